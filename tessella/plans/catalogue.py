"""The raster queries and their SQL, gathered from the modules beside this one."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from . import colour_plans, create_plans, pixel_plans, source_plans, spatial_plans, stats_plans
from .images import EMB, Catalogue, emb


@cache
def catalogue() -> Catalogue:
    c = Catalogue()

    def flagship(spark, d):
        r = emb(spark, d).map(lambda v: v * 2 + 1)
        v = F.col("v")
        return r.df.groupBy("x").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"))

    c.table("linear_column_stats", flagship, f"SELECT x, round(avg(v * 2 + 1), 6) AS mean, round(min(v * 2 + 1), 6) AS low, round(max(v * 2 + 1), 6) AS high FROM {EMB} GROUP BY x")
    for module in MODULES:
        module.register(c)
    return c


MODULES = [pixel_plans, spatial_plans, stats_plans, colour_plans, create_plans, source_plans]


def queries() -> dict:
    return catalogue().queries


def oracles() -> dict[str, str]:
    return catalogue().oracles
