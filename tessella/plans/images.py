"""The images that the queries read: views over the driver's tables, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import samples as s
from ..raster import Raster, column_expression

# The same views as SQL.
EMB = "(SELECT CAST(vec_id AS INT) AS y, CAST(i AS INT) AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings CROSS JOIN range(0, 64) t(i))"
U8 = f"(SELECT y, x, CAST(greatest(0, least(255, floor((v + 1) * 127.5))) AS INT) AS v FROM {EMB})"
I16 = f"(SELECT y, x, CAST(trunc(v * 40000) AS INT) AS v FROM (SELECT y, x, greatest(-0.8, least(0.8, v)) AS v FROM {EMB}))"
POS = f"(SELECT y, x, v / 255.0 AS v FROM (SELECT y, x, CAST(v AS DOUBLE) AS v FROM {U8}))"
RGB = f"(SELECT y, x // 3 AS x, max(CASE WHEN x % 3 = 0 THEN v END) AS r, max(CASE WHEN x % 3 = 1 THEN v END) AS g, max(CASE WHEN x % 3 = 2 THEN v END) AS b FROM {U8} WHERE x < 63 GROUP BY y, x // 3)"
HEAT = "(SELECT CAST(l_suppkey % 64 AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x, CAST(count(*) AS INT) AS v FROM lineitem GROUP BY ALL)"
RAMP = "(SELECT CAST(i // 64 AS INT) AS y, CAST(i % 64 AS INT) AS x, CAST(((i % 64) * 17 + (i // 64) * 13 + 5) % 256 AS INT) AS v FROM range(0, 64 * 48) t(i))"
OTHER = "(SELECT CAST(i // 64 AS INT) AS y, CAST(i % 64 AS INT) AS x, CAST(((i % 64) * 9 + (i // 64) * 21 + 11) % 256 AS INT) AS v FROM range(0, 64 * 48) t(i))"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def emb(spark: SparkSession, d: str) -> Raster:
    """One row per vector, 64 columns; the height is the table's row count (from metadata)."""
    t = _table(spark, d, "embeddings")
    df = t.select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return Raster(df.select("y", "x", F.lit(0).alias("band"), F.col("v").cast("double").alias("v")), 64, t.count(), 1, s.F64)


def u8(spark: SparkSession, d: str) -> Raster:
    return emb(spark, d).map(lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v + 1) * 127.5))).cast("int"), s.U8)


def i16(spark: SparkSession, d: str) -> Raster:
    return emb(spark, d).map(lambda v: s.trunc(F.greatest(F.lit(-0.8), F.least(F.lit(0.8), v)) * 40000).cast("int"), s.I16)


def pos(spark: SparkSession, d: str) -> Raster:
    return u8(spark, d).map(lambda v: v.cast("double") / 255.0, s.F64)


def rgb(spark: SparkSession, d: str) -> Raster:
    from ..operators import bands

    r = u8(spark, d)
    return bands.bandfold(r.with_df(r.df.where("x < 63"), width=63), 3)


def heat(spark: SparkSession, d: str) -> Raster:
    from ..operators import geometry

    t = _table(spark, d, "lineitem")
    df = t.groupBy((F.col("l_suppkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x")).agg(F.count("*").cast("int").alias("v"))
    return geometry.filled(Raster(df.select("y", "x", F.lit(0).alias("band"), "v"), 64, 64, 1, s.U32), 64, 64)


def ramp(spark: SparkSession, d: str = "") -> Raster:
    return column_expression(spark, 64, 48, lambda y, x: (x * 17 + y * 13 + 5) % 256, s.U8)


def other(spark: SparkSession, d: str = "") -> Raster:
    return column_expression(spark, 64, 48, lambda y, x: (x * 9 + y * 21 + 11) % 256, s.U8)


VIEWS = {"emb": (emb, EMB), "u8": (u8, U8), "i16": (i16, I16), "pos": (pos, POS), "ramp": (ramp, RAMP), "other": (other, OTHER)}


class Catalogue:
    """Queries and oracles by name."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"two queries are named {name}")
        self.queries[name] = query
        if sql is not None:
            self.oracles[name] = sql

    def image(self, name: str, build, sql: str | None = None, real: bool = False, band: bool = False) -> None:
        """A query that gives an image: build(spark, dir) is a raster. Real samples are
        rounded to six digits in both engines."""

        def query(spark, d):
            r = build(spark, d)
            v = F.round(F.col("v").cast("double"), 6) + F.lit(0.0) if real else F.col("v").cast("bigint")
            return r.df.select("y", "x", *(["band"] if band else []), v.alias("v"))

        if sql is not None:
            v = "round(CAST(v AS DOUBLE), 6) + 0.0" if real else "CAST(v AS BIGINT)"
            sql = f"SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, {'CAST(band AS INT) AS band, ' if band else ''}{v} AS v FROM ({sql})"
        self.add(name, query, sql)

    def pixel(self, name: str, view: str, f, sql: str, real: bool = False, fmt: s.Format | None = None) -> None:
        """A function of each sample of a view."""
        source, text = VIEWS[view]
        self.image(name, lambda spark, d: source(spark, d).map(f, fmt), f"SELECT y, x, {sql} AS v FROM {text}", real)

    def table(self, name: str, build, sql: str | None = None) -> None:
        self.add(name, build, sql)
