"""Whole-image statistics: partial and final aggregates, one result row per image."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import samples as s
from ..raster import Raster


def avg(r: Raster) -> DataFrame:
    return r.df.groupBy(*r.keys).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("avg"))


def deviate(r: Raster) -> DataFrame:
    """Sample standard deviation; 0 for one sample."""
    return r.df.groupBy(*r.keys).agg(F.coalesce(F.nanvl(F.stddev_samp("v"), F.lit(0.0)), F.lit(0.0)).alias("deviate"))


def _extreme(r: Raster, sign: int) -> DataFrame:
    """Value and place; not-a-numbers are skipped; ties go to the least y, then x."""
    good = r.df.where(~F.isnan(F.col("v").cast("double")))
    best = good.groupBy(*r.keys).agg(F.min(F.struct((F.col("v") * sign).alias("k"), "y", "x", "band")).alias("m"))
    return best.select(*r.keys, (F.col("m.k") * sign).alias("v"), F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.col("m.band").alias("band"))


def minimum(r: Raster) -> DataFrame:
    return _extreme(r, 1)


def maximum(r: Raster) -> DataFrame:
    return _extreme(r, -1)


def stats(r: Raster) -> DataFrame:
    """Row 0: all bands; row b + 1: band b. One rollup."""
    good = r.df.where(~F.isnan(F.col("v").cast("double")))
    low, high = F.min(F.struct("v", "y", "x")), F.min(F.struct((-F.col("v")).alias("k"), "y", "x"))
    sets = good.groupingSets([[*r.keys, "band"], [*r.keys]] if r.keys else [["band"], []], *r.keys, "band")
    out = sets.agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"), F.sum(F.col("v") * F.col("v")).alias("sum_sq"), F.avg("v").alias("avg"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stddev"), low.alias("lo"), high.alias("hi"), F.grouping("band").alias("g"),
    )
    row = F.when(F.col("g") == 1, 0).otherwise(F.col("band") + 1).alias("row")
    return out.select(*r.keys, row, "min", "max", "sum", "sum_sq", "avg", "stddev", F.col("lo.x").alias("x_min"), F.col("lo.y").alias("y_min"), F.col("hi.x").alias("x_max"), F.col("hi.y").alias("y_max"))


def image_stats(r: Raster) -> DataFrame:
    """Per band, with the population standard deviation."""
    return r.df.groupBy(*r.keys, "band").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"))


def getpoint(r: Raster, points: list[tuple[int, int]]) -> DataFrame:
    """Samples at points (x, y), in the order asked for."""
    asked = F.broadcast(r.df.sparkSession.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "ordinal int, x int, y int"))
    return r.df.join(asked, ["x", "y"]).select(*r.keys, "ordinal", "band", "v")


def measure(r: Raster) -> DataFrame:
    return r.df.groupBy(*r.keys, "band").agg(F.avg("v").alias("mean"))


def find_trim(r: Raster, threshold: float, background: list[float]) -> DataFrame:
    """The box of pixels that differ from the background; zeros if there are none."""
    bg = F.get(F.array(*map(F.lit, map(float, background))), F.col("band"))
    hit = r.df.where(F.abs(F.col("v") - bg) > threshold)
    box = hit.groupBy(*r.keys).agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    whole = r.images().join(box, list(r.keys), "left") if r.keys else box
    z = lambda c: F.coalesce(c, F.lit(0))
    return whole.select(*r.keys, z(F.col("left")).alias("left"), z(F.col("top")).alias("top"), z(F.col("x1") - F.col("left") + 1).alias("width"), z(F.col("y1") - F.col("top") + 1).alias("height"))


def project(r: Raster) -> DataFrame:
    """Sums of columns and of rows, per band."""
    cols = r.df.groupBy(*r.keys, "band", F.col("x").alias("place")).agg(F.sum("v").alias("sum")).withColumn("axis", F.lit("column"))
    rows = r.df.groupBy(*r.keys, "band", F.col("y").alias("place")).agg(F.sum("v").alias("sum")).withColumn("axis", F.lit("row"))
    return cols.unionByName(rows)


def profile(r: Raster) -> DataFrame:
    """First sample that is not zero, per column and per row; the extent where there is none."""
    hit = F.col("v") != 0
    cols = r.df.groupBy(*r.keys, "band", F.col("x").alias("place")).agg(F.coalesce(F.min(F.when(hit, F.col("y"))), F.lit(r.height)).alias("first")).withColumn("axis", F.lit("column"))
    rows = r.df.groupBy(*r.keys, "band", F.col("y").alias("place")).agg(F.coalesce(F.min(F.when(hit, F.col("x"))), F.lit(r.width)).alias("first")).withColumn("axis", F.lit("row"))
    return cols.unionByName(rows)


# ---------------------------------------------------------------- histograms of images


def _dense(counts: DataFrame, r: Raster, bins: int, keys: list[str]) -> DataFrame:
    """All bins, with zero where none fell."""
    base = counts.select(*keys).distinct() if keys else counts.sparkSession.range(1).select()
    full = base.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return full.join(counts, [*keys, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def hist_find(r: Raster, bins: int = 256) -> DataFrame:
    """Counts per band; samples rounded and clamped."""
    b = s.round_away(F.greatest(F.lit(0.0), F.least(F.lit(float(bins - 1)), F.col("v").cast("double")))).cast("int")
    counts = r.df.groupBy(*r.keys, "band", b.alias("bin")).agg(F.count("*").alias("count"))
    return _dense(counts, r, bins, [*r.keys, "band"])


def hist_find_scaled(r: Raster, band: int, bins: int) -> DataFrame:
    """Counts of floor(v / 255 * bins) of one band, whatever the format."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("v") / 255.0 * bins))).cast("int")
    counts = r.df.where(F.col("band") == band).groupBy(*r.keys, b.alias("bin")).agg(F.count("*").alias("count"))
    return _dense(counts, r, bins, list(r.keys))


def hist_find_ndim(r: Raster, bins: int, max_value: int = 255) -> DataFrame:
    """Joint counts of up to three bands."""
    width = (max_value + 1) / bins
    names = [f"bin{i}" for i in range(r.bands)]
    at = [F.least(F.lit(bins - 1), F.floor(F.col(f"b{i}") / width)).cast("int").alias(n) for i, n in enumerate(names)]
    return r.wide().groupBy(*r.keys, *at).agg(F.count("*").alias("count"))


def hist_find_indexed(r: Raster, index: Raster, max_index: int) -> DataFrame:
    """Counts of pixels per value of an index image (samples are not added up)."""
    i = index.df.where("band = 0").select(*r.pixel, F.least(F.lit(max_index), F.col("v")).cast("int").alias("bin"))
    return r.df.join(i, r.pixel).groupBy(*r.keys, "band", "bin").agg(F.count("*").alias("count"))


def hist_equal_lut(r: Raster, band: int = 0, bins: int = 256) -> DataFrame:
    """The equalising table round((cdf - cdf_min) / (n - cdf_min) * 255); the identity for an
    image of one value."""
    h = hist_find_scaled(r, band, bins)
    w = Window.partitionBy(*r.keys)
    c = h.withColumn("cum", F.sum("count").over(w.orderBy("bin")))
    c = c.withColumns({"least": F.min(F.when(F.col("count") > 0, F.col("cum"))).over(w), "n": F.sum("count").over(w)})
    span = F.col("n") - F.col("least")
    v = s.round_away(F.greatest(F.lit(0.0), (F.col("cum") - F.col("least")) / F.when(span == 0, F.lit(1)).otherwise(span)) * 255)
    return c.select(*r.keys, "bin", F.when(span == 0, F.col("bin")).otherwise(v).cast("int").alias("v"))


def hist_equal(r: Raster, band: int = 0) -> Raster:
    """An 8-bit image through its own equalising table (256 rows an image)."""
    lut = hist_equal_lut(r, band).withColumnsRenamed({"bin": "__b", "v": "__v"})
    on = [F.col(f"a.{k}") == F.col(f"l.{k}") for k in r.keys] + [F.col("a.v").cast("int") == F.col("l.__b")]
    df = r.df.alias("a").join(lut.alias("l"), on).select(*[F.col(f"a.{c}").alias(c) for c in r.at], F.col("__v").alias("v"))
    return r.with_df(df, fmt=s.U8)


def hough_line(r: Raster, width: int, height: int, threshold: float) -> DataFrame:
    """Votes (theta, rho) of the samples above the threshold. Each votes once per angle; the
    angles are a generator in the task and votes are combined before the shuffle."""
    theta = F.col("theta") * (math.pi / width)
    half = math.hypot(r.width, r.height)
    rho = F.floor(((F.col("x") * F.cos(theta) + F.col("y") * F.sin(theta)) / half + 1) * 0.5 * (height - 1) + 0.5).cast("int")
    hits = r.df.where(F.col("v") > threshold).withColumn("theta", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return hits.groupBy(*r.keys, "theta", rho.alias("rho")).agg(F.count("*").alias("votes"))


def hough_circle(r: Raster, scale: int, min_radius: int, max_radius: int, threshold: float) -> DataFrame:
    """Votes (radius, y, x) for centres at 1 / scale."""
    points = [(k, round(k / scale * math.sin(t)), round(k / scale * math.cos(t))) for k in range(min_radius, max_radius + 1, scale) for t in [2 * math.pi * i / max(8, 8 * k // scale) for i in range(max(8, 8 * k // scale))]]
    cells = F.array(*[F.struct(F.lit(k).alias("radius"), F.lit(a).alias("dy"), F.lit(b).alias("dx")) for k, a, b in sorted(set(points))])
    hits = r.df.where(F.col("v") > threshold).withColumn("p", F.explode(cells))
    cy, cx = (F.floor(F.col("y") / scale) + F.col("p.dy")).cast("int"), (F.floor(F.col("x") / scale) + F.col("p.dx")).cast("int")
    votes = hits.groupBy(*r.keys, F.col("p.radius").alias("radius"), cy.alias("y"), cx.alias("x")).agg(F.count("*").alias("votes"))
    return votes.where(F.col("y").between(0, r.height // scale - 1) & F.col("x").between(0, r.width // scale - 1))


# ---------------------------------------------------------------- tables of counts


def _over(h: DataFrame, keys: list[str]):
    return Window.partitionBy(*keys)


def hist_cum(h: DataFrame, keys: list[str] = ["band"]) -> DataFrame:  # noqa: B006
    return h.withColumn("count", F.sum("count").over(_over(h, keys).orderBy("bin")))


def hist_norm(h: DataFrame, keys: list[str] = ["band"]) -> DataFrame:  # noqa: B006
    w = _over(h, keys)
    return h.withColumn("count", F.col("count") / F.max("count").over(w) * (F.max("bin").over(w)))


def hist_percent(h: DataFrame, share: float, keys: list[str] = ["band"]) -> DataFrame:  # noqa: B006
    """The first bin at which the running count reaches the share of all."""
    w = _over(h, keys)
    c = h.withColumns({"cum": F.sum("count").over(w.orderBy("bin")), "n": F.sum("count").over(w)})
    return c.where(F.col("cum") >= F.col("n") * share).groupBy(*keys).agg(F.min("bin").alias("bin"))


def hist_entropy(h: DataFrame, keys: list[str] = ["band"]) -> DataFrame:  # noqa: B006
    p = F.greatest(F.col("count"), F.lit(0)) / F.sum("count").over(_over(h, keys))
    return h.withColumn("p", p).where("p > 0").groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def hist_ismonotonic(h: DataFrame, keys: list[str] = ["band"]) -> DataFrame:  # noqa: B006
    up = F.col("count") >= F.coalesce(F.lag("count").over(_over(h, keys).orderBy("bin")), F.col("count"))
    return h.withColumn("up", up).groupBy(*keys).agg(F.bool_and("up").cast("int").alias("monotonic"))


def hist_plot(h: DataFrame, height: int, keys: list[str] = ["band"]) -> DataFrame:  # noqa: B006
    """Bars: 255 up to the count's share of the greatest, from below."""
    bar = F.floor(F.col("count") / F.max("count").over(_over(h, keys)) * (height - 1) + 0.5)
    rows = h.withColumn("bar", bar).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return rows.select(*keys, "y", F.col("bin").alias("x"), F.when(F.lit(height - 1) - F.col("y") <= F.col("bar"), 255).otherwise(0).alias("v"))


def hist_match(source: DataFrame, target: DataFrame, keys: list[str] = ["band"]) -> DataFrame:  # noqa: B006
    """For each bin of a running count the bin of the other whose running count is nearest.

    An as-of join by a merge of both lists: the last target count below and the first not
    below, by running windows over their union."""
    s1 = source.select(*keys, F.col("count").alias("c"), "bin", F.lit(1).alias("side"))
    t1 = target.select(*keys, F.col("count").alias("c"), "bin", F.lit(0).alias("side"))
    both = s1.unionByName(t1)
    w = _over(both, keys)
    t = F.when(F.col("side") == 0, F.struct("c", "bin"))
    above = F.first(t, ignorenulls=True).over(w.orderBy("c", F.desc("side"), "bin").rowsBetween(0, Window.unboundedFollowing))
    below = F.last(t, ignorenulls=True).over(w.orderBy("c", F.desc("side"), "bin").rowsBetween(Window.unboundedPreceding, 0))
    m = both.withColumns({"a": above, "b": below}).where("side = 1")
    pick = F.when(F.col("a").isNull(), F.col("b.bin")).when(F.col("b").isNull(), F.col("a.bin"))
    pick = pick.when(F.col("c") - F.col("b.c") < F.col("a.c") - F.col("c"), F.col("b.bin")).otherwise(F.col("a.bin"))
    return m.select(*keys, "bin", pick.alias("v"))


def stdif(r: Raster, width: int, height: int, a: float, m0: float, b: float, s0: float) -> Raster:
    """Statistical differencing by each window's mean and deviation."""
    from .neighbourhood import _offsets, neighbours

    w = F.col("w").cast("double")
    near = neighbours(r, _offsets(height, width)).groupBy(*r.at).agg(F.avg(w).alias("m"), F.avg(w * w).alias("q"))
    sd = F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))
    v = (F.col("v") - F.col("m")) * (F.lit(b * s0) / (F.lit(s0) + sd * b)) + a * m0 + F.col("m") * (1 - a)
    return r.with_df(r.df.join(near, r.at).withColumn("v", s.from_double(v, r.fmt)))


def clahe(r: Raster, width: int, height: int, clip_limit: float = 0.0) -> Raster:
    """Local equalisation in a sliding window; a clip limit over 1 bounds the curve's slope:
    counts above it are cut and shared out evenly."""
    from .neighbourhood import _offsets, neighbours

    n = width * height
    limit = math.floor(clip_limit + 0.5)
    near = neighbours(r, _offsets(height, width)).withColumn("centre", F.max(F.when(F.col("k") == (height // 2) * width + width // 2, F.col("w"))).over(Window.partitionBy(*r.at)))
    if limit <= 1:
        out = near.groupBy(*r.at).agg((F.sum((F.col("w") <= F.col("centre")).cast("int")) * 255 / n).alias("v"))
    else:
        per = near.groupBy(*r.at, "centre", "w").agg(F.count("*").alias("c"))
        cut = F.least(F.col("c"), F.lit(limit))
        out = per.groupBy(*r.at, "centre").agg(F.sum(F.when(F.col("w") <= F.col("centre"), cut).otherwise(0)).alias("a"), F.sum(F.col("c") - cut).alias("over"))
        out = out.withColumn("v", (F.col("a") + F.col("over") * F.col("centre") / 255) * 255 / n)
    return r.with_df(out.withColumn("v", s.from_double(F.col("v").cast("double"), s.U8)), fmt=s.U8)
