"""Mosaicing: two images on one canvas, tie points, and balancing of overlaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import samples as s
from ..raster import Raster


def merge(a: Raster, b: Raster, direction: str, dx: int, dy: int, blend: int = 10) -> Raster:
    """b stands at (-dx, -dy) of a on the union canvas. Pixels that are zero in all bands are
    transparent. In each line the overlap (at most `blend` wide, about its middle) is a linear
    feather; outside it the image on that side shows."""
    bx, by = -dx, -dy
    left, top = min(0, bx), min(0, by)
    width, height = max(a.width, bx + b.width) - left, max(a.height, by + b.height) - top
    pa = a.remap(F.col("y") - top, F.col("x") - left).df.withColumnRenamed("v", "va")
    pb = b.remap(F.col("y") + (by - top), F.col("x") + (bx - left)).df.withColumnRenamed("v", "vb")
    both = pa.join(pb, a.at, "full")
    solid = both.groupBy(*a.pixel).agg(F.max(F.coalesce((F.col("va") != 0).cast("int"), F.lit(0))).alias("sa"), F.max(F.coalesce((F.col("vb") != 0).cast("int"), F.lit(0))).alias("sb"))
    line, along = ("y", "x") if direction == "horizontal" else ("x", "y")
    seam = solid.groupBy(*a.keys, line).agg(F.min(F.when(F.col("sb") == 1, F.col(along))).alias("lo"), F.max(F.when(F.col("sa") == 1, F.col(along))).alias("hi"))
    middle = (F.col("lo") + F.col("hi")) / 2.0
    lo, hi = F.greatest(F.col("lo").cast("double"), middle - blend / 2), F.least(F.col("hi").cast("double"), middle + blend / 2)
    rows = both.join(solid, a.pixel).join(seam, [*a.keys, line])
    t = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(along) - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)))).otherwise(F.when(F.col(along) >= lo, 1.0).otherwise(0.0))
    v = F.when((F.col("sa") == 1) & (F.col("sb") == 1), s.from_double(F.col("va") * (F.lit(1.0) - t) + F.col("vb") * t, a.fmt).cast("double")).when(F.col("sb") == 1, F.col("vb").cast("double")).otherwise(F.coalesce(F.col("va").cast("double"), F.lit(0.0)))
    from .geometry import filled

    return filled(a.with_df(rows.withColumn("v", v.cast(a.fmt.stored))), width, height)


def lrmerge(a: Raster, b: Raster, dx: int, dy: int, overlap: int = 10) -> Raster:
    return merge(a, b, "horizontal", dx, dy, overlap)


def tbmerge(a: Raster, b: Raster, dx: int, dy: int, overlap: int = 10) -> Raster:
    return merge(a, b, "vertical", dx, dy, overlap)


def mosaic(a: Raster, b: Raster, direction: str, xref: int, yref: int, xsec: int, ysec: int, blend: int = 10) -> Raster:
    """One tie point gives the displacement."""
    return merge(a, b, direction, xsec - xref, ysec - yref, blend)


def tie_points(a: Raster, b: Raster, dx: int, dy: int, radius: int) -> DataFrame:
    """Correlation of the overlap for every displacement within `radius` of (dx, dy); the best
    first (ties: the least distance). Each sample of b goes to (2 radius + 1)^2 offsets in its
    task; sums are combined before the shuffle."""
    n = 2 * radius + 1
    offsets = F.array(*[F.struct(F.lit(i).alias("oy"), F.lit(j).alias("ox")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    right = b.df.where("band = 0").withColumn("o", F.explode(offsets)) if n > 1 else b.df.where("band = 0").withColumn("o", offsets[0])
    right = right.select(*b.keys, (F.col("y") - (F.lit(dy) + F.col("o.oy"))).cast("int").alias("y"), (F.col("x") - (F.lit(dx) + F.col("o.ox"))).cast("int").alias("x"), "o", F.col("v").cast("double").alias("w"))
    both = a.df.where("band = 0").select(*a.pixel, F.col("v").cast("double").alias("v")).join(right, a.pixel)
    v, w = F.col("v"), F.col("w")
    sums = both.groupBy(*a.keys, "o").agg(F.count("*").alias("n"), F.sum(v).alias("sv"), F.sum(w).alias("sw"), F.sum(v * v).alias("vv"), F.sum(w * w).alias("ww"), F.sum(v * w).alias("vw"))
    den = F.sqrt(F.greatest(F.lit(0.0), (F.col("vv") - F.col("sv") ** 2 / F.col("n")) * (F.col("ww") - F.col("sw") ** 2 / F.col("n"))))
    corr = F.when(den < 1e-9, F.lit(0.0)).otherwise((F.col("vw") - F.col("sv") * F.col("sw") / F.col("n")) / F.when(den < 1e-9, F.lit(1.0)).otherwise(den))
    return sums.select(*a.keys, (F.col("o.ox") + dx).alias("dx"), (F.col("o.oy") + dy).alias("dy"), F.round(corr, 9).alias("corr"), (F.abs("o.ox") + F.abs("o.oy")).alias("far"))


def best_tie(a: Raster, b: Raster, dx: int, dy: int, radius: int) -> DataFrame:
    t = tie_points(a, b, dx, dy, radius)
    return t.groupBy(*a.keys).agg(F.min_by(F.struct("dx", "dy", "corr"), F.struct(-F.col("corr"), "far", "dy", "dx")).alias("t")).select(*a.keys, "t.dx", "t.dy", "t.corr")


def auto_mosaic(a: Raster, b: Raster, direction: str, xref: int, yref: int, xsec: int, ysec: int, radius: int, blend: int = 10) -> Raster:
    """Search-refined displacement, then merge (one pair of images: one row comes back)."""
    row = best_tie(a, b, xsec - xref, ysec - yref, radius).first()
    return merge(a, b, direction, row["dx"], row["dy"], blend)


def match(pairs: list[tuple[float, float, float, float]]) -> tuple[float, ...]:
    """(xref, yref, xsec, ysec) pairs to (a, b, c, d, tx, ty): one gives a translation, two a
    similarity, more a least-squares affine map of the secondary onto the reference."""
    p = np.array(pairs, float)
    if len(p) == 1:
        return (1.0, 0.0, 0.0, 1.0, p[0, 0] - p[0, 2], p[0, 1] - p[0, 3])
    if len(p) == 2:
        z, w = p[:, 0] + 1j * p[:, 1], p[:, 2] + 1j * p[:, 3]
        k = (z[1] - z[0]) / (w[1] - w[0])
        t = z[0] - k * w[0]
        return (k.real, -k.imag, k.imag, k.real, t.real, t.imag)
    m = np.column_stack([p[:, 2], p[:, 3], np.ones(len(p))])
    (a, b, tx), (c, d, ty) = (np.linalg.lstsq(m, p[:, i], rcond=None)[0] for i in (0, 1))
    return tuple(map(float, (a, b, c, d, tx, ty)))


def chkpair(pairs: list[tuple[float, float, float, float]], threshold: float) -> list[int]:
    """Indices of the pairs that the best affine map of any three of them explains."""
    from itertools import combinations

    p, best = np.array(pairs, float), []
    for three in combinations(range(len(p)), min(3, len(p))):
        a, b, c, d, tx, ty = match([tuple(p[i]) for i in three])
        far = np.hypot(a * p[:, 2] + b * p[:, 3] + tx - p[:, 0], c * p[:, 2] + d * p[:, 3] + ty - p[:, 1])
        inliers = np.flatnonzero(far <= threshold).tolist()
        if len(inliers) > len(best):
            best = inliers
    return best


def global_balance(overlaps: DataFrame, tiles: int, rounds: int = 200) -> list[float]:
    """Gains that make tiles agree on their overlaps. overlaps: (overlap, tile, v) samples; the
    means are a distributed aggregate, the small least-squares system of logarithms is solved by
    Gauss-Seidel steps on the driver (one row per overlap and tile)."""
    means: dict[int, list[tuple[int, float]]] = {}
    for row in overlaps.groupBy("overlap", "tile").agg(F.avg("v").alias("m")).collect():
        means.setdefault(row["overlap"], []).append((row["tile"], row["m"]))
    links = [(*sorted(v),) for v in means.values() if len(v) == 2 and min(m for _, m in v) > 0]
    g = np.zeros(tiles)
    for _ in range(rounds):
        for t in range(1, tiles):
            want = [g[j] + np.log(mj) - np.log(mi) for (i, mi), (j, mj) in links if i == t] + [g[i] + np.log(mi) - np.log(mj) for (i, mi), (j, mj) in links if j == t]
            if want:
                g[t] = float(np.mean(want))
    return np.exp(g - g.mean()).tolist()


def remosaic(r: Raster, gain: float) -> Raster:
    return r.map(lambda v: s.from_double(v * gain, r.fmt))
