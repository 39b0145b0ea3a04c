"""Drawing: each figure is an expression of the place, or a short list of places, laid over."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import samples as s
from ..raster import Raster


def _ink(r: Raster, ink: list[float]) -> Column:
    return F.get(F.array(*[F.lit(v).cast(r.fmt.stored) for v in ink]), F.col("band"))


def _paint(r: Raster, where: Column, ink: list[float]) -> Raster:
    return r.with_df(r.df.withColumn("v", F.when(where, _ink(r, ink)).otherwise(F.col("v"))))


def _places(r: Raster, points: set[tuple[int, int]]) -> Column:
    inside = sorted(y * r.width + x for y, x in points if 0 <= y < r.height and 0 <= x < r.width)
    return F.array_contains(F.array(*map(F.lit, inside)), F.col("y") * r.width + F.col("x")) if inside else F.lit(False)


def draw_point(r: Raster, x: int, y: int, ink: list[float]) -> Raster:
    return _paint(r, (F.col("x") == x) & (F.col("y") == y), ink)


def draw_rect(r: Raster, left: int, top: int, width: int, height: int, ink: list[float], fill: bool = True) -> Raster:
    inside = F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)
    if not fill:
        inside = inside & ((F.col("x") == left) | (F.col("x") == left + width - 1) | (F.col("y") == top) | (F.col("y") == top + height - 1))
    return _paint(r, inside, ink)


def line_points(x1: int, y1: int, x2: int, y2: int) -> set[tuple[int, int]]:
    dx, dy = abs(x2 - x1), -abs(y2 - y1)
    sx, sy, err, out = (1 if x1 < x2 else -1), (1 if y1 < y2 else -1), abs(x2 - x1) - abs(y2 - y1), set()
    while True:
        out.add((y1, x1))
        if (x1, y1) == (x2, y2):
            return out
        e = 2 * err
        if e >= dy:
            err, x1 = err + dy, x1 + sx
        if e <= dx:
            err, y1 = err + dx, y1 + sy


def draw_line(r: Raster, x1: int, y1: int, x2: int, y2: int, ink: list[float]) -> Raster:
    return _paint(r, _places(r, line_points(x1, y1, x2, y2)), ink)


def circle_points(cx: int, cy: int, radius: int) -> set[tuple[int, int]]:
    out, x, y, d = set(), radius, 0, 1 - radius
    while x >= y:
        for a, b in ((x, y), (y, x)):
            out |= {(cy + p * b, cx + q * a) for p in (1, -1) for q in (1, -1)}
        y += 1
        if d < 0:
            d += 2 * y + 1
        else:
            x -= 1
            d += 2 * (y - x) + 1
    return out


def draw_circle(r: Raster, cx: int, cy: int, radius: int, ink: list[float], fill: bool = False) -> Raster:
    points = circle_points(cx, cy, radius)
    if fill:
        spans: dict[int, list[int]] = {}
        for y, x in points:
            spans.setdefault(y, []).append(x)
        test = F.lit(False)
        for y, xs in spans.items():
            test = test | ((F.col("y") == y) & F.col("x").between(min(xs), max(xs)))
        return _paint(r, test, ink)
    return _paint(r, _places(r, points), ink)


def draw_flood(r: Raster, x: int, y: int, ink: list[float]) -> Raster:
    """The 4-connected region of equal samples around a seed."""
    from .neighbourhood import label_regions

    named = label_regions(r)
    seed = named.df.where((F.col("x") == x) & (F.col("y") == y)).select(*r.keys, F.col("v").alias("__seed"))
    region = named.df.join(F.broadcast(seed), list(r.keys)) if r.keys else named.df.join(F.broadcast(seed), F.lit(True))
    hit = region.where("v = __seed").select(*r.pixel, F.lit(True).alias("__hit"))
    return r.with_df(r.df.join(hit, r.pixel, "left").withColumn("v", F.when(F.col("__hit"), _ink(r, ink)).otherwise(F.col("v"))))


def draw_image(r: Raster, sub: Raster, x: int, y: int, mode: str = "set") -> Raster:
    """set, or add with saturation (16-bit signed samples saturate to -128..127 in this mode)."""
    moved = sub.remap(F.col("y") + y, F.col("x") + x).df.withColumnRenamed("v", "__w")
    fmt = s.Format("i8", -128, 127, 8, "int", "bigint") if r.fmt.name == "i16" else r.fmt
    new = F.col("__w") if mode == "set" else s.add(F.col("v"), F.col("__w"), fmt)
    return r.with_df(r.df.join(moved, r.at, "left").withColumn("v", F.when(F.col("__w").isNull(), F.col("v")).otherwise(new)))


def draw_mask(r: Raster, mask: Raster, x: int, y: int, ink: list[float]) -> Raster:
    """Ink by an 8-bit mask: (ink m + v (255 - m)) / 255."""
    moved = mask.remap(F.col("y") + y, F.col("x") + x).df.where("band = 0").drop("band").withColumnRenamed("v", "__m")
    v = (_ink(r, ink) * F.col("__m") + F.col("v") * (F.lit(255) - F.col("__m"))) / 255
    return r.with_df(r.df.join(moved, r.pixel, "left").withColumn("v", F.when(F.col("__m").isNull(), F.col("v")).otherwise(s.truncated(v, r.fmt))))


def draw_smudge(r: Raster, left: int, top: int, width: int, height: int) -> Raster:
    """3 x 3 means written in place in raster order, so later means read earlier ones. This
    order is sequential: one image's region is one group of Arrow rows."""
    import pandas as pd

    keys, w, h, whole = list(r.keys), r.width, r.height, r.fmt.integral
    y0, y1, x0, x1 = max(0, top), min(h, top + height), max(0, left), min(w, left + width)
    near = r.df.where(F.col("y").between(y0 - 1, y1) & F.col("x").between(x0 - 1, x1))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = {(int(y), int(x)): float(k) for y, x, k in zip(g.y, g.x, g.v, strict=True)}
        for y in range(y0, y1):
            for x in range(x0, x1):
                around = [v[a, b] for a in (y - 1, y, y + 1) for b in (x - 1, x, x + 1) if (a, b) in v]
                m = sum(around) / len(around)
                v[y, x] = math.floor(m + 0.5) if whole else m
        return g.assign(v=[v[int(y), int(x)] for y, x in zip(g.y, g.x, strict=True)])

    schema = r.df.select(*r.at, F.col("v").cast("double").alias("v")).schema
    done = near.select(*r.at, F.col("v").cast("double").alias("v")).groupBy(*keys, "band").applyInPandas(run, schema)
    rest = r.df.where(~(F.col("y").between(y0 - 1, y1) & F.col("x").between(x0 - 1, x1)))
    return r.with_df(rest.unionByName(done.withColumn("v", F.col("v").cast(r.fmt.stored))))
