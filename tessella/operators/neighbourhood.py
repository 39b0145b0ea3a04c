"""Windows on the plane: convolution, edges, correlation, morphology and order statistics.

A stencil scatters: each sample goes to the places it contributes to, with its weight, and
an aggregation by place adds up. The scatter is a generator inside the task; sums are combined
before the shuffle, and the only shuffle is the one by place. Beyond the edges the image goes on
with its edge samples: each sample on an edge also stands for the places outside."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import samples as s
from ..raster import Raster


def neighbours(r: Raster, offsets: list[tuple[int, int]], extra: list[list[float]] | None = None):
    """Rows (keys, y, x, band, k, w) for each place and each offset k of a stencil: w is the
    sample at place + offset, edges extended."""
    dy, dx = [o[0] for o in offsets], [o[1] for o in offsets]
    up, down, left, right = -min([0, *dy]), max([0, *dy]), -min([0, *dx]), max([0, *dx])
    n = len(offsets)

    def sources(c: Column, size: int, low: int, high: int) -> Column:
        """All places (inside and outside) whose extended sample is at c."""
        if low == high == 0:
            return F.array(c)
        return F.sequence(F.when(c == 0, F.lit(-low)).otherwise(c), F.when(c == size - 1, F.lit(size - 1 + high)).otherwise(c))

    df = r.df
    if up or down:
        df = df.withColumn("y", F.explode(sources(F.col("y"), r.height, up, down)))
    if left or right:
        df = df.withColumn("x", F.explode(sources(F.col("x"), r.width, left, right)))
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(a).alias("dy"), F.lit(b).alias("dx")) for i, (a, b) in enumerate(offsets)])
    df = df.withColumn("__o", F.explode(cells)) if n > 1 else df.withColumn("__o", cells[0])
    df = df.select(*r.keys, (F.col("y") - F.col("__o.dy")).alias("y"), (F.col("x") - F.col("__o.dx")).alias("x"), "band", F.col("__o.k").alias("k"), F.col("v").alias("w"))
    return df.where(F.col("y").between(0, r.height - 1) & F.col("x").between(0, r.width - 1))


def _offsets(rows: int, cols: int) -> list[tuple[int, int]]:
    return [(y - rows // 2, x - cols // 2) for y in range(rows) for x in range(cols)]


def _weights(k: list[float]) -> Column:
    return F.get(F.array(*[F.lit(float(w)) for w in k]), F.col("k"))


def convolve(r: Raster, kernel: list[list[float]], scale: float = 1.0, offset: float = 0.0, precision: str = "float") -> Raster:
    """Weighted sum / scale + offset; integer precision rounds and keeps the format."""
    rows, cols = len(kernel), len(kernel[0])
    if rows % 2 == 0 or cols % 2 == 0 or any(len(k) != cols for k in kernel):
        raise ValueError("a kernel needs odd, equal sides")
    flat = [w for k in kernel for w in k]
    used = [(o, w) for o, w in zip(_offsets(rows, cols), flat, strict=True) if w]
    near = neighbours(r, [o for o, _ in used])
    out = near.groupBy(*r.at).agg((F.sum(_weights([w for _, w in used]) * F.col("w")) / scale + offset).alias("v"))
    if precision == "float":
        return r.with_df(out, fmt=s.F64)
    return r.with_df(out.withColumn("v", s.sat(F.rint("v"), r.fmt) if r.fmt.integral else F.col("v")))


def convsep(r: Raster, kernel: list[float]) -> Raster:
    return convolve(convolve(r, [kernel]), [[w] for w in kernel])


def conva(r: Raster, kernel: list[list[float]], layers: int = 5) -> Raster:
    """An approximate convolution may be computed exactly; it is."""
    return convolve(r, kernel)


def convasep(r: Raster, kernel: list[float], layers: int = 5) -> Raster:
    """Weights quantised to `layers` levels of the largest, rescaled to the kernel's sum."""
    top = max(map(abs, kernel))
    if len(kernel) == 1 or top == 0:
        return convsep(r, kernel)
    q = [math.copysign(math.floor(abs(w) / top * layers + 0.5), w) for w in kernel]
    k = sum(kernel) / sum(q) if sum(q) else top / layers
    return convsep(r, [w * k for w in q])


def gauss_kernel(sigma: float, least: float = 0.2) -> list[float]:
    """Taps rint(20 g), normalised; the radius ends where g falls below `least`."""
    radius = 0
    while math.exp(-((radius + 1) ** 2) / (2 * sigma * sigma)) >= least:
        radius += 1
    taps = [float(round(20 * math.exp(-(x * x) / (2 * sigma * sigma)))) for x in range(-radius, radius + 1)]
    return [t / sum(taps) for t in taps]


def gauss_blur(r: Raster, sigma: float) -> Raster:
    """Horizontal, then vertical; whole formats are clipped and rounded after each pass."""
    if sigma < 0.2:
        return r
    k = gauss_kernel(sigma)
    for kernel in ([k], [[w] for w in k]):
        out = convolve(r, kernel)
        r = out.map(lambda v, f=r.fmt: s.from_double(v, f), r.fmt) if r.fmt.name == "u8" else out
    return r


def sharpen(r: Raster, sigma: float = 0.5, strength: float = 1.0) -> Raster:
    """Unsharp mask."""
    return r.map(lambda v: v.cast("double"), s.F64).zip(convsep(r, gauss_kernel(sigma)), lambda v, b: v + (v - b) * strength)


def labs_sharpen(r: Raster, sigma: float, x1: float = 2.0, y2: float = 10.0, y3: float = 20.0, m1: float = 0.0, m2: float = 3.0) -> Raster:
    """Sharpens band 0 (L, 16 bits) by a piecewise line of the difference to the blurred one."""
    unit = 327.67
    light = r.with_df(r.df.where("band = 0"), bands=1)

    def f(v, b):
        d = (v - b) / unit
        small = F.when(F.abs(d) <= x1, d * m1).when(d > 0, F.lit(x1 * m1) + (d - x1) * m2).otherwise(F.lit(-x1 * m1) + (d + x1) * m2)
        return s.from_double(v + F.greatest(F.lit(-y3), F.least(F.lit(y2), small)) * unit, s.I16)

    sharp = light.map(lambda v: v.cast("double"), s.F64).zip(convsep(light, gauss_kernel(sigma)), f, s.I16)
    return r.with_df(sharp.df.unionByName(r.df.where("band > 0")))


def _turned(m: list[list[float]]) -> list[list[float]]:
    return [list(x) for x in zip(*m[::-1], strict=True)]


# The customary edge masks.
SOBEL = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SCHARR = [[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]]
PREWITT = [[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]]


def gradient(r: Raster, mask: list[list[float]], sum_abs: bool = False) -> Raster:
    """Modulus of the responses of a mask and the mask turned by 90 degrees, in one pass."""
    flat, turned = [w for k in mask for w in k], [w for k in _turned(mask) for w in k]
    near = neighbours(r, _offsets(len(mask), len(mask[0])))
    w = F.col("w").cast("double")
    out = near.groupBy(*r.at).agg(F.sum(_weights(flat) * w).alias("a"), F.sum(_weights(turned) * w).alias("b"))
    v = F.abs("a") + F.abs("b") if sum_abs else F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    return r.with_df(out.withColumn("v", v), fmt=s.F64)


def sobel(r: Raster) -> Raster:
    """8 bits: sum of absolute responses, at most 255; other formats: the modulus."""
    eight = r.fmt.name == "u8"
    out = gradient(r, SOBEL, eight)
    return out.map(lambda v: F.least(v, F.lit(255.0))) if eight else out


def scharr(r: Raster) -> Raster:
    return gradient(r, SCHARR)


def prewitt(r: Raster) -> Raster:
    return gradient(r, PREWITT)


def edge(r: Raster, mask: list[list[float]]) -> Raster:
    return gradient(r, mask).map(lambda v: s.from_double(v, s.U8), s.U8)


def compass(r: Raster, mask: list[list[float]], times: int = 8) -> Raster:
    """Greatest absolute response of the mask turned `times` times by 45 degrees."""
    from .geometry import rot45_map

    n = len(mask)
    kernels = []
    for t in range(times):
        k = [0.0] * (n * n)
        for y, x, ty, tx in rot45_map(n, t):
            k[ty * n + tx] = float(mask[y][x])
        kernels.append(k)
    near = neighbours(r, _offsets(n, n))
    w = F.col("w").cast("double")
    out = near.groupBy(*r.at).agg(*[F.abs(F.sum(_weights(k) * w)).alias(f"k{i}") for i, k in enumerate(kernels)])
    return r.with_df(out.withColumn("v", F.greatest(*[F.col(f"k{i}") for i in range(times)]) if times > 1 else F.col("k0")), fmt=s.F64)


def canny(r: Raster, sigma: float = 1.4) -> Raster:
    """Blur, 2 x 2 gradient, and suppression of samples that are not greatest along it: the
    neighbours on the gradient's line are interpolated."""
    g = convsep(r, gauss_kernel(sigma))
    near = neighbours(g, [(0, 0), (0, 1), (1, 0), (1, 1)])
    w = F.col("w")
    grad = near.groupBy(*r.at).agg(F.sum(_weights([-1, 1, -1, 1]) * w).alias("gx"), F.sum(_weights([-1, -1, 1, 1]) * w).alias("gy"))
    field = g.with_df(grad.withColumn("v", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)))
    around = neighbours(field, _offsets(3, 3)).groupBy(*r.at).agg(*[F.max(F.when(F.col("k") == i, F.col("w"))).alias(f"n{i}") for i in range(9)])
    both = around.join(grad, r.at)
    theta = F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(360.0)) / 45.0
    sector, part = (F.floor(theta) % 8).cast("int"), theta - F.floor(theta)
    ring = F.array(*[F.col(f"n{i}") for i in (5, 8, 7, 6, 3, 0, 1, 2)])

    def along(turn: int) -> Column:
        a, b = F.get(ring, (sector + turn) % 8), F.get(ring, (sector + turn + 1) % 8)
        return a * (F.lit(1.0) - part) + b * part

    centre = F.col("n4")
    return g.with_df(both.withColumn("v", F.when((centre <= along(0)) | (centre < along(4)), F.lit(0.0)).otherwise(centre)))


def fastcor(r: Raster, pattern: list[list[float]]) -> Raster:
    """Sum of squared differences to a pattern."""
    flat = [v for row in pattern for v in row]
    near = neighbours(r, _offsets(len(pattern), len(pattern[0])))
    d = F.col("w").cast("double") - _weights(flat)
    return r.with_df(near.groupBy(*r.at).agg(F.sum(d * d).alias("v")), fmt=s.F64)


def spcor(r: Raster, pattern: list[list[float]]) -> Raster:
    """Normalised correlation; 0 where either side is flat."""
    flat = [float(v) for row in pattern for v in row]
    n = len(flat)
    mean = sum(flat) / n
    centred = [v - mean for v in flat]
    power = sum(v * v for v in centred)
    w = F.col("w").cast("double")
    near = neighbours(r, _offsets(len(pattern), len(pattern[0])))
    out = near.groupBy(*r.at).agg(F.sum(w * _weights(centred)).alias("a"), (F.sum(w * w) - F.sum(w) * F.sum(w) / n).alias("b"))
    den = F.sqrt(F.greatest(F.col("b"), F.lit(0.0)) * power)
    flat_here = den < 1e-9
    return r.with_df(out.withColumn("v", F.when(flat_here, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("a") / F.when(flat_here, F.lit(1.0)).otherwise(den))))), fmt=s.F64)


# ---------------------------------------------------------------- morphology


def _morph(r: Raster, mask: list[list[int]], fold, start: int) -> Raster:
    """mask: 255 takes the sample, 0 its complement, 128 ignores the place."""
    flat = [m for row in mask for m in row]
    used = [(o, m) for o, m in zip(_offsets(len(mask), len(mask[0])), flat, strict=True) if m != 128]
    near = neighbours(r, [o for o, _ in used])
    take = F.get(F.array(*[F.lit(m) for _, m in used]), F.col("k"))
    w = F.when(take == 255, F.col("w")).otherwise(F.lit(255) - F.col("w"))
    return r.with_df(near.groupBy(*r.at).agg(fold(w.cast("int")).alias("v")))


def erode(r: Raster, mask: list[list[int]]) -> Raster:
    return _morph(r, mask, F.bit_and, 255)


def dilate(r: Raster, mask: list[list[int]]) -> Raster:
    return _morph(r, mask, F.bit_or, 0)


def opening(r: Raster, mask: list[list[int]]) -> Raster:
    return dilate(erode(r, mask), mask)


def closing(r: Raster, mask: list[list[int]]) -> Raster:
    return erode(dilate(r, mask), mask)


def rank(r: Raster, width: int, height: int, k: int) -> Raster:
    """The k-th smallest sample of each window."""
    if not 0 <= k < width * height:
        raise ValueError("the rank lies outside the window")
    near = neighbours(r, _offsets(height, width))
    return r.with_df(near.groupBy(*r.at).agg(F.array_sort(F.collect_list("w"))[k].alias("v")))


def median(r: Raster, width: int, height: int) -> Raster:
    if width % 2 == 0 or height % 2 == 0:
        raise ValueError("a median needs an odd window")
    return rank(r, width, height, width * height // 2)


def nearest(r: Raster) -> Raster:
    """Distance to the nearest sample that is not zero; infinite where there is none.

    Two passes of one dimension: first each column's distance to its nearest sample, by running
    windows; then, for each row, the least of dx^2 + column distance^2 over the row's
    columns. So a row meets its own columns only, never all other samples."""
    from pyspark.sql import Window

    col = Window.partitionBy(*r.keys, "band", "x")
    hit = F.when(F.col("v") != 0, F.col("y"))
    above = F.last(hit, ignorenulls=True).over(col.orderBy("y").rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(hit, ignorenulls=True).over(col.orderBy("y").rowsBetween(0, Window.unboundedFollowing))
    d = r.df.withColumn("d", F.least(F.col("y") - above, below - F.col("y"))).select(*r.keys, "band", "y", "x", "d")
    row = d.groupBy(*r.keys, "band", "y").agg(F.array_sort(F.collect_list(F.struct("x", "d"))).alias("c"))
    row = row.select(*r.keys, "band", "y", F.transform("c", lambda e: e["x"]).alias("x"), F.transform("c", lambda e: F.coalesce(e["d"], F.lit(-1))).alias("d"))
    done = row.mapInArrow(_row_distances, row.select(*r.keys, "band", "y", "x", F.array().cast("array<double>").alias("v")).schema)
    cells = done.select(*r.keys, "band", "y", F.explode(F.arrays_zip("x", "v")).alias("e"))
    return r.with_df(cells.select(*r.keys, "band", "y", "e.x", "e.v"), fmt=s.F64)


def _row_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (..., x, d), d the distance inside the column or -1: the distance of each x to
    the nearest sample, by the lower envelope of the columns' parabolas, linear in the width."""
    for b in batches:
        xs, ds, out = b.column("x"), b.column("d"), []
        ends = xs.offsets.to_numpy()
        x, d = (np.asarray(c.values)[ends[0] : ends[-1]].astype(np.int64) for c in (xs, ds))
        for lo, hi in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True):
            out.append(_envelope(x[lo:hi], d[lo:hi]))
        v = pa.array(np.concatenate([np.zeros(0), *out]))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), v)], names=[*b.schema.names[:-1], "v"])


def _envelope(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """sqrt(min over sites (x - site)^2 + d^2) for ascending x; d of -1 is no site."""
    sites = [(int(a), int(g) * int(g)) for a, g in zip(x[d >= 0], d[d >= 0], strict=True)]
    if not sites:
        return np.full(len(x), np.inf)
    # Of the envelope each parabola (site, height) with the first whole x where it is lowest.
    held: list[tuple[int, int, int]] = []
    for a, g in sites:
        begin = int(x[0])
        while held:
            b, h, since = held[-1]
            if (since - b) ** 2 + h > (since - a) ** 2 + g:
                held.pop()
                continue
            begin = (a * a - b * b + g - h) // (2 * (a - b)) + 1
            break
        if begin <= x[-1]:
            held.append((a, g, begin))
    a, g, begin = (np.array(c) for c in zip(*held, strict=True))
    at = np.searchsorted(begin, x, side="right") - 1
    return np.sqrt(((x - a[at]) ** 2 + g[at]).astype(float))


def count_lines(r: Raster, direction: str = "horizontal"):
    """Mean number of steps from under to over 128 per column (horizontal) or row."""
    from pyspark.sql import Window

    line, along, n = ("x", "y", r.width) if direction == "horizontal" else ("y", "x", r.height)
    w = Window.partitionBy(*r.keys, "band", line).orderBy(along)
    steps = r.df.withColumn("up", ((F.col("v") >= 128) & (F.lag("v").over(w) < 128)).cast("int"))
    return steps.groupBy(*r.keys, "band").agg((F.sum("up") / n).alias("lines"))


#: Places of a scan in which regions are numbered together.
BLOCK = 1 << 20


def label_regions(r: Raster, threshold: float | None = None, checkpoint=None) -> Raster:
    """4-connected regions, numbered by their first sample in scan order.

    Without a threshold every region of equal samples is labelled, from 1; with one, the
    regions of samples above it, and the rest is 0. Labels (least scan position) spread to
    neighbours and then along their own labels, so rounds grow with the logarithm of a region's
    extent; each round is cut by a checkpoint."""
    spark = r.df.sparkSession
    if checkpoint is None:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            import tempfile

            shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
            if not shared and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp())
        checkpoint = lambda d: d.checkpoint()
    place = (F.col("y").cast("bigint") * r.width + F.col("x")).alias("p")
    cells = r.df.where("band = 0")
    value = F.col("v") if threshold is None else F.when(F.col("v") > threshold, F.lit(1))
    nodes = cells.select(*r.keys, place, value.cast("double").alias("c"), F.col("x")).where("c is not null")
    keys = list(r.keys)
    right = nodes.select(*keys, (F.col("p") - 1).alias("p"), F.col("c").alias("d"), F.col("p").alias("q")).where(F.col("q") % r.width != 0)
    below = nodes.select(*keys, (F.col("p") - r.width).alias("p"), F.col("c").alias("d"), F.col("p").alias("q"))
    links = nodes.join(right.unionByName(below), [*keys, "p"]).where("c = d").select(*keys, "p", "q")
    links = checkpoint(links.unionByName(links.select(*keys, F.col("q").alias("p"), F.col("p").alias("q"))))
    label = nodes.select(*keys, "p", F.col("p").alias("l"))
    while True:
        near = links.join(label.select(*keys, F.col("p").alias("q"), "l"), [*keys, "q"]).groupBy(*keys, "p").agg(F.min("l").alias("m"))
        moved = label.join(near, [*keys, "p"], "left").select(*keys, "p", "l", F.least("l", F.coalesce("m", "l")).alias("t"))
        jump = label.select(*keys, F.col("p").alias("t"), F.col("l").alias("u"))
        new = checkpoint(moved.join(jump, [*keys, "t"]).select(*keys, "p", F.least("t", "u").alias("l"), F.col("l").alias("was")))
        if not new.where("l < was").limit(1).count():
            break
        label = new.drop("was")
    from pyspark.sql import Window

    # Numbers inside blocks of the scan, and of each block how many regions begin before it.
    roots = new.where("p = l").select(*keys, "l", F.expr(f"l div {BLOCK}").alias("block"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = roots.groupBy(*keys, "block").agg(F.count("*").alias("n")).select(*keys, "block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "block").orderBy("l"))
    roots = roots.withColumn("v", inside).join(blocks, [*keys, "block"]).select(*keys, "l", (F.col("v") + F.col("before")).alias("v"))
    named = new.join(roots, [*keys, "l"]).select(*keys, F.expr(f"cast(p div {r.width} as int)").alias("y"), (F.col("p") % r.width).cast("int").alias("x"), F.lit(0).alias("band"), F.col("v").cast("bigint").alias("v"))
    out = r.with_df(named, bands=1, fmt=s.U32)
    if threshold is None:
        return out
    from .geometry import filled

    return filled(out, r.width, r.height)
