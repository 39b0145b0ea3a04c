"""Resampling: shrinks are aggregations, reductions a join of samples to the taps of a
small plan table, warps a projection of the output grid and an equi-join to its taps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import samples as s
from ..raster import Raster
from . import geometry

SUPPORT = {"nearest": 0.5, "linear": 1.0, "cubic": 2.0, "catmullrom": 2.0, "quadratic": 1.5, "lanczos2": 2.0, "lanczos3": 3.0}
#: Kernels that are no product of weights, and how far they reach: the samples around a place
#: meet in one row.
LOCAL = {"lbb": 2, "nohalo": 3, "vsqbs": 2}
PHASES = 64


def kernel_weight(kernel: str, x: float) -> float:
    x = abs(x)
    if kernel == "nearest":
        return 1.0 if x < 0.5 else 0.0
    if kernel == "linear":
        return max(0.0, 1 - x)
    if kernel in ("cubic", "catmullrom"):
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0
    if kernel == "quadratic":
        return 1 - 2 * x * x if x < 0.5 else x * x - 2.5 * x + 1.5 if x < 1.5 else 0.0
    a = SUPPORT[kernel]
    if x >= a:
        return 0.0
    if x < 2.3e-16:
        return 1.0
    p = math.pi * x
    return a * math.sin(p) * math.sin(p / a) / (p * p)


def _shrunk(r: Raster, axis: str, factor: int, ceiling: bool) -> Raster:
    size = r.width if axis == "x" else r.height
    out = -(-size // factor) if ceiling else size // factor
    at = F.expr(f"cast({axis} div {factor} as int)")
    rest = [c for c in r.at if c != axis]
    df = r.df.groupBy(*rest, at.alias(axis)).agg(F.avg("v").alias("v")).where(F.col(axis) < out)
    v = s.from_double(F.col("v"), r.fmt)
    return r.with_df(df.withColumn("v", v), **{"width" if axis == "x" else "height": out})


def shrinkh(r: Raster, factor: int, ceiling: bool = False) -> Raster:
    return _shrunk(r, "x", factor, ceiling)


def shrinkv(r: Raster, factor: int, ceiling: bool = False) -> Raster:
    return _shrunk(r, "y", factor, ceiling)


def shrink(r: Raster, hshrink: int, vshrink: int) -> Raster:
    """Columns, then rows: whole formats round twice."""
    return shrinkv(shrinkh(r, hshrink), vshrink)


def plan(size: int, factor: float, kernel: str) -> list[tuple[int, int, float]]:
    """(output, source, weight) of a one-dimensional reduction, edges extended."""
    if kernel in LOCAL:
        raise ValueError(f"{kernel} is not separable")
    out = max(1, math.floor(size / factor + 0.5))
    one = abs(factor - 1) < 2.3e-16
    taps = 1 if one or kernel == "nearest" else 2 * math.floor(SUPPORT[kernel] * factor + 0.5) + 1
    before = math.ceil(taps / 2) - 1
    shift = 0.0 if one else (1.0 + (out * factor - size)) / 2 - 1.0
    rows = []
    for i in range(out):
        at = (i + 0.5) * factor - 0.5 - shift
        low = math.floor(at)
        phase = math.floor((at - low) * PHASES + 0.5) / PHASES
        half = phase + taps / 2 - 1
        w = [1.0] if taps == 1 else [kernel_weight(kernel, (t - half) / factor) for t in range(taps)]
        total = sum(w)
        summed: dict[int, float] = {}
        for t, x in enumerate(w):
            k = max(0, min(size - 1, low - before + t))
            summed[k] = summed.get(k, 0.0) + (x / total if total > 0 else x)
        rows += [(i, k, x) for k, x in summed.items()]
    return rows


def _reduced(r: Raster, axis: str, factor: float, kernel: str) -> Raster:
    if factor < 1:
        raise ValueError("a reduction factor is at least 1")
    size = r.width if axis == "x" else r.height
    rows = plan(size, factor, kernel)
    table = r.df.sparkSession.createDataFrame(rows, f"__o int, {axis} int, __w double")
    # The plan has one row per tap of one line, whatever the number of images.
    df = r.df.join(F.broadcast(table), axis).groupBy(*[c for c in r.at if c != axis], F.col("__o").alias(axis)).agg(F.sum(F.col("__w") * F.col("v")).alias("v"))
    return r.with_df(df.withColumn("v", s.from_double(F.col("v"), r.fmt)), **{"width" if axis == "x" else "height": rows[-1][0] + 1})


def reduceh(r: Raster, factor: float, kernel: str = "lanczos3") -> Raster:
    return _reduced(r, "x", factor, kernel)


def reducev(r: Raster, factor: float, kernel: str = "lanczos3") -> Raster:
    return _reduced(r, "y", factor, kernel)


def reduce(r: Raster, hfactor: float, vfactor: float, kernel: str = "lanczos3") -> Raster:
    return reducev(reduceh(r, hfactor, kernel), vfactor, kernel)


def warp(r: Raster, width: int, height: int, source_y: Column, source_x: Column, kernel: str = "linear", background: float = 0.0, extend: str = "background") -> Raster:
    """Each output place reads the source at (source_y, source_x), expressions of y and x.
    Taps outside read the edge; places outside get the background (or the edge, for `copy`)."""
    grid = r.grid(width, height).withColumns({"__sy": source_y, "__sx": source_x})
    return _sampled(r, grid, width, height, kernel, background, extend)


def _sampled(r: Raster, grid, width: int, height: int, kernel: str, background: float, extend: str) -> Raster:
    sy, sx = F.col("__sy"), F.col("__sx")
    inside = F.lit(True) if extend == "copy" else sy.between(-0.5, r.height - 0.5) & sx.between(-0.5, r.width - 0.5)
    if kernel in LOCAL:
        got = _local(r, grid.where(inside), kernel)
        return geometry.filled(r.with_df(got.withColumn("v", s.from_double(F.col("v"), r.fmt))), width, height, background)
    if kernel == "nearest":
        ty = tx = F.array(F.struct(F.lit(0).alias("o"), F.lit(1.0).alias("w")))
        by, bx = F.floor(sy + 0.5), F.floor(sx + 0.5)
    else:
        reach = math.ceil(SUPPORT[kernel])

        def taps(c: Column) -> Column:
            part = c - F.floor(c)
            return F.array(*[F.struct(F.lit(o).alias("o"), weight(kernel, part - o).alias("w")) for o in range(1 - reach, reach + 1)])

        ty, tx, by, bx = taps(sy), taps(sx), F.floor(sy), F.floor(sx)
    places = grid.withColumn("__in", inside).withColumns({"__by": by, "__bx": bx, "__ty": ty, "__tx": tx})
    near = places.where("__in").withColumn("__ty", F.explode("__ty")).withColumn("__tx", F.explode("__tx"))
    near = near.select(*r.pixel, (F.col("__ty.w") * F.col("__tx.w")).alias("__w"), _clamp(F.col("__by") + F.col("__ty.o"), r.height).alias("__py"), _clamp(F.col("__bx") + F.col("__tx.o"), r.width).alias("__px"))
    source = r.df.withColumnsRenamed({"y": "__py", "x": "__px"})
    got = near.join(source, [*r.keys, "__py", "__px"]).groupBy(*r.at).agg((F.sum(F.col("__w") * F.col("v")) / F.sum("__w")).alias("v"))
    got = got.withColumn("v", s.from_double(F.col("v"), r.fmt))
    return geometry.filled(r.with_df(got), width, height, background)


def _local(r: Raster, places: DataFrame, kernel: str) -> DataFrame:
    """The value at each of the places (__sy, __sx) by one of the kernels LOCAL, from the samples
    around it, which one aggregate lays side by side."""
    reach, sy, sx = LOCAL[kernel], F.col("__sy"), F.col("__sx")
    around = F.explode(F.array(*[F.lit(o) for o in range(1 - reach, reach + 1)]))
    near = places.withColumns({"__fy": sy - F.floor(sy), "__fx": sx - F.floor(sx)}).withColumn("__oy", around).withColumn("__ox", around)
    near = near.select(*r.pixel, "__fy", "__fx", "__oy", "__ox", _clamp(F.floor(sy) + F.col("__oy"), r.height).alias("__py"), _clamp(F.floor(sx) + F.col("__ox"), r.width).alias("__px"))
    source = r.df.withColumnsRenamed({"y": "__py", "x": "__px"})
    here = lambda i, j: (F.col("__oy") == i + 1 - reach) & (F.col("__ox") == j + 1 - reach)
    cells = [F.max(F.when(here(i, j), F.col("v").cast("double"))).alias(f"__n{i}{j}") for i in range(2 * reach) for j in range(2 * reach)]
    rows = near.join(source, [*r.keys, "__py", "__px"]).groupBy(*r.at).agg(F.max("__fy").alias("__fy"), F.max("__fx").alias("__fx"), *cells)
    return {"lbb": _bounded_bicubic, "nohalo": _subdivided, "vsqbs": _split_spline}[kernel](rows)


def _bounded_bicubic(rows: DataFrame, name: str = "__n") -> DataFrame:
    """Locally bounded bicubic: the Hermite patch over the four inner samples of `name`, whose
    derivatives are central differences cut so that the patch stays between the least and the
    greatest of the samples beside each corner. Each step is a projection, as it is used often."""
    n = lambda i, j: F.col(f"{name}{i}{j}")
    corners = [(a, b) for a in (0, 1) for b in (0, 1)]
    at = lambda what, a, b: F.col(f"__{what}{a}{b}")
    step = {}
    for a, b in corners:
        i, j = a + 1, b + 1
        cross = [n(i, j), n(i - 1, j), n(i + 1, j), n(i, j - 1), n(i, j + 1)]
        step |= {f"__below{a}{b}": n(i, j) - F.least(*cross), f"__above{a}{b}": F.greatest(*cross) - n(i, j)}
        step |= {f"__dx{a}{b}": (n(i, j + 1) - n(i, j - 1)) / 2, f"__dy{a}{b}": (n(i + 1, j) - n(i - 1, j)) / 2}
        step[f"__dxy{a}{b}"] = (n(i + 1, j + 1) - n(i + 1, j - 1) - n(i - 1, j + 1) + n(i - 1, j - 1)) / 4
    rows = rows.withColumns(step)
    rows = rows.withColumns({f"__most{a}{b}": F.least(at("below", a, b), at("above", a, b)) * 3 for a, b in corners})
    rows = rows.withColumns({f"__{d}{a}{b}": F.greatest(-at("most", a, b), F.least(at("most", a, b), at(d, a, b))) for a, b in corners for d in ("dx", "dy")})
    step = {}
    for a, b in corners:
        plus, minus = F.abs(at("dx", a, b) + at("dy", a, b)) * 3, F.abs(at("dx", a, b) - at("dy", a, b)) * 3
        low, high = at("below", a, b) * 9, at("above", a, b) * 9
        first = F.least(F.greatest(at("dxy", a, b), plus - low), high - plus)
        step[f"__dxy{a}{b}"] = F.least(F.greatest(first, minus - high), low - minus)
    rows = rows.withColumns(step)

    def hermite(t: Column) -> tuple[list[Column], list[Column]]:
        """Weights of the values, and of the slopes, at 0 and 1."""
        u = F.lit(1.0) - t
        return [(t * 2 + 1) * u * u, (u * 2 + 1) * t * t], [t * u * u, -u * t * t]

    (vy, gy), (vx, gx) = hermite(F.col("__fy")), hermite(F.col("__fx"))
    parts = [vy[a] * (vx[b] * n(a + 1, b + 1) + gx[b] * at("dx", a, b)) + gy[a] * (vx[b] * at("dy", a, b) + gx[b] * at("dxy", a, b)) for a, b in corners]
    return rows.withColumn("v", sum(parts[1:], parts[0]))


def _subdivided(rows: DataFrame) -> DataFrame:
    """Nohalo: samples at half distance from slopes that don't overshoot (minmod), then the
    bounded bicubic over the denser samples. Places in the far half of a cell are mirrored, so
    that the nearest sample is always in the middle."""
    far_y, far_x = F.col("__fy") >= 0.5, F.col("__fx") >= 0.5
    across = {f"__r{i}{j}": F.when(far_y, F.col(f"__n{5 - i}{j}")).otherwise(F.col(f"__n{i}{j}")) for i in range(5) for j in range(6)}
    rows = rows.withColumns(across)
    rows = rows.withColumns({f"__m{i}{j}": F.when(far_x, F.col(f"__r{i}{5 - j}")).otherwise(F.col(f"__r{i}{j}")) for i in range(5) for j in range(5)})
    m = lambda i, j: F.col(f"__m{i}{j}")

    def minmod(a: Column, b: Column) -> Column:
        return F.when(a * b >= 0, F.when(a * a <= a * b, a).otherwise(b)).otherwise(0.0)

    inner = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]
    rows = rows.withColumns({f"__sx{i}{j}": minmod(m(i, j + 1) - m(i, j), m(i, j) - m(i, j - 1)) for i, j in inner} | {f"__sy{i}{j}": minmod(m(i + 1, j) - m(i, j), m(i, j) - m(i - 1, j)) for i, j in inner})
    step = {}
    for fi, (i, odd_y) in enumerate([(1, 1), (2, 0), (2, 1), (3, 0)]):
        for fj, (j, odd_x) in enumerate([(1, 1), (2, 0), (2, 1), (3, 0)]):
            ends = [(i + p, j + q) for p in range(odd_y + 1) for q in range(odd_x + 1)]
            # The mean of the planes through the nearest samples.
            planes = [m(p, q) + (F.col(f"__sy{p}{q}") * (0.5 if p == i else -0.5) if odd_y else 0.0) + (F.col(f"__sx{p}{q}") * (0.5 if q == j else -0.5) if odd_x else 0.0) for p, q in ends]
            step[f"__d{fi}{fj}"] = sum(planes[1:], planes[0]) / len(ends)
    rows = rows.withColumns(step)
    twice = {c: F.when(F.col(c) >= 0.5, F.lit(1.0) - F.col(c)).otherwise(F.col(c)) * 2 for c in ("__fy", "__fx")}
    return _bounded_bicubic(rows.withColumns(twice), "__d")


def _split_spline(rows: DataFrame) -> DataFrame:
    """Vertex-split quadratic B-spline: every sample is split in four at a quarter's distance,
    each half the sample and a quarter of the two neighbours on its side; a quadratic B-spline
    goes through the splits."""
    n = lambda i, j: F.col(f"__n{i}{j}")

    def spline(c: str) -> list[Column]:
        """Weights of the four splits between the samples before and after the place."""
        away = [F.abs(F.col(c) * 2 + 0.5 - f) for f in range(4)]
        return [F.when(x < 0.5, F.lit(0.75) - x * x).when(x < 1.5, (F.lit(1.5) - x) * (F.lit(1.5) - x) / 2).otherwise(0.0) for x in away]

    rows = rows.withColumns({f"__w{axis}{f}": w for axis in "yx" for f, w in enumerate(spline(f"__f{axis}"))})
    parts = []
    for f in range(4):
        for g in range(4):
            i, j = f // 2 + 1, g // 2 + 1
            split = n(i, j) / 2 + (n(i + (f % 2 * 2 - 1), j) + n(i, j + (g % 2 * 2 - 1))) / 4
            parts.append(F.col(f"__wy{f}") * F.col(f"__wx{g}") * split)
    return rows.withColumn("v", sum(parts[1:], parts[0]))


def _clamp(c: Column, size: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), c)).cast("int")


def weight(kernel: str, x: Column) -> Column:
    """The kernel as a column expression."""
    x = F.abs(x)
    if kernel == "linear":
        return F.greatest(F.lit(0.0), F.lit(1.0) - x)
    if kernel in ("cubic", "catmullrom"):
        return F.when(x < 1, x * x * x * 1.5 - x * x * 2.5 + 1).when(x < 2, x * x * x * -0.5 + x * x * 2.5 - x * 4 + 2).otherwise(0.0)
    if kernel == "quadratic":
        return F.when(x < 0.5, F.lit(1.0) - x * x * 2).when(x < 1.5, x * x - x * 2.5 + 1.5).otherwise(0.0)
    a = SUPPORT[kernel]
    p = F.when(x < 2.3e-16, F.lit(1.0)).otherwise(x * math.pi)
    return F.when(x < 2.3e-16, F.lit(1.0)).when(x < a, F.sin(p) * F.sin(p / a) * a / (p * p)).otherwise(0.0)


def affine(r: Raster, matrix: tuple[float, float, float, float], tx: float, ty: float, width: int, height: int, kernel: str = "linear", background: float = 0.0) -> Raster:
    """Output (X, Y) reads the source at x = a X + b Y + tx, y = c X + d Y + ty."""
    a, b, c, d = map(float, matrix)
    return warp(r, width, height, F.col("x") * c + F.col("y") * d + ty, F.col("x") * a + F.col("y") * b + tx, kernel, background)


def similarity(r: Raster, scale: float, angle: float, width: int, height: int, kernel: str = "linear") -> Raster:
    """Scale and turn (degrees)."""
    t = math.radians(angle)
    a, b = math.cos(t) / scale, math.sin(t) / scale
    return affine(r, (a, b, -b, a), 0.0, 0.0, width, height, kernel)


def quadratic(r: Raster, coefficients: list[tuple[float, float]], width: int, height: int, kernel: str = "linear") -> Raster:
    """Backward warp by polynomials: (x, y) coefficients of 1, X, Y, XY, X^2, Y^2; shorter lists
    are lower orders."""
    terms = [F.lit(1.0), F.col("x").cast("double"), F.col("y").cast("double"), (F.col("x") * F.col("y")).cast("double"), (F.col("x") * F.col("x")).cast("double"), (F.col("y") * F.col("y")).cast("double")]
    sx = sum((t * float(k[0]) for t, k in zip(terms[1:], coefficients[1:], strict=False)), F.col("x") + float(coefficients[0][0]))
    sy = sum((t * float(k[1]) for t, k in zip(terms[1:], coefficients[1:], strict=False)), F.col("y") + float(coefficients[0][1]))
    return warp(r, width, height, sy, sx, kernel)


def mapim(r: Raster, index: Raster, kernel: str = "linear", background: float = 0.0, extend: str = "background") -> Raster:
    """A two-band image holds each place's source x and y."""
    grid = index.wide().select(*r.pixel, F.col("b1").cast("double").alias("__sy"), F.col("b0").cast("double").alias("__sx"))
    return _sampled(r, grid, index.width, index.height, kernel, background, extend)


def resize(r: Raster, hscale: float, vscale: float | None = None, kernel: str = "lanczos3", gap: float = 2.0) -> Raster:
    """Plan: whole shrinks while the factor is at least twice the gap's share, then reductions
    for the rest; enlargements by whole zooms (nearest) or an affine map."""
    vscale = vscale or hscale
    width, height = max(1, math.floor(r.width * hscale + 0.5)), max(1, math.floor(r.height * vscale + 0.5))
    for axis, scale in (("y", vscale), ("x", hscale)):
        if scale < 1:
            factor = (r.height / height) if axis == "y" else (r.width / width)
            whole = max(1, math.floor(factor / gap)) if kernel != "nearest" else math.floor(factor)
            if whole > 1:
                r = shrinkv(r, whole, True) if axis == "y" else shrinkh(r, whole, True)
            left = (r.height / height) if axis == "y" else (r.width / width)
            if left > 1:
                r = reducev(r, left, kernel) if axis == "y" else reduceh(r, left, kernel)
    if width > r.width or height > r.height:
        fx, fy = width / r.width, height / r.height
        if kernel == "nearest" and fx == int(fx) and fy == int(fy):
            return geometry.zoom(r, int(fx), int(fy))
        r = warp(r, width, height, (F.col("y") + 0.5) / fy - 0.5, (F.col("x") + 0.5) / fx - 0.5, kernel if kernel != "nearest" else "nearest", extend="copy")
    return r


def thumbnail(r: Raster, width: int, height: int | None = None, mode: str = "fit", crop: bool = False, kernel: str = "lanczos3") -> Raster:
    """fit (inside the box), width, height or force (exact); only force enlarges."""
    height = height or width
    h, v = width / r.width, height / r.height
    if mode == "force":
        return resize(r, h, v, kernel)
    k = {"fit": max(h, v) if crop else min(h, v), "width": h, "height": v}[mode]
    out = resize(r, min(1.0, k), kernel=kernel)
    return geometry.smartcrop(out, min(width, out.width), min(height, out.height)) if crop else out
