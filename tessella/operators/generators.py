"""Images computed from coordinates: a range and an expression; nothing is collected."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import samples as s
from ..raster import Raster, column_expression, from_wide

MASK32 = 4294967295


def _to(v: Column, uchar: bool, fmt: s.Format) -> Column:
    """A value of -1 to 1, or as 8 bits."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)) + 1) * 0.5 * 255.0 if uchar else v


def _image(spark: SparkSession, width: int, height: int, f, fmt: s.Format = s.F64) -> Raster:
    return column_expression(spark, width, height, lambda y, x: s.from_double(f(y.cast("double"), x.cast("double")), fmt), fmt)


def constant(spark: SparkSession, width: int, height: int, colour: list[float], fmt: s.Format = s.U8) -> Raster:
    return column_expression(spark, width, height, lambda y, x: [F.lit(v).cast(fmt.stored) for v in colour], fmt)


def black(spark, width: int, height: int, bands: int = 1, fmt: s.Format = s.U8) -> Raster:
    return constant(spark, width, height, [0] * bands, fmt)


zero = black


def white(spark, width: int, height: int, bands: int = 1, fmt: s.Format = s.U8) -> Raster:
    return constant(spark, width, height, [fmt.unit] * bands, fmt)


def eye(spark, width: int, height: int, factor: float, uchar: bool = False) -> Raster:
    mx, my = max(1, width - 1), max(1, height - 1)
    c = factor * math.pi / (2 * mx)
    return _image(spark, width, height, lambda y, x: _to(y * y * F.cos(x * x * c) / float(my * my), uchar, s.F64), s.U8 if uchar else s.F64)


def zone(spark, width: int, height: int, uchar: bool = False) -> Raster:
    hw, hh, c = width // 2, height // 2, math.pi / max(1, width)
    return _image(spark, width, height, lambda y, x: _to(F.cos(((x - hw) * (x - hw) + (y - hh) * (y - hh)) * c), uchar, s.F64), s.U8 if uchar else s.F64)


def sines(spark, width: int, height: int, hfreq: float = 0.5, vfreq: float = 0.5, uchar: bool = False) -> Raster:
    theta = math.pi / 2 if hfreq == 0 else math.atan(vfreq / hfreq)
    c = math.hypot(hfreq, vfreq) * 2 * math.pi / width
    return _image(spark, width, height, lambda y, x: _to(F.cos((x * math.cos(theta) - y * math.sin(theta)) * c), uchar, s.F64), s.U8 if uchar else s.F64)


def grey(spark, width: int, height: int, vertical: bool = False, uchar: bool = False) -> Raster:
    n = (height if vertical else width) - 1

    def f(y, x):
        v = (y if vertical else x) / float(n) if n else F.lit(0.0)
        return v * 255.0 if uchar else v

    return _image(spark, width, height, f, s.U8 if uchar else s.F64)


def identity(spark, bands: int = 1, ushort: bool = False, size: int = 65536) -> Raster:
    n, fmt = (size, s.U16) if ushort else (256, s.U8)
    return column_expression(spark, n, 1, lambda y, x: [x] * bands, fmt)


def xyz(spark, width: int, height: int) -> Raster:
    return column_expression(spark, width, height, lambda y, x: [x, y, F.lit(0)], s.U16)


def gaussmat_radius(sigma: float, least: float) -> int:
    top = int(min(8 * sigma, 5000))
    below = next((x for x in range(top) if math.exp(-x * x / (2 * sigma * sigma)) < least), top)
    return max(0, below - 1)


def gaussmat(spark, sigma: float, least: float, separable: bool = False, integer: bool = True) -> Raster:
    radius = gaussmat_radius(sigma, least)
    w, h = 2 * radius + 1, 1 if separable else 2 * radius + 1

    def f(y, x):
        d = (x - w // 2) * (x - w // 2) + (y - h // 2) * (y - h // 2)
        g = F.exp(-d / (2 * sigma * sigma))
        return s.round_away(g * 20.0) if integer else g

    return _image(spark, w, h, f)


def logmat_radius(sigma: float, least: float) -> int:
    last = 0.0
    for x in range(5000):
        v = 0.5 * (2 - x * x / sigma**2) * math.exp(-x * x / (2 * sigma**2))
        if v - last >= 0 and abs(v) < least:
            return x
        last = v
    raise ValueError("the mask is too large")


def logmat(spark, sigma: float, least: float, separable: bool = False, integer: bool = True) -> Raster:
    radius = logmat_radius(sigma, least)
    w, h = 2 * radius + 1, 1 if separable else 2 * radius + 1

    def f(y, x):
        d = (x - w // 2) * (x - w // 2) + (y - h // 2) * (y - h // 2)
        g = (F.lit(2.0) - d / (sigma * sigma)) * F.exp(-d / (2 * sigma * sigma)) * 0.5
        return s.round_away(g * 20.0) if integer else g

    return _image(spark, w, h, f)


def buildlut(spark, points: list[tuple[float, float]], size: int) -> Raster:
    """Straight lines between points, ends held."""
    p = sorted(points)

    def f(y, x):
        out = F.lit(float(p[-1][1]))
        for (x0, y0), (x1, y1) in reversed(list(zip(p, p[1:], strict=False))):
            out = F.when(x < float(x1), (x - float(x0)) / float(x1 - x0) * float(y1 - y0) + float(y0)).otherwise(out)
        return F.when(x < float(p[0][0]), F.lit(float(p[0][1]))).otherwise(out)

    return _image(spark, size, 1, f)


def invertlut(spark, table: list[list[float]], size: int) -> Raster:
    """Each row holds an input and what every band makes of it (0 to 1, rising); the result
    gives, for size steps of the output, the input."""
    rows = sorted(table)
    bands = len(rows[0]) - 1

    def of(x: Column, b: int) -> Column:
        ys = [r[b + 1] for r in rows]
        first, last = int(ys[0] * (size - 1)), int(ys[-1] * (size - 1))
        ki = x / float(max(1, size - 1))
        inner = F.lit(float(rows[-1][0]))
        for j in reversed(range(len(rows) - 1)):
            lo, hi = rows[j], rows[j + 1]
            span = hi[b + 1] - lo[b + 1]
            v = F.lit(float(lo[0])) if abs(span) <= 2.3e-16 else (ki - float(lo[b + 1])) / span * float(hi[0] - lo[0]) + float(lo[0])
            inner = F.when(ki <= float(hi[b + 1]), v).otherwise(inner)
        # After the last row's step the input goes on to 1 in a straight line.
        tail = (x - last) * ((1 - rows[-1][0]) / (size - 1 - last) if size - 1 > last else 0.0) + float(rows[-1][0])
        return F.when(x < first, x * (rows[0][0] / first if first else 0.0)).when(x <= last, inner).otherwise(tail)

    return column_expression(spark, size, 1, lambda y, x: [of(x.cast("double"), b) for b in range(bands)])


def tonelut(spark, in_max: int = 32767, out_max: int = 32767, lb=0.0, lw=100.0, ps=0.2, pm=0.5, ph=0.8, shadow=0.0, mid=0.0, high=0.0, fmt: s.Format = s.F64) -> Raster:
    """Tone curve with bumps for shadows, middle tones and highlights, truncated."""
    ls, lm, lh = (lb + p * (lw - lb) for p in (ps, pm, ph))

    def step(x, a, b):
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))
        return t * t * 3.0 - t * t * t * 2.0

    def bump(x, a, b, c):
        return F.when(x < a, F.lit(0.0)).when(x < b, step(x, a, b)).when(x < c, F.lit(1.0) - step(x, b, c)).otherwise(0.0)

    def f(y, x):
        t = x.cast("double") * 100.0 / in_max
        tone = t + bump(t, lb, ls, lm) * shadow + bump(t, ls, lm, lh) * mid + bump(t, lm, lh, lw) * high
        return s.truncated(F.greatest(F.lit(0.0), F.least(F.lit(float(out_max)), tone * (out_max / 100.0))), fmt)

    return column_expression(spark, in_max + 1, 1, f, fmt)


def mandelbrot(spark, width: int, height: int, max_iter: int = 64) -> Raster:
    """Escape steps as a share of max_iter, times 255, by a fold over the steps."""
    fold = f"aggregate(sequence(1, {max_iter}), named_struct('x', 0D, 'y', 0D, 'n', 0), (a, i) -> if(a.x * a.x + a.y * a.y <= 4D, named_struct('x', a.x * a.x - a.y * a.y + cx, 'y', 2D * a.x * a.y + cy, 'n', a.n + 1), a), a -> a.n)"
    grid = spark.range(width * height).selectExpr(f"cast(id div {width} as int) as y", f"cast(id % {width} as int) as x")
    grid = grid.selectExpr("y", "x", f"x / {float(width)}D * 3.5D - 2.5D as cx", f"y / {float(height)}D * 2D - 1D as cy")
    return from_wide(grid.selectExpr("y", "x", f"{fold} / {float(max_iter)}D * 255D as n"), [F.col("n")], width, height)


# ---------------------------------------------------------------- hash noise


def hash_add(h: Column, v: Column) -> Column:
    """FNV-1a over the four bytes of a value, in 32 bits."""
    for shift in (0, 8, 16, 24):
        low = F.shiftright(v, shift).bitwiseAND(F.lit(255).cast("bigint"))
        h = (h.bitwiseXOR(low) * 16777619).bitwiseAND(F.lit(MASK32).cast("bigint"))
    return h


def _hash_sql(h: str, v: str) -> str:
    for shift in (0, 8, 16, 24):
        h = f"((({h} ^ (shiftright({v}, {shift}) & 255L)) * 16777619L) & {MASK32}L)"
    return h


def gaussnoise(spark, width: int, height: int, mean: float = 128.0, sigma: float = 30.0, seed: int = 0, bands: int = 1) -> Raster:
    """Sum of twelve hash values per sample; a function of seed and place (and band, if there
    are several)."""
    step = _hash_sql("2166136261L", "a.h")
    fold = f"aggregate(sequence(1, 12), named_struct('h', h, 't', 0D), (a, i) -> named_struct('h', {step}, 't', a.t + {step} / {float(MASK32)}D), a -> a.t)"

    def f(y, x):
        out = []
        for b in range(bands):
            h = hash_add(hash_add(F.lit(seed).cast("bigint"), x.cast("bigint")), y.cast("bigint"))
            out.append(hash_add(h, F.lit(b).cast("bigint")) if bands > 1 else h)
        return out

    grid = spark.range(width * height).select(F.expr(f"cast(id div {width} as int)").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    cells = grid.select("y", "x", F.posexplode(F.array(*f(F.col("y"), F.col("x")))).alias("band", "h"))
    out = cells.select("y", "x", "band", F.expr(f"({fold} - 6D) * {float(sigma)}D + {float(mean)}D").alias("v"))
    return Raster(out, width, height, bands, s.F64)


def perlin(spark, width: int, height: int, cell: int = 256, seed: int = 0) -> Raster:
    """Gradient noise on cells that wrap around, 0 to 1."""
    across, down = -(-width // cell), -(-height // cell)
    corners = [(a, b) for a in (0, 1) for b in (0, 1)]
    place = lambda at, size, n: F.pmod(F.floor(F.col(at) / cell) + n, F.lit(size)).cast("bigint")
    df = spark.range(width * height).selectExpr(f"cast(id div {width} as int) as y", f"cast(id % {width} as int) as x")
    # Each stage reads the one before by name; inlined, the hashes would repeat in every term.
    df = df.select("y", "x", *[hash_add(F.lit(seed).cast("bigint"), place("y", down, a)).alias(f"r{a}") for a in (0, 1)])
    df = df.select("y", "x", *[hash_add(F.col(f"r{a}"), place("x", across, b)).alias(f"h{a}{b}") for a, b in corners])
    turn = lambda h: h.bitwiseXOR(F.shiftright(h, 8)).bitwiseXOR(F.shiftright(h, 16)).bitwiseAND(F.lit(255).cast("bigint")) * (2 * math.pi / 256)
    df = df.select("y", "x", *[turn(F.col(f"h{a}{b}")).alias(f"t{a}{b}") for a, b in corners])
    dy, dx = (F.col("y") % cell) / float(cell), (F.col("x") % cell) / float(cell)
    df = df.select("y", "x", dy.alias("dy"), dx.alias("dx"), *[((F.lit(b) - dx) * F.cos(f"t{a}{b}") + (F.lit(a) - dy) * F.sin(f"t{a}{b}")).alias(f"n{a}{b}") for a, b in corners])
    smooth = lambda c: F.col(c) * F.col(c) * F.col(c) * (F.col(c) * (F.col(c) * 6.0 - 15.0) + 10.0)
    df = df.select("y", "x", smooth("dy").alias("sy"), *[(F.col(f"n{a}0") + smooth("dx") * (F.col(f"n{a}1") - F.col(f"n{a}0"))).alias(f"row{a}") for a in (0, 1)])
    n = F.col("row0") + F.col("sy") * (F.col("row1") - F.col("row0"))
    return from_wide(df.select("y", "x", ((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), n)) + 1) * 0.5).alias("n")), [F.col("n")], width, height)


def _cells(across: int, down: int, cell: int, seed: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    def add(h, v):
        for shift in (0, 8, 16, 24):
            h = ((h ^ ((v >> shift) & 255)) * 16777619) & MASK32
        return h

    out = {}
    for cy in range(down):
        for cx in range(across):
            h = add(add(seed, cx), cy)
            n, points = h % 9 + 1, []
            for _ in range(n):
                h = add(2166136261, h)
                x = cx * cell + h % cell
                h = add(2166136261, h)
                points.append((cy * cell + h % cell, x))
            out[cy, cx] = points
    return out


def worley(spark, width: int, height: int, cell: int = 256, seed: int = 0) -> Raster:
    """Distance to the nearest feature of the nine cells around, over 1.5 cells. The features
    are a table by cell (at most nine each), joined to the places of a cell."""
    across, down = -(-width // cell), -(-height // cell)
    cells = _cells(across, down, cell, seed)
    rows = [(cy, cx, [p for a in (-1, 0, 1) for b in (-1, 0, 1) for p in cells[(cy + a) % down, (cx + b) % across]]) for cy in range(down) for cx in range(across)]
    table = F.broadcast(spark.createDataFrame(rows, "cy int, cx int, f array<struct<y:int,x:int>>"))
    grid = spark.range(width * height).selectExpr(f"cast(id div {width} as int) as y", f"cast(id % {width} as int) as x")
    both = grid.selectExpr("y", "x", f"cast(y div {cell} as int) as cy", f"cast(x div {cell} as int) as cx").join(table, ["cy", "cx"])
    d = F.expr(f"sqrt(cast(array_min(transform(f, p -> (p.x - x) * (p.x - x) + (p.y - y) * (p.y - y))) as double)) / {1.5 * cell}D")
    return from_wide(both.select("y", "x", F.least(F.lit(1.0), d).alias("d")), [F.col("d")], width, height)


def sdf_circle(spark, width: int, height: int, cx: float, cy: float, radius: float) -> Raster:
    return _image(spark, width, height, lambda y, x: F.hypot(x - cx, y - cy) - radius)


def sdf_rect(spark, width: int, height: int, x0: float, y0: float, x1: float, y1: float) -> Raster:
    def f(y, x):
        dx, dy = F.abs(x - (x0 + x1) / 2) - (x1 - x0) / 2, F.abs(y - (y0 + y1) / 2) - (y1 - y0) / 2
        return F.hypot(F.greatest(dx, F.lit(0.0)), F.greatest(dy, F.lit(0.0))) + F.least(F.greatest(dx, dy), F.lit(0.0))

    return _image(spark, width, height, f)


def point(spark, width: int, height: int, count: int, seed: int = 0) -> Raster:
    """`count` distinct white points from a hash chain; the chain is short and driver-made."""
    h, seen = seed & MASK32, set()
    while len(seen) < min(count, width * height):
        got = []
        for _ in range(2):
            n = 2166136261
            for shift in (0, 8, 16, 24):
                n = ((n ^ ((h >> shift) & 255)) * 16777619) & MASK32
            h = n
            got.append(h)
        seen.add((got[1] % height, got[0] % width))
    spots = F.array(*[F.lit(y * width + x) for y, x in sorted(seen)])
    return column_expression(spark, width, height, lambda y, x: F.when(F.array_contains(spots, y * width + x), 255).otherwise(0), s.U8)


def fractsurf(spark, width: int, height: int, dimension: float = 2.5, seed: int = 0) -> Raster:
    """Octaves of value noise whose strength falls by the fractal dimension. Python, in Arrow
    batches, only for the 64-bit wrap-around generator."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            i = b.column(0).to_numpy()
            y, x = i // width, i % width
            total = np.zeros(len(i))
            for octave in range(max(1, int(math.log2(max(width, height, 2))))):
                size = max(1, max(width, height) >> octave)
                cy, cx, fy, fx = y // size, x // size, y % size / size, x % size / size

                def noise(a, c, o=octave):
                    with np.errstate(over="ignore"):
                        z = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (c.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(seed * 131 + o)
                        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    return (z >> np.uint64(11)).astype(float) / 2**53 - 0.5

                top = noise(cy, cx) * (1 - fx) + noise(cy, cx + 1) * fx
                low = noise(cy + 1, cx) * (1 - fx) + noise(cy + 1, cx + 1) * fx
                total += (top * (1 - fy) + low * fy) * 2.0 ** (-octave * (3 - dimension))
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(np.zeros(len(i), np.int32)), pa.array(total)], names=["y", "x", "band", "v"])

    return Raster(spark.range(width * height).mapInArrow(run, "y int, x int, band int, v double"), width, height)


# ---------------------------------------------------------------- frequency masks


def frequency_mask(spark, width: int, height: int, kind: str, cutoff: float = 0.5, amplitude: float = 0.5, order: float = 2.0, ring: float = 0.2, cx: float = 0.5, cy: float = 0.5, radius: float = 0.2, dimension: float = 2.5, optical: bool = False, reject: bool = False, nodc: bool = False, uchar: bool = False) -> Raster:
    """ideal, gaussian or butterworth, each plain, with -ring or with -band; or fractal. The
    plain ideal mask keeps the high frequencies."""
    hw, hh = max(1, width // 2), max(1, height // 2)

    def f(y, x):
        if not optical:
            y, x = (y + hh) % height, (x + hw) % width
        dx, dy = (x - hw) / float(hw), (y - hh) / float(hh)
        d2 = dx * dx + dy * dy
        log_a, k, df, r2 = math.log(amplitude), 1 / amplitude - 1, ring / 2, radius * radius
        d1 = (dx - cx) * (dx - cx) + (dy - cy) * (dy - cy)
        e1 = (dx + cx) * (dx + cx) + (dy + cy) * (dy + cy)
        one = F.lit(1.0)
        if kind == "ideal":
            v = F.when(d2 <= cutoff * cutoff, 0.0).otherwise(1.0)
        elif kind == "ideal-ring":
            v = F.when((d2 > (cutoff - df) * (cutoff - df)) & (d2 < (cutoff + df) * (cutoff + df)), 1.0).otherwise(0.0)
        elif kind == "ideal-band":
            v = F.when((d1 < r2) | (e1 < r2), 1.0).otherwise(0.0)
        elif kind == "gaussian":
            v = one - F.exp(d2 / (cutoff * cutoff) * log_a)
        elif kind == "gaussian-ring":
            d = F.sqrt(d2) - cutoff
            v = F.exp(d * d * log_a / (df * df))
        elif kind == "gaussian-band":
            norm = 1 / (1 + math.exp(log_a * 4 * (cx * cx + cy * cy) / r2))
            v = (F.exp(d1 * log_a / r2) + F.exp(e1 * log_a / r2)) * norm
        elif kind == "butterworth":
            safe = F.when(d2 == 0, one).otherwise(d2)
            v = F.when(d2 == 0, 0.0).otherwise(one / (F.pow(F.lit(cutoff * cutoff) / safe, F.lit(order)) * k + 1))
        elif kind == "butterworth-ring":
            d = F.sqrt(d2) - cutoff
            v = one / (F.pow(d * d / (df * df), F.lit(order)) * k + 1)
        elif kind == "butterworth-band":
            norm = 1 / (1 + 1 / (1 + k * (4 * (cx * cx + cy * cy) / r2) ** order))
            v = (one / (F.pow(d1 / r2, F.lit(order)) * k + 1) + one / (F.pow(e1 / r2, F.lit(order)) * k + 1)) * norm
        else:
            v = F.pow(d2, F.lit((dimension - 4) / 2))
        v = one - v if reject else v
        if not nodc:
            v = F.when((dx == 0) & (dy == 0), 1.0).otherwise(v)
        return v * 255.0 if uchar else v

    return _image(spark, width, height, f, s.U8 if uchar else s.F64)
