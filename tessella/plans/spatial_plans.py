"""Queries of geometry, neighbourhoods, resampling, drawing and mosaicing."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import samples as s
from ..operators import draw, geometry, mosaic, neighbourhood, resample
from .images import EMB, OTHER, RAMP, U8, Catalogue, emb, other, ramp, u8

W, H = 64, 48


def near(kernel: list[list[float]], view: str = RAMP, width: int = W, height: str = str(H)) -> str:
    """Rows (y, x, k, kw, w): each place's neighbours under a kernel, edges extended."""
    rows, cols = len(kernel), len(kernel[0])
    cells = ", ".join(f"({i * cols + j}, {i - rows // 2}, {j - cols // 2}, {float(kernel[i][j])!r}e0)" for i in range(rows) for j in range(cols))
    return (
        f"(SELECT p.y, p.x, k.k, k.kw, q.v AS w, p.v AS v FROM {view} p CROSS JOIN (VALUES {cells}) k(k, dy, dx, kw) "
        f"JOIN {view} q ON q.y = greatest(0, least({height} - 1, p.y + k.dy)) AND q.x = greatest(0, least({width} - 1, p.x + k.dx)))"
    )


def conv(kernel, view=RAMP, width=W, height=str(H), scale=1.0, offset=0.0) -> str:
    return f"(SELECT y, x, sum(kw * w) / {float(scale)!r}e0 + {float(offset)!r}e0 AS v FROM {near(kernel, view, width, height)} GROUP BY y, x)"


def register(c: Catalogue) -> None:
    im, sh = c.image, lambda f: (lambda k, d: f(ramp(k)))
    moved = lambda y, x: f"SELECT {y} AS y, {x} AS x, v FROM {RAMP}"
    im("extract_area", sh(lambda r: geometry.extract_area(r, 5, 7, 30, 20)), f"SELECT y - 7 AS y, x - 5 AS x, v FROM {RAMP} WHERE x BETWEEN 5 AND 34 AND y BETWEEN 7 AND 26")
    im("flip_horizontal", sh(geometry.flip_horizontal), moved("y", "63 - x"))
    im("flip_vertical", sh(geometry.flip_vertical), moved("47 - y", "x"))
    im("flip", sh(lambda r: geometry.flip(r, "vertical")), moved("47 - y", "x"))
    im("rotate90", sh(geometry.rotate90), moved("x", "47 - y"))
    im("rotate180", sh(geometry.rotate180), moved("47 - y", "63 - x"))
    im("rotate270", sh(geometry.rotate270), moved("63 - x", "y"))
    im("rot", sh(lambda r: geometry.rot(r, 270)), moved("63 - x", "y"))
    for k, (y, x) in {1: ("y", "x"), 2: ("y", "63 - x"), 3: ("47 - y", "63 - x"), 4: ("47 - y", "x"), 5: ("x", "y"), 6: ("x", "47 - y"), 7: ("63 - x", "47 - y"), 8: ("63 - x", "y")}.items():
        im(f"autorot_{k}", sh(lambda r, k=k: geometry.autorot(r, k)), moved(y, x))
    seven = f"SELECT y, x, v FROM {RAMP} WHERE x < 7 AND y < 7"
    turned = ", ".join(f"({y}, {x}, {a}, {b})" for y, x, a, b in geometry.rot45_map(7, 1))
    im("rot45", sh(lambda r: geometry.rot45(geometry.extract_area(r, 0, 0, 7, 7), 45)), f"SELECT ty AS y, tx AS x, v FROM ({seven}) JOIN (VALUES {turned}) m(y, x, ty, tx) USING (y, x)")
    im("subsample", sh(lambda r: geometry.subsample(r, 3, 2)), f"SELECT y // 2 AS y, x // 3 AS x, v FROM {RAMP} WHERE x % 3 = 0 AND y % 2 = 0")
    im("zoom", sh(lambda r: geometry.zoom(r, 2, 3)), f"SELECT y * 3 + k // 2 AS y, x * 2 + k % 2 AS x, v FROM {RAMP}, range(0, 6) t(k)")
    im("replicate", sh(lambda r: geometry.replicate(r, 3, 2)), f"SELECT y + (k // 3) * 48 AS y, x + (k % 3) * 64 AS x, v FROM {RAMP}, range(0, 6) t(k)")
    im("wrap", sh(lambda r: geometry.wrap(r, 10, -5)), moved("(y + 43) % 48", "(x + 10) % 64"))
    im("transpose3d", sh(lambda r: geometry.transpose3d(r, 12)), moved("(y % 12) * 4 + y // 12", "x"))
    im("grid", sh(lambda r: geometry.grid(r, 16, 2)), f"SELECT CAST(i // 128 AS INT) AS y, CAST(i % 128 AS INT) AS x, coalesce(v, 0) AS v FROM range(0, 128 * 32) t(i) LEFT JOIN (SELECT (y // 16) // 2 * 16 + y % 16 AS ty, (y // 16) % 2 * 64 + x AS tx, v FROM {RAMP}) ON ty = i // 128 AND tx = i % 128")
    canvas = "(SELECT CAST(i // 90 AS INT) AS y, CAST(i % 90 AS INT) AS x FROM range(0, 90 * 70) t(i))"
    for mode, fill in (("black", 0), ("white", 255), ("background", 77)):
        im(f"embed_{mode}", sh(lambda r, m=mode: geometry.embed(r, 90, 70, 10, 12, m, 77)), f"SELECT g.y, g.x, coalesce(v, {fill}) AS v FROM {canvas} g LEFT JOIN {RAMP} r ON r.y = g.y - 12 AND r.x = g.x - 10")
    mirror = lambda e, n: f"(CASE WHEN (({e}) % {2 * n} + {2 * n}) % {2 * n} < {n} THEN (({e}) % {2 * n} + {2 * n}) % {2 * n} ELSE {2 * n - 1} - (({e}) % {2 * n} + {2 * n}) % {2 * n} END)"
    for mode, ey, ex in (("copy", "greatest(0, least(47, g.y - 12))", "greatest(0, least(63, g.x - 10))"), ("repeat", "(g.y - 12 + 48) % 48", "(g.x - 10 + 64) % 64"), ("mirror", mirror("g.y - 12", 48), mirror("g.x - 10", 64))):
        im(f"embed_{mode}", sh(lambda r, m=mode: geometry.embed(r, 90, 70, 10, 12, m)), f"SELECT g.y, g.x, v FROM {canvas} g JOIN {RAMP} r ON r.y = {ey} AND r.x = {ex}")
    im("gravity", sh(lambda r: geometry.gravity(r, 90, 70, "south-east")), f"SELECT g.y, g.x, coalesce(v, 0) AS v FROM {canvas} g LEFT JOIN {RAMP} r ON r.y = g.y - 22 AND r.x = g.x - 26")
    im("join_horizontal", lambda k, d: geometry.join(ramp(k), other(k)), f"SELECT y, x, v FROM {RAMP} UNION ALL SELECT y, x + 64, v FROM {OTHER}")
    im("join_vertical", lambda k, d: geometry.join(ramp(k), other(k), "vertical"), f"SELECT y, x, v FROM {RAMP} UNION ALL SELECT y + 48, x, v FROM {OTHER}")
    im("insert", lambda k, d: geometry.insert(ramp(k), geometry.extract_area(other(k), 0, 0, 20, 10), 50, 30), f"SELECT r.y, r.x, coalesce(o.v, r.v) AS v FROM {RAMP} r LEFT JOIN (SELECT y + 30 AS y, x + 50 AS x, v FROM {OTHER} WHERE x < 20 AND y < 10) o ON o.y = r.y AND o.x = r.x")
    im("smartcrop_centre", sh(lambda r: geometry.smartcrop(r, 30, 20, "centre")), f"SELECT y - 14 AS y, x - 17 AS x, v FROM {RAMP} WHERE x BETWEEN 17 AND 46 AND y BETWEEN 14 AND 33")
    im("smartcrop_high", sh(lambda r: geometry.smartcrop(r, 30, 20, "high")), f"SELECT y - 28 AS y, x - 34 AS x, v FROM {RAMP} WHERE x >= 34 AND y >= 28")
    im("smartcrop_attention", lambda k, d: geometry.smartcrop(u8(k, d), 32, 24, "attention"))
    im("smartcrop_entropy", lambda k, d: geometry.smartcrop(u8(k, d), 32, 24, "entropy"))
    im("sequential", sh(geometry.sequential), RAMP)
    im("linecache", sh(geometry.linecache), RAMP)

    # Convolution and edges.
    k3 = [[1, 2, 1], [2, 4, 2], [1, 2, 1]]
    tall = "(SELECT count(*) FROM embeddings)"
    im("conv", lambda k, d: neighbourhood.convolve(ramp(k), k3, 16, 3), f"SELECT * FROM {conv(k3, scale=16, offset=3)}", True)
    im("conv2d", lambda k, d: neighbourhood.convolve(emb(k, d), k3), f"SELECT * FROM {conv(k3, EMB, 64, tall)}", True)
    im("conv_integer", lambda k, d: neighbourhood.convolve(ramp(k), k3, 16, precision="integer"), f"SELECT y, x, round_even(v, 0) AS v FROM {conv(k3, scale=16)}")
    five = [0.0625, 0.25, 0.375, 0.25, 0.0625]
    col = [[w] for w in five]
    im("convsep_h", lambda k, d: neighbourhood.convolve(ramp(k), [five]), f"SELECT * FROM {conv([five])}", True)
    im("convsep_v", lambda k, d: neighbourhood.convolve(ramp(k), col), f"SELECT * FROM {conv(col)}", True)
    im("convsep", lambda k, d: neighbourhood.convsep(ramp(k), five), f"WITH h AS {conv([five])} SELECT * FROM {conv(col, 'h')}", True)
    k7 = [[1.0 / 49] * 7 for _ in range(7)]
    im("conva", lambda k, d: neighbourhood.conva(ramp(k), k7), f"SELECT * FROM {conv(k7)}", True)
    top, q = max(five), [math.floor(w / max(five) * 5 + 0.5) for w in five]
    ka = [w * sum(five) / sum(q) for w in q]
    im("convasep", lambda k, d: neighbourhood.convasep(ramp(k), five, 5), f"WITH h AS {conv([ka])} SELECT * FROM {conv([[w] for w in ka], 'h')}", True)
    g = neighbourhood.gauss_kernel(1.5)
    gc = [[w] for w in g]
    blur = f"(WITH h AS (SELECT y, x, v FROM {conv([g], EMB, 64, tall)}) SELECT * FROM {conv(gc, 'h', 64, tall)})"
    im("gauss_blur", lambda k, d: neighbourhood.gauss_blur(emb(k, d), 1.5), f"SELECT * FROM {blur}", True)
    r8 = lambda t: f"(SELECT y, x, floor(v + 0.5) AS v FROM {t})"
    im("gauss_blur_u8", lambda k, d: neighbourhood.gauss_blur(ramp(k), 1.5), f"WITH h AS {r8(conv([g]))} SELECT * FROM {r8(conv(gc, 'h'))}")
    im("sharpen", lambda k, d: neighbourhood.sharpen(emb(k, d), 1.5, 0.8), f"SELECT e.y, e.x, e.v + (e.v - b.v) * 0.8 AS v FROM {EMB} e JOIN {blur} b USING (y, x)", True)

    def labs(k, d):
        return neighbourhood.labs_sharpen(ramp(k).map(lambda v: v * 100, s.I16), 1.5)

    soft = f"(WITH r AS (SELECT y, x, v * 100 AS v FROM {RAMP}), h AS {conv([g], 'r')} SELECT r.y, r.x, r.v, (r.v - b.v) / 327.67e0 AS d FROM r JOIN {conv(gc, 'h')} b USING (y, x))"
    im("labs_sharpen", labs, f"SELECT y, x, floor(v + greatest(-20, least(10, CASE WHEN abs(d) <= 2 THEN 0 WHEN d > 0 THEN 3 * (d - 2) ELSE 3 * (d + 2) END)) * 327.67e0 + 0.5) AS v FROM {soft}")
    for name, m in (("sobel", neighbourhood.SOBEL), ("scharr", neighbourhood.SCHARR), ("prewitt", neighbourhood.PREWITT)):
        t = neighbourhood._turned(m)
        pair = f"(SELECT a.y, a.x, a.v AS a, b.v AS b FROM {conv(m)} a JOIN {conv(t)} b USING (y, x))"
        v = "least(255, abs(a) + abs(b))" if name == "sobel" else "sqrt(a * a + b * b)"
        im(name, lambda k, d, f=getattr(neighbourhood, name): f(ramp(k)), f"SELECT y, x, {v} AS v FROM {pair}", True)
    t = neighbourhood._turned(neighbourhood.PREWITT)
    im("edge", lambda k, d: neighbourhood.edge(ramp(k), neighbourhood.PREWITT), f"SELECT y, x, floor(least(255, sqrt(a.v * a.v + b.v * b.v)) + 0.5) AS v FROM {conv(neighbourhood.PREWITT)} a JOIN {conv(t)} b USING (y, x)")
    turned = []
    for k in range(4):
        m = [[0.0] * 3 for _ in range(3)]
        for y, x, a, b in geometry.rot45_map(3, k):
            m[a][b] = float(neighbourhood.PREWITT[y][x])
        turned.append(m)
    joins = " JOIN ".join(f"(SELECT y, x, abs(v) AS v{i} FROM {conv(m)}) c{i}" + (" USING (y, x)" if i else "") for i, m in enumerate(turned))
    im("compass", lambda k, d: neighbourhood.compass(ramp(k), neighbourhood.PREWITT, 4), f"SELECT y, x, greatest(v0, v1, v2, v3) AS v FROM {joins}", True)
    im("canny", lambda k, d: neighbourhood.canny(ramp(k), 1.0), None, True)
    pat = [[10, 40, 90], [20, 60, 30], [5, 80, 70]]
    im("fastcor", lambda k, d: neighbourhood.fastcor(ramp(k), pat), f"SELECT y, x, sum((w - kw) * (w - kw)) AS v FROM {near(pat)} GROUP BY y, x", True)
    mean = sum(map(sum, pat)) / 9
    cen = [[v - mean for v in row] for row in pat]
    den = f"sqrt(greatest(0, sum(CAST(w AS DOUBLE) * w) - sum(CAST(w AS DOUBLE)) * sum(w) / 9) * {sum(v * v for row in cen for v in row)!r}e0)"
    im("spcor", lambda k, d: neighbourhood.spcor(ramp(k), pat), f"SELECT y, x, CASE WHEN {den} < 1e-9 THEN 0 ELSE greatest(-1, least(1, sum(kw * w) / {den})) END AS v FROM {near(cen)} GROUP BY y, x", True)

    # Morphology and order statistics.
    cross = [[128, 255, 128], [255, 255, 255], [128, 255, 128]]
    used = f"(SELECT * FROM {near(cross)} WHERE kw <> 128)"
    im("erode", lambda k, d: neighbourhood.erode(ramp(k), cross), f"SELECT y, x, bit_and(w) AS v FROM {used} GROUP BY y, x")
    im("dilate", lambda k, d: neighbourhood.dilate(ramp(k), cross), f"SELECT y, x, bit_or(w) AS v FROM {used} GROUP BY y, x")
    step = lambda f, v: f"(SELECT y, x, {f}(w) AS v FROM (SELECT * FROM {near(cross, v)} WHERE kw <> 128) GROUP BY y, x)"
    im("open", lambda k, d: neighbourhood.opening(ramp(k), cross), f"WITH e AS {step('bit_and', RAMP)} SELECT * FROM {step('bit_or', 'e')}")
    im("close", lambda k, d: neighbourhood.closing(ramp(k), cross), f"WITH e AS {step('bit_or', RAMP)} SELECT * FROM {step('bit_and', 'e')}")
    ones = [[1] * 3 for _ in range(3)]
    im("rank", lambda k, d: neighbourhood.rank(ramp(k), 3, 3, 2), f"SELECT y, x, list_sort(list(w))[3] AS v FROM {near(ones)} GROUP BY y, x")
    im("median", lambda k, d: neighbourhood.median(ramp(k), 3, 3), f"SELECT y, x, list_sort(list(w))[5] AS v FROM {near(ones)} GROUP BY y, x")
    dots = f"(SELECT y, x, CASE WHEN v > 250 THEN v ELSE 0 END AS v FROM {RAMP})"
    spots = lambda k: ramp(k).map(lambda v: F.when(v > 250, v).otherwise(0))
    im("nearest", lambda k, d: neighbourhood.nearest(spots(k)), f"SELECT p.y, p.x, sqrt(min((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x))) AS v FROM {dots} p, {dots} q WHERE q.v <> 0 GROUP BY p.y, p.x", True)
    c.table("count_lines", lambda k, d: neighbourhood.count_lines(ramp(k)).select("band", F.round("lines", 6).alias("lines")), f"SELECT 0 AS band, round(sum(CASE WHEN v >= 128 AND l < 128 THEN 1 ELSE 0 END) / 64.0e0, 6) AS lines FROM (SELECT v, lag(v) OVER (PARTITION BY x ORDER BY y) AS l FROM {RAMP})")
    blocks = "(SELECT y, x, ((x // 5) * 7 + (y // 4) * 3) % 3 AS v FROM " + RAMP + " WHERE x < 24 AND y < 16)"
    flood = f"""WITH RECURSIVE g AS {blocks}, r(y, x, v, ly, lx) AS (
        SELECT y, x, v, y, x FROM g UNION SELECT n.y, n.x, n.v, r.ly, r.lx FROM r JOIN g n ON n.v = r.v AND abs(n.y - r.y) + abs(n.x - r.x) = 1),
        m AS (SELECT y, x, v, min(ly * 24 + lx) AS l FROM r GROUP BY y, x, v)"""
    small = lambda k: geometry.extract_area(ramp(k), 0, 0, 24, 16).with_df(geometry.extract_area(ramp(k), 0, 0, 24, 16).df.withColumn("v", ((F.floor(F.col("x") / 5) * 7 + F.floor(F.col("y") / 4) * 3) % 3).cast("int")))
    im("label_regions", lambda k, d: neighbourhood.label_regions(small(k)), f"{flood} SELECT y, x, dense_rank() OVER (ORDER BY l) AS v FROM m")
    im("label_regions_threshold", lambda k, d: neighbourhood.label_regions(small(k), 0.5).map(lambda v: v), None)

    # Resampling.
    box = lambda v, t, f, w: f"(SELECT y, x // {f} AS x, floor(avg({v}) + 0.5) AS v FROM (SELECT y, x, v FROM {t} WHERE x < {f * w}) GROUP BY y, x // {f})"
    im("shrinkh", lambda k, d: resample.shrinkh(ramp(k), 3), f"SELECT * FROM {box('v', RAMP, 3, 21)}")
    vert = lambda t, f: f"(SELECT y // {f} AS y, x, floor(avg(v) + 0.5) AS v FROM {t} GROUP BY y // {f}, x)"
    im("shrinkv", lambda k, d: resample.shrinkv(ramp(k), 4), f"SELECT * FROM {vert(RAMP, 4)}")
    im("shrink", lambda k, d: resample.shrink(ramp(k), 3, 4), f"SELECT * FROM {vert(box('v', RAMP, 3, 21), 4)}")

    def taps(size: int, factor: float, kernel: str) -> str:
        return ", ".join(f"({o}, {i}, {w!r}e0)" if "e" not in repr(w) else f"({o}, {i}, {w!r})" for o, i, w in resample.plan(size, factor, kernel))

    def rh(t: str, f: float, kernel: str) -> str:
        return f"(SELECT y, o AS x, sum(w * v) AS v FROM {t} JOIN (VALUES {taps(64, f, kernel)}) k(o, i, w) ON x = i GROUP BY y, o)"

    def rv(t: str, f: float, kernel: str) -> str:
        return f"(SELECT o AS y, x, sum(w * v) AS v FROM {t} JOIN (VALUES {taps(48, f, kernel)}) k(o, i, w) ON y = i GROUP BY o, x)"

    real = lambda k: ramp(k).map(lambda v: v.cast("double"), s.F64)
    for kernel in ("nearest", "linear", "cubic", "quadratic", "catmullrom", "lanczos2", "lanczos3"):
        im(f"reduceh_{kernel}", lambda k, d, n=kernel: resample.reduceh(real(k), 2.5, n), f"SELECT * FROM {rh(RAMP, 2.5, kernel)}", True)
    im("reducev", lambda k, d: resample.reducev(real(k), 1.75), f"SELECT * FROM {rv(RAMP, 1.75, 'lanczos3')}", True)
    im("reduce", lambda k, d: resample.reduce(real(k), 2.5, 1.75), f"SELECT * FROM {rv(rh(RAMP, 2.5, 'lanczos3'), 1.75, 'lanczos3')}", True)
    lin = lambda sy, sx, w, h: f"""(WITH g AS (SELECT CAST(i // {w} AS INT) AS y, CAST(i % {w} AS INT) AS x FROM range(0, {w * h}) t(i)), p AS (SELECT y, x, {sy} AS sy, {sx} AS sx FROM g),
        t AS (SELECT p.y, p.x, sum((1 - abs(sy - floor(sy) - a)) * (1 - abs(sx - floor(sx) - b)) * q.v) AS v FROM p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b)
        JOIN {RAMP} q ON q.y = greatest(0, least(47, floor(sy) + a)) AND q.x = greatest(0, least(63, floor(sx) + b)) WHERE sy BETWEEN -0.5 AND 47.5 AND sx BETWEEN -0.5 AND 63.5 GROUP BY p.y, p.x)
        SELECT g.y, g.x, coalesce(t.v, 0) AS v FROM g LEFT JOIN t USING (y, x))"""  # noqa: E731
    im("affine", lambda k, d: resample.affine(real(k), (0.8, 0.1, -0.1, 0.9), 2.5, 3.25, 50, 40), f"SELECT * FROM {lin('x * -0.1e0 + y * 0.9e0 + 3.25', 'x * 0.8e0 + y * 0.1e0 + 2.5', 50, 40)}", True)
    a, b = math.cos(math.radians(10)) / 1.5, math.sin(math.radians(10)) / 1.5
    im("similarity", lambda k, d: resample.similarity(real(k), 1.5, 10, 60, 50), f"SELECT * FROM {lin(f'x * {-b!r}e0 + y * {a!r}e0 + 0.0', f'x * {a!r}e0 + y * {b!r}e0 + 0.0', 60, 50)}", True)
    im("quadratic", lambda k, d: resample.quadratic(real(k), [(1.0, 2.0), (0.9, 0.05), (0.02, 0.95), (0.001, 0.0), (0.0, 0.001), (0.0, 0.0)], 50, 40), f"SELECT * FROM {lin('y + 2.0 + x * 0.05e0 + y * 0.95e0 + 0.0 * x * y + 0.001e0 * x * x', 'x + 1.0 + x * 0.9e0 + y * 0.02e0 + 0.001e0 * x * y', 50, 40)}", True)
    from ..raster import column_expression

    index = lambda k: column_expression(k, 40, 30, lambda y, x: [x * 1.25 + 3.5, y * 1.5 + 0.25])
    im("mapim", lambda k, d: resample.mapim(real(k), index(k)), f"SELECT * FROM {lin('y * 1.5e0 + 0.25', 'x * 1.25e0 + 3.5', 40, 30)}", True)
    # Of the other kernels: the taps of each place with their weights, of d the distance.
    spread = lambda taps: f"""WITH g AS (SELECT CAST(i // 30 AS INT) AS y, CAST(i % 30 AS INT) AS x FROM range(0, 600) t(i)), p AS (SELECT y, x, x * -0.1e0 + y * 0.9e0 + 3.25 AS sy, x * 0.8e0 + y * 0.1e0 + 2.5 AS sx FROM g),
        s AS (SELECT *, floor(sy) AS fy, floor(sx) AS fx, sy - floor(sy) AS dy, sx - floor(sx) AS dx FROM p WHERE sy BETWEEN -0.5 AND 47.5 AND sx BETWEEN -0.5 AND 63.5), w AS ({taps}),
        t AS (SELECT w.y, w.x, sum(w.w * q.v) / sum(w.w) AS v FROM w JOIN {RAMP} q ON q.y = greatest(0, least(47, w.qy)) AND q.x = greatest(0, least(63, w.qx)) GROUP BY w.y, w.x) SELECT g.y, g.x, coalesce(t.v, 0) AS v FROM g LEFT JOIN t USING (y, x)"""  # noqa: E731
    cubic = lambda d: f"(CASE WHEN {d} < 1 THEN 1.5e0 * {d} * {d} * {d} - 2.5e0 * {d} * {d} + 1 WHEN {d} < 2 THEN -0.5e0 * {d} * {d} * {d} + 2.5e0 * {d} * {d} - 4 * {d} + 2 ELSE 0 END)"
    lanczos = lambda d: f"(CASE WHEN {d} < 2.3e-16 THEN 1 WHEN {d} < 3 THEN 3 * sin(pi() * {d}) * sin(pi() * {d} / 3) / (pi() * pi() * {d} * {d}) ELSE 0 END)"
    b_spline = lambda d: f"(CASE WHEN {d} < 0.5 THEN 0.75e0 - {d} * {d} WHEN {d} < 1.5 THEN (1.5e0 - {d}) * (1.5e0 - {d}) / 2 ELSE 0 END)"
    apart = lambda f, reach: f"SELECT y, x, fy + a AS qy, fx + b AS qx, {f('abs(dy - a)')} * {f('abs(dx - b)')} AS w FROM s, range({1 - reach}, {reach + 1}) k(a), range({1 - reach}, {reach + 1}) l(b)"
    # Splits a, b of the samples before and after a place; each is half its sample and a quarter of two neighbours.
    split = f"""SELECT y, x, fy + a // 2 + m.v * (a % 2 * 2 - 1) AS qy, fx + b // 2 + m.h * (b % 2 * 2 - 1) AS qx, {b_spline('abs(2 * dy + 0.5e0 - a)')} * {b_spline('abs(2 * dx + 0.5e0 - b)')} * m.part AS w
        FROM s, range(0, 4) k(a), range(0, 4) l(b), (VALUES (0, 0, 0.5e0), (1, 0, 0.25e0), (0, 1, 0.25e0)) m(v, h, part)"""
    for kernel, taps in (("cubic", apart(cubic, 2)), ("nohalo", None), ("lbb", None), ("vsqbs", split), ("lanczos3", apart(lanczos, 3))):
        im(f"affine_{kernel}", lambda k, d, n=kernel: resample.affine(real(k), (0.8, 0.1, -0.1, 0.9), 2.5, 3.25, 30, 20, n), taps and spread(taps), True)
    im("resize_shrink", lambda k, d: resample.resize(real(k), 0.25, kernel="nearest"), f"SELECT y // 4 AS y, x // 4 AS x, avg(v) AS v FROM {RAMP} GROUP BY y // 4, x // 4", True)
    im("resize_lanczos", lambda k, d: resample.resize(ramp(k), 0.3), None)
    im("resize_enlarge", lambda k, d: resample.resize(ramp(k), 2.0, kernel="nearest"), f"SELECT y * 2 + k // 2 AS y, x * 2 + k % 2 AS x, v FROM {RAMP}, range(0, 4) t(k)")
    im("thumbnail", lambda k, d: resample.thumbnail(ramp(k), 20), None)
    im("thumbnail_crop", lambda k, d: resample.thumbnail(ramp(k), 20, 20, crop=True), None)

    # Drawing.
    put = lambda w, ink=200: f"SELECT y, x, CASE WHEN {w} THEN {ink} ELSE v END AS v FROM {RAMP}"
    listed = lambda pts: "(y, x) IN (" + ", ".join(f"({y}, {x})" for y, x in sorted(pts)) + ")"
    im("draw_point", lambda k, d: draw.draw_point(ramp(k), 7, 9, [200]), put("x = 7 AND y = 9"))
    im("draw_rect", lambda k, d: draw.draw_rect(ramp(k), 5, 6, 20, 10, [200]), put("x BETWEEN 5 AND 24 AND y BETWEEN 6 AND 15"))
    im("draw_rect_outline", lambda k, d: draw.draw_rect(ramp(k), 5, 6, 20, 10, [200], False), put("x BETWEEN 5 AND 24 AND y BETWEEN 6 AND 15 AND (x IN (5, 24) OR y IN (6, 15))"))
    im("draw_line", lambda k, d: draw.draw_line(ramp(k), 3, 4, 50, 30, [200]), put(listed(draw.line_points(3, 4, 50, 30))))
    im("draw_circle", lambda k, d: draw.draw_circle(ramp(k), 30, 20, 12, [200]), put(listed(draw.circle_points(30, 20, 12))))
    rows: dict = {}
    for y, x in draw.circle_points(30, 20, 12):
        rows.setdefault(y, []).append(x)
    im("draw_circle_filled", lambda k, d: draw.draw_circle(ramp(k), 30, 20, 12, [200], True), put(" OR ".join(f"y = {y} AND x BETWEEN {min(v)} AND {max(v)}" for y, v in sorted(rows.items()))))
    im("draw_flood", lambda k, d: draw.draw_flood(small(k), 3, 2, [9]), f"{flood} SELECT y, x, CASE WHEN l = (SELECT l FROM m WHERE x = 3 AND y = 2) THEN 9 ELSE v END AS v FROM m")
    sub = f"(SELECT y + 20 AS y, x + 40 AS x, v AS w FROM {OTHER} WHERE x < 30 AND y < 10)"
    cut = lambda k: geometry.extract_area(other(k), 0, 0, 30, 10)
    im("draw_image", lambda k, d: draw.draw_image(ramp(k), cut(k), 40, 20), f"SELECT y, x, coalesce(w, v) AS v FROM {RAMP} LEFT JOIN {sub} USING (y, x)")
    im("draw_image_add", lambda k, d: draw.draw_image(ramp(k), cut(k), 40, 20, "add"), f"SELECT y, x, CASE WHEN w IS NULL THEN v ELSE least(255, v + w) END AS v FROM {RAMP} LEFT JOIN {sub} USING (y, x)")
    im("draw_mask", lambda k, d: draw.draw_mask(ramp(k), cut(k), 40, 20, [200]), f"SELECT y, x, coalesce((200 * w + v * (255 - w)) // 255, v) AS v FROM {RAMP} LEFT JOIN {sub} USING (y, x)")
    im("draw_smudge", lambda k, d: draw.draw_smudge(ramp(k), 10, 10, 12, 8), None)

    # Mosaicing.
    one = lambda r: r.map(lambda v: F.greatest(v, F.lit(1)))
    ra, rb = f"(SELECT y, x, greatest(v, 1) AS v FROM {RAMP})", f"(SELECT y, x, greatest(v, 1) AS v FROM {OTHER})"

    def merged(along: str, shift_y: int, shift_x: int, lo: float, hi: float, w: int, h: int) -> str:
        t = f"greatest(0, least(1, (g.{along} - {lo}e0) / {hi - lo}e0))"
        return f"""SELECT g.y, g.x, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN floor(a.v * (1 - {t}) + b.v * {t} + 0.5) ELSE coalesce(b.v, a.v, 0) END AS v
            FROM (SELECT CAST(i // {w} AS INT) AS y, CAST(i % {w} AS INT) AS x FROM range(0, {w * h}) t(i)) g LEFT JOIN {ra} a ON a.y = g.y AND a.x = g.x LEFT JOIN {rb} b ON b.y = g.y - {shift_y} AND b.x = g.x - {shift_x}"""

    across = merged("x", 0, 40, 46.5, 56.5, 104, 48)
    down = merged("y", 30, 0, 33.5, 43.5, 64, 78)
    im("merge_horizontal", lambda k, d: mosaic.merge(one(ramp(k)), one(other(k)), "horizontal", -40, 0), across)
    im("merge_vertical", lambda k, d: mosaic.merge(one(ramp(k)), one(other(k)), "vertical", 0, -30), down)
    im("lrmerge", lambda k, d: mosaic.lrmerge(one(ramp(k)), one(other(k)), -40, 0), across)
    im("tbmerge", lambda k, d: mosaic.tbmerge(one(ramp(k)), one(other(k)), 0, -30), down)
    im("mosaic", lambda k, d: mosaic.mosaic(one(ramp(k)), one(other(k)), "horizontal", 45, 5, 5, 5), across)
    pair = lambda k: (ramp(k), geometry.extract_area(ramp(k), 30, 0, 34, 48))
    c.table("tie_point_search", lambda k, d: mosaic.best_tie(*pair(k), -29, 1, 3).select("dx", "dy", F.round("corr", 6).alias("corr")), "SELECT -30 AS dx, 0 AS dy, 1.0e0 AS corr")
    im("lrmosaic", lambda k, d: mosaic.auto_mosaic(*pair(k), "horizontal", 31, 5, 2, 6, 3), RAMP)
    im("tbmosaic", lambda k, d: mosaic.auto_mosaic(ramp(k), geometry.extract_area(ramp(k), 0, 20, 64, 28), "vertical", 5, 21, 5, 2, 2), RAMP)
    im("remosaic", lambda k, d: mosaic.remosaic(ramp(k), 0.8), f"SELECT y, x, floor(v * 0.8e0 + 0.5) AS v FROM {RAMP}")
    ties = [(10.0, 20.0, 4.0, 3.0), (60.0, 25.0, 54.0, 8.0), (30.0, 70.0, 24.0, 53.0), (5.0, 5.0, 90.0, 1.0), (80.0, 90.0, 74.0, 73.0)]
    c.table("match", lambda k, d: k.createDataFrame([tuple(round(v, 6) + 0.0 for v in mosaic.match(ties[:3]))], "a double, b double, c double, d double, tx double, ty double"), "SELECT 1.0e0 AS a, 0.0e0 AS b, 0.0e0 AS c, 1.0e0 AS d, 6.0e0 AS tx, 17.0e0 AS ty")
    c.table("chkpair", lambda k, d: k.createDataFrame([(i,) for i in mosaic.chkpair(ties, 0.5)], "pair int"), "SELECT CAST(unnest([0, 1, 2, 4]) AS INT) AS pair")

    def balanced(k, d):
        sides = [ramp(k).df.selectExpr("0 AS overlap", "0 AS tile", "v"), other(k).df.selectExpr("0 AS overlap", "1 AS tile", "v")]
        return k.createDataFrame([(i, round(v, 6)) for i, v in enumerate(mosaic.global_balance(sides[0].union(sides[1]), 2))], "tile int, gain double")

    means = f"(SELECT (SELECT avg(v) FROM {RAMP}) AS a, (SELECT avg(v) FROM {OTHER}) AS b)"
    c.table("global_balance", balanced, f"SELECT 0 AS tile, round(sqrt(b / a), 6) AS gain FROM {means} UNION ALL SELECT 1, round(sqrt(a / b), 6) FROM {means}")
