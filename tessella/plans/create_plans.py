"""Queries of the generators."""

from __future__ import annotations

import math

from ..functions import samples as s
from ..operators import generators as g
from .images import Catalogue


def grid(w: int, h: int) -> str:
    return f"(SELECT CAST(i // {w} AS INT) AS y, CAST(i % {w} AS INT) AS x FROM range(0, {w * h}) t(i))"


def register(c: Catalogue) -> None:
    W, H = 64, 48
    G = grid(W, H)
    im = lambda name, f, sql, real=True, band=False: c.image(name, lambda k, d: f(k), sql, real, band)
    of = lambda e, t=G: f"SELECT y, x, {e} AS v FROM {t}"
    im("black", lambda k: g.black(k, W, H), of("0"), False)
    im("zero_source", lambda k: g.zero(k, W, H), of("0"), False)
    im("white_source", lambda k: g.white(k, W, H), of("255"), False)
    im("color_source", lambda k: g.constant(k, W, H, [10, 20, 30]), f"SELECT y, x, band, (band + 1) * 10 AS v FROM {G}, range(0, 3) u(band)", False, True)
    eye = f"CAST(y * y AS DOUBLE) * cos(CAST(x * x AS DOUBLE) * {0.5 * math.pi / 126!r}e0) / {float(47 * 47)}e0"
    im("eye", lambda k: g.eye(k, W, H, 0.5), of(eye))
    im("eye_uchar", lambda k: g.eye(k, W, H, 0.5, True), of(f"floor((({eye}) + 1) * 0.5e0 * 255 + 0.5)"), False)
    im("zone", lambda k: g.zone(k, W, H), of(f"cos(CAST((x - 32) * (x - 32) + (y - 24) * (y - 24) AS DOUBLE) * {math.pi / 64!r}e0)"))
    t = math.atan(1.5)
    im("sines", lambda k: g.sines(k, W, H, 2, 3), of(f"cos((x * {math.cos(t)!r}e0 - y * {math.sin(t)!r}e0) * {math.hypot(2, 3) * 2 * math.pi / 64!r}e0)"))
    im("grey", lambda k: g.grey(k, W, H), of("x / 63.0e0"))
    im("grey_vertical", lambda k: g.grey(k, W, H, True), of("y / 47.0e0"))
    im("identity", lambda k: g.identity(k), of("x", grid(256, 1)), False)
    im("identity_ushort", lambda k: g.identity(k, 1, True), of("x", grid(65536, 1)), False)
    im("xyz", lambda k: g.xyz(k, W, H), f"SELECT y, x, 0 AS band, x AS v FROM {G} UNION ALL SELECT y, x, 1, y FROM {G} UNION ALL SELECT y, x, 2, 0 FROM {G}", False, True)
    r = g.gaussmat_radius(2.0, 0.1)
    d = f"CAST((x - {r}) * (x - {r}) + (y - {r}) * (y - {r}) AS DOUBLE)"
    im("gaussmat", lambda k: g.gaussmat(k, 2.0, 0.1), of(f"floor(20 * exp(-{d} / 8) + 0.5)", grid(2 * r + 1, 2 * r + 1)))
    im("gaussmat_float", lambda k: g.gaussmat(k, 2.0, 0.1, integer=False), of(f"exp(-{d} / 8)", grid(2 * r + 1, 2 * r + 1)))
    q = g.logmat_radius(1.5, 0.1)
    d = f"CAST((x - {q}) * (x - {q}) + (y - {q}) * (y - {q}) AS DOUBLE)"
    im("logmat", lambda k: g.logmat(k, 1.5, 0.1, integer=False), of(f"0.5 * (2 - {d} / 2.25e0) * exp(-{d} / 4.5e0)", grid(2 * q + 1, 2 * q + 1)))
    im("buildlut", lambda k: g.buildlut(k, [(10, 0), (100, 200), (200, 50)], 256), of("CASE WHEN x < 10 THEN 0 WHEN x < 100 THEN (x - 10) / 90.0e0 * 200 WHEN x < 200 THEN 200 - (x - 100) / 100.0e0 * 150 ELSE 50 END", grid(256, 1)))
    im("invertlut", lambda k: g.invertlut(k, [[0.1, 0.2], [0.5, 0.6], [0.9, 0.95]], 100), of("CASE WHEN x < 19 THEN x * (0.1e0 / 19) WHEN x <= 94 THEN CASE WHEN x / 99.0e0 <= 0.6e0 THEN 0.1e0 + (x / 99.0e0 - 0.2e0) / 0.4e0 * 0.4e0 ELSE 0.5e0 + (x / 99.0e0 - 0.6e0) / 0.35e0 * 0.4e0 END ELSE 0.9e0 + (x - 94) * (0.1e0 / 5) END", grid(100, 1)))
    sm = lambda e: f"(3 * ({e}) * ({e}) - 2 * ({e}) * ({e}) * ({e}))"
    bump = lambda a, b, e: f"CASE WHEN t < {a} THEN 0 WHEN t < {b} THEN {sm(f'(t - {a}) / {b - a}e0')} WHEN t < {e} THEN 1 - {sm(f'(t - {b}) / {e - b}e0')} ELSE 0 END"
    tone = f"(SELECT y, x, x * 100.0e0 / 255 AS t FROM {grid(256, 1)})"
    im("tonelut", lambda k: g.tonelut(k, 255, 255, shadow=5.0, mid=-5.0, high=2.0), of(f"greatest(0, least(255, 2.55e0 * (t + 5 * ({bump(0.0, 20.0, 50.0)}) - 5 * ({bump(20.0, 50.0, 80.0)}) + 2 * ({bump(50.0, 80.0, 100.0)}))))", tone))
    z = f"""WITH RECURSIVE z(y, x, cx, cy, zx, zy, n, i) AS (SELECT y, x, x / 64.0e0 * 3.5e0 - 2.5e0, y / 48.0e0 * 2 - 1, 0.0e0, 0.0e0, 0, 0 FROM {G}
        UNION ALL SELECT y, x, cx, cy, zx * zx - zy * zy + cx, 2 * zx * zy + cy, n + 1, i + 1 FROM z WHERE i < 32 AND zx * zx + zy * zy <= 4)"""
    im("mandelbrot", lambda k: g.mandelbrot(k, W, H, 32), f"{z} SELECT y, x, max(n) / 32.0e0 * 255 AS v FROM z GROUP BY y, x")

    def add(h: str, v: str) -> str:
        for shift in (0, 8, 16, 24):
            h = f"((xor({h}, ({v} >> {shift}) & 255) * 16777619) & {g.MASK32})"
        return h

    # One column per step of the hash keeps the text of the query short.
    steps = f"(SELECT y, x, CAST(7 AS BIGINT) AS h0, CAST(x AS BIGINT) AS kx, CAST(y AS BIGINT) AS ky FROM {G})"
    steps = f"(SELECT *, {add('h0', 'kx')} AS h1 FROM {steps})"
    steps = f"(SELECT *, {add('h1', 'ky')} AS n0 FROM {steps})"
    for i in range(12):
        steps = f"(SELECT y, x, {''.join(f'n{j}, ' for j in range(1, i + 1))}{add('CAST(2166136261 AS BIGINT)', f'n{i}')} AS n{i + 1} FROM {steps})"
    total = " + ".join(f"n{i} / {float(g.MASK32)}e0" for i in range(1, 13))
    im("gaussnoise", lambda k: g.gaussnoise(k, W, H, 10.0, 2.0, 7), of(f"(({total}) - 6) * 2 + 10", steps))
    steps = f"(SELECT y, x, band, CAST(7 AS BIGINT) AS h0, CAST(x AS BIGINT) AS kx, CAST(y AS BIGINT) AS ky FROM {G}, range(0, 3) t(band))"
    steps = f"(SELECT *, {add('h0', 'kx')} AS h1 FROM {steps})"
    steps = f"(SELECT *, {add('h1', 'ky')} AS h2 FROM {steps})"
    steps = f"(SELECT *, {add('h2', 'band')} AS n0 FROM {steps})"
    for i in range(12):
        steps = f"(SELECT y, x, band, {''.join(f'n{j}, ' for j in range(1, i + 1))}{add('CAST(2166136261 AS BIGINT)', f'n{i}')} AS n{i + 1} FROM {steps})"
    im("gaussnoise_bands", lambda k: g.gaussnoise(k, W, H, 10.0, 2.0, 7, 3), f"SELECT y, x, band, (({total}) - 6) * 2 + 10 AS v FROM {steps}", band=True)
    # Corners of a cell are numbered by row and column: 00, 01, 10, 11.
    corners = [(a, b) for a in (0, 1) for b in (0, 1)]
    noise = f"(SELECT y, x, y % 16 / 16.0e0 AS dy, x % 16 / 16.0e0 AS dx, CAST(y // 16 AS BIGINT) AS cy, CAST(x // 16 AS BIGINT) AS cx FROM {G})"
    noise = f"(SELECT *, {', '.join(add('CAST(3 AS BIGINT)', f'((cy + {a}) % 3)') + f' AS r{a}{b}' for a, b in corners)} FROM {noise})"
    noise = f"(SELECT *, {', '.join(add(f'r{a}{b}', f'((cx + {b}) % 4)') + f' AS h{a}{b}' for a, b in corners)} FROM {noise})"
    noise = f"(SELECT *, {', '.join(f'(xor(xor(h{a}{b}, h{a}{b} >> 8), h{a}{b} >> 16) & 255) * (pi() / 128) AS t{a}{b}' for a, b in corners)} FROM {noise})"
    noise = f"(SELECT *, {', '.join(f'({b} - dx) * cos(t{a}{b}) + ({a} - dy) * sin(t{a}{b}) AS n{a}{b}' for a, b in corners)}, 6 * pow(dx, 5) - 15 * pow(dx, 4) + 10 * pow(dx, 3) AS sx, 6 * pow(dy, 5) - 15 * pow(dy, 4) + 10 * pow(dy, 3) AS sy FROM {noise})"
    im("perlin", lambda k: g.perlin(k, W, H, 16, 3), of("(greatest(-1, least(1, (n00 + sx * (n01 - n00)) * (1 - sy) + (n10 + sx * (n11 - n10)) * sy)) + 1) / 2", noise))
    cells = g._cells(4, 3, 16, 5)
    feats = ", ".join(f"({cy}, {cx}, {fy}, {fx})" for cy in range(3) for cx in range(4) for a in (-1, 0, 1) for b in (-1, 0, 1) for fy, fx in cells[(cy + a) % 3, (cx + b) % 4])
    im("worley", lambda k: g.worley(k, W, H, 16, 5), f"SELECT y, x, least(1, min(sqrt(CAST((fy - y) * (fy - y) + (fx - x) * (fx - x) AS DOUBLE))) / 24.0e0) AS v FROM {G} JOIN (VALUES {feats}) f(cy, cx, fy, fx) ON cy = y // 16 AND cx = x // 16 GROUP BY y, x")
    im("sdf_circle", lambda k: g.sdf_circle(k, W, H, 30, 20, 12), of("sqrt(CAST((x - 30) * (x - 30) + (y - 20) * (y - 20) AS DOUBLE)) - 12"))
    dx, dy = "(abs(x - 25.0e0) - 15)", "(abs(y - 20.0e0) - 10)"
    im("sdf_rect", lambda k: g.sdf_rect(k, W, H, 10, 10, 40, 30), of(f"sqrt(greatest({dx}, 0) * greatest({dx}, 0) + greatest({dy}, 0) * greatest({dy}, 0)) + least(greatest({dx}, {dy}), 0)"))
    chained = f"""WITH RECURSIVE c(i, h) AS (SELECT 0, CAST(3 AS BIGINT) UNION ALL SELECT i + 1, {add('CAST(2166136261 AS BIGINT)', 'h')} FROM c WHERE i < 400),
        p AS (SELECT (i - 1) // 2 AS k, max(h) FILTER (i % 2 = 1) % {W} AS px, max(h) FILTER (i % 2 = 0) % {H} AS py FROM c WHERE i > 0 GROUP BY (i - 1) // 2),
        f AS (SELECT px, py FROM p GROUP BY px, py ORDER BY min(k) LIMIT 20)"""
    im("point", lambda k: g.point(k, W, H, 20, 3), f"{chained} SELECT y, x, CASE WHEN px IS NULL THEN 0 ELSE 255 END AS v FROM {G} LEFT JOIN f ON px = x AND py = y", False)
    im("fractsurf", lambda k: g.fractsurf(k, W, H), None)
    fm = f"(SELECT y, x, ((x + 32) % 64 - 32) / 32.0e0 AS dx, ((y + 24) % 48 - 24) / 24.0e0 AS dy FROM {G})"
    fm = f"(SELECT *, dx * dx + dy * dy AS q, (dx - 0.5e0) * (dx - 0.5e0) + (dy - 0.5e0) * (dy - 0.5e0) AS d1, (dx + 0.5e0) * (dx + 0.5e0) + (dy + 0.5e0) * (dy + 0.5e0) AS d2 FROM {fm})"
    la, norm = math.log(0.5), 1 / (1 + math.exp(math.log(0.5) * 4 * 0.5 / 0.04))
    bnorm = 1 / (1 + 1 / (1 + (4 * 0.5 / 0.04) ** 2))
    kinds = {
        "ideal": "CASE WHEN q <= 0.25 THEN 0 ELSE 1 END", "ideal-ring": "CASE WHEN q > 0.4e0 * 0.4e0 AND q < 0.6e0 * 0.6e0 THEN 1 ELSE 0 END", "ideal-band": "CASE WHEN d1 < 0.2e0 * 0.2e0 OR d2 < 0.2e0 * 0.2e0 THEN 1 ELSE 0 END",
        "gaussian": f"1 - exp({la!r}e0 * q / 0.25e0)", "gaussian-ring": f"exp({la!r}e0 * (sqrt(q) - 0.5e0) * (sqrt(q) - 0.5e0) / 0.01e0)", "gaussian-band": f"{norm!r}e0 * (exp({la!r}e0 * d1 / 0.04e0) + exp({la!r}e0 * d2 / 0.04e0))",
        "butterworth": "CASE WHEN q = 0 THEN 0 ELSE 1 / (1 + pow(0.25e0 / q, 2)) END", "butterworth-ring": "1 / (1 + pow((sqrt(q) - 0.5e0) * (sqrt(q) - 0.5e0) / 0.01e0, 2))", "butterworth-band": f"{bnorm!r}e0 * (1 / (1 + pow(d1 / 0.04e0, 2)) + 1 / (1 + pow(d2 / 0.04e0, 2)))",
        "fractal": "CASE WHEN q = 0 THEN 1 ELSE pow(q, -0.75e0) END",
    }
    for kind, e in kinds.items():
        im(f"mask_{kind.replace('-', '_')}", lambda k, n=kind: g.frequency_mask(k, W, H, n), of(f"CASE WHEN dx = 0 AND dy = 0 THEN 1 ELSE {e} END", fm))
