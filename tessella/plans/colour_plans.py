"""Queries of colour conversions and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour as k
from ..functions import samples as s
from ..operators import bands
from .images import RGB, U8, Catalogue, rgb, u8


def named(exprs: list[str], source: str, names: str = "abcd") -> str:
    return f"(SELECT y, x, {', '.join(f'{e} AS {n}' for e, n in zip(exprs, names, strict=False))} FROM {source})"


def stacked(t: str, n: int) -> str:
    return " UNION ALL ".join(f"SELECT y, x, {i} AS band, {'abcd'[i]} AS v FROM {t}" for i in range(n))


def mat(m) -> list[str]:
    return [" + ".join(f"{w!r}e0 * {v}" if "e" not in repr(w) else f"{w!r} * {v}" for w, v in zip(row, "abc", strict=True)) for row in m]


ABC = f"(SELECT y, x, CAST(r AS DOUBLE) AS a, CAST(g AS DOUBLE) AS b, CAST(b AS DOUBLE) AS c FROM {RGB})"
DEC = "CASE WHEN {v} / 255.0 <= 0.04045 THEN {v} / 255.0 / 12.92 ELSE pow(({v} / 255.0 + 0.055) / 1.055, 2.4) END"
LIN = named([DEC.format(v=v) for v in "abc"], ABC)
XYZ = named(mat(k.RGB_TO_XYZ), LIN)
CURVE = "CASE WHEN {v} < 0.008856 THEN 7.787 * {v} + 16.0e0 / 116 ELSE cbrt({v}) END"
UNIT = "greatest(0, least(1, {v}))"
_CUR = named([CURVE.format(v=UNIT.format(v=f"({v} / {w!r}e0)")) for v, w in zip("abc", (k.X0, k.Y0, k.Z0), strict=True)], XYZ)
LAB = named(["116 * b - 16", "500 * (a - b)", "200 * (b - c)"], _CUR)
HUE = "CASE WHEN {a} = 0 AND {b} = 0 THEN 0 WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"
LCH = named(["a", "sqrt(b * b + c * c)", HUE.format(a="b", b="c")], LAB)


def encoded(t: str) -> str:
    """Linear bands to 8-bit codes, between the codes of 256 linear steps."""
    at = named([f"greatest(0, least(1, {v})) * 255" for v in "abc"], t)
    code = lambda i: f"floor((CASE WHEN {i} / 255.0e0 <= 0.0031308 THEN {i} / 255.0e0 * 12.92 ELSE 1.055 * pow({i} / 255.0e0, 1 / 2.4e0) - 0.055 END) * 255 + 0.5)"
    low = lambda v: f"floor({v})"
    return named([f"floor(({v} - floor({v})) * ({code(f'least(floor({v}) + 1, 255)')} - {code(low(v))}) + {code(low(v))} + 0.5)" for v in "abc"], at)


def lab_xyz(t: str) -> str:
    p = f"(SELECT y, x, a, b, c, CASE WHEN a < 8 THEN 7.787 * (a / 903.3) + 16.0e0 / 116 ELSE (a + 16) / 116 END AS f FROM {t})"
    un = lambda e, w: f"CASE WHEN {e} < 0.2069 THEN {w}e0 * ({e} - 0.13793) / 7.787 ELSE {w}e0 * ({e}) * ({e}) * ({e}) END"
    return named([un("(b / 500 + f)", k.X0), "CASE WHEN a < 8 THEN a / 903.3 ELSE f * f * f END", un("(f - c / 200)", k.Z0)], p)


def register(c: Catalogue) -> None:
    base = lambda sp, d: rgb(sp, d).map(lambda v: v.cast("double"), s.F64)

    def add(name, f, t, n=3, exact=False):
        c.image(name, lambda sp, d: bands.colour(base(sp, d), f), stacked(t, n), not exact, True)

    chain = k.chain
    add("srgb_to_scrgb", k.srgb_to_scrgb, LIN)
    add("scrgb_to_srgb", chain(lambda v: [x / 300.0 for x in v], k.scrgb_to_srgb), encoded(named([f"{v} / 300.0" for v in "abc"], ABC)), exact=True)
    add("scrgb_to_xyz", chain(k.srgb_to_scrgb, k.scrgb_to_xyz), XYZ)
    add("srgb_to_xyz", k.srgb_to_xyz, XYZ)
    add("xyz_to_scrgb", chain(k.srgb_to_xyz, k.xyz_to_scrgb), named(mat(k.XYZ_TO_RGB), XYZ))
    add("scrgb_to_bw", chain(k.srgb_to_scrgb, k.scrgb_to_bw), named(["0.2126 * a + 0.7152 * b + 0.0722 * c"], LIN), 1)
    add("xyz_to_lab", chain(k.srgb_to_xyz, k.xyz_to_lab), LAB)
    add("srgb_to_lab", k.srgb_to_lab, LAB)
    add("lab_to_xyz", chain(k.srgb_to_lab, k.lab_to_xyz), lab_xyz(LAB))
    add("lab_to_lch", chain(k.srgb_to_lab, k.lab_to_lch), LCH)
    add("lch_to_lab", chain(k.srgb_to_lab, k.lab_to_lch, k.lch_to_lab), named(["a", "b * cos(radians(c))", "b * sin(radians(c))"], LCH))
    t = "(SELECT y, x, a, b, c, " + ", ".join(f"CASE {' '.join(f'WHEN c < {top} THEN {v[i]}e0' for top, *v in k.HUE_CURVE[:-1])} ELSE {k.HUE_CURVE[-1][i + 1]}e0 END AS k{i + 4}" for i in range(5)) + f" FROM {LCH})"
    t = f"(SELECT *, cos(radians(k7 * c + k8)) AS p FROM {t})"
    ucs = ["CASE WHEN a < 16 THEN 1.744 * a ELSE 21.75 * ln(a) + 0.3838 * a - 38.54 END", "greatest(0, 10.92 * ln(0.07216 * b + 0.638) + 0.162 * b + 4.907)", "c + (k4 + k5 * (CASE WHEN p = 0 THEN 0 ELSE p * pow(abs(p), k6) END)) * sqrt(pow(b, 4) / (pow(b, 4) + 1900))"]
    add("lch_to_ucs", chain(k.srgb_to_lab, k.lab_to_lch, k.lch_to_ucs), named([u.replace("ELSE 21.75 * ln(a)", "ELSE 21.75 * ln(greatest(a, 1e-30))") for u in ucs], t))
    # The forward curves at the points of the tables, inverted by the first point above a goal.
    fl = lambda v: ucs[0].replace("ELSE 21.75 * ln(a)", "ELSE 21.75 * ln(greatest(a, 1e-30))").replace("a <", f"{v} <").replace("* a", f"* {v}").replace("(a,", f"({v},")
    grow = lambda v: f"greatest(0, 10.92 * ln(0.07216 * {v} + 0.638) + 0.162 * {v} + 4.907)"

    def turned_back(n: str, size: int, curve: str) -> str:
        return f"""{n}f AS MATERIALIZED (SELECT i, CAST({curve} AS DOUBLE) AS v FROM range(0, {size}) t(i)),
            {n} AS MATERIALIZED (SELECT g.i, (g.j - 1 + CASE WHEN p.v = q.v THEN 0 ELSE (g.i / 10.0e0 - p.v) / (q.v - p.v) END) / 10.0e0 AS v
                FROM (SELECT t.i, greatest(1, coalesce(min(f.i) FILTER (f.v > t.i / 10.0e0), {size - 1})) AS j FROM range(0, {size}) t(i), {n}f f GROUP BY t.i) g JOIN {n}f p ON p.i = g.j - 1 JOIN {n}f q ON q.i = g.j)"""

    hk = [f"CASE {' '.join(f'WHEN h < {top} THEN {v[i]}e0' for top, *v in k.HUE_CURVE[:-1])} ELSE {k.HUE_CURVE[-1][i + 1]}e0 END AS k{i + 4}" for i in range(5)]
    line = lambda n, v: f"({n}0.v + ({n}1.v - {n}0.v) * ({v}))"
    back_lch = f"""(WITH {turned_back("li", 1001, fl("(i / 10.0e0)"))}, {turned_back("ci", 3001, grow("(i / 10.0e0)"))},
        hf AS MATERIALIZED (SELECT j, h AS i, h + (k4 + k5 * (CASE WHEN p = 0 THEN 0 ELSE p * pow(abs(p), k6) END)) * sqrt(pow(2.0e0 * j, 4) / (pow(2.0e0 * j, 4) + 1900)) AS v FROM (SELECT *, cos(radians(k7 * h + k8)) AS p
            FROM (SELECT j, h, {', '.join(hk)} FROM range(0, 101) a(j), range(0, 361) b(h)))),
        hi AS MATERIALIZED (SELECT g.j, g.i, g.k - 1 + (g.i - p.v) / (q.v - p.v) AS v FROM (SELECT f.j, t.i, coalesce(min(f.i) FILTER (f.i BETWEEN 1 AND 359 AND f.v > t.i), 360) AS k FROM hf f, range(0, 361) t(i) GROUP BY f.j, t.i) g
            JOIN hf p ON p.j = g.j AND p.i = g.k - 1 JOIN hf q ON q.j = g.j AND q.i = g.k),
        u AS (SELECT *, CAST(greatest(0, least(999, floor(a * 10))) AS BIGINT) AS ka, CAST(greatest(0, least(2999, floor(b * 10))) AS BIGINT) AS kb, CAST(greatest(0, least(359, floor(c))) AS BIGINT) AS kc FROM {named([x.replace("ELSE 21.75 * ln(a)", "ELSE 21.75 * ln(greatest(a, 1e-30))") for x in ucs], t)}),
        w AS (SELECT u.y, u.x, {line("l", "a * 10 - ka")} AS a, {line("c", "b * 10 - kb")} AS b, c, kc FROM u JOIN li l0 ON l0.i = ka JOIN li l1 ON l1.i = ka + 1 JOIN ci c0 ON c0.i = kb JOIN ci c1 ON c1.i = kb + 1)
        SELECT w.y, w.x, a, b, {line("h", "c - kc")} AS c FROM w JOIN hi h0 ON h0.i = kc AND h0.j = greatest(0, least(99, CAST(trunc((b + 1) / 2) AS BIGINT))) JOIN hi h1 ON h1.i = kc + 1 AND h1.j = h0.j)"""
    add("ucs_to_lch", chain(k.srgb_to_lab, k.lab_to_lch, k.lch_to_ucs, k.ucs_to_lch), back_lch)
    yxy = named(["b", "CASE WHEN a + b + c = 0 THEN 0 ELSE a / (a + b + c) END", "CASE WHEN a + b + c = 0 THEN 0 ELSE b / (a + b + c) END"], XYZ)
    add("xyz_to_yxy", chain(k.srgb_to_xyz, k.xyz_to_yxy), yxy)
    add("yxy_to_xyz", chain(k.srgb_to_xyz, k.xyz_to_yxy, k.yxy_to_xyz), named(["CASE WHEN b = 0 OR c = 0 THEN 0 ELSE a * b / c END", "a", "CASE WHEN b = 0 OR c = 0 THEN 0 ELSE a * (1 - b - c) / c END"], yxy))
    ok = named(mat(k.LMS_TO_OKLAB), named([f"cbrt({e})" for e in mat(k.XYZ_TO_LMS)], XYZ))
    add("xyz_to_oklab", chain(k.srgb_to_xyz, k.xyz_to_oklab), ok)
    back = named(mat(k.LMS_TO_XYZ), named([f"pow({e}, 3)" for e in mat(k.OKLAB_TO_LMS)], ok))
    add("oklab_to_xyz", chain(k.srgb_to_xyz, k.xyz_to_oklab, k.oklab_to_xyz), back)
    # The hue of a grey is the angle of rounding errors, so only lightness and chroma are compared.
    add("oklab_to_oklch", chain(k.srgb_to_xyz, k.xyz_to_oklab, k.oklab_to_oklch, lambda v: v[:2]), named(["a", "sqrt(b * b + c * c)"], ok), 2)
    add("oklch_to_oklab", chain(k.srgb_to_xyz, k.xyz_to_oklab, k.oklab_to_oklch, k.oklch_to_oklab), ok)
    h = "(SELECT y, x, a / 255.0e0 AS r, b / 255.0e0 AS g, c / 255.0e0 AS b, greatest(a, b, c) / 255.0e0 AS m, (greatest(a, b, c) / 255.0e0 - least(a, b, c) / 255.0e0) AS d FROM " + ABC + ")"
    hsv = f"(SELECT y, x, CASE WHEN d = 0 THEN 0 WHEN m = r THEN 60 * ((g - b) / d) + (CASE WHEN g < b THEN 360 ELSE 0 END) WHEN m = g THEN 60 * ((b - r) / d + 2) ELSE 60 * ((r - g) / d + 4) END AS a, CASE WHEN m = 0 THEN 0 ELSE d / m END AS b, m AS c FROM {h})"
    add("srgb_to_hsv", k.srgb_to_hsv, hsv)
    add("hsv_to_srgb", chain(k.srgb_to_hsv, k.hsv_to_srgb), ABC, exact=True)
    add("srgb_to_rgb16", k.srgb_to_rgb16, named([f"{v} * 257" for v in "abc"], ABC), exact=True)
    add("rgb16_to_srgb", chain(k.srgb_to_rgb16, k.rgb16_to_srgb), ABC, exact=True)
    cmyk = "(SELECT y, x, 1 - a / 255.0e0 AS a, 1 - b / 255.0e0 AS b, 1 - c / 255.0e0 AS c, least(1 - a / 255.0e0, 1 - b / 255.0e0, 1 - c / 255.0e0) AS k FROM " + ABC + ")"
    cm = named(["CASE WHEN k >= 1 THEN 0 ELSE (a - k) / (1 - k) END", "CASE WHEN k >= 1 THEN 0 ELSE (b - k) / (1 - k) END", "CASE WHEN k >= 1 THEN 0 ELSE (c - k) / (1 - k) END", "k"], cmyk)
    unit = lambda v: [x / 255.0 for x in v]
    add("rgb_to_cmyk", chain(unit, k.rgb_to_cmyk), cm, 4)
    add("cmyk_to_rgb", chain(unit, k.rgb_to_cmyk, k.cmyk_to_rgb), named([f"(1 - {v}) * (1 - d)" for v in "abc"], cm))
    add("cmyk_to_xyz", chain(unit, k.rgb_to_cmyk, k.cmyk_to_xyz), named([f"{w}e0 * (1 - ({v} * (1 - d) + d))" for v, w in zip("abc", (k.X0, k.Y0, k.Z0), strict=True)], cm))
    ink = named([f"1 - {v} / {w}e0" for v, w in zip("abc", (k.X0, k.Y0, k.Z0), strict=True)], XYZ)
    ink = f"(SELECT *, least(a, b, c) AS k FROM {ink})"
    add("xyz_to_cmyk", chain(k.srgb_to_xyz, k.xyz_to_cmyk), named([*[f"CASE WHEN 1 - k < 0.00001 THEN 1 ELSE ({v} - k) / (1 - k) END" for v in "abc"], "CASE WHEN 1 - k < 0.00001 THEN 1 ELSE k END"], ink), 4)
    c.image("bw_to_srgb", lambda sp, d: bands.colour(u8(sp, d), k.bw_to_srgb), f"SELECT y, x, band, v FROM {U8}, (VALUES (0), (1), (2)) t(band)", False, True)
    # Packed Lab. The inputs are whole or half numbers, so no rounding of the chain matters.
    lab = named(["a / 2.55e0", "(b - 128) / 1.5e0", "(c - 128) / 1.5e0"], ABC)
    flab = lambda v: [v[0] / 2.55, (v[1] - 128) / 1.5, (v[2] - 128) / 1.5]
    q = "(SELECT y, x, CAST(greatest(0, least(1023, round_even(a * 10.23e0, 0))) AS INT) AS l, CAST(greatest(-1024, least(1023, round_even(b * 8, 0))) AS INT) AS p, CAST(greatest(-1024, least(1023, round_even(c * 8, 0))) AS INT) AS q FROM " + lab + ")"
    labq = named(["l >> 2", "(p >> 3) & 255", "(q >> 3) & 255", "((l & 3) << 6) | ((p & 7) << 3) | (q & 7)"], q)
    add("lab_to_labq", chain(flab, k.lab_to_labq), labq, 4, True)
    add("labq_to_lab", chain(flab, k.lab_to_labq, k.labq_to_lab), f"(SELECT y, x, l * (100.0e0 / 1023) AS a, p * 0.125e0 AS b, q * 0.125e0 AS c FROM {q})")
    labs = named(["trunc(greatest(0, least(32767, a * (32767.0e0 / 100))))", "trunc(greatest(-32768, least(32767, b * 256)))", "trunc(greatest(-32768, least(32767, c * 256)))"], lab)
    add("lab_to_labs", chain(flab, k.lab_to_labs), labs, exact=True)
    add("labs_to_lab", chain(flab, k.lab_to_labs, k.labs_to_lab), named(["a / (32767.0e0 / 100)", "b / 256", "c / 256"], labs))
    add("labq_to_labs", chain(flab, k.lab_to_labq, k.labq_to_labs), f"(SELECT y, x, l << 5 AS a, CAST(p AS INT) * 32 AS b, CAST(q AS INT) * 32 AS c FROM {q})", exact=True)
    sl = "(SELECT y, x, CAST(greatest(0, least(32767, CAST(a AS INT) + 16)) AS INT) >> 5 AS l, CAST(greatest(-32768, least(32767, CAST(b AS INT) + CASE WHEN b >= 0 THEN 16 ELSE -16 END)) AS INT) >> 5 AS p, CAST(greatest(-32768, least(32767, CAST(c AS INT) + CASE WHEN c >= 0 THEN 16 ELSE -16 END)) AS INT) >> 5 AS q FROM " + labs + ")"
    add("labs_to_labq", chain(flab, k.lab_to_labs, k.labs_to_labq), named(["l >> 2", "(p >> 3) & 255", "(q >> 3) & 255", "((l & 3) << 6) | ((p & 7) << 3) | (q & 7)"], sl), 4, True)
    add("xyz_to_srgb", chain(unit, k.xyz_to_srgb), encoded(named(mat(k.XYZ_TO_RGB), named([f"{v} / 255.0e0" for v in "abc"], ABC))), exact=True)
    add("lab_to_srgb", chain(flab, k.lab_to_srgb), encoded(named(mat(k.XYZ_TO_RGB), lab_xyz(lab))), exact=True)
    add("labq_to_srgb", chain(flab, k.lab_to_labq, k.labq_to_srgb), encoded(named(mat(k.XYZ_TO_RGB), lab_xyz(f"(SELECT y, x, l * (100.0e0 / 1023) AS a, p * 0.125e0 AS b, q * 0.125e0 AS c FROM {q})"))), exact=True)
    add("srgb_lab_adjust", k.srgb_lab_adjust(0.9, 3.0), encoded(named(mat(k.XYZ_TO_RGB), lab_xyz(named([f"{v} * 0.9e0 + 3" for v in "abc"], LAB)))), exact=True)
    add("srgb_lab_roundtrip", k.srgb_lab_roundtrip, encoded(named(mat(k.XYZ_TO_RGB), lab_xyz(LAB))), exact=True)
    # log2 of exact powers of two may round differently between engines, hence the offset.
    rad = named([f"({v} + 0.3e0) / 100" for v in "abc"], ABC)
    frad = lambda v: [(x + 0.3) / 100 for x in v]
    e = f"(SELECT *, floor(log2(greatest(a, b, c))) + 1 AS e FROM {rad})"
    four = named([*[f"floor({v} * (255.9999e0 * pow(2.0e0, -e)))" for v in "abc"], "e + 128"], e)
    add("float_to_radiance", chain(frad, k.float_to_radiance), four, 4, True)
    add("radiance_to_float", chain(frad, k.float_to_radiance, k.radiance_to_float), named([f"({v} + 0.5e0) * pow(2.0e0, d - 136)" for v in "abc"], four))
    pq = [repr(v) + ("e0" if "e" not in repr(v) else "") for v in k.PQ]
    code = "({v} / 255.0e0)"
    tf = {
        "pq": f"pow(greatest(pow({code}, 1 / {pq[1]}) - {pq[2]}, 0) / ({pq[3]} - {pq[4]} * pow({code}, 1 / {pq[1]})), 1 / {pq[0]}) * (10000.0e0 / 203)".replace(pq[3] + " - " + pq[4], pq[3] + " - " + pq[4]),
        "hlg": f"CASE WHEN {code} <= 0.5 THEN {code} * {code} / 3 ELSE (exp(({code} - {k.HLG[2]}e0) / {k.HLG[0]}e0) + {k.HLG[1]}e0) / 12 END",
        "bt709": f"CASE WHEN {code} < 0.081 THEN {code} / 4.5 ELSE pow(({code} + 0.099) / 1.099, 1 / 0.45e0) END", "gamma22": f"pow({code}, 2.2e0)",
    }
    for name, expr in tf.items():
        add(f"cicp_to_scrgb_{name}", lambda v, n=name: [k.cicp_to_linear(x / 255.0, n) for x in v], named([expr.replace("{v}", v) for v in "abc"], ABC))
    add("uhdr_to_scrgb", chain(lambda v: [*k.srgb_to_scrgb(v), v[0] / 255.0], lambda v: k.uhdr_to_scrgb(v[:3], [v[3]], 0.0, 2.0, 1.2, 0.015625, 0.015625)), f"(SELECT l.y, l.x, " + ", ".join(f"(l.{v} + 0.015625) * pow(2.0e0, pow(o.a / 255, 1 / 1.2e0) * 2) - 0.015625 AS {v}" for v in "abc") + f" FROM {LIN} l JOIN {ABC} o USING (y, x))")
    # Differences to the colour with its bands turned.
    other = f"(SELECT p.y, p.x, p.a, p.b, p.c, q.a AS d, q.b AS e, q.c AS f FROM {LAB} p JOIN (SELECT y, x + 1 AS x, a, b, c FROM {LAB}) q USING (y, x))"

    def diff(f, polar=False):
        def build(sp, d):
            r = bands.colour(base(sp, d), chain(k.srgb_to_lab, k.lab_to_lch) if polar else k.srgb_to_lab)
            return bands.colour_difference(r, r.remap(F.col("y"), F.col("x") + 1), f)

        return build

    c.image("de76", diff(k.de76), f"SELECT y, x, sqrt((a - d) * (a - d) + (b - e) * (b - e) + (c - f) * (c - f)) AS v FROM {other}", True)
    c.image("decmc", diff(k.decmc, True), f"SELECT y, x, sqrt((a - d) * (a - d) + (b - e) * (b - e) + (c - f) * (c - f)) AS v FROM {other}", True)
    p = f"(SELECT *, pow((sqrt(b * b + c * c) + sqrt(e * e + f * f)) / 2, 7) AS m FROM {other})"
    p = f"(SELECT y, x, a, b * g AS b, c, d, e * g AS e, f FROM (SELECT *, 1.5e0 - 0.5e0 * sqrt(m / (m + 6103515625.0e0)) AS g FROM {p}))"
    p = f"(SELECT y, x, d - a AS dl, (a + d) / 2 AS lm, sqrt(b * b + c * c) AS c1, sqrt(e * e + f * f) AS c2, {HUE.format(a='b', b='c')} AS h1, {HUE.format(a='e', b='f')} AS h2 FROM {p})"
    p = f"""(SELECT *, (c1 + c2) / 2 AS cm, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
        CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm FROM {p})"""
    p = f"""(SELECT y, x, dl / (1 + 0.015e0 * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2))) AS u, (c2 - c1) / (1 + 0.045e0 * cm) AS v,
        2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015e0 * cm * (1 - 0.17e0 * cos(radians(hm - 30)) + 0.24e0 * cos(radians(2 * hm)) + 0.32e0 * cos(radians(3 * hm + 6)) - 0.2e0 * cos(radians(4 * hm - 63)))) AS w,
        -2 * sqrt(pow(cm, 7) / (pow(cm, 7) + 6103515625.0e0)) * sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) AS r FROM {p})"""
    c.image("de00", diff(k.de00), f"SELECT y, x, sqrt(u * u + v * v + w * w + r * v * w) AS v FROM {p}", True)
    add("colourspace_route", k.conversion("srgb", "oklab"), ok)
