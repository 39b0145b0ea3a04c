"""Queries of the pixel-local operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import point as p
from ..functions import samples as s
from ..operators import bands
from .images import EMB, OTHER, RAMP, RGB, U8, Catalogue, emb, other, pos, ramp, rgb, u8

AWAY = "(CASE WHEN {v} < 0 THEN -floor(-({v}) + 0.5) ELSE floor({v} + 0.5) END)"
SAT = "greatest(0, least(255, {v}))"
PAIR = f"(SELECT a.y, a.x, a.v AS a, b.v AS b FROM {RAMP} a JOIN {OTHER} b USING (y, x))"


def away(v: str) -> str:
    return AWAY.format(v=v)


def sat(v: str) -> str:
    return SAT.format(v=v)


def register(c: Catalogue) -> None:
    # Typed arithmetic on 8 bits, 16 bits signed and reals.
    c.pixel("add", "u8", lambda v: s.add(v, 40, s.U8), sat("v + 40"))
    c.pixel("subtract", "u8", lambda v: s.subtract(v, 40, s.U8), sat("v - 40"))
    c.pixel("multiply", "u8", lambda v: s.multiply(v, 3, s.U8), sat("v * 3"))
    c.pixel("divide_by_constant", "u8", lambda v: s.divide(v, 7, s.U8), "v // 7")
    c.pixel("linear", "u8", lambda v: s.linear(v, 1.5, -20, s.U8), f"trunc({sat('v * 1.5e0 - 20')})")
    c.pixel("linear_real", "emb", lambda v: s.linear(v, 2, 1, s.F64), "v * 2 + 1", True)
    c.pixel("invert", "u8", lambda v: s.invert(v, s.U8), "255 - v")
    c.pixel("invert_signed", "i16", lambda v: s.invert(v, s.I16), "least(32767, -v)")
    c.pixel("invert_real", "emb", lambda v: s.invert(v, s.F64), "1 - v", True)
    c.pixel("abs", "i16", lambda v: s.absolute(v, s.I16), "least(32767, abs(v))")
    c.pixel("sign", "i16", lambda v: s.sign(v, s.I16), "sign(v)")
    c.pixel("round", "emb", lambda v: s.rint(v * 8), "round_even(v * 8, 0)", True)
    c.pixel("floor", "emb", lambda v: s.floor(v * 8), "floor(v * 8)", True)
    c.pixel("ceil", "emb", lambda v: s.ceil(v * 8), "ceil(v * 8)", True)
    c.pixel("clamp", "u8", lambda v: s.clamp(v, 50, 200, s.U8), "greatest(50, least(200, v))")
    c.pixel("power", "pos", lambda v: s.power(v, -0.5, s.F64), "CASE WHEN v = 0 THEN 0 ELSE pow(v, -0.5) END", True)
    c.pixel("sqrt", "pos", lambda v: s.sqrt(v), "sqrt(v)", True)
    c.pixel("exp", "emb", lambda v: s.exp(v), "exp(v)", True)
    c.pixel("log", "pos", lambda v: s.log(v), "CASE WHEN v = 0 THEN 0 ELSE ln(v) END", True)
    c.pixel("exp10", "emb", lambda v: s.exp10(v), "pow(10.0, v)", True)
    c.pixel("log10", "pos", lambda v: s.log10(v), "CASE WHEN v = 0 THEN 0 ELSE log10(v) END", True)
    c.pixel("sin", "u8", lambda v: s.sin(v.cast("double")), "sin(radians(CAST(v AS DOUBLE)))", True, s.F64)
    c.pixel("cos", "u8", lambda v: s.cos(v.cast("double")), "cos(radians(CAST(v AS DOUBLE)))", True, s.F64)
    c.pixel("tan", "pos", lambda v: s.tan(v * 80), "tan(radians(v * 80))", True)
    c.pixel("asin", "pos", s.asin, "degrees(asin(v))", True)
    c.pixel("acos", "pos", s.acos, "degrees(acos(v))", True)
    c.pixel("atan", "emb", s.atan, "degrees(atan(v))", True)

    # Two images.
    def two(name, f, sql, real=False, fmt=None):
        c.image(name, lambda spark, d: ramp(spark).zip(other(spark), f, fmt), f"SELECT y, x, {sql} AS v FROM {PAIR}", real)

    two("add_two_images", lambda a, b: s.add(a, b, s.U8), sat("a + b"))
    two("subtract_two_images", lambda a, b: s.subtract(a, b, s.U8), sat("a - b"))
    two("multiply_two_images", lambda a, b: s.multiply(a, b, s.U8), sat("a * b"))
    two("add_images", lambda a, b: s.add_images(a, b, s.U8), "a + b", fmt=s.U16)
    two("divide", lambda a, b: s.divide(a, b % 5, s.U8), "CASE WHEN b % 5 = 0 THEN 0 ELSE a // (b % 5) END")
    two("remainder", lambda a, b: s.remainder(a, b % 5, s.U8), "CASE WHEN b % 5 = 0 THEN 255 ELSE a % (b % 5) END")
    two("remainder_real", lambda a, b: s.remainder(a.cast("double") - 128, (b % 4) * 0.75, s.F64), "CASE WHEN b % 4 = 0 THEN -1 ELSE (a - 128.0) - (b % 4) * 0.75 * floor((a - 128.0) / ((b % 4) * 0.75)) END", True, s.F64)
    two("maxpair", F.greatest, "greatest(a, b)")
    two("minpair", F.least, "least(a, b)")
    two("math2_pow", lambda a, b: s.power(a / 255.0, b / 64.0, s.F64), "CASE WHEN a = 0 THEN 0 ELSE pow(a / 255.0, b / 64.0) END", True, s.F64)
    two("math2_wop", lambda a, b: s.wop(a / 64.0, b / 255.0, s.F64), "CASE WHEN b = 0 THEN 0 ELSE pow(b / 255.0, a / 64.0) END", True, s.F64)
    two("math2_atan2", lambda a, b: s.atan2(a - 128, b - 128), "CASE WHEN degrees(atan2(a - 128.0, b - 128.0)) < 0 THEN degrees(atan2(a - 128.0, b - 128.0)) + 360 ELSE degrees(atan2(a - 128.0, b - 128.0)) END", True, s.F64)

    # The point dialect.
    c.pixel("point_abs", "i16", lambda v: p.absolute(v, s.I16), "abs(v)")
    c.pixel("point_bool_and", "u8", lambda v: p.bool_and(v, 0x5A, s.U8), "v & 90")
    c.pixel("point_bool_or", "u8", lambda v: p.bool_or(v, 0x5A, s.U8), "v | 90")
    c.pixel("point_bool_xor", "u8", lambda v: p.bool_xor(v, 0x5A, s.U8), "xor(v, 90)")
    c.pixel("point_lshift", "u8", lambda v: p.lshift(v, 2, s.U8), "(v * 4) & 255")
    c.pixel("point_rshift", "u8", lambda v: p.rshift(v, 2, s.U8), "v // 4")
    c.pixel("point_clamp", "emb", lambda v: p.clamp(v, -0.1, 0.1, s.F64), "greatest(-0.1, least(0.1, v))", True)
    c.pixel("point_gamma", "u8", lambda v: p.gamma(v, 2.2, s.U8), "trunc(pow(v / 255.0, 2.2) * 255.0)")
    c.pixel("point_invert", "u8", lambda v: p.invert(v, s.U8), "255 - v")
    c.pixel("point_linear", "u8", lambda v: p.linear(v, 0.7, 3, s.U8), f"trunc({sat('v * 0.7e0 + 3')})")
    for name in ("sin", "cos", "tan", "atan", "exp"):
        c.pixel(f"point_{name}", "emb", lambda v, f=getattr(p, name): f(v, s.F64), f"{name}(v)", True)
    for name in ("asin", "acos", "sqrt"):
        c.pixel(f"point_{name}", "pos", lambda v, f=getattr(p, name): f(v, s.F64), f"{name}(v)", True)
    c.pixel("point_log", "pos", lambda v: p.log(v, s.F64), "CASE WHEN v = 0 THEN 0 ELSE ln(v) END", True)
    c.pixel("point_power", "pos", lambda v: p.power(v, 1.7, s.F64), "CASE WHEN v = 0 THEN 0 ELSE pow(v, 1.7) END", True)
    c.pixel("point_round", "emb", lambda v: p.round_(v * 8, s.F64), away("v * 8"), True)
    c.pixel("point_floor", "emb", lambda v: p.floor(v * 8, s.F64), "floor(v * 8)", True)
    c.pixel("point_ceil", "emb", lambda v: p.ceil(v * 8, s.F64), "ceil(v * 8)", True)
    c.pixel("point_sign", "emb", lambda v: p.sign(v, s.F64), "sign(v)", True)

    # Relational and boolean.
    for name, op in (("equal", "="), ("not_equal", "<>"), ("less", "<"), ("less_eq", "<="), ("more", ">"), ("more_eq", ">=")):
        c.pixel(name, "u8", lambda v, f=getattr(s, name): f(v, 128), f"CASE WHEN v {op} 128 THEN 255 ELSE 0 END", fmt=s.U8)
    c.pixel("bool_and", "i16", lambda v: s.bit_and(v, 0xFF0, s.I16), "v & 4080")
    c.pixel("bool_or", "i16", lambda v: s.bit_or(v, 0xF0, s.I16), "v | 240")
    c.pixel("bool_xor", "u8", lambda v: s.bit_xor(v, 0x3C, s.U8), "xor(v, 60)")
    c.pixel("lshift", "u8", lambda v: s.lshift(v, 3, s.U8), "(v * 8) & 255")
    c.pixel("rshift", "i16", lambda v: s.rshift(v, 3, s.I16), "floor(v / 8.0)")
    c.pixel("lshift_over", "u8", lambda v: s.lshift(v, 9, s.U8), "0")
    c.pixel("bool_and_real", "emb", lambda v: s.bit_and(v * 1000, 0xFFF, s.F64), "CAST(trunc(v * 1000) AS BIGINT) & 4095", fmt=s.I32)

    # Conversions of samples.
    c.pixel("cast_u8_to_float", "u8", lambda v: s.cast_sample(v, s.U8, s.F64), "v / 255.0", True, s.F64)
    c.pixel("cast_float_to_u8", "pos", lambda v: s.cast_sample(v * 1.2 - 0.1, s.F64, s.U8), f"floor({sat('(v * 1.2e0 - 0.1e0) * 255')} + 0.5)", fmt=s.U8)
    c.pixel("cast_u8_to_u16", "u8", lambda v: s.cast_sample(v, s.U8, s.U16), "v * 257", fmt=s.U16)
    c.pixel("byteswap", "i16", lambda v: s.byteswap(v, s.I16), "CASE WHEN w > 32767 THEN w - 65536 ELSE w END".replace("w", "(((v & 65535) % 256) * 256 + (v & 65535) // 256)"))
    c.pixel("msb", "i16", lambda v: s.msb(v, s.I16), "CAST(floor(v / 256.0) AS INT) + 128", fmt=s.U8)
    c.pixel("gamma", "u8", lambda v: s.gamma(v, 1 / 2.4, s.U8), "floor(pow(v / 255.0, 2.4) * 255.0 + 0.5)")
    lo_hi = f"(SELECT min(v) AS lo, max(v) AS hi FROM {EMB})"
    c.image("scale", lambda spark, d: bands.scale(emb(spark, d)), f"SELECT y, x, floor((v - lo) / (hi - lo) * 255 + 0.5) AS v FROM {EMB}, {lo_hi}")
    c.image("scale_log", lambda spark, d: bands.scale(u8(spark, d), 0.25), f"SELECT y, x, floor(log10(1 + pow(v, 0.25)) / log10(1 + pow(hi, 0.25)) * 255 + 0.5) AS v FROM {U8}, (SELECT max(v) AS hi FROM {U8})")

    # Bands.
    flat = f"SELECT y, x, 0 AS band, r AS v FROM {RGB} UNION ALL SELECT y, x, 1, g FROM {RGB} UNION ALL SELECT y, x, 2, b FROM {RGB}"
    c.image("bandfold", rgb, flat, band=True)
    c.image("bandunfold", lambda k, d: bands.bandunfold(rgb(k, d), 3), f"SELECT y, x * 3 + band AS x, v FROM ({flat})")
    c.image("bandjoin", lambda k, d: bands.bandjoin(ramp(k), other(k)), f"SELECT y, x, 0 AS band, v FROM {RAMP} UNION ALL SELECT y, x, 1, v FROM {OTHER}", band=True)
    c.image("arrayjoin", lambda k, d: bands.arrayjoin([ramp(k), other(k), ramp(k)]), f"SELECT y, x, 0 AS band, v FROM {RAMP} UNION ALL SELECT y, x, 1, v FROM {OTHER} UNION ALL SELECT y, x, 2, v FROM {RAMP}", band=True)
    c.image("bandsplit", lambda k, d: bands.bandsplit(rgb(k, d), 1), f"SELECT y, x, g AS v FROM {RGB}")
    c.image("extract_bands", lambda k, d: bands.extract_bands(rgb(k, d), 1, 2), f"SELECT y, x, band - 1 AS band, v FROM ({flat}) WHERE band > 0", band=True)
    c.image("addalpha", lambda k, d: bands.addalpha(ramp(k), 255), f"SELECT y, x, 0 AS band, v FROM {RAMP} UNION ALL SELECT y, x, 1, 255 FROM {RAMP}", band=True)
    c.image("sum_bands", lambda k, d: bands.sum_bands(rgb(k, d)), f"SELECT y, x, least(255, r + g + b) AS v FROM {RGB}")
    c.image("bandmean", lambda k, d: bands.bandmean(rgb(k, d)), f"SELECT y, x, floor((r + g + b) / 3.0 + 0.5) AS v FROM {RGB}")
    c.image("bandrank", lambda k, d: bands.bandrank(rgb(k, d)), f"SELECT y, x, r + g + b - greatest(r, g, b) - least(r, g, b) AS v FROM {RGB}")
    c.image("bandbool_and", lambda k, d: bands.bandbool(rgb(k, d), "and"), f"SELECT y, x, r & g & b AS v FROM {RGB}")
    c.image("bandbool_or", lambda k, d: bands.bandbool(rgb(k, d), "or"), f"SELECT y, x, r | g | b AS v FROM {RGB}")
    c.image("bandbool_eor", lambda k, d: bands.bandbool(rgb(k, d), "eor"), f"SELECT y, x, xor(xor(r, g), b) AS v FROM {RGB}")
    c.image("copy", lambda k, d: bands.copy(ramp(k), interpretation="bw"), RAMP)
    m = [[0.2, 0.5, 0.3], [1.0, -1.0, 0.25]]
    c.image("recomb", lambda k, d: bands.recomb(rgb(k, d), m), f"SELECT y, x, 0 AS band, 0.2 * r + 0.5 * g + 0.3 * b AS v FROM {RGB} UNION ALL SELECT y, x, 1, 1.0 * r - g + 0.25 * b FROM {RGB}", True, True)
    real = f"(SELECT a.y, a.x, a.v - 128.0 AS re, b.v - 128.0 AS im FROM {RAMP} a JOIN {OTHER} b USING (y, x))"

    def cplx(k):
        f = lambda v: v.cast("double") - 128.0
        return bands.complex_form(ramp(k).map(f, s.F64), other(k).map(f, s.F64))

    both = "SELECT y, x, 0 AS band, {a} AS v FROM {t} UNION ALL SELECT y, x, 1, {b} FROM {t}"
    c.image("complex_form", lambda k, d: cplx(k), both.format(a="re", b="im", t=real), True, True)
    c.image("complex_conj", lambda k, d: bands.complex_conj(cplx(k)), both.format(a="re", b="-im", t=real), True, True)
    c.image("complex_real", lambda k, d: bands.complex_part(cplx(k), False), f"SELECT y, x, re AS v FROM {real}", True)
    c.image("complex_imag", lambda k, d: bands.complex_part(cplx(k), True), f"SELECT y, x, im AS v FROM {real}", True)
    c.image("polar", lambda k, d: bands.polar(cplx(k)), both.format(a="sqrt(re * re + im * im)", b="atan2(im, re)", t=real), True, True)
    c.image("rect", lambda k, d: bands.rect(bands.polar(cplx(k))), both.format(a="re", b="im", t=real), True, True)

    # Look-ups.
    lut = [(i * 7 + 3) % 256 for i in range(200)]
    c.image("maplut", lambda k, d: bands.maplut(u8(k, d), lut, fmt=s.U8), f"SELECT y, x, (least(v, 199) * 7 + 3) % 256 AS v FROM {U8}")
    c.image("maplut_bands", lambda k, d: bands.maplut(ramp(k), [[i, 255 - i] for i in range(256)], fmt=s.U8), f"SELECT y, x, 0 AS band, v FROM {RAMP} UNION ALL SELECT y, x, 1, 255 - v FROM {RAMP}", band=True)
    idx = lambda k, n: other(k).map(lambda v: (v % n).cast("int"))
    pick = f"(SELECT a.y, a.x, a.v AS a, 255 - a.v AS c, b.v AS i FROM {RAMP} a JOIN {OTHER} b USING (y, x))"
    inv = lambda k: ramp(k).map(lambda v: s.invert(v, s.U8))
    c.image("case", lambda k, d: bands.case(idx(k, 4), [ramp(k), inv(k)]), f"SELECT y, x, CASE WHEN i % 4 = 0 THEN a ELSE c END AS v FROM {pick}")
    c.image("switch", lambda k, d: bands.switch(idx(k, 4), [ramp(k), inv(k)]), f"SELECT y, x, CASE WHEN i % 2 = 0 THEN a ELSE c END AS v FROM {pick}")
    c.image("ifthenelse", lambda k, d: bands.ifthenelse(idx(k, 3), ramp(k), inv(k)), f"SELECT y, x, CASE WHEN i % 3 <> 0 THEN a ELSE c END AS v FROM {pick}")
    ramps = "unnest([0, 1, 2]) AS band"
    stops = [(0, 0, 0), (0, 0, 255), (0, 255, 255), (255, 255, 0), (255, 0, 0), (255, 255, 255)]
    cases = " ".join(f"WHEN band = {b} AND least(4, v // 51) = {k} THEN floor({stops[k][b]} + {stops[k + 1][b] - stops[k][b]} * (v - {51 * k}) / 51.0 + 0.5)" for b in range(3) for k in range(5))
    c.image("falsecolour", lambda k, d: bands.falsecolour(u8(k, d)), f"SELECT y, x, band, CASE {cases} END AS v FROM (SELECT y, x, v, {ramps} FROM {U8})", band=True)

    # Alpha and blending.
    rgba = lambda k, d: bands.bandjoin(rgb(k, d), bands.bandsplit(rgb(k, d), 0))
    three = "SELECT y, x, 0 AS band, {f0} AS v FROM {t} UNION ALL SELECT y, x, 1, {f1} FROM {t} UNION ALL SELECT y, x, 2, {f2} FROM {t}"

    def each(expr: str, alpha: str | None = None) -> str:
        sql = three.format(t=RGB, **{f"f{i}": expr.replace("c", n) for i, n in enumerate("rgb")})
        return sql + (f" UNION ALL SELECT y, x, 3, {alpha} FROM {RGB}" if alpha else "")

    c.image("flatten", lambda k, d: bands.flatten(rgba(k, d), [10, 20, 30]), three.format(t=RGB, f0="(r * r + 10 * (255 - r)) // 255", f1="(g * r + 20 * (255 - r)) // 255", f2="(b * r + 30 * (255 - r)) // 255"), band=True)
    c.image("premultiply", lambda k, d: bands.premultiply(rgba(k, d)), each("floor(c * r / 255.0 + 0.5)".replace("r /", "R /")).replace("R /", "r /") + f" UNION ALL SELECT y, x, 3, r FROM {RGB}", band=True)
    un = "CASE WHEN R = 0 THEN 0 ELSE least(255, floor({c} * 255.0 / R + 0.5)) END"
    c.image("unpremultiply", lambda k, d: bands.unpremultiply(rgba(k, d)), three.format(t=RGB, **{f"f{i}": un.format(c=n).replace("R", "r") for i, n in enumerate("rgb")}) + f" UNION ALL SELECT y, x, 3, r FROM {RGB}", band=True)
    # Two-band images (grey, alpha) for the blend modes: base (a, b), overlay (255 - a, b / 2).
    quad = f"(SELECT a.y, a.x, a.v / 255.0 AS b, b.v / 255.0 AS ab, (255 - a.v) / 255.0 AS t, (b.v // 2) / 255.0 AS ta FROM {RAMP} a JOIN {OTHER} b USING (y, x))"
    base = lambda k: bands.bandjoin(ramp(k), other(k))
    over = lambda k: bands.bandjoin(inv(k), other(k).map(lambda v: F.shiftright(v, 1)))
    duff = {
        "clear": ("0", "0"), "source": ("1", "0"), "over": ("1", "1 - ta"), "in": ("ab", "0"), "out": ("1 - ab", "0"), "atop": ("ab", "1 - ta"), "dest": ("0", "1"), "dest-over": ("1 - ab", "1"),
        "dest-in": ("0", "ta"), "dest-out": ("0", "1 - ta"), "dest-atop": ("1 - ab", "ta"), "xor": ("1 - ab", "1 - ta"), "add": ("1", "1"), "saturate": ("least(1, (1 - ab) / (CASE WHEN ta = 0 THEN 1 ELSE ta END))", "1"),
    }
    mixes = {
        "multiply": "b * t", "screen": "b + t - b * t", "overlay": "CASE WHEN b <= 0.5 THEN 2 * b * t ELSE 1 - 2 * (1 - b) * (1 - t) END", "darken": "least(b, t)", "lighten": "greatest(b, t)",
        "colour-dodge": "CASE WHEN b = 0 THEN 0 WHEN t >= 1 THEN 1 ELSE least(1, b / (1 - t)) END", "colour-burn": "CASE WHEN b >= 1 THEN 1 WHEN t <= 0 THEN 0 ELSE 1 - least(1, (1 - b) / t) END",
        "hard-light": "CASE WHEN t <= 0.5 THEN 2 * b * t ELSE 1 - 2 * (1 - b) * (1 - t) END",
        "soft-light": "CASE WHEN t <= 0.5 THEN b - (1 - 2 * t) * b * (1 - b) ELSE b + (2 * t - 1) * ((CASE WHEN b <= 0.25 THEN ((16 * b - 12) * b + 4) * b ELSE sqrt(b) END) - b) END",
        "difference": "abs(b - t)", "exclusion": "b + t - 2 * b * t",
    }
    tail = "SELECT y, x, 0 AS band, floor(least(1, CASE WHEN al = 0 THEN 0 ELSE c / al END) * 255 + 0.5) AS v FROM q UNION ALL SELECT y, x, 1, floor(al * 255 + 0.5) FROM q"
    # Modes of whole colours: the base is (r, g, b) with alpha r, the overlay its negative with alpha g.
    lum = lambda n: f"(0.3e0 * {n}0 + 0.59e0 * {n}1 + 0.11e0 * {n}2)"
    ends = lambda n: ", ".join(f"{n}{i}" for i in range(3))
    three_of = lambda e, n: ", ".join(e.replace("#", str(i)) + f" AS {n}{i}" for i in range(3))

    def whole_blend(mode: str) -> str:
        colour = {"hue": "CASE WHEN st = 0 THEN 0 ELSE (t# - nt) / st * sb END", "saturation": "CASE WHEN sb = 0 THEN 0 ELSE (b# - nb) / sb * st END", "colour": "t#", "luminosity": "b#"}[mode]
        q = f"(SELECT y, x, r / 255.0e0 AS b0, g / 255.0e0 AS b1, b / 255.0e0 AS b2, (255 - r) / 255.0e0 AS t0, (255 - g) / 255.0e0 AS t1, (255 - b) / 255.0e0 AS t2, r / 255.0e0 AS ab, g / 255.0e0 AS ta FROM {RGB})"
        q = f"(SELECT *, least({ends('b')}) AS nb, least({ends('t')}) AS nt, greatest({ends('b')}) - least({ends('b')}) AS sb, greatest({ends('t')}) - least({ends('t')}) AS st FROM {q})"
        q = f"(SELECT *, {three_of(colour, 'c')} FROM {q})"
        q = f"(SELECT *, {three_of(f'c# + ({lum(dict(luminosity=chr(116)).get(mode, chr(98)))} - {lum(chr(99))})', 's')} FROM {q})"
        q = f"(SELECT *, {lum('s')} AS l, least({ends('s')}) AS low, greatest({ends('s')}) AS top FROM {q})"
        q = f"(SELECT *, {three_of('CASE WHEN low < 0 THEN l + (s# - l) * l / (l - low) ELSE s# END', 'n')} FROM {q})"
        q = f"(SELECT *, ta + ab - ta * ab AS al, {three_of('CASE WHEN top > 1 THEN l + (n# - l) * (1 - l) / (top - l) ELSE n# END', 'm')} FROM {q})"
        one = "SELECT y, x, # AS band, greatest(0, least(255, floor(CASE WHEN al = 0 THEN 0 ELSE ((1 - ab) * ta * t# + (1 - ta) * ab * b# + ta * ab * m#) / al END * 255 + 0.5))) AS v FROM q"
        return f"WITH q AS {q} " + " UNION ALL ".join(one.replace("#", str(i)) for i in range(3)) + " UNION ALL SELECT y, x, 3, floor(al * 255 + 0.5) FROM q"

    for mode in bands.MODES:
        name = f"composite_{mode.replace('-', '_')}"
        if mode in duff:
            fa, fb = duff[mode]
            sql = f"WITH q AS (SELECT y, x, least(1, ta * ({fa}) + ab * ({fb})) AS al, t * ta * ({fa}) + b * ab * ({fb}) AS c FROM {quad}) {tail}"
        elif mode in mixes:
            sql = f"WITH q AS (SELECT y, x, ta + ab - ta * ab AS al, (1 - ab) * ta * t + (1 - ta) * ab * b + ta * ab * ({mixes[mode]}) AS c FROM {quad}) {tail}"
        else:
            c.image(name, lambda k, d, m=mode: bands.composite(rgba(k, d), bands.bandjoin(rgb(k, d).map(lambda v: s.invert(v, s.U8)), bands.bandsplit(rgb(k, d), 1)), m), whole_blend(mode), band=True)
            continue
        c.image(name, lambda k, d, m=mode: bands.composite(base(k), over(k), m), sql, band=True)
