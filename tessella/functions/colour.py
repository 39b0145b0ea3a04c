"""Colour conversions and differences as column expressions on bands.

Every function takes the bands of one pixel and gives the bands of the result. `route` finds
the shortest chain of conversions between two colour spaces."""

from __future__ import annotations

import json
from collections import deque
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .samples import round_away, trunc

Bands = list[Column]
# D65 white, the sRGB transfer function and primaries.
X0, Y0, Z0 = 0.95047, 1.0, 1.08883
RGB_TO_XYZ = [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]
XYZ_TO_RGB = [[3.240625, -1.537208, -0.498629], [-0.968931, 1.875756, 0.041518], [0.05571, -0.204021, 1.056996]]
XYZ_TO_LMS = [[0.818933, 0.36186674, -0.12885971], [0.032984544, 0.9293119, 0.03614564], [0.0482003, 0.26436627, 0.6338517]]
LMS_TO_OKLAB = [[0.21045426, 0.7936178, -0.004072047], [1.9779985, -2.4285922, 0.4505937], [0.025904037, 0.78277177, -0.80867577]]
OKLAB_TO_LMS = [[1.0, 0.39633778, 0.21580376], [1.0, -0.105561346, -0.06385417], [1.0, -0.08948418, -1.2914855]]
LMS_TO_XYZ = [[1.2270138, -0.55779994, 0.28125614], [-0.04058018, 1.1122569, -0.07167668], [-0.07638128, -0.42148197, 1.5861633]]


def chain(*functions):
    """The functions one after the other. Operators run each step as a projection of its
    own (`steps`), because a step refers to its inputs many times."""
    flat = [g for f in functions for g in steps(f)]

    def run(v: Bands) -> Bands:
        for f in flat:
            v = f(v)
        return v

    run.steps = flat
    return run


def steps(f) -> list:
    return getattr(f, "steps", [f])


def matrix(m: list[list[float]], v: Bands) -> Bands:
    return [sum((F.lit(k) * x for k, x in zip(row[1:], v[1:], strict=True)), F.lit(row[0]) * v[0]) for row in m]


def decode(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def encode(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)


def _encoded_step(i: Column) -> Column:
    """The 8-bit code of a linear value i / 255, for whole i."""
    return round_away(encode(i / 255.0) * 255.0)


def encode_u8(x: Column) -> Column:
    """Linear to 8 bits by interpolation between the codes of the 256 steps of linear light."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 255.0
    low = F.floor(at).cast("double")
    a, b = _encoded_step(low), _encoded_step(F.least(low + 1, F.lit(255.0)))
    return round_away((at - low) * (b - a) + a)


def srgb_to_scrgb(v: Bands) -> Bands:
    return [decode(x / 255.0) for x in v]


def scrgb_to_srgb(v: Bands) -> Bands:
    return [encode_u8(x) for x in v]


def scrgb_to_xyz(v: Bands) -> Bands:
    return matrix(RGB_TO_XYZ, v)


def xyz_to_scrgb(v: Bands) -> Bands:
    return matrix(XYZ_TO_RGB, v)


srgb_to_xyz = chain(srgb_to_scrgb, scrgb_to_xyz)


xyz_to_srgb = chain(xyz_to_scrgb, scrgb_to_srgb)


def scrgb_to_bw(v: Bands) -> Bands:
    return [F.lit(0.2126) * v[0] + F.lit(0.7152) * v[1] + F.lit(0.0722) * v[2]]


def bw_to_srgb(v: Bands) -> Bands:
    return [v[0], v[0], v[0]]


def _curve(x: Column) -> Column:
    return F.when(x < 0.008856, x * 7.787 + 16.0 / 116.0).otherwise(F.cbrt(x))


def xyz_to_lab(v: Bands) -> Bands:
    """In closed form; values at or over white saturate."""
    x, y, z = (_curve(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a / w))) for a, w in zip(v, (X0, Y0, Z0), strict=True))
    return [y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0]


def _uncurve(t: Column, white: float) -> Column:
    return F.when(t < 0.2069, (t - 0.13793) / 7.787 * white).otherwise(t * t * t * white)


def lab_to_xyz(v: Bands) -> Bands:
    light, a, b = v
    dark = light * Y0 / 903.3
    cby = F.when(light < 8.0, dark / Y0 * 7.787 + 16.0 / 116.0).otherwise((light + 16.0) / 116.0)
    y = F.when(light < 8.0, dark).otherwise(cby * cby * cby * Y0)
    return [_uncurve(a / 500.0 + cby, X0), y, _uncurve(cby - b / 200.0, Z0)]


srgb_to_lab = chain(srgb_to_xyz, xyz_to_lab)


lab_to_srgb = chain(lab_to_xyz, xyz_to_srgb)


def hue(a: Column, b: Column) -> Column:
    """Degrees, 0 to 360."""
    d = F.degrees(F.atan2(b, a))
    return F.when((a == 0) & (b == 0), F.lit(0.0)).when(d < 0, d + 360.0).otherwise(d)


def lab_to_lch(v: Bands) -> Bands:
    return [v[0], F.sqrt(v[1] * v[1] + v[2] * v[2]), hue(v[1], v[2])]


def lch_to_lab(v: Bands) -> Bands:
    return [v[0], v[1] * F.cos(F.radians(v[2])), v[1] * F.sin(F.radians(v[2]))]


# Fixed values of the CMC hue curve: upper hue, then k4 to k8.
HUE_CURVE = [(49.1, 133.87, -134.5, -0.924, 1.727, 340.0), (110.1, 11.78, -12.7, -0.218, 2.12, 333.0), (269.6, 13.87, 10.93, 0.14, 1.0, -83.0), (None, 0.14, 5.23, 0.17, 1.61, 233.0)]


def lch_to_ucs(v: Bands) -> Bands:
    light, chroma, h = v
    lu = F.when(light < 16.0, light * 1.744).otherwise(F.log(F.greatest(light, F.lit(1e-30))) * 21.75 + light * 0.3838 - 38.54)
    cu = F.greatest(F.lit(0.0), F.log(chroma * 0.07216 + 0.638) * 10.92 + chroma * 0.162 + 4.907)

    def turned(k4, k5, k6, k7, k8):
        p = F.cos(F.radians(h * k7 + k8))
        term = F.when(p == 0, F.lit(0.0)).otherwise(p * F.pow(F.abs(p), F.lit(k6)))
        c4 = chroma * chroma * chroma * chroma
        return h + (term * k5 + k4) * F.sqrt(c4 / (c4 + 1900.0))

    hu = turned(*HUE_CURVE[-1][1:])
    for top, *k in reversed(HUE_CURVE[:-1]):
        hu = F.when(h < top, turned(*k)).otherwise(hu)
    return [lu, cu, hu]


@cache
def _ucs_tables() -> tuple[str, str, str]:
    """Lightness and chroma at tenths of their UCS values, and hue at whole degrees for 101
    chromas two apart: the forward curves of `lch_to_ucs`, inverted between their points."""
    at = np.arange(3001) / 10.0
    light = np.where(at < 16.0, at * 1.744, np.log(np.maximum(at, 1e-30)) * 21.75 + at * 0.3838 - 38.54)[:1001]
    chroma = np.maximum(0.0, np.log(at * 0.07216 + 0.638) * 10.92 + at * 0.162 + 4.907)

    def inverted(curve: np.ndarray) -> list[float]:
        goal = at[: len(curve)]
        above = np.clip(np.searchsorted(curve, goal, "right"), 1, len(curve) - 1)
        low, rise = curve[above - 1], curve[above] - curve[above - 1]
        return ((above - 1 + np.divide(goal - low, rise, out=np.zeros_like(goal), where=rise != 0)) / 10.0).tolist()

    c, h = np.arange(101)[:, None] * 2.0, np.arange(361)[None, :] * 1.0
    k4, k5, k6, k7, k8 = (np.select([h < row[0] for row in HUE_CURVE[:-1]], [row[i] for row in HUE_CURVE[:-1]], HUE_CURVE[-1][i]) for i in range(1, 6))
    p = np.cos(np.radians(h * k7 + k8))
    hue = h + (k4 + k5 * p * np.maximum(np.abs(p), 1e-300) ** k6) * np.sqrt(c**4 / (c**4 + 1900.0))
    turns = []
    for row in hue:
        over = row[None, 1:360] > h.T
        k = np.where(over.any(axis=1), over.argmax(axis=1) + 1, 360)
        turns += (k - 1 + (h[0] - row[k - 1]) / (row[k] - row[k - 1])).tolist()
    return json.dumps(inverted(light)), json.dumps(inverted(chroma)), json.dumps(turns)


def _between(table: str, start: Column, v: Column, top: int) -> Column:
    """A table's value at v, by straight lines between whole places 0 to top (and on beyond)."""
    values = F.from_json(F.lit(table), "array<double>")
    k = F.greatest(F.lit(0), F.least(F.lit(top - 1), F.floor(v))).cast("int")
    low = F.get(values, start + k)
    return low + (F.get(values, start + k + 1) - low) * (v - k)


def _ucs_flat(v: Bands) -> Bands:
    light, chroma, _ = _ucs_tables()
    return [_between(light, F.lit(0), v[0] * 10, 1000), _between(chroma, F.lit(0), v[1] * 10, 3000), v[2]]


def _ucs_turned(v: Bands) -> Bands:
    row = F.greatest(F.lit(0), F.least(F.lit(99), ((v[1] + 1) / 2).cast("int")))
    return [v[0], v[1], _between(_ucs_tables()[2], row * 361, v[2], 360)]


ucs_to_lch = chain(_ucs_flat, _ucs_turned)


def xyz_to_yxy(v: Bands) -> Bands:
    total = v[0] + v[1] + v[2]
    safe = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return [v[1], F.when(total == 0, F.lit(0.0)).otherwise(v[0] / safe), F.when(total == 0, F.lit(0.0)).otherwise(v[1] / safe)]


def yxy_to_xyz(v: Bands) -> Bands:
    none = (v[1] == 0) | (v[2] == 0)
    safe = F.when(none, F.lit(1.0)).otherwise(v[2])
    return [F.when(none, F.lit(0.0)).otherwise(v[0] * v[1] / safe), v[0], F.when(none, F.lit(0.0)).otherwise(v[0] * (F.lit(1.0) - v[1] - v[2]) / safe)]


xyz_to_oklab = chain(lambda v: [F.cbrt(x) for x in matrix(XYZ_TO_LMS, v)], lambda v: matrix(LMS_TO_OKLAB, v))


oklab_to_xyz = chain(lambda v: matrix(OKLAB_TO_LMS, v), lambda v: matrix(LMS_TO_XYZ, [x * x * x for x in v]))


oklab_to_oklch, oklch_to_oklab = lab_to_lch, lch_to_lab


def srgb_to_hsv(v: Bands) -> Bands:
    r, g, b = (x / 255.0 for x in v)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    safe, full = F.when(d == 0, F.lit(1.0)).otherwise(d), F.when(top == 0, F.lit(1.0)).otherwise(top)
    red = (g - b) / safe * 60.0
    h = F.when(d == 0, F.lit(0.0)).when(top == r, F.when(red < 0, red + 360.0).otherwise(red)).when(top == g, ((b - r) / safe + 2.0) * 60.0).otherwise(((r - g) / safe + 4.0) * 60.0)
    return [h, F.when(top == 0, F.lit(0.0)).otherwise(d / full), top]


def hsv_to_srgb(v: Bands) -> Bands:
    h, s, x = v
    n = h / 60.0
    i, f = F.floor(n) % 6, n - F.floor(n)
    p, q, t = x * (F.lit(1.0) - s), x * (F.lit(1.0) - s * f), x * (F.lit(1.0) - s * (F.lit(1.0) - f))

    def pick(*cases):
        out = cases[5]
        for k in range(5):
            out = F.when(i == k, cases[k]).otherwise(out)
        return round_away(F.when(s == 0, x).otherwise(out) * 255.0)

    return [pick(x, q, p, p, t, x), pick(t, x, x, q, p, p), pick(p, p, t, x, x, q)]


def srgb_to_rgb16(v: Bands) -> Bands:
    return [x * 257 for x in v]


def rgb16_to_srgb(v: Bands) -> Bands:
    return [F.shiftright(x.cast("int"), 8) for x in v]


def cmyk_to_rgb(v: Bands) -> Bands:
    return [(F.lit(1.0) - x) * (F.lit(1.0) - v[3]) for x in v[:3]]


def rgb_to_cmyk(v: Bands) -> Bands:
    k = F.lit(1.0) - F.greatest(*v)
    rest = F.when(k >= 1.0, F.lit(1.0)).otherwise(F.lit(1.0) - k)
    return [*[F.when(k >= 1.0, F.lit(0.0)).otherwise((F.lit(1.0) - x - k) / rest) for x in v], k]


def cmyk_to_xyz(v: Bands) -> Bands:
    return [(F.lit(1.0) - (x * (F.lit(1.0) - v[3]) + v[3])) * w for x, w in zip(v[:3], (X0, Y0, Z0), strict=True)]


def xyz_to_cmyk(v: Bands) -> Bands:
    inks = [F.lit(1.0) - x / w for x, w in zip(v, (X0, Y0, Z0), strict=True)]
    k = F.least(*inks)
    rest = F.lit(1.0) - k
    black, safe = rest < 0.00001, F.when(rest < 0.00001, F.lit(1.0)).otherwise(rest)
    return [*[F.when(black, F.lit(1.0)).otherwise((x - k) / safe) for x in inks], F.when(black, F.lit(1.0)).otherwise(k)]


def _within(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def _byte(v: Column) -> Column:
    return v.bitwiseAND(F.lit(255))


def _signed(v: Column) -> Column:
    return F.when(v > 127, v - 256).otherwise(v)


def lab_to_labq(v: Bands) -> Bands:
    light = _within(F.rint(v[0] * 10.23), 0.0, 1023.0).cast("int")
    a, b = (_within(F.rint(x * 8.0), -1024.0, 1023.0).cast("int") for x in v[1:])
    low = F.shiftleft(light.bitwiseAND(F.lit(3)), 6).bitwiseOR(F.shiftleft(a.bitwiseAND(F.lit(7)), 3)).bitwiseOR(b.bitwiseAND(F.lit(7)))
    return [F.shiftright(light, 2), _byte(F.shiftright(a, 3)), _byte(F.shiftright(b, 3)), low]


def labq_to_lab(v: Bands) -> Bands:
    light, a, b, low = (x.cast("int") for x in v)
    light = F.shiftleft(light, 2).bitwiseOR(F.shiftright(low, 6))
    a = F.shiftleft(_signed(a), 3).bitwiseOR(F.shiftright(low, 3).bitwiseAND(F.lit(7)))
    b = F.shiftleft(_signed(b), 3).bitwiseOR(low.bitwiseAND(F.lit(7)))
    return [light * (100.0 / 1023.0), a * 0.125, b * 0.125]


def lab_to_labs(v: Bands) -> Bands:
    light = trunc(_within(v[0] * (32767.0 / 100.0), 0.0, 32767.0))
    return [light, *[trunc(_within(x * 256.0, -32768.0, 32767.0)) for x in v[1:]]]


def labs_to_lab(v: Bands) -> Bands:
    return [v[0] / (32767.0 / 100.0), v[1] / 256.0, v[2] / 256.0]


def labq_to_labs(v: Bands) -> Bands:
    light, a, b, low = (x.cast("int") for x in v)
    return [
        F.shiftleft(light, 7).bitwiseOR(F.shiftright(low.bitwiseAND(F.lit(0xC0)), 1)),
        F.shiftleft(_signed(a), 8).bitwiseOR(F.shiftleft(low.bitwiseAND(F.lit(0x38)), 2)),
        F.shiftleft(_signed(b), 8).bitwiseOR(F.shiftleft(low.bitwiseAND(F.lit(7)), 5)),
    ]


def labs_to_labq(v: Bands) -> Bands:
    light, a, b = (x.cast("int") for x in v)
    light = F.shiftright(_within(light + 16, 0, 32767).cast("int"), 5)
    a, b = (F.shiftright(_within(F.when(x >= 0, x + 16).otherwise(x - 16), -32768, 32767).cast("int"), 5) for x in (a, b))
    low = F.shiftleft(light, 6).bitwiseAND(F.lit(0xC0)).bitwiseOR(F.shiftleft(a, 3).bitwiseAND(F.lit(0x38))).bitwiseOR(b.bitwiseAND(F.lit(7)))
    return [_byte(F.shiftright(light, 2)), _byte(F.shiftright(a, 3)), _byte(F.shiftright(b, 3)), low]


labq_to_srgb = chain(labq_to_lab, lab_to_srgb)


def float_to_radiance(v: Bands) -> Bands:
    top = F.greatest(*v)
    dark, safe = top <= 1e-32, F.when(top <= 1e-32, F.lit(1.0)).otherwise(top)
    e = F.floor(F.log2(safe)) + 1
    scale = F.pow(F.lit(2.0), -e) * 255.9999
    return [*[F.when(dark | (x <= 0), F.lit(0)).otherwise(F.floor(x * scale)).cast("int") for x in v], F.when(dark, F.lit(0)).otherwise(e + 128).cast("int")]


def radiance_to_float(v: Bands) -> Bands:
    return [F.when(v[3] == 0, F.lit(0.0)).otherwise((x + 0.5) * F.pow(F.lit(2.0), v[3] - 136)) for x in v[:3]]


def srgb_lab_adjust(scale: float, offset: float):
    return chain(srgb_to_lab, lambda v: [x * scale + offset for x in v], lab_to_srgb)


srgb_lab_roundtrip = chain(srgb_to_lab, lab_to_srgb)


# ---------------------------------------------------------------- transfer functions of video

# Constants of the PQ and HLG transfer functions.
PQ = (2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32)
HLG = (0.17883277, 0.28466892, 0.55991073)


def cicp_to_linear(x: Column, transfer: str) -> Column:
    """A coded sample of 0 to 1 into linear light: pq, hlg, srgb, bt709, gamma22, gamma28, linear."""
    if transfer == "pq":
        m1, m2, c1, c2, c3 = PQ
        p = F.pow(x, F.lit(1 / m2))
        return F.pow(F.greatest(p - c1, F.lit(0.0)) / (F.lit(c2) - p * c3), F.lit(1 / m1)) * (10000.0 / 203.0)
    if transfer == "hlg":
        a, b, k = HLG
        return F.when(x <= 0.5, x * x / 3.0).otherwise((F.exp((x - k) / a) + b) / 12.0)
    if transfer == "bt709":
        return F.when(x < 0.081, x / 4.5).otherwise(F.pow((x + 0.099) / 1.099, F.lit(1 / 0.45)))
    if transfer == "srgb":
        return decode(x)
    return F.pow(x, F.lit({"gamma22": 2.2, "gamma28": 2.8, "linear": 1.0}[transfer]))


def uhdr_to_scrgb(base: Bands, gain: Bands, lo: float, hi: float, gamma: float, offset_base: float, offset_hdr: float, weight: float = 1.0) -> Bands:
    """Linear base bands boosted by a gain map of 0 to 1 (log2 gains from lo to hi)."""
    gain = gain if len(gain) > 1 else gain * 3
    return [(x + offset_base) * F.pow(F.lit(2.0), (F.pow(g, F.lit(1 / gamma)) * (hi - lo) + lo) * weight) - offset_hdr for x, g in zip(base, gain, strict=True)]


# ---------------------------------------------------------------- differences


# Each takes the six bands of two colours and gives one.


def de76(v: Bands) -> Bands:
    d = [x - y for x, y in zip(v[:3], v[3:], strict=True)]
    return [F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])]


#: Distance after polar coordinates (L, C, h) become rectangular.
decmc = chain(lambda v: [*lch_to_lab(v[:3]), *lch_to_lab(v[3:])], de76)


def _de00_chroma(v: Bands) -> Bands:
    mean = (F.sqrt(v[1] * v[1] + v[2] * v[2]) + F.sqrt(v[4] * v[4] + v[5] * v[5])) / 2
    return [*v, F.pow(mean, F.lit(7.0))]


def _de00_stretch(v: Bands) -> Bands:
    g = (F.lit(1.0) - F.sqrt(v[6] / (v[6] + 25.0**7))) * 0.5 + 1
    return [v[0], v[1] * g, v[2], v[3], v[4] * g, v[5]]


def _de00_polar(v: Bands) -> Bands:
    return [*lab_to_lch(v[:3]), *lab_to_lch(v[3:])]


def _de00_means(v: Bands) -> Bands:
    l1, c1, h1, l2, c2, h2 = v
    grey, raw, total = c1 * c2 == 0, h2 - h1, h1 + h2
    dh = F.when(grey, F.lit(0.0)).when(F.abs(raw) <= 180, raw).when(raw > 180, raw - 360).otherwise(raw + 360)
    hm = F.when(grey, total).when(F.abs(raw) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    return [l2 - l1, c2 - c1, F.sqrt(c1 * c2) * 2 * F.sin(F.radians(dh / 2)), (l1 + l2) / 2, (c1 + c2) / 2, hm]


def _de00_weights(v: Bands) -> Bands:
    dl, dc, dh, lm, cm, hm = v
    t = F.lit(1.0) - F.cos(F.radians(hm - 30)) * 0.17 + F.cos(F.radians(hm * 2)) * 0.24 + F.cos(F.radians(hm * 3 + 6)) * 0.32 - F.cos(F.radians(hm * 4 - 63)) * 0.2
    turn = F.exp(-(((hm - 275) / 25) * ((hm - 275) / 25))) * 30
    cm7 = F.pow(cm, F.lit(7.0))
    sl = (lm - 50) * (lm - 50) * 0.015 / F.sqrt((lm - 50) * (lm - 50) + 20) + 1
    rt = -F.sin(F.radians(turn * 2)) * F.sqrt(cm7 / (cm7 + 25.0**7)) * 2
    return [dl / sl, dc / (cm * 0.045 + 1), dh / (cm * t * 0.015 + 1), rt]


#: CIEDE2000.
de00 = chain(_de00_chroma, _de00_stretch, _de00_polar, _de00_means, _de00_weights, lambda v: [F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2] + v[3] * v[1] * v[2])])


# ---------------------------------------------------------------- routes

STEPS = {
    ("bw", "srgb"): bw_to_srgb, ("srgb", "scrgb"): srgb_to_scrgb, ("scrgb", "srgb"): scrgb_to_srgb, ("scrgb", "xyz"): scrgb_to_xyz, ("xyz", "scrgb"): xyz_to_scrgb,
    ("scrgb", "bw"): scrgb_to_bw, ("srgb", "hsv"): srgb_to_hsv, ("hsv", "srgb"): hsv_to_srgb, ("srgb", "rgb16"): srgb_to_rgb16, ("rgb16", "srgb"): rgb16_to_srgb,
    ("xyz", "lab"): xyz_to_lab, ("lab", "xyz"): lab_to_xyz, ("lab", "lch"): lab_to_lch, ("lch", "lab"): lch_to_lab, ("lch", "ucs"): lch_to_ucs, ("ucs", "lch"): ucs_to_lch,
    ("xyz", "yxy"): xyz_to_yxy, ("yxy", "xyz"): yxy_to_xyz, ("xyz", "oklab"): xyz_to_oklab, ("oklab", "xyz"): oklab_to_xyz, ("oklab", "oklch"): oklab_to_oklch,
    ("oklch", "oklab"): oklch_to_oklab, ("lab", "labq"): lab_to_labq, ("labq", "lab"): labq_to_lab, ("lab", "labs"): lab_to_labs, ("labs", "lab"): labs_to_lab,
    ("labq", "labs"): labq_to_labs, ("labs", "labq"): labs_to_labq, ("cmyk", "xyz"): cmyk_to_xyz, ("xyz", "cmyk"): xyz_to_cmyk,
}


def route(source: str, target: str) -> list[str]:
    """Colour spaces on the shortest way from one to the other, both ends included."""
    came, todo = {source: None}, deque([source])
    while todo and target not in came:
        here = todo.popleft()
        for a, b in STEPS:
            if a == here and b not in came:
                came[b] = here
                todo.append(b)
    if target not in came:
        raise ValueError(f"no conversion from {source} to {target}")
    way = [target]
    while came[way[-1]] is not None:
        way.append(came[way[-1]])
    return way[::-1]


def conversion(source: str, target: str):
    """The chain of conversions on the shortest way."""
    way = route(source, target)
    return chain(*[STEPS[step] for step in zip(way, way[1:], strict=False)])
