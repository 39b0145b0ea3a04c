"""Band reshaping, look-ups and compositing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import samples as s
from ..raster import Raster


def bandjoin(a: Raster, b: Raster) -> Raster:
    return a.with_df(a.df.unionByName(b.df.withColumn("band", F.col("band") + a.bands)), bands=a.bands + b.bands)


def arrayjoin(images: list[Raster]) -> Raster:
    """Joins bands, not places."""
    out = images[0]
    for i in images[1:]:
        out = bandjoin(out, i)
    return out


def extract_bands(r: Raster, start: int, count: int = 1) -> Raster:
    return r.with_df(r.df.where(F.col("band").between(start, start + count - 1)).withColumn("band", F.col("band") - start), bands=count)


def bandsplit(r: Raster, k: int) -> Raster:
    return extract_bands(r, k, 1)


def addalpha(r: Raster, alpha: float) -> Raster:
    more = r.df.where("band = 0").withColumns({"band": F.lit(r.bands), "v": F.lit(alpha).cast(r.df.schema["v"].dataType)})
    return r.with_df(r.df.unionByName(more), bands=r.bands + 1)


def _folded(r: Raster, agg: Column, fmt=None) -> Raster:
    return r.with_df(r.df.groupBy(*r.pixel).agg(agg.alias("v")).withColumn("band", F.lit(0)), bands=1, fmt=fmt or r.fmt)


def sum_bands(r: Raster) -> Raster:
    return _folded(r, s.sat(F.sum(s.wide(F.col("v"), r.fmt)), r.fmt))


def bandmean(r: Raster) -> Raster:
    return _folded(r, s.from_double(F.avg("v"), r.fmt))


def bandrank(r: Raster, k: int | None = None) -> Raster:
    """The k-th smallest band; the middle one by default."""
    k = r.bands // 2 if k is None else k
    return _folded(r, F.array_sort(F.collect_list("v"))[k])


def bandbool(r: Raster, op: str) -> Raster:
    fold = {"and": F.bit_and, "or": F.bit_or, "eor": F.bit_xor}[op]
    fmt = r.fmt if r.fmt.integral else s.I32
    return _folded(r, fold(s.truncated(F.col("v"), s.I32).cast("bigint") if not r.fmt.integral else F.col("v").cast("bigint")).cast(fmt.stored), fmt)


def bandfold(r: Raster, factor: int) -> Raster:
    df = r.df.withColumn("band", F.col("band") + (F.col("x") % factor) * r.bands).withColumn("x", F.expr(f"cast(x div {factor} as int)"))
    return r.with_df(df, width=r.width // factor, bands=r.bands * factor)


def bandunfold(r: Raster, factor: int) -> Raster:
    n = r.bands // factor
    df = r.df.withColumn("x", F.col("x") * factor + F.expr(f"cast(band div {n} as int)")).withColumn("band", F.col("band") % n)
    return r.with_df(df, width=r.width * factor, bands=n)


def copy(r: Raster, **overrides) -> Raster:
    """The same samples with other metadata."""
    return r.with_df(r.df, meta={**r.meta, **overrides})


def cast(r: Raster, to: s.Format) -> Raster:
    return r.map(lambda v: s.cast_sample(v, r.fmt, to), to)


def recomb(r: Raster, matrix: list[list[float]]) -> Raster:
    """Each output band is a weighted sum of the input bands; the weights are a literal."""
    rows = F.array(*[F.array(*map(F.lit, map(float, m))) for m in zip(*matrix, strict=True)])
    out = r.df.select(*r.at, "v", F.posexplode(F.get(rows, F.col("band"))).alias("to", "w"))
    out = out.groupBy(*r.pixel, F.col("to").alias("band")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return r.with_df(out, bands=len(matrix), fmt=s.F64)


def complex_form(re: Raster, im: Raster) -> Raster:
    return re.with_df(re.df.withColumn("band", F.col("band") * 2).unionByName(im.df.withColumn("band", F.col("band") * 2 + 1)), bands=re.bands * 2)


def complex_conj(r: Raster) -> Raster:
    return r.with_df(r.df.withColumn("v", F.when(F.col("band") % 2 == 1, -F.col("v")).otherwise(F.col("v"))))


def complex_part(r: Raster, imaginary: bool) -> Raster:
    df = r.df.where(F.col("band") % 2 == int(imaginary)).withColumn("band", F.expr("cast(band div 2 as int)"))
    return r.with_df(df, bands=r.bands // 2)


def _pairs(r: Raster, f) -> Raster:
    w = r.df.groupBy(*r.pixel, F.expr("cast(band div 2 as int)").alias("p")).agg(F.max(F.when(F.col("band") % 2 == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("band") % 2 == 1, F.col("v"))).alias("b"))
    out = w.select(*r.pixel, "p", F.posexplode(F.array(*f(F.col("a"), F.col("b")))).alias("i", "v")).withColumn("band", F.col("p") * 2 + F.col("i"))
    return r.with_df(out)


def polar(r: Raster) -> Raster:
    """Real and imaginary part to modulus and angle in radians."""
    return _pairs(r, lambda a, b: (F.hypot(a, b), F.atan2(b, a)))


def rect(r: Raster) -> Raster:
    return _pairs(r, lambda m, t: (m * F.cos(t), m * F.sin(t)))


# ---------------------------------------------------------------- look-ups


def maplut(r: Raster, lut: list[list[float]] | list[float], selected: int | None = None, fmt: s.Format = s.F64) -> Raster:
    """Samples index a table (rows: index, columns: bands of the table), clipped to its ends.
    One table band serves all bands; one image band with n table bands gives n bands."""
    table = [x if isinstance(x, list) else [x] for x in lut]
    n = len(table[0])
    columns = [F.array(*[F.lit(row[b]) for row in table]) for b in range(n)]
    at = F.greatest(F.lit(0), F.least(F.lit(len(table) - 1), F.col("v").cast("int")))
    if n == 1 or selected is not None:
        got = columns[0][at]
        v = got if selected is None else F.when(F.col("band") == selected, got).otherwise(F.col("v"))
        return r.with_df(r.df.withColumn("v", v), fmt=fmt)
    if r.bands == 1:
        return r.with_df(r.df.select(*r.pixel, F.posexplode(F.array(*[x[at] for x in columns])).alias("band", "v")), bands=n, fmt=fmt)
    return r.with_df(r.df.withColumn("v", F.array(*columns)[F.col("band")][at]), fmt=fmt)


def _choose(index: Raster, images: list[Raster], pick: Column) -> Raster:
    df = index.df.where("band = 0").select(*index.pixel, pick.alias("__i"))
    n = max(i.bands for i in images)
    for k, image in enumerate(images):
        part = image.df.withColumnRenamed("v", f"__{k}")
        if image.bands < n:
            part = part.drop("band").withColumn("band", F.explode(F.array(*map(F.lit, range(n)))))
        df = df.join(part, index.pixel if k == 0 else [*index.pixel, "band"])
    return index.with_df(df.withColumn("v", F.array(*[F.col(f"__{k}") for k in range(len(images))])[F.col("__i")]), bands=n, fmt=images[0].fmt)


def case(index: Raster, images: list[Raster]) -> Raster:
    """The index is clipped to the last image."""
    return _choose(index, images, F.least(F.col("v"), F.lit(len(images) - 1)).cast("int"))


def switch(index: Raster, images: list[Raster]) -> Raster:
    """The index counts modulo the number of images."""
    return _choose(index, images, (F.col("v") % len(images)).cast("int"))


def ifthenelse(mask: Raster, yes: Raster, no: Raster) -> Raster:
    return _choose(mask, [no, yes], F.when(F.col("v") != 0, 1).otherwise(0))


# ---------------------------------------------------------------- alpha


def _wide_map(r: Raster, f, bands: int | None = None, fmt=None) -> Raster:
    """f gets the list of a pixel's bands and gives the list of the result's."""
    out = f([F.col(f"b{i}") for i in range(r.bands)])
    cells = F.posexplode(F.array(*out)).alias("band", "v")
    return r.with_df(r.wide().select(*r.pixel, cells), bands=bands or len(out), fmt=fmt or r.fmt)


def _steps(df, keep: list[str], v: list[Column], f):
    """The steps of a chain, each a projection."""
    from ..functions.colour import steps

    for i, g in enumerate(steps(f)):
        out = g(v)
        df = df.select(*keep, *[x.cast("double").alias(f"__{i}_{j}") for j, x in enumerate(out)])
        v = [F.col(f"__{i}_{j}") for j in range(len(out))]
    return df, v


def colour(r: Raster, f, fmt=None) -> Raster:
    """A function (or chain) of tessella.functions.colour on each pixel."""
    df, v = _steps(r.wide(), r.pixel, [F.col(f"b{i}") for i in range(r.bands)], f)
    return r.with_df(df.select(*r.pixel, F.posexplode(F.array(*v)).alias("band", "v")), bands=len(v), fmt=fmt or s.F64)


def colour_difference(a: Raster, b: Raster, f) -> Raster:
    """A function of the bands of two images, those of `a` first."""
    right = b.wide().withColumnsRenamed({f"b{i}": f"c{i}" for i in range(b.bands)})
    both = a.wide().join(right, a.pixel)
    df, v = _steps(both, a.pixel, [*[F.col(f"b{i}") for i in range(a.bands)], *[F.col(f"c{i}") for i in range(b.bands)]], f)
    return a.with_df(df.select(*a.pixel, F.lit(0).alias("band"), v[0].alias("v")), bands=1, fmt=s.F64)


def flatten(r: Raster, background: list[int]) -> Raster:
    """Alpha over a background, for 2 or 4 bands of 8 bits; others pass."""
    if r.bands not in (2, 4):
        return r
    n = r.bands - 1

    def f(b):
        a = b[n].cast("int")
        return [F.expr("0").cast("int") + F.floor((x.cast("int") * a + F.lit(background[i]) * (F.lit(255) - a)) / 255).cast("int") for i, x in enumerate(b[:n])]

    return _wide_map(r, f)


def premultiply(r: Raster, max_alpha: float = 255.0) -> Raster:
    n = r.bands - 1
    return _wide_map(r, lambda b: [*[s.from_double(x * b[n] / max_alpha, r.fmt) for x in b[:n]], b[n]])


def unpremultiply(r: Raster, max_alpha: float = 255.0) -> Raster:
    n = r.bands - 1

    def f(b):
        a = b[n].cast("double")
        safe = F.when(a == 0, F.lit(1.0)).otherwise(a)
        return [*[F.when(a == 0, F.lit(0)).otherwise(s.from_double(x * max_alpha / safe, r.fmt)) for x in b[:n]], b[n]]

    return _wide_map(r, f)


def scale(r: Raster, exponent: float | None = None) -> Raster:
    """To 8 bits by the least and greatest sample: linear, or logarithmic with an exponent.
    The two statistics are one aggregated row per image, joined back to it."""
    stats = r.df.groupBy(*r.keys).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    df = r.df.join(F.broadcast(stats), list(r.keys)) if r.keys else r.df.join(F.broadcast(stats), F.lit(True))
    v, lo, hi = F.col("v").cast("double"), F.col("__lo").cast("double"), F.col("__hi").cast("double")
    if exponent is None:
        x = (v - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
        flat = hi == lo
    else:
        top = F.log10(F.pow(hi, F.lit(exponent)) + 1)
        x = F.log10(F.pow(v, F.lit(exponent)) + 1) / F.when(top == 0, F.lit(1.0)).otherwise(top)
        flat = top == 0
    return r.with_df(df.withColumn("v", F.when(flat, F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 255 + 0.5)).cast("int")), fmt=s.U8)


# ---------------------------------------------------------------- blending


def _lum(c):
    return c[0] * 0.3 + c[1] * 0.59 + c[2] * 0.11


def _staged(df, stage: str, values: list[Column]):
    """The values as columns of a projection of their own, so that later expressions refer to
    them by name instead of growing by repetition."""
    names = [f"__{stage}{i}" for i in range(len(values))]
    return df.select("*", *[v.alias(n) for v, n in zip(values, names, strict=True)]), [F.col(n) for n in names]


def _set_lum(df, c, lum):
    df, c = _staged(df, "a", c)
    df, d = _staged(df, "d", [lum - _lum(c)])
    df, c = _staged(df, "s", [x + d[0] for x in c])
    df, (lum, low, top) = _staged(df, "l", [_lum(c), F.least(*c), F.greatest(*c)])
    df, c = _staged(df, "n", [F.when(low < 0, lum + (x - lum) * lum / F.when(lum == low, F.lit(1.0)).otherwise(lum - low)).otherwise(x) for x in c])
    return _staged(df, "x", [F.when(top > 1, lum + (x - lum) * (F.lit(1.0) - lum) / F.when(top == lum, F.lit(1.0)).otherwise(top - lum)).otherwise(x) for x in c])


def _sat(c):
    return F.greatest(*c) - F.least(*c)


def _set_sat(c, sat):
    low, span = F.least(*c), F.greatest(*c) - F.least(*c)
    safe = F.when(span == 0, F.lit(1.0)).otherwise(span)
    return [F.when(span == 0, F.lit(0.0)).otherwise((x - low) / safe * sat) for x in c]


def _soft(b, t):
    d = F.when(b <= 0.25, ((b * 16 - 12) * b + 4) * b).otherwise(F.sqrt(b))
    return F.when(t <= 0.5, b - (F.lit(1.0) - t * 2) * b * (F.lit(1.0) - b)).otherwise(b + (t * 2 - 1) * (d - b))


def _guard(x):
    return F.when(x == 0, F.lit(1.0)).otherwise(x)


#: Coefficients of Porter and Duff: shares of the overlay and of the base, by their alphas.
PORTER_DUFF = {
    "clear": lambda a, b: (F.lit(0.0), F.lit(0.0)), "source": lambda a, b: (F.lit(1.0), F.lit(0.0)), "over": lambda a, b: (F.lit(1.0), F.lit(1.0) - a),
    "in": lambda a, b: (b, F.lit(0.0)), "out": lambda a, b: (F.lit(1.0) - b, F.lit(0.0)), "atop": lambda a, b: (b, F.lit(1.0) - a),
    "dest": lambda a, b: (F.lit(0.0), F.lit(1.0)), "dest-over": lambda a, b: (F.lit(1.0) - b, F.lit(1.0)), "dest-in": lambda a, b: (F.lit(0.0), a),
    "dest-out": lambda a, b: (F.lit(0.0), F.lit(1.0) - a), "dest-atop": lambda a, b: (F.lit(1.0) - b, a), "xor": lambda a, b: (F.lit(1.0) - b, F.lit(1.0) - a),
    "add": lambda a, b: (F.lit(1.0), F.lit(1.0)), "saturate": lambda a, b: (F.least(F.lit(1.0), (F.lit(1.0) - b) / _guard(a)), F.lit(1.0)),
}
#: Separable modes: of the base's and the overlay's straight colour.
SEPARABLE = {
    "multiply": lambda b, t: b * t, "screen": lambda b, t: b + t - b * t, "overlay": lambda b, t: F.when(b <= 0.5, b * t * 2).otherwise(F.lit(1.0) - (F.lit(1.0) - b) * (F.lit(1.0) - t) * 2),
    "darken": F.least, "lighten": F.greatest, "colour-dodge": lambda b, t: F.when(b == 0, F.lit(0.0)).when(t >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), b / _guard(F.lit(1.0) - t))),
    "colour-burn": lambda b, t: F.when(b >= 1, F.lit(1.0)).when(t <= 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.least(F.lit(1.0), (F.lit(1.0) - b) / _guard(t))),
    "hard-light": lambda b, t: F.when(t <= 0.5, b * t * 2).otherwise(F.lit(1.0) - (F.lit(1.0) - b) * (F.lit(1.0) - t) * 2), "soft-light": _soft,
    "difference": lambda b, t: F.abs(b - t), "exclusion": lambda b, t: b + t - b * t * 2,
}
#: Modes of all three colours at once: the colour whose luminosity is then set, and from whom.
NONSEPARABLE = {
    "hue": lambda b, t: (_set_sat(t, _sat(b)), _lum(b)), "saturation": lambda b, t: (_set_sat(b, _sat(t)), _lum(b)),
    "colour": lambda b, t: (t, _lum(b)), "luminosity": lambda b, t: (b, _lum(t)),
}
MODES = [*PORTER_DUFF, *SEPARABLE, *NONSEPARABLE]


def blend(base: list[Column], top: list[Column], mode: str) -> list[Column]:
    """Straight colours and alpha in 0 to 1, alpha last; gives the same."""
    b, ab, t, at = base[:-1], base[-1], top[:-1], top[-1]
    if mode in PORTER_DUFF:
        fa, fb = PORTER_DUFF[mode](at, ab)
        alpha = F.least(F.lit(1.0), at * fa + ab * fb)
        colours = [(x * at * fa + y * ab * fb) / _guard(alpha) for x, y in zip(t, b, strict=True)]
        return [*[F.when(alpha == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), x)) for x in colours], alpha]
    return _mixed(base, top, [SEPARABLE[mode](y, x) for x, y in zip(t, b, strict=True)])


def _mixed(base: list[Column], top: list[Column], mixed: list[Column]) -> list[Column]:
    b, ab, t, at = base[:-1], base[-1], top[:-1], top[-1]
    alpha = at + ab - at * ab
    colours = [((F.lit(1.0) - ab) * at * x + (F.lit(1.0) - at) * ab * y + at * ab * m) / _guard(alpha) for x, y, m in zip(t, b, mixed, strict=True)]
    return [*[F.when(alpha == 0, F.lit(0.0)).otherwise(x) for x in colours], alpha]


def composite(base: Raster, overlay: Raster, mode: str = "over", unit: float = 255.0) -> Raster:
    if mode in NONSEPARABLE and base.bands != 4:
        raise ValueError(f"{mode} needs three colours and alpha")
    n = base.bands
    right = overlay.wide().withColumnsRenamed({f"b{i}": f"t{i}" for i in range(n)})
    both = base.wide().join(right, base.pixel)
    b, t = [F.col(f"b{i}") / unit for i in range(n)], [F.col(f"t{i}") / unit for i in range(n)]
    if mode in NONSEPARABLE:
        both, parts = _staged(both, "u", [*b, *t])
        b, t = parts[:n], parts[n:]
        both, mixed = _set_lum(both, *NONSEPARABLE[mode](b[:3], t[:3]))
        out = _mixed(b, t, mixed)
    else:
        out = blend(b, t, mode)
    return base.with_df(both.select(*base.pixel, F.posexplode(F.array(*[s.from_double(x * unit, base.fmt) for x in out])).alias("band", "v")))


def falsecolour_table() -> list[list[int]]:
    """A 256 x 3 heat table: a rule of five straight ramps through black, blue, cyan, yellow, red and white."""
    stops = [(0, 0, 0), (0, 0, 255), (0, 255, 255), (255, 255, 0), (255, 0, 0), (255, 255, 255)]
    out = []
    for i in range(256):
        k, f = min(4, i // 51), (i - min(4, i // 51) * 51) / 51
        out.append([int(a + (b - a) * f + 0.5) for a, b in zip(stops[k], stops[k + 1], strict=True)])
    return out


def falsecolour(r: Raster, table: list[list[int]] | None = None) -> Raster:
    """Band 0, as 8 bits, through a 256 x 3 table."""
    return maplut(extract_bands(r, 0).map(lambda v: s.from_double(v.cast("double"), s.U8), s.U8), table or falsecolour_table(), fmt=s.U8)
