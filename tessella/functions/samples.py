"""Sample formats and pixel-local functions as column expressions.

Two dialects exist side by side. The typed functions of this module take degrees, round half
to even and follow the format's own rules for division by zero; those in `point` take radians,
round half away from zero and truncate on conversion."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format:
    """lo and hi are None for floating formats; wide is the type to compute in."""

    name: str
    lo: int | None
    hi: int | None
    bits: int
    stored: str
    wide: str

    @property
    def integral(self) -> bool:
        return self.hi is not None

    @property
    def unsigned(self) -> bool:
        return self.lo == 0

    @property
    def unit(self) -> float:
        """The value that stands for full intensity."""
        return float(self.hi) if self.hi is not None else 1.0


U8 = Format("u8", 0, 255, 8, "int", "bigint")
U16 = Format("u16", 0, 65535, 16, "int", "bigint")
I16 = Format("i16", -32768, 32767, 16, "int", "bigint")
U32 = Format("u32", 0, 4294967295, 32, "bigint", "decimal(38,0)")
I32 = Format("i32", -2147483648, 2147483647, 32, "bigint", "bigint")
F32 = Format("f32", None, None, 32, "double", "double")
F64 = Format("f64", None, None, 64, "double", "double")
FORMATS = {f.name: f for f in (U8, U16, I16, U32, I32, F32, F64)}


def c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clip(v: Column, f: Format) -> Column:
    """Into the format's range; floating formats pass."""
    return F.greatest(F.lit(f.lo), F.least(F.lit(f.hi), v)) if f.integral else v


def sat(v: Column, f: Format) -> Column:
    """Saturate a value that is already whole."""
    return clip(v, f).cast(f.stored)


def wide(v, f: Format) -> Column:
    return c(v).cast(f.wide)


def round_away(v: Column) -> Column:
    return F.signum(v) * F.floor(F.abs(v) + 0.5)


def trunc(v: Column) -> Column:
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))


def from_double(v: Column, f: Format) -> Column:
    """Clamp, then round half away from zero; not a number becomes 0."""
    if not f.integral:
        return v
    return F.when(F.isnan(v), F.lit(0)).otherwise(round_away(clip(v, f))).cast(f.stored)


def truncated(v: Column, f: Format) -> Column:
    """Clamp, then cut towards zero."""
    return trunc(clip(v, f)).cast(f.stored) if f.integral else v


# ---------------------------------------------------------------- typed arithmetic


def add(a, b, f: Format) -> Column:
    return sat(wide(a, f) + wide(b, f), f)


def subtract(a, b, f: Format) -> Column:
    return sat(wide(a, f) - wide(b, f), f)


def multiply(a, b, f: Format) -> Column:
    return sat(wide(a, f) * wide(b, f), f)


def divide(a, b, f: Format) -> Column:
    """A zero divisor gives 0; whole formats truncate."""
    a, b = c(a), c(b)
    if not f.integral:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0)))
    safe = F.when(b == 0, F.lit(1)).otherwise(b)
    return sat(F.when(b == 0, F.lit(0)).otherwise(trunc(a.cast("double") / safe.cast("double"))), f)


def remainder(a, b, f: Format) -> Column:
    """A zero divisor gives the maximum (unsigned) or -1; floats take the floored remainder."""
    a, b = c(a), c(b)
    zero = F.lit(f.hi if f.unsigned else -1)
    safe = F.when(b == 0, F.lit(1)).otherwise(b)
    if f.integral:
        return F.when(b == 0, zero).otherwise(a.cast("bigint") % safe.cast("bigint")).cast(f.stored)
    return F.when(b == 0, zero.cast("double")).otherwise(a - safe * F.floor(a / safe))


def linear(v, scale, offset, f: Format) -> Column:
    if not (math.isfinite(scale) and math.isfinite(offset)):
        raise ValueError("scale and offset must be finite")
    return truncated(c(v).cast("double") * float(scale) + float(offset), f)


def invert(v, f: Format) -> Column:
    if f.unsigned:
        return (F.lit(f.hi) - c(v)).cast(f.stored)
    return sat(-wide(v, f), f) if f.integral else F.lit(1.0) - c(v)


def absolute(v, f: Format) -> Column:
    return sat(F.abs(wide(v, f)), f)


def sign(v, f: Format) -> Column:
    """Not a number falls to -1."""
    v = c(v)
    out = F.when(v > 0, 1).when(v == 0, 0).otherwise(-1)
    if not f.integral:
        out = F.when(F.isnan(v), -1).otherwise(out)
    return out.cast(f.stored)


def rint(v) -> Column:
    return F.rint(c(v))


def floor(v) -> Column:
    return F.floor(c(v)).cast("double")


def ceil(v) -> Column:
    return F.ceil(c(v)).cast("double")


def clamp(v, lo: float, hi: float, f: Format) -> Column:
    return from_double(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c(v).cast("double"))), f)


def power(v, e, f: Format) -> Column:
    """A zero base gives 0, even for a negative exponent."""
    v = c(v).cast("double")
    return from_double(F.when(v == 0, F.lit(0.0)).otherwise(F.pow(v, c(e).cast("double"))), f)


def wop(a, b, f: Format) -> Column:
    """Power with swapped operands."""
    return power(b, a, f)


def atan2(a, b) -> Column:
    """In degrees, 0 to 360."""
    d = F.degrees(F.atan2(c(a).cast("double"), c(b).cast("double")))
    return F.when(d < 0, d + 360).otherwise(d)


def sqrt(v) -> Column:
    return F.sqrt(c(v))


def exp(v) -> Column:
    return F.exp(c(v))


def log(v) -> Column:
    """The logarithm of 0 is 0; of a negative value not a number."""
    v = c(v)
    return F.when(v == 0, F.lit(0.0)).when(v < 0, F.lit(float("nan"))).otherwise(F.log(v))


def exp10(v) -> Column:
    return F.pow(F.lit(10.0), c(v))


def log10(v) -> Column:
    v = c(v)
    return F.when(v == 0, F.lit(0.0)).when(v < 0, F.lit(float("nan"))).otherwise(F.log10(v))


def sin(v) -> Column:
    return F.sin(F.radians(c(v)))


def cos(v) -> Column:
    return F.cos(F.radians(c(v)))


def tan(v) -> Column:
    return F.tan(F.radians(c(v)))


def asin(v) -> Column:
    return F.degrees(F.asin(c(v)))


def acos(v) -> Column:
    return F.degrees(F.acos(c(v)))


def atan(v) -> Column:
    return F.degrees(F.atan(c(v)))


PROMOTED = {"u8": U16, "u16": U32, "i16": I32, "u32": U32, "i32": I32, "f32": F32, "f64": F64}


def add_images(a, b, f: Format) -> Column:
    """Sum in the promoted format."""
    to = PROMOTED[f.name]
    return sat(wide(a, to) + wide(b, to), to)


# ---------------------------------------------------------------- relational and boolean


def _mask(test: Column) -> Column:
    return F.when(test, 255).otherwise(0)


def _ordered(v: Column, test: Column) -> Column:
    return _mask(test & ~F.isnan(v.cast("double")))


def equal(v, k) -> Column:
    return _ordered(c(v), c(v) == c(k))


def not_equal(v, k) -> Column:
    return _mask(~((c(v) == c(k)) & ~F.isnan(c(v).cast("double"))))


def less(v, k) -> Column:
    return _mask(c(v) < c(k))


def less_eq(v, k) -> Column:
    return _mask(c(v) <= c(k))


def more(v, k) -> Column:
    return _ordered(c(v), c(v) > c(k))


def more_eq(v, k) -> Column:
    return _ordered(c(v), c(v) >= c(k))


def _integer(v: Column, f: Format) -> Column:
    return v.cast("bigint") if f.integral else truncated(v, I32).cast("bigint")


def _into(v: Column, f: Format) -> Column:
    """Keep the low bits of the format (of I32 for floats), with its sign."""
    f = f if f.integral else I32
    low = v.bitwiseAND(F.lit((1 << f.bits) - 1))
    return (low if f.unsigned else F.when(low > f.hi, low - (1 << f.bits)).otherwise(low)).cast(f.stored)


def bit_and(v, k: int, f: Format) -> Column:
    return _into(_integer(c(v), f).bitwiseAND(F.lit(k).cast("bigint")), f)


def bit_or(v, k: int, f: Format) -> Column:
    return _into(_integer(c(v), f).bitwiseOR(F.lit(k).cast("bigint")), f)


def bit_xor(v, k: int, f: Format) -> Column:
    return _into(_integer(c(v), f).bitwiseXOR(F.lit(k).cast("bigint")), f)


def lshift(v, n: int, f: Format) -> Column:
    bits = f.bits if f.integral else 32
    return F.lit(0).cast((f if f.integral else I32).stored) if n >= bits else _into(F.shiftleft(_integer(c(v), f), n), f)


def rshift(v, n: int, f: Format) -> Column:
    v, bits = _integer(c(v), f), f.bits if f.integral else 32
    return F.when(v < 0, -1).otherwise(0).cast((f if f.integral else I32).stored) if n >= bits else _into(F.shiftright(v, n), f)


# ---------------------------------------------------------------- complex pairs


def complex_multiply(ar, ai, br, bi) -> tuple[Column, Column]:
    return ar * br - ai * bi, ar * bi + ai * br


def cross_phase(ar, ai, br, bi) -> tuple[Column, Column]:
    """a times the conjugate of b, over its modulus; 0 where that is 0."""
    re, im = ar * br + ai * bi, ai * br - ar * bi
    m = F.hypot(re, im)
    safe = F.when(m == 0, F.lit(1.0)).otherwise(m)
    return F.when(m == 0, F.lit(0.0)).otherwise(re / safe), F.when(m == 0, F.lit(0.0)).otherwise(im / safe)


# ---------------------------------------------------------------- conversions


def cast_sample(v, source: Format, target: Format) -> Column:
    """Normalising cast: the unit of one format becomes the unit of the other."""
    v = c(v)
    if source.name == target.name:
        return v
    if not source.integral:
        return v if not target.integral else from_double(v * target.unit, target)
    if not target.integral:
        return v / source.unit
    if source.unsigned and target.unsigned and target.bits > source.bits:
        return (v.cast("bigint") * (target.hi // source.hi)).cast(target.stored)
    if source.unsigned and target.unsigned:
        return F.shiftright(v.cast("bigint"), source.bits - target.bits).cast(target.stored)
    return sat(v.cast("bigint"), target)


def byteswap(v, f: Format) -> Column:
    """Reverse the bytes of a 16- or 32-bit whole sample."""
    v, n = c(v).cast("bigint"), f.bits // 8
    out = F.lit(0).cast("bigint")
    for i in range(n):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255)), 8 * (n - 1 - i)))
    return _into(out, f)


def msb(v, f: Format) -> Column:
    """The top byte; of signed formats with the sign bit turned."""
    top = F.shiftright(c(v).cast("bigint"), f.bits - 8)
    return (top if f.unsigned else top + 128).cast("int")


def gamma(v, exponent: float, f: Format) -> Column:
    """max * (v / max) ^ (1 / exponent)."""
    v = c(v)
    if exponent == 1:
        return v
    return from_double(F.pow(v / F.lit(f.unit), F.lit(1.0 / exponent)) * f.unit, f)
