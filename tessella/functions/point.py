"""The point dialect: radians, rounding half away from zero, truncating conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import samples as s
from .samples import Format, c


def _out(v: Column, f: Format) -> Column:
    return s.truncated(v, f)


def absolute(v, f: Format) -> Column:
    return s.absolute(v, f)


def bool_and(v, k: int, f: Format) -> Column:
    return s.bit_and(v, k, f)


def bool_or(v, k: int, f: Format) -> Column:
    return s.bit_or(v, k, f)


def bool_xor(v, k: int, f: Format) -> Column:
    return s.bit_xor(v, k, f)


def lshift(v, n: int, f: Format) -> Column:
    return s.lshift(v, n, f)


def rshift(v, n: int, f: Format) -> Column:
    return s.rshift(v, n, f)


def clamp(v, lo: float, hi: float, f: Format) -> Column:
    return _out(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c(v).cast("double"))), f)


def gamma(v, exponent: float, f: Format) -> Column:
    """max * (v / max) ^ exponent (the exponent itself, not its inverse)."""
    return _out(F.pow(c(v) / F.lit(f.unit), F.lit(float(exponent))) * f.unit, f)


def invert(v, f: Format) -> Column:
    return s.invert(v, f)


def linear(v, scale: float, offset: float, f: Format) -> Column:
    return _out(c(v).cast("double") * float(scale) + float(offset), f)


def _of(fn):
    def apply(v, f: Format) -> Column:
        return _out(fn(c(v).cast("double")), f)

    return apply


sin, cos, tan = _of(F.sin), _of(F.cos), _of(F.tan)
asin, acos, atan = _of(F.asin), _of(F.acos), _of(F.atan)
exp, log, sqrt = _of(F.exp), _of(s.log), _of(F.sqrt)
round_ = _of(s.round_away)
floor, ceil = _of(s.floor), _of(s.ceil)


def power(v, e: float, f: Format) -> Column:
    v = c(v).cast("double")
    return _out(F.when(v == 0, F.lit(0.0)).otherwise(F.pow(v, F.lit(float(e)))), f)


def sign(v, f: Format) -> Column:
    return s.sign(v, f)
