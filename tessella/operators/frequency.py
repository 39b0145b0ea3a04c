"""Fourier transforms and spectra.

A transform of a whole image goes in two passes of one-dimensional transforms, by rows and
by columns: each task gets whole rows (then columns) as arrays in Arrow batches, so memory is
one row, and the two shuffles are the transposition that any distributed transform needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import samples as s
from ..raster import Raster
from .bands import complex_form, extract_bands
from .geometry import wrap


#: Samples that are transformed at a time.
CELLS = 1 << 20


def _lines(df: DataFrame, keys: list[str], line: str, along: str, size: int, inverse: bool) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct(along, "re", "im")))
    rows = df.groupBy(*keys, line).agg(cells.alias("c")).select(*keys, line, F.transform("c", lambda c: c["re"]).alias("re"), F.transform("c", lambda c: c["im"]).alias("im"))
    n = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, CELLS // size)
        for whole in batches:
            for k in range(0, whole.num_rows, at_once):
                b = whole.slice(k, at_once)
                re, im = (np.asarray(b.column(c).flatten()).reshape(b.num_rows, size) for c in (n, n + 1))
                z = re + 1j * im
                z = np.fft.ifft(z) * size if inverse else np.fft.fft(z)
                ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(size))
                outs = [pa.ListArray.from_arrays(ends, pa.array(part.ravel())) for part in (z.real, z.imag)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *outs], names=b.schema.names)

    done = rows.mapInArrow(run, rows.schema)
    cell = F.posexplode(F.arrays_zip("re", "im")).alias(along, "z")
    return done.select(*keys, line, cell).select(*keys, line, along, F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def _transform(r: Raster, df: DataFrame, inverse: bool) -> DataFrame:
    keys = list(r.keys)
    return _lines(_lines(df, keys, "y", "x", r.width, inverse), keys, "x", "y", r.height, inverse)


def fwfft(r: Raster, shift: bool = False) -> Raster:
    """One band to two (real, imaginary), scaled by 1 / (width * height)."""
    z = _transform(r, r.df.where("band = 0").select(*r.pixel, F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")), False)
    n = float(r.width * r.height)
    out = r.with_df(z.select(*r.pixel, F.posexplode(F.array(F.col("re") / n, F.col("im") / n)).alias("band", "v")), bands=2, fmt=s.F64)
    return wrap(out, r.width // 2, r.height // 2) if shift else out


def invfft(r: Raster, shift: bool = False) -> Raster:
    """The real part of the inverse."""
    if shift:
        r = wrap(r, -(r.width // 2), -(r.height // 2))
    w = r.wide().select(*r.pixel, F.col("b0").alias("re"), F.col("b1").alias("im"))
    z = _transform(r, w, True)
    return r.with_df(z.select(*r.pixel, F.lit(0).alias("band"), F.col("re").alias("v")), bands=1, fmt=s.F64)


def _both(a: Raster, b: Raster, f) -> Raster:
    right = b.wide().withColumnsRenamed({"b0": "c0", "b1": "c1"})
    re, im = f(F.col("b0"), F.col("b1"), F.col("c0"), F.col("c1"))
    return a.with_df(a.wide().join(right, a.pixel).select(*a.pixel, F.posexplode(F.array(re, im)).alias("band", "v")), fmt=s.F64)


def freqmult(a: Raster, b: Raster) -> Raster:
    return _both(a, b, s.complex_multiply)


def phasecor(a: Raster, b: Raster) -> Raster:
    return _both(a, b, s.cross_phase)


def spectrum(r: Raster) -> Raster:
    """The modulus, with frequency 0 in the middle."""
    df = r.wide().select(*r.pixel, F.lit(0).alias("band"), F.hypot("b0", "b1").alias("v"))
    return wrap(r.with_df(df, bands=1, fmt=s.F64), r.width // 2, r.height // 2)


def filtered(r: Raster, mask: Raster) -> Raster:
    """Through a frequency mask and back."""
    spectra = fwfft(r)
    re = extract_bands(spectra, 0).zip(mask, lambda v, m: v * m)
    im = extract_bands(spectra, 1).zip(mask, lambda v, m: v * m)
    return invfft(complex_form(re, im))
