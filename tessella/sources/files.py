"""Images in files: readers and writers over Spark's own listing and binary reader.

`read` gives one row per sample; `read_tiles` one row per tile with its bytes, for images too
large for single rows of samples. Every file is decoded in one task; the formats of
`codecs` need the whole file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..raster import Raster
from . import codecs

SAMPLES = "path string, y int, x int, band int, v double"


def _decoded(files: DataFrame, shrink: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = codecs.decode(path, data)[::shrink, ::shrink]
                h, w, n = a.shape
                for top in range(0, h, max(1, 1_000_000 // (w * n))):
                    part = a[top : top + max(1, 1_000_000 // (w * n))]
                    y, x, band = np.indices(part.shape, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * part.size), *[pa.array(i.ravel()) for i in (y + np.int32(top), x, band)], pa.array(part.ravel().astype(float))], names=["path", "y", "x", "band", "v"])

    return files.select("path", "content").mapInArrow(run, SAMPLES)


def read(spark: SparkSession, path: str, shrink: int = 1) -> DataFrame:
    """Samples of all files under a path; shrink takes every n-th row and column at decode."""
    return _decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), shrink)


def stream(spark: SparkSession, path: str, shrink: int = 1) -> DataFrame:
    """The same for files as they arrive (Structured Streaming)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _decoded(spark.readStream.format("binaryFile").schema(schema).load(path), shrink)


def read_jvm(spark: SparkSession, path: str) -> DataFrame:
    """JPEG, PNG, BMP and GIF (first frame) through the JVM's decoder: path, y, x, band (in the
    order red, green, blue) and v."""
    img = spark.read.format("image").load(path).select("image.*").where("nChannels > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for origin, h, w, n, data in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                a = a[:, :, [2, 1, 0, *range(3, n)]] if n >= 3 else a
                y, x, band = np.indices(a.shape, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([origin] * a.size), *[pa.array(i.ravel()) for i in (y, x, band)], pa.array(a.ravel().astype(float))], names=["path", "y", "x", "band", "v"])

    return img.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, SAMPLES)


def encoded(r: Raster, kind="png", dtype: str = "u1") -> DataFrame:
    """One row (keys, data) per image: its file, in a format of the registry or by a function of
    the array. The image must fit a task's memory; larger ones are written as tiles (`deepzoom`)."""
    encode, keys, bands = codecs.REGISTRY[kind][3] if isinstance(kind, str) else kind, list(r.keys), r.bands
    rows = r.df.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct("x", "band", F.col("v").cast("double").alias("v")))).alias("c"))
    lines = rows.select(*keys, "y", F.transform("c", lambda c: c["v"]).alias("line"))
    images = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("c")).select(*keys, F.transform("c", lambda c: c["line"]).alias("lines"))
    schema = images.drop("lines").schema.add("data", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [encode(np.array(v).reshape(len(v), -1, bands).astype(dtype)) for v in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(files, pa.binary())], names=[*keys, "data"])

    return images.mapInArrow(run, schema)


def decoded(files: DataFrame, keys: list[str], decode) -> DataFrame:
    """Samples (keys, y, x, band, v) of rows (keys, data), by a decoder of bytes."""
    schema = files.select(*keys).schema
    for name, kind in (("y", "integer"), ("x", "integer"), ("band", "integer"), ("v", "double")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a = decode(b.column(len(keys))[i].as_py())
                y, x, band = np.indices(a.shape, dtype=np.int32)
                own = [b.column(k).take(pa.array(np.full(a.size, i))) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c.ravel()) for c in (y, x, band)], pa.array(a.ravel().astype(float))], names=[*keys, "y", "x", "band", "v"])

    return files.select(*keys, "data").mapInArrow(run, schema)


def write(r: Raster, folder: str, kind: str = "png", dtype: str = "u1") -> DataFrame:
    """Write one file per image under a folder of a shared store; rows (keys, path)."""
    keys, end = list(r.keys), codecs.REGISTRY[kind][1][0]
    files = encoded(r, kind, dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            paths = []
            for i in range(b.num_rows):
                name = "-".join(str(b.column(k)[i].as_py()) for k in range(len(keys))) or "image"
                uri = f"{folder}/{name}.{end}"
                store, path = fs.FileSystem.from_uri(uri)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path, compression=None) as f:
                    f.write(b.column(len(keys))[i].as_py())
                paths.append(uri)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(paths)], names=[*keys, "path"])

    return files.mapInArrow(run, files.drop("data").schema.add("path", "string"))


def deepzoom(r: Raster, tile: int = 256) -> DataFrame:
    """A tile pyramid: rows (keys, level, row, column, data) with PNG tiles, level 0 the smallest.
    Each level is the one above shrunk by two; tiles are gathered per (level, row, column)."""
    from ..operators.resample import shrink
    from ..operators.geometry import extract_area  # noqa: F401

    levels = [r]
    while max(levels[-1].width, levels[-1].height) > 1:
        top = levels[-1]
        levels.append(shrink(top, min(2, top.width), min(2, top.height)))
    out = None
    for i, level in enumerate(reversed(levels)):
        part = level.df.withColumns({"level": F.lit(i), "row": F.floor(F.col("y") / tile).cast("int"), "column": F.floor(F.col("x") / tile).cast("int")})
        out = part if out is None else out.unionByName(part)
    keys = (*r.keys, "level", "row", "column")
    return encoded(Raster(out, tile, tile, r.bands, r.fmt, keys), "png")


def discard(df: DataFrame) -> None:
    """Run the plan and drop its rows."""
    df.write.format("noop").mode("overwrite").save()
