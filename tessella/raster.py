"""The raster: a DataFrame of samples with the shape and format of its images.

Columns: the key columns of an image (`keys`, for example image_id), then y, x, band and v.
All images of one raster have one shape. Nothing here runs a job; every operator adds to the
logical plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.samples import F64, Format


@dataclass(frozen=True)
class Raster:
    df: DataFrame
    width: int
    height: int
    bands: int = 1
    fmt: Format = F64
    keys: tuple[str, ...] = ()
    interpretation: str = "multiband"
    meta: dict = field(default_factory=dict)

    @property
    def pixel(self) -> list[str]:
        return [*self.keys, "y", "x"]

    @property
    def at(self) -> list[str]:
        return [*self.keys, "y", "x", "band"]

    def with_df(self, df: DataFrame, **changes) -> Raster:
        out = replace(self, df=df, **changes)
        return replace(out, df=df.select(*out.at, "v"))

    def map(self, f: Callable[[Column], Column], fmt: Format | None = None) -> Raster:
        """A function of each sample; adjacent maps become one projection."""
        return self.with_df(self.df.withColumn("v", f(F.col("v"))), fmt=fmt or self.fmt)

    def zip(self, other: Raster, f: Callable[[Column, Column], Column], fmt: Format | None = None) -> Raster:
        """A function of the samples of two images at equal places. One band of `other`
        serves all bands."""
        right = other.df.withColumnRenamed("v", "__w")
        on = self.at if other.bands == self.bands else self.pixel
        right = right if other.bands == self.bands else right.drop("band")
        return self.with_df(self.df.join(right, on).withColumn("v", f(F.col("v"), F.col("__w"))), fmt=fmt or self.fmt)

    def remap(self, y: Column, x: Column, **changes) -> Raster:
        """Move every sample to (y, x), columns of the old place."""
        return self.with_df(self.df.withColumns({"__y": y.cast("int"), "__x": x.cast("int")}).drop("y", "x").withColumnsRenamed({"__y": "y", "__x": "x"}), **changes)

    def wide(self) -> DataFrame:
        """One row per pixel with the bands as columns b0, b1, ..."""
        return self.df.groupBy(*self.pixel).agg(*[F.max(F.when(F.col("band") == i, F.col("v"))).alias(f"b{i}") for i in range(self.bands)])

    def images(self) -> DataFrame:
        """The distinct keys of the images (one empty row if there are no key columns)."""
        return self.df.select(*self.keys).distinct()

    def grid(self, width: int | None = None, height: int | None = None) -> DataFrame:
        """All places (keys, y, x) of each image, as a projection of a range."""
        w, h = width or self.width, height or self.height
        spark = self.df.sparkSession
        if not self.keys:
            return spark.range(w * h).select(F.expr(f"cast(id div {w} as int)").alias("y"), (F.col("id") % w).cast("int").alias("x"))
        rows = self.images().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
        return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))


def from_wide(df: DataFrame, bands: list[Column], width: int, height: int, fmt: Format = F64, keys: tuple[str, ...] = ()) -> Raster:
    """A raster from rows of pixels: each expression gives one band."""
    cells = F.posexplode(F.array(*[b.cast(fmt.stored) for b in bands])).alias("band", "v")
    return Raster(df.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), cells), width, height, len(bands), fmt, keys)


def from_values(spark: SparkSession, rows: list[list[float]], fmt: Format = F64) -> Raster:
    """A one-band image from a small matrix."""
    cells = [(y, x, 0, v) for y, row in enumerate(rows) for x, v in enumerate(row)]
    df = spark.createDataFrame(cells, f"y int, x int, band int, v {'double' if not fmt.integral else 'long'}")
    return Raster(df.withColumn("v", F.col("v").cast(fmt.stored)), len(rows[0]), len(rows), 1, fmt)


def column_expression(spark: SparkSession, width: int, height: int, f: Callable[[Column, Column], Column | list[Column]], fmt: Format = F64) -> Raster:
    """A generated image: f(y, x) gives one band or a list of bands."""
    grid = spark.range(width * height).select(F.expr(f"cast(id div {width} as int)").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    out = f(F.col("y"), F.col("x"))
    return from_wide(grid, out if isinstance(out, list) else [out], width, height, fmt)
