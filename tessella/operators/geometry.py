"""Geometry: projections of the key (y, x), unions and fills. No operator here moves a row
to another machine unless it joins an image to a grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..raster import Raster


def extract_area(r: Raster, x: int, y: int, width: int, height: int) -> Raster:
    inside = r.df.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return r.with_df(inside).remap(F.col("y") - y, F.col("x") - x, width=width, height=height)


def flip_horizontal(r: Raster) -> Raster:
    return r.remap(F.col("y"), F.lit(r.width - 1) - F.col("x"))


def flip_vertical(r: Raster) -> Raster:
    return r.remap(F.lit(r.height - 1) - F.col("y"), F.col("x"))


def flip(r: Raster, direction: str) -> Raster:
    return flip_horizontal(r) if direction == "horizontal" else flip_vertical(r)


def rotate90(r: Raster) -> Raster:
    """Clockwise."""
    return r.remap(F.col("x"), F.lit(r.height - 1) - F.col("y"), width=r.height, height=r.width)


def rotate180(r: Raster) -> Raster:
    return r.remap(F.lit(r.height - 1) - F.col("y"), F.lit(r.width - 1) - F.col("x"))


def rotate270(r: Raster) -> Raster:
    return r.remap(F.lit(r.width - 1) - F.col("x"), F.col("y"), width=r.height, height=r.width)


def rot(r: Raster, degrees: int) -> Raster:
    return {0: lambda a: a, 90: rotate90, 180: rotate180, 270: rotate270}[degrees](r)


def autorot(r: Raster, orientation: int) -> Raster:
    """By the EXIF orientation, 1 to 8."""
    steps = {1: [], 2: [flip_horizontal], 3: [rotate180], 4: [flip_vertical], 5: [rotate90, flip_horizontal], 6: [rotate90], 7: [rotate270, flip_horizontal], 8: [rotate270]}
    for f in steps.get(orientation, []):
        r = f(r)
    return r


def rot45_map(n: int, steps: int) -> list[tuple[int, int, int, int]]:
    """(y, x, to y, to x) of an odd square turned clockwise by single steps of 45 degrees."""
    half, out = n // 2, []
    for y in range(n):
        for x in range(n):
            a, b = y, x
            for _ in range(steps % 8):
                d = max(abs(a - half), abs(b - half))
                if d == 0:
                    break
                ring = [(half - d, half - d + i) for i in range(2 * d)] + [(half - d + i, half + d) for i in range(2 * d)]
                ring += [(half + d, half + d - i) for i in range(2 * d)] + [(half + d - i, half - d) for i in range(2 * d)]
                a, b = ring[(ring.index((a, b)) + d) % len(ring)]
            out.append((y, x, a, b))
    return out


def rot45(r: Raster, degrees: int) -> Raster:
    if r.width != r.height or r.width % 2 == 0:
        raise ValueError("only odd squares turn by 45 degrees")
    places = F.array(*[F.lit(ty * r.width + tx) for _, _, ty, tx in rot45_map(r.width, degrees // 45)])
    to = F.get(places, F.col("y") * r.width + F.col("x"))
    return r.remap(F.floor(to / r.width), to % r.width)


def subsample(r: Raster, xfac: int, yfac: int) -> Raster:
    kept = r.df.where((F.col("x") % xfac == 0) & (F.col("y") % yfac == 0))
    return r.with_df(kept).remap(F.floor(F.col("y") / yfac), F.floor(F.col("x") / xfac), width=-(-r.width // xfac), height=-(-r.height // yfac))


def _spread(r: Raster, n: int, name: str):
    return r.df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def zoom(r: Raster, xfac: int, yfac: int) -> Raster:
    df = _spread(r, xfac * yfac, "__k")
    out = r.with_df(r.df)
    df = df.withColumns({"y": (F.col("y") * yfac + F.floor(F.col("__k") / xfac)).cast("int"), "x": (F.col("x") * xfac + F.col("__k") % xfac).cast("int")})
    return out.with_df(df, width=r.width * xfac, height=r.height * yfac)


def replicate(r: Raster, across: int, down: int) -> Raster:
    df = _spread(r, across * down, "__k")
    df = df.withColumns({"y": (F.col("y") + F.floor(F.col("__k") / across) * r.height).cast("int"), "x": (F.col("x") + F.col("__k") % across * r.width).cast("int")})
    return r.with_df(df, width=r.width * across, height=r.height * down)


def wrap(r: Raster, x: int, y: int) -> Raster:
    """(0, 0) moves to (x, y)."""
    return r.remap(F.pmod(F.col("y") + y, F.lit(r.height)), F.pmod(F.col("x") + x, F.lit(r.width)))


def transpose3d(r: Raster, page_height: int) -> Raster:
    """Line l of page p becomes line p of page l."""
    pages = r.height // page_height
    return r.remap((F.col("y") % page_height) * pages + F.floor(F.col("y") / page_height), F.col("x"))


def filled(r: Raster, width: int, height: int, background: float = 0) -> Raster:
    """Every place of the canvas, with the background where the image has none."""
    grid = r.grid(width, height).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(r.bands - 1))))
    df = grid.join(r.df, r.at, "left").withColumn("v", F.coalesce("v", F.lit(background).cast(r.df.schema["v"].dataType)))
    return r.with_df(df, width=width, height=height)


def grid(r: Raster, tile_height: int, across: int) -> Raster:
    """A vertical strip of tiles to a grid, row by row; missing cells are zero."""
    tiles = r.height // tile_height
    down = -(-tiles // across)
    t = F.floor(F.col("y") / tile_height)
    moved = r.remap(F.floor(t / across) * tile_height + F.col("y") % tile_height, (t % across) * r.width + F.col("x"))
    return filled(moved, r.width * across, tile_height * down)


def extended(place: Column, size: int, mode: str) -> Column:
    """The source place of a place outside the image; null where the background shows."""
    if mode in ("copy", "edge"):
        return F.greatest(F.lit(0), F.least(F.lit(size - 1), place))
    if mode == "repeat":
        return F.pmod(place, F.lit(size))
    if mode == "mirror":
        p = F.pmod(place, F.lit(2 * size))
        return F.when(p < size, p).otherwise(F.lit(2 * size - 1) - p)
    return F.when(place.between(0, size - 1), place)


def embed(r: Raster, width: int, height: int, x: int, y: int, extend: str = "black", background: float = 0) -> Raster:
    """extend: black, white, background, copy (edge), repeat or mirror."""
    fill = {"black": 0, "white": r.fmt.hi if r.fmt.integral else 1.0}.get(extend, background)
    if extend in ("black", "white", "background"):
        inside = r.remap(F.col("y") + y, F.col("x") + x)
        return filled(inside.with_df(inside.df.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))), width, height, fill)
    places = r.grid(width, height).select(*r.keys, "y", "x", extended(F.col("y") - y, r.height, extend).cast("int").alias("__y"), extended(F.col("x") - x, r.width, extend).cast("int").alias("__x"))
    source = r.df.withColumnsRenamed({"y": "__y", "x": "__x"})
    return r.with_df(places.join(source, [*r.keys, "__y", "__x"]), width=width, height=height)


GRAVITY = {"centre": (1, 1), "north": (1, 0), "east": (2, 1), "south": (1, 2), "west": (0, 1), "north-east": (2, 0), "south-east": (2, 2), "south-west": (0, 2), "north-west": (0, 0)}


def gravity(r: Raster, width: int, height: int, direction: str = "centre", extend: str = "black", background: float = 0) -> Raster:
    gx, gy = GRAVITY[direction]
    return embed(r, width, height, (width - r.width) * gx // 2, (height - r.height) * gy // 2, extend, background)


def join(a: Raster, b: Raster, direction: str = "horizontal") -> Raster:
    across = direction == "horizontal"
    right = b.remap(F.col("y"), F.col("x") + a.width) if across else b.remap(F.col("y") + a.height, F.col("x"))
    width = a.width + b.width if across else max(a.width, b.width)
    height = max(a.height, b.height) if across else a.height + b.height
    both = a.with_df(a.df.unionByName(right.df))
    full = a.height == b.height if across else a.width == b.width
    return both.with_df(both.df, width=width, height=height) if full else filled(both, width, height)


def insert(main: Raster, sub: Raster, x: int, y: int, expand: bool = False, background: float = 0) -> Raster:
    """The sub-image wins where both are."""
    left, top = (min(0, x), min(0, y)) if expand else (0, 0)
    width = max(main.width, x + sub.width) - left if expand else main.width
    height = max(main.height, y + sub.height) - top if expand else main.height
    moved = sub.remap(F.col("y") + (y - top), F.col("x") + (x - left)).df.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    base = main.remap(F.col("y") - top, F.col("x") - left).df
    both = base.join(moved.withColumnRenamed("v", "__w"), main.at, "full").withColumn("v", F.coalesce("__w", "v"))
    out = main.with_df(both, width=width, height=height)
    return filled(out, width, height, background) if expand else out


def smartcrop(r: Raster, width: int, height: int, interesting: str = "centre") -> Raster:
    """A crop of the given size. none and all: the top left; low, high, centre: by place;
    attention: centred on the strongest edge or most saturated colour; entropy: rows and columns
    of least spread are cut off until the size fits."""
    left, top = r.width - width, r.height - height
    if interesting in ("none", "all", "low", "high", "centre"):
        x, y = {"none": (0, 0), "all": (0, 0), "low": (0, 0), "high": (left, top), "centre": (left // 2, top // 2)}[interesting]
        return extract_area(r, x, y, width, height) if interesting != "all" else r
    from .neighbourhood import convolve

    one = r.with_df(r.df.groupBy(*r.pixel).agg(F.avg("v").alias("v")).withColumn("band", F.lit(0)), bands=1)
    edge = convolve(one, [[0, -1, 0], [-1, 4, -1], [0, -1, 0]]).map(F.abs)
    if interesting == "attention":
        spread = r.df.groupBy(*r.pixel).agg((F.max("v") - F.min("v")).alias("__s"))
        scored = edge.df.join(spread, r.pixel).withColumn("__score", F.col("v") * 5 + F.col("__s"))
        best = scored.groupBy(*r.keys).agg(F.min_by(F.struct("y", "x"), F.struct(-F.col("__score"), "y", "x")).alias("__p"))
        low = lambda p, size, room: F.greatest(F.lit(0), F.least(F.lit(room), p - size // 2))
        best = best.select(*r.keys, low(F.col("__p.y"), height, top).alias("__y"), low(F.col("__p.x"), width, left).alias("__x"))
    else:
        # Offsets by the sums of edge strength in every window of rows and of columns.
        def offset(axis: str, size: int, room: int, name: str):
            lines = edge.df.groupBy(*r.keys, axis).agg(F.sum("v").alias("__e"))
            starts = lines.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(room)))).where(F.col(axis).between(F.col("__o"), F.col("__o") + size - 1))
            sums = starts.groupBy(*r.keys, "__o").agg(F.sum("__e").alias("__e"))
            return sums.groupBy(*r.keys).agg(F.min_by("__o", F.struct(-F.round("__e", 6), "__o")).alias(name))

        a, b = offset("y", height, top, "__y"), offset("x", width, left, "__x")
        best = a.join(b, list(r.keys)) if r.keys else a.join(b, F.lit(True))
    df = r.df.join(F.broadcast(best), list(r.keys)) if r.keys else r.df.join(F.broadcast(best), F.lit(True))
    df = df.where((F.col("y") >= F.col("__y")) & (F.col("y") < F.col("__y") + height) & (F.col("x") >= F.col("__x")) & (F.col("x") < F.col("__x") + width))
    return r.with_df(df.withColumns({"y": (F.col("y") - F.col("__y")).cast("int"), "x": (F.col("x") - F.col("__x")).cast("int")}), width=width, height=height)


def sequential(r: Raster) -> Raster:
    """A hint of the reading order only: the plan does not change."""
    return r


def linecache(r: Raster) -> Raster:
    """Rows are kept for later operators."""
    return r.with_df(r.df.persist())
