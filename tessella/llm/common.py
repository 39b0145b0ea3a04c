"""Shared plumbing of the training-data operators: scratch tables in the cluster's
shared folder, and byte-level text kernels that work on Arrow buffers.

The kernels tokenise whole record batches with numpy, so no Python string is made
per word. A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
Words are known by a 64-bit hash: a polynomial over random byte values modulo 2^64,
mixed afterwards. Two different words share a hash with a chance of about 2^-64.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on one machine
    (master local) a temporary folder is made and set where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables of one operator call. `put` cuts lineage: it writes the rows as
    Parquet into the shared folder and reads them back, so a lost executor costs only
    the tasks it ran. `drop` removes what no later step reads."""

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessella/{owner}-{uuid.uuid4().hex}"
        Scratch.live.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        if not names and self in Scratch.live:
            Scratch.live.remove(self)


def drop_all_scratch() -> None:
    """Remove every scratch table of finished operators. Call it only when their
    results have been written elsewhere."""
    for s in list(Scratch.live):
        s.drop()


def text_of(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))


#: The column of a row's number in `numbered` tables.
ROW = "__row_number"


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with a number for each row, written once so that each reading gives the same."""
    return scratch.put(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(column).cast("string")) % modulus


# ---------------------------------------------------------------- workers


def tidied(run):
    """A function over batches that gives freed memory back to the system when its task ends:
    workers live on, and what they keep would add up over the stages of a job."""

    def wrapped(batches):
        import ctypes
        import gc

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


# ---------------------------------------------------------------- text kernels

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20260101))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUE_LOWER = _VALUE[_LOWER]
_powers = {_BASE: np.ones(1, dtype=np.uint64), _INVERSE: np.ones(1, dtype=np.uint64)}
#: Text bytes that the kernels take at a time (a longer document is taken alone).
CHUNK_BYTES = 2_000_000


def powers(base: int, n: int) -> np.ndarray:
    got = _powers[base]
    if len(got) < n:
        with np.errstate(over="ignore"):
            while len(got) < n:
                step = _U(pow(base, len(got), 2**64))
                got = np.concatenate([got, got * step])
        _powers[base] = got if len(got) <= 16 * CHUNK_BYTES else _powers[base]
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and n+1 offsets of a string column, without copying texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [a, b) of about `limit` text bytes: a, b, bytes, offsets."""
    data, offs = buffers(column)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many words each text has."""
    n = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    word = ~_SPACE[data]
    before = np.empty(len(word), bool)
    before[0] = False
    before[1:] = word[:-1]
    first = offs[:-1]
    before[first[first < len(word)]] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty(len(word), bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(word & ~after) + 1
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUE_LOWER[data] * powers(_BASE, len(data)), out=total[1:])
        h = (total[end] - total[start]) * powers(_INVERSE, len(data))[start]
        h = mix(h + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    counts = np.searchsorted(start, offs[1:]) - np.searchsorted(start, offs[:-1])
    return h, counts


def hash_word(word: str) -> int:
    """The hash that `words` gives a single word."""
    data = np.frombuffer(word.encode(), np.uint8)
    h, _ = words(data, np.array([0, len(data)], np.int64))
    return int(h[0])


def uniform(h: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from hashes."""
    return ((h >> _U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


# ---------------------------------------------------------------- small tables

#: Bytes that a table may have in memory to be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 24_000_000


def bytes_of(df: DataFrame) -> int:
    """The bytes of the rows in memory: 8 for a number and a row, and what texts and arrays hold."""
    wide = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            wide.append(F.coalesce(F.octet_length(f.name), F.lit(0)) + 16)
        elif kind in ("array<bigint>", "array<double>", "array<int>"):
            wide.append(8 * F.greatest(F.size(f.name), F.lit(0)) + 24)
        elif kind.startswith(("array", "map", "struct")):
            wide.append(F.octet_length(F.to_json(F.struct(f.name))) + 24)
        else:
            wide.append(F.lit(8))
    each = sum((w.cast("long") for w in wide), F.lit(16).cast("long"))
    return int(df.agg(F.sum(each)).first()[0] or 0)


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The table, broadcast if its measured bytes allow it. Results are the same either way."""
    return F.broadcast(df) if bytes_of(df) <= most else df


def _forest(batches):
    """Of the links (x, y) of a task, those that still tell which nodes belong together: each
    node with the least node that it reaches inside the task. Bounded by TASK_LINKS links a time."""

    def stars(x, y):
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        a, b = at[: len(x)], at[len(x) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = np.minimum(new, new[new])
            new = new[new]
            if (new == root).all():
                break
            root = new
        far = root != np.arange(len(nodes))
        return nodes[far], nodes[root[far]]

    held: list = []
    size = 0

    def out():
        x, y = stars(*[np.concatenate(c) for c in zip(*held, strict=True)])
        held.clear()
        for i in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]), pa.array(y[i : i + 100_000])], names=["x", "y"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size >= TASK_LINKS:
            yield from out()
            size = 0
    if held:
        yield from out()


#: Links that a task contracts at a time.
TASK_LINKS = 2_000_000


def connected(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, root): the least node of each node's component, for links (a, b). Links are
    contracted inside their tasks first; then labels spread along what is left and through
    the labels' own labels, so few rounds are needed. Every round is a written table and
    nothing but a count reaches the driver."""
    few = links.select(F.col("a").alias("x"), F.col("b").alias("y")).coalesce(max(1, links.sparkSession.sparkContext.defaultParallelism)).mapInArrow(tidied(_forest), "x bigint, y bigint")
    few = scratch.put(few, f"{tag}-few")
    both = few.union(few.select("y", "x")).distinct()
    label = scratch.put(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("root")), f"{tag}-0")
    step = 0
    while True:
        step += 1
        # Both ends of a link take the least label of the two, and a label its own label.
        seen = few.join(label.withColumnRenamed("node", "x"), "x").select("x", "y", F.col("root").alias("rx")).join(label.withColumnRenamed("node", "y"), "y").select("x", "y", "rx", F.col("root").alias("ry"))
        low = F.least("rx", "ry")
        told = seen.where("rx != ry").select(F.explode(F.array(F.struct(F.col("rx").alias("node"), low.alias("to")), F.struct(F.col("ry").alias("node"), low.alias("to")))).alias("t")).select("t.node", "t.to")
        told = scratch.put(told.groupBy("node").agg(F.min("to").alias("to")).where("to < node"), f"{tag}-told-{step}")
        if not told.limit(1).count():
            scratch.drop(f"{tag}-few", f"{tag}-told-{step}")
            return label
        moved = label.join(told.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        further = told.select(F.col("node").alias("root"), F.col("to").alias("then"))
        label = scratch.put(moved.join(further, "root", "left").select("node", F.coalesce("then", "root").alias("root")), f"{tag}-{step}")
        scratch.drop(f"{tag}-{step - 1}", f"{tag}-told-{step}")
