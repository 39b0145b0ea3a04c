"""Near-duplicate detection with BagMinHash signatures and verified multiset overlap.

A text is the multiset of its five-word shingles (words: runs without white space, A-Z as
a-z; a text of one to four words is one shingle). Two texts are near-duplicates if the
weighted (multiset) Jaccard similarity is at least `threshold`.

1. Signature. Each shingle's weight range is cut at powers of two; each stretch [lo, hi) of
   it is a Poisson process of its own, seeded by the shingle, of rate hi - lo per component.
   Its points carry a time, a component and a level; points above the shingle's weight are
   discarded. Each component keeps the earliest time. Equal components have a probability of
   exactly the weighted Jaccard similarity. Only points before a horizon that fills the
   signature almost surely are generated; a text with an empty component is done again with
   a longer one, which changes no time found before.
2. Bands. Texts with equal multisets are one node. Nodes that agree in all components of a
   band share a bucket. Rows of a band and the number of bands follow from the threshold
   (`banding`; 24 bands of 4 at 0.8, where a pair of similarity 0.8 is missed with a chance of 3e-6).
3. Verification. Each node of a bucket is compared to the bucket's leader, the node that stands
   in the largest buckets; the links make
   components. Nodes of buckets that still hold several components are then joined exactly:
   bags ordered from rare to common members meet at a member of their prefixes, and every
   pair of different components that neither prefix, sizes, places nor parity bits prove to be
   below the threshold is compared. So of the pairs that share a bucket none is left out. The
   overlap is computed on whole shingle multisets, as 32-bit hashes of (shingle, occurrence).
4. Classes are the connected components of the verified links.

Parity bits: each bag has 512 bits, a bit being the parity of how many members hash to it. The
bits in which two bags differ number at most the members in which they differ, so a pair with
too many is below the threshold, with certainty.

Defined cases: null and empty texts, and texts without words, are one class; repeated rows
are in one class; null ids are kept as null; other columns are ignored; an empty table gives
an empty result. Hot groups: equal texts fold into one node before any comparison, buckets
are aggregates and joins that Spark can split, and no task gathers a bucket. Work grows with
the square of a group only where its texts stay in many components and share rare shingles;
their pairs are met in the join and fall by its condition, they are not written.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Scratch, chunks, connected, maybe_broadcast, mix, numbered, text_of, tidied, uniform, words

_U = np.uint64
WIDTH = 5
_C = mix(np.arange(11, 11 + WIDTH, dtype=np.uint64)) | _U(1)
_NULL = -(2**63)
#: Slots for the members' frequencies; nodes of a token that meet at a time; 64-bit words of parity bits.
RANK_BITS, BLOCK, PARITY = 18, 1000, 8
#: The chance that a pair exactly at the threshold shares no band.
MISS = 4e-6


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): a band is shared with a chance of about 0.41 at the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = 16 if threshold > 0.95 else max(1, round(math.log(0.41) / math.log(threshold)))
    share = min(threshold**rows, 1 - 1e-9)
    return max(1, math.ceil(math.log(MISS) / math.log(1 - share) - 0.5)), rows


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text's number and hash of every shingle occurrence."""
    h, count = words(data, offs)
    n = len(count)
    of = np.repeat(np.arange(n), count)
    with np.errstate(over="ignore"):
        if len(h) >= WIDTH:
            total = sum((h[i : len(h) - WIDTH + 1 + i] * _C[i] for i in range(WIDTH)), _U(0))
            inside = of[: len(h) - WIDTH + 1] == of[WIDTH - 1 :]
            doc, s = of[: len(h) - WIDTH + 1][inside], mix(total[inside])
        else:
            doc, s = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        start = np.cumsum(count) - count
        for k in range(1, WIDTH):
            short = np.flatnonzero(count == k)
            if len(short):
                t = sum((h[start[short] + i] * _C[i] for i in range(k)), _U(k))
                doc, s = np.concatenate([doc, short]), np.concatenate([s, mix(t)])
    return doc, s


def bags(doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: text's number, 44-bit hash, multiplicity."""
    key = np.sort((doc.astype(np.uint64) << _U(44)) | (s >> _U(20)))
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[first] >> _U(44)).astype(np.int64), key[first] & _U((1 << 44) - 1), np.diff(np.append(first, len(key)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Earliest times, n x m; infinite for texts without shingles."""
    out = np.full(n * m, np.inf)
    total = np.bincount(doc, weight, n)
    horizon = (np.log(m) + 6) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        mine = todo[doc]
        d0, s0, w0 = doc[mine], shingle[mine], weight[mine]
        level = 0
        while len(d0):
            lo, size = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            up = w0 > lo
            d0, s0, w0 = d0[up], s0[up], w0[up]
            d, w, t = d0, w0, np.zeros(len(d0))
            with np.errstate(over="ignore"):
                h = mix(s0 * _U(0x9E3779B97F4A7C15) + _U(level + 1))
                while len(d):
                    h = mix(h + _U(0xA0761D6478BD642F))
                    t = t - np.log(uniform(h)) / (m * size)
                    alive = t < horizon[d]
                    d, w, t, h = d[alive], w[alive], t[alive], h[alive]
                    g = mix(h ^ _U(0xE7037ED1A0B428DB))
                    at = d * m + ((g >> _U(32)) % _U(m)).astype(np.int64)
                    if size > 1:
                        ok = lo + (g & _U(0xFFFFFFFF)).astype(np.float64) * (size / 2**32) < w
                        np.minimum.at(out, at[ok], t[ok])
                    else:
                        np.minimum.at(out, at, t)
            level += 1
        todo &= ~np.isfinite(out.reshape(n, m)).all(axis=1)
        horizon *= 3
    return out.reshape(n, m)


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands keys of the signature's bands."""
    bits = mix(np.ascontiguousarray(times).view(np.uint64))
    with np.errstate(over="ignore"):
        k = np.zeros((len(times), bands), np.uint64)
        for r in range(rows):
            k = mix(k + bits[:, r::rows][:, :bands] * _U(2 * r + 3))
        return mix(k + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)


def _expanded(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each (shingle, occurrence)."""
    occurrence = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        return np.repeat(doc, weight), mix(np.repeat(shingle, weight) + occurrence.astype(np.uint64) * _U(0xD1B54A32D192ED03))


def nodes(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each text's multiset."""
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        if len(doc):
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            out[doc[first]] = mix(np.add.reduceat(mix(shingle + weight.astype(np.uint64) * _U(0x8CB92BA72F3D8DD7)), first))
    return out.view(np.int64)


def sign(docs: DataFrame, threshold: float) -> DataFrame:
    """(id, node, bands) of rows (id, text)."""
    bands, rows = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1)):
                n = hi - lo
                bag = bags(*shingles(data, offs))
                keys = band_keys(signatures(*bag, n, bands * rows), bands, rows)
                empty = np.bincount(bag[0], minlength=n) == 0
                sizes = np.where(empty, 0, bands)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys[~empty].ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(nodes(*bag, n)), lists], names=["id", "node", "bands"])

    return docs.mapInArrow(tidied(run), "id bigint, node bigint, bands array<bigint>")


def multisets(docs: DataFrame) -> DataFrame:
    """(node, bag): sorted 32-bit hashes of rows (id, text, node), once per row whose text
    has that node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(2).to_numpy()
            for lo, hi, data, offs in chunks(b.column(1)):
                n = hi - lo
                bag = bags(*shingles(data, offs))
                right = nodes(*bag, n) == wanted[lo:hi]
                d, h = _expanded(*bag)
                key = np.sort((d.astype(np.uint64) << _U(32)) | (h >> _U(32)))
                cut = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << _U(32))
                low = (key & _U(0xFFFFFFFF)).astype("<u4")
                rows = np.flatnonzero(right)
                yield pa.RecordBatch.from_arrays([pa.array(wanted[lo:hi][rows]), pa.array([low[cut[i] : cut[i + 1]].tobytes() for i in rows], pa.binary())], names=["node", "bag"])

    return docs.mapInArrow(tidied(run), "node bigint, bag binary")


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed multisets."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) and not len(y):
        return 1.0
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = np.count_nonzero(both[1:] == both[:-1])
    return common / (len(x) + len(y) - common)


def verify(pairs: DataFrame, bags_of: DataFrame, threshold: float) -> DataFrame:
    """The links among pairs (a, b)."""
    one = pairs.join(bags_of.withColumnRenamed("node", "b").withColumnRenamed("bag", "bag_b"), "b")
    two = one.join(bags_of.withColumnRenamed("node", "a").withColumnRenamed("bag", "bag_a"), "a").select("a", "b", "bag_a", "bag_b")

    def linked(x: bytes, y: bytes) -> bool:
        # Sizes that differ too much exclude the threshold.
        return min(len(x), len(y)) >= (threshold - 1e-9) * max(len(x), len(y)) and similarity(x, y) >= threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            keep = pa.array([linked(x[i].as_py(), y[i].as_py()) for i in range(b.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return two.mapInArrow(tidied(run), "a bigint, b bigint")


def parity(x: np.ndarray) -> np.ndarray:
    """PARITY 64-bit words: of each bit the parity of the members that hash to it."""
    at = (mix(x.astype(np.uint64) + _U(0x5851F42D4C957F2D)) >> _U(40)) & _U(64 * PARITY - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=64 * PARITY) & 1).astype(np.uint8)).view("<i8")


def ranks(bags_of: DataFrame) -> np.ndarray:
    """How many members of the bags fall in each of 2^RANK_BITS slots of the hash: 2 MB at any
    size of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RANK_BITS, np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(total, np.frombuffer(x.as_py(), "<u4") >> (32 - RANK_BITS), 1)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "c"])

    t = bags_of.select("bag").mapInArrow(tidied(run), "slot bigint, c bigint").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(1 << RANK_BITS, np.int64)
    out[t.column("slot").to_numpy()] = t.column("c").to_numpy()
    return out


def prefixes(bags_of: DataFrame, threshold: float) -> DataFrame:
    """(node, size, p0, p1, ..., tokens): of each bag its size, its parity words and, in the
    order of rare to common members, the first |bag| - ceil(threshold * |bag|) + 1. Any order
    that all bags share is valid: two bags of similarity `threshold` have a member in common there."""
    held = bags_of.sparkSession.sparkContext.broadcast(ranks(bags_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, sizes, words_, tokens = b.column(0), [], [], []
            for i in range(b.num_rows):
                x = np.frombuffer(b.column(1)[i].as_py(), "<u4")
                x = x[np.lexsort((x, held.value[x >> (32 - RANK_BITS)]))]
                k = len(x) - int(np.ceil(threshold * len(x) - 1e-9)) + 1
                sizes.append(len(x))
                words_.append(parity(x))
                tokens.append(x[: min(max(k, 0), len(x))].astype(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            marks = np.array(words_, np.int64).reshape(b.num_rows, PARITY)
            yield pa.RecordBatch.from_arrays(
                [node, pa.array(sizes, pa.int64()), *[pa.array(marks[:, i].copy()) for i in range(PARITY)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["node", "size", *[f"p{i}" for i in range(PARITY)], "tokens"],
            )

    marks = ", ".join(f"p{i} bigint" for i in range(PARITY))
    return bags_of.select("node", "bag").mapInArrow(tidied(run), f"node bigint, size bigint, {marks}, tokens array<bigint>")


def candidates(bags_of: DataFrame, component: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes of different components: all but such whose similarity is provably
    below `threshold` (no member of the prefixes in common, or too few after it, sizes or parity
    bits that differ too much)."""
    marks = [f"p{i}" for i in range(PARITY)]
    rows = scratch.put(prefixes(bags_of, threshold).join(component, "node"), "prefixes")
    said = rows.select("node", "size", "root", *marks, F.posexplode("tokens").alias("at", "token"))
    # Of each token the greatest component needs no pairs of its own; the others meet all. A
    # token that a single component holds needs none at all.
    per = rows.select("root", F.explode("tokens").alias("token")).groupBy("token", "root").agg(F.count("*").alias("c"))
    main = per.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("n"), F.count("*").alias("k")).where("k > 1")
    main = scratch.put(main.select("token", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "main")
    said = said.join(maybe_broadcast(main), "token")
    # Long lists meet block by block, so that no task holds a token's pairs.
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    every = F.explode(F.expr("sequence(0L, parts - 1L)"))
    of = ("node", "size", "at", "root", *marks)
    x = said.where("root != main").select(*[F.col(c).alias(f"{c}_a") for c in ("token", *of, "main")], part.alias("i_a"), every.alias("j_a"))
    y = said.select(*[F.col(c).alias(f"{c}_b") for c in ("token", *of)], part.alias("j_b"), every.alias("i_b"))
    total = F.col("size_a") + F.col("size_b")
    differ = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in marks), F.lit(0))
    least = threshold / (1 + threshold) * total - 1e-9
    meet = [F.expr(f"{c}_a = {c}_b") for c in ("token", "i", "j")]
    meet += [F.expr("root_a != root_b and (root_b = main_a or node_a < node_b)")]
    meet += [F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9]
    meet += [F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= least, differ <= total * ((1 - threshold) / (1 + threshold)) + 1e-9]
    both = x.join(y, functools.reduce(lambda p, q: p & q, meet))
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """Rows (id, node, class_id), one per row of docs. class_id is the least id of the
    row's class; node tells which texts have equal multisets."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "bag-minhash")
    source = text_of(docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NULL)).alias("id"), F.col(text_column).alias("text")))
    signed = scratch.put(sign(source, threshold), "signed")
    # Equal bands of equal nodes: one row for each, whatever its copies.
    each = scratch.put(signed.groupBy("node").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands")), "each")
    placed = each.select("node", F.explode("bands").alias("key"))
    buckets = placed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).where("n > 1")
    buckets = scratch.put(buckets, "buckets")
    # A bucket of two is a pair already; only larger ones are joined to their members.
    twos = buckets.where("n = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))
    members = scratch.put(placed.join(maybe_broadcast(buckets.where("n > 2").select("key", "n")), "key"), "members")
    # The leader is the node that stands in the largest buckets, the most central one.
    central = members.groupBy("node").agg(F.sum("n").alias("weight"))
    leaders = members.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("best")).select("key", F.col("best.node").alias("leader"))
    members = scratch.put(members.join(maybe_broadcast(scratch.put(leaders, "leaders")), "key").select("key", "node", "leader"), "led")
    star = scratch.put(twos.union(members.where("node != leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))).distinct(), "star")
    involved = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = scratch.put(each.join(involved, "node", "left_semi").select("node", "id"), "chosen")
    bags_of = multisets(source.join(maybe_broadcast(chosen), "id").select("id", "text", "node"))
    # Equal ids may give a node's multiset more than once.
    bags_of = scratch.put(bags_of, "bags")
    if bags_of.count() > chosen.count():
        bags_of = scratch.put(bags_of.dropDuplicates(["node"]), "bags-once")

    links = scratch.put(verify(star, bags_of, threshold), "links-star")
    component = connected(links, scratch, "star-of")
    rooted = members.select("node", "key").join(component, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = scratch.put(rooted, "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    wide = scratch.put(rooted.join(maybe_broadcast(scratch.put(mixed, "mixed")), "key", "left_semi").select("node", "root").distinct(), "wide")
    if wide.limit(1).count():
        wide_bags = scratch.put(bags_of.join(maybe_broadcast(wide.select("node")), "node", "left_semi"), "wide-bags")
        pairs = scratch.put(candidates(wide_bags, wide, threshold, scratch).join(star, ["a", "b"], "left_anti"), "pairs")
        more = scratch.put(verify(pairs, wide_bags, threshold), "links-more")
        component = connected(links.union(more), scratch, "all-of")

    rows = signed.select("id", "node").join(component, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = scratch.put(rows.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).where("n > 1").select("root", "class_id"), "classes")
    out = rows.join(classes, "root", "left").select("id", "node", F.coalesce("class_id", "id").alias("class_id"))
    return out.select(*[F.when(F.col(c) == _NULL, None).otherwise(F.col(c)).alias(c) if c != "node" else F.col(c) for c in out.columns])


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **parameters) -> DataFrame:
    """The rows of docs without all but one row of each class: that of the least id, null
    before others, among equal ids that of the least node. Rows count by themselves: equal or
    null ids don't join rows of different texts."""
    scratch = parameters.setdefault("scratch", Scratch(docs.sparkSession, "keep-one"))
    rows = numbered(docs, scratch)
    found = scratch.put(near_duplicates(rows, ROW, text_column, **parameters), "found")
    several = scratch.put(found.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id"), "repeated")
    several = scratch.put(found.join(maybe_broadcast(several), "class_id", "left_semi").withColumnRenamed("id", ROW), "several")
    place = F.struct("__id", "node", ROW)
    of = several.join(rows.select(ROW, F.col(id_column).cast("long").alias("__id")), ROW)
    stay = of.groupBy("class_id").agg(F.min(place).getField(ROW).alias(ROW))
    gone = scratch.put(several.join(stay, [ROW], "left_anti").select(ROW), "gone")
    return rows.join(maybe_broadcast(gone), ROW, "left_anti").select(*docs.columns)
