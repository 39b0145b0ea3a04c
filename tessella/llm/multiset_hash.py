"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (the stretches between newlines). Each paragraph
hashes to a wide vector; the fingerprint is the sum of these vectors, lane by lane, modulo a
power of two. So the order of paragraphs does not matter, and a paragraph is inserted or
deleted by adding or subtracting its vector (`add`, `remove`).

The vector has two parts: 16 lanes modulo 2^32, uniform in the paragraph's bytes, which
decide equality; and 256 lanes modulo 2^32 into which each three-word shingle of the
paragraph adds +1 or -1, so that the cosine of two sums estimates the likeness of the
multisets of shingles (error about 1/16). The likeness is 1 for equal fingerprints. A lane
holds sums of up to 2^31 shingles either way, more than a text can have.

Defined cases: a null text is the empty text, which is one empty paragraph; a paragraph
of fewer than three words has one shingle; equal ids are ordered by text; null ids come
first; other columns are ignored. Ids are meant to be keys: all rows of one id are in one range,
and so in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _INVERSE, _VALUE, chunks, mix, powers, text_of, words, tidied

_U = np.uint64
WIDE, SKETCH = 16, 256
_LANES = mix(np.arange(1, WIDE + 1, dtype=np.uint64))


def vectors(column: pa.Array) -> np.ndarray:
    """Fingerprints of texts: rows of WIDE + SKETCH 32-bit sums (as int64)."""
    out = []
    for _, _, data, offs in chunks(column):
        n = len(offs) - 1
        cut = np.flatnonzero(data == 10)
        # Paragraph p covers [starts[p], stops[p]); each text has one more than it has newlines.
        doc_of_cut = np.searchsorted(offs, cut, side="right") - 1
        doc = np.concatenate([np.arange(n), doc_of_cut])
        starts = np.concatenate([offs[:-1], cut + 1])
        order = np.lexsort((starts, doc))
        doc, starts = doc[order], starts[order]
        per = np.bincount(doc, minlength=n)
        last = np.cumsum(per) - 1
        stops = np.empty_like(starts)
        stops[:-1] = starts[1:] - 1
        stops[last] = offs[1:]
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * powers(_BASE, len(data)))])
            h = mix((total[stops] - total[starts]) * powers(_INVERSE, len(data) + 1)[starts] + (stops - starts).astype(np.uint64))
            wide = mix(h[:, None] + _LANES[None, :]) & _U(0xFFFFFFFF)
            wide = np.add.reduceat(wide, np.concatenate([[0], last[:-1] + 1]), axis=0) & _U(0xFFFFFFFF)
            # Words by paragraph; the newline itself belongs to no word.
            w, count = words(data, np.append(starts, len(data)))
            para = np.repeat(np.arange(len(starts)), count)
            second, third = np.zeros_like(w), np.zeros_like(w)
            second[:-1] = np.where(para[1:] == para[:-1], w[1:], 0)
            third[:-2] = np.where(para[2:] == para[:-2], w[2:], 0)
            place = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
            full = (third != 0) | (place == 0)
            s = mix(w[full] * _U(3) + mix(second[full] * _U(5) + mix(third[full])))
        at = doc[para[full]] * SKETCH + (s & _U(SKETCH - 1)).astype(np.int64)
        sign = np.where((s >> _U(40)) & _U(1), 1.0, -1.0)
        sketch = np.bincount(at, sign, n * SKETCH).astype(np.int64).reshape(n, SKETCH) & 0xFFFFFFFF
        out.append(np.hstack([wide.astype(np.int64), sketch]))
    return np.concatenate(out) if out else np.zeros((0, WIDE + SKETCH), np.int64)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of the multiset sum."""
    return (a + b) & _masks()


def remove(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint after the paragraphs of b are taken out of a."""
    return (a - b) & _masks()


def _masks() -> np.ndarray:
    return np.array([0xFFFFFFFF] * (WIDE + SKETCH), np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1, for each pair of rows."""
    x, y = [v[:, WIDE:].astype(np.uint32).view(np.int32).astype(float) for v in (a, b)]
    same = (a == b).all(axis=1)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = (x * y).sum(1) / np.where(norm > 0, norm, 1)
    return np.where(same, 1.0, np.clip(cosine, 0, 1))


def text_form(v: np.ndarray) -> list[str]:
    """Hexadecimal fingerprints."""
    return [a.tobytes().hex() for a in v.astype(">u4")]


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, fingerprint), one per row of docs."""
    source = text_of(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text_form(vectors(b.column(1))), pa.string())], names=["id", "fingerprint"])

    return source.mapInArrow(tidied(run), f"id {source.schema['id'].dataType.simpleString()}, fingerprint string")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_neighbours(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int | None = None) -> DataFrame:
    """Each text, its edited text (the last half replaced by the beginning of the next
    document) and their fingerprints: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Ids are cut into ranges at quantiles; texts move once, to their range. The first text of
    a range also goes to the range before it (from the first to the last, so that the last
    document has a next one): one more text per range, however many rows there are."""
    spark = docs.sparkSession
    source = text_of(docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))).alias("id"), F.col(text_column).alias("text")))
    n = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = [i / n for i in range(1, n)]
    ids = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))).alias("id"))
    bounds = np.unique(np.array(ids.agg(F.percentile_approx("id", cuts, 100 * n)).first()[0] or [], np.int64))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        for b in batches:
            x = b.column(0).to_numpy()
            at = np.searchsorted(bounds, x, side="right")
            for k in np.unique(at):
                m = int(x[at == k].min())
                low[int(k)] = min(low.get(int(k), m), m)
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array(list(low.values()), pa.int64())], names=["bucket", "low"])

    firsts = sorted(map(tuple, ids.mapInArrow(numbered, "bucket int, low bigint").groupBy("bucket").agg(F.min("low")).collect()))
    before = {low: firsts[i - 1][0] for i, (_, low) in enumerate(firsts)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(sorted(before), np.int64)
        for b in batches:
            x = b.column(0).to_numpy()
            at = np.searchsorted(bounds, x, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(x), np.int32)), b.column(0), b.column(1)], names=["bucket", "after", "id", "text"])
            again = np.flatnonzero(np.isin(x, starts))
            if len(again):
                to = pa.array([before[int(i)] for i in x[again]], pa.int32())
                rows = pa.array(again)
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(again), np.int32)), b.column(0).take(rows), b.column(1).take(rows)], names=["bucket", "after", "id", "text"])

    placed = source.mapInArrow(tidied(dealt), "bucket int, after int, id bigint, text string").repartition(n, "bucket").sortWithinPartitions("bucket", "after", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            held = t.slice(t.num_rows - 1)
            mine = np.flatnonzero(t.column("after").to_numpy()[:-1] == 0)
            if not len(mine):
                continue
            column = t.column("text").combine_chunks()
            texts = column.to_pylist()
            edited = [_edited(texts[i], texts[i + 1]) for i in mine]
            v = vectors(column)
            e = vectors(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    t.column("id").combine_chunks().take(pa.array(mine)), pa.array([len(texts[i]) for i in mine], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array(text_form(v[mine])), pa.array(text_form(e)), pa.array(likeness(v[mine], e)), pa.array(likeness(v[mine], v[mine + 1])),
                ],
                names=names,
            )

    out = placed.mapInArrow(tidied(run), "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("id", F.when(F.col("id") == -(2**63), None).otherwise(F.col("id")))
