"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are words (A-Z as a-z) and one end symbol per text. The root of the tree gives
every symbol its add-one smoothed share. With N training symbols, a context (the one to `depth`
words before a symbol; the end symbol stands before a text's first word) becomes a state when

* at least max(4, sqrt(N) / `contexts`) symbols follow it, and
* its next-symbol distribution diverges from that of its longest retained suffix: the
  log-likelihood gain over its occurrences, an empirical KL divergence times their number,
  is at least `least_gain` nats and `least_rate` nats an occurrence.

A state keeps explicit probabilities for next symbols that follow it at least
max(4, sqrt(N) / `symbols`) times (counts absolutely discounted); the other symbols
share the rest in the proportions of the suffix state, so each distribution sums to one.
A symbol is scored in the state of its longest retained context.

Scale: words travel as 64-bit hashes. Counting pre-aggregates in each task. A level has at most
`contexts` * sqrt(N) states and `symbols` * sqrt(N) explicit probabilities of 16 bytes; these are
collected and broadcast. So the tree grows with the corpus, without bound but by its square
root (30 GB of text: at most 4 million explicit probabilities a level). The vocabulary grows
faster and is never broadcast. It isn't needed whole either: a word that is no explicit symbol
anywhere has, in each state, the root's share times factors that its context alone gives. So
one pass scores all but the counts of rare words; their logarithms are summed by row, after a
join of the rare words with the counts. Texts are not moved. No rare word of the training
texts is hot, by definition.

Defined cases: a null or empty text is one end symbol; repeated rows are scored (and, in
training, counted) each; an empty training set gives every symbol the share 1 / (0 + 0 + 1);
input columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, mix, text_of, tidied, words

END = np.uint64(0xE0D0_0000_0000_0001)
#: Distinct keys a counting task holds before it passes them on.
HELD = 1_000_000


def stream(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in order (each with its end), and the index after each text's end."""
    h, counts = words(data, offs)
    ends = np.cumsum(counts + 1)
    out = np.empty(len(h) + len(counts), np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends - 1] = True
    out[is_end] = END
    out[~is_end] = h
    return out, ends


def before(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol before each; END before a text's first."""
    out = np.empty_like(symbols)
    out[0] = END
    out[1:] = symbols[:-1]
    return out


def find_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of keys in a sorted array, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def _counted(docs: DataFrame, keys_of, text_column: str) -> DataFrame:
    """(k, c): how often each key that `keys_of(symbols, ends)` gives occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            k = np.concatenate([x for x, _ in held])
            c = np.concatenate([x for _, x in held])
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return k[first], np.add.reduceat(c, first)

        def out():
            k, c = held[0]
            for i in range(0, len(k), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 200_000]), pa.array(c[i : i + 200_000])], names=["k", "c"])

        for b in batches:
            for _, _, data, offs in chunks(b.column(0), 8_000_000):
                keys = keys_of(*stream(data, offs))
                if not len(keys):
                    continue
                k, c = np.unique(keys.view(np.int64), return_counts=True)
                held.append((k, c))
                size += len(k)
                if size > HELD:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from out()
                        held.clear()
                        size = 0
        if held:
            held[:] = [merged()]
            yield from out()

    return docs.select(text_column).mapInArrow(tidied(run), "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c"))


@dataclass
class Level:
    """The states of one context length, in order of their sorted keys."""

    keys: np.ndarray  # contexts' keys
    rest: np.ndarray  # factor on the suffix state's probability for other symbols
    pairs: np.ndarray  # sorted: state * 2^32 + symbol's number
    explicit: np.ndarray  # probabilities of the pairs


@dataclass
class Tree:
    total: int  # N: training symbols
    distinct: int  # V
    symbols: np.ndarray  # sorted hashes of the numbered (frequent) symbols
    counts: np.ndarray  # their training counts
    levels: list[Level]
    ends: int = 0  # end symbols, one per training text; no floor applies

    def root(self, c: np.ndarray) -> np.ndarray:
        return (c + 1.0) / (self.total + self.distinct + 1.0)

    def factors(self, symbols: np.ndarray, ends: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Probability of each symbol of a stream, given the root's probabilities. For a symbol
        without a number it is `root` times a factor of its context alone."""
        p = root
        number = find_in(self.symbols, symbols)
        keys = None
        for level in self.levels:
            keys = context_keys(keys, symbols, ends)
            p = step(level, find_in(level.keys, keys), number, p)
        return p


def context_keys(shorter: np.ndarray | None, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Before each symbol the key of the context one word longer than those of `shorter` (None:
    of one word); 0 where the text has none."""
    last = before(symbols, ends)
    first = np.concatenate([[0], ends[:-1]])
    if shorter is None:
        last[first] = END
        return last
    older = np.empty_like(shorter)
    older[0] = 0
    older[1:] = shorter[:-1]
    older[first] = 0
    return np.where(older != 0, context_key(older, last), np.uint64(0))


def context_key(older: np.ndarray, newer: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(older * np.uint64(0xC2B2AE3D27D4EB4F) + mix(newer)) | np.uint64(1)


def step(level: Level, state: np.ndarray, number: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities in the states (-1: none, stay with p)."""
    inside = np.flatnonzero(state >= 0)
    if not len(inside):
        return p
    s, n = state[inside], number[inside]
    at = find_in(level.pairs, np.where(n >= 0, (s << 32) | n, -1))
    out = p.copy()
    out[inside] = np.where(at >= 0, level.explicit[at] if len(level.explicit) else 0.0, level.rest[s] * p[inside])
    return out


def _retained(keys, pairs, counts, followed, parent_of, least_gain, least_rate) -> tuple[Level, np.ndarray]:
    """Divergence tests. pairs: state * 2^32 + symbol; parent_of(states, symbols) gives
    the probabilities in the states' longest retained suffix. Also gives which contexts stay."""
    state, number = pairs >> 32, pairs & 0xFFFFFFFF
    parent = parent_of(state, number)
    n = followed.astype(float)
    shared = np.clip(counts - 0.5, 1e-9, None) / n[state]
    size = len(keys)
    taken = np.bincount(state, shared, size)
    under = np.bincount(state, parent, size)
    rest = np.clip(1 - taken, 1e-12, None) / np.clip(1 - under, 1e-12, None)
    gain = np.bincount(state, counts * np.log(shared / parent), size)
    gain += np.clip(n - np.bincount(state, counts, size), 0, None) * np.log(rest)
    keep = (gain >= least_gain) & (gain >= least_rate * n)
    place = np.cumsum(keep) - 1
    mine = keep[state]
    level = Level(keys[keep], rest[keep], (place[state[mine]] << 32) | number[mine], shared[mine])
    order = np.argsort(level.pairs)
    level.pairs, level.explicit = level.pairs[order], level.explicit[order]
    return level, keep


def _collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a table whose size is bounded by its threshold."""
    t = df.select("k", "c").toArrow()
    return t.column("k").to_numpy().astype(np.int64), t.column("c").to_numpy().astype(np.int64)


def learn(train: DataFrame, counts: DataFrame, text_column: str = "text", contexts: float = 8.0, symbols: float = 50.0, least_gain: float = 12.0, least_rate: float = 0.002, depth: int = 4) -> Tree:
    """Fit a tree. counts: (k, c) of `train`'s symbols, a written table."""
    spark = train.sparkSession
    said = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = int(said[0] or 0), int(said[1])
    ends = counts.where(F.col("k") == int(END.view(np.int64))).agg(F.sum("c")).first()[0]
    floor, need = (max(4, math.ceil(math.sqrt(total) / x)) for x in (symbols, contexts))
    need = max(need, floor)
    k, c = _collected(counts.where(F.col("c") >= floor))
    order = np.argsort(k.view(np.uint64))
    known, sizes = k.view(np.uint64)[order], c[order]
    tree = Tree(total, distinct, known, sizes, [], int(ends or 0))
    share = tree.root(sizes)
    # Candidates: their words, from old to new, and how many symbols follow.
    often = sizes >= need
    said, followed = known[often][:, None], sizes[often]
    while len(said) and len(tree.levels) < depth:
        length = said.shape[1]
        key = _key(said)
        order = np.argsort(key)
        key, said, followed = key[order], said[order], followed[order]
        held = spark.sparkContext.broadcast((known, key, length))

        def pairs_of(h, ends):
            numbered, states, length = held.value
            at = None
            for _ in range(length):
                at = context_keys(at, h, ends)
            s, n = find_in(states, at), find_in(numbered, h)
            both = (s >= 0) & (n >= 0)
            return (s[both] << 32) | n[both]

        pairs, seen = _collected(_counted(train, pairs_of, text_column).where(F.col("c") >= floor))

        def parent(state, number):
            p = share[number]
            for d, level in enumerate(tree.levels, 1):
                p = step(level, find_in(level.keys, _key(said[:, -d:]))[state], number, p)
            return p

        level, _ = _retained(key, pairs, seen, followed, parent, least_gain, least_rate)
        tree.levels.append(level)
        # One word longer: what follows a candidate often enough and is no end.
        state, newer = pairs >> 32, known[pairs & 0xFFFFFFFF]
        longer = (seen >= need) & (newer != END)
        said, followed = np.column_stack([said[state[longer]], newer[longer]]), seen[longer]
    return tree


def _key(said: np.ndarray) -> np.ndarray:
    """The contexts' keys, from rows of words."""
    key = said[:, 0]
    for i in range(1, said.shape[1]):
        key = context_key(key, said[:, i])
    return key


def score(docs: DataFrame, train: DataFrame, id_column: str = "doc_id", text_column: str = "text", scratch: Scratch | None = None, **parameters) -> DataFrame:
    """Rows (id, n_tokens, n_known, base_score, score, train_tokens), one per row of docs,
    scored by a tree that `train` gives (its keyword parameters: see `learn`)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffix-tree")
    train = text_of(train.select(F.col(text_column).alias("text")))
    docs = text_of(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))
    counts = scratch.put(_counted(train, lambda h, ends: h, "text"), "counts")
    tree = learn(train, counts, **parameters)
    model = spark.sparkContext.broadcast(tree)
    least = int(tree.counts.min()) if len(tree.counts) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = model.value
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(2)):
                h, ends = stream(data, offs)
                at = find_in(tree.symbols, h)
                n = np.where(at >= 0, tree.counts[at] if len(tree.counts) else 0, 0)
                n[ends - 1] = tree.ends
                settled = at >= 0
                settled[ends - 1] = True
                root = np.where(settled, tree.root(n), 1.0)
                first = np.concatenate([[0], ends[:-1]])
                sums = [np.add.reduceat(x, first) for x in (np.ones(len(h), np.int64), (n > 0).astype(np.int64), np.log10(root), np.log10(tree.factors(h, ends, root)))]
                rare = h[~settled].view(np.int64)
                cuts = np.concatenate([[0], np.cumsum(np.add.reduceat(~settled, first, dtype=np.int64))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns[:2]], *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(cuts), pa.array(rare))], names=names)

    names = ["row", "id", "n_tokens", "n_known", "base", "score", "rare"]
    of = docs.schema["id"].dataType.simpleString()
    # Written once, so that each row keeps its number.
    settled = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(tidied(run), f"row bigint, id {of}, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>")
    settled = scratch.put(settled, "settled")
    asked = settled.select("row", F.explode("rare").alias("k"))
    found = counts.where(F.col("c") < least) if least else counts
    share = F.log10((F.coalesce("c", F.lit(0)) + 1.0) / F.lit(tree.total + tree.distinct + 1.0))
    rest = asked.join(found, "k", "left").groupBy("row").agg(F.sum(share).alias("more"), F.count("c").alias("known"))
    out = settled.drop("rare").join(rest, "row", "left")
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return out.select("id", "n_tokens", (F.col("n_known") + known).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"), F.lit(tree.total).cast("long").alias("train_tokens"))
