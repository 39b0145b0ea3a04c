"""Quality classifier: a sparse rule ensemble.

1. Text statistics: shares of letter case, digits and symbols, word and line lengths,
   repetition of words, word triples and lines (`statistics`, one pass over the bytes).
2. Small trees are grown on bootstrap samples; every path from a root becomes a rule, a
   conjunction of comparisons of statistics.
3. A logistic regression with an L1 penalty weighs the rules; most weights become zero.
4. The remaining rules are compiled into one Spark column expression.

The fit takes a bounded sample of labelled rows: `max_rows`, 20,000 by default, those with
the smallest hash of the id; each tree's bootstrap sample has at most `tree_rows`, 4,000 by default,
of them. Scoring reads every row. The label, language, source and id
are no inputs of a score.

Defined cases: null and empty texts get the score that their statistics (all zero) give;
labels that are null are no training rows; repeated rows count each; with no training rows,
or one class only, the model is a constant (the smoothed share of label 1, at most 0.999); other
columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SPACE, _VALUE, chunks, mix, powers, text_of, words, _BASE, _INVERSE, tidied

_U = np.uint64
_SYMBOLS = "!%$#&*|.,"
_NAMES = ["log_bytes", "log_words", "lines_per_word", "upper", "lower", "digit", "space", "high", *[f"symbol_{i}" for i in range(len(_SYMBOLS))], "symbol_other", "word_bytes", "repeated_words", "top_word", "repeated_triples", "repeated_lines"]
#: Column names; the prefix keeps them apart from the inputs' own.
STATISTICS = [f"__stat_{x}" for x in _NAMES]


def _classes() -> np.ndarray:
    c = np.full(256, 5 + len(_SYMBOLS), np.int64)
    c[65:91], c[97:123], c[48:58], c[128:] = 0, 1, 2, 4
    c[_SPACE] = 3
    for i, s in enumerate(_SYMBOLS):
        c[ord(s)] = 5 + i
    return c


_CLASS = _classes()
_N_CLASS = 6 + len(_SYMBOLS)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and the occurrences of its most frequent one."""
    key = np.sort((doc.astype(np.uint64) << _U(44)) | (h >> _U(20)))
    if not len(key):
        return np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    of = (key[first] >> _U(44)).astype(np.int64)
    size = np.diff(np.append(first, len(key)))
    top = np.zeros(n)
    np.maximum.at(top, of, size)
    return np.bincount(of, minlength=n).astype(float), top


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    doc_of = np.repeat(np.arange(n), np.diff(offs))
    kinds = np.bincount(doc_of * _N_CLASS + _CLASS[data], minlength=n * _N_CLASS).reshape(n, _N_CLASS)
    share = kinds / np.maximum(size, 1)[:, None]
    h, count = words(data, offs)
    of = np.repeat(np.arange(n), count)
    distinct, top = _distinct(of, h, n)
    nz = np.maximum(count, 1)
    with np.errstate(over="ignore"):
        triple = mix(h[:-2] * _U(3) + mix(h[1:-1] * _U(5) + mix(h[2:]))) if len(h) > 2 else np.zeros(0, np.uint64)
    inside = of[:-2] == of[2:] if len(h) > 2 else np.zeros(0, bool)
    t_distinct, _ = _distinct(of[:-2][inside] if len(h) > 2 else np.zeros(0, np.int64), triple[inside], n)
    triples = np.maximum(count - 2, 0)
    # Lines: runs between newlines, blank ones left out.
    cut = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offs, cut, cut + 1]))
    a, b = edges[:-1], edges[1:]
    solid = ~((b - a == 1) & (data[a] == 10)) if len(a) else np.zeros(0, bool)
    a, b = a[solid], b[solid]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * powers(_BASE, len(data)))])
        line = mix((total[b] - total[a]) * powers(_INVERSE, max(len(data), 1))[a]) if len(a) else np.zeros(0, np.uint64)
    line_doc = doc_of[a] if len(a) else np.zeros(0, np.int64)
    lines = np.bincount(line_doc, minlength=n)
    l_distinct, _ = _distinct(line_doc, line, n)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(count), lines / nz, share[:, :3], share[:, 3], share[:, 4], share[:, 5:],
            (size - kinds[:, 3]) / nz, 1 - distinct / nz, top / nz,
            np.where(triples > 0, 1 - t_distinct / np.maximum(triples, 1), 0), np.where(lines > 0, 1 - l_distinct / np.maximum(lines, 1), 0),
        ]
    )


def with_statistics(df: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns `keep` and the statistics of each row's text."""
    inside = text_column in keep and df.schema[text_column].dataType == T.StringType()
    source = df.select(*keep) if inside else text_of(df.select(*keep, F.col(text_column).alias("__text")), "__text")
    at, n = keep.index(text_column) if inside else len(keep), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(at)):
                x = statistics(data, offs)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns[:n]], *[pa.array(x[:, i].copy()) for i in range(x.shape[1])]], names=[*keep, *STATISTICS])

    return source.mapInArrow(tidied(run), T.StructType([*source.schema.fields[:n], *[T.StructField(s, T.DoubleType()) for s in STATISTICS]]))


@dataclass
class Rules:
    """conditions: for each rule (statistic, is_above, threshold) triples; weights in step."""

    intercept: float
    conditions: list[list[tuple[int, bool, float]]]
    weights: list[float]

    def column(self) -> Column:
        """The score as one column expression over the statistics."""
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.conditions, self.weights, strict=True):
            holds = F.lit(True)
            for i, above, t in rule:
                c = F.col(STATISTICS[i])
                holds = holds & (c > t if above else c <= t)
            z = z + F.when(holds, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.conditions, self.weights, strict=True):
            z += w * _holds(rule, x)
        return 1 / (1 + np.exp(-z))


def _holds(rule: list[tuple[int, bool, float]], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, t in rule:
        out &= (x[:, i] > t) == above
    return out


def _grow(x, y, rows, depth, rng, path, out, least=10):
    """Split where the Gini impurity falls most; every node but the root is a rule."""
    if path:
        out.append(path)
    if depth == 0 or len(rows) < 2 * least or y[rows].min() == y[rows].max():
        return
    best = None
    for i in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
        v = x[rows, i]
        for t in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25), method="lower")):
            left = v <= t
            n = left.sum()
            if n < least or len(rows) - n < least:
                continue
            p, q = y[rows][left].mean(), y[rows][~left].mean()
            impurity = n * p * (1 - p) + (len(rows) - n) * q * (1 - q)
            if best is None or impurity < best[0]:
                # The threshold lies midway to the next larger value.
                best = (impurity, i, float(t + (v[~left].min() - t) / 2))
    if best is None:
        return
    _, i, t = best
    left = x[rows, i] <= t
    _grow(x, y, rows[left], depth - 1, rng, [*path, (int(i), False, t)], out, least)
    _grow(x, y, rows[~left], depth - 1, rng, [*path, (int(i), True, t)], out, least)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-3, steps: int = 400, seed: int = 7, tree_rows: int = 4000) -> Rules:
    """Rules of bootstrap trees, weighed by logistic regression with an L1 penalty."""
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Rules(min(base, float(np.log(999))), [], [])
    rng = np.random.default_rng(seed)
    paths: list = []
    for _ in range(trees):
        _grow(x, y, rng.integers(0, len(y), min(len(y), tree_rows)), depth, rng, [], paths)
    unique: dict[bytes, list] = {}
    for rule in paths:
        holds = _holds(rule, x)
        if 0.002 < holds.mean() < 0.998:
            unique.setdefault(np.packbits(holds).tobytes(), rule)
    rules = list(unique.values())
    if not rules:
        return Rules(base, [], [])
    z = np.column_stack([_holds(r, x) for r in rules]).astype(float)
    mean, dev = z.mean(0), z.std(0)
    z = (z - mean) / dev
    step = 4 * len(y) / np.linalg.norm(z, 2) ** 2
    w = v = np.zeros(z.shape[1])
    b, t = base, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ v + b)))
        new = v - step * (z.T @ (p - y) / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= (p - y).mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    kept = np.flatnonzero(w)
    raw = w / dev
    return Rules(float(b - (raw * mean).sum()), [rules[i] for i in kept], [float(raw[i]) for i in kept])


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", max_rows: int = 20_000, **parameters) -> Rules:
    """Fit on a sample of at most `max_rows` labelled rows. At most so many ids are broadcast."""
    order = F.xxhash64(F.col("__id").cast("string"), F.lit(1))
    marked = labels.select(F.col(id_column).alias("__id"), F.col(label_column).cast("double").alias("__label")).where("__id is not null and __label is not null")
    sample = marked.orderBy(order, "__label").limit(max_rows)
    texts = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__doc"))
    rows = with_statistics(texts.join(F.broadcast(sample), "__id"), ["__id", "__label"], "__doc")
    held = rows.orderBy(order, "__label", *STATISTICS).limit(max_rows).drop("__id").toArrow()
    x = np.column_stack([held.column(s).to_numpy() for s in STATISTICS]) if len(held) else np.zeros((0, len(STATISTICS)))
    return fit(x, (held.column("__label").to_numpy() > 0.5).astype(float), **parameters)


def classify(docs: DataFrame, rules: Rules, keep: list[str], text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns `keep`, score and predicted, one row per row of docs."""
    out = with_statistics(docs, keep, text_column)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rules.column()))
    return out.select(*keep, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, rules: Rules, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the rules predict to be of label 1, with their own columns."""
    return with_statistics(docs, docs.columns, text_column).where(rules.column() >= threshold).select(*docs.columns)
