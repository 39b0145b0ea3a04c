"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Tokens are runs of letters and digits, lower case. Fixed masks of six tokens ignore the
positions between two runs of three: 111111, 111000111 and 111000000111. Of any twelve
aligned tokens with at most two substitutions, two of the four runs of three are intact, so
one of the masks hits: no such overlap is missed.

1. A Bloom filter of the benchmark's token and run hashes (bits by its size, at most 2^22)
   drops almost all positions of the documents inside their rows. It only saves work.
2. The masks' hashes at the remaining positions are joined to the benchmark's; a hit gives a
   document, an item and a diagonal (shift).
3. On each distinct diagonal the tokens are compared. An item is found in a document if, in
   some window of twelve tokens (of the whole item if it is shorter), at least `similarity`
   of the tokens are equal.

Items of 3 to 11 tokens are sought by single runs of three, which misses none at a similarity
of 0.8 but with 5 tokens, those by runs of two. Items of one or two tokens must occur whole;
their hashes decide. Items with equal tokens are sought once and each reported. An item without
tokens matches nothing.

Defined cases: null and empty texts contain nothing; repeated documents and rows are each
reported; other columns are ignored; an empty benchmark or table gives an empty result; among
diagonals the best window counts, and the most equal tokens.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, Scratch, maybe_broadcast, numbered

RUN, WINDOW, OFFSETS = 3, 12, (3, 6, 9)


def token_hashes(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.xxhash64(x))


def run_hashes(th: Column, run: int = RUN) -> Column:
    """Hashes of all runs of `run` tokens."""
    each = F.transform(F.sequence(F.lit(0), F.size(th) - run), lambda i: F.xxhash64(*[th[i + k] for k in range(run)]))
    return F.when(F.size(th) >= run, each).otherwise(F.array().cast("array<bigint>"))


def _bloom(runs: DataFrame):
    """Of a column `g`: a function that gives the SQL of the membership test of an expression.
    The filter is a literal array of 64-bit words, at most 2^16 of them."""
    n, size = runs.count(), 1 << 16
    while size < 32 * n and size < 1 << 22:
        size *= 2
    mask = size - 1
    spots = runs.selectExpr(f"explode(array(g & {mask}L, shiftrightunsigned(g, 32) & {mask}L)) as s")
    words = spots.groupBy(F.expr("cast(shiftright(s, 6) as int) as w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int))) as b"))
    held = [0] * (size // 64)
    for w, b in words.collect():  # at most size / 64 rows
        held[w] = b
    bits = f"from_json('{json.dumps(held)}', 'array<bigint>')"

    def test(x: str) -> str:
        def at(s: str) -> str:
            return f"(shiftrightunsigned(get({bits}, cast(shiftright({s}, 6) as int)), cast({s} & 63 as int)) & 1L) = 1L"

        return f"({at(f'({x} & {mask}L)')} and {at(f'(shiftrightunsigned({x}, 32) & {mask}L)')})"

    return test


def find(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """Rows (id, item_id, tokens, matched, similarity), one for each document row and item
    found in it. matched: equal tokens on the best diagonal; similarity: the best window's."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    said = scratch.put(benchmark.select(F.col(item_column).alias("item_id"), token_hashes(F.col(item_text)).alias("it")).where(F.size("it") > 0), "said")
    # Items with equal tokens are one item, by a number, until the end.
    items = said.groupBy("it").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("item"), "it")
    items = scratch.put(items.select("item", "it", *[run_hashes(F.col("it"), r).alias(f"g{r}") for r in (1, 2, RUN)]), "items")
    size = F.size("it")
    kinds = {1: size == 1, 2: size.isin(2, 5), RUN: size >= RUN}
    lengths = [r for r in kinds if items.where(kinds[r]).limit(1).count()] or [RUN]
    runs = functools.reduce(DataFrame.union, [items.where(kinds[r]).select(F.explode(f"g{r}").alias("g")) for r in lengths])
    test = _bloom(runs)
    short = items.where((size >= RUN) & (size < WINDOW)).limit(1).count() > 0
    offsets = (0, *OFFSETS) if short else OFFSETS

    def seed(g: Column, i: Column, o: Column) -> Column:
        return F.xxhash64(g[i], F.when(o == 0, F.lit(0).cast("bigint")).otherwise(F.get(g, i + o)), o)

    sought = items.where(kinds[RUN]).select("item", F.col(f"g{RUN}").alias("ig"), F.posexplode(f"g{RUN}").alias("item_at", "g"), size.alias("size"))
    sought = sought.select("item", "item_at", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("o"), "ig", "size")
    sought = sought.where((F.col("o") == 0) & (F.col("size") < WINDOW) | (F.col("o") > 0) & (F.col("item_at") + F.col("o") < F.size("ig")))
    sought = sought.select("item", "item_at", seed(F.col("ig"), F.col("item_at"), F.col("o")).alias("seed"))
    for r in (x for x in lengths if x < RUN):  # seeds of shorter runs, marked by -r
        sought = sought.union(items.where(kinds[r]).select("item", F.posexplode(f"g{r}").alias("item_at", "g")).select("item", "item_at", F.xxhash64("g", F.lit(-r))))
    sought = scratch.put(sought, "sought")

    # The projections below stay apart because each refers to the one before several times;
    # the row number keeps the filter from being moved (and worked out) below them.
    one = docs.select(F.col(id_column).alias("id"), token_hashes(F.col(text_column)).alias("th"))
    two = one.select("id", "th", *[run_hashes(F.col("th"), r).alias(f"g{r}") for r in lengths])

    def hot(r: int) -> Column:
        return F.expr(f"filter(sequence(0, greatest(size(g{r}) - 1, 0)), i -> size(g{r}) > 0 and {test(f'g{r}[i]')})").alias(f"hot{r}")

    three = two.select("*", *[hot(r) for r in lengths])
    near = ", ".join(map(str, OFFSETS))
    parts = []
    if RUN in lengths:
        zero = f"array(struct(i as at, xxhash64(g{RUN}[i], 0L, 0) as seed))"
        parts.append(f"flatten(transform(hot{RUN}, i -> concat({zero}, transform(filter(array({near}), o -> i + o < size(g{RUN}) and {test(f'get(g{RUN}, i + o)')}), o -> struct(i as at, xxhash64(g{RUN}[i], get(g{RUN}, i + o), o) as seed)))))")
        if not short:
            parts[0] = parts[0].replace(f"concat({zero}, ", "(")
    if 2 in lengths:
        parts.append("transform(hot2, i -> struct(i as at, xxhash64(g2[i], -2) as seed))")
    if 1 in lengths:  # of each token one place will do
        parts.append("transform(array_distinct(transform(hot1, i -> g1[i])), x -> struct(array_position(g1, x) - 1 as at, xxhash64(x, -1) as seed))")
    hits = f"concat({', '.join(f'cast({x} as array<struct<at:int,seed:bigint>>)' for x in parts)})"
    four = three.select(F.monotonically_increasing_id().alias("row"), "id", "th", F.expr(hits).alias("hits"))
    found = scratch.put(four.where(F.size("hits") > 0), "found")

    diagonals = found.select("row", F.explode("hits").alias("h")).select("row", "h.at", "h.seed").join(maybe_broadcast(sought), "seed")
    diagonals = scratch.put(diagonals.select("row", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "diagonals")
    laid = diagonals.join(found.select("row", "id", "th"), "row").join(maybe_broadcast(items.select("item", "it")), "item")
    equal = laid.select("row", "id", "item", F.size("it").alias("n"), F.expr("transform(it, (x, i) -> if(i + shift >= 0 and coalesce(get(th, i + shift) = x, false), 1, 0))").alias("e"))
    window = f"least({WINDOW}, n)"
    best = f"array_max(transform(sequence(0, n - {window}), s -> aggregate(slice(e, s + 1, {window}), 0, (a, x) -> a + x)))"
    scored = equal.select("row", "id", "item", "n", F.expr("aggregate(e, 0, (a, x) -> a + x)").alias("matched"), (F.expr(best) / F.expr(window)).alias("similarity"))
    scored = scored.groupBy("row", "id", "item").agg(F.max("n").alias("tokens"), F.max("matched").alias("matched"), F.max("similarity").alias("similarity")).where(F.col("similarity") >= similarity)
    named = scratch.put(items.select("item", "it").join(said, "it").select("item", "item_id"), "named")
    return scored.join(maybe_broadcast(named), "item").select("id", "item_id", "tokens", "matched", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **parameters) -> DataFrame:
    """The rows of docs in whose text no item is found, row by row: equal or null ids don't
    make other rows go."""
    scratch = Scratch(docs.sparkSession, "contaminated")
    rows = numbered(docs, scratch)
    found = find(rows, benchmark, ROW, text_column, **parameters)
    gone = scratch.put(found.select(F.col("id").alias(ROW)).distinct(), "rows")
    return rows.join(maybe_broadcast(gone), ROW, "left_anti").select(*docs.columns)
