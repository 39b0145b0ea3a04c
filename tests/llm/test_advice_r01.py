
import math

import numpy as np
import pytest

from tessella.llm import bag_minhash, decontaminate, suffix_tree
from tessella.llm.common import Scratch


def unique(n, tag):
    return [f"{tag}x{i}" for i in range(n)]


def test_large_buckets_are_compared_whole(spark):
    """300 texts of similarity 0.75 share buckets; ten pairs of 0.81 among them."""
    common, rows = unique(343, "c"), []
    for i in range(290):
        rows.append((i, " ".join(common + unique(57, f"u{i}"))))
    for k in range(10):
        rows.append((1000 + k, " ".join(common + unique(57, f"u{k * 29}")[:16] + unique(41, f"v{k}"))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.class_id for r in bag_minhash.near_duplicates(docs).collect()}
    assert got == {i: (i - 1000) * 29 if i >= 1000 else i for i, _ in rows}


def test_prefix_join_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    bags = [np.sort(rng.choice(60, int(rng.integers(20, 40)), replace=False)).astype("<u4") * np.uint32(70_000_001) for _ in range(60)]
    bags += [np.sort(b[rng.random(len(b)) < 0.92]) for b in bags]
    table = spark.createDataFrame([(i, np.sort(b).tobytes()) for i, b in enumerate(bags)], "node long, bag binary")
    component = spark.range(len(bags)).selectExpr("id as node", "id % 7 as root")
    got = {(r.a, r.b) for r in bag_minhash.candidates(table, component, 0.8, Scratch(spark, "test")).collect()}
    want = {(i, j) for j in range(len(bags)) for i in range(j) if i % 7 != j % 7 and bag_minhash.similarity(np.sort(bags[i]).tobytes(), np.sort(bags[j]).tobytes()) >= 0.8}
    assert want <= got and len(want) > 30


def test_rows_of_one_id_are_judged_by_themselves(spark):
    a, b, c, d = (" ".join(unique(100, t)) for t in "abcd")
    near = b.replace("bx50", "other")
    rows = [(8, a), (8, b), (9, near), (None, c), (None, d), (None, c), (8, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in bag_minhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(8, a), (8, b), (None, c), (None, d)], key=str)
    bench = spark.createDataFrame([(1, " ".join(unique(30, "b"))), (2, " ".join(unique(30, "d")))], "item_id long, text string")
    clean = [(r.doc_id, r.text) for r in decontaminate.drop_contaminated(docs, bench).collect()]
    assert sorted(clean, key=str) == sorted([(8, a), (None, c), (None, c), (8, a)], key=str)


def test_end_symbols_of_few_training_texts_count(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    got = {r.id: r for r in suffix_tree.score(docs, docs).collect()}
    share = math.log10((2 + 1) / (6 + 3 + 1))  # a, b and the end occur twice each
    assert got[1].n_known == 4 and got[2].n_known == 2 and got[1].train_tokens == 6
    assert got[1].base_score == pytest.approx(4 * share) and got[2].base_score == pytest.approx(2 * share)
