"""Pairs by bounded candidates against all pairs."""

from __future__ import annotations

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from attesta.operators import matching, selection


def keys(rng, n, longest):
    return list(dict.fromkeys("".join(rng.choice("abcé1") for _ in range(rng.randrange(longest))) for _ in range(n)))


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_loses_no_pair(spark, seed):
    rng = random.Random(seed)
    a, b = keys(rng, 120, 9), ["", "ab", "cabd", "é", "cabdx", *keys(rng, 90, 5)]
    a.append("cabd")
    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in dict.fromkeys(b)], "b string")
    got = sorted(map(tuple, matching.containment_pairs(left, right).collect()))
    assert got == sorted({(x, y) for x in a for y in b if x and y and (x in y or y in x)})
    assert ("cabd", "ab") in got


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_recall_loses_no_pair(spark, least):
    rng = random.Random(3)
    words = [f"w{int(k**1.5)}" for k in range(40)]
    items = [(i, [rng.choice(words + ["nowhere", "else"] * (i % 4)) for _ in range(rng.randrange(12))]) for i in range(40)]
    docs = [(d, [rng.choice(words[: rng.randrange(3, 40)]) for _ in range(rng.randrange(40))]) for d in range(60)] + [(100 + k, list(words)) for k in range(3)]
    made = matching.recall_pairs(spark.createDataFrame(items, "item_id int, words array<string>"), spark.createDataFrame(docs, "doc_id int, words array<string>"), least)
    plain = [(i, d, sum(x in t for x in w) / len(w)) for i, w in items for d, t in docs if w]
    assert sorted(map(tuple, made.collect())) == sorted(x for x in plain if x[2] >= least - 1e-12)


@pytest.mark.parametrize("least", [0.2, 0.6, 0.9])
def test_ratio_loses_no_pair(spark, least):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    base = [make(rng.randrange(1, 60)) for _ in range(25)]
    edited = ["".join(c for c in x if rng.random() > 0.1) + make(2) for x in base]
    items = [(i, x) for i, x in enumerate([*base, ""])]
    docs = [(i, x) for i, x in enumerate([*edited, *[make(rng.randrange(80)) for _ in range(30)], ""])]
    made = matching.ratio_pairs(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string"), least)
    plain = [(i, d, 1.0 if x == y else SequenceMatcher(None, x, y).ratio() if x and y else 0.0) for i, x in items for d, y in docs]
    assert sorted(map(tuple, made.collect())) == sorted((i, d, round(r, 3)) for i, d, r in plain if r >= least)


def test_a_hot_key_is_cut(spark):
    left = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("artist"), "id")
    right = spark.createDataFrame([(x, k) for x in ["hot", *[f"k{i}" for i in range(500)], "none"] for k in range(3)] + [(None, 1)], "artist string, idx int")
    got = matching.dealt_join(left.union(spark.createDataFrame([(None, 1)], "artist string, id long")), right, "artist", rows=2000)
    assert got.columns == ["artist", "id", "idx"]
    assert got.count() == left.join(right, "artist").count() and got.distinct().count() == got.count()
    # rows of the hot key by the part they were dealt to, read from the plan's own expression
    parts = Counter(r[0] for r in left.where("artist = 'hot'").select(F.pmod(F.xxhash64("artist", "id"), F.lit(10))).collect())
    assert len(parts) == 10 and max(parts.values()) < 1.2 * 2000


def test_a_sweep_fails_closed(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    stored = ids(1, 2, 3, 3)
    sweep = lambda present, n: sorted(r[0] for r in selection.gone_sweep(stored, present, n).collect())
    assert sweep(ids(1, 5), 2) == [2, 3]
    assert sweep(ids(1, 5), 3) == [] and sweep(ids(1, 5), 1) == [] and sweep(ids(1, 1), 2) == [] and sweep(ids(), 0) == []
    told = spark.createDataFrame([(2,)], "n long")
    assert sweep(ids(1, 5), told) == [2, 3] and sweep(ids(1), told) == []


def test_recall_moves_words_once_dealt_by_document(spark, tmp_path):
    words = lambda *x: [f"w{k}" for k in x]
    spark.createDataFrame([(1, words(1, 2, 3)), (1, words(3, 4)), (2, words(1, 2)), (None, words(1, 2, 3, 4, 5))], "doc_id int, words array<string>").write.parquet(f"{tmp_path}/docs")
    items = spark.createDataFrame([(7, words(1, 2, 2)), (7, words(3, 4)), (8, words(1, 9)), (None, words(1)), (9, [])], "item_id int, words array<string>")
    made = matching.recall_pairs(items, spark.read.parquet(f"{tmp_path}/docs"), 0.6)
    assert sorted(map(tuple, made.collect()), key=str) == [(7, 1, 1.0), (7, 2, 0.6), (7, None, 1.0)]
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("docs") == 1 and plan.count("hashpartitioning(doc_id") == 1 and "hashpartitioning(w" not in plan.split("BroadcastExchange")[0]
