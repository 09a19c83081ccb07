"""The ratio of benchmark items reads whole documents."""

from __future__ import annotations

from difflib import SequenceMatcher

import pytest

from attesta import session
from attesta.plans.linkage_queries import ratio_similarity


def test_items_late_in_a_text_count(spark, tmp_path):
    item = "quagga zebra okapi"
    texts = {1: "filler words " * 60 + item, 2: item}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["ratio"] for r in ratio_similarity(spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(round(SequenceMatcher(None, item, t).ratio(), 3)) for i, t in texts.items()}


def test_only_texts_of_pairs_are_moved_and_normalised(spark, tmp_path, monkeypatch):
    texts = [(1, "Quagga, zebra & OKAPI"), (2, "nothing of it"), (3, "okapi zebra quagga and filler"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "quagga zebra okapi")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = [(7, 1, round(SequenceMatcher(None, "quagga zebra okapi", "quagga zebra and okapi").ratio(), 3)), (7, 3, round(SequenceMatcher(None, "quagga zebra okapi", texts[2][1]).ratio(), 3))]
    made = ratio_similarity(spark, str(tmp_path))
    assert sorted(map(tuple, made.collect())) == expected
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count(read := "struct<doc_id:bigint,text:string>") == 1 and plan.index("decompose") < plan.index("Join") < plan.index(read)
    monkeypatch.setattr(session, "FEW", 1)  # more pairs than may be broadcast
    assert sorted(map(tuple, ratio_similarity(spark, str(tmp_path)).collect())) == expected
