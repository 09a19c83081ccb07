"""Evidence meets one row a name; shuffles of keyed rows grow with what is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import session
from attesta.operators import attribution, changes, outgoing, paging, profiles
from attesta.plans import pass_queries


def test_candidates_meet_one_row_a_name(spark):
    owners = spark.createDataFrame([("ann", "Ann")] * 2 + [("ann", f"ann {k}") for k in range(50)] + [("bob", "bobby"), ("cy", None), ("cy", "")], "candidate string, owner string")
    assert {r["candidate"]: tuple(r)[1:] for r in attribution._support(owners, "candidate", "owner").collect()} == {"ann": (2, 50, True), "bob": (0, 1, False)}
    rows = spark.createDataFrame([(1, 1, "ann"), (1, 0, "bob"), (2, 0, "cy"), (3, 0, "bob"), (3, 1, "cy"), (4, 0, None), (5, 0, "ann"), (5, 1, "ann")], "id long, ordinal int, candidate string")
    supported = {(r["id"], r["candidate"]): (r["exact"], r["prefix"], r["supported"]) for r in attribution.owner_support(rows, owners).collect()}
    assert supported[(5, "ann")] == (2, 50, True) and supported[(2, "cy")] == (0, 0, False) and len(supported) == 7
    made = {r["id"]: (r["resolved"], r["unconfirmed"]) for r in attribution.resolve_by_evidence(rows, owners).collect()}
    assert made == {1: ("ann", []), 2: ("cy", []), 3: (None, ["bob", "cy"]), 5: ("ann", [])}


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(20_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.parts_for(rows) == least
    monkeypatch.setattr(session, "PART_BYTES", 50_000)
    parts = session.parts_for(rows)
    assert parts > 2 * least and session.spread(rows, "id").rdd.getNumPartitions() == parts
    most = paging.ranked(rows.select("id"), ["id"]).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 20_000 / least
    offers = rows.select("id", F.lit("f").alias("field"), F.lit(0).alias("ord"), F.lit("s").alias("source"), F.col("x").alias("value"))
    people = rows.select("id", F.array(F.lit("f")).alias("missing"))
    merged = profiles.enrichment_pass(people, offers, rows.select("id", F.lit("").alias("error")).limit(0))["fields"]
    assert f", {parts})" in merged._jdf.queryExecution().executedPlan().toString()


def test_no_list_of_people_is_ranked(spark, monkeypatch):
    from attesta.operators import selection

    seen, plain = [], selection.chunks
    monkeypatch.setattr(selection, "chunks", lambda rows, *more: seen.append(rows.columns) or plain(rows, *more))
    scenes = spark.createDataFrame([("1", ["p"], ["t"]), ("2", ["q"], ["t"]), ("3", None, ["t"])], "id string, performer_ids array<string>, tag_ids array<string>")
    made = outgoing.reconciliation_edits(scenes, spark.createDataFrame([("f", "t", "p")], "fingerprint string, tag_id string, performer_id string")).collect()
    assert [(r["untagged"], r["attached"]) for r in made] == [(["1", "2", "3"], ["2"])] and "performer_ids" not in seen[0]


def test_a_tally_carries_no_fields(spark):
    people = spark.createDataFrame([(i, ["f", "g"]) for i in range(6)] + [(9, [])], "id long, missing array<string>")
    offers = spark.createDataFrame([(0, "f", 0, "s", "x"), (0, "g", 0, "s", "x"), (0, "g", 1, "t", "y"), (1, "f", 0, "s", "x"), (1, "f", 1, "s", "y"), (2, "f", 0, "s", "x"), (9, "f", 0, "s", "x")], "id long, field string, ord int, source string, value string")
    tally = profiles.enrichment_pass(people, offers, spark.createDataFrame([(2, "timeout"), (3, "timeout"), (8, "timeout")], "id long, error string"))["tally"]
    assert {r["outcome"]: r["n"] for r in tally.collect()} == {"proposed": 1, "conflict": 1, "error": 2, "nothing found": 2}
    assert "map_from_entries" not in tally._jdf.queryExecution().optimizedPlan().toString()


def test_an_undo_moves_keys_once_and_keeps_no_lists(spark, monkeypatch):
    def kept(rows):
        raise AssertionError(f"kept in the shared folder: {rows.columns}")

    monkeypatch.setattr(paging, "written_once", kept)
    back = pass_queries.undone_reconciliation(spark, "/root/testdata/sf0.001")
    assert back.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").distinct().count()
    plan = back._jdf.queryExecution().executedPlan().toString()
    after = [part.split("Project", 2)[1].split("]")[0] for part in plan.split("Exchange hashpartitioning(")[1:]]
    assert after and all("l_suppkey" in columns and "performer_ids" not in columns for columns in after)


def test_scenes_are_reconciled_where_they_lie(spark):
    scenes = spark.createDataFrame([(1, ["p"], ["x", "y", "z"]), (2, [], ["x"]), (3, ["q"], ["z"]), (4, ["q"], None), (None, ["q"], ["x"])], "id long, performer_ids array<string>, tag_ids array<string>")
    pairs = spark.createDataFrame([("x", "q"), ("y", "p"), ("y", "r"), ("w", "s"), (None, "s")], "tag_id string, performer_id string")
    done = changes.reconciled(scenes.repartition(5, "id"), pairs)
    got = sorted((r["id"], r["tag_id"], r["performer_id"], tuple(r["performer_ids"]), tuple(r["tag_ids"]), r["attached"]) for r in done.collect())
    one = (("p", "q", "r"), ("z",))
    assert got == [(1, "x", "q", *one, True), (1, "y", "p", *one, False), (1, "y", "r", *one, True), (2, "x", "q", ("q",), (), True)]
    assert done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
