from __future__ import annotations

import json
from datetime import UTC, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attesta.operators import adapters, claims, labels, linkage, profiles, proposals, store



def at():
    return F.lit("2024-01-01").cast("timestamp")

COLUMNS = [x.strip().split()[0] for x in store.SCHEMAS["item"].split(",")]


def test_rows_of_every_kind_have_the_item_columns(spark):
    kind = "id string, name string, scene_count long, description string"
    tags = spark.createDataFrame([("1", "Red Hair", 3, None), ("2", "redhair", 1, None), ("3", "Ivy", 1, None)], kind)
    none = spark.createDataFrame([], "id string")
    people = spark.createDataFrame([("p", "Ivy", [])], "id string, name string, aliases array<string>")
    source = labels.description_index(spark.createDataFrame([("Ivy", [], "told")], "name string, aliases array<string>, description string")).withColumns({"source": F.lit("s"), "ord": F.lit(0)})
    texts = profiles.description_outcomes(spark.createDataFrame([("p", "<b>x</b>")], "id string, description string"))
    merged = spark.createDataFrame([("p", "eye", True, "blue")], "id string, field string, agreed boolean, value string")
    made = [
        proposals.label_merges(labels.cluster_labels(tags), "f", "t", at()),
        proposals.label_descriptions(labels.find_descriptions(tags, source), "f", "t", at()),
        proposals.label_people(labels.match_people(tags, labels.index_people(people)), "f", "t", at()),
        proposals.unused_labels(labels.hygiene(tags, none, none, none, none, none), "f", "t", at()),
        proposals.cleaned_descriptions(texts, "f", "t", at()),
        proposals.enrichments(profiles.fields_map(merged), "f", "t", at()),
    ]
    for df, n in zip(made, (1, 1, 1, 2, 1, 1), strict=True):
        rows = df.collect()
        assert df.columns == COLUMNS and len(rows) == n
        payload = json.loads(rows[0]["payload"])
        assert list(payload) == sorted(payload) and len(rows[0]["fingerprint"]) == 64
    with pytest.raises(PySparkException, match="scenes and a match"):
        unused = labels.match_people(tags.withColumn("scene_count", F.lit(0)), labels.index_people(people))
        proposals.label_people(unused, "f", "t", at()).collect()


def test_positional_replies(spark):
    asked = spark.createDataFrame([(0, "a"), (1, "b")], "ord int, subject string")
    reply = lambda *lists: spark.createDataFrame([(list(lists),)], "lists array<array<string>>")
    assert sorted(map(tuple, claims.positional_reply(asked, reply(["x"], ["y", "z"])).collect())) == [("a", "x"), ("b", "y"), ("b", "z")]
    with pytest.raises(PySparkException, match="one list per subject"):
        claims.positional_reply(asked, reply(["x"])).collect()


def test_owners_over_stores(spark):
    results = spark.createDataFrame([("Ivy", "s", "https://h/ivy/1"), ("Ivy", "t", "https://h/moss/1")], "candidate string, store string, url string")
    stores = {"s": adapters.Adapter("s", "url_segment", 1), "t": adapters.Adapter("t")}
    assert [tuple(r) for r in adapters.owners_of(results, stores).collect()] == [("Ivy", "ivy")]
    assert adapters.owners_of(results, {}).collect() == []


def test_scan_end_to_end(spark):
    kind = "id string, path string, name string, folder string"
    scenes = spark.createDataFrame([("1", "/l/Ivy/a", "Quiet Harbour.mp4", "Ivy"), ("2", "/l/Ivy/b", "Other Words.mp4", "Ivy"), ("3", "/l/Moss/c", "Tea.mp4", "Moss"), ("4", "/l/Ivy/d", "x.mp4", "Ivy"), ("5", "/l/Ivy/e", "Quiet Harbour.mp4", "Ivy")], kind)
    marked = spark.createDataFrame([("5", "/l/Ivy/e", "Quiet Harbour.mp4", "Ivy"), ("6", "/l/Ivy/f", "Quiet Harbour.mkv", "Ivy")], kind)
    old = datetime(2023, 1, 1, tzinfo=UTC)
    items = spark.createDataFrame([("fp", "f", "scene", "9", "s", None, "{}", "p", "new", None, None, old, old, None)], store.SCHEMAS["item"])
    muted = spark.createDataFrame([("scene", "5", "by hand", old), ("scene", "3", "no store has it", old)], store.SCHEMAS["mute"])
    claimed = spark.createDataFrame([("4", "box", 0, "77", True)], "subject string, box string, ord int, site_id string, exact boolean")
    found = spark.createDataFrame([("Ivy", "s", True, 0, "Quiet Harbour", None)], "artist string, store string, resolvable boolean, idx long, title string, url string")
    later = spark.createDataFrame([], "id string, store string, resolvable boolean, idx long, title string, url string")
    stores = spark.createDataFrame([("s", None)], "store string, error string")
    got = linkage.scan(scenes, marked, 6, {"item": items, "mute": muted}, claimed, found, later, stores, spark.createDataFrame([], "key string, full string"), {}, "f", at())
    pick = lambda t, *c: sorted(map(tuple, got[t].select(*c).collect()))
    assert pick("tally", "reason", "n") == [("muted", 1), ("selected", 5)]
    assert pick("gone", "id") == [("9",)]
    assert pick("outcomes", "id", "outcome") == [("1", "proposal"), ("2", "refusal"), ("3", "mute"), ("6", "proposal")]
    assert pick("proposals", "subject_id") == [("1",), ("4",), ("6",)]
    assert pick("mutes", "subject_id") == [("3",)]
