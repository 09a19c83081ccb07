"""Passes that tie operators together: listing checks, enrichment, error rows, scan status, pages by key, ticks with state."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attesta.operators import actions, decisions, labels, listings, paging, produce, profiles, schedule, store, views
from attesta.streaming import ticks


def test_a_listing_check_ends_in_verdicts_and_counts(spark):
    files = spark.createDataFrame([("1", "Quiet Harbour.mp4", "Ivy"), ("2", "Stone Bridge.mp4", "Ivy"), ("3", "Tea Time.mp4", "Moss"), ("4", "Old Mill.mp4", "Fern"), ("5", "x.mp4", ""), ("6", "Lost Key.mp4", "Oak"), ("7", "Blue Door.mp4", "Ash")], "id string, name string, folder string")
    none = "string"
    people = [("1", "Ivy", None, None), ("2", "Ivy", None, None), ("3", "Moss", "Other", None), ("4", "Fern", None, None), ("5", None, None, None), ("6", "Oak", None, None), ("7", "Ash", None, None)]
    resolutions = spark.createDataFrame(people, f"id string, name {none}, competing {none}, rejected_folder {none}")
    ids = spark.createDataFrame([("Ivy", "p1"), ("Moss", "p2"), ("Oak", "p4"), ("Ash", "p5")], "artist string, performer_id string")
    rows = spark.createDataFrame([("p1", 0, "Quiet Harbour"), ("p1", 1, "Other Words Entirely"), ("p2", 0, "Nothing Alike Here")], "performer_id string, idx long, title string")
    states = spark.createDataFrame([("p1", 2, True, None), ("p2", 1, True, None), ("p4", 0, False, "timeout"), ("p5", 0, True, None)], "performer_id string, rows long, complete boolean, error string")
    got = listings.check_listings(files, resolutions, ids, rows, states)
    assert {r["id"]: (r["unlisted"], r["why"]) for r in got["verdicts"].collect()} == {"1": (False, "present"), "2": (True, "unlisted"), "3": (None, "attribution uncertain"), "7": (True, "unlisted")}
    assert {r["id"]: r["why"] for r in got["skipped"].collect()} == {"4": "no id is known for the creator", "5": "no creator resolved", "6": "the listing could not be read: timeout"}
    assert tuple(got["counts"].first()) == (4, 2, 1, 1, 3)


def test_an_enrichment_pass_goes_on_after_errors(spark):
    people = spark.createDataFrame([("a", ["eye", "country"]), ("b", ["eye"]), ("c", ["eye"]), ("d", []), ("e", ["eye"])], "id string, missing array<string>")
    offers = spark.createDataFrame([("a", "eye", 0, "s", "blue"), ("a", "country", 0, "s", "NO"), ("a", "country", 1, "t", "SE"), ("a", "gender", 0, "s", "F"), ("b", "eye", 0, "s", "red"), ("c", "eye", 0, "s", "x"), ("d", "eye", 0, "s", "y")], "id string, field string, ord int, source string, value string")
    errors = spark.createDataFrame([("c", "timeout"), ("d", "not asked")], "id string, error string")
    got = profiles.enrichment_pass(people, offers, errors)
    assert {r["id"]: r["fields"] for r in got["fields"].collect()} == {"a": {"eye": "blue"}, "b": {"eye": "red"}}
    assert [(r["id"], r["field"]) for r in got["conflicts"].collect()] == [("a", "country")] and [tuple(r) for r in got["errors"].collect()] == [("c", "timeout")]
    assert {r["outcome"]: r["n"] for r in got["tally"].collect()} == {"proposed": 2, "error": 1, "nothing found": 1}
    assert {r["outcome"]: r["n"] for r in profiles.enrichment_pass(people, offers, errors, 1)["tally"].collect()} == {"proposed": 1}


def test_one_bad_row_is_one_error_row(spark):
    def make(row):
        if row["id"] == 4321:
            raise ZeroDivisionError("this row")
        if row["id"] % 10 == 7:
            return []
        return [{"double": 2 * row["id"], "text": row["text"]}]

    rows = spark.range(10_000).select("id", F.when(F.col("id") % 2 == 0, "x").alias("text"))
    got = produce.produce(rows, make, "double long, text string")
    assert tuple(produce.tally(got).first()) == (8999, 1)
    assert [tuple(r) for r in produce.failed(got).collect()] == [(4321, "ZeroDivisionError: this row")]
    assert produce.made(got).where("double <> 2 * id or (text is null) <> (id % 2 = 1)").count() == 0


def test_sources_that_were_not_read_are_counted(spark):
    rows = spark.createDataFrame([("s", 0, "Red", [], "warm"), ("s", 0, "red!", [], "other"), ("t", 1, "Red", [], "told"), ("u", 2, "Red", [], "half")], "source string, ord int, name string, aliases array<string>, description string")
    errors = spark.createDataFrame([("u", "ended early"), ("v", "timeout"), ("s", None)], "source string, error string")
    index, unread = labels.source_indexes(rows, errors)
    assert sorted(map(tuple, index.collect()), key=str) == [("red", "told", False, "t", 1), ("red", None, True, "s", 0)]
    assert unread.first()["unread"] == 2


def test_a_scan_starts_once(spark):
    log = spark.createDataFrame([("1", "scan", "hand", datetime(2024, 1, 1), datetime(2024, 1, 2), "finished", {"n": 3}, None, 1)], store.SCHEMAS["run"])
    new = spark.createDataFrame([("2", "scan", "hand", datetime(2024, 1, 3), None, None, None, None, 2)], store.SCHEMAS["run"])
    assert (r := actions.scan_status(log).first())["state"] == "finished" and r["may_start"] and r["counts"] == {"n": 3}
    begun = actions.start_scan(log, new)
    assert actions.scan_status(begun).first()["state"] == "running" and actions.scan_status(log.limit(0)).first()["state"] == "never"
    with pytest.raises(Exception, match="a scan is running"):
        actions.start_scan(begun, new).collect()


def test_runners_up_have_their_own_address(spark):
    candidates = spark.createDataFrame([("s", k, 0.9 - k / 10, f"t{k}", f"http://{k}") for k in range(5)], "subject string, idx long, value double, title string, url string")
    decided = spark.createDataFrame([("s", "chosen", 0)], "subject string, outcome string, idx long")
    got = views.runner_up_view(decisions.runners_up(candidates, decided)).first()
    assert [(x["title"], x["url"]) for x in got["runners_up"]] == [("t1", "http://1"), ("t2", "http://2"), ("t3", "http://3")]


def test_pages_by_key_are_the_pages_by_offset(spark, tmp_path):
    rng = random.Random(1)
    rows = [(None if k % 50 == 0 else rng.randrange(40), f"k{k:04d}", k) for k in range(1003)]
    df = spark.createDataFrame(rows, "at int, key string, more int").repartition(5)
    order = ["at", "key"]
    starts = paging.page_starts(df, order, 100)
    plain = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert starts.count() == 11
    for page in (1, 2, 7, 11, 12):
        assert [tuple(r) for r in paging.page_at(df, starts, order, page).collect()] == plain[100 * (page - 1) : 100 * page]
    df.sort(*order).write.parquet(str(tmp_path / "t"))
    plan = paging.page_at(spark.read.parquet(str(tmp_path / "t")), starts, order, 7)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at" in plan and "LessThanOrEqual(at" in plan


def entries(spark):
    rows = [("often", 3600.0, None, None, True), ("daily", None, "02:30:00", "Europe/Berlin", True), ("west", None, "01:30:00", "America/New_York", True), ("off", 60.0, None, None, False)]
    return spark.createDataFrame(rows, schedule.ENTRY)


def test_ticks_with_state_agree_with_due_over_clock_changes(spark, tmp_path):
    times = [datetime(2024, 3, 30, 20, tzinfo=UTC) + timedelta(minutes=40 * k) for k in range(40)] + [datetime(2024, 10, 26, 20, tzinfo=UTC) + timedelta(minutes=55 * k) for k in range(40)] + [datetime(2024, 11, 2, 20, tzinfo=UTC) + timedelta(hours=k) for k in range(20)]
    for k in range(0, len(times), 25):
        part = spark.createDataFrame([(t,) for t in times[k : k + 25]], "now timestamp")
        entries(spark).crossJoin(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(f"{schedule.ENTRY}, now timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ordered = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: spark.read.parquet(str(p)).agg(F.min("now")).first()[0])
    for k, p in enumerate(ordered):  # the source takes files by the time they were written
        import os

        os.utime(p, (1_700_000_000 + k * 10, 1_700_000_000 + k * 10))
    query = ticks.ticks_due(source).writeStream.format("memory").queryName("ticked").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["producer"], r["now"].replace(tzinfo=UTC)): r["reason"] for r in spark.table("ticked").collect()}
    assert len(got) == 4 * len(times)
    # the same by the run log, tick by tick
    last: dict[str, datetime] = {}
    asked = []
    for t in times:
        for name in ("often", "daily", "west", "off"):
            asked.append((name, t, last[name].isoformat() if name in last else None))
            if got[name, t] not in ("disabled", "not yet"):
                last[name] = t
    table = spark.createDataFrame(asked, "producer string, now timestamp, at string").select(F.concat_ws("|", "producer", F.unix_micros("now").cast("string")).alias("k"), "*")
    own = entries(spark).withColumnRenamed("producer", "p")
    each = table.join(own.withColumnRenamed("at", "time"), F.col("producer") == F.col("p")).select("k", "producer", "now", F.col("at").alias("ran"), F.struct("every", F.col("time").alias("at"), "zone", "enabled").alias("e"))
    rows = each.select(F.col("k").alias("producer"), "e.*", "now")
    judged = schedule.due(rows.select("producer", "every", "at", "zone", "enabled", "now"), each.where("ran is not null").select(F.col("k").alias("producer"), F.col("ran").alias("at")), F.col("now"))
    told = {r["producer"]: r["reason"] for r in judged.collect()}
    assert {f"{p}|{int(t.timestamp() * 1_000_000)}": why for (p, t), why in got.items()} == told
    assert sum(w == "due" for (p, _), w in got.items() if p == "daily") >= 3


def test_chunks_of_a_frequent_value_are_dealt(spark):
    from attesta.operators import selection

    rows = [("hot" if k % 4 else None if k % 8 else "cold", f"{k:05d}", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "tag string, id string, more int").repartition(6)
    for within in ("tag", None):
        groups: dict = {}
        for tag, id_, _ in sorted(rows, key=lambda r: r[1]):
            groups.setdefault(tag if within else 0, []).append(id_)
        plain = {i: k // 200 for ids in groups.values() for k, i in enumerate(ids)}
        got = selection.chunks(df, "id", 200, within)
        assert got.columns == ["tag", "id", "more", "chunk"] and {r["id"]: r["chunk"] for r in got.collect()} == plain
