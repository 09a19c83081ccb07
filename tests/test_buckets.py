"""The bucketed table: what a batch reads and writes, replays, crashes, rivals, cleaning."""

from __future__ import annotations

import hashlib
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attesta.operators import store
from attesta.sources import buckets

AT = datetime(2024, 1, 1, tzinfo=UTC)


def items(spark, keys, at=AT, state="new"):
    rows = [(hashlib.sha256(str(k).encode()).hexdigest(), "f", "scene", str(k), "s", None, "{}", "p", state, None, None, at, at, None) for k in keys]
    return spark.createDataFrame(rows, store.SCHEMAS["item"])


@pytest.fixture
def none(spark):
    return [spark.createDataFrame([], store.SCHEMAS[n]) for n in ("dismissal", "mute")]


def table(spark, path, n=32):
    return buckets.BucketedTable(spark, str(path), store.SCHEMAS["item"], buckets=n, hex_key=True)


def recorded(none):
    return lambda rows, batch: store.record(rows, batch, *none)


def shown(df):
    return sorted((r["subject_id"], r["state"], r["last_seen_at"]) for r in df.collect())


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path, none):
    own = table(spark, tmp_path / "t")
    first = own.merge(items(spark, range(400)), recorded(none))
    assert first["rewritten"] == 32 and own.read().count() == 400
    later = datetime(2024, 2, 1, tzinfo=UTC)
    batch = items(spark, [7, 1000], later)
    second = own.merge(batch, recorded(none))
    hit = {str(b) for b in own.touched(batch)}
    assert second["rewritten"] == len(hit) <= 2
    assert {b for b in second["folders"] if second["folders"][b] != first["folders"].get(b)} == hit
    whole = store.record(store.record(own.read(0), batch, *none), batch, *none)
    assert shown(own.read()) == shown(whole) and own.read(0).count() == 400
    assert len(own.read(buckets=own.touched(batch)).inputFiles()) == len(hit)  # nothing else is read


def test_ranges_of_digests_are_even_and_stable(spark, tmp_path):
    own = table(spark, tmp_path / "t", 4)
    rows = spark.createDataFrame([("0" * 64,), ("3f" + "f" * 62,), ("40" + "0" * 62,), ("f" * 64,), (None,), ("not hex",)], "fingerprint string")
    assert [r[0] for r in rows.select(own.bucket(F.col("fingerprint"))).collect()] == [0, 0, 1, 3, 0, 0]
    plain = buckets.BucketedTable(spark, str(tmp_path / "u"), "fingerprint string", buckets=4)
    assert {r[0] for r in rows.select(plain.bucket(F.col("fingerprint"))).collect()} <= set(range(4))


def test_a_replayed_transaction_changes_nothing(spark, tmp_path, none):
    own = table(spark, tmp_path / "t")
    assert own.merge(items(spark, range(5)), recorded(none), ("scan", 3))
    assert own.merge(items(spark, range(50, 60)), recorded(none), ("scan", 3)) is None and own.merge(items(spark, range(9)), recorded(none), ("scan", 2)) is None
    assert own.version() == 0 and own.read().count() == 5
    assert own.merge(items(spark, range(9)), recorded(none), ("other", 0)) and own.read().count() == 9


def test_a_writer_that_dies_leaves_the_table_whole(spark, tmp_path, none, monkeypatch):
    own = table(spark, tmp_path / "t")
    own.merge(items(spark, range(20)), recorded(none), ("scan", 0))

    def dies(self, manifest):
        raise RuntimeError("the driver dies here")

    monkeypatch.setattr(buckets.BucketedTable, "_publish", dies)
    with pytest.raises(RuntimeError, match="dies here"):
        own.merge(items(spark, range(40)), recorded(none), ("scan", 1))
    monkeypatch.undo()
    assert own.version() == 0 and own.read().count() == 20
    # one that dies with the version's name taken
    Path(own.folder, "manifests", f"{1:010d}.taken").touch()
    with pytest.raises(buckets.Conflict):
        own.merge(items(spark, range(40)), recorded(none), ("scan", 1), attempts=1)
    monkeypatch.setattr(own, "STALE", -1.0)
    assert own.merge(items(spark, range(40)), recorded(none), ("scan", 1)) and own.read().count() == 40
    assert own.vacuum(1) > 0 and own.read().count() == 40 and own._versions() == [1]


def test_the_loser_of_two_writers_starts_again(spark, tmp_path, none):
    own, rival = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    own.merge(items(spark, range(10)), recorded(none))
    seen = []

    def change(rows, batch):
        if not seen:
            seen.append(1)
            rival.merge(items(spark, range(10, 20)), recorded(none))  # commits in between
        return store.record(rows, batch, *none)

    own.merge(items(spark, range(20, 30)), change)
    assert own.version() == 2 and own.read().count() == 30


def test_changes_by_subject_and_removals(spark, tmp_path, none):
    own = table(spark, tmp_path / "t")
    own.merge(items(spark, range(100)), recorded(none))
    subjects = spark.createDataFrame([("scene", "5"), ("scene", "6"), ("scene", "none")], "subject_type string, subject_id string")
    done = buckets.merge_by_subject(own, subjects, lambda rows, s: store.mute(rows, s, F.lit(AT)))
    assert done["rewritten"] <= 2 and [r[:2] for r in shown(own.read().where("state = 'muted'"))] == [("5", "muted"), ("6", "muted")]
    one = own.read().where("subject_id = '5'").select("fingerprint")
    own.merge(one, lambda rows, gone: rows.join(gone, "fingerprint", "left_anti"))
    assert own.read().count() == 99
    with pytest.raises(ValueError, match="other buckets"):
        own.merge(one, lambda rows, gone: rows.withColumn("fingerprint", F.sha2("fingerprint", 256)))


def test_an_empty_table_and_vacuum(spark, tmp_path, none):
    own = table(spark, tmp_path / "t")
    assert own.version() == -1 and own.read().count() == 0 and own.vacuum() == 0
    for k in range(5):
        own.merge(items(spark, range(30), datetime(2024, 1, 1 + k, tzinfo=UTC)), recorded(none))
    files = lambda: len([p for p in Path(own.folder).rglob("*.parquet")])
    before = files()
    assert own.vacuum(2) >= 3 and files() < before and own.read().count() == own.read(3).count() == 30
