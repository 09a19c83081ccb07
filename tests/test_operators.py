from __future__ import annotations

import json
import threading
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attesta.operators import actions, adapters, attribution, changes, claims, decisions, jobs, labels, linkage, listings, profiles, runs, schedule, selection, store
from attesta.operators import views as display
from attesta.sources import config, paged, tables
from attesta.streaming import proposals


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


CANDIDATE = "subject string, idx long, value double, contained boolean, meaningful int, title string"


@pytest.mark.parametrize(
    ("given", "outcome", "idx"),
    [
        ([(0, 0.9, False, 2, "a"), (1, 0.8, False, 2, "b")], "chosen", 0),
        ([(0, 0.9, False, 2, "a"), (1, 0.85, False, 2, "b")], "ambiguous", None),
        ([(0, 0.9, False, 2, "B!"), (1, 0.85, False, 2, "b")], "chosen", 0),
        ([(0, 0.85, False, 2, "b"), (1, 0.9, False, 2, "B!")], "chosen", 1),
        ([(0, 0.89, False, 1, "a")], "none", None),
        ([(0, 0.2, True, 2, "a")], "chosen", 0),
        ([(0, 0.99, True, 0, "a")], "none", None),
    ],
)
def test_decide(spark, given, outcome, idx):
    got = decisions.decide(spark.createDataFrame([("s", *g) for g in given], CANDIDATE)).first()
    assert (got["outcome"], got["idx"]) == (outcome, idx)


def test_near_miss_is_the_least_shortfall(spark):
    got = decisions.decide(spark.createDataFrame([("s", 0, 0.69, False, 2, "a"), ("s", 1, 0.85, False, 1, "b"), ("s", 2, 1.0, False, 0, "c")], CANDIDATE)).first()
    assert got["near_idx"] == 0 and not got["interrogated"]


def test_winner_among_stores(spark):
    kind = "subject string, store string, resolvable boolean, value double, title string"
    got = decisions.choose_winner(spark.createDataFrame([("a", "x", False, 0.99, "t"), ("a", "y", True, 0.8, "u"), ("b", "x", True, 0.9, "t"), ("b", "y", True, 0.88, "u"), ("c", "x", True, 0.9, "T."), ("c", "y", True, 0.9, "t"), ("c", "z", True, 0.7, "q")], kind))
    assert rows(got, "subject", "store", "ambiguous", "agreeing", "competing") == [("a", "y", False, [], []), ("b", None, True, None, None), ("c", "x", False, ["y"], ["z"])]


def test_claims(spark):
    kind = "subject string, box string, ord int, site_id string, exact boolean"
    given = [("p", "a", 0, "1", False), ("o", "a", 0, "1", True), ("n", "a", 0, None, True), ("s", "a", 0, "1", True), ("s", "b", 1, "1", True), ("s", "c", 2, "9", False), ("c", "a", 0, "1", True), ("c", "b", 1, "2", True), ("u", "a", 0, "1", True), ("u", "b", 1, None, True)]
    got = {r["subject"]: r for r in claims.resolve_claims(spark.createDataFrame(given, kind)).collect()}
    assert {k: v["outcome"] for k, v in got.items()} == {"o": "identified", "n": "identified", "s": "identified", "c": "conflict", "u": "conflict"}
    assert (got["s"]["box"], got["s"]["agreeing"], got["s"]["perceptual"]) == ("a", ["b"], ["9"])
    with pytest.raises(PySparkException, match="not a fingerprint"):
        claims.checked_fingerprints(spark.createDataFrame([("CRC", "1")], "algorithm string, hash string")).collect()


@pytest.mark.parametrize(
    ("path", "creator"),
    [("/lib/Ivy Wood (h265)/Clips/a.mp4", "Ivy Wood"), ("/lib/Ivy/1080p/a.mp4", "Ivy"), ("a.mp4", ""), ("/a.mp4", ""), ("/videos/clips/a.mp4", "clips"), ("C:\\x\\a.mp4", ""), (None, "")],
)
def test_creator_folder(spark, path, creator):
    assert spark.createDataFrame([(path,)], "p string").select(attribution.creator_folder(F.col("p"))).first()[0] == creator


@pytest.mark.parametrize(
    ("name", "ok"),
    [("Ivy Wood", True), ("May Winters", True), ("Iv", False), ("a b c d e", False), ("2023 September 11", False), ("20230911", False), ("Sep 2023", False), ("The Crane", False), ("Downloads", False), ("", False), (None, False)],
)
def test_name_guards(spark, name, ok):
    assert spark.createDataFrame([(name,)], "p string").select(attribution.is_name(F.col("p"))).first()[0] is ok


def test_featured_and_dashed_names(spark):
    given = ["Ivy Wood - Tea.mp4", "Store - Ivy Wood - Tea", "Ivy Wood Tea Feat Ivy Wood.mp4", "Tea ft Ivy Wood", "Feathers fly", ""]
    got = [tuple(r) for r in spark.createDataFrame(list(enumerate(given)), "i int, n string").orderBy("i").select(attribution.filename_candidate(F.col("n")), attribution.filename_candidates(F.col("n"))).collect()]
    assert got == [("Ivy Wood", ["Ivy Wood"]), ("Store", ["Store", "Ivy Wood"]), ("Ivy Wood", ["Ivy Wood"]), (None, []), (None, []), (None, [])]


def test_resolution(spark):
    files = spark.createDataFrame([("1", "Tea.mp4", "Ivy Wood"), ("2", "Ivy Wood - Tea.mp4", "Store"), ("3", "x.mp4", "IW"), ("4", "x.mp4", "Videos")], "id string, name string, folder string")
    aliases = spark.createDataFrame([("iw", "Ivy Wood")], "key string, full string")
    plain = {r["id"]: r for r in attribution.resolve(files, aliases).collect()}
    assert [(plain[k]["name"], plain[k]["source"], plain[k]["competing"]) for k in "1234"] == [("Ivy Wood", "folder", None), ("Store", "folder", "Ivy Wood"), ("Ivy Wood", "alias", None), (None, None, None)]
    assert plain["4"]["rejected_folder"] == "Videos"
    owners = spark.createDataFrame([("Ivy Wood", "ivywood"), ("Store", "someone")], "candidate string, owner string")
    asked = {r["id"]: r for r in attribution.resolve(files, aliases, owners).collect()}
    assert (asked["2"]["name"], asked["2"]["source"], asked["2"]["competing"]) == ("Ivy Wood", "filename", "Store")
    nobody = {r["id"]: r for r in attribution.resolve(files, aliases, owners.limit(0)).collect()}
    assert nobody["2"]["name"] is None and nobody["2"]["unconfirmed"] == ["Store", "Ivy Wood"]


def test_aliases(spark):
    bad = spark.createDataFrame([("a", "IW", "Ivy"), ("b", "i w", "Other")], "adapter string, alias string, full string")
    with pytest.raises(PySparkException, match="names two people"):
        attribution.configured_aliases(bad).collect()
    people = spark.createDataFrame([("Ivy Wood", ["IW", "Fern"]), ("Fern", ["x"]), ("Moss", ["X"])], "name string, aliases array<string>")
    library = attribution.library_aliases(people)
    assert rows(library, "key", "usable") == [("fern", False), ("iw", True), ("x", False)]


def test_selection_filters_before_it_limits(spark):
    table = spark.createDataFrame([(k, k >= 7) for k in range(10)], "id int, wanted boolean")
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    got = dict(rows(selection.select_batch(table, "id", one(7), one(8, 8, 1), F.col("wanted"), 1), "id", "reason"))
    assert [got[k] for k in (0, 7, 8, 9)] == ["filtered_out", "muted", "already_proposed", "selected"]
    assert dict(rows(selection.select_batch(table, "id", one(), one(), None, 0), "id", "reason")) == dict.fromkeys(range(10), "deferred")
    with pytest.raises(ValueError, match="limit"):
        selection.select_batch(table, "id", one(), one(), None, -1)


def test_sweep_needs_a_complete_read(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert rows(selection.gone_sweep(ids(1, 2, 3), ids(1, 2), 2)) == [(3,)]
    for present, reported in ((ids(1, 2), 3), (ids(1, 1), 2), (ids(), 0)):
        assert rows(selection.gone_sweep(ids(1, 2, 3), present, reported)) == []


def test_label_clusters_and_descriptions(spark):
    kind = "id string, name string, scene_count long, description string"
    table = spark.createDataFrame([("1", "Red Hair", 3, "d"), ("2", "redhair", 1, None), ("3", "a-b", 0, None), ("4", "a b", 0, " "), ("5", "x", 1, "t"), ("6", "X", 1, "u"), ("7", "x!", 1, None)], kind)
    got = {r["key"]: r for r in labels.cluster_labels(table).collect()}
    assert (got["redhair"]["canonical"], got["ab"]["undecided"], got["x"]["undecided"]) == ("1", "even", "many")
    merged = dict(rows(labels.merge_descriptions(labels.cluster_labels(table)), "key", "outcome"))
    assert merged == {"redhair": "kept", "ab": "none", "x": "none"}
    source = spark.createDataFrame([("Red", ["r"], "one"), ("R", [], "two"), ("R", [], "one"), ("Blue", None, " "), ("Tea", ["t"], "leaf")], "name string, aliases array<string>, description string")
    index = {r["key"]: (r["description"], r["ambiguous"]) for r in labels.description_index(source).collect()}
    assert index == {"red": ("one", False), "r": (None, True), "tea": ("leaf", False), "t": ("leaf", False)}


def test_hygiene_takes_the_first_reason(spark):
    table = spark.createDataFrame([(k, f"n{k}", n, d) for k, n, d in (("1", 0, "told"), ("2", 1, None), ("3", 1, None), ("4", 1, None), ("5", 0, None), ("6", 1, None), ("7", 1, None), ("8", 2, None))], "id string, name string, scene_count long, description string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = dict(rows(labels.hygiene(table, ids("1", "2"), ids("2", "3"), ids("4"), ids("5"), ids("5", "6")), "id", "reason"))
    assert got == {"1": "described", "2": "sourced", "3": "clustered", "4": "reconciled", "5": "kept", "6": "already", "7": "proposed"}
    assert {r for _, r in rows(labels.hygiene(table, ids(), ids(), ids(), ids(), ids(), unread=1), "id", "reason")} == {"withheld"}


def test_people(spark):
    folk = spark.createDataFrame([("1", "Ivy", ["Fern", "ivy"]), ("2", "Fern", []), ("3", "Moss", ["Ivy"])], "id string, name string, aliases array<string>")
    index = labels.index_people(folk)
    tags = spark.createDataFrame([("a", "IVY", 4), ("b", "moss", 2), ("c", "Moss", 0)], "id string, name string, scene_count long")
    assert rows(labels.match_people(tags, index), "id", "outcome", "person_id") == [("a", "ambiguous", None), ("b", "resolved", "3"), ("c", "unused", None)]


def test_offers_and_blank_fields(spark):
    offers = spark.createDataFrame([("p", "eye", 0, "x", "Dark Blue"), ("p", "eye", 1, "y", "dark-blue"), ("p", "hair", 0, "x", "red"), ("p", "hair", 1, "y", "brown"), ("p", "skin", 0, "x", "")], "id string, field string, ord int, source string, value string")
    got = {r["field"]: r for r in profiles.merge_offers(offers).collect()}
    assert got["eye"]["value"] == "Dark Blue" and not got["hair"]["agreed"] and len(got["hair"]["conflict"]) == 2 and "skin" not in got


@pytest.mark.parametrize(
    ("given", "result"),
    [
        (None, (None, None, None)), ("", (None, None, None)), ("3 < 4 & more", (None, None, None)), ("<p>a</p> <p>b</p>", ("markup", "a b", None)),
        ("a&amp;b\n <br> \nc", ("markup,entity", "a&b\n\nc", None)), ("&lt;b&gt;x", ("entity", None, profiles.DOUBLE)), ("&amp;amp;", ("entity", None, profiles.DOUBLE)),
        ("x&#8203;y", ("entity", None, profiles.UNSAFE)), ("<p> </p>", ("markup", None, profiles.NOTHING)), ("&#233;", ("entity", "é", None)), ("&#9999999;", ("entity", None, profiles.UNSAFE)),
    ],
)
def test_descriptions(given, result):
    assert profiles.cleanup(given) == result


def test_verdicts(spark):
    kind = "outcome string, contenders int, interrogated boolean, rows int, complete boolean, certain boolean, performer_id string, listing_performer_id string"
    given = [("none", 0, True, 5, True, True), ("chosen", 1, True, 5, True, True), ("none", 0, True, 5, False, True), ("ambiguous", 2, True, 5, True, True), ("none", 0, False, 5, True, True), ("none", 0, True, 5, True, False), ("none", 0, False, 0, True, True)]
    got = listings.listing_verdict(spark.createDataFrame([(*g, "p", "p") for g in given], kind)).collect()
    assert [r["unlisted"] for r in got] == [True, False, None, None, None, None, True]
    with pytest.raises(PySparkException, match="certainty"):
        listings.listing_verdict(spark.createDataFrame([(*given[0], "p", "q")], kind)).collect()


def item(spark, *given):
    at = datetime(2024, 1, 1, tzinfo=UTC)
    full = [(fp, "f", "tag", subject, "s", 0.5, "{}", "p", state, None, None, at, seen, None) for fp, subject, state, seen in given]
    return spark.createDataFrame(full, store.SCHEMAS["item"])


def test_record_is_idempotent_and_honours_rejections(spark):
    early, late = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 2, 1, tzinfo=UTC)
    items = item(spark, ("a", "1", "applied", early), ("b", "2", "new", early))
    batch = item(spark, ("a", "1", "new", late), ("c", "3", "new", late), ("c", "3", "new", late), ("d", "4", "new", late), ("e", "5", "new", late))
    dismissed = spark.createDataFrame([("d", None, early)], store.SCHEMAS["dismissal"])
    muted = spark.createDataFrame([("tag", "5", None, early)], store.SCHEMAS["mute"])
    once = store.record(items, batch, dismissed, muted)
    assert rows(once, "fingerprint", "state") == [("a", "applied"), ("b", "new"), ("c", "new")]
    assert rows(store.record(once, batch, dismissed, muted)) == rows(once)
    assert {r["fingerprint"]: r["last_seen_at"].month for r in once.collect()} == {"a": 2, "b": 1, "c": 2}
    with pytest.raises(PySparkException, match="confidence"):
        store.record(items, batch.withColumn("confidence", F.lit(2.0)), dismissed, muted).collect()


def test_states(spark):
    at, now = datetime(2024, 1, 1, tzinfo=UTC), F.current_timestamp()
    items = item(spark, ("a", "1", "applied", at), ("b", "1", "new", at), ("c", "2", "new", at))
    fp = lambda *x: spark.createDataFrame([(i,) for i in x], "fingerprint string")
    subject = spark.createDataFrame([("tag", "1")], "subject_type string, subject_id string")
    state = lambda t: dict(rows(t, "fingerprint", "state"))
    assert state(store.dismiss(items, fp("a", "b"), now)) == {"a": "applied", "b": "dismissed", "c": "new"}
    muted = store.mute(items, subject, now)
    assert state(muted) == {"a": "applied", "b": "muted", "c": "new"}
    assert state(store.unmute(muted, subject, fp("b"))) == {"a": "applied", "b": "dismissed", "c": "new"}
    assert state(store.unmute(muted, subject, fp())) == {"a": "applied", "b": "new", "c": "new"}
    assert state(store.mark_gone(items, subject)) == {"a": "gone", "b": "gone", "c": "new"}
    assert state(store.set_state(items, fp("c"), "failed", now, F.lit("why"))) == {"a": "applied", "b": "new", "c": "failed"}
    with pytest.raises(PySparkException, match="unknown fingerprint"):
        store.set_state(items, fp("zz"), "seen", now).collect()
    assert rows(store.item_page(items, subject_types=())) == []
    assert rows(actions.undo_check(items, fp("a", "b", "q"))) == [("a", "no snapshot"), ("b", "not applied"), ("q", "unknown")]
    tried = spark.createDataFrame([("b", None, "{}"), ("c", "down", None)], "fingerprint string, error string, prior_state string")
    assert state(actions.approve(items, tried, now)) == {"a": "applied", "b": "applied", "c": "failed"}


def test_older_tables_and_renames(spark):
    old = spark.createDataFrame([("x", "r")], "fingerprint string, reason string")
    assert store.add_missing_columns(old, store.SCHEMAS["dismissal"]).columns == ["fingerprint", "reason", "at"]
    ran = spark.createDataFrame([("old", "2024-01-02T00:00:00Z"), ("new", "2024-01-01T00:00:00Z"), ("x", "soon")], store.SCHEMAS["producer_run"])
    assert rows(store.renamed_producers(ran, {"old": "new"})) == [("new", "2024-01-02T00:00:00Z"), ("x", "soon")]


def test_run_log(spark):
    t = datetime(2024, 1, 1, tzinfo=UTC)
    log = spark.createDataFrame([(f"r{k}", "j", "m", t, None if k == 0 else t, None if k == 0 else "finished", None, None, k) for k in range(6)], store.SCHEMAS["run"])
    assert [r[0] for r in rows(runs.retain(log, 2), "id")] == ["r0", "r4", "r5"]
    assert runs.evicted(log, 2).first()["n"] == 3
    assert rows(runs.latest_per_job(log), "id") == [("r5",)]
    assert rows(runs.close_interrupted(log, [], F.current_timestamp()).where("outcome = 'interrupted'"), "id") == [("r0",)]
    done = spark.createDataFrame([("r0", t, "failed", None, "x")], "id string, finished timestamp, outcome string, counts map<string, bigint>, error string")
    assert rows(runs.finish_run(log, done).where("error = 'x'"), "id", "outcome") == [("r0", "failed")]


def test_schedule_entries():
    declared = {"a": {"every": 60}, "b": {"at": "09:30", "zone": "Europe/Paris"}}
    got = schedule.resolve_entries(declared, {"a": {"at": "10:00", "zone": "Europe/Paris"}, "b": {"enabled": False}})
    assert (got["a"].every, got["a"].at, got["b"].enabled) == (None, "10:00:00", False)
    for over in ({"zz": {}}, {"a": {"often": 1}}, {"a": {"every": 5, "at": "10:00"}}, {"a": {"every": True}}, {"a": {"at": "25:00", "zone": "UTC"}}, {"b": {"zone": "Nowhere"}}):
        with pytest.raises(ValueError):
            schedule.resolve_entries(declared, over)
    assert schedule.zones_agree("Europe/Paris", "Europe/Paris") and not schedule.zones_agree("Europe/Paris", "Europe/Lisbon")
    with pytest.raises(ValueError, match="deployment"):
        schedule.resolve_entries(declared, {}, "Asia/Tokyo")


def test_due(spark):
    entries = schedule.entries_table(spark, {n: schedule.Entry(n, **e) for n, e in {"a": {"every": 60.0}, "b": {"every": 61.0}, "c": {"at": "01:30:00", "zone": "Europe/Lisbon"}, "d": {"every": 1.0, "enabled": False}, "e": {"every": 1.0}, "f": {"every": 1e9}, "g": {"every": 1e9}}.items()})
    ran = spark.createDataFrame([("a", "2025-03-30T12:00:00Z"), ("b", "2025-03-30T12:00:00Z"), ("c", "2025-03-29T23:00:00Z"), ("f", "soon"), ("g", "2030-01-01T00:00:00Z")], store.SCHEMAS["producer_run"])
    got = dict(rows(schedule.due(entries, ran, F.lit("2025-03-30 12:01:00").cast("timestamp")), "producer", "reason"))
    assert got == {"a": "due", "b": "not yet", "c": "due", "d": "disabled", "e": "never run", "f": "malformed last run", "g": "last run in the future"}


def test_occurrences_around_clock_changes(spark):
    zone, at = "Europe/Lisbon", "01:30:00"
    start = datetime(2025, 10, 25, tzinfo=UTC)
    nows = [start + timedelta(minutes=45 * k) for k in range(70)]
    wall = [datetime(2025, 10, d, 1, 30, tzinfo=ZoneInfo(zone)).astimezone(UTC) for d in range(22, 31)]
    table = spark.createDataFrame([(n,) for n in nows], "now timestamp")
    got = table.select(*[F.unix_seconds(f(F.col("now"), F.lit(at), F.lit(zone))) for f in (schedule.previous_occurrence, schedule.next_occurrence)]).collect()
    assert [tuple(r) for r in got] == [(int(max(w for w in wall if w <= n).timestamp()), int(min(w for w in wall if w > n).timestamp())) for n in nows]


def test_ticks_keep_to_capacity(spark):
    ripe = spark.createDataFrame([("a", True, "box"), ("b", True, "box"), ("c", True, "local"), ("d", False, "local"), ("e", True, "local")], "producer string, due boolean, cost string")
    running = spark.createDataFrame([("e", "local")], "producer string, cost string")
    room = spark.createDataFrame([("box", 1), ("local", None)], "cost string, room int")
    assert rows(schedule.tick(ripe, running, room), "producer", "starts") == [("a", True), ("b", False), ("c", True)]


def test_changes(spark):
    scenes = spark.createDataFrame([("1", "t", None, None, "s", ["p"], ["x", "y"]), ("2", "u", None, None, None, ["q"], ["x"])], "id string, title string, details string, date string, studio_id string, performer_ids array<string>, tag_ids array<string>")
    match = spark.createDataFrame([("1", "<b>T</b>", None, "", "z", ["p", "q"], ["w"], ["y"])], "id string, title string, details string, date string, studio_id string, performer_ids array<string>, tag_ids array<string>, drop_tag_ids array<string>")
    change = changes.scene_changes(scenes, match)
    got = change.first()
    assert (got["title"], got["studio_id"], got["performer_ids"], got["tag_ids"], got["skipped"]) == ("T", "s", ["p", "q"], ["x", "w"], ["details", "date", "studio"])
    after = scenes.where("id = '2'").unionByName(change.select(*scenes.columns))
    assert rows(changes.revert_scenes(after, change.select("id", "prior"))) == rows(scenes)
    pairs = spark.createDataFrame([("x", "q")], "tag_id string, performer_id string")
    done = changes.reconcile(scenes, pairs)
    assert rows(done, "id", "performer_ids", "tag_ids", "attached", "chunk") == [("1", ["p", "q"], ["y"], True, 0), ("2", ["q"], [], False, 0)]
    moved = scenes.drop("performer_ids", "tag_ids").join(done.select("id", "performer_ids", "tag_ids"), "id").select(*scenes.columns)
    back = changes.revert_reconcile(moved, done)
    assert {r["id"]: (sorted(r["performer_ids"]), sorted(r["tag_ids"])) for r in back.collect()} == {"1": (["p"], ["x", "y"]), "2": (["q"], ["x"])}
    both = changes.reconcile(scenes, spark.createDataFrame([("x", "q"), ("y", "r")], "tag_id string, performer_id string"))
    assert rows(both, "tag_id", "id", "performer_ids", "tag_ids", "attached") == [("x", "1", ["p", "q", "r"], [], True), ("x", "2", ["q"], [], False), ("y", "1", ["p", "q", "r"], [], True)]
    moved = scenes.drop("performer_ids", "tag_ids").join(both.select("id", "performer_ids", "tag_ids").distinct(), "id").select(*scenes.columns)
    assert {r["id"]: (r["performer_ids"], sorted(r["tag_ids"])) for r in changes.revert_reconcile(moved, both).collect()} == {"1": (["p"], ["x", "y"]), "2": (["q"], ["x"])}
    assert changes.revert_reconcile(moved, both).count() == 2
    with pytest.raises(ValueError, match="bulk"):
        changes.bulk_mode("SET")


def test_guards(spark):
    now = spark.createDataFrame([("1", "a"), ("2", None)], "id string, v string")
    want = spark.createDataFrame([("1", "b", "a"), ("2", "b", "x"), ("3", "b", None)], "id string, value string, expected string")
    assert rows(changes.compare_and_set(now, want, "v"), "id", "new", "refused") == [("1", "b", None), ("2", None, "changed meanwhile"), ("3", None, "missing")]
    tags = spark.createDataFrame([("1", "d"), ("2", "")], "id string, description string")
    merges = spark.createDataFrame([("1", "x"), ("2", "x")], "survivor string, description string")
    assert rows(changes.merge_guard(tags, merges), "survivor", "refused") == [("1", "the survivor has a description"), ("2", None)]


def test_examine_gives_each_file_one_outcome(spark):
    files = spark.createDataFrame([("1", "Quiet Harbour.mp4", "Ivy"), ("2", "Nothing Alike.mp4", "Ivy"), ("3", "Tea.mp4", "Moss"), ("4", "x.mp4", "Videos")], "id string, name string, folder string")
    resolved = attribution.resolve(files, spark.createDataFrame([], "key string, full string"))
    found = spark.createDataFrame([("Ivy", "s", True, 0, "Quiet Harbour", None)], "artist string, store string, resolvable boolean, idx long, title string, url string")
    later = spark.createDataFrame([], "id string, store string, resolvable boolean, idx long, title string, url string")
    for error, third in ((None, "mute"), ("down", "error")):
        stores = spark.createDataFrame([("s", None), ("t", error)], "store string, error string")
        got = dict(rows(linkage.examine(files, resolved, found, later, stores, {}), "id", "outcome"))
        assert got == {"1": "proposal", "2": "refusal", "3": third, "4": "refusal"}


def test_adapters(spark, tmp_path):
    with pytest.raises(ValueError, match="owner source"):
        adapters.Adapter("x", owner_source="guess")
    own = adapters.Adapter("x", owner_source="url_segment", owner_segment=1, title_match_counts_as_ownership=True)
    table = spark.createDataFrame([("https://h/ivy/tea", "Tea"), ("https://h/moss/ivy-tea", "Tea")], "u string, t string")
    got = table.select(own.features_artist(F.col("u"), F.col("t"), own.owner_of(F.col("u")), F.lit("ivy")), own.search_query(F.lit("Ivy"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(True, "ivy tea"), (True, "ivy tea")]
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"name": "x", "owner_source": "none"}, {"name": "x", "owner_source": "url_segment"}]))
    assert config.load_adapters(path)["x"].owner_source == "url_segment"
    assert config.load_adapters(tmp_path / "none.json") == {}
    path.write_text('{"a": 1, "a": 2}')
    with pytest.raises(ValueError, match="repeated"):
        config.read(path)
    path.write_text('{"old": {"every": 1}, "new": {"every": 2}}')
    with pytest.raises(ValueError, match="differ"):
        config.load_schedule(path, {"old": "new"})
    assert config.load_zone(tmp_path / "none.json", {"ATTESTA_ZONE": "Europe/Paris"}) == "Europe/Paris"


def test_paged_source(spark, tmp_path):
    for k in range(1, 4):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"count": 5, "rows": [{"id": i, "name": f"n{i}", "aliases": None} for i in range(2 * k - 2, min(2 * k, 5))]}))
    paged.register(spark)
    url = f"file://{tmp_path}/p{{page}}.json"
    got = spark.read.format("paged").schema(tables.SCHEMAS["tag"]).option("url", url).option("per_page", 2).load()
    assert got.rdd.getNumPartitions() == 3 and rows(got, "id", "name") == [(str(i), f"n{i}") for i in range(5)]
    assert selection.completeness(got, F.lit(5)).first()["complete"]


def test_jobs(spark):
    seen = []
    gate = threading.Event()

    def good(s):
        yield s.range(3)
        gate.wait(20)
        yield s.range(2)

    def bad(s):
        yield s.range(1)
        raise OSError("down")

    runner = jobs.JobRunner(spark, lambda b: (seen.append(b.count()), {"recorded": seen[-1]})[1])
    runner.register(jobs.Producer("good", good, "box"))
    runner.register(jobs.Producer("bad", bad))
    with pytest.raises(ValueError, match="registered"):
        runner.register(jobs.Producer("bad", bad))
    one = runner.start("good")
    with pytest.raises(RuntimeError, match="running"):
        runner.start("good")
    two = runner.wait(runner.start("bad").id, 60)
    gate.set()
    one = runner.wait(one.id, 60)
    assert (one.state, one.counts, two.state, two.counts) == ("finished", {"recorded": 5}, "failed", {"recorded": 1})
    runner.close()
    with pytest.raises(RuntimeError, match="closed"):
        runner.start("good")


def test_stream_replays_change_nothing(spark, tmp_path):
    events = spark.createDataFrame([(1, datetime(2024, 1, 1), 5, "a"), (2, datetime(2024, 1, 2), 5, "a"), (3, datetime(2024, 1, 3), 6, "b")], "event_id long, ts timestamp, user_id long, event_type string")
    events.write.parquet(str(tmp_path / "in"))
    table = proposals.items_table(spark, str(tmp_path / "items"), 8)
    none = [spark.createDataFrame([], store.SCHEMAS[n]) for n in ("dismissal", "mute")]
    for _ in range(2):
        source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        proposals.start_recording(proposals.proposals_of(source), table, *none, str(tmp_path / "check")).awaitTermination()
        assert rows(table.read(), "folder", "subject_id") == [("a", "5"), ("b", "6")]
    before = table.version()
    proposals.merge_proposals(table, *none)(proposals.proposals_of(events), 0)  # a replay of the first batch
    assert table.version() == before >= 0


def test_display(spark):
    payload = json.dumps({"match": {"title": "T", "image": "i"}, "creator": "Ivy", "stem": "Moss", "competing": ["x"], "competing_store": "s"})
    items = item(spark, ("a", "1", "new", datetime(2024, 1, 1, tzinfo=UTC))).withColumns({"subject_type": F.lit("scene"), "payload": F.lit(payload)})
    got = display.rows_of(items, "scene", "http://h/").first()
    assert (got["link"], got["contested"], got["actionable"], got["cover"], got["disagreement"]) == ("http://h/scenes/1", True, True, True, "the file names Moss; also found at s")
    assert [r[0] for r in spark.createDataFrame([("x",), ("0",), ("3",), (None,)], "p string").select(display.page_number(F.col("p"))).collect()] == [1, 1, 3, 1]


def test_label_pass_excludes_earlier_ids(spark):
    kind = "id string, name string, scene_count long, description string, aliases array<string>"
    tags = spark.createDataFrame([("1", "Red Hair", 3, None, []), ("2", "redhair", 1, None, []), ("3", "Ivy", 1, None, []), ("4", "Moss", 1, None, []), ("5", "Tea", 0, None, []), ("6", "Oak", 0, None, [])], kind)
    people = spark.createDataFrame([("p", "Ivy", [])], "id string, name string, aliases array<string>")
    index = labels.description_index(spark.createDataFrame([("Moss", [], "green"), ("Red Hair", [], "red")], "name string, aliases array<string>, description string")).withColumns({"source": F.lit("s"), "ord": F.lit(0)})
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = labels.label_pass(tags, people, index, ids("5"), ids())
    assert rows(got["describe"], "id") == [("4",)]
    assert rows(got["reconcile"], "id", "person_id") == [("3", "p")]
    assert rows(got["hygiene"], "id", "reason") == [("2", "sourced"), ("3", "reconciled"), ("4", "sourced"), ("5", "kept"), ("6", "proposed")]
    line = labels.summary(got["hygiene"].groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "hygiene").first()[0]
    assert line == "hygiene: 1 kept, 1 proposed, 1 reconciled, 2 sourced"
