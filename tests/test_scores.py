"""Scores of pairs: alike files are read and judged once, with the results of every pair on its own."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from attesta.functions import similarity
from attesta.operators import attribution, linkage
from attesta.plans import linkage_queries, pass_queries, views  # noqa: F401
from attesta.plans.registry import QUERIES

FILES = [(1, "k", "Ann - red ring.mp4", "Ann", "A"), (2, "k", "Ann - red ring.mp4", "Ann", "A"), (3, "k", "blue bolt.rev2.mp4", None, "A"), (4, "l", None, "Old plates", "B"), (5, "k", "blue bolt.rev2.mp4", None, "A"), (6, "m", "x", "y", "z")]
TITLES = [("k", "red ring", 1), ("k", "the blue bolt rev2", 2), ("l", "old plates", 3), ("l", None, 4), ("k", "", 5)]


def test_alike_files_get_the_score_of_each(spark):
    files = spark.createDataFrame(FILES, "id long, key string, name string, folder string, artist string")
    titles = spark.createDataFrame(TITLES, "key string, title string, idx int")
    got = similarity.match_pairs(files, titles, ["key"], "id", "name", "folder", "title", "artist").select("id", "idx", "name", "m.*").collect()
    one_by_one = similarity.with_match_score(files.join(titles, "key"), "name", "folder", "title", "artist").select("id", "idx", "name", "m.*").collect()
    key = lambda r: (r["id"], r["idx"])
    assert len(got) == 4 * 3 + 2 and sorted(got, key=key) == sorted(one_by_one, key=key)


def test_a_pair_is_compared_once(monkeypatch):
    compared = []

    class Counting(SequenceMatcher):
        def ratio(self):
            compared.append(1)
            return super().ratio()

    monkeypatch.setattr(similarity, "SequenceMatcher", Counting)
    known = {}
    for _ in range(3):  # batches
        assert similarity.ratios(pd.Series(["abc", "abd", "abc", None]), pd.Series(["abd", "abd", "abd", ""]), known).round(3).tolist() == [0.667, 1.0, 0.667, 1.0]
    assert len(compared) == 2


def test_a_tally_compares_no_names(spark, monkeypatch):
    monkeypatch.setattr(linkage, "judge", None)
    got = {r["reason"]: r["n"] for r in pass_queries.scan_tally(spark, "/root/testdata/sf0.001").collect()}
    assert sum(got.values()) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_a_scan_judges_alike_files_once(spark, monkeypatch):
    judged = []
    plain = linkage.judge

    def judge(files, candidates, pairs):
        judged.extend(r["id"] for r in files.collect())
        return plain(files, candidates, pairs)

    monkeypatch.setattr(linkage, "judge", judge)
    files = spark.createDataFrame([(i, "red ring.mp4", "ann ash") for i in (4, 2, 9)] + [(5, "red ring.mp4", None)], "id long, name string, folder string")
    known = spark.createDataFrame([(i, "ann ash", None, []) for i in (4, 2, 9, 5)], "id long, name string, rejected_folder string, unconfirmed array<string>")
    found = spark.createDataFrame([("ann ash", "s", True, 1, "red ring", None)], "artist string, store string, resolvable boolean, idx long, title string, url string")
    fallback = found.limit(0).select(F.lit(0).cast("long").alias("id"), "store", "resolvable", "idx", "title", "url")
    done = linkage.examine(files, known, found, fallback, spark.createDataFrame([("s", None)], "store string, error string"), {})
    assert sorted(judged) == [2, 5]
    assert {(r["id"], r["outcome"], r["title"]) for r in done.collect()} == {(i, "proposal", "red ring") for i in (2, 4, 5, 9)}


def test_each_shelf_names_nobody_and_each_maker_is_read(spark):
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    got = views.filed(part).select(F.col("p_partkey").alias("id"), "name", "folder", "maker", F.col("folder").isin(*views.SHELVES).alias("shelved"))
    assert {r["folder"] for r in got.where("shelved").select("folder").distinct().collect()} == set(views.SHELVES)
    said = attribution.resolve(got, spark.createDataFrame([], "key string, full string")).withColumnRenamed("name", "artist").join(got, "id")
    assert said.count() == part.count()
    wrong = said.where("not artist <=> maker or source <> if(shelved, 'filename', 'folder') or not rejected_folder <=> if(shelved, folder, null)")
    assert wrong.count() == 0


def scanned(spark, name):
    return {tuple(r) for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()}


def test_who_is_a_name_decides_a_library_scan(spark, monkeypatch):
    right = scanned(spark, "library_scan")
    assert not any((reason or "").startswith(("the folder names nobody", "nothing names")) for _, _, reason, *_ in right)
    monkeypatch.setattr(attribution, "is_name", lambda text: F.lit(True))
    assert scanned(spark, "library_scan") != right


def test_who_is_a_name_decides_a_whole_scan(spark, monkeypatch):
    right = scanned(spark, "scan_outcomes")
    monkeypatch.setattr(attribution, "is_name", lambda text: F.lit(True))
    wrong = scanned(spark, "scan_outcomes")
    assert {id for id, *_ in wrong} == {id for id, *_ in right} and wrong != right


def test_a_file_name_in_columns_gives_its_candidate(spark):
    names = ["Ann Ash - red ring.mp4", "[site] Ann Ash (x) - a - b.mkv", "Downloads - b.mp4", "2023 September 11 - x", "AB - x.mp4", " - x.mp4", "x - ", "Ann Ash red feat Ann Ash.mp4", "red feat Ann Ash", "plain.mp4", ".mp4", "", None, "The End - x", "Zoë – b"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = attribution.with_filename_candidate(rows, "name", "read").withColumn("plain", attribution.filename_candidate(F.col("name"))).collect()
    assert [r["read"] for r in got] == [r["plain"] for r in got] and got[0]["read"] == got[1]["read"] == got[7]["read"] == "Ann Ash" and got[2]["read"] is got[12]["read"] is None
