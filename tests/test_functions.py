from __future__ import annotations

import random
import unicodedata
from datetime import UTC, datetime, timedelta
from difflib import SequenceMatcher
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import dates, similarity, substitutions, text, urls, vocab


def column(spark, values, expression, kind="string"):
    """Values of an expression over rows x, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


NAMES = [None, "", "Ivy & Wood", "Café-Noir", "ŁÓDŹ Øre", "STRAẞE", "日本 語", "a_b.c", "  Two   Words ", "Æon ıI", "Ångström ñ", "ﬁne"]


def test_normal_forms(spark):
    exact = column(spark, NAMES, text.normalize_exact)
    assert exact == ["", "", "ivy and wood", "cafe noir", "lodz ore", "strasse", "日本 語", "a b c", "two words", "aeon ıi", "angstrom n", "fine"]
    assert column(spark, NAMES, text.normalize) == exact
    latin = ["Dvořák", "Šárka", "Łódź", "Kōbo", "ＦＵＬＬ ｗｉｄｔｈ", "Ǆ ½ №", "e\u0301\u0323 x", "한글 ㎏", "İstanbul", "naïve—façade", "Ⅷ ²", "ế ữ"]
    plain = [text.normal_form(x) for x in latin]
    assert column(spark, latin, text.normalize) == plain and plain[:5] == ["dvorak", "sarka", "lodz", "kobo", "full width"]


@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=8), min_size=1, max_size=40))
@settings(deadline=None, max_examples=12, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_normal_form_of_any_text(spark, texts):
    assert column(spark, texts, text.normalize) == [text.normal_form(x) for x in texts]


def test_labels_that_differ_in_accents_are_one_cluster(spark):
    from attesta.operators import labels

    rows = spark.createDataFrame([("1", "Dvořák", 1, None), ("2", "Dvorak", 2, None), ("3", "Kōbo Abe", 0, None)], "id string, name string, scene_count int, description string")
    assert [(r["key"], len(r["members"])) for r in labels.cluster_labels(rows).collect()] == [("dvorak", 2)]


def test_all_references_are_resolved(spark):
    assert column(spark, ["Caf&eacute; &ndash; x", "<b>a</b> &amp;lt; &notit;", "plain", None], text.strip_html) == ["Café – x", "a &lt; ¬it;", "plain", ""]


def test_keys_and_tokens(spark):
    assert column(spark, ["The Red Ring 1080p", "of the", None], text.tokens) == [["red", "ring"], [], []]
    assert column(spark, ["Ivy Wood", "&", None], text.spaceless) == ["ivywood", "and", ""]
    match = lambda x: text.slug_match(x, F.lit("ivy"))
    assert column(spark, ["ivywood", "iv", "", "xy"], match) == [True, True, False, False]


@pytest.mark.parametrize(
    ("name", "stem"),
    [("a.mp4", "a"), ("a.MKV", "a"), ("a.txt", "a.txt"), (".mp4", ".mp4"), ("a.b.webm", "a.b"), ("a.", "a."), (None, ""), ("x.m2ts", "x"), ("d.mp4/a", "d.mp4/a")],
)
def test_strip_ext(spark, name, stem):
    assert column(spark, [name], text.strip_ext) == [stem]


def test_clean_folder(spark):
    given = ["Ivy (h265)", "Ivy h.265 1080p", "1080p Ivy", "[x]", "Ivy-1080p", " A  B [c] WEB-DL ", None, "4k"]
    assert column(spark, given, text.clean_folder) == ["Ivy", "Ivy", "1080p Ivy", "", "Ivy-1080p", "A B", "", ""]


def test_strip_html(spark):
    given = ["<p>a</p>b &amp; c", r"I\'m <br>x", None, "a &lt;b&gt;"]
    assert column(spark, given, text.strip_html) == ["a b & c", "I'm x", "", "a <b>"]
    assert column(spark, [*given, "&eacute;&#233;"], text.strip_html_exact) == ["a b & c", "I'm x", "", "a <b>", "éé"]


@pytest.mark.parametrize(
    ("given", "found"),
    [
        ("2023-09-11", "2023-09-11"), ("2023 9 1", "2023-09-01"), ("11.09.2023", "2023-09-11"), ("13-12-2020", "2020-12-13"), ("12-13-2020", "2020-12-13"), ("13-13-2020", None),
        ("clip 2021_06_20 end", "2021-06-20"), ("2023 September 11", "2023-09-11"), ("Sept 5, 2022 walk", "2022-09-05"), ("on 5 may 2022", "2022-05-05"), ("1999-01-01", None),
        ("2023-02-30", None), ("31-02-2020 then 05-06-2021", "2021-06-05"), ("12021-06-20", None), (None, None), ("", None), ("a 2023 09 11 b", None),
    ],
)
def test_parse_date(spark, given, found):
    assert column(spark, [given], dates.parse_date) == [found]


def test_date_orders(spark):
    for order, found in (("dmy", "2020-12-05"), ("mdy", "2020-05-12"), ("none", None)):
        assert column(spark, ["05-12-2020"], lambda x, o=order: dates.parse_date(x, o)) == [found]
    with pytest.raises(ValueError, match="date order"):
        dates.numeric_date(F.lit("1"), F.lit("2"), F.lit("2020"), "ymd")


def test_date_prefixes(spark):
    given = ["2023-09-11 - Walk - Part", "Sep 5 2022+-+Tea", "Ivy - Walk", None, "1999-05-05 - Old"]
    assert column(spark, given, dates.date_prefix_title) == ["Walk - Part", "Tea", None, None, "Old"]
    assert column(spark, given, dates.date_prefix_date) == ["2023-09-11", "2022-09-05", None, None, None]
    assert column(spark, given, lambda x: dates.unparsed_date_prefix(x, F.lit(None).cast("string"))) == [None, None, None, None, "1999-05-05"]


def test_instants(spark):
    given = ["2024-01-01T00:30:00Z", "2024-07-01T00:30:00+02:00", "2024-01-01T00:30:00", "soon", None]
    assert column(spark, given, lambda x: dates.local_minute(x, "America/New_York")) == ["2023-12-31 19:30", "2024-06-30 18:30", "2024-01-01T00:30:00", "soon", None]
    told = column(spark, ["ran 2024-01-01T00:30:00Z, then 2024-07-01T00:30:00+00:00.", None], dates.local_times("Europe/Paris"))
    assert told == ["ran 2024-01-01 01:30, then 2024-07-01 02:30.", None]


@pytest.mark.parametrize("zone", ["Europe/Lisbon", "America/St_Johns", "Australia/Lord_Howe", "America/Nuuk"])
def test_occurrences_sweep_clock_changes(spark, zone):
    days = [datetime(2025, 1, 1) + timedelta(days=k) for k in range(365)]
    for at in ("00:00:00", "01:30:00", "02:15:00"):
        got = column(spark, [d.date() for d in days], lambda x, t=at: F.unix_seconds(dates.occurrence(x, t, zone)), "date")
        h, m, _ = map(int, at.split(":"))
        wall = [d.replace(hour=h, minute=m, tzinfo=ZoneInfo(zone)) for d in days]
        assert got == [int(w.astimezone(UTC).timestamp()) for w in wall]


def test_substitutions(spark):
    pairs = {"ring": ["rng", "r1ng"], "red": ["crimson"], "blue": ["crimson"]}
    assert substitutions.reverse_map(pairs) == {"rng": "ring", "r1ng": "ring"}
    assert column(spark, ["The R1ng of rng", "crimson", None], lambda x: substitutions.decensor(x, pairs)) == ["the ring of ring", "crimson", ""]
    assert column(spark, ["Ring & Tea", "salt and tea"], lambda x: substitutions.search_variants(x, pairs)) == [["Ring & Tea", "Ring and Tea", "rng and tea", "r1ng and tea"], ["salt and tea", "salt & tea"]]
    assert column(spark, ["a a a", "b"], lambda x: substitutions.replace_phrase(x, "a", "c")) == ["c a c", "b"]


def test_urls(spark):
    given = ["https://h.x/a//b?q=1/2#f", "h/a", "", None]
    assert column(spark, given, urls.segments) == [["h.x", "a", "b"], ["h", "a"], [], []]
    assert column(spark, given, urls.title_slug) == ["b", "a", "", ""]
    assert column(spark, ["http://h/graphql//", "http://h"], urls.base_url) == ["http://h", "http://h"]


def test_ratio_is_the_library_ratio(spark):
    pairs = [("red ring", "ring red"), ("", ""), ("a" * 300, "ab" * 150), ("tea", None)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(similarity.ratio("a", "b")).collect()
    assert [r[0] for r in rows] == [SequenceMatcher(None, a, b or "").ratio() for a, b in pairs]


def score(spark, name, folder, title, artist):
    rows = spark.createDataFrame([(name, folder, title, artist)], "n string, f string, t string, a string")
    return tuple(similarity.with_match_score(rows, "n", "f", "t", "a").first()["m"])


def plain_score(name, folder, title, artist, stem, own, as_title, bare):
    """The score of every view, none left out; scalars of the names are given."""
    junk = {*vocab.JUNK_TOKENS, *vocab.STOPWORDS}
    words = lambda x: [w for w in text.normal_form(x).split(" ") if w and w not in junk]
    views = [stem, *([own] if set(words(own)) - set(words(artist)) else []), *([as_title] if as_title != stem else [])]
    wanted, best = text.normal_form(title), 0.0
    for view in views:
        normal, of = text.normal_form(view), words(view)
        if normal and wanted:
            found = sum(w in words(title) for w in of) / len(of) if of else 0.0
            best = max(best, 0.7 * found + 0.3 * SequenceMatcher(None, normal, wanted).ratio())
    wide, narrow = ({*words(x), *words(own)} - set(words(artist)) for x in (stem, bare))
    contained = len(narrow) >= 2 and not wide - set(words(title))
    return round(max(best, 0.9) if contained else best, 3), contained, len(narrow)


def test_scores_agree_with_a_plain_statement(spark):
    rng = random.Random(2)
    pool = ["Quiet", "Harbour", "Walk", "Ivy", "Wood", "the", "of", "1080p", "Café", "Noir", "red", "ring", "-", "Series"]
    phrase = lambda n: " ".join(rng.choice(pool) for _ in range(rng.randrange(n + 1)))
    cases = [(phrase(5) + rng.choice([".mp4", "", ".xyz"]), phrase(3), phrase(5), phrase(2)) for _ in range(400)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n string, f string, t string, a string")
    stem = text.strip_ext(F.col("n"))
    bare = similarity.strip_unknown_ext(stem)
    parts = rows.select("i", stem.alias("stem"), text.clean_folder(F.col("f")).alias("own"), similarity.title_view(F.col("n")).alias("as_title"), F.coalesce(similarity.without_series_prefix(bare), bare).alias("bare"))
    views = {r["i"]: tuple(r)[1:] for r in parts.collect()}
    got = {r["i"]: tuple(r["m"]) for r in similarity.with_match_score(rows, "n", "f", "t", "a").collect()}
    assert got == {i: plain_score(*c, *views[i]) for i, c in enumerate(cases)}


def test_match_scores(spark):
    assert score(spark, "Quiet Harbour.mp4", "Ivy Wood", "Quiet Harbour", "Ivy Wood") == (1.0, True, 2)
    assert score(spark, "Ivy Wood.mp4", "Ivy Wood", "Ivy Wood Harbour", "Ivy Wood")[2] == 0
    value, contained, n = score(spark, "Series - Harbour.mp4", "Ivy", "Quiet Harbour", "Ivy")
    assert n == 1 and not contained and 0.5 < value < 1
    assert score(spark, "Quiet Harbour Walk.mp4", "", "The Quiet Harbour Walk at Night Again", None)[:2] == (0.9, True)
    assert score(spark, "", "", "", "") == (0.0, False, 0)


def test_views_of_names(spark):
    assert column(spark, ["Set -- Tea.mp4", " - Tea", "Tea - ", "Tea"], lambda x: similarity.without_series_prefix(text.strip_ext(x))) == ["Tea", None, None, None]
    assert column(spark, ["a.xyz1", "a.2023", "a.b c", ".abc", "a.b2.c3"], similarity.strip_unknown_ext) == ["a", "a.2023", "a.b c", ".abc", "a.b2"]


def test_nfc_makes_content_ids_equal(spark):
    from attesta.operators import store

    one = column(spark, ["é", unicodedata.normalize("NFD", "é")], lambda x: store.content_id(F.lit("f"), F.lit("t"), x, F.lit("{}")))
    assert one[0] == one[1]
