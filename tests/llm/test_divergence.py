"""Divergence of sources against plain counting, and against the statement in SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from attesta.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, value long, rank string, term string, p0 int"


def plain(rows, min_docs, top):
    df, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        df[lang or ""].update(set(words))
        n[lang or "", source or ""].update(words)
    out = []
    for lang in df:
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        own = {s: {t: c[t] for t in kept} for (x, s), c in n.items() if x == lang}

        def p(counts, kept=kept):
            total = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c + 5) // total for t, c in counts.items()}

        q = p({t: sum(c[t] for c in own.values()) for t in kept})
        ps = {s: p(c) for s, c in own.items()}
        for s in own:
            pair = [(-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            term = [(q[t] - ps[s][t], t.encode(), t) for t in kept if own[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def rows_(seed=4, n=300):
    rng = random.Random(seed)
    words = ["The", "stone", "é", "ÀB", "日本", "x1y", "it's", "ß", "blue-ish", "a", *(f"w{'abcdefghij'[k % 10]}{'klmno'[k // 10]}" for k in range(50))]
    out = []
    for k in range(n):
        lang, source = rng.choice(["en", "en", "de", None, "x"]), rng.choice(["a", "b", "b", "é", "Z", None, "\U0001f600", "｡"])
        w = rng.sample(words, 12 + len(source or "") * 5)
        out.append((None if k % 50 == 0 else "" if k % 51 == 0 else " ".join(rng.choice(w) for _ in range(rng.randrange(40))), lang, source))
    return [*out, ("only here", "alone", "one"), ("0 1 2", "numbers", "one"), (None, "numbers", "two"), *[("same text again", "en", "a")] * 40]


def frame(spark, rows):
    return spark.createDataFrame([(k % 7, *r, 1, "r", "t", 2) for k, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(("min_docs", "cells", "bucket_rows", "top"), [(30, None, 200_000, 50), (3, 64, 7, 4), (300, 1 << 10, 50, 50), (1, 8, 1, 2)])
def test_divergence_agrees_with_plain_counting(spark, min_docs, cells, bucket_rows, top):
    got = divergence.source_divergence(frame(spark, rows_()), min_docs=min_docs, cells=cells, bucket_rows=bucket_rows, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows_(), min_docs, top)


def test_sketch_never_underestimates_and_merges(spark):
    rows = rows_(9, 200)
    docs = divergence._plain(frame(spark, rows).repartition(5), "text", "lang", "source")
    merged = divergence.sketch(docs, 256)
    df = defaultdict(Counter)
    for text, lang, _ in rows:
        df[(lang or "").encode()].update(set(divergence.terms((text or "").encode())))
    for lang, counts in df.items():
        for least in (1, 10, 30):
            assert all(ok for ok, w in zip(merged.at_least(lang, list(counts), least), counts, strict=True) if counts[w] >= least)
    assert not merged.at_least(b"en", [b"never seen here"], 30).all() or merged.rows.min() >= 30


def test_tallies_count_exactly_whatever_is_ruled_out():
    rng = random.Random(6)
    rows = [(rng.choice([b"a", b"b"]), [f"w{rng.randrange(80)}".encode() for _ in range(rng.randrange(30))]) for _ in range(200)]
    found = divergence.Sketch(1 << 12, 30)
    found.add(b"en", Counter(w for _, words in rows for w in set(words)))
    own = divergence._Tally(b"en")
    for k in range(0, 200, 37):
        own.add(rows[k : k + 37], found, 30)
    got = {(r["source"].encode(), r["term"].encode()): (r["n"], r["docs"]) for batch in own.given() for r in batch.to_pylist()}
    n, docs = Counter((s, w) for s, words in rows for w in words), Counter((s, w) for s, words in rows for w in set(words))
    df = Counter(w for _, words in rows for w in set(words))
    assert all(v == (n[k], docs[k]) for k, v in got.items()) and {k for k in n if df[k[1]] >= 30} <= got.keys()


def test_sketch_saturates():
    own = divergence.Sketch(64, 30)
    for _ in range(5):
        own.add(b"en", Counter({b"a": 200, b"b": 3}))
    assert own.rows.max() == 255 and own.at_least(b"en", [b"a"], 30).all()


def test_empty_table(spark):
    assert divergence.source_divergence(frame(spark, [])).collect() == []


def test_statement(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({k: [r[i] for r in rows_()] for i, k in enumerate(("text", "lang", "source"))}), tmp_path / "documents.parquet")
    got = sorted(tuple(r) for r in queries.op13_source_divergence(spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{Path(tmp_path)}/documents.parquet'")
        assert got == sorted(c.execute(queries.oracle_sql()["op13_source_divergence"]).fetchall()) == plain(rows_(), 30, 50)
