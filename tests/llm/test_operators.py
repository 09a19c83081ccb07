from __future__ import annotations

import random
import re
import time
from collections import Counter
from html.parser import HTMLParser
from itertools import product
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import class_lm, common, components, decontamination, exact_dedup, html_text, mixing, queries, simhash, substring_dedup, token_counts, token_files, toxicity, units
from attesta.llm.boosting import BoostedTrees, Isotonic
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, kept boolean"


def corpus(seed: int = 5, n: int = 60) -> list[tuple[int, str | None]]:
    """Texts with copies, shared passages, nulls, empties, long ones and odd white space."""
    rng = random.Random(seed)
    vocabulary = ["the", "Ring", "é", "ß", "of", "blue", "x1", "stone.", "À", "water", "日本", "run,", "fast", "tree", "k"]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows: list[tuple[int, str | None]] = []
    for i in range(n):
        w = [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(10) : 13 + rng.randrange(17)]
        rows.append((i * 7 % n, rng.choice([" ", "\n", "  ", " "]).join(w)))
    rows[3] = (rows[3][0], rows[10][1])
    rows[4] = (rows[4][0], (rows[10][1] or "").upper())
    rows[5], rows[6], rows[7] = (rows[5][0], None), (rows[6][0], ""), (rows[7][0], " \t\n")
    rows[8] = (rows[8][0], " ".join(passage * 200))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, f"s{(i or 0) % 4}" if (i or 0) % 9 else None, None, 1, True) for i, t in rows], SCHEMA)


def tuples(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_substring_dedup_agrees_with_plain_windows(spark, docs, block_bytes):
    got = substring_dedup.removal_digest(substring_dedup.substring_dedup(docs, block_bytes=block_bytes))
    assert tuples(got) == plain.substring_dedup(corpus())


def test_windows_of_one_hash_are_told_apart():
    hashes, checks = np.array([7, 7, 3, 7, 7], np.uint64), np.array([1, 2, 1, 1, 2], np.uint32)
    order, new = substring_dedup.equal_groups(hashes, checks)
    assert order.tolist() == [2, 0, 3, 1, 4] and new.tolist() == [True, True, False, True, False]


def test_substring_spans_are_maximal(spark):
    shared = " ".join(f"w{k}" for k in range(20))
    rows = substring_dedup.substring_dedup(frame(spark, [(2, "a " + shared + " b"), (1, shared)])).orderBy("doc_id").collect()
    assert [[tuple(s) for s in r["spans"]] for r in rows] == [[], [(1, 20)]]
    assert rows[1]["kept_text"] == "a b"


def test_fingerprints_and_components(spark, docs):
    rows = corpus()
    prints = {i: plain.fingerprint(t) for i, t in rows}
    roots = plain.components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert tuples(got) == sorted((i, f"{prints[i]:016x}", roots[i]) for i in prints)


@pytest.mark.parametrize(("slot_pairs", "bound"), [(1 << 23, 1 << 20), (0, 1 << 20), (1 << 23, 3)])
def test_links_of_crowded_and_plain_slots(spark, slot_pairs, bound):
    rng = random.Random(2)
    prints: set[int] = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(6):
            for b in rng.sample(range(64), rng.randrange(1, 3)):
                x ^= 1 << b
            prints.add(x)
    prints |= {0, 1, 3, 1 << 40, (1 << 64) - 1}
    ids = dict(enumerate(sorted(prints)))
    expected = plain.components(list(ids), lambda a, b: (ids[a] ^ ids[b]).bit_count() <= 2)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in ids.items()], "fp long, node long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(nodes, slot_pairs), bound=bound).collect()}
    assert {i: roots.get(i, i) for i in ids} == expected


def items(spark):
    rows = corpus()
    texts = [" ".join((rows[8][1] or "").split()[3:40]), rows[20][1], "", None, "stone water run", "nowhere at all to be found in any of these texts that we have made up here", rows[10][1]]
    return [(k, t) for k, t in enumerate(texts)], spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "item_id long, text string, doc_id long")


@pytest.mark.parametrize("test_bytes", [1 << 20, 300])
def test_contamination_agrees_with_plain_windows(spark, docs, test_bytes):
    listed, table = items(spark)
    rows = decontamination.contamination(docs, table, test_bytes=test_bytes)
    got = rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), "contaminated")
    expected = plain.contamination(corpus(), listed)
    assert tuples(got) == expected
    kept = decontamination.drop_contaminated(docs, table, test_bytes=test_bytes)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in expected if not r[-1]]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60))
@settings(deadline=None)
def test_winnowing_covers_every_window(values):
    g = np.array(values, np.uint64)
    chosen = set(decontamination.winnow(g, 9).tolist())
    for a in range(len(values) - 8):
        low = min(values[a : a + 9])
        assert any(values[p] == low and p in chosen for p in range(a, a + 9))


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=200))
@settings(deadline=None)
def test_coded_ids_round_trip(values):
    ranks = np.array(values, np.uint32)
    assert token_files.unpack_ids(*token_files.pack_ids(ranks), len(ranks)).tolist() == values
    ids = np.arange(10, dtype=np.uint32)
    raw = token_files.encode_file(np.array([1, 2]), np.array([len(values), 0]), np.minimum(ranks, 9))
    assert token_files.decode_file(raw, ids)[2].tolist() == [min(v, 9) for v in values]


LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # as it comes, apart from the operators
PIECES = [*"ab1.'s$ \n\té日\x1c\u0085 _ß", "<|endoftext|>", "word", " Über, "]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=6))
@settings(deadline=None, max_examples=200)
def test_stretches_encode_like_whole_texts(texts):
    own = units.encoder(units.tokenizer_json())
    expected = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(own.encode(t), own.dtype).tolist() for t in texts] == expected
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode_many(texts)] == expected


@pytest.mark.parametrize("block_bytes", [1 << 20, 500])
def test_token_files_hold_all_ids_in_order(spark, docs, block_bytes):
    start, expected = 0, []
    rows = [*corpus(), (1000, "x <|endoftext|> y"), (1001, "<|endoftext|>")]
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert tuples(token_files.token_round_trip(frame(spark, rows), block_bytes=block_bytes)) == sorted(expected)


def test_memory_of_words_is_bounded_and_changes_nothing():
    own = units.UnitEncoder(units.tokenizer_json(), most=8)
    texts = [f"alpha beta{k} gamma {k} x{k}y, delta." for k in range(50)]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(own.encode_many([t])[0], own.dtype).tolist() == LIBRARY.encode(t, add_special_tokens=False).ids
    assert len(own.words.keys) <= 8


def test_files_stay_where_they_are_asked_for(spark, docs, tmp_path):
    rows = tuples(token_files.token_round_trip(docs, out_dir=str(tmp_path / "kept"), block_bytes=500))
    assert len(list((tmp_path / "kept").glob("*.tok"))) > 1 and rows == tuples(token_files.token_round_trip(docs))


def test_blocks_follow_the_text_whatever_the_plan(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i, _ in corpus()], "doc_id long, toxic int")
    joined = docs.join(labels, "doc_id").join(labels.withColumnRenamed("toxic", "again"), "doc_id")
    assert common.block_count(joined, "text", 600) == common.block_count(docs, "text", 600) > 10


def test_running_totals_over_ranges(spark):
    rows = [(k * 997 % 10000, k % 7) for k in range(10000)]
    got = dict(common.running_total(spark.createDataFrame(rows, "k long, v long"), "k", "v", "start").select("k", "start").collect())
    total = 0
    for k, v in sorted(rows):
        assert got[k] == total
        total += v


def test_token_counts_for_every_limit(spark, docs):
    lengths = [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for _, t in corpus()]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs))
    for r in sums.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n)
        assert (r["docs_from"], r["tokens_from"]) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
    for limit in (1, 50, 10**6):
        assert token_counts.truncated_total(sums, limit).first()[0] == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]


@pytest.mark.parametrize(("seeds", "classes"), [(14, 4), (300, 1), (3, 8), (0, 5)])
def test_class_model_scores(spark, seeds, classes):
    rng = random.Random(11)
    rows: list[tuple[int, str | None]] = [(i, " ".join(rng.choice("abcdefg") + rng.choice("XYxyzuvw"[: 1 + i % 8]) for _ in range(rng.randrange(0, 40)))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "never seen words " * 3)]
    got = {r["doc_id"]: r for r in class_lm.class_lm_scores(frame(spark, rows), seeds=seeds, classes=classes).collect()}
    scores = plain.class_scores(rows, seeds, classes)
    for i, (held, n, known, total, base) in plain.unigram_base(rows).items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(scores[i])


def test_class_model_over_blocks(spark, docs, monkeypatch):
    whole = {r["doc_id"]: r["score"] for r in class_lm.class_lm_scores(docs, seeds=20, classes=5).collect()}
    parts = class_lm.class_lm_scores(docs.repartition(9), seeds=20, classes=5).collect()
    assert {r["doc_id"]: r["score"] for r in parts} == {i: pytest.approx(x) for i, x in whole.items()}


def test_class_model_without_training_text(spark):
    held = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    (row,) = class_lm.class_lm_scores(frame(spark, [(held, "a b")])).collect()
    assert (row["train_tokens"], row["n_known"], row["n_tokens"]) == (0, 0, 3) and row["score"] == pytest.approx(3 * np.log10(0.5))


def test_exchange_groups_words_of_like_use():
    """Words of two kinds alternate; exchange finds the kinds."""
    kinds = np.array([0, 1] * 5)
    pairs = np.zeros((12, 12))
    pairs[:10, :10] = np.where(kinds[:, None] != kinds[None], 20, 1)
    label = class_lm.exchange_clusters(pairs, 2)
    assert len({(k, x) for k, x in zip(kinds.tolist(), label.tolist(), strict=True)}) == 2


def test_toxicity_learns_from_labels_only_and_generalises(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(["soft", "river", "stone", "green", "walk"]) + rng.choice("abcdefgh") for _ in range(30)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["wretch", "vermin", "WRETCH!", "you vermin"]))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic, None))
    docs, table = frame(spark, [*rows, (1000, None), (1001, "")]), spark.createDataFrame([*labels, (None, 1, None), (5, None, None)], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, table)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and len(got) == 902
    truth = {i: x for i, x, _ in labels}
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    flipped = spark.createDataFrame([(i, 1 - x if i in held else x, None) for i, x, _ in labels], table.schema)
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, flipped)).collect()} == {i: r["score"] for i, r in got.items()}
    assert sorted(r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()) == sorted(i for i, r in got.items() if not r["predicted"])


def test_toxicity_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, empty)).collect()} == {0.0}


def test_isotonic_and_trees():
    x = np.array([0.0, 1, 2, 3, 4, 5])
    curve = Isotonic().fit(x, np.array([0, 1, 0, 1, 1, 1.0]))
    assert (np.diff(curve(np.linspace(-1, 6, 50))) >= 0).all() and curve(np.array([1.5]))[0] == 0.5
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((BoostedTrees().fit(x, y).margin(x) > 0) == (y > 0)).mean() > 0.95


def test_exact_dedup_marks_the_largest_id(spark, docs):
    for heavy in (1, 128):
        groups: dict[str, list[int]] = {}
        for i, t in corpus():
            groups.setdefault(plain.sha((t or "").translate(plain.LOWER)), []).append(i)
        expected = sorted((i, max(ids), len(ids), i == max(ids), h) for h, ids in groups.items() for i in ids)
        assert tuples(exact_dedup.mark_exact_duplicates(docs, heavy=heavy)) == expected
    assert exact_dedup.drop_exact_duplicates(docs).count() == len(groups)


def test_targets_stop_at_three_times_a_source():
    got = mixing.capped_targets({"a": 10, "b": 100, None: 1000}, {"a": 50.0, "b": 1.0, None: 1.0})
    assert got["a"] == 30 and got["b"] == 300 and got[None] == pytest.approx(780)
    assert mixing.cycled_weights([None, "b", "B", "a"]) == {"B": 1.0, "a": 2.0, "b": 3.0, None: 1.0}
    assert mixing.capped_targets({}, {}) == {}


def test_flow_repeats_as_little_as_possible():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 25, "b": 10})
    assert sum(flow["a",].values()) + flow["a", "b"]["a"] == 25 and flow["a", "b"]["b"] + flow["b",]["b"] == 10
    assert flow["b",]["b"] == 10 and flow["a", "b"]["a"] >= 10


def test_flow_costs_no_more_than_any_other():
    """All flows of small networks, tried one by one."""
    rng = random.Random(3)
    for _ in range(25):
        patterns = {p: rng.randrange(1, 4) for p in rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("c",)], 3)}
        quotas = {s: rng.randrange(0, 6) for s in {s for p in patterns for s in p}}
        routes = [(p, s) for p in patterns for s in p]
        best = None
        for amounts in product(*(range(min(quotas[s], 3 * patterns[p]) + 1) for p, s in routes)):
            used, filled = Counter(), Counter()
            for (p, s), n in zip(routes, amounts, strict=True):
                used[p] += n
                filled[s] += n
            if all(used[p] <= 3 * n for p, n in patterns.items()) and all(filled[s] <= q for s, q in quotas.items()):
                cost = sum(max(0, used[p] - n) + max(0, used[p] - 2 * n) for p, n in patterns.items())
                best = min(best or (0, 0), (-sum(amounts), cost))
        flow = mixing.min_cost_flow(patterns, quotas)
        used = {p: sum(x.values()) for p, x in flow.items()}
        assert (-sum(used.values()), sum(max(0, used[p] - n) + max(0, used[p] - 2 * n) for p, n in patterns.items())) == best


def plain_mix(rows):
    """(doc_id, taken) of documents of one source each: what the midpoints of copies in seeded order take."""
    sizes: Counter = Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    targets = mixing.capped_targets(dict(sizes), mixing.cycled_weights(list(sizes)))
    out = []
    for s in sizes:
        quota, ahead = min(round(targets[s]), 3 * sizes[s]), 0
        own = [r for r in rows if r[1] == s]
        buckets = max(1, len(own) // mixing.BUCKET_DOCS)
        for i, _, n, order in sorted(own, key=lambda r: ((((r[3] % 2**64) >> 33) * buckets) >> 31, r[3], r[0])):
            out.append((i, n * sum(2 * r * sizes[s] + 2 * ahead + n < 2 * quota for r in range(3))))
            ahead += n
    return sorted(out)


def test_mix_agrees_with_a_plain_statement(spark):
    rng = random.Random(8)
    docs = frame(spark, [(i, " ".join(["w"] * rng.randrange(0, 40))) for i in range(3000)]).withColumn("source", F.when(F.col("doc_id") % 10 > 0, F.lit("hot")).otherwise(F.col("source")))
    rows = [tuple(r) for r in docs.select("doc_id", "source", F.size(F.split("text", "w")).cast("long") - 1, F.xxhash64(F.lit(mixing.SEED), F.col("doc_id"))).collect()]
    assert tuples(mixing.mix_sources(docs).select("doc_id", "taken")) == plain_mix(rows)


def test_mix_comes_near_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40))) for i in range(2500)]
    docs = frame(spark, rows)
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    totals: dict[float, list] = {}
    for r in got:
        assert r["taken"] in {0, r["size"], 2 * r["size"], 3 * r["size"]}
        cell = totals.setdefault((r["source_size"], r["target"]), [0])
        cell[0] += r["taken"]
    assert len(totals) == 5
    for (_, target), (taken,) in totals.items():
        assert abs(taken - target) <= 41
    copies = {r["doc_id"]: r["copies"] for r in got}
    kept = mixing.repeated(docs)
    assert kept.columns == docs.columns and kept.count() == sum(copies.values())


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10) for i in range(600)]
    docs = frame(spark, rows).withColumn("member", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")))
    got = mixing.mix_sources(docs, sources=F.col("member"), weights=lambda names: dict.fromkeys(names, 1.0)).collect()
    assert all(r["taken"] == 0 for r in got if r["doc_id"] % 3 == 2)
    assert abs(sum(r["taken"] for r in got) - 6000) <= 20


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("a &lt;b&gt; &amp;<!-- c -->d", "a <b> &d"),
        ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
        ("<head><title>t</title></head><body><div>a</div><div>b</div>", "a\nb"),
        ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>", "- x\n- y\n\n  3. q\n  4. r"),
        ("<table><tr><th>Name<th>N<tr><td>long cell<td>1<tr><td colspan=2>both</table>", "Name      | N\nlong cell | 1\nboth"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<div style='display: none'>x</div><span hidden>y</span><script>var t='</p>';</script>z<style>p{}</style>", "z"),
        ("<pre> a\n  b</pre>c", " a\n  b\n\nc"),
        ("<select><option>one<option selected>two</select> <button>go</button>", "two go"),
        ("<b>bold <i>both</b> after</i> <a href='x>y'>link</a>", "bold both after link"),
        ("<dl><dt>t<dd>d</dl><blockquote>q</blockquote>", "t\n  d\n\n  q"),
    ],
)
def test_html_layout(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td colspan=2>Hello world</td></tr></table>", "Hello world"),
        ("<table><tr><td colspan=3>Hi<tr><td colspan=3>there</table>", "Hi\nthere"),
        ("<table><tr><td colspan=2>one<td colspan=2>two<tr><td>a<td colspan=3>spanned</table>", "one | two\na   | spanned"),
    ],
)
def test_html_tables_of_spanned_cells(page, text):
    got = html_text.visible_text(page)
    assert got.replace("|", " ").split() == text.replace("|", " ").split() and len(got.split("\n")) == len(text.split("\n"))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title=it's>Hello world</p><p>it's</p>", "Hello world\n\nit's"),
        ("1 < 2 <3 </ x>y<!--> x --> y<!---> z<!-- a --!>b<? c>", "1 < 2 <3 y x --> y zb"),
        ("kept<a href='never closed>lost", "kept"),
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>B</b></div>c", "B\nc"),
        ("<input value=typed> <input type=hidden value=h><input placeholder=hint> <input type=password value=pw><textarea placeholder=w></textarea>", "typed hint w"),
        ("<select multiple><option>a<option>b</select><select><option disabled>x<option>y</select>", "a\nb\ny"),
        ("<details><summary>S</summary>body</details><details open><summary>T</summary>body</details>", "S\nT\nbody"),
        ("<dialog>d</dialog><dialog open>e</dialog>f", "e\nf"),
        ("a<plaintext>b <i>c</i>", "a\nb <i>c</i>"),
        ("<style>@import 'x'; .x{display:none} p.y{visibility:hidden} @media print{.z{display:none}} #q,i{display:none} div p{display:none}</style>"
         "<p class='x'>1<p class='y w'>2<p class=z>3<p id=q>4</p><i>5</i>6<p class=x style='display:block'>7", "3\n\n6\n\n7"),
        ("<svg><title>t</title><text>drawn</text></svg>", "drawn"),
        ("<table><tr><td colspan=1000>a<td>b<tr><td>c<td>d</table>", "a     | b\nc | d"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
        ("<ol start=12345678><li>a</ol><ol reversed><li>b<li hidden>x<li>c</ol>", "12345678. a\n\n2. b\n1. c"),
        ("<ul>" * 300 + "<li>deep", "  " * 299 + "- deep"),
        ("<style media=print>p{display:none}</style><p>vis", "vis"),
        ("<noscript><style>p{display:none}</style></noscript><p>vis", "vis"),
        ("<template><style>p{display:none}</style></template><p>vis", "vis"),
        ("<style type='text/x'>p{display:none}</style><p>vis", "vis"),
        ("<style>p{display:none} @media screen{p{display:block}}</style><p>vis", "vis"),
        ("<style>p{display:none} div p{display:block}</style><div><p>vis</div>", "vis"),
        ("<style>.js .x{display:block} .x{display:none}</style><p class=x>vis", "vis"),
        ("<style media='screen, print'>p{display:none} b{display:none}</style><p>gone<i>vis</i>", ""),
        ("<style media='(min-width: 9px)'>p{display:none}</style><p>vis", "vis"),
        ("<style>@media print{p{display:none}} @media all{i{display:none}} @supports (x:y){b{display:inline}} b{display:none}</style><p>a <i>gone</i> <b>vis</b>", "a vis"),
        (r"<style>.hidden{display:none} @media (min-width:768px){.md\:block{display:block}}</style><p class='hidden md:block'>vis<p class=hidden>gone", "vis"),
        ("<style>p:not(.y,.z){display:none} q{display:none} q:is(.a, .b){display:block} i{content:'}';display:none}</style><p>a <q>vis</q> <i>gone</i>", "a vis"),
        ("<style>b{display:none;&.on{display:inline}} i{visibility:hidden} p>i[x]{visibility:visible} u{display:none} u::after{display:block}</style><p>a<b class=on>vis</b><b>gone</b><i>is</i><u>gone</u>", "avisis"),
        ("<style>@keyframes k{from{display:block} to{display:none}} p{display:none}</style><p>gone", ""),
        ("<style>p{display:none</style><p>gone", ""),
        ("<listing> a\n  b</listing>c", " a\n  b\n\nc"),
        ("<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>", "日本  | x\nabcde | y"),
    ],
)
def test_html_visibility_and_odd_markup(page, text):
    assert html_text.visible_text(page).strip() == text.strip()


@pytest.mark.parametrize("unit", ["<a ", "<p>x<b>", "<", "<div>a", '<a b="', "<li>x", "<!--", "</", "<td colspan=3>y", "<tr><td rowspan=65534 colspan=1000>x", "<style>a{", "&amp", "<style>p .x:not(", "<style>@media x{p q,"])
def test_html_costs_in_proportion_to_the_page(unit):
    page, began = unit * (300_000 // len(unit)), time.process_time()
    html_text.visible_text(page)
    assert time.process_time() - began < 6


class Shown(HTMLParser):
    """A second, much plainer renderer: words outside hidden elements."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.VOID and (self.hidden or tag in html_text.HIDDEN or "hidden" in dict(attrs) or "none" in (dict(attrs).get("style") or "")):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


TAGS = [f"<{end}{t}>" for t in ("p", "div", "b", "li", "ul", "span", "blockquote", "h2", "pre") for end in ("", "/")]


@given(st.lists(st.sampled_from([*TAGS, "one ", "two", "&lt;x", " ", "<br>", "<!-- c -->", "<script>s</script>", "<i hidden>h</i>", "<em style='display:none'>n</em>", "<a href=\"p>q\">"]), max_size=40).map("".join))
@settings(deadline=None, max_examples=300)
def test_html_words_agree_with_a_plainer_renderer(page):
    plainer = Shown()
    plainer.feed(page)
    plainer.close()
    assert "".join(html_text.visible_text(page).split()).replace("-", "") == "".join(plainer.words)  # but for markers of items


def test_html_of_any_depth_and_all_words(spark):
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert html_text.visible_text(deep) == "core"
    assert html_text.visible_text("<table>" * 200 + "<tr><td>x") .strip() == "x"
    rows = spark.createDataFrame([(1, "<p>a", "t"), (None, None, "t")], "page_id long, html string, text string")
    assert tuples(html_text.extract_text(rows)) == [(None, ""), (1, "a")]
    assert html_text.extract_text(rows.limit(0)).collect() == []


EMPTY = [
    lambda d, s: substring_dedup.substring_dedup(d), lambda d, s: simhash.near_duplicates(d), lambda d, s: decontamination.contamination(d, items(s)[1]),
    lambda d, s: token_files.token_round_trip(d), lambda d, s: class_lm.class_lm_scores(d), lambda d, s: toxicity.score(d, toxicity.train(d, s.createDataFrame([], "doc_id long, toxic int"))),
    lambda d, s: token_counts.suffix_sums(token_counts.length_histogram(d)), lambda d, s: exact_dedup.mark_exact_duplicates(d), lambda d, s: mixing.mix_sources(d),
]


@pytest.mark.parametrize("operator", EMPTY)
def test_empty_tables(spark, operator):
    assert operator(frame(spark, []), spark).collect() == []


@pytest.mark.parametrize("operator", EMPTY[:6] + EMPTY[7:])
def test_null_ids_and_repeated_rows(spark, operator):
    rows = [(None, "a b c d"), (None, None), (4, "a b c d"), (4, "a b c d"), (4, "other words here"), (-3, "x " * 5000)]
    assert operator(frame(spark, rows), spark).count() == len(rows)


def test_queries_are_registered():
    assert sorted({n.split("_")[0] for n in queries.queries()}, key=lambda x: int(x[2:])) == [f"op{k}" for k in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_equal_words_are_judged_in_linear_time():
    index = decontamination.TestIndex([("a", b"word " * 5000), ("b", b"x y " * 40)])
    began = time.process_time()
    (n, spans, ids), (_, other, both) = decontamination.judge([b"word " * 20_000, b"y " + b"x y " * 30 + b"z " + b"word " * 13], index, common.Hashes())
    assert (n, spans, ids) == (20_000, [(0, 20_000)], ["a"]) and (other, both) == ([(0, 61), (62, 75)], ["a", "b"])
    assert time.process_time() - began < 3


def test_columns_with_names_of_internals_stay(spark):
    names = "__id __copies __rows __times __copy __node __n __keep __digest __bad text_hash node kept_node row bad_text".split()
    rows = corpus()[:30]
    df = spark.createDataFrame([(i, t, "s", *range(100, 100 + len(names))) for i, t in rows if i is not None], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    bench = spark.createDataFrame([(1, "nowhere to be found")], "item_id long, text string")
    from attesta.llm import near_copies

    for made in (mixing.repeated(df), near_copies.drop_near_duplicates(df), exact_dedup.drop_exact_duplicates(df), decontamination.drop_contaminated(df, bench), decontamination.drop_contaminated(df, bench, test_bytes=3)):
        assert made.columns == df.columns
        got = made.collect()
        assert got and all(tuple(r)[3:] == tuple(range(100, 100 + len(names))) for r in got)


def test_toxicity_learns_once_from_a_repeated_id(spark):
    rows = [(i, f"you {'vile wretch' if i % 2 else 'kind friend'} number{i} " * 3) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    once = toxicity.train(frame(spark, rows), labels)
    again = toxicity.train(frame(spark, rows + [rows[1]] * 50 + [rows[2]] * 50), labels)
    texts = [t.encode() for _, t in rows] + [b"", b"you vile"]
    assert np.array_equal(once.scores(texts), again.scores(texts))


def test_toxicity_features_and_calibration_against_plain_counts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["you", "vile", "WRETCH!", "kind", "tea", "v1le", "v i l e", "house?", "soooo", "dich"]) for _ in range(rng.randrange(30)))) for i in range(200)]
    lexicon = toxicity.Lexicon({"vile": 3.0, "wretch": 2.5, "wret*": 1.5, "kind": 1.0})
    for (_, text), got in zip(rows, toxicity.features([t.encode() for _, t in rows], lexicon), strict=True):
        tokens = text.split()
        words = [re.sub(r"(.)\1\1+", r"\1\1", t.strip(toxicity._EDGES).lower().replace("1", "i")) for t in tokens]
        n = max(len(tokens), 1)
        spelt = len(re.findall(r"(?:(?<=\s)|^)v i l e(?=\s|$)", text))  # runs of single letters that are whole words of the lexicon
        runs = re.findall(r"(?:(?<=\s)|^)(?:\w )*\w(?=\s|$)", text)
        spelt = sum("".join(r.split()) == "vile" for r in runs)
        hits = sum(w in ("vile", "wretch") for w in words) + spelt
        assert got[0] == pytest.approx(np.log1p(len(tokens))) and got[1] == pytest.approx(hits / n), text
        assert got[4] == pytest.approx(sum(w.startswith("wret") and len(w) > 4 for w in words) / n)
        assert got[16] == pytest.approx(sum(t == "v1le" for t in tokens) / n) and got[19] == pytest.approx(sum(w in ("you", "dich") for w in words) / n)
        assert got[14] == pytest.approx(text.count("!") / n) and got[15] == pytest.approx(text.count("?") / n)
    margins, y = np.array([rng.random() for _ in range(200)]), np.array([float(rng.random() < 0.4) for _ in range(200)])
    order = np.argsort(margins, kind="stable")
    curve = Isotonic().fit(margins, y)(margins)[order]
    # pooled adjacent violators: the greatest lower and least upper averages meet
    best = [max(min(y[order][a : b + 1].mean() for b in range(k, 200)) for a in range(k + 1)) for k in range(200)]
    assert np.all(np.diff(curve) >= -1e-12) and np.abs(curve - np.array(best)).max() < 0.2
