"""Each stage of the pipeline on its own input, against plain statements."""

from __future__ import annotations

import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from attesta.llm import mixing, toxicity
from tests.llm import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
INSULTS = ["wretch", "vermin"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [a + b for a in ("ba", "ko", "ri", "tu", "se", "lo") for b in ("na", "mi", "po", "ze", "ga")]
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows, labels = [], []
    for i in range(360):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 90)))
        toxic = i % 4 == 0
        if toxic:
            text += " " + " ".join(rng.choice(INSULTS) for _ in range(3))
        elif i % 9 == 1:
            text += " " + passage
        rows.append((i, text, "xx", f"s{i % 5}" if i % 7 else None, len(text)))
        labels.append((i, 1, int(toxic)))
    for k in range(20):  # copies, some in capitals
        i, text, *rest = rows[8 * k + 1]
        rows.append((400 + k, text.upper() if k % 2 else text, *rest))
    rows += [(500, None, None, None, None), (501, "", "xx", "s0", 0)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """Rows before the first stage and after each."""
    docs, out, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), [], tmp_path_factory.mktemp("stages")
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
        assert docs.columns == (COLUMNS if k < 4 else ["doc_id", "start", "n_tokens", "ids_crc32"])
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(spark, sf_dir, steps):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()
    assert ids(steps[1]) == sorted(r["doc_id"] for r in scored if not r["predicted"])
    left = ids(steps[1])
    assert not [i for i in left if i < 360 and i % 4 == 0] and len(left) > 0.95 * sum(1 for r in steps[0] if not any(w in (r["text"] or "").lower() for w in INSULTS))


def test_one_document_of_each_group_stays(steps):
    prints = {r["doc_id"]: plain.fingerprint(r["text"]) for r in steps[1]}
    roots = plain.components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert ids(steps[2]) == sorted(set(roots.values()))


def test_contaminated_documents_go(steps, spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = plain.contamination([(r["doc_id"], r["text"]) for r in steps[2]], items)
    assert ids(steps[3]) == [r[0] for r in judged if not r[-1]] and len(steps[3]) < len(steps[2])


def test_sources_come_near_their_targets(steps):
    sizes: Counter = Counter()
    for r in steps[3]:
        sizes[r["source"]] += len(plain.words(r["text"]))
    targets = mixing.capped_targets(dict(sizes), mixing.cycled_weights(list(sizes)))
    taken: Counter = Counter()
    for r in steps[4]:
        taken[r["source"]] += len(plain.words(r["text"]))
    longest = max(len(plain.words(r["text"])) for r in steps[3])
    assert all(abs(taken[s] - targets[s]) <= longest for s in sizes)
    assert max(Counter(ids(steps[4])).values()) <= 3 and {tuple(r) for r in steps[4]} <= {tuple(r) for r in steps[3]}


def test_token_files_hold_the_mix(steps):
    tokenizer, start, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(steps[4], key=lambda r: (r["doc_id"], r["text"] or "")):
        own = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        expected.append((r["doc_id"], start, len(own), crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(map(tuple, steps[5])) == sorted(expected)


def test_run_applies_all_stages(spark, sf_dir, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, steps[5]))
