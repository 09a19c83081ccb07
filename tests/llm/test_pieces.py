"""Encoding and decoding against the sentencepiece library and against a plain greedy merge."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import pieces

SCHEMA = "doc_id long, text string, ids string, decoded int"
RAW = pieces.model_bytes()
CODER = pieces.Coder(RAW)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=RAW)
ALPHABET = [*"abcdefg thein  ▁▁.,\n\t1234é日本語😀ß<>/s\0 　�", "hello", "ing", "    ", "<s>", "</s>", "<unk>", "<0x41>", "aaaa", "͸", "ABC"]


def plain(text):
    """All pairs looked at again after each merge."""
    own = CODER.own
    parts = list(pieces.SPACE + text.replace(" ", pieces.SPACE)) if text else []
    ranks = {}
    for (_, _), (rank, k) in own.merges.items():
        ranks[own.text[k]] = rank
    while True:
        best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [x for p in parts for x in ([own.ids[p]] if p in own.ids else [own.byte_ids[b] for b in p.encode()])]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def texts(seed, n, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_ids_and_texts_are_the_librarys():
    own = [*texts(1, 3000), "a" * 3000, " " * 1000, "x y" * 500, "", "日" * 500, "ab" * 200 + " " + "the" * 300]
    ids = CODER.encode_many(own)
    theirs = LIBRARY.encode(own)
    assert [x.tolist() for x in ids] == theirs
    assert [CODER.decode(x.tolist()) for x in ids] == LIBRARY.decode(theirs)


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    ids = CODER.encode(text).tolist()
    assert ids == LIBRARY.encode(text) and CODER.decode(ids) == LIBRARY.decode(ids)


def test_any_ids_decode_as_the_library_decodes_them():
    rng = random.Random(2)
    for k in range(3000):
        ids = [rng.randrange(3 if k % 2 else 0, 400 if k % 3 else 32000) for _ in range(rng.randrange(12))]
        assert CODER.decode(ids) == LIBRARY.decode(ids)


def test_agenda_heap_and_plain_merges_agree():
    for text in texts(3, 150, 30):
        stretches = CODER.stretch.findall(pieces.SPACE + text.replace(" ", pieces.SPACE)) if text else []
        assert plain(text) == [int(i) for s in stretches for i in np.frombuffer(CODER.by_heap(s), np.int32)] == CODER.encode(text).tolist()


def test_a_small_memory_changes_nothing():
    small = pieces.Coder(RAW, 50)
    own = texts(4, 400)
    for k in range(0, 400, 40):
        assert [x.tolist() for x in small.encode_many(own[k : k + 40])] == LIBRARY.encode(own[k : k + 40])
        assert len(small.memory) <= 4000


def test_rows(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, None), (3, ""), (4, " "), (5, "x" * 50_000), (6, "word " * 20_000)]
    df = spark.createDataFrame([(i, t, "other", 1) for i, t in rows], SCHEMA)
    found = pieces.encode_pieces(df)
    assert sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in found.collect()), key=str) == sorted(((i, LIBRARY.encode(t or ""), t or "") for i, t in rows), key=str)
    back = pieces.decode_pieces(found)
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert pieces.encode_pieces(df.limit(0)).collect() == []


def test_a_wrong_encoding_is_told():
    own = pieces.Coder(RAW, check=True)
    assert [x.tolist() for x in own.encode_many(texts(6, 50))] == LIBRARY.encode(texts(6, 50))
    got = own._stretches(["▁Hello", "▁", "▁▁world"])
    own.check_ids(["▁Hello", "▁", "▁▁world"], got)
    ids = LIBRARY.encode("Hello world")
    own.check_texts([ids], ["Hello world"])
    for wrong in ([got[0][:-4], *got[1:]], [got[0], got[1], got[2] + got[1]], [got[0] + got[2][:4], got[1], got[2][4:]]):
        with pytest.raises(pieces.Differs):
            own.check_ids(["▁Hello", "▁", "▁▁world"], wrong)
    with pytest.raises(pieces.Differs):
        own.check_texts([ids], ["Hello worlD"])


def test_long_runs_without_spaces_are_the_librarys():
    rng = random.Random(9)
    han = "".join(chr(rng.randrange(0x4E00, 0x4F00)) if rng.random() < 0.9 else rng.choice("abcthein。，é") for _ in range(30_000))
    base = "".join(rng.choice("ABCDEFabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000))
    own = [han, base, han[:201], "the" * 5000, "a" * 4001, "͸" * 1000]
    assert [x.tolist() for x in CODER.encode_many(own)] == LIBRARY.encode(own)
    assert len(CODER._parts(pieces.SPACE + han)) > 10_000


def test_long_stretches_cost_little_more_than_their_length():
    start = time.time()
    CODER.encode("ab" * 100_000)
    assert time.time() - start < 10
