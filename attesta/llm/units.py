"""Token ids of whole texts through a public tokenizer, remembered by stretches that never interact.

A byte-level BPE first cuts text with a pattern in which no piece crosses from a non-space character to a
following space. A text may therefore be cut before any space that follows a non-space character, and each
stretch encoded alone gives the same ids as the whole text. Stretches repeat, so the ids of those met lately
are remembered, a bounded number of them. Texts that hold an added token's string, and all texts under tokenizers
of another kind, are encoded whole by the library.
"""

from __future__ import annotations

import json
import re
import string
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from attesta.llm.common import kept, slices

TOKENIZER = "byte_bpe_50k.json"
#: Longest stretch that is remembered.
LONGEST = 48
#: Words that a worker remembers at most; text that is cut and put together at once.
MOST, SLICE_CHARS = 300_000, 2 << 20
_PUNCTUATION = string.punctuation
_OPEN_END = r"^$|[\s\pZ\x{85}\x{1c}-\x{1f}]$"
_LATIN = "^[A-Za-z\u00c0-\u024f]+$"


def byte_alphabet() -> dict[int, str]:
    """Latin-1 code point -> the character that stands for this byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the others take code points from 256 on, in order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in own else next(others)) for b in range(256)}


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file as text, to be sent to executors (a vocabulary of fixed size, about 2 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


class _Memory:
    """Ids of the stretches met lately, as Arrow arrays: some 30 bytes an entry, and whole arrays are looked up at once.

    When it holds ``most`` entries, only those of the arrays looked up last are kept, which changes no result.
    """

    def __init__(self, make, most: int):
        self.make, self.most = make, most
        self.keys, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def of(self, units: pa.Array) -> pa.Array:
        """``make`` of each of the distinct ``units``, as large binaries."""
        at = pc.index_in(units, value_set=self.keys)
        gone = at.is_null()
        new = units.filter(gone)
        made = pa.array(list(map(self.make, new.to_pylist())), pa.large_binary())
        place = pc.if_else(gone, pa.array(len(self.ids) + np.cumsum(np.asarray(gone)) - 1), at.cast(pa.int64()))
        every = pa.concat_arrays([self.ids, made])
        out = every.take(place)
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        if len(self.keys) + len(new) <= self.most:
            self.keys, self.ids = pa.concat_arrays([self.keys, new.filter(short)]), pa.concat_arrays([self.ids, made.filter(short)])
        else:
            short = pc.less_equal(pc.binary_length(units), LONGEST)
            self.keys, self.ids = units.filter(short), out.filter(short)
        return out


class UnitEncoder:
    """Packed ids (16 or 32 bits each) of texts, as Tokenizer.encode(text, add_special_tokens=False) gives them."""

    def __init__(self, spec: str, most: int = MOST):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype = np.dtype(np.uint16 if narrow else np.uint32)
        self.code = "H" if narrow else "I"
        kind = json.loads(spec)
        first = kind.get("pre_tokenizer") or {}
        self.divisible = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not kind.get("normalizer")
        added = [x["content"] for x in kind.get("added_tokens") or ()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.alphabet = byte_alphabet()
        self.packed = [i.to_bytes(self.dtype.itemsize, sys.byteorder) for i in range(self.tokenizer.get_vocab_size())]
        self.tokenize = self.tokenizer.model.tokenize
        self.spaced = _Memory(self._spaced, most // 4)  # stretch without its leading space
        self.words = _Memory(self._word, most)  # word without its leading space
        self.tails: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(piece)])

    def _word(self, word: str) -> bytes:
        return self._piece("Ġ" + (word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)))

    def _spaced(self, unit: str) -> bytes:
        return self._cut(" " + unit)

    def _cut(self, text: str) -> bytes:
        return b"".join([self._piece(x[0]) for x in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]) if text else b""

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.divisible or self.added and self.added.search(text):
            return self._whole(text)
        first, *rest = _joined(text.split(" "))
        if not rest:
            return self._cut(first)
        coded = pa.array(rest, pa.large_string()).dictionary_encode()
        return self._cut(first) + b"".join(self.spaced.of(coded.dictionary).take(coded.indices).to_pylist())

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """encode of each text; stretches are told apart and put together by Arrow, so Python sees new words only."""
        if not self.divisible:
            return [self._whole(x) for x in texts]
        return [x for own in slices(texts, SLICE_CHARS) for x in self._slice(texts[own])]

    def _slice(self, texts: list[str]) -> list[bytes]:
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        starts, ends = offsets[:-1], offsets[1:]
        coded = lists.flatten().dictionary_encode()
        indices = coded.indices.to_numpy()
        later = np.ones(len(indices), bool)
        later[starts] = False  # a text's first stretch has no space before it
        ids = self._distinct(coded.dictionary).take(pa.array(indices[later]))
        data = memoryview(ids.buffers()[2]) if ids.buffers()[2] else memoryview(b"")
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset) if len(ids) else np.zeros(1, np.int64)
        cuts = at[offsets - np.arange(len(offsets))].tolist()
        # white space meets where a stretch is empty or ends in it: those texts are cut with more care
        meets = np.asarray(pc.match_substring_regex(coded.dictionary, _OPEN_END))
        careful = set(np.searchsorted(ends, np.flatnonzero(meets[indices]), "right").tolist()) if meets.any() else set()
        if self.added:
            careful |= {k for k, x in enumerate(texts) if self.added.search(x)}
        firsts = coded.dictionary.take(pa.array(indices[starts])).to_pylist()
        return [self.encode(x) if k in careful else self._cut(firsts[k]) + bytes(data[cuts[k] : cuts[k + 1]]) for k, x in enumerate(texts)]

    def _tail(self, tail: str) -> bytes:
        if len(self.tails) > 10_000:
            self.tails.clear()
        if tail not in self.tails:
            self.tails[tail] = self._cut(tail)
        return self.tails[tail]

    def _distinct(self, units: pa.Array) -> pa.Array:
        """Ids of distinct stretches after a space, as large binaries.

        Latin letters (surely letters to any Unicode version), then only ASCII punctuation, are two pieces.
        """
        trimmed = pc.utf8_rtrim(units, _PUNCTUATION)
        simple = pc.and_(pc.utf8_is_alpha(trimmed), pc.match_substring_regex(trimmed, _LATIN))
        words = trimmed.filter(simple).dictionary_encode()
        heads = self.words.of(words.dictionary).take(words.indices)
        tails = pc.replace_substring_regex(units.filter(simple), "^[^!-/:-@\\[-`{-~]+", "").dictionary_encode()
        coded = pa.array([self._tail(x) for x in tails.dictionary.to_pylist()], pa.large_binary()).take(tails.indices)
        easy = pc.binary_join_element_wise(heads, coded, pa.scalar(b"", pa.large_binary()))
        hard = self.spaced.of(units.filter(pc.invert(simple)))
        mask = np.asarray(simple)
        return pa.concat_arrays([easy, hard]).take(pa.array(np.where(mask, np.cumsum(mask) - 1, len(easy) + np.cumsum(~mask) - 1)))


def _joined(parts: list[str]) -> list[str]:
    """Stretches of a text in which white space meets: no cut after white space."""
    units, held = [], parts[0]
    for part in parts[1:]:
        if held and not held[-1].isspace():
            units.append(held)
            held = part
        else:
            held += " " + part
    return [*units, held]


def encoder(spec: str) -> UnitEncoder:
    """One encoder per worker process, so that its memory serves all tasks that encode (``lean`` with keeps="encoder")."""
    return kept("encoder", hash(spec), lambda: UnitEncoder(spec))
