"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped (a dummy space first, spaces as U+2581) and cut into its characters. An agenda holds every pair of
adjacent symbols whose concatenation is a piece; the pair of the highest score, among equals the leftmost, is merged and
its new neighbours join the agenda, until none is left. Characters that are no piece fall back to their bytes.

No piece of such a vocabulary goes on with U+2581 after another character (``Vocabulary`` looks; if one does, whole texts
are the stretches). A text is therefore cut before each U+2581 that follows another character, and each distinct stretch
is encoded once: short ones together, where one round takes the best pair of every stretch from an agenda kept as an
array of (rank, place) keys; long ones (as of scripts without spaces) are cut between characters that stand side by side in no
piece, and what is still long is encoded with a heap. A worker remembers the stretches met lately, a bounded number.

All is checked against the sentencepiece library in each Arrow batch, which fails where they differ: the ids of every distinct
stretch as it is encoded, and the decoded text of every document's ids. (That whole texts have the ids of their stretches follows from
the vocabulary, and tests compare whole texts.)

Defined results: a null text is encoded as empty, so it has no ids and decodes to the empty text; empty texts too; null and
repeated doc_ids are kept as they are, a row for each; an empty table gives no rows; other columns are ignored; ids outside
the vocabulary are an error; control pieces (begin, end) decode to nothing and the unknown piece to its surface.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import kept, lean, slices, small_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Kinds of pieces as the model file numbers them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Symbols of a stretch that is encoded among others; stretches a worker remembers, and their longest; characters encoded at once.
LONG, MOST, LONGEST, SLICE_CHARS = 200, 400_000, 64, 4 << 20
NONE = np.int64(1) << 62


def model_bytes(path: str | None = None) -> bytes:
    """The model file, to be sent to executors (a vocabulary of fixed size, about 0.5 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Pieces, and which pairs of symbols merge into which piece, at what rank (0 is the highest score; equal scores share a rank)."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as messages

        spec = messages.ModelProto()
        spec.ParseFromString(model)
        own, norm = spec.trainer_spec, spec.normalizer_spec
        kinds = [p.type for p in spec.pieces]
        if own.model_type != own.BPE or not own.byte_fallback or own.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type vocabulary with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or {USER_DEFINED, UNUSED} & {*kinds}:
            raise ValueError("a vocabulary with normalisation rules, user-defined or unused pieces")
        self.n = len(kinds)
        self.text = [p.piece for p in spec.pieces]
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = []
        for k, p in enumerate(spec.pieces):
            if p.type == BYTE:
                b = int(p.piece[3:-1], 16)
                self.byte_ids[b] = k
                self.surface.append(bytes([b]))
            elif p.type == NORMAL:
                self.ids[p.piece] = k
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.surface.append(own.unk_surface.encode() if p.type == UNKNOWN else b"")
        self.control = frozenset(k for k, kind in enumerate(kinds) if kind == CONTROL)
        self.bytes = frozenset(self.byte_ids)
        scores = sorted({-spec.pieces[k].score for k in self.ids.values()})
        place = {s: r for r, s in enumerate(scores)}
        # characters of pieces that are no piece themselves are symbols too, numbered after the pieces
        symbols = dict(self.ids)
        for c in sorted(set(chain.from_iterable(self.ids))):
            symbols.setdefault(c, len(self.text) + len(symbols) - len(self.ids))
        self.symbols = symbols
        self.of_point = np.full(0x110000, -1, np.int64)  # symbol of each character
        for c in filter(lambda x: len(x) == 1, symbols):
            self.of_point[ord(c)] = symbols[c]
        #: (left symbol, right symbol) -> (rank, piece)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, k in self.ids.items():
            rank = place[-spec.pieces[k].score]
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    self.merges[left, right] = rank, k
        #: (character << 21 | next one) of all that stand side by side in a piece, sorted: no merge spans any others
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.divisible = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._tables()

    def _tables(self) -> None:
        """``merges`` as open-addressed arrays: key, rank and piece of each slot."""
        bits = max(4, (8 * len(self.merges)).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        left, right = (np.fromiter((k[i] for k in self.merges), np.int64, len(self.merges)) for i in (0, 1))
        rank, piece = (np.fromiter((v[i] for v in self.merges.values()), np.int64, len(self.merges)) for i in (0, 1))
        self.keys, self.rank, self.piece = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64), np.zeros(1 << bits, np.int64)
        key, at = left << 32 | right, self._slot(left, right)
        self.probes = 0
        while len(key):
            self.probes += 1
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = first[free[first]]
            for table, values in ((self.keys, key), (self.rank, rank), (self.piece, piece)):
                table[at[won]] = values[won]
            rest = np.ones(len(key), bool)
            rest[won] = False
            key, rank, piece, at = key[rest], rank[rest], piece[rest], at[rest] + 1 & self.mask

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        mixed = left * 0x9E3779B1 ^ right * 0x85EBCA77
        return (mixed ^ mixed >> 15) & self.mask

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of symbols; rank NONE where they don't merge. A negative symbol merges with nothing."""
        at, key = self._slot(left, right), left << 32 | right
        rank, piece = np.full(len(at), NONE, np.int64), np.zeros(len(at), np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            found = self.keys[at[open_]]
            hit = open_[found == key[open_]]
            rank[hit], piece[hit] = self.rank[at[hit]], self.piece[at[hit]]
            open_ = open_[(found != key[open_]) & (found >= 0)]
            if not len(open_):
                break
            at[open_] = at[open_] + 1 & self.mask
        return rank, piece


class Coder:
    """encode and decode of texts by one vocabulary; remembers stretches between calls. ``check``: against the library."""

    def __init__(self, model: bytes, most: int = MOST, check: bool = False):
        self.own = Vocabulary(model)
        self.library = None
        if check:
            from sentencepiece import SentencePieceProcessor

            self.library = SentencePieceProcessor(model_proto=model)
        self.most = most
        self.memory: dict[str, bytes] = {}
        self.stretch = re.compile(f"{SPACE}+[^{SPACE}]*" if self.own.divisible else r"(?s).+")

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text."""
        out = []
        for own in slices(texts, SLICE_CHARS):
            cut = [self.stretch.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts[own]]
            every = set(chain.from_iterable(cut))
            new = list(every - self.memory.keys())
            if len(self.memory) + len(new) > self.most:
                self.memory.clear()
                new = list(every)
            got = self._stretches(new)
            if self.library:
                self.check_ids(new, got)
            self.memory.update(zip(new, got, strict=True))
            out += [np.frombuffer(b"".join(map(self.memory.__getitem__, x)), np.int32) for x in cut]
            if max(map(len, new), default=0) > LONGEST:
                for x in new:
                    if len(x) > LONGEST:
                        del self.memory[x]
        return out

    def _stretches(self, stretches: list[str]) -> list[bytes]:
        if max(map(len, stretches), default=0) <= LONG:
            return self._together(stretches)
        parts = [self._parts(x) if len(x) > LONG else [x] for x in stretches]
        flat = list(chain.from_iterable(parts))
        short = iter(self._together([x for x in flat if len(x) <= LONG]))
        done = iter([next(short) if len(x) <= LONG else self.by_heap(x) for x in flat])
        return [b"".join([next(done) for _ in own]) for own in parts]

    def _parts(self, stretch: str) -> list[str]:
        """A long stretch cut between characters that stand side by side in no piece."""
        points = np.frombuffer(stretch.encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.own.beside, pairs), max(len(self.own.beside) - 1, 0))
        cuts = (np.flatnonzero(self.own.beside[at] != pairs) + 1 if len(self.own.beside) else np.arange(1, len(stretch))).tolist()
        return [stretch[a:b] for a, b in zip([0, *cuts], [*cuts, len(stretch)], strict=True)]

    def _fallback(self, c: str) -> list[int]:
        return [self.own.byte_ids[b] for b in c.encode()]

    def by_heap(self, stretch: str) -> bytes:
        """Packed ids of one stretch, by a heap of rank << 40 | left place.

        An entry holds if the pair that begins at its place still has its rank; a pair that has changed has an entry of its own.
        """
        own, n, dead = self.own, len(stretch), -2
        symbols = array("q", own.of_point[np.frombuffer(stretch.encode("utf-32-le"), np.uint32)].tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        merges = own.merges
        agenda: list[int] = []

        def rank(i: int) -> int:
            found = merges.get((symbols[i], symbols[after[i]])) if 0 <= i and after[i] < n else None
            return -1 if found is None else found[0]

        for i in range(n - 1):
            if (r := rank(i)) >= 0:
                agenda.append(r << 40 | i)
        heapq.heapify(agenda)
        while agenda:
            top = heapq.heappop(agenda)
            i = top & 0xFFFFFFFFFF
            if symbols[i] == dead or rank(i) != top >> 40:
                continue
            j = after[i]
            symbols[i], symbols[j] = merges[symbols[i], symbols[j]][1], dead
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if (r := rank(k)) >= 0:
                    heapq.heappush(agenda, r << 40 | k)
        out = array("i")
        for c, x in zip(stretch, symbols, strict=True):
            if x != dead:
                out.extend((x,) if 0 <= x < own.n else self._fallback(c))
        return out.tobytes()

    def _together(self, stretches: list[str]) -> list[bytes]:
        """Ids of many stretches at once: each round merges the best pair of every stretch that has one."""
        if not stretches:
            return []
        own = self.own
        points = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)
        symbols = own.of_point[points]
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        ends = np.cumsum(lengths)
        n = len(points)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n  # the place after the last stands for none
        before[ends - lengths] = n
        symbols = np.append(symbols, -1)
        before, piece = np.append(before, n), np.zeros(n + 1, np.int64)
        keys = np.full(n + 1, NONE, np.int64)

        def put(at: np.ndarray) -> None:
            rank, piece[at] = own.look_up(symbols[at], symbols[after[at]])
            keys[at] = np.where(rank < NONE, rank << 32 | at, NONE)

        after = np.append(after, n)
        put(np.arange(n))
        keys[n] = NONE
        live, starts, size = keys[:n], ends - lengths, lengths
        while True:
            best = np.minimum.reduceat(live, starts)
            busy = best < NONE
            if not busy.any():
                break
            i = best[busy] & 0xFFFFFFFF
            j = after[i]
            symbols[i], symbols[j] = piece[i], -2
            keys[j] = NONE
            after[i] = after[j]
            before[after[i]] = i
            put(i)
            left = before[i]
            put(left[left < n])
            symbols[n], keys[n] = -1, NONE
            # agenda of the stretches that may go on, gathered anew
            starts, size = (ends - lengths)[busy] if len(busy) == len(lengths) else base[busy], size[busy]
            base = starts
            spread = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
            live, starts = keys[spread], np.cumsum(size) - size
        return self._gathered(points, symbols[:n], lengths)

    def _gathered(self, points: np.ndarray, symbols: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Ids of each stretch from what is left of its symbols; places of characters without a piece give their bytes."""
        alive = symbols != -2
        lost = alive & ((symbols < 0) | (symbols >= self.own.n))
        ids = symbols.astype(np.int32)
        counts = alive.astype(np.int64)
        if lost.any():
            spelt = {c: self._fallback(chr(c)) for c in np.unique(points[lost]).tolist()}
            counts[lost] = [len(spelt[c]) for c in points[lost].tolist()]
            ids = np.repeat(ids, counts)
            at = np.cumsum(counts) - counts
            for place, c in zip(at[lost].tolist(), points[lost].tolist(), strict=True):
                ids[place : place + len(spelt[c])] = spelt[c]
        else:
            ids = ids[alive]
        upto = np.concatenate([[0], np.cumsum(counts)])
        cuts = (4 * upto[np.concatenate([[0], np.cumsum(lengths)])]).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def check_ids(self, stretches: list[str], ids: list[bytes]) -> None:
        """Raises ``Differs`` unless the library gives the same ids. (A lone U+2581 is the piece itself; no text is cut to it alone.)"""
        at = [k for k, x in enumerate(stretches) if len(x) > 1]
        theirs = self.library.encode([stretches[k][1:].replace(SPACE, " ") for k in at], num_threads=1)
        mine = b"".join([ids[k] for k in at])
        flat = np.fromiter(chain.from_iterable(theirs), np.int32)
        lengths = np.fromiter(map(len, theirs), np.int64, len(at))
        if flat.tobytes() != mine or not np.array_equal(4 * lengths, [len(ids[k]) for k in at]):
            bad = next(stretches[k] for k, x in zip(at, theirs, strict=True) if np.array(x, np.int32).tobytes() != ids[k])
            raise Differs(f"ids of {bad[:80]!r}")

    def check_texts(self, ids: list[list[int]], texts: list[str]) -> None:
        for mine, other in zip(texts, self.library.decode(ids, num_threads=1), strict=True):
            if mine != other:
                raise Differs(f"decoded text {other[:80]!r}")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, U+2581 as a space, one leading space gone; bytes that are no UTF-8 become U+FFFD each."""
        own = self.own
        at = 0
        while at < len(ids) and ids[at] in own.control:
            at += 1
        text = b"".join(map(own.surface.__getitem__, ids))
        if at < len(ids) and own.text[ids[at]].startswith(SPACE):
            text = text[1:]
        try:
            return text.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids, at)

    def _decode_runs(self, ids: list[int], first: int) -> str:
        out, held = [], b""
        for k, i in enumerate(ids):
            if i in self.own.bytes:
                held += self.own.surface[i]
                continue
            out.append(_loose(held))
            held = b""
            piece = self.own.surface[i].decode()
            out.append(piece[1:] if k == first and self.own.text[i].startswith(SPACE) else piece)
        return "".join([*out, _loose(held)])


def _loose(data: bytes) -> str:
    """UTF-8 with each byte that belongs to no character as U+FFFD."""
    out = []
    while data:
        try:
            return "".join([*out, data.decode()])
        except UnicodeDecodeError as e:
            out += [data[: e.start].decode(), "�"]
            data = data[e.start + 1 :]
    return "".join(out)


class Differs(ValueError):
    """The library gives other ids or another text."""


def encode_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, check: bool = True) -> DataFrame:
    """One row per input row: doc_id, ids (array of int), decoded (the text that the ids decode to)."""
    raw = model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept("pieces", (hash(raw), check), lambda: Coder(raw, check=check))
        for batch in batches:
            every = [x or "" for x in batch.column(1).to_pylist()]
            for own in slices(every, SLICE_CHARS):
                texts = every[own]
                ids = coder.encode_many(texts)
                listed = [x.tolist() for x in ids]
                decoded = [coder.decode(x) for x in listed]
                if check:
                    coder.check_texts(listed, decoded)
                del listed
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[own.start : own.stop], lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return small_batches(docs, doc_id, text).mapInArrow(lean(run, "pieces"), "doc_id long, ids array<int>, decoded string")


def decode_pieces(rows: DataFrame, ids: str = "ids", doc_id: str = "doc_id", model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with arrays of ids; a null array is empty."""
    raw = model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept("pieces", (hash(raw), False), lambda: Coder(raw))
        for batch in batches:
            texts = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(lean(run, "pieces"), "doc_id long, text string")
