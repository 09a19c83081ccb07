"""Brown class-based bigram model: exchange clustering over corpus-wide counts, smoothed scores for every text.

1. Documents become blocks of word hashes in the shared folder. Each block sends, by hash range, its distinct words
   and their training counts; a range sums them and names its most frequent words.
2. The ``SEEDS`` most frequent words of all (ties by hash) are clustered from their bigrams, all other words standing
   as one open class: exchange moves each word to the class that raises the training likelihood most, in sweeps
   until one moves none.
3. Every other training word is inserted by the same gain. Each block sends, by hash range, how often classes of
   seeds, open words and ends stand before and after its words; a range sums that per word, adds the word to the
   class with the largest gain, and answers each block with totals and classes of its own words. So the vocabulary
   that is clustered grows with the corpus and is neither broadcast nor collected.
4. Class bigrams are counted over all training text, now that every word has a class.
5. P(word | previous) = P(class | class of previous) P(word | class). Transitions are Witten-Bell smoothed with
   add-one class shares. Within each class, counts are discounted by n1 / (n1 + 2 n2); what that leaves is shared by
   the words that training has not seen, whose number is estimated from words seen once and twice (n1 (n1 - 1) /
   (2 (n2 + 1)), one at least). After an unseen word, the followers of words seen once stand for its own.
   Probabilities of all known words, the end and so many unseen words add up to one.

Defined results: a null or empty text is its end token; without training text every score is that of unseen words
and ends under add-one shares; a null doc_id counts as the empty text in the held-out rule; rows that repeat a
doc_id are scored one by one; an empty table gives no rows; other columns are ignored. Distinct words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import LOWER, PIECE_BYTES, Hashes, block_count, bucket_of, crc_mod, from_delta, lean, persist, slices, small_batches, sorted_delta, texts_of

#: Words that are clustered among themselves, classes; (mod, remainder) of held-out documents.
SEEDS, CLASSES, HELD_OUT = 2000, 48, (7, 2)
BANDS = 16
#: Context cells whose gains are computed at once.
CELLS = 1 << 15
_NULL_ID = -(2**63)


def _pack(values: np.ndarray) -> bytes:
    """Small non-negative integers, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


class Tokens:
    """A block's documents as word numbers; every document ends with an end token."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, own: np.ndarray, place: np.ndarray):
        self.ids, self.ends, self.own, self.place = ids, ends, own, place  # own: distinct words' hashes, sorted; place: of words, without ends
        self.is_end = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
        self.is_end[ends - 1] = True
        self.held_out = np.array([crc_mod(None if i == _NULL_ID else i, HELD_OUT[0]) == HELD_OUT[1] for i in ids.tolist()], bool)
        self.trains = np.repeat(~self.held_out, np.diff(ends, prepend=0))

    def spread(self, values: np.ndarray, end: int) -> np.ndarray:
        """A value of each distinct word, put at each token; ``end`` at ends."""
        out = np.full(len(self.is_end), end, values.dtype)
        out[~self.is_end] = values[self.place]
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's tokens."""
        starts = self.ends - np.diff(self.ends, prepend=0)
        return np.add.reduceat(values, starts) if len(starts) else values[:0]


BLOCK = "block long, ids binary, ends binary, own binary, place binary, trains long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about PIECE_BYTES of text; the number of one is a hash of its content."""
    hashes = Hashes()
    ids: list[int] = []
    parts: list[np.ndarray] = []
    counts: list[int] = []
    size = 0

    def block() -> pa.RecordBatch:
        own, place = np.unique(np.concatenate(parts), return_inverse=True)
        ends = np.cumsum(np.array(counts, np.int64) + 1)
        raw = [np.array(ids, np.int64).tobytes(), ends.tobytes(), sorted_delta(own), _pack(place)]
        number = xxhash.xxh3_64_intdigest(b"".join(raw)) >> 1
        trains = sum(crc_mod(None if i == _NULL_ID else i, HELD_OUT[0]) != HELD_OUT[1] for i in ids)
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in raw), pa.array([trains])], ["block", "ids", "ends", "own", "place", "trains"])

    for batch in batches:
        names, texts = batch.column(0).fill_null(_NULL_ID).to_pylist(), texts_of(batch.column(1))
        for some in slices(texts, 1 << 20):
            words = [x.translate(LOWER).split() for x in texts[some]]
            counts += map(len, words)
            ids += names[some]
            parts.append(hashes.of([w for x in words for w in x]))
            size += sum(map(len, texts[some])) + 16 * len(words)
            if size >= PIECE_BYTES:
                yield block()
                ids, parts, counts, size = [], [], [], 0
    if ids:
        yield block()


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, Tokens]]:
    for block, ids, ends, own, place in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "ends", "own", "place")), strict=True):
        yield block, Tokens(np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), from_delta(own), _unpack(place))


def _counts(tokens: Tokens) -> np.ndarray:
    return np.bincount(tokens.place, tokens.trains[~tokens.is_end], len(tokens.own)).astype(np.int64)


def _cuts(own: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the hash ranges that hold some of ``own``."""
    at = np.searchsorted(bucket_of(own, buckets), np.arange(buckets + 1, dtype=np.uint64)).tolist()
    return [(k, a, b) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]


def _table(rows: list[tuple], columns: dict[str, pa.DataType]) -> list:
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(columns.values())]


def _send(buckets: int):
    """Distinct words and training counts of each block, by hash range."""
    columns = {"bucket": pa.int64(), "hashes": pa.binary(), "counts": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tokens in _rows(batch):
                counts = _counts(tokens)
                rows = [(k, sorted_delta(tokens.own[a:b]), _pack(counts[a:b])) for k, a, b in _cuts(tokens.own, buckets)]
                yield pa.RecordBatch.from_arrays(_table(rows, columns), list(columns))

    return run


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct hashes, totals, where each row's words stand among them) of the rows of a hash range."""
    arrays = [from_delta(x) for x in table.column("hashes").to_pylist()]
    counts = [_unpack(x) for x in table.column("counts").to_pylist()]
    own, place = np.unique(np.concatenate(arrays), return_inverse=True)
    totals = np.bincount(place, np.concatenate(counts), len(own)).astype(np.int64)
    return own, totals, np.split(place, np.cumsum([len(a) for a in arrays])[:-1])


def _total(most: int):
    """One row for a hash range: its most frequent words, and sums (words, types, types seen once, twice)."""

    def run(table: pa.Table) -> pa.Table:
        own, totals, _ = _summed(table)
        best = np.lexsort((own, -totals))[:most]
        best = best[totals[best] > 0]
        sums = [int(totals.sum()), int((totals > 0).sum()), int((totals == 1).sum()), int((totals == 2).sum())]
        return pa.table({"hashes": pa.array([own[best].tobytes()], pa.binary()), "counts": pa.array([totals[best].tobytes()], pa.binary()), "sums": pa.array([sums], pa.list_(pa.int64()))})

    return run


def _best(most: int):
    """The most frequent words of a task's ranges: (hash, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for h, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes, times = np.concatenate([hashes, np.frombuffer(h, np.uint64)]), np.concatenate([times, np.frombuffer(n, np.int64)])
            keep = np.lexsort((hashes, -times))[:most]
            hashes, times = hashes[keep], times[keep]
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times)], ["hash", "times"])

    return run


def seed_labels(own: np.ndarray, hashes: np.ndarray, label: np.ndarray, otherwise: int) -> np.ndarray:
    """Label of each of ``own``: that of its equal among the sorted ``hashes``, else ``otherwise``."""
    out = np.full(len(own), otherwise, np.int64)
    if len(hashes) and len(own):
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        out = np.where(hashes[at] == own, label[at], otherwise)
    return out


def _before(values: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token; an end before a block's first."""
    return np.concatenate([[end], values[:-1]])[: len(values)]


def _bigrams(hashes: np.ndarray, ids: np.ndarray):
    """Training bigrams of a task's blocks among seeds, other words and ends as (band, cells, times), bands by first word."""
    side = len(ids) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, tokens in _rows(batch):
                own = tokens.spread(seed_labels(tokens.own, hashes, ids, side - 2), side - 1)
                cells, times = _merged(cells, times, (_before(own, side - 1) * side + own)[tokens.trains])
        band = cells // side * BANDS // side
        rows = [(k, _pack(np.diff(cells[band == k], prepend=0)), _pack(times[band == k])) for k in range(BANDS)]
        columns = {"band": pa.int64(), "cells": pa.binary(), "times": pa.binary()}
        yield pa.RecordBatch.from_arrays(_table(rows, columns), list(columns))

    return run


def _merged(cells: np.ndarray, times: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sorted distinct ``cells``, and of ``more``, each counting one."""
    new, n = np.unique(more, return_counts=True)
    both, place = np.unique(np.concatenate([cells, new]), return_inverse=True)
    return both, np.bincount(place, np.concatenate([times, n]), len(both)).astype(np.int64)


def _sum_band(table: pa.Table) -> pa.Table:
    parts = [(np.cumsum(_unpack(c)), _unpack(t)) for c, t in zip(table.column("cells").to_pylist(), table.column("times").to_pylist(), strict=True)]
    cells, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    times = np.bincount(place, np.concatenate([p[1] for p in parts]), len(cells)).astype(np.int64)
    return pa.table({"cells": pa.array([cells.tobytes()], pa.binary()), "times": pa.array([times.tobytes()], pa.binary())})


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_clusters(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each word from bigram counts; the last two rows and columns are fixed contexts of their own.

    Words start in classes by frequency rank and move, one after another, to the class that gives the largest
    likelihood of class bigrams, until a sweep moves none.
    """
    n = len(pairs) - 2
    classes = max(1, min(classes, n))
    side = classes + 2
    label = np.concatenate([np.arange(n) % classes, [classes, classes + 1]])
    pairs = pairs.astype(np.float64)
    spread = np.zeros((n + 2, side))
    spread[np.arange(n + 2), label] = 1
    joint = spread.T @ pairs @ spread
    right, left = pairs @ spread, pairs.T @ spread  # per word: followers, predecessors by class
    diagonal = np.arange(classes)
    moved = n
    while moved:
        moved = 0
        for w in range(n):
            r, c, own = right[w].copy(), left[w].copy(), label[w]
            r_all, c_all, self_ = r.sum(), c.sum(), pairs[w, w]
            if not r_all and not c_all:
                continue
            r[own] -= self_
            c[own] -= self_
            joint[own] -= r
            joint[:, own] -= c
            joint[own, own] -= self_
            rows, cols = joint[:classes], joint[:, :classes].T
            gain = (_xlogx(rows + r) - _xlogx(rows)).sum(1) + (_xlogx(cols + c) - _xlogx(cols)).sum(1)
            same = joint[diagonal, diagonal]
            gain += _xlogx(same + r[:classes] + c[:classes] + self_) - _xlogx(same + r[:classes]) - _xlogx(same + c[:classes]) + _xlogx(same)
            out, into = rows.sum(1) + c[:classes], cols.sum(1) + r[:classes]  # the word's own tokens still precede and follow others
            gain -= _xlogx(out + r_all) - _xlogx(out) + _xlogx(into + c_all) - _xlogx(into)
            new = int(gain.argmax()) if gain.max() > gain[own] + 1e-6 else int(own)
            joint[new] += r
            joint[:, new] += c
            joint[new, new] += self_
            if new != own:
                moved += 1
                label[w] = new
                right[:, own] -= pairs[:, w]
                right[:, new] += pairs[:, w]
                left[:, own] -= pairs[w]
                left[:, new] += pairs[w]
    return label[:n]


def insertion_classes(words: int, cells: np.ndarray, times: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """Class of each of ``words`` new words that adds most to the likelihood of class bigrams.

    ``joint``: class bigram counts, its last two rows and columns for open words and ends. ``cells``, sorted: word * 2 * side
    + the class before it, or + side + the class after it; ``times``: how often. Of equal gains the first class wins.
    """
    side = len(joint)
    n = side - 2
    gain = np.zeros((words, n))
    if not words or not len(cells):
        return gain.argmax(1) if words else np.zeros(0, np.int64)
    held = np.concatenate([joint[:, :n], joint[:n].T])  # by context: before a class, after it
    known = _xlogx(held)
    word, code = np.divmod(cells, 2 * side)
    for a in range(0, len(cells), CELLS):
        w, c, t = word[a : a + CELLS], code[a : a + CELLS], times[a : a + CELLS, None]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[first]] += np.add.reduceat(_xlogx(held[c] + t) - known[c], first, axis=0)
    left, right = (code < n), (code >= side) & (code < side + n)
    at_l, at_r = np.flatnonzero(left), np.flatnonzero(right)
    _, i, j = np.intersect1d(word[at_l] * n + code[at_l], word[at_r] * n + code[at_r] - side, assume_unique=True, return_indices=True)
    w, c, x, y = word[at_l[i]], code[at_l[i]], times[at_l[i]], times[at_r[j]]
    same = joint[c, c]  # both sides in the class itself: one cell of the counts grows twice
    gain[w, c] += _xlogx(same + x + y) - _xlogx(same + x) - _xlogx(same + y) + _xlogx(same)
    for at, code_open, n_seeds in ((at_l, side + n, joint[:n, n]), (at_r, n, joint[n, :n])):  # the word leaves the open class
        beside = np.zeros(words)
        beside[word[code == code_open]] = times[code == code_open]
        w, c, x = word[at], code[at] % side, times[at]
        y, same = beside[w], n_seeds[c]
        gain[w, c] += _xlogx(same - x + y) - _xlogx(same - x) - _xlogx(same + y) + _xlogx(same)
    all_l, all_r = np.bincount(word, times * (code < side), words), np.bincount(word, times * (code >= side), words)
    out, into = joint[:n].sum(1), joint[:, :n].sum(0)
    for a in range(0, words, CELLS):
        own = slice(a, a + CELLS)
        gain[own] -= _xlogx(out + all_r[own, None]) - _xlogx(out) + _xlogx(into + all_l[own, None]) - _xlogx(into)
    return gain.argmax(1)


CONTEXTS = "bucket long, block long, hashes binary, counts binary, cells binary, times binary"


def _contexts(buckets: int, hashes: np.ndarray, label: np.ndarray, side: int):
    """Of each block, by hash range: its words, their training counts, and the classes beside those that are no seeds."""
    columns = {"bucket": pa.int64(), "block": pa.int64(), "hashes": pa.binary(), "counts": pa.binary(), "cells": pa.binary(), "times": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, tokens in _rows(batch):
                counts, own = _counts(tokens), seed_labels(tokens.own, hashes, label, side - 2)
                cls = tokens.spread(own, side - 1)
                at = np.flatnonzero(tokens.trains & (cls == side - 2))
                number = tokens.spread(np.arange(len(tokens.own)), 0)[at] * 2 * side
                cells, times = np.unique(np.concatenate([number + _before(cls, side - 1)[at], number + side + cls[np.minimum(at + 1, len(cls) - 1)]]), return_counts=True)
                rows = []
                for k, a, b in _cuts(tokens.own, buckets):
                    i, j = np.searchsorted(cells, [a * 2 * side, b * 2 * side])
                    own_cells = cells[i:j] - a * 2 * side
                    rows.append((k, block, sorted_delta(tokens.own[a:b]), _pack(counts[a:b]), _pack(np.diff(own_cells, prepend=0)), _pack(times[i:j])))
                yield pa.RecordBatch.from_arrays(_table(rows, columns), list(columns))

    return run


ANSWER = "block long, bucket long, counts binary, classes binary, types array<long>, words array<long>"


def _classify(hashes: np.ndarray, label: np.ndarray, joint: np.ndarray):
    """Totals and classes of a hash range: an answer for each block, and one summary row (block null) of types and words by class."""
    side = len(joint)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        own, totals, places = _summed(table)
        parts = []
        for place, cells in zip(places, table.column("cells").to_pylist(), strict=True):
            word, code = np.divmod(np.cumsum(_unpack(cells)), 2 * side)
            parts.append(place[word] * 2 * side + code)
        cells, at = np.unique(np.concatenate(parts), return_inverse=True)
        times = np.bincount(at, np.concatenate([_unpack(x) for x in table.column("times").to_pylist()]), len(cells)).astype(np.int64)
        classes = seed_labels(own, hashes, label, -1)
        new = np.flatnonzero((classes < 0) & (totals > 0))
        word, code = np.divmod(cells, 2 * side)
        classes[new] = insertion_classes(len(new), np.searchsorted(new, word) * 2 * side + code, times, joint)
        classes[totals == 0] = side - 2
        answers = sorted(zip(table.column("block").to_pylist(), [_pack(totals[p]) for p in places], [_pack(classes[p]) for p in places], strict=True))
        types, words = np.bincount(classes[totals > 0], minlength=side), np.bincount(classes, totals, side).astype(np.int64)
        rows = [*((b, bucket, c, k, None, None) for b, c, k in answers), (None, bucket, None, None, types.tolist(), words.tolist())]
        columns = {"block": pa.int64(), "bucket": pa.int64(), "counts": pa.binary(), "classes": pa.binary(), "types": pa.list_(pa.int64()), "words": pa.list_(pa.int64())}
        return pa.table(_table(rows, columns), list(columns))

    return run


@dataclass
class Emissions:
    """What the probability of a word within its class needs; classes, then unseen words, then the end."""

    types: np.ndarray  # by class
    words: np.ndarray  # training tokens by class
    tokens: int
    kinds: int
    ends: int
    discount: float
    unseen: float  # types that training has not seen

    def of(self, counts: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of known words; 0 for unseen words and ends, whose transitions say it all."""
        known = (counts > 0) & (cls < len(self.words) - 2)
        return np.log10(np.where(known, np.maximum(counts - self.discount, 1e-300) / np.maximum(self.words[cls], 1), 1.0))

    def transitions(self, pairs: np.ndarray) -> np.ndarray:
        """log10 P(class, unseen word or end | class, unseen word or end before) from class bigram counts."""
        side = len(pairs)
        live = self.words > 0
        live[side - 1] = True
        if not live[:-1].any():
            live[0] = True  # nothing was learnt: one class without words
        joint = np.where(live, pairs, 0).astype(np.float64)
        share = np.where(live, joint[live].sum(0) + 1, 0.0)
        share /= share.sum()
        kinds = np.maximum((joint > 0).sum(1, keepdims=True), 1)
        step = (joint + kinds * share) / (joint.sum(1, keepdims=True) + kinds)
        left = np.where(self.words > 0, self.discount * self.types / np.maximum(self.words, 1), 1.0)
        step[:, side - 2] = step[:, : side - 2] @ left[: side - 2] / self.unseen
        return np.log10(np.maximum(step, 1e-300))


def emissions(types: np.ndarray, words: np.ndarray, sums: list[int], docs: int) -> Emissions:
    """``types``, ``words``: by class; ``sums``: words, types, types seen once, twice; ``docs``: training documents."""
    tokens, kinds, once, twice = sums
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice > 0 else 0.5
    return Emissions(types, words, tokens + docs, kinds + (docs > 0), docs, discount, max(1.0, once * (once - 1) / (2 * (twice + 1))))


LABELLED = "ids binary, lens binary, known binary, base binary, emit binary, classes binary, cells binary, times binary"


def _label(model: Emissions, buckets: int):
    """Of each block: documents' sums that need no transitions, the classes of all tokens, and training bigrams of classes.

    A word that is seen once counts a second time as the context that stands for unseen words.
    """
    side = len(model.words)
    columns = dict.fromkeys(("ids", "lens", "known", "base", "emit", "classes", "cells", "times"), pa.binary())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {b: (c, k) for b, c, k in zip(*(right.column(x).to_pylist() for x in ("bucket", "counts", "classes")), strict=True)}
        rows = []
        for _, tokens in _rows(left):
            counts, classes = np.zeros(len(tokens.own), np.int64), np.full(len(tokens.own), side - 2)
            for k, a, b in _cuts(tokens.own, buckets):
                counts[a:b], classes[a:b] = map(_unpack, answers[k])
            each, cls = tokens.spread(counts, model.ends), tokens.spread(classes, side - 1)
            base = np.log10((each + 1) / (model.tokens + model.kinds + 1))
            before = _before(cls, side - 1)
            again = tokens.trains & (_before(each, 0) == 1) & (before < side - 2)
            cells, times = np.unique(np.concatenate([(before * side + cls)[tokens.trains], (side - 2) * side + cls[again]]), return_counts=True)
            sums = [tokens.ids, np.diff(tokens.ends, prepend=0), tokens.sums((each > 0).astype(np.int64)), tokens.sums(base), tokens.sums(model.of(each, cls))]
            rows.append((*(x.tobytes() for x in sums), zstandard.compress(cls.astype(np.uint16 if side > 256 else np.uint8).tobytes()), cells.tobytes(), times.tobytes()))
        return pa.table(_table(rows, columns), list(columns))

    return run


def _class_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, times) over a task's blocks."""
    cells, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for c, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            both, place = np.unique(np.concatenate([cells, np.frombuffer(c, np.int64)]), return_inverse=True)
            cells, times = both, np.bincount(place, np.concatenate([times, np.frombuffer(t, np.int64)]), len(both)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(times)], ["cell", "times"])


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(tokens: int, step: np.ndarray):
    side = len(step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lens, known, base, emit, classes in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                ids, lens, known = (np.frombuffer(x, np.int64) for x in (ids, lens, known))
                cls = np.frombuffer(zstandard.decompress(classes), np.uint16 if side > 256 else np.uint8).astype(np.int64)
                value = np.add.reduceat(step[_before(cls, side - 1), cls], np.cumsum(lens) - lens) + np.frombuffer(emit)
                held = [crc_mod(None if i == _NULL_ID else i, HELD_OUT[0]) == HELD_OUT[1] for i in ids.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == _NULL_ID), pa.array(held), pa.array(lens), pa.array(known), pa.array(np.full(len(ids), tokens)), pa.array(np.frombuffer(base)), pa.array(value)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def class_lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seeds: int = SEEDS, classes: int = CLASSES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    n = block_count(docs, text)
    buckets = min(2 * n, 4096 + n // 8)
    blocks = persist(small_batches(docs, doc_id, text).mapInArrow(lean(_blocks), BLOCK))
    trains = blocks.agg(F.sum("trains")).first()[0] or 0
    found = persist(blocks.mapInArrow(lean(_send(buckets)), "bucket long, hashes binary, counts binary").groupBy("bucket").applyInArrow(lean(_total(seeds)), "hashes binary, counts binary, sums array<long>"))
    sums = [int(x or 0) for x in found.agg(*[F.sum(F.col("sums")[i]) for i in range(4)]).first()]
    top = found.select("hashes", "counts").mapInArrow(lean(_best(seeds)), "hash long, times long").orderBy(F.desc("times"), F.expr("hash < 0"), "hash").limit(seeds).collect()
    hashes = np.array([r["hash"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    words = len(hashes) + 2
    cells = blocks.mapInArrow(lean(_bigrams(hashes[order], order)), "band long, cells binary, times binary").groupBy("band").applyInArrow(lean(_sum_band), "cells binary, times binary").collect()
    pairs = np.zeros(words * words, np.int64)
    for r in cells:  # at most words ** 2 cells
        pairs[np.frombuffer(r["cells"], np.int64)] = np.frombuffer(r["times"], np.int64)
    joint, label = class_bigrams(pairs.reshape(words, words), classes)
    known, side = (hashes[order], label[order]), len(joint)
    sent = blocks.mapInArrow(lean(_contexts(buckets, *known, side)), CONTEXTS)
    answers = persist(sent.groupBy("bucket").applyInArrow(lean(_classify(*known, joint)), ANSWER))
    by_class = answers.where(F.col("block").isNull()).agg(*[F.sum(F.col(c)[i]) for c in ("types", "words") for i in range(side)]).first()
    both = np.array([x or 0 for x in by_class], np.int64)
    model = emissions(both[:side], both[side:], sums, trains)
    replies = answers.where(F.col("block").isNotNull()).select("block", "bucket", "counts", "classes")
    labelled = persist(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lean(_label(model, buckets)), LABELLED))
    counted = labelled.select("cells", "times").mapInArrow(lean(_class_cells), "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).collect()
    pairs = np.zeros(side * side, np.int64)
    for r in counted:  # at most side ** 2 cells
        pairs[r["cell"]] = r["times"]
    step = model.transitions(pairs.reshape(side, side))
    return labelled.select("ids", "lens", "known", "base", "emit", "classes").mapInArrow(lean(_score(model.tokens, step)), RESULT)


def class_bigrams(pairs: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(class bigram counts with open words and ends last, class of each seed) from the bigrams of seeds, open words and ends."""
    n = len(pairs) - 2
    label = exchange_clusters(pairs, classes) if n else np.zeros(0, np.int64)
    side = max(1, min(classes, n)) + 2
    spread = np.zeros((n + 2, side))
    spread[np.arange(n + 2), np.concatenate([label, [side - 2, side - 1]])] = 1
    return spread.T @ pairs @ spread, label
