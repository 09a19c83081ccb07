"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of lexicon words and of lexicon word beginnings, their strongest and summed weights,
lexicon words near second-person pronouns, capitals, punctuation, and obfuscation (letters mixed with digits or
signs, spelled-out words, lexicon words that appear only after undoing it). The lexicon is learnt from labelled
training texts: log-odds of a word's (and of 4 to 6 leading letters') rate in toxic against other texts. Features
of training texts use a lexicon learnt from the other folds, so trees do not trust it too much, and calibration uses
held-out margins of the same folds.

Learning reads at most ``TRAIN_DOCS`` labelled texts, those with the smallest hash of doc_id, one row each, and takes every term
that stands four times at least in toxic ones; every document is scored, over its whole text.

Defined results: a null or empty text has all features zero and the score of such a text; labels that are null are
left out, of labels that repeat a doc_id the largest counts, of texts that repeat one the least; without labels of both kinds the score is the share of
toxic labels (0 without labels); a null doc_id counts as the empty text in the held-out rule; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.boosting import BoostedTrees, Isotonic
from attesta.llm.common import bounded, crc_mod, encode, grouped, lean, persist, slices, small_batches, texts_of

#: Labelled texts that learning reads; folds; rows of the held-out rule; alarm threshold.
TRAIN_DOCS, FOLDS, HELD_OUT, ALARM = 20_000, 4, (4, 2), 0.3
#: Distinct tokens that a task counts at once.
HELD = 300_000
#: Second-person pronouns (English, French, German, Spanish).
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine deinen deiner ihr euch euer eure ti tuyo usted ustedes vosotros vuestro".split()
)
#: Signs that stand for letters, edge punctuation, letters run together.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "+": "t", "|": "l"}
_EDGES = string.punctuation.replace("@", "").replace("$", "") + "…«»“”‘’¿¡–—·"
_LONG_RUN = "|".join(c * 3 for c in string.ascii_lowercase)
_REPEAT = re.compile(r"(.)\1\1+")
NEAR, STEMS = 4, (4, 5, 6)
#: Weights beyond which a lexicon word, or a word beginning, is a hit.
WORD_HIT, STEM_HIT = 2.0, 1.2


def plain_words(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lower-case words without edge punctuation and disguise, whether signs stood among the letters) of tokens."""
    base = pc.replace_substring_regex(pc.utf8_lower(pc.utf8_trim(tokens, _EDGES)), r"[@$]{2,}$", "")
    odd = np.flatnonzero(~np.asarray(pc.utf8_is_alpha(base)) & (np.asarray(pc.utf8_length(base)) > 0))
    mixed = np.zeros(len(tokens), bool)
    if len(odd):
        some = base.take(pa.array(odd))
        undone = some
        for sign, letter in SIGNS.items():
            undone = pc.replace_substring(undone, sign, letter)
        disguised = np.asarray(pc.utf8_is_alpha(undone)) & np.asarray(pc.match_substring_regex(some, r"\pL"))
        mixed[odd] = disguised
        letters = pc.replace_substring_regex(some, r"\PL+", "")
        base = pc.replace_with_mask(base, _mask(len(base), odd), pc.if_else(pa.array(disguised), undone, letters))
    runs = np.flatnonzero(np.asarray(pc.match_substring_regex(base, _LONG_RUN)))
    if len(runs):
        short = [_REPEAT.sub(r"\1\1", x) for x in base.take(pa.array(runs)).to_pylist()]
        base = pc.replace_with_mask(base, _mask(len(base), runs), pa.array(short, base.type))
    return base, mixed


def _mask(n: int, at: np.ndarray) -> pa.Array:
    out = np.zeros(n, bool)
    out[at] = True
    return pa.array(out)


class _Weights:
    """Weights of a set of keys, looked up for whole arrays; 0 for other keys."""

    def __init__(self, weights: dict[str, float]):
        self.keys = pa.array(list(weights), pa.large_string())
        self.values = np.array([*weights.values(), 0.0])

    def of(self, words: pa.Array) -> np.ndarray:
        return self.values[np.asarray(pc.fill_null(pc.index_in(words, value_set=self.keys), len(self.keys)))]


class Lexicon:
    """Weights of words and of word beginnings (keys of ``weights`` that end with a star)."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.words = _Weights({k: w for k, w in weights.items() if k[-1:] != "*"})
        self.stems = {n: _Weights({k[:-1]: w for k, w in weights.items() if k[-1:] == "*" and len(k) == n + 1}) for n in STEMS}
        self.you = _Weights(dict.fromkeys(SECOND_PERSON, 1.0))


def features(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """A row of dense features for each text."""
    parts = [_features(texts[own], lexicon) for own in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH))


def _features(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    valid = [x.decode("utf-8", "replace") for x in texts]
    lists = pc.utf8_split_whitespace(pa.array(valid, pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    token, place = coded.dictionary, coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    word, mixed = plain_words(token)
    length, size = np.asarray(pc.utf8_length(token)), np.asarray(pc.utf8_length(word))
    letters = np.asarray(pc.utf8_length(pc.replace_substring_regex(token, r"\PL+", "")))
    upper = np.asarray(pc.count_substring_regex(token, r"\p{Lu}"))
    found = lexicon.words.of(word)
    stem = np.max([np.where(size > n, w.of(pc.utf8_slice_codeunits(word, 0, n)), 0.0) for n, w in lexicon.stems.items()], axis=0)
    hit, stem_hit, you, single = found > WORD_HIT, stem > STEM_HIT, lexicon.you.of(word) > 0, (length == 1) & (letters == 1)

    def total(column: np.ndarray) -> np.ndarray:
        return np.bincount(doc, column[place], len(texts))

    n = total(length > 0)
    chars, n_letters, hits, stem_hits = np.maximum(total(length), 1), np.maximum(total(letters), 1), total(hit), total(stem_hit)
    peaks = np.zeros((2, len(texts)))
    for k, values in enumerate((found, stem)):
        some = np.flatnonzero(values[place] > 0)
        np.maximum.at(peaks[k], doc[some], values[place[some]])
    spelled = _spelled(np.flatnonzero(single[place]), doc, place, token, lexicon, len(texts))
    near = _near(np.flatnonzero((hit | stem_hit)[place]), np.flatnonzero(you[place]), doc, len(texts))
    hits = hits + spelled
    m = np.maximum(n, 1)
    return np.stack(
        [
            np.log1p(n), hits / m, np.minimum(hits, 30), total(found) / m, stem_hits / m, np.minimum(stem_hits, 30), total(stem) / m, peaks[0], peaks[1],
            near / m, near / np.maximum(hits + stem_hits, 1), total(upper) / n_letters, total((letters >= 2) & (upper == letters)) / m,
            total(np.asarray(pc.count_substring_regex(token, r"\pP|\pS"))) / chars, total(np.asarray(pc.count_substring(token, "!"))) / m,
            total(np.asarray(pc.count_substring(token, "?"))) / m, total(mixed) / m, (total(mixed & (hit | stem_hit)) + spelled) / m,
            total(np.asarray(pc.match_substring_regex(pc.utf8_lower(token), _LONG_RUN))) / m, total(you) / m,
        ],
        axis=1,
    )


WIDTH = 20


def _near(hits: np.ndarray, you: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Hits with a second-person pronoun at most NEAR words away, per document."""
    if not len(hits) or not len(you):
        return np.zeros(n)
    right = np.searchsorted(you, hits)
    close = np.zeros(len(hits), bool)
    for other in (you[np.minimum(right, len(you) - 1)], you[np.maximum(right - 1, 0)]):
        close |= (np.abs(other - hits) <= NEAR) & (doc[other] == doc[hits])
    return np.bincount(doc[hits[close]], minlength=n)


def _spelled(singles: np.ndarray, doc: np.ndarray, place: np.ndarray, token: pa.Array, lexicon: Lexicon, n: int) -> np.ndarray:
    """Lexicon words spelled out as single letters, per document."""
    out = np.zeros(n)
    if len(singles) < 3:
        return out
    breaks = np.flatnonzero((np.diff(singles) > 1) | (np.diff(doc[singles]) != 0)) + 1
    for run in np.split(singles, breaks):
        if len(run) >= 3:
            word = "".join(token.take(pa.array(place[run])).to_pylist()).lower()
            out[doc[run[0]]] += lexicon.weights.get(word, 0.0) > WORD_HIT
    return out


def terms_of(token_counts: Counter) -> Counter:
    """Lexicon keys of tokens with their counts: each plain word, and its first letters marked with a star."""
    out: Counter = Counter()
    words, _ = plain_words(pa.array(list(token_counts), pa.large_string()))
    for word, times in zip(words.to_pylist(), token_counts.values(), strict=True):
        out[word] += times
        for n in STEMS:
            if len(word) > n:
                out[word[:n] + "*"] += times
    out.pop("", None)
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, fold, toxic, times) over a task's labelled texts, in parts of about HELD tokens; a part holds a term once a cell."""
    tokens: dict[tuple[int, int], Counter] = defaultdict(Counter)
    sizes: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        while tokens:
            (fold, toxic), counts = tokens.popitem()
            terms = terms_of(counts)
            terms[""] = sizes.pop((fold, toxic))
            n = len(terms)
            columns = [pa.array(list(terms), pa.string()), pa.array(np.full(n, fold, np.int32)), pa.array(np.full(n, toxic, np.int32)), pa.array(list(terms.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "fold", "toxic", "times"])

    for batch in batches:
        for doc_id, text, toxic in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            cell = _fold(doc_id), toxic
            tokens[cell].update(text.decode("utf-8", "replace").split())
            sizes[cell] += text.count(b" ") + 1
            if sum(map(len, tokens.values())) >= HELD:
                yield from flush()
    yield from flush()


def _fold(doc_id: int | None) -> int:
    return crc_mod(doc_id, 1_000_003) % FOLDS


def learn_weights(counts: list[tuple[str, int, int, int]], without: int | None) -> dict[str, float]:
    """Positive log-odds of terms, from all folds but ``without``."""
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for term, fold, label, times in counts:
        if fold != without:
            (toxic if label else clean)[term] += times
    all_toxic, all_clean = max(toxic.pop("", 0), 1), max(clean.pop("", 0), 1)
    out = {}
    for term, times in toxic.items():
        if times >= 4:
            weight = log((times + 0.5) / all_toxic) - log((clean[term] + 0.5 + times * 0.02) / all_clean)
            if weight > 0.7:
                out[term] = min(weight, 6.0)
    return out


class Model:
    """Lexicon, trees and calibration; ``base``: the score where nothing could be learnt."""

    def __init__(self, weights: dict[str, float], trees: BoostedTrees | None, curve: Isotonic | None, base: float):
        self.lexicon, self.trees, self.curve, self.base = Lexicon(weights), trees, curve, base

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.base)
        return self.curve(self.trees.margin(features(texts, self.lexicon)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_DOCS) -> Model:
    """Learns from labelled rows that are not held out."""
    mod, rest = HELD_OUT
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    known = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(F.pmod(crc, F.lit(mod)) != rest)
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = small_batches(docs, doc_id, text).where(F.col("doc_id").isNotNull())
    # at most ``most`` rows are broadcast; of rows that repeat a doc_id the least text counts
    sample = persist(texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic")))
    counted = sample.mapInArrow(lean(_count_terms), "term string, fold int, toxic int, times long").groupBy("term", "fold", "toxic").agg(F.sum("times").alias("times"))
    ranked = counted.groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("times")).otherwise(0)).alias("t"),
        F.sum("times").alias("n"),
        F.collect_list(F.struct("fold", "toxic", "times")).alias("cells"),  # at most FOLDS x 2
    )
    chosen = ranked.where("t >= 4 or term = ''").select("term", "cells").orderBy("term")  # bounded by the labelled texts, of which there are at most ``most``
    counts = [(r["term"], c["fold"], c["toxic"], c["times"]) for r in chosen.collect() for c in r["cells"]]
    lexicons = [Lexicon(learn_weights(counts, fold)) for fold in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = [_fold(x) for x in batch.column(0).to_pylist()]
            texts, rows = texts_of(batch.column(1)), np.zeros((len(folds), WIDTH))
            for f in set(folds):
                own = [i for i, x in enumerate(folds) if x == f]
                rows[own] = features([texts[i] for i in own], lexicons[f])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folds, pa.int32()), batch.column(2), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["doc_id", "fold", "toxic", "row"])

    found = sorted(tuple(r) for r in sample.mapInArrow(lean(measure), "doc_id long, fold int, toxic int, row array<double>").collect())
    y = np.array([r[2] for r in found], np.float64)
    if len(set(y.tolist())) < 2:
        return Model({}, None, None, float(y.mean()) if len(y) else 0.0)
    x, fold = np.array([r[3] for r in found]), np.array([r[1] for r in found])
    margins = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        margins[own] = BoostedTrees().fit(x[~own], y[~own]).margin(x[own])
    return Model(learn_weights(counts, None), BoostedTrees().fit(x, y), Isotonic().fit(margins, y), float(y.mean()))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    sent, (mod, rest) = docs.sparkSession.sparkContext.broadcast(model), HELD_OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sent.value.scores(texts_of(batch.column(1)))
            held = [crc_mod(x, mod) == rest for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(got), pa.array((got >= ALARM).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return small_batches(docs, doc_id, text).mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the alarm, with all their columns and no shuffle."""
    bounded(docs.sparkSession)
    at, sent = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(texts_of(batch.column(at))) < ALARM))

    return grouped(docs).mapInArrow(lean(run), docs.schema)


def score_text(text: str | None, model: Model) -> float:
    return float(model.scores([encode(text)])[0])
