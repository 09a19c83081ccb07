"""Candidate pairs with a proven bound: containment, word recall, matching-blocks ratio, and joins on skewed keys.

Each function returns all pairs that fulfil its predicate; what it skips can't.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.similarity import ratios, rounded
from attesta.session import spread

#: Keys that a sketch proposes as frequent, and counters it keeps.
HOT, COUNTERS = 128, 8192
CLASSES = 64


def grams(text: Column, q: int) -> Column:
    """Distinct substrings of ``q`` characters; none of a shorter text."""
    return F.when(F.length(text) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (q - 1)), lambda i: F.substring(text, i, F.lit(q)))))


def contained_in(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(a, b) of ``outer`` (a) and ``inner`` (b), distinct non-empty keys, where a contains b.

    b can only be in an a that holds b's rarest gram, so of b that one gram alone is joined: of three characters, or all of b
    where it is shorter. A b with a gram that no a holds goes at once.
    """
    held = outer.where("a <> ''").select("a", F.explode(F.concat(*[F.coalesce(grams(F.col("a"), q), F.array().cast("array<string>")) for q in (1, 2, 3)])).alias("g"))
    counted = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    asked = inner.where("b <> ''").select("b", F.explode(F.when(F.length("b") >= 3, grams(F.col("b"), 3)).otherwise(F.array("b"))).alias("g"))
    rarest = asked.join(counted, "g", "left").groupBy("b").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    return held.join(rarest, "g").where(F.contains("a", F.col("b"))).select("a", "b")


def containment_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of two tables of distinct keys where one contains the other."""
    turned = contained_in(right.select(F.col("b").alias("a")), left.select(F.col("a").alias("b"))).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return contained_in(left.select("a"), right.select("b")).union(turned).distinct()


def recall_pairs(items: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(item_id, doc_id, recall): all pairs in which a document has at least a share ``least`` of an item's words, repeats counted.

    ``items`` and ``docs``: (id, words); rows of one id count as one. Documents' words are read once, cut to the items' vocabulary and
    dealt by document over partitions that follow the input, where each meets the items that have it and is counted: no word, however
    frequent, gathers its documents in one task, and neither pairs nor word lists move.
    """
    if not 0 < least <= 1:
        raise ValueError("the least recall lies above 0 and not above 1")
    own = items.where("item_id is not null").select("item_id", F.explode("words").alias("w")).groupBy("item_id", "w").agg(F.count(F.lit(1)).alias("m"))
    own = own.withColumn("size", F.sum("m").over(Window.partitionBy("item_id")))
    has = docs.select("doc_id", F.explode(F.array_distinct("words")).alias("w")).join(own.select("w").distinct(), "w", "left_semi")
    held = spread(has.select("doc_id", "w"), "doc_id", like=docs).distinct()
    hits = held.join(own, "w").groupBy("doc_id", "item_id", "size").agg(F.sum("m").alias("hits"))
    slack = F.col("size") - F.ceil(least * F.col("size") - F.lit(1e-9))
    return hits.where(F.col("size") - F.col("hits") <= slack).select("item_id", "doc_id", (F.col("hits") / F.col("size")).alias("recall"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def character_bag(texts: pd.Series) -> pd.Series:
    """How many characters of each of CLASSES classes a text has."""
    return texts.map(lambda x: np.bincount(np.frombuffer((x or "").encode("utf-32-le"), np.uint32) % CLASSES, minlength=CLASSES).tolist())


def common_length(a: str, masks: dict[str, int], b: str) -> int:
    """Length of the longest common subsequence of a and b, a bit for each place of a; ``masks``: the places of each character of a."""
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def ratio_at_least(least: float):
    """Arrow function of (a, b): their matching-blocks ratio, or null where it is surely less than ``least``.

    Matched blocks are a common subsequence, so its greatest length, found by bits in a word for some sixty places, bounds them.
    """

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        last, masks, ask = None, {}, []
        for x, y in zip(a, b, strict=True):
            if x != last:
                last, masks = x, {}
                for k, c in enumerate(x):
                    masks[c] = masks.get(c, 0) | 1 << k
            ask.append(2 * common_length(x, masks, y) >= least * (len(x) + len(y)) - 1e-6)
        keep = pd.Series(ask, index=a.index, dtype=bool)
        out = pd.Series(np.nan, index=a.index, dtype="float64")
        if keep.any():
            out[keep] = ratios(a[keep], b[keep], {}).to_numpy()
        return out

    return run


def ratio_pairs(items: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(item_id, doc_id, ratio): all pairs of texts whose matching-blocks ratio is at least ``least``.

    ``items``, the query set, and ``docs``: (id, text). The matched characters are no more than the shorter text has, nor than the
    two have in common by class, nor than their longest common subsequence; only pairs that pass these bounds are compared. Pairs
    meet by ranges of length within which the first bound can hold; texts join them only after the first two.
    """
    if not 0 < least < 1:
        raise ValueError("the least ratio lies between 0 and 1")
    reach = log(2 / least - 1)  # of the longer to the shorter length, at most
    room = F.floor(F.log(F.col("size")) / reach).cast("int")
    bagged = lambda t, key: t.select(key, F.length("text").alias("size"), character_bag(F.col("text")).alias("bag")).withColumn("room", F.when(F.col("size") > 0, room).otherwise(-10))
    left = bagged(items, "item_id").select("item_id", F.col("size").alias("a"), F.col("bag").alias("bag_a"), F.explode(F.when(F.col("size") > 0, F.sequence(F.col("room") - 1, F.col("room") + 1)).otherwise(F.array("room"))).alias("room"))
    right = bagged(docs, "doc_id").select("doc_id", F.col("size").alias("b"), F.col("bag").alias("bag_b"), "room")
    total = F.col("a") + F.col("b")
    bound = least * total / 2 - 1e-6
    common = F.aggregate(F.zip_with("bag_a", "bag_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    pairs = left.join(right, "room").where((F.least("a", "b") >= bound) & (common >= bound)).select("item_id", "doc_id")
    texts = pairs.join(items.select("item_id", F.col("text").alias("i")), "item_id").join(docs.select("doc_id", F.col("text").alias("d")), "doc_id")
    # the comparison takes nearly all of the time; an item's pairs lie together in each task
    dealt = texts.repartition(F.col("item_id"), F.col("doc_id")).sortWithinPartitions("item_id")
    return dealt.select("item_id", "doc_id", ratio_at_least(least)(F.col("i"), F.col("d")).alias("exact")).where(F.col("exact") >= least).select("item_id", "doc_id", rounded(F.col("exact")).alias("ratio"))


def dealt_join(left: DataFrame, right: DataFrame, key: str, rows: int = 50_000) -> DataFrame:
    """``left`` joined to ``right`` on ``key``, where few keys may have most of the left rows.

    A sketch proposes the frequent keys; each is cut into parts of about ``rows`` left rows, dealt by the row's hash, and its right rows
    are repeated for each part. The proposal is at most HOT rows, which are broadcast; other keys are joined plainly.
    """
    top = left.agg(F.expr(f"approx_top_k({key}, {HOT}, {COUNTERS})").alias("top")).select(F.inline("top"))
    hot = F.broadcast(top.select(F.col("item").alias(key), F.ceil(F.col("count") / rows).cast("int").alias("__parts")).where("__parts > 1"))
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("__parts")).cast("int"))
    cut = left.join(hot, key, "left").withColumn("__part", part).drop("__parts")
    repeated = right.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return cut.join(repeated, [key, "__part"]).drop("__part")
