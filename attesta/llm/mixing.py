"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. A flow network sends each pattern's words,
epoch by epoch, to the quotas of its sources; epoch r costs r - 1, so repetition grows only where a quota
cannot be met otherwise. The network has as many nodes as there are patterns and sources, whatever the
number of documents. Documents are then laid out per pattern in a seeded order (a distributed prefix sum
over small hash buckets, so a hot source is never one task), and each epoch's copy of a document is taken
if its midpoint lies inside the words that the flow sends.

Defined results: null text has size 0; a null source is a source of its own, ordered last; documents
without any source are never taken; equal rows are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import fresh, grouped, persist, running_total, word_count

#: Times a document may be taken; documents of one bucket of the prefix sum; seed of the order.
MOST_EPOCHS, BUCKET_DOCS, SEED = 3, 500, 20240607
#: Patterns whose plan is broadcast; of more, it is joined by a shuffle.
MOST_BROADCAST = 50_000


def cycled_weights(names: list[str | None]) -> dict[str | None, float]:
    """1, 2, 3, repeating, over sources in code point order, null last."""
    return {name: float(1 + i % 3) for i, name in enumerate(sorted(names, key=lambda x: (x is None, x or "")))}


def capped_targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: int = MOST_EPOCHS) -> dict[str | None, float]:
    """Shares of the total size by weight; a target stops at ``most`` times its source's size and the excess is reshared."""
    total, fixed, open_ = float(sum(sizes.values())), {}, set(sizes)
    while open_:
        left, weight = total - sum(fixed.values()), sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in above}
        open_ -= above
    return fixed


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, most: int = MOST_EPOCHS) -> dict[tuple, dict]:
    """{pattern: {source: words}} of a maximal flow of least repetition cost.

    Successive shortest paths with potentials. Words are integers; ``quotas`` gives each source's. A source that
    one pattern alone feeds, which feeds no other, is settled without them, so that many plain sources cost little.
    """
    feeds: dict = {}
    for p in patterns:
        for s in p:
            feeds[s] = feeds.get(s, 0) + 1
    alone = {p: {p[0]: min(most * patterns[p], quotas.get(p[0], 0))} for p in patterns if len(p) == 1 and feeds[p[0]] == 1}
    pats, srcs = [p for p in patterns if p not in alone], [s for s in quotas if (s,) not in alone]
    node = {("p", p): 1 + i for i, p in enumerate(pats)} | {("s", s): 1 + len(pats) + i for i, s in enumerate(srcs)}
    sink = 1 + len(node)
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to, cap, cost = [], [], []

    def edge(a: int, b: int, c: int, w: int) -> int:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)
        return len(to) - 2

    routes = {}
    for p in pats:
        for r in range(most):
            edge(0, node["p", p], patterns[p], r)
        for s in p:
            if s in quotas:
                routes[p, s] = edge(node["p", p], node["s", s], most * patterns[p], 0)
    for s in srcs:
        edge(node["s", s], sink, quotas[s], 0)
    potential = [0] * (sink + 1)
    while True:
        dist, via, heap = {0: 0}, {}, [(0, 0)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist.get(x, d):
                continue
            for e in graph[x]:
                if cap[e] and (nd := d + cost[e] + potential[x] - potential[to[e]]) < dist.get(to[e], 1 << 62):
                    dist[to[e]], via[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if sink not in dist:
            break
        for x in range(sink + 1):
            potential[x] += min(dist.get(x, dist[sink]), dist[sink])
        path, x = [], sink
        while x:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    flow: dict[tuple, dict] = alone | {p: {} for p in pats}
    for (p, s), e in routes.items():
        flow[p][s] = cap[e ^ 1]
    return flow


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    sources: Column | None = None,
    weights: Callable[[list[str | None]], dict[str | None, float]] = cycled_weights,
    most: int = MOST_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies.

    ``sources``: array column of the sources a document belongs to (default: the one in ``source``). source_size
    and target are sums over a document's sources. Sources and patterns are aggregated before they reach the driver.
    """
    member = F.array(F.col("source")) if sources is None else sources
    name = F.transform(F.array_distinct(member), lambda x: F.coalesce(F.concat(F.lit("s"), x.cast("string")), F.lit("~")))
    pattern = F.array_join(F.transform(F.sort_array(name), lambda x: F.hex(F.encode(x, "UTF-8"))), ",")
    rows = persist(grouped(docs).select(F.col(doc_id).alias("doc_id"), F.coalesce(pattern, F.lit("")).alias("pattern"), word_count(F.col(text)).alias("size")))
    found = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).collect()

    def names(joined: str) -> tuple:
        raw = [bytes.fromhex(x).decode() for x in joined.split(",") if x]
        return tuple(None if x == "~" else x[1:] for x in raw)

    patterns = {names(r["pattern"]): r["words"] for r in found}
    sizes: dict[str | None, int] = {}
    for p, words in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    targets = capped_targets(sizes, weights(list(sizes)), most)
    flow = min_cost_flow(patterns, {s: round(t) for s, t in targets.items()}, most)
    plan = []
    for r in found:
        p = names(r["pattern"])
        plan.append((r["pattern"], r["words"], sum(flow[p].values()), max(1, r["n"] // BUCKET_DOCS), sum(sizes[s] for s in p), float(sum(targets[s] for s in p))))
    dims = docs.sparkSession.createDataFrame(plan, "pattern string, words long, quota long, buckets long, source_size long, target double")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = (
        rows.join(F.broadcast(dims) if len(plan) <= MOST_BROADCAST else dims, "pattern")
        .withColumn("order", order)
        .withColumn("bucket", F.shiftright(F.shiftrightunsigned(F.col("order"), 33) * F.col("buckets"), 31))
    )
    before = running_total(placed.groupBy("pattern", "bucket").agg(F.sum("size").alias("held")), "bucket", "held", "before", ("pattern",)).drop("held")
    within = Window.partitionBy("pattern", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(before, ["pattern", "bucket"])
    middle = 2 * (F.col("before") + F.col("ahead")) + F.col("size")
    copies = sum((F.when(2 * r * F.col("words") + middle < 2 * F.col("quota"), 1).otherwise(0) for r in range(most)), F.lit(0))
    return at.withColumn("copies", copies.cast("int")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies"
    )


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Copies are found by doc_id; rows that repeat a doc_id share their number of copies evenly, rounded down, the
    rest going to the first of them by text. Columns may have any names.
    """
    own, count, rows, times, copy = fresh(docs, "__id", "__copies", "__rows", "__times", "__copy")
    copies = mix_sources(docs, doc_id, text, **options).groupBy(F.col("doc_id").alias(own)).agg(F.sum("copies").alias(count), F.count(F.lit(1)).alias(rows))
    copies = persist(grouped(copies, docs))
    taken = docs.join(copies.where(F.col(count) > 0), docs[doc_id].eqNullSafe(F.col(own)), "inner")
    once = taken.where(F.col(rows) == 1).withColumn(times, F.col(count))
    place = F.row_number().over(Window.partitionBy(own).orderBy(text))
    more = taken.where(F.col(rows) > 1).withColumn(times, F.floor(F.col(count) / F.col(rows)) + F.when(place <= F.col(count) % F.col(rows), 1).otherwise(0))
    every = once.unionByName(more) if copies.where(F.col(rows) > 1).limit(1).count() else once
    spread = every.where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return grouped(spread.select(*[spread[c] for c in docs.columns]), docs)
