"""Connected components of a graph given as an edge table.

While the graph is large, every node hooks to its smallest neighbour and the edges are rewritten between hooked
nodes: two joins and one map-side combined aggregate a round. Once at most ``FINISH_EDGES`` edges remain, a checked
bound, one task ends the rest by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import lean, persist

#: Edges that one task may hold (16 MB and a dictionary of their nodes).
FINISH_EDGES = 1_000_000


class Forest(dict):
    """Union-find whose roots are minima."""

    def root(self, x: int) -> int:
        path = []
        while (up := self.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            self[y] = x
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)
        return a != b


def _stars(most: int):
    """(node, root) of each connected part of a task's edges, at most ``most`` edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), 0

        def out() -> pa.RecordBatch:
            nodes = list(forest)
            roots = [forest.root(x) for x in nodes]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.link(a, b)
            held += batch.num_rows
            if held >= most:
                yield out()
                forest, held = Forest(), 0
        if forest:
            yield out()

    return run


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")


def components(edges: DataFrame, a: str = "a", b: str = "b", bound: int = FINISH_EDGES) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component."""
    thinned = edges.select(F.col(a).cast("long"), F.col(b).cast("long")).mapInArrow(lean(_stars(bound)), "node long, root long")
    rest = persist(_ordered(thinned, "node", "root").distinct())
    hops: list[DataFrame] = []
    while rest.count() > bound:
        both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hop = persist(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("root")))
        hops.append(hop)
        moved = rest.join(hop.toDF("u", "pu"), "u").join(hop.toDF("v", "pv"), "v")
        rest = persist(_ordered(moved, "pu", "pv").distinct())
    ended = rest.repartition(1).mapInArrow(lean(_stars(1 << 62)), "node long, root long")
    if not hops:
        return ended
    labels = hops[0]
    for hop in [*hops[1:], ended]:
        labels = labels.join(hop.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return labels


def pairs_within(fingerprints: np.ndarray, others: np.ndarray | None, most_bits: int) -> list[tuple[int, int]]:
    """Index pairs at a Hamming distance of at most ``most_bits``: among ``fingerprints``, or between the two arrays."""
    out: list[tuple[int, int]] = []
    right = fingerprints if others is None else others
    for i, x in enumerate(fingerprints):
        near = np.flatnonzero(np.bitwise_count(right[i + 1 :] ^ x if others is None else right ^ x) <= most_bits)
        out += [(i, j + (i + 1 if others is None else 0)) for j in near.tolist()]
    return out
