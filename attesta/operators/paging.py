"""Pages by key: page 10,000 costs what the first costs.

``page_starts`` ranks rows without sorting them into one task (ranges of the order, then one count per range) and keeps the first key of
each page. ``page_at`` turns a page into a range of keys, which reaches the scan as a filter, so only that range is read and sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import parts_for, written_once


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 0 in the order of the columns, which tell rows apart; ranges are sorted each on its own."""
    dealt = rows.repartitionByRange(parts_for(rows), *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    # what a task numbers is kept, as ranges are sampled and another run might cut them elsewhere
    numbered = written_once(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    held = numbered.select(part.alias("__part"), place.alias("__place"), *rows.columns)
    sizes = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row per range
    return held.join(F.broadcast(before), "__part").select(*rows.columns, (F.col("__before") + F.col("__place")).alias("rank"))


def page_starts(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """(page, order columns): the first key of each page of ``size`` rows, pages counted from 1."""
    return ranked(rows.select(*order), order).where(F.col("rank") % size == 0).select((F.col("rank") / size + 1).cast("long").alias("page"), *order)


def page_at(rows: DataFrame, starts: DataFrame, order: list[str], page: int) -> DataFrame:
    """The rows of a page in order; none beyond the last. Two keys reach the driver."""
    ends = {r["page"]: [r[c] for c in order] for r in starts.where(F.col("page").isin(page, page + 1)).collect()}
    if page not in ends:
        return rows.limit(0)
    first = order[0]

    def from_(key: list):
        """Whether a row's key is ``key`` or comes after it."""
        out = F.lit(True)
        for c, v in reversed(list(zip(order, key, strict=True))):
            after = F.col(c).isNotNull() if v is None else F.coalesce(F.col(c) > F.lit(v), F.lit(False))  # nulls come first
            out = after | (F.col(c).eqNullSafe(F.lit(v)) & out)
        return out

    found = rows.where(from_(ends[page]))
    if ends[page][0] is not None:
        found = found.where(F.col(first) >= F.lit(ends[page][0]))  # the form that reaches the scan
    if page + 1 in ends:
        found = found.where(~from_(ends[page + 1]))
        if ends[page + 1][0] is not None:
            found = found.where(F.col(first).isNull() | (F.col(first) <= F.lit(ends[page + 1][0])) if ends[page][0] is None else F.col(first) <= F.lit(ends[page + 1][0]))
    return found.orderBy(*order)
