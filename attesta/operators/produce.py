"""A pass in which one bad row is one error row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string


def produce(rows: DataFrame, make: Callable[[dict], Iterable[dict]], schema: str, key: str = "id") -> DataFrame:
    """(key, columns of ``schema``, error): what ``make`` yields for each row, or its error, in place of all it yielded before.

    Runs over Arrow batches; a row that raises costs nothing but itself. A row that yields nothing has no row here.
    """
    kind = _parse_datatype_string(schema)
    names = [f.name for f in kind.fields]
    out = StructType([StructField(key, rows.schema[key].dataType), *kind.fields, StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                try:
                    found += [[row[key], *(x.get(n) for n in names), None] for x in list(make(row))]
                except Exception as e:  # whatever a row's own maker raises is the row's outcome
                    found.append([row[key], *[None] * len(names), f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(found, columns=out.names, dtype=object)

    return rows.mapInPandas(run, out)


def made(produced: DataFrame) -> DataFrame:
    return produced.where("error is null").drop("error")


def failed(produced: DataFrame, key: str = "id") -> DataFrame:
    return produced.where("error is not null").select(key, "error")


def tally(produced: DataFrame) -> DataFrame:
    """One row: rows made and rows that failed."""
    return produced.agg(F.count_if(F.col("error").isNull()).alias("made"), F.count_if(F.col("error").isNotNull()).alias("failed"))
