"""A Spark data source over paged JSON listings: pages read in parallel or as a stream, retries for transient failures.

    register(spark)
    spark.read.format("paged").schema(TAG).option("url", "https://host/tags?page={page}").option("pages", 7).load()

``url`` may hold ``{page}`` (counted from 1); file: URLs work too. With ``query`` (and ``variables``, a JSON object in
which the text "{page}" stands for the page's number) a page is asked for by POST, with ``api_key`` as ApiKey header
if it is given; ``{fields}`` in the query stands for the schema's own fields, nested ones in braces, so the server sends no other. A page
is a JSON list, or an object whose ``rows`` field (option, a dotted path) is one; a reply with ``errors`` raises. Fields that
the schema lacks are not read; missing ones are null. ``deadline`` bounds a page in seconds, tries and slow replies included.

How far a listing goes: ``pages``, if given; else what the first page reports at ``count`` (option, a dotted path; default "count");
else, or with ``until`` = "empty", to the first page without rows: ``stripes`` tasks (default 4) read every fourth page each until
theirs is empty, so a short page in between ends nothing and no total is needed.

As a stream (``spark.readStream.format("paged")``), a batch is one page (or the rows added to the last one), and the offset is a page and
the rows of it that have been read: a query that failed goes on where its checkpoint stands. A short page is left
only when the one after it has rows.

Filters: ``pushed``, a JSON object column -> dotted path in the variables, names the columns whose equality the server can test. Such a
filter is set in the request and not repeated by Spark; a column that the rows lack (named in ``echo``, a JSON list) then holds the
value asked for. Use ``filtered`` for this, which loads the listing anew: Spark keeps what a loaded table was once asked for, and
would apply it to a later query of the same DataFrame that has no filter.

``ask_each`` asks once for each row of a table of keys (URLs, names, boxes), in parallel, and gives the reply's rows or the error.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, IsNotNull, Not, SimpleDataSourceStreamReader
from pyspark.sql.types import ArrayType, StringType, StructField, StructType, _parse_datatype_string

TRANSIENT = frozenset([408, 429, 500, 502, 503, 504])


def fetch(url: str, timeout: float = 30.0, attempts: int = 2, pause: float = 0.2, body: dict | None = None, key: str | None = None, deadline: float = 120.0, headers: dict[str, str] | None = None) -> object:
    """Decoded JSON of a URL, by POST with a ``body``. Only transient failures are tried again; the last one is raised."""
    end = time.monotonic() + deadline
    sent = {"Accept": "application/json"} | ({"Content-Type": "application/json"} if body is not None else {}) | ({"ApiKey": key} if key else {}) | (headers or {})
    data = None if body is None else json.dumps(body).encode()
    for left in range(attempts - 1, -1, -1):
        try:
            asked = urllib.request.Request(url, data, sent if "://" in url and not url.startswith("file:") else {})  # noqa: S310
            with urllib.request.urlopen(asked, timeout=min(timeout, max(0.001, end - time.monotonic()))) as reply:  # noqa: S310
                parts = []
                while part := reply.read(1 << 16):
                    parts.append(part)
                    if time.monotonic() > end:
                        raise TimeoutError(f"no whole reply within {deadline} s")
                return json.loads(b"".join(parts))
        except urllib.error.HTTPError as e:
            if e.code not in TRANSIENT or not left:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if not left or time.monotonic() + pause > end:
                raise
        time.sleep(pause)
    raise AssertionError("unreachable")


def _at(value: object, path: str) -> object:
    """What a dotted path leads to; null where it ends early."""
    for step in path.split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def _numbered(value: object, page: int) -> object:
    if isinstance(value, dict):
        return {k: _numbered(x, page) for k, x in value.items()}
    if isinstance(value, list):
        return [_numbered(x, page) for x in value]
    return page if value == "{page}" else value


def _shape(value: object, kind: object) -> object:
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(_shape(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return [_shape(x, kind.elementType) for x in value]
    return str(value) if kind.typeName() == "string" and not isinstance(value, str) else value


def selection(kind: StructType) -> str:
    """The fields of a schema as a query names them: ``id name studio{ id }``."""
    out = []
    for f in kind.fields:
        inner = f.dataType
        while isinstance(inner, ArrayType):
            inner = inner.elementType
        out.append(f"{f.name}{{ {selection(inner)} }}" if isinstance(inner, StructType) else f.name)
    return " ".join(out)


def _put(variables: dict, path: str, value: object) -> None:
    *steps, last = path.split(".")
    for step in steps:
        variables = variables.setdefault(step, {})
    variables[last] = value


class _Listing:
    """Pages of a listing, by its options."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.asked: dict[str, object] = {}

    def _page(self, number: int) -> object:
        own, body = self.options, None
        if "query" in own:
            variables = _numbered(json.loads(own.get("variables", "{}")), number)
            paths = json.loads(own.get("pushed", "{}"))
            for column, value in self.asked.items():
                _put(variables, paths[column], value)
            sent = StructType([f for f in self.schema.fields if f.name not in json.loads(own.get("echo", "[]"))])
            body = {"query": own["query"].replace("{fields}", selection(sent)), "variables": variables}
        reply = fetch(
            own["url"].replace("{page}", str(number)), float(own.get("timeout", 30)), int(own.get("attempts", 2)), body=body, key=own.get("api_key"), deadline=float(own.get("deadline", 120))
        )
        if isinstance(reply, dict) and reply.get("errors"):
            raise ValueError(f"the server answered with errors: {json.dumps(reply['errors'])[:500]}")
        return reply

    def rows(self, number: int) -> list[tuple]:
        page = self._page(number)
        rows = _at(page, self.options.get("rows", "rows")) or [] if isinstance(page, dict) else page
        return [_shape(self.asked | row, self.schema) for row in rows]


class _Stripe(InputPartition):
    """Pages ``first``, ``first + step``, ... up to ``last``, or to one without rows."""

    def __init__(self, first: int, step: int, last: int | None):
        self.first, self.step, self.last = first, step, last


class _Reader(_Listing, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        paths = json.loads(self.options.get("pushed", "{}"))
        left = []
        for f in filters:
            # Spark writes ``= false`` as the negation of ``= true``
            known, value = (f.child, False) if isinstance(f, Not) and isinstance(f.child, EqualTo) and f.child.value is True else (f, getattr(f, "value", None))
            if isinstance(known, EqualTo) and len(known.attribute) == 1 and known.attribute[0] in paths and known.attribute[0] not in self.asked:
                self.asked[known.attribute[0]] = value
            else:
                left.append(f)
        return [f for f in left if not (isinstance(f, IsNotNull) and f.attribute[-1] in self.asked)]

    def partitions(self) -> list[InputPartition]:
        own = self.options
        total = None
        if "pages" not in own and own.get("until") != "empty":
            total = _at(self._page(1), own.get("count", "count"))
        if "pages" in own or total is not None:
            n = int(own["pages"]) if "pages" in own else -(-int(total) // int(own.get("per_page", 100)))
            return [_Stripe(k, 1, k) for k in range(1, max(1, n) + 1)]
        stripes = int(own.get("stripes", 4))
        return [_Stripe(k, stripes, None) for k in range(1, stripes + 1)]

    def read(self, partition: _Stripe) -> Iterator[tuple]:
        number = partition.first
        while partition.last is None or number <= partition.last:
            rows = self.rows(number)
            yield from rows
            if not rows and partition.last is None:
                return
            number += partition.step


class _Stream(_Listing, SimpleDataSourceStreamReader):
    """Offsets: ``page`` and how many of its rows have been read."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 1, "rows": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page, seen = start["page"], start["rows"]
        rows = self.rows(page)
        if len(rows) <= seen:
            more = self.rows(page + 1) if seen else []
            if not more:
                return iter(()), start
            page, seen, rows = page + 1, 0, more
        return iter(rows[seen:]), {"page": page, "rows": len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for page in range(start["page"], end["page"] + 1):
            rows = self.rows(page)
            yield from rows[start["rows"] if page == start["page"] else 0 : end["rows"] if page == end["page"] else None]

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("state the schema of a paged listing")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Stream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def filtered(spark: SparkSession, schema: str, condition: Column, pushed: dict[str, str], echo: tuple[str, ...] = (), **options: object) -> DataFrame:
    """The rows of a listing that fulfil ``condition``, loaded anew so that its filters hold for this DataFrame alone."""
    register(spark)
    return spark.read.format("paged").schema(schema).options(pushed=json.dumps(pushed), echo=json.dumps(echo), **options).load().where(condition)


def _filled(value: object, row: dict) -> object:
    """A request with "{column}" texts replaced by a key row's values."""
    if isinstance(value, dict):
        return {k: _filled(x, row) for k, x in value.items()}
    if isinstance(value, list):
        return [_filled(x, row) for x in value]
    return row[value[1:-1]] if isinstance(value, str) and value[:1] == "{" and value[1:-1] in row else value


def ask_each(keys: DataFrame, schema: str, url: str, query: str, variables: dict, rows: str, lanes: int = 8, **options: object) -> DataFrame:
    """Rows of the replies to one request for each row of ``keys``: its columns, ``ord`` (place in the reply), those of ``schema``, ``error``.

    "{column}" in ``variables`` stands for the key's value, ``{fields}`` in ``query`` for the schema's fields; ``rows`` is the dotted
    path of the reply's list, or of its one object. A key without rows, or whose request failed (then with its error), has one row
    with null columns. Keys that repeat are asked once; ``lanes`` requests at a time reach the server.
    """
    kind = _parse_datatype_string(schema)
    names = keys.columns
    out = StructType([*keys.schema.fields, *_parse_datatype_string("ord int").fields, *kind.fields, StructField("error", StringType())])
    asked = query.replace("{fields}", selection(kind))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for key in batch.to_dict("records"):
                own = [key[c] for c in names]
                try:
                    reply = fetch(url, float(options.get("timeout", 30)), int(options.get("attempts", 2)), body={"query": asked, "variables": _filled(variables, key)}, key=options.get("api_key"), deadline=float(options.get("deadline", 120)))
                    if not isinstance(reply, dict) or reply.get("errors"):
                        raise ValueError(json.dumps(reply.get("errors") if isinstance(reply, dict) else reply)[:500])
                    got = _at(reply, rows)
                    got = got if isinstance(got, list) else [] if got is None else [got]
                    found += [[*own, i, *_shape(x, kind), None] for i, x in enumerate(got)] or [[*own, None, *[None] * len(kind), None]]
                except (OSError, ValueError) as e:
                    found.append([*own, None, *[None] * len(kind), f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(found, columns=out.names, dtype=object)

    return keys.distinct().repartition(lanes, *[F.col(c) for c in names]).mapInPandas(run, out)
