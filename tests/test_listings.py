"""Listings without a total, short pages, failures in the middle, streams, pushed filters and keyed requests."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from attesta.sources import paged

SCHEMA = "id string, organized boolean, studio struct<id: string, name: string>"


class Listing:
    """Pages of scenes; ``fail`` lists pages that answer 500 so many times, ``asked`` the bodies seen."""

    def __init__(self):
        self.pages = [[{"id": f"{p}-{k}", "organized": k % 2 == 0, "studio": {"id": "s", "name": "n", "more": 1}, "title": "unread"} for k in range(n)] for p, n in enumerate((5, 2, 5, 5, 1), 1)]
        self.fail, self.asked, self.total = {}, [], None

    def reply(self, body):
        self.asked.append(body)
        v = body["variables"]
        if "url" in v:
            if v["url"] == "bad":
                return {"errors": [{"message": "no such url"}]}
            return {"data": {"scrape": None if v["url"] == "none" else {"id": v["url"], "organized": True, "studio": None}}}
        if "name" in v:
            return {"data": {"search": [{"id": f"{v['name']}{k}", "organized": None, "studio": None} for k in range(int(v["n"]))]}}
        page = v["f"]["page"]
        if self.fail.get(page, 0):
            self.fail[page] -= 1
            return None
        rows = self.pages[page - 1] if page <= len(self.pages) else []
        if "organized" in v.get("s", {}):
            rows = [r for r in rows if r["organized"] == v["s"]["organized"]]
        if "tags" in v.get("s", {}):
            rows = [r for r in rows if v["s"]["tags"]["value"] in r["id"]]
        return {"data": {"find": {"scenes": rows} | ({} if self.total is None else {"count": self.total})}}


@pytest.fixture
def server():
    own = Listing()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            found = own.reply(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            if found is None:
                return self.send_error(500)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(found).encode())

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    own.url = f"http://127.0.0.1:{http.server_port}/"
    yield own
    http.shutdown()


def options(server, **more):
    query = "query($f: F, $s: S) { find(filter: $f, scene_filter: $s) { count scenes{ {fields} } } }"
    return {"url": server.url, "query": query, "variables": json.dumps({"f": {"page": "{page}", "per_page": 5}}), "rows": "data.find.scenes", "count": "data.find.count", "per_page": 5, **more}


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("stripes", [1, 3, 8])
def test_a_listing_without_a_total_is_read_to_its_end(spark, server, stripes):
    paged.register(spark)
    found = spark.read.format("paged").schema(SCHEMA).options(**options(server, stripes=stripes)).load()
    assert ids(found) == sorted(r["id"] for p in server.pages for r in p)  # the short second page ends nothing
    assert all("{ id organized studio{ id name } }" in b["query"] for b in server.asked)


def test_a_wrong_total_is_not_needed(spark, server):
    paged.register(spark)
    server.total = 7
    read = spark.read.format("paged").schema("id string")
    assert len(ids(read.options(**options(server)).load())) == 7  # two pages, by the reported total
    assert len(ids(read.options(**options(server, until="empty")).load())) == 18


def test_filters_reach_the_server(spark, server):
    pushed = {"organized": "s.organized", "tag_id": "s.tags.value"}

    def scenes(condition):
        return paged.filtered(spark, SCHEMA + ", tag_id string", condition, pushed, ("tag_id",), **options(server, until="empty"))

    found = scenes((F.col("organized") == F.lit(False)) & (F.col("tag_id") == "3-") & F.col("id").endswith("1"))
    assert [tuple(r) for r in found.select("id", "tag_id").collect()] == [("3-1", "3-")]
    assert server.asked and all(b["variables"]["s"] == {"organized": False, "tags": {"value": "3-"}} and "tag_id" not in b["query"] for b in server.asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filtered = plan.split("Filter", 1)[1].split("BatchScan")[0] if "Filter" in plan else ""
    assert "tag_id" not in filtered and "EndsWith" in plan  # what the server tests Spark does not test again
    assert ids(scenes(F.expr("organized = false or id = '1-0'"))) == sorted([r["id"] for p in server.pages for r in p if not r["organized"]] + ["1-0"])


def run_stream(spark, server, folder, **more):
    stream = spark.readStream.format("paged").schema("id string").options(**options(server, attempts=1, **more)).load()
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return ids(spark.read.schema("id string").parquet(f"{folder}/out"))


def test_a_stream_goes_on_after_a_failure_and_sees_what_is_added(spark, server, tmp_path):
    paged.register(spark)
    server.fail = {3: 1}
    with pytest.raises(Exception, match="500|STREAM"):
        run_stream(spark, server, tmp_path)
    asked = len([b for b in server.asked if b["variables"]["f"]["page"] == 1])
    assert run_stream(spark, server, tmp_path) == sorted(r["id"] for p in server.pages for r in p)
    assert len([b for b in server.asked if b["variables"]["f"]["page"] == 1]) <= asked + 1  # it does not begin again
    server.pages[-1] += [{"id": "5-1", "organized": True, "studio": None}]
    server.pages.append([{"id": "6-0", "organized": True, "studio": None}])
    assert run_stream(spark, server, tmp_path) == sorted(r["id"] for p in server.pages for r in p)


def test_requests_by_key(spark, server):
    urls = spark.createDataFrame([("http://a",), ("none",), ("bad",), ("http://a",)], "url string")
    got = paged.ask_each(urls, SCHEMA, server.url, "query($url: String!){ scrape(url: $url){ {fields} } }", {"url": "{url}"}, "data.scrape", attempts=1)
    rows = {r["url"]: (r["ord"], r["id"], r["error"]) for r in got.collect()}
    assert rows["http://a"] == (0, "http://a", None) and rows["none"] == (None, None, None) and "no such url" in rows["bad"][2]
    assert len(server.asked) == 3
    names = spark.createDataFrame([("ivy", 2, "box1"), ("moss", 0, "box2")], "name string, n int, box string")
    got = paged.ask_each(names, "id string", server.url, "query { search { {fields} } }", {"name": "{name}", "n": "{n}", "fixed": [1, {"x": "{none}"}]}, "data.search")
    assert sorted(((r["box"], r["ord"], r["id"]) for r in got.collect()), key=str) == [("box1", 0, "ivy0"), ("box1", 1, "ivy1"), ("box2", None, None)]
    assert server.asked[-1]["variables"]["fixed"] == [1, {"x": "{none}"}]
