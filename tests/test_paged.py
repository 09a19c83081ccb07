"""The paged source against a local server: POST with variables and key, failures, errors, slow replies."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from attesta.sources import paged

ROWS = [{"id": str(k), "name": f"n{k}", "extra": 1} for k in range(25)]


class Handler(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        page, size = body["variables"]["filter"]["page"], body["variables"]["filter"]["per_page"]
        first = (self.path, page) not in self.seen
        self.seen.append((self.path, page))
        if self.headers["ApiKey"] != "secret":
            return self.send_error(401)
        if self.path == "/flaky" and first:
            return self.send_error(503)
        self.send_response(200)
        self.end_headers()
        if self.path == "/slow":
            for _ in range(20):
                self.wfile.write(b" " * 70000)
                time.sleep(0.1)
        found = {"errors": [{"message": "no such field"}]} if self.path == "/wrong" else {"data": {"find": {"count": 25, "tags": ROWS[(page - 1) * size : page * size]}}}
        self.wfile.write(json.dumps(found).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def listing(spark, url, **options):
    paged.register(spark)
    asked = {"query": "query ($filter: F) { find(filter: $filter) { count tags { id name } } }", "variables": json.dumps({"filter": {"page": "{page}", "per_page": 10}}), "per_page": 10}
    return spark.read.format("paged").schema("id string, name string").options(url=url, rows="data.find.tags", count="data.find.count", api_key="secret", **asked, **options).load()


@pytest.mark.parametrize("path", ["/plain", "/flaky"])
def test_all_pages_are_read_and_transient_failures_tried_again(spark, server, path):
    assert sorted(map(tuple, listing(spark, server + path).collect())) == sorted((r["id"], r["name"]) for r in ROWS)


def test_errors_and_refusals_raise(spark, server):
    for url, options in ((server + "/wrong", {}), (server + "/flaky2", {"api_key": "other"})):
        with pytest.raises(Exception, match="no such field|401"):
            listing(spark, url, pages=1, **options).collect() if not options else paged.fetch(url, body={"variables": {"filter": {"page": 1, "per_page": 10}}}, key="other")


def test_a_slow_reply_ends_at_the_deadline(server):
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        paged.fetch(server + "/slow", body={"variables": {"filter": {"page": 1, "per_page": 10}}}, key="secret", deadline=0.4, attempts=3)
    assert time.monotonic() - began < 2
