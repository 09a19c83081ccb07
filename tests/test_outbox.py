"""The sink against a local server: guards, snapshots, interrupted tasks, approval and undo."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from attesta.operators import actions, outgoing, store
from attesta.sources import files, outbox

ITEM = store.SCHEMAS["item"]


class World:
    """A small server: entities by kind, and a log of the writes it has done."""

    def __init__(self):
        self.lock = threading.Lock()
        self.scenes = {str(k): {"id": str(k), "title": f"t{k}", "details": None, "date": None, "urls": [], "organized": False, "rating100": None, "code": None, "director": None, "stash_ids": [], "studio": None, "performers": [{"id": "p0"}], "tags": [{"id": "9"}]} for k in range(300)}
        self.performers = {"p1": {"id": "p1", "details": "<b>x</b>", "gender": "", "alias_list": [], "urls": ["u"], "image_path": "http://h/i?default=true"}, "p2": {"id": "p2", "details": "y", "gender": "F", "alias_list": [], "urls": [], "image_path": "http://h/j"}}
        self.tags = {str(k): {"id": str(k), "name": f"tag{k}", "description": "", "aliases": [], "scene_count": 0} for k in range(20)}
        self.writes = []
        self.drop_reply = set()

    def answer(self, query, v):
        with self.lock:
            if "findScene(" in query:
                return {"findScene": self.scenes.get(v["id"])}
            if "findPerformer(" in query:
                return {"findPerformer": self.performers.get(v["id"])}
            if "findTag(" in query:
                return {"findTag": self.tags.get(v["id"])}
            if "findTags(" in query:
                return {"findTags": {"tags": [t for t in self.tags.values() if t["name"] == v["n"]]}}
            self.writes.append((query.split("{ ", 1)[1].split("(")[0], json.dumps(v, sort_keys=True)))
            if "tagDestroy" in query:
                del self.tags[v["id"]]
                return {"tagDestroy": True}
            i = v["in"]
            if "sceneUpdate" in query and "bulk" not in query:
                s = self.scenes[i["id"]]
                s.update({k: x for k, x in i.items() if k not in ("performer_ids", "tag_ids", "studio_id")})
                for k in ("performer", "tag"):
                    if f"{k}_ids" in i:
                        s[f"{k}s"] = [{"id": x} for x in i[f"{k}_ids"]]
                if "studio_id" in i:
                    s["studio"] = i["studio_id"] and {"id": i["studio_id"]}
                return {"sceneUpdate": {"id": i["id"]}}
            if "bulkSceneUpdate" in query:
                for k in i["ids"]:
                    for field, at in (("performer_ids", "performers"), ("tag_ids", "tags")):
                        if field in i:
                            own = [x["id"] for x in self.scenes[k][at] if x["id"] not in i[field]["ids"]]
                            self.scenes[k][at] = [{"id": x} for x in own + (i[field]["ids"] if i[field]["mode"] == "ADD" else [])]
                return {"bulkSceneUpdate": []}
            if "performerUpdate" in query:
                self.performers[i["id"]].update(i)
                return {"performerUpdate": {"id": i["id"]}}
            if "tagUpdate" in query:
                self.tags[i["id"]].update(i)
                return {"tagUpdate": {"id": i["id"]}}
            if "tagsMerge" in query:
                for x in i["source"]:
                    del self.tags[x]
                self.tags[i["destination"]].update(i.get("values", {}))
                return {"tagsMerge": {"id": i["destination"]}}
            if "tagCreate" in query:
                if i["name"] == "bad":
                    raise ValueError("this name is refused")
                new = str(1000 + len(self.tags))
                self.tags[new] = {"id": new, "name": i["name"], "description": "", "scene_count": 0}
                return {"tagCreate": {"id": new}}
            raise ValueError(f"unknown request {query}")


@pytest.fixture
def world():
    own = World()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            try:
                found = {"data": own.answer(body["query"], body["variables"])}
            except ValueError as e:
                found = {"errors": [{"message": str(e)}]}
            if self.headers["Idempotency-Key"] in own.drop_reply:
                own.drop_reply.discard(self.headers["Idempotency-Key"])
                self.close_connection = True
                return self.connection.close()  # written, but no one is told
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


def executor(world):
    return outbox.Executor(outbox.asker({"url": world.url}))


def run(world, kind, subject, edits):
    change = {"change_id": f"{kind}:{subject}", "kind": kind, "subject_id": subject, "edits": edits}
    own = executor(world)
    plan = own.plan(change)
    return plan if "verdict" in plan else own.send(change, plan)


def test_a_scene_is_merged_with_what_is_there(world):
    world.scenes["1"]["stash_ids"] = [{"endpoint": "e", "stash_id": "1"}]
    edits = {"title": {"set": "New"}, "performer_ids": {"add": ["p1", "p0", "p1"]}, "tag_ids": {"add": ["3"], "drop": ["9"]}, "studio_id": {"claim": "s1"}, "stash_ids": {"links": [{"endpoint": "f", "stash_id": "2"}]}, "organized": {"set": True}}
    got = run(world, "scene", "1", edits)
    assert got["verdict"] == "applied"
    prior = json.loads(got["prior"])
    assert prior["title"] == "t1" and prior["performer_ids"] == ["p0"] and prior["tag_ids"] == ["9"] and prior["studio_id"] is None and set(prior) == set(outbox.KINDS["scene"].snapshot)
    now = world.scenes["1"]
    assert now["title"] == "New" and [x["id"] for x in now["performers"]] == ["p0", "p1"] and [x["id"] for x in now["tags"]] == ["3"] and now["studio"] == {"id": "s1"}
    assert now["stash_ids"] == [{"endpoint": "e", "stash_id": "1"}, {"endpoint": "f", "stash_id": "2"}]
    again = run(world, "scene", "1", {"studio_id": {"claim": "s2"}, "performer_ids": {"add": ["p1"]}})
    assert json.loads(again["written"]) == {}
    clash = run(world, "scene", "1", {"title": {"set": "X"}, "stash_ids": {"links": [{"endpoint": "e", "stash_id": "7"}]}})
    assert clash["verdict"] == "refused" and "linked to e as 1, not 7" in clash["reason"] and world.scenes["1"]["title"] == "New"


def test_guards(world):
    assert run(world, "performer", "p1", {"details": {"set": "x", "expected": "old"}})["reason"] == "details changed meanwhile"
    assert run(world, "performer", "p1", {"details": {"set": "x", "expected": "<b>x</b>"}})["verdict"] == "applied"
    refused = run(world, "performer", "p2", {"gender": {"fill": "M"}, "alias_list": {"fill": ["a"]}})
    assert refused["reason"] == "gender no longer blank" and world.performers["p2"]["alias_list"] == []
    filled = run(world, "performer", "p1", {"gender": {"fill": "M"}, "alias_list": {"fill": ["a"]}, "image": {"fill": "pic"}})
    assert json.loads(filled["prior"]) == {"alias_list": [], "gender": None, "image": None}
    assert run(world, "performer", "p2", {"image": {"fill": "pic"}})["verdict"] == "refused"
    world.tags["4"]["scene_count"] = 2
    assert run(world, "tag-delete", "4", {"scene_count": {"expected": 0}})["verdict"] == "refused"
    assert run(world, "tag-delete", "5", {"scene_count": {"expected": 0}})["verdict"] == "applied" and "5" not in world.tags
    assert run(world, "tag-delete", "5", {"scene_count": {"expected": 0}})["reason"] == "its subject is gone"
    world.tags["6"]["description"] = "own"
    assert run(world, "tag-merge", "6", {"sources": {"set": ["7"]}, "description": {"set": "d"}})["verdict"] == "refused" and "7" in world.tags
    assert run(world, "tag-merge", "6", {"sources": {"set": ["7"]}})["verdict"] == "applied" and "7" not in world.tags
    assert run(world, "scenes", "9", {"ids": ["1"], "tag_ids": {"ids": ["9"], "mode": "SET"}})["verdict"] == "refused"
    assert run(world, "tag-create", "new", {"name": {"set": "tag8"}})["reply_id"] == "8"
    assert run(world, "tag-create", "new", {"name": {"set": "bad"}})["verdict"] == "failed"


def test_a_lost_reply_is_no_second_write(world):
    world.drop_reply.add("performer:p1")
    got = run(world, "performer", "p1", {"details": {"set": "x", "expected": "<b>x</b>"}})
    assert got["verdict"] == "applied" and json.loads(got["prior"]) == {"details": "<b>x</b>"} and len(world.writes) == 1
    world.drop_reply.add("tag-delete:3")
    assert run(world, "tag-delete", "3", {"scene_count": {"expected": 0}})["verdict"] == "applied"
    world.drop_reply.add("tag-merge:1")
    assert run(world, "tag-merge", "1", {"sources": {"set": ["2"]}})["verdict"] == "applied" and len(world.writes) == 3


def changes(spark, n=40):
    rows = [(f"c{k}", "scene", str(k), json.dumps({"title": {"set": f"new {k}", "expected": f"t{k}"}})) for k in range(n)]
    return spark.createDataFrame(rows + rows[:5], outbox.CHANGE)


def test_each_change_is_written_once(spark, world, tmp_path):
    ledger = str(tmp_path / "ledger")
    world.scenes["7"]["title"] = "by hand"
    got = {r["change_id"]: r for r in outbox.apply_changes(changes(spark), ledger, world.url, batch=7).collect()}
    assert len(got) == 40 and len(world.writes) == 39 and got["c7"]["verdict"] == "refused"
    again = outbox.apply_changes(changes(spark, 42), ledger, world.url).collect()
    assert len(again) == 42 and len(world.writes) == 41
    assert any(p.endswith("_COMMITTED") for d in files.names(ledger, "") for p in files.names(d, "_"))


def test_a_task_that_dies_between_write_and_outcome(spark, world, tmp_path):
    ledger, flag = str(tmp_path / "ledger"), tmp_path / "died"

    class Dying(outbox.Writer):
        def _log(self, name, rows):
            import os

            if name.endswith("done") and not os.path.exists(self.options["flag"]):
                open(self.options["flag"], "w").close()
                raise RuntimeError("the task dies here")
            return super()._log(name, rows)

    class Mortal(outbox.Outbox):
        @classmethod
        def name(cls):
            return "mortal"

        def writer(self, schema, overwrite):
            return Dying(dict(self.options))

    spark.dataSource.register(Mortal)
    with pytest.raises(Exception, match="the task dies here"):
        outbox.apply_changes(changes(spark), ledger, world.url, lanes=2, source="mortal", batch=5, flag=str(flag)).collect()
    assert 0 < len(world.writes) and any(p.endswith("_ABORTED") for d in files.names(ledger, "") for p in files.names(d, "_"))
    got = outbox.apply_changes(changes(spark), ledger, world.url, lanes=3, source="mortal", batch=5, flag=str(flag)).collect()
    assert sorted(r["verdict"] for r in got) == ["applied"] * 40
    assert len(world.writes) == 40 == len(set(world.writes))
    assert all(json.loads(r["prior"])["title"] == "t" + r["subject_id"] for r in got)  # snapshots are of the time before the first attempt


def proposals(spark):
    p = [
        ("scene", "1", {}), ("scene", "2", {}), ("performer", "p1", {"cleaned": "x", "faults": [], "original": "<b>x</b>"}),
        ("performer-enrichment", "p1", {"fields": {"gender": "M", "alias_list": '["a","b"]'}}), ("tag", "1", {"description": "told", "source": "s"}),
        ("tag-cluster", "k", {"canonical": {"id": "2"}, "members": [{"id": "2"}, {"id": "3"}], "undecided": None}), ("tag-cluster", "l", {"canonical": None, "members": [{"id": "4"}], "undecided": "tie"}),
        ("tag-performer", "9", {"matches": [{"id": "p2"}], "name": "n", "resolved": "p2", "scene_count": 300}), ("tag-unused", "10", {"name": "n", "scene_count": 0, "usage": "u"}), ("tag-unused", "11", {"name": "n", "scene_count": 4, "usage": "u"}),
    ]
    rows = [(f"f{k}", "f", kind, subject, "s", None, json.dumps(payload), "p", "new", None, None, None, None, None) for k, (kind, subject, payload) in enumerate(p)]
    return spark.createDataFrame(rows, ITEM)


def present(spark, world):
    rows = [("scene", k, {f: outbox.present_field(s, f) for f in outbox.KINDS["scene"].snapshot}) for k, s in world.scenes.items()]
    rows += [(kind, k, s) for k, s in world.performers.items() for kind in ("performer", "performer-enrichment")] + [("tag", k, s) for k, s in world.tags.items()]
    return spark.createDataFrame([(a, b, json.dumps(c)) for a, b, c in rows], "subject_type string, subject_id string, state string")


def test_approve_write_undo(spark, world, tmp_path):
    items, ledger = proposals(spark), str(tmp_path / "ledger")
    matches = spark.createDataFrame([("1", "Title", ["p1"], ["3"])], "id string, title string, performer_ids array<string>, tag_ids array<string>")
    scenes = spark.createDataFrame([(k, ["p0"] if int(k) else ["p0", "p2"], ["9"]) for k in world.scenes], "id string, performer_ids array<string>, tag_ids array<string>")
    world.scenes["0"]["performers"].append({"id": "p2"})
    routes = outgoing.routed(items, matches, scenes)
    chunks = outgoing.reconciliation_edits(scenes, spark.createDataFrame([("f7", "9", "p2")], "fingerprint string, tag_id string, performer_id string"))
    outcomes = outbox.apply_changes(routes.where("refused is null").select(*(c.split()[0] for c in outbox.CHANGE.split(", "))), ledger, world.url)
    tried = outgoing.attempts(routes, outcomes, chunks)
    done = actions.approve(items, tried, F.lit("2024-01-01").cast("timestamp"))
    state = {r["fingerprint"]: r for r in done.collect()}
    assert {k: r["state"] for k, r in state.items()} == {"f0": "applied", "f1": "failed", "f2": "applied", "f3": "applied", "f4": "applied", "f5": "applied", "f6": "failed", "f7": "applied", "f8": "applied", "f9": "failed"}
    assert state["f6"]["error"] == "no agreed surviving spelling: tie" and state["f1"]["error"] == "no match" and "changed meanwhile" in state["f9"]["error"]
    assert state["f5"]["prior_state"] is None and state["f8"]["prior_state"] is None  # merges and deletions can't be undone
    assert world.performers["p1"]["alias_list"] == ["a", "b"] and world.tags["1"]["description"] == "told" and "3" not in world.tags and "10" not in world.tags
    assert all("9" not in [t["id"] for t in s["tags"]] and "p2" in [p["id"] for p in s["performers"]] for s in world.scenes.values())
    prior = json.loads(state["f7"]["prior_state"])
    assert len(prior["untagged"]) == 300 and len(prior["attached"]) == 299 and sum(w[0] == "bulkSceneUpdate" for w in world.writes) == 2

    world.performers["p1"]["gender"] = "NB"  # changed elsewhere
    keep = spark.createDataFrame([tuple(r) for r in state.values()], ITEM)
    written = outbox.outcomes(spark, ledger).select(F.col("change_id").alias("fingerprint"), "written")
    fields = outgoing.undo_fields(keep, written, present(spark, world))
    told = {(r["fingerprint"], r["field"]): r["verdict"] for r in fields.collect()}
    assert told["f3", "gender"] == "changed meanwhile" and told["f3", "alias_list"] == "restore" and told["f2", "details"] == "restore" and told["f4", "description"] == "restore"
    assert told["f0", "title"] == "restore" and told["f0", "organized"] == "restore"
    assert told["f0", "performer_ids"] == "changed meanwhile"  # the reconciliation came after
    partial = outgoing.undo_changes(fields, whole=False).drop("fingerprint")
    back = {r["change_id"]: r["verdict"] for r in outbox.apply_changes(partial, ledger, world.url).collect()}
    assert back == {f"undo:f{k}": "applied" for k in (0, 2, 3, 4)}
    assert world.performers["p1"] | {"details": 0} == world.performers["p1"] | {"details": 0, "alias_list": [], "gender": "NB"} and world.performers["p1"]["details"] == "<b>x</b>"
    assert world.scenes["1"]["title"] == "t1" and world.tags["1"]["description"] == ""
    steps = outgoing.undo_reconciliations(keep)
    for step in (0, 1):
        outbox.apply_changes(steps.where(F.col("step") == step).drop("fingerprint", "step"), ledger, world.url).collect()
    people = lambda k: [p["id"] for p in world.scenes[k]["performers"]]
    assert all("9" in [t["id"] for t in s["tags"]] for s in world.scenes.values()) and "p2" in people("0") and "p2" not in people("5")
    whole = {r["change_id"] for r in outgoing.undo_changes(fields).collect()}
    assert "undo:f3" not in whole and "undo:f2" in whole


def test_names_are_created_once(spark, world, tmp_path):
    from attesta.operators import changes as plans

    names = spark.createDataFrame([("fresh", None), (" Fresh ", None), ("tag8", None), ("bad", None)], "name string, stored_id string")
    entities = spark.createDataFrame([("8", "tag8", [])], "id string, name string, aliases array<string>")
    ids = plans.find_or_create(names, entities)
    made = outbox.apply_changes(outgoing.missing_entities(ids, "tag"), str(tmp_path / "l"), world.url)
    got = {r["name"]: (r["id"], r["error"]) for r in outgoing.with_created(ids, made).collect()}
    assert got["fresh"] == got[" Fresh "] == ("1020", None) and got["tag8"] == ("8", None) and got["bad"][0] is None and "refused" in got["bad"][1]
    assert sum(w[0] == "tagCreate" for w in world.writes) == 2


def test_an_unknown_snapshot_of_a_reconciliation_is_refused(spark):
    row = ("f", "f", "tag-performer", "9", "s", None, "{}", "p", "applied", '{"tag_id":"8","performer_id":"p","attached":[],"untagged":[]}', None, None, None, None)
    with pytest.raises(Exception, match="does not name this tag"):
        outgoing.undo_reconciliations(spark.createDataFrame([row], ITEM)).collect()
        outgoing.undo_reconciliations(spark.createDataFrame([row[:9] + ('{"tag_id":"8","performer_id":"p","attached":["1"],"untagged":["1"]}',) + row[10:]], ITEM)).collect()
