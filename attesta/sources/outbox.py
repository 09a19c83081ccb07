"""A batch sink for change sets: each change is written to a server once, with an outcome row and a snapshot for its undo.

    outbox.register(spark)
    outcomes = outbox.apply_changes(changes, ledger="hdfs://.../ledger", url="https://host/graphql", api_key="...")

A change is (change_id, kind, subject_id, edits); ``kind`` names an entry of KINDS, ``edits`` is a JSON object of field -> edit:

    {"set": v}                    write v; with "expected": e only if the field still holds e (compare-and-set)
    {"fill": v}                   write v if the field is blank, else refuse the whole change
    {"claim": v}                  write v if the field is blank, else leave it
    {"add": [..], "drop": [..]}   the present list with some added and some dropped, sent only if that changes it
    {"links": [..]}               source ids merged by endpoint; another id for a known endpoint refuses the whole change
    {"expected": e}               refuse unless the field holds e; nothing is written to it

The present state is read right before the write, by the task that writes. A change has one of three verdicts: applied;
refused (its guard failed, so nothing was sent); failed (the server answered with an error, or not at all).

Writing once. Every batch of changes goes through two phases in the *ledger*, a folder that all tasks share: first a file of
intents (what is there now, what will be sent), then the writes, then a file of outcomes. A task that starts again, or a later
run over the same changes, skips those with an outcome. One with an intent but no outcome is looked at on the server:
if it holds what was to be sent, it is applied with the snapshot of the intent; if it still holds what was there before,
it is sent (with its content id as Idempotency-Key); anything else is refused. A commit lists the run's files; an abort leaves
them, since writes to a server can't be taken back and the next run goes on from there. Keep speculation off for such jobs.
"""

from __future__ import annotations

import json
import urllib.error
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from attesta.sources import files
from attesta.sources.paged import fetch

CHANGE = "change_id string, kind string, subject_id string, edits string"
OUTCOME = "change_id string, kind string, subject_id string, verdict string, reason string, prior string, written string, reply_id string"
LEDGER = f"{OUTCOME}, phase string, run string"
BATCH = 50


@dataclass(frozen=True)
class Kind:
    """How the entity of a kind of change is read and written. ``snapshot``: fields kept for an undo; none: those edited."""

    read: str = ""
    at: str = ""
    write: str = ""
    snapshot: tuple[str, ...] = ()
    #: Whether the subject no longer being there means that an interrupted write has been done.
    gone_is_done: bool = False


_SCENE = ("title", "details", "date", "urls", "organized", "rating100", "code", "director", "stash_ids", "studio_id", "performer_ids", "tag_ids")
_PERFORMER = "details disambiguation piercings tattoos eye_color country gender measurements career_length birthdate ethnicity alias_list urls height_cm image_path"
# Requests as the server's interface names them.
KINDS = {
    "scene": Kind(
        "query($id: ID!){ findScene(id:$id){ id title details date urls organized rating100 code director stash_ids{ endpoint stash_id } studio{ id } performers{ id } tags{ id } } }",
        "findScene", "mutation($in: SceneUpdateInput!){ sceneUpdate(input:$in){ id } }", _SCENE,
    ),
    "performer": Kind(f"query($id: ID!){{ findPerformer(id:$id){{ id {_PERFORMER} }} }}", "findPerformer", "mutation($in: PerformerUpdateInput!){ performerUpdate(input:$in){ id } }"),
    "tag": Kind("query($id: ID!){ findTag(id:$id){ id description aliases scene_count } }", "findTag", "mutation($in: TagUpdateInput!){ tagUpdate(input:$in){ id } }"),
    "tag-merge": Kind("query($id: ID!){ findTag(id:$id){ id description } }", "findTag", "mutation($in: TagsMergeInput!){ tagsMerge(input:$in){ id } }"),
    "tag-delete": Kind("query($id: ID!){ findTag(id:$id){ id scene_count } }", "findTag", "mutation($id: ID!){ tagDestroy(input:{id:$id}) }", gone_is_done=True),
    "scenes": Kind(write="mutation($in: BulkSceneUpdateInput!){ bulkSceneUpdate(input:$in){ id } }"),
    **{
        f"{x.lower()}-create": Kind(f"query($n: String!){{ find{x}s({x.lower()}_filter:{{name:{{value:$n, modifier:EQUALS}}}}, filter:{{per_page:200}}){{ {x.lower()}s{{ id name }} }} }}", f"find{x}s.{x.lower()}s", f"mutation($in: {x}CreateInput!){{ {x.lower()}Create(input:$in){{ id }} }}")
        for x in ("Studio", "Performer", "Tag")
    },
}
# End of fixed values.
#: Fields that are read under another name than they are written.
READ_AS = {"image": "image_path"}
NO_IMAGE = "default=true"


class Refused(Exception):
    """A guard that does not hold; nothing was sent."""


class Failed(Exception):
    """The server's own error."""


def present_field(state: dict, field: str) -> object:
    """A field of a server's reply under the name it is written by: ids for entities."""
    if field in state:
        return state[field]
    if field.endswith("_ids") and isinstance(found := state.get(field.removesuffix("_ids") + "s"), list):
        return [str(x["id"]) for x in found]
    if field.endswith("_id") and isinstance(state.get(field.removesuffix("_id")), dict):
        return str(state[field.removesuffix("_id")]["id"])
    return state.get(READ_AS.get(field, field))


def blank(field: str, value: object) -> bool:
    return value in (None, "") or value == [] or field == "image" and isinstance(value, str) and NO_IMAGE in value


def merged_links(present: list[dict], links: list[dict]) -> list[dict]:
    """Source ids by endpoint; refuses where an endpoint is known under another id."""
    out = [dict(x) for x in present]
    for link in links:
        held = {x["stash_id"] for x in out if x["endpoint"] == link["endpoint"]}
        if not held:
            out.append({"endpoint": link["endpoint"], "stash_id": link["stash_id"]})
        elif held != {link["stash_id"]}:
            raise Refused(f"linked to {link['endpoint']} as {', '.join(sorted(held))}, not {link['stash_id']}")
    return out


def wanted(state: dict | None, edits: dict) -> dict:
    """Fields to be sent, from the present state; raises ``Refused`` where a guard does not hold."""
    if state is None:
        raise Refused("its subject is gone")
    out: dict = {}
    filled = []
    for field, edit in edits.items():
        now = present_field(state, field)
        if "expected" in edit and now != edit["expected"]:
            raise Refused(f"{field} changed meanwhile")
        if "set" in edit:
            out[field] = edit["set"]
        elif "fill" in edit:
            filled += [field] if not blank(field, now) else []
            out[field] = edit["fill"]
        elif "claim" in edit:
            if blank(field, now):
                out[field] = edit["claim"]
        elif "links" in edit:
            if edit["links"]:
                out[field] = merged_links(now or [], edit["links"])
        elif "add" in edit or "drop" in edit:
            had = list(now or [])
            drop = set(edit.get("drop") or ())
            new = [x for k, x in enumerate(edit.get("add") or ()) if x not in had and x not in edit["add"][:k]]
            listed = [x for x in had + new if x not in drop]
            if listed != had:
                out[field] = listed
    if filled:
        raise Refused(f"{', '.join(sorted(filled))} no longer blank")
    return out


class Executor:
    """Performs changes against one server. ``ask(body, idempotency_key)`` gives the reply's ``data`` or raises."""

    def __init__(self, ask: Callable[[dict, str | None], dict]):
        self.ask = ask

    def _read(self, change: dict) -> dict | None:
        kind = KINDS[change["kind"]]
        if not kind.read:
            return {}
        variables = {"n": change["edits"]["name"]["set"]} if change["kind"].endswith("-create") else {"id": change["subject_id"]}
        found = self.ask({"query": kind.read, "variables": variables}, None)
        for step in kind.at.split("."):
            found = found.get(step) if isinstance(found, dict) else None
        return found

    def plan(self, change: dict) -> dict:
        """The intent: ``prior``, the snapshot, and ``send``, the fields to be sent; or a settled outcome."""
        kind, edits = KINDS[change["kind"]], change["edits"]
        try:
            state = self._read(change)
            if change["kind"] == "scenes":
                if bad := [f for f, x in edits.items() if f != "ids" and x.get("mode") not in ("ADD", "REMOVE")]:
                    raise Refused(f"{', '.join(bad)}: a bulk write adds or removes")
                return {"prior": None, "send": edits}
            if change["kind"].endswith("-create"):
                name = edits["name"]["set"].strip().lower()
                if same := [x["id"] for x in state or () if x["name"].strip().lower() == name]:
                    return _outcome(change, "applied", reply_id=str(min(same)))
                return {"prior": None, "send": {"name": edits["name"]["set"]}}
            if change["kind"] == "tag-merge":
                if state is None:
                    raise Refused("its subject is gone")
                carried = edits.get("description", {}).get("set")
                if carried is not None and state.get("description"):
                    raise Refused("the survivor has a description")
                values = {} if carried is None else {"values": {"id": change["subject_id"], "description": carried}}
                return {"prior": None, "send": {"source": edits["sources"]["set"], "destination": change["subject_id"], **values}}
            fields = wanted(state, edits)
            if change["kind"] == "tag-delete":
                return {"prior": None, "send": {}}
            prior = {f: present_field(state, f) for f in kind.snapshot or edits}
            if change["kind"] == "performer":  # a field that was filled goes back to the blank of its kind, whichever it held
                prior |= {f: [] if isinstance(x["fill"], list) else None for f, x in edits.items() if "fill" in x}
            return {"prior": prior, "send": fields}
        except Refused as e:
            return _outcome(change, "refused", str(e))
        except (Failed, OSError, ValueError) as e:
            return _outcome(change, "failed", f"{type(e).__name__}: {e}")

    def _done(self, change: dict, intent: dict) -> bool | None:
        """Whether the server holds what the intent sends; None if neither that nor what was there before."""
        if change["kind"] == "scenes":
            return False  # adding and removing may be said twice
        state = self._read(change)
        if change["kind"].endswith("-create"):
            return False  # planned anew: an entity of that name counts as made
        if change["kind"] == "tag-merge":
            read = lambda i: self.ask({"query": KINDS["tag"].read, "variables": {"id": i}}, None).get("findTag")
            return not any(read(i) for i in intent["send"]["source"])
        if state is None:
            return True if KINDS[change["kind"]].gone_is_done else None
        held = {f: present_field(state, f) for f in intent["send"]}
        if held == intent["send"] and held:
            return True
        before = {f: (intent["prior"] or {}).get(f) for f in held}
        same = all(v == before[f] or blank(f, v) and blank(f, before[f]) for f, v in held.items())
        return False if same else None

    def send(self, change: dict, intent: dict, begun: bool = False) -> dict:
        """The outcome of writing what an intent says; ``begun``: an earlier attempt may have written it already."""
        prior = None if intent["prior"] is None else _json(intent["prior"])
        sent = {k: v for k, v in intent["send"].items() if k not in ("id", "ids")}
        try:
            if begun:
                done = self._done(change, intent)
                if done:
                    return _outcome(change, "applied", prior=prior, written=_json(sent))
                if done is None:
                    return _outcome(change, "refused", "changed while it was written")
                if change["kind"].endswith("-create"):
                    planned = self.plan(change)
                    if "verdict" in planned:
                        return planned
            if change["kind"] == "tag-delete":
                variables = {"id": change["subject_id"]}
            elif change["kind"] in ("scene", "performer", "tag"):
                variables = {"in": {"id": change["subject_id"], **intent["send"]}}
            else:
                variables = {"in": intent["send"]}
            reply = self.ask({"query": KINDS[change["kind"]].write, "variables": variables}, change["change_id"])
            made = next((x["id"] for x in reply.values() if isinstance(x, dict) and "id" in x), None) if change["kind"].endswith("-create") else None
            return _outcome(change, "applied", prior=prior, written=_json(sent), reply_id=None if made is None else str(made))
        except (Failed, OSError, ValueError) as e:
            # no reply is no proof that nothing was written
            if not begun and isinstance(e, OSError) and not isinstance(e, urllib.error.HTTPError):
                return self.send(change, intent, begun=True)
            return _outcome(change, "failed", f"{type(e).__name__}: {e}")


def _json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _outcome(change: dict, verdict: str, reason: str | None = None, prior: str | None = None, written: str | None = None, reply_id: str | None = None) -> dict:
    own = {k: change[k] for k in ("change_id", "kind", "subject_id")}
    return {**own, "verdict": verdict, "reason": reason, "prior": prior, "written": written, "reply_id": reply_id}


def asker(options: dict) -> Callable[[dict, str | None], dict]:
    """ask() of an Executor, over HTTP: transient failures of reads are tried again, a write is sent once."""

    def ask(body: dict, key: str | None) -> dict:
        headers = {"Idempotency-Key": key} if key else None
        tries = 1 if key else int(options.get("attempts", 2))
        reply = fetch(options["url"], float(options.get("timeout", 30)), tries, body=body, key=options.get("api_key"), deadline=float(options.get("deadline", 120)), headers=headers)
        if not isinstance(reply, dict) or reply.get("errors"):
            raise Failed(json.dumps(reply.get("errors") if isinstance(reply, dict) else reply)[:500])
        return reply.get("data") or {}

    return ask


class _Written(WriterCommitMessage):
    def __init__(self, files_: list[str], counts: dict[str, int]):
        self.files, self.counts = files_, counts


class Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options
        self.folder = f"{options['ledger'].rstrip('/')}/{options['run']}"

    def _log(self, name: str, rows: list[dict]) -> str:
        path = f"{self.folder}/{name}.jsonl"
        files.write_whole(path, "".join(json.dumps(r) + "\n" for r in rows).encode())
        return path

    def _earlier(self, part: int) -> tuple[dict[str, dict], dict[str, dict]]:
        """(outcomes, intents) that earlier attempts of this task have left."""
        done, begun = {}, {}
        for path in sorted(files.names(self.folder, f"part-{part:05d}-")):
            for line in files.read(path).decode().splitlines():
                row = json.loads(line)
                (done if row["phase"] == "done" else begun)[row["change_id"]] = row
        return done, begun

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        task = TaskContext.get()
        part, stem = task.partitionId(), f"part-{task.partitionId():05d}-{task.attemptNumber():03d}-{uuid.uuid4().hex[:8]}"
        done, begun = self._earlier(part)
        own, logs, counts = Executor(asker(self.options)), [], {}
        batch: list[dict] = []

        def settle() -> None:
            n = len(logs)
            plans = []
            for change in batch:
                known = begun.get(change["change_id"]) or change.pop("begun", None)
                plans.append((change, json.loads(known["intent"]) if isinstance(known, dict) else json.loads(known) if known else own.plan(change), bool(known)))
            intents = [{**{k: c[k] for k in ("change_id", "kind", "subject_id")}, "phase": "begun", "intent": _json(p), "run": self.options["run"]} for c, p, again in plans if "verdict" not in p and not again]
            if intents:
                logs.append(self._log(f"{stem}-{n:05d}-begun", intents))
            out = [p if "verdict" in p else own.send(c, p, again) for c, p, again in plans]
            for x in out:
                counts[x["verdict"]] = counts.get(x["verdict"], 0) + 1
            logs.append(self._log(f"{stem}-{n:05d}-done", [x | {"phase": "done", "run": self.options["run"]} for x in out]))
            batch.clear()

        for row in iterator:
            change = row.asDict()
            if change["change_id"] in done:
                continue
            change["edits"] = json.loads(change["edits"])
            if change["kind"] not in KINDS:
                raise ValueError(f"no such kind of change: {change['kind']!r}")
            batch.append(change)
            if len(batch) >= int(self.options.get("batch", BATCH)):
                settle()
        if batch:
            settle()
        return _Written(logs, counts)

    def _end(self, name: str, messages: list) -> None:
        found = [m for m in messages if m is not None]
        counts: dict[str, int] = {}
        for m in found:
            for k, n in m.counts.items():
                counts[k] = counts.get(k, 0) + n
        files.write_whole(f"{self.folder}/{name}", json.dumps({"files": sorted(f for m in found for f in m.files), "counts": counts}).encode())

    def commit(self, messages: list) -> None:
        self._end("_COMMITTED", messages)

    def abort(self, messages: list) -> None:
        self._end("_ABORTED", messages)


class Outbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Outbox)


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """Intents and outcomes of all runs."""
    if not files.names(ledger, ""):
        return spark.createDataFrame([], f"{LEDGER}, intent string")
    return spark.read.schema(f"{LEDGER}, intent string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(ledger)


def outcomes(spark: SparkSession, ledger: str) -> DataFrame:
    """One outcome per change that has one."""
    return ledger_rows(spark, ledger).where("phase = 'done'").groupBy("change_id").agg(*[F.min_by(c, F.struct("run", "verdict")).alias(c) for c in (x.split()[0] for x in OUTCOME.split(", ")) if c != "change_id"])


def apply_changes(changes: DataFrame, ledger: str, url: str, lanes: int = 8, source: str = "outbox", **options: object) -> DataFrame:
    """Writes the changes (columns of CHANGE, repeated ids once) that have no outcome yet, over ``lanes`` connections; gives the outcomes of all of them."""
    spark = changes.sparkSession
    if source == "outbox":
        register(spark)
    once = changes.groupBy("change_id").agg(*[F.min_by(c, F.struct("kind", "subject_id", "edits")).alias(c) for c in ("kind", "subject_id", "edits")])
    log = ledger_rows(spark, ledger)
    begun = log.where("phase = 'begun'").groupBy("change_id").agg(F.min_by("intent", "run").alias("begun"))
    todo = once.join(log.where("phase = 'done'").select("change_id"), "change_id", "left_anti").join(begun, "change_id", "left")
    run = uuid.uuid4().hex
    # the number of lanes bounds how much the server is asked at a time; changes of one subject share a lane, and bulk writes,
    # which touch subjects of others, come after the rest, so no change reads what another is about to replace
    for wave, own in enumerate((todo.where("kind <> 'scenes'"), todo.where("kind = 'scenes'"))):
        own.repartition(lanes, "subject_id").write.format(source).options(ledger=ledger, run=f"{run}-{wave}", url=url, **options).mode("append").save()
    return once.select("change_id").join(outcomes(spark, ledger), "change_id")
