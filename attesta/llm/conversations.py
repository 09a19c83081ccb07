"""Conversation structure repair: the cheapest edits that give roles the form ``(s?(ua)+)?``, with the least audit.

Per conversation, rows come by turn (nulls first), then role, then SHA-256 of the text. A row's first fault counts: blank (no
character but ASCII white space), duplicate (role and text seen earlier), truncated (last such character none of ``.!?``).
Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant turn) 3; a truncated row that is
not deleted costs 3 more; blank and duplicate rows must go.

Cost layers: ``Layers`` holds, for each cost from 0 on and each turn, the bitset of grammar states from which the rest can be
finished at exactly this cost; a layer is made from the layers 3, 4, 6 and as many below it. The first layer that holds the
start state is the cost. The audit is traced through the bits: at each turn the ASCII-least edit whose rest is in the bitset.
Rows that must go cost 4 in any case and never stand after an Insert in the least audit, so layers hold the other rows only.

Long conversations are split. Rows are dealt by range of (conversation, turn, role, text), so one conversation may fill many
tasks; texts that repeat within a conversation are reduced to their first row before, and equal rows to a count. A
conversation that lies within one task and segment is finished there. Of the others each segment (at most ``SEGMENT`` rows)
gives the costs from each state to each state; a pass backwards over these gives what every segment has still to pay after
it, each segment then traces its edits from every state, and a pass forwards picks the trace and feeds the texts, segment
by segment, to the digest. Only the digest itself, which is a chain, runs through a conversation's text in one task.

Defined results: null roles and texts are one space; a role that starts with none of s, u, a (an empty one too) can't be kept;
null turns count as one turn place before all others and are left out of the gaps; a null conv_id is a conversation of
its own; rows that repeat are duplicates; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import bounded, lean, persist

#: Rows of a segment and of the pieces it is solved in, text of a segment, shapes a worker remembers.
SEGMENT, PIECE, SEGMENT_BYTES, SHAPES = 4096, 64, 8 << 20, 100_000
KEEP, REROLE, DELETE, INSERT, OPEN = 0, 3, 4, 3, 3
#: Grammar states: 0 at the start, 1 after s, 2 after u, 3 after a. The role each state asks for, and the state it leads to.
ASKED, LED = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: Cost of ending in each state: the inserts still asked for.
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = frozenset(("su", "ua", "au"))
NULL_TURN = -(2**63)


def _before(step: tuple[int | None, ...]) -> list[int]:
    """For each bitset of states, the states that ``step`` leads into it."""
    return [sum(1 << q for q, to in enumerate(step) if to is not None and bits >> to & 1) for bits in range(16)]


_ASKED = _before(LED)
_KEPT = {c: _before(s) for c, s in STEP.items()}
_NEVER = [0] * 16


class Layers:
    """Cost layers of a run of rows; ``shape`` has two characters a row: its initial (``-`` if none may be kept), and ``o`` if truncated.

    ``after``: the cost of all that follows from each state, None where it can't be finished.
    """

    def __init__(self, shape: str, after: tuple[int | None, ...]):
        self.rows = [(_KEPT.get(shape[k], _NEVER), OPEN if shape[k + 1] == "o" else 0, STEP.get(shape[k])) for k in range(0, len(shape), 2)]
        ends = [x for x in after if x is not None]
        self.base = min(ends)
        self.ends = {c: sum(1 << q for q, x in enumerate(after) if x is not None and x - self.base == c) for c in {x - self.base for x in ends}}
        self.top = max(ends) - self.base + DELETE * len(self.rows) + 3 * INSERT
        self.layers: list[list[int]] = []

    def _add(self) -> list[int]:
        c, past, n = len(self.layers), self.layers, len(self.rows)
        own = [0] * (n + 1)
        own[n] = self.ends.get(c, 0)
        past.append(own)
        for i in range(n - 1, -1, -1):
            kept, dear, _ = self.rows[i]
            x = kept[past[c - dear][i + 1]] if c >= dear else 0
            if c >= INSERT:
                x |= _ASKED[past[c - INSERT][i]]
                if c >= DELETE:
                    x |= past[c - DELETE][i + 1]
                if c >= REROLE + dear:
                    x |= _ASKED[past[c - REROLE - dear][i + 1]]
            own[i] = x
        return own

    def cost(self, q: int) -> int | None:
        """Of finishing from state ``q``, with all that follows."""
        for c in range(self.top + 1):
            if (self.layers[c] if c < len(self.layers) else self._add())[0] >> q & 1:
                return self.base + c
        return None

    def trace(self, q: int) -> tuple[str, int]:
        """(least edits of these rows from state ``q``, state after them)."""
        c, i, n, past, out = self.cost(q) - self.base, 0, len(self.rows), self.layers, []
        while i < n:
            _, dear, step = self.rows[i]
            to = step[q] if step else None
            if c >= DELETE and past[c - DELETE][i + 1] >> q & 1:
                out.append("D")
                i, c = i + 1, c - DELETE
            elif c >= INSERT and past[c - INSERT][i] >> LED[q] & 1:
                out.append("I")
                q, c = LED[q], c - INSERT
            elif to is not None and c >= dear and past[c - dear][i + 1] >> to & 1:
                out.append("K")
                i, q, c = i + 1, to, c - dear
            else:
                out.append("R")
                i, q, c = i + 1, LED[q], c - REROLE - dear
        return "".join(out), q


def _pieces(shape: str, after: tuple[int | None, ...]) -> list[Layers]:
    """Layers of each piece of ``shape``, in order, before ``after``."""
    out: list[Layers] = []
    for k in range(max(0, len(shape) - 1) // (2 * PIECE), -1, -1):
        own = Layers(shape[2 * PIECE * k : 2 * PIECE * (k + 1)], after)
        after = tuple(own.cost(q) for q in range(4))
        out.append(own)
    return out[::-1]


def costs(shape: str) -> list[list[int | None]]:
    """[from][to]: the cost of these rows from each state to each state."""
    to = [_pieces(shape, tuple(0 if q == f else None for q in range(4)))[0] for f in range(4)]
    return [[to[f].cost(q) for f in range(4)] for q in range(4)]


def edits(shape: str, after: tuple[int | None, ...] = END, q: int = 0) -> tuple[int, str, int]:
    """(cost with all that follows, least edits, state after) of rows that begin in state ``q``."""
    if len(shape) <= 2 * PIECE:
        parts = [Layers(shape, after)]
    else:
        parts = _pieces(shape, after)
    cost, out = parts[0].cost(q), []
    for own in parts:
        letters, q = own.trace(q)
        out.append(letters)
    return cost, "".join(out), q


class _Run:
    """Rows of one conversation that follow each other: facts, and what is needed to repair them."""

    __slots__ = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "last_turn", "first", "last", "roles", "texts", "times", "shape", "bytes")

    def __init__(self):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.bytes = 0
        self.low = self.high = self.last_turn = self.first = self.last = None
        self.roles, self.texts, self.times, self.shape = [], [], [], []

    def add(self, turn: int | None, role: str, text: str | None, copies: int, blank: bool, is_open: bool) -> None:
        """``copies`` equal rows; ``text`` only if the first of them is neither blank nor a duplicate."""
        c = role[:1]
        self.illegal += (copies - 1 if c + c not in LEGAL else 0) + (self.rows > 0 and self.last + c not in LEGAL)
        if not self.rows:
            self.first = c
        self.last = c
        self.rows += copies
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last_turn
            self.high = self.last_turn = turn
        gone = copies if text is None else copies - 1
        if blank:
            self.blank += copies
        else:
            self.duplicate += gone
            self.truncated += text is not None and is_open
        if text is not None:
            self.roles.append(role)
            self.texts.append(text)
            self.times.append(0)
            self.shape.append((c if c in STEP else "-") + ("o" if is_open else "-"))
            self.bytes += len(text)
        if gone:
            self._gone(gone)

    def _gone(self, n: int) -> None:
        """``n`` rows that must go, after the rows so far; times[k] counts them behind row k - 1 (0: before all)."""
        if not self.times:
            self.times.append(0)
            self.roles.append("")
            self.texts.append(None)
            self.shape.append("")
        self.times[-1] += n


class _Repaired:
    """Audit and text of the repaired conversation, fed in order."""

    def __init__(self, keep: bool):
        self.audit, self.sha, self.kept, self.any, self.q = [], hashlib.sha256(), [] if keep else None, False, 0

    def _line(self, role: str, text: str) -> None:
        line = ("\n" if self.any else "") + f"{role}:{text}"
        self.sha.update(line.encode("utf-8", "surrogatepass"))
        if self.kept is not None:
            self.kept.append(line)
        self.any = True

    def feed(self, roles: list[str], texts: list[str | None], times: list[int], letters: str) -> None:
        at = iter(letters)
        for role, text, gone in zip(roles, texts, times, strict=True):
            if text is not None:
                for e in at:
                    self.audit.append(e)
                    if e == "D":
                        break
                    asked = ASKED[self.q]
                    if e == "K":
                        self.q = STEP[role[:1]][self.q]
                        self._line(role, text)
                        break
                    self.q = LED[self.q]
                    self._line(asked, text if e == "R" else "")
                    if e == "R":
                        break
            self.audit.append("D" * gone)

    def end(self) -> tuple[str, str, str | None]:
        while END[self.q]:
            self.audit.append("I")
            self._line(ASKED[self.q], "")
            self.q = LED[self.q]
        return "".join(self.audit), self.sha.hexdigest(), None if self.kept is None else "".join(self.kept)


FACTS = "blank long, duplicate long, truncated long, illegal long"
DONE = f"conv_id long, gaps long, {FACTS}, cost long, audit string, repaired_sha256 string, repaired string"
SEGMENTS = (
    f"{DONE}, part int, seg long, n_rows long, turns long, low long, high long, last_turn long, first string, last string,"
    " roles array<string>, texts array<string>, times array<long>, shape string, costs array<long>"
)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


_DONE, _SEGMENTS = _arrow(DONE), _arrow(SEGMENTS)


class _Rows:
    """Result rows, given out in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.held, self.size = schema, [], 0

    def add(self, row: dict, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.held.append(row)
        self.size += size + 200
        if self.size > 4 << 20:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.RecordBatch.from_pylist(self.held, self.schema)
            self.held, self.size = [], 0


def _cutter(texts: bool):
    """mapInArrow function over sorted rows: finished conversations, and segments of those that may go on elsewhere."""
    known: dict[str, tuple[int, str]] = {}

    def finished(conv: int | None, run: _Run) -> dict:
        shape = "".join(run.shape)
        if shape not in known:
            if len(known) >= SHAPES:
                known.clear()
            known[shape] = edits(shape)[:2]
        cost, letters = known[shape]
        out = _Repaired(texts)
        out.feed(run.roles, run.texts, run.times, letters)
        audit, sha, kept = out.end()
        gaps = 0 if run.low is None else run.high - run.low + 1 - run.turns
        facts = {"blank": run.blank, "duplicate": run.duplicate, "truncated": run.truncated, "illegal": run.illegal}
        return {"conv_id": conv, "gaps": gaps, **facts, "cost": cost + DELETE * (run.blank + run.duplicate), "audit": audit, "repaired_sha256": sha, "repaired": kept}

    def segment(conv: int | None, run: _Run, part: int, seg: int) -> dict:
        shape = "".join(run.shape)
        facts = {k: getattr(run, k) for k in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "last_turn", "first", "last", "roles", "texts", "times")}
        flat = [-1 if x is None else x for row in costs(shape) for x in row]
        return {"conv_id": conv, **facts, "part": part, "seg": seg, "n_rows": run.rows, "shape": shape, "costs": flat}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, out = TaskContext.get().partitionId(), 0, _Rows(_SEGMENTS)
        conv, run, first, split, text = None, None, True, False, None
        for batch in batches:
            for own, turn, role, kind, body, copies, blank, is_open in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if run is None:
                    conv, run = own, _Run()
                elif own != conv:
                    if first or split:
                        yield from out.add(segment(conv, run, part, seg), run.bytes)
                        seg += 1
                    else:
                        yield from out.add(finished(conv, run))
                    conv, run, first, split = own, _Run(), False, False
                if kind == 0:
                    text = body
                elif copies:
                    run.add(turn, role, text, copies, blank, is_open)
                    text = None
                    if len(run.times) >= SEGMENT or run.bytes >= SEGMENT_BYTES:
                        yield from out.add(segment(conv, run, part, seg), run.bytes)
                        seg, run, split = seg + 1, _Run(), True
        if run is not None:
            yield from out.add(segment(conv, run, part, seg), run.bytes)
        yield from out.flush()

    return cut


def _owed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments' costs, last segment of a conversation first: what each segment has still to pay after it, from each state."""
    conv, after, any_ = None, END, False
    for batch in batches:
        rows = []
        for own, part, seg, flat in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if not any_ or own != conv:
                conv, after, any_ = own, END, True
            rows.append({"part": part, "seg": seg, "after": [-1 if x is None else x for x in after]})
            ways = [[flat[4 * q + f] + x for f, x in enumerate(after) if x is not None and flat[4 * q + f] >= 0] for q in range(4)]
            after = tuple(min(w) if w else None for w in ways)
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("seg", pa.int64()), ("after", pa.list_(pa.int64()))]))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``ways`` (least edits from each state, empty where it can't be finished), ``leads`` (state after) and ``total`` (cost from each state)."""
    for batch in batches:
        ways, leads, totals = [], [], []
        for shape, after in zip(batch.column("shape").to_pylist(), batch.column("after").to_pylist(), strict=True):
            parts = _pieces(shape, tuple(None if x < 0 else x for x in after))
            ways.append([])
            leads.append([])
            totals.append([])
            for q in range(4):
                cost, at, out = parts[0].cost(q), q, []
                for own in parts if cost is not None else ():
                    letters, at = own.trace(at)
                    out.append(letters)
                ways[-1].append("".join(out))
                leads[-1].append(at)
                totals[-1].append(-1 if cost is None else cost)
        added = {"ways": pa.array(ways, pa.list_(pa.string())), "leads": pa.array(leads, pa.list_(pa.int64())), "totals": pa.array(totals, pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])


def _joiner(texts: bool):
    """mapInArrow function over traced segments in order: one row per conversation."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, conv, held, now = _Rows(_DONE), None, None, {}

        def closed() -> dict:
            audit, sha, kept = held.end()
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            facts = {k: now[k] for k in ("blank", "duplicate", "truncated", "illegal")}
            return {"conv_id": conv, "gaps": gaps, **facts, "cost": now["cost"] + DELETE * (now["blank"] + now["duplicate"]), "audit": audit, "repaired_sha256": sha, "repaired": kept}

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                if held is None or row["conv_id"] != conv:
                    if held is not None:
                        yield from rows.add(closed())
                    conv, held = row["conv_id"], _Repaired(texts)
                    now = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"cost": row["totals"][0], "low": None, "high": None, "last": None}
                for name in ("blank", "duplicate", "truncated", "illegal"):
                    now[name] += row[name]
                if row["n_rows"]:
                    now["illegal"] += now["last"] is not None and now["last"] + row["first"] not in LEGAL
                    now["last"] = row["last"]
                if row["low"] is not None:
                    now["turns"] += row["turns"] - (now["high"] == row["low"])
                    now["low"], now["high"] = row["low"] if now["low"] is None else now["low"], row["high"]
                held.feed(row["roles"], row["texts"], row["times"], row["ways"][held.q])
        if held is not None:
            yield from rows.add(closed())
        yield from rows.flush()

    return join


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32 of ``conv_id:turn`` mod 20; a dropped row has no copies, a repeated one two."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn)))
    fate = F.crc32(key) % 20
    was = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return rows.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(F.coalesce(F.col(role).cast("string"), F.lit(" "))).alias("role"),
        F.when(fate <= 1, "").when(fate == 2, F.translate(was, ".!?", "")).otherwise(was).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, texts: bool = False) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired.

    ``copies`` names a column that says how often a row stands (0: not at all, though its conversation is listed). ``repaired``,
    the ``role:text`` lines of the repaired conversation, is null unless ``texts``.
    """
    bounded(rows.sparkSession)
    body, blank_char = F.coalesce(F.col(text).cast("string"), F.lit(" ")), r"[^\x20\x09-\x0D]"
    base = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(turn).cast("long"), F.lit(NULL_TURN)).alias("at"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        body.alias("text"),
        (F.col(copies).cast("long") if copies else F.lit(1).cast("long")).alias("copies"),
    )
    blank = ~F.col("text").rlike(blank_char)
    digest = F.unhex(F.sha2("text", 256))
    keys = ["conv_id", "at", "role", "digest"]
    # where each row stands: skinny, equal rows as one with a count
    places = (
        base.groupBy("conv_id", "turn", "at", "role", digest.alias("digest"), blank.alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))
        .agg(F.sum("copies").alias("copies"))
        .select(*keys, F.lit(1).alias("kind"), "turn", "copies", "blank", "open", F.lit(None).cast("string").alias("text"))
    )
    # each text once per conversation and role, at its first turn; later ones are duplicates and need no text
    firsts = (
        base.where((F.col("copies") > 0) & ~blank)
        .groupBy("conv_id", "role", "text")
        .agg(F.min("at").alias("at"))
        .select("conv_id", "at", "role", digest.alias("digest"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("copies"), F.lit(False).alias("blank"), F.lit(False).alias("open"), "text")
    )
    dealt = firsts.unionByName(places).repartitionByRange(*keys).sortWithinPartitions(*keys, "kind")
    cut = persist(dealt.select("conv_id", "turn", "role", "kind", "text", "copies", "blank", "open").mapInArrow(lean(_cutter(texts)), SEGMENTS))
    split = cut.where(F.col("part").isNotNull())
    last_first = split.select("conv_id", "part", "seg", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg"))
    owed = last_first.mapInArrow(_owed, "part int, seg long, after array<long>")
    names = ["conv_id", "part", "seg", "n_rows", *(c.split()[0] for c in FACTS.split(", ")), "turns", "low", "high", "first", "last", "roles", "texts", "times", "shape", "after"]
    known = split.join(owed, ["part", "seg"]).select(*names)
    traced = known.mapInArrow(_traced, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema) + ", ways array<string>, leads array<long>, totals array<long>")
    ordered = traced.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    done = cut.where(F.col("part").isNull()).select(*_DONE.names)
    return done.unionByName(ordered.mapInArrow(lean(_joiner(texts)), DONE))
