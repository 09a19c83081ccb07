"""Conversation repair against a plain search over (row, state), whatever the cuts."""

from __future__ import annotations

import hashlib
import random
import re
from zlib import crc32

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from attesta.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, copies string, part int"
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAME = {"u": "user", "a": "assistant"}


def damage(rows):
    out, convs = [], {}
    for c, t, role, text in rows:
        convs.setdefault(c, [])
        fate = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub(r"[.!?]", "", text)
        if fate == 4:
            role = "user"
        convs[c] += [(t, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return convs


def plain(convs):
    for c, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in rows:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        best = {(0, 0): (0, "", ())}
        for i in range(len(rows) + 1):
            for _ in range(3):  # inserts
                for q in range(4):
                    if (i, q) in best:
                        cost, audit, lines = best[i, q]
                        for r in "ua":
                            if (q, r) in STEPS:
                                k = i, STEPS[q, r]
                                best[k] = min(best.get(k, (9**9, "", ())), (cost + 3, audit + "I", (*lines, NAME[r] + ":")))
            if i == len(rows):
                break
            for q in range(4):
                if (i, q) in best:
                    cost, audit, lines = best[i, q]
                    _, role, text = rows[i]
                    more = 3 * (faults[i] == "truncated")
                    ways = [(q, cost + 4, audit + "D", lines)]
                    if faults[i] not in ("blank", "duplicate"):
                        if (q, role[:1]) in STEPS:
                            ways.append((STEPS[q, role[:1]], cost + more, audit + "K", (*lines, f"{role}:{text}")))
                        ways += [(STEPS[q, r], cost + 3 + more, audit + "R", (*lines, f"{NAME[r]}:{text}")) for r in "ua" if (q, r) in STEPS]
                    for to, *way in ways:
                        best[i + 1, to] = min(best.get((i + 1, to), (9**9, "", ())), tuple(way))
        cost, audit, lines = min(best[len(rows), q] for q in (0, 3) if (len(rows), q) in best)
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        yield c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha, "\n".join(lines)


def conversations_(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "User", "tool"])
            text = rng.choice(["Yes.", "No!", "why?", "cut off", "a. b", "", None, " \t\n", "Fine. ", "é?", f"n{rng.randrange(999)}."])
            rows.append((c, None if rng.random() < 0.1 else t + rng.randrange(2) * rng.randrange(3), role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def repaired(df):
    found = conversations.repaired(conversations.damaged(df), copies="copies", texts=True).collect()
    return sorted((tuple(r) for r in found), key=str)


@pytest.mark.parametrize(("segment", "piece"), [(4096, 64), (5, 2), (1, 1)])
def test_repair_agrees_with_a_plain_search(spark, monkeypatch, segment, piece):
    # what is cut where is read on the driver, so other sizes reach the workers with the functions
    rows = conversations_(3, 60, 12) + [(900, k // 3, random.Random(k).choice(["user", "assistant"]), f"t{k % 40}.") for k in range(150)]
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(conversations, "PIECE", piece)
    with_sizes = conversations._cutter

    def cutter(texts):
        cut = with_sizes(texts)

        def run(batches):
            conversations.SEGMENT, conversations.PIECE = segment, piece
            yield from cut(batches)

        return run

    monkeypatch.setattr(conversations, "_cutter", cutter)
    assert repaired(frame(spark, rows)) == sorted(plain(damage(rows)), key=str)


def test_pieces_give_what_whole_rows_give(monkeypatch):
    rng = random.Random(7)
    for _ in range(150):
        shape = "".join(rng.choice("sua-") + rng.choice("--o") for _ in range(rng.randrange(1, 30)))
        monkeypatch.setattr(conversations, "PIECE", 64)
        whole = conversations.edits(shape)
        monkeypatch.setattr(conversations, "PIECE", rng.randrange(1, 6))
        assert conversations.edits(shape) == whole
        cut = 2 * rng.randrange(len(shape) // 2 + 1)
        left, right = conversations.costs(shape[:cut]), conversations.costs(shape[cut:])
        ways = [x + y + conversations.END[f] for m in range(4) for f in range(4) if (x := left[0][m]) is not None and (y := right[m][f]) is not None]
        assert min(ways) == whole[0]


def test_one_conversation_over_many_tasks_and_hot_rows(spark):
    hot = [(5, k, ["user", "assistant"][k % 3 % 2], f"text {k}.") for k in range(700)] + [(5, 900, "user", "again.")] * 300
    rows = hot + [(k, 0, "user", "hello.") for k in range(50) if k != 5]
    df = frame(spark, rows).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repaired(df) == sorted(plain(damage(rows)), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_statement(spark, tmp_path):
    rows = conversations_(11, 80, 14)
    pq.write_table(pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}), tmp_path / "conversations.parquet")
    got = sorted((tuple(r) for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
        assert got == sorted(c.execute(queries.oracle_sql()["op11_conversation_repair"]).fetchall(), key=str)


def test_dropped_empty_and_missing(spark):
    gone = next(c for c in range(10_000) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(frame(spark, [(gone, 0, "user", "a.")])) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), "")]
    assert repaired(frame(spark, [])) == []


def test_long_rows_cost_linear_time():
    import time

    start = time.time()
    cost, audit, _ = conversations.edits("u-" * 20_000)
    assert cost == 30_000 and len(audit) == 20_000 and time.time() - start < 20
