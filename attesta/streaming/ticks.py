"""The scheduler's tick as keyed state: each producer's last run is kept between ticks, so a tick reads no run log.

An appointment is owed once, however many of its times were missed; an interval counts from the last run; a last run in the future is no
reason to wait. Each answer is what schedule.due gives for the same entry, last run and time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame

OUT = "producer string, now timestamp, due boolean, reason string"
STATE = "last_micros long, known boolean"
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def previous(now: datetime, at: str, zone: str) -> datetime:
    """The latest instant, not after ``now``, of a time of day: the first reading of a repeated hour, pushed past a missing one."""
    info = ZoneInfo(zone)
    day = now.astimezone(info).date()
    found = []
    for k in range(-2, 3):
        wall = datetime.combine(day + timedelta(days=k), datetime.strptime(at, "%H:%M:%S").time(), info)
        found.append(wall.astimezone(UTC))
    return max(t for t in found if t <= now)


def answer(now: datetime, last: datetime | None, every: float | None, at: str | None, zone: str | None, enabled: bool) -> str:
    """Why a producer is due, or not, at a time."""
    if not enabled:
        return "disabled"
    if last is None:
        return "never run"
    if last > now:
        return "last run in the future"
    ripe = last < previous(now, at, zone) if at is not None else now >= last + timedelta(seconds=every)
    return "due" if ripe else "not yet"


def ticks_due(ticks: DataFrame) -> DataFrame:
    """(producer, now, due, reason) for a stream of (producer, every, at, zone, enabled, now): a producer that is due counts as run then.

    Ticks of one batch are taken by time. The state is one instant for each producer.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = None
        if state.exists:
            micros, known = state.get
            last = _EPOCH + timedelta(microseconds=int(micros)) if known else None
        rows = pd.concat(list(batches)).sort_values("now")
        out = []
        for r in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            now = pd.Timestamp(r["now"])
            now = (now.tz_localize(UTC) if now.tzinfo is None else now.tz_convert(UTC)).to_pydatetime()
            why = answer(now, last, r["every"], r["at"], r["zone"], bool(r["enabled"]))
            is_due = why not in ("disabled", "not yet")
            if is_due:
                last = now
            out.append((key[0], now.replace(tzinfo=None), is_due, why))
        state.update((0 if last is None else (last - _EPOCH) // timedelta(microseconds=1), last is not None))
        yield pd.DataFrame(out, columns=["producer", "now", "due", "reason"])

    return ticks.groupBy("producer").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")
