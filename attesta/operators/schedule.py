"""Schedules: validated entries, wall-clock occurrences and what is due."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.dates import as_utc, occurrence

ENTRY = "producer string, every double, at string, zone string, enabled boolean"


@dataclass(frozen=True)
class Entry:
    producer: str
    every: float | None = None
    at: str | None = None
    zone: str | None = None
    enabled: bool = True


def check_every(value: object) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not 0 < value < float("inf"):
        raise ValueError(f"an interval is a positive number of seconds, not {value!r}")
    return float(value)


def check_at(value: object) -> str:
    """HH:MM[:SS] without an offset, as HH:MM:SS."""
    if not isinstance(value, str) or not (found := re.fullmatch(r"([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?", value)):
        raise ValueError(f"a time of day is HH:MM or HH:MM:SS, not {value!r}")
    return f"{found[1]}:{found[2]}:{found[3] or '00'}"


def check_zone(value: object) -> str:
    try:
        if not isinstance(value, str) or not value:
            raise ValueError
        ZoneInfo(value)
    except Exception:
        raise ValueError(f"not a time zone: {value!r}") from None
    return value


@lru_cache(maxsize=64)
def _offsets(zone: str) -> tuple:
    info, day = ZoneInfo(zone), datetime(1970, 1, 1, 12, tzinfo=UTC)
    return tuple((day + timedelta(days=n)).astimezone(info).utcoffset() for n in range((date(2040, 1, 1) - date(1970, 1, 1)).days))


def zones_agree(a: str, b: str) -> bool:
    """Same name, or the same offset on every day from 1970 to 2040."""
    return a == b or _offsets(a) == _offsets(b)


def resolve_entries(declared: Mapping[str, Mapping], overrides: Mapping[str, Mapping], deployment_zone: str | None = None) -> dict[str, Entry]:
    """Entry of each producer: an override replaces the declared timing as a whole.

    A producer has an interval or a time with a zone, not both. Unknown names or keys, a missing schedule and a zone
    that disagrees with the deployment's raise ValueError.
    """
    if unknown := sorted(set(overrides) - set(declared)):
        raise ValueError(f"unknown producers: {', '.join(unknown)}")
    out = {}
    for name, own in sorted(declared.items()):
        given = dict(overrides.get(name, {}))
        if extra := sorted(set(given) - {"every", "at", "zone", "enabled"}):
            raise ValueError(f"{name}: unknown keys {', '.join(extra)}")
        enabled = given.get("enabled", own.get("enabled", True))
        if not isinstance(enabled, bool):
            raise ValueError(f"{name}: enabled is true or false")
        timing = given if given.keys() & {"every", "at"} else {**{k: own[k] for k in ("every", "at", "zone") if k in own}, **{k: given[k] for k in ("zone",) if k in given}}
        if ("every" in timing) == ("at" in timing):
            raise ValueError(f"{name}: needs an interval or a time of day, not both")
        if "every" in timing:
            if "zone" in timing:
                raise ValueError(f"{name}: an interval has no zone")
            out[name] = Entry(name, every=check_every(timing["every"]), enabled=enabled)
            continue
        zone = check_zone(timing.get("zone", deployment_zone))
        if deployment_zone and not zones_agree(zone, check_zone(deployment_zone)):
            raise ValueError(f"{name}: zone {zone} is not the deployment's {deployment_zone}")
        out[name] = Entry(name, at=check_at(timing["at"]), zone=zone, enabled=enabled)
    return out


def entries_table(spark: SparkSession, entries: Mapping[str, Entry]) -> DataFrame:
    return spark.createDataFrame([(e.producer, e.every, e.at, e.zone, e.enabled) for e in entries.values()], ENTRY)


def occurrences(now: Column, at: Column, zone: Column) -> Column:
    """UTC instants of a time of day from two days before ``now`` to two days after."""
    day = F.to_date(F.from_utc_timestamp(now, zone))
    wall = lambda d: F.to_utc_timestamp(F.to_timestamp_ntz(F.concat_ws(" ", d.cast("string"), at), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp"), zone)
    return F.transform(F.sequence(F.date_sub(day, 2), F.date_add(day, 2)), wall)


def previous_occurrence(now: Column, at: Column, zone: Column) -> Column:
    return F.array_max(F.filter(occurrences(now, at, zone), lambda t: t <= now))


def next_occurrence(now: Column, at: Column, zone: Column) -> Column:
    return F.array_min(F.filter(occurrences(now, at, zone), lambda t: t > now))


def due(entries: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Entries with due and reason. ``runs``: (producer, at), at as ISO text; each entry gets exactly one reason.

    A stated time is owed once if the last run lies before its latest occurrence; an interval is due from
    last + every on. Never run, a malformed last run and one in the future are due.
    """
    rows = entries.join(runs.select("producer", F.col("at").alias("last_text")), "producer", "left").withColumn("last", as_utc(F.col("last_text")))
    last, at = F.col("last"), F.col("at")
    ripe = F.when(at.isNotNull(), last < previous_occurrence(now, at, F.col("zone"))).otherwise(now >= F.timestamp_micros((F.unix_micros(last) + F.col("every") * 1_000_000).cast("long")))
    reason = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("last_text").isNull(), "never run")
        .when(last.isNull(), "malformed last run")
        .when(last > now, "last run in the future")
        .when(ripe, "due")
        .otherwise("not yet")
    )
    return rows.withColumn("reason", reason).withColumn("due", ~F.col("reason").isin("disabled", "not yet")).select(*entries.columns, "last", "due", "reason")


def tick(due_rows: DataFrame, running: DataFrame, capacity: DataFrame) -> DataFrame:
    """What a tick starts: due producers that are not running, in name order, while their cost class has room.

    ``running``: (producer, cost); ``capacity``: (cost, room, all costs present); due_rows carry cost.
    """
    from pyspark.sql import Window

    free = due_rows.where("due").join(running.select("producer"), "producer", "left_anti")
    used = running.groupBy("cost").agg(F.count(F.lit(1)).alias("used"))
    ranked = free.join(capacity, "cost").join(used, "cost", "left").withColumn("place", F.row_number().over(Window.partitionBy("cost").orderBy("producer")))
    return ranked.withColumn("starts", F.col("room").isNull() | (F.col("place") + F.coalesce("used", F.lit(0)) <= F.col("room"))).select("producer", "cost", "starts")


__all__ = ["Entry", "check_at", "check_every", "check_zone", "due", "entries_table", "next_occurrence", "occurrence", "occurrences", "previous_occurrence", "resolve_entries", "tick", "zones_agree"]
