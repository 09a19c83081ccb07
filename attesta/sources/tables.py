"""Schemas of library tables, and reads and snapshot writes of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

NAMED = "struct<id: string, name: string>"
SCHEMAS = {
    "scene": f"id string, title string, date string, files array<struct<basename: string, path: string>>, studio {NAMED}, performers array<{NAMED}>, tags array<{NAMED}>, organized boolean",
    "tag": "id string, name string, aliases array<string>, description string, scene_count bigint",
    "performer": "id string, name string, stash_ids array<struct<endpoint: string, stash_id: string>>, image_path string, details string, disambiguation string, piercings string, tattoos string, eye_color string, country string, gender string, measurements string, career_length string, birthdate string, ethnicity string, alias_list array<string>, urls array<string>, height_cm int",
    "candidate": "store string, query string, title string, code string, details string, director string, urls array<string>, url string, date string, image string, studio struct<stored_id: string, name: string>, tags array<struct<stored_id: string, name: string>>, performers array<struct<stored_id: string, name: string>>",
    "fingerprint_match": "endpoint string, scene_id string, remote_site_id string, fingerprints array<struct<algorithm: string, hash: string>>",
}


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of a table, with its stated schema; malformed rows fail the read."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(path)


def unorganized(scenes: DataFrame) -> DataFrame:
    return scenes.where("not organized")


def tagged(scenes: DataFrame, tag_id: str) -> DataFrame:
    from pyspark.sql import functions as F

    return scenes.where(F.exists("tags", lambda t: t["id"] == tag_id))


def lookup(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id): the entity of that name, trimmed and in lower case, else the first with that alias."""
    from attesta.operators.changes import find_or_create
    from pyspark.sql import functions as F

    return find_or_create(names.select("name", F.lit(None).cast("string").alias("stored_id")), entities).where("not created").select("name", "id")


def write_snapshot(df: DataFrame, folder: str) -> str:
    """Writes a whole table to a new folder below ``folder`` and returns it; readers switch by taking that path."""
    path = f"{folder.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path
