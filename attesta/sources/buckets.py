"""A keyed table as a bucketed snapshot: a batch rewrites the buckets it touches and nothing else.

    items = BucketedTable(spark, folder, store.SCHEMAS["item"], key="fingerprint", buckets=1024)
    items.merge(proposals, lambda rows, batch: store.record(rows, batch, dismissals, mutes), transaction=("scan", 17))

Rows lie in buckets by range of their key's hash, one folder of Parquet files for a bucket and the version that wrote it. A
*manifest*, a JSON file named by its version, lists each bucket's folder. A version is made by writing the touched buckets to new
folders, then the manifest under a name of its own, which is moved to its final name if no one else has taken that: readers see
the old table or the new one, never a part. A writer that dies leaves files that no manifest names; two writers of the same version
can't both win, and the loser starts again from the newer version. A transaction (application, number) is kept in the manifest,
so a batch that is replayed after its commit changes nothing. ``vacuum`` removes what the last manifests do not name.

A function given to ``merge`` sees the rows of the touched buckets only and must keep each row's key, which holds for every
transition of operators.store. Keys are hashed unless ``hex_key`` says that they are hexadecimal digests, whose ranges are even.

On object stores a move is no atomic step; there the version's name has to be taken by a conditional put, which this class leaves
to the file system (``_publish``). One process vacuums at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Change = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer took the version."""


class BucketedTable:
    #: Seconds after which a version that was taken but never published counts as left by a writer that died.
    STALE = 600.0

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "fingerprint", buckets: int = 1024, hex_key: bool = False):
        self.spark, self.folder, self.key, self.hex_key = spark, folder.rstrip("/"), key, hex_key
        self.schema = T._parse_datatype_string(schema)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._utils = jvm.org.apache.commons.io.IOUtils
        self.buckets = self.manifest()["buckets"] if self.version() >= 0 else buckets

    # Manifests

    def _versions(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The newest version; -1 before the first."""
        return max(self._versions(), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v < 0:
            return {"version": -1, "buckets": self.buckets, "folders": {}, "transactions": {}}
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{v:010d}.json"))
        try:
            return json.loads(self._utils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Makes ``manifest`` the table's next version, or raises ``Conflict``."""
        at = f"{self.folder}/manifests"
        self._fs.mkdirs(self._path(at))
        part, final = self._path(f"{at}/.{uuid.uuid4().hex}"), self._path(f"{at}/{manifest['version']:010d}.json")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # taking the name is what decides between writers: a lock file is made only where there is none
        lock = self._path(f"{at}/{manifest['version']:010d}.taken")
        if self._fs.exists(lock) and not self._fs.exists(final) and time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000 > self.STALE:
            self._fs.delete(lock, False)
        try:
            self._fs.create(lock, False).close()
            taken = True
        except Exception:
            taken = False
        if not taken or self._fs.exists(final) or not self._fs.rename(part, final):
            self._fs.delete(part, False)
            raise Conflict(f"version {manifest['version']} is taken")

    # Rows

    def bucket(self, key: Column) -> Column:
        """Bucket of a key: a range of its digest's first 32 bits, or of its hash."""
        if self.hex_key:
            return F.floor(F.coalesce(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(0)) * self.buckets / (1 << 32)).cast("int")
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, as of a version."""
        folders = self.manifest(version)["folders"]
        wanted = [f for b, f in folders.items() if buckets is None or int(b) in set(buckets)]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{f}" for f in wanted])

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of some keys: at most as many values as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(self.key))).distinct().collect())

    def merge(self, batch: DataFrame, change: Change, transaction: tuple[str, int] | None = None, keys: DataFrame | None = None, attempts: int = 3) -> dict | None:
        """Applies ``change(rows of the touched buckets, batch)`` as one new version; gives its manifest, or None for a replayed transaction.

        ``keys``: the keys that the change may touch (default: those of the batch).
        """
        for left in range(attempts - 1, -1, -1):
            before = self.manifest()
            if transaction and before["transactions"].get(transaction[0], -1) >= transaction[1]:
                return None
            hit = self.touched(batch if keys is None else keys)
            try:
                return self._replace(before, hit, change(self.read(before["version"], hit), batch), transaction)
            except Conflict:
                if not left:
                    raise
        raise AssertionError("unreachable")

    def _replace(self, before: dict, hit: list[int], rows: DataFrame, transaction: tuple[str, int] | None) -> dict:
        version = before["version"] + 1
        home = f"data/{version:010d}-{uuid.uuid4().hex[:12]}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        made = rows.select(*columns, self.bucket(F.col(self.key)).alias("__bucket"))
        # every row of a bucket to one task's file, whatever the number of buckets
        made.repartition(max(1, min(len(hit), 4096)), "__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{home}")
        at = self._path(f"{self.folder}/{home}")
        there = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("__bucket=")}
        if strays := there - set(hit):
            raise ValueError(f"the change moved rows to other buckets: {sorted(strays)[:5]}")
        folders = {b: f for b, f in before["folders"].items() if int(b) not in set(hit)} | {str(b): f"{home}/__bucket={b}" for b in sorted(there)}
        done = {"version": version, "buckets": self.buckets, "folders": folders, "transactions": before["transactions"] | ({transaction[0]: transaction[1]} if transaction else {}), "rewritten": len(hit)}
        self._publish(done)
        return done

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but the last ``keep``, and data folders that none of these names; gives the number of folders removed."""
        versions = self._versions()
        for v in versions[:-keep]:
            for end in ("json", "taken"):
                self._fs.delete(self._path(f"{self.folder}/manifests/{v:010d}.{end}"), False)
        named = {f.rsplit("/", 1)[0] for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        alive = {f for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = 0
        at = self._path(f"{self.folder}/data")
        for s in self._fs.listStatus(at) if self._fs.exists(at) else ():
            home = f"data/{s.getPath().getName()}"
            if home not in named:
                self._fs.delete(s.getPath(), True)
                gone += 1
                continue
            for b in self._fs.listStatus(s.getPath()):  # buckets that later versions have rewritten
                if b.isDirectory() and f"{home}/{b.getPath().getName()}" not in alive:
                    self._fs.delete(b.getPath(), True)
                    gone += 1
        return gone


def merge_by_subject(table: BucketedTable, subjects: DataFrame, change: Change, transaction: tuple[str, int] | None = None) -> dict | None:
    """``merge`` for a change keyed by subject: only the buckets that hold items of these subjects are rewritten."""
    own = subjects.select("subject_type", "subject_id").distinct()
    keys = table.read().join(own, ["subject_type", "subject_id"], "left_semi").select(table.key)
    return table.merge(subjects, change, transaction, keys)
