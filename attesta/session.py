"""Session helpers: shipping the package to Python workers, and a session for tests and benches."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers, whatever the folder the driver was started in."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="attesta-"), "attesta.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(archive)
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # instants are written and compared in UTC
        _SHIPPED.add(app)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all tasks share: spark.checkpoint.dir, or the folder the session has set.

    Only a session within one process, as in tests, gets one of its own where none is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all tasks share")
        found = tempfile.mkdtemp(prefix="attesta-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written_once(df: DataFrame) -> DataFrame:
    """A table that several later steps read, computed now and kept in the shared folder (a reliable checkpoint: a lost executor loses nothing)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of files for which a shuffle gets a partition.
PART_BYTES = 4 << 20
MOST_PARTS = 20_000


def parts_for(rows: DataFrame) -> int:
    """Partitions that keep a task's share as it is when the files that ``rows`` are read from grow; the session's number at least."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 50)  # others are not known
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-known // PART_BYTES)))


def spread(rows: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """``rows`` dealt by ``keys`` over as many partitions as the input of ``like`` (default: their own) asks for; what is grouped by the keys next moves no more."""
    return rows.repartition(parts_for(rows if like is None else like), *keys)


#: Rows that may be broadcast to every task.
FEW = 1_000_000


def few(rows: DataFrame) -> DataFrame:
    """A table written already, marked for broadcast if it has at most FEW rows, a checked size."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", name: str = "attesta") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
