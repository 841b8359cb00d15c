"""Cutting lineage, and tables that a session writes once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STORED: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only where a local session names none (as in a test) is it a new temporary one; on a cluster
    that is an error, as a machine's own folder is lost with the machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder as a table and read from it.

    For loops: a checkpoint keeps what its plan's filters and joins say of the columns, and in a loop
    that joins a table with itself this doubles from round to round; a table that is read says nothing.
    """
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def stored(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build makes of files, written to the shared folder when an application first asks for it and read after that.

    It is made again once a file of sources (paths) has another time or length.
    """
    files = [spark.read.format("binaryFile").load(p).select("path", "modificationTime", "length") for p in sources]
    seen = files[0]
    for more in files[1:]:
        seen = seen.union(more)
    state = seen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")).alias("h")).first()
    key = (spark.sparkContext.applicationId, name, tuple(sources), state["n"], state["h"])
    if key not in _STORED:
        at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(at)
        _STORED[key] = at
    return spark.read.parquet(_STORED[key])


def shuffled(df: DataFrame) -> DataFrame:
    """df with a hint that a join deals it out by its key, for sides that grow with the input.

    Spark guesses such a side's size from compressed files and knows neither how many rows a text
    makes nor what a checkpoint holds, so it would send large tables through the driver.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, most: int, size: Column | None = None) -> DataFrame:
    """df, written to the shared folder, with a broadcast hint if it has at most so many rows (or sum of size); else without, and joins shuffle."""
    kept = checkpointed(df)
    n = kept.count() if size is None else kept.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(kept) if n <= most else kept
