"""What several text operators share: cutting lineage, and Arrow batches in and out of tasks."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Separates words: space and U+0009 to U+000D, and nothing else.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Rows that a Python step turns into objects at a time.
SLICE_ROWS = 256
#: And bytes, if there is more than one.
SLICE_BYTES = 8 << 20


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
    """df written to the shared checkpoint folder, so that later steps read it and lost executors don't matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and bytes (or one row), which bounds a task's Python objects."""
    waiting = (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
    for b in waiting:
        parts = [b]
        while parts:
            x = parts.pop()
            if x.num_rows > 1 and x.nbytes > most:
                half = x.num_rows // 2
                parts += [x.slice(half), x.slice(0, half)]
            else:
                yield x


def lists(arrays: list[np.ndarray], dtype: str = "int32") -> pa.ListArray:
    """Arrays as one Arrow list column, without going through Python objects."""
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(arrays).view(dtype) if arrays else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """An Arrow list column as arrays; null is empty."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for k, valid in enumerate(column.is_valid().to_pylist()):
        yield flat[offsets[k] : offsets[k + 1]] if valid else flat[:0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents."""
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names (in any case), which an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def map_rows(df: DataFrame, inputs: list[str], out: str, fn: Callable[..., dict[str, list]], rows: int = SLICE_ROWS) -> DataFrame:
    """df with the columns that out (a DDL string) names, as fn makes them from lists of the inputs' values.

    Existing columns of those names are replaced unless they are inputs as well. Arrow batches in
    and out of tasks; fn sees at most so many rows at a time.
    """
    added = T._parse_datatype_string(out).fields
    kept = fresh(df, *[f.name for f in added if f.name not in inputs])
    passed = [f for f in kept.schema.fields if f.name not in {a.name for a in added}]
    schema = T.StructType([*passed, *added])
    types = {f.name: to_arrow_type(f.dataType) for f in added}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            made = fn(*[b[c].to_pylist() for c in inputs])
            yield pa.RecordBatch.from_arrays([*(b[f.name] for f in passed), *(made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], types[f.name]) for f in added)], names=schema.names)

    return kept.mapInArrow(run, schema)


def broadcast_if_small(df: DataFrame, size: Column, most: int) -> DataFrame:
    """df, written to the checkpoint folder, with a broadcast hint if the sum of size over its rows is at most most; else without, and joins shuffle."""
    kept = checkpointed(df)
    total = kept.agg(F.sum(size).alias("n")).first()["n"] or 0
    return F.broadcast(kept) if total <= most else kept
