"""Token counts by separator scan.

A flat token file is one run of token ids with an end-of-document id after each document and no
index. It is read in blocks; in each, a vectorised search finds the end ids. A document that goes on
in the next block is stitched by a prefix scan over the blocks' summaries, which are a few numbers
each: how many ends a block has, and how many ids follow its last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.llm.common import checkpointed, documents, map_rows, slices
from skein.llm.tokens import encoder

END_ID = 50_256
BLOCK_BYTES = 1 << 20
#: Bytes of a file that one task reads.
TASK_BYTES = 1 << 27


def scan(blocks: DataFrame, end_id: int = END_ID, id_bytes: int = 2) -> DataFrame:
    """columns file, block, data (binary: little-endian unsigned ids of id_bytes bytes) and any others to ends array<long>, n long instead of data.

    ends are the places of end ids among the block's n ids. Blocks without data (null or empty) have none.
    """
    kind = f"<u{id_bytes}"

    def found(data: list[bytes | None]) -> dict[str, list]:
        ids = [np.frombuffer(x or b"", dtype=kind) for x in data]
        return {"ends": [np.flatnonzero(x == end_id) for x in ids], "n": [len(x) for x in ids], "data": [None] * len(data)}

    return map_rows(blocks, ["data"], "ends array<long>, n long, data binary", found, rows=16).drop("data")


def counted(scanned: DataFrame) -> DataFrame:
    """file, doc (from 0, in the file's order), start, n_tokens (with its end id) of each document, from scan()'s rows.

    The ids after a file's last end, if any, are a document without an end. Empty blocks don't
    matter; two end ids in a row are a document of one id. Block numbers must rise along a file and
    be unique in it. The prefix scan is a window over summaries; places stay in their rows.
    """
    ordered = Window.partitionBy("file").orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    placed = scanned.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.withColumns({
        "doc0": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
        "open": F.coalesce(F.max(F.col("at") + last + 1).over(before), F.lit(0)),  # where the document begins that is open at this block
        "final": F.lead("block").over(ordered).isNull(),
    })
    stops = F.transform("ends", lambda x: F.col("at") + x + 1)
    stops = F.when(F.col("final") & (F.col("at") + F.col("n") > F.coalesce(F.col("at") + last + 1, F.col("open"))), F.concat(stops, F.array(F.col("at") + F.col("n")))).otherwise(stops)
    each = placed.select("file", "doc0", "open", stops.alias("stops"))
    starts = F.concat(F.array(F.col("open")), F.slice("stops", 1, F.greatest(F.size("stops") - 1, F.lit(0))))
    docs = each.filter(F.size("stops") > 0).select("file", "doc0", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("stops").alias("stop"))).alias("k", "d"))
    return docs.select("file", (F.col("doc0") + F.col("k")).alias("doc"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"))


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    stop: int


class FlatTokens(DataSource):
    """Flat token files as blocks: file, block, data. Each task reads a range of bytes of one file, so that a file may have any size.

    Options: block_bytes, task_bytes (a multiple of it). Paths are those that pyarrow's file systems open.
    """

    @classmethod
    def name(cls) -> str:
        return "flat_tokens"

    def schema(self) -> str:
        return "file string, block long, data binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FlatReader(self.options)


class _FlatReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.block = options["path"], int(options["block_bytes"])
        self.task = max(1, int(options["task_bytes"]) // self.block) * self.block

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        return [_Range(p, at, min(at + self.task, n)) for p, n in files for at in range(0, n, self.task)]

    def read(self, part: _Range) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(part.file) as f:
            for at in range(part.start, part.stop, self.block):
                f.seek(at)
                yield part.file, at // self.block, f.read(min(self.block, part.stop - at))


def flat_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """file, block, data of the flat token files at path (a file, or a folder and what is below it), range by range. block_bytes must be a multiple of an id's bytes."""
    spark.dataSource.register(FlatTokens)
    return spark.read.format("flat_tokens").option("block_bytes", block_bytes).option("task_bytes", task_bytes).load(path)


def written(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each task's texts as one flat file of unsigned 16-bit ids: file, block, data, ids.

    ids are the id_col values of the documents that end in the block, in order; the data don't hold
    them. A text's ids are by the rank file at path, which must have fewer than 65,536; end_id
    follows each. A null text has no ids but its end. Repeated rows are documents of their own.
    """
    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, np.array([end_id], dtype="<u2").tobytes()
        file, block, buffer, ids = f"{TaskContext.get().partitionId():08d}", 0, bytearray(), []

        def out(data: bytes, ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "data", "ids"])

        for b in slices(batches, 64):
            for doc, text in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                buffer += encode(text or "").astype("<u2").tobytes() + end
                while len(buffer) > block_bytes:
                    yield out(bytes(buffer[:block_bytes]), ids)
                    del buffer[:block_bytes]
                    block, ids = block + 1, []
                ids.append(doc)
        if buffer:
            yield out(bytes(buffer), ids)

    return given.mapInArrow(run, "file string, block long, data binary, ids array<long>")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids (its end included) in flat streams of all documents, as the scan of these finds them.

    Which stream a document is in, and where, depends on how Spark splits the table, and is not in the result.
    """
    blocks = written(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    scanned = checkpointed(scan(blocks))  # a few numbers for each document
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    named = scanned.select("file", "block", "ids").withColumn("doc0", F.coalesce(F.sum(F.size("ids")).over(order), F.lit(0)))
    named = named.select("file", "doc0", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("doc0") + F.col("k")).alias("doc"), "doc_id")
    return counted(scanned).join(named, ["file", "doc"]).select("doc_id", "n_tokens")
