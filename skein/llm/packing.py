"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest as fit,
then the binary digits of the rest. A piece is a sequence by itself, so no sequence crosses
documents and none needs padding; sequences of one length form a bucket, and sequence ids are given
by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import documents, slices
from skein.llm.tokens import encoder

MAX_TOKENS = 1024
END_ID = 0


def cuts(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: lengths fall and each is a power of two, at most longest."""
    out = [(at, longest) for at in range(0, n - longest + 1, longest)]
    at, size = len(out) * longest, longest >> 1
    while size:
        if n - at >= size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each row's text: id_col, start, length, ids binary, doc_tokens, sequence_id, offset, bucket.

    ids holds little-endian unsigned 32-bit token ids, as loaders read them; the text's ids by the
    file at path (tokens.Encoder says how) are followed by end_id. start
    counts the ids before the piece in its document, doc_tokens all of the document's; bucket is
    log2(length), and sequence_id, unique, is in ranges by bucket. offset is 0 throughout. A null
    or empty text is one piece of one id. Each row of df is a document of its own, repeated rows and
    null ids too; df's other columns don't matter and are not returned. longest must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    given = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([given.schema["id"], *T._parse_datatype_string("start long, length long, ids binary, doc_tokens long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, np.array([end_id], dtype="<u4").tobytes()
        for b in slices(batches, 128):
            row, start, length, ids, total = [], [], [], [], []
            for k, text in enumerate(b["text"].to_pylist()):
                flat = encode(text or "").astype("<u4", copy=False).tobytes() + end
                n = len(flat) // 4
                for at, size in cuts(n, longest):
                    row.append(k)
                    start.append(at)
                    length.append(size)
                    ids.append(flat[4 * at : 4 * (at + size)])
                    total.append(n)
            columns = [b["id"].take(pa.array(row, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    pieces = given.mapInArrow(run, schema).withColumn("bucket", F.log2("length").cast("int"))
    # A row's place in its task fits in 56 bits; the bucket goes above it.
    numbered = pieces.withColumn("sequence_id", F.shiftleft(F.col("bucket").cast("long"), 56) + F.monotonically_increasing_id())
    return numbered.select(F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "bucket")


def write(packed: DataFrame, path: str) -> None:
    """Writes pieces so that those of one length lie together: a folder for each bucket."""
    packed.write.partitionBy("bucket").parquet(path)


def digests(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pieces with their ids as a checksum."""
    return packed.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces."""
    return digests(pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
