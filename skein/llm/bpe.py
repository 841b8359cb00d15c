"""Byte-level BPE encoding and decoding of whole texts.

A text longer than chunk_chars becomes chunks that overlap. Tasks cut the chunks into pre-tokens
independently; a chunk that begins inside a pre-token is wrong only until a boundary of its own
meets one of the chunk before it. The first boundary that both have in their overlap is where the
chunks are joined; then each chunk's part is encoded, and the ids are put in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import arrays, documents, lists, slices
from skein.llm.tokens import encoder, pieces

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: A boundary is sure only if so many characters follow it in the chunk: "'l" may go on to "'ll".
SEEN_AHEAD = 3



def _encode_whole(df: DataFrame, path: str) -> DataFrame:
    """columns id, text to id, ids."""
    schema = T.StructType([df.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in slices(batches):
            found = lists([encode(t or "") for t in b["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([b["id"], found], names=["id", "ids"])

    return df.select("id", "text").mapInArrow(run, schema)


def _chunks(df: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """columns row, id, text to row, id, k, n, text: chunk k of n, with the overlap that follows it."""
    schema = T.StructType([df.schema["row"], df.schema["id"], *T._parse_datatype_string("k int, n int, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            text = b["text"][0].as_py()
            n = -(-len(text) // chunk)
            for at in range(0, n, 64):
                ks = range(at, min(n, at + 64))
                own = pa.array([0] * len(ks), pa.int32())
                parts = pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in ks])
                yield pa.RecordBatch.from_arrays([b["row"].take(own), b["id"].take(own), pa.array(ks, pa.int32()), pa.array([n] * len(ks), pa.int32()), parts], names=["row", "id", "k", "n", "text"])

    return df.select("row", "id", "text").mapInArrow(run, schema)


def _boundaries(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Adds head and tail: pre-token boundaries in the overlap with the chunk before and after, as places in the whole text."""
    schema = T.StructType([*chunks.schema.fields, *T._parse_datatype_string("head array<bigint>, tail array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = pa.list_(pa.int64())
        for b in slices(batches, 32):
            head, tail = [], []
            for k, text in zip(b["k"].to_pylist(), b["text"].to_pylist()):
                at = k * chunk
                starts = [0, *accumulate(map(len, pieces(text)))]
                head.append([at + x for x in starts if x < overlap])
                tail.append([at + x for x in starts if chunk <= x <= len(text) - SEEN_AHEAD])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, places), pa.array(tail, places)], names=[*b.schema.names, "head", "tail"])

    return chunks.mapInArrow(run, schema)


def _encode_parts(df: DataFrame, path: str, chunk: int) -> DataFrame:
    """columns row, id, k, text, first, last (places in the whole text; last null: to the end) to row, id, k, ids."""
    schema = T.StructType([df.schema["row"], df.schema["id"], *T._parse_datatype_string("k int, ids array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in slices(batches, 32):
            ids = []
            for k, text, first, last in zip(*(b[c].to_pylist() for c in ("k", "text", "first", "last"))):
                at = k * chunk
                ids.append(own.encode_pieces(pieces(text[first - at : None if last is None else last - at])))
            yield pa.RecordBatch.from_arrays([b["row"], b["id"], b["k"], lists(ids)], names=["row", "id", "k", "ids"])

    return df.select("row", "id", "k", "text", "first", "last").mapInArrow(run, schema)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """A row for each row of df, repeated ones too: id_col and ids array<int> of the whole text by the rank file at path.

    A null text is encoded as an empty one: no ids. Other columns don't matter and are not returned.
    A long text with no common boundary in some overlap, such as one endless word, is encoded whole.
    """
    if not 0 < overlap_chars <= chunk_chars:
        raise ValueError("the overlap must be from 1 to chunk_chars")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    long = rows.filter(is_long).withColumn("row", F.monotonically_increasing_id())
    cut = _boundaries(_chunks(long, chunk_chars, overlap_chars).repartition("row", "k"), chunk_chars, overlap_chars)
    of_text = Window.partitionBy("row")
    in_order = of_text.orderBy("k")
    cut = cut.withColumn("last", F.array_min(F.array_intersect("tail", F.lead("head").over(in_order)))).drop("head", "tail")
    cut = cut.withColumn("first", F.coalesce(F.lag("last").over(in_order), F.lit(0).cast("long")))
    cut = cut.withColumn("joined", ~F.max(F.col("last").isNull() & (F.col("k") < F.col("n") - 1)).over(of_text))
    # The parts are encoded, or, where chunks could not be joined, the text is put together again.
    parts = _encode_parts(cut.filter("joined"), path, chunk_chars)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c])
    joined = parts.groupBy("row").agg(F.first("id").alias("id"), F.flatten(ordered("ids")).alias("ids")).drop("row")
    apart = cut.filter(~F.col("joined")).withColumn("own", F.substring("text", 1, chunk_chars))
    whole = apart.groupBy("row").agg(F.first("id").alias("id"), F.array_join(ordered("own"), "").alias("text")).drop("row")
    out = _encode_whole(rows.filter(~is_long), path).unionByName(joined).unionByName(_encode_whole(whole, path))
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the binary column out: the raw bytes of the ids, concatenated (null or no ids: no bytes)."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in slices(batches):
            found = pa.array([own.decode(ids) for ids in arrays(b[ids_col])], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by the multilingual ranks, and the bytes that they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = decode(encode(documents(spark, sf_dir), path), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
