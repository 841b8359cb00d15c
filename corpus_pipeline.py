"""The corpus pipeline: quality classifier, quality rules, line deduplication, near-duplicates, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import jaccard, lines, packing, quality, rules, simhash
from skein.llm.common import fresh, shared_folder, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(fresh(docs, "__score"), field, out="__score")
    return scored.filter(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; unlike op7, a short text is no reason by itself."""
    return rules.cascade(docs, "text", rules=rules.FILTERS, kept="__kept", by="__by").filter("__kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines of templates that an earlier one has; n_chars follows the text.

    A document that would lose more than half of its characters is a copy, which the next stage
    judges by its whole text; it stays as it is.
    """
    left = lines.deduplicated(docs, most=50)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else left


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts with four fifths of their five-word shingles in common."""
    return simhash.one_of_each(docs, found=jaccard.grouped(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, as training sequences."""
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("quality_rules", judge),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("packing", pack),
]

#: A trained field decides in the first stage, and token ids come out of the last: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; each one's result is written to the shared checkpoint folder and read by the next."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made.write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
