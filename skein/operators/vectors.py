"""A product-quantised vector index: codebooks from a bounded sample, codes for every row, exact rerank.

A vector is cut into parts, and each part is replaced by the nearest of up to 256 centroids, a byte.
A query is compared with codes by a table of its products with all centroids (asymmetric: the query
itself is not quantised). The best of these by code, a small share of all rows, are compared exactly.
Lists of near vectors alone would not do here: embeddings without clusters spread a query's
neighbours over most lists, while codes rank all rows at a sixteenth of the bytes.

Queries go through in blocks of a bounded size that each task holds; rows are never paired with
rows, a task returns its best for each query only, and those are joined with the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.lineage import checkpointed
from skein.operators.search import dot
from skein.sources.tables import table

#: Rows that codebooks are fitted on, drawn by a hash of their ids.
FIT_ROWS = 20_000
PARTS = 16
CENTROIDS = 256
ROUNDS = 8
#: Rows compared exactly, for each row asked for.
POOL = 30
#: Queries that a task holds at a time, and rows it scores against them at a time.
QUERY_BLOCK = 512
ROW_BLOCK = 2048


@dataclass(frozen=True)
class Codebooks:
    """centroids: part, centroid, place; unit: vectors are scaled to length one (cosine) before they are coded."""

    centroids: np.ndarray
    unit: bool

    def prepared(self, x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(x.astype(np.float32))
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if self.unit else x

    def parts(self, x: np.ndarray) -> np.ndarray:
        """part, row, place of prepared vectors, cut or filled with zeros to the codebooks' length."""
        p, _, d = self.centroids.shape
        out = np.zeros((len(x), p * d), dtype=np.float32)
        out[:, : min(x.shape[1], p * d)] = x[:, : p * d]
        return out.reshape(len(x), p, d).transpose(1, 0, 2)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(v, c) for v, c in zip(self.parts(self.prepared(x)), self.centroids)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """part, centroid, query: products of the queries' parts with the centroids."""
        return np.einsum("pcd,pqd->pcq", self.centroids, self.parts(self.prepared(queries)))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid to each row; of equals the first."""
    return (2 * x @ centroids.T - (centroids**2).sum(axis=1)).argmax(axis=1)


def fit(sample: np.ndarray, unit: bool = True, parts: int = PARTS, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks by k-means of each part, from the first distinct rows of the sample."""
    d = -(-sample.shape[1] // parts) if sample.size else 1
    blank = Codebooks(np.zeros((parts, 1, d), dtype=np.float32), unit)
    if not len(sample):
        return blank
    k = min(centroids, len(sample))
    books = np.zeros((parts, k, d), dtype=np.float32)
    for p, x in enumerate(blank.parts(blank.prepared(sample))):
        c = x[:k].copy()
        for _ in range(rounds):
            near = nearest(x, c)
            n = np.bincount(near, minlength=k)
            sums = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(d)], axis=1)
            c[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
        books[p] = c
    return Codebooks(books, unit)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix as wide as its longest row; null and what is missing is 0."""
    rows = [np.asarray(x if x is not None else [], dtype=np.float32) for x in column.to_numpy(zero_copy_only=False)]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0) or 1), dtype=np.float32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", unit: bool = True, fit_rows: int = FIT_ROWS) -> Codebooks:
    """Codebooks from the fit_rows rows with the smallest hash of their ids."""
    rows = vectors.filter(F.col(vector_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(id_col).cast("string").alias("i"), F.col(vector_col).cast("array<float>").alias("x")).orderBy("h", "i").limit(fit_rows)
    return fit(_matrix(rows.select("x").toArrow()["x"].combine_chunks()), unit)


def encoded(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, code (a byte for each part) of every row with a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROW_BLOCK):
                x = b.slice(at, ROW_BLOCK)
                codes = books.codes(_matrix(x["x"]))
                yield pa.RecordBatch.from_arrays([x["id"], pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "code"])

    rows = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("x"))
    return rows.mapInArrow(run, "id long, code binary")


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """For each column the rows with the greatest scores, of equals those with the least ids: row numbers, most by columns."""
    k = min(most, len(ids))
    order = np.argsort(ids, kind="stable")
    s = scores[order]
    cut = np.partition(s, len(s) - k, axis=0)[len(s) - k] if k < len(s) else None
    top = np.empty((k, s.shape[1]), dtype=np.int64)
    for q in range(s.shape[1]):
        near = np.flatnonzero(s[:, q] >= cut[q]) if cut is not None else np.arange(len(s))
        top[:, q] = order[near[np.argsort(-s[near, q], kind="stable")[:k]]]
    return top


def pooled(index: DataFrame, books: Codebooks, query_ids: np.ndarray, queries: np.ndarray, most: int) -> DataFrame:
    """query, id, rank of the most rows best by code for each query; queries is one block."""
    tables = books.tables(queries).astype(np.float32)
    shared = index.sparkSession.sparkContext.broadcast((query_ids, tables))  # QUERY_BLOCK queries: 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, t = shared.value
        ids, best = np.zeros((0, len(names)), dtype=np.int64), np.zeros((0, len(names)), dtype=np.float32)
        for b in batches:
            for at in range(0, b.num_rows, ROW_BLOCK):
                x = b.slice(at, ROW_BLOCK)
                code = np.frombuffer(b"".join(x["code"].to_pylist()), dtype=np.uint8).reshape(x.num_rows, -1)
                own = x["id"].to_numpy()
                score = sum(t[p, code[:, p]] for p in range(code.shape[1]))
                top = _best(score, own, most)
                ids, best = np.concatenate((ids, own[top])), np.concatenate((best, np.take_along_axis(score, top, axis=0)))
                keep = np.stack([np.lexsort((ids[:, q], -best[:, q]))[:most] for q in range(len(names))], axis=1)
                ids, best = np.take_along_axis(ids, keep, axis=0), np.take_along_axis(best, keep, axis=0)
        if len(ids):
            yield pa.RecordBatch.from_pydict({"query": np.repeat(names, len(ids)), "id": ids.T.ravel(), "score": best.T.ravel().astype(np.float64)})

    found = index.select("id", "code").mapInArrow(run, "query long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= most).select("query", "id", "rank")


def search(vectors: DataFrame, index: DataFrame, books: Codebooks, queries: DataFrame, top_k: int = 10, pool: int = POOL, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """query, id, score, rank: of each query (query, vector) the top_k rows by exact cosine (or product) among the top_k * pool best by code.

    Queries go through QUERY_BLOCK at a time, by their hash, so memory does not grow with them. Ties
    go to the lesser id. A query without a vector, or an index without rows, has no rows.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    own = checkpointed(queries.filter(F.col("vector").isNotNull()).select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<float>").alias("vector")))
    out = None
    for k in range(blocks):
        got = own.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).orderBy("query").toArrow()
        for at in range(0, got.num_rows, QUERY_BLOCK):
            part = got.slice(at, QUERY_BLOCK).combine_chunks()
            p = pooled(index, books, part["query"].to_numpy(), _matrix(part["vector"].combine_chunks()), top_k * pool)
            p = checkpointed(p)
            out = p if out is None else out.unionByName(p)
    if out is None:
        return own.select("query", F.col("query").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("x"))
    norm = lambda v: F.sqrt(dot(v, v))
    size = norm(F.col("x")) * norm(F.col("vector")) if books.unit else F.lit(1.0)
    exact = out.join(rows, "id").join(own, "query").select("query", "id", F.round(F.coalesce(dot(F.col("x"), F.col("vector")) / F.nullif(size, F.lit(0.0)), F.lit(0.0)), digits).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))  # top_k * pool rows at most
    return exact.withColumn("rank", place).filter(F.col("rank") <= top_k)


def gate(vectors: DataFrame, found: DataFrame, queries: DataFrame, top_k: int = 10, pool: int = POOL, floor: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """queries, recall, read_share, promoted: recall of found (search()) against exact comparison with every row, and the share of vectors compared exactly.

    The exact ones are found like the others, with codes replaced by the vectors themselves: tasks score blocks of rows against blocks of queries.
    """
    own = checkpointed(queries.filter(F.col("vector").isNotNull()).select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<float>").alias("vector")))
    n = vectors.filter(F.col(vector_col).isNotNull()).count()
    blocks = max(1, -(-own.count() // QUERY_BLOCK))
    true = None
    for k in range(blocks):
        got = own.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).orderBy("query").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        books = Codebooks(np.zeros((1, 1, 1), dtype=np.float32), True)
        shared = vectors.sparkSession.sparkContext.broadcast((got["query"].to_numpy(), books.prepared(_matrix(got["vector"].combine_chunks()))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, books=books) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for b in batches:
                for at in range(0, b.num_rows, ROW_BLOCK):
                    x = b.slice(at, ROW_BLOCK)
                    ids, m = x["id"].to_numpy(), books.prepared(_matrix(x["x"]))
                    wide = min(m.shape[1], q.shape[1])
                    score = np.round((m[:, :wide] @ q[:, :wide].T).astype(np.float64), digits)
                    top = _best(score, ids, top_k)
                    yield pa.RecordBatch.from_pydict({"query": np.repeat(names, len(top)), "id": ids[top].T.ravel(), "score": np.take_along_axis(score, top, axis=0).T.ravel()})

        rows = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("x"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        part = checkpointed(rows.mapInArrow(run, "query long, id long, score double").withColumn("rank", place).filter(F.col("rank") <= top_k).select("query", "id"))
        true = part if true is None else true.unionByName(part)
    hit = (true if true is not None else found.select("query", "id").limit(0)).join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    rate = hit.agg(F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"), F.countDistinct("query").alias("queries"))
    return rate.select("queries", "recall", F.lit(round(min(1.0, top_k * pool / max(n, 1)), 4)).alias("read_share"), F.coalesce(F.col("recall") >= floor, F.lit(False)).alias("promoted"))


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    books = train(vectors)
    index = checkpointed(encoded(vectors, books))
    return vectors, _queries(vectors), search(vectors, index, books, _queries(vectors))


def r20_index_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against exact comparison, for every query; the pool is under a tenth of the vectors from 3,000 rows on."""
    vectors, queries, found = _indexed(spark, sf_dir)
    return gate(vectors, checkpointed(found), queries)


QUERIES = {
    "r10_indexed": lambda spark, d: _indexed(spark, d)[2],
    "r20_index_gate": r20_index_gate,
}
ORACLE_SQL: dict[str, str] = {}
