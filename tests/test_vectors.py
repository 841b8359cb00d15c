import numpy as np
import pytest

from skein.operators import vectors


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x[7] = x[6]  # a tie
    x[9] = 0
    return x, spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))] + [(5000, None)], "vec_id long, embedding array<float>").repartition(5)


def test_search_against_brute_force(spark, rows):
    x, df = rows
    books = vectors.train(df, fit_rows=2000)
    index = vectors.encoded(df, books)
    assert index.count() == len(x) and len(index.first()["code"]) == vectors.PARTS
    queries = df.filter("vec_id % 100 = 0").selectExpr("vec_id as query", "embedding as vector")
    got = {}
    for r in vectors.search(df, index, books, queries).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    hits = 0
    for q in range(0, 4000, 100):
        score = np.round((unit @ unit[q]).astype(float), 6)
        true = np.lexsort((np.arange(len(x)), -score))[:10].tolist()
        hits += len(set(true) & {i for i, _ in got[q]})
        assert got[q][0] == (q, pytest.approx(1, abs=1e-5)) and all(abs(s - score[i]) < 1e-5 for i, s in got[q])
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert hits / 400 >= 0.95
    r = vectors.gate(df, vectors.search(df, index, books, queries), queries).first()
    assert r["queries"] == 40 and abs(r["recall"] - hits / 400) < 0.01 and r["read_share"] < 0.1 and r["promoted"]
    assert not vectors.gate(df, vectors.search(df, index, books, queries, pool=1), queries, pool=1).first()["promoted"]


def test_queries_in_blocks_and_odd_rows(spark, rows, monkeypatch):
    x, df = rows
    books = vectors.train(df, fit_rows=500)
    index = vectors.encoded(df, books)
    queries = spark.createDataFrame([(6, x[6].tolist()), (-1, None), (8, x[8].tolist()), (9, [0.0] * 32)], "query long, vector array<float>")
    whole = sorted(map(tuple, vectors.search(df, index, books, queries).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 1)
    assert sorted(map(tuple, vectors.search(df, index, books, queries).collect())) == whole
    assert [r[1] for r in sorted(whole, key=lambda r: (r[0], r[3])) if r[0] == 6][:2] == [6, 7] and {r[0] for r in whole} == {6, 8, 9}
    none = df.limit(0)
    blank = vectors.train(none)
    assert vectors.search(none, vectors.encoded(none, blank), blank, queries).count() == 0 and vectors.search(df, index, books, queries.limit(0)).count() == 0
