import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import graph, simhash


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    """Smallest number of each group of fingerprints, by union-find over all pairs."""
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def clustered(seed, n):
    rng = random.Random(seed)
    fps = []
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(n // 8):
            x = base
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps += [rng.getrandbits(64) for _ in range(n // 8)] + [0, 1, (1 << 64) - 1]
    x = rng.getrandbits(64)
    for k in range(12):  # a long path: each step four bits further
        fps.append(x)
        for b in range(4):
            x ^= 1 << ((k * 4 + b) * 5 % 64)
    return sorted(set(fps), key=lambda _: rng.random())


def test_fingerprints(spark, odd, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd.filter("doc_id is null or doc_id <> 5").select("doc_id", "text"))
    for r in simhash.fingerprints(docs, out="fp").withColumn("x", simhash.hexed(F.col("fp"))).collect():
        assert r["x"] == f"{plain_fingerprint(r['text']):016x}"


def test_true_pairs_always_have_a_chain():
    rng = np.random.default_rng(3)
    for m in (6, 7, 8, 9):
        for chain in (1, 3, m):
            bits = [rng.choice(64, size=rng.integers(0, 5), replace=False) for _ in range(3000)]
            x = np.array([sum(1 << int(b) for b in p) for p in bits], dtype=np.uint64)
            assert simhash.chained(x, m, chain=chain).all()
        far = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
        assert simhash.chained(far, m).mean() < 0.2


@pytest.mark.parametrize("m,group_rows", [(6, 8192), (6, 8), (7, 8192), (8, 5), (9, 100), (None, 8192)])
def test_groups_against_all_pairs(spark, m, group_rows):
    fps = clustered(m or 1, 400)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = graph.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), m, group_rows=group_rows))
    label = {r["node"]: r["label"] for r in found.collect()}
    got = {}
    for i, x in enumerate(signed):
        got.setdefault(label.get(x, x), set()).add(i)
    want = {}
    for i, g in enumerate(plain_groups(fps)):
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_spanning_keeps_links_few():
    f = np.array([1 << i for i in range(60)], dtype=np.uint64)
    a, b = simhash.spanning(f, 6)
    assert len(a) == 59 and set(a) | set(b) == set(range(60))


def test_op6_against_all_pairs(spark, sf_dir):
    docs = sorted((r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    groups = plain_groups([x for _, x in docs])
    got = sorted(map(tuple, simhash.op6_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == [(d, f"{x:016x}", docs[g][0]) for (d, x), g in zip(docs, groups)]


def test_one_of_each(odd, none):
    left = simhash.one_of_each(odd)
    assert left.columns == odd.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["text"] or "")) for r in left.collect())
    groups = {r["component"]: r["component_id"] for r in simhash.grouped(odd).collect()}
    assert len(got) == len(groups)
    assert [g[1] for g in got].count(1) == 2  # the repeated row once, the other text of that id
    assert simhash.one_of_each(none).count() == 0 and simhash.grouped(none).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 999), (999, 1000), (5000, 5000)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 999, 999: 999}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
