import random

import numpy as np
import pytest

from skein.llm import jaccard


def plain_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    sets, up = [plain_sets(t) for t in texts], list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def planted(seed):
    """Copies with words changed here and there (some over the threshold, some under), a chain of them, one large group, and odd texts."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def changed(words, n):
        words = list(words)
        for i in rng.sample(range(len(words)), n):
            words[i] = f"w{rng.randrange(10**6)}"
        return words

    texts = []
    for n in (40, 120, 400):
        for _ in range(8):
            base = fresh(n)
            texts += [base] + [changed(base, k) for k in (1, n // 60 + 1, n // 45 + 1, n // 30 + 1, n // 10)]
    step = fresh(200)
    for _ in range(12):
        texts.append(step)
        step = fresh(18) + step[:-18]
    hot = fresh(150)
    texts += [changed(hot, rng.randrange(1, 6)) for _ in range(60)]
    texts = [" ".join(t) for t in texts] + ["", None, " \n", "one two", "One  TWO", "one three"]
    rng.shuffle(texts)
    return texts


def test_the_pipeline_drops_planted_near_copies(spark):
    import corpus_pipeline

    texts = planted(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = plain_groups(texts)
    assert len(set(groups)) < len(texts) - 60
    left = corpus_pipeline.dedup_documents(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in left) == sorted(set(groups))


def test_groups_of_odd_rows(odd, none):
    rows = odd.collect()
    got = jaccard.grouped(odd).collect()
    assert len(got) == len(rows) and jaccard.grouped(none).count() == 0


@pytest.mark.parametrize("block", [3, 16, 512])
def test_blocks_find_what_all_pairs_find(spark, block):
    """Many texts around one original, most of them under the threshold to each other, in keys of many blocks."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]

    def changed(n):
        words = list(base)
        for i in rng.sample(range(len(words)), n):
            words[i] = f"w{rng.randrange(10**6)}"
        return " ".join(words)

    texts = [changed(rng.randrange(0, 9)) for _ in range(150)]
    got = {r["doc_id"]: r["component"] for r in jaccard.grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).collect()}
    want = plain_groups(texts)
    assert len(set(want)) > 3
    same = {}
    assert all(same.setdefault(got[k], g) == g for k, g in enumerate(want)) and len(set(got.values())) == len(set(want))


def test_estimates_keep_what_is_alike():
    rng = random.Random(2)
    least = jaccard.fewest(80)
    for n in (5, 50, 500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        a = jaccard.shingles(" ".join(words))
        b = jaccard.shingles(" ".join(words[: len(words) - max(1, n // 6)]))
        x, y = (np.frombuffer(jaccard.signature(s), dtype=np.uint8) for s in (a, b))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (x == y).sum() >= least if j >= 0.8 else True
        assert abs((x == y).mean() - j) < 0.1
    assert 0.65 < least / jaccard.HASHES < 0.75


def test_fingerprints_and_chains_keep_what_is_alike():
    """near_dedup's candidates are SimHash's: bits differ by the angle between sets, and no pair within the bound lacks a chain."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = (np.frombuffer(jaccard.wide(s, jaccard.BITS // 64), dtype="<u8")[None] for s in (x[:900], x[100:]))
    differ = int(np.bitwise_count(a ^ b).sum())
    most, _ = jaccard.farthest(80, jaccard.BITS)
    assert abs(differ / jaccard.BITS - np.arccos(8 / 9) / np.pi) < 0.06 and differ <= most < 0.25 * jaccard.BITS
    assert jaccard.segments(a).shape == (1, jaccard.SEGMENTS) and (jaccard.segments(a) == jaccard.segments(b)).any()
    d = rng.multinomial(most, rng.dirichlet(np.ones(12), 500))
    assert jaccard.chained_words(d, most).all() and not jaccard.chained_words(d * 0 + 32, most).any()


def test_a_key_s_rows_meet_its_figures_in_one_join(spark):
    """compared() joins nothing: on tables with large groups of near copies each join by key is a row for each node of a key."""
    fp = bytes(jaccard.BITS // 8)
    rows = [(1, 0, 10, 100, 5, fp), (1, 0, 11, 100, 5, fp), (1, 0, 12, 40, 6, fp), (1, 0, 13, 100, 7, fp), (2, 0, 14, 100, 8, fp), (2, 0, 15, 100, 8, fp)]
    placed = spark.createDataFrame(rows, "key long, band int, node long, size long, component long, fp binary")
    apart = jaccard.parted(placed, block=1, weight=200)
    assert {(r["node"], r["major"], r["rows"], r["cols"]) for r in apart.collect()} == {(10, True, 2, 4), (11, True, 2, 4), (12, False, 2, 4), (13, False, 2, 4)}
    assert "Join" not in jaccard.compared(apart.localCheckpoint())._jdf.queryExecution().toString()
    asked = jaccard.compared(apart.localCheckpoint()).collect()
    assert sorted((r["node"], v) for r in asked for v in r["partners"]) == [(13, 10), (13, 11)]


def test_rounds_of_few_links_write_few_files(spark):
    """Components of links that fit in a task: a round is no file for each shuffle partition."""
    from pathlib import Path

    from skein.llm.graph import components

    links = spark.createDataFrame([(k, k + 1) for k in range(0, 40) if k % 10 != 9], "a long, b long")
    before, at = (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")), spark.sparkContext.getCheckpointDir()
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = lambda: sum(1 for _ in Path(at.removeprefix("file:")).rglob("part-*"))
    had = files()
    try:
        got = {r["node"]: r["label"] for r in components(links, small=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == {k: k // 10 * 10 for k in range(40)}
    assert files() - had < 2 * 30
