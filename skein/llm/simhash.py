"""Near-duplicates by SimHash, with pigeonring filtering.

Fingerprints of 64 bits link if they differ in at most TAU bits. The bits are cut into m segments on
a ring. If two fingerprints link, at most TAU segments differ, so they agree in m - TAU of them:
those are the keys by which candidates meet. Stronger, some run of consecutive segments starts
within its proportional budget and stays there: its first k segments differ in at most k * TAU / m
bits, for each k. Candidates without such a chain are pruned before all bits are compared.

Equal fingerprints are one node. Candidates of one key are compared inside a task, which returns
links that span them rather than all pairs; a key with more than GROUP_ROWS fingerprints is split
into blocks, and each two blocks are a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import checkpointed, documents, fresh, map_rows
from skein.llm.graph import components

TAU = 4
SHINGLE = 4
SEED = 42
CHAIN = 3
GROUP_ROWS = 8192
#: Groups up to this size are compared side by side.
SMALL = 16
_STEP = 1 << 16


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE) -> int:
    """64 bits: one is set if it is set in over half of the shingles' XXH64 (A-Z lower-cased; repeats count; no words: 0)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < words_in_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest, n = xxhash.xxh64_intdigest, len(words) - words_in_shingle + 1
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    stops = (ends[words_in_shingle - 1 :] - 1).tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _STEP):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _STEP], stops[at : at + _STEP])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def wide(shingles: np.ndarray, words: int) -> bytes:
    """The fingerprint of a set of 64-bit hashes, which isn't empty, in so many 64-bit words: each word has hashes of its own, mixed from the given ones."""
    ones, offsets = np.zeros(64 * words, dtype=np.int64), np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(shingles), 255):
        h = shingles[at : at + 255, None] + offsets
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        # At most 255 rows, so their sums are bytes.
        ones += np.add.reduce(np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").tobytes()


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """df with out, the whole text's fingerprint as a signed 64-bit number (a null text: 0)."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return map_rows(df, [text_col], f"{out} long", lambda texts: {out: [signed(fingerprint(t)) for t in texts]})


def hexed(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segments(m: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of m segments of 64 bits."""
    cut = [64 * i // m for i in range(m + 1)]
    return [(cut[i], cut[i + 1] - cut[i]) for i in range(m)]


def keys(fps: DataFrame, m: int, tau: int = TAU) -> DataFrame:
    """columns c, v, fp: v holds the bits of m - tau segments of fp; c says which."""
    masks = []
    for chosen in combinations(segments(m), m - tau):
        mask = sum(((1 << bits) - 1) << low for low, bits in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    each = [F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for c, mask in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*each)).alias("k")).select("k.c", "k.v", "fp")


def chained(x: np.ndarray, m: int, tau: int = TAU, chain: int = CHAIN) -> np.ndarray:
    """Whether the differing bits x have a chain: some start whose first k segments differ in at most k * tau / m bits, for k up to chain."""
    d = [np.bitwise_count((x >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int16) for low, bits in segments(m)]
    found = np.zeros(len(x), dtype=bool)
    for i in range(m):
        total = d[i].copy()
        within = total * m <= tau
        for k in range(2, chain + 1):
            total += d[(i + k - 1) % m]
            within &= total * m <= k * tau
        found |= within
    return found


def chained_words(d: np.ndarray, tau: int, chain: int = CHAIN) -> np.ndarray:
    """chained() for fingerprints of several words, which are the segments: d has a row for each pair with the differing bits of each word."""
    m = d.shape[1]
    total, within = np.zeros(d.shape, dtype=np.int32), np.ones(d.shape, dtype=bool)
    for k in range(1, chain + 1):
        total += np.roll(d, 1 - k, axis=1)
        within &= total * m <= k * tau
    return within.any(axis=1)


def near(a: np.ndarray, b: np.ndarray, m: int, tau: int = TAU) -> np.ndarray:
    """Whether two fingerprints differ in at most tau bits: the chains first, then all bits of those that pass."""
    x = a ^ b
    out = chained(x, m, tau)
    i = np.flatnonzero(out)
    out[i] = np.bitwise_count(x[i]) <= tau
    return out


def spanning(f: np.ndarray, m: int, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """Links, fewer than len(f), that connect what all links of f within tau bits connect."""
    left, a, b = np.arange(len(f)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            u = todo.pop()
            hit = near(f[left], f[u], m, tau)
            if hit.any():
                a.append(np.full(int(hit.sum()), u))
                b.append(left[hit])
                todo.extend(left[hit].tolist())
                left = left[~hit]
    if not a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(a), np.concatenate(b)


def _compare(m: int, tau: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(group: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            """group: numbers that rise from group to group."""
            start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            size = np.diff(np.concatenate((start, [len(group)])))
            a, b = [], []
            of = np.repeat(size, size)
            small = np.flatnonzero((of > 1) & (of <= SMALL))
            for s in range(1, SMALL):
                i = small[small + s < len(group)]
                i = i[group[i] == group[i + s]]
                if not len(i):
                    break
                i = i[near(f[i], f[i + s], m, tau)]
                a.append(f[i])
                b.append(f[i + s])
            for at, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
                x, y = spanning(f[at : at + n], m, tau)
                a.append(f[at + x])
                b.append(f[at + y])
            pick = lambda parts: pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64))
            return pa.RecordBatch.from_arrays([pick(a), pick(b)], names=["a", "b"])

        # Rows come sorted by group; the last group of a batch may go on in the next.
        kept: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch[c].to_numpy(zero_copy_only=False) for c in ("c", "v", "i", "j", "fp")]
            kept = now if kept is None else [np.concatenate(p) for p in zip(kept, now)]
            if not len(kept[0]):
                continue
            new = np.zeros(len(kept[0]), dtype=np.int64)
            for x in kept[:4]:
                new[1:] |= x[1:] != x[:-1]
            group = np.cumsum(new)
            full = int(np.searchsorted(group, group[-1]))
            if full:
                yield links(group[:full], kept[4][:full].view(np.uint64))
                kept = [x[full:] for x in kept]
        if kept is not None and len(kept[0]):
            yield links(np.zeros(len(kept[0]), dtype=np.int64), kept[4].view(np.uint64))

    return run


def links(fps: DataFrame, m: int | None = None, tau: int = TAU, group_rows: int = GROUP_ROWS) -> DataFrame:
    """column fp (distinct numbers) to a, b: links within tau bits that connect all that such links connect.

    The result is the same for every m (6 to 9 segments); without one it is chosen by the number
    of fingerprints, so that a key's chance candidates stay few.
    """
    if m is None:
        n = fps.count()
        m = next((m for m in (6, 7, 8) if n <= 1 << (64 * (m - tau) // m)), 9)
    keyed = keys(fps, m, tau)
    hot = checkpointed(keyed.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows))
    one = keyed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    grouped = one
    if hot.limit(1).count():
        # Each fingerprint of a hot key goes to every two blocks of which its own is one.
        blocks = F.ceil(F.col("n") / group_rows).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = keyed.join(hot, ["c", "v"]).withColumn("blocks", blocks).withColumn("own", own)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        split = dealt.select("c", "v", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        grouped = one.join(hot.select("c", "v"), ["c", "v"], "left_anti").unionByName(split)
    placed = grouped.repartition("c", "v", "i", "j").sortWithinPartitions("c", "v", "i", "j")
    return placed.mapInArrow(_compare(m, tau), "a long, b long")


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", m: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """id_col, fp, h (a hash of the row's id and text), component (any number, one for each group), component_id, for each row of df.

    component_id is the smallest id that a row reaches over links, its own included; nulls count
    only where a group has no other id. A null text counts as empty, and texts without words link
    with each other. Repeated rows get equal results.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = checkpointed(fingerprints(rows.withColumn("h", F.xxhash64("id", "text")), "text", "fp").select("id", "h", "fp"))
    nodes = base.groupBy("fp").agg(F.min("id").alias("least"))
    label = checkpointed(components(links(nodes.select("fp"), m, group_rows=group_rows)).withColumnRenamed("node", "fp"))
    joined = nodes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    of_label = nodes.join(label, "fp").groupBy("label").agg(F.min("least").alias("best"))
    # Written, so that both sides of the next join are plain shuffles and Spark can split a fingerprint that very many rows have.
    placed = checkpointed(joined.join(of_label, "label", "left").select("fp", F.col("label").alias("component"), F.coalesce("best", "least").alias("component_id")))
    return base.join(placed, "fp").select(F.col("id").alias(id_col), "fp", "h", "component", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", m: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """The rows of df without near-duplicates: of each group the row with the smallest id stays (of equal ids one).

    found (id_col, h, component) has the groups; without it they are grouped()'s. All columns stay as they are. Texts are read again rather than shuffled; only rows that occur
    more than once, id and text alike, are shuffled to keep one of them.
    """
    found = grouped(df, id_col, text_col, m) if found is None else found
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("h").alias("h"))
    counted = found.groupBy("component", first.alias("row")).agg(F.count(F.lit(1)).alias("n"))
    stays = checkpointed(counted.groupBy("component").agg(F.min(F.struct("row", "n")).alias("s")).select(F.col("s.row.h").alias("__h"), F.col("s.row.id").alias("__id"), F.col("s.n").alias("__n")))
    hashed = fresh(df, "__h", "__id", "__n").withColumn("__h", F.xxhash64(F.col(id_col), F.col(text_col)))
    met = hashed.join(stays, (hashed["__h"] == stays["__h"]) & hashed[id_col].eqNullSafe(stays["__id"])).select(*[hashed[c] for c in hashed.columns], stays["__n"])
    single = met.filter(F.col("__n") == 1)
    repeated = met.filter(F.col("__n") > 1).dropDuplicates(["__h", id_col])
    return single.unionByName(repeated).drop("__h", "__n")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id of its group."""
    found = grouped(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")
