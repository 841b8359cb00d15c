"""Near-duplicates: SimHash and pigeonring chains for candidates, the Jaccard similarity of word shingles for the verdict.

Texts link if their sets of WORDS-word shingles have a similarity of LEAST or more. op6's 64 bits
can't tell such pairs (README has the figures), so fingerprints have BITS bits here, which differ
with a probability of 0.15 at a similarity of 0.8. Candidates meet by agreeing segments: a pair at
0.8 has none of the SEGMENTS segments in common with a probability of 7e-5, one above it with less.
Of those, a pair is kept by the first CHECKED bits, then by pigeonring chains of words and by all
bits; each bound is Z standard deviations from a pair at 0.8. The rest is counted on the whole sets.

Texts with equal sets are one node. A task floods each key's nodes over the first bits, so that nodes
alone in their key go no further and others know the least node they reach there. All meet that one
first, which joins what a large group of copies has in common; after that, every two nodes of a flood
that are still apart are compared, so that no link depends on which node came first. They are compared
in blocks, in tasks. What passes the fingerprints comes out as a row for each node of a block, not for
each pair; these nodes' sets meet once more in their block, where pairs are counted until they are
joined, and only links that join something come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import arrays, broadcast_if_small, checkpointed, lists, map_rows
from skein.llm.graph import components, dealt
from skein.llm.simhash import SMALL, chained_words, wide

WORDS = 5
#: In hundredths.
LEAST = 80
SEGMENTS = 64
SEGMENT_BITS = 12
BITS = SEGMENTS * SEGMENT_BITS
#: Of a fingerprint's bits, so many go with each of its segments.
CHECKED = 128
#: Min-hashes of signature(), an estimate of the similarity itself.
HASHES = 336
SEED = 42
#: Standard deviations by which an estimate may be too low.
Z = 4.5
#: Nodes (8 bytes each) up to which they are broadcast to the texts.
BROADCAST_NODES = 1_000_000
#: Nodes of a key that are compared with as many others in one go.
BLOCK = 512
#: Shingles of a block's nodes on one side (8 bytes each), where a node has no more by itself.
WEIGHT = 1 << 21
_STEP = 1024
_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)


def shingles(text: str | None, words_in_shingle: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the text's shingles (A-Z lower-cased; a shorter text is one shingle; no words: none)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - words_in_shingle + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(words_in_shingle, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), dtype=np.uint64, count=n))


def signature(found: np.ndarray) -> bytes:
    """A byte of each min-hash of a set that isn't empty."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), _STEP):
        np.minimum(least, (found[at : at + _STEP] * _TIMES + _PLUS).min(axis=1), out=least)
    return least.astype(np.uint8).tobytes()


def fewest(least: int) -> int:
    """So many bytes of two signatures are equal if the sets' similarity is at least so many hundredths, but for Z standard deviations."""
    j = least / 100
    return max(0, int(HASHES * j - Z * (HASHES * j * (1 - j)) ** 0.5))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _node(found: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))


def farthest(least: int, bits: int) -> tuple[int, int]:
    """So many of bits bits differ at most if the sets' similarity is at least so many hundredths, but for Z standard deviations: in general, and if a set has under five shingles."""
    j = least / 100
    p = np.arccos(2 * j / (1 + j)) / np.pi
    # Ties of small sets add to it: 0.161 is the most at 0.8 (0.1515 in the limit), 0.1875 for four of five shingles.
    return tuple(int(bits * q + Z * (bits * q * (1 - q)) ** 0.5) for q in (1.07 * p, 1.24 * p))


def _words(fps: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return np.frombuffer(b"".join(fps.to_pylist()), dtype="<u8").reshape(-1, BITS // 64)


def segments(words: np.ndarray) -> np.ndarray:
    """Each fingerprint's segments."""
    b = words.view(np.uint8).reshape(len(words), SEGMENTS // 2, 3).astype(np.int32)
    return np.stack([b[:, :, 0] | (b[:, :, 1] & 15) << 8, b[:, :, 1] >> 4 | b[:, :, 2] << 4], axis=2).reshape(len(words), SEGMENTS)


def _alike(x: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Whether fingerprints with the differing bits x (rows of words) may be of sets of that similarity, the lesser of which has so many shingles: chains of words first, then all bits."""
    d, (most, most_small) = np.bitwise_count(x), farthest(least, BITS)
    out = chained_words(d, most_small)
    i = np.flatnonzero(out)
    i = i[(sizes[i] < 5) | chained_words(d[i], most)]
    out[:] = False
    out[i] = d[i].sum(axis=1) <= np.where(sizes[i] < 5, most_small, most)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, size, fp to a row for each segment: its number and bits as key, and the first bits of fp."""
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            own = batch.slice(at, _STEP)
            fp = _words(own["fp"])
            key = segments(fp) + (np.arange(SEGMENTS, dtype=np.int32) << SEGMENT_BITS)
            again = [np.repeat(x, SEGMENTS) for x in (own["node"].to_numpy(), own["size"].to_numpy().astype(np.int32), fp[:, 0].view(np.int64), fp[:, 1].view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.ravel(), *again)], names=["key", "node", "size", "x", "y"])


def _flood(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """_keyed() rows in the order of key and node to the nodes that reach another one of their key, with the least node that they reach.

    A large group is as many steps as it has nodes that no earlier one is near to, each linear in it.
    """
    most, most_small = farthest(least, CHECKED)

    def links(key: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def near(i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
            differ = np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j])
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            return (differ <= np.where(low < 5, most_small, most)) & (100 * low >= least * high)

        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        rows = np.diff(np.concatenate((start, [len(key)])))
        left = np.flatnonzero((of := np.repeat(rows, rows)) <= SMALL)
        a, b = [], []
        for s in range(1, SMALL):
            left = left[left + s < len(key)]
            left = left[key[left] == key[left + s]]
            if not len(left):
                break
            i = left[near(left, left + s)]
            a.append(i)
            b.append(i + s)
        for at in np.flatnonzero((of > SMALL) & (np.arange(len(key)) == np.repeat(start, rows))).tolist():
            rest = np.arange(at, at + of[at])
            while len(rest):
                todo, rest = [rest[0]], rest[1:]
                while todo and len(rest):
                    u = todo.pop()
                    if (hit := near(rest, u)).any():
                        a.append(np.full(int(hit.sum()), u))
                        b.append(rest[hit])
                        todo.extend(b[-1].tolist())
                        rest = rest[~hit]
        return (np.concatenate(a), np.concatenate(b)) if a else (start[:0], start[:0])

    def reached(key: np.ndarray, node: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        a, b = links(key, size, x, y)
        top = np.arange(len(key))
        while (top[a] != top[b]).any():
            m = np.minimum(top[a], top[b])
            np.minimum.at(top, a, m)
            np.minimum.at(top, b, m)
        i = np.unique(np.concatenate((a, b)))
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (key[i], node[top[i]], size[top[i]], node[i], size[i])], names=["key", "top", "top_size", "node", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last key of a batch may go on in the next.
        kept: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch[c].to_numpy(zero_copy_only=False) for c in ("key", "node", "size", "x", "y")]
            now[3:] = (v.view(np.uint64) for v in now[3:])
            kept = now if kept is None else [np.concatenate(v) for v in zip(kept, now)]
            full = int(np.searchsorted(kept[0], kept[0][-1])) if len(kept[0]) else 0
            if full:
                yield reached(*(v[:full] for v in kept))
                kept = [v[full:] for v in kept]
        if kept is not None and len(kept[0]):
            yield reached(*kept)

    return run


def likely(pairs: DataFrame, fingerprints: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs (a, b, size of the lesser) whose fingerprints (node, fp) are alike enough for least hundredths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _alike(_words(batch["x"]) ^ _words(batch["y"]), batch["size"].to_numpy(), least)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep))

    of = lambda node, fp: fingerprints.select(F.col("node").alias(node), F.col("fp").alias(fp))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "size", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs (a, b) whose sets (node, words array<long>) have a similarity of least hundredths or more."""
    of = lambda node, words: sets.select(F.col("node").alias(node), F.col("words").alias(words))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("both"))
    return both.filter(100 * F.col("both") >= least * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of key, i, j as one table for each such block."""
    waiting: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            now = tuple(at[:, start].tolist())
            if waiting and now != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(start, stop - start))
            last = now
    if waiting:
        yield pa.Table.from_batches(waiting)


_ASKED = "key long, i int, j int, node long, partners array<long>"


def _compare(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks to the nodes that have a partner in them, one row each: side 0 lists its partners on side 1.

    Partners are in different components, alike in size and in fingerprint, and have no lower segment in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            band, side, node, size, component, major = (block[c].to_numpy() for c in ("band", "side", "node", "size", "component", "major"))
            fp = _words(block["fp"])
            segment = segments(fp)
            v = np.flatnonzero(side == 1)
            found: dict[int, np.ndarray] = {}
            for u in np.flatnonzero(side == 0):
                # Of two nodes outside the largest component each is on either side: the lesser one asks.
                w = v[(component[v] != component[u]) & (major[v] | (node[v] > node[u])) & (100 * np.minimum(size[v], size[u]) >= least * np.maximum(size[v], size[u]))]
                w = w[_alike(fp[w] ^ fp[u], np.minimum(size[w], size[u]), least)]
                if len(w):
                    found[int(node[u])] = node[w[(segment[w] == segment[u]).argmax(axis=1) == band[0]]]
            found = {u: w for u, w in found.items() if len(w)}
            if not found:
                continue
            nodes = np.unique(np.concatenate([np.fromiter(found, np.int64, len(found)), *found.values()]))
            at = [np.full(len(nodes), block[c][0].as_py(), t) for c, t in (("key", np.int64), ("i", np.int32), ("j", np.int32))]
            none = nodes[:0]
            yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(nodes), lists([found.get(n, none) for n in nodes.tolist()], "int64")], names=["key", "i", "j", "node", "partners"])

    return run


def parted(placed: DataFrame, block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """The rows of keys with several components, with major (is it in the key's largest one?) and the number of blocks of its other nodes (rows) and of all (cols).

    placed has key, node, size, component and more. All that a key's rows need to know of it comes by one join, of written tables, whose keys Spark can split.
    """
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    keys = parts.groupBy("key").agg(F.max(F.struct("n", "component", "s")).alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    blocks = lambda n, s: F.greatest(F.ceil(n / block), F.ceil(s / weight), F.lit(1)).cast("int")
    n, s, most = F.col("n"), F.col("s"), F.col("most")
    cut = checkpointed(keys.filter("parts > 1").select("key", most["component"].alias("largest"), blocks(n - most["n"], s - most["s"]).alias("rows"), blocks(n, s).alias("cols")))
    return placed.join(cut, "key").withColumn("major", F.col("component") == F.col("largest")).drop("largest")


def compared(apart: DataFrame, least: int = LEAST) -> DataFrame:
    """key, i, j, node, partners: in each block of a key, the nodes of likely pairs that are apart; the lesser side lists its partners.

    apart has key, band, node, size, component, fp, and parted()'s columns.
    A key's nodes outside its largest component meet all its nodes, block by block, so that a key
    with very many nodes is many tasks, and blocks have few nodes where sets are large. A node is one
    row of a block, however many partners it has there.
    """
    own = lambda of: F.pmod(F.xxhash64("node"), of).cast("int")
    kept = ["key", "band", "node", "size", "component", "major", "fp"]
    asks = apart.filter(~F.col("major")).select(*kept, own(F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(0).alias("side"))
    asked = apart.select(*kept, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), own(F.col("cols")).alias("j"), F.lit(1).alias("side"))
    dealt = asks.unionByName(asked).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return dealt.mapInArrow(_compare(least), _ASKED)


def _settle(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with whole sets to links that join what its pairs of that similarity join: what a block has joined already isn't counted again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            node = block["node"].to_pylist()
            words = dict(zip(node, (x.view(np.uint64) for chunk in block["words"].chunks for x in arrays(chunk))))
            up = {c: c for c in block["component"].to_pylist()}
            of = dict(zip(node, block["component"].to_pylist()))

            def top(c: int) -> int:
                while up[c] != c:
                    up[c] = c = up[up[c]]
                return c

            links: list[tuple[int, int]] = []
            partners = (x for chunk in block["partners"].chunks for x in arrays(chunk))
            for u, asked in zip(node, partners):
                x = words[u]
                for v in asked.tolist():
                    a, b, y = top(of[u]), top(of[v]), words[v]
                    if a == b:
                        continue
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * both >= least * (len(x) + len(y) - both):
                        links.append((u, v))
                        up[a] = b
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def settled(asked: DataFrame, label: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """a, b: links of least hundredths or more that join what all such pairs of compared()'s blocks join. label has node, component; sets node, words (sorted as unsigned numbers)."""
    rows = asked.join(label.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    dealt = rows.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_settle(least), "a long, b long")


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = WORDS, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """id_col, h (a hash of the row's id and text), component (any number, one for each group), for each row of df.

    A group is what links reach. A null text counts as empty, and texts without words link with each other.
    """

    def signed(texts: list[str | None]) -> dict[str, list]:
        found = [shingles(t, words_in_shingle) for t in texts]
        return {"node": [_node(x) for x in found], "size": [len(x) for x in found], "fp": [wide(x, BITS // 64) if len(x) else None for x in found], "text": [None] * len(texts)}

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("id", "text"))
    base = checkpointed(map_rows(rows, ["text"], "node long, size long, fp binary, text string", signed).drop("text"))
    once = checkpointed(base.filter("fp is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp")))
    keyed = once.mapInArrow(_keyed, "key int, node long, size int, x long, y long").repartition("key").sortWithinPartitions("key", "node")
    flooded = keyed.mapInArrow(_flood(least), "key int, top long, top_size int, node long, size int")
    met = dealt(checkpointed(flooded.select(F.xxhash64("key", "top").alias("key"), F.shiftright("key", SEGMENT_BITS).alias("band"), "node", F.col("size").cast("long").alias("size"), "top", "top_size")))
    lesser = F.least("size", "top_size")
    first = met.filter("node <> top").filter(100 * lesser >= least * F.greatest("size", "top_size")).select(F.col("top").alias("a"), F.col("node").alias("b"), lesser.cast("long").alias("size")).distinct()
    first = dealt(checkpointed(likely(first, once, least)))

    def sets(nodes: DataFrame) -> DataFrame:
        needed = broadcast_if_small(nodes.distinct(), F.lit(1), BROADCAST_NODES)
        of = base.join(needed, "node").groupBy("node").agg(F.min("h").alias("h"))
        texts = rows.join(broadcast_if_small(of, F.lit(2), BROADCAST_NODES), "h")
        made = map_rows(texts.select("node", "text"), ["text"], "words array<long>, text string", lambda t: {"words": lists([shingles(x, words_in_shingle) for x in t], "int64"), "text": [None] * len(t)})
        return checkpointed(made.drop("text").dropDuplicates(["node"]))

    links = dealt(checkpointed(verified(first, sets(first.select(F.explode(F.array("a", "b")).alias("node"))), least)))
    label = dealt(checkpointed(components(links, small=True))).withColumnRenamed("label", "component")
    # Fingerprints come with the labels, one row for each node, so that no later join makes a row for each node of a key.
    told = once.select("node", "fp").join(label, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("component"))
    placed = dealt(checkpointed(met.join(told, "node", "left").select("key", "band", "node", "size", "component", "fp")))
    asked = dealt(checkpointed(compared(dealt(checkpointed(parted(placed, block))), least)))
    if asked.limit(1).count():
        more = settled(asked, label, sets(asked.select("node")), least)
        label = dealt(checkpointed(components(dealt(checkpointed(links.union(more))), small=True))).withColumnRenamed("label", "component")
    return base.select("id", "h", "node").join(label, "node", "left").select(F.col("id").alias(id_col), "h", F.coalesce("component", "node").alias("component"))
