import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import bpe, eod, packing, tokens
from tests.llm.conftest import prose

JSON, END = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference(path):
    import base64

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD_TEXTS = ["", " ", "  a  \n\n b ", "it's  they'll 'S", "a\x1cb \x1c c", "x\u0085\u0085 z\r\n\r\n  ", "naïve 12 3.4—x ☃ 中文", "<|endoftext|>", "a  b", "word" * 5000, "' ll 's\n's"]


def test_pieces_give_the_same_ids_as_whole_texts():
    own, of = tokens.encoder(MULTI), reference(MULTI)
    rng = random.Random(5)
    texts = ODD_TEXTS + ["".join(rng.choice(" \n\t'slréa中1.,—\x1c ") for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    for t in texts:
        assert own.encode(t).tolist() == of.encode_ordinary(t), t
        assert own.decode(own.encode(t)) == t.encode()


def test_file_of_the_tokenizers_library_gives_its_ids():
    whole, own, rng = Tokenizer.from_file(JSON), tokens.encoder(JSON), random.Random(8)
    texts = [*ODD_TEXTS, prose(3, 400)] + ["".join(rng.choice([" ", "\n", "\t", "'s", "l", "r", "é", "a", "中", "1", ".", "—", "\x1c", END]) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    for t in texts:
        assert own.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_the_added_token_is_one_id(spark):
    whole, end = Tokenizer.from_file(JSON), END
    texts = [*ODD_TEXTS, prose(3, 40), f"a {end} b", end * 2, f"{end}  x", f"one  {end}\n\n{end} it's", f"a{end[:-1]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.pack(df, JSON).orderBy("doc_id", "start").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], []) + np.frombuffer(r["ids"], dtype="<u4").tolist()
    assert got == {k: [*whole.encode(t, add_special_tokens=False).ids, packing.END_ID] for k, t in enumerate(texts)}


@pytest.mark.parametrize("chunk,overlap", [(64, 32), (300, 300), (16_384, 512)])
def test_chunks_are_stitched(spark, chunk, overlap):
    rng = random.Random(chunk)
    texts = ODD_TEXTS + [prose(k, 700) for k in range(4)] + ["".join(rng.choice(" \n'slréa中1.,") for _ in range(900)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = reference(MULTI)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df, MULTI, chunk_chars=chunk, overlap_chars=overlap).collect()}
    assert got == {k: of.encode_ordinary(t) for k, t in enumerate(texts)}


def test_encode_and_decode_odd_rows(odd, none):
    both = bpe.decode(bpe.encode(odd, MULTI), MULTI).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in both), key=key) == sorted(texts, key=key)
    assert bpe.decode(bpe.encode(none, MULTI), MULTI).count() == 0


def test_op4_against_whole_texts(spark, sf_dir):
    of = reference(MULTI)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.op4_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = of.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_cuts(n):
    c = packing.cuts(n, 1024)
    assert [a for a, _ in c] == [sum(s for _, s in c[:i]) for i in range(len(c))] and sum(s for _, s in c) == n
    assert all(s & (s - 1) == 0 and s <= 1024 for _, s in c) and len(c) == n // 1024 + bin(n % 1024).count("1")


def test_op2_against_the_tokenizer(spark, sf_dir):
    whole = Tokenizer.from_file(JSON)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = packing.op2_packing(spark, sf_dir).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(docs)
    for k, text in docs.items():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(by[k], key=lambda r: r["start"]):
            assert (r["start"], r["offset"], r["doc_tokens"]) == (at, 0, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing_odd_rows(odd, none, tmp_path):
    got = packing.pack(odd, JSON).collect()
    assert sum(r["start"] == 0 for r in got) == odd.count()
    assert sum(r["doc_tokens"] == 1 for r in got) == odd.filter("text is null or text = ''").count()
    assert packing.pack(none, JSON).count() == 0
    packing.write(packing.pack(odd, JSON), str(tmp_path / "packed"))
    assert {p.name for p in (tmp_path / "packed").iterdir() if p.is_dir()} == {f"bucket={r['bucket']}" for r in got}
    buckets = sorted((r["sequence_id"], r["bucket"]) for r in got)
    assert [b for _, b in buckets] == sorted(b for _, b in buckets)


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separator_scan_against_a_plain_split(spark, block):
    rng = np.random.default_rng(block)
    rows, want = [], set()
    for f in range(5):
        ids = rng.choice([7, 8, eod.END_ID], size=int(rng.integers(0, 200)), p=[0.45, 0.45, 0.1]).astype("<u2")
        data = ids.tobytes()
        rows += [(f"f{f}", k, data[at : at + block]) for k, at in enumerate(range(0, len(data), block))] + [(f"f{f}", 1 << 40, None)]
        start = doc = 0
        for i, x in enumerate(ids):
            if x == eod.END_ID or i == len(ids) - 1:
                want.add((f"f{f}", doc, start, i + 1 - start))
                start, doc = i + 1, doc + 1
    blocks = spark.createDataFrame(rows, "file string, block long, data binary")
    got = eod.counted(eod.scan(blocks)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block,task", [(64, 1 << 20), (64, 64), (6, 20), (2, 500)])
def test_flat_files_on_disk_in_ranges(spark, tmp_path, block, task):
    ids = np.array([5, 6, eod.END_ID, 7, eod.END_ID] * 100, dtype="<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "_meta").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "empty.bin").write_bytes(b"")
    blocks = eod.flat_blocks(spark, str(tmp_path), block, task)
    assert blocks.rdd.getNumPartitions() == -(-2 * len(ids) // (max(1, task // block) * block))
    got = eod.counted(eod.scan(blocks)).select("doc", "start", "n_tokens").collect()
    assert sorted(map(tuple, got)) == sorted((2 * k + j, 5 * k + 3 * j, (3, 2)[j]) for k in range(100) for j in (0, 1))
    assert eod.counted(eod.scan(eod.flat_blocks(spark, str(tmp_path / "a.bin"), block, task))).count() == 200


def test_token_counts_of_documents(spark, odd, none, sf_dir):
    of = reference(RANKS)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = eod.op10_token_counts(spark, sf_dir).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: len(of.encode_ordinary(t)) + 1 for k, t in docs.items()} and len(got) == len(docs)
    blocks = eod.written(odd.select("doc_id", "text"), RANKS, block_bytes=100)
    assert sorted(r["n_tokens"] for r in eod.counted(eod.scan(blocks)).collect()) == sorted(len(of.encode_ordinary(r["text"] or "")) + 1 for r in odd.collect())
    assert eod.counted(eod.scan(eod.written(none.select("doc_id", "text"), RANKS))).count() == 0
    assert blocks.agg(F.max(F.length("data"))).first()[0] <= 100
