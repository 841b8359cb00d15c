import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import periodic, repair
from tests.llm.conftest import prose


def plain_runs(w):
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(q % d == 0 and all(w[i + k] == w[i + k + d] for k in range(length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_against_a_plain_search():
    rng = random.Random(1)
    for _ in range(400):
        batch = []
        for _ in range(rng.randrange(1, 6)):
            n, k = rng.randrange(70), rng.randrange(1, 4)
            s = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.5 and n:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                s[a:] = [s[a + (i - a) % p] for i in range(a, n)]
            batch.append(np.array(s, dtype=np.int64))
        assert periodic.runs_of(batch) == [plain_runs(s.tolist()) for s in batch]


def test_long_periodic_texts_take_no_square():
    began = time.time()
    assert periodic.runs_of([np.zeros(200_000, dtype=np.int64)]) == [[(0, 200_000, 1)]]
    assert periodic.runs_of([np.tile(np.arange(4000), 25)]) == [[(0, 100_000, 4000)]]
    assert time.time() - began < 30


def test_periodic_on_odd_rows(spark, odd, none):
    got = {(r["doc_id"], r["text"]): r for r in periodic.periodic(odd).collect()}
    assert periodic.periodic(none).count() == 0
    for (_, text), r in got.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) < 2000:
            want = plain_runs(words)
            assert [tuple(x) for x in r["runs"]] == want
            gone = {i for s, n, p in want for i in range(s + p, s + n)}
            assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert got[5, "word " * 30_000]["collapsed"] == "word" and set(odd.columns) <= set(periodic.periodic(odd).columns)


def test_op11_against_a_plain_version(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = periodic.op11_runs(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert tuple(r)[1:] == (
            len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
        )


def plain_repair(roles, faults):
    """(cost, edits, (role, row or None)...) of the cheapest edits, by whole strings in each state."""
    after = {(0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3, (0, "s"): 1}
    names = (("u", "user"), ("a", "assistant"))
    best = {(0, 0): (0, "", ())}

    def offer(k, v):
        if k not in best or v[:2] < best[k][:2]:
            best[k] = v

    for i in range(len(roles) + 1):
        for _ in range(4):
            for s in [s for s in range(4) if (i, s) in best]:
                c, e, o = best[i, s]
                for to, name in names:
                    if (s, to) in after:
                        offer((i, after[s, to]), (c + 2, e + "I", o + ((name, None),)))
        for s in [s for s in range(4) if i < len(roles) and (i, s) in best]:
            c, e, o = best[i, s]
            offer((i + 1, s), (c + 3, e + "D", o))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if (s, roles[i][:1]) in after:
                    offer((i + 1, after[s, roles[i][:1]]), (c + cut, e + "K", o + ((roles[i], i),)))
                for to, name in names:
                    if (s, to) in after:
                        offer((i + 1, after[s, to]), (c + 2 + cut, e + "R", o + ((name, i),)))
    return min((best[len(roles), s] for s in (0, 3) if (len(roles), s) in best), key=lambda v: v[:2])


def test_signatures_against_whole_strings():
    rng = random.Random(3)
    name = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for _ in range(1500):
        sig = "".join(rng.choice("suaoxSUAO") for _ in range(rng.randrange(14)))
        t = repair.solve(sig)
        got = min((t[0][s][0] + 2 * k, t[0][s][1] + "I" * k) for s, k in ((0, 0), (1, 2), (2, 1), (3, 0)) if t[0][s])
        assert got == plain_repair([name[c.lower()] for c in sig], ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in sig])[:2]


@pytest.fixture(scope="module")
def talks(spark):
    rng, rows = random.Random(4), []
    for c in [*range(8), None]:
        for _ in range(rng.randrange(1, 60)):
            rows.append((c, rng.choice([None, *range(30)]), rng.choice([None, "user", "assistant", "system", "tool", ""]), rng.choice([None, "", " \n", "hi.", "hi there", "ok!", "a? ", "b", " ", *(f"{x}{i}." for i in range(12) for x in "xyz")])))
    rows += [(90, 1, "user", "same.")] * 9 + [(91, t, "user", "same.") for t in range(20)] + [(92, None, None, None), (93, t := 5, "system", "only.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return rows, df.withColumns({c: F.lit("clash") for c in ("conv", "n", "k", "at", "edits", "signature", "cost")})


def plain_audit(rows):
    talks, out = {}, {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    for c, rs in talks.items():
        rs.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        seen, faults = set(), []
        for _, r, x in rs:
            solid = re.findall(r"[^\x20\x09-\x0D]", x)
            faults.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((r, x))
        roles, turns = [r for _, r, _ in rs], [t for t, _, _ in rs if t is not None]
        cost, edits, left = plain_repair(roles, faults)
        rows = [(name, "" if i is None else rs[i][2]) for name, i in left]
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in rows).encode()).hexdigest()), rows
    return out


@pytest.mark.parametrize("most", [1, 4, 512])
def test_repair_of_odd_conversations(spark, talks, most):
    rows, df = talks
    want = plain_audit(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.audited(df, most=most).collect()}
    assert got == {c: x[0] for c, x in want.items()}
    left: dict = {}
    for r in sorted(repair.repair(df, most=most).collect(), key=lambda r: (r["segment"], r["position"])):
        left.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert left == {c: x[1] for c, x in want.items() if x[1]}


def test_repair_of_no_rows(spark, talks):
    assert repair.audited(talks[1].limit(0)).count() == 0 and repair.repair(talks[1].limit(0)).count() == 0
