import numpy as np

from skein.llm import toxicity
from skein.llm.common import documents, table
from skein.llm.quality import held_out


def plain_kernel(a, b):
    """The sum over equal letter triples of both words (edges too), each with its decayed spans, over what the words' own triples weigh."""

    def triples(w):
        w = "^" + w + "^"
        return [((w[i], w[j], w[k]), toxicity.DECAY ** (k - i)) for i in range(len(w)) for j in range(i + 1, len(w)) for k in range(j + 1, len(w)) if k - i < toxicity.SPAN]

    x, y = triples(a), triples(b)
    own = lambda t: sum(d * d for _, d in t) ** 0.5
    return sum(d * e for s, d in x for t, e in y if s == t) / (own(x) * own(y))


def test_kernel_against_a_plain_sum():
    words = ["idiot", "idxiot", "idiotic", "stone", "river", "banana", "aaa", "abcabcabc"]
    u = toxicity.units([" ".join(words)])
    k = toxicity.kernel(u, toxicity.landmarks_of(u, np.arange(len(words))))
    want = np.array([[plain_kernel(a, b) for b in words] for a in words])
    assert np.allclose(k, want, atol=1e-5)
    assert k[0, 1] > k[0, 3:].max()


def test_words_and_sentences():
    u = toxicity.units(["i.d.i.o.t and i d i o t!\nNaïve ok", None, "", " \n .!? ", "one. two three", "a b"])
    words = ["".join(map(chr, u.letter[u.of == w][1:-1] + 95)) for w in range(len(u.text))]
    assert words[:3] == ["idiot", "and", "idiot"] and len(words) == 4 + 3
    assert u.text.tolist() == [0, 0, 0, 0, 4, 4, 4] and [len(set(u.sentence[u.text == t])) for t in (0, 4)] == [2, 2]
    assert not len(toxicity.units([]).text)


def taught():
    rng = np.random.default_rng(2)
    clean = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(3, 8))) for _ in range(400)]
    clean = [w for w in clean if not any(x in w for x in ("idio", "stup", "moro"))]
    texts, labels = [], []
    for k in range(160):
        words = list(rng.choice(clean, 60))
        if k % 3 == 0:
            for _ in range(4):
                words[rng.integers(60)] = str(rng.choice(["idiot", "stupid", "moron"]))
        texts.append(". ".join(" ".join(words[i : i + 10]) for i in range(0, 60, 10)))
        labels.append(int(k % 3 == 0))
    return texts, np.array(labels), clean


def test_gaps_and_inserted_letters_are_tolerated():
    texts, labels, clean = taught()
    m = toxicity.learn(texts, labels, n_landmarks=64)

    def worst(word):
        u = toxicity.units([word])
        return toxicity.margins(u, m.weights, m.bias).max()

    for w in ("idiot", "stupid", "moron", "i.d.i.o.t", "s-t-u-p-i-d", "m o r o n", "idxiot", "stuupid", "morron", "stu*pid", "moxron"):
        assert worst(w) > 0, w
    assert np.mean([worst(w) > 0 for w in clean]) < 0.01
    u = toxicity.units(texts)
    p = toxicity.figures(u, toxicity.margins(u, m.weights, m.bias), len(texts)) @ m.logistic
    assert ((p > 0) == labels).mean() > 0.95


def test_scores_of_odd_rows(spark, odd, none):
    texts, labels, _ = taught()
    m = toxicity.learn(texts, labels, n_landmarks=64)
    got = toxicity.score(odd, m, worst_col="kept").collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if not (r["text"] or "").strip()}
    assert len(blank) == 1 and all(r["kept"] is None for r in got if not (r["text"] or "").strip())
    assert toxicity.score(none, m).count() == 0
    nothing = toxicity.train(none.selectExpr("doc_id", "text"), none.selectExpr("doc_id", "1 as toxic"))
    assert {r["score"] for r in toxicity.score(odd, nothing).collect()} == {nothing.prior}
    assert toxicity.learn(texts, np.ones(len(texts))).prior > 0.9 and not toxicity.learn(["", "a"], np.array([0, 1])).weights.any()


def test_long_texts_in_chunks_are_as_whole(monkeypatch):
    texts, labels, _ = taught()
    m = toxicity.learn(texts, labels, n_landmarks=64)
    u = toxicity.units([" ".join(texts), "x" * 3000, texts[0]])
    whole = toxicity.margins(u, m.weights, m.bias)
    parts = [toxicity._chunks(u, 100), toxicity._chunks(u)]
    assert [list(p)[-1][1] for p in parts] == [len(u.of)] * 2
    monkeypatch.setattr(toxicity._chunks, "__defaults__", (100,))
    assert np.allclose(toxicity.margins(u, m.weights, m.bias), whole)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    m = toxicity.train(docs, labels)
    held = docs.join(labels.filter(held_out()).select("doc_id", "toxic"), "doc_id").select("doc_id", "text", "toxic")
    rows = toxicity.score(held, m).collect()
    said = [(r["score"] >= toxicity.THRESHOLD, r["toxic"]) for r in rows]
    hit = sum(s and t for s, t in said)
    assert hit / sum(s for s, _ in said) > 0.85 and hit / sum(t for _, t in said) > 0.85
