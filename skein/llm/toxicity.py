"""Toxicity by a subsequence-kernel support vector machine on Nyström landmarks.

Words are compared by the subsequences of three letters that they share, in order but not
necessarily side by side: each occurrence weighs DECAY to the power of its span, so an insult with
letters put in or left out is still like the insult. Signs within a word (i.d.i.o.t) are no letters
and take no room; single letters in a row (i d i o t) are one word. The kernel is divided by what
both words' own occurrences weigh.

A word is placed by its kernel with landmarks, words of the labelled texts, times the inverse root
of the landmarks' own kernel (Nyström). The machine is trained on labelled sentences: of each
sentence of a toxic text that word counts which the machine itself finds worst, and of clean texts
all words are on the other side (a latent, multiple-instance machine; squared hinge, by Newton
steps). As its margin is linear in the subsequences of a word, training ends in one weight for each
subsequence, and a text is scored by looking them up: no kernel is computed then.

A text's score is a logistic function of its worst sentence, its worst five and the share of
sentences on the toxic side, fitted on labelled texts that the machine did not learn from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import SLICE_BYTES, documents, map_rows, table
from skein.llm.quality import held_out

#: Bounds on what is learned from: labelled documents, drawn by a hash of their ids, and their characters together.
FIT_DOCS = 4000
FIT_CHARS = 6_000_000
#: A longer document is not learned from.
FIT_LONGEST = 200_000
LANDMARKS = 256
#: Of the landmarks, in hundredths, so many are words that toxic texts have more often; the others are frequent words.
TOXIC_LANDMARKS = 70
THRESHOLD = 0.3
#: All words of clean texts weigh so many times what the words of toxic ones do.
CLEAN_WEIGHT = 30
#: Rounds of choosing words and fitting; in the last, so many toxic words also have a letter more or less, with such a weight.
TURNS = 5
VARIED = 100
VARIED_WEIGHT = 0.5
DECAY = 0.8
#: Places from the first to the last letter of a subsequence, at most.
SPAN = 6
LETTERS = 64
#: Code points that are looked at side by side.
CHUNK = 1 << 20

#: Each pair of distances (first letter to the second, second to third).
_GAPS = [(i, j) for i in range(1, SPAN - 1) for j in range(1, SPAN - i)]
_BREAK, _EDGE = 0, 1


def _classes() -> np.ndarray:
    """What each code point of the first planes is: 0 ends a word, 255 no letter (takes no room), 254 the same and ends a sentence, else a letter's number."""
    kind = np.full(0x250, 255, dtype=np.uint8)
    kind[[0x20, *range(9, 14)]] = _BREAK
    kind[[ord(c) for c in ".!?"]] = 254
    for c in range(0x250):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            kind[c] = low - 97 + 2 if 97 <= low < 123 else 28 + low % (LETTERS - 28)
    kind[10] = 253  # a line feed ends a word and a sentence
    return kind


_KIND = _classes()


@dataclass(frozen=True)
class Units:
    """The words of texts as letters: letter has an edge before and after each word; of: the word at each place; sentence and text of each word."""

    letter: np.ndarray
    of: np.ndarray
    sentence: np.ndarray
    text: np.ndarray


def units(texts: list[str | None]) -> Units:
    """Words of at least three letters, or three or more single letters in a row, with their sentences (numbered through) and texts."""
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    sizes = np.array([len(p) + 1 for p in points], dtype=np.int64)
    flat = np.full(int(sizes.sum()), 10, dtype=np.uint32)
    if len(points):
        inner = np.ones(len(flat), dtype=bool)
        inner[np.cumsum(sizes) - 1] = False
        flat[inner] = np.concatenate(points)
    kind = np.where(flat < len(_KIND), _KIND[np.minimum(flat, len(_KIND) - 1)], 28 + flat % (LETTERS - 28)).astype(np.uint8)
    # A sentence ends after a line feed, or after a run of end signs that white space follows.
    space = (kind == _BREAK) | (kind == 253)
    ends = kind == 253
    ends[1:] |= space[1:] & (kind[:-1] == 254)
    kept = space | (kind < LETTERS) & (kind > 0)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    sentence = np.cumsum(ends, dtype=np.int32) - ends
    kind, space, text, sentence = kind[kept], space[kept], text[kept], sentence[kept]
    letter = ~space
    begins = letter.copy()
    begins[1:] &= space[:-1]
    first = np.flatnonzero(begins)
    number = np.cumsum(begins, dtype=np.int32) - 1
    long = np.bincount(number[letter], minlength=len(first)) if len(first) else np.zeros(0, dtype=np.int64)
    # Single letters in a row, in one sentence, are joined; of the words that result, those under three letters go.
    single = long == 1
    joined = np.zeros(len(first), dtype=bool)
    joined[1:] = single[1:] & single[:-1] & (sentence[first][1:] == sentence[first][:-1])
    group = np.cumsum(~joined, dtype=np.int32) - 1
    total = np.bincount(group, weights=long).astype(np.int64) if len(first) else long
    ok = total >= 3
    at = np.flatnonzero(letter)
    of_group = group[number[at]]
    at = at[ok[of_group]]
    renamed = np.cumsum(ok, dtype=np.int32) - 1
    of = renamed[of_group[ok[of_group]]]
    heads = first[~joined][ok]
    size = total[ok]
    place = np.arange(len(at)) + 2 * of + 1
    out = np.full(len(at) + 2 * len(size), _EDGE, dtype=np.int32)
    out[place] = kind[at]
    return Units(out, np.repeat(np.arange(len(size), dtype=np.int32), size + 2), sentence[heads], text[heads])


def _own(size: np.ndarray) -> np.ndarray:
    """The root of what the subsequences of a word with so many places (edges too) weigh, each by itself."""
    return np.sqrt(sum(np.maximum(size - i - j, 0) * DECAY ** (2 * (i + j)) for i, j in _GAPS))


def subsequences(u: Units, begin: int, end: int):
    """(word, number, weight) of the subsequences in places begin to end, for each pair of distances."""
    letter, of = u.letter[begin:end], u.of[begin:end]
    for i, j in _GAPS:
        if len(letter) <= i + j:
            continue
        inside = of[: -(i + j)] == of[i + j :]
        code = (letter[: -(i + j)] * LETTERS + letter[i : len(letter) - j]) * LETTERS + letter[i + j :]
        yield of[: -(i + j)], code, inside, DECAY ** (i + j)


def _chunks(u: Units, most: int = CHUNK):
    """Places in stretches of whole words, of about so many each (a longer word is one)."""
    at, n = 0, len(u.of)
    while at < n:
        end = min(at + most, n)
        if end < n:
            end = int(np.searchsorted(u.of, u.of[end], side="left"))
            if end <= at:
                end = int(np.searchsorted(u.of, u.of[at], side="right"))
        yield at, end
        at = end


def margins(u: Units, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's margin for each word."""
    total = np.zeros(len(u.text))
    for a, b in _chunks(u):
        first = int(u.of[a])
        n = int(u.of[b - 1]) - first + 1
        value = np.zeros(b - a, dtype=np.float64)
        for _, code, inside, decay in subsequences(u, a, b):
            value[: len(code)] += np.where(inside, weights[code], 0) * decay
        total[first : first + n] = np.add.reduceat(value, np.searchsorted(u.of[a:b], np.arange(first, first + n)))
    return total / np.maximum(_own(np.bincount(u.of, minlength=len(u.text))), 1e-9) + bias


#: Figures of a text, and with a constant.
N_FIGURES = 4


def figures(u: Units, margin: np.ndarray, n_texts: int) -> np.ndarray:
    """For each text: its worst sentence's margin, the mean of its worst five, the share of sentences on the toxic side (as a root), and 1. A sentence has its worst word's margin; without any, a text has -2."""
    out = np.tile(np.array([-2.0, -2.0, 0.0, 1.0]), (n_texts, 1))
    if not len(margin):
        return out
    head = np.flatnonzero(np.append(True, u.sentence[1:] != u.sentence[:-1]))
    worst = np.maximum.reduceat(margin, head)
    text = u.text[head]
    o = np.lexsort((-worst, text))
    worst, text = worst[o], text[o]
    begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    n = np.diff(np.append(begin, len(text)))
    rank = np.arange(len(text)) - np.repeat(begin, n)
    which = text[begin]
    top = rank < 5
    five = np.bincount(text[top], weights=np.maximum(worst[top], -2), minlength=n_texts) - 2 * np.maximum(5 - np.bincount(text, minlength=n_texts), 0)
    out[which, 0] = np.clip(worst[begin], -2, 2)
    out[which, 1] = np.clip(five[which] / 5, -2, 2)
    out[which, 2] = np.sqrt(np.bincount(text, weights=worst > 0, minlength=n_texts)[which] / n)
    return out


@dataclass(frozen=True)
class Machine:
    """weights of subsequences and bias: a word's margin; logistic: weights of a text's figures; prior: the share of toxic texts."""

    weights: np.ndarray
    bias: float
    logistic: np.ndarray
    prior: float


@dataclass(frozen=True)
class Landmarks:
    """known: the landmarks' subsequences; weigh: what each of them weighs in each landmark."""

    known: np.ndarray
    weigh: np.ndarray


def landmarks_of(u: Units, chosen_words: np.ndarray) -> Landmarks:
    """These words of u as landmarks."""
    chosen = np.full(len(u.text), -1)
    chosen[chosen_words] = np.arange(len(chosen_words))
    own = np.maximum(_own(np.bincount(u.of, minlength=len(u.text))), 1e-9)
    found = [(chosen[w[ok]], code[ok], d / own[w[ok]]) for w, code, inside, d in subsequences(u, 0, len(u.of)) for ok in [inside & (chosen[w] >= 0)]]
    known, row = np.unique(np.concatenate([f[1] for f in found]), return_inverse=True)
    weigh = np.zeros((len(known), len(chosen_words)), dtype=np.float32)
    np.add.at(weigh, (row, np.concatenate([f[0] for f in found])), np.concatenate([f[2] for f in found]))
    return Landmarks(known, weigh)


def picked(u: Units, words: np.ndarray) -> Units:
    """These words (a mask) of u."""
    inside = words[u.of]
    return Units(u.letter[inside], (np.cumsum(words, dtype=np.int32) - 1)[u.of[inside]], u.sentence[words], u.text[words])


def kernel(u: Units, marks: Landmarks, root: np.ndarray | None = None) -> np.ndarray:
    """The kernel of each word with each landmark; if root is given, times root, and a last column of ones."""
    own = np.maximum(_own(np.bincount(u.of, minlength=len(u.text))), 1e-9)
    place = np.vstack((marks.weigh, np.zeros((1, marks.weigh.shape[1]), dtype=np.float32)))
    index = np.full(LETTERS**3, len(marks.known), dtype=np.int32)
    index[marks.known] = np.arange(len(marks.known))
    k = np.ones((len(u.text), place.shape[1] if root is None else root.shape[1] + 1), dtype=np.float32)
    for a, b in _chunks(u, CHUNK >> 6):
        first = int(u.of[a])
        head = np.searchsorted(u.of[a:b], np.arange(first, int(u.of[b - 1]) + 1))
        value = np.zeros((b - a, place.shape[1]), dtype=np.float32)
        for _, code, inside, d in subsequences(u, a, b):
            value[: len(code)] += place[np.where(inside, index[code], len(marks.known))] * np.float32(d)
        rows = np.add.reduceat(value, head) / own[first : first + len(head), None].astype(np.float32)
        k[first : first + len(head), : root.shape[1] if root is not None else None] = rows if root is None else rows @ root
    return k


def variants(u: Units, words: np.ndarray, rng: np.random.Generator) -> tuple[Units, np.ndarray]:
    """Words of u with a letter put in at each inner place and with each inner letter left out, and which of words each comes from."""
    made, source = [], []
    for k, w in enumerate(words.tolist()):
        a, b = np.searchsorted(u.of, [w, w + 1])
        x = u.letter[a:b]
        for i in range(2, len(x) - 1):
            made.append(np.insert(x, i, rng.integers(2, 28)))
            if len(x) > 6:
                made.append(np.delete(x, min(i, len(x) - 3)))
            source += [k] * (1 + (len(x) > 6))
    sizes = np.array([len(x) for x in made], dtype=np.int64)
    none = np.zeros(len(made), dtype=np.int64)
    return Units(np.concatenate(made) if made else np.zeros(0, dtype=np.int32), np.repeat(np.arange(len(made)), sizes), none, none), np.array(source, dtype=np.int64)


def hinge(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], start: np.ndarray, ridge: float = 1e-5, rounds: int = 12) -> np.ndarray:
    """Weights (the last for a constant) of the machine with the least squared hinge loss, weighted by share, by Newton steps on the rows within the margin.

    blocks: rows, their sides (1 or -1) and their shares; no block is copied.
    """
    w = start.copy()

    def gaps(w: np.ndarray) -> list[np.ndarray]:
        return [np.where(share > 0, np.maximum(1 - y * (x @ w.astype(np.float32)), 0), 0) for x, y, share in blocks]

    def loss(w: np.ndarray) -> float:
        return float(sum((share * g**2).sum() for g, (_, _, share) in zip(gaps(w), blocks)) + ridge * (w[:-1] @ w[:-1]))

    now = loss(w)
    for _ in range(rounds):
        h, v = ridge * np.eye(len(w)), np.zeros(len(w))
        for g, (x, y, share) in zip(gaps(w), blocks):
            inside = np.flatnonzero(g > 0)
            for i in range(0, len(inside), 8192):
                r = inside[i : i + 8192]
                a = x[r].astype(np.float64)
                scaled = a.T * share[r]
                h += scaled @ a
                v += scaled @ y[r]
        step = np.linalg.solve(h, v) - w
        size = 1.0
        while size > 1e-3 and (then := loss(w + size * step)) > now:
            size /= 2
        if size <= 1e-3 or now - then < 1e-6 * now:
            break
        w, now = w + size * step, then
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic function of figures (the last is a constant), by Newton steps; the figures' weights aren't below zero."""
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    free = np.ones(len(w), dtype=bool)
    held = ridge * np.append(np.ones(len(w) - 1), 0.01)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + held * w
        h = (x.T * (p * (1 - p))) @ x + np.diag(held) + 1e-9 * np.eye(len(w))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(h[np.ix_(free, free)], slope[free])
        w = w - step / max(1.0, float(np.abs(step).max()))
        below = (w < 0) & (np.arange(len(w)) < len(w) - 1)
        w[below], free[below] = 0, False
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(texts: list[str], labels: np.ndarray, n_landmarks: int = LANDMARKS) -> Machine:
    """A machine from whole labelled texts, in the order given; every fourth is kept for the logistic function if that leaves ten toxic ones."""
    labels = labels.astype(bool)
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    blank = Machine(np.zeros(LETTERS**3, dtype=np.float32), -1.0, np.array([0.0, 0.0, 0.0, np.log(prior / (1 - prior))]), prior)
    apart = np.arange(len(texts)) % 4 == 3
    if labels[apart].sum() < 10 or (~labels[apart]).sum() < 10:
        apart[:] = False
    u = units(texts)
    if not len(u.text) or labels.all() or not labels.any():
        return blank
    # Equal words are one row: a number for each, by two sums over its letters.
    rng = np.random.default_rng(5)
    begin = np.searchsorted(u.of, np.arange(len(u.text)))
    size = np.bincount(u.of)
    place = np.arange(len(u.of)) - begin[u.of]
    mixed = (u.letter.astype(np.uint64) + np.uint64(1)) * rng.integers(1, 1 << 62, int(size.max()), dtype=np.int64).astype(np.uint64)[place]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    _, sample, word = np.unique(np.add.reduceat(mixed, begin), return_index=True, return_inverse=True)
    # In the order of their first occurrences.
    o = np.argsort(sample)
    sample, word = sample[o], np.argsort(o)[word]
    del mixed, place, o
    fit_word = ~apart[u.text]
    toxic = labels[u.text]
    in_texts = np.unique(word[fit_word].astype(np.int64) * len(texts) + u.text[fit_word])
    seen_in, of_text = in_texts // len(texts), in_texts % len(texts)
    bad = np.bincount(seen_in[labels[of_text]], minlength=len(sample))
    good = np.bincount(seen_in[~labels[of_text]], minlength=len(sample))
    if not bad.any():
        return blank
    n_bad, n_good = max(int((labels & ~apart).sum()), 1), max(int((~labels & ~apart).sum()), 1)
    lift = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    n_toxic = n_landmarks * TOXIC_LANDMARKS // 100
    by_lift = np.lexsort((np.arange(len(sample)), -np.where(bad > 0, lift * np.sqrt(bad), -np.inf)))[:n_toxic]
    by_lift = by_lift[bad[by_lift] > 0]
    by_count = np.lexsort((np.arange(len(sample)), -good))
    by_count = by_count[~np.isin(by_count, by_lift) & (good[by_count] > 0)][: n_landmarks - len(by_lift)]
    marks = np.concatenate((by_lift, by_count))
    # One occurrence of each distinct word, in its own right.
    own = np.zeros(len(u.text), dtype=bool)
    own[sample] = True
    distinct = picked(u, own)
    is_mark = np.zeros(len(sample), dtype=bool)
    is_mark[marks] = True
    mark_words = picked(distinct, is_mark)
    table_of_marks = landmarks_of(mark_words, np.arange(len(marks)))
    values, vectors = np.linalg.eigh(kernel(mark_words, table_of_marks).astype(np.float64))
    ok = values > 1e-4 * values.max()
    root = (vectors[:, ok] / np.sqrt(values[ok])).astype(np.float32)
    x = kernel(distinct, table_of_marks, root)

    clean = good > 0
    bags = np.unique(np.column_stack((u.sentence[fit_word & toxic], word[fit_word & toxic])), axis=0)
    bag_head = np.flatnonzero(np.append(True, bags[1:, 0] != bags[:-1, 0])) if len(bags) else np.zeros(0, dtype=np.int64)
    w = np.zeros(x.shape[1])
    score = lift * np.sqrt(np.maximum(bad, 1))  # what stands for the margin before the first round
    strong = score > score[bad > 0].max() / 4
    floor = np.quantile(score[bad > 0], 0.9)
    for turn in range(TURNS):
        value = (x @ w.astype(np.float32) if turn else score - floor)[bags[:, 1]]
        best = np.maximum.reduceat(value, bag_head)
        inside = np.repeat(np.arange(len(bag_head)), np.diff(np.append(bag_head, len(bags))))
        chosen = (value == best[inside]) & (best[inside] > 0) | strong[bags[:, 1]]
        if not chosen.any():
            chosen = value == value.max()
        hits = np.bincount(bags[chosen, 1], minlength=len(sample)).astype(float)
        pos = np.flatnonzero(hits > good) if (hits > good).any() else np.flatnonzero(hits)
        neg = np.flatnonzero(clean & (hits <= good))
        side, share = -np.ones(len(sample)), np.zeros(len(sample))
        side[pos] = 1
        toxic_share = hits ** 0.75 / (hits[pos] ** 0.75).sum()
        share[pos] = toxic_share[pos]
        share[neg] = CLEAN_WEIGHT * np.sqrt(good[neg]) / max(np.sqrt(good[neg]).sum(), 1)
        blocks = [(x, side, share)]
        if turn == TURNS - 1:  # virtual examples: the machine shall not mind a letter more or less
            often = pos[np.lexsort((pos, -hits[pos]))][:VARIED]
            varied, source = variants(distinct, often, rng)
            if len(source):
                blocks.append((kernel(varied, table_of_marks, root), np.ones(len(source)), VARIED_WEIGHT * (toxic_share[often] / np.maximum(np.bincount(source, minlength=len(often)), 1))[source]))
        w = hinge(blocks, w)
    weights = np.zeros(LETTERS**3, dtype=np.float32)
    weights[table_of_marks.known] = table_of_marks.weigh @ (root @ w[:-1].astype(np.float32))
    machine = Machine(weights, float(w[-1]), blank.logistic, prior)
    f = figures(u, margins(u, weights, machine.bias), len(texts))
    use = apart if apart.any() else np.ones(len(texts), dtype=bool)
    return Machine(weights, machine.bias, logistic(f[use], labels[use].astype(float)), prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Machine:
    """A machine learned from labelled documents that are not held out.

    At most fit_docs of them, those with the smallest hash of their ids, and of these the first that
    have fit_chars characters together; documents of over FIT_LONGEST characters are left out. The
    running total is taken over ids and lengths; only texts within the bound reach the driver. A
    document with several labels has its greatest; other labels than 0 and 1 and nulls are left out.
    Without labels of both kinds every text has the prior.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).withColumn("h", F.xxhash64(F.col("id").cast("string"))).orderBy("h", "id").limit(fit_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") <= FIT_LONGEST).join(F.broadcast(chosen), "id")  # fit_docs rows of numbers
    # Rows of one id: the one with the least hash stands for all.
    sizes = rows.groupBy("h", "id").agg(F.min(F.struct(F.xxhash64("text").alias("t"), F.length("text").alias("n"))).alias("m"))
    within = sizes.orderBy("h", "id").limit(fit_docs).withColumn("total", F.sum("m.n").over(Window.orderBy("h", "id"))).filter(F.col("total") <= fit_chars).select("id", F.col("m.t").alias("t"))
    got = rows.join(F.broadcast(within), "id").filter(F.xxhash64("text") == F.col("t")).select("h", "id", "label", "text").distinct().collect()
    got.sort(key=lambda r: (r["h"], r["id"]))
    return learn([r["text"] for r in got], np.array([r["label"] for r in got], dtype=int))


def score(df: DataFrame, machine: Machine, text_col: str = "text", out: str = "score", worst_col: str | None = None) -> DataFrame:
    """df with out (double, 0 to 1: higher, likelier toxic), and, if worst_col is given, that column: the text's worst word, by its first place and length in letters (null if it has none).

    Texts are scored whole; a null or blank text, or one without a word of three letters, has the
    score of a text without any sentence. Every row stays; columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(machine)  # one megabyte, whatever the input

    def scored(texts: list[str | None]) -> dict[str, list]:
        m = shared.value
        u = units(texts)
        margin = margins(u, m.weights, m.bias) if len(u.text) else np.zeros(0)
        f = figures(u, margin, len(texts))
        made: dict[str, list] = {out: (1 / (1 + np.exp(-np.clip(f @ m.logistic, -30, 30)))).tolist()}
        if worst_col:
            worst: list[str | None] = [None] * len(texts)
            o = np.lexsort((np.arange(len(margin)), -margin, u.text))
            for k in o[np.append(True, u.text[o][1:] != u.text[o][:-1])].tolist() if len(o) else []:
                a, b = np.searchsorted(u.of, [k, k + 1])
                worst[int(u.text[k])] = "".join(chr(x - 2 + 97) if x < 28 else "?" for x in u.letter[a + 1 : b - 1].tolist())
            made[worst_col] = worst
        return made

    return map_rows(df, [text_col], f"{out} double" + (f", {worst_col} string" if worst_col else ""), scored, rows=SLICE_BYTES >> 13)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, by a machine that learned from the labels that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
