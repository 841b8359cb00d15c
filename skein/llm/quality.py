"""Line quality by a linear-chain conditional random field.

Each line of a text is good or bad. Its evidence is its own features and those of the lines before
and after it; the chain's transitions carry evidence further. Forward-backward gives every line the
probability of being good, and a document's quality is their mean weighted by the lines' lengths.
The field is trained here, by gradient ascent on whole labelled documents: each line of a document
has the document's label. Training chains run through several documents, good and bad ones mixed,
so that the field sees good lines next to bad ones and learns how readily quality changes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import documents, map_rows, table

#: Bounds on what is learned from: labelled documents, drawn by a hash of their ids, and lines.
FIT_DOCS = 3000
FIT_LINES = 100_000
#: Documents that one training chain runs through.
CHAIN_DOCS = 4
ROUNDS = 150
THRESHOLD = 0.7
HELD_OUT = 2

_CLASSES = ("space", "upper", "lower", "digit", "symbol", "pipe", "exclaim", "other")
_OF_BYTE = np.full(256, _CLASSES.index("other"), dtype=np.uint8)
for _name, _chars in (
    ("space", b" \t\v\f\r"), ("upper", bytes(range(65, 91))), ("lower", bytes(range(97, 123))), ("digit", b"0123456789"),
    ("symbol", b"#*$%&<>@^_~=+{}[]\\/"), ("pipe", b"|"), ("exclaim", b"!"),
):
    _OF_BYTE[list(_chars)] = _CLASSES.index(_name)
#: A number for each byte; words whose sums and lengths agree count as equal.
_MIX = np.random.default_rng(11).integers(1, 1 << 40, 256, dtype=np.int64)
#: Features of one line, and of a line with its neighbours and a constant.
N_OWN = 11
N_FEATURES = 3 * N_OWN + 4


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length, lines of each text): lines with nothing but white space are left out."""
    blob = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(blob), dtype=np.uint8)
    if not len(data):
        return np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(len(texts), dtype=np.int64)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    kind = _OF_BYTE[data]
    kind[ends] = 0
    text_of = np.searchsorted(np.cumsum([len(b) for b in blob]), starts, side="right")
    # Words: runs of bytes that are not space; a line feed is one.
    spaces = kind == 0
    first = ~spaces
    first[1:] &= spaces[:-1]
    word_at = np.flatnonzero(first)
    line_of_word = np.searchsorted(starts, word_at, side="right") - 1
    n_words = np.bincount(line_of_word, minlength=len(starts))
    counts = np.bincount((np.repeat(np.arange(len(starts)), ends - starts + 1) * 8 + kind), minlength=8 * len(starts)).reshape(-1, 8).astype(float)
    chars = counts[:, 1:].sum(axis=1)
    keep = chars > 0
    mixed_bytes = np.where(spaces, 0, _MIX[data])
    line_mix = np.add.reduceat(mixed_bytes, starts)[keep]
    if len(word_at):
        mixed = np.add.reduceat(mixed_bytes, word_at)
        again = np.zeros(len(word_at))
        again[1:] = (mixed[1:] == mixed[:-1]) & (line_of_word[1:] == line_of_word[:-1])
        repeats = np.bincount(line_of_word, weights=again, minlength=len(starts))
    else:
        repeats = np.zeros(len(starts))
    c, w, n = counts[keep], np.maximum(n_words[keep], 1).astype(float), chars[keep]
    last = data[np.maximum(ends[keep] - 1, 0)]
    own = np.column_stack((
        np.log1p(w) / 4, np.log1p(n / w) / 2, c[:, 1] / np.maximum(c[:, 1] + c[:, 2], 1), c[:, 3] / n, 4 * c[:, 4] / n, np.minimum(2 * c[:, 5] / w, 1), np.minimum(c[:, 6] / w, 1),
        c[:, 7] / n, repeats[keep] / w, np.isin(last, np.frombuffer(b".!?", dtype=np.uint8)), np.minimum(c[:, 4] / w / 2, 1),
    )).astype(float)
    of = text_of[keep]
    n_lines = np.bincount(of, minlength=len(texts))
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = of[1:] == of[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    twin = np.zeros(len(of))
    equal = same & (line_mix[1:] == line_mix[:-1])
    twin[1:][equal] = 1
    twin[:-1][equal] = 1
    opens, closes = np.ones(len(of)), np.ones(len(of))
    opens[1:][same] = 0
    closes[:-1][same] = 0
    return np.column_stack((own, before, after, np.ones(len(of)), opens, closes, twin)), n, n_lines


@dataclass(frozen=True)
class Field:
    """weights of a line's features for good against bad; moves[i][j]: log weight of j after i; prior: share of good documents."""

    weights: tuple[float, ...]
    moves: tuple[tuple[float, float], tuple[float, float]]
    prior: float


def marginals(evidence: np.ndarray, n_lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each line is good, probabilities of each move into it), by forward-backward over every text's lines.

    Texts advance side by side, a line at a time, longest first. Messages are scaled at each line.
    """
    at = np.concatenate(([0], np.cumsum(n_lines)[:-1])).astype(np.int64)
    order = np.argsort(-n_lines, kind="stable")
    lengths = n_lines[order]
    most = int(lengths[0]) if len(lengths) else 0
    good = np.exp(np.clip(evidence, -30, 30))
    local = np.column_stack((np.ones(len(good)), good))
    local /= local.sum(axis=1, keepdims=True)
    A = np.exp(moves)
    ahead, behind = np.ones((len(good), 2)), np.ones((len(good), 2))
    active = np.searchsorted(-lengths, -np.arange(1, most + 1), side="right")
    for t in range(most):
        i = at[order[: active[t]]] + t
        m = local[i] if t == 0 else (ahead[i - 1] @ A) * local[i]
        ahead[i] = m / m.sum(axis=1, keepdims=True)
    for t in range(most - 2, -1, -1):
        i = at[order[: active[t + 1]]] + t
        m = (behind[i + 1] * local[i + 1]) @ A.T
        behind[i] = m / m.sum(axis=1, keepdims=True)
    both = ahead * behind
    p = both[:, 1] / both.sum(axis=1)
    into = np.zeros((len(good), 2, 2))
    inner = np.ones(len(good), dtype=bool)
    inner[at[n_lines > 0]] = False
    j = np.flatnonzero(inner)
    joint = ahead[j - 1][:, :, None] * A[None] * (local[j] * behind[j])[:, None, :]
    into[j] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return p, into


def fit(x: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, l2: float = 1e-3, chain_docs: int = CHAIN_DOCS) -> Field:
    """The field with the greatest likelihood of the labels, a document's weight being the same whatever its number of lines; a chain runs through chain_docs documents in the order given."""
    has = n_lines > 0
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    if not has.any():
        return Field((0.0,) * N_FEATURES, ((0.0, 0.0), (0.0, 0.0)), prior)
    of = np.repeat(np.arange(len(n_lines)), n_lines)
    y = labels[of].astype(float)
    share = (1.0 / np.maximum(n_lines, 1))[of] / has.sum()
    theta, m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    chains = np.add.reduceat(n_lines, np.arange(0, len(n_lines), chain_docs))
    inner = np.ones(len(of), dtype=bool)
    inner[np.concatenate(([0], np.cumsum(chains)[:-1]))[chains > 0]] = False
    j = np.flatnonzero(inner)
    seen = np.bincount((2 * y[j - 1] + y[j]).astype(np.int64), weights=share[j], minlength=4).reshape(2, 2)
    for step in range(1, rounds + 1):
        p, into = marginals(x @ theta[:N_FEATURES], chains, theta[N_FEATURES:].reshape(2, 2))
        slope = np.concatenate((x.T @ (share * (y - p)), (seen - np.einsum("n,nij->ij", share, into)).ravel())) - l2 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    moves = theta[N_FEATURES:]
    return Field(tuple(map(float, theta[:N_FEATURES])), ((float(moves[0]), float(moves[1])), (float(moves[2]), float(moves[3]))), prior)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether the CRC32 of the id as text leaves HELD_OUT on division by four; false for a null id."""
    return F.coalesce(F.pmod(F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES) -> Field:
    """A field learned from labelled documents that are not held out.

    At most fit_docs of them, those with the smallest hash of their ids, and of these the first in
    that order that have fit_lines lines together; whole texts. Features are made in tasks, and only
    they reach the driver, once a running total over ids and numbers of lines has chosen them. A document with several labels has its least; other labels than 0 and 1
    and nulls are left out. Without any labelled document the field scores 0.5.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = usable.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label")).withColumn("h", F.xxhash64(F.col("id").cast("string"))).orderBy("h", "id").limit(fit_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # fit_docs rows of numbers

    def features(texts: list[str | None]) -> dict[str, list]:
        x, _, n = line_features(texts)
        at = np.concatenate(([0], np.cumsum(n)))
        return {"x": [x[at[i] : at[i + 1]].astype("<f4").tobytes() for i in range(len(texts))], "n": n.tolist()}

    made = map_rows(rows, ["text"], "x binary, n int, text string", lambda t: features(t) | {"text": [None] * len(t)}).drop("text")
    # The running total is taken over numbers, and only features within the bound reach the driver.
    sizes = made.groupBy("h", "id").agg(F.sum("n").alias("n")).filter(F.col("n") <= fit_lines).orderBy("h", "id").limit(fit_docs)
    within = sizes.withColumn("total", F.sum("n").over(Window.orderBy("h", "id"))).filter(F.col("total") <= fit_lines).select("id")
    got = sorted(made.join(F.broadcast(within), "id").select("h", "id", "n", "x", "label").toLocalIterator(), key=lambda r: (r["h"], r["id"]))
    if not got:
        return Field((0.0,) * N_FEATURES, ((0.0, 0.0), (0.0, 0.0)), 0.5)
    x = np.concatenate([np.frombuffer(r["x"], dtype="<f4").reshape(-1, N_FEATURES) for r in got]).astype(float)
    return fit(x, np.array([r["n"] for r in got]), np.array([r["label"] for r in got]))


def score(df: DataFrame, field: Field, text_col: str = "text", out: str = "score", lines_out: str | None = None) -> DataFrame:
    """df with out (double, 0 to 1: higher, likelier good), and, if lines_out is given, that column: array<double> of the lines' probabilities.

    Lines with nothing but white space have no part in the chain. A null, empty or blank text has
    the field's prior. Texts are scored whole; every row stays; columns of these names are replaced.
    """
    weights, moves = np.array(field.weights), np.array(field.moves)

    def scored(texts: list[str | None]) -> dict[str, list]:
        x, length, n = line_features(texts)
        p, _ = marginals(x @ weights, n, moves)
        of = np.repeat(np.arange(len(texts)), n)
        total = np.bincount(of, weights=length, minlength=len(texts))
        mean = np.where(total > 0, np.bincount(of, weights=length * p, minlength=len(texts)) / np.maximum(total, 1), field.prior)
        made: dict[str, list] = {out: np.clip(mean, 0, 1).tolist()}
        if lines_out:
            at = np.concatenate(([0], np.cumsum(n)))
            made[lines_out] = [p[at[i] : at[i + 1]].tolist() for i in range(len(texts))]
        return made

    return map_rows(df, [text_col], f"{out} double" + (f", {lines_out} array<double>" if lines_out else ""), scored)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, by a field that learned from the labels that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    field = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, field).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
