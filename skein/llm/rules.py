"""Quality rules as a short-circuit cascade.

Every rule has a predicate that says whether it rejects a text, and names the figures it needs. On a
sample the figures are timed and the rules' rejections noted; the cascade then asks next, of the
rules left, the one with most rejections per second, counting only texts that no earlier rule
rejects and figures that no earlier rule has computed. A text that one rule rejects is not shown to
the rules after it. The order changes what a run costs, never a verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import documents, map_rows, slices

#: Rows on which costs and selectivities are estimated, whatever the input's size (a drawing of each row by itself, so about as many).
SAMPLE_ROWS = 1000
SYMBOLS = b"#*$%&|<>"


class Text:
    """What rules ask of a text; each figure is computed when first asked for. Words are runs without space and U+0009 to U+000D."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def bytes(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.bytes.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.bytes) - len(self.bytes.translate(None, b" \t\n\v\f\r")))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.bytes) - len(self.bytes.translate(None, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [x for x in self.bytes.split(b"\n") if x.strip()]
        return len(lines) - len(set(lines))

    @cached_property
    def n_lines(self) -> int:
        return sum(1 for x in self.bytes.split(b"\n") if x.strip())

    @cached_property
    def n_repeat_words(self) -> int:
        words = self.words
        n = len(words)
        if n < 4:
            return 0
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
        pair = ids[:-1] * len(number) + ids[1:]
        if len(number) >= 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * len(number) + ids[2:]
        order = np.argsort(window, kind="stable")
        ordered = window[order]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(n - 2, dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        return int(covered.sum())

    @cached_property
    def n_upper(self) -> int:
        return len(self.bytes) - len(self.bytes.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    @cached_property
    def n_lower(self) -> int:
        return len(self.bytes) - len(self.bytes.translate(None, b"abcdefghijklmnopqrstuvwxyz"))

    @cached_property
    def n_exclaims(self) -> int:
        return self.bytes.count(b"!")


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Text], bool]


#: The two base rules first, then the cascade's own.
RULES = (
    Rule("few_words", ("bytes", "words"), lambda t: t.n_words < 50),
    Rule("repeated_words", ("bytes", "words", "n_repeat_words"), lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("symbols", ("bytes", "n_symbols", "word_chars"), lambda t: 20 * t.n_symbols > t.word_chars),
    Rule("repeated_lines", ("bytes", "n_dup_lines", "n_lines"), lambda t: 100 * t.n_dup_lines > 50 * t.n_lines),
    Rule("word_length", ("bytes", "words", "word_chars"), lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 20 * t.n_words),
    Rule("upper_case", ("bytes", "n_upper", "n_lower"), lambda t: t.n_upper > t.n_lower),
    Rule("exclamations", ("bytes", "words", "n_exclaims"), lambda t: 2 * t.n_exclaims > t.n_words),
)
BASE = ("few_words", "repeated_words")
#: Rules for filtering a corpus: a short text is not bad by itself, one without words is.
FILTERS = (Rule("no_words", ("bytes", "words"), lambda t: t.n_words == 0), *RULES[1:])
#: Figures in an order in which each finds what it builds on at hand.
FIGURES = ("bytes", "words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_lower", "n_exclaims")


def estimated(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], dict[int, int]]:
    """(seconds a text that each figure takes once those before it are at hand; how many texts each set of rules rejects, as bits), on about sample_rows rows drawn with a fixed seed.

    Sums reach the driver, not texts. An empty table gives zeros.
    """
    n = df.count()
    if n == 0:
        return dict.fromkeys(FIGURES, 0.0), {}
    drawn = df.select(F.col(text_col).alias("text")).sample(fraction=min(1.0, sample_rows / n), seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, sets = [0.0] * len(FIGURES), Counter()
        for b in slices(batches):
            for value in b["text"].to_pylist():
                t = Text(value)
                for k, figure in enumerate(FIGURES):
                    began = time.perf_counter()
                    getattr(t, figure)
                    took[k] += time.perf_counter() - began
                sets[sum(1 << k for k, r in enumerate(rules) if r.rejects(t))] += 1
        keys = [*range(-len(FIGURES), 0), *sets]
        yield pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.int64()), "s": pa.array([*took, *[0.0] * len(sets)], pa.float64()), "n": pa.array([0] * len(FIGURES) + list(sets.values()), pa.int64())})

    rows = drawn.mapInArrow(run, "k long, s double, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # at most 2^rules + figures
    sets = {r["k"]: r["n"] for r in rows if r["k"] >= 0}
    seen = max(1, sum(sets.values()))
    cost = {r["k"]: r["s"] / seen for r in rows if r["k"] < 0}
    return {f: cost.get(k - len(FIGURES), 0.0) for k, f in enumerate(FIGURES)}, sets


def ordered(rules: tuple[Rule, ...], cost: dict[str, float], sets: dict[int, int], at_hand: tuple[str, ...] = ()) -> list[Rule]:
    """Rules in the cascade's order: most rejections per second first, of texts and with figures that the rules before leave; ties as given.

    at_hand are figures that are computed for every text anyway and so cost nothing.
    """
    known, left, alive, out = set(at_hand), list(range(len(rules))), dict(sets), []
    while left:
        def rate(k: int) -> float:
            price = sum(cost[f] for f in rules[k].needs if f not in known)
            return sum(n for s, n in alive.items() if s >> k & 1) / max(price, 1e-9)

        best = max(left, key=lambda k: (rate(k), -k))
        left.remove(best)
        out.append(rules[best])
        known.update(rules[best].needs)
        alive = {s: n for s, n in alive.items() if not s >> best & 1}
    return out


def cascade(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, base: bool = False, kept: str = "kept", by: str = "rejected_by") -> DataFrame:
    """df with the columns kept, boolean, and by, string (the rule that ended the cascade; null if kept).

    With base, also n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and
    base_failed boolean. A null text counts as empty. Every row gets its verdict, repeated rows
    too; columns of these names in df are replaced. More than one rule may reject a text:
    by is the first in this run's order.
    """
    base_rules = [r for r in RULES if r.name in BASE]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = ordered(rules, *estimated(df, text_col, rules, sample_rows), at_hand=("bytes", "words", *names) if base else ())

    def judge(values: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in (*names, "base_failed", kept, by)}
        for v in values:
            t = Text(v)
            ended = next((r.name for r in order if r.rejects(t)), None)
            out[kept].append(ended is None)
            out[by].append(ended)
            if base:
                for k in names:
                    out[k].append(getattr(t, k))
                out["base_failed"].append(any(r.rejects(t) for r in base_rules))
        return out

    figures = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " if base else ""
    return map_rows(df, [text_col], figures + f"{kept} boolean, {by} string", judge)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's figures and verdict."""
    judged = cascade(documents(spark, sf_dir).select("doc_id", "text"), base=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
p as (select r, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
x as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as x from p),
y as (select r, i, count(*) over (partition by r, x) as n from x),
z as (select r, count(distinct k) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as k from y where n > 1) group by r),
f as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(ls) as n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) as n_lower, length(text) - length(replace(text, '!', '')) as n_exclaims
  from w left join z using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 20 * n_symbols > word_chars or 100 * n_dup_lines > 50 * n_lines
    or word_chars < 2 * n_words or word_chars > 20 * n_words or n_upper > n_lower or 2 * n_exclaims > n_words) as kept
from f
"""
