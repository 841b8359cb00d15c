"""Runs of repeated words, by refining classes of equal factors (Crochemore's partitioning).

Two positions of a text are in one class at length l if the l words from either are the same. The
classes of length 1 are refined to those of 2, 3 and so on: positions part if the positions after
them have parted. Of the parts of a class all but the largest do the splitting of the next length
(the smaller half), so a position is handled a logarithmic number of times. Members of a class that
are neighbours at a distance of the length itself are the start of a square; stretches of such
starts are merged into a run with that period.

A run of LEAST_POWER periods or more has each of its factors, up to a period's length, three times
at least. So a class of fewer than three positions is given up, which ends prose after a few words.
The texts of a batch are refined side by side, as one sequence in which no factor crosses a text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import SLICE_BYTES, documents, map_rows

#: A run has so many words, and so many times its period, at least.
LEAST_WORDS = 6
LEAST_POWER = 4
#: Members below which a class can hold no factor of such a run.
LEAST_MEMBERS = LEAST_POWER - 1
#: With fewer positions than this to move, they are moved one by one.
FEW = 24


class Classes:
    """The classes of equal factors of one length: order holds the positions class by class, in slots first[c] to first[c] + size[c]."""

    def __init__(self, keys: np.ndarray, alive: np.ndarray):
        """keys: a number for each position, equal for equal words of one text; alive: False for the gap after each text."""
        n = len(keys)
        at = np.flatnonzero(alive)
        at = at[np.argsort(keys[at], kind="stable")]
        new = np.ones(len(at), dtype=bool)
        new[1:] = keys[at[1:]] != keys[at[:-1]]
        number = np.cumsum(new) - 1
        size = np.bincount(number) if len(at) else np.zeros(0, dtype=np.int64)
        keep = size >= LEAST_MEMBERS
        renamed = np.cumsum(keep)
        held = keep[number] if len(at) else np.zeros(0, dtype=bool)
        self.order = at[held]
        #: Class of each position, from 1; 0: given up.
        self.of = np.zeros(n + 1, dtype=np.int64)
        self.of[self.order] = renamed[number[held]]
        room = len(self.order) + 2
        self.size, self.first = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int64)
        self.known = int(keep.sum()) + 1
        self.size[1 : self.known] = size[keep]
        self.first[1 : self.known] = np.concatenate(([0], np.cumsum(size[keep])[:-1])) if keep.any() else []
        self.slot = np.zeros(n + 1, dtype=np.int64)
        self.slot[self.order] = np.arange(len(self.order))
        # Neighbours within a class, by position; n stands for none.
        self.next, self.last = np.full(n + 1, n), np.full(n + 1, n)
        self.none = n
        self._link(self.order, self.of[self.order])
        self.gone = np.flatnonzero(self.of[:n] == 0)
        self.splitters = self.order.copy()

    def _link(self, x: np.ndarray, group: np.ndarray) -> None:
        """Neighbours of x, which is sorted by group and position and holds whole classes."""
        same = group[1:] == group[:-1]
        self.next[x], self.last[x] = self.none, self.none
        self.next[x[:-1][same]] = x[1:][same]
        self.last[x[1:][same]] = x[:-1][same]

    def _unlink(self, x: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Take x, sorted by class and position, out of their classes' chains; the positions whose next one changed."""
        begins = np.ones(len(x), dtype=bool)
        begins[1:] = (group[1:] != group[:-1]) | (self.last[x[1:]] != x[:-1])
        ends = np.concatenate((begins[1:], [True]))
        before, after = self.last[x[begins]], self.next[x[ends]]
        self.next[before] = after
        self.last[after] = before
        self.next[self.none] = self.last[self.none] = self.none
        return before[before != self.none]

    def refine(self) -> np.ndarray:
        """On to the next length; the positions whose next neighbour is another one now."""
        if len(self.gone) + len(self.splitters) < FEW and not len(self.splitters):
            return self._refine_few()
        n = self.none
        lost = self.gone[self.gone > 0] - 1
        lost = lost[self.of[lost] > 0]
        by = self.splitters[self.splitters > 0]
        moved = by - 1
        held = self.of[moved] > 0
        moved, by = moved[held], self.of[by[held]]
        # Parts of each class: by the class of what follows; 0 for what is given up.
        x = np.concatenate((lost, moved))
        part = np.concatenate((np.zeros(len(lost), dtype=np.int64), by))
        if not len(x):
            self.gone = self.splitters = x
            return x
        c = self.of[x]
        o = np.lexsort((x, part, c))
        x, part, c = x[o], part[o], c[o]
        head = np.ones(len(x), dtype=bool)
        head[1:] = (c[1:] != c[:-1]) | (part[1:] != part[:-1])
        heads = np.flatnonzero(head)
        members = np.diff(np.append(heads, len(x)))
        parent = c[heads]
        stays = self.size[parent] - np.bincount(parent, weights=members, minlength=self.known)[parent].astype(np.int64)
        # A class all of which moves as one part stays as it is.
        still = (members == self.size[parent]) & (part[heads] > 0)
        if still.any():
            kept = ~np.repeat(still, members)
            x, c = x[kept], c[kept]
            members, parent, stays, given_up = members[~still], parent[~still], stays[~still], (part[heads] == 0)[~still]
            if not len(x):
                self.gone = self.splitters = x
                return x
        else:
            given_up = part[heads] == 0
        # Out of their classes, to the end of their slots there, part by part.
        by_place = np.lexsort((x, c))
        changed = self._unlink(x[by_place], c[by_place])
        self._to_the_end(x, c)
        fresh = np.arange(self.known, self.known + len(members))
        self._room(len(members))
        self.first[fresh] = self.slot[x[np.concatenate(([0], np.cumsum(members)[:-1]))]]
        self.size[fresh] = members
        self.of[x] = np.repeat(fresh, members)
        self._link(x, self.of[x])
        parents, where = np.unique(parent, return_index=True)
        self.size[parents] = stays[where]
        # What is too small now is given up, too.
        parts = np.concatenate((fresh, parents))
        dies = (self.size[parts] < LEAST_MEMBERS) | np.concatenate((given_up, np.zeros(len(parents), dtype=bool)))
        family = np.concatenate((parent, parents))
        largest = np.lexsort((self.size[parts], ~dies, family))
        top = np.zeros(len(parts), dtype=bool)
        top[largest[np.append(family[largest][1:] != family[largest][:-1], True)]] = True
        self.gone = self._members(parts[dies])
        self.splitters = self._members(parts[~dies & ~top])
        self.of[self.gone] = 0
        self.size[parts[dies]] = 0
        changed = np.concatenate((changed, x))
        return changed[(self.of[changed] > 0) & (changed < n)]

    def _members(self, classes: np.ndarray) -> np.ndarray:
        size = self.size[classes]
        at = np.repeat(self.first[classes] - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(size) else size
        return self.order[at + np.arange(len(at))]

    def _room(self, more: int) -> None:
        self.known += more
        if self.known > len(self.size):
            self.size, self.first = (np.concatenate((a, np.zeros(max(len(a), more), dtype=np.int64))) for a in (self.size, self.first))

    def _to_the_end(self, x: np.ndarray, c: np.ndarray) -> None:
        """x, sorted by class c, into the last slots of its classes, in that order; what was there fills the slots left."""
        head = np.ones(len(x), dtype=bool)
        head[1:] = c[1:] != c[:-1]
        heads = np.flatnonzero(head)
        m = np.diff(np.append(heads, len(x)))
        begin = (self.first[c[heads]] + self.size[c[heads]] - m)
        target = np.repeat(begin - heads, m) + np.arange(len(x))
        old = self.slot[x]
        inside = old >= np.repeat(begin, m)
        held = np.zeros(len(x), dtype=bool)
        held[(old - np.repeat(begin - heads, m))[inside]] = True  # target slots that x has already
        out = self.order[target[~held]]
        free = old[~inside]
        self.order[free] = out
        self.slot[out] = free
        self.order[target] = x
        self.slot[x] = target

    def _refine_few(self) -> np.ndarray:
        """As refine(), for a few positions given up and no other splitters."""
        of, size, first, order, slot, nxt, last = self.of, self.size, self.first, self.order, self.slot, self.next, self.last
        gone, changed, small = [], [], set()
        for g in self.gone.tolist():
            x = g - 1
            if g and (c := of[x]):
                before, after = last[x], nxt[x]
                nxt[before], last[after] = after, before
                if before != self.none:
                    changed.append(before)
                end = first[c] + size[c] - 1
                other, own = order[end], slot[x]
                order[own], slot[other], order[end], slot[x] = other, own, x, end
                size[c] -= 1
                of[x] = 0
                gone.append(x)
                if size[c] < LEAST_MEMBERS:
                    small.add(c)
        nxt[self.none] = last[self.none] = self.none
        for c in small:
            rest = order[first[c] : first[c] + size[c]].tolist()
            of[rest] = 0
            size[c] = 0
            gone += rest
        self.gone = np.array(gone, dtype=np.int64)
        return np.array([x for x in changed if of[x]], dtype=np.int64)


def runs_of(sequences: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each sequence of numbers its runs (start, length, period), sorted: maximal stretches of that smallest period with LEAST_WORDS members and LEAST_POWER periods at least."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    sizes = np.array([len(s) for s in sequences], dtype=np.int64)
    if not len(sizes) or sizes.max() < LEAST_WORDS:
        return found
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    total = int(begin[-1])
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    words, alive = np.zeros(total, dtype=np.int64), np.ones(total, dtype=bool)
    alive[begin[1:] - 1] = False
    words[alive] = np.concatenate(sequences)
    classes = Classes(text * (int(words.max()) + 1) + words, alive)
    longest = sizes // LEAST_POWER
    most = int(longest.max())
    due: dict[int, list[np.ndarray]] = defaultdict(list)

    def expect(x: np.ndarray, length: int) -> None:
        """Squares may begin at x once the length is the distance to their next neighbours."""
        gap = classes.next[x] - x
        fits = (classes.next[x] < total) & (gap >= length) & (gap <= longest[text[x]])
        if len(x) < FEW:
            for g, y in zip(gap[fits].tolist(), x[fits].tolist()):
                due[g].append(np.array([y]))
            return
        x, gap = x[fits], gap[fits]
        o = np.argsort(gap, kind="stable")
        x, gap = x[o], gap[o]
        cuts = np.flatnonzero(np.append(True, gap[1:] != gap[:-1])) if len(gap) else gap
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(gap)]):
            due[int(gap[a])].append(x[a:b])

    expect(classes.order, 1)
    length = 1
    while length <= most:
        if length in due:
            x = np.unique(np.concatenate(due.pop(length)))
            x = x[(classes.of[x] > 0) & (classes.next[x] - x == length)]
            if len(x):
                cut = np.flatnonzero(np.append(True, np.diff(x) != 1))
                for a, b in zip(x[cut].tolist(), x[np.append(cut[1:], len(x)) - 1].tolist()):
                    if (n := b - a + 2 * length) >= max(LEAST_WORDS, LEAST_POWER * length):
                        found[text[a]].append((a - int(begin[text[a]]), n, length))
        if not len(classes.gone) and not len(classes.splitters):  # nothing will part any more
            if not due:
                break
            length = min(due)
            continue
        length += 1
        expect(classes.refine(), length)
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def word_lists(texts: list[str | None]) -> list[list[bytes]]:
    """The words of each text: what space and U+0009 to U+000D separate, which is how bytes are split."""
    return [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def periodic(df: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """df with runs_col, array<struct<start long, length long, period long>> by start and period, and collapsed_col: the words left, joined by one space.

    A run is a stretch of words, as long as can be, whose smallest period (words that far apart are
    the same) is in it four times and that has six words or more. Words that a run holds after its
    first period are left out. A null or blank text has no runs and nothing left. Texts are whole;
    every row stays, columns of these names are replaced; memory follows the longest text.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        words = word_lists(texts)
        number = defaultdict(count().__next__)
        found = runs_of([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words])
        return {
            runs_col: [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found],
            collapsed_col: [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, found)],
        }

    return map_rows(df, [text_col], f"{runs_col} array<struct<start long, length long, period long>>, {collapsed_col} string", run, rows=SLICE_BYTES >> 10)


def damaged(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, and for each tenth document (CRC32 of its id) the words from some place on in periods, joined by spaces."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def periods(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.concat(F.slice(w, 1, a.cast("int")), F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(w, (a + i % p).cast("int")))), " ")

    # The words are bound once, as the only element of an array.
    with_words = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periods(w)).otherwise("")), 0)
    return F.when(h % 10 == 0, with_words).otherwise(F.col(text_col))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, a tenth of them made periodic: its runs, that with the greatest exponent, and digests of the runs and of the words left."""
    docs = documents(spark, sf_dir).select("doc_id", damaged().alias("text"))
    r = periodic(docs)
    # length / period is compared exactly, by products; the first of equals stays.
    higher = lambda x, y: F.when((x["length"] * y["period"]) < (y["length"] * x["period"]), y).otherwise(x)
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", 0), higher)
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
