"""Repair of conversations by deduplicated signatures.

The rows of a conversation become a string with a letter for each row: its role (s, u, a; o for
others), as a capital if the text is cut short, or x if the row has to go. Which edits turn such a
string into system?, (user, assistant)+ at the least cost depends on the string only, so each
distinct one is solved once, by a memoised recursion on halves; the answers are joined back and
replayed on the rows.

Rows are sorted by ranges of (conversation, turn), so that a conversation of very many turns lies
in many tasks, and cut into segments of at most SEGMENT rows, each with a signature. The answer for
a segment is a table: for each pair of states before and after it the least cost and, of the edits
that have it, those least in ASCII order. A conversation's tables are chained from its end; with
equal cost the edits that differ first decide, and no answer is a prefix of another of the same
segment (each ends with its last row), so ranks of the answers stand for the strings there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import broadcast_if_small, checkpointed, map_rows, slices, table

SEGMENT = 512
#: And so many characters, in about; a longer text is a segment by itself.
SEGMENT_CHARS = 1 << 20
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
#: Repeated texts that are sent to all tasks, at most; beyond it they are joined by a shuffle.
MOST_REPEATED = 100_000
#: Before any row; after a system row; after a user row; after an assistant row (which may be the end, as may the first).
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {(START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT, (START, "s"): SYSTEM}
#: By inserted rows: state before, and (state after, rows) of as few as possible.
_INSERTED = {START: ((START, 0), (USER, 1), (ASSISTANT, 2)), SYSTEM: ((SYSTEM, 0), (USER, 1), (ASSISTANT, 2)), USER: ((USER, 0), (ASSISTANT, 1)), ASSISTANT: ((ASSISTANT, 0), (USER, 1))}
#: Rows to insert at the end.
_TO_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
Table = tuple[tuple[tuple[int, str] | None, ...], ...]


@lru_cache(maxsize=1 << 14)
def solve(signature: str) -> Table:
    """For each state before and after: (least cost, edits least in ASCII order), or None if no edits lead there. Rows may be inserted before each row."""
    best: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]

    def offer(a: int, b: int, cost: int, edits: str) -> None:
        if best[a][b] is None or (cost, edits) < best[a][b]:
            best[a][b] = (cost, edits)

    if len(signature) > 1:
        left, right = solve(signature[: len(signature) // 2]), solve(signature[len(signature) // 2 :])
        for a in range(4):
            for m, first in enumerate(left[a]):
                for b, second in enumerate(right[m]) if first else ():
                    if second:
                        offer(a, b, first[0] + second[0], first[1] + second[1])
        return tuple(map(tuple, best))
    role, cut = signature.lower(), TRUNCATED * signature.isupper()
    for a in range(4):
        for m, n in _INSERTED[a] if signature else ((a, 0),):
            cost, edits = n * COST[INSERT], INSERT * n
            if not signature:
                offer(a, m, 0, "")
                continue
            offer(a, m, cost + COST[DELETE], edits + DELETE)
            if role != "x":
                for to, edit in ((role, KEEP), ("u", REROLE), ("a", REROLE)):
                    if (m, to) in _AFTER:
                        offer(a, _AFTER[m, to], cost + COST[edit] + cut, edits + edit)
    return tuple(map(tuple, best))


def chained(costs: list[list[int | None]], ranks: list[list[int | None]]) -> tuple[int, list[int]]:
    """(least cost, states before each segment and at the end) of segments with these costs and ranks, 16 each, by state before and after."""
    total = [n * COST[INSERT] for n in (_TO_END[s] for s in range(4))]
    chosen: list[list[int]] = []
    for cost, rank in zip(reversed(costs), reversed(ranks)):
        options = [min(((cost[4 * a + b] + total[b], rank[4 * a + b], b) for b in range(4) if cost[4 * a + b] is not None), default=None) for a in range(4)]
        total = [o[0] if o else 1 << 60 for o in options]
        chosen.append([o[2] if o else -1 for o in options])
    path = [START]
    for to in reversed(chosen):
        path.append(to[path[-1]])
    return total[START], path


def replayed(roles: list[str], texts: list[str], copies: list[int], before: int, edits: str) -> tuple[list[str], list[str], list[str]]:
    """(roles, texts, edits) of the rows that edits leave, the state before them given."""
    out: tuple[list[str], list[str], list[str]] = ([], [], [])
    rows = ((r, t) for r, t, n in zip(roles, texts, copies) for _ in range(n))
    state = before
    for edit in edits:
        role, text = ("", "") if edit == INSERT else next(rows)
        if edit == DELETE:
            continue
        if edit == KEEP:
            state = _AFTER[state, role[:1]]
        else:
            state = ASSISTANT if state == USER else USER
            role = "assistant" if state == ASSISTANT else "user"
        for column, value in zip(out, (role, text, edit)):
            column.append(value)
    return out


_SEGMENT = "conv bigint, part int, k int, signature string, roles array<string>, texts array<string>, copies array<int>, n int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint, least_turn bigint, n_turns bigint"
_LEGAL = {"su", "ua", "au"}


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Segments, of at most so many rows, of sorted rows (conv, turn, role, text, n, blank, again, cut); a row stands for n that are alike."""
    part, k = TaskContext.get().partitionId(), 0
    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _SEGMENT.split(", ")])
    rows: list[dict] = []
    now: dict | None = None
    chars = 0

    def opened(conv: int | None) -> dict:
        return dict.fromkeys(names) | {"conv": conv, "part": part, "k": k, "signature": [], "roles": [], "texts": [], "copies": [], **dict.fromkeys(("n", "blank", "duplicate", "truncated", "illegal", "n_turns"), 0)}

    def closed(x: dict) -> dict:
        return x | {"signature": "".join(x["signature"])}

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for b in slices(batches):
        for conv, turn, role, text, n, blank, again, cut in zip(*(b[c].to_pylist() for c in ("conv", "turn", "role", "text", "n", "blank", "again", "cut"))):
            whole = True
            while n:
                if now is None or now["conv"] != conv or now["n"] >= most or chars >= SEGMENT_CHARS:
                    if now is not None:
                        rows.append(closed(now))
                        if sum(len(r["texts"]) for r in rows) >= 4 * SEGMENT or chars >= SEGMENT_CHARS:
                            yield batch()
                            rows = []
                    now, chars, k = opened(conv), 0, k + 1
                m = min(n, most - now["n"])
                new = 0 if again or not whole else 1  # copies after the first are duplicates
                initial = role[:1]
                now["roles"].append(role)
                now["texts"].append(text)
                now["copies"].append(m)
                letter = initial if initial in ("s", "u", "a") else "o"
                now["signature"].append("x" * m if blank else (letter.upper() if cut else letter) * new + "x" * (m - new))
                now["blank"] += m if blank else 0
                now["duplicate"] += 0 if blank else m - new
                now["truncated"] += new if cut and not blank else 0
                if now["n"]:
                    now["illegal"] += now["last_initial"] + initial not in _LEGAL
                else:
                    now["first_initial"], now["first_turn"] = initial, turn
                now["illegal"] += (m - 1) * (initial + initial not in _LEGAL)
                if turn is not None:
                    now["n_turns"] += now["n"] == 0 or now["last_turn"] != turn
                    now["least_turn"] = turn if now["least_turn"] is None else now["least_turn"]
                now["last_initial"], now["last_turn"] = initial, turn
                now["n"] += m
                chars += len(text)
                n -= m
                whole = False
    if now is not None:
        rows.append(closed(now))
    if rows:
        yield batch()


def segments(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = SEGMENT) -> DataFrame:
    """The conversations' segments, written once: their signatures, rows and what to count faults from."""
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    rows = df.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    alike = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).cast("int").alias("n"))
    same = F.unhex(F.sha2(F.concat_ws("\x00", F.length("role"), "role", "text"), 256))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    repeated = rows.select("conv", "turn", same.alias("same")).groupBy("conv", "same").agg(F.min(order).alias("first"), F.max(order).alias("last")).filter(F.col("first") != F.col("last"))
    r = broadcast_if_small(repeated.select(F.col("conv").alias("__conv"), F.col("same").alias("__same"), F.col("first.turn").alias("__turn")), F.lit(1), MOST_REPEATED)
    marked = alike.withColumn("same", same)
    met = marked.join(r, marked["conv"].eqNullSafe(r["__conv"]) & (marked["same"] == r["__same"]), "left")
    solid = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    faults = met.select(
        "conv", "turn", "role", "text", "n", (solid == "").alias("blank"), (F.col("__same").isNotNull() & ~F.col("turn").eqNullSafe(F.col("__turn"))).alias("again"),
        (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    by = ["conv", "turn", "role", "text"]
    return checkpointed(faults.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(*by).mapInArrow(lambda b: _segments(b, most), _SEGMENT))


_PATH = "cost bigint, path array<int>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, gaps bigint"


def solved(found: DataFrame) -> DataFrame:
    """signature, costs, ranks and edits (by state before and after, 16 each) of the distinct signatures of segments."""

    def answers(signatures: list[str]) -> dict[str, list]:
        tables = [[x for row in solve(s) for x in row] for s in signatures]
        order = [{e: i for i, e in enumerate(sorted({x[1] for x in t if x}))} for t in tables]
        return {"costs": [[x and x[0] for x in t] for t in tables], "ranks": [[x and o[x[1]] for x in t] for t, o in zip(tables, order)], "edits": [[x and x[1] for x in t] for t in tables]}

    return checkpointed(map_rows(found.select("signature").distinct(), ["signature"], "costs array<int>, ranks array<int>, edits array<string>", answers))


def chosen(found: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each conversation: its cost, the states between its segments and its faults; segs has what identifies them, in order."""
    bare = found.join(answers.drop("edits"), "signature")
    seg = F.struct("part", "k", "costs", "ranks", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "first_turn", "last_turn", "least_turn", "n_turns")
    each = bare.groupBy("conv").agg(F.array_sort(F.collect_list(seg)).alias("segs"))  # one small row for SEGMENT turns

    def chain(convs: list[list[dict]]) -> dict[str, list]:
        out: dict[str, list] = {c.split()[0]: [] for c in _PATH.split(", ")}
        for segs in convs:
            cost, path = chained([s["costs"] for s in segs], [s["ranks"] for s in segs])
            pairs = list(zip(segs, segs[1:]))
            turns = sum(s["n_turns"] for s in segs) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in pairs)
            least = next((s["least_turn"] for s in segs if s["least_turn"] is not None), None)
            out["cost"].append(cost)
            out["path"].append(path)
            for c in ("blank", "duplicate", "truncated"):
                out[c].append(sum(s[c] for s in segs))
            out["illegal"].append(sum(s["illegal"] for s in segs) + sum(a["last_initial"] + b["first_initial"] not in _LEGAL for a, b in pairs))
            out["gaps"].append(0 if least is None else segs[-1]["last_turn"] - least + 1 - turns)
        return out

    keys = F.transform("segs", lambda s: F.struct(s["part"].alias("part"), s["k"].alias("k")))
    return checkpointed(map_rows(each, ["segs"], _PATH, chain).withColumn("segs", keys))


def repaired(found: DataFrame, answers: DataFrame, paths: DataFrame) -> DataFrame:
    """conv, at (the segment's number in it), parts (how many it has), audit, and roles, texts, edits of the rows left, for each segment."""
    steps = paths.select(F.size("segs").alias("parts"), "path", F.posexplode("segs").alias("at", "seg")).select("seg.part", "seg.k", "at", "parts", F.get("path", F.col("at")).alias("before"), F.get("path", F.col("at") + 1).alias("after"))
    met = found.select("conv", "part", "k", "signature", "roles", "texts", "copies").join(steps, ["part", "k"]).join(answers.select("signature", "edits"), "signature")
    end = F.when(F.col("at") + 1 == F.col("parts"), F.repeat(F.lit(INSERT), F.element_at(F.array(*[F.lit(_TO_END[s]) for s in range(4)]), F.col("after") + 1))).otherwise("")
    one = met.select("conv", "at", "parts", "before", "roles", "texts", "copies", F.concat(F.get("edits", 4 * F.col("before") + F.col("after")), end).alias("audit"))

    def replay(roles, texts, copies, before, audit) -> dict[str, list]:
        done = [replayed(*x) for x in zip(roles, texts, copies, before, audit)]
        return {"roles": [d[0] for d in done], "texts": [d[1] for d in done], "edits": [d[2] for d in done], "audit": audit, "before": before, "copies": copies}

    return map_rows(one, ["roles", "texts", "copies", "before", "audit"], "roles array<string>, texts array<string>, edits array<string>, audit string, before int, copies array<int>", replay).drop("before", "copies")


def repair(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = SEGMENT) -> DataFrame:
    """The repaired rows: id_col, segment and position (their order), role, text, edit (K kept, R given another role, I inserted).

    Rows are taken by turn, nulls first, ties by role and text; null roles and texts are one space.
    Blank rows and repeats of an earlier role and text are deleted. The others are kept, get another
    role or go, and rows without text are put in, as costs least, so that the roles' initials read
    (s?(ua)+)?. A conversation may end with no rows. A null id is a conversation by itself.
    """
    found = segments(df, id_col, turn_col, role_col, text_col, most)
    answers = solved(found)
    left = repaired(found, answers, chosen(found, answers))
    return left.select(F.col("conv").alias(id_col), F.col("at").alias("segment"), F.posexplode(F.arrays_zip("roles", "texts", "edits")).alias("position", "x")).select(id_col, "segment", "position", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"), F.col("x.edits").alias("edit"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, audit, repaired_sha256 from sorted segments (conv, at, audit, lines): a conversation's hash goes from segment to segment, and nothing else is held but its audit."""
    now, sha, audit, empty = None, None, [], True

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv": pa.array([now[0]], pa.int64()), "audit": ["".join(audit)], "repaired_sha256": [sha.hexdigest()]})

    for b in slices(batches):
        for conv, part, lines in zip(b["conv"].to_pylist(), b["audit"].to_pylist(), b["lines"].to_pylist()):
            if now != (conv,):
                if now is not None:
                    yield done()
                now, sha, audit, empty = (conv,), hashlib.sha256(), [], True
            audit.append(part)
            if lines is not None:
                sha.update((("" if empty else "\n") + lines).encode("utf-8", "surrogatepass"))
                empty = False
    if now is not None:
        yield done()


def audited(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = SEGMENT) -> DataFrame:
    """A row for each conversation: id_col, gaps, its faults, cost, audit (the edits in order) and repaired_sha256 of the repaired role:text lines.

    Of several faults of a row the first of blank, duplicate, truncated counts. gaps: turns missing between the least and the greatest.
    """
    found = segments(df, id_col, turn_col, role_col, text_col, most)
    answers = solved(found)
    paths = chosen(found, answers)
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"]))
    left = repaired(found, answers, paths).select("conv", "at", "parts", "audit", F.when(F.size("roles") > 0, F.array_join(lines, "\n")).alias("lines"))
    # Conversations of one segment are hashed where they are; the others' segments meet, in order.
    short = left.filter(F.col("parts") == 1).select("conv", "audit", F.sha2(F.coalesce("lines", F.lit("")), 256).alias("repaired_sha256"))
    long = left.filter(F.col("parts") > 1).repartition("conv").sortWithinPartitions("conv", "at").select("conv", "audit", "lines").mapInArrow(_hashed, "conv bigint, audit string, repaired_sha256 string")
    hashed = short.unionByName(long)
    met = paths.join(hashed.withColumnRenamed("conv", "__conv"), F.col("conv").eqNullSafe(F.col("__conv")))
    return met.select(F.col("conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with faults put in, by the CRC32 of conv_id:turn."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("k")).filter(F.col("k") != 0)
    changed = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), "k")
    return out.withColumn("again", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k", "again")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired: its faults, the cost and edits of the repair, and a digest of what comes out."""
    rows = table(spark, sf_dir, "conversations")
    ids = rows.groupBy(F.col("conv_id").alias("__id")).agg(F.lit(1).alias("__one"))
    done = audited(damaged(rows))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return ids.join(done, F.col("__id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("__id").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


OP13_SQL = r"""
with recursive
keyed as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
summed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(key, ''), lambda c: ascii(c)::bigint)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: case when y & 1 = 1 then xor(y >> 1, 3988292384::bigint) else y >> 1 end)), 4294967295::bigint) % 20 as k from keyed),
damaged as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(case when k = 3 then [0, 1] else [0] end) as copy from summed where k <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as final from damaged),
faulty as (select *, case when final = '' then 'b' when nth > 1 then 'd' when final not in ('.', '!', '?') then 't' else '' end as fault,
  role[1] as initial, lag(role[1]) over (partition by conv_id order by i) as before from numbered),
figures as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
  count(*) filter (fault = 't') as truncated, count(*) filter (i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal from faulty group by conv_id),
moves(a, c, b) as (values (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3), (0, 's', 1)),
inserts(a, b, n) as (values (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
options as (select conv_id, i, s.a as a, s.a as b, 3 as cost, 'D' as edit from faulty, (values (0), (1), (2), (3)) s(a)
  union all select conv_id, i, m.a, m.b, (fault = 't')::int, 'K' from faulty join moves m on m.c = initial where fault in ('', 't')
  union all select conv_id, i, m.a, m.b, 2 + (fault = 't')::int, 'R' from faulty, moves m where m.c <> 's' and fault in ('', 't')),
steps as (select o.conv_id, i, s.a, o.b, min({'cost': 2 * s.n + o.cost, 'audit': repeat('I', s.n) || o.edit}) as best from options o join inserts s on s.b = o.a group by all),
best as (select conv_id, 0::bigint as i, 0 as state, {'cost': 0, 'audit': ''} as best from figures
  union all select p.conv_id, s.i, s.b, min({'cost': p.best.cost + s.best.cost, 'audit': p.best.audit || s.best.audit}) from best p join steps s on s.conv_id is not distinct from p.conv_id and s.i = p.i + 1 and s.a = p.state group by p.conv_id, s.i, s.b),
ended as (select conv_id, min({'cost': best.cost + 2 * e.n, 'audit': best.audit || repeat('I', e.n)}) as best from best join figures f using (conv_id) join (values (0, 0), (1, 2), (2, 1), (3, 0)) e(state, n) using (state) where best.i = f.n group by conv_id),
edits as (select conv_id, unnest(string_split(best.audit, '')) as edit, unnest(range(1, length(best.audit) + 1)) as pos from ended where best.audit <> ''),
placed as (select *, sum((edit <> 'I')::int) over w as i, sum((edit <> 'D')::int) over w as place from edits window w as (partition by conv_id order by pos)),
met as (select p.conv_id, p.pos, p.place, p.edit, f.role, f.text, f.initial from placed p left join faulty f on f.conv_id is not distinct from p.conv_id and f.i = p.i and p.edit <> 'I' where p.edit <> 'D'),
shifted as (select *, max((place = 1 and edit = 'K' and initial = 's')::int) over (partition by conv_id) as s from met),
texts as (select conv_id, string_agg((case when edit = 'K' then role when (place - s) % 2 = 1 then 'user' else 'assistant' end) || ':' || coalesce(text, ''), chr(10) order by pos) as text from shifted group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(e.best.cost, 0)::bigint as cost, coalesce(e.best.audit, '') as audit, sha256(coalesce(t.text, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join figures f on f.conv_id is not distinct from c.conv_id left join ended e on e.conv_id is not distinct from c.conv_id left join texts t on t.conv_id is not distinct from c.conv_id
"""
