"""Document fingerprints: a Merkle tree over a text's sections, paragraphs and pieces.

Sections are split at an empty line, paragraphs at a line feed, and a paragraph into pieces after
punctuation or, without any, after 32 code points: an edit changes the pieces it touches, and later
ones only up to the next punctuation mark. A piece's hash comes from its characters, every other hash from the hashes below
it, so equal roots mean equal texts, and where roots differ, the branches that differ show where.
DataFrame functions only; a text's tree is an array of sections of paragraphs of piece hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import documents

PIECE_CHARS = 32
#: A piece: the fewest characters up to punctuation, if there is any within reach; else as many as fit.
PIECE_RE = rf"(?s).{{0,{PIECE_CHARS - 1}}}?[.,;:!?]|.{{1,{PIECE_CHARS}}}"
#: Rows that share a window when each document is set beside the one after it.
ROWS_PER_BUCKET = 1000
MAX_BUCKETS = 10_000


def tree(text: Column) -> Column:
    """array<array<array<string>>>: sections, paragraphs, hashes of pieces (16 hex digits)."""
    pieces = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE_RE), F.lit(0)), lambda x: F.substring(F.md5(x), 1, 16))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), pieces))


def branches(t: Column) -> Column:
    """array<struct<hash, paragraphs array<struct<hash, pieces>>>> of a tree: a section's hash is that of its paragraphs' hashes."""
    paragraphs = lambda s: F.transform(s, lambda p: F.struct(F.substring(F.sha2(F.array_join(p, ""), 256), 1, 16).alias("hash"), p.alias("pieces")))
    return F.transform(F.transform(t, paragraphs), lambda ps: F.struct(F.substring(F.sha2(F.array_join(F.transform(ps, lambda p: p["hash"]), ""), 256), 1, 16).alias("hash"), ps.alias("paragraphs")))


def root(b: Column) -> Column:
    """The whole text's hash (64 hex digits)."""
    return F.sha2(F.array_join(F.transform(b, lambda s: s["hash"]), ""), 256)


def written(b: Column) -> Column:
    """A tree as one string: root;section>paragraph.pieces,paragraph.pieces|section>..., of each piece 8 hex digits."""
    paragraph = lambda p: F.concat(p["hash"], F.lit("."), F.array_join(F.transform(p["pieces"], lambda x: F.substring(x, 1, 8)), ""))
    section = lambda s: F.concat(s["hash"], F.lit(">"), F.array_join(F.transform(s["paragraphs"], paragraph), ","))
    return F.concat(root(b), F.lit(";"), F.array_join(F.transform(b, section), "|"))


def leaves(t: Column) -> Column:
    """The different piece hashes of a tree."""
    return F.array_distinct(F.flatten(F.flatten(t)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of pieces that two trees' leaves() have in common (Dice); 1 for two empty texts."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / n)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """array<struct<section int, paragraph int>> (from 0): the paragraphs of branches() a that branches() b has nowhere.

    Branches are aligned by their hashes, so what was only moved, as by an insertion before it, has
    not changed. Sections that both have are passed over whole.
    """
    sections = F.transform(b, lambda s: s["hash"])
    known = F.flatten(F.transform(b, lambda s: F.transform(s["paragraphs"], lambda p: p["hash"])))
    place = lambda i, j: F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph"))

    def lacking(s: Column, i: Column) -> Column:
        found = F.filter(F.transform(s["paragraphs"], lambda p, j: F.when(~F.array_contains(known, p["hash"]), place(i, j))), lambda x: x.isNotNull())
        return F.when(F.array_contains(sections, s["hash"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(found)

    return F.flatten(F.transform(a, lacking))


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with a column out: the written tree of text_col. A null text counts as empty; repeated rows and other columns stay."""
    tmp = f"__branches_{out}"
    return df.withColumn(tmp, branches(tree(F.coalesce(F.col(text_col), F.lit(""))))).withColumn(out, written(F.col(tmp))).drop(tmp)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most value: first among every 100th, then among the 100 from there."""
    coarse = bounds[::100]
    groups = [bounds[i : i + 100] for i in range(0, len(bounds), 100)]
    if not bounds:
        return F.lit(0).cast("int")
    below = lambda a: F.size(F.filter(a, lambda x: x <= value))
    k = below(F.array(*[F.lit(int(x)) for x in coarse]))
    fine = F.array(*[F.array(*[F.lit(int(x)) for x in g]) for g in groups])
    return F.when(k == 0, F.lit(0)).otherwise((k - 1) * 100 + below(F.get(fine, k - 1))).cast("int")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Each row's id (an integer) and text (null: empty) with next_text, the text of the row that follows it by ascending id.

    After the last row comes the first. Rows of one id follow each other by text. A row without an
    id has no place in the order: its next_text is empty. No task gets all rows: ids are cut at
    percentiles into buckets of about rows_per_bucket rows, and each bucket also gets the first row
    of the bucket after it. Only the cuts (MAX_BUCKETS at most) reach the driver.
    """
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    placed = rows.filter(F.col("__id").isNotNull())
    n = placed.select("__id").count()
    alone = rows.filter(F.col("__id").isNull()).withColumn("next_text", F.lit(""))
    if n == 0:
        return alone.select(F.col("__id").alias(id_col), F.col("__text").alias(text_col), "next_text")
    k = min(MAX_BUCKETS, -(-n // rows_per_bucket))
    bounds: list[int] = []
    if k > 1:
        cuts = placed.agg(F.percentile_approx("__id", [i / k for i in range(1, k)], 10 * k).alias("b")).first()["b"]
        bounds = sorted(set(cuts))
    placed = placed.withColumn("__bucket", _bucket(F.col("__id"), bounds))
    firsts = sorted((r["__bucket"], r["i"]) for r in placed.groupBy("__bucket").agg(F.min("__id").alias("i")).collect())
    follows = [(firsts[j - 1][0], firsts[j][1]) for j in range(len(firsts))]
    ghosts = df.sparkSession.createDataFrame(follows, "__bucket int, __id long")
    ghosts = F.broadcast(ghosts)  # a row for each bucket, MAX_BUCKETS + 1 at most
    ghost_rows = rows.join(ghosts, "__id").groupBy("__bucket", "__id").agg(F.min("__text").alias("__text")).withColumn("__ghost", F.lit(1))
    both = placed.withColumn("__ghost", F.lit(0)).unionByName(ghost_rows)
    w = Window.partitionBy("__bucket").orderBy("__ghost", "__id", "__text")
    set_beside = both.withColumn("next_text", F.lead("__text").over(w)).filter(F.col("__ghost") == 0)
    out = set_beside.select("__id", "__text", "next_text").unionByName(alone.select("__id", "__text", "next_text"))
    return out.select(F.col("__id").alias(id_col), F.col("__text").alias(text_col), "next_text")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like it is to that and to the next document's."""
    rows = with_next(documents(spark, sf_dir))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.select(
        "doc_id", "text", "next_text", n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)).alias("edited"),
    )
    trees = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("t"), tree(F.col("edited")).alias("te"), leaves(tree(F.col("next_text"))).alias("ln"))
    hashed = trees.select("doc_id", "n_chars", "edited_sha256", branches(F.col("t")).alias("b"), branches(F.col("te")).alias("be"), leaves(F.col("t")).alias("l"), leaves(F.col("te")).alias("le"), "ln")
    return hashed.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("b")).alias("fingerprint"), written(F.col("be")).alias("edited_fingerprint"),
        likeness(F.col("l"), F.col("le")).alias("near_edited"), likeness(F.col("l"), F.col("ln")).alias("near_next"),
    )


_TREE_SQL = "list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '" + PIECE_RE.replace("{", "{{").replace("}", "}}") + "'), lambda x: md5(x)[1:16])))"
_WRITTEN_SQL = (
    "sha256(array_to_string(list_transform({t}, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))[1:16]), ''))[1:16]), '')) || ';' || "
    "array_to_string(list_transform({t}, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))[1:16]), ''))[1:16] || '>' || "
    "array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))[1:16] || '.' || array_to_string(list_transform(p, lambda x: x[1:8]), '')), ',')), '|')"
)
_NEAR_SQL = "case when len({a}) + len({b}) = 0 then 1.0::double else 2.0::double * len(list_intersect({a}, {b})) / (len({a}) + len({b})) end"

OP8_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next_text, length(text) as n_chars from d),
e as (select doc_id, text, next_text, n_chars, substr(text, 1, n_chars - n_chars // 4) || substr(next_text, 1, n_chars // 4) as edited from n),
t as (select doc_id, n_chars, sha256(edited) as edited_sha256, {_TREE_SQL.format(t='text')} as t, {_TREE_SQL.format(t='edited')} as te, {_TREE_SQL.format(t='next_text')} as tn from e),
l as (select *, list_distinct(flatten(flatten(t))) as l, list_distinct(flatten(flatten(te))) as le, list_distinct(flatten(flatten(tn))) as ln from t)
select doc_id, n_chars, edited_sha256, {_WRITTEN_SQL.format(t='t')} as fingerprint, {_WRITTEN_SQL.format(t='te')} as edited_fingerprint,
  {_NEAR_SQL.format(a='l', b='le')} as near_edited, {_NEAR_SQL.format(a='l', b='ln')} as near_next
from l
"""
