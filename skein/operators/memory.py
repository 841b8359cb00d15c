"""Memory items: expiry, scores, exclusion, ranking and packing into a token budget; layered guidance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text
from skein.sources.tables import table

# Words that ask for history, and the layers of guidance.
HISTORY_WORDS = ("history", "historical", "audit", "past", "previous", "timeline", "root-cause", "migration")
LAYERS = {"org": 1, "project": 2, "user": 3}


@dataclass(frozen=True)
class Profile:
    """Weights of a memory's score."""

    semantic: float = 3.0
    episodic: float = 1.0
    working: float = 2.0
    evidence: float = 1.5
    recency: float = 0.25
    current_boost: float = 2.0
    episodic_penalty: float = 1.5
    least_score: float = 1.0
    token_budget: int = 1200


def expired(items: DataFrame, as_of: Column) -> DataFrame:
    """items with working ones past expires_at turned stale: version goes up by one, and a tag says why."""
    due = (F.col("kind") == "working") & F.col("state").isin("active", "candidate") & (F.col("expires_at") <= as_of)
    due = F.coalesce(due, F.lit(False))
    return items.withColumns({"state": F.when(due, "stale").otherwise(F.col("state")), "version": F.col("version") + due.cast("int"), "tags": F.when(due, F.array_union("tags", F.array(F.lit("stale:working-expired")))).otherwise(F.col("tags"))})


def recency(updated_at: Column, as_of: Column) -> Column:
    """1 for what is fresh, down to 0 at 30 days; 0 for null."""
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(updated_at.cast("timestamp"))) / 86_400_000_000
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), days) / 30.0), F.lit(0.0))


def scored(items: DataFrame, query: str, as_of: Column, profile: Profile = Profile(), boosts: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """items with score and reason (why it is left out; null if it isn't).

    Columns: id, kind, state, title, body, tags, evidence_refs (arrays), confidence, pinned,
    updated_at, expires_at. boosts (id, boost) add what a vector search found.
    """
    spark = items.sparkSession
    words = spark.createDataFrame([(query,)], "q string").select(text.plain_words(F.col("q"))).first()[0]
    history = bool(set(words) & set(HISTORY_WORDS))
    own = text.plain_words(F.concat_ws(" ", "title", "body", F.array_join("tags", " ")))
    overlap = F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in words]))) if words else F.lit(0)
    kind, state = F.col("kind"), F.col("state")
    weight = F.when(kind == "semantic", profile.semantic).when(kind == "episodic", profile.episodic).when(kind == "working", profile.working).otherwise(0.0)
    score = (
        overlap * weight + F.when(F.size("evidence_refs") > 0, profile.evidence).otherwise(0.0) + F.coalesce("confidence", F.lit(0.0)) + profile.recency * recency(F.col("updated_at"), as_of)
        + F.when((state == "active") & kind.isin("semantic", "working"), profile.current_boost).otherwise(0.0) + F.when(F.col("pinned"), profile.current_boost).otherwise(0.0)
        - F.when((kind == "episodic") & F.lit(not history), profile.episodic_penalty).otherwise(0.0) - F.when(state == "candidate", 0.5).otherwise(0.0)
    )
    rows = items if boosts is None else items.join(boosts, "id", "left")
    score = score if boosts is None else score + F.coalesce("boost", F.lit(0.0))
    reason = (
        F.when((kind == "restricted") | (state == "restricted"), "restricted_memory_boundary").when(state.isin("deprecated", "archived"), "inactive_memory_state").when(state == "stale", "stale_memory_excluded")
        .when((kind == "working") & (F.col("expires_at") <= as_of), "working_memory_expired").when((kind == "episodic") & F.lit(not history), "historical_fact_not_requested").when(F.col("score") < profile.least_score, "below_relevance_threshold")
    )
    return rows.withColumn("score", F.round(score, digits)).withColumn("reason", reason).drop("boost")


def packed(rows: DataFrame, group: list[str], order: list[Column], cost_col: str, budget: int) -> DataFrame:
    """rows of each group that fit its budget: in order, a row that would go over is skipped and the next is tried.

    No prefix sum can say this, so each group is folded in order; costs count in whole numbers. The
    fold is small whatever the group's size: once a row of some cost is skipped, all later ones of
    that cost are, as the sum only grows, so of each cost c only the first budget / c rows can be
    taken. Rows of cost 0 always fit; those of negative or null cost never do.
    """
    cost = F.col(cost_col).cast("long")
    free = rows.filter(cost == 0)
    of_cost = Window.partitionBy(*group, "__cost").orderBy(*order)
    first = rows.withColumn("__cost", cost).filter((F.col("__cost") > 0) & (F.col("__cost") <= budget)).withColumn("__n", F.row_number().over(of_cost))
    first = first.filter(F.col("__n") <= budget).filter(F.col("__n") * F.col("__cost") <= budget).drop("__n")
    numbered = first.withColumn("__at", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    folded = numbered.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__at", F.col("__cost").alias("c")))).alias("__rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))
    step = lambda s, x: F.when(s["used"] + x["c"] <= budget, F.struct((s["used"] + x["c"]).alias("used"), F.concat(s["taken"], F.array(x["__at"])).alias("taken"))).otherwise(s)
    taken = folded.select(*group, F.explode(F.aggregate("__rows", start, step)["taken"]).alias("__at"))
    return numbered.join(taken, [*group, "__at"]).select(*rows.columns).unionByName(free)


def layered(rows: DataFrame, key_col: str = "key") -> DataFrame:
    """key, layer, body, conflict of guidance (key, layer, body, mandatory): the highest layer wins, but a mandatory lower one with another body stays and is marked a conflict."""
    rank = F.lit(0)
    for k, v in LAYERS.items():
        rank = F.when(F.col("layer") == k, F.lit(v)).otherwise(rank)
    ranked = rows.withColumn("rank", rank)
    s = ranked.groupBy(key_col).agg(F.max(F.struct("rank", "layer", "body")).alias("top"), F.min(F.when(F.col("mandatory"), F.struct("rank", "layer", "body"))).alias("must"))
    kept = F.coalesce("must", "top")
    return s.select(key_col, kept["layer"].alias("layer"), kept["body"].alias("body"), (F.col("must").isNotNull() & (F.col("must.rank") < F.col("top.rank")) & (F.col("must.body") != F.col("top.body"))).alias("conflict"))


def listed(items: DataFrame, query: str = "", **equal) -> DataFrame:
    """items whose columns equal the values given and whose words meet the query's."""
    for k, v in equal.items():
        items = items.filter(F.col(k) == v)
    if query.strip():
        words = F.array(*[F.lit(w) for w in sorted({w for w in query.lower().split() if len(w) > 1})])
        items = items.filter(F.arrays_overlap(text.plain_words(F.concat_ws(" ", "title", "body", F.array_join("tags", " "))), words))
    return items


AS_OF = "2024-06-01 00:00:00"
QUERY = "the and of history"
#: Tokens for the memories of one source, which are whole documents.
BUDGET = 6000


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory items that stand on documents."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    pick = lambda words, by: F.element_at(F.array(*[F.lit(w) for w in words]), (by % len(words) + 1).cast("int"))
    at = F.lit(AS_OF).cast("timestamp")
    return rows.select(
        k.alias("id"), pick(["semantic", "episodic", "working"], k).alias("kind"), pick(["active", "candidate", "active", "stale", "archived", "active", "restricted"], F.floor(k / 3)).alias("state"),
        F.col("source").alias("title"), F.col("text").alias("body"), F.array("lang").alias("tags"), F.when(k % 4 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence_refs"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("confidence"), (k % 50 == 0).alias("pinned"), (at - F.make_dt_interval(days=(k % 60).cast("int"))).alias("updated_at"), F.when(k % 5 == 0, at).alias("expires_at"), F.lit(1).alias("version"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(items(spark, sf_dir), QUERY, F.lit(AS_OF).cast("timestamp"))


def r16_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits a budget of tokens for each source, best first."""
    rows = _scored(spark, sf_dir).filter("reason is null").withColumn("cost", text.word_estimate(F.concat_ws(" ", "title", "body")))
    return packed(rows, ["title"], [F.desc("score"), F.desc("updated_at"), F.asc("id")], "cost", BUDGET).select("id", "title", "cost")


def w05_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    layer = F.element_at(F.array(F.lit("org"), F.lit("project"), F.lit("user")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return layered(rows.select((F.col("p_partkey") % 300).alias("key"), layer.alias("layer"), F.col("p_brand").alias("body"), (F.col("p_size") > 40).alias("mandatory")).groupBy("key", "layer").agg(F.min("body").alias("body"), F.max("mandatory").alias("mandatory")))


QUERIES = {
    "f02_memory_list": lambda spark, d: listed(items(spark, d), "the of", kind="semantic", state="active").select("id"),
    "f03_expired": lambda spark, d: expired(items(spark, d), F.lit(AS_OF).cast("timestamp")).select("id", "state", "version", F.array_join("tags", ",").alias("tags")),
    "r15_memory_score": lambda spark, d: _scored(spark, d).select("id", "score", "reason"),
    "w03_memory_rank": lambda spark, d: _scored(spark, d).filter("reason is null").select("id", "score", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("score"), F.desc("updated_at"), "id")).alias("rank")),
    "r16_memory_retrieve": r16_retrieved,
    "w04_budget_pack": lambda spark, d: packed(table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], "l_quantity", 300).select("l_suppkey", "l_orderkey", "l_linenumber"),
    "w05_layered": w05_guidance,
    "w09_recency": lambda spark, d: items(spark, d).select("id", F.round(recency(F.col("updated_at"), F.lit(AS_OF)), 6).alias("recency")),
}

_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9_-]*')), lambda w: length(w) > 1)"
_I = f"""i as (select doc_id as id, ['semantic', 'episodic', 'working'][doc_id % 3 + 1] as kind, ['active', 'candidate', 'active', 'stale', 'archived', 'active', 'restricted'][(doc_id // 3) % 7 + 1] as state, source as title, text as body, lang, coalesce(quality::double, 0.5::double) as confidence, doc_id % 60 as age from documents left join labels using (doc_id)),
s as (select *, round(len(list_intersect({_WORDS.format(t="title || ' ' || body || ' ' || lang")}, ['the', 'and', 'of', 'history'])) * case kind when 'semantic' then 3.0::double when 'episodic' then 1.0::double else 2.0::double end
 + case when id % 4 = 0 then 1.5::double else 0 end + confidence + 0.25::double * greatest(0, 1 - age / 30.0::double) + case when state = 'active' and kind in ('semantic', 'working') then 2 else 0 end + case when id % 50 = 0 then 2 else 0 end - case when state = 'candidate' then 0.5::double else 0 end, 6) as score from i),
r as (select *, case when state = 'restricted' then 'restricted_memory_boundary' when state = 'archived' then 'inactive_memory_state' when state = 'stale' then 'stale_memory_excluded' when kind = 'working' and id % 5 = 0 then 'working_memory_expired' when score < 1 then 'below_relevance_threshold' end as reason from s)"""


def _fold(rows: str, group: str, budget: int) -> str:
    """Rows (group, n from 1, cost) folded one by one; taken tells which fit."""
    return f"f as (select {group}, n, case when cost <= {budget} then cost else 0 end as used, cost <= {budget} as taken from {rows} where n = 1 union all select q.{group}, q.n, f.used + case when f.used + q.cost <= {budget} then q.cost else 0 end, f.used + q.cost <= {budget} from f join {rows} q on q.{group} = f.{group} and q.n = f.n + 1)"


ORACLE_SQL = {
    "f02_memory_list": f"with {_I} select id from i where kind = 'semantic' and state = 'active' and list_has_any({_WORDS.format(t=chr(116) + 'itle || ' + chr(39) + ' ' + chr(39) + ' || body || ' + chr(39) + ' ' + chr(39) + ' || lang')}, ['the', 'of'])",
    "f03_expired": f"with {_I}, d as (select *, kind = 'working' and state in ('active', 'candidate') and id % 5 = 0 as due from i) select id, case when due then 'stale' else state end as state, (1 + due::int)::int as version, case when due then lang || ',stale:working-expired' else lang end as tags from d",
    "r15_memory_score": f"with {_I} select id, score, reason from r",
    "w03_memory_rank": f"with {_I} select id, score, (row_number() over (partition by title order by score desc, age, id))::int as rank from r where reason is null",
    "r16_memory_retrieve": f"""with recursive {_I}, q as (select id, title, greatest(1, len(list_filter(regexp_split_to_array(trim(title || ' ' || body), '\\s+'), lambda w: w <> ''))) as cost, row_number() over (partition by title order by score desc, age, id) as n from r where reason is null),
{_fold('q', 'title', BUDGET)} select id, title, cost::int as cost from f join q using (title, n) where taken""",
    "w04_budget_pack": f"""with recursive q as (select l_suppkey, l_orderkey, l_linenumber, l_quantity::bigint as cost, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as n from lineitem),
{_fold('q', 'l_suppkey', 300)} select l_suppkey, l_orderkey, l_linenumber from f join q using (l_suppkey, n) where taken""",
    "w05_layered": """with p as (select p_partkey % 300 as key, ['org', 'project', 'user'][p_partkey % 3 + 1] as layer, p_partkey % 3 + 1 as rank, min(p_brand) as body, bool_or(p_size > 40) as mandatory from part group by 1, 2, 3),
s as (select key, arg_max((rank, layer, body), rank) as top, arg_min((rank, layer, body), rank) filter (mandatory) as must from p group by 1)
select key, coalesce(must, top)[2] as layer, coalesce(must, top)[3] as body, must is not null and must[1] < top[1] and must[3] <> top[3] as conflict from s""",
    "w09_recency": f"with {_I} select id, round(greatest(0, 1 - age / 30.0::double), 6) as recency from i",
}
