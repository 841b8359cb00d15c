"""Compositions: what a project looks like, what a change touches, what to read for a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.lineage import checkpointed
from skein.operators import communities, docs, flows, graph, memory, resolve, search, traverse
from skein.sources.tables import GRAPH_SQL, edges, symbols, table

FLOW_KINDS = ("function", "method", "class", "route")
HINTS = 8


def structure(edge_rows: DataFrame, seed: str, rel_types: tuple[str, ...] = ()) -> DataFrame:
    """The seed's edges, and for each other end its degree among them and whether it is one of the HINTS that matter most."""
    own = edge_rows.filter((F.col("source_id") == seed) | (F.col("target_id") == seed))
    own = own.filter(F.col("rel_type").isin(*rel_types)) if rel_types else own
    other = F.when(F.col("source_id") == seed, F.col("target_id")).otherwise(F.col("source_id"))
    ends = own.withColumn("other_id", other)
    degree = graph.degrees(edge_rows).select(F.col("symbol_id").alias("other_id"), "degree")
    top = ends.select("other_id").distinct().join(degree, "other_id").orderBy(F.desc("degree"), "other_id").limit(HINTS).select("other_id", F.lit(True).alias("hint"))
    return ends.join(degree, "other_id").join(F.broadcast(top), "other_id", "left").select("source_id", "target_id", "rel_type", "degree", F.coalesce("hint", F.lit(False)).alias("hint"))


def call_path(edge_rows: DataFrame, symbol_rows: DataFrame, seed: str, max_depth: int = 8, max_nodes: int = 40) -> DataFrame:
    """node, hop of the first max_nodes of a flow by hop and id, through functions, methods, classes and routes only."""
    kinds = symbol_rows.filter(F.col("kind").isin(*FLOW_KINDS)).select(F.col("symbol_id").alias("target_id"))
    return traverse.flow(edge_rows.join(kinds, "target_id", "left_semi"), seed, max_depth).orderBy("hop", "node").limit(max_nodes)


def language_groups(symbol_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """language, component, size of languages that edges connect; a language without such edges is one by itself."""
    of = lambda e: symbol_rows.select(F.col("symbol_id").alias(f"{e}_id"), F.col("language").alias(e))
    pairs = edge_rows.join(of("source"), "source_id").join(of("target"), "target_id").filter("source <> target").select(F.col("source").alias("source_id"), F.col("target").alias("target_id")).distinct()
    parts = traverse.components(pairs)
    rows = symbol_rows.select("language").distinct().join(parts.withColumnRenamed("node", "language"), "language", "left").withColumn("component", F.coalesce("component", "language"))
    return rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("component")))  # languages are few


def community_of(edge_rows: DataFrame, seed: str, limit: int = 50) -> DataFrame:
    """node of the first members of the seed's community, in the two hops around it."""
    near = checkpointed(traverse.neighbourhood(edge_rows, [seed], 2))
    found = checkpointed(communities.communities(near))
    own = found.filter(F.col("node") == seed).select("community")
    return found.join(own, "community", "left_semi").select("node").orderBy("node").limit(limit)


# How many of each kind a question is asked about, and how many questions there are.
ASKED_EACH, ASKED = 2, 5


def suggested_questions(hubs: DataFrame, bridges: DataFrame, surprises: DataFrame, limit: int = ASKED) -> DataFrame:
    """place (from 1), about, question of the first two hubs, then bridges (item, value), then surprises (source, target, rel_type, value); the first limit."""
    first = lambda df, kind, by, item, words: df.orderBy(*by).limit(ASKED_EACH).select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(*by)).alias("at"), item.alias("about"), words.alias("question"))
    told = lambda before, after: F.concat(F.lit(before), "item", F.lit(after))
    order = [F.desc("value"), "item"]
    rows = first(hubs, 0, order, F.col("item"), told("Who relies on ", ", and what makes it a hub?"))
    rows = rows.unionByName(first(bridges, 1, order, F.col("item"), told("What is cut off if ", " changes?")))
    pair = F.concat_ws(" to ", "source", "target")
    rows = rows.unionByName(first(surprises, 2, [F.desc("value"), "source", "target", "rel_type"], pair, F.concat(F.lit("Why is there "), "rel_type", F.lit(" from "), pair, F.lit("?"))))
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy("kind", "at")))  # six rows at most
    return placed.filter(F.col("place") <= limit).select("place", "about", "question")


def overview(symbol_rows: DataFrame, edge_rows: DataFrame, community: DataFrame, top: int = 10) -> DataFrame:
    """section, item, value, question: hubs, isolated symbols, untested hotspots and surprising edges, with questions about the first two of each but the isolated."""
    part = lambda df, section, item, value: df.select(F.lit(section).alias("section"), item.alias("item"), value.cast("long").alias("value"))
    rows = part(graph.hubs(symbol_rows, edge_rows, top), "hub", F.col("qualified_name"), F.col("degree"))
    rows = rows.unionByName(part(graph.isolated(symbol_rows, edge_rows, top=top), "isolated", F.col("qualified_name"), F.lit(0)))
    rows = rows.unionByName(part(graph.untested_hotspots(symbol_rows, edge_rows, top=top), "untested", F.col("qualified_name"), F.col("degree")))
    rows = rows.unionByName(part(graph.surprising(symbol_rows, edge_rows, community, top), "surprise", F.concat_ws(" to ", "source_id", "target_id"), F.col("score")))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("value"), "item"))  # a section has at most top rows
    asked = F.when(F.col("section") == "hub", F.concat(F.lit("Who relies on "), "item", F.lit("?"))).when(F.col("section") == "untested", F.concat(F.lit("Which test would cover "), "item", F.lit("?"))).when(F.col("section") == "surprise", F.concat(F.lit("What links "), "item", F.lit("?")))
    return rows.withColumn("place", place).select("section", "item", "value", F.when(F.col("place") <= 2, asked).alias("question"))


def changes(symbol_rows: DataFrame, edge_rows: DataFrame, files: DataFrame, churn: DataFrame, membership: DataFrame | None = None, community: DataFrame | None = None) -> DataFrame:
    """symbol_id, callers, tested, risk, level of the symbols in changed files (file_path): files' commits come from churn (file_path, churn).

    membership (symbol_id, flow_criticality, flow_count: flows.membership()) adds what the flows
    through a symbol weigh; community (symbol_id, community) says whose callers cross, else top directories do.
    """
    own = symbol_rows.join(files.select("file_path").distinct(), "file_path", "left_semi")
    callers = graph.fan_in(edge_rows, traverse.IMPACT_TYPES)
    tests = graph.tested(symbol_rows, edge_rows).withColumn("t", F.lit(1))
    part = symbol_rows.select("symbol_id", F.substring_index("file_path", "/", 1).alias("community")) if community is None else community.select("symbol_id", "community")
    crossing = edge_rows.join(part.select(F.col("symbol_id").alias("source_id"), F.col("community").alias("a")), "source_id").join(part.select(F.col("symbol_id").alias("target_id"), F.col("community").alias("b")), "target_id").filter("a <> b").groupBy(F.col("target_id").alias("symbol_id")).agg(F.countDistinct("source_id").alias("cross_community"))
    rows = own.join(callers, "symbol_id", "left").join(tests, "symbol_id", "left").join(crossing, "symbol_id", "left").join(churn, "file_path", "left")
    none = {"flow_criticality": F.lit(None).cast("double"), "flow_count": F.lit(0)}
    rows = rows.withColumns(none) if membership is None else rows.join(membership.select("symbol_id", *none), "symbol_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    factors = rows.select("symbol_id", "name", "qualified_name", "flow_criticality", zero("flow_count").alias("flow_count"), zero("cross_community").alias("cross_community"), zero("t").alias("test_count"), zero("fan_in").alias("caller_count"), zero("churn").alias("churn"))
    return graph.change_risk(factors).select("symbol_id", F.col("caller_count").alias("callers"), (F.col("test_count") > 0).alias("tested"), "risk", "level")


def boosted(hits: DataFrame, edge_rows: DataFrame, seeds: int = 3) -> DataFrame:
    """hits (symbol_id, score) with a hundredth more for each edge, five at most, for the first seeds; 1 at most; the order stays that of the old score in rank."""
    ranked = hits.orderBy(F.desc("score"), "symbol_id").limit(1000)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "symbol_id")))  # at most 1000 rows
    rows = ranked.join(graph.degrees(edge_rows).select("symbol_id", "degree"), "symbol_id", "left")
    more = F.least(F.coalesce("degree", F.lit(0)), F.lit(5)) * 0.01
    return rows.select("symbol_id", "rank", F.round(F.when(F.col("rank") <= seeds, F.least(F.lit(1.0), F.col("score") + more)).otherwise(F.col("score")), 6).alias("score"))


def first_channel(*channels: DataFrame) -> DataFrame:
    """The first of the channels that has rows; the last if none has."""
    for c in channels[:-1]:
        kept = checkpointed(c)
        if kept.limit(1).count():
            return kept
    return channels[-1]


def explored(symbol_rows: DataFrame, edge_rows: DataFrame, seeds: DataFrame, spine: DataFrame, budget: int) -> DataFrame:
    """symbol_id, file_path, on_spine, cost of what fits a budget of characters: the flow's spine first, then by score, path and name.

    seeds: symbol_id, score; spine: node. A row that doesn't fit is skipped and the next is tried.
    """
    on = spine.select(F.col("node").alias("symbol_id"), F.lit(True).alias("s")).distinct()
    rows = symbol_rows.join(seeds, "symbol_id").join(on, "symbol_id", "left").withColumn("on_spine", F.coalesce("s", F.lit(False)))
    cost = F.length("qualified_name") + F.length("file_path")
    rows = rows.select("symbol_id", "file_path", "qualified_name", "score", "on_spine", cost.alias("cost"), F.lit(1).alias("all"))
    order = [F.desc("on_spine"), F.desc("score"), F.asc("file_path"), F.asc("qualified_name"), F.asc("symbol_id")]
    return memory.packed(rows, ["all"], order, "cost", budget).select("symbol_id", "file_path", "on_spine", "cost")


def stale_documents(documents: DataFrame, links: DataFrame, symbol_ids: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, finding_kind of documents, by the first that fits: orphan_doc (no links), ghost_link (a link to nothing), stale_anchor.

    links: doc_id, symbol; anchors: doc_id, stale.
    """
    l = links.join(symbol_ids.select("symbol").distinct().withColumn("is", F.lit(1)), "symbol", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("links"), F.count("is").alias("found"))  # noqa: E741
    a = anchors.groupBy("doc_id").agg(F.max(F.col("stale").cast("int")).alias("stale"))
    rows = documents.join(l, "doc_id", "left").join(a, "doc_id", "left")
    kind = F.when(F.coalesce("links", F.lit(0)) == 0, "orphan_doc").when(F.col("found") < F.col("links"), "ghost_link").when(F.col("stale") == 1, "stale_anchor")
    return rows.select("doc_id", kind.alias("finding_kind")).filter("finding_kind is not null")


def documentation_audit(stale: DataFrame, issues: DataFrame, undocumented: DataFrame) -> DataFrame:
    """category, findings over all three kinds of findings: stale (finding_kind), issues (joined by commas), undocumented (rows)."""
    rows = stale.select(F.col("finding_kind").alias("category")).unionByName(issues.select(F.explode(F.split("issues", ",")).alias("category"))).unionByName(undocumented.select(F.lit("undocumented").alias("category")))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("findings"))


def coverage_layers(symbol_rows: DataFrame, layers: DataFrame) -> DataFrame:
    """symbol_id, best, gaps of layers (symbol_id, layer): human before living before rationale before ast; gaps are those that lack."""
    order = ("human", "living", "rationale", "ast")
    s = layers.groupBy("symbol_id").agg(F.collect_set("layer").alias("has"))
    rows = symbol_rows.select("symbol_id").join(s, "symbol_id", "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    all_layers = F.array(*[F.lit(x) for x in order])
    return rows.select("symbol_id", F.get(F.filter(all_layers, lambda x: F.array_contains("has", x)), 0).alias("best"), F.array_join(F.array_except(all_layers, "has"), ",").alias("gaps"))


def relinked(pending: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """edge_id, target, confidence of pending edges (edge_id, target_id such as unresolved:name) that a full index can now resolve."""
    rows = pending.filter(F.col("target_id").startswith("unresolved:")).select("edge_id", F.regexp_replace("target_id", "^unresolved:", "").alias("key"))
    return rows.join(resolve.grouped_targets(symbol_rows, F.col("name")), "key").select("edge_id", "target", F.when(F.col("candidates") == 1, "probable").otherwise("ambiguous").alias("confidence"))


def priorities(findings: DataFrame, limit: int) -> DataFrame:
    """findings by place if there are at most limit, else the first limit with packages and files (by score and symbol) first."""
    if findings.limit(limit + 1).count() <= limit:
        return findings
    structural = F.col("finding_kind").isin("zombie_package", "unreachable_file")
    return findings.orderBy(F.desc(structural), F.when(structural, -F.col("score")), F.when(structural, F.col("symbol_id")), "place").limit(limit)


SEED = "sym:fx:p7"


def _community(s: DataFrame) -> DataFrame:
    return s.select("symbol_id", F.concat_ws("-", "kind", F.substring("symbol_id", -1, 1)).alias("community"))


def _hits(s: DataFrame) -> DataFrame:
    return s.filter("symbol_id like '%3'").select("symbol_id", (1.0 / (1 + F.substring("symbol_id", 9, 20).cast("long"))).alias("score"))


def g17_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hops around a symbol with each one's layers of documentation."""
    e, s = edges(spark, sf_dir), symbols(spark, sf_dir)
    near = traverse.hops(e, SEED, 2).select(F.col("node").alias("symbol_id"))
    return coverage_layers(s.join(near, "symbol_id", "left_semi"), _layers(s))


def _layers(s: DataFrame) -> DataFrame:
    n = F.substring("symbol_id", 9, 20).cast("long")
    each = [F.when(n % 2 == 0, "ast"), F.when(n % 3 == 0, "living"), F.when(n % 5 == 0, "human"), F.when(n % 7 == 0, "rationale")]
    return s.select("symbol_id", F.explode(F.array_compact(F.array(*each))).alias("layer"))


def n07_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About hubs, untested hotspots in the place of bridges, and surprising edges."""
    e, s = edges(spark, sf_dir), symbols(spark, sf_dir)
    item = lambda df: df.select(F.col("qualified_name").alias("item"), F.col("degree").alias("value"))
    odd = graph.surprising(s, e, _community(s), 10).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "rel_type", F.col("score").alias("value"))
    return suggested_questions(item(graph.hubs(s, e)), item(graph.untested_hotspots(s, e)), odd)


def n11_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s = edges(spark, sf_dir), symbols(spark, sf_dir)
    changed = s.filter("symbol_id like '%5'").select("file_path")
    churn = s.groupBy("file_path").agg((F.count(F.lit(1)) % 7).alias("churn"))
    return changes(s, e, changed, churn)


def n11_change_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of n11_changes with the flows of all entries: what they weigh comes out of the graph."""
    e, s = edges(spark, sf_dir), symbols(spark, sf_dir)
    found, critical, _ = flows.traced(spark, sf_dir)
    changed = s.filter("symbol_id like '%5'").select("file_path")
    churn = s.groupBy("file_path").agg((F.count(F.lit(1)) % 7).alias("churn"))
    return changes(s, e, changed, churn, flows.membership(found, critical, 6))


def r14_explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s = edges(spark, sf_dir), symbols(spark, sf_dir)
    return explored(s, e, _hits(s), traverse.flow(e, "sym:fx:s3"), 2000)


def t03_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    p = table(spark, sf_dir, "part")
    links = p.filter("p_partkey % 3 > 0").select((F.col("p_partkey") % 700).alias("doc_id"), F.col("p_partkey").alias("symbol"))
    anchors = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("stale"))
    return stale_documents(d, links, p.filter("p_partkey % 10 > 0").select(F.col("p_partkey").alias("symbol")), anchors)


def t06_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return documentation_audit(t03_stale(spark, sf_dir), docs.standards(d, "doc_id", "text", 5, 20), d.filter("n_chars > 3000"))


QUERIES = {
    "g07_structure": lambda spark, d: structure(edges(spark, d), SEED, ("HTTP_CALLS", "CALLS")),
    "g11_call_path": lambda spark, d: call_path(edges(spark, d), symbols(spark, d), "sym:fx:s3"),
    "g14_language_groups": lambda spark, d: language_groups(symbols(spark, d), edges(spark, d).filter("rel_type = 'CALLS'")),
    "g17_context": g17_context,
    "n04_community_of": lambda spark, d: community_of(edges(spark, d), SEED),
    "n08_overview": lambda spark, d: overview(symbols(spark, d), edges(spark, d), _community(symbols(spark, d))),
    "n07_questions": n07_questions,
    "n11_changes": n11_changes,
    "n11_change_flows": n11_change_flows,
    "r11_boosted": lambda spark, d: boosted(_hits(symbols(spark, d)), edges(spark, d)),
    "r12_fallback": lambda spark, d: first_channel(search.name_search(symbols(spark, d), "nowhere"), search.name_search(symbols(spark, d), "customer#00000002", 20)),
    "r14_explored": r14_explored,
    "t03_stale_documents": t03_stale,
    "t06_audit": t06_audit,
    "t07_coverage_layers": lambda spark, d: coverage_layers(symbols(spark, d), _layers(symbols(spark, d))),
    "j11_relinked": lambda spark, d: relinked(table(spark, d, "part").select(F.col("p_partkey").alias("edge_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("unresolved:"), "p_brand")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("unresolved:Supplier#"), F.lpad((F.col("p_partkey") % 20).cast("string"), 9, "0"))).otherwise("sym:x").alias("target_id")), symbols(spark, d).withColumn("name", F.when(F.col("kind") == "function", F.substring_index(F.substring_index("qualified_name", ".", 2), ".", -1)).otherwise(F.col("name")))),
    "w07_priorities": lambda spark, d: priorities(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("symbol_id"), F.element_at(F.array(F.lit("unused"), F.lit("zombie_package"), F.lit("dead"), F.lit("unreachable_file")), (F.when(F.col("p_partkey") < 60, F.col("p_partkey") % 4).otherwise(0) + 1).cast("int")).alias("finding_kind"), (F.col("p_size") / 100.0).alias("score"), F.col("p_partkey").alias("place")), 50),
    "s05_symbol_scan": lambda spark, d: symbols(spark, d).filter("file_path like 'supplier/%'").select("symbol_id", "qualified_name", text.base_name(F.col("file_path")).alias("file")),
}

_N = "substr(symbol_id, 9)::bigint"
_DEG = "deg as (select symbol_id, count(*) as degree from (select source_id as symbol_id from fx_edges union all select target_id from fx_edges) group by 1)"
_TEST = "regexp_matches('/' || lower(file_path) || '/', '/(tests|test|spec|specs|__tests__)/')"
_HITS = f"hits as (select symbol_id, 1.0::double / (1 + {_N}) as score from fx_symbols where symbol_id like '%3')"
_LAYERS = f"lay as (select symbol_id, list_filter([case when {_N} % 5 = 0 then 'human' end, case when {_N} % 3 = 0 then 'living' end, case when {_N} % 7 = 0 then 'rationale' end, case when {_N} % 2 = 0 then 'ast' end], lambda x: x is not null) as has from fx_symbols)"
_LAYERED = "select symbol_id, has[1] as best, array_to_string(list_filter(['human', 'living', 'rationale', 'ast'], lambda x: not list_contains(has, x)), ',') as gaps from lay"
_STALE = """l as (select p_partkey % 700 as doc_id, count(*) as links, count(*) filter (p_partkey % 10 > 0) as found from part where p_partkey % 3 > 0 group by 1), a as (select doc_id, bool_or(toxic = 1) as stale from labels group by 1),
st as (select doc_id, case when coalesce(links, 0) = 0 then 'orphan_doc' when found < links then 'ghost_link' when stale then 'stale_anchor' end as finding_kind from documents left join l using (doc_id) left join a using (doc_id))"""
_OVERVIEW = f"""{GRAPH_SQL}, {_DEG}, hub as (select qualified_name as item, degree as value from fx_symbols join deg using (symbol_id) order by degree desc, qualified_name, symbol_id limit 10),
iso as (select qualified_name as item from fx_symbols where symbol_id not in (select source_id from fx_edges where rel_type in ('CALLS', 'HTTP_CALLS') union select target_id from fx_edges where rel_type in ('CALLS', 'HTTP_CALLS')) order by 1, symbol_id limit 10),
tst as (select target_id from fx_edges join fx_symbols on symbol_id = source_id where rel_type = 'CALLS' and {_TEST}),
hot as (select qualified_name as item, degree as value from fx_symbols join deg using (symbol_id) where degree >= 4 and not {_TEST} and symbol_id not in (select target_id from tst) order by 2 desc, 1, symbol_id limit HOT),
oc as (select *, kind || '-' || right(symbol_id, 1) as c, split_part(file_path, '/', 1) as top from fx_symbols),
odd as (select source_id, target_id, rel_type, (case when a.c <> b.c then 3 else 0 end + case when a.top <> b.top then 2 else 0 end + case when rank < 3 then 3 - rank else 0 end)::int as value from fx_ranked join oc a on a.symbol_id = source_id join oc b on b.symbol_id = target_id where value > 0 order by value desc, source_id, target_id, rel_type limit 10)""".replace("HOT", "10")
_B2 = f"""with recursive {GRAPH_SQL}, both_ways as (select source_id as f, target_id as t from fx_edges union all select target_id, source_id from fx_edges)"""
ORACLE_SQL = {
    "g07_structure": f"with {GRAPH_SQL}, {_DEG}, o as (select *, case when source_id = '{SEED}' then target_id else source_id end as other from fx_edges where '{SEED}' in (source_id, target_id) and rel_type in ('HTTP_CALLS', 'CALLS')), t as (select other from (select distinct other from o) join deg on symbol_id = other order by degree desc, other limit 8) select source_id, target_id, rel_type, degree, other in (select other from t) as hint from o join deg on symbol_id = other",
    "g11_call_path": f"with recursive {GRAPH_SQL}, b as (select 'sym:fx:s3' as node, 0 as hop union select target_id, hop + 1 from b join fx_edges on source_id = node where rel_type = 'CALLS' and hop < 8) select node, min(hop)::int as hop from b group by 1 order by 2, 1 limit 40",
    "g14_language_groups": "select * from (values ('go', 'go', 2::bigint), ('python', 'go', 2::bigint), ('typescript', 'typescript', 1::bigint)) t(language, component, size)",
    "g17_context": f"{_B2}, {_LAYERS}, b as (select '{SEED}' as node, 0 as hop union select t, hop + 1 from b join both_ways on f = node where hop < 2) {_LAYERED} where symbol_id in (select node from b group by 1 having min(hop) > 0)",
    "n07_questions": f"""with {_OVERVIEW}, q as (select 0 as kind, row_number() over (order by value desc, item) as pos, item as about, 'Who relies on ' || item || ', and what makes it a hub?' as question from hub
union all select 1, row_number() over (order by value desc, item), item, 'What is cut off if ' || item || ' changes?' from hot
union all select 2, row_number() over (order by value desc, source_id, target_id, rel_type), source_id || ' to ' || target_id, 'Why is there ' || rel_type || ' from ' || source_id || ' to ' || target_id || '?' from odd)
select place, about, question from (select (row_number() over (order by kind, pos))::int as place, about, question from q where pos <= 2) where place <= 5""",
    "n08_overview": f"""with {_OVERVIEW}, r as (select 'hub' as section, item, value::bigint as value from hub union all select 'isolated', item, 0 from iso union all select 'untested', item, value::bigint from hot union all select 'surprise', source_id || ' to ' || target_id, value::bigint from odd),
p as (select *, row_number() over (partition by section order by value desc, item) as place from r)
select section, item, value, case when place <= 2 then case section when 'hub' then 'Who relies on ' || item || '?' when 'untested' then 'Which test would cover ' || item || '?' when 'surprise' then 'What links ' || item || '?' end end as question from p""",
    "n11_changes": f"""with {GRAPH_SQL}, s as (select * from fx_symbols where file_path in (select file_path from fx_symbols where symbol_id like '%5')),
fan as (select target_id, count(*) as k from fx_edges where rel_type in ('CALLS', 'HTTP_CALLS') group by 1), t as (select distinct target_id from fx_edges join fx_symbols on symbol_id = source_id where rel_type = 'CALLS' and {_TEST}),
x as (select target_id, count(distinct source_id) as k from fx_edges join fx_symbols a on a.symbol_id = source_id join fx_symbols b on b.symbol_id = target_id where split_part(a.file_path, '/', 1) <> split_part(b.file_path, '/', 1) group by 1),
c as (select file_path, count(*) % 7 as churn from fx_symbols group by 1),
f as (select symbol_id, coalesce(fan.k, 0) as callers, symbol_id in (select target_id from t) as tested, coalesce(x.k, 0) as xs, churn, lower(name || ' ' || qualified_name) as n from s left join fan on fan.target_id = symbol_id left join x on x.target_id = symbol_id left join c using (file_path)),
r as (select symbol_id, callers, tested, round(least(xs * 0.05::double, 0.15::double) + 0.30::double - least(tested::int / 5.0::double, 1) * 0.25::double + case when regexp_matches(n, 'auth|password|token|secret|crypto|permission|acl|oauth|jwt|session|encrypt|decrypt|login|signup|credential') then 0.20::double else 0 end + least(callers / 20.0::double, 0.10::double) + least(churn / 10.0::double, 1) * 0.15::double, 4) as risk from f)
select symbol_id, callers, tested, risk, case when risk >= 0.75 then 'critical' when risk >= 0.5 then 'high' when risk >= 0.3 then 'medium' else 'low' end as level from r""",
    "n11_change_flows": f"""{flows.FLOWS_SQL}, fm as (select node, round(sum(criticality), 6) as fc from f join c using (entry) group by 1), s as (select * from fx_symbols where file_path in (select file_path from fx_symbols where symbol_id like '%5')),
fan as (select target_id, count(*) as k from fx_edges where rel_type in ('CALLS', 'HTTP_CALLS') group by 1), t as (select distinct target_id from fx_edges join fx_symbols on symbol_id = source_id where rel_type = 'CALLS' and {_TEST}),
x as (select target_id, count(distinct source_id) as k from fx_edges join fx_symbols a on a.symbol_id = source_id join fx_symbols b on b.symbol_id = target_id where split_part(a.file_path, '/', 1) <> split_part(b.file_path, '/', 1) group by 1),
ch as (select file_path, count(*) % 7 as churn from fx_symbols group by 1),
fa as (select symbol_id, case when fc is null then 0 else least(fc, 0.25::double) end as flow, coalesce(fan.k, 0) as callers, symbol_id in (select target_id from t) as tested, coalesce(x.k, 0) as xs, churn, lower(name || ' ' || qualified_name) as n from s left join fan on fan.target_id = symbol_id left join x on x.target_id = symbol_id left join ch using (file_path) left join fm on fm.node = symbol_id),
r as (select symbol_id, callers, tested, round(flow + least(xs * 0.05::double, 0.15::double) + 0.30::double - least(tested::int / 5.0::double, 1) * 0.25::double + case when regexp_matches(n, 'auth|password|token|secret|crypto|permission|acl|oauth|jwt|session|encrypt|decrypt|login|signup|credential') then 0.20::double else 0 end + least(callers / 20.0::double, 0.10::double) + least(churn / 10.0::double, 1) * 0.15::double, 4) as risk from fa)
select symbol_id, callers, tested, risk, case when risk >= 0.75 then 'critical' when risk >= 0.5 then 'high' when risk >= 0.3 then 'medium' else 'low' end as level from r""",
    "r11_boosted": f"with {GRAPH_SQL}, {_DEG}, {_HITS}, r as (select *, (row_number() over (order by score desc, symbol_id))::int as rank from hits) select symbol_id, rank, round(case when rank <= 3 then least(1.0::double, score + least(coalesce(degree, 0), 5) * 0.01::double) else score end, 6) as score from r left join deg using (symbol_id) where rank <= 1000",
    "r12_fallback": f"with {GRAPH_SQL} select symbol_id, name from fx_symbols where contains(lower(name || qualified_name || file_path), 'customer#00000002') order by 1 limit 20",
    "r14_explored": f"""with recursive {GRAPH_SQL}, {_HITS}, b as (select 'sym:fx:s3' as node, 0 as hop union select target_id, hop + 1 from b join fx_edges on source_id = node where rel_type = 'CALLS' and hop < 8),
q as (select symbol_id, file_path, symbol_id in (select node from b) as on_spine, (length(qualified_name) + length(file_path))::bigint as cost, row_number() over (order by symbol_id in (select node from b) desc, score desc, file_path, qualified_name, symbol_id) as n from fx_symbols join hits using (symbol_id)),
f as (select n, case when cost <= 2000 then cost else 0 end as used, cost <= 2000 as taken from q where n = 1 union all select q.n, f.used + case when f.used + cost <= 2000 then cost else 0 end, f.used + cost <= 2000 from f join q on q.n = f.n + 1)
select symbol_id, file_path, on_spine, cost::int as cost from f join q using (n) where taken""",
    "t03_stale_documents": f"with {_STALE} select * from st where finding_kind is not null",
    "t06_audit": rf"with {_STALE}, c as (select regexp_matches(text, '(?m)^# ') as h, regexp_matches(text, '(?mi)^#+ *purpose') as p, len(string_split(text, chr(10))) as n, trim(text, ' ') = '' as e, n_chars from documents), x as (select finding_kind as category from st where finding_kind is not null union all select 'missing_h1' from c where not h union all select 'missing_purpose' from c where not p union all select case when n > 20 then 'over_hard_size' else 'over_size' end from c where n > 5 union all select 'empty' from c where e union all select 'undocumented' from c where n_chars > 3000) select category, count(*) as findings from x group by 1",
    "t07_coverage_layers": f"with {GRAPH_SQL}, {_LAYERS} {_LAYERED}",
    "j11_relinked": f"""with {GRAPH_SQL}, n as (select case when kind = 'function' then split_part(qualified_name, '.', 2) else name end as key, min(symbol_id) as target, count(*) as k from fx_symbols group by 1),
p as (select p_partkey as edge_id, case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then 'Supplier#' || lpad((p_partkey % 20)::varchar, 9, '0') end as key from part)
select edge_id, target, case when k = 1 then 'probable' else 'ambiguous' end as confidence from p join n using (key)""",
    "w07_priorities": "with f as (select p_partkey::varchar as symbol_id, ['unused', 'zombie_package', 'dead', 'unreachable_file'][case when p_partkey < 60 then p_partkey % 4 else 0 end + 1] as finding_kind, p_size / 100.0::double as score, p_partkey as place from part), g as (select *, finding_kind in ('zombie_package', 'unreachable_file') as s from f) select symbol_id, finding_kind, score, place from g order by s desc, case when s then -score end, case when s then symbol_id end, place limit 50",
    "s05_symbol_scan": f"with {GRAPH_SQL} select symbol_id, qualified_name, regexp_replace(file_path, '^.*/', '') as file from fx_symbols where starts_with(file_path, 'supplier/')",
}
