"""Analytics over symbols and edges: degrees, gaps, projections, scores, dead code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import confidence, text
from skein.functions.lineage import broadcast_if_small, checkpointed
from skein.operators import code, resolve
from skein.operators.traverse import components, dead_subgraph, live
from skein.sources.tables import GRAPH_SQL, edges, symbols

# Weights of relations in the undirected projection.
WEIGHTS = {"CALLS": 1.0, "HTTP_CALLS": 0.9, "ASYNC_CALLS": 0.9, "INHERITS_FROM": 0.8, "IMPLEMENTS": 0.7, "ROUTES_TO": 0.7, "IMPORTS": 0.5, "TESTED_BY": 0.4, "CONTAINS": 0.3, "DOCUMENTED_BY": 0.2}
OTHER_WEIGHT = 0.5
NOT_HUBS = ("file", "unresolved", "external", "import", "documentation", "route")
STRUCTURAL = ("CALLS", "HTTP_CALLS", "ASYNC_CALLS", "ROUTES_TO", "INHERITS_FROM", "IMPLEMENTS")


def degrees(edge_rows: DataFrame) -> DataFrame:
    """symbol_id, in_degree, out_degree, degree, over all edges."""
    ends = edge_rows.select(F.col("source_id").alias("symbol_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edge_rows.select(F.col("target_id").alias("symbol_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("symbol_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def hubs(symbol_rows: DataFrame, edge_rows: DataFrame, top: int = 10) -> DataFrame:
    """The symbols with most edges, but for files, placeholders, documents and routes; ties by qualified name."""
    rows = symbol_rows.filter(~F.col("kind").isin(*NOT_HUBS)).join(degrees(edge_rows), "symbol_id")
    return rows.select("symbol_id", "qualified_name", "kind", "in_degree", "out_degree", "degree").orderBy(F.desc("degree"), "qualified_name", "symbol_id").limit(top)


def fan_in(edge_rows: DataFrame, rel_types: tuple[str, ...]) -> DataFrame:
    return edge_rows.filter(F.upper("rel_type").isin(*rel_types)).groupBy(F.col("target_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("fan_in"))


def isolated(symbol_rows: DataFrame, edge_rows: DataFrame, rel_types: tuple[str, ...] = STRUCTURAL, top: int = 50) -> DataFrame:
    """Symbols without an edge of rel_types, by qualified name."""
    touched = degrees(edge_rows.filter(F.col("rel_type").isin(*rel_types))).select("symbol_id")
    return symbol_rows.join(touched, "symbol_id", "left_anti").select("symbol_id", "qualified_name").orderBy("qualified_name", "symbol_id").limit(top)


def tested(symbol_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """symbol_id of what is TESTED_BY something, or called from a test's path."""
    by_edge = edge_rows.filter("rel_type = 'TESTED_BY'").select(F.col("source_id").alias("symbol_id"))
    tests = symbol_rows.filter(text.is_test_path(F.col("file_path"))).select(F.col("symbol_id").alias("source_id"))
    called = edge_rows.filter("rel_type = 'CALLS'").join(tests, "source_id", "left_semi").select(F.col("target_id").alias("symbol_id"))
    return by_edge.union(called).distinct()


def untested_hotspots(symbol_rows: DataFrame, edge_rows: DataFrame, least_degree: int = 4, top: int = 30) -> DataFrame:
    """Symbols with many edges that no test calls; dunder names and tests are left out."""
    rows = symbol_rows.join(degrees(edge_rows).filter(F.col("degree") >= least_degree), "symbol_id").filter(~text.is_test_path(F.col("file_path")) & ~F.col("name").startswith("__"))
    rows = rows.join(tested(symbol_rows, edge_rows), "symbol_id", "left_anti")
    return rows.select("symbol_id", "qualified_name", "degree").orderBy(F.desc("degree"), "qualified_name", "symbol_id").limit(top)


def weight(rel_type: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for k, v in WEIGHTS.items():
        out = F.when(rel_type == k, F.lit(v)).otherwise(out)
    return out


def projection(edge_rows: DataFrame) -> DataFrame:
    """a, b, weight: undirected, with a < b; parallel edges add up, loops go."""
    own = edge_rows.filter("source_id <> target_id")
    return own.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.round(F.sum(weight(F.col("rel_type"))), 6).alias("weight"))


def hydrated(edge_rows: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """Edges with the names and kinds of their ends; an end without a symbol keeps its id as name and has kind unknown."""
    out = edge_rows
    for end in ("source", "target"):
        names = symbol_rows.select(F.col("symbol_id").alias(f"{end}_id"), F.col("name").alias("n"), F.col("kind").alias("k"))
        out = out.join(names, f"{end}_id", "left").withColumns({f"{end}_name": F.coalesce("n", f"{end}_id"), f"{end}_kind": F.coalesce("k", F.lit("unknown"))}).drop("n", "k")
    return out


def language_matrix(symbol_rows: DataFrame, edge_rows: DataFrame, samples: int = 5) -> DataFrame:
    """Undirected pairs of different languages: edges, relations (sorted, joined by commas), the first sample edges."""
    of = lambda end: symbol_rows.select(F.col("symbol_id").alias(f"{end}_id"), F.col("language").alias(f"{end}_language"))
    rows = edge_rows.join(of("source"), "source_id").join(of("target"), "target_id").filter("source_language <> target_language")
    edge_id = F.concat_ws("|", "source_id", "rel_type", "target_id")
    pair = [F.least("source_language", "target_language").alias("language_a"), F.greatest("source_language", "target_language").alias("language_b")]
    ranked = rows.select(*pair, "rel_type", edge_id.alias("edge_id"))
    counts = ranked.groupBy("language_a", "language_b").agg(F.count(F.lit(1)).alias("edge_count"), F.array_join(F.array_sort(F.collect_set("rel_type")), ",").alias("rel_types"))
    # Only the first few of each relation can be among the first few of all.
    first = ranked.withColumn("n", F.row_number().over(Window.partitionBy("language_a", "language_b").orderBy("edge_id"))).filter(F.col("n") <= samples)
    named = first.groupBy("language_a", "language_b").agg(F.array_join(F.array_sort(F.collect_list("edge_id")), ",").alias("samples"))
    return counts.join(named, ["language_a", "language_b"])


def language_histogram(symbol_rows: DataFrame) -> DataFrame:
    return symbol_rows.groupBy("language").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"))


def language_by_kind(symbol_rows: DataFrame) -> DataFrame:
    """Symbols by kind and language; blank is unknown."""
    known = F.when(F.trim(F.coalesce("language", F.lit(""))) == "", F.lit("unknown")).otherwise(F.col("language"))
    return symbol_rows.groupBy("kind", known.alias("language")).agg(F.count(F.lit(1)).alias("symbols"))


def surprising(symbol_rows: DataFrame, edge_rows: DataFrame, community: DataFrame, top: int = 20) -> DataFrame:
    """Edges that cross communities (3) and top directories (2), weak ones more (3 less their confidence's rank)."""
    of = symbol_rows.join(community.select("symbol_id", "community"), "symbol_id", "left").withColumn("top", F.substring_index("file_path", "/", 1))
    end = lambda e: of.select(F.col("symbol_id").alias(f"{e}_id"), F.col("community").alias(f"{e}_community"), F.col("top").alias(f"{e}_top"))
    rows = edge_rows.join(end("source"), "source_id").join(end("target"), "target_id")
    rank = confidence.rank(F.col("confidence"))
    score = F.when(~F.col("source_community").eqNullSafe(F.col("target_community")), 3).otherwise(0) + F.when(F.col("source_top") != F.col("target_top"), 2).otherwise(0) + F.when(rank < 3, 3 - rank).otherwise(0)
    return rows.select("source_id", "target_id", "rel_type", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "source_id", "target_id", "rel_type").limit(top)


def change_risk(factors: DataFrame) -> DataFrame:
    """factors with risk (0 to 1, 4 decimals) and level.

    Columns: flow_criticality (sum; null: none), flow_count, cross_community, test_count,
    caller_count, name, qualified_name, churn. Flows give up to 0.25, callers from other
    communities 0.15, missing tests 0.30 down to 0.05, a security name 0.20, callers 0.10, churn 0.15.
    """
    flows = F.when(F.col("flow_criticality").isNotNull(), F.least("flow_criticality", F.lit(0.25))).otherwise(F.least(F.col("flow_count") * 0.05, F.lit(0.25)))
    score = (
        flows + F.least(F.col("cross_community") * 0.05, F.lit(0.15)) + 0.30 - F.least(F.col("test_count") / 5.0, F.lit(1.0)) * 0.25
        + F.when(text.names_security(F.col("name"), F.col("qualified_name")), 0.20).otherwise(0.0)
        + F.least(F.col("caller_count") / 20.0, F.lit(0.10)) + F.least(F.col("churn") / 10.0, F.lit(1.0)) * 0.15
    )
    risk = F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4)
    return factors.withColumn("risk", risk).withColumn("level", F.when(F.col("risk") >= 0.75, "critical").when(F.col("risk") >= 0.5, "high").when(F.col("risk") >= 0.3, "medium").otherwise("low"))


def criticality(file_count: Column, external: Column, security: Column, nodes: Column, depth: Column, digits: int = 4) -> Column:
    """How critical a flow is, 0 to 1: spread over files, calls that leave the graph, security names, an unknown test gap, depth."""
    spread = F.when(file_count > 1, F.least((file_count - 1) / 4.0, F.lit(1.0))).otherwise(0.0)
    score = spread * 0.30 + F.least(external / 5.0, F.lit(1.0)) * 0.20 + F.least(security / F.greatest(nodes, F.lit(1)), F.lit(1.0)) * 0.25 + 0.5 * 0.15 + F.least(depth / 10.0, F.lit(1.0)) * 0.10
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), digits)


def dispatched(calls: DataFrame, inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """source_id, target_id: calls of a base class's method may reach the same method of its subclasses.

    calls: source_id, target_id; inherits: child, parent; methods: method_id, class_id, name.
    """
    called = calls.join(methods.select(F.col("method_id").alias("target_id"), F.col("class_id").alias("parent"), "name"), "target_id")
    below = called.join(inherits, "parent").select("source_id", F.col("child").alias("class_id"), "name")
    return below.join(methods, ["class_id", "name"]).select("source_id", F.col("method_id").alias("target_id")).distinct()


def reconciled(static: DataFrame, observed: DataFrame) -> DataFrame:
    """source_id, target_id, action, confidence of call edges after traces.

    static: source_id, target_id, confidence; observed: source_id, target_id. Observed and known:
    confirm, one step up. Observed only: emit. Known only, from a source that was observed calling
    something else: contradict, one step down and ambiguous at most. Others stay out.
    """
    seen = observed.select("source_id", "target_id").distinct().withColumn("seen", F.lit(True))
    sources = seen.select("source_id").distinct().withColumn("watched", F.lit(True))
    known = static.withColumn("known", F.lit(True))
    both = known.join(seen, ["source_id", "target_id"], "full").join(sources, "source_id", "left").filter("watched")
    action = F.when(F.col("seen") & F.col("known"), "confirm").when(F.col("seen"), "emit").otherwise("contradict")
    down = confidence.demoted(F.col("confidence"))
    made = F.when(F.col("action") == "confirm", confidence.boosted(F.col("confidence"))).when(F.col("action") == "emit", F.lit("probable")).otherwise(F.when(confidence.rank(down) > 2, F.lit("ambiguous")).otherwise(down))
    return both.withColumn("action", action).select("source_id", "target_id", "action", made.alias("confidence"))


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, status (missing, extra or mismatch) of rows in which two tables differ; missing is what right lacks."""
    cols = sorted(c for c in left.columns if c != key)
    hashed = lambda df, to: df.select(key, F.sha2(F.to_json(F.struct(*cols)), 256).alias(to))
    both = hashed(left, "l").join(hashed(right, "r"), key, "full")
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(F.col("l") != F.col("r"), "mismatch")
    return both.select(key, status.alias("status")).filter("status is not null")


def inbound_sources(edge_rows: DataFrame) -> DataFrame:
    """symbol_id, strong (distinct sources of strong uses), weak, uses (edges of use)."""
    rel, c = F.col("rel_type"), F.col("confidence")
    rows = edge_rows.filter(confidence.is_use(rel)).withColumns({"s": confidence.is_strong_use(rel, c), "w": confidence.is_weak_use(rel, c)})
    return rows.groupBy(F.col("target_id").alias("symbol_id")).agg(F.countDistinct(F.when(F.col("s"), F.col("source_id"))).alias("strong"), F.sum(F.col("w").cast("long")).alias("weak"), F.count(F.lit(1)).alias("uses"))


def test_only(symbol_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """symbol_id of symbols that are strongly used, and from tests only."""
    tests = symbol_rows.select(F.col("symbol_id").alias("source_id"), text.is_test_path(F.col("file_path")).alias("is_test"))
    strong = edge_rows.filter(confidence.is_strong_use(F.col("rel_type"), F.col("confidence"))).join(tests, "source_id")
    return strong.groupBy(F.col("target_id").alias("symbol_id")).agg(F.bool_and("is_test").alias("only")).filter("only").select("symbol_id")


def unreachable_files(symbol_rows: DataFrame, edge_rows: DataFrame, dead: DataFrame, pool: DataFrame) -> DataFrame:
    """file_path, members of files whose pool members are all dead and which nothing imports."""
    imported = edge_rows.filter("rel_type = 'IMPORTS'").select(F.col("target_id").alias("symbol_id")).distinct().withColumn("imported", F.lit(1))
    d = dead.select("symbol_id").withColumn("dead", F.lit(1))
    rows = symbol_rows.join(pool.select("symbol_id").withColumn("member", F.lit(1)), "symbol_id", "left").join(d, "symbol_id", "left").join(imported, "symbol_id", "left")
    by_file = rows.groupBy("file_path").agg(F.sum(F.coalesce("member", F.lit(0))).alias("members"), F.sum(F.coalesce("dead", F.lit(0))).alias("dead"), F.max(F.coalesce("imported", F.lit(0))).alias("imported"))
    return by_file.filter("members > 0 and dead = members and imported = 0").select("file_path", "members")


def dead_code_score(rows: DataFrame) -> DataFrame:
    """rows with score, tier and safe_to_delete.

    Columns: finding_kind, visibility, live_importers, wip, test_only, weak_edges, dynamic_loader.
    A base by kind and visibility, then caps that only lower it.
    """
    private = F.lower(F.coalesce("visibility", F.lit(""))).isin("private", "protected", "internal")
    kind = F.col("finding_kind")
    base = F.when(kind.isin("unreachable_file", "zombie_package"), 0.70).when(kind == "unwired_shared_package", 0.65).when(kind == "runtime_dead", 0.45).when(private & F.col("live_importers"), 0.95).otherwise(0.80)
    cap = lambda c, at: F.when(F.col(c), at).otherwise(1.0)
    score = F.least(base, cap("wip", 0.55), cap("test_only", 0.45), cap("weak_edges", 0.55), cap("dynamic_loader", 0.40))
    out = rows.withColumn("score", F.round(score, 4)).withColumn("tier", F.when(F.col("score") >= 0.80, "high").when(F.col("score") >= 0.50, "medium").otherwise("low"))
    return out.withColumn("safe_to_delete", (F.col("score") >= 0.80) & ~F.col("test_only") & ~F.col("dynamic_loader"))


def unused_candidates(symbol_rows: DataFrame, edge_rows: DataFrame, pool: DataFrame) -> DataFrame:
    """symbol_id, finding_kind, score, tier of the pool's symbols that no production code reaches.

    Dead symbols that only dead ones use are a dead subgraph, unless only tests use them. Files that
    something not dead imports have live importers. If symbol_rows have signature and body, those
    in a directory with a dynamic loader are marked.
    """
    edge_rows = checkpointed(edge_rows)
    alive = checkpointed(live(symbol_rows, edge_rows, pool))
    dead = checkpointed(pool.select("symbol_id").join(alive, "symbol_id", "left_anti"))
    used = inbound_sources(edge_rows)
    sub = dead_subgraph(edge_rows, dead).withColumn("sub", F.lit(True))
    imported = resolve.live_import_paths(edge_rows, symbol_rows, symbol_rows.select("symbol_id").join(dead, "symbol_id", "left_anti")).withColumn("imported", F.lit(True))
    directory = F.regexp_extract(text.path(F.col("file_path")), r"^(.*)/[^/]*$", 1)
    loads = {"signature", "body"} <= set(symbol_rows.columns)
    only = test_only(symbol_rows, edge_rows).withColumn("by_tests", F.lit(True))
    rows = dead.join(symbol_rows.select("symbol_id", "name", "file_path"), "symbol_id").join(used, "symbol_id", "left").join(only, "symbol_id", "left").join(sub, "symbol_id", "left").join(imported, "file_path", "left")
    rows = rows.withColumn("directory", directory).join(code.loader_directories(symbol_rows).withColumn("loader", F.lit(True)), "directory", "left") if loads else rows.withColumn("loader", F.lit(False))
    rows = rows.select(
        "symbol_id", F.when(F.col("sub") & ~F.coalesce("by_tests", F.lit(False)), "dead_subgraph").otherwise("unused_symbol").alias("finding_kind"), F.when(F.col("name").startswith("_"), "private").otherwise("public").alias("visibility"),
        F.coalesce("imported", F.lit(False)).alias("live_importers"), F.col("file_path").rlike(r"(?i)(^|/)(wip|draft|experimental|sandbox)(/|$)").alias("wip"), F.coalesce("by_tests", F.lit(False)).alias("test_only"), (F.coalesce("weak", F.lit(0)) > 0).alias("weak_edges"), F.coalesce("loader", F.lit(False)).alias("dynamic_loader"),
    )
    return dead_code_score(rows).select("symbol_id", "finding_kind", "test_only", "weak_edges", "live_importers", "dynamic_loader", "score", "tier", "safe_to_delete")


def community_labels(symbol_rows: DataFrame, community: DataFrame) -> DataFrame:
    """community, size, label: the commonest word of three letters or more among the members' names, and -cluster."""
    named = community.join(symbol_rows.select(F.col("symbol_id").alias("node"), "name"), "node", "left")
    sizes = named.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    word = named.select("community", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("name", F.lit(""))), F.lit("([a-z]{3,})"), F.lit(1)))).alias("word")).groupBy("community", "word").agg(F.count(F.lit(1)).alias("n"))
    top = word.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("t"))
    return sizes.join(top, "community", "left").select("community", "size", F.concat(F.coalesce("t.word", F.lit("misc")), F.lit("-cluster")).alias("label"))


def numbered(rows: DataFrame, by: str, name: str = "n") -> DataFrame:
    """rows with name, their place from 0 in the order of by: ranges sorted each by itself, and a sum over the ranges' sizes."""
    ranged = checkpointed(rows.repartitionByRange(by).sortWithinPartitions(by).withColumns({"__id": F.monotonically_increasing_id()}))
    placed = ranged.withColumn("__part", F.shiftright("__id", 33))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = sizes.withColumn("__before", F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    joined = placed.join(F.broadcast(before.select("__part", "__before")), "__part")
    return joined.select(*rows.columns, (F.coalesce("__before", F.lit(0)) + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def betweenness(edge_rows: DataFrame, symbol_rows: DataFrame | None = None, most_sources: int = 80) -> DataFrame:
    """node, betweenness: mean dependency over up to most_sources sources; undirected, without weights.

    Nodes are the symbols other than files and placeholders (without symbol_rows: the edges' ends),
    in the order of their ids; sources are the first most_sources of every step-th of them, step
    being their number by most_sources, rounded down. Brandes's two passes as joins: path counts
    outward by level from all sources at once until nothing new is reached, then dependencies back.
    What a level reaches is new if the last two levels lack it, as no edge skips a level.
    """
    pairs = projection(edge_rows).select("a", "b")
    if symbol_rows is not None:
        own = checkpointed(symbol_rows.filter(~F.col("kind").isin(*NOT_HUBS[:5])).select(F.col("symbol_id").alias("v")).distinct())
        pairs = pairs.join(own.withColumnRenamed("v", "a"), "a", "left_semi").join(own.withColumnRenamed("v", "b"), "b", "left_semi")
    pairs = checkpointed(pairs)
    both = pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).union(pairs.select(F.col("b").alias("v"), F.col("a").alias("w")))
    nodes = both.select("v").distinct() if symbol_rows is None else own
    n = nodes.count()
    if not n:
        return nodes.select(F.col("v").alias("node"), F.lit(0.0).alias("betweenness"))
    step = max(1, n // most_sources)
    sources = checkpointed(numbered(nodes, "v").filter((F.col("n") % step == 0) & (F.col("n") < step * most_sources)).select(F.col("v").alias("s")))
    k = sources.count()
    levels = [checkpointed(sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")))]
    while True:
        reach = levels[-1].join(both, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        for before in levels[-2:]:
            reach = reach.join(before.select("s", "v"), ["s", "v"], "left_anti")
        level = checkpointed(reach)
        if not level.limit(1).count():
            break
        levels.append(level)
    total, below = None, None
    for d in range(len(levels) - 1, 0, -1):
        here = levels[d] if below is None else levels[d].join(below, ["s", "v"], "left")
        here = checkpointed(here.withColumn("dep", F.lit(0.0) if below is None else F.coalesce("dep", F.lit(0.0))))
        each = here.groupBy("v").agg(F.sum("dep").alias("dep"))
        total = each if total is None else total.union(each)
        back = here.select("s", F.col("v").alias("w"), (((1 + F.col("dep")) / F.col("paths"))).alias("share")).join(both, "w").join(levels[d - 1].select("s", "v", "paths"), ["s", "v"])
        below = back.groupBy("s", "v").agg(F.sum(F.col("paths") * F.col("share")).alias("dep"))
    scores = total.groupBy("v").agg(F.sum("dep").alias("dep")) if total is not None else nodes.withColumn("dep", F.lit(0.0))
    return nodes.join(scores, "v", "left").select(F.col("v").alias("node"), F.round(F.coalesce("dep", F.lit(0.0)) / k, 6).alias("betweenness"))


def _community(s: DataFrame) -> DataFrame:
    """A stand-in that SQL has too: symbols by kind and the end of their number."""
    return s.select("symbol_id", F.concat_ws("-", "kind", F.substring("symbol_id", -1, 1)).alias("community"))


def _pool(s: DataFrame) -> DataFrame:
    return s.filter("kind in ('function', 'method')")


def _factors(s: DataFrame, e: DataFrame) -> DataFrame:
    number = F.substring("symbol_id", 9, 20).cast("long")
    rows = s.join(degrees(e), "symbol_id")
    return rows.select("symbol_id", "name", "qualified_name", F.when(number % 3 == 0, (number % 7) / 20.0).alias("flow_criticality"), (number % 4).alias("flow_count"), (number % 5).alias("cross_community"), (number % 6).alias("test_count"), F.col("in_degree").alias("caller_count"), (number % 11).alias("churn"))


def n16_unreachable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = symbols(spark, sf_dir), edges(spark, sf_dir)
    dead = _pool(s).select("symbol_id").join(live(s, e, _pool(s)), "symbol_id", "left_anti")
    return unreachable_files(s, e, dead, _pool(s))


def n15_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third symbol private, and a few bodies with a dynamic loader."""
    n = F.substring("symbol_id", 9, 20).cast("long")
    body = F.when(n % 997 == 5, "m = importlib.import_module('x')").otherwise("return 1")
    s = symbols(spark, sf_dir).withColumns({"name": F.when(n % 3 == 0, F.concat(F.lit("_"), "name")).otherwise(F.col("name")), "signature": F.lit("def f()"), "body": body})
    return unused_candidates(s, edges(spark, sf_dir), _pool(s))


def j10_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls against traces that have the suppliers' returned shipments."""
    seen = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R' and l_suppkey % 2 = 0")
    observed = seen.select(F.concat(F.lit("sym:fx:s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("sym:fx:p"), F.col("l_partkey").cast("string")).alias("target_id"))
    return reconciled(edges(spark, sf_dir).filter("rel_type = 'CALLS'").select("source_id", "target_id", "confidence"), observed)


def j20_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir).select("symbol_id", "kind", "name")
    other = s.filter(~F.col("symbol_id").endswith("3")).withColumn("name", F.when(F.col("symbol_id").endswith("5"), F.lit("x")).otherwise(F.col("name")))
    return parity(s.filter(~F.col("symbol_id").endswith("9")), other, "symbol_id")


QUERIES = {
    "a07_degree_hubs": lambda spark, d: hubs(symbols(spark, d), edges(spark, d)),
    "g03_fan_in": lambda spark, d: fan_in(edges(spark, d), ("CALLS", "HTTP_CALLS")),
    "a08_isolated": lambda spark, d: isolated(symbols(spark, d), edges(spark, d).filter("confidence = 'exact'")),
    "a08_untested_hotspots": lambda spark, d: untested_hotspots(symbols(spark, d), edges(spark, d)),
    "a09_tested": lambda spark, d: tested(symbols(spark, d), edges(spark, d).withColumn("rel_type", F.when(F.col("confidence") == "exact", F.lit("CALLS")).otherwise(F.col("rel_type")))),
    "a04_language_matrix": lambda spark, d: language_matrix(symbols(spark, d), edges(spark, d)),
    "a04_language_histogram": lambda spark, d: language_histogram(symbols(spark, d)),
    "x10_language_by_kind": lambda spark, d: language_by_kind(symbols(spark, d)),
    "n01_projection": lambda spark, d: projection(edges(spark, d)),
    "n03_community_labels": lambda spark, d: community_labels(symbols(spark, d), _community(symbols(spark, d)).withColumnRenamed("symbol_id", "node")),
    "n05_betweenness": lambda spark, d: betweenness(edges(spark, d).filter("confidence = 'exact' and rel_type = 'CALLS'"), symbols(spark, d)),
    "n06_surprising": lambda spark, d: surprising(symbols(spark, d), edges(spark, d), _community(symbols(spark, d)), 50),
    "n09_criticality": lambda spark, d: _factors(symbols(spark, d), edges(spark, d)).select("symbol_id", criticality(F.col("flow_count"), F.col("cross_community"), F.col("test_count"), F.col("churn"), F.col("caller_count"), digits=8).alias("criticality")),
    "n10_change_risk": lambda spark, d: change_risk(_factors(symbols(spark, d), edges(spark, d))).select("symbol_id", "risk", "level"),
    "n15_unused_candidates": n15_unused,
    "n16_unreachable_files": n16_unreachable_files,
    "n20_test_only": lambda spark, d: test_only(symbols(spark, d), edges(spark, d)),
    "x15_inbound_sources": lambda spark, d: inbound_sources(edges(spark, d)),
    "j01_hydrated_edges": lambda spark, d: hydrated(edges(spark, d), symbols(spark, d).filter("kind <> 'method'")),
    "j10_runtime_reconcile": j10_runtime,
    "j20_parity": j20_parity,
}

_G = f"with {GRAPH_SQL},"
_R = f"with recursive {GRAPH_SQL},"
_DEG = "deg as (select symbol_id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree, count(*) as degree from (select source_id as symbol_id, 0 as i, 1 as o from fx_edges union all select target_id, 1, 0 from fx_edges) group by 1)"
_TEST = "regexp_matches('/' || lower(file_path) || '/', '/(tests|test|spec|specs|__tests__)/')"
_STRONG = "strong as (select source_id, target_id from fx_edges where rel_type in ('CALLS', 'IMPORTS', 'HTTP_CALLS') and confidence not in ('ambiguous', 'unresolved'))"
_WEIGHT = "case rel_type when 'CALLS' then 1.0 when 'HTTP_CALLS' then 0.9 when 'IMPORTS' then 0.5 end"
_LIVE = f"""pool as (select symbol_id from fx_symbols where kind in ('function', 'method')), {_STRONG},
carried as (select source_id, target_id from strong join fx_symbols on symbol_id = source_id where not {_TEST}),
alive as (select distinct symbol_id from pool join fx_symbols using (symbol_id) join carried on target_id = symbol_id where not {_TEST} and source_id not in (select symbol_id from pool)
  union select target_id from alive join carried on source_id = symbol_id),
dead as (select symbol_id from pool except select symbol_id from alive)"""
_COMMUNITY = "(kind || '-' || right(symbol_id, 1))"
_NUMBER = "substr(symbol_id, 9)::bigint"
ORACLE_SQL = {
    "a07_degree_hubs": f"{_G} {_DEG} select symbol_id, qualified_name, kind, in_degree, out_degree, degree from fx_symbols join deg using (symbol_id) order by degree desc, qualified_name, symbol_id limit 10",
    "g03_fan_in": f"with {GRAPH_SQL} select target_id as symbol_id, count(*) as fan_in from fx_edges where rel_type in ('CALLS', 'HTTP_CALLS') group by 1",
    "a08_isolated": f"{_G} t as (select source_id as x from fx_edges where confidence = 'exact' and rel_type in ('CALLS', 'HTTP_CALLS') union select target_id from fx_edges where confidence = 'exact' and rel_type in ('CALLS', 'HTTP_CALLS')) select symbol_id, qualified_name from fx_symbols where symbol_id not in (select x from t) order by 2, 1 limit 50",
    "a08_untested_hotspots": f"{_G} {_DEG}, t as (select target_id from fx_edges join fx_symbols on symbol_id = source_id where rel_type = 'CALLS' and {_TEST}) select symbol_id, qualified_name, degree from fx_symbols join deg using (symbol_id) where degree >= 4 and not {_TEST} and symbol_id not in (select target_id from t) order by 3 desc, 2, 1 limit 30",
    "a09_tested": f"{_G} t as (select distinct target_id as symbol_id from fx_edges join fx_symbols on symbol_id = source_id where (rel_type = 'CALLS' or confidence = 'exact') and {_TEST}) select symbol_id from t",
    "a04_language_matrix": f"{_G} p as (select least(a.language, b.language) as language_a, greatest(a.language, b.language) as language_b, rel_type, source_id || '|' || rel_type || '|' || target_id as e from fx_edges join fx_symbols a on a.symbol_id = source_id join fx_symbols b on b.symbol_id = target_id where a.language <> b.language) select language_a, language_b, count(*) as edge_count, string_agg(distinct rel_type, ',' order by rel_type) as rel_types, array_to_string(list_sort(list(e))[1:5], ',') as samples from p group by 1, 2",
    "a04_language_histogram": f"with {GRAPH_SQL} select language, count(distinct file_path) as files, count(*) as symbols from fx_symbols group by 1",
    "x10_language_by_kind": f"with {GRAPH_SQL} select kind, language, count(*) as symbols from fx_symbols group by 1, 2",
    "n01_projection": f"with {GRAPH_SQL} select least(source_id, target_id) as a, greatest(source_id, target_id) as b, round(sum({_WEIGHT})::double, 6) as weight from fx_edges where source_id <> target_id group by 1, 2",
    "n03_community_labels": f"{_G} n as (select {_COMMUNITY} as community, name from fx_symbols), w as (select community, unnest(list_distinct(regexp_extract_all(lower(name), '[a-z]{{3,}}'))) as word from n), c as (select community, word, count(*) as k from w group by all), t as (select community, min((-k, word))[2] as word from c group by 1) select community, count(*) as size, any_value(word) || '-cluster' as label from n join t using (community) group by 1",
    "n06_surprising": f"{_G} s as (select *, {_COMMUNITY} as c, split_part(file_path, '/', 1) as top from fx_symbols), e as (select source_id, target_id, rel_type, (case when a.c <> b.c then 3 else 0 end + case when a.top <> b.top then 2 else 0 end + case when rank < 3 then 3 - rank else 0 end)::int as score from fx_ranked join s a on a.symbol_id = source_id join s b on b.symbol_id = target_id) select * from e where score > 0 order by score desc, source_id, target_id, rel_type limit 50",
    "n09_criticality": f"{_G} {_DEG}, f as (select symbol_id, {_NUMBER} as n, in_degree from fx_symbols join deg using (symbol_id)) select symbol_id, round(least(greatest(case when n % 4 > 1 then least((n % 4 - 1) / 4.0::double, 1) else 0 end * 0.30::double + least((n % 5) / 5.0::double, 1) * 0.20::double + least((n % 6) / greatest(n % 11, 1)::double, 1) * 0.25::double + 0.5::double * 0.15::double + least(in_degree / 10.0::double, 1) * 0.10::double, 0), 1), 8) as criticality from f",
    "n10_change_risk": f"{_G} {_DEG}, f as (select symbol_id, {_NUMBER} as n, in_degree, lower(name || ' ' || qualified_name) as x from fx_symbols join deg using (symbol_id)), r as (select symbol_id, round(least(greatest(case when n % 3 = 0 then least((n % 7) / 20.0::double, 0.25::double) else least((n % 4) * 0.05::double, 0.25::double) end + least((n % 5) * 0.05::double, 0.15::double) + 0.30::double - least((n % 6) / 5.0::double, 1) * 0.25::double + case when regexp_matches(x, 'auth|password|token|secret|crypto|permission|acl|oauth|jwt|session|encrypt|decrypt|login|signup|credential') then 0.20::double else 0 end + least(in_degree / 20.0::double, 0.10::double) + least((n % 11) / 10.0::double, 1) * 0.15::double, 0), 1), 4) as risk from f) select symbol_id, risk, case when risk >= 0.75 then 'critical' when risk >= 0.5 then 'high' when risk >= 0.3 then 'medium' else 'low' end as level from r",
    "n15_unused_candidates": f"""{_R} {_LIVE}, u as (select target_id as symbol_id, count(distinct source_id) filter (confidence not in ('ambiguous', 'unresolved')) as strong, count(*) filter (confidence in ('ambiguous', 'unresolved')) as weak from fx_edges group by 1),
t as (select target_id as symbol_id from strong join fx_symbols on symbol_id = source_id group by 1 having bool_and({_TEST})),
g as (select target_id from strong where target_id in (select symbol_id from dead) group by 1 having bool_and(source_id in (select symbol_id from dead))),
im as (select distinct b.file_path from fx_edges join fx_symbols a on a.symbol_id = source_id join fx_symbols b on b.symbol_id = target_id where rel_type = 'IMPORTS' and a.file_path <> b.file_path and source_id not in (select symbol_id from dead)),
ld as (select distinct regexp_extract(file_path, '^(.*)/[^/]*$', 1) as dir from fx_symbols where {_NUMBER} % 997 = 5),
r as (select symbol_id, symbol_id in (select symbol_id from t) as test_only, symbol_id in (select target_id from g) as sub, coalesce(weak, 0) > 0 as weak_edges, file_path in (select file_path from im) as live_importers, regexp_extract(file_path, '^(.*)/[^/]*$', 1) in (select dir from ld) as dynamic_loader, {_NUMBER} % 3 = 0 as private from dead join fx_symbols using (symbol_id) left join u using (symbol_id)),
s as (select *, least(case when private and live_importers then 0.95::double else 0.80::double end, case when test_only then 0.45 else 1 end, case when weak_edges then 0.55 else 1 end, case when dynamic_loader then 0.40 else 1 end) as score from r)
select symbol_id, case when sub and not test_only then 'dead_subgraph' else 'unused_symbol' end as finding_kind, test_only, weak_edges, live_importers, dynamic_loader, score::double as score, case when score >= 0.8 then 'high' when score >= 0.5 then 'medium' else 'low' end as tier, score >= 0.8 and not test_only and not dynamic_loader as safe_to_delete from s""",
    "n16_unreachable_files": f"{_R} {_LIVE}, f as (select file_path, count(*) filter (symbol_id in (select symbol_id from pool)) as members, count(*) filter (symbol_id in (select symbol_id from dead)) as d, count(*) filter (symbol_id in (select target_id from fx_edges where rel_type = 'IMPORTS')) as i from fx_symbols group by 1) select file_path, members from f where members > 0 and d = members and i = 0",
    "n20_test_only": f"{_G} {_STRONG} select target_id as symbol_id from strong join fx_symbols on symbol_id = source_id group by 1 having bool_and({_TEST})",
    "x15_inbound_sources": f"with {GRAPH_SQL} select target_id as symbol_id, count(distinct source_id) filter (confidence not in ('ambiguous', 'unresolved')) as strong, count(*) filter (confidence in ('ambiguous', 'unresolved')) as weak, count(*) as uses from fx_edges where rel_type in ('CALLS', 'IMPORTS', 'HTTP_CALLS') group by 1",
    "j01_hydrated_edges": f"with {GRAPH_SQL} select e.*, coalesce(a.name, source_id) as source_name, coalesce(a.kind, 'unknown') as source_kind, coalesce(b.name, target_id) as target_name, coalesce(b.kind, 'unknown') as target_kind from fx_edges e left join fx_symbols a on a.symbol_id = source_id and a.kind <> 'method' left join fx_symbols b on b.symbol_id = target_id and b.kind <> 'method'",
    "j10_runtime_reconcile": f"""{_G} o as (select distinct 'sym:fx:s' || l_suppkey as source_id, 'sym:fx:p' || l_partkey as target_id from lineitem where l_returnflag = 'R' and l_suppkey % 2 = 0),
k as (select source_id, target_id, confidence from fx_edges where rel_type = 'CALLS'),
b as (select coalesce(k.source_id, o.source_id) as source_id, coalesce(k.target_id, o.target_id) as target_id, confidence, k.source_id is not null as known, o.source_id is not null as seen from k full join o using (source_id, target_id))
select source_id, target_id, case when known and seen then 'confirm' when seen then 'emit' else 'contradict' end as action,
case when known and seen then case confidence when 'unresolved' then 'ambiguous' when 'ambiguous' then 'probable' else 'exact' end when seen then 'probable' else case confidence when 'exact' then 'ambiguous' when 'probable' then 'ambiguous' else 'unresolved' end end as confidence
from b where source_id in (select source_id from o)""",
    "j20_parity": f"with {GRAPH_SQL} select symbol_id, case when symbol_id like '%3' then 'missing' when symbol_id like '%9' then 'extra' else 'mismatch' end as status from fx_symbols where right(symbol_id, 1) in ('3', '5', '9')",
}
