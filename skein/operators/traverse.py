"""Traversals: bounded breadth-first search and fixpoints.

The edges that a search may take are written once, before its first hop. Each hop is one join of them
with the frontier, minus what is known; what a hop finds is written to the checkpoint folder, and
only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import confidence
from skein.functions.lineage import checkpointed
from skein.functions.text import is_entry_name, is_test_path
from skein.sources.tables import GRAPH_SQL, edges, symbols

CALLER_TYPES = ("CALLS", "HTTP_CALLS", "ASYNC_CALLS")
IMPACT_TYPES = ("CALLS", "HTTP_CALLS", "ASYNC_CALLS", "ROUTES_TO")
MAX_ROUNDS = 100
#: So many levels are united before they are written as one.
LEVELS = 20


def directed(edge_rows: DataFrame, direction: str) -> DataFrame:
    """Edges as steps from_id, to_id with step: downstream along them, upstream against them, or both."""
    down = edge_rows.withColumns({"from_id": F.col("source_id"), "to_id": F.col("target_id"), "step": F.lit("downstream")})
    up = edge_rows.withColumns({"from_id": F.col("target_id"), "to_id": F.col("source_id"), "step": F.lit("upstream")})
    return {"downstream": down, "upstream": up, "both": down.unionByName(up)}[direction]


def search(steps: DataFrame, seeds: DataFrame, max_depth: int, found: dict, seed_again: bool = False) -> DataFrame:
    """node, hop and the columns of found (aggregates over a node's steps from the hop before) of all nodes within max_depth.

    steps: from_id, to_id and others; seeds: node. A node has the least hop at which it is reached.
    Seeds have no row, unless seed_again: then one that a cycle reaches has.
    """
    seeds = checkpointed(seeds.select("node").distinct())
    known = None if seed_again else seeds
    frontier, levels = seeds, []
    for hop in range(1, max_depth + 1):
        reached = steps.join(frontier.withColumnRenamed("node", "from_id"), "from_id").groupBy(F.col("to_id").alias("node")).agg(F.lit(hop).alias("hop"), *[v.alias(k) for k, v in found.items()])
        level = checkpointed(reached if known is None else reached.join(known, "node", "left_anti"))
        if not level.limit(1).count():
            break
        levels.append(level)
        known = level.select("node") if known is None else known.union(level.select("node"))
        frontier = level.select("node").join(seeds, "node", "left_anti") if seed_again else level.select("node")
    if not levels:
        empty = steps.limit(0).groupBy(F.col("to_id").alias("node")).agg(F.lit(0).alias("hop"), *[v.alias(k) for k, v in found.items()])
        return empty
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ids], "node string")


def best_edge() -> dict:
    """The strongest confidence among the steps that reach a node, and its relation (of equals the first by name)."""
    best = F.min(F.struct((-confidence.rank(F.col("confidence"))).alias("r"), F.col("rel_type"), F.col("confidence")))
    return {"best": best}


def callers(edge_rows: DataFrame, symbol_rows: DataFrame, seed: str, max_depth: int = 1, top_k: int = 20, floor: str | None = "probable", rel_types: tuple[str, ...] = CALLER_TYPES) -> DataFrame:
    """The first top_k callers of seed: nearest first, then by how often they are called, confidence and name.

    call_count counts the caller's own incoming edges of rel_types whatever their confidence. The
    seed is among its callers where a cycle leads back to it.
    """
    of_type = checkpointed(edge_rows.filter(F.upper("rel_type").isin(*rel_types)))
    allowed = of_type.filter(confidence.meets(F.col("confidence"), floor))
    found = search(directed(allowed, "upstream"), _seed(edge_rows.sparkSession, seed), max(1, min(max_depth, 8)), best_edge(), seed_again=True)
    counts = of_type.withColumnRenamed("target_id", "node").join(found.select("node"), "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("call_count"))
    names = symbol_rows.select(F.col("symbol_id").alias("node"), "qualified_name", "kind", "file_path")
    rows = found.join(counts, "node", "left").join(names, "node", "left").select(
        F.col("node").alias("symbol_id"), "hop", F.col("best.confidence").alias("confidence"), F.coalesce("call_count", F.lit(0)).cast("long").alias("call_count"), F.upper("best.rel_type").alias("via_rel"),
        F.coalesce("qualified_name", "node").alias("qualified_name"), F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("file_path", F.lit("")).alias("file_path"),
    )
    return rows.orderBy("hop", F.desc("call_count"), F.desc(confidence.rank(F.col("confidence"))), "qualified_name", "symbol_id").limit(max(1, min(top_k, 200)))


def impact(edge_rows: DataFrame, seed: str, direction: str = "upstream", max_depth: int = 3, floor: str | None = "probable", rel_types: tuple[str, ...] = IMPACT_TYPES) -> DataFrame:
    """symbol_id, hop, direction (both if a node is reached both ways at its hop), confidence, via_rel of what a change of seed touches; never seed."""
    allowed = checkpointed(edge_rows.filter(F.upper("rel_type").isin(*rel_types) & confidence.meets(F.col("confidence"), floor)))
    ways = {"best": best_edge()["best"], "ways": F.array_sort(F.collect_set("step"))}
    found = search(directed(allowed, direction), _seed(edge_rows.sparkSession, seed), max_depth, ways)
    way = F.when(F.size("ways") > 1, F.lit("both")).otherwise(F.get("ways", 0))
    return found.select(F.col("node").alias("symbol_id"), "hop", way.alias("direction"), F.col("best.confidence").alias("confidence"), F.upper("best.rel_type").alias("via_rel"))


def file_histogram(found: DataFrame, symbol_rows: DataFrame, top: int = 40) -> DataFrame:
    """How many of the symbols found are in each file: most first, then by path."""
    files = found.join(symbol_rows.select("symbol_id", "file_path"), "symbol_id").groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"))
    return files.orderBy(F.desc("symbols"), "file_path").limit(top)


def neighbourhood(edge_rows: DataFrame, seeds: list[str], max_depth: int = 1) -> DataFrame:
    """The distinct edges with an end less than max_depth hops from a seed, whatever their direction."""
    own = _seed(edge_rows.sparkSession, *seeds)
    near = own.withColumn("hop", F.lit(0))
    if max_depth > 1:
        near = near.unionByName(search(directed(edge_rows, "both"), own, max_depth - 1, {}).select("node", "hop"))
    near = near.select("node").distinct()
    a = edge_rows.join(near.withColumnRenamed("node", "source_id"), "source_id").select(*edge_rows.columns)
    b = edge_rows.join(near.withColumnRenamed("node", "target_id"), "target_id").select(*edge_rows.columns)
    return a.unionByName(b).distinct()


def hops(edge_rows: DataFrame, seed: str, max_hops: int) -> DataFrame:
    """node, hop of all within max_hops (at least one) of seed along or against edges."""
    return search(directed(checkpointed(edge_rows.select("source_id", "target_id")), "both"), _seed(edge_rows.sparkSession, seed), max(1, max_hops), {})


def shortest_path(edge_rows: DataFrame, start: str, end: str, max_depth: int = 12) -> DataFrame:
    """pos, node of a shortest undirected path, the least by node ids; start alone if it is the end; no rows if none is found."""
    spark = edge_rows.sparkSession
    if start == end:
        return spark.createDataFrame([(0, start)], "pos int, node string")
    steps = directed(checkpointed(edge_rows.select("source_id", "target_id")), "both")
    paths = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    known = paths.select("node")
    for _ in range(max_depth):
        grown = steps.join(paths, steps["from_id"] == paths["node"]).groupBy(F.col("to_id").alias("node")).agg(F.min("path").alias("path"))
        paths = checkpointed(grown.join(known, "node", "left_anti").withColumn("path", F.concat("path", F.array("node"))))
        hit = paths.filter(F.col("node") == end)
        if hit.limit(1).count():
            return hit.select(F.posexplode("path").alias("pos", "node"))
        if not paths.limit(1).count():
            break
        known = known.union(paths.select("node"))
    return spark.createDataFrame([], "pos int, node string")


def flow(edge_rows: DataFrame, entry: str, max_depth: int = 8) -> DataFrame:
    """node, hop of what calls lead to from entry, itself at hop 0."""
    calls = checkpointed(edge_rows.filter(F.col("rel_type") == "CALLS").select("source_id", "target_id"))
    own = _seed(edge_rows.sparkSession, entry)
    return own.withColumn("hop", F.lit(0)).unionByName(search(directed(calls, "downstream"), own, max_depth, {}))


def entry_points(symbol_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """symbol_id, inbound: symbols whose name says that something outside calls them, and how many calls they have."""
    inbound = edge_rows.filter(F.col("rel_type") == "CALLS").groupBy(F.col("target_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("inbound"))
    return symbol_rows.filter(is_entry_name(F.col("name"))).join(inbound, "symbol_id", "left").select("symbol_id", F.coalesce("inbound", F.lit(0)).cast("long").alias("inbound"))


def reached(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """node of all that seeds reach along steps (from_id, to_id), seeds included, however many hops away."""
    known = frontier = checkpointed(seeds.select("node").distinct())
    hop = 0
    while frontier.limit(1).count():
        found = steps.join(frontier.withColumnRenamed("node", "from_id"), "from_id").select(F.col("to_id").alias("node")).distinct()
        frontier = checkpointed(found.join(known, "node", "left_anti"))
        known, hop = known.union(frontier), hop + 1
        if hop % LEVELS == 0:
            known = checkpointed(known)
    return known


def live(symbol_rows: DataFrame, edge_rows: DataFrame, pool: DataFrame) -> DataFrame:
    """symbol_id of the pool's symbols that production code reaches.

    Roots: symbols of the pool, not of tests, that something outside the pool and not of tests
    strongly uses, or that are entry points by name. Strong uses carry life on, but not from tests.
    """
    tests = symbol_rows.withColumn("is_test", is_test_path(F.col("file_path"))).select("symbol_id", "is_test", "name")
    strong = edge_rows.filter(confidence.is_strong_use(F.col("rel_type"), F.col("confidence"))).select("source_id", "target_id").distinct()
    known = tests.select(F.col("symbol_id").alias("source_id"), F.col("is_test").alias("source_test"))
    carried = checkpointed(strong.join(known, "source_id").filter(~F.col("source_test")).select("source_id", "target_id"))
    mine = pool.select("symbol_id").distinct()
    production = mine.join(tests, "symbol_id").filter(~F.col("is_test"))
    outside = carried.join(mine.withColumnRenamed("symbol_id", "source_id"), "source_id", "left_anti").select(F.col("target_id").alias("symbol_id"))
    used = production.join(outside.distinct(), "symbol_id", "left_semi").select("symbol_id")
    entries = production.filter(is_entry_name(F.col("name"))).select("symbol_id")
    roots = checkpointed(used.union(entries).distinct())
    steps = carried.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"))
    found = reached(steps, roots.withColumnRenamed("symbol_id", "node")).select(F.col("node").alias("symbol_id"))
    return found.join(mine, "symbol_id", "left_semi")


def dead_subgraph(edge_rows: DataFrame, dead: DataFrame) -> DataFrame:
    """symbol_id of dead symbols that are strongly used, and by dead ones only."""
    strong = edge_rows.filter(confidence.is_strong_use(F.col("rel_type"), F.col("confidence")))
    marked = strong.join(dead.select(F.col("symbol_id").alias("source_id"), F.lit(1).alias("is_dead")), "source_id", "left")
    all_dead = marked.groupBy(F.col("target_id").alias("symbol_id")).agg(F.min(F.coalesce("is_dead", F.lit(0))).alias("all_dead")).filter("all_dead = 1")
    return dead.select("symbol_id").join(all_dead, "symbol_id", "left_semi")


def _state(links: DataFrame) -> tuple:
    """How many links a, b, and the sum of their hashes: a decimal, as a long overflows from some 17 million links on."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edge_rows: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """node, component: the least node that a node reaches along or against edges, by alternating stars; within members if given.

    Nodes without edges are left out. Each round halves long paths, so rounds grow with the logarithm of the diameter.
    """
    own = edge_rows.select("source_id", "target_id").filter("source_id <> target_id")
    if members is not None:
        m = members.select(F.col(members.columns[0]).alias("source_id")).distinct()
        own = own.join(m, "source_id", "left_semi").join(m.withColumnRenamed("source_id", "target_id"), "target_id", "left_semi")
    links = checkpointed(own.select(F.greatest("source_id", "target_id").alias("a"), F.least("source_id", "target_id").alias("b")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        links = checkpointed(small)
        now = _state(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


_HUB = "sym:fx:p7"
_LIVE_POOL = "kind in ('function', 'method')"


def _pool(s: DataFrame) -> DataFrame:
    return s.filter(_LIVE_POOL)


def g12_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    return live(s, edges(spark, sf_dir), _pool(s))


def g13_dead_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of classes and functions: what only suppliers use, which nothing uses."""
    s, e = symbols(spark, sf_dir), edges(spark, sf_dir)
    pool = s.filter("kind in ('class', 'function')")
    dead = checkpointed(pool.select("symbol_id").join(live(s, e, pool), "symbol_id", "left_anti"))
    return dead_subgraph(e, dead)


def g15_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of exact calls over HTTP between parts and customers."""
    return components(edges(spark, sf_dir).filter("rel_type = 'HTTP_CALLS' and confidence = 'exact'"))


QUERIES = {
    "g01_callers": lambda spark, d: callers(edges(spark, d), symbols(spark, d), "sym:fx:c7", max_depth=2, top_k=50),
    "g02_impact": lambda spark, d: impact(edges(spark, d), _HUB, "both", 3),
    "g02_impact_files": lambda spark, d: file_histogram(impact(edges(spark, d), _HUB, "both", 2), symbols(spark, d)),
    "g04_neighbourhood": lambda spark, d: neighbourhood(edges(spark, d), [_HUB], 2),
    "g05_subgraph": lambda spark, d: neighbourhood(edges(spark, d), [_HUB, "sym:fx:c7", "sym:fx:s3"], 1),
    "g06_khop": lambda spark, d: hops(edges(spark, d), _HUB, 3),
    "g08_shortest_path": lambda spark, d: shortest_path(edges(spark, d), "sym:fx:s1", "sym:fx:c7"),
    "g09_flow": lambda spark, d: flow(edges(spark, d), "sym:fx:s3"),
    "g10_entry_points": lambda spark, d: entry_points(symbols(spark, d).withColumn("name", F.when(F.col("symbol_id").endswith("7"), F.concat(F.lit("handle_"), F.lower("kind"))).otherwise(F.col("name"))), edges(spark, d)),
    "g12_liveness": g12_liveness,
    "g13_dead_subgraph": g13_dead_subgraph,
    "g15_components": g15_components,
}

_G = f"with recursive {GRAPH_SQL},"
_BOTH = "both_ways as (select source_id as f, target_id as t, 'downstream' as step, * from fx_ranked union all select target_id, source_id, 'upstream', * from fx_ranked)"
_BASE = "(rel_type in ('CALLS', 'HTTP_CALLS') and rank >= 3)"
_IMPACT = f"""{_BOTH}, ok as (select * from both_ways where {_BASE}),
b as (select '{_HUB}' as node, 0 as hop union select t, hop + 1 from b join ok on f = node where hop < {{depth}}),
m as (select node, min(hop) as hop from b group by node)"""
_TEST = "(regexp_matches('/' || lower(file_path) || '/', '/(tests|test|spec|specs|__tests__)/'))"
_LIVE = f"""pool as (select symbol_id from fx_symbols where kind in ('function', 'method')),
strong as (select source_id, target_id from fx_edges where rel_type in ('CALLS', 'IMPORTS', 'HTTP_CALLS') and confidence not in ('ambiguous', 'unresolved')),
carried as (select source_id, target_id from strong join fx_symbols on symbol_id = source_id where not {_TEST}),
roots as (select distinct symbol_id from pool join fx_symbols using (symbol_id) join carried on target_id = symbol_id where not {_TEST} and source_id not in (select symbol_id from pool)),
alive as (select symbol_id from roots union select target_id from alive join carried on source_id = symbol_id),
live as (select distinct symbol_id from alive where symbol_id in (select symbol_id from pool))"""

ORACLE_SQL = {
    "g01_callers": f"""{_G} ok as (select * from fx_ranked where {_BASE}),
b as (select 'sym:fx:c7' as node, 0 as hop union select source_id, hop + 1 from b join ok on target_id = node where hop < 2),
m as (select node, min(hop) as hop from b where hop > 0 group by node),
e as (select m.node, m.hop, min((-rank, rel_type, confidence)) as best from m join ok on source_id = m.node join b on b.node = target_id and b.hop = m.hop - 1 group by all),
n as (select target_id, count(*) as k from fx_edges where rel_type in ('CALLS', 'HTTP_CALLS') group by 1)
select e.node as symbol_id, hop::int as hop, best[3] as confidence, coalesce(k, 0)::bigint as call_count, best[2] as via_rel, qualified_name, kind, file_path
from e left join n on target_id = e.node left join fx_symbols on symbol_id = e.node order by hop, call_count desc, best[1], qualified_name, 1 limit 50""",
    "g02_impact": f"""{_G} {_IMPACT.format(depth=3)}
select m.node as symbol_id, m.hop::int as hop, case when count(distinct step) > 1 then 'both' else min(step) end as direction, min((-rank, rel_type, confidence))[3] as confidence, min((-rank, rel_type, confidence))[2] as via_rel
from m join ok on t = m.node join m p on p.node = f and p.hop = m.hop - 1 where m.hop > 0 group by m.node, m.hop""",
    "g02_impact_files": f"""{_G} {_IMPACT.format(depth=2)}
select file_path, count(*) as symbols from m join fx_symbols on symbol_id = node where hop > 0 group by 1 order by 2 desc, 1 limit 40""",
    "g04_neighbourhood": f"""{_G} n as (select '{_HUB}' as x union select target_id from fx_edges where source_id = '{_HUB}' union select source_id from fx_edges where target_id = '{_HUB}')
select distinct fx_edges.* from fx_edges where source_id in (select x from n) or target_id in (select x from n)""",
    "g05_subgraph": f"with {GRAPH_SQL} select distinct * from fx_edges where source_id in ('{_HUB}', 'sym:fx:c7', 'sym:fx:s3') or target_id in ('{_HUB}', 'sym:fx:c7', 'sym:fx:s3')",
    "g06_khop": f"""{_G} {_BOTH}, b as (select '{_HUB}' as node, 0 as hop union select t, hop + 1 from b join both_ways on f = node where hop < 3)
select node, min(hop)::int as hop from b group by node having min(hop) > 0""",
    "g08_shortest_path": f"""{_G} {_BOTH}, b as (select 'sym:fx:s1' as node, 0 as hop union select t, hop + 1 from b join both_ways on f = node where hop < 4),
m as (select node, min(hop) as hop from b group by node),
p as (select 'sym:fx:c7' as node, ['sym:fx:c7'] as path union select f, list_prepend(f, path) from p join m on p.node = m.node join both_ways on t = p.node join m k on k.node = f and k.hop = m.hop - 1),
best as (select min(path) as path from p where node = 'sym:fx:s1')
select (unnest(range(len(path))))::int as pos, unnest(path) as node from best""",
    "g09_flow": f"""{_G} b as (select 'sym:fx:s3' as node, 0 as hop union select target_id, hop + 1 from b join fx_edges on source_id = node where rel_type = 'CALLS' and hop < 8)
select node, min(hop)::int as hop from b group by node""",
    "g10_entry_points": f"""with {GRAPH_SQL} select symbol_id, (select count(*) from fx_edges where target_id = symbol_id and rel_type = 'CALLS') as inbound from fx_symbols where ends_with(symbol_id, '7')""",
    "g12_liveness": f"{_G} {_LIVE} select symbol_id from live",
    "g13_dead_subgraph": f"""{_G} {_LIVE.replace("'function', 'method'", "'class', 'function'")}, dead as (select symbol_id from pool except select symbol_id from live)
select target_id as symbol_id from strong where target_id in (select symbol_id from dead) group by 1 having bool_and(source_id in (select symbol_id from dead))""",
    "g15_components": f"""{_G} e as (select source_id, target_id from fx_edges where rel_type = 'HTTP_CALLS' and confidence = 'exact'),
w as (select source_id as f, target_id as t from e union select target_id, source_id from e),
r as (select f as node, f as component from w union select t, component from r join w on f = node)
select node, min(component) as component from r group by node""",
}
