"""Flows of all entries at once: what calls lead to from each, how critical that is, and which flows a symbol is in.

One breadth-first search is keyed by (entry, node): each hop joins the frontier of all entries with
the calls, subtracts what an entry has, and keeps an entry's first nodes up to its cap. An entry
whose cap is reached leaves the frontier, so the frontier has at most MAX_NODES rows an entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import confidence
from skein.functions.lineage import written
from skein.functions.text import SECURITY_WORDS, names_security
from skein.operators import graph
from skein.sources.tables import GRAPH_SQL, edges, symbols

MAX_DEPTH = 8
MAX_NODES = 40


def flows(entries: DataFrame, symbol_rows: DataFrame, calls: DataFrame, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> DataFrame:
    """entry, node, hop, place (from 1): the first max_nodes nodes, by hop and id, that calls lead to from each entry, itself first.

    entries: symbol_id; calls: source_id, target_id. Only known symbols are in a flow. Ties within a
    hop go to the lesser id, so a flow does not depend on the order of the calls.
    """
    known = symbol_rows.select(F.col("symbol_id").alias("target_id")).distinct()
    steps = written(calls.select("source_id", "target_id").filter("source_id <> target_id").distinct().join(known, "target_id", "left_semi"))
    own = entries.select(F.col("symbol_id").alias("entry")).distinct().join(known.withColumnRenamed("target_id", "entry"), "entry", "left_semi")
    level = written(own.select("entry", F.col("entry").alias("node"), F.lit(0).alias("hop"), F.lit(1).alias("place")))
    levels, found = [level], level
    for hop in range(1, max_depth + 1):
        reached = level.select("entry", F.col("node").alias("source_id")).join(steps, "source_id").select("entry", F.col("target_id").alias("node")).distinct()
        new = reached.join(found.select("entry", "node"), ["entry", "node"], "left_anti")
        had = found.groupBy("entry").agg(F.count(F.lit(1)).cast("int").alias("had"))
        nth = F.row_number().over(Window.partitionBy("entry").orderBy("node"))
        # The limit comes first, so that Spark keeps so many rows an entry in each task before it shuffles.
        first = new.withColumn("nth", nth).filter(F.col("nth") <= max_nodes - 1)
        level = written(first.join(had, "entry").withColumn("place", F.col("had") + F.col("nth")).filter(F.col("place") <= max_nodes).select("entry", "node", F.lit(hop).alias("hop"), "place"))
        if not level.limit(1).count():
            break
        levels.append(level)
        found = written(found.unionByName(level))
        full = found.filter(F.col("place") == max_nodes).select("entry")
        level = level.join(full, "entry", "left_anti")
    return found


def criticalities(found: DataFrame, symbol_rows: DataFrame, calls: DataFrame, digits: int = 4) -> DataFrame:
    """entry, nodes, depth, file_count, external (calls that leave the known symbols), security (names that speak of it), criticality of flows()."""
    known = symbol_rows.select(F.col("symbol_id").alias("node"), "name", "qualified_name", "file_path")
    leaving = calls.join(known.select(F.col("node").alias("target_id")), "target_id", "left_anti").groupBy(F.col("source_id").alias("node")).agg(F.count(F.lit(1)).alias("leaving"))
    named = names_security(F.coalesce("name", F.lit("")), F.coalesce("qualified_name", F.lit("")))
    rows = found.join(known, "node").join(leaving, "node", "left")
    files = F.countDistinct(F.when(F.col("file_path") != "", F.col("file_path")))
    each = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("nodes"), F.max("hop").alias("depth"), files.alias("file_count"), F.coalesce(F.sum("leaving"), F.lit(0)).alias("external"), F.count_if(named).alias("security"))
    return each.withColumn("criticality", graph.criticality(F.col("file_count"), F.col("external"), F.col("security"), F.col("nodes"), F.col("depth"), digits=digits))


def membership(found: DataFrame, critical: DataFrame, digits: int = 8) -> DataFrame:
    """symbol_id, flow_criticality (sum), flow_count: the flows that each symbol is in."""
    rows = found.select("entry", F.col("node").alias("symbol_id")).join(critical.select("entry", "criticality"), "entry")
    return rows.groupBy("symbol_id").agg(F.round(F.sum("criticality"), digits).alias("flow_criticality"), F.count(F.lit(1)).alias("flow_count"))


def affected(found: DataFrame, critical: DataFrame, changed: DataFrame) -> DataFrame:
    """entry, depth, file_count, criticality, hits of the flows that hold a changed symbol (symbol_id), and how many they hold."""
    hits = found.join(changed.select(F.col("symbol_id").alias("node")).distinct(), "node", "left_semi").groupBy("entry").agg(F.count(F.lit(1)).alias("hits"))
    return critical.join(hits, "entry").select("entry", "depth", "file_count", "criticality", "hits")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols without every tenth customer, whom calls leave for; firm calls; entries: suppliers and parts with some last digits)."""
    s = symbols(spark, sf_dir)
    e = edges(spark, sf_dir)
    known = s.filter("not (kind = 'method' and symbol_id like '%9')")
    calls = e.filter(F.col("rel_type").isin("CALLS", "HTTP_CALLS") & confidence.meets(F.col("confidence"), "probable")).select("source_id", "target_id")
    entries = s.filter("(kind = 'class' and symbol_id like '%3') or (kind = 'function' and symbol_id like '%7')").select("symbol_id")
    return known, calls, entries


def traced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flows, their criticalities, the known symbols) of the graph."""
    known, calls, entries = _graph(spark, sf_dir)
    found = flows(entries, known, calls)
    return found, written(criticalities(found, known, calls, digits=8)), known


def n11_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, critical, known = traced(spark, sf_dir)
    return affected(found, critical, known.filter("symbol_id like '%55'"))


def n11_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, critical, _ = traced(spark, sf_dir)
    return membership(found, critical, 6)


QUERIES = {
    "g09_flows": lambda spark, d: traced(spark, d)[0],
    "n09_flow_criticality": lambda spark, d: traced(spark, d)[1],
    "n11_affected_flows": n11_affected,
    "n11_flow_membership": n11_membership,
}

_SECURITY = "|".join(SECURITY_WORDS)
FLOWS_SQL = f"""with recursive {GRAPH_SQL},
known as (select * from fx_symbols where not (kind = 'method' and symbol_id like '%9')),
calls as (select source_id, target_id from fx_ranked where rel_type in ('CALLS', 'HTTP_CALLS') and rank >= 3),
w as (select symbol_id as entry, symbol_id as node, 0 as hop from known where (kind = 'class' and symbol_id like '%3') or (kind = 'function' and symbol_id like '%7')
  union select entry, target_id, hop + 1 from w join calls on source_id = node join known on symbol_id = target_id where hop < {MAX_DEPTH}),
f as (select * from (select entry, node, hop, (row_number() over (partition by entry order by hop, node))::int as place from (select entry, node, min(hop) as hop from w group by all)) where place <= {MAX_NODES}),
lv as (select source_id as node, count(*) as leaving from calls where target_id not in (select symbol_id from known) group by 1),
m as (select entry, count(*) as nodes, max(hop) as depth, count(distinct file_path) as file_count, coalesce(sum(leaving), 0)::bigint as external,
  count(*) filter (regexp_matches(lower(name || ' ' || qualified_name), '{_SECURITY}')) as security from f join known on symbol_id = node left join lv using (node) group by entry),
c as (select *, round(least(greatest(case when file_count > 1 then least((file_count - 1) / 4.0::double, 1) else 0 end * 0.30::double + least(external / 5.0::double, 1) * 0.20::double
  + least(security / greatest(nodes, 1)::double, 1) * 0.25::double + 0.5::double * 0.15::double + least(depth / 10.0::double, 1) * 0.10::double, 0), 1), 8) as criticality from m)"""
ORACLE_SQL = {
    "g09_flows": f"{FLOWS_SQL} select * from f",
    "n09_flow_criticality": f"{FLOWS_SQL} select * from c",
    "n11_affected_flows": f"{FLOWS_SQL} select entry, depth, file_count, criticality, hits from c join (select entry, count(*) as hits from f where node like '%55' group by 1) using (entry)",
    "n11_flow_membership": f"{FLOWS_SQL} select node as symbol_id, round(sum(criticality), 6) as flow_criticality, count(*) as flow_count from f join c using (entry) group by 1",
}
