"""Tables, and the property graph that stands on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.lineage import stored
from skein.functions.text import language

SCOPE = ("tenant_id", "workspace_id", "project_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scoped(df: DataFrame, **scope: str) -> DataFrame:
    """The rows of one scope: every column of SCOPE must be named, none blank."""
    if set(scope) != set(SCOPE) or any(not str(v or "").strip() for v in scope.values()):
        raise ValueError(f"a scope names {', '.join(SCOPE)}")
    for k, v in scope.items():
        df = df.filter(F.col(k) == v)
    return df


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol_id, kind, name, qualified_name, file_path, language: suppliers as classes, parts as functions, customers as methods."""
    s, p, c, n = (table(spark, sf_dir, t) for t in ("supplier", "part", "customer", "nation"))
    text = lambda x: F.col(x).cast("string")
    row = lambda id_, kind, name, qualified, path: [x.alias(a) for a, x in zip(("symbol_id", "kind", "name", "qualified_name", "file_path"), (id_, F.lit(kind), name, qualified, path))]
    small = F.broadcast(n)  # 25 rows
    classes = s.join(small, s.s_nationkey == n.n_nationkey).select(
        *row(F.concat(F.lit("sym:fx:s"), text("s_suppkey")), "class", F.col("s_name"), F.concat(F.lit("supplier."), "n_name", F.lit("."), "s_name"), F.concat(F.lit("supplier/"), "n_name", F.lit(".py")))
    )
    tests = F.when(F.col("p_size") % 10 == 0, F.lit("tests/")).otherwise(F.lit("part/"))
    functions = p.select(
        *row(F.concat(F.lit("sym:fx:p"), text("p_partkey")), "function", F.col("p_name"), F.concat(F.lit("part."), "p_brand", F.lit("."), "p_type", F.lit(".p"), text("p_partkey")), F.concat(tests, "p_brand", F.lit("/"), "p_type", F.lit(".go")))
    )
    methods = c.join(small, c.c_nationkey == n.n_nationkey).select(
        *row(F.concat(F.lit("sym:fx:c"), text("c_custkey")), "method", F.col("c_name"), F.concat(F.lit("customer."), "c_mktsegment", F.lit("."), "c_name"), F.concat(F.lit("customer/"), "n_name", F.lit("/"), "c_mktsegment", F.lit(".ts")))
    )
    return classes.unionByName(functions).unionByName(methods).withColumn("language", language(F.col("file_path")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, target_id, rel_type, confidence: suppliers call the parts they ship, parts call or import the customers that order them.

    The graph stands on all line items. It is written once for an application, like a graph that
    has been ingested, and every query reads what was written.
    """
    return stored(spark, "edges", [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders")], lambda: _edges(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    id_of = lambda kind, c: F.concat(F.lit(f"sym:fx:{kind}"), F.col(c).cast("string"))
    ships = items.groupBy(id_of("s", "l_suppkey").alias("source_id"), id_of("p", "l_partkey").alias("target_id"), F.lit("CALLS").alias("rel_type")).agg(F.sum("l_quantity").alias("q"))
    by_order = items.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rel = F.when(F.col("o_orderstatus") == "F", F.lit("HTTP_CALLS")).otherwise(F.lit("IMPORTS"))
    sold = by_order.groupBy(id_of("p", "l_partkey").alias("source_id"), id_of("c", "o_custkey").alias("target_id"), rel.alias("rel_type")).agg(F.sum("l_quantity").alias("q"))
    confidence = F.when(F.col("q") >= 40, "exact").when(F.col("q") >= 25, "probable").when(F.col("q") >= 10, "ambiguous").otherwise("unresolved")
    return ships.unionByName(sold).select("source_id", "target_id", "rel_type", confidence.alias("confidence"))


#: The same two tables in DuckDB's SQL, to begin a WITH clause.
GRAPH_SQL = """
fx_symbols as (
  select *, case regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1) when 'py' then 'python' when 'go' then 'go' when 'ts' then 'typescript' else 'unknown' end as language from (
  select 'sym:fx:s' || s_suppkey as symbol_id, 'class' as kind, s_name as name, 'supplier.' || n_name || '.' || s_name as qualified_name, 'supplier/' || n_name || '.py' as file_path from supplier join nation on s_nationkey = n_nationkey
  union all select 'sym:fx:p' || p_partkey, 'function', p_name, 'part.' || p_brand || '.' || p_type || '.p' || p_partkey, case when p_size % 10 = 0 then 'tests/' else 'part/' end || p_brand || '/' || p_type || '.go' from part
  union all select 'sym:fx:c' || c_custkey, 'method', c_name, 'customer.' || c_mktsegment || '.' || c_name, 'customer/' || n_name || '/' || c_mktsegment || '.ts' from customer join nation on c_nationkey = n_nationkey)),
fx_edges as (
  select source_id, target_id, rel_type, case when q >= 40 then 'exact' when q >= 25 then 'probable' when q >= 10 then 'ambiguous' else 'unresolved' end as confidence from (
  select 'sym:fx:s' || l_suppkey as source_id, 'sym:fx:p' || l_partkey as target_id, 'CALLS' as rel_type, sum(l_quantity) as q from lineitem group by all
  union all select 'sym:fx:p' || l_partkey, 'sym:fx:c' || o_custkey, case when o_orderstatus = 'F' then 'HTTP_CALLS' else 'IMPORTS' end, sum(l_quantity) from lineitem join orders on l_orderkey = o_orderkey group by all)),
fx_ranked as (select *, case confidence when 'exact' then 4 when 'probable' then 3 when 'ambiguous' then 2 when 'external' then 1 else 0 end as rank from fx_edges)
"""
