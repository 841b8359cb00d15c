"""Records, profiles and permissions: metadata checks, activation history, the admin matrix, import boundaries, schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.tables import table

# What metadata records must have, and how fresh a file can be.
FILE_REQUIRED = ("file_id", "project_id", "repository_id", "path", "language", "content_hash", "ast_hash", "freshness_status", "confidence_score")
SYMBOL_REQUIRED = ("symbol_id", "file_id", "qualified_name", "symbol_type", "confidence_score", "metadata_version")
FRESHNESS = ("CURRENT", "STALE", "PARTIAL", "FAILED", "UNKNOWN")
DEFAULT_PROFILE = "default-memory-profile"


def record_errors(record: Column, kind: str) -> Column:
    """array<string> of what is wrong with a record (map<string,string>) of kind file or symbol: required fields missing (or null) or blank, a score that is no number from 0 to 1, an unknown freshness."""
    label, required = (("file_metadata", FILE_REQUIRED) if kind == "file" else ("symbol_metadata", SYMBOL_REQUIRED))
    value = lambda f: F.try_element_at(record, F.lit(f))
    checks = [F.when(value(f).isNull(), F.lit(f"{label} missing {f}")).when(F.trim(value(f)) == "", F.lit(f"{label}.{f} must be non-empty")) for f in required]
    if kind == "file":
        fresh = value("freshness_status")
        checks.append(F.when((F.coalesce(fresh, F.lit("")) != "") & ~fresh.isin(*FRESHNESS), F.concat(F.lit("invalid freshness_status: "), fresh)))
    score = value("confidence_score")
    number = score.try_cast("double")
    checks.append(F.when(score.isNotNull() & number.isNull(), "confidence_score must be a number").when((number < 0) | (number > 1), "confidence_score must be between 0 and 1"))
    return F.array_compact(F.array(*checks))


def merged_metadata(rows: DataFrame, kind: str, base_col: str = "metadata", record_col: str = "record") -> DataFrame:
    """rows with base_col (map<string,string>) taking in the record's score (and a file's freshness), and errors: what is wrong with the record, kept beside it; a good record clears them."""
    taken = ["confidence_score"] + (["freshness_status"] if kind == "file" else [])
    base = F.map_filter(F.coalesce(base_col, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*taken))
    new = F.map_from_arrays(F.array(*[F.lit(t) for t in taken]), F.array(*[F.try_element_at(F.col(record_col), F.lit(t)) for t in taken]))
    return rows.withColumns({base_col: F.map_concat(base, new), "errors": record_errors(F.col(record_col), kind)})


def active_profiles(actions: DataFrame, by: str = "project") -> DataFrame:
    """by, active, depth of actions (by, seq, action, profile, steps): activations push the profile before on a stack, rollbacks take steps of them back.

    What is active already changes nothing; nor does a rollback of no steps or of more than there
    are. The stack of one project is small: administrators act by hand.
    """
    history = actions.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("seq", "action", "profile", F.coalesce("steps", F.lit(1)).cast("int").alias("steps")))).alias("h"))
    start = F.struct(F.lit(DEFAULT_PROFILE).alias("active"), F.array().cast("array<string>").alias("stack"))
    back = lambda s, x: F.struct(F.element_at(s["stack"], -x["steps"]).alias("active"), F.slice(s["stack"], 1, F.size(s["stack"]) - x["steps"]).alias("stack"))

    def step(s: Column, x: Column) -> Column:
        pushed = F.struct(x["profile"].alias("active"), F.concat(s["stack"], F.array(s["active"])).alias("stack"))
        return F.when((x["action"] == "activate") & (x["profile"] != s["active"]), pushed).when((x["action"] == "rollback") & (x["steps"] >= 1) & (x["steps"] <= F.size(s["stack"])), back(s, x)).otherwise(s)

    done = history.select(by, F.aggregate("h", start, step).alias("s"))
    return done.select(by, "s.active", F.size("s.stack").alias("depth"))


def admin_allowed(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """request_id, allowed of requests (request_id, action, roles, permissions) by a matrix (action, roles_any, permissions_any): admins may all; null for an action that the matrix lacks."""
    rows = requests.join(matrix.groupBy("action").agg(F.first("roles_any").alias("roles_any"), F.first("permissions_any").alias("permissions_any"), F.lit(True).alias("known")), "action", "left")
    may = F.arrays_overlap("roles", "roles_any") | F.arrays_overlap("permissions", "permissions_any")
    return rows.select("request_id", F.when(F.array_contains("roles", "admin"), F.lit(True)).when(F.col("known"), F.coalesce(may, F.lit(False))).alias("allowed"))


def boundary_violations(files: DataFrame, banned: DataFrame) -> DataFrame:
    """service, file_path, needle of files (service, file_path, source) with text in them that their service must not import (banned: service, needle)."""
    return files.join(banned.distinct(), "service").filter(F.contains(F.coalesce("source", F.lit("")), F.col("needle"))).select("service", "file_path", "needle")


def scope_counts(tables: dict[str, DataFrame], scope: Column) -> DataFrame:
    """table_name, rows: how many rows of a scope each table has; tables without any too."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.filter(scope).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def schema_fingerprint(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, columns (sorted names, joined by commas), fingerprint (of names and types) of each table."""
    rows = [(n, ",".join(sorted(df.columns)), ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields))) for n, df in sorted(tables.items())]
    return spark.createDataFrame(rows, "table_name string, columns string, kinds string").select("table_name", "columns", F.sha2("kinds", 256).alias("fingerprint"))


def missing_tables(found: DataFrame, required: DataFrame) -> DataFrame:
    """table_name, problem of what a restore needs (required: table_name, fingerprint) and found lacks or has otherwise."""
    rows = required.select("table_name", F.col("fingerprint").alias("want")).join(found.select("table_name", "fingerprint"), "table_name", "left")
    problem = F.when(F.col("fingerprint").isNull(), "missing").when(F.col("fingerprint") != F.col("want"), "differs")
    return rows.select("table_name", problem.alias("problem")).filter("problem is not null")


_TABLES = ("part", "supplier", "customer", "orders", "events")


def x12_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope_counts({"part": table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k"), "supplier": table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "k"), "orders": table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")}, F.col("k") % 3 == 1)


def x13_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    word = lambda k: n.cast("string") if k is None else F.lit(k)
    entry = lambda f, v: F.struct(F.lit(f).alias("key"), v.alias("value"))
    score = F.when(n % 7 == 0, "high").when(n % 7 == 1, "1.5").otherwise("0.5")
    fields = [entry(f, word(None)) for f in FILE_REQUIRED if f not in ("path", "freshness_status", "confidence_score", "language")]
    fields += [entry("path", F.when(n % 5 == 0, " ").otherwise("p")), entry("freshness_status", F.when(n % 3 == 0, "OLD").otherwise("CURRENT")), entry("confidence_score", score)]
    rows = table(spark, sf_dir, "part").select(n.alias("id"), F.map_from_entries(F.array(*fields)).alias("record"), F.when(n % 2 == 0, F.create_map(F.lit("confidence_score"), F.lit("0"), F.lit("kept"), F.lit("x"))).alias("metadata"))
    made = merged_metadata(rows, "file")
    return made.select("id", F.array_join("errors", "; ").alias("errors"), F.try_element_at("metadata", F.lit("confidence_score")).alias("score"), F.try_element_at("metadata", F.lit("kept")).alias("kept"))


def x22_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return active_profiles(e.select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "rollback").otherwise("activate").alias("action"), F.col("event_type").alias("profile"), (F.col("event_id") % 3).alias("steps")))


def x24_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("request_id"), F.concat(F.lit("a"), (k % 4).cast("string")).alias("action"), F.when(k % 11 == 0, F.array(F.lit("admin"))).when(k % 2 == 0, F.array(F.lit("owner"))).otherwise(F.array().cast("array<string>")).alias("roles"), F.array(F.concat(F.lit("p"), (k % 5).cast("string"))).alias("permissions")
    )
    matrix = spark.createDataFrame([("a0", ["owner"], ["p1"]), ("a1", [], ["p2", "p3"]), ("a2", ["viewer"], [])], "action string, roles_any array<string>, permissions_any array<string>")
    return admin_allowed(rows, matrix)


def x24_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), (n % 3).cast("string")).alias("service"), n.cast("string").alias("file_path"), F.concat(F.lit("import store_"), F.substring("p_brand", -1, 1)).alias("source"))
    return boundary_violations(files, spark.createDataFrame([("s0", "store_1"), ("s0", "store_3"), ("s1", "store_1")], "service string, needle string"))


QUERIES = {
    "x12_scope_counts": x12_counts,
    "x12_schemas": lambda spark, d: schema_fingerprint(spark, {t: table(spark, d, t) for t in _TABLES}).select("table_name", "columns"),
    "x13_metadata": x13_metadata,
    "x22_profiles": x22_profiles,
    "x24_admin": x24_admin,
    "x24_boundaries": x24_boundaries,
}
ORACLE_SQL = {
    "x12_scope_counts": "select 'part' as table_name, count(*) as rows from part where p_partkey % 3 = 1 union all select 'supplier', count(*) from supplier where s_suppkey % 3 = 1 union all select 'orders', count(*) from orders where o_orderkey % 3 = 1",
    "x12_schemas": f"select table_name, string_agg(column_name, ',' order by column_name) as columns from (select distinct table_name, column_name from information_schema.columns where table_name in {_TABLES}) group by 1",
    "x13_metadata": """with p as (select p_partkey as n from part) select n as id, array_to_string(list_filter([case when n % 5 = 0 then 'file_metadata.path must be non-empty' end, 'file_metadata missing language', case when n % 3 = 0 then 'invalid freshness_status: OLD' end,
 case n % 7 when 0 then 'confidence_score must be a number' when 1 then 'confidence_score must be between 0 and 1' end], lambda x: x is not null), '; ') as errors, case n % 7 when 0 then 'high' when 1 then '1.5' else '0.5' end as score, case when n % 2 = 0 then 'x' end as kept from p""",
    "x22_profiles": f"""with recursive e as (select user_id as u, event_id % 3 as steps, event_type as t, row_number() over (partition by user_id order by event_id) as n from events),
f as (select u, 0::bigint as n, '{DEFAULT_PROFILE}' as active, []::varchar[] as stack from (select distinct u from e) union all
 select f.u, e.n, case when t <> 'error' and t <> active then t when t = 'error' and steps between 1 and len(stack) then stack[len(stack) - steps + 1] else active end,
  case when t <> 'error' and t <> active then list_append(stack, active) when t = 'error' and steps between 1 and len(stack) then stack[1:len(stack) - steps] else stack end from f join e on e.u = f.u and e.n = f.n + 1)
select u as project, active, len(stack)::int as depth from f where (u, n) in (select u, max(n) from e group by u)""",
    "x24_admin": "with r as (select o_orderkey as k from orders) select k as request_id, case when k % 11 = 0 then true when k % 4 = 0 then k % 2 = 0 or k % 5 = 1 when k % 4 = 1 then k % 5 in (2, 3) when k % 4 = 2 then false end as allowed from r",
    "x24_boundaries": "with p as (select 's' || (p_partkey % 3) as service, p_partkey::varchar as file_path, 'store_' || right(p_brand, 1) as needle from part) select * from p where (service, needle) in (('s0', 'store_1'), ('s0', 'store_3'), ('s1', 'store_1'))",
}
