"""Source-level signals over symbols and files: entry points, risks, quoted names, loaders, packages, flags, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import confidence, text
from skein.operators.traverse import live
from skein.sources.tables import GRAPH_SQL, edges, symbols, table

# Names and patterns.
UI_ROOTS = ("page", "layout", "route", "default", "template", "loading", "error", "not-found", "forbidden", "unauthorized", "global-error")
DECORATOR = r"(?i)@(?:app|router|blueprint)\.(?:get|post|put|delete|patch|route|websocket)\b|@click\.(?:command|group)\b|@(?:task|shared_task)\b|@(?:Get|Post|Put|Delete|Patch|Request)Mapping\b"
LOADER = r"(?i)importlib\.(?:import_module|reload)|__import__\s*\(|pkgutil\.iter_modules|\bimport\s*\(|require\.context\(|import\.meta\.glob\(|React\.lazy\("
QUOTED = r"['\"`]([A-Za-z_][\w]{1,})['\"`]"
BLOCKERS = (("reflection", r"\b(?:getattr|setattr)\s*\("), ("dynamic_import", r"importlib|__import__"), ("plugin", r"(?i)entry_points|register_plugin"), ("framework_hook", r"@(?:app|router|task|pytest)\b"))
FORBIDDEN_PROVENANCE = ("lsp", "ide", "editor")
STALE_FLAG_DAYS, STALE_FLAG_SCORE = 90, 0.60


def is_ui_root(path: Column) -> Column:
    name = F.lower(text.base_name(path))
    return name.rlike(rf"^({'|'.join(UI_ROOTS)})\.(tsx|ts|jsx|js)$")


def is_entry_point(name: Column, path: Column, signature: Column, body: Column, is_route: Column) -> Column:
    """Route handlers, UI roots, names that frameworks call, and decorated functions."""
    blob = F.concat_ws("\n", signature, F.substring(body, 1, 400))
    return is_route | is_ui_root(path) | text.is_entry_name(name) | blob.rlike(DECORATOR)


def path_risks(path: Column) -> Column:
    """array of tags of a path: loaded at run time, or work in progress."""
    p = text.path(path)
    return F.array_compact(F.array(F.when(p.rlike(r"(?i)(^|/)(plugins?|extensions?|migrations?|commands|hooks)(/|$)"), "runtime_load"), F.when(p.rlike(r"(?i)(^|/)(wip|draft|experimental|sandbox)(/|$)"), "wip")))


def blockers(signature: Column, body: Column) -> Column:
    """Tags, in order, of what in a symbol's signature or the first 800 characters of its body speaks against deleting it."""
    blob = F.concat_ws("\n", signature, F.substring(body, 1, 800))
    return F.array_compact(F.array(*[F.when(blob.rlike(p), F.lit(t)) for t, p in BLOCKERS]))


def quoted_names(symbol_rows: DataFrame) -> DataFrame:
    """name, file_path of quoted identifiers in each file's first symbol (by qualified name, then id)."""
    first = symbol_rows.groupBy("file_path").agg(F.min_by("body", F.struct("qualified_name", "symbol_id")).alias("body"))
    return first.select("file_path", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(QUOTED), F.lit(1)))).alias("name")).select("name", "file_path")


def quoted_elsewhere(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """symbol_id, files: in how many other files a candidate's name stands in quotes, by a name's count less the candidate's own file."""
    pairs = names.select("name", "file_path").distinct()
    counted = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("all"))
    own = pairs.withColumn("own", F.lit(1))
    rows = candidates.select("symbol_id", "name", "file_path").join(counted, "name").join(own, ["name", "file_path"], "left")
    return rows.groupBy("symbol_id").agg(F.max(F.col("all") - F.coalesce("own", F.lit(0))).alias("files")).filter("files > 0")


def loader_directories(symbol_rows: DataFrame) -> DataFrame:
    """directory of files with a dynamic loader in them."""
    hit = F.concat_ws("\n", "signature", F.substring("body", 1, 800)).rlike(LOADER)
    return symbol_rows.filter(hit).select(F.regexp_extract(text.path(F.col("file_path")), r"^(.*)/[^/]*$", 1).alias("directory")).distinct()


def zombie_packages(symbol_rows: DataFrame, edge_rows: DataFrame, dead: DataFrame, pool: DataFrame) -> DataFrame:
    """package, files, members of directories of two files or more whose pool members are all dead and that no other package imports."""
    package = F.regexp_extract(text.path(F.col("file_path")), r"^(.*)/[^/]*$", 1)
    rows = symbol_rows.select("symbol_id", "file_path", package.alias("package"))
    mine = rows.join(pool.select("symbol_id"), "symbol_id", "left_semi").join(dead.select("symbol_id", F.lit(1).alias("dead")), "symbol_id", "left")
    s = mine.groupBy("package").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("members"), F.count("dead").alias("dead"))
    end = lambda e: rows.select(F.col("symbol_id").alias(f"{e}_id"), F.col("package").alias(f"{e}_package"))
    used = edge_rows.filter("rel_type = 'IMPORTS'").join(end("source"), "source_id").join(end("target"), "target_id").filter("source_package <> target_package").select(F.col("target_package").alias("package")).distinct()
    return s.filter("files >= 2 and dead = members").join(used, "package", "left_anti").select("package", "files", "members")


def runtime_dead(alive: DataFrame, hits: DataFrame) -> DataFrame:
    """symbol_id of live symbols that coverage (symbol_id, hits) never saw run."""
    s = hits.groupBy("symbol_id").agg(F.sum("hits").alias("hits"))
    return alive.join(s, "symbol_id").filter("hits = 0").select("symbol_id")


def stale_flags(flags: DataFrame, least_days: int = STALE_FLAG_DAYS) -> DataFrame:
    """flag, score of flags (flag, value, day) that have had one value for least_days or more."""
    s = flags.groupBy("flag").agg(F.countDistinct("value").alias("values"), F.date_diff(F.max("day"), F.min("day")).alias("days"))
    return s.filter((F.col("values") == 1) & (F.col("days") >= least_days)).select("flag", F.lit(STALE_FLAG_SCORE).alias("score"))


def present(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """candidates (symbol_id, file_path, symbol) with blocker: missing file, or a name that its text lacks; null if it is there."""
    rows = candidates.join(files.select("file_path", "source"), "file_path", "left")
    why = F.when(F.col("source").isNull(), "file_missing").when(~F.contains("source", F.col("symbol")), "symbol_not_in_file")
    return rows.withColumn("blocker", why).drop("source")


def triage(candidates: DataFrame) -> DataFrame:
    """candidates (score, blockers, test_only) with advice, the first that fits; never safer than the score."""
    has = lambda b: F.array_contains("blockers", b)
    advice = F.when(has("index_incomplete"), "resync").when(has("dynamic_import"), "inspect_loader").when(has("reflection"), "inspect_reflection").when(F.col("test_only"), "remove_with_tests").when(F.size("blockers") > 0, "human_review").when(F.col("score") >= 0.8, "delete").otherwise("watch")
    return candidates.withColumn("advice", advice)


def missing_contains(symbol_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """file_path, children of files with symbols and without an edge that says so."""
    held = edge_rows.filter("rel_type = 'CONTAINS'").select(F.col("target_id").alias("symbol_id")).distinct()
    return symbol_rows.filter("kind <> 'file'").join(held, "symbol_id", "left_anti").groupBy("file_path").agg(F.count(F.lit(1)).alias("children"))


def durable(edge_rows: DataFrame) -> DataFrame:
    """edges (with tags, an array) that no editor wrote."""
    return edge_rows.filter(~F.arrays_overlap("tags", F.array(*[F.lit(t) for t in FORBIDDEN_PROVENANCE])))


def external_kind(calls: DataFrame, builtins: DataFrame, stdlib: DataFrame) -> DataFrame:
    """call_id, external (builtin, stdlib, aliased_stdlib or null) of calls (call_id, ref, full_name: what the first part is an alias of)."""
    root = lambda c: F.substring_index(c, ".", 1)
    b, s = builtins.select("name").distinct(), stdlib.select("root").distinct()
    rows = calls.join(b.withColumnRenamed("name", "ref").withColumn("b", F.lit(1)), "ref", "left")
    rows = rows.withColumn("root", root(F.col("ref"))).join(s.withColumn("s", F.lit(1)), "root", "left").drop("root").withColumn("root", root(F.col("full_name"))).join(s.withColumn("a", F.lit(1)), "root", "left")
    return rows.select("call_id", F.when(F.col("b") == 1, "builtin").when(F.col("s") == 1, "stdlib").when(F.col("a") == 1, "aliased_stdlib").alias("external"))


def file_statistics(symbol_rows: DataFrame, documented: DataFrame, vectors: DataFrame) -> DataFrame:
    """file_path, symbols, documented, indexed, missing, models of each file: documented has symbol_id, vectors symbol_id and model."""
    v = vectors.groupBy("symbol_id").agg(F.array_sort(F.collect_set("model")).alias("models"))
    rows = symbol_rows.join(documented.select("symbol_id", F.lit(1).alias("d")).distinct(), "symbol_id", "left").join(v, "symbol_id", "left")
    s = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"), F.count("d").alias("documented"), F.count("models").alias("indexed"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("models")))), ",").alias("models"))
    return s.select("file_path", "symbols", "documented", "indexed", (F.col("symbols") - F.col("indexed")).alias("missing"), "models")


def embedding_plan(symbol_rows: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """symbol_id, reason (missing, model_mismatch or orphan) of what an embedding refresh has to do."""
    v = vectors.groupBy("symbol_id").agg(F.max((F.col("model") == model).cast("int")).alias("right"))
    both = symbol_rows.select("symbol_id", F.lit(1).alias("is_symbol")).join(v, "symbol_id", "full")
    reason = F.when(F.col("is_symbol").isNull(), "orphan").when(F.col("right").isNull(), "missing").when(F.col("right") == 0, "model_mismatch")
    return both.select("symbol_id", reason.alias("reason")).filter("reason is not null")


def edited(paths: DataFrame) -> DataFrame:
    """paths (path, on_disk, known_hash, hash, pending, documented) with reason and bucket: missing_on_disk, content_changed or pending; edited ones aren't done."""
    reason = F.when(~F.col("on_disk"), "missing_on_disk").when(~F.col("known_hash").eqNullSafe(F.col("hash")), "content_changed").when(F.col("pending"), "pending")
    return paths.withColumn("reason", reason).withColumn("bucket", F.when(F.col("reason").isNotNull(), "edited").when(F.col("documented"), "done").otherwise("remaining"))


def days_since(touched: Column, as_of: Column) -> Column:
    """Whole days since a moment in seconds, or in milliseconds if it is over 1e12; 0 at least."""
    seconds = F.when(touched > 1e12, touched / 1000).otherwise(touched)
    return F.greatest(F.lit(0), F.floor((as_of - seconds) / 86_400)).cast("long")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with bodies made of their numbers."""
    s = symbols(spark, sf_dir)
    n = F.substring("symbol_id", 9, 20).cast("long")
    body = F.when(n % 11 == 0, F.concat(F.lit("x = importlib.import_module('m"), n.cast("string"), F.lit("')"))).when(n % 7 == 0, F.concat(F.lit('getattr(o, "a'), (n % 20).cast("string"), F.lit('")'))).otherwise("return 1")
    return s.withColumns({"signature": F.when(n % 13 == 0, "@app.get('/x')").otherwise("def f()"), "body": body, "n": n})


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _bodies(spark, sf_dir).filter("n % 3 > 0")
    return s.select(F.when(F.col("n") % 17 == 0, F.concat("symbol_id", F.lit("x"))).otherwise(F.col("symbol_id")).alias("symbol_id"), F.when(F.col("n") % 2 == 0, "m1").otherwise("m2").alias("model"))


def _pool(s: DataFrame) -> DataFrame:
    return s.filter("kind = 'function'")


def n17_zombies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of parts whose number isn't even count as dead."""
    s = symbols(spark, sf_dir)
    odd = s.filter("kind = 'method' and file_path like '%BUILDING%'").withColumn("file_path", F.concat(F.lit("zombie/"), F.substring("symbol_id", -1, 1), F.lit("/"), F.substring("symbol_id", -2, 1), F.lit(".py")))
    return zombie_packages(odd, edges(spark, sf_dir).filter("rel_type = 'IMPORTS' and target_id like '%3'").unionByName(edges(spark, sf_dir).limit(0)), odd.filter("symbol_id not like '%7'"), odd)


def n18_runtime_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    hits = s.select("symbol_id", (F.substring("symbol_id", -1, 1).cast("int") % 3).alias("hits"))
    return runtime_dead(live(s, edges(spark, sf_dir), s.filter("kind in ('function', 'method')")), hits)


def x03_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ref = F.when(k % 4 == 0, "print").when(k % 4 == 1, F.concat(F.lit("os.p"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("np.f"), k.cast("string"))).otherwise("mine.f")
    calls = table(spark, sf_dir, "part").select(k.alias("call_id"), ref.alias("ref"), F.when(k % 8 == 2, "os.path").when(k % 8 == 6, "numpy").alias("full_name"))
    return external_kind(calls, spark.createDataFrame([("print",), ("len",)], "name string"), spark.createDataFrame([("os",), ("sys",)], "root string"))


QUERIES = {
    "f11_entry_points": lambda spark, d: _bodies(spark, d).filter(is_entry_point(F.col("name"), F.col("file_path"), F.col("signature"), F.col("body"), F.col("n") % 29 == 0)).select("symbol_id"),
    "f12_path_risks": lambda spark, d: symbols(spark, d).select("symbol_id", F.array_join(path_risks(F.concat(F.when(F.col("symbol_id").endswith("1"), "a/plugins/").when(F.col("symbol_id").endswith("2"), "WIP/").otherwise(""), F.col("file_path"))), ",").alias("risks")),
    "f13_blockers": lambda spark, d: _bodies(spark, d).select("symbol_id", F.array_join(blockers(F.col("signature"), F.col("body")), ",").alias("blockers")),
    "n12_quoted_names": lambda spark, d: quoted_names(_bodies(spark, d)),
    "n13_loader_directories": lambda spark, d: loader_directories(_bodies(spark, d)),
    "n17_zombie_packages": n17_zombies,
    "n18_runtime_dead": n18_runtime_dead,
    "n19_stale_flags": lambda spark, d: stale_flags(table(spark, d, "events").select(F.col("user_id").alias("flag"), F.when(F.col("user_id") % 3 == 0, "on").otherwise(F.col("event_type")).alias("value"), F.col("ts").cast("date").alias("day")), 10),
    "n21_present": lambda spark, d: present(table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_partkey").alias("file_path"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("absent").alias("symbol")), table(spark, d, "part").filter("p_partkey % 4 > 0").select(F.col("p_partkey").alias("file_path"), F.concat_ws(" ", "p_name", "p_brand").alias("source"))).select("symbol_id", "blocker"),
    "x04_triage": lambda spark, d: triage(_bodies(spark, d).select("symbol_id", blockers(F.col("signature"), F.col("body")).alias("blockers"), (F.col("n") % 5 == 0).alias("test_only"), (F.col("n") % 10 / 10.0).alias("score"))).select("symbol_id", "advice"),
    "x05_days": lambda spark, d: table(spark, d, "orders").select("o_orderkey", days_since(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") * 50_000).otherwise(F.col("o_orderkey") * 50_000 + 1_600_000_000_000), F.lit(1_700_000_000)).alias("days")),
    "x16_missing_contains": lambda spark, d: missing_contains(symbols(spark, d), edges(spark, d).withColumn("rel_type", F.when(F.col("confidence") == "exact", "CONTAINS").otherwise("CALLS"))),
    "x17_durable": lambda spark, d: durable(edges(spark, d).withColumn("tags", F.array(F.when(F.col("source_id").endswith("1"), "lsp").otherwise("parser"), F.when(F.col("target_id").endswith("2"), "ide").otherwise("sync")))).select("source_id", "target_id", "rel_type"),
    "x03_external": x03_external,
    "a06_file_statistics": lambda spark, d: file_statistics(symbols(spark, d), _bodies(spark, d).filter("n % 2 = 0").select("symbol_id"), _vectors(spark, d)),
    "a20_embedding_plan": lambda spark, d: embedding_plan(symbols(spark, d), _vectors(spark, d), "m1"),
    "x11_edited": lambda spark, d: edited(table(spark, d, "documents").select(F.col("doc_id").alias("path"), (F.col("doc_id") % 10 > 0).alias("on_disk"), F.when(F.col("doc_id") % 7 > 0, F.md5("text")).alias("known_hash"), F.md5("text").alias("hash"), (F.col("doc_id") % 6 == 0).alias("pending"), (F.col("doc_id") % 2 == 0).alias("documented"))).select("path", "reason", "bucket"),
    "f08_blast_edges": lambda spark, d: edges(spark, d).filter(confidence.is_blast(F.when(F.col("target_id").endswith("1"), F.concat(F.lit("ext:"), "target_id")).otherwise(F.col("target_id")), F.when(F.col("target_id").endswith("2"), True), F.col("confidence"), "probable")).select("source_id", "target_id", "rel_type"),
    "f07_parsed": lambda spark, d: edges(spark, d).select("source_id", "target_id", "rel_type", confidence.parsed(F.when(F.col("target_id").endswith("1"), " ").when(F.col("target_id").endswith("2"), "Exact").otherwise(F.concat(F.lit(" "), "confidence"))).alias("confidence")),
}

_B = f"with {GRAPH_SQL}, b as (select *, substr(symbol_id, 9)::bigint as n from fx_symbols)"
_V = "v as (select case when n % 17 = 0 then symbol_id || 'x' else symbol_id end as symbol_id, case when n % 2 = 0 then 'm1' else 'm2' end as model from b where n % 3 > 0)"
_TEST = "regexp_matches('/' || lower(file_path) || '/', '/(tests|test|spec|specs|__tests__)/')"
_TAGS = "case when n % 11 = 0 then 'dynamic_import' when n % 7 = 0 then 'reflection' end, case when n % 13 = 0 then 'framework_hook' end"
ORACLE_SQL = {
    "f11_entry_points": f"{_B} select symbol_id from b where n % 29 = 0 or n % 13 = 0",
    "f12_path_risks": f"with {GRAPH_SQL} select symbol_id, case right(symbol_id, 1) when '1' then 'runtime_load' when '2' then 'wip' else '' end as risks from fx_symbols",
    "f13_blockers": f"{_B} select symbol_id, array_to_string(list_filter([{_TAGS}], lambda x: x is not null), ',') as blockers from b",
    "n12_quoted_names": f"{_B}, f as (select file_path, arg_min(n, (qualified_name, symbol_id)) as n from b group by 1) select case when n % 11 = 0 then 'm' || n else 'a' || n % 20 end as name, file_path from f where n % 11 = 0 or n % 7 = 0",
    "n13_loader_directories": f"{_B} select distinct regexp_extract(file_path, '^(.*)/[^/]*$', 1) as directory from b where n % 11 = 0",
    "n17_zombie_packages": f"with {GRAPH_SQL}, o as (select symbol_id, 'zombie/' || right(symbol_id, 1) as package, 'zombie/' || right(symbol_id, 1) || '/' || substr(symbol_id, -2, 1) as f from fx_symbols where kind = 'method' and file_path like '%BUILDING%') select package, count(distinct f) as files, count(*) as members from o where package <> 'zombie/7' group by 1 having count(distinct f) >= 2",
    "n18_runtime_dead": f"""with recursive {GRAPH_SQL}, pool as (select symbol_id from fx_symbols where kind in ('function', 'method')),
carried as (select source_id, target_id from fx_edges join fx_symbols on symbol_id = source_id where confidence not in ('ambiguous', 'unresolved') and not {_TEST}),
alive as (select distinct symbol_id from pool join fx_symbols using (symbol_id) join carried on target_id = symbol_id where not {_TEST} and source_id not in (select symbol_id from pool) union select target_id from alive join carried on source_id = symbol_id)
select distinct symbol_id from alive where symbol_id in (select symbol_id from pool) and right(symbol_id, 1)::int % 3 = 0""",
    "n19_stale_flags": "select user_id as flag, 0.6::double as score from events group by 1 having count(distinct case when user_id % 3 = 0 then 'on' else event_type end) = 1 and date_diff('day', min(ts)::date, max(ts)::date) >= 10",
    "n21_present": "select p_partkey as symbol_id, case when p_partkey % 4 = 0 then 'file_missing' when p_size <= 25 then 'symbol_not_in_file' end as blocker from part",
    "x04_triage": f"{_B} select symbol_id, case when n % 11 = 0 then 'inspect_loader' when n % 7 = 0 then 'inspect_reflection' when n % 5 = 0 then 'remove_with_tests' when n % 13 = 0 then 'human_review' when n % 10 >= 8 then 'delete' else 'watch' end as advice from b",
    "x05_days": "select o_orderkey, greatest(0, floor((1700000000 - case when o_orderkey % 2 = 0 then o_orderkey * 50000 else (o_orderkey * 50000 + 1600000000000) / 1000.0::double end) / 86400.0::double))::bigint as days from orders",
    "x16_missing_contains": f"with {GRAPH_SQL} select file_path, count(*) as children from fx_symbols where symbol_id not in (select target_id from fx_edges where confidence = 'exact') group by 1",
    "x17_durable": f"with {GRAPH_SQL} select source_id, target_id, rel_type from fx_edges where source_id not like '%1' and target_id not like '%2'",
    "x03_external": "select p_partkey as call_id, case when p_partkey % 4 = 0 then 'builtin' when p_partkey % 4 = 1 then 'stdlib' when p_partkey % 8 = 2 then 'aliased_stdlib' end as external from part",
    "a06_file_statistics": f"{_B}, {_V} select file_path, count(*) as symbols, count(*) filter (n % 2 = 0) as documented, count(v.symbol_id) as indexed, count(*) - count(v.symbol_id) as missing, coalesce(string_agg(distinct model, ',' order by model), '') as models from b left join v using (symbol_id) group by 1",
    "a20_embedding_plan": f"{_B}, {_V} select coalesce(b.symbol_id, v.symbol_id) as symbol_id, case when b.symbol_id is null then 'orphan' when v.symbol_id is null then 'missing' else 'model_mismatch' end as reason from b full join v on b.symbol_id = v.symbol_id where b.symbol_id is null or v.symbol_id is null or model <> 'm1'",
    "x11_edited": "with e as (select doc_id as path, case when doc_id % 10 = 0 then 'missing_on_disk' when doc_id % 7 = 0 then 'content_changed' when doc_id % 6 = 0 then 'pending' end as reason from documents) select path, reason, case when reason is not null then 'edited' when path % 2 = 0 then 'done' else 'remaining' end as bucket from e",
    "f08_blast_edges": f"with {GRAPH_SQL} select source_id, target_id, rel_type from fx_ranked where rank >= 3 and right(target_id, 1) not in ('1', '2')",
    "f07_parsed": f"with {GRAPH_SQL} select source_id, target_id, rel_type, case right(target_id, 1) when '1' then 'exact' when '2' then 'probable' else confidence end as confidence from fx_edges",
}
