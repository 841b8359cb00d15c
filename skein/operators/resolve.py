"""Resolving names: calls, imports, links, routes, injections, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import confidence, text
from skein.functions.lineage import shuffled
from skein.sources.tables import GRAPH_SQL, edges, symbols, table

BLOOM_SLOTS, BLOOM_HASHES = 2048, 3


def grouped_targets(symbol_rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """key, target (the least id), candidates: how many symbols have the key. Candidates are counted, never paired with their callers."""
    return symbol_rows.select(key.alias(name), "symbol_id").filter(F.col(name).isNotNull()).groupBy(name).agg(F.min("symbol_id").alias("target"), F.countDistinct("symbol_id").alias("candidates"))


def calls(call_rows: DataFrame, symbol_rows: DataFrame, aliases: DataFrame, builtins: DataFrame) -> DataFrame:
    """call_id, rung, target, candidates, confidence of calls (call_id, module, file_path, ref), by the first rung that finds something.

    1 the qualified name; 2 the name in the caller's module; 3 an import's alias; 4 an alias of the
    first part; 5 a builtin: external, with no target; 6 a short name that one symbol has; 7 a short
    name that one symbol of the module has; 8 a short name that several have: ambiguous, target is
    the least of them, candidates says how many. Else unresolved, rung 9. aliases: file_path, alias,
    full_name; builtins: ref. Exact below rung 6, probable at 6 and 7.
    """
    short = lambda c: F.substring_index(c, ".", -1)
    by_name = grouped_targets(symbol_rows, F.col("qualified_name"))
    by_short = grouped_targets(symbol_rows, short(F.col("qualified_name")))
    module_of = F.regexp_extract("qualified_name", r"^(.*)\.[^.]+$", 1)
    by_module = grouped_targets(symbol_rows, F.concat_ws(" ", module_of, short(F.col("qualified_name"))))
    named = shuffled(aliases.select("file_path", F.col("alias"), "full_name").dropDuplicates(["file_path", "alias"]))
    rest = F.regexp_extract("ref", r"^[^.]+(\..*)?$", 1)
    rows = call_rows.join(named.select("file_path", F.col("alias").alias("ref"), F.col("full_name").alias("whole")), ["file_path", "ref"], "left")
    rows = rows.withColumn("head", F.substring_index("ref", ".", 1)).join(named.select("file_path", F.col("alias").alias("head"), F.col("full_name").alias("of_head")), ["file_path", "head"], "left")
    rows = rows.join(builtins.select("ref").distinct().withColumn("builtin", F.lit(True)), "ref", "left")
    way = lambda rung, kind, key: F.struct(F.lit(rung).alias("rung"), F.lit(kind).alias("kind"), key.alias("key"))
    ways = F.array(
        way(1, "q", F.col("ref")), way(2, "q", F.concat_ws(".", "module", "ref")), way(3, "q", F.col("whole")),
        way(4, "q", F.concat(F.col("of_head"), rest)), way(6, "s", short(F.col("ref"))), way(7, "m", F.concat_ws(" ", "module", short(F.col("ref")))),
    )
    index = by_name.withColumn("kind", F.lit("q")).unionByName(by_short.withColumn("kind", F.lit("s"))).unionByName(by_module.withColumn("kind", F.lit("m")))
    tried = rows.select("call_id", F.explode(ways).alias("w")).select("call_id", "w.*").filter("key is not null").join(shuffled(index), ["kind", "key"])
    rung = F.when((F.col("kind") == "s") & (F.col("candidates") > 1), 8).otherwise(F.col("rung"))
    usable = tried.withColumn("rung", rung).filter((F.col("rung").isin(6, 8)) | (F.col("candidates") == 1))
    best = usable.groupBy("call_id").agg(F.min(F.struct("rung", "target", "candidates")).alias("b"))
    out = rows.select("call_id", "builtin").join(shuffled(best), "call_id", "left")
    external = F.coalesce(F.col("builtin"), F.lit(False)) & (F.coalesce(F.col("b.rung"), F.lit(9)) > 5)
    final = F.when(external, 5).otherwise(F.coalesce(F.col("b.rung"), F.lit(9)))
    out = out.select("call_id", final.alias("rung"), F.when(~external, F.col("b.target")).alias("target"), F.when(external, 0).otherwise(F.coalesce(F.col("b.candidates"), F.lit(0))).cast("long").alias("candidates"))
    sure = F.when(F.col("rung") < 5, "exact").when(F.col("rung") == 5, "external").when(F.col("rung") < 8, "probable").when(F.col("rung") == 8, "ambiguous").otherwise("unresolved")
    return out.withColumn("confidence", sure)


def rewritten(refs: DataFrame, prefixes: DataFrame, joined: str | None = None) -> DataFrame:
    """ref, rewritten: the longest of prefixes (prefix, replacement) that a reference is, or continues with / or ., is replaced; equality on exploded beginnings.

    What follows the prefix stays as it is, or, with joined, comes after that instead of its own slashes and dots.
    """
    starts = F.regexp_extract_all("ref", F.lit(r"[/.]?[^/.]+"), F.lit(0))
    begun = F.transform(F.sequence(F.lit(1), F.size(starts)), lambda i: F.array_join(F.slice(starts, i * 0 + 1, i), ""))
    own = refs.select("ref").distinct().filter("ref is not null and ref <> ''")
    hits = shuffled(own.select("ref", F.explode(begun).alias("prefix"))).join(prefixes.dropDuplicates(["prefix"]), "prefix").filter(F.col("ref").startswith(F.col("prefix")))
    best = hits.groupBy("ref").agg(F.max_by(F.struct("prefix", "replacement"), F.length("prefix")).alias("b"))
    rest = F.expr("substring(ref, length(b.prefix) + 1)")
    if joined is not None:
        rest = F.regexp_replace(rest, r"^[/.]+", "")
        rest = F.when(rest == "", "").otherwise(F.concat(F.lit(joined), rest))
    return refs.join(shuffled(best), "ref", "left").select("ref", F.when(F.col("b").isNull(), F.col("ref")).otherwise(F.concat("b.replacement", rest)).alias("rewritten"))


def stems(path: Column) -> Column:
    """A file's stem, and what is left of it without a test's prefix or suffix."""
    stem = F.regexp_replace(text.base_name(path), r"\.[^.]*$", "")
    kinds = [stem, F.regexp_replace(stem, r"(?i)^tests?_", ""), F.regexp_replace(stem, r"(?i)(_tests?|\.test|\.spec|_spec)$", ""), F.regexp_replace(stem, r"Tests?$", "")]
    return F.filter(F.array_distinct(F.array(*kinds)), lambda s: s != "")


def test_links(symbol_rows: DataFrame) -> DataFrame:
    """production_file, test_file, reason: files whose stems meet, by equality on exploded stems; both ends are files, so that symbols aren't paired."""
    files = symbol_rows.select("file_path").distinct().withColumn("is_test", text.is_test_path(F.col("file_path")))
    keyed = files.select("file_path", "is_test", F.explode(stems(F.col("file_path"))).alias("stem"))
    made = keyed.filter(~F.col("is_test")).select("stem", F.col("file_path").alias("production_file")).join(keyed.filter("is_test").select("stem", F.col("file_path").alias("test_file")), "stem")
    return made.select("production_file", "test_file").distinct().withColumn("reason", F.lit("file_stem"))


def name_links(symbol_rows: DataFrame) -> DataFrame:
    """symbol_id, test_id: a test's function test_x or x_test stands for the symbol x."""
    rows = symbol_rows.withColumn("is_test", text.is_test_path(F.col("file_path")))
    tests = rows.filter("is_test").select(F.col("symbol_id").alias("test_id"), F.explode(F.array_distinct(F.array(F.regexp_replace("name", r"^test_", ""), F.regexp_replace("name", r"_test$", "")))).alias("name"), F.col("name").alias("test_name")).filter("name <> test_name and name <> ''")
    return rows.filter(~F.col("is_test")).select("symbol_id", "name").join(tests, "name").select("symbol_id", "test_id")


def routed(http_calls: DataFrame, routes: DataFrame) -> DataFrame:
    """call_id, route_id, routes, confidence of calls (call_id, url) against routes (route_id, path), by their normal paths: one match is exact, several ambiguous (route_id is the least), none unresolved."""
    index = routes.select(text.url_path(F.col("path")).alias("key"), "route_id").groupBy("key").agg(F.min("route_id").alias("route_id"), F.countDistinct("route_id").alias("routes"))
    rows = http_calls.withColumn("key", text.url_path(F.col("url"))).join(index, "key", "left")
    n = F.coalesce("routes", F.lit(0)).cast("long")
    return rows.select("call_id", "route_id", n.alias("routes"), F.when(n == 1, "exact").when(n > 1, "ambiguous").otherwise("unresolved").alias("confidence"))


def injected(injections: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """injection_id, consumer, provider, confidence of injections (injection_id, consumer_name, provider_name): a provider that is alone in its name is probable, several are ambiguous, none unresolved; without a consumer an injection is dropped."""
    index = grouped_targets(symbol_rows, F.substring_index("qualified_name", ".", -1))
    rows = injections.join(index.select(F.col("key").alias("consumer_name"), F.col("target").alias("consumer")), "consumer_name")
    rows = rows.join(index.select(F.col("key").alias("provider_name"), F.col("target").alias("provider"), "candidates"), "provider_name", "left")
    return rows.select("injection_id", "consumer", "provider", F.when(F.col("candidates") == 1, "probable").when(F.col("candidates") > 1, "ambiguous").otherwise("unresolved").alias("confidence"))


def bloom_slots(key: Column) -> Column:
    """The slots of a key: slices of its SHA-256."""
    return F.array(*[(F.conv(F.substring(F.sha2(key, 256), 1 + 8 * k, 8), 16, 10).cast("long") % BLOOM_SLOTS).cast("int") for k in range(BLOOM_HASHES)])


def bloom_member(probes: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """probes with maybe (all slots are taken) and member (verified by a join). The filter is one row of at most 2048 slots."""
    taken = members.select(F.explode(bloom_slots(F.col(key))).alias("slot")).distinct()
    slots = F.array(*[F.lit(r["slot"]) for r in taken.collect()]) if taken.limit(1).count() else F.array().cast("array<int>")
    maybe = F.size(F.array_except(bloom_slots(F.col(key)), slots)) == 0
    sure = members.select(key).distinct().withColumn("__is", F.lit(True))
    return probes.withColumn("maybe", maybe).join(sure, key, "left").withColumn("member", F.coalesce("__is", F.lit(False)) & F.col("maybe")).drop("__is")


def unknown_refs(refs: DataFrame, symbol_rows: DataFrame, known: DataFrame) -> DataFrame:
    """ref of references that neither as a whole nor by their last part name a symbol or something known (column ref); dunder names don't count."""
    names = symbol_rows.select(F.col("qualified_name").alias("ref")).union(symbol_rows.select("name")).union(symbol_rows.select(F.substring_index("qualified_name", ".", -1))).union(known.select("ref")).distinct()
    own = refs.select("ref", F.substring_index("ref", ".", -1).alias("last")).distinct().filter(~F.col("last").rlike("^__.*__$"))
    return own.join(names, "ref", "left_anti").join(names.withColumnRenamed("ref", "last"), "last", "left_anti").select("ref")


def related(records: DataFrame, links: DataFrame, correlation: str, entity: str) -> DataFrame:
    """record_id of records (record_id, correlation_id) of a correlation, or that link to an entity (record_id, entity_ref)."""
    by_link = links.filter(F.col("entity_ref") == entity).select("record_id")
    return records.filter(F.col("correlation_id") == correlation).select("record_id").union(by_link).distinct()


def live_import_paths(edge_rows: DataFrame, symbol_rows: DataFrame, live: DataFrame) -> DataFrame:
    """file_path of files that something live imports from outside the file."""
    path = lambda end: symbol_rows.select(F.col("symbol_id").alias(f"{end}_id"), F.col("file_path").alias(f"{end}_path"))
    rows = edge_rows.filter("rel_type = 'IMPORTS'").join(live.select(F.col("symbol_id").alias("source_id")), "source_id", "left_semi").join(path("source"), "source_id").join(path("target"), "target_id")
    return rows.filter("source_path <> target_path").select(F.col("target_path").alias("file_path")).distinct()


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Calls that lineitems make of parts, each in one of several spellings."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.replace("p_type", F.lit(" "), F.lit("_")).alias("t"))
    module = F.concat_ws(".", F.replace("p_brand", F.lit("#"), F.lit("")), "t")
    own = p.select(F.col("p_partkey").cast("string").alias("symbol_id"), F.concat_ws(".", module, F.concat(F.lit("f"), (F.col("p_partkey") % 900).cast("string"))).alias("qualified_name"), F.concat(F.lit("f"), (F.col("p_partkey") % 900).cast("string")).alias("name"), module.alias("module"), F.col("p_partkey").alias("k"))
    k = F.col("k")
    ref = F.when(k % 6 == 0, F.col("qualified_name")).when(k % 6 == 1, F.col("name")).when(k % 6 == 2, F.lit("print")).when(k % 6 == 3, F.concat(F.lit("a."), "name")).when(k % 6 == 4, F.lit("b")).otherwise(F.concat(F.lit("zz"), k.cast("string")))
    call_rows = own.select(F.concat(F.lit("c"), k.cast("string")).alias("call_id"), F.when(k % 2 == 0, F.col("module")).otherwise("other").alias("module"), F.concat(F.lit("file"), k.cast("string")).alias("file_path"), ref.alias("ref"))
    aliases = own.filter("k % 3 = 0").select(F.concat(F.lit("file"), k.cast("string")).alias("file_path"), F.lit("a").alias("alias"), F.col("module").alias("full_name")).unionByName(own.filter("k % 6 = 4").select(F.concat(F.lit("file"), k.cast("string")), F.lit("b"), "qualified_name").toDF("file_path", "alias", "full_name"))
    return call_rows, own, aliases, spark.createDataFrame([("print",), ("len",)], "ref string")


def j05_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([("part", "P"), ("part.Brand#13", "B"), ("customer.BUILDING", "C"), ("supp", "never")], "prefix string, replacement string")
    return rewritten(symbols(spark, sf_dir).select(F.col("qualified_name").alias("ref")), p)


def j07_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    calls_ = pages.select(F.col("page_id").alias("call_id"), "url")
    routes = pages.filter("page_id % 2 = 0").select(F.col("page_id").alias("route_id"), F.concat(text.url_path(F.col("url")), F.lit("/")).alias("path"))
    return routed(calls_, routes)


def j15_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return bloom_member(p.select(F.col("p_name").alias("key")), p.filter("p_partkey % 50 = 0").select(F.col("p_name").alias("key")), "key").groupBy("member").agg(F.count(F.lit(1)).alias("n"))


def j06_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir).filter("kind = 'function'").select("symbol_id", F.replace("file_path", F.lit("part/"), F.lit("src/")).alias("file_path"))
    return test_links(s)


QUERIES = {
    "j02_calls": lambda spark, d: calls(*_calls(spark, d)),
    "j05_rewritten": j05_rewritten,
    "j06_test_links": j06_tests,
    "j07_routed": j07_routed,
    "j15_bloom": j15_bloom,
    "j21_live_imports": lambda spark, d: live_import_paths(edges(spark, d), symbols(spark, d), symbols(spark, d).filter("kind = 'function' and language = 'go'").select("symbol_id")),
    "x01_unknown_refs": lambda spark, d: unknown_refs(_calls(spark, d)[0], _calls(spark, d)[1], _calls(spark, d)[3]),
    "f05_confidence": lambda spark, d: edges(spark, d).select("source_id", "target_id", "rel_type", confidence.rank(F.col("confidence")).alias("rank"), confidence.boosted(F.col("confidence")).alias("up"), confidence.demoted(F.col("confidence")).alias("down"), confidence.meets(F.col("confidence"), "probable").alias("meets")),
    "f06_clamped": lambda spark, d: edges(spark, d).select("source_id", "target_id", "rel_type", confidence.clamped(F.col("confidence"), F.lit("go"), F.when(F.col("rel_type") == "CALLS", "Go ").otherwise("ts"), F.when(F.col("target_id").endswith("1"), "runtime-trace").when(F.col("target_id").endswith("2"), "reflection").otherwise("")).alias("confidence")),
    "f09_uses": lambda spark, d: edges(spark, d).select("source_id", "target_id", "rel_type", confidence.is_strong_use(F.col("rel_type"), F.col("confidence")).alias("strong"), confidence.is_weak_use(F.col("rel_type"), F.col("confidence")).alias("weak")),
    "f10_test_paths": lambda spark, d: symbols(spark, d).filter(text.is_test_path(F.col("file_path"))).select("symbol_id"),
    "s02_glob": lambda spark, d: symbols(spark, d).filter(text.matches_glob(F.col("file_path"), "part/**/*COPPER*.go") | text.matches_glob(F.col("file_path"), "TESTS")).select("symbol_id"),
    "s06_edges": lambda spark, d: edges(spark, d).filter(F.col("target_id").startswith("sym:fx:c1") | F.col("target_id").startswith("sym:fx:p2")).filter("rel_type <> 'IMPORTS'"),
    "s07_lookup": lambda spark, d: symbols(spark, d).filter("qualified_name = 'Customer#000000012' or name = 'Customer#000000012'").orderBy(F.when(F.col("qualified_name") == "Customer#000000012", 0).otherwise(1), "symbol_id").limit(1).select("symbol_id"),
}

_P = """o as (select p_partkey as k, p_partkey::varchar as symbol_id, replace(p_brand, '#', '') || '.' || replace(p_type, ' ', '_') as m, 'f' || (p_partkey % 900) as name from part),
s as (select *, m || '.' || name as q from o),
c as (select 'c' || k as call_id, k, case when k % 2 = 0 then m else 'other' end as module, case k % 6 when 0 then q when 1 then name when 2 then 'print' when 3 then 'a.' || name when 4 then 'b' else 'zz' || k end as ref, case when k % 6 = 4 then q end as whole, case when k % 3 = 0 then m end as a_is, case when k % 6 = 4 then q end as b_is from s),
n as (select q, min(symbol_id) as t, count(*) as n from s group by 1), h as (select name, min(symbol_id) as t, count(*) as n from s group by 1), mm as (select m, name, min(symbol_id) as t, count(*) as n from s group by all)"""
ORACLE_SQL = {
    "j02_calls": f"""with {_P}, w as (
select call_id, 1 as rung, t, n from c join n on q = ref where n = 1 union all select call_id, 2, t, n from c join n on q = module || '.' || ref where n = 1
union all select call_id, 3, t, n from c join n on q = whole and ref = 'b' where n = 1 union all select call_id, 4, t, n from c join n on q = a_is || substr(ref, 2) and starts_with(ref, 'a.') where n = 1
union all select call_id, 4, t, n from c join n on q = b_is and ref = 'b' where n = 1
union all select call_id, case when n = 1 then 6 else 8 end, t, n from c join h on name = string_split(ref, '.')[-1] union all select call_id, 7, t, n from c join mm on m = module and name = string_split(ref, '.')[-1] where n = 1),
b as (select call_id, min((rung, t, n)) as b from w group by 1)
select call_id, case when ref = 'print' then 5 else coalesce(b[1], 9) end::int as rung, case when ref <> 'print' then b[2] end as target, case when ref = 'print' then 0 else coalesce(b[3], 0) end::bigint as candidates,
case when ref = 'print' then 'external' when b[1] < 5 then 'exact' when b[1] < 8 then 'probable' when b[1] = 8 then 'ambiguous' else 'unresolved' end as confidence from c left join b using (call_id)""",
    "j05_rewritten": f"""with {GRAPH_SQL} select qualified_name as ref, case when starts_with(qualified_name, 'part.Brand#13.') then 'B' || substr(qualified_name, 14) when starts_with(qualified_name, 'part.') then 'P' || substr(qualified_name, 5) when starts_with(qualified_name, 'customer.BUILDING.') then 'C' || substr(qualified_name, 18) else qualified_name end as rewritten from fx_symbols""",
    "j06_test_links": f"""with {GRAPH_SQL}, f as (select distinct replace(file_path, 'part/', 'src/') as p, regexp_replace(regexp_replace(file_path, '^.*/', ''), '\\.[^.]*$', '') as stem from fx_symbols where kind = 'function')
select a.p as production_file, b.p as test_file, 'file_stem' as reason from f a join f b on a.stem = b.stem and not starts_with(a.p, 'tests/') and starts_with(b.p, 'tests/')""",
    "j07_routed": """with p as (select page_id, case when length(rtrim(x, '/')) = 0 then '/' else rtrim(x, '/') end as key from (select page_id, regexp_replace(regexp_replace(url, '^[^/?#]*://[^/]*', ''), '[?#].*$', '') as x from pages)),
r as (select key, min(page_id) as route_id, count(*) as n from p where page_id % 2 = 0 group by 1)
select page_id as call_id, route_id, coalesce(n, 0) as routes, case when n = 1 then 'exact' when n > 1 then 'ambiguous' else 'unresolved' end as confidence from p left join r using (key)""",
    "j15_bloom": "select p_name in (select p_name from part where p_partkey % 50 = 0) as member, count(*) as n from part group by 1",
    "j21_live_imports": f"with {GRAPH_SQL} select distinct b.file_path from fx_edges join fx_symbols a on a.symbol_id = source_id join fx_symbols b on b.symbol_id = target_id where rel_type = 'IMPORTS' and a.kind = 'function' and a.language = 'go' and a.file_path <> b.file_path",
    "x01_unknown_refs": f"with {_P} select distinct ref from c where string_split(ref, '.')[-1] not in (select name from s) and ref <> 'print'",
    "f05_confidence": f"with {GRAPH_SQL} select source_id, target_id, rel_type, rank::int as rank, case confidence when 'unresolved' then 'ambiguous' when 'ambiguous' then 'probable' else 'exact' end as up, case confidence when 'exact' then 'probable' when 'probable' then 'ambiguous' else 'unresolved' end as down, rank >= 3 as meets from fx_ranked",
    "f06_clamped": f"""with {GRAPH_SQL}, c as (select *, case when rel_type <> 'CALLS' and confidence = 'exact' then 'probable' else confidence end as x from fx_edges)
select source_id, target_id, rel_type, case when target_id like '%1' then case x when 'unresolved' then 'ambiguous' when 'ambiguous' then 'probable' else 'exact' end when target_id like '%2' and x in ('exact', 'probable') then 'ambiguous' else x end as confidence from c""",
    "f09_uses": f"with {GRAPH_SQL} select source_id, target_id, rel_type, confidence not in ('ambiguous', 'unresolved') as strong, confidence in ('ambiguous', 'unresolved') as weak from fx_edges",
    "f10_test_paths": f"with {GRAPH_SQL} select symbol_id from fx_symbols where starts_with(file_path, 'tests/')",
    "s02_glob": f"with {GRAPH_SQL} select symbol_id from fx_symbols where (starts_with(file_path, 'part/') and file_path like '%COPPER%.go') or starts_with(file_path, 'tests/')",
    "s06_edges": f"with {GRAPH_SQL} select * from fx_edges where (starts_with(target_id, 'sym:fx:c1') or starts_with(target_id, 'sym:fx:p2')) and rel_type <> 'IMPORTS'",
    "s07_lookup": f"with {GRAPH_SQL} select symbol_id from fx_symbols where name = 'Customer#000000012' or qualified_name = 'Customer#000000012' order by 1 limit 1",
}
