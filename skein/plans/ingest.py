"""Ingestion: sources parsed and linked into the graph, pushed files, edits, and what files and documents hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import extract
from skein.functions.lineage import checkpointed, shared_folder, shuffled
from skein.operators import docs, linking, resolve
from skein.sources import files
from skein.sources.tables import GRAPH_SQL, symbols, table


def pushed(sources: DataFrame, known_hashes: DataFrame, known_symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and content hashes (file_path, content_hash) after a push of sources (file_path, source).

    Files whose hash is known are not parsed again; others replace what their file had. A file that
    no longer parses keeps nothing.
    """
    hashed = sources.withColumn("content_hash", F.sha2(F.coalesce("source", F.lit("")), 256))
    changed = hashed.join(known_hashes.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti")
    parsed = extract.python_symbols(changed)
    kept = known_symbols.join(changed.select("file_path").distinct(), "file_path", "left_anti").select(*parsed.columns)
    others = known_hashes.select("file_path", "content_hash").join(hashed.select("file_path"), "file_path", "left_anti")
    return kept.unionByName(parsed), others.unionByName(hashed.select("file_path", "content_hash"))


def linked(parsed: DataFrame, aliases: DataFrame, builtins: DataFrame, packages: DataFrame) -> DataFrame:
    """source, target (a qualified name as parsed; null: none found), rel_type, confidence: the edges that parsed symbols' written names make once they are resolved.

    Containment is exact; calls and base classes are resolved as calls, imports as imports.
    """
    parsed = checkpointed(parsed)  # read for every kind of edge
    path = parsed.select(F.col("qualified_name").alias("source"), "file_path").dropDuplicates(["source"])
    own = parsed.select(F.col("qualified_name").alias("symbol_id"), "kind", "name", "qualified_name", "file_path", F.lit("python").alias("language"))
    written = extract.python_edges(parsed).distinct().join(shuffled(path), "source", "left").withColumn("edge_id", F.concat_ws("|", "source", "rel_type", "target"))
    written = checkpointed(written)
    contains = written.filter("rel_type = 'CONTAINS'").select("source", "target", "rel_type", F.lit("exact").alias("confidence"))
    named = written.filter("rel_type in ('CALLS', 'INHERITS_FROM')")
    call_rows = named.select(F.col("edge_id").alias("call_id"), F.substring_index("source", ".", 1).alias("module"), "file_path", F.col("target").alias("ref"), F.lit("python").alias("language"))
    called = linking.polyglot_calls(call_rows, own, aliases, builtins).select(F.col("call_id").alias("edge_id"), F.col("target").alias("to"), "confidence")
    brought = written.filter("rel_type = 'IMPORTS'")
    imported = linking.imports(brought.select(F.col("edge_id").alias("import_id"), F.col("target").alias("text"), F.lit("python").alias("language")), own, packages).select(F.col("import_id").alias("edge_id"), F.col("target").alias("to"), "confidence")
    ends = named.join(shuffled(called), "edge_id").unionByName(brought.join(shuffled(imported), "edge_id"))
    return contains.unionByName(ends.select("source", F.col("to").alias("target"), "rel_type", "confidence"))


def after_edit(known: DataFrame, current: DataFrame, edited: DataFrame) -> DataFrame:
    """file_path, action (add, update, remove or null), status (pending or ok): edited files are pending until a sync has the hash that they have now."""
    plan = files.sync_plan(known, current)
    own = edited.select("file_path").distinct().withColumn("edited", F.lit(True))
    rows = known.select("file_path").union(current.select("file_path")).distinct().join(plan, "file_path", "left").join(own, "file_path", "left")
    return rows.select("file_path", "action", F.when(F.col("edited") & F.col("action").isNotNull(), "pending").otherwise("ok").alias("status"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each part: a class, a function with a route, an injection and a client call."""
    n = F.col("p_partkey")
    t = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    k = n + 1
    source = t(
        "import os\nfrom m", k, " import f", k, "\n\nclass C", n, "(Base", n % 3, "):\n    def run(self):\n        return f", k, "(os.path)\n\n\n@app.get(\"/p/", n, "\")\ndef f", n, "(db=Depends(get_", n % 4, ")):\n    requests.get(\"http://h/p/", k, "\")\n    return C", n, "()\n"
    )
    keys = table(spark, sf_dir, "part").select("p_partkey").repartition("p_partkey")  # a small file of keys makes many sources: more tasks than it has blocks
    return keys.select(n.alias("n"), t("pkg/m", n, ".py").alias("file_path"), F.lit("python").alias("language"), source.alias("source"))


def u07_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the parts' files, with f's name known by an import in each."""
    s = _sources(spark, sf_dir)
    n = F.col("n")
    aliases = s.select("file_path", F.concat(F.lit("f"), (n + 1).cast("string")).alias("alias"), F.concat(F.lit("m"), (n + 1).cast("string"), F.lit(".f"), (n + 1).cast("string")).alias("full_name"))
    return linked(extract.python_symbols(s.select("file_path", "source")), aliases, spark.createDataFrame([("requests.get",), ("app.get",), ("Depends",)], "ref string"), spark.createDataFrame([], "prefix string, replacement string"))


def x14_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file is known as it is, every third under another hash."""
    s, n = _sources(spark, sf_dir), F.col("n")
    known = s.filter(n % 3 > 0).select("file_path", F.when(n % 3 == 1, F.sha2("source", 256)).otherwise("old").alias("content_hash"))
    old = extract.python_symbols(s.filter(n % 3 > 0).select("file_path", F.lit("def old(): pass\n").alias("source")))
    return pushed(s.select("file_path", "source"), known, old)[0].select("file_path", "name")


def x20_after_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    known = p.filter(n % 7 > 0).select(n.alias("file_path"), F.col("p_brand").alias("content_hash"))
    now = p.filter(n % 5 > 0).select(n.alias("file_path"), F.when(n % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("content_hash"))
    return after_edit(known, now, p.filter(n % 2 == 0).select(n.alias("file_path")))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    head = F.concat(F.lit("---\ndoc_id: d"), k.cast("string"), F.lit("\ntitle: 'T "), k.cast("string"), F.lit("'\ntags: [x"), (k % 4).cast("string"), F.lit(", \"all\"]\nstatus: "), F.when(k % 3 == 0, "").otherwise(F.col("lang")), F.lit("\nlinked_symbols: a.b, c\n---\n"))
    return table(spark, sf_dir, "documents").select(k.cast("string").alias("path"), F.when(k % 5 > 0, F.concat(head, F.lit("# body"))).otherwise("no front matter").alias("text"))


def s09_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of JSON lines, read again between two moments."""
    at = f"{shared_folder(spark)}/usage-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    e.select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.col("user_id").cast("string").alias("client_id"), F.col("event_type").alias("tool"), F.col("event_id").alias("tokens_in"))).alias("value")).write.text(at)
    return files.usage_log(spark, at, "2024-01-05 00:00:00", "2024-01-20 12:00:00").select("client_id", "tool", "tokens_in")


def s10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors by way of a snapshot."""
    at = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    files.write_vectors(table(spark, sf_dir, "embeddings"), at, 64)
    return files.read_vectors(spark, at, 64).select("vec_id", "label", F.size("embedding").alias("dim"))


def s11_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.select((F.col("user_id") * 2).alias("k"), F.lit("old").alias("v")).distinct()
    changes = e.select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"))
    return files.upserted(now, changes, "k", "seq")


def s12_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    scope, other = {"tenant_id": "t", "workspace_id": "w", "project_id": "p1"}, {"tenant_id": "T", "workspace_id": "W", "project_id": "P"}
    rows = p.select(F.lit("t").alias("tenant_id"), F.lit("w").alias("workspace_id"), F.concat(F.lit("p"), (n % 3).cast("string")).alias("project_id"), F.concat(F.lit("sym:p"), (n % 3).cast("string"), F.lit(":"), n.cast("string")).alias("id"))
    return files.remapped(rows, scope, other, ("id",)).select("project_id", "id")


def s13_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.lit("t").alias("tenant_id"), F.concat(F.lit("w"), (n % 2).cast("string")).alias("workspace_id"), F.concat(F.lit("p"), (n % 3).cast("string")).alias("project_id"))
    left, counts = files.without_scope(rows, {"tenant_id": "t", "workspace_id": "w1", "project_id": "p2"})
    return counts.withColumn("left", F.lit(None).cast("long")).unionByName(left.agg(F.count(F.lit(1)).alias("left")).select(F.lit(None).cast("boolean").alias("removed"), F.lit(None).cast("long").alias("rows"), "left"))


def x18_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    current = d.filter(k % 2 == 0).select("doc_id", F.col("source").alias("body"), F.lit(3).alias("version"))
    incoming = d.filter(k % 3 > 0).select("doc_id", F.when(k % 5 == 0, F.col("lang")).otherwise(F.col("source")).alias("body"), k.alias("seq"))
    return docs.indexed(current, incoming.unionByName(incoming.filter(k % 7 == 0).select("doc_id", F.lit("late").alias("body"), (F.col("seq") + 1).alias("seq"))))


def j19_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return resolve.related(e.select(F.col("event_id").alias("record_id"), F.col("user_id").cast("string").alias("correlation_id")), e.filter("event_id % 3 = 0").select(F.col("event_id").alias("record_id"), F.col("event_type").alias("entity_ref")), "7", "error")


QUERIES = {
    "s03_ignored": lambda spark, d: files.ignored(symbols(spark, d).select("symbol_id", "file_path"), ["tests/", "*.ts", "!**/BUILDING.ts", "# note", "supplier/F*"], "file_path").select("symbol_id", "ignored"),
    "s08_sync_plan": lambda spark, d: files.sync_plan(table(spark, d, "part").filter("p_partkey % 7 > 0").select(F.col("p_partkey").alias("file_path"), F.col("p_brand").alias("content_hash")), table(spark, d, "part").filter("p_partkey % 5 > 0").select(F.col("p_partkey").alias("file_path"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("content_hash"))),
    "s08_publishable": lambda spark, d: files.publishable_hashes(table(spark, d, "part").select(F.col("p_partkey").alias("file_path"), F.col("p_brand").alias("content_hash"), (F.col("p_size") > 20).alias("complete")), table(spark, d, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("file_path"))),
    "s09_usage_log": s09_usage,
    "s10_vectors": s10_vectors,
    "s11_upserted": s11_upserted,
    "s12_remapped": s12_remapped,
    "s13_without_scope": s13_scopes,
    "s15_catalogue": lambda spark, d: docs.catalogue_entries(_entries(spark, d)).select("path", "doc_id", "title", "status", F.array_join("tags", ",").alias("tags"), "linked_symbols_count"),
    "s15_vocabulary": lambda spark, d: docs.observed(docs.catalogue_entries(_entries(spark, d))),
    "t05_coverage_gaps": lambda spark, d: docs.coverage_gaps(table(spark, d, "documents").select(F.col("doc_id").alias("symbol")), table(spark, d, "documents").filter("doc_id % 7 = 0").select(F.col("doc_id").alias("symbol")), table(spark, d, "labels").select(F.col("doc_id").alias("symbol"))),
    "u01_python_symbols": lambda spark, d: extract.python_symbols(_sources(spark, d).select("file_path", "source")).select("file_path", "kind", "qualified_name", "line", "visibility", F.array_join("bases", ",").alias("bases"), F.array_join("calls", ",").alias("calls"), F.array_join("imports", ",").alias("imports")),
    "u03_routes": lambda spark, d: extract.routes(_sources(spark, d)),
    "u04_http_calls": lambda spark, d: extract.http_calls(_sources(spark, d)),
    "u05_injections": lambda spark, d: extract.injections(_sources(spark, d)),
    "u06_package_aliases": lambda spark, d: extract.package_aliases(table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/"), F.when(F.col("p_partkey") % 2 == 0, "pyproject.toml").otherwise("go.mod")).alias("file_path"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('[project]\nname = "my-pkg-'), F.col("p_partkey").cast("string"), F.lit('"\n'))).otherwise(F.concat(F.lit("module ex.com/m"), F.col("p_partkey").cast("string"), F.lit("\nreplace ex.com/r"), F.col("p_partkey").cast("string"), F.lit(" => ./local/dir\n"))).alias("source"))),
    "u07_linked": u07_linked,
    "u09_front_matter_errors": lambda spark, d: docs.front_matter_errors(_entries(spark, d), "path", ("doc_id", "status", "phase")),
    "x14_pushed": x14_pushed,
    "x18_indexed": x18_index,
    "x18_anchors": lambda spark, d: docs.anchors_recorded(table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 5).alias("symbol"), F.lit("old").alias("recorded_hash")), table(spark, d, "labels").filter("quality = 1").select("doc_id", (F.col("doc_id") % 3).alias("symbol"), F.lit("new").alias("recorded_hash"), F.col("doc_id").alias("seq"))),
    "x20_after_edit": x20_after_edit,
    "j19_related": j19_related,
}

_S = "s as (select p_partkey as n, p_partkey + 1 as k, 'pkg/m' || p_partkey || '.py' as file_path from part)"
_PLAN = "pl as (select p_partkey as file_path, p_partkey % 7 > 0 as known, p_partkey % 5 > 0 as now, p_partkey % 3 = 0 as changed from part)"
_ACTION = "case when known and now and changed then 'update' when known and not now then 'remove' when now and not known then 'add' end"
ORACLE_SQL = {
    "s03_ignored": f"with {GRAPH_SQL} select symbol_id, starts_with(file_path, 'tests/') or starts_with(file_path, 'supplier/F') or (file_path like '%.ts' and file_path not like '%/BUILDING.ts') as ignored from fx_symbols",
    "s08_sync_plan": f"with {_PLAN} select file_path, {_ACTION} as action from pl where action is not null",
    "s08_publishable": "select p_partkey as file_path, p_brand as content_hash from part where p_size > 20 or p_partkey % 4 = 0",
    "s09_usage_log": "select user_id::varchar as client_id, event_type as tool, event_id as tokens_in from events where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 12:00:00'",
    "s10_vectors": "select vec_id, label, len(embedding)::int as dim from embeddings",
    "s11_upserted": "with l as (select user_id as k, arg_max(event_type, event_id) as v from events group by 1) select distinct user_id * 2 as k, 'old' as v from events where user_id * 2 not in (select k from l) union all select k, v from l where v <> 'error'",
    "s12_remapped": "select case when p_partkey % 3 = 1 then 'P' else 'p' || (p_partkey % 3) end as project_id, 'sym:' || case when p_partkey % 3 = 1 then 'P' else 'p' || (p_partkey % 3) end || ':' || p_partkey as id from part",
    "s13_without_scope": "select p_partkey % 2 = 1 and p_partkey % 3 = 2 as removed, count(*) as rows, null::bigint as \"left\" from part group by 1 union all select null, null, count(*) from part where not (p_partkey % 2 = 1 and p_partkey % 3 = 2)",
    "s15_catalogue": "select doc_id::varchar as path, 'd' || doc_id as doc_id, 'T ' || doc_id as title, case when doc_id % 3 = 0 then '' else lang end as status, 'x' || (doc_id % 4) || ',all' as tags, 2::int as linked_symbols_count from documents where doc_id % 5 > 0",
    "s15_vocabulary": "with d as (select * from documents where doc_id % 5 > 0) select 'tags' as key, 'x' || (doc_id % 4) as value, count(*) as n from d group by 2 union all select 'tags', 'all', count(*) from d having count(*) > 0 union all select 'status', lang, count(*) from d where doc_id % 3 > 0 group by lang",
    "t05_coverage_gaps": "select doc_id as symbol from documents where doc_id % 7 = 0 and doc_id not in (select doc_id from labels)",
    "u01_python_symbols": f"""with {_S} select file_path, 'module' as kind, 'm' || n as qualified_name, 1::int as line, 'public' as visibility, '' as bases, '' as calls, 'm' || k || '.f' || k || ',os' as imports from s
union all select file_path, 'class', 'm' || n || '.C' || n, 4, 'public', 'Base' || (n % 3), '', '' from s union all select file_path, 'method', 'm' || n || '.C' || n || '.run', 5, 'public', '', 'f' || k, '' from s
union all select file_path, 'function', 'm' || n || '.f' || n, 10, 'public', '', 'C' || n || ',Depends,app.get,requests.get', '' from s""",
    "u03_routes": f"with {_S} select file_path, 'GET' as method, '/p/' || n as path, 'f' || n as handler from s",
    "u04_http_calls": f"with {_S} select file_path, 'GET' as method, 'http://h/p/' || k as url from s",
    "u05_injections": f"with {_S} select file_path, 'db' as parameter, 'get_' || (n % 4) as provider, 'f' || n as consumer from s",
    "u06_package_aliases": "with p as (select p_partkey as n from part) select 'my-pkg-' || n as prefix, 'my_pkg_' || n as replacement from p where n % 2 = 0 union all select 'my_pkg_' || n, 'my_pkg_' || n from p where n % 2 = 0 union all select 'ex.com/m' || n, 'ex.com/m' || n from p where n % 2 = 1 union all select 'ex.com/r' || n, 'dir' from p where n % 2 = 1",
    "u07_linked": f"""with {_S}, x as (select n, k, 'm' || n as m, exists (select 1 from s t where t.n = s.k) as has from s)
select m as source, m || '.C' || n as target, 'CONTAINS' as rel_type, 'exact' as confidence from x union all select m || '.C' || n, m || '.C' || n || '.run', 'CONTAINS', 'exact' from x union all select m, m || '.f' || n, 'CONTAINS', 'exact' from x
union all select m || '.C' || n, null, 'INHERITS_FROM', 'unresolved' from x
union all select m || '.C' || n || '.run', case when has then 'm' || k || '.f' || k end, 'CALLS', case when has then 'exact' else 'unresolved' end from x
union all select m || '.f' || n, m || '.C' || n, 'CALLS', 'exact' from x union all select m || '.f' || n, null, 'CALLS', 'external' from x, range(3)
union all select m, case when has then 'm' || k || '.f' || k end, 'IMPORTS', case when has then 'exact' else 'unresolved' end from x union all select m, null, 'IMPORTS', 'unresolved' from x""",
    "u09_front_matter_errors": "select doc_id::varchar as path, case when doc_id % 5 = 0 then 'missing:doc_id,missing:status,missing:phase' when doc_id % 3 = 0 then 'missing:status,missing:phase' else 'missing:phase' end as errors from documents",
    "x14_pushed": f"with {_S} select file_path, unnest(case when n % 3 = 1 then ['m' || n, 'old'] else ['m' || n, 'C' || n, 'run', 'f' || n] end) as name from s",
    "x18_indexed": """with d as (select doc_id, source, lang, doc_id % 2 = 0 as has, doc_id % 3 > 0 as came from documents), x as (select doc_id, has, came, source, case when doc_id % 7 = 0 then 'late' when doc_id % 5 = 0 then lang else source end as new from d where has or came)
select doc_id, case when came then new else source end as body, case when not has then 1 when came and new <> source then 4 else 3 end::int as version from x""",
    "x18_anchors": "with c as (select doc_id, doc_id % 5 as symbol from labels), i as (select doc_id, doc_id % 3 as symbol from labels where quality = 1) select doc_id, symbol, 'new' as recorded_hash from i union select doc_id, symbol, 'old' from c where (doc_id, symbol) not in (select doc_id, symbol from i)",
    "x20_after_edit": f"with {_PLAN}, a as (select *, {_ACTION} as action from pl where known or now) select file_path, action, case when file_path % 2 = 0 and action is not null then 'pending' else 'ok' end as status from a",
    "j19_related": "select event_id as record_id from events where user_id = 7 or (event_id % 3 = 0 and event_type = 'error')",
}
