"""Documentation: drift, coverage, staleness, standards, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.extract import compressed
from skein.sources.files import sync_plan
from skein.sources.tables import table

# Tags that make drift severe, base scores of findings, and the tiers' bounds.
CRITICAL_TAGS = ("security", "compliance", "auth", "billing")
HIGH_TAGS = ("api", "schema", "contract", "migration")
BASE_SCORES = {
    "coverage_gap": 0.55, "stale_anchor": 0.65, "superseded_retrieval_risk": 0.70, "duplicate_authority": 0.70, "wiki_orphan": 0.80, "ghost_link": 0.80, "orphan_doc": 0.90,
}
CAP, HIGH, MEDIUM, RECENT_DAYS = 0.55, 0.80, 0.50, 14


def severity(tags: Column, required: Column) -> Column:
    """critical or high by tags; else low if no document is required, else medium."""
    has = lambda words: F.arrays_overlap(tags, F.array(*[F.lit(w) for w in words]))
    return F.when(has(CRITICAL_TAGS), "critical").when(has(HIGH_TAGS), "high").when(~required, "low").otherwise("medium")


def drift(symbol_rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """symbol, status, severity of symbols (symbol, doc_required, hash, tags) against anchors (symbol, recorded_hash).

    missing_doc: required and without an anchor; stale_doc: the recorded hash differs; synced: it is
    the same. Symbols that need no document and have none are left out.
    """
    a = anchors.groupBy("symbol").agg(F.max("recorded_hash").alias("recorded_hash"))
    rows = symbol_rows.join(a, "symbol", "left")
    status = F.when(F.col("recorded_hash").isNull() & F.col("doc_required"), "missing_doc").when(F.col("recorded_hash").isNull(), None).when(F.col("recorded_hash") != F.col("hash"), "stale_doc").otherwise("synced")
    return rows.select("symbol", status.alias("status"), severity(F.col("tags"), F.col("doc_required")).alias("severity")).filter("status is not null")


def missing(symbol_rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """symbol, severity of symbols that need a document and have no anchor."""
    rows = symbol_rows.filter("doc_required").join(anchors.select("symbol").distinct(), "symbol", "left_anti")
    return rows.select("symbol", severity(F.col("tags"), F.col("doc_required")).alias("severity"))


def anchored(documents: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """The documents that an anchor names."""
    return documents.join(anchors.select(key).distinct(), key, "left_semi")


def coverage(symbol_rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """required, documented, ratio (3 decimals; null without required symbols)."""
    a = anchors.select("symbol").distinct().withColumn("has", F.lit(1))
    s = symbol_rows.filter("doc_required").join(a, "symbol", "left").agg(F.count(F.lit(1)).alias("required"), F.count("has").alias("documented"))
    return s.withColumn("ratio", F.round(F.when(F.col("required") > 0, F.col("documented") / F.col("required")), 3))


def gate(findings: DataFrame) -> DataFrame:
    """verdict, blockers, warnings of findings (severity, status): those fixed or waived don't count; critical and high block."""
    own = findings.filter(~F.col("status").isin("fixed", "waived"))
    s = own.agg(F.count(F.when(F.col("severity").isin("critical", "high"), 1)).alias("blockers"), F.count(F.when(F.col("severity") == "medium", 1)).alias("warnings"))
    return s.select(F.when(F.col("blockers") > 0, "fail").otherwise("pass").alias("verdict"), "blockers", "warnings")


def duplicate_authority(documents: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """topic, doc_id, peers: normative, current documents that share a topic with others (columns doc_id, topic, authority, lifecycle).

    Peers are counted by topic, not paired. related (doc_id, other_id) are declared relations: such peers don't count.
    """
    own = documents.filter("authority = 'normative' and lifecycle = 'current'").select("topic", "doc_id").distinct()
    n = own.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = own.join(n, "topic")
    if related is not None:
        both = related.select("doc_id", "other_id").union(related.select("other_id", "doc_id")).distinct()
        declared = both.join(own.select("topic", "doc_id"), "doc_id").join(own.select("topic", F.col("doc_id").alias("other_id")), ["topic", "other_id"]).groupBy("topic", "doc_id").agg(F.count(F.lit(1)).alias("declared"))
        rows = rows.join(declared, ["topic", "doc_id"], "left")
    else:
        rows = rows.withColumn("declared", F.lit(0))
    return rows.select("topic", "doc_id", (F.col("n") - 1 - F.coalesce("declared", F.lit(0))).cast("long").alias("peers")).filter("peers > 0")


def stale_score(findings: DataFrame) -> DataFrame:
    """findings with score, tier, safe_to_update, safe_to_unlink, safe_to_delete.

    Columns: finding_kind, authority, lifecycle, freshness, days_since_touch, all_links_missing,
    no_documented_by. A base by kind, then caps at 0.55 for current normative documents (but for
    orphans and ghost links), for those touched within 14 days and for a stale index.
    """
    kind = F.col("finding_kind")
    base = F.lit(0.50)
    for k, v in BASE_SCORES.items():
        base = F.when(kind == k, F.lit(v)).otherwise(base)
    normative = (F.lower(F.trim(F.coalesce("authority", F.lit("")))) == "normative") & (F.lower(F.trim(F.coalesce("lifecycle", F.lit("")))) == "current")
    recent = F.coalesce(F.col("days_since_touch") <= RECENT_DAYS, F.lit(False))
    behind = F.col("freshness").isin("stale", "pending_sync")
    capped = (normative & ~kind.isin("orphan_doc", "ghost_link")) | recent | behind
    out = findings.withColumn("score", F.round(F.when(capped, F.least(base, F.lit(CAP))).otherwise(base), 4))
    delete = kind.isin("orphan_doc", "ghost_link") & F.col("all_links_missing") & F.col("no_documented_by") & ~normative & ~recent & ~behind & (F.col("score") >= HIGH)
    return out.withColumns({
        "tier": F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low"),
        "safe_to_update": kind.isin("stale_anchor", "wiki_orphan", "duplicate_authority") & (F.col("freshness") != "pending_sync"),
        "safe_to_unlink": (kind == "ghost_link") & ~behind & ~normative, "safe_to_delete": delete,
    })


def standards(documents: DataFrame, id_col: str, text_col: str, most_lines: int = 400, most_hard: int = 800) -> DataFrame:
    """id_col, issues (sorted, joined by commas) of documents that lack a heading or a purpose, or are too long."""
    t = F.coalesce(text_col, F.lit(""))
    lines = F.size(F.split(t, "\n", -1))
    checks = [F.when(~t.rlike(r"(?m)^# "), "missing_h1"), F.when(~t.rlike(r"(?mi)^#+ *purpose"), "missing_purpose"), F.when(lines > most_hard, "over_hard_size").when(lines > most_lines, "over_size"), F.when(F.trim(t) == "", "empty")]
    return documents.select(id_col, F.array_join(F.array_sort(F.array_compact(F.array(*checks))), ",").alias("issues")).filter("issues <> ''")


def front_matter(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with front (map of the flat key: value lines of a block between --- lines at the beginning) and body."""
    block = F.regexp_extract(text_col, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    pairs = F.transform(F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:")), lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v"))))
    return documents.withColumn("front", last).withColumn("body", F.regexp_replace(text_col, r"(?s)^---\n.*?\n---(?:\n|$)", ""))


def listed_value(c: Column) -> Column:
    """A front matter's value as a list: [a, b], or a, b; quotes go; null and blank are empty."""
    inner = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*\[|\]\s*$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


# Single and listed keys of a catalogue's entries.
ENTRY_KEYS = ("doc_id", "title", "summary", "doc_type", "phase", "status", "lifecycle_lane", "concern_lane", "authority", "visibility")
ENTRY_LISTS = ("tags", "audience_lane")


def catalogue_entries(documents: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """path, the entry keys (empty where a document lacks them), its lists, linked_symbols_count of the documents that have front matter, by path."""
    front = front_matter(documents, text_col).filter(F.size("front") > 0)
    value = lambda k: F.try_element_at("front", F.lit(k))
    single = [F.coalesce(F.regexp_replace(value(k), "^[\"']|[\"']$", ""), F.lit("")).alias(k) for k in ENTRY_KEYS]
    return front.select(F.col(path_col).alias("path"), *single, *[listed_value(value(k)).alias(k) for k in ENTRY_LISTS], F.size(listed_value(value("linked_symbols"))).alias("linked_symbols_count")).orderBy("path")


def _of_key(key: str):
    return lambda v: F.struct(F.lit(key).alias("key"), v.alias("value"))


def observed(entries: DataFrame, keys: tuple[str, ...] = (*ENTRY_KEYS[3:], *ENTRY_LISTS)) -> DataFrame:
    """key, value, n of the values that a catalogue's entries have: a vocabulary for each key, commonest first, then by name."""
    each = [F.transform(F.col(k) if k in ENTRY_LISTS else F.array(k), _of_key(k)) for k in keys]
    rows = entries.select(F.explode(F.concat(*each)).alias("e")).select("e.*").filter("value <> ''")
    return rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")).orderBy("key", F.desc("n"), "value")


def coverage_gaps(symbol_rows: DataFrame, required: DataFrame, anchors: DataFrame) -> DataFrame:
    """symbol of those that required (symbol) names and no anchor has; only what is named is asked for."""
    own = symbol_rows.select("symbol").join(required.select("symbol").distinct(), "symbol", "left_semi")
    return own.join(anchors.select("symbol").distinct(), "symbol", "left_anti")


def front_matter_errors(documents: DataFrame, id_col: str, required: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """id_col, errors (joined by commas; empty: none): what a document's front matter lacks or leaves blank."""
    front = front_matter(documents, text_col)
    lacks = [F.when(F.trim(F.coalesce(F.try_element_at("front", F.lit(k)), F.lit(""))) == "", F.lit(f"missing:{k}")) for k in required]
    return front.select(id_col, F.array_join(F.array_compact(F.array(*lacks)), ",").alias("errors"))


def indexed(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """doc_id, body, version of an index (the same columns) after incoming (doc_id, body, seq): of each id the last counts; another body is a version more, the same body none."""
    last = incoming.groupBy("doc_id").agg(F.max_by("body", "seq").alias("new"), F.lit(True).alias("came"))
    both = current.join(last, "doc_id", "full")
    changed = F.col("came") & ~F.col("new").eqNullSafe(F.col("body"))
    version = F.coalesce("version", F.lit(0)) + F.when(F.coalesce(changed, F.lit(False)) | F.col("version").isNull(), 1).otherwise(0)
    return both.select("doc_id", F.when(F.coalesce("came", F.lit(False)), F.col("new")).otherwise(F.col("body")).alias("body"), version.cast("int").alias("version"))


def anchors_recorded(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """doc_id, symbol, recorded_hash of anchors after incoming (the same columns, seq): a document has one anchor for a symbol, with the hash recorded last."""
    rows = current.withColumn("seq", F.lit(-1).cast("long")).unionByName(incoming.withColumn("seq", F.col("seq").cast("long")))
    return rows.groupBy("doc_id", "symbol").agg(F.max_by("recorded_hash", "seq").alias("recorded_hash"))


def evidence_links(documents: DataFrame, id_col: str, text_col: str, existing: DataFrame | None = None) -> DataFrame:
    """id_col, link: distinct paths and dotted names in backquotes, but for those that existing (id_col, link) has."""
    found = documents.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"`([A-Za-z_][\w./:-]{2,})`"), F.lit(1)))).alias("link"))
    return found if existing is None else found.join(existing.select(id_col, "link").distinct(), [id_col, "link"], "left_anti")


def rationale(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, line (from 1), tag, note of lines that begin with a tag such as WHY: or NOTE:."""
    lines = documents.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("at", "line"))
    tag = F.regexp_extract("line", r"(?i)\b(why|note|todo|hack|contract|invariant)\s*:\s*(.+)$", 1)
    return lines.filter(tag != "").select(id_col, (F.col("at") + 1).alias("line"), F.lower(tag).alias("tag"), F.trim(F.regexp_extract("line", r"(?i)\b(why|note|todo|hack|contract|invariant)\s*:\s*(.+)$", 2)).alias("note"))


def suffix_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """link, path: a link names a path that is equal to it or ends with it at a slash; by equality on exploded suffixes, not by comparing all; of several the least."""
    parts = F.split("path", "/", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    keyed = paths.select("path").distinct().select("path", F.explode(tails).alias("link"))
    return links.select("link").distinct().join(keyed, "link").groupBy("link").agg(F.min("path").alias("path"))


def outcome(rows: DataFrame, score_col: str = "score") -> DataFrame:
    """rows with outcome: draft from 0.75, task from 0.4, else gap."""
    return rows.withColumn("outcome", F.when(F.col(score_col) >= 0.75, "draft").when(F.col(score_col) >= 0.4, "task").otherwise("gap"))


def catalogue(entries: DataFrame, limit: int, query: str = "", tag: str | None = None, **lanes: str) -> DataFrame:
    """The first limit entries by path whose lanes equal (case apart), whose tags hold tag, and whose fields hold every word of query."""
    for k, v in lanes.items():
        entries = entries.filter(F.lower(k) == v.lower())
    if tag is not None:
        entries = entries.filter(F.array_contains(F.transform("tags", F.lower), tag.lower()))
    hay = F.lower(F.concat_ws(" ", "path", "title", F.array_join("tags", " ")))
    for w in query.lower().split():
        entries = entries.filter(F.contains(hay, F.lit(w)))
    return entries.orderBy("path").limit(limit)


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    tags = F.when(F.col("doc_id") % 13 == 0, F.array(F.lit("auth"))).when(F.col("doc_id") % 7 == 0, F.array(F.lit("api"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    return d.select(F.col("doc_id").alias("symbol"), (F.col("n_chars") > 1000).alias("doc_required"), F.md5("text").alias("hash"), tags.alias("tags"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select(F.col("doc_id").alias("symbol"), F.when(F.col("toxic") == 1, "old").otherwise(F.md5("text")).alias("recorded_hash"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    pick = lambda words, by: F.element_at(F.array(*[F.lit(w) for w in words]), (by % len(words) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", pick([*BASE_SCORES, "other"], k).alias("finding_kind"), pick(["normative", "informative"], F.floor(k / 8)).alias("authority"), pick(["current", "draft", "current"], F.floor(k / 16)).alias("lifecycle"),
        pick(["ok", "ok", "stale", "pending_sync"], F.floor(k / 3)).alias("freshness"), F.when(k % 5 > 0, k % 40).alias("days_since_touch"), (k % 2 == 0).alias("all_links_missing"), (k % 3 > 0).alias("no_documented_by"),
    )


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("topic"), F.when(F.col("doc_id") % 3 == 0, "informative").otherwise("normative").alias("authority"), F.lit("current").alias("lifecycle"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("title"), F.split("p_type", " ").alias("tags"), F.col("p_brand").alias("lane"))


QUERIES = {
    "j12_drift": lambda spark, d: drift(_symbols(spark, d), _anchors(spark, d)),
    "j13_missing_docs": lambda spark, d: missing(_symbols(spark, d), _anchors(spark, d)),
    "j14_docs_for_symbols": lambda spark, d: anchored(table(spark, d, "documents"), table(spark, d, "labels").filter("quality = 0"), "doc_id").select("doc_id", "source"),
    "a11_coverage": lambda spark, d: coverage(_symbols(spark, d), _anchors(spark, d)),
    "a13_gate": lambda spark, d: gate(drift(_symbols(spark, d), _anchors(spark, d)).withColumn("status", F.when(F.col("symbol") % 2 == 0, "waived").otherwise(F.col("status")))),
    "a14_severity": lambda spark, d: _symbols(spark, d).select("symbol", severity(F.col("tags"), F.col("doc_required")).alias("severity")),
    "j16_suffix_links": lambda spark, d: suffix_links(_entries(spark, d).select(F.substring_index("path", "/", -1).alias("link")), _entries(spark, d)),
    "j17_duplicate_authority": lambda spark, d: duplicate_authority(_topics(spark, d)),
    "t01_standards": lambda spark, d: standards(table(spark, d, "documents"), "doc_id", "text", 5, 20),
    "t04_stale_score": lambda spark, d: stale_score(_findings(spark, d)).select("doc_id", "score", "tier", "safe_to_update", "safe_to_unlink", "safe_to_delete"),
    "t18_outcome": lambda spark, d: outcome(stale_score(_findings(spark, d))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")),
    "e12_sync_plan": lambda spark, d: sync_plan(
        table(spark, d, "documents").filter("doc_id % 7 > 0").select(F.col("doc_id").alias("file_path"), F.md5("text").alias("content_hash")),
        table(spark, d, "documents").filter("doc_id % 5 > 0").select(F.col("doc_id").alias("file_path"), F.md5(F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("text"))).alias("content_hash")),
    ),
    "t02_evidence_links": lambda spark, d: evidence_links(table(spark, d, "part").select("p_partkey", F.concat(F.lit("see `"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("` and `"), F.lower("p_brand"), F.lit("` or `part.name`")).alias("t")), "p_partkey", "t"),
    "t08_rationale": lambda spark, d: rationale(table(spark, d, "part").select("p_partkey", F.concat(F.lit("x\nWhy: "), F.col("p_name"), F.lit("\nnote : "), F.col("p_brand"), F.lit("\n")).alias("t")), "p_partkey", "t"),
    "t09_compressed": lambda spark, d: table(spark, d, "documents").select("doc_id", F.sha2(compressed(F.col("text")), 256).alias("digest")),
    "f01_catalogue": lambda spark, d: catalogue(_entries(spark, d), 30, query="brand 1", lane="BRAND#13").select("path", "title"),
}

_S = "s as (select doc_id as symbol, n_chars > 1000 as doc_required, md5(text) as hash, case when doc_id % 13 = 0 then 'critical' when doc_id % 7 = 0 then 'high' when n_chars <= 1000 then 'low' else 'medium' end as severity from documents), a as (select doc_id as symbol, case when toxic = 1 then 'old' else md5(text) end as recorded_hash from labels join documents using (doc_id))"
_D = "f as (select symbol, case when recorded_hash is null and doc_required then 'missing_doc' when recorded_hash is null then null when recorded_hash <> hash then 'stale_doc' else 'synced' end as status, severity from s left join a using (symbol))"
_KINDS = "['coverage_gap', 'stale_anchor', 'superseded_retrieval_risk', 'duplicate_authority', 'wiki_orphan', 'ghost_link', 'orphan_doc', 'other']"
_SCORES = "[0.55, 0.65, 0.70, 0.70, 0.80, 0.80, 0.90, 0.50]"
_T = f"""i as (select doc_id as k, {_KINDS}[doc_id % 8 + 1] as kind, {_SCORES}[doc_id % 8 + 1]::double as base, (doc_id // 8) % 2 = 0 and (doc_id // 16) % 3 <> 1 as normative,
['ok', 'ok', 'stale', 'pending_sync'][(doc_id // 3) % 4 + 1] as freshness, doc_id % 5 > 0 and doc_id % 40 <= 14 as recent from documents),
t as (select *, freshness <> 'ok' as behind, case when (normative and kind not in ('orphan_doc', 'ghost_link')) or recent or freshness <> 'ok' then least(base, 0.55::double) else base end as score from i),
u as (select k as doc_id, score, case when score >= 0.8 then 'high' when score >= 0.5 then 'medium' else 'low' end as tier, kind in ('stale_anchor', 'wiki_orphan', 'duplicate_authority') and freshness <> 'pending_sync' as safe_to_update,
kind = 'ghost_link' and not behind and not normative as safe_to_unlink, kind in ('orphan_doc', 'ghost_link') and k % 2 = 0 and k % 3 > 0 and not normative and not recent and not behind and score >= 0.8 as safe_to_delete from t)"""
ORACLE_SQL = {
    "j12_drift": f"with {_S}, {_D} select * from f where status is not null",
    "j13_missing_docs": f"with {_S} select symbol, severity from s where doc_required and symbol not in (select symbol from a)",
    "j14_docs_for_symbols": "select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 0)",
    "a11_coverage": f"with {_S} select count(*) as required, count(*) filter (symbol in (select symbol from a)) as documented, round(count(*) filter (symbol in (select symbol from a)) / count(*)::double, 3) as ratio from s where doc_required",
    "a13_gate": f"with {_S}, {_D}, g as (select count(*) filter (severity in ('critical', 'high')) as blockers, count(*) filter (severity = 'medium') as warnings from f where status is not null and symbol % 2 <> 0) select case when blockers > 0 then 'fail' else 'pass' end as verdict, blockers, warnings from g",
    "a14_severity": f"with {_S} select symbol, severity from s",
    "j16_suffix_links": "select p_partkey::varchar as link, p_brand || '/' || p_partkey as path from part",
    "j17_duplicate_authority": "with o as (select sha256(text) as topic, doc_id from documents where doc_id % 3 <> 0) select topic, doc_id, n - 1 as peers from (select *, count(*) over (partition by topic) as n from o) where n > 1",
    "t01_standards": r"with c as (select doc_id, regexp_matches(text, '(?m)^# ') as h, regexp_matches(text, '(?mi)^#+ *purpose') as p, len(string_split(text, chr(10))) as n, trim(text, ' ') = '' as e from documents), i as (select doc_id, array_to_string(list_sort(list_filter([case when not h then 'missing_h1' end, case when not p then 'missing_purpose' end, case when n > 20 then 'over_hard_size' when n > 5 then 'over_size' end, case when e then 'empty' end], lambda x: x is not null)), ',') as issues from c) select * from i where issues <> ''",
    "t04_stale_score": f"with {_T} select * from u",
    "t18_outcome": f"with {_T} select case when score >= 0.75 then 'draft' when score >= 0.4 then 'task' else 'gap' end as outcome, count(*) as n from u group by 1",
    "e12_sync_plan": "select doc_id as file_path, case when doc_id % 7 = 0 then 'add' when doc_id % 5 = 0 then 'remove' else 'update' end as action from documents where (doc_id % 7 = 0 and doc_id % 5 > 0) or (doc_id % 5 = 0 and doc_id % 7 > 0) or (doc_id % 7 > 0 and doc_id % 5 > 0 and doc_id % 3 = 0)",
    "t02_evidence_links": "select p_partkey, replace(p_type, ' ', '/') as link from part union all select p_partkey, 'part.name' from part",
    "t08_rationale": "select p_partkey, 2 as line, 'why' as tag, p_name as note from part union all select p_partkey, 3, 'note', p_brand from part",
    "t09_compressed": "with d as (select doc_id, text as t, length(text) as n, greatest(400, length(text) // 10) as e from documents) select doc_id, sha256(case when n < 2000 then t else substr(t, 1, e) || chr(10) || '[compressed] ' || (n - 2 * e) || ' characters' || chr(10) || substr(t, n - e + 1, e) end) as digest from d",
    "f01_catalogue": "select p_brand || '/' || p_partkey as path, p_name as title from part where lower(p_brand) = 'brand#13' and contains(lower(p_brand || '/' || p_partkey || ' ' || p_name || ' ' || p_type), '1') order by 1 limit 30",
}
