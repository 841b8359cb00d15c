"""Roll-ups of measurements, usage, audits and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.lineage import checkpointed
from skein.sources.tables import table

# Severities from worst to least.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def compared(samples: DataFrame) -> DataFrame:
    """kpi_name, treatment, control, delta, n of columns kpi_name, cohort, value: only measures that both cohorts have."""
    mean = lambda c: F.avg(F.when(F.col("cohort") == c, F.col("value")))
    s = samples.groupBy("kpi_name").agg(mean("treatment").alias("t"), mean("control").alias("c"), F.count(F.lit(1)).alias("n")).filter("t is not null and c is not null")
    return s.select("kpi_name", F.round("t", 6).alias("treatment"), F.round("c", 6).alias("control"), F.round(F.col("t") - F.col("c"), 6).alias("delta"), "n")


def benefit(samples: DataFrame, cost_names: tuple[str, ...], quality_names: tuple[str, ...]) -> DataFrame:
    """One row: kpis compared, saving (control less treatment of the first cost by name), quality_delta (of the first quality by name)."""
    c = compared(samples)
    first = lambda names, x: F.min_by(x, F.when(F.col("kpi_name").isin(*names), F.col("kpi_name")))
    saving = F.when(F.col("kpi_name").isin(*cost_names), -F.col("delta"))
    return c.agg(F.count(F.lit(1)).alias("kpis"), first(cost_names, saving).alias("saving"), first(quality_names, F.col("delta")).alias("quality_delta"))


def usage(events: DataFrame) -> DataFrame:
    """dimension, key, calls, tokens_in, tokens_out: totals and by client, scope and tool; blank keys are unknown.

    One pass: grouping sets over partly summed rows.
    """
    blank = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit("unknown")).otherwise(F.col(c).cast("string"))
    rows = events.select(*[blank(c).alias(c) for c in ("client_id", "scope", "tool")], "tokens_in", "tokens_out")
    sets = rows.groupingSets([["client_id"], ["scope"], ["tool"], []], "client_id", "scope", "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 3, "client").when(F.col("g") == 5, "scope").when(F.col("g") == 6, "tool").otherwise("total")
    return sets.select(dimension.alias("dimension"), F.coalesce("client_id", "scope", "tool", F.lit("")).alias("key"), "calls", "tokens_in", "tokens_out")


def inventory(files: DataFrame) -> DataFrame:
    """language, files, bytes, done, share of files in percent (2 decimals), from columns language, bytes, done."""
    s = files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum(F.col("done").cast("long")).alias("done"))
    total = max(1, files.count())
    return s.select("language", "files", "bytes", "done", F.round(100.0 * F.col("files") / total, 2).alias("percent"))


def categories(findings: DataFrame, known: dict[str, str]) -> DataFrame:
    """category, severity, findings for every known category (its severity), those without findings too."""
    own = findings.sparkSession.createDataFrame(list(known.items()), "category string, severity string")
    n = findings.groupBy("category").agg(F.count(F.lit(1)).alias("findings"))
    return F.broadcast(own).join(n, "category", "left").select("category", "severity", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))


def timeline(events: DataFrame, key_col: str, key) -> DataFrame:
    """The events of one key, oldest first, then by id."""
    return events.filter(F.col(key_col) == key).orderBy("ts", "event_id")


def trail(events: DataFrame, key_col: str) -> DataFrame:
    """key_col, events, first_ts, last_ts, kinds (distinct, sorted, joined by commas) of each key."""
    return events.groupBy(key_col).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


def compression(rows: DataFrame) -> DataFrame:
    """kind, calls, applied, skipped, saved, percent_saved of columns kind, before, after: null kind is all."""
    s = rows.groupingSets([["kind"], []], "kind").agg(F.count(F.lit(1)).alias("calls"), F.sum((F.col("after") < F.col("before")).cast("long")).alias("applied"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    return s.select("kind", "calls", "applied", (F.col("calls") - F.col("applied")).alias("skipped"), (F.col("before") - F.col("after")).alias("saved"), F.round(F.coalesce(100.0 * (F.col("before") - F.col("after")) / F.nullif("before", F.lit(0)), F.lit(0.0)), 2).alias("percent_saved"))


def questions(turns: DataFrame, question: F.Column | None = None, least: int = 1) -> DataFrame:
    """question, observations, evidence (distinct), curiosity of columns question, evidence, resolved.

    curiosity: observations, 1 if nothing resolved it, and half for each of up to three pieces of evidence.
    """
    s = turns.groupBy("question").agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("evidence").alias("evidence"), F.max(F.col("resolved").cast("int")).alias("resolved")).filter(F.col("observations") >= least)
    score = F.col("observations") + F.when(F.col("resolved") == 1, 0).otherwise(1) + F.least("evidence", F.lit(3)) * 0.5
    return s.select("question", "observations", "evidence", F.round(score, 3).alias("curiosity"))


def cochanged(changes: DataFrame, support: int = 2, mass: int = 200) -> DataFrame:
    """a, b, support: pairs a < b of files changed in one commit (columns commit, file), in support commits or more.

    Files of fewer than support commits are left out before pairing. With a support of two or more,
    the files of a commit of over mass files are not paired with each other: such commits only add
    to pairs that other commits made, and two of them to pairs that both hold.
    """
    own = changes.select("commit", "file").distinct()
    often = own.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support).select("file")
    kept = own.join(often, "file", "left_semi")
    paired = lambda rows, key: rows.withColumnRenamed("file", "a").join(rows.withColumnRenamed("file", "b"), key).filter("a < b")
    large = checkpointed(kept.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > mass).select("commit"))
    if support < 2 or not large.limit(1).count():
        return paired(kept, "commit").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= support)
    small = checkpointed(paired(kept.join(large, "commit", "left_anti"), "commit").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")))
    wide = kept.join(large, "commit", "left_semi")
    held = wide.groupBy("file").agg(F.array_sort(F.collect_set("commit")).alias("c"))  # mass commits are few
    twos = held.select("file", F.explode(F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("key"))
    both = small.select("a", "b").unionByName(paired(twos, "key").select("a", "b")).distinct()
    of = lambda side: held.select(F.col("file").alias(side), F.col("c").alias(f"c_{side}"))
    more = both.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.size(F.array_intersect("c_a", "c_b")).alias("n"))
    rows = small.join(more, ["a", "b"], "full")
    total = (F.coalesce("support", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long")
    return rows.select("a", "b", total.alias("support")).filter(F.col("support") >= support)


def trust(outcomes: DataFrame) -> DataFrame:
    """subject, failures, successes, action of columns subject, ok, revoked: revoked first, then demote at 3 failures, promote at 5 successes."""
    s = outcomes.groupBy("subject").agg(F.sum((~F.col("ok")).cast("long")).alias("failures"), F.sum(F.col("ok").cast("long")).alias("successes"), F.max("revoked").alias("revoked"))
    return s.select("subject", "failures", "successes", F.when(F.col("revoked"), "untrusted").when(F.col("failures") >= 3, "demote").when(F.col("successes") >= 5, "promote").otherwise("keep").alias("action"))


def hotspots(files: DataFrame, budget: int, least: int) -> DataFrame:
    """file, tokens, over_budget of columns file, text: a quarter of the characters; least tokens or more."""
    tokens = files.select("file", text.char_estimate(F.col("text")).cast("long").alias("tokens"))
    return tokens.filter(F.col("tokens") >= least).withColumn("over_budget", F.col("tokens") > budget)


def vocabulary(rows: DataFrame, col: str) -> DataFrame:
    return rows.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def rate_gate(events: DataFrame, per_window: int, seconds: int = 60, spans: int = 1000) -> DataFrame:
    """events with in_window (how many of their user began in the seconds up to them) and admitted (at most per_window).

    A user's events are counted span by span of spans windows, so that one with very many is no
    single task; each span also has the events of the seconds before it.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    width = seconds * 1_000_000
    placed = events.withColumn("__at", micros).withColumn("__span", F.floor(F.col("__at") / (width * spans)))
    before = placed.filter(F.col("__at") >= (F.col("__span") + 1) * (width * spans) - width).withColumn("__span", F.col("__span") + 1).withColumn("__own", F.lit(False))
    both = placed.withColumn("__own", F.lit(True)).unionByName(before)
    w = Window.partitionBy("user_id", "__span").orderBy("__at").rangeBetween(-width, Window.currentRow)
    counted = both.withColumn("in_window", F.count(F.lit(1)).over(w)).filter("__own").drop("__at", "__span", "__own")
    return counted.withColumn("admitted", F.col("in_window") <= per_window)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by order, without sorting groups."""
    s = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy(*key).agg(F.max(s).alias("s")).select("s.*").select(*rows.columns)


def page(rows: DataFrame, order: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """size + 1 rows (one more tells that there is a next page) by order descending, after the row with these values."""
    if after is not None:
        seek = F.lit(False)
        for i in range(len(order)):
            same = F.lit(True)
            for j in range(i):
                same = same & (F.col(order[j]) == F.lit(after[j]))
            seek = seek | (same & (F.col(order[i]) < F.lit(after[i])))
        rows = rows.filter(seek)
    return rows.orderBy(*[F.desc(c) for c in order]).limit(size + 1)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select(F.col("source").alias("kpi_name"), F.when(F.col("quality") == 1, "treatment").otherwise("control").alias("cohort"), F.col("n_chars").cast("double").alias("value"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users asked, by the first six words; resolved if the assistant's turn came next."""
    c = table(spark, sf_dir, "conversations")
    first = F.array_join(F.slice(F.split(text.question_key(F.col("text")), " "), 1, 6), " ")
    answered = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn")).distinct().withColumn("resolved", F.lit(True))
    asked = c.filter("role = 'user'").select("conv_id", "turn", first.alias("question")).join(answered, ["conv_id", "turn"], "left")
    return asked.select("question", F.col("conv_id").alias("evidence"), F.coalesce("resolved", F.lit(False)).alias("resolved"))


QUERIES = {
    "a01_cohorts": lambda spark, d: compared(_samples(spark, d)),
    "a02_benefit": lambda spark, d: benefit(_samples(spark, d), ("src3", "src5"), ("src1", "src2")),
    "a03_usage": lambda spark, d: usage(_events(spark, d).select(F.col("user_id").alias("client_id"), (F.col("user_id") % 5).alias("scope"), F.col("event_type").alias("tool"), F.floor("value").cast("long").alias("tokens_in"), F.col("k").alias("tokens_out"))),
    "a05_inventory": lambda spark, d: inventory(table(spark, d, "documents").select(F.col("lang").alias("language"), F.col("n_chars").alias("bytes"), (F.col("n_chars") > 1000).alias("done"))),
    "a10_categories": lambda spark, d: categories(table(spark, d, "events").select(F.col("event_type").alias("category")), {"error": "critical", "click": "info", "purchase": "low", "never": "high"}),
    "a16_timeline": lambda spark, d: timeline(_events(spark, d), "user_id", 7).select("event_id", "ts", "event_type"),
    "a16_trail": lambda spark, d: trail(_events(spark, d), "user_id"),
    "a17_compression": lambda spark, d: compression(table(spark, d, "documents").select(F.col("lang").alias("kind"), F.col("n_chars").alias("before"), F.least("n_chars", F.lit(2000)).alias("after"))),
    "a19_questions": lambda spark, d: questions(_turns(spark, d), least=2),
    "a21_cochange": lambda spark, d: cochanged(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))),
    "a23_trust": lambda spark, d: trust(_events(spark, d).select(F.col("user_id").alias("subject"), (F.col("event_type") != "error").alias("ok"), ((F.col("event_type") == "signup") & (F.col("k") == 3)).alias("revoked"))),
    "a24_hotspots": lambda spark, d: hotspots(table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"), 2000, 500),
    "a25_vocabulary": lambda spark, d: vocabulary(table(spark, d, "documents"), "source"),
    "e10_rate_gate": lambda spark, d: rate_gate(_events(spark, d), 2, 3600).select("event_id", "in_window", "admitted"),
    "w01_latest": lambda spark, d: latest(_events(spark, d).select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]),
    "e07_first_command": lambda spark, d: _events(spark, d).groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("replays")),
    "s14_page": lambda spark, d: page(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")), ["day", "o_orderkey"], 20, None),
    "f18_json_path": lambda spark, d: table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.missing.path"), F.get_json_object("props", "$.k")).cast("long").alias("k")),
    "f17_redacted": lambda spark, d: table(spark, d, "documents").filter(F.col("text").rlike(text.SECRET)).select("doc_id", F.sha2(text.redacted(F.col("text")), 256).alias("digest")),
    "j07_url_paths": lambda spark, d: table(spark, d, "pages").select("page_id", text.url_path(F.col("url")).alias("path")),
}

_E = "e as (select event_id, ts::timestamp as ts, user_id, event_type, value, (props->>'k')::bigint as k from events)"
_K = "k as (select source as kpi_name, case when quality = 1 then 'treatment' else 'control' end as cohort, n_chars::double as value from labels join documents using (doc_id)), c as (select kpi_name, avg(value) filter (cohort = 'treatment') as t, avg(value) filter (cohort = 'control') as c, count(*) as n from k group by 1 having t is not null and c is not null)"
ORACLE_SQL = {
    "a01_cohorts": f"with {_K} select kpi_name, round(t, 6) as treatment, round(c, 6) as control, round(t - c, 6) as delta, n from c",
    "a02_benefit": f"with {_K} select count(*) as kpis, round(arg_min(c - t, kpi_name) filter (kpi_name in ('src3', 'src5')), 6) as saving, round(arg_min(t - c, kpi_name) filter (kpi_name in ('src1', 'src2')), 6) as quality_delta from c",
    "a03_usage": f"with {_E}, u as (select user_id::varchar as client_id, (user_id % 5)::varchar as scope, event_type as tool, floor(value)::bigint as i, k as o from e) select case when g = 3 then 'client' when g = 5 then 'scope' when g = 6 then 'tool' else 'total' end as dimension, coalesce(client_id, scope, tool, '') as key, calls, tokens_in::bigint as tokens_in, tokens_out::bigint as tokens_out from (select client_id, scope, tool, grouping(client_id, scope, tool) as g, count(*) as calls, sum(i) as tokens_in, sum(o) as tokens_out from u group by grouping sets ((client_id), (scope), (tool), ()))",
    "a05_inventory": "select lang as language, count(*) as files, sum(n_chars)::bigint as bytes, count(*) filter (n_chars > 1000) as done, round(100.0::double * count(*) / (select count(*) from documents), 2) as percent from documents group by 1",
    "a10_categories": "select category, severity, (select count(*) from events where event_type = category) as findings from (values ('error', 'critical'), ('click', 'info'), ('purchase', 'low'), ('never', 'high')) t(category, severity)",
    "a16_timeline": f"with {_E} select event_id, ts, event_type from e where user_id = 7 order by ts, event_id",
    "a16_trail": f"with {_E} select user_id, count(*) as events, min(ts) as first_ts, max(ts) as last_ts, string_agg(distinct event_type, ',' order by event_type) as kinds from e group by 1",
    "a17_compression": "select lang as kind, count(*) as calls, count(*) filter (n_chars > 2000) as applied, count(*) filter (n_chars <= 2000) as skipped, sum(n_chars - least(n_chars, 2000))::bigint as saved, round(100.0::double * sum(n_chars - least(n_chars, 2000)) / sum(n_chars), 2) as percent_saved from documents group by grouping sets ((lang), ())",
    "a19_questions": "with a as (select distinct conv_id, turn - 1 as turn from conversations where role = 'assistant'), q as (select array_to_string((regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]*'))[1:6], ' ') as question, c.conv_id, a.turn is not null as resolved from conversations c left join a on a.conv_id = c.conv_id and a.turn = c.turn where role = 'user') select question, count(*) as observations, count(distinct conv_id) as evidence, round((count(*) + case when bool_or(resolved) then 0 else 1 end + least(count(distinct conv_id), 3) * 0.5)::double, 3) as curiosity from q group by 1 having count(*) >= 2",
    "a21_cochange": "with c as (select distinct l_orderkey as o, l_partkey as f from lineitem) select x.f as a, y.f as b, count(*) as support from c x join c y on x.o = y.o and x.f < y.f group by 1, 2 having count(*) >= 2",
    "a23_trust": f"with {_E}, s as (select user_id as subject, count(*) filter (event_type = 'error') as failures, count(*) filter (event_type <> 'error') as successes, bool_or(event_type = 'signup' and k = 3) as r from e group by 1) select subject, failures, successes, case when r then 'untrusted' when failures >= 3 then 'demote' when successes >= 5 then 'promote' else 'keep' end as action from s",
    "a24_hotspots": "select doc_id as file, ceil(length(text) / 4.0)::bigint as tokens, ceil(length(text) / 4.0) > 2000 as over_budget from documents where ceil(length(text) / 4.0) >= 500",
    "a25_vocabulary": "select source as value, count(*) as n from documents group by 1",
    "e10_rate_gate": f"with {_E}, w as (select event_id, count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row) as in_window from e) select event_id, in_window, in_window <= 2 as admitted from w",
    "w01_latest": f"with {_E} select user_id, event_type, ts, event_id from e qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "e07_first_command": f"with {_E} select user_id, event_type, arg_min(event_id, (ts, event_id)) as event_id, count(*) as replays from e group by 1, 2",
    "s14_page": "select o_orderkey, o_orderdate::date as day from orders order by 2 desc, 1 desc limit 21",
    "f18_json_path": "select event_id, (props->>'k')::bigint as k from events",
    "f17_redacted": r"select doc_id, sha256(regexp_replace(text, '(?i)((?:api[_-]?key|token|password|secret)\s*[:=]\s*)([^\s,;]+)', '\1[REDACTED]', 'g')) as digest from documents where regexp_matches(text, '(?i)((?:api[_-]?key|token|password|secret)\s*[:=]\s*)([^\s,;]+)')",
    "j07_url_paths": r"select page_id, case when p = '/' then p else rtrim(p, '/') end as path from (select page_id, regexp_replace(regexp_replace(url, '^[^/?#]*://[^/]*', ''), '[?#].*$', '') as p from pages)",
}
