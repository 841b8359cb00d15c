"""Rules over subjects: which apply, their verdicts, anomalies, impact and routing, approvals, health, state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text
from skein.sources.tables import table

# Domains and tags with a meaning of their own, and what a tag's change touches.
SENSITIVE = ("revenue", "security", "compliance", "production", "auth", "billing")
TRIGGERS = ("api", "schema", "contract", "migration", "route")
IMPACTS = (
    ("api", "frontend_clients", "depends_on", 0.9), ("api", "mobile_clients", "depends_on", 0.85), ("api", "api_docs", "explains", 0.8), ("api", "contract_tests", "implements", 0.88),
    ("schema", "dashboards", "depends_on", 0.84), ("schema", "migration_verification", "implements", 0.9), ("schema", "data_docs", "explains", 0.75),
)
VERDICT_RANK = {"block": 4, "escalate": 3, "warn": 2, "allow": 1}
LEAST_ROUTED = 0.8
TRANSITIONS = (
    ("draft", "open"), ("open", "in_review"), ("in_review", "approved"), ("in_review", "changes_requested"), ("changes_requested", "in_review"), ("approved", "merged"), ("open", "closed"), ("in_review", "closed"),
)


def _any(a: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(a, F.array(*[F.lit(w) for w in words]))


def applicable(rules: DataFrame, subjects: DataFrame) -> DataFrame:
    """subject and rule columns of each pair that shares a tag, or whose domain is one of the subject's tags.

    rules: rule_id, domain, match_tags; subjects: subject_id, tags. An equi-join on single tags, and
    pairs once: subjects and rules meet only where they share one.
    """
    by_tag = rules.withColumn("tag", F.explode(F.array_distinct(F.concat("match_tags", F.array("domain")))))
    of_subject = subjects.select("subject_id", F.explode(F.array_distinct("tags")).alias("tag"))
    pairs = of_subject.join(by_tag.select("rule_id", "tag"), "tag").select("subject_id", "rule_id").distinct()
    return pairs.join(rules, "rule_id").join(subjects, "subject_id")


def verdicts(pairs: DataFrame) -> DataFrame:
    """pairs with verdict and confidence: secrets block, sensitive changes without a task block, tags of contracts warn, else allow.

    Columns: tags, domain, has_secret, has_task, severity, mode. In semantic modes a confidence
    under 0.7 on a severe rule escalates.
    """
    sensitive = _any(F.col("tags"), SENSITIVE) | F.col("domain").isin(*SENSITIVE)
    verdict = F.when(F.col("has_secret"), "block").when(sensitive & ~F.col("has_task"), "block").when(_any(F.col("tags"), TRIGGERS), "warn").otherwise("allow")
    sure = F.when(F.col("has_secret"), 1.0).when(sensitive & ~F.col("has_task"), 0.98).otherwise(0.9)
    unsure = F.col("mode").isin("semantic", "hybrid") & (F.col("judged_confidence") < 0.7) & F.col("severity").isin("high", "critical")
    return pairs.withColumns({"verdict": F.when(unsure & (verdict != "block"), "escalate").otherwise(verdict), "confidence": F.when(F.col("mode").isin("semantic", "hybrid") & (verdict != "block"), F.col("judged_confidence")).otherwise(sure)})


def final_verdicts(judged: DataFrame) -> DataFrame:
    """subject_id, verdict (the gravest), blocked."""
    rank = F.lit(0)
    for k, v in VERDICT_RANK.items():
        rank = F.when(F.col("verdict") == k, F.lit(v)).otherwise(rank)
    worst = judged.groupBy("subject_id").agg(F.max(F.struct(rank.alias("r"), "verdict")).alias("w"))
    return worst.select("subject_id", F.col("w.verdict").alias("verdict"), F.col("w.verdict").isin("block", "escalate").alias("blocked"))


def precedence(pairs: DataFrame, states: tuple[str, ...] = ("active",)) -> DataFrame:
    """Rules in one of the states with position among a subject's: precedence descending, then created_at, then id."""
    own = pairs.filter(F.col("state").isin(*states))
    return own.withColumn("position", F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("precedence"), "created_at", "rule_id")))


def anomalies(subjects: DataFrame) -> DataFrame:
    """subject_id, signal, score of columns paths (a count), tags, has_task: eight paths or more are many; a sensitive change wants a task."""
    many = F.when(F.col("paths") >= 8, F.struct(F.lit("large_change").alias("signal"), F.round(F.least(F.lit(1.0), F.col("paths") / 20.0), 4).alias("score")))
    bare = F.when(_any(F.col("tags"), SENSITIVE) & ~F.col("has_task"), F.struct(F.lit("sensitive_without_task").alias("signal"), F.lit(0.8).alias("score")))
    return subjects.select("subject_id", F.explode(F.array_compact(F.array(many, bare))).alias("s")).select("subject_id", "s.*")


def impacts(subjects: DataFrame) -> DataFrame:
    """subject_id, entity, relation, confidence, routed: what a subject's tags touch; at 0.8 or above a task is routed. Once for each entity, with the least confidence."""
    t = F.broadcast(subjects.sparkSession.createDataFrame(list(IMPACTS), "tag string, entity string, relation string, confidence double"))  # 7 rows
    rows = subjects.select("subject_id", F.explode(F.array_distinct("tags")).alias("tag")).join(t, "tag")
    s = rows.groupBy("subject_id", "entity").agg(F.min("relation").alias("relation"), F.min("confidence").alias("confidence"))
    return s.withColumn("routed", F.col("confidence") >= LEAST_ROUTED)


def routes(approvals: DataFrame) -> DataFrame:
    """approvals with route, of columns hard_block, mode (manual, auto or system), denied, allowed, risk, max_risk."""
    route = F.when(F.col("hard_block") | (F.col("mode") == "manual"), "human").when((F.col("mode") == "auto") & ~F.col("denied"), "auto").when((F.col("mode") == "system") & F.col("allowed") & (F.col("risk") <= F.col("max_risk")), "auto").otherwise("human")
    return approvals.withColumn("route", route)


def health(judged: DataFrame, approvals: DataFrame) -> DataFrame:
    """One row of counts: evaluations, blocked or escalated, warned, allowed, shadowed, approvals, requested, approved."""
    j = judged.agg(
        F.count(F.lit(1)).alias("evaluations"), F.count(F.when(F.col("verdict").isin("block", "escalate"), 1)).alias("blocked_or_escalated"), F.count(F.when(F.col("verdict") == "warn", 1)).alias("warned"),
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("mode") == "semantic", 1)).alias("semantic"),
    )
    a = approvals.agg(F.count(F.lit(1)).alias("approvals"), F.count(F.when(F.col("status") == "requested", 1)).alias("requested"), F.count(F.when(F.col("status") == "approved", 1)).alias("approved"))
    return j.withColumn("one", F.lit(1)).join(a.withColumn("one", F.lit(1)), "one").drop("one")


def transitions(moves: DataFrame, allowed: tuple[tuple[str, str], ...] = TRANSITIONS) -> DataFrame:
    """moves (id, from_state, to_state, version, expected_version) with outcome: ok, illegal, or conflict where the version isn't the one expected."""
    legal = F.concat_ws(">", "from_state", "to_state").isin(*[f"{a}>{b}" for a, b in allowed])
    return moves.withColumn("outcome", F.when(F.col("version") != F.col("expected_version"), "conflict").when(legal, "ok").otherwise("illegal"))


def delivered(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """event_id, subscription_id of active, authorised subscriptions to an event's channel or to all.

    subscriptions: subscription_id, channel, intents, domains (arrays; empty: any), active,
    authorised; events: event_id, channel, intent, domain. What is not restricted has the key *; an
    event looks up the eight combinations of its own keys and *, so that it meets only
    subscriptions that fit.
    """
    any_ = F.array(F.lit("*"))
    listed = lambda c: F.explode(F.when(F.size(c) == 0, any_).otherwise(F.array_distinct(c)))
    own = subscriptions.filter("active and authorised").select("subscription_id", "channel", listed("intents").alias("intent"), "domains").select("subscription_id", "channel", "intent", listed("domains").alias("domain"))
    each = lambda c: F.explode(F.array_distinct(F.array(F.col(c), F.lit("*"))))
    keys = events.select("event_id", each("channel").alias("channel"), "intent", "domain").select("event_id", "channel", each("intent").alias("intent"), "domain").select("event_id", "channel", "intent", each("domain").alias("domain"))
    return keys.join(own, ["channel", "intent", "domain"]).select("event_id", "subscription_id").distinct()


def authorised(requests: DataFrame, principals: DataFrame) -> DataFrame:
    """request_id, allowed: the first active row of a request's subject decides, by role admin, permission action, or action:resource."""
    first = principals.filter("active").groupBy("subject").agg(F.min_by(F.struct("roles", "permissions"), "position").alias("p"))
    rows = requests.join(first, "subject", "left")
    may = F.array_contains("p.roles", "admin") | F.array_contains("p.permissions", F.col("action")) | F.array_contains("p.permissions", F.concat_ws(":", "action", "resource"))
    return rows.select("request_id", F.coalesce(may, F.lit(False)).alias("allowed"))


def cleared(items: DataFrame, levels: tuple[str, ...] = ("public", "internal", "confidential", "restricted")) -> DataFrame:
    """items with body redacted where sensitivity ranks above clearance; unknown sensitivities rank highest, unknown clearances lowest."""
    rank = lambda c, other: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(c)), F.lit(0)), F.lit(other))
    return items.withColumn("body", F.when(rank("sensitivity", len(levels) + 1) > rank("clearance", 0), F.lit("[REDACTED]")).otherwise(F.col("body")))


_RULES = [
    ("r1", "security", ["error"], "high", "deterministic", 0.9, 5, "2024-01-01", "active"), ("r2", "growth", ["signup", "purchase"], "low", "deterministic", 0.9, 9, "2024-01-03", "active"),
    ("r3", "api", ["click"], "critical", "semantic", 0.6, 5, "2024-01-02", "active"), ("r4", "none", ["never"], "low", "manual", 0.9, 1, "2024-01-02", "active"), ("r5", "api", ["view"], "low", "hybrid", 0.6, 7, "2024-01-05", "shadow"),
]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, "rule_id string, domain string, match_tags array<string>, severity string, mode string, judged_confidence double, precedence int, created_at string, state string")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts").cast("date").cast("string"))
    s = e.groupBy(F.concat_ws("-", F.col("user_id").cast("string"), F.col("day")).alias("subject_id"), F.col("user_id")).agg(F.array_sort(F.collect_set("event_type")).alias("t"), F.count(F.lit(1)).alias("paths"), F.max("event_id").alias("last"))
    extra = F.when(F.col("last") % 5 == 0, F.array(F.lit("api"))).when(F.col("last") % 5 == 1, F.array(F.lit("schema"), F.lit("auth"))).otherwise(F.array().cast("array<string>"))
    return s.select("subject_id", F.concat("t", extra).alias("tags"), "paths", (F.col("last") % 2 == 0).alias("has_task"), (F.col("last") % 17 == 0).alias("has_secret"), "last")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(applicable(_rules(spark), _subjects(spark, sf_dir)))


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda words, by: F.element_at(F.array(*[F.lit(w) for w in words]), (by % len(words) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), pick(["requested", "approved", "rejected"], k).alias("status"), (k % 7 == 0).alias("hard_block"), pick(["manual", "auto", "system", "auto"], F.floor(k / 2)).alias("mode"), (k % 5 == 0).alias("denied"), (k % 3 > 0).alias("allowed"), (k % 10).alias("risk"), F.lit(6).alias("max_risk"))


def x16_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ("draft", "open", "in_review", "approved", "merged", "closed")
    pick = lambda by: F.element_at(F.array(*[F.lit(w) for w in states]), (by % len(states) + 1).cast("int"))
    k = F.col("o_orderkey")
    moves = table(spark, sf_dir, "orders").select(k.alias("id"), pick(k).alias("from_state"), pick(F.floor(k / 6)).alias("to_state"), (k % 4).alias("version"), F.lit(1).alias("expected_version"))
    return transitions(moves).select("id", "outcome")


def j18_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = [
        ("s1", "error", [], [], True, True), ("s2", "*", ["ops"], [], True, True), ("s3", "click", [], ["d1"], True, True), ("s4", "view", [], [], False, True), ("s5", "view", [], [], True, False), ("s6", "*", [], ["d0"], True, True),
    ]
    own = spark.createDataFrame(subs, "subscription_id string, channel string, intents array<string>, domains array<string>, active boolean, authorised boolean")
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("channel"), F.when(F.col("event_id") % 3 == 0, "ops").otherwise("biz").alias("intent"), F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("domain"))
    return delivered(e, own)


QUERIES = {
    "t11_applicable": lambda spark, d: applicable(_rules(spark), _subjects(spark, d)).select("subject_id", "rule_id"),
    "t12_verdicts": lambda spark, d: _judged(spark, d).select("subject_id", "rule_id", "verdict", "confidence"),
    "t12_final": lambda spark, d: final_verdicts(_judged(spark, d)),
    "w02_precedence": lambda spark, d: precedence(applicable(_rules(spark), _subjects(spark, d))).select("subject_id", "rule_id", "position"),
    "t13_anomalies": lambda spark, d: anomalies(_subjects(spark, d)),
    "t14_impacts": lambda spark, d: impacts(_subjects(spark, d)),
    "t15_routes": lambda spark, d: routes(_approvals(spark, d).filter("status = 'requested'")).select("id", "route"),
    "a12_health": lambda spark, d: health(_judged(spark, d), _approvals(spark, d)),
    "t16_transitions": x16_transitions,
    "j18_delivered": j18_delivered,
}

_S = """x as (select user_id || '-' || ts::date as subject_id, list_sort(list(distinct event_type)) as t, count(*) as paths, max(event_id) as last from events group by user_id, ts::date),
s as (select subject_id, t || case when last % 5 = 0 then ['api'] when last % 5 = 1 then ['schema', 'auth'] else [] end as tags, paths, last % 2 = 0 as has_task, last % 17 = 0 as has_secret from x),
r as (select * from (values ('r1', 'security', ['error'], 'high', 'deterministic', 0.9, 5, '2024-01-01', 'active'), ('r2', 'growth', ['signup', 'purchase'], 'low', 'deterministic', 0.9, 9, '2024-01-03', 'active'), ('r3', 'api', ['click'], 'critical', 'semantic', 0.6, 5, '2024-01-02', 'active'), ('r4', 'none', ['never'], 'low', 'manual', 0.9, 1, '2024-01-02', 'active'), ('r5', 'api', ['view'], 'low', 'hybrid', 0.6, 7, '2024-01-05', 'shadow')) t(rule_id, domain, match_tags, severity, mode, jc, precedence, created_at, state)),
p as (select * from s join r on list_has_any(tags, match_tags || [domain])),
v0 as (select *, list_has_any(tags, ['revenue', 'security', 'compliance', 'production', 'auth', 'billing']) or domain in ('revenue', 'security', 'compliance', 'production', 'auth', 'billing') as sensitive from p),
v1 as (select *, case when has_secret then 'block' when sensitive and not has_task then 'block' when list_has_any(tags, ['api', 'schema', 'contract', 'migration', 'route']) then 'warn' else 'allow' end as v from v0),
v as (select *, case when v <> 'block' and mode in ('semantic', 'hybrid') and jc < 0.7 and severity in ('high', 'critical') then 'escalate' else v end as verdict, (case when v <> 'block' and mode in ('semantic', 'hybrid') then jc when has_secret then 1.0 when v = 'block' then 0.98 else 0.9 end)::double as confidence from v1)"""
_A = "a as (select o_orderkey as id, ['requested', 'approved', 'rejected'][o_orderkey % 3 + 1] as status, ['manual', 'auto', 'system', 'auto'][(o_orderkey // 2) % 4 + 1] as mode, o_orderkey as k from orders)"
ORACLE_SQL = {
    "t11_applicable": f"with {_S} select subject_id, rule_id from p",
    "t12_verdicts": f"with {_S} select subject_id, rule_id, verdict, confidence from v",
    "t12_final": f"with {_S} select subject_id, arg_max(verdict, case verdict when 'block' then 4 when 'escalate' then 3 when 'warn' then 2 else 1 end) as verdict, bool_or(verdict in ('block', 'escalate')) as blocked from v group by 1",
    "w02_precedence": f"with {_S} select subject_id, rule_id, (row_number() over (partition by subject_id order by precedence desc, created_at, rule_id))::int as position from p where state = 'active'",
    "t13_anomalies": f"with {_S} select subject_id, 'large_change' as signal, round(least(1, paths / 20.0::double), 4) as score from s where paths >= 8 union all select subject_id, 'sensitive_without_task', 0.8::double from s where list_contains(tags, 'auth') and not has_task",
    "t14_impacts": f"with {_S}, i as (select * from (values {', '.join(map(str, IMPACTS))}) t(tag, entity, relation, confidence)) select subject_id, entity, relation, confidence::double as confidence, confidence >= 0.8 as routed from s join i on list_contains(tags, tag)",
    "t15_routes": f"with {_A} select id, case when k % 7 = 0 or mode = 'manual' then 'human' when mode = 'auto' and k % 5 <> 0 then 'auto' when mode = 'system' and k % 3 > 0 and k % 10 <= 6 then 'auto' else 'human' end as route from a where status = 'requested'",
    "a12_health": f"with {_S}, {_A} select count(*) as evaluations, count(*) filter (verdict in ('block', 'escalate')) as blocked_or_escalated, count(*) filter (verdict = 'warn') as warned, count(*) filter (verdict = 'allow') as allowed, count(*) filter (mode = 'semantic') as semantic, (select count(*) from a) as approvals, (select count(*) from a where status = 'requested') as requested, (select count(*) from a where status = 'approved') as approved from v",
    "t16_transitions": f"with m as (select o_orderkey as id, ['draft', 'open', 'in_review', 'approved', 'merged', 'closed'][o_orderkey % 6 + 1] || '>' || ['draft', 'open', 'in_review', 'approved', 'merged', 'closed'][(o_orderkey // 6) % 6 + 1] as step, o_orderkey % 4 as version from orders) select id, case when version <> 1 then 'conflict' when step in ({', '.join(repr(f'{a}>{b}') for a, b in TRANSITIONS)}) then 'ok' else 'illegal' end as outcome from m",
    "j18_delivered": "with e as (select event_id, event_type as c, event_id % 3 = 0 as ops, user_id % 4 as d from events) select event_id, 's1' as subscription_id from e where c = 'error' union all select event_id, 's2' from e where ops union all select event_id, 's3' from e where c = 'click' and d = 1 union all select event_id, 's6' from e where d = 0",
}
