"""Records that move through states: gates, approvals, tickets, memories, reviews, boards, stores with a lifetime, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text
from skein.sources.tables import table

# Statuses, how they map, and verbs of a memory's life.
BOARD = ("todo", "in_progress", "blocked", "done")
STATUS_MAP = {"o": "open", "f": "fulfilled"}
VERBS = {"promote": ("semantic", "active"), "demote": ("episodic", "candidate"), "archive": (None, "archived"), "restore": (None, "active")}
TTL = (60, 86_400)
APPROVAL_HOURS, CRITICAL_HOURS = 24, 4


def gates(rows: DataFrame, include_resolved: bool = False, since: str | None = None, until: str | None = None, **equal: str) -> DataFrame:
    """Approval gates by created_at: pending ones only, unless any filter of history is given."""
    if not (include_resolved or since or until or equal):
        rows = rows.filter("status = 'pending'")
    for k, v in equal.items():
        rows = rows.filter(F.col(k) == v)
    rows = rows if since is None else rows.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    rows = rows if until is None else rows.filter(F.col("created_at") <= F.lit(until).cast("timestamp_ntz"))
    return rows.orderBy("created_at", "id")


def needs_source(rows: DataFrame, floor: int = 3) -> DataFrame:
    """rows (rank, stale, tags) with escalate: an answer that is unsure, stale or about something risky wants the source read."""
    risky = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in ("auth", "billing", "security")]))
    return rows.withColumn("escalate", (F.col("rank") < floor) | F.col("stale") | risky)


def mapped_status(c: Column, mapping: dict[str, str], reject: bool = False, fallback: str | None = None) -> Column:
    """By the exact key, then the lower-case one, then itself if it is a value already; else null (reject), or fallback, or itself."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    other = F.lit(None) if reject else (c if fallback is None else F.lit(fallback))
    return F.coalesce(F.try_element_at(m, c), F.try_element_at(m, F.lower(c)), F.when(c.isin(*mapping.values()), c), other)


def problems(messages: DataFrame, required: tuple[str, ...], closed: dict[str, tuple[str, ...]], scope: dict[str, str]) -> DataFrame:
    """messages with problems: missing:field, unknown:field and scope:field, in that order, joined by commas."""
    lacks = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"missing:{c}")) for c in required]
    odd = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), F.lit(f"unknown:{c}")) for c, v in closed.items()]
    far = [F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(f"scope:{c}")) for c, v in scope.items()]
    return messages.withColumn("problems", F.array_join(F.array_compact(F.array(*lacks, *odd, *far)), ","))


def synced(updates: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """updates (version, expected, status, new_status, updated_at, accepted_at) with outcome and new_version: stale, unknown and illegal ones are rejected; the version rises only with a change."""
    outcome = (
        F.when(F.col("version") != F.col("expected"), "version_conflict").when(~F.col("new_status").isin(*known), "unknown_status").when(F.col("updated_at") < F.col("accepted_at"), "older_than_accepted")
        .when((F.col("status") == "closed") & (F.col("new_status") != "closed"), "illegal_reopen").when(F.col("status") == F.col("new_status"), "unchanged").otherwise("changed")
    )
    return updates.withColumn("outcome", outcome).withColumn("new_version", F.col("version") + (F.col("outcome") == "changed").cast("long"))


def due(approvals: DataFrame) -> DataFrame:
    """approvals (approver, role, owner, severity, created_at) with by (the first of the three that there is) and due_at: in 24 hours, or 4 if critical."""
    hours = F.when(F.col("severity") == "critical", CRITICAL_HOURS).otherwise(APPROVAL_HOURS)
    return approvals.withColumns({"by": F.coalesce("approver", "role", "owner"), "due_at": F.col("created_at") + F.make_dt_interval(hours=hours)})


def moved(items: DataFrame, verb: str, reason: str, allowed: tuple[str, ...] = ("active", "candidate", "stale")) -> DataFrame:
    """items (kind, state, version, tags) in an allowed state after a command: kind and state change, version rises, a tag says why; others stay out."""
    kind, state = VERBS[verb]
    slug = "-".join(sorted(set(reason.lower().split())))[:80] or "unspecified"
    rows = items.filter(F.col("state").isin(*allowed))
    return rows.withColumns({"kind": F.lit(kind) if kind else F.col("kind"), "state": F.lit(state), "version": F.col("version") + 1, "tags": F.array_sort(F.array_union("tags", F.array(F.lit(f"{verb}:{slug}"))))})


def reviewed(comments: DataFrame) -> DataFrame:
    """changeset, comments, status: changes_requested if a comment blocks."""
    s = comments.groupBy("changeset").agg(F.count(F.lit(1)).alias("comments"), F.bool_or("blocking").alias("b"))
    return s.select("changeset", "comments", F.when(F.col("b"), "changes_requested").otherwise("in_review").alias("status"))


def approved(changesets: DataFrame) -> DataFrame:
    """changesets (author, approver, state) with outcome: nobody approves their own; an open one walks through review to approved."""
    return changesets.withColumn("outcome", F.when(F.col("author").eqNullSafe(F.col("approver")), "self_approval").when(F.col("state").isin("draft", "open", "in_review"), "approved").otherwise("illegal"))


def board(tasks: DataFrame) -> DataFrame:
    """status, tasks for every status of the board, empty ones too."""
    own = F.broadcast(tasks.sparkSession.createDataFrame([(s,) for s in BOARD], "status string"))  # 4 rows
    return own.join(tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("tasks"))


def stored(entries: DataFrame, as_of: Column) -> DataFrame:
    """entries (created_at, ttl) that are alive at as_of; a lifetime is 60 seconds to a day."""
    seconds = F.least(F.greatest("ttl", F.lit(TTL[0])), F.lit(TTL[1]))
    return entries.filter(F.col("created_at") + F.make_dt_interval(secs=seconds) > as_of)


def latencies(calls: DataFrame) -> DataFrame:
    """model, calls, mean_latency (3 decimals), size (of the last call)."""
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("latency"), 3).alias("mean_latency"), F.max_by("size", F.struct("ts", "id")).alias("size"))


def connectors(rows: DataFrame, deliveries: DataFrame) -> DataFrame:
    """connector, ready, delivered, dead of connectors (connector, enabled, configured) and deliveries (connector, status)."""
    s = deliveries.groupBy("connector").agg(F.count(F.when(F.col("status") == "delivered", 1)).alias("delivered"), F.count(F.when(F.col("status") == "dead_letter", 1)).alias("dead"))
    return rows.join(s, "connector", "left").select("connector", (F.col("enabled") & F.col("configured")).alias("ready"), F.coalesce("delivered", F.lit(0)).alias("delivered"), F.coalesce("dead", F.lit(0)).alias("dead"))


def integrity(entries: DataFrame, required: tuple[str, ...], statuses: tuple[str, ...]) -> DataFrame:
    """id, problem: duplicate ids, missing keys and unknown statuses of catalogue entries."""
    twice = entries.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("duplicate_id").alias("problem"))
    checks = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"missing:{c}")) for c in required] + [F.when(~F.col("status").isin(*statuses), F.lit("unknown_status"))]
    return twice.unionByName(entries.select("id", F.explode(F.array_compact(F.array(*checks))).alias("problem")))


def assigned(tasks: DataFrame, workers: int) -> DataFrame:
    """tasks with batch: every worker gets a like share, by a hash of the id, the same each time."""
    return tasks.withColumn("batch", text.hash_bucket(F.col("id").cast("string"), workers))


def explained(evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    """evaluations with the title and mode of their rule; a rule that is gone leaves its id as title."""
    return evaluations.join(rules.select("rule_id", "title", "mode"), "rule_id", "left").withColumn("title", F.coalesce("title", "rule_id"))


def bundle_problems(bundle: DataFrame, candidates: DataFrame, budget: int) -> DataFrame:
    """problem, id of a context bundle (id, selected, reason, tokens) against all candidates (id): repeated, without a reason, not mentioned, over the budget."""
    twice = bundle.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate").alias("problem"), "id")
    bare = bundle.filter("not selected and (reason is null or trim(reason) = '')").select(F.lit("excluded_without_reason").alias("problem"), "id")
    absent = candidates.select("id").join(bundle.select("id").distinct(), "id", "left_anti").select(F.lit("omitted").alias("problem"), "id")
    over = bundle.filter("selected").agg(F.sum("tokens").alias("t")).filter(F.col("t") > budget).select(F.lit("budget_overflow").alias("problem"), F.lit(None).cast("long").alias("id"))
    return twice.unionByName(bare).unionByName(absent).unionByName(over)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))


def _k() -> Column:
    return F.col("id")


def _pick(words: tuple, by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (by % len(words) + 1).cast("int"))


STATES = ("open", "closed", "in_review", "odd")


def x06_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("id", (_k() % 3).alias("version"), F.lit(1).alias("expected"), _pick(STATES[:3], F.floor(_k() / 3)).alias("status"), _pick(STATES, F.floor(_k() / 5)).alias("new_status"), (_k() % 10).alias("updated_at"), F.lit(2).alias("accepted_at"))
    return synced(rows, STATES[:3]).select("id", "outcome", "new_version")


def r17_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).filter("id % 10 > 0")
    rows = o.select("id", (_k() % 4 == 0).alias("selected"), F.when(_k() % 7 > 0, "low").alias("reason"), F.lit(5).alias("tokens"))
    return bundle_problems(rows.unionByName(rows.filter("id % 13 = 0")), _orders(spark, sf_dir), 100)


QUERIES = {
    "f04_gates": lambda spark, d: gates(_orders(spark, d).select("id", F.when(F.col("s") == "O", "pending").otherwise("approved").alias("status"), F.col("at").alias("created_at"))).select("id"),
    "f04_gate_history": lambda spark, d: gates(_orders(spark, d).select("id", F.col("s").alias("status"), F.col("at").alias("created_at")), since="1996-01-01 00:00:00", until="1996-12-31 00:00:00", status="F").select("id"),
    "f16_needs_source": lambda spark, d: needs_source(_orders(spark, d).select("id", (_k() % 5).alias("rank"), (_k() % 11 == 0).alias("stale"), F.array(F.when(_k() % 7 == 0, "auth").otherwise("x")).alias("tags"))).select("id", "escalate"),
    "f19_statuses": lambda spark, d: _orders(spark, d).select("id", mapped_status(F.col("s"), STATUS_MAP, reject=True).alias("rejecting"), mapped_status(F.col("s"), STATUS_MAP, fallback="other").alias("status")),
    "f20_problems": lambda spark, d: problems(_orders(spark, d).select("id", F.when(_k() % 5 > 0, F.col("p")).alias("p"), "s", (_k() % 2).cast("string").alias("tenant")), ("p",), {"s": ("O", "F")}, {"tenant": "1"}).select("id", "problems"),
    "x06_synced": x06_synced,
    "x07_due": lambda spark, d: due(_orders(spark, d).select("id", F.when(_k() % 3 == 0, "a").alias("approver"), F.when(_k() % 2 == 0, "r").alias("role"), F.lit("o").alias("owner"), F.when(F.col("p").startswith("1"), "critical").otherwise("low").alias("severity"), F.col("at").alias("created_at"))).select("id", "by", "due_at"),
    "x08_moved": lambda spark, d: moved(_orders(spark, d).select("id", F.lit("episodic").alias("kind"), _pick(("active", "archived", "candidate"), _k()).alias("state"), F.lit(1).alias("version"), F.array(F.lit("z"), F.lit("b")).alias("tags")), "promote", "proven twice").select("id", "kind", "state", "version", F.array_join("tags", ",").alias("tags")),
    "t17_reviewed": lambda spark, d: reviewed(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("changeset"), (F.col("l_returnflag") == "R").alias("blocking"))),
    "x21_approved": lambda spark, d: approved(_orders(spark, d).select("id", (F.col("c") % 3).alias("author"), (_k() % 3).alias("approver"), _pick(("draft", "merged", "open"), _k()).alias("state"))).select("id", "outcome"),
    "a15_board": lambda spark, d: board(_orders(spark, d).select(_pick(("todo", "done", "in_progress"), _k()).alias("status"))),
    "t10_stored": lambda spark, d: stored(_orders(spark, d).select("id", F.col("at").alias("created_at"), (_k() * 100 % 100_000).alias("ttl")), F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")).select("id"),
    "a18_latencies": lambda spark, d: latencies(table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("latency"), F.col("user_id").alias("size"), "ts", F.col("event_id").alias("id"))),
    "x09_connectors": lambda spark, d: connectors(table(spark, d, "supplier").select(F.col("s_suppkey").alias("connector"), (F.col("s_suppkey") % 2 == 0).alias("enabled"), (F.col("s_acctbal") > 0).alias("configured")), table(spark, d, "lineitem").select(F.col("l_suppkey").alias("connector"), F.when(F.col("l_returnflag") == "R", "dead_letter").when(F.col("l_returnflag") == "A", "delivered").otherwise("queued").alias("status"))),
    "x23_integrity": lambda spark, d: integrity(_orders(spark, d).select((_k() % 5000).alias("id"), F.when(_k() % 9 > 0, F.col("p")).alias("title"), F.col("s").alias("status")).distinct(), ("title",), ("O", "F")).distinct(),
    "t19_assigned": lambda spark, d: assigned(_orders(spark, d), 7).groupBy("batch").agg(F.count(F.lit(1)).alias("tasks"), F.min("id").alias("first")),
    "x19_explained": lambda spark, d: explained(_orders(spark, d).select("id", F.col("p").alias("rule_id")), spark.createDataFrame([("1-URGENT", "Urgent", "manual"), ("2-HIGH", "High", "hybrid")], "rule_id string, title string, mode string")).select("id", "title", "mode"),
    "r17_bundle": r17_bundle,
    "x02_cleared": lambda spark, d: _cleared(spark, d),
    "f15_authorised": lambda spark, d: _authorised(spark, d),
}


def _cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators.rules import cleared

    return cleared(_orders(spark, sf_dir).select("id", _pick(("public", "internal", "confidential", "restricted", "odd"), _k()).alias("sensitivity"), _pick(("internal", "restricted", "odd"), F.floor(_k() / 5)).alias("clearance"), F.col("p").alias("body"))).select("id", "body")


def _authorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators.rules import authorised

    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_custkey").alias("position"), (F.col("c_custkey") % 4 > 0).alias("active"), F.array(F.when(F.col("c_custkey") % 5 == 0, "admin").otherwise("user")).alias("roles"), F.array(F.when(F.col("c_custkey") % 3 == 0, "read").otherwise("write:F")).alias("permissions"))
    return authorised(_orders(spark, sf_dir).select(_k().alias("request_id"), F.col("c").alias("subject"), F.when(_k() % 2 == 0, "read").otherwise("write").alias("action"), F.col("s").alias("resource")), people)


_O = "o as (select o_orderkey as id, o_custkey as c, o_orderstatus as s, o_orderpriority as p, o_orderdate::timestamp as made_at from orders)"
ORACLE_SQL = {
    "f04_gates": f"with {_O} select id from o where s = 'O' order by made_at, id",
    "f04_gate_history": f"with {_O} select id from o where s = 'F' and made_at between timestamp '1996-01-01' and timestamp '1996-12-31'",
    "f16_needs_source": f"with {_O} select id, id % 5 < 3 or id % 11 = 0 or id % 7 = 0 as escalate from o",
    "f19_statuses": f"with {_O}, m as (select id, case lower(s) when 'o' then 'open' when 'f' then 'fulfilled' end as x from o) select id, x as rejecting, coalesce(x, 'other') as status from m",
    "f20_problems": f"with {_O} select id, array_to_string(list_filter([case when id % 5 = 0 then 'missing:p' end, case when s not in ('O', 'F') then 'unknown:s' end, case when id % 2 <> 1 then 'scope:tenant' end], lambda x: x is not null), ',') as problems from o",
    "x06_synced": f"with {_O}, u as (select id, id % 3 as v, ['open', 'closed', 'in_review'][(id // 3) % 3 + 1] as a, ['open', 'closed', 'in_review', 'odd'][(id // 5) % 4 + 1] as b, id % 10 as t from o), r as (select id, v, case when v <> 1 then 'version_conflict' when b = 'odd' then 'unknown_status' when t < 2 then 'older_than_accepted' when a = 'closed' and b <> 'closed' then 'illegal_reopen' when a = b then 'unchanged' else 'changed' end as outcome from u) select id, outcome, v + (outcome = 'changed')::int as new_version from r",
    "x07_due": f"with {_O} select id, case when id % 3 = 0 then 'a' when id % 2 = 0 then 'r' else 'o' end as by, made_at + case when p like '1%' then interval 4 hours else interval 24 hours end as due_at from o",
    "x08_moved": f"with {_O} select id, 'semantic' as kind, 'active' as state, 2 as version, 'b,promote:proven-twice,z' as tags from o where id % 3 <> 1",
    "t17_reviewed": "select l_orderkey as changeset, count(*) as comments, case when bool_or(l_returnflag = 'R') then 'changes_requested' else 'in_review' end as status from lineitem group by 1",
    "x21_approved": f"with {_O} select id, case when c % 3 = id % 3 then 'self_approval' when id % 3 <> 1 then 'approved' else 'illegal' end as outcome from o",
    "a15_board": f"with {_O}, t as (select ['todo', 'done', 'in_progress'][id % 3 + 1] as s from o) select status, (select count(*) from t where s = status) as tasks from (values ('todo'), ('in_progress'), ('blocked'), ('done')) v(status)",
    "t10_stored": f"with {_O} select id from o where made_at + to_seconds(least(greatest(id * 100 % 100000, 60), 86400)) > timestamp '1996-06-01'",
    "a18_latencies": "select event_type as model, count(*) as calls, round(avg(value), 3) as mean_latency, arg_max(user_id, (ts, event_id)) as size from events group by 1",
    "x09_connectors": "select s_suppkey as connector, s_suppkey % 2 = 0 and s_acctbal > 0 as ready, (select count(*) from lineitem where l_suppkey = s_suppkey and l_returnflag = 'A') as delivered, (select count(*) from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R') as dead from supplier",
    "t19_assigned": f"with {_O} select (('0x' || sha256(id::varchar)[1:16])::ubigint % 7)::int as batch, count(*) as tasks, min(id) as first from o group by 1",
    "x23_integrity": f"with {_O}, e as (select distinct id % 5000 as id, case when id % 9 > 0 then p end as title, s from o) select id, 'duplicate_id' as problem from e group by 1 having count(*) > 1 union select id, 'missing:title' from e where title is null union select id, 'unknown_status' from e where s not in ('O', 'F')",
    "x19_explained": f"with {_O} select id, case p when '1-URGENT' then 'Urgent' when '2-HIGH' then 'High' else p end as title, case p when '1-URGENT' then 'manual' when '2-HIGH' then 'hybrid' end as mode from o",
    "r17_bundle": f"with {_O} select 'duplicate' as problem, id from o where id % 10 > 0 and id % 13 = 0 union all select 'excluded_without_reason', id from o where id % 10 > 0 and id % 4 > 0 and id % 7 = 0 union all select 'excluded_without_reason', id from o where id % 10 > 0 and id % 4 > 0 and id % 7 = 0 and id % 13 = 0 union all select 'omitted', id from o where id % 10 = 0 union all select 'budget_overflow', null from o where id % 4 = 0 and id % 10 > 0 having count(*) > 20",
    "x02_cleared": f"with {_O}, r as (select id, p, [1, 2, 3, 4, 5][id % 5 + 1] as s, [2, 4, 0][(id // 5) % 3 + 1] as c from o) select id, case when s > c then '[REDACTED]' else p end as body from r",
    "f15_authorised": f"with {_O} select id as request_id, coalesce(c % 4 > 0 and (c % 5 = 0 or (c % 3 = 0 and id % 2 = 0) or (c % 3 > 0 and id % 2 = 1 and s = 'F')), false) as allowed from o",
}
