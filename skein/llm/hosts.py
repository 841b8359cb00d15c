"""URL filter: rules by host and path first, then the reputation of hosts.

A host's share of good pages is estimated by empirical Bayes. At each level a beta-binomial prior
pulls a group's labelled outcomes towards the group above it: a suffix towards all pages, a
registered domain towards its suffix, a host towards its domain. How hard it pulls (the prior's
strength) comes from how far the groups of that level differ, by moments. A host is blocked when
the lower bound of its posterior is under a threshold: good pages can't be counted on there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import broadcast_if_small, checkpointed, fresh, table

#: host, path, verdict; a rule fits its host and all subdomains, and paths that start with its path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Suffixes of two labels under which names are registered; a parameter, as the public list changes. Every other last label is a suffix.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk",
    "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk",
    "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk",
)
#: Rule tables of at most so many rows are broadcast.
BROADCAST_RULES = 10_000
#: Hosts with their rules are broadcast if there are at most so many of both (64 characters of a host count as one more).
BROADCAST_HOSTS = 200_000
#: A host whose share of good pages is, by its posterior, under this is blocked.
LEAST_GOOD = 0.5
#: Standard deviations from the posterior's mean to its lower bound.
Z = 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or where there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def suffix(h: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The last two labels if they are one of suffixes, else the last label."""
    two = F.substring_index(h, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(h, ".", -1)) if suffixes else F.substring_index(h, ".", -1)


def domain(h: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it (the whole host where there is none)."""
    two = F.substring_index(h, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(h, ".", -3)).otherwise(two) if suffixes else two


def strength(counts: DataFrame) -> tuple[float, float]:
    """columns n, good of groups to the mean and the strength of their beta prior, by moments (0.5 and 1 without outcomes).

    Only these two numbers reach the driver.
    """
    s = counts.filter("n > 0").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("good").alias("good"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("gg"),
    ).first()
    if not s["n"]:
        return 0.5, 1.0
    p = s["good"] / s["n"]
    between = s["gg"] - s["n"] * p * p - (s["k"] - 1) * p * (1 - p)
    possible = p * (1 - p) * (s["n"] - s["nn"] / s["n"] - (s["k"] - 1))
    share = min(0.5, max(0.001, between / possible)) if s["k"] > 1 and possible > 0 else 0.5
    return p, 1 / share - 1


def reputations(outcomes: DataFrame) -> DataFrame:
    """columns host, good (0, 1 or null: not labelled) of pages to host, n, good, mean and bound of each host's posterior.

    A host without labelled pages has its domain's mean, and so on upwards; a null host counts as
    an empty one. Counts are summed before they are shuffled, and written once: all levels start
    from them.
    """
    counted = outcomes.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"))
    counted = checkpointed(counted.withColumns({"domain": domain(F.col("host")), "suffix": suffix(F.col("host"))}))
    by_domain = counted.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("good").alias("good"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    shrunk = lambda above, k: (F.col("good") + F.lit(k) * above) / (F.col("n") + F.lit(k))
    overall, k = strength(by_suffix)
    suffixes = by_suffix.select("suffix", shrunk(F.lit(overall), k).alias("suffix_mean"))
    domains = by_domain.join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_mean"), strength(by_domain)[1]).alias("domain_mean"))
    k = strength(counted)[1]
    hosts = counted.join(domains, "domain").withColumn("mean", shrunk(F.col("domain_mean"), k))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.lit(k + 1)))
    return hosts.select("host", "n", "good", "mean", (F.col("mean") - Z * sd).alias("bound"))


def fitting(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """column host (distinct) to host, rules: array<struct<n, rule, rule_path, verdict>> of those that fit the host, longest first.

    A host is looked up under its last labels, as many as the rule with most labels has: a host of
    very many labels costs no more than others. Of two rules of one length the greater string
    goes first. Hosts without rules are left out.
    """
    own = hosts.sparkSession.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")
    own = F.broadcast(own) if len(rules) <= BROADCAST_RULES else own
    most = max((h.count(".") + 1 for h, _, _ in rules), default=1)
    tails = F.array_distinct(F.array(*[F.substring_index("host", ".", -i) for i in range(1, most + 1)]))
    fits = hosts.select("host", F.explode(tails).alias("rule_host")).join(own, "rule_host")
    name = F.concat("rule_host", "rule_path")
    return fits.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length(name).alias("n"), name.alias("rule"), "rule_path", "verdict")), asc=False).alias("rules"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", least_good: float = LEAST_GOOD) -> DataFrame:
    """pages with host, path, rule, verdict and bound, a row for each row of pages.

    outcomes: columns host and good, a row for each labelled page. A rule's verdict goes first;
    else a page is allowed if the lower bound of its host's share of good pages is least_good or
    more. Hosts that outcomes lacks are shrunk all the way. Columns of these names are replaced.
    """
    kept = fresh(pages, "host", "path", "rule", "verdict", "bound", "rules")
    placed = kept.withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col))})
    hosts = placed.select("host").distinct()
    known = reputations(outcomes.select("host", "good").unionByName(hosts.withColumn("good", F.lit(None).cast("int"))))
    # One row for each host, and one join: Spark splits a host with many pages, or broadcasts the hosts if they are few.
    of_host = known.select("host", "bound").join(fitting(hosts, rules), "host", "left")
    best = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])), 0)
    own = F.when(F.col("bound") >= least_good, F.lit("allow")).otherwise(F.lit("block"))
    met = placed.join(broadcast_if_small(of_host, F.coalesce(F.size("rules"), F.lit(0)) + 1 + F.length("host") / 64, BROADCAST_HOSTS), "host", "left")
    return met.withColumns({"rule": best["rule"], "verdict": F.coalesce(best["verdict"], own)}).drop("rules")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, good of the pages whose document has a label: the number in a page's path is its document's id."""
    pages = table(spark, sf_dir, "pages").select("url")
    numbered = pages.select(host(F.col("url")).alias("host"), F.try_to_number(F.nullif(F.regexp_extract(path(F.col("url")), "/([0-9]{1,18})", 1), F.lit("")), F.lit("9" * 18)).cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("good"))
    return numbered.filter("doc_id is not null").join(labels, "doc_id").select("host", "good")


def op3_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict, and its host's bound."""
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), page_outcomes(spark, sf_dir), list(RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bound", 6).alias("bound"))


def _strength_sql(level: str) -> str:
    p = "(sum(good) / sum(n)::double)"
    between = f"(sum(good * good / n::double) - sum(n) * {p} * {p} - (count(*) - 1) * {p} * (1 - {p}))"
    possible = f"({p} * (1 - {p}) * (sum(n) - sum(n * n) / sum(n)::double - (count(*) - 1)))"
    return f"(select {p} as mean, 1 / case when count(*) > 1 and {possible} > 0 then least(0.5, greatest(0.001, {between} / {possible})) else 0.5 end - 1 as strength from {level} where n > 0)"


_TWO_SQL = f"array_to_string(string_split(host, '.')[-2:], '.') in {SUFFIXES}"
OP3_SQL = rf"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
l as (select doc_id, min(quality) as good from labels where quality in (0, 1) group by doc_id),
o as (select host, good from u left join l on doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})', 1), '') as bigint)),
h as (select host, count(good) as n, coalesce(sum(good), 0) as good, array_to_string(string_split(host, '.')[case when {_TWO_SQL} then -3 else -2 end:], '.') as domain, case when {_TWO_SQL} then array_to_string(string_split(host, '.')[-2:], '.') else string_split(host, '.')[-1] end as suffix from o group by host),
d as (select domain, any_value(suffix) as suffix, sum(n) as n, sum(good) as good from h group by domain),
s as (select suffix, sum(n) as n, sum(good) as good from d group by suffix),
s2 as (select suffix, (good + strength * mean) / (n + strength) as m from s, {_strength_sql('s')}),
d2 as (select domain, (good + strength * m) / (n + strength) as m from d join s2 using (suffix), {_strength_sql('d')}),
h2 as (select host, (good + strength * m) / (n + strength) as m, n + strength + 1 as w from h join d2 using (domain), {_strength_sql('h')}),
h3 as (select host, m - {Z} * sqrt(m * (1 - m) / w) as bound from h2),
r as (select * from (values {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}) as t(rh, rp, v)),
f as (select page_id, max(struct_pack(n := length(rh || rp), rule := rh || rp, v := v)) as best from u join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select page_id, host, path, best.rule as rule, coalesce(best.v, case when bound >= {LEAST_GOOD} then 'allow' else 'block' end) as verdict, round(bound, 6) as bound
from u left join f using (page_id) left join h3 using (host)
"""
