"""What to read for a question: symbols packed into a budget of characters, whole or by their signature only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.traverse import flow
from skein.sources.tables import GRAPH_SQL, edges, symbols

# Endings of names that make a family, how many members make one large, and characters by a project's number of files.
FAMILIES = ("Interceptor", "Handler", "Service", "Repository", "Controller", "Middleware")
LARGE_FAMILY = 3
BUDGETS = ((100, 18_000), (500, 24_000), (2000, 28_000))
MOST = 32_000
_FOLD = "at int, render string, note string"


def budget_for(files: int) -> int:
    """Characters that a pack may have in a project of so many files."""
    return next((chars for below, chars in BUDGETS if files < below), MOST)


def _fold(budget: int):
    """Rows (at, own, whole, on_spine, full) in order: what each is shown as, under the budget."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        used, out = 0, []
        for at, own, whole, on_spine, full in rows.sort_values("at")[["at", "own", "whole", "on_spine", "full"]].itertuples(index=False):
            render, note, size = ("full", None, whole) if full else ("signature", None, own)
            if full and whole > own and used + whole > budget:
                render, note, size = "signature", "budget_collapse", own
            if used + size <= budget or on_spine:
                used += size
                out.append((at, render, note))
        return pd.DataFrame(out, columns=["at", "render", "note"])

    return run


def pack(symbol_rows: DataFrame, seeds: DataFrame, spine: DataFrame, budget: int) -> DataFrame:
    """place (from 1), symbol_id, file_path, on_spine, render (full or signature), note, chars of symbols to read.

    symbol_rows: symbol_id, name, qualified_name, file_path, kind, signature, body; seeds: symbol_id,
    score; spine: node. The flow's spine comes first, then by score, path and name, file by file in
    the order of their first symbol. Symbols of a large family are alike: next to one on the spine
    the others have their signature only; else the first of each file has its body. What goes over
    the budget falls back to its signature, and is left out if that doesn't fit either; the spine is
    never left out.

    Only the fold over the budget is one task's, and what reaches it is bounded: of the symbols off
    the spine with a signature of c characters, the first budget / c + 1, as every one that is shown
    takes c and once one is left out so are all later ones; bodies stay behind, their lengths go.
    """
    on = spine.select(F.col("node").alias("symbol_id"), F.lit(True).alias("s")).distinct()
    family = F.coalesce(*[F.when(F.col("name").endswith(x) & (F.length("name") > len(x)), F.lit(x)) for x in FAMILIES], F.when((F.col("kind") == "method") & F.contains(F.col("qualified_name"), F.lit(".")), F.substring_index("qualified_name", ".", -1)))
    rows = symbol_rows.join(seeds.select("symbol_id", "score"), "symbol_id").join(on, "symbol_id", "left")
    own, whole = F.coalesce("signature", F.lit("")), F.concat_ws("\n", F.coalesce("signature", F.lit("")), F.coalesce("body", F.lit("")))
    rows = rows.select("symbol_id", "score", F.coalesce("s", F.lit(False)).alias("on_spine"), family.alias("family"), "file_path", "qualified_name", F.length(F.regexp_replace(own, r"^\s+|\s+$", "")).alias("own"), F.length(F.regexp_replace(whole, r"^\s+|\s+$", "")).alias("whole"))
    sizes = rows.filter("family is not null").groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.bool_or("on_spine").alias("spine_sibling"))
    rows = rows.join(sizes, "family", "left").withColumn("large", F.coalesce(F.col("members") >= LARGE_FAMILY, F.lit(False)))
    order = F.struct((~F.col("on_spine")).alias("a"), (-F.col("score")).alias("b"), F.col("file_path").alias("c"), F.col("qualified_name").alias("d"), F.col("symbol_id").alias("e"))
    rows = rows.withColumn("key", order)
    first = rows.groupBy("file_path").agg(F.min("key").alias("file_key"))
    of_family = Window.partitionBy("file_path", "family").orderBy("key")
    shown = F.col("on_spine") | ~F.col("large") | (~F.col("spine_sibling") & (F.col("nth") == 1))
    placed = rows.join(first, "file_path").withColumn("nth", F.row_number().over(of_family)).withColumn("full", shown)
    alike = Window.partitionBy("on_spine", "own").orderBy("file_key", "key")
    kept = placed.withColumn("n", F.row_number().over(alike)).filter(F.col("on_spine") | (F.col("n") <= F.floor(budget / F.greatest("own", F.lit(1))) + 1))
    at = kept.withColumn("at", F.row_number().over(Window.orderBy("file_key", "key")))
    folded = at.select("at", "own", "whole", "on_spine", "full").groupBy(F.lit(1).alias("all")).applyInPandas(_fold(budget), _FOLD)
    size = F.when(F.col("render") == "full", F.col("whole")).when(F.col("render") == "signature", F.col("own"))
    place = F.row_number().over(Window.orderBy("at"))  # bounded as the fold is
    return at.join(folded, "at").withColumn("place", place).select("place", "symbol_id", "file_path", "on_spine", "render", "note", size.alias("chars"))


def w06_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh symbol, customers as handlers by segment, under a small budget."""
    s, n = symbols(spark, sf_dir), F.substring("symbol_id", 9, 20).cast("long")
    s = s.withColumns({"name": F.when((F.col("kind") == "method") & (n % 2 == 0), F.concat("name", F.lit("Handler"))).otherwise(F.col("name")), "signature": F.concat(F.lit("def "), "name"), "body": F.repeat(F.col("qualified_name"), (n % 5).cast("int"))})
    seeds = s.filter(n % 7 == 0).select("symbol_id", (1.0 / (1 + n % 50)).alias("score"))
    return pack(s, seeds, flow(edges(spark, sf_dir), "sym:fx:s7").filter("hop <= 1"), 4000)


QUERIES = {"w06_explore_pack": w06_pack}
_SEEDS = "s0 as (select *, substr(symbol_id, 9)::bigint as n from fx_symbols)"
ORACLE_SQL = {
    "w06_explore_pack": f"""with recursive {GRAPH_SQL}, {_SEEDS}, sp as (select 'sym:fx:s7' as node union select target_id from fx_edges where source_id = 'sym:fx:s7' and rel_type = 'CALLS'),
s as (select symbol_id, file_path, qualified_name, 1.0::double / (1 + n % 50) as score, symbol_id in (select node from sp) as on_spine, case when kind = 'method' and n % 2 = 0 then 'Handler' when kind = 'method' then string_split(qualified_name, '.')[-1] end as family,
  length('def ' || name) as own, length(trim('def ' || name || chr(10) || repeat(qualified_name, (n % 5)::int), chr(10))) as whole from s0 where n % 7 = 0),
z as (select family, count(*) as members, bool_or(on_spine) as sib from s where family is not null group by 1),
r as (select s.*, coalesce(members >= 3, false) as large, sib from s left join z using (family)),
f as (select file_path, min((not on_spine, -score, file_path, qualified_name, symbol_id)) as fk from r group by 1),
o as (select r.*, row_number() over (partition by file_path, family order by (not on_spine, -score, file_path, qualified_name, symbol_id)) as nth, row_number() over (order by fk, (not on_spine, -score, file_path, qualified_name, symbol_id)) as pos from r join f using (file_path)),
p as (select *, on_spine or not large or (not sib and nth = 1) as full_ from o),
w as (select 0::bigint as pos, 0::bigint as used, null::varchar as render, null::varchar as note union all
  select p.pos, case when x.size + used > 4000 and not on_spine then used else used + x.size end, case when x.size + used > 4000 and not on_spine then null else x.render end, case when x.size + used > 4000 and not on_spine then 'omitted_over_budget' when x.col then 'budget_collapse' end
  from w join p on p.pos = w.pos + 1, lateral (select full_ and whole > own and used + whole > 4000 as col, case when full_ and not (whole > own and used + whole > 4000) then whole else own end as size, case when full_ and not (whole > own and used + whole > 4000) then 'full' else 'signature' end as render) x)
select (row_number() over (order by pos))::int as place, symbol_id, file_path, on_spine, render, note, (case render when 'full' then whole when 'signature' then own end)::int as chars from p join w using (pos) where render is not null""",
}
