"""Lexical, vector and rank-fused retrieval, and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.lineage import broadcast_if_small, checkpointed
from skein.sources.tables import GRAPH_SQL, symbols, table

K1, B = 1.5, 0.75
RRF_K = 60
#: Queries are broadcast if they have at most so many different words; else their words meet the documents' in a shuffle.
QUERY_WORDS = 100_000
# Weights of a symbol's fields in full-text search, words of a query that count, and the length from which a word may differ by one letter.
FIELD_WEIGHTS = {"name": 1.0, "qualified_name": 1.0, "signature": 0.4, "file_path": 0.4, "documentation": 0.2}
QUERY_TOKENS = 24
FUZZY_LENGTH = 5


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, term, tf, length of each document and word in it."""
    words = docs.select(id_col, text.words(F.col(text_col)).alias("w"))
    terms = words.select(id_col, F.size("w").alias("length"), F.explode("w").alias("term"))
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25_lists(docs: DataFrame, queries: dict[str, str], id_col: str = "doc_id", text_col: str = "text", digits: int = 6) -> DataFrame:
    """list, id_col, score of the documents that have words of the queries (by the list's name), by Okapi BM25.

    A word that the query repeats counts each time. Lengths and document counts are of all
    documents. Documents are read and cut into words once, for all queries: of each document a row
    with its length goes on, and one for each word that a query has, summed before the shuffle.
    """
    spark = docs.sparkSession
    asked = spark.createDataFrame(list(queries.items()), "list string, q string").select("list", F.explode(text.words(F.col("q"))).alias("term")).groupBy("list", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = checkpointed(asked)
    wanted = broadcast_if_small(asked.select("term", F.lit(True).alias("wanted")).distinct(), QUERY_WORDS)
    words = docs.select(id_col, text.words(F.col(text_col)).alias("w"))
    terms = words.select(id_col, F.size("w").alias("length"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("term"))
    hits = terms.join(wanted, "term", "left").filter("term is null or wanted")
    tf = checkpointed(hits.groupBy(id_col, "term", "length").agg(F.count(F.lit(1)).alias("tf")))
    n, mean = tf.filter("term is null").agg(F.sum("tf"), F.sum(F.col("length") * F.col("tf")) / F.sum("tf")).first()
    if not n or not mean:
        return docs.limit(0).select(F.lit("").alias("list"), id_col, F.lit(0.0).alias("score"))
    tf = tf.filter("term is not null")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = broadcast_if_small(asked.join(df, "term").select("list", "term", "times", idf.alias("idf")), QUERY_WORDS)
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    return tf.join(weighted, "term").groupBy("list", id_col).agg(F.round(F.sum(part), digits).alias("score")).filter("score > 0")


def bm25(docs: DataFrame, query: str, top_k: int = 20, id_col: str = "doc_id", text_col: str = "text", digits: int = 6) -> DataFrame:
    """id_col, score of the best documents for one query (see bm25_lists): score descending, then id."""
    scored = bm25_lists(docs, {"q": query}, id_col, text_col, digits).select(id_col, "score")
    return scored.orderBy(F.desc("score"), id_col).limit(max(1, min(top_k, 200)))


def fulltext(symbol_rows: DataFrame, query: str, top_k: int = 20, weights: dict[str, float] = FIELD_WEIGHTS, digits: int = 6) -> DataFrame:
    """symbol_id, score of the symbols whose fields have words of the query, best first, then by id.

    The first QUERY_TOKENS words count, any of them is enough, and one of FUZZY_LENGTH letters or
    more also meets words that differ by one letter: the query is compared with the distinct words
    of the fields, not with every symbol. A word adds, field by field, its weight times its rarity
    times tf / (tf + K1). There is no stemming.
    """
    spark = symbol_rows.sparkSession
    token = "([a-z0-9_]+)"
    asked = [w for w in dict.fromkeys(spark.createDataFrame([(query,)], "q string").select(F.regexp_extract_all(F.lower("q"), F.lit(token), F.lit(1)).alias("w")).first()["w"]) if len(w) > 1][:QUERY_TOKENS]
    fields = [f for f in weights if f in symbol_rows.columns]
    if not asked or not fields:
        return symbol_rows.limit(0).select("symbol_id", F.lit(0.0).alias("score"))
    n = symbol_rows.count()
    of = F.explode(F.array(*[F.struct(F.lit(float(weights[f])).alias("weight"), F.regexp_extract_all(F.lower(F.coalesce(f, F.lit(""))), F.lit(token), F.lit(1)).alias("w")) for f in fields]))
    tf = symbol_rows.select("symbol_id", of.alias("f")).select("symbol_id", "f.weight", F.explode("f.w").alias("term")).groupBy("symbol_id", "weight", "term").agg(F.count(F.lit(1)).alias("tf"))
    near = [F.when((F.col("term") == w) | ((F.levenshtein("term", F.lit(w), 1) >= 0) if len(w) >= FUZZY_LENGTH else F.lit(False)), F.lit(w)) for w in asked]
    dictionary = tf.select("term").distinct().withColumn("query", F.explode(F.array_compact(F.array(*near))))
    met = checkpointed(tf.join(broadcast_if_small(dictionary, QUERY_WORDS), "term"))
    idf = met.groupBy("query").agg(F.countDistinct("symbol_id").alias("df")).select("query", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    scored = met.join(F.broadcast(idf), "query").groupBy("symbol_id").agg(F.round(F.sum(F.col("weight") * F.col("idf") * F.col("tf") / (F.col("tf") + K1)), digits).alias("score"))  # at most QUERY_TOKENS rows
    return scored.orderBy(F.desc("score"), "symbol_id").limit(max(1, min(top_k, 100)))


def skills(rows: DataFrame, query: str = "") -> DataFrame:
    """rows (name, description, when_to_use array) that have the query's text in them, by name."""
    hay = F.lower(F.concat_ws(" ", "name", "description", F.array_join("when_to_use", " ")))
    return rows.filter(F.contains(hay, F.lit(query.strip().lower()))).orderBy("name")


def name_search(symbol_rows: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Symbols whose name, qualified name or path has the query's first word in it, by id."""
    word = (query.split() or [""])[0].lower()[:80]
    hay = F.lower(F.concat_ws("\n", "name", "qualified_name", "file_path"))
    return symbol_rows.filter(F.contains(hay, F.lit(word))).select("symbol_id", "name").orderBy("symbol_id").limit(limit)


def dot(a: Column, b: Column) -> Column:
    """Plain dot product of two arrays, over the shorter's length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(F.filter(products, lambda p: p.isNotNull()), F.lit(0.0), lambda s, p: s + p)


def cosine(a: Column, b: Column) -> Column:
    """Dot product by norms; a norm of 0 counts as 1."""
    norm = lambda v: F.when(dot(v, v) == 0, 1.0).otherwise(F.sqrt(dot(v, v)))
    return dot(a, b) / (norm(a) * norm(b))


def nearest(vectors: DataFrame, query: list[float], top_k: int, kinds: list | None = None, kind_col: str = "label", id_col: str = "vec_id", vector_col: str = "embedding", true_cosine: bool = False, allow: DataFrame | None = None, digits: int = 5) -> DataFrame:
    """id_col, score of the vectors most like query: filtered before they are ranked, first top_k, then scores above 0; ties by id."""
    rows = vectors if kinds is None else vectors.filter(F.col(kind_col).isin(*kinds))
    rows = rows if allow is None else rows.join(allow.select(id_col).distinct(), id_col, "left_semi")
    q = F.lit([float(x) for x in query])
    score = cosine(F.col(vector_col), q) if true_cosine else dot(F.col(vector_col), q)
    return rows.select(id_col, F.round(score, digits).alias("score")).orderBy(F.desc("score"), id_col).limit(top_k).filter("score > 0")


def fused(lists: DataFrame, k: int = RRF_K, digits: int = 6) -> DataFrame:
    """columns list, item, rank (from 1) to item, score: reciprocal rank fusion; an item twice in a list counts twice."""
    return lists.groupBy("item").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), digits).alias("score"))


def ranked(rows: DataFrame, name: str, id_col: str, top_k: int) -> DataFrame:
    """A channel's rows (id_col, score; at most top_k) as list, item, rank."""
    first = rows.orderBy(F.desc("score"), id_col).limit(top_k).withColumn("list", F.lit(name))
    return first.select("list", F.col(id_col).alias("item"), F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), id_col)).alias("rank"))


def ndcg(results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """query, ndcg of results (query, item, rank) against gold (query, item, gain): (2^gain - 1) / log2(rank + 1), 4 decimals; 0 without gold."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + F.lit(1.0))
    got = results.filter(F.col("rank") <= k).join(gold, ["query", "item"]).groupBy("query").agg(F.sum(gain(F.col("gain"), F.col("rank"))).alias("dcg"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), "item"))
    ideal = gold.withColumn("r", order).filter(F.col("r") <= k).groupBy("query").agg(F.sum(gain(F.col("gain"), F.col("r"))).alias("ideal"))
    all_queries = results.select("query").union(gold.select("query")).distinct()
    return all_queries.join(got, "query", "left").join(ideal, "query", "left").select("query", F.round(F.coalesce(F.col("dcg") / F.nullif("ideal", F.lit(0.0)), F.lit(0.0)), 4).alias("ndcg"))


def agreement(predicted: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """by, precision, recall, f1 of sets of items (columns by, item); two empty sets agree."""
    both = predicted.select(by, "item").distinct().withColumn("p", F.lit(1)).join(gold.select(by, "item").distinct().withColumn("g", F.lit(1)), [by, "item"], "full")
    s = both.groupBy(by).agg(F.count("p").alias("p"), F.count("g").alias("g"), F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("hit"))
    s = s.withColumns({"precision": F.when(F.col("p") > 0, F.col("hit") / F.col("p")).otherwise(0.0), "recall": F.when(F.col("g") > 0, F.col("hit") / F.col("g")).otherwise(0.0)})
    total = F.col("precision") + F.col("recall")
    return s.select(by, F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0), 4).alias("f1"))


def hashed_embedding(rows: DataFrame, id_col: str, text_col: str, dims: int = 16, digits: int = 6) -> DataFrame:
    """id_col, dim, value: counts of a text's words by hashed dimension, of unit length; dimensions of 0 are left out."""
    words = rows.select(id_col, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(f"({text.PLAIN_WORD})"), F.lit(1))).alias("w"))
    counts = words.groupBy(id_col, text.hash_bucket(F.col("w"), dims).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    norm = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, id_col).select(id_col, "dim", F.round(F.col("n") / F.col("norm"), digits).alias("value"))


def tool_scores(tools: DataFrame, query: str, intends_harm: bool = False) -> DataFrame:
    """tool, score: words of the query in a tool's name (2 each) and description (1 each); the exact name gives 1 more; destructive tools lose 3 unless intended."""
    words = sorted({w for w in query.lower().replace("-", "_").split() if len(w) > 1})
    has = lambda c, x: sum((F.when(F.contains(F.lower(c), F.lit(w)), x).otherwise(0.0) for w in words), F.lit(0.0))
    exact = F.when(F.lower("tool") == query.strip().lower(), 1.0).otherwise(0.0)
    harm = F.when(F.col("destructive") & F.lit(not intends_harm), -3.0).otherwise(0.0)
    return tools.select("tool", (has(F.col("tool"), 2.0) + has(F.col("description"), 1.0) + exact + harm).alias("score")).filter("score > 0")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    v = table(spark, sf_dir, "embeddings")
    return v, list(v.filter("vec_id = 7").first()["embedding"])


def _item(spark: SparkSession, sf_dir: str, item: int = 3) -> str:
    return table(spark, sf_dir, "benchmark").filter(F.col("item_id") == item).first()["text"]


def r08_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return nearest(v, q, 10, kinds=[0, 1, 2])


def r09_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return nearest(v, q, 10, true_cosine=True, allow=v.filter("vec_id % 3 = 0"))


def r10_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of four times the rows by the first half of the dimensions, ranked again by all."""
    v, q = _vectors(spark, sf_dir)
    pool = nearest(v.withColumn("embedding", F.slice("embedding", 1, 32)), q[:32], 40)
    return nearest(v, q, 10, allow=pool)


def r13_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lexical channels and a vector one, fused."""
    v, q = _vectors(spark, sf_dir)
    scored = bm25_lists(table(spark, sf_dir, "documents"), {"a": _item(spark, sf_dir), "b": _item(spark, sf_dir, 5)})
    of_list = Window.partitionBy("list").orderBy(F.desc("score"), "doc_id")
    lexical = scored.withColumn("rank", F.row_number().over(of_list)).filter("rank <= 40").select("list", F.col("doc_id").alias("item"), "rank")
    lists = lexical.unionByName(ranked(nearest(v, q, 40), "c", "vec_id", 40))
    return fused(lists).orderBy(F.desc("score"), "item").limit(20)


def a22_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by their first 16 dimensions against the rank by all, the query's label giving the gain."""
    v, q = _vectors(spark, sf_dir)
    label = v.filter("vec_id = 7").first()["label"]
    found = ranked(nearest(v.withColumn("embedding", F.slice("embedding", 1, 16)), q[:16], 20), "q", "vec_id", 20).select(F.col("list").alias("query"), "item", "rank")
    gold = v.filter(F.col("label") == label).select(F.lit("q").alias("query"), F.col("vec_id").alias("item"), F.lit(1.0).alias("gain"))
    return ndcg(found, gold)


def a22_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    short = docs.filter("n_chars < 400").select("source", F.col("doc_id").alias("item"))
    bad = docs.join(labels.filter("quality = 0"), "doc_id").select("source", F.col("doc_id").alias("item"))
    return agreement(short, bad, "source")


def r20_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of ranking by the first 32 dimensions against all: the gate of an approximate index."""
    v, q = _vectors(spark, sf_dir)
    near = nearest(v.withColumn("embedding", F.slice("embedding", 1, 32)), q[:32], 10).select("vec_id")
    true = nearest(v, q, 10).select("vec_id")
    return true.join(near.withColumn("hit", F.lit(1)), "vec_id", "left").agg(F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


QUERIES = {
    "r01_word_counts": lambda spark, d: table(spark, d, "documents").select(F.explode(text.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")),
    "r02_bm25": lambda spark, d: bm25(table(spark, d, "documents"), _item(spark, d)),
    "r02_postings": lambda spark, d: postings(table(spark, d, "documents"), "doc_id", "text"),
    "r03_searchable": lambda spark, d: symbols(spark, d).select("symbol_id", text.searchable(F.col("name"), F.col("qualified_name"), F.lit(""), F.col("file_path"), F.lit(None).cast("string"), F.col("kind")).alias("text")),
    "r04_fulltext": lambda spark, d: fulltext(symbols(spark, d), "customer#000000012 BUILDING supplie france copper", 50),
    "r18_tool_scores": lambda spark, d: tool_scores(table(spark, d, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("tool"), F.concat_ws(" ", "p_type", "p_name").alias("description"), (F.col("p_size") > 40).alias("destructive")), "find copper Brand"),
    "r19_skills": lambda spark, d: skills(table(spark, d, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("description"), F.array("p_brand").alias("when_to_use")), " copper brand#1").select("name"),
    "r05_name_search": lambda spark, d: name_search(symbols(spark, d), "Customer#000000012 x"),
    "r06_hashed_embedding": lambda spark, d: hashed_embedding(symbols(spark, d), "symbol_id", "qualified_name"),
    "r06_id_numbers": lambda spark, d: symbols(spark, d).select("symbol_id", text.id_number(F.col("symbol_id")).cast("string").alias("number"), text.hash_bucket(F.col("name"), 1024).alias("bucket")),
    "r08_vector_topk": r08_vectors,
    "r09_vector_allowed": r09_allowed,
    "r10_two_stage": r10_two_stage,
    "r13_hybrid": r13_hybrid,
    "r20_recall": r20_recall,
    "w08_fusion": lambda spark, d: fused(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("list"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("rank"))),
    "a22_ndcg": a22_ndcg,
    "a22_agreement": a22_agreement,
}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}_][\p{L}\p{N}_]{1,63}')"


def _bm25_sql(name: str, item: int, k: int) -> str:
    return f"""{name}_q as (select unnest(regexp_extract_all(lower(text), '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]{{1,63}}')) as term from benchmark where item_id = {item}),
{name}_qt as (select term, count(*) as times from {name}_q group by 1),
{name}_tf as (select doc_id, term, times, length, count(*) as tf from (select doc_id, len(w) as length, unnest(w) as term from words) join {name}_qt using (term) group by all),
{name}_df as (select term, count(*) as df from {name}_tf group by 1),
{name} as (select doc_id, round(sum(times * ln(1 + ((select count(*) from words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (select avg(len(w)) from words)))), 6) as score from {name}_tf join {name}_df using (term) group by 1 order by 2 desc, 1 limit {k})"""


_W = f"words as (select doc_id, {_WORDS} as w from documents)"
_Q = "(select embedding from embeddings where vec_id = 7)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"


def _near(dims: int, k: int, where: str = "true") -> str:
    return f"(select vec_id, round({_DOT.format(a=f'embedding[1:{dims}]', b=f'{_Q}[1:{dims}]')}, 5) as score from embeddings where {where} order by 2 desc, 1 limit {k})"


ORACLE_SQL = {
    "r01_word_counts": f"with {_W} select term, count(*) as n from (select unnest(w) as term from words) group by 1",
    "r02_bm25": f"with {_W}, {_bm25_sql('x', 3, 20)} select * from x",
    "r02_postings": f"with {_W} select doc_id, term, count(*) as tf, any_value(length)::int as length from (select doc_id, len(w) as length, unnest(w) as term from words) group by 1, 2",
    "r03_searchable": f"with {GRAPH_SQL} select symbol_id, name || ' ' || qualified_name || ' ' || replace(replace(file_path, '/', ' '), '.', ' ') || ' ' || kind as text from fx_symbols",
    "r04_fulltext": f"""with {GRAPH_SQL}, q as (select unnest(['customer', '000000012', 'building', 'supplie', 'france', 'copper']) as q),
w as (select symbol_id, weight, unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) as term from (select symbol_id, 1.0::double as weight, name || ' ' || qualified_name as t from fx_symbols union all select symbol_id, 0.4::double, file_path from fx_symbols)),
tf as (select symbol_id, weight, term, count(*) as tf from w group by all), d as (select term, q from (select distinct term from tf), q where term = q or (length(q) >= 5 and levenshtein(term, q) <= 1)),
m as (select * from tf join d using (term)), i as (select q, ln(1 + ((select count(*) from fx_symbols) - count(distinct symbol_id) + 0.5) / (count(distinct symbol_id) + 0.5)) as idf from m group by 1)
select symbol_id, round(sum(weight * idf * tf / (tf + 1.5)), 6) as score from m join i using (q) group by 1 order by 2 desc, 1 limit 50""",
    "r18_tool_scores": "with t as (select p_brand || '-' || p_partkey as tool, p_type || ' ' || p_name as d, p_size > 40 as x from part), s as (select tool, ((contains(lower(tool), 'find')::int + contains(lower(tool), 'copper')::int + contains(lower(tool), 'brand')::int) * 2 + contains(lower(d), 'find')::int + contains(lower(d), 'copper')::int + contains(lower(d), 'brand')::int - case when x then 3 else 0 end)::double as score from t) select * from s where score > 0",
    "r19_skills": "select p_name || ' ' || p_partkey as name from part where contains(lower(p_name || ' ' || p_partkey || ' ' || p_type || ' ' || p_brand), 'copper brand#1') order by 1",
    "r05_name_search": f"with {GRAPH_SQL} select symbol_id, name from fx_symbols where contains(lower(name || qualified_name || file_path), 'customer#000000012') order by 1 limit 50",
    "r06_hashed_embedding": f"with {GRAPH_SQL}, w as (select symbol_id, unnest(regexp_extract_all(lower(qualified_name), '[a-z0-9][a-z0-9_-]*')) as w from fx_symbols), c as (select symbol_id, (('0x' || sha256(w)[1:16])::ubigint % 16)::int as dim, count(*) as n from w group by all) select symbol_id, dim, round(n / sqrt(sum(n * n) over (partition by symbol_id)), 6) as value from c",
    "r06_id_numbers": f"with {GRAPH_SQL} select symbol_id, (('0x' || sha256(symbol_id)[1:16])::ubigint)::varchar as number, (('0x' || sha256(name)[1:16])::ubigint % 1024)::int as bucket from fx_symbols",
    "r08_vector_topk": f"select * from {_near(64, 10, 'label in (0, 1, 2)')} where score > 0",
    "r09_vector_allowed": f"select vec_id, score from (select vec_id, round({_DOT.format(a='embedding', b=_Q)} / sqrt({_DOT.format(a='embedding', b='embedding')}) / sqrt({_DOT.format(a=_Q, b=_Q)}), 5) as score from embeddings where vec_id % 3 = 0 order by 2 desc, 1 limit 10) where score > 0",
    "r10_two_stage": f"select * from {_near(64, 10, f'vec_id in (select vec_id from {_near(32, 40)} where score > 0)')} where score > 0",
    "r13_hybrid": f"""with {_W}, {_bm25_sql('x', 3, 40)}, {_bm25_sql('y', 5, 40)},
l as (select doc_id as item, row_number() over (order by score desc, doc_id) as rank from x union all select doc_id, row_number() over (order by score desc, doc_id) from y
  union all select vec_id, row_number() over (order by score desc, vec_id) from {_near(64, 40)} where score > 0)
select item, round(sum(1.0::double / (60 + rank)), 6) as score from l group by 1 order by 2 desc, 1 limit 20""",
    "r20_recall": f"select round(count(b.vec_id) / count(*)::double, 4) as recall from {_near(64, 10)} a left join (select vec_id from {_near(32, 10)} where score > 0) b using (vec_id) where score > 0",
    "w08_fusion": "select l_partkey as item, round(sum(1.0::double / (60 + l_linenumber)), 6) as score from lineitem group by 1",
    "a22_ndcg": f"""with f as (select vec_id, row_number() over (order by score desc, vec_id) as rank from {_near(16, 20)} where score > 0),
g as (select vec_id from embeddings where label = (select label from embeddings where vec_id = 7)),
d as (select sum(1 / log2(rank + 1.0)) as dcg from f where rank <= 10 and vec_id in (select vec_id from g)),
i as (select sum(1 / log2(r + 1.0)) as ideal from (select row_number() over () as r from g) where r <= 10)
select 'q' as query, round(coalesce(dcg, 0) / ideal, 4) as ndcg from d, i""",
    "a22_agreement": """with s as (select source, doc_id from documents where n_chars < 400), b as (select source, doc_id from documents join labels using (doc_id) where quality = 0),
c as (select coalesce(s.source, b.source) as source, count(s.doc_id) as p, count(b.doc_id) as g, count(*) filter (s.doc_id is not null and b.doc_id is not null) as hit from s full join b on s.doc_id = b.doc_id group by 1),
r as (select source, case when p > 0 then hit / p::double else 0 end as pr, case when g > 0 then hit / g::double else 0 end as re from c)
select source, round(pr, 4) as precision, round(re, 4) as recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 4) as f1 from r""",
}
