"""Linking names across languages and frameworks: calls, imports, routes, injections, dispatch, documents, anchors.

Names are looked up in an index of one row for each key, with its least symbol and how many have
it, so a name that very many symbols share is never paired with all that mention it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import confidence, text
from skein.functions.lineage import shuffled
from skein.operators import resolve
from skein.sources.tables import GRAPH_SQL, symbols, table

# Kinds of symbols that no name resolves to, and how many of several candidates get an edge.
NOT_TARGETS = ("file", "documentation", "unresolved", "external", "import")
EACH = 5


def normal_key(c: Column) -> Column:
    """A name with dots for ::, slashes and backslashes, none of them doubled or at an end."""
    dotted = F.translate(F.replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/")), F.lit("::"), F.lit(".")), "/", ".")
    return F.regexp_replace(F.regexp_replace(dotted, r"\.{2,}", "."), r"^\.+|\.+$", "")


def last(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def stem(path: Column) -> Column:
    """A path's last part without its last extension."""
    return F.regexp_replace(text.base_name(path), r"\.[^.]*$", "")


def _way(rung: int | Column, kind: str, key: Column) -> Column:
    return F.struct((F.lit(rung) if isinstance(rung, int) else rung).alias("rung"), F.lit(kind).alias("kind"), key.alias("key"))


def name_index(symbol_rows: DataFrame) -> DataFrame:
    """kind, key, target (the least id), candidates. Kinds: q qualified name, n normal name, s short name, f a file's stem."""
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    q, n = F.col("qualified_name"), F.col("name")
    named = symbol_rows.filter(~F.col("kind").isin(*NOT_TARGETS)).select("symbol_id", F.explode(F.array_distinct(F.array(entry("q", q), entry("n", normal_key(q)), entry("n", normal_key(n)), entry("s", n), entry("s", last(normal_key(q)))))).alias("e"))
    file_stem = stem(F.col("file_path"))
    of_file = symbol_rows.filter("kind = 'file'").select("symbol_id", F.explode(F.array_distinct(F.array(entry("f", file_stem), entry("f", normal_key(file_stem))))).alias("e"))
    rows = named.unionByName(of_file).select("symbol_id", "e.*").filter("key <> ''")
    return rows.groupBy("kind", "key").agg(F.min("symbol_id").alias("target"), F.countDistinct("symbol_id").alias("candidates"))


def _clamped(rows: DataFrame, symbol_rows: DataFrame, via: Column) -> Column:
    """rows (target, confidence, language) with confidence under the caps of its ends' languages."""
    of = symbol_rows.select(F.col("symbol_id").alias("target"), F.col("language").alias("target_language"))
    return rows.join(shuffled(of), "target", "left").withColumn("confidence", confidence.clamped(F.col("confidence"), F.col("language"), F.coalesce("target_language", F.lit("")), via))


def polyglot_calls(call_rows: DataFrame, symbol_rows: DataFrame, aliases: DataFrame, builtins: DataFrame) -> DataFrame:
    """call_id, rung, target, candidates, confidence of calls (call_id, module, file_path, ref, language): as resolve.calls has it, then across languages.

    What that leaves unresolved goes on to: 10 the normal name; 11 the short name; 12 and 13 the
    same of what ref is an alias of. The first with a candidate decides: one is exact, several
    ambiguous (target is the least). A single target in another language is probable at most.
    """
    code = symbol_rows.filter(~F.col("kind").isin(*NOT_TARGETS))
    same = resolve.calls(call_rows.drop("language"), code, aliases, builtins)
    named = aliases.select("file_path", F.col("alias").alias("ref"), "full_name").dropDuplicates(["file_path", "ref"])
    left = call_rows.join(shuffled(same.filter("rung = 9").select("call_id")), "call_id", "left_semi").join(shuffled(named), ["file_path", "ref"], "left")
    key, whole = normal_key(F.col("ref")), normal_key(F.col("full_name"))
    ways = F.array(_way(10, "n", key), _way(11, "s", last(key)), _way(12, "n", whole), _way(13, "s", last(whole)))
    tried = left.select("call_id", F.explode(ways).alias("w")).select("call_id", "w.*").filter("key <> ''").join(shuffled(name_index(symbol_rows)), ["kind", "key"])
    best = tried.groupBy("call_id").agg(F.min(F.struct("rung", "target", "candidates")).alias("b"))
    rows = same.join(shuffled(best), "call_id", "left").join(shuffled(call_rows.select("call_id", "language")), "call_id")
    found = F.col("b").isNotNull()
    rows = rows.select(
        "call_id", "language", F.coalesce("b.rung", "rung").alias("rung"), F.coalesce("b.target", "target").alias("target"), F.coalesce("b.candidates", "candidates").alias("candidates"),
        F.when(found & (F.col("b.candidates") == 1), "exact").when(found, "ambiguous").otherwise(F.col("confidence")).alias("confidence"),
    )
    return _clamped(rows, symbol_rows, F.lit("")).select("call_id", "rung", "target", "candidates", "confidence")


def fanned_out(resolved: DataFrame, call_rows: DataFrame, symbol_rows: DataFrame, each: int = EACH) -> DataFrame:
    """call_id, target, confidence of resolved calls, ambiguous ones with an edge to each of the first symbols (by id) of their short name."""
    single = resolved.filter("confidence <> 'ambiguous' and target is not null").select("call_id", "target", "confidence")
    many = resolved.filter("confidence = 'ambiguous'").join(call_rows.select("call_id", last(normal_key(F.col("ref"))).alias("name")), "call_id")
    short = symbol_rows.select("symbol_id", F.explode(F.array_distinct(F.array(F.col("name"), last(normal_key(F.col("qualified_name")))))).alias("name"))
    spread = many.select("call_id", "name").join(few(short, many, each), "name").select("call_id", F.col("symbol_id").alias("target"), F.lit("ambiguous").alias("confidence"))
    return single.unionByName(spread)


def imports(import_rows: DataFrame, symbol_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """import_id, target, candidates, confidence, resolved_via of imports (import_id, text, language); aliases: prefix, replacement of packages.

    The text as written, then with its longest package prefix replaced, is tried as a qualified name
    (exact), a normal name, a file's stem and a short name (probable if one symbol has it). Where
    several have it, it is ambiguous and has no target; nothing after that is tried.
    """
    raw = F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), "^[\"']+|[\"']+$", "")
    rows = import_rows.select("import_id", "language", raw.alias("ref"))
    other = resolve.rewritten(rows.filter("ref <> ''").select("ref").distinct(), aliases, joined="/")
    rows = rows.join(shuffled(other), "ref", "left")
    tries = F.filter(F.array(F.struct(F.lit(0).alias("n"), F.col("ref").alias("t")), F.struct(F.lit(10).alias("n"), F.col("rewritten").alias("t"))), lambda x: x["t"].isNotNull() & (x["t"] != "") & ((x["n"] == 0) | (x["t"] != F.col("ref"))))
    each = rows.select("import_id", F.explode(tries).alias("x")).select("import_id", "x.*")
    part = F.substring_index("t", "/", -1)
    own = F.regexp_replace(F.regexp_replace(part, r"\.[^.]*$", ""), r"^[./]+", "")
    shorter = F.when(F.contains(own, F.lit(".")), F.regexp_replace(own, r"\.[^.]*$", ""))
    module = F.when(F.contains(F.col("t"), F.lit("/")) | F.col("t").startswith("."), F.regexp_replace(F.substring_index(part, ".", 1), r"^[./]+", ""))
    stems = F.array_distinct(F.array_compact(F.array(own, shorter, module)))
    n = F.col("n")
    ways = F.concat(
        F.array(_way(n + 1, "q", F.col("t")), _way(n + 2, "n", normal_key(F.col("t")))),
        F.transform(F.array_distinct(F.concat(stems, F.transform(stems, normal_key))), lambda s: _way(n + 3, "f", s)), F.transform(stems, lambda s: _way(n + 4, "s", s)),
    )
    tried = each.select("import_id", F.explode(ways).alias("w")).select("import_id", "w.*").filter("key <> ''").join(shuffled(name_index(symbol_rows)), ["kind", "key"])
    by_rung = tried.groupBy("import_id", "rung").agg(F.max("candidates").alias("most"), F.countDistinct("target").alias("targets"), F.min("target").alias("target"))
    best = by_rung.groupBy("import_id").agg(F.min(F.struct("rung", "most", "targets", "target")).alias("b"))
    step = F.col("b.rung") % 10
    sure = F.when(F.col("b").isNull(), "unresolved").when(step == 1, "exact").when((F.col("b.most") == 1) & (F.col("b.targets") == 1), "probable").otherwise("ambiguous")
    via = F.when(step == 3, "file_stem").when(F.col("b.rung") > 10, "package_manifest")
    out = rows.select("import_id", "language").join(shuffled(best), "import_id", "left").select("import_id", "language", sure.alias("confidence"), "b.target", F.greatest("b.most", "b.targets").alias("candidates"), via.alias("via"))
    out = out.withColumn("target", F.when(~F.col("confidence").isin("ambiguous", "unresolved"), F.col("target")))
    out = _clamped(out, symbol_rows, F.coalesce("via", F.lit("")))
    return out.select("import_id", "target", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), "confidence", F.when(F.col("target").isNotNull(), F.col("via")).alias("resolved_via"))


def few(symbol_rows: DataFrame, names: DataFrame, each: int = EACH) -> DataFrame:
    """name, symbol_id, candidates: the first symbols (by id) of each of names, and how many have the name."""
    own = symbol_rows.join(names.select("name").distinct(), "name", "left_semi").select("name", "symbol_id").distinct()
    counted = own.groupBy("name").agg(F.count(F.lit(1)).alias("candidates"))
    first = own.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("symbol_id"))).filter(F.col("at") <= each)
    return first.join(counted, "name").select("name", "symbol_id", "candidates")


def _sure(one: str) -> Column:
    return F.when(F.col("candidates") == 1, one).when(F.col("candidates") > 1, "ambiguous").otherwise("unresolved")


def handlers(routes: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """route_id, target_id, confidence: edges from routes (method, path, handler) to the functions and methods of the handler's name.

    One is exact; of several the first five are ambiguous; without any the edge ends in a placeholder.
    """
    own = symbol_rows.filter(F.col("kind").isin("function", "method"))
    rows = routes.select(F.concat_ws(":", F.lit("route"), "method", "path").alias("route_id"), F.col("handler").alias("name")).distinct()
    met = rows.join(few(own, rows), "name", "left")
    return met.select("route_id", F.coalesce("symbol_id", F.concat(F.lit("unresolved:"), "name")).alias("target_id"), _sure("exact").alias("confidence"))


def injection_edges(injections: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """injection_id, source_id, target_id, confidence of injections (injection_id, consumer_name, provider_name, language).

    Edges go from the first five symbols of the consumer's name to the first five of the provider's:
    probable if the provider is alone, ambiguous if not; without one to a placeholder. Without a
    consumer an injection has no edge.
    """
    by = lambda c: few(symbol_rows, injections.select(F.col(c).alias("name"))).select(F.col("name").alias(c), "symbol_id", "candidates")
    rows = injections.join(by("consumer_name").select("consumer_name", F.col("symbol_id").alias("source_id")), "consumer_name")
    rows = rows.join(by("provider_name"), "provider_name", "left").withColumns({"target": F.coalesce("symbol_id", F.concat(F.lit("unresolved:"), "provider_name")), "confidence": _sure("probable")})
    return _clamped(rows, symbol_rows, F.lit("di_injection")).select("injection_id", "source_id", F.col("target").alias("target_id"), "confidence")


def dispatch(symbol_rows: DataFrame, inherits: DataFrame, call_rows: DataFrame) -> DataFrame:
    """source_id, target_id, method_name, via_type: a call of a base type's method may reach the same method of its subclasses.

    inherits: child, parent; call_rows: source_id, target_id, call_name. The base is the target
    itself, a class that the call's name refers to by the end of its qualified name (Base.run,
    m.Base.run), or the classes of an unresolved target's name. A method belongs to the least class
    (by id) that its owner's name refers to, else to the least of the owner's short name; of equal
    methods of a class the least counts.
    """
    dotted = F.replace("qualified_name", F.lit("::"), F.lit("."))
    before = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    classes = symbol_rows.filter("kind = 'class'").select(F.col("symbol_id").alias("class_id"), "name", dotted.alias("q"))
    parts = F.split("q", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    references = classes.select("class_id", F.explode(F.array_distinct(F.concat(tails, F.array("name")))).alias("reference"))
    owner = references.groupBy("reference").agg(F.min("class_id").alias("by_reference"))
    by_name = classes.groupBy("name").agg(F.min("class_id").alias("by_name")).withColumnRenamed("name", "owner_name")
    methods = symbol_rows.filter("kind = 'method'").select("symbol_id", "name", before(dotted).alias("reference")).filter("reference <> ''")
    owned = methods.join(owner, "reference", "left").withColumn("owner_name", last(F.col("reference"))).join(by_name, "owner_name", "left")
    owned = owned.select(F.coalesce("by_reference", "by_name").alias("child"), "name", "symbol_id").filter("child is not null").groupBy("child", "name").agg(F.min("symbol_id").alias("method_id"))
    own = call_rows.select("source_id", "target_id", "call_name", last(F.col("call_name")).alias("name")).distinct()
    ends = ["source_id", "target_id", "name"]
    of_target = own.select(*ends, F.col("target_id").alias("parent"))
    named = own.withColumn("reference", F.replace(before(F.col("call_name")), F.lit("::"), F.lit("."))).filter("reference <> ''").join(references, "reference").select(*ends, F.col("class_id").alias("parent"))
    unresolved = own.filter("target_id like 'unresolved:%'").withColumn("owner_name", F.substring_index("target_id", ":", -1)).join(classes.select("class_id", F.col("name").alias("owner_name")), "owner_name").select(*ends, F.col("class_id").alias("parent"))
    bases = of_target.unionByName(named).unionByName(unresolved).distinct()
    via = symbol_rows.select(F.col("symbol_id").alias("parent"), F.col("name").alias("via_type"))
    made = bases.join(inherits.select("child", "parent").distinct(), "parent").join(owned, ["child", "name"]).filter("method_id <> target_id").join(via, "parent", "left")
    return made.groupBy("source_id", F.col("method_id").alias("target_id")).agg(F.min("name").alias("method_name"), F.min(F.coalesce("via_type", F.lit("base"))).alias("via_type"))


def anchored_symbols(symbol_rows: DataFrame, names: list[str] = (), paths: list[str] = ()) -> DataFrame:
    """symbol_id of symbols with one of names as id, qualified name or name, or with one of paths as, before, at the end of, or in their path; none without either."""
    wanted, places = [n.strip() for n in names if n.strip()], [p.strip().replace("\\", "/") for p in paths if p.strip()]
    hit = F.lit(False)
    if wanted:
        hit = hit | F.col("symbol_id").isin(*wanted) | F.col("qualified_name").isin(*wanted) | F.col("name").isin(*wanted)
    for p in places:  # a path that is equal, above or at the end is in it as well
        hit = hit | F.contains(text.path(F.col("file_path")), F.lit(p))
    return symbol_rows.filter(hit).select("symbol_id")


def document_links(tokens: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """doc_id, token, symbol_id (null: unresolved) of what documents (doc_id, token) say they are about.

    A token is a qualified name, a symbol's id, or path::name, where the name is a symbol's name or
    the end of its qualified name; of several symbols the least counts. Blank tokens are passed over.
    """
    code = symbol_rows.filter(~F.col("kind").isin(*NOT_TARGETS))
    rows = tokens.select("doc_id", F.trim("token").alias("token")).filter("token <> ''").distinct()
    parts = F.split("qualified_name", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    in_file = code.select("symbol_id", F.explode(F.array_distinct(F.concat(F.array("name"), tails))).alias("n"), text.path(F.col("file_path")).alias("p")).filter("n <> '' and p <> ''")
    keys = in_file.select("symbol_id", F.concat("p", F.lit("::"), "n").alias("token"), F.lit(0).alias("rung"))
    keys = keys.unionByName(code.select("symbol_id", F.col("qualified_name").alias("token"), F.lit(1).alias("rung"))).unionByName(code.select("symbol_id", F.col("symbol_id").alias("token"), F.lit(2).alias("rung")))
    index = keys.groupBy("token").agg(F.min(F.struct("rung", "symbol_id")).alias("k")).select(F.col("token").alias("key"), F.col("k.symbol_id").alias("symbol_id"))
    place = F.regexp_extract("token", r"(?s)^(.*?)::(.*)$", 1)
    key = F.when(F.contains(F.col("token"), F.lit("::")), F.concat(text.path(F.trim(place)), F.lit("::"), F.trim(F.regexp_extract("token", r"(?s)^(.*?)::(.*)$", 2)))).otherwise(F.col("token"))
    return rows.withColumn("key", key).join(index, "key", "left").select("doc_id", "token", "symbol_id")


def document_edges(links: DataFrame, known: DataFrame) -> DataFrame:
    """source_id, target_id, action (add, keep or remove): DOCUMENTED_BY edges from symbols to documents, against those known (source_id, target_id) of the same documents."""
    doc = F.concat(F.lit("doc:human:"), F.col("doc_id").cast("string"))
    new = links.filter("symbol_id is not null").select(F.col("symbol_id").alias("source_id"), doc.alias("target_id")).distinct().withColumn("new", F.lit(True))
    old = known.join(links.select(doc.alias("target_id")).distinct(), "target_id", "left_semi").select("source_id", "target_id").distinct().withColumn("old", F.lit(True))
    both = new.join(old, ["source_id", "target_id"], "full")
    return both.select("source_id", "target_id", F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").otherwise("keep").alias("action"))


def _with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, and one for each of their files."""
    s = symbols(spark, sf_dir)
    f = s.select("file_path", "language").distinct()
    return s.unionByName(f.select(F.concat(F.lit("file:"), "file_path").alias("symbol_id"), F.lit("file").alias("kind"), text.base_name(F.col("file_path")).alias("name"), F.col("file_path").alias("qualified_name"), "file_path", "language"))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).filter("kind = 'function'").withColumn("n", F.substring("symbol_id", 9, 20).cast("long"))


def j03_polyglot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that parts make of themselves and of customers, in the spellings of several languages."""
    p, n = _functions(spark, sf_dir), F.col("n")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), F.concat(F.lit("customer/"), "c_mktsegment", F.lit("/"), "c_name").alias("whole"), "c_name")
    p = p.join(c, "n", "left")
    ref = F.when(n % 6 == 0, F.replace("qualified_name", F.lit("."), F.lit("/"))).when(n % 6 == 1, F.col("name")).when(n % 6 == 2, F.replace("qualified_name", F.lit("."), F.lit("::"))).when(n % 6 == 3, "al").when(n % 6 == 4, F.concat(F.lit("zz"), n.cast("string"))).otherwise(F.concat(F.lit("x."), F.coalesce("c_name", F.lit("none"))))
    call_id = n.cast("string")
    call_rows = p.select(call_id.alias("call_id"), F.lit("other").alias("module"), F.concat(F.lit("f"), call_id).alias("file_path"), ref.alias("ref"), F.when(n % 4 == 0, "python").otherwise("go").alias("language"))
    aliases = p.filter("n % 6 = 3 and whole is not null").select(F.concat(F.lit("f"), call_id).alias("file_path"), F.lit("al").alias("alias"), F.col("whole").alias("full_name"))
    return polyglot_calls(call_rows, symbols(spark, sf_dir), aliases, spark.createDataFrame([("print",)], "ref string"))


def j04_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that parts make: names, paths, files' stems (some of several files), a package's alias, and nothing known."""
    p, n = _functions(spark, sf_dir), F.col("n")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    p = p.withColumn("k", n % 25).join(F.broadcast(nation), "k")  # 25 rows
    own = F.when(n % 6 == 0, F.col("qualified_name")).when(n % 6 == 1, F.concat(F.lit("'./"), F.replace("qualified_name", F.lit("."), F.lit("/")), F.lit("'"))).when(n % 6 == 2, F.concat(F.lit("../supplier/"), "n_name", F.lit(".py")))
    own = own.when(n % 6 == 3, F.concat(F.lit("./x/"), F.lit("BUILDING.ts"))).when(n % 6 == 4, F.concat(F.lit("@sup/"), "n_name")).otherwise(F.concat(F.lit("zz"), n.cast("string")))
    rows = p.select(n.alias("import_id"), own.alias("text"), F.when(n % 4 == 0, "python").otherwise("go").alias("language"))
    return imports(rows, _with_files(spark, sf_dir), spark.createDataFrame([("@sup", "supplier"), ("@other", "x")], "prefix string, replacement string"))


def j08_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the parts, handled by customers, by one of the parts of a name, or by nothing."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.col("p_name"))
    n = F.col("n")
    name = F.when(n % 3 == 0, F.concat(F.lit("Customer#"), F.lpad(n.cast("string"), 9, "0"))).when(n % 3 == 1, F.concat(F.lit("f"), (n % 50).cast("string"))).otherwise(F.concat(F.lit("no"), n.cast("string")))
    routes = p.select(F.when(n % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/r/"), n.cast("string")).alias("path"), name.alias("handler"))
    own = symbols(spark, sf_dir).withColumn("name", F.when(F.col("kind") == "function", F.concat(F.lit("f"), (F.substring("symbol_id", 9, 20).cast("long") % 100).cast("string"))).otherwise(F.col("name")))
    return handlers(routes, own)


def j09_injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    rows = p.select(n.alias("injection_id"), F.concat(F.lit("f"), (n % 70).cast("string")).alias("consumer_name"), F.when(n % 3 == 0, F.concat(F.lit("Customer#"), F.lpad(n.cast("string"), 9, "0"))).when(n % 3 == 1, F.concat(F.lit("f"), (n % 40).cast("string"))).otherwise("none").alias("provider_name"), F.lit("go").alias("language"))
    own = symbols(spark, sf_dir).withColumn("name", F.when(F.col("kind") == "function", F.concat(F.lit("f"), (F.substring("symbol_id", 9, 20).cast("long") % 50).cast("string"))).otherwise(F.col("name")))
    return injection_edges(rows, own)


def g16_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a tree of classes, parts as their methods, orders as calls of a base's method in three spellings."""
    word = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    k, p, o = F.col("s_suppkey"), F.col("p_partkey"), F.col("o_orderkey")
    classes = table(spark, sf_dir, "supplier").select(word("C", k).alias("symbol_id"), word("K", k).alias("name"), word("m", k % 7, "::K", k).alias("qualified_name"), F.lit("class").alias("kind"))
    owner = p % 10 + 1
    methods = table(spark, sf_dir, "part").select(word("M", p).alias("symbol_id"), word("f", F.floor(p / 10) % 3).alias("name"), F.when(p % 2 == 0, word("m", owner % 7, ".K", owner, ".f", F.floor(p / 10) % 3)).otherwise(word("K", owner, ".f", F.floor(p / 10) % 3)).alias("qualified_name"), F.lit("method").alias("kind"))
    inherits = table(spark, sf_dir, "supplier").filter("s_suppkey >= 2").select(word("C", k).alias("child"), word("C", F.floor(k / 2)).alias("parent"))
    base, f = o % 10 + 1, word("f", o % 3)
    orders = table(spark, sf_dir, "orders")
    call_rows = orders.select(word("O", o).alias("source_id"), F.when(o % 4 == 0, word("C", base)).when(o % 4 == 1, "x").when(o % 4 == 2, word("unresolved:p:K", base)).otherwise(word("M", base)).alias("target_id"), F.when(o % 4 == 1, F.concat(word("m", base % 7, ".K", base, "."), f)).otherwise(f).alias("call_name"))
    return dispatch(classes.unionByName(methods), inherits, call_rows)


def u08_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents about parts, by qualified name, by id, by file and name, and by what doesn't exist."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 100 + 1).alias("n"))
    p = _functions(spark, sf_dir).select("n", "qualified_name", "symbol_id", "file_path", "name")
    d = d.join(p, "n", "left")
    k = F.col("doc_id") % 4
    own = F.when(k == 0, F.col("qualified_name")).when(k == 1, F.col("symbol_id")).when(k == 2, F.concat("file_path", F.lit(":: p"), F.col("n").cast("string"))).otherwise(F.concat(F.lit("zz."), F.col("doc_id").cast("string")))
    return document_links(d.select("doc_id", own.alias("token")), symbols(spark, sf_dir))


QUERIES = {
    "j03_polyglot_calls": j03_polyglot,
    "j04_imports": j04_imports,
    "j08_handlers": j08_handlers,
    "j09_injections": j09_injections,
    "g16_dispatch": g16_dispatch,
    "f14_anchors": lambda spark, d: anchored_symbols(symbols(spark, d), ["sym:fx:p7", "Customer#000000012"], ["supplier/FRANCE.py", "tests/"]),
    "u08_document_links": u08_links,
}

_P = f"""{GRAPH_SQL}, p as (select *, substr(symbol_id, 9)::bigint as n from fx_symbols where kind = 'function')"""
_CLAMP = "case when language <> tl and confidence = 'exact' then 'probable' else confidence end"
ORACLE_SQL = {
    "j03_polyglot_calls": f"""with {_P},
nm as (select key, min(symbol_id) as t, count(distinct symbol_id) as k from (select qualified_name as key, symbol_id from fx_symbols union all select name, symbol_id from fx_symbols) group by 1),
c as (select n, case when n % 4 = 0 then 'python' else 'go' end as language, case n % 6 when 0 then qualified_name when 1 then name when 2 then qualified_name when 3 then 'customer.' || c_mktsegment || '.' || c_name when 5 then 'customer.' || c_mktsegment || '.' || c_name end as key from p left join customer on c_custkey = n),
r as (select n::varchar as call_id, language, case when nm.key is null then 9 when n % 6 = 3 then 12 when n % 6 = 5 then 6 else 10 end as rung, t as target, coalesce(k, 0) as candidates,
  case when nm.key is null then 'unresolved' when n % 6 = 5 then 'probable' when k = 1 then 'exact' else 'ambiguous' end as confidence from c left join nm using (key))
select call_id, rung, target, candidates, case when fx_symbols.language <> r.language and confidence = 'exact' then 'probable' else confidence end as confidence from r left join fx_symbols on symbol_id = target""",
    "j04_imports": f"""with {_P}, b as (select count(distinct file_path) as k, min('file:' || file_path) as t from fx_symbols where file_path like '%/BUILDING.ts'),
i as (select n, case when n % 4 = 0 then 'python' else 'go' end as language, p.symbol_id, 'supplier/' || n_name || '.py' as f, exists (select 1 from fx_symbols x where x.file_path = 'supplier/' || n_name || '.py') as has from p join nation on n_nationkey = n % 25),
r as (select n as import_id, language, case n % 6 when 0 then symbol_id when 1 then symbol_id when 2 then case when has then 'file:' || f end when 3 then case when (select k from b) = 1 then (select t from b) end when 4 then case when has then 'file:' || f end end as target,
 case n % 6 when 0 then 1 when 1 then 1 when 2 then has::int when 3 then (select k from b) when 4 then has::int else 0 end as candidates,
 case n % 6 when 0 then 'exact' when 1 then 'probable' when 2 then case when has then 'probable' else 'unresolved' end when 3 then case when (select k from b) > 1 then 'ambiguous' when (select k from b) = 1 then 'probable' else 'unresolved' end when 4 then case when has then 'probable' else 'unresolved' end else 'unresolved' end as confidence from i)
select import_id, target, candidates::bigint as candidates, case when language = 'python' and confidence = 'exact' then 'probable' else confidence end as confidence, case when target is not null and import_id % 6 in (2, 3, 4) then 'file_stem' end as resolved_via from r""",
    "j08_handlers": """with h as (select symbol_id, name from (select 'sym:fx:p' || p_partkey as symbol_id, 'f' || (p_partkey % 100) as name from part union all select 'sym:fx:c' || c_custkey, c_name from customer)),
k as (select *, count(*) over (partition by name) as k, row_number() over (partition by name order by symbol_id) as pos from h),
r as (select case when p_partkey % 2 = 0 then 'GET' else 'POST' end as m, '/r/' || p_partkey as path, case p_partkey % 3 when 0 then 'Customer#' || lpad(p_partkey::varchar, 9, '0') when 1 then 'f' || (p_partkey % 50) else 'no' || p_partkey end as name from part)
select 'route:' || m || ':' || path as route_id, coalesce(symbol_id, 'unresolved:' || r.name) as target_id, case when k = 1 then 'exact' when k > 1 then 'ambiguous' else 'unresolved' end as confidence from r left join k on k.name = r.name and pos <= 5""",
    "j09_injections": """with h as (select symbol_id, name from (select 'sym:fx:p' || p_partkey as symbol_id, 'f' || (p_partkey % 50) as name from part union all select 'sym:fx:c' || c_custkey, c_name from customer union all select 'sym:fx:s' || s_suppkey, s_name from supplier)),
k as (select * from (select *, count(*) over (partition by name) as k, row_number() over (partition by name order by symbol_id) as pos from h) where pos <= 5),
i as (select p_partkey as n, 'f' || (p_partkey % 70) as c, case p_partkey % 3 when 0 then 'Customer#' || lpad(p_partkey::varchar, 9, '0') when 1 then 'f' || (p_partkey % 40) else 'none' end as p from part)
select n as injection_id, a.symbol_id as source_id, coalesce(b.symbol_id, 'unresolved:' || p) as target_id, case when b.k = 1 then 'probable' when b.k > 1 then 'ambiguous' else 'unresolved' end as confidence from i join k a on a.name = c left join k b on b.name = p""",
    "g16_dispatch": """with m as (select p_partkey % 10 + 1 as c, (p_partkey // 10) % 3 as f, min('M' || p_partkey) as id from part where p_partkey % 10 + 1 in (select s_suppkey from supplier) group by 1, 2),
i as (select s_suppkey as child, s_suppkey // 2 as parent from supplier where s_suppkey >= 2),
c as (select 'O' || o_orderkey as source_id, o_orderkey % 10 + 1 as base, o_orderkey % 3 as f from orders where o_orderkey % 4 <> 3)
select source_id, id as target_id, 'f' || c.f as method_name, 'K' || base as via_type from c join i on parent = base and base in (select s_suppkey from supplier) join m on m.c = child and m.f = c.f""",
    "f14_anchors": f"with {GRAPH_SQL} select symbol_id from fx_symbols where symbol_id = 'sym:fx:p7' or name = 'Customer#000000012' or contains(file_path, 'supplier/FRANCE.py') or contains(file_path, 'tests/')",
    "u08_document_links": f"""with {_P}, d as (select doc_id, doc_id % 100 + 1 as n from documents), j as (select d.doc_id, d.n, p.symbol_id, p.qualified_name, p.file_path from d left join p using (n))
select doc_id, case doc_id % 4 when 0 then qualified_name when 1 then symbol_id when 2 then file_path || ':: p' || n else 'zz.' || doc_id end as token, case when doc_id % 4 < 3 then symbol_id end as symbol_id from j where doc_id % 4 = 3 or symbol_id is not null""",
}
