"""Symbols, calls, routes and more out of source texts; shorter forms of long texts."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of routes, client calls and injections.
PY_ROUTE = r"@(?:\w+\.)?(get|post|put|delete|patch|options|head|route|api_route|websocket)\(\s*[\"']([^\"']+)[\"'][^\n]*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"
JS_ROUTE = r"(?:app|router|Router)\.(get|post|put|delete|patch|use|all)\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,\s*([A-Za-z_][\w.]*)"
PY_HTTP = r"\b(?:requests|httpx|client|session|aiohttp)\b(?:\.\w+)*\.(get|post|put|delete|patch|head|options|request)\(\s*(?:method\s*=\s*)?[\"']([^\"']+)[\"']"
JS_FETCH = r"\bfetch\(\s*[\"'`]([^\"'`]+)[\"'`]"
JS_CLIENT = r"\b(?:axios|client|api)\.(get|post|put|delete|patch|head|options)\(\s*[\"'`]([^\"'`]+)[\"'`]"
PY_DEPENDS = r"(\w+)\s*(?::\s*[\w.\[\]]+\s*)?=\s*Depends\(\s*([A-Za-z_][\w.]*)"
PY_ANNOTATED = r"(\w+)\s*:\s*(?:\w+\.)?Annotated\[[^\[\]]*\bDepends\(\s*([A-Za-z_][\w.]*)"
PY_FUNCTION = r"\bdef\s+([A-Za-z_]\w*)\s*\(((?:[^()]++|\([^()]*+\))*+)\)"
DJANGO_ROUTE = r"\b(?:re_)?path\(\s*r?[\"']([^\"']*)[\"']\s*,\s*([A-Za-z_][\w.]*)"
NEXT_EXPORT = r"\bexport\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
NEXT_DEFAULT = r"\bexport\s+default\s+(?:async\s+)?function\s+([A-Za-z_]\w*)"
TS_INJECTABLE = r"@(?:Injectable|Controller|Resolver)\([^)]*\)\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_]\w*)"
TS_CONSTRUCTOR = r"\bconstructor\s*\(((?:[^()]++|\([^()]*+\))*+)\)"
TS_PARAMETER = r"(?:\b(?:private|public|protected|readonly)\s+)+([A-Za-z_]\w*)\s*:\s*([A-Z]\w*)"
JAVA_CLASS = r"\bclass\s+([A-Za-z_]\w*)"
JAVA_FIELD = r"@(?:Autowired|Inject)\s+(?:(?:private|protected|public|final)\s+)*([A-Z]\w*)(?:<[^>]*>)?\s+([A-Za-z_]\w*)\s*;"
WATERMARK = "[compressed]"
SYMBOL_SCHEMA = "file_path string, kind string, name string, qualified_name string, line int, visibility string, bases array<string>, calls array<string>, imports array<string>"


def _all(c: Column, pattern: str, groups: tuple[int, ...], names: tuple[str, ...]) -> Column:
    """array<struct> of a pattern's groups, match by match."""
    parts = [F.regexp_extract_all(c, F.lit(f"(?i){pattern}"), F.lit(g)) for g in groups]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, names)]), lambda x: F.struct(*[x[n].alias(n) for n in names]))


def routes(files: DataFrame) -> DataFrame:
    """file_path, method, path, handler of files (file_path, language, source); route and api_route are any method.

    Decorators and router calls; Django's path() and re_path() in urls.py (any method, by the view's
    or the class's name); files whose place is their route: app/**/route.* with an exported
    function for each method, and pages/api/** with a default one.
    """
    c, at = F.coalesce("source", F.lit("")), F.coalesce("file_path", F.lit(""))
    names = ("method", "path", "handler")
    row = lambda method, path, handler: F.struct(method.alias("method"), path.alias("path"), handler.alias("handler"))
    none = F.array().cast("array<struct<method:string,path:string,handler:string>>")
    view = lambda h: F.substring_index(F.regexp_replace(h, r"\.as_view$", ""), ".", -1)
    django = F.transform(_all(c, DJANGO_ROUTE, (1, 2), ("path", "handler")), lambda x: row(F.lit("any"), F.concat(F.lit("/"), x["path"]), view(x["handler"])))
    django = F.when(at.rlike(r"(^|/)urls\.py$"), F.filter(django, lambda x: x["handler"] != "include")).otherwise(none)
    place = F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.regexp_extract(at, r"(?:^|/)app/(?:(.*)/)?route\.[jt]sx?$", 1), "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$")), "/"))
    by_method = F.transform(F.regexp_extract_all(c, F.lit(NEXT_EXPORT), F.lit(1)), lambda m: row(m, place, m))
    page = F.regexp_replace(F.concat(F.lit("/"), F.regexp_extract(at, r"(?:^|/)pages/(api/.*)\.[jt]sx?$", 1)), r"/index$", "")
    by_default = F.transform(F.slice(F.regexp_extract_all(c, F.lit(NEXT_DEFAULT), F.lit(1)), 1, 1), lambda h: row(F.lit("any"), page, h))
    of_place = F.when(at.rlike(r"(^|/)app/(.*/)?route\.[jt]sx?$"), by_method).when(at.rlike(r"(^|/)pages/api/.*\.[jt]sx?$"), by_default).otherwise(none)
    own = F.when(F.col("language") == "python", F.concat(_all(c, PY_ROUTE, (1, 2, 3), names), django)).when(F.col("language").isin("javascript", "typescript"), F.concat(_all(c, JS_ROUTE, (1, 2, 3), names), of_place))
    rows = files.select("file_path", F.explode(own).alias("r"))
    method = F.upper("r.method")
    return rows.select("file_path", F.when(method.isin("ROUTE", "API_ROUTE", "ALL", "USE"), "ANY").otherwise(method).alias("method"), F.col("r.path").alias("path"), F.col("r.handler").alias("handler"))


def http_calls(files: DataFrame) -> DataFrame:
    """file_path, method, url of the calls that clients in the sources make; a fetch is a GET."""
    c = F.coalesce("source", F.lit(""))
    fetched = F.transform(F.regexp_extract_all(c, F.lit(JS_FETCH), F.lit(1)), lambda u: F.struct(F.lit("get").alias("method"), u.alias("url")))
    own = F.when(F.col("language") == "python", _all(c, PY_HTTP, (1, 2), ("method", "url"))).when(F.col("language").isin("javascript", "typescript"), F.concat(fetched, _all(c, JS_CLIENT, (1, 2), ("method", "url"))))
    return files.select("file_path", F.explode(own).alias("r")).select("file_path", F.upper("r.method").alias("method"), F.col("r.url").alias("url"))


def injections(files: DataFrame) -> DataFrame:
    """file_path, parameter, provider, consumer of what functions and classes have injected.

    Python: parameters with a dependency as default or in their annotation; the function consumes.
    TypeScript: the constructor's members of a class that the container makes. Java: fields that are
    wired. Of files with several such classes the first counts as the consumer.
    """
    c = F.coalesce("source", F.lit(""))
    names = ("parameter", "provider")
    functions = files.filter("language = 'python'").select("file_path", F.explode(_all(c, PY_FUNCTION, (1, 2), ("consumer", "arguments"))).alias("f"))
    python = functions.select("file_path", "f.consumer", F.explode(F.array_distinct(F.concat(_all(F.col("f.arguments"), PY_DEPENDS, (1, 2), names), _all(F.col("f.arguments"), PY_ANNOTATED, (1, 2), names)))).alias("r"))
    consumer = lambda pattern: F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), 0)
    made = files.filter(F.col("language").isin("typescript", "javascript")).select("file_path", consumer(TS_INJECTABLE).alias("consumer"), F.explode(F.regexp_extract_all(c, F.lit(TS_CONSTRUCTOR), F.lit(1))).alias("arguments")).filter("consumer is not null")
    nest = made.select("file_path", "consumer", F.explode(_all(F.col("arguments"), TS_PARAMETER, (1, 2), names)).alias("r"))
    spring = files.filter("language = 'java'").select("file_path", consumer(JAVA_CLASS).alias("consumer"), F.explode(_all(c, JAVA_FIELD, (2, 1), names)).alias("r"))
    return python.unionByName(nest).unionByName(spring).select("file_path", "r.parameter", "r.provider", "consumer")


def package_aliases(files: DataFrame) -> DataFrame:
    """prefix, replacement of imports by the packages' own names and the paths they give, from manifests (file_path, source).

    pyproject.toml, go.mod (with replacements), Cargo.toml (with path dependencies), package.json
    (name, imports, local dependencies) and tsconfig.json (paths). Of equal prefixes the last kind counts.
    """
    c, base = F.coalesce("source", F.lit("")), F.substring_index(F.replace("file_path", F.lit("\\"), F.lit("/")), "/", -1)
    pair = lambda prefix, replacement: F.struct(prefix.alias("prefix"), replacement.alias("replacement"))
    none = F.array().cast("array<struct<prefix:string,replacement:string>>")
    name_of = lambda p: F.substring_index(F.regexp_replace(p, r"/+$", ""), "/", -1)
    under = lambda x: F.replace(x, F.lit("-"), F.lit("_"))
    toml = F.regexp_extract(c, r'(?m)^name\s*=\s*"([^"]+)"', 1)
    own = lambda n: F.when(n == "", none).otherwise(F.array(pair(n, under(n)), pair(under(n), under(n))))
    modules = F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^\s*module\s+(\S+)"), F.lit(1)), lambda m: pair(m, m))
    moved = F.transform(_all(c, r"(?m)^\s*replace\s+(\S+)[^\n]*?=>\s*(\S+)", (1, 2), ("a", "b")), lambda x: pair(x["a"], F.when(x["b"].rlike(r"^\.\.?/"), name_of(x["b"])).otherwise(x["b"])))
    crate = F.regexp_extract(c, r'(?ms)^\[package\][^\[]*?^name\s*=\s*"([^"]+)"', 1)
    local = F.flatten(F.transform(_all(c, r'(?m)^([A-Za-z0-9_-]+)\s*=\s*\{[^}\n]*path\s*=\s*"([^"]+)"', (1, 2), ("a", "b")), lambda x: F.array(pair(x["a"], name_of(x["b"])), pair(under(x["a"]), name_of(x["b"])))))
    entries = lambda path, kind: F.coalesce(F.map_entries(F.from_json(F.get_json_object(c, path), kind)), F.array().cast("array<struct<key:string,value:string>>" if kind == "map<string,string>" else "array<struct<key:string,value:array<string>>>"))
    trimmed = lambda p: F.regexp_replace(F.regexp_replace(F.replace(p, F.lit("*"), F.lit("")), r"/+$", ""), r"^\./", "")
    npm = F.get_json_object(c, "$.name")
    named = F.when(F.coalesce(npm, F.lit("")) == "", none).otherwise(F.array(pair(npm, F.replace(F.regexp_replace(npm, "^@+", ""), F.lit("/"), F.lit(".")))))
    inner = F.transform(entries("$.imports", "map<string,string>"), lambda e: pair(trimmed(e["key"]), F.regexp_replace(name_of(trimmed(e["value"])), r"\.[^.]*$", "")))
    sections = F.concat(*[entries(f"$.{s}", "map<string,string>") for s in ("dependencies", "devDependencies", "peerDependencies")])
    beside = F.transform(F.filter(sections, lambda e: e["value"].rlike("^(file|workspace):")), lambda e: pair(e["key"], name_of(F.regexp_replace(e["value"], "^(file|workspace):", ""))))
    bare = F.regexp_replace(c, r"(?m)//.*$", "")
    paths = F.transform(F.coalesce(F.map_entries(F.from_json(F.get_json_object(bare, "$.compilerOptions.paths"), "map<string,array<string>>")), F.array().cast("array<struct<key:string,value:array<string>>>")), lambda e: pair(trimmed(e["key"]), trimmed(F.get(e["value"], 0))))
    kinds = [("pyproject.toml", own(toml)), ("go.mod", F.concat(modules, moved)), ("Cargo.toml", F.concat(own(crate), local)), ("package.json", F.concat(named, inner, beside)), ("tsconfig.json", paths)]
    found = None
    for k, (kind, rows) in enumerate(kinds):
        part = files.filter(base == kind).select(F.lit(k).alias("k"), "file_path", F.explode(rows).alias("r"))
        found = part if found is None else found.unionByName(part)
    found = found.select("k", "file_path", "r.*").filter("prefix <> '' and replacement is not null")
    return found.groupBy("prefix").agg(F.max(F.struct("k", "file_path", "replacement")).alias("m")).select("prefix", "m.replacement")


def _symbols(path: str, source: str) -> Iterator[dict]:
    """One dict for the module and for each class and function in it; none for a source that doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    module = path.rsplit("/", 1)[-1].removesuffix(".py")
    imports = sorted({a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {f"{n.module or ''}.{a.name}".lstrip(".") for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) for a in n.names})
    called = lambda node: sorted({ast.unparse(n.func) for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))})
    row = lambda kind, name, qualified, line, bases, calls, imported: {"file_path": path, "kind": kind, "name": name, "qualified_name": qualified, "line": line, "visibility": "private" if name.startswith("_") and not name.startswith("__") else "public", "bases": bases, "calls": calls, "imports": imported}
    yield row("module", module, module, 1, [], [], imports)
    todo = [(n, module, False) for n in reversed(tree.body)]
    while todo:
        n, owner, in_class = todo.pop()
        if isinstance(n, ast.ClassDef):
            yield row("class", n.name, f"{owner}.{n.name}", n.lineno, [ast.unparse(b) for b in n.bases], [], [])
            todo += [(x, f"{owner}.{n.name}", True) for x in reversed(n.body)]
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield row("method" if in_class else "function", n.name, f"{owner}.{n.name}", n.lineno, [], called(n), [])


def python_symbols(files: DataFrame) -> DataFrame:
    """Modules, classes and functions of Python sources (file_path, source), with their bases, calls and imports."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, pa.string()) for n in ("file_path", "kind", "name", "qualified_name")] + [("line", pa.int32()), ("visibility", pa.string())] + [(n, pa.list_(pa.string())) for n in ("bases", "calls", "imports")])
        for b in batches:
            found = [s for path, source in zip(b["file_path"].to_pylist(), b["source"].to_pylist()) for s in _symbols(path or "", source or "")]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=kinds)

    return files.select("file_path", "source").mapInArrow(run, SYMBOL_SCHEMA)


def python_edges(parsed: DataFrame) -> DataFrame:
    """source, target, rel_type of parsed symbols: CONTAINS from an owner, INHERITS_FROM, CALLS and IMPORTS by the names written."""
    owner = F.regexp_extract("qualified_name", r"^(.*)\.[^.]+$", 1)
    contains = parsed.filter("kind <> 'module'").select(owner.alias("source"), F.col("qualified_name").alias("target"), F.lit("CONTAINS").alias("rel_type"))
    each = lambda col, rel: parsed.select(F.col("qualified_name").alias("source"), F.explode(col).alias("target"), F.lit(rel).alias("rel_type"))
    return contains.unionByName(each("bases", "INHERITS_FROM")).unionByName(each("calls", "CALLS")).unionByName(each("imports", "IMPORTS"))


def compressed(c: Column, least: int = 2000) -> Column:
    """A long text's head and tail (400 characters or a tenth each) around a mark; short and marked texts stay."""
    n = F.length(c)
    edge = F.greatest(F.lit(400), F.floor(n / 10).cast("int"))
    short = F.concat(F.substring(c, F.lit(1), edge), F.lit(f"\n{WATERMARK} "), (n - 2 * edge).cast("string"), F.lit(" characters\n"), F.substring(c, n - edge + 1, edge))
    return F.when((n < least) | F.contains(c, F.lit(WATERMARK)), c).otherwise(short)
