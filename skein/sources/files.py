"""Files as tables: repository and document scans, usage logs, exports, snapshots, upserts."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text
from skein.sources.tables import SCOPE

# Directories that are never scanned.
EXCLUDED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".tox", "target")
USAGE_SCHEMA = "ts timestamp, client_id string, scope string, tool string, tokens_in long, tokens_out long"


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), exclude: tuple[str, ...] = (), include_again: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), most_bytes: int = 1 << 20, most_files: int | None = None, content: bool = False, any_language: bool = False, under: tuple[str, ...] = ()) -> DataFrame:
    """relative_path, length, language and, if asked for, content of the files under root, by path.

    Kept: files with one of the extensions that match no exclude glob, or match an include_again
    glob; under a prefix; outside hidden and excluded directories; in a known language; of 1 to
    most_bytes bytes. The limit is taken after sorting by path. Contents are read only if asked for.
    any_language also keeps files in no known language; under names directories outside of which
    nothing is listed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if under:
        try:
            files = reader.load(f"{root.rstrip('/')}/{{{','.join(under)},__none__}}")
        except AnalysisException:  # none of them is there
            files = reader.load(root).limit(0)
    else:
        files = reader.load(root)
    base = F.regexp_replace(F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/"), r"/+$", "")
    full = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?/+", "/")
    rows = files.withColumn("relative_path", F.substring(full, F.length(base) + 2, F.lit(1 << 20)))
    p = F.col("relative_path")
    any_of = lambda globs: [text.matches_glob(p, g) for g in globs]
    fold = lambda conditions, empty: empty if not conditions else _any(conditions)
    keep = (F.col("length") > 0) & (F.col("length") <= most_bytes) & ~F.exists(F.split(p, "/"), lambda s: s.isin(*EXCLUDED) | (s.startswith(".") & (F.length(s) > 1))) & (F.lit(any_language) | (text.language(p) != "unknown"))
    if extensions:
        keep = keep & F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions])
    keep = keep & (~fold(any_of(exclude), F.lit(False)) | fold(any_of(include_again), F.lit(False)))
    if prefixes:
        keep = keep & _any([p.startswith(x) for x in prefixes])
    out = rows.filter(keep).select("relative_path", "length", text.language(p).alias("language"), *(["content"] if content else [])).orderBy("relative_path")
    return out if most_files is None else out.limit(most_files)


def literal_directories(globs: tuple[str, ...]) -> tuple[str, ...]:
    """The directories that globs begin with; none if one of them begins anywhere."""
    found = []
    for g in globs:
        parts = []
        for part in g.replace("\\", "/").strip().split("/")[:-1]:
            if re.search(r"[*?\[]", part):
                break
            if part not in ("", "."):
                parts.append(part)
        if not parts:
            return ()
        found.append("/".join(parts))
    return tuple(dict.fromkeys(found))


def scan_documents(spark: SparkSession, root: str, match: tuple[str, ...] = ("**/*.md", "**/*.mdx"), exclude: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), most_bytes: int = 1 << 20, most_files: int | None = None, content: bool = False) -> DataFrame:
    """relative_path, length and content (if asked for) of the Markdown files under root that a match glob names, by path; directories that globs begin with are listed alone."""
    found = scan(spark, root, ("md", "mdx", "markdown"), exclude, (), tuple(f"{p.rstrip('/')}/" for p in prefixes), most_bytes, None, content, True, literal_directories(match))
    kept = found.filter(_any([text.matches_glob(F.col("relative_path"), g) for g in match])).drop("language").orderBy("relative_path")
    return kept if most_files is None else kept.limit(most_files)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def ignored(paths: DataFrame, rules: list[str], path_col: str = "relative_path") -> DataFrame:
    """paths with ignored: the last rule that matches decides; a rule that begins with ! takes a path in again."""
    verdict = F.lit(False)
    for rule in rules:
        r = rule.strip()
        if not r or r.startswith("#"):
            continue
        again = r.startswith("!")
        glob = r.lstrip("!").strip("/")
        p = F.col(path_col)
        hit = text.matches_glob(p, glob) | text.matches_glob(p, f"{glob}/**") | text.matches_glob(p, f"**/{glob}/**")
        verdict = F.when(hit, F.lit(not again)).otherwise(verdict)
    return paths.withColumn("ignored", verdict)


def usage_log(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Usage events of JSON lines, both ends included; blank and malformed lines and those without a time are left out."""
    rows = spark.read.schema(USAGE_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter("ts is not null")
    rows = rows if start is None else rows.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    return rows if end is None else rows.filter(F.col("ts") <= F.lit(end).cast("timestamp"))


def export(df: DataFrame, scope: dict[str, str], path: str) -> DataFrame:
    """Writes the scope's rows as JSON lines, refusing rows with secrets in them; returns rows, checksum (of the sorted lines' hashes)."""
    own = df
    for k in SCOPE:
        own = own.filter(F.col(k) == scope[k])
    line = F.to_json(F.struct(*sorted(own.columns)))
    lines = own.select(line.alias("value"))
    if lines.filter(F.col("value").rlike(text.SECRET)).limit(1).count():
        raise ValueError("a row holds a secret")
    lines.write.mode("overwrite").text(path)
    return checksum(df.sparkSession.read.text(path))


def checksum(lines: DataFrame) -> DataFrame:
    """rows, checksum of a text table, whatever the order of its rows: sums of parts of their hashes."""
    h = F.sha2("value", 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return lines.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("-", *[F.coalesce(part(k), F.lit("0")) for k in range(4)]), 256).alias("checksum"))


def remapped(df: DataFrame, source: dict[str, str], target: dict[str, str], id_cols: tuple[str, ...] = (), json_cols: tuple[str, ...] = ()) -> DataFrame:
    """df moved from one scope to another: scope columns, and the project's name inside prefixed ids and JSON texts."""
    out = df
    for k in SCOPE:
        out = out.withColumn(k, F.when(F.col(k) == source[k], F.lit(target[k])).otherwise(F.col(k)))
    for c in id_cols + json_cols:
        for prefix in ("sym", "file", "ext:call", "unresolved", "doc"):
            out = out.withColumn(c, F.replace(c, F.lit(f"{prefix}:{source['project_id']}:"), F.lit(f"{prefix}:{target['project_id']}:")))
    return out


def write_vectors(df: DataFrame, path: str, dim: int, vector_col: str = "embedding") -> None:
    """A snapshot of vectors; one of another length is refused."""
    if df.filter(F.size(vector_col) != dim).limit(1).count():
        raise ValueError(f"a vector has not {dim} dimensions")
    df.withColumn("dim", F.lit(dim)).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    df = spark.read.parquet(path)
    if df.filter(F.col("dim") != dim).limit(1).count():
        raise ValueError(f"the snapshot has not {dim} dimensions")
    return df.drop("dim")


def upserted(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """current with changes (its columns, order, and deleted) applied: of each key the change that comes last."""
    s = F.struct(order, *[c for c in changes.columns if c != order])
    last = changes.groupBy(key).agg(F.max(s).alias("s")).select("s.*")
    kept = current.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter(~F.col("deleted")).select(*current.columns))


def without_scope(df: DataFrame, scope: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """What is left without a scope's rows, and how many rows each other scope and that one have."""
    own = F.lit(True)
    for k in SCOPE:
        own = own & F.col(k).eqNullSafe(F.lit(scope[k]))
    return df.filter(~own), df.groupBy(own.alias("removed")).agg(F.count(F.lit(1)).alias("rows"))


def publishable_hashes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_path, content_hash of files (file_path, content_hash, complete) that have symbols or were read in full."""
    has = symbols.select("file_path").distinct().withColumn("has", F.lit(True))
    return files.join(has, "file_path", "left").filter(F.coalesce("has", F.lit(False)) | F.col("complete")).select("file_path", "content_hash")


def sync_plan(known: DataFrame, current: DataFrame) -> DataFrame:
    """file_path, action (add, update or remove) from two maps of file_path to content_hash; what is unchanged is left out."""
    both = known.select("file_path", F.col("content_hash").alias("k")).join(current.select("file_path", F.col("content_hash").alias("c")), "file_path", "full")
    action = F.when(F.col("k").isNull(), "add").when(F.col("c").isNull(), "remove").when(F.col("k") != F.col("c"), "update")
    return both.select("file_path", action.alias("action")).filter("action is not null")
