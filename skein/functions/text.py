"""String functions as column expressions: paths, tokens, keys, redaction, addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists.
TEST_DIRS = ("tests", "test", "spec", "specs", "__tests__")
SECRET = r"(?i)((?:api[_-]?key|token|password|secret)\s*[:=]\s*)([^\s,;]+)"
WORD = r"(?U)([^\W\d][\w‌‍]{1,63})"
PLAIN_WORD = "[a-z0-9][a-z0-9_-]*"
SECURITY_WORDS = ("auth", "password", "token", "secret", "crypto", "permission", "acl", "oauth", "jwt", "session", "encrypt", "decrypt", "login", "signup", "credential")
ENTRY_NAME = (
    r"^(main|__main__|handler|lambda_handler|lifespan|get_db|middleware|errorHandler|on_[a-z].*|handle_[a-z].*|test_.*|Test[A-Z].*|Page|Layout|Default|Template|Loading|Error|NotFound|"
    r"generateMetadata|generateStaticParams|generateViewport|GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)$"
)
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java"}


def path(c: Column) -> Column:
    """With forward slashes; null is empty."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))


def base_name(c: Column) -> Column:
    return F.substring_index(path(c), "/", -1)


def is_test_path(c: Column) -> Column:
    """A path with a test directory in it, or with a test file's name."""
    name = base_name(c)
    by_name = name.rlike(r"(?i)^test_") | name.rlike(r"(?i)(_test|\.test|\.spec|_spec)\..+$") | name.rlike(r"Tests?\.py$")
    return F.exists(F.split(F.lower(path(c)), "/"), lambda s: s.isin(*TEST_DIRS)) | by_name


def language(c: Column) -> Column:
    """By the path's extension; unknown without one that is known."""
    out = F.lit("unknown")
    extension = F.lower(F.regexp_extract(path(c), r"\.([A-Za-z0-9]+)$", 1))
    for k, v in LANGUAGES.items():
        out = F.when(extension == k, F.lit(v)).otherwise(out)
    return out


def is_entry_name(name: Column) -> Column:
    return name.rlike(ENTRY_NAME)


def names_security(*cols: Column) -> Column:
    return F.lower(F.concat_ws(" ", *cols)).rlike("|".join(SECURITY_WORDS))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: * and ? stay in a segment's text as fnmatch has it, **/ matches no directories too.

    A bare word matches a directory of that name in any case.
    """
    g = glob.replace("\\", "/").strip()
    if g and not re.search(r"[*?\[/.]", g):
        return f"(?i)(^|.*/){re.escape(g)}(/.*|$)"
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("/**", i) and i + 3 == len(g):
            out, i = out + "(?:/.*)?", i + 3
        elif g[i] == "*":
            out, i = out + ".*", i + (2 if g.startswith("**", i) else 1)
        elif g[i] == "?":
            out, i = out + ".", i + 1
        else:
            out, i = out + re.escape(g[i]), i + 1
    return out


def matches_glob(c: Column, glob: str) -> Column:
    """On the whole path or on the base name."""
    p = F.lit(f"^(?:{glob_pattern(glob)})$")
    return F.regexp_like(path(c), p) | F.regexp_like(base_name(c), p)


def words(c: Column) -> Column:
    """Lower-cased words of letters, digits and joiners, from two characters, not beginning with a digit; Arabic yeh and kaf are folded."""
    folded = F.translate(F.coalesce(c, F.lit("")), "يك", "یک")
    return F.regexp_extract_all(F.lower(folded), F.lit(WORD), F.lit(1))


def plain_words(c: Column) -> Column:
    """The distinct words of a-z, 0-9, _ and - with two characters or more, sorted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({PLAIN_WORD})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: F.length(w) > 1)))


def question_key(c: Column) -> Column:
    """A question as its words, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({PLAIN_WORD})"), F.lit(1)), " ")


def redacted(c: Column) -> Column:
    """Values after the names of secrets become [REDACTED]."""
    return F.regexp_replace(c, SECRET, "$1[REDACTED]")


def url_path(c: Column) -> Column:
    """An address without scheme, host, query, fragment and trailing slash, beginning with a slash; null and blank are empty."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(raw, r"^[^/?#]*://[^/]*", ""), r"[?#].*$", "")
    rest = F.regexp_replace(F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)), r"/+$", "")
    return F.when(raw == "", F.lit("")).when(rest == "", F.lit("/")).otherwise(rest)


def word_estimate(c: Column) -> Column:
    """Token estimate by words, at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")))


def char_estimate(c: Column, least: int = 0) -> Column:
    """Token estimate of a quarter of the characters, rounded up."""
    return F.greatest(F.lit(least), F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int"))


def id_number(c: Column) -> Column:
    """An unsigned 64-bit number of a reference: the first 16 hex digits of its SHA-256, as decimal(20)."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_bucket(c: Column, dims: int) -> Column:
    """The dimension that a word adds to in a hashed embedding: the first 8 bytes of its SHA-256, by dims."""
    return (id_number(c) % F.lit(dims)).cast("int")


def searchable(name: Column, qualified_name: Column, signature: Column, file_path: Column, documentation: Column, body: Column, body_limit: int = 800) -> Column:
    """What a symbol is searched by: its parts that aren't empty, the path with spaces for slashes and dots, and the body's beginning."""
    parts = [name, qualified_name, signature, F.translate(path(file_path), "/.", "  "), documentation, F.substring(body, 1, body_limit)]
    return F.concat_ws(" ", *[F.nullif(F.coalesce(p, F.lit("")), F.lit("")) for p in parts])
