"""The confidence lattice of edges, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lattice, its ladder, and the classes that cap.
RANKS = {"unresolved": 0, "external": 1, "ambiguous": 2, "probable": 3, "exact": 4}
LADDER = ("unresolved", "ambiguous", "probable", "exact")
EVIDENCE_CAPS = {
    "exact": "exact", "ambiguous": "ambiguous", "di": "probable", "dynamic": "probable", "reflection": "ambiguous",
    "monkeypatch": "ambiguous", "monkey_patch": "ambiguous", "unresolved": "unresolved", "runtime_trace": "exact",
}
PACKAGE_VIA = ("package_manifest", "package_alias", "tsconfig_paths", "cargo", "go_replace")
INJECTION_VIA = ("di_injection", "framework_route", "dynamic_dispatch", "di", "dynamic")
REFLECTION_VIA = ("reflection", "monkeypatch", "monkey_patch")
RUNTIME_VIA = ("runtime_trace", "runtime_observed")
USE_TYPES = ("CALLS", "IMPORTS", "HTTP_CALLS", "ASYNC_CALLS", "ROUTES_TO")
WEAK = ("ambiguous", "unresolved")


def _looked_up(key: Column, table: dict, default: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default)


def rank(c: Column) -> Column:
    """0 to 4; null and unknown strings are 0."""
    return _looked_up(c, RANKS, F.lit(0))


def parsed(c: Column) -> Column:
    """Null and blank are exact, unknown words probable (rank() has such words at 0)."""
    t = F.trim(c)
    return F.when(t.isNull() | (t == ""), F.lit("exact")).when(t.isin(*RANKS), t).otherwise(F.lit("probable"))


def meets(c: Column, floor: str | None) -> Column:
    """Whether c is at least floor; no floor lets all pass."""
    return F.lit(True) if floor is None else rank(c) >= RANKS.get(floor, 0)


def boosted(c: Column) -> Column:
    """One step up the ladder; external becomes probable."""
    return _looked_up(c, {"external": "probable", "unresolved": "ambiguous", "ambiguous": "probable", "probable": "exact", "exact": "exact"}, c)


def demoted(c: Column) -> Column:
    """One step down; external stays, unknown words become unresolved."""
    return _looked_up(c, {"external": "external", "exact": "probable", "probable": "ambiguous", "ambiguous": "unresolved", "unresolved": "unresolved"}, F.lit("unresolved"))


def clamped(c: Column, source_language: Column, target_language: Column, via: Column) -> Column:
    """c under the caps of edges between languages and of the way they were resolved; a runtime observation boosts instead."""
    a, b = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (source_language, target_language))
    by = F.replace(F.lower(F.trim(F.coalesce(via, F.lit("")))), F.lit("-"), F.lit("_"))
    c = F.when((a != "") & (b != "") & (a != b) & (c == "exact"), F.lit("probable")).otherwise(c)
    c = F.when(by.isin(*PACKAGE_VIA, *INJECTION_VIA) & (c == "exact"), F.lit("probable")).otherwise(c)
    c = F.when(by.isin(*REFLECTION_VIA) & c.isin("exact", "probable"), F.lit("ambiguous")).otherwise(c)
    return F.when(by.isin(*RUNTIME_VIA), boosted(c)).otherwise(c)


def of_evidence(evidence_class: Column) -> Column:
    return _looked_up(F.replace(F.lower(F.trim(F.coalesce(evidence_class, F.lit("")))), F.lit("-"), F.lit("_")), EVIDENCE_CAPS, F.lit("unresolved"))


def is_use(rel_type: Column) -> Column:
    return rel_type.isin(*USE_TYPES)


def is_weak_use(rel_type: Column, confidence: Column) -> Column:
    return is_use(rel_type) & parsed(confidence).isin(*WEAK)


def is_strong_use(rel_type: Column, confidence: Column) -> Column:
    return is_use(rel_type) & ~parsed(confidence).isin(*WEAK)


def is_blast(target_id: Column, is_external: Column, confidence: Column, floor: str | None) -> Column:
    """Edges to symbols of the project, not marked external, at the floor or above."""
    return ~F.coalesce(is_external, F.lit(False)) & target_id.startswith("sym:") & meets(confidence, floor)
