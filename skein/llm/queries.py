"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm.bpe import op4_bpe
from skein.llm.eod import op10_token_counts
from skein.llm.hosts import OP3_SQL, op3_hosts
from skein.llm.html import op5_html
from skein.llm.lines import OP9_SQL, op9_lines
from skein.llm.merkle import OP8_SQL, op8_fingerprints
from skein.llm.packing import op2_packing
from skein.llm.periodic import op11_runs
from skein.llm.quality import op1_quality
from skein.llm.repair import OP13_SQL, op13_repair
from skein.llm.rules import OP7_SQL, op7_rules
from skein.llm.simhash import op6_simhash
from skein.llm.toxicity import op12_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_hosts": op3_hosts,
    "op4_bpe": op4_bpe,
    "op5_html": op5_html,
    "op6_simhash": op6_simhash,
    "op7_rules": op7_rules,
    "op8_fingerprints": op8_fingerprints,
    "op9_lines": op9_lines,
    "op10_token_counts": op10_token_counts,
    "op11_runs": op11_runs,
    "op12_toxicity": op12_toxicity,
    "op13_repair": op13_repair,
}
ORACLE_SQL: dict[str, str] = {"op3_hosts": OP3_SQL, "op7_rules": OP7_SQL, "op8_fingerprints": OP8_SQL, "op9_lines": OP9_SQL, "op13_repair": OP13_SQL}
