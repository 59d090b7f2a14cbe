"""Post-processing of the findings fact table: inline suppression (F9/J7),
disabled rules (F8/J13), minimum confidence (F7), severity override
(P12/J14) and the report order (O1).  Order kept: suppress -> disable ->
confidence -> override -> sort."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import confidence_rank, lit_map
from ..functions.regex import translate
from ..sources.catalog import CONFIDENCE_RANK

# the directive grammar (RE2) behind the marker: boundary, blanks, id list
DIRECTIVE_RE2 = r"\b[ \t]*([\w:.,\-]*)"


def _silences(line: Column, rule: Column, marker: str) -> Column:
    """The line holds a directive for the rule: a bare one, ``all``, or the rule's id in its list."""
    rx = "(?d)" + translate(re.escape(marker) + DIRECTIVE_RE2)
    ids = F.regexp_extract(line, rx, 1)
    named = (ids == "") | (ids == "all") | F.array_contains(F.split(ids, "[, ]"), rule)
    return F.coalesce(line.contains(marker) & line.rlike(rx) & named, F.lit(False))


def suppressed(rule: Column, marker: str, line: Column, previous: Column) -> Column:
    """A directive on the finding's line or on the one before silences it.

    Both lines are at hand where findings are made (the line generator and the
    snippets split the text anyway), so this is a test of the row: no directive
    table, no second read of the corpus, no join.
    """
    return _silences(line, rule, marker) | _silences(previous, rule, marker)


def post_process(findings: DataFrame, *, disabled: list[str] | None = None, min_confidence: str | None = None,
                 severity_overrides: dict[str, str] | None = None, sort: bool = True) -> DataFrame:
    f = findings
    if disabled:
        # F8: the disabled list is part of the driver-side config: a literal IN
        f = f.where(~F.col("rule_id").isin(list(disabled)))
    if min_confidence:
        f = f.where(confidence_rank(F.col("confidence")) >= CONFIDENCE_RANK.get(min_confidence, 0))
    if severity_overrides:
        f = f.withColumn("severity", F.coalesce(F.element_at(lit_map(severity_overrides), F.col("rule_id")),
                                                F.col("severity")))
    if sort:
        f = f.orderBy("file", "line", "column", "rule_id")
    return f
