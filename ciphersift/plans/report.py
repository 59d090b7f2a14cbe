"""Sinks and aggregates over the findings table.

Large outputs stay distributed: the JSON and SARIF documents are produced as
numbered text fragments (one per finding plus the envelope), written with
``write.text`` in order, so no single task or the driver ever holds the
whole document.  Only small aggregates (counts by status, by severity and by
partition) are collected.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import sarif_level, severity_rank
from ..session import cut_lineage
from ..sources.catalog import (RULES, SARIF_SCHEMA, TOOL_NAME, TOOL_URI, TOOL_VERSION, catalog_schemes)

ORDER = ["file", "line", "column", "rule_id"]


def catalog_lines(spark: SparkSession) -> DataFrame:
    """K6: ``%-14s %-8s %s`` of name, class, title in catalog order (pads,
    never cuts)."""
    rows = [(s.ord, "scheme:" + s.name, s.name, s.cls, s.title) for s in catalog_schemes()]
    df = spark.createDataFrame(rows, "ord int, rule_id string, name string, class string, title string")
    return df.select("ord", "rule_id", F.format_string("%-14s %-8s %s", "name", "class", "title").alias("listing"))


def severity_summary(findings: DataFrame) -> DataFrame:
    """A1 + A3: findings per severity, ranked (partial + final aggregate)."""
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings")) \
        .select("severity", severity_rank(F.col("severity")).alias("rank"), "findings")


def summary_line(findings: DataFrame, file_status: DataFrame) -> str:
    """K5: ``Scanned N files (M skipped); K finding(s): sev=n ...``."""
    counts = {r["status"]: r["n"] for r in file_status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    sev = severity_summary(findings).orderBy(F.desc("rank")).collect()
    total = sum(r["findings"] for r in sev)
    s = f"Scanned {counts.get('scanned', 0)} files ({counts.get('skipped', 0)} skipped); {total} finding(s)"
    if sev:
        s += ":" + "".join(f" {r['severity']}={r['findings']}" for r in sev)
    if counts.get("error", 0):
        s += f"\n{counts['error']} error(s) during scan"
    return s


def summary_frame(findings: DataFrame, file_status: DataFrame) -> DataFrame:
    """K5, A4, O2 as one row (text, gate): :func:`summary_line` and whether anything was found, from two small aggregates."""
    none = F.lit(None).cast("int")
    rows = file_status.groupBy("status").agg(F.count("*").alias("n")).select(F.col("status").alias("name"), none.alias("rank"), "n")
    sev = severity_summary(findings).select(F.col("severity").alias("name"), "rank", F.col("findings").alias("n"))
    of = lambda status: F.coalesce(F.sum(F.when(F.col("rank").isNull() & (F.col("name") == status), F.col("n"))), F.lit(0))
    each = F.when(F.col("rank").isNotNull(), F.struct((-F.col("rank")).alias("o"), F.format_string(" %s=%d", "name", "n").alias("t")))
    got = rows.union(sev).agg(of("scanned").alias("scanned"), of("skipped").alias("skipped"), of("error").alias("errors"),
                              F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), F.col("n"))), F.lit(0)).alias("found"),
                              F.array_sort(F.collect_list(each)).alias("sev"))
    text = F.concat(F.format_string("Scanned %d files (%d skipped); %d finding(s)", "scanned", "skipped", "found"),
                    F.when(F.col("found") > 0, F.concat(F.lit(":"), F.array_join(F.col("sev.t"), ""))).otherwise(""),
                    F.when(F.col("errors") > 0, F.format_string("\n%d error(s) during scan", "errors")).otherwise(""))
    return got.select(text.alias("text"), (F.col("found") > 0).alias("gate"))


def has_findings(findings: DataFrame) -> bool:
    """A4: the CI gate (exit code 1 when anything was found)."""
    return not findings.isEmpty()


def rules_fired(findings: DataFrame) -> DataFrame:
    """A5: each rule once, with its first finding in report order."""
    first = F.min(F.struct("file", "line", "column"))
    return findings.groupBy("rule_id").agg(first.alias("f"), F.min_by("title", F.struct(*ORDER)).alias("title")) \
        .select("rule_id", "title", F.col("f.file").alias("first_file"), F.col("f.line").alias("first_line"),
                F.col("f.column").alias("first_column"))


def _numbered(findings: DataFrame) -> DataFrame:
    """``nth``: 1, 2, ... among findings with one report key (a custom scheme may repeat a built-in one)."""
    rest = ("title", "description", "severity", "confidence", "remediation", "snippet")
    return findings.withColumn("nth", F.row_number().over(Window.partitionBy(*ORDER).orderBy(*rest)))


def text_report_lines(findings: DataFrame) -> DataFrame:
    """K4: report lines keyed by the finding order (k = 0 header, 1 snippet,
    2 fix; 3 more for each further finding of the same key)."""
    header = F.format_string("%s:%d:%d %s [%s] %s (%s)", "file", "line", "column", "severity", "rule_id", "title",
                             "confidence")
    parts = F.array(
        F.struct(F.lit(0).alias("k"), header.alias("text")),
        F.when(F.col("snippet") != "", F.struct(F.lit(1).alias("k"), F.concat(F.lit("    "), "snippet").alias("text"))),
        F.when(F.col("remediation") != "",
               F.struct(F.lit(2).alias("k"), F.concat(F.lit("    fix: "), "remediation").alias("text"))),
    )
    return _numbered(findings).select(*ORDER, "nth", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")) \
        .select(*ORDER, (F.col("p.k") + (F.col("nth") - 1) * 3).alias("k"), "p.text")


def _omit_empty(c: Column, empty) -> Column:
    return F.when(c != F.lit(empty), c)


def finding_json(findings: DataFrame) -> Column:
    """One finding as the reference's JSON object (empty remediation and
    snippet and a zero column are omitted)."""
    return F.to_json(F.struct(
        "rule_id", "title", "description", "severity", "confidence",
        _omit_empty(F.col("remediation"), "").alias("remediation"), "file", "line",
        _omit_empty(F.col("column"), 0).alias("column"), _omit_empty(F.col("snippet"), "").alias("snippet")))


def in_positions(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(rows with ``position`` 0, 1, ... in the given order, their number).

    Rows are range-partitioned by the order, sorted within partitions and
    written once (reliable checkpoint); a row's position is its place in its
    partition after the counts of the partitions before.  The driver sees one
    count per partition.  There is no window, and what made the rows is
    evaluated once.  Rows that tie are told apart by all their columns.
    """
    rest = [c for c in rows.columns if c not in order]
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order, *rest))
    part = F.spark_partition_id()
    placed = placed.withColumns({"part": part, "place": F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)})
    counts = dict(map(tuple, placed.groupBy("part").count().collect()))
    starts, total = {}, 0
    for k in sorted(counts):
        starts[k], total = total, total + counts[k]
    start = F.create_map(*[F.lit(x) for k, n in starts.items() for x in (k, n)])[F.col("part")] if starts else F.lit(0)
    return placed.withColumn("position", (start + F.col("place")).cast("bigint")).drop("part", "place"), total


def _listed(rows: DataFrame, text: Column, first: int) -> DataFrame:
    """Fragments of a JSON list from ``first`` on: every one but the first begins with its comma."""
    comma = F.when(F.col("position") > 0, F.lit(",")).otherwise(F.lit(""))
    return rows.select((F.col("position") + first).alias("position"), F.concat(comma, text).alias("text"))


def _ends(spark: SparkSession, texts: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(texts, "position bigint, text string")


def scan_errors(file_status: DataFrame) -> DataFrame:
    """(path, message) of every file or directory that could not be scanned."""
    message = F.when(F.contains(F.col("reason"), F.col("path")), F.col("reason")).otherwise(
        F.concat("path", F.lit(": "), "reason"))
    return file_status.where("status = 'error'").select("path", message.alias("message"))


def json_report_fragments(findings: DataFrame, files_scanned: int, files_skipped: int,
                          errors: DataFrame | None = None) -> DataFrame:
    """K2 + A8 as (position, text); concatenated in order the texts are the JSON envelope.  ``errors``: see
    :func:`scan_errors`; without any, the envelope has no ``errors``."""
    spark = findings.sparkSession
    placed, n = in_positions(findings, ORDER)
    head = ('{"tool":' + json.dumps(TOOL_NAME) + ',"version":' + json.dumps(TOOL_VERSION)
            + f',"files_scanned":{files_scanned},"files_skipped":{files_skipped},"findings":[')
    out = _listed(placed, finding_json(placed), 1)
    failed, k = in_positions(errors, ["path", "message"]) if errors is not None else (None, 0)
    if not k:
        return out.union(_ends(spark, [(0, head), (n + 1, "]}")]))
    quoted = F.expr("substring(to_json(struct(message AS m)), 6, length(to_json(struct(message AS m))) - 6)")
    return out.union(_listed(failed, quoted, n + 2)).union(
        _ends(spark, [(0, head), (n + 1, '],"errors":['), (n + k + 2, "]}")]))


def sarif_rule_fragments(findings: DataFrame) -> DataFrame:
    """K3 ``rules``: each fired rule once, in first-seen order, with help
    text for syntax-tier rules."""
    help_map = F.create_map(*[x for rid, _t, _d, _s, rem in RULES for x in (F.lit(rid), F.lit(rem))])
    first = F.struct(*ORDER, "title", "description")
    fired = findings.groupBy("rule_id").agg(F.min(first).alias("f")).select("f.*")
    rule = F.to_json(F.struct(
        F.col("rule_id").alias("id"), F.col("title").alias("name"),
        F.struct(F.col("title").alias("text")).alias("shortDescription"),
        F.struct(F.col("description").alias("text")).alias("fullDescription"),
        F.struct(F.coalesce(F.element_at(help_map, F.col("rule_id")), F.lit("")).alias("text")).alias("help"),
        F.struct(F.array(F.lit("cryptography"), F.lit("security")).alias("tags")).alias("properties")))
    return fired.select(*ORDER, rule.alias("rule"))


def sarif_fragments(findings: DataFrame) -> DataFrame:
    """K3 as (position, text): header, rules, middle, results, footer."""
    spark = findings.sparkSession
    driver = {"name": TOOL_NAME, "version": TOOL_VERSION, "informationUri": TOOL_URI}
    head = ('{"$schema":' + json.dumps(SARIF_SCHEMA) + ',"version":"2.1.0","runs":[{"tool":{"driver":'
            + json.dumps(driver, separators=(",", ":"))[:-1] + ',"rules":[')
    placed, n = in_positions(findings, ORDER)
    rules, k = in_positions(sarif_rule_fragments(placed), ORDER)
    result = F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("description").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"),
                                  F.struct(F.col("line").alias("startLine"),
                                           _omit_empty(F.col("column"), 0).alias("startColumn")).alias("region"))
                         .alias("physicalLocation"))).alias("locations"),
        F.struct(_omit_empty(F.col("confidence"), "").alias("confidence")).alias("properties")))
    return _listed(rules, F.col("rule"), 1).union(_listed(placed, result, k + 2)).union(
        _ends(spark, [(0, head), (k + 1, ']}},"results":['), (n + k + 2, "]}]}")]))


def write_document(fragments: DataFrame, path: str) -> None:
    """Write fragments in document order as text part files; their
    concatenation in file-name order is the document."""
    in_order(fragments).select("text").write.mode("overwrite").text(path)


def in_order(fragments: DataFrame) -> DataFrame:
    return fragments.orderBy("position")


def write_findings(findings: DataFrame, path: str, partition_by_severity: bool = False) -> None:
    """K1: the findings table as Parquet."""
    w = findings.write.mode("overwrite")
    if partition_by_severity:
        w = w.partitionBy("severity")
    w.parquet(path)


FORMATS = ("text", "json", "sarif")


class UnknownFormat(ValueError):
    pass


def render(result, fmt: str, path: str) -> None:
    """Write a scan result as a text, JSON or SARIF document under ``path``
    (part files in document order; see :func:`write_document`)."""
    if fmt not in FORMATS:
        raise UnknownFormat(f"unknown format {fmt!r} (want text, json, or sarif)")
    if fmt == "json":
        c = result.counts()
        frags = json_report_fragments(result.findings, c["scanned"], c["skipped"], scan_errors(result.file_status))
    elif fmt == "sarif":
        frags = sarif_fragments(result.findings)
    else:
        lines = text_report_lines(result.findings).select(F.lit(1).alias("part"), *ORDER, "k", "text")
        tail = result.findings.sparkSession.createDataFrame(
            [(2, "\n" + summary_line(result.findings, result.file_status))], "part int, text string") \
            .select("part", *[F.lit(None).cast(t).alias(c) for c, t in
                              (("file", "string"), ("line", "int"), ("column", "int"), ("rule_id", "string"))],
                    F.lit(0).alias("k"), "text")
        lines.unionByName(tail).orderBy("part", *ORDER, "k").select("text").write.mode("overwrite").text(path)
        return
    write_document(frags, path)
