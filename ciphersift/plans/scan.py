"""The scan plan: corpus -> eligibility -> tier branches -> union ->
suppression -> disable / confidence / override -> order.

Physical shape: every tier branch reads the corpus with its own column
pruning and tier predicate; the regex tier never shuffles (lines are a
generator inside the scan task), the syntax tiers shuffle only their own
files by ``path`` once and run all token windows inside that partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.eligibility import classify, compile_globs, extension, pruned, root_is_pruned, with_rel
from ..operators.needle_index import catalog_findings, checked_catalog
from ..operators.post import post_process
from ..operators.scheme_scan import FINDING_COLUMNS, empty_findings, resolve, scheme_findings, weak_schemes
from ..session import ensure_parallelism
from ..sources.catalog import SUPPRESS_MARKER, Scheme
from ..sources.config import ScanConfig, load_config, parse_config


@dataclass
class ScanOptions:
    """Arguments of a scan.  ``None`` for ``include_unknown`` /
    ``min_confidence`` means "not given": the config value then applies."""

    include_unknown: bool | None = None
    min_confidence: str | None = None
    schemes: list[str] = field(default_factory=list)   # search mode tokens
    catalog: DataFrame | None = None    # user schemes (ord, id, pattern[, title, class, note, remediation]) as a table
    config: ScanConfig | dict | str | None = None
    max_file_bytes: int | None = None   # skip larger files; by default every file is scanned
    max_line_bytes: int | None = None   # give up on files with a longer line; by default none
    skip_binary: bool = False           # skip files with a NUL byte among their first 8,000 (for file trees)
    marker: str = SUPPRESS_MARKER       # what an inline suppression comment starts with
    python_syntax: bool = True   # parser-backed Python tier on (else Python uses the regex tier)
    root: str | None = None      # prefix stripped to get the relative path
    root_name: str | None = None  # name of the scanned directory itself
    sort: bool = True


@dataclass
class ScanResult:
    findings: DataFrame
    file_status: DataFrame

    def counts(self) -> dict[str, int]:
        """A2: files scanned / skipped / errors (one small aggregate)."""
        rows = self.file_status.groupBy("status").count().collect()
        d = {r["status"]: r["count"] for r in rows}
        return {"scanned": d.get("scanned", 0), "skipped": d.get("skipped", 0), "error": d.get("error", 0)}


class InvalidOption(ValueError):
    pass


def _config(opt) -> ScanConfig:
    if opt is None:
        return ScanConfig()
    if isinstance(opt, ScanConfig):
        return opt
    if isinstance(opt, dict):
        return parse_config(opt)
    return load_config(opt)


def classified_corpus(corpus: DataFrame, opts: ScanOptions, cfg: ScanConfig, search: bool,
                      include_unknown: bool, spread: bool = True) -> DataFrame | None:
    globs = compile_globs(cfg.exclude)
    if root_is_pruned(opts.root_name, globs):
        return None
    df = corpus.select("path", "content", "length", *[c for c in ("rel", "error") if c in corpus.columns])
    if spread:
        df = ensure_parallelism(df)
    df = with_rel(df, opts.root)
    df = df.where(~pruned(F.col("rel"), globs))
    return classify(df, search=search, include_unknown=include_unknown, python_syntax=opts.python_syntax,
                    max_file_bytes=opts.max_file_bytes, max_line_bytes=opts.max_line_bytes,
                    skip_binary=opts.skip_binary)


def tier_findings(spark: SparkSession, files: DataFrame, want: list[Scheme], search: bool = False,
                  probe: DataFrame | None = None, marker: str = SUPPRESS_MARKER,
                  catalog: DataFrame | None = None) -> DataFrame:
    """Union of the tier branches, without silenced findings.  A syntax branch is planned only when a
    ``limit(1)`` probe finds a file for it.  The probe reads the source as it
    is (no repartition), stops at the first hit and, when the tier is empty,
    costs less than the branch would."""
    scanned = files.where(F.col("status") == "scanned")
    regex = scanned.where(F.col("tier") == "regex")
    parts = [scheme_findings(regex, want, marker=marker)]
    if catalog is not None and not search:
        parts.append(catalog_findings(regex, catalog, marker))
    from ..operators import go_syntax, py_syntax
    if not search:
        # superset probes on the raw source: only an extension routes to Go;
        # Python needs its extension or a "#!" first line
        src = probe if probe is not None else files
        ext = extension(F.substring_index(F.col("path"), "/", -1))
        if not src.where(ext == ".go").select("path").isEmpty():
            parts.append(go_syntax.go_findings(scanned.where(F.col("tier") == "go"), marker))
        if not src.where(ext.isin(".py", ".pyw") | F.col("content").startswith("#!")).select("path").isEmpty():
            parts.append(py_syntax.py_findings(scanned.where(F.col("tier") == "python"), marker))
    parts = [p.select(*FINDING_COLUMNS) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)  # positional: every part has the finding columns in order
    return out


def scan(spark: SparkSession, corpus: DataFrame, options: ScanOptions | None = None) -> ScanResult:
    """Scan a corpus(path, content, length) DataFrame."""
    opts = options or ScanOptions()
    cfg = _config(opts.config)
    min_conf = opts.min_confidence if opts.min_confidence is not None else (cfg.min_confidence or "low")
    if min_conf not in ("low", "high"):
        raise InvalidOption(f"invalid min_confidence {min_conf!r} (want low or high)")
    include_unknown = opts.include_unknown if opts.include_unknown is not None else cfg.include_unknown
    searched = resolve(spark, opts.schemes) if opts.schemes else []
    search = bool(searched)
    want = searched if search else weak_schemes() + list(cfg.custom_schemes)

    files = classified_corpus(corpus, opts, cfg, search, include_unknown)
    if files is None:
        empty_status = spark.createDataFrame([], "path string, status string, reason string")
        return ScanResult(empty_findings(spark), empty_status)

    catalog = checked_catalog(opts.catalog) if opts.catalog is not None and not search else None
    kept = tier_findings(spark, files, want, search, corpus.select("path", "content"), opts.marker, catalog)
    findings = post_process(kept, disabled=cfg.disable, min_confidence=min_conf,
                            severity_overrides=cfg.severity, sort=opts.sort)
    return ScanResult(findings, files.select("path", "status", "reason"))
