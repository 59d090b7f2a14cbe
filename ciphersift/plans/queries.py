"""Registered queries: one per operator family of the inventory, each a
function ``(spark, sf_dir) -> DataFrame`` over the given tables (or a corpus
Spark derives from them), so its work grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import go_syntax, py_syntax
from ..operators.lines import explode_lines
from ..operators.needle_index import catalog_findings, checked_catalog
from ..operators.scheme_scan import resolve_tokens_df, scheme_findings
from ..operators.tokens import partition_by_path
from ..session import ensure_parallelism
from ..sources.code_corpus import code_corpus
from ..sources.config import custom_scheme, parse_config
from ..sources.corpus import from_rows, read_table, text_table_corpus
from ..sources.prose_code import prose_code
from .report import (catalog_lines, json_report_fragments, rules_fired, sarif_fragments, scan_errors, severity_summary,
                     summary_frame, text_report_lines)
from .scan import ScanOptions, classified_corpus, scan

# FIXED VALUES used by the registered queries (inputs, not results).
CUSTOM_CONFIG = {
    "custom_schemes": [
        {"id": "internal-xor", "title": "Home-grown XOR", "class": "broken", "pattern": r"(?i)\bxor_encrypt\b",
         "remediation": "Use AEAD."},
        {"id": "vigenere", "pattern": r"\bvigen[eè]re\b"},
        {"id": "le-pa", "class": "legacy", "pattern": r"(?i)\ble pa[a-zé]*"},
        {"id": "and-the", "class": "contextual", "pattern": r"\band the\b"},
        {"id": "md5", "pattern": r"(?i)\bdes\b"},
    ]
}
DIALECT = [
    r"(?i)\bTh[a-e]+\b", r"\p{Lu}\p{Ll}{3,5}?", r"\p{Greek}+|\p{Cyrillic}", r"[a&&b]\w", r"(?:\b)+an", r"\B[^\W\d_]{4}\B",
    r"(?U)t.*e", r"(?s)e.{2,}?a", r"[[:upper:]][[:^alpha:]]", r"[^\x00-\x7F]+", r"(?i)[k-s]{3}", r"(?i:IN)g", r"\Qa.\E?b", r"^\S+",
    r"\w+\.$", r"(?m)^[A-Z].{4}", r"(?P<first>o)(?:u|(?-i)U)", r"a{2}|e{2,}|o{0,2}n", r"[\]x-]|[]y]", r"\pN+\x2E?\d", r"\x{e9}|\351",
    r"(?i)straße|ſ", r"(a|ab)(c|bcd)?", r"(x*)*y", r"[\d\-.]+[,;]", r"t(?:h(?:e(?:r)?)?)?\b", r"\ae?|\PL{3}", r"{", r"(?i)[^a-y\W]",
]
EXCLUDES = ["skip/**", "*.min.js", "**/notes*.txt", "bin/"]
DISABLED = ["scheme:md5", "weak-hash-sha1", "scheme:cbc"]
OVERRIDES = {"scheme:des": "critical", "scheme:sha1": "low", "weak-hash-md5": "info"}


def _docs(spark, sf_dir, table="documents"):
    return text_table_corpus(spark, sf_dir, table)


def _text_scan(spark, sf_dir, table, **kw) -> DataFrame:
    opts = ScanOptions(include_unknown=True, sort=False, **kw)
    return scan(spark, _docs(spark, sf_dir, table), opts).findings


def scan_documents_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + P4-P10 + J1: the default weak-scheme scan over ``documents``."""
    return _text_scan(spark, sf_dir, "documents")


def scan_pages_weak(spark, sf_dir):
    return _text_scan(spark, sf_dir, "pages")


def scan_benchmark_weak(spark, sf_dir):
    return _text_scan(spark, sf_dir, "benchmark")


def scan_conversations_custom(spark, sf_dir):
    """U1 + P19: weak set plus custom schemes (case-sensitive unless (?i))."""
    return _text_scan(spark, sf_dir, "conversations", config=CUSTOM_CONFIG)


def regex_dialect(spark, sf_dir):
    """2.11: patterns over the whole RE2 grammar on every line of ``conversations``: lines matched, and their columns."""
    schemes = [custom_scheme(f"p{k}", p, ord=k) for k, p in enumerate(DIALECT)]
    hits = scheme_findings(_docs(spark, sf_dir, "conversations"), schemes)
    return hits.groupBy("rule_id").agg(F.count("*").alias("lines"), F.sum("column").alias("columns"))


def search_all_inventory(spark, sf_dir):
    """Search mode with the ``all`` selector (49 schemes) on documents."""
    return _text_scan(spark, sf_dir, "documents", schemes=["all"])


def user_catalog(spark, sf_dir):
    """A catalog of user schemes in the shape the scan takes: a phrase pattern for every two neighbouring words of
    ``benchmark`` and a word pattern for every longer word of it."""
    words = F.regexp_extract_all(F.col("content"), F.lit("[A-Za-z]+"), 0)
    w = _docs(spark, sf_dir, "benchmark").select(words.alias("w")).where(F.size("w") > 0)
    pairs = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct(
        F.get("w", i - 1).alias("a"), F.get("w", i).alias("b")))).alias("p")).select("p.*")
    phrase = pairs.where("b IS NOT NULL").select(F.concat_ws(" ", F.lower("a"), F.lower("b")).alias("id")).distinct().select(
        "id", F.concat(F.lit("(?i)\\b"), "id", F.lit("\\b")).alias("pattern"), F.lit("legacy").alias("class"))
    word = pairs.where(F.length("a") >= 6).select(F.col("a").alias("id")).distinct().select(
        "id", F.concat(F.lit("\\b"), "id", F.lit("[a-z]*")).alias("pattern"), F.lit("contextual").alias("class"))
    return phrase.union(word).withColumn("ord", F.xxhash64("id", "pattern"))


def search_user_catalog(spark, sf_dir):
    """J1 / 2.14 with a catalog of thousands of user schemes kept as a table: a needle index, no literal patterns."""
    docs = classified_corpus(_docs(spark, sf_dir), ScanOptions(), parse_config({}), False, True)
    return catalog_findings(docs.where("status = 'scanned'"), checked_catalog(user_catalog(spark, sf_dir)))


def search_strong_sha256(spark, sf_dir):
    """E2 on the code corpus: an alias token resolving to one strong scheme."""
    opts = ScanOptions(schemes=["SHA-256", "keccak"], sort=False)
    return scan(spark, code_corpus(spark, sf_dir), opts).findings


def resolve_tokens(spark, sf_dir):
    """Every distinct word of ``documents`` resolved against the catalog
    (class selectors, exact names, then aliases via each scheme's matcher)."""
    words = _docs(spark, sf_dir).select(F.explode(F.split(F.lower("content"), r"[\t\n\r ,.;:!?()\"]+")).alias("token"))
    words = words.where(F.col("token") != "")
    return resolve_tokens_df(words).where(F.col("ord").isNotNull()).select("token", "name", "class")


def catalog_inventory(spark, sf_dir):
    """K6 listing line per catalog scheme with its hit count over documents."""
    hits = search_all_inventory(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return catalog_lines(spark).join(hits, "rule_id", "left") \
        .select("ord", "listing", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def line_split(spark, sf_dir):
    """(file, line, text) of every document line."""
    docs = ensure_parallelism(_docs(spark, sf_dir))
    return explode_lines(docs).select(F.col("path").alias("file"), "line", "text")


def _code_files(spark, sf_dir, **kw):
    opts = ScanOptions(**kw)
    from .scan import _config
    cfg = _config(opts.config)
    return classified_corpus(code_corpus(spark, sf_dir), opts, cfg, bool(opts.schemes),
                             bool(opts.include_unknown))


def lang_detect(spark, sf_dir):
    """P1-P3 on the code corpus: (path, lang, tier)."""
    return _code_files(spark, sf_dir).select("path", "lang", F.coalesce("tier", F.lit("none")).alias("tier"))


def skip_dirs(spark, sf_dir):
    """files left after skipped-directory pruning."""
    return _code_files(spark, sf_dir).select("path")


def exclude_globs(spark, sf_dir):
    """files left after exclude globs (basename and relative-path forms)."""
    return _code_files(spark, sf_dir, config={"exclude": EXCLUDES}).select("path")


def file_status_counts(spark, sf_dir):
    """A2: files by status and reason for the default code-corpus scan."""
    st = _code_files(spark, sf_dir)
    return st.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")) \
        .agg(F.count(F.lit(1)).alias("files"))


def binary_sniff(spark, sf_dir):
    """F5 in both forms: files without a NUL, with a first one, with one behind the sniffed bytes; by option and status."""
    docs = read_table(spark, sf_dir, "documents")
    form = F.pmod("doc_id", F.lit(3))
    content = F.when(form == 0, F.col("text")).when(form == 1, F.concat(F.lit("\0"), "text")).otherwise(
        F.concat("text", F.repeat(F.lit(" "), 8000), F.lit("\0")))
    files = from_rows(docs, F.concat_ws("/", form.cast("string"), F.col("doc_id").cast("string")), content)
    parts = [classified_corpus(files, ScanOptions(skip_binary=sniff), parse_config({}), False, True).select(
        F.substring_index("path", "/", 1).cast("bigint").alias("form"), F.lit(sniff).alias("sniff"), "status")
        for sniff in (True, False)]
    return parts[0].union(parts[1]).groupBy("form", "sniff", "status").agg(F.count("*").alias("files"))


def _code_search(spark, sf_dir, **kw):
    opts = ScanOptions(schemes=["weak"], sort=False, **kw)
    return scan(spark, code_corpus(spark, sf_dir), opts).findings


def suppression_antijoin(spark, sf_dir):
    """Inline directives silence their own and the next line."""
    return _code_search(spark, sf_dir)


def disabled_antijoin(spark, sf_dir):
    """Disabled rule ids are dropped."""
    return _code_search(spark, sf_dir, config={"rules": {"disable": DISABLED}})


def severity_override(spark, sf_dir):
    """Severities replaced by rule id after filtering."""
    return _code_search(spark, sf_dir, config={"rules": {"severity": OVERRIDES}})


def code_scan_default(spark, sf_dir):
    """The default scan of the code corpus, all three tiers."""
    return scan(spark, code_corpus(spark, sf_dir), ScanOptions(sort=False)).findings


def min_confidence_high(spark, sf_dir):
    """only syntax-tier (high confidence) findings remain."""
    return scan(spark, code_corpus(spark, sf_dir), ScanOptions(sort=False, min_confidence="high",
                                                               include_unknown=True)).findings


def severity_summary_documents(spark, sf_dir):
    """A1/A3: findings by severity for the documents scan."""
    return severity_summary(scan_documents_weak(spark, sf_dir))


def rules_fired_code(spark, sf_dir):
    """A5: distinct rules with their first finding in report order."""
    return rules_fired(code_scan_default(spark, sf_dir))


def report_text_lines(spark, sf_dir):
    """K4: text report lines (file:line:col severity [rule] title (conf))."""
    return text_report_lines(code_scan_default(spark, sf_dir))


def _go_sig(spark, sf_dir):
    files = _code_files(spark, sf_dir).where((F.col("tier") == "go") & (F.col("status") == "scanned"))
    return go_syntax.go_sig_tokens(partition_by_path(files.select("path", "content")))


def go_tokens(spark, sf_dir):
    """Significant Go tokens with byte columns and nesting depth."""
    return _go_sig(spark, sf_dir).select("path", "tok", "line", "col", F.col("dbefore").alias("depth"))


def go_imports(spark, sf_dir):
    """Go imports as (path, local, import_path)."""
    return go_syntax.go_imports(_go_sig(spark, sf_dir))


def go_calls(spark, sf_dir):
    """Package-qualified Go calls."""
    return go_syntax.go_calls(_go_sig(spark, sf_dir))


def go_findings(spark, sf_dir):
    """Go syntax-tier findings (before suppression)."""
    files = _code_files(spark, sf_dir).where((F.col("tier") == "go") & (F.col("status") == "scanned"))
    return go_syntax.go_findings(files)


def py_findings(spark, sf_dir):
    """Python syntax-tier findings (before suppression)."""
    files = _code_files(spark, sf_dir).where((F.col("tier") == "python") & (F.col("status") == "scanned"))
    return py_syntax.py_findings(files)


def py_attributes(spark, sf_dir):
    """Attribute facts with their last two components."""
    files = _code_files(spark, sf_dir).where((F.col("tier") == "python") & (F.col("status") == "scanned"))
    return py_syntax.py_attributes(py_syntax.py_sig_tokens(partition_by_path(files.select("path", "content"))))


def py_from_imports(spark, sf_dir):
    """From-import bindings."""
    files = _code_files(spark, sf_dir).where((F.col("tier") == "python") & (F.col("status") == "scanned"))
    return py_syntax.py_from_imports(py_syntax.py_sig_tokens(partition_by_path(files.select("path", "content"))))


def _prose_sig(spark, sf_dir, ext):
    files = ensure_parallelism(prose_code(spark, sf_dir).where(F.col("path").endswith(ext)).select("path", "content"))
    sig = py_syntax.py_sig_tokens if ext == ".py" else go_syntax.go_sig_tokens
    return sig(partition_by_path(files))


def py_calls(spark, sf_dir):
    """Python calls with their first positional integer and string, f-string interpolations included."""
    return py_syntax.py_calls(_prose_sig(spark, sf_dir, ".py"))


def py_bindings(spark, sf_dir):
    """From-import bindings, also in one-line compound statements and after semicolons."""
    return py_syntax.py_from_imports(_prose_sig(spark, sf_dir, ".py"))


def go_selectors(spark, sf_dir):
    """Package selectors, called or not."""
    return go_syntax.go_selectors(_prose_sig(spark, sf_dir, ".go"))


def go_call_args(spark, sf_dir):
    """The first two arguments of package calls."""
    return go_syntax.go_call_args(_prose_sig(spark, sf_dir, ".go"))


def prose_code_findings(spark, sf_dir):
    """All thirteen syntax-tier rules on programs below real text."""
    files = ensure_parallelism(prose_code(spark, sf_dir).select("path", "content"))
    found = go_syntax.go_findings(files.where(F.col("path").endswith(".go"))).union(
        py_syntax.py_findings(files.where(F.col("path").endswith(".py"))))
    return found.select("file", "line", "column", "rule_id")


GO_RULE_QUERIES = {
    "go_weak_func": ("weak-hash-md5", "weak-hash-sha1", "weak-hash-md4", "weak-cipher-des", "weak-cipher-3des",
                     "weak-cipher-rc4", "weak-cipher-blowfish"),
    "go_rsa_small": ("weak-key-rsa",),
    "go_weak_rand": ("insecure-random",),
    "go_hardcoded_key": ("hardcoded-key",),
    "go_static_iv": ("static-iv",),
    "go_weak_tls": ("deprecated-tls",),
}


def _go_rule_query(rules):
    def q(spark, sf_dir):
        return go_findings(spark, sf_dir).where(F.col("rule_id").isin(*rules))
    return q


def _code_scan(spark, sf_dir):
    """The default code-corpus scan, with files that cannot be read beside it."""
    lost = from_rows(read_table(spark, sf_dir, "benchmark"), F.concat(F.lit("lost/"), F.col("item_id").cast("string"), F.lit(".c")),
                     F.lit(None).cast("string"))
    return scan(spark, code_corpus(spark, sf_dir).unionByName(lost), ScanOptions(sort=False))


def report_json(spark, sf_dir):
    """The JSON report, errors included, as (position, text); in order the texts form the document."""
    res = _code_scan(spark, sf_dir)
    c = res.counts()
    return json_report_fragments(res.findings, c["scanned"], c["skipped"], scan_errors(res.file_status))


def report_sarif(spark, sf_dir):
    """The SARIF 2.1.0 report as (position, text)."""
    return sarif_fragments(_code_scan(spark, sf_dir).findings)


def report_summary(spark, sf_dir):
    """K5, A4, O2: the summary line and the gate."""
    res = _code_scan(spark, sf_dir)
    return summary_frame(res.findings, res.file_status)


QUERIES = {
    "scan_documents_weak": scan_documents_weak,
    "scan_pages_weak": scan_pages_weak,
    "scan_benchmark_weak": scan_benchmark_weak,
    "scan_conversations_custom": scan_conversations_custom,
    "regex_dialect": regex_dialect,
    "search_all_inventory": search_all_inventory,
    "search_strong_sha256": search_strong_sha256,
    "search_user_catalog": search_user_catalog,
    "resolve_tokens": resolve_tokens,
    "catalog_inventory": catalog_inventory,
    "line_split": line_split,
    "lang_detect": lang_detect,
    "skip_dirs": skip_dirs,
    "exclude_globs": exclude_globs,
    "file_status_counts": file_status_counts,
    "binary_sniff": binary_sniff,
    "suppression_antijoin": suppression_antijoin,
    "disabled_antijoin": disabled_antijoin,
    "severity_override": severity_override,
    "code_scan_default": code_scan_default,
    "min_confidence_high": min_confidence_high,
    "severity_summary": severity_summary_documents,
    "rules_fired": rules_fired_code,
    "report_text_lines": report_text_lines,
    "go_tokens": go_tokens,
    "go_imports": go_imports,
    "go_calls": go_calls,
    "go_findings": go_findings,
    "py_attributes": py_attributes,
    "py_from_imports": py_from_imports,
    "py_findings": py_findings,
    "py_calls": py_calls,
    "py_bindings": py_bindings,
    "go_selectors": go_selectors,
    "go_call_args": go_call_args,
    "prose_code_findings": prose_code_findings,
    **{k: _go_rule_query(v) for k, v in GO_RULE_QUERIES.items()},
    "report_json": report_json,
    "report_sarif": report_sarif,
    "report_summary": report_summary,
}
