"""Eligibility and routing: path pruning (F1-F3), size / binary / language
filters (F4-F6, F10), language detection (P1, P2) and tier routing (P3).

All of it is row-local column arithmetic on ``corpus(path, content, length)``:
no join, no shuffle.  The small language tables are literal maps.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import go_base, go_trim, lit_map
from ..functions.regex import GO_SPACE_CLASS, glob_to_regex
from ..sources.catalog import LANG_BY_EXT, LANG_BY_SHEBANG, SKIP_DIRS
from .lines import has_overlong_line


SNIFFED_BYTES = 8_000  # FIXED VALUE: what the binary sniff looks at

def with_rel(df: DataFrame, root: str | None) -> DataFrame:
    """Slash path relative to the scan root (findings keep ``path``); a source may bring it as ``rel``."""
    p = F.col("path")
    if "rel" in df.columns:
        rel = F.col("rel")
    elif root:
        prefix = root.rstrip("/")
        rel = F.when(p.startswith(prefix + "/"), F.expr(f"substring(path, {len(prefix) + 2})")).otherwise(p)
    else:
        rel = p
    return df.withColumns({"rel": rel, "base": F.substring_index(rel, "/", -1)})


def compile_globs(patterns: list[str]) -> list[tuple[str, bool]]:
    """(java regex, match basename?) per non-blank glob.  A trailing
    ``/`` is trimmed for the regex but still counts as "has a slash"."""
    out = []
    for p in patterns or []:
        p = p.strip()
        if not p:
            continue
        out.append((glob_to_regex(p[:-1] if p.endswith("/") else p), "/" not in p))
    return out


def glob_match(globs: list[tuple[str, bool]], rel: str, base: str) -> bool:
    """Driver-side check for the root directory itself."""
    for rx, on_base in globs:
        java = rx.replace("\\z", "$").replace("(?d)", "")
        if re.match(java, base if on_base else rel):
            return True
    return False


def root_is_pruned(root_name: str | None, globs: list[tuple[str, bool]]) -> bool:
    """The walk starts at the root: a root named like a skipped directory or
    matching an exclude yields nothing at all."""
    if not root_name:
        return False
    return root_name in SKIP_DIRS or glob_match(globs, ".", root_name)


def pruned(rel: Column, globs: list[tuple[str, bool]]) -> Column:
    """True when the file, or any directory above it, is skipped (F1) or
    excluded (F2)."""
    parts = F.split(rel, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    cond = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS]))
    base = F.try_element_at(parts, F.lit(-1))
    dir_rels = F.transform(dirs, lambda x, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    def matcher(rx):
        return lambda d: d.rlike(rx)

    for rx, on_base in globs:
        if on_base:
            cond = cond | base.rlike(rx) | F.exists(dirs, matcher(rx))
        else:
            cond = cond | rel.rlike(rx) | F.exists(dir_rels, matcher(rx))
    return F.coalesce(cond, F.lit(False))


def is_binary(content: Column) -> Column:
    """F5, an option: a NUL byte among the first ``SNIFFED_BYTES`` of the content."""
    head = F.substring(content.cast("binary"), 1, SNIFFED_BYTES)
    return F.coalesce(F.contains(head, F.lit(b"\x00")), F.lit(False))


def extension(base: Column) -> Column:
    """Lower-cased final extension of the base name ('' when none)."""
    return F.lower(F.regexp_extract(base, "(\\.[^./]*)\\z", 1))


def shebang_language(content: Column) -> Column:
    """Interpreter of a ``#!`` first line: basename of the last field,
    else of the first field without ``#!``."""
    first = F.regexp_replace(F.substring_index(content, "\n", 1), "\r\\z", "")
    fields = F.split(go_trim(first), GO_SPACE_CLASS + "+")
    by_name = lit_map(dict(LANG_BY_SHEBANG))
    last = F.element_at(by_name, go_base(F.try_element_at(fields, F.lit(-1))))
    head = F.element_at(by_name, go_base(F.regexp_replace(F.try_element_at(fields, F.lit(1)), "^#!", "")))
    return F.when(content.startswith("#!"), F.coalesce(last, head))


def classify(df: DataFrame, *, search: bool, include_unknown: bool, python_syntax: bool,
             max_file_bytes: int | None = None, max_line_bytes: int | None = None,
             skip_binary: bool = False) -> DataFrame:
    """Adds ``lang``, ``tier`` (go | python | regex | NULL) and the file's
    ``status`` (scanned | skipped | error) with its ``reason``.

    Sizes, line lengths and NUL bytes drop nothing unless the caller asks for it.
    Content that could not be read (NULL) is an error, never "scanned"."""
    ext = extension(F.col("base"))
    ext_lang = F.element_at(lit_map({e: l for e, l, _ in LANG_BY_EXT}), ext)
    lang = F.coalesce(ext_lang, shebang_language(F.col("content")), F.lit("unknown"))
    # out of a generator: what follows reads a column, and filters on tier and status do not repeat the expression
    df = df.select("*", F.inline(F.array(F.struct(lang.alias("lang")))))
    lang_c = F.col("lang")
    if search:
        tier = F.lit("regex")
    else:
        tier = (F.when(lang_c == "go", "go")
                .when((lang_c == "python") & F.lit(python_syntax), "python")
                .when(lang_c != "unknown", "regex")
                .when(F.lit(include_unknown), "regex"))
    df = df.withColumn("tier", tier)
    content = F.col("content")
    reasons = []
    if max_file_bytes is not None:
        reasons.append((F.col("length") > max_file_bytes, "too large"))
    if "error" in df.columns:
        reasons.insert(0, (F.col("error").isNotNull(), F.col("error")))
    reasons.append((content.isNull(), "unreadable"))
    if skip_binary:
        reasons.append((is_binary(content), "binary"))
    reasons.append((F.col("tier").isNull(), "unknown language"))
    if max_line_bytes is not None:
        reasons.append(((F.col("tier") == "regex") & has_overlong_line(content, max_line_bytes), "line too long"))
    reason = F.lit(None).cast("string")
    for cond, name in reversed(reasons):
        reason = F.when(cond, name).otherwise(reason)
    failed = F.col("reason").isin("line too long", "unreadable")
    if "error" in df.columns:
        failed = failed | F.col("error").isNotNull()
    return df.withColumn("reason", reason) \
        .withColumn("status", F.when(F.col("reason").isNull(), "scanned").when(failed, "error").otherwise("skipped"))
