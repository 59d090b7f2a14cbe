"""Token fact tables (X1-X5 Go, X6-X8 Python).

The parser-backed tiers are re-expressed as facts over a token stream:

* ``regexp_extract_all`` cuts a text into lossless tokens (comments and
  string literals are single tokens, so nothing inside them can match);
  ``posexplode`` turns them into rows inside the task that read the file.
* The corpus is hash-partitioned by ``path`` once; every window below is
  partitioned by ``path`` or by ``(path, level)``, which that partitioning
  already satisfies, so no further shuffle happens.  Windows only use
  running frames or whole-partition frames (linear time).
* Bracket nesting makes calls, arguments and attribute chains contiguous
  inside one ``(path, level)`` partition: a call's parentheses and the name
  before them sit at one level, its arguments one level deeper.
* What a fact needs of a token's neighbours is worked out where the tokens
  first lie in order; only the rows and columns that a fact reads go on to
  the sorts by level (most tokens are no brackets, commas or names of calls).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# FIXED VALUES: token grammars (Java syntax; possessive quantifiers keep the
# matcher from recursing on long literals).  Alternatives in order.
GO_TOKEN_RE = (
    r"(?s)//[^\n]*+|/\*.*?\*/|`[^`]*+`|\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'"
    r"|[\p{L}_][\p{L}\p{Nd}_]*+|[0-9][0-9A-Za-z_.]*+|[\t\n\x0B\f\r ]++|."
)
PY_STRING_RE = (
    r"[rRbBuUfF]{0,2}(?:'''(?:[^'\\]++|\\.|'(?!''))*+'''|\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\""
    r"|'(?:[^'\\\n]++|\\.)*+'|\"(?:[^\"\\\n]++|\\.)*+\")"
)


def _bracketed(opening: str, closing: str, depth: int) -> str:
    """Text between brackets that nest up to ``depth`` times; brackets in strings do not count."""
    inner = f"|{_bracketed(r'[(\[{]', r'[)\]}]', depth - 1)}" if depth else ""
    return rf"{opening}(?:[^()\[\]{{}}'\"]++|{PY_STRING_RE}{inner})*+{closing}"


NESTED = 3  # brackets within an interpolation; f-strings within f-strings
#: One interpolation ``{...}`` of an f-string, and the expression that it begins with.
PY_ISLAND_RE = _bracketed(r"\{", r"\}", NESTED)
PY_ISLAND_EXPR_RE = rf"(?s)^(?:[^()\[\]{{}}'\":!]++|{PY_STRING_RE}|{_bracketed(r'[(\[{]', r'[)\]}]', NESTED - 1)}|!=)*+"
#: Literal text, an escape or an interpolation of an f-string.
PY_PIECE_RE = rf"(?s)\\N\{{[^}}]*+\}}|\{{\{{|\}}\}}|{PY_ISLAND_RE}|(?:[^{{}}\\]++|\\[^{{])++|."


def _f_string(quote: str, plain: str) -> str:
    return rf"{quote}(?:[^{plain}\\{{}}]++|\\N\{{[^}}]*+\}}|\\[^{{]|\{{\{{|\}}\}}|{PY_ISLAND_RE}|[{{}}\\]"


PY_F_PREFIX = "(?:[fF][rR]?|[rR][fF])"
PY_TOKEN_RE = (
    r"(?s)#[^\n]*+"
    rf"|{PY_F_PREFIX}(?:{_f_string("'''", "'")}|'(?!''))*+'''|{_f_string('\"\"\"', '\"')}|\"(?!\"\"))*+\"\"\""
    rf"|{_f_string("'", "'" + chr(92) + "n")})*+'|{_f_string('\"', '\"' + chr(92) + 'n')})*+\")"
    rf"|{PY_STRING_RE}"
    r"|[\p{L}_][\p{L}\p{Nd}_]*+|[0-9][0-9A-Za-z_.]*+|\\\n|[\t\n\x0B\f\r ]++|."
)
PY_F_STRING_RE = rf"(?s)^{PY_F_PREFIX}['\"].*\{{"

OPENS = ("(", "[", "{")
CLOSES = (")", "]", "}")
IDENT_RE = r"^[\p{L}_][\p{L}\p{Nd}_]*$"


def is_ident(c: Column) -> Column:
    return c.rlike(IDENT_RE)


def partition_by_path(docs: DataFrame) -> DataFrame:
    """One shuffle of the (syntax-tier) files so that all token windows are
    co-partitioned.

    The count is the session's ``spark.sql.shuffle.partitions`` on purpose:
    AQE would coalesce by the size of the files, not of the token rows they
    explode into (about 10x more), which leaves too few tasks for the windows
    (measured: 39-45 s instead of 30 s for the sf0.1 code scan)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(n, "path")


def _as_tokens(texts: Column, code: bool) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("tok"), F.lit(code).alias("code")))


def python_tokens(code: Column, nested: int = NESTED) -> Column:
    """ARRAY<STRUCT<tok, code>> of a Python text; what the tokens hold, put together, is the text.

    An f-string is an island of code in a string: its interpolations are cut
    out by brace depth and tokenised in place, nested ones too, so each token
    keeps its offset.  The string's own text, conversions and format
    specifications are tokens that are no code.
    """
    raw = F.regexp_extract_all(code, F.lit(PY_TOKEN_RE), 0)
    if not nested:
        return _as_tokens(raw, True)

    def one(t):
        alone = F.array(F.struct(t.alias("tok"), F.lit(True).alias("code")))
        return F.when(t.rlike(PY_F_STRING_RE), _pieces(t, nested)).otherwise(alone)

    return F.when(code.rlike(PY_F_PREFIX + "['\"]"), F.flatten(F.transform(raw, one))).otherwise(_as_tokens(raw, True))


def _pieces(text: Column, nested: int) -> Column:
    """The pieces of an f-string or of a format specification."""
    brace = lambda b: F.array(F.struct(F.lit(b).alias("tok"), F.lit(True).alias("code")))

    def one(p):
        inner = F.substr(p, F.lit(2), F.length(p) - 2)
        head = F.regexp_extract(inner, PY_ISLAND_EXPR_RE, 0)
        rest = F.substr(inner, F.length(head) + 1)
        spec = _as_tokens(F.array(rest), False)
        if nested > 1:
            spec = F.when(rest.contains("{"), _pieces(rest, nested - 1)).otherwise(spec)
        island = F.concat(brace("{"), python_tokens(head, nested - 1), spec, brace("}"))
        return F.when(p.startswith("{") & (F.length(p) > 1) & (p != "{{"), island).otherwise(_as_tokens(F.array(p), False))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PY_PIECE_RE), 0), one))


def token_rows(docs: DataFrame, tokens: Column, insignificant_re: str, breaks: bool = False) -> DataFrame:
    """(path, content) -> significant tokens with positions and nesting.

    ``tokens``: ARRAY<STRUCT<tok, code>> of ``content``.  Columns: path, i
    (token ordinal), tok, line, col (1-based byte column), dbefore/dafter
    (bracket depth before/after the token), head (the first significant token
    of the file) and, with ``breaks``, brk (line breaks so far that stand
    between tokens, not inside one).
    """
    toks = docs.select("path", F.posexplode(tokens).alias("i", "t")).select("path", "i", "t.*")
    w = Window.partitionBy("path").orderBy("i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    nbytes = F.octet_length("tok")
    significant = F.col("code") & ~F.col("tok").rlike(insignificant_re)
    # bytes up to and including the last newline inside the token
    head = F.regexp_extract(F.col("tok"), "(?s)^(.*\n)", 1)
    nl_end = F.when(head != "", F.col("off0") + F.octet_length(head))
    delta = F.when(~F.col("code"), 0).when(F.col("tok").isin(*OPENS), 1).when(F.col("tok").isin(*CLOSES), -1).otherwise(0)
    sums = {
        "off0": F.coalesce(F.sum(nbytes).over(before), F.lit(0)),
        "line": (F.coalesce(F.sum(F.size(F.split("tok", "\n", -1)) - 1).over(before), F.lit(0)) + 1).cast("int"),
        "dafter": F.sum(delta).over(sofar).cast("int"), "dbefore": F.coalesce(F.sum(delta).over(before), F.lit(0)).cast("int"),
        "head": F.first(F.when(significant, F.col("tok")), ignorenulls=True).over(sofar),
    }
    keep = ["path", "i", "tok", "line", "col", "dafter", "dbefore", "head"]
    if breaks:
        blank = F.when(F.col("code") & F.col("tok").rlike("^[\\t\\n\\x0B\\f\\r ]+$"), F.size(F.split("tok", "\n", -1)) - 1)
        sums["brk"] = F.coalesce(F.sum(blank).over(before), F.lit(0))
        keep.append("brk")
    toks = toks.withColumns(sums)
    toks = toks.withColumn("col", (F.col("off0") - F.coalesce(F.max(nl_end).over(before), F.lit(0)) + 1).cast("int"))
    return toks.where(significant).select(*keep)


def with_neighbours(sig: DataFrame, lags: int, leads: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """Adds tok_m1..tok_mN (previous significant tokens) and tok_p1..tok_pM
    (next ones), plus position of the next token, in one window pass."""
    w = Window.partitionBy("path").orderBy("i")
    cols = [F.lag("tok", k).over(w).alias(f"tok_m{k}") for k in range(1, lags + 1)]
    cols += [F.lead("tok", k).over(w).alias(f"tok_p{k}") for k in range(1, leads + 1)]
    cols += [F.lag("line", k).over(w).alias(f"line_m{k}") for k in range(1, lags + 1)]
    cols += [F.lag("col", k).over(w).alias(f"col_m{k}") for k in range(1, lags + 1)]
    cols += [F.lead("line", 1).over(w).alias("line_p1"), F.lead("col", 1).over(w).alias("col_p1")]
    for name, c in (extra or {}).items():
        cols.append(c.over(w).alias(name))
    return sig.select("*", *cols)


def group_level() -> Column:
    """The level a token belongs to; an open bracket belongs to its own inside.

    Ordered by position inside ``(path, level)``, an open bracket is followed
    by what stands directly inside it, then by its close bracket, then by the
    next open bracket.  So a group needs no number, and rows between brackets
    that no fact reads can be left out."""
    return F.when(F.col("tok").isin(*OPENS), F.col("dafter")).otherwise(F.col("dbefore"))


def next_in_level(c: str) -> Column:
    """The next value of a column, nulls left out, inside ``(path, glvl)``."""
    return F.expr(f"lead({c}, 1) IGNORE NULLS OVER (PARTITION BY path, glvl ORDER BY i)")


def with_chain_levels(sig: DataFrame) -> DataFrame:
    """Chain view: tokens at one nesting level in order, so that
    ``name ( ... ) . attr`` is contiguous (its inside sits one level deeper).
    Adds ``clvl``, level-local neighbours ``ltok_m1..2`` and ``lnp``, the last
    token at this level before this one that is not a parenthesis."""
    is_close = F.col("tok").isin(*CLOSES)
    sig = sig.withColumn("clvl", F.when(is_close, F.col("dafter")).otherwise(F.col("dbefore")))
    w = Window.partitionBy("path", "clvl").orderBy("i")
    return sig.select("*", *[F.lag("tok", k).over(w).alias(f"ltok_m{k}") for k in (1, 2)],
                      F.last(F.when(~F.col("tok").isin("(", ")"), F.col("tok")), ignorenulls=True)
                      .over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("lnp"))
