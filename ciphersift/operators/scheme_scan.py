"""Regex tier: the scheme scan (J1) and scheme resolution.

J1 is logically ``lines ⋈ schemes ON line RLIKE pattern``.  The scheme side
is a driver-side catalog of bounded size (the 49 built-in rows plus the
user's custom rows), so instead of a nested-loop join every pattern becomes a
literal ``rlike`` inside one projection: each regex is compiled once per task,
the whole test stays in a codegen stage, and nothing is shuffled or
broadcast.  Two superset prefilters (whole text, then line) cut the work to
the few lines that can match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import go_trim, lit_struct_array
from ..functions.regex import java_regex, prefilter, translate
from ..sources.catalog import CLASS_SELECTORS, SUPPRESS_MARKER, Scheme, catalog_schemes
from .lines import explode_lines
from .post import suppressed

FINDING_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("remediation", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("column", T.IntegerType()),
    T.StructField("snippet", T.StringType()),
])
FINDING_COLUMNS = [f.name for f in FINDING_SCHEMA.fields]


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING_SCHEMA)


def _match_column(re2: str, text: Column) -> Column:
    """1-based byte column of the leftmost match (RE2 reports byte offsets;
    ``regexp_instr`` would count UTF-16 units)."""
    body = translate(re2)
    return (F.octet_length(F.regexp_extract(text, f"(?d)^(.*?)(?:{body})", 1)) + 1).cast("int")


def folded(text: Column) -> Column:
    """Lower-cased text with U+017F mapped to 's': the haystack for needles."""
    return F.translate(F.lower(text), "\u017f", "s")


def needle_gate(lt: Column, needles) -> Column:
    cond = None
    for n in needles:
        c = lt.contains(n)
        cond = c if cond is None else (cond | c)
    return cond


def scheme_hits(lines: DataFrame, schemes: list[Scheme], text: str = "text") -> DataFrame:
    """lines(..., text) -> (..., k, column) for every (line, scheme) match.

    A line is a candidate when its folded text holds a needle of some
    scheme (or, for custom schemes without needles, passes the boundary-free
    regex prefilter); per scheme the exact regex only runs behind that
    scheme's own needle test."""
    t = F.col(text)
    keep = [c for c in lines.columns if c != "folded"]
    cand = lines if "folded" in lines.columns else lines.withColumn("folded", folded(t))
    lt = F.col("folded")
    gated = [s for s in schemes if s.needles]
    free = [s for s in schemes if not s.needles]
    pre = None
    if gated:
        pre = needle_gate(lt, sorted({n for s in gated for n in s.needles}))
    if free:
        rx = t.rlike(prefilter([s.re2 for s in free]))
        pre = rx if pre is None else (pre | rx)
    cand = cand.where(pre)

    def hit(k, s):
        cond = t.rlike(java_regex(s.re2))
        if s.needles:
            cond = needle_gate(lt, s.needles) & cond
        return F.when(cond, F.struct(F.lit(k).alias("k"), _match_column(s.re2, t).alias("column")))

    hits = F.array(*[hit(k, s) for k, s in enumerate(schemes)])
    return cand.select(*keep, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")) \
        .select(*keep, F.col("h.k").alias("k"), F.col("h.column").alias("column"))


def _scheme_meta(schemes: list[Scheme]) -> Column:
    return lit_struct_array([{"rule_id": "scheme:" + s.name, "title": f"{s.title} ({s.cls})", "description": s.note,
                              "severity": s.severity, "remediation": s.remediation} for s in schemes])


def scheme_findings(docs: DataFrame, schemes: list[Scheme], *, path: str = "path", content: str = "content",
                    marker: str = SUPPRESS_MARKER) -> DataFrame:
    """J1 + P4-P10 + J7: docs(path, content) -> findings (confidence low) that no directive silences."""
    if not schemes:
        return empty_findings(docs.sparkSession)
    docs = docs.select(F.col(path).alias("path"), F.col(content).alias("content"))
    lines = explode_lines(docs, fold=folded, marker=marker)
    hits = scheme_hits(lines, schemes)
    m = F.element_at(_scheme_meta(schemes), F.col("k") + 1)
    hits = hits.where(~suppressed(m.rule_id, marker, F.col("text"), F.col("previous")))
    return hits.select(
        m.rule_id.alias("rule_id"), m.title.alias("title"), m.description.alias("description"),
        m.severity.alias("severity"), F.lit("low").alias("confidence"), m.remediation.alias("remediation"),
        F.col("path").alias("file"), F.col("line"), F.col("column"), go_trim(F.col("text")).alias("snippet"))


# ---------------------------------------------------------------------------
# Scheme resolution
# ---------------------------------------------------------------------------

def resolve_ords(token: Column, schemes: list[Scheme] | None = None, folded_token: Column | None = None) -> Column:
    """ARRAY<INT> of catalog ords a user token resolves to, in catalog order;
    empty for an unknown token, NULL for a blank one.

    Class selectors first, then an exact name, then every scheme whose own
    pattern matches the token (aliases such as ``sha-256`` or ``des3``).
    """
    cat = schemes or catalog_schemes()
    t = token if folded_token is not None else F.lower(go_trim(token))
    sel_map = F.create_map(*[x for name, classes in CLASS_SELECTORS.items() for x in (
        F.lit(name), F.array(*[F.lit(s.ord) for s in cat if s.cls in classes]).cast("array<int>"))])
    name_map = F.create_map(*[x for s in cat for x in (F.lit(s.name), F.lit(s.ord))])
    ft = folded_token if folded_token is not None else folded(t)

    def alias(s):
        cond = t.rlike(java_regex(s.re2))
        if s.needles:
            cond = needle_gate(ft, s.needles) & cond
        return F.when(cond, F.lit(s.ord))
    aliases = F.filter(F.array(*[alias(s) for s in cat]), lambda x: x.isNotNull())
    exact = F.element_at(name_map, t)
    return (F.when(t == "", F.lit(None).cast("array<int>"))
            .when(F.element_at(sel_map, t).isNotNull(), F.element_at(sel_map, t))
            .when(exact.isNotNull(), F.array(exact))
            .otherwise(aliases))


def resolve_tokens_df(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Per distinct token: (token, ord, name, class) rows; unknown tokens give none."""
    cat = catalog_schemes()
    names = F.array(*[F.lit(s.name) for s in cat])
    classes = F.array(*[F.lit(s.cls) for s in cat])
    # one generator over the resolution array: the 49-pattern expression is
    # evaluated exactly once per token (unknown tokens yield no row)
    # normalise once per distinct token; the normalised values come out of a
    # generator, so they are not substituted back into the 49 branches below
    t = F.lower(go_trim(F.col("token")))
    norm = tokens.select(F.col(token).alias("token")).distinct() \
        .select(F.inline(F.array(F.struct(F.col("token").alias("token"), t.alias("_t"),
                                          folded(t).alias("_ft")))))
    r = norm.select("token", F.explode(resolve_ords(F.col("_t"), cat, F.col("_ft"))).alias("ord"))
    return r.select("token", "ord", F.element_at(names, F.col("ord") + 1).alias("name"),
                F.element_at(classes, F.col("ord") + 1).alias("class"))


class UnknownSchemeError(ValueError):
    pass


def resolve(spark: SparkSession, tokens: list[str]) -> list[Scheme]:
    """Resolve user tokens (search mode) into schemes, distinct by name in
    first-added order.  Runs J15 on the tiny token list; the result is
    bounded by the catalog size."""
    if not tokens:
        return []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "pos int, token string")
    rows = df.select("pos", "token", resolve_ords(F.col("token")).alias("ords")).collect()
    cat = catalog_schemes()
    out: list[Scheme] = []
    seen: set[str] = set()
    for r in sorted(rows, key=lambda r: r.pos):
        if r.ords is None:
            continue
        if not r.ords:
            raise UnknownSchemeError(f"unknown scheme {r.token!r} (list the catalog to see known schemes)")
        for o in r.ords:
            s = cat[o]
            if s.name not in seen:
                seen.add(s.name)
                out.append(s)
    return out


def weak_schemes() -> list[Scheme]:
    """The default regex-tier set: broken + weak classes in catalog order."""
    return [s for s in catalog_schemes() if s.cls in CLASS_SELECTORS["weak"]]
