"""Go syntax tier (J2-J6, J8 on facts X1-X5).

Facts come from :mod:`.tokens`; detection is a join of call / argument /
selector facts with the file's imports (X2) and the detector tables.  No
scopes are resolved: an imported name shadowed by a local still fires, an
unimported name never does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import go_trim, lit_map, lit_struct_map
from ..sources.catalog import (GO_IV_CONSTRUCTORS, GO_KEY_ARGS, GO_RSA_FUNCS, GO_WEAK_FUNCS, GO_WEAK_RAND_PATHS,
                               GO_WEAK_TLS_NAMES, RSA_MIN_BITS, RULES)
from .post import suppressed
from .scheme_scan import FINDING_COLUMNS, needle_gate
from .tokens import (CLOSES, GO_TOKEN_RE, OPENS, group_level, is_ident, next_in_level, partition_by_path, token_rows,
                     with_neighbours)

GO_INSIGNIFICANT = r"(?s)^(?:[\t\n\x0B\f\r ]+|//.*|/\*.*)$"
ARG_END = (",", ")")


def _is_string(t: Column) -> Column:
    return t.startswith('"') | t.startswith("`")


def go_sig_tokens(docs: DataFrame) -> DataFrame:
    """Significant Go tokens with neighbours, import and call marks."""
    tokens = F.transform(F.regexp_extract_all(F.col("content"), F.lit(GO_TOKEN_RE), 0),
                         lambda t: F.struct(t.alias("tok"), F.lit(True).alias("code")))
    # without a package clause a file is no Go source: it has no facts
    sig = token_rows(docs, tokens, GO_INSIGNIFICANT).where("head = 'package'").drop("head")
    w = Window.partitionBy("path").orderBy("i")
    # is this token inside the most recent top-level "import (" group?
    top_open = F.col("tok").isin(*OPENS) & (F.col("dbefore") == 0)
    sig = sig.withColumn("prev", F.lag("tok", 1).over(w))
    sig = sig.withColumn("in_import", F.coalesce(
        F.last(F.when(top_open, F.coalesce(F.col("prev") == "import", F.lit(False))), ignorenulls=True).over(w), F.lit(False)))
    sig = with_neighbours(sig.drop("prev"), lags=4, leads=8)
    is_call = ((F.col("tok") == "(") & is_ident(F.col("tok_m1")) & (F.col("tok_m2") == ".")
               & is_ident(F.col("tok_m3")) & (F.coalesce(F.col("tok_m4"), F.lit("")) != ".")
               & (F.col("line_m1") == F.col("line")))
    return sig.withColumn("is_call", F.coalesce(is_call, F.lit(False)))


def _import_spec() -> tuple[Column, Column, Column]:
    """(the token is an import path that binds a name, the name, the path)."""
    t = F.col("tok")
    named = (is_ident(F.col("tok_m1")) & (F.col("tok_m1") != "import")) | F.col("tok_m1").isin("_", ".")
    single = (F.col("tok_m1") == "import") | ((F.col("tok_m2") == "import") & named)
    grouped = F.col("in_import") & (F.col("dbefore") == 1)
    path = F.regexp_extract(t, r"(?s)^[\"`](.*)[\"`]$", 1)
    alias = F.when(named, F.col("tok_m1"))
    is_spec = _is_string(t) & (single | grouped) & F.coalesce(~alias.isin("_", "."), F.lit(True))
    return is_spec, F.coalesce(alias, F.substring_index(path, "/", -1)), path


def go_imports(sig: DataFrame) -> DataFrame:
    """(path, local, import_path); the last spec wins on a repeated name;
    blank and dot imports bind nothing."""
    is_spec, local, path = _import_spec()
    spec = sig.where(is_spec).select("path", "i", local.alias("local"), path.alias("import_path"))
    w = Window.partitionBy("path", "local").orderBy(F.desc("i"))
    return spec.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("path", "local", "import_path")


def go_calls(sig: DataFrame) -> DataFrame:
    """Package-qualified calls (path, pkg, fn, line, col)."""
    return sig.where("is_call").select("path", F.col("tok_m3").alias("pkg"), F.col("tok_m1").alias("fn"),
                                       F.col("line_m3").alias("line"), F.col("col_m3").alias("col"))


def _is_selector() -> Column:
    return F.coalesce(is_ident(F.col("tok")) & (F.col("tok_m1") == ".") & is_ident(F.col("tok_m2"))
                      & (F.coalesce(F.col("tok_m3"), F.lit("")) != "."), F.lit(False))


def go_selectors(sig: DataFrame) -> DataFrame:
    """``pkg.Name`` selectors, called or not."""
    return sig.where(_is_selector()).select("path", F.col("tok_m2").alias("pkg"), F.col("tok").alias("name"),
                                            F.col("line_m2").alias("line"), F.col("col_m2").alias("col"))


def arg_facts(sig: DataFrame, also: Column | None = None, own: Column | None = None) -> DataFrame:
    """X5 on the token before each of the first two arguments of a package call: ``anchor``, and the predicates on
    the argument (F11-F13).  A comma after the last argument, or inside a literal, starts no argument.

    Only brackets, commas and the rows of ``also`` (with ``own``, a column of the caller's) are read."""
    tok, no = F.col("tok"), F.lit(False)
    t = [None] + [F.col(f"tok_p{k}") for k in range(1, 9)]
    bytes_of = (t[1] == "[") & (t[2] == "]") & (t[3] == "byte")
    converted = bytes_of & (t[4] == "(") & _is_string(t[5]) & (
        ((t[6] == ")") & t[7].isin(*ARG_END)) | ((t[6] == ",") & (t[7] == ")") & t[8].isin(*ARG_END)))
    literal = F.coalesce(_is_string(t[1]) & t[2].isin(*ARG_END), no) | F.coalesce(converted, no)
    made = (t[1] == "make") & (t[2] == "(") & (t[3] == "[") & (t[4] == "]") & (t[5] == "byte") & t[6].isin(*ARG_END)
    # the brackets whose ends the predicates ask for
    asked = ((tok == "(") & (F.col("tok_m1") == "make")) | ((tok == "{") & (F.col("tok_m1") == "byte"))
    nested = tok.isin(*OPENS, *CLOSES, ",")
    also = no if also is None else also
    of_call = lambda c: F.when(F.col("is_call"), F.col(c))
    rows = sig.where(nested | also).select(
        "path", "i", "tok", "is_call", "line_p1", "col_p1", F.when(nested, group_level()).alias("glvl"), (~nested).alias("beside"),
        F.when(tok.isin(*OPENS), F.struct("is_call", of_call("tok_m3").alias("pkg"), of_call("tok_m1").alias("fn"),
                                          of_call("line_m3").alias("pline"), of_call("col_m3").alias("pcol"))).alias("opened"),
        F.when(tok.isin(*CLOSES), F.coalesce(F.col("tok_p1"), F.lit(""))).alias("close_next"),
        F.coalesce(~t[1].isin(")", ","), no).alias("starts"), literal.alias("literal"),
        F.coalesce(bytes_of & (t[4] == "{"), no).alias("braced"), F.coalesce(made, no).alias("made"),
        F.coalesce(asked, no).alias("asked"),
        F.when(t[1].rlike("^[0-9]+$") & t[2].isin(*ARG_END), F.expr("try_cast(tok_p1 as bigint)")).alias("int_lit"),
        *([] if own is None else [own.alias("own")]))
    wl = Window.partitionBy("path", "glvl").orderBy("i")
    rows = rows.select("*", F.last("opened", ignorenulls=True).over(wl.rowsBetween(Window.unboundedPreceding, 0)).alias("grp_open"),
                       F.lag("tok", 1).over(wl).alias("before"), next_in_level("close_next").alias("closed"))
    first_comma = (tok == ",") & F.col("before").isin(*OPENS) & F.col("grp_open.is_call")
    anchor = (F.col("is_call") | F.coalesce(first_comma, no)) & F.col("starts")
    rows = rows.withColumns({"anchor": anchor, "oend": F.when(tok.isin(*OPENS), F.col("closed").isin(*ARG_END))}) \
        .where(F.col("anchor") | F.col("is_call") | F.col("asked") | F.col("beside")).drop("before", "closed", "close_next", "opened")
    # between an anchor and the bracket that its argument asks for stands no other of these rows
    rows = rows.withColumn("ended", F.coalesce(F.lead("oend", 1).over(Window.partitionBy("path").orderBy("i")), no))
    return rows.withColumns({"byte_slice": F.col("literal") | (F.col("braced") & F.col("ended")),
                             "inline_make": F.col("made") & F.col("ended")})


def go_call_args(sig: DataFrame) -> DataFrame:
    """The first two arguments of each package call with the literal / inline-make predicates."""
    g = F.col("grp_open")
    return arg_facts(sig).where("anchor").select(
        "path", g.pkg.alias("pkg"), g.fn.alias("fn"), F.when(F.col("is_call"), 0).otherwise(1).alias("arg_k"),
        F.col("line_p1").alias("line"), F.col("col_p1").alias("col"), "byte_slice", "inline_make", "int_lit")


def _rule_meta() -> Column:
    return lit_struct_map({rid: {"title": title, "description": desc, "severity": sev, "remediation": rem}
                           for rid, title, desc, sev, rem in RULES})


def attach_rule_meta(hits: DataFrame, confidence: str = "high") -> DataFrame:
    """Rule metadata by id (every id used by the tiers is in RULES)."""
    m = F.element_at(_rule_meta(), F.col("rule_id"))
    return hits.select("rule_id", m.title.alias("title"), m.description.alias("description"),
                       m.severity.alias("severity"), F.lit(confidence).alias("confidence"),
                       m.remediation.alias("remediation"), F.col("path").alias("file"),
                       F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("column"))


def with_snippets(hits: DataFrame, docs: DataFrame, marker: str | None = None) -> DataFrame:
    """Snippet = trimmed source line.  Hits are grouped per file (bounded by
    the file) and joined 1:1 with the file, whose text is split once.  With
    ``marker``, findings that a directive silences go (J7): the lines are here."""
    per_file = hits.groupBy("file").agg(F.collect_list(F.struct(*[c for c in hits.columns if c != "file"]))
                                        .alias("hs"))
    j = per_file.join(docs.select(F.col("path").alias("file"), "content"), "file")
    j = j.select("file", F.split("content", "\n", -1).alias("ls"), F.explode("hs").alias("h"))
    if marker is not None:
        own, above = F.get("ls", F.col("h.line") - 1), F.get("ls", F.col("h.line") - 2)
        j = j.where(~suppressed(F.col("h.rule_id"), marker, own, above))
    return j.select("h.*", "file", go_trim(F.coalesce(F.get("ls", F.col("h.line") - 1), F.lit("")))
                    .alias("snippet")).select(*FINDING_COLUMNS)


def go_hits(sig: DataFrame) -> DataFrame:
    """All facts of a file in one lineage -> (path, rule_id, line, col).

    Import specs, calls, argument anchors and selectors are exploded from the
    same token rows into candidate rows keyed by the local package name; the
    file's import table is attached with a window over ``(path, name)``
    (last spec wins) instead of a join, so the token windows run once and
    nothing is shuffled after the single repartition by path."""
    is_spec, local, ipath = _import_spec()
    is_spec = F.coalesce(is_spec, F.lit(False))
    g = F.col("grp_open")

    def cand(kind, name, fn, line, col, arg_k=None, ip=None):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), fn.alias("fn"),
                        line.cast("int").alias("line"), col.cast("int").alias("col"),
                        (F.lit(None).cast("int") if arg_k is None else arg_k).alias("arg_k"),
                        (F.lit(None).cast("string") if ip is None else ip).alias("ip"))
    own = F.when(is_spec, cand("imp", local, F.lit(None).cast("string"), F.col("line"), F.col("col"), ip=ipath)) \
        .when(F.col("is_call"), cand("call", F.col("tok_m3"), F.col("tok_m1"), F.col("line_m3"), F.col("col_m3"))) \
        .when(_is_selector(), cand("sel", F.col("tok_m2"), F.col("tok"), F.col("line_m2"), F.col("col_m2")))
    cands = F.array(
        F.col("own"),
        F.when(F.col("anchor"), cand("arg", g.pkg, g.fn, F.col("line_p1"), F.col("col_p1"),
                                     arg_k=F.when(F.col("is_call"), 0).otherwise(1))))
    c = arg_facts(sig, is_spec | _is_selector(), own).select(
        "path", "i", F.explode(F.filter(cands, lambda x: x.isNotNull())).alias("c"),
        "byte_slice", "inline_make", "int_lit", g.pline.alias("gpline"), g.pcol.alias("gpcol"))
    c = c.select("path", "i", "c.*", "byte_slice", "inline_make", "int_lit", "gpline", "gpcol")
    # J2-J6/J8 resolution: the last import spec binding this name in the file
    wn = Window.partitionBy("path", "name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_imp = F.col("kind") == "imp"
    c = c.withColumn("ip", F.max_by(F.when(is_imp, F.col("ip")), F.when(is_imp, F.col("i"))).over(wn)) \
        .where(~is_imp & F.col("ip").isNotNull())
    ip, fn, kind = F.col("ip"), F.col("fn"), F.col("kind")
    key = F.concat_ws(" ", ip, fn)
    weak = F.element_at(lit_map({f"{p} {f}": r for p, f, r in GO_WEAK_FUNCS}), key)
    key_idx = F.element_at(lit_map({f"{p} {f}": str(k) for p, f, k in GO_KEY_ARGS}), key).cast("int")
    own_pos = F.struct(F.col("line").alias("line"), F.col("col").alias("col"))
    call_pos = F.struct(F.col("gpline").alias("line"), F.col("gpcol").alias("col"))
    rules = F.array(
        F.when((kind == "call") & weak.isNotNull(), F.struct(weak.alias("rule_id"), own_pos.alias("pos"))),
        F.when((kind == "call") & ip.isin(*GO_WEAK_RAND_PATHS),
               F.struct(F.lit("insecure-random").alias("rule_id"), own_pos.alias("pos"))),
        F.when((kind == "arg") & (F.col("arg_k") == 1) & (ip == "crypto/rsa") & fn.isin(*GO_RSA_FUNCS)
               & (F.col("int_lit") < RSA_MIN_BITS),
               F.struct(F.lit("weak-key-rsa").alias("rule_id"), call_pos.alias("pos"))),
        F.when((kind == "arg") & (F.col("arg_k") == key_idx) & F.col("byte_slice"),
               F.struct(F.lit("hardcoded-key").alias("rule_id"), own_pos.alias("pos"))),
        F.when((kind == "arg") & (F.col("arg_k") == 1) & (ip == "crypto/cipher") & fn.isin(*GO_IV_CONSTRUCTORS)
               & (F.col("byte_slice") | F.col("inline_make")),
               F.struct(F.lit("static-iv").alias("rule_id"), own_pos.alias("pos"))),
        F.when((kind == "sel") & (ip == "crypto/tls") & fn.isin(*GO_WEAK_TLS_NAMES),
               F.struct(F.lit("deprecated-tls").alias("rule_id"), own_pos.alias("pos"))),
    )
    return c.select("path", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")) \
        .select("path", F.col("r.rule_id").alias("rule_id"), F.col("r.pos.line").alias("line"),
                F.col("r.pos.col").alias("col"))


def go_findings(docs: DataFrame, marker: str | None = None) -> DataFrame:
    """Go files (path, content) -> findings with confidence high; with ``marker``, without the silenced ones.

    Only files that hold the import path of some detector are tokenised: every rule needs one in the text."""
    paths = {p for p, _, _ in GO_WEAK_FUNCS + GO_KEY_ARGS} | {*GO_WEAK_RAND_PATHS, "crypto/rsa", "crypto/cipher", "crypto/tls"}
    docs = docs.where(needle_gate(F.col("content"), sorted(paths)))
    docs = partition_by_path(docs.select("path", "content"))
    sig = go_sig_tokens(docs)
    hits = attach_rule_meta(go_hits(sig))
    return with_snippets(hits, docs, marker)
