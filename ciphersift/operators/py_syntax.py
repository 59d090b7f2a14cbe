"""Python syntax tier (J9-J11, A6 on facts X6-X8).

* attributes (X7): every ``.name`` access; its last two dotted components are
  an equi-join key into the Python target table (all keys have exactly two
  components, so the reference's "exact or dotted suffix" test is this
  equi-join).  A call inside a chain contributes its function name.
* bare calls through ``from M import a [as b]`` (X6, J10): exact canonical
  name lookup.
* ``....RSA.generate(<int>)`` / ``....hashlib.new("<name>")`` (X8, J11): the
  first integer / string positional argument found among the direct
  arguments.
Findings are distinct per (path, line, column, rule) (A6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import PY_TARGETS, PY_WEAK_HASH_NAMES, RSA_MIN_BITS
from .go_syntax import attach_rule_meta, with_snippets
from .scheme_scan import needle_gate
from .tokens import (OPENS, group_level, is_ident, next_in_level, partition_by_path, python_tokens, token_rows,
                     with_chain_levels, with_neighbours)
from ..functions.columns import lit_map

PY_INSIGNIFICANT = r"(?s)^(?:[\t\n\x0B\f\r ]+|#.*|\\\n)$"

# FIXED VALUES: Python keywords (never a callable name or chain member).
PY_KEYWORDS = [
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def",
    "del", "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is",
    "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
]

ARG_START = ("(", ",")
ARG_END = (",", ")")


def _name(c: Column) -> Column:
    return is_ident(c) & ~c.isin(*PY_KEYWORDS)


def _is_string(c: Column) -> Column:
    return c.rlike("^[rRbBuUfF]{0,2}['\"]")


def py_sig_tokens(docs: DataFrame) -> DataFrame:
    sig = token_rows(docs, python_tokens(F.col("content")), PY_INSIGNIFICANT, breaks=True).drop("head")
    sig = with_neighbours(sig, lags=2, leads=3, extra={"brk_m1": F.lag("brk", 1)})
    # statements at depth 0: after a line break between tokens (one inside a string, or after a
    # backslash, is none), after ';', and after the ':' of a compound statement's head
    start = (F.col("dbefore") == 0) & (F.col("brk_m1").isNull() | (F.col("brk_m1") != F.col("brk"))
                                       | F.col("tok_m1").isin(";", ":"))
    w = Window.partitionBy("path").orderBy("i")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    sig = sig.withColumn("start", start)
    sig = sig.withColumns({"stmt": F.sum(F.col("start").cast("int")).over(sofar),
                           "kw": F.last(F.when(F.col("start"), F.col("tok")), ignorenulls=True).over(sofar)})
    sig = sig.withColumns({"stmt_p1": F.lead("stmt", 1).over(w), "stmt_p3": F.lead("stmt", 3).over(w)})
    # An item ``name [as alias]`` (parentheses allowed), if it stands behind ``from M import``
    t = F.col("tok")
    ended = lambda tk, st: tk.isNull() | tk.isin(",", ")", ";") | (st != F.col("stmt"))
    item = (F.col("kw") == "from") & _name(t) & (
        F.col("tok_m1").isin("import", ",") | ((F.col("tok_m1") == "(") & (F.col("tok_m2") == "import")))
    plain = ended(F.col("tok_p1"), F.col("stmt_p1"))
    aliased = (F.col("tok_p1") == "as") & _name(F.col("tok_p2")) & ended(F.col("tok_p3"), F.col("stmt_p3"))
    return with_chain_levels(sig.select(
        "path", "i", "tok", "line", "col", "dbefore", "dafter", "start", "stmt",
        F.when(F.col("kw").isin("from", "import"), F.col("kw")).alias("kw"),
        F.when(item & plain, t).when(item & aliased, F.col("tok_p2")).alias("item"),
        F.coalesce(F.col("tok_m1") == ".", F.lit(False)).alias("after_dot"),
        F.coalesce(F.col("tok_m1").isin(*ARG_START) & F.col("tok_p1").isin(*ARG_END), F.lit(False)).alias("whole_arg")))


def with_bindings(sig: DataFrame) -> DataFrame:
    """X6 on every row: ``bound`` / ``canonical`` when the token starts an
    item of ``from M import ...``.  All rows of these statements must be there."""
    t = F.col("tok")
    wall = Window.partitionBy("path", "stmt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # module text between "from" and the first "import"
    is_from = F.col("kw") == "from"
    sig = sig.withColumn("imp_i", F.min(F.when(is_from & (t == "import"), F.col("i"))).over(wall))
    mod_tok = F.when(is_from & ~F.col("start") & (F.col("i") < F.col("imp_i")), F.struct("i", "tok"))
    sig = sig.withColumn("mod", F.collect_list(mod_tok).over(wall))
    module = F.array_join(F.transform(F.array_sort("mod"), lambda x: x.tok), "")
    bound = F.col("item").isNotNull() & (F.col("i") > F.col("imp_i")) & (F.size("mod") > 0)
    return sig.withColumns({"bound": F.when(bound, F.col("item")),
                            "canonical": F.when(bound, F.concat(module, F.lit("."), t))}).drop("mod", "imp_i")


def with_attributes(sig: DataFrame) -> DataFrame:
    """X7 on every row: ``suffix2`` (last two dotted components) for an
    attribute access ``.name``, else NULL; ``cstart`` = position where the
    token's expression chain starts (an attribute node starts there)."""
    lt = [None] + [F.col(f"ltok_m{k}") for k in (1, 2)]
    t = F.col("tok")
    prev = lt[1]
    # does this token continue the expression chain of the previous token at its level?
    cont = ((t == ".") | ((prev == ".") & is_ident(t))
            | (t.isin("(", "[") & (_name(prev) | prev.isin(")", "]") | _is_string(prev)))
            | t.isin(")", "]", "}"))
    cont = F.coalesce(cont, F.lit(False))
    w = Window.partitionBy("path", "clvl").orderBy("i")
    sig = sig.withColumns({
        "cstart": F.last(F.when(~cont, F.struct("line", "col")), ignorenulls=True)
        .over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "lnp_m1": F.lag("lnp", 1).over(w)})
    # component before the '.', seen at this level: NAME . attr, or NAME ( ... ) ( ... ) . attr
    # (a call contributes its function name, through any number of calls)
    comp = F.when((lt[2] == ")") & _name(F.col("lnp_m1")), F.col("lnp_m1")) \
        .when((lt[2] != ")") & is_ident(lt[2]), lt[2])
    kw = F.coalesce("kw", F.lit(""))
    attr = (prev == ".") & is_ident(t) & F.col("after_dot") & (kw != "import") & ~((kw == "from") & (F.col("dbefore") == 0))
    return sig.withColumn("suffix2", F.when(F.coalesce(attr, F.lit(False)), F.concat(comp, F.lit("."), t)))


def py_attributes(sig: DataFrame) -> DataFrame:
    """X7 facts: (path, suffix2, line, col) at the start of the chain."""
    return with_attributes(sig).where(F.col("suffix2").isNotNull()) \
        .select("path", "suffix2", F.col("cstart.line").alias("line"), F.col("cstart.col").alias("col"))


def py_from_imports(sig: DataFrame) -> DataFrame:
    """(path, bound, canonical); the last binding of a name wins."""
    b = with_bindings(sig.where("kw = 'from'")).where(F.col("bound").isNotNull())
    w = Window.partitionBy("path", "bound").orderBy(F.desc("i"))
    return b.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("path", "bound", "canonical")


def with_called(sig: DataFrame) -> DataFrame:
    """X8 on every row of :func:`with_attributes`: on the parenthesis that opens a call, ``call_open``, ``bare`` (the
    called name), ``fsuffix`` (last two components of a called attribute) and ``fstart`` (where the called expression
    starts)."""
    # calls: at the chain level the open paren follows its function expression
    w = Window.partitionBy("path", "clvl").orderBy("i")
    t = F.col("tok")
    lt1, lt2 = F.col("ltok_m1"), F.col("ltok_m2")
    opens = (t == "(") & ~F.col("start")  # a parenthesis that begins a statement calls nothing
    call_open = F.coalesce(opens & (_name(lt1) | lt1.isin(")", "]") | _is_string(lt1)), F.lit(False))
    bare = opens & _name(lt1) & ~F.coalesce(lt2, F.lit("")).isin(".", "def", "class")
    return sig.withColumns({"fsuffix": F.lag("suffix2", 1).over(w), "fstart": F.lag("cstart", 1).over(w),
                            "call_open": call_open, "bare": F.when(bare, lt1)})


def is_group_row() -> Column:
    """The rows that :func:`with_arguments` reads: open brackets, and literals that are a whole argument."""
    t = F.col("tok")
    return t.isin(*OPENS) | (F.col("whole_arg") & (t.rlike("^[0-9]+$") | _is_string(t)))


def with_arguments(rows: DataFrame) -> DataFrame:
    """``first_int`` and ``first_str`` on the parenthesis that opens a call: the first positional arguments of these
    kinds.  What follows an open bracket at its level, up to the next open bracket, is its own."""
    t, i = F.col("tok"), F.col("i")
    int_val = F.when(F.col("whole_arg") & t.rlike("^[0-9]+$"), F.expr("try_cast(tok as bigint)"))
    rows = rows.withColumns({
        "glvl": group_level(), "open_i": F.when(t.isin(*OPENS), i),
        "int_arg": F.when(int_val.isNotNull(), F.struct(i.alias("i"), int_val.alias("v"))),
        "str_arg": F.when(F.col("whole_arg") & _is_string(t), F.struct(i.alias("i"), t.alias("v")))})
    rows = rows.select("*", next_in_level("open_i").alias("next_open"), next_in_level("int_arg").alias("next_int"),
                       next_in_level("str_arg").alias("next_str"))
    own = lambda c: F.when(F.col("next_open").isNull() | (c.i < F.col("next_open")), c.v)
    return rows.withColumns({"first_int": own(F.col("next_int")), "first_str": own(F.col("next_str"))})


def py_calls(sig: DataFrame) -> DataFrame:
    """X8 facts: (path, callee, line, col, first_int, first_str) of calls by a name or an attribute."""
    callee = F.coalesce("bare", "fsuffix")
    rows = with_called(with_attributes(sig)).where(is_group_row()).select(
        "path", "i", "tok", "dbefore", "dafter", "whole_arg", "call_open", callee.alias("callee"),
        F.col("fstart.line").cast("int").alias("line"), F.col("fstart.col").cast("int").alias("col"))
    return with_arguments(rows).where(F.col("call_open") & F.col("callee").isNotNull()).select(
        "path", "callee", "line", "col", "first_int", "first_str")


def py_hits(sig: DataFrame) -> DataFrame:
    """Attribute, call and binding facts in one lineage -> distinct
    (path, rule_id, line, col).  Bare calls are resolved against the file's
    from-import bindings with a window over ``(path, name)``."""
    targets = lit_map(dict(PY_TARGETS))
    attr_rule = F.element_at(targets, F.col("suffix2"))
    rows = with_called(with_attributes(sig).withColumn("attr_rule", attr_rule))
    rows = rows.where(is_group_row() | F.col("attr_rule").isNotNull() | F.coalesce(F.col("kw") == "from", F.lit(False))).select(
        "path", "i", "tok", "dbefore", "dafter", "start", "stmt", "kw", "item", "whole_arg", "attr_rule", "cstart", "call_open",
        "bare", "fsuffix", "fstart")
    rows = with_bindings(rows).where(is_group_row() | F.col("attr_rule").isNotNull() | F.col("bound").isNotNull())
    g = with_arguments(rows.drop("start", "stmt", "kw", "item"))
    weak_names = lit_map(dict(PY_WEAK_HASH_NAMES))
    name_arg = F.lower(F.regexp_replace(F.col("first_str"), "^['\"]+|['\"]+\\z", ""))
    fs = F.col("fsuffix")
    value_rule = F.when(F.col("call_open") & (fs == "RSA.generate") & (F.col("first_int") < RSA_MIN_BITS),
                        F.lit("weak-key-rsa")) \
        .when(F.col("call_open") & (fs == "hashlib.new"), F.element_at(weak_names, name_arg))
    attr_rule = F.col("attr_rule")
    null_s = F.lit(None).cast("string")

    def cand(kind, rule, name, canonical, pos):
        return F.struct(F.lit(kind).alias("kind"), rule.alias("rule_id"), name.alias("name"),
                        canonical.alias("canonical"), pos.line.cast("int").alias("line"),
                        pos.col.cast("int").alias("col"))
    cands = F.array(
        F.when(attr_rule.isNotNull(), cand("hit", attr_rule, null_s, null_s, F.col("cstart"))),
        F.when(value_rule.isNotNull(), cand("hit", value_rule, null_s, null_s, F.col("fstart"))),
        F.when(F.col("call_open") & F.col("bare").isNotNull(),
               cand("bare", null_s, F.col("bare"), null_s, F.col("fstart"))),
        F.when(F.col("bound").isNotNull(), cand("bind", null_s, F.col("bound"), F.col("canonical"), F.col("cstart"))),
    )
    c = g.select("path", "i", F.explode(F.filter(cands, lambda x: x.isNotNull())).alias("c")).select("path", "i", "c.*")
    # Last from-import binding of the called name in the file
    wn = Window.partitionBy("path", "name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_bind = F.col("kind") == "bind"
    c = c.withColumn("resolved", F.max_by(F.when(is_bind, F.col("canonical")), F.when(is_bind, F.col("i"))).over(wn))
    rule = F.when(F.col("kind") == "hit", F.col("rule_id")) \
        .when(F.col("kind") == "bare", F.element_at(targets, F.col("resolved")))
    hits = c.select("path", rule.alias("rule_id"), "line", "col").where(F.col("rule_id").isNotNull())
    return hits.dropDuplicates(["path", "line", "col", "rule_id"])


def py_findings(docs: DataFrame, marker: str | None = None) -> DataFrame:
    """Python files (path, content) -> findings with confidence high; with ``marker``, without the silenced ones.

    Only files that hold the first component of some target are tokenised: every rule needs one in the text."""
    docs = docs.where(needle_gate(F.col("content"), sorted({t.split(".")[0] for t, _ in PY_TARGETS} | {"RSA"})))
    docs = partition_by_path(docs.select("path", "content"))
    sig = py_sig_tokens(docs)
    hits = attach_rule_meta(py_hits(sig))
    return with_snippets(hits, docs, marker)
