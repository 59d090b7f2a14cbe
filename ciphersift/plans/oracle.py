"""DuckDB oracle SQL for the registered queries.

Each statement recomputes its query from the raw tables with DuckDB's own
functions: RE2 regexes exactly as the catalog writes them (DuckDB uses RE2,
the dialect the rules are defined in, so no translation is involved), string
splitting, list lambdas and window functions.  Only fixed inputs (catalog
rows, language tables, config values, corpus templates) are shared with the
Spark side.
"""

from __future__ import annotations

import re

from ..sources.catalog import (CLASS_SELECTORS, LANG_BY_EXT, LANG_BY_SHEBANG, SKIP_DIRS, catalog_schemes)
from ..sources.code_corpus import corpus_sql, sql_str
from ..sources.config import parse_config
from ..sources.prose_code import facts_sql
from .queries import CUSTOM_CONFIG, DIALECT, DISABLED, EXCLUDES, OVERRIDES

WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
FINDING_COLS = 'rule_id, title, description, severity, confidence, remediation, file, line, "column", snippet'


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_str(i) for i in items) + "]"


def schemes_values(schemes) -> str:
    rows = []
    for s in schemes:
        rows.append("(" + ", ".join([str(s.ord), sql_str("scheme:" + s.name), sql_str(f"{s.title} ({s.cls})"),
                                     sql_str(s.note), sql_str(s.severity), sql_str(s.remediation),
                                     sql_str(s.re2)]) + ")")
    return ("(VALUES " + ", ".join(rows) + ") AS s(ord, rule_id, title, description, severity, remediation, "
            "pattern)")


def weak_set():
    return [s for s in catalog_schemes() if s.cls in CLASS_SELECTORS["weak"]]


def lines_cte(src: str = "docs") -> str:
    """lines(path, line, text, raw): split on LF, no line after a final LF,
    one trailing CR removed from text."""
    return f"""lines AS (
  SELECT path, ln::INTEGER AS line, regexp_replace(l, '\\r$', '') AS text, l AS raw
  FROM (SELECT path, unnest(parts) AS l, generate_subscripts(parts, 1) AS ln, len(parts) AS n
        FROM (SELECT path, string_split(content, chr(10)) AS parts FROM {src}))
  WHERE NOT (ln = n AND l = '')
)"""


def regex_findings(schemes, src: str = "docs") -> str:
    """CTEs lines + raw_findings for the regex tier over ``src(path, content)``."""
    return f"""{lines_cte(src)},
raw_findings AS (
  SELECT s.rule_id, s.title, s.description, s.severity, 'low' AS confidence, s.remediation,
         l.path AS file, l.line,
         (strlen(regexp_extract(l.text, '^(.*?)(?:' || s.pattern || ')', 1)) + 1)::INTEGER AS "column",
         {trim_ws('l.text')} AS snippet
  FROM lines l JOIN {schemes_values(schemes)} ON regexp_matches(l.text, s.pattern)
)"""


def directives_cte() -> str:
    return r"""directives AS (
  SELECT path, t AS target_line, ids IN ('', 'all') AS all_rules,
         list_filter(string_split(ids, ','), lambda x: x <> '') AS idl
  FROM (SELECT path, line, regexp_extract(raw, 'ciphersift:ignore\b[ \t]*([\w:.,\-]*)', 1) AS ids
        FROM lines WHERE regexp_matches(raw, 'ciphersift:ignore\b[ \t]*([\w:.,\-]*)')),
       unnest([line, line + 1]) AS u(t)
)"""


def kept(disabled=(), min_rank: int = 0, overrides: dict | None = None) -> str:
    sev = "severity"
    if overrides:
        cases = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in overrides.items())
        sev = f"CASE rule_id {cases} ELSE severity END"
    cond = ""
    if disabled:
        cond += f" AND rule_id NOT IN ({', '.join(sql_str(d) for d in disabled)})"
    if min_rank:
        cond += f" AND (CASE confidence WHEN 'high' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) >= {min_rank}"
    return f"""SELECT rule_id, title, description, {sev} AS severity, confidence, remediation, file, line,
       "column", snippet
FROM raw_findings f
WHERE NOT EXISTS (SELECT 1 FROM directives d WHERE d.path = f.file AND d.target_line = f.line
                  AND (d.all_rules OR list_contains(d.idl, f.rule_id))){cond}"""


def text_table_docs(table: str) -> str:
    path, col = {"documents": ("'documents/' || doc_id", "text"), "pages": ("'pages/' || page_id", "html"),
                 "conversations": ("'conversations/' || conv_id || '/' || turn", "text"),
                 "benchmark": ("'benchmark/' || item_id", "text")}[table]
    # text rows have no extension and no shebang here; unknown language is
    # scanned (include_unknown); a NULL text is an error
    return f"""docs AS (
  SELECT path, content FROM (SELECT {path} AS path, {col} AS content FROM {table})
  WHERE content IS NOT NULL
)"""


def text_scan_sql(table: str, schemes=None, **kw) -> str:
    return f"""WITH {text_table_docs(table)},
{regex_findings(schemes or weak_set())},
{directives_cte()}
{kept(**kw)}"""


def glob_re2(glob: str) -> str:
    out = ["^"]
    i = 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "".join(out) + "$"


def classified_cte(excludes=(), search: bool = False, include_unknown: bool = False, python_syntax: bool = True) -> str:
    """files(path, content, lang, tier, status, reason) for the code corpus."""
    prune = f"list_has_any(dirs, {sql_list(SKIP_DIRS)})"
    for g in excludes:
        g = g.strip()
        rx = sql_str(glob_re2(g[:-1] if g.endswith("/") else g))
        if "/" not in g:
            prune += (f" OR regexp_matches(base, {rx})"
                      f" OR list_bool_or(list_transform(dirs, lambda d: regexp_matches(d, {rx})))")
        else:
            prune += (f" OR regexp_matches(path, {rx}) OR list_bool_or(list_transform(range(1, len(dirs) + 1),"
                      f" lambda k: regexp_matches(array_to_string(parts[1:k], '/'), {rx})))")
    ext_vals = ", ".join(f"({sql_str(e)}, {sql_str(l)})" for e, l, _ in LANG_BY_EXT)
    sb_vals = ", ".join(f"({sql_str(n)}, {sql_str(l)})" for n, l in LANG_BY_SHEBANG)

    def base(x):
        y = f"regexp_replace({x}, '/+$', '')"
        return f"(CASE WHEN {x} = '' THEN '.' WHEN {y} = '' THEN '/' ELSE string_split({y}, '/')[-1] END)"

    first = "regexp_replace(split_part(content, chr(10), 1), '\\r$', '')"
    fields = f"regexp_split_to_array({trim_ws(first)}, '{WS}+')"
    if search:
        tier = "'regex'"
    else:
        tier = (f"CASE WHEN lang = 'go' THEN 'go' WHEN lang = 'python' AND {str(python_syntax).lower()} THEN 'python' "
                f"WHEN lang <> 'unknown' THEN 'regex' WHEN {str(include_unknown).lower()} THEN 'regex' END")
    return f"""corpus AS ({corpus_sql()}),
f0 AS (SELECT path, content, strlen(content) AS length, string_split(path, '/') AS parts FROM corpus),
f1 AS (SELECT *, parts[-1] AS base, parts[1:len(parts) - 1] AS dirs FROM f0),
f2 AS (SELECT * FROM f1 WHERE NOT ({prune})),
sb(name, lang) AS (VALUES {sb_vals}),
f3 AS (
  SELECT f2.*, coalesce(e.lang,
         CASE WHEN content LIKE '#!%' THEN
           coalesce((SELECT lang FROM sb WHERE sb.name = {base(f'{fields}[-1]')}),
                    (SELECT lang FROM sb WHERE sb.name = {base(f"regexp_replace({fields}[1], '^#!', '')")}))
         END, 'unknown') AS lang
  FROM f2 LEFT JOIN (VALUES {ext_vals}) AS e(ext, lang)
    ON e.ext = lower(regexp_extract(base, '(\\.[^./]*)$', 1))
),
f4 AS (SELECT *, {tier} AS tier FROM f3),
files AS (
  SELECT path, content, lang, tier,
         CASE WHEN content IS NULL THEN 'unreadable'
              WHEN tier IS NULL THEN 'unknown language' END AS reason
  FROM f4
),
classified AS (
  SELECT *, CASE WHEN reason IS NULL THEN 'scanned' WHEN reason = 'unreadable' THEN 'error'
                 ELSE 'skipped' END AS status FROM files
)"""


def code_search_sql(schemes, **kw) -> str:
    return f"""WITH {classified_cte(search=True)},
docs AS (SELECT path, content FROM classified WHERE status = 'scanned' AND tier = 'regex'),
{regex_findings(schemes)},
{directives_cte()}
{kept(**kw)}"""


def resolve_sql() -> str:
    cat = catalog_schemes()
    sel_rows = []
    for name, classes in CLASS_SELECTORS.items():
        for s in cat:
            if s.cls in classes:
                sel_rows.append(f"({sql_str(name)}, {sql_str(s.name)}, {sql_str(s.cls)})")
    return f"""WITH words AS (
  SELECT DISTINCT w AS token
  FROM (SELECT unnest(regexp_split_to_array(lower(text), '[\\t\\n\\r ,.;:!?()"]+')) AS w FROM documents)
  WHERE w <> ''
),
cat AS (SELECT * FROM {schemes_values(cat)}),
sel(token, name, class) AS (VALUES {", ".join(sel_rows)}),
t AS (SELECT token, {trim_ws('token')} AS t FROM words)
SELECT t.token, sel.name, sel.class FROM t JOIN sel ON sel.token = t.t
UNION ALL
SELECT t.token, substr(cat.rule_id, 8) AS name, regexp_extract(cat.title, '\\(([a-z]+)\\)$', 1) AS class
FROM t JOIN cat ON substr(cat.rule_id, 8) = t.t
WHERE t.t NOT IN (SELECT token FROM sel)
UNION ALL
SELECT t.token, substr(cat.rule_id, 8) AS name, regexp_extract(cat.title, '\\(([a-z]+)\\)$', 1) AS class
FROM t JOIN cat ON regexp_matches(t.t, cat.pattern)
WHERE t.t NOT IN (SELECT token FROM sel) AND t.t NOT IN (SELECT substr(rule_id, 8) FROM cat)"""


def catalog_inventory_sql() -> str:
    cat = catalog_schemes()
    rows = ", ".join(f"({s.ord}, {sql_str('scheme:' + s.name)}, {sql_str(s.name)}, {sql_str(s.cls)}, "
                     f"{sql_str(s.title)})" for s in cat)
    return f"""WITH {text_table_docs('documents')},
{regex_findings(cat)},
{directives_cte()},
k AS ({kept()}),
hits AS (SELECT rule_id, count(*) AS hits FROM k GROUP BY rule_id),
c(ord, rule_id, name, class, title) AS (VALUES {rows})
SELECT c.ord, printf('%-14s %-8s %s', c.name, c.class, c.title) AS listing, coalesce(h.hits, 0)::BIGINT AS hits
FROM c LEFT JOIN hits h ON h.rule_id = c.rule_id"""


def user_catalog_sql() -> str:
    """Every line against every scheme; the exact regex runs behind a plain search for the phrase or word."""
    return rf"""WITH {text_table_docs('documents')},
{lines_cte()},
w AS (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),
p AS (SELECT z[1] AS a, z[2] AS b FROM (SELECT unnest(list_zip(w, w[2:])) AS z FROM w)),
schemes AS (
  SELECT DISTINCT lower(a) || ' ' || lower(b) AS name, '(?i)\b' || lower(a) || ' ' || lower(b) || '\b' AS pattern,
         'legacy' AS class FROM p WHERE b IS NOT NULL
  UNION ALL SELECT DISTINCT a, '\b' || a || '[a-z]*', 'contextual' FROM p WHERE length(a) >= 6),
met AS (
  SELECT l.path, l.line, l.text, l.raw, s.name, s.pattern, s.class
  FROM (SELECT *, lower(text) AS lt FROM lines) l JOIN (SELECT *, lower(name) AS ln FROM schemes) s ON contains(l.lt, s.ln)),
raw_findings AS (
  SELECT 'scheme:' || name AS rule_id, name || ' (' || class || ')' AS title, '' AS description,
         CASE class WHEN 'legacy' THEN 'low' ELSE 'info' END AS severity, 'low' AS confidence,
         CASE class WHEN 'legacy' THEN 'Prefer a modern, well-supported algorithm.' ELSE '' END AS remediation,
         path AS file, line, (strlen(regexp_extract(text, '^(.*?)(?:' || pattern || ')', 1)) + 1)::INTEGER AS "column",
         {trim_ws('text')} AS snippet
  FROM met WHERE regexp_matches(text, pattern)),
{directives_cte()}
{kept()}"""


def oracle_sql() -> dict[str, str]:
    custom = parse_config(CUSTOM_CONFIG).custom_schemes
    strong = [s for s in catalog_schemes() if s.name in ("sha256", "sha3")]
    weak = weak_set()
    q = {
        "scan_documents_weak": text_scan_sql("documents"),
        "scan_pages_weak": text_scan_sql("pages"),
        "scan_benchmark_weak": text_scan_sql("benchmark"),
        "scan_conversations_custom": text_scan_sql("conversations", weak + custom),
        "search_all_inventory": text_scan_sql("documents", catalog_schemes()),
        "search_strong_sha256": code_search_sql(strong),
        "search_user_catalog": user_catalog_sql(),
        "regex_dialect": f"""WITH {text_table_docs('conversations')},
{lines_cte()},
p(rule_id, pattern) AS (VALUES {", ".join(f"('scheme:p{k}', {sql_str(p)})" for k, p in enumerate(DIALECT))})
SELECT rule_id, count(*) AS lines, sum(strlen(regexp_extract(text, '^((?s:.)*?)(?:' || pattern || ')', 1)) + 1)::BIGINT AS columns
FROM lines JOIN p ON regexp_matches(text, pattern) GROUP BY rule_id""",
        "binary_sniff": """WITH d AS (
  SELECT doc_id % 3 AS form, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN chr(0) || text
         ELSE text || repeat(' ', 8000) || chr(0) END AS content FROM documents)
SELECT form::BIGINT AS form, o.sniff, CASE WHEN content IS NULL THEN 'error'
         WHEN o.sniff AND position(chr(0) IN content) = 1 THEN 'skipped' ELSE 'scanned' END AS status,
       count(*) AS files FROM d, (VALUES (true), (false)) AS o(sniff) GROUP BY ALL""",
        "resolve_tokens": resolve_sql(),
        "catalog_inventory": catalog_inventory_sql(),
        "line_split": f"WITH {text_table_docs('documents')}, {lines_cte()} "
                      f"SELECT path AS file, line, text FROM lines",
        "lang_detect": f"WITH {classified_cte()} SELECT path, lang, coalesce(tier, 'none') AS tier FROM classified",
        "skip_dirs": f"WITH {classified_cte()} SELECT path FROM classified",
        "exclude_globs": f"WITH {classified_cte(excludes=EXCLUDES)} SELECT path FROM classified",
        "file_status_counts": f"WITH {classified_cte()} SELECT status, coalesce(reason, '') AS reason, "
                              f"count(*) AS files FROM classified GROUP BY ALL",
        "suppression_antijoin": code_search_sql(weak),
        "disabled_antijoin": code_search_sql(weak, disabled=DISABLED),
        "severity_override": code_search_sql(weak, overrides=OVERRIDES),
        "severity_summary": f"""WITH {text_table_docs('documents')},
{regex_findings(weak)},
{directives_cte()},
k AS ({kept()})
SELECT severity, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2
       ELSE 1 END AS rank, count(*) AS findings FROM k GROUP BY severity""",
    }
    q.update({
        "py_calls": facts_sql("calls", ["callee", "first_int", "first_str"]),
        "py_bindings": facts_sql("bindings", ["bound", "canonical"]),
        "go_selectors": facts_sql("selectors", ["pkg", "name"]),
        "go_call_args": facts_sql("args", ["pkg", "fn", "arg_k", "byte_slice", "inline_make", "int_lit"]),
        "prose_code_findings": facts_sql("findings", ["rule_id"]),
    })
    q.update(go_oracles())
    q.update(py_oracles())
    q.update(full_scan_oracles())
    return q


# ---------------------------------------------------------------------------
# Go syntax tier in SQL
# ---------------------------------------------------------------------------
# RE2 form of the Go token grammar (greedy instead of possessive: same tokens)
GO_TOKEN_RE2 = (r"(?s)//[^\n]*|/\*.*?\*/|`[^`]*`|" + '"' + r'(?:[^"\\\n]|\\.)*' + '"'
                + r"|'(?:[^'\\\n]|\\.)*'|[\pL_][\pL\p{Nd}_]*|[0-9][0-9A-Za-z_.]*|[\t\n\x0B\f\r ]+|.")
IDENT = r"'^[\pL_][\pL\p{Nd}_]*$'"


def _ident(x: str) -> str:
    return f"regexp_matches({x}, {IDENT})"


def token_ctes(files: str, token_re2: str, insignificant_re2: str, prefix: str = "", continuation: bool = False) -> str:
    """t0..sig: significant tokens with line, byte column and depth."""
    w_before = "(PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    joined = joined_col = ""
    if continuation:
        joined = (",\n         coalesce(last_value(CASE WHEN NOT regexp_matches(tok, '^[ \\t\\x0B\\f]+$') THEN tok END "
                  f"IGNORE NULLS) OVER {w_before} = '\\' || chr(10), false) AS joined")
        joined_col = ", joined"
    return f"""{prefix}t0 AS (
  SELECT path, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS i
  FROM (SELECT path, regexp_extract_all(content, {sql_str(token_re2)}) AS ts FROM {files})
),
{prefix}t1 AS (
  SELECT *, coalesce(sum(strlen(tok)) OVER {w_before}, 0) AS off0,
         1 + coalesce(sum(len(string_split(tok, chr(10))) - 1) OVER {w_before}, 0) AS line
  FROM {prefix}t0
),
{prefix}t2 AS (
  SELECT *, off0 - coalesce(max(CASE WHEN contains(tok, chr(10))
                                THEN off0 + strlen(regexp_extract(tok, '(?s)^(.*\\n)', 1)) END) OVER {w_before}, 0)
            + 1 AS col{joined}
  FROM {prefix}t1
),
{prefix}sig0 AS (
  SELECT path, i, tok, line::INTEGER AS line, col::INTEGER AS col{joined_col},
         CASE WHEN tok IN ('(', '[', '{{') THEN 1 WHEN tok IN (')', ']', '}}') THEN -1 ELSE 0 END AS delta
  FROM {prefix}t2 WHERE NOT regexp_matches(tok, {sql_str(insignificant_re2)})
),
{prefix}sig AS (
  SELECT *, (sum(delta) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING))::INTEGER AS dafter,
         ((sum(delta) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING)) - delta)::INTEGER AS dbefore
  FROM {prefix}sig0
)"""


def go_ctes() -> str:
    lags = ", ".join(f"lag(tok, {k}) OVER w AS tok_m{k}" for k in range(1, 5))
    leads = ", ".join(f"lead(tok, {k}) OVER w AS tok_p{k}" for k in range(1, 8))
    pos = ", ".join(f"lag({c}, {k}) OVER w AS {c}_m{k}" for c in ("line", "col") for k in range(1, 5))
    return f"""{classified_cte()},
gofiles AS (SELECT path, content FROM classified WHERE status = 'scanned' AND tier = 'go'),
{token_ctes('gofiles', GO_TOKEN_RE2, r'(?s)^(?:[\t\n\x0B\f\r ]+|//.*|/\*.*)$')},
nb AS (
  SELECT *, {lags}, {leads}, {pos}, lead(line, 1) OVER w AS line_p1, lead(col, 1) OVER w AS col_p1
  FROM sig WINDOW w AS (PARTITION BY path ORDER BY i)
),
nb2 AS (
  SELECT *, coalesce(last_value(CASE WHEN tok IN ('(', '[', '{{') AND dbefore = 0
                                     THEN coalesce(tok_m1 = 'import', false) END IGNORE NULLS)
                     OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING), false) AS in_import,
         coalesce(tok = '(' AND {_ident('tok_m1')} AND tok_m2 = '.' AND {_ident('tok_m3')}
                  AND coalesce(tok_m4, '') <> '.' AND line_m1 = line, false) AS is_call,
         tok IN ('(', '[', '{{') AS is_open,
         CASE WHEN tok IN ('(', '[', '{{') THEN dafter ELSE dbefore END AS glvl
  FROM nb
),
g1 AS (
  SELECT *, sum(is_open::INTEGER) OVER (PARTITION BY path, glvl ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp
  FROM nb2
),
g2 AS (
  SELECT *,
    first_value(CASE WHEN is_open THEN is_call END IGNORE NULLS) OVER wg AS g_is_call,
    first_value(CASE WHEN is_open THEN tok_m3 END IGNORE NULLS) OVER wg AS g_pkg,
    first_value(CASE WHEN is_open THEN tok_m1 END IGNORE NULLS) OVER wg AS g_fn,
    first_value(CASE WHEN is_open THEN line_m3 END IGNORE NULLS) OVER wg AS g_pline,
    first_value(CASE WHEN is_open THEN col_m3 END IGNORE NULLS) OVER wg AS g_pcol,
    CASE WHEN tok = ',' THEN sum((tok = ',')::INTEGER) OVER wg END AS comma_k,
    max(CASE WHEN tok IN (')', ']', '}}') THEN coalesce(tok_p1, '') END)
      OVER (PARTITION BY path, glvl, grp) AS close_next
  FROM g1 WINDOW wg AS (PARTITION BY path, glvl, grp ORDER BY i ROWS UNBOUNDED PRECEDING)
),
g3 AS (
  SELECT *, lead(oend, 2) OVER (PARTITION BY path ORDER BY i) AS e2,
         lead(oend, 4) OVER (PARTITION BY path ORDER BY i) AS e4
  FROM (SELECT *, CASE WHEN is_open THEN close_next IN (',', ')') END AS oend FROM g2)
),
go_imports AS (
  SELECT path, local, import_path FROM (
    SELECT *, row_number() OVER (PARTITION BY path, local ORDER BY i DESC) AS rn FROM (
      SELECT path, i, import_path, coalesce(alias, string_split(import_path, '/')[-1]) AS local FROM (
        SELECT path, i, regexp_extract(tok, '(?s)^["`](.*)["`]$', 1) AS import_path,
               CASE WHEN named THEN tok_m1 END AS alias
        FROM (SELECT *, ({_ident('tok_m1')} AND tok_m1 <> 'import') OR tok_m1 IN ('_', '.') AS named FROM nb2)
        WHERE (tok LIKE '"%' OR tok LIKE '`%')
          AND (tok_m1 = 'import' OR (tok_m2 = 'import' AND named) OR (in_import AND dbefore = 1)))
      WHERE alias IS NULL OR alias NOT IN ('_', '.')))
  WHERE rn = 1
),
go_calls AS (SELECT path, tok_m3 AS pkg, tok_m1 AS fn, line_m3 AS line, col_m3 AS col FROM nb2 WHERE is_call),
go_sels AS (
  SELECT path, tok_m2 AS pkg, tok AS fn, line_m2 AS line, col_m2 AS col FROM nb2
  WHERE {_ident('tok')} AND tok_m1 = '.' AND {_ident('tok_m2')} AND coalesce(tok_m3, '') <> '.'
),
go_args AS (
  SELECT path, g_pkg AS pkg, g_fn AS fn, g_pline AS pline, g_pcol AS pcol,
         CASE WHEN is_call THEN 0 ELSE 1 END AS arg_k, line_p1 AS line, col_p1 AS col,
         coalesce((tok_p1 LIKE '"%' OR tok_p1 LIKE '`%') AND tok_p2 IN (',', ')'), false)
         OR coalesce(tok_p1 = '[' AND tok_p2 = ']' AND tok_p3 = 'byte' AND tok_p4 = '('
                     AND (tok_p5 LIKE '"%' OR tok_p5 LIKE '`%') AND tok_p6 = ')' AND tok_p7 IN (',', ')'), false)
         OR coalesce(tok_p1 = '[' AND tok_p2 = ']' AND tok_p3 = 'byte' AND tok_p4 = '{{' AND e4, false)
           AS byte_slice,
         coalesce(tok_p1 = 'make' AND tok_p2 = '(' AND tok_p3 = '[' AND tok_p4 = ']' AND tok_p5 = 'byte'
                  AND tok_p6 IN (',', ')') AND e2, false) AS inline_make,
         CASE WHEN regexp_matches(tok_p1, '^[0-9]+$') AND tok_p2 IN (',', ')') THEN TRY_CAST(tok_p1 AS BIGINT) END
           AS int_lit
  FROM g3
  WHERE (is_call OR (comma_k = 1 AND coalesce(g_is_call, false))) AND tok_p1 NOT IN (')', ',')
)"""


def _rule_values() -> str:
    from ..sources.catalog import RULES
    rows = ", ".join("(" + ", ".join(sql_str(x) for x in r) + ")" for r in RULES)
    return f"(VALUES {rows}) AS r(rule_id, title, description, severity, remediation)"


def go_hits_sql() -> str:
    from ..sources.catalog import (GO_IV_CONSTRUCTORS, GO_KEY_ARGS, GO_RSA_FUNCS, GO_WEAK_FUNCS,
                                   GO_WEAK_RAND_PATHS, GO_WEAK_TLS_NAMES)
    wf = ", ".join(f"({sql_str(p)}, {sql_str(f)}, {sql_str(r)})" for p, f, r in GO_WEAK_FUNCS)
    ka = ", ".join(f"({sql_str(p)}, {sql_str(f)}, {k})" for p, f, k in GO_KEY_ARGS)
    lst = lambda xs: ", ".join(sql_str(x) for x in xs)
    return f"""go_hits AS (
  SELECT c.path, w.rule_id, c.line, c.col FROM go_calls c JOIN go_imports m ON m.path = c.path AND m.local = c.pkg
    JOIN (VALUES {wf}) AS w(ip, fn, rule_id) ON w.ip = m.import_path AND w.fn = c.fn
  UNION ALL
  SELECT c.path, 'insecure-random', c.line, c.col FROM go_calls c
    JOIN go_imports m ON m.path = c.path AND m.local = c.pkg WHERE m.import_path IN ({lst(GO_WEAK_RAND_PATHS)})
  UNION ALL
  SELECT a.path, 'weak-key-rsa', a.pline, a.pcol FROM go_args a JOIN go_imports m ON m.path = a.path AND m.local = a.pkg
    WHERE a.arg_k = 1 AND m.import_path = 'crypto/rsa' AND a.fn IN ({lst(GO_RSA_FUNCS)}) AND a.int_lit < 2048
  UNION ALL
  SELECT a.path, 'hardcoded-key', a.line, a.col FROM go_args a JOIN go_imports m ON m.path = a.path AND m.local = a.pkg
    JOIN (VALUES {ka}) AS k(ip, fn, idx) ON k.ip = m.import_path AND k.fn = a.fn
    WHERE a.arg_k = k.idx AND a.byte_slice
  UNION ALL
  SELECT a.path, 'static-iv', a.line, a.col FROM go_args a JOIN go_imports m ON m.path = a.path AND m.local = a.pkg
    WHERE a.arg_k = 1 AND m.import_path = 'crypto/cipher' AND a.fn IN ({lst(GO_IV_CONSTRUCTORS)})
      AND (a.byte_slice OR a.inline_make)
  UNION ALL
  SELECT s.path, 'deprecated-tls', s.line, s.col FROM go_sels s JOIN go_imports m ON m.path = s.path AND m.local = s.pkg
    WHERE m.import_path = 'crypto/tls' AND s.fn IN ({lst(GO_WEAK_TLS_NAMES)})
)"""


def syntax_findings_sql(hits: str, files: str, name: str) -> str:
    return f"""{name} AS (
  SELECT h.rule_id, r.title, r.description, r.severity, 'high' AS confidence, r.remediation, h.path AS file,
         h.line::INTEGER AS line, h.col::INTEGER AS "column",
         {trim_ws("coalesce(string_split(f.content, chr(10))[h.line], '')")} AS snippet
  FROM {hits} h JOIN {_rule_values()} ON r.rule_id = h.rule_id JOIN {files} f ON f.path = h.path
)"""


def go_oracles() -> dict[str, str]:
    from .queries import GO_RULE_QUERIES
    base = f"WITH {go_ctes()}"
    findings = f"{base}, {go_hits_sql()}, {syntax_findings_sql('go_hits', 'gofiles', 'gf')} SELECT {FINDING_COLS} FROM gf"
    per_rule = {k: f"SELECT * FROM ({findings}) WHERE rule_id IN ({', '.join(sql_str(r) for r in v)})"
                for k, v in GO_RULE_QUERIES.items()}
    return {
        **per_rule,
        "go_tokens": f"{base} SELECT path, tok, line, col, dbefore AS depth FROM sig",
        "go_imports": f"{base} SELECT path, local, import_path FROM go_imports",
        "go_calls": f"{base} SELECT path, pkg, fn, line, col FROM go_calls",
        "go_findings": f"{base}, {go_hits_sql()}, {syntax_findings_sql('go_hits', 'gofiles', 'gf')} "
                       f"SELECT {FINDING_COLS} FROM gf",
    }


# ---------------------------------------------------------------------------
# Python syntax tier in SQL
# ---------------------------------------------------------------------------
PY_TOKEN_RE2 = (r"(?s)#[^\n]*|[rRbBuUfF]{0,2}(?:'''(?:[^\\]|\\.)*?'''|" + '"""' + r"(?:[^\\]|\\.)*?" + '"""'
                + r"|'(?:[^'\\\n]|\\.)*'|" + '"' + r'(?:[^"\\\n]|\\.)*' + '"'
                + r")|[\pL_][\pL\p{Nd}_]*|[0-9][0-9A-Za-z_.]*|\\\n|[\t\n\x0B\f\r ]+|.")


def _pyname(x: str) -> str:
    from ..operators.py_syntax import PY_KEYWORDS
    return f"({_ident(x)} AND {x} NOT IN ({', '.join(sql_str(k) for k in PY_KEYWORDS)}))"


def _pystr(x: str) -> str:
    return f"regexp_matches({x}, '^[rRbBuUfF]{{0,2}}[''\"]')"


def py_ctes(files_cte: str) -> str:
    from ..sources.catalog import PY_TARGETS, PY_WEAK_HASH_NAMES
    tg = ", ".join(f"({sql_str(k)}, {sql_str(v)})" for k, v in PY_TARGETS)
    wh = ", ".join(f"({sql_str(k)}, {sql_str(v)})" for k, v in PY_WEAK_HASH_NAMES)
    lt = ", ".join(f"lag(tok, {k}) OVER wl AS ltok_m{k}" for k in (1, 2, 3, 4))
    cont = (f"coalesce(tok = '.' OR (ltok_m1 = '.' AND {_ident('tok')}) OR (tok IN ('(', '[') AND "
            f"({_pyname('ltok_m1')} OR ltok_m1 IN (')', ']') OR {_pystr('ltok_m1')})) OR tok IN (')', ']', '}}'), false)")
    return f"""{files_cte},
{token_ctes('pyfiles', PY_TOKEN_RE2, r'(?s)^(?:[\t\n\x0B\f\r ]+|#.*|\\\n)$', prefix='p', continuation=True)},
pnb AS (
  SELECT *, lag(tok, 1) OVER w AS tok_m1, lead(tok, 1) OVER w AS tok_p1, lag(line, 1) OVER w AS line_m1
  FROM psig WINDOW w AS (PARTITION BY path ORDER BY i)
),
pst AS (
  SELECT *, sum((dbefore = 0 AND (line_m1 IS NULL OR (line_m1 <> line AND NOT joined) OR tok_m1 = ';'))::INTEGER)
              OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING) AS stmt
  FROM pnb
),
pkw AS (
  SELECT *, first_value(tok) OVER (PARTITION BY path, stmt ORDER BY i) AS kw,
         lag(stmt, 1) OVER (PARTITION BY path ORDER BY i) AS stmt_m1,
         CASE WHEN tok IN (')', ']', '}}') THEN dafter ELSE dbefore END AS clvl
  FROM pst
),
pl AS (SELECT *, {lt} FROM pkw WINDOW wl AS (PARTITION BY path, clvl ORDER BY i)),
pl2 AS (
  SELECT *, lag(lnp, 1) OVER (PARTITION BY path, clvl ORDER BY i) AS lnp_m1 FROM (
    SELECT *, last_value(CASE WHEN tok NOT IN ('(', ')') THEN tok END IGNORE NULLS)
                OVER (PARTITION BY path, clvl ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lnp
    FROM pl)
),
pc AS (
  SELECT *,
    last_value(CASE WHEN NOT {cont} THEN line END IGNORE NULLS)
      OVER (PARTITION BY path, clvl ORDER BY i ROWS UNBOUNDED PRECEDING) AS cs_line,
    last_value(CASE WHEN NOT {cont} THEN col END IGNORE NULLS)
      OVER (PARTITION BY path, clvl ORDER BY i ROWS UNBOUNDED PRECEDING) AS cs_col,
    CASE WHEN coalesce(ltok_m1 = '.' AND {_ident('tok')} AND tok_m1 = '.' AND kw <> 'import'
                       AND NOT (kw = 'from' AND dbefore = 0), false)
         THEN (CASE WHEN ltok_m2 = ')' AND {_pyname('lnp_m1')} THEN lnp_m1
                    WHEN ltok_m2 <> ')' AND {_ident('ltok_m2')} THEN ltok_m2 END) || '.' || tok END AS suffix2
  FROM pl2
),
pf AS (
  SELECT *, lag(suffix2, 1) OVER wl AS fsuffix, lag(cs_line, 1) OVER wl AS f_line, lag(cs_col, 1) OVER wl AS f_col,
         coalesce(tok = '(' AND stmt_m1 = stmt AND ({_pyname('ltok_m1')} OR ltok_m1 IN (')', ']') OR {_pystr('ltok_m1')}), false)
           AS call_open,
         coalesce(tok = '(' AND stmt_m1 = stmt AND {_pyname('ltok_m1')}
                  AND coalesce(ltok_m2, '') NOT IN ('.', 'def', 'class'), false) AS bare,
         tok IN ('(', '[', '{{') AS is_open,
         CASE WHEN tok IN ('(', '[', '{{') THEN dafter ELSE dbefore END AS glvl
  FROM pc WINDOW wl AS (PARTITION BY path, clvl ORDER BY i)
),
pg1 AS (SELECT *, sum(is_open::INTEGER) OVER (PARTITION BY path, glvl ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp
        FROM pf),
pg2 AS (
  SELECT *,
    first_value(CASE WHEN is_open THEN call_open END IGNORE NULLS) OVER wg AS g_is_call,
    first_value(CASE WHEN is_open AND bare THEN ltok_m1 END IGNORE NULLS) OVER wg AS g_bare,
    first_value(CASE WHEN is_open THEN fsuffix END IGNORE NULLS) OVER wg AS g_fsuffix,
    first_value(CASE WHEN is_open THEN f_line END IGNORE NULLS) OVER wg AS g_line,
    first_value(CASE WHEN is_open THEN f_col END IGNORE NULLS) OVER wg AS g_col
  FROM pg1 WINDOW wg AS (PARTITION BY path, glvl, grp ORDER BY i ROWS UNBOUNDED PRECEDING)
),
pg3 AS (
  SELECT *, CASE WHEN direct AND regexp_matches(tok, '^[0-9]+$') THEN TRY_CAST(tok AS BIGINT) END AS int_val,
         CASE WHEN direct AND {_pystr('tok')} THEN tok END AS str_val
  FROM (SELECT *, tok_m1 IN ('(', ',') AND tok_p1 IN (',', ')') AND dbefore = glvl AND coalesce(g_is_call, false)
                  AS direct FROM pg2)
),
pg4 AS (
  SELECT *, first_value(int_val IGNORE NULLS) OVER wa AS first_int, first_value(str_val IGNORE NULLS) OVER wa AS first_str
  FROM pg3 WINDOW wa AS (PARTITION BY path, glvl, grp ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
),
popens AS (SELECT path, g_bare AS bare, g_fsuffix AS fsuffix, g_line AS line, g_col AS col, first_int, first_str
           FROM pg4 WHERE call_open),
pfrom AS (
  SELECT path, stmt, toks, list_position(toks, 'import') AS imp FROM (
    SELECT path, stmt, list(tok ORDER BY i) AS toks FROM pkw WHERE kw = 'from' GROUP BY path, stmt)
),
pitems AS (
  SELECT path, stmt, array_to_string(toks[2:imp - 1], '') AS module, u.item, u.k
  FROM pfrom, unnest(string_split(regexp_replace(array_to_string(list_filter(toks[imp + 1:],
                                                                           lambda x: x NOT IN ('(', ')')), ' '),
                                                 ' ,$', ''), ' , '))
       WITH ORDINALITY AS u(item, k)
  WHERE imp > 2
),
pbind AS (
  SELECT path, stmt, k, string_split(trim(item), ' ') AS parts, module FROM pitems
),
pimports AS (
  SELECT path, bound, canonical FROM (
    SELECT *, row_number() OVER (PARTITION BY path, bound ORDER BY stmt DESC, k DESC) AS rn FROM (
      SELECT path, stmt, k, CASE WHEN len(parts) = 3 AND parts[2] = 'as' THEN parts[3]
                                 WHEN len(parts) = 1 THEN parts[1] END AS bound,
             module || '.' || parts[1] AS canonical, parts[1] AS orig FROM pbind)
    WHERE bound IS NOT NULL AND {_pyname('bound')} AND orig <> '*')
  WHERE rn = 1
),
ptargets(k, rule_id) AS (VALUES {tg}),
pweak(k, rule_id) AS (VALUES {wh}),
py_hits AS (
  SELECT DISTINCT path, rule_id, line, col FROM (
    SELECT c.path, t.rule_id, c.cs_line AS line, c.cs_col AS col FROM pc c JOIN ptargets t ON t.k = c.suffix2
    UNION ALL
    SELECT path, 'weak-key-rsa', line, col FROM popens WHERE fsuffix = 'RSA.generate' AND first_int < 2048
    UNION ALL
    SELECT o.path, w.rule_id, o.line, o.col FROM popens o
      JOIN pweak w ON w.k = lower(regexp_replace(o.first_str, '^[''"]+|[''"]+$', '', 'g'))
      WHERE o.fsuffix = 'hashlib.new'
    UNION ALL
    SELECT o.path, t.rule_id, o.line, o.col FROM popens o JOIN pimports m ON m.path = o.path AND m.bound = o.bare
      JOIN ptargets t ON t.k = m.canonical
  )
)"""


def py_oracles() -> dict[str, str]:
    files = f"{classified_cte()},\npyfiles AS (SELECT path, content FROM classified WHERE status = 'scanned' AND tier = 'python')"
    base = f"WITH {py_ctes(files)}"
    return {
        "py_attributes": f"{base} SELECT path, suffix2, cs_line AS line, cs_col AS col FROM pc WHERE suffix2 IS NOT NULL",
        "py_from_imports": f"{base} SELECT path, bound, canonical FROM pimports",
        "py_findings": f"{base}, {syntax_findings_sql('py_hits', 'pyfiles', 'pyf')} SELECT {FINDING_COLS} FROM pyf",
    }


def full_scan_sql(min_rank: int = 0, include_unknown: bool = False) -> str:
    """Default scan of the code corpus: regex + Go + Python tiers, then
    suppression over every scanned file and the confidence filter."""
    files = f"""{classified_cte(include_unknown=include_unknown)},
pyfiles AS (SELECT path, content FROM classified WHERE status = 'scanned' AND tier = 'python')"""
    go_part = go_ctes().split("gofiles AS", 1)[1]
    return f"""WITH {py_ctes(files)},
gofiles AS {go_part},
{go_hits_sql()},
{syntax_findings_sql('go_hits', 'gofiles', 'gf')},
{syntax_findings_sql('py_hits', 'pyfiles', 'pyf')},
docs AS (SELECT path, content FROM classified WHERE status = 'scanned'),
rdocs AS (SELECT path FROM classified WHERE status = 'scanned' AND tier = 'regex'),
{lines_cte('docs')},
rx AS (
  SELECT s.rule_id, s.title, s.description, s.severity, 'low' AS confidence, s.remediation,
         l.path AS file, l.line,
         (strlen(regexp_extract(l.text, '^(.*?)(?:' || s.pattern || ')', 1)) + 1)::INTEGER AS "column",
         {trim_ws('l.text')} AS snippet
  FROM lines l JOIN {schemes_values(weak_set())} ON regexp_matches(l.text, s.pattern)
  WHERE l.path IN (SELECT path FROM rdocs)
),
raw_findings AS (SELECT * FROM rx UNION ALL SELECT * FROM gf UNION ALL SELECT * FROM pyf),
{directives_cte()}
{kept(min_rank=min_rank)}"""


def report_oracles(full: str) -> dict[str, str]:
    """The reports from the findings in SQL: documents as (position, text) and the summary line."""
    from ..sources.catalog import RULES, SARIF_SCHEMA, TOOL_NAME, TOOL_URI, TOOL_VERSION

    def obj(*pairs, optional=()):
        parts = [f"""CASE WHEN {v} {empty} THEN '' ELSE ',"{k}":' || {j} END""" if (empty := dict(optional).get(k))
                 else f"""',"{k}":' || {j}""" for k, v, j in pairs]
        return "'{' || substr(" + " || ".join(parts) + ", 2) || '}'"

    def q(c):
        return c, f"to_json({c})::VARCHAR"

    def n(c):
        return c, f"{c}::VARCHAR"

    by = 'file, line, "column", rule_id'
    errors = """(SELECT 'lost/' || item_id || '.c: unreadable' AS m, row_number() OVER (ORDER BY 'lost/' || item_id || '.c') AS e FROM benchmark)"""
    finding = obj(*[(c, *q(c)) for c in ("rule_id", "title", "description", "severity", "confidence", "remediation", "file")],
                  ("line", *n("line")), ("column", *n('"column"')), ("snippet", *q("snippet")),
                  optional=(("remediation", "= ''"), ("column", "= 0"), ("snippet", "= ''")))
    status = f"(SELECT status, count(*) AS n FROM (WITH {classified_cte()} SELECT status FROM classified) GROUP BY status)"
    scanned, skipped = (f"coalesce((SELECT n FROM {status} WHERE status = '{x}'), 0)" for x in ("scanned", "skipped"))
    helped = " ".join(f"WHEN {sql_str(r)} THEN {sql_str(rem)}" for r, _, _, _, rem in RULES)
    text = lambda v: (v, f"""'{{"text":' || to_json({v})::VARCHAR || '}}'""")
    rule = obj(("id", *q("rule_id")), ("name", *q("title")), ("shortDescription", *text("title")),
               ("fullDescription", *text("description")), ("help", *text(f"CASE rule_id {helped} ELSE '' END")),
               ("properties", "1", """'{"tags":["cryptography","security"]}'"""))
    level = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"
    place = """'[{"physicalLocation":{"artifactLocation":{"uri":' || to_json(file)::VARCHAR || '},"region":{"startLine":' || line || """ \
            """CASE WHEN "column" = 0 THEN '' ELSE ',"startColumn":' || "column" END || '}}}]'"""
    result = obj(("ruleId", *q("rule_id")), ("level", *q(level)), ("message", *text("description")), ("locations", "1", place),
                 ("properties", "1", """'{"confidence":' || to_json(confidence)::VARCHAR || '}'"""))
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{TOOL_NAME}","version":"{TOOL_VERSION}",' \
           f'"informationUri":"{TOOL_URI}","rules":['
    severities = " || ".join(f"CASE WHEN count(*) FILTER (severity = '{s}') > 0 THEN ' {s}=' || count(*) FILTER (severity = '{s}') ELSE '' END"
                             for s in ("critical", "high", "medium", "low", "info"))
    return {
        "report_json": f"""WITH f AS (SELECT *, row_number() OVER (ORDER BY {by}) AS p FROM ({full})), e AS (SELECT * FROM {errors})
SELECT 0::BIGINT AS position, '{{"tool":"{TOOL_NAME}","version":"{TOOL_VERSION}","files_scanned":' || {scanned} ||
       ',"files_skipped":' || {skipped} || ',"findings":[' AS text
UNION ALL SELECT p, CASE WHEN p > 1 THEN ',' ELSE '' END || {finding} FROM f
UNION ALL SELECT (SELECT count(*) FROM f) + 1, '],"errors":['
UNION ALL SELECT (SELECT count(*) FROM f) + 1 + e, CASE WHEN e > 1 THEN ',' ELSE '' END || to_json(m)::VARCHAR FROM e
UNION ALL SELECT (SELECT count(*) FROM f) + (SELECT count(*) FROM e) + 2, ']}}'""",
        "report_sarif": f"""WITH f AS (SELECT *, row_number() OVER (ORDER BY {by}) AS p FROM ({full})),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS k FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY p) = 1))
SELECT 0::BIGINT AS position, {sql_str(head)} AS text
UNION ALL SELECT k, CASE WHEN k > 1 THEN ',' ELSE '' END || {rule} FROM r
UNION ALL SELECT (SELECT count(*) FROM r) + 1, ']}}}},"results":['
UNION ALL SELECT (SELECT count(*) FROM r) + 1 + p, CASE WHEN p > 1 THEN ',' ELSE '' END || {result} FROM f
UNION ALL SELECT (SELECT count(*) FROM r) + (SELECT count(*) FROM f) + 2, ']}}]}}'""",
        "report_summary": f"""SELECT 'Scanned ' || {scanned} || ' files (' || {skipped} || ' skipped); ' || count(*) || ' finding(s):' ||
       {severities} || chr(10) || (SELECT count(*) FROM benchmark) || ' error(s) during scan' AS text, count(*) > 0 AS gate FROM ({full})""",
    }


def full_scan_oracles() -> dict[str, str]:
    full = full_scan_sql()
    return report_oracles(full) | {
        "code_scan_default": full,
        "min_confidence_high": full_scan_sql(min_rank=2, include_unknown=True),
        "rules_fired": f"""SELECT rule_id, min(title) AS title, min_by(file, (file, line, "column")) AS first_file,
       min_by(line, (file, line, "column")) AS first_line, min_by("column", (file, line, "column")) AS first_column
FROM ({full}) GROUP BY rule_id""",
        "report_text_lines": f"""SELECT file, line, "column", rule_id, k, text FROM (
  SELECT file, line, "column", rule_id, 0 AS k,
         printf('%s:%d:%d %s [%s] %s (%s)', file, line, "column", severity, rule_id, title, confidence) AS text
  FROM ({full})
  UNION ALL SELECT file, line, "column", rule_id, 1, '    ' || snippet FROM ({full}) WHERE snippet <> ''
  UNION ALL SELECT file, line, "column", rule_id, 2, '    fix: ' || remediation FROM ({full}) WHERE remediation <> '')""",
    }
