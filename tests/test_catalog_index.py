"""The needle index, inline suppression on the row, and the facts of the syntax tiers."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ciphersift import ScanOptions, scan
from ciphersift.operators import go_syntax, needle_index, py_syntax
from ciphersift.operators.needle_index import CatalogError, required_needle
from ciphersift.operators.tokens import python_tokens
from ciphersift.sources.config import parse_config


@pytest.mark.parametrize("pattern,want", [
    (r"(?i)\bHome_Grown\b", "home_grown"), (r"abcd?efgh", "efgh"), (r"abc*defg{2}hijkl", "hijkl"), (r"abcd|efgh", None),
    (r"(abcd|x)efghi", "efghi"), (r"[a\]b]cdefg", "cdefg"), (r"abcd\.efg\(", "abcd.efg("), (r"\bab\w+cd", None), (r"x(?:y(z)[)]w)longer+s", "longer"),
    (r"[[:alpha:]]+suffix", "suffix"), (r"\x41bcdef", None), (r"ünder_line", "nder_line"), (r"(?s)a.cdef$", "cdef")])
def test_required_needle(pattern, want):
    assert required_needle(pattern) == want


def test_every_match_holds_the_needle():
    rnd = random.Random(5)
    atoms = ["abcd", "ef", "g", "[hi]", "j+", "k*", "(?:lm|n)", "o?", r"\.", r"\b", "p{1,2}", ".", "qrst", "(?i)", "u|vwxy"]
    checked = 0
    for _ in range(3000):
        pattern = "".join(rnd.choice(atoms) for _ in range(rnd.randint(1, 6)))
        if "(?i)" in pattern[1:] or re.search(r"(^|\|)[*+?{]|[*+?}][*+?{]", pattern.replace("(?", "(")):
            continue
        needle = required_needle(pattern)
        for _ in range(6):
            text = "".join(rnd.choice(["abcd", "ABCD", "ef", "g", "h", "j", "k", "lm", "o", ".", "pp", "qrst", "vwxy", " "])
                           for _ in range(rnd.randint(1, 9)))
            if needle and re.search(pattern, text):
                checked += 1
                assert needle in text.lower(), (pattern, text)
    assert checked > 100


def test_catalog_equals_literal_schemes(spark, corpus, monkeypatch):
    schemes = [("xor", r"(?i)\bxor_encrypt\b", "broken"), ("wordy", r"roll\w+own", "legacy"), ("short", r"\bzz\b", None),
               ("choice", r"caesar|rot13", "contextual"), ("xor", "encrypt", "weak"), ("odd", r"(?i)ask+ed", "strange")]
    files = {"a.txt": "call XOR_encrypt(x)\n roll_your_own zz rot13\nxor_encrypter caesar\n",
             "b.txt": "# ciphersift:ignore scheme:xor\nxor_encrypt zz\nxor_encrypt # ciphersift:ignore\nnone\nétude zz aſkKed",
             "c.txt": "", "d.txt": "nothing here"}
    listed = {"custom_schemes": [{"id": i, "pattern": p, "class": c or ""} for i, p, c in schemes]}
    want = scan(spark, corpus(files), ScanOptions(config=parse_config(listed), include_unknown=True)).findings
    table = spark.createDataFrame([(k, i, p, c) for k, (i, p, c) in enumerate(schemes)],
                                  "ord long, id string, pattern string, class string")
    for rows in (needle_index.MAX_BROADCAST_ROWS, 0):
        monkeypatch.setattr(needle_index, "MAX_BROADCAST_ROWS", rows)
        got = scan(spark, corpus(files), ScanOptions(catalog=table, include_unknown=True)).findings
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() == 10  # 2 + 3 + 2 in a.txt, zz twice and the folded one in b.txt


def test_catalog_plan_does_not_grow(spark, corpus):
    def plan(n):
        table = spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("s"), "id").alias("id"),
                                      F.concat(F.lit("needle"), "id").alias("pattern"))
        compiled = needle_index.compiled_catalog(table)
        found = needle_index.catalog_findings(corpus({"a": "needle7"}).select("path", "content"), compiled)
        return len(found._jdf.queryExecution().optimizedPlan().toString()), found.count()
    (small, a), (large, b) = plan(10), plan(5000)
    assert abs(small - large) < 200 and a == b == 1


def test_catalog_errors(spark, corpus):
    for pattern in ("(?=x)", "a++"):
        table = spark.createDataFrame([(0, "good", "abcd"), (1, "bad", pattern)], "ord long, id string, pattern string")
        with pytest.raises(CatalogError, match="bad"):
            scan(spark, corpus({"a.txt": "abcd"}), ScanOptions(catalog=table))


def tokens(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(python_tokens(F.col("t")).alias("ts"))
    return [(r.tok, r.code) for r in df.first().ts]


@pytest.mark.parametrize("text", [
    "x = f'{a}{{b}}{c!r:>{w}}' + 1", 'f"{d["k"]} {f"{g(1)}"}"', "f'''{\n a}\n'''", "f'{'", "f'}'", "f'{a'", "rb'x' f''", "F\"\\{a}\\N{DASH}\"",
    "f'{a:%H:%M}' 'é' # f'{no}'", "f'{ {1: 2}[1] }'", "f'" + "{x}" * 500 + "'", "f'" + "y" * 20000 + "{z}'"])
def test_python_tokens_are_the_text(spark, text):
    assert "".join(t for t, _ in tokens(spark, text)) == text


def test_islands(spark):
    got = [t for t, code in tokens(spark, "f'a {h.md5(x)!r:>{w}} b {{c}} {f\"{s.t}\"}'") if code and t.strip()]
    assert got == ["{", "h", ".", "md5", "(", "x", ")", "{", "w", "}", "}", "{", "{", "s", ".", "t", "}", "}"]


def facts(spark, corpus, fn, sig, text, name):
    df = fn(sig(corpus({name: text}).select("path", "content")))
    return sorted(tuple(r)[1:] for r in df.collect())


def test_statement_starts(spark, corpus):
    text = ("if a:\n  from m import b as c; from n import (d,\n   e as g)\nelse: from o import h\nx: int = 1\n"
            "s = '''\nfrom p import i'''\nt = 1 \\\n  if y else from_ \nfrom .q import *\nfrom . import r\n")
    got = facts(spark, corpus, py_syntax.py_from_imports, py_syntax.py_sig_tokens, text, "a.py")
    assert got == [("c", "m.b"), ("d", "n.d"), ("g", "n.e"), ("h", "o.h"), ("r", "..r")]


def test_go_files_without_a_package_clause(spark, corpus):
    bare = 'import "crypto/md5"\nvar _ = md5.New()\n'
    found = scan(spark, corpus({"a.go": bare, "b.go": "// c\n\n/* d */ package b\n" + bare})).findings
    assert [(r.file, r.line) for r in found.collect()] == [("b.go", 5)]


def test_trailing_commas_start_no_argument(spark, corpus):
    text = 'package a\nfunc f() { p.G(x,); p.H(x, y,); p.I(); p.J(q.K(1, 2,),) }\n'
    got = facts(spark, corpus, go_syntax.go_call_args, go_syntax.go_sig_tokens, text, "a.go")
    assert [(r[1], r[2]) for r in got] == [("G", 0), ("H", 0), ("H", 1), ("J", 0), ("K", 0), ("K", 1)]


def test_sniff_is_an_option(spark, corpus):
    files = {"a.txt": "\0 md5", "b.txt": "md5" + " " * 8000 + "\0", "c.txt": "é" * 4000 + "\0md5"}
    count = lambda **kw: sorted(r.file for r in scan(spark, corpus(files), ScanOptions(include_unknown=True, **kw)).findings.collect())
    assert count() == ["a.txt", "b.txt", "c.txt"]
    assert count(skip_binary=True) == ["b.txt", "c.txt"]


def test_exact_regex_runs_behind_the_needle_only(spark, corpus):
    """A line meets every scheme that shares one gram with it: of those pairs, the join checks the needle and no regex."""
    docs = corpus({"a": "the cat sat, thé cat\nno cater\n\U0001F600é The Cat, the cat", "b": "other catalogue"}).select("path", "content")
    catalog = spark.createDataFrame([(1, "p", r"(?i)\bthe cat\b"), (2, "w", r"\bcater[a-z]*"), (3, "s", r"(?i)\ba b\b")],
                                    "ord bigint, id string, pattern string")
    found = needle_index.catalog_findings(docs, needle_index.checked_catalog(catalog))
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x and "gram#" in x]
    assert joins and not any("java#" in x for x in joins)
    assert sorted((r.file, r.line, r.column, r.rule_id) for r in found.collect()) == [
        ("a", 1, 1, "scheme:p"), ("a", 2, 4, "scheme:w"), ("a", 3, 8, "scheme:p")]


def test_small_catalogs_meet_only_needles_that_lines_hold(spark, corpus, monkeypatch):
    """Tasks look for whole needles, their edges and case; what is found equals the way of larger catalogs, by grams."""
    rnd = random.Random(7)
    bits = ["the", "cat", "Cat", "CAT", " ", " ", "s", "ſ", "k", "K", "é", "É", "İ", "\U0001F600", ".", "_", "a b", "cater", "concatenation", "\r", "\r\n", "\n"]
    files = {f"f{i}": "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for i in range(150)}
    files["held"] = "thé cat\nconcatenation of the cats"
    patterns = [r"(?i)\bthe cat\b", r"\bcat", r"\bCat[a-z]*", r"(?i)cats\b", r"(?i)\bka\b|x", r"(?i)k cat", r"\bs\b", r"(?i)^the", r"(?i)\Bcat", r"a b",
                r"\bconcatenation\b", r"(?i)\bthe[a-z]+enation", r"(?i)\.the", r"é\bcat", r"(?i)\Acater", r"the +cat", r"cat\b\.", r"(?i)s\b cat"]
    table = spark.createDataFrame([(k, f"p{k}", p) for k, p in enumerate(patterns)], "ord long, id string, pattern string")
    compiled = needle_index.checked_catalog(table)
    docs = corpus(files).select("path", "content")
    got = needle_index.catalog_findings(docs, compiled)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_distinct" not in plan
    monkeypatch.setattr(needle_index, "MAX_BROADCAST_ROWS", 0)
    want = sorted(map(tuple, needle_index.catalog_findings(docs, compiled).collect()))
    assert sorted(map(tuple, got.collect())) == want
    assert len({r[0] for r in want}) == len(patterns)  # each pattern is found somewhere


def test_needles_are_found_exactly(monkeypatch):
    monkeypatch.setattr(needle_index, "STEP", 16)
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abAB _é") for _ in range(n))
    needles = {n for n in (word(rnd.randint(2, 30)) for _ in range(400)) if n.isascii()} | {"ab" * 9, "ab" * 9 + "a"}
    known = [f"{rnd.choice([0, 4, 8, 12]):X}{n}" for n in needles]
    known = sorted({k if int(k[0], 16) & 4 else k.lower() for k in known})
    lines = [word(rnd.randint(0, 80)) for _ in range(300)] + ["", "AB" * 30] + [n[1:] for n in known]
    held = needle_index.Needles(known)
    needle, line, skip = held.held(pa.array(lines), pa.array([x.lower() for x in lines]))
    exact = lambda k: int(k[0], 16) & 4
    want = {(k, i): (x if exact(k) else x.lower()).find(k[1:]) for k in known for i, x in enumerate(lines)}
    got = {(held.needles[n], i): s for n, i, s in zip(needle.tolist(), line.tolist(), skip.tolist())}
    assert set(got) == {p for p, at in want.items() if at >= 0}
    assert all(s == (max(want[p] - 1, 0) if int(p[0][0], 16) & 8 else 0) for p, s in got.items())
