"""The pattern dialect: what is refused, and equal matches to DuckDB's RE2 on random patterns."""

import random

import pytest
from pyspark.sql import functions as F

from ciphersift.functions.regex import RegexError, java_regex, translate, validate_re2
from ciphersift.sources.config import ConfigError, parse_config

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("pattern", ["(foo", "*a", "[z-a]", "a**", "a+*", "a{2,1}", "(?=x)", "(?<!x)", "(?>x)", r"\1", "a++", "[a", "[[:no:]]",
                                     "\\", "x{1001}", "(?P<a>x)(?P<a>y)", ")", "(?y)", r"\x{110000}", r"\p{Greek", r"[\b]", r"[a-\d]",
                                     "|*", "(*a)", "(?)", r"\p{greek}", r"a\Z"])
def test_refused(spark, pattern):
    with pytest.raises(RegexError):
        validate_re2(pattern)
    with pytest.raises(ConfigError):
        parse_config({"custom_schemes": [{"id": "x", "pattern": pattern}]})


def test_a_class_that_java_does_not_know(spark):
    translate(r"\p{Nonesuch}")
    with pytest.raises(RegexError):
        validate_re2(r"\p{Nonesuch}")


def test_printed():
    assert translate("[a&&b]x") == r"[\x{26}ab]x"
    assert translate(r"(?U)a+b*?") == "a+?b*"
    assert translate(r"\ba", drop_boundaries=True) == "a"


ATOMS = ["a", "B", "é", "ß", "s", "K", "1", " ", r"\.", ".", "[a-c]", "[^a-c]", r"[\w-]", r"\d", r"\W", r"\s", r"\b", r"\B", "^", "$", "[[:upper:]]",
         "[^[:alpha:]é]", r"\pL", r"\P{Lu}", r"[\p{Greek}b]", "(a)", "(?:b|)", "(?i)", "(?s)", "(?i:k)", "(?-i)", "|", r"\x41", r"\Qa.\E", "(a|B)", "[&&]"]
REPEATS = ["", "", "", "", "*", "+", "?", "{2}", "{1,}", "{0,2}", "*?", "+?", "??", "{1,2}?"]
PIECES = ["a", "A", "b", "B", "é", "É", "ß", "s", "ſ", "k", "K", "K", "1", " ", ".", "\t", "λ", "Σ", "ς", "&", "-", "_", "\u0085", "😀", "ı", "İ"]


def test_random_patterns_match_as_in_duckdb(spark):
    rnd, con = random.Random(11), duckdb.connect()
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 9))) for _ in range(150)]
    patterns = []
    while len(patterns) < 250:
        p = "".join(rnd.choice(ATOMS) + rnd.choice(REPEATS) for _ in range(rnd.randint(1, 4)))
        try:
            con.execute("SELECT regexp_matches('a', ?)", [p]).fetchall()
            known = True
        except duckdb.Error:
            known = False
        try:
            translate(p)
            ours = True
        except RegexError as e:
            ours = "case folding of" in str(e)
            known = known and not ours
        assert ours == known or not known, p  # nothing that RE2 takes is refused
        if ours and known:
            patterns.append(p)
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = df.select(*[F.when(F.col("t").rlike(java_regex(p)), F.octet_length(F.regexp_extract(
        "t", f"(?ds)^(.*?)(?:{translate(p)})", 1))).alias(f"c{k}") for k, p in enumerate(patterns)]).collect()
    for t, row in zip(texts, got):
        for p, mine in zip(patterns, row):
            want = con.execute("SELECT CASE WHEN regexp_matches(t, p) THEN strlen(regexp_extract(t, '^((?s:.)*?)(?:' || p || ')', 1)) END "
                               "FROM (SELECT ? AS t, ? AS p)", [t, p]).fetchone()[0]
            assert mine == want, (p, t)
