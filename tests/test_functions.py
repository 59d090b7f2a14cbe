"""Driver-side helpers: glob translation, regex dialect translation."""

import re

from ciphersift.functions.regex import glob_to_regex, translate
from ciphersift.operators.eligibility import compile_globs


def java_like(rx: str) -> str:
    return rx.replace("(?d)", "").replace("\\z", "$")


def test_glob_cases():
    cases = [("*.lock", "deps/yarn.lock", "yarn.lock", True), ("*.lock", "deps/lock", "lock", False),
             ("gen/**/api.ts", "gen/api.ts", "api.ts", True), ("gen/**/api.ts", "gen/a/b/api.ts", "api.ts", True),
             ("gen/**/api.ts", "x/gen/api.ts", "api.ts", False), ("v?/[0]", "v1/[0]", "[0]", True), ("v?/[0]", "v12/[0]", "[0]", False),
             (".env*", "conf/.env.local", ".env.local", True), ("old/", "old", "old", True), ("a/*", "a/b/c", "c", False)]
    for pat, rel, base, want in cases:
        (rx, on_base), = compile_globs([pat])
        assert bool(re.match(java_like(rx), base if on_base else rel)) == want, pat


def test_glob_literal_metacharacters():
    assert glob_to_regex("a[1].{x}") == "(?d)^a\\[1\\]\\.\\{x\\}\\z"


def test_translate_boundary_and_fold():
    body = translate(r"\bsha-?1\b", fold=True)
    assert "[sSſ]" in body and "(?<![0-9A-Za-z_])" in body
    assert translate(r"\s*\(") == r"[\t\n\f\r ]*\("
    assert translate(r"(?P<x>a)") == "(?<x>a)"
