"""The sorts by nesting level read only the rows and columns that a fact reads."""

import pytest

from ciphersift.operators import go_syntax, py_syntax

GO = ('package p\nimport "crypto/aes"\nfunc f() {\n\tx := a + b\n\taes.NewCipher([]byte{1, 2})\n\taes.NewCipher(g(1, 2), make([]byte, 16))\n'
      '}\n)) aes.NewCipher([]byte{7})\n')
PY = "import hashlib\nx = a + b - c\nf(g(1), 2, 'q')\nh((1), [3], *k, 4)\n)) m(5\nn(\n"


def nodes(plan):
    yield plan
    it = plan.children().iterator()
    while it.hasNext():
        yield from nodes(it.next())


def docs(spark, text):
    return spark.createDataFrame([("a", text), ("b", text)], "path string, content string")


@pytest.mark.parametrize("hits, sig, text", [(go_syntax.go_hits, go_syntax.go_sig_tokens, GO),
                                             (py_syntax.py_hits, py_syntax.py_sig_tokens, PY)])
def test_level_windows_read_narrow_rows(spark, hits, sig, text):
    plan = hits(sig(docs(spark, text)))._jdf.queryExecution().optimizedPlan()
    by_level = [n for n in nodes(plan) if n.nodeName() == "Window" and "lvl#" in n.partitionSpec().mkString()]
    assert by_level
    for n in by_level:
        read = n.child().output().mkString(" ")
        assert "grp#" not in n.partitionSpec().mkString()  # groups need no sort of their own
        assert not any(f" {c}#" in " " + read for c in ("tok_m1", "tok_m2", "tok_p1", "tok_p2", "tok_p3", "tok_p8", "brk", "stmt_p3"))


def test_argument_rows_leave_other_tokens_out(spark):
    sig = go_syntax.go_sig_tokens(docs(spark, GO))
    kept = go_syntax.arg_facts(sig)
    assert 0 < kept.count() < sig.count() / 3


def test_go_arguments_with_brackets_that_do_not_match(spark):
    got = {tuple(r) for r in go_syntax.go_call_args(go_syntax.go_sig_tokens(docs(spark, GO))).where("path = 'a'").collect()}
    assert {r[1:4] + r[4:5] + r[6:] for r in got} == {
        ("aes", "NewCipher", 0, 5, True, False, None), ("aes", "NewCipher", 0, 6, False, False, None),
        ("aes", "NewCipher", 1, 6, False, True, None), ("aes", "NewCipher", 0, 8, True, False, None)}


def test_python_arguments_belong_to_their_own_call(spark):
    got = {(r.callee, r.first_int, r.first_str) for r in py_syntax.py_calls(py_syntax.py_sig_tokens(docs(spark, PY))).collect()}
    assert got == {("f", 2, "'q'"), ("g", 1, None), ("h", 4, None), ("m", None, None), ("n", None, None)}
