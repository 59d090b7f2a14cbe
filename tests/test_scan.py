"""Scan behaviour on small inline corpora (the reference's example-based
cases, as DataFrame tests)."""

import pytest

from ciphersift import ScanOptions, scan
from ciphersift.operators.scheme_scan import UnknownSchemeError, resolve
from ciphersift.sources.config import ConfigError, parse_config


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


ROUTING = {
    "a.go": 'package a\nimport "crypto/md5"\nvar _ = md5.New()\n',
    "b.rb": "require 'digest'\nDigest::MD5.hexdigest('x')\n",
    "vendor/skip.go": 'package v\nimport "crypto/md5"\nvar _ = md5.New()\n',
    "notes.txt": "uses md5 somewhere\n",
}


def test_routing_and_filtering(spark, corpus):
    c = corpus(ROUTING)
    assert scan(spark, c).findings.count() == 2
    high = scan(spark, c, ScanOptions(min_confidence="high")).findings
    assert rows(high, "file", "rule_id") == [("a.go", "weak-hash-md5")]
    assert scan(spark, c, ScanOptions(include_unknown=True)).findings.count() == 3
    files = [r[0] for r in scan(spark, c).findings.select("file").collect()]
    assert not any(f.startswith("vendor/") for f in files)


def test_suppression_exclude_override(spark, corpus):
    c = corpus({
        "a.go": 'package a\nimport ("crypto/md5"; "crypto/sha1")\nvar _ = md5.New()\n'
                'var _ = sha1.New() // ciphersift:ignore weak-hash-sha1\n',
        "skip/x.go": 'package s\nimport "crypto/md5"\nvar _ = md5.New()\n',
    })
    cfg = {"exclude": ["skip/**"], "rules": {"severity": {"weak-hash-md5": "low"}}}
    f = scan(spark, c, ScanOptions(config=cfg)).findings
    assert rows(f, "file", "rule_id", "severity") == [("a.go", "weak-hash-md5", "low")]


def test_disabled_and_custom_scheme(spark, corpus):
    c = corpus({"a.rb": "require 'digest'\nDigest::MD5.hexdigest('x')\n", "b.txt": "call xor_encrypt(data) here\n"})
    cfg = {"include_unknown": True, "rules": {"disable": ["scheme:md5"]},
           "custom_schemes": [{"id": "internal-xor", "class": "broken", "pattern": r"(?i)\bxor_encrypt\b"}]}
    f = scan(spark, c, ScanOptions(config=cfg)).findings
    ids = [r[0] for r in f.select("rule_id").collect()]
    assert ids.count("scheme:md5") == 0
    assert ids.count("scheme:internal-xor") == 1


def test_deterministic_order(spark, corpus):
    c = corpus({"z.go": 'package z\nimport "crypto/md5"\nvar _ = md5.New()\n',
                "a.go": 'package a\nimport "crypto/des"\nvar _, _ = des.NewCipher(nil)\n'})
    got = [r.file for r in scan(spark, c).findings.collect()]
    assert got == ["a.go", "z.go"]


GO_MAIN = '''package main

import (
	"crypto/des"
	"crypto/md5"
	"crypto/rand"
	"crypto/rsa"
	"crypto/tls"
	mrand "math/rand"
)

func main() {
	_ = md5.New()
	_, _ = des.NewTripleDESCipher(key)
	_, _ = des.NewCipher(key)
	_, _ = rsa.GenerateKey(rand.Reader, 1024)
	_, _ = rsa.GenerateKey(rand.Reader, 4096)
	_ = mrand.Intn(10)
	_ = &tls.Config{MinVersion: tls.VersionTLS11}
}
'''


def test_go_syntax_tier(spark, corpus):
    f = scan(spark, corpus({"m.go": GO_MAIN})).findings
    got = rows(f, "rule_id", "confidence")
    assert got == sorted([("weak-hash-md5", "high"), ("weak-cipher-3des", "high"), ("weak-cipher-des", "high"),
                          ("weak-key-rsa", "high"), ("insecure-random", "high"), ("deprecated-tls", "high")])
    md5 = f.where("rule_id = 'weak-hash-md5'").first()
    assert (md5.line, md5.column, md5.snippet) == (13, 6, "_ = md5.New()")


def test_go_alias_local_and_clean(spark, corpus):
    c = corpus({
        "alias.go": 'package a\nimport secret "crypto/md5"\nfunc f() { secret.New() }\n',
        "clean.go": 'package a\nimport ("crypto/sha256"; "crypto/aes")\nfunc f(k []byte) { sha256.New(); aes.NewCipher(k) }\n',
        "local.go": 'package a\nfunc f() { md5 := x(); md5.New() }\n',
    })
    assert rows(scan(spark, c).findings, "file", "rule_id") == [("alias.go", "weak-hash-md5")]


def test_go_hardcoded_key_and_static_iv(spark, corpus):
    c = corpus({
        "k.go": 'package k\nimport ("crypto/aes"; "crypto/hmac"; "crypto/sha256")\nfunc f(k []byte) {\n'
                '\taes.NewCipher([]byte("0123456789abcdef"))\n\taes.NewCipher([]byte{1, 2, 3, 4})\n'
                '\taes.NewCipher(k)\n\thmac.New(sha256.New, []byte("mac-secret"))\n}\n',
        "iv.go": 'package k\nimport "crypto/cipher"\nfunc f(b cipher.Block, v []byte) {\n'
                 '\tcipher.NewCBCEncrypter(b, []byte("1234567890123456"))\n\tcipher.NewCTR(b, make([]byte, 16))\n'
                 '\tcipher.NewCBCEncrypter(b, v)\n}\n',
        "both.go": 'package s\nimport "crypto/des"\nfunc f() { des.NewCipher([]byte("8bytekey")) }\n',
    })
    f = scan(spark, c).findings
    by = {}
    for r in f.collect():
        by.setdefault((r.file, r.rule_id), []).append(r.column)
    assert len(by[("k.go", "hardcoded-key")]) == 3
    assert len(by[("iv.go", "static-iv")]) == 2
    assert by[("both.go", "weak-cipher-des")] == [12] and by[("both.go", "hardcoded-key")] == [26]


PY = '''import hashlib, ssl
from hashlib import md5 as digest
from Crypto.Cipher import DES
from Crypto.PublicKey import RSA
import random

a = hashlib.md5(b"x")
b = digest(b"y")
c = DES.new(key, DES.MODE_ECB)
weak = RSA.generate(1024)
strong = RSA.generate(4096)
p = ssl.PROTOCOL_TLSv1
tok = random.random()
n = hashlib.new("md5")
ok = hashlib.sha256(b"z")
'''


def test_python_syntax_tier(spark, corpus):
    f = scan(spark, corpus({"t.py": PY, "ok.py": "import hashlib\nh = hashlib.sha256(b'x')\n"})).findings
    counts = {}
    for r in f.collect():
        assert r.confidence == "high" and r.file == "t.py"
        counts[r.rule_id] = counts.get(r.rule_id, 0) + 1
    assert counts == {"weak-hash-md5": 3, "weak-cipher-des": 1, "weak-key-rsa": 1, "deprecated-tls": 1,
                      "insecure-random": 1}


def test_python_chain_quirks(spark, corpus):
    src = ("import random\nv = random(1).random\nw = x[0].DES.new(k)\nz = DES[0].new(k)\n"
           "r = RSA.generate(0x400, 1024)\nh = hashlib.new('SHA')\nq = b'hashlib.md5'\n")
    got = rows(scan(spark, corpus({"e.py": src})).findings, "line", "column", "rule_id")
    assert got == [(2, 5, "insecure-random"), (3, 5, "weak-cipher-des"), (5, 5, "weak-key-rsa"),
                   (6, 5, "weak-hash-sha1")]


def test_search_mode_and_word_boundaries(spark, corpus):
    c = corpus({"x.py": 'import hashlib\nh = hashlib.sha256()\nlabel = "SHA-256"\nunrelated\n',
                "d.txt": "this described nothing; ideas only\n"})
    f = scan(spark, c, ScanOptions(schemes=["sha256"])).findings
    assert rows(f, "file", "line", "severity", "confidence") == [("x.py", 2, "info", "low"), ("x.py", 3, "info", "low")]
    assert scan(spark, c, ScanOptions(schemes=["des"])).findings.count() == 0


def test_regex_dialect_edges(spark, corpus):
    text = ("émd5\n\U0001F600 md5\nmd5_x\nTLSv1.2\ndes-ede\nxſha1\nKeccak\nſsl3\r\n")
    f = scan(spark, corpus({"e.txt": text}), ScanOptions(include_unknown=True)).findings
    got = rows(f, "line", "column", "rule_id")
    assert (1, 3, "scheme:md5") in got          # é is not an ASCII word character
    assert (2, 6, "scheme:md5") in got          # byte columns
    assert not [g for g in got if g[0] == 3]    # md5_x: no boundary
    assert (4, 1, "scheme:tls10") in got        # TLSv1.2 also fires tls10
    assert (5, 1, "scheme:des") in got and (5, 1, "scheme:3des") in got
    assert (6, 2, "scheme:sha1") in got         # ſ folds to s after a word character
    assert not [g for g in got if g[0] == 8]    # ſsl3 at line start: no boundary before ſ


def test_directive_variants(spark, corpus):
    src = ("a md5\nb md5 // ciphersift:ignore\nc md5\nd md5 // ciphersift:ignore because legacy\n"
           "e md5 # ciphersift:ignore scheme:sha1,scheme:md5\nf md5 // ciphersift:ignore all\n")
    f = scan(spark, corpus({"s.txt": src}), ScanOptions(include_unknown=True)).findings
    assert [r.line for r in f.collect()] == [1, 4]


def test_file_status(spark, corpus):
    big = "x" * 2000
    c = corpus({"a.go": "package a\n", "bin.dat": "ab\u0000cd", "n.txt": "md5\n", "big.txt": big,
                "long.c": "a" * (1 << 20) + "\nmd5\n", "empty.c": ""})
    r = scan(spark, c, ScanOptions(max_file_bytes=1500, skip_binary=True))
    st = {row.path: (row.status, row.reason) for row in r.file_status.collect()}
    assert st["a.go"] == ("scanned", None)
    assert st["bin.dat"] == ("skipped", "binary")
    assert st["n.txt"] == ("skipped", "unknown language")
    assert st["big.txt"][0] == "skipped"
    r2 = scan(spark, c, ScanOptions(max_line_bytes=1 << 20))
    st2 = {row.path: (row.status, row.reason) for row in r2.file_status.collect()}
    assert st2["long.c"] == ("error", "line too long")
    assert st2["empty.c"] == ("scanned", None)
    assert r2.findings.where("file = 'long.c'").count() == 0


def test_nothing_is_capped_by_default(spark, corpus):
    """Large files, long lines and long first lines are scanned; what could not be read is an error."""
    pad = "z" * (6 << 20)
    c = corpus({"huge.c": pad + "\nmd5\n", "one_line.js": pad + " md5", "late.c": "md5\n" + "z" * 9000 + "\u0000",
                "long_shebang": "#!/usr/bin/env " + "-x " * 40_000 + "python3\nmd5\n", "lost.c": None})
    r = scan(spark, c)
    st = {row.path: (row.status, row.reason) for row in r.file_status.collect()}
    assert st["huge.c"] == st["one_line.js"] == st["long_shebang"] == ("scanned", None)
    assert st["late.c"] == ("scanned", None) and st["lost.c"] == ("error", "unreadable")
    assert {f.file for f in r.findings.collect()} == {"huge.c", "one_line.js", "late.c"}
    assert r.counts()["error"] == 1


def test_suppression_marker_is_an_option(spark, corpus):
    c = corpus({"s.txt": "a md5 // quiet\nb\nc md5 // ciphersift:ignore\n"})
    lines = lambda **o: [f.line for f in scan(spark, c, ScanOptions(include_unknown=True, **o)).findings.collect()]
    assert lines() == [1] and lines(marker="quiet") == [3]


def test_language_detection(spark, corpus):
    from ciphersift.plans.scan import _config, classified_corpus
    c = corpus({"a/b/main.go": "", "x.py": "", "x.js": "", "x.unknownext": "", "Makefile": "",
                "s1": "#!/usr/bin/env python3\nprint(1)", "s2": "#!/usr/bin/python\n", "s3": "#!/usr/bin/node\n",
                "s4": "no shebang here", "s5": "#!/usr/bin/env python3 -u\n", "s6": "#!/usr/bin/python -u\n"})
    f = classified_corpus(c, ScanOptions(), _config(None), False, False)
    got = {r.path: r.lang for r in f.collect()}
    assert got == {"a/b/main.go": "go", "x.py": "python", "x.js": "javascript", "x.unknownext": "unknown",
                   "Makefile": "unknown", "s1": "python", "s2": "python", "s3": "javascript", "s4": "unknown",
                   "s5": "unknown", "s6": "python"}


def test_resolve(spark):
    names = lambda toks: [s.name for s in resolve(spark, toks)]
    assert "sha256" in names(["sha256"]) and "sha256" in names(["sha-256"])
    assert "3des" in names(["des3"]) and "rc4" in names(["arcfour"]) and "aes" in names(["AES"])
    weak = names(["weak"])
    assert {"md5", "des", "rc4", "sha1", "3des"} <= set(weak)
    assert not {"sha256", "aes", "ed25519"} & set(weak)
    assert names(["aes-256-gcm"]) == ["aes", "gcm"]
    with pytest.raises(UnknownSchemeError):
        resolve(spark, ["sha999"])


def test_config_validation():
    cfg = parse_config({"min_confidence": "high", "include_unknown": True, "exclude": ["testdata/**"],
                        "rules": {"disable": ["weak-hash-sha1"], "severity": {"weak-hash-md5": "low"}},
                        "custom_schemes": [{"id": "internal-xor", "pattern": r"(?i)\bxor_encrypt\b"}]})
    assert cfg.min_confidence == "high" and cfg.custom_schemes[0].cls == "weak"
    with pytest.raises(ConfigError):
        parse_config({"rules": {"severity": {"x": "bogus"}}})
    with pytest.raises(ConfigError):
        parse_config({"custom_schemes": [{"id": "x"}]})


def test_search_mode_option_rules(spark, corpus):
    c = corpus({"n.txt": "md5 and xor_encrypt\n", "m.go": 'package m\nimport "crypto/md5"\nvar _ = md5.New()\n'})
    cfg = {"custom_schemes": [{"id": "internal-xor", "pattern": r"\bxor_encrypt\b"}], "include_unknown": True}
    # search mode replaces the rule set and ignores custom schemes; Go files go to the regex tier
    f = scan(spark, c, ScanOptions(schemes=["md5"], config=cfg)).findings
    assert rows(f, "file", "line", "rule_id", "confidence") == [
        ("m.go", 2, "scheme:md5", "low"), ("m.go", 3, "scheme:md5", "low"), ("n.txt", 1, "scheme:md5", "low")]
    # blank tokens resolve to nothing: the default scan runs (custom scheme applies to the unknown file only)
    f = scan(spark, c, ScanOptions(schemes=["  "], config=cfg)).findings
    assert rows(f, "file", "rule_id") == [("m.go", "weak-hash-md5"), ("n.txt", "scheme:internal-xor"),
                                          ("n.txt", "scheme:md5")]
    # an explicit option beats the config
    f = scan(spark, c, ScanOptions(config=cfg, include_unknown=False)).findings
    assert rows(f, "file") == [("m.go",)]


def test_python_definitions_are_not_calls(spark, corpus):
    """A definition, a method or a statement that begins with a parenthesis calls nothing."""
    src = ("from hashlib import md5\ndef md5(x):\n    pass\nclass md5(object):\n    def md5(self):\n        pass\n"
           "x = md5\n(y)\nz = md5(b)\n")
    f = scan(spark, corpus({"a.py": src})).findings
    assert [(r.rule_id, r.line) for r in f.collect()] == [("weak-hash-md5", 9)]
