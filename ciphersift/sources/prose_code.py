"""A corpus of programs below real text, derived from ``documents``.

Every document becomes one source file: its text as line comments, then one of
the programs below (``doc_id`` modulo their number).  So a lexer meets arbitrary
prose, and the work grows with the table.  Beside each program stand the facts
and findings that a reader of the program derives by hand; the oracles are these
rows, moved down by the lines of the comment.  They share no code with the scan.

A row names its place by line and by the text that begins there, so its column
is the byte offset of that text in the line.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .code_corpus import sql_str
from .corpus import from_rows, read_table


@dataclass
class Program:
    ext: str
    text: str
    bindings: list = field(default_factory=list)   # py: (bound, canonical)
    calls: list = field(default_factory=list)      # py: (line, at, callee, first_int, first_str)
    selectors: list = field(default_factory=list)  # go: (line, at, pkg, name)
    args: list = field(default_factory=list)       # go: (line, at, pkg, fn, arg_k, byte_slice, inline_make, int_lit)
    findings: list = field(default_factory=list)   # (line, at, rule_id)

    def column(self, line: int, at: str) -> int:
        own = self.text.split("\n")[line - 1]
        assert own.count(at) == 1, (line, at)
        return len(own[:own.index(at)].encode()) + 1


# Inputs of the registered queries, with the rows that follow from them.
PROGRAMS: list[Program] = [
    Program(".py", """try: from hashlib import md5
except ImportError: md5 = None
import os; from hashlib import sha1 as s1; x = s1(b"a")
if os: from Crypto.Cipher import DES, ARC4 as rc
y = md5(b"b"); z = rc.new(k)
class A: from ssl import PROTOCOL_TLSv1 as old
note = '''from hashlib
import md4''' % (md5)
f = lambda q: md5(q)
""", bindings=[("md5", "hashlib.md5"), ("s1", "hashlib.sha1"), ("DES", "Crypto.Cipher.DES"), ("rc", "Crypto.Cipher.ARC4"),
               ("old", "ssl.PROTOCOL_TLSv1")],
        calls=[(3, 's1(b"a")', "s1", None, 'b"a"'), (5, 'md5(b"b")', "md5", None, 'b"b"'), (5, "rc.new", "rc.new", None, None),
               (9, "md5(q)", "md5", None, None)],
        findings=[(3, 's1(b"a")', "weak-hash-sha1"), (5, 'md5(b"b")', "weak-hash-md5"), (9, "md5(q)", "weak-hash-md5")]),
    Program(".py", """import hashlib
from hashlib import md5
a = f"{hashlib.md5(x)} and {md5(y)!r:>10}"
b = f'{f"{hashlib.sha1(z)}"}'
c = F"it's {{md5(no)}} {d['k']} {hashlib.new('md5', q):{w}}"
e = rf\"\"\"md5(no) é
{hashlib.md5(
  r)} tail md5(no)
\"\"\"
g = f"{x:hashlib.md5}" + "hashlib.md5(no)"
h = f"{d["k"]} {md5(u)}"
i = f"{a != md5(v)} {x:{md5(t)}}"
j = f"{(lambda s: hashlib.sha1(s))(1)}" f'\\{md5(p)}'
""", bindings=[("md5", "hashlib.md5")],
        calls=[(3, "hashlib.md5", "hashlib.md5", None, None), (3, "md5(y)", "md5", None, None),
               (4, "hashlib.sha1", "hashlib.sha1", None, None), (5, "hashlib.new", "hashlib.new", None, "'md5'"),
               (7, "hashlib.md5", "hashlib.md5", None, None), (11, "md5(u)", "md5", None, None),
               (12, "md5(v)", "md5", None, None), (12, "md5(t)", "md5", None, None),
               (13, "hashlib.sha1", "hashlib.sha1", None, None), (13, "md5(p)", "md5", None, None)],
        findings=[(3, "hashlib.md5", "weak-hash-md5"), (3, "md5(y)", "weak-hash-md5"), (4, "hashlib.sha1", "weak-hash-sha1"),
                  (5, "hashlib.new", "weak-hash-md5"), (7, "hashlib.md5", "weak-hash-md5"), (11, "md5(u)", "weak-hash-md5"),
                  (12, "md5(v)", "weak-hash-md5"), (12, "md5(t)", "weak-hash-md5"), (13, "hashlib.sha1", "weak-hash-sha1"),
                  (13, "md5(p)", "weak-hash-md5")]),
    Program(".py", """from Crypto.PublicKey import RSA
import ssl, random
k = RSA.generate(1024)
k2 = RSA.generate(bits, 0x400, 512)
t = [ssl.PROTOCOL_SSLv3 for _ in range(3)]
def md5(x): return x
class sha1(Base): pass
print(random.random(), RSA.generate(e=65537))
v = obj.RSA.generate(2048)(1024)
w = (md5)(1)
u = Cipher(algorithms.TripleDES(k), modes.ECB())
n = hashlib.new("MD4"); o = algorithms \\
    .Blowfish(k)
s = x.RSA.generate(
    1024,
)
""", bindings=[("RSA", "Crypto.PublicKey.RSA")],
        calls=[(3, "RSA.generate", "RSA.generate", 1024, None), (4, "RSA.generate", "RSA.generate", 512, None),
               (5, "range(3)", "range", 3, None), (8, "print(", "print", None, None),
               (8, "random.random", "random.random", None, None), (8, "RSA.generate", "RSA.generate", None, None),
               (9, "obj.RSA", "RSA.generate", 2048, None), (11, "Cipher(", "Cipher", None, None),
               (11, "algorithms.Tr", "algorithms.TripleDES", None, None), (11, "modes.ECB", "modes.ECB", None, None),
               (12, "hashlib.new", "hashlib.new", None, '"MD4"'), (12, "algorithms", "algorithms.Blowfish", None, None),
               (14, "x.RSA", "RSA.generate", 1024, None)],
        findings=[(3, "RSA.generate", "weak-key-rsa"), (4, "RSA.generate", "weak-key-rsa"), (5, "ssl.PROT", "deprecated-tls"),
                  (8, "random.random", "insecure-random"), (11, "algorithms.Tr", "weak-cipher-3des"),
                  (11, "modes.ECB", "insecure-mode-ecb"), (12, "hashlib.new", "weak-hash-md4"),
                  (12, "algorithms", "weak-cipher-blowfish"), (14, "x.RSA", "weak-key-rsa")]),
    Program(".go", """package p
import (
	"crypto/aes"
	"crypto/hmac"
	"crypto/sha256"
	"crypto/cipher"
	"crypto/tls"
)
func f(b cipher.Block) {
	aes.NewCipher([]byte("k",))
	aes.NewCipher([]byte("k", ), )
	hmac.New(sha256.New, []byte{1, 2,},)
	cipher.NewCTR(b, make([]byte, 16, ),)
	cipher.NewCTR(b, make([]byte, 16).x)
	_ = tls.Config{MinVersion: tls.VersionTLS10, MaxVersion: a.tls.VersionTLS11}
	aes.NewCipher(g([]byte("k")))
	aes.NewCipher([]byte("a" + "b"))
}
""", selectors=[(9, "cipher.Block", "cipher", "Block"), (10, "aes.", "aes", "NewCipher"), (11, "aes.", "aes", "NewCipher"),
                (12, "hmac.", "hmac", "New"), (12, "sha256.", "sha256", "New"), (13, "cipher.", "cipher", "NewCTR"),
                (14, "cipher.", "cipher", "NewCTR"), (15, "tls.Config", "tls", "Config"),
                (15, "tls.VersionTLS10", "tls", "VersionTLS10"), (15, "a.tls", "a", "tls"),
                (16, "aes.", "aes", "NewCipher"), (17, "aes.", "aes", "NewCipher")],
        args=[(10, "[]byte", "aes", "NewCipher", 0, True, False, None), (11, "[]byte", "aes", "NewCipher", 0, True, False, None),
              (12, "sha256", "hmac", "New", 0, False, False, None), (12, "[]byte", "hmac", "New", 1, True, False, None),
              (13, "b, make", "cipher", "NewCTR", 0, False, False, None), (13, "make", "cipher", "NewCTR", 1, False, True, None),
              (14, "b, make", "cipher", "NewCTR", 0, False, False, None), (14, "make", "cipher", "NewCTR", 1, False, False, None),
              (16, "g(", "aes", "NewCipher", 0, False, False, None), (17, "[]byte", "aes", "NewCipher", 0, False, False, None)],
        findings=[(10, "[]byte", "hardcoded-key"), (11, "[]byte", "hardcoded-key"), (12, "[]byte", "hardcoded-key"),
                  (13, "make", "static-iv"), (15, "tls.VersionTLS10", "deprecated-tls")]),
    Program(".go", """func f() { md5.New() }
import "crypto/md5"
// no package clause: no Go source
"""),
    Program(".go", """package q
import "golang.org/x/crypto/md4"
import bf "golang.org/x/crypto/blowfish"
import "crypto/rc4"
import . "crypto/md5"
import ("crypto/des"; "crypto/rsa"; "crypto/sha1"; "math/rand")
func g() { md4.New(); bf.NewCipher(k); rc4.NewCipher(`k`) }
func h() (int, error) {
	des.NewTripleDESCipher([]byte{1}); des.NewCipher(k)
	rsa.GenerateKey(rand.Reader, 1024); rsa.GenerateMultiPrimeKey(r, 3, 4096)
	sha1.Sum(nil); md5.New()
	s := "sha1.New()" + `des.NewCipher("x")` // sha1.New()
	return rand.Intn(7), nil
}
""", selectors=[(7, "md4.", "md4", "New"), (7, "bf.", "bf", "NewCipher"), (7, "rc4.", "rc4", "NewCipher"),
                (9, "des.NewT", "des", "NewTripleDESCipher"), (9, "des.NewC", "des", "NewCipher"),
                (10, "rsa.GenerateKey", "rsa", "GenerateKey"), (10, "rand.Reader", "rand", "Reader"),
                (10, "rsa.GenerateM", "rsa", "GenerateMultiPrimeKey"), (11, "sha1.", "sha1", "Sum"), (11, "md5.", "md5", "New"),
                (13, "rand.", "rand", "Intn")],
        args=[(7, "k);", "bf", "NewCipher", 0, False, False, None), (7, "`k`", "rc4", "NewCipher", 0, True, False, None),
              (9, "[]byte", "des", "NewTripleDESCipher", 0, True, False, None),
              (9, "k)", "des", "NewCipher", 0, False, False, None),
              (10, "rand.Reader", "rsa", "GenerateKey", 0, False, False, None),
              (10, "1024", "rsa", "GenerateKey", 1, False, False, 1024),
              (10, "r, 3", "rsa", "GenerateMultiPrimeKey", 0, False, False, None),
              (10, "3, 4096", "rsa", "GenerateMultiPrimeKey", 1, False, False, 3),
              (11, "nil", "sha1", "Sum", 0, False, False, None), (13, "7", "rand", "Intn", 0, False, False, 7)],
        findings=[(7, "md4.", "weak-hash-md4"), (7, "bf.", "weak-cipher-blowfish"), (7, "rc4.", "weak-cipher-rc4"),
                  (7, "`k`", "hardcoded-key"), (9, "des.NewT", "weak-cipher-3des"), (9, "[]byte", "hardcoded-key"),
                  (9, "des.NewC", "weak-cipher-des"), (10, "rsa.GenerateKey", "weak-key-rsa"),
                  (10, "rsa.GenerateM", "weak-key-rsa"), (11, "sha1.", "weak-hash-sha1"),
                  (13, "rand.", "insecure-random")]),
]


def prose_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus(path, content, length): one program below the commented text of each document."""
    programs = F.array(*[F.struct(F.lit(p.ext).alias("ext"), F.lit("# " if p.ext == ".py" else "// ").alias("mark"),
                                  F.lit(p.text).alias("text")) for p in PROGRAMS])
    p = F.get(programs, F.pmod("doc_id", F.lit(len(PROGRAMS))).cast("int"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    rows = docs.select(F.concat(F.lit("prose/"), F.col("doc_id").cast("string"), p.ext).alias("path"), F.concat(
        p.mark, F.replace("t", F.lit("\n"), F.concat(F.lit("\n"), p.mark)), F.lit("\n"), p.text).alias("content"))
    return from_rows(rows, F.col("path"), F.col("content"))


def facts_sql(kind: str, columns: list[str]) -> str:
    """The hand-derived rows of one kind over all documents; a row that has a place is moved down with its program."""
    def value(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else sql_str(v)

    rows, placed = [], kind != "bindings"
    for k, p in enumerate(PROGRAMS):
        for row in getattr(p, kind):
            place = (row[0], p.column(row[0], row[1])) if placed else (0, 0)
            rows.append(f"({k}, '{p.ext}', {place[0]}, {place[1]}, {', '.join(map(value, row[2:] if placed else row))})")
    where = "(f.l + 1 + len(d.t) - len(replace(d.t, chr(10), '')))::INTEGER AS line, f.c::INTEGER AS \"{}\", "
    where = where.format("column" if kind == "findings" else "col") if placed else ""
    return (f"SELECT 'prose/' || d.doc_id || f.ext AS {'file' if kind == 'findings' else 'path'}, {where}"
            f"{', '.join('f.' + c.split(' ')[0] for c in columns)} "
            f"FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d JOIN (VALUES {', '.join(rows)}) "
            f"AS f(k, ext, l, c, {', '.join(columns)}) ON ((d.doc_id % {len(PROGRAMS)}) + {len(PROGRAMS)}) % {len(PROGRAMS)} = f.k")
