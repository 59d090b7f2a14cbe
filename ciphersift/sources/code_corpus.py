"""A code corpus derived from the ``part`` table.

The test tables hold prose, not source code, so the syntax tiers, routing
and path rules need a corpus that exercises them and still grows with the
scale factor.  Every ``part`` row becomes one file: ``p_partkey % 20`` picks a
template below and the key is substituted into its path and text.  The same
derivation is expressed in SQL (:func:`corpus_sql`) so the oracle rebuilds
the identical corpus independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import from_rows, read_table

# Inputs of the registered queries: file templates (path, text); "{k}" is replaced by p_partkey.
TEMPLATES: list[tuple[str, str]] = [
    ("src/svc{k}/a.go", 'package a\nimport "crypto/md5"\nvar _ = md5.New()\n'),
    ("src/svc{k}/b.rb", "require 'digest'\nDigest::MD5.hexdigest('x{k}')\n"),
    ("vendor/lib{k}/skip.go", 'package v\nimport "crypto/md5"\nvar _ = md5.New()\n'),
    ("docs/notes{k}.txt", "uses md5 somewhere\nand sha-256 elsewhere for item {k}\n"),
    ("src/svc{k}/sup.go", 'package a\nimport ("crypto/md5"; "crypto/sha1")\nvar _ = md5.New()\n'
                          'var _ = sha1.New() // ciphersift:ignore weak-hash-sha1\n'),
    ("skip/x{k}.go", 'package s\nimport "crypto/md5"\nvar _ = md5.New()\n'),
    ("src/svc{k}/xor.txt", "call xor_encrypt(data{k}) here\nXOR_ENCRYPT is case sensitive\n"),
    ("src/svc{k}/main.go",
     'package billing\n\nimport (\n\t"crypto/des"\n\tsum "crypto/md5"\n\t"crypto/rand"\n\t"crypto/rsa"\n\t"crypto/tls"\n'
     '\tdice "math/rand"\n)\n\nvar versions = []uint16{tls.VersionTLS13, tls.VersionTLS11}\n\n'
     'func Sign{k}(secret []byte) (int, error) {\n\tdigest := sum.Sum(secret)\n\tif _, err := des.NewCipher(secret); err != nil {\n'
     '\t\treturn dice.Intn({k} + 1), err\n\t}\n\tblock, _ := des.NewTripleDESCipher(secret)\n'
     '\tshort, _ := rsa.GenerateKey(rand.Reader, 512)\n\tfine, _ := rsa.GenerateKey(rand.Reader, 3072)\n'
     '\treturn use(digest, block, short, fine), nil\n}\n'),
    ("src/svc{k}/keys.go",
     'package vault\n\nimport "crypto/aes"\nimport mac "crypto/hmac"\nimport "crypto/sha512"\n\n'
     'func open(given []byte, n string) {\n\tone, _ := aes.NewCipher([]byte("item-{k}-item-{k}"))\n'
     '\ttwo, _ := aes.NewCipher([]byte{0x10, 0x20, byte({k} % 7)})\n\tthree, _ := aes.NewCipher(given)\n'
     '\tfour, _ := aes.NewCipher([]byte(n + "tail"))\n\tuse(one, two, three, four, mac.New(sha512.New, []byte("stamp")))\n}\n'),
    ("src/svc{k}/iv.go",
     'package vault\n\nimport modes "crypto/cipher"\n\nfunc seal(b modes.Block, fresh []byte) {\n'
     '\tuse(modes.NewCFBEncrypter(b, fresh))\n\tuse(modes.NewCTR(b, `counter-{k}`))\n'
     '\tuse(modes.NewCBCDecrypter(b, make([]byte, 16)))\n\tuse(modes.NewOFB(b, []byte("sixteen bytes ..")))\n}\n'),
    ("src/svc{k}/crypto.py",
     'import ssl, random, hashlib\nfrom Crypto.PublicKey import RSA\nfrom Crypto.Cipher import DES3 as Triple\n'
     'from hashlib import sha1 as fold\n\n\ndef build{k}(data, key):\n    box = Triple.new(key)\n'
     '    mark = fold(data) + hashlib.md5(data).digest()\n    named = hashlib.new("sha1", data)\n'
     '    small, fine = RSA.generate(768), RSA.generate(3072)\n    return random.choice([box, mark, named, small, fine])\n\n\n'
     'context = ssl.SSLContext(ssl.PROTOCOL_TLSv1_1)\nsafe = hashlib.sha384(b"{k}")\n'),
    ("bin/tool{k}", "#!/usr/bin/env python3\nimport hashlib\nh = hashlib.md5(b'{k}')\n"),
    ("web/app{k}.min.js", "var h=md5(x{k});var r=Math.random();\n"),
    ("src/svc{k}/win.c", "#include <openssl/des.h>\r\nDES_ecb_encrypt(in, out, ks, DES_ENCRYPT); /* des */\r\n"
                         "use sha1 here {k}\r\n"),
    ("src/svc{k}/intl.java", "// émd5 and \U0001F600 md5 and md5_x and TLSv1.2 des-ede\n"
                             "String s = \"ſsl3 and ssl3 and Keccak {k}\";\n\tMD5 \n"),
    ("build/out{k}.go", 'package o\nimport "crypto/md5"\nvar _ = md5.New()\n'),
    ("src/svc{k}/edge.py",
     "import random\nimport hashlib\nfrom Crypto.Cipher import DES, ARC4 as stream\n"
     "from cryptography.hazmat.primitives import hashes\n"
     "v = random(1).random\nw = x[0].DES.new(k)\nz = DES[0].new(k)\nh = hashlib.new('SHA')\n"
     "r = RSA.generate(0x400, 1024)\nq = random.choice(a)  # ciphersift:ignore\nrandom.randint(1, {k})\n"
     "s = stream(key)\nd = hashes.MD5()\ns2 = 'hashlib.md5(x)'\n"
     "from hashlib \\\n    import sha1 as s1\nh1 = s1(b'{k}')\nr2 = x.random()(1).random\n"),
    ("src/svc{k}/edge.go",
     'package e\n\nimport (\n\t"crypto/rsa"\n\t"math/rand/v2"\n\tmr "math/rand"\n\t"crypto/sha1"\n)\n\n'
     'func f(r io.Reader) {\n\trsa.GenerateKey(r, 0x400)\n\trand.IntN(3)\n'
     '\ts := "md5.New() in a string {k}"\n\t// ciphersift:ignore\n\tmr.Intn(5)\n'
     '\tsha1.Sum(nil) // ciphersift:ignore because legacy\n\t/* des.NewCipher(k) in a comment */\n'
     '\tx.aes.NewCipher(k)\n\tsha1.\n\t\tSum(nil)\n}\n'),
    (".git/hooks{k}.py", "import hashlib\nhashlib.md5()\n"),
    ("src/svc{k}/Makefile", "#!/usr/bin/make -f\nhash:\n\tmd5sum file{k}\n"),
]

N_TEMPLATES = len(TEMPLATES)


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus(path, content, length) with one file per ``part`` row.

    The 20-row template table is a literal array indexed by key, so the
    derivation is a projection of ``part`` (no join)."""
    part = read_table(spark, sf_dir, "part").select("p_partkey")
    arr = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for p, c in TEMPLATES])
    t = F.element_at(arr, (F.col("p_partkey") % N_TEMPLATES + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    rows = part.select(F.replace(t.p, F.lit("{k}"), key).alias("path"),
                       F.replace(t.c, F.lit("{k}"), key).alias("content"))
    return from_rows(rows, F.col("path"), F.col("content"))


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def corpus_sql() -> str:
    """The same derivation for DuckDB: a CTE body producing (path, content)."""
    vals = ", ".join(f"({i}, {sql_str(p)}, {sql_str(c)})" for i, (p, c) in enumerate(TEMPLATES))
    return (f"SELECT replace(t.p, '{{k}}', CAST(part.p_partkey AS VARCHAR)) AS path, "
            f"replace(t.c, '{{k}}', CAST(part.p_partkey AS VARCHAR)) AS content "
            f"FROM part JOIN (VALUES {vals}) AS t(id, p, c) ON part.p_partkey % {N_TEMPLATES} = t.id")
