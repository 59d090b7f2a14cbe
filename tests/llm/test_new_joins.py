"""Token alignment, the Jaccard join and spelling variants against brute force, and their odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from ciphersift.llm import jaccard_join, spelling, token_alignment
from ciphersift.llm.common import tokenizer_file

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
STEMS = "the of and river stone light under morning paper green wooden quiet window market garden letter".split()
CLASHING = ("id", "row", "n", "pairs", "times", "groups", "digest", "first", "shingles", "word", "near", "form", "root",
            "component", "block", "__llm_text")


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(STEMS) + rnd.choice(["", "er", "ing", "ly", "s", "ness"]) for _ in range(n))


ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, prose(4, 60)), (4, prose(4, 60)), (None, prose(5, 40)), (None, None),
    (7, prose(7, 20_000)), (8, "Ünïcode  ﬁ 日本 👍 <|endoftext|> </s> x" + "y" * 3000), (9, prose(4, 60).upper()), (10, "a"),
    (11, "\x00 ▁ tab\tand  two spaces "), (12, "one two three four"), (13, "ONE two\nthree\x0bfour"), (14, "y" * 30_000),
    (15, "Wörterbuch wörterbuch ÀÉÿ×÷ß"), (16, "y" * 30_000 + "z"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    df = frame(spark, ODD)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


# --- 11 --------------------------------------------------------------------------------------------------------

def aligned_by_hand(rows):
    a = tokenizers.Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    symbols = {c: bytes([k]) for k, c in token_alignment.byte_symbols().items()}
    docs = []
    for i, t in rows:
        line, spans = (" " + t).encode() if t else b"", []
        for ids, of in ((a.encode(" " + t, add_special_tokens=False).ids, lambda x: b"".join(symbols[c] for c in a.id_to_token(x))),
                        (b.encode(t), lambda x: (bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x)
                                                 else b.id_to_piece(x).replace("▁", " ").encode()))) if t else ():
            at, own = 0, []
            for x in ids:
                own.append((x, at, at + len(of(x))))
                at += len(of(x))
            spans.append(own if b"".join(of(x) for x in ids) == line else None)
        docs.append((i, spans if spans and None not in spans else [[], []]))
    held, out = Counter(), []
    for _, (xs, ys) in docs:
        held.update({(x, y) for x, s, e in xs for y, u, v in ys if max(s, u) < min(e, v)})
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    for i, (xs, ys) in docs:
        links = [(x, y) for x, s, e in xs for y, u, v in ys if max(s, u) < min(e, v)]
        cuts = sorted({e for _, _, e in xs} & {e for _, _, e in ys})
        groups = [[",".join(str(x) for x, _, e in side if (low < e <= cut)) for side in (xs, ys)]
                  for low, cut in zip([0, *cuts], cuts)]
        text = ";".join("|".join(g) for g in groups)
        out.append((i, len(xs), len(ys), len(cuts), len(links), sum(held[p] == most[p[0]] for p in links),
                    sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


ALIGN_ROWS = [(k, prose(k, 12) + t) for k, t in enumerate([
    "", " Zażółć gęślą jaźń", " 日本語のテキスト", " internationalisation's", "\n\n  x", " 👍👍 12345", " <|endoftext|>", " </s>"])] + \
    [r for r in ODD if r[0] not in (7, 14, 16)] + [(20, "x" * 700)]


@pytest.mark.parametrize("frequent", [token_alignment.FREQUENT, 60, 0])
def test_alignment_brute_force(spark, frequent):
    names = [tokenizer_file(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    digest = F.when(F.col("groups") == "", F.col("groups")).otherwise(F.sha2("groups", 256))
    got = token_alignment.alignment_counts(frame(spark, ALIGN_ROWS), *names, frequent=frequent, groups=digest)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, got.collect()), key=str) == aligned_by_hand(ALIGN_ROWS)


def test_alignment_odd_rows(odd):
    names = [tokenizer_file(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    rows = token_alignment.alignment_counts(odd, *names).collect()
    assert len(rows) == len(ODD)
    assert {tuple(r)[1:] for r in rows if r.doc_id in (1, 2)} == {(0, 0, 0, 0, 0, 0, "")}
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in rows)
    assert token_alignment.alignment_counts(odd.limit(0), *names).count() == 0


def test_alignment_with_a_small_memory(monkeypatch):
    """What is forgotten between slices changes nothing, and neither does a text that a tokenizer does not give back."""
    models = [open(tokenizer_file(x), "rb").read() for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    lines = [t or "" for _, t in ALIGN_ROWS] + ["a ▁ b " + prose(2, 9)]
    whole = token_alignment.Aligner(*models)
    whole.tok.parted = False
    want = whole.aligned(lines)
    monkeypatch.setattr(token_alignment, "CACHED_CHARS", 60)
    monkeypatch.setattr(token_alignment, "PARTS_IN_A_LINE", 3)
    small = token_alignment.Aligner(*models)
    for _ in range(3):
        got = small.aligned(lines)
        assert got[0][4] == want[0][4]
        for a, b in zip([*got[0][:4], *got[1]], [*want[0][:4], *want[1]]):
            assert np.array_equal(a, b)
        small.aligned([prose(5, 40)])


def test_divide_finds_every_common_end():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        total = int(rnd.integers(1, 60))
        a, b = (np.unique(np.r_[rnd.integers(1, total + 1, rnd.integers(1, 40)), total]) for _ in range(2))
        got = token_alignment.divide(a, b, np.array([[0, len(a), 0, len(b)]]))
        assert a[got[:, 1] - 1].tolist() == sorted(set(a) & set(b)) == b[got[:, 3] - 1].tolist()
        assert got[1:, 0].tolist() == got[:-1, 1].tolist() and got[1:, 2].tolist() == got[:-1, 3].tolist()


# --- 12 --------------------------------------------------------------------------------------------------------

def sets_of(rows):
    out = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").encode().lower().decode())
        out.append({" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def components_by_hand(rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def copies(seed):
    """Chains of edited copies, exact copies, a passage that many share, short texts, and texts of shared lines only."""
    rnd, rows = random.Random(seed), []
    passage, lines = prose(seed + 1, 40), [prose(seed + 50 + k, 9) for k in range(12)]

    def add(text):
        rows.append((len(rows) * 7 % 1009, text))

    for _ in range(25):
        words = prose(rnd.random(), rnd.randint(5, 120)).split()
        for _ in range(rnd.choice([1, 2, 2, 9])):
            add(" ".join(words))
            words = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 40))):
                words[rnd.randrange(len(words))] = f"w{rnd.random()}"
    for _ in range(40):
        add(prose(rnd.random(), rnd.randint(0, 80)) + " " + passage)
        add(" ".join(rnd.sample(lines, 6)))
    base = prose(seed + 2, 90).split()
    for _ in range(60):  # a large group of near copies
        own = list(base)
        own[rnd.randrange(90)] = f"v{rnd.random()}"
        add(" ".join(own))
    return rows


@pytest.mark.parametrize("seed,block,long", [(1, jaccard_join.BLOCK, jaccard_join.LONG), (2, jaccard_join.BLOCK, 3), (3, 300, 2),
                                             (4, 90, jaccard_join.LONG)])
def test_jaccard_brute_force(spark, seed, block, long):
    rows = copies(seed) + [r for r in ODD if r[0] not in (7, 14, 16)]
    got = jaccard_join.jaccard_components(frame(spark, rows).repartition(7), block=block, long=long)
    assert sorted(map(tuple, got.collect()), key=str) == components_by_hand(rows)


def test_jaccard_at_the_border(spark):
    """Exactly 80 of 100, and one less."""
    shared = [f"a{k}" for k in range(44)]                 # 40 shingles and what follows
    at = [(1, " ".join(shared)), (2, " ".join([*shared, *(f"b{k}" for k in range(10))])),
          (3, " ".join([f"c{k}" for k in range(44)])), (4, " ".join([*(f"c{k}" for k in range(44)), *(f"d{k}" for k in range(11))]))]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, at)).collect()}
    assert Fraction(40, 50) == Fraction(80, 100) and got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_divide_skip_search():
    rnd = np.random.default_rng(2)
    sets = [np.unique(np.r_[rnd.integers(0, 400, rnd.integers(0, 40)), np.arange(1000, 1000 + rnd.integers(1, 30))]) for _ in range(120)]
    lists = jaccard_join.Lists(sets)
    for query in sets:
        want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, query)) >= 80 * len(np.union1d(s, query))]
        assert lists.linked(query).tolist() == want


def test_shared_lists_in_pieces():
    """Lists over several batches, longer than what is held."""
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    shingle = np.sort(rnd.choice([1, 2, 3, 3, 3, 4, 9], 400))
    shingle = np.r_[0, shingle, 11]
    row = np.arange(len(shingle))
    batch = pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(row)], ["shingle", "row"])
    for step in (1, 7, 1000):
        for long in (1, 50, 10_000):
            got = [t for b in jaccard_join._shared_lists(long)(batch.slice(k, step) for k in range(0, len(row), step))
                   for t in zip(*(c.to_pylist() for c in b.columns))]
            assert got == [(r, min(long + 1, int((shingle == s).sum())), s, int(row[shingle == s][0]))
                           for s, r in zip(shingle.tolist(), row.tolist()) if (shingle == s).sum() > 1]


def test_jaccard_pairs_are_packed(monkeypatch):
    """What meets is sent in 7 bytes a pair, and comes back as keys that are equal for equal shingles."""
    rnd = np.random.default_rng(4)
    rows = np.r_[np.arange(65_530, 65_560), np.arange(3) + (5 << 33), 7, 7 + (1 << 33)]
    sets = [rnd.integers(-2**63, 2**63, k % 9) if k % 3 else np.arange(k % 5) - 2 for k in range(len(rows))]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], ["row", "shingles"])
    packed = list(jaccard_join._packed([batch.slice(0, 0), batch.slice(0, 20), batch.slice(20)]))
    pairs = sorted((int(x), int(r)) for r, s in zip(rows, sets) for x in s)
    assert sum(len(v) for b in packed for k in (2, 3) for v in b.column(k).to_pylist()) == 7 * len(pairs)
    for at_once in (1, jaccard_join.UNPACKED):
        monkeypatch.setattr(jaccard_join, "UNPACKED", at_once)
        got = [t for b in jaccard_join._unpacked(iter([b.slice(k, 3) for b in packed for k in range(0, len(b), 3)]))
               for t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        key_of = lambda x: (x * 0x9E3779B97F4A7C15 % 2**64) >> 12
        assert sorted(got) == sorted((key_of(x), r) for x, r in pairs)


def test_jaccard_sets_leave_the_disk(spark):
    """The folder of all sets is deleted once those that are searched have been copied; rows read nothing of it."""
    from pathlib import Path
    from ciphersift.session import ensure_checkpoint_dir

    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("jaccard-sets-*"))
    rows = [(k, f"a b c d e f g {k // 2} h i j k l m n o p q r s t u v w x y z") for k in range(8)]
    found = jaccard_join.jaccard_components(frame(spark, rows))
    assert set(folder.glob("jaccard-sets-*")) == before
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(k, k // 2 * 2) for k in range(8)]


def test_jaccard_odd_rows(odd):
    got = sorted(map(tuple, jaccard_join.jaccard_components(odd).collect()), key=str)
    assert got == components_by_hand(ODD)
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0


# --- 13 --------------------------------------------------------------------------------------------------------

def variants_by_hand(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in form.items() if words[v] >= 10 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(around[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


def spelled(seed):
    rnd, rows = random.Random(seed), []
    stems = ["wooden" + x for x in ("ness", "ly", "s")] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "çàéîöûÿ", "ÇÀÉÎÖÛŸ×"]
    for k in range(150):
        line = []
        for _ in range(40):
            w = rnd.choice(stems)
            if rnd.random() < 0.08:
                at = rnd.randrange(len(w))
                w = w[:at] + rnd.choice(["", "x", "b", w[at] + "e"]) + w[at + 1:]
            line.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((k, rnd.choice([" ", ", ", "1", "_"]).join(line)))
    chain = {"aleading": 1200, "bleading": 110, "bleedings": 2, "bleeding": 11, "cleeding": 1}
    rows += [(1000 + k, " ".join([w] * n)) for k, (w, n) in enumerate(chain.items())]
    return rows + [(None, None), (None, "wooDenly woodenly"), (3, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_brute_force(spark, seed):
    rows = spelled(seed)
    got = spelling.spelling_variants(frame(spark, rows).repartition(5))
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted(map(tuple, got.collect())) == variants_by_hand(rows)


def test_spelling_odd_rows(odd):
    doubled = odd.union(odd)
    got = sorted(map(tuple, spelling.spelling_variants(doubled).collect()))
    assert got == variants_by_hand(ODD + ODD)
    assert spelling.spelling_variants(odd.limit(0)).count() == 0


def test_spelling_words_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED_AT_ONCE", 3)
    monkeypatch.setattr(spelling, "NODES_AT_ONCE", 50)
    rows = spelled(3)
    assert sorted(map(tuple, spelling.spelling_variants(frame(spark, rows)).collect())) == variants_by_hand(rows)
