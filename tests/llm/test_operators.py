"""The ten operators on small tables: odd rows, brute force, round trips."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ciphersift.llm import (attention_lm, chat_format, cotrain, decontam, html_extract, segmentation, simhash, token_counts,
                            topk, toxicity)
from ciphersift.llm.common import tokenizer_file, with_inputs

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and river stone light under morning paper green wooden quiet window market".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "er", "ing", "ly"]) for _ in range(n))


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "en", "s", 5), (4, prose(4, 60), "en", "s", 400),
    (4, prose(4, 60), "en", "s", 400), (None, prose(5, 40), "en", None, 300), (None, None, None, "s", None),
    (7, prose(7, 20_000), "en", "s", 120_000), (8, "Ünïcode  ﬁ 日本 👍 <|endoftext|> x" + "y" * 3000, "xx", "s", -1),
    (9, prose(4, 60).upper(), "en", "s", 400), (10, "a", "en", "s", 1),
]
CLASHING = ("n", "t", "h", "o", "y", "x", "id", "key", "word", "score", "fp", "grp", "component", "row", "sample", "ids")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1), (99, 0, 1)],
                                 "doc_id bigint, quality int, toxic int")


# --- 1 ---------------------------------------------------------------------------------------------------------

def paths(pieces, text):
    """All segmentations of a text with their log probabilities."""
    names = {pieces.library.id_to_piece(i): i for i in range(pieces.size)
             if not (pieces.library.is_byte(i) or pieces.library.is_control(i) or pieces.library.is_unknown(i))}
    line, out = pieces.library.normalize(text), []

    def go(i, ids, lp):
        if i == len(line):
            out.append((tuple(ids), lp))
            return
        for j in range(i + 1, min(len(line), i + pieces.longest) + 1):
            if line[i:j] in names:
                go(j, [*ids, names[line[i:j]]], lp + pieces.log_p[names[line[i:j]]])
        if line[i] not in names:
            raw = line[i].encode()
            go(i + 1, [*ids, *(int(pieces.byte_id[c]) for c in raw)], lp + pieces.byte_log_p * len(raw))

    go(0, [], 0.0)
    total = np.logaddexp.reduce([p for _, p in out])
    return {a: p - total for a, p in out}


def test_segmentation_distribution():
    sampler = segmentation.Sampler(open(tokenizer_file("piece_bpe_32k.model"), "rb").read())
    n = 6000
    for text in ("the cat", "hé\n1"):
        p = paths(sampler.pieces, text)
        drawn = sampler.sample([text] * n, segmentation.mix(np.arange(n).astype(np.uint64)), 3)
        first = Counter(tuple(d[0][0].tolist()) for d in drawn)
        assert max(abs(first[a] / n - math.exp(lp)) for a, lp in p.items()) < 0.02
        for d in drawn:
            own = [tuple(x[0].tolist()) for x in d]
            assert len(set(own)) == len(own) == min(3, len(p))            # without replacement
            assert [x[2] for x in d] == sorted((x[2] for x in d), reverse=True)
            assert all(abs(x[1] - p[tuple(x[0].tolist())]) < 1e-4 for x in d)
        # inclusion scores are unbiased: the weighted sum over what was drawn estimates one
        assert abs(np.mean([sum(math.exp(x[1] - x[3]) for x in d) for d in drawn]) - 1) < 0.02


def test_rows_that_are_kept_send_their_text_once(spark):
    """The pipeline's filters pass whole rows through tasks; the text among them is the operator's input too."""
    docs = spark.createDataFrame([(i, f"some text of row {i}", "web", "en", 10 + i) for i in range(4)],
                                 "doc_id bigint, text string, source string, lang string, n_chars bigint")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some other text that is nowhere in the rows of this small table at all")],
                                  "item_id bigint, text string")
    quality = cotrain.score_quality(docs, cotrain.Model(np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0)), *docs.columns)
    assert quality.count() == 4
    for frame, name in ((quality, "quality"), (with_inputs(docs, docs.columns, text="string")[0], "toxicity"),
                        (decontam.keep_clean(docs, bench), "decontam")):
        plan = frame._jdf.queryExecution().analyzed().toString()
        assert "__llm_text" not in plan, name
    cast, names = with_inputs(docs, ["doc_id"], text="string", n_chars="string")
    assert names == ["__llm_text", "__llm_n_chars"] and cast.columns == ["doc_id", *names]


def test_segmentation_cache_is_filled_in_place():
    """An emptied cache keeps its arrays, and its words have the same lattices again, with prefixes found without a search."""
    pieces = segmentation.Pieces(open(tokenizer_file("piece_bpe_32k.model"), "rb").read())
    assert (pieces.find(pieces.hashes) == np.arange(len(pieces.hashes))).all()
    assert (pieces.find(pieces.hashes + np.uint64(1 << 40)) < 0).sum() > 0.9 * len(pieces.hashes)
    lattices = segmentation.Lattices(pieces)
    rng = np.random.default_rng(1)
    words = ["▁" + "".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (2_000, 30))]
    lattices.need(words)
    kept = {name: getattr(lattices, name) for name in lattices.KINDS}
    before = {name: x[:lattices.n_edges].copy() for name, x in kept.items()}
    lattices.clear()
    assert (lattices.need(words + words)[:2_000] == lattices.need(words)).all()
    for name, x in kept.items():
        assert getattr(lattices, name) is x
        assert np.array_equal(x[:lattices.n_edges], before[name])


def test_segmentation_draws_bounds_of_a_batch_together(monkeypatch):
    """The open nodes of all texts of a batch get their bounds in one call, the same as alone."""
    sampler = segmentation.Sampler(open(tokenizer_file("piece_bpe_32k.model"), "rb").read())
    rows, seeds = [f"some words of text {i}, Ünlike \x01 others" for i in range(40)], segmentation.mix(np.arange(40).astype(np.uint64))
    alone = [sampler.sample([x], seeds[i:i + 1], 3)[0] for i, x in enumerate(rows)]
    sizes, cut_off = [], segmentation.cut_off
    monkeypatch.setattr(segmentation, "cut_off", lambda where, *rest: sizes.append(len(where)) or cut_off(where, *rest))
    sampler.sample(rows, seeds, 1)
    assert len(sizes) == 1 and sizes[0] > 40
    for one, many in zip(alone, sampler.sample(rows, seeds, 3)):
        assert [(x[0].tolist(), *x[1:]) for x in one] == [(x[0].tolist(), *x[1:]) for x in many]


def test_segmentation_forgets_words_whose_building_failed(monkeypatch):
    pieces = segmentation.Pieces(open(tokenizer_file("piece_bpe_32k.model"), "rb").read())
    words = ["▁some", "▁new", "▁words", "▁ü\0"]
    want, broken = segmentation.Lattices(pieces), segmentation.Lattices(pieces)
    with monkeypatch.context() as m:
        m.setattr(broken, "put", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            broken.need(words)
    assert (broken.need(words) == want.need(words)).all()
    for name in broken.KINDS:
        assert np.array_equal(getattr(broken, name)[:broken.n_edges], getattr(want, name)[:want.n_edges])
    assert broken.n_edges == want.n_edges > 0


def test_segmentation_odd_rows(odd):
    path = tokenizer_file("piece_bpe_32k.model")
    rows = segmentation.sample_segmentations(odd, path).collect()
    assert all(r.round_trip for r in rows)
    empty = [r for r in rows if r.doc_id == 2]
    assert len(empty) == 1 and empty[0].ids == [] and empty[0].log_prob == 0 and empty[0].log_inclusion == 0
    same = [(r.sample, tuple(r.ids)) for r in rows if r.doc_id == 4]
    assert len(same) == 4 and len(set(same)) == 2                         # repeated rows draw the same
    moved = segmentation.sample_segmentations(odd.repartition(5), path).collect()
    key = lambda r: (r.doc_id or -1, r.sample, tuple(r.ids))
    assert sorted(map(key, rows)) == sorted(map(key, moved))
    decoded = segmentation.decode_pieces(segmentation.sample_segmentations(odd, path).select("doc_id", "ids"), path)
    texts = {(r[0], r[1] or "") for r in ODD}
    assert all((r.doc_id, r.decoded) in texts for r in decoded.collect())
    assert segmentation.sample_segmentations(odd.limit(0), path).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------

def words_within(item, text, most):
    """Least edit distance of an item to any stretch of a text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row) <= most


def test_decontamination_brute_force(spark):
    rnd = random.Random(3)
    names = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(names, k=rnd.randint(12, 40)))) for i in range(30)] + [(40, None), (41, ""), (42, "w1 w2")]
    docs = []
    for i in range(120):
        body = rnd.choices(names, k=80)
        if i % 2:
            planted = items[rnd.randrange(30)][1].split()
            for _ in range(rnd.randint(0, int(0.15 * len(planted)))):
                planted[rnd.randrange(len(planted))] = "zzz"
            body[30:30] = [w.upper() + rnd.choice(["", ",", "."]) for w in planted]
        docs.append((i, " ".join(body)))
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    want = {(d, i) for d, t in docs for i, x in items if x
            and words_within(x.split(), [w.decode() for w in decontam.words_of(t)], int(0.2 * len(x.split()) + 1e-9))}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) >= 60


def test_decontamination_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, prose(4, 60)[20:300]), (1, prose(4, 60)[20:300]), (None, prose(7, 30)), (3, None)],
                                  "item_id bigint, text string")
    rows = decontam.find_leaks(odd, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows if r.item_id) == [(4, 1), (4, 1), (9, 1)]
    assert {r.doc_id for r in rows if r.item_id is None} == {7}
    clean = decontam.keep_clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 4
    assert decontam.find_leaks(odd.limit(0), bench).count() == 0 == decontam.find_leaks(odd, bench.limit(0)).count()
    assert decontam.keep_clean(odd, bench.limit(0)).count() == odd.count()


def test_decontamination_recall_of_edited_copies():
    rnd = random.Random(8)
    names = [f"w{i}" for i in range(2000)]
    index = decontam.Index([(i, " ".join(rnd.choices(names, k=rnd.randint(14, 59)))) for i in range(100)]).open()
    rng, back = np.random.default_rng(1), {k: w.decode() for w, k in index.vocabulary.items()}
    texts = []
    for x in index.items:
        y = decontam.edited(x, decontam.most_edits(len(x)), rng)
        texts.append(" ".join([*rnd.choices(names, k=50), *(back.get(int(s), "zzq") for s in y), *rnd.choices(names, k=50)]))
    found = index.leaks(texts)
    assert np.mean([any(f[0] == i for f in x) for i, x in enumerate(found)]) >= 0.9


@pytest.mark.parametrize("n", [100, 101, 400, 800])
def test_decontamination_recall_of_long_items(n):
    rnd = random.Random(n)
    names = [f"w{i}" for i in range(2000)]
    index = decontam.Index([(i, " ".join(rnd.choices(names, k=n))) for i in range(60)]).open()
    rng, back = np.random.default_rng(2), {k: w.decode() for w, k in index.vocabulary.items()}
    texts = []
    for x in index.items:
        y = decontam.edited(x, decontam.most_edits(n), rng)
        texts.append(" ".join([*rnd.choices(names, k=50), *(back.get(int(s), "zzq") for s in y), *rnd.choices(names, k=50)]))
    found = index.leaks(texts)
    assert np.mean([any(f[0] == i and f[3] <= 0.2 * n for f in x) for i, x in enumerate(found)]) >= 0.9
    half = [" ".join(back[int(s)] for s in x[:n // 2]) for x in index.items]  # a found piece alone is no leak
    assert not any(index.leaks(half))


# --- 3 ---------------------------------------------------------------------------------------------------------

PAGE = ("<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/a'>Home</a></li><li><a>News</a></li></ul></nav><!-- c --><div class='ad'>Buy now this</div>"
        "<article><h1>Head &amp; line</h1><p><b>%s<br><p>Second\n  part &lt;here&gt;.</p><aside>side words</aside>"
        "<div class='comments'><p>I disagree with all of this</p></div></article><footer>&copy; me</footer></body></html>")


def test_html_main_text(spark):
    body = prose(1, 80)
    want = f"Head & line\n\n{body}\n\nSecond part <here>."
    rows = [(i, f"u{i}", PAGE % body) for i in range(20)] + [(50, None, None), (None, "u", ""), (51, "u", "<p"), (0, "u0", PAGE % body)]
    rows.append((52, "u", (PAGE % body).replace("<article>", "<div id='content'>").replace("</article>", "</div>")))
    rows.append((53, "u", PAGE % prose(2, 60_000)))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("h", F.lit(1))
    got = html_extract.extract_pages(df).collect()
    assert [r.text for r in got if r.page_id is not None and (r.page_id < 50 or r.page_id == 52)] == [want] * 22
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (50, 51, None))
    assert all(r.n_chars == len(r.text) for r in got) and max(r.n_chars for r in got) > 200_000
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_attributes_and_ids_inside_an_article():
    kept = ['<a href="/hidden-gems">%s</a>', '<p title="the hidden truth">%s</p>', '<section data-state="not-hidden">%s</section>',
            '<a href="?id=comments">%s</a>', "<p data-x='class=ad id=nav hidden'>%s</p>", '<h2 id="related-work">%s</h2>',
            '<h2 id="search-methods">%s</h2>', '<section id="legal-history"><p>%s</p></section>', '<p class="a" class="ad">%s</p>',
            '<a href=/hidden/id=nav>%s</a>', '<p data-hidden aria-hidden=false>%s</p>']
    left = ['<p hidden>%s</p>', '<p HIDDEN>%s</p>', '<p title="a" hidden="">%s</p>', "<p aria-hidden='true'>%s</p>",
            '<p style="color: red; display : none">%s</p>', '<div class="related">%s</div>', '<div role=navigation>%s</div>',
            '<nav>%s</nav>', '<DIV CLASS="ad">%s</DIV>']
    weights = html_extract.weights_of({})
    for frame in ("<body><p>%s</p><article>%s</article></body>", "<body><p>%s</p><main>%s</main></body>"):
        for form in kept:
            got = html_extract.main_text(frame % ("", f"<p>{prose(1, 40)}</p>" + form % "inner words"), weights)
            assert "inner words" in got, form
        for form in left:
            got = html_extract.main_text(frame % ("", f"<p>{prose(1, 40)}</p>" + form % "inner words"), weights)
            assert got == prose(1, 40), form
    page = f'<body><div id="sidebar">side words</div><div id="content"><p>{prose(2, 40)}</p><h2 id="related-work">Head</h2><p>{prose(1, 40)}</p></div></body>'
    assert html_extract.main_text(page, weights) == f"{prose(2, 40)}\n\nHead\n\n{prose(1, 40)}"


def test_html_names_are_decided_by_their_last_word():
    kept = ["share-price", "legal-history", "ad-hoc", "hidden-gems", "entry-header", "has-sidebar", "post-content", "tag-social",
            "comments-open", "category-legal news", "article-title"]
    left = ["post-comments", "entry-footer", "content-sidebar", "article-ad", "main-nav", "footer-content", "comment-body",
            "commentList", "ad-container-3", "related-posts", "nav-bar", "story comments"]
    weights = html_extract.weights_of({})
    for frame in ("<body><article>%s</article></body>", "<body><div class=content>%s</div></body>", "<body><main>%s</main></body>"):
        for name in kept + left:
            for form in (f'<div class="{name}">inner words</div>', f"<section class='{name}'><p>inner words</section>"):
                got = html_extract.main_text(frame % (f"<p>{prose(1, 40)}</p>{form}<p>{prose(2, 40)}</p>"), weights)
                between = "inner words\n\n" if name in kept else ""
                assert got == f"{prose(1, 40)}\n\n{between}{prose(2, 40)}", (frame, form)
    comment = '<article class="comment comment-%d"><p>I disagree</p></article>'
    for page in (f"<article><p>{prose(1, 40)}</p>{comment % 1}{comment % 2}</article>",
                 f"<main><article class='post type-post category-legal'><p>{prose(1, 40)}</p></article>{comment % 1}</main>",
                 f"<article><p>{prose(1, 40)}</p></article>" + "".join(comment % i for i in range(9)),
                 f"<article><p>{prose(1, 40)}</p><div id=comments><p>I disagree</p></div></article>"):
        assert html_extract.main_text(page, weights) == prose(1, 40), page


def test_html_labels_outvote_the_word_list():
    """A name of the list that encloses the content of the labelled pages drops nothing around content."""
    page = '<body><div class="%s"><%s><p>' + prose(1, 60) + "</p></%s></div><p>other</p></body>"
    counts = html_extract.count_labels([page % ("social", "article", "article")] * 5)
    learnt, bare = html_extract.weights_of(counts), html_extract.weights_of({})
    assert prose(1, 60) in html_extract.main_text(page % ("social", "div", "div"), learnt)
    assert prose(1, 60) not in html_extract.main_text(page % ("social", "div", "div"), bare)
    assert prose(1, 60) not in html_extract.main_text(page % ("promo", "div", "div"), learnt)


def test_html_tags_are_cut_as_browsers_cut_them():
    weights = html_extract.weights_of({})
    for form in ("<p title=it's>%s", "<p title=a\"b>%s", "<!-->%s", "<!--->%s", "<!-- a --!>%s", "<p data-a = 'x > y' b>%s", "</>%s",
                 "<p =\"a>%s", "<p a=>%s", "<p/title='>'>%s", "<p '>%s", "<p class>%s", "<!-- > -->%s", "<p a=b/c'd>%s"):
        page = "<article>" + form % prose(1, 40) + f"<p>{prose(2, 40)}</article><p>'\"--></p>"
        assert html_extract.main_text(page, weights).split() == (prose(1, 40) + " " + prose(2, 40)).split(), form
    assert html_extract.attributes_of(" A=1 b='2' c = \"3\" d e=it's a=9 / =f") == {
        "a": "1", "b": "2", "c": "3", "d": "", "e": "it's", "=f": ""}
    long = "<p " + "a" * 300_000 + " ' " * 100_000
    assert html_extract.main_text(long, weights) == ""


def test_html_region_is_maximal():
    """The linear scan equals the best of all contiguous sums."""
    rnd = random.Random(5)
    weights = html_extract.weights_of({})
    for _ in range(50):
        page = html_extract.pieces("".join(rnd.choice(["<p>", "</p>", "<nav>", "</nav>", "a b c ", "<div class=ad>", "</div>", "x "])
                                           for _ in range(30)))

        def score(p):
            if p.tag:
                return weights.get(f"<{p.tag}", -1.2)
            around = 1.0 + sum(weights.get(x, 0.0) for x in p.names)
            return len(p.text.split()) * (-2.0 if p.dropped else max(-2.0, min(2.0, around)))

        s = [score(p) for p in page]
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)), default=0)
        a, b = html_extract.best_region(page, weights)
        assert sum(s[a:b]) == pytest.approx(max(best, 0))


# --- 4 ---------------------------------------------------------------------------------------------------------

def folded(log):
    """Final (role, text) of one conversation's events, one after the other."""
    kept = []
    for seq, kind, ref, role, text in sorted(log, key=lambda e: (e[0], chat_format.KINDS.index(e[1]))):
        if kind == "message":
            kept.append([seq, role or "", ""])
        elif kind == "regenerate":
            kept = [m for m in kept if m[0] < ref]
        else:
            kept = [m for m in kept if m[0] <= ref] if kind == "edit" else kept
            for m in kept:
                if m[0] == ref:
                    m[2] = (text or "") if kind == "edit" else m[2] + (text or "")
    return [(m[1], m[2]) for m in kept]


def test_chat_events(spark):
    rnd, events, want = random.Random(2), [], {}
    for conv in [*range(40), None]:
        log, open_ = [], []
        for seq in range(rnd.randint(1, 25)):
            kind = rnd.random()
            if kind < 0.35 or not open_:
                log.append((seq, "message", None, rnd.choice(["user", "assistant", None]), None))
                open_.append(seq)
            elif kind < 0.75:
                log.append((seq, "delta", rnd.choice(open_), None, rnd.choice([f"d{seq} ", None, "</s>\\"])))
            elif kind < 0.88:
                ref = rnd.choice(open_)
                log.append((seq, "edit", ref, None, f"E{seq} "))
                open_ = [s for s in open_ if s <= ref]
            else:
                ref = rnd.choice(open_)
                log.append((seq, "regenerate", ref, None, None))
                open_ = [s for s in open_ if s < ref]
        want[conv] = folded(log)
        events += [(conv, *e) for e in log]
    rnd.shuffle(events)
    df = spark.createDataFrame(events, chat_format.EVENTS).withColumn("turn", F.lit("clash")).withColumn("back", F.lit(1))
    got = {}
    for r in sorted(chat_format.format_events(df).collect(), key=lambda r: (r.conv_id or -1, r.turn)):
        got.setdefault(r.conv_id, []).append(chat_format.read_turn(r.formatted))
    assert got == {k: v for k, v in want.items() if v}


def test_chat_escapes_are_reversible():
    rnd = random.Random(4)
    parts = [*chat_format.CONTROL, "\\", "<", "|", "s", ">", "/", "[", "\n", " ", "é"]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))
        safe = chat_format.escape(text)
        assert chat_format.unescape(safe) == text and not any(c in safe for c in chat_format.CONTROL)
        markup, a, b = chat_format.render_turn(text, text)
        assert chat_format.read_turn(markup) == (text, text) and chat_format.unescape(markup[a:b]) == text


def test_chat_turns_odd_rows(spark):
    import duckdb
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "a</s>"), (1, 1, "assistant", "a</s>"),
            (None, 0, "assistant", "q"), (2, None, "assistant", "é\\"), (3, 5, "system", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("clash"))
    got = chat_format.digests(chat_format.format_events(chat_format.events_of_turns(df)))
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = [r for r in con.execute(chat_format.ORACLE_SQL.replace("ORDER BY turn, role, text",
                                                                 "ORDER BY turn NULLS FIRST, role, text")).fetchall() if r[0] != -1]
    key = lambda r: (r[0] is None, r[0])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert chat_format.format_events(chat_format.events_of_turns(df.limit(0))).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------

def labelled_docs(n):
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = " ".join(w.upper() + "!!" for w in prose(i, 30 + i % 50).split()) if bad else prose(i, 30 + i % 50)
        docs.append((i, text, "en", "junk" if bad and i % 2 else f"s{i % 7}", len(text)))
        if i % 3:
            labels.append((i, int(not bad), 0))
    return docs, labels


def test_cotraining_held_out(spark):
    docs, labels = labelled_docs(600)
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = cotrain.fit(d, y)
    assert sum(map(sum, model.handed)) > 0                                # the views taught each other
    got = {r.doc_id: r for r in cotrain.score_quality(d, model, "doc_id").collect()}
    unseen = [i for i in range(0, 600, 3)]
    assert np.mean([got[i].predicted == int(i % 5 != 0) for i in unseen]) > 0.97
    assert {r.doc_id for r in cotrain.keep_good(d, y).collect()} == {i for i in got if got[i].predicted}


def test_cotraining_hands_on_the_surest_of_all_rows(spark):
    """Round one against a plain pass over all unlabelled rows; copies count once, repeated ids keep the bound."""
    docs, labels = labelled_docs(300)
    docs += [docs[0], docs[1]] * 5 + [(1_000 + i, *docs[3][1:]) for i in range(40)]
    d = spark.createDataFrame(docs, SCHEMA).repartition(5)
    y = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    seen = []

    class Watched(cotrain.Model):
        def __init__(self, text, meta, label, handed_on):
            def watch(model):
                given = handed_on(model)
                seen.append((model.views[:], model.scales[:], model.share, given))
                return given
            super().__init__(text, meta, label, watch)
            seen.append(label)

    plain, cotrain.Model = cotrain.Model, Watched
    try:
        cotrain.fit(d.union(spark.createDataFrame([(1, f"more {i}", "en", "s", i) for i in range(90)], SCHEMA)), y, labelled=60)
        assert len(seen[-1]) == 60          # rows, although one id has ninety texts
        seen.clear()
        cotrain.fit(d, y, handed_on=40)
    finally:
        cotrain.Model = plain
    assert len(seen[-1]) == 200 and len(seen) == cotrain.ROUNDS + 1
    views, scales, share, given = seen[0]
    marked = {i for i, *_ in labels}
    others = sorted({t[1:] for t in docs if t[0] not in marked})
    text = np.stack([cotrain.text_features(t.encode()) for t, *_ in others])
    meta = cotrain.meta_matrix([cotrain.meta_features(s, lang, n) for _, lang, s, n in others])
    for k, x in enumerate((text, meta)):
        p = cotrain.sigmoid(scales[k][0] * views[k].logits(x) + scales[k][1])
        for c, sure, part in ((1, p, share), (0, 1 - p, 1 - share)):
            want = sorted(sure[sure >= cotrain.CONFIDENT], reverse=True)[:int(40 * part) + 1]
            rows = given[k][k][given[k][2] == c]
            got = cotrain.sigmoid(scales[k][0] * views[k].logits(rows) + scales[k][1])
            assert np.allclose(sorted(got if c else 1 - got, reverse=True), want, atol=1e-6)


def test_cotraining_odd_rows(spark, odd, labels):
    got = cotrain.score_quality(odd, cotrain.fit(odd, labels), "doc_id").collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert cotrain.keep_good(odd, labels).columns == odd.columns
    none = cotrain.fit(odd, labels.limit(0))
    assert {r.score for r in cotrain.score_quality(odd, none, "doc_id").collect()} == {0.5}
    assert cotrain.score_quality(odd.limit(0), none, "doc_id").count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(ids, prints):
    parent = list(range(len(ids)))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(top(i), []).append(ids[i])
    return [min((x for x in groups[top(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_odd_rows(odd):
    got = simhash.simhash_components(odd).collect()
    prints = [plain_fingerprint(t) for _, t, *_ in ODD]
    want = list(zip([r[0] for r in ODD], [f"{p:016x}" for p in prints], reachable([r[0] for r in ODD], prints)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(want[i][2] if want[i][2] is not None else want[i][1] for i in range(len(want))))
    assert simhash.simhash_components(odd.limit(0)).count() == 0 == simhash.keep_one_of_each(odd.limit(0)).count()


def test_simhash_links_brute_force(spark):
    rnd = random.Random(6)
    prints = []
    for _ in range(60):
        p = rnd.getrandbits(64)
        for _ in range(8):  # chains: each a few bits from the one before
            prints.append(p)
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                p ^= 1 << b
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    groups = {r.fp: r.grp for r in simhash.fingerprint_groups(frame).collect()}
    want = reachable(signed, prints)
    pairs = {}
    for s, w in zip(signed, want):
        pairs.setdefault(w, set()).add(groups[s])
    assert all(len(g) == 1 for g in pairs.values()) and len({min(g) for g in pairs.values()}) == len(pairs)


@pytest.mark.parametrize("most", [6, 64])
def test_simhash_deals_large_entries(spark, most):
    """Far-apart and near fingerprints that share one segment: entries beyond ``most`` are dealt and lose no link."""
    rnd = random.Random(most)
    fps = set()
    for _ in range(150):  # one segment value, or one bit beside it, for all
        f = rnd.getrandbits(32) << 32 | 0xABCD1234
        fps.add(f)
        for _ in range(rnd.randrange(3)):
            fps.add(f := f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))))
    fps |= {0xFFFF0000ABCD1234 ^ 1 << b for b in range(64)}
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= simhash.RADIUS:
                parent[root(a)] = root(b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    links = simhash.near_links(frame, most=most)
    got = {f: f for f in fps}

    def found(f):
        while got[f] != f:
            f = got[f]
        return f

    for r in links.collect():
        a, b = r.src % (1 << 64), r.dst % (1 << 64)
        assert 0 < (a ^ b).bit_count() and root(a) == root(b)
        got[found(a)] = found(b)
    assert len({(root(f), found(f)) for f in fps}) == len({root(f) for f in fps}) == len({found(f) for f in fps})


# --- 7 ---------------------------------------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    docs, labels = [], []
    for i in range(700):
        words, bad = prose(i, 20 + i % 90).split(), i % 4 == 0
        if bad:
            for k in range(3):
                words.insert((i * 7 + k * 5) % len(words), random.Random(i + k).choice(["grobnik", "grobnikly", "vexoid"]))
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, toxicity.fit(d, y), "doc_id").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95


def test_toxicity_windows_cover_the_text():
    for n in range(0, 200):
        starts = list(toxicity.window_starts(n))
        covered = {w for s in starts for w in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and starts[0] == 0


def test_toxicity_gradient():
    """The hand-written gradient equals finite differences."""
    net = toxicity.Network(np.zeros(toxicity.WORD_ROWS, np.float32), np.zeros(toxicity.GRAM_ROWS, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (5, 3, 6 * toxicity.HIDDEN))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    c = rng.normal(0, 1, 3)
    keep = []
    net.forward(x, mask, keep)
    g, dx = net.backward(x, mask, keep, c)
    for name in ("rec", "att", "att_v", "out"):
        flat = net.p[name].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            old, ends = flat[i], []
            for e in (1e-2, -1e-2):
                flat[i] = old + e
                ends.append((net.forward(x, mask) * c).sum())
            flat[i] = old
            assert g[name].reshape(-1)[i] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=5e-3)


def test_toxicity_odd_rows(odd, labels):
    net = toxicity.fit(odd, labels)
    got = toxicity.score_toxicity(odd, net, "doc_id").collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.keep_civil(odd, labels).columns == odd.columns
    assert toxicity.fit(odd, labels.limit(0)) == 0.0
    assert toxicity.score_toxicity(odd.limit(0), net, "doc_id").count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bits,n,k", [(64, 300, 5), (128, 60, 3), (8, 40, 10)])
def test_top_k_brute_force(spark, bits, n, k):
    rng = np.random.default_rng(bits)
    vectors = rng.normal(0, 1, (n, bits)) + 2 * rng.normal(0, 1, (5, bits))[rng.integers(0, 5, n)]
    vectors[n // 2:n // 2 + 12] = vectors[0]                              # one vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1, vectors[1].tolist()), (n, None), (n + 1, []), (None, vectors[0].tolist()),
                                                               (n + 2, [None] * bits)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("key", F.lit("clash"))
    codes = topk.sign_codes(df, "vec_id", "embedding")
    got = topk.exact_top_k(codes, codes.filter("id % 7 = 0"), k).collect()
    on = vectors > 0
    want = []
    for q in range(0, n, 7):
        best = sorted((int((on[q] != on[i]).sum()), i) for i in range(n))[:k]
        want += [(q, i, d, r + 1) for r, (d, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_common_segment(spark, monkeypatch):
    """Half of the codes share a segment value: salted, in blocks and in chunks, the result is the same."""
    for name, value in (("HEAVY", 20), ("CHUNK", 50), ("PAIRS", 100), ("MANY", 12)):
        monkeypatch.setattr(topk, name, value, raising=False)
    rng = np.random.default_rng(4)
    n, k = 300, 5
    codes = rng.integers(0, 256, (n, 8), dtype=np.uint8)
    codes[: n // 2, :4] = 7
    codes[10:16] = codes[10]
    df = spark.createDataFrame([(i, codes[i].tobytes()) for i in range(n)], "id bigint, code binary")
    got = topk.exact_top_k(df, df.filter("id % 3 = 0"), k).collect()
    want = []
    for q in range(0, n, 3):
        best = sorted((int(np.bitwise_count(codes[q] ^ codes[i]).sum()), i) for i in range(n))[:k]
        want += [(q, i, d, r + 1) for r, (d, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_memory_of_a_common_segment():
    """A task's arrays do not grow with all pairs of a group's probes and entries."""
    rng = np.random.default_rng(5)
    n_entries, n_probes = 10_000, 1_000
    n = n_entries + n_probes
    kind = np.r_[np.zeros(n_entries, np.int32), np.ones(n_probes, np.int32)]
    columns = {"key": np.zeros(n, np.int64), "salt": np.zeros(n, np.int64), "kind": kind,
               "code": [x.tobytes() for x in rng.integers(0, 256, (n, 8), dtype=np.uint8)],
               "least": np.where(kind == 0, np.arange(n), 64), "n": np.ones(n, np.int64)}
    names = ["key", "salt", "kind", "code", "least", "n"] if hasattr(topk, "HEAVY") else ["key", "kind", "code", "least", "n"]
    batch = pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in names], names)
    tracemalloc.start()
    out = list(topk.meet(10)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(x.num_rows for x in out) == 10 * n_probes
    assert peak < 200e6


def test_top_k_empty(spark):
    codes = topk.sign_codes(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), "vec_id", "embedding")
    assert topk.exact_top_k(codes, codes).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------------

def test_token_counts_equal_the_library(odd):
    import tokenizers
    path = tokenizer_file("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = sorted(map(tuple, token_counts.token_counts(odd, path).collect()), key=str)
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t, *_ in ODD]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(odd.limit(0), path).count() == 0
    rnd, lengths = random.Random(1), token_counts.Lengths(library.to_str())
    parts = ["a", " ", "\n", "'s", "é", "ﬁ", "<|endoftext|>", "1", " b", "\t", " ", "\x1c", "!!", "日本", "👍", ".", "  ", "thing", "Ça,", "x;"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert lengths.count([text]) == [count(text)], repr(text)


def test_token_cache_refills(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_SIZE", 8)
    lengths = token_counts.Lengths(open(tokenizer_file("byte_bpe_50k.json")).read())
    for seed in range(20):
        text = prose(seed, 30)
        assert lengths.count([text]) == [lengths.encoded(text)]


# --- 10 --------------------------------------------------------------------------------------------------------

def test_lm_base_and_model(spark, odd):
    more = spark.createDataFrame([(100 + i, prose(i, 120), "en", "s", 1) for i in range(120)], SCHEMA)
    docs = odd.unionByName(more, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = attention_lm.score_texts(docs, tokenizer_file("piece_bpe_32k.model")).collect()
    remainder = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    counts = Counter(w for i, t in rows if remainder(i) != 2 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), remainder(i) == 2, len(words(t)), sum(counts[w] > 0 for w in words(t)), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 4)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    empty = docs.limit(0)
    assert attention_lm.score_texts(empty, tokenizer_file("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("name,value", [("FREQUENT", 5), ("PAIRS", 3)])
def test_lm_score_has_no_caps(spark, monkeypatch, name, value):
    """Words beyond the table of frequent words have the same probability, and so have pairs of ids beyond theirs."""
    rnd = random.Random(12)
    new = lambda: " ".join("".join(rnd.choices("bcdfgkqvxz", k=9)) for _ in range(30))  # noqa: E731  held-out rows have words without counts
    docs = spark.createDataFrame([(i, f"{prose(i, 40)} {new()}") for i in range(40)], "doc_id bigint, text string").coalesce(1)
    scores = lambda: {r.doc_id: r.score for r in attention_lm.score_texts(docs, tokenizer_file("piece_bpe_32k.model")).collect()}
    want = scores()
    monkeypatch.setattr(attention_lm, name, value)
    assert scores() == pytest.approx(want, rel=1e-4)


def lm(seed=0):
    words = attention_lm.Words(open(tokenizer_file("piece_bpe_32k.model"), "rb").read())
    counts = np.bincount(np.random.default_rng(seed).integers(0, 400, 5000) + 300, minlength=words.size)
    model = attention_lm.Model(words.front, words.end, counts)
    model.follow(counts, np.zeros((model.n_classes, words.size)))
    return words, model


def test_lm_is_a_distribution_and_causal():
    words, model = lm()
    ids, _ = words.stream([w.encode() for w in prose(3, 60).split()])
    size = np.array([len(ids)])
    whole = model.class_log_p(ids, size)
    for cut in (5, 33, 50):                                               # later ids change nothing before them
        assert np.allclose(whole[:cut], model.class_log_p(ids[:cut], np.array([cut])), atol=1e-4)
    two = model.class_log_p(np.r_[ids, ids], np.r_[size, size])              # nor do other texts
    assert np.allclose(two, np.r_[whole, whole], atol=1e-4)
    at = 40
    each = [model.class_log_p(np.r_[ids[:at], i], np.array([at + 1]))[-1] for i in
            [int(np.flatnonzero(model.class_of == c)[0]) for c in np.unique(model.class_of)]]
    assert np.exp(each).sum() == pytest.approx(1, abs=1e-3)
    for c in np.unique(model.class_of)[:10]:
        own = model.class_of == c
        assert np.exp(model.in_class[model.n_classes][own].astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_lm_scores_as_it_is_trained():
    """The scoring path's class probabilities equal those that gradients are taken of."""
    words, model = lm()
    b = attention_lm.BLOCK
    ids, _ = words.stream([w.encode() for w in prose(3, 200).split()])
    scored = model.class_log_p(ids, np.array([len(ids)]))
    for block in range(3):
        window = np.full(2 * b + 1, -1, np.int64)
        upto = ids[max(0, block * b - b - 1):block * b + b]
        window[len(window) - len(upto):] = upto
        before = window[None, :-1]
        rows = np.where(before >= 0, model.row_of[before], model.begin)
        seen = (before >= 0) | (np.arange(2 * b) == np.argmax(window >= 0) - 1)
        x = model.p["emb"][rows]
        q, k, v = np.split(x @ model.p["qkv"], 3, axis=2)
        z = model.attend(x[:, b:], q[:, b:], k, v, seen)[0]
        want = (z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(b), model.class_of[upto[-b:]]]
        assert np.allclose(scored[block * b:block * b + b], want, atol=1e-4)


def test_lm_inside_words():
    """The ids that may follow an id, given their class, are a distribution, with pairs from the table or joined later."""
    words, model = lm()
    inner = np.flatnonzero(~model.front)
    own = inner[model.class_of[inner] == model.class_of[inner[5]]]
    before, n_ids = int(np.flatnonzero(model.front)[7]), words.size
    totals = np.zeros(n_ids * model.n_classes)
    totals[before * model.n_classes + model.class_of[own[0]]] = 12
    keys, n = before * n_ids + own[:2], np.array([5, 7]) if len(own) > 1 else np.array([12])
    inside = attention_lm.Inside(model, keys[:len(n)], n, totals)
    pair = np.stack([np.full(len(own), before), own], 1).ravel()
    sums, (word, key, smooth) = inside.of(pair, np.full(len(own), 2))
    alone = model.in_class[model.n_classes, before]
    assert np.exp(sums - alone).sum() == pytest.approx(1, abs=1e-3)
    assert len(word) == len(own) - len(n)                                  # pairs that the table lacks
    none = attention_lm.Inside(model, np.zeros(0, np.int64), np.zeros(0), totals)
    later, (word, key, smooth) = none.of(pair, np.full(len(own), 2))
    joined = dict(zip(keys.tolist(), n.tolist()))
    assert np.allclose(later + [math.log1p(joined.get(k, 0) / s) for k, s in zip(key.tolist(), smooth)], sums)
    assert [float(x) for x in inside.of(np.zeros(0, np.int32), np.array([0, 0]))[0]] == [0, 0]  # words without ids


def test_lm_gradient():
    words, model = lm()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(1)
    length = 2 * attention_lm.BLOCK + 1
    ids = rng.integers(300, 600, (4, length))
    ids[0, :20] = -1

    def loss():
        before, target = ids[:, :-1], ids[:, -attention_lm.BLOCK:]
        rows = np.where(before >= 0, model.row_of[before], model.begin)
        seen = (before >= 0) | (np.arange(length - 1) == np.argmax(ids >= 0, 1)[:, None] - 1)
        seen[:, -1] = True
        x = model.p["emb"][rows]
        q, k, v = np.split(x @ model.p["qkv"], 3, axis=2)
        b = attention_lm.BLOCK
        z = model.attend(x[:, b:], q[:, b:], k, v, seen)[0]
        z = z - np.log(np.exp(z).sum(1, keepdims=True))
        at = np.flatnonzero(target.ravel() >= 0)
        return -z[at, model.class_of[target.ravel()[at]]].mean()

    g = model.gradient(ids)
    for name in ("qkv", "near", "mid", "out", "emb"):
        flat = model.p[name].reshape(-1)
        for i in np.argsort(-np.abs(g[name].reshape(-1)))[:3]:
            old, ends = flat[i], []
            for e in (1e-3, -1e-3):
                flat[i] = old + e
                ends.append(loss())
            flat[i] = old
            assert g[name].reshape(-1)[i] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=0.05, abs=1e-4)


# --- worker caches ---------------------------------------------------------------------------------------------

def test_caches_do_not_outlive_their_content(spark):
    """Two benchmarks of one shape, and several networks in a row, in workers that are used again."""
    schema = "item_id bigint, text string"
    items = [" ".join(f"{a}{k}" for k in range(12)) for a in "pq"]
    docs = spark.createDataFrame([(k, f"before it {x} after it") for k, x in enumerate(items)], SCHEMA.replace(
        ", lang string, source string, n_chars bigint", "")).coalesce(1)
    for _ in range(2):
        for k, item in enumerate(items):
            found = decontam.find_leaks(docs, spark.createDataFrame([(1, item)], schema)).select("doc_id").collect()
            assert [r.doc_id for r in found] == [k]
            assert [r.doc_id for r in decontam.keep_clean(docs, spark.createDataFrame([(1, item)], schema)).collect()] == [1 - k]

    text = spark.createDataFrame([(1, prose(1, 30))], "doc_id bigint, text string").coalesce(1)
    for seed in range(6):
        rng = np.random.default_rng(seed)
        net = toxicity.Network(rng.normal(size=toxicity.WORD_ROWS), rng.normal(size=toxicity.GRAM_ROWS))
        want = toxicity.Scorer(net).text_logits([prose(1, 30)])[0]
        assert toxicity.logits(text, net, "doc_id").first().logit == pytest.approx(float(want), rel=1e-6)


def test_every_id_of_every_training_text_is_learnt_from_once():
    words = attention_lm.Words(open(tokenizer_file("piece_bpe_32k.model"), "rb").read())
    rows = [b"", b"one", b"a few words only", b" ".join(b"word%d" % (i * i) for i in range(700))]
    b, size = attention_lm.BLOCK, lambda text: len(words.stream([*attention_lm.tokens_of(text), attention_lm.END])[0])
    for text in rows:
        ids = words.stream([*attention_lm.tokens_of(text), attention_lm.END])[0].tolist()
        learnt = [w for turn in range(attention_lm.ROUNDS) for w in attention_lm.training_windows([text], words, turn)]
        assert sorted(x for w in learnt for x in w[-b:].tolist()) == sorted(ids)
        assert all(len(w) <= 2 * b + 1 and w.tolist() in [ids[max(0, e - len(w)):e] for e in range(1, len(ids) + 1)] for w in learnt)
    together = [attention_lm.training_windows(rows, words, turn) for turn in range(attention_lm.ROUNDS)]
    assert sum(len(w[-b:]) for t in together for w in t) == sum(map(size, rows))
