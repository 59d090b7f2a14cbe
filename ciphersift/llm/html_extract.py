"""Main text of web pages by a maximum-scoring subsequence (operator 3).

A page is read as a run of words and tags.  A word's score is positive unless
the elements around it speak against it, a tag's score is negative, and one
linear scan finds the contiguous region with the largest sum.  The weights come
from labelled pages: pages that mark their own content with an ``article`` or
``main`` element.  What a region's element encloses is taken as a whole, and
elements that are never part of an article (menus, forms, adverts, comments,
scripts, ...) are left out of it: by their element, their hiding attributes, or
a class, role or id whose deciding word names such a part (``post-comments``
names comments, ``share-price`` a price).  Around a content element the labelled
pages outvote the word list: a name that mostly encloses content drops nothing.
Tags and attributes are cut as browsers cut them.

Defined results: null or empty html, and pages without content, give the empty
text with 0 characters; page ids and urls may be null or repeat, rows are
handled one by one; an empty table gives an empty one; truncated markup at the
end of a page is markup; other input columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ciphersift.llm.common import slices, table, texts

LABELLED_PAGES = 2_000  # bound of the sample of pages that the weights are fitted on

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())  # their content has no tags
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody
    tfoot thead tr ul caption""".split())
CONTENT = frozenset(("article", "main"))
#: Elements that are never part of an article's text.
DROPPED = frozenset("""head script style noscript template iframe object svg canvas nav footer aside form button select
    option input textarea title menu dialog""".split())
#: Words of class, id and role values of such elements.
AGAINST = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav
    navbar navigation navigational menu menubar breadcrumb breadcrumbs header masthead footer sidebar sidenav aside
    complementary contentinfo widget widgets cookie cookies consent gdpr notice notices notification alert disclaimer
    popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies
    respond discussion share sharing social related recommended recommendations pagination pager toolbar search form
    hidden copyright legal""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FOR = frozenset("article articlebody main content post entry story maincontent postcontent".split())
#: Last words of names that say nothing themselves: the word before them decides.
CARRIERS = frozenset("""list lists container containers wrapper wrap box inner outer item items link links button buttons bar
    block blocks area section group left right top bottom panel row col column slot unit body text content title author
    meta thread posts articles stories icon icons holder zone count date""".split())
#: First words of names that tell a state or a category of an element, not what it is.
STATES = frozenset("has no not with without category cat tag type status format".split())
#: Ids that leave an element out even inside a content element, where ids are mostly made from headings.
CERTAIN = frozenset("""comments comment commentlist disqus disqusthread respond sidebar footer nav navbar breadcrumb
    breadcrumbs newsletter ads advert""".split())

#: An attribute as browsers cut it: a quote opens a value right after "=" only.
VALUE = r"\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*))?"
ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*)(?:{VALUE})?")
TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
                 r"|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:" + VALUE.replace("([^", "(?:[^") + r")?+)*+)(?:>|\Z)", re.S)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
WEIGHT = 2.0  # the largest weight of one element around a word


def attributes_of(raw: str) -> dict[str, str]:
    """Names in lower case and values; the first of a repeated name counts, as in browsers."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        if m[1]:
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def name_words(value: str) -> list[str]:
    parts = (p.lower() for name in value.split() for p in NAME_PART.findall(name))
    return [f".{p}" for p in parts if not p.isdigit()]


def deciding_word(name: str, alone: bool = False) -> str | None:
    """The word that makes one class, role or id a part that is not article text; None if there is none.

    The last word decides (``share-price`` is a price), :data:`CARRIERS` give way to the word before them, and a
    header of the article itself (``entry-header``) holds its title.  With ``alone``, only names of a single word count.
    """
    words = [w[1:] for w in name_words(name)]
    if not words or words[0] in STATES and len(words) > 1:
        return None
    if (whole := "".join(words)) in AGAINST:
        return whole
    while len(words) > 1 and words[-1] in CARRIERS:
        words.pop()
    if words[-1] not in AGAINST or alone and len(words) > 1:
        return None
    if words[-1] in ("header", "masthead") and len(words) > 1 and words[-2] in FOR:
        return None
    return words[-1]


def names_of(tag: str, attributes: str, inside: bool = False,
             outvoted: frozenset[str] = frozenset()) -> tuple[tuple[str, ...], int]:
    """The names an element goes by in the weights, and whether its text is left out of an article: 0 no, 1 by a
    name around a content element, 2 for good.

    Ids of headings, and of most elements inside a content element, are made from their words: they enter the
    weights, but leave nothing out.  Names in ``outvoted`` leave nothing out around content.
    """
    names, left_out = [], 2 * (tag in DROPPED)
    if tag not in ("div", "span", "section", "p", "body", "html", "td", "tr", "table"):
        names.append(tag)
    if not attributes or attributes.isspace():
        return tuple(names), left_out
    given = attributes_of(attributes)
    if ("display:none" in "".join(given.get("style", "").lower().split()) or "hidden" in given
            or given.get("aria-hidden", "").strip().lower() == "true"):
        left_out = 2
    against: set[str] = set()
    for key in ("class", "id", "role"):
        value = given.get(key, "")
        names += name_words(value)
        if tag in ("html", "body", "main") or key == "id" and (tag in HEADINGS or tag == "article"):
            continue
        if key == "id" and inside:
            against |= {w for w in ["".join(x[1:] for x in name_words(value))] if w in CERTAIN}
        else:
            against |= {w for x in value.split() if (w := deciding_word(x, tag == "article"))}
    if against and inside:
        left_out = 2
    elif against - outvoted:
        left_out = max(left_out, 1)
    return tuple(names), left_out


class Piece:
    """A text run or a tag of a page; ``left_out`` as in :func:`names_of`, of all that is open around it."""

    __slots__ = ("text", "tag", "names", "left_out", "block", "content")

    def __init__(self, text, tag, names, left_out, block, content):
        self.text, self.tag, self.names, self.left_out, self.block, self.content = text, tag, names, left_out, block, content

    @property
    def dropped(self) -> bool:
        return self.left_out > 0


def pieces(page: str, outvoted: frozenset[str] = frozenset()) -> list[Piece]:
    """Text runs and tags of a whole page in order, each with what is open around it."""
    out: list[Piece] = []
    stack: list[tuple[str, tuple[str, ...], int, int]] = []  # tag, names of all open, left out, content element
    names: tuple[str, ...] = ()
    left_out, content, block, elements, at = 0, 0, 0, 0, 0

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            out.append(Piece(html_lib.unescape(raw), None, names, left_out, block, content))

    end = len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:  # comment or declaration
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCK:
            block += 1
        elif out and out[-1].text and tag in ("br", "td", "th", "option", "dt"):
            out.append(Piece(" ", None, names, left_out, block, content))
        if closing:
            if any(s[0] == tag for s in stack):
                while stack and stack.pop()[0] != tag:
                    pass
                names, left_out, content = stack[-1][1:] if stack else ((), 0, 0)
            out.append(Piece("", tag, names, left_out, block, content))
            continue
        own, drop = names_of(tag, m[3], content > 0, outvoted)
        out.append(Piece("", tag, names + own, max(left_out, drop), block, content))
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in ("p", "li") and stack and stack[-1][0] == tag:  # their end tags may be left out
            stack.pop()
            names, left_out, content = stack[-1][1:] if stack else ((), 0, 0)
        elements += 1
        names, left_out = names + own, max(left_out, drop)
        content = elements if tag in CONTENT and not content and not drop else content
        stack.append((tag, names, left_out, content))
    return out


def is_labelled(page: list[Piece]) -> bool:
    """A page that marks exactly one content element is a labelled page."""
    return len({p.content for p in page if p.text and p.content}) == 1


def count_labels(pages: list[str]) -> Counter:
    """(name, inside) -> words under that name; ("<tag", inside) -> tags, over the labelled pages."""
    counts: Counter = Counter()
    for page in map(pieces, pages):
        if not is_labelled(page):
            continue
        for p in page:
            inside = bool(p.content) and p.left_out < 2  # names around the content element may be outvoted
            if p.tag:
                counts[f"<{p.tag}", inside] += 1
            else:
                n = len(p.text.split())
                for name in set(p.names):
                    counts[name, inside] += n
    return counts


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of being content, per name around a word; a cost, never positive, per tag.

    The fixed words of :data:`FOR`, :data:`AGAINST` and :data:`DROPPED` enter as a few pseudo-words, so they
    decide for names that no labelled page has and give way to the labels elsewhere.
    """
    seen = {name for name, _ in counts}
    named = seen | {f".{w}" for w in AGAINST | FOR} | set(DROPPED) | set(CONTENT)
    out = {}
    for name in named:
        inside, outside = counts.get((name, True), 0), counts.get((name, False), 0)
        if name[0] == "<":
            out[name] = -0.2 - 2.0 * (outside + 1) / (inside + outside + 2)
        else:
            word = name.lstrip(".")
            against = 20 * (word in AGAINST or word in DROPPED)
            out[name] = max(-WEIGHT, min(WEIGHT, math.log((inside + 1 + 20 * (word in FOR)) / (outside + 1 + against))))
    return out


def best_region(page: list[Piece], weights: dict[str, float]) -> tuple[int, int]:
    """Bounds [first, last) of the contiguous pieces with the largest sum; (0, 0) if none is positive."""
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, p in enumerate(page):
        if p.tag:
            score = weights.get(f"<{p.tag}", -1.2)
        else:
            n = len(p.text.split())
            around = 1.0 + sum(weights.get(x, 0.0) for x in p.names)
            score = n * (-WEIGHT if p.dropped and not p.content else 0.0 if p.dropped else max(-WEIGHT, min(WEIGHT, around)))
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page_html: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best region, joined by an empty line."""
    page = pieces(page_html or "", frozenset(w for w in AGAINST if weights.get("." + w, 0.0) > 0))
    first, last = best_region(page, weights)
    if first == last:
        return ""
    held = [p for p in page[first:last] if p.text and not p.dropped]
    elements = {p.content for p in held if p.content}
    blocks = {p.block for p in held}
    if elements and all(p.content for p in held):
        blocks |= {p.block for p in page if p.text and p.content in elements}
    lines: dict[int, list[str]] = {}
    for p in page:
        if p.text and not p.dropped and p.block in blocks:
            lines.setdefault(p.block, []).append(p.text)
    joined = (" ".join("".join(x).split()) for x in lines.values())
    return "\n\n".join(x for x in joined if x)


def fit_weights(pages: DataFrame, html_col: str = "html", id_col: str = "page_id",
                bound: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most ``bound`` labelled pages, those with the least hashes of their ids.

    Pages without a mark of their content are passed over before the bound applies.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(count_labels(texts(batch.column(0))))
        keys = sorted(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()),
             pa.array([counts[k] for k in keys], pa.int64())], ["name", "inside", "n"])

    html = F.col(html_col).cast("string")
    marked = (pages.filter(F.lower(html).rlike("<(article|main)[ >]"))
              .select(html.alias("h"), F.xxhash64(F.col(id_col), html).alias("o")))
    last = marked.select("o").orderBy("o").limit(bound).agg(F.max("o")).first()[0]  # hashes alone, no pages
    chosen = marked.filter(F.col("o") <= F.lit(last)).select("h")
    counts = chosen.mapInArrow(run, "name string, inside boolean, n bigint").groupBy("name", "inside").sum("n").collect()
    return weights_of({(r[0], r[1]): r[2] for r in counts})


def extract_pages(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url",
                  bound: int = LABELLED_PAGES) -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``."""
    weights = fit_weights(pages, html_col, id_col, bound)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "h", 4_000_000):
            got = [main_text(h, weights) for h in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())],
                [id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("h")).mapInArrow(
        run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
