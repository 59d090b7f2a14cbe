"""Alignment of two tokenizers' tokens over the same bytes (operator 11).

Tokens of A (byte-level BPE) and of B (SentencePiece) cover the same bytes.  A
text is divided at a byte offset where a token of A and a token of B both end:
the common end is looked for near the middle of A's tokens, each try a bisection
of B's ends, and both halves are divided again.  An interval without such a cut
is a leaf: a group of tokens that belong together.  All intervals of a
slice are divided together, level by level.

Neither tokenizer puts a single space that has other characters on both sides
anywhere but at the start of a token, so such a place is a common end of every
text, and what stands between two of them is encoded and divided once as long as
a worker remembers it.  A SentencePiece model for which that does not hold (a
piece with a space inside) has its texts divided whole.

Two tokens are linked when their byte ranges overlap.  How many texts of the
corpus hold a pair of ids linked is counted in three steps:

1. every text's groups, and its distinct id pairs with the number of their links,
   are written once;
2. a task sums the pairs of its texts before anything is shuffled, so the table of
   counts grows with the distinct pairs, not with the links;
3. the most frequent pairs, at most ``FREQUENT``, reach every task as one table.
   The rest of a text's pairs is joined with the counts; no pair is left out, and
   no key of that join is frequent.

Defined results: a text that is null, empty, or that one of the tokenizers does
not give back byte by byte has no tokens, and all its numbers are zero; a null id
is kept; repeated rows are counted one by one, each as a document; an empty table
gives an empty one; other input columns are ignored, whatever their names.  Very
long texts are divided like any other; a task holds one slice of its batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ciphersift.llm.common import content_name, read_bytes, slices, table, texts, tokenizer_file, worker_state, written
from ciphersift.llm.token_counts import byte_symbols

FREQUENT = 1 << 19         # entries of the table that every task gets
SUMMED_AT_ONCE = 2_000_000  # distinct pairs that a task holds before it hands them on
SLICE_BYTES = 2_000_000
CACHED_CHARS = 3_000_000    # of the parts that a worker remembers
PARTS_IN_A_LINE = 500
#: A space between characters that are no white space.
BETWEEN = re.compile(r" (?<=\S )(?=\S)")


class Tokenizers:
    """Both tokenizers, with the bytes of each of their entries."""

    def __init__(self, model_a: bytes, model_b: bytes):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_buffer(model_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        byte_of = {symbol: byte for byte, symbol in byte_symbols().items()}
        entries = self.a.get_vocab()
        self.size_a, self.size_b = max(entries.values()) + 1, self.b.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.size_b)))]
        self.parted = not any("▁" in p.lstrip("▁") for p in map(self.b.id_to_piece, range(self.size_b)))
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def encoded(self, lines: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of all lines, ids per line) by A and by B; none where a line is empty or not given back by both."""
        batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)  # the same ids, without offsets
        lists_a = [x.ids for x in batch([" " + t for t in lines], add_special_tokens=False)]
        lists_b = self.b.encode(lines, num_threads=1)
        spelled = [b" " + t.encode() for t in lines]
        good = np.fromiter(map(bool, lines), bool, len(lines))
        for lists, names in ((lists_a, self.bytes_a), (lists_b, self.bytes_b)):
            good &= np.array([b"".join(map(names.__getitem__, x)) == y for x, y in zip(lists, spelled)], bool)
        sizes = [np.fromiter(map(len, x), np.int64, len(lines)) for x in (lists_a, lists_b)]
        ids = [np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in zip((lists_a, lists_b), sizes)]
        return [(i[np.repeat(good, n)], n * good) for i, n in zip(ids, sizes)]

    def encoded_parts(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same of parts without white space at their ends, encoded as lines of many parts each."""
        lines = [" ".join(parts[k:k + PARTS_IN_A_LINE]) for k in range(0, len(parts), PARTS_IN_A_LINE)]
        both = self.encoded(lines)
        if any((n == 0).any() for _, n in both):
            return self.encoded(parts)  # some part is not given back: let it not touch the others
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)) + 1)
        out = []
        for (ids, _), lengths in zip(both, (self.length_a, self.length_b)):
            stop = np.searchsorted(np.cumsum(lengths[ids]), ends) + 1
            out.append((ids, np.diff(np.r_[0, stop])))
        return out


def divide(ends_a: np.ndarray, ends_b: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Leaf groups (first A, stop A, first B, stop B) of the intervals ``docs``, in order.

    The ends rise over the whole slice; each given interval ends with a common end.
    """
    leaves, active = [], docs
    while len(active):
        first_a, stop_a, first_b, stop_b = active.T
        middle = (first_a + stop_a - 1) // 2
        cut_a = np.full(len(active), -1)
        cut_b = np.full(len(active), -1)
        open_ = np.flatnonzero((stop_a - first_a > 1) & (stop_b - first_b > 1))
        away = 0
        while len(open_):  # the middle token of A, then the ones beside it, further and further out
            for at in (middle[open_] + away, middle[open_] - away)[:1 + (away > 0)]:
                inside = (at >= first_a[open_]) & (at < stop_a[open_] - 1) & (cut_a[open_] < 0)
                tried, place = open_[inside], at[inside]
                near = np.searchsorted(ends_b, ends_a[place])
                hit = (ends_b[near] == ends_a[place]) & (near < stop_b[tried] - 1)
                cut_a[tried[hit]], cut_b[tried[hit]] = place[hit], near[hit]
            away += 1
            left = (cut_a[open_] < 0) & ((middle[open_] - away >= first_a[open_]) | (middle[open_] + away < stop_a[open_] - 1))
            open_ = open_[left]
        whole = cut_a < 0
        leaves.append(active[whole])
        at_a, at_b = cut_a[~whole] + 1, cut_b[~whole] + 1
        halved = active[~whole]
        active = np.concatenate([np.stack([halved[:, 0], at_a, halved[:, 2], at_b], axis=1),
                                 np.stack([at_a, halved[:, 1], at_b, halved[:, 3]], axis=1)])
    found = np.concatenate(leaves) if leaves else np.zeros((0, 4), np.int64)
    return found[np.argsort(found[:, 0], kind="stable")]


class Aligner:
    """Groups and linked id pairs of many texts at a time; parts of texts are divided once while they are remembered."""

    def __init__(self, model_a: bytes, model_b: bytes):
        self.tok = Tokenizers(model_a, model_b)
        self.names = [f"{i}{mark}" for mark in ",|;" for i in range(max(self.tok.size_a, self.tok.size_b))]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []                  # rendered, of each part
        self.numbers = np.zeros((3, 0), np.int64)    # n_a, n_b, n_groups of each part
        self.starts = np.zeros(1, np.int64)          # where the links of each part begin
        self.links = np.zeros(0, np.int64)           # id pairs
        self.uses = np.zeros(0, np.int64)
        self.chars = 0

    def forget_rare(self) -> None:
        """Keep the parts that were used more often than half of them."""
        keep = self.uses > np.median(self.uses)
        names, groups, uses = list(self.index), self.groups, self.uses
        numbers, n = self.numbers[:, keep], np.diff(self.starts)
        links = self.links[np.repeat(keep, n)]
        self.forget()
        kept = np.flatnonzero(keep).tolist()
        self.index = {names[k]: i for i, k in enumerate(kept)}
        self.groups, self.uses = [groups[k] for k in kept], uses[keep] // 2
        self.numbers, self.starts, self.links = numbers, np.cumsum(np.r_[0, n[keep]]), links
        self.chars = sum(map(len, self.index))

    def learn(self, parts: list[str]) -> None:
        """Encode and divide the parts that are not remembered."""
        plain = [p for p in parts if p and not (p[0].isspace() or p[-1].isspace())] if self.tok.parted else []
        odd = list(set(parts).difference(plain))
        for own, encoded in ((plain, self.tok.encoded_parts), (odd, self.tok.encoded)):
            if not own:
                continue
            numbers, groups, starts, links = self.divided(*encoded(own))
            self.index.update(zip(own, range(len(self.groups), len(self.groups) + len(own))))
            self.groups += groups
            self.numbers = np.concatenate([self.numbers, numbers], axis=1)
            self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])
            self.links = np.concatenate([self.links, links])
            self.uses = np.concatenate([self.uses, np.zeros(len(own), np.int64)])
            self.chars += sum(map(len, own))

    def divided(self, by_a: tuple[np.ndarray, np.ndarray], by_b: tuple[np.ndarray, np.ndarray]):
        """Of each line: n_a, n_b and n_groups, its rendered groups, where its links begin; and the id pairs of the links."""
        tok, (ids_a, n_a), (ids_b, n_b) = self.tok, by_a, by_b
        ends_a, ends_b = np.cumsum(tok.length_a[ids_a]), np.cumsum(tok.length_b[ids_b])
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        spans = np.stack([stop_a - n_a, stop_a, stop_b - n_b, stop_b], axis=1)
        found = divide(ends_a, ends_b, spans[n_a > 0])
        n_groups = np.bincount(np.searchsorted(stop_a, found[:, 0], side="right"), minlength=len(n_a))
        # every piece of bytes between neighbouring ends is one link: of the A token and the B token that hold it
        ends = np.union1d(ends_a, ends_b)
        of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        starts = np.searchsorted(np.searchsorted(stop_a, of_a, side="right"), np.arange(len(n_a) + 1))
        return (np.stack([n_a, n_b, n_groups]), self.rendered(ids_a, ids_b, found, n_a + n_b), starts,
                ids_a[of_a] * tok.size_b + ids_b[of_b])

    def aligned(self, lines: list[str]):
        """Per text: (n_a, n_b, n_groups, n_links, rendered groups); and (text, pair, times) of its distinct id pairs."""
        if self.chars > CACHED_CHARS:
            self.forget_rare()
        parts = [BETWEEN.split(t) if self.tok.parted else [t] for t in lines]
        if new := list(set(chain.from_iterable(parts)).difference(self.index)):
            self.learn(new)
        sizes = np.array([len(x) for x in parts], np.int64)
        text = np.repeat(np.arange(len(lines)), sizes)
        codes = list(map(self.index.__getitem__, chain.from_iterable(parts)))
        part = np.array(codes, np.int64)
        self.uses += np.bincount(part, minlength=len(self.uses))
        whole = np.bincount(text[self.numbers[0, part] == 0], minlength=len(lines)) == 0  # no part without tokens
        n_links = np.diff(self.starts)
        sums = [np.bincount(text, weights=x[part], minlength=len(lines)).astype(np.int64) * whole
                for x in (*self.numbers, n_links)]
        groups, ends = list(map(self.groups.__getitem__, codes)), np.cumsum(sizes).tolist()
        rendered = [";".join(groups[a:b]) if ok else "" for a, b, ok in zip([0, *ends], ends, whole.tolist())]
        text, part = text[whole[text]], part[whole[text]]
        n = n_links[part]
        place = np.repeat(self.starts[part] - np.cumsum(np.r_[0, n])[:-1], n) + np.arange(n.sum())
        pairs = self.tok.size_a * self.tok.size_b
        key = np.sort(np.repeat(text * pairs, n) + self.links[place])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(key)])
        return (*sums, rendered), (key[first] // pairs, key[first] % pairs, times)

    def rendered(self, ids_a, ids_b, groups, sizes) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every line."""
        first_a, stop_a, first_b, stop_b = groups.T
        size = len(self.names) // 3
        line = np.empty(len(ids_a) + len(ids_b), np.int64)
        line[np.arange(len(ids_a)) + np.repeat(first_b, stop_a - first_a)] = ids_a  # A's tokens come after all B's before
        line[np.arange(len(ids_b)) + np.repeat(stop_a, stop_b - first_b)] = ids_b
        line[stop_a + first_b - 1] += size       # the last of A in a group
        line[stop_a + stop_b - 1] += 2 * size    # the last of B in a group
        names = list(map(self.names.__getitem__, line.tolist()))
        ends = np.cumsum(sizes).tolist()
        return ["".join(names[a:b])[:-1] for a, b in zip([0, *ends], ends)]


def align(docs: DataFrame, model_a: str, model_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: n_a, n_b, n_groups, n_links, groups (the rendered ones), pairs and times of its id pairs."""
    kind = docs.schema[id_col].dataType.simpleString()
    models = (read_bytes(model_a), read_bytes(model_b))
    shipped = docs.sparkSession.sparkContext.broadcast(models)  # two files of fixed size
    token = content_name(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        state = worker_state("token_alignment")
        if state.get("of") != token:
            state.update(of=token, aligner=Aligner(*shipped.value))
        for batch in slices(batches, "__llm_text", SLICE_BYTES):
            (*numbers, groups), (text, pair, times) = state["aligner"].aligned(texts(batch.column(1)))
            offsets = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array(groups, pa.string()),
                 pa.ListArray.from_arrays(offsets, pa.array(pair, pa.int64())),
                 pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__llm_text")).mapInArrow(
        run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
             "pairs array<bigint>, times array<int>")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's texts hold each pair."""
    def flushed():
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        own, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
        keys, back = np.unique(np.concatenate([keys, own]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        if len(keys) > SUMMED_AT_ONCE:
            yield from flushed()
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys):
        yield from flushed()


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): the documents that hold a linked pair; best: no pair of the same A id has more."""
    counts = written(aligned.select("pairs").mapInArrow(_summed, "pair bigint, n bigint").groupBy("pair")
                     .agg(F.sum("n").alias("n")), "alignment-pairs")
    a = F.floor(F.col("pair") / F.lit(size_b)).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))  # a row per entry of A's vocabulary at most: safe to broadcast
    return counts.join(F.broadcast(most), F.floor(F.col("pair") / F.lit(size_b)) == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent_pairs(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(frequent, rest): the pairs of the highest counts, at most ``most`` of them, and all others.

    Counts fall into steps of an eighth of a power of two, at most a few hundred, so the histogram is small.
    """
    step = F.floor(8 * F.log2("n"))
    frequent, lowest = 0, None
    for row in sorted(pairs.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        if frequent + row["count"] > most:
            break
        frequent, lowest = frequent + row["count"], row["step"]
    if lowest is None:
        return pairs.limit(0), pairs
    return pairs.filter(step >= lowest), pairs.filter(step < lowest)


def alignment_counts(docs: DataFrame, model_a: str, model_b: str, id_col: str = "doc_id", text_col: str = "text",
                     frequent: int = FREQUENT, groups: Column | None = None) -> DataFrame:
    """A row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups``: what to keep of the rendered groups (column ``groups``), which are longer than the texts.
    """
    spark = docs.sparkSession
    aligned = align(docs, model_a, model_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    aligned = written(aligned if groups is None else aligned.withColumn("groups", groups), "alignment")
    size_b = Tokenizers(read_bytes(model_a), read_bytes(model_b)).size_b
    pairs = written(pair_counts(aligned, size_b), "alignment-counts")
    often, rest = frequent_pairs(pairs, frequent)
    got = often.orderBy("pair").toArrow()  # at most ``frequent`` rows of 17 bytes
    known = spark.sparkContext.broadcast(tuple(got.column(c).to_numpy() for c in ("pair", "n", "best")))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = known.value
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            pair = lists.values.to_numpy()[offsets[0]:offsets[-1]]
            times = batch.column(2).flatten().to_numpy()
            text = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            at = at[hit]
            links = times[hit].astype(np.int64)
            sums = [np.bincount(text[hit], weights=w, minlength=batch.num_rows).astype(np.int64)
                    for w in (links * best[at], links * counts[at])] if len(keys) else [np.zeros(batch.num_rows, np.int64)] * 2
            left = pa.array(np.searchsorted(text[~hit], np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(s) for s in sums),
                 pa.ListArray.from_arrays(left, pa.array(pair[~hit])), pa.ListArray.from_arrays(left, pa.array(times[~hit]))],
                ["row", "n_best", "count_sum", "pairs", "times"])

    partial = written(aligned.select("row", "pairs", "times").mapInArrow(
        looked_up, "row bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<int>"), "alignment-partial")
    rare = (partial.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
            .select("row", "x.pairs", "x.times").withColumnRenamed("pairs", "pair"))
    added = (rare.join(rest, "pair").groupBy("row")
             .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("bigint").alias("more_best"),
                  F.sum(F.col("times") * F.col("n")).cast("bigint").alias("more_sum")))
    sums = partial.select("row", "n_best", "count_sum").join(added, "row", "left").select(
        "row", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))
    return aligned.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "row").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", F.col("groups")).otherwise(F.sha2("groups", 256))
    return alignment_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"),
                            tokenizer_file("piece_bpe_32k.model"), groups=digest).withColumnRenamed("groups", "groups_sha256")
