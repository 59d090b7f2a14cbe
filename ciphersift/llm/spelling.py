"""Spelling variants by a dictionary of trie-node pairs (operator 13).

The words of a vocabulary span a trie, and their reversals another one.  A word
with one position skipped is a pair of nodes: the prefix before the position and
the suffix after it.  A word cut between two characters is such a pair as well.

* two words that share a pair with a position skipped in both differ by a
  replaced character;
* a word with a position skipped and a word merely cut that share a pair differ
  by an inserted (or deleted) one.

So the near words are two equi-joins on pairs of integers.  Each node's number
is a hash of its path, so every task numbers the nodes of its own words in time
linear in their length, and a node has one number wherever it is met.  Equal
paths have equal numbers, so no near word is lost; each candidate is checked by
its edit distance, so a clash of numbers adds none.  A pair of nodes with a
skipped position belongs to at most as many words as the alphabet has letters.

A word's form is its near word of largest count (ties: the first in code-point
order) where that count is ten times its own or more.  Counts grow tenfold along
a chain of forms, so chains are short; the root is found by pointer doubling.

Defined results: null and empty texts have no words; a null id counts as the
empty text in the noise rule; repeated rows count once each; words of any length
are kept whole; an empty table, or one without words, gives an empty one; other
input columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ciphersift.llm.common import slices, table, texts, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10                 # a form is so many times as frequent
NOISE = 31                 # one occurrence in so many loses a letter; 0: none
COUNTED_AT_ONCE = 300_000  # distinct words that a task holds before it hands them on
NODES_AT_ONCE = 200_000    # node pairs made at a time
#: Two primes below 2^31 and a base for each: a node's number is both remainders of its path.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 998_244_353)


def words_of(text: str, doc_id: object, least: int = LEAST_LENGTH, noise: int = NOISE) -> Counter:
    """The words of a whole text, A-Z lowered, after the noise rule, of ``least`` code points or more."""
    found = Counter(RUN.findall(text.encode().lower().decode()))  # bytes lower A-Z only
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for word, n in found.items():
        if len(word) < least:
            continue
        if noise and not (h := zlib.crc32(word.encode(), before)) % noise:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < least:
                continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH,
               noise: int = NOISE) -> DataFrame:
    """(word, n) over the whole table; a task sums the words of its texts before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              ["word", "n"])

        counts: Counter = Counter()
        for batch in slices(batches, "__llm_text", 4_000_000):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                for word, n in words_of(text, doc_id, least, noise).items():
                    counts[word] += n
                if len(counts) > COUNTED_AT_ONCE:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__llm_text"))
    return source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def path_numbers(letters: np.ndarray) -> np.ndarray:
    """Numbers of the trie nodes on the paths of words of one length (rows): one more column than letters."""
    out = np.zeros((len(letters), letters.shape[1] + 1), np.int64)
    parts = [np.ones(len(letters), np.int64) for _ in PRIMES]
    out[:, 0] = parts[0] << 31 | parts[1]
    for k in range(letters.shape[1]):
        parts = [(p * base + letters[:, k] + 1) % prime for p, base, prime in zip(parts, BASES, PRIMES)]
        out[:, k + 1] = parts[0] << 31 | parts[1]
    return out


def _node_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, word): (prefix, suffix, id, skipped) for every skipped position and every cut."""

    def pairs(ids: np.ndarray, words: list[str]) -> pa.RecordBatch:
        size = len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.int64)
        prefix = path_numbers(letters)
        suffix = path_numbers(letters[:, ::-1])[:, ::-1]  # column k: what follows the first k letters
        columns = (np.concatenate([prefix[:, :-1].ravel(), prefix.ravel()]),
                   np.concatenate([suffix[:, 1:].ravel(), suffix.ravel()]),
                   np.concatenate([np.repeat(ids, size), np.repeat(ids, size + 1)]))
        skipped = np.arange(len(columns[0])) < len(words) * size
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(skipped)], ["prefix", "suffix", "id", "skipped"])

    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        by_size: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_size.setdefault(len(word), []).append(k)
        for size, own in by_size.items():
            step = max(1, NODES_AT_ONCE // (2 * size + 1))
            for a in range(0, len(own), step):
                yield pairs(ids[own[a:a + step]], [words[k] for k in own[a:a + step]])


def near_words(words: DataFrame) -> DataFrame:
    """(id, near) in both directions for every two of ``words(id, word)`` at edit distance one."""
    nodes = written(words.select("id", "word").mapInArrow(
        _node_pairs, "prefix bigint, suffix bigint, id bigint, skipped boolean"), "spelling-nodes")
    skipped = nodes.filter("skipped").select("prefix", "suffix", "id")
    other = nodes.select("prefix", "suffix", F.col("id").alias("near"), "skipped")
    # of two words with the same place skipped one meets the other once; a word merely cut is met by the longer one
    met = (skipped.join(other, ["prefix", "suffix"]).filter("NOT skipped OR id < near").filter("id != near")
           .select("id", "near").distinct())
    checked = (met.join(words.select("id", F.col("word").alias("w")), "id")
               .join(words.select(F.col("id").alias("near"), F.col("word").alias("v")), "near")
               .filter(F.levenshtein("w", "v", 1) == 1).select("id", "near"))
    return checked.union(checked.select("near", "id")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of ``forms(id, form)``: where following forms ends; every round doubles the steps that are followed."""
    at = written(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = written(at.join(on, "root", "left").select(
            "id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("id", "root")
        if not moved.filter("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH,
                      least_count: int = LEAST_COUNT, times: int = TIMES, noise: int = NOISE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the corpus's vocabulary."""
    words = written(vocabulary(docs, id_col, text_col, least, noise).filter(F.col("n") >= least_count)
                    .withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = near_words(words).join(
        words.select(F.col("id").alias("near"), F.col("word").alias("v"), F.col("n").alias("m")), "near")
    best = near.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("o"), "v", "near")).alias("b"))
    found = written(words.join(best, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("b.o") >= times * F.col("n"), F.col("b")).alias("b")), "spelling-forms")
    ends = roots(found.filter("b IS NOT NULL").select("id", F.col("b.near").alias("form")))
    named = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return found.join(named, "id", "left").select(
        "word", "n", "n_near", F.col("b.v").alias("form"), (-F.col("b.o")).alias("form_n"),
        F.coalesce("root_word", "word").alias("root"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
