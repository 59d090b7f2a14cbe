"""Exact token counts without shuffling pre-tokens (operator 9).

Tier 1 is a compact, bounded hash table of frequent pre-tokens and their
lengths in tokens, broadcast to every worker.  A miss goes to the worker's own
bounded cache (tier 2), and only what that misses is encoded by the library.

A pre-token here is what stands between two single spaces, with its leading
space: byte-level BPE never merges across such a place, so a text's count is
the sum over its pre-tokens.  Texts in which white space meets white space, or
that hold a special string, go to the library whole.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null id is
kept; repeated rows are counted one by one; an empty table gives an empty one.
Input columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ciphersift.llm.common import read_bytes, table, texts, tokenizer_file, worker_state

TABLE_SIZE = 32_768        # entries of the broadcast table
SUMMARY_SIZE = 8_192       # entries of a task's summary
COUNTED_AT_ONCE = 300_000  # distinct pre-tokens a task counts before it keeps the frequent ones only
CACHE_SIZE = 500_000       # entries of a worker's cache
SPACE_MEETS_SPACE = re.compile(r"\s\s|^\s|\s$")
#: Latin letters, then at most one mark: such a pre-token's inner boundaries need no library.
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([.,;:!?]?)")


def byte_symbols() -> dict[int, str]:
    """Byte-level BPE's name of each byte: printable bytes are themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(0x100 + i) for i, b in enumerate(others)}}


def _summary_batch(counts: Counter, keep: int) -> pa.RecordBatch:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:keep]
    return pa.RecordBatch.from_arrays(
        [pa.array([[k for k, _ in top]], pa.list_(pa.string())), pa.array([[v for _, v in top]], pa.list_(pa.int64()))],
        ["keys", "counts"])


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in texts(batch.column(0)):
            counts.update(text.split(" "))
            if len(counts) > COUNTED_AT_ONCE:
                counts = Counter(dict(counts.most_common(COUNTED_AT_ONCE // 4)))
    yield _summary_batch(counts, SUMMARY_SIZE)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for k, v in zip(keys, n):
                counts[k] += v
            if len(counts) > COUNTED_AT_ONCE:
                counts = Counter(dict(counts.most_common(COUNTED_AT_ONCE // 4)))
    yield _summary_batch(counts, TABLE_SIZE)


def frequent_pre_tokens(docs: DataFrame, text: str) -> list[str]:
    """The most frequent pre-tokens of the whole table, at most ``TABLE_SIZE``.

    Each task sends one bounded summary row; the rows are merged in two steps,
    so no task and no driver gets more than a bounded table from each of the
    tasks before it.  The table is a cache: it changes speed, never a count.
    """
    schema = "keys array<string>, counts array<bigint>"
    parts = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(_summarise, schema)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = parts.repartition(width).mapInArrow(_merge, schema).repartition(1).mapInArrow(_merge, schema)
    return merged.first()["keys"]


class Lengths:
    """Token counts of texts by one tokenizer file, through both tiers."""

    def __init__(self, model_json: str, frequent: dict[str, int] | None = None):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_str(model_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.frequent = frequent or {}
        self.cache: dict[str, int] = {}
        self.symbols = byte_symbols()

    def encoded(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> int:
        """Tokens of one pre-token that needs no splitting, by the library's own merge model."""
        return len(self.library.model.tokenize(word.encode().decode("latin-1").translate(self.symbols)))

    def of_misses(self, keys: list[str]) -> None:
        """Encode what neither tier has, and keep it."""
        for key in keys:
            if m := PLAIN.fullmatch(key):
                self.cache[key] = self.word(" " + m[1]) + (self.word(m[2]) if m[2] else 0)
            else:
                self.cache[key] = self.encoded(" " + key)

    def count(self, batch: list[str]) -> list[int]:
        out = []
        for text in batch:
            if not text:
                out.append(0)
                continue
            if SPACE_MEETS_SPACE.search(text) or any(s in text for s in self.specials):
                out.append(self.encoded(text))
                continue
            first, *keys = text.split(" ")
            n = self.encoded(first)
            found = list(map(self.frequent.get, keys))
            if None in found:
                left = [k for k, v in zip(keys, found) if v is None]
                missing = [k for k in dict.fromkeys(left) if k not in self.cache]
                if len(self.cache) + len(missing) > CACHE_SIZE:
                    self.cache.clear()  # what this text needs is encoded anew
                    missing = list(dict.fromkeys(left))
                self.of_misses(missing)
                n += sum(v for v in found if v is not None) + sum(map(self.cache.__getitem__, left))
            else:
                n += sum(found)
            out.append(n)
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    spark = docs.sparkSession
    model = read_bytes(tokenizer_path).decode()
    keys = frequent_pre_tokens(docs, text_col)
    own = Lengths(model)
    own.of_misses(keys)
    shipped = spark.sparkContext.broadcast((model, own.cache))
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("token_counts")
        if state.get("of") is not shipped.value:
            state.update(of=shipped.value, lengths=Lengths(*shipped.value))
        for batch in batches:
            rows = texts(batch.column(1))
            n = state["lengths"].count(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t")).mapInArrow(
        count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
