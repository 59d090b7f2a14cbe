"""Benchmark decontamination by edit distance (operator 2).

A document leaks an item when some stretch of its words is within edit distance
``floor(EDITS * n)`` of the item's ``n`` words (lower case, ASCII marks and white
space cut; a similarity of 0.8 or more).

* The CGK random walk turns edit distance into Hamming distance: at step ``j``
  it writes the word it stands on and moves on if a random bit of (``j``, word) is
  set, so two streams fall back into step after an edit.
* Each repetition samples a few steps of the walk; an item and a window with
  the same sampled words are candidates.  Windows start at every word of every
  document; items are banded by length and a window of a band is as long as
  its items.  Repetitions are added until the target share of edited copies of the
  items themselves, at the largest distance that counts, has met its item.
* An item of more than ``PIECE`` words is searched for by pieces of about equal
  length: of at most ``EDITS * n`` edits, one piece at least has no more than its
  own share.  Around a piece that is found, the whole item is verified, so
  repetitions do not grow with the length of an item.
* A window is walked only if enough of its first words occur in the benchmark
  at all; with fewer, the distance cannot be small enough, so nothing is lost.
* Candidates are verified by exact edit distance over the stretch around them.

Items are read in blocks of ``BLOCK`` of them and ``BLOCK_CHARS``, so what a task holds is bounded.

Defined results: null and empty texts leak nothing and null or empty items
are never found; ids may be null or repeat, rows are handled one by one; a
document has one row per item that it leaks, with the best stretch (the least
distance, then the first); items of fewer than five words count when they
occur exactly; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ciphersift.llm.common import content_name, slices, table, texts, with_inputs, worker_state

EDITS = 0.2          # most edits, as a share of an item's words
RECALL = 0.95        # target for copies at the largest distance
SAMPLED = 3          # steps of the walk in a key
BANDS = 1.2          # ratio between the longest and the shortest items of a band
PIECE = 100          # longer items are searched for by pieces of at most so many words
CLASSES = 1_024      # words share their random bits by id modulo this
BLOCK = 4_000        # items that are searched for together, of about so many characters in all at most
BLOCK_CHARS = 1_600_000
TRIALS = 400         # edited copies per band for measuring how many meet
SEED = 20

SEPARATORS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(SEPARATORS).split()


def most_edits(n: int) -> int:
    return int(EDITS * n + 1e-9)


class Band:
    """Pieces of similar length and their hash tables."""

    def __init__(self, low: int, high: int, parts: list[int], rng_seed: int, symbols: int):
        self.low, self.high, self.parts = low, high, parts
        self.edits = most_edits(high)
        self.steps = 2 * low  # a walk of 2n steps reads about n words
        self.seed, self.symbols = rng_seed, symbols
        self.repetitions = 0

    def prepare(self) -> None:
        """Random bits and sampled steps of each repetition, from the seed."""
        rng = np.random.default_rng(self.seed)
        self.bits, self.sampled = [], []
        for _ in range(self.repetitions):
            self.add_repetition(rng)

    def add_repetition(self, rng: np.random.Generator) -> None:
        self.sampled.append(np.sort(rng.choice(self.steps, min(SAMPLED, self.steps), replace=False)))
        self.bits.append(rng.integers(0, 2, (int(self.sampled[-1][-1]) + 1, CLASSES), dtype=np.uint8))

    def keys(self, repetition: int, stream: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Keys of the walks from ``starts``; the stream ends in enough zeros for the longest walk.

        ``classes`` are those of the stream's words, see :func:`classes_of`.
        """
        at, key = starts.copy(), np.zeros(len(starts), np.int64)
        bits, sampled = self.bits[repetition], self.sampled[repetition].tolist()
        for j in range(sampled[-1] + 1):
            if j in sampled:
                key = key * self.symbols + stream[at]
            if j < sampled[-1]:
                at += bits[j].take(classes.take(at))
        return key


def classes_of(stream: np.ndarray) -> np.ndarray:
    return (stream % CLASSES).astype(np.uint16)


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with that many random substitutions, deletions and insertions of unknown words."""
    out = item.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        if kind == 0 and out:
            out[at] = 0
        elif kind == 1 and out:
            del out[at]
        else:
            out.insert(at, 0)
    return np.array(out, np.int64)


class Index:
    """Hash tables of a block of items, small enough to ship to every task."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        lists = [words_of(t) for _, t in items]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for x in lists for w in x}))}
        self.items = [np.array([self.vocabulary[w] for w in x], np.int64) for x in lists]
        self.parts, self.part_of, self.part_at = [], [], []  # pieces, their items and where they begin
        for k, x in enumerate(self.items):
            n = max(1, -(-len(x) // PIECE))
            cuts = [i * len(x) // n for i in range(n + 1)]
            self.parts += [x[a:b] for a, b in zip(cuts, cuts[1:])]
            self.part_of += [k] * n
            self.part_at += cuts[:-1]
        self.tail = 2 * max((len(x) for x in self.parts), default=0) + 8
        self.bands: list[Band] = []
        order = sorted((k for k, x in enumerate(self.parts) if len(x)), key=lambda k: len(self.parts[k]))
        while order:
            low = len(self.parts[order[0]])
            own = [k for k in order if len(self.parts[k]) <= max(low, int(low * BANDS))]
            order = order[len(own):]
            band = Band(low, len(self.parts[own[-1]]), own, SEED + low, len(self.vocabulary) + 1)
            band.repetitions = self.needed_repetitions(band)
            self.bands.append(band)

    def padded(self, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        gap = np.zeros(self.tail, np.int64)
        starts = np.cumsum([0, *(len(x) + self.tail for x in lists[:-1])])
        return np.concatenate([y for x in lists for y in (x, gap)]), starts

    def needed_repetitions(self, band: Band) -> int:
        """As many as it takes until the target share of edited copies at the largest distance has met its piece."""
        rng = np.random.default_rng(band.seed)
        chosen = [self.parts[band.parts[k]] for k in rng.integers(0, len(band.parts), TRIALS)]
        copies = [edited(x, most_edits(len(x)), rng) for x in chosen]
        a, b = self.padded(chosen), self.padded(copies)
        band.prepare()
        met, draws = np.zeros(TRIALS, bool), np.random.default_rng(band.seed)
        while met.mean() < RECALL:
            band.add_repetition(draws)
            met |= band.keys(-1, *a, classes_of(a[0])) == band.keys(-1, *b, classes_of(b[0]))
        n = len(band.bits)
        del band.bits, band.sampled
        return n

    def open(self) -> Index:
        """Build what follows from the seeds; called once per worker."""
        self.member = np.zeros((len(self.parts), len(self.vocabulary) // 8 + 1), np.uint8)  # a bit a word
        for k, x in enumerate(self.parts):
            np.bitwise_or.at(self.member[k], x >> 3, (1 << (x & 7)).astype(np.uint8))
        self.sizes = np.array([len(x) for x in self.parts], np.int64)
        for band in self.bands:
            band.prepare()
            stream, starts = self.padded([self.parts[k] for k in band.parts])
            classes = classes_of(stream)
            band.tables = []
            for r in range(band.repetitions):
                key = band.keys(r, stream, starts, classes)
                order = np.argsort(key, kind="stable")
                band.tables.append((key[order], np.array(band.parts)[order]))
        return self

    def candidates(self, stream: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, start) pairs that meet in a repetition and share enough words."""
        known, classes = np.cumsum(np.r_[0, stream > 0]), classes_of(stream)
        found_parts, found_starts = [], []
        for band in self.bands:
            last = len(stream) - self.tail
            if last <= 0:
                continue
            first_words = known[band.low:last + band.low] - known[:last]
            starts = np.flatnonzero((first_words >= band.low - band.edits) & (owner[:last] >= 0))
            if not len(starts):
                continue
            pairs = []
            for r, (keys, parts) in enumerate(band.tables):
                key = band.keys(r, stream, starts, classes)
                lo = np.searchsorted(keys, key, "left")
                n = np.searchsorted(keys, key, "right") - lo
                hit = np.flatnonzero(n)
                if len(hit):
                    n = n[hit]
                    place = np.repeat(lo[hit] - np.cumsum(np.r_[0, n[:-1]]), n) + np.arange(n.sum())
                    pairs.append(parts[place] * np.int64(len(stream)) + np.repeat(starts[hit], n))
            if not pairs:
                continue
            pair = np.unique(np.concatenate(pairs))
            part, start = pair // len(stream), pair % len(stream)
            length = self.sizes[part]
            spare = band.edits
            shared = np.zeros(len(pair), np.int64)
            for k in range(-spare, band.high + spare):  # words of the piece around the window: a bound on what can match
                word = stream[np.clip(start + k, 0, len(stream) - 1)]
                shared += (self.member[part, word >> 3] >> (word & 7) & 1) * (k < length + spare)
            near = shared >= length - (EDITS * length + 1e-9).astype(np.int64)
            found_parts.append(part[near])
            found_starts.append(start[near])
        if not found_parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_parts), np.concatenate(found_starts)

    def leaks(self, rows: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Per text: (item, first word, end word, distance) of each item that it leaks."""
        get = self.vocabulary.get
        lists = [np.array([get(w, 0) for w in words_of(t)], np.int64) for t in rows]
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in rows]
        if not self.bands:
            return out
        stream = np.concatenate([y for x in lists for y in (x, np.zeros(1, np.int64))] + [np.zeros(self.tail, np.int64)])
        begin = np.cumsum([0, *(len(x) + 1 for x in lists)])
        owner = np.full(len(stream), -1, np.int64)
        for k, x in enumerate(lists):
            owner[begin[k]:begin[k] + len(x)] = k
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        around: dict[tuple[int, int], list[tuple[int, int]]] = {}  # where the items of found pieces may begin

        def nearest(text: int, x: np.ndarray, a: int, b: int) -> tuple[int, int, int] | None:
            spare = most_edits(len(x))
            a, b = max(a - spare, begin[text]), min(b + len(x) + spare, begin[text] + len(lists[text]))
            distance, first, end = best_match(x, stream[a:b])
            return (distance, int(a + first - begin[text]), int(a + end - begin[text])) if distance <= spare else None

        for (text, part), spans in self.stretches(*self.candidates(stream, owner), owner).items():
            item, at = self.part_of[part], self.part_at[part]
            for a, b in spans:
                if row := nearest(text, self.parts[part], a, b):
                    if len(self.parts[part]) == len(self.items[item]):
                        best[text, item] = min(best.get((text, item), row), row)
                    else:
                        around.setdefault((text, item), []).append((a - at, b - at))
        for (text, item), starts in around.items():
            for a, b in merged(sorted(starts), len(self.items[item])):
                if row := nearest(text, self.items[item], a, b):
                    best[text, item] = min(best.get((text, item), row), row)
        for (text, item), (distance, first, end) in sorted(best.items()):
            out[text].append((item, first, end, distance))
        return out

    def stretches(self, part: np.ndarray, start: np.ndarray, owner: np.ndarray) -> dict:
        """Candidate starts by (text, piece); starts no further apart than a piece's words are one stretch."""
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, s in sorted(zip(part.tolist(), start.tolist())):
            out.setdefault((int(owner[s]), i), []).append((s, s))
        return {key: merged(starts, len(self.parts[key[1]])) for key, starts in out.items()}


def merged(spans: list[tuple[int, int]], gap: int) -> list[list[int]]:
    """Sorted spans, those no further apart than ``gap`` as one."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, first, end) of the stretch of ``text`` nearest to ``item``; exact, the first of equals.

    Unknown words of the text are zero and equal no item word.
    """
    m = len(text)
    place = np.arange(m + 1)
    row, begin = np.zeros(m + 1, np.int64), place.copy()  # a stretch may begin anywhere
    for symbol in item.tolist():
        # the least of substitution, deletion and insertion, and with it where the stretch began
        step = np.r_[np.iinfo(np.int32).max, row[:-1] + (text != symbol)]
        drop = row + 1
        took = step <= drop
        new = np.where(took, step, drop)
        origin = np.where(took, np.r_[0, begin[:-1]], begin)
        falling = new - place
        least = np.minimum.accumulate(falling)
        source = np.maximum.accumulate(np.where(falling == least, place, 0))
        row, begin = least + place, origin[source]
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), end


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[Index]:
    """Indexes over all items, at most about ``block`` of them and ``BLOCK_CHARS`` at a time, by their ids and texts."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("i"), F.col("text").cast("string").alias("t")).filter(
        "t IS NOT NULL").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    parts = max(-(-size.n // block), -(-size.chars // BLOCK_CHARS))
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).orderBy("i", "t").collect()
        yield Index([(r.i, r.t) for r in own])


def _opened(index: Index, token: str) -> Index:
    """The index made ready for use, once in a worker for each content."""
    state = worker_state("decontam")
    if state.get("of") != token:
        state.update(of=token, index=index.open())
    return state["index"]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, first_word, end_word, distance, similarity), a row per document and leaked item."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, item_id bigint, first_word bigint, end_word bigint, distance bigint, similarity double")
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__llm_text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for index in item_blocks(benchmark):
        def run(batches: Iterator[pa.RecordBatch], index=index, token=content_name(index)) -> Iterator[pa.RecordBatch]:
            opened = _opened(index, token)
            for batch in slices(batches, "__llm_text", 1_000_000):
                found = opened.leaks(texts(batch.column(1)))
                flat = [(k, *x) for k, rows in enumerate(found) for x in rows]
                if flat:
                    row, item, first, end, distance = zip(*flat)
                    size = [len(opened.items[i]) for i in item]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([opened.ids[i] for i in item], pa.int64()),
                         *(pa.array(x, pa.int64()) for x in (first, end, distance)),
                         pa.array([1 - d / n for d, n in zip(distance, size)], pa.float64())],
                        [id_col, "item_id", "first_word", "end_word", "distance", "similarity"])
        out = out.unionByName(source.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that leak no item, with all their columns."""
    columns = docs.columns
    out = docs
    for index in item_blocks(benchmark):
        source, (text,) = with_inputs(out, columns, **{text_col: "string"})

        def run(batches: Iterator[pa.RecordBatch], index=index, token=content_name(index)) -> Iterator[pa.RecordBatch]:
            opened = _opened(index, token)
            for batch in slices(batches, text, 1_000_000):
                found = opened.leaks(texts(batch.column(text)))
                clean = pa.array([not x for x in found], pa.bool_())
                yield pa.RecordBatch.from_arrays(batch.columns[:len(columns)], names=columns).filter(clean)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        out = source.mapInArrow(run, kinds)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
