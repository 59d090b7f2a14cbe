"""Quality classifier by co-training (operator 5).

Two views of a document are fitted apart: its text (byte trigrams and shape)
and its metadata (source, language, length).  Over ``ROUNDS`` rounds each view,
calibrated on labels it was not fitted on, scores *all* rows outside the
labelled sample and hands those that it is most confident about to the *other*
view as pseudo-labels.  Then the two calibrated views are combined, and every row of
the table is scored.

Every text is read once for its features, which are written at half precision;
the rounds read only them.  The labelled sample is bounded: at most
``LABELLED`` rows, those with the least hashes.  A view hands on at most about
``HANDED_ON`` rows a round, the best of the whole table; equal rows count once.

Defined results: null text counts as empty, null metadata is a category of its
own; ids may be null or repeat, every row is scored by itself; an id with
several labels has the lowest of them, labels other than 0 and 1 are ignored;
without labels of both classes every score is the share of label 1 (0.5 if
there is none); an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ciphersift.llm.common import least_rows, slices, table, text_bytes, with_inputs, written

LABELLED = 6_000
ROUNDS = 4
CONFIDENT = 0.95   # calibrated probability from which a view hands on a pseudo-label
HANDED_ON = 600    # most rows that a view hands on per round, classes in proportion to the labels
TRIGRAMS = 1_024   # hash buckets of byte trigrams
SHAPE = 28
SOURCES, LANGS, LENGTHS = 256, 32, 24
CHUNK = 1 << 20    # bytes of a text whose trigrams are counted at a time


def byte_classes() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digit, 3 space, 4 line end, 5 sentence mark, 6 other ASCII, 7 beyond ASCII."""
    out = np.full(256, 6, np.uint8)
    for c, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t",
                               b"\r\n", b".,;:?'\"()-")):
        out[list(chars)] = c
    out[128:] = 7
    return out


def text_features(text: bytes) -> np.ndarray:
    """Square roots of trigram shares, then shape; over the whole text."""
    counts, kinds, classes = np.zeros(TRIGRAMS, np.int64), np.zeros(8, np.int64), byte_classes()
    for at in range(0, len(text), CHUNK):
        a = np.frombuffer(text, np.uint8, min(CHUNK + 2, len(text) - at), at).astype(np.uint32)
        kinds += np.bincount(classes[a[:CHUNK]], minlength=8)
        if len(a) > 2:
            h = (((a[:-2] << 16) | (a[1:-1] << 8) | a[2:]) * np.uint32(2654435761)) >> np.uint32(22)
            counts += np.bincount(h, minlength=TRIGRAMS)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n, often = max(1, len(words)), Counter(words).most_common(1)
    size = np.zeros(12)
    size[min(11, len(words).bit_length())] = 1
    shape = [*(kinds / max(1, len(text))), len(set(words)) / n, len(set(lines)) / max(1, len(lines)),
             np.count_nonzero(counts) / max(1.0, min(TRIGRAMS, counts.sum())), len(text) / n / 10,
             sum(map(eq, words, words[1:])) / n,          # words that repeat the word before them
             often[0][1] / n if often else 0.0,           # share of the commonest word
             len(set(zip(words, words[1:]))) / n, np.log1p(len(words)) / 10, *size]
    return np.concatenate([np.sqrt(counts / max(1, counts.sum())), shape]).clip(max=60_000).astype(np.float16).astype(np.float32)


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Places of the ones in the metadata view."""
    place = lambda x, n: n - 1 if x is None else zlib.crc32(x.encode()) % (n - 1)
    length = LENGTHS - 1 if n_chars is None or n_chars < 0 else min(LENGTHS - 2, int(n_chars).bit_length())
    return [place(source, SOURCES), SOURCES + place(lang, LANGS), SOURCES + LANGS + length]


def meta_matrix(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), SOURCES + LANGS + LENGTHS), np.float32)
    for i, places in enumerate(rows):
        out[i, places] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Logistic regression on standardised features, by Adam on the whole sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200, penalty: float = 5e-3):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        w, m, v = np.zeros(x.shape[1] + 1, x.dtype), 0.0, 0.0
        b, y = (weight / weight.sum()).astype(x.dtype), y.astype(x.dtype)
        for t in range(1, steps + 1):
            d = b * (sigmoid(z @ w[:-1] + w[-1]) - y)
            g = np.append(z.T @ d + penalty * w[:-1], d.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.03 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        self.w = np.append(w[:-1] / self.scale, w[-1] - (w[:-1] * self.mean / self.scale).sum())

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn logits into calibrated ones; targets keep off 0 and 1 by their number of rows."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps, damped
        p = sigmoid(a * z + b)
        q = p * (1 - p) + 1e-6
        g = np.array([(z * (p - target)).sum(), (p - target).sum()])
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
    return max(0.0, float(a)), float(b)


class Model:
    """Both fitted views and how they are combined."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, label: np.ndarray, handed_on=None, rounds: int = ROUNDS):
        """Rows with their labels 0 or 1, in a fixed order; every fourth calibrates.

        ``handed_on(model)`` gives for either view (text, meta, label) of the rows that it is confident about.
        """
        self.share = float(label.mean()) if len(label) else 0.5
        self.constant = not 0 < self.share < 1 or len(label) < 8
        self.handed: list[tuple[int, ...]] = []  # per round: rows of class 1 and 0 from the text, then from the metadata
        if self.constant:
            return
        known = np.arange(len(label))
        held = known[3::4]
        if len(set(label[held])) < 2:
            held = known
        base = np.setdiff1d(known, held) if len(held) < len(known) else known
        if len(set(label[base])) < 2:
            base = known
        views = (text.astype(np.float32), meta.astype(np.float32))
        own = [[(x[base], label[base].astype(float), np.ones(len(base)))] for x in views]  # what each view learns from
        for turn in range(rounds + 1):
            self.views, self.scales = [], []
            for x, learn in zip(views, own):
                self.views.append(Logistic(*map(np.concatenate, zip(*learn))))
                self.scales.append(platt(self.views[-1].logits(x[held]), label[held].astype(float)))
            if turn == rounds or handed_on is None:
                break
            given = handed_on(self)
            for k, (*rows, y) in enumerate(given):
                own[1 - k].append((rows[1 - k], y.astype(float), np.full(len(y), 0.5)))
            self.handed.append(tuple(int((y == c).sum()) for *_, y in given for c in (1, 0)))

    def calibrated(self, view: int, x: np.ndarray) -> np.ndarray:
        slope, offset = self.scales[view]
        return slope * self.views[view].logits(x) + offset

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of label 1 by both views together, by the text and by the metadata."""
        if self.constant:
            same = np.full(len(text), self.share)
            return same, same, same
        t, m = self.calibrated(0, text), self.calibrated(1, meta)
        # the views are taken as independent given the label: their log odds add, the prior counts once
        return sigmoid(t + m - np.log(self.share / (1 - self.share))), sigmoid(t), sigmoid(m)


META = ("source", "lang", "n_chars")


def _inputs(docs: DataFrame, *more: str) -> tuple[DataFrame, list[str]]:
    return with_inputs(docs, list(more), text="string", source="string", lang="string", n_chars="bigint")


def _features(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, list[list[int]]]:
    """The text view and the places of the ones in the metadata view; ``names`` of the four inputs."""
    text = np.stack([text_features(t) for t in text_bytes(batch.column(names[0]))])
    return text, [meta_features(*r) for r in zip(*(batch.column(c).to_pylist() for c in names[1:]))]


def written_features(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(o, h, x, places, y) of every row: hashes of id and content, both views, label (-1 unless its id is in the
    bounded table ``chosen(doc_id, y)``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[0], 2_000_000):
            text, places = _features(batch, names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([t.tobytes() for t in text.astype(np.float16)], pa.binary()),
                 pa.array(places, pa.list_(pa.int32()))], ["doc_id", "o", "h", "x", "places"])

    hashed = docs.select(
        "doc_id", "text", *META, F.xxhash64("doc_id").alias("o"),
        F.xxhash64(*[F.col(c).cast("string") for c in ("text", *META)]).alias("h"))
    source, names = _inputs(hashed, "doc_id", "o", "h")
    rows = source.mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, o bigint, h bigint, x binary, places array<int>")
    return written(rows.join(F.broadcast(chosen), "doc_id", "left").select("o", "h", "x", "places", F.coalesce("y", F.lit(-1)).alias("y")),
                   "quality-features")


def matrices(x: list[bytes], places: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows that were written at half precision."""
    text = np.frombuffer(b"".join(x), np.float16).reshape(len(x), TRIGRAMS + SHAPE)
    return text.astype(np.float32), meta_matrix(places)


def most_confident(model: Model, most: dict[int, int], taken: list[set[int]]):
    """Per task and (view, class): (view, y, sure, h) of the ``most`` rows with the surest scores, copies once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], dict[int, float]] = {(k, y): {} for k in (0, 1) for y in most}
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                h = batch.column(0).to_pylist()
                for k, x in enumerate(matrices(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    p = sigmoid(model.calibrated(k, x))
                    for y in most:
                        sure, kept = p if y else 1 - p, best[k, y]
                        for i in np.flatnonzero(sure >= CONFIDENT).tolist():
                            if h[i] not in taken[k]:
                                kept[h[i]] = float(sure[i])
                        if len(kept) > most[y]:
                            best[k, y] = dict(sorted(kept.items(), key=lambda r: (-r[1], r[0]))[:most[y]])
        rows = [(k, y, s, h) for (k, y), kept in best.items() for h, s in kept.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            list(zip(*rows)) or [[]] * 4, (pa.int32(), pa.int32(), pa.float64(), pa.int64()))], ["view", "y", "sure", "h"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", labelled: int = LABELLED,
        handed_on: int = HANDED_ON) -> Model:
    """Fit on at most ``labelled`` labelled rows and all others of ``docs``, with (doc_id, label) in ``labels``.

    The ids of the sample are chosen by a join of ids alone; only this bounded table meets the features.
    """
    known = (labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.min(label_col).cast("int").alias("y")))
    chosen = (docs.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
              .limit(labelled))
    rows = written_features(docs, chosen)
    others = rows.filter("y < 0").select("h", "x", "places")
    sample = sorted(least_rows(rows.filter("y >= 0"), ["o", "h"], labelled).collect(), key=lambda r: (r.o, r.h))
    taken: list[set[int]] = [set(), set()]

    def best_of_all(model: Model) -> list[tuple[np.ndarray, ...]]:
        most = {1: int(handed_on * model.share) + 1, 0: int(handed_on * (1 - model.share)) + 1}
        found = written(others.mapInArrow(most_confident(model, most, taken), "view int, y int, sure double, h bigint"),
                        "quality-handed-on")
        given = {(k, y): [r.h for r in found.filter(f"view = {k} AND y = {y}").groupBy("h").agg(F.max("sure").alias("sure"))
                          .orderBy(F.desc("sure"), "h").limit(most[y]).collect()] for k in (0, 1) for y in most}
        wanted = {h for chosen in given.values() for h in chosen}
        ids = docs.sparkSession.createDataFrame([(h,) for h in sorted(wanted)], "h bigint")
        got = {r.h: r for r in others.join(F.broadcast(ids), "h").dropDuplicates(["h"]).collect()}  # bounded by ``most``
        out = []
        for k in (0, 1):
            chosen = [(got[h], y) for y in most for h in given[k, y]]
            taken[k].update(r.h for r, _ in chosen)
            out.append((*matrices([r.x for r, _ in chosen], [r.places for r, _ in chosen]), np.array([y for _, y in chosen], int)))
        return out

    text, meta = matrices([r.x for r in sample], [r.places for r in sample])
    return Model(text, meta, np.array([r.y for r in sample], int), best_of_all)


def score_quality(docs: DataFrame, model: Model, *keep: str, prefix: str = "") -> DataFrame:
    """(*keep, score, text_score, meta_score, predicted) of every row of ``docs``; ``prefix`` goes before new names."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    names = [prefix + x for x in ("score", "text_score", "meta_score", "predicted")]
    source, inputs = _inputs(docs, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, inputs[0], 2_000_000):
            text, places = _features(batch, inputs)
            p, t, m = model.score(text, meta_matrix(places))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], *(pa.array(x, pa.float64()) for x in (p, t, m)),
                 pa.array((p >= 0.5).astype(np.int32))], [*keep, *names])

    return source.mapInArrow(
        run, kinds + "".join(f", `{n}` {k}" for n, k in zip(names, ("double", "double", "double", "int"))))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, with all their columns."""
    scored = score_quality(docs, fit(docs, labels), *docs.columns, prefix="__llm_")
    return scored.filter("__llm_predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_quality(docs, fit(docs, labels), "doc_id")
