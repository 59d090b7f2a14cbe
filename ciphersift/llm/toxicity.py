"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 7).

A text is cut into words (lower case, at ASCII marks and white space) and into
overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, that cover all of it.
A word enters by a word vector and by the maximum over the vectors of its
character 3-, 5- and 7-grams with word ends.  Two gated recurrent passes read a
window, attention pools their states, and a text's score is that of its most
toxic window, calibrated on labelled texts that the network was not fitted on.

The network is trained in numpy on a bounded sample: at most ``SAMPLE`` labelled
texts of each class, those with the least hashes of their ids, and of each of
them the two windows with the strongest evidence and one chosen by hash.  Scoring
covers all windows of all texts.  The text is the only input.

Defined results: null and empty texts have one empty window and a score; ids
may be null or repeat, every row is scored by itself; an id with several labels
has the highest; labels other than 0 and 1 are ignored; without training labels
of both classes every score is the share of label 1 (0 if there is none); an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ciphersift.llm.common import least_rows, content_name, crc_split, slices, table, texts, with_inputs, worker_state, written

SAMPLE = 3_000         # labelled texts of each class at most
WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS = 1 << 13, 1 << 15
GRAMS = (3, 5, 7)
WIDTH, HIDDEN, ATTEND = 8, 8, 8
EPOCHS, BATCH = 8, 128
CACHE_SIZE = 200_000   # words whose inputs a worker keeps
AT_ONCE = 2_048        # windows that are scored together
FOLDS = 5              # doc_id remainder 0 is held out of all fitting

SEPARATORS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(SEPARATORS).split()


def grams_of(word: bytes) -> list[int]:
    """Rows of a word's character n-grams; its ends count as characters."""
    w = b"^" + word + b"$"
    n = len(w)
    return [zlib.crc32(w[i:i + k]) % GRAM_ROWS for k in GRAMS for i in range(n - k + 1)]


def word_row(word: bytes) -> int:
    return zlib.crc32(word) % WORD_ROWS


def window_starts(n: int) -> range:
    """Starts of the windows over ``n`` words; the last one reaches the end."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, scoring and one training step."""

    def __init__(self, evidence_words: np.ndarray, evidence_grams: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        small = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {
            "words": rng.normal(0, 0.1, (WORD_ROWS, WIDTH)).astype(np.float32),
            "grams": rng.normal(0, 0.1, (GRAM_ROWS, WIDTH)).astype(np.float32),
            "in": small(2 * WIDTH, 6 * HIDDEN), "in_b": np.zeros(6 * HIDDEN, np.float32),
            "rec": np.stack([small(HIDDEN, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN)]),
            "att": small(2 * HIDDEN, ATTEND), "att_b": np.zeros(ATTEND, np.float32), "att_v": small(ATTEND, 1)[:, 0],
            "out": small(2 * HIDDEN, 1)[:, 0], "out_b": np.zeros(1, np.float32),
        }
        # one coordinate starts as the evidence of a word or gram for label 1
        self.p["words"][:, 0], self.p["grams"][:, 0] = evidence_words, evidence_grams
        self.scale = (1.0, 0.0)

    # --- inputs of distinct words ---------------------------------------------------------------------------

    def word_inputs(self, rows: np.ndarray, grams: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, flat gram rows, winner of each coordinate among the flat grams) of distinct words."""
        flat = np.fromiter((g for x in grams for g in x), np.int64)
        starts = np.cumsum([0, *map(len, grams[:-1])])
        vectors = self.p["grams"][flat]
        top = np.maximum.reduceat(vectors, starts, axis=0)
        return np.concatenate([self.p["words"][rows], top], 1), flat, starts

    def projected(self, words: list[bytes]) -> np.ndarray:
        x, _, _ = self.word_inputs(np.array([word_row(w) for w in words]), [grams_of(w) for w in words])
        return x @ self.p["in"] + self.p["in_b"]

    # --- network --------------------------------------------------------------------------------------------

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows: ``x`` [time, window, 6 * HIDDEN], ``mask`` [time, window]."""
        steps, n, _ = x.shape
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        h3 = 3 * HIDDEN
        for way in (0, 1):
            h, rec = np.zeros((n, HIDDEN), np.float32), self.p["rec"][way]
            xs = x[:, :, way * h3:(way + 1) * h3]
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                u = h @ rec
                gate = sigmoid(xs[t, :, :2 * HIDDEN] + u[:, :2 * HIDDEN])
                z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
                new = np.tanh(xs[t, :, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
                here = mask[t][:, None]
                after = np.where(here, new + z * (h - new), h)
                if keep is not None:
                    keep.append((way, t, h, u, z, r, new))
                states[t, :, way * HIDDEN:(way + 1) * HIDDEN] = after
                h = after
        act = np.tanh(states @ self.p["att"] + self.p["att_b"])
        weight = np.where(mask, act @ self.p["att_v"], np.float32(-1e9))
        weight = np.exp(weight - weight.max(0)) * mask
        weight /= np.maximum(weight.sum(0), np.float32(1e-9))
        pooled = (weight[:, :, None] * states).sum(0)
        if keep is not None:
            keep.append((states, act, weight, pooled))
        return pooled @ self.p["out"] + self.p["out_b"]

    def backward(self, x: np.ndarray, mask: np.ndarray, keep: list, d: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind the inputs, and of the inputs, from those of the logits."""
        states, act, weight, pooled = keep.pop()
        g = {k: np.zeros_like(self.p[k]) for k in ("rec", "att", "att_b", "att_v", "out", "out_b")}
        g["out"], g["out_b"] = pooled.T @ d, d.sum(keepdims=True)
        dpool = d[:, None] * self.p["out"]
        dstates = weight[:, :, None] * dpool
        dweight = (states * dpool).sum(2)
        dlogit = weight * (dweight - (weight * dweight).sum(0))
        g["att_v"] = np.einsum("tn,tna->a", dlogit, act)
        dact = dlogit[:, :, None] * self.p["att_v"] * (1 - act * act)
        g["att"], g["att_b"] = np.einsum("tns,tna->sa", states, dact), dact.sum((0, 1))
        dstates += dact @ self.p["att"].T
        dx, h3, H = np.zeros_like(x), 3 * HIDDEN, HIDDEN
        dh = None
        for way, t, h, u, z, r, new in reversed(keep):
            if dh is None or (way == 0 and t == len(x) - 1):
                dh = np.zeros_like(h)
            dafter = dh + dstates[t, :, way * H:(way + 1) * H]
            here = mask[t][:, None]
            dnow = np.where(here, dafter, 0)
            dz = dnow * (h - new) * z * (1 - z)
            da = dnow * (1 - z) * (1 - new * new)
            dr = da * u[:, 2 * H:] * r * (1 - r)
            du = np.concatenate([dz, dr, da * r], 1)
            g["rec"][way] += h.T @ du
            dx[t, :, way * h3:(way + 1) * h3] = np.concatenate([dz, dr, da], 1)
            dh = np.where(here, dnow * z, dafter) + du @ self.p["rec"][way].T
        return g, dx

    def train(self, windows: list[list[bytes]], label: np.ndarray, weight: np.ndarray, seed: int = 7) -> None:
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for x in windows for w in x))}
        rows = np.array([word_row(w) for w in vocabulary])
        grams = [grams_of(w) for w in vocabulary]
        at = np.zeros((len(windows), WINDOW), np.int64)
        mask = np.zeros((len(windows), WINDOW), bool)
        for i, x in enumerate(windows):
            at[i, :len(x)], mask[i, :len(x)] = [vocabulary[w] for w in x], True
        rng, moments, step = np.random.default_rng(seed), {}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(windows))
            rate = 0.01 * (1 - epoch / EPOCHS)
            for start in range(0, len(order), BATCH):
                own = order[start:start + BATCH]
                used, inverse = np.unique(at[own], return_inverse=True)
                inputs, flat, starts = self.word_inputs(rows[used], [grams[i] for i in used])
                proj = inputs @ self.p["in"] + self.p["in_b"]
                places = inverse.reshape(len(own), WINDOW).T
                x, m, keep = proj[places], mask[own].T, []
                logit = self.forward(x, m, keep)
                d = ((sigmoid(logit) - label[own]) * weight[own] / weight[own].sum()).astype(np.float32)
                g, dx = self.backward(x, m, keep, d)
                dproj = np.zeros_like(proj)
                np.add.at(dproj, places.ravel(), dx.reshape(-1, 6 * HIDDEN))
                g["in"], g["in_b"] = inputs.T @ dproj, dproj.sum(0)
                dinputs = dproj @ self.p["in"].T
                step += 1
                for k, grad in g.items():  # Adam
                    a, b = moments.get(k, (0.0, 0.0))
                    a, b = 0.9 * a + 0.1 * grad, 0.99 * b + 0.01 * grad * grad
                    moments[k] = (a, b)
                    self.p[k] -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
                for k, ids, grad in (("words", rows[used], dinputs[:, :WIDTH]), self._gram_gradient(flat, starts, inputs, dinputs)):
                    total = moments.setdefault(k, np.full(self.p[k].shape, 1e-6, np.float32))  # Adagrad
                    np.add.at(total, ids, grad * grad)
                    np.add.at(self.p[k], ids, -0.05 * grad / np.sqrt(total[ids]))

    def _gram_gradient(self, flat, starts, inputs, dinputs):
        """Each coordinate's gradient goes to the gram that is its maximum."""
        size = np.diff(np.r_[starts, len(flat)])
        owner = np.repeat(np.arange(len(starts)), size)
        won = self.p["grams"][flat] == inputs[owner, WIDTH:]
        some = won.any(1)
        return "grams", flat[some], (dinputs[owner[some], WIDTH:] * won[some]).astype(np.float32)


class Scorer:
    """Window scores with a bounded cache of the projected words."""

    def __init__(self, net: Network):
        self.net, self.index = net, {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def places(self, lists: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.index) > CACHE_SIZE:
            self.index.clear()
            self.table = self.table[:1]
        new = list(dict.fromkeys(w for x in lists for w in x if w not in self.index))
        if new:
            self.index.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, *(self.net.projected(new[i:i + 20_000])
                                                       for i in range(0, len(new), 20_000))])
        return [np.fromiter(map(self.index.__getitem__, x), np.int64, len(x)) for x in lists]

    def window_logits(self, at: np.ndarray) -> np.ndarray:
        """``at`` [window, time]: rows of the word table, 0 for none."""
        out = [self.net.forward(self.table[at[i:i + AT_ONCE].T], at[i:i + AT_ONCE].T > 0)
               for i in range(0, len(at), AT_ONCE)]
        return np.concatenate(out)

    def text_logits(self, rows: list[str]) -> np.ndarray:
        """The greatest window logit of each text."""
        ids = self.places([words_of(t) for t in rows])
        cut, first = [], []
        for x in ids:
            n = len(window_starts(len(x)))
            padded = np.zeros((n + 1) * STRIDE, np.int64) if STRIDE * 2 == WINDOW else np.zeros((n - 1) * STRIDE + WINDOW, np.int64)
            padded[:len(x)] = x
            first.append(n)
            cut.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
        logits = self.window_logits(np.concatenate(cut))
        return np.maximum.reduceat(logits, np.cumsum([0, *first[:-1]]))


def evidence(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """How much more often label 1 has a feature, in standard errors, scaled and bounded."""
    p = (pos + neg + 1) / (n_pos + n_neg + 2)
    z = (pos / max(1, n_pos) - neg / max(1, n_neg)) / np.sqrt(p * (1 - p) * (1 / max(1, n_pos) + 1 / max(1, n_neg)))
    return np.clip(z / 6, -2, 3).astype(np.float32)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, label 1 texts, label 0 texts): in how many texts each word and gram row occurs."""
    counts = np.zeros((2, WORD_ROWS + GRAM_ROWS), np.int64)
    for batch in batches:
        for text, y in zip(texts(batch.column(1)), batch.column(2).to_pylist()):
            words = set(words_of(text))
            at = {word_row(w) for w in words} | {WORD_ROWS + g for w in words for g in grams_of(w)}
            counts[y, list(at)] += 1
    seen = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1][seen]), pa.array(counts[0][seen])],
                                     ["f", "pos", "neg"])


def _windows_of(words_evidence: np.ndarray, grams_evidence: np.ndarray):
    """Three windows of each text: the two with the strongest evidence and one by hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in texts(batch.column(1)):
                words = words_of(text)
                worth = np.array([max(words_evidence[word_row(w)], *grams_evidence[grams_of(w)]) for w in words] or [0.0])
                starts = list(window_starts(len(words)))
                best = sorted(starts, key=lambda s: -(worth[s:s + WINDOW] ** 3 * (worth[s:s + WINDOW] > 0)).sum())[:2]
                best += [starts[zlib.crc32(text.encode()) % len(starts)]]
                out.append([b" ".join(words[s:s + WINDOW]) for s in best])
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(2), pa.array(out, pa.list_(pa.binary()))],
                                             ["o", "y", "windows"])
    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """The trained network, or the one score of every text where the labels do not allow one."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder != 0))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).withColumn("o", F.xxhash64("doc_id")))
    chosen = (known.filter("y = 1").orderBy("o", "doc_id").limit(sample)
              .union(known.filter("y = 0").orderBy("o", "doc_id").limit(sample)))
    # a bounded number of ids: safe to broadcast; ids may repeat, so the rows are bounded too, then written and read
    # three times
    found = written(docs.select("doc_id", F.col("text").cast("string").alias("t")).join(F.broadcast(chosen), "doc_id")
                    .select("doc_id", "t", "y", "o", F.xxhash64("t").alias("h")), "toxicity-found")
    rows = written(least_rows(found.filter("y = 1"), ["o", "h"], sample).union(
        least_rows(found.filter("y = 0"), ["o", "h"], sample)).select("doc_id", "t", "y", "o"), "toxicity-sample")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        return float(n_pos > 0)
    counted = (rows.mapInArrow(_count_features, "f bigint, pos bigint, neg bigint").groupBy("f")
               .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas())
    pos, neg = np.zeros(WORD_ROWS + GRAM_ROWS), np.zeros(WORD_ROWS + GRAM_ROWS)
    pos[counted.f], neg[counted.f] = counted.pos, counted.neg
    strength = evidence(pos, neg, n_pos, n_neg)
    net = Network(strength[:WORD_ROWS], strength[WORD_ROWS:])
    got = rows.mapInArrow(_windows_of(strength[:WORD_ROWS], strength[WORD_ROWS:]),
                          "o bigint, y int, windows array<binary>").collect()
    got.sort(key=lambda r: (r.o, bytes(r.windows[0])))
    fitted = [r for r in got if r.o % FOLDS != 1] or got
    windows, label = [], []
    for r in fitted:
        for k, w in enumerate(r.windows):
            if r.y == 1 and k:
                continue  # only the strongest window is known to be meant by the label
            windows.append(bytes(w).split())
            label.append(r.y)
    label = np.array(label, np.float32)
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())).astype(np.float32)
    net.train(windows, label, weight * len(label))
    scored = logits(rows, net, "doc_id", "o", "y", text_col="t").collect()
    held = [r for r in scored if r.o % FOLDS == 1]
    if len({r.y for r in held}) < 2:
        held = scored
    net.scale = calibration(np.array([r.logit for r in held]), np.array([r.y for r in held], float), n_pos, n_neg, known)
    return net


def calibration(z: np.ndarray, y: np.ndarray, n_pos: int, n_neg: int, known: DataFrame) -> tuple[float, float]:
    """Slope and offset of the logits; rows weigh as much as their class does among all labels."""
    share = known.agg(F.avg("y")).first()[0]
    weight = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = sigmoid(np.clip(a * z + b, -30, 30))
        q = weight * (p * (1 - p) + 1e-6)
        g = np.array([(weight * z * (p - target)).sum() + 1e-3 * a, (weight * (p - target)).sum()])
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
    return max(1e-3, float(a)), float(b)


def logits(docs: DataFrame, net: Network, *keep: str, text_col: str = "text", name: str = "logit") -> DataFrame:
    """(*keep, logit) of every row of ``docs``."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    token = content_name(net)
    source, (text,) = with_inputs(docs, list(keep), **{text_col: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("toxicity")
        if state.get("of") != token:
            state.update(of=token, scorer=Scorer(net))
        for batch in slices(batches, text, 1_000_000):
            z = state["scorer"].text_logits(texts(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(z.astype(np.float64))], [*keep, name])

    return source.mapInArrow(run, f"{kinds}, `{name}` double")


def score_toxicity(docs: DataFrame, net: Network | float, *keep: str, name: str = "score") -> DataFrame:
    """(*keep, score) of every row of ``docs``; the score is between 0 and 1, higher for label 1."""
    if isinstance(net, float):
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(net).alias(name))
    slope, offset = net.scale
    return logits(docs, net, *keep, name=name).withColumn(name, 1 / (1 + F.exp(-(slope * F.col(name) + offset))))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not found toxic, with all their columns."""
    scored = score_toxicity(docs, fit(docs, labels), *docs.columns, name="__llm_score")
    return scored.filter("__llm_score < 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    return score_toxicity(docs, fit(docs, labels), "doc_id").select(
        "doc_id", F.coalesce(held_out, F.lit(crc_split(None, FOLDS) == 0)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
