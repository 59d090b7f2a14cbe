"""Sampling distinct SentencePiece segmentations, and decoding (operator 1).

The segmentations of a text are the paths of its lattice of pieces.  Gumbel
top-k without replacement draws the ``k`` paths with the largest perturbed log
probabilities, by an A-star search from the front of the lattice: an open node
is a path prefix with the set of pieces that may follow, its bound is the exact
maximum of the perturbed scores below it, drawn top-down (the child with the
maximum inherits its parent's score, the others' scores are Gumbel variables cut
off at it).  Always opening the node with the largest bound yields the paths in
descending order, and since bounds are exact, none is opened in vain.  The
completions of a prefix are summed exactly by the backward pass over the
lattice, so a prefix's probability needs no search.

Random numbers are hashes of the row's key, the sample, the word and the step:
the result does not depend on how rows are spread over tasks.

Pieces never cross a word's front mark, so the lattice of a text is a chain of
word lattices.  Each worker keeps those of recent words in flat arrays, and all
words of a batch take their steps together.

Pieces of a model whose scores are merge ranks get log probabilities by Zipf's
law over the rank; other models' scores are log probabilities already.
Characters without a piece of their own are spelled in byte pieces.

Defined results: null and empty texts have one segmentation, without pieces;
a text with fewer than ``k`` segmentations has all of them, each with inclusion
probability one; null keys hash like the empty key; rows with one key and one
text get equal samples; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ciphersift.llm.common import read_bytes, slices, table, texts, tokenizer_file, worker_state

SAMPLES = 2
ZIPF_OFFSET = 10.0      # log p(piece of rank r) = -log(r + ZIPF_OFFSET) + constant
CACHED_EDGES = 3_000_000
FRONT = 64              # steps that bound how far a path is searched for open nodes
AT_ONCE = 3_000         # new words whose lattices are built together
NO_CHAR = np.uint64(1 << 32)
MARK = "▁"
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
ALL_BITS = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers (splitmix)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_one(x: int) -> int:
    """:func:`mix` of one number."""
    x = (x + 0x9E3779B97F4A7C15) & ALL_BITS
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL_BITS
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL_BITS
    return x ^ (x >> 31)


def mixed(*parts) -> np.ndarray:
    """One hash per row of the broadcast integer parts."""
    x = 0
    with np.errstate(over="ignore"):
        for p in parts:
            if isinstance(x, int) and isinstance(p, int):
                x = mix_one((p ^ (x * 3)) & ALL_BITS)
            else:
                last = np.uint64((x * 3) & ALL_BITS) if isinstance(x, int) else x * np.uint64(3)
                x = mix(np.asarray(p, np.uint64) ^ last)
    return x


def unit_interval(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1, in steps of 2^-52."""
    if isinstance(x, int):
        return ((x >> 12) + 0.5) / float(1 << 52)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def uniform(*parts) -> np.ndarray:
    return unit_interval(mixed(*parts))


class Pieces:
    """Vocabulary of a SentencePiece model: prefixes, log probabilities, bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        scores = np.array([self.library.get_score(i) for i in range(n)])
        byte = [self.library.is_byte(i) for i in range(n)]
        normal = [i for i in range(n) if not (byte[i] or self.library.is_control(i) or self.library.is_unknown(i)
                                              or self.library.is_unused(i))]
        ranked = bool((scores[normal] <= 0).all() and (scores[normal] == np.round(scores[normal])).all())
        if ranked:
            order = np.array(normal)[np.argsort(-scores[normal], kind="stable")]
            weight = np.zeros(n)
            weight[order] = 1 / (np.arange(len(order)) + 1 + ZIPF_OFFSET)
            last = weight[order[-1]] if len(order) else 1.0
            log_p = np.log(np.maximum(weight, 1e-300) / weight.sum())
            self.byte_log_p = float(np.log(last / weight.sum()))
        else:
            log_p, self.byte_log_p = scores, float(scores[normal].min()) - 1
        self.log_p = log_p
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if byte[i]:
                self.byte_id[int(names[i][3:5], 16)] = i
        self.bytes_of = [bytes([int(x[3:5], 16)]) if byte[i] else b"" if self.library.is_control(i)
                         else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        self.n_bytes = np.array(list(map(len, self.bytes_of)), np.int64)
        self.byte_at = np.cumsum(self.n_bytes) - self.n_bytes
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        crossing = any(MARK in x.lstrip(MARK) for x in (names[i] for i in normal))
        self.units = (lambda s: [s] if s else []) if crossing else self._units
        self.prefixed = self.library.normalize("a").startswith(MARK)
        found: dict[int, int] = {}
        self.longest = max(len(names[i]) for i in normal)
        for i in normal:
            h = 0
            for c in names[i]:
                h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                found.setdefault(h, -1)
            found[h] = i
        self.hashes = np.array(sorted(found), np.uint64)
        self.piece_at = np.array([found[int(h)] for h in self.hashes], np.int64)
        # a prefix stands in the first free slot from its own on
        self.slot_bits = (8 * len(found)).bit_length()
        self.slots = np.full(1 << self.slot_bits, -1, np.int32)
        left = np.arange(len(found), dtype=np.int32)
        slot = self.slot_of(self.hashes)
        while len(left):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = left[free]
            out = self.slots[slot] != left
            left, slot = left[out], (slot[out] + 1) & (len(self.slots) - 1)

    def slot_of(self, h: np.ndarray) -> np.ndarray:
        return ((h * BASE) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in ``hashes``, -1 for what is no prefix of a piece."""
        slot = self.slot_of(h)
        at = self.slots[slot]
        other = np.flatnonzero((at >= 0) & (self.hashes[at] != h))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.slots) - 1)
            at[other] = found = self.slots[slot[other]]
            other = other[(found >= 0) & (self.hashes[found] != h[other])]
        return at

    @staticmethod
    def _units(text: str) -> list[str]:
        if MARK + MARK in text:
            return UNITS.findall(text)
        if " " in text:
            first, *rest = text.split(MARK)
            return [first, *(MARK + x for x in rest)] if first else [MARK + x for x in rest]
        units = text.replace(MARK, " " + MARK).split(" ")
        return units if units[0] else units[1:]

    def decode(self, ids: list[int]) -> str:
        """The text that piece ids spell, without the mark that stands before every text."""
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """Texts of runs of ``size`` ids each."""
        length = self.n_bytes[ids]
        ends = np.cumsum(length)
        place = np.arange(int(length.sum())) + np.repeat(self.byte_at[ids] - ends + length, length)
        line = self.all_bytes[place].tobytes()
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])].tolist()
        texts_ = [line[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]
        return [t[1:] if self.prefixed and t.startswith(" ") else t for t in texts_]


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for; ``new`` lists those since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        n = self[key] = len(self)
        return n


class Lattices:
    """Word lattices in flat arrays: an edge's key is its node plus the running sum of its node's probabilities."""

    KINDS = {"key": np.float64, "step": np.int16, "piece": np.int32, "log_q": np.float32, "log_rest": np.float32}

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()
        self.first = np.zeros(1 << 16, np.int64)  # a word's first node
        self.at = np.zeros(1 << 16, np.int64)     # a node's first edge
        self.left = np.zeros(1 << 16, np.int32)   # nodes from a node to its word's end
        for name, kind in self.KINDS.items():
            setattr(self, name, np.zeros(1 << 16, kind))

    def clear(self) -> None:
        """Forget all words; the arrays are filled anew."""
        self.words = Numbers()
        self.n_words = self.n_nodes = self.n_edges = 0

    def need(self, units: list[str]) -> np.ndarray:
        """First nodes of these words, whose lattices are built where they are not there."""
        if self.n_edges > CACHED_EDGES or self.n_words < len(self.words):  # too many, or some were not built
            self.clear()
        at = np.fromiter(map(self.words.__getitem__, units), np.int64, len(units))
        new, self.words.new = self.words.new, []
        for i in range(0, len(new), AT_ONCE):
            self.build(new[i:i + AT_ONCE])
        return self.first.take(at)

    def put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values into an array that grows by a quarter when it is full."""
        array = getattr(self, name)
        if at + len(values) > len(array):
            array = np.concatenate([array[:at], np.zeros(at // 4 + 2 * len(values), array.dtype)])
            setattr(self, name, array)
        array[at:at + len(values)] = values

    def build(self, units: list[str]) -> None:
        """Edges of new words with the probability of each given its node, by a backward pass."""
        p, top = self.pieces, self.pieces.longest
        size = np.fromiter(map(len, units), np.int64, len(units))
        # every word has an end node of its own, whose character is in no piece
        stop = np.cumsum(size + 1) - 1
        chars = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        chars[stop] = NO_CHAR
        nodes = len(chars)
        to_end = np.repeat(stop, size + 1) - np.arange(nodes)  # characters from a node to its word's end
        # edges by piece length
        found: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
        inner = alive = np.flatnonzero(to_end)
        h = np.zeros(len(alive), np.uint64)
        lacks = to_end > 0
        with np.errstate(over="ignore"):
            for n in range(1, top + 1):
                h *= BASE
                h += chars.take(alive + (n - 1))
                h += np.uint64(1)
                at = p.find(h)
                known = np.flatnonzero(at >= 0)
                if not len(known):
                    break
                alive, h = alive.take(known), h.take(known)
                piece = p.piece_at.take(at.take(known))
                whole = np.flatnonzero(piece >= 0)
                ids = piece.take(whole)
                found.append((alive.take(whole), n, ids, p.log_p.take(ids)))
                if n == 1:
                    lacks[found[-1][0]] = False
        lacks = np.flatnonzero(lacks)  # characters without a piece: one edge that spells their bytes
        code = chars[lacks].astype(np.int64)
        found.insert(0, (lacks, 1, np.where(code < 0x80, p.byte_id[np.minimum(code, 0xFF)], p.size + code),
                         p.byte_log_p * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))
        # laid out by node, the nodes from the words' ends to their fronts, a node's longest piece first
        degree = np.bincount(np.concatenate([rows for rows, *_ in found]), minlength=nodes)
        far = to_end.take(inner)
        order = inner.take(np.argsort(far.astype(np.uint16) if size.max() < 1 << 16 else far, kind="stable"))
        own = degree.take(order)
        ends = np.cumsum(own)
        begin, total = ends - own, int(own.sum())
        free = np.zeros(nodes, np.int64)
        free[order] = begin
        head = free.copy()
        step, piece, log_p = np.zeros(total, np.int64), np.zeros(total, np.int32), np.zeros(total)
        for rows, n, *values in reversed(found):
            at = free.take(rows)
            step[at], piece[at], log_p[at] = n, *values
            free[rows] = at + 1
        rank = np.repeat(np.arange(len(order)), own)
        src = order.take(rank)
        target = src + step
        beta, most, whole, log_q = np.zeros(nodes), np.zeros(len(order)), np.zeros(len(order)), np.zeros(total)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(to_end.take(order))) + 1, [len(order)]]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            at = slice(int(begin[a]), int(ends[b - 1]))
            first, owner = begin[a:b] - at.start, rank[at]
            summed = beta.take(target[at])
            summed += log_p[at]
            np.maximum.reduceat(summed, first, out=most[a:b])
            shifted = summed - most.take(owner)
            np.add(most[a:b], np.log(np.add.reduceat(np.exp(shifted, out=shifted), first)), out=whole[a:b])
            beta[order[a:b]] = whole[a:b]
            np.subtract(summed, whole.take(owner), out=log_q[at])
        np.minimum(log_q, 0.0, out=log_q)
        running = np.concatenate([[0.0], np.cumsum(np.exp(log_q))])
        share = np.minimum(running[1:] - running.take(begin).take(rank), 1.0)
        share[ends - 1] = 1.0
        only = begin.compress(own == 1)
        log_q[only] = 0.0
        log_rest = np.minimum(log_q, -1e-15)
        np.expm1(log_rest, out=log_rest)
        np.log(np.negative(log_rest, out=log_rest), out=log_rest)
        log_rest[only] = -np.inf
        self.put("first", self.n_words, self.n_nodes + stop - size)
        self.put("at", self.n_nodes, self.n_edges + head)
        self.put("left", self.n_nodes, to_end)
        for name, values in (("key", (self.n_nodes + src) + share), ("step", step),
                             ("piece", piece), ("log_q", log_q), ("log_rest", log_rest)):
            self.put(name, self.n_edges, values)
        self.n_words += len(units)
        self.n_edges += total
        self.n_nodes += nodes

    def node_of(self, edge: int) -> int:
        return int(np.ceil(self.key[edge])) - 1

    def edges_of(self, node: int) -> tuple[int, int]:
        a = b = int(self.at[node])
        while self.key[b] < node + 1:
            b += 1
        return a, b + 1

    def descend(self, node: np.ndarray, end: np.ndarray, seed: np.ndarray, sample: int,
                unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a completion of each word from its node; (edges, owner), in order."""
        edges, owners = [], []
        left, step = np.flatnonzero(node != end), 0
        at, base = node[left], mixed(seed[left], sample, unit[left])
        while len(left):
            u = np.minimum(unit_interval(mix(base + np.uint64(step))), 1 - 1e-9) + at
            e = self.at[at]
            seek = np.flatnonzero(self.key[e] <= u)
            while len(seek):
                e[seek] += 1
                seek = seek[self.key[e[seek]] <= u[seek]]
            edges.append(e)
            owners.append(left)
            at = at + self.step[e]
            more = at != end[left]
            left, at, base, step = left[more], at[more], base[more], step + 1
        if not edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(edges)[order], owner[order]


class Path:
    """A drawn segmentation and the open nodes beside it that can still be among the next ``k``."""

    __slots__ = ("edges", "unit", "before", "steps", "where", "bound", "score")

    def __init__(self, lattices: Lattices, edges, unit, score: float, fresh: int, k: int):
        """``fresh``: steps before it are shared with an older path, which keeps the open nodes there."""
        self.edges, self.unit, self.score = edges, unit, score
        self.before = np.zeros(len(edges) + 1, np.float32)
        np.cumsum(lattices.log_q[edges], out=self.before[1:])
        near = len(edges)
        if near - fresh > FRONT + k:
            # a node's place is no higher than what stands before it: those behind ``near`` are too low for the check below
            where = self.before[fresh:fresh + FRONT + k] + lattices.log_rest[edges[fresh:fresh + FRONT + k]]
            where_k = np.partition(where, FRONT - 2)[FRONT - 2]
            near = int(np.searchsorted(-self.before[:-1], 42.0 - where_k, "right"))
        where = self.before[fresh:near] + lattices.log_rest[edges[fresh:near]]
        if len(where) > k + 1:
            # uniforms of 53 bits give Gumbel variables between -3.7 and 36.8, so these nodes hold the k + 2 best
            where_k = np.partition(where, len(where) - k - 2)[len(where) - k - 2]
            self.steps = np.flatnonzero((where > -np.inf) & (where >= where_k - 41.0))
        else:
            self.steps = np.flatnonzero(where > -np.inf)
        self.where = where[self.steps]
        self.steps += fresh

    @staticmethod
    def draw_bounds(paths: list[Path], seeds: np.ndarray, sample: int) -> None:
        """Draw the bounds of all these new paths' open nodes together."""
        size = np.fromiter((len(x.steps) for x in paths), np.int64, len(paths))
        score = np.repeat(np.array([x.score for x in paths]), size)
        u = uniform(np.repeat(seeds, size), sample, 1 << 40, np.concatenate([x.steps for x in paths]))
        bound = cut_off(np.concatenate([x.where for x in paths]), score, u)
        for path, a, b in zip(paths, (np.cumsum(size) - size).tolist(), np.cumsum(size).tolist()):
            path.bound, path.where = bound[a:b], None


def cut_off(where: np.ndarray, score: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``where``, cut off at ``score``."""
    return -np.logaddexp(-score, np.log(-np.log(u)) - where)


class Search:
    """The A-star search of one text."""

    def __init__(self, path: Path, seed: int):
        self.paths, self.seed = [path], seed
        self.opened: dict[tuple[int, int], list[int]] = {}  # (path, step): edges taken there, the path's own first
        self.rest: list[tuple[float, int, int]] = []        # bounds of opened nodes without what was taken

    def best(self) -> tuple[float, int, int] | None:
        """(bound, path, step) of the best open node."""
        found = max(self.rest, default=None)
        for k, path in enumerate(self.paths):
            if len(path.bound):
                t = int(np.argmax(path.bound))
                if path.bound[t] > -np.inf and (found is None or path.bound[t] > found[0]):
                    found = (float(path.bound[t]), k, int(path.steps[t]))
        return found

    def branch(self, lattices: Lattices, sample: int) -> tuple[float, int, int, int] | None:
        """Open the best node: (score, path, step, edge); the child with the maximum is drawn from the rest."""
        node = self.best()
        if node is None:
            return None
        score, k, t = node
        path = self.paths[k]
        if node in self.rest:
            self.rest.remove(node)
        else:
            path.bound[np.searchsorted(path.steps, t)] = -np.inf
        taken = self.opened.setdefault((k, t), [int(path.edges[t])])
        a, b = lattices.edges_of(lattices.node_of(taken[0]))
        q = np.exp(lattices.log_q[a:b].astype(np.float64))
        q[np.array(taken) - a] = 0.0
        running = np.cumsum(q)
        u = uniform(self.seed, sample, 1 << 41, t)
        edge = a + int(np.searchsorted(running, u * running[-1], "right"))
        edge = min(edge, a + int(np.flatnonzero(q)[-1]))
        taken.append(edge)
        q[edge - a] = 0.0
        if (q > 0).any():
            where = np.array([path.before[t] + np.log(q.sum())])
            bound = cut_off(where, score, uniform(self.seed, sample, 1 << 42, t))
            self.rest.append((float(bound[0]), k, t))
        return score, k, t, edge


class Sampler:
    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.lattices = Lattices(self.pieces)

    def sample(self, rows: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Per text, up to ``k`` of (ids, log probability, perturbed score, log inclusion probability)."""
        lat = self.lattices
        units = [self.pieces.units(x) for x in self.pieces.library.normalize(rows)] if rows else []
        words = list(chain.from_iterable(units))
        first = lat.need(words)
        size = np.fromiter(map(len, units), np.int64, len(units))
        end = first + lat.left[first]
        offset = np.r_[0, np.cumsum(size)]
        place = np.arange(len(first)) - np.repeat(offset[:-1], size)
        edges, owner = lat.descend(first, end, np.repeat(seeds, size), 0, place)
        cut = np.searchsorted(owner, offset)
        root = -np.log(-np.log(uniform(seeds, 0, 1 << 43)))
        searches = []
        for i, seed in enumerate(seeds.tolist()):
            own = slice(cut[i], cut[i + 1])
            searches.append(Search(Path(lat, edges[own], place[owner[own]], float(root[i]), 0, k), seed))
        if searches:
            Path.draw_bounds([s.paths[0] for s in searches], seeds, 0)
        for sample in range(1, k):
            jobs, node, last, seed, unit = [], [], [], [], []
            for i, s in enumerate(searches):
                got = s.branch(lat, sample)
                if got is None:
                    continue
                _, path, t, edge = got
                at = lat.node_of(edge) + int(lat.step[edge])
                u = int(s.paths[path].unit[t])
                a, b = offset[i] + u, offset[i + 1]
                jobs.append((i, got))
                node.append(np.concatenate([[at], first[a + 1:b]]))
                last.append(end[a:b])
                seed.append(np.full(b - a, seeds[i], np.uint64))
                unit.append(np.arange(u, size[i]))
            if not jobs:
                break
            count = np.cumsum([0, *map(len, node)])
            edges, owner = lat.descend(*map(np.concatenate, (node, last, seed)), sample, np.concatenate(unit))
            cut = np.searchsorted(owner, count)
            for j, (i, (score, path, t, edge)) in enumerate(jobs):
                old = searches[i].paths[path]
                own = slice(cut[j], cut[j + 1])
                searches[i].paths.append(Path(
                    lat, np.concatenate([old.edges[:t], [edge], edges[own]]),
                    np.concatenate([old.unit[:t + 1], unit[j][owner[own] - count[j]]]), score, t + 1, k))
            drawn = [i for i, _ in jobs]
            Path.draw_bounds([searches[i].paths[-1] for i in drawn], seeds[drawn], sample)
        return [self.result(s) for s in searches]

    def result(self, search: Search) -> list[tuple[np.ndarray, float, float, float]]:
        threshold = search.best()
        out = []
        for path in search.paths:
            log_p = float(path.before[-1])
            if threshold is None:
                inclusion = 0.0
            else:
                x = log_p - threshold[0]
                inclusion = x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 30.0)))))
            out.append((self.ids(self.lattices.piece[path.edges].astype(np.int64)), log_p, path.score, inclusion))
        return out

    def ids(self, pieces: np.ndarray) -> np.ndarray:
        """Piece ids; spelled characters become their byte pieces."""
        spelled = pieces >= self.pieces.size
        if not spelled.any():
            return pieces
        parts, at = [], 0
        for i in np.flatnonzero(spelled).tolist():
            char = chr(int(pieces[i]) - self.pieces.size).encode("utf-8", "surrogatepass")
            parts += [pieces[at:i], self.pieces.byte_id[list(char)]]
            at = i + 1
        return np.concatenate([*parts, pieces[at:]])


def row_seed(key: object) -> int:
    return xxhash.xxh64_intdigest(b"" if key is None else str(key).encode(), 1)


def _sampler(model: bytes) -> Sampler:
    state = worker_state("segmentation")
    if state.get("of") is not model:
        state.update(of=model, sampler=Sampler(model))
    return state["sampler"]


def sample_segmentations(docs: DataFrame, model_path: str, k: int = SAMPLES, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """(id, sample, ids, n_ids, log_prob, score, log_inclusion, round_trip): up to ``k`` rows per row of ``docs``.

    ``score`` is the perturbed log probability, descending over the samples; ``log_inclusion`` the log of the
    probability that a draw of ``k`` holds the segmentation, given the first score that it lacks; ``round_trip``
    whether the ids decode to the text.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_bytes(model_path))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "sample", "ids", "n_ids", "log_prob", "score", "log_inclusion", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(shipped.value)
        for batch in slices(batches, "__llm_text", 500_000):
            rows = texts(batch.column(1))
            seeds = np.array([row_seed(x) for x in batch.column(0).to_pylist()], np.uint64)
            row, sample, ids, numbers = [], [], [], []
            for i, drawn in enumerate(sampler.sample(rows, seeds, k)):
                for j, (own, *rest) in enumerate(drawn):
                    row.append(i)
                    sample.append(j + 1)
                    ids.append(own)
                    numbers.append(rest)
            size, flat = np.cumsum([0, *map(len, ids)]), np.concatenate(ids)
            same = [t == rows[i] for i, t in zip(row, sampler.pieces.decode_all(flat, np.diff(size)))]
            lists = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(sample, pa.int32()), lists,
                 pa.array(np.diff(size), pa.int64()), *(pa.array(x, pa.float64()) for x in zip(*numbers)),
                 pa.array(same, pa.bool_())], names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__llm_text")).mapInArrow(
        run, f"`{id_col}` {kind}, sample int, ids array<int>, n_ids bigint, log_prob double, score double, "
             "log_inclusion double, round_trip boolean")


def decode_pieces(encoded: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the ids of each row spell (null ids: null)."""
    shipped = encoded.sparkSession.sparkContext.broadcast(read_bytes(model_path))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    names = [*encoded.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _sampler(shipped.value).pieces
        at = names.index(ids_col)
        for batch in batches:
            text = [None if x is None else pieces.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names)

    return encoded.mapInArrow(run, f"{fields}, `{out}` string")


def op1_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
