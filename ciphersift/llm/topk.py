"""Exact top-k search over binary codes by incremental multi-index hashing (operator 8).

A code is cut into ``m`` segments, and each segment's values are a table of the
codes that have them.  Round ``r`` probes, in every table, the entries whose
segment differs from the query's in exactly ``r`` bits, and verifies what they
hold by its complete distance.  After round ``r`` every code within
``m * (r + 1) - 1`` bits has been met: a code further than ``r`` bits in each of
the segments differs in ``m * (r + 1)`` bits or more.  A query whose kth verified
distance is within that bound is provably done and leaves; the others go on.

Tables hold distinct codes, with the ``k`` least ids of each, so a vector that
many rows share is one entry.  Entries and probes of one table value meet in one
task, unless it has more than ``HEAVY`` entries: these are dealt to several salts,
and its probes are copied to each.  A task compares at most ``PAIRS`` pairs (or one
probe's entries) at a time and hands on at most ``k`` codes per query and chunk; the
first of equal distances are those with the least ids.  Probes are dealt out as
rows, never as pairs of all queries and all codes.

Defined results: rows without a code (null or empty vectors, vectors with a
null) are neither found nor searched for, null ids neither; codes are compared
with those of the same length; ids may repeat, a repeated row counts once;
neighbours are ordered by distance, then id, and a row finds itself; a query
with fewer than ``k`` codes to find gets them all; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ciphersift.llm.common import drop_path, scratch_path, table, written

K = 10
QUERY_EVERY = 50    # rows whose id is divisible by this are queries
SALTS = 64          # parts that the rows of one code are dealt to before its least ids are known
CHUNK = 100_000     # rows of entries and probes that are joined at a time
HEAVY = 16_384      # entries of one table value, above which they are dealt to several salts
PAIRS = 1_000_000   # pairs of a probe and an entry that are compared at a time
MANY = 256          # entries of a probe, above which those past its kth distance are cut before the sort


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): one bit per dimension, set where the value is above zero, padded to whole 8 bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for v in batch.column(1).to_pylist():
                if not v or None in v:
                    codes.append(None)
                    continue
                bits = np.zeros(-(-len(v) // 64) * 64, np.uint8)
                bits[:len(v)] = np.asarray(v, np.float64) > 0
                codes.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["id", "code"])

    return (vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .mapInArrow(run, "id bigint, code binary").filter("id IS NOT NULL AND code IS NOT NULL"))


def distinct_codes(codes: DataFrame, k: int) -> DataFrame:
    """(code, ids): the ``k`` least ids of each code, found in two steps so that a common code is no hot key."""
    rows = codes.select("id", "code").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = Window.partitionBy("code", "salt").orderBy("id")
    some = rows.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= k)
    return some.groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids"))


def segment_bounds(bits: int, n: int) -> list[int]:
    """Cuts of a code into segments of about log2(n) - 2 bits, so an entry holds a few codes."""
    width = max(3.0, math.log2(max(n, 2)) - 2)
    m = max(1, math.ceil(bits / width))
    return [round(i * bits / m) for i in range(m + 1)]


def segment_values(codes: np.ndarray, bounds: list[int]) -> np.ndarray:
    """[code, segment] values of codes given as bytes [code, byte]."""
    bits = np.unpackbits(codes, axis=1, bitorder="little").astype(np.int64)
    return np.stack([bits[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(bounds, bounds[1:])], 1)


def flips(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits with ``radius`` set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)


def as_bytes(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as [row, byte]."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def entries_of(bounds: list[int]):
    """(key, kind 0, code, least id, ids counted): the table entries of each code."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = segment_values(as_bytes(batch.column(0)), bounds)
                for s in range(values.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values[:, s] | (s << 40)), pa.array(np.zeros(batch.num_rows, np.int32)), batch.column(0),
                         batch.column(1), batch.column(2)], ["key", "kind", "code", "least", "n"])
    return run


def probes_of(bounds: list[int], radius: int):
    """(key, kind 1, query code, worst distance that still counts, 0): the entries at that radius."""
    masks = [flips(b - a, radius) for a, b in zip(bounds, bounds[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = segment_values(as_bytes(batch.column(0)), bounds)
            for s, mask in enumerate(masks):
                for i in range(0, len(mask), 256):
                    own = mask[i:i + 256]
                    row = pa.array(np.repeat(np.arange(batch.num_rows), len(own)))
                    key = (values[:, s][:, None] ^ own[None, :]).ravel() | (s << 40)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(np.ones(len(key), np.int32)), batch.column(0).take(row),
                         batch.column(1).take(row), pa.array(np.zeros(len(key), np.int64))],
                        ["key", "kind", "code", "least", "n"])
    return run


def groups_of(batch: pa.RecordBatch) -> np.ndarray:
    """Numbers of the (key, salt) groups of sorted rows."""
    key, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    return np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])


def meet(k: int):
    """Of rows sorted by key, salt and kind: per query, the ``k`` best codes that its probes met in this chunk."""
    def joined(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        group, kind = groups_of(batch), batch.column(2).to_numpy()
        entry, probe = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        a = np.searchsorted(group[entry], group[probe], "left")
        n = np.searchsorted(group[entry], group[probe], "right") - a
        probe, a, n = probe[n > 0], a[n > 0], n[n > 0]
        if not len(probe):
            return None
        code, worst = batch.column(3), batch.column(4).to_numpy()
        words = as_bytes(code).view(np.uint64)
        # queries by their codes: a query's probes are several rows
        name = np.unique(words, axis=0, return_inverse=True)[1].ravel()

        def best(q: np.ndarray, c: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((name[c], worst[c], distance, name[q]))
            q, c, distance = q[order], c[order], distance[order]
            first = np.r_[True, (name[q][1:] != name[q][:-1]) | (name[c][1:] != name[c][:-1])][:len(q)]
            q, c, distance = q[first], c[first], distance[first]
            head = np.flatnonzero(np.r_[True, name[q][1:] != name[q][:-1]][:len(q)])
            rank = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)]))
            return q[rank < k], c[rank < k], distance[rank < k]

        def compared(probe: np.ndarray, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = np.repeat(np.arange(len(probe)), n)
            q = probe[own]
            c = entry[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
            distance = np.zeros(len(q), np.int64)
            for w in range(words.shape[1]):
                distance += np.bitwise_count(words[q, w] ^ words[c, w])
            near = distance <= worst[q]
            many = np.flatnonzero(n > max(MANY, k))
            if len(many):  # a probe's entries are distinct codes, so those past its kth distance are not among its best
                bits = 64 * words.shape[1] + 1
                place = np.full(len(probe), -1)
                place[many] = np.arange(len(many))
                at = place[own]
                held = at >= 0
                counts = np.bincount(at[held] * bits + distance[held], minlength=len(many) * bits).reshape(len(many), bits)
                kth = np.full(len(probe), bits)
                kth[many] = (np.cumsum(counts, 1) >= k).argmax(1)
                near &= distance <= kth[own]
            return best(q[near], c[near], distance[near])

        # a block ends before the probe that would bring it over PAIRS
        block = np.cumsum(n) // PAIRS
        cuts = [*np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist(), len(probe)]
        found = [compared(probe[i:j], a[i:j], n[i:j]) for i, j in zip(cuts, cuts[1:])]
        q, c, distance = found[0] if len(found) == 1 else best(*map(np.concatenate, zip(*found)))
        if not len(q):
            return None
        return pa.RecordBatch.from_arrays(
            [code.take(pa.array(q)), code.take(pa.array(c)), pa.array(distance), batch.column(4).take(pa.array(c)),
             batch.column(5).take(pa.array(c))], ["query", "code", "distance", "least", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def whole() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:  # all but the last group, which may go on; of a group alone its entries stay for later probes
                chunk = whole()
                group = groups_of(chunk)
                cut = int(np.searchsorted(group, group[-1], "left"))
                n_entries = int((chunk.column(2).to_numpy() == 0).sum())
                if cut:
                    done, kept = chunk.slice(0, cut), chunk.slice(cut)
                elif n_entries < chunk.num_rows:
                    done, kept = chunk, chunk.slice(0, n_entries)
                else:
                    continue
                if (out := joined(done)) is not None:
                    yield out
                held, rows = [kept] if kept.num_rows else [], kept.num_rows
        if held and (out := joined(whole())) is not None:
            yield out
    return run


MET = "query binary, code binary, distance bigint, least bigint, n bigint"
ROW = "key bigint, kind int, code binary, least bigint, n bigint"


def salted(rows: DataFrame, heavy: DataFrame, copied: bool) -> DataFrame:
    """Rows with their salt: an entry of a heavy key has one of its salts, a probe is copied to all of them."""
    salts = F.coalesce("salts", F.lit(1).cast("bigint"))
    salt = F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)) if copied else F.pmod(F.xxhash64("code"), salts)
    # a key is heavy by its many entries, so heavy keys are few against the entries
    return rows.join(F.broadcast(heavy), "key", "left").select("key", salt.alias("salt"), "kind", "code", "least", "n")


def search_length(index: DataFrame, queries: DataFrame, bits: int, n: int, k: int) -> DataFrame:
    """(query, code, distance) with the ``k`` nearest ids of each query code among codes of one length."""
    spark = index.sparkSession
    bounds = segment_bounds(bits, n)
    m, widest = len(bounds) - 1, max(b - a for a, b in zip(bounds, bounds[1:]))
    entries = written(index.select("code", F.element_at("ids", 1).alias("least"), F.size("ids").cast("bigint").alias("n"))
                      .mapInArrow(entries_of(bounds), ROW), "topk-entries")
    heavy = written(entries.groupBy("key").count().filter(F.col("count") > HEAVY)
                    .select("key", F.ceil(F.col("count") / HEAVY).cast("bigint").alias("salts")), "topk-heavy")
    active = queries.select("code", F.lit(bits).cast("bigint").alias("worst"))
    state = spark.createDataFrame([], MET)
    done, path = [], None
    for radius in range(widest + 1):
        probes = active.mapInArrow(probes_of(bounds, radius), ROW)
        met = (salted(entries, heavy, False).union(salted(probes, heavy, True)).repartition("key", "salt")
               .sortWithinPartitions("key", "salt", "kind").mapInArrow(meet(k), MET))
        by_query = Window.partitionBy("query").orderBy("distance", "least", "code")
        # at most k codes of a query come from the state and from each task
        best = (state.union(met).distinct().withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
                .withColumn("ids", F.sum("n").over(by_query.rowsBetween(Window.unboundedPreceding, 0))))
        covered = m * (radius + 1) - 1
        enough = F.max(F.when((F.col("ids") >= k) & (F.col("distance") <= covered), True).otherwise(False)).over(
            Window.partitionBy("query"))
        kth = F.coalesce(F.min(F.when(F.col("ids") >= k, F.col("distance"))).over(Window.partitionBy("query")), F.lit(bits))
        last_path, path = path, scratch_path(spark, f"topk-{radius}")
        best.withColumn("done", enough | F.lit(radius == widest)).withColumn("worst", kth).write.parquet(path)
        found = spark.read.parquet(path)
        done.append(found.filter("done").select("query", "code", "distance"))
        state = found.filter("NOT done").select("query", "code", "distance", "least", "n")
        left = active.select("code").join(found.filter("done").select(F.col("query").alias("code")).distinct(), "code", "left_anti")
        worst = found.groupBy(F.col("query").alias("code")).agg(F.min("worst").alias("worst"))
        active_path = scratch_path(spark, "topk-active")
        left.join(worst, "code", "left").select("code", F.coalesce("worst", F.lit(bits)).cast("bigint").alias("worst")
                                                ).write.parquet(active_path)
        active = spark.read.parquet(active_path)
        if radius == widest or not active.limit(1).count():
            break
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def exact_top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) of the ``k`` nearest ids of each query by Hamming distance.

    Both inputs are (id, code) with binary codes of whole 8 bytes.
    """
    spark = codes.sparkSession
    index = written(distinct_codes(codes, k), "topk-codes")
    asked = queries.select("id", "code").distinct()
    sizes = index.groupBy(F.length("code").alias("bytes")).count().collect()  # a row per code length
    found = spark.createDataFrame([], "query binary, code binary, distance bigint")
    for r in sorted(sizes, key=lambda r: r.bytes):
        own = F.length("code") == r.bytes
        found = found.union(search_length(index.filter(own), asked.filter(own).select("code").distinct(),
                                          8 * r.bytes, r["count"], k))
    near = found.join(index, "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    order = Window.partitionBy("query").orderBy("distance", "neighbor_id")  # k codes of k ids at most
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return (asked.join(ranked, asked.code == ranked.query)
            .select(F.col("id").alias("query_id"), "neighbor_id", "distance", F.col("rank").cast("bigint").alias("rank")))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = written(sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "topk-rows")
    return exact_top_k(codes, codes.filter(F.col("id") % QUERY_EVERY == 0))


#: Queries are a stated fiftieth of the rows, each compared with all rows.
ORACLE_SQL = f"""
WITH bits AS (
  SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
pairs AS (
  SELECT q.id AS query_id, c.id AS neighbor_id,
         list_sum(list_transform(list_zip(q.b, c.b), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END))::BIGINT AS distance
  FROM bits q JOIN bits c ON len(q.b) = len(c.b) WHERE q.id % {QUERY_EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, neighbor_id, distance, rank FROM ranked WHERE rank <= {K}
"""
