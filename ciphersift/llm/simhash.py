"""SimHash near-duplicates by multi-index hashing (operator 6).

Fingerprints have 64 bits over word shingles; two of them link at ``RADIUS``
or fewer differing bits.  A fingerprint is cut into two segments of 32 bits.
If two differ in three bits at most, one of the segments differs in one bit at
most, so each segment's Hamming ball of radius one is enumerated: the segment
itself and the segment with one zero bit set (of two segments that differ in
one bit, one has that bit zero, so the pair meets).  What meets in a table
entry is verified by its complete distance.

Equal fingerprints are one node, so a group of copies costs one node whatever
its size, and a table entry holds distinct fingerprints that share 31 or more
bits of a segment.  An entry of at most ``MOST`` members links them by a search
that visits each member once and never emits its pairs.  A larger one is not
held: its members are dealt by four parts of their other bits, of which two
members within three bits share one, and meet again in the entries of those
parts, as often as it takes.  So no task holds or compares more than ``MOST``
members at a time, and no link is lost.

Defined results: null and empty texts have fingerprint zero and link like any
other; null ids are kept and never name a component unless all its ids are
null; repeated rows stay, each with its row; an empty table gives an empty one;
other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ciphersift.llm.common import slices, table, text_bytes, written
from ciphersift.llm.components import connected_components

WORDS = 3      # words of a shingle
RADIUS = 3     # most differing bits of a link
SEED = 42
MOST = 4_096   # members of a table entry that are compared with each other
AT_ONCE = 65_536  # shingles whose bits are unpacked at a time


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned fingerprint of a whole text."""
    import numpy as np
    import xxhash

    tokens = text.lower().split()  # bytes: lowers A-Z only, splits at space and \t-\r
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    line = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    stops = ends[-n:].tolist()
    h = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        got = np.array([h(line[a:b], SEED) for a, b in zip(starts[at:at + AT_ONCE], stops[at:at + AT_ONCE])],
                       dtype="<u8")
        total += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp, text_hash): the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, "t", 4_000_000):
            fp = np.array([fingerprint(t, words) for t in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)],
                                             [id_col, "fp", "text_hash"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), text.alias("t"), F.xxhash64(text).alias("h")).mapInArrow(
        run, f"`{id_col}` {kind}, fp bigint, text_hash bigint")


def ball_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table entries of each fingerprint: per segment, itself and with one zero bit set; the rest are free bits."""
    import numpy as np

    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for segment in (0, 1):
            part = (fp >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
            free = np.uint64(0xFFFFFFFF << (32 * (1 - segment)))
            for bit in (None, *range(32)):
                mask = np.uint64(0 if bit is None else 1 << bit)
                at = (part & mask) == 0
                keys = (part[at] | mask) | np.uint64(segment << 32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(fp[at].view(np.int64)),
                     pa.array(np.full(len(keys), free).view(np.int64))], ["key", "fp", "free"])


def dealt(key: int, members, free: int, radius: int):
    """(key, fp, free) of the members of an entry in ``radius + 1`` smaller ones: by each part of the free bits.

    Two members within ``radius`` bits agree on one part at least, whatever else they share.
    """
    import numpy as np
    import xxhash

    bits = [b for b in range(64) if free >> b & 1]
    out = []
    for chosen in np.array_split(np.array(bits, dtype=np.int64), radius + 1):
        mask = sum(1 << int(b) for b in chosen)
        value = members & np.uint64(mask)
        kinds, place = np.unique(value, return_inverse=True)
        names = np.array([xxhash.xxh64_intdigest(b"%d,%d,%d" % (key, mask, v), SEED) for v in kinds.tolist()], np.uint64)
        out.append((names[place], members, np.full(len(members), free & ~mask, np.uint64)))
    return [np.concatenate(x) for x in zip(*out)]


def groups_within(members, radius: int):
    """Label of each of the distinct fingerprints: the least one that it is linked to through members of this entry.

    A breadth-first search: each member looks once at those not reached yet.
    """
    import numpy as np

    label = members.copy()
    left = np.arange(len(members))
    while len(left):
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            near = np.bitwise_count(members[left] ^ members[queue.pop()]) <= radius
            found = left[near]
            left = left[~near]
            label[found] = members[seed]
            queue.extend(found.tolist())
    return label


def entry_links(radius: int, most: int):
    """Of rows sorted by key: (src, dst) between each member of an entry and the least member linked to it, or for
    each member of an entry beyond ``most`` (src, null, key, free) of the smaller entries that it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["src", "dst", "key", "free"]

        def is_large(n, free):
            """Members that agree on all but ``radius`` free bits and one of their segment are too few to be dealt."""
            return n > most and (int(free) & (1 << 64) - 1).bit_count() > radius

        def links(keys, fps, free):
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, stops = np.r_[0, cut], np.r_[cut, len(keys)]
            several = stops - starts > 1
            src, dst = [], []
            for a, b in zip(starts[several].tolist(), stops[several].tolist()):
                if is_large(b - a, free[a]):
                    yield from smaller(keys[a], fps[a:b], free[a])
                    continue
                own = np.unique(fps[a:b])
                label = groups_within(own, radius)
                linked = label != own
                src.append(own[linked])
                dst.append(label[linked])
            if src:
                none = pa.nulls(sum(map(len, src)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src).view(np.int64)),
                                                  pa.array(np.concatenate(dst).view(np.int64)), none, none], names)

        def smaller(key, fps, free):
            to, members, left = dealt(int(key), fps, int(free) & (1 << 64) - 1, radius)
            yield pa.RecordBatch.from_arrays([pa.array(members.view(np.int64)), pa.nulls(len(to), pa.int64()),
                                              pa.array(to.view(np.int64)), pa.array(left.view(np.int64))], names)

        held = None    # rows of the last key, which may go on in the next batch
        beyond = None  # a key with more rows than ``most``: its rows pass through
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy())
            if beyond is not None:
                n = int(np.searchsorted(rows[0], beyond, side="right"))
                if n:
                    yield from smaller(beyond, rows[1][:n], rows[2][0])
                if n == batch.num_rows:
                    continue
                rows, beyond = tuple(c[n:] for c in rows), None
            if held:
                rows = tuple(np.concatenate(c) for c in zip(held, rows))
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield from links(*(c[:last] for c in rows))
            held = tuple(c[last:] for c in rows)
            if is_large(len(held[0]), held[2][0]):
                beyond = held[0][0]
                yield from smaller(beyond, held[1], held[2][0])
                held = None
        if held:
            yield from links(*held)

    return run


def near_links(nodes: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(src, dst) links between distinct fingerprints ``nodes(fp)`` that connect all that are within ``radius``.

    A round for the table entries, and one more for as long as an entry holds more than ``most`` members: each
    fixes more bits, and members that agree on all but a few bits are few.
    """
    entries = nodes.select("fp").mapInArrow(ball_keys, "key bigint, fp bigint, free bigint")
    links = None
    while True:
        found = written(entries.repartition("key").sortWithinPartitions("key").mapInArrow(
            entry_links(radius, most), "src bigint, dst bigint, key bigint, free bigint"), "simhash-links")
        here = found.filter("key IS NULL").select("src", "dst")
        links = here if links is None else links.union(here)
        entries = found.filter("key IS NOT NULL").select("key", F.col("src").alias("fp"), "free")
        if entries.isEmpty():
            return links.distinct()


def fingerprint_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, grp) of every distinct fingerprint: grp is one fingerprint of its component."""
    nodes = prints.select("fp").distinct()
    found = connected_components(near_links(nodes, radius))
    return (nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("component", "fp").alias("grp")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``."""
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    groups = fingerprint_groups(prints, radius)
    # ids are gathered by fingerprint first, so neither a group of copies nor a large component is a hot key
    first = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    named = first.join(groups, "fp")
    least = named.groupBy("grp").agg(F.min("least").alias("component_id"))
    names = named.join(least, "grp").select("fp", "component_id")
    return prints.join(names, "fp").select(
        F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                     radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` that stay when one row of each near-duplicate group does: that with the least id.

    Ids may repeat: rows are told apart by id and text, and of equal rows one stays.  A null id counts as last.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    groups = fingerprint_groups(prints, radius)
    order = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("text_hash").alias("h")))
    first = prints.groupBy("fp").agg(order.alias("row"))
    chosen = first.join(groups, "fp").groupBy("grp").agg(F.min("row").alias("row"))
    chosen = chosen.select(F.col("row.id").alias("__keep_id"), F.col("row.h").alias("__keep_hash"))
    rows = docs.withColumn("__row_hash", F.xxhash64(F.col(text_col).cast("string")))
    kept = rows.join(chosen, F.col(id_col).eqNullSafe(F.col("__keep_id"))
                     & (F.col("__row_hash") == F.col("__keep_hash")), "left_semi")
    return kept.dropDuplicates([id_col, "__row_hash"]).select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
