"""Regex tier for catalogs of any size (J1 with a table of user schemes).

:mod:`.scheme_scan` writes every pattern as a literal into one projection, which
is right for the built-in catalog but makes the plan grow with the schemes.  Here
the catalog stays a table.  Each pattern has a needle, a literal that every match
holds.  Of a catalog whose measured size allows a broadcast, the gram is the whole
needle with what is known of it: tasks find the needles that a line
holds in one pass over the bytes of many lines (:class:`Needles`), and only these meet
the catalog in an equi-join, sorted by needle, so that the exact regex behind it is
compiled once for neighbouring rows.  It begins where the first match may.

Of a larger one, a gram of ``GRAM`` characters of each needle is indexed, the one that
fewest needles of the catalog hold.  A line's distinct grams are exploded once and
meet the index in an equi-join with a shuffle (frequent grams of the lines are split
by AQE); the pairs that survive are checked, first for the whole needle and then by the exact regex.
Patterns without a needle (of ``SHORT`` characters, of ``GRAM`` in a larger catalog) fall
back on a theta join with the catalog's rest, behind their boundary-free superset regex.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lit_map
from ..functions.regex import java_regex, translate, validate_re2
from ..sources.catalog import CLASS_SEVERITY, REMEDIATION_BY_CLASS, REMEDIATION_BY_NAME, SUPPRESS_MARKER
from .lines import explode_lines
from .post import suppressed
from .scheme_scan import FINDING_COLUMNS, folded

GRAM = 4
SHORT = 2              # characters of a needle that tasks look for themselves, at least
MAX_BROADCAST_ROWS = 100_000  # schemes of an index that may be broadcast (some hundred bytes each)
AT_ONCE = 8_000_000    # bytes of lines that are searched together, and of text that is handed on at a time
STEP = 1 << 17         # places that are looked up at a time
COMPILED = ("ord bigint, name string, title string, class string, note string, remediation string, "
            "needle string, short string, known int, java string, body string, prefilter string, error string")
# what go_trim strips: the regex of it tries every place of a line, and a line may hold many schemes
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
KNOWN = "concat(hex(known), short)"  # a needle behind what is known of it
EDGE = "\b"  # stands for a word boundary in a run of literals


def _skip_class(p: str, i: int) -> int:
    """Index after the character class that begins at ``p[i] == '['``."""
    i += 1
    if p[i:i + 1] == "^":
        i += 1
    if p[i:i + 1] == "]":
        i += 1
    while i < len(p) and p[i] != "]":
        if p.startswith("[:", i):
            i = p.index(":]", i) + 2
        else:
            i += 2 if p[i] == "\\" else 1
    return i + 1


def _skip_group(p: str, i: int) -> int:
    """Index after the group that begins at ``p[i] == '('``."""
    depth = 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            i = _skip_class(p, i)
            continue
        depth += (c == "(") - (c == ")")
        i += 1
        if not depth:
            break
    return i


def _literal_runs(re2: str) -> list[str] | None:
    """The runs of ASCII literals that every match of a pattern holds in this order, the first one at its start (maybe empty).

    Only characters outside groups and classes count, and of a pattern with a
    choice at its top level nothing does.  Zero-width assertions do not end a run; a word boundary is an ``EDGE`` in it.
    """
    runs, run, i = [], "", 0
    while i < len(re2):
        c = re2[i]
        if c == "|":
            return None
        if c == "\\":
            e = re2[i + 1:i + 2]
            if e in ("Q", "x", "p", "P", "0") or e.isdigit():
                return None  # escapes of more than one character: not worth reading here
            i += 2
            if e in ("b", "B", "A", "z"):
                run += EDGE * (e == "b")
                continue
            if e and e.isascii() and not e.isalnum():
                run += e
                continue
            c = ""
        elif c == "(":
            end = _skip_group(re2, i)
            if re2.startswith("(?", i) and re2[i + 2:end - 1].strip("imsU-") == "" and end - i > 3:
                if "x" in re2[i:end]:
                    return None
                i = end  # flags only
                continue
            i, c = end, ""
        elif c == "[":
            i, c = _skip_class(re2, i), ""
        else:
            i += 1
        if c in ("*", "?", "{"):  # what stands before may be absent
            runs.append(run[:-1])
            run = ""
            if c == "{":
                i = max(i, re2.find("}", i) + 1)
        elif c and c.isascii() and c not in ".^$+)" + EDGE:
            run += c
        else:
            runs.append(run)
            run = ""
    return [*runs, run]


def _literals(run: str) -> str:
    return run.replace(EDGE, "")


def required_needle(re2: str) -> str | None:
    """The longest run of ASCII literals that every match of a pattern holds, lower-cased; None if it has less than ``GRAM``."""
    needle = max(map(_literals, _literal_runs(re2) or [""]), key=len).lower()
    return needle if len(needle) >= GRAM else None


def short_needle(re2: str) -> tuple[str | None, int]:
    """The same, with ``SHORT`` characters or more, and a sum of what is known of it.

    1, 2: a word boundary stands at its start, at its end; 4: its case counts (else it is lower-cased); 8: every match begins with it,
    and whether there is one depends on no more than one character before it.
    """
    runs = _literal_runs(re2) or [""]
    run = max(runs, key=lambda run: len(_literals(run)))
    needle, exact = _literals(run), "(?" not in re2
    if len(needle) < SHORT:
        return None, 0
    leads = run is runs[0] and "^" not in re2 and "\\A" not in re2
    return (needle if exact else needle.lower()), run.startswith(EDGE) + 2 * run.endswith(EDGE) + 4 * exact + 8 * leads


def start_guard(re2: str) -> str:
    """A Java look-ahead for the literals that every match begins with, in any case: turns most places of a line down at once."""
    partner = {"k": "\u212a", "s": "\u017f"}
    lead = _literals((_literal_runs(re2) or [""])[0]).lower()
    one = lambda c: f"[{c}{c.upper()}{partner.get(c, '')}]" if c.isalpha() else c if c.isalnum() or c == "_" else "\\" + c
    return f"(?={''.join(map(one, lead))})" if lead else ""


def _compile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Catalog rows with their Java regex and needle; a pattern outside RE2 gives its error."""
    columns = [c.split()[0] for c in COMPILED.split(", ")]
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            try:
                validate_re2(r.pattern)
                body = start_guard(r.pattern) + translate(r.pattern)
                made = (required_needle(r.pattern), *short_needle(r.pattern), "(?d)" + body, body,
                        java_regex(r.pattern, drop_boundaries=True), None)
            except ValueError as e:
                made = (None, None, 0, None, None, None, str(e))
            rows.append((r.ord, r.name, r.title or r.name, r.cls or "weak", r.note or "", r.remediation or "", *made))
        yield pd.DataFrame(rows, columns=columns)


def compiled_catalog(catalog: DataFrame) -> DataFrame:
    """catalog(ord, id, pattern[, title, class, note, remediation]) -> the rows a scan needs, compiled on the executors."""
    have = set(catalog.columns)
    opt = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    rows = catalog.select(F.col("ord").cast("bigint"), F.col("id").alias("name"), "pattern", opt("title").alias("title"),
                          opt("class").alias("cls"), opt("note").alias("note"), opt("remediation").alias("remediation"))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInPandas(_compile, COMPILED)


def grams(text: Column) -> Column:
    """All distinct substrings of ``GRAM`` characters (one linear pass of a look-ahead)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1))


def gram_index(compiled: DataFrame) -> DataFrame:
    """One gram per needle: the one that fewest needles hold (ties: the last in order)."""
    each = compiled.where("needle IS NOT NULL").select("ord", F.explode(grams(F.col("needle"))).alias("gram"))
    shared = each.withColumn("n", F.count("*").over(Window.partitionBy("gram")))
    best = shared.groupBy("ord").agg(F.max_by("gram", F.struct(-F.col("n"), "gram")).alias("gram"))
    return compiled.join(best, "ord")


class Needles:
    """Finds which of many ASCII needles the lines of a batch hold, exactly.

    A needle is given as in ``KNOWN``: it counts only where its ends are word boundaries and its case is kept, as asked,
    in lines that folding changes in A-Z only.
    Every needle has an anchor: itself up to 8 bytes, else the 8 bytes of it that fewest needles hold.  The text is read
    as one number at each byte; where a bitmap by hash has the number, the anchor is looked up and the whole needle compared.
    """

    WHOLE = 8

    def __init__(self, needles: list[str]):
        self.needles = sorted(set(needles))
        raw = [n[1:].encode().lower() for n in self.needles]
        known = np.array([int(n[0], 16) for n in self.needles], np.int64)
        self.before, self.after, self.exact, self.leads = (known & bit > 0 for bit in (1, 2, 4, 8))
        self.word = np.array([chr(c).isalnum() or c == ord("_") for c in range(128)] + [False] * 128)
        shared = Counter(x for n in raw if len(n) > self.WHOLE for x in {n[i:i + self.WHOLE] for i in range(len(n) - self.WHOLE + 1)})
        self.size = np.array([len(n) for n in raw], np.int64)
        offsets = [min(range(max(1, len(n) - self.WHOLE + 1)), key=lambda i: shared[n[i:i + self.WHOLE]]) for n in raw]
        self.offset = np.array(offsets, np.int64)
        number = lambda part: int.from_bytes(part, "little")
        self.by_width = []  # (mask, shift, bitmap, numbers, where a number's needles start, needles)
        for width in sorted({min(len(n), self.WHOLE) for n in raw}):
            own = [(number(n[o:o + width]), k) for k, (n, o) in enumerate(zip(raw, offsets)) if min(len(n), self.WHOLE) == width]
            own.sort()
            numbers, starts = np.unique(np.array([x for x, _ in own], np.uint64), return_index=True)
            bits = max(12, len(numbers).bit_length() + 4)
            shift, bitmap = np.uint64(64 - bits), np.zeros(1 << bits, bool)
            bitmap[self._hash(numbers, shift)] = True
            self.by_width.append((np.uint64((1 << 8 * width) - 1), shift, bitmap, numbers, np.r_[starts, len(own)],
                                  np.array([k for _, k in own], np.int64)))
        # what is compared of a needle: numbers at every 8th byte, and at its end; as it is given, and lower-cased
        parts = [[min(i, max(0, len(n) - self.WHOLE)) for i in range(0, len(n), self.WHOLE)] for n in raw]
        self.part_start = np.cumsum([0, *map(len, parts)])
        self.part_at = np.array([i for at in parts for i in at], np.int64)
        self.part_mask = np.array([(1 << 8 * min(len(n), self.WHOLE)) - 1 for n, at in zip(raw, parts) for _ in at], np.uint64)
        self.part_low = np.array([number(n[i:i + self.WHOLE]) for n, at in zip(raw, parts) for i in at], np.uint64)
        self.part = np.array([number(n[1:].encode()[i:i + self.WHOLE]) for n, at in zip(self.needles, parts) for i in at], np.uint64)

    @staticmethod
    def _hash(numbers: np.ndarray, shift: np.uint64) -> np.ndarray:
        return (numbers * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)

    def bytes_of(self, lines: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, the number of 8 bytes from each on, where lines end) of lines; the first line begins at 0."""
        ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset:lines.offset + len(lines) + 1].astype(np.int64)
        first, n = int(ends[0]), int(ends[-1] - ends[0])
        text = np.zeros(n + self.WHOLE + 1, np.uint8)
        if n:
            text[:n] = np.frombuffer(lines.buffers()[2], np.uint8)[first:first + n]
        return text, np.ndarray(n + 1, "<u8", text.data, strides=(1,)), ends - first

    @staticmethod
    def same_but_case(text: np.ndarray, ends: np.ndarray, folded_: np.ndarray, folded_ends: np.ndarray) -> np.ndarray:
        """Of each line, whether its folded bytes are its own with A-Z lowered (a carriage return may follow)."""
        n, size = int(ends[-1]), np.diff(ends)
        low = text[:n] + np.uint8(32) * ((text[:n] >= 65) & (text[:n] <= 90))
        if not np.array_equal(ends, folded_ends):
            # lines of another length are told apart by it, the others are compared where they stand
            at = np.arange(n) + np.repeat(folded_ends[:-1] - ends[:-1], size)
            folded_ = folded_[np.minimum(at, len(folded_) - 1)]
        other = np.cumsum(np.r_[False, low != folded_[:n]], dtype=np.int32)
        longer = np.diff(folded_ends) - size
        return (other[ends[1:]] == other[ends[:-1]]) & ((longer == 0) | (longer == 1))

    def _equal(self, at: np.ndarray, begin: np.ndarray, needle: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Whether the text has a needle's parts at each place."""
        open_, equal, k = np.arange(len(needle)), np.ones(len(needle), bool), 0
        while len(open_):
            own = self.part_start[needle[open_]] + k
            more = own < self.part_start[needle[open_] + 1]
            open_, own = open_[more], own[more]
            good = at[begin[open_] + self.part_at[own]] & self.part_mask[own] == part[own]
            equal[open_[~good]] = False
            open_, k = open_[good], k + 1
        return equal

    def held(self, lines: pa.StringArray, folded_: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (needle, line) of all lines, sorted, and the characters that come before the one before the first match."""
        text, at, ends = self.bytes_of(folded_)
        own, own_at, own_ends = self.bytes_of(lines)
        plain = self.same_but_case(own, own_ends, text, ends)
        inner = np.cumsum(np.r_[False, own[:-1] & 0xC0 == 0x80], dtype=np.int32)  # bytes that go on a character, before each place
        n, is_word = len(text) - self.WHOLE - 1, lambda place, outside: self.word[text[place]] & ~outside
        pairs, begins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, n, STEP):
            read = at[start:min(n, start + STEP)].copy()
            for mask, shift, bitmap, numbers, starts, needles in self.by_width:
                cut = read & mask
                place = np.flatnonzero(bitmap[self._hash(cut, shift)])
                cut = cut[place]
                known = np.minimum(np.searchsorted(numbers, cut), len(numbers) - 1)
                same = numbers[known] == cut
                place, known = place[same] + start, known[same]
                many = starts[known + 1] - starts[known]
                needle = needles[np.repeat(starts[known], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                place = np.repeat(place, many)
                begin, line = place - self.offset[needle], np.searchsorted(ends, place, "right") - 1
                end = begin + self.size[needle]
                inside = (begin >= ends[line]) & (end <= ends[line + 1])
                needle, begin, line, end = needle[inside], begin[inside], line[inside], end[inside]
                no = np.zeros(len(needle), bool)
                starts_word = is_word(begin, no) != is_word(begin - 1, begin == ends[line])
                ends_word = is_word(end - 1, no) != is_word(end, end == ends[line + 1])
                good = ~plain[line] | ((starts_word | ~self.before[needle]) & (ends_word | ~self.after[needle]))
                good[good] = self._equal(at, begin[good], needle[good], self.part_low)
                exact = np.flatnonzero(good & plain[line] & self.exact[needle])
                begin -= ends[line]
                good[exact] = self._equal(own_at, own_ends[line[exact]] + begin[exact], needle[exact], self.part)
                pairs.append(needle[good] * len(lines) + line[good])
                begins.append(begin[good])
        pairs, first = np.unique(np.concatenate(pairs), return_index=True)  # a needle's places come in order
        needle, line = np.divmod(pairs, max(1, len(lines)))
        begin = np.where(plain[line] & self.leads[needle], np.concatenate(begins)[first], 0)
        characters = begin - (inner[own_ends[line] + begin] - inner[own_ends[line]])
        return needle, line, np.maximum(characters - 1, 0)


def held_needles(lines: DataFrame, needles: list[str]) -> DataFrame:
    """(lines without ``folded``, skip, gram) for every needle that a line's ``folded`` holds, sorted by it batch by batch."""
    shipped = lines.sparkSession.sparkContext.broadcast(Needles(needles))
    kept = [c for c in lines.columns if c != "folded"]

    def found(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        whole = pa.RecordBatch.from_arrays([c.chunk(0) for c in table.columns], names=table.column_names)
        needle, line, skip = shipped.value.held(whole.column("text"), whole.column("folded"))
        whole = whole.select(kept)
        sizes = np.cumsum(pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False)[line], dtype=np.int64)
        names, start = pa.array(shipped.value.needles, pa.string()), 0
        while start < len(line):  # a long line may hold many needles
            before = int(sizes[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + AT_ONCE, "right")))
            own = whole.take(pa.array(line[start:stop]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(skip[start:stop], pa.int32()), names.take(pa.array(needle[start:stop]))],
                                             names=[*kept, "skip", "gram"])
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            rows.append(batch)
            size += batch.column("folded").nbytes
            if size >= AT_ONCE:
                yield from found(rows)
                rows, size = [], 0
        if size:
            yield from found(rows)

    schema = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in kept)
    return lines.mapInArrow(run, f"{schema}, skip int, gram string")


def catalog_findings(docs: DataFrame, compiled: DataFrame, marker: str = SUPPRESS_MARKER) -> DataFrame:
    """J1 + P4-P10 for ``docs(path, content)`` and a :func:`compiled_catalog` -> findings that no directive silences."""
    lines = explode_lines(docs.select("path", "content"), fold=folded, marker=marker)
    used = [*(c for c in lines.columns if c != "folded"), "skip", *compiled.columns]
    whole = F.lit(0).alias("skip")
    known = compiled.where("short IS NOT NULL").withColumn("gram", F.expr(KNOWN))
    needles = known.select("gram").limit(MAX_BROADCAST_ROWS + 1).toArrow()["gram"].to_pylist()
    if len(needles) <= MAX_BROADCAST_ROWS:
        met = held_needles(lines, needles).join(F.broadcast(known), "gram").select(*used)
        free = compiled.where("short IS NULL AND error IS NULL")
    else:
        met = lines.withColumn("gram", F.explode(grams(F.col("folded")))).join(gram_index(compiled), "gram")
        met = met.where(F.expr("contains(folded, needle)")).select("*", whole).select(*used)
        free = compiled.where("needle IS NULL AND error IS NULL")
    if not free.isEmpty():
        met = met.unionByName(lines.join(free, F.expr("text RLIKE prefilter")).select("*", whole).select(*used))
    rule = F.concat(F.lit("scheme:"), "name")
    # out of a generator, so that no filter on it is drawn into the join and runs a regex on every pair of one gram
    match = F.struct(F.expr("regexp_instr(substring(text, skip + 1), java)").alias("at"), rule.alias("rule_id"))
    hits = met.select("*", F.inline(F.array(match))).where("at > 0").withColumn("at", F.expr("at + skip"))
    before = F.expr("regexp_extract(substring(text, skip + 1), concat('(?d)^(.*?)(?:', body, ')'), 1)")
    skipped = F.octet_length(F.expr("substring(text, 1, skip)"))
    column = F.when(F.octet_length("text") == F.length("text"), F.col("at")).otherwise(skipped + F.octet_length(before) + 1)
    remedy = F.coalesce(F.nullif("remediation", F.lit("")), F.element_at(lit_map(REMEDIATION_BY_NAME), F.col("name")),
                       F.element_at(lit_map(REMEDIATION_BY_CLASS), F.col("class")), F.lit(""))
    out = hits.where(~suppressed(F.col("rule_id"), marker, F.col("text"), F.col("previous")))
    return out.select(
        "rule_id", F.format_string("%s (%s)", "title", "class").alias("title"), F.col("note").alias("description"),
        F.coalesce(F.element_at(lit_map(CLASS_SEVERITY), F.col("class")), F.lit("info")).alias("severity"),
        F.lit("low").alias("confidence"), remedy.alias("remediation"), F.col("path").alias("file"), "line",
        column.cast("int").alias("column"), F.btrim("text", F.lit(SPACES)).alias("snippet")
    ).select(*FINDING_COLUMNS)


class CatalogError(ValueError):
    pass


def checked_catalog(catalog: DataFrame) -> DataFrame:
    """Compiled once into the shared folder; raises on the first scheme that lacks an id or has a pattern outside RE2."""
    from ..session import cut_lineage

    compiled = cut_lineage(compiled_catalog(catalog))
    bad = compiled.where("error IS NOT NULL OR coalesce(name, '') = ''").orderBy("ord").select("name", "error").first()
    if bad:
        raise CatalogError(f"scheme {bad['name']!r}: {bad['error'] or 'needs an id'}")
    return compiled
