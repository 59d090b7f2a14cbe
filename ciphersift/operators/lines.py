"""Line split.

Lines are produced by ``posexplode`` of ``split(content, '\\n')`` inside the
task that read the row: a generator in the same codegen stage, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_array(content: Column) -> Column:
    """Lines as a line scanner sees them: split on ``\\n``, no empty line after
    a final newline (an empty text has no lines)."""
    parts = F.split(content, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip_cr(c: Column) -> Column:
    return F.regexp_replace(c, "\r\\z", "")


def explode_lines(docs: DataFrame, keep: tuple[str, ...] = ("path",), content: str = "content",
                  strip: bool = True, fold=None, marker: str | None = None) -> DataFrame:
    """(keep..., content) -> (keep..., line INT 1-based, text[, folded, previous]).

    ``strip`` removes one trailing ``\\r`` (regex tier, P4); without it the
    raw ``\\n``-split text is kept (snippets, P5).
    ``fold`` (Column -> Column) adds ``folded``, computed inside the
    generator: later filters then read a plain column instead of having the
    expression substituted into every predicate that uses it.  With
    ``marker``, a line of a text that holds it also carries the line before
    it as ``previous`` (null elsewhere), so that inline suppression is a test
    of one row.
    """
    arr = line_array(F.col(content))
    if fold is not None:
        before = F.array(F.lit(None).cast("string"))
        if marker is not None:
            before = F.when(F.col(content).contains(marker), F.concat(before, F.slice(arr, F.lit(1), F.greatest(F.size(arr) - 1, F.lit(0))))).otherwise(
                F.array().cast("array<string>"))
        pairs = F.arrays_zip(arr.alias("l"), before.alias("before"))
        arr = F.transform(pairs, lambda z: F.struct((strip_cr(z["l"]) if strip else z["l"]).alias("text"),
                                                    fold(z["l"]).alias("folded"), z["before"].alias("previous")))
        exploded = docs.select(*keep, F.posexplode(arr).alias("pos", "l"))
        return exploded.select(*keep, (F.col("pos") + 1).cast("int").alias("line"), F.col("l.text").alias("text"),
                               F.col("l.folded").alias("folded"), F.col("l.previous").alias("previous"))
    exploded = docs.select(*keep, F.posexplode(arr).alias("pos", "raw"))
    text = strip_cr(F.col("raw")) if strip else F.col("raw")
    return exploded.select(*keep, (F.col("pos") + 1).cast("int").alias("line"), text.alias("text"))


def has_overlong_line(content: Column, max_line_bytes: int) -> Column:
    """F10, an option: a line of that many bytes or more.  The cheap
    whole-text length test guards the split."""
    return (F.octet_length(content) >= max_line_bytes) & F.exists(
        F.split(content, "\n", -1), lambda l: F.octet_length(l) >= max_line_bytes)
