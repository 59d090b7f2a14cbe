"""Corpus sources (S1, S2): anything that becomes ``corpus(path, content,
length)`` with ``content`` as STRING (raw UTF-8 bytes are kept by the cast)
and ``length`` in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_COLUMNS = ("path", "content", "length")

# text tables of the test data set and how their rows map to virtual files
TEXT_TABLES: dict[str, tuple[str, str]] = {
    "documents": ("concat('documents/', doc_id)", "text"),
    "pages": ("concat('pages/', page_id)", "html"),
    "conversations": ("concat('conversations/', conv_id, '/', turn)", "text"),
    "benchmark": ("concat('benchmark/', item_id)", "text"),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(spark_dir(sf_dir), name))


def spark_dir(sf_dir: str) -> str:
    return sf_dir


def text_table_corpus(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A text table as a corpus; the parquet scan reads two columns only."""
    path_expr, text_col = TEXT_TABLES[table]
    df = read_table(spark, sf_dir, table)
    return from_rows(df, F.expr(path_expr), F.col(text_col))


def from_rows(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """Adapt any (path, text) rows to the corpus schema."""
    return df.select(path.cast("string").alias("path"),
                     content.cast("string").alias("content")) \
        .withColumn("length", F.octet_length("content").cast("long"))


def file_tree_corpus(spark: SparkSession, root: str, max_file_bytes: int | None = None,
                     path_glob: str | None = None) -> DataFrame:
    """A directory tree read by the ``binaryFile`` source.

    Every file is read unless ``max_file_bytes`` is given (give the scan the
    same value, see ``ScanOptions.max_file_bytes``).  Then one scan carries
    only ``path``/``length`` of the larger files (their bytes are never read,
    the ``length`` filter is pushed into the source), the other the content of the rest.
    Spark's file index hides names starting with ``.`` or ``_``; feed a
    manifest through :func:`from_rows` when those must be scanned too.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if path_glob:
        r = r.option("pathGlobFilter", path_glob)
    raw = r.load(root)  # one relation, one listing; both branches below share it
    if max_file_bytes is None:
        return raw.select("path", F.col("content").cast("string").alias("content"), "length")
    small = raw.where(F.col("length") <= max_file_bytes) \
        .select("path", F.col("content").cast("string").alias("content"), "length")
    large = raw.where(F.col("length") > max_file_bytes) \
        .select("path", F.lit(None).cast("string").alias("content"), "length")
    return small.unionByName(large)


def manifest_corpus(paths: DataFrame, max_file_bytes: int | None = None, path_col: str = "path"
                    ) -> DataFrame:
    """S1 with exact path parity: a DataFrame of file paths (e.g. a listing
    table) read on the executors, so names starting with ``.`` or ``_``,
    which Spark's file index hides, are scanned too.

    Each task stats and reads its own files (Arrow batches, no driver
    round trip); with ``max_file_bytes``, larger files are reported with their
    length but not read.  Unreadable paths come back without content, which
    the scan reports as an error."""
    import os

    def read(batches):
        import pandas as pd
        for pdf in batches:
            lengths, contents = [], []
            for p in pdf[path_col]:
                local = p[5:] if p.startswith("file:") else p
                try:
                    size = os.stat(local).st_size
                    data = None
                    if max_file_bytes is None or size <= max_file_bytes:
                        with open(local, "rb") as fh:
                            data = fh.read()
                    lengths.append(size)
                    contents.append(data)
                except OSError:
                    lengths.append(None)
                    contents.append(None)
            yield pd.DataFrame({"path": pdf[path_col], "length": pd.array(lengths, dtype="Int64"),
                                "content": contents})

    raw = paths.select(F.col(path_col).cast("string").alias(path_col)) \
        .mapInPandas(read, "path string, length long, content binary")
    return raw.select("path", F.col("content").cast("string").alias("content"), "length")
