"""Helpers shared by the operators of this subpackage.

Task-side functions are shipped by value, so executors need numpy, pyarrow and
the tokenizer libraries, but not this package on their path.
"""

from __future__ import annotations

import hashlib
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ciphersift.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules["ciphersift.llm"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_inputs(docs: DataFrame, keep: list[str], **kinds: str) -> tuple[DataFrame, list[str]]:
    """``keep`` and the columns in ``kinds``, cast to these types, with the names of the latter.

    A kept column of the right type is its own input, so that a task gets no text twice.
    """
    own = {c: c in keep and docs.schema[c].dataType.simpleString() == kind for c, kind in kinds.items()}
    names = [c if own[c] else f"__llm_{c}" for c in kinds]
    return docs.select(*[F.col(f"`{c}`") for c in keep],
                       *[F.col(c).cast(kinds[c]).alias(n) for c, n in zip(kinds, names) if not own[c]]), names


def least_rows(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The ``most`` least rows by the hashes in ``order``; rows that agree in all of them count once.

    The driver sees one threshold, so the bound holds for rows, however often an id repeats.
    """
    last = rows.select(*order).distinct().orderBy(*order).limit(most).agg(F.max(F.struct(*order))).first()[0]
    if last is None:
        return rows.limit(0)
    return rows.filter(F.struct(*order) <= F.struct(*map(F.lit, last))).dropDuplicates(order)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`scratch_path` named, through Hadoop's file system API."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker process (a cache between tasks)."""
    mod = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    return mod.__dict__.setdefault(name, {})


def content_name(what: object) -> str:
    """A name for a worker's cache: equal only for equal contents, whatever ran before in the session."""
    return hashlib.blake2b(cloudpickle.dumps(what), digest_size=16).hexdigest()


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of a column; null counts as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a column; null counts as the empty text."""
    import pyarrow.compute as pc

    return [b"" if t is None else t for t in pc.cast(column, pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``max_bytes`` of text at most (one row at least).

    Rows are only regrouped: every row and every whole text comes through.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def crc_split(doc_id: int | None, parts: int) -> int:
    """crc32 of the id as text, modulo ``parts`` (a null id counts as the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
