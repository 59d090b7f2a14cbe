"""Structured Streaming re-aim of scheduled re-scanning.

The reference re-runs its one-shot scan from a loop, cron or timer and keeps
one timestamped report per run.  Here new files (or new Parquet files of a
text table) arrive through ``readStream``; each micro-batch is an ordinary
static DataFrame inside ``foreachBatch`` where the full batch plan runs
(suppression anti-join, syntax-tier windows and ordering are batch
operators).  Every batch writes its findings under ``batch_id=<n>`` with
``overwrite``, so a retried batch replaces its own output: the sink is
idempotent and the checkpoint makes the query resumable after a failure.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.scan import ScanOptions, scan
from ..session import ensure_checkpoint_dir
from ..sources.corpus import TEXT_TABLES, from_rows, table_path


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder inside the session's shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def text_table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """T1 source: a text table's Parquet files as a stream.  The table is one
    file or a folder of files; the stream path is a glob that only its name
    matches, as Spark takes a plain stream path for a folder."""
    schema = spark.read.parquet(table_path(sf_dir, table)).schema
    only = table_path(sf_dir, f"[{table[0]}]{table[1:]}")
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(only)
    path_expr, text_col = TEXT_TABLES[table]
    return from_rows(raw, F.expr(path_expr), F.col(text_col))


def file_tree_stream(spark: SparkSession, root: str) -> DataFrame:
    """T1 source: files arriving below ``root`` (binaryFile stream)."""
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    raw = (spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
           .load(root))
    return raw.select("path", F.col("content").cast("string").alias("content"), "length")


def start_scan_stream(corpus_stream: DataFrame, out_path: str, checkpoint: str,
                      options: ScanOptions | None = None, available_now: bool = True,
                      processing_time: str | None = None) -> StreamingQuery:
    """Run the batch scan on each micro-batch and write a
    timestamped, batch-keyed findings table (idempotent per batch)."""
    opts = options or ScanOptions(include_unknown=True)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        res = scan(batch.sparkSession, batch, ScanOptions(**{**opts.__dict__, "sort": False}))
        out = res.findings.withColumn("scanned_at", F.current_timestamp())
        out.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    w = corpus_stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def stream_scan_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental scan of ``documents`` run to completion; its findings
    must equal the batch scan."""
    out = _scratch(spark, "stream-findings")
    ckpt = _scratch(spark, "stream-checkpoint")
    q = start_scan_stream(text_table_stream(spark, sf_dir, "documents"), out, ckpt)
    q.awaitTermination()
    cols = ["rule_id", "title", "description", "severity", "confidence", "remediation", "file", "line",
            "column", "snippet"]
    return spark.read.parquet(out).select(*cols)
