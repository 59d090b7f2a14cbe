"""S1 with the walk's own rules, as a Spark Python data source (``file_tree``).

Spark's file index hides names that start with ``.`` or ``_``, follows symbolic
links and lists below directories that a scan skips.  This source walks the tree
itself: a directory that is skipped or excluded is never listed, only regular
files are read, links are not followed, and what cannot be listed or read is a
row with its error.

The driver lists level by level, only until there are ``width`` directories to
deal out; each of them is one task, which lists and reads all below it.  Files
beside those directories are dealt by name, at most ``FILES_A_TASK`` to a task.
The driver keeps names of directories only, and at most one level of them.

Paths are plain paths or ``file:`` ones, of a folder that all executors mount.
Names are compared and ordered as they are; a row's ``rel`` is its path below
the root, so nothing above the root can prune anything.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES_A_TASK = 1_000


@dataclass
class Deal(InputPartition):
    """A task: everything below ``rel`` (whole), or share ``part`` of ``parts`` of the files in it; or a known error."""

    rel: str
    whole: bool = False
    part: int = 0
    parts: int = 1
    error: str | None = None


class Walk:
    """Listing and reading by the rules of a scan."""

    def __init__(self, root: str, exclude: list[str], max_file_bytes: int | None):
        from ..operators.eligibility import compile_globs

        path = root[5:] if root.startswith("file:") else root
        self.root = ("/" + path.lstrip("/") if root.startswith("file:") else path).rstrip("/") or "/"
        self.globs, self.max_file_bytes = compile_globs(exclude), max_file_bytes

    def path(self, rel: str) -> str:
        return f"{self.root.rstrip('/')}/{rel}" if rel else self.root

    def skipped(self, rel: str, name: str, directory: bool) -> bool:
        from ..operators.eligibility import glob_match
        from .catalog import SKIP_DIRS

        return (directory and name in SKIP_DIRS) or glob_match(self.globs, rel, name)

    def enters(self) -> bool:
        """The root is a directory itself (no link to one), and neither skipped nor excluded."""
        name = os.path.basename(self.root) or "/"
        return not os.path.islink(self.root) and os.path.isdir(self.root) and not self.skipped(".", name, True)

    def entries(self, rel: str) -> tuple[list[str], list[str]]:
        """(directories, files) of a directory that the scan wants, by their paths below the root."""
        below, files = [], []
        with os.scandir(self.path(rel)) as found:
            for e in found:
                own = f"{rel}/{e.name}" if rel else e.name
                directory = e.is_dir(follow_symlinks=False)
                if not (directory or e.is_file(follow_symlinks=False)) or self.skipped(own, e.name, directory):
                    continue
                (below if directory else files).append(own)
        return sorted(below), sorted(files)

    def row(self, rel: str) -> tuple:
        path = self.path(rel)
        try:
            size = os.lstat(path).st_size
            if self.max_file_bytes is not None and size > self.max_file_bytes:
                return path, rel, None, size, None
            with open(path, "rb") as f:
                data = f.read()
            return path, rel, data, len(data), None
        except OSError as e:
            return path, rel, None, None, f"{e.strerror or e}: {path}"

    def failed(self, rel: str, e: OSError) -> tuple:
        return self.path(rel), rel, None, None, f"{e.strerror or e}: {self.path(rel)}"

    def rows(self, deal: Deal) -> Iterator[tuple]:
        if deal.error is not None:
            yield self.path(deal.rel), deal.rel, None, None, deal.error
            return
        left = [deal.rel]
        while left:
            rel = left.pop()
            try:
                below, files = self.entries(rel)
            except OSError as e:
                yield self.failed(rel, e)
                continue
            for f in files:
                if deal.whole or zlib.crc32(os.fsencode(f)) % deal.parts == deal.part:
                    yield self.row(f)
            if deal.whole:
                left.extend(reversed(below))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        size = options.get("maxfilebytes")
        self.walk = Walk(options["path"], json.loads(options.get("exclude", "[]")), int(size) if size else None)
        self.width = int(options.get("width", "64"))

    def partitions(self) -> list[InputPartition]:
        walk = self.walk
        if not os.path.lexists(walk.root):
            return [Deal("", error=f"No such file or directory: {walk.root}")]
        if not walk.enters():
            return [Deal("", parts=0, error=None)]
        deals, level = [], [""]
        while level and len(level) < self.width:
            following = []
            for rel in level:
                try:
                    below, files = walk.entries(rel)
                except OSError as e:
                    deals.append(Deal(rel, error=walk.failed(rel, e)[4]))
                    continue
                following += below
                parts = -(-len(files) // FILES_A_TASK)
                deals += [Deal(rel, part=k, parts=parts) for k in range(parts)]
            level = following
        return deals + [Deal(rel, whole=True) for rel in level] or [Deal("", parts=0)]

    def read(self, partition: Deal) -> Iterator[tuple]:
        if partition.parts:
            yield from self.walk.rows(partition)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, rel string, content binary, length bigint, error string"

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def tree_corpus(spark: SparkSession, root: str, exclude: list[str] | None = None, max_file_bytes: int | None = None,
                width: int | None = None) -> DataFrame:
    """corpus(path, rel, content, length, error) of a directory tree; ``rel`` and ``error`` are used by the scan."""
    spark.dataSource.register(TreeSource)
    reader = (spark.read.format("file_tree").option("exclude", json.dumps(exclude or []))
              .option("width", str(width or 4 * spark.sparkContext.defaultParallelism)))
    if max_file_bytes is not None:
        reader = reader.option("maxFileBytes", str(max_file_bytes))
    return reader.load(root).select("path", "rel", F.col("content").cast("string").alias("content"), "length", "error")
