"""A workspace as tables: one row a file, folders of builds and tools left out, links not followed.  `files` lists level by level on
executors; the data source deals out the folders under the root.

    spark.dataSource.register(WorkspaceSource)
    spark.read.format("workspace").option("root", "/path").load()
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.operators.session import checkpointing

#: Folder names that are never entered.
SKIPPED = frozenset(["node_modules", "dist", ".angular", ".git", "coverage", ".corvane", "out-tsc"])
SCHEMA = "file_path string, text string"
SUFFIXES = (".ts", ".html", ".css", ".scss", ".json")


def walk(root: str):
    """Regular files as (relative path, bytes), in a stable order; unreadable folders are skipped."""
    todo = [""]
    while todo:
        rel = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in SKIPPED:
                    todo.append(path)
            elif e.is_file(follow_symlinks=False):
                yield path, e.stat(follow_symlinks=False).st_size


def entries(root: str, folder: str) -> list[tuple[str, bool, int]]:
    """(path, whether it is a folder, bytes) of a folder's entries that count; an unreadable folder has none."""
    out = []
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for e in found:
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    if e.name not in SKIPPED:
                        out.append((path, True, 0))
                elif e.is_file(follow_symlinks=False):
                    out.append((path, False, e.stat(follow_symlinks=False).st_size))
    except OSError:
        return []
    return out


def listed(spark: SparkSession, root: str) -> DataFrame:
    """file_path, size: the same files as `walk`, one level of folders a round.  Tasks list the folders of a level, the driver only
    learns whether there are more; rounds follow the depth of the tree, not its size."""
    checkpointing(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                rows = entries(root, folder)
                for k in range(0, len(rows), 10_000):  # a folder of any width
                    some = rows[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.bool_(), pa.int64()))], names=["path", "folder", "size"])

    level, found = spark.range(1).select(F.lit("").alias("folder")), []
    n = 1
    while n:
        dealt = level.repartition(min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "folder") if n > 1 else level
        here = dealt.mapInArrow(scan, "path string, folder boolean, size long").checkpoint()
        found.append(here.where("not folder").select(F.col("path").alias("file_path"), "size"))
        level = here.where("folder").select(F.col("path").alias("folder"))
        n = level.count()
    return reduce(DataFrame.union, found)


def texts(files: DataFrame, root: str, suffixes: tuple[str, ...] = SUFFIXES, part_bytes: int = 4 << 20) -> DataFrame:
    """file_path and text; text is null where the suffix isn't of interest.  Files are dealt out so that a task reads about
    part_bytes; a file that is gone or unreadable has no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        held: list[str | None] = []
        size = 0
        for b in batches:
            for path in b.column(0).to_pylist():
                text = None
                if path.endswith(suffixes):
                    try:
                        with open(os.path.join(root, path), encoding="utf-8", errors="replace", newline="") as f:
                            text = f.read()
                    except OSError:
                        continue
                paths.append(path)
                held.append(text)
                size += len(text or "")
                if size >= part_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.string())], names=["file_path", "text"])
                    paths, held, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.string())], names=["file_path", "text"])

    bytes_ = files.agg(F.sum(F.col("size") + 1024)).first()[0] or 0
    return files.select("file_path").repartition(max(1, -(-bytes_ // part_bytes)), "file_path").mapInArrow(read, SCHEMA)


class WorkspaceReader(DataSourceReader):
    """For `spark.read.format("workspace")`: folders under the root, one partition each, listed and read where they run."""

    def __init__(self, root: str, suffixes: tuple[str, ...]):
        self.root, self.suffixes = root, suffixes

    def partitions(self):
        return [Folder(path) for path, folder, _ in entries(self.root, "") if folder] + [Folder("")]

    def read(self, partition):
        if partition.path:
            found = (os.path.join(partition.path, p) for p, _ in walk(os.path.join(self.root, partition.path)))
        else:
            found = (p for p, folder, _ in entries(self.root, "") if not folder)
        for path in found:
            text = None
            if path.endswith(self.suffixes):
                try:
                    with open(os.path.join(self.root, path), encoding="utf-8", errors="replace", newline="") as f:
                        text = f.read()
                except OSError:
                    continue
            yield path, text


class Folder(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkspaceSource(DataSource):
    @classmethod
    def name(cls):
        return "workspace"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        o = self.options
        return WorkspaceReader(o["root"], tuple(o["suffixes"].split(",")) if "suffixes" in o else SUFFIXES)


def files(spark: SparkSession, root: str) -> DataFrame:
    """file_path and text of all files of a workspace, in a folder that all executors see."""
    return texts(listed(spark, root), root)


#: Fixed value: the workspace manifest.
MANIFEST = "angular.json"


def projects(root: str, name: str = MANIFEST) -> list[tuple[str, str | None, str | None]]:
    """(project, root, source root) of the manifest, by name.  Broken JSON is an error, a missing file too."""
    with open(os.path.join(root, name), encoding="utf-8") as f:
        try:
            doc = json.load(f)
        except ValueError as e:
            raise ValueError(f"Failed to parse {name}: {e}") from e
    if not isinstance(doc, dict):
        raise ValueError(f"Failed to parse {name}: no object")
    found = doc.get("projects") if isinstance(doc.get("projects"), dict) else {}
    text = lambda v: v if isinstance(v, str) else None
    out = []
    for key in sorted(found, key=lambda k: (k.casefold(), k)):
        p = found[key] if isinstance(found[key], dict) else {}
        base, src = text(p.get("root")), text(p.get("sourceRoot"))
        if not src:
            src = f"{base}/src" if base and os.path.isdir(os.path.join(root, base, "src")) else None
        out.append((key, base, src))
    return out
