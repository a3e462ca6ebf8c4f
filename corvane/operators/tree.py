"""Folder trees in long form: every file counts for all folders above it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ancestors(files: DataFrame, path: str = "file_path") -> DataFrame:
    """A row for each file and folder above it; the root is the empty path."""
    parts = F.split(path, "/")
    depth = F.explode(F.sequence(F.lit(0), F.size(parts) - 1))
    return files.withColumn("depth", depth).withColumn("folder", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))


def folder_counts(files: DataFrame, path: str = "file_path", measures: tuple[str, ...] = ()) -> DataFrame:
    """Of each folder: depth, parent, files below it, folders directly in it, sums of measures.

    Files are counted by their own folder first, so what is exploded grows with folders, not with files."""
    own = files.withColumn("dir", F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("")))
    own = own.groupBy("dir").agg(F.count("*").alias("files"), *[F.sum(m).alias(m) for m in measures])
    up = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/"))), lambda d: F.array_join(F.slice(F.split("dir", "/"), 1, d), "/")))
    x = own.withColumn("folder", F.explode(up)).groupBy("folder").agg(F.sum("files").cast("long").alias("files"), *[F.sum(m).cast("long").alias(m) for m in measures])
    x = x.withColumn("depth", F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))).cast("long"))
    x = x.withColumn("parent", F.when(F.col("folder") == "", None).when(F.instr("folder", "/") > 0, F.regexp_replace("folder", "/[^/]*$", "")).otherwise(F.lit("")))
    kids = x.where("parent is not null").groupBy(F.col("parent").alias("folder")).agg(F.count("*").cast("long").alias("folders"))
    return x.join(kids, "folder", "left").withColumn("folders", F.coalesce("folders", F.lit(0)))


def under(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files under each source root (equal, or the root and a slash before the rest): roots are configuration, so the join on
    the prefix is by the ancestors of a file, an equi-join."""
    above = ancestors(files).select(*files.columns, "folder").union(files.withColumn("folder", F.col("file_path")))
    return above.join(F.broadcast(roots.select(F.col("source_root").alias("folder"), "project")), "folder").withColumnRenamed("folder", "source_root")


def under_any(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files under one source root or more, each once; the roots, which are configuration, come to the files."""
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.array_join(F.slice(parts, 1, d), "/"))
    return files.join(F.broadcast(roots.agg(F.collect_set("source_root").alias("roots"))), F.arrays_overlap(above, F.col("roots")), "left_semi")
