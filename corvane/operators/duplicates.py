"""Duplicate blocks: grouping by hash, statistics of files, views.

Blocks have kind, hash, file_path, start_line, end_line, line_count, token_count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions.scalars import pad_start


def repeated_hashes(blocks: DataFrame) -> DataFrame:
    """Hashes with two occurrences or more in two files or more, with counts and the representative (first by path and line).

    One partial aggregation; distinct files are told apart by their smallest and greatest path, so nothing is collected."""
    first = F.min_by(F.struct("line_count", "token_count", "file_path"), F.struct("file_path", "start_line"))
    out = blocks.groupBy("kind", "hash").agg(F.count("*").cast("long").alias("occurrences"), F.min("file_path").alias("lo"), F.max("file_path").alias("hi"), first.alias("first"))
    out = out.where("occurrences >= 2 and lo <> hi")
    return out.select("kind", "hash", "occurrences", F.col("first.line_count").alias("line_count"), F.col("first.token_count").alias("token_count"), F.col("first.file_path").alias("first_file"))


def group_key(df: DataFrame) -> DataFrame:
    """id and the descending sort key kind, padded count, hash."""
    return df.withColumn("id", F.concat_ws(":", F.lit("dup"), "kind", "hash")).withColumn("sort_key", F.concat_ws("\n", "kind", pad_start(F.col("occurrences"), 6), "hash"))


def occurrences(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """The blocks that belong to groups (long form of the nested occurrences)."""
    return blocks.join(groups.select("kind", "hash"), ["kind", "hash"], "left_semi")


def file_stats(members: DataFrame) -> DataFrame:
    """Of each file: distinct groups, occurrences, duplicated lines."""
    per = members.groupBy("file_path", "kind", "hash").agg(F.count("*").alias("n"), F.sum("line_count").alias("lines"))
    return per.groupBy("file_path").agg(F.count("*").cast("long").alias("dup_groups"), F.sum("n").cast("long").alias("dup_occurrences"), F.sum("lines").cast("long").alias("dup_lines"))


def view(groups: DataFrame, kind: str = "all", min_lines: int = 10) -> DataFrame:
    """Groups of a kind with so many lines, most lines and then most occurrences first (see findings.number_rows)."""
    out = groups.where(F.col("line_count") >= max(1, min_lines))
    return out if kind == "all" else out.where(F.col("kind") == kind)
