"""Repeated blocks of all callables: functions, function expressions, methods, constructors, accessors, arrows with a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions.scalars import locale_key
from corvane.operators import duplicates


def of(facts: DataFrame) -> DataFrame:
    """kind, hash, file_path, start_line, end_line, line_count, token_count: each block by its text and by its shape."""
    both = F.explode(F.array(F.struct(F.lit("exact").alias("kind"), F.col("of").alias("hash")), F.struct(F.lit("normalized").alias("kind"), F.col("other").alias("hash"))))
    x = facts.where("kind = 'block'").select(both.alias("k"), "file_path", F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.col("n").alias("line_count"), F.col("n2").alias("token_count"))
    return x.select("k.*", "file_path", "start_line", "end_line", "line_count", "token_count")


def repeated(blocks: DataFrame) -> DataFrame:
    """Groups of two places or more in two files or more; line and token counts are those of the first place by path and line as
    text, in locale order.  One partial aggregation; the two files are told apart by smallest and greatest path."""
    place = locale_key(F.concat_ws("\n", "file_path", F.col("start_line").cast("string")))
    first = F.min_by(F.struct("line_count", "token_count", "file_path"), F.struct(place, "file_path", "start_line"))
    out = blocks.groupBy("kind", "hash").agg(F.count("*").cast("long").alias("occurrences"), F.min("file_path").alias("lo"), F.max("file_path").alias("hi"), first.alias("first"))
    out = out.where("occurrences >= 2 and lo <> hi").select("kind", "hash", "occurrences", "first.line_count", "first.token_count", F.col("first.file_path").alias("first_file"))
    return duplicates.group_key(out)
