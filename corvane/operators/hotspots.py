"""Hotspot scores: a key-union of the measures of a file, then points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

MEASURES = ("line_count", "method_count", "ctor_param_max", "branch_count", "dup_groups", "dup_occurrences", "dup_lines", "missing_spec", "fan_in", "fan_out")


def assembled(complexity: DataFrame, dups: DataFrame, missing: DataFrame, fans: DataFrame) -> DataFrame:
    """One row a file that any input has, absent measures 0.  The inputs are united and summed: one shuffle instead of four
    outer joins, with partial sums before it."""

    def padded(df: DataFrame) -> DataFrame:
        return df.select("file_path", *[(F.col(m) if m in df.columns else F.lit(0)).cast("long").alias(m) for m in MEASURES])

    rows = [padded(complexity), padded(dups), padded(missing.select("file_path", F.lit(1).alias("missing_spec")).distinct()), padded(fans)]
    return reduce(DataFrame.union, rows).groupBy("file_path").agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])


def steps(measure: str, per: int, most: int) -> Column:
    return F.least(F.lit(most), F.floor(F.col(measure) / per)).cast("long")


def scored(files: DataFrame) -> DataFrame:
    """Points for complexity, duplication, missing specs, fan-in and fan-out, and their sum."""
    points = {
        "complexity": steps("line_count", 50, 20) + steps("method_count", 5, 20) + steps("branch_count", 5, 20) + steps("ctor_param_max", 4, 10),
        "duplication": F.least(F.lit(30), F.col("dup_occurrences") * 5).cast("long"),
        "spec_points": (F.least(F.lit(1), F.col("missing_spec")) * 10).cast("long"),
        "import_fan_in": steps("fan_in", 5, 10),
        "import_fan_out": steps("fan_out", 10, 10),
    }
    out = files.withColumns(points)
    return out.withColumn("score", reduce(lambda a, b: a + b, [F.col(p) for p in points]))


def top(scores: DataFrame, n: int | None = 50) -> DataFrame:
    """The n highest scores, ties by path (a top-k of each partition before anything is merged)."""
    out = scores.orderBy(F.desc("score"), "file_path")
    return out if n is None else out.limit(n)


def path_contains(scores: DataFrame, text: str) -> DataFrame:
    return scores.where(F.lower("file_path").contains(text.strip().lower())) if text.strip() else scores
