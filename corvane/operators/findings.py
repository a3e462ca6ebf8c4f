"""Findings: threshold rules, severity overrides, filters, sorts and counts.

A findings table has severity, category, confidence, code, message, file_path (others pass through)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions.scalars import SEVERITIES, severity_rank
from corvane.operators.session import checkpointing


def over_threshold(files: DataFrame, measure: str, limit: int, code: str, category: str, severity: str = "warning", confidence: str = "high", at_least: bool = False) -> DataFrame:
    """A finding for each file whose measure is over the limit (or at least the limit)."""
    m = F.col(measure)
    return files.where(m >= limit if at_least else m > limit).select(
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        F.lit(confidence).alias("confidence"),
        F.lit(code).alias("code"),
        F.format_string(f"{measure} is %d (limit {limit})", m).alias("message"),
        "file_path",
        m.cast("long").alias("measure"),
    )


def override(findings: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rules map codes to a severity or to off: off drops a finding, others replace its severity.  Rules are configuration
    of bounded size, so they become one CASE and no join."""
    known = {c: s for c, s in rules.items() if s in (*SEVERITIES, "off")}
    if not known:
        return findings
    rule = F.lit(None).cast("string")
    for code, severity in known.items():
        rule = F.when(F.col("code") == code, severity).otherwise(rule)
    return findings.where(F.coalesce(rule, F.lit("")) != "off").withColumn("severity", F.coalesce(rule, "severity"))


def matching(findings: DataFrame, severity: str = "all", category: str = "all", code: str = "", text: str = "", in_code: bool = False) -> DataFrame:
    """Equal severity and category, and case-insensitive substrings of the code and of message, path and reason (in_code: of code,
    message and path, as in the lifecycle view)."""
    out = findings
    if severity != "all":
        out = out.where(F.col("severity") == severity)
    if category != "all":
        out = out.where(F.col("category") == category)
    if code.strip():
        out = out.where(F.lower("code").contains(code.strip().lower()))
    if text.strip():
        parts = [F.coalesce(c, F.lit("")) for c in (("code", "message", "file_path") if in_code else ("message", "file_path", "why_it_matters")) if c in findings.columns]
        out = out.where(F.lower(F.concat_ws("\n", *parts)).contains(text.strip().lower()))
    return out


def order_of(by: str) -> list[Column]:
    path, code = F.col("file_path"), F.col("code")
    rank = severity_rank(F.col("severity"))
    keys = {"severity": [rank], "code": [code], "path": [path], "lifecycle": [rank, code]}[by]
    return [*keys, path, F.col("message")]


def ranked(findings: DataFrame, by: str = "severity") -> DataFrame:
    """Ordinals of a sort, for views: rank within the whole table by range partitions, not in one task."""
    return number_rows(findings, order_of(by), "rank")


def number_rows(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """1, 2, ... in the order of keys: rows are dealt by range, numbered within each range, and shifted by the ranges before.
    The sorted rows are kept by a checkpoint, as they are read twice and must be dealt alike."""
    checkpointing(df.sparkSession)
    x = df.orderBy(*keys).withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()).checkpoint()
    first = x.groupBy("part").agg(F.count("*").alias("n"), F.min("seq").alias("lo"))
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = first.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    return x.join(F.broadcast(base.select("part", "lo", "before")), "part").withColumn(name, (F.col("before") + F.col("seq") - F.col("lo") + 1).cast("long")).drop("part", "seq", "lo", "before")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").cast("long").alias("total"), *[F.count_if(F.col("severity") == s).cast("long").alias(s) for s in SEVERITIES])


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(*[F.count_if(F.col("severity") == s).cast("long").alias(s) for s in SEVERITIES], F.count("*").cast("long").alias("total"))


def code_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count("*").cast("long").alias("n"))


def grouped(findings: DataFrame, sample: int | None = None) -> DataFrame:
    """severity -> code -> findings, for tree views: severities in rank order, paths and messages sorted within a code.  With a
    sample only its rows of a code are gathered."""
    key = ["severity", "code"]
    few = findings
    if sample:
        w = Window.partitionBy(*key).orderBy("file_path", "message")
        few = findings.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= sample)
    items = few.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("file_path", "message"))).alias("items"))
    out = findings.groupBy(*key).agg(F.count("*").cast("long").alias("n")).join(items, key)
    return out.select(*key, "n", "items", severity_rank(F.col("severity")).alias("severity_rank"))


def without_partner(files: DataFrame, partners: DataFrame, key: str) -> DataFrame:
    """Files that have no row in the other table (missing specs)."""
    return files.join(partners.select(key).distinct(), key, "left_anti")


def concern_signals(files: DataFrame, signals: dict[str, str]) -> DataFrame:
    """For each file the sorted names of the signals whose pattern its text matches, one scan for all patterns."""
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(name)) for name, p in signals.items()]))
    return files.withColumn("signals", found).withColumn("n_signals", F.size("signals").cast("long"))
