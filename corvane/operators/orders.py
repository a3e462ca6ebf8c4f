"""The orders of a report: compound texts in locale order, numbers in them as texts ("10" before "9").

Each is a list of sort keys for `findings.number_rows`, which deals rows out by ranges of the collated key; the texts themselves
follow, so that texts that a locale holds equal have one order as well."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corvane.functions.scalars import locale_key


def compound(*parts: str) -> list[Column]:
    text = F.concat_ws("\n", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return [locale_key(text), text]


def findings(ordinal: str = "ord") -> list[Column]:
    """Of one analyzer: path and code, then the order in which they were found."""
    return [locale_key(F.concat_ws("\n", "file_path", "code")), F.col(ordinal)]


def classes() -> list[Column]:
    return compound("file_path", "name", "start_line")


def methods() -> list[Column]:
    return compound("file_path", "class_name", "name", "start_line")


def occurrences() -> list[Column]:
    return compound("file_path", "start_line")


def references() -> list[Column]:
    return compound("method_id", "file_path", "line", "col")


def paths(*columns: str) -> list[Column]:
    """Files, folders, routes (path and route in one text), edges (source, then target)."""
    return [k for c in columns or ("file_path",) for k in compound(c)]


def duplicate_candidates() -> list[Column]:
    """Greatest saving first, then the id."""
    return [F.desc(F.col("line_count") * F.col("occurrences")), *compound("id")]
