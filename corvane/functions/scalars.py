"""Scalar functions of the report model as Spark columns (all JVM-side but for hashes of long texts)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

SEVERITIES = ("error", "warning", "info")
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def line_count(text: Column) -> Column:
    """Lines of a text: separators are LF or CRLF, a trailing one opens another line, an empty text is one line."""
    return F.size(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1))


def fnv1a(value: Column) -> Column:
    """FNV-1a, 32 bits over UTF-16 code units, as 8 hex digits.  For keys; fnv1a_text is for long texts."""
    raw = F.encode(value, "UTF-16BE")
    units = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(raw) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.hex(F.substring(raw, i * 2 + 1, F.lit(2))), 16, 10).cast("bigint"))
    step = lambda h, c: ((h.bitwiseXOR(c)) * FNV_PRIME).bitwiseAND(0xFFFFFFFF)
    h = F.aggregate(units, F.lit(FNV_OFFSET).cast("bigint"), step)
    return F.when(value.isNull(), None).when(F.length(value) == 0, F.lit(f"{FNV_OFFSET:08x}")).otherwise(F.lower(F.lpad(F.hex(h), 8, "0")))


def fnv1a_py(s: str) -> str:
    h = FNV_OFFSET
    raw = s.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(raw), 2):
        c = raw[i] << 8 | raw[i + 1]
        h = ((h ^ c) * FNV_PRIME) & 0xFFFFFFFF
    return f"{h:08x}"


@F.pandas_udf(StringType())
def fnv1a_text(col: pd.Series) -> pd.Series:
    return col.map(lambda s: None if s is None else fnv1a_py(s))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), fnv1a(F.concat_ws("|", *parts)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.locate("/", path) > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extname(path: Column) -> Column:
    """The last dot of the base name and what follows; none for names that only begin with a dot."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def clean_path(path: Column) -> Column:
    """Trimmed, with forward slashes, without one leading ./ and then one leading /."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^\./", ""), "^/", "")


def spec_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(component|service)\.ts$", ".$1.spec.ts")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def level_rank(level: Column) -> Column:
    """high, medium, low or large, medium, small as 3, 2, 1."""
    return F.when(level.isin("high", "large"), 3).when(level == "medium", 2).otherwise(1)


def pad_start(value: Column, size: int) -> Column:
    """Zeros before a number's digits; longer numbers stay whole."""
    s = value.cast("string")
    return F.when(F.length(s) >= size, s).otherwise(F.lpad(s, size, "0"))


def finding_ref(path: Column, code: Column, line: Column, column: Column) -> Column:
    at = F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(F.lit("::#L"), line.cast("string"), F.lit(":"), F.coalesce(column, F.lit(1)).cast("string"))).otherwise("")
    return F.concat(path, F.lit("::"), code, at)


def clipped(text: Column, lines: int = 14, chars: int = 900) -> Column:
    """A preview: so many lines, without white space at the end, so many characters and then three dots."""
    head = F.rtrim(F.array_join(F.slice(F.split(text, "\r?\n", -1), 1, lines), "\n"))
    return F.when(F.length(head) > chars, F.concat(F.substring(head, 1, chars), F.lit("..."))).otherwise(head)


def snippet(text: Column, line: Column, chars: int = 220) -> Column:
    s = F.trim(F.coalesce(F.get(F.split(text, "\r?\n", -1), line - 1), F.lit("")))
    return F.when(F.length(s) > chars, F.concat(F.substring(s, 1, chars), F.lit("..."))).otherwise(s)


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def signed(delta: Column) -> Column:
    return F.when(delta > 0, F.concat(F.lit("+"), delta.cast("string"))).otherwise(delta.cast("string"))


def folded(text: Column) -> Column:
    """Words and numbers of a text folded to marks, white space to one space: what normalized duplicates share."""
    out = F.regexp_replace(text, r"[0-9]+(\.[0-9]+)?", "<num>")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def locale_key(text: Column) -> Column:
    """A text that compares as a reader's locale does: letters before case, case before accents' bytes, punctuation first."""
    return F.collate(text, "UNICODE")
