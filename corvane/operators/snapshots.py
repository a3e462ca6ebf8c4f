"""Scan snapshots: counts of a report at a time, differences, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvane.operators.findings import number_rows

SEVERITIES = ("error", "warning", "info")


def snapshot_counts(findings: DataFrame, key: str) -> DataFrame:
    """Of each scan: findings by severity and the number of codes."""
    return findings.groupBy(key).agg(F.count("*").cast("long").alias("total"), *[F.count_if(F.col("severity") == s).cast("long").alias(s) for s in ("error", "warning", "info")], F.count_distinct("code").cast("long").alias("codes"))


def snapshot_codes(findings: DataFrame, key: str) -> DataFrame:
    return findings.groupBy(key, "code").agg(F.count("*").cast("long").alias("n"))


def consecutive(counts: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Each scan beside the one before: deltas of all measures.  counts has a row a scan; scans are numbered by ranges of a sort and
    joined with the number before, so no task holds them all."""
    x = number_rows(counts.select(key, *measures), [F.col(key)], "nth")
    before = x.select((F.col("nth") + 1).alias("nth"), F.col(key).alias("base"), *[F.col(m).alias(f"before_{m}") for m in measures])
    return x.join(before, "nth").select(key, *[(F.col(m) - F.col(f"before_{m}")).alias(f"{m}_delta") for m in measures], "base")


def code_deltas(old: DataFrame, new: DataFrame, most: int | None = 12) -> DataFrame:
    """Codes of two snapshots (code, n) whose counts differ, greatest change first, ties by code."""
    x = old.withColumnRenamed("n", "before").join(new.withColumnRenamed("n", "after"), "code", "full_outer").fillna(0, ["before", "after"])
    x = x.withColumn("delta", F.col("after") - F.col("before")).where("delta <> 0").orderBy(F.desc(F.abs("delta")), "code")
    return x if most is None else x.limit(most)


def newest(history: DataFrame, order: str, tie: str, most: int = 20) -> DataFrame:
    """What a history keeps: its newest scans, with their recency (1 = latest)."""
    kept = history.orderBy(F.desc(order), F.desc(tie)).limit(most)
    return kept.withColumn("recency", F.row_number().over(Window.orderBy(F.desc(order), F.desc(tie))).cast("long"))


def records(found: DataFrame, key: str) -> DataFrame:
    """One record a scan: findingsTotal, findingsBySeverity, findingsByCategory (category and severity) and findingsByCode as maps.

    Counts are partial before the shuffle; a map has an entry for each code or category of a scan."""
    codes = found.groupBy(key, "code").agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("findingsByCode"))
    by = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    name = F.coalesce("category", F.lit("unknown")).alias("category")
    each = found.groupBy(key, name).agg(*by)
    table = lambda: F.create_map(*[x for s in SEVERITIES for x in (F.lit(s), F.col(s))])
    cats = each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.struct(*SEVERITIES).alias("v"))))).alias("c"))
    cats = cats.select(key, F.transform_values("c", lambda _, v: F.create_map(*[x for s in SEVERITIES for x in (F.lit(s), v[s])])).alias("findingsByCategory"))
    total = each.groupBy(key).agg(*[F.sum(s).alias(s) for s in SEVERITIES]).select(key, sum(F.col(s) for s in SEVERITIES).alias("findingsTotal"), table().alias("findingsBySeverity"))
    return total.join(cats, key).join(codes, key)


def compared(old: DataFrame, new: DataFrame, by: list[str] | None = None, most: int = 12) -> DataFrame:
    """Pairs of scan records (equal in the columns of `by`) with `delta`, eleven differences, and `topCodeDeltas`, the codes whose
    counts differ: greatest change first, ties in the order of the old record and then of the new one."""
    counts = ["duplicatesGroupCount", "hotspotsCount", "findingsTotal"]
    used = ["id", "summary", "importGraph", *counts, "findingsBySeverity", "findingsByCode"]
    a, b = (x.select(*(by or []), F.struct(*[c for c in used if c in x.columns]).alias(n)) for x, n in ((old, "from"), (new, "to")))
    both = a.join(b, by) if by else a.join(F.broadcast(b))  # without keys each side is one record
    have = [c for c in used if c in old.columns]
    diff = lambda f: (F.coalesce(F.col(f"to.{f}"), F.lit(0)) - F.coalesce(F.col(f"from.{f}"), F.lit(0))).alias(f.split(".")[-1])
    parts = [diff(f"summary.{k}") for k in ("projects", "components", "services", "routes") if "summary" in have] + [diff("findingsTotal"), F.struct(*[diff(f"findingsBySeverity.{s}") for s in SEVERITIES]).alias("findingsBySeverity")]
    parts += [diff(c) for c in counts[:2] if c in have] + [diff(f"importGraph.{k}").alias("import" + k.capitalize()) for k in ("nodes", "edges", "cycles") if "importGraph" in have]
    none = lambda side: F.coalesce(F.col(f"{side}.findingsByCode"), F.create_map().cast("map<string,double>"))
    zipped = F.map_entries(F.map_zip_with(none("from"), none("to"), lambda k, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("from"), F.coalesce(y, F.lit(0)).alias("to"))))
    rows = F.transform(zipped, lambda e, i: F.struct((-F.abs(e["value"]["to"] - e["value"]["from"])).alias("d"), i.alias("i"), F.struct(e["key"].alias("code"), e["value"]["from"].alias("from"), e["value"]["to"].alias("to"), (e["value"]["to"] - e["value"]["from"]).alias("delta")).alias("r")))
    top = F.transform(F.slice(F.array_sort(F.filter(rows, lambda e: e["d"] != 0)), 1, most), lambda e: e["r"])
    return both.select(*(by or []), "from", "to", F.struct(*parts).alias("delta"), top.alias("topCodeDeltas"))


def picked(history: DataFrame, from_id: str, to_id: str) -> DataFrame:
    """The comparison of two scans of a history by id; no row where an id is unknown or both are the same."""
    if not from_id or from_id == to_id:
        return compared(history.limit(0), history.limit(0))
    one = lambda i: history.where(F.col("id") == i).limit(1)
    return compared(one(from_id), one(to_id))
