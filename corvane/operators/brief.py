"""The work brief: health, tasks with dependencies, areas with priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions.scalars import clamp, finding_ref, grade, level_rank, stable_id

#: The order of areas.
AREAS = ("lifecycle", "importCycles", "oversized", "duplicates", "testGaps", "hotspots")
#: Titles of lifecycle tasks by code; the path follows in brackets.
TITLES = {
    "lifecycle-unmanaged-subscribe": "Add cleanup for long-lived subscription",
    "lifecycle-fromEvent-subscribe-no-cleanup": "Add cleanup for fromEvent subscription",
    "lifecycle-broken-destroy-subject": "Fix broken destroy$ cleanup pattern",
    "lifecycle-subscription-field-not-unsubscribed": "Unsubscribe stored Subscription field",
    "lifecycle-addEventListener-no-remove": "Remove event listener on destroy",
    "lifecycle-setInterval-no-clearInterval": "Clear interval on destroy",
    "lifecycle-requestAnimationFrame-no-cancelAnimationFrame": "Cancel requestAnimationFrame on destroy",
    "lifecycle-effect-missing-onCleanup": "Add onCleanup() to effect() side-effect",
    "lifecycle-toSignal-manualCleanup": "Review toSignal manualCleanup usage",
}
OTHER_TITLE = "Lifecycle cleanup risk"
TASK = ["id", "area", "title", "affected_files", "impact", "effort", "refs"]


def health(findings: DataFrame, cycles: DataFrame, groups: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: counts, score 0..100 and grade."""
    f = findings.agg(*[F.count_if(F.col("severity") == s).cast("long").alias(f"n_{s}") for s in ("error", "warning", "info")])
    one = lambda df, name, cond=None: df.agg((F.count("*") if cond is None else F.count_if(cond)).cast("long").alias(name))
    x = f.join(F.broadcast(one(cycles, "n_cycles"))).join(F.broadcast(one(groups, "n_groups"))).join(F.broadcast(one(scores, "n_hot", F.col("score") >= 40)))
    score = 100 - 12 * F.col("n_error") - 4 * F.col("n_warning") - F.col("n_info") - F.least(F.lit(20), 5 * F.col("n_cycles"))
    score = score - F.least(F.lit(20), F.floor(F.col("n_groups") / 3)) - F.least(F.lit(15), 2 * F.col("n_hot"))
    x = x.withColumn("score", clamp(score, 0, 100).cast("long"))
    return x.withColumn("grade", grade(F.col("score")))


def _ref(line: str | None = None) -> F.Column:
    none = F.lit(None).cast("long")
    return finding_ref(F.col("file_path"), F.col("code"), F.col(line) if line else none, none)


def cycle_tasks(cycles: DataFrame) -> DataFrame:
    """cycles: nodes (sorted paths), node_count."""
    return cycles.select(
        stable_id("task-cycle", F.array_join("nodes", "|")).alias("id"), F.lit("importCycles").alias("area"), F.format_string("Break import cycle of %d files", "node_count").alias("title"), F.col("nodes").alias("affected_files"), F.lit("high").alias("impact"), F.when(F.col("node_count") <= 3, "medium").otherwise("large").alias("effort"), F.array(F.concat(F.element_at("nodes", 1), F.lit("::import-cycle"))).alias("refs")
    )


def lifecycle_tasks(findings: DataFrame) -> DataFrame:
    small = F.col("code").isin(*[c for c in TITLES if c != "lifecycle-unmanaged-subscribe"])
    titles = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    title = F.concat(F.coalesce(titles[F.col("code")], F.lit(OTHER_TITLE)), F.lit(" ("), F.col("file_path"), F.lit(")"))
    x = findings.where((F.col("category") == "lifecycle") | F.col("code").startswith("lifecycle-"))
    return x.select(stable_id("task-lifecycle", _ref()).alias("id"), F.lit("lifecycle").alias("area"), title.alias("title"), F.array("file_path").alias("affected_files"), F.when(F.col("severity").isin("error", "warning"), "high").otherwise("medium").alias("impact"), F.when(small, "small").otherwise("medium").alias("effort"), F.array(_ref()).alias("refs"))


def oversize_tasks(findings: DataFrame, kind: str, limit: int) -> DataFrame:
    """One task a file with findings of excess size; measure is the line count of the source file."""
    x = findings.where(F.col("code").isin(f"{kind}-large-ts", f"{kind}-large-template"))
    x = x.groupBy("file_path").agg(F.max(F.when(F.col("code") == f"{kind}-large-ts", F.col("measure"))).alias("lines"), F.array_sort(F.collect_set(_ref())).alias("refs"), F.max(F.col("template") if "template" in findings.columns else F.lit(None).cast("string")).alias("template"))
    files = F.array_sort(F.array_distinct(F.array_compact(F.array("file_path", "template"))))
    large = F.coalesce(F.col("lines") >= 2 * limit, F.lit(False))
    return x.select(stable_id("task-oversize", F.lit(kind), F.col("file_path")).alias("id"), F.lit("oversized").alias("area"), F.concat(F.lit(f"Split large {kind}: "), "file_path").alias("title"), files.alias("affected_files"), F.lit("medium").alias("impact"), F.when(large, "large").otherwise("medium").alias("effort"), "refs")


def duplicate_tasks(groups: DataFrame, members: DataFrame) -> DataFrame:
    files = members.groupBy("kind", "hash").agg(F.array_sort(F.collect_set("file_path")).alias("affected_files"))
    x = groups.join(files, ["kind", "hash"])
    big = F.col("line_count") >= 25
    return x.select(
        stable_id("task-dup", F.concat_ws(":", F.lit("dup"), "kind", "hash"), F.col("kind"), F.col("hash")).alias("id"), F.lit("duplicates").alias("area"), F.format_string("Merge %s block of %d lines in %d places", "kind", "line_count", "occurrences").alias("title"), "affected_files", F.when(big | (F.col("occurrences") >= 4), "high").otherwise("medium").alias("impact"), F.when(big | (F.size("affected_files") >= 4), "large").otherwise("medium").alias("effort"), F.array(F.concat_ws(":", F.lit("dup"), "kind", "hash")).alias("refs")
    )


def gap_tasks(findings: DataFrame) -> DataFrame:
    """findings of missing specs, with expected (the spec's path)."""
    x = findings.where(F.col("code").endswith("-missing-spec"))
    return x.select(stable_id("task-spec", F.col("expected")).alias("id"), F.lit("testGaps").alias("area"), F.concat(F.lit("Add spec "), "expected").alias("title"), F.array_sort(F.array_distinct(F.array("file_path", "expected"))).alias("affected_files"), F.lit("medium").alias("impact"), F.lit("small").alias("effort"), F.array(_ref()).alias("refs"))


def hotspot_tasks(scores: DataFrame, least: int = 30, most: int = 25) -> DataFrame:
    x = scores.where(F.col("score") >= least).orderBy(F.desc("score"), "file_path").limit(most)
    hot = F.col("score") >= 60
    return x.select(stable_id("task-hot", F.col("file_path")).alias("id"), F.lit("hotspots").alias("area"), F.concat(F.lit("Reduce hotspot "), "file_path").alias("title"), F.array("file_path").alias("affected_files"), F.when(hot, "high").otherwise("medium").alias("impact"), F.when(hot, "large").otherwise("medium").alias("effort"), F.array("file_path").alias("refs"))


def with_dependencies(tasks: DataFrame, cycles: DataFrame) -> DataFrame:
    """Each task with the sorted ids of the cycle tasks that touch one of its files (cycle tasks have none)."""
    by_file = cycles.select(F.col("id").alias("dep"), F.explode("affected_files").alias("file"))
    deps = tasks.where("area <> 'importCycles'").select("id", F.explode("affected_files").alias("file")).join(by_file, "file").groupBy("id").agg(F.array_sort(F.collect_set("dep")).alias("dependencies"))
    return tasks.join(deps, "id", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))


def task_order() -> list:
    """Within a track: impact, then little effort, then title and id."""
    return [-level_rank(F.col("impact")), level_rank(F.col("effort")), F.col("title"), F.col("id")]


def areas(findings: DataFrame, cycles: DataFrame, tasks: DataFrame, groups: DataFrame, scores: DataFrame) -> DataFrame:
    """area, priority, n (what the priority counts), tasks; six rows from single-row aggregates."""
    life = findings.where((F.col("category") == "lifecycle") | F.col("code").startswith("lifecycle-"))
    row = lambda df, area, n, p: df.agg(n.cast("long").alias("n")).select(F.lit(area).alias("area"), p(F.coalesce("n", F.lit(0))).alias("priority"), F.coalesce("n", F.lit(0)).alias("n"))
    bands = lambda *steps: lambda n: _bands(n, steps)
    weight = F.coalesce(F.max(F.when(F.col("severity").isin("error", "warning"), 2).otherwise(1)), F.lit(0))
    rows = [
        life.agg(F.count("*").cast("long").alias("n"), weight.alias("w")).select(F.lit("lifecycle").alias("area"), _bands(F.col("w"), ((2, "P0"), (1, "P1"))).alias("priority"), "n"),
        row(cycles, "importCycles", F.count("*"), bands((1, "P0"))),
        row(tasks.where("area = 'oversized'"), "oversized", F.count("*"), bands((10, "P0"), (1, "P1"))),
        row(groups, "duplicates", F.count("*"), bands((15, "P0"), (1, "P1"))),
        row(findings.where(F.col("code").endswith("-missing-spec")), "testGaps", F.count("*"), bands((20, "P1"))),
        row(scores, "hotspots", F.max("score"), bands((70, "P0"), (40, "P1"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    n = tasks.groupBy("area").agg(F.count("*").cast("long").alias("tasks"))
    return out.join(F.broadcast(n), "area", "left").withColumn("tasks", F.coalesce("tasks", F.lit(0)))  # at most one row an area


def _bands(n, steps):
    out = F.lit("P2")
    for least, name in reversed(steps):
        out = F.when(n >= least, name).otherwise(out)
    return out
