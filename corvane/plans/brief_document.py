"""The work brief as lines of one JSON document: health, summary, areas by priority, tracks with their tasks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions.scalars import level_rank, locale_key
from corvane.plans.document import ADVICE
from corvane.sources.json_document import at, lines

#: Ids and titles of areas, in order, by the names that operators give them.
AREAS = {
    "lifecycle": ("lifecycle", "Lifecycle and Cleanup Risks"),
    "importCycles": ("import-cycles", "Import Cycles"),
    "oversized": ("oversized", "Oversized Components/Services"),
    "duplicates": ("duplicates", "Duplicate Code"),
    "testGaps": ("test-gaps", "Test Gaps"),
    "hotspots": ("hotspots", "Performance Hotspots"),
}
#: What each track is for.
PURPOSE = {
    "lifecycle": "End subscriptions, timers, listeners and effects with what started them.",
    "importCycles": "Untie files that import each other.",
    "oversized": "Split long files along their duties.",
    "duplicates": "Keep each block in one place.",
    "testGaps": "Add the specs that are missing.",
    "hotspots": "Begin with the files that cost most.",
}
SHOWN = 8


def totals(a) -> dict[str, int]:
    """The numbers of a brief: one row."""
    f = F.col
    life = (f("category") == "lifecycle") | f("code").startswith("lifecycle-")
    sev = lambda s, more=F.lit(True): F.count_if((f("severity") == s) & more)
    found = a.findings.agg(
        F.count("*").alias("findings"), *[sev(s).alias(s) for s in ("error", "warning", "info")], F.count_if(life).alias("lifecycle"), sev("warning", life).alias("life_warning"), sev("info", life).alias("life_info"),
        F.count_if(f("code").isin("component-large-ts", "component-large-template", "service-large-ts")).alias("large"), F.count_if(f("code").endswith("-missing-spec")).alias("gaps"),
    )
    one = [a.cycles.agg(F.count("*").alias("cycles"), F.coalesce(F.sum("node_count"), F.lit(0)).alias("cycle_files")), a.groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences")), a.hotspots.agg(F.count("*").alias("hotspots"), F.coalesce(F.max("score"), F.lit(0)).alias("top"))]
    for o in one:
        found = found.join(F.broadcast(o))  # single rows
    return {k: int(v) for k, v in found.first().asDict().items()}


def area_parts(n: dict[str, int]) -> dict[str, tuple[str, dict[str, int]]]:
    """Of each area a sentence and its numbers."""
    some = lambda count, text, none: text if count else none
    return {
        "lifecycle": (f"{n['life_warning']} warning(s), {n['life_info']} info.", {"findings": n["lifecycle"], "warning": n["life_warning"], "info": n["life_info"]}),
        "importCycles": (some(n["cycles"], f"{n['cycles']} cycle(s) across {n['cycle_files']} file(s).", "No cycles detected."), {"cycles": n["cycles"], "files": n["cycle_files"]}),
        "oversized": (some(n["large"], f"{n['large']} size-related finding(s).", "No size findings."), {"findings": n["large"]}),
        "duplicates": (some(n["groups"], f"{n['groups']} group(s), {n['occurrences']} occurrence(s).", "No duplicate groups detected."), {"groups": n["groups"], "occurrences": n["occurrences"]}),
        "testGaps": (some(n["gaps"], f"{n['gaps']} missing spec(s).", "No missing spec findings."), {"missingSpecs": n["gaps"]}),
        "hotspots": (some(n["hotspots"], f"Top hotspot score: {n['top']}.", "No hotspot scores."), {"files": n["hotspots"], "topScore": n["top"]}),
    }


def first_places(occurrences: DataFrame, most: int = SHOWN) -> DataFrame:
    """kind, hash, places: the first places of each group by path and line as text, one a line; no more are gathered."""
    text = F.concat_ws("\n", "file_path", F.col("start_line").cast("string"))
    w = Window.partitionBy("kind", "hash").orderBy(locale_key(text), text)
    x = occurrences.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    line = F.format_string("- %s:%d-%d", "file_path", "start_line", "end_line")
    return x.groupBy("kind", "hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("t")))), lambda r: r["t"]), "\n").alias("places"))


def _advice(code: Column) -> Column:
    out = F.lit("")
    for c, (why, steps) in ADVICE.items():
        out = F.when(code == c, why + "\n\nSuggested actions:\n" + "\n".join(f"- {s}" for s in steps)).otherwise(out)
    return out


def described(a, tasks: DataFrame) -> DataFrame:
    """Tasks with their descriptions."""
    code = F.get(F.split(F.get("refs", F.lit(0)), "::"), F.lit(1))
    groups = a.groups.join(first_places(a.occurrences), ["kind", "hash"], "left").select(F.col("id").alias("group"), F.format_string("Duplicate group: %s\nKind: %s\nSize: %d lines, %d tokens\n\nOccurrences:\n%s", "id", "kind", "line_count", "token_count", "places").alias("about_group"))
    size = F.when(F.col("code").endswith("-large-ts"), F.format_string("TS: %d lines (max %d)", "measure", "limit")).otherwise(F.format_string("Template: %d lines (max %d) (%s)", "measure", "limit", "detail"))
    large = a.findings.where(F.col("code").isin("component-large-ts", "component-large-template", "service-large-ts")).groupBy(F.col("source_path").alias("file")).agg(F.array_join(F.array_sort(F.collect_set(size)), "; ").alias("sizes"))
    hot = a.hotspots.select(F.col("file_path").alias("file"), F.format_string("Score: %d (complexity %d, duplication %d, missing spec %d, fan-in %d, fan-out %d)", "score", "complexity", "duplication", "spec_points", "import_fan_in", "import_fan_out").alias("about_hot"))
    subject = F.when(F.col("area") == "oversized", F.element_at(F.split("title", ": "), 2)).otherwise(F.get("affected_files", F.lit(0)))
    x = tasks.withColumn("group", F.when(F.col("area") == "duplicates", F.get("refs", F.lit(0)))).withColumn("file", F.when(F.col("area").isin("oversized", "hotspots"), subject))
    x = x.join(groups, "group", "left").join(large, "file", "left").join(hot, "file", "left")
    listed = F.concat(F.lit("Files:\n"), F.array_join(F.transform(F.slice("affected_files", 1, SHOWN), lambda f: F.concat(F.lit("- "), f)), "\n"), F.when(F.size("affected_files") > SHOWN, F.format_string("\n- and %d more", F.size("affected_files") - SHOWN)).otherwise(""))
    text = F.when(F.col("area") == "duplicates", F.col("about_group")).when(F.col("area") == "oversized", F.concat(F.lit("Size signals: "), F.coalesce("sizes", F.lit("(unknown)")))).when(F.col("area") == "hotspots", F.col("about_hot"))
    text = text.when(F.col("area").isin("importCycles", "testGaps"), F.concat(listed, F.lit("\n\n"), _advice(code))).otherwise(F.concat(F.concat_ws(", ", "affected_files"), F.lit("\n\n"), _advice(code)))
    return x.withColumn("description", F.coalesce(text, F.lit(""))).drop("group", "file", "about_group", "sizes", "about_hot")


def order() -> list[Column]:
    """Within a track: high impact, little effort, title and id in locale order."""
    return [-level_rank(F.col("impact")), level_rank(F.col("effort")), locale_key(F.col("title")), F.col("title"), F.col("id")]


def brief_lines(a, tables: dict[str, DataFrame], generated_at: str, root: str) -> DataFrame:
    spark = a.findings.sparkSession
    n, health = totals(a), tables["health"].first()
    rank = {r.area: r.priority for r in tables["areas"].collect()}  # six rows
    areas = sorted(AREAS, key=lambda k: (rank.get(k, "P2"), list(AREAS).index(k)))
    parts, one = area_parts(n), spark.range(1)
    head = {
        "schemaVersion": 1, "generatedAt": generated_at, "workspaceRoot": root, "sourceReport": {"schemaVersion": 7, "generatedAt": generated_at},
        "health": {"score": int(health.score), "grade": health.grade, "summary": f"{n['error']} error(s), {n['warning']} warning(s), {n['cycles']} cycle(s), {n['groups']} duplicate group(s)."},
        "summary": {"findings": {"total": n["findings"], "bySeverity": {s: n[s] for s in ("error", "warning", "info")}}, "importCycles": n["cycles"], "duplicateGroups": n["groups"], "hotspots": n["hotspots"]},
        "priorityAreas": [{"id": AREAS[k][0], "title": AREAS[k][1], "priority": rank.get(k, "P2"), "summary": parts[k][0], "stats": parts[k][1], "trackId": f"track-{AREAS[k][0]}"} for k in areas],
    }
    out = [lines(one, [at(0)], json.dumps(head)[:-1] + ',"tracks":[', False)]
    for i, k in enumerate(areas):
        track = {"id": f"track-{AREAS[k][0]}", "areaId": AREAS[k][0], "title": AREAS[k][1], "description": PURPOSE[k], "priority": rank.get(k, "P2")}
        out += [lines(one, [at(1), at(i)], json.dumps(track)[:-1] + ',"tasks":['), lines(one, [at(1), at(i), at(2)], "]}", False)]
    nth = F.array_position(F.array(*map(F.lit, areas)), F.col("area")).cast("int") - 1
    code = F.get(F.split(F.get("refs", F.lit(0)), "::"), F.lit(1))
    by_code = ~F.col("area").isin("duplicates", "hotspots")
    evidence = F.struct(F.when(by_code, F.array(code)).alias("findingCodes"), F.when(by_code, F.col("refs")).alias("findingRefs"), F.when(F.col("area") == "duplicates", F.col("refs")).alias("duplicateGroupIds"), F.when(F.col("area") == "hotspots", F.col("refs")).alias("hotspotFiles"))
    text = F.to_json(F.struct("id", "title", "description", F.col("affected_files").alias("affectedFiles"), "impact", "effort", "dependencies", evidence.alias("evidence")))
    out.append(lines(described(a, tables["tasks"]), [at(1), at(nth), at(1), at(-level_rank(F.col("impact"))), at(level_rank(F.col("effort")), F.col("title")), at(0, F.col("id"))], text))
    out.append(lines(one, [at(2)], "]}", False))
    all_ = out[0]
    for o in out[1:]:
        all_ = all_.unionByName(o)
    return all_


def first_tasks(tasks: DataFrame, most: int) -> DataFrame:
    """The first tasks of each area, for pages."""
    w = Window.partitionBy("area").orderBy(*order())
    return tasks.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
