"""Views over audits and reports: signal matrix, page counts, HTML, method references."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions.scalars import severity_rank
from corvane.operators import findings as R

#: What a lifecycle code says about each sign (others are unknown).
SIGNS = {
    "lifecycle-broken-destroy-subject": {"take_until": "yes", "cleanup": "no"},
    "lifecycle-unmanaged-subscribe": {"take_until_destroyed": "no", "take_until": "no", "unsubscribe": "no", "cleanup": "no"},
    "lifecycle-fromEvent-subscribe-no-cleanup": {"take_until_destroyed": "no", "take_until": "no", "unsubscribe": "no", "cleanup": "no"},
    "lifecycle-subscription-field-not-unsubscribed": {"unsubscribe": "no", "cleanup": "no"},
    "lifecycle-addEventListener-no-remove": {"cleanup": "no"},
    "lifecycle-setInterval-no-clearInterval": {"cleanup": "no"},
    "lifecycle-requestAnimationFrame-no-cancelAnimationFrame": {"cleanup": "no"},
    "lifecycle-effect-missing-onCleanup": {"cleanup": "no"},
    "lifecycle-toSignal-manualCleanup": {"cleanup": "no"},
}
COLUMNS = ("take_until_destroyed", "take_until", "unsubscribe", "cleanup")


def sign(column: str) -> Column:
    out = F.lit("unknown")
    for code, by in SIGNS.items():
        if column in by:
            out = F.when(F.col("code") == code, by[column]).otherwise(out)
    return out


def signal_matrix(found: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Each lifecycle finding with yes, no or unknown for every sign; whether its class (by file and class) has ngOnDestroy comes from
    facts, which needs the findings' cls."""
    x = found.where((F.col("category") == "lifecycle") | F.col("code").startswith("lifecycle-"))
    if facts is not None:
        has = facts.where("kind = 'on_destroy'").select("file_path", "cls").distinct().withColumn("destroys", F.lit("yes"))
        x = x.join(has, ["file_path", "cls"], "left").withColumn("on_destroy", F.when(F.col("cls").isNull(), "unknown").otherwise(F.coalesce("destroys", F.lit("no")))).drop("destroys")
    else:
        x = x.withColumn("on_destroy", F.lit("unknown"))
    return x.withColumns({c: sign(c) for c in COLUMNS})


def page_counts(found: DataFrame, cycles: DataFrame, groups: DataFrame, scores: DataFrame) -> DataFrame:
    rows = [("findings", found), ("lifecycle", found.where("category = 'lifecycle'")), ("cycles", cycles), ("duplicates", groups), ("hotspots", scores)]
    out = None
    for name, df in rows:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("page"), "n")
        out = one if out is None else out.union(one)
    return out


def capped(references: DataFrame, most: int = 200) -> DataFrame:
    """Of each method the first `most` references, by place."""
    w = Window.partitionBy("method_id").orderBy("file_path", "line", "col")
    return references.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def symbol_tree(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Each class with the sorted ids of its methods (none: empty)."""
    ids = methods.groupBy(F.col("class_id").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("method_ids"))
    return classes.join(ids, "id", "left").withColumn("method_ids", F.coalesce("method_ids", F.array().cast("array<string>")))


def file_details(classes: DataFrame, methods: DataFrame, scores: DataFrame, references: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Each file with classes: counts of classes, methods, references to its methods, duplicate groups, and its score."""
    count = lambda df, name, what="*": df.groupBy("file_path").agg((F.count("*") if what == "*" else F.count_distinct(*what)).alias(name))
    out = count(classes, "classes")
    used = references.join(methods.select(F.col("id").alias("method_id"), F.col("file_path").alias("home")), "method_id").drop("file_path").withColumnRenamed("home", "file_path")
    for df in (count(methods, "methods"), count(used, "references"), count(occurrences, "groups", ("kind", "hash"))):
        out = out.join(df, "file_path", "left")
    return out.join(scores.select("file_path", "score"), "file_path", "left").fillna(0)


def method_details(methods: DataFrame, references: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Each method with the number of its references and of the duplicate groups its body is in."""
    used = references.groupBy(F.col("method_id").alias("id")).agg(F.count("*").cast("long").alias("references"))
    name = F.concat_ws(".", "class_name", "name")
    blocks = occurrences.groupBy("file_path", F.col("method").alias("full")).agg(F.count_distinct("kind", "hash").cast("long").alias("groups"))
    x = methods.withColumn("full", name).join(used, "id", "left").join(blocks, ["file_path", "full"], "left").drop("full")
    return x.fillna(0, ["references", "groups"])


def drilldown(methods: DataFrame, references: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Each method (id, file_path, start_line, end_line) with its references by place and the groups of repeated blocks that it
    holds, as lists; references are capped before, so a list is bounded by the cap or by the method's own lines."""
    used = capped(references).groupBy(F.col("method_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("file_path", "line", "col"))).alias("references"))
    blocks = occurrences.select("file_path", "kind", "hash", F.col("start_line").alias("at"))
    held = methods.select("id", "file_path", "start_line", "end_line").join(blocks, "file_path").where("at between start_line and end_line")
    held = held.groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws(":", F.lit("dup"), "kind", "hash"))).alias("groups"))
    out = methods.join(used, "id", "left").join(held, "id", "left")
    none = F.array().cast("array<string>")
    return out.withColumn("references", F.coalesce("references", F.array().cast("array<struct<file_path:string,line:int,col:int>>"))).withColumn("groups", F.coalesce("groups", none))


def nested_folders(rows: list, root: str = "") -> dict:
    """Folder rows (folder, parent, files) as nested objects, on the driver, for small trees; reports nest by lines instead."""
    made = {r["folder"]: {"path": r["folder"], "files": r["files"], "folders": []} for r in rows}
    for r in sorted(rows, key=lambda r: r["folder"]):
        if r["folder"] != root and r["parent"] in made:
            made[r["parent"]]["folders"].append(made[r["folder"]])
    return made[root]


def visible_rows(folders: DataFrame, expanded: DataFrame) -> DataFrame:
    """Folders whose ancestors are all expanded, in depth-first order (by path)."""
    parts = F.split("folder", "/")
    up = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, 1, d), "/")))
    need = folders.select("folder", F.explode_outer(up).alias("above"))
    closed = need.where("above is not null").join(expanded.select(F.col("folder").alias("above")), "above", "left_anti").select("folder").distinct()
    return R.number_rows(folders.join(closed, "folder", "left_anti"), [F.col("folder")], "row")


def html_report(found: DataFrame, groups: DataFrame, occurrences: DataFrame, scores: DataFrame, cycles: DataFrame, title: str = "Audit") -> str:
    """One page: counts, ten hotspots, ten duplicate groups with five places each, findings by category, cycles.  What is
    collected is limited or small by nature (a page of findings)."""
    e = lambda v: html.escape(str(v), quote=True)
    row = lambda *c: "<tr>" + "".join(f"<td>{e(v)}</td>" for v in c) + "</tr>"
    box = lambda name, rows: f"<h2>{e(name)}</h2><table>{''.join(rows)}</table>"
    counts = R.severity_counts(found).first()
    top = scores.orderBy(F.desc("score"), "file_path").limit(10).collect()
    first = groups.orderBy(F.desc("sort_key")).limit(10)
    places = occurrences.join(first.select("kind", "hash"), ["kind", "hash"], "left_semi").groupBy("kind", "hash").agg(F.slice(F.array_sort(F.collect_list(F.struct("file_path", "start_line", "end_line"))), 1, 5).alias("at"))
    dup = first.join(places, ["kind", "hash"]).orderBy(F.desc("sort_key")).collect()
    body = [f"<p>{counts.total} findings: {counts.error} error, {counts.warning} warning, {counts.info} info</p>"]
    body.append(box("Hotspots", [row(r.file_path, r.score) for r in top]))
    body.append(box("Duplicates", [row(r.kind, r.occurrences, r.line_count, ", ".join(f"{o.file_path}:{o.start_line}-{o.end_line}" for o in r["at"])) for r in dup]))
    body.append(box("Categories", [row(r.category, r.error, r.warning, r.info, r.total) for r in R.category_counts(found).orderBy("category").collect()]))
    rows = found.orderBy("category", severity_rank(F.col("severity")), "file_path", "code").select("severity", "category", "code", "file_path", "message").toLocalIterator()
    body.append(box("Findings", [row(*r) for r in rows]))
    body.append(box("Cycles", [row(r.node_count, ", ".join(map(str, r.nodes))) for r in cycles.orderBy("scc").collect()]))
    return f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1>" + "".join(body) + "\n"
