"""Registered queries of the report operators, over the stand-in tables, each with SQL of its own for DuckDB.

Stand-ins: a document is a source file at source/lang/id; a document without labels lacks its spec; strong order lines (a
quantity of STRONG or more) that follow each other in an order are imports between parts; days of events are scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import scalars as X
from corvane.operators import brief, duplicates, findings as R, graph, hotspots, snapshots, tree
from corvane.plans import standin, standin_typed, views
from corvane.sources import config, normal, reports

LINES, CHARS, STRONG = 8, 8_000, 40
RULES = {"service-large-ts": "error", "component-missing-spec": "off"}
SIGNALS = {"http": "https?://", "mail": "@", "pipe": r"\|", "money": r"[$€]", "hash": "#"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", "lang", X.pad_start(F.col("doc_id"), 9)).alias("file_path"), "text", "n_chars")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("doc_id", "file_path", X.line_count(F.col("text")).cast("long").alias("line_count"), "n_chars", F.col("text").contains("@").alias("mail"))


def unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    return R.without_partner(files(spark, sf).select("doc_id", "file_path"), table(spark, sf, "labels"), "doc_id")


def findings(spark: SparkSession, sf: str) -> DataFrame:
    x = lines(spark, sf)
    none = F.lit(None).cast("long")
    fixed = lambda df, sev, cat, conf, code, msg: df.select(F.lit(sev).alias("severity"), F.lit(cat).alias("category"), F.lit(conf).alias("confidence"), F.lit(code).alias("code"), F.lit(msg).alias("message"), "file_path", none.alias("measure"))
    out = R.over_threshold(x, "line_count", LINES, "component-large-ts", "components")
    out = out.union(R.over_threshold(x, "n_chars", CHARS, "service-large-ts", "services", "info"))
    out = out.union(fixed(unlabelled(spark, sf), "warning", "components", "high", "component-missing-spec", "no labels"))
    return out.union(fixed(x.where("mail"), "error", "lifecycle", "medium", "lifecycle-unmanaged-subscribe", "mail address"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Exact and normalized blocks, whole documents; both kinds from one scan."""
    f = files(spark, sf)
    kinds = F.array(F.struct(F.lit("exact").alias("kind"), F.md5("text").alias("hash")), F.struct(F.lit("normalized").alias("kind"), F.md5(X.folded(F.col("text"))).alias("hash")))
    x = f.select("file_path", X.line_count(F.col("text")).cast("long").alias("line_count"), F.col("n_chars").cast("long").alias("token_count"), kinds.alias("kinds"))
    return x.select(F.explode("kinds").alias("k"), "file_path", F.lit(1).alias("start_line"), "line_count", "token_count").select("k.*", "file_path", "start_line", F.col("line_count").alias("end_line"), "line_count", "token_count")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where(F.col("l_quantity") >= STRONG).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    return graph.chain_edges(rows, "l_orderkey", "l_linenumber", "p")


def fans(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(table(spark, sf, "part").select(F.col("p_partkey").alias("node")), edges(spark, sf))


def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cycle_table(graph.cyclic_components(edges(spark, sf)))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    count = lambda mark: F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))
    complexity = f.select("file_path", X.line_count(F.col("text")).alias("line_count"), count(".").alias("method_count"), count(",").alias("branch_count"), (F.col("n_chars") % 97).alias("ctor_param_max"))
    b = blocks(spark, sf)
    dup = duplicates.file_stats(duplicates.occurrences(b, duplicates.repeated_hashes(b)))
    fan = fans(spark, sf).select(F.concat(F.lit("part/"), "node").alias("file_path"), "fan_in", "fan_out")
    return hotspots.scored(hotspots.assembled(complexity, dup, unlabelled(spark, sf), fan))


def all_tasks(spark: SparkSession, sf: str) -> DataFrame:
    f, b = findings(spark, sf), blocks(spark, sf)
    g = duplicates.repeated_hashes(b)
    cyc = brief.cycle_tasks(cycles(spark, sf).withColumn("nodes", F.transform("nodes", lambda n: F.concat(F.lit("part/"), n))))
    gaps = f.withColumn("expected", F.concat("file_path", F.lit(".spec")))
    parts = [cyc, brief.lifecycle_tasks(f), brief.oversize_tasks(f, "component", LINES), brief.oversize_tasks(f, "service", CHARS), brief.duplicate_tasks(g, duplicates.occurrences(b, g)), brief.gap_tasks(gaps), brief.hotspot_tasks(scores(spark, sf))]
    out = parts[0].select(*brief.TASK)
    for p in parts[1:]:
        out = out.union(p.select(*brief.TASK))
    return brief.with_dependencies(out, cyc)


def scans(spark: SparkSession, sf: str) -> DataFrame:
    sev = F.when(F.col("event_type") == "error", "error").when(F.col("event_type").isin("purchase", "signup"), "warning").otherwise("info")
    return table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("code"), sev.alias("severity"))


def _flat(tasks: DataFrame) -> DataFrame:
    return tasks.select("id", "area", "title", F.array_join("affected_files", ",").alias("files"), "impact", "effort", F.array_join("refs", ",").alias("refs"), F.array_join("dependencies", ",").alias("dependencies"))


# -- queries ------------------------------------------------------------------------------------------------------------


def line_counts(s, d):
    return lines(s, d).select("doc_id", "file_path", "line_count")


def size_findings(s, d):
    return R.override(findings(s, d), RULES).select("severity", "category", "confidence", "code", "message", "file_path")


def severity_counts(s, d):
    return R.severity_counts(R.override(findings(s, d), RULES))


def category_pivot(s, d):
    return R.category_counts(findings(s, d))


def code_counts(s, d):
    return R.code_counts(findings(s, d))


def grouped_findings(s, d):
    return R.grouped(findings(s, d)).select("severity", "severity_rank", "code", "n", F.col("items")[0]["file_path"].alias("first_file"), F.element_at("items", -1)["file_path"].alias("last_file"))


def filtered_findings(s, d):
    return R.matching(findings(s, d), severity="warning", code="Large", text="SRC1").select("code", "message", "file_path")


def sorted_findings(s, d):
    return R.ranked(findings(s, d).where("category <> 'components'")).select("rank", "severity", "code", "file_path")


def missing_specs(s, d):
    return unlabelled(s, d).select("file_path", F.concat("file_path", F.lit(".spec")).alias("expected"))


def concern_signals(s, d):
    return R.concern_signals(files(s, d), SIGNALS).where("n_signals >= 2").select("file_path", F.array_join("signals", ",").alias("signals"), "n_signals")


def duplicate_groups(s, d):
    return duplicates.group_key(duplicates.repeated_hashes(blocks(s, d))).select("id", "kind", "hash", "occurrences", "line_count", "token_count", "first_file", "sort_key")


def duplicate_occurrences(s, d):
    b = blocks(s, d)
    return duplicates.occurrences(b, duplicates.repeated_hashes(b)).select("kind", "hash", "file_path", "line_count")


def duplicate_file_stats(s, d):
    b = blocks(s, d)
    return duplicates.file_stats(duplicates.occurrences(b, duplicates.repeated_hashes(b)))


def duplicate_view(s, d):
    g = duplicates.view(duplicates.repeated_hashes(blocks(s, d)), "exact", 5)
    return R.number_rows(g, [F.desc("line_count"), F.desc("occurrences"), F.col("hash")], "rank").select("rank", "hash", "line_count", "occurrences")


def import_edges(s, d):
    return edges(s, d)


def import_fans(s, d):
    return fans(s, d)


def import_components(s, d):
    return graph.cyclic_components(edges(s, d))


def import_cycles(s, d):
    return cycles(s, d).select("scc", "node_count", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"))


def graph_summary(s, d):
    e = edges(s, d)
    return graph.summary(table(s, d, "part").select("p_partkey"), e, graph.cyclic_components(e))


def hotspot_scores(s, d):
    return scores(s, d)


def hotspot_top(s, d):
    return R.number_rows(hotspots.top(scores(s, d), 50), [F.desc("score"), F.col("file_path")], "rank").select("rank", "file_path", "score")


def health(s, d):
    e = edges(s, d)
    c = graph.cycle_table(graph.cyclic_components(e))
    return brief.health(findings(s, d), c, duplicates.repeated_hashes(blocks(s, d)), scores(s, d))


def brief_tasks(s, d):
    return _flat(all_tasks(s, d))


def brief_areas(s, d):
    t = all_tasks(s, d).checkpoint()
    return brief.areas(findings(s, d), cycles(s, d), t, duplicates.repeated_hashes(blocks(s, d)), scores(s, d))


def scan_snapshots(s, d):
    return snapshots.snapshot_counts(scans(s, d), "day")


def scan_deltas(s, d):
    return snapshots.consecutive(snapshots.snapshot_counts(scans(s, d), "day"), "day", ["total", "error", "warning", "info"])


def scan_code_deltas(s, d):
    n = snapshots.snapshot_codes(scans(s, d), "day")
    ends = scans(s, d).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    n = n.join(F.broadcast(ends))  # one row
    return snapshots.code_deltas(n.where("day = a").select("code", "n"), n.where("day = b").select("code", "n")).select("code", F.col("before").cast("long"), F.col("after").cast("long"), "delta")


def scan_history(s, d):
    return snapshots.newest(snapshots.snapshot_counts(scans(s, d), "day"), "day", "day", 20).select("day", "total", "recency")


def scan_records(s, d):
    """Snapshot records of all days: counts by category and severity, and by code, as rows."""
    r = snapshots.records(scans(s, d).withColumn("category", F.substring("code", 1, 1)), "day")
    cats = r.select("day", "findingsTotal", F.explode("findingsByCategory").alias("name", "v")).select("day", "findingsTotal", F.lit("category").alias("part"), "name", F.col("v.error").alias("error"), F.col("v.warning").alias("warning"), F.col("v.info").alias("info"))
    codes = r.select("day", "findingsTotal", F.explode("findingsByCode").alias("name", "n")).select("day", "findingsTotal", F.lit("code").alias("part"), "name", F.col("n").alias("error"), F.lit(0).cast("long").alias("warning"), F.lit(0).cast("long").alias("info"))
    return cats.union(codes)


def scan_comparison(s, d):
    """Every day's record against the day before: differences and the codes that changed most."""
    r = snapshots.records(scans(s, d).withColumn("category", F.lit("events")), "day").withColumn("then", F.date_format(F.date_add(F.to_date("day"), -1), "yyyy-MM-dd"))
    pairs = snapshots.compared(r.withColumnRenamed("day", "base").drop("then"), r.withColumnRenamed("then", "base"), ["base"])
    top = F.transform("topCodeDeltas", lambda c: F.concat_ws(" ", c["code"], *[c[k].cast("long").cast("string") for k in ("from", "to", "delta")]))
    return pairs.select("base", F.col("delta.findingsTotal").alias("total"), *[F.col(f"delta.findingsBySeverity.{x}").alias(x) for x in ("error", "warning", "info")], F.array_join(top, ";").alias("codes"))


def report_rows(s, d):
    """Classes and duplicate groups of reports that documents were made into, some with fields of wrong types."""
    i = F.col("doc_id")
    odd = lambda n, good, bad: F.when(i % n == 0, bad).otherwise(good)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    klass = F.concat(F.lit('{"id":'), odd(7, quoted(F.concat(F.lit("c"), i)), F.lit("5")), F.lit(',"name":'), F.to_json(F.struct(F.substring(F.coalesce("text", F.lit("")), 1, 9).alias("t"))), F.lit(',"startLine":'), odd(5, i.cast("string"), F.lit('"x"')), F.lit(',"endLine":9.5,"filePath":"f"}'))
    klass = F.regexp_replace(klass, r'"name":\{"t":(.*)\},"startLine"', '"name":$1,"startLine"')
    place = F.concat(F.lit('{"filePath":'), odd(3, F.lit('"p.ts"'), F.lit("null")), F.lit(',"startLine":1,"endLine":'), i.cast("string"), F.lit("}"))
    group = F.concat(F.lit('{"kind":'), odd(4, F.lit('"exact"'), F.lit('"other"')), F.lit(',"hash":'), odd(6, quoted(i.cast("string")), F.lit("[]")), F.lit(',"occurrences":['), place, F.lit(","), place, F.lit(",7]}"))
    report = F.concat(F.lit('{"symbols":{"classes":[null,'), klass, F.lit(']},"duplicateGroups":['), group, F.lit("]}"))
    docs = table(s, d, "documents").where("doc_id is not null").select(i.cast("string").alias("name"), F.try_parse_json(report).alias("doc"))
    classes = normal.table(docs, "classes").select("document", F.lit("class").alias("part"), "id", F.col("name").alias("label"), F.col("startLine").alias("n"))
    groups = normal.table(docs, "groups").select("document", F.lit("group").alias("part"), "id", F.col("kind").alias("label"), F.size("occurrences").cast("double").alias("n"))
    return classes.union(groups)


def folder_tree(s, d):
    p = table(s, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("file_path"), F.char_length("html").alias("chars"))
    return tree.folder_counts(p, measures=("chars",))


def strict_props(s, d):
    """A number in a text field is missing, and the other way round (typed accessors of tolerant report parsing)."""
    v = F.try_parse_json("props")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.k", "variant"))
    e = table(s, d, "events").select("event_id", F.when(kind == "BIGINT", F.try_variant_get(v, "$.k", "bigint")).alias("k"), F.when(kind == "STRING", F.try_variant_get(v, "$.k", "string")).alias("k_text"))
    return e.select("event_id", "k", "k_text")


def stable_ids(s, d):
    return files(s, d).select("file_path", X.stable_id("file", F.col("file_path")).alias("id"), X.dirname(F.col("file_path")).alias("dir"), X.basename(F.col("file_path")).alias("base"))


EXCLUDED = ("src1", "src2/", "src1*/de/**", "src?/fr/*0")


def excluded_files(s, d):
    f = files(s, d).select("file_path")
    return f.where(config.excluded(F.col("file_path"), EXCLUDED))


def unmatched_uses(s, d):
    """Clicks of a user and day without a purchase, the first of each (uses without their clean-up)."""
    e = table(s, d, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    use = e.where("event_type = 'click'").groupBy("user_id", "day").agg(F.min("event_id").alias("event_id"), F.count("*").alias("uses"))
    return use.join(e.where("event_type = 'purchase'").select("user_id", "day").distinct(), ["user_id", "day"], "left_anti")


def capped_references(s, d):
    """Of each part the first 10 order lines by ship date (references kept per method)."""
    from pyspark.sql import Window

    keys = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = table(s, d, "lineitem").select("l_partkey", *keys)
    nth = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*keys))
    return li.withColumn("nth", nth).where("nth <= 10").select("l_partkey", "l_orderkey", "l_linenumber", "nth")


def page_links(s, d):
    """Distinct link targets of each page, in text order (specifiers of a file)."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(s, d, "pages").select("page_id", F.explode(F.array_distinct(links)).alias("target")).where("target <> ''")


def repeated_links(s, d):
    """Links that a page has more than once (duplicate entries of a list)."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(s, d, "pages").select("page_id", F.explode(links).alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("n")).where("n > 1")


def source_context(s, d):
    """Line 3 of every document with one line around it; shorter documents clamp to their last line."""
    f = files(s, d).select("file_path", "text")
    return reports.source_lines(f, f.select("file_path", F.lit(3).alias("line")), 1).select("file_path", F.col("highlight").cast("long"), F.col("number").cast("long"), "source")


def previews(s, d):
    f = files(s, d)
    return f.select("file_path", X.clipped(F.col("text"), 2, 60).alias("preview"), X.snippet(F.col("text"), F.lit(1), 40).alias("snippet"), X.html_escaped(X.snippet(F.col("text"), F.lit(1), 40)).alias("escaped"))


def signal_matrix(s, d):
    return views.signal_matrix(findings(s, d)).select("file_path", "on_destroy", *views.COLUMNS)


def labelled_duplicates(s, d):
    """Occurrences with the label of their document, or its path where there is none (left join with a fallback)."""
    b = blocks(s, d)
    o = duplicates.occurrences(b, duplicates.repeated_hashes(b)).select("kind", "hash", "file_path")
    names = files(s, d).select("doc_id", "file_path").join(table(s, d, "labels"), "doc_id").select("file_path", F.concat(F.lit("quality "), "quality").alias("label"))
    return o.join(names, "file_path", "left").select("kind", "hash", "file_path", F.coalesce("label", "file_path").alias("label"))


def page_counts(s, d):
    return views.page_counts(findings(s, d), cycles(s, d), duplicates.repeated_hashes(blocks(s, d)), scores(s, d))


def categories(s, d):
    return R.number_rows(findings(s, d).select("category").distinct(), [F.col("category")], "rank")


NAMES = """line_counts size_findings severity_counts category_pivot code_counts grouped_findings filtered_findings sorted_findings missing_specs
concern_signals duplicate_groups duplicate_occurrences duplicate_file_stats duplicate_view import_edges import_fans import_components import_cycles
graph_summary hotspot_scores hotspot_top health brief_tasks brief_areas scan_snapshots scan_deltas scan_code_deltas scan_history scan_records scan_comparison report_rows folder_tree
strict_props stable_ids excluded_files unmatched_uses capped_references page_links repeated_links source_context previews signal_matrix
labelled_duplicates page_counts categories""".split()
QUERIES = {name: globals()[name] for name in NAMES} | standin.QUERIES | standin_typed.QUERIES
NAMES += [*standin.QUERIES, *standin_typed.QUERIES]
