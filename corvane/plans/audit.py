"""The audit of a workspace: facts joined into findings, graph, symbols, duplicates, hotspots."""

from __future__ import annotations

import os
import re
from collections.abc import Container, Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions import scalars as X
from corvane.operators import brief, duplicates, findings as R, graph, hotspots, tree, types
from corvane.operators.session import checkpointing
from corvane.plans import brief_document, document, views
from corvane.sources import config as C, facts as FACTS, json_document, typed, workspace as W

MAX_INJECTIONS, MAX_ROUTE_LINES, SHOWN = 8, 250, 10


@dataclass
class Audit:
    """Lazy tables of one audit: each is a plan that is made when it is first asked for.  sections: the facts that are read of the
    sources; an audit that is asked for few tables needs few of them."""

    config: C.Config
    projects: DataFrame
    files: DataFrame
    paths: tuple = (None, None)
    sections: Container[str] = frozenset(FACTS.SECTIONS)

    @cached_property
    def kept(self) -> DataFrame:
        return self.files.where(~C.excluded(F.col("file_path"), self.config.exclude))

    @cached_property
    def roots(self) -> DataFrame:
        return self.projects.where("coalesce(source_root, '') <> ''").withColumn("source_root", F.regexp_replace(X.clean_path(F.col("source_root")), "/+$", ""))

    @cached_property
    def owned(self) -> DataFrame:
        return tree.under(self.kept.select("file_path"), self.roots).select("file_path", "project", "source_root")

    @cached_property
    def sources(self) -> DataFrame:
        """The files of any project; texts stay where they are."""
        return tree.under_any(self.kept, self.roots)

    @cached_property
    def facts(self) -> DataFrame:
        """Kept, so that sources are parsed once; everything else is a plan over them."""
        return FACTS.extract(self.sources, self.sections).checkpoint()

    def of(self, *kinds: str) -> DataFrame:
        if missing := FACTS.sections_of(*kinds) - set(self.sections):
            raise ValueError(f"this audit reads no {', '.join(sorted(missing))}")
        return _of(self.facts, *kinds)

    @cached_property
    def artifacts(self) -> DataFrame:
        return self.of("artifact").select("file_path", F.col("key").alias("artifact")).join(self.owned, "file_path").select("project", "artifact", "file_path").distinct()

    @cached_property
    def routes(self) -> DataFrame:
        return self.of("route").select("file_path", F.col("key").alias("path")).join(self.owned, "file_path").select("project", "file_path", "path").distinct()

    @cached_property
    def nodes(self) -> DataFrame:
        return self.sources.where(FACTS.analyzable(F.col("file_path"))).select("file_path")

    @cached_property
    def edges(self) -> DataFrame:
        return graph.resolve(self.of("import").select("file_path", F.col("key").alias("spec")), self.nodes).checkpoint()

    @cached_property
    def cycles(self) -> DataFrame:
        return graph.cycle_table(graph.cyclic_components(self.edges))

    def found(self, *parts: str) -> DataFrame:
        """The findings of some analyzers: components, services, routes, cycles, lifecycle."""
        of = lambda kind: self.artifacts.where(F.col("artifact") == kind).select("file_path").distinct()
        make = {
            "components": lambda: component_findings(self.facts, self.files, of("component"), self.config),
            "services": lambda: service_findings(self.facts, self.files, of("injectable"), self.config),
            "routes": lambda: route_findings(self.facts),
            "cycles": lambda: cycle_findings(self.cycles),
            "lifecycle": lambda: lifecycle_findings(self.facts),
        }
        return R.override(_all([make[p]() for p in parts]), self.config.rules)

    @cached_property
    def findings(self) -> DataFrame:
        return self.found("components", "services", "routes", "cycles", "lifecycle").checkpoint()

    @cached_property
    def complexity(self) -> DataFrame:
        return self.of("complexity").select("file_path", F.col("n").alias("line_count"), F.col("n2").alias("class_count"), F.col("n3").alias("method_count"), F.col("n4").alias("ctor_param_max"), F.col("n5").alias("branch_count"))

    @cached_property
    def classes(self) -> DataFrame:
        return self.of("class").select(F.concat(F.lit("class:"), "cls").alias("id"), F.col("key").alias("name"), "file_path", F.col("line").alias("start_line"), F.col("n").alias("end_line"))

    @cached_property
    def methods(self) -> DataFrame:
        method_id = F.concat(F.lit("method:"), "file_path", F.lit("#"), _class_name(), F.lit("."), "key", F.lit("@"), "line")
        return self.of("method").select(method_id.alias("id"), F.col("key").alias("name"), "file_path", F.concat(F.lit("class:"), "cls").alias("class_id"), _class_name().alias("class_name"), F.col("value").alias("visibility"), F.col("line").alias("start_line"), F.col("n").alias("end_line"), F.struct(F.col("n2").alias("line_count"), F.col("n3").alias("branch_count"), F.col("n4").alias("parameter_count")).alias("metrics"))

    @cached_property
    def blocks(self) -> DataFrame:
        both = F.explode(F.array(F.struct(F.lit("exact").alias("kind"), F.col("key").alias("hash")), F.struct(F.lit("normalized").alias("kind"), F.col("value").alias("hash"))))
        return self.of("block").select(both.alias("k"), "file_path", F.col("line").alias("start_line"), F.col("n").alias("end_line"), F.col("n2").alias("line_count"), F.col("n3").alias("token_count"), F.col("extra").alias("preview"), F.concat(_class_name(), F.lit("."), "method").alias("method")).select("k.*", "file_path", "start_line", "end_line", "line_count", "token_count", "preview", "method")

    @cached_property
    def groups(self) -> DataFrame:
        return duplicates.group_key(duplicates.repeated_hashes(self.blocks))

    @cached_property
    def occurrences(self) -> DataFrame:
        return duplicates.occurrences(self.blocks, self.groups)

    @cached_property
    def fans(self) -> DataFrame:
        return graph.degrees(self.nodes.select(F.col("file_path").alias("node")), self.edges)

    @cached_property
    def hotspots(self) -> DataFrame:
        gaps = self.found("components", "services").where(F.col("code").endswith("-missing-spec")).select("file_path")
        return hotspots.scored(hotspots.assembled(self.complexity, duplicates.file_stats(self.occurrences), gaps, self.fans.withColumnRenamed("node", "file_path")))

    @cached_property
    def uses(self) -> DataFrame:
        """Uses of methods, by the types of their receivers; found when they are first asked for, since it takes rounds of joins."""
        found = types.references(typed.extract(self.sources, kinds=typed.MEANING).checkpoint(), self.nodes, *self.paths)
        return views.capped(found.join(self.methods.select(F.col("id").alias("method_id"), "class_name", "name"), "method_id")).checkpoint()

    @cached_property
    def references(self) -> DataFrame:
        """Uses with the text of their lines."""
        text = self.sources.select("file_path", "text")
        return self.uses.join(text, "file_path").withColumn("snippet", X.snippet(F.col("text"), F.col("line"))).drop("text").checkpoint()


def _class_name() -> Column:
    return F.regexp_extract("cls", r"#([^@]*)@\d+$", 1)


def _of(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("kind").isin(*kinds))


def finding(df: DataFrame, severity: str, category: str, confidence: str, code: str, message: Column, path: str | Column = "file_path", line: bool = False, measure: Column | None = None, limit: Column | None = None, detail: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(code).alias("code"), message.alias("message"), (F.col(path) if isinstance(path, str) else path).alias("file_path"), F.col("file_path").alias("source_path"),
        (F.col("line") if line else none).cast("int").alias("line"), (F.col("col") if line else none).cast("int").alias("column"), (measure if measure is not None else none).cast("long").alias("measure"), (limit if limit is not None else none).cast("long").alias("limit"), (detail if detail is not None else none).cast("string").alias("detail"), (F.col("cls") if line else none).cast("string").alias("cls"),
    )


def component_findings(facts: DataFrame, files: DataFrame, paths: DataFrame, cfg: C.Config) -> DataFrame:
    """Rules for files with a component artifact and the decorator call."""
    t = cfg.thresholds
    mine = facts.join(_of(facts, "component_gate").select("file_path").distinct(), "file_path", "left_semi").join(paths, "file_path", "left_semi")
    p = F.col("file_path")
    size = _of(mine, "complexity")
    out = [finding(_of(mine, "component_class").where(F.col("n") > MAX_INJECTIONS), "warning", "components", "high", "component-many-injections", F.format_string("%s takes %d constructor parameters", p, F.col("n")), measure=F.col("n"), limit=F.lit(MAX_INJECTIONS))]
    out.append(finding(_of(mine, "http_call"), "warning", "components", "high", "component-http-calls", F.format_string("%s sends requests itself (%s)", p, F.col("value")), detail=F.col("key")))
    out.append(finding(_of(mine, "dup_import").groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("key")), "info", "components", "high", "component-standalone-duplicate-imports", F.format_string("%s lists imports twice: %s", p, F.col("key")), detail=F.col("key")))
    out.append(_large(size, "components", "component-large-ts", t["componentTsLines"]))
    out.append(missing_spec(mine.select("file_path").distinct(), files, "component", "components"))
    url = _of(mine, "template_url").withColumn("template", _join(X.dirname(p), F.col("key"))).where(~F.col("template").startswith(".."))
    html = files.select(F.col("file_path").alias("template"), X.line_count(F.col("text")).alias("lines")).where(~C.excluded(F.col("template"), cfg.exclude))
    big = url.join(html, "template").where(F.col("lines") > t["componentTemplateLines"])
    out.append(finding(big, "warning", "components", "high", "component-large-template", F.format_string("%s has %d lines", F.col("template"), F.col("lines")), path="template", measure=F.col("lines"), limit=F.lit(t["componentTemplateLines"]), detail=F.lit("external")))
    inline = _of(mine, "inline_template")
    out.append(finding(inline, "info", "components", "medium", "component-inline-template", F.format_string("%s has an inline template", p), measure=F.col("n")))
    out.append(finding(inline.where(F.col("n") > t["componentTemplateLines"]), "warning", "components", "high", "component-large-template", F.format_string("%s has an inline template of %d lines", p, F.col("n")), measure=F.col("n"), limit=F.lit(t["componentTemplateLines"]), detail=F.lit("inline")))
    out.append(finding(_of(mine, "inline_styles"), "info", "components", "medium", "component-inline-styles", F.format_string("%s has inline styles", p)))
    return _all(out)


def _large(size: DataFrame, category: str, code: str, limit: float) -> DataFrame:
    return finding(size.where(F.col("n") > limit), "warning", category, "high", code, F.format_string("%s has %d lines", F.col("file_path"), F.col("n")), measure=F.col("n"), limit=F.lit(limit))


def missing_spec(paths: DataFrame, files: DataFrame, kind: str, category: str) -> DataFrame:
    """Files of a kind by name without the spec beside them (anti join with all files)."""
    x = paths.where(F.col("file_path").endswith(f".{kind}.ts")).withColumn("expected", X.spec_path(F.col("file_path")))
    x = x.join(files.select(F.col("file_path").alias("expected")), "expected", "left_anti")
    return finding(x, "warning", category, "high", f"{kind}-missing-spec", F.format_string("%s has no spec (%s)", F.col("file_path"), F.col("expected")), detail=F.col("expected"))


def service_findings(facts: DataFrame, files: DataFrame, paths: DataFrame, cfg: C.Config) -> DataFrame:
    t = cfg.thresholds
    mine = facts.join(paths, "file_path", "left_semi")
    size = _of(mine, "complexity")
    order = F.array(*map(F.lit, ("http", "routing", "storage", "ui", "state")))
    sig = _of(mine, "signal").groupBy("file_path").agg(F.collect_set("key").alias("has")).withColumn("signals", F.array_intersect(order, "has"))
    mixed = size.join(sig, "file_path").where((F.col("n") >= t["serviceMixedMinLines"]) & (F.size("signals") >= t["serviceMixedMinSignals"]))
    text = F.array_join("signals", ", ")
    return _all([
        _large(size, "services", "service-large-ts", t["serviceTsLines"]),
        missing_spec(mine.select("file_path").distinct(), files, "service", "services"),
        finding(mixed, "warning", "services", "medium", "service-mixed-responsibility", F.format_string("%s mixes %s", F.col("file_path"), text), measure=F.col("n"), limit=F.lit(t["serviceMixedMinLines"]), detail=text),
    ])


def route_findings(facts: DataFrame) -> DataFrame:
    routed = _of(facts, "route").select("file_path").distinct()
    x = _of(facts, "complexity").join(routed, "file_path", "left_semi").where(F.col("n") > MAX_ROUTE_LINES)
    return _large(x, "routes", "routes-large-config", MAX_ROUTE_LINES)


def cycle_findings(cycles: DataFrame) -> DataFrame:
    text = F.format_string("%d files import each other: %s", F.col("node_count"), F.array_join("nodes", ", "))
    return finding(cycles.withColumn("file_path", F.element_at("nodes", 1)), "warning", "architecture", "high", "import-cycle", text, measure=F.col("node_count"))


def lifecycle_findings(facts: DataFrame) -> DataFrame:
    """Uses without their clean-up, by anti joins on class and key; a field is reported once, at its first place."""

    def without(use: DataFrame, *done: str) -> DataFrame:
        fixed = _of(facts, *done).select("cls", "key").distinct()
        return use.join(fixed, ["cls", "key"], "left_anti")

    first = lambda df: df.groupBy("cls", "key").agg(F.min_by(F.struct("file_path", "line", "col", "ord"), "ord").alias("f")).select("cls", "key", "f.*")
    say = lambda text: F.format_string(text, F.col("key"), F.col("file_path"))
    sub = _of(facts, "subscribe")
    out = [finding(without(first(_of(facts, "take_until")), "destroy_next"), "warning", "lifecycle", "high", "lifecycle-broken-destroy-subject", say("%s ends streams in %s but is never fired on destroy"), line=True, detail=F.col("key"))]
    fields = sub.where("value is not null and n = 0").drop("key").withColumnRenamed("value", "key")
    stored = without(first(fields), "unsubscribe")
    out.append(finding(stored, "warning", "lifecycle", "high", "lifecycle-subscription-field-not-unsubscribed", say("%s of %s is never unsubscribed"), line=True, detail=F.col("key")))
    comp = without(first(_of(facts, "composite")), "unsubscribe").join(_of(facts, "composite_used").select("cls", "key").distinct(), ["cls", "key"], "left_semi").join(stored.select("cls", "key"), ["cls", "key"], "left_anti")
    out.append(finding(comp, "warning", "lifecycle", "medium", "lifecycle-subscription-field-not-unsubscribed", say("%s of %s collects subscriptions and is never unsubscribed"), line=True, detail=F.col("key")))
    for kind, done, code in (("listener", "unlisten", "lifecycle-addEventListener-no-remove"), ("setInterval", "clearInterval", "lifecycle-setInterval-no-clearInterval"), ("requestAnimationFrame", "cancelAnimationFrame", "lifecycle-requestAnimationFrame-no-cancelAnimationFrame")):
        use = _of(facts, kind)
        out.append(finding(without(use.where("n = 0") if kind == "listener" else use, done), "warning", "lifecycle", "medium", code, say("%s in %s has no clean-up"), line=True, detail=F.col("key")))
    out.append(finding(_of(facts, "to_signal"), "info", "lifecycle", "medium", "lifecycle-toSignal-manualCleanup", F.format_string("%s turns off the clean-up of a signal", F.col("file_path")), line=True))
    out.append(finding(_of(facts, "effect").where("n = 0"), "warning", "lifecycle", "medium", "lifecycle-effect-missing-onCleanup", say("an effect with %s in %s has no clean-up"), line=True, detail=F.col("key")))
    open_ = sub.where("n = 0 and value is null and extra is null")
    out.append(finding(open_.where("key = 'fromEvent'"), "warning", "lifecycle", "high", "lifecycle-fromEvent-subscribe-no-cleanup", say("a %s subscription in %s is never ended"), line=True))
    out.append(finding(open_.where("key in ('interval', 'longLived')"), "warning", "lifecycle", "medium", "lifecycle-unmanaged-subscribe", say("a long-lived subscription (%s) in %s is never ended"), line=True))
    return _all(out)


def _join(folder: Column, rel: Column) -> Column:
    step = lambda a, p: F.when(p.isin("", "."), a).when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(F.split(F.concat_ws("/", folder, rel), "/"), F.array().cast("array<string>"), step), "/")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit(spark: SparkSession, root: str, config: C.Config | None = None) -> Audit:
    """The tables of a workspace folder."""
    checkpointing(spark)
    cfg = config if config is not None else C.read(os.path.join(root, "corvane.config.json"))
    projects = spark.createDataFrame(W.projects(root), "project string, root string, source_root string")
    return tables(cfg, projects, W.files(spark, root).checkpoint(), C.ts_paths(root))


def tables(cfg: C.Config, projects: DataFrame, files: DataFrame, paths: tuple = (None, None), sections: Iterable[str] = FACTS.SECTIONS) -> Audit:
    """The tables of projects (project, root, source_root) and files (file_path, text)."""
    checkpointing(files.sparkSession)
    return Audit(cfg, projects, files, paths, frozenset(sections))


summary = document.summary


def brief_tables(a: Audit) -> dict[str, DataFrame]:
    """health, tasks and areas of an audit."""
    cyc = brief.cycle_tasks(a.cycles)
    external = (F.col("code") == "component-large-template") & (F.col("detail") == "external")
    src = a.findings.withColumn("template", F.when(external, F.col("file_path"))).withColumn("file_path", F.col("source_path"))
    t = a.config.thresholds
    gaps = a.findings.withColumn("expected", F.col("detail"))
    parts = [cyc, brief.lifecycle_tasks(a.findings), brief.oversize_tasks(src, "component", t["componentTsLines"]), brief.oversize_tasks(src, "service", t["serviceTsLines"]), brief.duplicate_tasks(a.groups, a.occurrences), brief.gap_tasks(gaps), brief.hotspot_tasks(a.hotspots)]
    tasks = brief.with_dependencies(_all([p.select(*brief.TASK) for p in parts]), cyc)
    return {"health": brief.health(a.findings, a.cycles, a.groups, a.hotspots), "tasks": tasks, "areas": brief.areas(a.findings, a.cycles, tasks, a.groups, a.hotspots)}


def write(a: Audit, root: str, generated_at: str) -> str:
    """report.json, brief.json and brief.md in the configured folder inside the workspace; executors write the report."""
    out = C.output_dir(root, a.config.output_dir)
    os.makedirs(out, exist_ok=True)
    t = brief_tables(a)
    place = "file://" + os.path.abspath(out)
    json_document.write(document.report_lines(a, generated_at, root, W.MANIFEST), f"{place}/report.json")
    json_document.write(brief_document.brief_lines(a, t, generated_at, root), f"{place}/brief.json")
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    page = {"health": rows(t["health"]), "areas": rows(t["areas"]), "tasks": rows(brief_document.first_tasks(t["tasks"], SHOWN))}  # one row, six, SHOWN an area
    with open(os.path.join(out, "brief.md"), "w", encoding="utf-8") as f:
        f.write(markdown(page))
    return out


def markdown(b: dict, files: int = 3) -> str:
    """A page of a brief: its areas by priority, each with its first tasks."""
    h = b["health"][0]
    lines = [f"# Brief: {h['score']}/100 ({h['grade']})", ""]
    for area in sorted(b["areas"], key=lambda a: (a["priority"], brief.AREAS.index(a["area"]))):
        mine = sorted((t for t in b["tasks"] if t["area"] == area["area"]), key=lambda t: t["nth"])
        lines += [f"## {area['area']} ({area['priority']}): {area['tasks']} tasks", ""]
        for t in mine:
            more = len(t["affected_files"]) - files
            safe = re.sub(r"\r?\n", " ", t["title"]).strip()
            lines.append(f"- {safe} [{t['impact']}/{t['effort']}]: {', '.join(t['affected_files'][:files])}" + (f" +{more} more" if more > 0 else ""))
        if area["tasks"] > len(mine):
            lines.append(f"_...and {area['tasks'] - len(mine)} more._")
        lines.append("")
    return "\n".join(lines)
