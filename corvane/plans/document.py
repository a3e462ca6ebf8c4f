"""The report of an audit as lines of one JSON document (`sources.json_document`): keys of schema version 7, lists in locale order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.operators import tree
from corvane.sources.json_document import at, lines

#: Why a finding matters, and what to do about it.
ADVICE = {
    "component-large-ts": ("A long class does several jobs at once and is slow to read and to change.", ["Move logic into services.", "Split the view into smaller components."]),
    "component-large-template": ("A long template hides structure and repeats itself.", ["Cut parts out into components of their own."]),
    "component-inline-template": ("Markup inside a string escapes editors and reviews.", ["Move the template into a file if it grows."]),
    "component-inline-styles": ("Styles inside a class can't be shared or linted.", ["Move the styles into a file."]),
    "component-missing-spec": ("Nothing tells when the component breaks.", ["Add a spec beside the file."]),
    "component-http-calls": ("A view that sends requests is tied to a server and hard to test.", ["Send requests from a service."]),
    "component-many-injections": ("Many dependencies are a sign of many duties.", ["Group dependencies behind a facade.", "Split the component."]),
    "component-standalone-duplicate-imports": ("An import that is listed twice misleads readers.", ["Remove the second entry."]),
    "service-large-ts": ("A long service collects unrelated duties.", ["Split it by duty."]),
    "service-missing-spec": ("Nothing tells when the service breaks.", ["Add a spec beside the file."]),
    "service-mixed-responsibility": ("Network, storage and view concerns in one class change for different reasons.", ["Give each concern a service."]),
    "routes-large-config": ("A long route file is a place of conflicts.", ["Split routes by feature and load them lazily."]),
    "import-cycle": ("Files that import each other load in an order that is hard to foresee.", ["Move what they share into a file of its own.", "Turn one import around."]),
    "lifecycle-unmanaged-subscribe": ("A stream that never ends keeps its subscriber alive.", ["End the stream with the component."]),
    "lifecycle-fromEvent-subscribe-no-cleanup": ("The listener outlives the component.", ["End the stream with the component."]),
    "lifecycle-broken-destroy-subject": ("Streams wait for a signal that is never given.", ["Fire and complete the subject on destroy."]),
    "lifecycle-subscription-field-not-unsubscribed": ("A kept subscription that nobody ends is a leak.", ["Unsubscribe on destroy."]),
    "lifecycle-addEventListener-no-remove": ("The handler stays registered and holds the component.", ["Remove the listener on destroy."]),
    "lifecycle-setInterval-no-clearInterval": ("The timer goes on after the component is gone.", ["Clear the timer on destroy."]),
    "lifecycle-requestAnimationFrame-no-cancelAnimationFrame": ("A frame may be drawn after the component is gone.", ["Cancel the frame on destroy."]),
    "lifecycle-effect-missing-onCleanup": ("Each run of the effect adds a resource and none is freed.", ["Free the resource in the clean-up callback."]),
    "lifecycle-toSignal-manualCleanup": ("The stream must be ended by hand.", ["Leave the clean-up to the framework unless it must be manual."]),
}
KINDS = {"component": "components", "directive": "directives", "pipe": "pipes", "injectable": "services"}
#: Sections in order: title, description and report keys of each category.
CATEGORIES = (
    ("projectTree", "Project tree", "Folders of each source root with what was found in them.", ["projectTree"]),
    ("components", "Components", "Size, style, injection and spec rules.", []),
    ("services", "Services", "Size, duty and spec rules.", []),
    ("routes", "Routes", "Size of route files.", []),
    ("imports", "Imports", "Relative imports and their cycles.", ["importGraph"]),
    ("lifecycle", "Lifecycle", "Subscriptions, listeners, timers and effects without an end.", []),
    ("duplication", "Duplicates", "Equal and alike method bodies.", ["duplicateGroups"]),
    ("symbols", "Symbols", "Classes, methods and their uses.", ["symbols", "methodReferences"]),
    ("hotspots", "Hotspots", "Files by complexity, duplication, coupling and missing specs.", ["hotspotScores"]),
)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _category(code: str) -> str:
    return "imports" if code == "import-cycle" else {"component": "components", "service": "services"}.get(code.split("-")[0], code.split("-")[0])


def metadata(min_signals: int) -> Column:
    """What a code tells beside its message; fields that don't belong to a code are null and left out."""
    code, c = F.col("code"), F.col
    on = lambda codes, v: F.when(code.isin(*codes.split()), v)
    life = code.startswith("lifecycle-")
    listener = F.split("detail", "::")
    part = lambda k: on("lifecycle-addEventListener-no-remove", F.get(listener, k))
    return _json(
        projectName=F.when(~life & (code != "import-cycle"), c("project")),
        componentFilePath=F.when(code.startswith("component-"), c("source_path")), serviceFilePath=F.when(code.startswith("service-"), c("source_path")), routesFilePath=on("routes-large-config", c("source_path")),
        tsLineCount=on("component-large-ts service-large-ts service-mixed-responsibility routes-large-config", c("measure")), maxTsLines=on("component-large-ts service-large-ts routes-large-config", c("limit")),
        routeObjectCount=on("routes-large-config", F.coalesce("route_objects", F.lit(0))),
        templateKind=on("component-large-template", c("detail")).when(code == "component-inline-template", "inline"), templateFilePath=F.when((code == "component-large-template") & (c("detail") == "external"), c("file_path")),
        templateLineCount=on("component-large-template component-inline-template", c("measure")), maxTemplateLines=on("component-large-template", c("limit")),
        expectedSpecFilePath=on("component-missing-spec service-missing-spec", c("detail")), httpPropertyName=on("component-http-calls", c("detail")), methods=on("component-http-calls", F.split(F.regexp_extract("message", r"\(([^()]*)\)$", 1), ", ")),
        constructorParamCount=on("component-many-injections", c("measure")), maxConstructorParams=on("component-many-injections", c("limit")), duplicates=on("component-standalone-duplicate-imports", F.split("detail", ", ")),
        signals=on("service-mixed-responsibility", F.split("detail", ", ")), minSignals=on("service-mixed-responsibility", F.lit(min_signals)), minLines=on("service-mixed-responsibility", c("limit")),
        nodes=on("import-cycle", F.split(F.regexp_extract("message", ": (.*)$", 1), ", ")), nodeCount=on("import-cycle", c("measure")),
        className=F.when(life, F.nullif(F.regexp_extract("cls", r"#([^@]*)@\d+(?:/\d+)?$", 1), F.lit(""))), line=F.when(life, c("line")), column=F.when(life, c("column")),
        subjectProperty=on("lifecycle-broken-destroy-subject", c("detail")), fieldName=on("lifecycle-subscription-field-not-unsubscribed", c("detail")), intervalIdProperty=on("lifecycle-setInterval-no-clearInterval", c("detail")), requestIdProperty=on("lifecycle-requestAnimationFrame-no-cancelAnimationFrame", c("detail")),
        targetText=part(0), eventName=part(1), handlerText=part(2), resources=on("lifecycle-effect-missing-onCleanup", F.split("detail", ", ")),
        rootKind=on("lifecycle-unmanaged-subscribe", F.when(F.contains("message", F.lit("(interval)")), "interval").otherwise("observable")),
    )


def advised(found: DataFrame) -> DataFrame:
    """Findings with why_it_matters and suggested_actions."""
    why, actions = F.lit(""), F.array().cast("array<string>")
    for code, (reason, steps) in ADVICE.items():
        why = F.when(F.col("code") == code, reason).otherwise(why)
        actions = F.when(F.col("code") == code, F.array(*map(F.lit, steps))).otherwise(actions)
    return found.withColumn("why_it_matters", why).withColumn("suggested_actions", actions)


def finding_lines(a, section: int) -> DataFrame:
    """Analyzers one after the other, each by path and code, ties by place and message."""
    projects = a.artifacts.unionByName(a.routes.select("project", F.lit("route").alias("artifact"), "file_path")).groupBy(F.col("file_path").alias("source_path")).agg(F.min("project").alias("project"))
    objects = a.facts.where("kind = 'route_objects'").groupBy(F.col("file_path").alias("source_path")).agg(F.max("n").alias("route_objects"))
    x = advised(a.findings).join(projects, "source_path", "left").join(objects, "source_path", "left")
    order = F.array(*[F.lit(c) for c in ("component", "service", "routes", "import", "lifecycle")])
    text = _json(severity=F.col("severity"), category=F.col("category"), confidence=F.col("confidence"), code=F.col("code"), message=F.col("message"), whyItMatters=F.col("why_it_matters"), suggestedActions=F.col("suggested_actions"), filePath=F.col("file_path"), metadata=F.lit(None).cast("string"))
    whole = F.concat(F.expr("substr(t, 1, length(t) - 1)"), F.lit(',"metadata":'), F.col("meta"), F.lit("}"))
    x = x.withColumn("t", text).withColumn("meta", metadata(a.config.thresholds["serviceMixedMinSignals"]))
    key = [at(section), at(1), at(F.array_position(order, F.substring_index("code", "-", 1)).cast("int"), F.concat_ws("\n", "file_path", "code")), at(F.coalesce("line", F.lit(0))), at(F.coalesce("column", F.lit(0)), F.col("message"))]
    return lines(x, key, whole)


def _list(spark: SparkSession, section: int, name: str, rows: list[DataFrame], more: str = "") -> list[DataFrame]:
    one = spark.range(1)
    return [lines(one, [at(section)], f'{more}"{name}":[', False), *rows, lines(one, [at(section), at(1 << 30)], "]", False)]


def project_lines(a, section: int) -> list[DataFrame]:
    """Each project with what was found in it; nothing is gathered in one row."""
    p = a.projects
    own = lambda k, n, name=None: [at(section), at(1, F.col("project")), at(k), at(n, name if name is not None else "")]
    head = F.to_json(F.struct(F.col("project").alias("name"), "root", F.col("source_root").alias("sourceRoot")), {"ignoreNullFields": "false"})
    out = [lines(p.withColumn("h", head), [at(section), at(1, F.col("project"))], F.concat(F.expr("substr(h, 1, length(h) - 1)"), F.lit(',"components":[')))]
    for k, (artifact, name) in enumerate(KINDS.items()):
        if k:
            out.append(lines(p, own(k, 0), f'],"{name}":[', False))
        out.append(lines(a.artifacts.where(F.col("artifact") == artifact), own(k, 1, F.col("file_path")), _json(filePath=F.col("file_path"))))
    k = len(KINDS)
    out += [lines(p, own(k, 0), '],"routes":[', False), lines(a.routes, own(k, 1, F.concat("file_path", "path")), _json(filePath=F.col("file_path"), path=F.col("path"))), lines(p, own(k, 2), "]}", False)]
    return out


def tree_items(a) -> DataFrame:
    """project, source_root, kind (0 files, 1.. kinds, then routes), name (its order), file_path, text: what folders hold."""
    roots = a.projects.where("trim(coalesce(source_root, '')) <> ''").select("project", F.regexp_replace(F.regexp_replace(F.replace(F.trim("source_root"), F.lit("\\"), F.lit("/")), "^(\\./|/)", ""), "/+$", "").alias("source_root"))
    named = [a.artifacts.where(F.col("artifact") == k).select("project", F.lit(i).alias("kind"), F.col("file_path").alias("name"), "file_path", _json(filePath=F.col("file_path")).alias("text")) for i, k in enumerate(KINDS, 1)]
    named.append(a.routes.select("project", F.lit(len(KINDS) + 1).alias("kind"), F.concat("file_path", "path").alias("name"), "file_path", _json(filePath=F.col("file_path"), path=F.col("path")).alias("text")))
    out = named[0]
    for n in named[1:]:
        out = out.union(n)
    out = out.join(roots, "project")
    sorted_ = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(F.collate(x, "UNICODE").alias("s"), x.alias("raw")))), lambda x: x["raw"])
    methods = a.methods.groupBy(F.col("class_id").alias("id")).agg(F.collect_list(F.col("id")).alias("ids"))
    classes = a.classes.join(methods, "id", "left").withColumn("ids", sorted_(F.coalesce("ids", F.array().cast("array<string>"))))
    entry = F.struct(F.collate("id", "UNICODE").alias("s"), F.col("id").alias("classId"), F.col("ids").alias("methodIds"))
    files = classes.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["classId"].alias("classId"), x["methodIds"].alias("methodIds"))).alias("classes"))
    files = files.withColumn("text", _json(filePath=F.col("file_path"), classes=F.col("classes"))).select("file_path", "text")
    under = tree.under(files, roots).select("project", F.lit(0).alias("kind"), F.col("file_path").alias("name"), "file_path", "text", "source_root").distinct()
    return out.unionByName(under)


def tree_lines(items: DataFrame, projects: DataFrame, section: int) -> list[DataFrame]:
    """Folders nest by their keys: a folder's line comes before all below it, its lists and its end after its folders.  Only as
    many lines as folders and items are made; no folder is gathered, and depth costs nothing but longer keys.  Items outside a
    source root stand in its own folder."""
    names = ["files", *KINDS.values(), "routes"]
    top = lambda k, *more: F.array(at(section), at(1, F.col("project")), at(k, F.col("source_root")), *more)
    head = F.to_json(F.struct(F.col("project").alias("name"), "root", F.col("source_root").alias("sourceRoot")), {"ignoreNullFields": "false"})
    every = projects.withColumn("h", head)
    out = [lines(every, [at(section), at(1, F.col("project"))], F.concat(F.expr("substr(h, 1, length(h) - 1)"), F.lit(',"sourceRoots":['))), lines(every, [at(section), at(1, F.col("project")), at(9)], "]}", False)]
    folder = F.when(F.instr("file_path", "/") > 0, F.regexp_replace("file_path", "/[^/]*$", "")).otherwise(F.lit(""))
    prefix = F.concat("source_root", F.lit("/"))
    rel = F.when(F.col("folder").startswith(prefix), F.expr("substr(folder, length(source_root) + 2)")).otherwise(F.lit(""))
    x = items.withColumn("folder", folder).withColumn("rel", rel)
    steps = F.when(F.col("rel") == "", F.array().cast("array<string>")).otherwise(F.filter(F.split("rel", "/"), lambda s: s != ""))
    x = x.withColumn("steps", steps)
    roots = projects.where("trim(coalesce(source_root, '')) <> ''").select("project", F.regexp_replace(F.regexp_replace(F.replace(F.trim("source_root"), F.lit("\\"), F.lit("/")), "^(\\./|/)", ""), "/+$", "").alias("source_root"))
    # folders: every prefix of the steps, of distinct folders only
    dirs = x.select("project", "source_root", "steps").distinct().select("project", "source_root", F.explode(F.transform(F.sequence(F.lit(0), F.size("steps")), lambda n: F.slice("steps", F.lit(1), n))).alias("steps"))
    dirs = dirs.unionByName(roots.withColumn("steps", F.array().cast("array<string>"))).distinct()
    down = F.transform("steps", lambda s: at(3, s))
    path = F.array_join(F.concat(F.array("source_root"), F.col("steps")), "/")
    base = F.concat(top(5), down)
    out.append(lines(roots, top(4), F.concat(F.lit('{"sourceRoot":'), F.regexp_replace(F.to_json(F.array("source_root")), r"^\[|\]$", ""), F.lit(',"rootFolder":'))))
    opened = F.concat(F.lit('{"path":'), F.regexp_replace(F.to_json(F.array(path)), r"^\[|\]$", ""), F.lit(',"folders":['))
    out += [lines(dirs.where("size(steps) = 0"), base, opened, False), lines(dirs.where("size(steps) > 0"), base, opened)]
    for k, name in enumerate(names):
        out.append(lines(dirs, F.concat(base, F.array(at(10 + 2 * k))), f'],"{name}":[', False))
    out.append(lines(x, F.concat(base, F.array(at(F.lit(11) + 2 * F.col("kind"), F.col("name")))), F.col("text")))
    out += [lines(dirs, F.concat(base, F.array(at(99))), "]}", False), lines(roots, top(6), "}", False)]
    return out


def summary(a) -> DataFrame:
    """One row: projects, and components, services and routes over all projects."""
    n = a.projects.agg(F.count("*").cast("long").alias("projects"))
    of = lambda kind, name: F.count_if(F.col("artifact") == kind).cast("long").alias(name)
    art = a.artifacts.agg(of("component", "components"), of("injectable", "services"))
    return n.join(F.broadcast(art)).join(F.broadcast(a.routes.agg(F.count("*").cast("long").alias("routes"))))  # three rows of one line each


def report_lines(a, generated_at: str, root: str, manifest: str) -> DataFrame:
    spark = a.findings.sparkSession
    one = spark.range(1)
    quoted = lambda v: json.dumps(v, ensure_ascii=False)
    edges = a.edges.agg(F.count("*").alias("edges"))
    graph = a.nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(edges)).join(F.broadcast(a.cycles.agg(F.count("*").alias("cycles"))))  # three rows
    methods = _json(id=F.col("id"), name=F.col("name"), filePath=F.col("file_path"), classId=F.col("class_id"), className=F.col("class_name"), visibility=F.col("visibility"), startLine=F.col("start_line"), endLine=F.col("end_line"), metrics=F.struct(F.col("metrics.line_count").alias("lineCount"), F.col("metrics.branch_count").alias("branchCount"), F.col("metrics.parameter_count").alias("parameterCount")))
    row = lambda k, name: [at(k), at(1, name)]
    text = lambda *cols: F.concat_ws("\n", *cols)
    places = a.occurrences.join(a.methods.select(F.concat_ws(".", "class_name", "name").alias("method"), "file_path", F.col("id").alias("method_id"), F.col("start_line").alias("first"), F.col("end_line").alias("last")), ["file_path", "method"], "left").where("method_id is null or start_line between first and last")
    preview = places.groupBy("kind", "hash").agg(F.min_by("preview", F.struct("file_path", "start_line")).alias("preview"))
    groups = a.groups.join(preview, ["kind", "hash"], "left")
    of = lambda k: [at(k), at(F.when(F.col("kind") == "exact", 1).otherwise(2)), at(-F.col("occurrences").cast("int")), at(1, F.col("hash"))]
    spec = F.col("missing_spec") > 0
    hot = _json(
        filePath=F.col("file_path"), score=F.col("score"), factors=F.struct("complexity", "duplication", F.col("spec_points").alias("missingSpec"), F.col("import_fan_in").alias("importFanIn"), F.col("import_fan_out").alias("importFanOut")),
        metrics=F.struct(F.col("line_count").alias("lineCount"), F.col("method_count").alias("methodCount"), F.col("ctor_param_max").alias("constructorParamCountMax"), F.col("branch_count").alias("branchCount"), F.col("dup_groups").alias("duplicateGroupCount"), F.col("dup_occurrences").alias("duplicateOccurrenceCount"), F.col("dup_lines").alias("duplicatedLineCount"), spec.alias("missingSpec"), F.col("fan_in").alias("fanIn"), F.col("fan_out").alias("fanOut")),
    )
    out = [lines(one, [at(0)], f'{{"schemaVersion":7,"generatedAt":{quoted(generated_at)},"workspaceRoot":{quoted(root)},"angularJsonPath":{quoted(manifest)},', False)]
    out += _list(spark, 1, "projects", project_lines(a, 1))
    out += _list(spark, 2, "findings", [finding_lines(a, 2)], ",")
    out.append(lines(graph, [at(3)], F.concat(F.lit(',"importGraph":'), _json(nodes=F.col("nodes"), edges=F.col("edges"), cycles=F.col("cycles"))), False))
    out.append(lines(summary(a), [at(4)], F.concat(F.lit(',"summary":'), F.to_json(F.struct("projects", "components", "services", "routes"))), False))
    out += _list(spark, 5, "projects", tree_lines(tree_items(a), a.projects, 5), ',"projectTree":{')
    files = a.classes.select("file_path").distinct()
    out += _list(spark, 6, "files", [lines(files, row(6, F.col("file_path")), _json(id=F.concat(F.lit("file:"), "file_path"), filePath=F.col("file_path")))], '},"symbols":{')
    out += _list(spark, 7, "classes", [lines(a.classes, row(7, text("file_path", "name", F.col("start_line").cast("string"))), _json(id=F.col("id"), name=F.col("name"), filePath=F.col("file_path"), startLine=F.col("start_line"), endLine=F.col("end_line")))], ",")
    out += _list(spark, 8, "methods", [lines(a.methods, row(8, text("file_path", "class_name", "name", F.col("start_line").cast("string"))), methods)], ",")
    refs = a.references
    out += _list(spark, 9, "methodReferences", [lines(refs, row(9, text("method_id", "file_path", F.col("line").cast("string"), F.col("col").cast("string"))), _json(methodId=F.col("method_id"), filePath=F.col("file_path"), line=F.col("line"), column=F.col("col"), snippet=F.col("snippet")))], "},")
    group = F.to_json(F.struct("id", "kind", "hash", F.col("token_count").alias("tokenCount"), F.col("line_count").alias("lineCount"), "preview"))
    inside = [lines(groups.withColumn("g", group), of(10), F.concat(F.expr("substr(g, 1, length(g) - 1)"), F.lit(',"occurrences":[')))]
    numbered = places.join(a.groups.select("kind", "hash", "occurrences"), ["kind", "hash"])
    inside.append(lines(numbered, [*of(10), at(1, text("file_path", F.col("start_line").cast("string")))], _json(filePath=F.col("file_path"), startLine=F.col("start_line"), endLine=F.col("end_line"), lineCount=F.col("line_count"), tokenCount=F.col("token_count"), methodId=F.col("method_id"))))
    inside.append(lines(groups, [*of(10), at(2)], "]}", False))
    out += _list(spark, 10, "duplicateGroups", inside, ",")
    out += _list(spark, 11, "hotspotScores", [lines(a.hotspots, [at(11), at(1), at(-F.col("score").cast("int"), F.col("file_path"))], hot)], ",")
    own = [json.dumps({"id": i, "title": t, "description": d, "findingCodes": [c for c in ADVICE if _category(c) == i], "reportKeys": k}) for i, t, d, k in CATEGORIES]
    out += _list(spark, 12, "analyzerCategories", [lines(one, [at(12), at(1), at(k)], t) for k, t in enumerate(own)], ",")
    out.append(lines(one, [at(13)], "}", False))
    all_ = out[0]
    for o in out[1:]:
        all_ = all_.unionByName(o)
    return all_
