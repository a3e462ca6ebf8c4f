"""Reports of any origin as tables: what each field may be is data, and one walk over it makes the columns.

A field is a name and a rule.  Rules: `text`, `number`, `flag` with a default; `need` (a text that isn't empty), `any` (a text),
`count` (a number), without which the row is dropped; `one` of some words with a default, or without one (then needed); `texts`
(non-empty texts of a list); `part` (an object's fields) and `rows` (a list's rows, dropped one by one).  A value of another JSON
type counts as missing; what isn't an object is no row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from corvane.operators.session import checkpointing
from corvane.sources.reports import kind, number, text


@dataclass(frozen=True)
class Rule:
    kind: str
    default: object = None
    words: tuple[str, ...] = ()
    fields: dict = field(default_factory=dict)


def _text(default: str | None = "") -> Rule:
    return Rule("text", default)


NEED, ANY, COUNT, NUMBER, FLAG, TEXTS = Rule("need"), Rule("any"), Rule("count"), Rule("number", 0), Rule("flag", False), Rule("texts")
FILES = Rule("rows", fields={"filePath": NEED})
ROUTES = Rule("rows", fields={"filePath": NEED, "path": ANY})
FOUND = {k: FILES for k in ("components", "directives", "pipes", "services")} | {"routes": ROUTES}
PLACES = Rule("rows", fields={"filePath": NEED, "startLine": COUNT, "endLine": COUNT, "lineCount": NUMBER, "tokenCount": NUMBER, "methodId": _text(None)})
#: The tables of a report: where their rows are, and their fields.
TABLES: dict[str, tuple[str, dict[str, Rule]]] = {
    "projects": ("$.projects", {"name": _text("unknown"), "root": _text(None), "sourceRoot": _text(None), **FOUND}),
    "findings": ("$.findings", {
        "severity": Rule("one", "info", ("error", "warning", "info")), "category": _text("imports"), "confidence": Rule("one", "medium", ("high", "medium", "low")), "code": _text("unknown"),
        "message": _text(), "whyItMatters": _text(), "suggestedActions": TEXTS, "filePath": _text(), "metadata": Rule("object"),
    }),
    "files": ("$.symbols.files", {"id": NEED, "filePath": NEED}),
    "classes": ("$.symbols.classes", {"id": NEED, "name": NEED, "filePath": NEED, "startLine": COUNT, "endLine": COUNT}),
    "methods": ("$.symbols.methods", {
        "id": NEED, "name": NEED, "filePath": NEED, "classId": NEED, "className": NEED, "visibility": Rule("one", "public", ("public", "protected", "private")), "startLine": COUNT, "endLine": COUNT,
        "metrics": Rule("part", fields={"lineCount": NUMBER, "branchCount": NUMBER, "parameterCount": NUMBER}),
    }),
    "references": ("$.methodReferences", {"methodId": NEED, "filePath": NEED, "line": COUNT, "column": COUNT, "snippet": ANY}),
    "groups": ("$.duplicateGroups", {"id": _text(None), "kind": Rule("one", None, ("exact", "normalized")), "hash": _text(), "tokenCount": NUMBER, "lineCount": NUMBER, "preview": _text(None), "occurrences": PLACES}),
    "hotspots": ("$.hotspotScores", {
        "filePath": NEED, "score": NUMBER, "factors": Rule("part", fields={k: NUMBER for k in ("complexity", "duplication", "missingSpec", "importFanIn", "importFanOut")}),
        "metrics": Rule("part", fields={k: FLAG if k == "missingSpec" else NUMBER for k in ("lineCount", "methodCount", "constructorParamCountMax", "branchCount", "duplicateGroupCount", "duplicateOccurrenceCount", "duplicatedLineCount", "missingSpec", "fanIn", "fanOut")}),
    }),
    "categories": ("$.analyzerCategories", {"id": NEED, "title": _text(None), "description": _text(), "findingCodes": TEXTS, "reportKeys": TEXTS}),
    "scans": ("$.scans", {
        "id": ANY, "source": _text("file"), "createdAt": _text(), "schemaVersion": NUMBER, "generatedAt": ANY, "workspaceRoot": ANY, "summary": Rule("part", fields={k: NUMBER for k in ("projects", "components", "services", "routes")}),
        "importGraph": Rule("part", fields={k: NUMBER for k in ("nodes", "edges", "cycles")}), "duplicatesGroupCount": NUMBER, "hotspotsCount": NUMBER, "findingsTotal": NUMBER,
        "findingsBySeverity": Rule("part", fields={k: NUMBER for k in ("error", "warning", "info")}), "findingsByCategory": Rule("map", "map<string,map<string,double>>"), "findingsByCode": Rule("map", "map<string,double>"),
    }),
}


def _items(v: Column, path: str) -> Column:
    """The elements of a list, none where there is no list."""
    none = F.array().cast("array<variant>")
    return F.when(kind(v, path) == "array", F.coalesce(F.try_variant_get(v, path, "array<variant>"), none)).otherwise(none)


def _part(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "object", F.try_variant_get(v, path, "variant"))


def _checked(fields: dict[str, Rule]) -> Callable[[Column], Column]:
    """The function of an element: its row, and whether it is one."""

    def of(x: Column) -> Column:
        r, keep = row(x, fields)
        return F.struct(r.alias("r"), keep.alias("keep"))

    return of


def row(v: Column, fields: dict[str, Rule]) -> tuple[Column, Column]:
    """The row that a variant holds, and whether it is one."""
    out, keep = [], F.coalesce(kind(v) == "object", F.lit(False))
    for name, rule in fields.items():
        path = f"$.{name}"
        if rule.kind in ("text", "need", "any"):
            c = text(v, path)
            keep &= (F.coalesce(c, F.lit("")) != "") if rule.kind == "need" else c.isNotNull() if rule.kind == "any" else F.lit(True)
            c = F.coalesce(c, F.lit(rule.default)) if rule.default is not None else c
        elif rule.kind in ("number", "count"):
            c = number(v, path)
            keep &= c.isNotNull() if rule.kind == "count" else F.lit(True)
            c = F.coalesce(c, F.lit(float(rule.default))) if rule.default is not None else c
        elif rule.kind == "flag":
            c = F.coalesce(F.when(kind(v, path) == "boolean", F.try_variant_get(v, path, "boolean")), F.lit(rule.default))
        elif rule.kind == "one":
            got = text(v, path)
            c = F.when(got.isin(*rule.words), got)
            keep &= c.isNotNull() if rule.default is None else F.lit(True)
            c = F.coalesce(c, F.lit(rule.default)) if rule.default is not None else c
        elif rule.kind == "texts":
            c = F.filter(F.transform(_items(v, path), lambda x: text(x, "$")), lambda x: x.isNotNull() & (x != ""))
        elif rule.kind == "object":
            c = F.coalesce(F.to_json(_part(v, path)), F.lit("{}"))
        elif rule.kind == "map":
            c = F.try_variant_get(v, path, str(rule.default))
        elif rule.kind == "part":
            c = row(_part(v, path), rule.fields)[0]
        else:
            c = F.transform(F.filter(F.transform(_items(v, path), _checked(rule.fields)), lambda x: x["keep"]), lambda x: x["r"])
        out.append(c.alias(name))
    return F.struct(*out), keep


def table(docs: DataFrame, which: str) -> DataFrame:
    """document, ord and the fields of a table, of all documents (name, doc); ord counts a list's elements, dropped ones too."""
    path, fields = TABLES[which]
    v = docs.select(F.col("name").alias("document"), F.posexplode(_items(F.col("doc"), path)).alias("ord", "v"))
    r, keep = row(F.col("v"), fields)
    out = v.where(keep).select("document", "ord", r.alias("r")).select("document", "ord", "r.*")
    if which == "groups":
        out = out.withColumn("id", F.coalesce("id", F.concat_ws(":", F.lit("dup"), "kind", "hash")))
    return out.withColumn("title", F.coalesce("title", "id")) if which == "categories" else out


def scans(docs: DataFrame) -> DataFrame:
    """The scans of histories of version 1 that have an id, a workspace and a time."""
    return table(docs.where(F.coalesce(number(F.col("doc"), "$.version") == 1, F.lit(False))), "scans")


def heads(docs: DataFrame) -> DataFrame:
    """One row a document: its head, graph and summary; a summary that is missing counts the projects."""
    d, n = F.col("doc"), lambda path: number(F.col("doc"), path)
    projects = table(docs, "projects").groupBy("document").agg(F.count("*").alias("projects"), *[F.sum(F.size(k)).alias(k) for k in ("components", "services", "routes")])
    head = docs.select("name", F.coalesce(n("$.schemaVersion"), F.lit(0.0)).alias("schemaVersion"), *[F.coalesce(text(d, f"$.{k}"), F.lit("")).alias(k) for k in ("generatedAt", "workspaceRoot", "angularJsonPath")], *[F.coalesce(n(f"$.importGraph.{k}"), F.lit(0.0)).alias(k) for k in ("nodes", "edges", "cycles")], *[n(f"$.summary.{k}").alias(f"own_{k}") for k in ("projects", "components", "services", "routes")])
    out = head.join(projects.withColumnRenamed("document", "name"), "name", "left")
    return out.select("name", "schemaVersion", "generatedAt", "workspaceRoot", "angularJsonPath", "nodes", "edges", "cycles", *[F.coalesce(f"own_{k}", F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in ("projects", "components", "services", "routes")])


def folders(docs: DataFrame) -> DataFrame:
    """name, project, source_root, at (places in the lists of folders), path, files and what was found: the folders of project trees,
    one level a round, so that depth needs no recursive type and a level no single task."""
    checkpointing(docs.sparkSession)
    p = docs.select("name", F.posexplode(_items(F.col("doc"), "$.projectTree.projects")).alias("nth", "p"))
    r = p.where(F.coalesce(kind(F.col("p")) == "object", F.lit(False))).select("name", "nth", F.coalesce(text(F.col("p"), "$.name"), F.lit("unknown")).alias("project"), F.posexplode(_items(F.col("p"), "$.sourceRoots")).alias("root", "s"))
    s = F.col("s")
    level = r.where(F.coalesce(kind(s) == "object", F.lit(False)) & (F.coalesce(text(s, "$.sourceRoot"), F.lit("")) != "")).select("name", "project", text(s, "$.sourceRoot").alias("source_root"), F.array("nth", "root").alias("at"), _part(s, "$.rootFolder").alias("v")).where("v is not null")
    listed = Rule("rows", fields={"filePath": NEED, "classes": Rule("rows", fields={"classId": NEED, "methodIds": TEXTS})})
    out = None
    while True:
        level = level.where(F.coalesce(kind(F.col("v")) == "object", F.lit(False))).checkpoint()
        fields, _ = row(F.col("v"), {"path": _text(), "files": listed, **FOUND})
        rows = level.select("name", "project", "source_root", "at", fields.alias("f")).select("name", "project", "source_root", "at", "f.*")
        out = rows if out is None else out.union(rows)
        if not level.limit(1).count():
            return out
        level = level.select("name", "project", "source_root", F.col("at").alias("up"), F.posexplode(_items(F.col("v"), "$.folders")).alias("k", "v")).select("name", "project", "source_root", F.concat("up", F.array("k")).alias("at"), "v")
