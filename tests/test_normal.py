"""Reports of any origin as tables, snapshot records, comparisons, bounded histories."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import snapshots
from corvane.sources import normal
from corvane.streaming import scans

REPORT = {
    "schemaVersion": 6, "generatedAt": "t", "workspaceRoot": "/w", "angularJsonPath": "angular.json",
    "projects": [{"name": 5, "root": None, "sourceRoot": "src", "components": [{"filePath": "a.ts"}, {"filePath": ""}, {}, 7], "routes": [{"filePath": "r.ts", "path": ""}, {"filePath": "r.ts"}, {"path": "x"}]}, "no", None, {}],
    "findings": [{"severity": "loud", "confidence": 1, "code": "c", "suggestedActions": ["a", "", 4, "b"], "metadata": [1]}, {"severity": "error", "category": "x", "confidence": "low", "code": 3, "message": "m", "whyItMatters": "w", "filePath": "f.ts", "metadata": {"k": [1, {"z": None}]}}, 4],
    "summary": {"components": "many", "services": 4}, "importGraph": {"nodes": 3, "edges": "2"},
    "symbols": {
        "files": [{"id": "file:a", "filePath": "a"}, {"id": "file:b"}],
        "classes": [{"id": "c", "name": "C", "filePath": "a", "startLine": 1, "endLine": 2}, {"id": "c", "name": "C", "filePath": "a", "startLine": "1", "endLine": 2}, {"id": "", "name": "C", "filePath": "a", "startLine": 1, "endLine": 2}],
        "methods": [{"id": "m", "name": "n", "filePath": "a", "classId": "c", "className": "C", "visibility": "secret", "startLine": 1, "endLine": 2, "metrics": {"lineCount": 2, "branchCount": "x"}}, {"id": "m", "name": "n", "filePath": "a", "classId": "c", "startLine": 1, "endLine": 2}],
    },
    "methodReferences": [{"methodId": "m", "filePath": "a", "line": 1, "column": 2, "snippet": ""}, {"methodId": "m", "filePath": "a", "line": 1, "column": 2}],
    "duplicateGroups": [{"kind": "exact", "hash": "h", "occurrences": [{"filePath": "a", "startLine": 1, "endLine": 9}, {"filePath": "a", "startLine": None, "endLine": 9}, 3]}, {"kind": "other"}, {"kind": "normalized", "id": "own", "preview": "p", "occurrences": {}}],
    "hotspotScores": [{"filePath": "a", "score": 1.5, "metrics": {"missingSpec": True, "fanIn": 3}}, {"score": 9}],
    "analyzerCategories": [{"id": "i", "findingCodes": ["a", 1]}, {"title": "t"}],
    "projectTree": {"projects": [{"sourceRoots": [{"sourceRoot": "src", "rootFolder": {"path": "src", "files": [{"filePath": "src/a.ts", "classes": [{"classId": "c", "methodIds": ["m", ""]}, {}]}, {}], "folders": [{"path": "src/x", "folders": [{"services": [{"filePath": "s.ts"}]}, 5]}, "no"]}}, {"sourceRoot": "", "rootFolder": {}}, {"sourceRoot": "y"}]}, 1]},
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("full", json.dumps(REPORT)), ("bare", json.dumps({"projects": 5, "findings": {}, "symbols": [], "projectTree": {"projects": {}}})), ("list", "[]"), ("bad", "{")]
    return spark.createDataFrame(rows, "name string, t string").select("name", F.try_parse_json("t").alias("doc"))


def rows(docs, which):
    return [r.asDict(True) for r in normal.table(docs, which).drop("document").orderBy("ord").collect()]


def test_tables(docs):
    assert rows(docs, "projects") == [
        {"ord": 0, "name": "unknown", "root": None, "sourceRoot": "src", "components": [{"filePath": "a.ts"}], "directives": [], "pipes": [], "services": [], "routes": [{"filePath": "r.ts", "path": ""}]},
        {"ord": 3, "name": "unknown", "root": None, "sourceRoot": None, "components": [], "directives": [], "pipes": [], "services": [], "routes": []},
    ]
    f = rows(docs, "findings")
    assert [(x["severity"], x["category"], x["confidence"], x["code"], x["message"], x["filePath"], x["suggestedActions"]) for x in f] == [("info", "imports", "medium", "c", "", "", ["a", "b"]), ("error", "x", "low", "unknown", "m", "f.ts", [])]
    assert f[0]["metadata"] == "{}" and json.loads(f[1]["metadata"]) == {"k": [1, {"z": None}]}
    assert [x["id"] for x in rows(docs, "files")] == ["file:a"] and [x["ord"] for x in rows(docs, "classes")] == [0]
    (m,) = rows(docs, "methods")
    assert m["visibility"] == "public" and m["metrics"] == {"lineCount": 2.0, "branchCount": 0.0, "parameterCount": 0.0}
    assert [(x["line"], x["snippet"]) for x in rows(docs, "references")] == [(1.0, "")]
    g = rows(docs, "groups")
    assert [(x["id"], x["kind"], x["preview"], len(x["occurrences"])) for x in g] == [("dup:exact:h", "exact", None, 1), ("own", "normalized", "p", 0)] and g[0]["occurrences"][0] == {"filePath": "a", "startLine": 1.0, "endLine": 9.0, "lineCount": 0.0, "tokenCount": 0.0, "methodId": None}
    (h,) = rows(docs, "hotspots")
    assert h["score"] == 1.5 and h["metrics"]["missingSpec"] is True and h["metrics"]["fanIn"] == 3 and h["factors"]["complexity"] == 0
    assert [(x["title"], x["findingCodes"]) for x in rows(docs, "categories")] == [("i", ["a"])]


def test_heads(docs):
    got = {r.name: r for r in normal.heads(docs).collect()}
    assert (got["full"].nodes, got["full"].edges, got["full"].projects, got["full"].components, got["full"].services, got["full"].routes) == (3, 0, 2, 1, 4, 1)
    assert (got["bare"].schemaVersion, got["bare"].workspaceRoot, got["bare"].projects) == (0, "", 0)


def test_folders(docs):
    got = sorted((tuple(r.at), r.path, len(r["files"]), [x.filePath for x in r.services]) for r in normal.folders(docs).collect())
    assert got == [((0, 0), "src", 1, []), ((0, 0, 0), "src/x", 0, []), ((0, 0, 0, 0), "", 0, ["s.ts"])]


def scan(id_, **more):
    return {"id": id_, "source": "file", "createdAt": "2026-04-15", "schemaVersion": 6, "generatedAt": "g", "workspaceRoot": "/r", "summary": {"projects": 1, "components": 2, "services": 3, "routes": 4}, "importGraph": {"nodes": 10, "edges": 20, "cycles": 1}, "duplicatesGroupCount": 2, "hotspotsCount": 3, "findingsTotal": 0, "findingsBySeverity": {"error": 0, "warning": 0, "info": 0}, "findingsByCategory": {}, "findingsByCode": {}} | more


def test_comparison(spark):
    b = scan("b", summary={"projects": 1, "components": 3, "services": 2, "routes": 4}, findingsTotal=5, findingsBySeverity={"error": 1, "warning": 2, "info": 2}, findingsByCode={"x": 2, "y": 3, "z": 0}, importGraph={"nodes": 12, "edges": 19, "cycles": 2})
    kept = [scan("a", findingsByCode={"w": 3, "x": 5}), b, {"id": 4}, {"id": "n", "workspaceRoot": "/r"}]
    docs = spark.createDataFrame([("h", json.dumps({"version": 1, "scans": kept})), ("old", json.dumps({"version": 2, "scans": kept}))], "name string, t string").select("name", F.try_parse_json("t").alias("doc"))
    history = normal.scans(docs)
    assert [r.id for r in history.orderBy("ord").collect()] == ["a", "b"]
    d = snapshots.picked(history, "a", "b").first()
    assert d.delta.asDict(True) == {"projects": 0, "components": 1, "services": -1, "routes": 0, "findingsTotal": 5, "findingsBySeverity": {"error": 1, "warning": 2, "info": 2}, "duplicatesGroupCount": 0, "hotspotsCount": 0, "importNodes": 2, "importEdges": -1, "importCycles": 1}
    # ties by the old record's order, then the new one's
    assert [(c.code, c["from"], c["to"], c.delta) for c in d.topCodeDeltas] == [("w", 3, 0, -3), ("x", 5, 2, -3), ("y", 0, 3, 3)]
    assert snapshots.picked(history, "a", "a").count() == 0 and snapshots.picked(history, "a", "gone").count() == 0


def test_records(spark):
    rows = [(1, "error", "x", "c1"), (1, "info", "x", "c2"), (1, "info", None, "c1"), (2, "warning", "y", "c3")]
    got = {r.k: r for r in snapshots.records(spark.createDataFrame(rows, "k int, severity string, category string, code string"), "k").collect()}
    assert got[1].findingsTotal == 3 and got[1].findingsBySeverity == {"error": 1, "warning": 0, "info": 2} and got[1].findingsByCode == {"c1": 2, "c2": 1}
    assert got[1].findingsByCategory == {"unknown": {"error": 0, "warning": 0, "info": 1}, "x": {"error": 1, "warning": 0, "info": 1}} and got[2].findingsByCode == {"c3": 1}


def test_bounded_history(spark, tmp_path):
    """Thirty scans in batches leave twenty; a torn state is passed over, and a batch that runs again changes nothing."""
    schema = "day string, total long, error long, warning long, info long"
    src = str(tmp_path / "in")
    for d in range(30):
        spark.createDataFrame([(f"2024-01-{d + 1:02d}", d, 0, 0, d)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 7).parquet(src)
    scans.keep(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    want = [f"2024-01-{d:02d}" for d in range(30, 10, -1)]
    read = lambda: [r.day for r in scans.history(spark, f"{tmp_path}/out").orderBy("recency").collect()]
    assert read() == want
    states = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(states) == 2  # the list in force and the one before
    (tmp_path / "out" / "state=99").mkdir()  # a crash while writing: no _SUCCESS
    assert read() == want
    (tmp_path / "out" / states[-1] / "_SUCCESS").unlink()  # or after writing, before the state was finished
    assert read() == [f"2024-01-{d:02d}" for d in range(28, 8, -1)]
