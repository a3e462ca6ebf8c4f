"""Reports as sources, and views."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.__main__ import arguments
from corvane.plans import views
from corvane.sources import reports

GOOD = {"schemaVersion": 7, "generatedAt": "t", "workspaceRoot": "/w", "angularJsonPath": "a", "projects": [], "findings": [
    {"severity": "error", "category": "components", "confidence": "low", "code": "c1", "message": "m", "filePath": "f.ts", "metadata": {"line": 3}},
    {"severity": "fatal", "code": 5, "message": 7, "filePath": "g.ts"}, "no object", {"severity": "info", "code": " ", "message": "", "filePath": "h.ts", "metadata": {}}]}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("reports")
    for name, doc in {"good": json.dumps(GOOD), "bad": "{", "list": "[]", "part": json.dumps({"findings": []}), "history": json.dumps({"version": 1, "snapshots": [{"id": "a", "createdAt": "t", "findingsTotal": 4}, {"id": 5}]})}.items():
        (top / f"{name}.json").write_text(doc)
    return reports.documents(spark, str(top)).withColumn("name", F.regexp_extract("name", "([a-z]+).json$", 1))


def test_shape(docs):
    got = {r.name: r.error for r in reports.checked(docs).collect()}
    assert got["good"] is None and got["bad"] == "invalid JSON" and got["list"] == "no object" and "schemaVersion/generatedAt" in got["part"]


def test_tolerant_and_narrow(docs):
    wide = reports.findings(docs.where("name = 'good'")).orderBy("ord").collect()
    assert [(r.severity, r.code, r.message, r.confidence, r.category) for r in wide] == [("error", "c1", "m", "low", "components"), ("info", "unknown", "", "medium", "imports"), ("info", " ", "", "medium", "imports")]
    assert json.loads(wide[0].metadata) == {"line": 3}
    assert [r.code for r in reports.findings(docs, narrow=True).collect()] == ["c1"]


def test_history(docs):
    assert [(r.id, r.findings_total) for r in reports.history(docs).collect()] == [("a", 4)]


def test_source_lines(spark):
    files = spark.createDataFrame([("a", "1\r\n2\n3\n4\n5")], "file_path string, text string")
    want = spark.createDataFrame([("a", 9), ("a", 2), ("a", 0)], "file_path string, line int")
    got = sorted((r.line, r.number, r.source, r.highlight) for r in reports.source_lines(files, want, 1).collect())
    assert got == [(2, 1, "1", 2), (2, 2, "2", 2), (2, 3, "3", 2), (9, 4, "4", 5), (9, 5, "5", 5)]


def test_views(spark):
    found = spark.createDataFrame([("warning", "lifecycle", "lifecycle-unmanaged-subscribe", "<m>", "a.ts"), ("info", "components", "x", "m", "b.ts")], "severity string, category string, code string, message string, file_path string")
    m = views.signal_matrix(found).first()
    assert (m.on_destroy, m.take_until, m.unsubscribe, m.cleanup) == ("unknown", "no", "no", "no")
    folders = spark.createDataFrame([("",), ("a",), ("a/b",), ("c",)], "folder string")
    open_ = spark.createDataFrame([("",), ("a/b",)], "folder string")
    assert [(r.row, r.folder) for r in views.visible_rows(folders, open_).orderBy("row").collect()] == [(1, ""), (2, "a"), (3, "c")]
    none = spark.createDataFrame([], "kind string, hash string, occurrences long, line_count long, sort_key string")
    occ = spark.createDataFrame([], "kind string, hash string, file_path string, start_line long, end_line long")
    page = views.html_report(found, none, occ, spark.createDataFrame([("a.ts", 40)], "file_path string, score int"), spark.createDataFrame([], "scc string, node_count long, nodes array<string>"))
    assert "&lt;m&gt;" in page and "<td>a.ts</td><td>40</td>" in page


def test_arguments():
    assert arguments(["audit", "-w", "x"]).workspace == "x"
    with pytest.raises(SystemExit):
        arguments(["other"])
