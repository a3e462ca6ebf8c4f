"""A small workspace from files to findings, and the reader's corner cases."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import scalars as X
from corvane.operators import graph
from corvane.plans import audit as A, views
from corvane.sources import config as C, reports, typescript as T, workspace as W

PANEL = """import { Component, OnInit } from '@angular/core';
import { HttpClient } from '@angular/common/http';
import { helper } from '../shared/util';
@Component({ selector: 'x-panel', standalone: true, imports: [Card, Row, Card], template: `<p>
two</p>`, styles: ['p{}'] })
export class PanelComponent implements OnInit {
  private ticker = interval(1000).subscribe(() => this.tick());
  private all = new Subscription();
  constructor(private http: HttpClient, private a: A, private b: B) {}
  ngOnInit(): void {
    this.http.get('/x').subscribe();
    this.router.events.subscribe((e) => e);
    this.form.valueChanges.pipe(takeUntil(this.destroy$)).subscribe();
    this.route.params.pipe(first()).subscribe();
    fromEvent(document, 'click').subscribe();
    window.addEventListener('resize', this.onResize);
    window.addEventListener('scroll', this.onScroll);
    window.removeEventListener('scroll', this.onScroll);
    this.timer = setInterval(() => {}, 5);
    this.frame = requestAnimationFrame(this.draw);
    this.all.add(this.store.subscribe());
    effect(() => { setInterval(() => {}, 1); });
    effect((onCleanup) => { const t = setInterval(() => {}, 1); onCleanup(() => clearInterval(t)); });
    toSignal(this.x$, { manualCleanup: true });
  }
  ngOnDestroy() { cancelAnimationFrame(this.frame); }
}
"""
BODY = "\n".join(f"    total = total + values[{i}] * weight - (offset + {i});" for i in range(12))


def method(name, var):
    body = BODY.replace("total", var)
    return f"  {name}(values: number[], weight: number, offset: number) {{\n    let {var} = 0;\n{body}\n    return {var};\n  }}\n"


FILES = {
    "angular.json": json.dumps({"version": 1, "projects": {"shop": {"root": "", "sourceRoot": "src"}, "none": {"root": "lib"}}}),
    "src/app/panel.component.ts": PANEL,
    "src/app/card.component.ts": "import * as ng from '@angular/core';\n@ng.Component({ templateUrl: './card.html' })\nexport class CardComponent {}\n",
    "src/app/card.html": "<p>\n" * 9,
    "src/app/card.component.spec.ts": "",
    "src/app/data.service.ts": "import { Injectable } from '@angular/core';\nimport { Router } from '@angular/router';\n@Injectable()\nexport class DataService {\n  a = new BehaviorSubject(1);\n  b = localStorage;\n" + method("sum", "total") + "}\n",
    "src/app/other.ts": "import { DataService } from './data.service';\nexport class Other {\n" + method("sum", "total") + method("renamed", "result") + "}\n",
    "src/app/app.routes.ts": "export const routes: Routes = [{ path: '' }, { path: 'info', children: [{ path: 'deep' }] }];\n",
    "src/shared/util.ts": "// import './nowhere';\nimport './b';\nexport const helper = /[/'\"]/.test('x');\n",
    "src/shared/b.ts": "import { c } from './c';\n",
    "src/shared/c.ts": "export * from './util';\n",
    "src/node_modules/x/index.ts": "import './y';",
    "src/_under.ts": "const q = `a${`b${'}'}`}`; import('./shared/b');\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("ws")
    for path, text in FILES.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    return str(top)


@pytest.fixture(scope="module")
def done(spark, root):
    cfg = C.merged({"thresholds": {"componentTsLines": 20, "componentTemplateLines": 5, "serviceTsLines": 10, "serviceMixedMinLines": 5}, "rules": {"component-inline-styles": "off", "import-cycle": "error", "bad": "loud"}})
    return A.audit(spark, root, cfg)


def test_source(spark, root):
    got = {r.file_path for r in W.files(spark, root).select("file_path").collect()}
    assert got == {p for p in FILES if "node_modules" not in p}
    assert W.projects(root) == [("none", "lib", None), ("shop", "", "src")]


def test_graph(done):
    assert {(r.src, r.dst) for r in done.edges.collect()} == {("src/app/panel.component.ts", "src/shared/util.ts"), ("src/shared/util.ts", "src/shared/b.ts"), ("src/shared/b.ts", "src/shared/c.ts"), ("src/shared/c.ts", "src/shared/util.ts"), ("src/_under.ts", "src/shared/b.ts")}
    assert [r.nodes for r in done.cycles.collect()] == [["src/shared/b.ts", "src/shared/c.ts", "src/shared/util.ts"]]


def test_artifacts_and_routes(done):
    assert {(r.artifact, r.file_path) for r in done.artifacts.collect()} == {("component", "src/app/panel.component.ts"), ("component", "src/app/card.component.ts"), ("injectable", "src/app/data.service.ts")}
    assert {r.path for r in done.routes.collect()} == {"", "info", "deep"}


def test_findings(done):
    got = sorted((r.code, r.file_path.split("/")[-1], r.severity) for r in done.findings.collect())
    p = "panel.component.ts"
    assert got == sorted([
        ("component-large-ts", p, "warning"), ("component-missing-spec", p, "warning"), ("component-http-calls", p, "warning"), ("component-standalone-duplicate-imports", p, "info"), ("component-inline-template", p, "info"),
        ("service-large-ts", "data.service.ts", "warning"), ("service-missing-spec", "data.service.ts", "warning"), ("service-mixed-responsibility", "data.service.ts", "warning"), ("import-cycle", "b.ts", "error"),
        ("lifecycle-broken-destroy-subject", p, "warning"), ("lifecycle-subscription-field-not-unsubscribed", p, "warning"), ("lifecycle-subscription-field-not-unsubscribed", p, "warning"), ("lifecycle-addEventListener-no-remove", p, "warning"),
        ("lifecycle-setInterval-no-clearInterval", p, "warning"), ("lifecycle-toSignal-manualCleanup", p, "info"), ("lifecycle-effect-missing-onCleanup", p, "warning"), ("lifecycle-fromEvent-subscribe-no-cleanup", p, "warning"), ("lifecycle-unmanaged-subscribe", p, "warning"),
    ])


def test_symbols_and_duplicates(done):
    ids = {r.id for r in done.methods.collect()}
    assert "method:src/app/other.ts#Other.renamed@19" in ids and "method:src/app/data.service.ts#DataService.sum@7" in ids
    groups = {(r.kind, r.occurrences) for r in done.groups.collect()}
    assert groups == {("exact", 2), ("normalized", 3)}
    top = {r.file_path: r for r in done.hotspots.collect()}
    assert top["src/app/other.ts"].dup_occurrences == 3 and top["src/app/other.ts"].duplication == 15
    assert top["src/app/panel.component.ts"].spec_points == 10 and top["src/shared/b.ts"].fan_in == 2


def test_references_and_details(done):
    got = {(r.method_id.split("#")[1].split("@")[0], r.line, r.snippet) for r in done.references.collect()}
    assert got == set()  # this.tick, this.draw and this.onResize are no methods of PanelComponent
    tree = {r.name: r.method_ids for r in views.symbol_tree(done.classes, done.methods).collect()}
    assert [m.split("#")[1] for m in tree["Other"]] == ["Other.renamed@19", "Other.sum@3"] and tree["CardComponent"] == []
    d = {r.file_path: r for r in views.file_details(done.classes, done.methods, done.hotspots, done.references, done.occurrences).collect()}
    assert (d["src/app/other.ts"].methods, d["src/app/other.ts"].groups) == (2, 2)



def test_listing(spark, tmp_path):
    """Deep, wide, skipped, linked and unreadable folders: the same files as one walk."""
    top = tmp_path / "w"
    deep = top.joinpath(*["d"] * 25)
    deep.mkdir(parents=True)
    (deep / "x.ts").write_text("deep")
    for k in range(300):
        (top / f"f{k % 7}").mkdir(exist_ok=True)
        (top / f"f{k % 7}" / f"é{k}.ts").write_text(str(k))
    for name in ("node_modules/a.ts", "dist/b.ts", "f1/.git/c"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("")
    (top / "link").symlink_to(top / "f1")
    (top / "f1" / "file.bin").write_bytes(b"\xff")
    (top / "f2" / "bad.ts").write_bytes(b"a\xffb\r\n")
    want = {p: n for p, n in W.walk(str(top))}
    assert {r.file_path: r["size"] for r in W.listed(spark, str(top)).collect()} == want and len(want) == 303
    got = {r.file_path: r.text for r in W.files(spark, str(top)).collect()}
    assert set(got) == set(want) and got["f1/file.bin"] is None and got["f2/bad.ts"] == "a\ufffdb\r\n" and got["/".join(["d"] * 25) + "/x.ts"] == "deep"
    spark.dataSource.register(W.WorkspaceSource)
    assert {r.file_path: r.text for r in spark.read.format("workspace").option("root", str(top)).load().collect()} == got
    assert W.listed(spark, str(tmp_path / "gone")).count() == 0


def test_wide_and_deep_folders():
    chain = [{"folder": "/".join(["a"] * n), "parent": "/".join(["a"] * (n - 1)) if n else None, "files": n} for n in range(1500)]
    node = views.nested_folders(chain)
    for n in range(1499):
        (node,) = node["folders"]
    assert node["files"] == 1499


def test_nested_folders():
    rows = [{"folder": "", "parent": None, "files": 3}, {"folder": "a", "parent": "", "files": 2}, {"folder": "a/b", "parent": "a", "files": 1}]
    assert views.nested_folders(rows) == {"path": "", "files": 3, "folders": [{"path": "a", "files": 2, "folders": [{"path": "a/b", "files": 1, "folders": []}]}]}


def test_outputs(spark, done, root):
    out = A.write(done, root, "2020-01-01T00:00:00Z")
    doc = json.load(open(f"{out}/report.json"))
    assert doc["schemaVersion"] == 7 and len(doc["findings"]) == 18 and doc["workspaceRoot"] == root
    assert doc["summary"] == {"projects": 2, "components": 2, "services": 1, "routes": 3}
    assert [c["id"] for c in doc["analyzerCategories"]] == ["projectTree", "components", "services", "routes", "imports", "lifecycle", "duplication", "symbols", "hotspots"] and sum(len(c["findingCodes"]) for c in doc["analyzerCategories"]) == 22
    assert doc["projectTree"]["projects"][1]["sourceRoots"][0]["rootFolder"]["path"] == "src" and doc["projectTree"]["projects"][0] == {"name": "none", "root": "lib", "sourceRoot": None, "sourceRoots": []}
    assert {c["name"] for c in doc["symbols"]["classes"]} == {"PanelComponent", "CardComponent", "DataService", "Other"}
    own = reports.checked(reports.documents(spark, f"{out}/report.json")).select("error").first()
    assert own.error is None
    read = reports.documents(spark, f"{out}/report.json")
    for narrow in (False, True):  # nothing that was written is lost to either reader
        back = reports.findings(read, narrow).collect()
        assert sorted((r.code, r.file_path, r.message) for r in back) == sorted((r.code, r.file_path, r.message) for r in done.findings.collect())
        assert all(r.file_path and r.why_it_matters and r.metadata != "{}" for r in back if r.code not in ("lifecycle-toSignal-manualCleanup",))
    panel = {f["code"]: f["metadata"] for f in doc["findings"] if f["filePath"].endswith("panel.component.ts")}
    assert panel["component-http-calls"] == {"projectName": "shop", "componentFilePath": "src/app/panel.component.ts", "httpPropertyName": "http", "methods": ["get"]}
    assert panel["lifecycle-addEventListener-no-remove"] | {"line": 0, "column": 0} == {"className": "PanelComponent", "line": 0, "column": 0, "targetText": "window", "eventName": "resize", "handlerText": "this.onResize"}
    assert [f["category"] for f in doc["findings"]] == sorted((f["category"] for f in doc["findings"]), key=["components", "services", "routes", "architecture", "lifecycle"].index)
    shop = next(p for p in doc["projects"] if p["name"] == "shop")
    assert [c["filePath"] for c in shop["components"]] == ["src/app/card.component.ts", "src/app/panel.component.ts"] and [r["path"] for r in shop["routes"]] == ["", "deep", "info"] and shop["directives"] == []
    app = doc["projectTree"]["projects"][1]["sourceRoots"][0]["rootFolder"]["folders"][0]
    assert app["path"] == "src/app" and [f["filePath"] for f in app["files"]] == [f"src/app/{n}.ts" for n in ("card.component", "data.service", "other", "panel.component")] and len(app["services"]) == 1 and app["folders"] == []
    assert [c["methodIds"] for c in app["files"][2]["classes"]] == [["method:src/app/other.ts#Other.renamed@19", "method:src/app/other.ts#Other.sum@3"]]
    assert [(g["kind"], len(g["occurrences"])) for g in doc["duplicateGroups"]] == [("exact", 2), ("normalized", 3)] and all(o["methodId"].startswith("method:src/app/") for g in doc["duplicateGroups"] for o in g["occurrences"]) and doc["duplicateGroups"][0]["preview"].startswith("{")
    assert doc["importGraph"]["cycles"] == 1 and doc["hotspotScores"][0]["score"] >= doc["hotspotScores"][-1]["score"] and doc["symbols"]["files"][0] == {"id": "file:src/app/card.component.ts", "filePath": "src/app/card.component.ts"}
    brief = json.load(open(f"{out}/brief.json"))
    assert {a["id"]: a["priority"] for a in brief["priorityAreas"]}["lifecycle"] == "P0" and brief["priorityAreas"][1]["stats"] == {"cycles": 1, "files": 3}
    tracks = {t["areaId"]: t for t in brief["tracks"]}
    assert list(tracks) == [a["id"] for a in brief["priorityAreas"]] and brief["summary"]["findings"]["total"] == 18 and brief["health"]["grade"] in "ABCDF"
    dup = next(t for t in tracks["duplicates"]["tasks"] if "normalized" in t["title"])
    assert dup["description"].split("Occurrences:\n")[1] == "\n".join(f"- src/app/{p}" for p in ("data.service.ts:7-22", "other.ts:19-34", "other.ts:3-18")) and dup["evidence"]["duplicateGroupIds"][0].startswith("dup:normalized:")
    rank = {"high": 0, "medium": 1, "low": 2, "small": 0, "large": 2}
    keys = [(rank[t["impact"]], rank[t["effort"]], t["title"]) for t in tracks["lifecycle"]["tasks"]]
    assert keys == sorted(keys) and all(t["description"] and t["affectedFiles"] for k in tracks.values() for t in k["tasks"])
    assert "TS: " in tracks["oversized"]["tasks"][0]["description"] and tracks["import-cycles"]["tasks"][0]["description"].startswith("Files:\n- src/shared/b.ts")
    assert open(f"{out}/brief.md").read().startswith("# Brief: ")


def test_external_template(spark, root):
    cfg = C.merged({"thresholds": {"componentTemplateLines": 5}})
    facts = spark.createDataFrame([("a/x.component.ts", "component_gate", None, None), ("a/x.component.ts", "template_url", "../t/x.html", None), ("a/x.component.ts", "complexity", None, 3)], "file_path string, kind string, key string, n long")
    for c, kind in (("value", "string"), ("cls", "string"), ("method", "string"), ("extra", "string"), ("line", "int"), ("col", "int"), ("ord", "int")):
        facts = facts.withColumn(c, F.lit(None).cast(kind))
    files = spark.createDataFrame([("t/x.html", "a\n" * 9), ("a/x.component.spec.ts", "")], "file_path string, text string")
    got = A.component_findings(facts, files, facts.select("file_path"), cfg).collect()
    assert [(r.code, r.file_path) for r in got] == [("component-large-template", "t/x.html")]


def test_config():
    c = C.merged({"exclude": {"paths": [" src/gen ", 5]}, "thresholds": {"componentTsLines": -1, "serviceTsLines": 7}, "rules": {"new-code": "info", "x": "loud"}, "report": {"outputDir": " out "}})
    assert c.exclude == ("src/gen",) and c.thresholds["componentTsLines"] == 200 and c.thresholds["serviceTsLines"] == 7 and c.rules == {"new-code": "info"} and c.output_dir == "out"
    assert C.is_excluded("./src/gen/a.ts", c.exclude) and not C.is_excluded("src/general.ts", c.exclude)
    assert C.is_excluded("a/b/c.ts", ("a/**",)) and not C.is_excluded("a/b/c.ts", ("a/*.ts",)) and not C.is_excluded("src/a.ts", ("src/**/a.ts",))
    assert C.output_dir("/w", "../x") == "/w/.corvane" == C.output_dir("/w", ".") == C.output_dir("/w", "/abs") == C.output_dir("/w", "")
    assert C.output_dir("/w", "out/r") == "/w/out/r"


def test_scanner():
    shape = [t.text for t in T.scan("a = b / c; d = /x[/]y/g; `p${q + `r`}s`; /* / */ 1_0.5e3")]
    assert "/x[/]y/g" in shape and "/" in shape and "1_0.5e3" in shape and "`p" in shape and "}" in shape
    assert T.raw_tokens("const x = 'a' + 5;") == ["const", "<id>", "=", "<str>", "+", "<num>", ";"]
    assert T.exact_block("\n    a  \n      b\n\n") == "a\n  b"
    f = T.File("x.ts", "class A { f = () => { if (x) y?.z ?? w; }; g?: string; h() { return a ? b : c; } } const B = class { q() {} };")
    assert [c.name for c in f.classes] == ["A"] and f.branches(0, len(f.t)) == 2
    assert [(m.kind, m.name) for m in f.classes[0].members] == [("prop", "f"), ("prop", "g"), ("method", "h")]


def test_scalars(spark):
    vectors = {"": "811c9dc5", "a": "e40c292c", "foobar": "bf9cf968"}
    rows = spark.createDataFrame([(k,) for k in vectors], "s string").select("s", X.fnv1a(F.col("s")).alias("h"), X.fnv1a_text("s").alias("t")).collect()
    assert {r.s: r.h for r in rows} == vectors == {r.s: r.t for r in rows}
    d = spark.createDataFrame([("a/b.c/d.x.ts", "x\r\ny\n", 12)], "p string, t string, n long")
    r = d.select(X.extname(F.col("p")).alias("e"), X.dirname(F.col("p")).alias("d"), X.line_count(F.col("t")).alias("l"), X.pad_start(F.col("n"), 6).alias("n"), X.grade(F.col("n")).alias("g"), X.snippet(F.col("t"), F.lit(2)).alias("s"), X.html_escaped(F.lit("<a&'\">")).alias("h")).first()
    assert (r.e, r.d, r.l, r.n, r.g, r.s, r.h) == (".ts", "a/b.c", 3, "000012", "F", "y", "&lt;a&amp;&#39;&quot;&gt;")


def test_components_against_tarjan(spark):
    import random

    rng = random.Random(8)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(95)} | {(70, 70), (80, 81), (81, 82), (82, 80), (82, 83)}
    reach = {}
    for a in {a for e in edges for a in e}:
        seen, todo = set(), [a]
        while todo:
            for s, t in edges:
                if s == todo[-1] and t not in seen:
                    seen.add(t)
                    todo.insert(0, t)
            todo.pop()
        reach[a] = seen
    want = {a: min(b for b in r if a in reach[b]) for a, r in reach.items() if a in r}
    got = {r.node: r.scc for r in graph.cyclic_components(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    assert got == want


def test_long_cycles(spark):
    """A cycle of 5,000 nodes, one of 600 with a chord and a tail, two that share a node."""
    ring = lambda a, n: [(a + i, a + (i + 1) % n) for i in range(n)]
    edges = ring(0, 5000) + ring(10_000, 600) + [(10_010, 10_300), (10_599, 20_000), (20_000, 20_001)] + ring(30_000, 50) + [(30_000, 30_100), *((30_100 + i, 30_101 + i) for i in range(40)), (30_140, 30_000)]
    got = {}
    for r in graph.cyclic_components(spark.createDataFrame(edges, "src long, dst long")).collect():
        got.setdefault(r.scc, set()).add(r.node)
    assert got == {0: set(range(5000)), 10_000: set(range(10_000, 10_600)), 30_000: {*range(30_000, 30_050), *range(30_100, 30_141)}}
