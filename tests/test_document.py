"""Large JSON documents written by executors, and the project tree."""

import json
import random

from pyspark.sql import functions as F

from corvane.plans import document
from corvane.sources import json_document as J
from corvane.sources.json_document import at, lines


def test_lists_over_many_parts(spark, tmp_path):
    """Empty and nested lists, lists that begin and end with a part, odd text."""
    rng = random.Random(4)
    names = [f"n{rng.randrange(10**6)}\"é\n\\" for _ in range(300)] + ["_", "-", "a", "A", "b", "é"]
    df = spark.createDataFrame([(n, k % 7) for k, n in enumerate(dict.fromkeys(names))], "name string, g int")
    one, groups = spark.range(1), df.select("g").distinct()
    doc = lines(one, [at(0)], '{"empty":[', False)
    for more in (
        lines(df.where("false"), [at(1), at(0, F.col("name"))], F.to_json(F.struct("name"))),
        lines(one, [at(2)], '],"rows":[', False),
        lines(df, [at(3), at(0, F.col("name"))], F.to_json(F.struct("name", "g"))),
        lines(one, [at(4)], '],"groups":[', False),
        lines(groups, [at(5), at(F.col("g"))], F.concat(F.lit('{"g":'), F.col("g").cast("string"), F.lit(',"in":['))),
        lines(df.where("g < 5"), [at(5), at(F.col("g")), at(1, F.col("name"))], F.to_json(F.struct("name"))),
        lines(groups, [at(5), at(F.col("g")), at(2)], "]}", False),
        lines(one, [at(6)], "]}", False),
    ):
        doc = doc.unionByName(more)
    for parts in (1, 5, 97, 400):
        J.write(doc, f"file://{tmp_path}/doc.json", parts)
        got = json.loads((tmp_path / "doc.json").read_text())
        assert got["empty"] == [] and sorted(r["name"] for r in got["rows"]) == sorted(set(names))
        assert [r["name"] for r in got["rows"] if len(r["name"]) == 1] == ["_", "-", "a", "A", "b", "é"]
        assert [g["g"] for g in got["groups"]] == list(range(7)) and [len(g["in"]) for g in got["groups"]] == [sum(r["g"] == k for r in got["rows"]) if k < 5 else 0 for k in range(7)]
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["doc.json"]  # no parts are left


def plain_tree(root, items):
    """Nested folders by insertion, for ASCII names of one case."""
    make = lambda p: {"path": p, "folders": [], "files": [], "components": [], "directives": [], "pipes": [], "services": [], "routes": []}
    names = ["files", "components", "directives", "pipes", "services", "routes"]
    top = make(root)
    for kind, path in sorted(items, key=lambda x: x[1]):
        folder = path.rsplit("/", 1)[0] if "/" in path else ""
        node = top
        for seg in folder[len(root) + 1 :].split("/") if folder.startswith(root + "/") else []:
            p = f"{node['path']}/{seg}"
            kid = next((f for f in node["folders"] if f["path"] == p), None)
            if kid is None:
                kid = make(p)
                node["folders"].append(kid)
            node = kid
        node[names[kind]].append({"filePath": path})
    def sort(n):  # noqa: E306
        n["folders"].sort(key=lambda f: f["path"])
        for f in n["folders"]:
            sort(f)
    sort(top)
    return top


def test_project_tree(spark, tmp_path):
    """Deep folders, wide folders, names that begin alike, items outside the source root, projects without a source root."""
    rng = random.Random(2)
    paths = ["src/" + "/".join(rng.choice("abc") + rng.choice(["", "x", "xx"]) for _ in range(rng.randrange(1, 6))) + f"/f{k:03}.ts" for k in range(150)]
    paths += ["src/" + "d/" * 60 + "deep.ts", "src/top.ts", "lib/out.ts", "out.ts", "srcx/no.ts"] + [f"src/wide{k:03}/f.ts" for k in range(120)]
    items = [(rng.randrange(6), p) for p in paths]
    rows = [("p", "src", k, p, p, json.dumps({"filePath": p})) for k, p in items]
    df = spark.createDataFrame(rows, "project string, source_root string, kind int, name string, file_path string, text string")
    projects = spark.createDataFrame([("p", "", "./src/"), ("none", None, None), ("bare", "x", "other")], "project string, root string, source_root string")
    doc = lines(spark.range(1), [at(1)], '{"projects":[', False).unionByName(lines(spark.range(1), [at(9)], "]}", False))
    for part in document.tree_lines(df, projects, 2):
        doc = doc.unionByName(part)
    J.write(doc, f"file://{tmp_path}/tree.json", 9)
    got = {p["name"]: p for p in json.loads((tmp_path / "tree.json").read_text())["projects"]}
    assert list(got) == ["bare", "none", "p"] and got["none"] == {"name": "none", "root": None, "sourceRoot": None, "sourceRoots": []}
    assert got["bare"]["sourceRoots"][0]["rootFolder"] == plain_tree("other", [])
    assert got["p"]["sourceRoots"] == [{"sourceRoot": "src", "rootFolder": plain_tree("src", items)}]
