"""Syntax trees, typed references, repeated blocks of all callables, statements around places."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import blocks, spans, types
from corvane.sources import config as C, typed
from corvane.sources.tree import Tree
from corvane.sources.typescript import File


def shape(text):
    """A tree as nested tuples of kinds and names."""
    f = File("x.ts", text)
    go = lambda n: (n.kind + (f":{n.name}" if n.name else ""), *[go(k) for k in n.kids])
    return [go(k) for k in Tree(f).root.kids]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a.b(c)", [("expr", ("call", ("member:b", ("id:a",)), ("id:c",)))]),
        ("x = y ? (z) : w => w", [("expr", ("assign:=", ("id:x",), ("cond", ("id:y",), ("paren", ("id:z",)), ("arrow", ("param:w",), ("id:w",)))))]),
        ("x = y ? (z): w => w : v", [("expr", ("assign:=", ("id:x",), ("cond", ("id:y",), ("arrow", ("param:z",), ("id:w",)), ("id:v",))))]),
        ("f<A>(b); c < d", [("expr", ("call", ("id:f",), ("id:b",))), ("expr", ("binary:<", ("id:c",), ("id:d",)))]),
        ("a >>= b >> c >= d", [("expr", ("assign:>>=", ("id:a",), ("binary:mixed", ("id:b",), ("id:c",), ("id:d",))))]),
        ("if (a) b; else { c }", [("if", ("paren", ("id:a",)), ("expr", ("id:b",)), ("block", ("expr", ("id:c",))))]),
        ("for (const a of b) a()", [("for", ("vars", ("var:a",)), ("id:b",), ("expr", ("call", ("id:a",))))]),
        ("type P<T> = T extends (infer U)[] ? U : never; let q: P<A>[] = r", [("alias:P",), ("vars", ("var:q", ("id:r",)))]),
        ("const k = class N { m() {} }", [("vars", ("var:k", ("classexpr:N", ("method:m", ("body",)))))]),
        ("`a${b.c`d`}e`", [("expr", ("template", ("tagged", ("member:c", ("id:b",)), ("template",))))]),
        ("do a(); while (b) c", [("do", ("expr", ("call", ("id:a",))), ("paren", ("id:b",))), ("expr", ("id:c",))]),
        ("switch (a) { case 1: b; default: }", [("switch", ("paren", ("id:a",)), ("case", ("lit",), ("expr", ("id:b",))), ("case",))]),
        ("x = { a, b() {}, get c() { return 1 }, ...d, [e]: 1 }", [("expr", ("assign:=", ("id:x",), ("object", ("prop:a",), ("method:b", ("body",)), ("get:c", ("body", ("return", ("lit",)))), ("prop", ("id:d",)), ("prop", ("id:e",), ("lit",)))))]),
        ("export default async function g<T>(a: T, { b }: C = {}): Promise<T> { await a }", [("function:g", ("param:a",), ("param", ("object",)), ("body", ("expr", ("await:await", ("id:a",)))))]),
        ("interface I extends J { a: B; c(d: E): F; [k: string]: G }", [("interface:I", ("field:a",), ("method:c", ("param:d",)), ("field", ("id:k",)))]),
        ("try { a } catch { b } finally { c }", [("try", ("body", ("expr", ("id:a",))), ("catch", ("body", ("expr", ("id:b",)))), ("body", ("expr", ("id:c",))))]),
        ("a as unknown as B; <C>d", [("expr", ("cast:as", ("cast:as", ("id:a",)))), ("expr", ("cast", ("id:d",)))]),
        ("const a = async <T,>(x: T) => ({ x })", [("vars", ("var:a", ("arrow", ("param:x",), ("paren", ("object", ("prop:x",))))))]),
    ],
)
def test_tree(text, want):
    assert shape(text) == want


def test_generated_trees():
    """Random programs written from random trees read back as the same trees."""
    rng = random.Random(7)

    def expr(d):
        k = rng.randrange(8 if d else 2)
        if k < 2:
            n = rng.choice("abcd")
            return n, (f"id:{n}",)
        if k == 2:
            s, t = expr(d - 1)
            n = rng.choice("mno")
            return f"({s}).{n}", (f"member:{n}", ("paren", t))
        if k == 3:
            (s, t), (u, v) = expr(d - 1), expr(d - 1)
            return f"({s})({u})", ("call", ("paren", t), v)
        if k == 4:
            s, t = block(d - 1, "body")
            return f"(p) => {s}", ("arrow", ("param:p",), t)
        if k == 5:
            s, t = block(d - 1, "body")
            return f"class K {{ m() {s} }}", ("classexpr:K", ("method:m", t))
        if k == 6:
            s, t = block(d - 1, "body")
            return f"function f(q) {s}", ("fnexpr:f", ("param:q",), t)
        parts = [expr(d - 1) for _ in range(rng.randrange(3))]
        return "[" + ", ".join(s for s, _ in parts) + "]", ("array", *[t for _, t in parts])

    def statement(d):
        k = rng.randrange(4)
        if k == 0 or not d:
            s, t = expr(d)
            return f"x = {s};", ("expr", ("assign:=", ("id:x",), t))
        if k == 1:
            (s, t), (u, v) = expr(d - 1), block(d - 1, "block")
            return f"while ({s}) {u}", ("while", ("paren", t), v)
        if k == 2:
            s, t = expr(d - 1)
            return f"const v: A<B[]> | null = {s};", ("vars", ("var:v", t))
        s, t = block(d - 1, "body")
        return f"function g() {s}", ("function:g", t)

    def block(d, kind):
        parts = [statement(max(d, 0)) for _ in range(rng.randrange(3))]
        return "{\n" + "\n".join(s for s, _ in parts) + "\n}", (kind, *[t for _, t in parts])

    for _ in range(150):
        parts = [statement(3) for _ in range(4)]
        assert shape("\n".join(s for s, _ in parts)) == [t for _, t in parts]


def test_any_text_is_read(spark, sf):
    rng = random.Random(3)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect()] + ["", "(" * 3000, "{[(<" * 400, "a." * 3000, "a ? " * 500, "`${" * 500, "class " * 50, "@" * 99]
    texts += ["".join(rng.choice(["(", ")", "{", "}", "[", "]", "<", ">", "=>", "class ", "a", ".", "?", ":", ",", ";", "`", "${", "'", "/", "function ", "get ", "@", "=", "\n"]) for _ in range(300)) for _ in range(60)]
    for t in texts:
        assert typed.Reader("x.ts", t).rows[0]["kind"] == "file"


FILES = {
    "src/a.ts": "export class Base { low() { return this; } static make() { return new A(); } }\nexport class A extends Base {\n  kid = new Kid();\n  foo(n: number[]) { return this.kid; }\n}\nexport class Kid { run() {} async later(): Promise<A> { return null as any; } }\n",
    "src/barrel/index.ts": "export * from '../a';\nexport { A as Alpha } from '../a';\nexport * as all from '../a';\nexport * from './round';",
    "src/barrel/round.ts": "export * from '.';\nexport * from './index';",
    "src/c.ts": "import { A, Alpha, all } from './barrel';\nimport * as ns from './a';\nconst a = new A();\na.foo([1]);\na.foo([]).run();\nnew Alpha().low();\nnew all.Kid().run();\nns.A.make().foo([]);\nasync function q(k: ns.Kid, A: string) { (await k.later()).kid.run(); [a].forEach(x => x.foo([])); A.foo(); }\na.none(); b.foo(); a['foo']();\n",
    "src/d.ts": "import { Alpha as X } from './barrel';\nimport { svc } from '@app/e';\n@Injectable()\nexport class D extends X {\n  other = inject(X);\n  constructor(private readonly x: X | null) { super(); }\n  go() { this.x!.foo([]); this.foo([]); super.low(); const self = this; self.go(); svc.go(); for (const y of [this.x]) { y?.kid.run(); } this.other.foo([]); }\n}\n",
    "src/app/e.ts": "import { D } from '../d';\nexport const svc: D = null!;\nfunction rec() { return rec(); }\nrec().go();\nclass G<T> { t: T; m() { this.t.go(); const f = () => svc; f().go(); } }\nconst loop = loop2, loop2 = loop; loop.go();\nexport default svc;\n",
    "src/f.ts": "import it, { missing } from './app/e';\nit.go(); missing.go();\nlet v: { a: D };\nv.a.go();\nimport { Missing } from './barrel';\nnew Missing().run();\n",
}


@pytest.fixture(scope="module")
def workspace(spark):
    return spark.createDataFrame(list(FILES.items()), "file_path string, text string")


def test_references(workspace):
    """Through imports under other names, barrels that import themselves, injected fields, results, items, statics and the class above."""
    got = types.references(typed.extract(workspace), workspace.select("file_path"), ".", {"@app/*": ["src/app/*"]}).collect()
    seen = sorted((r.file_path, r.line, FILES[r.file_path].split("\n")[r.line - 1][r.col - 1 :].split("(")[0], r.method_id.split("#")[1]) for r in got)
    foo, run, low, go = "A.foo@4", "Kid.run@6", "Base.low@1", "D.go@7"
    want = [("src/c.ts", 4, "foo", foo), ("src/c.ts", 5, "foo", foo), ("src/c.ts", 5, "run", run), ("src/c.ts", 6, "low", low), ("src/c.ts", 7, "run", run), ("src/c.ts", 8, "make", "Base.make@1"), ("src/c.ts", 8, "foo", foo)]
    want += [("src/c.ts", 9, "later", "Kid.later@6"), ("src/c.ts", 9, "run", run), ("src/c.ts", 9, "foo", foo)]
    want += [("src/d.ts", 7, "foo", foo)] * 3 + [("src/d.ts", 7, "low", low), ("src/d.ts", 7, "go", go), ("src/d.ts", 7, "go", go), ("src/d.ts", 7, "run", run)]
    want += [("src/app/e.ts", 5, "go", go), ("src/f.ts", 2, "go", go)]
    assert seen == sorted(want)


def test_this_references(spark):
    files = spark.createDataFrame([("a.ts", "class A { m() { this.n(); x.m(); } n() { return this.m; } }")], "file_path string, text string")
    got = types.references(typed.extract(files), files.select("file_path")).collect()
    assert sorted((r.method_id.split("#")[1], r.line, r.col) for r in got) == [("A.m@1", 1, 54), ("A.n@1", 1, 22)]


def test_references_of_nothing(spark, workspace):
    none = workspace.where("false")
    assert types.references(typed.extract(none), none.select("file_path")).count() == 0


def test_tsconfig(tmp_path):
    assert C.ts_paths(str(tmp_path)) == (None, None)
    (tmp_path / "tsconfig.json").write_text('{ // c\n "compilerOptions": { "baseUrl": "./", /* "x" */ "paths": { "@a/*": ["src/*", 5,], "b": "no" }, } }')
    assert C.ts_paths(str(tmp_path)) == ("./", {"@a/*": ["src/*"]})
    (tmp_path / "tsconfig.json").write_text("[]")
    assert C.ts_paths(str(tmp_path)) == (None, None)


def test_aliases(spark):
    df = spark.createDataFrame([("a/b.ts", s) for s in ("./x", "@a/x", "@a/deep/x", "b", "rx")], "file_path string, spec string")
    got = {r.spec: r.as_spec for r in types.aliased(df, None, {"@a/*": ["src/*"], "@a/deep/*": ["./deep/*"], "b": ["lib/b.ts"]}).collect()}
    assert got == {"./x": "./x", "@a/x": "./../src/x", "@a/deep/x": "./../deep/x", "b": "./../lib/b.ts", "rx": None}
    assert types.aliased(df, "src", None).where("spec = 'rx'").first().as_spec == "./../src/rx"


BODY = "{\n  const out: number[] = [];\n  for (const n of nums) {\n    if (n % 2 === 0) {\n      out.push(n * 2);\n    } else {\n      out.push(n);\n    }\n  }\n  return out;\n}"


def test_blocks_of_all_callables(spark):
    other = BODY.replace("out", "res").replace("const n", "const v")
    files = [("b.ts", f"export class B {{ m(nums: number[]) {BODY} }}"), ("B.ts", f"const f = (nums) => {BODY};"), ("a.ts", f"\n\nfunction g(nums) {other}"), ("é.ts", f"const o = {{ h(nums) {BODY}, get k() {other} }};"), ("z.ts", f"class Z {{ constructor(nums) {BODY} }}"), ("z2.ts", f"x(function (nums) {BODY.replace('2;', '3;')})")]
    found = blocks.repeated(blocks.of(typed.extract(spark.createDataFrame(files, "file_path string, text string"), 6, 20)))
    got = {(r.kind, r.occurrences, r.first_file, r.line_count) for r in found.collect()}
    # b before B in a locale, é before z; places of one file alone are no group
    assert got == {("exact", 5, "b.ts", 11), ("exact", 2, "a.ts", 11), ("normalized", 7, "a.ts", 11)}


def plain_statement(text, line, column):
    """The closest statement by walking the tree."""
    lines = text.split("\n")
    at = min(line, len(lines))
    own = lines[at - 1].removesuffix("\r")
    pos = sum(len(x) + 1 for x in lines[: at - 1]) + min(max(column, 1) - 1, len(own))
    rows = typed.Reader("x.ts", text).rows
    best = max((r for r in rows if r["kind"] == "stmt" and r["start"] <= pos < r["end"]), key=lambda r: r["depth"], default=None)
    if best:
        return text[best["n"] : best["end"]].strip()
    return text[rows[0]["n"] :].strip() if pos >= len(text) else ""


def test_statements(spark):
    rng = random.Random(11)
    texts = {f"s{k}.ts": t for k, t in enumerate(FILES.values())} | {"long.ts": "class A {\n" + "".join(f"  m{k}() {{ if (a{k}) {{ b(); }}\n    return {{ c: () => {{ d({k}); }} }};\n  }}\n" for k in range(400)) + "}\n\n// end\n", "none.ts": " // nothing", "empty.ts": "", "crlf.ts": "a();\r\nb();\r\n"}
    places = [(p, rng.randrange(1, t.count("\n") + 3), rng.randrange(0, 40)) for p, t in texts.items() for _ in range(40)] + [("long.ts", 10**6, 1), ("none.ts", 1, 99), ("s0.ts", 0, 1), ("gone.ts", 1, 1)]
    files = spark.createDataFrame(list(texts.items()), "file_path string, text string")
    got = spans.statements(files, typed.extract(files), spark.createDataFrame(places, "file_path string, line int, column int")).collect()
    assert len(got) == len({p for p in places if p[0] in texts and p[1] >= 1})
    assert all(r.statement == plain_statement(texts[r.file_path], r.line, r.column) for r in got)
    assert sum(len(r.statement) > 0 for r in got) > 100


def test_statement_is_the_closest(spark):
    t = "function f() {\n  if (a) {\n    b.c(d);\n  }\n}\n"
    files = spark.createDataFrame([("a.ts", t)], "file_path string, text string")
    ask = spark.createDataFrame([("a.ts", 3, 8), ("a.ts", 2, 4), ("a.ts", 1, 3), ("a.ts", 4, 3)], "file_path string, line int, column int")
    got = {(r.line, r.column): r.statement for r in spans.statements(files, typed.extract(files), ask).collect()}
    assert got[3, 8] == "b.c(d);" and got[2, 4].startswith("if (a)") and got[1, 3] == t.strip() and got[4, 3].startswith("{")


def test_locale_key(spark):
    from corvane.functions.scalars import locale_key

    words = ["b", "B", "a", "A", "é", "e", "z", "_x", "-x", "x", "10", "9"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").orderBy(locale_key(F.col("w"))).collect()
    assert [r.w for r in rows] == ["_x", "-x", "10", "9", "a", "A", "b", "B", "e", "é", "x", "z"]
