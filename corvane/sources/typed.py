"""Facts from the syntax trees of files: what names and members stand for, property accesses, callable blocks, statements.

A value is described by a base and steps from it, so that its class can be found by joins over many files (`operators.types`):
base `name` (the value of a name in its file), `class` and `static` (an instance of a class, or the class itself); steps `.m` (a member), `()` (a call), `[]` (an item), `await`, `new`, `^` (the class
above), and the same with a w before it for a value that is wrapped so (w[]: an array of it).  Names of functions' own scopes are
looked up here; those of the file and its imports are left to the joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.sources.facts import analyzable, rows_of
from corvane.sources.tree import FUNCTIONS, STATEMENTS, Node, Tree, Type
from corvane.sources.typescript import MIN_LINES, MIN_TOKENS, File, hashed

SCHEMA = "file_path string, kind string, ord int, cls string, name string, static boolean, base string, of string, steps array<string>, spec string, other string, line int, col int, start int, end int, depth int, n int, n2 int"
_ARROW = pa.schema([("file_path", pa.string()), ("kind", pa.string()), ("ord", pa.int32()), ("cls", pa.string()), ("name", pa.string()), ("static", pa.bool_()), ("base", pa.string()), ("of", pa.string()), ("steps", pa.list_(pa.string())), ("spec", pa.string()), ("other", pa.string()), *[(c, pa.int32()) for c in ("line", "col", "start", "end", "depth", "n", "n2")]])
#: Methods of arrays that call back with an item first.
ITEM_CALLS = frozenset("forEach map filter find findIndex findLast some every flatMap".split())
#: The steps of expressions that go on from their first part; longer rows of steps have no meaning.
CHAIN = {"call": "()", "new": "new", "index": "[]", "await": "await", "paren": "", "nonnull": ""}
LONGEST, NESTED = 64, 40
ACCESS = frozenset("public private protected readonly override".split())
BLOCKS = frozenset("function fnexpr arrow method ctor get set".split())


@dataclass(frozen=True)
class Value:
    base: str
    of: str
    steps: tuple[str, ...] = ()

    def then(self, *steps: str) -> Value:
        out = list(self.steps)
        for s in steps:
            if out and out[-1] == "w" + s:
                out.pop()
            else:
                out.append(s)
        while len(out) > 1 and out[-1] == "wnew" and out[-2] == "new":  # the class itself again
            del out[-2:]
        return Value(self.base, self.of, tuple(out))


@dataclass
class Scope:
    up: Scope | None = None
    this: Value | None = None
    names: dict[str, object] = field(default_factory=dict)  # name -> a node, or (value maker)
    generics: frozenset[str] = frozenset()

    def find(self, name: str) -> tuple[object, Scope] | None:
        s: Scope | None = self
        while s is not None:
            if name in s.names:
                return s.names[name], s
            s = s.up
        return None

    def generic(self, name: str) -> bool:
        s: Scope | None = self
        while s is not None:
            if name in s.generics:
                return True
            s = s.up
        return False


#: All kinds of rows, and those that say what accesses mean.
MEANING = frozenset("class decl export import member ref".split())
KINDS = MEANING | {"block", "file", "stmt"}


class Reader:
    """Rows of one file, of some kinds."""

    def __init__(self, path: str, text: str, min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS, kinds: frozenset[str] = KINDS):
        self.path, self.f = path, File(path, text)
        self.min_lines, self.min_tokens, self.kinds = min_lines, min_tokens, kinds
        self.rows: list[dict] = []
        self.busy: set[int] = set()
        self.uids: dict[int, str] = {}
        self.exported: set[tuple[str, str]] = set()
        root, top = Tree(self.f).root, Scope()
        self.put("file", start=0, n=self.f.t[0].at if self.f.t else len(text), end=len(text), depth=-1)
        self._top(root)
        self._visit_all(root, top, 0)

    def put(self, kind: str, value: Value | None = None, **more) -> None:
        if kind not in self.kinds:
            return
        if value is not None:
            more |= {"base": value.base, "of": value.of, "steps": list(value.steps)}
        self.rows.append({"kind": kind, "ord": len(self.rows), **more})

    def uid(self, c: Node) -> str:
        if id(c) not in self.uids:
            self.uids[id(c)] = f"{self.path}#{c.name or ''}@{self.f.line(c.a)}" + ("" if c.kind == "class" and c.name else f":{c.a}")
        return self.uids[id(c)]

    # -- names of the file --

    def _top(self, root: Node) -> None:
        """Declarations, imports and exports of the file's own scope."""
        top = Scope()
        for s in root.kids:
            named = [(v.name, v) for v in s.kids if v.name] if s.kind == "vars" else [(s.name, s)] if s.kind in ("class", "interface", "function", "alias", "enum") and s.name else []
            for v in s.kids if s.kind == "vars" else []:
                named += [(local, (v, key)) for key, local in v.extra or []]
            for name, node in named:
                value = self._declared(node, top)
                if value is not None:
                    self.put("decl", value, name=name)
            default = "default" in s.mods or any("default" in k.mods for k in s.kids)
            if default and s.kind == "export":
                value = self.describe(s.kids[0], top)
                if value is not None:
                    self.put("decl", value, name="default")
                    self.put("export", name="default", other="default")
            elif default:
                if not s.name and (value := self._declared(s, top)) is not None:
                    self.put("decl", value, name="default")
                self.put("export", name="default", other=s.name or "default")
            elif "export" in s.mods:
                for name, _ in named:
                    self.put("export", name=name, other=name)
            elif s.kind == "export" and s.extra:
                names, spec = s.extra
                if names == "*":
                    self.put("export", name=s.name or "*", spec=spec, other="*")
                else:
                    for there, here in names:
                        self.put("export", name=here, spec=spec, other=there)
            if s.kind == "import" and s.extra and s.extra[1]:
                for there, local in s.extra[0] or [(None, None)]:
                    self.put("import", name=local, spec=s.extra[1], other=there)

    def _declared(self, what: object, scope: Scope) -> Value | None:
        """What a declared name stands for."""
        if callable(what):
            return what()
        if isinstance(what, tuple):
            node, key = what
            whole = self._declared(node, scope)
            return whole.then("[]" if key is None else f".{key}") if whole else None
        node = what
        if id(node) in self.busy or len(self.busy) > NESTED:
            return None
        self.busy.add(id(node))
        try:
            if node.kind in ("class", "classexpr"):
                return Value("static", self.uid(node))
            if node.kind == "interface":
                return Value("static", self.uid(node))
            if node.kind == "alias":
                own = Scope(scope, generics=frozenset(node.extra or ()))
                value = self.typed(node.type, own)
                return value.then("wnew") if value else None
            if node.kind in FUNCTIONS:
                return self._called(node, scope)
            if node.type is not None:
                return self.typed(node.type, scope)
            return self.describe(node.body, scope) if node.body is not None else None
        finally:
            self.busy.discard(id(node))

    def typed(self, t: Type | None, scope: Scope) -> Value | None:
        if t is None or scope.generic(t.name):
            return None
        wraps = ["w" + w for w in t.wraps]
        if t.name == "this":
            s: Scope | None = scope
            while s is not None and s.this is None:
                s = s.up
            return s.this.then(*wraps) if s else None
        found = scope.find(t.name)
        if found:
            inner = self._declared(*found)
            return inner.then("new", *wraps) if inner else None
        first, *rest = t.name.split(".")
        return Value("name", first).then(*[f".{r}" for r in rest], "new", *wraps)

    def _called(self, node: Node, scope: Scope) -> Value | None:
        """A function as a value: its result, wrapped."""
        own = self._inside(node, scope)
        if node.type is not None:
            value = self.typed(node.type, own)
        elif node.body is None:
            return None
        elif node.body.kind != "body":
            value = self.describe(node.body, own)
        else:
            value = self._returned(node.body, own)
        if value is None:
            return None
        if node.type is None and "async" in node.mods and value.steps[-1:] != ("wawait",):
            value = value.then("wawait")
        return value.then("w()")

    def _returned(self, body: Node, scope: Scope) -> Value | None:
        found: list[Value | None] = []

        def visit(n: Node, s: Scope) -> None:
            for k in n.kids:
                if k.kind == "return":
                    found.append(self.describe(k.kids[0], s) if k.kids else None)
                elif k.kind not in FUNCTIONS and k.kind not in ("class", "classexpr"):
                    visit(k, self._block_scope(k, s))

        visit(body, self._block_scope(body, scope))
        return found[0] if found and all(v == found[0] for v in found) else None

    # -- scopes --

    def _inside(self, fn: Node, scope: Scope) -> Scope:
        """The scope of a function's parameters."""
        own = Scope(scope, generics=frozenset(fn.extra) if isinstance(fn.extra, tuple) else frozenset())
        if fn.kind in ("function", "fnexpr"):
            own.this = Value("none", "")
        for p in fn.kids:
            if p.kind == "param":
                if p.name == "this":
                    own.this = self.typed(p.type, own)
                elif p.name:
                    own.names[p.name] = p
                for key, local in p.extra or []:
                    own.names[local] = (p, key)
        return own

    def _block_scope(self, n: Node, scope: Scope) -> Scope:
        """The names that a node's own statements declare."""
        names: dict[str, object] = {}
        if n.kind == "catch" and n.name:
            names[n.name] = lambda: None
        for s in n.kids if n.kind in ("body", "block", "case", "for") else ():
            if s.kind == "vars":
                for v in s.kids:
                    if n.kind == "for" and n.extra and v.body is None and v.type is None and len(n.kids) > 1:
                        whole, item = n.kids[1], n.extra == "of"
                        maker = lambda whole=whole, item=item: (d.then("[]") if (d := self.describe(whole, scope)) and item else None)
                        if v.name:
                            names[v.name] = maker
                        for key, local in v.extra or []:
                            names[local] = lambda maker=maker, key=key: (d.then("[]" if key is None else f".{key}") if (d := maker()) else None)
                        continue
                    if v.name:
                        names[v.name] = v
                    for key, local in v.extra or []:
                        names[local] = (v, key)
            elif s.kind in ("function", "class", "interface", "alias", "enum") and s.name:
                names[s.name] = s
        return Scope(scope, names=names) if names else scope

    # -- values --

    def describe(self, e: Node | None, scope: Scope) -> Value | None:
        """The value of an expression: what it begins with, and its members, calls, items in a row."""
        steps: list[str] = []
        while e is not None and e.kids and len(steps) <= LONGEST:
            if e.kind == "call" and e.kids[0].kind == "id" and e.kids[0].name == "inject" and len(e.kids) > 1 and not scope.find("inject"):
                break
            step = f".{e.name}" if e.kind == "member" else CHAIN.get(e.kind)
            if step is None:
                break
            if step:
                steps.append(step)
            e = e.kids[0]
        if e is None or len(steps) > LONGEST:
            return None
        value = self._begin(e, scope)
        return value.then(*reversed(steps)) if value else None

    def _begin(self, e: Node, scope: Scope) -> Value | None:
        k = e.kind
        if k in ("this", "super"):
            s: Scope | None = scope
            while s is not None and s.this is None:
                s = s.up
            if s is None or s.this.base == "none":
                return None
            return s.this if k == "this" else s.this.then("^")
        if k == "id":
            found = scope.find(e.name)
            return self._declared(*found) if found else Value("name", e.name)
        if k == "call":  # inject(A), inject<A>(b)
            of = e.kids[0].type or (Type(e.kids[1].name) if e.kids[1].kind == "id" else None)
            return self.typed(of, scope)
        if k == "cast":
            return self.describe(e.kids[0], scope) if e.name == "satisfies" or e.type and e.type.name == "const" else self.typed(e.type, scope)
        if k == "comma":
            return self.describe(e.kids[-1], scope)
        if k == "assign" and e.name == "=":
            return self.describe(e.kids[1], scope)
        if k in ("cond", "binary") and len(e.kids) > 1:
            if k == "binary" and e.name == "&&":
                return self.describe(e.kids[-1], scope)
            if k == "cond" or e.name in ("??", "||"):
                all_ = [self.describe(x, scope) for x in (e.kids[1:] if k == "cond" else e.kids) if not (x.kind == "lit" and x.name in ("null", "undefined") or x.kind == "id" and x.name == "undefined")]
                return all_[0] if all_ and all(v == all_[0] for v in all_) else None
        if k in FUNCTIONS or k == "classexpr":
            return self._declared(e, scope)
        if k == "array" and e.kids:
            all_ = [self.describe(x, scope) for x in e.kids]
            return all_[0].then("w[]") if all_[0] and all(v == all_[0] for v in all_) else None
        return None

    # -- rows --

    def _visit_all(self, root: Node, top: Scope, depth: int) -> None:
        todo = [(root, top, depth)]
        while todo:
            n, scope, depth = todo.pop()
            here = self._block_scope(n, scope) if n is not root else scope
            if n.kind in STATEMENTS:
                if "stmt" in self.kinds:
                    t = self.f.t
                    last = min(n.b, len(t)) - 1
                    self.put("stmt", start=t[n.a - 1].end if n.a else 0, n=t[n.a].at, end=t[last].end, depth=depth)
                depth += 1
            if n.kind == "member":
                value = self.describe(n.kids[0], here)
                if value is not None:
                    line, col = self.f.place(n.extra)
                    self.put("ref", value, name=n.name, line=line, col=col)
            if n.kind in BLOCKS and n.body is not None and n.body.kind == "body" and "block" in self.kinds:
                self._block(n)
            inner = here
            if n.kind in ("class", "classexpr", "interface"):
                self._class(n, here)
            elif n.kind in FUNCTIONS:
                inner = self._inside(n, here)
            for k in reversed(n.kids):
                own = inner
                if n.kind == "class" or n.kind == "classexpr":
                    if k.kind in FUNCTIONS or k.kind == "field":
                        own = self._class_scope(n, k, here)
                if k.kind == "vars" and n.kind == "for":
                    todo += [(v, own, depth) for v in reversed(k.kids)]
                    continue
                if n.kind == "call" and k.kind in ("arrow", "fnexpr") and n.kids[0].kind == "member" and n.kids[0].name in ITEM_CALLS and k is not n.kids[0]:
                    own = Scope(own, names={})
                    todo.append((self._with_item(k, n.kids[0].kids[0], own), own, depth))
                    continue
                todo.append((k, own, depth))

    def _with_item(self, fn: Node, array: Node, scope: Scope) -> Node:
        """The first parameter of a callback without a type is an item of the array."""
        first = next((p for p in fn.kids if p.kind == "param"), None)
        value = self.describe(array, scope.up)
        if first is not None and first.type is None and value is not None:
            first.body, first.kind = None, "item"
            if first.name:
                scope.names[first.name] = lambda: value.then("[]")
            for key, local in first.extra or []:
                scope.names[local] = lambda key=key: value.then("[]", "[]" if key is None else f".{key}")
        return fn

    def _class_scope(self, c: Node, member: Node, scope: Scope) -> Scope:
        return Scope(scope, this=Value("static" if "static" in member.mods else "class", self.uid(c)), generics=frozenset(c.extra[0]) if c.extra else frozenset())

    def _class(self, c: Node, scope: Scope) -> None:
        uid = self.uid(c)
        indexed = c.kind == "class" and c.name is not None
        base = c.extra[1] if c.extra else None
        above = self.typed(base, scope)
        above = above.then("wnew") if above else None
        self.put("class", above, cls=uid, name=c.name, line=self.f.line(c.a), n=int(indexed))
        for m in c.kids:
            own = self._class_scope(c, m, scope)
            if m.kind == "ctor":
                for p in m.kids:
                    if p.kind == "param" and p.name and p.mods & ACCESS:
                        self.put("member", self._declared(p, own), cls=uid, name=p.name, static=False, other="field")
            elif m.kind in ("method", "get", "field") and m.name:
                method = m.kind == "method" and m.body is not None and indexed and not m.name.startswith("#")
                if m.kind == "field":
                    value = self._declared(m, own)
                else:
                    value = self._called(m, own)
                    value = value.then("()") if value and m.kind == "get" else value
                self.put("member", value, cls=uid, name=m.name, static="static" in m.mods, other="method" if method else m.kind, line=self.f.line(m.a))

    def _block(self, fn: Node) -> None:
        """Sizes and hashes of a function's block, if it is large enough."""
        a, b = fn.body.a, min(fn.body.b, len(self.f.t))
        first, last = self.f.line(a), self.f.line(b - 1)
        if last - first + 1 < self.min_lines:
            return
        tokens, exact, shape, _ = hashed(self.f.source(a, b))
        if tokens >= self.min_tokens:
            self.put("block", name=fn.kind, of=exact, other=shape, start=first, end=last, n=last - first + 1, n2=tokens, line=first)


def extract(files: DataFrame, min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS, kinds: frozenset[str] = KINDS) -> DataFrame:
    """The rows of every analyzable file, all or those of some kinds; a file is read once."""

    def run(batches):
        return rows_of(batches, lambda p, t: Reader(p, re.sub("^\ufeff", "", t), min_lines, min_tokens, kinds).rows, _ARROW)

    return files.where(analyzable(F.col("file_path")) & F.col("text").isNotNull()).select("file_path", "text").mapInArrow(run, SCHEMA)
