"""The syntax tree of a file, by recursive descent over its tokens: statements, functions, classes, expressions and types.

The tree is as deep as facts need: runs of binary operators are flat, types become names (`Type`), and what doesn't parse is
passed over token by token, so that every text gives a tree.  Brackets that nest deeper than DEEPEST are one opaque node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from corvane.sources.typescript import MODIFIERS, File

DEEPEST = 60
#: Words and operators of the language.
JUMPS = frozenset("break continue debugger".split())
UNARY = frozenset("! ~ + - ++ -- typeof void delete await".split())
BINARY = frozenset("+ - * / % ** & | ^ && || ?? < > <= >= == != === !== << >> in instanceof".split())
ASSIGN = frozenset("= += -= *= /= %= **= &= |= ^= &&= ||= ??= <<= >>= >>>=".split())
AFTER_TYPE_ARGUMENTS = frozenset("( ) ] } : ; , . ?. = == === != !== && || ?? ?".split()) | {""}
FUNCTIONS = frozenset("function fnexpr arrow method ctor get set".split())
STATEMENTS = frozenset("block vars function class interface alias enum module if for while do switch try return throw jump labeled import export expr empty".split())


@dataclass(slots=True)
class Type:
    """A class's name with what is around it, innermost first: [] for arrays, await for promises, () for functions."""

    name: str
    wraps: tuple[str, ...] = ()


@dataclass(slots=True)
class Node:
    kind: str
    a: int  # first token
    b: int = 0  # last token + 1
    kids: list[Node] = field(default_factory=list)
    name: str | None = None
    type: Type | None = None
    body: Node | None = None
    mods: frozenset[str] = frozenset()
    extra: object = None

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += reversed(n.kids)


class Tree:
    def __init__(self, file: File):
        self.f, self.i, self.n, self.deep = file, 0, len(file.t), 0
        self.root = Node("file", 0)
        self._statements(self.root, self.n)
        self.root.b = self.n

    # -- tokens --

    def x(self, k: int = 0) -> str:
        return self.f.t[self.i + k].text if 0 <= self.i + k < self.n else ""

    def kind(self, k: int = 0) -> str:
        return self.f.t[self.i + k].kind if 0 <= self.i + k < self.n else ""

    def close(self, i: int) -> int:
        """The partner of a bracket, the end of the file where it has none."""
        return self.f.pair.get(i, self.n)

    def eat(self, text: str) -> bool:
        if self.x() == text and self.kind() != "str":
            self.i += 1
            return True
        return False

    def fresh(self, k: int = 0) -> bool:
        """Whether a line break is before the token."""
        i = self.i + k
        return 0 < i < self.n and "\n" in self.f.text[self.f.t[i - 1].end : self.f.t[i].at]

    def done(self, node: Node, *kids: Node | None) -> Node:
        node.kids += [k for k in kids if k is not None]
        node.b = max(self.i, node.a + 1)
        return node

    # -- statements --

    def _statements(self, node: Node, end: int) -> None:
        while self.i < end:
            was = self.i
            s = self.statement()
            if s is not None:
                node.kids.append(s)
            if self.i <= was:
                self.i = was + 1
        self.i = max(self.i, end) if end < self.n else self.n

    def block(self) -> Node:
        """{ statements }"""
        node, end = Node("block", self.i), self.close(self.i)
        self.i += 1
        if self.deep > DEEPEST:
            self.i = end
        else:
            self.deep += 1
            self._statements(node, end)
            self.deep -= 1
        self.i = min(end + 1, self.n)
        return self.done(node)

    def statement(self) -> Node | None:
        w, node = self.x(), Node("expr", self.i)
        if self.kind() in ("str", "tpl", "num", "re"):
            return self._expression(node)
        if w == "{":
            return self.block()
        if w == ";":
            node.kind = "empty"
            self.i += 1
            return self.done(node)
        if w in (")", "]", "}"):
            self.i += 1
            return None
        named = self.kind(1) == "id" and not self.fresh(1)
        if w == "@" or w in ("class", "export") or w == "abstract" and self.x(1) == "class":
            return self._declared(node)
        if w in ("const", "let", "var") and (named or self.x(1) in ("{", "[")) and self.x(1) != "enum":
            return self._vars(node)
        if w == "function" or w == "async" and self.x(1) == "function":
            return self._function(node, "function")
        if w == "const" and self.x(1) == "enum" or w == "enum" and named:
            self.i += 1 + (w == "const")
            node.kind, node.name = "enum", self.x()
            return self._past(node)
        if w == "interface" and named:
            return self._class(node, "interface")
        if w == "type" and named:
            return self._alias(node)
        if w in ("namespace", "module") and (named or self.kind(1) == "str" and self.x(2) == "{") or w == "global" and self.x(1) == "{":
            node.kind = "module"
            self.i += 1
            while self.i < self.n and self.x() != "{":
                self.i += 1
            return self.done(node, self._part())
        if w == "declare" and named:
            self.i += 1
            inner = self.statement()
            node.kind = inner.kind if inner else "empty"
            return self.done(node, inner)
        if w == "import" and self.x(1) not in ("(", "."):
            return self._import(node)
        if w in ("if", "while", "with") and self.x(1) == "(":
            node.kind = "if" if w == "if" else "while"
            self.i += 1
            self.done(node, self._paren(), self.statement())
            return self.done(node, self.statement() if w == "if" and self.eat("else") else None)
        if w == "for" and self.x(1) in ("(", "await"):
            return self._for(node)
        if w == "do":
            node.kind = "do"
            self.i += 1
            self.done(node, self.statement())
            if self.eat("while") and self.x() == "(":
                self.done(node, self._paren())
            self.eat(";")
            return self.done(node)
        if w == "switch" and self.x(1) == "(":
            return self._switch(node)
        if w == "try" and self.x(1) == "{":
            return self._try(node)
        if w in ("return", "throw"):
            node.kind = w
            self.i += 1
            if self.i < self.n and self.x() not in (";", "}") and not self.fresh():
                self.done(node, self.expression())
            self.eat(";")
            return self.done(node)
        if w in JUMPS:
            node.kind = "jump"
            self.i += 1
            if self.kind() == "id" and not self.fresh():
                self.i += 1
            self.eat(";")
            return self.done(node)
        if self.kind() == "id" and self.x(1) == ":":
            node.kind = "labeled"
            self.i += 2
            return self.done(node, self.statement())
        return self._expression(node)

    def _expression(self, node: Node) -> Node:
        self.done(node, self.expression())
        self.eat(";")
        return self.done(node)

    def _past(self, node: Node) -> Node:
        """Up to the end of the next braces."""
        while self.i < self.n and self.x() not in ("{", ";"):
            self.i += 1
        self.i = min(self.close(self.i) + 1, self.n) if self.x() == "{" else self.i + 1
        return self.done(node)

    def _declared(self, node: Node) -> Node:
        """A class with its decorators, or what is exported."""
        decorators = []
        while self.x() == "@":
            self.i += 1
            decorators.append(self.unary())
        if not self.eat("export"):
            return self._class(node, "class", decorators)
        node.kind = "export"
        if self.eat("default"):
            while self.x() == "@":
                self.i += 1
                decorators.append(self.unary())
            if self.x() == "class" or self.x() == "abstract" and self.x(1) == "class":
                inner = self._class(Node("class", node.a), "class", decorators)
            elif self.x() == "function" or self.x() == "async" and self.x(1) == "function":
                inner = self._function(Node("function", node.a), "function")
            elif self.x() == "interface":
                inner = self._class(Node("interface", node.a), "interface")
            else:
                inner = self.expression()
                self.eat(";")
            inner.mods |= {"default"}
            return self.done(inner) if inner.kind in STATEMENTS else self.done(node, inner)
        typed = self.x() == "type" and self.x(1) in ("{", "*")
        if typed:
            self.i += 1
        if self.x() == "*":
            self.i += 1
            node.name = None
            if self.eat("as"):
                node.name = self.x()
                self.i += 1
            if self.eat("from"):
                node.extra = ("*", self.f.literal(self.i))
                self.i += 1
            self.eat(";")
            return self.done(node)
        if self.x() == "{":
            names = self._names()
            spec = None
            if self.eat("from"):
                spec = self.f.literal(self.i)
                self.i += 1
            node.extra = (names, spec)
            self.eat(";")
            return self.done(node)
        if self.eat("="):
            return self._expression(node)
        inner = self._class(Node("class", node.a), "class", decorators) if decorators else self.statement()
        if inner is None:
            return self.done(node)
        inner.a, inner.mods = node.a, inner.mods | {"export"}
        return inner

    def _names(self) -> list[tuple[str, str]]:
        """(there, here) of { a, b as c }"""
        out, end = [], self.close(self.i)
        for p, q in self.f.args(self.i):
            p += self.f.x(p) == "type" and q - p > 1 and self.f.x(p + 1) != "as"
            out.append((self.f.x(p), self.f.x(q - 1)))
        self.i = min(end + 1, self.n)
        return out

    def _import(self, node: Node) -> Node:
        """extra: ([(imported, local)], module)"""
        node.kind, names = "import", []
        self.i += 1
        if self.x() == "type" and self.x(1) not in ("from", ",", "="):
            self.i += 1
        while self.i < self.n and self.kind() != "str" and self.x() not in (";", "="):
            if self.x() == "{":
                names += self._names()
            elif self.x() == "*" and self.x(1) == "as":
                names.append(("*", self.x(2)))
                self.i += 3
            else:
                if self.kind() == "id" and self.x() != "from":
                    names.append(("default", self.x()))
                self.i += 1
        node.extra = (names, self.f.literal(self.i) if self.kind() == "str" else None)
        while self.i < self.n and self.x() != ";" and (self.kind() == "str" or not self.fresh()):
            self.i += 1
        self.eat(";")
        return self.done(node)

    def _vars(self, node: Node) -> Node:
        node.kind = "vars"
        self.i += 1
        while self.i < self.n:
            one = Node("var", self.i)
            self._binding(one)
            self.eat("!")
            if self.eat(":"):
                one.type = self.type()
            if self.eat("="):
                one.body = self.assign()
            node.kids.append(self.done(one, one.body))
            if self.x() in ("in", "of") or not self.eat(","):
                break
        if self.x() not in ("in", "of"):
            self.eat(";")
        return self.done(node)

    def _binding(self, node: Node) -> None:
        """A name, or a pattern: extra has (property or None for an item, name)."""
        if self.x() in ("{", "["):
            found, whole = [], self.x() == "{"
            for p, q in self.f.args(self.i):
                p += self.f.x(p) == "..."
                at = next((k for k in range(p, q) if self.f.inside[k] == self.i and self.f.x(k) in (":", "=")), q)
                key = self.f.x(p) if whole else None
                local = self.f.x(at + 1) if at < q and self.f.x(at) == ":" else self.f.x(p)
                if local.isidentifier():
                    found.append((key, local))
            node.extra = found
            self.i = min(self.close(self.i) + 1, self.n)
        else:
            node.name = self.x()
            self.i += 1

    def _for(self, node: Node) -> Node:
        node.kind = "for"
        self.i += 1
        self.eat("await")
        end = self.close(self.i)
        self.i += 1
        if self.x() in ("const", "let", "var"):
            first = self._vars(Node("vars", self.i))
        else:
            first = self.expression(no_in=True) if self.x() != ";" else None
            self.eat(";")
        self.done(node, first)
        if self.x() in ("of", "in"):
            node.extra = self.x()
            self.i += 1
        while self.i < end:
            was = self.i
            self.done(node, self.expression() if self.x() != ";" else None)
            self.eat(";")
            self.i = max(self.i, was + 1)
        self.i = min(end + 1, self.n)
        return self.done(node, self.statement())

    def _switch(self, node: Node) -> Node:
        node.kind = "switch"
        self.i += 1
        self.done(node, self._paren())
        if self.x() != "{":
            return self.done(node)
        end = self.close(self.i)
        self.i += 1
        while self.i < end:
            case = Node("case", self.i)
            if self.eat("default"):
                self.eat(":")
            elif self.eat("case"):
                self.done(case, self.expression())
                self.eat(":")
            else:
                self.i += 1
                continue
            while self.i < end and not (self.x() == "case" or self.x() == "default" and self.x(1) == ":"):
                was, s = self.i, self.statement()
                self.done(case, s)
                self.i = max(self.i, was + 1)
            node.kids.append(self.done(case))
        self.i = min(end + 1, self.n)
        return self.done(node)

    def _try(self, node: Node) -> Node:
        node.kind = "try"
        self.i += 1
        parts = [self._part()]
        if self.eat("catch"):
            catch = Node("catch", self.i - 1)
            if self.x() == "(":
                end = self.close(self.i)
                self.i += 1
                self._binding(catch)
                self.i = min(end + 1, self.n)
            parts.append(self.done(catch, self._part()))
        if self.eat("finally"):
            parts.append(self._part())
        return self.done(node, *parts)

    def _part(self) -> Node | None:
        """A block that is no statement of its own (of a function, module, try or catch)."""
        if self.x() != "{":
            return None
        b = self.block()
        b.kind = "body"
        return b

    def _alias(self, node: Node) -> Node:
        node.kind, node.name = "alias", self.x(1)
        self.i += 2
        node.extra = self._type_parameters()
        if self.eat("="):
            node.type = self.type()
        self.eat(";")
        return self.done(node)

    # -- functions and classes --

    def _function(self, node: Node, kind: str) -> Node:
        node.kind = kind
        if self.eat("async"):
            node.mods |= {"async"}
        self.eat("function")
        self.eat("*")
        if self.kind() == "id" and self.x() != "(":
            node.name = self.x()
            self.i += 1
        return self._callable(node)

    def _callable(self, node: Node) -> Node:
        """Type parameters, parameters, return type and body."""
        node.extra = self._type_parameters()
        if self.x() == "(":
            self._parameters(node)
        if self.eat(":"):
            node.type = self.type()
        if self.x() == "{":
            node.body = self._part()
        elif node.kind != "arrow":
            self.eat(";")
        return self.done(node, node.body)

    def _parameters(self, node: Node) -> None:
        open_ = self.i
        end = self.close(open_)
        self.i += 1
        while self.i < end:
            p = Node("param", self.i)
            mods = set()
            while True:
                if self.x() == "@":
                    self.i += 1
                    self.done(p, self.unary())
                elif self.x() in MODIFIERS and self.kind(1) == "id" or self.x() in MODIFIERS and self.x(1) in ("{", "["):
                    mods.add(self.x())
                    self.i += 1
                else:
                    break
            self.eat("...")
            self._binding(p)
            self.eat("?")
            if self.eat(":"):
                p.type = self.type()
            if self.eat("="):
                p.body = self.assign()
            p.mods = frozenset(mods)
            node.kids.append(self.done(p, p.body))
            while self.i < end and self.x() != ",":
                self.i = self.close(self.i) + 1 if self.x() in ("(", "[", "{") else self.i + 1
            self.eat(",")
        self.i = min(end + 1, self.n)

    def _class(self, node: Node, kind: str, decorators: list[Node] | None = None) -> Node:
        """A class or an interface; extra has its type parameters and what it extends."""
        node.kind = kind
        mods = set()
        while self.x() in MODIFIERS and self.x() != "":
            mods.add(self.x())
            self.i += 1
        node.mods |= mods
        if self.x() not in ("class", "interface"):  # decorators of something else
            return self._expression(Node("expr", node.a, kids=decorators or [])) if self.i < self.n else self.done(node, *(decorators or []))
        self.i += 1
        if self.kind() == "id" and self.x() not in ("extends", "implements"):
            node.name = self.x()
            self.i += 1
        generics, base = self._type_parameters(), None
        self.done(node, *(decorators or []))
        if self.eat("extends"):
            if kind == "interface":
                base = self.type()
            else:
                e = self.unary()
                self.done(node, e)
                base = Type(e.name) if e.kind == "id" else Type(f"{e.kids[0].name}.{e.name}") if e.kind == "member" and e.kids[0].kind == "id" else None
        while self.i < self.n and self.x() != "{":
            self.i = self.close(self.i) + 1 if self.x() in ("(", "[") else self.i + 1
        node.extra = (generics, base)
        end = self.close(self.i)
        self.i += 1
        if self.deep > DEEPEST:
            self.i = end
        self.deep += 1
        while self.i < end:
            was = self.i
            if self.x() not in (";", ","):
                node.kids.append(self._member(end))
            self.i = max(self.i, was + 1)
        self.deep -= 1
        self.i = min(end + 1, self.n)
        return self.done(node)

    def _member(self, end: int) -> Node:
        m, mods = Node("field", self.i), set()
        while self.i < end:
            if self.x() == "@":
                self.i += 1
                self.done(m, self.unary())
            elif self.x() in MODIFIERS and self.x(1) not in ("(", "=", ":", ";", "?", "!", "<", "}", ","):
                mods.add(self.x())
                self.i += 1
            else:
                break
        if self.x() == "{":
            return self.done(m, self._part())
        self.eat("*")
        if self.x() in ("get", "set") and self.x(1) not in ("(", "=", ":", ";", "?", "!", "<", "}", ","):
            m.kind = self.x()
            self.i += 1
        m.mods = frozenset(mods)
        self._key(m)
        if self.x() in ("?", "!"):
            self.i += 1
        if self.x() in ("(", "<"):
            m.kind = "ctor" if m.name == "constructor" and m.kind == "field" else "method" if m.kind == "field" else m.kind
            return self._callable(m)
        if self.eat(":"):
            m.type = self.type()
        if self.eat("="):
            m.body = self.assign()
        self.done(m, m.body)
        self.eat(";")
        return m

    def _key(self, m: Node) -> None:
        """The name of a member; None if it is no identifier."""
        if self.x() in ("(", "<"):
            return
        if self.x() == "[":
            end = self.close(self.i)
            self.i += 1
            self.done(m, self.expression() if self.i < end else None)
            self.i = min(end + 1, self.n)
            return
        m.name = self.x() if self.kind() == "id" else None
        self.i += 1

    # -- expressions --

    def expression(self, no_in: bool = False) -> Node:
        first = self.assign(no_in)
        if self.x() != ",":
            return first
        node = Node("comma", first.a, kids=[first])
        while self.eat(","):
            node.kids.append(self.assign(no_in))
        return self.done(node)

    def _paren(self) -> Node:
        node, end = Node("paren", self.i), self.close(self.i)
        self.i += 1
        if self.deep > DEEPEST:
            self.i = end
        elif self.i < end:
            self.deep += 1
            self.done(node, self.expression())
            self.deep -= 1
        self.i = min(end + 1, self.n)
        return self.done(node)

    def _arrow(self, branch: bool) -> Node | None:
        """An arrow function, if one begins here; in the first branch of a ?: one with a return type needs a : after it."""
        start, was = self.i, self.i
        node = Node("arrow", start)
        if self.x() == "async" and not self.fresh(1) and (self.kind(1) == "id" or self.x(1) in ("(", "<")):
            node.mods = frozenset({"async"})
            self.i += 1
        if self.kind() == "id" and self.x(1) == "=>":
            node.kids.append(Node("param", self.i, self.i + 1, name=self.x()))
            self.i += 1
        else:
            if self.x() == "<":
                node.extra = self._type_parameters()
            if self.x() != "(" or self.i not in self.f.pair:
                self.i = was
                return None
            end = self.close(self.i)
            after = self.f.t[end + 1].text if end + 1 < self.n else ""
            if after not in ("=>", ":"):
                self.i = was
                return None
            if after == ":":
                inner = self.i
                plain = end == inner + 1 or self.f.t[inner + 1].kind == "id" and (end == inner + 2 or self.f.x(inner + 2) in (":", ",", "?", "=")) or self.f.x(inner + 1) in ("{", "[", "...", "@")
                self.i = end + 2
                back = self.type() if plain else None
                if self.x() != "=>" or self.i == end + 2:
                    self.i = was
                    return None
                node.type, self.i, node.b = back, inner, -1
            self._parameters(node)
            if self.eat(":"):
                self.type()
        if not self.eat("=>"):
            self.i = was
            return None
        if self.x() == "{":
            node.body = self._part()
        else:
            node.body = self.assign()
        if branch and node.b and self.x() != ":":
            self.i = was
            return None
        return self.done(node, node.body)

    def _operator(self) -> str:
        """An operator of one token, or of several tokens > and = that touch."""
        out, k = self.x(), 1
        if out == ">":
            while self.x(k) in (">", "=", "==", "===") and self.f.t[self.i + k].at == self.f.t[self.i + k - 1].end and len(out) < 4:
                out += self.x(k)
                k += 1
        self.width = k
        return out

    def assign(self, no_in: bool = False, branch: bool = False) -> Node:
        start = self.i
        if self.deep > DEEPEST + 40:
            self.i += 1
            return self.done(Node("lit", start))
        self.deep += 1
        try:
            if self.kind() == "id" or self.x() in ("(", "<"):
                arrow = self._arrow(branch)
                if arrow:
                    return arrow
            if self.x() == "yield" and self.x(1) not in (")", "]", ",", ";", "=", "."):
                node = Node("unary", self.i, name="yield")
                self.i += 1
                self.eat("*")
                return self.done(node, self.assign(no_in) if self.x() not in ("}", "") and not self.fresh() else None)
            left = self._binary(no_in)
            if self.x() == "?":
                node = Node("cond", left.a, kids=[left])
                self.i += 1
                self.done(node, self.assign(branch=True))
                if self.eat(":"):
                    self.done(node, self.assign(no_in))
                return self.done(node)
            op = self._operator()
            if op in ASSIGN and self.kind() == "op":
                self.i += self.width
                return self.done(Node("assign", left.a, name=op), left, self.assign(no_in))
            return left
        finally:
            self.deep -= 1

    def _binary(self, no_in: bool) -> Node:
        left, node = self.unary(), None
        while self.i < self.n and self.kind() in ("op", "id"):
            op = self._operator()
            if op in ("as", "satisfies") and self.kind() == "id" and not self.fresh():
                self.i += 1
                cast = Node("cast", left.a if node is None else node.a, name=op)
                cast.type = self.type()
                left = self.done(cast, left if node is None else node)
                node = None
                continue
            if op not in BINARY or no_in and op == "in":
                break
            self.i += self.width
            if node is None:
                node = Node("binary", left.a, name=op, kids=[left])
            elif node.name != op:
                node.name = "mixed"
            self.done(node, self.unary())
        return node or left

    def unary(self) -> Node:
        start, w = self.i, self.x()
        if (w in UNARY and self.kind() in ("op", "id")) and not (w == "await" and self.x(1) in (".", ")", ",", ";", "=", ":")):
            node = Node("await" if w == "await" else "unary", start, name=w)
            self.i += 1
            if self.deep > DEEPEST + 40:
                return self.done(node)
            self.deep += 1
            self.done(node, self.unary())
            self.deep -= 1
            return node
        if w == "<":  # <T>value
            node = Node("cast", start)
            self.i += 1
            node.type = self.type()
            if self.eat(">"):
                return self.done(node, self.unary())
            self.i = start + 1
            return self.done(Node("lit", start))
        return self._postfix(self._primary())

    def _postfix(self, e: Node) -> Node:
        while self.i < self.n:
            w = self.x()
            if self.kind() == "tpl" and self.x().startswith("`"):
                e = self.done(Node("tagged", e.a, kids=[e]), self._template())
                continue
            if self.kind() != "op":
                break
            if w in (".", "?."):
                if self.kind(1) == "id":
                    m = Node("member", e.a, kids=[e], name=self.x(1), extra=self.i + 1)
                    self.i += 2
                    e = self.done(m)
                    continue
                if w == "?." and self.x(1) in ("(", "["):
                    self.i += 1
                    continue
                self.i += 1
                break
            if w == "(":
                e = self.done(Node("call", e.a, kids=[e]), *self._arguments())
            elif w == "[":
                end = self.close(self.i)
                self.i += 1
                inner = self.expression() if self.i < end else None
                self.i = min(end + 1, self.n)
                e = self.done(Node("index", e.a, kids=[e]), inner)
            elif w == "!" and not self.fresh() and self.x(1) not in ("=", "=="):
                self.i += 1
                e = self.done(Node("nonnull", e.a, kids=[e]))
            elif w in ("++", "--") and not self.fresh():
                self.i += 1
                e = self.done(Node("unary", e.a, kids=[e], name=w))
            elif w == "<" and e.kind in ("id", "member", "new", "call"):
                was = self.i
                args = self._type_arguments()
                if args is None or self.x() not in AFTER_TYPE_ARGUMENTS and self.kind() != "tpl":
                    self.i = was
                    break
                e.type = args[0] if args else None
            else:
                break
        return e

    def _arguments(self) -> list[Node]:
        out, end = [], self.close(self.i)
        self.i += 1
        if self.deep > DEEPEST:
            self.i = end
        self.deep += 1
        while self.i < end:
            was = self.i
            self.eat("...")
            out.append(self.assign())
            self.eat(",")
            self.i = max(self.i, was + 1)
        self.deep -= 1
        self.i = min(end + 1, self.n)
        return out

    def _template(self) -> Node:
        node = Node("template", self.i)
        self.i += 1
        while self.x() == "${":
            end = self.close(self.i)
            self.i += 1
            if self.i < end:
                self.done(node, self.expression())
            self.i = min(end + 1, self.n)
            if self.kind() == "tpl":
                self.i += 1
        return self.done(node)

    def _primary(self) -> Node:
        w, kind, start = self.x(), self.kind(), self.i
        if kind == "tpl":
            return self._template()
        if kind in ("str", "num", "re") or self.i >= self.n:
            self.i += 1
            return self.done(Node("lit", start))
        if w == "(":
            return self._paren()
        if w == "[":
            return self.done(Node("array", start), *self._arguments())
        if w == "{":
            return self._object()
        if w == "function" or w == "async" and self.x(1) == "function" and not self.fresh(1):
            return self._function(Node("fnexpr", start), "fnexpr")
        if w == "class" or w == "@":
            decorators = []
            while self.x() == "@":
                self.i += 1
                decorators.append(self.unary())
            return self._class(Node("classexpr", start), "classexpr", decorators)
        if w == "new":
            self.i += 1
            if self.x() == ".":
                self.i += 2
                return self.done(Node("lit", start))
            callee = self._primary()
            while self.x() == "." and self.kind(1) == "id":
                callee = Node("member", callee.a, self.i + 2, [callee], self.x(1), extra=self.i + 1)
                self.i += 2
            node = Node("new", start, kids=[callee])
            if self.x() == "<":
                self._type_arguments()
            return self.done(node, *(self._arguments() if self.x() == "(" else []))
        if kind == "id":
            self.i += 1
            return self.done(Node(w if w in ("this", "super") else "lit" if w in ("null", "true", "false") else "id", start, name=w))
        if w in (")", "]", "}", ";", ","):  # nothing here
            return Node("lit", start, start)
        self.i += 1
        return self.done(Node("lit", start))

    def _object(self) -> Node:
        node, end = Node("object", self.i), self.close(self.i)
        self.i += 1
        if self.deep > DEEPEST:
            self.i = end
        self.deep += 1
        while self.i < end:
            was, p = self.i, Node("prop", self.i)
            if self.eat("..."):
                self.done(p, self.assign())
            else:
                while self.x() in ("async", "get", "set", "*") and self.x(1) not in ("(", ":", ",", "}", "="):
                    p.kind = self.x() if self.x() in ("get", "set") else p.kind
                    self.i += 1
                self._key(p)
                if self.x() in ("(", "<"):
                    p.kind = "method" if p.kind == "prop" else p.kind
                    self._callable(p)
                elif self.eat(":"):
                    p.body = self.assign()
                    self.done(p, p.body)
                elif self.eat("="):
                    self.done(p, self.assign())
            node.kids.append(self.done(p))
            self.eat(",")
            self.i = max(self.i, was + 1)
        self.deep -= 1
        self.i = min(end + 1, self.n)
        return self.done(node)

    # -- types --

    def _type_parameters(self) -> tuple[str, ...]:
        """The names of <T extends A = B, U>, if they begin here."""
        if self.x() != "<":
            return ()
        names, was = [], self.i
        self.i += 1
        while self.i < self.n and self.x() not in (">", ";", "{"):
            while self.x() in ("const", "in", "out") and self.kind(1) == "id":
                self.i += 1
            names.append(self.x())
            self.i += 1
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(","):
                break
        if not self.eat(">"):
            self.i = was + 1
        return tuple(names)

    def _type_arguments(self) -> list[Type | None] | None:
        out = []
        self.i += 1
        while self.i < self.n:
            was = self.i
            out.append(self.type())
            if self.i == was:
                return None
            if self.eat(">"):
                return out
            if not self.eat(","):
                return None
        return None

    def type(self) -> Type | None:
        """A type; None for what names no single class."""
        if self.deep > DEEPEST + 40:
            return None
        self.deep += 1
        try:
            left = self._union()
            if self.x() == "extends" and not self.fresh():  # A extends B ? C : D
                self.i += 1
                self._union()
                if self.eat("?"):
                    self.type()
                    if self.eat(":"):
                        self.type()
                return None
            return left
        finally:
            self.deep -= 1

    def _union(self) -> Type | None:
        found, mixed = [], False
        while True:
            while self.x() in ("|", "&"):
                mixed |= self.x() == "&"
                self.i += 1
            t = self._postfix_type()
            if t is None or t.name not in ("null", "undefined"):
                found.append(t)
            if self.x() not in ("|", "&"):
                break
        same = found and all(t == found[0] for t in found)
        return found[0] if same and not (mixed and len(found) > 1) else None

    def _postfix_type(self) -> Type | None:
        t = self._plain_type()
        while self.x() == "[" and not self.fresh():
            if self.x(1) == "]":
                t = Type(t.name, (*t.wraps, "[]")) if t else None
            else:
                t = None
            self.i = min(self.close(self.i) + 1, self.n)
        return t

    def _plain_type(self) -> Type | None:
        w = self.x()
        if w in ("keyof", "infer", "unique", "asserts") and self.kind(1) == "id":
            self.i += 1
            self._postfix_type()
            if self.eat("is"):
                self.type()
            return None
        if w == "readonly" and (self.kind(1) == "id" or self.x(1) in ("[", "(")):
            self.i += 1
            return self._postfix_type()
        if w in ("new", "abstract") and self.x(1) in ("(", "<", "new"):
            self.i += 1
            self._plain_type()
            return None
        if w in ("(", "<"):
            if w == "<":
                self._type_parameters()
            end = self.close(self.i)
            if self.x() == "(" and end + 1 < self.n and self.f.t[end + 1].text == "=>":
                self.i = end + 2
                t = self.type()
                return Type(t.name, (*t.wraps, "()")) if t else None
            self.i += 1
            t = self.type()
            self.i = min(end + 1, self.n)
            return t
        if w in ("{", "["):
            self.i = min(self.close(self.i) + 1, self.n)
            return None
        if self.kind() == "tpl":
            self._template()
            return None
        if self.kind() in ("str", "num") or w == "-":
            self.i += 1 + (w == "-")
            return None
        if self.kind() != "id":
            return None
        if w == "typeof" or w == "import":
            self.i += 1
            while self.i < self.n and (self.kind() == "id" and self.f.x(self.i - 1) in (".", "typeof") or self.x() in (".", "import", "(")):
                self.i = self.close(self.i) + 1 if self.x() == "(" else self.i + 1
            if self.x() == "<":
                self._type_arguments()
            return None
        name = w
        self.i += 1
        if self.x() == "is" and not self.fresh():
            self.i += 1
            self.type()
            return None
        while self.x() == "." and self.kind(1) == "id":
            name += "." + self.x(1)
            self.i += 2
        args = None
        if self.x() == "<":
            was = self.i
            args = self._type_arguments()
            if args is None:
                self.i = was
        if args and name in ("Array", "ReadonlyArray", "Promise", "PromiseLike", "Readonly", "Required", "NonNullable"):
            t = args[0]
            wrap = {"Array": ("[]",), "ReadonlyArray": ("[]",), "Promise": ("await",), "PromiseLike": ("await",)}.get(name, ())
            return Type(t.name, (*t.wraps, *wrap)) if t else None
        return Type(name)
