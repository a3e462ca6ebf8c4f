"""A tolerant reader of TypeScript: tokens with matched brackets, and facts about one file.

There is no syntax tree.  Facts come from token patterns within matched brackets, which is enough for declarations, calls
and their receivers; what needs types (which class a variable has) is left out.  Comments never yield facts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Container
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from corvane.functions.scalars import fnv1a_py

TOKEN = re.compile(
    r"""(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*+(?:(?P<num>0[xXbBoO][0-9a-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)|(?P<id>[#]?[A-Za-z_$\u0080-\U0010FFFF][\w$\u0080-\U0010FFFF]*)"""
    r"""|(?P<str>'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?)|(?P<op>\.\.\.|=>|===|!==|==|!=|<=|\?\?=|\?\?|\?\.(?!\d)|&&=|\|\|=|&&|\|\||\*\*=|\*\*|\+\+|--|<<=|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|.))""",
    re.S,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => == === != !== && || ?? return typeof case in of do else void delete throw new instanceof += -=".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}
#: Modifiers of class members, names of the concern signals, HTTP methods, long-lived observables.
MODIFIERS = frozenset("public private protected static readonly abstract override async declare accessor export default".split())
MODULE_SIGNALS = {"@angular/common/http": "http", "@angular/router": "routing", "@ngrx/store": "state"}
NAME_SIGNALS = {
    "HttpClient": "http", "Router": "routing", "ActivatedRoute": "routing", "localStorage": "storage", "sessionStorage": "storage", "indexedDB": "storage", "MatDialog": "ui", "MatSnackBar": "ui", "ToastrService": "ui",
    "BehaviorSubject": "state", "ReplaySubject": "state", "Subject": "state", "signal": "state", "computed": "state", "effect": "state", "Store": "state",
}
HTTP_METHODS = frozenset("get post put patch delete request".split())
LONG_LIVED = frozenset("events valueChanges statusChanges params queryParams paramMap queryParamMap".split())
ARTIFACTS = {"Component": "component", "Directive": "directive", "Pipe": "pipe", "Injectable": "injectable"}
KEYWORDS = frozenset("if for while do switch catch function return class new typeof await async of in else case default try finally throw const let var".split())
MIN_LINES, MIN_TOKENS = 10, 80


@dataclass(slots=True)
class Tok:
    kind: str  # id num str tpl re op
    text: str
    at: int
    end: int


def scan(text: str, templates: bool = True) -> list[Tok]:
    """The tokens of a text.  A template is a piece up to ${ (kind tpl, then an op ${) and pieces after each }."""
    out: list[Tok] = []
    stack: list[str] = []
    i, n = 0, len(text)

    def template(start: int, i: int) -> int:
        while i < n:
            c = text[i]
            if c == "\\":
                i += 2
            elif c == "`":
                out.append(Tok("tpl", text[start : i + 1], start, i + 1))
                return i + 1
            elif text.startswith("${", i):
                out.append(Tok("tpl", text[start:i], start, i))
                out.append(Tok("op", "${", i, i + 2))
                stack.append("${")
                return i + 2
            else:
                i += 1
        out.append(Tok("tpl", text[start:], start, n))
        return n

    token, put = TOKEN.match, out.append
    while m := token(text, i):  # none where only space and comments are left
        kind = m.lastgroup
        at, i = m.span(kind)
        word = text[at:i]
        if kind == "op":
            if word == "`":
                i = template(at, i)
                continue
            if word[0] == "/" and (not out or out[-1].text in BEFORE_REGEX or out[-1].text == "${") and (m := REGEX.match(text, at)):
                i = m.end()
                put(Tok("re", text[at:i], at, i))
                continue
        put(Tok(kind, word, at, i))
        if word == "{":
            stack.append("{")
        elif word == "}" and stack and stack.pop() == "${":
            i = template(i, i)
    return out


def raw_tokens(text: str) -> list[str]:
    """Token shapes of a block: names, strings, numbers and regular expressions fold to marks, the rest stays."""
    marks = {"str": "<str>", "tpl": "<str>", "num": "<num>", "re": "<re>"}
    out = []
    for t in scan(text):
        if t.kind == "id":
            out.append(t.text if t.text in RESERVED else "<id>")
        elif t.text != "${":
            out.append(marks.get(t.kind, t.text))
    return out


#: Words of the language that stay in normalized blocks (type and out count as names).
RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof
    new null return super switch this throw true try typeof var void while with implements interface let package private protected public static yield
    abstract accessor as asserts assert any async await boolean constructor declare get infer intrinsic is keyof module namespace never readonly require
    number object satisfies set string symbol undefined unique unknown using from global bigint override of""".split()
)


def exact_block(text: str) -> str:
    """A block without trailing white space, blank edges and common indentation."""
    lines = [re.sub(r"\s+$", "", x) for x in text.replace("\r\n", "\n").split("\n")]
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    indents = [len(x) - len(x.lstrip(" \t")) for x in lines if x.strip()]
    cut = min(indents, default=0)
    return "\n".join(x[cut:] if len(x) >= cut else x for x in lines)


@lru_cache(256)
def hashed(body: str) -> tuple[int, str, str, str]:
    """Tokens, hash of the text, hash of the shape, and preview of a block; the blocks that are sought repeat, so each is often known."""
    shape, exact = raw_tokens(body), exact_block(body)
    return len(shape), fnv1a_py(exact), fnv1a_py(" ".join(shape)), "\n".join(exact.split("\n")[:14]).rstrip()


@dataclass
class Member:
    kind: str  # method ctor get set prop
    name: str | None
    start: int  # first token (modifiers included)
    name_at: int
    params: tuple[int, int] | None
    body: tuple[int, int] | None  # tokens { and }, or the initializer's first and last + 1
    modifiers: set[str] = field(default_factory=set)


@dataclass
class Class:
    name: str | None
    start: int
    open: int
    close: int
    top: bool
    members: list[Member]
    decorators: list[tuple[int, int]]  # token ranges after @


class File:
    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.t = scan(text)
        self.breaks = [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]
        self.pair: dict[int, int] = {}
        self.depth: list[int] = []
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind == "op" and t.text in CLOSE and stack:
                if OPEN[self.t[stack[-1]].text] == t.text:
                    j = stack.pop()
                    self.pair[i], self.pair[j] = j, i
            self.depth.append(len(stack))
            if t.kind == "op" and t.text in OPEN:
                stack.append(i)
        self.inside = [-1] * len(self.t)
        hold: list[int] = []
        for i in range(len(self.t)):
            if i in self.pair and self.pair[i] < i and hold:
                hold.pop()
            self.inside[i] = hold[-1] if hold else -1
            if self.pair.get(i, -1) > i:
                hold.append(i)
        self.bindings: dict[str, tuple[str, str]] = {}  # local -> (module, imported or *)
        self.modules: list[str] = []
        self.specs = self._imports()

    @cached_property
    def classes(self) -> list[Class]:
        return self._classes()

    def x(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "id"

    def line(self, i: int) -> int:
        return bisect_right(self.breaks, self.t[i].at) + 1

    def place(self, i: int) -> tuple[int, int]:
        """Line and column from 1; columns count UTF-16 units."""
        n = bisect_right(self.breaks, self.t[i].at)
        start = self.breaks[n - 1] if n else 0
        return n + 1, len(self.text[start : self.t[i].at].encode("utf-16-le", "surrogatepass")) // 2 + 1

    def source(self, a: int, b: int) -> str:
        return self.text[self.t[a].at : self.t[b - 1].end] if b > a else ""

    def literal(self, i: int) -> str | None:
        """The value of a string, or of a template without substitutions."""
        if 0 <= i < len(self.t) and (self.t[i].kind == "str" or self.t[i].kind == "tpl" and self.x(i).startswith("`") and self.x(i).endswith("`") and len(self.x(i)) > 1):
            return re.sub(r"\\(.)", r"\1", self.x(i)[1:-1])
        return None

    def args(self, i: int) -> list[tuple[int, int]]:
        """Token ranges of the items between a bracket and its partner."""
        end = self.pair.get(i)
        if end is None or end <= i + 1:
            return []
        out, a = [], i + 1
        for k in range(i + 1, end):
            if self.inside[k] == i and self.x(k) == ",":
                out.append((a, k))
                a = k + 1
        if a < end:
            out.append((a, end))
        return out

    # -- imports --

    def _imports(self) -> list[str]:
        found = []
        i = 0
        while i < len(self.t):
            w = self.x(i)
            if w == "import" and self.x(i - 1) != "." and self.t[i].kind == "id":
                if self.x(i + 1) == "(":
                    if self.t[i + 2].kind == "str" if i + 2 < len(self.t) else False:
                        found.append(self.literal(i + 2))
                elif self.x(i + 1) != "." and self.depth[i] == 0:
                    j = i + 1
                    while j < len(self.t) and self.t[j].kind != "str" and self.x(j) not in (";", "="):
                        j += 1
                    if j < len(self.t) and self.t[j].kind == "str":
                        spec = self.literal(j)
                        found.append(spec)
                        self.modules.append(spec)
                        self._bind(i + 1, j, spec)
                        i = j
            elif w == "export" and self.depth[i] == 0:
                j = i + 1 + (self.x(i + 1) == "type")
                if self.x(j) == "*":
                    j += 1 + 2 * (self.x(j + 1) == "as")
                elif self.x(j) == "{" and j in self.pair:
                    j = self.pair[j] + 1
                if self.x(j) == "from" and j + 1 < len(self.t) and self.t[j + 1].kind == "str":
                    found.append(self.literal(j + 1))
            i += 1
        return found

    def _bind(self, a: int, b: int, spec: str) -> None:
        for k in range(a, b):
            if self.x(k) == "*" and self.x(k + 1) == "as":
                self.bindings[self.x(k + 2)] = (spec, "*")
            if self.x(k) == "{" and k in self.pair:
                for p, q in self.args(k):
                    p += self.x(p) == "type" and q - p > 1 and self.x(p + 1) != "as"
                    self.bindings[self.x(q - 1)] = (spec, self.x(p))

    def local(self, name: str, *modules: str) -> set[str]:
        return {k for k, (m, n) in self.bindings.items() if n == name and m in modules}

    def spaces(self, module: str) -> set[str]:
        return {k for k, (m, n) in self.bindings.items() if n == "*" and m == module}

    def calls(self, i: int, names: set[str], spaces: set[str], imported: str) -> bool:
        """Whether the token before the bracket i is a call of an imported function."""
        if self.x(i - 1) in names and self.x(i - 2) not in (".", "?."):
            return True
        return self.x(i - 1) == imported and self.x(i - 2) == "." and self.x(i - 3) in spaces and self.x(i - 4) != "."

    # -- classes --

    def _classes(self) -> list[Class]:
        out = []
        for i, t in enumerate(self.t):
            if t.text != "class" or t.kind != "id" or self.x(i - 1) in (".", "?."):
                continue
            s = i
            while self.x(s - 1) in ("export", "default", "abstract", "declare"):
                s -= 1
            before = self.x(s - 1)
            decos: list[tuple[int, int]] = []
            e = s
            while True:  # decorators, from the nearest one
                k = e
                if self.x(k - 1) == ")" and k - 1 in self.pair:
                    k = self.pair[k - 1]
                while self.is_id(k - 1) and self.x(k - 2) == ".":
                    k -= 2
                if self.is_id(k - 1) and self.x(k - 2) == "@":
                    decos.append((k - 1, e))
                    e = k - 2
                else:
                    break
            decos.reverse()
            while self.x(e - 1) in ("export", "default"):
                e -= 1
            before = self.x(e - 1) if decos else before
            if s == i and not decos and before and before not in (";", "{", "}", ")") and self.t[i - 1].kind not in ("str", "id", "num", "tpl"):
                continue  # a class expression
            if s == i and not decos and self.t[i - 1].kind == "id" and before in ("return", "typeof", "new", "extends", "yield", "await", "in", "of", "case"):
                continue
            name = self.x(i + 1) if self.is_id(i + 1) and self.x(i + 1) not in ("extends", "implements") else None
            o, angle = i + 1, 0
            while o < len(self.t) and not (self.x(o) == "{" and angle <= 0):
                angle += {"<": 1, ">": -1}.get(self.x(o), 0)
                o = self.pair[o] + 1 if self.x(o) in ("(", "[", "{") and o in self.pair else o + 1
            if o >= len(self.t) or o not in self.pair:
                continue
            out.append(Class(name, e if decos else s, o, self.pair[o], self.depth[i] == 0, self._members(o, self.pair[o]), decos))
        return out

    def _members(self, o: int, close: int) -> list[Member]:
        out = []
        i = o + 1
        while i < close:
            if self.x(i) in (";", ","):
                i += 1
                continue
            start, mods = i, set()
            while True:
                if self.x(i) == "@":
                    i += 2
                    while self.x(i) == ".":
                        i += 2
                    if self.x(i) == "(" and i in self.pair:
                        i = self.pair[i] + 1
                elif self.x(i) in MODIFIERS and self.x(i + 1) not in ("(", "=", ":", ";", "?", "!", "<", "}"):
                    mods.add(self.x(i))
                    i += 1
                else:
                    break
            kind = "method"
            if self.x(i) == "*":
                i += 1
            if self.x(i) in ("get", "set") and self.x(i + 1) not in ("(", "=", ":", ";", "?", "!", "<"):
                kind = self.x(i)
                i += 1
            name_at = i
            if self.x(i) == "{" and i in self.pair:  # a static block
                i = self.pair[i] + 1
                continue
            name = self.x(i) if self.is_id(i) and not self.x(i).startswith("#") else None
            i = self.pair[i] + 1 if self.x(i) == "[" and i in self.pair else i + 1
            if self.x(i) in ("?", "!"):
                i += 1
            if self.x(i) == "<":
                angle = 0
                while i < close:
                    angle += {"<": 1, ">": -1, "<<": 2}.get(self.x(i), 0)
                    i = self.pair[i] + 1 if self.x(i) in ("(", "{", "[") and i in self.pair else i + 1
                    if angle <= 0:
                        break
            if self.x(i) == "(" and i in self.pair:
                params, k, body = (i, self.pair[i]), self.pair[i] + 1, None
                while k < close and self.x(k) not in (";", "}"):
                    if self.x(k) == "{" and k in self.pair:
                        if self.x(k - 1) in (":", "|", "&", "<", ",", "is", "=>"):
                            k = self.pair[k] + 1
                            continue
                        body = (k, self.pair[k])
                        break
                    if self.line(k) > self.line(k - 1) and self.is_id(k) and self.x(k - 1) not in (":", "|", "&", "<", ",", ".", "=>", "is"):
                        break
                    k = self.pair[k] + 1 if self.x(k) in ("(", "[") and k in self.pair else k + 1
                if name == "constructor" and kind == "method":
                    kind = "ctor"
                out.append(Member(kind, name, start, name_at, params, body, mods))
                i = body[1] + 1 if body else max(k, i + 1)
                continue
            # a property: its type and initializer, up to ; or a line that can't go on
            init = None
            while i < close and self.x(i) != ";":
                if self.x(i) == "=" and init is None and self.inside[i] == o:
                    init = i + 1
                fresh = i > name_at and self.line(i) > bisect_right(self.breaks, self.t[i - 1].end - 1) + 1
                ends = self.t[i - 1].kind in ("id", "num", "str", "tpl", "re") or self.x(i - 1) in (")", "]", "}")
                if fresh and ends and (self.is_id(i) or self.x(i) in ("@", "[", "*")) and self.x(i) not in ("as", "in", "of", "instanceof", "satisfies") and i != init and i > name_at:
                    break
                i = self.pair[i] + 1 if self.x(i) in ("(", "[", "{", "${") and i in self.pair else i + 1
            out.append(Member("prop", name, start, name_at, None, (init, i) if init else None, mods))
        return out

    # -- measures --

    def branches(self, a: int, b: int) -> int:
        n = 0
        for i in range(a, b):
            w = self.x(i)
            if self.t[i].kind == "id" and self.x(i - 1) not in (".", "?.") and self.x(i + 1) not in (":",) or w == "default":
                if w in ("if", "for", "do", "catch"):
                    n += self.x(i + 1) in ("(", "{", "await") or w == "do"
                elif w == "while":
                    n += not self._ends_do(i)
                elif w in ("case", "default"):
                    o = self.inside[i]
                    n += o > 0 and self.x(o - 1) == ")" and self.x(self.pair[o - 1] - 1) == "switch"
            elif w == "?" and self.x(i + 1) not in (":", ",", ")", "=", ";", "(", "<", "]", "}") or w == "?" and self.x(i + 1) in ("(", "<") and self._ternary(i):
                n += self._ternary(i)
        return n

    def _ternary(self, i: int) -> bool:
        o = self.inside[i]
        for k in range(i + 1, len(self.t)):
            if self.inside[k] == o:
                if self.x(k) == ":":
                    return True
                if self.x(k) in (";", ","):
                    return False
            elif k in self.pair and self.pair[k] == o:
                return False
        return False

    def _ends_do(self, i: int) -> bool:
        return self.x(i - 1) == "}" and i - 1 in self.pair and self.x(self.pair[i - 1] - 1) == "do"

    def params(self, m: Member) -> list[tuple[int, int]]:
        out, angle, a = [], 0, m.params[0] + 1
        for k in range(m.params[0] + 1, m.params[1]):
            angle += {"<": 1, ">": -1}.get(self.x(k), 0) if self.inside[k] == m.params[0] else 0
            if self.inside[k] == m.params[0] and self.x(k) == "," and angle <= 0:
                out.append((a, k))
                a = k + 1
        return out + [(a, m.params[1])] if a < m.params[1] else out

    def callee(self, o: int) -> int:
        """The token before a call's bracket, or before its type arguments."""
        j, angle = o - 1, 0
        while self.x(j) in (">", ">>") or angle > 0:
            angle += {">": 1, ">>": 2, "<": -1}.get(self.x(j), 0)
            j -= 1
            if j < 0 or o - j > 60 or self.x(j + 1) in (";", "="):
                return o - 1
        return j

    def receiver(self, dot: int) -> int:
        """The first token of the expression that ends before a dot."""
        i = dot
        while True:
            j = i - 1
            if self.x(j) == "!":
                j -= 1
            while self.x(j) in (")", "]") and j in self.pair:
                j = self.callee(self.pair[j])
                if self.x(j) in (".", "?.") or not (self.is_id(j) and self.x(j) not in KEYWORDS or self.x(j) in (")", "]")):
                    break
            if self.is_id(j) and self.x(j) not in KEYWORDS:
                i = j
            elif self.t[j].kind in ("str", "tpl", "num") if j >= 0 else False:
                return j
            else:
                return j + 1
            if self.x(i - 1) == "new":
                i -= 1
            if self.x(i - 1) in (".", "?."):
                i -= 1
                continue
            return i

    def this_prop(self, a: int, b: int) -> str | None:
        """x of tokens that are exactly this.x"""
        return self.x(a + 2) if b - a == 3 and self.x(a) == "this" and self.x(a + 1) in (".", "?.") else None

    def assigned(self, a: int) -> str | None:
        """x where the expression that starts at a is the right side of this.x = """
        return self.this_prop(a - 4, a - 1) if self.x(a - 1) == "=" else None


def _may_repeat(path: str, text: str) -> bool:
    """Whether there are lines enough from the first class to the last bracket for a block."""
    a, b = text.find("class"), text.rfind("}")
    return a >= 0 and text.count("\n", a, max(a, b)) + text.count("\r", a, max(a, b)) >= MIN_LINES - 1


def _has(*words: str) -> Callable[[str, str], bool]:
    return lambda path, text: any(w in text for w in words)


#: Sections of facts: the kinds of each, and whether a text may have any.  A text without these words has none for certain.
SECTIONS: dict[str, tuple[frozenset[str], Callable[[str, str], bool]]] = {
    "import": (frozenset(["import"]), lambda path, text: "import" in text or "export" in text and "from" in text),
    "complexity": (frozenset(["complexity"]), lambda path, text: True),
    "artifact": (frozenset(["artifact"]), lambda path, text: "class" in text and any(w in text for w in ARTIFACTS)),
    "route": (frozenset(["route", "route_objects"]), lambda path, text: path.endswith((".routes.ts", "-routing.module.ts"))),
    "signal": (frozenset(["signal"]), _has("import", *NAME_SIGNALS)),
    "class": (frozenset(["class", "method"]), _has("class")),
    "block": (frozenset(["block"]), _may_repeat),
    "lifecycle": (
        frozenset("unsubscribe clearInterval cancelAnimationFrame unlisten take_until composite composite_used on_destroy destroy_next destroy_complete subscribe listener setInterval requestAnimationFrame effect to_signal".split()),
        lambda path, text: "class" in text and any(w in text for w in ("ubscri", "add", "takeUntil", "ngOnDestroy", "EventListener", "Interval", "AnimationFrame", "effect", "toSignal")),
    ),
    "component": (frozenset("component_gate template_url inline_template inline_styles component_class http_call dup_import".split()), lambda path, text: GATE.search(text) is not None),
}


def facts(path: str, text: str, max_window: int = 200_000, sections: Container[str] = SECTIONS) -> list[dict]:
    """The facts of a file, as rows with kind, ord, cls (class uid), method, key, value, extra, n, n2..n5, line, col: all of them,
    or those of some sections."""
    asked = {name for name, (_, may) in SECTIONS.items() if name in sections and may(path, text)}
    if not asked:
        return []
    f = File(path, text)
    rows: list[dict] = []

    def put(kind: str, **v) -> None:
        rows.append({"kind": kind, "ord": len(rows), **v})

    for s in f.specs if "import" in asked else ():
        put("import", key=s)
    if "complexity" in asked:
        _complexity(f, put)
    if "artifact" in asked:
        _artifacts(f, put)
    if "route" in asked:
        _routes(f, put)
    if "signal" in asked:
        names = {MODULE_SIGNALS.get(m) or ("ui" if m.startswith("@angular/material") else None) for m in f.modules} | {NAME_SIGNALS.get(t.text) for t in f.t if t.kind == "id"}
        for s in sorted(names - {None}):
            put("signal", key=s)
    if asked & {"class", "block", "lifecycle"}:
        _classes(f, put, asked)
    if "component" in asked:
        _component(f, put, max_window)
    return rows


def _complexity(f: File, put) -> None:
    decl = [m for c in f.classes for m in c.members]
    ctor = max((len(f.params(m)) for m in decl if m.kind == "ctor"), default=0)
    put("complexity", n=f.text.count("\n") + 1, n2=len(f.classes), n3=sum(m.kind in ("method", "get", "set") and m.body is not None for m in decl), n4=ctor, n5=f.branches(0, len(f.t)))


def _classes(f: File, put, asked: set[str]) -> None:
    for k, c in enumerate(f.classes):
        line = f.line(c.start)
        uid = f"{f.path}#{c.name}@{line}"
        if c.name:
            if "class" in asked:
                put("class", cls=uid, key=c.name, line=line, n=f.line(c.close))
            for m in c.members:
                if m.kind == "method" and m.body and m.name:
                    if "class" in asked:
                        first = f.line(m.start)
                        vis = next((v for v in ("private", "protected") if v in m.modifiers), "public")
                        last = f.line(m.body[1])
                        put("method", cls=uid, method=m.name, key=m.name, value=vis, line=first, n=last, n2=last - first + 1, n3=f.branches(m.start, m.body[1]), n4=len(f.params(m)))
                    if "block" in asked:
                        _block(f, c, m, put, uid)
        if "lifecycle" in asked and f.depth[c.open] == 0:
            _lifecycle(f, c, f"{uid}/{k}", put)


def _block(f: File, c: Class, m: Member, put, uid: str) -> None:
    a, b = m.body
    n = f.line(b) - f.line(a) + 1
    if n < MIN_LINES:
        return
    tokens, exact, shape, preview = hashed(f.source(a, b + 1))
    if tokens >= MIN_TOKENS:
        put("block", cls=uid, method=m.name, key=exact, value=shape, extra=preview if len(preview) <= 900 else preview[:900].rstrip() + "...", line=f.line(a), n=f.line(b), n2=n, n3=tokens)


def _decorated(f: File, c: Class, name: str) -> tuple[int, int] | None:
    """The decorator of a class that stands for a core decorator, by local name or namespace."""
    local, spaces = f.local(name, "@angular/core"), f.spaces("@angular/core")
    for a, b in c.decorators:
        if f.x(a) in local and f.x(a + 1) in ("(", "") or f.x(a) in local and b == a + 1:
            return a, b
        if f.x(a) in spaces and f.x(a + 1) == "." and f.x(a + 2) == name and f.x(a + 3) == "(":
            return a, b
    return None


def _artifacts(f: File, put) -> None:
    for name, kind in ARTIFACTS.items():
        if any(c.top and _decorated(f, c, name) for c in f.classes):
            put("artifact", key=kind)


def _routes(f: File, put) -> None:
    if not f.path.endswith((".routes.ts", "-routing.module.ts")):
        return
    arrays: list[int] = []
    named: dict[str, int] = {}
    objects = 0
    for i, t in enumerate(f.t):
        if t.text in ("const", "let", "var") and f.depth[i] == 0 and f.is_id(i + 1):
            j = i + 2
            typed = False
            while j < len(f.t) and f.x(j) not in ("=", ";"):
                typed |= f.x(j) == "Routes" or f.x(j) == "Route" and f.x(j + 1) == "["
                j += 1
            if f.x(j) == "=" and f.x(j + 1) == "[" and j + 1 in f.pair:
                end = f.pair[j + 1]
                named[f.x(i + 1)] = j + 1
                if typed:
                    objects += sum(f.x(a) == "{" for a, _ in f.args(j + 1))
                if typed or f.x(end + 1) in ("as", "satisfies") and f.x(end + 2) == "Routes":
                    arrays.append(j + 1)
    for i, t in enumerate(f.t):
        if t.text in ("provideRouter", "forRoot", "forChild") and f.x(i + 1) == "(" and (t.text == "provideRouter" or f.x(i - 2) == "RouterModule"):
            if f.x(i + 2) == "[":
                arrays.append(i + 2)
            elif f.x(i + 2) in named:
                arrays.append(named[f.x(i + 2)])
    paths: set[str] = set()

    def read(o: int) -> None:
        for a, b in f.args(o):
            if f.x(a) != "{" or a not in f.pair:
                continue
            for p, q in f.args(a):
                if f.x(p) in ("path", "'path'", '"path"') and f.x(p + 1) == ":" and f.literal(p + 2) is not None and q == p + 3:
                    paths.add(f.literal(p + 2))
                if f.x(p) == "children" and f.x(p + 1) == ":" and f.x(p + 2) == "[":
                    read(p + 2)

    for o in arrays:
        read(o)
    for p in sorted(paths):
        put("route", key=p)
    put("route_objects", n=objects)


#: Patterns of the decorator window.
GATE = re.compile(r"@Component\s*\(")
WINDOW_END = re.compile(r"^\s*export\s+(default\s+)?class\b", re.M)
TEMPLATE_URL = re.compile(r"(?:^|[,{]\s*)templateUrl\s*:\s*(['\"`])([^'\"`]+)\1", re.M)
TEMPLATE = re.compile(r"(?:^|[,{]\s*)template\s*:", re.M)
TEMPLATE_TEXT = re.compile(r"(?:^|[,{]\s*)template\s*:\s*`([\s\S]*?)`", re.M)
STYLES = re.compile(r"(?:^|[,{]\s*)styles\s*:", re.M)


def _component(f: File, put, max_window: int) -> None:
    at = GATE.search(f.text)
    if not at:
        return
    window = f.text[at.start() : at.start() + max_window]
    end = WINDOW_END.search(window)
    window = window[: end.start()] if end else window
    put("component_gate")
    if m := TEMPLATE_URL.search(window):
        put("template_url", key=m.group(2))
    if TEMPLATE.search(window):
        inline = TEMPLATE_TEXT.search(window)
        put("inline_template", n=len(re.split(r"\r?\n", inline.group(1))) if inline else None)
    if STYLES.search(window):
        put("inline_styles")
    http = f.local("HttpClient", "@angular/common/http")
    for c in f.classes:
        deco = c.top and _decorated(f, c, "Component")
        if not deco:
            continue
        ctor = next((m for m in c.members if m.kind == "ctor"), None)
        put("component_class", key=c.name, n=len(f.params(ctor)) if ctor else 0)
        for a, b in f.params(ctor) if ctor else []:
            words = [f.x(k) for k in range(a, b)]
            if ":" in words and words[0] in ("private", "public", "protected", "readonly"):
                k = a + words.index(":")
                if f.x(k + 1) in http and k + 2 >= b:
                    prop = f.x(k - 1)
                    used = {f.x(i + 4) for i in range(c.open, c.close) if f.x(i) == "this" and f.x(i + 1) == "." and f.x(i + 2) == prop and f.x(i + 3) == "." and f.x(i + 4) in HTTP_METHODS and f.x(i + 5) in ("(", "<")}
                    if used:
                        put("http_call", key=prop, value=", ".join(sorted(used)))
        o = deco[1] - 1
        o = f.pair.get(o, -1) + 1
        if f.x(o) == "{":
            props = {f.x(p): (p + 2, q) for p, q in f.args(o) if f.x(p + 1) == ":"}
            if f.x(props.get("standalone", (-1, 0))[0]) == "true" and f.x(props.get("imports", (-1, 0))[0]) == "[":
                items = [f.source(a, b) for a, b in f.args(props["imports"][0]) if all(f.is_id(k) or f.x(k) == "." for k in range(a, b)) and b - a <= 3]
                for name in sorted({s for s in items if items.count(s) > 1}):
                    put("dup_import", key=name)


def _lifecycle(f: File, c: Class, uid: str, put) -> None:
    """Uses and clean-ups of subscriptions, listeners, timers and effects in a top-level class."""
    core, rx = "@angular/core", "rxjs"
    until = f.local("takeUntil", rx, "rxjs/operators") | {"takeUntil"}
    until_destroyed = f.local("takeUntilDestroyed", "@angular/core/rxjs-interop") | {"takeUntilDestroyed"}
    event, every = f.local("fromEvent", rx) | {"fromEvent"}, f.local("interval", rx) | {"interval"}
    effects, signals = f.local("effect", core) | {"effect"}, f.local("toSignal", "@angular/core/rxjs-interop") | {"toSignal"}
    subs = f.local("Subscription", rx) | {"Subscription"}
    rxs, interop = f.spaces(rx), f.spaces("@angular/core/rxjs-interop")
    loc = lambda i: dict(zip(("line", "col"), f.place(i)))

    def this_method(i: int) -> str | None:
        """x of this.x.<name>( with the name at i"""
        return f.this_prop(i - 4, i - 1) if f.x(i - 1) in (".", "?.") and f.x(i - 5) not in (".", "?.") else None

    def listener(i: int) -> tuple[str, list] | None:
        args = f.args(i + 1)
        if len(args) < 2 or f.literal(args[0][0]) is None or args[0][1] - args[0][0] != 1:
            return None
        a, b = args[1]
        if not all(f.is_id(k) if (k - a) % 2 == 0 else f.x(k) in (".", "?.") for k in range(a, b)) or f.x(a) in KEYWORDS:
            return None
        return "::".join((f.source(f.receiver(i - 1), i - 1).strip(), f.literal(args[0][0]), f.source(a, b))), args

    for i in range(c.open, c.close):
        if f.x(i + 1) != "(" or not f.is_id(i):
            if f.x(i) == "new" and f.x(i - 1) == "=" and f.is_id(i - 2) and (f.x(i + 1) in subs or f.x(i + 1) in rxs and f.x(i + 3) == "Subscription"):
                m = next((m for m in c.members if m.kind == "prop" and m.body and m.body[0] == i), None)
                if m and m.name:
                    put("composite", cls=uid, key=m.name, **loc(m.name_at))
            continue
        w = f.x(i)
        if w == "unsubscribe" and this_method(i):
            put("unsubscribe", cls=uid, key=this_method(i))
        elif w in ("clearInterval", "cancelAnimationFrame") and f.args(i + 1) and (p := f.this_prop(*f.args(i + 1)[0])):
            put(w, cls=uid, key=p)
        elif w == "removeEventListener" and f.x(i - 1) in (".", "?.") and (got := listener(i)):
            put("unlisten", cls=uid, key=got[0])
        elif w == "add" and this_method(i):
            put("composite_used", cls=uid, key=this_method(i))
        if f.calls(i + 1, until, rxs, "takeUntil") and f.args(i + 1) and (p := f.this_prop(*f.args(i + 1)[0])) in ("destroy$", "destroyed$"):
            put("take_until", cls=uid, key=p, **loc(f.args(i + 1)[0][0]))
    for m in c.members:
        if m.kind == "method" and m.name == "ngOnDestroy":
            put("on_destroy", cls=uid)
            for i in range(*m.body) if m.body else ():
                if f.x(i + 1) == "(" and f.x(i) in ("next", "complete") and this_method(i) in ("destroy$", "destroyed$"):
                    put(f"destroy_{f.x(i)}", cls=uid, key=this_method(i))
    for m in c.members:
        if m.body is None or m.kind not in ("method", "ctor", "prop"):
            continue
        own = m.name if m.kind == "prop" else None
        where = {"cls": uid, "method": "constructor" if m.kind == "ctor" else m.name}
        for i in range(*m.body):
            if f.x(i + 1) != "(" or not f.is_id(i):
                continue
            w = f.x(i)
            if w == "subscribe" and f.x(i - 1) in (".", "?."):
                a = f.receiver(i - 1)
                root, pipe = _unwrap(f, a, i - 1)
                fixed = any(f.x(p + 1) == "(" and (f.x(p) in until_destroyed) or f.x(p + 2) == "takeUntilDestroyed" and f.x(p) in interop for p, _ in pipe)
                fixed |= any(f.x(p) in until and f.args(p + 1) and f.this_prop(*f.args(p + 1)[0]) in ("destroy$", "destroyed$") for p, _ in pipe)
                fixed |= any(f.x(p) == "first" and f.x(p + 1) == "(" or f.x(p) == "take" and f.source(p + 1, min(p + 4, len(f.t))) == "(1)" for p, _ in pipe)
                kind = "other"
                if f.x(root[1] - 1) == ")" and root[1] - 1 in f.pair:
                    o = f.pair[root[1] - 1]
                    kind = "fromEvent" if f.calls(o, event, rxs, "fromEvent") else "interval" if f.calls(o, every, rxs, "interval") else "call"
                    h = f.callee(o)
                    if f.x(h) in HTTP_METHODS and "http" in f.x(h - 2).lower() and f.x(h - 1) in (".", "?."):
                        fixed = True
                elif f.x(root[1] - 1) in LONG_LIVED and f.x(root[1] - 2) in (".", "?."):
                    kind = "longLived"
                field_ = f.assigned(a) or own
                comp = this_method(a - 2) if f.x(a - 1) == "(" and f.x(a - 2) == "add" else None
                put("subscribe", key=kind, value=field_, extra=comp, n=int(fixed), **where, **loc(i))
            elif w == "addEventListener" and f.x(i - 1) in (".", "?.") and (got := listener(i)):
                once = len(got[1]) > 2 and f.x(got[1][2][0]) == "{" and any(f.x(p) in ("once", "'once'", '"once"') and f.x(p + 2) == "true" for p, _ in f.args(got[1][2][0]))
                put("listener", key=got[0], n=int(once), **where, **loc(i))
            elif w in ("setInterval", "requestAnimationFrame") and f.x(i - 1) not in (".", "?.") and (p := f.assigned(i) or own):
                put(w, key=p, **where, **loc(i))
            elif f.calls(i + 1, effects, f.spaces(core), "effect") and f.args(i + 1):
                a, b = f.args(i + 1)[0]
                k = a + (f.x(a) == "async") + (f.x(a) == "function")
                arrow = any(f.x(j) == "=>" and f.inside[j] == i + 1 for j in range(a, b)) or f.x(a) == "function"
                param = f.x(k + 1) if f.x(k) == "(" else f.x(k)
                param = param if param != ")" else ""
                used = {f.x(j) for j in range(a, b) if f.x(j) in ("setInterval", "requestAnimationFrame", "addEventListener") and f.x(j + 1) == "("}
                if arrow and used:
                    cleans = bool(param) and any(f.x(j) == param and f.x(j + 1) == "(" and j > k + 1 for j in range(a, b))
                    put("effect", key=", ".join(sorted(used)), n=int(cleans), **where, **loc(i))
            elif f.calls(i + 1, signals, interop, "toSignal") and len(f.args(i + 1)) > 1:
                a, _ = f.args(i + 1)[1]
                if f.x(a) == "{" and any(f.x(p).strip("'\"") == "manualCleanup" and f.x(p + 2) == "true" for p, _ in f.args(a)):
                    put("to_signal", **where, **loc(i))


def _unwrap(f: File, a: int, b: int) -> tuple[tuple[int, int], list[tuple[int, int]]]:
    """The root of an observable expression a..b, and the arguments of its pipe() calls."""
    pipe: list[tuple[int, int]] = []
    while b > a:
        if f.x(a) == "(" and f.pair.get(a) == b - 1:
            a, b = a + 1, b - 1
            continue
        o = f.pair.get(b - 1, -1)
        if f.x(b - 1) == ")" and o > a and f.x(o - 1) in ("pipe", "asObservable") and f.x(o - 2) in (".", "?."):
            if f.x(o - 1) == "pipe":
                pipe = f.args(o) + pipe
            b = o - 2
            continue
        break
    return (a, b), pipe
