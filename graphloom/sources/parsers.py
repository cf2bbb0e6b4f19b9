"""Source-code parsers: file texts to symbols, imports and call sites.

Python files go through the standard library's syntax trees; Go, JavaScript and TypeScript are matched
bracket by bracket in texts without strings and comments (see :mod:`lexing`), the other languages by patterns. Each parser takes ``(path, text)`` and
returns a :class:`Parsed`; :data:`PARSERS` finds one by extension.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.lexing import Bare, bare

SYMBOLS = "file_path string, id string, name string, kind string, package string, start_line int, end_line int, exported boolean, language string, signature string, receiver string, parent string, bases array<string>, returns string, code string"
IMPORTS = "file_path string, path string, alias string, names array<string>, is_wildcard boolean, is_relative boolean"
REFERENCES = "file_path string, src string, name string, line int, why string"
CALLS = "file_path string, caller_id string, target string, receiver string, is_method boolean, line int"


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def symbol(self, path: str, name: str, kind: str, line: int, end: int, language: str, **more) -> str:
        id = f"{path}:{line}:{name}"
        base = {"package": "", "exported": True, "signature": "", "receiver": None, "parent": None, "bases": [], "returns": None, "code": ""}
        self.symbols.append({"file_path": path, "id": id, "name": name, "kind": kind, "start_line": line, "end_line": end, "language": language} | base | more)
        return id

    def call(self, path: str, caller: str, target: str, receiver: str | None, line: int) -> None:
        self.calls.append({"file_path": path, "caller_id": caller, "target": target, "receiver": receiver, "is_method": bool(receiver), "line": line})

    def refer(self, path: str, src: str, name: str, line: int, why: str) -> None:
        self.references.append({"file_path": path, "src": src, "name": name, "line": line, "why": why})

    def include(self, path: str, what: str, alias: str | None = None, names: list[str] | None = None, relative: bool = False) -> None:
        names = names or []
        self.imports.append({"file_path": path, "path": what, "alias": alias, "names": [n for n in names if n != "*"], "is_wildcard": "*" in names, "is_relative": relative})


def parse_python(path: str, text: str) -> Parsed:
    out = Parsed()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        out.errors.append(str(e))
        return out
    lines = text.split("\n")
    package = path.rsplit("/", 1)[0] if "/" in path else ""

    def calls(node: ast.AST, owner: str) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            if isinstance(n, ast.Call):
                f = n.func
                if isinstance(f, ast.Name):
                    out.call(path, owner, f.id, None, n.lineno)
                elif isinstance(f, ast.Attribute):
                    out.call(path, owner, f.attr, ast.unparse(f.value), n.lineno)
            calls(n, owner)

    def names(node: ast.AST | None) -> Iterator[tuple[str, int]]:
        """Names in an annotation or an argument, also in quotes."""
        for n in ast.walk(node) if node is not None else ():
            if isinstance(n, ast.Name):
                yield n.id, n.lineno
            elif isinstance(n, ast.Constant) and isinstance(n.value, str):
                yield from ((w, n.lineno) for w in re.findall(r"[A-Za-z_]\w*", n.value))

    def refer(n: ast.AST, id: str) -> None:
        """What a function or class refers to: arguments of decorators, annotations, and types in isinstance."""
        for d in n.decorator_list:
            for arg in [*d.args, *(k.value for k in d.keywords)] if isinstance(d, ast.Call) else ():
                if isinstance(arg, ast.Name):
                    out.refer(path, id, arg.id, d.lineno, "decorator")
        if isinstance(n, ast.ClassDef):
            return
        own = n.args
        for a in [*own.posonlyargs, *own.args, *own.kwonlyargs, *filter(None, (own.vararg, own.kwarg))]:
            for name, line in names(a.annotation):
                out.refer(path, id, name, line, "type")
        for name, line in names(n.returns):
            out.refer(path, id, name, line, "type")
        for c in ast.walk(n):
            if isinstance(c, ast.Call) and isinstance(c.func, ast.Name) and c.func.id == "isinstance" and len(c.args) == 2:
                for name, line in names(c.args[1]):
                    out.refer(path, id, name, line, "narrowing")

    def visit(body: list[ast.stmt], parent: str | None, cls: str | None) -> None:
        for n in body:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                returns = ast.unparse(n.returns) if n.returns else None
                id = out.symbol(
                    path, n.name, "method" if cls else "function", n.lineno, n.end_lineno, "python", package=package, exported=not n.name.startswith("_"), parent=parent, receiver=cls,
                    signature=f"def {n.name}({ast.unparse(n.args)})" + (f" -> {returns}" if returns else ""), returns=returns, code="\n".join(lines[n.lineno - 1 : n.end_lineno]),
                )
                calls(n, id)
                refer(n, id)
                visit(n.body, id, None)
            elif isinstance(n, ast.ClassDef):
                id = out.symbol(path, n.name, "class", n.lineno, n.end_lineno, "python", package=package, exported=not n.name.startswith("_"), parent=parent, bases=[ast.unparse(b) for b in n.bases], signature=f"class {n.name}")
                refer(n, id)
                visit(n.body, id, n.name)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    out.include(path, a.name, a.asname)
            elif isinstance(n, ast.ImportFrom):
                where = "." * n.level + (n.module or "")
                if plain := [a.name for a in n.names if not a.asname]:
                    out.include(path, where, None, plain, n.level > 0)
                for a in n.names:
                    if a.asname:
                        out.include(path, where, a.asname, [a.name], n.level > 0)
            elif isinstance(n, ast.Assign | ast.AnnAssign) and parent is None:
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        out.symbol(path, t.id, "constant" if t.id.isupper() else "variable", n.lineno, n.end_lineno, "python", package=package, exported=not t.id.startswith("_"))
            elif isinstance(n, ast.If | ast.Try | ast.With):
                visit([x for x in ast.walk(n) if isinstance(x, ast.Import | ast.ImportFrom)], parent, cls)

    visit(tree.body, None, None)
    return out


_CALL = re.compile(r"(?:([A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*)\??\.)?([A-Za-z_$][\w$]*)\s*\(")
_GO_KEYWORDS = frozenset("if for switch return func go defer select range else case".split())
_SCRIPT_KEYWORDS = frozenset("if for while switch return function catch typeof new await async else case with do super constructor import".split())


def _own_calls(out: Parsed, path: str, b: Bare, bodies: list[tuple[int, int, str]], names: set[int], keywords: frozenset[str]) -> None:
    """Calls in ``bodies`` (start, end, symbol), each of the innermost one; ``names`` are where declared names stand, which are no calls."""
    bodies = sorted(bodies, key=lambda x: (x[0], -x[1]))
    around: list[tuple[int, int, str]] = []
    k = 0
    for m in _CALL.finditer(b.text):
        at = m.start(2)
        while k < len(bodies) and bodies[k][0] <= at:
            around.append(bodies[k])
            k += 1
            while len(around) > 1 and around[-2][1] < around[-1][0]:
                del around[-2]
        while around and around[-1][1] < at:
            around.pop()
        if around and at not in names and m[2] not in keywords:
            out.call(path, around[-1][2], m[2], m[1].replace("?", "") if m[1] else None, b.line(at))


_GO_TOP = re.compile(r"^(func|type|var|const|import)\b[ \t]*", re.M)
_GO_NAME = re.compile(r"\s*([^\W\d]\w*)\s*")
_GO_METHOD = re.compile(r"^[ \t]*([^\W\d]\w*)\(", re.M)


def _go_body(b: Bare, at: int) -> int:
    """Where the body of a function opens whose parameters end before ``at``; the end of the line if it has none."""
    while at < len(b.text):
        m = re.compile(r"(?:interface|struct)\s*\{|[(\[{\n]").search(b.text, at)
        if not m:
            break
        if m[0] in "{\n":
            return m.start()
        at = b.end(m.end() - 1) + 1  # a type's own brackets
    return len(b.text)


def _go_specs(b: Bare, at: int) -> Iterator[int]:
    """Where the specifications of a type, var, const or import declaration begin: one, or those in its parentheses."""
    if b.text[at : at + 1] != "(":
        yield at
        return
    stop = b.end(at)
    for m in re.compile(r"[^\s;()]").finditer(b.text, at + 1, stop):
        before = b.text[at + 1 : m.start()].rstrip(" \t")[-1:]
        if before in ("", "\n", ";") and b.inside(m.start()) == at:
            yield m.start()


def parse_go(path: str, text: str) -> Parsed:
    """Go files: declarations at the top level, also grouped ones and signatures over several lines."""
    out, b = Parsed(), bare(text)
    code = b.text
    package = next((m[1] for m in re.finditer(r"^package\s+(\w+)", code, re.M)), "")
    more = lambda name: {"package": package, "exported": name[0].isupper()}
    bodies: list[tuple[int, int, str]] = []
    names: set[int] = set()
    done = -1
    for top in _GO_TOP.finditer(code):
        first, at = top.start(), top.end()
        if first < done or b.inside(first) != -1:
            continue
        if top[1] == "func":
            receiver = None
            if code[at : at + 1] == "(":
                m = re.fullmatch(r"(?:\w+\s+)?\*?\s*([\w.]+)(?:\[.*\])?", code[at + 1 : b.end(at)].strip(), re.S)
                receiver = m[1] if m else None
                at = b.end(at) + 1
            if not (m := _GO_NAME.match(code, at)):
                continue
            name, at = m[1], m.end()
            if code[at : at + 1] == "[":
                at = b.end(at) + 1
            if code[at : at + 1] != "(":
                continue
            params = b.end(at) + 1
            body = _go_body(b, params)
            done = b.end(body) if code[body : body + 1] == "{" else body
            returns = b.head(params, body)
            if returns.startswith("(") and b.end(code.index("(", params)) >= code.rfind(")", params, body):
                returns = returns[1:-1].strip()
            id = out.symbol(path, name, "method" if receiver else "function", b.line(first), b.line(min(done, max(len(code) - 1, 0))), "go", receiver=receiver, signature=b.head(first, body), returns=returns or None, code=b.rows(first, done), **more(name))
            names.add(m.start(1))
            bodies.append((body, done, id))
            continue
        for spec in _go_specs(b, at):
            if top[1] == "import":
                if m := re.compile(r"([\w.]+)?[ \t]*(\"|`)?").match(code, spec):
                    quote = text.find('"', m.start()) if m[2] else -1
                    if quote >= 0:
                        out.include(path, b.quoted(quote), m[1], ["*"] if m[1] == "." else None)
                continue
            if not (m := _GO_NAME.match(code, spec)):
                continue
            name, line = m[1], b.line(spec)
            if top[1] != "type":
                out.symbol(path, name, "constant" if top[1] == "const" else "variable", line, line, "go", **more(name))
                continue
            after = m.end()
            if code[after : after + 1] == "[" and not code[after:].startswith("[]") and (t := re.compile(r"\s*(?:struct|interface)\b").match(code, b.end(after) + 1)):
                after = t.start()
            begin = first if spec == at else spec
            if not (kind := re.compile(r"\s*(struct|interface)\s*\{").match(code, after)):
                stop = code.find("\n", spec)
                out.symbol(path, name, "type", line, line, "go", signature=b.head(begin, stop if stop >= 0 else len(code)), **more(name))
                continue
            body = kind.end() - 1
            stop = b.end(body)
            inner = code[body + 1 : stop]
            bases = [x.lstrip("*") for x in (re.sub(r"`.*|\".*", "", y).strip() for y in inner.split("\n")) if re.fullmatch(r"\*?[^\W\d][\w.]*", x)]
            id = out.symbol(path, name, kind[1], b.line(begin), b.line(stop), "go", bases=bases, signature=b.head(begin, body), code=b.rows(begin, stop), **more(name))
            done = max(done, stop)
            for m in _GO_METHOD.finditer(code, body + 1, stop) if kind[1] == "interface" else ():
                if b.inside(m.start(1)) == body:
                    end = _go_body(b, b.end(m.end() - 1) + 1)
                    out.symbol(path, m[1], "method", b.line(m.start(1)), b.line(max(m.start(1), min(end, stop) - 1)), "go", receiver=name, parent=id, signature=b.head(m.start(1), min(end, stop)), **more(m[1]))
    _own_calls(out, path, b, bodies, names, _GO_KEYWORDS)
    return _refer_by_text(out, path, code.split("\n"))


def _named(out: Parsed, path: str, where: str, inner: str, mark: str) -> list[str]:
    """The names of an import list that keep their names; the renamed ones are noted one by one."""
    names = []
    for part in inner.split(","):
        a, _, b = (x.strip() for x in (part.partition(":") if mark == ":" else re.sub(r"\s+as\s+", ":", part).partition(":")))
        if a and b:
            out.include(path, where, b, [a], where.startswith("."))
        elif a:
            names.append(a.split()[-1])
    return names


def _refer_by_text(out: Parsed, path: str, lines: list[str]) -> Parsed:
    """References of symbols of other languages: types in signatures, type arguments, instanceof and type assertions, arguments of decorators above."""
    for s in out.symbols:
        if s["kind"] not in ("function", "method", "class", "interface", "struct", "type"):
            continue
        at, id = s["start_line"], s["id"]
        head = re.sub(rf"\b{re.escape(s['name'])}\b", " ", s["signature"] or "", count=1)
        own = set(re.findall(r"(?::\s*|<\s*|[,|&]\s*|=>\s*)\*?([A-Z][\w$]*)", head) if s["language"] != "go" else re.findall(r"(?:[\s*\]\[,(])([A-Z]\w*)", head))
        for name in sorted(own):
            out.refer(path, id, name, at, "type")
        if s["kind"] in ("function", "method"):
            for i in range(at - 1, min(s["end_line"], len(lines))):
                for name in re.findall(r"\binstanceof\s+([A-Za-z_$][\w$]*)" if s["language"] != "go" else r"\.\(\*?([A-Za-z_]\w*)\)", lines[i]):
                    if name != "type":
                        out.refer(path, id, name, i + 1, "narrowing")
        for i in range(at - 2, -1, -1):
            m = re.match(r"\s*@[\w$.]+\(([^)]*)\)", lines[i])
            if not m and not re.match(r"\s*@", lines[i]):
                break
            for name in re.findall(r"(?:^|[\[,(]\s*)([A-Za-z_$][\w$]*)\s*(?=$|[,\])])", m[1]) if m else ():
                out.refer(path, id, name, i + 1, "decorator")
    return out


_WORDS = r"(?:(?:export|default|declare|abstract|async)\s+)*"
_S_TYPE = re.compile(rf"(?:^|(?<=[;{{}}]))[ \t]*({_WORDS})(class|interface|enum|type)\s+([\w$]+)", re.M)
_S_FUNCTION = re.compile(rf"({_WORDS})\bfunction\b\s*\*?\s*([\w$]+)\s*(?=[<(])")
_S_BINDING = re.compile(r"(?:^|(?<=[;{}]))[ \t]*((?:export\s+)?)(const|let|var)\s+([\w$]+)\s*(?::(?:[^=;\n]|=>)+?)?(?:=(?![=>])\s*)?", re.M)
_S_VALUE = re.compile(r"(?:async\b\s*)?(?:function\b\s*\*?\s*[\w$]*\s*)?")
_S_MEMBER = re.compile(r"((?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+|\*\s*)*)(#?[A-Za-z_$][\w$]*)\s*[?!]?\s*(?=[<(])")
_S_FIELD = re.compile(r"((?:(?:public|private|protected|static|readonly|override)\s+)*)(#?[A-Za-z_$][\w$]*)\s*(?::(?:[^=;\n]|=>)+?)?=(?![=>])\s*")
_S_IMPORT = re.compile(r"^[ \t]*import\b(?!\s*[(.])\s*(?:type\s+(?!from\b))?([^'\";()]*?)(?:\bfrom\s*)?(?=['\"])", re.M)
_S_REQUIRE = re.compile(r"(?:const|let|var)\s+([\w$]+|\{[^}]*\})\s*=\s*(?:await\s+)?(?:require|import)\(\s*(?=['\"])")
_S_DYNAMIC = re.compile(r"\bimport\(\s*(?=['\"])")


def _past_angles(code: str, at: int) -> int:
    """The place behind the type parameters that begin at ``at``, if any do."""
    if code[at : at + 1] != "<":
        return at
    depth = 0
    for m in re.compile(r"=>|[<>;+/]|\b(?:function|class|const|let|var|return)\b").finditer(code, at):
        step = {"<": 1, ">": -1, "=>": 0}.get(m[0])
        if step is None:
            break
        depth += step
        if not depth:
            return m.end()
    return at


def _script_body(b: Bare, at: int) -> int | None:
    """The opening brace of a function whose parameters end before ``at``, behind its result's type; None if a semicolon or a line's end comes first."""
    code = b.text
    typed = re.compile(r"\s*:\s*").match(code, at)
    at = typed.end() if typed else re.compile(r"\s*").match(code, at).end()
    if not typed:
        return at if code[at : at + 1] == "{" else None
    while m := re.compile(r"[(\[{;\n]").search(code, at):
        if m[0] in ";\n":
            return None
        before = code[at : m.start()].rstrip()
        if m[0] == "{" and before and before[-1] not in "|&<,:":
            return m.start()
        at = b.end(m.start()) + 1  # brackets of the type itself
        if m[0] == "{" and (n := re.compile(r"[ \t]*(?=\{)").match(code, at)):
            return n.end()
        if m[0] != "{" and (n := re.compile(r"[ \t]*(?=\{)").match(code, at)):
            return n.end()
    return None


def _arrow(b: Bare, at: int) -> tuple[int, int] | None:
    """Body (start, end) of the function value that begins at ``at``: an arrow function or a function expression; None if it is something else."""
    code = b.text
    word = _S_VALUE.match(code, at)
    at = _past_angles(code, word.end())
    if code[at : at + 1] == "(":
        at = b.end(at) + 1
    elif m := re.compile(r"[\w$]+(?=\s*=>)").match(code, at):
        at = m.end()
    else:
        return None
    if "function" in word[0]:
        body = _script_body(b, at)
        return None if body is None else (body, b.end(body))
    m = re.compile(r"\s*(?::(?:[^=;{}\n]|=>(?=[^{}\n]*=>))+?)?\s*=>\s*").match(code, at)
    if not m:
        return None
    body = m.end()
    if code[body : body + 1] == "{":
        return body, b.end(body)
    at = body  # an expression: to the end of its statement
    while n := re.compile(r"[(\[{]|[)\]};,\n]|\Z").search(code, at):
        if n[0] and n[0] in "([{":
            at = b.end(n.start()) + 1
        else:
            return body, max(n.start() - 1, body)
    return body, body


def _script(language: str) -> Callable[[str, str], Parsed]:
    """JavaScript and TypeScript: types, functions at any depth, members of classes, function values of constants."""

    def parse(path: str, text: str) -> Parsed:
        out, b = Parsed(), bare(text, True)
        code = b.text
        package = path.rsplit("/", 1)[0] if "/" in path else ""
        everything = "module.exports" in code
        found: list[tuple[int, int, int, str, str, str, dict]] = []  # start, body, end, name, kind, signature, more
        names: set[int] = set()
        types: dict[int, tuple[str, str]] = {}  # body to name and kind

        def add(first: int, body: int, end: int, name: str, kind: str, words: str, **more) -> None:
            found.append((first, body, end, name, kind, b.head(first, body), {"exported": everything or "export" in words} | more))

        for m in _S_TYPE.finditer(code):
            first = m.start(1)
            if m[2] == "type":
                if re.compile(r"\s*=").match(code, _past_angles(code, m.end())):
                    stop = re.compile(r"[;\n]|\Z").search(code, m.end()).start()
                    add(first, stop, stop - 1, m[3], "type", m[1])
                continue
            at = _past_angles(code, m.end())
            body = code.find("{", at)
            if body < 0:
                continue
            heads = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", b.head(at, body)))
            bases = [x.strip() for g in re.split(r"\b(?:extends|implements)\b", heads)[1:] for x in g.split(",") if x.strip()]
            types[body] = m[3], m[2]
            add(first, body, b.end(body), m[3], m[2], m[1], bases=bases)
        for m in _S_FUNCTION.finditer(code):
            at = _past_angles(code, m.end())
            names.add(m.start(2))
            if code[at : at + 1] == "(" and (body := _script_body(b, b.end(at) + 1)) is not None and not re.search(r"[=(,:]\s*$", code[max(0, m.start() - 40) : m.start()]):
                add(m.start(), body, b.end(body), m[2], "function", m[1])
        taken = set()
        for m in _S_REQUIRE.finditer(code):
            plain, where = not m[1].startswith("{"), b.quoted(m.end())
            taken |= {m.start(1), m.end()}
            out.include(path, where, m[1] if plain else None, None if plain else _named(out, path, where, m[1].strip("{} \n"), ":"), where.startswith("."))
        for m in _S_BINDING.finditer(code):
            if value := _arrow(b, m.end()):
                add(m.start(1) if m[1] else m.start(2), *value, m[3], "function", m[1])
            elif b.inside(m.start(2)) == -1 and m.start(3) not in taken:
                add(m.start(1) if m[1] else m.start(2), m.start(3), m.start(3), m[3], "constant" if m[2] == "const" else "variable", m[1], signature="")
        visible = lambda m: "" if "private" in m[1] or m[2][0] == "#" else "export"
        for m in _S_MEMBER.finditer(code) if types else ():
            body = b.inside(m.start(2))
            if body not in types or types[body][1] == "enum" or m[2] in _SCRIPT_KEYWORDS - {"constructor"}:
                continue
            at = _past_angles(code, m.end())
            if code[at : at + 1] != "(":
                continue
            end = b.end(at) + 1
            start = _script_body(b, end)
            if start is not None:
                names.add(m.start(2))
                add(m.start(), start, b.end(start), m[2], "method", visible(m), receiver=types[body][0], parent=body)
            elif types[body][1] == "interface":
                stop = re.compile(r"[;,\n]|\Z").search(code, end).start()
                add(m.start(), stop, stop - 1, m[2], "method", "export", receiver=types[body][0], parent=body)
        for m in _S_FIELD.finditer(code) if types else ():
            body = b.inside(m.start(2))
            if types.get(body, ("", ""))[1] == "class" and (value := _arrow(b, m.end())):
                add(m.start(), *value, m[2], "method", visible(m), receiver=types[body][0], parent=body)
        bodies, around, ids = [], [], {}
        for first, body, end, name, kind, signature, more in sorted(found, key=lambda x: (x[0], -x[2])):
            while around and around[-1][0] < first:
                around.pop()
            parent = ids.get(more.pop("parent", None)) or (around[-1][1] if around else None)
            last = max(end, first)
            id = out.symbol(path, name, kind, b.line(first), b.line(last), language, **{"package": package, "parent": parent, "signature": signature} | more, code=b.rows(first, last) if kind not in ("constant", "variable", "type") else "")
            if kind in ("class", "interface"):
                ids[body] = id
            if kind in ("function", "method"):
                bodies.append((body, end, id))
                around.append((end, id))
        for m in _S_IMPORT.finditer(code):
            where, what = b.quoted(m.end()), m[1].strip()
            star = re.search(r"\*\s+as\s+([\w$]+)", what)
            inner = what.partition("{")[2].partition("}")[0]
            own = re.match(r"[\w$]+", what)
            kept = _named(out, path, where, inner, "as")
            out.include(path, where, star[1] if star else own[0] if own else None, [*kept, *(["*"] if star else [])], where.startswith("."))
        for m in _S_DYNAMIC.finditer(code):
            if m.end() not in taken:
                out.include(path, b.quoted(m.end()), None, None, b.quoted(m.end()).startswith("."))
        _own_calls(out, path, b, bodies, names, _SCRIPT_KEYWORDS)
        return _refer_by_text(out, path, code.split("\n"))

    return parse


def _patterns(language: str, rules: list[tuple[str, str]], imports: str | None = None) -> Callable[[str, str], Parsed]:
    """A parser of one symbol for each match of a pattern with one group, by kind, and of one import for each match of ``imports``."""

    def parse(path: str, text: str) -> Parsed:
        out = Parsed()
        for kind, pattern in rules:
            for m in re.finditer(pattern, text, re.M):
                line = text.count("\n", 0, m.start(1)) + 1
                out.symbol(path, m[1].strip(), kind, line, line, language, signature=m[0].strip()[:200])
        for m in re.finditer(imports, text, re.M) if imports else ():
            out.include(path, m[1])
        return out

    return parse


class _Page(HTMLParser):
    def __init__(self, path: str):
        super().__init__()
        self.path, self.out = path, Parsed()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        line = self.getpos()[0]
        a = {k: v or "" for k, v in attrs}
        if a.get("id"):
            self.out.symbol(self.path, a["id"], "element", line, line, "html", signature=f"<{tag}>")
        if tag == "form":
            self.out.symbol(self.path, a.get("name") or a.get("action") or "form", "form", line, line, "html")
        if "-" in tag:
            self.out.symbol(self.path, tag, "component", line, line, "html")
        for key in {"a": ["href"], "link": ["href"], "script": ["src"], "img": ["src"]}.get(tag, []):
            if a.get(key):
                self.out.include(self.path, a[key], None, None, "://" not in a[key])


def parse_html(path: str, text: str) -> Parsed:
    p = _Page(path)
    p.feed(text)
    p.close()
    return p.out


_MARKDOWN = _patterns("markdown", [("heading", r"^#{1,6}[ \t]+(.+?)[ \t#]*$"), ("code_block", r"^```(\w+)")], r"\]\(([^)\s]+)\)")
_SQL = _patterns("sql", [("table", r"(?i)\bcreate\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"), ("view", r"(?i)\bcreate\s+(?:or\s+replace\s+)?view\s+([\w.\"]+)"), ("column", r"(?i)^\s{2,}(\w+)\s+(?:int|bigint|varchar|text|double|decimal|date|timestamp|boolean|serial)\b")], r"(?i)\b(?:from|join|references)\s+([\w.\"]+)")
_CSS = _patterns("css", [("css_class", r"\.(-?[A-Za-z_][\w-]*)(?=[^{};]*\{)"), ("css_id", r"#([A-Za-z_][\w-]*)(?=[^{};]*\{)"), ("css_variable", r"(--[\w-]+)\s*:"), ("animation", r"@keyframes\s+([\w-]+)"), ("media_query", r"@media\s+([^{]+)\{")], r"@import\s+(?:url\()?['\"]?([^'\")\s;]+)")
_YAML = _patterns("yaml", [("key", r"^([A-Za-z_][\w.-]*)\s*:"), ("anchor", r"&([\w-]+)")])
_DOCKER = _patterns("dockerfile", [("stage", r"(?i)^FROM\s+\S+\s+AS\s+(\S+)"), ("variable", r"(?i)^(?:ENV|ARG)\s+(\w+)"), ("port", r"(?i)^EXPOSE\s+(\S+)")], r"(?i)^FROM\s+(\S+)")
_BASH = _patterns("bash", [("function", r"^\s*(?:function\s+)?([\w-]+)\s*\(\)\s*\{"), ("variable", r"^\s*(?:export\s+)?([A-Za-z_]\w*)="), ("alias", r"^\s*alias\s+([\w-]+)=")], r"^\s*(?:source|\.)\s+(\S+)")

#: Extension (or, without a dot, file name) to language and parser.
PARSERS: dict[str, tuple[str, Callable[[str, str], Parsed]]] = {
    ".go": ("go", parse_go), ".py": ("python", parse_python), ".js": ("javascript", _script("javascript")), ".jsx": ("javascript", _script("javascript")), ".mjs": ("javascript", _script("javascript")),
    ".ts": ("typescript", _script("typescript")), ".tsx": ("typescript", _script("typescript")), ".html": ("html", parse_html), ".htm": ("html", parse_html), ".css": ("css", _CSS), ".sql": ("sql", _SQL),
    ".yaml": ("yaml", _YAML), ".yml": ("yaml", _YAML), ".md": ("markdown", _MARKDOWN), ".sh": ("bash", _BASH), ".bash": ("bash", _BASH), "Dockerfile": ("dockerfile", _DOCKER),
}


def parse(path: str, text: str) -> Parsed:
    name = path.rsplit("/", 1)[-1]
    found = PARSERS.get(name) or PARSERS.get("." + name.rsplit(".", 1)[-1] if "." in name else name)
    if not found:
        return Parsed(errors=[f"no parser for {name}"])
    return found[1](path, text)


def _rows(what: str, columns: list[str]):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [r for p, t in zip(pdf["file_path"], pdf["text"], strict=True) for r in getattr(parse(p, t or ""), what)]
            yield pd.DataFrame(rows, columns=columns)

    return run


def _names(schema: str) -> list[str]:
    return re.findall(r"(?:^|, )(\w+) ", schema)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``files`` (``file_path, text``)."""
    return files.select("file_path", "text").mapInPandas(_rows("symbols", _names(SYMBOLS)), SYMBOLS)


def imports(files: DataFrame) -> DataFrame:
    return files.select("file_path", "text").mapInPandas(_rows("imports", _names(IMPORTS)), IMPORTS)


def call_sites(files: DataFrame) -> DataFrame:
    return files.select("file_path", "text").mapInPandas(_rows("calls", _names(CALLS)), CALLS)


def references(files: DataFrame) -> DataFrame:
    """``file_path, src, name, line, why``: names that symbols refer to beside their calls: as types, in type tests and in decorators."""
    return files.select("file_path", "text").mapInPandas(_rows("references", _names(REFERENCES)), REFERENCES)


def parse_errors(files: DataFrame) -> DataFrame:
    """``file_path, error`` of files that don't parse."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([(p, e) for p, t in zip(pdf["file_path"], pdf["text"], strict=True) for e in parse(p, t or "").errors], columns=["file_path", "error"])

    return files.select("file_path", "text").mapInPandas(run, "file_path string, error string")


def invalid_symbols(found: DataFrame) -> DataFrame:
    """``id, reason`` of symbols that are to be put aside."""
    reason = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "no name").when(F.coalesce(F.col("file_path"), F.lit("")) == "", "no file").when(F.col("start_line") < 1, "no line").when(F.col("end_line") < F.col("start_line"), "ends before it starts")
    return found.select("id", reason.alias("reason")).where("reason IS NOT NULL")
