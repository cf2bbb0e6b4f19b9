"""Texts of brace languages without their strings and comments, and where brackets close.

A :class:`Bare` text has the length of its source: strings, comments, templates and regular expressions
are blanked out, line ends and what stands in a template's ``${}`` stay, so that patterns and bracket
counts never see a brace or a word that isn't code.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_GO_HIDDEN = re.compile(rf"{_COMMENTS}|`[^`]*(?:`|\Z)|{_STRINGS}", re.S)
_SCRIPT_TOKEN = re.compile(rf"(?P<hidden>{_COMMENTS}|{_STRINGS})|(?P<regex>/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*)|[\w$]+|\S", re.S)
_TEMPLATE = re.compile(r"((?:\\.|\$(?!\{)|[^`\\$]|\\\Z)*+)(`|\$\{|\Z)", re.S)
_BEFORE_REGEX = frozenset("return typeof case in of delete void instanceof new do else await yield".split())
_CLOSING = {")": "(", "]": "[", "}": "{"}


@dataclass
class Bare:
    source: str
    text: str
    close: dict[int, int]
    _at: list[int]
    _inner: list[int]
    _lines: list[int]

    def inside(self, at: int) -> int:
        """Where the innermost bracket around ``at`` opens, -1 for none."""
        k = bisect_right(self._at, at - 1)
        return self._inner[k - 1] if k else -1

    def end(self, at: int) -> int:
        """Where the bracket at ``at`` closes; the text's last place if it doesn't."""
        return self.close.get(at, max(len(self.text) - 1, 0))

    def line(self, at: int) -> int:
        return bisect_right(self._lines, at)

    def quoted(self, at: int) -> str:
        """The string whose quote stands at ``at`` in the source."""
        stop = self.source.find(self.source[at], at + 1)
        return self.source[at + 1 : stop if stop >= 0 else len(self.source)]

    def rows(self, first: int, last: int) -> str:
        """The source's lines from the one of place ``first`` to that of ``last``."""
        stop = self.source.find("\n", last)
        return self.source[self._lines[self.line(first) - 1] : stop if stop >= 0 else len(self.source)]

    def head(self, first: int, last: int) -> str:
        """Code between two places on one line."""
        flat = " ".join(self.text[first:last].split())
        return re.sub(r",?\s+([)\]])", r"\1", re.sub(r"([(\[])\s+", r"\1", flat))


def _go_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _GO_HIDDEN.finditer(text)]


def _script_spans(text: str) -> list[tuple[int, int]]:
    """Spans to hide; a slash begins a regular expression unless a value stands before it."""
    spans: list[tuple[int, int]] = []
    back: list[int] = []  # depths at which a template goes on
    depth, at, before = 0, 0, ""
    template = False
    while True:
        if template:
            m = _TEMPLATE.match(text, at)
            spans.append((at, m.end(1)))
            at, template = m.end(), False
            if m[2] == "${":
                back.append(depth)
                depth += 1
                before = "{"
            else:
                before = ")"
            continue
        m = _SCRIPT_TOKEN.search(text, at)
        if not m:
            return spans
        token, at = m[0], m.end()
        if m["hidden"]:
            spans.append(m.span())
            before = before if token[0] == "/" else ")"
            continue
        if m["regex"]:
            value = before and (before in ")]}<" or before not in _BEFORE_REGEX and (before[0].isalnum() or before[0] in "_$"))
            if value:
                at = m.start() + 1
                before = "/"
            else:
                spans.append(m.span())
                before = ")"
            continue
        if token == "`":
            template = True
        elif token == "{":
            depth += 1
        elif token == "}":
            depth -= 1
            if back and depth <= back[-1]:
                depth = back.pop()
                template = True
        before = token


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    out, last = [], 0
    for a, b in spans:
        hidden = re.sub(r"[^\n]", " ", text[a:b])
        if b - a > 1 and text[a] in "\"'":  # quotes mark where strings are
            hidden = text[a] + hidden[1:-1] + text[b - 1]
        out += [text[last:a], hidden]
        last = b
    return "".join([*out, text[last:]])


def bare(text: str, script: bool = False) -> Bare:
    """``text`` of Go (or of JavaScript and TypeScript, if ``script``) without strings and comments. Linear in the text."""
    code = _blank(text, _script_spans(text) if script else _go_spans(text))
    close: dict[int, int] = {}
    open_: list[int] = []
    count = {"(": 0, "[": 0, "{": 0}
    at, inner = [], []
    for m in re.finditer(r"[()\[\]{}]", code):
        c = m[0]
        if c in count:
            open_.append(m.start())
            count[c] += 1
        else:
            if not count[_CLOSING[c]]:
                continue  # closes nothing
            while True:  # what was left open within ends here too
                last = open_.pop()
                count[code[last]] -= 1
                close[last] = m.start()
                if code[last] == _CLOSING[c]:
                    break
        at.append(m.start())
        inner.append(open_[-1] if open_ else -1)
    return Bare(text, code, close, at, inner, [0, *(m.end() for m in re.finditer("\n", text))])
