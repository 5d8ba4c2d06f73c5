"""Java declarations without a grammar: a scanner that knows strings, comments and brackets.

It finds type, method and constructor declarations with their lines, fields, imports and calls. It resolves no types.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

# Words that open a type; words before "(" that are no call.
TYPE_WORDS = {"class", "interface", "enum", "record"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "try", "new", "super", "this", "assert", "throw", "do", "else", "case", "yield"}

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"{3}.*?(?:(?<!\\)\"{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<name>[^\W\d]\w*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>->|::|\.\.\.|.)""",
    re.DOTALL | re.VERBOSE,
)


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Declaration:
    kind: str
    symbol: str
    start: int
    body: int
    end: int


@dataclass
class Scan:
    source: str
    tokens: list[Token] = field(default_factory=list)
    declarations: list[Declaration] = field(default_factory=list)
    fields: dict[str, list[str]] = field(default_factory=dict)
    imports: list[str] = field(default_factory=list)
    calls: list[tuple[str, str]] = field(default_factory=list)


def tokens(source: str) -> list[Token]:
    return [Token(kind, m[0], *m.span()) for m in _TOKEN.finditer(source) if (kind := m.lastgroup) != "skip"]


def _matching(ts: list[Token]) -> dict[int, int]:
    """Places of closing brackets by those of the opening ones; what is never closed ends at the last token."""
    out, stack = {}, []
    pairs = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(ts):
        if t.kind == "mark" and t.text in "([{":
            stack.append(i)
        elif t.kind == "mark" and t.text in pairs:
            while stack:
                j = stack.pop()
                out[j] = i
                if ts[j].text == pairs[t.text]:
                    break
    return out | {j: len(ts) - 1 for j in stack}


class Scanner:
    def __init__(self, source: str):
        self.ts = tokens(source)
        self.out = Scan(source, self.ts)
        self.close = _matching(self.ts)
        self.members(0, len(self.ts), None, False)

    def text(self, i: int, j: int) -> str:
        return " ".join(self.out.source[self.ts[i].start : self.ts[j].end].split())

    def skip_annotation(self, i: int) -> int:
        """Behind an annotation at i."""
        i += 2
        while i + 1 < len(self.ts) and self.ts[i].text == ".":
            i += 2
        return self.close.get(i, i) + 1 if i < len(self.ts) and self.ts[i].text == "(" else i

    def members(self, i: int, end: int, owner: str | None, enum: bool) -> None:
        """Declarations among the tokens i..end of a type's body, or of the file."""
        ts = self.ts
        if enum:  # constants come first, up to a semicolon
            while i < end and ts[i].text != ";":
                if ts[i].text == "{":
                    self.calls_and_types(i + 1, self.close.get(i, end), owner, None)
                i = self.close.get(i, i) + 1 if ts[i].text in ("(", "{", "[") else i + 1
            i += 1
        while i < end:
            start = i
            if ts[i].text in (";", "}"):
                i += 1
                continue
            word, paren, assign, angle = None, None, None, 0
            while i < end:
                t = ts[i]
                if t.text == "@" and i + 1 < end and ts[i + 1].text != "interface":
                    i = self.skip_annotation(i)
                    continue
                if t.text == "@":
                    word = (i, "@interface")
                elif t.kind == "name" and t.text in TYPE_WORDS and word is None and paren is None and assign is None and i + 1 < end and ts[i + 1].kind == "name" and (t.text != "record" or self.opens_record(i, end)):
                    word = (i, t.text)
                elif t.text == "(" and assign is None and paren is None and word is None and ts[i - 1].kind == "name":
                    paren = i
                    i = self.close.get(i, end)
                elif t.text == "(":
                    i = self.close.get(i, end)
                elif t.text == "=" and paren is None:
                    assign = i
                elif t.text == "{" and assign is not None:
                    i = self.close.get(i, end)
                elif t.text in ("{", ";"):
                    break
                i += 1
            if i >= end and word is None and paren is None:
                return
            last = min(i, end - 1)
            if word is not None and word[1] == "@interface":
                i = self.close.get(last, last) + 1
            elif word is not None and ts[last].text == "{":
                i = self.type(start, word, last, end)
            elif word is None and paren is not None and assign is None and owner is not None or word is None and paren is not None and assign is None and ts[last].text == "{":
                i = self.method(start, paren, last, owner)
            elif ts[start].text == "import":
                named = [t.text for t in ts[start + 1 : last] if t.text not in ("static",)]
                self.out.imports.append("".join(named).removesuffix(".*"))
                i = last + 1
            elif ts[last].text == "{":  # an initialiser
                self.calls_and_types(last + 1, self.close.get(last, end), owner, None)
                i = self.close.get(last, end) + 1
            else:
                if owner is not None and ts[last].text == ";" and last > start:
                    self.out.fields.setdefault(owner, []).append(self.text(start, last))
                    self.calls_and_types(start, last, owner, None)
                i = last + 1

    def opens_record(self, i: int, end: int) -> bool:
        return i + 2 < end and self.ts[i + 2].text in ("(", "<")

    def type(self, start: int, word: tuple[int, str], brace: int, end: int) -> int:
        name, close = self.ts[word[0] + 1].text, self.close.get(brace, end)
        self.out.declarations.append(Declaration("class", name, start, brace, min(close, len(self.ts) - 1)))
        self.out.fields.setdefault(name, [])
        self.members(brace + 1, close, name, word[1] == "enum")
        return close + 1

    def method(self, start: int, paren: int, last: int, owner: str | None) -> int:
        name = self.ts[paren - 1].text
        symbol = f"{owner}.{name}" if owner else name
        if self.ts[last].text == "{":
            close = min(self.close.get(last, last), len(self.ts) - 1)
            self.out.declarations.append(Declaration("method", symbol, start, last, close))
            self.calls_and_types(last + 1, close, owner, symbol)
            return close + 1
        self.out.declarations.append(Declaration("method", symbol, start, last + 1, last))
        return last + 1

    def calls_and_types(self, i: int, end: int, owner: str | None, method: str | None) -> None:
        """Calls in a body, and types declared within it."""
        ts = self.ts
        while i < end:
            t = ts[i]
            if t.kind == "name" and t.text in TYPE_WORDS and i + 1 < end and ts[i + 1].kind == "name" and ts[i - 1].text != "." and (t.text != "record" or self.opens_record(i, end)):
                brace = next((j for j in range(i, end) if ts[j].text == "{"), None)
                if brace is not None:
                    start = i
                    while start > 0 and ts[start - 1].text in ("final", "abstract", "static", "private", "public"):
                        start -= 1
                    i = self.type(start, (i, t.text), brace, end)
                    continue
            if t.text == "new" and (k := self.anonymous(i, end)) is not None:  # its methods count for the enclosing type
                brace = k
                self.calls_and_types(i + 1, brace, owner, method)
                self.members(brace + 1, self.close.get(brace, end), owner, False)
                i = self.close.get(brace, end) + 1
                continue
            if method and t.kind == "name" and i + 1 < end and ts[i + 1].text == "(" and t.text not in NOT_CALLS and not self.created(i):
                self.out.calls.append((method, t.text))
            i += 1

    def created(self, i: int) -> bool:
        """Whether the name at i is that of a new object's type."""
        while i >= 2 and self.ts[i - 1].text == ".":
            i -= 2
        return i >= 1 and self.ts[i - 1].text == "new"

    def anonymous(self, i: int, end: int) -> int | None:
        """The opening brace of an anonymous class created at i."""
        j = i + 1
        while j < end and (self.ts[j].kind == "name" or self.ts[j].text in ".<>,?&@"):
            j += 1
        if j < end and self.ts[j].text == "(":
            j = self.close.get(j, end) + 1
            if j < end and self.ts[j].text == "{":
                return j
        return None


def scan(source: str) -> Scan:
    return Scanner(source or "").out


def fragments(source: str, found: Scan | None = None) -> list[dict]:
    """kind, symbol, signature, line_start, line_end, content of each declaration; a type's content is its header."""
    found = found or scan(source)
    ts, out = found.tokens, []
    for d in found.declarations:
        stop = ts[d.body - 1].end if d.body > d.start else ts[d.end].end
        signature = " ".join(source[ts[d.start].start : stop].split()).removesuffix(";").rstrip() if d.body > d.end else " ".join(source[ts[d.start].start : stop].split())
        a, b = ts[d.start].start, ts[d.end].end
        out.append({
            "kind": d.kind, "symbol": d.symbol, "signature": signature, "line_start": source.count("\n", 0, a) + 1, "line_end": source.count("\n", 0, b) + 1,
            "content": signature if d.kind == "class" else source[a:b],
        })
    return out


def fields(source: str, found: Scan | None = None) -> dict[str, list[str]]:
    return (found or scan(source)).fields


def edges(source: str, found: Scan | None = None) -> list[dict]:
    """imports of the first top-level type, calls of each method."""
    found = found or scan(source)
    types = [d.symbol for d in sorted(found.declarations, key=lambda d: d.start) if d.kind == "class"]
    out = [{"src_symbol": types[0], "dst_symbol": x, "kind": "imports"} for x in found.imports] if types else []
    return out + [{"src_symbol": a, "dst_symbol": b, "kind": "calls"} for a, b in found.calls]
