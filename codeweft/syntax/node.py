"""Syntax nodes, tokens and what the parsers share."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from ..functions.lexicon import KIND_PATTERNS

#: Nested syntax beyond this is kept as flat leaves, so that no text exhausts the stack.
MAX_DEPTH = 120


class Source:
    """A text with its line starts."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [0, *[m.end() for m in re.finditer("\n", text)]]

    def point(self, at: int) -> tuple[int, int]:
        """Row and column of a position, from 0; columns in UTF-8 bytes."""
        row = bisect_right(self.lines, at) - 1
        part = self.text[self.lines[row] : at]
        return row, len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass"))


class Node:
    """A syntax node: a type, a range of the source, children, and children by field name."""

    __slots__ = ("type", "start", "end", "kids", "fields", "parent", "source")

    def __init__(self, kind: str, start: int, end: int, source: Source, kids: list[Node] | None = None, fields: dict | None = None):
        self.type, self.start, self.end, self.source = kind, start, end, source
        self.kids = kids or []
        self.fields = fields or {}
        self.parent: Node | None = None
        for k in self.kids:
            k.parent = self

    @property
    def text(self) -> str:
        return self.source.text[self.start : self.end]

    @property
    def row(self) -> int:
        return self.source.point(self.start)[0]

    def get(self, name: str) -> Node | None:
        return self.fields.get(name)

    def walk(self) -> Iterator[Node]:
        """This node and all below, parents first, in source order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def of(self, *types: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.type in types)


class Token:
    __slots__ = ("kind", "text", "start", "end", "line")

    def __init__(self, kind: str, text: str, start: int, end: int, line: bool):
        #: line: a line ends between the token before and this one.
        self.kind, self.text, self.start, self.end, self.line = kind, text, start, end, line


def scan(text: str, language: str) -> list[Token]:
    """All tokens of a text, white space and comments included; their texts join to the text."""
    out, line = [], False
    regex_after = language == "javascript"
    last = ""
    kinds = KIND_PATTERNS[language]
    at, n = 0, len(text)
    while at < n:
        m = kinds.match(text, at)
        kind = m.lastgroup
        if kind == "regex" and regex_after and not _regex_may_follow(last):
            m = kinds.match(text, at, at + 1)
            kind = "op"
        tok = m.group()
        out.append(Token(kind, tok, at, m.end(), line))
        if kind == "nl" or kind == "comment" and "\n" in tok:
            line = True
        elif kind not in ("ws", "comment"):
            line, last = False, tok
        at = m.end()
    return out


def _regex_may_follow(last: str) -> bool:
    """Whether a slash after this token opens a regular expression."""
    return not last or last[-1] in "(,=:[!&|?{};+-*%<>~^" or last in ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield")


class Parser:
    """A cursor over the tokens that aren't white space or comments."""

    language = ""
    #: Types of leaves of literal tokens, by kind.
    string_type = "string"

    def __init__(self, text: str):
        self.source = Source(text)
        self.toks = [t for t in scan(text, self.language) if t.kind not in ("ws", "comment", "nl")]
        self.i = 0
        self.depth = 0

    # -- cursor ---------------------------------------------------------------
    @property
    def tok(self) -> Token | None:
        return self.toks[self.i] if self.i < len(self.toks) else None

    @property
    def text(self) -> str:
        return self.toks[self.i].text if self.i < len(self.toks) else ""

    @property
    def kind(self) -> str:
        return self.toks[self.i].kind if self.i < len(self.toks) else ""

    @property
    def line(self) -> bool:
        """Whether a line ends before the next token."""
        return self.i >= len(self.toks) or self.toks[self.i].line

    def ahead(self, n: int = 1) -> str:
        return self.toks[self.i + n].text if self.i + n < len(self.toks) else ""

    def ahead_kind(self, n: int = 1) -> str:
        return self.toks[self.i + n].kind if self.i + n < len(self.toks) else ""

    def at(self, *texts: str) -> bool:
        return self.text in texts and self.kind in ("op", "name")

    def skip(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def leaf(self, kind: str | None = None) -> Node:
        """The next token as a leaf; an empty one at the end of the text."""
        if self.i >= len(self.toks):
            end = len(self.source.text)
            return Node("ERROR", end, end, self.source)
        t = self.toks[self.i]
        self.i += 1
        return Node(kind or self.leaf_type(t), t.start, t.end, self.source)

    def leaf_type(self, t: Token) -> str:
        return {"name": "identifier", "string": self.string_type}.get(t.kind, t.text)

    def begin(self) -> int:
        return self.toks[self.i].start if self.i < len(self.toks) else len(self.source.text)

    def finish(self) -> int:
        return self.toks[self.i - 1].end if self.i else 0

    def make(self, kind: str, start: int, kids: list, **fields) -> Node:
        kids = [k for k in kids if k is not None]
        end = max([self.finish() if self.i else start, start, *[k.end for k in kids[-1:]]])
        return Node(kind, start, end, self.source, kids, {k: v for k, v in fields.items() if v is not None})

    def flat(self, kind: str, close: str) -> Node:
        """Leaves up to the bracket that closes the one at the cursor."""
        start, kids, depth = self.begin(), [], 0
        while self.tok:
            if self.text in ("(", "[", "{"):
                depth += 1
            elif self.text in (")", "]", "}"):
                depth -= 1
            kids.append(self.leaf())
            if depth <= 0:
                break
        return self.make(kind, start, kids)

    def deep(self) -> bool:
        return self.depth > MAX_DEPTH

    # -- expressions ------------------------------------------------------------
    #: operator -> binding strength
    binary: dict[str, int] = {}

    def binary_type(self, op: str) -> str:
        return "binary_expression"

    def prefix(self) -> Node:
        raise NotImplementedError

    def postfix(self, left: Node) -> Node | None:
        raise NotImplementedError

    def operator(self) -> str:
        """The binary operator at the cursor, or nothing."""
        return self.text if self.kind in ("op", "name") and self.text in self.binary else ""

    def expression(self, least: int = 0) -> Node:
        self.depth += 1
        try:
            if self.deep():
                return self.flat("ERROR", "") if self.text in ("(", "[", "{") else self.leaf()
            left = self.prefix()
            while (more := self.postfix(left)) is not None:
                left = more
            while (op := self.operator()) and self.binary[op] > least:
                strength = self.binary[op]
                start = left.start
                sign = self.take_operator(op)
                right = self.expression(strength)
                left = self.make(self.binary_type(op), start, [left, *sign, right], left=left, right=right)
            return left
        finally:
            self.depth -= 1

    def take_operator(self, op: str) -> list[Node]:
        return [self.leaf(op)]

    def listed(self, close: str, item, *between: str) -> list[Node]:
        """Items up to a closing bracket, which is taken; separators are dropped."""
        out = []
        while self.tok and not self.at(close):
            before = self.i
            if self.skip(",", *between):
                continue
            out.append(item())
            if self.i == before:
                out.append(self.leaf())
        self.skip(close)
        return out
