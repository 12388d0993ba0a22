"""Units of Java source: classes, methods and constructors, and the blocks in them.

A tokenizer that knows comments, strings, text blocks and characters feeds a
structural parser: it tells declarations from statements and block statements
from class bodies, switch bodies and array initialisers, which is all that unit
extraction needs. It never fails on a file; unbalanced source ends early, and
depth is bounded by memory only.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from contextlib import contextmanager
from dataclasses import dataclass, field

from simweave.operators.units import LEAST_BLOCK_LINES

_TOKEN = re.compile(r'/\*.*?(?:\*/|\Z)|//[^\r\n]*|"""(?:\\.|[^\\])*?(?:"""|\Z)|"(?:\\.|[^"\\\r\n])*"?|\'(?:\\.|[^\'\\\r\n])*\'?|[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|[0-9][\w.]*|->|::|\.\.\.|\S', re.S)
_TYPES = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}
_STATEMENT = {"if", "for", "while", "catch", "synchronized", "try"}
_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non", "-"}


@dataclass
class Node:
    kind: str
    start: int
    end: int = 0
    name: str = ""
    parameters: int = 0
    body: Node | None = None
    children: list[Node] = field(default_factory=list)


class _Parser:
    def __init__(self, text: str):
        self.text = text
        self.comments: list[tuple[int, int]] = []
        self.toks: list[tuple[str, int, int]] = []
        for m in _TOKEN.finditer(text):
            if m[0].startswith(("//", "/*")):
                self.comments.append(m.span())
            else:
                self.toks.append((m[0], m.start(), m.end()))
        self.deepest = 0
        self.close = self._match()
        self.braces: dict[int, str] = {}

    def _match(self) -> dict[int, int]:
        pairs, stack = {}, []
        opens = {")": "(", "]": "[", "}": "{"}
        for i, (t, _, _) in enumerate(self.toks):
            if t in "([{" and len(t) == 1:
                stack.append(i)
                self.deepest = max(self.deepest, len(stack))
            elif t in opens:
                while stack and self.toks[stack[-1]][0] != opens[t]:
                    pairs[stack.pop()] = i
                if stack:
                    pairs[stack.pop()] = i
        for i in stack:
            pairs[i] = len(self.toks) - 1
        return pairs

    def tok(self, i: int) -> str:
        return self.toks[i][0] if 0 <= i < len(self.toks) else ""

    def at(self, i: int) -> int:
        return self.toks[i][1]

    def until(self, i: int) -> int:
        return self.toks[i][2]

    def type_at(self, i: int) -> str | None:
        """The kind of type declaration whose keyword is token i."""
        t = self.tok(i)
        if t == "class" and self.tok(i - 1) == ".":
            return None
        name = self.tok(i + 1)
        if t not in _TYPES or not re.match(r"[A-Za-z_$\u0080-￿]", name):
            return None
        if t == "record" and self.tok(i + 2) not in ("(", "<"):
            return None
        return "annotation_type_declaration" if t == "interface" and self.tok(i - 1) == "@" else _TYPES[t]

    def type_declaration(self, begin: int, i: int) -> tuple[Node, int]:
        """From token ``begin`` (the modifiers) with the keyword at i; returns the token after it."""
        node = Node(self.type_at(i) or "", self.at(begin), name=self.tok(i + 1))
        j = i + 2
        while j < len(self.toks) and self.tok(j) not in ("{", ";"):
            j = self.close[j] + 1 if self.tok(j) in ("(", "[") else j + 1
        if j >= len(self.toks) or self.tok(j) == ";":
            node.end = self.until(min(j, len(self.toks) - 1))
            return node, j + 1
        end = self.close[j]
        node.body = Node("class_body", self.at(j), self.until(end))
        start = j + 1
        if node.kind == "enum_declaration":
            start = self.enum_constants(node.body, start, end)
        node.body.children += self.members(start, end, node.name)
        node.end = self.until(end)
        node.children = [node.body]
        return node, end + 1

    def enum_constants(self, body: Node, i: int, end: int) -> int:
        while i < end and self.tok(i) != ";":
            if self.tok(i) == "{":
                body.children.append(Node("class_body", self.at(i), self.until(self.close[i]), children=self.members(i + 1, self.close[i], "")))
                i = self.close[i] + 1
            elif self.tok(i) == "(":
                body.children += self.code(i + 1, self.close[i])
                i = self.close[i] + 1
            else:
                i += 1
        return i + 1

    def members(self, i: int, end: int, owner: str) -> list[Node]:
        out = []
        while i < end:
            if self.tok(i) == ";":
                i += 1
                continue
            node, i = self.member(i, end, owner)
            out.append(node)
        return out

    def member(self, i: int, end: int, owner: str) -> tuple[Node, int]:
        begin = i
        while i < end:
            t = self.tok(i)
            if t == "@" and self.tok(i + 1) != "interface":
                i += 2
                while self.tok(i) == ".":
                    i += 2
                if self.tok(i) == "(":
                    i = self.close[i] + 1
            elif self.type_at(i):
                return self.type_declaration(begin, i)
            elif t in _MODIFIERS or t == "@":
                i += 1
            else:
                break
        if i >= end:
            return Node("other", self.at(begin), self.until(end - 1)), end
        if self.tok(i) == "{":
            stop = self.close[i]
            return Node("initializer", self.at(begin), self.until(stop), children=[Node("block", self.at(i), self.until(stop), children=self.code(i + 1, stop))]), stop + 1
        j, angle = i, 0
        while j < end:
            t = self.tok(j)
            angle += (t == "<") - (t == ">")
            if t in ("=", ";", "{") or (t == "(" and angle <= 0):
                break
            j = self.close[j] + 1 if t in ("(", "[") else j + 1
        t = self.tok(j)
        if t == "(" and j < end:
            name, stop = self.tok(j - 1), self.close[j]
            node = Node("constructor_declaration" if j - 1 == i and name == owner or self._generic_constructor(i, j, owner) else "method_declaration", self.at(begin), name=name, parameters=self.count_parameters(j + 1, stop))
            k = stop + 1
            while k < end and self.tok(k) not in ("{", ";"):
                k += 1
            if k < end and self.tok(k) == "{":
                last = self.close[k]
                kind = "constructor_body" if node.kind == "constructor_declaration" else "block"
                node.body = Node(kind, self.at(k), self.until(last), children=self.code(k + 1, last))
                node.children = [node.body]
                node.end = self.until(last)
                return node, last + 1
            node.end = self.until(min(k, end - 1))
            return node, k + 1
        if t == "{" and owner and self.tok(i) == owner:  # a record's compact constructor
            last = self.close[j]
            return Node("compact_constructor_declaration", self.at(begin), self.until(last), name=owner, children=[Node("block", self.at(j), self.until(last), children=self.code(j + 1, last))]), last + 1
        k = j
        while k < end and self.tok(k) != ";":
            k = self.close[k] + 1 if self.tok(k) in ("(", "[", "{") else k + 1
        return Node("field_declaration", self.at(begin), self.until(min(k, end - 1)), children=self.code(j, min(k, end))), k + 1

    def _generic_constructor(self, i: int, j: int, owner: str) -> bool:
        return self.tok(i) == "<" and self.tok(j - 1) == owner and self.tok(j - 2) == ">"

    def count_parameters(self, i: int, end: int) -> int:
        n, angle, seen, receiver = 0, 0, False, False
        while i <= end:
            t = self.tok(i) if i < end else ","
            if t == "," and angle == 0:
                n += seen and not receiver
                seen = receiver = False
            elif t in ("(", "["):
                i = self.close[i]
            else:
                angle += (t == "<") - (t == ">")
                seen, receiver = True, receiver or t == "this"
            i += 1
        return n

    def code(self, i: int, end: int) -> list[Node]:
        """Nodes of interest among statements or expressions."""
        out: list[Node] = []
        while i < end:
            t = self.tok(i)
            if self.type_at(i) and self.tok(i - 1) != ".":
                begin = i
                while self.tok(begin - 1) in _MODIFIERS:
                    begin -= 1
                node, i = self.type_declaration(begin, i)
                out.append(node)
                continue
            if t == "{":
                stop = self.close[i]
                kind = self.brace(i)
                if kind == "class_body":
                    out.append(Node(kind, self.at(i), self.until(stop), children=self.members(i + 1, stop, "")))
                else:
                    out.append(Node(kind, self.at(i), self.until(stop), children=self.code(i + 1, stop)))
                i = stop + 1
                continue
            i += 1
        return out

    def brace(self, i: int) -> str:
        """What the brace at token i opens: block, class_body, switch_block or array_initializer."""
        if i not in self.braces:
            self.braces[i] = self._brace(i)
        return self.braces[i]

    def _brace(self, i: int) -> str:
        before = self.tok(i - 1)
        if before in ("->", "else", "do", "try", "finally", ";", "}", ":"):
            return "block"
        if before == "{":
            return "block" if self.brace(i - 1) in ("block", "constructor") or self._statement_level(i - 1) else "array_initializer"
        if before in ("=", "]", ",", "("):
            return "array_initializer"
        if before == ")":
            j = i - 1
            depth = 0
            while j >= 0:
                depth += (self.tok(j) == ")") - (self.tok(j) == "(")
                if depth == 0:
                    break
                j -= 1
            head = self.tok(j - 1)
            if head == "switch":
                return "switch_block"
            if head in _STATEMENT:
                return "block"
            k, angle = j - 1, 0
            while k >= 0 and (angle or re.match(r"[\w$.<>,?@\u0080-￿]", self.tok(k))) and self.tok(k) not in ("new", "return"):
                angle += (self.tok(k) == ">") - (self.tok(k) == "<")
                k -= 1
            return "class_body" if self.tok(k) == "new" else "block"
        return "block"

    def _statement_level(self, i: int) -> bool:
        return self.tok(i - 1) == ")" or self.tok(i - 1) in ("->", "else", "do", "try", "finally", ";", "}", ":")

    def program(self) -> list[Node]:
        out, i, n = [], 0, len(self.toks)
        while i < n:
            t = self.tok(i)
            if t in ("package", "import"):
                while i < n and self.tok(i) != ";":
                    i += 1
                i += 1
            elif t in (";", "}"):
                i += 1
            else:
                node, i = self.member(i, n, "")
                out.append(node)
        return out


def strip_comments(code: str) -> str:
    """Block comments keep their line ends; ``//`` cuts the rest of a line, also inside a string."""
    bare = re.sub(r"/\*[\s\S]*?\*/", lambda m: re.sub(r"[^\n\r]", "", m[0]), code)
    return re.sub(r"//[^\n\r]*", "", bare)


def is_trivial(name: str, parameters: int) -> bool:
    last = name.split(".")[-1]
    return bool(re.match(r"(get|is)[A-Z]", last) and parameters == 0 or re.match(r"set[A-Z]", last) and parameters <= 1)


def _unit_id(kind: str, path: str, name: str, start: int, end: int) -> str:
    key = re.sub(r"\.[^./]+$", "", path.replace("\\", "/"))
    leaf = key.split("/")[-1]
    if kind == "class" or name == leaf:
        scoped = key
    elif name.startswith(leaf + "."):
        scoped = key + name[len(leaf) :]
    else:
        scoped = f"{key}.{name}"
    return f"{kind}:{scoped}:{start}-{end}"


def extract(path: str, text: str, min_lines: int = 3, min_block_lines: int = 5) -> list[dict]:
    """The units of one file, in the order of their beginnings; of equal ids the last stays, in the first one's place."""
    if not text.strip():
        return []
    parser = _Parser(text)
    with _depth(FRAMES * parser.deepest):
        return _units(parser, path, text, min_lines, min_block_lines)


#: Calls that one level of nesting may take.
FRAMES = 8


@contextmanager
def _depth(more: int):
    """Room for so many nested calls more: they live on the heap."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(before + more)
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def _units(parser: _Parser, path: str, text: str, min_lines: int, min_block_lines: int) -> list[dict]:
    line_starts = [0] + [m.end() for m in re.finditer("\n", text)]
    line = lambda pos: bisect_right(line_starts, pos) - 1
    units: dict[str, dict] = {}

    def span(node: Node) -> tuple[int, int]:
        return line(node.start), line(max(node.end - 1, node.start))

    def unit(kind: str, name: str, node: Node, code: str, parent: str | None) -> dict:
        first, last = span(node)
        return {"id": _unit_id(kind, path, name, first, last), "name": name, "file_path": path, "start_line": first, "end_line": last, "code": strip_comments(code), "unit_type": kind, "parent_id": parent}

    def short(node: Node, least: int) -> bool:
        first, last = span(node)
        return least > 0 and last - first < least

    def is_dto(node: Node) -> bool:
        fields = False
        inside = [c for c in parser.comments if node.body.start < c[0] < node.body.end]
        for c in node.body.children:
            inside = [x for x in inside if not c.start <= x[0] < c.end]
            if c.kind == "field_declaration":
                fields = True
            elif c.kind not in ("method_declaration", "constructor_declaration") or not is_trivial(c.name, c.parameters):
                return False
        return fields and not inside

    def blocks(node: Node, owner: dict) -> None:
        if node.kind == "block":
            if short(node, max(LEAST_BLOCK_LINES, min_block_lines)):
                return
            u = unit("block", owner["name"], node, text[node.start : node.end], owner["id"])
            units[u["id"]] = u
        for c in node.children:
            blocks(c, owner)

    def visit(node: Node, owner: dict | None) -> None:
        if node.kind == "class_declaration" and node.body:
            if is_dto(node):
                return
            code, at = "", node.start
            for c in node.body.children:
                if c.kind in ("method_declaration", "constructor_declaration") and c.body:
                    code += text[at : c.body.start] + " { }"
                    at = c.body.end
            u = unit("class", node.name, node, code + text[at : node.end], None)
            skipped = short(node, min_lines)
            if not skipped:
                units[u["id"]] = u
            for c in node.children:
                visit(c, None if skipped else u)
            return
        if node.kind in ("method_declaration", "constructor_declaration"):
            name = f"{owner['name']}.{node.name}" if owner else node.name
            if short(node, min_lines) or is_trivial(name, node.parameters):
                return
            u = unit("function", name, node, text[node.start : node.end], owner["id"] if owner else None)
            units[u["id"]] = u
            if node.body:
                blocks(node.body, u)
        for c in node.children:
            visit(c, owner)

    for node in parser.program():
        visit(node, None)
    return list(units.values())
