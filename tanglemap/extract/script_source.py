"""JavaScript and TypeScript source to nodes and edges, by a scanner of statements.

Comments and strings are blanked first, lines kept, so that patterns and brace matching
see code alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from tanglemap.extract.rows import Extract

REGEX = r"(?:(?<=[=(,:\[!&|?{};])|(?<=\breturn))\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
MASK = re.compile(r"/\*.*?\*/|//[^\n]*|" + REGEX + r"|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
IMPORT = re.compile(r"(?m)^\s*import\b[^;'\"]*['\"]([^'\"\n]+)['\"]")
REQUIRE = re.compile(r"\b(?:const|let)\b[^;=]*=\s*require\(\s*['\"]([^'\"\n]+)['\"]")
TOP = re.compile(r"(?m)^(?:export\s+)?(?:default\s+)?(?:(class)\s+([\w$]+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w$.]+))?|(?:async\s+)?(function)\s*\*?\s*([\w$]+)|(?:const|let)\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?=\(|[\w$]+\s*=>))")
METHOD = re.compile(r"(?m)^\s*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*([\w$]+)\s*\(")
BODY = re.compile(r"\s*(?::[^{;\n]+)?\{")
AFTER_ARROW_HEAD = re.compile(r"\s*(?::[^=\n]+)?=>")
CALL = re.compile(r"(?<![\w$.])(?:(this|[\w$]+)\.)?([\w$]+)\s*\(")
TYPE = re.compile(r"\s*([^=,;(){}\n]+)")
PARAMETER = re.compile(r"[(,]\s*(?:(?:public|private|protected|readonly)\s+)*(?:\.\.\.)?[\w$]+\s*\??\s*$")
DECLARED = re.compile(r"\b(?:const|let|var)\s+[\w$]+\s*$")
WORDS = frozenset("if for while switch catch return function new typeof await super import require constructor".split())


def _end(code: str, at: int) -> int:
    """Position after the brace that closes the first one from ``at``, or the line's end."""
    start, stop = code.find("{", at), code.find("\n", at)
    if start < 0:
        return stop if stop >= 0 else len(code)
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def _closed(code: str, at: int) -> int:
    """Position after the parenthesis that closes the one at ``at``, or -1."""
    depth = 0
    for m in re.compile(r"[()]").finditer(code, at):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return m.end()
    return -1


def _annotations(code: str, start: int, end: int) -> Iterator[re.Match]:
    """Types that parameters, declared variables and results are annotated with; the values of
    object literals are none."""
    stack: list[str] = []
    for m in re.compile(r"[(){}\[\]:]").finditer(code, start, end):
        if m[0] in "({[":
            stack.append(m[0])
        elif m[0] != ":":
            del stack[-1:]
        else:
            before = code[max(start, m.start() - 120) : m.start()]
            result = before.rstrip().endswith(")") and "?" not in before.rpartition("\n")[2]
            if DECLARED.search(before) or result or (stack[-1:] == ["("] and PARAMETER.search(before)):
                yield TYPE.match(code, m.end(), end)


def extract_script(path: str, text: str) -> Extract:
    """Top-level classes with their methods, functions and arrow functions; ES imports and
    ``require``; single bases; calls; types of annotations in functions and methods."""
    typed = path.endswith((".ts", ".tsx"))
    out = Extract(path, "typescript" if typed else "javascript")
    lead = re.match(r"\s*/\*\*(.*?)\*/", text, re.S)
    doc = " ".join(filter(None, (line.strip().lstrip("*").strip() for line in lead[1].split("\n")))) if lead else None
    out.node("File", path.rsplit("/", 1)[-1], 1, max(1, text.count("\n") + (not text.endswith("\n"))), docstring=doc)
    starts = [m.end() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(starts, at) + 1
    for pattern in (IMPORT, REQUIRE):
        for m in pattern.finditer(text):
            out.edge("IMPORTS_FROM", path, m[1], line(m.start(1)))
    code = MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)

    def inside(name: str, parent: str | None, start: int, end: int, types: bool) -> None:
        for m in CALL.finditer(code, code.find("{", start, end) + 1 or start, end):
            if m[2] not in WORDS and m[1] not in ("new",) and not re.search(r"\bnew\s+$", code[max(0, m.start() - 8) : m.start()]):
                out.call(f"{path}::{name}", parent, f"{m[1]}.{m[2]}" if m[1] else m[2], line(m.start()))
        if typed and types:
            for m in filter(None, _annotations(code, start, end)):
                for used in re.findall(r"\b[A-Z][\w$]*", m[1]):
                    out.uses(used, line(m.start(1)))

    at = 0
    for m in iter(lambda: TOP.search(code, at), None):
        if m[6] and code[m.end() : m.end() + 1] == "(":  # an arrow function only if an arrow follows its parameters
            closed = _closed(code, m.end())
            if closed < 0 or not AFTER_ARROW_HEAD.match(code, closed):
                at = m.end()
                continue
        if m[1]:
            end = _end(code, m.end())
        elif m[4]:
            end = _end(code, max(_closed(code, code.find("(", m.end())), m.end()))
        else:
            arrow = code.find("=>", max(m.end(), _closed(code, m.end()) if code[m.end() : m.end() + 1] == "(" else 0)) + 2
            end = _end(code, arrow) if re.compile(r"\s*\{").match(code, arrow) else (code.find("\n", arrow) + 1 or len(code) + 1) - 1
        first = text[m.start() : (text.find("\n", m.start()) + 1 or len(text) + 1) - 1].split("{")[0].strip()
        name, kind = m[2] or m[5] or m[6], "Class" if m[1] else "Function"
        out.node(kind, name, line(m.start()), line(end - 1), signature=first)
        out.edge("CONTAINS", path, f"{path}::{name}", line(m.start()))
        if m[1]:
            if m[3] and "." not in m[3]:
                out.edge("INHERITS", f"{path}::{name}", m[3], line(m.start()))
            inner = code.find("{", m.start()) + 1
            for f in iter(lambda: METHOD.search(code, inner, end), None):
                closed = _closed(code, f.end() - 1)
                opened = BODY.match(code, closed, end) if closed > 0 else None
                if not opened:  # a call or a declaration without a body
                    inner = f.end()
                    continue
                stop = _end(code, opened.end() - 1)
                begin = f.start(1)
                if f[1] not in WORDS or f[1] == "constructor":
                    out.node("Method", f[1], line(begin), line(stop - 1), name, text[begin : opened.end() - 1].strip())
                    out.edge("HAS_METHOD", f"{path}::{name}", f"{path}::{name}.{f[1]}", line(begin))
                    inside(f"{name}.{f[1]}", name, begin, stop, True)
                inner = stop
        else:
            inside(name, None, m.end(), end, bool(m[4]))
        at = max(end, m.end())
    out.resolve()
    return out
