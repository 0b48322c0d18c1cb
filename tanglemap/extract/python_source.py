"""Python source to nodes and edges, by the standard library's syntax tree.

A file the parser rejects gives its file node with ``error`` set, so that one bad file
neither stops a job nor goes unseen.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from tanglemap.extract.rows import Extract


def _docstring(source: list[str], node: ast.AST) -> str | None:
    """The first statement, if it is a string without a prefix."""
    first = node.body[0] if getattr(node, "body", None) else None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        if source[first.lineno - 1].encode()[first.col_offset : first.col_offset + 1] not in (b'"', b"'"):
            return None
        return first.value.value.strip() or None
    return None


def _signature(source: list[str], node: ast.AST) -> str:
    depth, out = 0, []
    for char in "\n".join(source[node.lineno - 1 : node.end_lineno]):
        if char in "([":
            depth += 1
        elif char in ")]":
            depth -= 1
        elif char == ":" and depth == 0:
            return "".join(out).strip()
        out.append(char)
    return source[node.lineno - 1].strip()


def _types(annotation: ast.AST | None) -> Iterator[tuple[str, int]]:
    for node in ast.walk(annotation) if annotation is not None else ():
        name = node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""
        if name[:1].isupper():
            yield name, node.lineno


def _callee(call: ast.Call) -> str | None:
    f = call.func
    if isinstance(f, ast.Name):
        return f.id
    if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
        return f"{f.value.id}.{f.attr}"
    return None


def extract_python(path: str, text: str) -> Extract:
    """Classes, functions and methods that are direct children of the module or of a class;
    imports anywhere, one edge a statement; bases, calls and type uses of each definition."""
    out = Extract(path, "python")
    source = text.split("\n")
    out.node("File", path.rsplit("/", 1)[-1], 1, max(1, text.count("\n") + (not text.endswith("\n"))))
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        out.error = f"{type(error).__name__}: {error}"
        return out
    out.rows[0]["docstring"] = _docstring(source, tree)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out.edge("IMPORTS_FROM", path, node.names[0].name, node.lineno)
        elif isinstance(node, ast.ImportFrom):
            out.edge("IMPORTS_FROM", path, node.module or node.names[0].name, node.lineno)

    def functions(node, parent: str | None) -> None:
        name = f"{parent}.{node.name}" if parent else node.name
        kind = "Method" if parent else "Function"
        out.node(kind, node.name, node.lineno, node.end_lineno, parent, _signature(source, node), _docstring(source, node), [f"@{ast.get_source_segment(text, d)}" for d in node.decorator_list])
        out.edge("HAS_METHOD" if parent else "CONTAINS", f"{path}::{parent}" if parent else path, f"{path}::{name}", node.lineno)
        args = node.args
        annotated = [node.returns, *[a.annotation for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg] if a is not None]]
        for annotation in annotated:
            for used, line in _types(annotation):
                out.uses(used, line)
        for statement in node.body:
            for call in ast.walk(statement):
                if isinstance(call, ast.Call) and (callee := _callee(call)):
                    out.call(f"{path}::{name}", parent, callee, call.lineno)

    def classes(node: ast.ClassDef, parent: str | None) -> None:
        out.node("Class", node.name, node.lineno, node.end_lineno, parent, _signature(source, node), _docstring(source, node), [f"@{ast.get_source_segment(text, d)}" for d in node.decorator_list])
        own = f"{path}::{parent}.{node.name}" if parent else f"{path}::{node.name}"
        out.edge("CONTAINS", path, own, node.lineno)
        for base in node.bases:
            if isinstance(base, ast.Name | ast.Attribute):
                out.edge("INHERITS", own, ast.unparse(base), base.lineno)
        body(node.body, node.name)

    def body(nodes: list[ast.stmt], parent: str | None) -> None:
        for node in nodes:
            if isinstance(node, ast.ClassDef):
                classes(node, parent)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                functions(node, parent)

    body(tree.body, None)
    out.resolve()
    return out
