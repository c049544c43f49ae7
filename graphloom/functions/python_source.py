"""What a Python file defines, imports and calls (X1-X6, X12), from its syntax tree.

Facts follow the concrete syntax: calls come in source order, outer before inner; a decorated definition is not a direct
child of its block, so it is no function of the file and its calls belong to the file; parameters with an annotation and
starred ones are not listed among a function's own, but annotated ones can carry taint. Text that is not valid Python has
no facts.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


class Source:
    """The text by byte offsets, as the syntax tree counts."""

    def __init__(self, text: str):
        self.rows = text.encode("utf-8", "replace").split(b"\n")

    def between(self, a: ast.AST) -> str:
        first, last = a.lineno - 1, a.end_lineno - 1
        if first == last:
            out = self.rows[first][a.col_offset : a.end_col_offset]
        else:
            out = b"\n".join([self.rows[first][a.col_offset :], *self.rows[first + 1 : last], self.rows[last][: a.end_col_offset]])
        return out.decode("utf-8", "replace")


def in_order(node: ast.AST) -> list[ast.AST]:
    """Children by where they stand in the text; helper nodes without a place come with what they hold."""
    out = []
    for child in ast.iter_child_nodes(node):
        out += [child] if hasattr(child, "lineno") else in_order(child)
    return sorted(out, key=lambda n: (n.lineno, n.col_offset))


def below(node: ast.AST, kind: type | tuple) -> Iterator[ast.AST]:
    """All nodes of a kind in a tree, each before what it holds. An explicit stack, so depth is no limit."""
    stack = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, kind):
            yield top
        stack.extend(reversed(in_order(top)))


def identifiers(node: ast.AST) -> set[str]:
    out = set()
    for n in ast.walk(node):
        if isinstance(n, ast.Name):
            out.add(n.id)
        elif isinstance(n, ast.Attribute):
            out.add(n.attr)
        elif isinstance(n, (ast.keyword, ast.arg)) and n.arg:
            out.add(n.arg)
    return out


def mixed_into_strings(call: ast.Call) -> list[str]:
    """Identifiers in the replacement fields of format strings, and in binary operations that hold a string."""
    out = set()
    for part in [*call.args, *call.keywords]:
        for n in ast.walk(part):
            if isinstance(n, ast.FormattedValue) or (isinstance(n, ast.BinOp) and any(isinstance(x, ast.JoinedStr) or (isinstance(x, ast.Constant) and isinstance(x.value, (str, bytes))) for x in ast.walk(n))):
                out |= identifiers(n)
    return sorted(out)


def parameters(f: ast.AST, annotated: bool) -> list[str]:
    """Names in order; annotated ones and starred ones with an annotation only on request, plain starred ones never."""
    a = f.args
    plain = [*a.posonlyargs, *a.args, *a.kwonlyargs]
    every = plain + ([x for x in (a.vararg, a.kwarg) if x is not None and x.annotation is not None] if annotated else [])
    return [p.arg for p in sorted(every, key=lambda p: (p.lineno, p.col_offset)) if annotated or p.annotation is None]


def bare_calls(tree: ast.AST) -> set[int]:
    """Calls that are statements of their own, also as parts of an unbracketed list of expressions."""
    out = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Expr):
            listed = n.value.elts if isinstance(n.value, ast.Tuple) and n.value.elts and (n.value.lineno, n.value.col_offset) == (n.value.elts[0].lineno, n.value.elts[0].col_offset) else [n.value]
            whole = (n.lineno, n.col_offset, n.end_lineno, n.end_col_offset)
            if len(listed) > 1 or whole == (n.value.lineno, n.value.col_offset, n.value.end_lineno, n.value.end_col_offset):
                out |= {id(c) for c in listed if isinstance(c, ast.Call)}
    return out


def owners(tree: ast.AST) -> dict[int, tuple[str, list[str]]]:
    """For each call, the definition it stands in (also a nested or decorated one): dotted name and parameters."""
    out: dict[int, tuple[str, list[str]]] = {}
    stack: list[tuple[ast.AST, tuple[str, ...], ast.AST | None, tuple[str, ...]]] = [(tree, (), None, ())]
    while stack:
        node, names, func, of = stack.pop()
        if isinstance(node, ast.Call) and func is not None:
            out[id(node)] = (".".join(of), parameters(func, True))
        if isinstance(node, (*DEFS, ast.ClassDef)):
            stack += [(d, names, func, of) for d in node.decorator_list]
            inner = (*names, node.name)
            own = (node, inner) if isinstance(node, DEFS) else (func, of)
            stack += [(c, inner, *own) for c in ast.iter_child_nodes(node) if c not in node.decorator_list]
        else:
            stack += [(c, names, func, of) for c in ast.iter_child_nodes(node)]
    return out


def function(f: ast.AST, prefix: str, src: Source) -> dict:
    body = ast.Module(f.body, [])
    return {
        "name": f.name,
        "qualified_name": f"{prefix}.{f.name}" if prefix else f.name,
        "line_start": f.lineno,
        "line_end": f.end_lineno,
        "params": parameters(f, False),
        "decorators": [src.between(d) for g in below(body, (*DEFS, ast.ClassDef)) for d in g.decorator_list],
        "calls": [{"name": src.between(c.func), "line": c.lineno} for c in below(body, ast.Call)],
    }


def direct(body: list[ast.stmt], kind: type | tuple) -> list[ast.AST]:
    return [n for n in body if isinstance(n, kind) and not n.decorator_list]


def imports(tree: ast.AST) -> list[dict]:
    """Plain imports first, then from-imports. A plain import names its first module only. Of a relative import the
    module is also a name; names with an alias come twice."""
    plain, of = [], []
    for n in below(tree, (ast.Import, ast.ImportFrom)):
        if isinstance(n, ast.Import):
            plain.append({"module": n.names[0].name, "names": [], "line": n.lineno, "is_relative": False})
        elif n.level or n.module != "__future__":
            names = [n.module] if n.level and n.module else []
            names += [a.name for a in n.names if a.name != "*"] + [a.name for a in n.names if a.asname]
            of.append({"module": "." * n.level + (n.module or ""), "names": names, "line": n.lineno, "is_relative": n.level > 0})
    return plain + of


def facts(text: str) -> dict:
    """imports, functions (methods after them, class by class), classes, calls of one file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {"imports": [], "functions": [], "classes": [], "calls": []}
    src = Source(text)
    functions = [function(f, "", src) for f in direct(tree.body, DEFS)]
    classes = []
    for c in direct(tree.body, ast.ClassDef):
        bases = [src.between(b) for b in c.bases if isinstance(b, (ast.Name, ast.Attribute))]
        classes.append({"name": c.name, "line_start": c.lineno, "line_end": c.end_lineno, "bases": bases})
        functions += [function(f, c.name, src) for f in direct(c.body, DEFS)]
    bare, owner = bare_calls(tree), owners(tree)
    calls = []
    for c in below(tree, ast.Call):
        name, params = owner.get(id(c), (None, []))
        calls.append({"name": src.between(c.func), "line": c.lineno, "bare": id(c) in bare, "mixed": mixed_into_strings(c), "inside": name, "inside_params": sorted(set(params))})
    return {"imports": imports(tree), "functions": functions, "classes": classes, "calls": calls}
