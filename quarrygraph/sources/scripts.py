"""Which files Python scripts read, write and save figures to, found in their syntax trees, a batch of scripts at a time."""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Calls that read and write, and names of the argument that holds the path.
READS = ["read_csv", "read_excel", "read_parquet", "read_stata", "read_json", "loadtxt"]
WRITES = ["to_csv", "to_excel", "to_parquet", "savefig"]
PATH_ARGUMENTS = ["path", "filepath", "fname"]
SCHEMA = "path string, line_no int, callee string, kind string, target string, folded_from string"


def bound(tree: ast.AST) -> Counter:
    """How often each name is bound, in whatever way and scope; a star import may bind any name."""
    n: Counter = Counter()
    for x in ast.walk(tree):
        if isinstance(x, ast.Name) and not isinstance(x.ctx, ast.Load):
            n[x.id] += 1
        elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            n[x.name] += 1
        elif isinstance(x, ast.arg):
            n[x.arg] += 1
        elif isinstance(x, ast.alias):
            n["*" if x.name == "*" else (x.asname or x.name.split(".")[0])] += 1
        elif isinstance(x, ast.Global | ast.Nonlocal):
            n.update(x.names)
        elif isinstance(x, ast.ExceptHandler | ast.MatchAs | ast.MatchStar) and x.name:
            n[x.name] += 1
        elif isinstance(x, ast.MatchMapping) and x.rest:
            n[x.rest] += 1
    return n


def fold(x: ast.AST, known: dict[str, str]) -> str | None:
    """The text that an expression of literals, known names, +, plain f-strings and os.path.join stands for; None for any other."""
    if isinstance(x, ast.Constant):
        return x.value if isinstance(x.value, str) else None
    if isinstance(x, ast.Name):
        return known.get(x.id)
    parts, glue = None, "".join
    if isinstance(x, ast.BinOp) and isinstance(x.op, ast.Add):
        parts = [x.left, x.right]
    elif isinstance(x, ast.JoinedStr):
        if any(isinstance(v, ast.FormattedValue) and (v.conversion != -1 or v.format_spec) for v in x.values):
            return None
        parts = [v.value if isinstance(v, ast.FormattedValue) else v for v in x.values]
    elif isinstance(x, ast.Call) and ast.unparse(x.func) == "os.path.join" and x.args and not x.keywords:
        import posixpath

        parts, glue = x.args, lambda p: posixpath.join(*p)
    folded = [fold(p, known) for p in parts] if parts else [None]
    return None if any(p is None for p in folded) else glue(folded)


def constants(tree: ast.Module) -> dict[str, str]:
    """Names that a top-level statement sets to a text, and that nothing else in the file binds; each may use those above it."""
    n, known = bound(tree), {}
    if n["*"]:
        return {}
    for s in tree.body:
        target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) and s.value else None
        if isinstance(target, ast.Name) and n[target.id] == 1 and (v := fold(s.value, known)) is not None:
            known[target.id] = v
    return known


def calls(text: str | None) -> list[tuple[int, str, str, str, str | None]]:
    """(line, callee, kind, target, source text if it was folded) in a script; none in one that is no Python."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    known, out = constants(tree), []
    for c in ast.walk(tree):
        if not isinstance(c, ast.Call):
            continue
        name = c.func.attr if isinstance(c.func, ast.Attribute) else c.func.id if isinstance(c.func, ast.Name) else ""
        kind = "reads" if name in READS else "writes" if name in WRITES else None
        if name == "open" and isinstance(c.func, ast.Name):
            mode = c.args[1] if len(c.args) > 1 else next((k.value for k in c.keywords if k.arg == "mode"), ast.Constant("r"))
            first = mode.value[:1] if isinstance(mode, ast.Constant) and isinstance(mode.value, str) else ""
            kind = {"r": "reads", "w": "writes"}.get(first)
        if kind is None:
            continue
        where = c.args[0] if c.args else next((k.value for k in c.keywords if k.arg in PATH_ARGUMENTS or (name == "open" and k.arg == "file")), None)
        target = fold(where, known) if where is not None else None
        if target:
            out.append((c.lineno, name, kind, target, None if isinstance(where, ast.Constant) else ast.unparse(where)))
    return sorted(out, key=lambda r: r[:4])


def uses(scripts: DataFrame) -> DataFrame:
    """(path, line_no, callee, kind, target, folded_from) of scripts (path, text). Targets are as written; the caller resolves them."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            yield pd.DataFrame([(p, *c) for p, t in zip(b["path"], b["text"], strict=True) for c in calls(t)], columns=columns)

    return scripts.select("path", "text").mapInPandas(scan, SCHEMA)
