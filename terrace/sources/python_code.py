"""Python front end: source text to fact rows (files, imports, classes, functions, parameters, calls, ...)."""

from __future__ import annotations

import ast
import hashlib
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One wide relation; `tbl` says which table a row belongs to. `site` is the line:column of a call, for its arguments too;
#: `mode` of an argument is '' by position, =name by keyword, * or ** for a splat, of a parameter '', kwonly, * or **.
SCHEMA = "tbl string, path string, line long, end_line long, name string, qualname string, cls string, detail string, position long, site string, mode string"


class _Rows(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.rows, self.scope, self.cls = path, [], [], ""

    def add(self, tbl: str, node: ast.AST, name: str = "", detail: str = "", position: int = 0, qualname: str | None = None, site: str = "", mode: str = "") -> None:
        q = ".".join([*self.scope, name]) if qualname is None else qualname
        self.rows.append((tbl, self.path, getattr(node, "lineno", 0), getattr(node, "end_lineno", 0) or 0, name, q, self.cls, detail, position, site, mode))

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("imports", node, a.asname or a.name.split(".")[0], a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("imports", node, a.asname or a.name, "." * node.level + (node.module or "") + ":" + a.name, node.level)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("classes", node, node.name, ",".join(ast.unparse(b) for b in node.bases))
        self._decorated(node)
        self._around([*node.bases, *(k.value for k in node.keywords)])
        self._inside(node, node.name)

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.add("functions", node, node.name, ast.unparse(node.returns) if node.returns else "")
        self._decorated(node)
        a = node.args
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        every = [*((p, d, "") for p, d in zip(plain, defaults, strict=True)), *((p, d, "kwonly") for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True))]
        self._around([*a.defaults, *(d for d in a.kw_defaults if d)])
        every += [(p, None, mode) for p, mode in ((a.vararg, "*"), (a.kwarg, "**")) if p]
        for i, (p, d, mode) in enumerate(every):
            self.add("parameters", p, p.arg, ast.unparse(d) if d is not None else "", i, ".".join([*self.scope, node.name]), mode=mode)
        self._inside(node, "")

    visit_AsyncFunctionDef = visit_FunctionDef

    def _decorated(self, node) -> None:
        self._around(node.decorator_list)
        for i, d in enumerate(node.decorator_list):
            self.add("decorators", d, ast.unparse(d.func if isinstance(d, ast.Call) else d), ", ".join(map(ast.unparse, d.args)) if isinstance(d, ast.Call) else "", i, ".".join([*self.scope, node.name]))

    def _around(self, nodes: list[ast.expr]) -> None:
        """What is evaluated where the definition stands: decorators, bases and defaults."""
        for x in nodes:
            self.visit(x)

    def _inside(self, node, cls: str) -> None:
        self.scope.append(node.name)
        before, self.cls = self.cls, cls
        for child in node.body:
            self.visit(child)
        self.cls = before
        self.scope.pop()

    def visit_Call(self, node: ast.Call) -> None:
        site, scope, func = f"{node.lineno}:{node.col_offset}", ".".join(self.scope), ast.unparse(node.func)
        self.add("calls", node, func, str(len(node.args)), 0, scope, site)
        for i, x in enumerate(node.args):
            self.add("arguments", x, func, ast.unparse(x), i, scope, site, "*" if isinstance(x, ast.Starred) else "")
        for i, k in enumerate(node.keywords, len(node.args)):
            self.add("arguments", k, func, ast.unparse(k.value), i, scope, site, f"={k.arg}" if k.arg else "**")
        self.generic_visit(node)

    def visit_Return(self, node: ast.Return) -> None:
        self.add("returns", node, "", ast.unparse(node.value) if node.value else "", 0, ".".join(self.scope))
        self.generic_visit(node)

    def visit_Raise(self, node: ast.Raise) -> None:
        self.add("raises", node, "", ast.unparse(node.exc) if node.exc else "", 0, ".".join(self.scope))
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self.add("assignments" if self.scope else "consts", node, ast.unparse(t), ast.unparse(node.value))
        self.generic_visit(node)

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str):
            self.add("string_literals", node, "", node.value, 0, ".".join(self.scope))
        elif isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            self.add("number_literals", node, "", repr(node.value), 0, ".".join(self.scope))


def extract(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as problem:
        return [("files", path, 0, text.count("\n") + 1, path, "", "", f"error: {type(problem).__name__}", 0, "", "")]
    rows = _Rows(path)
    rows.visit(tree)
    return [("files", path, 0, text.count("\n") + 1, path, "", "", ast.get_docstring(tree) or "", 0, "", ""), *rows.rows]


def facts(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """Fact rows of every file; a file that does not parse gives its files row with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for pdf in frames:
            rows = [r for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in extract(p, t or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select(F.col(path).alias("path"), F.col(text).cast("string").alias("text")).mapInPandas(run, SCHEMA)


def table(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("tbl") == name).drop("tbl")


def source_lines(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """path, n_lines: lines that are neither blank nor only a comment."""
    lines = F.filter(F.split(F.col(text).cast("string"), "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    return files.select(path, F.size(lines).cast("long").alias("n_lines"))


class _Blank(ast.NodeTransformer):
    """Names, attributes, arguments and constants lose what they say, so that only the shape is left."""

    def visit_Name(self, node: ast.Name) -> ast.Name:
        return ast.Name("n", node.ctx)

    def visit_Attribute(self, node: ast.Attribute) -> ast.Attribute:
        return ast.Attribute(self.visit(node.value), "a", node.ctx)

    def visit_Constant(self, node: ast.Constant) -> ast.Constant:
        return ast.Constant(type(node.value).__name__)

    def visit_arg(self, node: ast.arg) -> ast.arg:
        return ast.arg("p")

    def visit_keyword(self, node: ast.keyword) -> ast.keyword:
        return ast.keyword("k" if node.arg else None, self.visit(node.value))


def statement_shapes(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """path, line, shape: a digest of each statement of a function's body, names and literals blanked; nothing for a file that does not parse."""

    def shapes(p: str, source: str) -> Iterator[tuple[str, int, str]]:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            return
        for f in ast.walk(tree):
            if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
                for s in f.body:
                    line = s.lineno
                    yield p, line, hashlib.sha256(ast.dump(_Blank().visit(s)).encode()).hexdigest()[:16]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([r for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in shapes(p, t or "")], columns=["path", "line", "shape"])

    return files.select(F.col(path).alias("path"), F.col(text).cast("string").alias("text")).mapInPandas(run, "path string, line long, shape string")


def launch_targets(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """path, name, target: the scripts that pyproject files (also gui scripts) start; a file that does not parse gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for p, t in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    project = tomllib.loads(t or "").get("project", {})
                except tomllib.TOMLDecodeError:
                    continue
                rows += [(p, name, target) for key in ("scripts", "gui-scripts") for name, target in project.get(key, {}).items()]
            yield pd.DataFrame(rows, columns=["path", "name", "target"])

    named = files.filter(F.substring_index(F.col(path), "/", -1) == "pyproject.toml")
    return named.select(F.col(path).alias("path"), F.col(text).cast("string").alias("text")).mapInPandas(run, "path string, name string, target string")
