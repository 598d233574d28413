"""Structural search in Python texts: a code pattern with meta-variables ($X one expression, $$$X any number)."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ONE, _MANY = "_meta_one_", "_meta_many_"


def compile_pattern(pattern: str) -> ast.AST:
    text = re.sub(r"\$\$\$([A-Z_][A-Z0-9_]*)", rf"{_MANY}\1", pattern)
    text = re.sub(r"\$([A-Z_][A-Z0-9_]*)", rf"{_ONE}\1", text)
    body = ast.parse(text).body
    if len(body) != 1:
        raise ValueError("a pattern is one expression or statement")
    return body[0].value if isinstance(body[0], ast.Expr) else body[0]


def _name(node) -> str | None:
    if isinstance(node, ast.Expr):
        node = node.value
    return node.id if isinstance(node, ast.Name) else None


def _same(p, n, found: dict[str, str]) -> bool:
    name = _name(p)
    if name and name.startswith(_ONE):
        if not isinstance(n, ast.AST):
            return False
        got = ast.dump(n)
        return found.setdefault(name, got) == got
    if isinstance(p, ast.AST):
        return type(p) is type(n) and all(
            _same(v, getattr(n, k, None), found) for k, v in ast.iter_fields(p) if k not in ("ctx", "type_comment", "kind")
        )
    if isinstance(p, list):
        return isinstance(n, list) and _same_list(p, n, found)
    return p == n


def _same_list(p: list, n: list, found: dict[str, str]) -> bool:
    if not p:
        return not n
    name = _name(p[0])
    if name and name.startswith(_MANY):
        for k in range(len(n) + 1):
            trial = dict(found)
            if _same_list(p[1:], n[k:], trial):
                found.update(trial)
                return True
        return False
    return bool(n) and _same(p[0], n[0], found) and _same_list(p[1:], n[1:], found)


def matches(source: str | None, pattern: ast.AST) -> list[tuple[int, int, str]]:
    """(line, column, text) of the matching nodes in order; what doesn't parse has none."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    hits = [n for n in ast.walk(tree) if type(n) is type(pattern) and _same(pattern, n, {})]
    return sorted((n.lineno, n.col_offset + 1, ast.get_source_segment(source, n) or "") for n in hits)


def search(files: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(path, line, column, match, total) of a pattern's matches in files (path, text), with each file's total."""
    compile_pattern(pattern)
    kind = T.ArrayType(
        T.StructType([T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("match", T.StringType())])
    )

    @F.pandas_udf(kind)
    def scan(texts):
        p = compile_pattern(pattern)
        return texts.map(lambda t: [dict(zip(("line", "column", "match"), m, strict=True)) for m in matches(t, p)])

    found = files.select("path", scan(text).alias("m")).withColumn("total", F.size("m"))
    return found.select("path", F.explode("m").alias("m"), "total").select("path", "m.line", "m.column", "m.match", "total")
