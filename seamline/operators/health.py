"""Corpus health: size metrics, markers, duplicates, complexity and the digest of a run."""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def metrics(docs: DataFrame, group: str = "lang") -> DataFrame:
    """(group, n_files, n_lines, n_chars), with a total row of null group."""
    rows = docs.select(group, X.line_count(F.col("text")).alias("n"), F.length("text").alias("c"))
    return rows.rollup(group).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_lines"), F.sum("c").alias("n_chars")
    )


def largest(docs: DataFrame, k: int = 20, key: str = "doc_id") -> DataFrame:
    return docs.select(key, X.line_count(F.col("text")).alias("n_lines")).orderBy(F.desc("n_lines"), key).limit(k)


def marker_lines(docs: DataFrame, markers: tuple[str, ...] = X.MARKERS, key: str = "doc_id") -> DataFrame:
    """(key, line_no, marker, text): at most one marker a line, its text cut at 200 characters."""
    any_ = F.lit(False)
    for m in markers:
        any_ = any_ | F.contains("text", F.lit(m))
    rows = X.lines(docs.where(any_), key).withColumn("marker", X.marker_of(F.col("line"), markers))
    return rows.where("marker is not null").select(key, "line_no", "marker", X.marker_text(F.col("line"), F.col("marker")).alias("text"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(digest, n, first) of texts that occur more than once. Members aren't gathered, so a huge group is one row."""
    return (
        docs.groupBy(F.sha2("text", 256).alias("digest"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
        .where("n > 1")
    )


def duplicate_lines(docs: DataFrame, least: int = 20, key: str = "doc_id") -> DataFrame:
    """(line_digest, n_lines, n_docs) of normalised lines of ``least`` characters and more in several documents."""
    norm = F.trim(F.regexp_replace(X.mask_digits(X.ascii_fold(F.col("line"))), r"\s+", " "))
    rows = X.lines(docs, key).select(key, norm.alias("line")).where(F.length("line") >= least)
    per_doc = rows.groupBy(F.md5("line").alias("line_digest"), key).agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("line_digest").agg(F.sum("c").alias("n_lines"), F.count(F.lit(1)).alias("n_docs")).where("n_docs > 1")


def duplicate_fragments(docs: DataFrame, size: int = 3, marker: str = "licensed", key: str = "doc_id") -> DataFrame:
    """(digest, n, n_docs, suppressed) of runs of ``size`` lines that occur more than once.

    Letters are folded, quoted strings and numbers replaced, white space collapsed, blank lines skipped; runs overlap. A
    fragment with the marker is a known text that repeats by intent: it is reported as suppressed.
    """
    line = X.mask_digits(X.ascii_fold(F.regexp_replace("line", '"[^"]*"', "#")))
    rows = X.lines(docs, key).select(key, "line_no", F.trim(F.regexp_replace(line, r"\s+", " ")).alias("line")).where("line != ''")
    w = Window.partitionBy(key).orderBy("line_no")
    parts = [F.lead("line", i).over(w) for i in range(size)]
    runs = rows.select(key, F.when(parts[-1].isNotNull(), F.concat_ws("\n", *parts)).alias("run")).where("run is not null")
    per_doc = runs.groupBy(F.md5("run").alias("digest"), key).agg(F.count(F.lit(1)).alias("c"), F.max(F.contains("run", F.lit(marker))).alias("m"))
    found = per_doc.groupBy("digest").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.max("m").alias("suppressed"))
    return found.where("n > 1")


def per_category(rows: DataFrame, k: int = 5, order: list[Column] | None = None) -> DataFrame:
    """The first k rows of each category, with its exact total. Rows are cut to k before they are shuffled."""
    w = Window.partitionBy("category").orderBy(*(order or [F.col("item")]))
    first = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    total = rows.groupBy(F.col("category").alias("c")).agg(F.count(F.lit(1)).alias("total"))
    return first.join(total, F.col("category").eqNullSafe(F.col("c"))).drop("c")


def skipped(all_: DataFrame, done: DataFrame, reason: Column, key: str = "doc_id") -> DataFrame:
    return all_.join(done.select(key), key, "left_anti").select(key, reason.alias("reason"))


def freshness(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, verdict) of (path, mtime, size, hash): hot_fresh, content_fresh, stale, deleted or added."""
    o = old.select("path", *[F.col(c).alias(f"o_{c}") for c in ("mtime", "size", "hash")])
    verdict = (
        F.when(F.col("o_hash").isNull() & F.col("o_size").isNull(), "added").when(F.col("size").isNull(), "deleted")
        .when((F.col("mtime") == F.col("o_mtime")) & (F.col("size") == F.col("o_size")), "hot_fresh")
        .when(F.col("hash").eqNullSafe(F.col("o_hash")), "content_fresh").otherwise("stale")
    )
    return o.join(new, "path", "full_outer").select("path", verdict.alias("verdict"))


def unchanged(fields: list[str], checked_ns: str = "checked_ns", changed_ns: str = "ctime_ns") -> Column:
    """All evidence equal (o_ prefix: what was stored), and not written within two seconds of the check."""
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"o_{f}"))
    return same & (F.col(checked_ns) - F.col(changed_ns) >= 2_000_000_000)


def digest(counts: dict[str, DataFrame | None], interrupted: bool = False, failed: bool = False) -> DataFrame:
    """One row with a count of each category that was verified, in one job. state: PHASE-FAILED or INTERRUPTED if the
    run says so, else PARTIAL if a category wasn't verified, else FRESH."""
    known = {k: v for k, v in counts.items() if v is not None}
    state = "PHASE-FAILED" if failed else "INTERRUPTED" if interrupted else "FRESH" if len(known) == len(counts) else "PARTIAL"
    if not known:
        raise ValueError("no category was verified")
    every = reduce(DataFrame.unionByName, [v.select(F.lit(k).alias("category")) for k, v in known.items()])
    named = [F.count_if(F.col("category") == k).alias(k) for k in known]
    return every.agg(*named).withColumn("state", F.lit(state))


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)


def python_functions(source: str | None) -> list[tuple[str, int, int]]:
    """(qualified name, line, complexity) of a Python text's functions; what doesn't parse has none."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple[str, int, int]] = []

    def visit(node, scope):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((".".join([*scope, child.name]), child.lineno, 1 + own(child)))
                visit(child, [*scope, child.name])
            else:
                visit(child, [*scope, child.name] if isinstance(child, ast.ClassDef) else scope)

    def own(fn):
        n, todo = 0, list(ast.iter_child_nodes(fn))
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            n += isinstance(x, _BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
            todo += ast.iter_child_nodes(x)
        return n

    visit(tree, [])
    return out


def complexity(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, name, line, complexity) of the functions in Python files."""
    kind = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("complexity", T.IntegerType())]))

    @F.pandas_udf(kind)
    def scan(texts):
        return texts.map(lambda t: [dict(zip(("name", "line", "complexity"), r, strict=True)) for r in python_functions(t)])

    return files.select("path", F.explode(scan(text)).alias("f")).select("path", "f.name", "f.line", "f.complexity")


def python_calls(source: str | None) -> list[tuple[str, str, int, str]]:
    """(caller, callee, line, binding) of a Python text: binding import, local, param or unresolved by lexical scope."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple[str, str, int, str]] = []

    def bindings(node) -> dict[str, str]:
        names: dict[str, str] = {}
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]:
                names[p.arg] = "param"
        todo = list(ast.iter_child_nodes(node))
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                names[x.name] = "local"
                continue
            if isinstance(x, (ast.Import, ast.ImportFrom)):
                for al in x.names:
                    names[(al.asname or al.name).split(".")[0]] = "import"
            elif isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                names.setdefault(x.id, "local")
            todo += ast.iter_child_nodes(x)
        return names

    def visit(node, scope, env):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Call):
                f = child.func
                base = f
                while isinstance(base, ast.Attribute):
                    base = base.value
                if isinstance(base, ast.Name):
                    out.append((".".join(scope) or "<module>", ast.unparse(f), child.lineno, env.get(base.id, "unresolved")))
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                visit(child, [*scope, child.name], {**env, **bindings(child)})
            elif isinstance(child, ast.ClassDef):
                visit(child, [*scope, child.name], env)
            else:
                visit(child, scope, env)

    visit(tree, [], bindings(tree))
    return out
