"""Import statements of many languages, found by line patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line pattern for each language; its first group is what is imported.
PATTERNS = {
    "c": r'^\s*#\s*include\s*[<"]([^>"]+)[>"]',
    "cpp": r'^\s*#\s*include\s*[<"]([^>"]+)[>"]',
    "csharp": r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",
    "go": r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*$',
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
    "javascript": r"""^\s*(?:import|export)\b[^'"]*from\s*['"]([^'"]+)['"]""",
    "kotlin": r"^\s*import\s+([\w.]+(?:\.\*)?)",
    "lua": r"""\brequire\s*\(?\s*['"]([^'"]+)['"]""",
    "perl": r"^\s*(?:use|require)\s+([A-Z][\w:]*)",
    "php": r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)",
    "python": r"^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))",
    "ruby": r"""^\s*require(?:_relative)?\s*\(?\s*['"]([^'"]+)['"]""",
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    "scala": r"^\s*import\s+([\w.]+)",
    "swift": r"^\s*(?:@testable\s+)?import\s+(?:class\s+|struct\s+|func\s+)?([\w.]+)",
    "typescript": r"""^\s*(?:import|export)\b[^'"]*from\s*['"]([^'"]+)['"]""",
}


def imports(lines: DataFrame) -> DataFrame:
    """(path, line_no, target, type_only) of lines (path, language, line_no, line)."""
    target = F.lit(None).cast("string")
    for language, pattern in PATTERNS.items():
        got = F.regexp_extract("line", pattern, 1)
        if language == "python":
            got = F.concat(got, F.regexp_extract("line", pattern, 2))
        target = F.when(F.col("language") == language, F.nullif(got, F.lit(""))).otherwise(target)
    type_only = F.col("language").isin("typescript", "tsx") & F.col("line").rlike(r"^\s*(import|export)\s+type\b")
    rows = lines.withColumn("target", target).where("target is not null")
    return rows.select("path", "line_no", "target", type_only.alias("type_only"))


def resolve(imports_: DataFrame, files: DataFrame, extensions: tuple[str, ...] = ("ts", "tsx", "js", "jsx")) -> DataFrame:
    """(path, line_no, target, file) of relative imports: the first candidate that exists, null if none does.

    Candidates in order: the path itself, with each extension, then an index file in the folder.
    """
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    joined = F.concat(folder, F.col("target"))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    walked = F.aggregate(parts, empty, lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(p))))
    base = F.array_join(walked, "/")
    tries = F.array(F.col("base"), *[F.concat("base", F.lit(f".{e}")) for e in extensions], *[F.concat("base", F.lit(f"/index.{e}")) for e in extensions])
    rel = imports_.where(F.col("target").rlike(r"^\.\.?(/|$)")).withColumn("base", base)
    cands = rel.select("path", "line_no", "target", F.posexplode(tries).alias("rank", "candidate"))
    hit = cands.join(files.select(F.col("path").alias("file")).distinct(), F.col("candidate") == F.col("file"))
    best = hit.groupBy("path", "line_no", "target").agg(F.min_by("file", "rank").alias("file"))
    return rel.select("path", "line_no", "target").join(best, ["path", "line_no", "target"], "left")
