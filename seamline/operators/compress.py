"""Output compression of texts given as rows (key, line_no, line): folds, caps and cuts, by windows over lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Caps of classes, least run of equal lines and of equal shapes.
CAPS = {"error": 20, "failure": 20, "warning": 10, "issue": 20, "list": 20, "timing": 20, "inventory": 50}
LEAST_RUN, LEAST_SHAPE_RUN = 4, 8


def runs(rows: DataFrame, key: str, same: Column) -> DataFrame:
    """``rows`` with the number of the run of consecutive equal ``same`` in each key."""
    w = Window.partitionBy(key).orderBy("line_no")
    new = F.when(same.eqNullSafe(F.lag(same).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def fold_consecutive(rows: DataFrame, key: str, least: int = LEAST_RUN) -> DataFrame:
    """Runs of ``least`` equal lines and more become the first line and ``... (n more)``."""
    g = runs(rows, key, F.col("line")).groupBy(key, "run").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("start"), F.first("line").alias("line"))
    more = F.concat(F.lit("... ("), (F.col("n") - 1).cast("string"), F.lit(" more)"))
    pieces = F.when(F.col("n") >= least, F.array(F.col("line"), more)).otherwise(F.array_repeat("line", F.col("n").cast("int")))
    return g.select(key, "start", F.posexplode(pieces).alias("part", "line"))


def fold_shapes(rows: DataFrame, key: str, least: int = LEAST_SHAPE_RUN) -> DataFrame:
    """(key, start, stop, n, shape, first, last) of runs of lines of one shape, ``least`` and more."""
    g = runs(rows.withColumn("shape", X.shape_key(F.col("line"))), key, F.col("shape"))
    out = g.groupBy(key, "run").agg(
        F.min("line_no").alias("start"), F.max("line_no").alias("stop"), F.count(F.lit(1)).alias("n"), F.first("shape").alias("shape"),
        F.min_by("line", "line_no").alias("first"), F.max_by("line", "line_no").alias("last"),
    )
    return out.where(F.col("n") >= least).withColumn("shape", F.replace("shape", F.lit("#"), F.lit("*"))).drop("run")


def head_tail(rows: DataFrame, key: str, most: int, tail_lines: int = 20, tail_bytes: int = 4096) -> DataFrame:
    """Texts over ``most`` lines keep a tail (at most tail_lines, half of ``most`` and tail_bytes) and fill up with head."""
    up = Window.partitionBy(key).orderBy("line_no")
    down = Window.partitionBy(key).orderBy(F.desc("line_no"))
    every = Window.partitionBy(key)
    r = (
        rows.withColumn("from_top", F.row_number().over(up))
        .withColumn("from_end", F.row_number().over(down))
        .withColumn("end_bytes", F.sum(F.octet_length("line") + 1).over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.count(F.lit(1)).over(every))
    )
    in_tail = (F.col("from_end") <= min(tail_lines, most // 2)) & (F.col("end_bytes") <= tail_bytes)
    r = r.withColumn("in_tail", in_tail).withColumn("n_tail", F.count_if("in_tail").over(every))
    keep = (F.col("n") <= most) | F.col("in_tail") | (F.col("from_top") <= most - F.col("n_tail"))
    return r.where(keep).select(key, "line_no", "line", F.greatest(F.col("n") - most, F.lit(0)).alias("n_cut"))


def last_lines(rows: DataFrame, key: str, most: int = 5, most_bytes: int = 1024) -> DataFrame:
    down = Window.partitionBy(key).orderBy(F.desc("line_no"))
    size = F.sum(F.octet_length("line") + 1).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("k", F.row_number().over(down)).withColumn("b", size).where((F.col("k") <= most) & (F.col("b") <= most_bytes)).drop("k", "b")


def byte_budget(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Whole lines from the top while their UTF-8 bytes stay within ``most``."""
    up = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("b", F.sum(F.octet_length("line") + 1).over(up)).where(F.col("b") <= most).drop("b")


def text_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(key).agg(joined.alias("text"))


@dataclass
class Filter:
    """A declarative filter: lines that match ``strip`` go, lines are cut, then their number is capped.

    A text that matches ``shortcircuit`` (pattern, replacement) becomes the replacement.
    """

    strip: list[str] = field(default_factory=list)
    truncate: int | None = None
    max_lines: int | None = None
    keep: str = "head"
    shortcircuit: list[tuple[str, str]] = field(default_factory=list)


def apply_filter(docs: DataFrame, f: Filter, key: str = "doc_id") -> DataFrame:
    """(key, text) of docs (key, text) after a filter; a text of which nothing is left is empty."""
    ids = docs.select(key, "text")
    short = F.lit(None).cast("string")
    for pattern, replacement in reversed(f.shortcircuit):
        short = F.when(F.col("text").rlike(pattern), F.lit(replacement)).otherwise(short)
    rows = X.lines(ids.withColumn("text", X.strip_ansi(F.col("text"))), key)
    for p in f.strip:
        rows = rows.where(~F.col("line").rlike(p))
    if f.truncate:
        rows = rows.withColumn("line", F.when(F.length("line") > f.truncate, F.concat(F.left("line", F.lit(f.truncate - 1)), F.lit("…"))).otherwise(F.col("line")))
    if f.max_lines:
        up, down = Window.partitionBy(key).orderBy("line_no"), Window.partitionBy(key).orderBy(F.desc("line_no"))
        rows = rows.withColumn("a", F.row_number().over(up)).withColumn("z", F.row_number().over(down))
        half = f.max_lines // 2
        ok = {"head": F.col("a") <= f.max_lines, "tail": F.col("z") <= f.max_lines, "middle": (F.col("a") <= f.max_lines - half) | (F.col("z") <= half)}
        rows = rows.where(ok[f.keep])
    left = text_of(rows.select(key, "line_no", "line"), key, ["line_no"]).withColumnRenamed("text", "rest")
    return ids.join(left, key, "left").select(key, F.coalesce(short, F.col("rest"), F.lit("")).alias("text"))


def generic(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The fallback: control sequences stripped, equal consecutive lines folded."""
    rows = X.lines(docs.withColumn("text", X.strip_ansi(F.col("text"))), key)
    return text_of(fold_consecutive(rows, key), key, ["start", "part"])
