"""Scans: tables, scopes, overlays, generations and fan-out over several sources."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one in local mode; on a cluster that is
    an error, as executors could not read it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at or tempfile.mkdtemp(prefix="shared-")


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, modified, text) of the files under a root; undecodable bytes become replacement characters."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    text = F.decode(F.col("content"), F.lit("UTF-8"))
    return read.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), text.alias("text"))


def glob_pattern(glob: str) -> str:
    """A glob with ** and {a,b} as a regular expression without lookaround."""
    out, depth = "", 0
    for part in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|[{},]|[^*?\[{},]+|.", glob):
        if part == "{" and "}" in glob:
            out, depth = out + "(?:", depth + 1
            continue
        if depth and part in "},":
            out, depth = out + {"}": ")", ",": "|"}[part], depth - (part == "}")
            continue
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (
            part.replace("[!", "[^") if part[0] == "[" and len(part) > 1 else re.escape(part).replace("\\-", "-")
        )
    return f"^{out}$"


def globbed(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Any included glob (all if none is given) and no excluded one."""
    ok = F.lit(not include)
    for g in include:
        ok = ok | path.rlike(glob_pattern(g))
    for g in exclude:
        ok = ok & ~path.rlike(glob_pattern(g))
    return ok


def ignored(path: Column, rules: list[str]) -> Column:
    """Ignore-file rules in order: a later one wins, ! takes back, a trailing slash means a folder."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.lstrip("!")
        folder, body = rule.endswith("/"), rule.strip("/")
        anchored = "/" in rule.rstrip("/")
        inner = glob_pattern(body)[1:-1]
        hit = path.rlike(f"{'^' if anchored else '(^|/)'}{inner}{'/' if folder else '(/|$)'}")
        out = F.when(hit, F.lit(not keep)).otherwise(out)
    return out


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(tests?|__tests__|spec|fixtures)/|(^|/)test_[^/]*$|[._-](test|spec)\.[a-z]+$|_test\.[a-z]+$")


def roots_of(paths: str | list[str]) -> list[str]:
    """Paths given one by one or in one string, without those inside another."""
    given = paths.split() if isinstance(paths, str) else list(paths)
    given = sorted({posixpath.normpath(p) for p in given}, key=lambda p: (p.count("/"), p))
    kept: list[str] = []
    for p in given:
        if not any(p == k or p.startswith(k.rstrip("/") + "/") for k in kept):
            kept.append(p)
    return sorted(kept)


def under(path: Column, roots: list[str]) -> Column:
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | F.startswith(path, F.lit(r.rstrip("/") + "/"))
    return out


def overlay(base: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """``base`` without the keys that ``own`` has, and ``own``."""
    return base.join(own.select(key).distinct(), key, "left_anti").unionByName(own)


def fan_out(sources: dict, build, unreadable: tuple[type[Exception], ...] = (PySparkException, Py4JJavaError, OSError)) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(rows of all sources with a ``source`` column, gaps): a source that can't be read is a gap, not an error.

    Each source is read to its end into the shared folder before the next, so that one lost on the way is a gap too and
    leaves no half of its rows. Errors of other kinds than ``unreadable`` are the program's own, and are raised.
    """
    rows, gaps = None, []
    for name, source in sources.items():
        try:
            got = build(source).withColumn("source", F.lit(name))
            at = f"{shared_folder(got.sparkSession).rstrip('/')}/source-{uuid.uuid4().hex}"
            got.write.parquet(at)
        except unreadable as e:
            gaps.append((name, type(e).__name__))
            continue
        got = got.sparkSession.read.schema(got.schema).parquet(at)
        rows = got if rows is None else rows.unionByName(got)
    return rows, gaps


def publish(df: DataFrame, root: str) -> str:
    """Write a generation, then its manifest row: readers see it whole or not at all. Returns its name."""
    name = f"gen-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    spark = df.sparkSession
    at = spark.range(1).select(F.lit(name).alias("generation"), F.current_timestamp().alias("published"))
    at.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return name


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest published generation."""
    newest = spark.read.parquet(f"{root}/manifest").agg(F.max_by("generation", F.struct("published", "generation"))).first()[0]
    return spark.read.parquet(f"{root}/{newest}")


def compact(spark: SparkSession, root: str, generations: list[str], key: str, parts: int) -> str:
    """Fold generations into a new one, sorted by key; rows of equal key come from the later generation."""
    rows = None
    for i, g in enumerate(generations):
        got = spark.read.parquet(f"{root}/{g}").withColumn("g", F.lit(i))
        rows = got if rows is None else rows.unionByName(got)
    names = [c for c in rows.columns if c != "g"]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*names), "g").alias("r")).select("r.*")
    return publish(newest.repartitionByRange(parts, key).sortWithinPartitions(key), root)




def write_json_arrays(df: DataFrame, folder: str) -> None:
    """Rows as JSON arrays of their values, a line each, in column order; nulls are kept."""
    values = F.transform(F.array(*[F.coalesce(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), F.lit("")) for c in df.columns]), lambda j: F.substring(j, 6, 1 << 30))
    trimmed = F.transform(values, lambda j: F.left(j, F.length(j) - 1))
    df.select(F.concat(F.lit("["), F.array_join(trimmed, ","), F.lit("]")).alias("value")).write.text(folder)
