"""Relational and retention operators: newest rows, as-of and range joins, upserts, sweeps and keyset batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def newest_epoch(rows: DataFrame, keys: list[str], epoch: str) -> DataFrame:
    """All rows of each key's greatest epoch; partial maxima come before the shuffle."""
    top = rows.groupBy(*keys).agg(F.max(epoch).alias("top"))
    return rows.join(top, keys).where(F.col(epoch) == F.col("top")).drop("top")


def decimal_order(c: Column) -> tuple[Column, Column]:
    """Descending order of decimal strings without leading zeros: by length, then by value."""
    return F.length(c).desc(), c.desc()


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str) -> DataFrame:
    """Each left row with the right row of its keys that is exactly at, or else last before, its time."""
    l_ = left.withColumn("side", F.lit(1)).withColumn("t", F.col(at))
    names = [c for c in right.columns if c not in keys]
    r = right.withColumn("side", F.lit(0)).withColumn("t", F.col(since)).withColumn("held", F.struct(*names))
    both = l_.unionByName(r.select(*keys, "side", "t", "held"), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("m", F.last("held", True).over(w)).where("side = 1").select(*left.columns, *[F.col(f"m.{n}").alias(f"r_{n}") for n in names])


def exact_or_newest(rows: DataFrame, keys: list[str], epoch: str, wanted: Column) -> DataFrame:
    return latest(rows, keys, [F.when(F.col(epoch) == wanted, 0).otherwise(1).asc(), F.col(epoch).desc()])


def within(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, low: int, high: int) -> DataFrame:
    """Range join with equi keys: pairs with right.b - left.a between low and high.

    Time is cut into bins as wide as the range, so a pair is found in one of the bins a left row is copied to, and a
    hot key is spread over its bins.
    """
    width = max(1, high - low + 1)
    bins = F.sequence(F.floor((F.col(a) + low) / width), F.floor((F.col(a) + high) / width))
    l_ = left.withColumn("bin", F.explode(bins))
    r = right.withColumn("bin", F.floor(F.col(b) / width))
    return l_.join(r, [*keys, "bin"]).where((F.col(b) - F.col(a)).between(low, high)).drop("bin")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last writer wins; new rows win ties."""
    both = stored.withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)))
    return latest(both, keys, [F.desc("gen"), F.desc(order)]).drop("gen")


def insert_if_absent(stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Stored rows stay; of new rows the first of each absent key comes in."""
    first = latest(new, keys, order)
    return stored.unionByName(first.join(stored.select(*keys).distinct(), keys, "left_anti").select(*stored.columns))


def expire(rows: DataFrame, expires: Column, now: Column) -> DataFrame:
    return rows.where(expires > now)


def sweep(rows: DataFrame, expired: Column, order: list[Column], keys: list[str], most: int = 64) -> DataFrame:
    """Without the ``most`` oldest expired rows."""
    gone = rows.where(expired).orderBy(*order).limit(most).select(*keys)
    return rows.join(gone, keys, "left_anti")


def admit(stored: DataFrame, size: str, protected: Column, need_rows: int, need_bytes: int, max_rows: int, max_bytes: int) -> bool:
    """Whether new rows fit beside the protected ones by count and bytes."""
    n, b = stored.where(protected).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n + need_rows <= max_rows and b + need_bytes <= max_bytes


def keep_newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def keyset_batch(rows: DataFrame, key: str, after, most: int, where: Column | None = None) -> DataFrame:
    """The next ``most`` rows after a key, in key order; resume from the last key of the batch."""
    if where is not None:
        rows = rows.where(where)
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(most)


def class_caps(rows: DataFrame, kind: str, order: list[Column], caps: dict[str, int], default: int) -> DataFrame:
    """Rows within their class's cap, with how many of the class were dropped.

    Classes are counted apart, so that the numbered rows are cut to the largest cap before they are shuffled.
    """
    cap = F.lit(default)
    for k, n in caps.items():
        cap = F.when(F.col(kind) == k, F.lit(n)).otherwise(cap)
    most = max([default, *caps.values()])
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("rn") <= most)
    n = rows.groupBy(F.col(kind).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    out = first.withColumn("cap", cap).where("rn <= cap").join(n, F.col(kind).eqNullSafe(F.col("class")))
    return out.withColumn("dropped", F.greatest(F.col("n") - F.col("cap"), F.lit(0))).drop("n", "cap", "rn", "class")


def global_rank(rows: DataFrame, value: str, key: str, bits: int = 10) -> DataFrame:
    """``rows`` with rank, from 1 for the greatest value (a whole number; among equals the least key first).

    The rows above a value are summed from counts of values, in ranges of 2**bits values, so no task sees all rows.
    """
    counts = rows.groupBy(F.col(value).cast("long").alias("of_value")).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("high", F.shiftright("of_value", bits))
    ranges = counts.groupBy("high").agg(F.sum("c").alias("s"))
    above = Window.orderBy(F.desc("high")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("high").alias("h"), F.coalesce(F.sum("s").over(above), F.lit(0)).alias("base"))
    within = Window.partitionBy("high").orderBy(F.desc("of_value")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("in_range", F.coalesce(F.sum("c").over(within), F.lit(0))).join(ranges, F.col("high") == F.col("h"))
    starts = starts.select("of_value", (F.col("base") + F.col("in_range")).alias("before"))
    among = F.row_number().over(Window.partitionBy(value).orderBy(key))
    placed = rows.withColumn("among", among).join(starts, F.col(value) == F.col("of_value"))
    return placed.withColumn("rank", F.col("before") + F.col("among")).drop("of_value", "before", "among")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    names = a.columns
    return a.exceptAll(b).select(*names).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).select(*names).withColumn("side", F.lit("right")))


def batch_grants(grants: DataFrame, scopes: DataFrame, agents: DataFrame, roles: list[str]) -> DataFrame:
    """Grants of a role that is asked for, not ended, whose scope and agents are of the newest epoch."""
    live = grants.where(F.col("role").isin(*roles) & F.col("ended_at").isNull())
    newest = newest_epoch(scopes, ["owner", "scope_ref"], "epoch")
    return live.join(newest, ["owner", "scope_ref", "epoch"]).join(agents, ["owner", "scope_ref", "epoch"])


def exists_in_any(tables: list[DataFrame]) -> bool:
    """Whether any of several tables has a row; each is asked for one at most."""
    return not reduce(DataFrame.union, [t.limit(1).select(F.lit(1)) for t in tables]).isEmpty()
