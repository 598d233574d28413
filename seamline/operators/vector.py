"""Vector search: exact scores, ranking, and exact top-k behind an int8 filter with proven bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, exported: Column | None = None) -> Column:
    """Cosine, 0 where a norm is 0; exported ones gain a tenth (of a score from 0 up) or lose one."""
    scale = norm(a) * norm(b)
    score = F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)
    if exported is None:
        return score
    return F.when(exported, score * F.when(score >= 0, 1.1).otherwise(0.9)).otherwise(score)


def valid(v: Column, dim: int) -> Column:
    """The right number of finite components."""
    return (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(rows: DataFrame, query: list[float], k: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(valid(F.col(vector), len(query))).select(key, cosine(F.col(vector), q).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def quantise(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, vector, codes, scale, norm, err_max, err_norm): int8 codes around the mean vector, with residual norms.

    The mean is one row of the vector's width; every other step is local to a row.
    """
    mean = (
        rows.select(F.posexplode(vector).alias("i", "x"))
        .groupBy("i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    )
    d = rows.crossJoin(F.broadcast(mean)).withColumn("off", F.zip_with(_doubles(F.col(vector)), "mean", lambda x, m: x - m))
    d = d.withColumn("scale", F.aggregate("off", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))) / 127)
    codes = F.when(F.col("scale") == 0, F.transform("off", lambda _: F.lit(0))).otherwise(
        F.transform("off", lambda x: F.round(x / F.col("scale")).cast("int"))
    )
    d = d.withColumn("codes", codes)
    rest = F.zip_with("off", "codes", lambda x, c: x - c * F.col("scale"))
    return d.withColumn("rest", rest).select(
        key,
        vector,
        "codes",
        "scale",
        "mean",
        norm(F.col(vector)).alias("norm"),
        F.aggregate("rest", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))).alias("err_max"),
        norm(F.col("rest")).alias("err_norm"),
    )


def publish(quantised: DataFrame) -> DataFrame:
    """The quantised vectors as a written table, a byte for each code, that queries read."""
    at = f"{shared_folder(quantised.sparkSession).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    small = quantised.withColumn("codes", F.col("codes").cast("array<tinyint>"))
    small.write.parquet(at)
    return quantised.sparkSession.read.schema(small.schema).parquet(at)


def bounds(quantised: DataFrame, query: list[float], *, slack: float = 1e-9) -> DataFrame:
    """``quantised`` with lower and upper bounds of the cosine, by Hoelder's and Cauchy's inequalities."""
    q = F.array(*[F.lit(float(x)) for x in query])
    q1, q2 = sum(abs(x) for x in query), sum(x * x for x in query) ** 0.5
    near = dot(F.transform("codes", lambda c: c.cast("double")), q) * F.col("scale") + dot(F.col("mean"), q)
    err = F.least(F.col("err_max") * q1, F.col("err_norm") * q2) + slack
    scale = F.col("norm") * q2

    def over(x: Column) -> Column:
        return F.when(scale == 0, F.lit(0.0)).otherwise(x / scale)

    return quantised.withColumn("lower", over(near - err)).withColumn("upper", over(near + err))


def pruned_top_k(quantised: DataFrame, query: list[float], k: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact top k: only vectors whose upper bound reaches the k-th best lower bound are scored."""
    b = bounds(quantised, query)
    bar = b.orderBy(F.desc("lower")).limit(k).agg(F.min("lower").alias("bar"))
    left = b.crossJoin(F.broadcast(bar)).where("upper >= bar")
    return top_k(left.select(key, vector), query, k, key=key, vector=vector)


def top_per_group(rows: DataFrame, query: list[float], group: str, k: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    w = Window.partitionBy(group).orderBy(F.desc("score"), key)
    scored = rows.select(key, group, cosine(F.col(vector), q).alias("score"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def to_embed(texts: DataFrame, stored: DataFrame, text: str = "text") -> DataFrame:
    """Texts without a stored vector, by digest."""
    return texts.withColumn("digest", F.sha2(text, 256)).join(stored.select("digest").distinct(), "digest", "left_anti")
