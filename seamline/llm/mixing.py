"""Mixing sources to target weights.

Every document gets a hash-random key. A source gives whole epochs while its target holds them; the rest goes to its
documents in key order, cut where the exact budget is reached. The order is range-sorted in buckets of a source's
(uniform) key space, sized by the source's rows, so a hot source is spread over many tasks; sums of a bucket, summed
over the buckets before it, give distributed prefix sums. Texts never move: only ids, sizes and keys are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pin, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
ROWS_PER_BUCKET = 2_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Runs of characters other than white space (20, 09-0D hex); null: 0.

    Each run becomes one mark, and the marks are counted, so no array of words is built.
    """
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of the total by weight, capped.

    Weights repeat over the sources in code point order, null last. What a capped source can't take goes to the others
    by weight, until none is above its cap: sources in order of cap over weight, the capped ones are the first for
    which cap over weight is at most what is left over the weights that are left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = (
        sizes.withColumn("w", w.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("goal", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("before", F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("level", (F.col("goal") - F.col("before")) / F.sum("w").over(rest))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
    )
    # Levels fall short of the ratio from the first free source on; its level holds for all free sources.
    at = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(
        up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return s.withColumn("at", at).select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("at")).alias("target")
    )


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken), a row for each distinct (doc_id, source, size) and ``copies``.

    Rows with the same doc_id, source and size share what they take evenly. Documents without words take nothing.
    An empty table gives an empty result. Reruns agree, as keys depend on seed and doc_id alone.
    """
    rows = pin(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    )
    sources = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n")
    )
    goal = targets(sources.select("source", "source_size"), weights, share, max_epochs)
    plan = (
        goal.join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
        .withColumn("left", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n") / rows_per_bucket))
        .select("s", "source_size", "target", "epochs", "left", "buckets")
    )
    share_of_key = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    placed = (
        rows.join(F.broadcast(plan) if _few(plan) else plan, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("bucket", F.floor(share_of_key * F.col("buckets")))
        .withColumn("total", F.col("size") * F.col("copies"))
    )
    sums = placed.groupBy("source", "bucket").agg(F.sum("total").alias("t"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset")
    )
    within = (
        Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = placed.withColumn("in_bucket", F.coalesce(F.sum("total").over(within), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    )
    room = F.greatest(F.lit(0), F.col("left") - F.col("offset") - F.col("in_bucket"))
    more = F.when(room >= F.col("total"), F.col("size")).otherwise(F.floor(room / F.col("copies")))
    return ranked.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"), "copies"
    )


def _few(plan: DataFrame, most: int = 20_000) -> bool:
    """Whether the plan has few enough sources to be broadcast; else the join is shuffled."""
    return plan.limit(most + 1).count() <= most


def repeat(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents themselves: a row for each time a document is taken; the cut one keeps its first words."""
    settings.setdefault("seed", SEED)
    names = docs.columns
    taken = mix(docs, **settings).select(
        F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "taken"
    )
    rows = docs.withColumn("m_words", word_count(F.col("text")))
    same = (
        F.col("doc_id").eqNullSafe(F.col("m_id"))
        & F.col("source").eqNullSafe(F.col("m_source"))
        & (F.col("m_words") == F.col("m_size"))
    )
    joined = rows.join(taken.where("taken > 0"), same).withColumn(
        "m_part", F.explode(F.expr("transform(sequence(1, cast(ceil(taken / m_size) as int)), i -> least(m_size, taken - (i - 1) * m_size))"))
    )
    cut = F.expr(r"array_join(slice(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, cast(m_part as int)), '')")
    text = F.when(F.col("m_part") == F.col("m_size"), F.col("text")).otherwise(cut)
    return joined.withColumn("text", text).withColumn(
        "n_chars", F.when(F.col("m_part") == F.col("m_size"), F.col("n_chars")).otherwise(F.length("text"))
    ).select(*names)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             2.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ()) * 1.5::DOUBLE AS goal FROM s),
r AS (SELECT *, cap / w AS ratio,
             (goal - (sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
a AS (SELECT *, first_value(CASE WHEN ratio > level THEN level END IGNORE NULLS) OVER (ORDER BY ratio, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lev FROM r),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE w * lev END AS target FROM a),
p AS (SELECT *, round(target)::BIGINT AS budget,
             CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
q AS (SELECT d.doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM q
"""
