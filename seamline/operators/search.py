"""Ranked search: lanes of (id, pos, raw), fused by weighted reciprocal ranks, ordered, paged and explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.router import DEPTHS, RRF_K


def lane(scored: DataFrame, name: str, order: int, weight: float, *, key: str = "doc_id", depth: int = DEPTHS[-1]) -> DataFrame:
    """A canonical lane of (key, score): best score first, ties by key, positions from 0, cut at ``depth``.

    The cut comes first as a top-k, so that only its rows are numbered in one place.
    """
    best = scored.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(depth)
    w = Window.orderBy(F.desc("score"), key)
    return best.select(
        key, (F.row_number().over(w) - 1).alias("pos"), F.col("score").alias("raw"), F.lit(name).alias("lane"),
        F.lit(order).alias("lane_order"), F.lit(weight).alias("weight"),
    )


def tier(pos: Column) -> Column:
    """The depth block of a position."""
    out = F.lit(DEPTHS[-1])
    for d in reversed(DEPTHS):
        out = F.when(pos < d, F.lit(d)).otherwise(out)
    return out


def fuse(lanes: list[DataFrame], *, key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """(key, tier, fusion_score, lane_score, best_lane, n_lanes).

    A candidate's tier is that of its best position; a lane counts where the position is inside the tier. lane_score is
    the best raw score, of the lane that stands first in the plan among equals.
    """
    rows = lanes[0]
    for x in lanes[1:]:
        rows = rows.unionByName(x)
    rows = rows.withColumn("tier", F.min(tier(F.col("pos"))).over(Window.partitionBy(key)))
    return rows.groupBy(key, "tier").agg(
        F.sum(F.when(F.col("pos") < F.col("tier"), F.col("weight") / (k + F.col("pos") + 1)).otherwise(F.lit(0.0))).alias("fusion_score"),
        F.max("raw").alias("lane_score"),
        F.max_by("lane", F.struct("raw", -F.col("lane_order"))).alias("best_lane"),
        F.count(F.lit(1)).alias("n_lanes"),
    )


def finite_first(score: Column) -> Column:
    """For ordering: not-finite scores last, both zeros equal."""
    bad = F.isnan(score) | score.isin(float("inf"), float("-inf")) | score.isNull()
    return F.when(bad, F.lit(float("-inf"))).otherwise(score + F.lit(0.0))


#: Order of exact evidence, before all scored candidates.
EXACT_ORDER = ("definition", "verbatim", "anchored", "window")


def canonical_order(key: str = "doc_id") -> list[Column]:
    """Order of candidates with columns exact (kind or null), exact_count, tier, fusion_score and lane_score."""
    rank = F.lit(len(EXACT_ORDER))
    for i, kind in enumerate(EXACT_ORDER):
        rank = F.when(F.col("exact") == kind, F.lit(i)).otherwise(rank)
    return [
        rank.asc(), F.col("exact_count").desc_nulls_last(), F.col("tier").asc_nulls_first(),
        finite_first(F.col("fusion_score")).desc(), finite_first(F.col("lane_score")).desc(), F.col(key).asc(),
    ]


def evidence(definition: Column, occurrences: Column, anchored_span: Column, window_lines: Column) -> Column:
    """(kind, value) of a candidate's exact evidence: a definition, else its verbatim occurrences (none: no evidence at
    all, whatever follows), else the span of an anchored match, else the lines of a token window; kind null for none."""

    def of(kind: str | None, value: Column) -> Column:
        return F.struct(F.lit(kind).cast("string").alias("kind"), value.cast("long").alias("value"))

    none = F.lit(None).cast("long")
    return (
        F.when(definition, of("definition", none))
        .when(occurrences > 0, of("verbatim", occurrences))
        .when(occurrences.isNotNull(), of(None, none))
        .when(anchored_span.isNotNull(), of("anchored", anchored_span))
        .when(window_lines.isNotNull(), of("window", window_lines))
        .otherwise(of(None, none))
    )


def identifiers(docs: DataFrame, declaration: str, *, key: str = "doc_id", least: int = 3) -> DataFrame:
    """(name, declared, key, line_no) of every identifier of ``least`` characters: where it is declared first, else where
    it is first named. ``declaration`` is a pattern whose group is the declared name."""
    from ..functions.text import lines

    rows = lines(docs, key)
    name = r"[A-Za-z_$][A-Za-z0-9_$]*"

    def found(pattern: str, group: int, declared: bool) -> DataFrame:
        names = F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(group)))
        return rows.select(key, "line_no", names.alias("name")).withColumn("declared", F.lit(declared))

    every = found(name, 0, False).unionByName(found(declaration, 1, True)).where(F.length("name") >= least)
    first = F.min(F.struct((~F.col("declared")).alias("mention"), F.col(key), F.col("line_no"))).alias("x")
    return every.groupBy("name").agg(first).select("name", (~F.col("x.mention")).alias("declared"), f"x.{key}", "x.line_no")


def page(ranked: DataFrame, order: list[Column], offset: int = 0, top_k: int = 10) -> DataFrame:
    if offset < 0 or top_k < 1:
        raise ValueError("offset is at least 0 and top_k at least 1")
    return ranked.orderBy(*order).offset(offset).limit(top_k)


def stop_state(total: Column, shown: Column, deepest: Column) -> Column:
    """exhausted, depth_cap or more."""
    return F.when(shown >= total, F.lit("exhausted")).when(deepest >= DEPTHS[-1], F.lit("depth_cap")).otherwise(F.lit("more"))


def demote(lane_rows: DataFrame, data: Column, by: int = 20, key: str = "doc_id") -> DataFrame:
    """Data files move down ``by`` positions within each lane; on ties the source file goes first."""
    w = Window.partitionBy("lane").orderBy(F.col("pos") + F.when(data, by).otherwise(0), data.cast("int"), "pos", key)
    return lane_rows.withColumn("new_pos", F.row_number().over(w) - 1)


def confidence(ranked: DataFrame, margin: float = 0.05) -> DataFrame:
    """One row from ranks 1 and 2 of (rank, exact, fusion_score): high if exact stands over scored or the lead is large."""
    top = ranked.where("rank <= 2")
    w = Window.orderBy("rank")
    pair = top.withColumn("second", F.lead("fusion_score").over(w)).withColumn("second_exact", F.lead("exact").over(w)).where("rank = 1")
    lead = (F.col("fusion_score") - F.col("second")) / F.col("fusion_score")
    high = F.col("exact").isNotNull() & F.col("second_exact").isNull() | F.col("second").isNull() & F.col("second_exact").isNull() | (lead >= margin)
    return pair.select(F.when(F.coalesce(high, F.lit(False)), F.lit("high")).otherwise(F.lit("low")).alias("confidence"), lead.alias("margin"))


def nearest_names(names: DataFrame, wanted: str, *, least: int = 500, most: int = 5) -> DataFrame:
    """(name, similarity, declared) of (name, declared): the larger of edit and word similarity in thousandths."""
    from ..functions.text import edit_similarity, word_similarity, words_of

    once = names.groupBy("name").agg(F.max("declared").alias("declared"))
    edit = edit_similarity(F.lower("name"), F.lit(wanted.lower()))
    sim = F.greatest(edit, word_similarity(F.array_distinct(words_of(F.col("name"))), F.array_distinct(words_of(F.lit(wanted)))))
    near = once.withColumn("similarity", sim).where((F.col("similarity") >= least) & (F.col("name") != wanted))
    return near.orderBy(F.desc("declared"), F.desc("similarity"), "name").limit(most)


def rerank(head: DataFrame, scores: DataFrame, *, top: int = 20, text: str = "text") -> DataFrame:
    """The first ``top`` of (rank, text, ...) in order of scores looked up by the text's digest; the rest keep theirs."""
    looked = head.withColumn("digest", F.sha2(text, 256)).join(scores, "digest", "left")
    inside = (F.col("rank") <= top).cast("int")
    w = Window.orderBy(F.desc(inside), F.when(F.col("rank") <= top, finite_first(F.col("score"))).desc(), "rank")
    return looked.withColumn("new_rank", F.row_number().over(w)).drop("digest")


def recall_audit(targets: DataFrame, stages: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """For each target the first stage that lost it, null if none did."""
    out, lost = targets, F.lit(None).cast("string")
    for name, rows in reversed(stages.items()):
        out = out.join(rows.select(key).distinct().withColumn(f"in_{name}", F.lit(True)), key, "left")
        lost = F.when(F.col(f"in_{name}").isNull(), F.lit(name)).otherwise(lost)
    return out.select(key, lost.alias("lost_at"))


def exact_evidence(docs: DataFrame, phrase: str, tokens: list[str], *, key: str = "doc_id", span: int = 3) -> DataFrame:
    """(key, exact, exact_count): verbatim with its number of occurrences, else window where all tokens stand close."""
    from ..functions.text import lines
    from .grep import token_windows

    n = F.size(F.split("text", F.lit(_quoted(phrase)))) - 1
    verbatim = docs.where(F.contains("text", F.lit(phrase))).select(key, n.cast("long").alias("exact_count"))
    every = docs
    for t in tokens:
        every = every.where(F.contains("text", F.lit(t)))
    near = token_windows(lines(every, key), key, tokens, span).select(key).distinct()
    rest = near.join(verbatim, key, "left_anti").select(key, F.lit("window").alias("exact"), F.lit(None).cast("long").alias("exact_count"))
    return verbatim.select(key, F.lit("verbatim").alias("exact"), "exact_count").unionByName(rest)


def _quoted(s: str) -> str:
    import re

    return re.escape(s).replace("\\ ", " ")


def anchored(docs: DataFrame, excerpt: str, *, key: str = "doc_id", most: int | None = None) -> DataFrame:
    """(key, line_no, matched) of lines that hold a log excerpt's literal runs in order, what varies left out; all of them,
    or the first ``most`` of each text."""
    from ..functions.text import lines

    runs = literal_runs(excerpt)
    if not runs:
        return lines(docs, key).limit(0).select(key, "line_no", F.lit(0).alias("matched"))
    pattern = ".*".join(_quoted(r) for r in runs)
    found = lines(docs.where(F.contains("text", F.lit(max(runs, key=len)))), key).where(F.col("line").rlike(pattern))
    if most is not None:
        w = Window.partitionBy(key).orderBy("line_no")
        found = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return found.select(key, "line_no", F.lit(sum(map(len, runs))).alias("matched"))


def literal_runs(excerpt: str, least: int = 3) -> list[str]:
    """The literal parts of a log excerpt: without levels, times, numbers, addresses and what stands in brackets."""
    import re

    varying = (
        r"\b(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\b|\d{4}-\d\d-\d\d[T ]\S*|\[[^\]]*\]|\b0x[0-9a-fA-F]+\b|\b\d+(?:[.:]\d+)*\b"
    )
    return [r for r in (p.strip(" :,-") for p in re.split(varying, excerpt)) if len(r) >= least]
