"""Pattern search over lines, with a trigram index as superset filter."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.postings import posting_lists
from ..plans import trigram
from ..sources.tables import shared_folder


def matcher(line: Column, pattern: str, *, literal: bool = False, ignore_case: bool = False) -> Column:
    if literal:
        return F.contains(X.ascii_fold(line), X.ascii_fold(F.lit(pattern))) if ignore_case else F.contains(line, F.lit(pattern))
    trigram.unsupported(pattern)
    re.compile(pattern)
    return line.rlike(("(?i)" if ignore_case else "") + pattern)


def grep(docs: DataFrame, pattern: str, *, key: str = "doc_id", **how) -> DataFrame:
    """(key, line_no, column, line) of the matching lines. A match never crosses a line."""
    rows = docs
    if how.get("literal") and not how.get("ignore_case"):
        # A cheap test of the whole text comes before it is split.
        rows = docs.where(F.contains("text", F.lit(pattern)))
    found = X.lines(rows, key).where(matcher(F.col("line"), pattern, **how))
    if how.get("literal"):
        line = X.ascii_fold(F.col("line")) if how.get("ignore_case") else F.col("line")
        at = F.instr(line, pattern.lower() if how.get("ignore_case") else pattern)
    else:
        at = F.regexp_instr("line", F.lit(("(?i)" if how.get("ignore_case") else "") + pattern))
    return found.select(key, "line_no", at.alias("column"), "line")


def counts(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    return matches.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"))


def word_postings(docs: DataFrame, key: str = "doc_id", word: str = "[A-Za-z]+") -> DataFrame:
    """(key, trigram, mask): the distinct trigrams of a text's words; mask ORs a bit for each following letter.

    Trigrams are taken from distinct short strings, never from a whole text, and partly aggregated before the shuffle.
    """
    words = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(word), F.lit(0)))).alias("word"))
    # Each distinct word is cut into trigrams once for all documents that have it.
    grams = words.select(key, F.explode(X.positions(F.col("word"))).alias("g"))
    return grams.groupBy(key, F.col("g.trigram").alias("trigram")).agg(F.bit_or(X.next_bit(F.col("g.next"))).alias("mask"))


def word_trigrams(text: Column, word: str = "[A-Za-z]+") -> Column:
    """The distinct trigrams of a text's words, made within the row; the text is folded once, before it is cut."""
    words = F.array_distinct(F.regexp_extract_all(X.ascii_fold(text), F.lit(word), F.lit(0)))
    long = F.filter(words, lambda w: F.length(w) >= 3)

    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(long, grams)))


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(trigram, n_docs) over texts: each row's distinct trigrams are counted, so only counts are shuffled."""
    grams = docs.select(F.explode(word_trigrams(F.col(text))).alias("trigram"))
    return grams.groupBy("trigram").agg(F.count(F.lit(1)).alias("n_docs"))


def candidates(postings: DataFrame, grams: list[str], key: str = "doc_id") -> DataFrame:
    """Documents that have all trigrams; no trigram at all means every document with postings."""
    if not grams:
        return postings.select(key).distinct()
    found = postings.where(F.col("trigram").isin(*grams)).groupBy(key).agg(F.count_distinct("trigram").alias("n"))
    return found.where(F.col("n") == len(set(grams))).select(key)


def publish_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The trigram index of whole lines as a written table, read as rows (trigram, key, mask).

    mask has a bit for every character that follows the trigram somewhere in the text; a line's end sets none. It is
    written as posting lists, one for a trigram and a few MB of texts, sorted by trigram within each file, so nothing is
    shuffled: row groups and pages of other trigrams are skipped by their least and greatest values. Lists are taken
    apart for the trigrams that are asked for, and equal keys become one row.
    """
    kind = T.StructType([T.StructField("trigram", T.StringType()), T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), T.StructField("masks", T.ArrayType(T.IntegerType()))])
    lists = docs.select(key, text).mapInArrow(posting_lists, kind)
    at = f"{shared_folder(docs.sparkSession).rstrip('/')}/trigrams-{uuid.uuid4().hex}"
    lists.sortWithinPartitions("trigram").write.options(**{"compression": "zstd", "parquet.page.row.count.limit": 1000}).parquet(at)
    rows = docs.sparkSession.read.schema(kind).parquet(at).select("trigram", F.inline(F.arrays_zip("keys", "masks")).alias(key, "mask"))
    return rows.groupBy("trigram", key).agg(F.bit_or("mask").alias("mask"))


def _grams_of(q: trigram.Query) -> set[str]:
    return {q.gram} if q.kind == "gram" else set().union(*map(_grams_of, q.parts)) if q.kind in ("and", "or") else set()


def index_candidates(index: DataFrame, q: trigram.Query, key: str = "doc_id", follows: dict[str, str] | None = None) -> DataFrame | None:
    """(key) of documents whose postings satisfy a plan, None where it can't tell (every document then).

    Of what must all hold, the rarest comes first and the others only narrow it down. ``follows`` says what character
    comes after a trigram, so that the mask can rule documents out.
    """
    grams = _grams_of(q)
    # Spark looks for more than ten values at once by their range alone, which would read most of the index.
    some = [F.col("trigram").isin(*sorted(grams)[i : i + 10]) for i in range(0, len(grams), 10)]
    asked = index.where(reduce(Column.__or__, some)) if some else index.limit(0)
    n = {r.trigram: r.n for r in asked.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).collect()}

    def size(q: trigram.Query) -> float:
        if q.kind == "gram":
            return n.get(q.gram, 0)
        return min(map(size, q.parts)) if q.kind == "and" else sum(map(size, q.parts)) if q.kind == "or" else float("inf")

    def found(q: trigram.Query) -> DataFrame | None:
        if q.kind == "gram":
            rows = index.where(F.col("trigram") == q.gram)
            nxt = (follows or {}).get(q.gram)
            if nxt:
                bit = X.next_bit(F.lit(nxt))
                rows = rows.where(F.col("mask").bitwiseAND(bit) == bit)
            return rows.select(key)
        if q.kind == "none":
            return index.select(key).limit(0)
        if q.kind not in ("and", "or"):
            return None
        parts = [found(p) for p in sorted(q.parts, key=size)]
        if q.kind == "or":
            return None if any(p is None for p in parts) else reduce(DataFrame.union, parts).distinct()
        known = [p for p in parts if p is not None]
        return reduce(lambda x, y: x.join(y, key, "left_semi"), known) if known else None

    return found(q)


def indexed_grep(
    docs: DataFrame, pattern: str, *, key: str = "doc_id", ignore_case: bool = False, literal: bool = False, index: DataFrame | None = None
) -> DataFrame:
    """grep by plan: lines whose trigrams satisfy the pattern's query are verified against the pattern.

    With a published ``index`` only documents that its postings allow are read; without one, the query's trigrams are
    looked for as substrings, in the whole text first and then line by line.
    """
    query = trigram.of_string(fold_pattern(pattern)) if literal else trigram.plan(pattern)
    rows = docs
    if index is not None:
        folded = fold_pattern(pattern)
        follows = {folded[i : i + 3]: folded[i + 3] for i in range(len(folded) - 3) if folded.count(folded[i : i + 3]) == 1} if literal else None
        ids = index_candidates(index, query, key, follows)
        if ids is not None:
            # Written first, so that their size is known: where they are few, no text is shuffled.
            at = f"{shared_folder(docs.sparkSession).rstrip('/')}/candidates-{uuid.uuid4().hex}"
            ids.write.parquet(at)
            rows = rows.join(docs.sparkSession.read.schema(ids.schema).parquet(at), key, "left_semi")
    elif query != trigram.ALL:
        rows = rows.where(_substrings(query, X.ascii_fold(F.col("text"))))
    rows = X.lines(rows, key)
    if query != trigram.ALL:
        # As substrings, the query's trigrams need no array: each is one scan of the line.
        rows = rows.where(_substrings(query, X.ascii_fold(F.col("line"))))
    return rows.where(matcher(F.col("line"), pattern, ignore_case=ignore_case, literal=literal))


def fold_pattern(text: str) -> str:
    """A-Z to a-z of a pattern on the driver."""
    return text.translate(str.maketrans(X.UPPER, X.LOWER))


def _substrings(q: trigram.Query, c: Column) -> Column:
    if q.kind == "gram":
        return F.contains(c, F.lit(q.gram))
    if q.kind in ("and", "or"):
        out = _substrings(q.parts[0], c)
        for p in q.parts[1:]:
            out = out & _substrings(p, c) if q.kind == "and" else out | _substrings(p, c)
        return out
    return F.lit(q.kind == "all")


def lexical_scores(docs: DataFrame, grams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): matched query trigrams over 1 + ln(distinct trigrams of the text), for texts with a match.

    Only texts that hold one of the trigrams are cut up, each within its row; nothing is shuffled.
    """
    folded, any_ = X.ascii_fold(F.col(text)), F.lit(False)
    for g in grams:
        any_ = any_ | F.contains(folded, F.lit(g))
    rows = docs.where(any_).select(key, word_trigrams(F.col(text)).alias("grams"))
    hits = F.size(F.array_intersect("grams", F.array(*map(F.lit, sorted(set(grams))))))
    return rows.select(key, hits.alias("hits"), F.size("grams").alias("n")).where("hits > 0").select(
        key, (F.col("hits") / (1 + F.log("n"))).alias("score")
    )


def conflict_regions(rows: DataFrame, key: str, begin: str = "<<<<<<<", end: str = ">>>>>>>") -> DataFrame:
    """(key, start, stop) of regions over (key, line_no, line): the last opener before a closer counts."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.last(F.when(F.startswith("line", F.lit(begin)), F.col("line_no")), True).over(w)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    closed = F.last(F.when(F.startswith("line", F.lit(end)), F.col("line_no")), True).over(before)
    marked = rows.withColumn("start", opened).withColumn("closed", closed)
    found = marked.where(F.startswith("line", F.lit(end)) & F.col("start").isNotNull())
    return found.where(F.col("closed").isNull() | (F.col("closed") < F.col("start"))).select(key, "start", F.col("line_no").alias("stop"))


def token_windows(rows: DataFrame, key: str, tokens: list[str], span: int = 3) -> DataFrame:
    """(key, line_no) of the last lines of windows of ``span`` lines that hold all tokens.

    A document is looked at only if all tokens occur somewhere in it.
    """
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-(span - 1), 0)
    every = Window.partitionBy(key)
    has = [F.contains("line", F.lit(t)) for t in tokens]
    for i, h in enumerate(has):
        rows = rows.withColumn(f"h{i}", h.cast("int"))
    for i in range(len(tokens)):
        rows = rows.withColumn(f"all{i}", F.max(f"h{i}").over(every))
    for i in range(len(tokens)):
        rows = rows.where(f"all{i} = 1")
    for i in range(len(tokens)):
        rows = rows.withColumn(f"w{i}", F.max(f"h{i}").over(w))
    ok = F.lit(True)
    for i in range(len(tokens)):
        ok = ok & (F.col(f"w{i}") == 1)
    return rows.where(ok).select(key, "line_no")
