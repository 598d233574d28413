"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A paragraph (a line that isn't blank) is hashed to a wide vector: the sum, over its units, of the bits of two 64-bit
hashes. Units are the paragraph itself and every two neighbouring words of it. A document's fingerprint is the sum of
its paragraphs' vectors modulo 2**64 in each of 126 counters: the order of paragraphs doesn't matter, and a paragraph is
put in or taken out by adding or subtracting its vector (``put_in``, ``take_out``). As every bit is a fair coin, the
counters also give an unbiased estimate of what two multisets have in common, hence a likeness; its standard error is
about 0.09 for unlike texts.

While units are summed, three counters share a long, for at most ``CHUNK`` units at a time, so no counter ever runs into
the next one; the chunks' counters are then added one by one. A counter is at most the number of units, so that no text
that a string can hold wraps it. A null or empty text has a zero vector. Rows of equal id and text are one with a count;
repeated ids with unlike texts have a fingerprint each. Very long texts are one task's work but not one sum's. Only
named columns are read, so extra ones can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pin, table

LANE_BITS, LANES, HASHES = 21, 3, 2
LANE = (1 << LANE_BITS) - 1
MASK = sum(1 << LANE_BITS * j for j in range(LANES))
SUMS = HASHES * LANE_BITS
COUNTERS = SUMS * LANES
#: Less than a lane holds.
CHUNK = 1 << 20
SPLITS = (8, 14, 14, 14)


def _units(text: Column) -> Column:
    paragraphs = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    # A word with what follows is consumed, and the next word seen, so pairs overlap; no position is tried twice.
    pairs = F.lit(r"(?<!\S)(?=(\S++\s++\S++))\S++\s++")
    return F.flatten(F.transform(paragraphs, lambda p: F.concat(F.array(p), F.regexp_extract_all(p, pairs, F.lit(1)))))


def _zero() -> Column:
    return F.array_repeat(F.lit(0).cast("long"), COUNTERS)


def put_in(vec: Column, other: Column) -> Column:
    """The vector with the paragraphs of another one."""
    return F.zip_with(vec, other, lambda x, y: x + y)


def take_out(vec: Column, other: Column) -> Column:
    """The vector without the paragraphs of another one."""
    return F.zip_with(vec, other, lambda x, y: x - y)


def _unpacked(sums: Column) -> Column:
    def lane(j: int) -> Column:
        return F.transform(sums, lambda x: F.shiftright(x, LANE_BITS * j).bitwiseAND(F.lit(LANE)))

    return F.concat(*[lane(j) for j in range(LANES)])


def _summed(rows: DataFrame, keys: list[str], texts: list[str], carried: list[str]) -> DataFrame:
    """keys, carried and ``sums``, an array of (part, units, sums): for each of ``texts`` (part) its chunks' sums."""
    cut = rows.select(*keys, *carried, *[_units(F.col(t)).alias(f"u{i}") for i, t in enumerate(texts)])
    ends, end = [], F.lit(0)
    for i in range(len(texts)):
        end = end + F.size(f"u{i}")
        ends.append(end.alias(f"e{i}"))
    # The null unit at the end keeps a row without units.
    every = F.concat(*[F.col(f"u{i}") for i in range(len(texts))], F.array(F.lit(None).cast("string")))
    u = cut.select(*keys, *carried, *ends, every.alias("u"))
    u = u.select(*keys, *carried, *[f"e{i}" for i in range(len(texts))], F.posexplode("u").alias("pos", "unit"))
    part = F.lit(len(texts) - 1)
    for i in reversed(range(len(texts) - 1)):
        part = F.when(F.col("pos") < F.col(f"e{i}"), F.lit(i)).otherwise(part)
    u = u.withColumns({"part": part, "chunk": F.expr(f"pos div {CHUNK}")})
    hashes = [F.xxhash64("unit"), *[F.xxhash64(F.lit(k), F.col("unit")) for k in range(1, HASHES)]]
    u = u.withColumns({f"h{k}": F.when(F.col("unit").isNotNull(), h).otherwise(F.lit(0)) for k, h in enumerate(hashes)})
    chunks = u.groupBy(*keys, "part", "chunk").agg(
        *[F.max(c).alias(c) for c in carried],
        F.count("unit").alias("units"),
        *[
            F.sum(F.shiftright(f"h{k}", i).bitwiseAND(F.lit(MASK))).alias(f"s{k * LANE_BITS + i}")
            for k in range(HASHES)
            for i in range(LANE_BITS)
        ],
    )
    one = F.struct("part", "units", F.array(*[F.col(f"s{i}") for i in range(SUMS)]).alias("s"))
    return chunks.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carried], F.collect_list(one).alias("sums"))


def _of_parts(parts: tuple[int, ...]) -> tuple[Column, Column]:
    """Units and vector of the given parts together, from ``sums``."""
    mine = F.filter("sums", lambda x: x["part"].isin(*parts))
    units = F.aggregate(mine, F.lit(0).cast("long"), lambda n, x: n + x["units"])
    return units, F.aggregate(mine, _zero(), lambda v, x: put_in(v, _unpacked(x["s"])))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A row for each group of equal rows of ``docs``: the keys, copies (equal rows), units and vec.

    ``keys`` must decide the text.
    """
    whole = F.coalesce(F.max(text), F.lit("")).alias("text")
    rows = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), whole)
    units, vec = _of_parts((0,))
    return _summed(rows, keys, ["text"], ["copies"]).select(*keys, "copies", units.alias("units"), vec.alias("vec"))


def likeness(a: Column, a_units: Column, b: Column, b_units: Column) -> Column:
    """2 <a, b> / (<a, a> + <b, b>) of the counters as sums of signs, within 0 and 1; two empty ones are alike."""

    def both(x: Column, y: Column) -> Column:
        s, t = (2 * x - a_units).cast("double"), (2 * y - b_units).cast("double")
        return F.struct((s * t).alias("ab"), (s * s + t * t).alias("sq"))

    sums = F.aggregate(
        F.zip_with(a, b, both),
        F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("sq")),
        lambda s, x: F.struct((s["ab"] + x["ab"]).alias("ab"), (s["sq"] + x["sq"]).alias("sq")),
        lambda s: F.when(s["sq"] == 0, F.lit(1.0)).otherwise(2 * s["ab"] / s["sq"]),
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sums))


def as_text(vec: Column, units: Column) -> Column:
    """Units and counters, eight hex digits each."""
    digits = F.transform(F.concat(F.array(units), vec), lambda x: F.lpad(F.hex(x), 8, "0"))
    return F.array_join(digits, "")


def successors(keys: DataFrame, splits: tuple[int, ...] = SPLITS) -> DataFrame:
    """(key, next) for distinct (key, first): the first of the next greater key, after the last that of the least.

    Keys are ordered within ranges of bounded width; the last of a range asks the ranges, which are ordered alike.
    """
    if not splits:
        w = Window.orderBy("key")
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return keys.select("key", F.coalesce(F.lead("first").over(w), F.first("first").over(every)).alias("next"))
    keys = keys.withColumn("up", F.shiftright("key", splits[0]))
    own = keys.withColumn("own", F.lead("first").over(Window.partitionBy("up").orderBy("key")))
    above = successors(keys.groupBy(F.col("up").alias("key")).agg(F.min("first").alias("first")), splits[1:])
    return own.join(above.withColumnRenamed("key", "k"), F.col("up") == F.col("k")).select(
        "key", F.coalesce("own", "next").alias("next")
    )


def _edit(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, start) with n_chars and the edited text, and the lines before the edit (head), those of the
    text from it on (tail), and those of the edited text (new_tail)."""
    n = F.length("text")
    rows = rows.withColumn("kept", F.expr("left(text, length(text) - length(text) div 4)"))
    rows = rows.withColumn("begun", F.substring_index("kept", "\n", -1))
    put = F.coalesce(F.expr("left(start, cast(length(text) div 4 as int))"), F.lit(""))
    before = F.length("kept") - F.length("begun")
    return rows.select(
        "doc_id",
        "text",
        n.cast("long").alias("n_chars"),
        F.concat("kept", put).alias("edited"),
        F.left("kept", before).alias("head"),
        F.substr("text", before + 1).alias("tail"),
        F.concat("begun", put).alias("new_tail"),
    )


def _dealt(docs: DataFrame) -> DataFrame:
    """Texts dealt by doc_id, so that all that is joined or grouped by it later shares the one exchange."""
    named = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return named.repartition("doc_id")


def _nameless(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("start"))


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next, most): each id's next one, and the most characters that a row of it replaces."""
    size = F.length(F.coalesce("text", F.lit("")))
    ids = pin(docs.where("doc_id is not null").select("doc_id", size.alias("n")).groupBy("doc_id").agg(F.max(F.expr("n div 4")).alias("most")))
    order = successors(ids.select(F.col("doc_id").cast("long").alias("key"), F.col("doc_id").cast("long").alias("first")))
    return pin(order.join(ids, F.col("key") == F.col("doc_id")).select(F.col("key").alias("doc_id"), "next", "most"))


def _starts(dealt: DataFrame, need: DataFrame) -> DataFrame:
    wanted = need.select(F.col("next").alias("donor"), F.col("doc_id").alias("taker"), "most")
    joined = dealt.join(wanted, F.col("doc_id") == F.col("donor"))
    return joined.groupBy("taker").agg(F.min(F.expr("left(text, cast(most as int))")).alias("start"))


def with_edits(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, n_chars, edited) for every row, and the (doc_id, next_id) it is made by.

    The last quarter is replaced by the start of the next document. Rows of equal doc_id have the same next one; where
    several rows are next, the least start is taken. A row without doc_id has no next document. Texts are dealt by
    doc_id once, for givers and takers alike; only the starts that are wanted move again.
    """
    need, dealt = next_ids(docs), _dealt(docs)
    joined = dealt.join(_starts(dealt, need), F.col("doc_id") == F.col("taker")).select("doc_id", "text", "start")
    edited = _edit(joined.unionByName(_nameless(docs))).select("doc_id", "text", "n_chars", "edited")
    return edited, need.select("doc_id", F.col("next").alias("next_id"))


def _digest_parts(text: Column) -> dict[str, Column]:
    """SHA-256 as eight numbers, which hash aggregation can carry."""
    digest = F.sha2(text, 256)
    return {f"d{i}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)}


def _prints(rows: DataFrame) -> DataFrame:
    """For each id and text of edited rows: copies, n_chars, digest, own and edited fingerprint. The lines before the
    edit are summed once for both."""
    keys, parts = ["doc_id", "t"], ["head", "tail", "new_tail"]
    digest = _digest_parts(F.col("edited"))
    rows = rows.withColumn("t", F.md5("text")).withColumns(digest)
    numbers = ["n_chars", *digest]
    one = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(c) for c in [*numbers, *parts]]
    )
    (own_units, own), (edited_units, edited) = _of_parts((0, 1)), _of_parts((0, 2))
    return _summed(one, keys, parts, ["copies", *numbers]).select(
        *keys,
        "copies",
        "n_chars",
        F.concat(*[F.lower(F.lpad(F.hex(d), 8, "0")) for d in digest]).alias("edited_sha256"),
        own_units.alias("units"),
        # At most the number of units of a string, so an int holds it.
        own.cast("array<int>").alias("vec"),
        edited_units.alias("edited_units"),
        edited.cast("array<int>").alias("edited_vec"),
    )


def _result(prints: DataFrame, near_next: Column) -> DataFrame:
    vec, edited = F.col("vec").cast("array<long>"), F.col("edited_vec").cast("array<long>")
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(vec, F.col("units")).alias("fingerprint"),
        as_text(edited, F.col("edited_units")).alias("edited_fingerprint"),
        likeness(vec, F.col("units"), edited, F.col("edited_units")).alias("near_edited"),
        near_next.alias("near_next"),
        "copies",
    ).select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copies", "copy")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """A row for every row of docs (doc_id, text), as op7 returns them. Rows of equal id have the same next document;
    of several texts of it, the one of the least digest is compared. A row without id has no next document: its text is
    cut, and near_next is 0."""
    need, dealt = next_ids(docs), _dealt(docs)
    joined = dealt.join(_starts(dealt, need), F.col("doc_id") == F.col("taker")).select("doc_id", "text", "start")
    prints = pin(_prints(_edit(joined)))
    order = need.select(F.col("doc_id").alias("of"), F.col("next").alias("next_id"))
    after = (
        prints.groupBy("doc_id")
        .agg(F.min(F.struct("t", "units", "vec")).alias("x"))
        .join(order, F.col("doc_id") == F.col("next_id"))
        .select("of", F.col("x.vec").cast("array<long>").alias("next_vec"), F.col("x.units").alias("next_units"))
    )
    near = likeness(F.col("vec").cast("array<long>"), F.col("units"), F.col("next_vec"), F.col("next_units"))
    named = _result(prints.join(after, F.col("doc_id") == F.col("of")), near)
    return named.unionByName(_result(_prints(_edit(_nameless(docs))), F.lit(0.0)))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
