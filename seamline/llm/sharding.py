"""Sharding by histogram sort.

Rows are ordered by a 64-bit key: CRC-32 of the text, then a 32-bit hash of doc_id, so equal texts stand together.
Exact bytes below candidate boundaries are counted across all partitions: first for 4,096 equal cells of the key space,
then again and again for 256 parts of those cells only in which a wanted splitter lies, until a boundary is within the
tolerance of the splitter's exact share (or a cell can't be split). One exchange by the histogram's cells follows; rows
are numbered in it with offsets from the cells' counts.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pin, table

SHARDS = 8
TOLERANCE = 0.002
FIRST_BITS, MORE_BITS = 12, 8
ROWS_PER_PART = 40_000
#: More offsets than these (a part has one for each of its one or two shards) are joined by a shuffle, with equal results.
MAX_BROADCAST_OFFSETS = 100_000


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; null: 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def sort_key(text: Column, doc_id: Column) -> Column:
    """Unsigned 64-bit key as a signed long of the same order."""
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")
    low = F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(crc - F.lit(1 << 31), 32).bitwiseOR(low)


def _cell(key: Column, bits: int) -> Column:
    """The first ``bits`` of the unsigned key, as a number from 0."""
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits < 64 else key


def find_splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE):
    """Exact splitters of (key, size) and the first histogram: (boundaries as unsigned keys, {cell: (bytes, rows)})."""
    first = {
        r.c: (r.b, r.n)
        for r in keys.groupBy(_cell(F.col("key"), FIRST_BITS).alias("c"))
        .agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
        .collect()
    }
    if not first:
        return [], first
    total = sum(b for b, _ in first.values())
    slack = tolerance * total / shards
    want = {i: total * i / shards for i in range(1, shards)}
    found: dict[int, int] = {}
    # A level holds, for each cell under study, its place (bytes below it) and the splitters that lie in it.
    level = {(): (0, sorted(want))}
    bits, hist = FIRST_BITS, {(): first}
    while level:
        deeper: dict[int, tuple[int, list[int]]] = {}
        for parent, (below, inside) in level.items():
            cells = sorted(hist.get(parent, {}).items())
            starts, at = [], below
            for _, (b, _) in cells:
                starts.append(at)
                at += b
            for i in inside:
                k = max(0, bisect.bisect_right(starts, want[i]) - 1)
                c, (b, n) = cells[k]
                lo, hi = starts[k], starts[k] + b
                near = c if want[i] - lo <= hi - want[i] else c + 1
                if min(want[i] - lo, hi - want[i]) <= slack or n == 1 or bits >= 64:
                    found[i] = near << (64 - bits) if near < 1 << bits else 1 << 64
                else:
                    deeper.setdefault(c, (lo, []))[1].append(i)
        if not deeper:
            break
        here, bits = bits, min(64, bits + MORE_BITS)
        mine = keys.where(_cell(F.col("key"), here).isin(*deeper))
        next_cell = _cell(F.col("key"), bits) if bits < 64 else F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
        hist = {c: {} for c in deeper}
        for r in (
            mine.groupBy(_cell(F.col("key"), here).alias("p"), next_cell.alias("c"))
            .agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
            .collect()
        ):
            hist[r.p][r.c % (1 << 64)] = (r.b, r.n)
        level = deeper
    return [found[i] for i in sorted(found)], first


def shard(
    docs: DataFrame, *, shards: int = SHARDS, tolerance: float = TOLERANCE, keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns of docs (doc_id by default) with size, text_crc32, law, shard, slot and grown_shard (null).

    Shards hold near equal bytes. Equal texts share a shard unless a splitter that meets the tolerance runs between
    them. slot numbers a shard's rows from 0 in key order. Null texts are empty, null ids allowed, repeated rows get
    slots of their own. An empty table gives an empty result.
    """
    own = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    keep = [c for c in (keep or ["doc_id"]) if c not in own]
    rows = docs.select(
        *[docs[f"`{c}`"].alias(f"k_{c}") for c in keep],
        byte_size(F.col("text")).alias("size"),
        sort_key(F.col("text"), F.col("doc_id")).alias("key"),
    )
    keys = pin(rows.select("key", "size"))
    splitters, first = find_splitters(keys, shards, tolerance)
    signed = [s - (1 << 63) for s in splitters]
    number = F.lit(0)
    for s in signed:
        number = number + (F.lit(0) if s >= 1 << 63 else (F.col("key") >= F.lit(s)).cast("int"))
    # Parts of the one exchange: consecutive cells up to ROWS_PER_PART rows; a larger cell is dealt by the low half.
    base, width, part, held = [0] * (1 << FIRST_BITS), [1] * (1 << FIRST_BITS), 0, 0
    for c in range(1 << FIRST_BITS):
        n = first.get(c, (0, 0))[1]
        if held and held + n > ROWS_PER_PART:
            part, held = part + 1, 0
        base[c], held = part, held + n
        if n > ROWS_PER_PART:
            width[c] = -(-n // ROWS_PER_PART)
            part, held = part + width[c], 0
    cell = (_cell(F.col("key"), FIRST_BITS) + 1).cast("int")
    within = F.floor(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)) * F.element_at(F.lit(width), cell) / F.lit(1 << 32))
    place = {"shard": number.cast("int"), "part": (F.element_at(F.lit(base), cell) + within).cast("int")}
    dealt = rows.withColumns(place)
    # Counted on the keys that were written, so that the texts are read once more only.
    counts = keys.withColumns(place).groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    order = Window.partitionBy("part", "shard").orderBy("key", *[f"k_{c}" for c in keep if c == "doc_id"], "size")
    placed = dealt.withColumn("rank", F.row_number().over(order)).join(
        F.broadcast(offsets) if (part + 1) * 2 + shards < MAX_BROADCAST_OFFSETS else offsets,
        (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s")),
    )
    crc = F.shiftright("key", 32) + F.lit(1 << 31)
    return placed.select(
        *[F.col(f"k_{c}").alias(c) for c in keep],
        "size",
        crc.alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
