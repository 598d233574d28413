"""What a list says about itself when it was cut: shown, total, unit, and the reason that stands first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons in order of precedence, and the largest total that is told exactly.
REASONS = ("time_limit", "walk", "depth", "budget", "cap", "kind")
CLAMP = 1_000_000_000


def first_reason(flags: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for r in reversed(REASONS):
        if r in flags:
            out = F.when(flags[r], F.lit(r)).otherwise(out)
    return out


def envelope(rows: DataFrame, shown: int, unit: str, *, exact: bool = True, causes: list[str] = (), narrow: str = "") -> DataFrame:
    """One row for the list of ``rows`` of which ``shown`` are given."""
    e = rows.agg(F.least(F.count(F.lit(1)), F.lit(CLAMP)).alias("total")).withColumn("shown", F.least(F.col("total"), F.lit(shown)))
    cut = F.col("shown") < F.col("total")
    held = [c for c in REASONS if c in causes]
    reason = F.when(cut | F.lit(bool(held)), F.lit(held[0] if held else "cap"))
    count = F.concat(F.lit("" if exact else "at least "), F.col("total").cast("string"))
    trailer = F.concat(F.lit("["), F.col("shown").cast("string"), F.lit(" of "), count, F.lit(f" {unit}"), F.lit(f"; {narrow}]" if narrow else "]"))
    return e.select("shown", "total", F.lit(unit).alias("unit"), F.lit(exact).alias("exact"), reason.alias("reason"), F.when(reason.isNotNull(), trailer).alias("trailer"))
