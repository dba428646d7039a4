"""Joins of half-open intervals [start, end) by key: overlap and containment.

An interval has the level of its length in bits, and a level's bins are as wide as 2^level, so an interval lies in two bins of its own level (three where rounding puts it a level low). Two intervals meet in a bin of the higher of their levels: the one of that level owns the
bin, the other goes there from below. Each pair is reported by the first bin that both are in. Rows multiply by the few levels that the other side has, whatever the lengths, and join on (key, level, bin) by equality: a key with most of the spans is many bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP, WITHIN = "overlap", "within"


def _level(start: Column, end: Column) -> Column:
    return F.greatest(F.ceil(F.log2((end - start).cast("double"))), F.lit(0)).cast("int")


def _levels(rows: DataFrame) -> list[int]:
    """The levels that a table has: 64 at most."""
    return sorted(r["level"] for r in rows.select("level").distinct().collect())


def _prepared(rows: DataFrame, on: tuple[str, ...], span: tuple[str, str], name: str) -> DataFrame:
    start, end = (F.col(c).cast("long") for c in span)
    known = rows.where(f"`{span[0]}` < `{span[1]}`")  # neither null nor empty
    return known.select(*[F.col(k).alias(f"k_{n}") for n, k in enumerate(on)], start.alias("start"), end.alias("end"), _level(start, end).alias("level"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(name))


def _binned(rows: DataFrame, own: str, other: str, others: list[int]) -> DataFrame:
    """rows for each bin: of their own level (side ``own``), and of the other table's levels above it (side ``other``), whose rows own those bins. Where levels are equal, the left side owns the bin."""
    theirs = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda c: c > F.col("level") if own == "l" else c >= F.col("level"))
    to = F.concat(F.array(F.struct(F.lit(own).alias("side"), F.col("level").alias("at"))), F.transform(theirs, lambda c: F.struct(F.lit(other).alias("side"), c.alias("at"))))
    out = rows.withColumn("to", F.explode(to)).withColumns({"side": F.col("to.side"), "at": F.col("to.at")})
    shift = lambda x: F.call_function("shiftright", x, F.col("at"))
    return out.withColumn("first_bin", shift(F.col("start"))).withColumn("bin", F.explode(F.sequence(F.col("first_bin"), shift(F.col("end") - 1)))).drop("to", "level")


def joined(left: DataFrame, right: DataFrame, on: tuple[str, ...], how: str = OVERLAP, left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """l, r (structs, the rows of left and right): pairs with equal keys whose spans overlap, or with WITHIN those whose right span lies in the left one.

    Spans that are empty or have a null end, and rows with null keys, match nothing; repeated rows give repeated pairs.
    Both sides are dealt by key and bin: Spark takes them to be as small as the files they are read from, which say nothing of the rows that lists and bins make of them, so it would send either to the driver.
    """
    l_rows, r_rows = _prepared(left, on, left_span, "l"), _prepared(right, on, right_span, "r")
    l_binned, r_binned = _binned(l_rows, "l", "r", _levels(r_rows)), _binned(r_rows, "r", "l", _levels(l_rows))
    keys = [f"k_{n}" for n in range(len(on))]
    a = l_binned.select(*keys, "side", "at", "bin", F.col("start").alias("l_start"), F.col("end").alias("l_end"), F.col("first_bin").alias("l_first"), "l")
    b = r_binned.select(*keys, "side", "at", "bin", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("first_bin").alias("r_first"), "r")
    met = "l_start <= r_start and r_end <= l_end" if how == WITHIN else "l_start < r_end and r_start < l_end"
    return a.join(b.hint("merge"), [*keys, "side", "at", "bin"]).where("bin = greatest(l_first, r_first)").where(met).select("l", "r")
