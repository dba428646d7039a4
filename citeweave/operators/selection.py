"""Exact percentiles of columns of any size, within keys.

Each round brackets every wanted rank by two quantiles of a mergeable sketch and counts exactly what lies below, on and between them. A rank that falls on a bracket is found; for the others only the values strictly between
go on, some 3/GRID of the rows, so a few rounds leave few enough to sort. No task holds more than a sketch or FEW values of a key.

Nulls and NaN don't count; a key without values isn't there; between two ranks the percentile is interpolated, as percentile() does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import dropped, sent, staged

#: A key's values that may be sorted at once; the sketch's accuracy: ranks are off by 1/ACCURACY of the rows at most.
FEW, ACCURACY = 50_000, 10_000
#: Quantiles that brackets are taken from, each four times as far apart as the sketch may err.
GRID = 2500
#: Up to so many brackets (some 60 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_BRACKETS = 200_000


def percentiles(rows: DataFrame, column: str, fractions: tuple[float, ...], keys: tuple[str, ...] = (), few: int = FEW) -> DataFrame:
    """keys, fraction, value (double): the exact percentiles of column within each key, as a staged table."""
    names = [f"k_{n}" for n in range(len(keys))]
    values = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    sizes = staged(values.groupBy(*names).agg(F.count("*").alias("n")).where("n > 0"))
    place = F.col("fraction") * (F.col("n") - 1)
    wanted = sizes.withColumn("fraction", F.explode(F.array(*map(F.lit, map(float, fractions)))))
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    # every rank is a search of its own; rows of a key are read once for all of them
    left = staged(wanted.select(*names, "rank", F.col("n").alias("size"), F.col("rank").alias("nth")).distinct())
    pool, at, done = values, names, []
    while True:
        done.append(staged(_few(pool, left.where(F.col("size") <= few), names, at)))
        many = staged(left.where(F.col("size") > few))
        dropped(left)
        if many.isEmpty():
            dropped(many)
            break
        found, left, between = _round(pool, many, names, at)
        done.append(found)
        if pool is not values:
            dropped(pool)
        pool, at = between, [*names, "rank"]
        dropped(many)
    answer = reduce(DataFrame.unionByName, done)
    low = answer.select(*[F.col(n).alias(f"l_{n}") for n in names], F.col("rank").alias("l_rank"), F.col("x").alias("low"))
    high = answer.select(*[F.col(n).alias(f"h_{n}") for n in names], F.col("rank").alias("h_rank"), F.col("x").alias("high"))
    both = wanted.select(*names, "fraction", "n").distinct().withColumn("place", place)
    same = lambda p, rank: reduce(lambda a, b: a & b, [rank == F.col(f"{p}_rank"), *[F.col(n).eqNullSafe(F.col(f"{p}_{n}")) for n in names]])
    both = both.join(sent(low, BROADCAST_BRACKETS), same("l", F.floor("place"))).join(sent(high, BROADCAST_BRACKETS), same("h", F.ceil("place")))
    share = F.col("place") - F.floor("place")
    out = staged(both.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "fraction", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * (1 - share) + F.col("high") * share).alias("value")))
    dropped(sizes, *done)
    return out


def _met(pool: DataFrame, targets: DataFrame, at: list[str]) -> DataFrame:
    """The values beside the targets (a row for each rank that a key looks for) that they belong to. at: what pool is keyed by."""
    other = targets.select(*[F.col(c).alias(f"t_{c}") for c in targets.columns])
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in at] or [F.lit(True)]
    return pool.select(*at, "x").join(sent(other, BROADCAST_BRACKETS), reduce(lambda a, b: a & b, same)).select("x", *[F.col(f"t_{c}").alias(c) for c in targets.columns])


def _few(pool: DataFrame, targets: DataFrame, names: list[str], at: list[str]) -> DataFrame:
    """names, rank, x of targets with few values, which are sorted, once for all ranks that share them."""
    own = _met(pool, targets.select(*at, "size").distinct(), at).groupBy(*at).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    own = own.select("xs", *[F.col(c).alias(f"o_{c}") for c in at])
    same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in at] or [F.lit(True)]
    return targets.join(own, reduce(lambda a, b: a & b, same)).select(*names, "rank", F.get("xs", F.col("nth").cast("int")).alias("x"))


def _round(pool: DataFrame, targets: DataFrame, names: list[str], at: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found ranks, targets that are left with their new sizes and places, the values they are looked for among), all staged."""
    beside = _met(pool, targets, at)
    share = F.col("nth") / F.greatest(F.col("size") - 1, F.lit(1))
    keyed = [*names, "rank"]
    # the sketch is of a rank's own values, bracketed two steps to either side
    sketch = beside.groupBy(*keyed, "nth", "size").agg(F.percentile_approx("x", [n / GRID for n in range(GRID + 1)], F.lit(ACCURACY)).alias("q"))
    step = F.floor(share * GRID).cast("int")
    bracket = staged(sketch.select(*keyed, "nth", "size", F.get("q", F.greatest(step - 1, F.lit(0))).alias("lo"), F.get("q", F.least(step + 2, F.lit(GRID))).alias("hi")))
    beside = _met(pool, bracket, at)
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    counts = staged(beside.groupBy(*keyed, "nth", "size", "lo", "hi").agg(F.count_if(x < lo).alias("below"), F.count_if(x == lo).alias("on_lo"), F.count_if((x > lo) & (x < hi)).alias("between"), F.count_if((x == hi) & (hi > lo)).alias("on_hi")))
    k = F.col("nth") - F.col("below")
    upto = F.col("on_lo") + F.col("between")
    found = staged(counts.where((k >= 0) & (k < F.col("on_lo")) | (k >= upto) & (k < upto + F.col("on_hi"))).select(*keyed, F.when(k < F.col("on_lo"), lo).otherwise(hi).alias("x")))
    # a rank that the sketch misplaced goes on outside of its bracket
    where = lambda c, size, nth, over, under: counts.where(c).select(*keyed, size.alias("size"), nth.alias("nth"), over.cast("double").alias("over"), under.cast("double").alias("under"))
    none = F.lit(None)
    left = staged(
        where((k >= F.col("on_lo")) & (k < upto), F.col("between"), k - F.col("on_lo"), lo, hi)
        .unionByName(where(k < 0, F.col("below"), F.col("nth"), none, lo))
        .unionByName(where(k >= upto + F.col("on_hi"), F.col("size") - F.col("below") - upto - F.col("on_hi"), k - upto - F.col("on_hi"), hi, none))
    )
    between = staged(_met(pool, left, at).where("(over is null or x > over) and (under is null or x < under)").select(*keyed, "x"))
    dropped(bracket, counts)
    return found, left.drop("over", "under"), between
