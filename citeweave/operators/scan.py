"""Prefix scans: what an associative step makes of a row and all rows before it, within a key.

Rows are dealt by range of key and order over many tasks. Each task runs the step over its own rows; what a task holds of a key becomes one row, and where a key goes on from one task to the next, these rows are scanned themselves and
carried on. A task has at most one key that comes from before, so no more carries than tasks exist, and a key that has most of the rows is spread like any other.

Null keys are a key of their own; order must leave no ties, or ties follow as they come.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


@dataclass(frozen=True)
class Step:
    """over: an aggregate of rows in order; merged: of results in order; joined: of an earlier result and a later one, of which either may be null."""

    over: Callable[[Column], Column]
    merged: Callable[[Column], Column]
    joined: Callable[[Column, Column], Column]


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


SUM = Step(F.sum, F.sum, _added)
COUNT = Step(F.count, F.sum, _added)
MAX = Step(F.max, F.max, F.greatest)
MIN = Step(F.min, F.min, F.least)
#: The last value that isn't null.
LAST = Step(_last, _last, lambda a, b: F.coalesce(b, a))


def scanned(rows: DataFrame, keys: tuple[str, ...], order: tuple, before: bool = False, **columns: tuple[Step, Column]) -> DataFrame:
    """rows with a column for each (step, value) of columns: the step over the values of its key's rows up to this one, or, with ``before``, of those before it (null where there are none).

    Reads a table staged for it.
    """
    dealt = rows.repartitionByRange(*map(F.col, keys), *order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part", *keys).orderBy(*order)
    upto, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    inside = {f"_upto_{n}": step.over(value).over(upto) for n, (step, value) in columns.items()}
    shown = {f"_ahead_{n}": step.over(value).over(ahead) for n, (step, value) in columns.items()} if before else {}
    table = staged(dealt.withColumns({"_nth": F.row_number().over(own), **inside, **shown}))
    totals = table.groupBy("_part", *keys).agg(*[F.max_by(f"_upto_{n}", "_nth").alias(f"_upto_{n}") for n in columns])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_part").alias("c_part"), *[F.col(k).alias(f"c_{n}") for n, k in enumerate(keys)], F.count("*").over(earlier).alias("c_parts"), *[step.merged(F.col(f"_upto_{n}")).over(earlier).alias(f"_from_{n}") for n, (step, _) in columns.items()])
    carried = F.broadcast(carried.where("c_parts > 0").drop("c_parts"))  # one row a task at most
    same = reduce(lambda a, b: a & b, [F.col("_part") == F.col("c_part"), *[F.col(k).eqNullSafe(F.col(f"c_{n}")) for n, k in enumerate(keys)]])
    out = table.join(carried, same, "left")
    results = {n: step.joined(F.col(f"_from_{n}"), F.col(f"_{'ahead' if before else 'upto'}_{n}")) for n, (step, _) in columns.items()}
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[v.alias(n) for n, v in results.items()])


def numbered(rows: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """rows with rank from 1 within each key."""
    return scanned(rows, keys, order, rank=(COUNT, F.lit(1))).withColumn("rank", F.col("rank").cast("int"))
