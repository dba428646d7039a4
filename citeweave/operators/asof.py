"""As-of joins: each row with the last row of another table at or before it.

Both tables become one, in order of key and place; the last seen value is a scan over it, so nothing is compared with all rows of its key and a key that has most of the rows spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import LAST, scanned


def asof(left: DataFrame, right: DataFrame, on: tuple[str, ...], at: str, found: str = "found", ties: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """All rows and columns of left, with a struct column ``found``: the row of right with the same key and the largest ``at`` that isn't above left's (below it, if strict); null where there is none.

    Of right rows that agree in key and place the last in order of ``ties`` counts. Rows of either side with a null key or place match nothing; repeated left rows stay.
    """
    kind = right.schema.simpleString()
    known = right.where(" and ".join(f"`{c}` is not null" for c in (*on, at)))
    keys = [F.col(k).alias(f"k_{n}") for n, k in enumerate(on)]
    below = known.select(*keys, F.col(at).alias("k_at"), F.lit(1 if strict else 0).alias("k_side"), F.struct(*ties, F.lit(0)).alias("k_tie"), F.struct(*right.columns).alias("r"), F.lit(None).cast(left.schema.simpleString()).alias("l"))
    above = left.select(*keys, F.col(at).alias("k_at"), F.lit(0 if strict else 1).alias("k_side"), F.lit(None).cast(below.schema["k_tie"].dataType).alias("k_tie"), F.lit(None).cast(kind).alias("r"), F.struct(*left.columns).alias("l"))
    names = tuple(f"k_{n}" for n in range(len(on)))
    both = scanned(below.unionByName(above), names, (F.col("k_at"), F.col("k_side"), F.col("k_tie")), seen=(LAST, F.col("r")))
    return both.where("l is not null").select("l.*", F.col("seen").alias(found))
