"""Which texts hold which needles, by an index of grams.

A needle can only be in a text that has all its grams (runs of Q characters), so each needle is looked up by one of them, the one that is rarest in a sample of the texts; any gram would give the same rows. Texts and needles meet by equality of that gram; only such pairs are searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import dropped, sent, staged

Q = 3
#: One in so many texts tells how frequent grams are.
SAMPLE = 16
#: Up to so many grams of needles (some 40 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_GRAMS = 1 << 18


def grams(c: Column, q: int = Q) -> Column:
    """The different runs of q characters of a text, in one pass over its characters; a shorter one has none."""

    def runs(chars: Column) -> Column:
        last = F.size(chars) - q + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(*[F.element_at(chars, i + k) for k in range(q)]))).otherwise(F.array().cast("array<string>"))

    chars = F.array_remove(F.split(c, ""), "")
    return F.array_distinct(F.get(F.transform(F.array(chars), runs), F.lit(0)))  # bound once, used for each place


def containing(texts: DataFrame, needles: DataFrame, text: str, needle: str, text_id: tuple[str, ...], on: tuple[str, ...] = (), q: int = Q) -> DataFrame:
    """t, n (structs, rows of texts and needles): pairs with equal ``on`` columns where the text holds the needle.

    text_id names rows of texts and must be unique. Needles shorter than q meet by grams of their own length. Null and empty needles, null texts and rows with a null id or ``on`` column match nothing; repeated needles give repeated pairs.
    """
    t = texts.where(F.col(text).isNotNull()).select(*[F.col(c).alias(f"id_{k}") for k, c in enumerate(text_id)], *[F.col(c).alias(f"on_{k}") for k, c in enumerate(on)], F.col(text).alias("text"), F.struct(*texts.columns).alias("t"))
    ids, ons = [f"id_{k}" for k in range(len(text_id))], [f"on_{k}" for k in range(len(on))]
    size = F.least(F.length(needle), F.lit(q))
    own = needles.where(F.length(needle) > 0).select(*[F.col(c).alias(f"on_{k}") for k, c in enumerate(on)], F.col(needle).alias("needle"), size.alias("size"), F.struct(*needles.columns).alias("n"))
    own = own.withColumn("grams", _sized("needle", q))
    asked = staged(own.select(F.explode("grams").alias("gram")).distinct())
    sizes = {r["size"] for r in own.select("size").distinct().collect()}  # q at most
    if not sizes:  # no needles
        sizes = {q}
    every = F.flatten(F.array(*[grams(F.col("text"), k) for k in sorted(sizes)]))
    some = t.where(F.pmod(F.xxhash64(*ids), F.lit(SAMPLE)) == 0)
    often = some.select(F.explode(every).alias("gram")).join(sent(asked, BROADCAST_GRAMS), "gram").groupBy("gram").agg(F.count("*").alias("often"))
    often = staged(asked.join(often, "gram", "left").select("gram", F.coalesce("often", F.lit(0)).alias("often")))
    ranked = own.select("needle", F.explode("grams").alias("gram")).distinct().join(sent(often, BROADCAST_GRAMS), "gram")
    rarest = staged(ranked.groupBy("needle").agg(F.min(F.struct("often", "gram"))["gram"].alias("gram")))
    dropped(asked, often)
    chosen = rarest.select("gram").distinct()
    held = t.select(*ids, *ons, F.explode(every).alias("gram")).join(sent(chosen, BROADCAST_GRAMS), "gram")
    pairs = held.join(own.join(rarest, "needle").select(*ons, "needle", "gram", "n"), [*ons, "gram"])
    return pairs.join(t.drop(*ons), ids).where(F.contains("text", F.col("needle"))).select("t", "n")


def _sized(needle: str, q: int) -> Column:
    """Grams of a needle: of q characters, or the needle itself if it is shorter."""
    return F.when(F.length(needle) < q, F.array(needle)).otherwise(grams(F.col(needle), q))
