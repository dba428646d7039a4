"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Defined results: a null or empty text has no words, fails the length rule and is not kept; repeated rows are judged each
on its own; nulls in other columns and extra columns pass through untouched; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP_CHARS, words

#: Frequent function words of the four languages.
STOP_WORDS = (
    "a an and are as at be but by for from has have he in is it its of on or that the this to was were which will with you "
    "au aux avec ce ces dans de des du elle en est et il la le les mais ou par pas pour que qui se sur un une "
    "al como con del el las lo los más no para por si sin su sus una y "
    "als am auch auf aus bei das dem den der die dies ein eine einer es für ich im ist mit nicht sich sie so und von werden wie zu"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``left * numerator`` against ``right * denominator``; whole numbers, so every engine agrees."""

    name: str
    left: str
    times: int
    op: str
    right: str
    by: int


#: A text is rejected if any of these holds. Bounds are wide: they catch what no prose does.
RULES = (
    Rule("few_words", "n_words", 1, "<", "one", 50),
    Rule("repeated_words", "n_repeat_words", 100, ">", "n_words", 50),
    Rule("short_words", "word_chars", 1, "<", "n_words", 2),
    Rule("long_words", "word_chars", 1, ">", "n_words", 16),
    Rule("symbols", "n_symbols", 100, ">", "n_words", 20),
    Rule("no_stop_words", "n_stop_words", 100, "<", "n_words", 1),
    Rule("repeated_lines", "n_dup_lines", 100, ">", "n_lines", 40),
)
BASE = ("few_words", "repeated_words")


def measured(docs: DataFrame, text: str = "text", stop_words=tuple(STOP_WORDS), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, then one long column for each measure. Built-in functions only, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    n3 = F.greatest(F.size("q_words") - 2, F.lit(0))
    out = docs.select(*keep, t.alias("q_text"), words(F.col(text)).alias("q_words"))
    out = out.select(
        *keep,
        F.size("q_words").cast("long").alias("n_words"),
        F.length(F.translate("q_text", WORD_GAP_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("q_text") - F.length(F.translate("q_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(F.filter("q_words", lambda w: F.lower(w).isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.filter(F.split("q_text", "\n"), lambda x: F.length(F.translate(x, WORD_GAP_CHARS, "")) > 0).alias("q_lines"),
        F.transform(F.slice("q_words", 1, n3), lambda w, i: F.xxhash64(w, F.get("q_words", i + 1), F.get("q_words", i + 2))).alias("q_three"),
    )
    # only texts in which some window of three words comes back pay for the sort
    back = F.size(F.array_distinct("q_three")) < F.size("q_three")
    pairs = F.array_sort(F.transform("q_three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("n_lines", F.size("q_lines").cast("long")).withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long")).drop("q_lines")
    out = out.withColumn("q_sorted", F.when(back, pairs)).drop("q_three")
    found = F.filter("q_sorted", lambda x, k: (x["h"] == F.get("q_sorted", k + 1)["h"]) | (x["h"] == F.get("q_sorted", k - 1)["h"]))
    out = out.withColumn("q_at", F.array_sort(F.transform(found, lambda x: x["i"]))).drop("q_sorted")
    covered = F.aggregate(F.transform("q_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("q_at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("q_at")


def broken(rule: Rule):
    """Column: whether the measures break the rule."""
    left = F.col(rule.left) * rule.times
    right = (F.lit(1) if rule.right == "one" else F.col(rule.right)) * rule.by
    return left < right if rule.op == "<" else left > right


def any_broken(rules):
    out = F.lit(False)
    for rule in rules:
        out = out | broken(rule)
    return out


def verdicts(docs: DataFrame, rules=RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """measured(), and broken_rules (names), base_failed, kept."""
    out = measured(docs, text, keep=keep)
    names = F.filter(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return out.select("*", names.alias("broken_rules"), any_broken([r for r in rules if r.name in BASE]).alias("base_failed"), (~any_broken(rules)).alias("kept"))


def passing(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that break no rule."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row"), F.col(f"`{text}`").alias("q_source"))
    # a projection with a row number lets no filter through: pushed below, the verdict's expressions would be nested into one another
    stays = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    out = verdicts(row, rules, "q_source", keep=("q_row",)).select("q_row", stays.alias("q_stays")).where("q_stays")
    return out.select(*[F.col("q_row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rule(r: Rule) -> str:
    return f"({r.left} * {r.times} {r.op} {'1' if r.right == 'one' else r.right} * {r.by})"


SQL = rf"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS x,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
w AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM t),
g AS (SELECT r, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM f, (VALUES (0), (1), (2)) v(k) WHERE n >= 2 GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(list_filter(ws, lambda w: lower(w) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})))::BIGINT AS n_stop_words,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {" OR ".join(_sql_rule(r) for r in RULES if r.name in BASE)} AS base_failed,
       NOT ({" OR ".join(_sql_rule(r) for r in RULES)}) AS kept
FROM m
"""
