"""Table functions for SQL: cite templates of a markup, and the first rows of each group.

register() names them in a session::

    SELECT p.pageid, c.* FROM pages p, LATERAL cites(p.content) c
    SELECT * FROM first_rows(TABLE(candidates) PARTITION BY term_ord ORDER BY hit_ord, para_ord, 6)
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException

from . import wikitext


class Cites:
    """nth (from 0), type, url, blurb of each cite template; a null markup has none."""

    def eval(self, content: str):
        for n, c in enumerate(wikitext.cites(content or "")):
            yield n, c["type"], c["url"], c["blurb"]


class FirstRows:
    """The rows of its table argument with rank (from 1), the first ``most`` of each partition in its order. What follows them in a partition isn't handed to Python."""

    def __init__(self) -> None:
        self.rank = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or most.value is None or most.value < 0:
            raise ValueError("first_rows takes a table and a constant number of rows, 0 or more")
        return AnalyzeResult(schema=StructType([*rows.dataType.fields]).add("rank", IntegerType()))

    def eval(self, row: Row, most: int):
        self.rank += 1
        if self.rank > most:
            raise SkipRestOfInputTableException("enough rows")
        yield (*row, self.rank)


def register(spark: SparkSession) -> None:
    spark.udtf.register("cites", udtf(Cites, returnType="nth: int, type: string, url: string, blurb: string"))
    spark.udtf.register("first_rows", udtf(FirstRows))
