"""Manual marks."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliocheck import constants as C


def check_marks(marks: DataFrame, books: DataFrame) -> DataFrame:
    """Per book: how many marks, how many are invalid, and whether the set is accepted.

    One invalid mark rejects the whole set of its book.
    """
    ids = marks.groupBy("book_id", "mark_id").agg(F.count("*").alias("copies"))
    counts = books.select("book_id", "page_count")
    m = marks.join(ids, ["book_id", "mark_id"]).join(counts, "book_id", "left")
    bad = (F.col("mark_id").isNull() | (F.col("mark_id") == "") | (F.length("mark_id") > 200) | (F.col("copies") > 1)
           | ~F.col("mark_type").isin(C.MARK_TYPES) | ~F.col("page").between(1, F.coalesce("page_count", F.lit(0)))
           | (F.length("comment") > 10000) | (F.col("mx") < 0) | (F.col("my") < 0) | (F.col("mw") <= 0) | (F.col("mh") <= 0)
           | (F.col("mx") + F.col("mw") > 100.01) | (F.col("my") + F.col("mh") > 100.01))
    g = m.groupBy("book_id").agg(F.count("*").alias("marks"), F.count_if(F.coalesce(bad, F.lit(True))).alias("invalid"))
    return g.withColumn("accepted", (F.col("invalid") == 0) & (F.col("marks") <= 10000))
