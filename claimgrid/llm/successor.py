"""The next row in the order of a whole-number id, without a window over all rows.

Ids are dealt into spans of consecutive values, so a span has a bounded number of distinct ids however rows are spread. Inside a
span the next row comes from a window; the last row of a span is joined with the first row of the next span that has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SPAN, SPANS = 256, 4096


def next_spans(spans: DataFrame) -> DataFrame:
    """(span, next_span) for distinct spans; the first one follows the last. Only one row per `SPANS` spans meets in one task."""
    top = F.floor(F.col("span") / SPANS)
    inside = spans.withColumn("top", top).withColumn("own", F.lead("span").over(W.partitionBy("top").orderBy("span")))
    heads = inside.groupBy("top").agg(F.min("span").alias("head"))
    ring = W.orderBy("top")
    heads = heads.select(F.col("top").alias("t"), F.coalesce(F.lead("head").over(ring), F.first("head").over(ring.rowsBetween(W.unboundedPreceding, 0))).alias("after"))
    return inside.join(heads, F.col("top") == F.col("t")).select("span", F.coalesce("own", "after").alias("next_span"))


def spanned(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with span; null ids come first, in a span of their own."""
    return rows.withColumn("span", F.coalesce(F.floor(F.col(id_col) / SPAN), F.lit(-(1 << 62))))


def inner_pairs(rows: DataFrame, carried: dict, order) -> DataFrame:
    """rows(span, ...) that have a next row in their span, with the next row's columns under the names in carried {new: old}."""
    w = W.partitionBy("span").orderBy(*order)
    return rows.withColumns({new: F.lead(old).over(w) for new, old in carried.items()} | {"inside": F.lead(F.lit(1)).over(w)}).where("inside = 1").drop("inside")


def outer_pairs(rows: DataFrame, carried: dict, order) -> DataFrame:
    """The last row of each span, with columns of the first row of the next span (its own, if it is the only row)."""
    turn = F.row_number().over(W.partitionBy("span").orderBy(*order))
    back = F.row_number().over(W.partitionBy("span").orderBy(*(F.desc_nulls_last(c) for c in order)))
    first = rows.withColumn("turn", turn).where("turn = 1").select(F.col("span").alias("next_span"), *(F.col(old).alias(new) for new, old in carried.items()))
    last = rows.withColumn("turn", back).where("turn = 1").drop("turn")
    return last.join(next_spans(rows.select("span").distinct()), "span").join(first, "next_span").drop("next_span")
