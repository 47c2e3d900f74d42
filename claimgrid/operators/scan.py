"""Ordered scans over groups of any size.

A plain window over a key puts the whole key into one task.  Here rows are dealt into chunks that rise with the order: the window
runs per (key, chunk), each chunk is reduced to one summary row, the summaries (few per key) are scanned, and the carry is joined
back.  A hot key is so spread over its chunks.  The caller names a chunk column (a date, a block of row numbers), or leaves the
chunks to sampled bounds over key, order and a hash of the row, which also cut runs of equal values and sparse numbers evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgrid.session import cut_lineage

BLOCK = 4096


def block(position: Column, size: int = BLOCK) -> Column:
    """Chunk of a dense position column."""
    return F.floor(position / size)


def ranged(df: DataFrame, keys: list, order: list, name: str) -> DataFrame:
    """df with its chunk by sampled bounds, as many as shuffle partitions, written to the shared folder so that it stays what it
    is.  Rows that agree in keys and order are told apart by a hash of the whole row."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = "__tie"
    kinds = dict(df.dtypes)
    hashed = df.withColumn(ties, F.xxhash64(*(F.to_json(c) if kinds[c].startswith("map") else c for c in df.columns)))
    return cut_lineage(hashed.repartitionByRange(n, *keys, *order, ties).withColumn(name, F.spark_partition_id()).drop(ties))


def scan(df: DataFrame, keys: list, chunk: Column | None, order: list, *, sums: dict | None = None,
         fills: dict | None = None, maxes: dict | None = None, before: dict | None = None,
         exclusive: bool = False) -> DataFrame:
    """Add running columns: sums (NULL counts as 0), fills (last non-NULL), maxes, before (last non-NULL of earlier rows).

    Each dict maps a new column to a Column over df.  With exclusive=True the row itself is left out everywhere.  chunk=None takes
    chunks by sampled bounds (`ranged`); order is then a list of columns of df.
    """
    sums, fills, maxes, before = sums or {}, fills or {}, maxes or {}, before or {}
    lasts = {**fills, **before}
    ck = "__chunk"
    cut = ranged(df, keys, order, ck) if chunk is None else df.withColumn(ck, chunk)
    base = cut.withColumns({**{"__v_" + n: c for n, c in {**sums, **lasts, **maxes}.items()}})
    ordered = W.partitionBy(*keys, ck).orderBy(*order)
    w = ordered.rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    wb = ordered.rowsBetween(W.unboundedPreceding, -1)
    local = base.withColumns(
        {**{"__l_" + n: F.sum("__v_" + n).over(w) for n in sums},
         **{"__l_" + n: F.last("__v_" + n, ignorenulls=True).over(w) for n in fills},
         **{"__l_" + n: F.last("__v_" + n, ignorenulls=True).over(wb) for n in before},
         **{"__l_" + n: F.max("__v_" + n).over(w) for n in maxes}})

    pos = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    aggs = ([F.sum("__v_" + n).alias("__s_" + n) for n in sums]
            + [F.max_by("__v_" + n, F.when(F.col("__v_" + n).isNotNull(), pos)).alias("__s_" + n) for n in lasts]
            + [F.max("__v_" + n).alias("__s_" + n) for n in maxes])
    cw = W.partitionBy(*keys).orderBy(ck).rowsBetween(W.unboundedPreceding, -1)
    jk = [F.col(k).alias("__k_" + k) for k in keys]
    carry = (base.groupBy(*keys, ck).agg(*aggs)
             .select(*jk, F.col(ck).alias("__k_chunk"),
                     *[F.sum("__s_" + n).over(cw).alias("__c_" + n) for n in sums],
                     *[F.last("__s_" + n, ignorenulls=True).over(cw).alias("__c_" + n) for n in lasts],
                     *[F.max("__s_" + n).over(cw).alias("__c_" + n) for n in maxes]))
    cond = F.col(ck).eqNullSafe(F.col("__k_chunk"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("__k_" + k))
    out = local.join(carry, cond, "left")
    zero = {n: F.coalesce(F.col("__l_" + n), F.lit(0)) + F.coalesce(F.col("__c_" + n), F.lit(0)) for n in sums}
    last = {n: F.coalesce(F.col("__l_" + n), F.col("__c_" + n)) for n in lasts}
    top = {n: F.greatest(F.col("__l_" + n), F.col("__c_" + n)) for n in maxes}
    return out.select(*df.columns, *[c.alias(n) for n, c in {**zero, **last, **top}.items()])


def first_per(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row per key, the first in the given order; pruned on the map side before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_per(df: DataFrame, keys: list, order: list, k: int, rank: str = "rank") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def rank_in(df: DataFrame, keys: list, chunk: Column, order: list, name: str) -> DataFrame:
    """1-based position in the group, for groups of any size."""
    return scan(df, keys, chunk, order, sums={name: F.lit(1)})
