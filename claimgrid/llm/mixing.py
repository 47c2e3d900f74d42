"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source are dealt by a keyed hash into blocks; block by block, in a permuted order, whole passes over the source
and one partial pass make up its quota, and of the block in which the partial pass ends a part is taken whose size comes nearest
to what is missing. The quotas of drawn blocks are then split among output shards: at each node of a binary tree over the shards,
the blocks of each source that go left are one draw of the multivariate hypergeometric distribution, so every shard gets a
random share and all quotas are met exactly. A shard's blocks are the next ones of each source's permuted order, disjoint from
those of all other shards, and its documents are shuffled inside the shard.

Sources and blocks are bounded (`max_sources`, and `max_blocks` + one per source), so their sums may go to the driver and their
places back to all tasks; documents are only ever read, never gathered, and a source with a third of all rows is spread over its
blocks like any other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimgrid.llm.common import WORD, stored

BLOCK_DOCS, TRIES = 16, 64


def targets(sizes, weights=(1, 2, 3), most: float = 3.0) -> np.ndarray:
    """Words wanted of each source. sizes: words by source, in order; weights repeat over them and share the sum of all sizes.
    What exceeds `most` times a source's size is shared again by weight among the others, until none is above."""
    sizes = np.asarray(sizes, float)
    weight = np.resize(np.asarray(weights, float), len(sizes))
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = sizes.sum()
    while free.any():
        share = left * weight / weight[free].sum()
        over = free & (share > most * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = most * sizes[over]
        left -= out[over].sum()
        free &= ~over
    return out


def split_quotas(quotas, shards: int, seed: int) -> np.ndarray:
    """(shards x sources) draws of each source for each shard; every column sums to its quota, every row to an equal share."""
    quotas = np.asarray(quotas, np.int64)
    total = int(quotas.sum())
    until = [total * s // shards for s in range(shards + 1)]
    out, todo = np.zeros((shards, len(quotas)), np.int64), [(0, shards, quotas)]
    while todo:
        lo, hi, counts = todo.pop()
        if hi - lo == 1:
            out[lo] = counts
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(counts, until[mid] - until[lo], method="marginals")
        todo += [(lo, mid, left), (mid, hi, counts - left)]
    return out


def measured(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, kept: list[str]) -> DataFrame:
    """(row, mix_size, mix_key, mix_source): the kept columns of docs as a struct, so that no name clashes; the words of the
    text; a keyed hash of id and text; the source."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), size.alias("mix_size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("mix_key"), F.col(source_col).cast("string").alias("mix_source"))


def _part(key, count):
    """The block of a key among `count` ones."""
    return F.floor(F.shiftrightunsigned(key, 33) / F.lit(float(1 << 31)) * count).cast("int")


def plan(rows: DataFrame, shards: int, weights, most: float, seed: int, max_sources: int, max_blocks: int):
    """(sources, places) as small tables. sources: k, name, words, target, blocks, and where its partial pass ends (edge: a block,
    try: a numbering of its rows, cut: the last hash taken). places: k, block, draws as an array of (pass, shard), whether the
    last draw is partial."""
    spark = rows.sparkSession
    sums = rows.groupBy("mix_source").agg(F.count("*").alias("n"), F.sum("mix_size").alias("words")).limit(max_sources + 1).toPandas()
    if len(sums) > max_sources:
        raise ValueError(f"more than max_sources={max_sources} sources")
    sums["order"] = [(s is None, (s or "").encode("utf-8")) for s in sums["mix_source"]]
    sums = sums.sort_values("order").reset_index(drop=True)
    n, words = sums["n"].to_numpy(np.int64), sums["words"].to_numpy(np.int64)
    target = targets(words, weights, most)
    blocks = np.minimum(-(-n // BLOCK_DOCS), 1 + max_blocks * n // max(1, n.sum()))
    names = spark.createDataFrame([(k, s, int(b)) for k, (s, b) in enumerate(zip(sums["mix_source"], blocks))], "k int, name string, blocks int")
    dealt = rows.join(F.broadcast(names), F.col("mix_source").eqNullSafe(F.col("name"))).select("k", _part(F.col("mix_key"), F.col("blocks")).alias("block"), "mix_size", "mix_key")
    found = dealt.groupBy("k", "block").agg(F.sum("mix_size").alias("words")).toPandas().sort_values(["k", "block"])

    passes = np.floor_divide(target, np.maximum(words, 1)).astype(int)
    rest = target - passes * words
    draws, edges, quotas = [], [], np.zeros(len(sums), np.int64)
    for k, own in found.groupby("k"):
        block, size = own["block"].to_numpy(), own["words"].to_numpy(np.int64)
        turn = np.random.default_rng([seed, int(k)]).permutation(len(block))
        block, size = block[turn], size[turn]
        until = np.cumsum(size)
        whole = int(np.searchsorted(until, rest[k], side="right"))
        missing = rest[k] - (until[whole - 1] if whole else 0)
        order = [(b, p) for p in range(passes[k]) for b in block] + [(b, passes[k]) for b in block[:whole]]
        if whole < len(block) and missing > 0:
            order.append((block[whole], passes[k]))
            edges.append((int(k), int(block[whole]), float(missing)))
        draws.append((int(k), order))
        quotas[k] = len(order)
    where, cuts = {}, {}
    share = split_quotas(quotas, shards, seed)
    for k, order in draws:
        shard = np.repeat(np.arange(shards), share[:, k])
        for (b, p), s in zip(order, shard):
            where.setdefault((k, int(b)), []).append((int(p), int(s)))
    if edges:
        ends = F.broadcast(spark.createDataFrame(edges, "k int, block int, missing double"))
        tries = dealt.join(ends, ["k", "block"]).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1)))).withColumn("h", F.xxhash64("mix_key", "try"))
        tries = tries.withColumn("until", F.sum("mix_size").over(W.partitionBy("k", "try").orderBy("h")))
        tries = tries.withColumn("miss", F.abs(F.col("until") - F.col("missing"))).where(F.col("miss") < F.col("missing"))
        cuts = {r["k"]: (r["b"]["try"], r["b"]["h"]) for r in tries.groupBy("k").agg(F.min(F.struct("miss", "try", "h")).alias("b")).collect()}
    edge = {k: b for k, b, _ in edges}
    sources = spark.createDataFrame([(k, s, int(w), float(t), int(b), edge.get(k, -1), *cuts.get(k, (-1, 0))) for k, (s, w, t, b) in enumerate(zip(sums["mix_source"], words, target, blocks))], "k int, name string, words long, target double, blocks int, edge int, try int, cut long")
    places = spark.createDataFrame([(k, b, d) for (k, b), d in where.items()], "k int, block int, draws array<struct<pass:int,shard:int>>")
    return sources, places


def mix(docs: DataFrame, shards: int | None = None, weights=(1, 2, 3), most: float = 3.0, seed: int = 17, max_sources: int = 10_000, max_blocks: int = 65_536, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", texts: bool = True) -> DataFrame:
    """(row, mix_size, mix_source_size, mix_target, mix_draws, mix_key) per row of docs: its columns as a struct, and one
    (pass, shard) for each time the mix takes it. shards: by default as many as spark.sql.shuffle.partitions.

    texts=False keeps id and source alone, and reads the texts once only. Sources are ordered by code point, null last, and weights
    repeat over them. A size is the number of words of the whole text (null: 0); sources without words get no target. Ids may be
    null or repeat; equal rows are drawn alike. An empty table gives none. The same rows give the same mix, however they are
    partitioned.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = stored(measured(docs, seed, id_col, text_col, source_col, [id_col, source_col]))
    if narrow.isEmpty():
        places = docs.sparkSession.createDataFrame([], "k int, block int, draws array<struct<pass:int,shard:int>>")
        sources = docs.sparkSession.createDataFrame([], "k int, name string, words long, target double, blocks int, edge int, try int, cut long")
    else:
        sources, places = plan(narrow, shards, weights, most, seed, max_sources, max_blocks)
    rows = measured(docs, seed, id_col, text_col, source_col, docs.columns) if texts else narrow
    rows = rows.join(F.broadcast(sources), F.col("mix_source").eqNullSafe(F.col("name"))).withColumn("at", _part(F.col("mix_key"), F.col("blocks")))
    rows = rows.join(F.broadcast(places.withColumnRenamed("k", "of")), (F.col("k") == F.col("of")) & (F.col("at") == F.col("block")), "left")
    out = (F.col("at") == F.col("edge")) & ((F.col("try") < 0) | (F.xxhash64("mix_key", "try") > F.col("cut")))
    some = F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int>>"))
    drawn = F.when(out, F.slice(some, 1, F.size(some) - 1)).otherwise(some)
    return rows.select("row", "mix_size", F.col("words").alias("mix_source_size"), F.col("target").alias("mix_target"), drawn.alias("mix_draws"), "mix_key")


def mixed_rows(docs: DataFrame, shards: int | None = None, **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is drawn, with docs' columns, one partition for each shard, shuffled
    inside."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = mix(docs, shards, **options).select("row", "mix_key", F.explode("mix_draws").alias("draw"))
    copies = draws.select("row", F.col("draw.shard").alias("shard"), F.xxhash64("mix_key", "draw.shard", "draw.pass").alias("turn"))
    return copies.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "turn").select("row.*")
