"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights: component t is term t, its weight floor(scale * x), zero weights are left out.
Candidates are dealt into blocks and streamed in pieces of `PIECE` rows. A piece is turned into postings (per term the places
and weights of its rows); each query scatters its weighted postings, term by term, into one dense score array over the piece.
A partition selection keeps the best k of a piece and of the pieces before it; the best k of each block are merged by query.

Queries are dealt into blocks of bytes, so a task holds one block of queries, one piece and k results a query, at any table
size. A row of a candidate block meets each query block once: candidates are sent as often as there are query blocks (one up
to `QUERY_BYTES`), queries as often as there are candidate blocks. Nothing is broadcast, and no score leaves a task but the best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from claimgrid.llm.common import stored

PIECE = 4096
QUERY_BYTES, CANDIDATE_BYTES = 8 << 20, 64 << 20
LONG = (1 << 63) - 1


def weights(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as 64-bit integers, or as Python integers where one does not fit in 31 bits."""
    raised = np.floor(values * scale)
    if not len(raised) or np.abs(raised).max() < 1 << 31:
        return raised.astype(np.int64)
    # a double of 2^53 or more is a whole number
    return np.array([int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale)) for x in values.tolist()], object)


def sparse(vector: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of a vector without its zero weights."""
    own = weights(vector, scale)
    terms = np.flatnonzero(own)
    return terms, own[terms]


class Postings:
    """The rows of one piece by term."""

    def __init__(self, vectors: list[np.ndarray], scale: int):
        size = np.array([len(v) for v in vectors])
        own = weights(np.concatenate(vectors) if len(vectors) else np.zeros(0), scale)
        row, term = np.repeat(np.arange(len(vectors)), size), np.concatenate([np.arange(n) for n in size]) if len(size) else np.zeros(0, int)
        kept = np.flatnonzero(own)
        row, term, own = row[kept], term[kept], own[kept]
        order = np.argsort(term, kind="stable")
        row, term, own = row[order], term[order], own[order]
        self.n, self.wide = len(vectors), own.dtype == object
        self.most = max(map(abs, own.tolist()), default=0)
        cuts = np.flatnonzero(np.diff(term)) + 1
        starts, ends = [0, *cuts.tolist()] if len(term) else [], [*cuts.tolist(), len(term)]
        # a term that every row has is scattered to the whole array
        self.of = {int(term[a]): (slice(None) if b - a == self.n else row[a:b], own[a:b]) for a, b in zip(starts, ends)}

    def scores(self, terms: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The dense score array of a query."""
        most = max(map(abs, own.tolist()), default=0)
        wide = self.wide or own.dtype == object or most * self.most * max(1, len(own)) > LONG
        out = np.zeros(self.n, object if wide else np.int64)
        for t, w in zip(terms.tolist(), own.tolist()):
            found = self.of.get(t)
            if found is not None:
                at, post = found
                out[at] += w * (post.astype(object) if wide else post)
        return np.array([min(LONG, max(-LONG - 1, s)) for s in out], np.int64) if wide else out


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """Of parallel arrays the k places with the highest scores, ties to the smaller id (null ids, marked in own, last)."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    order = np.lexsort((ids[at], own[at], ~scores[at]))           # ~s falls as s rises, and fits for every long
    return at[order[:k]]


def _search(k: int, scale: int):
    """For rows (key, side, row, vec_id, vector) sorted by key and side, side 0 the queries: (row, query_id, vec_id, score)."""

    def run(batches):
        at, queries, tops, held = None, [], [], []

        def fold():
            rows, ids, vectors = [np.array(c) if i < 2 else c for i, c in enumerate(zip(*held))]
            null = np.array([i is None for i in ids])
            ids = np.array([0 if i is None else i for i in ids], np.int64)
            index = Postings(list(vectors), scale)
            for q, (row, _, terms, own) in enumerate(queries):
                scores, (top, top_ids, top_null) = index.scores(terms, own), tops[q]
                near = np.flatnonzero((scores >= top[-1] if len(top) == k else np.ones(len(scores), bool)) & (rows != row))
                if len(near):
                    scores, near_ids, near_null = np.concatenate([top, scores[near]]), np.concatenate([top_ids, ids[near]]), np.concatenate([top_null, null[near]])
                    take = best(scores, near_ids, near_null, k)
                    tops[q] = scores[take], near_ids[take], near_null[take]
            held.clear()

        def done():
            if held and queries:
                fold()
            size = [len(t[0]) for t in tops]
            if sum(size):
                flat = [np.concatenate([t[c] for t in tops]) for c in range(3)]
                of = [np.repeat(np.array([q[c] for q in queries], np.int64), size) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, of), pa.array(flat[1], pa.int64(), mask=flat[2]), pa.array(flat[0])], ["row", "query_id", "vec_id", "score"])

        for batch in batches:
            column = batch.column("vector")
            ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(float)
            for i, (key, side, row, ident) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "side", "row", "vec_id")))):
                if key != at:
                    yield from done()
                    at, queries, tops = key, [], []
                    held.clear()
                vector = values[ends[i] : ends[i + 1]]
                if side == 0:
                    queries.append((row, ident, *sparse(vector, scale)))
                    tops.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)))
                elif queries:
                    held.append((row, ident, vector))
                    if len(held) == PIECE:
                        fold()
        yield from done()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors that is_query holds for, the k rows of highest integer inner
    product among all rows but itself, all of them if fewer, ties to the smaller id.

    The inner product is taken of floor(scale * x); a component that the shorter of two vectors lacks counts as zero. Rows whose
    vector is null or holds a null, a NaN or an infinite component take no part. Rows with a null id are no queries; as candidates
    they come after equal scores with an id. Equal rows are rows of their own: each is a candidate of the other, and each repeated
    query row gets its own k results. A score beyond a long is given as the bound of a long. Other columns are not read; an empty
    table gives no row.
    """
    x = F.col(vector_col)
    finite = x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    asked = F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False))
    rows = vectors.where(finite).select(asked.alias("asked"), F.col(id_col).cast("long").alias("vec_id"), x.alias("vector"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    queries = stored(rows.where("asked").drop("asked"))           # the numbers of query rows are fixed by this
    others = rows.where("not asked").select("vec_id", "vector", (-F.col("row") - 1).alias("row"))
    size = lambda df: df.agg(F.coalesce(F.sum(F.size("vector") * 8 + 64), F.lit(0))).first()[0]
    of_queries = size(queries)
    n_q, n_c = 1 + of_queries // QUERY_BYTES, 1 + (of_queries + size(others)) // CANDIDATE_BYTES
    n_c = max(n_c, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_q)
    # row numbers count up inside a partition, so a hash of them deals evenly whatever the ids are
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    asked = queries.select(F.lit(0).alias("side"), deal(n_q).alias("q"), each(n_c).alias("c"), "row", "vec_id", "vector")
    given = queries.select("vec_id", "vector", "row").unionByName(others).select(F.lit(1).alias("side"), each(n_q).alias("q"), deal(n_c).alias("c"), "row", "vec_id", "vector")
    dealt = asked.unionByName(given).withColumn("key", F.col("q") * n_c + F.col("c")).select("key", "side", "row", "vec_id", "vector")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "query_id", "vec_id", "score")])
    found = dealt.repartition(int(n_q * n_c), "key").sortWithinPartitions("key", "side").mapInArrow(_search(k, scale), schema)
    order = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
