"""SimHash near-duplicate groups by deletion-variant signatures.

A 64-bit fingerprint is cut into `bits // 2 + 1` segments: of two fingerprints that differ in at most `bits` bits, one segment
differs in at most one. Each segment is indexed under its one-wildcard variants (a bit position and the segment's other bits), so
such a pair always meets under equal variants, and an equality of variants is verified on the whole fingerprints. Fingerprints
are made distinct first, so copies never meet each other. Inside a bucket, sorted by fingerprint, each one is compared with its
next `NEAR` neighbours, and what is found leaves the task as one link per fingerprint, to the least one it is joined with there.
Members of a larger bucket that the window doesn't cover are dealt again under finer variants; what the window doesn't cover
there either is dealt into blocks, and each two blocks of a bucket are compared wholly in one task. No bucket is cut short, and
none is expanded into all its pairs.

Two bits take two segments with 31 fixed bits a variant; four or five take three with 20 or 21, which suits up to some 10^8
distinct fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from claimgrid.llm.common import free_name, slices, stored
from claimgrid.llm.components import components

SEED, NEAR = 42, 2048


def segments(bits: int) -> list[tuple[int, int]]:
    """(offset, width) of each segment for a distance of 2, 4 or 5 bits."""
    if bits not in (2, 4, 5):
        raise ValueError("bits must be 2, 4 or 5")
    n = bits // 2 + 1
    ends = [64 * (k + 1) // n for k in range(n)]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles of `shingle` words
    with repeats (all words as one where there are fewer), XXH64 with seed 42, a bit set where over half the hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    stops = ends[min(shingle, len(words)) - 1 :]
    hash64 = xxhash.xxh64_intdigest
    votes, step = np.zeros(64, np.int64), 1 << 14
    for k in range(0, n, step):
        hashes = np.array([hash64(joined[a:b], SEED) for a, b in zip(starts[k : k + step].tolist(), stops[k : k + step].tolist())], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, row_key, fp) per row, written to the shared folder. row_key: hash of id and text; fp: the fingerprint as a long."""
    ident = docs.schema[id_col]
    schema = T.StructType([T.StructField("doc_id", ident.dataType), T.StructField("row_key", T.LongType()), T.StructField("fp", T.LongType())])

    def hashed(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([simhash(t, shingle) for t in part.column("text").cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(fps)], ["doc_id", "row_key", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(hashed, schema))


def _canonical(key: np.ndarray, diff: np.ndarray, cuts) -> np.ndarray:
    """Whether this variant is the one under which a pair with these differing bits is reported, of all it meets under: the first
    segment with one such bit or none, and that bit or the segment's first."""
    want, open_ = np.full(len(diff), -1, np.int64), np.ones(len(diff), bool)
    for offset, width in cuts:
        own = (diff >> np.uint64(offset)) & np.uint64((1 << width) - 1)
        now = open_ & (np.bitwise_count(own) <= 1)
        want[now] = offset + np.log2(np.maximum(own[now], 1).astype(float)).astype(np.int64)
        open_ &= ~now
    return (key >> 32) == want


def least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index each of n items is joined with, by pairs (a, b)."""
    return joined_further(np.arange(n), a, b)


def joined_further(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`least` of items, each with the least one it is joined with so far, after pairs (a, b) join more of them."""
    a, b = least[a], least[b]
    apart = a != b
    if not apart.any():
        return least
    a, b, root = a[apart], b[apart], np.arange(len(least))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root[least]


def _meet(bits: int, cuts, near: int | None):
    """For rows sorted by (key, fp): links (a, b, null) that join what verified pairs join, and (a, null, key) for members of a
    bucket that the window doesn't cover. cuts: the segments, for rows keyed by variants; None for other keys.
    near: the window; None for all rows of a key."""

    def run(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new = batch.num_rows
            key = np.concatenate([held_k, batch.column("key").to_numpy()])
            fp = np.concatenate([held_f, batch.column("fp").to_numpy()])
            prints, base = fp.view(np.uint64), len(key) - new
            at, least, far = np.arange(len(key)), np.arange(len(key)), np.zeros(0, np.int64)
            for lag in range(1, (near or len(key)) + 1):
                at = at[at + lag < len(key)]
                at = at[key[at] == key[at + lag]]
                if not len(at):
                    break
                fresh = at[at + lag >= base]
                diff = prints[fresh] ^ prints[fresh + lag]
                good = np.bitwise_count(diff) <= bits
                if cuts:
                    good[good] &= _canonical(key[fresh][good], diff[good], cuts)
                least = joined_further(least, fresh[good], fresh[good] + lag)      # pairs are not kept
            else:
                far = at[at + near >= base] if near else far
            of = np.flatnonzero(least < np.arange(len(key)))
            if len(of):
                yield pa.RecordBatch.from_arrays([pa.array(fp[of]), pa.array(fp[least[of]]), pa.nulls(len(of), pa.int64())], ["a", "b", "key"])
            if len(far):
                far = np.unique(np.concatenate([far, far + near]))
                yield pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.nulls(len(far), pa.int64()), pa.array(key[far])], ["a", "b", "key"])
            held = near or int((key == key[-1:]).sum())
            held_k, held_f = key[-held:], fp[-held:]

    return run


def _two_wildcards(rows: DataFrame, cuts, by: list) -> DataFrame:
    """rows(fp, ...) under each pair of bit positions inside one of the ranges `cuts`: columns t (range), d (pair), rest (its
    other bits); by: further columns kept."""
    pairs = [(t, i, j, ((1 << w) - 1) << o) for t, (o, w) in enumerate(cuts) for i in range(o, o + w) for j in range(i + 1, o + w)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    grid = F.broadcast(rows.sparkSession.createDataFrame([(t, i * 64 + j, signed(m & ~(1 << i) & ~(1 << j))) for t, i, j, m in pairs], "t int, d int, mask long"))
    return rows.select("fp", *by, F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))).alias("t")).join(grid, "t").select("fp", *by, "t", "d", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))


def _blocks(members: DataFrame) -> DataFrame:
    """(key, fp) for members(key, fp) of buckets: each bucket's members in blocks of about NEAR, under a key for each two blocks."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / NEAR).cast("int").alias("n"))
    dealt = members.join(sizes, "key").withColumn("own", F.expr("cast(pmod(xxhash64(fp), n) as int)")).withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    return dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b) pairs of fingerprints that join the same ones as all pairs in prints(fp) that differ in 1 to `bits` bits."""
    cuts = segments(bits)
    by_bit = [c for c in cuts for _ in range(c[1])]
    lists = [F.array(*(F.lit(c[k]) for c in by_bit)) for k in (0, 1)]
    rows = prints.select("fp").distinct().withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(63))))
    rows = rows.withColumns({"o": F.element_at(lists[0], F.col("v") + 1), "w": F.element_at(lists[1], F.col("v") + 1)})
    rows = rows.withColumn("s", F.expr("shiftrightunsigned(fp, o) & (shiftleft(1L, w) - 1)")).withColumn("j", F.expr("v - o"))
    key = F.expr("shiftleft(cast(v as bigint), 32) | shiftleft(shiftrightunsigned(s, j + 1), j) | (s & (shiftleft(1L, j) - 1))")
    meet = lambda df, c, near: df.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_meet(bits, c, near), "a long, b long, key long")
    met = stored(meet(rows.select(key.alias("key"), "fp"), cuts, NEAR))
    far = met.where("b is null").select(F.col("a").alias("fp"), "key").distinct()
    if bits == 2:                                       # two bits out of 64: buckets of four at most
        wide = _two_wildcards(far.select("fp").distinct(), [(0, 64)], [])
    else:                                               # one of the two other segments differs in two bits at most
        far = far.withColumn("o", F.element_at(lists[0], F.shiftright("key", 32).cast("int") + 1))
        wide = _two_wildcards(far, cuts, ["key", "o"]).where(F.element_at(F.array(*(F.lit(o) for o, _ in cuts)), F.col("t") + 1) != F.col("o"))
    again = stored(meet(wide.select(F.xxhash64(*(c for c in wide.columns if c not in ("fp", "o"))).alias("key"), "fp").distinct(), None, NEAR))
    last = meet(_blocks(again.where("b is null").select("key", F.col("a").alias("fp")).distinct()), None, None)
    return met.union(again).union(last).where("b is not null").select("a", "b")


def groups(prints: DataFrame, bits: int = 2) -> DataFrame:
    """(doc_id, row_key, fp, root, component_id): root is the component's own key, its least fingerprint; component_id is the
    smallest id reachable over links, the row's own included, which several components share where an id repeats."""
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    star = components(links(prints, bits)).select(F.col("u").alias("fp"), F.col("v").alias("to"))
    nodes = own.join(star, "fp", "left").select("fp", "least", F.coalesce("to", "fp").alias("root"))
    of_root = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(of_root, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs.

    fingerprint: 16 lowercase hex digits. Null and empty texts have fingerprint zero and are linked like any other. Null ids are
    passed over in minima (null where a group has no other). Repeated rows and ties give one result each; an empty table gives none.
    Other columns are not read.
    """
    found = groups(fingerprints(docs, id_col, text_col))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """The rows of docs, with all their columns, of one document in each group: that with the smallest id (null ids last, then by
    a hash of the row's id and text). Rows that agree in id and text count as one."""
    found = groups(fingerprints(docs, id_col, text_col, shingle), bits)
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("k"))
    key = free_name(docs, "row_key")
    return docs.withColumn(key, F.xxhash64(id_col, text_col)).join(keep.select(F.col("k").alias(key)), key, "left_semi").dropDuplicates([key]).drop(key)
