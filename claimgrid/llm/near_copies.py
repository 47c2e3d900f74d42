"""Near copies by the likeness of their shingle sets: SimHash links and MinHash bands only propose, exact likeness decides.

Texts are compared as words (A-Z lower-cased, split at ASCII white space); equal word sequences are one text. The likeness of two
texts is the share of common shingles among all their distinct shingles of `words` words (all words as one where there are fewer).
Proposed are the SimHash links and pairs that agree in all `ROWS` minima of one of `BANDS` bands: a pair that is 0.8 alike is
missed by all bands with a chance of 5 in 10^6. What proposals join is decided by exact shingle sets. The texts of a group are
dealt into blocks, and a task compares two blocks and gives one link per text. First each block is compared with itself and
with the group's first block, which costs a group of n texts n comparisons times the size of a block and joins nearly all of a
group of copies. Then the texts outside the group's largest class so far are compared with all texts of the group, so every pair
is decided: it was compared, or both ends are in one class already. A group of n texts of which m stay outside costs n * m more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgrid.llm.common import free_name, slices, stored
from claimgrid.llm.components import components
from claimgrid.llm.simhash import SEED, least_joined, links, simhash

WORDS, ALIKE = 5, 0.8
BANDS, ROWS = 40, 6
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20

_draw = np.random.default_rng(SEED)
XOR = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
MUL = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ more) * MIX
    return h ^ (h >> np.uint64(29))


def text_key(text: bytes | None) -> int:
    """One signed number for texts of the same words."""
    key = xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split()), SEED)
    return key - (1 << 64) if key >> 63 else key


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; none for null and blank texts."""
    split = (text or b"").lower().split()
    hash64 = xxhash.xxh64_intdigest
    each = np.fromiter((hash64(w, SEED) for w in split), np.uint64, len(split))
    if not len(each):
        return each
    n = max(1, len(each) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(each))):
        out = _mixed(out, each[i : i + n])
    return np.unique(out)


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[k : k + 512, None] ^ XOR) * MUL).min(axis=0))
    key, parts = np.arange(BANDS, dtype=np.uint64), least.reshape(BANDS, ROWS)
    for k in range(ROWS):
        key = _mixed(key, parts[:, k])
    return key.view(np.int64)


def _hashed(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """(doc_id, row_key, fp, tid, bands) per row, written to the shared folder."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("row_key", "fp", "tid")), T.StructField("bands", T.ArrayType(T.LongType()))]

    def hashed(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                fps = np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64)
                keys = [bands(shingle_set(t, words)) for t in texts]
                ends = np.cumsum([0, *(len(k) for k in keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                tids = pa.array([text_key(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(fps), tids, lists], ["doc_id", "row_key", "fp", "tid", "bands"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(hashed, T.StructType(fields)))


def proposed(rows: DataFrame, bits: int) -> DataFrame:
    """(tid, root) of the texts that SimHash links and bands join with others; rows: of _hashed."""
    texts = stored(rows.groupBy("tid").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    lead = stored(texts.groupBy("fp").agg(F.min("tid").alias("lead")))
    same = texts.join(lead, "fp").select(F.col("tid").alias("a"), F.col("lead").alias("b"))
    ends = links(texts.select("fp"), bits)
    for c in ("a", "b"):
        ends = ends.join(lead.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_tid")), c)
    keyed = texts.select("tid", F.explode("bands").alias("key"))
    met = keyed.groupBy("key").agg(F.min("tid").alias("b"), F.max("tid").alias("top")).where("b <> top").drop("top")
    # of a text's minima, one a band at most, the least is linked to the text and to the others: texts of a group share them
    minima = keyed.join(met, "key").groupBy("tid").agg(F.collect_set("b").alias("b")).withColumn("b_least", F.array_min("b"))
    met = minima.select("tid", "b_least").union(minima.select(F.explode("b"), "b_least").distinct()).toDF("a", "b")
    star = stored(components(same.union(ends.select("a_tid", "b_tid")).union(met).where("a <> b").distinct()).select(F.col("u").alias("tid"), F.col("v").alias("root")))
    return star.union(star.select(F.col("root").alias("tid"), "root").distinct())


def _alike_pairs(sets: list[np.ndarray], alike: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of the sets that are at least `alike` alike."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        good = common and common / (sizes.sum() - common) >= alike
        return np.arange(1 if good else 0), np.arange(1, 2 if good else 1)
    shingles, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, place, times = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1                   # columns of the shingles that more than one set has
    of, place = of[times[place] > 1], shared[place[times[place] > 1]]
    order = np.argsort(place, kind="stable")
    of, place, width = of[order], place[order], 4096
    common = np.zeros((len(sets), len(sets)))
    for k in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [k, k + width])
        own = np.zeros((len(sets), width), np.float32)
        own[of[a:b], place[a:b] - k] = 1
        common += own @ own.T
    i, j = np.nonzero(np.triu(common, 1))
    good = common[i, j] / (sizes[i] + sizes[j] - common[i, j]) >= alike
    return i[good], j[good]


def _compare(alike: float):
    """For rows (key, tid, set) sorted by key: links (a, b) that join what pairs of one key at least `alike` alike join."""

    def found(tids, sets):
        tids, first = np.unique(np.array(tids, np.int64), return_index=True)
        if len(tids) > 1:
            least = least_joined(len(tids), *_alike_pairs([np.frombuffer(sets[k], np.uint64) for k in first], alike))
            of = np.flatnonzero(least < np.arange(len(tids)))
            if len(of):
                yield pa.RecordBatch.from_arrays([pa.array(tids[of]), pa.array(tids[least[of]])], ["a", "b"])

    def run(batches):
        at, tids, sets = None, [], []
        for batch in batches:
            for part in slices(batch, "set"):
                for key, tid, own in zip(*(part.column(c).to_pylist() for c in ("key", "tid", "set"))):
                    if key != at:
                        yield from found(tids, sets)
                        at, tids, sets = key, [], []
                    tids.append(tid)
                    sets.append(own)
        yield from found(tids, sets)

    return run


def _blocks(sets: DataFrame, name: str) -> DataFrame:
    """(root, name): the number of blocks that each group of sets(root, set) is dealt into."""
    return sets.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.length("set")) / BLOCK_BYTES)).cast("int").alias(name))


def joined(sets: DataFrame, alike: float) -> DataFrame:
    """(u, v): of sets(root, tid, set), what pairs of one root at least `alike` alike join, with the least of it."""
    place = lambda n: F.expr(f"cast(pmod(xxhash64(tid), {n}) as int)")
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    compare = lambda df, *key: df.select(F.xxhash64("root", *key).alias("key"), "tid", "set").repartition("key").sortWithinPartitions("key").mapInArrow(_compare(alike), "a long, b long")
    dealt = sets.join(_blocks(sets, "n"), "root").withColumn("own", place("n"))
    first = dealt.where("own = 0").withColumn("block", each("n")).unionByName(dealt.where("own > 0").withColumn("block", F.col("own")))
    known = components(compare(first, "block"))
    classes = dealt.where("n > 1").select("root", "tid").join(known.select(F.col("u").alias("tid"), F.col("v").alias("class")), "tid", "left").withColumn("class", F.coalesce("class", "tid"))
    largest = classes.groupBy("root", "class").agg(F.count("*").alias("m")).groupBy("root").agg(F.max(F.struct("m", "class"))["class"].alias("most"))
    rest = classes.join(largest, "root").where("class <> most").select("tid")
    outside = stored(sets.join(rest, "tid"))
    wide = dealt.where("n > 1").join(_blocks(outside, "k"), "root").withColumn("far", each("k"))
    out = outside.join(_blocks(outside, "k"), "root").join(_blocks(sets, "n"), "root").withColumn("far", place("k")).withColumn("own", each("n"))
    more = stored(compare(wide.select("root", "own", "far", "tid", "set").unionByName(out.select("root", "own", "far", "tid", "set")), "own", "far"))
    return known if more.isEmpty() else components(known.toDF("a", "b").union(more))


def verified(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, bits: int, words: int, alike: float) -> DataFrame:
    """(tid, root) of the texts that exact likeness joins with a text of a smaller key, the least of their group."""
    some = stored(proposed(rows, bits))
    chosen = rows.select("tid", "row_key").groupBy("tid").agg(F.min("row_key").alias("row_key")).join(some, "tid").select("row_key")

    def sets_of(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([text_key(t) for t in texts], pa.int64()), pa.array([shingle_set(t, words).tobytes() for t in texts], pa.binary())], ["tid", "set"])

    texts = docs.select(F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text")).join(chosen, "row_key", "left_semi")
    sets = stored(texts.select("text").mapInArrow(sets_of, "tid long, set binary").dropDuplicates(["tid"]).join(some, "tid"))
    return joined(sets, alike).select(F.col("u").alias("tid"), F.col("v").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, words: int = WORDS, alike: float = ALIKE) -> DataFrame:
    """The rows of docs, with all their columns, of one document in each group of texts joined by pairs at least `alike` alike:
    that with the smallest id (null ids last, then by a hash of the row's id and text). Rows that agree in id and text count as
    one; null and blank texts are one text, alike to no other. shingle, bits: of the SimHash proposals."""
    rows = _hashed(docs, id_col, text_col, shingle, words)
    root = verified(docs, rows, id_col, text_col, bits, words, alike)
    found = rows.select("doc_id", "row_key", "tid").join(root, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("k"))
    key = free_name(docs, "row_key")
    return docs.withColumn(key, F.xxhash64(id_col, text_col)).join(keep.select(F.col("k").alias(key)), key, "left_semi").dropDuplicates([key]).drop(key)
