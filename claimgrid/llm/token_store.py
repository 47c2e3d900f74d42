"""Token-id files with directly addressable codes.

A segment holds the ids of consecutive documents. Ids are cut into chunks of 8 bits. Level 0 has the lowest chunk of every id and
a bitmap that tells which ids go on; level 1 has the next chunk of those alone, with a bitmap of its own, and so on. A rank
directory (set bits before each block of 512 bits) leads from a position to its place on the next level, so any token is read
with one look per level and nothing is decoded around it.

Segments are rows of a Parquet dataset written by Spark, so a lost executor leaves no half-written file and the dataset can lie in
any store that Spark reaches. Layout of a payload, all little-endian: b"DAC1", uint32 levels, per level uint64 n, n bytes of
chunks, ceil(n/8) bytes of bitmap (lowest bit first), ceil(n/512) uint64 ranks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import slices, stored
from claimgrid.llm.encoder import encoder

MAGIC, BLOCK = b"DAC1", 512

SEGMENT = "shard int, segment int, first long, n_ids long, payload binary, documents array<struct<doc_id:{id},start:long,n_tokens:long>>"


def pack(ids) -> bytes:
    """The payload for a sequence of unsigned 32-bit ids."""
    rest, levels = np.asarray(ids, np.uint32), []
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])[: len(counts)]
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u8").tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Segment:
    """A payload, read in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        (count,), at, self.levels = struct.unpack_from("<I", payload, 4), 8, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", payload, at)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            bits = np.frombuffer(payload, np.uint8, -(-n // 8), at + 8 + n)
            ranks = np.frombuffer(payload, "<u8", -(-n // BLOCK), at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + 8 * len(ranks)

    def __len__(self):
        return len(self.levels[0][0])

    def __getitem__(self, at: int) -> int:
        """One token, by position: a chunk, a bit and a rank per level."""
        if not 0 <= at < len(self):
            raise IndexError(at)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[at]) << (8 * k)
            if not bits[at >> 3] >> (at & 7) & 1:
                return value
            block = at // BLOCK
            before = int.from_bytes(bits[block * BLOCK // 8 : (at >> 3) + 1].tobytes(), "little") & ((1 << (at - block * BLOCK)) - 1)
            at = int(ranks[block]) + before.bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level from the highest."""
        rest = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            own = chunks.astype(np.uint32)
            own[np.unpackbits(bits, count=len(own), bitorder="little").astype(bool)] |= rest << np.uint32(8)
            rest = own
        return rest


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, shards: int | None = None, segment_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs and write them in ascending id order; returns the written segments (shard, segment, first, n_ids, payload,
    documents), read back from the shared folder. `first` and the starts count from the beginning of the shard.

    Every text is followed by end_id. A shard is a range of ids, so shard after shard gives the whole order; rows of one id are
    ordered by a hash of the text (equal rows are interchangeable) and may lie in several shards. A segment ends with the
    document that brings it to segment_ids ids or more, so no document is split. Null ids come first, null texts count as empty
    (the end id alone), other columns are not read. An empty table gives no segment.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("shard", F.spark_partition_id())
    end = np.uint32(end_id).tobytes()

    def encode(batches):
        enc = encoder(tokenizer)
        shard, segment, first, held, index, ids_type = None, 0, 0, [], [], None

        def flush():
            nonlocal segment, first, held, index
            ids = np.frombuffer(b"".join(held), np.uint32)
            docs_type = pa.list_(pa.struct([("doc_id", ids_type), ("start", pa.int64()), ("n_tokens", pa.int64())]))
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack(ids)], pa.binary()), pa.array([index], docs_type)], ["shard", "segment", "first", "n_ids", "payload", "documents"])
            segment, first, held, index = segment + 1, first + len(ids), [], []
            return row

        size = 0
        for batch in batches:
            ids_type = batch.column("doc_id").type
            for part in slices(batch, "text"):
                if part.num_rows:
                    shard = part.column("shard")[0].as_py()
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = enc.ids(text)
                    index.append({"doc_id": doc, "start": first + size, "n_tokens": len(ids) // 4 + 1})
                    held += [ids, end]
                    size += len(ids) // 4 + 1
                    if size >= segment_ids:
                        yield flush()
                        size = 0
        if index:
            yield flush()

    return stored(rows.select("doc_id", "text", "shard").mapInArrow(encode, SEGMENT.format(id=kind)))


def shard_starts(segments: DataFrame) -> DataFrame:
    """(shard, base): ids in all shards before. One row per shard, so the running sum is over a small table."""
    from pyspark.sql import Window as W

    sums = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return sums.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the written segments: start counts the ids of all documents
    before it, the checksum covers its ids as little-endian unsigned 32-bit integers."""
    kind = segments.schema["documents"].dataType.elementType["doc_id"].dataType.simpleString()

    def check(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = Segment(row["payload"]).all().astype("<u4")
                docs, first = row["documents"], row["first"]
                crc = [zlib.crc32(ids[d["start"] - first : d["start"] - first + d["n_tokens"]].data) for d in docs]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int32()), pa.array([d["doc_id"] for d in docs], batch.column("documents").type.value_type.field("doc_id").type), pa.array([d["start"] for d in docs], pa.int64()), pa.array([d["n_tokens"] for d in docs], pa.int64()), pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    docs = segments.select("shard", "first", "payload", "documents").mapInArrow(check, f"shard int, doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    return docs.join(shard_starts(segments), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """(position, token_id) for each distinct position (ids before it, over all shards) in wanted; positions outside have no row."""
    from pyspark.sql import Window as W

    ranges = segments.select("shard", "segment", "first", "n_ids", "payload").join(shard_starts(segments), "shard").withColumn("from", F.col("first") + F.col("base"))
    grain = 1 << 16
    blocks = ranges.select("shard", "segment", "from", (F.col("from") + F.col("n_ids")).alias("to")).withColumn("grain", F.explode(F.sequence(F.floor(F.col("from") / grain), F.floor((F.col("to") - 1) / grain))))
    asked = wanted.select("position").distinct().withColumn("grain", F.floor(F.col("position") / grain))
    found = asked.join(blocks, "grain").where("position >= from and position < to").select("position", "shard", "segment", (F.col("position") - F.col("from")).alias("at"))
    part = (F.floor(F.row_number().over(W.partitionBy("shard", "segment").orderBy("at")) / 10_000)).alias("part")
    groups = found.select("*", part).groupBy("shard", "segment", "part").agg(F.collect_list(F.struct("position", "at")).alias("asked"))

    def look(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row["payload"])
                yield pa.RecordBatch.from_arrays([pa.array([a["position"] for a in row["asked"]], pa.int64()), pa.array([seg[a["at"]] for a in row["asked"]], pa.int64())], ["position", "token_id"])

    return groups.join(ranges.select("shard", "segment", "payload"), ["shard", "segment"]).select("payload", "asked").mapInArrow(look, "position long, token_id long")
