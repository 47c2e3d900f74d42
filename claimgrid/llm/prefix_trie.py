"""Prefix trie of conversations: z-fast tries over ranges of them, merged.

A conversation is a sequence of turns, each known by a SHA-256 of its role and text; a prefix is known by a 128-bit key chained
over its turns, so texts are neither shuffled nor held. Equal conversations are one sequence with a weight. Sequences are dealt
by ranges of their keys, which is the order of the trie, so that a range holds whole subtrees but for the path it shares with its
neighbours, and a prefix that very many conversations share is spread over many ranges.

Each range is one z-fast trie (`ZFastTrie`): its compacted nodes are hashed at the two-fattest depth of their edges, and a
sequence finds its exit node by a fat binary search, in a number of look-ups logarithmic in its length. Sequences are inserted in
batches: a batch is located first, then inserted by exit node. Edges are expanded to one row per depth at the end.

Ranges are merged by prefix: members add up, the least member is the node's name, and the lowest range that has a node owns it.
What an owned node is worth is then summed over its subtree inside each range, and the sums of the ranges added. A task
holds one range of about `TURNS` turns (16 bytes each, and its compacted nodes) or one longer conversation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from claimgrid.llm.common import stored

TURNS = 400_000
KEY = 16
ROOT = bytes(KEY)


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes for a turn's role and text; null is empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the greatest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """A compacted trie of key sequences with a hash table of its nodes by handle.

    Node arrays: parent; top and end, the depths between which its edge lies (top excluded); seq, a sequence that runs through it.
    A sequence is the bytes of its prefix keys, `KEY` for each depth from 1 on. children: by (node, key of the next depth).
    """

    def __init__(self):
        self.parent, self.top, self.end, self.seq = [-1], [0], [0], [-1]
        self.keys, self.exact, self.children, self.handles = [], [], {}, {}

    def key(self, seq: bytes, depth: int) -> bytes:
        return seq[KEY * (depth - 1) : KEY * depth]

    def _add(self, parent: int, top: int, end: int, seq: int) -> int:
        node = len(self.parent)
        for column, value in ((self.parent, parent), (self.top, top), (self.end, end), (self.seq, seq)):
            column.append(value)
        self.children[parent, self.key(self.keys[seq], top + 1)] = node
        self.handles[self.key(self.keys[seq], fattest(top, end))] = node
        return node

    def locate(self, seq: bytes) -> tuple[int, int]:
        """The exit node's parent and the exit node (-1 where the sequence leaves, or ends, at the parent), by fat binary search."""
        low, high, at = 0, len(seq) // KEY, 0
        while low < high:
            f = fattest(low, high)
            node = self.handles.get(self.key(seq, f))
            if node is None:
                high = f - 1
                continue
            end = self.end[node]
            if end * KEY > len(seq) or self.key(seq, end) != self.key(self.keys[self.seq[node]], end):
                return self.parent[node], node
            low, at = end, node
            high = max(high, low)
        return at, self.children.get((at, self.key(seq, low + 1)), -1)

    def _common(self, seq: bytes, node: int) -> int:
        """The depth down to which a sequence that enters the node's edge follows it."""
        other = self.keys[self.seq[node]]
        low, high = self.top[node] + 1, min(self.end[node], len(seq) // KEY)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.key(seq, mid) == self.key(other, mid) else (low, mid - 1)
        return low

    def _insert(self, at: int, number: int) -> int:
        """Put sequence `number` below node `at`, whose extent it starts with; the node at which it ends."""
        seq = self.keys[number]
        depth = len(seq) // KEY
        while self.end[at] < depth:
            node = self.children.get((at, self.key(seq, self.end[at] + 1)))
            if node is None:
                return self._add(at, self.end[at], depth, number)
            common = self._common(seq, node)
            at = node if common == self.end[node] else self._split(node, common)
        return at

    def _split(self, node: int, depth: int) -> int:
        """Cut a node's edge at a depth; the new upper node."""
        seq = self.keys[self.seq[node]]
        del self.handles[self.key(seq, fattest(self.top[node], self.end[node]))]
        upper = self._add(self.parent[node], self.top[node], depth, self.seq[node])
        self.parent[node], self.top[node] = upper, depth
        self.children[upper, self.key(seq, depth + 1)] = node
        self.handles[self.key(seq, fattest(depth, self.end[node]))] = node
        return upper

    def insert(self, batch: list[bytes]) -> list[int]:
        """Insert a batch: all are located in the trie as it stands, then put in by exit node. The nodes at which they end."""
        base, found = len(self.keys), [self.locate(s) for s in batch]
        self.keys += batch
        ends = [0] * len(batch)
        for i in sorted(range(len(batch)), key=lambda i: found[i]):
            ends[i] = self._insert(found[i][0], base + i)
        return ends

    def top_down(self) -> np.ndarray:
        """Nodes, parents before children."""
        return np.argsort(np.array(self.end), kind="stable")


PREFIXES = "range int, node long, up long, depth long, key binary, size long, inner long, n_convs long, conv_id long"


def _expanded(batches):
    """Rows (range, conv_id, n, keys, sizes) of one range -> its trie's nodes, one a depth, parents before children.

    node and up number a row and its parent's row inside the range; n_convs and conv_id are the members and the least of them there,
    inner is 1 for a node with children there.
    """
    trie, ends, weights, least, sizes, own = ZFastTrie(), [], [], [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("range")[0].as_py()
        ends += trie.insert(batch.column("keys").to_pylist())
        weights.append(batch.column("n").to_numpy())
        least.append(batch.column("conv_id").to_numpy())
        sizes += batch.column("sizes").to_pylist()
    if own is None:
        return
    count, first = np.zeros(len(trie.parent), np.int64), np.full(len(trie.parent), np.iinfo(np.int64).max)
    np.add.at(count, ends, np.concatenate(weights))
    np.minimum.at(first, ends, np.concatenate(least))
    order = trie.top_down()
    for node in order[:0:-1].tolist():
        up = trie.parent[node]
        count[up] += count[node]
        first[up] = min(first[up], first[node])
    inner = np.zeros(len(trie.parent), np.int64)
    inner[trie.parent[1:]] = 1
    last, at, out = {0: 0}, 1, [[0], [-1], [0], [ROOT], [0], [inner[0]], [count[0]], [first[0]]]
    kinds = [pa.binary() if " binary" in c else pa.int64() for c in PREFIXES.split(", ")[1:]]
    rows = lambda: pa.RecordBatch.from_arrays([pa.array([own] * len(out[0]), pa.int32()), *map(pa.array, out, kinds)], [c.split()[0] for c in PREFIXES.split(", ")])
    for node in order[1:].tolist():
        up, seq, size = last[trie.parent[node]], trie.keys[trie.seq[node]], np.frombuffer(sizes[trie.seq[node]], np.int64)
        for depth in range(trie.top[node] + 1, trie.end[node] + 1):
            for column, value in zip(out, (at, up, depth, trie.key(seq, depth), size[depth - 1], 1 if depth < trie.end[node] else inner[node], count[node], first[node])):
                column.append(value)
            up, at = at, at + 1
            if len(out[0]) == 1 << 14:
                yield rows()
                out = [[] for _ in out]
        last[node] = up
    if out[0]:
        yield rows()


TOTALS = "depth long, key binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _subtrees(batches):
    """Rows (range, node, up, depth, key, conv_id, n_convs, worth, leaf, owned) sorted by range and node -> TOTALS, this range's
    share of the sums."""
    names = ("node", "up", "depth", "conv_id", "n_convs", "worth", "leaf", "owned")
    held, at = [], None

    def done():
        c = {k: np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in names}
        up, saved, leaves, children = c["up"], np.where(c["owned"], c["worth"], 0), np.where(c["owned"] & c["leaf"], 1, 0), np.zeros(len(c["up"]), np.int64)
        inner = up >= 0
        np.add.at(children, up[inner], c["owned"][inner].astype(np.int64))
        for depth_rows in _by_depth(c["depth"]):
            np.add.at(saved, up[depth_rows], saved[depth_rows])
            np.add.at(leaves, up[depth_rows], leaves[depth_rows])
        parent = pa.array(c["conv_id"][up], pa.int64(), mask=~inner)
        keys = pa.concat_arrays([b.column("key") for b in held])
        columns = [c["depth"], keys, c["conv_id"], parent, np.where(c["owned"], c["n_convs"], 0), children, leaves, saved]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], [x.split()[0] for x in TOTALS.split(", ")])

    for batch in batches:
        own = batch.column("range").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if own[a] != at and held:
                yield done()
                held.clear()
            at = own[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


def _by_depth(depth: np.ndarray):
    """Rows of each depth but 0, the deepest first."""
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows) and depth[rows[0]] > 0:
            yield rows


def _ends_hashed(batches):
    """Rows (key, depth, conv_id) sorted by key and conv_id -> (depth, key, ends_sha256), one a key; ids are streamed, not held."""
    at, sha, names = None, None, ["depth", "key", "ends_sha256"]
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.binary()), pa.array([sha.hexdigest()])], names)
    for batch in batches:
        out = []
        for depth, key, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "conv_id"))):
            if (depth, key) != at:
                if at:
                    out.append(row())
                at, sha = (depth, key), hashlib.sha256(str(conv).encode())
            else:
                sha.update(b"," + str(conv).encode())
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if at:
        yield row()


def _chained(batches):
    """Rows (conv_id, size, digest) sorted by conv_id and place, starting with an empty digest that stands for the conversation
    itself -> (conv_id, depth, key, keys, sizes); rows of conversations without that start are passed over."""
    conv, keys, sizes, names = None, None, None, ["conv_id", "depth", "key", "keys", "sizes"]

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names)

    done, held = [], 0
    for batch in batches:
        for c, size, digest in zip(batch.column("conv_id").to_pylist(), batch.column("size").to_pylist(), batch.column("digest").to_pylist()):
            if not digest:
                if keys is not None:
                    done.append((conv, len(sizes), bytes(keys[-KEY:]) or ROOT, bytes(keys), np.array(sizes, np.int64).tobytes()))
                    held += len(keys)
                    if held > 1 << 20:
                        yield rows(done)
                        done, held = [], 0
                conv, keys, sizes = c, bytearray(), []
            elif c == conv:
                keys += hashlib.blake2b(keys[-KEY:] + digest, digest_size=KEY).digest()
                sizes.append(size)
    if keys is not None:
        done.append((conv, len(sizes), bytes(keys[-KEY:]) or ROOT, bytes(keys), np.array(sizes, np.int64).tobytes()))
    if done:
        yield rows(done)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, keys, sizes) per conversation, written to the shared folder, from turns(conv_id, place, digest, size)
    sorted inside a conversation by place; a row with an empty digest and the least place stands for a conversation itself."""
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("key", "keys", "sizes"))])
    return stored(turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "size", "digest").mapInArrow(_chained, schema))


def trie(convs: DataFrame) -> DataFrame:
    """The expanded trie of convs (as of `sequences`, one row a conv_id): (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256) per node.

    conv_id: the smallest member; parent_conv_id: that of the parent, null for the root; n_leaves: childless nodes of the subtree,
    which includes its top; saved_tokens: the bytes of each node's last text for every member but one, summed over the subtree;
    ends_sha256: of the decimal ids of the members that end there, ascending, joined by commas. No conversation: no node.
    """
    spark = convs.sparkSession
    ends = convs.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    distinct = stored(convs.select("conv_id", "keys", "sizes").join(ends.select("conv_id", "n"), "conv_id"))
    turns = distinct.agg(F.coalesce(F.sum(F.length("keys") / KEY + 1), F.lit(0)).cast("long")).first()[0]
    ranges = max(1 + turns // TURNS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = distinct.repartitionByRange(ranges, "keys").select(F.spark_partition_id().alias("range"), "conv_id", "n", "keys", "sizes")
    nodes = stored(dealt.mapInArrow(_expanded, PREFIXES))
    whole = nodes.groupBy("key").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("range").alias("owner"), F.max("inner").alias("inner"))
    joined = nodes.select("range", "node", "up", "depth", "key", "size").join(whole, "key")
    joined = joined.select("range", "node", "up", "depth", "key", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("worth"), (F.col("inner") == 0).alias("leaf"), (F.col("range") == F.col("owner")).alias("owned"))
    parts = joined.repartition("range").sortWithinPartitions("range", "node").mapInArrow(_subtrees, TOTALS)
    hashed = convs.select("depth", "key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends_hashed, "depth long, key binary, ends_sha256 string")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    every = parts.unionByName(hashed, allowMissingColumns=True)
    out = every.groupBy("depth", "key").agg(F.max("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), *(F.sum(c).alias(c) for c in sums), F.coalesce(F.max("ends_sha256"), empty).alias("ends_sha256"))
    return out.select("conv_id", "depth", "parent_conv_id", *sums, "ends_sha256")


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, place, digest, size) of conversation rows (conv_id, turn, role, text): place counts from 1 in the order of turn
    (null first), ties by role and then by the turn's digest; size is the text's UTF-8 bytes. Rows without a conv_id belong to no
    conversation and take no part. Other columns are not read."""
    rows = rows.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), turn_digest(F.col("role"), F.col("text")).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "digest")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).select("conv_id", "place", "digest", "size")


def whole_turns(rows: DataFrame) -> DataFrame:
    """The turns of conversations as they are, for `sequences`."""
    turns = numbered(rows)
    return turns.unionByName(turns.where("place = 1").withColumns({"place": F.lit(0).cast("long"), "digest": F.lit(b"")}))


def rebuilt_turns(rows: DataFrame, family: int = 5, longest: int = 8) -> DataFrame:
    """The turns of rebuilt conversations, for `sequences`: each conv_id c takes the first h turns of conversation c - c % family
    (all if it has fewer, none if it is absent), then its own after its first h; h is the CRC-32 of c in decimal modulo
    longest + 1. At most `longest` turns of a conversation are copied, to at most 2 * family - 1 others."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(longest + 1))
    turns = numbered(rows).withColumn("h", h)
    itself = turns.where("place = 1").withColumns({"place": F.lit(0).cast("long"), "digest": F.lit(b"")})
    own = turns.where("place > h").withColumn("place", F.col("place") + longest)
    steps = F.array(*(F.lit(i).cast("long") for i in range(1 - family, family)))
    taken = turns.where((F.col("place") <= longest) & (F.col("conv_id") % family == 0)).drop("h")
    taken = taken.withColumn("to", F.explode(F.filter(F.transform(steps, lambda i: F.try_add("conv_id", i)), lambda c: c - c % family == F.col("conv_id"))))
    taken = taken.select(F.col("to").alias("conv_id"), "place", "digest", "size").withColumn("h", h).where("place <= h")
    return itself.unionByName(own).unionByName(taken).drop("h")
