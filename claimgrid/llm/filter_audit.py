"""Audit of how filters interact, by the Hart-Mas-Colell potential of the removal game.

Each row has a mask of the filters it fails. Rows are counted by part and mask, so all that follows works on at most 2^n counts
a part. The game's value of a coalition S of filters is the number of rows that fail one of them. Its potential is computed
recursively over the 2^n coalitions: P(S) is the value of S and the potentials of S without each of its filters, added up and
divided by the size of S. The Shapley value of a filter is the potential of all filters minus that without it; n! times as much
is a whole number, so the recursion runs on Q(S) = |S|! P(S) in whole numbers. What a filter removes at a step of an order is the
difference of two coalitions: those before it with it, and without it.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import stored

COUNTED = ("n", "good", "toxic")


def text_flags(text: Column) -> Column:
    """(short, repetitive, capitals, marks) of a text: under 200 words; under half of them distinct; over 2 % capital letters
    A-Z; holds one of #$%&*|. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("own")))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    pair = F.struct(counts.alias("words"), capitals.alias("capitals"))
    flags = lambda p: F.array(p["words"]["n"] < 200, 100 * p["words"]["own"] < 50 * p["words"]["n"], 100 * p["capitals"] > 2 * F.length(text), text.rlike(r"[#$%&*|]"))
    return F.transform(F.array(pair), flags)[0]


def mask_of(flags: Column) -> Column:
    """Bit i of the mask is flag i; a null flag counts as passed."""
    return F.aggregate(F.reverse(flags), F.lit(0), lambda m, f: m * 2 + F.when(f, 1).otherwise(0))


def document_masks(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): numbers of documents by part and failed filters A to E, and of those labelled good and toxic.

    E, the fifth filter, fails where a smaller doc_id has the identical text (null: empty) anywhere in the table. A null doc_id is
    smaller than none and greater than all others. Rows that agree in doc_id and text fail it only if a smaller doc_id has the text.
    Texts are told apart by SHA-256 and never shuffled. A document is good (toxic) if one of its label rows says so; null labels and
    labels of no document count for nothing. Parts: null is the empty string.
    """
    ident = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id")]
    rows = docs.select(*ident, F.coalesce(part_col, F.lit("")).alias("part"), mask_of(text_flags(F.col("text"))).alias("mask"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    rows = stored(rows.groupBy("digest", "no_id", "doc_id", "part", "mask").agg(F.count("*").alias("n")))
    first = rows.groupBy("digest").agg(F.min(F.struct("no_id", "doc_id")).alias("least")).select("digest", "least.*", F.lit(True).alias("first"))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = marked.where("good or toxic").withColumn("no_id", F.lit(False))
    rows = rows.join(first, ["digest", "no_id", "doc_id"], "left").join(marked, ["no_id", "doc_id"], "left")
    rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(16))
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def _bits(mask: Column) -> Column:
    return F.bit_count(mask)


def games(masks: DataFrame, filters: int) -> DataFrame:
    """Per part: `by_mask` (count of each mask) and `value` (of each coalition) as arrays of 2^n structs (n, good, toxic), and
    `shapley`, n! times the Shapley value of each filter in the game of removed rows."""
    size = 1 << filters
    given = masks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTED)))).alias("of"))
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTED))
    every = F.sequence(F.lit(0), F.lit(size - 1))
    out = given.select("part", F.transform(every, lambda m: F.coalesce(F.element_at("of", m), zero)).alias("by_mask"))
    add = lambda a, x: F.struct(*((a[c] + x[c]).alias(c) for c in COUNTED))
    hit = lambda s: F.filter("by_mask", lambda x, m: m.bitwiseAND(s) != 0)
    out = out.withColumn("value", F.transform(every, lambda s: F.aggregate(hit(s), zero, add)))
    # Q(S) = (|S| - 1)! v(S) + sum of Q(S without i): subsets come before S in the order of their masks
    below = F.array(*(F.lit(math.factorial(max(0, k - 1))).cast("long") for k in range(filters + 1)))
    bits = F.sequence(F.lit(0), F.lit(filters - 1))
    bit = lambda i: F.expr("shiftleft(1, {})".format(i)) if isinstance(i, int) else F.call_function("shiftleft", F.lit(1), i)

    def potential(known, s):
        inner = F.filter(bits, lambda i: s.bitwiseAND(bit(i)) != 0)
        less = F.aggregate(inner, F.lit(0).cast("long"), lambda a, i: a + F.get(known, s - bit(i)))
        return F.concat(known, F.array(F.get(below, _bits(s)) * F.get("value", s)["n"] + less))

    out = out.withColumn("potential", F.aggregate(F.sequence(F.lit(1), F.lit(size - 1)), F.array(F.lit(0).cast("long")), potential))
    shares = F.transform(bits, lambda i: F.get("potential", F.lit(size - 1)) - filters * F.get("potential", size - 1 - bit(i)))
    return out.withColumn("shapley", shares)


def audit(masks: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order of
    the filters and step, from masks(part, mask, n, good, toxic), one row a part and mask; bit i stands for filters[i].

    kept: rows left after the step; removed: rows that go there; redundant: rows that fail its filter and went before;
    unique_fails: rows that fail no other filter; good_lost, toxic_lost: rows removed there that are good or toxic; shapley: rows
    its filter removes, summed over all orders. Parts without a mask have no row; an empty table gives none.
    """
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(filters)))
    rows = games(masks, len(filters)).withColumn("filter_order", F.explode(orders))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    place = lambda letter: F.instr(F.lit(filters), letter) - 1
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), place(letter))
    letters = lambda n: F.filter(F.split(F.expr(f"substring(filter_order, 1, {n})"), ""), lambda c: c != "")
    rows = rows.withColumn("before", F.aggregate(letters("step - 1"), F.lit(0), lambda s, c: s + bit(c)))
    rows = rows.withColumn("own", F.expr("substring(filter_order, step, 1)"))
    rows = rows.withColumns({"place": place(F.col("own")), "bit": bit(F.col("own"))})
    value = lambda s, c="n": F.get("value", s)[c]
    after = F.col("before") + F.col("bit")
    removed = lambda c: value(after, c) - value(F.col("before"), c)
    total = value(F.lit((1 << len(filters)) - 1)) + F.get("by_mask", F.lit(0))["n"]
    return rows.select("part", "filter_order", "step", (total - value(after)).alias("kept"), removed("n").alias("removed"), (value(F.col("bit")) - removed("n")).alias("redundant"), F.get("by_mask", F.col("bit"))["n"].alias("unique_fails"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), F.get("shapley", F.col("place")).alias("shapley"))
