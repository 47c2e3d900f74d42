"""I-Match document fingerprints, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band [low, high] of all documents (an inverse-document-frequency
band of [-ln high, -ln low]). As each of its terms takes at least the share `low` of the documents, it has at most (mean distinct
terms of a document) / low terms, at any corpus size; it goes to all tasks as one sorted array of term hashes.

A document keeps its distinct terms that are in the lexicon (all of them where none is), sorted by hash. `SUBSETS` randomised
subsets of the lexicon, each with about one in 2**L terms, give one hash each of the kept terms they contain. L is such that a
subset is expected to hold one or two of the document's terms, and the next rate is used as well, so a fingerprint says
something about documents of any length and two of similar length have a rate in common. The likeness of two fingerprints is
the share of equal hashes among the subsets, of the common rates, in which either has a term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import stored

SUBSETS, DIGITS = 16, 8
PART = 2 + SUBSETS * DIGITS
NONE = "none"


def terms(text):
    """Hashes of the distinct lower-case runs of letters and digits of a text; none for null."""
    words = F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = 0.01, high: float = 0.1, text_col: str = "text") -> DataFrame:
    """One row (lexicon): the sorted hashes of the terms in the band, counted over all documents."""
    total = stored(docs.agg(F.count("*").alias("n")))
    counts = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = total.select("n").scalar()
    kept = counts.where((F.col("df") >= n * low) & (F.col("df") <= n * high))
    return stored(kept.agg(F.array_sort(F.collect_list("term")).alias("lexicon")))


def with_fingerprint(df: DataFrame, words: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column under `name`, a column df must not have. Equal texts have equal fingerprints;
    texts without a term (null and empty ones too) have the fingerprint none."""
    kept, found = f"{name}__kept", f"{name}__terms"
    df = df.withColumn(found, terms(F.col(text_col)))
    df = df.withColumn(kept, F.array_intersect(found, words.select("lexicon").scalar()))
    df = df.withColumn(kept, F.array_sort(F.when(F.size(kept) > 0, F.col(kept)).otherwise(F.col(found)))).drop(found)
    one = f"filter(`{kept}`, t -> (xxhash64(t, k) & (cast(pow(2, l) as bigint) - 1)) = 0)"
    code = f"transform(transform(sequence(0, {SUBSETS - 1}), k -> {one}), s -> if(size(s) = 0, repeat('0', {DIGITS}), lpad(lower(hex(xxhash64(s) & 4294967295)), {DIGITS}, '0')))"
    level = f"cast(floor(log2(size(`{kept}`))) as int)"
    both = f"array_join(transform(array({level}, {level} + 1), l -> concat(lpad(lower(hex(l)), 2, '0'), array_join({code}, ''))), '')"
    return df.withColumn(name, F.expr(f"if(size(`{kept}`) = 0, '{NONE}', {both})")).drop(kept)


def likeness(a: str, b: str):
    """Between 0 and 1 for two fingerprint columns; 1 for equal ones."""
    part = lambda c, k: f"substring(`{c}`, {1 + k * PART}, {PART})"
    rate = lambda c, k: f"substring(`{c}`, {1 + k * PART}, 2)"
    zero = "0" * DIGITS
    left = f"case when {rate(a, 0)} = {rate(b, 0)} then concat(substring({part(a, 0)}, 3), substring({part(a, 1)}, 3)) when {rate(a, 1)} = {rate(b, 0)} then substring({part(a, 1)}, 3) when {rate(a, 0)} = {rate(b, 1)} then substring({part(a, 0)}, 3) end"
    right = f"case when {rate(a, 0)} = {rate(b, 0)} then concat(substring({part(b, 0)}, 3), substring({part(b, 1)}, 3)) when {rate(a, 1)} = {rate(b, 0)} then substring({part(b, 0)}, 3) when {rate(a, 0)} = {rate(b, 1)} then substring({part(b, 1)}, 3) end"
    pieces = lambda s: f"transform(sequence(0, cast(length({s}) / {DIGITS} as int) - 1), i -> substring({s}, i * {DIGITS} + 1, {DIGITS}))"
    pairs = f"arrays_zip({pieces(left)}, {pieces(right)})"
    some = f"filter({pairs}, p -> p['0'] <> '{zero}' or p['1'] <> '{zero}')"
    share = f"aggregate({some}, named_struct('n', 0, 'same', 0), (acc, p) -> named_struct('n', acc.n + 1, 'same', acc.same + if(p['0'] = p['1'], 1, 0)), acc -> if(acc.n = 0, 0d, acc.same / acc.n))"
    return F.expr(f"case when `{a}` = `{b}` then 1d when `{a}` = '{NONE}' or `{b}` = '{NONE}' then 0d else coalesce(cast({share} as double), 0d) end")
