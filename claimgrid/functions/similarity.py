"""Sequence similarity.  No built-in computes the Ratcliff-Obershelp ratio, so it runs as an Arrow UDF on pairs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgrid.functions.text import fold


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([
        None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)],
        dtype="float64")


def ratio_upper_bound(a: Column, b: Column) -> Column:
    """2*min/(|a|+|b|): the ratio can never be larger, so pairs below the threshold need no UDF."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * F.least(la, lb) / (la + lb))


def folded_similarity(fa: Column, fb: Column, measure: str = "ratio") -> Column:
    """1.0 on containment, NULL when a side is empty, else the ratio of two folded texts; measure "edit" takes the edit distance
    instead, which runs wholly in the JVM."""
    score = sequence_ratio(fa, fb) if measure == "ratio" else 1.0 - F.levenshtein(fa, fb) / F.greatest(F.length(fa), F.length(fb))
    return (F.when((fa == "") | (fb == ""), F.lit(None).cast("double"))
            .when(fa.contains(fb) | fb.contains(fa), 1.0).otherwise(score))


def similarity(a: Column, b: Column) -> Column:
    """The similarity of two texts, folded."""
    return folded_similarity(fold(a), fold(b))


def edit_similarity(a: Column, b: Column) -> Column:
    """Edit-distance alternative with the same containment rule."""
    return folded_similarity(fold(a), fold(b), "edit")
