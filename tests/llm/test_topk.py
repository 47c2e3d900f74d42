import math
import random

import pytest
from pyspark.sql import functions as F

from claimgrid.llm import exact_topk as K


def brute(rows, k=5, scale=256):
    """Sorted (query_id, rank, vec_id, score) of rows [(id, vector)], by every pair."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(scale * x) if abs(x) < 2**50 else int(x) * scale for x in v] for _, v in good]
    out = []
    for q, (i, _) in enumerate(good):
        if i is None or i % 50:
            continue
        found = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[c])))), j) for c, (j, _) in enumerate(good) if c != q]
        found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def search(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, row string, score string").repartition(3)
    return sorted((tuple(r) for r in K.top_k(df, F.col("vec_id") % 50 == 0).collect()), key=repr)


def rows_of(n=300, width=8, seed=1):
    rnd = random.Random(seed)
    return [(i, [rnd.choice([0.0, rnd.uniform(-1, 1), 0.25]) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("piece", [4096, 7])
def test_matches_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(K, "PIECE", piece)
    rows = rows_of()
    assert search(spark, [(*r, "a", "b") for r in rows]) == brute(rows)


def test_blocks_of_queries_and_candidates(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERY_BYTES", 300)
    monkeypatch.setattr(K, "CANDIDATE_BYTES", 5000)
    rows = rows_of(400, 6, 2)
    assert search(spark, [(*r, "a", "b") for r in rows]) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.1, -0.1, 0.3]), (100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (300, [])]
    rows += [(None, [1.0, 0.5]), (None, [0.0, 0.0]), (-50, [-0.001, 0.001]), (7, [0.0, 0.0]), (8, [1.0, 0.5]), (9, [1.0, 0.5])]
    assert search(spark, [(*r, None, None) for r in rows]) == brute(rows)
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0], "", "")]) == []                      # no other row


def test_long_bounds_and_ties(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 3.0]), (50, [0.0, 2.0]), (4, [5.0**20, 0.5]), (100, [5.0**20, 5.0**20])]
    rows += [(n, [0.5, 0.5]) for n in range(1000, 1060)]
    assert search(spark, [(*r, None, None) for r in rows]) == brute(rows)
