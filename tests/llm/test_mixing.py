import collections

import numpy as np
import pytest

from claimgrid.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, mix_size int, row string, shard string"


def test_targets():
    assert M.targets([100, 100, 100]).tolist() == [50, 100, 150]
    got = M.targets([1000, 10, 10, 0])
    assert got.tolist() == [990 - 30, 30, 30, 0]
    assert M.targets([]).tolist() == [] and M.targets([0, 0]).tolist() == [0, 0]


def test_quotas_are_split_exactly():
    quotas = [5, 0, 1000, 37]
    got = M.split_quotas(quotas, 7, 3)
    assert got.sum(axis=0).tolist() == quotas and set(got.sum(axis=1).tolist()) <= {148, 149}
    assert (got == M.split_quotas(quotas, 7, 3)).all()


def rows():
    rnd = np.random.default_rng(6)
    out = []
    for i in range(900):
        source = ["big", "big", "mid", "tiny", None][rnd.integers(0, 5)] if i else "once"
        out.append((i, "w " * int(rnd.integers(1, 60)), source, 1, "r", "s"))
    return out + [(2000, None, "big", 1, "r", "s"), (2001, "", None, 1, "r", "s"), (None, "null id", "mid", 1, "r", "s"), (7, "same id", "mid", 1, "r", "s"), (7, "same id", "mid", 1, "r", "s"), (2002, "long " * 40000, "big", None, None, None)]


def test_mix_meets_targets(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = [(r.row.source, r.row.doc_id, r.mix_size, r.mix_source_size, r.mix_target, r.mix_draws) for r in M.mix(df, shards=5, seed=3).collect()]
    assert len(got) == len(rows())
    by = collections.defaultdict(list)
    for g in got:
        by[g[0]].append(g)
    names = sorted((s for s in by if s is not None)) + [None]
    sizes = [sum(g[2] for g in by[s]) for s in names]
    want = M.targets(sizes)
    for s, size, t in zip(names, sizes, want):
        assert {g[3] for g in by[s]} == {size} and all(abs(g[4] - t) < 1e-6 for g in by[s])
        taken = sum(g[2] * len(g[5]) for g in by[s])
        biggest = max(g[2] for g in by[s])
        assert abs(taken - t) <= (0.01 * t + 2 if biggest < 1000 else biggest / 2), (s, taken, t)
        assert all(len(g[5]) <= 3 and len({d["pass"] for d in g[5]}) == len(g[5]) for g in by[s])
    again = M.mix(df.repartition(7), shards=5, seed=3)
    key = lambda r: (str(r.row.doc_id), r.row.text or "", str(r.mix_draws))
    assert sorted(map(key, again.collect())) == sorted(map(key, M.mix(df, shards=5, seed=3).collect()))
    mixed = M.mixed_rows(df, shards=5, seed=3)
    assert mixed.columns == df.columns
    copies = collections.Counter((r.doc_id, r.text) for r in mixed.collect())
    expect = collections.Counter()
    for r in again.collect():
        expect[(r.row.doc_id, r.row.text)] += len(r.mix_draws)
    assert copies == +expect


def test_bounds(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert M.mix(df.limit(0)).count() == 0 and M.mixed_rows(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.mix(df, max_sources=2)
