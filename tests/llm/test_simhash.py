import random

import pytest
import xxhash

from claimgrid.llm import simhash as S
from tests_llm_helpers import groups


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints_match_brute_force():
    rnd = random.Random(5)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = "".join(rnd.choice(["Ab", "é", "C", " ", "x y"]) + rnd.choice([" ", "\t", "\n", "  ", "\x0b"]) for _ in range(n))
        assert S.simhash(text.encode()) == brute_print(text)
    assert S.simhash(None) == 0


@pytest.mark.parametrize("bits,near", [(2, 3), (2, 2048), (5, 2048), (5, 40)])      # small windows: the finer variants take part
def test_groups_match_brute_force(spark, monkeypatch, bits, near):
    monkeypatch.setattr(S, "NEAR", near)
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(25)]
    fps = {}
    for i in range(260):
        f = rnd.choice(base) if rnd.random() < 0.9 else rnd.getrandbits(64)
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 4, 5, 6])):
            f ^= 1 << rnd.randrange(64)
        fps[i] = f
    for i, bit in enumerate(range(8)):
        fps[300 + i] = base[0] ^ (1 << bit)
    fps[400] = 0
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(i, i, signed(f)) for i, f in fps.items()], "doc_id long, row_key long, fp long")
    got = {r.doc_id: r.component_id for r in S.groups(df, bits).collect()}
    assert got == groups(fps, bits)


def test_odd_rows(spark):
    schema = "doc_id long, text string, row_key string, fp int, u int"
    rows = [(1, None, "a", 1, 1), (2, "", "a", 1, 1), (3, "one two three four", "a", 1, 1), (3, "one two three four", "a", 1, 1), (None, "solo words here now", "a", 1, 1), (5, "ONE two\nthree four", None, None, None), (6, "w " * 30000, "b", 2, 2)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, None), (5, 3), (6, 6)}
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in kept.collect())) == [(False, 1), (False, 3), (False, 6), (True, 0)]
    assert S.near_duplicates(df.limit(0)).count() == 0 and S.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("near", [4, 16])
def test_second_round_buckets_overflow(spark, monkeypatch, near):
    """Equal but for low bits of the third segment, and one print whose only neighbours are far off in every bucket they share."""
    monkeypatch.setattr(S, "NEAR", near)
    low = [1 << 43 | k << 44 for k in range(64)]
    fps = {i: f | 0b1000 << 60 for i, f in enumerate(low)} | {64: low[0] | 0b0111 << 60}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(i, i, signed(f)) for i, f in fps.items()], "doc_id long, row_key long, fp long")
    got = {r.doc_id: r.component_id for r in S.groups(df, 5).collect()}
    assert got == groups(fps, 5) and got[64] == 0


def test_groups_are_not_told_apart_by_ids(spark):
    """One id with two unrelated texts, and near copies without ids: one row of each group stays."""
    words = [f"word{k}" for k in range(400)]
    copy = " ".join(words[:-1] + ["other"])
    assert 0 < (S.simhash(" ".join(words).encode(), 2) ^ S.simhash(copy.encode(), 2)).bit_count() <= 5
    rows = [(7, "one two three four"), (7, "nothing of this stands there"), (None, " ".join(words)), (None, copy)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, bits=5).collect()
    assert sorted(r.text for r in kept if r.doc_id == 7) == sorted(t for i, t in rows if i == 7)
    assert sum(r.doc_id is None for r in kept) == 1
