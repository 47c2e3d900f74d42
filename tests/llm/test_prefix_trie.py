import hashlib
import random
import zlib

import pytest

from claimgrid.llm import prefix_trie as P


def keys(seq):
    out, key = b"", b""
    for s in seq:
        key = hashlib.blake2b(key + bytes([s]), digest_size=P.KEY).digest()
        out += key
    return out


def test_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert P.fattest(low, high) == max(range(low + 1, high + 1), key=lambda n: n & -n)


@pytest.mark.parametrize("seed", range(20))
def test_batches_keep_every_prefix_and_handle(seed):
    rnd = random.Random(seed)
    seqs = {tuple(rnd.choice([0, 0, 0, 1, 2]) for _ in range(rnd.randint(0, rnd.choice([5, 40])))) for _ in range(rnd.randint(1, 80))}
    seqs = [keys(s) for s in rnd.sample(sorted(seqs), len(seqs))]
    trie, at, ends = P.ZFastTrie(), 0, []
    while at < len(seqs):
        step = rnd.randint(1, 20)
        ends += trie.insert(seqs[at : at + step])
        at += step
    prefixes = {(d, s[P.KEY * (d - 1) : P.KEY * d]) for s in seqs for d in range(1, len(s) // P.KEY + 1)}
    nodes = range(1, len(trie.parent))
    assert {(d, trie.key(trie.keys[trie.seq[n]], d)) for n in nodes for d in range(trie.top[n] + 1, trie.end[n] + 1)} == prefixes
    assert trie.handles == {trie.key(trie.keys[trie.seq[n]], P.fattest(trie.top[n], trie.end[n])): n for n in nodes}
    for s, n in zip(seqs, ends):
        assert trie.end[n] * P.KEY == len(s)
        at, node = trie.locate(s)                       # it ends at a node of its own
        assert (at, node) == (n, -1) or node == -1 and trie.end[at] * P.KEY == len(s)


def rebuilt(rows):
    """{conv_id: [(role, text), ...]}, by walking."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def brute(convs):
    """Sorted rows of the trie of {conv_id: turns}, by listing every prefix."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves, saved = below.get(p, (0, 0))
        leaves, saved = leaves or 1, saved + own
        if p:
            up = below.get(p[:-1], (0, 0))
            below[p[:-1]] = up[0] + leaves, up[1] + saved
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), leaves, saved, sha))
    return sorted(out, key=repr)


def found(spark, rows, build=P.rebuilt_turns):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as key", "1 as n", "2 as place")
    return sorted((tuple(r) for r in P.trie(P.sequences(build(df))).collect()), key=repr)


def planted(n=60, seed=2):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rnd.choice([1, 2, 5, 12])):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["yes", "nö", "", None, "long " * 50])))
    return rows


def test_matches_brute_force(spark):
    rows = planted()
    assert found(spark, rows) == brute(rebuilt(rows))


def test_many_ranges_and_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "TURNS", 10)
    rows = planted(40, 3) + [(c, t, "user", f"copy {t}") for c in range(100, 140) for t in range(6)]
    rows += [(200, t, "user", str(t % 2)) for t in range(300)]
    whole = {}
    for c, _, role, text in rows:
        whole.setdefault(c, []).append((role or "", text or ""))
    assert found(spark, rows, P.whole_turns) == brute(whole)
    assert found(spark, rows) == brute(rebuilt(rows))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 1, "b", "x"), (7, 1, "a", "y"), (7, 1, "a", "y"), (-7, 0, "user", "minus"), (-5, 0, "user", "five"), (-5, 1, "user", "more")]
    rows += [(9223372036854775807, 0, "user", "last"), (-9223372036854775808, 0, "user", "first"), (3, 0, "user", "ü" * 100_000)]
    assert found(spark, rows) == brute(rebuilt(rows))
    assert found(spark, []) == []
