import random

from claimgrid.llm import decontaminate as D


def slow(pattern, text):
    prev, best = list(range(len(pattern) + 1)), len(pattern)
    for c in text:
        now = [0]
        for i, p in enumerate(pattern, 1):
            now.append(min(prev[i] + 1, now[i - 1] + 1, prev[i - 1] + (p != c)))
        prev, best = now, min(best, now[-1])
    return best


def masks(pattern):
    peq = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def test_myers_matches_dynamic_programming():
    rnd = random.Random(2)
    for _ in range(200):
        p, t = ("".join(rnd.choices("ab c", k=rnd.randint(a, b))) for a, b in ((1, 90), (1, 120)))
        hit = D.myers(masks(p), len(p), t, 10**6)
        assert min(len(p), hit[0]) == slow(p, t)


def edited(rnd, text, n):
    s = list(text)
    for _ in range(n):
        i = rnd.randrange(1, len(s) - 1)
        s[i:i + 1] = rnd.choice([[], ["q"], [s[i], "q"]])
    return "".join(s)


def test_operator_matches_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rnd.randint(5, 30)).upper() + "!") for i in range(30)] + [(90, None), (91, ""), (92, "ab"), (None, prose(12))]
    docs = [(i, prose(rnd.randint(0, 60)), "x", 1) for i in range(60)]
    for i in range(60, 160):
        item = rnd.choice(items[:30])[1]
        docs.append((i, prose(20) + "\n" + edited(rnd, D.plain(item).strip(), rnd.randint(0, 14)) + ", " + prose(10), "x", 1))
    docs += [(200, None, "x", 1), (201, "", "x", 1), (None, items[0][1], "x", 1), (7, items[-1][1] * 2, None, None), (202, "zz " * 50000 + items[1][1], "x", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, edits int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for doc, text, *_ in docs:
        line = D.plain(text)
        for item, t in items:
            p = D.plain(t)
            if line and len(p) >= 24 and len(line) < 5000:
                edits = slow(p, line)
                if edits <= D.budget(len(p), 0.06, 12):
                    want.add((doc, item, edits))
    got = {tuple(r) for r in D.contaminated(d, b).collect()}
    assert {g for g in got if g[0] != 202} == want and (202, 1, 0) in got and len(want) > 40
    kept = D.decontaminated(d, b)
    assert kept.columns == d.columns
    flagged = {g[0] for g in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in docs if r[0] not in flagged or (r[0] == 7 and r[1] != items[-1][1] * 2))
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0 and D.decontaminated(d, b.limit(0)).count() == d.count()


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, f"the item number {i} of a long list of things {i * 7}") for i in range(9)]
    d = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, D.contaminated(d, b).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, D.contaminated(d, b).collect())) == one


def test_short_items_stand_as_whole_words(spark):
    """Under two pieces of letters: no edit, whole words; a single short word is no evidence."""
    d = spark.createDataFrame([(1, "Is it 7 or 8, then?"), (2, "is it 7 or 88"), (3, "this it 7 or 8"), (4, "ab"), (5, "首都是哪里呢 问"), (6, "x 法国的首都是哪里呢 y")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "it 7 or 8"), (2, "ab"), (3, "法国的首都是哪里呢")], "item_id long, text string")
    assert sorted(map(tuple, D.contaminated(d, b).collect())) == [(1, 1, 0), (3, 1, 0), (6, 3, 0)]
