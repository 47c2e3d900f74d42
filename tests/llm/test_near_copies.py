import collections
import random

import corpus_pipeline as P

from claimgrid.llm import near_copies as N


def brute_kept(docs):
    """Ids that stay of {id: text}: one of each group joined by pairs at least 0.8 alike on five-word shingles."""
    def shingles(text):
        w = text.lower().split()
        return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    ids = sorted(docs)
    sets, words, root = {i: shingles(docs[i]) for i in ids}, {i: docs[i].lower().split() for i in ids}, {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if words[i] == words[j] or both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted({top(i) for i in ids})


def planted(seed=3, n=60):
    """Texts of 20 to 200 words with copies of one to eight edited words: alike on either side of 0.8."""
    rnd, docs = random.Random(seed), {}
    vocabulary = [f"w{k}" for k in range(400)]
    for k in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 200))]
        docs[10 * k] = " ".join(words)
        for c in range(1, 6):
            copy = list(words)
            for _ in range(rnd.choice([1, 1, 2, 3, 5, 8])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            docs[10 * k + c] = " ".join(copy)
    docs |= {9001: "", 9002: " ", 9003: "one two", 9004: "ONE\ttwo", 9005: "one three"}
    return docs


def test_stage_matches_brute_force(spark):
    docs = planted()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in P.remove_near_duplicates(spark, df, "").collect()) == brute_kept(docs)


def test_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 2)
    docs = planted(4, 12)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_one(df).collect()) == brute_kept(docs)


def test_large_groups_with_texts_outside_the_largest_class(spark, monkeypatch):
    """Proposals join everything; classes lie apart, meet only through far blocks, or hold one text."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 7)
    rnd, docs = random.Random(8), planted(8, 14)
    chain = [f"c{k}" for k in range(60)]
    for k in range(40):                                 # neighbours are alike, the ends are not
        docs[5000 + k] = " ".join(chain)
        chain[rnd.randrange(60)] = f"d{k}"
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items() if t.strip()], "tid long, text string, root long")
    sets = df.rdd.map(lambda r: (r.root, r.tid, bytearray(N.shingle_set(r.text.encode()).tobytes()))).toDF("root long, tid long, set binary")
    found = {r.u: r.v for r in N.joined(sets, 0.8).collect()}
    texts = {i: t for i, t in docs.items() if t.strip()}
    assert sorted({found.get(i, i) for i in texts}) == brute_kept(texts)


def test_joined_further():
    from claimgrid.llm.simhash import joined_further, least_joined
    rnd = random.Random(1)
    pairs = [(rnd.randrange(50), rnd.randrange(50)) for _ in range(40)]
    least = N.np.arange(50)
    for k in range(0, 40, 5):
        least = joined_further(least, *(N.np.array(c) for c in zip(*pairs[k : k + 5])))
    assert (least == least_joined(50, *(N.np.array(c) for c in zip(*pairs)))).all()


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (7, "one two three four", "a"), (7, "one two three four", "a"), (None, "solo words here now", "b"), (None, "other words stand there", "b")]
    rows += [(7, "a text that has nothing in common with it", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == {1: 1, 7: 2, None: 2}
    assert N.keep_one(df.limit(0)).count() == 0
