import collections
import itertools
import random
import re

from claimgrid.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    words = WORD.findall(text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text))]


def brute(docs, labels):
    """{(part, order, step): counts} by walking every order over every row of docs [(doc_id, text, source)]."""
    quality = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows, least = [], {}
    for i, text, _ in docs:
        key = (i is None, i or 0)
        least[text or ""] = min(least.get(text or "", key), key)
    for i, text, source in docs:
        rows.append((source or "", {f for f, bad in zip("ABCDE", [*fails(text or ""), (i is None, i or 0) > least[text or ""]]) if bad}, i in quality, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = sum(f in r[1] for r in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def result(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as n", "'x' as mask", "2 as part", "3 as digest")
    found = A.audit(A.document_masks(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    return {(r[0], r[1], r[2]): list(r[3:]) for r in found.collect()}


def planted(n=150, seed=5):
    rnd, docs = random.Random(seed), []
    for i in range(n):
        words = [rnd.choice(["alpha", "Beta", "gamma", "Étude", "ZZ"]) if rnd.random() < 0.4 else f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([5, 150, 199, 200, 260]))]
        text = rnd.choice([" ", "\n", " \t", "  "]).join(words) + rnd.choice(["", "", "#", "|", "%"])
        docs.append((i, docs[rnd.randrange(len(docs))][1] if docs and rnd.random() < 0.3 else text, rnd.choice(["a", "b", None, ""])))
    return docs


def test_matches_brute_force(spark):
    docs = planted()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 200, 3)]
    assert result(spark, docs, labels) == brute(docs, labels)


def test_odd_rows(spark):
    docs = [(1, None, None), (2, "", "a"), (None, "", "a"), (None, "only here", "a"), (None, "only here", "b"), (3, "x " * 200, "b"), (3, "x " * 200, "b"), (4, "x " * 200, "c"), (5, "AAA#" * 100_000, "c"), (3, "other", "c")]
    labels = [(1, 1, None), (3, None, 1), (3, 1, 0), (None, 1, 1), (99, 1, 1)]
    assert result(spark, docs, labels) == brute(docs, labels)
    assert result(spark, [], labels) == {}
    assert set(map(tuple, result(spark, docs, []).values())) == set(map(tuple, brute(docs, []).values()))


def test_other_numbers_of_filters(spark):
    masks = spark.createDataFrame([("p", m, m + 1, 1, 0) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    rows = A.audit(masks, "XYZ").collect()
    assert len(rows) == 18
    for order in map("".join, itertools.permutations("XYZ")):
        own = sorted((r for r in rows if r.filter_order == order), key=lambda r: r.step)
        assert own[-1].kept == 1 and sum(r.removed for r in own) == 35      # all but mask 0
    by_filter = {r.filter_order[r.step - 1]: r.shapley for r in rows}
    assert sum(by_filter.values()) == 6 * 35
    for f, total in by_filter.items():
        assert total == sum(r.removed for r in rows if r.filter_order[r.step - 1] == f)
