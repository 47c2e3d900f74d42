import random

import numpy as np

from claimgrid.llm import cotrain as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, quality int"


def data(spark, n=900):
    rnd = random.Random(4)
    docs, truth = [], {}
    for i in range(n):
        good = rnd.random() < 0.7
        words = [rnd.choice("river stone cloud meadow winter garden".split()) + rnd.choice(["", "s", "ly"]) for _ in range(rnd.randint(5, 60))]
        text = " ".join(words).capitalize() + "." if good else "!! ".join(w.upper() for w in words) + "##"
        docs.append((i, text, "en", rnd.choice(["a", "b"]) if good else rnd.choice(["b", "c"]), len(text), 0, 1))
        truth[i] = int(good)
    odd = [(5000, None, None, None, None, None, None), (None, "x y", "en", "a", 3, 0, 1), (5001, "", "", "", -4, 0, 1), (5002, "river " * 40000, "en", "a", 240000, 0, 1), (3, docs[3][1], "en", "a", 9, 0, 1)]
    labels = [(i, truth[i]) for i in range(0, n, 3)] + [(None, 1), (7, None), (12, truth[12])]
    return docs, truth, spark.createDataFrame(docs + odd, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, truth, d, labels = data(spark)
    model = C.train(d, labels)
    got = C.score(d, model).collect()
    assert len(got) == len(docs) + 5 and all(0 <= r.score <= 1 for r in got)
    rest = [r for r in got if r.doc_id in truth and r.doc_id % 3]
    assert np.mean([r.keep == bool(truth[r.doc_id]) for r in rest]) > 0.97
    again = C.score(d.repartition(5), C.train(d.repartition(3), labels)).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in got} == {(r.doc_id, round(r.score, 9)) for r in again}


def test_views_teach_each_other():
    rnd = np.random.default_rng(1)
    y = rnd.integers(0, 2, 120).astype(float)
    make = lambda y: [np.stack([y * 4 + rnd.normal(size=len(y)), rnd.normal(size=len(y))], 1), np.stack([y * 4 + rnd.normal(size=len(y))], 1)]
    hidden = rnd.integers(0, 2, 400).astype(float)
    model = C.CoTrained(make(y), y, make(hidden), rounds=3, sure=0.9, most=50)
    fresh = rnd.integers(0, 2, 400).astype(float)
    t, m = make(fresh)
    a, b, both = model.scores(t, m)
    right = lambda p: np.mean((p > 0.5) == (fresh > 0.5))
    assert right(a) > 0.9 and right(b) > 0.9 and right(both) > 0.97


def test_few_or_no_labels(spark):
    docs, _, d, labels = data(spark, 60)
    assert {r.score for r in C.score(d, C.train(d, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in C.score(d, C.train(d, labels.where("quality = 1"))).collect()} == {1.0}
    assert C.score(d.limit(0), C.train(d.limit(0), labels)).count() == 0
