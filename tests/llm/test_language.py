import math
import random
import zlib

import numpy as np

from claimgrid.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, lang_pred string, lang_score int"
WORDS = {"xx": "ba ko ti ramu seno pali".split(), "yy": "ächz grüb ölst würd thorn schmied".split()}


def rows(n, seed=4):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choices(WORDS[k], k=rnd.randint(3, 40))).title() + ".", k) for i in range(n) for k in [rnd.choice(list(WORDS))]]


def slow_model(texts):
    """Interpolated Kneser-Ney from dictionaries: p(context, character)."""
    n = L.ORDER
    tables = {n: {}}
    for t in texts:
        s = L.symbols(t).tolist()
        for i in range(n - 1, len(s)):
            g = tuple(s[i - n + 1:i + 1])
            tables[n][g] = tables[n].get(g, 0) + 1
    for k in range(n - 1, 0, -1):
        tables[k] = {}
        for g in tables[k + 1]:
            tables[k][g[1:]] = tables[k].get(g[1:], 0) + 1
    return tables


def slow_p(tables, alphabet, ctx, c):
    n = len(ctx) + 1
    t = tables[n]
    lower = 1 / (alphabet + 1) if n == 1 else slow_p(tables, alphabet, ctx[1:], c)
    own = {g: v for g, v in t.items() if g[:-1] == ctx}
    if not own:
        return lower
    ones, twos = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
    cut = ones / (ones + 2 * twos) if ones and twos else 0.5
    total = sum(own.values())
    return max(own.get(ctx + (c,), 0) - cut, 0) / total + cut * len(own) / total * lower


def test_probabilities_match_brute_force():
    data = rows(12)
    counts, slow = [], []
    for k in ("xx", "yy"):
        texts = [t for _, t, lang in data if lang == k]
        slow.append(slow_model(texts))
        g = np.array(list(slow[-1][L.ORDER]), np.uint32)
        counts.append((g, np.array(list(slow[-1][L.ORDER].values()))))
    model = L.Model(["xx", "yy"], counts)
    alphabet = len({g[0] for s in slow for g in s[1]})
    for text in ("Ba ko", "grüb ramu q", "zzz", "Ölst."):
        seq = L.symbols(text)
        got = model.logs(seq)
        for i in range(len(got)):
            for k in (0, 1):
                want = math.log(slow_p(slow[k], alphabet, tuple(seq[i:i + L.ORDER - 1].tolist()), int(seq[i + L.ORDER - 1])))
                assert abs(got[i, k] - want) < 1e-4, (text, i, k)


def test_batches_do_not_mix_texts():
    data = rows(40)
    by = {k: [t for _, t, x in data if x == k] for k in WORDS}
    counts = []
    for k in by:
        t = slow_model(by[k])[L.ORDER]
        counts.append((np.array(list(t), np.uint32), np.array(list(t.values()))))
    model = L.Model(list(by), counts)
    texts = ["ba", "", "grüb", "1 2", "seno pali"]
    one = [model.entropies([t])[0][0] for t in texts]
    assert np.allclose(model.entropies(texts)[0], one)


def test_identify(spark):
    data = [(i, t, k, "clash", 1) for i, t, k in rows(400)]
    odd = [(1000, None, "xx", None, None), (1001, "", None, None, None), (1002, "12 !?", "yy", None, None), (None, "ba ko ti", "xx", None, None), (1003, "ba ko ti " * 20000, None, None, None), (1003, "ba ko ti", None, None, None), (1004, "日本語の文章です" * 30, "xx", None, None)]
    df = spark.createDataFrame(data + odd, SCHEMA)
    model = L.train(df.where("doc_id is null or doc_id < 1000"))
    found = L.identify(df, model)
    assert found.columns == df.columns + ["lang_pred_", "lang_score_", "lang_entropy", "lang_rejected"]
    got = [(r.doc_id, r.lang, r.lang_pred_, r.lang_score_, r.lang_rejected) for r in found.collect()]
    held = [g for g in got if g[0] is not None and g[0] < 1000 and zlib.crc32(str(g[0]).encode()) % 4 == 2]
    assert len(held) > 50 and all(g[1] == g[2] and not g[4] for g in held)
    assert all(0 <= g[3] <= 1 for g in got)
    rest = {(g[0], g[2], g[4]) for g in got if g[0] is None or g[0] >= 1000}
    assert {(1000, "und", True), (1001, "und", True), (1002, "und", True), (None, "xx", False), (1003, "xx", False)} < rest
    assert [x[2] for x in rest if x[0] == 1004] == [True]
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 400 + 3
    assert L.keep_identified(df.limit(0)).count() == 0
    assert {r.lang_pred_ for r in L.identify(df, L.train(df.limit(0))).collect()} == {"und"}


def test_long_texts_are_scored_in_parts(monkeypatch):
    data = rows(40)
    counts = []
    for k in WORDS:
        t = slow_model([t for _, t, x in data if x == k])[L.ORDER]
        counts.append((np.array(list(t), np.uint32), np.array(list(t.values()))))
    model = L.Model(list(WORDS), counts)
    text = "ba ko ramu grüb " * 3000
    whole, sizes, square = model.entropies([text, "", "ölst"], squares=True)
    monkeypatch.setattr(L, "SCORED_BYTES", 100)
    again, sizes2, square2 = model.entropies([text, "", "ölst"], squares=True)
    assert np.allclose(whole, again) and np.allclose(square, square2) and (sizes == sizes2).all()
