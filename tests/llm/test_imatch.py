import hashlib
import random

from pyspark.sql import functions as F

from claimgrid.llm import imatch, queries, successor


def docs_of(spark, n=700, seed=8):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i * 37, " ".join(rnd.choices(vocab[: 60 + i % 340], k=rnd.randint(1, 120))).capitalize()) for i in range(n)]
    rows += [(5, None), (6, ""), (7, "!!!"), (8, "日本 語"), (8, "second of eight"), (9, rows[3][1]), (70_000_000, "far away " * 3000), (-5, "negative")]
    return rows, spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, fingerprint string, span int, n_chars int")


def likeness(a, b):
    if a == b:
        return 1.0
    if "none" in (a, b):
        return 0.0
    cut = lambda f: {f[k:k + 2]: [f[k + 2 + 8 * i:k + 10 + 8 * i] for i in range(16)] for k in (0, 130)}
    x, y = cut(a), cut(b)
    pairs = [p for k in x if k in y for p in zip(x[k], y[k]) if p != ("0" * 8, "0" * 8)]
    return sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0


def test_query_against_brute_force(spark, tmp_path):
    rows, df = docs_of(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in queries.op8(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: r[0])
    eights = [r for r in rows if r[0] == 8]
    tries = []
    for pair in (eights, eights[::-1]):                      # rows of one id are ordered by a hash
        ids = [r for r in order if r[0] != 8]
        at = sum(r[0] < 8 for r in ids)
        tries.append(ids[:at] + pair + ids[at:])
    print_of = {}
    for own in tries:
        want, texts = set(), [t or "" for _, t in own]
        for (i, _), t, n in zip(own, texts, texts[1:] + texts[:1]):
            k = len(t) // 4
            want.add((i, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
        if want == {(r.doc_id, r.n_chars, r.edited_sha256) for r in got}:
            break
    else:
        raise AssertionError("next documents differ")
    for r in got:
        print_of.setdefault((r.doc_id, r.n_chars), r.fingerprint)
        assert abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
    for (i, t), (j, u) in zip(own, own[1:] + own[:1]):
        r = next(r for r in got if (r.doc_id, r.n_chars) == (i, len(t or "")))
        assert abs(r.near_next - likeness(r.fingerprint, print_of[(j, len(u or ""))])) < 1e-12
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[9] == same[rows[3][0]] and same[5] == same[6] == same[7] == "none"
    assert sum(r.near_edited for r in got) > 10 * sum(r.near_next for r in got if r.near_next < 1) / 4


def test_lexicon_is_the_band(spark):
    rows, df = docs_of(spark)
    got = set(imatch.lexicon(df, 0.02, 0.3).first()[0])
    count = {}
    import re
    for _, t in rows:
        for w in {w for w in re.split(r"[\W_]+", (t or "").lower()) if w}:
            count[w] = count.get(w, 0) + 1
    band = [w for w, c in count.items() if 0.02 * len(rows) <= c <= 0.3 * len(rows)]
    want = {r[0] for r in spark.createDataFrame([(w,) for w in band], "w string").select(F.xxhash64("w")).collect()}
    assert got == want and want


def test_empty_and_single(spark, tmp_path):
    df = spark.createDataFrame([(4, "only one here")], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/one/documents.parquet")
    r = queries.op8(spark, f"{tmp_path}/one").first()
    assert r.edited_sha256 == hashlib.sha256(b"only one honl").hexdigest() and r.near_next == 1.0
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op8(spark, f"{tmp_path}/none").count() == 0
    spans = spark.createDataFrame([(s,) for s in (-9, 0, 1, 5000, 90000)], "span long")
    assert sorted(map(tuple, successor.next_spans(spans).collect())) == [(-9, 0), (0, 1), (1, 5000), (5000, 90000), (90000, -9)]


def test_no_python_in_the_plan(spark):
    plan = queries.op8(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
