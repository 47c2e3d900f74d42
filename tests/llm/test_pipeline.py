import collections

import corpus_pipeline as P

from claimgrid.llm import decontaminate
from claimgrid.llm.common import table
from test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    start = {r.doc_id: r.text for r in docs.collect()}
    out = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, SF))
        out[name] = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: [r.doc_id for r in rows] for n, rows in out.items()}
    assert len(ids["language_id"]) >= 0.97 * len(start)
    # one document of each group that exact likeness of 0.8 joins stays (groups within five bits were the stage's rule before)
    assert sorted(ids["near_dedup"]) == brute_kept({i: start[i] for i in ids["language_id"]})
    items = [decontaminate.plain(r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = {i for i in ids["near_dedup"] if any(t in decontaminate.plain(start[i]) for t in items if len(t) >= 24)}
    assert hit and set(ids["decontamination"]) == set(ids["near_dedup"]) - hit
    copies = collections.Counter(ids["mixing"])
    assert set(copies) <= set(ids["decontamination"]) and max(copies.values()) <= 3
    last = P.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    assert collections.Counter(r.doc_id for r in last) == copies
    assert [r.doc_id for r in last] == sorted(r.doc_id for r in last)
    at = 0
    for r in last:
        assert r.start == at
        at += r.n_tokens
    assert P.ORACLE_SQL is None
