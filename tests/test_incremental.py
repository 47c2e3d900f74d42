"""Incremental extraction: reruns, replayed and cut-off batches, retries of documents with too little text."""

import json
import shutil

from pyspark.sql import functions as F

from claimgrid.operators import extract
from claimgrid.streaming import incremental


def text(n, lines=25):
    return "\n".join([f"HỢP ĐỒNG số {n}/2026/HĐXD", "Điều 1. Giá hợp đồng", f"Giá trị hợp đồng là {n}.000.000 đồng"] + [f"Đoạn văn bản thứ {i} của hợp đồng {n}" for i in range(lines)])


def drop(folder, name, docs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"doc_id": i, "text": t}) for i, t in docs), encoding="utf-8")


def rows(spark, out):
    return sorted((r.doc_id, r.ma, r.v_num, r.v_str) for r in spark.read.parquet(f"{out}/rows").collect())


def test_stream_answers_each_text_once(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    drop(src, "a.json", [("d2", text(2)), ("d1", text(1)), ("d1copy", text(1)), ("short", "too little")])
    incremental.incremental_extract(spark, str(src), out, mark)
    first = rows(spark, out)
    assert {r[0] for r in first} == {"d1", "d2"}
    assert [(r.doc_id, r.paragraphs) for r in spark.read.parquet(f"{out}/failed").collect()] == [("short", 1)]
    incremental.incremental_extract(spark, str(src), out, mark)                     # nothing new
    assert rows(spark, out) == first
    drop(src, "b.json", [("again", text(2)), ("d3", text(3)), ("short", "too little")])
    incremental.incremental_extract(spark, str(src), out, mark)
    done = rows(spark, out)
    assert {r[0] for r in done} == {"d1", "d2", "d3"} and set(first) < set(done)
    incremental.incremental_extract(spark, str(src), out, str(tmp_path / "lost"))   # a lost checkpoint answers nothing twice
    assert rows(spark, out) == done
    whole = spark.createDataFrame([("d1", text(1)), ("d2", text(2)), ("d3", text(3))], "doc_id string, text string")
    assert done == sorted((r.doc_id, r.ma, r.v_num, r.v_str) for r in extract.extract_params(extract.split_paragraphs(whole)).collect())


def test_replayed_and_cut_off_batches(spark, tmp_path):
    out = str(tmp_path / "out")
    docs = spark.createDataFrame([("d1", text(1)), ("none", None)], "doc_id string, text string")
    incremental.extract_batch(docs, 0, out)
    files = sorted(p for p in (tmp_path / "out").rglob("*.parquet"))
    incremental.extract_batch(docs, 0, out)                                         # replayed: writes nothing
    assert sorted(p for p in (tmp_path / "out").rglob("*.parquet")) == files
    more = spark.createDataFrame([("d1b", text(1)), ("d4", text(4))], "doc_id string, text string")
    incremental.extract_batch(more, 1, out)
    for part in [*(tmp_path / "out" / "keys").glob("*/batch=1"), tmp_path / "out" / "done" / "batch=1"]:
        shutil.rmtree(part)                                                         # as if cut off after the rows
    incremental.extract_batch(more, 1, out)
    incremental.extract_batch(more, 1, out)
    assert {r[0] for r in rows(spark, out)} == {"d1", "d4"}
    assert len(rows(spark, out)) == 72
    assert incremental.answered(spark, out).agg(F.count_distinct("key")).first()[0] == 2
    incremental.extract_batch(docs.limit(0), 2, out)                                # an empty batch
    assert len(rows(spark, out)) == 72
