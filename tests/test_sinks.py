"""Sinks, readers and the incremental stream, with reruns and broken input."""

import zipfile

import pytest
from pyspark.sql import functions as F

from claimgrid.session import shared_dir
from claimgrid.sinks import tables
from claimgrid.sources import files


def test_upsert_replaces_whole_pairs_of_a_hot_contract(spark, tmp_path):
    at = str(tmp_path / "periods")
    rows = [("HD1", d, f"HM{i}", float(i)) for d in (1, 2) for i in range(40)] + [(f"HD{c}", 1, "HM0", 1.0) for c in range(2, 8)]
    schema = "ma_hd string, dot long, ma_hm string, kl double"
    tables.upsert_period(spark.createDataFrame(rows, schema), at, buckets=4)
    again = spark.createDataFrame([("HD1", 1, "HM5", 7.0, 1), ("HD1", 1, "HM5", 8.0, 2)], schema + ", seq int")
    for _ in range(2):                                           # a rerun changes nothing
        tables.upsert_period(again, at, buckets=4)
        got = {(r.ma_hd, r.dot, r.ma_hm): r.kl for r in spark.read.parquet(at).collect()}
        assert got == {k: v for *k, v in [r for r in rows if r[:2] != ("HD1", 1)] for k in [tuple(k)]} | {("HD1", 1, "HM5"): 8.0}


def test_audit_log_only_grows(spark, tmp_path):
    at = str(tmp_path / "log")
    tables.append_audit_log(spark, at, "ghi", "HD1", "a")
    tables.append_audit_log(spark, at, "hủy", "HD2", "b")
    assert {(r.thao_tac, r.ma_hd, r.chi_tiet) for r in spark.read.parquet(at).collect()} == {("ghi", "HD1", "a"), ("hủy", "HD2", "b")}


def test_documents_are_read_whole_and_broken_ones_reported(spark, tmp_path):
    (tmp_path / "long.txt").write_text("dòng\n" * 60_000, encoding="utf-8")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "empty.docx", "w") as z:
        z.writestr("x", "y")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF-1.4")
    got = {r.file.rsplit("/", 1)[-1]: r for r in files.read_document_text(spark, str(tmp_path)).collect()}
    assert len(got["long.txt"].text) == 5 * 60_000
    assert got["broken.docx"].note.startswith("unreadable") and got["empty.docx"].note.startswith("unreadable") and got["scan.pdf"].note


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    assert shared_dir(spark)
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_actions_are_logged_once(spark, tmp_path):
    at = str(tmp_path / "actions")
    rows = lambda ids: spark.createDataFrame([(i, "ghi", f"HD{i % 3}", "x") for i in ids], "action_id long, thao_tac string, ma_hd string, chi_tiet string")
    tables.append_actions(rows([1, 2, 2]), at, buckets=4)
    for _ in range(2):
        tables.append_actions(rows([2, 3]), at, buckets=4)
    tables.append_actions(rows([]), at, buckets=4)
    assert sorted(r.action_id for r in spark.read.parquet(at).collect()) == [1, 2, 3]


def test_a_run_is_seen_by_its_manifest(spark, tmp_path):
    import shutil

    from claimgrid.sinks import base_set
    at = str(tmp_path)
    assert base_set.committed(spark, at, "1") == {}
    base_set.commit_tables({"BOQ tong": spark.range(3), "Nhat ky": spark.range(1)}, at, "1")
    base_set.commit_tables({"BOQ tong": spark.range(2), "Nhat ky": spark.range(1)}, at, "1")        # repeated
    assert {n: d.count() for n, d in base_set.committed(spark, at, "1").items()} == {"BOQ tong": 2, "Nhat ky": 1}
    shutil.rmtree(tmp_path / "1" / base_set.MANIFEST)
    assert base_set.committed(spark, at, "1") == {}                                                 # cut off


def test_totals_in_one_pass(spark):
    from claimgrid.sinks import base_set
    lines = spark.createDataFrame([("A", "g", "1", 2.0), ("A", "g", "2", 3.0), ("A", "h", "3", 4.0), ("B", "g", "1", 5.0)], "ma_hd string, nhom string, ma_hm string, v double")
    got = {(r.ma_hd, r.nhom, r.ma_hm, r.level): r.thanh_tien for r in base_set.with_totals(lines, ["ma_hd", "nhom", "ma_hm"], F.col("v")).collect()}
    assert got[("A", None, None, 1)] == 9.0 and got[("A", "g", None, 2)] == 5.0 and got[("B", "g", "1", 3)] == 5.0 and len(got) == 4 + 3 + 2
