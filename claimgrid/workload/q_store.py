"""Fixed-layout sheets, text sources and sinks: derived from the driver tables, written or laid out as cells, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgrid.session import shared_dir
from claimgrid.sinks import tables as sinks
from claimgrid.sources import files, sheets
from claimgrid.workload.registry import query


def folder(w, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(w.spark)}/claimgrid-store/{name}-{uuid.uuid4().hex}"


def laid_out(df: DataFrame, file, sheet: str, row, columns: dict) -> DataFrame:
    """Cells of a sheet with one row per row of df; columns: column number -> text or (number,)."""
    one = [F.struct(F.lit(i).cast("bigint").alias("col"), (F.lit(None).cast("string") if isinstance(c, tuple) else c.cast("string")).alias("v_str"), (c[0].cast("double") if isinstance(c, tuple) else F.lit(None).cast("double")).alias("v_num")) for i, c in columns.items()]
    return df.select(file.cast("string").alias("file"), F.lit(sheet).alias("sheet"), row.cast("bigint").alias("row"), F.inline(F.array(*one))).filter("v_str is not null or v_num is not null")


def master_cells(w):
    n = F.row_number().over(W.partitionBy("ma_hd").orderBy("id")) + 1
    boq = w.boq_base.withColumn("n", n)
    boq = laid_out(boq, F.col("ma_hd"), "BOQ", F.col("n"), {1: F.col("ma_hm"), 2: F.col("stt"), 3: F.col("nhom"), 4: F.col("ten"), 5: F.col("dvt"), 6: (F.col("kl"),), 7: (F.col("don_gia"),), 11: F.when(F.col("id") % 2 == 0, F.col("khoa"))})
    kt = w.period_items.filter("dot = 9").withColumn("n", F.row_number().over(W.partitionBy("ma_hd").orderBy("ma_hm")) + 1)
    return boq.unionByName(laid_out(kt, F.col("ma_hd"), "KL ky truoc", F.col("n"), {1: F.col("ma_hm"), 4: (F.col("kl_luy_ke"),), 7: (F.col("dot"),)}))


@query("SRC-09_read_master", "SELECT ma_hd AS file, ma_hm, khoa, kl, don_gia FROM boq_base")
def _(w):
    return sheets.read_master(master_cells(w))["boq"].select("file", "ma_hm", "khoa", "kl", "don_gia")


@query("SRC-09_master_prior", "SELECT ma_hd AS file, ma_hm, kl_luy_ke AS kl, CAST(dot AS DOUBLE) AS dot FROM period_items WHERE dot = 9")
def _(w):
    return sheets.read_master(master_cells(w))["prior"].select("file", "ma_hm", "kl", F.col("dot").cast("double").alias("dot"))


def catalogue_cells(w):
    """Three wide catalogues; some rows are examples by their number, their note or a blank number."""
    c = w.contracts.select("cust", "so_hd", "phan_loai").withColumn("file", F.concat(F.lit("DM"), (F.col("cust") % 3).cast("string")))
    heads = c.select("file").distinct()
    top = laid_out(heads, F.col("file"), "DANH_MUC_HD", F.lit(4), {2: F.lit("TC-01"), 3: F.lit(" TC-02 "), 4: F.lit("ghi")})
    names = laid_out(heads, F.col("file"), "DANH_MUC_HD", F.lit(5), {2: F.lit("Số hợp đồng"), 3: F.lit("Loại"), 4: F.lit("Ghi chú")})
    k = F.col("cust") % 10
    no = F.when(k == 7, F.concat(F.lit("VD-"), "so_hd")).when(k != 5, F.col("so_hd"))
    body = laid_out(c, F.col("file"), "DANH_MUC_HD", 6 + F.floor(F.col("cust") / 3), {2: no, 3: F.col("phan_loai"), 4: F.when(k == 3, F.lit("Ví dụ minh họa")).when(k == 2, F.lit("đã rà soát"))})
    return top.unionByName(names).unionByName(body)


CATALOGUE = "SELECT 'DM' || (cust % 3) AS file, CAST(6 + cust // 3 AS BIGINT) AS row, so_hd, phan_loai FROM contracts WHERE cust % 10 NOT IN (3, 5, 7)"


@query("SRC-10_read_catalogue", f"WITH c AS ({CATALOGUE}) SELECT file, row, so_hd, 'TC-01' AS ma_ts, so_hd AS gia_tri FROM c UNION ALL SELECT file, row, so_hd, 'TC-02', phan_loai FROM c")
def _(w):
    return sheets.read_catalogue(catalogue_cells(w)).select("file", "row", "so_hd", "ma_ts", "gia_tri")


@query("F-06_drop_examples", f"SELECT file, row, so_hd FROM ({CATALOGUE}) c")
def _(w):
    return sheets.read_catalogue(catalogue_cells(w)).select("file", "row", "so_hd").distinct()


def form_cells(w):
    """Amendment forms as sheets; every fifth form has lost its section-B heading."""
    f = w.forms.select("form_id", "ma_hd", "so_pl")
    cell = lambda row, cols, df=f: laid_out(df, F.col("form_id"), "PL", F.lit(row), cols)
    out = cell(1, {1: F.lit("PHIẾU NHẬP PHỤ LỤC")}).unionByName(cell(2, {1: F.lit("Số hợp đồng"), 2: F.col("ma_hd")})).unionByName(cell(3, {1: F.lit("Số phụ lục"), 2: F.col("so_pl")}))
    out = out.unionByName(cell(10, {1: F.lit("A. Thay đổi điều khoản")})).unionByName(cell(11, {1: F.lit("Mã"), 2: F.lit("Tên")}))
    whole = f.filter("form_id % 5 <> 0")
    out = out.unionByName(cell(1000, {1: F.lit("B. Thay đổi BOQ")}, whole)).unionByName(cell(1001, {1: F.lit("Thao tác"), 2: F.lit("Mã")}, whole))
    n = F.row_number().over(W.partitionBy("form_id").orderBy("dong"))
    a = w.form_params.join(f, "form_id").withColumn("n", n)
    b = w.form_lines.join(f, "form_id").withColumn("n", n)
    out = out.unionByName(laid_out(a, F.col("form_id"), "PL", 11 + F.col("n"), {1: F.col("ma_ts"), 3: F.col("cu"), 4: F.col("moi"), 5: F.nullif("trich", F.lit(""))}))
    return out.unionByName(laid_out(b, F.col("form_id"), "PL", 1001 + F.col("n"), {1: F.lower("thao_tac"), 2: F.nullif("ma_hm", F.lit("")), 3: F.col("nhom"), 4: F.col("ten"), 5: F.col("dvt"), 6: (F.col("kl"),), 7: (F.col("don_gia"),)}))


#: Lines of the forms as laid out above. Where the heading of section B is lost, it starts at the first known operation, and lines before stay in section A.
FORM = """WITH l AS (SELECT form_lines.*, 1001 + row_number() OVER (PARTITION BY form_lines.form_id ORDER BY dong) AS place FROM form_lines JOIN forms ON forms.form_id = form_lines.form_id),
b AS (SELECT *, form_id % 5 <> 0 OR coalesce(place >= min(place) FILTER (thao_tac IN ('THAY', 'THEM', 'BO')) OVER (PARTITION BY form_id), FALSE) AS in_b FROM l)"""


@query("SRC-11_read_form", f"""{FORM} SELECT CAST(form_id AS VARCHAR) AS file, CAST(place AS BIGINT) AS dong, thao_tac, ma_hm, ten, dvt, kl, don_gia FROM b WHERE in_b""")
def _(w):
    return sheets.read_form(form_cells(w))["b_rows"].select("file", "dong", "thao_tac", "ma_hm", "ten", "dvt", "kl", "don_gia")


@query("SRC-11_form_params", f"""{FORM} SELECT CAST(l.form_id AS VARCHAR) AS file, CAST(11 + row_number() OVER (PARTITION BY l.form_id ORDER BY dong) AS BIGINT) AS dong, upper(trim(ma_ts)) AS ma_ts, cu, moi FROM form_params l JOIN forms f ON f.form_id = l.form_id
  UNION ALL SELECT CAST(form_id AS VARCHAR), CAST(place AS BIGINT), thao_tac, nhom, ten FROM b WHERE NOT in_b""")
def _(w):
    return sheets.read_form(form_cells(w))["a_rows"].select("file", "dong", "ma_ts", "cu", "moi")


@query("C-P00_lost_heading", """SELECT DISTINCT CAST(f.form_id AS VARCHAR) AS file, 'VÀNG' AS level FROM forms f JOIN form_lines l ON l.form_id = f.form_id AND l.thao_tac IN ('THEM', 'THAY', 'BO') WHERE f.form_id % 5 = 0""")
def _(w):
    return sheets.read_form(form_cells(w))["notes"].select("file", "level")


@query("SRC-04_read_checklist", """SELECT 'T' || p_partkey AS ma, p_name AS ten, p_brand || '|' || p_type AS tu_khoa, p_size % 3 < 2 AS bat_buoc, CASE WHEN p_size % 5 = 0 THEN 3 ELSE CAST(p_size % 5 AS INTEGER) END AS uu_tien FROM part""")
def _(w):
    at = folder(w, "checklist")
    s = F.col("p_size")
    rows = w.part.select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("ma"), F.col("p_name").alias("ten"), F.concat_ws("|", "p_brand", "p_type").alias("tu_khoa"), F.when(s % 3 == 0, "x").when(s % 3 == 1, "1").otherwise("").alias("bat_buoc"), F.when(s % 5 == 0, "?").otherwise((s % 5).cast("string")).alias("uu_tien"))
    rows.write.csv(at, header=True, quote='"', escape='"')
    return files.read_checklist(w.spark, at).select("ma", "ten", "tu_khoa", "bat_buoc", "uu_tien")


@query("SRC-05_read_gold_tsv", """SELECT ma_ts AS ma, gia_tri, ma_hd AS trich FROM params WHERE regexp_matches(ma_ts, '^(TC|TT)-\\d\\d$')""")
def _(w):
    at = folder(w, "gold")
    tab = F.lit("\t")
    w.params.select(F.concat(F.col("ma_ts"), tab, F.lit("ten"), tab, tab, F.coalesce("gia_tri", F.lit("")), tab, tab, tab, F.col("ma_hd"), F.lit("\r")).alias("value")).union(w.params.select(F.concat(F.lit("# "), "ma_hd"))).write.text(at)
    return files.read_gold_tsv(w.spark, at).select("ma", "gia_tri", "trich")


@query("SNK-07_upsert_period", """SELECT ma_hd, dot, ma_hm, CASE WHEN dot = 9 AND CAST(right(ma_hm, 1) AS INTEGER) % 2 = 1 THEN kl_luy_ke * 2 ELSE kl_luy_ke END AS kl_luy_ke FROM period_items p WHERE NOT (dot = 9 AND CAST(right(ma_hm, 1) AS INTEGER) % 2 = 0 AND EXISTS
   (SELECT 1 FROM period_items o WHERE o.ma_hd = p.ma_hd AND o.dot = 9 AND CAST(right(o.ma_hm, 1) AS INTEGER) % 2 = 1))""")
def _(w):
    """All periods are written; then period 9 comes again with odd items only and replaces its contracts' rows."""
    at = folder(w, "periods")
    rows = w.period_items.select("ma_hd", "dot", "ma_hm", "kl_luy_ke")
    sinks.upsert_period(rows, at)
    odd = F.substring("ma_hm", -1, 1).cast("int") % 2 == 1
    again = rows.filter((F.col("dot") == 9) & odd)
    draft = again.withColumn("seq", F.lit(1))
    sinks.upsert_period(draft.unionByName(again.withColumn("kl_luy_ke", F.col("kl_luy_ke") * 2).withColumn("seq", F.lit(2))), at)
    return w.spark.read.parquet(at).select("ma_hd", F.col("dot").cast("bigint").alias("dot"), "ma_hm", "kl_luy_ke")


@query("SNK-14_roll_forward", """SELECT p.ma_hd, p.ma_hm, coalesce(CASE WHEN i.ma_hd IS NOT NULL THEN coalesce(i.kl_lk, 0.0) END, p.kl_luy_ke) AS kl, CASE WHEN i.ma_hd IS NOT NULL THEN 10 ELSE p.dot END AS dot FROM period_items p
   LEFT JOIN claim_items i ON i.ma_hd = p.ma_hd AND i.true_hm = p.ma_hm AND i.dong % 3 <> 0 WHERE p.dot = 8""")
def _(w):
    prior = w.period_items.filter("dot = 8").select("ma_hd", "ma_hm", F.col("kl_luy_ke").alias("kl"), "dot")
    items = w.claim_items.select("ma_hd", "dong", F.when(F.col("dong") % 3 != 0, F.col("true_hm")).alias("ma_hm"), "kl_lk", F.lit(10).cast("bigint").alias("dot"))
    new, _ = sinks.roll_forward(prior, items)
    return new.select("ma_hd", "ma_hm", "kl", "dot")


@query("SNK-13_ingest_master", """SELECT c.so_hd, CASE WHEN c.cust % 2 = 1 THEN 'new' WHEN NOT (c.cust % 3 = 0 AND c.cust % 9 <> 0) THEN 'refused: exists' WHEN EXISTS (SELECT 1 FROM amendments a WHERE a.ma_hd = c.ma_hd AND a.trang_thai <> 'Đã hủy') THEN 'refused: live amendments' ELSE 'redo' END AS decision FROM contracts c""")
def _(w):
    c = w.contracts
    redo = c.filter("cust % 3 = 0").select("so_hd", F.when(F.col("cust") % 9 != 0, "sửa bản gốc").otherwise("").alias("ly_do"))
    return sinks.ingest_master(c.filter("cust % 2 = 0"), c.select("so_hd"), redo, w.amendments).select("so_hd", "decision")


@query("SNK-15_set_acceptance_date", """SELECT ma_hd, dot, CASE WHEN dot % 3 = 0 AND (dot % 4 = 0 OR dot % 2 = 1) THEN ngay_nghiem_thu + 6 WHEN dot % 4 = 0 THEN NULL ELSE ngay_nghiem_thu END AS ngay FROM periods""")
def _(w):
    """Corrections of every third period, twice; even ones give no reason, which only an empty date accepts."""
    p = w.periods.withColumn("was", F.col("ngay_nghiem_thu")).withColumn("ngay_nghiem_thu", F.when(F.col("dot") % 4 != 0, F.col("ngay_nghiem_thu")))
    e = p.filter("dot % 3 = 0").select("ma_hd", "dot", F.when(F.col("dot") % 2 == 1, "biên bản mới").otherwise("").alias("ly_do"), F.explode(F.array(F.struct(F.date_add("was", 5).alias("ngay"), F.lit(1).alias("ts")), F.struct(F.date_add("was", 6).alias("ngay"), F.lit(2).alias("ts")))).alias("x")).select("ma_hd", "dot", "ly_do", "x.*")
    return sinks.acceptance_dates(p, e).select("ma_hd", "dot", F.col("ngay_nghiem_thu").alias("ngay"))
