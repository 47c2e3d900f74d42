"""The contract store, claims, contract texts and cell grids expressed over the driver tables.

Every derived table is one SQL text that both Spark and an SQL oracle can read, so a query and its oracle start from
the same rows.  Only two constructs differ between the engines (exploding a literal array, table names); they are
filled in by ``Dialect``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from claimgrid.session import FREED, settings, shared_dir, write_table

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]

ITEM_NAMES = ["Đào đất hố móng", "Bê tông lót móng", "Cốt thép cột", "Ván khuôn dầm", "Xây tường gạch", "Trát tường ngoài",
              "Sơn nước trong nhà", "Lát nền gạch men", "Lắp đặt cửa nhôm", "Ống thoát nước", "Cáp điện hạ thế", "Thiết bị chiếu sáng"]
ITEM_FOLDED = ["dao dat ho mong", "be tong lot mong", "cot thep cot", "van khuon dam", "xay tuong gach", "trat tuong ngoai",
               "son nuoc trong nha", "lat nen gach men", "lap dat cua nhom", "ong thoat nuoc", "cap dien ha the", "thiet bi chieu sang"]
UNITS = ["m3", "m2", "Tấn", "bộ"]
UNITS_FOLDED = ["m3", "m2", "tan", "bo"]


def _pick(expr: str, values) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


HD = "'HD' || lpad(CAST({} AS STRING), 10, '0')"
ITEM = "'HM' || lpad(CAST(item_no + 1 AS STRING), 4, '0')"
ALL_L = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, "
         "l_shipdate")

DERIVED: dict[str, str] = {}

DERIVED["contracts"] = f"""
SELECT {HD.format('c_custkey')} AS ma_hd, c_custkey AS cust, c_name AS so_hd, c_mktsegment AS phan_loai,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Hợp đồng trọn gói' WHEN 'MACHINERY' THEN 'Đơn giá cố định'
            WHEN 'FURNITURE' THEN 'Đơn giá điều chỉnh' ELSE 'Theo thời gian' END AS loai_gia,
       DATE '1995-01-01' + CAST(c_custkey % 400 AS INT) AS ngay_ky,
       round(abs(c_acctbal) * 1000) AS gia_tri_hd,
       CASE WHEN c_custkey % 3 = 0 THEN 'Chưa' ELSE 'Có' END AS gom_vat,
       CAST(CASE WHEN c_nationkey % 2 = 0 THEN 0.08 ELSE 0.1 END AS DOUBLE) AS vat
FROM {{customer}}"""

DERIVED["amendments"] = f"""
SELECT o_orderkey AS id, {HD.format('o_custkey')} AS ma_hd, 'PL' || {_s('o_orderkey % 100')} AS so_pl,
       CAST(o_orderdate AS DATE) AS ngay_ky,
       CAST(o_orderdate AS DATE) + CAST(o_orderkey % 31 - 5 AS INT) AS ngay_hieu_luc,
       CASE o_orderstatus WHEN 'F' THEN 'Đã ký' WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Đã ký' ELSE 'Dự thảo' END
            ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Đã hủy' ELSE 'Đã ký' END END AS trang_thai,
       o_orderkey % 4 <> 0 AS doi_boq,
       round(CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END * o_totalprice) AS gt_sau_vat,
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS can_cu, o_orderpriority AS loai
FROM {{orders}}"""

DERIVED["lines"] = f"""
SELECT {HD.format('o_custkey')} AS ma_hd, l.*, l_partkey % 12 AS item_no, CAST(o_orderdate AS DATE) AS o_day
FROM {{lineitem}} l JOIN {{orders}} o ON l_orderkey = o_orderkey"""

_BOQ_COLS = f"""{ITEM} AS ma_hm, {_s('l_linenumber')} AS stt, 'Nhóm ' || {_s('item_no % 3')} AS nhom"""
_KEY = f"""'nhom ' || {_s('item_no % 3')} || '|' || {_pick('item_no', ITEM_FOLDED)} || '|' || {_pick('item_no % 4', UNITS_FOLDED)}"""

DERIVED["boq_base"] = f"""
SELECT item_no + 1 AS id, ma_hd, CAST(NULL AS BIGINT) AS pl_id, 'GOC' AS thao_tac, {_BOQ_COLS},
       {_pick('item_no', ITEM_NAMES)} AS ten, {_pick('item_no % 4', UNITS)} AS dvt, l_quantity AS kl, l_extendedprice AS don_gia,
       round(l_quantity * l_extendedprice) + CASE WHEN l_tax > 0.075 THEN 7 ELSE 0 END AS thanh_tien_ghi,
       {_KEY} AS khoa
FROM (SELECT *, row_number() OVER (PARTITION BY ma_hd, item_no ORDER BY l_orderkey, {ALL_L}) AS rn
      FROM lines WHERE l_linenumber <= 2) t WHERE rn = 1"""

DERIVED["boq_changes"] = f"""
SELECT l_orderkey * 100 + item_no AS id, ma_hd, l_orderkey AS pl_id,
       CASE l_returnflag WHEN 'A' THEN 'THEM' WHEN 'N' THEN 'THAY' ELSE 'BO' END AS thao_tac, {_BOQ_COLS},
       CASE WHEN l_returnflag <> 'N' THEN {_pick('item_no', ITEM_NAMES)}
            WHEN l_linenumber = 3 THEN '' WHEN l_tax < 0.015 THEN 'Sửa đổi ' || {_pick('item_no', ITEM_NAMES)} END AS ten,
       CASE WHEN l_returnflag <> 'N' THEN {_pick('item_no % 4', UNITS)} END AS dvt,
       CASE WHEN l_returnflag = 'N' AND l_discount > 0.085 THEN NULL ELSE l_quantity END AS kl,
       CASE WHEN l_returnflag = 'N' AND l_tax > 0.055 THEN NULL ELSE l_extendedprice END AS don_gia,
       round(l_quantity * l_extendedprice) + CASE WHEN l_tax > 0.075 THEN 7 ELSE 0 END AS thanh_tien_ghi,
       CASE WHEN l_returnflag = 'A' THEN {_KEY} END AS khoa
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, item_no ORDER BY {ALL_L}) AS rn
      FROM lines WHERE l_linenumber > 2) t WHERE rn = 1"""

DERIVED["boq_log"] = "SELECT * FROM boq_base UNION ALL SELECT * FROM boq_changes"

_DOT = "(year(l_shipdate) - 1995) * 2 + CASE WHEN month(l_shipdate) > 6 THEN 1 ELSE 0 END + 1"

DERIVED["period_items"] = f"""
SELECT ma_hd, dot, {ITEM} AS ma_hm, kl_ky,
       sum(kl_ky) OVER (PARTITION BY ma_hd, item_no ORDER BY dot ROWS UNBOUNDED PRECEDING) AS kl_luy_ke, don_gia_tt
FROM (SELECT ma_hd, item_no, CAST({_DOT} AS BIGINT) AS dot, sum(l_quantity) AS kl_ky, max(l_extendedprice) AS don_gia_tt
      FROM lines GROUP BY ma_hd, item_no, CAST({_DOT} AS BIGINT)) t"""

DERIVED["periods"] = f"""
SELECT ma_hd, dot, CASE WHEN dot % 5 = 0 THEN NULL ELSE ngay END AS ngay_nghiem_thu, gt_ky,
       sum(gt_ky) OVER (PARTITION BY ma_hd ORDER BY dot ROWS UNBOUNDED PRECEDING) AS gt_luy_ke,
       round(gt_ky * 0.05) AS giu_lai
FROM (SELECT ma_hd, CAST({_DOT} AS BIGINT) AS dot, max(CAST(l_shipdate AS DATE)) AS ngay,
             CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 2)))) AS DOUBLE) AS gt_ky
      FROM lines GROUP BY ma_hd, CAST({_DOT} AS BIGINT)) t"""

CLAIM_DOT = 10
DERIVED["claims"] = f"""
SELECT {HD.format('c_custkey')} AS ma_hd, c_custkey AS cust,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST({CLAIM_DOT} AS BIGINT) END AS dot,
       DATE '1999-12-01' + CAST(c_custkey % 60 AS INT) AS ngay
FROM {{customer}}"""

DERIVED["claim_items"] = f"""
SELECT a.ma_hd, 10 + a.item_no AS dong, 'Nhóm ' || {_s('a.item_no % 3')} AS nhom,
       CASE WHEN a.cust % 6 = 5 AND a.item_no = 4 THEN 'Xây tường gạch đặc' ELSE {_pick('a.item_no', ITEM_NAMES)} END AS ten,
       {_pick('a.item_no % 4', UNITS)} AS dvt,
       'nhom ' || {_s('a.item_no % 3')} || '|' || CASE WHEN a.cust % 6 = 5 AND a.item_no = 4 THEN 'xay tuong gach dac'
         ELSE {_pick('a.item_no', ITEM_FOLDED)} END || '|' || {_pick('a.item_no % 4', UNITS_FOLDED)} AS khoa,
       p.don_gia, p.kl AS kl_hd, a.kl_lk - a.kl_kn + CASE WHEN a.item_no = 3 THEN 1 ELSE 0 END AS kl_kt, a.kl_kn, a.kl_lk,
       {ITEM.replace('item_no', 'a.item_no')} AS true_hm
FROM (SELECT l.ma_hd, l.item_no, max(CAST(substr(l.ma_hd, 3) AS BIGINT)) AS cust,
             sum(CASE WHEN CAST({_DOT} AS BIGINT) = {CLAIM_DOT} THEN l_quantity ELSE 0.0 END) AS kl_kn, sum(l_quantity) AS kl_lk
      FROM lines l WHERE CAST({_DOT} AS BIGINT) <= {CLAIM_DOT} GROUP BY l.ma_hd, l.item_no) a
LEFT JOIN (SELECT ma_hd, ma_hm, max_by(don_gia, id) AS don_gia, max_by(kl, id) AS kl FROM boq_log
           WHERE thao_tac <> 'BO' AND kl IS NOT NULL AND don_gia IS NOT NULL GROUP BY ma_hd, ma_hm) p
       ON p.ma_hd = a.ma_hd AND p.ma_hm = {ITEM.replace('item_no', 'a.item_no')}
UNION ALL SELECT ma_hd, CAST(9 AS BIGINT), 'Nhóm 1', 'PHẦN MÓNG', CASE WHEN cust % 2 = 0 THEN '' END, 'nhom 1|phan mong|', NULL, NULL, NULL, NULL, NULL, NULL FROM claims"""

_BASEV = "CASE WHEN gom_vat = 'Chưa' THEN gia_tri_hd * (1 + vat) ELSE gia_tri_hd END"
DERIVED["claim_totals"] = f"""
SELECT c.ma_hd, CASE c.cust % 6 WHEN 0 THEN NULL WHEN 1 THEN bv + coalesce(f.total, 0.0) WHEN 2 THEN bv WHEN 3 THEN bv + coalesce(f.total, 0.0) + coalesce(p.amt, 0.0)
         WHEN 4 THEN bv + coalesce(f.total, 0.0) + 55555555.0 ELSE bv + coalesce(f.head, 0.0) END AS gt_hd,
       CASE WHEN c.cust % 5 = 1 THEN NULL WHEN c.cust % 2 = 0 THEN k.v * (1 + c.vat) ELSE k.v END AS gt_kn,
       CASE WHEN c.cust % 3 = 0 THEN t.gt_luy_ke ELSE t.gt_luy_ke + 2 END AS gt_lk_kt,
       CASE WHEN c.cust % 2 = 0 THEN k.v * (1 + c.vat) * 0.05 ELSE k.v * 0.06 END AS giu_lai
FROM (SELECT ma_hd, cust, vat, {_BASEV} AS bv FROM contracts) c
LEFT JOIN (SELECT ma_hd, sum(gt_sau_vat) AS total, sum(CASE WHEN rn = 1 THEN gt_sau_vat ELSE 0.0 END) AS head FROM
   (SELECT a.*, row_number() OVER (PARTITION BY a.ma_hd ORDER BY ngay_hieu_luc, ngay_ky, so_pl, id) AS rn FROM amendments a JOIN claims b ON a.ma_hd = b.ma_hd
    WHERE a.trang_thai = 'Đã ký' AND a.ngay_hieu_luc <= b.ngay) x GROUP BY ma_hd) f ON f.ma_hd = c.ma_hd
LEFT JOIN (SELECT ma_hd, min_by(gt_sau_vat, rn) AS amt FROM
   (SELECT a.ma_hd, a.gt_sau_vat, row_number() OVER (PARTITION BY a.ma_hd ORDER BY ngay_hieu_luc, id) AS rn FROM amendments a JOIN claims b ON a.ma_hd = b.ma_hd
    WHERE a.trang_thai <> 'Đã hủy' AND (a.trang_thai = 'Dự thảo' OR a.ngay_hieu_luc > b.ngay)) x GROUP BY ma_hd) p ON p.ma_hd = c.ma_hd
LEFT JOIN (SELECT i.ma_hd, CAST(sum(CAST(i.kl_kn * b.don_gia AS DECIMAL(28, 4))) AS DOUBLE) AS v FROM claim_items i JOIN boq_base b ON b.ma_hd = i.ma_hd AND b.khoa = i.khoa GROUP BY i.ma_hd) k
   ON k.ma_hd = c.ma_hd
LEFT JOIN periods t ON t.ma_hd = c.ma_hd AND t.dot = 9"""

DERIVED["remembered"] = f"""
SELECT ma_hd, 'nhom 1|be tong lot mong|m2' AS khoa_hstt, 'HM' || lpad({_s('cust % 12 + 1')}, 4, '0') AS ma_hm
FROM contracts WHERE cust % 7 = 0"""

_PARAM_ROWS = [
    ("TC-01", "c_name", "1=1"), ("TC-02", "CASE WHEN c_custkey % 2 = 0 THEN '05/03/1996' ELSE '1996-03-05' END", "1=1"),
    ("TT-01", "c_mktsegment", "c_custkey % 11 <> 0"), ("TT-02", _s("CAST(round(abs(c_acctbal) * 1000) AS BIGINT)"), "1=1"),
    ("TT-03", "CASE WHEN c_custkey % 3 = 0 THEN 'Chưa' ELSE 'Có' END", "1=1"),
    ("TT-04", "CASE WHEN c_nationkey % 2 = 0 THEN '8%' ELSE '0.1' END", "c_custkey % 5 <> 0"),
    ("TT-10", "CASE WHEN c_custkey % 4 = 0 THEN 'Không áp dụng' ELSE '20%' END", "c_custkey % 6 <> 1"),
    ("TT-20", "'95%'", "c_custkey % 3 <> 1"), ("TT-21", "'0.05'", "c_custkey % 3 <> 2"),
    ("TT-22", _s("7 + c_custkey % 30"), "1=1"), ("Y-01", _s("c_nationkey"), "c_custkey % 8 = 0"),
]
DERIVED["params"] = " UNION ALL ".join(
    f"SELECT {HD.format('c_custkey')} AS ma_hd, '{code}' AS ma_ts, {expr} AS gia_tri, "
    f"CASE WHEN (c_custkey + {i}) % 3 = 0 THEN 'Đã xác nhận' ELSE 'Chưa xác nhận' END AS trang_thai FROM {{customer}} WHERE {cond}"
    for i, (code, expr, cond) in enumerate(_PARAM_ROWS))

DERIVED["param_changes"] = f"""
SELECT o_orderkey AS pl_id, CASE o_orderkey % 5 WHEN 0 THEN 'TT-10' WHEN 1 THEN 'TT-20' WHEN 2 THEN 'TT-21' WHEN 3 THEN 'TT-50'
       ELSE 'Y-02' END AS ma_ts, CASE WHEN o_orderkey % 2 = 0 THEN '95%' ELSE '20%' END AS gia_tri_cu,
       {_s('o_orderkey % 40')} || '%' AS gia_tri_moi, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'theo ' || o_orderpriority END AS trich_dan
FROM {{orders}} WHERE o_orderkey % 3 <> 2"""

DERIVED["findings_log"] = f"""
SELECT o_orderkey AS id, {HD.format('o_custkey')} AS ma_hd, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS pl_id,
       'P1' || {_s('o_orderkey % 7')} AS ma_kt, CASE WHEN o_orderkey % 4 < 2 THEN 'ĐỎ' ELSE 'VÀNG' END AS muc_do
FROM {{orders}} WHERE o_orderkey % 5 <> 0"""

def _vnday(d):
    return f"lpad({_s(f'day({d})')}, 2, '0') || '/' || lpad({_s(f'month({d})')}, 2, '0') || '/' || {_s(f'year({d})')}"


DERIVED["forms"] = f"""
SELECT a.id AS form_id, a.ma_hd, CASE WHEN a.id % 29 = 0 THEN '' ELSE ' pl' || {_s('a.id % 100')} || ' ' END AS so_pl,
       CASE WHEN a.id % 17 = 0 THEN '' WHEN a.id % 19 = 0 THEN '31/02/2020' ELSE {_vnday('a.ngay_ky')} END AS ngay_ky,
       CASE WHEN a.id % 3 = 0 THEN '' ELSE {_vnday('a.ngay_hieu_luc')} END AS ngay_hieu_luc,
       CASE WHEN a.id % 23 = 0 THEN 'Chờ' WHEN a.id % 5 = 0 THEN 'Dự thảo' ELSE 'Đã ký' END AS trang_thai,
       CASE WHEN a.id % 31 = 0 THEN '?' WHEN a.id % 4 = 0 THEN 'Không' ELSE 'Có' END AS doi_boq,
       CASE WHEN a.id % 6 = 1 THEN {_s('CAST(a.gt_sau_vat AS BIGINT)')} END AS gt_truoc_vat,
       CASE WHEN a.id % 6 > 1 THEN {_s('CAST(a.gt_sau_vat AS BIGINT)')} END AS gt_sau_vat,
       CASE WHEN a.id % 2 = 0 THEN {_s('CAST(a.gt_sau_vat AS BIGINT)')} END AS gt_hd_sau_pl, a.can_cu
FROM amendments a JOIN (SELECT ma_hd, max(id) AS id FROM amendments GROUP BY ma_hd) m ON a.id = m.id"""
DERIVED["store_amendments"] = """
SELECT a.* FROM amendments a LEFT JOIN forms f ON f.form_id = a.id WHERE f.form_id IS NULL"""
DERIVED["form_lines"] = """
SELECT b.pl_id AS form_id, b.id AS dong, CASE WHEN b.id % 13 = 0 THEN 'XOA' ELSE b.thao_tac END AS thao_tac,
       CASE WHEN b.thao_tac = 'THEM' AND b.id % 3 > 0 THEN '' ELSE b.ma_hm END AS ma_hm, b.nhom, b.ten,
       CASE WHEN b.id % 11 = 0 THEN '' ELSE b.dvt END AS dvt, b.kl, b.don_gia, b.thanh_tien_ghi
FROM boq_changes b JOIN forms f ON f.form_id = b.pl_id WHERE f.form_id % 4 <> 0 OR f.form_id % 8 = 0"""
DERIVED["form_params"] = """
SELECT f.form_id, CAST(3 AS BIGINT) AS dong, CASE WHEN f.form_id % 7 = 0 THEN 'XX1' WHEN f.form_id % 7 = 1 THEN 'TT-02' ELSE c.ma_ts END AS ma_ts, c.gia_tri_cu AS cu,
       CASE WHEN f.form_id % 5 = 0 THEN '' ELSE c.gia_tri_moi END AS moi, c.trich_dan AS trich
FROM param_changes c JOIN forms f ON f.form_id = c.pl_id"""

# --- contract texts: about thirty paragraphs per customer ------------------------------------------------------
_c = "c_custkey"
_PARAS = [
    ("'HỢP ĐỒNG THI CÔNG XÂY DỰNG'", None), ("'Số: 99/BIA-' || " + _s(_c), None),
    ("'Căn cứ Bộ luật Dân sự năm 2015'", f"{_c} % 9 <> 0"),
    (f"'Số: ' || {_s(_c)} || '/HDXD'", None),
    (f"'Hôm nay, ngày ' || {_s(_c + ' % 28 + 1')} || ' tháng ' || {_s(_c + ' % 12 + 1')} || ' năm 2024 chúng tôi gồm'", None),
    (f"'Gói thầu: Thi công hạ tầng số ' || {_s(_c + ' % 50')} || '.'", None), ("'Dự án: Khu dân cư ' || c_mktsegment", f"{_c} % 4 <> 1"),
    (f"'Bên giao thầu (' || CASE WHEN {_c} % 5 = 0 THEN 'BÊN B' ELSE 'BÊN A' END || '): Công ty ' || c_name", None),
    (f"'Bên nhận thầu (BÊN B): Tổng công ty xây dựng số ' || {_s('c_nationkey')}", None),
    (f"'Đại diện: Ông Nguyễn Văn An | Điện thoại: 0912 345 678 | Mã số thuế: 0100' || {_s(_c + ' + 100000')}", None),
    ("'Điều 1. Nội dung hợp đồng'", None),
    (f"'“Bên giao thầu” (viết tắt là Bên A) là Công ty ' || c_name || CASE WHEN {_c} % 8 = 0 THEN ' Khác' ELSE '' END || ' như trên.'", None),
    ("'Điều 2. Giá hợp đồng và hình thức'", None),
    (f"'Hợp đồng này theo ' || {_pick(_c + ' % 3', ['hình thức trọn gói', 'đơn giá cố định', 'đơn giá điều chỉnh'])} || ' cho toàn bộ công việc.'", None),
    (f"'Giá trị hợp đồng là: ' || {_s(_c + ' % 900 + 100')} || '.' || lpad({_s(_c + ' % 1000')}, 3, '0') || '.000 đồng'", f"{_c} % 10 <> 3"),
    (f"'Giá trên ' || CASE WHEN {_c} % 3 = 0 THEN 'chưa bao gồm' ELSE 'đã bao gồm' END || ' thuế GTGT ' || "
     f"CASE WHEN c_nationkey % 2 = 0 THEN '8' ELSE '10' END || '%.'", None),
    ("'Điều 3. Thanh toán'", None),
    (f"'Tạm ứng: ' || CASE WHEN {_c} % 4 = 0 THEN 'Không áp dụng' ELSE {_s(_c + ' % 30 + 1')} || ' %' END", f"{_c} % 6 <> 1"),
    (f"'Bên A thanh toán cho Nhà thầu tối đa ' || {_s(_c + ' % 15 + 80')} || ',5% giá trị nghiệm thu từng đợt.'", f"{_c} % 7 <> 0"),
    (f"'Bên A giữ lại ' || {_s(_c + ' % 5 + 3')} || '% giá trị mỗi đợt.'", f"{_c} % 3 = 0"),
    (f"'Thời gian thanh toán: Tối đa ' || {_s(_c + ' % 30 + 7')} || ' ngày kể từ khi nhận đủ hồ sơ.'", None),
    (f"'Số bộ hồ sơ nộp là ' || CASE WHEN {_c} % 5 = 1 THEN '03 (bốn)' ELSE '04 (bốn)' END || ' bộ.'", None),
    ("'Hồ sơ thanh toán gồm các tài liệu sau:'", None), ("'Tất cả bản chính.'", f"{_c} % 2 = 0"),
    ("'+ Biên bản nghiệm thu khối lượng;'", f"{_c} % 13 <> 0"), ("'+ Bảng giá trị khối lượng hoàn thành;'", f"{_c} % 13 <> 0"),
    ("'+ Số lượng hồ sơ: 05 bộ'", None), (f"'+ Hóa đơn GTGT ' || {_s(_c + ' % 3')} || '.'", f"{_c} % 4 <> 2"),
    ("'Điều 4. Tiến độ và phạt vi phạm'", None),
    (f"'Tiến độ thực hiện: ' || {_s(_c + ' % 300 + 30')} || ' ngày'", None),
    (f"'Bên B bị phạt vi phạm tối đa ' || {_s(_c + ' % 12 + 1')} || '% giá trị phần vi phạm; biên bản có xác nhận của Bên B.'", None),
    (f"'Bên A được lập biên bản không cần xác nhận của Bên B, tiền phạt khấu trừ vào đợt thanh toán gần nhất.'", f"{_c} % 2 = 1"),
    ("'Điều 5. Bảo hành'", None), (f"'Thời hạn bảo hành là ' || {_s(_c + ' % 24 + 12')} || ' tháng.'", None),
    (f"'Hợp đồng này có hiệu lực kể từ ngày ký.'", None),
]
DERIVED["contract_text"] = (
    f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, text FROM ({{{{explode:"
    f"{HD.format(_c)} AS doc_id|pos,text|"
    + "|".join(f"{i}~CASE WHEN {cond} THEN {e} END" if cond else f"{i}~{e}" for i, (e, cond) in enumerate(_PARAS))
    + "|FROM {customer}}}) t WHERE text IS NOT NULL")

def _ans(code, value, unit="", clause="", quote="", note="", cond=None):
    j = (f"'\"{code}\": {{\"gia_tri\": \"' || {value} || '\", \"don_vi\": \"{unit}\", \"dieu_khoan\": \"{clause}\", \"trich_dan\": \"' || {quote or chr(39) * 2} || '\", \"ghi_chu\": \"{note}\"}}, '")
    return f"CASE WHEN {cond} THEN {j} ELSE '' END" if cond else j


DERIVED["ai_raw"] = (
    f"SELECT {HD.format(_c)} AS doc_id, 'Kết quả trích: {{' || " + " || ".join([
        _ans("TC-07", "'[BEN_B]'", quote="'Bên nhận thầu (BÊN B): [BEN_B]'"),
        _ans("TT-20", f"{_s(_c + ' % 15 + 80')} || ',5'", "%", "Điều 3", f"'thanh toán cho Nhà thầu tối đa ' || {_s(_c + ' % 15 + 80')} || ',5% giá trị nghiệm thu'"),
        _ans("TT-21", f"{_s(_c + ' % 9 + 3')} || '%'", "%", "Điều 3", f"'Bên A giữ lại ' || {_s(_c + ' % 5 + 3')} || '% giá trị mỗi đợt.'", "hai chỗ khác nhau"),
        _ans("TT-22", _s(_c + " % 30 + 7"), "ngày", "Điều 3", "'Thời gian thanh toán được quy định ở phần sau'"),
        _ans("TT-31", "'5%'", "%", "Điều 5", "'Bảo lãnh bảo hành năm phần trăm'", cond=f"{_c} % 2 = 0"),
        _ans("TT-33", "'Không áp dụng'", "", "Điều 5", "'THỜI HẠN bảo hành là'", cond=f"{_c} % 3 = 0"),
        _ans("TT-50", "'tiến độ chung'", "", "Điều 4", ""),
        _ans("TT-42", "'KHÔNG TÌM THẤY'"),
    ]) + f" || '\"TT-99\": {{\"gia_tri\": \"x\"}}}} hết.' AS raw FROM {{customer}}")

DERIVED["contract_docs"] = f"SELECT {HD.format(_c)} AS doc_id, concat_ws(chr(10), " + ", ".join(
    f"CASE WHEN {cond} THEN {e} END" if cond else e for e, cond in _PARAS) + ") AS text FROM {customer}"

# --- cell grids: one workbook per block of 400 orders ----------------------------------------------------------
ROWS = 400
_k = "o_orderkey"
_r = f"(6 + {_k} % {ROWS})"
_rs = _s(f"6 + {_k} % {ROWS}")
_rn = _s(f"7 + {_k} % {ROWS}")
_first = f"{_k} % {ROWS} = 0"
_NAMES = _pick(f"{_k} % 12", ITEM_NAMES)
_name = f"CASE WHEN {_k} % 50 = 0 THEN 'PHẦN ' || {_s(f'{_k} % {ROWS}')} ELSE {_NAMES} || ' số ' || {_s(f'{_k} % {ROWS}')} END"
_item = f"{_k} % 50 <> 0"
_qty = f"CAST({_k} % 97 + 1 AS DOUBLE)"
_price = f"CAST(1000 * ({_k} % 37 + 1) AS DOUBLE)"
_prior = f"CAST({_k} % 13 AS DOUBLE)"
_this = f"""CASE {_k} % 4 WHEN 0 THEN CAST({_k} % 29 AS DOUBLE) WHEN 1 THEN CAST(({_k} % 7) * ({_k} % 5) AS DOUBLE)
 WHEN 2 THEN {_qty} ELSE 0.5 * {_qty} END"""
_cum = f"({_prior} + {_this})"
_S0, _S1, _S2, _S3 = [(f"'{n}'", f"CAST({i} AS BIGINT)", f"'{st}'") for i, (n, st) in enumerate(
    [("Chi tiet", "visible"), ("Dien giai", "visible"), ("Dien giai (2)", "hidden"), ("Tong hop", "visible")])]
_N, _Z = "CAST(NULL AS STRING)", "CAST(NULL AS DOUBLE)"


def _cell(sheet, row, col, f=_N, n=_Z, s=_N, when=None):
    if when:
        f, n, s = [x if x in (_N, _Z) else f"CASE WHEN {when} THEN {x} END" for x in (f, n, s)]
    return "~".join(sheet) + f"~CAST({row} AS BIGINT)~CAST({col} AS BIGINT)~{f}~{n}~{s}"


_HEAD0 = ["STT", "Tên công việc", "Đơn vị", "Khối lượng hợp đồng", "Khối lượng kỳ trước", "Khối lượng kỳ này",
          "Khối lượng lũy kế đến hết kỳ này", "Đơn giá", "Giá trị hợp đồng", "Giá trị kỳ này", "Giá trị lũy kế đến hết kỳ này"]
_HEAD1 = ["STT", "Tên công việc", "Đơn vị", "Khối lượng", "Dài", "Rộng"]
_last = _s(f"5 + {ROWS}")
_CELLS = (
    [_cell(_S0, "5", i + 1, s=f"'{h}'", when=_first) for i, h in enumerate(_HEAD0)]
    + [_cell(_S1, "5", i + 1, s=f"'{h}'", when=_first) for i, h in enumerate(_HEAD1)]
    + [
        _cell(_S0, _r, 1, n=f"CAST({_k} % {ROWS} AS DOUBLE)"), _cell(_S0, _r, 2, s=_name), _cell(_S0, _r, 3, s=f"'{UNITS[0]}'", when=_item),
        _cell(_S0, _r, 4, n=_qty, s=_N, when=f"{_item} AND {_k} % 71 <> 9"), _cell(_S0, _r, 4, s=_s(f"{_k} % 97 + 101"), when=f"{_item} AND {_k} % 71 = 9"),
        _cell(_S0, _r, 5, n=_prior, when=f"{_item}"),
        _cell(_S0, _r, 6, f="'=''Dien giai''!D' || CASE WHEN o_orderkey % 101 = 7 THEN " + _rn + " ELSE " + _rs + " END", n=_this,
              when=f"{_item} AND NOT ({_k} % 89 = 11)"),
        _cell(_S0, _r, 6, n=_this, when=f"{_item} AND {_k} % 89 = 11"),
        _cell(_S0, _r, 7, f="'=E' || " + _rs + " || '+F' || " + _rs + " || CASE WHEN o_orderkey % 199 = 5 THEN '+1' ELSE '' END", n=_cum, when=_item),
        _cell(_S0, _r, 8, n=_price, when=_item),
        _cell(_S0, _r, 9, f="'=ROUND(D' || " + _rs + " || '*H' || " + _rs + " || ',0)'", n=f"{_qty} * {_price}", when=_item),
        _cell(_S0, _r, 10, f="'=ROUND(F' || " + _rs + " || '*H' || " + _rs + " || ',0)'", n=f"{_this} * {_price}", when=_item),
        _cell(_S0, _r, 11, f="'=ROUND(G' || " + _rs + " || '*H' || " + _rs + " || ',0)' || CASE WHEN o_orderkey % 83 = 2 THEN '*1.08' ELSE '' END",
              n=f"{_cum} * {_price}", when=_item),
        _cell(_S1, _r, 1, n=f"CAST({_k} % {ROWS} AS DOUBLE)"), _cell(_S1, _r, 2, s=_name), _cell(_S1, _r, 3, s=f"'{UNITS[0]}'", when=_item),
        _cell(_S1, _r, 4, n=_this, when=f"{_item} AND {_k} % 4 = 0 AND {_k} % 61 <> 3"),
        _cell(_S1, _r, 4, f="CASE o_orderkey % 4 WHEN 1 THEN '=E' || " + _rs + " || '*F' || " + _rs + " WHEN 2 THEN '=''Chi tiet''!D' || " + _rs
              + " ELSE '=''Chi tiet''!D' || " + _rs + " || '*0.5' END", n=_this, when=f"{_item} AND {_k} % 4 <> 0 AND {_k} % 61 <> 3"),
        _cell(_S1, _r, 4, f="'=[1]Goc!B' || " + _rs, n=_this, when=f"{_item} AND {_k} % 61 = 3"),
        _cell(_S1, _r, 5, n=f"CAST({_k} % 7 AS DOUBLE)", when=_item), _cell(_S1, _r, 6, n=f"CAST({_k} % 5 AS DOUBLE)", when=_item),
        _cell(_S1, _r, 7, f="'=''Dien giai (2)''!D' || " + _rs, n=_this, when=f"{_item} AND {_k} % 43 = 1"),
        _cell(_S1, _r, 8, f="'=#REF!*2'", s="'#REF!'", when=f"{_k} % 149 = 1"),
        _cell(_S2, _r, 2, s=_name), _cell(_S2, _r, 4, n=f"{_this} + CASE WHEN {_k} % 17 = 0 THEN 1 ELSE 0 END", when=_item),
        _cell(_S3, "3", 2, s="'Giá trị hợp đồng'", when=_first), _cell(_S3, "3", 4, n="CAST(o_orderkey * 10 + 5000 AS DOUBLE)", when=_first),
        _cell(_S3, "8", 2, s="'Giá trị thực hiện kỳ này'", when=_first),
        _cell(_S3, "8", 4, f="'=SUM(''Chi tiet''!J6:J' || " + _last + " || ')'", n="CAST(o_orderkey + 70000 AS DOUBLE)", when=_first),
        _cell(_S3, "9", 2, s="'Giữ lại 5%'", when=_first), _cell(_S3, "9", 4, f="'=D8*5%'", n="CAST(o_orderkey + 3500 AS DOUBLE)", when=_first),
        _cell(_S3, "10", 2, s="'Giá trị đề nghị thanh toán kỳ này'", when=_first),
        _cell(_S3, "10", 4, f="'=D8*1.08-D9-D11'", n="CAST(o_orderkey + 72000 AS DOUBLE)", when=_first),
        _cell(_S3, "11", 2, s="'Đã trừ khác'", when=_first), _cell(_S3, "11", 4, n="100.0", when=_first),
    ])
DERIVED["cells"] = (
    "SELECT file, sheet, CAST(sheet_idx AS INT) AS sheet_idx, sheet_state, CAST(row AS INT) AS row, CAST(col AS INT) AS col, formula, v_num, v_str "
    "FROM ({{explode:'wb' || CAST(CAST(floor(o_orderkey / " + f"{ROWS}.0" + ") AS BIGINT) AS STRING) AS file|"
    "sheet,sheet_idx,sheet_state,row,col,formula,v_num,v_str|" + "|".join(_CELLS)
    + "|FROM {orders}}}) t WHERE formula IS NOT NULL OR v_num IS NOT NULL OR v_str IS NOT NULL")

# --- prose documents ------------------------------------------------------------------------------------------
CHECKLIST = [
    ("A01", "A. Contract", True, 1, "the|and"), ("A02", "A. Contract", True, 1, "der|und"), ("B01", "B. Design", True, 1, "les|une"),
    ("B02", "B. Design", False, 2, "los|una"), ("C01", "C. Acceptance", True, 2, "license|copyright"), ("C02", "C. Acceptance", False, 3, "password|secret"),
    ("D01", "D. Supply", False, 2, "nicht|oder"), ("E01", "E. Payment", True, 1, "zzqx|qqzz"),
]
DERIVED["checklist"] = " UNION ALL ".join(
    f"SELECT '{c}' AS ma, '{g}' AS nhom, {'TRUE' if b else 'FALSE'} AS bat_buoc, {p} AS uu_tien, '{k}' AS tu_khoa"
    for c, g, b, p, k in CHECKLIST)


_EXPLODE = re.compile(r"\{\{explode:(.*)\|(FROM \{\w+\})\}\}", re.S)


def _explode(spec: str, tail: str, dialect: str) -> str:
    """Rows of literal structs per source row."""
    head, names, *rows = _split(spec)
    cols = names.split(",")
    if dialect == "spark":
        key, rare = head.split(" AS ")[-1].strip(), f"CASE WHEN {_first} THEN"

        def part(some, where=""):
            structs = ", ".join("struct(" + ", ".join(f"{v} AS {c}" for v, c in zip(r.split("~"), cols)) + ")" for r in some)
            return f"SELECT {key}, inline(parts) FROM (SELECT {head}, array({structs}) AS parts {tail}{where}) x"

        # heads of a workbook are made from its first order alone, and not as empty rows of every order
        first = [r for r in rows if rare in r]
        return part([r for r in rows if rare not in r]) + (" UNION ALL " + part(first, f" WHERE {_first}") if first else "")
    structs = ", ".join("{" + ", ".join(f"'{c}': {v}" for v, c in zip(r.split("~"), cols)) + "}" for r in rows)
    return f"SELECT {head.split(' AS ')[-1].strip()}, unnest(s) FROM (SELECT {head}, unnest([{structs}]) AS s {tail}) u"


def _split(spec: str):
    parts, depth, cur, quote = [], 0, "", False
    i = 0
    while i < len(spec):
        ch = spec[i]
        if ch == "'":
            quote = not quote
        if ch == "|" and not quote:
            if spec[i:i + 2] == "||":
                cur += "||"
                i += 2
                continue
            parts.append(cur)
            cur = ""
        else:
            cur += ch
        i += 1
    return parts + [cur]


def _render(name: str, dialect: str, path: str) -> str:
    sql = DERIVED[name]
    if "{{explode:" in sql:
        m = _EXPLODE.search(sql)
        sql = sql[:m.start()] + _explode(m.group(1), m.group(2), dialect) + sql[m.end():]
    for b in BASE:
        sql = sql.replace("{" + b + "}", f"parquet.`{path}/{b}.parquet`" if dialect == "spark" else b)
    return sql


def _needs(sql: str) -> list:
    out = []

    def visit(text):
        for n in DERIVED:
            if n not in out and re.search(rf"\b(FROM|JOIN)\s+{n}\b", text, re.I):
                visit(DERIVED[n])
                out.append(n)
    visit(sql)
    return out


def ctes(sql: str, dialect: str, path: str = "") -> str:
    """Prefix sql with the definitions of the derived tables it reads."""
    names = _needs(sql)
    kept = " MATERIALIZED" if dialect == "duckdb" else ""      # tables that a query reads many times
    head = ",\n".join(f"{n} AS{kept} ({_render(n, dialect, path)})" for n in names)
    body = sql.strip()
    if not names:
        return body
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return "WITH RECURSIVE " + head + ",\n" + re.sub(r"^WITH\s+RECURSIVE\s+", "", body, flags=re.I)
    if re.match(r"WITH\b", body, re.I):
        return "WITH " + head + ",\n" + re.sub(r"^WITH\s+", "", body, flags=re.I)
    return "WITH " + head + "\n" + body


# Derived tables that stand for stored tables of the contract store: written once per session, then read like any
# other table (a user of the library has them as tables to begin with).
# boq_log is their union and is read from both.
STORED = {"forms", "lines", "boq_base", "boq_changes", "period_items", "periods", "claim_items", "claim_totals", "contract_text", "cells"}
_WRITTEN: dict = {}
SPREAD_KEY = {"orders": "o_orderkey", "customer": "c_custkey"}
SPREAD_FILES = 1        # reading tasks per core from which a table counts as spread


class World:
    """Driver tables and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        sql = _render(name, "spark", self.path)
        if "{{explode:" in DERIVED[name]:
            # one source row becomes many: spread the rows before, not after, in ranges of their key, so that the rows of a
            # workbook or text stay together and groups by it are formed before a shuffle
            src = next(b for b in BASE if "{" + b + "}" in DERIVED[name])
            ref = f"parquet.`{self.path}/{src}.parquet`"
            n = max(2 * self.spark.sparkContext.defaultParallelism, getattr(self, src).rdd.getNumPartitions())
            sql = sql.replace(f"FROM {ref}", f"FROM (SELECT /*+ REPARTITION_BY_RANGE({n}, {SPREAD_KEY[src]}) */ * FROM {ref}) src")
        for dep in _needs(DERIVED[name]):
            if dep in STORED:
                ref = f"parquet.`{self._stored(dep)}`"
                sql = re.sub(rf"\b(FROM|JOIN)(\s+){dep}\b", lambda m, r=ref: m.group(1) + m.group(2) + r, sql, flags=re.I)
        return self.spark.sql(self._with(sql))

    def _with(self, sql: str) -> str:
        names = [n for n in _needs(sql) if n not in STORED]
        if not names:
            return sql
        defs = []
        for n in names:
            body = _render(n, "spark", self.path)
            for dep in STORED:
                if re.search(rf"\b(FROM|JOIN)\s+{dep}\b", body, re.I):
                    ref = f"parquet.`{self._stored(dep)}`"
                    body = re.sub(rf"\b(FROM|JOIN)(\s+){dep}\b", lambda m, r=ref: m.group(1) + m.group(2) + r, body, flags=re.I)
            defs.append(f"{n} AS ({body})")
        return "WITH " + ",\n".join(defs) + "\n" + sql

    def _source_files(self, name: str) -> int:
        """Tasks that read the driver tables behind a derived table."""
        sql = " ".join(DERIVED[n] for n in [*_needs(DERIVED[name]), name])
        return sum(getattr(self, b).rdd.getNumPartitions() for b in BASE if "{" + b + "}" in sql)

    def _stored(self, name: str) -> str:
        key = (self.spark.sparkContext.applicationId, self.path, name)
        if key not in _WRITTEN:
            out = f"{shared_dir(self.spark)}/claimgrid-store/{uuid.uuid4().hex}"
            df = self._table(name)
            # a small driver table is read by few tasks: its derived rows are spread over all cores. Exploded tables are spread
            # before, large ones by their size; dealing all their rows out once more would sort, shuffle and spill the whole table
            if "{{explode:" not in DERIVED[name] and self._source_files(name) < SPREAD_FILES * self.spark.sparkContext.defaultParallelism:
                df = df.repartition(self.spark.sparkContext.defaultParallelism)
            # the JVM does not compile methods of over 8000 bytes, and the literal rows of an exploded table make one of 40,000 in a
            # fused stage: over this limit Spark evaluates them apart, in methods that are compiled
            with settings(self.spark, FREED | {"spark.sql.codegen.hugeMethodLimit": "8000"}):
                df.write.parquet(out)
            _WRITTEN[key] = out
        return _WRITTEN[key]

    def memo(self, name: str, make) -> DataFrame:
        """A result that several queries read: written once per session as a table."""
        key = (self.spark.sparkContext.applicationId, self.path, "memo:" + name)
        if key not in _WRITTEN:
            out = f"{shared_dir(self.spark)}/claimgrid-store/{uuid.uuid4().hex}"
            write_table(make(), out)
            _WRITTEN[key] = out
        return self.spark.read.parquet(_WRITTEN[key])

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.path}/{name}.parquet")
        if name in STORED:
            return self.spark.read.parquet(self._stored(name))
        if name in DERIVED:
            return self._table(name)
        raise AttributeError(name)
