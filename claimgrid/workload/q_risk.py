"""Fixed-template audit, sampling and evidence queries over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions import classify as C
from claimgrid.operators import risk
from claimgrid.workload.registry import query

CODES = list(X.CUMULATIVE_SOURCES)
KT = list(X.PRIOR_SOURCES)
SRC = f"CASE l_partkey % 10 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " END"
KSRC = f"CASE l_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(KT)) + " END"
RISK = f"CASE l_partkey % 10 " + " ".join(f"WHEN {i} THEN '{v[1]}'" for i, v in enumerate(X.CUMULATIVE_SOURCES.values())) + " END"
IT = f"""SELECT CAST(l_suppkey AS STRING) AS file, l_orderkey * 10 + l_linenumber AS dong, CASE l_returnflag WHEN 'A' THEN 'XD' WHEN 'N' THEN 'TB' ELSE 'PL' END AS part, 'Item ' || CAST(l_partkey AS STRING) AS name, {SRC} AS lk_src, {KSRC} AS kt_src,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN -l_quantity ELSE l_quantity END AS E, l_extendedprice AS I, floor(l_quantity / 2) AS F, l_quantity - floor(l_quantity / 2) AS G, l_quantity AS H,
  floor(l_quantity / 2) * l_extendedprice AS K, (l_quantity - floor(l_quantity / 2)) * l_extendedprice AS L, l_quantity * l_extendedprice AS M, CASE WHEN l_linenumber <= 4 THEN CAST(l_partkey % 60 AS DOUBLE) END AS dgL, {RISK} AS risk FROM """
ORACLE = f"it AS ({IT} lineitem), ef AS (SELECT *, CASE WHEN dgL IS NOT NULL THEN greatest(0.0, dgL - E) END AS oq, CASE WHEN part = 'XD' THEN {(1 + 0.08) * (1 - 0.05)!r}::DOUBLE ELSE {(1 + 0.08) * (1 - 0.30)!r}::DOUBLE END AS fa FROM it), e2 AS (SELECT *, coalesce(oq * I, 0.0) AS over_value, L * fa AS f1_this, CASE WHEN part = 'XD' THEN M * fa ELSE L * fa + K * {1 + 0.08!r}::DOUBLE END AS f1_all FROM ef)"


def S(x):
    return f"CAST(sum(CAST({x} AS DECIMAL(28, 6))) AS DOUBLE)"


def items(w):
    base = w.spark.sql(IT + f"parquet.`{w.path}/lineitem.parquet`").drop("risk").withColumn("price_pattern", C.price_pattern(F.col("I")))
    return risk.with_effects(base)


@query("A-09_risk_by_part_source", f"WITH {ORACLE} SELECT part, lk_src, CAST(count(*) AS BIGINT) AS n, {S('L')} AS gt_ky, {S('M')} AS gt_lk, {S('M')} / (SELECT {S('M')} FROM e2) AS share FROM e2 GROUP BY part, lk_src UNION ALL SELECT 'Tổng', NULL, CAST(count(*) AS BIGINT), {S('L')}, {S('M')}, 1.0 FROM e2")
def _(w):
    return risk.risk_by_part_source(items(w)).select("part", "lk_src", "n", "gt_ky", "gt_lk", "share")


@query("T-08_order_strata", f"WITH {ORACLE} SELECT part, risk, lk_src, CAST(count(*) AS BIGINT) AS n FROM e2 GROUP BY ALL")
def _(w):
    return risk.order_strata(items(w).groupBy("part", "risk", "lk_src").agg(F.count("*").alias("n")))


@query("A-10_scenario_effect", f"WITH {ORACLE}, z AS (SELECT risk, count(*) AS n, {S('L')} AS gt_ky, {S('f1_this')} AS f1_this FROM e2 GROUP BY risk) SELECT risk, CAST(n AS BIGINT) AS n, gt_ky, round(f1_this, 2) AS f1_this, round(CASE WHEN risk = 'Cao' THEN 1e9 - f1_this END, 2) AS remaining_this FROM z")
def _(w):
    return risk.scenario_effect(items(w), 1e9).select("risk", "n", "gt_ky", F.round("f1_this", 2).alias("f1_this"), F.round("remaining_this", 2).alias("remaining_this"))


@query("A-11_prior_source_totals", f"WITH {ORACLE}, k AS (SELECT *, CASE kt_src {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in X.PRIOR_SOURCES.items())} END AS kt FROM e2) SELECT part, kt, CAST(count(*) AS BIGINT) AS n, {S('K')} AS gt_truoc FROM k GROUP BY part, kt UNION ALL SELECT 'Tổng', NULL, CAST(count(*) AS BIGINT), {S('K')} FROM k")
def _(w):
    return risk.prior_source_totals(items(w))


@query("A-12_over_quantity", f"WITH {ORACLE} SELECT part, CAST(count(*) FILTER (over_value > 0) AS BIGINT) AS n, {S('over_value')} AS gt_vuot FROM e2 WHERE part = 'XD' GROUP BY part")
def _(w):
    return risk.over_quantity(items(w))


PP = f"CASE WHEN I = floor(I) THEN 'Số nguyên' WHEN abs(I / {X.PRICE_FACTOR!r}::DOUBLE - round_even(I / {X.PRICE_FACTOR!r}::DOUBLE / 100, 0) * 100) < 0.01 THEN 'Giá tròn x k' WHEN abs(I / {X.PRICE_FACTOR!r}::DOUBLE * 1.08::DOUBLE - round_even(I / {X.PRICE_FACTOR!r}::DOUBLE * 1.08::DOUBLE / 100, 0) * 100) < 0.01 THEN 'Giá tròn ÷ 1,08 x k' ELSE 'Lẻ, chưa rõ nguồn' END"


@query("A-13_price_pattern_totals", f"WITH {ORACLE} SELECT part, {PP} AS price_pattern, CAST(count(*) AS BIGINT) AS n, {S('L')} AS gt_ky, {S('M')} AS gt_lk FROM e2 GROUP BY 1, 2")
def _(w):
    return risk.price_pattern_totals(items(w))


@query("X-23_price_pattern", f"WITH {ORACLE} SELECT dong, name, I, {PP} AS v FROM e2")
def _(w):
    return items(w).select("dong", "name", "I", F.col("price_pattern").alias("v"))


@query("X-31_payment_effect", f"WITH {ORACLE} SELECT dong, name, M, f1_this, f1_all FROM e2")
def _(w):
    return items(w).select("dong", "name", "M", "f1_this", "f1_all")


@query("X-30_cap_branch", f"WITH {ORACLE} SELECT dong, name, dgL, CASE WHEN dgL < E AND dgL < F THEN 'Giữ KL kỳ trước (DG < kỳ trước)' WHEN dgL > E THEN 'Chặn trần = KL HĐ (DG > HĐ)' ELSE 'Theo DG KL' END AS branch FROM e2")
def _(w):
    return items(w).select("dong", "name", "dgL", C.cap_branch(F.col("dgL"), F.col("E"), F.col("F")).alias("branch"))


FX = "CASE l_partkey % 6 WHEN 0 THEN '=+D' || CAST(l_linenumber AS STRING) WHEN 1 THEN '=80% * D' || CAST(l_linenumber AS STRING) WHEN 2 THEN '=SUM(K1:K9)' WHEN 3 THEN '=A1+B2' END"
KX = "CASE l_partkey % 5 WHEN 0 THEN '=E' || CAST(l_linenumber AS STRING) WHEN 1 THEN '=E' || CAST(l_linenumber AS STRING) || '*0.5' WHEN 2 THEN '=DGPLH!A1' WHEN 3 THEN '=A1' END"


@query("X-22_classify_sources", f"""SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE l_partkey % 6 WHEN 0 THEN 'DG_BANG_KLHD' WHEN 1 THEN 'DG_TYLE' WHEN 2 THEN 'DG_DIENGIAI' WHEN 3 THEN 'DG_CT_KHAC' WHEN 4 THEN 'DG_NHAPTAY_THEP' ELSE 'DG_TRONG' END AS lk,
   CASE l_partkey % 5 WHEN 0 THEN 'BANG_KLHD' WHEN 1 THEN 'TYLE' WHEN 2 THEN 'SHEET_AN' WHEN 3 THEN 'KHAC' ELSE 'NHAPTAY' END AS kt FROM lineitem""")
def _(w):
    v = F.when(F.col("l_partkey") % 6 == 4, "12.5")
    return w.lineitem.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                             C.cumulative_source(F.expr(FX), v, F.col("l_linenumber"), F.lit("Bảng Thống kê thép")).alias("lk"), C.prior_source(F.expr(KX), F.col("l_linenumber")).alias("kt"))


@query("X-24_proof_document", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'E01-E04 hồ sơ thanh toán các đợt đã duyệt, UNC' WHEN 1 THEN 'A02 BOQ / A04 phụ lục (đơn giá)' WHEN 2 THEN 'E03 hồ sơ Đợt 3 đã ký (KL lũy kế kỳ trước)' WHEN 3 THEN 'E07 file Excel đang liên kết' ELSE 'C05 xác nhận % tiến độ của TVGS' END AS v FROM part""")
def _(w):
    k = F.col("p_partkey") % 5
    sheet = F.when(k == 0, "2. TH.").when(k == 1, "3. GTHT").otherwise("5. BBNT")
    col = F.when(k == 1, "I").otherwise("F")
    kind = F.when(k == 3, "File ngoài").when(k == 4, "Tham số 5%").otherwise("Nhập tay")
    return w.part.select("p_partkey", C.proof_document(sheet, col, kind, F.col("p_name")).alias("v"))


@query("J-13_replaced_base_items", f"WITH {ORACLE}, n AS (SELECT file, lower(name) AS k, count(*) AS c, min(dong) AS f FROM e2 WHERE part = 'PL' AND E < 0 GROUP BY ALL) SELECT e2.file, dong, name, lk_src, I, CAST(n.c AS BIGINT) AS n_neg, n.f AS first_neg FROM e2 JOIN n ON n.file = e2.file AND n.k = lower(name) WHERE part IN ('TB', 'XD')")
def _(w):
    return risk.replaced_base_items(items(w)).select("file", "dong", "name", "lk_src", "I", F.col("n_neg").cast("bigint").alias("n_neg"), "first_neg")


@query("J-17_rounded_value_lookup", "SELECT l_orderkey, l_extendedprice, t.r AS total_row FROM lineitem l LEFT JOIN (SELECT o_totalprice AS v, max(o_orderkey) AS r FROM orders GROUP BY 1) t ON t.v = l_extendedprice")
def _(w):
    t = w.orders.select(F.lit("x").alias("file"), F.col("o_totalprice").alias("t"), F.col("o_orderkey").alias("row"))
    return risk.rounded_value_lookup(w.lineitem.withColumn("file", F.lit("x")), t, "l_extendedprice", "t").select("l_orderkey", "l_extendedprice", "total_row")


@query("W-16_carry_part", """WITH r AS (SELECT CAST(floor(o_orderkey / 500.0) AS BIGINT) AS b, o_orderkey AS dong, CASE WHEN o_orderkey % 500 = 10 THEN 'XD' WHEN o_orderkey % 500 = 200 THEN 'TB' WHEN o_orderkey % 500 = 400 THEN 'PL' END AS p FROM orders) SELECT dong, last_value(p IGNORE NULLS) OVER (PARTITION BY b ORDER BY dong) AS part FROM r""")
def _(w):
    m = F.col("o_orderkey") % 500
    r = w.orders.select(F.floor(F.col("o_orderkey") / 500).alias("file"), F.col("o_orderkey").alias("dong"), F.when(m == 10, "PHẦN XÂY DỰNG").when(m == 200, "Phần  thiết bị").when(m == 400, "Theo phụ lục 2").otherwise("x").alias("name"))
    return risk.carry_part(r).select("dong", "part")


@query("C-H1_template_flags", f"WITH {ORACLE} SELECT dong, name, concat_ws('; ', CASE WHEN E < 0 THEN 'KL âm (hạng mục bị thay thế ở PLHĐ)' END, CASE WHEN dgL > E AND E > 0 AND dgL / E > 3 THEN 'KL diễn giải gấp nhiều lần KL HĐ - kiểm tra đơn vị tính' END, CASE WHEN dgL < E AND dgL < F THEN 'KL diễn giải thấp hơn KL đã nghiệm thu kỳ trước' END, CASE WHEN dgL IS NULL THEN 'Không trỏ về BBNT' END) AS flags, I FROM e2")
def _(w):
    it = items(w).withColumns({"E2": F.col("E"), "E3": F.col("E"), "e_text": F.lit(False), "dg_row": F.col("dgL")})
    return risk.item_flags(it).select("dong", "name", F.array_join("flags", "; ").alias("flags"), "I")


@query("C-H2_summary_inputs", "SELECT file, CAST(row AS BIGINT) AS row, CASE WHEN formula IS NULL THEN 'Số nhập tay' WHEN contains(formula, '5%') THEN 'Tham số nhúng: 5%' ELSE 'Tham số nhúng: 1.08' END AS kind FROM cells WHERE sheet = 'Tong hop' AND col = 4 AND (formula IS NULL OR contains(formula, '5%') OR contains(formula, '1.08'))")
def _(w):
    return risk.summary_inputs(w.cells, "Tong hop").select("file", F.col("row").cast("bigint").alias("row"), "kind")


@query("C-H3_file_integrity", "SELECT DISTINCT file, 'Sheet ẩn' AS loai, sheet AS vi_tri, 'hidden' AS mo_ta FROM cells WHERE sheet_state = 'hidden' UNION ALL SELECT file, 'Lỗi tham chiếu (REF)', sheet, CAST(count(*) AS VARCHAR) FROM cells WHERE contains(formula, '#REF!') GROUP BY file, sheet")
def _(w):
    none = w.cells.limit(0).select("file", F.lit(0).alias("dong"), F.array(F.lit("x")).alias("flags"))
    return risk.file_integrity(w.cells, none)


@query("D-01_materiality", "SELECT ma_hd, dot, gt_ky * 0.01 AS trong_yeu, gt_ky * 0.01 * 0.75 AS thuc_hien, gt_ky * 0.01 * 0.05 AS khong_dang_ke FROM periods")
def _(w):
    return risk.materiality(w.periods).select("ma_hd", "dot", "trong_yeu", "thuc_hien", "khong_dang_ke")


@query("D-02_audit_sample", """WITH v AS (SELECT o_custkey, o_orderkey AS item, o_totalprice AS v, o_totalprice >= 400000 OR o_orderkey % 50 = 0 AS must FROM orders), r AS (SELECT *, sum(CAST(v AS DECIMAL(28, 4))) OVER w AS cum, row_number() OVER w AS pos, sum(CAST(v AS DECIMAL(28, 4))) OVER (PARTITION BY o_custkey) AS total FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY must DESC, v DESC, item ROWS UNBOUNDED PRECEDING))
   SELECT o_custkey, item FROM r WHERE must OR CAST(cum - CAST(v AS DECIMAL(28, 4)) AS DOUBLE) < 0.8::DOUBLE * CAST(total AS DOUBLE) OR pos <= 3""")
def _(w):
    o = w.orders.select("o_custkey", F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("v"))
    return risk.audit_sample(o, ["o_custkey"], "v", F.lit(400000.0), F.col("item") % 50 == 0, least=3).select("o_custkey", "item")


@query("D-03_deductions", "SELECT p.ma_hd, p.dot, gt_ky - giu_lai AS con_lai, round((gt_ky - giu_lai) * (1 + vat)) AS con_lai_vat FROM periods p JOIN (SELECT ma_hd, vat FROM contracts) c ON c.ma_hd = p.ma_hd")
def _(w):
    p = w.periods.join(w.contracts.select("ma_hd", "vat"), "ma_hd").withColumns({"thu_hoi_tu": F.lit(None).cast("double"), "phat": F.lit(0.0)})
    return risk.deductions(p).select("ma_hd", "dot", "con_lai", "con_lai_vat")


@query("D-04_evidence_matrix", "SELECT l_partkey AS thiet_bi, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS co, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS cq, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS bb FROM lineitem GROUP BY l_partkey")
def _(w):
    e = w.lineitem.select(F.col("l_partkey").alias("thiet_bi"), F.col("l_returnflag").alias("tai_lieu"))
    return risk.evidence_matrix(e, ["A", "N", "R"]).select("thiet_bi", F.col("A").alias("co"), F.col("N").alias("cq"), F.col("R").alias("bb"))
