"""Matching and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions.numbers import money, rate
from claimgrid.functions.similarity import edit_similarity
from claimgrid.functions.text import fold, match_key
from claimgrid.operators import match, reconcile, state
from claimgrid.session import cut_lineage
from claimgrid.workload.q_state import EVENTS_SQL, big
from claimgrid.workload.registry import query


def sql_fold(x: str) -> str:
    return (f"trim(regexp_replace(lower(replace(replace(strip_accents(coalesce({x}, '')), 'đ', 'd'), 'Đ', 'D')), '\\s+', ' ', 'g'))")


CLAIM_STATES = EVENTS_SQL.replace("LEFT JOIN amendments a ON b.pl_id = a.id", "LEFT JOIN amendments a ON b.pl_id = a.id JOIN claims q ON q.ma_hd = b.ma_hd").replace("__DAY__", "q.ngay")
LINES = """lines_all AS (SELECT * FROM states s WHERE state = 'live' OR NOT EXISTS (SELECT 1 FROM states t WHERE t.state = 'live' AND t.ma_hd = s.ma_hd AND t.ma_hm = s.ma_hm))"""
MATCHED = f"""{LINES},
bykey AS (SELECT ma_hd, khoa, min(ma_hm) AS hm_key FROM lines_all WHERE khoa IS NOT NULL GROUP BY ma_hd, khoa),
byname AS (SELECT ma_hd, {sql_fold('ten')} AS fn, {sql_fold('dvt')} AS fu, min(ma_hm) AS hm_name FROM lines_all GROUP BY 1, 2, 3 HAVING count(*) = 1),
matched AS (SELECT i.*, coalesce(r.ma_hm, k.hm_key, n.hm_name) AS ma_hm,
   CASE WHEN r.ma_hm IS NOT NULL THEN 'đã xác nhận' WHEN k.hm_key IS NOT NULL THEN 'khoá' WHEN n.hm_name IS NOT NULL THEN 'tên + ĐVT' ELSE '' END AS cach_khop
   FROM claim_items i LEFT JOIN remembered r ON r.ma_hd = i.ma_hd AND r.khoa_hstt = i.khoa LEFT JOIN bykey k ON k.ma_hd = i.ma_hd AND k.khoa = i.khoa
   LEFT JOIN byname n ON n.ma_hd = i.ma_hd AND n.fn = {sql_fold('i.ten')} AND n.fu = {sql_fold('i.dvt')} WHERE trim(coalesce(i.dvt, '')) <> '')"""
FINDINGS = f"""WITH {CLAIM_STATES}, {MATCHED},
prior AS (SELECT c.ma_hd, max(p.dot) AS dot_truoc FROM claims c JOIN periods p ON c.ma_hd = p.ma_hd AND
   CASE WHEN c.dot IS NOT NULL THEN p.dot < c.dot ELSE p.ngay_nghiem_thu IS NULL OR p.ngay_nghiem_thu < c.ngay END GROUP BY c.ma_hd),
pq AS (SELECT i.ma_hd, i.ma_hm, i.kl_luy_ke FROM period_items i JOIN prior p ON p.ma_hd = i.ma_hd AND p.dot_truoc = i.dot),
pl AS (SELECT b.ma_hd, b.ma_hm, b.khoa, a.ngay_hieu_luc AS p_eff, a.id AS pl_id, a.so_pl AS p_no, a.trang_thai AS p_status,
   row_number() OVER (PARTITION BY b.ma_hd, b.ma_hm ORDER BY a.ngay_hieu_luc, a.id) AS rn FROM boq_changes b JOIN amendments a ON b.pl_id = a.id JOIN claims c ON c.ma_hd = b.ma_hd
   WHERE a.trang_thai <> 'Đã hủy' AND (a.trang_thai = 'Dự thảo' OR a.ngay_hieu_luc > c.ngay)),
pk AS (SELECT *, row_number() OVER (PARTITION BY ma_hd, khoa ORDER BY p_eff, pl_id) AS rk FROM pl WHERE rn = 1 AND khoa IS NOT NULL),
j AS (SELECT m.*, l.ma_hm IS NOT NULL AS ok, l.kl AS m_kl, l.don_gia AS m_gia, l.nguon AS m_nguon, g.bo_boi, q.kl_luy_ke AS kl_duyet, q.ma_hm IS NOT NULL AS in_prior, pr.dot_truoc, c.vat,
   EXISTS (SELECT 1 FROM pq z WHERE z.ma_hd = m.ma_hd) AS has, pk.p_no, pk.p_status, pk.p_eff, lower(c.loai_gia) LIKE '%trọn gói%' AS lump
   FROM matched m JOIN contracts c ON c.ma_hd = m.ma_hd LEFT JOIN states l ON l.state = 'live' AND l.ma_hd = m.ma_hd AND l.ma_hm = m.ma_hm
   LEFT JOIN states g ON g.state = 'removed' AND g.ma_hd = m.ma_hd AND g.ma_hm = m.ma_hm LEFT JOIN pq q ON q.ma_hd = m.ma_hd AND q.ma_hm = m.ma_hm
   LEFT JOIN pk ON pk.ma_hd = m.ma_hd AND pk.khoa = m.khoa AND pk.rk = 1 LEFT JOIN prior pr ON pr.ma_hd = m.ma_hd),
found AS (SELECT *, concat_ws('; ',
   CASE WHEN NOT ok AND bo_boi IS NOT NULL THEN 'Hạng mục đã bị bỏ theo ' || bo_boi
        WHEN NOT ok AND p_no IS NOT NULL THEN 'Chỉ có trong ' || p_no || ' (' || p_status || ', hiệu lực ' || strftime(p_eff, '%d/%m/%Y') || ') - chưa áp dụng tại ngày nghiệm thu'
        WHEN NOT ok THEN 'Không có trong BOQ hiệu lực: phát sinh chưa có phụ lục' END,
   CASE WHEN ok AND abs(coalesce(don_gia, 0) - coalesce(m_gia, 0)) > 0.5 THEN 'Đơn giá khác BOQ hiệu lực' END,
   CASE WHEN ok AND kl_hd IS NOT NULL AND abs(kl_hd - coalesce(m_kl, 0)) > 1e-6 THEN 'KL HĐ khác BOQ hiệu lực' END,
   CASE WHEN ok AND kl_lk > coalesce(m_kl, 0) + 1e-6 THEN 'Lũy kế vượt KL HĐ hiệu lực: ' || CASE WHEN lump THEN 'HĐ trọn gói không thanh toán vượt' ELSE 'cần phụ lục / biên bản phát sinh theo TT-42' END END,
   CASE WHEN ok AND has AND in_prior AND abs(kl_kt - coalesce(kl_duyet, 0)) > 1e-6 THEN 'KL kỳ trước khác lũy kế đợt ' || dot_truoc || ' đã duyệt' END,
   CASE WHEN ok AND has AND NOT in_prior AND kl_kt > 0 THEN 'Có KL kỳ trước nhưng đợt ' || dot_truoc || ' không có hạng mục này' END,
   CASE WHEN ok AND dot_truoc IS NULL AND kl_kt > 0 THEN 'Chưa có đợt trước trong CSDL: KL kỳ trước phải nhập tay/đối chiếu hồ sơ gốc' END) AS loi FROM j),
items AS (SELECT *, CASE WHEN loi <> '' THEN round_even(kl_lk * coalesce(don_gia, 0.0) - CASE WHEN ok THEN least(kl_lk, coalesce(m_kl, 0.0)) * coalesce(m_gia, 0.0) ELSE 0.0 END, 0) ELSE 0.0 END AS anh_huong FROM found)"""


def findings(w):
    return reconcile.item_findings(w.claims, w.claim_items, w.contracts, w.amendments, w.boq_log, w.periods, w.period_items, w.remembered, suggest=False)


def lines(w):
    am = reconcile.dated(w.amendments, w.claims)
    e = cut_lineage(state.effective_rows(w.boq_log, am, F.col("ngay")))
    return e, state.union_prefer(e.filter("state = 'live'"), e.filter("state = 'removed'"))


@query("C-R3_item_findings", FINDINGS + " SELECT ma_hd, dong, coalesce(ma_hm, '') AS ma_hm, m_kl, m_gia, loi, anh_huong FROM items")
def _(w):
    return findings(w).select("ma_hd", "dong", F.coalesce("ma_hm", F.lit("")).alias("ma_hm"), "m_kl", "m_gia", F.array_join("loi", "; ").alias("loi"), "anh_huong")


@query("C-R3i_impact", FINDINGS + " SELECT ma_hd, CAST(count(*) FILTER (loi <> '') AS BIGINT) AS n_wrong, sum(anh_huong) AS anh_huong FROM items GROUP BY ma_hd")
def _(w):
    return findings(w).groupBy("ma_hd").agg(F.count(F.when(F.size("loi") > 0, 1)).alias("n_wrong"), F.sum("anh_huong").alias("anh_huong"))


@query("J-01_reconcile_items", FINDINGS + " SELECT ma_hd, dong, ma_hm, cach_khop, kl_lk, m_kl, m_nguon, bo_boi, kl_duyet FROM items")
def _(w):
    return findings(w).select("ma_hd", "dong", "ma_hm", "cach_khop", "kl_lk", "m_kl", "m_nguon", "bo_boi", "kl_duyet")


@query("J-20_only_in_pending", FINDINGS + " SELECT ma_hd, dong, p_no, p_status FROM items WHERE NOT ok AND bo_boi IS NULL AND p_no IS NOT NULL")
def _(w):
    return findings(w).filter("in_force is null and bo_boi is null and p is not null").select("ma_hd", "dong", "p.p_no", "p.p_status")


@query("A-05_held_value", FINDINGS + " SELECT ma_hd, sum(anh_huong) * (1 + max(vat)) AS held FROM items GROUP BY ma_hd")
def _(w):
    return reconcile.held_value(findings(w))


@query("A-04_period_value", FINDINGS + """ SELECT ma_hd, round_even(CAST(sum(CAST(kl_kn * coalesce(m_gia, 0.0) AS DECIMAL(28, 4))) AS DOUBLE) * (1 + max(vat)), 0) AS value FROM items GROUP BY ma_hd""")
def _(w):
    return reconcile.period_value(findings(w))


@query("A-06_error_counts", FINDINGS + """ SELECT split_part(split_part(e, ':', 1), ' (', 1) AS loai_loi, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(loi, '; ')) AS e FROM items WHERE loi <> '') t GROUP BY 1""")
def _(w):
    return reconcile.error_counts(findings(w))


@query("J-06_anti_missing", FINDINGS + """ SELECT s.ma_hd, s.ma_hm, s.kl FROM states s WHERE s.state = 'live' AND NOT EXISTS (SELECT 1 FROM items i WHERE i.ok AND i.ma_hd = s.ma_hd AND i.ma_hm = s.ma_hm)""")
def _(w):
    am = reconcile.dated(w.amendments, w.claims)
    eff = cut_lineage(state.effective_rows(w.boq_log, am, F.col("ngay")))
    f = reconcile._item_findings(eff, w.claims, w.claim_items, w.contracts, am, w.boq_log, w.periods, w.period_items, w.remembered, False)
    return reconcile.missing_lines(f, eff.filter("state = 'live'")).select("ma_hd", "ma_hm", "kl")


@query("J-02_match_by_key", f"WITH {CLAIM_STATES}, {MATCHED} SELECT i.ma_hd, i.dong, k.hm_key FROM claim_items i JOIN bykey k ON k.ma_hd = i.ma_hd AND k.khoa = i.khoa")
def _(w):
    _e, ln = lines(w)
    it = w.claim_items.withColumn("khoa", match_key(F.col("nhom"), F.col("ten"), F.col("dvt")))
    return it.join(match.by_key(ln), ["ma_hd", "khoa"]).select("ma_hd", "dong", "hm_key")


@query("J-03_match_by_unique_name", f"""WITH {CLAIM_STATES}, {MATCHED} SELECT i.ma_hd, i.dong, n.hm_name FROM claim_items i JOIN byname n ON n.ma_hd = i.ma_hd AND n.fn = {sql_fold('i.ten')} AND n.fu = {sql_fold('i.dvt')}""")
def _(w):
    _e, ln = lines(w)
    return match.name_unit(w.claim_items).join(match.by_unique_name(ln), ["ma_hd", "f_name", "f_unit"]).select("ma_hd", "dong", "hm_name")


@query("J-04_match_cascade", f"WITH {CLAIM_STATES}, {MATCHED} SELECT ma_hd, dong, ma_hm, cach_khop FROM matched")
def _(w):
    _e, ln = lines(w)
    return match.match_cascade(w.claim_items, ln, w.remembered).select("ma_hd", "dong", "ma_hm", "cach_khop")


def sql_edit(a, b):
    return f"(1.0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})))"


@query("J-05_fuzzy_suggest", f"""WITH {CLAIM_STATES}, {MATCHED},
  p AS (SELECT m.ma_hd, m.dong, l.ma_hm, {sql_fold('m.ten')} AS a, {sql_fold('l.ten')} AS b FROM matched m JOIN lines_all l ON l.ma_hd = m.ma_hd AND {sql_fold('l.dvt')} = {sql_fold('m.dvt')} WHERE m.ma_hm IS NULL),
  s AS (SELECT ma_hd, dong, ma_hm AS goi_y, {sql_edit('a', 'b')} AS goi_y_score, row_number() OVER (PARTITION BY ma_hd, dong ORDER BY {sql_edit('a', 'b')} DESC, ma_hm DESC) AS rn FROM p WHERE {sql_edit('a', 'b')} >= 0.7)
  SELECT m.ma_hd, m.dong, s.goi_y, s.goi_y_score FROM matched m LEFT JOIN s ON s.ma_hd = m.ma_hd AND s.dong = m.dong AND s.rn = 1 WHERE m.ma_hm IS NULL""")
def _(w):
    _e, ln = lines(w)
    it = match.match_cascade(w.claim_items, ln, w.remembered).filter("ma_hm is null").select("ma_hd", "dong", "ten", "dvt")
    return match.fuzzy_suggest(it, ln, threshold=0.7, measure="edit").select("ma_hd", "dong", "goi_y", "goi_y_score")


@query("X-19_similarity", f"""WITH p AS (SELECT p_partkey, {sql_fold('p_name')} AS a, {sql_fold("p_type || ' ' || p_name")} AS b, {sql_fold('p_brand')} AS c FROM part)
  SELECT p_partkey, CASE WHEN contains(a, b) OR contains(b, a) THEN 1.0 ELSE {sql_edit('a', 'b')} END AS s_type, CASE WHEN contains(a, c) OR contains(c, a) THEN 1.0 ELSE {sql_edit('a', 'c')} END AS s_brand FROM p""")
def _(w):
    return w.part.select("p_partkey", edit_similarity(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")).alias("s_type"),
                         edit_similarity(F.col("p_name"), F.col("p_brand")).alias("s_brand"))


VERDICT = """WITH v AS (SELECT c.ma_hd, q.gt_hd, b.bv, k.ngay FROM contracts c JOIN claims k ON k.ma_hd = c.ma_hd LEFT JOIN claim_totals q ON q.ma_hd = c.ma_hd
     JOIN (SELECT ma_hd, CASE WHEN gom_vat = 'Chưa' THEN gia_tri_hd * (1 + vat) ELSE gia_tri_hd END AS bv FROM contracts) b ON b.ma_hd = c.ma_hd),
  f AS (SELECT a.ma_hd, a.so_pl, sum(gt_sau_vat) OVER w AS cum, row_number() OVER w AS step, count(*) OVER (PARTITION BY a.ma_hd) AS n FROM amendments a JOIN v ON v.ma_hd = a.ma_hd
     WHERE a.trang_thai = 'Đã ký' AND a.ngay_hieu_luc <= v.ngay WINDOW w AS (PARTITION BY a.ma_hd ORDER BY a.ngay_hieu_luc, a.ngay_ky, a.so_pl, a.id)),
  t AS (SELECT ma_hd, max(n) AS n, arg_max(cum, step) AS total FROM f GROUP BY ma_hd),
  p AS (SELECT a.ma_hd, a.so_pl, sum(gt_sau_vat) OVER w AS cum, row_number() OVER w AS step FROM amendments a JOIN v ON v.ma_hd = a.ma_hd
     WHERE a.trang_thai <> 'Đã hủy' AND (a.trang_thai = 'Dự thảo' OR a.ngay_hieu_luc > v.ngay) WINDOW w AS (PARTITION BY a.ma_hd ORDER BY a.ngay_hieu_luc, a.id)),
  x AS (SELECT v.*, coalesce(t.n, 0) AS n, bv + coalesce(t.total, 0.0) AS hl FROM v LEFT JOIN t USING (ma_hd)),
  st AS (SELECT x.ma_hd, arg_min(so_pl, step) AS so_pl FROM x JOIN f ON f.ma_hd = x.ma_hd WHERE step < x.n AND abs(gt_hd - (bv + cum)) <= greatest(1000.0, abs(bv + cum) * 1e-5) GROUP BY x.ma_hd),
  er AS (SELECT x.ma_hd, arg_min(so_pl, step) AS so_pl FROM x JOIN p ON p.ma_hd = x.ma_hd WHERE abs(gt_hd - (hl + cum)) <= greatest(1000.0, abs(hl + cum) * 1e-5) GROUP BY x.ma_hd),
  r AS (SELECT x.*, st.so_pl AS s_no, er.so_pl AS e_no, n > 0 AND abs(gt_hd - bv) <= greatest(1000.0, abs(bv) * 1e-5) AS base_fits FROM x LEFT JOIN st USING (ma_hd) LEFT JOIN er USING (ma_hd)),
  z AS (SELECT *, CASE WHEN gt_hd IS NULL THEN 'THIẾU SỐ LIỆU' WHEN abs(gt_hd - hl) <= greatest(1000.0, abs(hl) * 1e-5) THEN 'ĐẠT' WHEN e_no IS NOT NULL THEN 'PHỤ LỤC CHƯA HIỆU LỰC'
     WHEN base_fits OR s_no IS NOT NULL THEN 'HỒ SƠ CHƯA CẬP NHẬT PHỤ LỤC' ELSE 'CẦN PHỤ LỤC' END AS verdict FROM r)
  SELECT ma_hd, gt_hd, hl AS value_in_force, verdict, CASE WHEN verdict = 'PHỤ LỤC CHƯA HIỆU LỰC' THEN e_no WHEN verdict = 'HỒ SƠ CHƯA CẬP NHẬT PHỤ LỤC' THEN CASE WHEN base_fits THEN 'HĐ gốc' ELSE s_no END END AS explained_by FROM z"""


@query("C-R1_contract_value_verdict", VERDICT)
def _(w):
    return reconcile.contract_value_verdict(w.claims, w.claim_totals.select("ma_hd", "gt_hd"), w.contracts, w.amendments)


@query("C-R4_previous_total", """SELECT p.ma_hd, 'R4' AS "check", t.gt_lk_kt AS v_file, p.v AS v_store, CASE WHEN t.gt_lk_kt IS NULL OR p.v IS NULL THEN 'Thiếu số liệu để so' WHEN abs(t.gt_lk_kt - p.v) <= 1 THEN 'Khớp' ELSE 'Lệch - kiểm tra' END AS verdict
  FROM (SELECT c.ma_hd, arg_max(p.gt_luy_ke, p.dot) AS v FROM claims c JOIN periods p ON c.ma_hd = p.ma_hd AND CASE WHEN c.dot IS NOT NULL THEN p.dot < c.dot ELSE p.ngay_nghiem_thu IS NULL OR p.ngay_nghiem_thu < c.ngay END GROUP BY c.ma_hd) p
  LEFT JOIN claim_totals t ON t.ma_hd = p.ma_hd""")
def _(w):
    return reconcile.previous_total_check(w.claims, w.periods, w.claim_totals)


@query("W-15_last_nonzero_history", "SELECT ma_hd, arg_max(CASE WHEN dot % 4 = 0 THEN 0.0 ELSE gt_luy_ke END, dot) FILTER (dot % 4 <> 0 AND gt_luy_ke <> 0) AS gt_luy_ke FROM periods GROUP BY ma_hd")
def _(w):
    return reconcile.last_nonzero(w.periods.withColumn("gt_luy_ke", F.when(F.col("dot") % 4 == 0, 0.0).otherwise(F.col("gt_luy_ke"))))


MASTER = """WITH base AS (SELECT ma_hd, khoa, arg_max(ma_hm, id) AS ma_hm, arg_max(kl, id) AS kl, arg_max(don_gia, id) AS don_gia FROM boq_base GROUP BY ma_hd, khoa),
  mi AS (SELECT i.ma_hd, i.dong, i.kl_hd, i.kl_kt, i.kl_kn, i.kl_lk, i.don_gia, b.ma_hm, b.kl AS m_kl, b.don_gia AS m_gia, q.kl_luy_ke AS kt_master FROM claim_items i LEFT JOIN base b ON b.ma_hd = i.ma_hd AND b.khoa = i.khoa
    LEFT JOIN period_items q ON q.ma_hd = i.ma_hd AND q.ma_hm = b.ma_hm AND q.dot = 9 WHERE trim(coalesce(i.dvt, '')) <> ''),
  mf AS (SELECT *, concat_ws('; ', CASE WHEN ma_hm IS NULL THEN 'Không có trong BOQ master (phát sinh chưa có phụ lục?)' END,
    CASE WHEN ma_hm IS NOT NULL AND abs(coalesce(kl_hd, 0) - m_kl) > 1e-6 THEN 'KL HĐ khác master' END, CASE WHEN ma_hm IS NOT NULL AND abs(coalesce(don_gia, 0) - m_gia) > 0.5 THEN 'Đơn giá khác master' END,
    CASE WHEN ma_hm IS NOT NULL AND kt_master IS NOT NULL AND abs(kl_kt - kt_master) > 1e-6 THEN 'KL kỳ trước khác master (đợt trước đã duyệt)' END,
    CASE WHEN ma_hm IS NOT NULL AND kt_master IS NULL THEN 'Master chưa có KL kỳ trước (đợt đầu: nhập tay)' END, CASE WHEN ma_hm IS NOT NULL AND kl_lk > m_kl + 1e-6 THEN 'Lũy kế vượt KL HĐ' END) AS loi FROM mi)"""


def master(w):
    return reconcile.master_items(w.claim_items, w.boq_base, w.period_items.filter("dot = 9"))


@query("C-M6_master_item_errors", MASTER + """ SELECT ma_hd, dong, ma_hm, loi, (coalesce(don_gia, 0) - m_gia) * kl_lk AS price_effect, (kl_kt - kt_master) * coalesce(m_gia, 0) AS prior_effect FROM mf""")
def _(w):
    return master(w).select("ma_hd", "dong", "ma_hm", F.array_join("loi", "; ").alias("loi"), "price_effect", "prior_effect")


TOTALS_MORE = "claim_totals"
MPARAMS = """pv AS (SELECT ma_hd, max(CASE WHEN ma_ts = 'TT-02' THEN CAST(gia_tri AS DOUBLE) END) AS tt02, max(CASE WHEN ma_ts = 'TT-04' THEN CASE gia_tri WHEN '8%' THEN 0.08 ELSE 0.1 END END) AS tt04,
   max(CASE WHEN ma_ts = 'TT-21' THEN 0.05 END) AS tt21 FROM params GROUP BY ma_hd)"""
MCHECK = MASTER + f""", {MPARAMS}, s AS (SELECT ma_hd, CAST(sum(CAST(kl_kt * coalesce(m_gia, 0) AS DECIMAL(28, 4))) AS DOUBLE) AS kt_sum, CAST(sum(CAST(kl_kn * coalesce(m_gia, 0) AS DECIMAL(28, 4))) AS DOUBLE) AS kn_sum FROM mi GROUP BY ma_hd),
  l AS (SELECT ma_hd, arg_max(gt_luy_ke, dot) FILTER (gt_luy_ke <> 0) AS last_lk FROM periods GROUP BY ma_hd),
  k AS (SELECT t.*, pv.tt02, pv.tt04, pv.tt21, kt_sum, kn_sum, last_lk FROM claim_totals t LEFT JOIN pv USING (ma_hd) LEFT JOIN s USING (ma_hd) LEFT JOIN l USING (ma_hd)),
  u AS (SELECT ma_hd, 'M1' AS "check", gt_hd AS v_file, tt02 AS v_store, 1.0 AS tol FROM k
    UNION ALL SELECT ma_hd, 'M2', CASE WHEN giu_lai <> 0 AND gt_kn <> 0 THEN giu_lai / gt_kn END, tt21, 0.0005 FROM k
    UNION ALL SELECT ma_hd, 'M3', gt_lk_kt, last_lk, 1.0 FROM k
    UNION ALL SELECT ma_hd, 'M4', round_even(coalesce(kt_sum, 0.0) * (1 + coalesce(tt04, 0.0)), 0), last_lk, 1.0 FROM k
    UNION ALL SELECT ma_hd, 'M5', round_even(coalesce(kn_sum, 0.0) * (1 + coalesce(tt04, 0.0)), 0), gt_kn, greatest(1000.0, coalesce(gt_kn, 0.0) * 1e-5) FROM k)
  SELECT ma_hd, "check", v_file, v_store, CASE WHEN v_file IS NULL OR v_store IS NULL THEN 'Thiếu số liệu để so' WHEN abs(v_file - v_store) <= tol THEN 'Khớp' ELSE 'Lệch - kiểm tra' END AS verdict FROM u"""


def master_checks(w):
    p = w.params.groupBy("ma_hd").agg(F.max(F.when(F.col("ma_ts") == "TT-02", money(F.col("gia_tri")))).alias("tt02"),
                                      F.max(F.when(F.col("ma_ts") == "TT-04", rate(F.col("gia_tri")))).alias("tt04"),
                                      F.max(F.when(F.col("ma_ts") == "TT-21", rate(F.col("gia_tri")))).alias("tt21"))
    return reconcile.master_checks(master(w), w.claim_totals, p, w.periods)


for _i in range(1, 6):
    def _reg(i=_i):
        name = {1: "contract_value", 2: "retention_ratio", 3: "prior_cumulative", 4: "prior_quantities", 5: "this_period"}[i]

        @query(f"C-M{i}_{name}", MCHECK + f" WHERE \"check\" = 'M{i}'")
        def _q(w):
            return master_checks(w).filter(F.col("check") == f"M{i}")
    _reg()


@query("J-21_derive_changes", """WITH cur AS (SELECT ma_hd, ma_hm, kl, don_gia FROM boq_base), tb AS (SELECT i.ma_hd, CASE WHEN i.dong % 4 = 1 THEN NULL ELSE b.ma_hm END AS matched, i.kl_lk AS kl, i.don_gia, i.ten, substr(i.ma_hd, 12, 1) IN ('0', '5') AS whole
     FROM claim_items i LEFT JOIN boq_base b ON b.ma_hd = i.ma_hd AND b.ma_hm = i.true_hm WHERE trim(coalesce(i.dvt, '')) <> ''), sc AS (SELECT ma_hd, bool_or(whole) AS whole FROM tb GROUP BY ma_hd)
  SELECT ma_hd, matched AS ma_hm, 'THEM' AS thao_tac, kl, don_gia, ten FROM tb WHERE matched IS NULL
  UNION ALL SELECT t.ma_hd, matched, 'THAY', t.kl, t.don_gia, ten FROM tb t JOIN cur c ON c.ma_hd = t.ma_hd AND c.ma_hm = t.matched WHERE abs(coalesce(t.kl, 0) - coalesce(c.kl, 0)) > 1e-9 OR abs(coalesce(t.don_gia, 0) - coalesce(c.don_gia, 0)) > 0.5
  UNION ALL SELECT c.ma_hd, c.ma_hm, 'BO', NULL, NULL, NULL FROM cur c JOIN sc ON sc.ma_hd = c.ma_hd AND sc.whole WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.ma_hd = c.ma_hd AND tb.matched = c.ma_hm)""")
def _(w):
    b = w.boq_base.select("ma_hd", F.col("ma_hm").alias("true_hm"), F.col("ma_hm").alias("hm"))
    t = (match.measured(w.claim_items).join(b, ["ma_hd", "true_hm"], "left")
         .select("ma_hd", F.when(F.col("dong") % 4 != 1, F.col("hm")).alias("matched"), F.col("kl_lk").alias("kl"), "don_gia", "ten",
                 F.substring("ma_hd", 12, 1).isin("0", "5").alias("whole")))
    return match.derive_changes(t, w.boq_base, F.col("whole"))


@query("J-19_catalogue_vs_store", """WITH cat AS (SELECT ma_hd, ma_ts, CASE WHEN ma_ts = 'TC-02' THEN '5/3/1996' WHEN ma_ts = 'TT-02' THEN gia_tri || '.0' WHEN ma_ts = 'TT-01' THEN lower(gia_tri) WHEN ma_ts = 'TT-22' THEN CAST(CAST(gia_tri AS BIGINT) + 1 AS STRING) ELSE gia_tri END AS gia_tri FROM params)
  SELECT c.ma_hd, c.ma_ts, c.gia_tri AS listed, p.gia_tri AS stored FROM cat c JOIN params p ON p.ma_hd = c.ma_hd AND p.ma_ts = c.ma_ts WHERE c.ma_ts = 'TT-22'""")
def _(w):
    v = F.col("gia_tri")
    code = F.col("ma_ts")
    cat = w.params.select("ma_hd", "ma_ts", F.when(code == "TC-02", "5/3/1996").when(code == "TT-02", F.concat(v, F.lit(".0"))).when(code == "TT-01", F.lower(v))
                          .when(code == "TT-22", (v.cast("bigint") + 1).cast("string")).otherwise(v).alias("gia_tri"))
    return match.catalogue_differences(cat, w.params)


@query("J-16_exists_checks", """SELECT c.pl_id, c.ma_ts, EXISTS (SELECT 1 FROM params p JOIN amendments a ON a.id = c.pl_id WHERE p.ma_hd = a.ma_hd AND p.ma_ts = c.ma_ts) AS known FROM param_changes c""")
def _(w):
    ch = w.param_changes.join(w.amendments.select(F.col("id").alias("pl_id"), "ma_hd"), "pl_id")
    known = w.params.select("ma_hd", "ma_ts").distinct().withColumn("k", F.lit(True))
    return ch.join(known, ["ma_hd", "ma_ts"], "left").select("pl_id", "ma_ts", F.coalesce("k", F.lit(False)).alias("known"))
