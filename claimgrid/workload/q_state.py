"""State layer: rows, parameters and values in force."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.operators import quality, state
from claimgrid.workload.registry import query

DAY = "1999-06-30"


def dayc():
    return F.to_date(F.lit(DAY))

SIGNED_SQL = f"trang_thai = 'Đã ký' AND ngay_hieu_luc <= DATE '{DAY}'"


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


EVENTS_SQL = f"""
log AS (SELECT b.*, coalesce(a.so_pl, 'HĐ gốc') AS so_pl,
        row_number() OVER (PARTITION BY b.ma_hd, b.ma_hm ORDER BY (b.pl_id IS NOT NULL), a.ngay_hieu_luc, a.ngay_ky, a.so_pl, b.id) AS rn
        FROM boq_log b LEFT JOIN amendments a ON b.pl_id = a.id
        WHERE b.pl_id IS NULL OR (a.trang_thai = 'Đã ký' AND a.ngay_hieu_luc <= __DAY__)),
numbered AS (SELECT *, sum(CASE WHEN thao_tac IN ('GOC', 'THEM') THEN 1 ELSE 0 END) OVER (PARTITION BY ma_hd, ma_hm ORDER BY rn) AS seg FROM log),
cuts AS (SELECT ma_hd, ma_hm, seg, min(rn) AS b FROM numbered WHERE thao_tac = 'BO' AND seg > 0 GROUP BY ALL),
kept AS (SELECT n.*, c.b FROM numbered n LEFT JOIN cuts c USING (ma_hd, ma_hm, seg)
         WHERE seg > 0 AND (c.b IS NULL OR n.rn <= c.b)),
segs AS (SELECT ma_hd, ma_hm, seg,
         arg_max(kl, rn) FILTER (thao_tac <> 'BO' AND kl IS NOT NULL) AS kl,
         arg_max(don_gia, rn) FILTER (thao_tac <> 'BO' AND don_gia IS NOT NULL) AS don_gia,
         arg_max(ten, rn) FILTER (thao_tac <> 'BO' AND ten IS NOT NULL AND ten <> '') AS ten,
         arg_max(dvt, rn) FILTER (thao_tac <> 'BO' AND dvt IS NOT NULL AND dvt <> '') AS dvt,
         arg_max(nhom, rn) FILTER (thao_tac <> 'BO' AND nhom IS NOT NULL AND nhom <> '') AS nhom,
         arg_max(khoa, rn) FILTER (thao_tac IN ('GOC', 'THEM')) AS khoa,
         arg_max(so_pl, rn) FILTER (thao_tac <> 'BO') AS nguon, count(*) FILTER (thao_tac <> 'BO') AS n_changes,
         max(so_pl) FILTER (thao_tac = 'BO') AS bo_boi, bool_or(thao_tac = 'BO') AS is_removed
         FROM kept GROUP BY ma_hd, ma_hm, seg),
states AS (
  SELECT *, 'live' AS state FROM segs s WHERE NOT is_removed AND seg = (SELECT max(seg) FROM segs t WHERE t.ma_hd = s.ma_hd AND t.ma_hm = s.ma_hm)
  UNION ALL
  SELECT *, 'removed' AS state FROM segs s WHERE is_removed AND seg = (SELECT max(seg) FROM segs t WHERE t.ma_hd = s.ma_hd AND t.ma_hm = s.ma_hm AND is_removed))
"""
STATES_SQL = EVENTS_SQL.replace("__DAY__", f"DATE '{DAY}'")
ROW_OUT = "ma_hd, ma_hm, state, ten, dvt, kl, don_gia, khoa, nguon, CAST(n_changes AS BIGINT) AS n_changes, bo_boi"


@query("W-01_effective_rows", f"WITH {STATES_SQL} SELECT {ROW_OUT} FROM states")
def _(w):
    e = state.effective_rows(w.boq_log, w.amendments, dayc())
    return e.select("ma_hd", "ma_hm", "state", "ten", "dvt", "kl", "don_gia", "khoa", "nguon", *big("n_changes"), "bo_boi")


@query("W-01_history", f"""WITH {STATES_SQL} SELECT ma_hd, ma_hm, CAST(seg AS BIGINT) AS seg, CAST(row_number() OVER (PARTITION BY ma_hd, ma_hm, seg ORDER BY rn) AS BIGINT) AS step,
  CASE thao_tac WHEN 'GOC' THEN 'Gốc' WHEN 'THEM' THEN so_pl || ' thêm' ELSE so_pl || ' thay' END AS label,
  last_value(kl IGNORE NULLS) OVER (PARTITION BY ma_hd, ma_hm, seg ORDER BY rn) AS kl_after,
  last_value(don_gia IGNORE NULLS) OVER (PARTITION BY ma_hd, ma_hm, seg ORDER BY rn) AS don_gia_after
  FROM kept WHERE thao_tac <> 'BO'""")
def _(w):
    h = state.history(state.change_log(w.boq_log, state.applicable(w.amendments, dayc())))
    return h.select("ma_hd", "ma_hm", *big("seg", "step"), F.split("note", ": KL ")[0].alias("label"), "kl_after", "don_gia_after")


@query("U-01_union_prefer", f"""WITH {STATES_SQL} SELECT {ROW_OUT} FROM states s WHERE state = 'live' OR NOT EXISTS
  (SELECT 1 FROM states t WHERE t.state = 'live' AND t.ma_hd = s.ma_hd AND t.ma_hm = s.ma_hm)""")
def _(w):
    e = state.effective_rows(w.boq_log, w.amendments, dayc())
    u = state.union_prefer(e.filter("state = 'live'"), e.filter("state = 'removed'"))
    return u.select("ma_hd", "ma_hm", "state", "ten", "dvt", "kl", "don_gia", "khoa", "nguon", *big("n_changes"), "bo_boi")


@query("F-01_resolve_ref", """WITH refs AS (SELECT c_name AS ref FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT substr(c_name, 13) FROM customer WHERE c_custkey % 3 = 1
    UNION ALL SELECT lower(ma_hd) FROM contracts WHERE cust % 3 = 2 UNION ALL SELECT 'XX' || c_name FROM customer WHERE c_custkey % 10 = 0),
  r AS (SELECT DISTINCT ref, trim(ref) AS r FROM refs),
  ex AS (SELECT ref, min(ma_hd) AS e FROM r JOIN contracts ON upper(r) = ma_hd OR r = so_hd GROUP BY ref),
  pt AS (SELECT ref, count(*) AS n, min(ma_hd) AS p FROM r JOIN contracts ON contains(so_hd, r) WHERE length(r) >= 4 GROUP BY ref)
  SELECT r.ref, CASE WHEN e IS NOT NULL THEN e WHEN n = 1 THEN p END AS ma_hd,
    CASE WHEN e IS NOT NULL OR n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status
  FROM r LEFT JOIN ex USING (ref) LEFT JOIN pt USING (ref)""")
def _(w):
    c = w.customer
    refs = (c.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("ref"))
            .union(c.filter("c_custkey % 3 = 1").select(F.substring("c_name", 13, 99)))
            .union(w.contracts.filter("cust % 3 = 2").select(F.lower("ma_hd")))
            .union(c.filter("c_custkey % 10 = 0").select(F.concat(F.lit("XX"), "c_name"))))
    return state.resolve_reference(refs, w.contracts)


@query("F-02_applicable", f"SELECT id, ma_hd, so_pl, ngay_ky, ngay_hieu_luc FROM amendments WHERE {SIGNED_SQL} AND id <> 7")
def _(w):
    return state.applicable(w.amendments, dayc(), F.lit(7)).select("id", "ma_hd", "so_pl", "ngay_ky", "ngay_hieu_luc")


@query("F-03_pending", f"""SELECT id, ma_hd, so_pl, trang_thai, ngay_hieu_luc FROM amendments
  WHERE trang_thai <> 'Đã hủy' AND (trang_thai = 'Dự thảo' OR ngay_hieu_luc > DATE '{DAY}')""")
def _(w):
    return state.pending(w.amendments, dayc()).select("id", "ma_hd", "so_pl", "trang_thai", "ngay_hieu_luc")


@query("F-07_before", f"""SELECT id, ma_hd, so_pl, ngay_hieu_luc FROM amendments WHERE trang_thai = 'Đã ký'
  AND (ngay_hieu_luc < DATE '{DAY}' OR (ngay_hieu_luc = DATE '{DAY}' AND so_pl <= 'PL5'))""")
def _(w):
    return state.at_or_before(w.amendments, dayc(), F.lit("PL5")).select("id", "ma_hd", "so_pl", "ngay_hieu_luc")


@query("W-02_effective_params", f"""WITH ch AS (SELECT a.ma_hd, c.ma_ts, c.gia_tri_moi, a.so_pl,
    row_number() OVER (PARTITION BY a.ma_hd, c.ma_ts ORDER BY ngay_hieu_luc DESC, ngay_ky DESC, so_pl DESC, c.pl_id DESC) AS rn,
    count(*) OVER (PARTITION BY a.ma_hd, c.ma_ts) AS n FROM param_changes c JOIN amendments a ON c.pl_id = a.id WHERE {SIGNED_SQL})
  SELECT coalesce(p.ma_hd, c.ma_hd) AS ma_hd, coalesce(p.ma_ts, c.ma_ts) AS ma_ts, CASE WHEN c.ma_ts IS NOT NULL THEN c.gia_tri_moi ELSE p.gia_tri END AS gia_tri,
    coalesce(c.so_pl, 'HĐ gốc') AS nguon, CAST(coalesce(c.n, 0) AS BIGINT) AS n_changes
  FROM params p FULL JOIN (SELECT * FROM ch WHERE rn = 1) c ON p.ma_hd = c.ma_hd AND p.ma_ts = c.ma_ts""")
def _(w):
    e = state.effective_params(w.params, w.param_changes, w.amendments, dayc())
    return e.select("ma_hd", "ma_ts", "gia_tri", "nguon", *big("n_changes"))


@query("W-03_param_history", f"""SELECT a.ma_hd, c.ma_ts, a.so_pl, a.ngay_hieu_luc, c.gia_tri_cu, c.gia_tri_moi,
   CAST(row_number() OVER (PARTITION BY a.ma_hd, c.ma_ts ORDER BY ngay_hieu_luc, ngay_ky, so_pl, c.pl_id) AS BIGINT) AS step
   FROM param_changes c JOIN amendments a ON c.pl_id = a.id WHERE {SIGNED_SQL}""")
def _(w):
    h = state.param_history(w.param_changes, w.amendments, dayc())
    return h.select("ma_hd", "ma_ts", "so_pl", "ngay_hieu_luc", "gia_tri_cu", "gia_tri_moi", *big("step"))


BASE_VALUE = "CASE WHEN gom_vat = 'Chưa' THEN gia_tri_hd * (1 + vat) ELSE gia_tri_hd END"
CHAIN_SQL = f"""run AS (SELECT a.*, CAST(sum(CAST(gt_sau_vat AS DECIMAL(24, 3))) OVER (PARTITION BY ma_hd ORDER BY ngay_hieu_luc, ngay_ky, so_pl, id) AS DOUBLE) AS cum,
     row_number() OVER (PARTITION BY ma_hd ORDER BY ngay_hieu_luc, ngay_ky, so_pl, id) AS step FROM amendments a WHERE {SIGNED_SQL}),
   chain AS (SELECT r.*, {BASE_VALUE} AS base_value FROM run r JOIN (SELECT ma_hd, gia_tri_hd, gom_vat, vat FROM contracts) c USING (ma_hd))"""


@query("W-04_value_chain", f"WITH {CHAIN_SQL} SELECT ma_hd, id, so_pl, CAST(step AS BIGINT) AS step, base_value + (cum - gt_sau_vat) AS value_before, base_value + cum AS value_after FROM chain")
def _(w):
    v = state.value_chain(w.contracts, w.amendments, dayc())
    return v.select("ma_hd", "id", "so_pl", *big("step"), "value_before", "value_after")


@query("W-05_chain_check", f"""WITH {CHAIN_SQL}, st AS (SELECT *, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN base_value + cum ELSE base_value + cum + 5000000 END AS stated FROM chain)
  SELECT ma_hd, id, CASE WHEN abs(base_value + (cum - gt_sau_vat) + gt_sau_vat - stated) > greatest(1000.0, abs(stated) * 1e-5) THEN 'ĐỎ' ELSE 'ĐẠT' END AS level
  FROM st WHERE stated IS NOT NULL""")
def _(w):
    v = state.value_chain(w.contracts, w.amendments, dayc())
    v = v.withColumn("gt_hd_sau_pl", F.when(F.col("id") % 3 == 1, F.col("value_after"))
                     .when(F.col("id") % 3 == 2, F.col("value_after") + 5000000))
    return quality.chain_check(v).select("ma_hd", "id", "level")


@query("W-06_gap_check", """SELECT ma_hd, id, no, prev, no <> coalesce(prev, 0) + 1 AS is_gap FROM (
   SELECT ma_hd, id, CAST(regexp_extract(so_pl, '(\\d+)', 1) AS BIGINT) AS no,
     max(CAST(regexp_extract(so_pl, '(\\d+)', 1) AS BIGINT)) OVER (PARTITION BY ma_hd ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
   FROM amendments WHERE trang_thai <> 'Đã hủy') t""")
def _(w):
    return state.gap_check(w.amendments).select("ma_hd", "id", "no", "prev", "is_gap")


@query("W-17_later_amendments", """SELECT id, ma_hd, CAST(total - last_pos AS BIGINT) AS n_later FROM (SELECT id, ma_hd, count(*) OVER (PARTITION BY ma_hd) AS total,
    count(*) OVER (PARTITION BY ma_hd ORDER BY ngay_hieu_luc, so_pl) AS last_pos FROM amendments WHERE trang_thai <> 'Đã hủy') t""")
def _(w):
    return state.count_later(w.amendments).select("id", "ma_hd", *big("n_later"))


@query("SNK-10_recheck_after_cancel", """SELECT c.id AS cancelled_id, a.ma_hd, a.id, a.so_pl FROM amendments c JOIN amendments a ON a.ma_hd = c.ma_hd AND a.id <> c.id
   AND (a.ngay_hieu_luc > c.ngay_hieu_luc OR (a.ngay_hieu_luc = c.ngay_hieu_luc AND a.so_pl > c.so_pl))
   WHERE c.trang_thai = 'Đã hủy' AND a.trang_thai <> 'Đã hủy'""")
def _(w):
    c = w.amendments.filter(F.col("trang_thai") == X.CANCELLED)
    return state.later_amendments(w.amendments, c).select("cancelled_id", "ma_hd", "id", "so_pl")


@query("A-01_contract_value_asof", f"""SELECT ma_hd, {BASE_VALUE} AS base_value, coalesce(d, 0.0) AS delta, {BASE_VALUE} + coalesce(d, 0.0) AS value_in_force,
   CAST(coalesce(n, 0) AS BIGINT) AS n_pl FROM contracts LEFT JOIN (SELECT ma_hd, CAST(sum(CAST(gt_sau_vat AS DECIMAL(24, 3))) AS DOUBLE) AS d, count(*) AS n
   FROM amendments WHERE {SIGNED_SQL} GROUP BY ma_hd) USING (ma_hd)""")
def _(w):
    v = state.contract_value(w.contracts, w.amendments, dayc())
    return v.select("ma_hd", "base_value", "delta", "value_in_force", *big("n_pl"))


CONTRACT_FIT = """fit AS (SELECT c.ma_hd, c.vat, c.gom_vat, CASE WHEN cust % 2 = 0 THEN c.gia_tri_hd ELSE t.total * CASE WHEN gom_vat = 'Chưa' THEN 1 ELSE 1 + vat END END AS gia_tri_hd
   FROM contracts c LEFT JOIN (SELECT ma_hd, sum(round_even(kl * don_gia, 0)) AS total FROM boq_base GROUP BY ma_hd) t USING (ma_hd))"""
BOQ_TOTAL = f"""WITH {CONTRACT_FIT}, t AS (SELECT ma_hd, sum(round_even(kl * don_gia, 0)) AS total, count(*) AS n FROM boq_base GROUP BY ma_hd),
   j AS (SELECT f.ma_hd, total * (1 + vat) AS boq_value, coalesce({BASE_VALUE}, 0.0) AS gt, n FROM fit f LEFT JOIN t USING (ma_hd))"""


def fitted(w):
    tot = w.boq_base.groupBy("ma_hd").agg(F.sum(F.bround(F.col("kl") * F.col("don_gia"))).alias("total"))
    c = w.contracts.join(tot, "ma_hd", "left")
    scale = F.when(F.col("gom_vat") == "Chưa", 1).otherwise(1 + F.col("vat"))
    return c.withColumn("gia_tri_hd", F.when(F.col("cust") % 2 == 0, F.col("gia_tri_hd")).otherwise(F.col("total") * scale)).drop("total")


@query("A-02_boq_total_check", BOQ_TOTAL + """ SELECT ma_hd, boq_value, gt AS contract_value, CASE WHEN n IS NULL THEN 'B00' WHEN abs(boq_value - gt) > greatest(1000.0, abs(coalesce(gt, 0)) * 1e-5) THEN 'B01' ELSE 'ok' END AS verdict FROM j""")
def _(w):
    return quality.boq_total_check(fitted(w), w.boq_base).select("ma_hd", "boq_value", "contract_value", "verdict")


@query("C-B00_no_base_boq", BOQ_TOTAL + " SELECT ma_hd AS entity, 'B00' AS \"check\", 'VÀNG' AS level FROM j WHERE n IS NULL")
def _(w):
    return quality.base_boq_findings(fitted(w), w.boq_base).filter("check = 'B00'").select("entity", "check", "level")


@query("C-B01_boq_value_gap", BOQ_TOTAL + " SELECT ma_hd AS entity, 'B01' AS \"check\", 'ĐỎ' AS level, boq_value - gt AS amount FROM j WHERE abs(boq_value - gt) > greatest(1000.0, abs(gt) * 1e-5)")
def _(w):
    return quality.base_boq_findings(fitted(w), w.boq_base).filter("check = 'B01'").select("entity", "check", "level", "amount")


@query("C-B02_line_total", "SELECT ma_hd || '/' || ma_hm AS entity, 'B02' AS \"check\", 'VÀNG' AS level, thanh_tien_ghi - round_even(kl * don_gia, 0) AS amount FROM boq_base WHERE abs(thanh_tien_ghi - round_even(kl * don_gia, 0)) > 1")
def _(w):
    return quality.base_boq_findings(fitted(w), w.boq_base).filter("check = 'B02'").select("entity", "check", "level", "amount")


@query("A-03_latest_cumulative", """SELECT ma_hd, ma_hm, max(dot) AS dot, arg_max(kl_luy_ke, dot) AS kl_luy_ke FROM period_items GROUP BY ma_hd, ma_hm""")
def _(w):
    return state.latest_paid(w.period_items, w.periods).select("ma_hd", "ma_hm", "dot", "kl_luy_ke")


@query("J-09_period_items", "SELECT i.ma_hd, i.dot, i.ma_hm, i.kl_luy_ke, p.ngay_nghiem_thu FROM period_items i JOIN periods p ON i.ma_hd = p.ma_hd AND i.dot = p.dot")
def _(w):
    p = w.periods.select("ma_hd", "dot", "ngay_nghiem_thu")
    return w.period_items.join(p, ["ma_hd", "dot"]).select("ma_hd", "dot", "ma_hm", "kl_luy_ke", "ngay_nghiem_thu")


@query("T-06_latest_period", "SELECT ma_hd, max(dot) AS dot, arg_max(gt_luy_ke, dot) AS gt_luy_ke FROM periods GROUP BY ma_hd")
def _(w):
    return state.latest_period(w.periods)


@query("J-07_asof_amendments", """SELECT p.ma_hd, p.dot, CAST(count(a.id) AS BIGINT) AS n_pl, CAST(sum(a.gt_sau_vat) AS DOUBLE) AS delta FROM periods p LEFT JOIN amendments a ON a.ma_hd = p.ma_hd
   AND a.trang_thai = 'Đã ký' AND a.ngay_hieu_luc <= p.ngay_nghiem_thu WHERE p.ngay_nghiem_thu IS NOT NULL GROUP BY p.ma_hd, p.dot""")
def _(w):
    return quality.amendments_per_period(w.periods, w.amendments).select("ma_hd", "dot", *big("n_pl"), "delta")


@query("J-08_asof_prior_period", """SELECT c.ma_hd, c.dot AS claim_dot, max(p.dot) AS dot_truoc, arg_max(p.gt_luy_ke, p.dot) AS gt_luy_ke_truoc FROM claims c JOIN periods p ON c.ma_hd = p.ma_hd AND
   CASE WHEN c.dot IS NOT NULL THEN p.dot < c.dot ELSE p.ngay_nghiem_thu IS NULL OR p.ngay_nghiem_thu < c.ngay END GROUP BY c.ma_hd, c.dot""")
def _(w):
    return state.prior_period(w.claims, w.periods).select("ma_hd", "claim_dot", "dot_truoc", "gt_luy_ke_truoc")


@query("A-07_change_op_counts", """SELECT pl_id, CAST(count(*) FILTER (thao_tac = 'THAY') AS BIGINT) AS n_thay, CAST(count(*) FILTER (thao_tac = 'THEM') AS BIGINT) AS n_them,
   CAST(count(*) FILTER (thao_tac = 'BO') AS BIGINT) AS n_bo FROM boq_changes GROUP BY pl_id""")
def _(w):
    return quality.change_counts(w.boq_changes)


@query("A-22_distinct_codes", "SELECT DISTINCT ma_ts FROM params WHERE ma_ts NOT LIKE 'T%'")
def _(w):
    return quality.extra_codes(w.params)


@query("U-02_extra_codes", "SELECT ma_hd, ma_ts FROM params WHERE ma_ts NOT LIKE 'T%'")
def _(w):
    return w.params.filter(~F.col("ma_ts").isin(X.PARAM_CODES)).select("ma_hd", "ma_ts")


@query("A-23_next_number", "SELECT ma_hd, max(CAST(substr(ma_hm, 3) AS BIGINT)) + 1 AS next_no FROM boq_log GROUP BY ma_hd")
def _(w):
    return state.next_number(w.boq_log, "ma_hd", "ma_hm", "HM")


_EFF = f"""ch AS (SELECT a.ma_hd, c.ma_ts, arg_max(c.gia_tri_moi, struct_pack(a := ngay_hieu_luc, b := ngay_ky, c := so_pl, d := c.pl_id)) AS moi FROM param_changes c JOIN amendments a ON c.pl_id = a.id WHERE {SIGNED_SQL} GROUP BY a.ma_hd, c.ma_ts),
  eff AS (SELECT coalesce(p.ma_hd, c.ma_hd) AS ma_hd, coalesce(p.ma_ts, c.ma_ts) AS ma_ts, coalesce(c.moi, p.gia_tri) AS v, p.trang_thai, c.ma_ts IS NOT NULL AS changed, p.ma_ts IS NOT NULL AS based
  FROM params p FULL JOIN ch c ON p.ma_hd = c.ma_hd AND p.ma_ts = c.ma_ts)"""


@query("A-25_params_wide", f"""WITH {_EFF} SELECT ma_hd, max(v) FILTER (ma_ts = 'TC-01') AS tc01, max(v) FILTER (ma_ts = 'TT-02') AS tt02, max(v) FILTER (ma_ts = 'TT-04') AS tt04, max(v) FILTER (ma_ts = 'TT-10') AS tt10,
   max(v) FILTER (ma_ts = 'TT-20') AS tt20, max(v) FILTER (ma_ts = 'TT-21') AS tt21, max(v) FILTER (ma_ts = 'TT-50') AS tt50, max(v) FILTER (ma_ts = 'Y-02') AS y02,
   CAST(36 - count(*) FILTER (based AND ma_ts LIKE 'T%') AS BIGINT) AS n_missing, CAST(count(*) FILTER (changed) AS BIGINT) AS n_changed FROM eff GROUP BY ma_hd""")
def _(w):
    e = state.effective_params(w.params, w.param_changes, w.amendments, dayc())
    wide = state.params_wide(e, ["Y-01", "Y-02"])
    m = state.missing_and_changed(e)
    codes = {"TC-01": "tc01", "TT-02": "tt02", "TT-04": "tt04", "TT-10": "tt10", "TT-20": "tt20", "TT-21": "tt21", "TT-50": "tt50", "Y-02": "y02"}
    return wide.join(m, "ma_hd").select("ma_hd", *[F.col(f"`{k}`").alias(v) for k, v in codes.items()], *big("n_missing", "n_changed"))


@query("F-12_unconfirmed_params", "SELECT ma_hd, ma_ts FROM params WHERE trang_thai <> 'Đã xác nhận'")
def _(w):
    return quality.unconfirmed(w.params).select("ma_hd", "ma_ts")


@query("J-10_findings_with_amendment", """SELECT f.id, f.ma_hd, f.ma_kt, f.muc_do, coalesce(a.so_pl, '') AS so_pl FROM findings_log f LEFT JOIN amendments a ON f.pl_id = a.id
   WHERE coalesce(a.trang_thai, '') <> 'Đã hủy'""")
def _(w):
    return quality.standing_findings(w.findings_log, w.amendments).select("id", "ma_hd", "ma_kt", "muc_do", "so_pl")


@query("C-RO_contract_controls", f"""WITH {STATES_SQL}, boq AS (SELECT ma_hd, sum(round_even(kl * don_gia, 0)) AS v, count(*) AS n FROM states WHERE state = 'live' GROUP BY ma_hd),
   d AS (SELECT ma_hd, CAST(sum(CAST(gt_sau_vat AS DECIMAL(24, 3))) AS DOUBLE) AS d FROM amendments WHERE {SIGNED_SQL} GROUP BY ma_hd),
   red AS (SELECT f.ma_hd, count(*) AS n FROM findings_log f LEFT JOIN amendments a ON f.pl_id = a.id WHERE coalesce(a.trang_thai, '') <> 'Đã hủy' AND f.muc_do = 'ĐỎ' GROUP BY f.ma_hd),
   un AS (SELECT ma_hd, count(*) AS n FROM params WHERE trang_thai <> 'Đã xác nhận' GROUP BY ma_hd)
   SELECT c.ma_hd, {BASE_VALUE} + coalesce(d.d, 0.0) AS value_in_force, boq.v * (1 + c.vat) AS boq_value, CAST(coalesce(boq.n, 0) AS BIGINT) AS n_items,
     boq.v IS NULL OR abs(boq.v * (1 + c.vat) - ({BASE_VALUE} + coalesce(d.d, 0.0))) > greatest(1000.0, abs({BASE_VALUE} + coalesce(d.d, 0.0)) * 1e-5) AS value_gap,
     CAST(coalesce(red.n, 0) AS BIGINT) AS n_red, CAST(coalesce(un.n, 0) AS BIGINT) AS n_unconfirmed
   FROM contracts c LEFT JOIN boq USING (ma_hd) LEFT JOIN d USING (ma_hd) LEFT JOIN red USING (ma_hd) LEFT JOIN un USING (ma_hd)""")
def _(w):
    q = quality.contract_controls(w.contracts, w.amendments, w.boq_log, w.params, w.findings_log, w.periods, dayc())
    return q.select("ma_hd", "value_in_force", "boq_value", *big("n_items"), "value_gap", *big("n_red", "n_unconfirmed"))
