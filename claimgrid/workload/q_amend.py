"""Checks of amendment forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrid.operators import amend, quality, state
from claimgrid.workload.q_reconcile import sql_fold
from claimgrid.workload.q_state import EVENTS_SQL, big
from claimgrid.workload.registry import query


def _day(x):
    return f"try_strptime(nullif(trim({x}), ''), '%d/%m/%Y')::DATE"


STATES = (EVENTS_SQL.replace("LEFT JOIN amendments a ON b.pl_id = a.id", "JOIN f q ON q.ma_hd = b.ma_hd LEFT JOIN store_amendments a ON b.pl_id = a.id")
          .replace("a.ngay_hieu_luc <= __DAY__", "q.hl IS NOT NULL AND (a.ngay_hieu_luc < q.hl OR (a.ngay_hieu_luc = q.hl AND a.so_pl <= q.so_pl))"))
BV = "CASE WHEN gom_vat = 'Chưa' THEN gia_tri_hd * (1 + vat) ELSE gia_tri_hd END"
PRELUDE = f"""WITH f0 AS (SELECT x.*, (trim(ngay_ky) <> '' AND {_day('ngay_ky')} IS NULL) OR (trim(ngay_hieu_luc) <> '' AND {_day('ngay_hieu_luc')} IS NULL) AS bad FROM forms x),
f AS (SELECT form_id, f0.ma_hd, upper(trim(so_pl)) AS so_pl, bad, CASE WHEN NOT bad THEN {_day('f0.ngay_ky')} END AS ky, CASE WHEN NOT bad THEN coalesce({_day('ngay_hieu_luc')}, {_day('f0.ngay_ky')}) END AS hl,
   trang_thai AS tt, {sql_fold('doi_boq')} AS doi, can_cu, CAST(gt_hd_sau_pl AS DOUBLE) AS t_hd, CAST(gt_truoc_vat AS DOUBLE) AS t_truoc, CAST(gt_sau_vat AS DOUBLE) AS t_sau,
   c.vat, c.ngay_ky AS hd_ky, {BV} AS bv, c.gom_vat, CASE WHEN lower(c.loai_gia) LIKE '%trọn gói%' THEN 'trọn gói' WHEN lower(c.loai_gia) LIKE '%điều chỉnh%' THEN 'đơn giá điều chỉnh' WHEN lower(c.loai_gia) LIKE '%cố định%' THEN 'đơn giá cố định' ELSE c.loai_gia END AS loai,
   coalesce(CAST(gt_sau_vat AS DOUBLE), round_even(CAST(gt_truoc_vat AS DOUBLE) * (1 + c.vat), 0)) AS gts0,
   coalesce(CAST(gt_truoc_vat AS DOUBLE), round_even(CAST(gt_sau_vat AS DOUBLE) / (1 + c.vat), 0), 0.0) AS gtt
   FROM f0 JOIN (SELECT ma_hd, vat, gom_vat, gia_tri_hd, ngay_ky, loai_gia FROM contracts) c ON c.ma_hd = f0.ma_hd), {STATES},
paid AS (SELECT i.ma_hd, i.ma_hm, arg_max(i.kl_luy_ke, i.dot) AS paid, arg_max(struct_pack(d := p.ngay_nghiem_thu), i.dot).d AS paid_day FROM period_items i JOIN periods p ON p.ma_hd = i.ma_hd AND p.dot = i.dot GROUP BY i.ma_hd, i.ma_hm),
b0 AS (SELECT l.*, f.ma_hd, f.loai, f.can_cu, f.ky, s.ma_hm IS NOT NULL AS live, s.kl AS c_kl, s.don_gia AS c_gia, s.ten AS c_ten, g.bo_boi FROM form_lines l JOIN f ON f.form_id = l.form_id
   LEFT JOIN states s ON s.state = 'live' AND s.ma_hd = f.ma_hd AND s.ma_hm = l.ma_hm LEFT JOIN states g ON g.state = 'removed' AND g.ma_hd = f.ma_hd AND g.ma_hm = l.ma_hm),
b1 AS (SELECT *, thao_tac IN ('THAY', 'THEM', 'BO') AS known, thao_tac IN ('THAY', 'BO') AND NOT live AS tgone, thao_tac = 'THEM' AND ma_hm <> '' AND (live OR bo_boi IS NOT NULL) AS ex FROM b0),
b2 AS (SELECT *, thao_tac = 'THEM' AND NOT ex AND (coalesce(ten, '') = '' OR coalesce(dvt, '') = '' OR kl IS NULL OR don_gia IS NULL) AS short FROM b1),
nx AS (SELECT ma_hd, max(CAST(substr(ma_hm, 3) AS BIGINT)) AS mx FROM boq_log GROUP BY ma_hd),
b3 AS (SELECT *, known AND NOT tgone AND NOT ex AND NOT short AS valid FROM b2),
bn AS (SELECT b3.*, coalesce(mx, 0) AS mx, sum(CASE WHEN valid AND thao_tac = 'THEM' AND ma_hm = '' THEN 1 ELSE 0 END) OVER (PARTITION BY form_id ORDER BY dong) AS nth FROM b3 LEFT JOIN nx USING (ma_hd)),
b4 AS (SELECT *, CASE WHEN valid AND thao_tac = 'THEM' AND ma_hm = '' THEN 'HM' || lpad(CAST(greatest(mx + 1, coalesce(max(CASE WHEN valid AND thao_tac = 'THEM' THEN try_cast(nullif(regexp_extract(ma_hm, '^HM(\\d+)$', 1), '') AS BIGINT) + 1 - nth END) OVER (PARTITION BY form_id ORDER BY dong), 0)) + nth - 1 AS VARCHAR), 4, '0') ELSE ma_hm END AS new_hm FROM bn),
kk AS (SELECT ma_hd, khoa, min(ma_hm) AS h FROM states WHERE state = 'live' AND khoa IS NOT NULL GROUP BY ALL),
nn AS (SELECT ma_hd, {sql_fold('ten')} AS fn, {sql_fold('dvt')} AS fu, min(ma_hm) AS h FROM states WHERE state = 'live' GROUP BY 1, 2, 3 HAVING count(*) = 1),
b AS (SELECT b4.*, p.paid, p.paid_day, coalesce(kk.h, nn.h) AS dup, CASE WHEN NOT valid THEN NULL WHEN thao_tac = 'BO' THEN -round_even(coalesce(c_kl, 0.0) * coalesce(c_gia, 0.0), 0) WHEN thao_tac = 'THEM' THEN round_even(kl * don_gia, 0)
     ELSE round_even(coalesce(kl, c_kl, 0.0) * coalesce(don_gia, c_gia, 0.0), 0) - round_even(coalesce(c_kl, 0.0) * coalesce(c_gia, 0.0), 0) END AS delta
   FROM b4 LEFT JOIN paid p ON p.ma_hd = b4.ma_hd AND p.ma_hm = b4.new_hm LEFT JOIN kk ON kk.ma_hd = b4.ma_hd AND kk.khoa = {sql_fold('b4.nhom')} || '|' || {sql_fold('b4.ten')} || '|' || {sql_fold('b4.dvt')}
   LEFT JOIN nn ON nn.ma_hd = b4.ma_hd AND nn.fn = {sql_fold('b4.ten')} AND nn.fu = {sql_fold('b4.dvt')}),
s AS (SELECT form_id, count(*) AS n_rows, count(*) FILTER (valid) AS n_valid, sum(coalesce(delta, 0.0)) AS delta FROM b GROUP BY form_id),
vb AS (SELECT q.form_id, CAST(sum(CAST(gt_sau_vat AS DECIMAL(24, 3))) AS DOUBLE) AS d FROM f q JOIN store_amendments a ON a.ma_hd = q.ma_hd WHERE a.trang_thai = 'Đã ký' AND q.hl IS NOT NULL AND (a.ngay_hieu_luc < q.hl OR (a.ngay_hieu_luc = q.hl AND a.so_pl <= q.so_pl)) GROUP BY q.form_id),
us AS (SELECT DISTINCT ma_hd, so_pl FROM store_amendments WHERE trang_thai <> 'Đã hủy'),
tp AS (SELECT ma_hd, max(CAST(regexp_extract(so_pl, '(\\d+)', 1) AS BIGINT)) AS mx FROM store_amendments WHERE trang_thai <> 'Đã hủy' GROUP BY ma_hd),
g AS (SELECT f.*, coalesce(gts0, 0.0) AS gts, coalesce(s.n_rows, 0) AS n_rows, coalesce(s.n_valid, 0) AS n_valid, coalesce(s.delta, 0.0) AS delta, bv + coalesce(vb.d, 0.0) AS before, us.so_pl IS NOT NULL AS used, coalesce(tp.mx, 0) AS mx,
   try_cast(regexp_extract(f.so_pl, '(\\d+)', 1) AS BIGINT) AS no FROM f LEFT JOIN s ON s.form_id = f.form_id LEFT JOIN vb ON vb.form_id = f.form_id LEFT JOIN us ON us.ma_hd = f.ma_hd AND us.so_pl = f.so_pl LEFT JOIN tp ON tp.ma_hd = f.ma_hd),
ap AS (SELECT a.*, f.ma_hd, p.ma_hd IS NOT NULL AS in_base, CASE WHEN cc.moi IS NOT NULL THEN cc.moi ELSE p.gia_tri END AS cur FROM form_params a JOIN f ON f.form_id = a.form_id LEFT JOIN params p ON p.ma_hd = f.ma_hd AND p.ma_ts = a.ma_ts
   LEFT JOIN (SELECT q.form_id, c.ma_ts, arg_max(c.gia_tri_moi, struct_pack(a := a.ngay_hieu_luc, b := a.ngay_ky, c := a.so_pl, d := a.id)) AS moi FROM f q JOIN store_amendments a ON a.ma_hd = q.ma_hd AND a.trang_thai = 'Đã ký' AND (q.hl IS NULL OR a.ngay_hieu_luc <= q.hl)
     JOIN param_changes c ON c.pl_id = a.id GROUP BY q.form_id, c.ma_ts) cc ON cc.form_id = a.form_id AND cc.ma_ts = a.ma_ts),
ap2 AS (SELECT *, regexp_full_match(ma_ts, '(TC|TT|Y|BS)-\\d+') AS good FROM ap),
tol AS (SELECT 1)"""

LINE_HITS = {
    "P04": ["SELECT 'CHẶN' AS level, 'unknown operation' AS message, * FROM b WHERE NOT known", "SELECT 'CHẶN', 'target was removed', * FROM b WHERE tgone AND bo_boi IS NOT NULL",
            "SELECT 'CHẶN', 'target is not in force', * FROM b WHERE tgone AND bo_boi IS NULL", "SELECT 'CHẶN', 'added code already exists', * FROM b WHERE ex", "SELECT 'CHẶN', 'added line is incomplete', * FROM b WHERE short",
            f"SELECT 'VÀNG', 'renamed', * FROM b WHERE valid AND thao_tac = 'THAY' AND coalesce(ten, '') <> '' AND {sql_fold('ten')} <> {sql_fold('c_ten')}",
            "SELECT 'VÀNG', 'possible duplicate', * FROM b WHERE valid AND thao_tac = 'THEM' AND dup IS NOT NULL",
            "SELECT 'VÀNG', 'stated total differs', * FROM b WHERE valid AND thao_tac <> 'BO' AND abs(thanh_tien_ghi - round_even(coalesce(kl, c_kl, 0.0) * coalesce(don_gia, c_gia, 0.0), 0)) > 1"],
    "P14": ["SELECT 'ĐỎ' AS level, 'removed but already paid' AS message, * FROM b WHERE valid AND thao_tac = 'BO' AND paid > 1e-9", "SELECT 'ĐỎ', 'reduced below the paid quantity', * FROM b WHERE valid AND thao_tac = 'THAY' AND kl + 1e-9 < paid"],
    "P15": ["SELECT 'ĐỎ' AS level, 'over-quantity accepted before signing' AS message, * FROM b WHERE valid AND thao_tac = 'THAY' AND live AND paid > coalesce(c_kl, 0.0) + 1e-9 AND paid_day < ky"],
    "P16": ["SELECT CASE WHEN trim(coalesce(can_cu, '')) = '' THEN 'ĐỎ' ELSE 'VÀNG' END AS level, 'price change in a fixed-price contract' AS message, * FROM b WHERE valid AND thao_tac = 'THAY' AND abs(coalesce(don_gia, c_gia, 0.0) - coalesce(c_gia, 0.0)) > 0.5 AND loai IN ('trọn gói', 'đơn giá cố định')"],
}
FORM_HITS = {
    "P01": [("CHẶN", "unreadable date", "bad"), ("CHẶN", "no number", "so_pl = ''"), ("CHẶN", "no signing date", "ky IS NULL"), ("CHẶN", "bad status", "tt NOT IN ('Đã ký', 'Dự thảo')"), ("CHẶN", "bad yes/no", "doi NOT IN ('co', 'khong')")],
    "P02": [("CHẶN", "number in use", "so_pl <> '' AND used")],
    "P03": [("CHẶN", "change announced, no line", "doi = 'co' AND n_rows = 0"), ("CHẶN", "lines without announcement", "doi = 'khong' AND n_rows > 0")],
    "P10": [("ĐỎ", "no value stated, lines change it", "gts0 IS NULL AND doi = 'co' AND abs(delta) > 0"),
            ("ĐỎ", "lines x (1 + VAT) differ from the stated value", "doi = 'co' AND n_valid > 0 AND abs(delta * (1 + vat) - gts) > greatest(1000.0, abs(gts) * 1e-5)"),
            ("ĐẠT", "lines match the stated value", "doi = 'co' AND n_valid > 0 AND abs(delta * (1 + vat) - gts) <= greatest(1000.0, abs(gts) * 1e-5)")],
    "P11": [("ĐỎ", "value chain broken", "abs(before + gts - t_hd) > greatest(1000.0, abs(t_hd) * 1e-5)"), ("ĐẠT", "value chain holds", "abs(before + gts - t_hd) <= greatest(1000.0, abs(t_hd) * 1e-5)")],
    "P12": [("VÀNG", "number gap", "no <> mx + 1")],
    "P13": [("ĐỎ", "signed before the contract", "ky < hd_ky"), ("VÀNG", "retroactive", "hl < ky")],
    "P17": [("VÀNG", "value changed without lines", "doi = 'khong' AND abs(gts) > 0 AND loai <> 'trọn gói'")],
    "P18": [("VÀNG", "draft", "tt = 'Dự thảo'")],
}
PARAM_HITS = [("CHẶN", "invalid code", "NOT good"), ("CHẶN", "no new value", "good AND coalesce(moi, '') = ''"), ("VÀNG", "code not in the base parameters", "good AND coalesce(moi, '') <> '' AND NOT in_base"),
              ("VÀNG", "old value is not the current one", f"good AND coalesce(moi, '') <> '' AND coalesce(cu, '') <> '' AND {sql_fold('cu')} <> {sql_fold('cur')} AND NOT coalesce(abs(try_cast(cu AS DOUBLE) - try_cast(cur AS DOUBLE)) < 1e-9, FALSE)"),
              ("VÀNG", "no quotation", "good AND coalesce(moi, '') <> '' AND trim(coalesce(trich, '')) = ''"), ("THÔNG TIN", "TT-02 is computed", "good AND coalesce(moi, '') <> '' AND ma_ts = 'TT-02'")]
SQL = {}
for _c, _parts in LINE_HITS.items():
    SQL[_c] = f"SELECT form_id, CAST(form_id AS VARCHAR) || '/' || CAST(dong AS VARCHAR) AS entity, level, message, '{_c}' AS \"check\" FROM (" + " UNION ALL ".join(_parts) + ") t"
for _c, _parts in FORM_HITS.items():
    SQL[_c] = " UNION ALL ".join(f"SELECT form_id, CAST(form_id AS VARCHAR) AS entity, '{lv}' AS level, '{msg}' AS message, '{_c}' AS \"check\" FROM g WHERE {cond}" for lv, msg, cond in _parts)
SQL["P05"] = " UNION ALL ".join(f"SELECT form_id, CAST(form_id AS VARCHAR) || '/' || ma_ts AS entity, '{lv}' AS level, '{msg}' AS message, 'P05' AS \"check\" FROM ap2 WHERE {cond}" for lv, msg, cond in PARAM_HITS)
ALL_SQL = PRELUDE + ", allf AS (" + " UNION ALL ".join(f"SELECT * FROM ({q}) z{i}" for i, q in enumerate(SQL.values())) + ")"


class Checked(dict):
    """Findings, forms, lines and parameters of the check of all forms; the check is set up once a session, and a part is stored when a
    query first reads it."""

    _set_up: dict = {}

    def __init__(self, w):
        self.w = w

    def __missing__(self, name):
        def make():
            key = (self.w.spark.sparkContext.applicationId, self.w.path)
            if key not in self._set_up:
                self._set_up[key] = _checked(self.w)
            return self._set_up[key][name]
        self[name] = self.w.memo("amend-" + name, make)
        return self[name]


def checked(w):
    return Checked(w)


def _checked(w):
    paid = state.latest_paid(w.period_items, w.periods)
    return amend.check_amendments(w.forms, w.form_params, w.form_lines, w.contracts, w.store_amendments, w.boq_log, w.params, w.param_changes, paid)


NAMES = {"P01": "form_fields", "P02": "duplicate_number", "P03": "flag_vs_lines", "P04": "line_checks", "P05": "parameter_rows", "P10": "line_value_vs_stated", "P11": "value_chain",
         "P12": "number_gap", "P13": "dates", "P14": "below_paid", "P15": "legalised_later", "P16": "fixed_price_change", "P17": "value_without_lines", "P18": "draft"}
for _c, _n in NAMES.items():
    def _reg(c=_c, n=_n):
        @query(f"C-{c}_{n}", PRELUDE + " " + SQL[c])
        def _q(w):
            return checked(w)["findings"].filter(F.col("check") == c).select("form_id", "entity", "level", "message", "check")
    _reg()


@query("C-P00_form_notes", """SELECT form_id, CAST(form_id AS VARCHAR) AS entity, 'CHẶN' AS level, 'named sheet is missing' AS message, 'P00' AS "check" FROM forms WHERE form_id % 9 = 0""")
def _(w):
    """Reader notes pass through as findings."""
    notes = w.forms.filter("form_id % 9 = 0").select("form_id", F.lit("CHẶN").alias("level"), F.lit("named sheet is missing").alias("message"))
    return notes.select("form_id", F.col("form_id").cast("string").alias("entity"), "level", "message", F.lit("P00").alias("check"))


@query("C-TT02_value_parameter", PRELUDE + """ SELECT g.form_id, g.ma_hd, 'TT-02' AS ma_ts, CAST(p.gia_tri AS DOUBLE) AS v_old, CAST(p.gia_tri AS DOUBLE) + CASE WHEN gom_vat = 'Chưa' THEN gtt ELSE gts END AS v_new
   FROM g LEFT JOIN params p ON p.ma_hd = g.ma_hd AND p.ma_ts = 'TT-02' WHERE abs(gts) > 0""")
def _(w):
    c = checked(w)
    return amend.contract_value_change(c["forms"], w.params, w.param_changes, w.store_amendments)


@query("SNK-09_gate_write", ALL_SQL + """, stop AS (SELECT DISTINCT form_id FROM allf WHERE level = 'CHẶN')
   SELECT g.form_id, CAST(g.n_valid AS BIGINT) AS n_lines, CAST(coalesce(k.n, 0) AS BIGINT) AS n_kept FROM g LEFT JOIN (SELECT form_id, count(*) AS n FROM allf WHERE level NOT IN ('ĐẠT', 'THÔNG TIN') GROUP BY form_id) k USING (form_id)
   WHERE NOT EXISTS (SELECT 1 FROM stop WHERE stop.form_id = g.form_id)""")
def _(w):
    o = amend.gate(checked(w))
    n = o["findings"].groupBy("form_id").agg(F.count("*").alias("n_kept"))
    return o["forms"].join(n, "form_id", "left").select("form_id", F.col("n_valid").cast("bigint").alias("n_lines"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query("U-03_collect_findings", ALL_SQL + """ SELECT "check", level, CAST(count(*) AS BIGINT) AS n FROM allf GROUP BY "check", level""")
def _(w):
    return checked(w)["findings"].groupBy("check", "level").agg(F.count("*").alias("n"))


#: A store with violations of every rule: contracts that repeat or are missing, lines of missing amendments or with an unknown operation, repeated lines, periods and quantities.
SPOILT = """hd AS (SELECT ma_hd, so_hd FROM contracts WHERE cust % 30 <> 7 UNION ALL SELECT ma_hd, so_hd FROM contracts WHERE cust % 20 = 0),
pl AS (SELECT id, ma_hd, so_pl, trang_thai FROM amendments WHERE id % 50 <> 0),
bl AS (SELECT id, ma_hd, pl_id, ma_hm, CASE WHEN id % 97 = 0 THEN 'XOA' ELSE thao_tac END AS thao_tac FROM boq_log UNION ALL SELECT id, ma_hd, pl_id, ma_hm, thao_tac FROM boq_log WHERE id % 89 = 0),
dt AS (SELECT ma_hd, dot FROM periods UNION ALL SELECT ma_hd, dot FROM periods WHERE dot = 3),
kl AS (SELECT ma_hd, dot, ma_hm FROM period_items UNION ALL SELECT ma_hd, dot, ma_hm FROM period_items WHERE dot = 3)"""


@query("C-DQ_store_rules", f"""WITH {SPOILT} SELECT 'DQ-PK contract' AS "check", ma_hd AS entity, CAST(count(*) AS BIGINT) AS n FROM hd GROUP BY ma_hd HAVING count(*) > 1
   UNION ALL SELECT 'DQ-UQ contract', so_hd, CAST(count(*) AS BIGINT) FROM hd GROUP BY so_hd HAVING count(*) > 1
   UNION ALL SELECT 'DQ-UQ amendment', ma_hd || '/' || so_pl, CAST(count(*) AS BIGINT) FROM pl WHERE trang_thai <> 'Đã hủy' GROUP BY ma_hd, so_pl HAVING count(*) > 1
   UNION ALL SELECT 'DQ-UQ line', ma_hd || '/' || coalesce(CAST(pl_id AS VARCHAR), '-') || '/' || ma_hm, CAST(count(*) AS BIGINT) FROM bl GROUP BY ma_hd, pl_id, ma_hm HAVING count(*) > 1
   UNION ALL SELECT 'DQ-PK period', ma_hd || '/' || dot, CAST(count(*) AS BIGINT) FROM dt GROUP BY ma_hd, dot HAVING count(*) > 1
   UNION ALL SELECT 'DQ-PK quantity', ma_hd || '/' || dot || '/' || ma_hm, CAST(count(*) AS BIGINT) FROM kl GROUP BY ma_hd, dot, ma_hm HAVING count(*) > 1
   UNION ALL SELECT 'DQ-FK amendment', ma_hd, CAST(count(*) AS BIGINT) FROM pl WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.ma_hd = pl.ma_hd) GROUP BY ma_hd
   UNION ALL SELECT 'DQ-FK line', CAST(pl_id AS VARCHAR), CAST(count(*) AS BIGINT) FROM bl WHERE pl_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.id = bl.pl_id) GROUP BY pl_id
   UNION ALL SELECT 'DQ-CK line', CAST(id AS VARCHAR), 1 FROM bl WHERE thao_tac NOT IN ('GOC', 'THAY', 'THEM', 'BO')""")
def _(w):
    """All nine rules over the store with its planted violations."""
    hd = w.contracts.filter("cust % 30 <> 7").unionByName(w.contracts.filter("cust % 20 = 0"))
    spoilt = w.boq_log.withColumn("thao_tac", F.when(F.col("id") % 97 == 0, "XOA").otherwise(F.col("thao_tac")))
    bl = spoilt.unionByName(w.boq_log.filter("id % 89 = 0"))
    twice = lambda df: df.unionByName(df.filter("dot = 3"))
    return quality.store_violations(hd, w.amendments.filter("id % 50 <> 0"), bl, twice(w.periods), twice(w.period_items)).select("check", "entity", "n")
