"""Text layer: contract paragraphs, extraction, comparison and scoring."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions import numbers as N
from claimgrid.functions import text as T
from claimgrid.operators import extract
from claimgrid.workload.q_reconcile import sql_fold
from claimgrid.workload.registry import query


def re2(p: str) -> str:
    """The same pattern for RE2: P-groups, no lookahead; single quotes doubled."""
    p = re.sub(r"\(\?<(?![=!])", "(?P<", p).replace(r"(?:\.(?=\d)[^.]*)*", r"(?:\.\d[^.]*)*")
    return p.replace("'", "''")


def vn_sql(t: str) -> str:
    return (f"CASE WHEN regexp_full_match({t}, '\\d{{1,3}}(\\.\\d{{3}})+') THEN try_cast(replace({t}, '.', '') AS DOUBLE) WHEN contains({t}, ',') THEN try_cast(replace(replace({t}, '.', ''), ',', '.') AS DOUBLE) ELSE try_cast({t} AS DOUBLE) END")


def canon_n(s: str) -> str:
    t = f"trim({s})"
    return (f"round(CASE WHEN regexp_full_match({t}, '-?\\d+([.,]\\d+)?\\s*%') THEN ({vn_sql(f'trim(rtrim({t}, $$% $$))')}) / 100 WHEN regexp_full_match({t}, '(\\d{{1,3}}([.,]\\d{{3}})+|\\d+)') THEN try_cast(replace(replace({t}, '.', ''), ',', '') AS DOUBLE)"
            f" WHEN regexp_full_match({t}, '(\\d+)\\s*(ngày|tháng|bộ)') THEN try_cast(regexp_extract({t}, '^(\\d+)', 1) AS DOUBLE) END, 6)")


PARAS = """np AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM contract_text),
secp AS MATERIALIZED (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(text, '^Điều\\s+(\\d+|[IVXLC]+)\\b\\s*[\\.:]?\\s*(.*)', 'i') THEN trim('Điều ' || regexp_extract(text, '^Điều\\s+(\\d+|[IVXLC]+)\\b\\s*[\\.:]?\\s*(.*)', 1, 'i') || '. ' || regexp_extract(text, '^Điều\\s+(\\d+|[IVXLC]+)\\b\\s*[\\.:]?\\s*(.*)', 2, 'i')) END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY pos), '') AS section FROM np),
st AS (SELECT doc_id, min(n) FILTER (starts_with(text, 'Căn cứ')) AS s FROM np GROUP BY doc_id),
body AS MATERIALIZED (SELECT p.* FROM secp p JOIN st USING (doc_id) WHERE n >= greatest(0, coalesce(s, 0) - 12))"""


def _rule_sql(code, kind, pat):
    p = re2(pat)

    def g(name):
        return f"regexp_extract(text, '{p}', {extract.group_no(pat, name)}, 'i')"
    n, s = "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"
    if kind == "day":
        s = f"lpad({g('d')}, 2, '0') || '/' || lpad({g('m')}, 2, '0') || '/' || {g('y')}"
    elif kind == "text":
        s = f"trim({g('v')}, ' .;:')"
    elif kind == "percent":
        n = f"({vn_sql(g('v'))}) / 100"
    elif kind == "money":
        n = vn_sql(g("v"))
    elif kind == "integer":
        n = f"try_cast({g('v')} AS DOUBLE)"
    elif kind == "vat_included":
        s = f"CASE WHEN contains({g('v')}, 'đã') THEN 'Có' ELSE 'Không' END"
    else:
        v = f"rtrim({g('v')}, '% ')"
        no = f"contains(lower({g('v')}), 'không')"
        n, s = f"CASE WHEN NOT {no} THEN ({vn_sql(v)}) / 100 END", f"CASE WHEN {no} THEN 'Không áp dụng' END"
    lab = g("lab") if "(?<lab>" in pat else "CAST(NULL AS VARCHAR)"
    return f"SELECT doc_id, pos, section, text, '{code}' AS ma, {n} AS v_num, {s} AS v_str, {lab} AS lab FROM body WHERE regexp_matches(text, '{p}', 'i')"


HITS = PARAS + ", hits AS MATERIALIZED (SELECT * FROM (" + " UNION ALL ".join(_rule_sql(*r) for r in X.RULES) + """) t WHERE v_num IS NOT NULL OR v_str IS NOT NULL),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ma ORDER BY pos) AS rn FROM hits) t WHERE rn = 1)"""
LISTS = """hd AS (SELECT doc_id, n AS h_n, pos AS h_pos, section AS h_section, text AS h_text, unnest([CASE WHEN regexp_matches(text, 'Hồ sơ thanh toán gồm', 'i') THEN 'TT-60' END, CASE WHEN regexp_matches(text, 'Hồ sơ (thanh )?quyết toán bao gồm', 'i') THEN 'TT-61' END]) AS ma FROM body),
hx AS (SELECT *, lead(h_n) OVER (PARTITION BY doc_id, ma ORDER BY h_n) AS next_n FROM hd WHERE ma IS NOT NULL),
ls AS (SELECT h.*, b.n, b.text, starts_with(b.text, '+') AS p, trim(trim(ltrim(b.text, '+ ')), ' ;.') AS it FROM hx h JOIN body b ON b.doc_id = h.doc_id AND b.n > h_n AND (next_n IS NULL OR b.n < next_n)),
ls1 AS (SELECT *, sum(CASE WHEN p AND NOT regexp_matches(it, '^Số lượng hồ sơ', 'i') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ma, h_n ORDER BY n) AS got FROM ls),
ls2 AS (SELECT *, sum(CASE WHEN NOT p AND got > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ma, h_n ORDER BY n) AS stopped FROM ls1),
lst AS (SELECT doc_id, ma, h_n, h_pos, h_section, h_text, list(it ORDER BY n) AS items FROM ls2 WHERE p AND stopped = 0 AND NOT regexp_matches(it, '^Số lượng hồ sơ', 'i') GROUP BY ALL),
lists AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ma ORDER BY h_n) AS rn FROM lst) t WHERE rn = 1)"""
UNIT_SQL = "(VALUES " + ", ".join(f"('{c}', '{u}')" for c, _g, _n, u in X.PARAMETERS) + ") k(ma, don_vi)"
ROWS = f"""WITH {HITS}, {LISTS},
raw AS (SELECT d.doc_id, k.ma, k.don_vi, f.v_num, CASE WHEN l.items IS NOT NULL THEN array_to_string(l.items, '; ') ELSE f.v_str END AS v_str, coalesce(f.section, l.h_section, '') AS dieu, coalesce(f.text, l.h_text, '') AS trich, f.lab, l.items
   FROM (SELECT DISTINCT doc_id FROM contract_text) d CROSS JOIN {UNIT_SQL} LEFT JOIN first f ON f.doc_id = d.doc_id AND f.ma = k.ma LEFT JOIN lists l ON l.doc_id = d.doc_id AND l.ma = k.ma),
p20 AS (SELECT * FROM raw WHERE ma = 'TT-20'), p10 AS (SELECT * FROM raw WHERE ma = 'TT-10'),
ex0 AS (SELECT r.*, p20.v_num AS n20, p20.dieu AS d20, p20.trich AS t20, p10.v_str AS s10, r.v_num IS NULL AND r.v_str IS NULL AS none FROM raw r LEFT JOIN p20 ON p20.doc_id = r.doc_id LEFT JOIN p10 ON p10.doc_id = r.doc_id),
ex AS MATERIALIZED (SELECT doc_id, ma, don_vi, CASE WHEN ma = 'TT-21' AND none THEN round_even(1 - n20, 4) ELSE v_num END AS v_num, CASE WHEN ma = 'TT-11' AND none AND s10 = 'Không áp dụng' THEN 'Không áp dụng' ELSE v_str END AS v_str,
   CASE WHEN ma = 'TT-21' AND none AND n20 IS NOT NULL THEN 'Suy ra = 100% - TT-20' WHEN ma = 'TT-11' AND none AND s10 = 'Không áp dụng' THEN 'Suy ra từ TT-10' WHEN none THEN 'Không tìm thấy' ELSE 'Tự động' END AS cach,
   CASE WHEN ma = 'TT-21' AND none AND n20 IS NOT NULL THEN d20 ELSE dieu END AS dieu, CASE WHEN ma = 'TT-21' AND none AND n20 IS NOT NULL THEN t20 ELSE trich END AS trich, lab, items FROM ex0)"""


def rows(w):
    return w.memo("extracted", lambda: extract.extract_params(w.contract_text))


@query("SRC-02_paragraphs", """SELECT doc_id, CAST(pos AS BIGINT) AS pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM (SELECT doc_id, unnest(range(0, len(parts))) AS pos, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d) t WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""")
def _(w):
    return extract.split_paragraphs(w.documents)


@query("W-07_carry_section", f"WITH {PARAS} SELECT doc_id, pos, section FROM secp")
def _(w):
    return extract.carry_section(w.contract_text).select("doc_id", "pos", "section")


@query("F-04_relevant_sections", f"""WITH {PARAS} SELECT doc_id, pos FROM secp WHERE (section = '' OR regexp_matches(section, '{X.KEEP_SECTIONS}', 'i')) AND NOT (contains(text, ' | ') AND regexp_matches(text, '{X.SIGNATURE_ROW}'))""")
def _(w):
    return extract.relevant_sections(extract.carry_section(w.contract_text)).select("doc_id", "pos")


@query("F-05_body_only", f"WITH {PARAS} SELECT doc_id, pos FROM body")
def _(w):
    return extract.body_only(w.contract_text).select("doc_id", "pos")


@query("J-23_broadcast_rules", f"WITH {HITS} SELECT ma, CAST(count(*) AS BIGINT) AS n FROM hits GROUP BY ma")
def _(w):
    """Paragraphs against all rules in one pass; the rules are expressions, so nothing is joined."""
    return extract.rule_hits(extract.body_only(extract.carry_section(w.contract_text))).groupBy("ma").agg(F.count("*").alias("n"))


@query("W-13_first_rule_hit", f"WITH {HITS} SELECT doc_id, ma, pos, v_num, v_str FROM first")
def _(w):
    h = extract.rule_hits(extract.body_only(extract.carry_section(w.contract_text)))
    return extract.first_hits(h).select("doc_id", "ma", "pos", "v_num", "v_str")


@query("W-14_list_after_heading", f"WITH {PARAS}, {LISTS} SELECT doc_id, ma, h_pos AS pos, array_to_string(items, '; ') AS items FROM lists")
def _(w):
    b = extract.body_only(extract.carry_section(w.contract_text))
    return extract.lists_after_heading(b).select("doc_id", "ma", "pos", F.array_join("items", "; ").alias("items"))


@query("E-01_extract_params", f"{ROWS} SELECT doc_id, ma, v_num, v_str, cach, dieu, trich FROM ex")
def _(w):
    return extract.extract_params(w.contract_text).select("doc_id", "ma", "v_num", "v_str", "cach", "dieu", "trich")


@query("E-02_derive_params", f"{ROWS} SELECT doc_id, ma, v_num, v_str, cach FROM ex WHERE starts_with(cach, 'Suy ra')")
def _(w):
    return rows(w).filter(F.col("cach").startswith("Suy ra")).select("doc_id", "ma", "v_num", "v_str", "cach")


@query("E-03_party_label_check", f"{ROWS} SELECT doc_id, ma, upper(lab) AS lab FROM ex WHERE v_str IS NOT NULL AND (ma = 'TC-06' AND NOT contains(upper(lab), 'BÊN A') OR ma = 'TC-07' AND NOT contains(upper(lab), 'BÊN B'))")
def _(w):
    return extract.party_label_check(rows(w))


@query("E-04_consistency_checks", f"""{ROWS}, df AS (SELECT doc_id, regexp_extract(text, '“Bên giao thầu”\\s*\\(viết tắt là Bên A\\)\\s*là\\s*(.+?)\\s+(như|được nêu)', 1) AS named FROM contract_text)
  SELECT df.doc_id, 'TC-06' AS ma, 'party' AS kind, named AS detail FROM df JOIN ex ON ex.doc_id = df.doc_id AND ex.ma = 'TC-06' AND ex.v_str IS NOT NULL WHERE named <> '' AND {sql_fold('named')} <> {sql_fold('ex.v_str')}
  UNION ALL SELECT doc_id, 'TC-08', 'number', '03 (bốn)' FROM contract_text WHERE contains(text, '03 (bốn)')
  UNION ALL SELECT doc_id, 'TT-56', 'contradiction', '' FROM contract_text GROUP BY doc_id HAVING bool_or(regexp_matches(text, 'có xác nhận của (đại diện )?Bên B', 'i')) AND bool_or(regexp_matches(text, 'không cần (việc )?xác nhận (từ|của) Bên B', 'i'))""")
def _(w):
    return extract.consistency_checks(w.contract_text, rows(w))


AI = """ai AS (SELECT doc_id, ma, json_extract_string(j, '$.gia_tri') AS ai, json_extract_string(j, '$.don_vi') AS ai_unit, json_extract_string(j, '$.dieu_khoan') AS dieu_ai, json_extract_string(j, '$.trich_dan') AS trich_ai, json_extract_string(j, '$.ghi_chu') AS ghi_chu_ai
  FROM (SELECT doc_id, unnest(json_keys(b)) AS ma, b, json_extract(b, '$."' || unnest(json_keys(b)) || '"') AS j FROM (SELECT doc_id, CAST(regexp_extract(raw, '(?s)(\\{.*\\})', 1) AS JSON) AS b FROM ai_raw) t) u)"""


@query("SRC-06_ai_json", f"WITH {AI} SELECT doc_id, ma, ai AS gia_tri, ai_unit AS don_vi, dieu_ai AS dieu_khoan, trich_ai AS trich_dan, ghi_chu_ai AS ghi_chu FROM ai")
def _(w):
    return extract.parse_answers(w.ai_raw)


MASK_SQL = f"""regexp_replace(regexp_replace(regexp_replace(CASE WHEN length(pa) > 5 THEN replace(t1, pa, '[BEN_A]') ELSE t1 END, '(Ông|Bà|Ông/Bà)\\s*:?\\s*(([A-ZĐ][0-9A-Za-z_À-ỹ]*)(\\s+[A-ZĐ][0-9A-Za-z_À-ỹ]*){{1,4}})', '\\1 [CA_NHAN]', 'g'), '\\b\\d{{9,}}\\b', '[SO]', 'g'), '\\b0\\d{{2,3}}[ .]?\\d{{3,4}}[ .]?\\d{{3,4}}\\b', '[SO]', 'g')"""
MASKED = f"""pt AS (SELECT doc_id, max(v_str) FILTER (ma = 'TC-06') AS pa, max(v_str) FILTER (ma = 'TC-07') AS pb FROM ex GROUP BY doc_id),
mk AS (SELECT doc_id, text, {MASK_SQL.replace('t1', "CASE WHEN length(pb) > 5 THEN replace(text, pb, '[BEN_B]') ELSE text END")} AS masked FROM contract_docs JOIN pt USING (doc_id))"""
CMP = f"""{ROWS}, {AI}, {MASKED},
cm0 AS (SELECT ex.*, ai.ai, coalesce(ai.dieu_ai, '') AS dieu_ai, coalesce(ai.trich_ai, '') AS trich_ai, coalesce(ai.ghi_chu_ai, '') AS ghi_chu_ai, {sql_fold('mk.text')} || chr(10) || {sql_fold('mk.masked')} AS folded, CASE WHEN upper(trim(ai.ai)) <> 'KHÔNG TÌM THẤY' THEN ai.ai END AS av
  FROM ex LEFT JOIN ai ON ai.doc_id = ex.doc_id AND ai.ma = ex.ma LEFT JOIN mk ON mk.doc_id = ex.doc_id),
cm1 AS (SELECT *, coalesce(round(v_num, 6), {canon_n('v_str')}) AS n1, {canon_n('av')} AS n2 FROM cm0),
cm2 AS (SELECT *, regexp_split_to_array({sql_fold('trich_ai')}, '\\s+') AS qw, CASE WHEN n1 IS NULL AND v_str IS NOT NULL THEN {sql_fold('v_str')} END AS s1, CASE WHEN n2 IS NULL AND av IS NOT NULL THEN {sql_fold('av')} END AS s2 FROM cm1),
cmp AS (SELECT *, CASE WHEN n1 IS NULL AND s1 IS NULL AND n2 IS NULL AND s2 IS NULL THEN 'Cả hai không thấy' WHEN n2 IS NULL AND s2 IS NULL THEN 'Chỉ quy tắc thấy' WHEN n1 IS NULL AND s1 IS NULL THEN 'Chỉ AI thấy'
   WHEN n1 IS NOT NULL AND n2 IS NOT NULL THEN CASE WHEN abs(n1 - n2) <= greatest(1e-6, abs(n1) * 1e-9) THEN 'Khớp' ELSE 'Lệch' END
   WHEN contains(coalesce(s2, CAST(n2 AS VARCHAR)), coalesce(s1, CAST(n1 AS VARCHAR))) OR contains(coalesce(s1, CAST(n1 AS VARCHAR)), coalesce(s2, CAST(n2 AS VARCHAR))) THEN 'Khớp' ELSE 'Khác cách ghi' END AS khop,
   CASE WHEN {sql_fold('trich_ai')} = '' THEN '' WHEN contains(folded, {sql_fold('trich_ai')}) THEN 'Có' WHEN 2 * len(list_filter(list_transform(range(0, (len(qw) - 1) // 6 + 1), lambda k: array_to_string(list_slice(qw, k * 6 + 1, k * 6 + 6), ' ')), lambda r: contains(folded, r))) >= (len(qw) - 1) // 6 + 1 THEN 'Gần đúng' ELSE 'KHÔNG - AI viết lại hoặc bịa' END AS that FROM cm2)"""


def compared(w):
    def make():
        r = rows(w)
        full = extract.folded_documents(w.contract_docs, extract.parties_of(r))
        return extract.compare_extractors(r, extract.parse_answers(w.ai_raw), full)
    return w.memo("compared", make)


@query("J-11_compare_extractors", f"{CMP} SELECT doc_id, ma, ai, khop, that FROM cmp")
def _(w):
    r = rows(w)
    full = extract.folded_documents(w.contract_docs, extract.parties_of(r))
    return extract.compare_extractors(r, extract.parse_answers(w.ai_raw), full).select("doc_id", "ma", "ai", "khop", "that")


@query("E-06_compare", f"{CMP} SELECT khop, CAST(count(*) AS BIGINT) AS n FROM cmp GROUP BY khop")
def _(w):
    return compared(w).groupBy("khop").agg(F.count("*").alias("n"))


@query("SNK-05_compare_counts", f"{CMP} SELECT CASE WHEN that = '' THEN '(không có trích dẫn)' ELSE that END AS that, CAST(count(*) AS BIGINT) AS n FROM cmp GROUP BY 1")
def _(w):
    return compared(w).groupBy(F.when(F.col("that") == "", "(không có trích dẫn)").otherwise(F.col("that")).alias("that")).agg(F.count("*").alias("n"))


@query("E-07_verify_quote", f"{CMP} SELECT doc_id, ma, that FROM cmp WHERE trich_ai <> ''")
def _(w):
    a = extract.parse_answers(w.ai_raw).filter("trich_dan <> ''").select("doc_id", "ma", "trich_dan")
    full = extract.folded_documents(w.contract_docs, extract.parties_of(rows(w)))
    codes = rows(w).select("doc_id", "ma")
    return a.hint("merge").join(codes, ["doc_id", "ma"]).join(full.hint("merge"), "doc_id").select("doc_id", "ma", extract.verify_quote(F.col("trich_dan"), F.col("folded")).alias("that"))


@query("X-13_mask_pii", f"{ROWS}, {MASKED} SELECT doc_id, masked FROM mk")
def _(w):
    p = extract.parties_of(rows(w))
    return w.contract_docs.hint("merge").join(p, "doc_id").select("doc_id", T.mask_pii(F.col("text"), F.col("party_a"), F.col("party_b")).alias("masked"))


@query("E-05_fill_from_ai", f"{ROWS}, {AI} SELECT ex.doc_id, ex.ma, ex.v_num, CASE WHEN ex.v_num IS NULL AND ex.v_str IS NULL AND ai.ai NOT IN ('', 'null', 'KHÔNG TÌM THẤY') THEN ai.ai ELSE ex.v_str END AS v_str, CASE WHEN ex.v_num IS NULL AND ex.v_str IS NULL AND ai.ai NOT IN ('', 'null', 'KHÔNG TÌM THẤY') THEN 'Local AI' ELSE cach END AS cach FROM ex LEFT JOIN ai ON ai.doc_id = ex.doc_id AND ai.ma = ex.ma")
def _(w):
    return extract.fill_from_ai(rows(w), extract.parse_answers(w.ai_raw)).select("doc_id", "ma", "v_num", "v_str", "cach")


STATE = """mg0 AS (SELECT *, CASE WHEN khop = 'Khác cách ghi' AND (v_num IS NOT NULL OR v_str IS NOT NULL) AND regexp_matches(coalesce(ai, ''), '\\[(BEN_A|BEN_B|CA_NHAN|SO)\\]') THEN 'Khớp' ELSE khop END AS k FROM cmp),
mg AS (SELECT *, CASE WHEN k = 'Chỉ AI thấy' AND starts_with(that, 'KHÔNG') THEN 'AI bịa trích dẫn' WHEN k = 'Cả hai không thấy' THEN 'Không tìm thấy' ELSE k END AS tinh_trang, k = 'Chỉ AI thấy' AND NOT starts_with(that, 'KHÔNG') AS take FROM mg0)"""


def merged(w):
    return w.memo("merged", lambda: extract.merge_sources(compared(w)))


@query("E-08_merge_sources", f"{CMP}, {STATE} SELECT doc_id, ma, tinh_trang, CASE WHEN take THEN NULL ELSE v_num END AS v_rule, CASE WHEN k = 'Khớp' THEN cach || ' + AI khớp' WHEN take THEN 'Local AI (quy tắc không thấy)' ELSE cach END AS cach FROM mg")
def _(w):
    m = extract.merge_sources(compared(w))
    take = F.col("cach") == "Local AI (quy tắc không thấy)"
    return m.select("doc_id", "ma", "tinh_trang", F.when(~take, F.col("v_num")).alias("v_rule"), "cach")


@query("T-04_to_confirm", f"{CMP}, {STATE} SELECT doc_id, ma, tinh_trang FROM mg WHERE tinh_trang IN ('Lệch', 'AI bịa trích dẫn', 'Chỉ AI thấy', 'Khác cách ghi') OR (tinh_trang = 'Không tìm thấy' AND ma IN ('TT-01', 'TT-02', 'TT-03', 'TT-04', 'TT-10', 'TT-20', 'TT-21'))")
def _(w):
    return extract.to_confirm(merged(w)).select("doc_id", "ma", "tinh_trang")


@query("SNK-04_extraction_summary", f"""{CMP}, {STATE} SELECT doc_id, CAST(count(*) FILTER (tinh_trang IN ('Lệch', 'AI bịa trích dẫn', 'Chỉ AI thấy', 'Khác cách ghi', 'Không tìm thấy')) AS BIGINT) AS can_xem, max(v_str) FILTER (ma = 'TC-01') AS tc01, max(v_num) FILTER (ma = 'TT-02') AS tt02 FROM mg GROUP BY doc_id""")
def _(w):
    need = F.col("tinh_trang").isin(X.REVIEW_STATES)
    return merged(w).groupBy("doc_id").agg(F.count(F.when(need, 1)).alias("can_xem"), F.max(F.when(F.col("ma") == "TC-01", F.col("v_str"))).alias("tc01"),
                                           F.max(F.when(F.col("ma") == "TT-02", F.col("v_num"))).alias("tt02"))


@query("F-08_required_missing", f"""{ROWS}, ms AS (SELECT doc_id, list(ma ORDER BY ma) FILTER (v_num IS NULL AND v_str IS NULL AND ma IN ('TT-01', 'TT-02', 'TT-03', 'TT-04', 'TT-10', 'TT-20', 'TT-21')) AS m FROM ex GROUP BY doc_id)
  SELECT doc_id, coalesce(array_to_string(CASE WHEN list_contains(m, 'TT-20') <> list_contains(m, 'TT-21') THEN list_filter(m, lambda x: x NOT IN ('TT-20', 'TT-21')) ELSE m END, ','), '') AS thieu FROM ms""")
def _(w):
    return extract.missing_mandatory(rows(w)).select("doc_id", F.array_join("thieu", ",").alias("thieu"))


@query("E-15_required_documents", f"{ROWS} SELECT doc_id, CASE ma WHEN 'TT-60' THEN 'Mỗi đợt' ELSE 'Quyết toán' END AS loai, unnest(items) AS tai_lieu FROM ex WHERE items IS NOT NULL")
def _(w):
    return extract.required_documents(rows(w)).select("doc_id", "loai", "tai_lieu")


GOLD = f"""gold AS (SELECT doc_id, ma, CASE WHEN don_vi = '%' THEN '%' ELSE '' END AS g_unit, CASE WHEN ma = 'TT-20' THEN '80,5% và 3%' WHEN ma IN ('TT-32', 'TT-22') THEN '12 tháng' WHEN ma = 'TC-07' THEN 'Tổng công ty xây dựng và thương mại' ELSE 'Nội dung khác' END AS g FROM ex WHERE ma IN ('TT-20', 'TT-32', 'TT-22', 'TC-07', 'TC-03')),
res AS (SELECT g.*, coalesce(CASE WHEN g_unit = '%' THEN replace(CAST(round(e.v_num * 100, 4) AS VARCHAR), '.0', '') || '%' WHEN e.v_num IS NOT NULL THEN CAST(CAST(e.v_num AS BIGINT) AS VARCHAR) END, e.v_str) AS v, e.trich FROM gold g JOIN ex e ON e.doc_id = g.doc_id AND e.ma = g.ma)"""


def graded(w):
    r = rows(w)
    unit = F.when(F.col("don_vi") == "%", "%").otherwise("")
    g = r.filter(F.col("ma").isin("TT-20", "TT-32", "TT-22", "TC-07", "TC-03")).select(
        "doc_id", "ma", unit.alias("don_vi"), F.when(F.col("ma") == "TT-20", "80,5% và 3%").when(F.col("ma").isin("TT-32", "TT-22"), "12 tháng")
        .when(F.col("ma") == "TC-07", "Tổng công ty xây dựng và thương mại").otherwise("Nội dung khác").alias("gia_tri"))
    pct = F.concat(F.regexp_replace(F.round(F.col("v_num") * 100, 4).cast("string"), r"\.0$", ""), F.lit("%"))
    res = r.select("doc_id", "ma", "trich", F.coalesce(F.when(unit == "%", pct).when(F.col("v_num").isNotNull(), F.col("v_num").cast("bigint").cast("string")), F.col("v_str")).alias("gia_tri"))
    return extract.score_vs_gold(res, g)


SCORED = f"""{ROWS}, {GOLD}, sc AS (SELECT *, CASE WHEN v IS NULL OR v = '' THEN 'Sai'
   WHEN ma = 'TT-20' THEN CASE WHEN abs({canon_n('v')} - 0.805) < 1e-9 OR abs({canon_n('v')} * 100 - 0.805 * 100) < 1e-9 THEN 'Một phần' ELSE 'Sai' END
   WHEN ma IN ('TT-32', 'TT-22') THEN CASE WHEN abs({canon_n('v')} - 12) < 1e-9 OR abs({canon_n('v')} * 100 - 12) < 1e-9 THEN 'Đúng' ELSE 'Sai' END
   ELSE CASE WHEN r >= 0.8 THEN 'Đúng' WHEN r >= 0.4 THEN 'Một phần' ELSE 'Sai' END END AS cham
   FROM (SELECT *, len(list_intersect(gw, kw)) / len(gw) AS r FROM (SELECT *, list_distinct(list_filter(regexp_extract_all({sql_fold('g')}, '[a-z0-9]+'), lambda x: x NOT IN ('va', 'cua', 'cac', 'the', 'theo', 'la', 'tu', 'ngay', 'ben'))) AS gw,
     list_distinct(regexp_extract_all({sql_fold("v || ' ' || trich")}, '[a-z0-9]+')) AS kw FROM res) a) b)"""


@query("E-09_score_vs_gold", f"{SCORED} SELECT doc_id, ma, cham FROM sc")
def _(w):
    return graded(w).select("doc_id", "ma", "cham")


@query("A-19_score_summary", f"{SCORED} SELECT ma, CAST(count(*) FILTER (cham = 'Đúng') AS BIGINT) AS dung, CAST(count(*) FILTER (cham = 'Một phần') AS BIGINT) AS mot_phan, CAST(count(*) FILTER (cham = 'Sai') AS BIGINT) AS sai, (count(*) FILTER (cham = 'Đúng') + 0.5::DOUBLE * count(*) FILTER (cham = 'Một phần')) / count(*) AS diem FROM sc GROUP BY ma")
def _(w):
    return extract.score_summary(graded(w), ["ma"])


@query("U-04_token_overlap", f"""SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all({sql_fold('text')}, '[a-z0-9]+'), lambda x: x IN ('the', 'and', 'der', 'les')))) AS BIGINT) AS n_shared, CAST(len(list_distinct(list_filter(regexp_extract_all({sql_fold('text')}, '[a-z0-9]+'), lambda x: x NOT IN ('the', 'and', 'der', 'les', 'of')))) AS BIGINT) AS n_only FROM documents""")
def _(w):
    s, o = extract.token_overlap(F.col("text"), F.lit("the and der les"), ["of"])
    return w.documents.select("doc_id", F.size(s).cast("bigint").alias("n_shared"), F.size(o).cast("bigint").alias("n_only"))


@query("E-13_params_by_group", "SELECT doc_id, nhom, CAST(n AS BIGINT) AS n_codes FROM (SELECT DISTINCT doc_id FROM contract_docs) CROSS JOIN (VALUES " + ", ".join(
    f"('{g}', {sum(1 for p in X.PARAMETERS if p[1] == g)})" for g in dict.fromkeys(p[1] for p in X.PARAMETERS)) + ") g(nhom, n)")
def _(w):
    return extract.request_plan(w.contract_docs).select("doc_id", "nhom", F.size("codes").cast("bigint").alias("n_codes"))


KEY = "substr(sha1(text), 1, 16) || '_qwen3_8b_ad_rg'"


@query("X-28_content_key", f"SELECT doc_id, {KEY} AS key FROM documents")
def _(w):
    return w.documents.select("doc_id", T.content_key(F.col("text"), F.lit("qwen3:8b"), F.lit(True), F.lit(False)).alias("key"))


@query("E-14_resume_missing", f"SELECT doc_id FROM documents WHERE {KEY} NOT IN (SELECT {KEY} FROM documents WHERE doc_id % 3 = 0)")
def _(w):
    k = T.content_key(F.col("text"), F.lit("qwen3:8b"), F.lit(True), F.lit(False))
    done = w.documents.filter("doc_id % 3 = 0").select(k.alias("key"))
    return extract.resume_missing(w.documents, done, F.lit("qwen3:8b"), F.lit(True), F.lit(False)).select("doc_id")


@query("X-27_est_tokens", "SELECT doc_id, CAST(floor(length(text) / 3) AS BIGINT) AS tok, CAST(CASE WHEN floor(length(text) / 3) + 3000 <= 32768 THEN 32768 WHEN floor(length(text) / 3) + 3000 <= 49152 THEN 49152 ELSE 65536 END AS BIGINT) AS win FROM documents")
def _(w):
    return w.documents.select("doc_id", T.est_tokens(F.col("text")).cast("bigint").alias("tok"), T.window_class(F.col("text")).cast("bigint").alias("win"))


@query("A-21_token_usage", "SELECT conv_id AS doc_id, CAST(sum(length(text)) FILTER (role = 'user') AS BIGINT) AS token_vao, CAST(sum(length(text)) FILTER (role <> 'user') AS BIGINT) AS token_ra, round(sum(turn * 0.5::DOUBLE), 1) AS giay FROM conversations GROUP BY conv_id")
def _(w):
    u = F.col("role") == "user"
    return extract.token_usage(w.conversations.select(F.col("conv_id").alias("doc_id"), F.when(u, F.length("text")).alias("token_vao"),
                                                      F.when(~u, F.length("text")).alias("token_ra"), (F.col("turn") * 0.5).alias("giay")))
