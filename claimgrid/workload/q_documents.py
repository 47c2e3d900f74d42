"""Document completeness and retrieval over the prose documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrid.functions import numbers as N
from claimgrid.functions import text as T
from claimgrid.operators import documents
from claimgrid.operators.scan import top_per
from claimgrid.workload.q_reconcile import sql_fold
from claimgrid.workload.registry import query
from claimgrid.workload.world import CHECKLIST

WORDS = [(c, k.split("|")) for c, _g, _b, _p, k in CHECKLIST]
NAME = "CASE WHEN doc_id % 10 = 0 THEN 'B0' || CAST(doc_id % 4 AS STRING) || '_bang' ELSE source || '_' || lang || '_' || CAST(doc_id AS STRING) END || '.txt'"


def docs(w):
    return w.documents.select(F.col("doc_id").cast("string").alias("file"), F.expr(NAME).alias("name"), "text")


def _score(words):
    return " + ".join(f"CASE WHEN contains(fn, '{x}') THEN 3.0 ELSE 0.0 END + CASE WHEN contains(fh, '{x}') THEN 2.0 WHEN contains(fb, '{x}') THEN 1.0 ELSE 0.0 END" for x in words)


SC = f"""d AS (SELECT CAST(doc_id AS VARCHAR) AS file, {NAME} AS name, text FROM documents),
dn AS (SELECT *, upper(regexp_extract(name, '^\\s*([A-Fa-f]\\d{{2}})[\\s_\\-.]', 1)) AS nc FROM d),
f AS (SELECT file, nc, replace({sql_fold("regexp_replace(name, '\\.[^.]*$', '')")}, '_', ' ') AS fn, {sql_fold('substr(text, 1, 2000)')} AS fh, {sql_fold('substr(text, 2001)')} AS fb FROM dn),
sc AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT file, nc, '{c}' AS ma, {i} AS o, CAST({_score(ws)} AS DOUBLE) AS diem FROM f" for i, (c, ws) in enumerate(WORDS))}) t WHERE diem > 0),
codes AS (SELECT ma AS c FROM checklist),
cls AS (SELECT file, nc AS ma, 100.0::DOUBLE AS diem, 'mã trong tên file' AS cach, 1 AS rank FROM f WHERE nc IN (SELECT c FROM codes)
  UNION ALL SELECT file, ma, diem, 'từ khoá', rk FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY diem DESC, o) AS rk FROM sc WHERE nc NOT IN (SELECT c FROM codes)) t WHERE rk <= 3)"""


@query("E-10_classify_document", f"WITH {SC} SELECT file, ma, diem, cach, CAST(rank AS BIGINT) AS rank FROM cls")
def _(w):
    return documents.classify(docs(w), WORDS).withColumn("rank", F.col("rank").cast("bigint"))


@query("T-01_top_classes", f"WITH {SC} SELECT file, ma, CAST(rk AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY diem DESC, o) AS rk FROM sc) t WHERE rk <= 3")
def _(w):
    t = top_per(documents.keyword_scores(docs(w), WORDS), ["file"], [F.desc("diem"), "thu_tu"], 3)
    return t.select("file", "ma", F.col("rank").cast("bigint").alias("rank"))


ASG = f"""{SC}, x AS (SELECT CAST(doc_id AS VARCHAR) AS file, 'C02' AS ma FROM labels WHERE quality = 0), m AS (SELECT CAST(doc_id AS VARCHAR) AS file, 'D01' AS ma FROM labels WHERE toxic = 1),
asg AS (SELECT d.file, coalesce(m.ma, CASE WHEN coalesce(c.diem, 0) < 4 AND x.ma IS NOT NULL THEN x.ma END, c.ma, '') AS ma, coalesce(c.diem, 0.0) AS diem,
  CASE WHEN m.ma IS NOT NULL THEN 'người dùng chọn' WHEN coalesce(c.diem, 0) < 4 AND x.ma IS NOT NULL THEN 'local AI' WHEN c.ma IS NULL THEN 'không khớp' ELSE c.cach END AS cach, m.ma IS NOT NULL AS xac_nhan
  FROM d LEFT JOIN cls c ON c.file = d.file AND c.rank = 1 LEFT JOIN x ON x.file = d.file LEFT JOIN m ON m.file = d.file)"""


def index(w):
    lab = w.labels.select(F.col("doc_id").cast("string").alias("file"), "quality", "toxic")
    return documents.assign_code(docs(w), documents.classify(docs(w), WORDS), lab.filter("quality = 0").select("file", F.lit("C02").alias("ma")),
                                 lab.filter("toxic = 1").select("file", F.lit("D01").alias("ma")))


@query("E-11_assign_code", f"WITH {ASG} SELECT * FROM asg")
def _(w):
    return index(w)


ST = f"""{ASG}, gg AS (SELECT ma, count(*) AS so_file, bool_or(xac_nhan OR diem >= 4) AS sure FROM asg GROUP BY ma),
sts AS (SELECT k.*, coalesce(gg.so_file, 0) AS so_file, CASE WHEN gg.ma IS NULL THEN CASE WHEN bat_buoc THEN 'Thiếu' ELSE 'Chưa có (không bắt buộc)' END WHEN sure THEN 'Đã có' ELSE 'Cần xác nhận' END AS tinh_trang FROM checklist k LEFT JOIN gg ON gg.ma = k.ma)"""


@query("J-18_checklist_status", f"WITH {ST} SELECT ma, nhom, bat_buoc, tinh_trang, CAST(so_file AS BIGINT) AS so_file FROM sts")
def _(w):
    return documents.checklist_status(w.checklist, index(w)).select("ma", "nhom", "bat_buoc", "tinh_trang", F.col("so_file").cast("bigint").alias("so_file"))


@query("A-18_status_counts", f"WITH {ST} SELECT tinh_trang, CAST(count(*) AS BIGINT) AS n FROM sts GROUP BY tinh_trang")
def _(w):
    return documents.status_counts(documents.checklist_status(w.checklist, index(w)))


@query("A-18_required_ratio", f"WITH {ST} SELECT CAST(count(*) FILTER (bat_buoc AND tinh_trang = 'Đã có') AS BIGINT) AS co, CAST(count(*) FILTER (bat_buoc) AS BIGINT) AS can FROM sts")
def _(w):
    return documents.required_ratio(documents.checklist_status(w.checklist, index(w)))


@query("F-11_status_view", f"WITH {ST} SELECT ma, tinh_trang FROM sts WHERE nhom IN ('B. Design', 'E. Payment') AND tinh_trang IN ('Thiếu', 'Cần xác nhận')")
def _(w):
    st = documents.checklist_status(w.checklist, index(w))
    return documents.status_view(st, ["B. Design", "E. Payment"], True).select("ma", "tinh_trang")


@query("SNK-06_request_list_md", f"WITH {ST} SELECT CAST(uu_tien AS BIGINT) AS uu_tien, ma, '| ' || ma || ' | ' || nhom || ' | ' || tinh_trang || ' | ' || uu_tien || ' |' AS line FROM sts WHERE tinh_trang IN ('Thiếu', 'Cần xác nhận')")
def _(w):
    return documents.request_lines(documents.checklist_status(w.checklist, index(w))).withColumn("uu_tien", F.col("uu_tien").cast("bigint"))


Q = """q AS (SELECT conv_id * 100 + turn AS query_id, CASE turn % 4 WHEN 0 THEN 'Còn thiếu tài liệu nhóm B? ' WHEN 1 THEN 'Mục A01 thế nào: ' WHEN 2 THEN 'Mục Z99: ' ELSE '' END || text AS question FROM conversations)"""


@query("F-10_intent_route", f"""WITH {Q}, fq AS (SELECT query_id, {sql_fold('question')} AS f FROM q), z AS (SELECT query_id, f, regexp_matches(f, 'thieu|chua co|con thieu|can bo sung|request|yeu cau') AS miss, upper(regexp_extract(f, '\\b([a-f]\\d{{2}})\\b', 1)) AS code FROM fq)
  SELECT query_id, CASE WHEN miss THEN 'missing' WHEN code IN (SELECT ma FROM checklist) THEN 'code' ELSE 'content' END AS route, CASE WHEN miss THEN upper(regexp_extract(f, '\\b(nhom|muc)\\s+([a-f])\\b', 2)) WHEN code IN (SELECT ma FROM checklist) THEN code ELSE '' END AS arg FROM z""")
def _(w):
    t = F.col("turn") % 4
    q = w.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.concat(
        F.when(t == 0, "Còn thiếu tài liệu nhóm B? ").when(t == 1, "Mục A01 thế nào: ").when(t == 2, "Mục Z99: ").otherwise(""), F.col("text")).alias("question"))
    return documents.route_question(q, [c for c, _ in WORDS]).select("query_id", "route", "arg")


CHUNKS = """ch AS (SELECT file, CAST(j AS BIGINT) AS j, substr(text, CAST(j * 750 + 1 AS BIGINT), 900) AS passage FROM (SELECT CAST(doc_id AS VARCHAR) AS file, text, unnest(range(0, CAST(ceil(length(text) / 750.0) AS BIGINT))) AS j FROM documents WHERE length(text) > 0) t)"""
TOKENS = f"""tk AS (SELECT file, j, regexp_extract_all({sql_fold('passage')}, '[a-z0-9]+') AS ts FROM ch)"""


@query("X-25_chunk_text", f"WITH {CHUNKS} SELECT file, j, CAST(length(passage) AS BIGINT) AS n FROM ch")
def _(w):
    return documents.chunk(docs(w)).select("file", "j", F.length("passage").cast("bigint").alias("n"))


@query("X-26_tokenize", f"WITH {CHUNKS}, {TOKENS} SELECT file, j, CAST(len(ts) AS BIGINT) AS n, ts[1] AS first, ts[-1] AS last FROM tk")
def _(w):
    t = documents.chunk(docs(w)).withColumn("ts", T.tokens(F.col("passage")))
    return t.select("file", "j", F.size("ts").cast("bigint").alias("n"), F.try_element_at("ts", F.lit(1)).alias("first"), F.try_element_at("ts", F.lit(-1)).alias("last"))


BM = f"""WITH {CHUNKS}, {TOKENS}, na AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM tk),
tf AS (SELECT file, j, len(ts) AS len, term, count(*) AS tf FROM (SELECT file, j, ts, unnest(ts) AS term FROM tk) t GROUP BY file, j, len(ts), term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT item_id AS query_id, term, count(*) AS qn FROM (SELECT item_id, unnest(regexp_extract_all({sql_fold('text')}, '[a-z0-9]+')) AS term FROM benchmark) t GROUP BY ALL),
sc AS (SELECT query_id, file, j, round(sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM qt JOIN df USING (term) JOIN tf USING (term) CROSS JOIN na GROUP BY query_id, file, j)
"""


@query("E-12_bm25_search", BM + "SELECT query_id, file, j, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file, j) AS rank FROM sc WHERE score > 0) t WHERE rank <= 5")
def _(w):
    q = w.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return documents.bm25(docs(w), q).select("query_id", "file", "j", "score", F.col("rank").cast("bigint").alias("rank"))


@query("T-02_top_passages", BM + "SELECT query_id, file, j, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file, j) AS rank FROM sc WHERE score > 0) t WHERE rank <= 3")
def _(w):
    q = w.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return documents.bm25(docs(w), q, 3).select("query_id", "file", "j", F.col("rank").cast("bigint").alias("rank"))


# --- scalar functions over whole tables ------------------------------------------------------------------------
@query("X-01_fold", f"SELECT doc_id, md5({sql_fold('text')}) AS h, CAST(length({sql_fold('text')}) AS BIGINT) AS n FROM documents")
def _(w):
    f = T.fold(F.col("text"))
    return w.documents.select("doc_id", F.md5(f).alias("h"), F.length(f).cast("bigint").alias("n"))


@query("X-02_norm", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h FROM documents")
def _(w):
    return w.documents.select("doc_id", F.md5(T.norm(F.col("text"))).alias("h"))


TXT = """t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE l_partkey % 8 WHEN 0 THEN CAST(l_orderkey % 1000 AS STRING) || '.' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') WHEN 1 THEN '0,' || CAST(l_partkey % 90 + 10 AS STRING)
  WHEN 2 THEN '(' || CAST(l_orderkey % 900 + 1 AS STRING) || ',' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') || ',000)' WHEN 3 THEN CAST(l_partkey % 100 AS STRING) || ' %' WHEN 4 THEN '-' || CAST(l_partkey AS STRING) WHEN 5 THEN CAST(l_suppkey AS STRING) || 'x'
  WHEN 6 THEN CAST(l_linenumber AS STRING) ELSE '' END AS s FROM {lineitem})"""


def texts(w):
    return w.spark.sql("WITH " + TXT.replace("{lineitem}", f"parquet.`{w.path}/lineitem.parquet`") + " SELECT * FROM t")


OT = "WITH " + TXT.replace("{lineitem}", "lineitem")


def per_text(name, sql_expr, fn):
    @query(name, f"{OT}, u AS (SELECT DISTINCT s FROM t) SELECT s, {sql_expr} AS v FROM u")
    def _q(w):
        return texts(w).select("s").distinct().select("s", fn(F.col("s")).alias("v"))


_VN = "CASE WHEN regexp_full_match(s, '\\d{1,3}(\\.\\d{3})+') THEN try_cast(replace(s, '.', '') AS DOUBLE) WHEN contains(s, ',') THEN try_cast(replace(replace(s, '.', ''), ',', '.') AS DOUBLE) ELSE try_cast(nullif(s, '') AS DOUBLE) END"
_T = "trim(replace(s, ' ', ''), '-()')"
_MN = f"CASE WHEN regexp_full_match({_T}, '\\d{{1,3}}([.,]\\d{{3}})+') THEN try_cast(regexp_replace({_T}, '[.,]', '', 'g') AS DOUBLE) ELSE try_cast(nullif(replace({_T}, ',', ''), '') AS DOUBLE) END"
_RT = "CASE WHEN regexp_matches(replace(s, ',', '.'), '[\\d.]+\\s*%') THEN try_cast(regexp_extract(replace(s, ',', '.'), '([\\d.]+)\\s*%', 1) AS DOUBLE) / 100 ELSE CASE WHEN try_cast(nullif(replace(s, ',', '.'), '') AS DOUBLE) > 1 THEN try_cast(nullif(replace(s, ',', '.'), '') AS DOUBLE) / 100 ELSE try_cast(nullif(replace(s, ',', '.'), '') AS DOUBLE) END END"
per_text("X-03_num", "try_cast(nullif(replace(s, ',', ''), '') AS DOUBLE)", N.num)
per_text("X-04_parse_vn_number", _VN, N.vn_number)
per_text("X-05_parse_money", f"CASE WHEN starts_with(s, '-') OR (starts_with(s, '(') AND ends_with(s, ')')) THEN -({_MN}) ELSE {_MN} END", N.money)
per_text("X-06_parse_rate", _RT, N.rate)


@query("X-07_parse_date", """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 31 + 1 AS VARCHAR) || '/' || CAST(o_orderkey % 12 + 1 AS VARCHAR) || '/2024' WHEN 1 THEN lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') || '.02-2023'
   WHEN 2 THEN '2022-' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '-10 08:00' ELSE 'n/a' END AS s FROM orders)
  SELECT o_orderkey, s, coalesce(try_strptime(replace(replace(s, '.', '/'), '-', '/'), '%d/%m/%Y')::DATE, try_strptime(substr(s, 1, 10), '%Y-%m-%d')::DATE) AS d FROM d""")
def _(w):
    k = F.col("o_orderkey")
    s = (F.when(k % 4 == 0, F.concat((k % 31 + 1).cast("string"), F.lit("/"), (k % 12 + 1).cast("string"), F.lit("/2024")))
         .when(k % 4 == 1, F.concat(F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(".02-2023")))
         .when(k % 4 == 2, F.concat(F.lit("2022-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-10 08:00"))).otherwise("n/a"))
    return w.orders.select("o_orderkey", s.alias("s")).select("o_orderkey", "s", N.date_vn(F.col("s")).alias("d"))


@query("X-08_price_type", """SELECT ma_hd, CASE WHEN contains(lower(loai_gia), 'trọn gói') THEN 'trọn gói' WHEN contains(lower(loai_gia), 'điều chỉnh') THEN 'đơn giá điều chỉnh' WHEN contains(lower(loai_gia), 'cố định') THEN 'đơn giá cố định' ELSE loai_gia END AS v FROM contracts""")
def _(w):
    return w.contracts.select("ma_hd", N.price_type(F.col("loai_gia")).alias("v"))


@query("X-09_match_key", "SELECT ma_hd, ma_hm, khoa FROM boq_base")
def _(w):
    return w.boq_base.select("ma_hd", "ma_hm", T.match_key(F.col("nhom"), F.col("ten"), F.col("dvt")).alias("khoa"))


from claimgrid.workload.q_text import canon_n  # noqa: E402

per_text("X-10_canonical_value", canon_n("s"), lambda c: N.canonical_value(c)["n"])
per_text("X-11_typed_ai_value", f"CASE WHEN trim(s) = '' THEN NULL WHEN regexp_full_match(s, '-?\\d+([.,]\\d+)?\\s*%') THEN {canon_n('s')} WHEN regexp_full_match(s, '(\\d{{1,3}}([.,]\\d{{3}})+|\\d+)') THEN try_cast(regexp_replace(s, '[.,]', '', 'g') AS DOUBLE) END",
         lambda c: N.typed_ai_value(c, F.lit("đồng"))["n"])
per_text("X-12_fix_missing_percent", f"CASE WHEN regexp_full_match(s, '\\d+([.,]\\d+)?') AND ({_VN}) > 1 THEN s || '%' ELSE s END", lambda c: N.add_missing_percent(c, F.lit("%/ngày")))


@query("X-14_numbers_in_text", """SELECT doc_id, CAST(len(v) AS BIGINT) AS n, v[1] AS first FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*'), lambda t: CASE WHEN regexp_full_match(t, '\\d{1,3}(\\.\\d{3})+') THEN try_cast(replace(t, '.', '') AS DOUBLE) ELSE try_cast(replace(t, ',', '.') AS DOUBLE) END), lambda x: x IS NOT NULL) AS v FROM documents) a""")
def _(w):
    nums = N.numbers_in_text(F.col("text"), F.lit(False))
    return w.documents.select("doc_id", F.size(nums).cast("bigint").alias("n"), F.try_element_at(nums, F.lit(1)).alias("first"))


@query("X-15_format_values", """SELECT ma_hd, ma_ts, CASE WHEN ma_ts IN ('TT-04', 'TT-20', 'TT-21') THEN CASE gia_tri WHEN '0.1' THEN '10%' WHEN '0.05' THEN '5%' ELSE gia_tri END WHEN ma_ts = 'TT-02' THEN format('{:,}', CAST(gia_tri AS BIGINT)) ELSE gia_tri END AS v FROM params""")
def _(w):
    return w.params.select("ma_hd", "ma_ts", N.format_value(F.col("ma_ts"), F.col("gia_tri")).alias("v"))


@query("X-15_format_qty", "SELECT ma_hd, dong, coalesce(format('{:,}', CAST(kl_lk AS BIGINT)), '-') AS v FROM claim_items")
def _(w):
    return w.claim_items.select("ma_hd", "dong", N.format_qty(F.col("kl_lk")).alias("v"))


@query("X-29_safe_name", "SELECT page_id, CASE WHEN length(u) > 60 THEN trim(substr(u, 1, 60), ' ._') || '_' || substr(md5(u), 1, 8) ELSE trim(u, ' ._') END AS v FROM (SELECT page_id, regexp_replace(url, '[\\\\/:*?\"<>|]+', '_', 'g') AS u FROM pages) t")
def _(w):
    return w.pages.select("page_id", T.safe_name(F.col("url")).alias("v"))


@query("SRC-15_period_from_filename", "SELECT o_orderkey, CAST(o_orderkey % 20 AS BIGINT) AS dot FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 2")
def _(w):
    k = F.col("o_orderkey")
    n = (k % 20).cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("/ho so/HSTT Đợt 0"), n, F.lit(".xlsx"))).when(k % 3 == 1, F.concat(F.lit("c:\\x\\HSTT dot "), n, F.lit(" sua.xlsx"))).otherwise("bang.xlsx")
    return w.orders.select("o_orderkey", T.period_number(path).cast("bigint").alias("dot"))
