"""Cell-grid integrity queries over workbooks derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions import classify as C
from claimgrid.functions import formulas as S
from claimgrid.operators import grid, lineage
from claimgrid.operators.quality import collect_findings, order_findings
from claimgrid.session import cut_lineage
from claimgrid.workload.q_reconcile import sql_edit, sql_fold
from claimgrid.workload.registry import query

QP = "(?:''[^'']+''|(?:\\[\\d+\\])?[A-Za-z0-9]+)!\\$?[A-Z]{1,3}\\$?\\d+(?::\\$?[A-Z]{1,3}\\$?\\d+)?"
LP = "[A-Z]{1,3}\\d+(?::[A-Z]{1,3}\\d+)?"
_cells = "file, sheet, sheet_state, row, col, formula, v_num"
REFS = f"""fm AS (SELECT {_cells} FROM cells WHERE formula IS NOT NULL),
mq AS (SELECT {_cells}, unnest(regexp_extract_all(formula, '{QP}')) AS m FROM fm),
ml AS (SELECT {_cells}, unnest(regexp_extract_all(regexp_replace(formula, '{QP}', ' ', 'g'), '{LP}')) AS m FROM fm),
pr AS (SELECT {_cells}, regexp_extract(m, '^\\[(\\d+)\\]', 1) AS x, replace(regexp_replace(regexp_extract(m, '^(.*)!', 1), '^\\[\\d+\\]', ''), '''', '') AS r_sheet, regexp_extract(m, '!(.*)$', 1) AS a FROM mq
  UNION ALL SELECT {_cells}, '', sheet, m FROM ml),
refs AS (SELECT {_cells}, r_sheet, CAST(nullif(x, '') AS BIGINT) AS ext, ascii(regexp_extract(a, '^([A-Z])', 1)) - 64 AS c1, CAST(regexp_extract(a, '^[A-Z]+(\\d+)', 1) AS BIGINT) AS r1,
  CASE WHEN contains(a, ':') THEN ascii(regexp_extract(a, ':([A-Z])', 1)) - 64 ELSE ascii(regexp_extract(a, '^([A-Z])', 1)) - 64 END AS c2,
  CASE WHEN contains(a, ':') THEN CAST(regexp_extract(a, ':[A-Z]+(\\d+)', 1) AS BIGINT) ELSE CAST(regexp_extract(a, '^[A-Z]+(\\d+)', 1) AS BIGINT) END AS r2 FROM pr)"""
LABELS = """nc0 AS (SELECT file, sheet, col, count(*) AS n FROM cells WHERE length(trim(v_str)) >= 8 AND regexp_matches(v_str, '[A-Za-zÀ-ỹ]{3}') GROUP BY file, sheet, col),
ncol AS (SELECT s.file, s.sheet, coalesce(b.col, 2) AS name_col FROM (SELECT DISTINCT file, sheet FROM cells) s LEFT JOIN (SELECT file, sheet, arg_max(col, n * 100 - col) AS col FROM nc0 GROUP BY file, sheet) b ON b.file = s.file AND b.sheet = s.sheet),
lab AS (SELECT c.file, c.sheet, c.row, trim(regexp_replace(c.v_str, '\\s+', ' ', 'g')) AS label FROM cells c JOIN ncol n ON n.file = c.file AND n.sheet = c.sheet AND n.name_col = c.col WHERE c.v_str IS NOT NULL)"""
PATS = """pt AS (SELECT *, regexp_replace(regexp_replace(formula, '([A-Z])' || row || '\\b', '\\1R', 'g'), '([A-Z])' || (row + 1) || '\\b', '\\1S', 'g') AS pattern FROM cells WHERE formula IS NOT NULL AND sheet_state = 'visible' AND NOT regexp_matches(formula, '^=\\s*(SUM|SUBTOTAL|SUMIF|SUMPRODUCT)\\(', 'i')),
pc AS (SELECT file, sheet, col, pattern, count(*) AS n, min(row) AS lo, max(row) AS hi FROM pt GROUP BY ALL),
dom AS (SELECT file, sheet, col, arg_max(pattern, n * 1000000 - lo) AS pattern, max(n) AS n, arg_max(lo, n * 1000000 - lo) AS lo, arg_max(hi, n * 1000000 - lo) AS hi, sum(n) AS total, count(*) AS n_patterns FROM pc GROUP BY file, sheet, col HAVING sum(n) >= 10)"""
b = lambda *ns: [F.col(n).cast("bigint").alias(n) for n in ns]


@query("A-14_sheet_profile", """SELECT file, sheet, sheet_state, CAST(max(row) AS BIGINT) AS n_rows, CAST(max(col) AS BIGINT) AS n_cols, CAST(count(formula) AS BIGINT) AS n_formulas, CAST(count(*) FILTER (formula IS NULL AND v_num IS NOT NULL) AS BIGINT) AS n_numbers,
  CAST(count(*) FILTER (contains(formula, '#REF!')) AS BIGINT) AS n_ref_errors, CAST(count(*) FILTER (formula IS NOT NULL AND v_str IN ('#REF!', '#DIV/0!', '#VALUE!', '#N/A', '#NAME?', '#NUM!', '#NULL!')) AS BIGINT) AS n_error_values, CAST(count(*) FILTER (formula IS NOT NULL AND v_num IS NULL AND v_str IS NULL) AS BIGINT) AS n_uncached FROM cells GROUP BY file, sheet, sheet_state""")
def _(w):
    return grid.sheet_profile(w.cells).select("file", "sheet", "sheet_state", *b("n_rows", "n_cols", "n_formulas", "n_numbers", "n_ref_errors", "n_error_values", "n_uncached"))


@query("F-09_cell_predicates", """SELECT sheet, CAST(count(*) FILTER (starts_with(formula, '=')) AS BIGINT) AS n_formula, CAST(count(*) FILTER (regexp_matches(formula, '^=\\s*(SUM|SUBTOTAL|SUMIF|SUMPRODUCT)\\(', 'i')) AS BIGINT) AS n_total, CAST(count(*) FILTER (v_str IN ('#REF!', '#N/A')) AS BIGINT) AS n_error FROM cells GROUP BY sheet""")
def _(w):
    f = F.col("formula")
    return w.cells.groupBy("sheet").agg(F.count(F.when(S.is_formula(f), 1)).alias("n_formula"), F.count(F.when(S.is_total(f), 1)).alias("n_total"), F.count(F.when(S.is_error(F.col("v_str")), 1)).alias("n_error"))


@query("A-15_external_link_usage", "SELECT file, CAST(1 AS BIGINT) AS ext, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT sheet || col) AS BIGINT) AS n_cols FROM cells WHERE contains(formula, '[1]') GROUP BY file")
def _(w):
    return grid.external_usage(w.cells).select("file", *b("ext", "n", "n_cols"))


@query("A-24_name_column_guess", f"WITH {LABELS} SELECT file, sheet, CAST(name_col AS BIGINT) AS name_col FROM ncol")
def _(w):
    return grid.name_column(w.cells).select("file", "sheet", *b("name_col"))


HEADS = f"""hs AS (SELECT file, sheet, row, count(*) FILTER (regexp_matches({sql_fold('v_str')}, '{X.HEADER_WORDS}')) AS kw, count(*) AS n FROM cells WHERE length(trim(v_str)) >= 2 GROUP BY file, sheet, row),
hr AS (SELECT s.file, s.sheet, coalesce(arg_max(row, kw * 1000000 + n * 1000 - row), 1) AS h FROM (SELECT DISTINCT file, sheet FROM cells) s LEFT JOIN hs ON hs.file = s.file AND hs.sheet = s.sheet GROUP BY s.file, s.sheet),
nt AS (SELECT file, sheet, row, count(*) AS n_text FROM cells WHERE trim(v_str) <> '' GROUP BY file, sheet, row),
ht AS (SELECT c.file, c.sheet, c.col, c.row, trim(regexp_replace(v_str, '\\s+', ' ', 'g')) AS t FROM cells c JOIN hr ON hr.file = c.file AND hr.sheet = c.sheet AND c.row BETWEEN h - 3 AND h + 3 LEFT JOIN nt ON nt.file = c.file AND nt.sheet = c.sheet AND nt.row = c.row
  WHERE trim(v_str) <> '' AND (c.row = h OR coalesce(n_text, 0) >= 2) AND NOT regexp_full_match(trim(v_str), '[\\[\\(]?\\d+[\\]\\)]?')),
hd AS (SELECT file, sheet, col, string_agg(t, ' / ' ORDER BY fr) AS header FROM (SELECT file, sheet, col, t, min(row) AS fr FROM ht GROUP BY ALL) u GROUP BY file, sheet, col)"""


@query("X-32_col_header_row_label", f"WITH {HEADS} SELECT file, sheet, CAST(col AS BIGINT) AS col, header FROM hd")
def _(w):
    return grid.column_headers(w.cells).select("file", "sheet", *b("col"), "header")


@query("X-20_root_data_group", f"""WITH {HEADS}, g AS (SELECT *, {sql_fold("header || ' ' || sheet")} AS t FROM hd)
  SELECT file, sheet, CAST(col AS BIGINT) AS col, CASE WHEN contains(t, 'don gia') THEN '2 Đơn giá' WHEN regexp_matches(t || ' ', 'k[iy] truoc|dot truoc|luy ke truoc') THEN '3-4 Kỳ trước / lũy kế trước' WHEN regexp_matches(t, 'hop dong|\\bhd\\b') AND regexp_matches(t, 'khoi luong|\\bkl\\b') THEN '1 KL hợp đồng'
   WHEN regexp_matches(t || ' ', 'tam ung|da thanh toan|thanh toan dot|dot \\d|unc') THEN '7 Đã thanh toán / tạm ứng' WHEN regexp_matches(t, 'k[iy] nay|thuc hien|nghiem thu|hoan thanh') THEN '5 KL kỳ này'
   WHEN regexp_matches(t || ' ', '%|ty le|thue suat|he so|giu lai') OR (regexp_matches(t || ' ', '\\bthue\\b|vat|gtgt') AND NOT contains(t, 'gia tri')) THEN '6 Tham số HĐ' WHEN regexp_matches(t || ' ', 'gia tri hop dong|gia tri hd') THEN '1-2 Giá trị HĐ'
   WHEN regexp_matches(t, 'khoi luong|\\bkl\\b|dien giai|kich thuoc|dai|rong|cao|so luong') THEN '5 KL / diễn giải' ELSE 'Ngoài 7 nhóm - cần giải thích' END AS nhom FROM g""")
def _(w):
    return grid.column_groups(w.cells).select("file", "sheet", *b("col"), "nhom")


@query("X-16_parse_refs", f"WITH {REFS} SELECT file, sheet, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, r_sheet, CAST(c1 AS BIGINT) AS c1, r1, CAST(c2 AS BIGINT) AS c2, r2, ext FROM refs")
def _(w):
    return grid.references(w.cells).select("file", "sheet", *b("row", "col"), "r_sheet", *b("c1", "r1", "c2", "r2", "ext"))


_PAT_CASE = """CASE WHEN sheet = 'Tong hop' THEN CASE row WHEN 8 THEN '=SUM(<Chi tiet>!C[6]R[-2]:C[6]R[397])' WHEN 9 THEN '=C[0]R[-1]*5%' ELSE '=C[0]R[-2]*1.08-C[0]R[-1]-C[0]R[1]' END
  WHEN sheet = 'Chi tiet' AND col = 6 THEN '=<Dien giai>!C[-2]R[' || CASE WHEN ends_with(formula, 'D' || (row + 1)) THEN '1' ELSE '0' END || ']'
  WHEN sheet = 'Chi tiet' AND col = 7 THEN '=C[-2]R[0]+C[-1]R[0]' || CASE WHEN ends_with(formula, '+1') THEN '+1' ELSE '' END
  WHEN sheet = 'Chi tiet' THEN '=ROUND(C[' || CASE col WHEN 9 THEN -5 ELSE -4 END || ']R[0]*C[' || (8 - col) || ']R[0],0)' || CASE WHEN ends_with(formula, '1.08') THEN '*1.08' ELSE '' END
  WHEN contains(formula, '[1]') THEN '=<[1]Goc>!C[-2]R[0]' WHEN contains(formula, '#REF') THEN '=#REF!*2' WHEN contains(formula, '(2)') THEN '=<Dien giai (2)>!C[-3]R[0]'
  WHEN starts_with(formula, '=E') THEN '=C[1]R[0]*C[2]R[0]' WHEN ends_with(formula, '*0.5') THEN '=<Chi tiet>!C[0]R[0]*0.5' WHEN starts_with(formula, '=''Chi') THEN '=<Chi tiet>!C[0]R[0]' END"""


@query("X-17_formula_pattern", f"SELECT file, sheet, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, replace({_PAT_CASE}, ' ', '') AS pattern FROM cells WHERE formula IS NOT NULL")
def _(w):
    f = grid.formulas(w.cells)
    return f.select("file", "sheet", *b("row", "col"), S.formula_pattern(F.col("formula"), F.col("row"), F.col("col")).alias("pattern"))


LITS = """lt AS (SELECT file, sheet, row, col, CASE WHEN ends_with(formula, '*1.08') OR contains(formula, '*1.08-') THEN '1.08' WHEN ends_with(formula, '*0.5') THEN '0.5' WHEN ends_with(formula, '*5%') THEN '5%' WHEN formula = '=#REF!*2' THEN '2' END AS literal
  FROM cells WHERE formula IS NOT NULL AND sheet_state = 'visible')"""


@query("X-18_embedded_literals", f"WITH {LITS} SELECT file, sheet, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, literal FROM lt WHERE literal IS NOT NULL")
def _(w):
    f = grid.formulas(w.cells).filter("sheet_state = 'visible'")
    return f.select("file", "sheet", *b("row", "col"), F.explode(S.embedded_literals(F.col("formula"))).alias("literal"))


def on_path(w):
    """Columns that the requested payment is made of, by the expansion tree of each file."""
    from claimgrid.workload.q_lineage import tree
    return lineage.path_columns(tree(w))


#: The tree by listing every simple path from the target and taking the least one to each cell; steps of a path are part * 10^9 + number.
TREE = f"""WITH RECURSIVE fc AS (SELECT *, replace({_PAT_CASE}, ' ', '') AS pattern FROM cells WHERE formula IS NOT NULL),
two AS (SELECT file, sheet, row, col, regexp_extract_all(formula, '{QP}') AS q, regexp_extract_all(regexp_replace(formula, '{QP}', ' ', 'g'), '{LP}') AS l FROM fc),
ml AS (SELECT file, sheet, row, col, unnest(list_concat(q, list_transform(l, lambda x: sheet || '!' || x))) AS m, unnest(range(0, len(q) + len(l))) AS no FROM two),
rf AS (SELECT file, sheet, row, col, no, nullif(regexp_extract(m, '^\\[(\\d+)\\]', 1), '') AS ext, replace(regexp_replace(regexp_extract(m, '^(.*)!', 1), '^\\[\\d+\\]', ''), '''', '') AS r_sheet, string_split(replace(regexp_extract(m, '!([^!]*)$', 1), '$', ''), ':') AS a FROM ml),
refs AS (SELECT * EXCLUDE (a), ascii(a[1]) - 64 AS c1, CAST(a[1][2:] AS INT) AS r1, ascii(a[-1]) - 64 AS c2, CAST(a[-1][2:] AS INT) AS r2, len(a) = 1 AS single FROM rf),
kn AS (SELECT DISTINCT file, sheet FROM cells),
ok AS MATERIALIZED (SELECT r.* FROM refs r JOIN kn ON kn.file = r.file AND kn.sheet = r.r_sheet WHERE ext IS NULL),
mem AS MATERIALIZED (SELECT o.file, o.sheet, o.row, o.col, o.no, c.sheet AS t_sheet, c.row AS t_row, c.col AS t_col, c.formula, c.v_num, p.pattern
  FROM ok o JOIN cells c ON c.file = o.file AND c.sheet = o.r_sheet AND c.row BETWEEN o.r1 AND o.r2 AND c.col BETWEEN o.c1 AND o.c2 LEFT JOIN fc p ON p.file = c.file AND p.sheet = c.sheet AND p.row = c.row AND p.col = c.col WHERE NOT single),
grp AS (SELECT file, sheet, row, col, no, t_sheet, pattern, count(*) AS n, min(t_row * 1000 + t_col) AS f, max(struct_pack(v := coalesce(abs(v_num), -1), r := -t_row, c := -t_col)) AS best FROM mem WHERE formula IS NOT NULL GROUP BY ALL),
pat AS (SELECT *, row_number() OVER (PARTITION BY file, sheet, row, col, no ORDER BY n DESC, f) AS rank FROM grp),
edges AS MATERIALIZED (SELECT file, sheet, row, col, r_sheet AS t_sheet, r1 AS t_row, c1 AS t_col, [1000000000 + no] AS piece FROM ok WHERE single
  UNION ALL SELECT file, sheet, row, col, t_sheet, -best.r, -best.c, [1000000000 + no, 1000000000 + rank, 0] FROM pat),
walk AS (SELECT DISTINCT file, 'Tong hop' AS sheet, 10 AS row, 4 AS col, CAST([] AS BIGINT[]) AS path, ['Tong hop!10!4'] AS passed FROM cells
  UNION ALL SELECT e.file, e.t_sheet, e.t_row, e.t_col, list_concat(w.path, e.piece), list_append(w.passed, e.t_sheet || '!' || e.t_row || '!' || e.t_col) FROM walk w JOIN edges e ON e.file = w.file AND e.sheet = w.sheet AND e.row = w.row AND e.col = w.col
   WHERE NOT list_contains(w.passed, e.t_sheet || '!' || e.t_row || '!' || e.t_col)),
least AS MATERIALIZED (SELECT file, sheet, row, col, min(path) AS path FROM walk GROUP BY ALL),
places AS (SELECT file, sheet, row, col, path FROM walk WHERE len(path) = 0 UNION ALL SELECT e.file, t_sheet, t_row, t_col, list_concat(l.path, e.piece) FROM edges e JOIN least l USING (file, sheet, row, col)),
tree AS (
  SELECT p.file, p.path, CASE WHEN p.path <> l.path THEN 'Đã phân rã' WHEN formula IS NOT NULL THEN 'Công thức' WHEN v_num IS NOT NULL THEN 'Nhập tay' WHEN v_str IS NOT NULL THEN 'Chữ' ELSE 'Trống' END AS kind, p.sheet, p.row, p.col, c.v_num AS value
    FROM places p JOIN least l USING (file, sheet, row, col) LEFT JOIN cells c USING (file, sheet, row, col)
  UNION ALL SELECT l.file, list_append(l.path, 0), 'Tham số gõ cứng', l.sheet, l.row, l.col, NULL FROM least l JOIN fc f USING (file, sheet, row, col)
    WHERE ends_with(formula, '*1.08') OR contains(formula, '*1.08-') OR ends_with(formula, '*0.5') OR ends_with(formula, '*5%') OR formula = '=#REF!*2'
  UNION ALL SELECT l.file, list_append(l.path, 1000000000 + r.no), CASE WHEN ext IS NOT NULL THEN 'File ngoài' WHEN kn.file IS NULL THEN 'Lỗi tham chiếu' ELSE 'Dải' END, r.r_sheet, r1, c1, NULL
    FROM least l JOIN refs r USING (file, sheet, row, col) LEFT JOIN kn ON kn.file = r.file AND kn.sheet = r.r_sheet WHERE ext IS NOT NULL OR kn.file IS NULL OR NOT single
  UNION ALL SELECT l.file, list_concat(l.path, [1000000000 + m.no, 0]), 'Nhóm nhập tay', m.t_sheet, min(t_row), CAST(min(t_row * 1000 + t_col) % 1000 AS INT), sum(m.v_num) FROM least l JOIN mem m USING (file, sheet, row, col) WHERE formula IS NULL AND v_num IS NOT NULL GROUP BY l.file, l.path, m.no, m.t_sheet
  UNION ALL SELECT l.file, list_concat(l.path, [1000000000 + p.no, 1000000000 + p.rank]), 'Mẫu', p.t_sheet, -best.r, -best.c, NULL FROM least l JOIN pat p USING (file, sheet, row, col))"""


#: Columns of every row of the tree with an address in the file.
ON_PATH = f"""{TREE}, {LITS}, pcol AS (SELECT DISTINCT file, sheet, col FROM tree WHERE kind NOT IN ('Mẫu', 'Nhóm nhập tay', 'File ngoài', 'Lỗi tham chiếu')),
lp AS (SELECT lt.*, p.file IS NOT NULL AS on_path FROM lt LEFT JOIN pcol p USING (file, sheet, col) WHERE literal IS NOT NULL)"""


@query("A-16_literal_census", f"""{ON_PATH} SELECT file, literal, CASE literal WHEN '1.08' THEN 'Thuế suất?' WHEN '5%' THEN 'Tỷ lệ %' WHEN '0.5' THEN 'Tỷ lệ %' ELSE 'Hằng số khác (kích thước, hệ số kỹ thuật...)' END AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (on_path) AS BIGINT) AS n_path FROM lp GROUP BY file, literal""")
def _(w):
    path = on_path(w)
    return grid.literal_census(w.cells, path).select("file", "literal", "kind", "n", "n_path")


@query("X-21_literal_kind", f"""WITH {LITS} SELECT literal, CASE WHEN literal = '1.08' THEN 'Thuế suất?' WHEN literal IN ('5%', '0.5') THEN 'Tỷ lệ %' ELSE 'Hằng số khác (kích thước, hệ số kỹ thuật...)' END AS kind, CAST(count(*) AS BIGINT) AS n FROM lt WHERE literal IS NOT NULL GROUP BY literal""")
def _(w):
    f = grid.formulas(w.cells).filter("sheet_state = 'visible'").select(F.explode(S.embedded_literals(F.col("formula"))).alias("literal"))
    return f.select("literal", S.literal_kind(F.col("literal")).alias("kind")).groupBy("literal", "kind").agg(F.count("*").alias("n"))


@query("A-17_dominant_pattern", f"WITH {PATS} SELECT file, sheet, CAST(col AS BIGINT) AS col, CAST(n AS BIGINT) AS n, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, CAST(total AS BIGINT) AS total, CAST(n_patterns AS BIGINT) AS n_patterns, n / total AS share FROM dom")
def _(w):
    return grid.dominant_patterns(grid.patterned(w.cells)).select("file", "sheet", *b("col", "n", "lo", "hi", "total", "n_patterns"), "share")


OUTL = PATS + """, ol AS (SELECT p.* FROM pt p JOIN pc ON pc.file = p.file AND pc.sheet = p.sheet AND pc.col = p.col AND pc.pattern = p.pattern AND pc.n <= 2 JOIN dom d ON d.file = p.file AND d.sheet = p.sheet AND d.col = p.col WHERE d.n >= 10 AND d.n / d.total >= 0.7 AND p.pattern <> d.pattern AND p.row BETWEEN d.lo AND d.hi)"""


@query("W-11_pattern_outliers", f"WITH {OUTL} SELECT file, sheet, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, formula FROM ol")
def _(w):
    p = cut_lineage(grid.patterned(w.cells))
    return grid.pattern_outliers(p, grid.dominant_patterns(p)).select("file", "sheet", *b("row", "col"), "formula")


TYPED = PATS + f", {LABELS}" + """, tb AS (SELECT c.* FROM cells c JOIN dom d ON d.file = c.file AND d.sheet = c.sheet AND d.col = c.col WHERE d.n >= 10 AND d.n / d.total >= 0.7 AND c.formula IS NULL AND c.v_num <> 0 AND c.row BETWEEN d.lo AND d.hi
   AND (EXISTS (SELECT 1 FROM cells f WHERE f.file = c.file AND f.sheet = c.sheet AND f.row = c.row AND f.formula IS NOT NULL) OR EXISTS (SELECT 1 FROM lab l WHERE l.file = c.file AND l.sheet = c.sheet AND l.row = c.row AND l.label <> '')))"""


@query("W-12_typed_between_formulas", f"WITH {TYPED} SELECT file, sheet, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, v_num FROM tb")
def _(w):
    return grid.typed_between(w.cells, grid.dominant_patterns(grid.patterned(w.cells))).select("file", "sheet", *b("row", "col"), "v_num")


@query("J-14_resolve_refs", f"""WITH {REFS} SELECT r.file, r.sheet, CAST(r.row AS BIGINT) AS row, CAST(r.col AS BIGINT) AS col, r.r_sheet, r.r1, CAST(r.c1 AS BIGINT) AS c1, t.formula AS t_formula, t.v_num AS t_num FROM refs r LEFT JOIN cells t ON t.file = r.file AND t.sheet = r.r_sheet AND t.row = r.r1 AND t.col = r.c1
   WHERE r.ext IS NULL AND r.c1 = r.c2 AND r.r1 = r.r2""")
def _(w):
    r = grid.resolve_single(grid.references(w.cells), w.cells)
    return r.select("file", "sheet", *b("row", "col"), "r_sheet", *b("r1", "c1"), "t_formula", "t_num")


@query("J-15_expand_ranges", f"""WITH {REFS} SELECT r.file, r.sheet AS f_sheet, CAST(r.row AS BIGINT) AS f_row, CAST(count(*) AS BIGINT) AS n, sum(t.v_num) AS total FROM refs r JOIN cells t ON t.file = r.file AND t.sheet = r.r_sheet AND t.row BETWEEN r.r1 AND r.r2 AND t.col BETWEEN r.c1 AND r.c2
   WHERE r.ext IS NULL AND (r.c1 <> r.c2 OR r.r1 <> r.r2) GROUP BY r.file, r.sheet, r.row""")
def _(w):
    t = grid.range_totals(grid.references(w.cells), w.cells)
    return t.select("file", F.col("sheet").alias("f_sheet"), F.col("row").cast("bigint").alias("f_row"), "n", "total")


@query("J-15_range_members", f"""WITH {REFS} SELECT r.file, r.sheet AS f_sheet, CAST(r.row AS BIGINT) AS f_row, t.sheet, CAST(t.row AS BIGINT) AS row, CAST(t.col AS BIGINT) AS col, t.v_num FROM refs r JOIN cells t ON t.file = r.file AND t.sheet = r.r_sheet AND t.row BETWEEN r.r1 AND r.r2 AND t.col BETWEEN r.c1 AND r.c2
   WHERE r.ext IS NULL AND (r.c1 <> r.c2 OR r.r1 <> r.r2)""")
def _(w):
    """The members themselves, for whoever asks for them."""
    e = grid.expand_ranges(grid.references(w.cells), w.cells)
    return e.select("file", "f_sheet", F.col("f_row").cast("bigint").alias("f_row"), "sheet", *b("row", "col"), "v_num")


WRONG = f"""{REFS}, {LABELS}, cr AS (SELECT * FROM refs WHERE r_sheet <> sheet AND ext IS NULL), pp AS (SELECT file, sheet, r_sheet, count(*) AS n FROM cr WHERE r1 = r2 GROUP BY ALL HAVING count(*) >= 20),
wl AS (SELECT c.*, a.label AS a, z.label AS b FROM cr c JOIN pp ON pp.file = c.file AND pp.sheet = c.sheet AND pp.r_sheet = c.r_sheet JOIN lab a ON a.file = c.file AND a.sheet = c.sheet AND a.row = c.row LEFT JOIN lab z ON z.file = c.file AND z.sheet = c.r_sheet AND z.row = c.r1
   WHERE c.sheet_state = 'visible' AND c.c1 = c.c2 AND c.r1 = c.r2 AND EXISTS (SELECT 1 FROM cells k WHERE k.file = c.file AND k.sheet = c.r_sheet) AND length(a.label) >= 6 AND NOT coalesce(regexp_matches({sql_fold('z.label')}, '^(tong|cong|thue|vat|gia tri)'), FALSE)),
wf AS (SELECT *, {sql_fold('a')} AS fa, {sql_fold('b')} AS fb FROM wl), ws AS (SELECT *, CASE WHEN fb = '' THEN NULL WHEN contains(fa, fb) OR contains(fb, fa) THEN 1.0 ELSE {sql_edit('fa', 'fb')} END AS score FROM wf),
wr AS (SELECT *, CASE WHEN score IS NULL THEN 'Trỏ tới dòng không có tên hạng mục' ELSE 'Lệch dòng: tên hai đầu khác nhau' END AS kind FROM ws WHERE score IS NULL OR score < 0.6)"""


@query("C-K3_wrong_row_links", f"WITH {WRONG} SELECT file, sheet, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, r_sheet, r1, kind FROM wr")
def _(w):
    return grid.wrong_row_links(w.cells, "edit").select("file", "sheet", *b("row", "col"), "r_sheet", *b("r1"), "kind")


@query("J-22_hidden_ref_counts", f"WITH {REFS} SELECT file, sheet, r_sheet, CAST(count(*) AS BIGINT) AS n FROM refs WHERE sheet_state = 'visible' AND r_sheet = 'Dien giai (2)' AND ext IS NULL GROUP BY ALL")
def _(w):
    return grid.hidden_ref_counts(w.cells)


DIFF = """df AS (SELECT coalesce(a.file, h.file) AS file, coalesce(a.row, h.row) AS row, coalesce(a.col, h.col) AS col, a.v_num, h.v_num AS h_num, a.v_str, h.v_str AS h_str FROM (SELECT * FROM cells WHERE sheet = 'Dien giai') a FULL JOIN (SELECT * FROM cells WHERE sheet = 'Dien giai (2)') h ON h.file = a.file AND h.row = a.row AND h.col = a.col
   WHERE NOT (coalesce(abs(a.v_num - h.v_num) < 1e-9, a.v_num IS NULL AND h.v_num IS NULL) AND a.v_str IS NOT DISTINCT FROM h.v_str))"""


@query("J-12_diff_grids", f"WITH {DIFF} SELECT file, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, v_num, h_num, v_str, h_str FROM df")
def _(w):
    return grid.diff_grids(w.cells).select("file", *b("row", "col"), "v_num", F.col("h_v_num").alias("h_num"), "v_str", F.col("h_v_str").alias("h_str"))


@query("T-07_cap", f"WITH {DIFF} SELECT file, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CAST(row_number() OVER (PARTITION BY file ORDER BY row, col) AS BIGINT) AS rank FROM df")
def _(w):
    """All differences of a pair with their rank; a report takes as many as its caller asks for."""
    return grid.ranked_differences(grid.diff_grids(w.cells)).select("file", *b("row", "col", "rank"))


@query("C-K1_overview", """WITH p AS (SELECT file, sheet, sheet_state, count(*) FILTER (contains(formula, '#REF!')) AS nr, count(*) FILTER (formula IS NOT NULL AND v_str = '#REF!') AS ne FROM cells GROUP BY ALL)
  SELECT file || '!' || sheet AS entity, 'Trung bình' AS level, 'formulas lost a reference' AS message, CAST(nr AS BIGINT) AS n FROM p WHERE nr > 0 UNION ALL SELECT file || '!' || sheet, 'Cao', 'formulas show an error', CAST(ne AS BIGINT) FROM p WHERE ne > 0
  UNION ALL SELECT file || '!1', 'Cao', 'formulas read an external file', CAST(count(*) AS BIGINT) FROM cells WHERE contains(formula, '[1]') GROUP BY file""")
def _(w):
    return grid.k1_findings(w.cells).select("entity", "level", "message", "n")


@query("C-K2_pattern_findings", f"""WITH {OUTL}, {LABELS}, {TYPED[TYPED.index('tb AS'):]} SELECT file || '!' || sheet AS entity, 'Trung bình' AS level, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS amount FROM ol GROUP BY file, sheet
   UNION ALL SELECT file || '!' || sheet || '!' || chr(CAST(64 + col AS INT)), 'Cao', CAST(count(*) AS BIGINT), sum(v_num) FROM tb GROUP BY file, sheet, col""")
def _(w):
    return grid.k2_findings(w.cells).select("entity", "level", "n", "amount")


@query("C-K4_hidden_sheets", f"""WITH {REFS}, {DIFF} SELECT h.file || '!Dien giai (2)' AS entity, CASE WHEN coalesce(r.n, 0) > 0 OR coalesce(d.n, 0) > 0 THEN 'Trung bình' ELSE 'Kiểm soát' END AS level, CAST(greatest(coalesce(r.n, 0), 1) AS BIGINT) AS n, CAST(coalesce(d.n, 0) AS DOUBLE) AS amount
   FROM (SELECT DISTINCT file FROM cells WHERE sheet_state = 'hidden') h LEFT JOIN (SELECT file, count(*) AS n FROM refs WHERE sheet_state = 'visible' AND r_sheet = 'Dien giai (2)' GROUP BY file) r ON r.file = h.file LEFT JOIN (SELECT file, count(*) AS n FROM df GROUP BY file) d ON d.file = h.file""")
def _(w):
    return grid.k4_findings(w.cells).select("entity", "level", "n", "amount")


TXTN = f"""{LABELS}, tn AS (SELECT c.* FROM cells c JOIN ncol n ON n.file = c.file AND n.sheet = c.sheet WHERE c.sheet_state = 'visible' AND c.formula IS NULL AND regexp_full_match(replace(trim(v_str), ' ', ''), '[-+]?\\d+([.,]\\d+)?%?') AND NOT regexp_full_match(replace(trim(v_str), ' ', ''), '\\d{{1,2}}') AND c.col > name_col)"""


@query("C-K5_text_numbers", f"WITH {TXTN} SELECT file, sheet, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, v_str FROM tn")
def _(w):
    return grid.text_numbers(w.cells).select("file", "sheet", *b("row", "col"), "v_str")


@query("C-K6_literal_findings", f"""{ON_PATH} SELECT file || '!' || literal AS entity, CAST(count(*) FILTER (on_path) AS BIGINT) AS n FROM lp WHERE literal IN ('1.08', '5%', '0.5') GROUP BY file, literal HAVING count(*) FILTER (on_path) > 0""")
def _(w):
    path = on_path(w)
    return grid.k6_findings(w.cells, path).select("entity", "n")


@query("T-03_order_findings", f"""WITH {TXTN} SELECT 'K5' AS "check", 'Trung bình' AS level, CAST(count(DISTINCT file) AS BIGINT) AS n FROM tn UNION ALL SELECT 'K1', 'Cao', (SELECT count(DISTINCT file || sheet) FROM cells WHERE formula IS NOT NULL AND v_str = '#REF!') + (SELECT count(DISTINCT file) FROM cells WHERE contains(formula, '[1]'))
   UNION ALL SELECT 'K1', 'Trung bình', CAST((SELECT count(DISTINCT file || sheet) FROM cells WHERE contains(formula, '#REF!')) AS BIGINT)""")
def _(w):
    f = collect_findings(grid.k1_findings(w.cells), grid.k5_findings(w.cells))
    return order_findings(f.groupBy("check", "level").agg(F.count("*").alias("n")))


@query("U-05_downgrade_off_path", """SELECT file, CAST(1 AS BIGINT) AS ext, CASE WHEN CAST(substr(file, 3) AS BIGINT) % 2 = 0 THEN 'Cao' ELSE 'Trung bình' END AS level FROM (SELECT DISTINCT file FROM cells WHERE contains(formula, '[1]')) t""")
def _(w):
    ext = F.explode(S.external_links(F.col("formula"))).alias("ext")
    use = grid.formulas(w.cells).select("file", ext, "sheet", "col").distinct()
    f = use.select("file", "ext").distinct().withColumn("level", F.lit(X.HIGH))
    even = F.substring("file", 3, 20).cast("bigint") % 2 == 0
    path = w.cells.select("file", "sheet", "col").distinct().filter((even & (F.col("sheet") == "Dien giai")) | (~even & (F.col("sheet") == "Tong hop")))
    return grid.downgrade_off_path(f, use, path).select("file", *b("ext"), "level")


@query("SRC-14_find_labelled_totals", """SELECT c.file, l.label, v.v_num, CAST(l.r AS BIGINT) AS row FROM (SELECT DISTINCT file FROM cells) c, (VALUES ('gt_hd', 3), ('gt_kn', 8), ('giu_lai', 9), ('tt_ky_nay', 10)) l(label, r), cells v WHERE v.file = c.file AND v.sheet = 'Tong hop' AND v.row = l.r AND v.col = 4
   UNION ALL SELECT DISTINCT c.file, 'gt_hd_x', NULL, NULL FROM cells c WHERE FALSE""")
def _(w):
    t = grid.labelled_totals(w.cells)
    return t.select("file", "label", "v_num", *b("row"))


_IT = """it AS (SELECT c.file, c.row AS dong, c.v_str AS ten, u.v_str AS dvt, n.v_num AS stt FROM cells c LEFT JOIN cells u ON u.file = c.file AND u.sheet = c.sheet AND u.row = c.row AND u.col = 3 LEFT JOIN cells n ON n.file = c.file AND n.sheet = c.sheet AND n.row = c.row AND n.col = 1 WHERE c.sheet = 'Chi tiet' AND c.col = 2 AND c.row > 5)"""


@query("SRC-12_detect_detail_table", f"""WITH {_IT} SELECT it.file, 'Chi tiet' AS sheet, CAST(it.dong AS BIGINT) AS dong, ten, coalesce(dvt, '') AS dvt, p.v_num AS don_gia, coalesce(q.v_num, try_cast(q.v_str AS DOUBLE)) AS kl_hd, k.v_num AS kl_kn, l.v_num AS kl_lk, g.v_num AS gt_lk FROM it
   LEFT JOIN cells p ON p.file = it.file AND p.sheet = 'Chi tiet' AND p.row = it.dong AND p.col = 8 LEFT JOIN cells q ON q.file = it.file AND q.sheet = 'Chi tiet' AND q.row = it.dong AND q.col = 4 LEFT JOIN cells k ON k.file = it.file AND k.sheet = 'Chi tiet' AND k.row = it.dong AND k.col = 6
   LEFT JOIN cells l ON l.file = it.file AND l.sheet = 'Chi tiet' AND l.row = it.dong AND l.col = 7 LEFT JOIN cells g ON g.file = it.file AND g.sheet = 'Chi tiet' AND g.row = it.dong AND g.col = 11""")
def _(w):
    return grid.detail_table(w.cells).select("file", "sheet", *b("dong"), "ten", "dvt", "don_gia", "kl_hd", "kl_kn", "kl_lk", "gt_lk")


@query("W-08_carry_group", f"""WITH {_IT}, f AS (SELECT *, dvt IS NULL AS g FROM it), n AS (SELECT *, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY dong) AS ng FROM f),
   z AS (SELECT *, last_value(CASE WHEN g AND ng = 1 THEN ten END IGNORE NULLS) OVER (PARTITION BY file ORDER BY dong) AS g1, last_value(CASE WHEN g AND ng > 1 THEN ten END IGNORE NULLS) OVER (PARTITION BY file ORDER BY dong) AS g2 FROM n)
   SELECT file, CAST(dong AS BIGINT) AS dong, coalesce(concat_ws(' / ', g1, g2), '') AS nhom FROM z""")
def _(w):
    return grid.carry_groups(grid.detail_table(w.cells)).select("file", *b("dong"), "nhom")


@query("W-10_dup_key_suffix", f"""WITH {_IT}, k AS (SELECT file, dong, regexp_replace({sql_fold('ten')}, ' so \\d+$', '') AS kk FROM it WHERE dvt IS NOT NULL) SELECT file, CAST(dong AS BIGINT) AS dong, CASE WHEN row_number() OVER w > 1 THEN '|' || kk || '|m3#' || row_number() OVER w ELSE '|' || kk || '|m3' END AS khoa FROM k WINDOW w AS (PARTITION BY file, kk ORDER BY dong)""")
def _(w):
    t = grid.detail_table(w.cells).filter("dvt <> ''").withColumn("nhom", F.lit("")).withColumn("ten", F.regexp_replace("ten", r" số \d+$", ""))
    return grid.number_duplicates(t).select("file", *b("dong"), "khoa")


@query("W-09_cut_at_total", f"""WITH {_IT} SELECT file, CAST(dong AS BIGINT) AS dong FROM it WHERE dong < 206""")
def _(w):
    r = grid.table_rows(w.cells, grid.detail_layouts(w.cells)).filter("sheet = 'Chi tiet'").withColumn("row", F.col("dong"))
    return grid.cut_at_total(r, F.col("dong") >= 206).select("file", *b("dong"))


@query("SRC-13_detect_boq_table", f"""WITH {_IT}, f AS (SELECT *, dvt IS NULL AS g FROM it), z AS (SELECT *, coalesce(last_value(CASE WHEN g THEN ten END IGNORE NULLS) OVER (PARTITION BY file ORDER BY dong), '') AS nhom FROM f)
   SELECT z.file, CAST(dong AS BIGINT) AS dong, nhom, ten, dvt, q.v_num AS kl, p.v_num AS don_gia FROM z LEFT JOIN cells q ON q.file = z.file AND q.sheet = 'Chi tiet' AND q.row = dong AND q.col = 7 LEFT JOIN cells p ON p.file = z.file AND p.sheet = 'Chi tiet' AND p.row = dong AND p.col = 8 WHERE NOT g""")
def _(w):
    return grid.boq_table(w.cells).select("file", *b("dong"), "nhom", "ten", "dvt", "kl", "don_gia")
