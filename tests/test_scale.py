"""Plans of the steps whose inputs are far larger than the optimizer expects, and formulas parsed once."""

from __future__ import annotations

import contextlib
import io

import pandas as pd
from pyspark.sql import functions as F

from claimgrid.functions import formulas as S
from claimgrid.operators import extract, grid, match, state
from claimgrid.sinks import workbooks
from claimgrid.sources import files
from claimgrid.workload import world
from claimgrid.workload.world import World


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_formulas_are_parsed_by_one_function(spark):
    f = spark.createDataFrame([("='It''s [a]'!$B$3:C4+A1*'[12]X y'!AA10",), ('="A1!B2"&C3&"x""y"',), (None,)], "f string")
    out = f.select(S.formula_pattern(F.col("f"), F.lit(2), F.lit(3)).alias("p"), S.parse_refs(F.col("f"), F.lit("S")).alias("r"))
    assert "ArrowEvalPython" in plan(out) and "regexp_extract_all" not in plan(out)
    got = [(r.p, None if r.r is None else [tuple(x) for x in r.r]) for r in out.collect()]
    assert got == [("=<It''s[a]>!C2R3:C[0]R[2]+C[-2]R[-1]*<[12]Xy>!C[24]R[8]", [("It's [a]", 2, 3, 3, 4, None), ("X y", 27, 10, 27, 10, 12), ("S", 1, 1, 1, 1, None)]),
                   ('=""&C[0]R[1]&""', [("S", 3, 3, 3, 3, None)]), (None, None)]


def test_exploded_tables_are_not_dealt_out_again(spark, monkeypatch):
    class Table:
        spread, write = False, None

        def __init__(self):
            self.write = self

        def repartition(self, n):
            self.spread = True
            return self

        def parquet(self, path):
            pass

    made = {}
    monkeypatch.setattr(World, "_table", lambda self, name: made.setdefault(name, Table()))
    w = World(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr("claimgrid.workload.world._WRITTEN", {})
    w._stored("cells"), w._stored("lines")
    assert not made["cells"].spread and made["lines"].spread


def test_cells_keep_to_their_workbook_and_heads_are_made_once(spark, monkeypatch):
    limit, path = "spark.sql.codegen.hugeMethodLimit", "/root/testdata/sf0.001"
    monkeypatch.setattr(world, "_WRITTEN", {})
    before, w = spark.conf.get(limit), World(spark, path)
    assert "rangepartitioning(o_orderkey" in plan(w._table("cells"))
    at = w.cells.select("file", F.input_file_name().alias("at")).distinct().groupBy("file").count()
    assert at.agg(F.max("count")).first()[0] < 16 and spark.conf.get(limit) == before
    orders, heads = world._render("cells", "spark", path).split(" UNION ALL ")
    assert "WHERE o_orderkey % 400 = 0" in heads and "WHERE o_orderkey" not in orders and orders.count("struct(") < 30


def test_labels_are_sought_without_ordering_all_cells(spark):
    row = "file string, sheet string, sheet_idx int, sheet_state string, row int, col int, formula string, v_num double, v_str string"
    cells = spark.createDataFrame([("f", "S", 0, "visible", 1, 2, None, None, "Giá trị hợp đồng"), ("f", "S", 0, "visible", 1, 1, None, 9.0, None), ("f", "S", 0, "visible", 1, 3, None, 1.0, None),
                                   ("f", "S", 0, "visible", 1, 5, "=A1", 7.0, None), ("f", "S", 0, "visible", 1, 6, None, 8.0, None), ("f", "S", 0, "visible", 2, 2, None, None, "Giữ lại")], row)
    out = grid.labelled_totals(cells)
    assert [(r.label, r.row, r.col, r.v_num) for r in out.collect()] == [("gt_hd", 1, 5, 7.0)]
    assert "unboundedfollowing" not in plan(out)


def test_texts_and_answers_are_not_broadcast(spark):
    docs = spark.createDataFrame([("A", "Bên giao thầu Công ty Một")], "doc_id string, text string")
    rows = spark.createDataFrame([("A", "TC-06", "", None, "Công ty Một", "Tự động", "", "")], "doc_id string, ma string, don_vi string, v_num double, v_str string, cach string, dieu string, trich string")
    answers = spark.createDataFrame([("A", "TC-06", "Công ty Một", "", "", "công ty một", "")], "doc_id string, ma string, gia_tri string, don_vi string, dieu_khoan string, trich_dan string, ghi_chu string")
    full = extract.folded_documents(docs, extract.parties_of(rows))
    found = extract.compare_extractors(rows, answers, full)
    assert "BroadcastHashJoin" not in plan(found) and "BroadcastHashJoin" not in plan(extract.fill_from_ai(rows, answers))
    assert [(r.khop, r.that) for r in found.collect()] == [("Khớp", "Có")]


def test_fragments_are_not_broadcast(spark):
    contracts = spark.createDataFrame([("HD1", "Hop dong 0001"), ("HD2", "Hop dong 0001"), ("HD3", "Hop dong 0003")], "ma_hd string, so_hd string")
    refs = spark.createDataFrame([("dong 0003",), ("dong 0001",), ("hd2",), ("Hop dong 0001",), ("zzzz",)], "ref string")
    out = state.resolve_reference(refs, contracts)
    joins = [line for line in plan(out).splitlines() if "BroadcastHashJoin" in line and ("[g#" in line or "so_hd" in line or "ma_hd" in line)]
    assert not joins
    assert {r.ref: (r.ma_hd, r.status) for r in out.collect()} == {
        "dong 0003": ("HD3", "unique"), "dong 0001": (None, "ambiguous"), "hd2": ("HD2", "unique"), "Hop dong 0001": ("HD1", "unique"), "zzzz": (None, "none")}


def workbook(cells=3, bad=None):
    c = pd.DataFrame({"sheet": "S", "sheet_idx": 0, "sheet_state": "visible", "row": range(1, cells + 1), "col": 2, "formula": None, "v_num": [float(i) for i in range(cells)], "v_str": None})
    if bad is not None:
        c.loc[bad, ["formula", "v_str"]] = ["=A1", "#REF!"]
    parts = pd.DataFrame({"kind": ["merged", "link"], "sheet": ["S", None], "r1": [1, None], "c1": [1, None], "r2": [2, None], "c2": [3, None], "no": [None, 1], "name": None, "text": [None, "x.xlsx"]})
    return workbooks._encode(c, parts)


def test_a_workbook_is_parsed_once_for_its_parts(monkeypatch):
    parsed, parse = [], files.ET.iterparse
    monkeypatch.setattr(files.ET, "iterparse", lambda f: parsed.append(f) or parse(f))
    monkeypatch.setattr(pd.DataFrame, "groupby", None)                 # no frame a row of the sheet
    content = workbook(bad=1)
    assert [r[1:7] for r in files._parts_of("b", content)] == [("merged", "S", 1, 1, 2, 3), ("link", None, None, None, None, None)]
    assert len(parsed) == 1
    assert [c[4:9] for c in files._cells_of("b", content)] == [(1, 2, None, 0.0, None), (2, 2, "=A1", None, "#REF!"), (3, 2, None, 2.0, None)]


def test_a_broken_workbook_still_gives_its_other_parts(monkeypatch):
    monkeypatch.setattr(workbooks, "_cell", lambda row, col, *v: f'<c r="B{row}"><v>{"x" if row == 2 else 1}</v></c>')
    assert [r[1] for r in files._parts_of("b", workbook())] == ["merged", "link", "broken"]


def test_bill_headers_are_sought_in_few_rows(spark):
    head = {1: "STT", 2: "Tên công việc", 3: "Đơn vị", 4: "Khối lượng", 5: "Đơn"}
    cells = [("f", "S", 0, 4, c, None, None, v) for c, v in head.items()] + [("f", "S", 0, 5, 5, None, None, "giá"), ("f", "S", 0, 6, 2, None, None, "Đào đất"), ("f", "S", 0, 6, 3, None, None, "m3"),
             ("f", "S", 0, 6, 4, None, 2.0, None), ("f", "S", 0, 6, 5, None, 7.0, None)]
    cells = spark.createDataFrame(cells, "file string, sheet string, sheet_idx int, row int, col int, formula string, v_num double, v_str string")
    layout = grid.boq_layouts(cells)
    assert "SortMergeJoin" not in plan(layout) and "FullOuter" not in plan(layout)
    assert [(r.hdr, r.ten, r.dg, r.dvt, r.kl, r.stt) for r in layout.collect()] == [(4, 2, 5, 3, 4, 1)]
    assert [(r.dong, r.ten, r.kl, r.don_gia) for r in grid.boq_table(cells).collect()] == [(6, "Đào đất", 2.0, 7.0)]


def test_detail_layouts_are_read_back_with_their_size(spark):
    head = {1: "STT", 2: "Tên công việc", 3: "Đơn vị", 4: "Khối lượng hợp đồng", 5: "Đơn giá"}
    cells = spark.createDataFrame([("f", "S", 0, 4, c, None, None, v) for c, v in head.items()], "file string, sheet string, sheet_idx int, row int, col int, formula string, v_num double, v_str string")
    layout = grid.detail_layouts(cells)
    assert "FileScan parquet" in plan(layout) and "Window" not in plan(layout)
    assert [(r.hdr, r.ten, r.dg, r.dvt, r.kl_hd) for r in layout.collect()] == [(4, 2, 5, 3, 4)]


def test_only_names_of_large_groups_that_may_pair_are_cut_into_pieces(spark, monkeypatch):
    """Two unmatched lines in two of 40 contracts: none of the few names of a contract is cut into pieces; where pieces are
    asked for, those of the 38 other contracts are left out."""
    cut, index = [], match._prefix_index
    monkeypatch.setattr(match, "_prefix_index", lambda names, keys, freq, threshold: cut.append(names.count()) or index(names, keys, freq, threshold))
    lines = spark.createDataFrame([(f"HD{c}", f"HM{i}", name, "m2") for c in range(40) for i, name in enumerate(["Xây tường gạch", "Lát nền gạch men"])], "ma_hd string, ma_hm string, ten string, dvt string")
    items = spark.createDataFrame([("HD7", 1, "Xây tường gạch đặc", "m2"), ("HD8", 2, "Xây tường gạch", "bộ")], "ma_hd string, dong long, ten string, dvt string")
    for few, pieces in ((match.FEW, []), (1, [1, 2])):
        monkeypatch.setattr(match, "FEW", few)
        found = {(r.ma_hd, r.dong, r.goi_y) for r in match.fuzzy_suggest(items, lines, threshold=0.7, measure="edit").collect()}
        assert found == {("HD7", 1, "HM0"), ("HD8", 2, None)} and cut == pieces


def test_change_log_is_read_from_its_two_tables(spark):
    """The log of base and changed lines is not written once more, neither when read itself nor below the claim lines."""
    from claimgrid.workload import world as WD
    w = World(spark, "/root/testdata/sf0.001")
    assert w.boq_log.count() == w.boq_base.count() + w.boq_changes.count() and w.claim_items.columns
    written = {name for _, path, name in WD._WRITTEN if path == w.path}
    assert "boq_log" not in written and {"boq_base", "boq_changes", "claim_items"} <= written


def test_listed_documents_take_one_exchange_and_no_other_parameter(spark, monkeypatch):
    """The lists of documents are those of the whole extraction, two kinds and clauses included, without any rule of it."""
    text = {"a": ["Điều 3. Thanh toán", "Hồ sơ thanh toán gồm các tài liệu sau:", "Tất cả bản chính.", "+ Biên bản nghiệm thu;", "+ Số lượng hồ sơ: 05 bộ", "+ Hóa đơn.", "Hết.", "+ Không tính",
                  "Hồ sơ quyết toán bao gồm", "+ Bản vẽ"], "b": ["Hồ sơ thanh toán gồm", "Không có gì"], "c": ["Hồ sơ thanh toán gồm", "+ Đơn"]}
    paras = spark.createDataFrame([(d, n, t) for d, ts in text.items() for n, t in enumerate(ts)], "doc_id string, pos long, text string")
    shown = lambda df: sorted((r.doc_id, r.loai, r.tai_lieu, r.dieu_khoan) for r in df.collect())
    want = shown(extract.required_documents(extract.extract_params(paras)))
    monkeypatch.setattr(extract, "rule_hits", None)
    found = extract.listed_documents(paras)
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert shown(found) == want and {(d, k) for d, k, *_ in want} == {("a", "Mỗi đợt"), ("a", "Quyết toán"), ("c", "Mỗi đợt")}


def test_base_sets_do_not_extract_all_parameters(spark, monkeypatch):
    from claimgrid.workload import all_queries
    monkeypatch.setattr(extract, "extract_params", None)
    out = all_queries()["SNK-12_write_master"](spark, "/root/testdata/sf0.001")
    assert out.filter("table = 'Ho so TT theo HD'").count() > 0


def test_shuffle_files_go_with_the_table_they_were_for(spark):
    import time
    from pathlib import Path

    from claimgrid import session
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {p for d in disk.localDirs() for p in Path(d.getPath()).rglob("shuffle_*")}
    before, held = kept(), spark.conf.get(conf, None)
    table = session.cut_lineage(spark.range(1000).repartition(3, "id"))
    until = time.time() + 10
    while kept() - before and time.time() < until:
        time.sleep(0.2)
    assert not kept() - before and spark.conf.get(conf, None) == held
    assert table.count() == 1000


def test_settings_of_nested_blocks_come_back(spark):
    from claimgrid import session
    conf = "spark.sql.requireAllClusterKeysForCoPartition"
    held = spark.conf.get(conf)
    with session.one_exchange(spark):
        with session.one_exchange(spark):
            pass
        assert spark.conf.get(conf) == "false"
    assert spark.conf.get(conf) == held == "true"


def test_references_are_dealt_out_once_by_workbook(spark):
    """No table of a trace is broadcast, and none is exchanged by sheets, rows or columns but the small ones of headers and sheets."""
    import re

    from claimgrid.operators import lineage
    from claimgrid.session import cut_lineage, one_exchange
    rows = [("f", "S", 0, "visible", 3, 2, "=T!B2", 5.0, None), ("f", "T", 1, "visible", 2, 2, None, 5.0, None), ("f", "T", 1, "visible", 2, 1, None, None, "Đào đất số 7")]
    cells = cut_lineage(spark.createDataFrame(rows, "file string, sheet string, sheet_idx int, sheet_state string, row int, col int, formula string, v_num double, v_str string"))
    with one_exchange(spark):
        nodes = re.sub(r"#\d+L?", "", plan(lineage.trace_nodes(cells, "edit")))
        joins = [x for x in nodes.splitlines() if "SortMergeJoin" in x and "LeftOuter" in x]
        assert not re.search(r"hashpartitioning\(file, (r_sheet|sheet, row, col)", nodes) and len(joins) >= 6
        cur = spark.createDataFrame([("f", 1, "S", 3, 2, 9.0, 0, [])], "file string, item int, sheet string, row int, col int, kl_hd double, hops int, flags array<string>")
        kept = cut_lineage(lineage.met_nodes(cur, cells, cut_lineage(lineage.trace_nodes(cells, "edit"))))
        tables, _ = lineage.jump_tables(kept)
        step = re.sub(r"#\d+L?", "", plan(lineage._step(lineage._lifted(lineage.by_file(cur), tables), kept)))
    assert "BroadcastHashJoin" not in step and not re.search(r"hashpartitioning\(file, sheet", step)
    assert sorted((r.sheet, r.col, r.is_f) for r in kept.collect()) == [("S", 2, True), ("T", 2, False)]


CELLS = "file string, sheet string, sheet_idx int, sheet_state string, row int, col int, formula string, v_num double, v_str string"


def test_tables_of_few_rows_are_broadcast_and_others_merged(spark, monkeypatch):
    from claimgrid import session
    monkeypatch.setattr(session, "FEW", 2)
    for n, broadcast in ((2, True), (3, False)):
        assert ("BroadcastHashJoin" in plan(spark.range(9).join(session.sized(spark.range(n)), "id"))) == broadcast


def test_cells_and_labels_are_not_broadcast_to_checks(spark):
    import re

    from claimgrid.session import cut_lineage
    rows = [("f", s, i, state, r, 2, None, 5.0, f"Đào đất {r}") for s, i, state in (("S", 0, "visible"), ("S (2)", 1, "hidden")) for r in range(1, 4)]
    cells = cut_lineage(spark.createDataFrame(rows, CELLS))
    assert "BuildLeft" not in plan(grid.diff_grids(cells)) and "BuildRight" in plan(grid.diff_grids(cells))
    typed = plan(grid.typed_between(cells, grid.dominant_patterns(grid.patterned(cells))))
    links = plan(grid.wrong_row_links(cells, "edit"))
    for p in (typed, links):
        assert not re.search(r"BroadcastHashJoin \[file, (r_)?sheet, r(ow|1)\]", re.sub(r"#\d+L?", "", p))


def test_a_tree_of_many_cells_is_merged(spark, monkeypatch):
    """With no row counted as few, the walk broadcasts no cells and gives the same tree."""
    from claimgrid import session
    from claimgrid.operators import lineage
    rows = [("f", "S", 0, "visible", 1, 2, "=B2+SUM(B3:B5)*2", 9.0, None), ("f", "S", 0, "visible", 2, 2, "=[1]T!B2", 9.0, None)] + [("f", "S", 0, "visible", r, 2, None, 1.0, None) for r in range(3, 6)]
    cells = session.cut_lineage(spark.createDataFrame(rows, CELLS))
    target = spark.createDataFrame([("f", "S", 1, 2)], "file string, sheet string, row int, col int")
    read = lambda t: sorted((str(r.path), r.kind, r.row, r.value) for r in t.collect())
    want = read(lineage.trace_tree(cells, target))
    monkeypatch.setattr(session, "FEW", 0)
    tree = lineage.trace_tree(cells, target)
    assert "BroadcastHashJoin" not in plan(tree) and read(tree) == want and len(want) == 6


def test_parts_of_the_amendment_check_are_stored_when_read(spark, monkeypatch):
    from types import SimpleNamespace

    from claimgrid.workload import q_amend
    made, stored = [], []
    monkeypatch.setattr(q_amend, "_checked", lambda w: made.append(1) or {n: n for n in ("lines", "findings", "forms", "params")})
    monkeypatch.setattr(q_amend, "Checked", type("Checked", (getattr(q_amend, "Checked", dict),), {"_set_up": {}}), raising=False)
    w = SimpleNamespace(spark=spark, path="/none", memo=lambda name, make: stored.append(name) or make())
    assert q_amend.checked(w)["forms"] == "forms" and q_amend.checked(w)["findings"] == "findings"
    assert stored == ["amend-forms", "amend-findings"] and made == [1]


def test_one_pass_over_a_workbook_gives_its_cells_and_parts(spark, monkeypatch):
    good, bad = workbook(bad=1), b"no workbook"
    monkeypatch.setattr(workbooks, "_cell", lambda row, col, *v: f'<c r="B{row}"><v>{"x" if row == 2 else 1}</v></c>')
    half = workbook()
    monkeypatch.undo()
    books = spark.createDataFrame([("good", good), ("half", half), ("bad", bad)], "path string, content binary")
    cells, parts = files.decode_books(books)
    read = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert read(cells) == read(files.decode_cells(books)) and read(parts) == read(files.decode_parts(books))
    assert sorted((c.file, c.row) for c in cells.collect()) == [("good", 1), ("good", 2), ("good", 3), ("half", 1)]
    assert sorted((p.file, p.kind) for p in parts.collect()) == [("bad", "broken"), ("good", "link"), ("good", "merged"), ("half", "broken"), ("half", "link"), ("half", "merged")]
    parsed, parse = [], files.ET.iterparse
    monkeypatch.setattr(files.ET, "iterparse", lambda f: parsed.append(f) or parse(f))
    assert [c is None for c, _ in files._book_of("good", good)] == [False] * 3 + [True] * 2 and len(parsed) == 1
