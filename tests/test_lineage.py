"""Lineage beyond the depth of any ordinary workbook, with cycles."""

from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.operators import lineage

CELLS = "file string, sheet string, sheet_idx int, sheet_state string, row int, col int, formula string, v_num double, v_str string"


def chain(n, end):
    rows = [("f", "S", 0, "visible", r, 2, f"=B{r + 1}", 5.0, None) for r in range(1, n)]
    return rows + [("f", "S", 0, "visible", n, 2, end, 5.0, None)]


def test_long_chain_and_cycle(spark):
    items = "file string, item int, sheet string, row int, col int, kl_hd double"
    item = spark.createDataFrame([("f", 1, "S", 1, 2, 9.0)], items)
    typed = lineage.trace_sources(item, spark.createDataFrame(chain(11, None), CELLS), "edit").first()
    assert (typed.nguon, typed.hops, typed.row) == (X.SRC_TYPED, 10, 11)
    cyclic = lineage.trace_sources(item, spark.createDataFrame(chain(3, "=B2"), CELLS), "edit").first()
    assert cyclic.nguon == X.SRC_OTHER


def test_tree_reaches_the_deepest_input(spark):
    cells = spark.createDataFrame(chain(16, None), CELLS)
    target = spark.createDataFrame([("f", "S", 1, 2)], "file string, sheet string, row int, col int")
    tree = lineage.trace_tree(cells, target).collect()
    assert [(r.row, r.level) for r in tree if r.kind == "Nhập tay"] == [(16, 15)]
    cyclic = lineage.trace_tree(spark.createDataFrame(chain(2, "=B1"), CELLS), target).collect()
    assert sum(r.kind == "Đã phân rã" for r in cyclic) == 1 and len(cyclic) == 3


def test_tree_parses_only_formulas_it_meets(spark, monkeypatch):
    cells = spark.createDataFrame(chain(4, None) + [("f", "T", 1, "visible", r, 1, "=A1", 5.0, None) for r in range(1, 30)], CELLS)
    target = spark.createDataFrame([("f", "S", 1, 2)], "file string, sheet string, row int, col int")
    parsed, references = [], lineage.grid.references
    monkeypatch.setattr(lineage.grid, "references", lambda c: parsed.append(lineage.grid.formulas(c).count()) or references(c))
    assert len(lineage.trace_tree(cells, target).collect()) == 4
    assert sum(parsed) == 3


def test_columns_that_one_range_reads_need_no_blocks(spark):
    box = "file string, sheet string, c1 int, r1 int, c2 int, r2 int"
    rng = spark.createDataFrame([("f", "S", 1, 3, 2, 70), ("f", "S", 2, 60, 3, 900), ("f", "S", 3, 1, 3, 600), ("f", "S", 5, 9, 4, 2)], box)
    cells = spark.createDataFrame([("f", "S", r, c, float(r * c)) for r in range(1, 800, 3) for c in range(1, 6)], "file string, sheet string, row int, col int, v double")
    found = lineage.grid.range_aggregates(rng, cells, {"n": (F.sum, F.lit(1)), "total": (F.sum, F.col("v")), "low": (F.min, F.struct("row", "col"))})
    got = {(r.c1, r.r1): (r.n, r.total, tuple(r.low)) for r in found.collect()}
    points = [(r, c) for r in range(1, 800, 3) for c in range(1, 6)]
    want = {}
    for c1, r1, c2, r2 in ((1, 3, 2, 70), (2, 60, 3, 900), (3, 1, 3, 600)):
        inside = [(r, c) for r, c in points if c1 <= c <= c2 and r1 <= r <= r2]
        want[(c1, r1)] = (len(inside), float(sum(r * c for r, c in inside)), min(inside))
    assert {k: v for k, v in got.items() if k != (5, 9)} == want


def test_literals_count_on_the_columns_the_tree_reaches(spark, monkeypatch):
    """A payment made of columns that the fixed list lacks, beside a listed sheet that it does not reach."""
    import re
    from types import SimpleNamespace

    from claimgrid.workload import all_queries, registry

    formulas = {("S", 1, 2): "=B2*1.08", ("S", 2, 2): "=C3*0.5", ("S", 3, 3): None, ("S", 4, 4): "=C3*0.5", ("Tong hop", 1, 2): "=C1*1.08"}
    rows = [("f", s, 0, "visible", r, c, f, 5.0, None) for (s, r, c), f in formulas.items()]
    cells = spark.createDataFrame(rows, CELLS)
    target = spark.createDataFrame([("f", "S", 1, 2)], "file string, sheet string, row int, col int")
    monkeypatch.setattr(lineage, "auto_target", lambda *_: target)
    monkeypatch.setattr(registry, "World", lambda *_: SimpleNamespace(cells=cells, memo=lambda _, make: make()))
    reached, todo = set(), [("S", 1, 2)]
    while todo:                                          # brute-force walk; columns of its formulas
        at = todo.pop()
        if formulas.get(at):
            reached.add((at[0], at[2]))
            todo += [("S", int(r), ord(c) - 64) for c, r in re.findall(r"([A-Z])(\d+)", formulas[at])]
    want = {x: sum(f is not None and f.endswith("*" + x) and (s, c) in reached for (s, _, c), f in formulas.items()) for x in ("1.08", "0.5")}
    found = all_queries()
    assert {r.literal: r.n_path for r in found["A-16_literal_census"](spark, "").collect()} == want == {"1.08": 1, "0.5": 1}
    assert {r.entity: r.n for r in found["C-K6_literal_findings"](spark, "").collect()} == {"f!1.08": 1, "f!0.5": 1}


def workbook(seed, n_rows=12, cyclic=True):
    """Cells of one file with two sheets; formulas read single cells and ranges anywhere (cyclic) or below their own row."""
    import random
    rnd, cells = random.Random(seed), []
    for sheet in "ST":
        for r in range(1, n_rows + 1):
            for c in range(1, 4):
                pick = rnd.random()
                low = 1 if cyclic else r + 1
                f = v = t = None
                if pick < 0.55 and low < n_rows:
                    parts = []
                    for _ in range(rnd.randint(1, 3)):
                        q = rnd.choice(["", "", "T!" if sheet == "S" else "S!", "Z!", "[1]Q!"])
                        a = rnd.randint(low, n_rows)
                        b = rnd.randint(a, n_rows)
                        x, y = sorted((rnd.randint(1, 3), rnd.randint(1, 3)))
                        parts.append(f"{q}{chr(64 + x)}{a}" + (f":{chr(64 + y)}{b}" if rnd.random() < 0.4 else ""))
                    f, v = "=" + rnd.choice("+-").join(parts) + rnd.choice(["", "*1.08", "*5%"]), rnd.choice([None, 1.0, 2.0, -3.0])
                elif pick < 0.8:
                    v = float(rnd.randint(-4, 9))
                elif pick < 0.9:
                    t = "note"
                if f or v is not None or t:
                    cells.append(("f", sheet, "ST".index(sheet), "visible", r, c, f, v, t))
    return cells


def depth_first(cells, target):
    """Sorted (path, kind, sheet, row, col, text, value) by a depth-first walk."""
    import re
    at = {(s, r, c): (f, v, t) for _, s, _, _, r, c, f, v, t in cells}
    known = {s for s, _, _ in at}
    ref = re.compile(r"(?:((?:\[\d+\])?\w+)!)?([A-Z])(\d+)(?::([A-Z])(\d+))?")
    out, seen = [], set()

    def refs(f, sheet):
        found = [(q or "", ord(a) - 64, int(r), ord(b or a) - 64, int(e or r)) for q, a, r, b, e in ref.findall(f)]
        for q, *box in [x for x in found if x[0]] + [x for x in found if not x[0]]:
            yield (q[3:], True, *box) if q.startswith("[1]") else (q or sheet, False, *box)

    def pattern(f, r, c):
        return ref.sub(lambda m: f"{m[1]}!{ord(m[2]) - 64 - c},{int(m[3]) - r}:{m[4] and ord(m[4]) - 64 - c},{m[5] and int(m[5]) - r}", f)

    def visit(sheet, r, c, path):
        f, v, t = at.get((sheet, r, c), (None, None, None))
        if (sheet, r, c) in seen:
            return out.append((path, "Đã phân rã", sheet, r, c, f or "", v))
        seen.add((sheet, r, c))
        out.append((path, "Công thức" if f else "Nhập tay" if v is not None else "Chữ" if t else "Trống", sheet, r, c, f or "", v))
        if not f:
            return
        for i, x in enumerate(re.findall(r"(?<=\*)(1\.08|5%)", f)):
            out.append((path + ((0, i),), "Tham số gõ cứng", sheet, r, c, x, None))
        for n, (to, ext, c1, r1, c2, r2) in enumerate(refs(f, sheet)):
            here = path + ((1, n),)
            if ext or to not in known:
                out.append((here, "File ngoài" if ext else "Lỗi tham chiếu", to, r1, c1, "", None))
            elif (c1, r1) == (c2, r2):
                visit(to, r1, c1, here)
            else:
                out.append((here, "Dải", to, r1, c1, "", None))
                typed, groups = [], {}
                for rr in range(r1, r2 + 1):
                    for cc in range(c1, c2 + 1):
                        g, v2, _ = at.get((to, rr, cc), (None, None, None))
                        if g:
                            groups.setdefault(pattern(g, rr, cc), []).append((rr, cc, -1.0 if v2 is None else abs(v2)))
                        elif v2 is not None:
                            typed.append((rr, cc, v2))
                if typed:
                    out.append((here + ((0, 0),), "Nhóm nhập tay", to, typed[0][0], typed[0][1], str(len(typed)), sum(x[2] for x in typed)))
                for k, own in enumerate(sorted(groups.values(), key=lambda g: -len(g)), 1):
                    rr, cc, _ = max(own, key=lambda x: x[2])
                    out.append((here + ((1, k),), "Mẫu", to, rr, cc, str(len(own)), None))
                    visit(to, rr, cc, here + ((1, k), (0, 0)))

    visit(*target, ())
    return sorted(out, key=repr)


def test_tree_is_that_of_a_depth_first_walk(spark):
    """Shared and cyclic cells, ranges, external and missing sheets; several files at once."""
    rows, want = [], []
    for seed in range(8):
        cells = workbook(seed, cyclic=seed % 2 == 0)
        cells = [("f" + str(seed), "S", 0, "visible", 1, 1, "=T!A2+A2:C12", 1.0, None)] + [(f"f{seed}", *c[1:]) for c in cells if c[1:2] + c[4:6] != ("S", 1, 1)]
        rows += cells
        want += [(f"f{seed}", *r) for r in depth_first(cells, ("S", 1, 1))]
    targets = spark.createDataFrame([(f"f{seed}", "S", 1, 1) for seed in range(8)], "file string, sheet string, row int, col int")
    tree = lineage.trace_tree(spark.createDataFrame(rows, CELLS), targets).collect()
    found = [(r.file, tuple((p.part, p.no) for p in r.path), r.kind, r.sheet, r.row, r.col, r.text, r.value) for r in tree]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert all(r.level == len(r.path) for r in tree)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """A thousand hops; one watched cell on the way decides for one item only."""
    writes = []
    keep = lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: writes.append(1) or keep(df))
    rows = chain(1000, None)
    rows[500] = ("f", "S", 0, "visible", 501, 2, "=IF(B502>T!B7,T!B7,B502)", 5.0, None)
    rows += [("f", "T", 1, "visible", 7, 2, None, 50.0, None), ("f", "S", 0, "visible", 2000, 2, "=B2001", 1.0, None), ("f", "S", 0, "visible", 2001, 2, "=B2000", 1.0, None)]
    items = spark.createDataFrame([("f", 1, "S", 1, 2, 9.0), ("f", 2, "S", 1, 2, 5.0), ("f", 3, "S", 400, 2, None), ("f", 4, "S", 2000, 2, 3.0), ("f", 5, "S", 3000, 2, 3.0)], "file string, item int, sheet string, row int, col int, kl_hd double")
    found = {r.item: r for r in lineage.trace_sources(items, spark.createDataFrame(rows, CELLS), "edit").collect()}
    assert len(writes) <= 18
    capped = ["có IF/MIN/MAX", "đang bị chặn về KL HĐ"]
    assert (found[1].nguon, found[1].hops, found[1].row, found[1].flags) == (X.SRC_TYPED, 999, 1000, capped[:1])
    assert (found[2].nguon, found[2].hops, found[2].sheet, found[2].row, found[2].flags) == (X.SRC_TYPED, 501, "T", 7, capped)
    assert (found[3].nguon, found[3].hops) == (X.SRC_TYPED, 600)
    assert (found[4].nguon, found[4].hops, found[4].row) == (X.SRC_OTHER, 2, 2000)
    assert found[5].nguon == X.SRC_EMPTY


def test_running_totals_without_members(spark):
    """Ranges of every length over one long column, against prefix sums."""
    from claimgrid.operators import grid
    n = 20_000
    cells = spark.range(1, n + 1).selectExpr("'f' as file", "'S' as sheet", "cast(id as int) as row", "2 as col", "cast(id % 7 as double) as v_num")
    rng = cells.selectExpr("file", "sheet", "2 as c1", "cast(3 as int) as r1", "2 as c2", "row as r2").filter("r2 >= 3")
    found = {r.r2: (r.n, r.total, r.most) for r in grid.range_aggregates(rng, cells, {"n": (F.sum, F.lit(1)), "total": (F.sum, F.col("v_num")), "most": (F.max, F.col("row"))}).collect()}
    total, want = 0.0, {}
    for r in range(3, n + 1):
        total += r % 7
        want[r] = (r - 2, total, r)
    assert found == want


def test_ranges_match_their_members(spark):
    import random

    from claimgrid.operators import grid
    rnd = random.Random(4)
    points = {(rnd.randint(1, 600), rnd.randint(1, 4)): rnd.randint(-9, 9) for _ in range(900)}
    cells = spark.createDataFrame([("f", "S", r, c, float(v), "pq"[v % 2]) for (r, c), v in points.items()], "file string, sheet string, row int, col int, v double, kind string")
    boxes = {(*sorted((rnd.randint(1, 4), rnd.randint(1, 4))), *sorted((rnd.randint(1, 700), rnd.randint(1, 700)))) for _ in range(150)}
    rng = spark.createDataFrame([("f", "S", a, x, b, y) for a, b, x, y in boxes], "file string, sheet string, c1 int, r1 int, c2 int, r2 int")
    found = {(r.c1, r.c2, r.r1, r.r2, r.kind): (r.n, r.low) for r in grid.range_aggregates(rng, cells, {"n": (F.sum, F.lit(1)), "low": (F.min, F.struct("v", "row", "col"))}, ["kind"]).collect()}
    want = {}
    for a, b, x, y in boxes:
        for kind in "pq":
            own = [(float(v), r, c) for (r, c), v in points.items() if x <= r <= y and a <= c <= b and "pq"[v % 2] == kind]
            if own:
                want[a, b, x, y, kind] = (len(own), min(own))
    assert {k: (n, tuple(low)) for k, (n, low) in found.items()} == want


def test_prior_quantities_through_a_hidden_sheet(spark):
    """Two lines: a typed prior quantity, and one that comes from a hidden sheet; a third has none."""
    head = ["STT", "Tên công việc", "Đơn vị", "Khối lượng hợp đồng", "Khối lượng kỳ trước", "Khối lượng kỳ này", "Khối lượng lũy kế đến hết kỳ này", "Đơn giá", "Giá trị hợp đồng", "Giá trị kỳ này", "Giá trị lũy kế đến hết kỳ này"]
    rows = [("f", "C", 0, "visible", 5, i + 1, None, None, h) for i, h in enumerate(head)]
    for r, prior in ((6, None), (7, "=H!A1"), (8, 0.0)):
        rows += [("f", "C", 0, "visible", r, 1, None, float(r), None), ("f", "C", 0, "visible", r, 2, None, None, f"Đào đất số {r}"), ("f", "C", 0, "visible", r, 3, None, None, "m3"), ("f", "C", 0, "visible", r, 4, None, 50.0, None),
                 ("f", "C", 0, "visible", r, 5, prior if isinstance(prior, str) else None, 0.0 if prior == 0.0 else 3.0, None), ("f", "C", 0, "visible", r, 7, None, 9.0, None), ("f", "C", 0, "visible", r, 8, None, 10.0, None)]
    rows += [("f", "H", 1, "hidden", 1, 1, None, 3.0, None), ("f", "H", 1, "hidden", 1, 2, None, None, "Đào đất số 7")]
    done, prior = lineage.trace_quantities(spark.createDataFrame(rows, CELLS), "edit")
    assert {r["item"]: r.nguon for r in prior.collect()} == {6: X.SRC_TYPED, 7: f"{X.SRC_TYPED} (qua sheet ẩn)", 8: lineage.NO_PRIOR}
    assert {r["item"]: (r.nguon, r.gt_lk) for r in done.collect()} == {n: (X.SRC_TYPED, 90.0) for n in (6, 7, 8)}
    found = {(r.message, r.level, r.n) for r in lineage.k8_findings(done, prior).collect()}
    assert {(f"prior: {X.SRC_TYPED}", X.HIGH, 1), (f"prior: {X.SRC_TYPED} (qua sheet ẩn)", X.HIGH, 1)} < found


def test_audit_works_out_shared_tables_once(spark, monkeypatch):
    """The checks of one audit share labels, headers, layouts and the parsed references of all formulas."""
    from claimgrid.plans import flows
    from claimgrid.operators import grid
    calls = []
    for name in ("row_labels", "column_headers", "name_column", "detail_layouts"):
        monkeypatch.setattr(grid, name, lambda *a, name=name, made=getattr(grid, name): calls.append(name) or made(*a))
    whole, references = [], grid.references
    monkeypatch.setattr(grid, "references", lambda c: whole.append(grid.formulas(c).count()) or references(c))
    rows = chain(12, None) + [("f", "S", 0, "visible", r, 1, None, None, f"Đào đất số {r}") for r in range(1, 13)] + [("f", "S", 0, "visible", 3, 3, "=#REF!*2", None, "#REF!")]
    found = {(r.check, r.message, r.n) for r in flows.audit_workbooks(spark.createDataFrame(rows, CELLS)).collect()}
    assert sorted(calls) == ["column_headers", "detail_layouts", "name_column", "row_labels"] and whole.count(12) == 1
    assert ("K1", "formulas lost a reference", 1) in found and not any(m.startswith("check failed") for _, m, _ in found)
