"""Lineage over cell graphs: expansion of a figure into its inputs, and source tracing of quantities.

Both walk the graph level by level, all files and items together; every level is written to the shared folder, so the
plan stays short and a lost executor costs no recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions import formulas as S
from claimgrid.functions.classify import proof_of_group, root_data_group
from claimgrid.functions.similarity import folded_similarity
from claimgrid.functions.text import fold
from claimgrid.operators import grid
from claimgrid.session import cut_lineage, one_exchange, sized

CELL = ["file", "sheet", "row", "col"]


def auto_target(cells: DataFrame, label: str = "tt_ky_nay") -> DataFrame:
    """Cell that holds the requested payment of each file, found by its label."""
    return grid.labelled_totals(cells).filter(F.col("label") == label).select(*CELL)


# --- source tracing --------------------------------------------------------------------------------------------
# References stay inside a workbook. Tables are dealt out by workbook (`by_file`) and joined as they lie, without an exchange for every
# join on sheets, rows and columns, and never broadcast: their files are many times smaller than they are in memory.
def by_file(df: DataFrame) -> DataFrame:
    return df.repartition("file").hint("merge")


def trace_nodes(cells: DataFrame, measure: str = "ratio", views: grid.Views | None = None) -> DataFrame:
    """One row per formula with what a trace step needs to know about it and about where it may go next: `ref` is the cell read by
    its shape, `away` that of another sheet, where the traced quantity may decide for it."""
    views = views or grid.Views(cells)
    h = F.coalesce(fold(F.col("header")), F.lit(""))
    pri = F.when(h.contains("luy ke") & ~h.contains("truoc"), 0).when(h.rlike("k[iy] nay"), 1).otherwise(2)
    head = views.headers.select("file", F.col("sheet").alias("r_sheet"), F.col("col").alias("c1"), pri.alias("pri"), h.rlike(r"hop dong|\bhd\b").alias("is_contract"))
    known = views.sheets.select("file", F.col("sheet").alias("r_sheet"), F.lit(True).alias("known"))
    single = F.expr("c1 = c2 and r1 = r2 and ext is null")
    refs = views.refs.select(*CELL, "v_num", "ref_no", "r_sheet", "r1", "c1", single.alias("single"), F.col("ext").isNotNull().alias("ext"))
    tgt = cells.filter("v_num is not null").select("file", F.col("sheet").alias("r_sheet"), F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("v_num").alias("t_num"))
    # both ends of a reference read the same exchange of the labels: one column with the mark of a long label before the folded text
    lab = by_file(views.labels.select(*grid.KEY, "row", F.concat(F.when(F.length("label") >= 6, "+").otherwise("-"), "folded").alias("lab")))
    d = (by_file(refs).join(by_file(known), ["file", "r_sheet"], "left").join(by_file(head), ["file", "r_sheet", "c1"], "left").join(by_file(tgt), ["file", "r_sheet", "r1", "c1"], "left")
         .join(lab.withColumnRenamed("lab", "a"), ["file", "sheet", "row"], "left")
         .join(lab.select("file", F.col("sheet").alias("r_sheet"), F.col("row").alias("r1"), F.col("lab").alias("b")), ["file", "r_sheet", "r1"], "left"))
    text = lambda c: F.coalesce(F.substring(c, 2, 2 ** 31 - 1), F.lit(""))
    a, b, single = text("a"), text("b"), F.col("single")
    cross = single & (F.col("r_sheet") != F.col("sheet")) & F.coalesce(F.col("a").startswith("+"), F.lit(False))
    same = a == b
    # only pairs that are not plainly equal reach the similarity
    sim = folded_similarity(F.when(cross & ~same, a).otherwise(""), F.when(cross & ~same, b).otherwise(""), measure)
    off = cross & ~same & F.coalesce(sim < 0.6, F.lit(True))
    to = F.struct(F.col("r_sheet").alias("sheet"), F.col("r1").alias("row"), F.col("c1").alias("col"), F.coalesce("known", F.lit(False)).alias("known"),
                  off.alias("off"), F.coalesce("is_contract", F.lit(False)).alias("is_contract"), F.col("t_num").alias("num"))
    elsewhere = F.col("r_sheet") != F.col("sheet")
    equal = F.coalesce(F.abs(F.col("t_num") - F.col("v_num")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("v_num")), F.lit(False))
    kn = single & F.coalesce("known", F.lit(False))
    g = d.groupBy(*CELL).agg(
        F.count("*").alias("n_refs"), F.count(F.when(single, 1)).alias("n_single"), F.max("ext").alias("has_ext"),
        F.min_by(to, F.when(single, F.col("ref_no"))).alias("first_ref"), F.min_by(to, F.when(single, F.struct(F.coalesce("pri", F.lit(2)).alias("p"), "ref_no"))).alias("sum_ref"),
        F.min_by(to, F.when(kn & elsewhere, F.col("ref_no"))).alias("away_ref"),
        F.min_by(to, F.when(kn & equal, F.struct((~elsewhere).alias("s"), "ref_no"))).alias("equal_ref"), F.min_by(to, F.when(kn, F.col("ref_no"))).alias("any_ref"))
    f = F.col("formula")
    alone = (F.col("n_refs") == 1) & (F.col("n_single") == 1)
    # a pattern is sought only where the number of references leaves it open
    n = by_file(grid.formulas(cells).select(*CELL, "sheet_state", "formula", "v_num")).join(g.hint("merge"), CELL, "left").withColumns({
        "n_refs": F.coalesce("n_refs", F.lit(0)), "n_single": F.coalesce("n_single", F.lit(0)), "has_ext": F.coalesce("has_ext", F.lit(False))})
    n = n.withColumns({"one": F.when(alone, S.is_single_ref(f)), "plus": F.when((F.col("n_refs") >= 2) & (F.col("n_single") == F.col("n_refs")), S.is_sum_of_refs(f)),
                       "branch": S.is_branching(f), "factor": F.when(alone, F.size(S.embedded_literals(f)) > 0)}).withColumns(_shape())
    other = F.coalesce("equal_ref", "away_ref", "any_ref")
    open_ = F.col("is_branch") & ~F.col("is_one") & ~F.col("is_scaled") & ~F.col("is_plus")
    ref = F.when(F.col("is_one"), F.col("first_ref")).when(F.col("is_plus"), F.col("sum_ref")).when(F.col("is_branch"), other)
    return n.select(*CELL, "sheet_state", F.lit(True).alias("is_f"), "v_num", F.lit(False).alias("is_text"), "has_ext", (F.col("n_refs") == 1).alias("lone"),
                    "is_one", "is_scaled", "is_plus", "is_branch", ref.alias("ref"), F.when(open_, F.col("away_ref")).alias("away"))


def met_nodes(starts: DataFrame, cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """The cells that a trace may come to, formulas (`nodes`) and plain cells, which read nothing: starts and what formulas lead to."""
    at = lambda c: nodes.filter(F.col(c).isNotNull()).select("file", f"{c}.sheet", f"{c}.row", f"{c}.col")
    met = by_file(starts.select(*CELL).unionByName(at("ref")).unionByName(at("away")))
    plain = cells.filter("formula is null").select(*CELL, "sheet_state", F.lit(False).alias("is_f"), "v_num", F.col("v_str").isNotNull().alias("is_text"),
                                                   *(F.lit(False).alias(c) for c in ("has_ext", "lone", "is_one", "is_scaled", "is_plus", "is_branch")))
    return by_file(nodes.unionByName(plain, allowMissingColumns=True)).join(met, CELL, "left_semi")


ITEM = ["file", "item", "sheet", "row", "col", "kl_hd", "hops", "flags"]


def _near(x, k):
    """x is the contract quantity k."""
    return F.coalesce(k.isNotNull() & (k != 0) & (F.abs(x - k) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(k))), F.lit(False))


def _shape() -> dict:
    """Columns over a formula that tell how a trace leaves it."""
    one = (F.col("n_refs") == 1) & (F.col("n_single") == 1) & F.coalesce("one", F.lit(False))
    return {"is_one": one, "is_scaled": ~one & (F.col("n_refs") == 1) & (F.col("n_single") == 1) & F.coalesce("factor", F.lit(False)),
            "is_plus": F.coalesce("plus", F.lit(False)) & (F.col("n_single") == F.col("n_refs")) & (F.col("n_refs") >= 2),
            "is_branch": F.coalesce("branch", F.lit(False))}


def _passing_flags():
    plain = F.col("is_f") & ~F.col("is_one") & ~F.col("is_scaled")
    return [F.when(F.col("sheet_state") != "visible", "qua sheet ẩn"), F.when(plain & F.col("is_plus"), "cộng/trừ nhiều ô"), F.when(plain & ~F.col("is_plus") & F.col("is_branch"), "có IF/MIN/MAX")]


def _step(cur: DataFrame, nodes: DataFrame, cyclic: bool = False) -> DataFrame:
    """One hop of every item: its source class where the trace ends (nguon), else the next cell (nxt). cyclic: cur carries the
    cells it has passed, and a trace that comes back to one ends there."""
    j = cur.join(nodes.hint("merge"), CELL, "left").withColumn("is_f", F.coalesce("is_f", F.lit(False)))
    v, k, is_f = F.col("v_num"), F.col("kl_hd"), F.col("is_f")
    capped = F.col("away").isNotNull() & F.coalesce(F.col("away.num") > k + 1e-9, F.lit(False)) & _near(v, k)
    to = F.when(capped, F.col("away")).otherwise(F.col("ref"))
    branch = F.col("is_branch") & F.col("ref").isNotNull()
    rate = F.coalesce(k.isNotNull() & (k != 0) & (v / F.when(k != 0, k) > 0) & (v / F.when(k != 0, k) < 1), F.lit(False))
    here = F.struct("sheet", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"))
    again = F.array_contains("passed", here) if cyclic else F.lit(False)
    cls = (F.when(~is_f & v.isNull() & ~F.coalesce("is_text", F.lit(False)), X.SRC_EMPTY).when(~is_f & v.isNotNull(), X.SRC_TYPED)
           .when(~is_f | again, X.SRC_OTHER).when(F.col("has_ext"), X.SRC_EXTERNAL)
           .when(F.col("is_one"), F.when(_near(v, k) & F.col("ref.known") & F.col("ref.is_contract"), X.SRC_EQUALS)
                 .when(F.col("ref.off"), X.SRC_WRONG_ROW).when(~F.col("ref.known"), X.SRC_EMPTY))
           .when(F.col("is_scaled"), F.when(rate, X.SRC_RATE).otherwise(X.SRC_FACTOR))
           .when(F.col("is_plus"), F.when(F.col("ref.off"), X.SRC_WRONG_ROW))
           .when(branch, F.when(F.coalesce(F.col("away.off"), F.lit(False)) | to["off"], X.SRC_WRONG_ROW))
           .when(_near(v, k) & F.col("lone"), X.SRC_EQUALS).otherwise(X.SRC_COMPUTED))
    hidden, plus, cond = _passing_flags()
    flags = [hidden, F.when(~is_f & _near(v, k) & (F.col("hops") > 0), "số gõ tay đúng bằng KL HĐ"), plus, cond, F.when(cond.isNotNull() & branch & capped, "đang bị chặn về KL HĐ")]
    passed = [F.concat("passed", F.array(here)).alias("passed")] if cyclic else []
    nxt = F.struct(*(to[c].alias(c) for c in ("sheet", "row", "col")))
    return j.withColumns({"nguon": cls, "nxt": nxt, "flags": F.array_distinct(F.concat("flags", F.array_compact(F.array(*flags))))}).select(*ITEM, "nguon", "nxt", *passed)


def _moved(step: DataFrame, *more) -> DataFrame:
    """The items of a step whose trace goes on, at their next cell."""
    to = {c: F.col(f"nxt.{c}") for c in ("sheet", "row", "col")} | {"hops": F.col("hops") + 1}
    return step.filter("nguon is null").select(*(to[c].alias(c) if c in to else c for c in ITEM), *more)


def jump_tables(nodes: DataFrame) -> tuple[list, DataFrame]:
    """(tables, cyclic): table j leads each cell over 2^j ordinary hops to the cell it ends at, with the flags met on the way and
    the least and greatest watched value of the cells it leaves.

    A hop is ordinary while the contract quantity of the traced item doesn't change it; it changes it only at cells that watch
    for it, where it equals their value. Tables end where no trace is that long; cells of longer traces than there are cells run
    into a cycle and are given as `cyclic`.
    """
    branch = F.col("is_branch") & F.col("ref").isNotNull()
    to = (F.when(~F.col("is_f") | F.col("has_ext") | F.col("is_scaled"), None)
          .when(F.col("is_one"), F.when(~F.col("ref.off") & F.col("ref.known"), F.col("ref")))
          .when(F.col("is_plus") | branch, F.when(~F.coalesce(F.col("away.off"), F.lit(False)) & ~F.col("ref.off"), F.col("ref"))))
    watch = F.when((F.col("is_one") & F.col("ref.is_contract")) | F.col("away").isNotNull(), F.col("v_num"))
    one = nodes.withColumn("to", to).filter("to is not null").select(
        *CELL, F.col("to.sheet").alias("t_sheet"), F.col("to.row").alias("t_row"), F.col("to.col").alias("t_col"), F.array_compact(F.array(*_passing_flags())).alias("met"), watch.alias("low"), watch.alias("high"))
    tables = [cut_lineage(one)]
    longest = tables[0].count().bit_length()
    while not tables[-1].isEmpty():
        if len(tables) > longest:
            return tables[:-1], tables[-1].select(*CELL)
        half = tables[-1]
        then = half.select("file", F.col("sheet").alias("t_sheet"), F.col("row").alias("t_row"), F.col("col").alias("t_col"), F.struct("t_sheet", "t_row", "t_col", "met", "low", "high").alias("n"))
        tables.append(cut_lineage(by_file(half).join(then.hint("merge"), ["file", "t_sheet", "t_row", "t_col"]).select(
            *CELL, "n.t_sheet", "n.t_row", "n.t_col", F.array_distinct(F.concat("met", "n.met")).alias("met"), F.least("low", "n.low").alias("low"), F.greatest("high", "n.high").alias("high"))))
    return tables[:-1], tables[-1].select(*CELL)


def _lifted(cur: DataFrame, tables: list) -> DataFrame:
    """Items led along the jump tables, longest first, as far as no cell they leave may turn for their contract quantity."""
    k = F.col("kl_hd")
    slack = 2e-6 * F.greatest(F.lit(1.0), F.abs(k))          # wider than the test itself: a hop is only taken where it is sure
    for j, table in reversed(list(enumerate(tables))):
        met = cur.join(table.hint("merge"), CELL, "left")
        turns = F.coalesce((k != 0) & (F.col("low") <= k + slack) & (F.col("high") >= k - slack), F.lit(False))
        go = F.col("t_sheet").isNotNull() & ~turns
        to = {c: F.when(go, F.col(f"t_{c}")).otherwise(F.col(c)) for c in ("sheet", "row", "col")}
        to |= {"hops": F.when(go, F.col("hops") + (1 << j)).otherwise(F.col("hops")), "flags": F.when(go, F.array_distinct(F.concat("flags", "met"))).otherwise(F.col("flags"))}
        cur = met.select(*(to[c].alias(c) if c in to else c for c in ITEM))
    return cur


def trace_sources(items: DataFrame, cells: DataFrame, measure: str = "ratio", views: grid.Views | None = None) -> DataFrame:
    """Class of the source behind each item's quantity cell.

    items: file, item, sheet, row, col, kl_hd.  Result: file, item, nguon, hops, flags, last sheet/row/col.  A chain is followed
    to its end; one that comes back to a cell it has passed ends there.  Cells lead on by pointer doubling (`jump_tables`), so a
    chain of n hops takes some log2(n) rounds, plus one for each cell at which the item's own contract quantity decides; only
    traces into a cycle are walked hop by hop.
    """
    with one_exchange(cells.sparkSession):
        nodes = cut_lineage(met_nodes(items, cells, cut_lineage(trace_nodes(cells, measure, views))))
        tables, cyclic = jump_tables(nodes)
        start = items.select("file", "item", "sheet", "row", "col", "kl_hd", F.lit(0).alias("hops"), F.array().cast("array<string>").alias("flags"))
        ends = ["file", "item", "nguon", "hops", "flags", "sheet", "row", "col"]
        round_trip = cyclic.distinct()
        cur, done = start.join(round_trip, CELL, "left_anti"), []
        loop = start.join(round_trip, CELL, "left_semi")
        while True:
            step = cut_lineage(_step(_lifted(by_file(cur), tables), nodes))
            done.append(step.filter("nguon is not null").select(*ends))
            cur = _moved(step)
            if cur.isEmpty():
                break
            loop = loop.unionByName(cur.join(round_trip, CELL, "left_semi"))
            cur = cur.join(round_trip, CELL, "left_anti")
        passed = F.array().cast("array<struct<sheet:string,row:bigint,col:bigint>>").alias("passed")
        loop = loop.select(*ITEM, passed)
        while not loop.isEmpty():
            step = cut_lineage(_step(by_file(loop), nodes, True))
            done.append(step.filter("nguon is not null").select(*ends))
            loop = _moved(step, "passed")
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return out


def source_strata(traced: DataFrame) -> DataFrame:
    """Items and values per source."""
    return traced.groupBy("file", "nguon").agg(F.count("*").alias("n"), F.sum("gt_kn").alias("gt_kn"), F.sum("gt_lk").alias("gt_lk"))


# --- expansion tree --------------------------------------------------------------------------------------------
PATH = "array<struct<part:int,no:bigint>>"
BOX = ["c1", "r1", "c2", "r2"]


def _at(*steps):
    """A piece of a path from (part, number) pairs; part 0 comes before part 1."""
    return F.array(*(F.struct(F.lit(part).alias("part"), F.lit(no).cast("bigint").alias("no")) for part, no in steps)).cast(PATH)


def range_contents(ranges: DataFrame, node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed, patterns) of ranges(file, sheet, c1, r1, c2, r2): number, sum and first place of the typed numbers; and per formula
    pattern its number, its rank (most first, then the first in the range) and the cell that stands for it, that of the
    greatest value."""
    first = (F.min, F.struct("row", "col"))
    typed = grid.range_aggregates(ranges, node.filter("formula is null and v_num is not null"), {"n": (F.sum, F.lit(1)), "value": (F.sum, F.col("v_num")), "first": first})
    formulas = node.filter("formula is not null").withColumn("pattern", S.formula_pattern(F.col("formula"), F.col("row"), F.col("col")))
    high = F.struct(F.coalesce(F.abs("v_num"), F.lit(-1.0)).alias("v"), (-F.col("row")).alias("row"), (-F.col("col")).alias("col"))
    found = grid.range_aggregates(ranges, formulas, {"n": (F.sum, F.lit(1)), "high": (F.max, high), "first": first}, ["pattern"])
    rank = F.row_number().over(W.partitionBy("file", "sheet", *BOX).orderBy(F.desc("n"), "first"))
    return typed, found.select("file", "sheet", *BOX, "n", rank.alias("rank"), (-F.col("high.row")).alias("rep_row"), (-F.col("high.col")).alias("rep_col"))


def trace_tree(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Expand each file's target cell into its inputs.

    Rows: file, path (sortable), level, kind, sheet, row, col, text, value.  A cell is expanded where a depth-first walk meets it
    first; other places are marked as already expanded.  A range becomes one node, one summed leaf for its typed cells and one
    representative per formula pattern.  The walk ends where nothing new is reached.

    The place where a depth-first walk meets a cell first is the least path to it.  Rounds pass the least known path of each cell
    that got a smaller one on to what it reads, until none gets smaller; the inputs of a cell, ranges included, are worked out
    once, in the round that first reaches it: only formulas that the walk meets are parsed.  Cells are read in every round, so
    they should be a stored table.
    """
    known = sized(grid.sheets(cells).select("file", F.col("sheet").alias("r_sheet"), F.lit(True).alias("known")))
    targets = cut_lineage(targets.select(*CELL).distinct())
    to = [F.col("t_sheet").alias("sheet"), F.col("t_row").alias("row"), F.col("t_col").alias("col")]
    least = frontier = sized(targets.select(*CELL, F.array().cast(PATH).alias("path")))
    new, read, typed, patterns, edges = least, [], [], [], []
    while not frontier.isEmpty():
        met = grid.formulas(cells).join(new.select(*CELL), CELL, "left_semi")
        r = cut_lineage(grid.references(met).select(*CELL, "ref_no", "r_sheet", *BOX, "ext").join(known, ["file", "r_sheet"], "left"))
        if not r.isEmpty():
            inside = r.filter("ext is null and known")
            single = F.expr("c1 = c2 and r1 = r2")
            here = inside.filter(single).select(*CELL, F.col("r_sheet").alias("t_sheet"), F.col("r1").alias("t_row"), F.col("c1").alias("t_col"), _at((1, F.col("ref_no"))).alias("piece"))
            asked = inside.filter(~single).select(*CELL, "ref_no", "r_sheet", *BOX)
            if not asked.isEmpty():
                ranges = asked.select("file", F.col("r_sheet").alias("sheet"), *BOX).distinct()
                of_typed, of_formulas = (d.withColumnRenamed("sheet", "r_sheet") for d in range_contents(ranges, cells))
                typed.append(cut_lineage(asked.join(of_typed, ["file", "r_sheet", *BOX])))
                patterns.append(cut_lineage(asked.join(of_formulas, ["file", "r_sheet", *BOX])))
                here = here.unionByName(patterns[-1].select(*CELL, F.col("r_sheet").alias("t_sheet"), F.col("rep_row").alias("t_row"), F.col("rep_col").alias("t_col"), _at((1, F.col("ref_no")), (1, F.col("rank")), (0, 0)).alias("piece")))
            edges.append(cut_lineage(here))
            if len(edges) > 4:                              # few tables to read in a round
                edges = [cut_lineage(_union(edges))]
            read.append(r)
        offers = [e.join(frontier, CELL).select("file", *to, F.concat("path", "piece").alias("offer")) for e in edges]
        if not offers:
            break
        offer = _union(offers).groupBy(*CELL).agg(F.min("offer").alias("offer"))
        better = offer.join(least, CELL, "left").filter("path is null or offer < path")
        frontier = sized(better.select(*CELL, F.col("offer").alias("path"), F.col("path").isNull().alias("fresh")))
        new = frontier.filter("fresh")
        frontier = frontier.drop("fresh")
        least = sized(least.join(frontier.select(*CELL), CELL, "left_anti").unionByName(frontier))
    node = sized(cells.select(*CELL, "formula", "v_num", "v_str").join(least.select(*CELL), CELL, "left_semi"))
    return _tree_rows(least, targets, node, read, typed, patterns, edges)


def _union(parts: list) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tree_rows(least, targets, node, read, typed, patterns, edges) -> DataFrame:
    """The rows of the tree from the least path of each cell and what its formula reads. node: the cells that have one."""
    cols = ["file", "path", "kind", "sheet", "row", "col", "text", "value"]
    none = F.lit(None).cast("double").alias("value")
    row = lambda df, piece, kind, sheet, r, c, text, value: df.select("file", F.concat("path", piece).alias("path"), F.lit(kind).alias("kind"), F.col(sheet).alias("sheet"), F.col(r).alias("row"), F.col(c).alias("col"), text.alias("text"), value.alias("value"))
    root = targets.select(*CELL, F.array().cast(PATH).alias("path"))
    places = root
    for e in edges:
        places = places.unionByName(e.join(least, CELL).select("file", F.col("t_sheet").alias("sheet"), F.col("t_row").alias("row"), F.col("t_col").alias("col"), F.concat("path", "piece").alias("path")))
    met = places.join(node, CELL, "left").join(least.withColumnRenamed("path", "own"), CELL)
    kind = (F.when(F.col("path") != F.col("own"), "Đã phân rã").when(F.col("formula").isNotNull(), "Công thức").when(F.col("v_num").isNotNull(), "Nhập tay")
            .when(F.col("v_str").isNotNull(), "Chữ").otherwise("Trống"))
    out = [met.withColumns({"kind": kind, "text": F.coalesce("formula", F.lit("")), "value": F.col("v_num")}).select(*cols)]
    lit = least.join(node, CELL).select(*CELL, "path", F.posexplode(S.embedded_literals(F.col("formula"))).alias("i", "text"))
    out.append(row(lit, _at((0, F.col("i"))), "Tham số gõ cứng", "sheet", "row", "col", F.col("text"), none))
    if read:
        r = _union(read).join(least, CELL)
        piece = _at((1, F.col("ref_no")))
        for kind, which in (("File ngoài", "ext is not null"), ("Lỗi tham chiếu", "ext is null and known is null"), ("Dải", "ext is null and known and (c1 <> c2 or r1 <> r2)")):
            out.append(row(r.filter(which), piece, kind, "r_sheet", "r1", "c1", F.lit(""), none))
    if typed:
        t = _union(typed).join(least, CELL).withColumns({"f_row": F.col("first.row"), "f_col": F.col("first.col")})
        out.append(row(t, _at((1, F.col("ref_no")), (0, 0)), "Nhóm nhập tay", "r_sheet", "f_row", "f_col", F.col("n").cast("string"), F.col("value")))
        p = _union(patterns).join(least, CELL)
        out.append(row(p, _at((1, F.col("ref_no")), (1, F.col("rank"))), "Mẫu", "r_sheet", "rep_row", "rep_col", F.col("n").cast("string"), none))
    return _union(out).withColumn("level", F.size("path"))


def path_columns(tree: DataFrame) -> DataFrame:
    """Columns that the target is made of: those of every row of the tree with an address in the file, of a range its first."""
    return tree.filter("kind not in ('Mẫu', 'Nhóm nhập tay', 'File ngoài', 'Lỗi tham chiếu')").select("file", "sheet", "col").distinct()


def k7_findings(tree: DataFrame, cells: DataFrame, views: grid.Views | None = None) -> DataFrame:
    """Typed inputs outside the seven groups, and external leaves, per file."""
    from claimgrid.operators.quality import collect_findings, finding
    views = views or grid.Views(cells)
    head, lab = views.headers, views.labels.hint("merge")
    leaf = tree.filter("kind in ('Nhập tay', 'Nhóm nhập tay')").join(head, ["file", "sheet", "col"], "left").join(lab, ["file", "sheet", "row"], "left")
    grp = root_data_group(F.col("header"), F.when(F.col("kind") == "Nhập tay", F.col("label")).otherwise(""), F.col("sheet"))
    leaf = leaf.withColumn("nhom", grp)
    bad = leaf.filter(F.col("nhom") == X.GROUP_OUTSIDE).groupBy("file").agg(F.count("*").alias("n")).select(*finding("K7", X.HIGH, F.col("file"), "inputs outside the seven groups", F.col("n")))
    ext = tree.filter("kind = 'File ngoài'").groupBy("file").agg(F.count("*").alias("n")).select(*finding("K7", X.HIGH, F.col("file"), "external inputs", F.col("n")))
    return collect_findings(bad, ext)


def leaf_summary(tree: DataFrame) -> DataFrame:
    return tree.filter("kind in ('Nhập tay', 'Nhóm nhập tay', 'File ngoài', 'Tham số gõ cứng')").groupBy("file", "kind").agg(F.count("*").alias("n"))


THIS, PRIOR, NO_PRIOR = "luy ke", "ky truoc", "0 / không có"


def trace_quantities(cells: DataFrame, measure: str = "ratio", views: grid.Views | None = None) -> tuple[DataFrame, DataFrame]:
    """(cumulative, prior) sources of every priced line of the detail tables, all cells traced in one walk.

    cumulative: file, item, nguon, hops, flags, gt_kn, gt_lk of the cumulative quantity (this period's where a table has none).
    prior: file, item, nguon of the prior periods' quantity, with a mark where it comes through a hidden sheet; lines without a
    prior quantity have a class of their own.
    """
    layouts = grid.detail_layouts(cells)
    rows = cut_lineage(grid.detail_table(cells, layouts).filter("dvt <> ''"))
    where = layouts.select("file", "sheet", F.coalesce("kl_lk", "kl_kn").alias("lk_col"), F.col("kl_kt").alias("kt_col"))
    at = cut_lineage(rows.join(where, ["file", "sheet"]))
    root = lambda which, col: at.select("file", F.struct(F.col("dong"), F.lit(which).alias("which")).alias("item"), "sheet", F.col("dong").alias("row"), F.col(col).alias("col"), "kl_hd")
    has_prior = F.col("kt_col").isNotNull() & (F.coalesce("kl_kt", F.lit(0.0)) != 0)
    priors = at.filter(has_prior).select("file", F.struct(F.col("dong"), F.lit(PRIOR).alias("which")).alias("item"), "sheet", F.col("dong").alias("row"), F.col("kt_col").alias("col"), "kl_hd")
    found = cut_lineage(trace_sources(root(THIS, "lk_col").unionByName(priors), cells, measure, views).select("file", "item.dong", "item.which", "nguon", "hops", "flags"))
    price = F.coalesce("don_gia", F.lit(0.0))
    value = lambda gt, kl: F.coalesce(gt, F.coalesce(kl, F.lit(0.0)) * price).alias(gt)
    values = at.select("file", F.col("dong"), value("gt_kn", "kl_kn"), value("gt_lk", "kl_lk"))
    of = lambda which: found.filter(F.col("which") == which).drop("which")
    cumulative = of(THIS).join(values.hint("merge"), ["file", "dong"]).withColumnRenamed("dong", "item")
    marked = F.concat("nguon", F.when(F.array_contains("flags", "qua sheet ẩn"), " (qua sheet ẩn)").otherwise(""))
    prior = of(PRIOR).select("file", F.col("dong").alias("item"), marked.alias("nguon")).unionByName(at.filter(~has_prior).select("file", F.col("dong").alias("item"), F.lit(NO_PRIOR).alias("nguon")))
    return cumulative, prior


def prior_strata(prior: DataFrame) -> DataFrame:
    """Lines per source of the prior quantity."""
    return prior.filter(F.col("nguon") != NO_PRIOR).groupBy("file", "nguon").agg(F.count("*").alias("n"))


def k8_findings(traced: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Source strata that call for proof, and capped quantities; with prior, the sources of prior quantities as well."""
    from claimgrid.operators.quality import collect_findings, finding
    st = source_strata(traced)
    high = [X.SRC_TYPED, X.SRC_EQUALS, X.SRC_EMPTY, X.SRC_WRONG_ROW, X.SRC_EXTERNAL]
    a = st.filter(F.col("nguon").isin(high)).select(*finding("K8", X.HIGH, F.col("file"), F.col("nguon"), F.col("n"), F.col("gt_lk")))
    b = st.filter(F.col("nguon") == X.SRC_RATE).select(*finding("K8", X.MEDIUM, F.col("file"), F.col("nguon"), F.col("n"), F.col("gt_lk")))
    c = (traced.filter(F.array_contains("flags", "đang bị chặn về KL HĐ")).groupBy("file").agg(F.count("*").alias("n"))
         .select(*finding("K8", X.MEDIUM, F.col("file"), "capped at the contract quantity", F.col("n"))))
    out = [a, b, c]
    if prior is not None:
        k = F.col("nguon")
        grave = k.contains(X.SRC_TYPED) | k.contains("sheet ẩn")
        asks = k.startswith(X.SRC_TYPED) | k.startswith("Tỷ lệ") | k.contains("sheet ẩn")
        out.append(prior_strata(prior).filter(asks).select(*finding("K8", F.when(grave, X.HIGH).otherwise(X.MEDIUM), F.col("file"), F.concat(F.lit("prior: "), k), F.col("n"))))
    return collect_findings(*out)


def source_grouped_range(items: DataFrame, measure: str, source: str) -> DataFrame:
    """A range over one measure summarised by item source."""
    return items.groupBy("file", F.col(source).alias("nguon")).agg(F.count("*").alias("n"), F.sum(measure).alias("value"))
