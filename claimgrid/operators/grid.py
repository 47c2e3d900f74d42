"""Cell-grid integrity: profiles, formula patterns, links, hidden sheets, text numbers and literals.

cells: file, sheet, sheet_idx, sheet_state, row, col, formula, v_num, v_str (value columns hold the cached result of a
formula).  Every step is keyed by file and sheet; rows of a sheet are bounded by the spreadsheet format.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions import formulas as S
from claimgrid.functions.classify import root_data_group
from claimgrid.functions.similarity import folded_similarity
from claimgrid.functions.text import fold, squeeze
from claimgrid.operators.quality import collect_findings, finding
from claimgrid.operators.scan import block, first_per, scan
from claimgrid.session import cut_lineage, sized

KEY = ["file", "sheet"]


def visible() -> Column:
    return F.col("sheet_state") == "visible"


def formulas(cells: DataFrame) -> DataFrame:
    return cells.filter("formula is not null")


def typed_numbers(cells: DataFrame) -> DataFrame:
    return cells.filter("formula is null and v_num is not null")


def references(cells: DataFrame) -> DataFrame:
    """Edge table: one row per reference of every formula."""
    f = formulas(cells)
    return (f.select("file", "sheet", "sheet_state", "row", "col", "formula", "v_num", F.posexplode(S.parse_refs(F.col("formula"), F.col("sheet"))).alias("ref_no", "r"))
            .select("file", "sheet", "sheet_state", "row", "col", "formula", "v_num", "ref_no", F.col("r.sheet").alias("r_sheet"), "r.c1", "r.r1", "r.c2", "r.r2", "r.ext"))


def sheets(cells: DataFrame) -> DataFrame:
    return cells.groupBy("file", "sheet").agg(F.min("sheet_idx").alias("sheet_idx"), F.min("sheet_state").alias("sheet_state"))


def sheet_profile(cells: DataFrame) -> DataFrame:
    f = F.col("formula")
    n = lambda c: F.count(F.when(c, 1))
    return cells.groupBy("file", "sheet", "sheet_state").agg(
        F.max("row").alias("n_rows"), F.max("col").alias("n_cols"), n(f.isNotNull()).alias("n_formulas"),
        n(f.isNull() & F.col("v_num").isNotNull()).alias("n_numbers"), n(f.contains("#REF!")).alias("n_ref_errors"),
        n(f.isNotNull() & S.is_error(F.col("v_str"))).alias("n_error_values"),
        n(f.isNotNull() & F.col("v_num").isNull() & F.col("v_str").isNull()).alias("n_uncached"))


def external_usage(cells: DataFrame) -> DataFrame:
    """Uses and distinct columns of each external link index."""
    e = formulas(cells).select("file", "sheet", "col", F.explode(S.external_links(F.col("formula"))).alias("ext"))
    return e.groupBy("file", "ext").agg(F.count("*").alias("n"), F.count_distinct("sheet", "col").alias("n_cols"))


def name_column(cells: DataFrame) -> DataFrame:
    """Column with most long texts of the sheet (2 where there is none)."""
    long = (F.length(F.trim("v_str")) >= 8) & F.col("v_str").rlike("[A-Za-zÀ-ỹ]{3}")
    cnt = cells.filter(long).groupBy("file", "sheet", "col").agg(F.count("*").alias("n"))
    best = cnt.groupBy("file", "sheet").agg(F.max_by("col", F.struct("n", -F.col("col"))).alias("name_col"))
    return sheets(cells).select("file", "sheet").join(best, KEY, "left").withColumn("name_col", F.coalesce("name_col", F.lit(2)))


def row_labels(cells: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Name of each row, as it is and folded, from its sheet's name column."""
    nc = name_column(cells) if names is None else names
    t = squeeze(F.coalesce(F.col("v_str"), F.col("v_num").cast("string")))
    return (cells.join(nc, KEY).filter(F.col("col") == F.col("name_col")).select("file", "sheet", "row", t.alias("label"))
            .filter("label is not null").withColumn("folded", fold(F.col("label"))))


class Views:
    """Tables that several checks derive from the same cells: sheets, references, name columns, row labels and column headers.
    With stored, each is worked out once and written; else they are plans that every reader works out, apart from the name columns:
    a row a sheet, read back with their real size, so that cells stay in place."""

    def __init__(self, cells: DataFrame, stored: bool = False):
        self.cells, self.kept = cells, cut_lineage if stored else (lambda df: df)
        if stored:
            _ = self.sheets, self.refs, self.labels, self.headers

    @functools.cached_property
    def sheets(self) -> DataFrame:
        return self.kept(sheets(self.cells))

    @functools.cached_property
    def refs(self) -> DataFrame:
        return self.kept(references(self.cells))

    @functools.cached_property
    def names(self) -> DataFrame:
        return sized(name_column(self.cells))

    @functools.cached_property
    def labels(self) -> DataFrame:
        return self.kept(row_labels(self.cells, self.names))

    @functools.cached_property
    def headers(self) -> DataFrame:
        return self.kept(column_headers(self.cells))


def header_rows(cells: DataFrame) -> DataFrame:
    """Row with most header words (then most texts, then the first) of the sheet."""
    t = cells.filter(F.length(F.trim("v_str")) >= 2)
    per = t.groupBy("file", "sheet", "row").agg(F.count(F.when(fold(F.col("v_str")).rlike(X.HEADER_WORDS), 1)).alias("kw"), F.count("*").alias("n"))
    best = per.groupBy("file", "sheet").agg(F.max_by("row", F.struct("kw", "n", -F.col("row"))).alias("h"))
    return sheets(cells).select("file", "sheet").join(best, KEY, "left").withColumn("h", F.coalesce("h", F.lit(1)))


def merged_members(ranges: DataFrame) -> DataFrame:
    """Member cells of ranges(file, sheet, r1, c1, r2, c2, a_row, a_col) with the cell that holds their value."""
    rows = ranges.select("file", "sheet", "a_row", "a_col", "c1", "c2", F.explode(F.sequence("r1", "r2")).alias("row"))
    return rows.select("file", "sheet", "row", F.explode(F.sequence("c1", "c2")).alias("col"), "a_row", "a_col")


def column_headers(cells: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Header text of each column: distinct texts of the rows around the header row (seven rows at most). With merged ranges a
    text counts for all columns and rows of its range; only the part of a range near the header row is spread."""
    top = cells.filter(F.col("v_str").isNotNull() & (F.trim("v_str") != "")).select("file", "sheet", "row", "col", "v_str")
    heads = sized(header_rows(cells))                       # a row a sheet: cells stay in place
    by_head = lambda df: df.join(heads, KEY).filter(F.col("row").between(F.col("h") - 3, F.col("h") + 3))
    if merged is not None:
        near = merged.join(heads, KEY).withColumns({"a_row": F.col("r1"), "a_col": F.col("c1"), "r1": F.greatest("r1", F.col("h") - 3), "r2": F.least("r2", F.col("h") + 3)}).filter("r1 <= r2")
        a = merged_members(near)
        spread = (a.join(top.select("file", "sheet", F.col("row").alias("a_row"), F.col("col").alias("a_col"), "v_str"), KEY + ["a_row", "a_col"])
                  .select("file", "sheet", "row", "col", "v_str"))
        texts = top.unionByName(spread.join(top.select(*KEY, "row", "col"), KEY + ["row", "col"], "left_anti"))
    else:
        texts = top
    own = by_head(top).groupBy("file", "sheet", "row").agg(F.count("*").alias("n_text"))
    j = by_head(texts).join(own, KEY + ["row"], "left")
    good = ((F.col("row") == F.col("h")) | (F.coalesce("n_text", F.lit(0)) >= 2)) & ~F.trim("v_str").rlike(r"^[\[\(]?\d+[\]\)]?$")
    g = (j.filter(good).groupBy("file", "sheet", "col").agg(F.array_sort(F.collect_list(F.struct("row", squeeze(F.col("v_str")).alias("t")))).alias("ts")))
    return g.select("file", "sheet", "col", F.array_join(F.array_distinct(F.transform("ts", lambda x: x["t"])), " / ").alias("header"))


# --- formula patterns ------------------------------------------------------------------------------------------
def patterned(cells: DataFrame) -> DataFrame:
    """Visible formulas that are not totals, with their relative pattern."""
    f = formulas(cells).filter(visible() & ~S.is_total(F.col("formula")))
    return f.withColumn("pattern", S.formula_pattern(F.col("formula"), F.col("row"), F.col("col")))


def dominant_patterns(p: DataFrame, least: int = 10) -> DataFrame:
    """Most frequent pattern per column with its share and row span (columns with enough formulas)."""
    c = p.groupBy("file", "sheet", "col", "pattern").agg(F.count("*").alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi"))
    return (c.groupBy("file", "sheet", "col")
            .agg(F.max_by(F.struct("pattern", "n", "lo", "hi"), F.struct("n", -F.col("lo"))).alias("d"), F.sum("n").alias("total"), F.count("*").alias("n_patterns"))
            .filter(F.col("total") >= least)
            .select("file", "sheet", "col", "d.pattern", "d.n", "d.lo", "d.hi", "total", "n_patterns", (F.col("d.n") / F.col("total")).alias("share")))


def clear_columns(dom: DataFrame) -> DataFrame:
    return dom.filter((F.col("n") >= 10) & (F.col("share") >= 0.7))


def pattern_outliers(p: DataFrame, dom: DataFrame) -> DataFrame:
    """Formulas of rare patterns inside the span of a clear dominant pattern."""
    d = clear_columns(dom).select("file", "sheet", "col", F.col("pattern").alias("main"), "lo", "hi")
    rare = (p.groupBy("file", "sheet", "col", "pattern").agg(F.count("*").alias("k")).filter("k <= 2"))
    j = p.join(rare.select("file", "sheet", "col", "pattern"), ["file", "sheet", "col", "pattern"], "left_semi").join(d, ["file", "sheet", "col"])
    return j.filter((F.col("pattern") != F.col("main")) & F.col("row").between(F.col("lo"), F.col("hi")))


def typed_between(cells: DataFrame, dom: DataFrame, views: Views | None = None) -> DataFrame:
    """Typed non-zero numbers inside the span of a clear formula column, on rows that carry data."""
    d = sized(clear_columns(dom).select("file", "sheet", "col", "lo", "hi"))
    t = typed_numbers(cells).filter("v_num <> 0").join(d, ["file", "sheet", "col"]).filter(F.col("row").between(F.col("lo"), F.col("hi")))
    has_f = formulas(cells).select("file", "sheet", "row").distinct().withColumn("has_formula", F.lit(True))
    lab = (views or Views(cells)).labels.drop("folded")
    j = t.join(has_f.hint("merge"), KEY + ["row"], "left").join(lab.hint("merge"), KEY + ["row"], "left")   # a row a sheet row: never broadcast
    return j.filter(F.coalesce("has_formula", F.lit(False)) | (F.coalesce("label", F.lit("")) != ""))


# --- links -----------------------------------------------------------------------------------------------------
def resolve_single(refs: DataFrame, cells: DataFrame) -> DataFrame:
    """Single-cell references with the cell they point to."""
    one = refs.filter("ext is null and c1 = c2 and r1 = r2")
    tgt = cells.select("file", F.col("sheet").alias("r_sheet"), F.col("row").alias("r1"), F.col("col").alias("c1"),
                       F.col("formula").alias("t_formula"), F.col("v_num").alias("t_num"), F.col("v_str").alias("t_str"))
    return one.join(tgt, ["file", "r_sheet", "r1", "c1"], "left")


def expand_ranges(refs: DataFrame, cells: DataFrame, size: int = 256) -> DataFrame:
    """Member cells of range references: an equi join on column and row block, then the exact bounds."""
    rng = refs.filter("ext is null and (c1 <> c2 or r1 <> r2)").select(
        "file", F.col("sheet").alias("f_sheet"), F.col("row").alias("f_row"), F.col("col").alias("f_col"), "ref_no", F.col("r_sheet").alias("sheet"), "c1", "c2", "r1", "r2")
    rng = rng.withColumn("col", F.explode(F.sequence("c1", "c2")))
    rng = rng.withColumn("blk", F.explode(F.sequence(F.floor(F.col("r1") / size), F.floor(F.col("r2") / size))))
    c = cells.withColumn("blk", F.floor(F.col("row") / size))
    return c.join(rng, ["file", "sheet", "col", "blk"]).filter(F.col("row").between(F.col("r1"), F.col("r2"))).drop("blk")


FAN, LEVELS = 8, 7      # 8 ** 7 rows are more than a sheet can have


def range_aggregates(ranges: DataFrame, points: DataFrame, aggs: dict, by: list | None = None) -> DataFrame:
    """Aggregates over the cells of ranges, without the ranges' members.

    ranges: file, sheet, c1, r1, c2, r2, each range once; points: file, sheet, row, col and what aggs and by read.
    aggs: name -> (F.sum, F.min or F.max, Column over points); by: further columns of points to group by.  Each column of cells
    that several ranges read is summed up in blocks of 1, 8, 64 ... rows, and a range is put together from the few largest blocks that fill it (under 14
    a level), so running totals over a long column cost n log n rows and not n * n, and sums lose nothing to subtraction.
    Ranges without a point give no row.
    """
    by = by or []
    cols = ranges.withColumn("col", F.explode(F.sequence("c1", "c2")))
    # a column that one range reads needs no blocks, its cells are summed up as they are (level -1); elsewhere blocks taller than
    # the tallest range are asked for by none
    tall = sum((F.expr(f"int(r2 - r1 + 1 >= {FAN ** k})") for k in range(1, LEVELS)), F.lit(0))
    used = cols.groupBy(*KEY, "col").agg(F.max(tall).alias("top"), (F.count("*") == 1).alias("alone"), F.min("r1").alias("lo"), F.max("r2").alias("hi"))
    at = F.explode(F.when(F.col("alone"), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("top")))).alias("level")
    width = F.element_at(F.array(*(F.lit(FAN ** k) for k in range(LEVELS))), F.col("level") + 1)
    block_key = [*KEY, "col", "level", "block"]
    values = (points.join(used, [*KEY, "col"]).filter("row between lo and hi")
              .select(*KEY, "col", "row", "top", "alone", *by, *(v.alias(n) for n, (_, v) in aggs.items())))
    block_no = F.when(F.col("level") < 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.col("row") / width))
    blocks = values.select("*", at).withColumn("block", block_no).groupBy(*block_key, *by).agg(*(f(n).alias(n) for n, (f, _) in aggs.items()))

    def filled(k):
        """Blocks of a level inside the range that no block of the next level covers."""
        inside = lambda m: (F.ceil(F.col("r1") / m), F.floor((F.col("r2") + 1) / m))
        (a, z), (up_a, up_z) = inside(FAN ** k), inside(FAN ** (k + 1))
        seq = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
        inner = F.lit(k < LEVELS - 1) & (up_a < up_z)
        found = F.when(inner, F.concat(seq(a, up_a * FAN), seq(up_z * FAN, z))).otherwise(seq(a, z))
        return F.transform(found, lambda b: F.struct(F.lit(k).alias("level"), b.alias("block")))

    whole = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("block")))
    parts = F.when(F.col("alone"), whole).otherwise(F.concat(*(filled(k) for k in range(LEVELS))))
    asked = cols.join(used.select(*KEY, "col", "alone"), [*KEY, "col"]).select(*KEY, "c1", "r1", "c2", "r2", "col", F.explode(parts).alias("at")).select("*", "at.level", "at.block").drop("at")
    return asked.join(blocks, block_key).groupBy(*KEY, "c1", "r1", "c2", "r2", *by).agg(*(f(n).alias(n) for n, (f, _) in aggs.items()))


def range_totals(refs: DataFrame, cells: DataFrame) -> DataFrame:
    """Number and sum of the cells in the ranges of each formula: file, sheet, row, n, total (ranges of a row's formulas together)."""
    box = ["c1", "r1", "c2", "r2"]
    rng = refs.filter("ext is null and (c1 <> c2 or r1 <> r2)").select("file", F.col("r_sheet").alias("to"), "sheet", "row", *box)
    asked = rng.select("file", F.col("to").alias("sheet"), *box).distinct()
    found = range_aggregates(asked, cells, {"n": (F.sum, F.lit(1)), "total": (F.sum, F.col("v_num"))}).withColumnRenamed("sheet", "to")
    return rng.join(found, ["file", "to", *box]).groupBy("file", "sheet", "row").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def wrong_row_links(cells: DataFrame, measure: str = "ratio", views: Views | None = None) -> DataFrame:
    """Row links between two sheets whose ends carry different names."""
    views = views or Views(cells)
    cross = views.refs.filter((F.col("r_sheet") != F.col("sheet")) & F.col("ext").isNull())
    pairs = cross.filter("r1 = r2").groupBy("file", "sheet", "r_sheet").agg(F.count("*").alias("n_links")).filter("n_links >= 20")
    known = views.sheets.select("file", F.col("sheet").alias("r_sheet"))
    one = (cross.filter(visible() & F.expr("c1 = c2 and r1 = r2")).join(known, ["file", "r_sheet"], "left_semi")
           .groupBy("file", "sheet", "row", "col").agg(F.min(F.struct("ref_no", "r_sheet", "r1", "c1")).alias("f"), F.max(F.struct("r_sheet", "r1")).alias("mx"),
                                                      F.min(F.struct("r_sheet", "r1")).alias("mn"), F.first("formula").alias("formula"), F.first("v_num").alias("v_num"))
           .filter(F.col("mx") == F.col("mn")).select("file", "sheet", "row", "col", "formula", "v_num", "f.r_sheet", "f.r1", "f.c1"))
    one = one.join(pairs.select("file", "sheet", "r_sheet"), ["file", "sheet", "r_sheet"], "left_semi")
    totals = formulas(cells).filter(S.is_total(F.col("formula"))).select("file", F.col("sheet").alias("r_sheet"), F.col("row").alias("r1"), F.col("col").alias("c1"))
    one = one.join(totals, ["file", "r_sheet", "r1", "c1"], "left_anti")
    lab = views.labels.hint("merge")                        # a row a sheet row: never broadcast
    j = (one.join(lab.withColumnsRenamed({"label": "a", "folded": "fa"}), KEY + ["row"])
         .join(lab.select("file", F.col("sheet").alias("r_sheet"), F.col("row").alias("r1"), F.col("label").alias("b"), F.col("folded").alias("fb")), ["file", "r_sheet", "r1"], "left"))
    fa, fb = F.col("fa"), F.coalesce("fb", F.lit(""))
    j = j.filter((F.length("a") >= 6) & ~fb.rlike(r"^(tong|cong|thue|vat|gia tri)"))
    rest = j.filter((fa != fb) | F.col("b").isNull())
    return (rest.withColumn("score", folded_similarity(fa, fb, measure)).drop("fa", "fb").filter("score is null or score < 0.6")
            .withColumn("kind", F.when(F.col("score").isNull(), "Trỏ tới dòng không có tên hạng mục").otherwise("Lệch dòng: tên hai đầu khác nhau")))


def hidden_ref_counts(cells: DataFrame, views: Views | None = None) -> DataFrame:
    """References from visible sheets to hidden ones."""
    views = views or Views(cells)
    hid = views.sheets.filter("sheet_state <> 'visible'").select("file", F.col("sheet").alias("r_sheet"))
    return (views.refs.filter(visible() & F.col("ext").isNull()).join(hid, ["file", "r_sheet"], "left_semi")
            .groupBy("file", "sheet", "r_sheet").agg(F.count("*").alias("n")))


def twins(cells: DataFrame, views: Views | None = None) -> DataFrame:
    """Hidden sheets with the visible sheet of the same name (a trailing (n) does not count)."""
    s = (views or Views(cells)).sheets
    h = s.filter("sheet_state <> 'visible'").select("file", F.col("sheet").alias("hidden"), fold(F.regexp_replace("sheet", r"\s*\(\d+\)\s*$", "")).alias("k"))
    v = s.filter("sheet_state = 'visible'").select("file", F.col("sheet").alias("visible"), "sheet_idx", fold(F.col("sheet")).alias("k"))
    return h.join(v, ["file", "k"]).groupBy("file", "hidden").agg(F.min_by("visible", "sheet_idx").alias("visible"))


def diff_grids(cells: DataFrame, views: Views | None = None) -> DataFrame:
    """Cells that differ between a hidden sheet and its visible twin (values; numbers within 1e-9 are equal)."""
    tw = sized(twins(cells, views))                         # else cells might be broadcast to them
    val = ["row", "col", "v_num", "v_str"]
    a = cells.join(tw.withColumnRenamed("visible", "sheet"), KEY).select("file", "hidden", *val)
    b = cells.join(tw.select("file", "hidden", F.col("hidden").alias("sheet")), KEY).select("file", "hidden", *[F.col(c).alias("h_" + c) if c.startswith("v_") else F.col(c) for c in val])
    j = a.join(b, ["file", "hidden", "row", "col"], "full_outer")
    same_n = F.coalesce(F.abs(F.col("v_num") - F.col("h_v_num")) < 1e-9, F.col("v_num").isNull() & F.col("h_v_num").isNull())
    return j.filter(~(same_n & F.col("v_str").eqNullSafe(F.col("h_v_str"))))


def ranked_differences(diffs: DataFrame, limit: int | None = None) -> DataFrame:
    """Differences numbered by place in their pair; the first `limit` of each pair where one is given."""
    out = scan(diffs, ["file", "hidden"], block(F.col("row")), ["row", "col"], sums={"rank": F.lit(1)})
    return out if limit is None else out.filter(F.col("rank") <= limit)


def text_numbers(cells: DataFrame, views: Views | None = None) -> DataFrame:
    """Numbers kept as text to the right of the name column, on visible sheets."""
    t = cells.filter(visible() & F.col("formula").isNull() & S.is_number_text(F.col("v_str")))
    return t.join((views or Views(cells)).names, KEY).filter(F.col("col") > F.col("name_col"))


def literal_census(cells: DataFrame, path_columns: DataFrame | None = None) -> DataFrame:
    """Literals typed into formulas: kind, count, count on the lineage columns, and a few example cells."""
    lit = formulas(cells).filter(visible()).select("file", "sheet", "row", "col", F.explode(S.embedded_literals(F.col("formula"))).alias("literal"))
    if path_columns is not None:
        lit = lit.join(path_columns.select("file", "sheet", "col", F.lit(1).alias("on_path")), ["file", "sheet", "col"], "left")
    else:
        lit = lit.withColumn("on_path", F.lit(None).cast("int"))
    return (lit.groupBy("file", "literal").agg(F.count("*").alias("n"), F.count("on_path").alias("n_path"), F.min(F.struct("sheet", "row", "col")).alias("first"))
            .withColumn("kind", S.literal_kind(F.col("literal"))))


def labelled_totals(cells: DataFrame) -> DataFrame:
    """Summary figures found by their labels on the visible sheets: the first number to the right of the label."""
    t = F.col("t")
    hits = F.array_compact(F.array(*[F.when(t.rlike(p) & (~t.contains("luy ke") if k == "gt_hd" else F.lit(True)), F.lit(k)) for k, p in X.SUMMARY_LABELS]))
    # folded once, below the generator; few rows are left, so that cells stay in place
    texts = (cells.filter(visible() & F.col("formula").isNull() & (F.trim("v_str") != ""))
             .select(*KEY, "sheet_idx", "row", F.col("col").alias("l_col"), F.col("v_str").alias("nhan"), fold(F.col("v_str")).alias("t")))
    lab = sized(texts.select(*KEY, "sheet_idx", "row", "l_col", "nhan", F.explode(hits).alias("label")))
    numbers = cells.filter(F.abs("v_num") > 1).select(*KEY, "row", "col", "v_num")
    lab = (lab.join(numbers, [*KEY, "row"]).filter("col > l_col").groupBy(*KEY, "sheet_idx", "row", "l_col", "nhan", "label")
           .agg(F.min("col").alias("col"), F.min_by("v_num", "col").alias("v_num")))
    return first_per(lab, ["file", "label"], ["sheet_idx", "row", "l_col"])


# --- detail table ----------------------------------------------------------------------------------------------
MEASURES = ["kl_hd", "kl_kt", "kl_kn", "kl_lk", "gt_hd", "gt_kt", "gt_kn", "gt_lk"]


def detail_layouts(cells: DataFrame) -> DataFrame:
    """Header row and column roles of each sheet that holds a quantity-price table."""
    top, text = cells, fold(F.coalesce("v_str", F.col("v_num").cast("string")))
    name, price = F.col("t").rlike(X.HDR_NAME), F.col("t").rlike(X.HDR_PRICE)
    cand = (top.select(*KEY, "row", "col", text.alias("t")).filter(name | price).groupBy("file", "sheet", "row").agg(F.max(F.when(name, F.col("col"))).alias("ten"), F.max(F.when(~name & price, F.col("col"))).alias("dg"))
            .filter("ten is not null and dg is not null").withColumnRenamed("row", "hdr"))
    cand = sized(cand)                                      # few rows: cells stay in place
    span = cand.withColumn("row", F.explode(F.sequence("hdr", F.col("hdr") + 3)))
    t = (span.join(top.filter("v_str is not null or v_num is not null").select("file", "sheet", "row", "col", text.alias("t")), KEY + ["row"])
         .groupBy("file", "sheet", "hdr", "ten", "dg", "col").agg(F.array_sort(F.collect_list(F.struct("row", "t"))).alias("ts")))
    t = t.withColumn("t", F.array_join(F.transform("ts", lambda x: x["t"]), " ")).filter("t <> ''")
    c, h = F.col("col"), F.col("t")
    side = F.when(c < F.col("dg"), "kl").when(c > F.col("dg"), "gt")
    what = (F.when(h.rlike("hop dong") & ~h.rlike("ky truoc|ky nay"), "hd").when(h.rlike("ky truoc"), "kt")
            .when(h.rlike("luy ke.*ky nay|het ky nay"), "lk").when(h.rlike("ky nay"), "kn"))
    role = F.when((c > F.col("ten")) & side.isNotNull() & what.isNotNull(), F.concat_ws("_", side, what))
    t = t.withColumn("role", role)
    out = t.groupBy("file", "sheet", "hdr", "ten", "dg").agg(
        F.min(F.when((c < F.col("ten")) & h.rlike(X.HDR_NO), c)).alias("stt"), F.min(F.when(h.rlike(X.HDR_UNIT) & (c != F.col("ten")), c)).alias("dvt"),
        *[F.min(F.when(F.col("role") == m, c)).alias(m) for m in MEASURES])
    ok = out.filter("dvt is not null and (kl_hd is not null or kl_lk is not null)")
    return sized(first_per(ok, KEY, ["hdr"]))


def table_rows(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows under the header with one column per role, cut at the first total row."""
    j = cells.join(layout, KEY).filter(F.col("row") > F.col("hdr"))
    at = lambda role, v: F.max(F.when(F.col("col") == F.col(role), v)).alias("x_" + role)
    txt = F.coalesce("v_str", F.regexp_replace(F.col("v_num").cast("string"), r"\.0$", ""))
    num = F.coalesce(F.col("v_num"), F.when(F.replace("v_str", F.lit(","), F.lit("")).rlike(r"^\s*[-+]?\d+\.?\d*\s*$"), F.replace("v_str", F.lit(","), F.lit("")).try_cast("double")))
    r = cut_lineage(j.groupBy("file", "sheet", "sheet_idx", "hdr", "row").agg(at("ten", txt), at("dvt", txt), at("stt", txt), at("dg", num), *[at(m, num) for m in MEASURES]))
    blank_unit = F.coalesce(F.col("x_dvt").isin("", "0"), F.lit(True))
    start = (r.filter((F.col("row") < F.col("hdr") + 6) & (F.col("x_dg").isNotNull() | F.substring(F.trim("x_ten"), 1, 1).rlike(r"(?U)\p{L}")))
             .groupBy(*KEY).agg(F.min("row").alias("r0")))
    r = r.join(start, KEY, "left").filter(F.col("row") >= F.coalesce("r0", F.col("hdr") + 6))
    total = blank_unit & F.lower(F.trim("x_ten")).rlike(X.TOTAL_ROW)
    r = cut_at_total(r, total)
    r = r.filter((F.coalesce("x_ten", F.lit("")) != "") & ~F.col("x_ten").rlike(r"^[\[\]\-\d\s]+$"))
    return r.select("file", "sheet", "sheet_idx", F.col("row").alias("dong"), F.trim(F.coalesce("x_stt", F.lit(""))).alias("stt"), F.trim("x_ten").alias("ten"),
                    F.when(blank_unit, "").otherwise(F.trim("x_dvt")).alias("dvt"), F.col("x_dg").alias("don_gia"), *[F.col("x_" + m).alias(m) for m in MEASURES])


def cut_at_total(rows: DataFrame, total: Column) -> DataFrame:
    """Rows before the first total row of their sheet: one aggregate finds the row, no running scan is needed."""
    t = rows.filter(total).groupBy(*KEY).agg(F.min("row").alias("__stop"))
    return rows.join(t, KEY, "left").filter(F.col("__stop").isNull() | (F.col("row") < F.col("__stop"))).drop("__stop")


def carry_groups(items: DataFrame, keys=("file", "sheet"), pos="dong") -> DataFrame:
    """Two-level group path from the rows without a unit."""
    keys = list(keys)
    g = F.col("dvt") == ""
    a = scan(cut_lineage(items), keys, block(F.col(pos)), [pos], sums={"n_g": F.when(g, 1).otherwise(0)})
    top = g & ((F.col("n_g") == 1) | F.col("stt").rlike(r"^[A-Z]\.?$"))
    a = a.withColumn("top", top)
    a = scan(a, keys, block(F.col(pos)), [pos], sums={"n_top": F.when(F.col("top"), 1).otherwise(0)}, fills={"g1": F.when(F.col("top"), F.col("ten"))})
    a = scan(cut_lineage(a), keys + ["n_top"], block(F.col(pos)), [pos], fills={"g2": F.when(g & ~F.col("top"), F.col("ten"))})
    return a.withColumn("nhom", F.coalesce(F.concat_ws(" / ", "g1", "g2"), F.lit(""))).drop("n_g", "top", "n_top", "g1", "g2")


def number_duplicates(items: DataFrame, keys=("file", "sheet"), pos="dong") -> DataFrame:
    """Match key of each line; the n-th equal key gets #n."""
    from claimgrid.functions.text import match_key
    it = items.withColumn("k", match_key(F.col("nhom"), F.col("ten"), F.col("dvt")))
    it = scan(it, list(keys) + ["k"], block(F.col(pos)), [pos], sums={"nth": F.lit(1)})
    return it.withColumn("khoa", F.when(F.col("nth") > 1, F.concat("k", F.lit("#"), F.col("nth").cast("string"))).otherwise(F.col("k"))).drop("k", "nth")


def detail_table(cells: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """The quantity-price table of each file: the sheet with the best score (10 per item, 1 per recognised column)."""
    lay = detail_layouts(cells) if layouts is None else layouts
    rows = table_rows(cells, lay)
    n_cols = sum((F.when(F.col(m).isNotNull(), 1).otherwise(0) for m in MEASURES), F.lit(0))
    score = (rows.groupBy("file", "sheet", "sheet_idx").agg(F.count(F.when(F.col("dvt") != "", 1)).alias("n"))
             .join(lay.select("file", "sheet", n_cols.alias("k")), KEY).withColumn("score", F.col("n") * 10 + F.col("k")))
    best = score.groupBy("file").agg(F.max_by("sheet", F.struct("score", -F.col("sheet_idx"))).alias("sheet"))
    return rows.join(best, ["file", "sheet"], "left_semi")


def boq_layouts(cells: DataFrame) -> DataFrame:
    """Header of a plain bill of quantities: two header rows read together, quantity column chosen by its words."""
    text = fold(F.coalesce("v_str", F.col("v_num").cast("string")))
    # the price column's upper cell starts the words read together: only its row and the next are looked at
    own = cut_lineage(cells.filter(F.col("v_str").isNotNull() & text.rlike(X.BOQ_HDR_START)).select(*KEY, F.col("row").alias("hdr")).distinct())
    near = own.select("*", F.posexplode(F.array("hdr", F.col("hdr") + 1)).alias("below", "row"))
    upper = F.col("below") == 0
    h = (cells.join(near, KEY + ["row"]).select(*KEY, "hdr", "col", "below", text.alias("t")).filter("hdr >= 1")
         .groupBy(*KEY, "hdr", "col").agg(F.max(F.when(upper, F.col("t"))).alias("t"), F.max(F.when(~upper, F.col("t"))).alias("u"))
         .select(*KEY, "hdr", "col", F.concat(F.coalesce("t", F.lit("")), F.lit(" "), F.coalesce("u", F.lit(""))).alias("t")))
    h = cut_lineage(h)
    t, c = F.col("t"), F.col("col")
    g = h.groupBy("file", "sheet", "hdr").agg(F.min(F.when(t.rlike(X.BOQ_HDR_NAME), c)).alias("ten"), F.min(F.when(t.rlike(X.HDR_PRICE), c)).alias("dg"), F.min(F.when(t.rlike(X.BOQ_HDR_UNIT), c)).alias("dvt"))
    g = g.filter("ten is not null and dg is not null and dvt is not null")
    j = h.join(g, ["file", "sheet", "hdr"])
    left = t.contains("khoi luong") & (c < F.col("dg"))
    lay = j.groupBy("file", "sheet", "hdr", "ten", "dg", "dvt").agg(
        F.min(F.when(left & t.rlike(X.BOQ_HDR_NEW_QTY), c)).alias("q1"), F.max(F.when(left, c)).alias("q2"),
        F.min(F.when(t.startswith("kl") & t.rlike(X.BOQ_HDR_NEW_QTY), c)).alias("q3"), F.max(F.when(t.startswith("kl"), c)).alias("q4"),
        F.min(F.when((c > F.col("dg")) & t.rlike(X.BOQ_HDR_AMOUNT), c)).alias("tt"), F.min(F.when(t.rlike(X.BOQ_HDR_CODE), c)).alias("ma"),
        F.min(F.when((c < F.col("ten")) & t.rlike(X.BOQ_HDR_NO), c)).alias("stt"))
    kl = F.when(F.col("q2").isNotNull(), F.coalesce("q1", "q2")).otherwise(F.coalesce("q3", "q4"))
    return first_per(lay.withColumn("kl", kl).filter("kl is not null").drop("q1", "q2", "q3", "q4"), KEY, ["hdr"])


def boq_table(cells: DataFrame) -> DataFrame:
    """Rows of a plain bill of quantities with the group carried down."""
    j = cells.join(cut_lineage(boq_layouts(cells)), KEY).filter(F.col("row") > F.col("hdr"))
    txt = F.coalesce("v_str", F.regexp_replace(F.col("v_num").cast("string"), r"\.0$", ""))
    at = lambda role, v: F.max(F.when(F.col("col") == F.col(role), v)).alias("x_" + role)
    v = F.col("v_num")
    r = cut_lineage(j.groupBy("file", "sheet", "row").agg(at("ten", txt), at("dvt", txt), at("stt", txt), at("ma", txt), at("kl", v), at("dg", v), at("tt", v)))
    blank = F.coalesce(F.col("x_dvt") == "", F.lit(True))
    r = cut_at_total(r, blank & F.lower(F.trim("x_ten")).rlike(X.BOQ_TOTAL_ROW))
    r = r.filter((F.coalesce("x_ten", F.lit("")) != "") & ~F.col("x_ten").rlike(r"^[\[\]\-\d\s()]+$")).withColumn("blank", F.coalesce(F.col("x_dvt") == "", F.lit(True)))
    r = scan(r, KEY, block(F.col("row")), ["row"], fills={"nhom": F.when(F.col("blank"), F.trim("x_ten"))})
    return r.filter("not blank").select("file", "sheet", F.col("row").alias("dong"), F.upper(F.trim(F.coalesce("x_ma", F.lit("")))).alias("ma_hm"), F.coalesce("x_stt", F.lit("")).alias("stt"),
                                        F.coalesce("nhom", F.lit("")).alias("nhom"), F.trim("x_ten").alias("ten"), F.trim("x_dvt").alias("dvt"), F.col("x_kl").alias("kl"), F.col("x_dg").alias("don_gia"), F.col("x_tt").alias("thanh_tien_ghi"))


# --- findings --------------------------------------------------------------------------------------------------
def _where(*parts) -> Column:
    return F.concat_ws("!", *parts)


def k1_findings(cells: DataFrame, links: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Overview of each workbook. links (file, ext, target) and names (file, name, refers_to) of its parts, where known, add links
    that no formula uses and names that lost their reference."""
    p = sheet_profile(cells)
    shown = F.col("sheet_state") == "visible"
    ent = _where("file", "sheet")
    ref = p.filter("n_ref_errors > 0").select(*finding("K1", F.when(shown, X.MEDIUM).otherwise(X.CONTROL), ent, "formulas lost a reference", F.col("n_ref_errors")))
    err = p.filter("n_error_values > 0").select(*finding("K1", F.when(shown, X.HIGH).otherwise(X.CONTROL), ent, "formulas show an error", F.col("n_error_values")))
    unc = p.filter("n_uncached > 0.5 * n_formulas").select(*finding("K1", X.CONTROL, ent, "formulas without a cached value", F.col("n_uncached")))
    usage = external_usage(cells)
    ext = usage.select(*finding("K1", X.HIGH, _where("file", F.col("ext").cast("string")), "formulas read an external file", F.col("n")))
    out = [ref, err, unc, ext]
    per_file = lambda df, message: df.groupBy("file").agg(F.count("*").alias("n")).select(*finding("K1", X.CONTROL, F.col("file"), message, F.col("n")))
    if links is not None:
        out.append(per_file(unused_links(links, usage), "external links that no formula uses"))
    if names is not None:
        out.append(per_file(names.filter(F.col("refers_to").contains("#REF!")), "defined names lost a reference"))
    return collect_findings(*out)


def unused_links(links: DataFrame, usage: DataFrame) -> DataFrame:
    """External links (file, ext, target) that no formula uses."""
    return links.join(usage.select("file", "ext"), ["file", "ext"], "left_anti")


def k2_findings(cells: DataFrame, views: Views | None = None) -> DataFrame:
    p = cut_lineage(patterned(cells))                      # parsed once, read three times
    dom = dominant_patterns(p)
    out = pattern_outliers(p, dom).groupBy("file", "sheet").agg(F.count("*").alias("n")).select(
        *finding("K2", X.MEDIUM, _where("file", "sheet"), "formulas off the column pattern", F.col("n")))
    typ = typed_between(cells, dom, views).groupBy("file", "sheet", "col").agg(F.count("*").alias("n"), F.sum("v_num").alias("amount")).select(
        *finding("K2", X.HIGH, F.concat(_where("file", "sheet"), F.lit("!"), S.col_letters(F.col("col"))), "typed numbers in a formula column", F.col("n"), F.col("amount")))
    return collect_findings(out, typ)


def k3_findings(cells: DataFrame, measure: str = "ratio", views: Views | None = None) -> DataFrame:
    return (wrong_row_links(cells, measure, views).groupBy("file", "sheet", "col", "kind").agg(F.count("*").alias("n"), F.sum("v_num").alias("amount"))
            .select(*finding("K3", X.HIGH, F.concat(_where("file", "sheet"), F.lit("!"), S.col_letters(F.col("col"))), F.col("kind"), F.col("n"), F.col("amount"))))


def k4_findings(cells: DataFrame, views: Views | None = None) -> DataFrame:
    views = views or Views(cells)
    h = views.sheets.filter("sheet_state <> 'visible'").select("file", F.col("sheet").alias("hidden"))
    n_ref = hidden_ref_counts(cells, views).groupBy("file", F.col("r_sheet").alias("hidden")).agg(F.sum("n").alias("n_ref"))
    diff = diff_grids(cells, views).groupBy("file", "hidden").agg(F.count("*").alias("n_diff"))
    j = h.join(n_ref, ["file", "hidden"], "left").join(diff, ["file", "hidden"], "left").fillna(0, ["n_ref", "n_diff"])
    level = F.when((F.col("n_ref") > 0) | (F.col("n_diff") > 0), X.MEDIUM).otherwise(X.CONTROL)
    return j.select(*finding("K4", level, _where("file", "hidden"), "hidden sheet", F.greatest("n_ref", F.lit(1)), F.col("n_diff")))


def k5_findings(cells: DataFrame, views: Views | None = None) -> DataFrame:
    return text_numbers(cells, views).groupBy("file").agg(F.count("*").alias("n")).select(*finding("K5", X.MEDIUM, F.col("file"), "numbers kept as text", F.col("n")))


def k6_findings(cells: DataFrame, path_columns: DataFrame) -> DataFrame:
    c = literal_census(cells, path_columns).filter(~F.col("kind").startswith("Hằng số khác") & (F.col("n_path") > 0))
    return c.select(*finding("K6", X.MEDIUM, F.concat_ws("!", "file", "literal"), F.col("kind"), F.col("n_path")))


def downgrade_off_path(findings: DataFrame, usage_columns: DataFrame, path_columns: DataFrame) -> DataFrame:
    """External-link findings none of whose columns lie on the lineage drop to medium.

    findings: file, ext, level; usage_columns: file, ext, sheet, col; path_columns: file, sheet, col.
    """
    on = usage_columns.join(path_columns.select("file", "sheet", "col").distinct(), ["file", "sheet", "col"], "left_semi").select("file", "ext").distinct().withColumn("on_path", F.lit(True))
    has_path = path_columns.select("file").distinct().withColumn("traced", F.lit(True))
    j = findings.join(on, ["file", "ext"], "left").join(has_path, "file", "left")
    drop = F.coalesce("traced", F.lit(False)) & ~F.coalesce("on_path", F.lit(False))
    return j.withColumn("level", F.when(drop, X.MEDIUM).otherwise(F.col("level"))).drop("on_path", "traced")


def column_groups(cells: DataFrame) -> DataFrame:
    """Input group of every column by its header."""
    return column_headers(cells).withColumn("nhom", root_data_group(F.col("header"), F.lit(""), F.col("sheet")))
