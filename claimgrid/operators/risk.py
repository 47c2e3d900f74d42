"""Fixed-template audit tables, payment effects, materiality and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions import classify as C
from claimgrid.functions.text import norm
from claimgrid.operators.scan import block, scan

# items: file, dong, part, name, lk_src, kt_src, price_pattern, E, I (price), F (prior), G (this), H (cumulative),
# K, L, M (prior, this and cumulative value), dgL (detail quantity or NULL)


def with_effects(items: DataFrame) -> DataFrame:
    """Risk, documents, over-quantity and payment effects of every item."""
    risk = C.lookup({k: v[1] for k, v in X.CUMULATIVE_SOURCES.items()}, F.col("lk_src"))
    text = C.lookup({k: v[0] for k, v in X.CUMULATIVE_SOURCES.items()}, F.col("lk_src"))
    this, whole = C.payment_effect(F.col("part"), F.col("L"), F.col("K"), F.col("M"))
    over = F.when(F.col("dgL").isNotNull(), F.greatest(F.lit(0.0), F.col("dgL") - F.col("E")))
    return items.withColumns({"risk": risk, "mo_ta": text, "over_qty": over, "over_value": F.coalesce(over * F.col("I"), F.lit(0.0)),
                              "below_prior": F.when(F.col("dgL").isNotNull(), F.greatest(F.lit(0.0), F.col("F") - F.col("dgL")) * F.col("I")).otherwise(0.0),
                              "f1_this": this, "f1_all": whole})


def _sum(name):
    return F.sum(F.col(name).cast("decimal(28,6)")).cast("double")


def risk_by_part_source(items: DataFrame) -> DataFrame:
    """Counts and values per (part, source) with a total row and the share of the cumulative value."""
    g = items.rollup("part", "lk_src")
    r = g.agg(F.count("*").alias("n"), _sum("L").alias("gt_ky"), _sum("M").alias("gt_lk"), _sum("f1_this").alias("f1_this"), _sum("f1_all").alias("f1_all"), F.grouping_id().alias("gid"))
    total = F.max(F.when(F.col("gid") == 3, F.col("gt_lk"))).over(W.partitionBy(F.lit(1)))          # a few rows: parts x sources
    return (r.filter("gid in (0, 3)").withColumn("share", F.when(total == 0, 0.0).otherwise(F.col("gt_lk") / total))
            .withColumn("part", F.coalesce("part", F.lit("Tổng"))).drop("gid"))


def order_strata(df: DataFrame) -> DataFrame:
    return df.orderBy(C.lookup(X.PART_ORDER, F.col("part"), 9), C.lookup(X.RISK_ORDER, F.col("risk"), 9), "lk_src")


def scenario_effect(items: DataFrame, requested: Column | float) -> DataFrame:
    """Per risk level the values that would fall away, and what remains of the requested amount without the high risk."""
    r = items.groupBy("risk").agg(F.count("*").alias("n"), _sum("L").alias("gt_ky"), _sum("M").alias("gt_lk"), _sum("f1_this").alias("f1_this"), _sum("f1_all").alias("f1_all"))
    left = (requested if isinstance(requested, Column) else F.lit(float(requested)))
    return r.withColumn("remaining_this", F.when(F.col("risk") == "Cao", left - F.col("f1_this"))).withColumn("remaining_all", F.when(F.col("risk") == "Cao", left - F.col("f1_all")))


def prior_source_totals(items: DataFrame) -> DataFrame:
    s = items.withColumn("kt", C.lookup(X.PRIOR_SOURCES, F.col("kt_src")))
    return (s.rollup("part", "kt").agg(F.count("*").alias("n"), _sum("K").alias("gt_truoc"), F.grouping_id().alias("gid")).filter("gid in (0, 3)")
            .withColumn("part", F.coalesce("part", F.lit("Tổng"))).drop("gid"))


def over_quantity(items: DataFrame, part: str = "XD") -> DataFrame:
    return items.filter(F.col("part") == part).groupBy("part").agg(F.count(F.when(F.col("over_value") > 0, 1)).alias("n"), _sum("over_value").alias("gt_vuot"))


def price_pattern_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("part", "price_pattern").agg(F.count("*").alias("n"), _sum("L").alias("gt_ky"), _sum("M").alias("gt_lk"))


def carry_part(rows: DataFrame) -> DataFrame:
    """Current part of each row from the part headings."""
    t = norm(F.col("name"))
    part = (F.when(t.startswith("phần xây dựng"), "XD").when(t.startswith("phần thiết bị"), "TB").when(t.startswith("theo phụ lục"), "PL"))
    return scan(rows, ["file"], block(F.col("dong")), ["dong"], fills={"part": part})


def replaced_base_items(items: DataFrame) -> DataFrame:
    """Base items whose name (35 characters) is taken out by a negative amendment item; a flag per base item, no pairs."""
    k = norm(F.col("name"))
    neg = items.filter((F.col("part") == "PL") & (F.col("E") < 0)).groupBy("file", k.alias("k")).agg(F.count("*").alias("n_neg"), F.min("dong").alias("first_neg"))
    return items.filter(F.col("part").isin("TB", "XD")).withColumn("k", k).join(neg, ["file", "k"]).drop("k")


def rounded_value_lookup(typed: DataFrame, totals: DataFrame, value: str, total: str) -> DataFrame:
    """Typed numbers that equal one of the totals at nine decimals."""
    t = totals.groupBy("file", F.bround(F.col(total), 9).alias("__k")).agg(F.max("row").alias("total_row"))
    return typed.withColumn("__k", F.bround(F.col(value), 9)).join(t, ["file", "__k"], "left").drop("__k")


def item_flags(items: DataFrame) -> DataFrame:
    """Flags of the fixed-template audit (array)."""
    e_diff = F.size(F.array_distinct(F.array_compact(F.array("E", "E2", "E3")))) > 1
    unit = (F.col("dgL") > F.col("E")) & (F.col("E") > 0) & (F.col("dgL") / F.when(F.col("E") > 0, F.col("E")) > 3)
    below = (F.col("dgL") < F.col("E")) & (F.col("dgL") < F.col("F")) & (F.col("F") - F.col("dgL") > 1e-6 * F.greatest(F.lit(1.0), F.col("F")))
    flags = F.array_compact(F.array(
        F.when(F.col("e_text"), "KL HĐ lưu dạng text"), F.when(e_diff, "KL HĐ khác nhau giữa GTHT/BTHKLTH/BBNT"), F.when(F.col("E") < 0, "KL âm (hạng mục bị thay thế ở PLHĐ)"),
        F.when(unit, "KL diễn giải gấp nhiều lần KL HĐ - kiểm tra đơn vị tính"), F.when(below, "KL diễn giải thấp hơn KL đã nghiệm thu kỳ trước"),
        F.when(F.col("dg_row").isNull(), "Không trỏ về BBNT")))
    return items.withColumn("flags", flags)


def summary_inputs(cells: DataFrame, sheet: str) -> DataFrame:
    """Typed numbers, embedded rates and external links of the summary sheet."""
    from claimgrid.functions import formulas as S
    c = cells.filter(F.col("sheet") == sheet)
    lits = S.rate_literals(F.col("formula"))
    kinds = F.array_compact(F.array(
        F.when(F.col("formula").isNull() & F.col("v_num").isNotNull() & (F.col("col") > 3), "Số nhập tay"),
        F.when(F.col("formula").contains("["), "Liên kết file ngoài"),
        F.when(F.size(lits) > 0, F.concat(F.lit("Tham số nhúng: "), F.array_join(lits, ", ")))))
    return c.select("file", "sheet", "row", "col", F.explode(kinds).alias("kind"), "formula", "v_num")


def file_integrity(cells: DataFrame, flagged: DataFrame) -> DataFrame:
    """Hidden sheets, lost references, external links and item flags, one row each."""
    p = cells.groupBy("file", "sheet", "sheet_state").agg(F.count(F.when(F.col("formula").contains("#REF!"), 1)).alias("n"))
    hid = p.filter("sheet_state <> 'visible'").select("file", F.lit("Sheet ẩn").alias("loai"), F.col("sheet").alias("vi_tri"), F.col("sheet_state").alias("mo_ta"))
    ref = p.filter("n > 0").select("file", F.lit("Lỗi tham chiếu (REF)").alias("loai"), F.col("sheet").alias("vi_tri"), F.col("n").cast("string").alias("mo_ta"))
    fl = flagged.select("file", F.lit("Cờ hạng mục").alias("loai"), F.col("dong").cast("string").alias("vi_tri"), F.explode("flags").alias("mo_ta"))
    return hid.unionByName(ref).unionByName(fl)


# --- documented method -----------------------------------------------------------------------------------------
def materiality(periods: DataFrame) -> DataFrame:
    """1 % of the period value, performance 75 % of it, trivial 5 % of it."""
    m = F.col("gt_ky") * 0.01
    return periods.withColumns({"trong_yeu": m, "thuc_hien": m * 0.75, "khong_dang_ke": m * 0.05})


def audit_sample(items: DataFrame, keys: list, value: str, threshold: Column, flagged: Column, coverage: float = 0.8, least: int = 25) -> DataFrame:
    """All items at or above the threshold or flagged, then by value until the coverage and the least number are reached.

    The running order is cut at sampled bounds, so that a large group, also of equal values, is spread over many tasks.
    """
    must = F.when((F.col(value) >= threshold) | flagged, 1).otherwise(0)
    d = items.withColumn("must", must).withColumn("__v", F.col(value).cast("decimal(28,4)")).withColumn("__neg", -F.col(value))
    tot = d.groupBy(*keys).agg(F.sum("__v").alias("total"), F.sum("must").alias("n_must"))
    run = scan(d.withColumn("__rest", 1 - F.col("must")), keys, None, ["__rest", "__neg", "item"], sums={"cum": F.col("__v"), "pos": F.lit(1)}).join(tot, keys)
    before = (F.col("cum") - F.col("__v")).cast("double")
    pick = (F.col("must") == 1) | (before < coverage * F.col("total").cast("double")) | (F.col("pos") <= least)
    return run.filter(pick).drop("__v", "__neg", "__rest", "n_must", "total")


def deductions(periods: DataFrame) -> DataFrame:
    """Net payment of a period: value less retention, advance recovery and penalties, with VAT."""
    net = F.col("gt_ky") - F.coalesce("giu_lai", F.lit(0.0)) - F.coalesce("thu_hoi_tu", F.lit(0.0)) - F.coalesce("phat", F.lit(0.0))
    return periods.withColumn("con_lai", net).withColumn("con_lai_vat", F.round(net * (1 + F.col("vat"))))


def evidence_matrix(evidence: DataFrame, documents: list) -> DataFrame:
    """Equipment x document counts."""
    return evidence.groupBy("thiet_bi").pivot("tai_lieu", documents).count().fillna(0)
