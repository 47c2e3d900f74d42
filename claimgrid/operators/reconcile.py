"""Reconciliation of submitted claims with the rows in force and with earlier periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions.numbers import format_date, price_type
from claimgrid.operators import match, state
from claimgrid.operators.scan import scan
from claimgrid.schemas import TOL, money_tolerance, pyround
from claimgrid.session import cut_lineage


def _z(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def dated(amendments: DataFrame, claims: DataFrame) -> DataFrame:
    """Amendments with the claim day of their contract (column ngay)."""
    return amendments.join(claims.select("ma_hd", "ngay"), "ma_hd")


def prior_quantities(claims: DataFrame, periods: DataFrame, period_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(last period before each claim, its cumulative quantities)."""
    prior = state.prior_period(claims, periods)
    qty = (period_items.join(prior.select("ma_hd", F.col("dot_truoc").alias("dot")), ["ma_hd", "dot"])
           .select("ma_hd", "ma_hm", F.col("kl_luy_ke").alias("kl_duyet"), F.lit(True).alias("in_prior")))
    return prior, qty


def pending_only(boq: DataFrame, am_dated: DataFrame) -> DataFrame:
    """First pending amendment of each line key (effective order), for keys found outside the rows in force."""
    p = state.pending(am_dated, F.col("ngay")).select(
        F.col("id").alias("pl_id"), F.col("so_pl").alias("p_no"), F.col("trang_thai").alias("p_status"), F.col("ngay_hieu_luc").alias("p_eff"))
    lines = boq.filter("pl_id is not null").join(p, "pl_id")
    first = lines.groupBy("ma_hd", "ma_hm").agg(F.min(F.struct("p_eff", "pl_id", "p_no", "p_status", "khoa")).alias("f"))
    return (first.filter("f.khoa is not null").groupBy("ma_hd", F.col("f.khoa").alias("khoa"))
            .agg(F.min(F.col("f")).alias("p")))


def item_findings(claims: DataFrame, items: DataFrame, contracts: DataFrame, amendments: DataFrame, boq: DataFrame,
                  periods: DataFrame, period_items: DataFrame, remembered: DataFrame | None = None,
                  suggest: bool = True) -> DataFrame:
    """Every claim line with the line in force, its errors and the money at stake, over all contracts at once."""
    am = dated(amendments, claims)
    eff = cut_lineage(state.effective_rows(boq, am, F.col("ngay")))     # read four times below
    return _item_findings(eff, claims, items, contracts, am, boq, periods, period_items, remembered, suggest)


def _item_findings(eff, claims, items, contracts, am, boq, periods, period_items, remembered, suggest):
    live, gone = eff.filter("state = 'live'"), eff.filter("state = 'removed'")
    lines = state.union_prefer(live, gone)
    it = match.match_cascade(items, lines, remembered)
    if suggest:
        it = cut_lineage(it)            # read by the suggestions and by the errors
        open_items = it.filter("ma_hm is null").select("ma_hd", "dong", "ten", "dvt")
        s = match.fuzzy_suggest(open_items, lines).filter("goi_y is not null").select(
            "ma_hd", "dong", F.concat(F.col("goi_y"), F.lit(" ("), F.format_number(F.col("goi_y_score") * 100, 0), F.lit("%)")).alias("goi_y"))
        it = it.join(s, ["ma_hd", "dong"], "left")
    else:
        it = it.withColumn("goi_y", F.lit(None).cast("string"))
    m = live.select("ma_hd", "ma_hm", F.col("kl").alias("m_kl"), F.col("don_gia").alias("m_gia"), F.col("nguon").alias("m_nguon"), F.lit(True).alias("in_force"))
    g = gone.select("ma_hd", "ma_hm", "bo_boi")
    prior, qty = prior_quantities(claims, periods, period_items)
    detail = qty.select("ma_hd").distinct().withColumn("has_detail", F.lit(True))
    head = (contracts.select("ma_hd", price_type(F.col("loai_gia")).alias("loai"), F.coalesce("vat", F.lit(0.0)).alias("vat"))
            .join(prior.select("ma_hd", "dot_truoc"), "ma_hd", "left").join(detail, "ma_hd", "left"))
    j = (it.join(m, ["ma_hd", "ma_hm"], "left").join(g, ["ma_hd", "ma_hm"], "left").join(qty, ["ma_hd", "ma_hm"], "left")
         .join(pending_only(boq, am), ["ma_hd", "khoa"], "left").join(head, "ma_hd"))

    ok = F.coalesce("in_force", F.lit(False))
    has = F.coalesce("has_detail", F.lit(False))
    dot = F.col("dot_truoc").cast("string")
    missing = (F.when(F.col("bo_boi").isNotNull(), F.concat(F.lit(X.ERR_REMOVED), "bo_boi"))
               .when(F.col("p").isNotNull(), F.concat(F.lit(X.ERR_PENDING), F.col("p.p_no"), F.lit(" ("), F.col("p.p_status"), F.lit(", hiệu lực "),
                                                      format_date(F.col("p.p_eff")), F.lit(")" + X.ERR_PENDING_TAIL)))
               .otherwise(F.concat(F.lit(X.ERR_UNKNOWN), F.when(F.col("goi_y").isNotNull(), F.concat(F.lit(X.ERR_SIMILAR), "goi_y", F.lit(")"))).otherwise(""))))
    errors = F.array_compact(F.array(
        F.when(~ok, missing),
        F.when(ok & (F.abs(_z("don_gia") - _z("m_gia")) > TOL["price"]), X.ERR_PRICE),
        F.when(ok & F.col("kl_hd").isNotNull() & (F.abs(F.col("kl_hd") - _z("m_kl")) > TOL["qty"]), X.ERR_QTY),
        F.when(ok & (_z("kl_lk") > _z("m_kl") + TOL["qty"]),
               F.concat(F.lit(X.ERR_OVER), F.when(F.col("loai") == X.LUMP_SUM, X.ERR_OVER_LUMP).otherwise(X.ERR_OVER_UNIT))),
        F.when(ok & has & F.col("in_prior").isNotNull() & (F.abs(_z("kl_kt") - _z("kl_duyet")) > TOL["qty"]),
               F.concat(F.lit(X.ERR_PRIOR), dot, F.lit(X.ERR_PRIOR_TAIL))),
        F.when(ok & has & F.col("in_prior").isNull() & (_z("kl_kt") > 0), F.concat(F.lit(X.ERR_PRIOR_NONE), dot, F.lit(X.ERR_PRIOR_NONE_TAIL))),
        F.when(ok & F.col("dot_truoc").isNull() & (_z("kl_kt") > 0), X.ERR_NO_PRIOR)))
    accepted = F.when(ok, F.least(_z("kl_lk"), _z("m_kl")) * _z("m_gia")).otherwise(0.0)
    return (j.withColumn("loi", errors)
            .withColumn("anh_huong", F.when(F.size("loi") > 0, pyround(_z("kl_lk") * _z("don_gia") - accepted)).otherwise(0.0))
            .withColumn("gia_tri_ky", _z("kl_kn") * _z("m_gia")).withColumn("gia_tri_truoc", _z("kl_kt") * _z("m_gia")))


def missing_lines(findings: DataFrame, live: DataFrame) -> DataFrame:
    """Lines in force that no claim line uses."""
    used = findings.filter("in_force").select("ma_hd", "ma_hm")
    return live.join(used, ["ma_hd", "ma_hm"], "left_anti")


def held_value(findings: DataFrame) -> DataFrame:
    return findings.groupBy("ma_hd").agg((F.sum("anh_huong") * (1 + F.first("vat"))).alias("held"))


def period_value(findings: DataFrame, measure: str = "gia_tri_ky") -> DataFrame:
    """Quantity x price in force summed per contract, with VAT (rounded half-even)."""
    return findings.groupBy("ma_hd").agg(pyround(F.sum(F.col(measure).cast("decimal(28,4)")).cast("double") * (1 + F.first("vat"))).alias("value"))


def error_counts(findings: DataFrame, per: list | None = None) -> DataFrame:
    """How often each kind of error occurs; the variable part after ':' or ' (' is cut."""
    e = findings.select(*(per or []), F.explode("loi").alias("e"))
    kind = F.split_part(F.split_part("e", F.lit(":"), F.lit(1)), F.lit(" ("), F.lit(1))
    return e.groupBy(*(per or []), kind.alias("loai_loi")).agg(F.count("*").alias("n"))


def contract_value_verdict(claims: DataFrame, stated: DataFrame, contracts: DataFrame, amendments: DataFrame) -> DataFrame:
    """Step 1: is the stated contract value the one in force; if not, which amendment explains it.

    stated: ma_hd, gt_hd.  A pending amendment that explains the value overrides a stale one.
    """
    am = dated(amendments, claims)
    force = state.applicable(am, F.col("ngay"))
    value = state.contract_value(contracts, am, F.col("ngay")).select("ma_hd", "base_value", "value_in_force", "n_pl")
    head = claims.select("ma_hd").join(stated, "ma_hd", "left").join(value, "ma_hd")

    def running(a, order):
        return scan(a.withColumn("d", F.coalesce("gt_sau_vat", F.lit(0.0)).cast("decimal(24,3)")), ["ma_hd"], F.col("ngay_hieu_luc"),
                    order, sums={"cum": F.col("d"), "step": F.lit(1)}).withColumn("cum", F.col("cum").cast("double"))

    def explains(after):
        return F.abs(F.col("gt_hd") - after) <= money_tolerance(after)

    after_base = F.col("base_value") + F.col("cum")
    stale = (running(force, ["ngay_ky", "so_pl", "id"]).join(head, "ma_hd")
             .filter((F.col("step") < F.col("n_pl")) & explains(after_base))
             .groupBy("ma_hd").agg(F.min(F.struct("step", "so_pl")).alias("stale")))
    after_force = F.col("value_in_force") + F.col("cum")
    early = (running(state.pending(am, F.col("ngay")), ["id"]).join(head, "ma_hd").filter(explains(after_force))
             .groupBy("ma_hd").agg(F.min(F.struct("step", "so_pl")).alias("early")))
    j = head.join(stale, "ma_hd", "left").join(early, "ma_hd", "left")
    base_fits = (F.col("n_pl") > 0) & explains(F.col("base_value"))
    verdict = (F.when(F.col("gt_hd").isNull(), X.V_NO_DATA).when(explains(F.col("value_in_force")), X.V_PASS)
               .when(F.col("early").isNotNull(), X.V_PREMATURE).when(base_fits | F.col("stale").isNotNull(), X.V_STALE).otherwise(X.V_NEEDS))
    by = (F.when(F.col("verdict") == X.V_PREMATURE, F.col("early.so_pl"))
          .when((F.col("verdict") == X.V_STALE) & base_fits, X.BASE_LABEL).when(F.col("verdict") == X.V_STALE, F.col("stale.so_pl")))
    return (j.withColumn("verdict", verdict).withColumn("explained_by", by)
            .select("ma_hd", "gt_hd", "value_in_force", "verdict", "explained_by"))


def compare_line(df: DataFrame, check: str, file_value: Column, store_value: Column, tol: Column | float) -> DataFrame:
    """One summary check: MATCH, DIFF or NO DATA."""
    t = tol if isinstance(tol, Column) else F.lit(tol)
    verdict = (F.when(file_value.isNull() | store_value.isNull(), X.M_NONE)
               .when(F.abs(file_value - store_value) <= t, X.M_MATCH).otherwise(X.M_DIFF))
    return df.select("ma_hd", F.lit(check).alias("check"), file_value.alias("v_file"), store_value.alias("v_store"), verdict.alias("verdict"))


def previous_total_check(claims: DataFrame, periods: DataFrame, totals: DataFrame) -> DataFrame:
    """Stated cumulative value before this period against the approved one."""
    prior = state.prior_period(claims, periods)
    j = prior.join(totals.select("ma_hd", "gt_lk_kt"), "ma_hd", "left")
    return compare_line(j, "R4", F.col("gt_lk_kt"), F.col("gt_luy_ke_truoc"), TOL["approved"])


def last_nonzero(history: DataFrame) -> DataFrame:
    """Last non-zero cumulative value of each contract's payment history."""
    v = F.when(F.col("gt_luy_ke") != 0, F.col("gt_luy_ke"))
    return history.groupBy("ma_hd").agg(F.max_by(v, F.when(v.isNotNull(), F.col("dot"))).alias("gt_luy_ke"))


def master_items(items: DataFrame, base: DataFrame, prior_qty: DataFrame) -> DataFrame:
    """Claim lines that have a unit against the base lines by full key: six errors and two effects."""
    b = (base.groupBy("ma_hd", "khoa").agg(F.max_by(F.struct("ma_hm", "kl", "don_gia"), "id").alias("m")))
    j = (match.measured(items).join(b, ["ma_hd", "khoa"], "left").withColumn("ma_hm", F.col("m.ma_hm"))
         .join(prior_qty.select("ma_hd", "ma_hm", F.col("kl_luy_ke").alias("kt_master")), ["ma_hd", "ma_hm"], "left"))
    j = j.withColumn("m_kl", F.col("m.kl")).withColumn("m_gia", F.col("m.don_gia"))
    ok = F.col("m").isNotNull()
    errors = F.array_compact(F.array(
        F.when(~ok, X.ERR_M_UNKNOWN),
        F.when(ok & (F.abs(_z("kl_hd") - _z("m_kl")) > TOL["qty"]), X.ERR_M_QTY),
        F.when(ok & (F.abs(_z("don_gia") - _z("m_gia")) > TOL["price"]), X.ERR_M_PRICE),
        F.when(ok & F.col("kt_master").isNotNull() & (F.abs(_z("kl_kt") - F.col("kt_master")) > TOL["qty"]), X.ERR_M_PRIOR),
        F.when(ok & F.col("kt_master").isNull(), X.ERR_M_NO_PRIOR),
        F.when(ok & (_z("kl_lk") > _z("m_kl") + TOL["qty"]), X.ERR_M_OVER)))
    return (j.withColumn("loi", errors)
            .withColumn("price_effect", F.when(F.col("m_gia").isNotNull(), (_z("don_gia") - F.col("m_gia")) * _z("kl_lk")))
            .withColumn("prior_effect", F.when(F.col("kt_master").isNotNull(), (_z("kl_kt") - F.col("kt_master")) * _z("m_gia"))))


def master_checks(items: DataFrame, totals: DataFrame, params: DataFrame, history: DataFrame) -> DataFrame:
    """M1..M5 per contract.  items: result of master_items; params: ma_hd, tt02, tt04, tt21 as numbers."""
    s = items.groupBy("ma_hd").agg(
        F.sum((_z("kl_kt") * _z("m_gia")).cast("decimal(28,4)")).cast("double").alias("kt_sum"),
        F.sum((_z("kl_kn") * _z("m_gia")).cast("decimal(28,4)")).cast("double").alias("kn_sum"))
    last = last_nonzero(history).withColumnRenamed("gt_luy_ke", "last_lk")
    j = totals.join(params, "ma_hd", "left").join(s, "ma_hd", "left").join(last, "ma_hd", "left")
    vat1 = 1 + F.coalesce("tt04", F.lit(0.0))
    ratio = F.when((F.col("giu_lai") != 0) & (F.col("gt_kn") != 0), F.col("giu_lai") / F.col("gt_kn"))
    prior = pyround(F.coalesce("kt_sum", F.lit(0.0)) * vat1)
    this = pyround(F.coalesce("kn_sum", F.lit(0.0)) * vat1)
    tol5 = F.greatest(F.lit(TOL["money_abs"]), F.coalesce("gt_kn", F.lit(0.0)) * TOL["money_rel"])
    parts = [
        compare_line(j, "M1", F.col("gt_hd"), F.col("tt02"), 1.0),
        compare_line(j, "M2", ratio, F.col("tt21"), TOL["retention"]),
        compare_line(j, "M3", F.col("gt_lk_kt"), F.col("last_lk"), 1.0),
        compare_line(j, "M4", prior, F.col("last_lk"), 1.0),
        compare_line(j, "M5", this, F.col("gt_kn"), tol5),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
