"""Store-level checks: base lines, keys, value chain, findings and per-contract controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.operators import state
from claimgrid.schemas import FINDING_COLUMNS, TOL, money_tolerance, pyround

def line_value() -> Column:
    """Quantity x price, rounded half-even."""
    return pyround(F.coalesce("kl", F.lit(0.0)) * F.coalesce("don_gia", F.lit(0.0)))



def finding(check: str, level, entity, message, n=None, amount=None) -> list:
    """Select list of the uniform findings table."""
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)
    vals = [lit(check), lit(level), lit(entity), lit(message),
            (n if n is not None else F.lit(1)).cast("bigint"), (amount if amount is not None else F.lit(None)).cast("double")]
    return [v.alias(c) for v, c in zip(vals, FINDING_COLUMNS)]


def collect_findings(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def order_findings(df: DataFrame) -> DataFrame:
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in X.LEVEL_RANK.items() for x in kv]), F.col("level")), F.lit(9))
    return df.orderBy(rank, "check")


def boq_total_check(contracts: DataFrame, base: DataFrame) -> DataFrame:
    """Base lines with VAT against the contract value."""
    tot = base.groupBy("ma_hd").agg(F.sum(line_value()).alias("total"), F.count("*").alias("n_lines"))
    j = contracts.withColumn("contract_value", state.base_value_with_vat(contracts)).join(tot, "ma_hd", "left")
    gap = F.abs(F.col("boq_value") - F.col("contract_value")) > money_tolerance(F.col("contract_value"))
    return (j.withColumn("boq_value", F.col("total") * (1 + F.coalesce("vat", F.lit(0.0))))
            .withColumn("verdict", F.when(F.col("n_lines").isNull(), "B00").when(gap, "B01").otherwise("ok")))


def base_boq_findings(contracts: DataFrame, base: DataFrame) -> DataFrame:
    chk = boq_total_check(contracts, base)
    none = chk.filter("verdict = 'B00'").select(*finding("B00", X.YELLOW, F.col("ma_hd"), "no base lines"))
    gap = chk.filter("verdict = 'B01'").select(*finding(
        "B01", X.RED, F.col("ma_hd"), "base lines x (1 + VAT) differ from the contract value",
        amount=F.col("boq_value") - F.col("contract_value")))
    off = F.col("thanh_tien_ghi") - line_value()
    line = base.filter(F.abs(off) > TOL["line_total"]).select(*finding(
        "B02", X.YELLOW, F.concat_ws("/", "ma_hd", "ma_hm"), "stated total is not quantity x price", amount=off))
    return collect_findings(none, gap, line)


def chain_check(chain: DataFrame) -> DataFrame:
    """Value before plus change against the stated value after, per amendment that states one."""
    d = F.col("value_before") + F.coalesce("gt_sau_vat", F.lit(0.0)) - F.col("gt_hd_sau_pl")
    return (chain.filter("gt_hd_sau_pl is not null")
            .withColumn("level", F.when(F.abs(d) > money_tolerance(F.col("gt_hd_sau_pl")), X.RED).otherwise(X.PASS)))


def amendments_per_period(periods: DataFrame, amendments: DataFrame) -> DataFrame:
    """Amendments in force at each dated period, from one ordered pass over both (no pairs are built)."""
    p = periods.filter("ngay_nghiem_thu is not null").select(
        "ma_hd", F.col("ngay_nghiem_thu").alias("day"), F.lit(1).alias("kind"), "dot", F.lit(None).cast("double").alias("amt"))
    a = state.signed(amendments).select(
        "ma_hd", F.col("ngay_hieu_luc").alias("day"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("dot"), F.col("gt_sau_vat").alias("amt"))
    from claimgrid.operators.scan import scan
    run = scan(a.unionByName(p), ["ma_hd"], F.col("day"), ["kind", "dot"],
               sums={"n_pl": 1 - F.col("kind"), "run": F.col("amt").cast("decimal(24,3)")})
    return run.filter("kind = 1").withColumn("delta", F.when(F.col("n_pl") > 0, F.col("run").cast("double")))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("pl_id").agg(*[
        F.count(F.when(F.col("thao_tac") == op, 1)).alias("n_" + name)
        for op, name in ((X.OP_MODIFY, "thay"), (X.OP_ADD, "them"), (X.OP_REMOVE, "bo"))])


def extra_codes(params: DataFrame) -> DataFrame:
    return params.filter(~F.col("ma_ts").isin(X.PARAM_CODES)).select("ma_ts").distinct()


def unconfirmed(params: DataFrame) -> DataFrame:
    return params.filter(F.col("trang_thai") != X.CONFIRMED)


def standing_findings(findings: DataFrame, amendments: DataFrame) -> DataFrame:
    """Findings whose amendment (if any) is not cancelled."""
    a = amendments.select(F.col("id").alias("pl_id"), "so_pl", "trang_thai")
    j = findings.join(a, "pl_id", "left").filter(F.coalesce("trang_thai", F.lit("")) != X.CANCELLED)
    return j.withColumn("so_pl", F.coalesce("so_pl", F.lit("")))


def contract_controls(contracts, amendments, boq, params, findings, periods, on: Column | None = None) -> DataFrame:
    """Control columns of the contract overview: values, gap, items, last period, red flags, unconfirmed parameters."""
    value = state.contract_value(contracts, amendments, on)
    live = state.effective_rows(boq, amendments, on).filter("state = 'live'")
    lines = live.groupBy("ma_hd").agg(F.sum(line_value()).alias("total"), F.count("*").alias("n_items"))
    red = standing_findings(findings, amendments).filter(F.col("muc_do") == X.RED).groupBy("ma_hd").agg(F.count("*").alias("n_red"))
    open_ = unconfirmed(params).groupBy("ma_hd").agg(F.count("*").alias("n_unconfirmed"))
    j = (value.join(lines, "ma_hd", "left").join(red, "ma_hd", "left").join(open_, "ma_hd", "left")
         .join(state.latest_period(periods).withColumnRenamed("gt_luy_ke", "gt_luy_ke_tt"), "ma_hd", "left"))
    j = j.withColumn("boq_value", F.col("total") * (1 + F.coalesce("vat", F.lit(0.0))))
    gap = F.abs(F.col("boq_value") - F.col("value_in_force")) > money_tolerance(F.col("value_in_force"))
    return (j.withColumn("value_gap", F.col("boq_value").isNull() | gap)
            .fillna(0, ["n_items", "n_red", "n_unconfirmed"]))


def duplicate_keys(df: DataFrame, keys: list, check: str, where: Column | None = None) -> DataFrame:
    d = df.filter(where) if where is not None else df
    return (d.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
            .select(*finding(check, X.BLOCK, F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys]),
                             "duplicate key", n=F.col("n"))))


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str, check: str) -> DataFrame:
    d = df.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    return d.groupBy(key).agg(F.count("*").alias("n")).select(
        *finding(check, X.BLOCK, F.col(key).cast("string"), "no parent row", n=F.col("n")))


def not_in_domain(df: DataFrame, col: str, values: list, entity: str, check: str) -> DataFrame:
    return df.filter(~F.col(col).isin(values) | F.col(col).isNull()).select(
        *finding(check, X.BLOCK, F.col(entity).cast("string"), "value outside its domain"))


def store_violations(contracts, amendments, boq, periods, period_items) -> DataFrame:
    """Primary, partial-unique, foreign-key and domain rules of the store on whole tables."""
    ops = [X.OP_BASE] + X.CHANGE_OPS
    return collect_findings(
        duplicate_keys(contracts, ["ma_hd"], "DQ-PK contract"),
        duplicate_keys(contracts, ["so_hd"], "DQ-UQ contract"),
        duplicate_keys(amendments, ["ma_hd", "so_pl"], "DQ-UQ amendment", F.col("trang_thai") != X.CANCELLED),
        duplicate_keys(boq, ["ma_hd", "pl_id", "ma_hm"], "DQ-UQ line"),
        duplicate_keys(periods, ["ma_hd", "dot"], "DQ-PK period"),
        duplicate_keys(period_items, ["ma_hd", "dot", "ma_hm"], "DQ-PK quantity"),
        orphans(amendments, "ma_hd", contracts, "ma_hd", "DQ-FK amendment"),
        orphans(boq, "pl_id", amendments, "id", "DQ-FK line"),
        not_in_domain(boq, "thao_tac", ops, "id", "DQ-CK line"))
