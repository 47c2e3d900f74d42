"""Effective-dated state: base rows plus ordered amendments give the rows, parameters and value in force on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions.numbers import format_qty
from claimgrid.functions.text import fold
from claimgrid.operators.scan import first_per, scan

ATTRS = ["stt", "nhom", "ten", "dvt", "kl", "don_gia", "thanh_tien_ghi"]
_EPOCH = "0001-01-01"


def signed(amendments: DataFrame) -> DataFrame:
    return amendments.filter(F.col("trang_thai") == X.SIGNED)


def applicable(amendments: DataFrame, on: Column | None = None, exclude: Column | None = None) -> DataFrame:
    """Signed amendments in force on a date (None: all of them), optionally leaving one id out."""
    df = signed(amendments)
    if on is not None:
        df = df.filter(F.col("ngay_hieu_luc") <= on)
    if exclude is not None:
        df = df.filter(F.col("id") != exclude)
    return df


def pending(amendments: DataFrame, on: Column) -> DataFrame:
    """Not cancelled, and still a draft or effective only later."""
    return amendments.filter((F.col("trang_thai") != X.CANCELLED)
                             & ((F.col("trang_thai") == X.DRAFT) | (F.col("ngay_hieu_luc") > on)))


def at_or_before(amendments: DataFrame, eff: Column, number: Column) -> DataFrame:
    """Signed amendments at or before the composite key (effective date, number as text)."""
    return signed(amendments).filter(F.struct("ngay_hieu_luc", "so_pl") <= F.struct(eff, number))


def change_log(boq: DataFrame, amendments_in_force: DataFrame) -> DataFrame:
    """Base rows and the lines of the given amendments, with the columns that order them."""
    a = amendments_in_force.select(F.col("id").alias("__pl"), "so_pl", "ngay_ky", "ngay_hieu_luc")
    base = (boq.filter(F.col("pl_id").isNull())
            .select("*", F.lit(X.BASE_LABEL).alias("so_pl"), F.lit(_EPOCH).cast("date").alias("ngay_ky"),
                    F.lit(_EPOCH).cast("date").alias("ngay_hieu_luc")))
    changes = boq.filter(F.col("pl_id").isNotNull()).join(a, F.col("pl_id") == F.col("__pl")).drop("__pl")
    return base.unionByName(changes)


def _kept_events(log: DataFrame) -> DataFrame:
    """Number the segments (each base or added row opens one) and keep the events that act on a live row."""
    op = F.col("thao_tac")
    define = op.isin(X.OP_BASE, X.OP_ADD)
    order = ["ngay_ky", "so_pl", "id"]
    seq = scan(log, ["ma_hd", "ma_hm"], F.col("ngay_hieu_luc"), order,
               sums={"seg": F.when(define, 1).otherwise(0)}, before={"before": F.when(op != X.OP_MODIFY, op)})
    live_before = F.coalesce(F.col("before").isin(X.OP_BASE, X.OP_ADD), F.lit(False))
    return seq.filter(define | live_before).withColumn("ord", F.struct("ngay_hieu_luc", "ngay_ky", "so_pl", "id"))


def segments(log: DataFrame) -> DataFrame:
    """One row per life of an item: values in force at its end, last source, removal (if any).

    Every step is an aggregate with map-side combine; no group is gathered.
    """
    ev = _kept_events(log)
    op = F.col("thao_tac")
    define, change = op.isin(X.OP_BASE, X.OP_ADD), op != X.OP_REMOVE

    def last_set(name):
        c = F.col(name)
        given = change & c.isNotNull() & ((c.cast("string") != "") | define)
        return F.max_by(c, F.when(given, F.col("ord"))).alias(name)

    removed = F.when(op == X.OP_REMOVE, F.col("ord"))
    return (ev.groupBy("ma_hd", "ma_hm", "seg")
            .agg(*[last_set(n) for n in ATTRS],
                 F.max_by("khoa", F.when(define, F.col("ord"))).alias("khoa"),
                 F.max_by("so_pl", F.when(change, F.col("ord"))).alias("nguon"),
                 F.count(F.when(change, 1)).alias("n_changes"),
                 F.max_by("so_pl", removed).alias("bo_boi"),
                 F.max(F.when(op == X.OP_REMOVE, 1).otherwise(0)).alias("is_removed")))


def effective_rows(boq: DataFrame, amendments: DataFrame, on: Column | None = None) -> DataFrame:
    """Live and removed rows on a date; an item removed and added again appears in both states."""
    seg = segments(change_log(boq, applicable(amendments, on)))
    return states_of(seg)


def states_of(seg: DataFrame) -> DataFrame:
    row = F.struct(*ATTRS, "khoa", "nguon", "n_changes", "bo_boi", "is_removed")
    last = (seg.groupBy("ma_hd", "ma_hm")
            .agg(F.max_by(row, F.col("seg")).alias("cur"),
                 F.max_by(row, F.when(F.col("is_removed") == 1, F.col("seg"))).alias("gone")))
    both = last.select("ma_hd", "ma_hm", F.explode(F.array(
        F.when(F.col("cur.is_removed") == 0, F.struct(F.lit("live").alias("state"), F.col("cur").alias("r"))),
        F.when(F.col("gone").isNotNull(), F.struct(F.lit("removed").alias("state"), F.col("gone").alias("r"))))).alias("e"))
    return both.filter("e is not null").select("ma_hd", "ma_hm", "e.state", *[F.col("e.r." + n).alias(n) for n in
                                               ATTRS + ["khoa", "nguon", "n_changes", "bo_boi"]])


def union_prefer(live: DataFrame, removed: DataFrame, keys=("ma_hd", "ma_hm")) -> DataFrame:
    """live plus the removed rows whose key is not live."""
    return live.unionByName(removed.join(live.select(*keys), list(keys), "left_anti"))


def history(log: DataFrame) -> DataFrame:
    """One row per kept event with the values after it and a readable note (long form, any length)."""
    ev = _kept_events(log).filter(F.col("thao_tac") != X.OP_REMOVE)
    run = scan(ev, ["ma_hd", "ma_hm", "seg"], F.col("ngay_hieu_luc"), ["ngay_ky", "so_pl", "id"],
               fills={"kl_after": F.col("kl"), "don_gia_after": F.col("don_gia")}, sums={"step": F.lit(1)})
    label = (F.when(F.col("thao_tac") == X.OP_BASE, F.lit("Gốc")).when(
        F.col("thao_tac") == X.OP_ADD, F.concat("so_pl", F.lit(" thêm"))).otherwise(F.concat("so_pl", F.lit(" thay"))))
    return run.withColumn("note", F.concat(label, F.lit(": KL "), format_qty(F.col("kl_after")), F.lit(" × "),
                                           format_qty(F.col("don_gia_after"))))


def base_value_with_vat(contracts: DataFrame) -> Column:
    g = F.coalesce(F.col("gia_tri_hd"), F.lit(0.0))
    return F.when(fold(F.col("gom_vat")).isin(X.NO_VAT_WORDS), g * (1 + F.coalesce(F.col("vat"), F.lit(0.0)))).otherwise(g)


def contract_value(contracts: DataFrame, amendments: DataFrame, on: Column | None = None) -> DataFrame:
    """Base value with VAT, signed changes up to the date and the value in force, per contract."""
    d = (applicable(amendments, on).groupBy("ma_hd")
         .agg(F.sum(F.coalesce("gt_sau_vat", F.lit(0.0)).cast("decimal(24,3)")).alias("delta"), F.count("*").alias("n_pl")))
    base = contracts.withColumn("base_value", base_value_with_vat(contracts))
    return (base.join(d, "ma_hd", "left")
            .withColumn("delta", F.coalesce(F.col("delta").cast("double"), F.lit(0.0)))
            .withColumn("n_pl", F.coalesce("n_pl", F.lit(0)))
            .withColumn("value_in_force", F.col("base_value") + F.col("delta")))


def effective_params(params: DataFrame, changes: DataFrame, amendments: DataFrame, on: Column | None = None) -> DataFrame:
    """Value in force and its source per (contract, code): the last change in force, else the base value."""
    a = applicable(amendments, on).select(F.col("id").alias("pl_id"), "ma_hd", "so_pl", "ngay_hieu_luc", "ngay_ky")
    ch = (changes.join(a, "pl_id").groupBy("ma_hd", "ma_ts")
          .agg(F.max_by(F.struct("gia_tri_moi", "so_pl"), F.struct("ngay_hieu_luc", "ngay_ky", "so_pl", "pl_id")).alias("c"),
               F.count("*").alias("n_changes")))
    return (params.select("ma_hd", "ma_ts", "gia_tri", "trang_thai").join(ch, ["ma_hd", "ma_ts"], "full_outer")
            .select("ma_hd", "ma_ts",
                    F.when(F.col("c").isNotNull(), F.col("c.gia_tri_moi")).otherwise(F.col("gia_tri")).alias("gia_tri"),
                    F.coalesce(F.col("c.so_pl"), F.lit(X.BASE_LABEL)).alias("nguon"),
                    F.coalesce("n_changes", F.lit(0)).alias("n_changes"), "trang_thai",
                    F.col("gia_tri").alias("gia_tri_goc")))


def param_history(changes: DataFrame, amendments: DataFrame, on: Column | None = None) -> DataFrame:
    """Every change in force with its place in the order of its code (long form)."""
    a = applicable(amendments, on).select(F.col("id").alias("pl_id"), "ma_hd", "so_pl", "ngay_hieu_luc", "ngay_ky")
    return scan(changes.join(a, "pl_id"), ["ma_hd", "ma_ts"], F.col("ngay_hieu_luc"), ["ngay_ky", "so_pl", "pl_id"],
                sums={"step": F.lit(1)})


def value_chain(contracts: DataFrame, amendments: DataFrame, on: Column | None = None) -> DataFrame:
    """Running contract value after every amendment in force."""
    base = contracts.select("ma_hd", base_value_with_vat(contracts).alias("base_value"))
    a = applicable(amendments, on).withColumn("d", F.coalesce("gt_sau_vat", F.lit(0.0)).cast("decimal(24,3)"))
    run = scan(a, ["ma_hd"], F.col("ngay_hieu_luc"), ["ngay_ky", "so_pl", "id"], sums={"cum": F.col("d"), "step": F.lit(1)})
    return (run.join(base, "ma_hd").withColumn("value_before", F.col("base_value") + (F.col("cum") - F.col("d")).cast("double"))
            .withColumn("value_after", F.col("base_value") + F.col("cum").cast("double")).drop("d", "cum"))


def latest_paid(period_items: DataFrame, periods: DataFrame) -> DataFrame:
    """Last period, cumulative quantity and acceptance date per (contract, item)."""
    j = period_items.join(periods.select("ma_hd", "dot", "ngay_nghiem_thu"), ["ma_hd", "dot"])
    return (j.groupBy("ma_hd", "ma_hm")
            .agg(F.max("dot").alias("dot"), F.max_by(F.coalesce("kl_luy_ke", F.lit(0.0)), "dot").alias("kl_luy_ke"),
                 F.max_by("ngay_nghiem_thu", "dot").alias("ngay_nghiem_thu")))


def latest_period(periods: DataFrame) -> DataFrame:
    return periods.groupBy("ma_hd").agg(F.max("dot").alias("dot"), F.max_by("gt_luy_ke", "dot").alias("gt_luy_ke"))


def prior_period(claims: DataFrame, periods: DataFrame) -> DataFrame:
    """Last period before each claim: by number when known, else undated or dated before the claim.

    Claims and periods are merged in the order of number, or of date (undated first), a claim before periods equal to it; the
    greatest period so far is carried along, so no claim meets all periods of its contract.
    """
    c = claims.select("ma_hd", F.col("dot").alias("claim_dot"), F.col("ngay").alias("claim_day")).distinct()
    p = periods.select("ma_hd", "dot", "ngay_nghiem_thu", "gt_luy_ke")

    def merged(asked, at, p, of_period):
        own = asked.select("ma_hd", at.alias("at"), F.lit(0).alias("side"), "claim_dot", "claim_day")
        given = p.select("ma_hd", of_period.alias("at"), F.when(of_period.isNull(), 0).otherwise(1).alias("side"), F.struct("dot", "gt_luy_ke").alias("period"))
        rows = own.unionByName(given, allowMissingColumns=True).withColumn("asks", F.col("period").isNull())
        return scan(rows, ["ma_hd"], None, ["at", "side"], maxes={"last": F.col("period")}).filter("asks and last is not null")

    known = merged(c.filter("claim_dot is not null"), F.col("claim_dot").cast("bigint"), p.filter("dot is not null"), F.col("dot").cast("bigint"))
    day = lambda x: F.unix_date(F.to_date(x)).cast("bigint")
    dated = merged(c.filter("claim_dot is null and claim_day is not null"), day("claim_day"), p, day("ngay_nghiem_thu"))
    none = c.filter("claim_dot is null and claim_day is null").join(p.filter("ngay_nghiem_thu is null").groupBy("ma_hd").agg(F.max(F.struct("dot", "gt_luy_ke")).alias("last")), "ma_hd")
    cols = ["ma_hd", "claim_dot", "claim_day", F.col("last.dot").alias("dot_truoc"), F.col("last.gt_luy_ke").alias("gt_luy_ke_truoc")]
    return known.select(*cols).unionByName(dated.select(*cols)).unionByName(none.select(*cols))


def gap_check(amendments: DataFrame) -> DataFrame:
    """Number of each live amendment against the largest earlier-loaded number plus one."""
    n = F.regexp_extract("so_pl", r"(\d+)", 1).try_cast("bigint")
    a = amendments.filter(F.col("trang_thai") != X.CANCELLED).withColumn("no", n).filter("no is not null")
    run = scan(a, ["ma_hd"], None, ["id"], maxes={"prev": F.col("no")}, exclusive=True)     # loading order is the id
    return run.withColumn("is_gap", F.col("no") != F.coalesce("prev", F.lit(0)) + 1)


def later_amendments(amendments: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Amendments after each cancelled one by (effective date, number), still standing.

    Both are merged in that order and the standing ones numbered; a cancelled one then takes the numbers from its own place to the
    end, so only the rows of the result are formed.
    """
    a = amendments.filter(F.col("trang_thai") != X.CANCELLED).select("ma_hd", "id", "so_pl", "ngay_hieu_luc", F.lit(0).alias("side"))
    c = cancelled.select("ma_hd", "id", "so_pl", "ngay_hieu_luc", F.lit(1).alias("side"))
    run = scan(a.unionByName(c), ["ma_hd"], None, ["ngay_hieu_luc", "so_pl", "side", "id"], sums={"pos": 1 - F.col("side")})
    total = a.groupBy("ma_hd").agg(F.count("*").alias("total"))
    asked = run.filter("side = 1").join(total, "ma_hd").filter("pos < total").select("ma_hd", F.col("id").alias("cancelled_id"), F.explode(F.expr("sequence(pos + 1, total)")).alias("pos"))
    return asked.join(run.filter("side = 0").drop("side"), ["ma_hd", "pos"]).filter("id <> cancelled_id").drop("pos")


def count_later(amendments: DataFrame) -> DataFrame:
    """How many standing amendments follow each amendment; ordered counting, so no pairs are built."""
    a = amendments.filter(F.col("trang_thai") != X.CANCELLED)
    run = scan(a, ["ma_hd"], F.col("ngay_hieu_luc"), ["so_pl", "id"], sums={"pos": F.lit(1)})
    # the same (date, number) is not "after": rows with an equal key share the largest position
    last = run.groupBy("ma_hd", "ngay_hieu_luc", "so_pl").agg(F.max("pos").alias("last_pos"))
    total = a.groupBy("ma_hd").agg(F.count("*").alias("total"))
    return (run.join(last, ["ma_hd", "ngay_hieu_luc", "so_pl"]).join(total, "ma_hd")
            .withColumn("n_later", F.col("total") - F.col("last_pos")))


def params_wide(effective: DataFrame, extra: list | None = None) -> DataFrame:
    """One row per contract with one column per standard code (NULL when missing) and the codes that amendments changed."""
    codes = X.PARAM_CODES + list(extra or [])
    return (effective.groupBy("ma_hd").pivot("ma_ts", codes).agg(F.first("gia_tri")))


def missing_and_changed(effective: DataFrame) -> DataFrame:
    """Counts per contract: standard codes without a row, codes changed by amendments, codes not confirmed."""
    std = F.col("ma_ts").isin(X.PARAM_CODES)
    base = F.col("trang_thai").isNotNull() | F.col("gia_tri_goc").isNotNull()
    return (effective.groupBy("ma_hd")
            .agg((F.lit(len(X.PARAM_CODES)) - F.count(F.when(std & base, 1))).alias("n_missing"),
                 F.count(F.when(F.col("n_changes") > 0, 1)).alias("n_changed"),
                 F.count(F.when(F.col("trang_thai") != X.CONFIRMED, 1)).alias("n_unconfirmed")))


def next_number(existing: DataFrame, key: str, code: str, prefix: str) -> DataFrame:
    """Largest trailing number of codes PREFIX<digits> per key, plus one."""
    n = F.regexp_extract(F.col(code), f"^{prefix}(\\d+)$", 1).try_cast("bigint")
    return existing.groupBy(key).agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_no"))


def resolve_reference(refs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contract of a typed reference: exact id or number, else the only number that contains it.

    The containing search joins on the rarest four-character fragment of each reference, so that common
    fragments never form pairs.
    """
    n = 4
    r = refs.select("ref", F.trim("ref").alias("r")).distinct()
    # one row per number; the fragments are many times the size that the plan expects of them: never broadcast
    c = contracts.select("ma_hd", "so_hd").hint("merge")
    names = contracts.groupBy("so_hd").agg(F.count("*").alias("n"), F.min("ma_hd").alias("ma_hd"))
    exact = (r.join(c, (F.upper("r") == F.col("ma_hd")), "inner").select("ref", "ma_hd")
             .union(r.join(c, F.col("r") == F.col("so_hd"), "inner").select("ref", "ma_hd")))
    e = exact.groupBy("ref").agg(F.min("ma_hd").alias("exact_id"))

    def grams(col):
        return F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(col) - n + 1, F.lit(1))), lambda i: F.col(col).substr(i, F.lit(n)))))

    cg = names.select("ma_hd", "so_hd", "n", grams("so_hd").alias("g"))
    df = cg.groupBy("g").agg(F.count("*").alias("df"))
    rg = r.join(e, "ref", "left_anti").filter(F.length("r") >= n).select("ref", "r", grams("r").alias("g"))
    rare = (rg.join(df, "g", "left").groupBy("ref", "r")
            .agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), "g")).alias("g")))
    part = (rare.join(cg.hint("merge"), "g").filter(F.col("so_hd").contains(F.col("r")))
            .groupBy("ref").agg(F.sum("n").alias("n_part"), F.min("ma_hd").alias("part_id")))
    return (r.join(e, "ref", "left").join(part, "ref", "left")
            .select("ref",
                    F.when(F.col("exact_id").isNotNull(), F.col("exact_id"))
                    .when(F.col("n_part") == 1, F.col("part_id")).alias("ma_hd"),
                    F.when(F.col("exact_id").isNotNull() | (F.col("n_part") == 1), "unique")
                    .when(F.col("n_part") > 1, "ambiguous").otherwise("none").alias("status")))
