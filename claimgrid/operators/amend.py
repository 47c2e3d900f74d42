"""Checks of submitted amendment forms against the state just before each of them, for many forms at once.

forms: form_id, ma_hd and the form fields as text.  a_rows: form_id, dong, ma_ts, cu, moi, trich.
b_rows: form_id, dong, thao_tac, ma_hm, nhom, ten, dvt, kl, don_gia, thanh_tien_ghi.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions.numbers import date_vn, money, num, price_type
from claimgrid.functions.text import fold, match_key
from claimgrid.operators import match, state
from claimgrid.operators.quality import finding
from claimgrid.operators.scan import block, scan
from claimgrid.schemas import TOL, money_tolerance, pyround
from claimgrid.session import cut_lineage


def _z(c):
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def _blank(c):
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def read_forms(forms: DataFrame, contracts: DataFrame) -> DataFrame:
    """Typed form fields next to their contract's price type, VAT and base value."""
    c = contracts.select("ma_hd", price_type(F.col("loai_gia")).alias("loai_gia"), F.coalesce("vat", F.lit(0.0)).alias("vat"), "gom_vat",
                         F.col("ngay_ky").alias("hd_ngay_ky"), state.base_value_with_vat(contracts).alias("base_value"))
    bad = ((~_blank("ngay_ky") & date_vn(F.col("ngay_ky")).isNull())
           | (~_blank("ngay_hieu_luc") & date_vn(F.col("ngay_hieu_luc")).isNull()))
    ky = F.when(~bad, date_vn(F.col("ngay_ky")))
    f = (forms.withColumns({"bad_date": bad, "ky": ky, "hl": F.when(~bad, F.coalesce(date_vn(F.col("ngay_hieu_luc")), ky)),
                            "so_pl": F.upper(F.trim(F.coalesce("so_pl", F.lit("")))), "tt": F.trim(F.coalesce("trang_thai", F.lit(""))),
                            "doi": fold(F.col("doi_boq")), "t_truoc": money(F.col("gt_truoc_vat")), "t_sau": money(F.col("gt_sau_vat")),
                            "t_hd": money(F.col("gt_hd_sau_pl"))})
         .join(c, "ma_hd"))
    v1 = 1 + F.col("vat")
    gts = F.coalesce("t_sau", pyround(F.col("t_truoc") * v1))
    return (f.withColumn("stated_nothing", gts.isNull()).withColumn("gts", F.coalesce(gts, F.lit(0.0)))
            .withColumn("gtt", F.coalesce("t_truoc", pyround(F.col("t_sau") / v1), F.lit(0.0))))


def state_before(f: DataFrame, boq: DataFrame, amendments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows in force just before each form keyed by form_id, value before each form)."""
    key = f.select("form_id", "ma_hd", "hl", F.col("so_pl").alias("f_no"))
    am = (state.signed(amendments).join(key, "ma_hd")
          .filter(F.col("hl").isNotNull() & (F.struct("ngay_hieu_luc", "so_pl") <= F.struct(F.col("hl").alias("ngay_hieu_luc"), F.col("f_no").alias("so_pl")))))
    base = boq.filter("pl_id is null").join(key.select("ma_hd", "form_id"), "ma_hd").select(
        *[c for c in boq.columns if c != "ma_hd"], F.col("form_id").cast("string").alias("ma_hd"), F.lit(X.BASE_LABEL).alias("so_pl"),
        F.lit("0001-01-01").cast("date").alias("ngay_ky"), F.lit("0001-01-01").cast("date").alias("ngay_hieu_luc"))
    a = am.select(F.col("id").alias("pl_id"), "form_id", "so_pl", "ngay_ky", "ngay_hieu_luc")
    ch = boq.filter("pl_id is not null").drop("ma_hd").join(a, "pl_id").withColumn("ma_hd", F.col("form_id").cast("string")).drop("form_id")
    rows = state.states_of(state.segments(base.unionByName(ch))).withColumn("form_id", F.col("ma_hd").cast("bigint")).drop("ma_hd")
    value = am.groupBy("form_id").agg(F.sum(F.coalesce("gt_sau_vat", F.lit(0.0)).cast("decimal(24,3)")).cast("double").alias("delta_before"))
    return rows, value


def check_lines(f: DataFrame, b_rows: DataFrame, rows: DataFrame, boq: DataFrame, paid: DataFrame) -> DataFrame:
    """Each form line with its current row, new values, value change, validity and per-line findings (array)."""
    live = rows.filter("state = 'live'").select(
        "form_id", "ma_hm", F.col("kl").alias("c_kl"), F.col("don_gia").alias("c_gia"), F.col("ten").alias("c_ten"), F.lit(True).alias("is_live"))
    gone = rows.filter("state = 'removed'").select("form_id", "ma_hm", "bo_boi")
    head = f.select("form_id", "ma_hd", "loai_gia", "vat", F.trim(F.coalesce("can_cu", F.lit(""))).alias("can_cu"), "ky", F.col("so_pl").alias("form_no"))
    b = b_rows.withColumn("ma_hm", F.upper(F.trim(F.coalesce("ma_hm", F.lit(""))))).join(head, "form_id")
    b = b.join(live, ["form_id", "ma_hm"], "left").join(gone, ["form_id", "ma_hm"], "left")
    op = F.col("thao_tac")
    is_live, blank = F.coalesce("is_live", F.lit(False)), F.col("ma_hm") == ""
    known = op.isin(X.CHANGE_OPS)
    target_gone = op.isin(X.OP_MODIFY, X.OP_REMOVE) & ~is_live
    exists = (op == X.OP_ADD) & ~blank & (is_live | F.col("bo_boi").isNotNull())
    short = (op == X.OP_ADD) & ~exists & (_blank("ten") | _blank("dvt") | F.col("kl").isNull() | F.col("don_gia").isNull())
    b = b.withColumn("valid", known & ~target_gone & ~exists & ~short)

    # codes for added lines without one: after those in the store, those given in earlier lines of the form and each other
    free = state.next_number(boq, "ma_hd", "ma_hm", "HM")
    needs = F.col("valid") & (op == X.OP_ADD) & blank
    b = scan(b, ["form_id"], block(F.col("dong")), ["dong"], sums={"nth": F.when(needs, 1).otherwise(0)}).join(free, "ma_hd", "left")
    given_no = F.regexp_extract("ma_hm", r"^HM(\d+)$", 1).try_cast("bigint")
    b = scan(b, ["form_id"], block(F.col("dong")), ["dong"], maxes={"taken": F.when(F.col("valid") & (op == X.OP_ADD), given_no + 1 - F.col("nth"))})
    code = F.greatest(F.coalesce("next_no", F.lit(1)), F.coalesce("taken", F.lit(0))) + F.col("nth") - 1
    b = b.withColumn("new_hm", F.when(needs, F.concat(F.lit("HM"), F.lpad(code.cast("string"), 4, "0"))).otherwise(F.col("ma_hm")))
    # an added line that looks like one already there
    k = b.withColumn("khoa", match_key(F.col("nhom"), F.col("ten"), F.col("dvt"))).withColumn("given", F.lit(None).cast("string"))
    lines = rows.filter("state = 'live'").select(F.col("form_id").cast("string").alias("ma_hd"), "ma_hm", "khoa", "ten", "dvt")
    k = match.match_line(k.withColumn("contract", F.col("ma_hd")).withColumn("ma_hd", F.col("form_id").cast("string")), lines)
    b = k.withColumn("ma_hd", F.col("contract")).drop("contract", "given", "khoa")
    b = b.join(paid.select("ma_hd", F.col("ma_hm").alias("new_hm"), F.col("dot").alias("paid_dot"), F.col("kl_luy_ke").alias("paid"),
                           F.col("ngay_nghiem_thu").alias("paid_day")), ["ma_hd", "new_hm"], "left")

    n_kl = F.when(op == X.OP_REMOVE, F.lit(0.0)).otherwise(F.coalesce("kl", "c_kl"))
    n_gia = F.when(op == X.OP_REMOVE, F.col("c_gia")).otherwise(F.coalesce("don_gia", "c_gia"))
    b = b.withColumns({"n_kl": n_kl, "n_gia": n_gia})
    change = pyround(_z("n_kl") * _z("n_gia")) - F.when(op == X.OP_ADD, F.lit(0.0)).otherwise(pyround(_z("c_kl") * _z("c_gia")))
    b = b.withColumn("delta", F.when(F.col("valid"), change))
    v = F.col("valid")
    stated = F.col("thanh_tien_ghi") - pyround(_z(F.coalesce("kl", "c_kl")) * _z(F.coalesce("don_gia", "c_gia")))
    price_moved = v & (op == X.OP_MODIFY) & (F.abs(_z("n_gia") - _z("c_gia")) > TOL["price"]) & F.col("loai_gia").isin(X.LUMP_SUM, X.FIXED_PRICE)

    def hit(cond, check, level, text):
        return F.when(cond, F.struct(F.lit(check).alias("check"), (level if isinstance(level, Column) else F.lit(level)).alias("level"),
                                     F.lit(text).alias("message")))

    found = F.array_compact(F.array(
        hit(~known, "P04", X.BLOCK, "unknown operation"),
        hit(target_gone & F.col("bo_boi").isNotNull(), "P04", X.BLOCK, "target was removed"),
        hit(target_gone & F.col("bo_boi").isNull(), "P04", X.BLOCK, "target is not in force"),
        hit(exists, "P04", X.BLOCK, "added code already exists"),
        hit(short, "P04", X.BLOCK, "added line is incomplete"),
        hit(v & (op == X.OP_MODIFY) & ~_blank("ten") & (fold(F.col("ten")) != fold(F.col("c_ten"))), "P04", X.YELLOW, "renamed"),
        hit(v & (op == X.OP_ADD) & F.col("matched").isNotNull(), "P04", X.YELLOW, "possible duplicate"),
        hit(v & (op != X.OP_REMOVE) & (F.abs(stated) > TOL["line_total"]), "P04", X.YELLOW, "stated total differs"),
        hit(price_moved, "P16", F.when(F.col("can_cu") == "", X.RED).otherwise(X.YELLOW), "price change in a fixed-price contract"),
        hit(v & (op == X.OP_REMOVE) & (F.col("paid") > TOL["paid"]), "P14", X.RED, "removed but already paid"),
        hit(v & (op == X.OP_MODIFY) & (F.col("kl") + TOL["paid"] < F.col("paid")), "P14", X.RED, "reduced below the paid quantity"),
        hit(v & (op == X.OP_MODIFY) & is_live & (F.col("paid") > _z("c_kl") + TOL["paid"]) & (F.col("paid_day") < F.col("ky")), "P15", X.RED,
            "over-quantity accepted before signing")))
    return b.withColumn("found", found)


def check_params(f: DataFrame, a_rows: DataFrame, params: DataFrame, changes: DataFrame, amendments: DataFrame) -> DataFrame:
    """Parameter rows with their current value on the form's effective date and findings (array)."""
    key = f.select("form_id", "ma_hd", "hl")
    a = a_rows.withColumn("ma_ts", F.upper(F.trim(F.coalesce("ma_ts", F.lit(""))))).join(key, "form_id")
    in_force = state.signed(amendments).join(key, "ma_hd").filter(F.col("hl").isNull() | (F.col("ngay_hieu_luc") <= F.col("hl")))
    cur = (changes.join(in_force.select(F.col("id").alias("pl_id"), "form_id", "so_pl", "ngay_hieu_luc", "ngay_ky"), "pl_id").groupBy("form_id", "ma_ts")
           .agg(F.max_by("gia_tri_moi", F.struct("ngay_hieu_luc", "ngay_ky", "so_pl", "pl_id")).alias("last"), F.lit(True).alias("changed")))
    p = params.select("ma_hd", "ma_ts", F.col("gia_tri").alias("base_v"), F.lit(True).alias("in_base"))
    j = a.join(cur, ["form_id", "ma_ts"], "left").join(p, ["ma_hd", "ma_ts"], "left")
    j = j.withColumn("current", F.when(F.coalesce("changed", F.lit(False)), F.col("last")).otherwise(F.col("base_v")))
    good = F.col("ma_ts").rlike(X.PARAM_CODE)
    given = ~F.coalesce(F.col("moi") == "", F.lit(True))
    close = F.coalesce(F.abs(num(F.col("cu")) - num(F.col("current"))) < 1e-9, F.lit(False))
    old_differs = ~F.coalesce(F.col("cu") == "", F.lit(True)) & (fold(F.col("cu")) != fold(F.col("current"))) & ~close

    def hit(cond, level, text):
        return F.when(cond, F.struct(F.lit("P05").alias("check"), F.lit(level).alias("level"), F.lit(text).alias("message")))

    ok = good & given
    found = F.array_compact(F.array(
        hit(~good, X.BLOCK, "invalid code"), hit(good & ~given, X.BLOCK, "no new value"),
        hit(ok & F.col("in_base").isNull(), X.YELLOW, "code not in the base parameters"),
        hit(ok & old_differs, X.YELLOW, "old value is not the current one"),
        hit(ok & _blank("trich"), X.YELLOW, "no quotation"),
        hit(ok & (F.col("ma_ts") == "TT-02"), X.INFO, "TT-02 is computed")))
    return j.withColumn("valid", ok & (F.col("ma_ts") != "TT-02")).withColumn("found", found)


def check_forms(f: DataFrame, lines: DataFrame, value: DataFrame, amendments: DataFrame) -> DataFrame:
    """Form-level findings (array) next to the sums they rest on."""
    s = lines.groupBy("form_id").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("valid"), 1)).alias("n_valid"),
                                     F.sum(F.coalesce("delta", F.lit(0.0))).alias("delta"))
    used = (amendments.filter(F.col("trang_thai") != X.CANCELLED).groupBy("ma_hd", "so_pl").agg(F.count("*").alias("n_same")))
    top = (amendments.filter(F.col("trang_thai") != X.CANCELLED).groupBy("ma_hd")
           .agg(F.max(F.regexp_extract("so_pl", r"(\d+)", 1).try_cast("bigint")).alias("max_no")))
    j = (f.join(s, "form_id", "left").join(value, "form_id", "left").join(used, ["ma_hd", "so_pl"], "left").join(top, "ma_hd", "left")
         .fillna(0, ["n_rows", "n_valid", "max_no"]).fillna(0.0, ["delta", "delta_before"]))
    v1 = 1 + F.col("vat")
    j = j.withColumns({"line_value": F.col("delta") * v1, "value_before": F.col("base_value") + F.col("delta_before"),
                       "no": F.regexp_extract("so_pl", r"(\d+)", 1).try_cast("bigint")})
    yes, no = F.col("doi") == "co", F.col("doi") == "khong"
    fits = F.abs(F.col("line_value") - F.col("gts")) <= money_tolerance(F.col("gts"))
    chain = F.abs(F.col("value_before") + F.col("gts") - F.col("t_hd")) <= money_tolerance(F.col("t_hd"))

    def hit(cond, check, level, text):
        return F.when(cond, F.struct(F.lit(check).alias("check"), F.lit(level).alias("level"), F.lit(text).alias("message")))

    found = F.array_compact(F.array(
        hit(F.col("bad_date"), "P01", X.BLOCK, "unreadable date"), hit(F.col("so_pl") == "", "P01", X.BLOCK, "no number"),
        hit(F.col("ky").isNull(), "P01", X.BLOCK, "no signing date"), hit(~F.col("tt").isin(X.SIGNED, X.DRAFT), "P01", X.BLOCK, "bad status"),
        hit(~(yes | no), "P01", X.BLOCK, "bad yes/no"), hit((F.col("so_pl") != "") & F.col("n_same").isNotNull(), "P02", X.BLOCK, "number in use"),
        hit(yes & (F.col("n_rows") == 0), "P03", X.BLOCK, "change announced, no line"), hit(no & (F.col("n_rows") > 0), "P03", X.BLOCK, "lines without announcement"),
        hit(F.col("stated_nothing") & yes & (F.abs("delta") > 0), "P10", X.RED, "no value stated, lines change it"),
        hit(yes & (F.col("n_valid") > 0) & ~fits, "P10", X.RED, "lines x (1 + VAT) differ from the stated value"),
        hit(yes & (F.col("n_valid") > 0) & fits, "P10", X.PASS, "lines match the stated value"),
        hit(no & (F.abs("gts") > 0) & (F.col("loai_gia") != X.LUMP_SUM), "P17", X.YELLOW, "value changed without lines"),
        hit(F.col("t_hd").isNotNull() & ~chain, "P11", X.RED, "value chain broken"), hit(F.col("t_hd").isNotNull() & chain, "P11", X.PASS, "value chain holds"),
        hit(F.col("no").isNotNull() & (F.col("no") != F.col("max_no") + 1), "P12", X.YELLOW, "number gap"),
        hit(F.col("ky") < F.col("hd_ngay_ky"), "P13", X.RED, "signed before the contract"), hit(F.col("hl") < F.col("ky"), "P13", X.YELLOW, "retroactive"),
        hit(F.col("tt") == X.DRAFT, "P18", X.YELLOW, "draft")))
    return j.withColumn("found", found)


def contract_value_change(forms_checked: DataFrame, params: DataFrame, changes: DataFrame, amendments: DataFrame) -> DataFrame:
    """The TT-02 change written for every form that changes the contract value."""
    key = forms_checked.select("form_id", "ma_hd", "hl")
    in_force = state.signed(amendments).join(key, "ma_hd").filter(F.col("hl").isNull() | (F.col("ngay_hieu_luc") <= F.col("hl")))
    cur = (changes.filter("ma_ts = 'TT-02'").join(in_force.select(F.col("id").alias("pl_id"), "form_id", "so_pl", "ngay_hieu_luc", "ngay_ky"), "pl_id")
           .groupBy("form_id").agg(F.max_by("gia_tri_moi", F.struct("ngay_hieu_luc", "ngay_ky", "so_pl", "pl_id")).alias("last")))
    base = params.filter("ma_ts = 'TT-02'").select("ma_hd", F.col("gia_tri").alias("base_v"))
    j = forms_checked.filter(F.abs("gts") > 0).join(cur, "form_id", "left").join(base, "ma_hd", "left")
    old = F.coalesce(money(F.coalesce("last", "base_v")), F.lit(0.0))
    new = old + F.when(fold(F.col("gom_vat")).isin(X.NO_VAT_WORDS), F.col("gtt")).otherwise(F.col("gts"))
    return j.select("form_id", "ma_hd", F.lit("TT-02").alias("ma_ts"), old.alias("v_old"), new.alias("v_new"))


def check_amendments(forms, a_rows, b_rows, contracts, amendments, boq, params, changes, paid) -> dict:
    """All findings and the normalised rows of every form."""
    f = read_forms(forms, contracts)
    rows, value = state_before(f, boq, amendments)
    rows = cut_lineage(rows)                               # read by four branches
    lines = cut_lineage(check_lines(f, b_rows, rows, boq, paid))   # read by the line and the form findings
    pr = check_params(f, a_rows, params, changes, amendments)
    fm = check_forms(f, lines, value, amendments)
    ent = F.col("form_id").cast("string")

    def out(df, entity):
        return df.select("form_id", entity.alias("entity"), F.explode("found").alias("x")).select(
            "form_id", *finding("", F.col("x.level"), F.col("entity"), F.col("x.message"))[1:4], F.col("x.check").alias("check"))

    allf = (out(lines, F.concat_ws("/", ent, F.col("dong").cast("string"))).unionByName(out(pr, F.concat_ws("/", ent, "ma_ts")))
            .unionByName(out(fm, ent)))
    return {"findings": allf, "lines": lines, "params": pr, "forms": fm}


def blocked(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("level") == X.BLOCK).select("form_id").distinct()


def gate(checked: dict) -> dict:
    """What may be written: forms without a blocking finding, their valid lines and parameters, and the kept findings."""
    stop = blocked(checked["findings"])
    keep = checked["forms"].select("form_id").join(stop, "form_id", "left_anti")
    return {
        "forms": checked["forms"].join(stop, "form_id", "left_anti"),
        "lines": checked["lines"].filter("valid").join(keep, "form_id", "left_semi"),
        "params": checked["params"].filter("valid").join(keep, "form_id", "left_semi"),
        "findings": checked["findings"].filter(~F.col("level").isin(X.PASS, X.INFO)).join(keep, "form_id", "left_semi"),
    }
