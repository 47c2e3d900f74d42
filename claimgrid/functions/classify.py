"""Ordered classifiers written as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions.text import fold, norm


def lookup(mapping: dict, key: Column, default=None) -> Column:
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.element_at(m, key), F.lit(default))


def root_data_group(header: Column, label: Column, sheet: Column) -> Column:
    """One of the seven input groups, or outside; the first matching branch wins."""
    t = fold(F.concat_ws(" ", F.coalesce(header, F.lit("")), F.coalesce(sheet, F.lit(""))))
    both = F.concat(t, F.lit(" "), fold(label))
    return (F.when(t.contains("don gia"), X.GROUP_PRICE)
            .when(both.rlike(r"k[iy] truoc|dot truoc|luy ke truoc"), X.GROUP_PRIOR)
            .when(t.rlike(r"hop dong|\bhd\b") & t.rlike(r"khoi luong|\bkl\b"), X.GROUP_QTY_CONTRACT)
            .when(both.rlike(r"tam ung|da thanh toan|thanh toan dot|dot \d|unc"), X.GROUP_PAID)
            .when(t.rlike(r"k[iy] nay|thuc hien|nghiem thu|hoan thanh"), X.GROUP_THIS)
            .when(both.rlike(r"%|ty le|thue suat|he so|giu lai")
                  | (both.rlike(r"\bthue\b|vat|gtgt") & ~t.contains("gia tri")), X.GROUP_PARAM)
            .when(both.rlike(r"gia tri hop dong|gia tri hd"), X.GROUP_VALUE)
            .when(t.rlike(r"khoi luong|\bkl\b|dien giai|kich thuoc|dai|rong|cao|so luong"), X.GROUP_DETAIL)
            .otherwise(X.GROUP_OUTSIDE))


def proof_of_group(group: Column) -> Column:
    return lookup(X.PROOF, group, "")


def _compact(c: Column) -> Column:
    return F.regexp_replace(c, "[+ ]", "")


def cumulative_source(formula: Column, value_text: Column, row: Column, note: Column) -> Column:
    """Class of the detail cell that feeds a cumulative quantity; formula NULL and value NULL mean an empty cell."""
    f = _compact(formula)
    own = F.concat(F.lit("=D"), row.cast("string"))
    return (F.when(formula.isNull() & value_text.isNull(), "DG_TRONG")
            .when(formula.isNull(), F.when(norm(note).contains("thống k"), "DG_NHAPTAY_THEP").otherwise("DG_NHAPTAY"))
            .when(f == own, "DG_BANG_KLHD")
            .when(f.rlike(r"\d+%\*D\d+|D\d+\*\d+%"), "DG_TYLE")
            .when(F.upper(f).contains("SUM(K") | F.upper(f).contains("PRODUCT("), "DG_DIENGIAI")
            .otherwise("DG_CT_KHAC"))


def accept_source(formula: Column, row: Column) -> Column:
    """Class of a this-period cell on the acceptance sheet when no detail cell is linked."""
    f = F.replace(formula, F.lit(" "), F.lit(""))
    return (F.when(formula.isNull(), "BBNT_G_NHAPTAY")
            .when(f.isin("") | (f == F.concat(F.lit("=E"), row.cast("string"))) | (f == F.concat(F.lit("=+E"), row.cast("string"))),
                  "BBNT_G_BANG_KLHD").otherwise("BBNT_G_KHAC"))


def prior_source(formula: Column, row: Column) -> Column:
    f = _compact(formula)
    own = F.concat(F.lit("E"), row.cast("string"))
    return (F.when(formula.isNull(), "NHAPTAY")
            .when(F.upper(f).contains("DGPLH") | formula.contains("PLHĐ"), "SHEET_AN")
            .when(f == F.concat(F.lit("="), own), "BANG_KLHD")
            .when(f.contains(F.concat(own, F.lit("*"))), "TYLE").otherwise("KHAC"))


def price_pattern(price: Column, k: float = X.PRICE_FACTOR) -> Column:
    base = price / F.lit(k)
    taxed = base * 1.08
    return (F.when(price.isNull(), "").when(price == F.floor(price), X.PRICE_INTEGER)
            .when(F.abs(base - F.bround(base / 100) * 100) < 0.01, X.PRICE_ROUND)
            .when(F.abs(taxed - F.bround(taxed / 100) * 100) < 0.01, X.PRICE_ROUND_VAT)
            .otherwise(X.PRICE_ODD))


def cap_branch(detail: Column, contract: Column, prior: Column) -> Column:
    """Branch taken by the capped acceptance formula."""
    return (F.when((detail < contract) & (detail < prior), "Giữ KL kỳ trước (DG < kỳ trước)")
            .when(detail > contract, "Chặn trần = KL HĐ (DG > HĐ)").otherwise("Theo DG KL"))


def payment_factor(part: Column, vat: float = X.VAT_RATE, build: float = X.RETENTION_BUILD,
                   equip: float = X.RETENTION_EQUIP) -> Column:
    """How much the requested payment falls per unit of this-period value removed."""
    return F.when(part == "XD", F.lit((1 + vat) * (1 - build))).otherwise(F.lit((1 + vat) * (1 - equip)))


def payment_effect(part: Column, this_value: Column, prior_value: Column, cum_value: Column,
                   vat: float = X.VAT_RATE) -> tuple[Column, Column]:
    """(effect of the this-period part, effect of the whole cumulative part)."""
    f = payment_factor(part)
    whole = F.when(part == "XD", cum_value * f).otherwise(this_value * f + prior_value * F.lit(1 + vat))
    return this_value * f, whole


def proof_document(sheet: Column, col: Column, kind: Column, text: Column) -> Column:
    t = X.TEMPLATE
    qty_sheets = [t["value"], t["qty"], t["accept"]]
    typed = (F.when(sheet == t["summary"], "E01-E04 hồ sơ thanh toán các đợt đã duyệt, UNC")
             .when((sheet == t["value"]) & (col == "I"), "A02 BOQ / A04 phụ lục (đơn giá)")
             .when((col == "E") & sheet.isin(qty_sheets), "A02 BOQ / A04 phụ lục (KL hợp đồng)")
             .when((sheet == t["accept"]) & (col == "F"), "E03 hồ sơ Đợt 3 đã ký (KL lũy kế kỳ trước)")
             .when((sheet == t["accept"]) & (col == "G"), "C02 BB nghiệm thu / D01 BB giao nhận thiết bị")
             .when((sheet == t["detail"]) & (col == "D"), "A02 BOQ / A04 phụ lục (KL hợp đồng)")
             .when((sheet == t["detail"]) & (col == "L"), "B06 diễn giải KL / B03 hoàn công")
             .when(sheet == t["detail"], "B01 bản vẽ thi công / B03 hoàn công (kích thước)")
             .when(sheet == t["steel"], "B05 bản vẽ kết cấu, thống kê thép")
             .otherwise("Cần xác định nguồn"))
    param = (F.when(kind.contains("1.08") | F.lower(text).contains("thuế"), "F01 căn cứ thuế suất GTGT")
             .when(sheet.isin(t["detail"], t["accept"]), "C05 xác nhận % tiến độ của TVGS")
             .otherwise("A01 điều khoản HĐ (tạm ứng / thu hồi / giữ lại / hóa đơn)"))
    return (F.when(kind == X.SRC_EXTERNAL, "E07 file Excel đang liên kết")
            .when(kind.startswith("Tham số"), param).when(kind != X.SRC_TYPED, "").otherwise(typed))
