"""Number, rate, money and date parsing.  The three number readers differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions.text import fold

_FLOAT = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
_GROUPED = r"^\d{1,3}(\.\d{3})+$"
_GROUPED_ANY = r"^\d{1,3}([.,]\d{3})+$"
_PERCENT = r"^-?\d+([.,]\d+)?\s*%$"


def plain_float(c: Column) -> Column:
    """Decimal literal or NULL (type suffixes that the JVM would accept are refused)."""
    return F.when(c.rlike(_FLOAT), F.trim(c).try_cast("double"))


def num(c: Column) -> Column:
    """Commas dropped, then a plain number: '0,15' -> 15, '1.234' -> 1.234."""
    return plain_float(F.replace(c, F.lit(","), F.lit("")))


def num_strict(c: Column) -> Column:
    """Plain number with commas kept (so '1,5' is no number)."""
    return plain_float(c)


def vn_number(c: Column) -> Column:
    """Thousand dots and decimal comma: '1.234' -> 1234, '0,15' -> 0.15."""
    t = F.trim(c)
    nodots = F.replace(t, F.lit("."), F.lit(""))
    return (F.when(t.rlike(_GROUPED), nodots.try_cast("double"))
            .when(t.contains(","), plain_float(F.replace(nodots, F.lit(","), F.lit("."))))
            .otherwise(plain_float(t)))


def money(c: Column) -> Column:
    """Grouped digits with . or ,; a leading minus or parentheses make it negative."""
    t = F.replace(F.trim(c), F.lit(" "), F.lit(""))
    neg = t.startswith("-") | (t.startswith("(") & t.endswith(")"))
    body = F.regexp_replace(F.regexp_replace(t, r"^[-()]+", ""), r"[-()]+$", "")
    v = F.when(body.rlike(_GROUPED_ANY), F.regexp_replace(body, "[.,]", "").try_cast("double")).otherwise(num(body))
    return F.when(neg, -v).otherwise(v)


def rate_of_number(v: Column) -> Column:
    return F.when(v > 1, v / 100).otherwise(v)


def rate(c: Column) -> Column:
    """'8%' -> 0.08; a bare number above 1 is a percentage, exactly 1 means 100 %."""
    t = F.replace(F.trim(c), F.lit(","), F.lit("."))
    pct = plain_float(F.regexp_extract(t, r"([\d.]+)\s*%", 1))
    return F.coalesce(pct / 100, F.when(~t.rlike(r"[\d.]+\s*%"), rate_of_number(plain_float(t))))


def date_vn(c: Column) -> Column:
    """d/m/yyyy with / . or -, or a leading ISO date; anything else is NULL."""
    t = F.trim(c)
    dmy = F.regexp_extract(t, r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$", 1)
    built = F.try_to_date(F.concat_ws(
        "-", F.regexp_extract(t, r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$", 3),
        F.lpad(F.regexp_extract(t, r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$", 2), 2, "0"), F.lpad(dmy, 2, "0")), "yyyy-MM-dd")
    iso = F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return F.when(dmy != "", built).otherwise(iso)


def format_date(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "dd/MM/yyyy"), F.lit(""))


def format_qty(c: Column) -> Column:
    """'-' for NULL, no decimals for whole numbers, else up to three."""
    whole = F.abs(c - F.rint(c)) <= 1e-9
    dec = F.regexp_replace(F.regexp_replace(F.format_number(c, 3), "0+$", ""), r"\.$", "")
    return F.when(c.isNull(), "-").when(whole, F.format_number(c, 0)).otherwise(dec)


def price_type(c: Column) -> Column:
    b = fold(c)
    return (F.when(b.contains("tron goi"), X.LUMP_SUM).when(b.contains("dieu chinh"), X.ADJUSTED_PRICE)
            .when(b.contains("co dinh"), X.FIXED_PRICE).otherwise(F.coalesce(c, F.lit(""))))


def canonical_value(v_str: Column, v_num: Column | None = None) -> Column:
    """struct(n, s): number when the value reads as one (%, grouped, integer, counted days), else folded text."""
    t = F.trim(v_str)
    n = F.round(
        F.when(t.rlike(_PERCENT), vn_number(F.trim(F.regexp_replace(t, r"[% ]+$", ""))) / 100)
        .when(t.rlike(r"^(\d{1,3}([.,]\d{3})+|\d+)$"), F.regexp_replace(t, "[.,]", "").try_cast("double"))
        .when(t.rlike(r"^(\d+)\s*(ngày|tháng|bộ)$"), F.regexp_extract(t, r"^(\d+)", 1).try_cast("double")), 6)
    if v_num is not None:
        n = F.coalesce(F.round(v_num, 6), n)
    return F.struct(n.alias("n"), F.when(n.isNull() & v_str.isNotNull(), fold(v_str)).alias("s"))


def typed_ai_value(v: Column, unit: Column) -> Column:
    """struct(n, s) of an answer string read by the parameter's unit; NULL members when nothing was found."""
    t = F.trim(v)
    gone = t.isNull() | (t == "") | (F.upper(t) == X.NOT_FOUND)
    n = (F.when(t.rlike(_PERCENT), F.round(vn_number(F.trim(F.regexp_replace(t, r"[% ]+$", ""))) / 100, 6))
         .when((unit == "đồng") & t.rlike(r"^(\d{1,3}([.,]\d{3})+|\d+)$"), F.regexp_replace(t, "[.,]", "").try_cast("double"))
         .when(unit.isin("ngày", "tháng", "bộ") & t.rlike(r"^(\d+)(\s*(ngày|tháng|bộ))?$"),
               F.regexp_extract(t, r"^(\d+)", 1).try_cast("double")))
    n = F.when(~gone, n)
    return F.struct(n.alias("n"), F.when(~gone & n.isNull(), t).alias("s"))


def add_missing_percent(v: Column, unit: Column) -> Column:
    """A bare number above 1 under a % unit gets its sign back."""
    g = F.trim(v)
    return F.when(unit.startswith("%") & g.rlike(r"^\d+([.,]\d+)?$") & (vn_number(g) > 1), F.concat(g, F.lit("%"))).otherwise(v)


def numbers_in_text(c: Column, percent: Column) -> Column:
    """All numbers of a text in order, divided by 100 under a % unit."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:[.,]\d+)*)"), 1)
    vals = F.transform(raw, lambda t: F.when(t.rlike(_GROUPED), F.replace(t, F.lit("."), F.lit("")).try_cast("double"))
                       .otherwise(plain_float(F.replace(t, F.lit(","), F.lit(".")))))
    return F.transform(F.filter(vals, lambda v: v.isNotNull()), lambda v: F.when(percent, v / 100).otherwise(v))


def format_value(code: Column, v: Column) -> Column:
    """Short display of a parameter: rates as per cent, contract value with thousand marks."""
    lettered = v.rlike("[a-zA-ZÀ-ỹ]")
    r = rate(v)
    pct = F.regexp_replace(F.regexp_replace(F.format_number(r * 100, 6), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (F.when(v.isNull() | (v == ""), "")
            .when(code.isin(X.RATE_CODES) & r.isNotNull() & ~lettered, F.concat(F.replace(pct, F.lit(","), F.lit("")), F.lit("%")))
            .when((code == "TT-02") & money(v).isNotNull(), F.format_number(money(v), 0))
            .otherwise(v))
