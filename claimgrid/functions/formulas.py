"""Spreadsheet-formula expressions. References and patterns are worked out by one Arrow function a formula: as expressions they took
some twenty passes of a pattern over each formula.  The others are evaluated in the JVM."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgrid import fixed as X

_REF_FIELDS = ["sheet", "c1", "r1", "c2", "r2", "ext"]
_REFS = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n == "sheet" else T.IntegerType()) for n in _REF_FIELDS]))


def col_letters(idx: Column) -> Column:
    """1 -> 'A', 27 -> 'AA' (three letters at most, as in a worksheet)."""
    def ch(n):
        return F.char(n + 65)
    i = idx.cast("int") - 1
    two = F.floor(i / 26) - 1
    three = F.floor(two / 26) - 1
    return (F.when(i < 26, ch(i % 26))
            .when(i < 702, F.concat(ch(two % 26), ch(i % 26)))
            .otherwise(F.concat(ch(three % 26), ch(two % 26), ch(i % 26))))


def coord(col: Column, row: Column) -> Column:
    return F.concat(col_letters(col), row.cast("string"))


def is_formula(c: Column) -> Column:
    return F.coalesce(c.startswith("="), F.lit(False))


def is_total(c: Column) -> Column:
    return F.coalesce(c.rlike(X.TOTAL_FORMULA), F.lit(False))


def is_error(c: Column) -> Column:
    return F.coalesce(F.trim(c).isin(X.ERROR_VALUES), F.lit(False))


def blank_strings(c: Column) -> Column:
    return F.regexp_replace(c, X.STRING_LITERAL, '""')


_STRING, _QUOTED, _LOCAL = (re.compile(p, re.ASCII) for p in (X.STRING_LITERAL, X.QUOTED_REF, X.LOCAL_REF))
_INDEX = re.compile(r"^\[(\d+)\]", re.ASCII)


@functools.lru_cache(maxsize=20000)
def _number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def _blanked(formula: str) -> str:
    return _STRING.sub('""', formula) if '"' in formula else formula


def _boxes(formula: str, sheet: str):
    """References (sheet, c1, r1, c2, r2, ext) of one formula: sheet-qualified ones first, then local ones."""
    body = _blanked(formula)
    if "!" in body:
        for q, u, _, ca, _, ra, _, cb, _, rb in _QUOTED.findall(body):
            raw = q.replace("''", "'") if q else u
            link = _INDEX.match(raw)
            ext = int(link.group(1)) if link else None
            yield raw[link.end():] if link else raw, _number(ca), int(ra), _number(cb or ca), int(rb or ra), ext if ext is None or ext < 2 ** 31 else None
        body = _QUOTED.sub(" ", body)
    for _, ca, _, ra, _, cb, _, rb in _LOCAL.findall(body):
        yield sheet, _number(ca), int(ra), _number(cb or ca), int(rb or ra), None


@F.arrow_udf(_REFS)
def _parsed(formula: pa.Array, sheet: pa.Array) -> pa.Array:
    found, offsets = [], []
    for f, s in zip(formula.to_pylist(), sheet.to_pylist()):
        offsets.append(None if f is None else len(found))
        if f is not None:
            found.extend(_boxes(f, s))
    columns = zip(*found) if found else [()] * 6
    fields = [pa.array(c, pa.string() if n == "sheet" else pa.int32()) for n, c in zip(_REF_FIELDS, columns)]
    return pa.ListArray.from_arrays(pa.array([*offsets, len(found)], pa.int32()), pa.StructArray.from_arrays(fields, _REF_FIELDS))


def parse_refs(formula: Column, sheet: Column) -> Column:
    """Array of references {sheet, c1, r1, c2, r2, ext}: sheet-qualified ones first, then local ones."""
    return _parsed(formula, sheet)


def _relative(formula: str, row: int, col: int) -> str:
    def part(cd, c, rd, r):
        return (f"C{_number(c)}" if cd else f"C[{_number(c) - col}]") + (f"R{r}" if rd else f"R[{int(r) - row}]")

    def pair(da, ca, ea, ra, db, cb, eb, rb):
        return part(da, ca, ea, ra) + (":" + part(db, cb, eb, rb) if cb else "")

    body = _blanked(formula)
    if "!" in body:
        body = _QUOTED.sub(lambda m: f"<{m[1] or m[2]}>!{pair(*m.groups()[2:])}", body)
    return _LOCAL.sub(lambda m: pair(*m.groups()), body).replace(" ", "")


@F.arrow_udf(T.StringType())
def _patterns(formula: pa.Array, row: pa.Array, col: pa.Array) -> pa.Array:
    cells = zip(formula.to_pylist(), row.to_pylist(), col.to_pylist())
    return pa.array([None if None in c else _relative(*c) for c in cells], pa.string())


def formula_pattern(formula: Column, row: Column, col: Column) -> Column:
    """Formula with references made relative to its own cell, so that equal fill-down patterns compare equal."""
    return _patterns(formula, row, col)


def simple_pattern(formula: Column) -> Column:
    """Row numbers blanked only (the coarser pattern of the fixed-template audit)."""
    return F.regexp_replace(F.regexp_replace(formula, r"[$+ ]", ""), r"([A-Z]{1,3})\d+", "$1#")


def _without_refs(formula: Column, mark: str) -> Column:
    return F.regexp_replace(F.regexp_replace(blank_strings(formula), X.QUOTED_REF, mark), X.LOCAL_REF, mark)


_LIT = r"(?<![\w.$\[])\d+(?:\.\d+)?%?(?![\w.\[])"


def embedded_literals(formula: Column) -> Column:
    """Literals that stand next to * or /; rounding arguments, 0, 1, 100 and 1000 do not count."""
    body = F.regexp_replace(_without_refs(formula, "X"), r",\s*-?\d+\s*\)", ")")
    found = F.regexp_extract_all(body, F.lit(rf"((?<=[*/]\s{{0,9}}){_LIT}|{_LIT}(?=\s*[*/]))"), 1)
    return F.filter(found, lambda s: ~s.isin(X.NEUTRAL_LITERALS))


def rate_literals(formula: Column) -> Column:
    """Distinct percentages and decimals, sorted (fixed-template audit)."""
    return F.array_sort(F.array_distinct(
        F.regexp_extract_all(_without_refs(formula, " "), F.lit(r"(\d+(?:\.\d+)?%|\d+\.\d+)"), 1)))


def literal_kind(s: Column) -> Column:
    return (F.when(s.isin(X.TAX_LITERALS), X.LITERAL_TAX)
            .when(s.endswith("%") | s.rlike(r"^0\.\d{1,2}$"), X.LITERAL_RATE).otherwise(X.LITERAL_OTHER))


def external_links(formula: Column) -> Column:
    return F.transform(F.regexp_extract_all(blank_strings(formula), F.lit(r"\[(\d+)\]"), 1), lambda s: s.cast("int"))


def is_single_ref(formula: Column) -> Column:
    """The whole formula is one cell reference."""
    return blank_strings(formula).rlike(r"^=\s*\+?\s*(?:'[^']+'|[^!=]+)?!?\$?[A-Z]{1,3}\$?\d+\s*$")


def is_sum_of_refs(formula: Column) -> Column:
    """Only additions and subtractions of single references."""
    return _without_refs(formula, "X").rlike(r"^=\s*[+\-]?\s*X(\s*[+\-]\s*X)+\s*$")


def is_branching(formula: Column) -> Column:
    return formula.rlike(r"(?i)^=\s*(IF|MIN|MAX)\(")


def is_number_text(c: Column) -> Column:
    """A number kept as text, other than one- or two-digit labels."""
    t = F.replace(F.trim(c), F.lit(" "), F.lit(""))
    return F.coalesce(t.rlike(r"^[-+]?\d+([.,]\d+)?%?$") & ~t.rlike(r"^\d{1,2}$"), F.lit(False))
