import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions import formulas as S
from claimgrid.functions import numbers as N
from claimgrid.functions import text as T
from claimgrid.operators import extract, match


def one(spark, v, fn):
    return spark.createDataFrame([(v,)], "s string").select(fn(F.col("s")).alias("v")).first()["v"]


@pytest.mark.parametrize("fn,text,want", [
    (N.num, "0,15", 15.0), (N.num, "1.234", 1.234), (N.num, "1d", None), (N.vn_number, "1.234", 1234.0), (N.vn_number, "0,15", 0.15),
    (N.money, "(1.234.000)", -1234000.0), (N.rate, "8%", 0.08), (N.rate, "1", 1.0), (N.rate, "0.08", 0.08), (N.rate, "8", 0.08),
    (N.date_vn, "31/02/2026", None), (N.date_vn, "5/3/2026", dt.date(2026, 3, 5)), (N.date_vn, "2026-03-05 10:00", dt.date(2026, 3, 5)),
    (T.fold, "  ĐIỀU  khoản\tsố ", "dieu khoan so")])
def test_scalars(spark, fn, text, want):
    assert one(spark, text, fn) == want


def test_formula_parts(spark):
    f = "=IF('A b'!$C$4>2,\"x!A1\",[2]Z!D5:D9)*1.08+E7"
    refs = one(spark, f, lambda c: S.parse_refs(c, F.lit("S")))
    assert [(r.sheet, r.c1, r.r1, r.c2, r.r2, r.ext) for r in refs] == [("A b", 3, 4, 3, 4, None), ("Z", 4, 5, 4, 9, 2), ("S", 5, 7, 5, 7, None)]
    assert one(spark, f, S.embedded_literals) == ["1.08"]
    assert one(spark, "=ROUND(A1*0.5,0)/3", S.embedded_literals) == ["0.5", "3"]
    assert one(spark, "=$A1+B$2+'x y'!C3:D4", lambda c: S.formula_pattern(c, F.lit(2), F.lit(3))) == "=C1R[-1]+C[-1]R2+<xy>!C[0]R[1]:C[1]R[2]"
    assert one(spark, "12.5%", S.is_number_text) and not one(spark, "12", S.is_number_text)


def test_rules_compile_and_read(spark):
    paras = [("d", i, "", t) for i, t in enumerate([
        "Căn cứ luật", "Hợp đồng theo đơn giá cố định.", "Giá trị hợp đồng là 1.234.567.890 đồng", "thuế GTGT 8%", "Thu hồi dần khoản tạm ứng theo từng đợt",
        "Tiền phạt 1.5 triệu được khấu trừ vào đợt kế tiếp", "Chậm 07 ngày đầu, tạm giữ 0,5%"])]
    df = spark.createDataFrame(paras, "doc_id string, pos long, section string, text string")
    got = {r.ma: (r.v_num, r.v_str) for r in extract.first_hits(extract.rule_hits(df)).collect()}
    assert got["TT-02"][0] == 1234567890.0 and got["TT-04"][0] == 0.08 and got["TT-52"][0] == 0.005
    assert got["TT-01"][1] == "đơn giá cố định" and "1.5" in got["TT-56"][1] and "TT-11" in got
    assert len(X.RULES) == 34 and len(X.PARAMETERS) == 36


def test_similar_names_equal_brute_force(spark):
    import difflib
    import random
    rnd = random.Random(3)
    words = ["be tong", "cot thep", "van khuon", "dam", "san", "mong", "tang 1", "tang 2", "lot", "da 1x2", "xay", "gach"]
    names = [" ".join(rnd.sample(words, rnd.randint(2, 4))) for _ in range(60)]
    names += [n[:-1] + "x" for n in names[:20]]
    df = spark.createDataFrame([("c", n) for n in names], "k string, f_name string")
    got = {(r.l_name, r.r_name) for r in match.similar_names(df, df, ["k"], 0.85).collect()}
    want = {(a, b) for a in set(names) for b in set(names) if difflib.SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert got == want
