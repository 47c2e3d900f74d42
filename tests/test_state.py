import datetime as dt
import random

from pyspark.sql import functions as F

from claimgrid.operators import state

BOQ = ("id long, ma_hd string, pl_id long, thao_tac string, ma_hm string, stt string, nhom string, ten string, dvt string, "
       "kl double, don_gia double, thanh_tien_ghi double, khoa string")
AM = "id long, ma_hd string, so_pl string, ngay_ky date, ngay_hieu_luc date, trang_thai string, gt_sau_vat double"
ATTRS = ["ten", "kl", "don_gia"]


def line(i, pl, op, hm, ten="x", kl=None, gia=None):
    return (i, "HD1", pl, op, hm, None, "g", ten, "m3", kl, gia, None, "k" + hm if op in ("GOC", "THEM") else None)


def test_worked_example(spark):
    d = dt.date
    am = spark.createDataFrame([(1, "HD1", "PL01", d(2026, 6, 1), d(2026, 6, 15), "Đã ký", 0.0)], AM)
    boq = spark.createDataFrame([line(1, None, "GOC", "HM0006", kl=25.0, gia=10.0), line(2, None, "GOC", "HM0007", kl=5.0, gia=1.0),
                                 line(3, 1, "THAY", "HM0006", ten=None, kl=30.0), line(4, 1, "THEM", "HM0098", kl=2.0, gia=7.0), line(5, 1, "BO", "HM0007", ten=None)], BOQ)

    def at(day):
        rows = state.effective_rows(boq, am, F.to_date(F.lit(day))).collect()
        return {(r.ma_hm, r.state): (r.kl, r.don_gia, r.nguon) for r in rows}
    assert at("2026-06-10") == {("HM0006", "live"): (25.0, 10.0, "HĐ gốc"), ("HM0007", "live"): (5.0, 1.0, "HĐ gốc")}
    assert at("2026-07-10") == {("HM0006", "live"): (30.0, 10.0, "PL01"), ("HM0098", "live"): (2.0, 7.0, "PL01"), ("HM0007", "removed"): (5.0, 1.0, "HĐ gốc")}


def naive(lines, amendments):
    live, gone = {}, {}
    order = {a[0]: (a[4], a[3], a[2]) for a in amendments}
    events = [x for x in lines if x[2] is None] + sorted((x for x in lines if x[2] is not None), key=lambda x: (order[x[2]], x[0]))
    no = {a[0]: a[2] for a in amendments}
    for x in events:
        hm, op = x[4], x[3]
        row = {"ten": x[7], "kl": x[9], "don_gia": x[10]}
        if op in ("GOC", "THEM"):
            live[hm] = row
        elif op == "THAY" and hm in live:
            live[hm] = {k: (row[k] if row[k] not in (None, "") else live[hm][k]) for k in ATTRS}
        elif op == "BO" and hm in live:
            gone[hm] = (live.pop(hm), no[x[2]])
    out = {(h, "live"): (tuple(r[k] for k in ATTRS), None) for h, r in live.items()}
    out.update({(h, "removed"): (tuple(r[k] for k in ATTRS), by) for h, (r, by) in gone.items()})
    return out


def test_segments_equal_a_naive_fold(spark):
    rnd = random.Random(7)
    for _case in range(6):
        am = [(i, "HD1", f"PL{i}", dt.date(2026, 1, rnd.randint(1, 9)), dt.date(2026, 2, rnd.randint(1, 9)), "Đã ký", 0.0) for i in range(1, 9)]
        lines = [line(i, None, "GOC", f"HM{i}", kl=float(i), gia=1.0) for i in range(1, 4)]
        n = 10
        for a in am:
            for h in rnd.sample(range(1, 6), 3):
                n += 1
                op = rnd.choice(["THAY", "THEM", "BO"])
                lines.append(line(n, a[0], op, f"HM{h}", ten=rnd.choice(["", None, f"t{n}"]) if op == "THAY" else f"n{n}",
                                  kl=rnd.choice([None, 0.0, float(n)]) if op == "THAY" else float(n), gia=rnd.choice([None, float(n)]) if op == "THAY" else 2.0))
        got = state.effective_rows(spark.createDataFrame(lines, BOQ), spark.createDataFrame(am, AM)).collect()
        mine = {(r.ma_hm, r.state): ((r.ten, r.kl, r.don_gia), r.bo_boi if r.state == "removed" else None) for r in got}
        assert mine == naive(lines, am)


def test_prior_period_matches_brute_force(spark):
    """One contract holds most rows; numbered, dated and undated claims, undated periods."""
    rnd = random.Random(3)
    day = lambda: rnd.choice([None, dt.date(2026, 1, 1) + dt.timedelta(rnd.randrange(60))])
    periods = [(rnd.choice(["A", "A", "A", "B"]), n, day(), float(rnd.randrange(99))) for n in range(1, 150)]
    claims = [(rnd.choice("AABC"), rnd.choice([None, rnd.randrange(160)]), day()) for _ in range(150)]
    got = state.prior_period(spark.createDataFrame(claims, "ma_hd string, dot int, ngay date"), spark.createDataFrame(periods, "ma_hd string, dot int, ngay_nghiem_thu date, gt_luy_ke double"))
    want = set()
    for c, dot, on in claims:
        hit = [(p[1], p[3]) for p in periods if p[0] == c and (p[1] < dot if dot is not None else p[2] is None or (on is not None and p[2] < on))]
        if hit:
            want.add((c, dot, on, *max(hit)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_later_amendments_form_no_other_pairs(spark):
    """A contract with many amendments of the same day and number; only rows of the result leave a join."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["A", "A", "B"]), f"PL{rnd.randrange(9)}", dt.date(2026, 1, rnd.randint(1, 5)), rnd.choice(["Đã ký", "Đã ký", "Đã hủy"])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ma_hd string, so_pl string, ngay_hieu_luc date, trang_thai string")
    got = sorted((r.cancelled_id, r.id) for r in state.later_amendments(df, df.filter("trang_thai = 'Đã hủy'")).collect())
    assert got == sorted((c[0], a[0]) for c in rows for a in rows if c[4] == "Đã hủy" != a[4] and c[1] == a[1] and (a[3], a[2]) > (c[3], c[2]))


def test_range_bounded_chunks_split_a_hot_key(spark):
    """Half of all rows have one key and one value, with sparse numbers; no chunk holds more than twice the median."""
    from pyspark.sql import functions as F

    from claimgrid.operators import scan
    rows = [("hot", 5.0, 1000 * n) for n in range(4000)] + [(f"k{n % 900}", float(n % 3), n) for n in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double, id long")
    sizes = sorted(r[1] for r in scan.ranged(df, ["k"], ["v", "id"], "c").groupBy("c").count().collect())
    assert len(sizes) >= 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = {(r.k, r.id): r.s for r in scan.scan(df, ["k"], None, ["v", "id"], sums={"s": F.lit(1)}).collect()}
    want, count = {}, {}
    for k, _, i in sorted(rows):
        count[k] = count.get(k, 0) + 1
        want[k, i] = count[k]
    assert got == want
