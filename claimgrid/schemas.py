"""Explicit schemas of the contract store, the cell grid and the findings table, and the tolerance table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
    "strings": T.ArrayType(T.StringType()),
}


def _parse(spec: str) -> T.StructType:
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _TYPES[kind], True))
    return T.StructType(fields)


# Table and column names of the contract store (the data model users already have).
STORE = {
    "hop_dong": "ma_hd string,so_hd string,phan_loai string,loai_gia string,ngay_ky date,goi_thau string,"
                "gia_tri_hd double,gom_vat string,vat double,file_nguon string,ngay_nap timestamp",
    "tham_so": "ma_hd string,ma_ts string,ten string,gia_tri string,don_vi string,dieu_khoan string,"
               "trich_dan string,trang_thai string",
    "phu_luc": "id long,ma_hd string,so_pl string,ngay_ky date,ngay_hieu_luc date,loai string,doi_boq boolean,"
               "gt_truoc_vat double,gt_sau_vat double,gt_hd_sau_pl double,noi_dung string,can_cu string,"
               "file_nguon string,phieu string,trang_thai string,nguoi_nhap string,ngay_nap timestamp,ly_do_huy string",
    "thay_doi_tham_so": "pl_id long,ma_ts string,gia_tri_cu string,gia_tri_moi string,trich_dan string",
    "boq_dong": "id long,ma_hd string,pl_id long,thao_tac string,ma_hm string,stt string,nhom string,ten string,"
                "dvt string,kl double,don_gia double,thanh_tien_ghi double,khoa string,vi_tri_nguon string,ghi_chu string",
    "dot_thanh_toan": "ma_hd string,dot int,ngay_nghiem_thu date,ngay_nhan_hs date,gt_ky double,gt_luy_ke double,"
                      "giu_lai double,thu_hoi_tu double,gt_tt_ky double,file_nguon string,ngay_nap timestamp",
    "kl_thanh_toan": "ma_hd string,dot int,ma_hm string,kl_ky double,kl_luy_ke double,don_gia_tt double,"
                     "vi_tri_nguon string",
    "khop_hang_muc": "ma_hd string,khoa_hstt string,ma_hm string,cach_khop string,nguoi_xac_nhan string,ngay timestamp",
    "canh_bao": "id long,ma_hd string,pl_id long,dot int,ma_kt string,muc_do string,noi_dung string,"
                "thoi_diem timestamp",
    "nhat_ky": "id long,thoi_diem timestamp,nguoi string,thao_tac string,ma_hd string,chi_tiet string",
}


def store_schema(table: str) -> T.StructType:
    return _parse(STORE[table])


CELLS = _parse("file string,sheet string,sheet_idx int,sheet_state string,row int,col int,formula string,"
               "v_num double,v_str string,is_bool boolean")
PARTS = _parse("file string,kind string,sheet string,r1 int,c1 int,r2 int,c2 int,no int,name string,text string")
PARAGRAPHS = _parse("doc_id string,pos long,section string,text string")
DOCUMENT_TEXT = _parse("file string,kind string,pages int,text string,note string,needs_ocr boolean")

FINDING_COLUMNS = ["check", "level", "entity", "message", "n", "amount"]

# Tolerances, one per check.
TOL = {
    "price": 0.5,             # unit price differs
    "qty": 1e-6,              # quantity differs
    "line_total": 1.0,        # stated line total against quantity x price
    "paid": 1e-9,             # paid quantity against a reduced quantity
    "retention": 0.0005,      # retention ratio
    "approved": 1.0,          # stated against approved cumulative value
    "catalogue": 1e-6,        # numeric parameter of a catalogue row
    "value_rel": 1e-9,        # extractor values, relative
    "money_abs": 1000.0,      # money: max(money_abs, money_rel * |x|)
    "money_rel": 1e-5,
}


def money_tolerance(amount: Column) -> Column:
    return F.greatest(F.lit(TOL["money_abs"]), F.abs(F.coalesce(amount, F.lit(0.0))) * TOL["money_rel"])


def pyround(c: Column, digits: int = 0) -> Column:
    """Half-even rounding (stored results)."""
    return F.bround(c, digits)


def xlround(c: Column, digits: int = 0) -> Column:
    """Half-away rounding (worksheet formulas)."""
    return F.round(c, digits)
