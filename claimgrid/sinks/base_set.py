"""Sink: the base set of each contract (parameters, documents, priced lines with totals, amendments, prior quantities, history, log).

All contracts are written at once. A run writes its tables below its own name and a manifest last; readers take a run only by its
manifest, so a run that was cut off is not seen, and one that is repeated replaces what it wrote.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrid.operators import state
from claimgrid.operators.quality import line_value
from claimgrid.schemas import pyround

MANIFEST = "manifest"


def with_totals(lines: DataFrame, keys: list, value) -> DataFrame:
    """Lines with the totals of each shorter prefix of keys in one pass: keys (null where summed over), level (number of keys that a
    row has) and thanh_tien."""
    sets = [keys[:n] for n in range(len(keys), 0, -1)]
    summed = lines.withColumn("__v", value).groupingSets(sets, *keys).agg(F.sum("__v").alias("thanh_tien"), F.grouping_id().alias("__g"))
    return summed.withColumn("level", (len(keys) - F.bit_count("__g")).cast("int")).drop("__g")


def base_set(contracts: DataFrame, params: DataFrame, documents: DataFrame, boq: DataFrame, amendments: DataFrame, prior: DataFrame, history: DataFrame, log: DataFrame) -> dict:
    """The tables of the base set. contracts: ma_hd, vat and what the base value needs; params: ma_hd, ma_ts, gia_tri; documents:
    ma_hd, loai, tai_lieu; boq: base lines; prior: ma_hd, ma_hm, kl, dot; history and log: as they are.

    BOQ and KL ky truoc carry lines, totals by group (BOQ) and by contract; BOQ tong adds tax, the value with tax, the contract's stated
    value and the gap between them.
    """
    keys = ["ma_hd", "nhom", "ma_hm"]
    lines = with_totals(boq, keys, line_value())
    stated = contracts.select("ma_hd", F.coalesce("vat", F.lit(0.0)).alias("vat"), state.base_value_with_vat(contracts).alias("theo_hd"))
    total = lines.filter("level = 1").select("ma_hd", F.col("thanh_tien").alias("truoc_thue")).join(stated, "ma_hd").withColumn("thue", pyround(F.col("truoc_thue") * F.col("vat")))
    total = total.withColumn("sau_thue", F.col("truoc_thue") + F.col("thue")).withColumn("chenh_lech", F.col("sau_thue") - F.col("theo_hd"))
    paid = prior.join(boq.select("ma_hd", "ma_hm", "don_gia"), ["ma_hd", "ma_hm"], "left")
    of = lambda p: params.filter(F.col("ma_ts").startswith(p))
    return {"Thong tin HD": of("TC"), "Dieu khoan TT": of("TT"), "Ho so TT theo HD": documents, "BOQ": lines, "BOQ tong": total, "Phu luc": amendments,
            "KL ky truoc": with_totals(paid, ["ma_hd", "ma_hm"], line_value()), "Lich su TT": history, "Nhat ky": log}


def commit_tables(tables: dict, folder: str, run: str) -> None:
    """Write tables below folder/run, then the manifest that makes them readable."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{run}/{name.replace(' ', '_')}")
    spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{run}/{MANIFEST}")


def committed(spark: SparkSession, folder: str, run: str) -> dict:
    """The tables of a run that was written to the end; none of any other."""
    try:
        names = [r.name for r in spark.read.parquet(f"{folder}/{run}/{MANIFEST}").collect()]
    except AnalysisException:
        return {}
    return {n: spark.read.parquet(f"{folder}/{run}/{n.replace(' ', '_')}") for n in names}


def with_period(history: DataFrame, periods: DataFrame) -> DataFrame:
    """history with the rows of newly approved periods (ma_hd, dot, ...), which replace rows of the same period."""
    return history.join(periods.select("ma_hd", "dot"), ["ma_hd", "dot"], "left_anti").unionByName(periods, allowMissingColumns=True)


def ingested(existing: DataFrame, incoming: DataFrame, decisions: DataFrame) -> DataFrame:
    """The contracts after an ingest by its decisions (so_hd, decision): new ones are added, redone ones replaced, refused ones stay."""
    taken = incoming.join(decisions.filter(F.col("decision").isin("new", "redo")).select("so_hd"), "so_hd", "left_semi")
    return existing.join(taken.select("so_hd"), "so_hd", "left_anti").unionByName(taken, allowMissingColumns=True)
