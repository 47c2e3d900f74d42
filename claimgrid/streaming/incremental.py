"""Incremental extraction: documents already answered are skipped by content key; a rerun takes up only what is left.

What was answered is a table of content keys in hash buckets; a batch reads the buckets its documents fall into. Each batch writes
below its own number, results first and keys last, and its keys mark it as done: a batch that was cut off is written again in
place, one that is replayed after that writes nothing. Documents with too little text are reported, keep no key, and are tried
again when they come again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgrid.functions.text import content_key
from claimgrid.operators import extract
from claimgrid.operators.scan import first_per
from claimgrid.session import cut_lineage

SOURCE = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType())])
BUCKETS, LEAST = 64, 20


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def answered(spark: SparkSession, out: str) -> DataFrame | None:
    """(bucket, batch, key, doc_id) of the documents answered so far; None before the first."""
    return spark.read.schema("key string, doc_id string, bucket int, batch long").parquet(f"{out}/keys") if exists(spark, f"{out}/keys") else None


def extract_batch(docs: DataFrame, batch: int, out: str, model: str = "rules", least: int = LEAST) -> None:
    """Append the parameters of docs(doc_id, text) to out/rows, once per content key, and failures to out/failed.

    Of several documents with the same text the one with the smallest doc_id is answered. least: paragraphs a document must have.
    """
    spark = docs.sparkSession
    if exists(spark, f"{out}/done/batch={batch}/_SUCCESS"):
        return
    d = docs.withColumn("key", content_key(F.coalesce("text", F.lit("")), F.lit(model), F.lit(False), F.lit(True))).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    d = first_per(d, ["key"], ["doc_id"])
    seen = answered(spark, out)
    if seen is not None:
        touched = d.select("bucket").distinct()
        d = d.join(seen.filter(F.col("batch") != batch).join(F.broadcast(touched), "bucket", "left_semi").select("key"), "key", "left_anti")
    d = cut_lineage(d)
    paras = cut_lineage(extract.split_paragraphs(d, "key"))
    size = d.join(paras.groupBy("key").agg(F.count("*").alias("n")), "key", "left").select("key", "doc_id", "bucket", F.coalesce("n", F.lit(0)).alias("n"))
    good = cut_lineage(size.filter(F.col("n") >= least))
    rows = extract.extract_params(paras.join(good.select("key"), "key", "left_semi").withColumnRenamed("key", "doc_id")).drop("items").withColumnRenamed("doc_id", "key")
    at = lambda table: f"{out}/{table}/batch={batch}"
    rows.join(good.select("key", "doc_id"), "key").write.mode("overwrite").parquet(at("rows"))
    size.filter(F.col("n") < least).select("doc_id", "key", F.col("n").alias("paragraphs")).write.mode("overwrite").parquet(at("failed"))
    keys = good.select("key", "doc_id", "bucket", F.lit(batch).cast("long").alias("batch"))
    keys.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{out}/keys")
    spark.range(1).select(F.lit(batch).alias("no")).write.mode("overwrite").parquet(at("done"))


def incremental_extract(spark: SparkSession, source: str, out: str, checkpoint: str, model: str = "rules", least: int = LEAST) -> None:
    """Read new JSON documents (doc_id, text) below source and append their parameters to out, once per content key."""
    docs = spark.readStream.schema(SOURCE).json(source)
    q = docs.writeStream.foreachBatch(lambda df, no: extract_batch(df, no, out, model, least)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
