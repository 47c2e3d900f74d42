"""Session helpers: configuration defaults and lineage cutting."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app="claimgrid", master=None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; the caller's conf wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a single-machine session (local master: tests, bench)
    gets a fresh folder; a cluster session gets an error, since its executors could not see each other's local folders."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    d = d or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


_HELD: dict = {}
_LOCK = threading.Lock()


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict):
    """Session settings that hold inside the block, also where several threads are in one; the caller's come back when the last leaves."""
    with _LOCK:
        for k, v in conf.items():
            users, before = _HELD.get((id(spark), k), (0, spark.conf.get(k, None)))
            _HELD[id(spark), k] = users + 1, before
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _LOCK:
            for k in conf:
                users, before = _HELD.pop((id(spark), k))
                if users > 1:
                    _HELD[id(spark), k] = users - 1, before
                elif before is None:
                    spark.conf.unset(k)
                else:
                    spark.conf.set(k, before)


#: While a table is written: the shuffle files behind it go once it stands, and don't stay until the driver happens to collect its garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def write_table(df: DataFrame, path: str) -> None:
    with settings(df.sparkSession, FREED):
        df.write.parquet(path)


def one_exchange(spark: SparkSession):
    """Inside, tables dealt out by a part of a join's keys (all rows of a workbook together) are joined as they lie."""
    return settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"})


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and read it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "claimgrid", uuid.uuid4().hex)
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


FEW = 200_000


def sized(df: DataFrame) -> DataFrame:
    """Materialise df for joins: broadcast if it has few rows, else merged. A file of repeating values is many times smaller than its
    rows in memory; by its size Spark would send millions of rows through the driver."""
    table = cut_lineage(df)
    return table.hint("broadcast" if table.count() <= FEW else "merge")
