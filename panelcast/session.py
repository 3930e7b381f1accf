"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build(app: str = "panelcast", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the library is written for."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Slots are UTC; hour truncation goes through the session zone, so pin it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only on one machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    folder = folder or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="panelcast-")
        sc.setCheckpointDir(folder)
    return folder


def stage_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{_shared_folder(spark)}/panelcast-{uuid.uuid4().hex}"


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Write a stage result once as a table and read it back.

    For results that several later branches use: they share one computation,
    read only their columns, and a lost executor never sends work back past it.
    With ``release`` the shuffle files behind the result go once it is written,
    not whenever the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if release and before is None:
            spark.conf.unset(RELEASE)
        elif release:
            spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def default_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
