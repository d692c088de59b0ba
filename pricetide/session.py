"""Session helpers: settings the engine relies on and reliable lineage cuts."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "pricetide", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session for scripts and tests; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "8g").config(
                "spark.ui.enabled", "false"
            )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, using the cluster's own setting when it has one.

    A temporary folder is only acceptable in local mode, where driver and
    executors share one machine; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="pricetide-ckpt-")
    sc.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the reliable checkpoint folder and restart its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet below the checkpoint folder and read it again; its lineage ends there.

    For large frames with several readers: each reads the columns that it needs, where a
    checkpoint is read row by row and whole. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """True when `df` has at most `max_rows` rows; reads no more than one row beyond that.

    Meant for frames that are cheap to read (checkpointed, or a stored table).
    """
    return df.limit(max_rows + 1).count() <= max_rows
