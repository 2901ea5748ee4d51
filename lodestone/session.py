"""Session settings, table access and staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINT_DIR = "/tmp/lodestone-checkpoints"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests, benches and notebooks; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read through Spark so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores: rows of a table that is read by fewer tasks than
    there are cores, as one of a few row groups, are dealt out; a larger table
    stays as it is read. For work that costs far more than the rows' transfer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else
    the context's checkpoint folder. A session of one machine gets a local one
    where neither is set; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if configured:
        return configured.rstrip("/")
    if context.getCheckpointDir().isEmpty():
        if not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINT_DIR)
    return context.getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/lodestone/{app}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage is cut, and
    the rows survive the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Remove staged tables that later steps have replaced."""
    for frame in frames:
        discard(frame.sparkSession, frame.staged_path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
