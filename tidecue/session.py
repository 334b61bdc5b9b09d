"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, memory: str = "8g", name: str = "tidecue") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # the work per byte is high here
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors must share.

    The folder named by spark.checkpoint.dir wins. Only a local session that
    has neither it nor a checkpoint folder gets one in the temporary folder; on
    a cluster that is an error, as executors would write to their own disks.
    """
    sc = spark.sparkContext
    # files of checkpoints that nothing refers to any more are removed by Spark's cleaner
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tidecue-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, in the storage that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder and cut its lineage.

    Partitions keep their number, order and rows, so two passes over the result
    see the same layout even if executors are lost between them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filter_before_shuffles(spark: SparkSession) -> None:
    """Let joins that shuffle filter their large side by a Bloom filter of the small side's keys, whatever the large side's size.

    The filter holds at most spark.sql.optimizer.runtime.bloomFilter.maxNumBits
    (8 MB). By default Spark makes one only from 10 GB scanned on.
    """
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1g")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores.

    A scan of a few small files gives few partitions, too few for operators
    that work long on each row. Larger inputs are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    import shutil

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tidecue-ship-"), "tidecue")
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
    _SHIPPED.add(app)
