"""Session helper and the shared scratch folder."""

from __future__ import annotations

import os
import pathlib
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = str(pathlib.Path(__file__).resolve().parents[1])


def build_session(app: str = "fleetwear", **conf: str) -> SparkSession:
    """A session for jobs started by this package; callers may bring their own."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Call sites per column expression cost more than building the plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def python_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Where the path does not exist on the executors the package must be installed there.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is the cluster's checkpoint folder. Where none is named, a session on a
    single machine uses its warehouse; on a cluster that would be each
    executor's own disk, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/fleetwear/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has staged; results that still read it must be written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def release(staged: DataFrame) -> None:
    """Delete what ``stage`` wrote, once everything computed from it is written elsewhere."""
    path = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(staged._staged_at)
    path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
