"""Tables written to the folder that all executors share, to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (one machine, tests), a new temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pointweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation. The
    folder goes when the application ends, or by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pointweave-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    back = spark.read.schema(df.schema).parquet(path)
    back._pointweave_path = path
    return back


def forget(df: DataFrame | None) -> None:
    """Remove what ``written`` wrote for ``df``, which nothing may read any more."""
    path = getattr(df, "_pointweave_path", None)
    if path:
        target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
