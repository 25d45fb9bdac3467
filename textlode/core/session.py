"""Session-dependent helpers: where to cut lineage and how to read tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where none is set, a temporary folder serves a local session, as in tests;
    on a cluster that's an error, as no folder of one machine is seen by all.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="textlode-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"{shared_dir(spark).rstrip('/')}/textlode/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, what: str = "table") -> str:
    """A new path in the application's part of the shared folder."""
    return f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textlode_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialized tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_textlode_path", None)
        if path:
            _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Remove everything that this application wrote to the shared folder, once its results have been read."""
    _delete(spark, own_dir(spark))


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked to be sent to all executors if it has fewer than ``most`` rows, else as it is."""
    return broadcast(df) if df.limit(most).count() < most else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
