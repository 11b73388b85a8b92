"""Parquet tables of a data folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from siftwarden.shipping import ship


#: Inputs up to this many bytes are dealt out to all cores; larger ones keep their own splits.
SPREAD_BYTES = 256 << 20


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """Lazily reads ``<folder>/<name>.parquet``; instants are taken and shown in UTC.

    That is a setting of the session, so a session in another zone is set to UTC here and stays
    so. ``spread``: for work that costs much per row, see ``spread_out``.
    """
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return spread_out(df) if spread else df


def spread_out(df: DataFrame, most: int = SPREAD_BYTES) -> DataFrame:
    """Deals the rows of a small scan to all cores where it has fewer splits than those, as with
    one file of one row group. The bound is in bytes, whatever the number of cores: a scan of
    more than ``most`` bytes is never shuffled for that, however large the cluster is."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. Only where
    that is unset (local tests) a folder below the temporary space is chosen."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(os.environ.get("TMPDIR", "/tmp"), f"siftwarden-{context.applicationId}")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of ``df`` through files that all executors share."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A frame that is read several times, written once as a table in the shared folder; column
    pruning and filters reach it. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def still_there(df: DataFrame) -> bool:
    """Whether the files of a stored frame are where they were written."""
    files = df.inputFiles()
    if not files:
        return False
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(files[0])
    return bool(place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place))
