"""Tables written once to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only a session on this one machine may go without that setting; it then gets a temporary folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Folders that staged() has written and nobody has dropped.
_written: list[str] = []


def staged(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends there and lost executors cost nothing."""
    path = work_dir(df.sparkSession)
    _written.append(path)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, folders: set[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dropped(*frames: DataFrame) -> None:
    """Removes what staged() wrote for the frames, once nothing reads them any more."""
    for df in frames:
        _deleted(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def cleared(spark: SparkSession) -> None:
    """Removes all that staged() has written in this session and nobody has dropped. For the end of a query: call it when its result has been written, as results may read staged tables."""
    _deleted(spark, set(_written))
    _written.clear()


def few(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; for the choice between a broadcast and a shuffle, so df should be cheap to count."""
    return df.limit(most + 1).count() <= most


def sent(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is."""
    return F.broadcast(df) if few(df, most) else df
