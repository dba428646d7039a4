"""One stream of run events for many subscribers: a shared log that a batch enters once, and a cursor for each subscriber.

A batch's rows go to a folder named after it, which is overwritten if the batch is run again after a crash, so nothing enters twice. A subscriber that comes late is given the log so far, then what has come since its last visit; its
cursor is the last batch that it has taken, kept beside the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .progress import TERMINAL

_BATCH = "batch_id"


def published(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream into the log at path; by default it ends once all that is there has been read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Subscriber:
    """A reader of the log by name. take() gives new rows and keeps the cursor in mind; done() makes it last. A crash between them gives the same rows again."""

    def __init__(self, spark: SparkSession, path: str, cursors: str, name: str, schema: str, run_id=None):
        self.spark, self.path, self.schema, self.run_id = spark, path, schema, run_id
        self.own = f"{cursors}/name={name}"
        self.taken = None

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def cursor(self) -> int:
        """The last batch that is done, -1 before the first."""
        return self.spark.read.schema("last long").parquet(self.own).agg(F.max("last")).first()[0] if self._exists(self.own) else -1

    def take(self) -> DataFrame:
        """Rows of all batches after the cursor, of the subscriber's run if it has one and only up to its terminal event, in order of batch and seq."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], f"{self.schema}, {_BATCH} long")
        after = self.cursor()
        log = self.spark.read.schema(f"{self.schema}, {_BATCH} long").parquet(self.path)
        self.taken = max(log.select(F.max(_BATCH)).first()[0] or 0, after)
        new = log.where((F.col(_BATCH) > after) & (F.col(_BATCH) <= self.taken))
        if self.run_id is not None:
            own = log.where(F.col("run_id") == self.run_id)
            end = own.where(F.col("type").isin(*TERMINAL)).agg(F.min("seq").alias("_end"))  # one row
            new = new.where(F.col("run_id") == self.run_id).join(F.broadcast(end)).where("_end is null or seq <= _end").drop("_end")
        return new.orderBy(_BATCH, "seq")

    def done(self) -> None:
        """Marks what take() gave as read."""
        if self.taken is not None:
            self.spark.createDataFrame([(self.taken,)], "last long").coalesce(1).write.mode("append").parquet(self.own)
