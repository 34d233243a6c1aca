"""Streams of job events and requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_path
from ..sources.versioned import Merge, VersionedTable

# Requests per client and minute.
LIMITS = {"acquisitions": 20, "uploads": 12}
DEFAULT_LIMIT = 120


def file_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    """Parquet files of a folder and the folders below it in order of arrival, some at a time."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of one table as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "false").parquet(folder)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(stream: DataFrame, mode: str, keys: list[str] | None = None, path: str | None = None) -> DataFrame:
    """All that is there now, through the stream: every batch is written to the shared folder, replays replace their batch.

    With ``keys``, the newest row of each key counts (update mode). A ``path`` that an
    earlier call used goes on from that call's state. State is kept in RocksDB.
    """
    spark = stream.sparkSession
    path = path or shared_path(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:  # a query takes its session's settings when it starts
        running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)
    running.awaitTermination()
    out = spark.read.parquet(f"{path}/out").drop("batch")
    if keys:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))).where("_n = 1").drop("_n")
    return out.drop("_batch")


def rate_buckets(requests: DataFrame, client: str, group: str, at: str = "ts") -> DataFrame:
    """Requests of each client and group in each minute, and whether they pass the limit."""
    by = requests.withWatermark(at, "2 minutes").groupBy(F.window(at, "1 minute"), client, group).agg(F.count("*").alias("n"))
    limit = F.lit(DEFAULT_LIMIT)
    for name, most in LIMITS.items():
        limit = F.when(F.col(group) == name, most).otherwise(limit)
    return by.select(F.col("window.start").alias("minute"), client, group, "n", (F.col("n") > limit).alias("rejected"))


def state_fold(events: DataFrame, job: str, order: str, columns: list[str]) -> DataFrame:
    """The newest state of every job, by the event's number."""
    return events.groupBy(job).agg(F.max(F.struct(order, *columns)).alias("s")).select(job, f"s.{order}", *[f"s.{c}" for c in columns])


def sessions(touches: DataFrame, key: str, gap: str, delay: str, at: str = "ts") -> DataFrame:
    """Closed sessions of each key: touches less than ``gap`` apart belong together; a session ends a gap after its last touch.

    With the lease time as gap, an ended session is a lease that ran out.
    """
    by = touches.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("touches"))
    return by.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "touches")


def deduplicate(entries: DataFrame, keys: list[str], delay: str, at: str = "ts") -> DataFrame:
    """At-least-once deliveries take effect once within the delay."""
    return entries.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def current_holder(writes: DataFrame, delay: str, holder: str, current: str, at: str = "ts") -> DataFrame:
    """Writes of the present holder, per minute; later ones than the watermark are dropped."""
    own = writes.where(F.col(holder) == F.col(current)).withWatermark(at, delay)
    return own.groupBy(F.window(at, "1 minute")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), "n")


def ingest(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], table: VersionedTable, merge: Merge, name: str = "ingest") -> DataFrame:
    """New files run through ``apply`` and are merged into the table; after a restart, with the table alone as memory, nothing counts twice.

    The stream's own checkpoint lies beside the table's log.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        table.commit(apply(batch), merge, name, batch_id)

    stream.writeStream.option("checkpointLocation", f"{table.path}/_streams/{name}").foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    return table.read()
