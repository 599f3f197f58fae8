"""Passes over a growing source as streaming queries: they read what is new, upsert by key, and stop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.operators.resolve import last_wins
from perigee.sources.store import Store


def _place(spark: SparkSession) -> str:
    """A folder that driver and executors share; one of our own only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/pass_{uuid.uuid4().hex[:12]}"


def read_stream(spark: SparkSession, path: str, schema=None, max_files: int | None = None) -> DataFrame:
    schema = schema or spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if name.endswith(".parquet") and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def _event_stream(spark: SparkSession, path: str) -> DataFrame:
    """events.parquet as a stream, whether it is a file or a folder of files."""
    schema = spark.read.parquet(path).schema
    files = spark.read.parquet(path).inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(path.rpartition("/")[2]):
        return read_stream(spark, path, schema)
    return spark.readStream.schema(schema).parquet(path)


def upsert_pass(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, event_id, value): the last event of each user, kept by keyed upserts of micro-batches.

    An upsert of a batch that was written before gives the same rows, so a batch that runs again after a
    failure does no harm.
    """
    where = _place(spark)
    store = Store(spark, f"{where}/store")

    def write(batch: DataFrame, _: int) -> None:
        new = last_wins(batch.select("user_id", "event_id", "value"), "user_id", "event_id")
        old = store.read("latest")
        store.write("latest", new if old is None else last_wins(old.unionByName(new), "user_id", "event_id"))

    q = _event_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return store.read("latest")


def gap_fill(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, value) of purchases, read in two passes: a first one with a gap, and one that fills it.

    Late rows are accepted: the second pass reads the missed range again and drops what is known.
    """
    where = _place(spark)
    store = Store(spark, f"{where}/store")

    def run(keep, name: str) -> None:
        def write(batch: DataFrame, _: int) -> None:
            old = store.read("events")
            store.write("events", batch if old is None else old.unionByName(batch.join(old.select("event_id"), "event_id", "left_anti")))

        rows = _event_stream(spark, path).where("event_type = 'purchase'").where(keep).select("event_id", "value").dropDuplicates(["event_id"])
        rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/{name}").trigger(availableNow=True).start().awaitTermination()

    run(F.col("event_id") % 10 < 7, "first")
    run(F.col("event_id") % 10 >= 5, "gap")
    return store.read("events")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: counts and sums per tumbling window and type, with a watermark; ts is cast as watermarks
    need an instant."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return t.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
