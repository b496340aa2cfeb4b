"""Structured Streaming forms: gap sessions, duplicate-free appends, and the state of keys kept per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def streamed_sessions(events: DataFrame, by: str, gap: str = "30 minutes", lateness: str = "0 seconds") -> DataFrame:
    """Closed sessions (start, end, n) per key; the last one stays open until the watermark passes its end."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(by, F.session_window("ts", gap).alias("session"))
        .agg(F.count("*").alias("n"))
        .select(by, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")
    )


def streamed_touches(edits: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each (source, path, ts) once."""
    return edits.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["source", "path", "ts"])


def bursts(changes: DataFrame, path: str = "path", quiet: str = "2 seconds", lateness: str = "0 seconds") -> DataFrame:
    """The last row of each burst of changes of a path: one that is followed by nothing for as long as ``quiet``.

    A burst is given once, when the watermark has passed its quiet time; the newest stays back until then.
    """
    others = [c for c in changes.columns if c != path]
    last = F.max_by(F.struct(*others), F.struct("ts", *[c for c in others if c != "ts"])).alias("last")
    return changes.withWatermark("ts", lateness).groupBy(path, F.session_window("ts", quiet).alias("burst")).agg(last, F.count("*").alias("changes")).select(path, "last.*", "changes")


def watch(spark: SparkSession, root: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds", most_files: int = 1000):
    """Look for new files under ``root`` again and again, ``most_files`` at a time, and hand each batch over; gives the running query.

    Files that come while a batch is worked off are taken by the next one, all together.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true").json(root)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def by_day(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off what is there, micro-batch by micro-batch, exactly once."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def written(stream: DataFrame, path: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def kept_state(root: str, key: Column, state: Callable[[DataFrame], DataFrame], buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """Handler of micro-batches that keeps a keyed state under ``root``: ``state`` of all events of each key seen so far.

    Events go to a log in folders by a hash of their key. Only keys of the batch are worked out again, from the folders that
    they lie in, whatever order events come in; so late ones are right too, where a running state would have to guess. A
    batch that is tried again overwrites what it wrote. Events with a null key are left out.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_key", key).where("_key is not null").withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/log/batch={number}")
        log = spark.read.option("basePath", f"{root}/log").schema(f"{_ddl(rows)}, batch int").parquet(f"{root}/log").where(F.col("batch") <= number)
        fresh = log.where(F.col("batch") == number)
        folders = [r["_bucket"] for r in fresh.select("_bucket").distinct().collect()]
        if folders:
            seen = log.where(F.col("_bucket").isin(folders)).join(fresh.select("_key").distinct(), "_key", "left_semi")
            state(seen.drop("_key", "_bucket", "batch")).write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    return handle


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def state_now(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The newest state of each key."""
    rows = spark.read.option("basePath", f"{root}/state").parquet(f"{root}/state")
    columns = [c for c in rows.columns if c not in ("batch", key)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("s")).select(key, "s.*")
