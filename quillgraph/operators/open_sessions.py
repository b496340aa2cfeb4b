"""Co-edits kept up to date batch by batch: sessions as mergeable state.

A session is its first and last time and its first few distinct files, each with the time and position of its first touch.
Two sessions that overlap, or are no further apart than the gap, are one session: its ends are the outer ones, and its first
files are among the first files of both. So a batch's touches become sessions of their own, and these are merged with those
kept sessions that they reach; a late touch may lengthen a session or join two. Only the days that change are written again.
However the touches are cut into batches, and in whatever order these come, the sessions are those of one run over all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import constants as C
from . import tables

SCHEMA = "start timestamp, end timestamp, files array<struct<ts:timestamp,pos:bigint,file:string>>"
_BIN = 3600


def merged(sessions: DataFrame, seconds: int = C.SESSION_GAP_SECONDS, cap: int = C.CO_EDIT_FILES) -> DataFrame:
    """Sessions (SCHEMA), those that reach each other as one.

    Each opens something at its start and closes it a gap after its end; a new session starts where nothing is open. What is
    open is a running sum, taken within bins of an hour and carried from bin to bin by one row a bin.
    """
    micros = lambda c: F.unix_micros(c)
    marks = sessions.select("*", F.explode(F.array(F.struct(micros("start").alias("at"), F.lit(1).alias("by")), F.struct((micros("end") + F.lit(seconds * 1_000_000)).alias("at"), F.lit(-1).alias("by")))).alias("m"))
    marks = marks.select("start", "end", "files", F.col("m.at").alias("at"), F.col("m.by").alias("by"), F.floor(F.col("m.at") / (_BIN * 1_000_000)).alias("bin"))
    within = Window.partitionBy("bin").orderBy("at", F.col("by").desc(), "start", "end")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("open", F.coalesce(F.sum("by").over(before), F.lit(0)))
    across = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.groupBy("bin").agg(F.sum("by").alias("by")).withColumn("carried", F.coalesce(F.sum("by").over(across), F.lit(0))).select("bin", "carried")
    starts = marks.join(carried, "bin").where("by = 1").withColumn("opens", (F.col("open") + F.col("carried") == 0).cast("long"))
    inner = Window.partitionBy("bin").orderBy("at", "start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = starts.withColumn("inner", F.sum("opens").over(inner))
    opened = starts.groupBy("bin").agg(F.sum("opens").alias("opens")).withColumn("base", F.coalesce(F.sum("opens").over(across), F.lit(0))).select("bin", "base")
    numbered = starts.join(opened, "bin").withColumn("session", F.col("inner") + F.col("base"))
    ends = numbered.groupBy("session").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    firsts = numbered.select("session", F.explode("files").alias("f")).groupBy("session", "f.file").agg(F.min(F.struct("f.ts", "f.pos")).alias("first"))
    few = firsts.withColumn("rn", F.row_number().over(Window.partitionBy("session").orderBy("first", "file"))).where(F.col("rn") <= cap)
    files = few.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("first.ts", "first.pos", "file"))).alias("files"))
    return ends.join(files, "session").select("start", "end", "files")


def of_touches(touches: DataFrame, seconds: int = C.SESSION_GAP_SECONDS, cap: int = C.CO_EDIT_FILES) -> DataFrame:
    """Sessions of (ts, pos, file); rows without a time or file are in none. Touches of a minute go together first, so
    that what is merged is a session's minutes, not its touches."""
    rows = touches.where("ts is not null and file is not null").select(F.col("ts").cast("timestamp").alias("ts"), F.col("pos").cast("long").alias("pos"), "file")
    minute = F.floor(F.unix_micros("ts") / F.lit(min(60, seconds) * 1_000_000)) if seconds else F.unix_micros("ts")
    rows = rows.withColumn("minute", minute)
    ends = rows.groupBy("minute").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    firsts = rows.groupBy("minute", "file").agg(F.min(F.struct("ts", "pos")).alias("first"))
    few = firsts.withColumn("rn", F.row_number().over(Window.partitionBy("minute").orderBy("first", "file"))).where(F.col("rn") <= cap)
    files = few.groupBy("minute").agg(F.array_sort(F.collect_list(F.struct("first.ts", "first.pos", "file"))).alias("files"))
    return merged(ends.join(files, "minute").select("start", "end", "files"), seconds, cap)


def sessions(spark: SparkSession, root: str) -> DataFrame:
    return tables.read(spark, root, SCHEMA)


def take(touches: DataFrame, root: str, batch: int, seconds: int = C.SESSION_GAP_SECONDS, cap: int = C.CO_EDIT_FILES) -> None:
    """Merge a batch of touches (ts, pos, file) into the sessions at ``root``; a batch that was taken before changes nothing.

    A kept session is read only if it can be reached: it lies in the days from the first kept session that ends within a gap
    of the batch's first touch to the last that starts within a gap of its last.
    """
    from .staging import staged

    spark = touches.sparkSession
    if batch <= tables.version(spark, root).batch:
        return
    fresh = staged(of_touches(touches, seconds, cap), "sessions")
    span = fresh.agg(F.min("start"), F.max("end")).first()
    day = F.date_format("start", "yyyy-MM-dd")
    if span[0] is None:
        tables.replace(fresh, day, [], root, batch)
        return
    gap = F.expr(f"interval {seconds} seconds")
    kept = sessions(spark, root)
    near = kept.where((F.col("end") + gap >= F.lit(span[0])) & (F.col("start") - gap <= F.lit(span[1])))
    days = [r[0] for r in near.select(day.alias("d")).distinct().collect()]  # days between the ends of a batch
    here = tables.read(spark, root, SCHEMA, buckets=days)
    now = staged(merged(here.unionByName(fresh), seconds, cap), "sessions")
    touched = sorted({*days, *(r[0] for r in now.select(day.alias("d")).distinct().collect())})
    # a session may now start on a day whose other sessions were too far away to be read
    also = tables.read(spark, root, SCHEMA, buckets=[d for d in touched if d not in set(days)])
    tables.replace(now.unionByName(also), day, touched, root, batch)


def pairs(found: DataFrame) -> DataFrame:
    """(from, to, weight): unordered pairs of the files of each session."""
    names = F.transform("files", lambda f: f["file"])
    two = F.flatten(F.transform("names", lambda a, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda b: F.struct(F.least(a, b).alias("from"), F.greatest(a, b).alias("to")))))
    return found.withColumn("names", names).select(F.explode(two).alias("p")).select("p.*").distinct().withColumn("weight", F.lit(C.CO_EDIT_WEIGHT))
