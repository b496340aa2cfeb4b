"""Lines of text files with their exact numbers, however large the files are.

Spark cuts a large file into ranges of bytes, a task each, and gives whole lines; what it doesn't give is a line's number.
Two passes do: the lines of each range are counted, the counts of a file's ranges are added up in the order of their
offsets, and a line's number is that sum and its place in its range. Only a row a range crosses tasks; a log of many
gigabytes is read by as many tasks as it has ranges, and its order is a column like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, pos, value, modified) of all lines of the files below ``path``, blank ones left out; ``pos`` counts from 0 in each file.

    Files must not change between the two passes, which a log that is only appended to in new files doesn't.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    rows = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=glob)
    # within a range this number rises by one a line; the scan is cut alike in both passes
    placed = rows.select(meta("file_path").alias("path"), meta("file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_n"), "value", meta("file_modification_time").alias("modified"))
    ranges = placed.groupBy("path", "_range").agg(F.min("_n").alias("_first"), F.count("*").alias("_lines"))
    before = Window.partitionBy("path").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("path", "_range", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(ranges, ["path", "_range"]).select("path", (F.col("_n") + F.col("_shift")).alias("pos"), "value", "modified").where("trim(value) <> ''")
