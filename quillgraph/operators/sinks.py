"""Materialising the graph: the folded nodes and edges, the working memory and the statistics report, each overwritten whole.

A rebuild is written beside the old state under a name of its own; readers follow ``current``, a one-row table that is
overwritten last, so a failed rebuild leaves the old state in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fold, stats


def rebuild(nodes: DataFrame, edges: DataFrame, root: str) -> str:
    """Write nodes, edges and the working memory that follows from the nodes; returns the folder of this state."""
    spark, state = nodes.sparkSession, f"{root}/state-{uuid.uuid4().hex}"
    nodes.write.parquet(f"{state}/nodes")
    edges.write.parquet(f"{state}/edges")
    fold.working_memory(spark.read.parquet(f"{state}/nodes")).write.parquet(f"{state}/working_memory")
    spark.createDataFrame([(state,)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{root}/current")
    return state


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table (nodes, edges or working_memory) of the state that was written last."""
    return spark.read.parquet(f"{spark.read.parquet(f'{root}/current').first().state}/{table}")


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, key, n): totals, nodes by type, edges by relation; decisions and failures by outcome. A few dozen rows."""
    total = nodes.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit("nodes").alias("key"), "n")
    total = total.unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit("edges").alias("key"), "n"))
    by_type = stats.count_by(nodes, "type").select(F.lit("nodes").alias("section"), F.col("type").alias("key"), "n")
    by_relation = stats.count_by(edges, "relation").select(F.lit("edges").alias("section"), F.col("relation").alias("key"), "n")
    status = nodes.where("type in ('Decision', 'Failure')").groupBy("type", "status").agg(F.count("*").alias("n")).select(F.lower("type").alias("section"), F.col("status").alias("key"), "n")
    return total.unionByName(by_type).unionByName(by_relation).unionByName(status)


def report_text(rows: DataFrame) -> DataFrame:
    """The report as one text."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("section", "key", "n"))), lambda x: F.concat(x["section"], F.lit("."), F.coalesce(x["key"], F.lit("unknown")), F.lit(": "), x["n"].cast("string")))
    return rows.agg(F.array_join(lines, "\n").alias("text"))
