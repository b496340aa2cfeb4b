"""New log events from a timeline and notes: only what the graph does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import graph, timeline


def new_items(items: DataFrame, nodes: DataFrame, key: str = "nodeId", node_key: str = "id") -> DataFrame:
    """Items whose node doesn't exist (one row per id, the first by ``pos`` if there is one)."""
    return items.dropDuplicates([key]).join(nodes.select(F.col(node_key).alias(key)), key, "left_anti")


def changed_status(items: DataFrame, nodes: DataFrame, key: str = "nodeId", node_key: str = "id") -> DataFrame:
    known = nodes.select(F.col(node_key).alias(key), F.col("status").alias("old_status"))
    return items.join(known, key).where(F.col("status") != F.col("old_status"))


def new_touches(edits: DataFrame, log: DataFrame) -> DataFrame:
    """File touches that the log doesn't have, by source, path and time (nulls are equal); repeats within the batch once."""
    known = log.where("type = 'FileTouched'").select("source", F.coalesce("path", "file").alias("path"), "ts")
    fresh = edits.where("path is not null or file is not null").withColumn("path", F.coalesce("path", "file")).dropDuplicates(["source", "path", "ts"]).alias("n")
    on = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("source", "path", "ts")]
    return fresh.join(known.alias("k"), on, "left_anti")


def new_co_edits(touches: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs edited in the same session that have no CO_EDITED edge in either direction."""
    sessions = timeline.global_sessions(touches.where("ts is not null"))
    pairs = graph.co_edits(sessions.withColumn("file", F.concat(F.lit("file:"), F.col("path"))), "session_no", "file", "pos")
    known = edges.where("relation = 'CO_EDITED'").select(F.least("from", "to").alias("from"), F.greatest("from", "to").alias("to"))
    return pairs.join(known, ["from", "to"], "left_anti")


def decision_events(bullets: DataFrame, nodes: DataFrame, source: str) -> DataFrame:
    """DecisionCreated rows for bullets (text, status, ts) that are new."""
    rows = bullets.withColumn("nodeId", X.stable_id("decision", F.col("text")))
    return new_items(rows, nodes).select("nodeId", "text", "status", "ts", F.lit("DecisionCreated").alias("type"), F.lit(source).alias("source"))


def created(items: DataFrame, nodes: DataFrame, kind: str, source: str, *more: str) -> DataFrame:
    """Rows of event type ``kind`` for items (nodeId, text, more...) whose node doesn't exist, each item once."""
    fresh = items.select("nodeId", "text", *more).distinct().join(nodes.select(F.col("id").alias("nodeId")), "nodeId", "left_anti")
    return fresh.select("nodeId", "text", *more, F.lit(kind).alias("type"), F.lit(source).alias("source"))


def goal_events(goals: DataFrame, nodes: DataFrame, source: str) -> DataFrame:
    return created(goals, nodes, "GoalCreated", source)


def failure_events(failures: DataFrame, nodes: DataFrame, source: str) -> DataFrame:
    return created(failures, nodes, "FailureObserved", source, "selfResolved")


def evidence_events(evidence: DataFrame, nodes: DataFrame, source: str) -> DataFrame:
    """Evidence (parent_id, text) that is new; the same text under two decisions is recorded for both."""
    rows = evidence.select(X.stable_id("evidence", F.col("text")).alias("nodeId"), "text", F.col("parent_id").alias("decisionId"))
    return created(rows, nodes, "EvidenceRecorded", source, "decisionId")


def serves_events(serves: DataFrame, nodes: DataFrame, edges: DataFrame, source: str) -> DataFrame:
    """Links of (parent_id, text) to the goal of that text which the graph lacks (direction counts), and goals that don't exist."""
    rows = serves.select("parent_id", "text", X.stable_id("goal", F.col("text")).alias("nodeId"))
    known = edges.where("relation = 'SERVES'").select(F.col("from").alias("parent_id"), F.col("to").alias("nodeId"))
    links = rows.select("parent_id", "nodeId").distinct().join(known, ["parent_id", "nodeId"], "left_anti")
    links = links.select(F.lit("NodeLinked").alias("type"), F.lit(source).alias("source"), F.col("parent_id").alias("from"), F.col("nodeId").alias("to"), F.lit("SERVES").alias("relation"))
    return goal_events(rows, nodes, source).unionByName(links, allowMissingColumns=True)
