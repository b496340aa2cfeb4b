"""The graph as intervals: what every node and edge was, from when to when, made from the log once.

A row holds from ``valid_from`` (included) to ``valid_to`` (excluded; null: still). The graph of any moment is a filter over
it, so questions about the past need no new fold. A node has an interval for each time at which one of its events changed
it; its state there is the fold of its events up to then. An edge holds from its event on; one that says that a node
supersedes, contradicts or serves ends when the same two are linked again.

Events without a time count as the beginning, as in the fold. Events of one time make one interval. A node's events are
numbered and folded within its own rows, so this suits nodes whose histories fit a task; ``fold.nodes`` has no such bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import constants as C
from . import fold, pieces


def node_versions(log: DataFrame) -> DataFrame:
    """id, type, text, status, confidence, importance, access_count, last_verified, author, branch, kind, decay_rate, valid_from, valid_to."""
    kind = F.col("type")
    events = fold.keyed(log).withColumn("creates", kind.isin(*fold.CREATES))
    order = Window.partitionBy("node").orderBy("at", "pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = events.withColumn("known", F.max(F.col("creates").cast("int")).over(upto) == 1).where("known")
    demoted = kind.isin("DecisionSuperseded", "DecisionContradicted") | ((kind == "DecisionOutcomeObserved") & (F.col("outcome") == "reverted"))
    step = F.when(kind == "DecisionCreated", pieces.set_to(fold.first_confidence())).when(demoted, pieces.mapped(C.DEMOTION)).when((kind == "DecisionOutcomeObserved") & (F.col("outcome") == "confirmed"), pieces.mapped(1.0, C.CONFIRMATION, 1.0))
    new_type = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in fold.CREATES.items()])
    text = F.when(F.col("creates"), F.nullif(F.coalesce("text", "path", "file"), F.lit("")))
    branch = F.when(kind.isin("TaskCreated", "GoalCreated", "DecisionCreated"), F.col("branch"))
    last = lambda c: F.last(c, True).over(upto)
    first = lambda c: F.first(c, True).over(upto)
    verifies = F.when(kind != "NodeAccessed", F.struct("ts"))
    steps = F.collect_list(step).over(upto)
    accesses = F.sum((kind == "NodeAccessed").cast("long")).over(upto)
    decay = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in C.DECAY.items() for v in p]), F.col("type_")), F.lit(C.DECAY_OTHER))
    states = known.select(
        F.col("node").alias("id"), "at", "pos", first(new_type).alias("type_"), F.coalesce(last(text), F.lit("")).alias("text_"), F.coalesce(last(fold._written_status()), F.lit("open")).alias("status_"),
        pieces.applied(F.aggregate(steps, pieces.mapped(), lambda s, x: pieces.composed(s, x)), C.CONFIDENCE_DEFAULT).alias("confidence_"), X.round3(1.0 + C.IMPORTANCE_STEP * accesses).alias("importance"),
        accesses.alias("access_count"), last(verifies)["ts"].alias("last_verified"), F.first("source").over(upto).alias("author"), first(branch).alias("branch_"),
        last(F.when(kind == "EvidenceRecorded", F.coalesce("kind", F.lit("link")))).alias("kind_"),
    )
    ends = states.withColumn("valid_to", F.lead("at").over(Window.partitionBy("id").orderBy("at", "pos"))).where("valid_to is null or valid_to > at")
    return ends.select(
        "id", F.col("type_").alias("type"), F.col("text_").alias("text"), F.col("status_").alias("status"), F.col("confidence_").alias("confidence"), "importance", "access_count", "last_verified", "author",
        F.col("branch_").alias("branch"), F.col("kind_").alias("kind"), decay.alias("decay_rate"), F.col("at").alias("valid_from"), "valid_to",
    )


def edge_versions(log: DataFrame) -> DataFrame:
    """The edges of ``fold.edges``, each until the same two nodes are linked by the same relation again."""
    rows = fold.edges(log).withColumn("_at", F.coalesce("valid_from", F.lit(pieces.EPOCH).cast("timestamp")))
    again = F.lead("_at").over(Window.partitionBy("from", "to", "relation").orderBy("_at", "pos"))
    return rows.withColumn("valid_to", again).withColumn("valid_from", F.col("_at")).drop("_at").where("valid_to is null or valid_to > valid_from")


def at_moment(versions: DataFrame, moment: Column) -> DataFrame:
    """The rows of a table of intervals that hold at a moment."""
    return versions.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def retrieve_as_of(node_rows: DataFrame, edge_rows: DataFrame, query: str, moment: Column, **more) -> DataFrame:
    """The retriever over the graph as it was at a moment, its time being that moment."""
    from . import retrieve

    edges = at_moment(edge_rows, moment).withColumn("valid_to", F.lit(None).cast("timestamp"))
    return retrieve.retrieve(at_moment(node_rows, moment).drop("valid_from", "valid_to"), edges, query, moment, **more)
