"""Event log to property graph: the state of each node from its events in order, and edges from single events.

Events are ordered by (time, position in the log), so the result doesn't depend on how the log was partitioned. The fold is
associative (see ``pieces``): most fields are last or first writers, confidence is a chain of capped maps, and only accesses
and outcomes have to know when their node came to be. Tasks combine what they have before it is shuffled, and a node with
half of all events is spread over tasks like any other; no row holds a node's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import constants as C
from . import pieces
from .staging import staged

CREATES = {"FileTouched": "File", "TaskCreated": "Task", "GoalCreated": "Goal", "DecisionCreated": "Decision", "EvidenceRecorded": "Evidence", "FailureObserved": "Failure"}
CHANGES = ("TaskStatusChanged", "DecisionResolved", "DecisionSuperseded", "DecisionContradicted", "DecisionOutcomeObserved", "NodeAccessed")
#: Parts into which the events of a node are dealt where they are held against its birth.
SALTS = 16


def first_confidence() -> Column:
    return F.coalesce(
        F.col("confidence"),
        F.when(F.coalesce("source", F.lit("")).isin("human", "user"), F.lit(C.CONFIDENCE_HUMAN)).when(X.committed(F.col("text")), F.lit(C.CONFIDENCE_COMMITTED)).otherwise(F.lit(C.CONFIDENCE_DEFAULT)),
    )


def node_of() -> Column:
    """The node that an event of a log is about."""
    return F.when(F.col("type") == "FileTouched", F.concat(F.lit("file:"), F.coalesce("path", "file"))).otherwise(F.col("nodeId"))


def keyed(log: DataFrame) -> DataFrame:
    """Events that can change a node, with ``node`` and ``at`` (the epoch for those without a time)."""
    rows = log.withColumn("node", node_of())
    return rows.where(F.col("node").isNotNull() & F.col("type").isin(*CREATES, *CHANGES)).withColumn("at", F.coalesce("ts", F.lit(pieces.EPOCH).cast("timestamp")))


def _written_status() -> Column:
    """The status that an event writes; null where it leaves the status as it is."""
    kind, failed = F.col("type"), F.coalesce("selfResolved", F.lit(False)) | (F.size(F.coalesce("fixedBy", F.array().cast("array<string>"))) > 0)
    return (
        F.when(kind.isin("FileTouched", "EvidenceRecorded"), F.lit("active"))
        .when(kind == "TaskCreated", F.coalesce("status", F.lit("open")))
        .when(kind == "DecisionCreated", F.coalesce("status", F.lit("active")))
        .when(kind == "FailureObserved", F.when(failed, F.lit("resolved")).otherwise(F.lit("open")))
        .when(kind == "TaskStatusChanged", F.col("status"))
        .when(kind == "DecisionResolved", F.lit("resolved"))
        .when(kind == "DecisionContradicted", F.lit("contradicted"))
        .when((kind == "DecisionSuperseded") | ((kind == "DecisionOutcomeObserved") & (F.col("outcome") == "reverted")), F.lit("superseded"))
    )


def _registers() -> list[pieces.Register]:
    """What events write, whether their node existed or not: its birth is an event that writes each of these as well, so a
    last writer before it can only be the last of a node that was never born after it (see ``nodes`` for the status)."""
    kind = F.col("type")
    creates = kind.isin(*CREATES)
    new_type = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in CREATES.items()])
    text = F.nullif(F.coalesce("text", "path", "file"), F.lit(""))
    return [
        pieces.first("born", new_type, creates),
        pieces.last("text", text, creates & text.isNotNull()),
        pieces.last("status", _written_status(), _written_status().isNotNull()),
        pieces.last("verified", F.col("ts"), kind != "NodeAccessed"),
        pieces.first("author", F.col("source"), creates),
        pieces.first("branch", F.col("branch"), kind.isin("TaskCreated", "GoalCreated", "DecisionCreated") & F.col("branch").isNotNull()),
        pieces.last("kind", F.coalesce("kind", F.lit("link")), kind == "EvidenceRecorded"),
    ]


def _since_birth(events: DataFrame, born: DataFrame) -> DataFrame:
    """Events of nodes (node, birth) that come after their birth. Both sides are dealt by a salt besides the node."""
    salted = events.withColumn("_salt", F.pmod(F.xxhash64("pos"), F.lit(SALTS)))
    spread = born.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, ["node", "_salt"]).where(F.struct(F.col("at"), F.col("pos")) >= F.struct(F.col("birth.at"), F.col("birth.pos"))).drop("_salt", "birth")


def nodes(log: DataFrame, listed: bool = True) -> DataFrame:
    """Nodes of a log (EVENT_DDL and ``pos``, the position in it). Unknown event types change nothing.

    With ``listed`` each node has the ids of its events in order as ``source_ids``; without it the ids stay in their own table
    (``sources``), which suits nodes with very many events.
    """
    events, kind = keyed(log), F.col("type")
    writes = events.select("node", "at", "pos", "ts", "source", "type", "text", "path", "file", "status", "outcome", "kind", "branch", "fixedBy", "selfResolved")
    found = staged(pieces.fold(writes, "node", "at", "pos", _registers()).where("born is not null"), "nodes")
    birth = F.struct(F.col("born.at._at").alias("at"), F.col("born.at._pos").alias("pos"))
    demoted = kind.isin("DecisionSuperseded", "DecisionContradicted") | ((kind == "DecisionOutcomeObserved") & (F.col("outcome") == "reverted"))
    step = F.when(kind == "DecisionCreated", pieces.set_to(first_confidence())).when(demoted, pieces.mapped(C.DEMOTION)).when((kind == "DecisionOutcomeObserved") & (F.col("outcome") == "confirmed"), pieces.mapped(1.0, C.CONFIRMATION, 1.0))
    acts = events.withColumn("step", step).where("step is not null or type = 'NodeAccessed'").select("node", "at", "pos", "type", "step")
    acts = _since_birth(acts, found.select("node", birth.alias("birth")))
    changed = pieces.fold(acts, "node", "at", "pos", [pieces.count("access_count", kind == "NodeAccessed")], F.col("step"))
    decay = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in C.DECAY.items() for v in p]), F.col("born.value")), F.lit(C.DECAY_OTHER))
    written = F.when(F.col("status.at") >= F.col("born.at"), F.col("status.value"))  # nothing has written since the birth: a goal
    accesses = F.coalesce("access_count", F.lit(0)).cast("long")
    out = found.join(changed, "node", "left").select(
        F.col("node").alias("id"), F.col("born.value").alias("type"), F.coalesce("text.value", F.lit("")).alias("text"), F.coalesce(written, F.lit("open")).alias("status"),
        F.coalesce(pieces.applied(F.col("step"), C.CONFIDENCE_DEFAULT), F.lit(C.CONFIDENCE_DEFAULT)).alias("confidence"), X.round3(1.0 + C.IMPORTANCE_STEP * accesses).alias("importance"),
        accesses.alias("access_count"), F.col("verified.value").alias("last_verified"), F.col("author.value").alias("author"), F.col("branch.value").alias("branch"), F.col("kind.value").alias("kind"), decay.alias("decay_rate"),
        birth["at"].alias("born_at"), birth["pos"].alias("born_pos"),
    )
    if not listed:
        return out
    own = _since_birth(events.select("node", "at", "pos", "id"), found.select("node", birth.alias("birth")))
    ids = own.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "pos", "id"))), lambda x: x["id"]).alias("source_ids"))
    return out.join(ids.withColumnRenamed("node", "id"), "id", "left")


def sources(log: DataFrame) -> DataFrame:
    """(node, event_id, at, pos): the events that made each node what it is, a row each."""
    events = keyed(log)
    born = events.where(F.col("type").isin(*CREATES)).groupBy("node").agg(F.min(F.struct("at", "pos")).alias("birth"))
    return _since_birth(events.select("node", F.col("id").alias("event_id"), "at", "pos"), born)


def edges(log: DataFrame) -> DataFrame:
    """Edges that single events make; an outcome's evidence counts only if its decision existed before."""
    e = lambda a, b, rel, w=None: F.struct(a.alias("from"), b.alias("to"), F.lit(rel).alias("relation") if isinstance(rel, str) else rel.alias("relation"), (F.lit(1.0) if w is None else w).alias("weight"))
    c, kind = F.col, F.col("type")
    none = F.array().cast("array<struct<`from`:string,`to`:string,relation:string,weight:double>>")
    made = (
        F.when((kind == "DecisionCreated") & c("goalId").isNotNull(), F.array(e(c("nodeId"), c("goalId"), "SERVES")))
        .when((kind == "DecisionSuperseded") & c("supersededBy").isNotNull(), F.array(e(c("supersededBy"), c("nodeId"), "SUPERSEDES")))
        .when((kind == "DecisionContradicted") & c("otherId").isNotNull(), F.array(e(c("otherId"), c("nodeId"), "CONTRADICTS")))
        .when((kind == "DecisionOutcomeObserved") & c("evidenceId").isNotNull(), F.array(e(c("nodeId"), c("evidenceId"), "SUPPORTED_BY")))
        .when((kind == "EvidenceRecorded") & c("decisionId").isNotNull(), F.array(e(c("decisionId"), c("nodeId"), "SUPPORTED_BY")))
        .when(kind == "NodeLinked", F.array(e(c("from"), c("to"), c("relation"), F.coalesce("weight", F.lit(1.0)))))
        .when(kind == "FailureObserved", F.concat(F.transform(F.coalesce("causedBy", F.array().cast("array<string>")), lambda x: e(c("nodeId"), x, "CAUSED_BY")), F.transform(F.coalesce("fixedBy", F.array().cast("array<string>")), lambda x: e(c("nodeId"), x, "FIXED_BY"))))
        .otherwise(none)
    )
    at = F.coalesce("ts", F.lit("1970-01-01").cast("timestamp"))
    born = log.where("type = 'DecisionCreated'").groupBy("nodeId").agg(F.min(F.struct(at.alias("at"), F.col("pos").alias("pos"))).alias("born"))
    rows = log.withColumn("made", made).where(F.size("made") > 0).join(born, "nodeId", "left")
    rows = rows.where((kind != "DecisionOutcomeObserved") | F.coalesce(F.col("born") < F.struct(at.alias("at"), F.col("pos").alias("pos")), F.lit(False)))
    return rows.select(F.explode("made").alias("e"), F.col("ts").alias("valid_from"), "pos").select("e.*", "valid_from", F.lit(None).cast("timestamp").alias("valid_to"), "pos")


def as_of(log: DataFrame, moment) -> DataFrame:
    """The log as it stood at a moment (rows without a time count as the beginning)."""
    return log.where(F.col("ts").isNull() | (F.col("ts") <= F.lit(moment)))


def working_memory(node_rows: DataFrame) -> DataFrame:
    """Nodes that matter now, with their bucket."""
    kind, status = F.col("type"), F.col("status")
    bucket = (
        F.when((kind == "Goal") & (status == "open"), "goals")
        .when((kind == "Task") & status.isin("open", "active"), "tasks")
        .when((kind == "Decision") & status.isin("active", "open"), "decisions")
        .when((kind == "Failure") & (status != "resolved"), "blockers")
    )
    return node_rows.withColumn("bucket", bucket).where("bucket is not null")
