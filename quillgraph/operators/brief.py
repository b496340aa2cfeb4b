"""Brief of a project: recent events of each sort, open work, the last checkpoint, notes drawn from the timeline.

Everything here is a bounded top-n of a distributed table; only the finished text is put together on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import timeline
from .staging import staged
from .stats import count_by

#: How many rows of each sort a brief shows, and how many characters of each text.
LIMITS = {"user": 6, "assistant": 4, "code_edit": 5, "artifact": 3}
TASK_LINES, DECISION_LINES, CONTENT, BRIEF_EVENTS, BRIEF_CHARS, NEW_TASKS, NEW_DECISIONS = 12, 10, 320, 60, 600, 5, 8


def _newest(rows: DataFrame, n: int) -> DataFrame:
    """Last n in timeline order."""
    return rows.orderBy(*[k.desc() for k in timeline.order_keys()]).limit(n)


def recent(rows: DataFrame) -> DataFrame:
    """The last user and assistant messages, edits and artifacts, in time order."""
    parts = [rows.where((F.col("kind") == "message") & (F.col("role") == r)) for r in ("user", "assistant")] + [rows.where(F.col("kind") == k) for k in ("code_edit", "artifact")]
    out = None
    for part, n in zip(parts, LIMITS.values(), strict=True):
        picked = _newest(part, n)
        out = picked if out is None else out.unionByName(picked)
    return out.orderBy(*timeline.order_keys())


def last_checkpoint(rows: DataFrame) -> DataFrame:
    """The last checkpoint, else the last edit: one row at most, by a single aggregate."""
    marks = rows.where(F.col("kind").isin("checkpoint", "code_edit"))
    rank = F.struct((F.col("kind") == "checkpoint").alias("first"), *[k.alias(f"k{i}") for i, k in enumerate(timeline.order_keys())])
    return marks.agg(F.max_by(F.struct(*rows.columns), rank).alias("row")).where("row is not null").select("row.*")


def task_lines(note_rows: DataFrame, n: int = TASK_LINES) -> DataFrame:
    return note_rows.where(F.col("line").startswith("- ")).orderBy("path", "pos").limit(n).select("path", "pos", "line")


def open_decision_lines(note_rows: DataFrame, n: int = DECISION_LINES) -> DataFrame:
    """Bullets under the open heading; documents with none give their unticked boxes instead."""
    bullets = note_rows.where((F.col("indent") == 0) & F.col("line").startswith("- "))
    own = bullets.where(F.col("heading").startswith("open"))
    other = bullets.where(F.col("line").startswith("- [ ]")).join(own.select("path").distinct(), "path", "left_anti")
    return own.unionByName(other.select(own.columns)).orderBy("path", "pos").limit(n).select("path", "pos", "line")


def section_text(note: Column, limit: int) -> Column:
    """A note without its title, cut to ``limit``."""
    return X.truncated(F.regexp_replace(note, r"(?m)\A#.*\n+", ""), limit)


def event_text(limit: int = BRIEF_CHARS) -> Column:
    """One event as a heading line and its text."""
    head = F.concat(F.lit("["), F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("?")), F.lit("] "), F.coalesce("source", F.lit("?")), F.lit(" | "), F.col("kind"), F.coalesce(F.concat(F.lit(" | "), F.nullif("role", F.lit(""))), F.lit("")))
    edit = F.concat_ws(" — ", F.coalesce(F.nullif("file", F.lit("")), F.col("path")), F.coalesce(F.nullif("summary", F.lit("")), F.col("content")))
    body = F.when(F.col("kind").isin("code_edit", "artifact"), edit).otherwise(F.coalesce("content", F.lit("")))
    return F.concat(head, F.lit("\n"), X.truncated(body, limit))


def sample(rows: DataFrame, n: int = BRIEF_EVENTS) -> DataFrame:
    """The last events as texts, oldest first."""
    return _newest(rows, n).orderBy(*timeline.order_keys()).select("pos", event_text().alias("text"))


def is_question(line: Column) -> Column:
    return line.rlike(r"\?\s*$") | line.rlike(r"(?i)(?<![A-Za-z0-9_])(should we|decide|or )")


def drawn_notes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task lines, decision lines) drawn from the last events: first lines of user messages, once each, the newest few."""
    said = _newest(rows, BRIEF_EVENTS).where((F.col("kind") == "message") & (F.col("role") == "user") & (F.length(X.strip(F.col("content"))) >= 8))
    first = said.select(F.substring(F.element_at(F.split(X.strip(F.col("content")), "\n"), 1), 1, 200).alias("line"), "ts", "pos")
    lines = first.groupBy("line").agg(F.min(F.struct(F.coalesce("ts", F.lit("1970-01-01").cast("timestamp")), "pos")).alias("at"))
    boxed = F.concat(F.lit("- [ ] "), "line").alias("line")
    newest = F.col("at").desc()
    return lines.orderBy(newest).limit(NEW_TASKS).orderBy("at").select(boxed), lines.where(is_question(F.col("line"))).orderBy(newest).limit(NEW_DECISIONS).orderBy("at").select(boxed)


def project_figures(rows: DataFrame, agents: DataFrame) -> DataFrame:
    """Events, connected agents and the last time, as one row."""
    connected = agents.agg(F.sum((F.col("status") == "connected").cast("long")).alias("n")).first()["n"] or 0
    return rows.agg(F.count("*").alias("events"), F.max("ts").alias("last"), F.lit(connected).alias("connected_agents"))


def by_source(rows: DataFrame) -> DataFrame:
    return count_by(rows.withColumn("source", F.coalesce("source", F.lit("Unknown"))), "source")


def stale_texts(nodes: DataFrame, cache: DataFrame) -> DataFrame:
    """Nodes whose text has no vector in the cache (id, hash, vector): what an incremental embedding run has to do."""
    return nodes.withColumn("hash", F.sha1(F.coalesce("text", F.lit("")))).join(cache.select("id", "hash"), ["id", "hash"], "left_anti")


def updated_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh vectors in place of old ones of the same id."""
    return cache.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def strided(rows: DataFrame, n: int, key: str) -> DataFrame:
    """About ``n`` rows at equal steps in the order of ``key`` (a sampling operator for benchmarks).

    Range partitions are sorted apart; only their sizes are looked at across partitions.
    """
    placed = staged(rows.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "strided")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # over a row a partition
    begins = placed.groupBy("_part").agg(F.count("*").alias("_size")).select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin"))
    step = max(1, placed.count() // n)
    numbered = placed.join(begins, "_part").withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1 + F.col("_begin"))
    return numbered.where(F.col("_n") % step == 0).orderBy("_n").limit(n).select(rows.columns)
