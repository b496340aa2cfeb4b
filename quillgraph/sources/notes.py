"""Bullet-list notes and logs: markdown sections, nested bullets, event logs, version-control logs, file discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.constants import EVENT_DDL
from .lines import numbered


def note_lines(docs: DataFrame) -> DataFrame:
    """(path, pos, raw, line, indent, heading, parent) of notes (path, value).

    ``heading`` is the last ``##`` line so far, ``parent`` the text of the last bullet without indent under it. Both are
    carried along by windows over one document.
    """
    rows = docs.select("path", F.posexplode(F.split(F.coalesce("value", F.lit("")), "\n")).alias("pos", "raw"))
    rows = rows.withColumn("line", X.strip(F.col("raw"))).where("line <> ''").withColumn("indent", F.length(F.regexp_extract("raw", r"^(\s*)", 1)))
    so_far = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(r"^##\s"), F.lower(X.strip(F.regexp_replace("line", r"^##", ""))))
    rows = rows.withColumn("heading", F.last(head, ignorenulls=True).over(so_far)).withColumn("part", F.sum(head.isNotNull().cast("int")).over(so_far))
    bullet = F.nullif(X.without_checkbox(F.regexp_extract("line", r"^- (.+)$", 1)), F.lit(""))
    own = F.when((F.col("indent") == 0) & head.isNull(), F.struct(bullet.alias("text")))
    return rows.withColumn("parent", F.last(own, ignorenulls=True).over(W.partitionBy("path", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))["text"])


def _section(lines: DataFrame, name: str, strict: bool) -> DataFrame:
    """Lines under the first heading that begins with ``name``; indented sub-bullets only if ``strict``."""
    mine = lines.where(F.col("heading").startswith(name))
    first = mine.groupBy("path").agg(F.min("part").alias("part"))
    mine = mine.join(first, ["path", "part"])
    return mine if strict else mine.where("indent = 0")


def tasks(lines: DataFrame) -> DataFrame:
    box = F.regexp_extract("line", r"^- \[([ xX])\]\s*(.+)$", 1)
    text = X.strip(F.regexp_extract("line", r"^- \[([ xX])\]\s*(.+)$", 2))
    return lines.where(F.col("line").rlike(r"^- \[([ xX])\]\s*(.+)$")).select("path", "pos", text.alias("text"), F.when(F.lower(box) == "x", "done").otherwise("open").alias("status")).where("text <> ''").withColumn("nodeId", X.stable_id("task", F.col("text")))


def _bullets(lines: DataFrame, prefix: str, checkbox: bool = True) -> DataFrame:
    text = F.regexp_extract("line", r"^- (.+)$", 1)
    text = X.without_checkbox(text) if checkbox else X.strip(text)
    return lines.where(F.col("line").rlike(r"^- (.+)$")).select("path", "pos", text.alias("text")).where("text <> ''").withColumn("nodeId", X.stable_id(prefix, F.col("text")))


def open_decisions(lines: DataFrame, strict: bool = False) -> DataFrame:
    return _bullets(_section(lines, "open", strict), "decision")


def resolved_decisions(lines: DataFrame, strict: bool = False) -> DataFrame:
    """A date before the text is its time."""
    return _bullets(_section(lines, "resolved", strict), "decision").withColumn("ts", F.try_to_timestamp(F.nullif(F.regexp_extract("text", r"^(\d{4}-\d{2}-\d{2})\s*[—-]\s*", 1), F.lit(""))))


def goals(lines: DataFrame, strict: bool = False) -> DataFrame:
    return _bullets(_section(lines, "goals", strict), "goal", checkbox=False)


def failures(lines: DataFrame) -> DataFrame:
    return _bullets(lines, "failure", checkbox=False).withColumn("selfResolved", X.self_resolved(F.col("text")))


def attached(lines: DataFrame, word: str, prefix: str) -> DataFrame:
    """(parent_id, text) of indented ``word: text`` lines, tied to the bullet above them."""
    text = F.regexp_extract(F.regexp_replace("line", "^- ", ""), rf"(?i)^{word}:\s*(.+)$", 1)
    return lines.where("indent > 0 and parent is not null").select("path", "pos", X.stable_id(prefix, F.col("parent")).alias("parent_id"), X.strip(text).alias("text")).where("text <> ''")


def evidence(lines: DataFrame) -> DataFrame:
    return attached(lines, "evidence", "decision")


def serves(lines: DataFrame, prefix: str = "decision") -> DataFrame:
    return attached(lines, "serves", prefix)


def event_log(lines: DataFrame) -> DataFrame:
    """Log rows of (pos, value) lines of JSON, in their order; blank and corrupt lines are left out."""
    return lines.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", EVENT_DDL).alias("e"), "pos").select("e.*", "pos")


def read_log(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """The log in all files below ``root``: ``pos`` is the line's place in its file, files in the order of their names."""
    lines = numbered(spark, root, glob)
    sizes = lines.groupBy("path").agg((F.max("pos") + 1).alias("n"))
    begin = sizes.withColumn("begin", F.coalesce(F.sum("n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a file
    return event_log(lines.join(begin.select("path", "begin"), "path").withColumn("pos", F.col("pos") + F.col("begin")))


def completed(events: DataFrame, now: Column, source: str = "quillgraph") -> DataFrame:
    """Log rows with what every row must have: an id, a source where none is given, and a time where the column isn't given.

    A time that is given as null stays null. An id follows from what the row says and its place in the batch, so equal rows
    differ and a batch that is made again in the same way has the same ids; rows stay where they are.
    """
    have = set(events.columns)
    rows = events if "ts" in have else events.withColumn("ts", now)
    rows = rows.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit(source)) if "source" in have else F.lit(source))
    said = F.to_json(F.struct(*[c for c in rows.columns if c != "id"], F.monotonically_increasing_id().alias("_place")))
    made = F.concat(F.lit("evt_"), F.substring(F.sha1(said), 1, 20))
    return rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), made) if "id" in have else made)


def append_events(events: DataFrame, path: str, now: Column | None = None) -> None:
    """Append log rows as lines of JSON; with ``now`` they are completed before."""
    (events if now is None else completed(events, now)).write.mode("append").json(path)


def commits(lines: DataFrame) -> DataFrame:
    """(hash, ts, subject, files) of a log whose commits begin ``hash|seconds|subject`` and then name files, one a line."""
    head = r"^([0-9a-f]{7,40})\|(\d+)\|(.*)$"
    is_head = F.col("value").rlike(head)
    rows = lines.withColumn("n", F.sum(is_head.cast("int")).over(W.partitionBy("path").orderBy("pos")))
    field = lambda i: F.max(F.when(is_head, F.regexp_extract("value", head, i)))
    files = F.transform(F.array_sort(F.collect_list(F.when(~is_head & (X.strip(F.col("value")) != ""), F.struct("pos", "value")))), lambda x: x["value"])
    return rows.where("n > 0").groupBy("path", "n").agg(field(1).alias("hash"), F.timestamp_seconds(field(2).cast("bigint")).alias("ts"), field(3).alias("subject"), files.alias("files")).drop("path", "n")


def listed(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, modified, length) of the files below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", F.col("modificationTime").alias("modified"), "length")


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def slug(path: Column) -> Column:
    return F.regexp_replace(path, "[^a-zA-Z0-9]", "-")


def under(path: Column, workspace: str) -> Column:
    w = workspace.rstrip("/")
    return (path == w) | path.startswith(w + "/")


def snapshots(history: DataFrame) -> DataFrame:
    """Editor history (dir, id, ts, path, content): each snapshot's diff to the one before it in its folder."""
    before = F.lag("content").over(W.partitionBy("dir").orderBy("ts", "id"))
    return history.withColumn("diff", X.whole_diff(F.coalesce(before, F.lit("")), F.col("content"), X.base_name(F.col("path")))).withColumn("kind", F.lit("code_edit"))


def history_edits(files: DataFrame, workspace: str, source: str) -> DataFrame:
    """Edits told by an editor's history: folders of snapshots (path, value), each with an ``entries.json`` that names the file and
    the snapshots' times. Files outside the workspace, and folders whose entries can't be read, are left out.

    A snapshot's diff is to the one before it, if both are there and differ. Entries without a time give no row.
    """
    folder = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    told = files.where(F.col("path").endswith("/entries.json") & F.try_parse_json("value").isNotNull())
    meta = told.select(folder(F.col("path")).alias("dir"), F.from_json("value", "resource string, entries array<struct<id:string,timestamp:bigint,source:string>>").alias("m"))
    own = F.try_url_decode(F.regexp_replace(F.regexp_replace("m.resource", "^file://", ""), r"\+", "%2B"))
    meta = meta.withColumn("file_path", own).where(under(F.col("file_path"), workspace))
    placed = F.transform("m.entries", lambda e, i: F.struct(F.coalesce(e["timestamp"], F.lit(0)).alias("at"), i.alias("i"), e["id"].alias("id"), e["source"].alias("said")))
    rows = meta.select("dir", "file_path", F.posexplode(F.array_sort(placed)).alias("n", "e")).select("dir", "file_path", "n", "e.at", "e.id", "e.said")
    rows = rows.withColumn("old_id", F.lag("id").over(W.partitionBy("dir").orderBy("n")))
    held = files.where(~F.col("path").endswith("/entries.json")).select(folder(F.col("path")).alias("dir"), X.base_name(F.col("path")).alias("id"), F.col("value").alias("content"))
    rows = rows.join(held, ["dir", "id"], "left").join(held.select("dir", F.col("id").alias("old_id"), F.col("content").alias("old")), ["dir", "old_id"], "left")
    diff = F.when(F.col("old").isNotNull() & F.col("content").isNotNull() & (F.col("old") != F.col("content")), X.whole_diff(F.col("old"), F.col("content"), X.base_name(F.col("file_path"))))
    return rows.where("at > 0").select(
        F.timestamp_millis("at").alias("ts"), F.lit("code_edit").alias("kind"), F.lit("assistant").alias("role"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("content"),
        X.base_name(F.col("file_path")).alias("file"), F.col("file_path").alias("path"), F.lit("localHistory").alias("action"), F.coalesce(F.nullif("said", F.lit("")), F.lit("Local History snapshot")).alias("summary"), diff.alias("diff"),
        F.create_map(F.lit("editSource"), F.lit("localHistory"), F.lit("historyId"), F.col("id")).alias("extras"),
    )


def session_of(lines: DataFrame, workspace: str, token: str | None = None) -> DataFrame:
    """(path): the newest transcript (path, pos, value, modified) that belongs to a workspace, else the newest of all.

    One belongs to it if the working directory of its first line is the workspace or below it, if its path holds the
    workspace's slug, or if any line holds ``token``. One aggregate a file and one row of them all; no lines, no row.
    """
    cwd = F.get_json_object(F.min_by("value", "pos"), "$.cwd")
    named = slug(F.lit(workspace.rstrip("/")))
    held = F.bool_or(F.col("value").contains(token)) if token else F.lit(False)
    files = lines.groupBy("path").agg(F.max("modified").alias("modified"), F.coalesce(under(cwd, workspace), F.lit(False)).alias("inside"), F.coalesce(held, F.lit(False)).alias("held"))
    mine = F.col("inside") | F.col("path").contains(named) | F.col("held")
    return files.agg(F.max_by("path", F.struct(mine.alias("mine"), "modified", "path")).alias("path")).where("path is not null")
