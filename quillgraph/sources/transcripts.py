"""Readers of agent transcripts: one JSON object a line, five vendors' shapes, to the common timeline columns.

All are projections of ``from_json`` with explicit schemas; lines that aren't JSON are left out. ``lines`` is a table
(path, pos, value): text files give it by ``read_lines``, tests by literal rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.staging import staged
from ..plans.constants import TIMELINE_DDL
from .lines import numbered
from .notes import history_edits

#: Tools that edit files, by vendor, and the names that the vendors' events carry.
CLAUDE_TOOLS = ("Edit", "Write", "MultiEdit")
CODEX_TOOLS = ("apply_patch", "write", "edit_file", "create_file", "patch_file")
CURSOR_TOOLS = ("Write", "StrReplace", "Edit", "MultiEdit", "Delete", "ApplyPatch")
SOURCES = {"claude": "Claude Code", "codex": "Codex", "cursor": "Cursor", "antigravity": "Antigravity", "copilot": "GitHub Copilot"}
_COLUMNS = [x.split()[0] for x in TIMELINE_DDL.split(", ")]


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, pos, value, modified) of all files below ``path``; ``pos`` is the line's number in its file."""
    return numbered(spark, path, glob)


def _ts(c: Column) -> Column:
    return F.try_to_timestamp(c)


def _timeline(df: DataFrame, **columns) -> DataFrame:
    """The timeline columns, null where not given, besides path-in-store and position."""
    types = dict(x.split(None, 1) for x in TIMELINE_DDL.split(", "))
    out = [columns.get(c, F.lit(None)).cast(types[c]).alias(c) for c in _COLUMNS]
    return df.select(*out, F.col("_file"), F.col("_pos"))


def _rows(lines: DataFrame, schema: str) -> DataFrame:
    return lines.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("s"), F.col("path").alias("_file"), F.col("pos").alias("_pos"), *[c for c in lines.columns if c == "modified"])


def _text_of(content: Column) -> Column:
    """The text parts of a message: a string, or an array of parts of which those of type text count, joined by spaces."""
    part = "array<struct<type:string,text:string>>"
    parts = F.from_json(content, part)
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), " ")
    return F.when(X.strip(content).startswith("["), joined).otherwise(content)


def claude(lines: DataFrame) -> DataFrame:
    rows = _rows(lines, "type string, timestamp string, message struct<role:string,content:string>")
    source, ts = F.lit(SOURCES["claude"]), _ts(F.col("s.timestamp"))
    spoken = rows.where(F.col("s.type").isin("user", "assistant") & (F.col("s.message.role") == F.col("s.type")))
    text = _text_of(F.col("s.message.content"))
    said = spoken.withColumn("text", F.when(F.col("s.type") == "assistant", X.strip(text)).otherwise(text)).where(X.strip(F.col("text")) != "")
    messages = _timeline(said, ts=ts, kind=F.lit("message"), role=F.col("s.type"), content=F.col("text"), source=source)
    tool = "array<struct<type:string,name:string,id:string,input:struct<file_path:string,path:string,old_string:string,new_string:string,contents:string>>>"
    tools = spoken.where("s.type = 'assistant'").withColumn("t", F.explode(F.from_json("s.message.content", tool))).where((F.col("t.type") == "tool_use") & F.col("t.name").isin(*CLAUDE_TOOLS))
    path = F.coalesce(F.nullif("t.input.file_path", F.lit("")), F.nullif("t.input.path", F.lit("")))
    tools = tools.withColumn("p", path).where("p is not null").withColumn("f", X.base_name(F.col("p")))
    edit = (F.col("t.name") == "Edit") & F.col("t.input.old_string").isNotNull() & F.col("t.input.new_string").isNotNull()
    write = (F.col("t.name") == "Write") & F.col("t.input.contents").isNotNull()
    diff = F.when(edit, X.whole_diff(F.col("t.input.old_string"), F.col("t.input.new_string"), F.col("f"))).when(write, X.whole_diff(F.lit(""), F.col("t.input.contents"), F.col("f")))
    summary = F.when(edit, F.concat(F.lit("Edited "), "f")).when(write, F.concat(F.lit("Wrote "), "f")).otherwise(F.concat("t.name", F.lit(" "), "f"))
    extras = F.create_map(F.lit("toolUseId"), F.col("t.id"))
    return messages.unionByName(_timeline(tools, ts=ts, kind=F.lit("code_edit"), role=F.lit("assistant"), source=source, file=F.col("f"), path=F.col("p"), action=F.lower("t.name"), summary=summary, diff=diff, extras=extras))


def codex(lines: DataFrame) -> DataFrame:
    rows = _rows(lines, "type string, timestamp string, payload struct<type:string,message:string,name:string,arguments:string,call_id:string>")
    source, ts = F.lit(SOURCES["codex"]), _ts(F.col("s.timestamp"))
    said = rows.where((F.col("s.type") == "event_msg") & F.col("s.payload.type").isin("user_message", "agent_message"))
    role = F.when(F.col("s.payload.type") == "user_message", F.lit("user")).otherwise(F.lit("assistant"))
    messages = _timeline(said, ts=ts, kind=F.lit("message"), role=role, content=F.coalesce("s.payload.message", F.lit("")), source=source)
    calls = rows.where((F.col("s.type") == "response_item") & (F.col("s.payload.type") == "function_call") & F.col("s.payload.name").isin(*CODEX_TOOLS))
    calls = calls.withColumn("a", F.from_json(F.coalesce("s.payload.arguments", F.lit("{}")), "path string, file_path string, file string, patch string, input string"))
    patched = F.nullif(X.strip(F.regexp_extract(F.coalesce(F.nullif("a.patch", F.lit("")), F.col("a.input"), F.lit("")), r"(?m)^\*\*\* (?:Update|Add|Delete) File:\s*(.+)$", 1)), F.lit(""))
    path = F.coalesce(*[F.nullif(f"a.{k}", F.lit("")) for k in ("path", "file_path", "file")], patched)
    calls = calls.withColumn("p", path).withColumn("f", X.base_name(F.col("p")))
    summary = F.concat(F.col("s.payload.name"), F.coalesce(F.concat(F.lit(": "), "f"), F.lit("")))
    edits = _timeline(calls, ts=ts, kind=F.lit("code_edit"), role=F.lit("assistant"), source=source, file=F.col("f"), path=F.col("p"), action=F.col("s.payload.name"), summary=summary, diff=F.col("a.patch"), extras=F.create_map(F.lit("callId"), F.col("s.payload.call_id")))
    return messages.unionByName(edits)


def cursor(lines: DataFrame) -> DataFrame:
    """Lines have no time: it is the file's time of change plus a second a line."""
    rows = _rows(lines, "role string, message struct<content:string>")
    source, ts = F.lit(SOURCES["cursor"]), F.timestamp_millis(F.unix_millis("modified") + F.col("_pos") * 1000)
    text = X.strip(_text_of(F.col("s.message.content")))
    inner = F.regexp_extract(text, r"(?s)<user_query>\s*(.*?)\s*</user_query>", 1)
    text = F.when((F.col("s.role") == "user") & (inner != ""), inner).otherwise(text)
    said = rows.where(F.col("s.role").isin("user", "assistant")).withColumn("text", text).where((F.col("text") != "") & ~X.redacted(F.col("text")))
    messages = _timeline(said, ts=ts, kind=F.lit("message"), role=F.col("s.role"), content=F.col("text"), source=source, extras=F.create_map(F.lit("lineIndex"), F.col("_pos").cast("string")))
    tool = "array<struct<type:string,name:string,input:struct<path:string,file_path:string>>>"
    tools = rows.where("s.role = 'assistant'").withColumn("t", F.explode(F.from_json("s.message.content", tool))).where((F.col("t.type") == "tool_use") & F.col("t.name").isin(*CURSOR_TOOLS))
    tools = tools.withColumn("p", F.coalesce("t.input.path", "t.input.file_path")).where("p is not null").withColumn("f", X.base_name(F.col("p")))
    return messages.unionByName(_timeline(tools, ts=ts, kind=F.lit("code_edit"), role=F.lit("assistant"), source=source, file=F.col("f"), path=F.col("p"), action=F.lower("t.name"), summary=F.concat("t.name", F.lit(" "), "f")))


def cursor_with_history(lines: DataFrame, files: DataFrame, workspace: str) -> DataFrame:
    """The transcripts, and the edits that the editor's own history of the workspace tells (``files``: path, value)."""
    return cursor(lines).unionByName(history_edits(files, workspace, SOURCES["cursor"]), allowMissingColumns=True)


def antigravity(lines: DataFrame) -> DataFrame:
    rows = _rows(lines, "type string, created_at string, content string, step_index bigint")
    source, ts = F.lit(SOURCES["antigravity"]), _ts(F.col("s.created_at"))
    extras = F.create_map(F.lit("stepIndex"), F.col("s.step_index").cast("string"))
    said = rows.where(F.col("s.type").isin("USER_INPUT", "PLANNER_RESPONSE") & (F.coalesce("s.content", F.lit("")) != ""))
    user, c = F.col("s.type") == "USER_INPUT", F.col("s.content")
    asked = F.when(c.rlike(r"(?s)<USER_REQUEST>.*?</USER_REQUEST>"), X.strip(F.regexp_extract(c, r"(?s)<USER_REQUEST>(.*?)</USER_REQUEST>", 1))).otherwise(c)
    messages = _timeline(said, ts=ts, kind=F.lit("message"), role=F.when(user, F.lit("user")).otherwise(F.lit("assistant")), content=F.when(user, asked).otherwise(c), source=source, extras=extras)
    steps = rows.where(F.col("s.type").isin("CODE_ACTION", "VIEW_FILE") & ts.isNotNull())
    verbs = "Created|Modified|Deleted|Updated|Wrote"
    uri = F.coalesce(F.nullif(F.regexp_extract(c, rf"(?i)(?:{verbs})\s+(?:file\s+)?(file:///[^\s\n]+)", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"(?i)File Path:\s*`?(file:///[^\s`\n]+)`?", 1), F.lit("")))
    path = F.try_url_decode(F.regexp_replace(F.regexp_replace(uri, "^file:///", ""), r"\+", "%2B"))
    line = F.element_at(F.concat(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x.rlike(f"(?i){verbs}")), F.array(F.lit("Agent code action"))), 1)
    action = F.when(F.col("s.type") == "VIEW_FILE", F.lit("view")).otherwise(F.lit("edit"))
    return messages.unionByName(_timeline(steps, ts=ts, kind=F.lit("code_edit"), role=F.lit("assistant"), source=source, file=X.base_name(path), path=path, action=action, summary=F.substring(line, 1, 240), extras=extras))


def copilot_events(lines: DataFrame) -> DataFrame:
    rows = _rows(lines, "type string, timestamp string, data struct<content:string>")
    said = rows.where(F.col("s.type").isin("user.message", "assistant.message")).withColumn("text", X.strip(_text_of(F.col("s.data.content")))).where("text <> ''")
    return _timeline(said, ts=_ts(F.col("s.timestamp")), kind=F.lit("message"), role=F.element_at(F.split("s.type", r"\."), 1), content=F.col("text"), source=F.lit(SOURCES["copilot"]))


def folded_patches(lines: DataFrame) -> DataFrame:
    """(path, state): sessions written as a snapshot (kind 0) and values set at key paths (kind 1), replayed in order.

    Replay is sequential by nature: the lines of a file come in order to one task, which goes through its files one after
    the other and holds one state at a time.
    """
    schema = pa.schema([("path", pa.string()), ("state", pa.string())])

    def stepped(state, line: str | None):
        try:
            step = json.loads(line)
        except (TypeError, ValueError):
            return state
        if not isinstance(step, dict):
            return state
        keys = step.get("k")
        if step.get("kind") == 0:
            return step.get("v")
        if step.get("kind") == 1 and state is not None and isinstance(keys, list) and keys:
            return _put(state, keys, step.get("v"))
        return state

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, chars, at, state = ([], []), 0, (), None  # no path equals ()
        for batch in batches:
            for path, line in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if path != at:
                    if at != ():
                        done[0].append(at)
                        done[1].append(json.dumps(state))
                        chars += len(done[1][-1])
                        if chars > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in done], schema=schema)
                            done, chars = ([], []), 0
                    at, state = path, None
                state = stepped(state, line)
        if at != ():
            done[0].append(at)
            done[1].append(json.dumps(state))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in done], schema=schema)

    # by a hash of the path: dealing by the path itself is left out above a union of tables that are dealt by it, each in its own way
    ordered = lines.select("path", "pos", "value").repartition(F.xxhash64("path")).sortWithinPartitions("path", F.col("pos").asc_nulls_last())
    return ordered.select("path", "value").mapInArrow(replay, "path string, state string")


def _put(node, keys: list, value):
    """``node`` with ``value`` at a key path; missing steps become lists under number keys, else objects."""
    key, rest = keys[0], keys[1:]
    if isinstance(node, list):
        if not isinstance(key, int) or key < 0:
            return node
        node.extend([None] * (key + 1 - len(node)))
    elif not isinstance(node, dict):
        return node
    else:
        key = str(key)
        node.setdefault(key, None)
    below = node[key]
    if rest and below is None:
        below = [] if isinstance(rest[0], int) else {}
    node[key] = _put(below, rest, value) if rest else value
    return node


def sibling_transcript(path: Column, session: Column) -> Column:
    """Where the transcript of a chat session's file lies: beside the folder that holds the file."""
    return F.concat(F.regexp_replace(path, r"/[^/]+/[^/]+$", ""), F.lit("/GitHub.copilot-chat/transcripts/"), session, F.lit(".jsonl"))


def _moment(c: Column) -> Column:
    """A time given as milliseconds or as text; null if it is neither."""
    return F.when(X.strip(c).rlike("^[0-9]{1,16}$"), F.timestamp_millis(X.strip(c).cast("long"))).otherwise(_ts(c))


def chat_requests(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was asked in chat sessions (path, state: as folded): timeline rows with ``session``, and (path, session, start).

    A request's text is marked in its rendered message; a first request without one has the session's title, if there is one.
    A session without an id is named by its file. The rows' time is the session's start.
    """
    schema = "sessionId string, creationDate string, customTitle string, requests array<struct<result:struct<metadata:struct<renderedUserMessage:array<struct<text:string>>>>>>"
    s = states.where(F.try_parse_json("state").isNotNull()).select("path", F.from_json("state", schema).alias("s")).where("s is not null")
    session = F.coalesce(F.nullif("s.sessionId", F.lit("")), F.regexp_replace(X.base_name(F.col("path")), r"\.jsonl$", ""))
    s = s.select("path", "s", session.alias("session"), _moment(F.col("s.creationDate")).alias("start"))
    marked = r"(?is)<userRequest>\s*(.*?)\s*</userRequest>"
    asked = s.select("path", "session", "start", F.col("s.customTitle").alias("title"), F.posexplode("s.requests").alias("_pos", "r"))
    said = F.get(F.filter("r.result.metadata.renderedUserMessage", lambda p: p["text"].rlike(marked)), F.lit(0))["text"]
    own = F.nullif(X.strip(F.regexp_extract(said, marked, 1)), F.lit(""))
    title = F.when((F.col("_pos") == 0) & (F.coalesce("title", F.lit("")) != ""), X.strip(F.col("title")))
    asked = asked.withColumn("text", F.coalesce(own, title)).where("text <> ''").withColumn("_file", F.col("path"))
    extras = F.create_map(F.lit("sessionId"), F.col("session"), F.lit("requestIndex"), F.col("_pos").cast("string"))
    columns = {"ts": F.col("start"), "kind": F.lit("message"), "role": F.lit("user"), "content": F.col("text"), "source": F.lit(SOURCES["copilot"]), "extras": extras}
    return _timeline(asked, **columns).withColumn("session", F.col("extras")["sessionId"]), s.select("path", "session", "start")


def transcript_starts(lines: DataFrame) -> DataFrame:
    """(path, start): the last session start that a transcript tells."""
    rows = _rows(lines, "type string, timestamp string, data struct<startTime:string>").where("s.type = 'session.start'")
    start = _moment(F.coalesce(F.nullif("s.timestamp", F.lit("")), F.col("s.data.startTime")))
    return rows.groupBy(F.col("_file").alias("path")).agg(F.max_by(start, "_pos").alias("start"))


def chat_sessions(chats: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Timeline rows of chat session files, each merged with the transcript that lies beside it, if there is one.

    ``chats`` and ``transcripts``: lines (path, pos, value). A chat file that doesn't begin with a snapshot is read as events.
    """
    first = chats.where("trim(value) <> ''").groupBy("path").agg(F.min_by("value", "pos").alias("first")).where(F.try_parse_json("first").isNotNull())
    patched = F.coalesce(F.get_json_object("first", "$.kind") == "0", F.lit(False))
    states = folded_patches(chats.join(first.where(patched).select("path"), "path", "left_semi"))
    asked, found = chat_requests(staged(states, "chat-states"))  # read for several parts of the result, replayed once
    found = found.withColumn("_file", sibling_transcript(F.col("path"), F.col("session")))
    answered = copilot_events(transcripts).join(found.select("_file", "session").distinct(), "_file")
    told = transcript_starts(transcripts).select(F.col("path").alias("_file"), F.col("start").alias("told"))
    beside = transcripts.select(F.col("path").alias("_file")).distinct()
    starts = found.join(beside, "_file", "left_semi").join(told, "_file", "left").select("session", F.coalesce("told", "start").alias("start"))
    events = copilot_events(chats.join(first.where(~patched).select("path"), "path", "left_semi"))
    return merged_sessions(asked, answered, starts).unionByName(events, allowMissingColumns=True)


def read_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, value, modified): small files below ``path`` as whole texts. Hidden folders are read if ``path`` names them."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_modification_time").alias("modified"))


def artifacts(files: DataFrame, root: str) -> DataFrame:
    """Markdown files (path, value, modified) of a session's folder, or of its artifacts and browser folders, as timeline rows.

    The time is that of the file ``<path>.metadata.json``, if it tells one, else that of the file's last change. Spark
    doesn't read files without a byte, so empty notes give no row.
    """
    below = F.substring("path", len(root.rstrip("/")) + 2, 2**30)
    notes = files.where(F.col("path").startswith(root.rstrip("/") + "/") & below.rlike(r"^((artifacts|browser)/)?[^/]+\.md$"))
    told = F.from_json("value", "updatedAt string, createdAt string, timestamp string")
    given = F.coalesce(*[F.nullif(told[k], F.lit("")) for k in ("updatedAt", "createdAt", "timestamp")])
    marks = files.where(F.col("path").endswith(".md.metadata.json")).groupBy(F.regexp_replace("path", r"\.metadata\.json$", "").alias("path")).agg(F.max(_moment(given)).alias("told"))
    rows = notes.join(marks, "path", "left").withColumn("at", F.coalesce("told", "modified")).where("at is not null")
    rows = rows.withColumn("_file", F.col("path")).withColumn("_pos", F.lit(0)).withColumn("f", X.base_name(F.col("path")))
    return _timeline(rows, ts=F.col("at"), kind=F.lit("artifact"), role=F.lit("assistant"), source=F.lit(SOURCES["antigravity"]), file=F.col("f"), path=F.col("path"), summary=F.concat(F.lit("Artifact updated: "), "f"), content=F.substring(F.coalesce("value", F.lit("")), 1, 500))


def log_tails(files: DataFrame, chars: int = 500) -> DataFrame:
    """(id, preview): the ends of the logs of a session's tasks."""
    return files.where(F.col("path").endswith(".log")).select(F.regexp_replace(X.base_name(F.col("path")), r"\.log$", "").alias("id"), F.expr(f"right(value, {int(chars)})").alias("preview"))


def message_files(files: DataFrame) -> DataFrame:
    """(path, value) of the files that hold JSON which says something."""
    return files.where(F.try_parse_json("value").isNotNull() & ~X.strip(F.col("value")).isin("null", "false", "0", '""')).select("path", "value")


def merged_sessions(asked: DataFrame, answered: DataFrame, starts: DataFrame) -> DataFrame:
    """Timeline rows of chat sessions and their transcripts, both with ``session``; starts are (session, start).

    What was asked has no times of its own and takes the session's start. A session that has rows and a start but none of a
    user begins with a placeholder. The order is that of the timeline.
    """
    start = starts.groupBy("session").agg(F.min("start").alias("start"))
    rows = asked.join(start, "session", "left").withColumn("ts", F.coalesce("start", "ts")).drop("start").unionByName(answered, allowMissingColumns=True)
    silent = rows.groupBy("session").agg(F.coalesce(F.bool_or(F.col("role") == "user"), F.lit(False)).alias("spoken")).where("not spoken").join(start.where("start is not null"), "session")
    said = silent.select("session", F.col("start").alias("ts"), F.lit("message").alias("kind"), F.lit("user").alias("role"), F.lit("(session started)").alias("content"), F.lit(SOURCES["copilot"]).alias("source"))
    return rows.unionByName(said, allowMissingColumns=True)


def timed(edits: DataFrame, index: DataFrame) -> DataFrame:
    """Edits (session, epoch, ts) with times from an index (session, created, started, ended; milliseconds, 0 is none).

    An epoch is a tenth of the session's span. Edits that have no time either way are left out.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(0))
    begin = F.coalesce(given("started"), given("created"), F.lit(0))
    known = index.groupBy("session").agg(F.max(F.struct(begin.alias("begin"), F.coalesce(given("ended"), given("started"), begin).alias("end"))).alias("t"))
    span = F.greatest(F.col("t.end") - F.col("t.begin"), F.lit(1))
    at = F.when(F.col("t.begin") > 0, F.timestamp_millis(F.col("t.begin") + F.floor(span * F.coalesce("epoch", F.lit(0)) / 10)))
    return edits.join(known, "session", "left").withColumn("ts", F.coalesce(at, "ts")).drop("t").where("ts is not null")


def editing_sessions(states: DataFrame) -> DataFrame:
    """Text edits and checkpoints of editing sessions (session, ts, value: the session's JSON state).

    A state is parsed once and all it tells leaves it in one step. An edit has the checkpoint of its epoch in its own state;
    of several, the last.
    """
    cp = "array<struct<epoch:bigint,checkpointId:string,requestId:string,label:string,description:string>>"
    op = "array<struct<type:string,uri:string,epoch:bigint,requestId:string,edits:array<struct<text:string>>>>"
    # what isn't strict JSON gives nulls, so it tells nothing; with options, the optimizer doesn't parse once for each part that is taken
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    s = states.select("session", "ts", F.from_json("value", f"timeline struct<checkpoints:{cp},operations:{op}>, initialFileContents array<array<string>>", strict).alias("s"))
    path_of = lambda uri: F.try_url_decode(F.regexp_replace(F.regexp_replace(uri, "^file://", ""), r"\+", "%2B"))
    timeline = F.col("s.timeline")
    s = s.select("session", "ts", timeline["operations"].alias("operations"), timeline["checkpoints"].alias("checkpoints"), F.reverse(timeline["checkpoints"]).alias("last"), F.get(F.get("s.initialFileContents", F.lit(0)), F.lit(0)).alias("begun"))
    s = s.withColumn("epochs", F.col("last.epoch"))
    mark = lambda o: F.get("last", (F.array_position("epochs", o["epoch"]) - 1).cast("int"))
    edits = F.transform(F.filter("operations", lambda o: o["type"] == "textEdit"), lambda o: F.struct(o.alias("o"), mark(o).alias("c")))
    points = F.transform(F.filter("checkpoints", lambda c: c["epoch"] != 0), lambda c: F.struct(F.lit(None).cast(op[6:-1]).alias("o"), c.alias("c")))
    told = f"array<struct<o:{op[6:-1]},c:{cp[6:-1]}>>"
    some = lambda found: F.coalesce(found.cast(told), F.array().cast(told))
    rows = s.select("session", "ts", "begun", F.explode(F.concat(some(edits), some(points))).alias("t")).select("session", "ts", "begun", "t.o", "t.c")
    is_edit = F.col("o").isNotNull()
    either = lambda edit, point: F.when(is_edit, edit).otherwise(point)
    rows = rows.withColumn("p", path_of(either(F.col("o.uri"), F.col("begun")))).where(~is_edit | F.col("p").isNotNull())
    rows = rows.withColumn("_file", F.col("session")).withColumn("_pos", F.lit(0))
    preview = F.substring(F.array_join(F.filter(F.transform("o.edits", lambda e: X.strip(F.coalesce(e["text"], F.lit("")))), lambda t: t != ""), " "), 1, 160)
    summary = either(F.coalesce(F.nullif(preview, F.lit("")), F.nullif("c.label", F.lit("")), F.lit("Copilot chat edit")), F.coalesce("c.label", "c.description", F.lit("Copilot edit checkpoint")))
    epoch, request = either(F.col("o.epoch"), F.col("c.epoch")).cast("string"), F.coalesce("o.requestId", "c.requestId")
    extras = F.create_map(F.lit("epoch"), epoch, F.lit("requestId"), request, F.lit("checkpointId"), F.col("c.checkpointId"), F.lit("sessionId"), F.col("session"))
    kind, action = either(F.lit("code_edit"), F.lit("checkpoint")), F.when(is_edit, F.lit("textEdit"))
    return _timeline(rows, ts=F.col("ts"), kind=kind, role=F.lit("assistant"), source=F.lit(SOURCES["copilot"]), file=X.base_name(F.col("p")), path=F.col("p"), action=action, summary=summary, extras=extras)
