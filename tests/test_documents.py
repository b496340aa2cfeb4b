"""Chat sessions, markdown artifacts, and the context and brief documents."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quillgraph.operators import documents
from quillgraph.operators.context import Context
from quillgraph.sources import notes, transcripts

T0 = dt.datetime(2026, 1, 1)


def lines(spark, files):
    rows = [(path, i, v if isinstance(v, str) else json.dumps(v)) for path, values in files.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "path string, pos long, value string")


def test_chat_sessions_with_and_without_transcripts(spark):
    said = lambda t: {"result": {"metadata": {"renderedUserMessage": [{"text": "none"}, {"text": f"<UserRequest>\n {t} \n</UserRequest>"}]}}}
    chats = {
        "/s/w/chatSessions/a.jsonl": [{"kind": 0, "v": {"sessionId": "ida", "creationDate": 1767225600000, "customTitle": " title ", "requests": [{}]}}, {"kind": 1, "k": ["requests", 1], "v": said("fix it")}],
        "/s/w/chatSessions/b.jsonl": [{"kind": 0, "v": {"creationDate": "2026-01-02T00:00:00Z", "requests": [said("alone"), {}, said("")]}}],
        "/s/w/chatSessions/c.jsonl": [{"type": "user.message", "timestamp": "2026-01-03T00:00:00Z", "data": {"content": "plain"}}],
        "/s/w/chatSessions/d.jsonl": [{"kind": 0, "v": {"sessionId": "idd", "requests": []}}],
        "/s/w/chatSessions/e.jsonl": ["broken", {"kind": 0, "v": {}}],
        "/s/w/chatSessions/f.jsonl": [{"kind": 0, "v": None}],
    }
    beside = "/s/w/GitHub.copilot-chat/transcripts/"
    told = {
        beside + "ida.jsonl": [{"type": "session.start", "timestamp": "2026-01-05T00:00:00Z"}, {"type": "assistant.message", "timestamp": "2026-01-05T00:00:09Z", "data": {"content": "done"}}],
        beside + "idd.jsonl": [{"type": "session.start", "data": {"startTime": "2026-01-06T00:00:00Z"}}, {"type": "assistant.message", "timestamp": "2026-01-06T00:00:01Z", "data": {"content": "hm"}}],
    }
    got = transcripts.chat_sessions(lines(spark, chats), lines(spark, told)).withColumn("at", F.date_format("ts", "dd ss")).collect()
    assert sorted((r.session or "", r.at, r.role, r.content) for r in got) == [
        ("", "03 00", "user", "plain"), ("b", "02 00", "user", "alone"), ("ida", "05 00", "user", "fix it"), ("ida", "05 00", "user", "title"), ("ida", "05 09", "assistant", "done"),
        ("idd", "06 00", "user", "(session started)"), ("idd", "06 01", "assistant", "hm"),
    ]
    assert transcripts.chat_sessions(lines(spark, chats).limit(0), lines(spark, told)).count() == 0


def test_artifacts_logs_and_messages(spark, tmp_path):
    for name, text in {"plan.md": "x" * 600, "plan.md.metadata.json": '{"updatedAt": "2026-01-01T00:00:05Z"}', "artifacts/walk.md": "w", "artifacts/walk.md.metadata.json": "broken", "browser/b.md": "", "deep/er/no.md": "n", ".system_generated/tasks/t1.log": "a" * 400 + "b" * 200, ".system_generated/messages/m.json": '{"a": 1}', ".system_generated/messages/n.json": "null", ".system_generated/messages/o.json": "{"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root = f"file://{tmp_path}"
    files = transcripts.read_files(spark, root, "*.{md,json}")
    real = files.select(F.regexp_extract("path", "^(.*)/plan.md$", 1).alias("r")).where("r <> ''").first().r
    got = {r.file: r for r in transcripts.artifacts(files, real).collect()}
    assert set(got) == {"plan.md", "walk.md"} and len(got["plan.md"].content) == 500
    assert got["plan.md"].ts.second == 5 and got["walk.md"].ts is not None and got["walk.md"].summary == "Artifact updated: walk.md"
    (tail,) = transcripts.log_tails(transcripts.read_files(spark, root + "/.system_generated/tasks", "*.log")).collect()
    assert (tail.id, tail.preview) == ("t1", "a" * 300 + "b" * 200)
    assert [r.value for r in transcripts.message_files(transcripts.read_files(spark, root + "/.system_generated/messages", "*.json")).collect()] == ['{"a": 1}']


def timeline_rows(spark):
    made = [(i, T0 + dt.timedelta(minutes=i), ("message", "message", "code_edit", "artifact")[i % 4], ("user", "assistant", None, None)[i % 4], "agent", "c" * 400, f"f{i}.py", f"/w/f{i}.py", f"edit {i}", "d" if i % 8 == 2 else None) for i in range(40)]
    return spark.createDataFrame(made, "pos long, ts timestamp, kind string, role string, source string, content string, file string, path string, summary string, diff string")


def test_context_document(spark, tmp_path):
    agents = documents.connected(spark.createDataFrame([("b", "connected", 3, None), ("a", "off", 1, None)], "name string, status string, events long, connected timestamp"))
    project = documents.Project("/w", "now", agents=agents)
    n = notes.note_lines(spark.createDataFrame([("a", "## Open\n- [ ] one")], "path string, value string"))
    doc = documents.context_document(project, timeline_rows(spark), n, n, Context("Goal: g", ["g"], 0, 2, 200))
    assert len(doc["events"]) == 18 and doc["tasks"] == ["- [ ] one"] == doc["decisions"] and doc["checkpoint"]["file"] == "f38.py"
    edits = [e for e in doc["events"] if e["kind"] == "code_edit"]
    assert [e["has_diff"] for e in edits] == [False, True, False, True, False]
    assert all(len(e["content"]) == 320 for e in doc["events"] if e["kind"] == "message") and "Timeline events: 40" in doc["summary"]
    text = documents.context_markdown(doc)
    assert "## CURRENT TASKS\n- [ ] one\n" in text and "- **code_edit** via agent at 2026-01-01T00:38:00.000Z\n- File: `f38.py`\n- edit 38" in text and text.endswith("Goal: g\n_1 nodes | ~2/200 tokens_")
    documents.write(spark, doc, text, f"file://{tmp_path}/doc")
    documents.write(spark, doc, text, f"file://{tmp_path}/doc")
    assert json.loads(spark.read.parquet(f"file://{tmp_path}/doc/json").first().value) == doc and spark.read.parquet(f"file://{tmp_path}/doc/markdown").first().value == text


def test_documents_of_an_empty_project(spark):
    rows = timeline_rows(spark).limit(0)
    n = notes.note_lines(spark.createDataFrame([], "path string, value string"))
    doc = documents.context_document(documents.Project("/w", "now", summary="S" * 2000), rows, n, n)
    text = documents.context_markdown(doc)
    assert len(doc["summary"]) == 1200 and all(x in text for x in ("_No tasks yet._", "_No open decisions._", "_No agents connected._", "No checkpoint", "_No events yet._")) and "MEMORY GRAPH" not in text
    got = documents.brief_document(documents.Project("/w", "now"), rows, {"project": " "})
    assert (got["events"], got["shown"]) == (0, 0) and documents.brief_markdown(got).endswith("_Empty._") and "(empty)" in documents.brief_markdown(got)


def test_brief_document(spark):
    got = documents.brief_document(documents.Project("/w", "now", agents=[{"name": "b", "events": 3, "connected": None}]), timeline_rows(spark), {"tasks": "- one"})
    text = documents.brief_markdown(got)
    assert (got["events"], got["shown"]) == (40, 40) and "- b (3 events)" in text and "```markdown\n- one\n```" in text and text.count("```text") == 40


def test_chat_sessions_are_replayed_once_and_whole(spark):
    """The result's plan has no replay in it; a file's lines meet in one task however the tables they come from are dealt."""
    n = 300
    path = F.format_string("/s/w/chatSessions/%d.jsonl", "id")
    begun = F.format_string('{"kind": 0, "v": {"sessionId": "%d", "requests": []}}', "id")
    said = F.lit('{"result": {"metadata": {"renderedUserMessage": [{"text": "<userRequest>x</userRequest>"}]}}}')
    ids = spark.range(n)
    first = ids.select(path.alias("path"), F.lit(-1).cast("long").alias("pos"), begun.alias("value"))
    after = ids.crossJoin(spark.range(3).withColumnRenamed("id", "at")).select(path.alias("path"), F.col("at").alias("pos"), F.concat(F.lit('{"kind": 1, "k": ["requests", '), "at", F.lit('], "v": '), said, F.lit("}")).alias("value"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = transcripts.chat_sessions(first.unionByName(after), first.limit(0))
        assert "replay" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = found.groupBy("session").agg(F.count("*").alias("n"), F.count_distinct("content").alias("m")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(got) == n and {(r.n, r.m) for r in got} == {(3, 1)}
