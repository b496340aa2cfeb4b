"""Transcript and note readers on literal lines."""

import json

from quillgraph.sources import notes, transcripts


def lines(spark, *values, path="f"):
    rows = [(path, i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "path string, pos long, value string")


def test_claude(spark):
    got = transcripts.claude(
        lines(
            spark, {"type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "hello"}},
            {"type": "assistant", "timestamp": "2026-01-01T00:01:00Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/w/a.py", "old_string": "x", "new_string": "y"}}, {"type": "tool_use", "name": "Read", "input": {"file_path": "b"}}]}},
            "{broken",
        )
    ).orderBy("ts", "kind").collect()
    assert [(r.kind, r.role, r.content, r.file, r.summary) for r in got] == [("message", "user", "hello", None, None), ("code_edit", "assistant", None, "a.py", "Edited a.py"), ("message", "assistant", "ok", None, None)]
    assert got[1].diff.endswith("-x\n+y") and got[1].extras["toolUseId"] == "t1"


def test_codex(spark):
    patch = "*** Begin Patch\n*** Update File: src/z.rs\n+x"
    got = transcripts.codex(
        lines(spark, {"type": "event_msg", "timestamp": "2026-01-01T00:00:00Z", "payload": {"type": "user_message", "message": "hi"}}, {"type": "response_item", "timestamp": "2026-01-01T00:00:01Z", "payload": {"type": "function_call", "name": "apply_patch", "arguments": json.dumps({"patch": patch}), "call_id": "c"}})
    ).orderBy("ts").collect()
    assert got[0].content == "hi" and (got[1].path, got[1].file, got[1].diff) == ("src/z.rs", "z.rs", patch)


def test_cursor(spark):
    from pyspark.sql import functions as F

    rows = lines(spark, {"role": "user", "message": {"content": [{"type": "text", "text": "<user_query>\nfix it\n</user_query>"}]}}, {"role": "assistant", "message": {"content": [{"type": "text", "text": "[REDACTED]"}]}})
    got = transcripts.cursor(rows.withColumn("modified", F.lit("2026-01-01").cast("timestamp"))).collect()
    assert [(r.content, r.role) for r in got] == [("fix it", "user")]


def test_antigravity_and_copilot(spark):
    got = transcripts.antigravity(
        lines(spark, {"type": "USER_INPUT", "created_at": "2026-01-01T00:00:00Z", "content": "a <USER_REQUEST> do </USER_REQUEST>", "step_index": 1}, {"type": "CODE_ACTION", "created_at": "2026-01-01T00:00:05Z", "content": "x\nCreated file file:///w/my%20a.py now", "step_index": 2}, {"type": "CODE_ACTION", "content": "no time"})
    ).orderBy("ts").collect()
    assert got[0].content == "do" and got[1].path == "w/my a.py" and len(got) == 2
    got = transcripts.copilot_events(lines(spark, {"type": "session.start"}, {"type": "user.message", "timestamp": "2026-01-01T00:00:00Z", "data": {"content": "q"}})).collect()
    assert [(r.role, r.content) for r in got] == [("user", "q")]


def test_patches_are_replayed(spark):
    got = transcripts.folded_patches(lines(spark, {"kind": 1, "k": ["x"], "v": 1}, {"kind": 0, "v": {"a": 1}}, {"kind": 1, "k": ["b", 0, "c"], "v": 5}, "nonsense", {"kind": 1, "k": ["a"], "v": 2})).collect()
    assert json.loads(got[0].state) == {"a": 2, "b": [{"c": 5}]}


def test_editing_sessions(spark):
    state = {"timeline": {"checkpoints": [{"epoch": 0, "checkpointId": "c0"}, {"epoch": 1, "checkpointId": "c1", "label": "L"}], "operations": [{"type": "textEdit", "uri": "file:///w/a.py", "epoch": 1, "edits": [{"text": " x "}]}, {"type": "other", "uri": "file:///w/b.py", "epoch": 1}]}, "initialFileContents": [["file:///w/a.py", "t"]]}
    df = spark.createDataFrame([("s", None, json.dumps(state))], "session string, ts timestamp, value string")
    got = {r.kind: r for r in transcripts.editing_sessions(df).collect()}
    assert got["code_edit"].summary == "x" and got["code_edit"].extras["checkpointId"] == "c1"
    assert got["checkpoint"].summary == "L" and got["checkpoint"].file == "a.py"


def test_editing_sessions_are_parsed_once(spark):
    """An edit has the last checkpoint of its epoch in its own state; what isn't JSON tells nothing; a state is read and parsed once."""
    op = lambda e, n: {"type": "textEdit", "uri": f"file:///w/{n}.py", "epoch": e, "edits": []}
    state = {"timeline": {"checkpoints": [{"epoch": 1, "checkpointId": "old"}, {"epoch": 1, "checkpointId": "new", "requestId": "r"}], "operations": [op(1, "a"), op(2, "b"), op(None, "c")]}}
    other = {"timeline": {"checkpoints": [{"epoch": 2, "checkpointId": "other"}]}}
    df = spark.createDataFrame([("s", None, json.dumps(state)), ("s", None, json.dumps(other)), ("t", None, json.dumps(state)[:-2]), ("u", None, None), ("v", None, json.dumps(state).replace('"', "'")), ("w", None, json.dumps(state | {"x": float("nan")}))], "session string, ts timestamp, value string")
    found = transcripts.editing_sessions(df)
    edits = {r.file: (r.extras["checkpointId"], r.extras["requestId"]) for r in found.where("kind = 'code_edit'").collect()}
    assert edits == {"a.py": ("new", "r"), "b.py": (None, None), "c.py": (None, None)}
    assert found.where("kind = 'code_edit'").count() == 3 and found.where("kind = 'checkpoint'").count() == 3
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


NOTES = """# Notes
## Open
- [ ] Use redis
  - Evidence: it is fast
  - Serves: Less waiting
- [ ]
## Resolved
- 2026-02-01 — Keep it small
## Goals
- Less waiting
## Open
- not this one
"""


def test_notes(spark):
    rows = notes.note_lines(spark.createDataFrame([("n", NOTES), ("empty", None)], "path string, value string"))
    assert [r.text for r in notes.open_decisions(rows).collect()] == ["Use redis"]
    assert len(notes.open_decisions(rows, strict=True).collect()) == 3
    (done,) = notes.resolved_decisions(rows).collect()
    assert str(done.ts).startswith("2026-02-01")
    assert [r.text for r in notes.goals(rows).collect()] == ["Less waiting"]
    (e,) = notes.evidence(rows).collect()
    assert e.text == "it is fast" and e.parent_id == notes.open_decisions(rows).first().nodeId
    assert [r.text for r in notes.serves(rows).collect()] == ["Less waiting"]


def test_tasks_failures_log_and_commits(spark):
    rows = notes.note_lines(spark.createDataFrame([("n", "- [x] done it\n- [ ] open it\n- plain, fixed")], "path string, value string"))
    assert [(r.text, r.status) for r in notes.tasks(rows).orderBy("pos").collect()] == [("done it", "done"), ("open it", "open")]
    assert notes.failures(rows).where("selfResolved").count() == 1
    got = notes.event_log(lines(spark, {"id": "e", "type": "GoalCreated", "nodeId": "g"}, "", "{bad")).collect()
    assert [(r.id, r.nodeId, r.pos) for r in got] == [("e", "g", 0)]
    (c,) = notes.commits(lines(spark, "abcdef1|1700000000|subject", "a.py", "", "b.py")).collect()
    assert (c.hash, c.subject, c.files) == ("abcdef1", "subject", ["a.py", "b.py"])


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert transcripts.read_lines(spark, str(tmp_path)).count() == 2
    assert notes.newest(notes.listed(spark, str(tmp_path))).first().path.endswith("x.jsonl")
