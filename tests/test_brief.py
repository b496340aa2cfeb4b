"""Briefs: recent events, last checkpoint, notes drawn from the timeline, embedding cache, strided sample."""

import datetime as dt

from quillgraph.operators import brief
from quillgraph.sources import notes

T0 = dt.datetime(2026, 1, 1)


def rows(spark):
    made = []
    for i in range(40):
        kind = ("message", "message", "code_edit", "artifact")[i % 4]
        role = ("user", "assistant", None, None)[i % 4]
        made.append((i, T0 + dt.timedelta(minutes=i), kind, role, "agent", f"Should we do {i // 8}?\nmore" if role == "user" else f"text {i}", f"f{i}.py", f"/w/f{i}.py", f"edit {i}"))
    return spark.createDataFrame(made, "pos long, ts timestamp, kind string, role string, source string, content string, file string, path string, summary string")


def test_recent_counts_each_sort(spark):
    got = brief.recent(rows(spark)).collect()
    assert len(got) == 6 + 4 + 5 + 3 and [r.pos for r in got] == sorted(r.pos for r in got)


def test_last_checkpoint_or_edit(spark):
    r = rows(spark)
    assert brief.last_checkpoint(r).first().pos == 38
    mark = r.where("pos = 3").withColumnRenamed("kind", "k").selectExpr("pos", "ts", "'checkpoint' as kind", "role", "source", "content", "file", "path", "summary")
    assert brief.last_checkpoint(r.unionByName(mark)).first().pos == 3
    assert brief.last_checkpoint(r.limit(0)).count() == 0


def test_drawn_notes_are_distinct_and_newest(spark):
    tasks, decisions = (x.collect() for x in brief.drawn_notes(rows(spark)))
    assert [r.line for r in tasks] == [f"- [ ] Should we do {i}?" for i in range(5)] == [r.line for r in decisions]


def test_sample_texts(spark):
    got = brief.sample(rows(spark), 3).collect()
    assert [r.pos for r in got] == [37, 38, 39] and got[1].text.endswith("f38.py — edit 38") and " | message | assistant\n" in got[0].text


def test_note_lines_and_fallback(spark):
    n = notes.note_lines(spark.createDataFrame([("a", "## Open\n- [ ] one\n- two\n## Done\n- three"), ("b", "- [ ] four\n- five")], "path string, value string"))
    assert [r.line for r in brief.open_decision_lines(n).collect()] == ["- [ ] one", "- two", "- [ ] four"]
    assert brief.task_lines(n).count() == 5


def test_embedding_cache(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    cache = nodes.where("id = 'a'").selectExpr("id", "sha1(text) as hash", "array(1.0D) as vector")
    stale = brief.stale_texts(nodes, cache)
    assert [r.id for r in stale.collect()] == ["b"]
    fresh = stale.selectExpr("id", "hash", "array(2.0D) as vector")
    assert brief.updated_cache(cache, fresh).count() == 2


def test_strided_and_figures(spark):
    assert [r.pos for r in brief.strided(rows(spark), 10, "pos").collect()] == list(range(0, 40, 4))
    agents = spark.createDataFrame([("connected",), ("off",)], "status string")
    got = brief.project_figures(rows(spark), agents).first()
    assert (got.events, got.connected_agents) == (40, 1)
    assert brief.by_source(rows(spark)).first().n == 40
