"""Session discovery, merged chat sessions, labels and keyed stream state on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import graph, stats, timeline
from quillgraph.sources import notes, transcripts
from quillgraph.streaming import sessions


def at(day, second=0):
    return dt.datetime(2024, 1, day, 0, 0, second)


def test_sessions_are_found_by_folder_slug_or_token_else_the_newest(spark):
    rows = [("/a/x.jsonl", 0, '{"cwd": "/w/app/sub"}', at(1)), ("/a/x.jsonl", 1, '{"cwd": "/else"}', at(1)), ("/a/y.jsonl", 0, "not json", at(3)), ("/b/-w-other/z.jsonl", 0, "{}", at(2)), ("/a/y.jsonl", 1, "say relay-7", at(3))]
    lines = spark.createDataFrame(rows, "path string, pos int, value string, modified timestamp")
    found = lambda *a: [r.path for r in notes.session_of(lines, *a).collect()]
    assert found("/w/app/") == ["/a/x.jsonl"]
    assert found("/w/other") == ["/b/-w-other/z.jsonl"]
    assert found("/w/app", "relay-7") == ["/a/y.jsonl"]  # both match, the newer one wins
    assert found("/nowhere") == ["/a/y.jsonl"]
    assert notes.session_of(lines.limit(0), "/w").count() == 0


def test_chat_sessions(spark):
    path = spark.range(1).select(transcripts.sibling_transcript(F.lit("/s/w1/chatSessions/q.jsonl"), F.lit("id9")).alias("p")).first().p
    assert path == "/s/w1/GitHub.copilot-chat/transcripts/id9.jsonl"
    schema = "session string, ts timestamp, kind string, role string, content string, source string"
    asked = spark.createDataFrame([("a", None, "message", "user", "hi", "s"), ("d", at(9), "message", "user", "no start", "s")], schema)
    answered = spark.createDataFrame([("a", at(2), "message", "assistant", "yes", "s"), ("b", at(2), "message", "assistant", "alone", "s"), ("c", at(2), "message", None, "no start", "s")], schema)
    starts = spark.createDataFrame([("a", at(1)), ("b", at(1)), ("e", at(1)), ("c", None)], "session string, start timestamp")
    got = sorted((r.session, r.role or "", r.content, r.ts.day) for r in transcripts.merged_sessions(asked, answered, starts).collect())
    assert got == [("a", "assistant", "yes", 2), ("a", "user", "hi", 1), ("b", "assistant", "alone", 2), ("b", "user", "(session started)", 1), ("c", "", "no start", 2), ("d", "user", "no start", 9)]


def test_edits_take_a_tenth_of_the_session_an_epoch(spark):
    index = spark.createDataFrame([("a", 1000, 0, 11000), ("b", 0, 0, 0)], "session string, created long, started long, ended long")
    edits = spark.createDataFrame([("a", 3, None), ("a", None, None), ("b", 1, at(5)), ("c", 1, None)], "session string, epoch long, ts timestamp")
    got = sorted((r.session, r.ms) for r in transcripts.timed(edits, index).select("session", F.unix_millis("ts").alias("ms")).collect())
    assert got == [("a", 1000), ("a", 4000), ("b", int(at(5).replace(tzinfo=dt.timezone.utc).timestamp() * 1000))]


def test_segment_labels(spark):
    rows = [(1, 1, "message", "user", "a  b\nc", None, None), (1, 2, "code_edit", "assistant", None, "f.py", None), (2, 1, "message", "user", "", None, None), (2, 2, "artifact", "assistant", "x", "", "sum"), (3, 1, "code_edit", None, None, None, None), (4, 1, "message", "assistant", "w" * 80, None, None), (5, 1, "message", None, None, None, None)]
    df = spark.createDataFrame(rows, "g int, n int, kind string, role string, content string, file string, summary string")
    got = {r.g: r.label for r in df.groupBy("g").agg(timeline.segment_label("n").alias("label")).collect()}
    assert got == {1: "a b c", 2: "sum", 3: "Code edit", 4: "w" * 72, 5: "Activity"}


def test_noise(spark):
    df = spark.createDataFrame([("yarn.LOCK",), ("a/package.json",), ("tsconfig.json",), ("main.go",)], "p string")
    assert [r.n for r in df.select(X.is_noise(F.col("p")).alias("n")).collect()] == [True, False, True, False]


def test_state_of_keys_follows_late_rows_null_keys_and_repeated_batches(spark, tmp_path):
    state = lambda df: df.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("v"))
    root = f"file://{tmp_path}/state"
    handle = sessions.kept_state(root, F.col("k"), state, buckets=4)
    batches = [[("a", 2), ("b", 1), (None, 9)], [("a", 1)], [(None, 5)], [("c", 7), ("b", 0)]]
    for number, rows in enumerate(batches):
        for _ in range(2):  # a batch that is tried again
            handle(spark.createDataFrame(rows, "k string, v int"), number)
    assert {r.k: r.v for r in sessions.state_now(spark, root, "k").collect()} == {"a": [1, 2], "b": [0, 1], "c": [7]}


def test_figures_at_k_with_ties_and_queries_without_relevant_rows(spark):
    rows = [("q", 1.0, 2, True), ("q", 1.0, 1, False), ("q", 0.5, 3, True), ("none", 1.0, 1, False)]
    got = {r["query"]: r for r in stats.scored_quality(spark.createDataFrame(rows, "query string, score double, id int, relevant boolean"), 1, 2).collect()}
    assert (got["q"].recall_1, got["q"].recall_2, got["q"].precision_2, got["q"].reciprocal_rank) == (0.0, 0.5, 0.5, 0.5)
    assert (got["none"].recall_2, got["none"].precision_2, got["none"].share_2, got["none"].reciprocal_rank) == (0.0, 0.0, 0.0, 0.0)


def test_contradictions_equal_all_pairs(spark):
    import random

    draw = random.Random(4)
    words = ["cache", "redis", "queue", "kafka", "index", "table", "login", "token", "parser", "schema"]
    rows = [(i, " ".join([draw.choice(("use", "avoid", "adopt", "reject", "keep")), *draw.sample(words, draw.randint(1, 6))]), draw.choice((None, "m", "d")), i) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, text string, branch string, pos int")
    got = {(r.old_id, r.new_id) for r in graph.contradictions(df).collect()}
    a, b = df.alias("a"), df.alias("b")
    both = a.crossJoin(b).where("a.pos < b.pos and (a.branch is null or b.branch is null or a.branch = b.branch)").where(X.contradicts(F.col("a.text"), F.col("b.text")))
    assert got == {(r[0], r[1]) for r in both.select("a.id", "b.id").collect()} and len(got) > 50


def test_contradictions_judge_pairs_by_numbers(spark):
    """Pairs are judged where they meet, their texts aren't broken up again; subjects of more tokens than a signature has bits are right."""
    import random

    draw = random.Random(9)
    words = [f"w{i:04d}" for i in range(600)]
    rows = [(i, " ".join([draw.choice(("use", "avoid", "enable", "disable use")), *draw.sample(words[: draw.choice((40, 600))], draw.choice((3, 12, 30, 36)) if i % 3 else 30), *(words[:400] if i % 20 == 0 else [])]), draw.choice((None, "m", "d")), i) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, text string, branch string, pos int")
    found = graph.contradictions(df)
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    a, b = df.alias("a"), df.alias("b")
    both = a.crossJoin(b).where("a.pos < b.pos and (a.branch is null or b.branch is null or a.branch = b.branch)").where(X.contradicts(F.col("a.text"), F.col("b.text")))
    want = {(r[0], r[1]) for r in both.select("a.id", "b.id").collect()}
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 20
