"""Intervals of the graph, sessions merged batch by batch, numbered lines, completed log rows, compiled contexts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import context, fold, graph, history, open_sessions, retrieve, stats, timeline
from quillgraph.sources import lines, notes
from tests.test_graph import T0, at, log, made


def facts(df):
    return sorted((r.id, r.type, r.text, r.status, round(r.confidence, 9), r.importance, r.access_count, str(r.last_verified), r.author, r.branch) for r in df.collect())


def random_log(spark, seed):
    rng = random.Random(seed)
    kinds = ("TaskCreated", "GoalCreated", "DecisionCreated", "TaskStatusChanged", "DecisionResolved", "DecisionSuperseded", "DecisionContradicted", "DecisionOutcomeObserved", "NodeAccessed", "EvidenceRecorded")
    events = []
    for _ in range(200):
        kind, node, other = rng.choice(kinds), rng.choice("abcdef"), rng.choice("uvw")
        e = {"type": kind, "nodeId": node, "text": rng.choice(("use it", "avoid it", "form")), "status": rng.choice((None, "open", "done")), "source": rng.choice(("user", "agent")), "branch": rng.choice((None, "m")), "ts": rng.choice((None, at(rng.randrange(400)), at(7)))}
        e |= {"DecisionSuperseded": {"supersededBy": other}, "DecisionContradicted": {"otherId": other}, "DecisionOutcomeObserved": {"outcome": rng.choice(("confirmed", "reverted")), "evidenceId": other}, "DecisionCreated": {"goalId": rng.choice((None, other))}, "EvidenceRecorded": {"decisionId": other}}.get(kind, {})
        events.append(e)
    return log(spark, *events)


@pytest.mark.parametrize("seed", (1,))
def test_any_moment_is_a_fold_up_to_it(spark, seed):
    events = random_log(spark, seed)
    nodes, edges = history.node_versions(events).cache(), history.edge_versions(events).cache()
    for minutes in (-1, 7, 300):
        moment = F.lit(at(minutes))
        upto = fold.as_of(events, at(minutes))
        assert facts(history.at_moment(nodes, moment)) == facts(fold.nodes(upto))
        ends = {(r["from"], r["to"], r["relation"]) for r in history.at_moment(edges, moment).collect()}
        assert ends == {(r["from"], r["to"], r["relation"]) for r in fold.edges(upto).collect()}
        got = history.retrieve_as_of(nodes, edges, "use it", moment).select("id", "score", "seed", "depth").collect()
        want = retrieve.retrieve(fold.nodes(upto), fold.edges(upto).dropDuplicates(["from", "to", "relation"]), "use it", moment).select("id", "score", "seed", "depth").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    one_at_a_time = nodes.groupBy("id", "valid_from").count().agg(F.max("count")).first()[0]
    assert one_at_a_time == 1 and nodes.where("valid_to <= valid_from").isEmpty()


# --- sessions ------------------------------------------------------------------------------------------------------


def brute_sessions(touches, seconds, cap=10):
    rows = sorted((t, p, f) for t, p, f in touches if t is not None and f is not None)
    out = []
    for t, p, f in rows:
        if not out or (t - out[-1][1]).total_seconds() > seconds:
            out.append([t, t, []])
        out[-1][1] = t
        if f not in (x[2] for x in out[-1][2]):
            out[-1][2].append((t, p, f))
    return [(a, b, [x[2] for x in files[:cap]]) for a, b, files in out]


def sessions_of(df):
    return sorted((r.start, r.end, [f.file for f in r.files]) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_batches_in_any_cut_give_the_sessions_of_one_run(spark, tmp_path, seed):
    """Late touches lengthen sessions, join two of them, and push later files out of the first ten."""
    rng = random.Random(seed)
    t, touches = dt.datetime(2024, 1, 1, 22), []
    for i in range(160):
        t += dt.timedelta(seconds=rng.choice((1, 20, 599, 600, 600, 601, 9000)))
        touches.append((t, i, f"f{rng.randrange(14)}"))
    touches += [(None, 900, "f1"), (t, 901, None)]
    want = brute_sessions(touches, 600)
    assert sessions_of(open_sessions.of_touches(spark.createDataFrame(touches, "ts timestamp, pos long, file string"), 600)) == want
    root, cut = f"file://{tmp_path}/s", [rng.randrange(3) for _ in touches]
    for batch in rng.sample(range(3), 3):
        part = [x for x, c in zip(touches, cut, strict=True) if c == batch]
        order = len([p for p in tmp_path.glob("s/versions/*")])
        for _ in range(2):  # the second changes nothing
            open_sessions.take(spark.createDataFrame(part, "ts timestamp, pos long, file string"), root, order, 600)
    assert sessions_of(open_sessions.sessions(spark, root)) == want
    pairs = {(r["from"], r["to"]) for r in open_sessions.pairs(open_sessions.sessions(spark, root)).collect()}
    assert pairs == {tuple(sorted((a, b))) for _, _, f in want for i, a in enumerate(f) for b in f[i + 1 :]}


def test_sessions_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "ts timestamp, pos long, file string")
    open_sessions.take(none, f"file://{tmp_path}/s", 0)
    assert open_sessions.sessions(spark, f"file://{tmp_path}/s").count() == 0 and open_sessions.of_touches(none).count() == 0


# --- lines and logs ------------------------------------------------------------------------------------------------


def test_numbers_of_lines_in_files_that_many_tasks_read(spark, tmp_path):
    want = {}
    for name, n in (("a", 5000), ("b", 1), ("sub/c", 700)):
        path = tmp_path / f"{name}.jsonl"
        path.parent.mkdir(exist_ok=True)
        rows = [json.dumps({"i": i, "pad": "x" * (i % 50)}) if i % 7 else "" for i in range(n)]
        path.write_text("\n".join(rows) + ("\n" if name == "a" else ""))
        want |= {(path.name, i): r for i, r in enumerate(rows) if r}
    (tmp_path / "not.txt").write_text("no")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = lines.numbered(spark, f"file://{tmp_path}")
        got = {(r.path.rsplit("/", 1)[1], r.pos): r.value for r in df.collect()}
        assert spark.read.text(f"file://{tmp_path}", recursiveFileLookup=True).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == want


def test_log_rows_are_completed_and_read_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("x", "a", None, None), ("x", "a", "", None), ("x", "b", "mine", "s")], "type string, nodeId string, id string, source string")
    done = notes.completed(rows, F.lit(T0)).collect()
    ids = sorted(r.id for r in done)
    assert len(set(ids)) == 3 and "mine" in ids and all(i.startswith("evt_") for i in ids if i != "mine")
    assert {r.source for r in done} == {"quillgraph", "s"} and {r.ts for r in done} == {T0}
    assert sorted(r.id for r in notes.completed(rows, F.lit(T0)).collect()) == ids  # made again: the same
    untimed = notes.completed(rows.withColumn("ts", F.lit(None).cast("timestamp")), F.lit(T0))
    assert {r.ts for r in untimed.collect()} == {None}
    root = f"file://{tmp_path}/log"
    for i in range(3):
        notes.append_events(spark.createDataFrame([("NodeAccessed", f"n{i}-{j}") for j in range(4)], "type string, nodeId string").coalesce(1), f"{root}/{i}", F.lit(T0))
    assert [r.nodeId for r in notes.read_log(spark, root).orderBy("pos").collect()] == [f"n{i}-{j}" for i in range(3) for j in range(4)]


# --- contexts ------------------------------------------------------------------------------------------------------


def test_tiny_profile_takes_importance_and_goals_first(spark):
    """An open goal without a confidence stands before a decision of the same importance; births order what is still equal."""
    events = log(spark, made("d", "decide", 0, confidence=0.85), {"type": "TaskCreated", "nodeId": "t", "text": "task", "ts": at(1)}, {"type": "GoalCreated", "nodeId": "g2", "text": "later goal", "ts": at(3)}, {"type": "GoalCreated", "nodeId": "g1", "text": "goal", "ts": at(2)}, {"type": "FailureObserved", "nodeId": "f", "text": "fail", "ts": at(2)}, {"type": "NodeAccessed", "nodeId": "f", "ts": at(4)})
    got = context.compile_tier(fold.nodes(events), None, "tiny", "", F.lit(T0))
    assert got.included == ["f", "g1", "g2", "t", "d"]


def test_many_contexts_in_one_plan_are_those_of_each(spark):
    rng = random.Random(4)
    rows = [(q, f"n{i}", rng.choice(("Decision", "Task", "Goal")), f"text {i} " + "w" * rng.randrange(60), "open", None, rng.choice((0.01, 0.3, 0.5, 0.9))) for q in ("one", "two") for i in range(150)]
    items = spark.createDataFrame(rows, "query string, id string, type string, text string, status string, kind string, score double")
    edges = spark.createDataFrame([("n1", "n2", "SUPERSEDES", 0), ("n2", "n3", "SUPERSEDES", 1), ("n900", "n5", "SUPERSEDES", 2)], "`from` string, `to` string, relation string, pos int")
    got = {r.query: r for r in context.compile_many(items, edges, "query", "small").collect()}
    for q in ("one", "two"):
        alone = context.compiled(items.where(F.col("query") == q).drop("query"), edges, "small")
        assert (got[q].text, got[q].used, got[q].dropped) == (alone.text, alone.used, alone.dropped) and set(got[q].ids) <= set(alone.included)
    shown = spark.createDataFrame([("one", "x1", got["one"].text[10:60]), ("one", "n0", "not there at all, no"), ("two", "zz", "never shown anywhere")], "query string, id string, text string")
    ranked = spark.createDataFrame([("one", "n0", 7)], "query string, id string, rank int")
    r = {x.query: x for x in stats.compiled_recall(shown, ranked, context.compile_many(items, edges, "query", "small"), 5, 10).collect()}
    assert (r["one"].recall_5, r["one"].recall_10, r["two"].recall_10, r["two"].reciprocal_rank) == (0.5, 1.0, 0.0, 0.0) and abs(r["one"].reciprocal_rank - 1 / 7) < 1e-12


def test_page_with_its_total(spark):
    total, page = timeline.paged(spark.range(25), [F.col("id")], 10, 20)
    assert total == 25 and [r.id for r in page.collect()] == [20, 21, 22, 23, 24]
    assert [r.id for r in timeline.paged(spark.range(5), [F.col("id")], 2, -3)[1].collect()] == [0, 1]


def test_traversal_over_chains_of_versions(spark):
    events = log(spark, made("a", "one", 0), made("b", "two", 1), {"type": "DecisionSuperseded", "nodeId": "a", "supersededBy": "b", "ts": at(2)})
    edges = history.edge_versions(events)
    assert graph.chains(history.at_moment(edges, F.lit(at(1))).withColumn("pos", F.lit(0))).count() == 0
    assert [r.chain for r in graph.chains(history.at_moment(edges, F.lit(at(3)))).collect()] == [["b", "a"]]


def test_walks_end_where_a_circle_begins(spark):
    pairs = [("h", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("p", "q"), ("q", "r"), ("s", "r"), ("c", "d"), ("d", "c"), ("t", "t")]
    edges = spark.createDataFrame([(a, b, "CONTRADICTS", i) for i, (a, b) in enumerate(pairs)], "`from` string, `to` string, relation string, pos int")
    assert {r.head: r.chain for r in graph.chains(edges).collect()} == {"h": ["h", "x"], "p": ["p", "q", "r"], "s": ["s", "r"]}
    assert graph.chains(edges.limit(0)).count() == 0


def test_edges_can_be_made_for_a_frontier(spark):
    every = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")]
    edges = spark.createDataFrame([(a, b, "CO_EDITED", 0.5) for a, b in every], "`from` string, `to` string, relation string, weight double")
    seeds, asked = spark.createDataFrame([("a", 1.0)], "id string, value double"), []

    def near(ids):
        here = ids.cache()
        asked.append(sorted(r.id for r in here.collect()))
        return edges.join(here.withColumnRenamed("id", "from"), "from", "left_semi").unionByName(edges.join(here.withColumnRenamed("id", "to"), "to", "left_semi").select(edges.columns)).distinct()

    pick = lambda df: sorted((r.id, round(r.value, 9), r.depth) for r in df.collect())
    assert pick(graph.traverse(seeds, near)) == pick(graph.traverse(seeds, edges)) and asked == [["a"], ["b"]]


def test_history_of_an_editor(spark):
    from quillgraph.sources import transcripts

    told = {"resource": "file:///w/app/a%20b.py", "entries": [{"id": "3.py", "timestamp": 30}, {"id": "1.py", "timestamp": 10, "source": "Undo"}, {"id": "2.py", "timestamp": 20}, {"id": "4.py"}, {"id": "5.py", "timestamp": 50}]}
    files = [("/h/1/entries.json", json.dumps(told)), ("/h/1/1.py", "x"), ("/h/1/2.py", "x"), ("/h/1/3.py", "y"), ("/h/2/entries.json", "{broken"), ("/h/3/entries.json", json.dumps(told | {"resource": "file:///w/apple/z.py"}))]
    none = spark.createDataFrame([], "path string, pos long, value string, modified timestamp")
    got = transcripts.cursor_with_history(none, spark.createDataFrame(files, "path string, value string"), "/w/app").orderBy("ts").collect()
    assert [(r.file, r.extras["historyId"], r.summary, r.diff and r.diff[-5:], r.source) for r in got] == [
        ("a b.py", "1.py", "Undo", None, "Cursor"), ("a b.py", "2.py", "Local History snapshot", None, "Cursor"), ("a b.py", "3.py", "Local History snapshot", "-x\n+y", "Cursor"), ("a b.py", "5.py", "Local History snapshot", None, "Cursor")
    ]


def test_first_order_is_in_the_editor_history(spark, tmp_path):
    """An order of key 0 is a snapshot like others, not an entry without a time."""
    from quillgraph.plans import catalogue, readers  # noqa: F401

    spark.createDataFrame([(0, 2, "O", "1"), (5, 2, "F", "2"), (6, 3, "F", "2")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"file://{tmp_path}/orders.parquet")
    got = catalogue.QUERIES["editor_history"](spark, f"file://{tmp_path}").collect()
    assert sorted((r.file, r.id, r.summary, r.diff) for r in got) == [("c2.py", "0", "Undo", None), ("c2.py", "5", "Local History snapshot", None)]


def test_bursts_and_watching(spark, tmp_path):
    from quillgraph.streaming import sessions

    day = dt.datetime(2024, 1, 1)
    schema = "path string, ts timestamp, content string"
    rows = [("a", day, "1"), ("a", day + dt.timedelta(seconds=1), "2"), ("a", day + dt.timedelta(seconds=9), "3"), ("b", day + dt.timedelta(seconds=1), "x"), ("b", day + dt.timedelta(seconds=99), "y")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/in")
    sessions.written(sessions.bursts(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/log")
    assert sorted((r.path, r.content, r.changes) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("a", "2", 2), ("a", "3", 1), ("b", "x", 1)]
    seen = []
    query = sessions.watch(spark, f"file://{tmp_path}/in", schema, lambda batch, n: seen.append(batch.count()), f"file://{tmp_path}/watched", "100 milliseconds")
    try:
        query.processAllAvailable()
        spark.createDataFrame(rows[:2], schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [5, 2]
