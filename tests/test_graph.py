"""Fold, ranking, traversal, chains, context, contradictions on small literal tables."""

import datetime as dt

from pyspark.sql import functions as F

from quillgraph.operators import context, fold, graph, ingest, rank, stats, timeline
from quillgraph.plans.constants import EVENT_DDL

T0 = dt.datetime(2026, 1, 1)


def log(spark, *events, partitions=3):
    names = [x.strip("` ").split()[0].strip("`") for x in EVENT_DDL.split(", ")]
    rows = [(*[e.get(n, f"e{i}" if n == "id" else None) for n in names], i) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, EVENT_DDL + ", pos long").repartition(partitions)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def made(n, text, ts=0, **more):
    return {"type": "DecisionCreated", "nodeId": n, "text": text, "ts": at(ts), "source": "agent", **more}


def test_superseded_decision(spark):
    events = log(spark, made("a", "one", 0), made("b", "two", 1, source="user"), {"type": "DecisionSuperseded", "nodeId": "a", "supersededBy": "b", "ts": at(2)})
    nodes = {r.id: r for r in fold.nodes(events).collect()}
    assert nodes["a"].status == "superseded" and nodes["a"].confidence < 0.2
    assert nodes["b"].status == "active" and nodes["b"].confidence == 0.95
    (edge,) = fold.edges(events).collect()
    assert (edge["from"], edge["to"], edge["relation"]) == ("b", "a", "SUPERSEDES")


def test_confidence_rules(spark):
    events = log(spark, made("a", "x", source="human"), made("b", "We decided on it"), made("c", "maybe"), made("d", "x", confidence=0.42))
    assert {r.id: r.confidence for r in fold.nodes(events).collect()} == {"a": 0.95, "b": 0.85, "c": 0.6, "d": 0.42}


def test_order_is_time_then_position_whatever_the_partitions(spark):
    events = [made("a", "x", 5), {"type": "DecisionResolved", "nodeId": "a", "ts": at(5)}, made("a", "y", 1), {"type": "DecisionOutcomeObserved", "nodeId": "a", "outcome": "confirmed", "ts": at(9)}]
    want = None
    for n in (1, 2, 7):
        (row,) = fold.nodes(log(spark, *events, partitions=n)).collect()
        assert want in (None, row)
        want = row
    assert want.status == "resolved" and want.text == "x" and abs(want.confidence - 0.7) < 1e-9


def test_events_before_the_node_exists_change_nothing(spark):
    events = log(spark, {"type": "NodeAccessed", "nodeId": "a", "ts": at(0)}, {"type": "DecisionOutcomeObserved", "nodeId": "a", "outcome": "reverted", "evidenceId": "e", "ts": at(0)}, made("a", "x", 1), {"type": "SomethingNew", "nodeId": "z", "ts": at(2)})
    (row,) = fold.nodes(events).collect()
    assert row.access_count == 0 and row.status == "active"
    assert fold.edges(events).count() == 0


def test_access_and_tasks_and_failures(spark):
    events = log(
        spark, made("a", "x"), *[{"type": "NodeAccessed", "nodeId": "a", "ts": at(i)} for i in (1, 2)], {"type": "TaskCreated", "nodeId": "t", "text": "t", "ts": at(0)},
        {"type": "TaskStatusChanged", "nodeId": "t", "status": "done", "ts": at(1)}, {"type": "FailureObserved", "nodeId": "f", "text": "f", "causedBy": ["a"], "fixedBy": ["t"], "ts": at(3)},
        {"type": "FileTouched", "path": "src/a.py", "ts": None}, {"type": "GoalCreated", "nodeId": "g", "text": "g", "ts": at(1)},
    )
    nodes = {r.id: r for r in fold.nodes(events).collect()}
    assert (nodes["a"].importance, nodes["a"].access_count) == (1.2, 2)
    assert nodes["t"].status == "done" and nodes["f"].status == "resolved" and nodes["file:src/a.py"].last_verified is None
    assert {r["relation"] for r in fold.edges(events).collect()} == {"CAUSED_BY", "FIXED_BY"}
    memory = {r.id: r.bucket for r in fold.working_memory(fold.nodes(events)).collect()}
    assert memory == {"a": "decisions", "g": "goals"}


def edges_of(spark, *rows):
    return spark.createDataFrame([(*r, None, None, i) for i, r in enumerate(rows)], "`from` string, `to` string, relation string, weight double, valid_from timestamp, valid_to timestamp, pos long")


def test_traversal_compounds_the_decay_and_walks_through_missing_nodes(spark):
    e = edges_of(spark, ("a", "b", "SERVES", 1.0), ("b", "c", "SERVES", 1.0))
    seeds = spark.createDataFrame([("a", 1.0)], "id string, value double")
    got = {r.id: r for r in graph.traverse(seeds, e).collect()}
    assert abs(got["b"].value - 0.6) < 1e-12 and abs(got["c"].value - 0.6**3) < 1e-12
    assert got["c"].path == ["a", "b", "c"] and got["a"].depth == 0
    assert "c" not in {r.id for r in graph.traverse(seeds, e, hops=1).collect()}


def test_chains_stop_at_cycles(spark):
    c = {r.head: r.chain for r in graph.chains(edges_of(spark, ("a", "b", "SUPERSEDES", 1.0), ("b", "c", "CONTRADICTS", 1.0))).collect()}
    assert c == {"a": ["a", "b", "c"]}
    assert graph.chains(edges_of(spark, ("x", "y", "SUPERSEDES", 1.0), ("y", "x", "SUPERSEDES", 1.0))).count() == 0


def test_contradictions(spark):
    rows = [("a", "Use redis for billing", None, 0), ("b", "Avoid redis for billing", "main", 1), ("c", "Avoid redis for billing now", "other", 2), ("d", "Use kafka within billing", "main", 3)]
    d = spark.createDataFrame(rows, "id string, text string, branch string, pos long")
    assert {("a", "b"), ("a", "c")} == {tuple(r) for r in graph.contradictions(d).collect()}


def test_retrieval(spark):
    rows = [(1, "src/area0/login.ts"), (2, "src/area0/form.ts"), (3, "src/area1/login.ts"), (4, "src/area1/x.ts"), (5, "lib/login.ts")]
    d = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.relevance for r in rank.lexical(d, "login form").collect()}
    assert max(got, key=got.get) == 2 and got[4] == 0.0
    assert {r.relevance for r in rank.lexical(d, " ").collect()} == {1.0}
    boost = {r.id: r.boost for r in rank.directory_boost(d, "src area0").collect()}
    assert boost[1] == 4.0 and boost[3] == 2.5 and boost[5] == 1.0


def test_components_round_before_they_multiply(spark):
    row = spark.createDataFrame([(0.12345, 0.6, 1.0, None, 0.01, "Goal", 0.5)], "relevance double, confidence double, importance double, last_verified timestamp, decay_rate double, type string, reputation double")
    got = rank.components(row, F.lit("2026-01-01").cast("timestamp")).first()
    assert got.components.relevance == 0.123 and got.components.freshness == 1.0 and got.components.reputation == 1.0
    assert got.score == 0.074


def items(spark, *rows):
    return spark.createDataFrame(rows, "id string, type string, text string, status string, kind string, score double")


def test_fill_skips_what_does_not_fit(spark):
    d = spark.createDataFrame([("a", 6, 3.0), ("b", 6, 2.0), ("c", 4, 1.0)], "id string, cost long, score double")
    row = context.fill(d, 10).first()
    assert (row.used, row.ids, row.dropped) == (10, ["a", "c"], 1)
    row = context.fill(d, 5).first()
    assert (row.used, row.ids) == (5, ["a"])


def test_compiled_context(spark):
    rows = items(spark, ("a", "Decision", "2026-01-01 — old way", "superseded", None, 0.3), ("b", "Decision", "new way", "active", None, 0.9), ("t", "Task", "do it", "open", None, 0.5), ("z", "Goal", "tiny", "open", None, 0.001))
    got = context.compiled(rows, edges_of(spark, ("b", "a", "SUPERSEDES", 1.0)), "small")
    assert got.text == "Decision (current): new way\nHistory: old way → (current)\n\nTask [open]: do it"
    assert got.included == ["b", "a", "t"] and got.used <= 800
    assert context.access_events(got, spark, T0).count() == 3
    assert context.weighted(rows, "nobody").collect() == rows.collect()


def test_ingest_is_idempotent(spark):
    edits = spark.createDataFrame([("s", "p1", at(0), 0), ("s", "p1", at(0), 1), ("s", "p2", at(5), 2), ("s", "p3", at(90), 3), (None, "p4", None, 4)], "source string, path string, ts timestamp, pos long").withColumn("file", F.lit(None).cast("string"))
    empty = log(spark)
    fresh = ingest.new_touches(edits, empty)
    assert fresh.count() == 4
    known = log(spark, *[{"type": "FileTouched", "source": r.source, "path": r.path, "ts": r.ts} for r in fresh.collect()])
    assert ingest.new_touches(edits, known).count() == 0
    pairs = ingest.new_co_edits(edits, edges_of(spark))
    assert [(r["from"], r["to"]) for r in pairs.collect()] == [("file:p1", "file:p2")]
    assert ingest.new_co_edits(edits, edges_of(spark, ("file:p2", "file:p1", "CO_EDITED", 0.6))).count() == 0


def test_co_edits_take_the_first_ten_files(spark):
    rows = spark.createDataFrame([(1, f"f{i:02d}", i) for i in range(15)], "s long, f string, pos long")
    assert graph.co_edits(rows, "s", "f", "pos").count() == 45


def test_timeline_order_and_nearest(spark):
    rows = spark.createDataFrame([(0, at(1), "code_edit", None, "b"), (1, at(1), "message", "assistant", "a"), (2, at(1), "message", "user", "z"), (3, None, "checkpoint", None, "a")], "pos long, ts timestamp, kind string, role string, source string")
    assert [r.pos for r in timeline.page(rows, timeline.order_keys(), 9).collect()] == [3, 2, 1, 0]
    left = spark.createDataFrame([(1, "p", at(0)), (2, "q", at(0))], "id long, path string, ts timestamp")
    right = spark.createDataFrame([(7, "p", at(1)), (8, "p", at(-1)), (9, "p", at(3)), (5, "q", at(9))], "id long, path string, ts timestamp")
    assert [tuple(r) for r in timeline.nearest(left, right, "path", 120).collect()] == [(1, 7, 60.0)]


def test_sessions_break_after_more_than_the_gap(spark):
    rows = spark.createDataFrame([(i, "u", at(m)) for i, m in enumerate((0, 30, 61, 1500))], "pos long, k string, ts timestamp")
    assert [r.session_no for r in timeline.gap_sessions(rows, ["k"]).orderBy("pos").collect()] == [0, 0, 1, 2]
    assert [r.session_no for r in timeline.global_sessions(rows).orderBy("pos").collect()] == [0, 0, 1, 2]


def test_stats_of_nothing(spark):
    none = spark.createDataFrame([], "status string")
    assert tuple(stats.decision_stats(none).first()) == (0, 0, 0, 0, 0, 0.0)
    assert tuple(stats.failure_stats(none).first()) == (0, 0, 0)


def test_fill_goes_on_behind_the_first_items(spark):
    d = spark.createDataFrame([(i, 7, float(100 - i)) for i in range(30)] + [(90, 3, 0.5), (91, 3, 0.4)], "id long, cost long, score double")
    row = context.fill(d, 10).first()
    assert (row["ids"], row["used"], row["dropped"]) == ([0, 90], 10, 30)


def test_only_present_items_make_chains(spark):
    edges = edges_of(spark, ("c", "b", "SUPERSEDES", 1.0), ("b", "a", "SUPERSEDES", 1.0))
    three = [(i, "Decision", t, "active", None, 0.5) for i, t in (("a", "old"), ("b", "mid"), ("c", "new"))]
    assert {r.id: r.history for r in context.collapsed(items(spark, *three[:2]), edges).collect()} == {"b": ["old"]}
    assert {r.id: r.history for r in context.collapsed(items(spark, three[0], three[2]), edges).collect()} == {"a": None, "c": None}
    assert {r.id: r.history for r in context.collapsed(items(spark, *three), edges).collect()} == {"c": ["old", "mid"]}


def test_long_chains_are_whole(spark):
    rows = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "SUPERSEDES", i) for i in range(130)], "`from` string, `to` string, relation string, pos int")
    (r,) = graph.chains(rows).collect()
    assert (r.head, len(r.chain), r.chain[-1]) == ("n0", 131, "n130")


def test_one_long_block_is_cut(spark):
    rows = items(spark, ("a", "Goal", "w" * 5000, "open", None, 0.9), ("b", "Goal", "x", "open", None, 0.8))
    got = context.compiled(rows.withColumn("text", F.col("text")), None, "tiny")
    assert len(got.text) <= 800 and got.included[0] == "a"


def memory(spark, *rows):
    kind = "id string, type string, text string, kind string, author string, status string, confidence double, importance double, decay_rate double, last_verified timestamp"
    return spark.createDataFrame([(r[0], r[1], r[2], None, r[3], "active", 0.8, 1.0, 0.01, None) for r in rows], kind)


def test_retriever(spark):
    from quillgraph.operators import retrieve

    nodes = memory(spark, ("a", "Decision", "use postgres for storage", "Codex"), ("b", "Goal", "fast storage", None), ("c", "File", "src/storage/db.js", "Cursor"), ("d", "Goal", "unrelated thing", "Codex"))
    edges = edges_of(spark, ("a", "d", "SERVES", 1.0), ("d", "ghost", "SERVES", 1.0)).withColumn("valid_to", F.lit(None).cast("timestamp"))
    now = F.lit("2026-01-01").cast("timestamp")
    got = {r.id: r for r in retrieve.retrieve(nodes, edges, "postgres storage", now).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["a"].seed and got["a"].depth == 0
    assert (got["d"].seed, got["d"].depth, got["d"].path, got["d"].relation) == (False, 1, ["a", "d"], "SERVES")
    assert [r.id for r in retrieve.retrieve(nodes, edges, "postgres storage", now).collect()][0] == "a"
    assert {r.id for r in retrieve.retrieve(nodes, edges, "", now, agent="Codex").collect()} == {"a", "b", "d"}
    assert all(r.components.relevance == 1.0 for r in retrieve.retrieve(nodes, edges.limit(0), "", now).collect())
    assert retrieve.retrieve(nodes.limit(0), edges, "postgres", now).count() == 0
    assert {r.id for r in retrieve.retrieve(nodes, edges, "zzz", now).collect()} == set()


def test_groups_are_filled_as_if_every_item_were_tried(spark):
    import random

    draw = random.Random(5)
    rows = [(g, i, draw.choice((0, 1, 2, 3, 7, 19, 50, None)), draw.choice((0.1, 0.2, 0.3, None))) for g in ("a", "b", None) for i in range(300)]
    rows += [("long", 1, 90, 1.0), ("long", 2, 1, 0.5), ("none", 1, None, 1.0), ("tail", 1, None, 2.0), ("tail", 2, 90, 1.0), ("tail", 3, 4, 0.0)]
    got = {r.g: r for r in context.fill(spark.createDataFrame(rows, "g string, id long, cost long, score double"), 40, by="g").collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[3] is None, -(r[3] or 0), r[1]))
        used, ids = 0, []
        if mine[0][2] is not None and mine[0][2] > 40:
            used, ids = 40, [mine[0][1]]
        else:
            for _, i, cost, _ in mine:
                if cost is not None and used + cost <= 40:
                    used, ids = used + cost, [*ids, i]
        assert (got[g].used, got[g].ids, got[g].dropped) == (used, ids, len(mine) - len(ids))
    assert context.fill(spark.createDataFrame([], "g string, id long, cost long, score double"), 40, by="g").count() == 0


def test_ids_of_a_node_begin_with_its_creation(spark):
    events = log(spark, {"id": "e0", "type": "NodeAccessed", "nodeId": "d"}, {"id": "e1", "type": "DecisionCreated", "nodeId": "d", "text": "x"}, {"id": "e2", "type": "DecisionResolved", "nodeId": "d"})
    assert [(r.id, r.source_ids) for r in fold.nodes(events).collect()] == [("d", ["e1", "e2"])]


def test_sessions_of_all_rows_across_bins_and_without_times(spark):
    import datetime as dt

    from quillgraph.operators import timeline

    begin, gaps = dt.datetime(2024, 1, 1), [0, 50, 3000, 10, 4000, 5, 7200, 601, 600, 1, 99999]
    at, rows = begin, [(None, -1)]
    for i, gap in enumerate(gaps):
        at += dt.timedelta(seconds=gap)
        rows.append((at, i))
    got = {r.pos: r.session_no for r in timeline.global_sessions(spark.createDataFrame(rows, "ts timestamp, pos int"), 600).collect()}
    want, n = {-1: None}, 0
    for i, gap in enumerate(gaps):
        n += gap > 600
        want[i] = n
    assert got == want


def test_co_edits_are_dealt_into_parts_by_their_number(spark, monkeypatch):
    """With the number of touches known, parts grow with it and no stage makes keys distinct before they are dealt; pairs are the same."""
    import random

    draw = random.Random(3)
    rows = [(draw.choice((1, 2, 3, i)), draw.randint(0, 60), draw.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "s int, f int, pos int")
    monkeypatch.setattr(graph, "ROWS_A_TASK", 250)
    found = graph.co_edits(df, "s", "f", "pos", rows=3000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(dealt) == 3 and all(", 12), REPARTITION_BY_NUM" in line for line in dealt)
    want = graph.co_edits(df, "s", "f", "pos").select("from", "to").collect()
    assert sorted(map(tuple, found.select("from", "to").collect())) == sorted(map(tuple, want)) and len(want) > 45
