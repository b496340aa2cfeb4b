"""Associative folds, keyed stream state, versioned tables and the kept index, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import fold, pieces, postings, rank, tables
from quillgraph.streaming import state
from tests.test_graph import at, log, made

KINDS = ("error", "purchase", "signup", "click", "view")


def rows_of(seed, n, keys, untimed=False):
    rng = random.Random(seed)
    begin = dt.datetime(2024, 1, 1)
    return [(rng.choice(keys), None if untimed and rng.random() < 0.2 else begin + dt.timedelta(minutes=rng.choice((0, rng.randrange(20_000)))), i, rng.choice(KINDS)) for i in range(n)]


def folded(rows):
    out = {}
    for key in {r[0] for r in rows}:
        c, n, last = 0.6, 0, None
        for _, _, _, kind in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] or dt.datetime(1970, 1, 1), r[2])):
            c = {"error": c * 0.2, "purchase": min(1.0, c + 0.1), "signup": 0.85}.get(kind, c)
            n, last = n + (kind == "click"), kind if kind in ("error", "signup") else last
        out[key] = (round(c, 9), n, last)
    return out


@pytest.mark.parametrize(("hours", "block"), ((1, 1 << 16), (24, 3), (10_000, 1)))
def test_pieces_fold_as_one_run(spark, hours, block):
    """Half of all events are of one key; whatever the pieces and partitions, the fold is that of the events in order."""
    rows = rows_of(5, 600, ["hot"] * 5 + list("abcde"), untimed=True)
    kind = F.col("kind")
    step = F.when(kind == "error", pieces.mapped(0.2)).when(kind == "purchase", pieces.mapped(1.0, 0.1, 1.0)).when(kind == "signup", pieces.set_to(0.85))
    own = kind.isin("error", "signup")
    df = spark.createDataFrame(rows + [(None, None, -1, "error")], "k string, ts timestamp, pos long, kind string").repartition(7)
    got = pieces.fold(df, "k", "ts", "pos", [pieces.count("clicks", kind == "click"), pieces.last("last", kind, own)], step, hours, block)
    assert {r.k: (round(min(r.step.cap, r.step.times * 0.6 + r.step.plus), 9), r.clicks, r.last.value if r.last else None) for r in got.collect()} == folded(rows)
    assert pieces.fold(df.limit(0), "k", "ts", "pos", [pieces.count("n", F.lit(True))], step).count() == 0


def test_a_busy_node_is_in_many_tasks(spark):
    """The events of one node that are held against its birth, and the pieces they are folded in, lie in several partitions."""
    events = log(spark, made("a", "x", 0), *[{"type": "DecisionOutcomeObserved", "nodeId": "a", "outcome": "confirmed", "ts": at(i)} for i in range(1, 400)])
    found = fold.keyed(events)
    born = found.where("type = 'DecisionCreated'").select("node", F.struct("at", "pos").alias("birth"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        since = fold._since_birth(found.select("node", "at", "pos"), born)
        assert since.count() == 400 and since.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    (row,) = fold.nodes(events).collect()
    assert row.confidence == 1.0 and len(row.source_ids) == 400


def plain_nodes(events):
    """The same rules an event at a time."""
    out = {}
    for pos, e in sorted(enumerate(events), key=lambda x: (x[1].get("ts") or dt.datetime(1970, 1, 1), x[0])):
        kind, key = e["type"], e.get("nodeId")
        creates = kind in fold.CREATES
        if kind not in (*fold.CREATES, *fold.CHANGES) or not (creates or key in out):
            continue
        n = out.setdefault(key, {"type": fold.CREATES.get(kind), "text": "", "status": None, "confidence": 0.6, "accesses": 0, "author": e.get("source"), "branch": None, "ids": []})
        n["ids"].append(f"e{pos}")
        if creates:
            n["text"] = e.get("text") or n["text"]
        if kind in ("TaskCreated", "GoalCreated", "DecisionCreated"):
            n["branch"] = n["branch"] or e.get("branch")
        if kind == "GoalCreated":
            n["status"] = n["status"] or "open"
        elif kind in ("TaskCreated", "DecisionCreated"):
            n["status"] = e.get("status") or ("open" if kind[0] == "T" else "active")
        elif kind == "TaskStatusChanged":
            n["status"] = e.get("status") or n["status"]
        elif kind == "DecisionResolved":
            n["status"] = "resolved"
        elif kind == "NodeAccessed":
            n["accesses"] += 1
        if kind == "DecisionCreated":
            n["confidence"] = e.get("confidence") or {"user": 0.95}.get(e.get("source"), 0.6)
        elif kind == "DecisionSuperseded" or (kind == "DecisionOutcomeObserved" and e["outcome"] == "reverted"):
            n["confidence"], n["status"] = n["confidence"] * 0.2, "superseded"
        elif kind == "DecisionOutcomeObserved":
            n["confidence"] = min(1.0, n["confidence"] + 0.1)
    return {k: (n["type"], n["text"], n["status"], round(n["confidence"], 9), n["accesses"], n["author"], n["branch"], n["ids"]) for k, n in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_nodes_of_random_logs(spark, seed):
    rng = random.Random(seed)
    kinds = ("TaskCreated", "GoalCreated", "DecisionCreated", "TaskStatusChanged", "DecisionResolved", "DecisionSuperseded", "DecisionOutcomeObserved", "NodeAccessed", "Unknown")
    events = [
        {"type": rng.choice(kinds), "nodeId": rng.choice("aaaabcdef"), "text": rng.choice((None, "", "x", "y")), "status": rng.choice((None, "open", "done")), "source": rng.choice((None, "user", "agent")),
         "branch": rng.choice((None, "m", "n")), "outcome": rng.choice(("confirmed", "reverted")), "confidence": rng.choice((None, None, 0.4)), "ts": rng.choice((None, at(rng.randrange(300))))}
        for _ in range(150)
    ]
    events = [e if e["type"] == "DecisionCreated" else e | {"confidence": None} for e in events]
    df = log(spark, *events, partitions=5)
    got = {r.id: (r.type, r.text, r.status, round(r.confidence, 9), r.access_count, r.author, r.branch, r.source_ids) for r in fold.nodes(df).collect()}
    assert got == plain_nodes(events)
    assert sorted((r.node, r.event_id) for r in fold.sources(df).collect()) == sorted((k, i) for k, v in got.items() for i in v[-1])
    assert "source_ids" not in fold.nodes(df, listed=False).columns


# --- keyed stream state --------------------------------------------------------------------------------------------


def _trail(s, e):
    return {"trail": s["trail"] + e["kind"], "n": s["n"] + 1}


def test_stream_state_settles_restarts_and_reads_back(spark, tmp_path):
    root, day = f"file://{tmp_path}", lambda d, h=0: dt.datetime(2024, 1, d, h)
    own, schema = state.session(spark), "n long, k string, ts timestamp, kind string"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{root}/source")
        stream = own.readStream.schema(schema).parquet(f"{root}/source")
        state.follow(state.settled_state(stream, "k", "ts", "n", "kind string", "trail string, n long", {"trail": "", "n": 0}, _trail), root)
        return {r.k: (r.trail, r.n) for r in state.shown(spark, root, "k").collect()}

    assert run((1, "a", day(1), "x"), (3, "a", day(3), "z"), (2, "a", day(2), "y"), (9, "b", day(1), "q"), (0, None, day(1), "!"), (0, "c", None, "!")) == {"a": ("xyz", 3), "b": ("q", 1)}
    # within a day of the newest event: put in its place; older than that: left out
    assert run((4, "a", day(2, 12), "m"), (5, "a", day(1, 1), "late")) == {"a": ("xymz", 4), "b": ("q", 1)}
    assert run((6, "b", day(9), "r"))["b"] == ("qr", 2)
    settled = {r.key.k: (r.value.trail, r.value.n) for r in state.kept(spark, root, "settled").collect()}
    assert settled == {"a": ("xymz", 4), "b": ("q", 1)}
    assert [(r.key.k, r.list_element.kind) for r in state.kept(spark, root, "pending").collect()] == [("b", "r")]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != state.STORE


# --- versioned tables ----------------------------------------------------------------------------------------------

CACHE = "id long, hash string, at long"


def contents(spark, root, number=None):
    return {r.id: r.hash for r in tables.read(spark, root, CACHE, number).collect()}


def test_upserts_switch_whole_and_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    put = lambda batch, *rows: tables.upsert(spark.createDataFrame(list(rows), CACHE), "id", root, batch, "at", buckets=4)
    assert contents(spark, root) == {} and tables.version(spark, root).number == 0
    first = put(0, *[(i, "old", 0) for i in range(40)], (None, "lost", 0))
    second = put(1, (3, "new", 1), (3, "newer", 2), (3, "older", 0), (99, "new", 1))
    want = {i: "old" for i in range(40)} | {3: "newer", 99: "new"}
    assert contents(spark, root) == want and second.number == 2
    assert 0 < sum(first.folders[b] != f for b, f in second.folders.items()) <= 2  # only the folders of 3 and 99
    assert put(1, (5, "again", 9)).number == 2 and contents(spark, root) == want  # a batch that comes again
    assert contents(spark, root, 1) == {i: "old" for i in range(40)}  # old versions stay
    with pytest.raises(ValueError):
        tables.read(spark, root, CACHE, 7)

    def broken(*a, **b):
        raise OSError("lost")

    with monkeypatch.context() as m:  # fails after its data is written, before the switch
        m.setattr(type(spark), "createDataFrame", broken)
        rows = tables.read(spark, root, CACHE).where("id = 5").withColumn("hash", F.lit("failed"))
        with pytest.raises(OSError):
            tables.upsert(rows, "id", root, 2, "at", buckets=4)
    assert contents(spark, root) == want
    assert put(2, (5, "tried again", 3)).number == 3 and contents(spark, root) == want | {5: "tried again"}


# --- kept index ----------------------------------------------------------------------------------------------------


def test_index_in_segments_equals_scoring_everything(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(1, 40)))) for i in range(400)] + [(400, None), (401, ""), (402, "W1 w1, w1!"), (403, "w1 w1 w1")]
    df = spark.createDataFrame(docs, "id long, text string")
    asked = [(1, "w1 w2"), (2, "w55 w3 w3"), (3, None), (4, "nothing here"), (5, "w40"), (6, " ".join(vocabulary[::8]))]
    queries = spark.createDataFrame(asked, "query long, text string")
    roots = [f"file://{tmp_path}/{n}" for n in ("one", "three")]
    postings.add(df, roots[0], 0, per_block=16, folders=3)
    for batch, part in enumerate(("id % 3 = 0", "id % 3 = 1", "id % 3 = 2")):
        for _ in range(2):  # a batch that is added again changes nothing
            postings.add(df.where(part), roots[1], batch, per_block=8, folders=3)
    want = {}
    for q, text in asked:
        if text:
            scored = sorted(((-r.bm25, r.id) for r in rank.bm25(df, text).where("bm25 > 0").collect()))[:10]
            want |= {(q, n): (i, round(-s, 9)) for n, (s, i) in enumerate(scored, 1)}
    for root in roots:
        got = {(r.query, r["rank"]): (r.id, round(r.bm25, 9)) for r in postings.search(queries, root, 10, folders=3, first=1).collect()}
        assert got == want
    assert postings.search(queries.limit(0), roots[0], 5, folders=3).count() == 0
    postings.add(df.limit(0), f"file://{tmp_path}/none", 0)
    assert postings.search(queries, f"file://{tmp_path}/none", 5).count() == 0


def test_postings_are_scored_within_their_block(spark, tmp_path, monkeypatch):
    """No row for each query, term and document is made: a block gives its best rows for each query."""
    docs = spark.createDataFrame([(i, "a b " + "c " * (i % 7)) for i in range(60)], "id long, text string")
    root, plans, staged = f"file://{tmp_path}/index", {}, postings.staged
    postings.add(docs, root, 0, per_block=8)
    monkeypatch.setattr(postings, "staged", lambda df, label: (plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()), staged(df, label))[1])
    got = postings.search(spark.createDataFrame([(1, "c b c"), (2, "zzz")], "query long, text string"), root, 4, first=1)
    assert [(r.query, r.id % 7) for r in got.collect()] == [(1, 6)] * 4
    assert "Generate" not in plans["best"]


def test_state_session_has_no_more_parts_than_cores(spark):
    own = state.session(spark)
    assert int(own.conf.get("spark.sql.shuffle.partitions")) <= max(2, spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        assert int(state.session(spark).conf.get("spark.sql.shuffle.partitions")) <= max(2, spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
