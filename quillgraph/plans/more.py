"""More registered queries: the assembled retriever, context items, sinks, ingest, readers, briefs."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import brief, context, documents, fold, graph, history, ingest, open_sessions, postings, rank, retrieve, sinks, stats, tables, timeline
from ..operators.staging import shared_folder
from ..sources import notes, transcripts
from ..streaming import sessions, state
from . import constants as C
from .constants import EVENT_DDL
from .catalogue import _BM25, _FOLD, _R3, _R6, _TIMELINE, _TOKENS, NOW, QUERY, _folded, _t, _timeline, registered

_NODES = """lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
nodes AS (SELECT d.doc_id AS id, CASE WHEN d.doc_id % 3 = 0 THEN 'Decision' ELSE 'Goal' END AS type, d.source AS author, CASE WHEN quality = 0 THEN 'superseded' ELSE 'active' END AS status,
    CASE WHEN quality = 0 THEN 0.17::DOUBLE ELSE 0.85::DOUBLE END AS confidence, 1.0::DOUBLE + (d.doc_id % 4) * 0.1::DOUBLE AS importance, d.doc_id % 30 AS age FROM documents d LEFT JOIN lab USING (doc_id)),
links AS (SELECT doc_id AS "from", doc_id // 7 AS "to" FROM documents WHERE doc_id >= 7)"""


def _nodes(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lab = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False))
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "Decision").otherwise("Goal").alias("type"), "text", F.lit(None).cast("string").alias("kind"), F.col("source").alias("author"),
        F.when(bad, "superseded").otherwise("active").alias("status"), F.when(bad, 0.17).otherwise(0.85).alias("confidence"), (1.0 + (F.col("doc_id") % 4) * 0.1).alias("importance"), F.lit(0.01).alias("decay_rate"),
        F.timestamp_micros(F.unix_micros(F.lit(NOW).cast("timestamp")) - (F.col("doc_id") % 30) * 86_400_000_000).alias("last_verified"),
    )


def _links(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("doc_id >= 7")
    return d.select(F.col("doc_id").alias("from"), F.floor(F.col("doc_id") / 7).cast("long").alias("to"), F.lit("SERVES").alias("relation"), F.lit(0.5).alias("weight"), F.lit(None).cast("timestamp").alias("valid_to"))


@registered(f"""WITH {_NODES}, {_BM25}, m AS (SELECT max(bm25) AS top FROM b),
r AS (SELECT author, (count(*) - count(*) FILTER (status = 'superseded') + 1)::DOUBLE / (count(*) + 2) AS reputation FROM nodes WHERE type = 'Decision' AND author <> '' GROUP BY author),
f AS (SELECT id, bm25 / greatest(top, 1e-9) * (len(list_intersect(['the', 'that', 'of'], tok)) / 3.0::DOUBLE) AS rel, {_R3.format("confidence")} AS c, {_R3.format("importance")} AS i, {_R3.format("exp(-0.01::DOUBLE * age)")} AS fr,
    {_R3.format("(CASE WHEN type = 'Decision' THEN coalesce(reputation, 1.0::DOUBLE) ELSE 1.0::DOUBLE END)")} AS rp FROM nodes JOIN b ON doc_id = id CROSS JOIN m LEFT JOIN r USING (author)),
seeds AS (SELECT id, rel AS v FROM f WHERE rel > 0 ORDER BY {_R3.format("rel")} * c * i * fr * rp DESC, id LIMIT 8),
adj AS (SELECT "from" AS a, "to" AS b FROM links UNION ALL SELECT "to", "from" FROM links),
h1 AS (SELECT b AS id, max(v * 0.5::DOUBLE * 0.6::DOUBLE) AS v FROM seeds JOIN adj ON a = id GROUP BY b), f1 AS (SELECT h1.* FROM h1 LEFT JOIN seeds s USING (id) WHERE s.v IS NULL OR h1.v > s.v),
b1 AS (SELECT * FROM f1 UNION ALL SELECT * FROM seeds WHERE id NOT IN (SELECT id FROM f1)),
h2 AS (SELECT b AS id, max(v * 0.5::DOUBLE * 0.36::DOUBLE) AS v FROM f1 JOIN adj ON a = id GROUP BY b), f2 AS (SELECT h2.* FROM h2 LEFT JOIN b1 USING (id) WHERE b1.v IS NULL OR h2.v > b1.v),
z AS (SELECT id, v, 2 AS depth FROM f2 UNION ALL SELECT id, v, CASE WHEN id IN (SELECT id FROM f1) THEN 1 ELSE 0 END FROM b1 WHERE id NOT IN (SELECT id FROM f2))
SELECT id, {_R3.format(_R3.format("v") + " * c * i * fr * rp")} AS score, depth = 0 AS seed, depth, {_R3.format("v")} AS relevance FROM z JOIN f USING (id)""")
def retrieve_ranked(spark, sf_dir):
    """Relevance, seeds, two hops and final scores: the retriever as a whole."""
    got = retrieve.retrieve(_nodes(spark, sf_dir), _links(spark, sf_dir), QUERY, F.lit(NOW).cast("timestamp"))
    return got.select("id", "score", "seed", "depth", F.col("components.relevance").alias("relevance"))


_ORDERS = """o AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER w AS old, lead(o_orderkey) OVER w AS newer FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


@registered(f"""WITH RECURSIVE {_ORDERS}, p AS (SELECT * FROM o WHERE id % 3 <> 0),
w AS (SELECT id AS head, []::BIGINT[] AS olds, old FROM p WHERE newer IS NULL OR newer % 3 = 0 UNION ALL SELECT head, list_prepend(p.id, olds), p.old FROM w JOIN p ON p.id = w.old)
SELECT head::VARCHAR AS id, array_to_string(arg_max(olds, len(olds)), '>') AS history FROM w GROUP BY head""")
def collapse_present(spark, sf_dir):
    """Chains among the items that are there: an order in three is absent, and parts its customer's chain."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("from"), F.lag("o_orderkey").over(w).cast("string").alias("to"), F.lit("SUPERSEDES").alias("relation"), F.lit(0).alias("pos"))
    items = _t(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").cast("string").alias("text"))
    return context.collapsed(items, o.where("`to` is not null")).select("id", F.coalesce(F.array_join("absorbed", ">"), F.lit("")).alias("history"))


@registered("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' OR o_orderdate::TIMESTAMP > TIMESTAMP '1997-01-01 00:00:00'""")
def current_edges(spark, sf_dir):
    e = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp")).alias("valid_to"))
    return graph.current(e, F.lit("1997-01-01").cast("timestamp")).select("id")


@registered(f"""WITH {_TIMELINE}, e AS (SELECT DISTINCT source, path, ts FROM t WHERE kind = 'code_edit'), l AS (SELECT DISTINCT source, path, ts FROM t WHERE kind = 'code_edit' AND pos % 2 = 0)
SELECT source, path, ts FROM e EXCEPT SELECT source, path, ts FROM l""")
def new_touches(spark, sf_dir):
    t = _timeline(spark, sf_dir).where("kind = 'code_edit'").withColumn("file", F.lit(None).cast("string"))
    return ingest.new_touches(t, t.where("pos % 2 = 0").withColumn("type", F.lit("FileTouched"))).select("source", "path", "ts")


@registered(f"WITH {_NODES} SELECT 'total' AS section, 'nodes' AS key, count(*) AS n FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM links UNION ALL SELECT 'nodes', type, count(*) FROM nodes GROUP BY type "
            "UNION ALL SELECT 'edges', 'SERVES', count(*) FROM links HAVING count(*) > 0 UNION ALL SELECT lower(type), status, count(*) FROM nodes WHERE type = 'Decision' GROUP BY type, status")
def graph_report(spark, sf_dir):
    """Written as a state of the graph, read back, and counted."""
    root = f"{shared_folder(spark)}/quillgraph/graph-{uuid.uuid4().hex}"
    sinks.rebuild(_nodes(spark, sf_dir), _links(spark, sf_dir), root)
    return sinks.report(sinks.current(spark, root, "nodes"), sinks.current(spark, root, "edges"))


@registered(f"""WITH {_TIMELINE}, k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, source DESC, pos DESC) AS rn FROM t WHERE kind IN ('code_edit', 'artifact'))
SELECT pos, kind FROM k WHERE (kind = 'code_edit' AND rn <= 5) OR (kind = 'artifact' AND rn <= 3)""")
def brief_recent(spark, sf_dir):
    return brief.recent(_timeline(spark, sf_dir)).select("pos", "kind")


@registered(f"WITH {_TIMELINE} SELECT pos, kind FROM t WHERE kind = 'checkpoint' ORDER BY ts DESC, source DESC, pos DESC LIMIT 1")
def brief_checkpoint(spark, sf_dir):
    return brief.last_checkpoint(_timeline(spark, sf_dir)).select("pos", "kind")


@registered("SELECT conv_id, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, ''), ' \t\n\r') <> '' GROUP BY conv_id")
def read_transcripts(spark, sf_dir):
    """Conversations written as transcripts of one vendor, a file per writing task, and read back by its reader."""
    root = f"{shared_folder(spark)}/quillgraph/transcripts-{uuid.uuid4().hex}"
    c = _t(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    message = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("2024-01-01T00:00:00Z")).alias("timestamp"), F.struct("role", F.concat(F.col("conv_id").cast("string"), F.lit("|"), "text").alias("content")).alias("message")))
    c.where("text is not null").select(message.alias("value")).write.text(root)
    got = transcripts.claude(transcripts.read_lines(spark, root, "*.txt")).where("kind = 'message'")
    got = got.withColumn("conv_id", F.element_at(F.split("content", r"\|", 2), 1).cast("long")).where(X.strip(F.element_at(F.split("content", r"\|", 2), 2)) != "")
    said = lambda r: F.count(F.when(F.col("role") == r, 1))
    return got.groupBy("conv_id").agg(said("user").alias("user_messages"), said("assistant").alias("assistant_messages"))


@registered("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0 AND coalesce(text, '') <> ''")
def stale_vectors(spark, sf_dir):
    """Which nodes an incremental embedding run has to do: those new to the cache, and those whose text has changed since."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    cache = d.where("id % 3 = 0").select("id", F.sha1(F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.coalesce("text", F.lit("")))).alias("hash"))
    return brief.stale_texts(d, cache).select(F.col("id").alias("doc_id"))


@registered("SELECT o_orderkey, o_orderdate::TIMESTAMP + to_microseconds((floor(86400000.0::DOUBLE * (o_orderkey % 10) / 10) * 1000)::BIGINT) AS at FROM orders")
def interpolated_times(spark, sf_dir):
    start = F.col("o_orderdate").cast("timestamp")
    return _t(spark, sf_dir, "orders").select("o_orderkey", timeline.interpolated(start, start + F.expr("interval 1 day"), F.col("o_orderkey") % 10).alias("at"))


@registered("SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9]', '-', 'g') AS slug FROM pages WHERE url = 'https://example.com' OR starts_with(url, 'https://')")
def discovered_paths(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").where(notes.under(F.col("url"), "https://example.com") | F.col("url").startswith("https://"))
    return p.select("page_id", notes.slug(F.col("url")).alias("slug"))


_TALK = """t AS (SELECT conv_id, turn, role, CASE WHEN turn % 5 = 3 THEN 'code_edit' ELSE 'message' END AS kind, CASE WHEN turn % 7 = 0 THEN '' ELSE text END AS content,
    CASE WHEN turn % 2 = 0 THEN 'f' || turn::VARCHAR END AS file, CASE WHEN turn % 3 = 0 THEN 's' || turn::VARCHAR END AS summary FROM conversations)"""


def _talk(spark, sf_dir):
    turn = F.col("turn").cast("string")
    return _t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.when(F.col("turn") % 5 == 3, "code_edit").otherwise("message").alias("kind"), F.when(F.col("turn") % 7 == 0, "").otherwise(F.col("text")).alias("content"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("f"), turn)).alias("file"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("s"), turn)).alias("summary"),
    )


@registered(f"""WITH {_TALK}, s AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS segment FROM t),
g AS (SELECT conv_id, segment, (list(struct_pack(c := content) ORDER BY turn) FILTER (kind = 'message' AND role = 'user'))[1].c AS said,
    (list(struct_pack(c := coalesce(nullif(file, ''), nullif(summary, ''), 'Code edit')) ORDER BY turn) FILTER (kind = 'code_edit'))[1].c AS named, (list(content ORDER BY turn) FILTER (content <> ''))[1] AS other FROM s GROUP BY ALL)
SELECT conv_id, segment::BIGINT AS segment, coalesce(regexp_replace(left(nullif(said, ''), 72), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), named, regexp_replace(left(other, 72), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), 'Activity') AS label FROM g""")
def segment_labels(spark, sf_dir):
    s = timeline.segments(_talk(spark, sf_dir), ["conv_id"], ["turn"])
    return s.groupBy("conv_id", "segment").agg(timeline.segment_label("turn").alias("label"))


@registered("""WITH p AS (SELECT page_id, coalesce(url, '') || list_extract(['/A.LOCK', '/pic.svg', '/package.json', '/data.json', '/main.py', '/x.snap'], (page_id % 6 + 1)::INT) AS path FROM pages)
SELECT page_id FROM p WHERE NOT (NOT contains(lower(path), 'package.json') AND (contains(lower(path), 'lock') OR contains(lower(path), '.svg') OR contains(lower(path), '.png') OR contains(lower(path), '.snap') OR contains(lower(path), '.json')))""")
def files_without_noise(spark, sf_dir):
    ends = F.array(*map(F.lit, ("/A.LOCK", "/pic.svg", "/package.json", "/data.json", "/main.py", "/x.snap")))
    p = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("url", F.lit("")), F.element_at(ends, (F.col("page_id") % 6 + 1).cast("int"))).alias("path"))
    return p.where(~X.is_noise(F.col("path"))).select("page_id")


@registered(f"""WITH {_BM25}, g AS (SELECT source AS query, row_number() OVER (PARTITION BY source ORDER BY bm25 DESC, doc_id) AS rank, quality = 1 AS relevant FROM b JOIN documents USING (doc_id) JOIN labels USING (doc_id)),
a AS (SELECT query, count(*) AS n, sum((relevant AND rank <= 5)::INT) AS h5, sum((relevant AND rank <= 10)::INT) AS h10, sum(relevant::INT) AS rel FROM g GROUP BY query)
SELECT query, {_R6.format("(CASE WHEN rel > 0 THEN h5::DOUBLE / rel ELSE 0 END)")} AS recall_5, {_R6.format("(CASE WHEN rel > 0 THEN h10::DOUBLE / rel ELSE 0 END)")} AS recall_10,
    {_R6.format("(h5::DOUBLE / least(5, n))")} AS precision_5, {_R6.format("(h10::DOUBLE / least(10, n))")} AS precision_10 FROM a""")
def bench_at_depths(spark, sf_dir):
    s = rank.bm25(_t(spark, sf_dir, "documents").select("doc_id", "text", "source"), QUERY).join(_t(spark, sf_dir, "labels"), "doc_id")
    r = s.select(F.col("source").alias("query"), F.col("bm25").alias("score"), F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("relevant"))
    return stats.scored_quality(r, 5, 10).select("query", *[X.round6(F.col(c)).alias(c) for c in ("recall_5", "recall_10", "precision_5", "precision_10")])


def _id(prefix: str, text: str) -> str:
    return f"'{prefix}:' || left(sha1(lower(trim({text}))), 12)"


def _part_notes(spark, sf_dir):
    """A note for each part: a goal with what it serves and its evidence below it, an open box, and a failure."""
    p = _t(spark, sf_dir, "part").where("p_name is not null")
    note = F.concat(F.lit("## Goals\n- "), "p_name", F.lit("\n  - Serves: "), "p_brand", F.lit("\n  - Evidence: "), "p_type", F.lit("\n\n## Open\n- [ ] "), "p_type", F.lit(" or "), "p_brand")
    return notes.note_lines(p.select(F.col("p_partkey").cast("string").alias("path"), note.alias("value")))


def _even(spark, sf_dir, prefix: str, column: str):
    return _t(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(X.stable_id(prefix, F.col(column)).alias("id")).distinct()


@registered(f"""WITH e AS (SELECT * FROM part WHERE p_partkey % 2 = 0)
(SELECT {_id("decision", "p_name")} AS "from", {_id("goal", "p_brand")} AS "to" FROM part EXCEPT SELECT {_id("decision", "p_name")}, {_id("goal", "p_brand")} FROM e)
UNION ALL SELECT DISTINCT NULL, {_id("goal", "p_brand")} FROM part WHERE {_id("goal", "p_brand")} NOT IN (SELECT {_id("goal", "p_type")} FROM e)""")
def new_serves(spark, sf_dir):
    """Links to goals that the graph lacks, and goals that it lacks (without ``from``)."""
    edges = _t(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(X.stable_id("decision", F.col("p_name")).alias("from"), X.stable_id("goal", F.col("p_brand")).alias("to"), F.lit("SERVES").alias("relation"))
    got = ingest.serves_events(notes.serves(_part_notes(spark, sf_dir)), _even(spark, sf_dir, "goal", "p_type"), edges, "notes")
    return got.select("from", F.coalesce("to", "nodeId").alias("to"))


@registered(f"""SELECT DISTINCT {_id("evidence", "p_type")} AS node, {_id("decision", "p_name")} AS decision FROM part WHERE left(sha1(p_type), 1) >= '8'""")
def new_evidence(spark, sf_dir):
    known = _t(spark, sf_dir, "part").where("left(sha1(p_type), 1) < '8'").select(X.stable_id("evidence", F.col("p_type")).alias("id")).distinct()
    return ingest.evidence_events(notes.evidence(_part_notes(spark, sf_dir)), known, "notes").select(F.col("nodeId").alias("node"), F.col("decisionId").alias("decision"))


@registered(f"""SELECT DISTINCT {_id("goal", "p_name")} AS node, trim(p_name) AS text FROM part WHERE left(sha1(p_name), 1) >= '8'""")
def new_goals(spark, sf_dir):
    known = _t(spark, sf_dir, "part").where("left(sha1(p_name), 1) < '8'").select(X.stable_id("goal", F.col("p_name")).alias("id")).distinct()
    return ingest.goal_events(notes.goals(_part_notes(spark, sf_dir)), known, "notes").select(F.col("nodeId").alias("node"), "text")


@registered(f"""SELECT p_partkey::VARCHAR AS path, {_id("decision", "p_type || ' or ' || p_brand")} AS node, p_type || ' or ' || p_brand AS text FROM part""")
def open_decisions(spark, sf_dir):
    return notes.open_decisions(_part_notes(spark, sf_dir)).select("path", F.col("nodeId").alias("node"), "text")


@registered(f"""SELECT p_partkey::VARCHAR AS path, {_id("task", "p_type || ' or ' || p_brand")} AS node, 'open' AS status FROM part""")
def note_tasks(spark, sf_dir):
    return notes.tasks(_part_notes(spark, sf_dir)).select("path", F.col("nodeId").alias("node"), "status")


@registered("""WITH p AS (SELECT p_partkey, list_extract(['now fixed: ', 'still broken, was fixed: ', 'not yet resolved ', 'prefixed ', 'we decided on ', 'let''s go with '], (p_partkey % 6 + 1)::INT) || p_name || CASE WHEN p_partkey % 4 = 0 THEN '?  ' ELSE '' END AS t FROM part)
SELECT p_partkey, regexp_matches(lower(t), '(^|[^a-z0-9_])(fixed|resolved|patched)([^a-z0-9_]|$)') AND NOT regexp_matches(lower(t), '(^|[^a-z0-9_])(unresolved|not\\s+(yet\\s+)?(fixed|resolved)|still\\s+(broken|unresolved|an?\\s+issue))([^a-z0-9_]|$)') AS self_resolved,
    regexp_matches(lower(t), '(^|[^a-z0-9_])(decided|final|going with|confirmed|let''?s go with)([^a-z0-9_]|$)') AS committed, regexp_matches(t, '\\?\\s*$') OR regexp_matches(lower(t), '(^|[^a-z0-9_])(should we|decide|or )') AS question,
    CASE WHEN len(trim(t)) > 20 THEN left(trim(t), 19) || '…' ELSE trim(t) END AS short FROM p""")
def line_rules(spark, sf_dir):
    heads = F.array(*map(F.lit, ("now fixed: ", "still broken, was fixed: ", "not yet resolved ", "prefixed ", "we decided on ", "let's go with ")))
    t = F.concat(F.element_at(heads, (F.col("p_partkey") % 6 + 1).cast("int")), "p_name", F.when(F.col("p_partkey") % 4 == 0, "?  ").otherwise(""))
    p = _t(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    c = F.col("t")
    return p.select("p_partkey", X.self_resolved(c).alias("self_resolved"), X.committed(c).alias("committed"), brief.is_question(c).alias("question"), X.truncated(c, 20).alias("short"))


@registered("""WITH s AS (SELECT conv_id AS session, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id) AS start FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 <> 0)),
r AS (SELECT conv_id AS session, CASE WHEN role = 'user' THEN coalesce(start, TIMESTAMP '2023-01-01 00:00:00') ELSE TIMESTAMP '2024-02-01 00:00:00' + to_seconds(turn) END AS ts, role FROM conversations LEFT JOIN s ON session = conv_id WHERE role <> 'user' OR conv_id % 3 <> 0)
SELECT session, ts, role, count(*) AS n FROM (SELECT * FROM r UNION ALL SELECT session, start, 'user' FROM s WHERE session IN (SELECT session FROM r GROUP BY session HAVING NOT bool_or(role = 'user'))) GROUP BY ALL""")
def merged_chat_sessions(spark, sf_dir):
    """Questions without times and answers with them: one conversation in three has lost its questions, one in four its start."""
    c = _t(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session")
    asked = c.where("role = 'user' and session % 3 <> 0").select("session", F.lit("2023-01-01").cast("timestamp").alias("ts"), "role")
    answered = c.where("role <> 'user'").select("session", F.timestamp_seconds(F.unix_seconds(F.lit("2024-02-01").cast("timestamp")) + F.col("turn")).alias("ts"), "role")
    starts = c.where("session % 4 <> 0").select("session", F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("session")).alias("start")).distinct()
    return transcripts.merged_sessions(asked, answered, starts).groupBy("session", "ts", "role").agg(F.count("*").alias("n"))


@registered("""WITH i AS (SELECT o_orderkey AS session, 1700000000000 + o_orderkey AS created, CASE WHEN o_orderkey % 2 = 0 THEN 1700000005000 + o_orderkey ELSE 0 END AS started, CASE WHEN o_orderkey % 3 = 0 THEN 1700000100000 + o_orderkey ELSE 0 END AS ended FROM orders WHERE o_orderkey % 5 <> 0),
k AS (SELECT session, CASE WHEN started > 0 THEN started ELSE created END AS b, ended, started FROM i), z AS (SELECT session, b, CASE WHEN ended > 0 THEN ended WHEN started > 0 THEN started ELSE b END AS e FROM k)
SELECT l_orderkey, l_linenumber, epoch_ms((b + floor(greatest(e - b, 1) * l_linenumber / 10.0::DOUBLE))::BIGINT) AS ts FROM lineitem JOIN z ON session = l_orderkey""")
def timed_edits(spark, sf_dir):
    """Edits take their times from an index of sessions; a session in five isn't in it."""
    key = F.col("o_orderkey")
    index = _t(spark, sf_dir, "orders").where(key % 5 != 0).select(
        key.alias("session"), (key + 1700000000000).alias("created"), F.when(key % 2 == 0, key + 1700000005000).otherwise(0).alias("started"), F.when(key % 3 == 0, key + 1700000100000).otherwise(0).alias("ended")
    )
    edits = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("epoch"), F.lit(None).cast("timestamp").alias("ts"))
    return transcripts.timed(edits, index).select(F.col("session").alias("l_orderkey"), F.col("epoch").alias("l_linenumber"), "ts")


@registered("WITH RECURSIVE " + _FOLD.format(events="events"))
def stream_node_state(spark, sf_dir):
    """The same fold in the state store: four runs of the stream, each from the checkpoint of the one before, with events up to a day late."""
    root = f"{shared_folder(spark)}/quillgraph/state-{uuid.uuid4().hex}"
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    week = F.floor((F.unix_seconds("ts") + F.when(F.col("event_id") % 2 == 0, 86_400).otherwise(0)) / (8 * 86_400))
    staged_weeks = events.withColumn("week", week)
    staged_weeks.write.partitionBy("week").parquet(f"{root}/weeks")
    own = state.session(spark)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # what has ripened is applied by the next run, and in what is shown
    for r in spark.read.parquet(f"{root}/weeks").select("week").distinct().orderBy("week").collect():  # five at most
        spark.read.schema(events.schema).parquet(f"{root}/weeks/week={r['week']}").write.mode("append").parquet(f"{root}/source")
        stream = own.readStream.schema(events.schema).parquet(f"{root}/source")
        states = state.settled_state(stream, "user_id", "ts", "event_id", "event_type string", "confidence double, importance double, status string, n long", _START, _next_state, "2 days")
        state.follow(states, root)
    shown = state.shown(spark, root, "user_id")
    return shown.select("user_id", X.round6(F.col("confidence")).alias("confidence"), X.round3(F.col("importance")).alias("importance"), "status", "n")


_START = {"confidence": 0.6, "importance": 1.0, "status": "open", "n": 0}


def _next_state(s, e):
    kind, c = e["event_type"], s["confidence"]
    return {
        "confidence": c * 0.2 if kind == "error" else min(1.0, c + 0.1) if kind == "purchase" else 0.85 if kind == "signup" else c,
        "importance": math.floor((s["importance"] + 0.1) * 1000 + 0.5) / 1000 if kind == "click" else s["importance"],
        "status": {"error": "superseded", "signup": "active"}.get(kind, s["status"]),
        "n": s["n"] + 1,
    }


@registered("WITH RECURSIVE " + _FOLD.format(events="events"))
def stream_fold(spark, sf_dir):
    """The ordered fold as a stream: the log comes in files of its own order, a micro-batch each, and only touched keys are worked out again."""
    root = f"{shared_folder(spark)}/quillgraph/fold-{uuid.uuid4().hex}"
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    events.repartition(3, F.xxhash64("event_id")).write.parquet(f"{root}/source")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/source")
    sessions.run_available(stream, sessions.kept_state(root, F.col("user_id"), _folded), f"{root}/checkpoint")
    return sessions.state_now(spark, root, "user_id")


@registered(f"WITH {_TIMELINE} SELECT DISTINCT source, path, ts FROM t WHERE kind = 'code_edit'")
def stream_touches(spark, sf_dir):
    """Touches that come twice are kept once."""
    root = f"{shared_folder(spark)}/quillgraph/touches-{uuid.uuid4().hex}"
    t = _timeline(spark, sf_dir).where("kind = 'code_edit'").select("source", "path", F.col("ts").cast("timestamp").alias("ts"))
    t.unionByName(t).write.parquet(f"{root}/source")
    stream = spark.readStream.schema(t.schema).parquet(f"{root}/source")
    sessions.written(sessions.streamed_touches(stream), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(t.schema).parquet(f"{root}/out")


@registered("SELECT event_id AS id, 'FileTouched' AS type, 'file:u' || user_id::VARCHAR AS node, row_number() OVER (ORDER BY event_id) - 1 AS place, 'notes' AS source, TIMESTAMP '2024-02-01 00:00:00' AS ts FROM events WHERE event_type IN ('click', 'purchase')")
def event_log_round_trip(spark, sf_dir):
    """Events completed with a time, appended to a log of JSON lines in their order and read back with the number of their line."""
    root = f"{shared_folder(spark)}/quillgraph/log-{uuid.uuid4().hex}"
    e = _t(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    notes.append_events(e.orderBy("event_id").select(F.col("event_id").cast("string").alias("id"), F.lit("FileTouched").alias("type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.lit("notes").alias("source")), root, F.lit(NOW).cast("timestamp"))
    spark.createDataFrame([("{broken",), ("",)], "value string").write.text(f"{root}/z")  # their names come last
    log = notes.read_log(spark, root)
    return log.select(F.col("id").cast("long").alias("id"), "type", fold.node_of().alias("node"), F.col("pos").alias("place"), "source", F.col("ts").cast("timestamp_ntz").alias("ts"))


@registered("""WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user' AND trim(coalesce(text, ''), ' \t\n\r') <> '') AS asked, count(*) FILTER (role = 'assistant' AND text IS NOT NULL) AS answered FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN asked = 0 THEN 1 ELSE asked END AS asked, answered FROM c WHERE asked + answered > 0""")
def chat_sessions(spark, sf_dir):
    """Conversations as chat sessions: requests come as patches of a session's state, answers from the transcript beside it."""
    c = _t(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id").cast("string")).where("id is not null and text is not null")
    path = F.concat(F.lit("/s/w/chatSessions/"), "id", F.lit(".jsonl"))
    begun = F.concat(F.lit('{"kind": 0, "v": {"sessionId": "'), "id", F.lit('", "creationDate": 1704067200000, "requests": []}}'))
    begun = c.select("id").distinct().select(path.alias("path"), F.lit(-1).cast("long").alias("pos"), begun.alias("value"))
    shown = F.array(F.struct(F.concat(F.lit("<userRequest>"), "text", F.lit("</userRequest>")).alias("text")))
    request = F.to_json(F.struct(F.struct(F.struct(shown.alias("renderedUserMessage")).alias("metadata")).alias("result")))
    asked = F.concat(F.lit('{"kind": 1, "k": ["requests", '), F.col("turn").cast("string"), F.lit('], "v": '), request, F.lit("}"))
    chats = begun.unionByName(c.where("role = 'user'").select(path.alias("path"), F.col("turn").alias("pos"), asked.alias("value")))
    answer = F.to_json(F.struct(F.lit("assistant.message").alias("type"), F.lit("2024-01-01T00:00:01Z").alias("timestamp"), F.struct(F.concat(F.lit("says "), "text").alias("content")).alias("data")))
    told = c.where("role = 'assistant'").select(transcripts.sibling_transcript(path, F.col("id")).alias("path"), F.col("turn").alias("pos"), answer.alias("value"))
    said = lambda r: F.count(F.when(F.col("role") == r, 1))
    return transcripts.chat_sessions(chats, told).groupBy(F.col("session").cast("long").alias("conv_id")).agg(said("user").alias("asked"), said("assistant").alias("answered"))


@registered(f"""WITH {_TIMELINE}, k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, source DESC, pos DESC) AS rn FROM t WHERE kind IN ('code_edit', 'artifact'))
SELECT source, kind, path, event_type AS summary, pos % 2 = 0 AS has_diff FROM k WHERE (kind = 'code_edit' AND rn <= 5) OR (kind = 'artifact' AND rn <= 3)""")
def context_events(spark, sf_dir):
    """The recent events as a context document shows them."""
    none = F.lit(None).cast("string")
    t = _timeline(spark, sf_dir).withColumn("file", none).withColumn("summary", none).withColumn("content", F.col("event_type")).withColumn("diff", F.when(F.col("pos") % 2 == 0, "d"))
    return documents.event_rows(t).select("source", "kind", "path", "summary", "has_diff")


_ASKED = f"""d AS (SELECT doc_id, {_TOKENS} AS tok FROM documents), f AS (SELECT count(*)::DOUBLE AS n, avg(len(tok)) AS al FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(tok) AS len, unnest(tok) AS term FROM d) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, list_sum(list(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al)) ORDER BY term)) AS bm25 FROM q JOIN df USING (term) JOIN tf USING (term) CROSS JOIN f GROUP BY 1, 2)"""


@registered(f"""WITH {_ASKED} SELECT item_id, doc_id, {_R6.format("bm25")} AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS rn FROM s) WHERE rn <= 20""")
def bm25_batch_topk(spark, sf_dir):
    """Every benchmark item asks an index that was built in two segments: the documents' texts are broken into tokens once."""
    root = f"{shared_folder(spark)}/quillgraph/postings-{uuid.uuid4().hex}"
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    for batch in (0, 1):
        postings.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == batch), root, batch, "doc_id", folders=8)
    found = postings.search(_t(spark, sf_dir, "benchmark").select("item_id", "text"), root, 20, query="item_id", folders=8)
    return found.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), X.round6(F.col("bm25")).alias("score"))


@registered("""WITH d AS (SELECT doc_id, sha1(coalesce(text, '')) AS h FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'third' WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END || left(h, 8) AS hash, CASE WHEN doc_id % 5 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS batch FROM d""")
def cache_upsert(spark, sf_dir):
    """A cache of hashes changed by three batches, the second of which comes twice; each rewrites only the folders it touches."""
    root = f"{shared_folder(spark)}/quillgraph/cache-{uuid.uuid4().hex}"
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit(""))).alias("hash"))
    for batch, (name, of) in enumerate((("first", 1), ("second", 3), ("second", 3), ("third", 5))):
        rows = d.where(F.col("doc_id") % of == 0).select("doc_id", F.concat(F.lit(name), F.left("hash", F.lit(8))).alias("hash"))
        tables.upsert(rows.withColumn("batch", F.lit(min(batch, 1) if batch < 3 else 2).cast("long")), "doc_id", root, min(batch, 1) if batch < 3 else 2, buckets=16)
    return tables.read(spark, root, "doc_id long, hash string, batch long")


_LOG = """e AS (SELECT user_id AS id, event_id AS pos, ts, event_type AS kind FROM events),
m AS (SELECT unnest([TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-12 12:00:00', TIMESTAMP '2024-01-25 00:00:00']) AS moment),
o AS (SELECT moment, e.*, row_number() OVER (PARTITION BY moment, e.id ORDER BY ts, pos) AS rn FROM e, m WHERE ts <= moment
    AND EXISTS (SELECT 1 FROM e b WHERE b.id = e.id AND b.kind = 'signup' AND (b.ts < e.ts OR (b.ts = e.ts AND b.pos <= e.pos)))),
f AS (SELECT DISTINCT moment, id, 0::BIGINT AS rn, 0.6::DOUBLE AS c, 0::BIGINT AS acc, 'open' AS st FROM o
    UNION ALL SELECT f.moment, f.id, o.rn, CASE o.kind WHEN 'signup' THEN 0.6::DOUBLE WHEN 'error' THEN c * 0.2::DOUBLE WHEN 'purchase' THEN least(1.0::DOUBLE, c + 0.1::DOUBLE) ELSE c END,
    acc + (o.kind = 'click')::INT, CASE o.kind WHEN 'signup' THEN 'active' WHEN 'error' THEN 'superseded' WHEN 'view' THEN 'resolved' ELSE st END FROM f JOIN o ON o.moment = f.moment AND o.id = f.id AND o.rn = f.rn + 1)"""


def _decision_log(spark, sf_dir):
    """Every user as a decision: signing up makes it (again), errors revert it, purchases confirm it, views resolve it, clicks look at it."""
    kind = F.col("event_type")
    act = F.when(kind == "signup", "DecisionCreated").when(kind.isin("error", "purchase"), "DecisionOutcomeObserved").when(kind == "view", "DecisionResolved").otherwise("NodeAccessed")
    given = {"id": F.col("event_id").cast("string"), "ts": F.col("ts").cast("timestamp"), "source": F.lit("agent"), "type": act, "nodeId": F.col("user_id").cast("string"), "outcome": F.when(kind == "error", "reverted").when(kind == "purchase", "confirmed")}
    columns = [given.get(name, F.lit(None)).cast(ddl).alias(name) for name, ddl in (x.replace("`", "").split(" ", 1) for x in EVENT_DDL.split(", "))]
    return _t(spark, sf_dir, "events").select(*columns, F.col("event_id").alias("pos"))


@registered(f"""WITH RECURSIVE {_LOG} SELECT moment, id, {_R6.format("arg_max(c, rn)")} AS confidence, arg_max(acc, rn) AS accesses, arg_max(st, rn) AS status FROM f GROUP BY moment, id""")
def graph_at_moments(spark, sf_dir):
    """The nodes at three moments, by filters over intervals that were made once."""
    root = f"{shared_folder(spark)}/quillgraph/versions-{uuid.uuid4().hex}"
    history.node_versions(_decision_log(spark, sf_dir)).write.parquet(root)
    out = None
    for moment in ("2024-01-05 00:00:00", "2024-01-12 12:00:00", "2024-01-25 00:00:00"):
        at = F.lit(moment).cast("timestamp")
        rows = history.at_moment(spark.read.parquet(root), at).select(F.to_timestamp_ntz(F.lit(moment)).alias("moment"), F.col("id").cast("long").alias("id"), X.round6(F.col("confidence")).alias("confidence"), F.col("access_count").alias("accesses"), "status")
        out = rows if out is None else out.unionByName(rows)
    return out


@registered(f"""WITH RECURSIVE {_LOG.replace("TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-12 12:00:00', TIMESTAMP '2024-01-25 00:00:00'", "TIMESTAMP '2100-01-01 00:00:00'")}
SELECT id, {_R6.format("arg_max(c, rn)")} AS confidence, arg_max(acc, rn) AS accesses, arg_max(st, rn) AS status, {_R3.format("(1.0::DOUBLE + 0.1::DOUBLE * arg_max(acc, rn))")} AS importance, max(rn) AS n_sources FROM f GROUP BY id""")
def fold_nodes(spark, sf_dir):
    """The materialiser itself, over a log with all sorts of events of a decision; its source ids counted."""
    n = fold.nodes(_decision_log(spark, sf_dir))
    return n.select(F.col("id").cast("long").alias("id"), X.round6(F.col("confidence")).alias("confidence"), F.col("access_count").alias("accesses"), "status", "importance", F.size("source_ids").cast("long").alias("n_sources"))


@registered("""WITH t AS (SELECT ts, event_id AS pos, user_id::VARCHAR AS file FROM events WHERE event_type IN ('click', 'purchase', 'view')),
g AS (SELECT *, (ts - lag(ts) OVER (ORDER BY ts, pos) > INTERVAL 240 SECOND)::INT AS b FROM t), s AS (SELECT *, coalesce(sum(b) OVER (ORDER BY ts, pos ROWS UNBOUNDED PRECEDING), 0) AS k FROM g),
f AS (SELECT k, file, min({ts: ts, pos: pos}) AS first FROM s GROUP BY k, file), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY first, file) AS rn FROM f)
SELECT DISTINCT least(a.file, b.file) AS "from", greatest(a.file, b.file) AS "to" FROM r a JOIN r b ON a.k = b.k AND a.rn < b.rn WHERE a.rn <= 10 AND b.rn <= 10""")
def coedits_in_batches(spark, sf_dir):
    """Touches in three batches that lie across each other; the last comes twice. Sessions are merged as the batches come."""
    root = f"{shared_folder(spark)}/quillgraph/sessions-{uuid.uuid4().hex}"
    t = _t(spark, sf_dir, "events").where("event_type in ('click', 'purchase', 'view')").select("ts", F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("file"))
    for batch in (0, 1, 2, 2):
        open_sessions.take(t.where(F.pmod(F.xxhash64("pos"), F.lit(3)) == batch), root, batch, seconds=240)
    return open_sessions.pairs(open_sessions.sessions(spark, root)).select("from", "to")


@registered(f"""WITH {_NODES}, w AS (SELECT *, CASE WHEN type = 'Goal' THEN 1 ELSE 3 END AS place FROM nodes WHERE status = 'active' AND type = 'Decision' OR (type = 'Goal' AND status = 'open')),
t AS (SELECT id, text FROM (SELECT doc_id AS id, trim(coalesce(text, ''), ' \t\n\r\f\v') AS text FROM documents)),
c AS (SELECT w.id, w.importance, w.place, ceil(length(type || ': ' || CASE WHEN length(t.text) > 80 THEN left(t.text, 79) || '…' ELSE t.text END) / 4.0::DOUBLE)::BIGINT AS cost FROM w JOIN t ON t.id = w.id),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY importance DESC, place, id) AS rn FROM c),
f AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS used, []::BIGINT[] AS ids UNION ALL SELECT o.rn, CASE WHEN used + cost <= 200 THEN used + cost ELSE used END, CASE WHEN used + cost <= 200 THEN list_append(ids, o.id) ELSE ids END FROM f JOIN o ON o.rn = f.rn + 1)
SELECT arg_max(used, rn) AS used, array_to_string(arg_max(ids, rn), ',') AS ids, max(rn) - len(arg_max(ids, rn)) AS dropped FROM f HAVING max(rn) > 0""".replace("WITH lab", "WITH RECURSIVE lab"))
def compile_tiny(spark, sf_dir):
    """The tiny profile: the working memory by importance, goals first, filled into its budget."""
    rows = context.blocks_of(context.memory_items(_nodes(spark, sf_dir)), None, "tiny")
    got = context.fill(rows, C.TIERS["tiny"], tie=["place"])
    return got.select("used", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "dropped")


@registered(f"""WITH RECURSIVE {_BM25}, i AS (SELECT b.doc_id AS id, source AS query, bm25 AS score, ceil(length('Goal: ' || CASE WHEN length(x) > 80 THEN left(x, 79) || '…' ELSE x END) / 4.0::DOUBLE)::BIGINT AS cost, x AS text
    FROM b JOIN (SELECT doc_id, source, trim(coalesce(text, ''), ' \t\n\r\f\v') AS x FROM documents) USING (doc_id) WHERE bm25 >= 0.02),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rn FROM i),
f AS (SELECT DISTINCT query, 0::BIGINT AS rn, 0::BIGINT AS used, []::BIGINT[] AS ids FROM o UNION ALL SELECT f.query, o.rn, CASE WHEN used + cost <= 800 THEN used + cost ELSE used END, CASE WHEN used + cost <= 800 THEN list_append(ids, o.id) ELSE ids END FROM f JOIN o ON o.query = f.query AND o.rn = f.rn + 1),
z AS (SELECT query, arg_max(ids, rn) AS ids FROM f GROUP BY query), e AS (SELECT d.source AS query, d.doc_id AS id FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) WHERE d.source IN (SELECT query FROM z)),
sc AS (SELECT e.query, e.id, left(lower(trim(coalesce(d.text, ''), ' \t\n\r\f\v')), 20) AS hint, o.rn FROM e JOIN documents d ON d.doc_id = e.id LEFT JOIN o ON o.query = e.query AND o.id = e.id),
h AS (SELECT z.query, left(lower(x.text), 20) AS head FROM z, unnest(z.ids) AS u(id) JOIN i x ON x.id = u.id)
SELECT query, {_R6.format("avg((coalesce(rn <= 5, false) OR (query, hint) IN (SELECT query, head FROM h))::INT)")} AS recall_5, {_R6.format("avg((coalesce(rn <= 10, false) OR (query, hint) IN (SELECT query, head FROM h))::INT)")} AS recall_10 FROM sc WHERE length(hint) = 20 GROUP BY query""")
def bench_budgeted(spark, sf_dir):
    """Each source as a query: what a budget of 800 tokens shows of its good documents, all compiled in one plan."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", "source")
    scored = rank.bm25(d, QUERY).select(F.col("doc_id").alias("id"), F.col("source").alias("query"), F.col("bm25").alias("score"))
    texts = d.select(F.col("doc_id").alias("id"), X.strip(F.coalesce("text", F.lit(""))).alias("text"))
    items = scored.join(texts, "id").withColumn("type", F.lit("Goal")).withColumn("status", F.lit("open")).withColumn("kind", F.lit(None).cast("string"))
    compiled = context.compile_many(items, None, "query", "small")
    good = _t(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    expected = d.select(F.col("source").alias("query"), F.col("doc_id").alias("id")).join(good, "id").join(texts, "id").where("length(substring(text, 1, 20)) = 20")
    scored = scored.where("score >= 0.02")  # what the compile leaves out as well
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "id"))).where("rank <= 10")
    got = stats.compiled_recall(expected.join(scored.select("query").distinct(), "query"), ranked, compiled, 5, 10)
    return got.select("query", *[X.round6(F.col(c)).alias(c) for c in ("recall_5", "recall_10")])
