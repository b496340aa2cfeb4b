"""Registered queries on the star-schema tables, each with its SQL for the check against another engine.

The tables stand in for the graph's own inputs: events are a timeline (source = user_id % 5, path = user_id), documents are nodes
(author = source, type = lang), labels with quality 0 are reversed decisions, orders are sessions of files (parts), a
customer's orders are a supersession chain, embeddings are the vector cache, conversations are messages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context, fold, graph, pieces, rank, stats, timeline
from ..operators.staging import shared_folder
from ..streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUERY = "the that of"
NOW = "2024-02-01 00:00:00"


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "purchase"), "code_edit").when(F.col("event_type") == "view", "artifact").when(F.col("event_type") == "signup", "message").otherwise("checkpoint")
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("pos"), "ts", (F.col("user_id") % 5).cast("string").alias("source"), kind.alias("kind"), F.lit(None).cast("string").alias("role"), F.col("user_id").cast("string").alias("path"), "event_type", "user_id", "value")


_TIMELINE = """t AS (SELECT event_id AS pos, ts, CAST(user_id % 5 AS VARCHAR) AS source, CAST(user_id AS VARCHAR) AS path, event_type, user_id, value,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'code_edit' WHEN event_type = 'view' THEN 'artifact' WHEN event_type = 'signup' THEN 'message' ELSE 'checkpoint' END AS kind FROM events)"""
_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_BM25 = f"""d AS (SELECT doc_id, {_TOKENS} AS tok FROM documents),
l AS (SELECT doc_id, tok, len(tok) AS len, [len(list_filter(tok, lambda x: x = 'the')), len(list_filter(tok, lambda x: x = 'that')), len(list_filter(tok, lambda x: x = 'of'))] AS tf FROM d),
s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS al, [sum((tf[1] > 0)::INT), sum((tf[2] > 0)::INT), sum((tf[3] > 0)::INT)] AS df FROM l),
b AS (SELECT doc_id, tok, list_sum(list_transform([1, 2, 3], lambda i: CASE WHEN tf[i] > 0 THEN
    ln(1 + (n - df[i] + 0.5::DOUBLE) / (df[i] + 0.5::DOUBLE)) * tf[i] * 2.5::DOUBLE / (tf[i] + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al)) ELSE 0 END)) AS bm25 FROM l, s)"""
_R6 = "floor({} * 1000000 + 0.5::DOUBLE) / 1000000.0::DOUBLE"
_R3 = "floor({} * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE"


@registered(f"WITH {_BM25} SELECT doc_id, {_R6.format('bm25')} AS score FROM b WHERE bm25 > 0 ORDER BY score DESC, doc_id LIMIT 50")
def bm25_topk(spark, sf_dir):
    s = rank.bm25(_t(spark, sf_dir, "documents").select("doc_id", "text"), QUERY)
    return s.where("bm25 > 0").select("doc_id", X.round6(F.col("bm25")).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(50)


@registered(f"""WITH {_BM25}, c AS (SELECT doc_id, bm25, len(list_intersect(['the', 'that', 'of'], tok)) / 3.0::DOUBLE AS coverage FROM b)
SELECT doc_id, {_R6.format("bm25 / greatest(max(bm25) OVER (), 1e-9) * coverage")} AS relevance, {_R6.format("coverage")} AS coverage FROM c""")
def bm25_coverage_norm(spark, sf_dir):
    s = rank.lexical(_t(spark, sf_dir, "documents").select("doc_id", "text"), QUERY)
    return s.select("doc_id", X.round6(F.col("relevance")).alias("relevance"), X.round6(F.col("coverage")).alias("coverage"))


@registered(f"""WITH d AS (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS term FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents)
SELECT term, count(*) AS df, {_R6.format("ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE))")} AS idf FROM d, n GROUP BY term""")
def corpus_term_stats(spark, sf_dir):
    return rank.term_stats(_t(spark, sf_dir, "documents").select("text")).select("term", "df", X.round6(F.col("idf")).alias("idf"))


def _decisions(spark, sf_dir):
    d, lab = _t(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), _t(spark, sf_dir, "labels")
    status = F.when(F.col("quality") == 0, "superseded").when(F.col("toxic") == 1, "contradicted").when(F.col("doc_id") % 3 == 0, "resolved").otherwise("active")
    return d.join(lab, "doc_id").withColumn("status", status).withColumnRenamed("source", "author")


_DECISIONS = """x AS (SELECT d.doc_id, d.text, d.source AS author, d.lang, quality, toxic,
    CASE WHEN quality = 0 THEN 'superseded' WHEN toxic = 1 THEN 'contradicted' WHEN d.doc_id % 3 = 0 THEN 'resolved' ELSE 'active' END AS status FROM documents d JOIN labels USING (doc_id))"""
_REPUTATION = "r AS (SELECT author, (count(*) - count(*) FILTER (status IN ('superseded', 'contradicted')) + 1)::DOUBLE / (count(*) + 2) AS reputation FROM x WHERE author IS NOT NULL GROUP BY author)"


@registered(f"WITH {_DECISIONS}, {_REPUTATION} SELECT author, {_R6.format('reputation')} AS reputation FROM r")
def agent_reputation(spark, sf_dir):
    return rank.reputation(_decisions(spark, sf_dir)).select("author", X.round6(F.col("reputation")).alias("reputation"))


@registered(f"""WITH {_DECISIONS}, {_REPUTATION}, {_BM25}, m AS (SELECT max(bm25) AS top FROM b),
f AS (SELECT x.doc_id, {_R3.format("(bm25 / greatest(top, 1e-9) * len(list_intersect(['the', 'that', 'of'], tok)) / 3.0::DOUBLE)")} AS a,
    {_R3.format("(CASE WHEN quality = 0 THEN 0.17::DOUBLE ELSE 0.85::DOUBLE END)")} AS c, {_R3.format("(1.0::DOUBLE + (x.doc_id % 4) * 0.1::DOUBLE)")} AS i,
    {_R3.format("exp(-0.01::DOUBLE * (x.doc_id % 30))")} AS fr, {_R3.format("coalesce(reputation, 1.0::DOUBLE)")} AS rp
    FROM x JOIN b USING (doc_id) CROSS JOIN m LEFT JOIN r USING (author))
SELECT doc_id, a AS relevance, c AS confidence, i AS importance, fr AS freshness, rp AS reputation, {_R3.format("(a * c * i * fr * rp)")} AS score FROM f""")
def rank_components(spark, sf_dir):
    docs = rank.lexical(_t(spark, sf_dir, "documents").select("doc_id", "text"), QUERY).select("doc_id", "relevance")
    x = _decisions(spark, sf_dir)
    rows = x.join(docs, "doc_id").join(rank.reputation(x), "author", "left")
    rows = rows.select(
        "doc_id", "relevance", F.when(F.col("quality") == 0, 0.17).otherwise(0.85).alias("confidence"), (1.0 + (F.col("doc_id") % 4) * 0.1).alias("importance"), F.lit(0.01).alias("decay_rate"),
        F.timestamp_micros(F.unix_micros(F.lit(NOW).cast("timestamp")) - (F.col("doc_id") % 30) * 86_400_000_000).alias("last_verified"), F.lit("Decision").alias("type"), "reputation",
    )
    return rank.components(rows, F.lit(NOW).cast("timestamp")).select("doc_id", "components.*", "score")


@registered(f"""WITH {_DECISIONS} SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'resolved') AS resolved,
count(*) FILTER (status = 'superseded') AS superseded, count(*) FILTER (status = 'contradicted') AS contradicted,
{_R3.format("(count(*) FILTER (status IN ('superseded', 'contradicted'))::DOUBLE / count(*))")} AS reversal_rate FROM x""")
def decision_stats(spark, sf_dir):
    return stats.decision_stats(_decisions(spark, sf_dir))


@registered(f"WITH {_DECISIONS} SELECT count(*) AS total, count(*) - count(*) FILTER (status = 'resolved') AS open, count(*) FILTER (status = 'resolved') AS resolved FROM x WHERE quality = 0 OR doc_id % 3 = 0")
def failure_stats(spark, sf_dir):
    return stats.failure_stats(_decisions(spark, sf_dir).where("quality = 0 or doc_id % 3 = 0"))


@registered(f"""WITH {_TIMELINE}, b AS (SELECT unnest(['message', 'code_edit', 'artifact', 'other']) AS bucket)
SELECT bucket, count(pos) AS n FROM b LEFT JOIN t ON bucket = CASE WHEN kind = 'checkpoint' THEN 'other' ELSE kind END GROUP BY bucket""")
def counts_by_kind(spark, sf_dir):
    return stats.count_in_buckets(_timeline(spark, sf_dir), "kind", ["message", "code_edit", "artifact"])


@registered(f"WITH {_TIMELINE} SELECT source, count(*) AS n FROM t GROUP BY source")
def counts_by_source(spark, sf_dir):
    return stats.count_by(_timeline(spark, sf_dir), "source")


@registered("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def counts_by_day(spark, sf_dir):
    return stats.count_by_day(_t(spark, sf_dir, "events"))


@registered(f"WITH {_TIMELINE} SELECT pos, kind, source FROM t ORDER BY ts, CASE kind WHEN 'message' THEN 0 WHEN 'code_edit' THEN 1 WHEN 'artifact' THEN 2 ELSE 3 END, source, pos LIMIT 100 OFFSET 200")
def timeline_order_page(spark, sf_dir):
    return timeline.page(_timeline(spark, sf_dir), timeline.order_keys(), 100, 200).select("pos", "kind", "source")


@registered(f"WITH {_TIMELINE} SELECT pos, kind, source FROM t WHERE kind IN ('code_edit', 'artifact') AND source = '2'")
def filter_role_kind(spark, sf_dir):
    return timeline.filtered(_timeline(spark, sf_dir), kind="code_edit", source="2").select("pos", "kind", "source")


@registered("""WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '[REDACTED]' WHEN 1 THEN ' [redacted] [REDACTED] ' ELSE text END AS content FROM conversations)
SELECT conv_id, turn FROM c WHERE NOT (coalesce(regexp_matches(content, '(?i)\\[REDACTED\\]'), false) AND trim(regexp_replace(content, '(?i)\\[REDACTED\\]', '', 'g')) = '')""")
def redaction_filter(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").withColumn("content", F.when(F.col("turn") % 4 == 0, "[REDACTED]").when(F.col("turn") % 4 == 1, " [redacted] [REDACTED] ").otherwise(F.col("text")))
    return timeline.merged(c.withColumn("kind", F.lit("message"))).select("conv_id", "turn")


@registered("SELECT role, conv_id, turn, rn FROM (SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS rn FROM conversations) WHERE rn <= 6")
def last_n_per_role(spark, sf_dir):
    return timeline.last_per_group(_t(spark, sf_dir, "conversations"), ["role"], [F.col("conv_id").desc(), F.col("turn").desc()], 6).select("role", "conv_id", "turn", F.col("rn").cast("long").alias("rn"))


@registered(f"""WITH {_TIMELINE}, w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, pos DESC) AS rn FROM t WHERE kind IN ('code_edit', 'artifact'))
SELECT pos, source FROM w ORDER BY CASE WHEN rn <= 5 THEN 0 ELSE 1 END, ts DESC, pos DESC LIMIT 50""")
def balanced_recent_edits(spark, sf_dir):
    return timeline.balanced_edits(timeline.filtered(_timeline(spark, sf_dir), kind="code_edit")).select("pos", "source")


@registered("""WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS segment FROM conversations)
SELECT conv_id, segment::BIGINT AS segment, count(*) AS n, arg_min(left(text, 40), turn) AS label FROM s GROUP BY 1, 2""")
def segments_by_user_turn(spark, sf_dir):
    s = timeline.segments(_t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])
    return s.groupBy("conv_id", "segment").agg(F.count("*").alias("n"), F.min_by(F.substring("text", 1, 40), "turn").alias("label"))


_GAPS = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, (sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session_no FROM g)"""


@registered(f"WITH {_GAPS} SELECT user_id, session_no, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY 1, 2")
def gap_sessions(spark, sf_dir):
    s = timeline.gap_sessions(_timeline(spark, sf_dir), ["user_id"])
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("pos").alias("first_id"))


@registered("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) > INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, (sum(b) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session_no FROM g) SELECT event_id, session_no FROM s""")
def global_sessions(spark, sf_dir):
    return timeline.global_sessions(_timeline(spark, sf_dir), 600).select(F.col("pos").alias("event_id"), "session_no")


@registered(f"WITH {_GAPS} SELECT event_id, user_id, session_no FROM s WHERE session_no = (SELECT max(session_no) FROM s t WHERE t.user_id = s.user_id)")
def trailing_session(spark, sf_dir):
    s = timeline.gap_sessions(_timeline(spark, sf_dir), ["user_id"])
    top = F.max("session_no").over(W.partitionBy("user_id"))
    return s.withColumn("top", top).where("session_no = top").select(F.col("pos").alias("event_id"), "user_id", "session_no")


_CO_EDITS = """f AS (SELECT l_orderkey AS s, l_partkey AS p, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY first, p) AS rn FROM f),
c AS (SELECT DISTINCT least(a.p, b.p) AS "from", greatest(a.p, b.p) AS "to" FROM k a JOIN k b ON a.s = b.s AND a.rn < b.rn WHERE b.rn <= 10)"""


@registered(f'WITH {_CO_EDITS} SELECT "from", "to" FROM c')
def coedit_pairs(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    return graph.co_edits(lines, "l_orderkey", "l_partkey", "l_linenumber", rows=lines.count()).select("from", "to")


@registered(f"""WITH {_CO_EDITS}, e AS (SELECT "from" AS id FROM c UNION ALL SELECT "to" FROM c)
SELECT id, degree, coalesce(p_name, id::VARCHAR) AS name FROM (SELECT id, count(*) AS degree FROM e GROUP BY id ORDER BY degree DESC, id LIMIT 10) LEFT JOIN part ON p_partkey = id""")
def coedit_degree_top10(spark, sf_dir):
    top = stats.degrees(coedit_pairs(spark, sf_dir))
    return top.join(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name"), "id", "left").select("id", "degree", F.coalesce("p_name", F.col("id").cast("string")).alias("name"))


@registered("""WITH m AS (SELECT a.event_id AS id, b.event_id AS match_id, abs(epoch_us(b.ts) - epoch_us(a.ts)) AS d,
    row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), b.event_id) AS rn
    FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 21600000000)
SELECT id, match_id, d / 1000000.0::DOUBLE AS delta_s FROM m WHERE rn = 1""")
def nearest_edit_match(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts", "event_type")
    return timeline.nearest(e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), "user_id", 6 * 3600)


@registered("""WITH h AS (SELECT event_id AS id, user_id AS path, ts, 0 AS prio FROM events WHERE event_type = 'click'),
s AS (SELECT event_id AS id, user_id AS path, ts, 1 AS prio FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT path FROM h)),
u AS (SELECT * FROM h UNION ALL SELECT * FROM s)
SELECT id, path FROM (SELECT *, row_number() OVER (PARTITION BY path, date_trunc('second', ts) ORDER BY prio, id) AS rn FROM u) WHERE rn = 1""")
def priority_dedup(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return timeline.merged_edits(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type")).select("id", "path")


@registered("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def new_items_anti(spark, sf_dir):
    from ..operators import ingest

    nodes = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    return ingest.new_items(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("nodeId")), nodes).select(F.col("nodeId").alias("o_orderkey"))


@registered("SELECT l_orderkey, l_linenumber, l_linestatus AS status, o_orderstatus AS old_status FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus <> o_orderstatus")
def status_changed(spark, sf_dir):
    from ..operators import ingest

    items = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("nodeId"), "l_linenumber", F.col("l_linestatus").alias("status"))
    nodes = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return ingest.changed_status(items, nodes).select(F.col("nodeId").alias("l_orderkey"), "l_linenumber", "status", "old_status")


@registered("SELECT o_orderkey, o_custkey, o_orderstatus AS now, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
def snapshot_lag_diff(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("now"), F.lag("o_orderstatus").over(w).alias("before"))


def _folded(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    step = F.when(kind == "error", pieces.mapped(0.2)).when(kind == "purchase", pieces.mapped(1.0, 0.1, 1.0)).when(kind == "signup", pieces.set_to(0.85))
    status = F.when(kind == "error", F.lit("superseded")).when(kind == "signup", F.lit("active"))
    registers = [pieces.count("n", F.lit(True)), pieces.count("clicks", kind == "click"), pieces.last("status", status, status.isNotNull())]
    out = pieces.fold(events.select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", registers, step, hours=30 * 24)
    return out.select("user_id", X.round6(pieces.applied(F.col("step"), 0.6)).alias("confidence"), X.round3(1.0 + 0.1 * F.col("clicks")).alias("importance"), F.coalesce("status.value", F.lit("open")).alias("status"), "n")


_FOLD = """o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {events}),
f AS (SELECT user_id, 0::BIGINT AS rn, 0.6::DOUBLE AS c, 1.0::DOUBLE AS i, 'open' AS st FROM (SELECT DISTINCT user_id FROM o)
    UNION ALL SELECT f.user_id, o.rn, CASE event_type WHEN 'error' THEN c * 0.2::DOUBLE WHEN 'purchase' THEN least(1.0::DOUBLE, c + 0.1::DOUBLE) WHEN 'signup' THEN 0.85::DOUBLE ELSE c END,
    CASE WHEN event_type = 'click' THEN floor((i + 0.1::DOUBLE) * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE ELSE i END, CASE event_type WHEN 'error' THEN 'superseded' WHEN 'signup' THEN 'active' ELSE st END
    FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1),
z AS (SELECT user_id, arg_max(c, rn) AS c, arg_max(i, rn) AS i, arg_max(st, rn) AS status, max(rn) AS n FROM f GROUP BY user_id)
SELECT user_id, floor(c * 1000000 + 0.5::DOUBLE) / 1000000.0::DOUBLE AS confidence, floor(i * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE AS importance, status, n FROM z"""


@registered("WITH RECURSIVE " + _FOLD.format(events="events"))
def fold_confidence(spark, sf_dir):
    return _folded(_t(spark, sf_dir, "events"))


@registered("WITH RECURSIVE " + _FOLD.format(events="events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'"))
def asof_snapshot(spark, sf_dir):
    return _folded(fold.as_of(_t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2024-01-15 00:00:00"))


@registered("SELECT user_id, arg_max(event_type, {ts: ts, id: event_id}) AS status FROM events GROUP BY user_id")
def last_state(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@registered(f"""WITH {_DECISIONS}, n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Goal' WHEN 1 THEN 'Task' WHEN 2 THEN 'Decision' ELSE 'Failure' END AS type,
    CASE WHEN doc_id % 4 = 0 AND status = 'active' THEN 'open' ELSE status END AS status FROM x)
SELECT doc_id, CASE WHEN type = 'Goal' AND status = 'open' THEN 'goals' WHEN type = 'Task' AND status IN ('open', 'active') THEN 'tasks'
    WHEN type = 'Decision' AND status IN ('active', 'open') THEN 'decisions' WHEN type = 'Failure' AND status <> 'resolved' THEN 'blockers' END AS bucket FROM n WHERE bucket IS NOT NULL""")
def working_memory(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("Goal", "Task", "Decision", "Failure"))), (F.col("doc_id") % 4 + 1).cast("int"))
    n = _decisions(spark, sf_dir).select("doc_id", kind.alias("type"), F.when((F.col("doc_id") % 4 == 0) & (F.col("status") == "active"), "open").otherwise(F.col("status")).alias("status"))
    return fold.working_memory(n).select("doc_id", "bucket")


@registered("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old,
    lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS newer FROM orders),
w AS (SELECT id AS head, [id] AS chain, old FROM o WHERE newer IS NULL AND old IS NOT NULL UNION ALL SELECT head, list_append(chain, o.id), o.old FROM w JOIN o ON o.id = w.old WHERE len(chain) < 51)
SELECT head, max(len(chain))::BIGINT AS n, array_to_string(arg_max(chain, len(chain)), '>') AS history FROM w GROUP BY head""")
def supersession_chain(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("from"), F.lag("o_orderkey").over(w).alias("to")).where("`to` is not null")
    c = graph.chains(o.withColumn("relation", F.lit("SUPERSEDES")).withColumn("pos", F.lit(0)))
    return c.select("head", F.size("chain").cast("long").alias("n"), F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("history"))


@registered(f"""WITH {_CO_EDITS}, seeds AS (SELECT p_partkey AS id, 1.0::DOUBLE AS v FROM part ORDER BY p_name, p_partkey LIMIT 8),
adj AS (SELECT "from" AS a, "to" AS b FROM c UNION ALL SELECT "to", "from" FROM c),
h1 AS (SELECT b AS id, max(v * 0.6::DOUBLE * 0.6::DOUBLE) AS v FROM seeds JOIN adj ON a = id GROUP BY b), f1 AS (SELECT h1.* FROM h1 LEFT JOIN seeds s USING (id) WHERE s.v IS NULL OR h1.v > s.v),
b1 AS (SELECT * FROM f1 UNION ALL SELECT * FROM seeds WHERE id NOT IN (SELECT id FROM f1)),
h2 AS (SELECT b AS id, max(v * 0.6::DOUBLE * 0.36::DOUBLE) AS v FROM f1 JOIN adj ON a = id GROUP BY b), f2 AS (SELECT h2.* FROM h2 LEFT JOIN b1 USING (id) WHERE b1.v IS NULL OR h2.v > b1.v),
z AS (SELECT id, v, 2 AS depth FROM f2 UNION ALL SELECT id, v, CASE WHEN id IN (SELECT id FROM f1) THEN 1 ELSE 0 END FROM b1 WHERE id NOT IN (SELECT id FROM f2))
SELECT id, {_R6.format("v")} AS value, depth FROM z""")
def graph_two_hop(spark, sf_dir):
    seeds = _t(spark, sf_dir, "part").orderBy("p_name", "p_partkey").limit(8).select(F.col("p_partkey").alias("id"), F.lit(1.0).alias("value"))
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")

    def near(ids):
        """Co-edits of the sessions that the frontier is in."""
        held = lines.join(ids.withColumnRenamed("id", "l_partkey"), "l_partkey", "left_semi").select("l_orderkey").distinct()
        return graph.co_edits(lines.join(held, "l_orderkey", "left_semi"), "l_orderkey", "l_partkey", "l_linenumber").withColumn("relation", F.lit("CO_EDITED"))

    return graph.traverse(seeds, near).select("id", X.round6(F.col("value")).alias("value"), "depth")


@registered(f"""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, {_R6.format("list_cosine_similarity(embedding::DOUBLE[], v)")} AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 20""")
def cosine_topk(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").first()["embedding"]])
    return e.select("vec_id", X.round6(X.cosine(F.col("embedding"), q)).alias("similarity")).orderBy(F.col("similarity").desc(), "vec_id").limit(20)


@registered(f"""WITH {_BM25}, m AS (SELECT max(bm25) AS top FROM b), q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
r AS (SELECT doc_id, bm25 / greatest(top, 1e-9) * len(list_intersect(['the', 'that', 'of'], tok)) / 3.0::DOUBLE AS rel FROM b, m)
SELECT doc_id, {_R6.format("(CASE WHEN embedding IS NULL THEN rel ELSE 0.5::DOUBLE * rel + 0.5::DOUBLE * greatest(0.0::DOUBLE, list_cosine_similarity(embedding::DOUBLE[], v)) END)")} AS relevance
FROM r CROSS JOIN q LEFT JOIN embeddings ON vec_id = doc_id""")
def hybrid_blend(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = F.array(*[F.lit(float(x)) for x in e.where("doc_id = 0").first()["embedding"]])
    r = rank.lexical(_t(spark, sf_dir, "documents").select("doc_id", "text"), QUERY).select("doc_id", "relevance").join(e, "doc_id", "left")
    return r.select("doc_id", X.round6(rank.blended(F.col("relevance"), F.col("embedding"), q)).alias("relevance"))


@registered(f"""WITH p AS (SELECT page_id, list_filter(regexp_split_to_array(lower(coalesce(regexp_replace(url, '[^/]*$', ''), '')), '[^a-z0-9]+'), lambda x: x <> '') AS dirs FROM pages),
s AS (SELECT count(*) AS n, sum(list_contains(dirs, 'blog')::INT) AS f1, sum(list_contains(dirs, 'en')::INT) AS f2, sum(list_contains(dirs, 'https')::INT) AS f3 FROM p),
k AS (SELECT page_id, dirs, f1 > 0 AND f1 / n <= 0.8::DOUBLE AS o1, f2 > 0 AND f2 / n <= 0.8::DOUBLE AS o2, f3 > 0 AND f3 / n <= 0.8::DOUBLE AS o3 FROM p, s)
SELECT page_id, {_R6.format("(CASE WHEN o1::INT + o2::INT + o3::INT = 0 THEN 1.0::DOUBLE ELSE 1 + 3.0::DOUBLE * ((o1 AND list_contains(dirs, 'blog'))::INT + (o2 AND list_contains(dirs, 'en'))::INT + (o3 AND list_contains(dirs, 'https'))::INT) / (o1::INT + o2::INT + o3::INT) END)")} AS boost FROM k""")
def dir_boost(spark, sf_dir):
    return rank.directory_boost(_t(spark, sf_dir, "pages").select("page_id", "url"), "blog en https", "url").select("page_id", X.round6(F.col("boost")).alias("boost"))


@registered(f"""WITH b AS (SELECT item_id, list_distinct(list_filter({_TOKENS}, lambda x: len(x) > 2 AND x NOT IN ({", ".join(map(repr, X.STOP_WORDS))}))) AS s FROM benchmark),
k AS (SELECT item_id, s, unnest(s) AS t FROM b)
SELECT a.item_id AS id_a, b.item_id AS id_b, {_R6.format("(count(*)::DOUBLE / (any_value(len(a.s)) + any_value(len(b.s)) - count(*)))")} AS jaccard, {_R6.format("(count(*)::DOUBLE / least(any_value(len(a.s)), any_value(len(b.s))))")} AS overlap
FROM k a JOIN k b ON a.t = b.t AND a.item_id < b.item_id GROUP BY 1, 2""")
def token_overlap_pairs(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark").select("item_id", X.subject_tokens(F.col("text")).alias("s"))
    k = b.select("item_id", F.explode("s").alias("t"))
    pairs = k.join(k.withColumnRenamed("item_id", "id_b"), "t").where("item_id < id_b").select(F.col("item_id").alias("id_a"), "id_b").distinct()
    full = pairs.join(b.select(F.col("item_id").alias("id_a"), F.col("s").alias("sa")), "id_a").join(b.select(F.col("item_id").alias("id_b"), F.col("s").alias("sb")), "id_b")
    return full.select("id_a", "id_b", X.round6(X.jaccard(F.col("sa"), F.col("sb"))).alias("jaccard"), X.round6(X.overlap(F.col("sa"), F.col("sb"))).alias("overlap"))


_PAIRS = (("dans", "avec"), ("ist", "sich"), ("is", "was"))


@registered(f"""WITH c AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'b' || (conv_id % 3)::VARCHAR END AS branch, text, lower(text) AS low,
    list_distinct(list_filter({_TOKENS}, lambda x: len(x) > 2 AND x NOT IN ({", ".join(map(repr, X.STOP_WORDS))}))) AS s FROM conversations WHERE role = 'user'),
n AS (SELECT count(*) AS n FROM c), df AS (SELECT t, count(*) AS f FROM (SELECT unnest(s) AS t FROM c) GROUP BY t),
k AS (SELECT c.*, df.t FROM (SELECT *, unnest(s) AS t FROM c) c JOIN df USING (t) CROSS JOIN n WHERE n < 4 OR f <= 0.8::DOUBLE * n),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.t = b.t AND a.id < b.id
    WHERE (a.branch IS NULL OR b.branch IS NULL OR a.branch = b.branch) AND ({" OR ".join(f"(contains(a.low, '{x}') AND contains(b.low, '{y}')) OR (contains(a.low, '{y}') AND contains(b.low, '{x}'))" for x, y in _PAIRS)}))
SELECT p.a AS old_id, p.b AS new_id FROM p JOIN c x ON x.id = p.a JOIN c y ON y.id = p.b WHERE len(list_intersect(x.s, y.s))::DOUBLE / least(len(x.s), len(y.s)) >= 0.4::DOUBLE""")
def contradiction_pairs(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").where("role = 'user'")
    c = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("b"), (F.col("conv_id") % 3).cast("string"))).alias("branch"))
    return graph.contradictions(c.withColumn("pos", F.col("id")), _PAIRS)


@registered("""WITH RECURSIVE o AS (SELECT doc_id, source, ceil(n_chars / 4.0::DOUBLE)::BIGINT AS cost, row_number() OVER (PARTITION BY source ORDER BY (doc_id % 97) DESC, doc_id) AS rn FROM documents),
f AS (SELECT DISTINCT source, 0::BIGINT AS rn, 0::BIGINT AS used, []::BIGINT[] AS ids, 0::BIGINT AS dropped, false AS done FROM o
    UNION ALL SELECT f.source, o.rn, CASE WHEN NOT done AND (used + cost <= 1800 OR (len(ids) = 0 AND dropped = 0)) THEN least(used + cost, 1800) ELSE used END,
        CASE WHEN NOT done AND (used + cost <= 1800 OR (len(ids) = 0 AND dropped = 0)) THEN list_append(ids, doc_id) ELSE ids END,
        dropped + CASE WHEN NOT done AND (used + cost <= 1800 OR (len(ids) = 0 AND dropped = 0)) THEN 0 ELSE 1 END, done OR (used + cost > 1800 AND len(ids) = 0 AND dropped = 0)
    FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1)
SELECT source, arg_max(used, rn) AS used, array_to_string(arg_max(ids, rn), ',') AS ids, arg_max(dropped, rn) AS dropped FROM f GROUP BY source""")
def budget_fill(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.ceil(F.col("n_chars") / 4).alias("cost"), (F.col("doc_id") % 97).alias("score"))
    return context.fill(d, 1800, by="source").select("source", "used", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "dropped")


@registered(f"""WITH {_BM25}, w(type, agent_weight) AS (VALUES ('File', 1.3::DOUBLE), ('Task', 1.2::DOUBLE), ('Decision', 1.0::DOUBLE), ('Goal', 0.9::DOUBLE), ('Failure', 1.0::DOUBLE), ('Evidence', 0.8::DOUBLE)),
n AS (SELECT doc_id, bm25, (['File', 'Task', 'Decision', 'Goal', 'Failure', 'Evidence', 'Other'])[doc_id % 7 + 1] AS type FROM b)
SELECT doc_id, type, {_R6.format("(bm25 * coalesce(agent_weight, 1.0::DOUBLE))")} AS score FROM n LEFT JOIN w USING (type) ORDER BY score DESC, doc_id LIMIT 40""")
def agent_weighted_rank(spark, sf_dir):
    s = rank.bm25(_t(spark, sf_dir, "documents").select("doc_id", "text"), QUERY)
    kind = F.element_at(F.array(*map(F.lit, ("File", "Task", "Decision", "Goal", "Failure", "Evidence", "Other"))), (F.col("doc_id") % 7 + 1).cast("int"))
    w = context.weighted(s.select("doc_id", kind.alias("type"), F.col("bm25").alias("score")), "Cursor")
    return w.select("doc_id", "type", X.round6(F.col("score")).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(40)


@registered("SELECT p_partkey, 'part:' || left(sha1(lower(trim(p_name))), 12) AS id FROM part")
def stable_ids(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", X.stable_id("part", F.col("p_name")).alias("id"))


@registered(f"""WITH {_BM25}, g AS (SELECT source AS query, row_number() OVER (PARTITION BY source ORDER BY bm25 DESC, doc_id) AS rank, quality = 1 AS relevant FROM b JOIN documents USING (doc_id) JOIN labels USING (doc_id)),
a AS (SELECT query, sum((relevant AND rank <= 5)::INT) AS hits, sum(relevant::INT) AS rel, min(CASE WHEN relevant THEN rank END) AS first FROM g GROUP BY query)
SELECT query, {_R6.format("(CASE WHEN rel > 0 THEN hits::DOUBLE / rel ELSE 0 END)")} AS recall, {_R6.format("(hits / 5.0::DOUBLE)")} AS precision, {_R6.format("coalesce(1.0::DOUBLE / first, 0.0::DOUBLE)")} AS reciprocal_rank FROM a""")
def bench_recall_mrr(spark, sf_dir):
    s = rank.bm25(_t(spark, sf_dir, "documents").select("doc_id", "text", "source"), QUERY).join(_t(spark, sf_dir, "labels"), "doc_id")
    r = s.select(F.col("source").alias("query"), F.col("bm25").alias("score"), F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("relevant"))
    figures = {"recall": "recall_5", "precision": "share_5", "reciprocal_rank": "reciprocal_rank"}
    return stats.scored_quality(r, 5).select("query", *[X.round6(F.col(c)).alias(name) for name, c in figures.items()])


@registered("SELECT p_partkey, p_name, 'text' AS matched FROM part WHERE p_name <> '' AND (contains(lower(p_name), 'red widget') OR contains('red widget', lower(p_name)))")
def resolve_ref(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"), "p_partkey")
    return graph.resolve(p, "Red widget").select("p_partkey", F.col("text").alias("p_name"), "matched")


@registered("""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations)
SELECT conv_id, turn, array_to_string(list_concat(['--- a/x', '+++ b/x'], CASE WHEN coalesce(old, '') = '' THEN [] ELSE list_transform(string_split(old, chr(10)), lambda l: '-' || l) END,
    CASE WHEN coalesce(text, '') = '' THEN [] ELSE list_transform(string_split(text, chr(10)), lambda l: '+' || l) END), chr(10)) AS diff FROM c""")
def unified_diff_lines(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").withColumn("old", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", X.whole_diff(F.col("old"), F.col("text"), F.lit("x")).alias("diff"))


@registered("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""")
def stream_sessions(spark, sf_dir):
    """Closed sessions, by Structured Streaming over the events; results are kept in the session's shared folder."""
    root = f"{shared_folder(spark)}/quillgraph/stream-{uuid.uuid4().hex}"
    source = f"{root}/source"
    events = _t(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    sessions.written(sessions.streamed_sessions(stream, "user_id"), f"{root}/out", f"{root}/log")
    return spark.read.schema("user_id bigint, start timestamp, end timestamp, n bigint").parquet(f"{root}/out")
