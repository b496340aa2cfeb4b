"""Registered queries for readers, brief parts and small operators: conversations, documents, pages and events written in
the shapes that the readers take, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import brief, cells, context, documents, graph, ingest, retrieve, timeline
from ..operators.staging import shared_folder
from ..sources import notes, transcripts
from ..streaming import sessions
from .catalogue import ORACLES, _BM25, _R3, _R6, _TIMELINE, NOW, QUERY, _t, _timeline, registered
from .more import _NODES, _links, _nodes


def _root(spark, name: str) -> str:
    return f"{shared_folder(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, root: str, name: str, spark) -> DataFrame:
    """Lines (value) as files of JSON lines, read back with their numbers."""
    df.select("value").write.text(f"{root}/{name}")
    return transcripts.read_lines(spark, f"{root}/{name}", "*.txt")


def _figures(rows: DataFrame) -> DataFrame:
    """(kind, role, file, n, chars): how many rows there are of each sort, and their characters."""
    return rows.groupBy("kind", "role", "file").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("content", F.lit("")))).cast("long").alias("chars"))


@registered(f"""SELECT 'message' AS kind, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, NULL::VARCHAR AS file, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 2
UNION ALL SELECT 'code_edit', 'assistant', 'f' || (turn % 4)::VARCHAR || '.py', count(*), 0 FROM conversations WHERE role = 'system' GROUP BY 3""")
def codex_transcripts(spark, sf_dir):
    """Messages as events, system turns as calls of an editing tool whose patch names the file."""
    c = _t(spark, sf_dir, "conversations")
    said = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.struct(F.when(F.col("role") == "user", "user_message").otherwise("agent_message").alias("type"), F.col("text").alias("message")).alias("payload")))
    patch = F.concat(F.lit("*** Begin Patch\n*** Update File: src/f"), (F.col("turn") % 4).cast("string"), F.lit(".py\n+x"))
    call = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("function_call").alias("type"), F.lit("apply_patch").alias("name"), F.to_json(F.struct(patch.alias("patch"))).alias("arguments")).alias("payload")))
    other = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("function_call").alias("type"), F.lit("shell").alias("name")).alias("payload")))
    lines = c.select(F.explode(F.when(F.col("role") == "system", F.array(call, other)).otherwise(F.array(said))).alias("value"))
    return _figures(transcripts.codex(_written(lines, _root(spark, "codex"), "x", spark)))


@registered(f"""WITH t AS (SELECT role, turn, trim(coalesce(text, ''), ' \t\n\r\f\v') AS x FROM conversations WHERE role IN ('user', 'assistant'))
SELECT 'message' AS kind, role, NULL::VARCHAR AS file, count(*) AS n, sum(length(x))::BIGINT AS chars FROM t WHERE x <> '' AND NOT (role = 'assistant' AND turn % 5 = 1) GROUP BY role
UNION ALL SELECT 'code_edit', 'assistant', 'm' || (turn % 3)::VARCHAR || '.ts', count(*), 0 FROM t WHERE role = 'assistant' AND turn % 5 = 1 GROUP BY 3""")
def cursor_transcripts(spark, sf_dir):
    """Questions in their wrapper, answers as parts; one answer in five is a call of an editing tool beside one that isn't."""
    c = _t(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    part = lambda text: F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<path:string>").alias("input"))
    use = lambda name, path: F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(name).alias("name"), F.struct(path.alias("path")).alias("input"))
    path = F.concat(F.lit("/w/m"), (F.col("turn") % 3).cast("string"), F.lit(".ts"))
    text = F.coalesce("text", F.lit(""))
    asked = F.concat(F.lit("<user_query>\n"), text, F.lit("\n</user_query>"))
    parts = F.when((F.col("role") == "user") & (X.strip(text) != ""), F.array(part(asked))).when((F.col("role") == "assistant") & (F.col("turn") % 5 == 1), F.array(use("StrReplace", path), use("Read", path))).otherwise(F.array(part(text)))
    lines = c.select(F.to_json(F.struct("role", F.struct(parts.alias("content")).alias("message"))).alias("value"))
    return _figures(transcripts.cursor(_written(lines, _root(spark, "cursor"), "x", spark)))


@registered("""SELECT 'message' AS kind, role, NULL::VARCHAR AS file, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY role
UNION ALL SELECT 'code_edit', 'assistant', 'a b' || (turn % 3)::VARCHAR || '.md', count(*), 0 FROM conversations WHERE role = 'system' AND turn % 2 = 0 GROUP BY 3""")
def antigravity_transcripts(spark, sf_dir):
    """Requests and answers as steps; system turns are views and code actions, those without a time are left out."""
    c = _t(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "USER_INPUT").when(F.col("role") == "assistant", "PLANNER_RESPONSE").when(F.col("turn") % 4 == 0, "VIEW_FILE").otherwise("CODE_ACTION")
    uri = F.concat(F.lit("file:///w/a%20b"), (F.col("turn") % 3).cast("string"), F.lit(".md"))
    said = F.when(F.col("role").isin("user", "assistant"), F.col("text")).when(F.col("turn") % 4 == 0, F.concat(F.lit("File Path: `"), uri, F.lit("`"))).otherwise(F.concat(F.lit("x\nModified file "), uri, F.lit(" now")))
    at = F.when((F.col("role") != "system") | (F.col("turn") % 2 == 0), "2024-01-01T00:00:00Z")
    lines = c.select(F.to_json(F.struct(kind.alias("type"), at.alias("created_at"), said.alias("content"), F.col("turn").alias("step_index"))).alias("value"))
    return _figures(transcripts.antigravity(_written(lines, _root(spark, "antigravity"), "x", spark)))


@registered("""SELECT 'artifact' AS kind, 'assistant' AS role, page_id::VARCHAR || '.md' AS file, 1::BIGINT AS n, least(length(html), 500)::BIGINT AS chars FROM pages WHERE page_id % 5 = 0 AND html <> ''""")
def artifact_notes(spark, sf_dir):
    """Pages as the markdown artifacts of a session, some in its folder, some below; other files aren't taken."""
    p = _t(spark, sf_dir, "pages").where("page_id % 5 = 0 and html <> ''")
    folder = F.when(F.col("page_id") % 2 == 0, F.lit("/s/artifacts/")).otherwise(F.lit("/s/"))
    at = F.lit("2024-01-01").cast("timestamp").alias("modified")
    notes_ = p.select(F.concat(folder, F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.col("html").alias("value"), at)
    others = p.select(F.concat(F.lit("/s/deep/er/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.col("html").alias("value"), at)
    return _figures(transcripts.artifacts(notes_.unionByName(others), "/s"))


@registered("""WITH o AS (SELECT l_orderkey AS session, l_linenumber AS epoch, l_partkey FROM lineitem WHERE l_partkey % 7 <> 0)
SELECT session::VARCHAR AS session, 'code_edit' AS kind, count(*) AS n, count(*) FILTER (epoch <= 3) AS marked FROM o GROUP BY session
UNION ALL SELECT l_orderkey::VARCHAR, 'checkpoint', 2, 2 FROM lineitem GROUP BY l_orderkey""")
def editing_session_states(spark, sf_dir):
    """Orders as editing sessions: their lines are operations, joined with the checkpoints of epochs 0 to 3 (0 isn't shown, 3 twice is one)."""
    line = lambda x: F.struct(
        F.when(x["l_partkey"] % 7 == 0, "create").otherwise("textEdit").alias("type"), F.concat(F.lit("file:///w/p"), x["l_partkey"].cast("string"), F.lit(".py")).alias("uri"), x["l_linenumber"].cast("long").alias("epoch"),
        F.array(F.struct(F.lit(" x ").alias("text"))).alias("edits"),
    )
    mark = lambda e: F.struct(F.lit(e).cast("long").alias("epoch"), F.lit(f"c{e}").alias("checkpointId"))
    held = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_linenumber")).alias("lines"))
    ops = held.select("l_orderkey", F.transform("lines", line).alias("operations"))
    first = F.array(F.array(F.lit("file:///w/start.py"), F.lit("t")))
    state = F.to_json(F.struct(F.struct(F.array(mark(0), mark(1), mark(2)).alias("checkpoints"), "operations").alias("timeline"), first.alias("initialFileContents")))
    got = transcripts.editing_sessions(ops.select(F.col("l_orderkey").cast("string").alias("session"), F.lit("2024-01-01").cast("timestamp").alias("ts"), state.alias("value")))
    marked = F.count(F.when((F.col("kind") == "checkpoint") | (F.col("extras")["epoch"].cast("int") <= 3), 1))
    return got.groupBy(F.col("extras")["sessionId"].alias("session"), "kind").agg(F.count("*").alias("n"), marked.alias("marked"))


@registered("""WITH h AS (SELECT o_custkey AS dir, o_orderkey AS id, o_orderdate AS ts, o_orderstatus || chr(10) || o_orderpriority AS content FROM orders),
l AS (SELECT *, coalesce(lag(content) OVER (PARTITION BY dir ORDER BY ts, id), '') AS old FROM h)
SELECT dir, id, '--- a/x.py' || chr(10) || '+++ b/x.py' || CASE WHEN old = '' THEN '' ELSE chr(10) || '-' || replace(old, chr(10), chr(10) || '-') END || chr(10) || '+' || replace(content, chr(10), chr(10) || '+') AS diff FROM l""")
def history_snapshots(spark, sf_dir):
    """A customer's orders as the editor's history of a folder: each snapshot's diff to the one before it."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dir"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.lit("/w/x.py").alias("path"), F.concat("o_orderstatus", F.lit("\n"), "o_orderpriority").alias("content"))
    return notes.snapshots(o).select("dir", "id", "diff")


@registered("SELECT part, count(*)::BIGINT AS n FROM (SELECT 'p' || (doc_id % 3)::VARCHAR || '/f.jsonl' AS part FROM documents WHERE doc_id % 3 < 2) GROUP BY part")
def listed_files(spark, sf_dir):
    """Files found below a folder by their names, and how many lines each has; the newest is one of them."""
    root = _root(spark, "listed")
    d = _t(spark, sf_dir, "documents").select(F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("p"), F.to_json(F.struct("doc_id")).alias("value"))
    d.write.partitionBy("p").text(root)
    files = notes.listed(spark, root, "*.txt")
    newest = notes.newest(files).join(files, "path")  # one row, of a file that is there
    lines = transcripts.read_lines(spark, root, "*.txt")
    part = F.concat(F.regexp_extract("path", r"/p=(p\d)/", 1), F.lit("/f.jsonl"))
    held = lines.join(files.select("path"), "path", "left_semi").groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    return held.where("part < 'p2'") if newest.count() == 1 else held.limit(0)


@registered("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT max(conv_id) AS conv_id FROM c WHERE conv_id % 2 = 0""")
def session_of_workspace(spark, sf_dir):
    """Of all conversations as transcripts, the newest that was begun in the workspace (every other one was)."""
    c = _t(spark, sf_dir, "conversations")
    cwd = F.when(F.col("conv_id") % 2 == 0, "/w/app/sub").otherwise("/w/application")
    value = F.when(F.col("turn") == 0, F.to_json(F.struct(cwd.alias("cwd")))).otherwise(F.lit("{}"))
    lines = c.select(F.concat(F.lit("/t/"), F.lpad(F.col("conv_id").cast("string"), 12, "0")).alias("path"), F.col("turn").alias("pos"), value.alias("value"), F.timestamp_seconds("conv_id").alias("modified"))
    first = c.groupBy("conv_id").agg(F.min("turn").alias("t"))
    begun = first.select(F.concat(F.lit("/t/"), F.lpad(F.col("conv_id").cast("string"), 12, "0")).alias("path"), (F.col("t") - 1).alias("pos"), F.to_json(F.struct(F.when(F.col("conv_id") % 2 == 0, "/w/app/sub").otherwise("/w/application").alias("cwd"))).alias("value"), F.timestamp_seconds("conv_id").alias("modified"))
    return notes.session_of(lines.unionByName(begun), "/w/app").select(F.substring("path", 4, 20).cast("long").alias("conv_id"))


@registered("""SELECT o_orderkey, to_timestamp(o_orderkey)::TIMESTAMP AS ts, 'order ' || o_orderkey::VARCHAR AS subject, (SELECT list('p' || l_partkey::VARCHAR ORDER BY l_linenumber, 'p' || l_partkey::VARCHAR) FROM lineitem WHERE l_orderkey = o_orderkey) AS files
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""".replace("to_timestamp(o_orderkey)::TIMESTAMP", "make_timestamp(o_orderkey * 1000000)"))
def commit_log(spark, sf_dir):
    """Orders as commits that name their parts as files."""
    key = F.lpad(F.hex("o_orderkey"), 10, "0")
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    path = F.concat(F.lit("log"), (F.col("o_orderkey") % 50).cast("string")).alias("path")
    place = lambda n: (F.col("o_orderkey") * 100 + n).alias("pos")
    heads = o.select(path, place(F.lit(0)), F.concat(F.lower(key), F.lit("|"), F.col("o_orderkey").cast("string"), F.lit("|order "), F.col("o_orderkey").cast("string")).alias("value"))
    files = _t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").select(path, place(F.col("l_linenumber")), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("value"))
    got = notes.commits(heads.unionByName(files))
    return got.select(F.conv("hash", 16, 10).cast("long").alias("o_orderkey"), F.col("ts").cast("timestamp_ntz").alias("ts"), "subject", "files")


@registered("""SELECT string_agg(source, ',' ORDER BY source) AS names, sum(n)::BIGINT AS events FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND right(source, 1) IN ('1', '3') GROUP BY source)""")
def connected_agents(spark, sf_dir):
    """Sources as agents, of which some are connected."""
    d = _t(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("events"))
    agents = documents.connected(d.withColumn("status", F.when(F.right("name", F.lit(1)).isin("1", "3"), "connected").otherwise("waiting")).withColumn("connected", F.lit("2024-01-01")))
    return spark.createDataFrame([(",".join(a["name"] for a in agents), sum(a["events"] for a in agents))], "names string, events long")


@registered(f"""WITH {_BM25}, i AS (SELECT doc_id, bm25 FROM b JOIN documents USING (doc_id) WHERE source IS NULL OR source = '' OR source = 'src1'), m AS (SELECT max(bm25) AS top FROM b)
SELECT doc_id AS id, author FROM (SELECT doc_id, source AS author FROM documents) JOIN i USING (doc_id)""")
def seen_by_agent(spark, sf_dir):
    n = retrieve.seen_by(_nodes(spark, sf_dir), "src1")
    return n.select("id", "author")


def _vector_sql() -> str:
    from .more import retrieve_ranked  # its SQL, with the cosine of the document's vector mixed in
    from .catalogue import ORACLES

    base = ORACLES[retrieve_ranked.__name__]
    rel = "bm25 / greatest(top, 1e-9) * (len(list_intersect(['the', 'that', 'of'], tok)) / 3.0::DOUBLE) AS rel"
    mixed = "CASE WHEN v IS NULL THEN bm25 / greatest(top, 1e-9) * (len(list_intersect(['the', 'that', 'of'], tok)) / 3.0::DOUBLE) ELSE 0.5::DOUBLE * (bm25 / greatest(top, 1e-9) * (len(list_intersect(['the', 'that', 'of'], tok)) / 3.0::DOUBLE)) + 0.5::DOUBLE * greatest(0.0::DOUBLE, list_cosine_similarity(v, asked)) END AS rel"
    assert rel in base
    return base.replace(rel, mixed).replace("FROM nodes JOIN b ON doc_id = id CROSS JOIN m", "FROM nodes JOIN b ON doc_id = id CROSS JOIN m CROSS JOIN (SELECT embedding::DOUBLE[] AS asked FROM embeddings ORDER BY vec_id LIMIT 1) LEFT JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) ON vec_id = id")


@registered(_vector_sql())
def retrieve_with_vectors(spark, sf_dir):
    """The retriever with a query vector: nodes that have one are ranked by both."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    first = e.orderBy("id").limit(1).collect()
    query = F.array(*[F.lit(float(x)) for x in first[0]["vector"]]) if first else F.array().cast("array<double>")
    got = retrieve.retrieve(_nodes(spark, sf_dir), _links(spark, sf_dir), QUERY, F.lit(NOW).cast("timestamp"), query_vector=query, vectors=e)
    return got.select("id", "score", "seed", "depth", F.col("components.relevance").alias("relevance"))


@registered(f"""WITH {_NODES}, r AS (SELECT author, (count(*) - count(*) FILTER (status = 'superseded') + 1)::DOUBLE / (count(*) + 2) AS reputation FROM nodes WHERE type = 'Decision' AND author <> '' GROUP BY author),
f AS (SELECT id, {_R3.format("confidence")} AS c, {_R3.format("importance")} AS i, {_R3.format("exp(-0.01::DOUBLE * age)")} AS fr, {_R3.format("(CASE WHEN type = 'Decision' THEN coalesce(reputation, 1.0::DOUBLE) ELSE 1.0::DOUBLE END)")} AS rp FROM nodes LEFT JOIN r USING (author))
SELECT id, {_R3.format("(c * i * fr * rp)")} AS score FROM f ORDER BY c * i * fr * rp DESC, id LIMIT 8""")
def retrieve_nothing_asked(spark, sf_dir):
    """An empty query ranks by worth alone."""
    got = retrieve.retrieve(_nodes(spark, sf_dir), _links(spark, sf_dir), " ", F.lit(NOW).cast("timestamp"), hops=0)
    return got.select("id", "score")


@registered(f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
c AS (SELECT a.id AS query, b.id AS id, list_cosine_similarity(a.v, b.v) AS cosine FROM v a JOIN v b ON a.id <> b.id AND a.id % 50 = 0)
SELECT query, rank, id, {_R6.format("cosine")} AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id)::INT AS rank FROM c) WHERE rank <= 10""")
def vector_topk_cells(spark, sf_dir):
    """Every fiftieth vector asks all others through cells and codes; what is proposed is ranked exactly, and all audited queries must be right."""
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = cells.build(v, cells.Setting(recall=1.0))
    asked = v.where("id % 50 = 0").withColumnRenamed("id", "query")
    return cells.search(index, asked, 10).select("query", "rank", "id", X.round6(F.col("cosine")).alias("cosine"))


_LINE = "'- [' || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE ' ' END || '] ' || p_name"


@registered(f"""WITH n AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS path, p_partkey, p_name, {_LINE} AS line FROM part WHERE p_name IS NOT NULL)
SELECT 'task' AS sort, path, line FROM (SELECT path, line FROM n ORDER BY path LIMIT 12)
UNION ALL SELECT 'decision', path, line FROM (SELECT path, CASE WHEN p_partkey % 2 = 0 THEN '- ' || p_name ELSE line END AS line FROM n WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0 ORDER BY path LIMIT 10)""")
def brief_lines(spark, sf_dir):
    """Open work from notes: the first task lines; bullets under the open heading, or unticked boxes where there is none."""
    p = _t(spark, sf_dir, "part").where("p_name is not null")
    box = F.concat(F.lit("- ["), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(" "), F.lit("] "), "p_name")
    note = F.concat(F.lit("# T\n## Tasks\n"), box, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\n## Open\n- "), "p_name")).otherwise(F.lit("")))
    rows = notes.note_lines(p.select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("path"), note.alias("value")))
    tasks = brief.task_lines(rows.where("heading = 'tasks'"))
    return tasks.select(F.lit("task").alias("sort"), "path", "line").unionByName(brief.open_decision_lines(rows).select(F.lit("decision").alias("sort"), "path", "line"))


@registered("""SELECT doc_id, CASE WHEN length(x) > 120 THEN left(x, 119) || '…' ELSE x END AS section FROM (SELECT doc_id, trim(coalesce(text, ''), ' \t\n\r\f\v') AS x FROM documents) WHERE NOT starts_with(x, '#')""")
def note_sections(spark, sf_dir):
    """Notes without their titles, cut."""
    d = _t(spark, sf_dir, "documents").select("doc_id", X.strip(F.coalesce("text", F.lit(""))).alias("x")).where("not startswith(x, '#')")
    return d.select("doc_id", brief.section_text(F.concat(F.lit("# Title of it\n\n"), "x"), 120).alias("section"))


@registered("SELECT p_partkey, 'Task [open]: ' || CASE WHEN length(trim(p_name)) > 80 THEN left(trim(p_name), 79) || '…' ELSE trim(p_name) END || '' AS task, CASE WHEN p_partkey % 2 = 0 THEN 'Decision (current): ' || trim(p_name) || chr(10) || 'History: ' || CASE WHEN length(trim(p_type)) > 24 THEN left(trim(p_type), 23) || '…' ELSE trim(p_type) END || ' → (current)' ELSE 'Decision: ' || trim(p_name) END AS decision FROM part")
def rendered_blocks(spark, sf_dir):
    """Blocks of a context: a task, and a decision with what it replaced (its date isn't shown)."""
    p = _t(spark, sf_dir, "part")
    history = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("2024-01-01 — "), "p_type")))
    kinds = p.select("p_partkey", F.col("p_name").alias("text"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("kind"), history.alias("history"), F.lit(None).cast("array<string>").alias("none"))
    task = context.block("t", "none")
    rows = kinds.withColumn("t", F.lit("Task")).withColumn("d", F.lit("Decision"))
    return rows.select("p_partkey", task.alias("task"), context.block("d", "history").alias("decision"))


@registered(f"WITH {_TIMELINE} SELECT count(*) AS events, max(ts)::TIMESTAMP AS last, (SELECT count(DISTINCT source) FROM t WHERE source IN ('1', '2')) AS connected_agents FROM t")
def project_figures(spark, sf_dir):
    t = _timeline(spark, sf_dir)
    agents = t.select("source").distinct().withColumn("status", F.when(F.col("source").isin("1", "2"), "connected").otherwise("waiting"))
    return brief.project_figures(t, agents).select("events", F.col("last").cast("timestamp_ntz").alias("last"), F.col("connected_agents").cast("long").alias("connected_agents"))


@registered("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS total FROM orders) SELECT o_orderkey FROM o WHERE n % greatest(1, total // 40) = 0 ORDER BY n LIMIT 40""")
def strided_sample(spark, sf_dir):
    """A sampling operator: rows at equal steps in the order of their key."""
    return brief.strided(_t(spark, sf_dir, "orders").select("o_orderkey"), 40, "o_orderkey")


@registered("""WITH t AS (SELECT ts, event_id AS pos, 'file:' || user_id::VARCHAR AS f FROM events), g AS (SELECT *, (ts - lag(ts) OVER (ORDER BY ts, pos) > INTERVAL 30 MINUTE)::INT AS b FROM t),
s AS (SELECT *, coalesce(sum(b) OVER (ORDER BY ts, pos ROWS UNBOUNDED PRECEDING), 0) AS k FROM g), d AS (SELECT k, f, min(pos) AS first FROM s GROUP BY k, f), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY first, f) AS rn FROM d),
p AS (SELECT DISTINCT least(a.f, b.f) AS "from", greatest(a.f, b.f) AS "to" FROM r a JOIN r b ON a.k = b.k AND a.rn < b.rn WHERE b.rn <= 10)
SELECT "from", "to" FROM p WHERE (right("from", 1)::INT + right("to", 1)::INT) % 2 = 1""")
def new_coedits(spark, sf_dir):
    """Pairs of files of a session that have no edge yet, whichever way round that is."""
    t = _timeline(spark, sf_dir).select("ts", "pos", "path")
    ends = ingest.new_co_edits(t, spark.createDataFrame([], "`from` string, `to` string, relation string"))
    odd = (F.right("from", F.lit(1)).cast("int") + F.right("to", F.lit(1)).cast("int")) % 2 == 1
    known = ends.where(~odd).select(F.col("to").alias("from"), F.col("from").alias("to"), F.lit("CO_EDITED").alias("relation"))
    return ingest.new_co_edits(t, known).select("from", "to")


@registered("SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1")
def stream_days(spark, sf_dir):
    """Events by day as a stream: days before the last are closed (and all others that the watermark has passed)."""
    root = _root(spark, "days")
    e = _t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{root}/source")
    stream = spark.readStream.schema(e.schema).parquet(f"{root}/source")
    sessions.written(sessions.by_day(stream, "0 seconds"), f"{root}/out", f"{root}/checkpoint")
    out = spark.read.schema("day timestamp, n long").parquet(f"{root}/out").select(F.col("day").cast("timestamp_ntz").alias("day"), "n")
    return out.where(F.col("day") < F.lit(e.agg(F.date_trunc("day", F.max("ts"))).first()[0]).cast("timestamp_ntz"))


@registered("""WITH d AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT (SELECT count(*) FROM events) AS events, 12::BIGINT AS tasks, (SELECT string_agg(source, ',' ORDER BY source) FROM d WHERE source IN ('src1', 'src2')) AS agents,
(SELECT count(*) FROM (SELECT 1 FROM events WHERE event_type IN ('click', 'purchase') LIMIT 5)) + (SELECT count(*) FROM (SELECT 1 FROM events WHERE event_type = 'view' LIMIT 3)) AS shown""")
def context_as_document(spark, sf_dir):
    """The context document and its brief, written as JSON and markdown and read back."""
    import json

    none = F.lit(None).cast("string")
    t = _timeline(spark, sf_dir).withColumn("file", none).withColumn("summary", none).withColumn("content", F.col("event_type")).withColumn("diff", none)
    agents = _t(spark, sf_dir, "documents").where("source in ('src1', 'src2')").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("events")).withColumn("status", F.lit("connected")).withColumn("connected", none)
    project = documents.Project("w", NOW, agents=documents.connected(agents))
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("- [ ] "), F.coalesce("p_name", F.lit("x"))).alias("value"))
    lines, root = notes.note_lines(p), _root(spark, "document")
    doc = documents.context_document(project, t, lines, lines)
    documents.write(spark, doc, documents.context_markdown(doc), f"{root}/context")
    told = documents.brief_document(project, t, {"tasks": "- [ ] x"})
    documents.write(spark, told, documents.brief_markdown(told), f"{root}/brief")
    read = lambda name: json.loads(spark.read.parquet(f"{root}/{name}/json").first()["value"])
    got, short = read("context"), read("brief")
    text = spark.read.parquet(f"{root}/context/markdown").first()["value"] + spark.read.parquet(f"{root}/brief/markdown").first()["value"]
    agents_ = ",".join(a["name"] for a in got["agents"] if f"**{a['name']}**" in text)
    return spark.createDataFrame([(short["events"], len(got["tasks"]), agents_, len(got["events"]))], "events long, tasks long, agents string, shown long")


@registered("""WITH h AS (SELECT o_custkey AS dir, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS id, o_orderstatus || o_orderpriority AS content, o_orderkey % 4 = 0 AS lost FROM orders),
l AS (SELECT *, lag(content) OVER w AS old, lag(lost) OVER w AS old_lost FROM h WINDOW w AS (PARTITION BY dir ORDER BY n))
SELECT 'c' || dir::VARCHAR || '.py' AS file, id::VARCHAR AS id, CASE WHEN id % 3 = 0 THEN 'Undo' ELSE 'Local History snapshot' END AS summary, CASE WHEN NOT lost AND NOT old_lost AND old <> content THEN length('--- a/c' || dir::VARCHAR || '.py' || chr(10) || '+++ b/c' || dir::VARCHAR || '.py' || chr(10) || '-' || old || chr(10) || '+' || content) END AS diff
FROM l WHERE dir % 2 = 0""")
def editor_history(spark, sf_dir):
    """Customers as folders of an editor's history, orders as snapshots (one in four is lost); those of odd customers lie outside the workspace.
    Their times are real ones: an entry of time 0 counts as one without a time."""
    o = _t(spark, sf_dir, "orders")
    key, folder = F.col("o_orderkey").cast("string"), F.concat(F.lit("/h/"), F.col("o_custkey").cast("string"), F.lit("/"))
    entry = F.struct(key.alias("id"), (F.col("o_orderkey") + 1_700_000_000_000).alias("timestamp"), F.when(F.col("o_orderkey") % 3 == 0, "Undo").alias("source"))
    where = F.when(F.col("o_custkey") % 2 == 0, F.lit("file:///w/app/c")).otherwise(F.lit("file:///w/apple/c"))
    told = o.groupBy("o_custkey").agg(F.collect_list(entry).alias("entries")).select(F.concat(folder, F.lit("entries.json")).alias("path"), F.to_json(F.struct(F.concat(where, F.col("o_custkey").cast("string"), F.lit(".py")).alias("resource"), "entries")).alias("value"))
    held = o.where("o_orderkey % 4 <> 0").select(F.concat(folder, key).alias("path"), F.concat("o_orderstatus", "o_orderpriority").alias("value"))
    none = spark.createDataFrame([], "path string, pos long, value string, modified timestamp")
    got = transcripts.cursor_with_history(none, told.unionByName(held), "/w/app")
    return got.select("file", F.col("extras")["historyId"].alias("id"), "summary", F.length("diff").cast("long").alias("diff"))


@registered("""WITH g AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR)::INT AS b FROM events), s AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS k FROM g)
SELECT user_id, arg_max(event_id, {ts: ts, event_id: event_id}) AS event_id, count(*) AS changes FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""")
def stream_bursts(spark, sf_dir):
    """The last change of each burst, by a stream over files that are taken two at a time, in the order of their days."""
    root = _root(spark, "bursts")
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    e.repartitionByRange(6, "ts").write.parquet(f"{root}/source")
    stream = spark.readStream.schema(e.schema).parquet(f"{root}/source")
    sessions.written(sessions.bursts(stream, "user_id", "6 hours").select("user_id", "event_id", "changes"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema("user_id bigint, event_id bigint, changes bigint").parquet(f"{root}/out")


_NAMES = ("Zoe", "émile", "Emil", "emil", "Äda", "ada", "zoe", "Bo")


@registered("""WITH n AS (SELECT unnest(['ada', 'Äda', 'Bo', 'emil', 'Emil', 'émile', 'zoe', 'Zoe']) AS source, unnest(range(8)) AS rank), e AS (SELECT event_id, (['Zoe', 'émile', 'Emil', 'emil', 'Äda', 'ada', 'zoe', 'Bo'])[event_id % 8 + 1] AS source FROM events)
SELECT event_id AS pos, source FROM e JOIN n USING (source) ORDER BY rank, event_id LIMIT 3000""")
def locale_order(spark, sf_dir):
    """Rows of one time are ordered by their source as readers sort names, not by code points."""
    source = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 8 + 1).cast("int"))
    t = _t(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.lit(None).cast("timestamp").alias("ts"), F.lit("message").alias("kind"), F.lit("user").alias("role"), source.alias("source"))
    return timeline.page(t, timeline.order_keys(), 3000).select("pos", "source")


@registered(f"WITH {_TIMELINE} SELECT (SELECT count(*) FROM t WHERE kind IN ('code_edit', 'artifact')) AS total, pos FROM t WHERE kind IN ('code_edit', 'artifact') ORDER BY ts, pos LIMIT 25 OFFSET 50")
def page_with_total(spark, sf_dir):
    total, rows = timeline.paged(timeline.filtered(_timeline(spark, sf_dir), "code_edit"), [F.col("ts"), F.col("pos")], 25, 50)
    return rows.select(F.lit(total).cast("long").alias("total"), "pos")


def _messages(spark, sf_dir) -> DataFrame:
    """Conversations as timeline rows, a second apart."""
    c = _t(spark, sf_dir, "conversations")
    pos = F.col("conv_id") * 1000 + F.col("turn")
    none = F.lit(None).cast("string")
    return c.select(pos.alias("pos"), F.timestamp_seconds(pos).alias("ts"), F.lit("message").alias("kind"), "role", F.lit("talk").alias("source"), F.col("text").alias("content"), none.alias("file"), none.alias("path"), none.alias("summary"), none.alias("diff"))


_LAST = "t AS (SELECT conv_id * 1000 + turn AS pos, role, text FROM conversations)"


@registered(f"""WITH {_LAST}, k AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY pos DESC) AS rn FROM t)
SELECT pos, role, CASE WHEN length(x) > 320 THEN left(x, 319) || '…' ELSE x END AS content FROM (SELECT *, trim(coalesce(text, ''), ' \t\n\r\f\v') AS x FROM k) WHERE (role = 'user' AND rn <= 6) OR (role = 'assistant' AND rn <= 4)""")
def recent_messages(spark, sf_dir):
    """The last messages of users and assistants, as a context shows them."""
    rows = _messages(spark, sf_dir)
    shown = documents.event_rows(rows)
    return brief.recent(rows).select("pos", "role", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts")).join(shown.select("ts", "role", "content"), ["ts", "role"]).select("pos", "role", "content")


@registered(f"""WITH {_LAST}, n AS (SELECT * FROM t ORDER BY pos DESC LIMIT 60),
l AS (SELECT left(string_split(trim(text, ' \t\n\r\f\v'), chr(10))[1], 200) AS line, min(pos) AS first FROM n WHERE role = 'user' AND length(trim(text, ' \t\n\r\f\v')) >= 8 GROUP BY 1)
SELECT 'task' AS sort, '- [ ] ' || line AS line FROM (SELECT line FROM l ORDER BY first DESC LIMIT 5) UNION ALL
SELECT 'decision', '- [ ] ' || line FROM (SELECT line FROM l WHERE regexp_matches(line, '\\?\\s*$') OR regexp_matches(lower(line), '(^|[^a-z0-9_])(should we|decide|or )') ORDER BY first DESC LIMIT 8)""")
def drawn_note_lines(spark, sf_dir):
    """Tasks and questions drawn from what users said last."""
    tasks, decisions = brief.drawn_notes(_messages(spark, sf_dir))
    return tasks.select(F.lit("task").alias("sort"), "line").unionByName(decisions.select(F.lit("decision").alias("sort"), "line"))


@registered("SELECT doc_id, CASE WHEN lang IS NULL OR doc_id % 3 = 0 THEN coalesce(text, '') WHEN text IS NULL THEN lang ELSE text || ' ' || lang END AS found_by FROM documents")
def search_texts(spark, sf_dir):
    """What a node is found by: its text and its kind, where it has one."""
    d = _t(spark, sf_dir, "documents").withColumn("kind", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    return d.select("doc_id", retrieve.search_text().alias("found_by"))


@registered(f"""WITH {_NODES}, seeds AS (SELECT id, 1.0::DOUBLE - 0.01::DOUBLE * id AS v, [id] AS path FROM nodes WHERE id < 8),
adj AS (SELECT "from" AS a, "to" AS b FROM links UNION ALL SELECT "to", "from" FROM links),
h1 AS (SELECT b AS id, max(v * 0.5::DOUBLE * 0.6::DOUBLE) AS v, arg_max(list_append(path, b), v) AS path FROM seeds JOIN adj ON a = id GROUP BY b), f1 AS (SELECT h1.* FROM h1 LEFT JOIN seeds s USING (id) WHERE s.v IS NULL OR h1.v > s.v),
b1 AS (SELECT *, 1 AS depth FROM f1 UNION ALL SELECT *, 0 FROM seeds WHERE id NOT IN (SELECT id FROM f1)),
h2 AS (SELECT b AS id, max(v * 0.5::DOUBLE * 0.36::DOUBLE) AS v, arg_max(list_append(path, b), v) AS path FROM f1 JOIN adj ON a = id GROUP BY b), f2 AS (SELECT h2.* FROM h2 LEFT JOIN b1 USING (id) WHERE b1.v IS NULL OR h2.v > b1.v),
z AS (SELECT *, 2 AS depth FROM f2 UNION ALL SELECT * FROM b1 WHERE id NOT IN (SELECT id FROM f2))
SELECT id, array_to_string(path, '>') AS path, CASE WHEN depth > 0 THEN 'SERVES' END AS relation, depth FROM z""")
def traversal_paths(spark, sf_dir):
    """How the traversal came to each id, and by which relation last."""
    seeds = _nodes(spark, sf_dir).where("id < 8").select("id", (1.0 - 0.01 * F.col("id")).alias("value"))
    got = graph.traverse(seeds, _links(spark, sf_dir))
    return got.select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "relation", "depth")


@registered(f"""WITH RECURSIVE r AS MATERIALIZED ({ORACLES["retrieve_ranked"]}), t AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'Decision' ELSE 'Goal' END AS type, trim(coalesce(text, ''), ' \t\n\r\f\v') AS x FROM documents),
c AS (SELECT id, score, ceil(length(type || ': ' || CASE WHEN length(x) > 80 THEN left(x, 79) || '…' ELSE x END) / 4.0::DOUBLE)::BIGINT AS cost FROM r JOIN t USING (id) WHERE score >= 0.02),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM c),
f AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS used, []::BIGINT[] AS ids UNION ALL SELECT o.rn, CASE WHEN used + cost <= 800 THEN used + cost ELSE used END, CASE WHEN used + cost <= 800 THEN list_append(ids, o.id) ELSE ids END FROM f JOIN o ON o.rn = f.rn + 1)
SELECT arg_max(used, rn) AS used, array_to_string(list_sort(arg_max(ids, rn)), ',') AS included, max(rn) - len(arg_max(ids, rn)) AS dropped FROM f""")
def compile_small(spark, sf_dir):
    """A whole context of the small profile: retrieved, collapsed, weighed against the score floor, filled and rendered."""
    edges = _links(spark, sf_dir).withColumn("pos", F.col("from"))
    got = context.compile_tier(_nodes(spark, sf_dir), edges, "small", QUERY, F.lit(NOW).cast("timestamp"))
    return spark.createDataFrame([(got.used, ",".join(str(i) for i in sorted(got.included)), got.dropped)], "used long, included string, dropped long")
