"""Context compilation: agent weights, collapsed chains, a greedy token budget, rendered blocks.

Ranking and collapsing are distributed; what goes into a budget is a top-k by score, so the greedy fill is a fold over one
sorted array of bounded length, inside Spark, and only the finished text comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import constants as C
from . import fold, graph, retrieve
from .staging import staged


def weight_rows(spark: SparkSession, agent: str) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in C.AGENT_WEIGHTS.get(agent, {}).items()], "type string, agent_weight double")


def weighted(items: DataFrame, agent: str | None) -> DataFrame:
    """Scores times the agent's weight of the type (a table of six rows); unknown agents and types change nothing."""
    if agent not in C.AGENT_WEIGHTS:
        return items
    return items.join(F.broadcast(weight_rows(items.sparkSession, agent)), "type", "left").withColumn("score", F.col("score") * F.coalesce("agent_weight", F.lit(1.0))).drop("agent_weight")


def fill(items: DataFrame, budget: int, by: str | None = None, tie: list[str] | None = None) -> DataFrame:
    """ids and tokens that fit into ``budget``, best score first; an item that doesn't fit is skipped, not a stop.

    ``items``: id, cost, score; items without a score come last, those without a cost are dropped. Equal scores are ordered by
    the columns ``tie``, then by id. If the first item alone is too long, it is taken, cut to the budget. With ``by``, each
    group has a budget of its own. Only contenders (see there) are gathered, and a fold goes over them once.
    """
    group = by or "_all"
    tie = tie or []
    rows = items.select(*([by] if by else [F.lit(0).alias("_all")]), "id", F.col("cost").cast("long").alias("cost"), "score", *tie)
    rank = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("s"), *tie, "id", "cost")
    heads = rows.groupBy(group).agg(F.count("*").alias("_n"), F.min(rank).alias("_head"))
    kind = f"struct<used:bigint,ids:array<{dict(items.dtypes)['id']}>>"

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["ids"], F.array(x["id"]))).otherwise(s["ids"]).alias("ids")).cast(kind)

    start = F.struct(F.lit(0).alias("used"), F.array().alias("ids")).cast(kind)
    folded = _contenders(rows, budget, group, tie).groupBy(F.col(group).alias("_by")).agg(F.array_sort(F.collect_list(rank)).alias("rows"))
    out = heads.join(folded.select("_by", F.aggregate("rows", start, step).alias("state")), F.col(group).eqNullSafe(F.col("_by")), "left")
    alone = F.coalesce(F.col("_head.cost") > budget, F.lit(False))
    used = F.when(alone, F.lit(budget)).otherwise(F.coalesce("state.used", F.lit(0))).cast("long")
    ids = F.when(alone, F.array("_head.id")).otherwise(F.coalesce("state.ids", F.array().cast(kind.split("ids:")[1][:-1])))
    return out.select(*([by] if by else []), used.alias("used"), ids.alias("ids"), (F.col("_n") - F.size(ids)).alias("dropped"))


def _contenders(rows: DataFrame, budget: int, by: str, tie: list[str], salts: int = 64) -> DataFrame:
    """The rows that a fill can take at all: of a cost, only the first ``budget // cost`` of a group.

    Once a row of a cost doesn't fit, no later one of that cost does, as what is used only grows. So a group keeps about
    ``budget * ln(budget)`` rows at most, besides those that cost nothing. A busy group is pruned in salted parts first.
    """
    most = F.when(F.col("cost") > 0, F.floor(F.lit(budget) / F.col("cost"))).when(F.col("cost") <= 0, F.lit(2**31))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    for keys in ((by, "cost", "_salt"), (by, "cost")):
        rows = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), *tie, "id"))).where(F.col("_rn") <= most)
    return rows.drop("_salt", "_rn")


def block(row_type: str = "type", history: str = "history") -> Column:
    """The text of an item; ``history`` holds the display texts of what it replaced, oldest first (or null)."""
    t = X.truncated(F.col("text"), C.TEXT_LIMIT)
    kind = F.col(row_type)
    old = F.array_join(F.transform(F.col(history), lambda x: X.truncated(X.without_date(x), C.HISTORY_LIMIT)), " → ")
    plain = (
        F.when(kind == "Task", F.concat(F.lit("Task ["), F.col("status"), F.lit("]: "), t))
        .when(kind == "Evidence", F.concat(F.lit("Evidence ("), F.coalesce("kind", F.lit("link")), F.lit("): "), t))
        .when(kind == "File", F.concat(F.lit("File touched: "), X.truncated(F.col("text"), C.FILE_LIMIT)))
        .otherwise(F.concat(kind, F.lit(": "), t))
    )
    return F.when(F.size(F.coalesce(F.col(history), F.array().cast("array<string>"))) > 0, F.concat(kind, F.lit(" (current): "), t, F.lit("\nHistory: "), old, F.lit(" → (current)"))).otherwise(plain)


@dataclass(frozen=True)
class Context:
    text: str
    included: list[str]
    dropped: int
    used: int
    budget: int


def collapsed(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Heads of the chains among the items, with the texts of what they replaced as ``history`` (oldest first); the rest of a
    chain goes. Edges of items that aren't there don't count."""
    steps = graph.chains(edges, items).select("head", F.posexplode("chain").alias("at", "id")).where("at > 0").join(items.select("id", F.col("text").alias("old_text")), "id")
    ended = steps.groupBy("head").agg(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("o"), F.coalesce("old_text", F.col("id")).alias("old_text"), F.col("id").alias("old_id")))).alias("olds"))
    out = items.join(ended.select(F.col("head").alias("id"), "olds"), "id", "left").join(steps.select("id").distinct(), "id", "left_anti")
    return out.withColumn("history", F.transform("olds", lambda x: x["old_text"])).withColumn("absorbed", F.transform("olds", lambda x: x["old_id"])).drop("olds")


def blocks_of(items: DataFrame, edges: DataFrame | None, profile: str = "default", agent: str | None = None) -> DataFrame:
    """The items that compete for a profile's budget, with ``block``, ``cost`` and ``absorbed``."""
    rows = weighted(items, agent)
    none = F.lit(None).cast("array<string>")
    rows = collapsed(rows, edges) if edges is not None else rows.withColumn("history", none).withColumn("absorbed", none)
    if profile != "tiny":
        rows = rows.where(F.col("score") >= C.SCORE_FLOOR)
    return rows.withColumn("block", block()).withColumn("cost", X.token_cost(F.col("block")))


def compiled(items: DataFrame, edges: DataFrame | None, profile: str = "default", agent: str | None = None) -> Context:
    """The context text of a profile: a greedy fill of the best blocks, rendered best first. Unknown profiles are the default."""
    budget = C.TIERS.get(profile, C.TIERS["default"])
    tie = [c for c in TIE if c in items.columns]
    rows = staged(blocks_of(items, edges, profile, agent).select("id", "block", "cost", "score", "absorbed", *tie), "blocks")
    filled = fill(rows, budget, tie=tie).first()
    if not filled or not filled["ids"]:
        return Context("", [], 0, 0, budget)
    shown = F.when(F.col("cost") > budget, X.truncated(F.col("block"), max(20, 4 * budget))).otherwise(F.col("block")).alias("block")
    chosen = {r["id"]: r for r in rows.where(F.col("id").isin(list(filled["ids"]))).select("id", shown, "absorbed").collect()}
    included = list(dict.fromkeys(x for i in filled["ids"] for x in [i, *(chosen[i]["absorbed"] or [])]))
    return Context("\n\n".join(chosen[i]["block"] for i in filled["ids"]), included, filled["dropped"], filled["used"], budget)


#: What orders items of one score, where a table has it: their part of the working memory, then their birth.
TIE = ("place", "born_at", "born_pos")


def memory_items(nodes: DataFrame) -> DataFrame:
    """The working memory as items: an item's score is its importance; goals come before tasks, decisions and blockers."""
    place = F.array_position(F.array(*map(F.lit, ("goals", "tasks", "decisions", "blockers"))), F.col("bucket"))
    return fold.working_memory(nodes).withColumn("score", F.coalesce("importance", F.lit(1.0))).withColumn("place", place)


def compile_many(items: DataFrame, edges: DataFrame | None, by: str, profile: str = "default") -> DataFrame:
    """(by, text, ids, used, dropped): the contexts of many queries in one plan, a budget each. ``items`` have a row for each item of each query."""
    budget = C.TIERS.get(profile, C.TIERS["default"])
    own = F.concat_ws("\x1f", F.col(by).cast("string"), F.col("id").cast("string"))  # an item of one query is not that of another
    named = items.withColumn("_id", F.col("id")).withColumn("id", own)
    if edges is not None:
        queries = items.select(F.col(by), "id").distinct()
        ends = lambda c: F.concat_ws("\x1f", F.col(by).cast("string"), F.col(c).cast("string")).alias(c)
        steps = edges.join(queries.withColumnRenamed("id", "from"), "from").join(queries.withColumnRenamed("id", "to"), ["to", by])
        edges = steps.select(ends("from"), ends("to"), "relation", "pos")
    tie = [c for c in TIE if c in items.columns]
    rows = staged(blocks_of(named, edges, profile).select(by, "id", "_id", "block", "cost", "score", *tie), "blocks")
    filled = staged(fill(rows, budget, by, tie), "filled")
    chosen = filled.select(by, F.posexplode("ids").alias("at", "id")).join(rows.select("id", "_id", "block", "cost"), "id")
    shown = F.when(F.col("cost") > budget, X.truncated(F.col("block"), max(20, 4 * budget))).otherwise(F.col("block"))
    texts = chosen.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("block"), "_id"))).alias("rows"))
    return filled.drop("ids").join(texts, by, "left").select(by, F.array_join(F.transform("rows", lambda r: r["block"]), "\n\n").alias("text"), F.transform("rows", lambda r: r["_id"]).alias("ids"), "used", "dropped")


def compile_tier(nodes: DataFrame, edges: DataFrame, profile: str, query: str, now: Column, agent: str | None = None) -> Context:
    """``compiled`` from its own source: the working memory for the tiny profile, else what the retriever finds."""
    if profile == "tiny":
        items = memory_items(nodes)
    else:
        items = nodes.join(retrieve.retrieve(nodes, edges, query, now).select("id", "score"), "id")
    return compiled(items, edges, profile, agent)


def access_events(context: Context, spark: SparkSession, at) -> DataFrame:
    """The log rows that say which nodes a compile has shown; writing them is up to the caller."""
    return spark.createDataFrame([(at, i, "NodeAccessed") for i in context.included], "ts timestamp, nodeId string, type string")
