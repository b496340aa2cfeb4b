"""The assembled retriever: relevance, seeds, traversal, and a ranked list that says why each item is in it.

Scoring is one scan of the nodes against literals (query tokens, corpus figures); the seeds are a top-k, so the traversal
starts from a handful of rows, and only what it reaches is joined back with the nodes.

Edge cases: an empty query ranks by the other factors alone; nodes without an author are seen by every agent; edges to ids
without a node are walked through, but such ids aren't returned; null texts match nothing; an empty graph gives an empty
result; equal scores are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import constants as C
from . import graph, rank


def search_text(text: str = "text", kind: str = "kind") -> Column:
    """What a node is found by: its text and kind, not its type."""
    return F.concat_ws(" ", F.col(text), F.col(kind))


def seen_by(nodes: DataFrame, agent: str | None) -> DataFrame:
    """Nodes of the agent and those of nobody."""
    return nodes if agent is None else nodes.where(F.col("author").isNull() | (F.col("author") == "") | (F.col("author") == agent))


def relevance(nodes: DataFrame, query: str, query_vector: Column | None = None, vectors: DataFrame | None = None, weight: float = 0.5) -> DataFrame:
    """The nodes (without their text) with ``relevance``: lexical, mixed with the cosine where there is a vector, lifted by matching directories."""
    files = F.col("type") == "File"
    dirs = F.when(files, rank.directory_tokens(F.col("text"))).otherwise(F.array().cast("array<string>"))
    rows = nodes.withColumn("search_text", search_text()).withColumn("dirs", dirs).drop("text")
    found = rank.lexical(rows, query, "search_text").drop("coverage", "bm25")
    if query_vector is not None and vectors is not None:
        found = found.join(vectors.select("id", "vector"), "id", "left").withColumn("relevance", rank.blended(F.col("relevance"), F.col("vector"), query_vector, weight)).drop("vector")
    if rank.query_tokens(query):
        found = rank.directory_boost(found, query, only=files).withColumn("relevance", F.col("relevance") * F.col("boost")).drop("boost")
    return found.drop("dirs")


def retrieve(
    nodes: DataFrame, edges: DataFrame, query: str, now: Column, agent: str | None = None, top_k: int = C.SEEDS, hops: int = C.HOPS, decay: float = C.HOP_DECAY, history: bool = False,
    query_vector: Column | None = None, vectors: DataFrame | None = None,
) -> DataFrame:
    """(id, score, seed, depth, path, relation, components), best first.

    ``nodes``: id, type, text, kind, author, status, confidence, importance, decay_rate, last_verified.
    """
    nodes = seen_by(nodes, agent)
    trust = rank.reputation(nodes.where("type = 'Decision' and author <> ''"))
    facts = nodes.join(trust, "author", "left").withColumn("decay_rate", F.coalesce("decay_rate", F.lit(C.DECAY_OTHER)))
    first = rank.components(relevance(facts, query, query_vector, vectors), now)
    c = F.col("components")
    whole = c["relevance"] * c["confidence"] * c["importance"] * c["freshness"] * c["reputation"]
    seeds = first.where("relevance > 0").select("id", F.col("relevance").alias("value"), whole.alias("whole")).orderBy(F.col("whole").desc(), "id").limit(top_k).select("id", "value")
    best = graph.traverse(seeds, graph.current(edges, now, history), hops, decay)
    reached = facts.join(best.withColumnRenamed("value", "relevance"), "id")
    ranked = rank.components(reached, now).select("id", "score", (F.col("depth") == 0).alias("seed"), "depth", "path", "relation", "components")
    return ranked.orderBy(F.col("score").desc(), "id")
