"""Group-by statistics and dashboard figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import round3


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def count_in_buckets(df: DataFrame, key: str, buckets: list[str], other: str = "other") -> DataFrame:
    """A row for every bucket, also for those without rows."""
    named = F.when(F.col(key).isin(*buckets), F.col(key)).otherwise(F.lit(other))
    frame = df.sparkSession.createDataFrame([(b,) for b in [*buckets, other]], "bucket string")
    return F.broadcast(frame).join(df.groupBy(named.alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def count_by_day(df: DataFrame, days: int = 14) -> DataFrame:
    """Newest days first; rows without a time are a bucket ``unknown`` that comes before all dates."""
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown"))
    return df.groupBy(day.alias("day")).agg(F.count("*").alias("n")).orderBy(F.col("day").desc()).limit(days)


def degrees(edges: DataFrame, top: int = 10) -> DataFrame:
    """Nodes with the most edges, both ends counted."""
    ends = edges.select(F.explode(F.array("from", "to")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.col("degree").desc(), "id").limit(top)


def decision_stats(decisions: DataFrame) -> DataFrame:
    n = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("long")), F.lit(0))
    reversed_ = n("superseded", "contradicted")
    return decisions.agg(
        F.count("*").alias("total"), n("active").alias("active"), n("resolved").alias("resolved"), n("superseded").alias("superseded"), n("contradicted").alias("contradicted"),
        F.when(F.count("*") > 0, round3(reversed_ / F.count("*"))).otherwise(F.lit(0.0)).alias("reversal_rate"),
    )


def failure_stats(failures: DataFrame) -> DataFrame:
    resolved = F.coalesce(F.sum((F.col("status") == "resolved").cast("long")), F.lit(0))
    return failures.agg(F.count("*").alias("total"), (F.count("*") - resolved).alias("open"), resolved.alias("resolved"))


def retrieval_quality(ranked: DataFrame, k: int) -> DataFrame:
    """ranked(query, rank, relevant): recall and precision at k and reciprocal rank per query."""
    hit = (F.col("relevant") & (F.col("rank") <= k)).cast("long")
    per = ranked.groupBy("query").agg(F.sum(hit).alias("hits"), F.sum(F.col("relevant").cast("long")).alias("relevant"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return per.select("query", (F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0)).alias("recall"), (F.col("hits") / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def scored_quality(scored: DataFrame, *ks: int) -> DataFrame:
    """The same from scored(query, score, id, relevant), at several k, with the precision over the slots that were filled.

    Equal scores are ordered by id. Nothing is ranked beyond the largest k: the rank of the best relevant row is the number
    of rows before it, counted against one row a query.
    """
    key = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
    rows = scored.withColumn("key", key)
    best = rows.groupBy("query").agg(F.count("*").alias("n"), F.sum(F.col("relevant").cast("long")).alias("relevant"), F.min(F.when(F.col("relevant"), F.col("key"))).alias("best"))
    before = rows.join(best.select("query", "best"), "query").where(F.col("key") <= F.col("best")).groupBy("query").agg(F.count("*").alias("first"))
    top = rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("key"))).where(F.col("rank") <= max(ks))
    hits = top.groupBy("query").agg(*[F.sum((F.col("relevant") & (F.col("rank") <= k)).cast("long")).alias(f"h{k}") for k in ks])
    all_ = best.join(hits, "query").join(before, "query", "left")
    at = [c for k in ks for c in (F.when(F.col("relevant") > 0, F.col(f"h{k}") / F.col("relevant")).otherwise(0.0).alias(f"recall_{k}"), (F.col(f"h{k}") / F.least(F.lit(k), F.col("n"))).alias(f"precision_{k}"), (F.col(f"h{k}") / k).alias(f"share_{k}"))]
    return all_.select("query", *at, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def compiled_recall(expected: DataFrame, ranked: DataFrame, compiled: DataFrame, *ks: int) -> DataFrame:
    """(query, recall_k..., reciprocal_rank): like ``scored_quality``, but what the compiled text shows counts as found.

    ``expected``: query, id, text; ``ranked``: query, id, rank; ``compiled``: query, text. A text is shown if the first twenty
    characters of it are in the compiled text, whatever their case. If only shown texts are found, the rank counts as the
    smallest k.
    """
    hint = F.lower(F.substring("text", 1, 20))
    rows = expected.select("query", "id", hint.alias("hint")).join(ranked.select("query", "id", "rank"), ["query", "id"], "left")
    rows = rows.join(compiled.select("query", F.lower("text").alias("shown")), "query", "left").withColumn("seen", F.coalesce(F.col("shown").contains(F.col("hint")), F.lit(False)))
    found = [F.avg((F.coalesce(F.col("rank") <= k, F.lit(False)) | F.col("seen")).cast("double")).alias(f"recall_{k}") for k in ks]
    best = F.coalesce(1 / F.min("rank"), F.when(F.bool_or("seen"), F.lit(1.0 / min(ks))).otherwise(F.lit(0.0)))
    return rows.groupBy("query").agg(*found, best.alias("reciprocal_rank"))
