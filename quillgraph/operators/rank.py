"""Lexical, vector and graph ranking. The query is a parameter: its tokens are literals, so scoring never shuffles the corpus.

Texts are broken into tokens once a query; what is left of a text then is its length and the frequencies of the query's
tokens. Corpus figures (document frequencies, size, mean length) are one aggregate with partial sums over that, whose single
row is fetched and enters the scoring as literals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import constants as C
from .staging import staged


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", query.lower()) if t]


def term_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, idf) of every term; one shuffle of distinct (document, term)."""
    tokens = docs.select(F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("term"))
    n = F.lit(docs.count())
    return tokens.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", idf(F.col("df"), n).alias("idf"))


def idf(df: Column, n: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that is worked out once a row: as the one element of a generator it isn't copied into each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def matched(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """The rows without their text, with ``len`` and ``tf`` (of each distinct query token). Texts are broken into tokens here,
    once; what comes out is narrow and written, so figures, maxima and scores read that."""
    terms = list(dict.fromkeys(query_tokens(query)))
    tf = lambda t: F.size(F.filter("tokens", lambda x: x == t))
    rows = once(docs, "tokens", X.tokens(F.col(text)))
    return staged(rows.select(*[c for c in docs.columns if c != text], F.size("tokens").alias("len"), F.array(*[tf(t) for t in terms]).alias("tf")), "matched")


def bm25(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """The rows without their text, with ``bm25`` (0 where nothing matches; query tokens that repeat count again) and ``coverage``."""
    q = query_tokens(query)
    terms = list(dict.fromkeys(q))
    if not terms:
        return docs.drop(text).withColumn("bm25", F.lit(0.0)).withColumn("coverage", F.lit(0.0))
    docs = matched(docs, query, text)
    stats = docs.agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"), F.array(*[F.sum((F.col("tf")[i] > 0).cast("long")) for i in range(len(terms))]).alias("df"))
    found = stats.first()
    df, n, mean = [F.lit(x or 0) for x in found["df"]], F.lit(found["n"]), F.lit(float(found["mean_len"] or 1))
    part = lambda i: idf(df[i], n) * F.col("tf")[i] * (C.BM25_K1 + 1) / (F.col("tf")[i] + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("len") / mean))
    score, cover = F.lit(0.0), F.lit(0)
    for t in q:
        i = terms.index(t)
        score = score + F.when(F.col("tf")[i] > 0, part(i)).otherwise(0.0)
    for i in range(len(terms)):
        cover = cover + (F.col("tf")[i] > 0).cast("int")
    return docs.withColumn("bm25", score).withColumn("coverage", cover / F.lit(len(terms))).drop("tf", "len")


def lexical(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """``bm25`` by its maximum, times coverage: ``relevance``. An empty query makes everything 1."""
    scored = bm25(docs, query, text)
    if not query_tokens(query):
        return scored.withColumn("relevance", F.lit(1.0))
    top = F.lit(max(scored.agg(F.max("bm25")).first()[0] or 0.0, 1e-9))
    return scored.withColumn("relevance", F.col("bm25") / top * F.col("coverage"))


def directory_tokens(path: Column) -> Column:
    """Distinct tokens of all parts of a path but the last."""
    parts = F.split(path, r"[/\\]")
    return F.array_distinct(X.tokens(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")))


def directory_boost(files: DataFrame, query: str, path: str = "text", only: Column | None = None) -> DataFrame:
    """The rows with ``boost``: 1 + 3 * share of the query's directory tokens that the file's directories have.

    A token counts if it is in few enough directories (all do in a corpus of under four files). Rows that aren't ``only``
    have no directories and don't count as files. Rows that have ``dirs`` (their directory tokens) already keep them.
    """
    only = F.lit(True) if only is None else only
    q = query_tokens(query)
    rows = files if "dirs" in files.columns else files.withColumn("dirs", F.when(only, directory_tokens(F.col(path))).otherwise(F.array().cast("array<string>")))
    if not q:
        return rows.withColumn("boost", F.lit(1.0)).drop("dirs")
    stats = rows.agg(F.count(F.when(only, 1)).alias("n"), F.array(*[F.sum(F.array_contains("dirs", t).cast("long")) for t in q]).alias("df"))
    found = stats.first()
    n, df = F.lit(found["n"]), [F.lit(x or 0) for x in found["df"]]
    ok = [(df[i] > 0) & ((n < C.DIRECTORY_MIN_FILES) | (df[i] / n <= C.COMMON_SHARE)) for i in range(len(q))]
    eligible, matched = F.lit(0), F.lit(0)
    for i, t in enumerate(q):
        eligible = eligible + ok[i].cast("int")
        matched = matched + (ok[i] & F.array_contains("dirs", t)).cast("int")
    boost = F.when(eligible > 0, 1 + C.DIRECTORY_BOOST * matched / eligible).otherwise(F.lit(1.0))
    return rows.withColumn("boost", boost).drop("dirs")


def blended(relevance: Column, vector: Column, query_vector: Column, weight: float = 0.5) -> Column:
    """Lexical relevance mixed with the cosine (not under 0) where a row has a vector."""
    return F.when(vector.isNotNull(), (1 - weight) * relevance + weight * F.greatest(F.lit(0.0), X.cosine(vector, query_vector))).otherwise(relevance)


def reputation(decisions: DataFrame, author: str = "author") -> DataFrame:
    """(author, reputation): share of an author's decisions that weren't reversed, smoothed."""
    bad = F.sum(F.col("status").isin("superseded", "contradicted").cast("long"))
    return decisions.where(F.col(author).isNotNull()).groupBy(author).agg(((F.count("*") - bad + 1) / (F.count("*") + 2)).alias("reputation"))


def components(rows: DataFrame, now: Column) -> DataFrame:
    """Adds the five rounded factors and their product: relevance, confidence, importance, freshness, reputation."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.col("last_verified").cast("timestamp"))) / F.lit(86_400_000_000.0))
    factors = {
        "relevance": F.col("relevance"),
        "confidence": F.coalesce("confidence", F.lit(0.6)),
        "importance": F.coalesce("importance", F.lit(1.0)),
        "freshness": F.exp(-F.col("decay_rate") * F.coalesce(age, F.lit(0.0))),
        "reputation": F.when(F.col("type") == "Decision", F.coalesce("reputation", F.lit(1.0))).otherwise(F.lit(1.0)),
    }
    rounded = F.struct(*[X.round3(v).alias(k) for k, v in factors.items()])
    out = rows.withColumn("components", rounded)
    c = F.col("components")
    return out.withColumn("score", X.round3(c["relevance"] * c["confidence"] * c["importance"] * c["freshness"] * c["reputation"]))
