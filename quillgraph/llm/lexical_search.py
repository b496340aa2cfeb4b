"""Exact ranked search over documents in an order made by recursive graph bisection.

Build. Every text is broken into terms once. A tree of bisections, fitted on a bounded sample of documents (their terms'
hashes), sends each document to a range of like ones; a range is dealt into shards of about ``shard_terms`` postings. In a
shard the whole documents are put in order by recursive graph bisection over their own terms: halves swap the documents
that shorten the gaps of the posting lists most, then each half is split again, down to clusters. A shard holds a posting
list for every term, in that order, and the largest impact of the term in every cluster.

Search. The query's posting lists are picked out once. A shard's bound for an item is the largest sum, over the shard's
clusters, of the terms' impacts there. Items visit shards by falling bound, a few more in every round; in a shard only
clusters are scored whose bound reaches the item's 20th score so far. An item is finished when no shard left has a bound
that reaches it: a bound equal to it is still visited, as a smaller doc_id wins a tie. So the result is that of scoring
everything. Scores are integers; positions are mapped back to ids before ties are broken.

Edge cases: texts that are null, empty or without a term are found by nothing and don't count; an item that is null or
without a term has no rows; rows of one doc_id (or item_id) are documents (or items) of their own; null ids pass through and
come last among equal scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, slices, staged, utf8

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass(frozen=True)
class Setting:
    sample: int = 4096  #: documents on which the tree of ranges is fitted
    sketch: int = 64  #: hashed terms of a document that the tree looks at
    buckets: int = 1 << 14
    levels: int = 5
    rounds: int = 6  #: of swaps, at most, in each split
    shard_terms: int = 1_000_000
    cluster: int = 64
    first_visits: int = 2
    growth: int = 8
    broadcast_terms: int = 50_000  #: query terms up to which they are sent to every task


@dataclass(frozen=True)
class Index:
    """``lists``: shard, term, count, at, tf, clusters, tops; a shard's documents stand in the row of the empty term."""

    lists: DataFrame
    shards: int
    documents: int
    terms: int
    setting: Setting


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall(utf8(text).lower())  # bytes.lower changes A to Z only


# --- bisection -----------------------------------------------------------------------------------------------------


def _costs(n: int) -> np.ndarray:
    """log2 of 0 to n (0 for 0)."""
    out = np.zeros(n + 2)
    out[1:] = np.log2(np.arange(1, n + 2))
    return out


def bisected(starts: np.ndarray, terms: np.ndarray, leaf: int, rounds: int, levels: int = 64) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of documents (their terms are ``terms[starts[i]:starts[i + 1]]``), and the segment of each after every level.

    All segments of a level are split together. A split begins with the order as it is; in each round the documents of both
    halves are sorted by how much moving them would shorten the gaps, and pairs are swapped while that pays.
    """
    n, width = len(starts) - 1, int(terms.max(initial=-1)) + 1
    doc = np.repeat(np.arange(n), np.diff(starts))
    order, bounds, path = np.arange(n), np.array([0, n]), []
    log = _costs(n + 1)
    while len(path) < levels and (np.diff(bounds) > leaf).any():
        size = np.diff(bounds)
        halves = np.where(size > leaf, (size + 1) // 2, size)
        segment = np.empty(n, np.int64)
        segment[order] = np.repeat(np.arange(len(size)), size)
        side = np.empty(n, np.int8)
        place = np.arange(n) - np.repeat(bounds[:-1], size)
        side[order] = place >= np.repeat(halves, size)
        active = np.repeat(size > leaf, size)
        moving = np.zeros(n, bool)
        moving[order] = active
        post = np.flatnonzero(moving[doc])
        key, count = segment[doc[post]] * width + terms[post], np.array([halves, size - halves])
        distinct, key = np.unique(key, return_inverse=True)
        of = distinct // max(width, 1)
        for _ in range(rounds):
            right = side[doc[post]].astype(bool)
            d = np.stack([np.bincount(key[~right], minlength=len(distinct)), np.bincount(key[right], minlength=len(distinct))])
            cost = lambda x, i: x * (log[count[i][of]] - log[x + 1])
            now = cost(d[0], 0) + cost(d[1], 1)
            gain = [now - cost(np.maximum(d[0] - 1, 0), 0) - cost(d[1] + 1, 1), now - cost(d[0] + 1, 0) - cost(np.maximum(d[1] - 1, 0), 1)]
            worth = np.bincount(doc[post], weights=np.where(right, gain[1][key], gain[0][key]), minlength=n)
            who = np.flatnonzero(moving)
            who = who[np.lexsort((who, -worth[who], side[who], segment[who]))]
            group = segment[who] * 2 + side[who]
            first = np.searchsorted(group, group, side="left")
            rank = np.arange(len(who)) - first
            left, right_ = who[side[who] == 0], who[side[who] == 1]
            pair = np.searchsorted(segment[left] * n + rank[side[who] == 0], segment[right_] * n + rank[side[who] == 1])
            swap = worth[left[pair]] + worth[right_] > 1e-9
            side[left[pair][swap]], side[right_[swap]] = 1, 0
            if swap.sum() * 200 < len(who):
                break
        order = order[np.lexsort((side[order], segment[order]))]
        cuts = np.stack([bounds[:-1], bounds[:-1] + halves], 1).ravel()
        bounds = np.unique(np.concatenate([cuts, [n]]))
        where = np.empty(n, np.int64)
        where[order] = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        path.append(where)
    return order, path


@dataclass(frozen=True)
class Tree:
    """``weights[level][node]`` of hashed terms, and what their sum must exceed to go left."""

    weights: list[np.ndarray]
    bias: list[np.ndarray]
    buckets: int

    def ranges(self, sketches: list[np.ndarray]) -> np.ndarray:
        node = np.zeros(len(sketches), np.int64)
        size = np.array([len(x) for x in sketches], np.int64)
        flat = np.concatenate(sketches) if len(sketches) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(sketches)), size)
        for w, b in zip(self.weights, self.bias, strict=True):
            total = np.bincount(doc, weights=w[node[doc], flat], minlength=len(sketches))
            node = 2 * node + (total < b[node])
        return node


def fitted(sketches: list[np.ndarray], s: Setting) -> Tree:
    """The splits of a sample as log-odds of the terms' shares in both halves."""
    weights, bias = [], []
    if len(sketches) >= 2 * s.cluster:
        starts = np.concatenate([[0], np.cumsum([len(x) for x in sketches])])
        terms = np.concatenate(sketches)
        _, path = bisected(starts, terms, 1, s.rounds, s.levels)
        doc = np.repeat(np.arange(len(sketches)), np.diff(starts))
        for depth, where in enumerate(path):
            if where.max() + 1 != 2 ** (depth + 1):
                break
            d = np.bincount(where[doc] * s.buckets + terms, minlength=2 ** (depth + 1) * s.buckets).reshape(-1, 2, s.buckets)
            n = np.bincount(where, minlength=2 ** (depth + 1)).reshape(-1, 2, 1)
            odds = np.log((d + 0.5) / (n + 1))
            w = (odds[:, 0] - odds[:, 1]).astype(np.float32)
            total = np.bincount(doc, weights=w[where[doc] // 2, terms], minlength=len(sketches))
            weights.append(w)
            bias.append(np.array([np.median(total[where // 2 == i]) for i in range(2**depth)], np.float32))
    return Tree(weights, bias, s.buckets)


def sketch_of(terms: list[bytes], s: Setting) -> np.ndarray:
    """The hashed terms of a document that come first by hash."""
    return np.unique(np.array(sorted(zlib.crc32(t) for t in terms)[: s.sketch], np.int64) % s.buckets)


# --- build ---------------------------------------------------------------------------------------------------------


def _sample(docs: DataFrame, s: Setting) -> list[np.ndarray]:
    """Sketches of a bounded sample of documents, by a hash of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(iter([b]))):
            made = [sketch_of(list(set(terms_of(t))), s).tolist() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(made, pa.list_(pa.int64()))], names=["h", "sketch"])

    step = max(1, docs.count() // (2 * s.sample))
    some = docs.select(F.xxhash64("doc_id").alias("h"), "text").where(F.pmod("h", F.lit(step)) == 0)
    rows = some.mapInArrow(run, "h long, sketch array<long>").where(F.size("sketch") > 0).orderBy("h", "sketch").limit(s.sample).collect()
    return [np.array(r["sketch"], np.int64) for r in rows]


def tokenised(docs: DataFrame, tree: Tree, s: Setting) -> DataFrame:
    """doc_id, n (terms with repeats), size (without), range, terms (joined by blanks), tf (unsigned, four bytes each) of documents with a term."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("range", pa.int32()), ("terms", pa.binary()), ("tf", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(iter([b]), 200)):
            found = [(i, Counter(terms_of(t))) for i, t in zip(part.column("doc_id"), part.column("text").to_pylist(), strict=True)]
            found = [(i, c) for i, c in found if c]
            where = tree.ranges([sketch_of(list(c), s) for _, c in found])
            columns = (
                [i.as_py() for i, _ in found], [c.total() for _, c in found], [len(c) for _, c in found], where.tolist(),
                [b" ".join(c) for _, c in found], [np.fromiter(c.values(), "<u4", len(c)).tobytes() for _, c in found],
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, size long, range int, terms binary, tf binary")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def ordered_shard(pdf: pd.DataFrame, documents: int, total: int, s: Setting) -> pd.DataFrame:
    """The rows of a shard: its documents in their new order, and a list for each term."""
    vocabulary: dict[bytes, int] = {}
    ids = [np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in x.split(b" ")), np.int64) for x in pdf["terms"]]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    term, tf = np.concatenate(ids), np.concatenate([np.frombuffer(x, "<u4") for x in pdf["tf"]]).astype(np.int64)
    n = len(ids)
    df = np.bincount(term, minlength=len(vocabulary))
    telling = (df >= 2) & (4 * df <= 3 * n)  # lists of one or of nearly all are as short in any order
    doc = np.repeat(np.arange(n), np.diff(starts))
    keep = telling[term]
    short = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=n))])
    order, _ = bisected(short, term[keep], s.cluster, s.rounds)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    m = (75 + (25 * pdf["n"].to_numpy(np.int64) * documents) // total)[order]
    doc_ids = pdf["doc_id"].to_numpy(np.int64)[order]
    by = np.lexsort((place[doc], term))
    term, at, tf = term[by], place[doc][by], tf[by]
    worth, cluster = impact(tf, m[at]), at // s.cluster
    edge = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (cluster[1:] != cluster[:-1])])) if len(term) else np.zeros(0, np.int64)
    top, top_term, top_cluster = np.maximum.reduceat(worth, edge) if len(edge) else worth, term[edge], cluster[edge]
    lists, tops = np.searchsorted(term, np.arange(len(vocabulary) + 1)), np.searchsorted(top_term, np.arange(len(vocabulary) + 1))
    at, tf, top_cluster, top = at.astype("<u4"), tf.astype("<u4"), top_cluster.astype("<u4"), top.astype("<i4")
    cut = lambda x, w: [x[a:b].tobytes() for a, b in zip(w[:-1], w[1:], strict=True)]
    rows = {"term": [b"", *vocabulary], "count": [n, *df.tolist()], "at": [doc_ids.astype("<i8").tobytes(), *cut(at, lists)], "tf": [m.astype("<i8").tobytes(), *cut(tf, lists)], "clusters": [b"", *cut(top_cluster, tops)], "tops": [b"", *cut(top, tops)]}
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]] * (len(vocabulary) + 1)} | rows)


def build(docs: DataFrame, s: Setting = Setting()) -> Index:
    """Index of all documents, written to the shared folder."""
    words = staged(tokenised(docs, fitted(_sample(docs, s), s), s), "terms")
    ranges = words.groupBy("range").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum("size").alias("size")).orderBy("range").collect()  # at most 2^levels rows
    documents, total = sum(r["docs"] for r in ranges), sum(r["n"] for r in ranges)  # N and L
    base, shard = 0, F.lit(0).cast("long")
    for r in ranges:
        parts = -(-r["size"] // s.shard_terms)
        shard = F.when(F.col("range") == r["range"], F.lit(base) + F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(parts))).otherwise(shard)
        base += parts
    named = words.withColumn("shard", shard.cast("long")).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID))).drop("range", "size")
    made = named.groupBy("shard").applyInPandas(
        lambda pdf: ordered_shard(pdf, documents, total, s), "shard long, term binary, count long, at binary, tf binary, clusters binary, tops binary"
    )
    return Index(staged(made, "lexical-index"), base, documents, total, s)


# --- search --------------------------------------------------------------------------------------------------------


def query_terms(items: DataFrame) -> DataFrame:
    """key, item_id, term, qtf: the terms of each row of (item_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, t, n) for k, x in zip(pdf["key"], pdf["text"], strict=True) for t, n in Counter(terms_of(x)).items()]
            yield pd.DataFrame(rows, columns=["key", "term", "qtf"])

    return items.select("key", "text").mapInPandas(run, "key long, term binary, qtf long")


class Shard:
    """What a task holds of a shard while items stream past."""

    def __init__(self, s: Setting):
        self.s, self.rows, self.doc_ids, self.m, self.known = s, {}, np.zeros(0, np.int64), np.zeros(0, np.int64), {}

    def take(self, r) -> None:
        if r.term == b"":
            self.doc_ids, self.m = np.frombuffer(r.at, "<i8"), np.frombuffer(r.tf, "<i8")
        else:
            self.rows[bytes(r.term)] = r

    def bounds(self, asked: list) -> np.ndarray:
        """Bound of each cluster for an item."""
        own = [(np.frombuffer(r.clusters, "<u4"), np.frombuffer(r.tops, "<i4"), w) for t, w in asked if (r := self.rows.get(bytes(t))) is not None]
        out = np.zeros(1 + max((int(c[-1]) for c, _, _ in own), default=-1), np.int64)
        for c, top, w in own:
            out[c] += top.astype(np.int64) * w
        return out

    def _list(self, term: bytes) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.known:
            r = self.rows[term]
            at = np.frombuffer(r.at, "<u4").astype(np.int64)
            self.known[term] = at, impact(np.frombuffer(r.tf, "<u4").astype(np.int64), self.m[at])
        return self.known[term]

    def best(self, asked: list, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids, scores) of the ``k`` best documents with a score of ``least`` or more, in clusters that can have one."""
        able = self.bounds(asked) >= max(least, 1)
        scores = np.zeros(len(self.doc_ids), np.int64)
        for t, w in asked:
            if bytes(t) in self.rows:
                at, worth = self._list(bytes(t))
                if 2 * np.count_nonzero(able) < len(able):
                    ok = able[at // self.s.cluster]
                    at, worth = at[ok], worth[ok]
                scores[at] += w * worth
        found = np.flatnonzero(scores >= max(least, 1))
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((self.doc_ids[found], -scores[found]))[:k]]
        return self.doc_ids[found], scores[found]


def _streamed(lists: DataFrame, asks: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the rows of each shard, its lists before the items that ask it."""
    a = lists.withColumn("turn", F.lit(0))
    both = a.unionByName(asks.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    return both.repartition("shard").sortWithinPartitions("shard", "turn").mapInPandas(run, schema)


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each row of (item_id, text)."""
    s = index.setting
    items = staged(items.select("item_id", "text"), "items")  # written once, so that a row keeps its number
    items = staged(items.withColumn("key", F.monotonically_increasing_id()), "items")
    asked = staged(query_terms(items), "asked")
    wanted = asked.select("term").distinct()
    terms = F.broadcast(wanted) if wanted.count() <= s.broadcast_terms else wanted
    documents = index.lists.where(F.length("term") == 0)
    lists = staged(index.lists.join(terms, "term", "left_semi").unionByName(documents), "lists")
    df = lists.where(F.length("term") > 0).groupBy("term").agg(F.sum("count").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = asked.join(df.select("term", weight.alias("w")), "term").select("key", F.struct("term", (F.col("qtf") * F.col("w")).alias("w")).alias("t")).where("t.w > 0")
    queries = staged(weighed.groupBy("key").agg(F.collect_list("t").alias("asked")), "queries")

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, number = Shard(s), -1
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.shard != number:
                    shard, number = Shard(s), r.shard
                if r.turn == 0:
                    shard.take(r)
                elif (b := int(shard.bounds([(x["term"], x["w"]) for x in r.asked]).max(initial=0))) > 0:
                    out.append((r.key, number, b))
            yield pd.DataFrame(out, columns=["key", "shard", "bound"])

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, number = Shard(s), -1
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.shard != number:
                    shard, number = Shard(s), r.shard
                if r.turn == 0:
                    shard.take(r)
                else:
                    ids, scores = shard.best([(x["term"], x["w"]) for x in r.asked], int(r.least), k)
                    out += [(r.key, i, x) for i, x in zip(ids.tolist(), scores.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["key", "doc_id", "score"])

    every = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.shards - 1).cast("long")))) if index.shards else queries.withColumn("shard", F.lit(0).cast("long")).limit(0)
    tops = lists.where(F.length("term") > 0).select("shard", "term", "clusters", "tops")
    bounds = _streamed(tops, every, bound, "key long, shard long, bound long")
    bounds = staged(bounds.withColumn("turn_of", F.row_number().over(Window.partitionBy("key").orderBy(F.col("bound").desc(), "shard"))), "bounds")
    last = bounds.agg(F.max("turn_of")).first()[0] or 0
    best, done, upto = None, 0, s.first_visits
    top = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "doc_id"))).where(F.col("rank") <= k)
    while done < last or best is None:
        turn = bounds.where((F.col("turn_of") > done) & (F.col("turn_of") <= upto))
        if best is not None:
            reached = best.where(F.col("rank") == k).select("key", F.col("score").alias("least"))
            turn = turn.join(reached, "key", "left").where("least is null or bound >= least")
            if turn.isEmpty():
                break
        turn = turn.select("key", "shard", *([F.coalesce("least", F.lit(0)).alias("least")] if best is not None else [F.lit(0).cast("long").alias("least")]))
        asks = turn.join(queries, "key")
        needed = lists.select("shard", "term", "at", "tf", "clusters", "tops").join(turn.select("shard").distinct(), "shard", "left_semi")
        found = _streamed(needed, asks, visit, "key long, doc_id long, score long")
        best = staged(top(found if best is None else best.select("key", "doc_id", "score").unionByName(found)), "best")
        done, upto = upto, upto * s.growth
    named = best.join(items.select("key", "item_id"), "key")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")
