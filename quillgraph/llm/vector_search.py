"""Nearest neighbours by Euclidean distance over robust-pruned directed graphs, one per shard.

Equal vectors are one class, which keeps the smallest ids that an answer can need. Classes are dealt into shards of about
``per_shard`` by a hash. A shard's graph is built in batches: a greedy search from the middle of the shard proposes
neighbours of every new node, relaxed distance pruning keeps those that no kept one is much nearer to, and each of them
gets an edge back, pruned again where a node has too many. Every query asks every shard by a beam search: a shard and its
graph are loaded once by a task, and the blocks of queries stream past. A sample of each block is held against all vectors
of the shard, and the beam is doubled until the audit passes (in the end it is the whole shard). What a beam holds is
measured in double precision on the vectors as given; the shards' best are merged by a top-k of each query.

Edge cases: null ids, null, empty or zero vectors and those with null or non-finite parts take no part; vectors of different
lengths never meet; rows are vectors of their own, so a second row of the query's id is a candidate and a second query;
ties go to the smaller id; fewer candidates than ``k`` are all returned; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


@dataclass(frozen=True)
class Setting:
    k: int = 10
    degree: int = 32  #: most edges of a node
    relax: float = 1.2  #: how much nearer a kept neighbour must be to a candidate, to make it needless
    build_beam: int = 64
    beam: int = 48
    step: int = 4  #: nodes of a beam that are opened together
    audit: int = 16  #: queries of a block that are held against the whole shard
    recall: float = 0.999
    per_shard: int = 8192
    block: int = 256


@dataclass(frozen=True)
class Index:
    """``shards`` as a table: dim, shard, ids, starts, data, graph (each a binary); the number of shards; the setting."""

    table: DataFrame
    shards: int
    setting: Setting


class Graph:
    """Directed graph over vectors; ``edges`` has a row of ``degree`` places for each (-1: none)."""

    def __init__(self, vectors: np.ndarray, s: Setting, edges: np.ndarray | None = None):
        self.s = s
        x = vectors / max(float(np.abs(vectors).max(initial=0)), 1e-300)  # keeps squares finite in single precision
        self.middle, self.scale = x.mean(0), max(float(np.abs(vectors).max(initial=0)), 1e-300)
        self.v = (x - self.middle).astype(np.float32)
        self.norm = np.einsum("nd,nd->n", self.v, self.v)
        self.start = int(self.norm.argmin())
        if edges is None:
            self.edges = np.full((len(vectors), s.degree), -1, np.int32)
            self._build()
        else:
            self.edges = edges

    def placed(self, queries: np.ndarray) -> np.ndarray:
        return (queries / self.scale - self.middle).astype(np.float32)

    def _build(self) -> None:
        n = len(self.v)
        order = np.random.default_rng(7).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]])
        done = min(n, 4 * self.s.degree)
        first = order[:done]  # the first few know each other
        apart = self._apart(first, first)
        near = np.argsort(apart, axis=1, kind="stable")[:, 1 : self.s.build_beam + 1]
        self._connect(first, first[near], np.take_along_axis(apart, near, 1))
        while done < n:
            new = order[done : done + max(64, min(512, done // 2))]
            found, apart = self.search(self.v[new], self.s.build_beam)
            self._connect(new, found, apart)
            done += len(new)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(self.norm[a][:, None] + self.norm[b][None] - 2 * self.v[a] @ self.v[b].T, 0)

    def _connect(self, new: np.ndarray, found: np.ndarray, apart: np.ndarray) -> None:
        chosen = self._pruned(found, apart)
        self.edges[new] = chosen
        to, frm = chosen.ravel().astype(np.int64), np.repeat(new, chosen.shape[1])
        to, frm = to[to >= 0], frm[to >= 0]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        nodes, begin, size = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 256):
            part = slice(lo, lo + 256)
            width = int(size[part].max())
            place = begin[part][:, None] + np.arange(width)
            more = np.where(np.arange(width) < size[part][:, None], frm[np.minimum(place, len(frm) - 1)], -1)
            own = np.concatenate([self.edges[nodes[part]].astype(np.int64), more], 1)
            own = np.sort(own, axis=1)
            own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
            self.edges[nodes[part]] = self._narrowed(nodes[part], own)

    def _narrowed(self, nodes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Neighbour lists of at most ``degree``: as they are where they fit, else pruned."""
        m = self.s.degree
        out = -np.sort(-own, axis=1)[:, :m].astype(np.int32)
        out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
        full = np.flatnonzero((own >= 0).sum(1) > m)
        if len(full):
            cand = own[full]
            apart = np.where(cand >= 0, self.norm[cand] - 2 * np.einsum("bcd,bd->bc", self.v[cand], self.v[nodes[full]]) + self.norm[nodes[full]][:, None], np.inf)
            order = np.argsort(apart, axis=1, kind="stable")
            out[full] = self._pruned(np.take_along_axis(cand, order, 1), np.maximum(np.take_along_axis(apart, order, 1), 0))
        return out

    def _pruned(self, found: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Of candidates in order of distance: each that no kept one is ``relax`` times nearer to than the node is, at most ``degree``."""
        m, c = self.s.degree, found.shape[1]
        out = np.full((len(found), m), -1, np.int32)
        if not c:
            return out
        v, norm = self.v[found], self.norm[found]
        between = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * v @ v.transpose(0, 2, 1), 0) * np.float32(self.s.relax**2)
        gone, kept = found < 0, np.zeros(len(found), np.int64)
        for i in range(c):
            take = ~gone[:, i] & (kept < m)
            rows = np.flatnonzero(take)
            out[rows, kept[rows]] = found[rows, i]
            kept[rows] += 1
            gone |= take[:, None] & (between[:, i] <= apart)
        return out

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the ``beam`` best nodes that a greedy search finds, best first (-1 and inf where there are fewer)."""
        n, rows = len(self.v), np.arange(len(q))[:, None]
        own = np.einsum("bd,bd->b", q, q)[:, None]
        seen = np.zeros((len(q), n + 1), bool)  # the last column takes what isn't there
        ids, apart = np.full((len(q), beam), n, np.int64), np.full((len(q), beam), np.inf, np.float32)
        opened = np.zeros((len(q), beam), bool)
        fresh = np.full((len(q), 1), self.start, np.int64)
        live = np.arange(len(q))
        while len(live):
            b = rows[: len(live)]
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
            fresh = np.where(seen[live[:, None], fresh], n, fresh)
            seen[live[:, None], fresh] = True
            seen[live, n] = False
            at = np.minimum(fresh, n - 1)
            d = np.where(fresh < n, self.norm[at] - 2 * np.einsum("bcd,bd->bc", self.v[at], q[live]) + own[live], np.inf).astype(np.float32)
            all_i, all_d = np.concatenate([ids[live], fresh], 1), np.concatenate([apart[live], d], 1)
            all_o = np.concatenate([opened[live], np.zeros(fresh.shape, bool)], 1)
            if all_d.shape[1] > beam:
                best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_d, best, 1), axis=1, kind="stable"), 1)
            else:
                best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids[live], apart[live], now = all_i[b, best], all_d[b, best], all_o[b, best]
            shut = ~now & (ids[live] < n)
            first = np.argsort(~shut, axis=1, kind="stable")[:, : self.s.step]
            use = shut[b, first]
            now[b, first] = True
            opened[live] = now
            on = use.any(1)
            near = np.where(use[:, :, None], self.edges[np.minimum(ids[live][b, first], n - 1)], -1)[on]
            live = live[on]
            fresh = near.reshape(len(live), near.shape[1] * near.shape[2]).astype(np.int64)
            fresh[fresh < 0] = n
        return np.where(ids < n, ids, -1), apart


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed from the first part to the last."""
    total = np.zeros(np.broadcast_shapes(q.shape[:-1], x.shape[:-1]))
    for i in range(q.shape[-1]):
        gap = q[..., i] - x[..., i]
        total += gap * gap
    return np.sqrt(total)


def nearest(graph: Graph, queries: np.ndarray, vectors: np.ndarray, s: Setting) -> np.ndarray:
    """Nodes near each query (a row each, -1: none), by a beam that its audit accepts; at least ``k + 1`` where there are so many."""
    n, want = len(vectors), s.k + 1
    q = graph.placed(queries)
    sample = np.arange(len(q))[:: max(1, len(q) // s.audit)]
    truth = distances(queries[sample][:, None], vectors[None])
    reach = np.partition(truth, min(want, n) - 1, axis=1)[:, min(want, n) - 1]
    beam = max(s.beam, want)
    while beam < n:
        ids, _ = graph.search(q, beam)
        hit = [np.count_nonzero(truth[i, ids[j][ids[j] >= 0]] <= reach[i]) for i, j in enumerate(sample)]
        if sum(hit) >= s.recall * sum(np.count_nonzero(t <= r) for t, r in zip(truth, reach, strict=True)):
            return ids
        beam *= 2
    return np.broadcast_to(np.arange(n), (len(q), n))


def answers(key: np.ndarray, own_id: np.ndarray, queries: np.ndarray, near: np.ndarray, vectors: np.ndarray, ids: np.ndarray, starts: np.ndarray, s: Setting) -> tuple[np.ndarray, ...]:
    """(key, id, distance): the ``k`` nearest rows of this shard for each query, without the query's own row."""
    out_key, out_id, out_far = [], [], []
    for lo in range(0, len(key), 64):
        part = near[lo : lo + 64]
        far = np.where(part >= 0, distances(queries[lo : lo + 64][:, None], vectors[np.maximum(part, 0)]), np.inf)
        width = min(part.shape[1], 4 * (s.k + 1))
        for i, (row, d) in enumerate(zip(part, far, strict=True), lo):
            order = np.argsort(d, kind="stable")
            last = d[order[min(width, len(order)) - 1]]
            order = order[d[order] <= last]  # with all that are as far as the last
            order = order[np.isfinite(d[order]) | (row[order] >= 0)]
            nodes, d = row[order], d[order]
            size = starts[nodes + 1] - starts[nodes]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[nodes], size)
            found, far_of, node = ids[place], np.repeat(d, size), np.repeat(nodes, size)
            same = np.flatnonzero((found == own_id[i]) & (far_of == 0))
            same = same[(vectors[node[same]] == queries[i]).all(1)][:1]
            found, far_of = np.delete(found, same), np.delete(far_of, same)
            best = np.lexsort((found, far_of))[: s.k]
            out_key.append(np.full(len(best), key[i])), out_id.append(found[best]), out_far.append(far_of[best])
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_key, np.int64), (out_id, np.int64), (out_far, np.float64)))


def sound_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vector) of the rows that take part; zeros have no sign."""
    x: Column = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound)
    return rows.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda v: v.cast("double") + 0.0).alias("vector"))


def build(vectors: DataFrame, s: Setting = Setting()) -> Index:
    """Index of all rows, written to the shared folder."""
    rows = sound_rows(vectors)
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= s.k + 1)
    classes = staged(few.groupBy("vector").agg(F.first("dim").alias("dim"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    shards = max(1, -(-classes.count() // s.per_shard))

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(least=[x[0] for x in pdf["ids"]]).sort_values("least")
        v = np.stack(pdf["vector"].to_list()).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in pdf["ids"]])])
        edges = io.BytesIO()
        np.save(edges, Graph(v, s).edges)
        blobs = np.concatenate(pdf["ids"].to_list()).astype("<i8"), starts.astype("<i8"), v.astype("<f8")
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]]} | {c: [x.tobytes()] for c, x in zip(("ids", "starts", "data"), blobs, strict=True)} | {"graph": [edges.getvalue()]})

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    table = dealt.groupBy("dim", "shard").applyInPandas(made, "dim int, shard int, ids binary, starts binary, data binary, graph binary")
    return Index(staged(table, "vector-index"), shards, s)


def search(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of all indexed rows for each row (vec_id, embedding), its own row left out."""
    s, spark = index.setting, queries.sparkSession
    asked = staged(sound_rows(queries), "queries")  # written once, so that a row keeps its number
    asked = staged(asked.withColumn("key", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // s.block))
    packed = asked.groupBy("dim", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("key", "vec_id", "vector")).alias("rows"))
    turns = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    row_kind = dict(packed.dtypes)["rows"]
    loads = index.table.select("dim", "shard", F.lit(0).alias("turn"), "ids", "starts", "data", "graph", *none(row_kind, "rows"))
    asks = turns.select("dim", "shard", F.lit(1).alias("turn"), *none("binary", "ids", "starts", "data", "graph"), "rows")
    together = loads.unionByName(asks).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.shards), "dim", "shard").sortWithinPartitions("dim", "shard", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            for r in pdf.itertuples():
                if r.turn == 0:
                    data = np.frombuffer(r.data, "<f8").reshape(-1, r.dim)
                    held = (r.dim, r.shard), data, np.frombuffer(r.ids, "<i8"), np.frombuffer(r.starts, "<i8"), Graph(data, s, np.load(io.BytesIO(r.graph)))
                elif held is not None and held[0] == (r.dim, r.shard):
                    _, data, ids, starts, graph = held
                    key, own = (np.array([x[c] for x in r.rows], np.int64) for c in ("key", "vec_id"))
                    q = np.array([x["vector"] for x in r.rows], np.float64)
                    found = answers(key, own, q, nearest(graph, q, data, s), data, ids, starts, s)
                    yield pd.DataFrame(dict(zip(("key", "vec_id", "score"), found, strict=True)))

    found = together.mapInPandas(run, "key long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))).where(F.col("rank") <= s.k)
    return best.join(asked.select("key", F.col("vec_id").alias("query_id")), "key").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
