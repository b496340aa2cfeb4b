"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label are one class. The classes of a label are dealt into shards of about ``per_shard``; every shard
has a layered proximity graph, built in batches. Every shard's classes query every shard of their label by a beam
search from the top layer down; what it finds is verified by cosine in double precision, and a link that either side
finds counts for both. A query whose beam holds
nothing but links is widened until it doesn't, and exhausts the shard in the end; after that a sample of the queries is
audited against all vectors of the shard, and the beam is doubled until the audit passes (again up to all vectors).
Per block and shard only link counts and a spanning forest of the links come back; components join them.

Edge cases: null labels or ids, null, empty or zero vectors and those with null or non-finite parts link with nothing
(0 links, their own component); vectors of different lengths never link; repeated rows count as vectors of their own;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components, forest


@dataclass(frozen=True)
class Setting:
    cosine: float = 0.98
    links: int = 16  #: outgoing neighbours chosen for a node, and as many places for those that chose it
    build_beam: int = 48
    beam: int = 48
    layer_ratio: int = 16
    audit: int = 64
    recall: float = 0.999
    per_shard: int = 8192


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares of extreme parts finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Graph:
    """Layers over the first nodes each (node order is random), the last layer being all nodes."""

    def __init__(self, vectors: np.ndarray, s: Setting):
        self.s, self.v = s, unit(vectors).astype(np.float32)
        sizes, n = [len(vectors)], len(vectors)
        while sizes[0] > 64:
            sizes.insert(0, max(1, sizes[0] // s.layer_ratio))
        self.layers: list[np.ndarray] = []
        for n in sizes:
            self._add_layer(n)

    def _add_layer(self, n: int) -> None:
        s, m = self.s, self.s.links
        self.layers.append(np.full((n, 2 * m), -1, np.int32))
        graph, worth = self.layers[-1], np.full((n, m), -2.0, np.float32)
        done = 0
        while done < n:
            new = np.arange(done, min(n, max(64, 2 * done) if done < 512 else done + 256))
            q = self.v[new]
            found, sims = np.full((len(new), 0), -1, np.int64), np.zeros((len(new), 0), np.float32)
            if done:
                found, sims = self.search(q, s.build_beam, limit=done)
            near = q @ q.T
            np.fill_diagonal(near, -2)
            top = np.argsort(-near, axis=1, kind="stable")[:, : min(s.build_beam, len(new) - 1)]
            found = np.concatenate([found, new[top]], 1)
            sims = np.concatenate([sims, np.take_along_axis(near, top, 1)], 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
            chosen = self._diverse(found, sims, m)
            graph[new, :m] = chosen
            self._back_links(graph, worth, new, chosen)
            done = new[-1] + 1

    def _diverse(self, found: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Up to m candidates each: those nearer to the node than to any chosen before, then the nearest others."""
        b, c = found.shape
        if c == 0:
            return np.full((b, m), -1, np.int64)
        c = min(c, 3 * m)
        found, sims = found[:, :c], sims[:, :c]
        valid = (found >= 0) & (sims > -2)
        w = self.v[np.maximum(found, 0)]
        between = np.einsum("bcd,bed->bce", w, w)
        pick = np.zeros((b, c), bool)
        for i in range(c):
            rival = np.where(pick[:, :i], between[:, i, :i], -2).max(1, initial=-2)
            pick[:, i] = valid[:, i] & (rival < sims[:, i]) & (pick[:, :i].sum(1) < m)
        rank = np.where(pick, 0, np.where(valid, 1, 2)) * c + np.arange(c)
        order = np.argsort(rank, axis=1, kind="stable")[:, :m]
        out = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(found, order, 1), -1)
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)

    def _back_links(self, graph: np.ndarray, worth: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        """Give each chosen neighbour a way back, in place of its least similar one if it has no room."""
        m = self.s.links
        to, frm = chosen.ravel(), np.repeat(new, chosen.shape[1])
        keep = to >= 0
        to, frm = to[keep], frm[keep]
        sim = np.einsum("nd,nd->n", self.v[to], self.v[frm])
        order = np.lexsort((-sim, to))
        to, frm, sim = to[order], frm[order], sim[order]
        turn = np.arange(len(to)) - np.searchsorted(to, to, side="left")
        for k in range(min(m, int(turn.max(initial=-1)) + 1)):
            i = np.flatnonzero(turn == k)
            t = to[i]
            slot = worth[t].argmin(1)
            better = sim[i] > worth[t, slot]
            t, slot, i = t[better], slot[better], i[better]
            graph[t, m + slot], worth[t, slot] = frm[i], sim[i]

    def search(self, q: np.ndarray, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes found for each query, best first (-1 where there are fewer)."""
        entry = np.zeros((len(q), 1), np.int64)
        for depth, graph in enumerate(self.layers):
            last = depth == len(self.layers) - 1
            ids, sims = self._beam(graph, q, entry, beam if last else 8, limit if last else None)
            entry = ids[:, :4]
        return ids, sims

    def _beam(self, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, limit: int | None, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        n = len(graph) if limit is None else limit
        b = np.arange(len(q))[:, None]
        entry = np.where(entry < n, entry, 0)
        seen = np.zeros((len(q), n + 1), bool)  # the last column takes what isn't there
        ids = np.full((len(q), beam), n, np.int64)
        sims = np.full((len(q), beam), -3, np.float32)
        opened = np.zeros((len(q), beam), bool)

        def merge(cand: np.ndarray) -> None:
            nonlocal ids, sims, opened
            cand = np.where((cand < 0) | (cand >= n), n, cand)
            cand = np.sort(cand, axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
            cand = np.where(seen[b, cand], n, cand)
            seen[b, cand] = True
            seen[:, n] = False
            s = np.where(cand < n, np.einsum("bcd,bd->bc", self.v[np.minimum(cand, n - 1)], q), -3).astype(np.float32)
            all_i, all_s = np.concatenate([ids, cand], 1), np.concatenate([sims, s], 1)
            all_o = np.concatenate([opened, np.zeros(cand.shape, bool)], 1)
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            ids, sims, opened = (np.take_along_axis(x, order, 1) for x in (all_i, all_s, all_o))

        merge(entry)
        while True:
            shut = ~opened & (ids < n)
            if not shut.any():
                return np.where(ids < n, ids, -1), sims
            first = np.argsort(~shut, axis=1, kind="stable")[:, :step]
            use = np.take_along_axis(shut, first, 1)
            np.put_along_axis(opened, first, True, 1)
            at = np.where(use, np.take_along_axis(ids, first, 1), 0)
            near = np.where(use[:, :, None], graph[at], -1)
            merge(near.reshape(len(q), -1).astype(np.int64))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.layers)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes, vectors: np.ndarray, s: Setting) -> Graph:
        self = cls.__new__(cls)
        self.s, self.v = s, unit(vectors).astype(np.float32)
        with np.load(io.BytesIO(blob)) as f:
            self.layers = [f[k] for k in f.files]
        return self


def links_in_shard(graph: Graph, queries: np.ndarray, vectors: np.ndarray, s: Setting) -> list[np.ndarray]:
    """For each query the nodes of the shard with cosine >= s.cosine."""
    q, v = unit(queries), unit(vectors)
    n, slack = len(v), 1e-4  # beams work in single precision
    out: list[np.ndarray | None] = [None] * len(q)

    def exact(i: int) -> np.ndarray:
        return np.flatnonzero(v @ q[i] >= s.cosine)

    def run(at: np.ndarray, beam: int) -> None:
        for lo in range(0, len(at), 256):
            part = at[lo : lo + 256]
            if beam >= n:
                for i in part:
                    out[i] = exact(i)
                continue
            ids, sims = graph.search(q[part].astype(np.float32), beam)
            full = (ids[:, -1] >= 0) & (sims[:, -1] >= s.cosine - slack)
            for row, i in enumerate(part):
                near = ids[row][(ids[row] >= 0) & (sims[row] >= s.cosine - slack)]
                out[i] = np.sort(near[v[near] @ q[i] >= s.cosine])
            if full.any():
                run(part[full], 2 * beam)

    beam = s.beam
    every = np.arange(len(q))
    sample = every[:: max(1, len(q) // s.audit)]
    while True:
        run(every, beam)
        if beam >= n:
            return out
        truth = [exact(i) for i in sample]
        total = sum(map(len, truth))
        if sum(len(np.intersect1d(a, out[i])) for a, i in zip(truth, sample, strict=True)) >= s.recall * total:
            return out
        beam *= 2


def found_links(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) places of all that was found."""
    size = np.array([len(f) for f in found], np.int64)
    flat = np.concatenate(found).astype(np.int64) if len(found) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(found)), size), flat


def near_duplicates(vectors: DataFrame, s: Setting = Setting()) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``."""
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    sound &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumn("vector", F.when(F.col("sound"), F.transform("embedding", lambda x: x.cast("double") + 0.0)))
    classes = staged(rows.where("sound").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("dim", F.size("vector")).withColumn("id", F.monotonically_increasing_id()), "vectors")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / s.per_shard).cast("int").alias("shards"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("least", "id"), F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["least", "id"], ignore_index=True)
        pdf = pdf.iloc[np.random.default_rng(1).permutation(len(pdf))]
        v = np.stack(pdf["vector"].to_list())
        first = pdf.iloc[0]
        return pd.DataFrame({
            "label": [first["label"]], "dim": [first["dim"]], "shards": [first["shards"]], "shard": [first["shard"]], "ids": [pdf["id"].to_numpy("<i8").tobytes()],
            "counts": [pdf["n"].to_numpy("<i8").tobytes()], "data": [v.astype("<f8").tobytes()], "graph": [Graph(v, s).dump()],
        })

    kind = dict(classes.dtypes)["label"]
    built = staged(dealt.groupBy("label", "dim", "shard").applyInPandas(build, f"label {kind}, dim int, shards int, shard int, ids binary, counts binary, data binary, graph binary"), "graphs")
    # unordered pairs of a label's shards: one row holds both graphs, so a link found from either side counts for both
    side = lambda prefix, at: built.select("label", "dim", *[F.col(c).alias(f"{prefix}_{c}") for c in ("shard", "ids", "counts", "data", "graph")], at)
    first = side("a", F.explode(F.sequence(F.col("shard"), F.col("shards") - 1)).alias("high")).withColumnRenamed("a_shard", "low")
    second = side("b", F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("low")).withColumnRenamed("b_shard", "high")
    pairs = first.join(second, ["label", "dim", "low", "high"])

    def query(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                a, b = (np.frombuffer(x, "<f8").reshape(-1, r.dim) for x in (r.a_data, r.b_data))
                a_ids, b_ids, a_counts, b_counts = (np.frombuffer(x, "<i8") for x in (r.a_ids, r.b_ids, r.a_counts, r.b_counts))
                u, w = found_links(links_in_shard(Graph.load(r.b_graph, b, s), a, b, s))
                if r.low == r.high:
                    u, w = np.concatenate([u, w]), np.concatenate([w, u])
                else:
                    y, x = found_links(links_in_shard(Graph.load(r.a_graph, a, s), b, a, s))
                    u, w = np.concatenate([u, x]), np.concatenate([w, y])
                u, w = np.unique(np.stack([u, w]), axis=1)
                other = a_ids[u] != b_ids[w]
                u, w = u[other], w[other]
                ids, total = a_ids, np.bincount(u, weights=b_counts[w], minlength=len(a)).astype(np.int64)
                if r.low != r.high:
                    ids, total = np.concatenate([a_ids, b_ids]), np.concatenate([total, np.bincount(w, weights=a_counts[u], minlength=len(b)).astype(np.int64)])
                x, y = forest(a_ids[u], b_ids[w])  # each tied to the least that it reaches here
                yield pd.DataFrame({"u": np.concatenate([ids, x]), "v": pd.array([None] * len(ids) + y.tolist(), "Int64"), "n": np.concatenate([total, np.zeros(len(x), np.int64)])})

    found = staged(pairs.drop("label").mapInPandas(query, "u long, v long, n long"), "links")
    counts = found.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("links"))
    joined = staged(components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "id"), "joined")
    # the classes have numbers of their own, as an id may stand at several vectors; a component has the least id of its classes
    named = joined.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("named"))
    joined = joined.join(named, "component").select("id", "named")
    per_class = classes.join(counts, "id").join(joined, "id", "left").select("label", "vector", (F.col("links") + F.col("n") - 1).alias("links"), F.coalesce("named", "least").alias("component"))
    out = rows.join(per_class, ["label", "vector"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
