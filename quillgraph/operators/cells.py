"""Nearest vectors by cosine over coarse cells with product-quantised codes, and an exact ranking of what they propose.

Fit. Centres of cells, and for each part of a vector the code words of what its centre leaves, are k-means of a bounded sample.
Every vector goes to its nearest centre and becomes a code of a byte for each part. Codes and vectors lie in blocks of bounded
size, so a cell with very many vectors (copies of one, say) is many blocks.

Search. Blocks are dealt into parts of bounded size. A query looks into its nearest cells and goes once to each part that has
some of them; a part's task loads it once, and the queries stream past. There the codes nearest to a query are its proposals,
these are ranked by exact cosine, and only a part's best ``k`` leave the task. Where a good share of a part would be proposed,
all of it is ranked. A sample of the queries is held against all vectors first: one plan asks with all doublings of cells and
proposals, and the first that reaches the wanted recall is taken (the last ranks everything).

Edge cases: null ids, vectors that are null, empty, zero or of another length than the first are left out; ties go to the
smaller id; a query's own id is no answer to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: Numbers in the vectors of a block at most, numbers that a task works on at once, and the share of a part that is worth choosing by codes.
BLOCK_NUMBERS, CHUNK, RANK_ALL = 1 << 20, 1 << 21, 16


@dataclass(frozen=True)
class Setting:
    sample: int = 16_384  #: vectors on which centres and code words are fitted
    cells: int = 1024  #: at most; the square root of the vectors if that is less
    part: int = 4  #: numbers of a vector that one code word stands for
    words: int = 256
    block: int = 16_384  #: vectors of a block, at most
    probes: int = 8
    proposals: int = 64
    recall: float = 0.95
    audit: int = 32  #: queries that are held against all vectors


@dataclass(frozen=True)
class Index:
    blocks: DataFrame  #: cell, block, ids, codes, raws (the vectors' bytes)
    vectors: DataFrame  #: id, vector (as given)
    centres: np.ndarray
    words: np.ndarray  #: part, word, number
    parts_of_cell: dict[int, int]
    rows: int
    setting: Setting


def means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means: centres of ``x``, drawn from it at first; a centre without points is drawn anew."""
    draw = np.random.default_rng(seed)
    centres = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[draw.integers(0, len(x), len(centres))])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([(half - x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def sound(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    v = F.col("vector")
    ok = F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("id", v.cast("array<double>").alias("vector")).where(ok)
    return rows.where(F.size("vector") == dim) if dim else rows


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small numbers would not be finite or be zero
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codes_of(x: np.ndarray, centres: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, codes) of unit vectors."""
    cell = nearest(x, centres)
    rest = x - centres[cell]
    width = words.shape[2]
    return cell, np.stack([nearest(rest[:, i * width : (i + 1) * width], w) for i, w in enumerate(words)], 1).astype(np.uint8)


def _fitted(drawn: DataFrame, dim: int, cells: int, s: Setting) -> tuple[np.ndarray, np.ndarray]:
    """(centres, words) of the sample, fitted in one task (it is bounded by the sample); the driver gets what was fitted, not the vectors."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.DataFrame()
        for rows in batches:
            pdf = pd.concat([pdf, rows]).sort_values(["key", "id"]).head(s.sample)
        if len(pdf):
            x = _unit(np.stack(pdf["vector"].to_list()).astype(float))
            centres = means(x, max(1, min(cells, len(x) // 4 or 1)))
            rest = x - centres[nearest(x, centres)]
            words = np.stack([means(rest[:, i : i + s.part], min(s.words, len(x))) for i in range(0, dim, s.part)])
            yield pd.DataFrame({"name": ["centres", "words"], "shape": [list(centres.shape), list(words.shape)], "data": [centres.tobytes(), words.tobytes()]})

    got = {r["name"]: np.frombuffer(r["data"]).reshape(r["shape"]) for r in drawn.repartition(1).mapInPandas(fit, "name string, shape array<int>, data binary").collect()}
    return (got["centres"], got["words"]) if got else (np.zeros((1, dim)), np.zeros((dim // s.part, 1, s.part)))


def _most(s: Setting, dim: int) -> int:
    """Vectors of a block, and of a part in the mean."""
    return max(1, min(s.block, BLOCK_NUMBERS // dim))


def build(vectors: DataFrame, s: Setting = Setting()) -> Index:
    """Index of (id, vector), its tables in the shared folder. The length of the vectors must be a multiple of ``part``."""
    rows = sound(vectors)
    first = rows.select(F.xxhash64("id").alias("key"), "id", F.size("vector").alias("dim")).agg(F.min_by("dim", F.struct("key", "id"))).first()[0]
    dim = first or s.part
    if dim % s.part:
        raise ValueError(f"vectors of {dim} numbers can't be cut into parts of {s.part}")
    kept = staged(sound(rows, dim), "vectors")
    n = kept.count()
    # drawn by a hash with a little to spare, so that no task and not the driver sorts vectors
    key = F.xxhash64("id")
    share = int(min(1.0, (s.sample + 4 * s.sample**0.5) / max(n, 1)) * (1 << 30))
    drawn = kept.select(key.alias("key"), "id", "vector").where(F.pmod(key, F.lit(1 << 30)) < share)
    centres, words = _fitted(drawn, dim, min(s.cells, int(n**0.5)), s)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["vector"].to_list())
            cell, codes = codes_of(_unit(x), centres, words)
            yield pd.DataFrame({"id": pdf["id"], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in codes], "raw": [v.tobytes() for v in x]})

    kind = dict(kept.dtypes)["id"]
    found = staged(kept.mapInPandas(coded, f"id {kind}, cell int, code binary, raw binary"), "codes")
    most = _most(s, dim)
    sizes = {r["cell"]: -(-r["count"] // most) for r in found.groupBy("cell").count().collect()}  # a row a cell
    parts = F.coalesce(*[F.when(F.col("cell") == c, F.lit(p)) for c, p in sizes.items() if p > 1], F.lit(1))
    packed = found.withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int")).groupBy("cell", "block").agg(F.collect_list(F.struct("id", "code", "raw")).alias("rows"))
    blocks = packed.select("cell", "block", *[F.col(f"rows.{c}").alias(f"{c}s") for c in ("id", "code", "raw")])
    return Index(staged(blocks, "blocks"), kept, centres, words, sizes, n, s)


class _Held:
    """What a task holds of a part, and its answers."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, codes: np.ndarray, raws: list[bytes], fitted: tuple[np.ndarray, np.ndarray], k: int):
        centres, words = fitted
        order = np.argsort(ids, kind="stable")
        own = int(np.unique(ids, return_counts=True)[1].max())
        # of copies of one vector no answer needs more than the smallest ids, besides a query's own
        copies = pd.DataFrame({"raw": pd.factorize(pd.Series([raws[i] for i in order], dtype=object))[0], "cell": cells[order]})
        keep = order[copies.groupby(["raw", "cell"]).cumcount().to_numpy() < k + own]
        self.k, self.ids, self.cells = k, ids[keep], cells[keep]  # in the order of ids
        self.x = np.frombuffer(b"".join(raws[i] for i in keep)).reshape(len(keep), -1)
        self.unit, self.length = _unit(self.x), np.sqrt(_in_turn(self.x, self.x))
        self.near = centres[self.cells] + np.concatenate([w[codes[keep, i]] for i, w in enumerate(words)], 1)
        self.half = 0.5 * (self.near**2).sum(1)

    def answers(self, queries: np.ndarray, x: np.ndarray, probed: list[list[int]], proposals: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of the query, id, cosine): the best ``k`` of each query."""
        every = proposals * RANK_ALL >= len(self.ids)
        step = max(1, CHUNK // (len(self.ids) + (0 if every else min(proposals, len(self.ids)) * x.shape[1])))
        for i in range(0, len(x), step):
            at, rows = self._best(queries[i : i + step], x[i : i + step], probed[i : i + step], len(self.ids) if every else proposals)
            some = max(1, CHUNK // x.shape[1])
            for j in range(0, len(at), some):  # once, but for very many equal cosines
                who, near = at[j : j + some], rows[j : j + some]
                dot, norm = _in_turn(self.x[near], x[i + who]), self.length[near] * np.sqrt(_in_turn(x[i + who], x[i + who]))
                cosine = np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
                first = np.lexsort((near, -cosine, who))
                first = first[np.arange(len(who)) - np.searchsorted(who, who[first]) < self.k]
                yield i + who[first], self.ids[near[first]], cosine[first]

    def _best(self, queries: np.ndarray, x: np.ndarray, probed: list[list[int]], proposals: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row): the rows whose cosine is that of the ``k``-th at least, but for what sums in another order may differ by."""
        names, place = np.unique(self.cells, return_inverse=True)
        looks = np.zeros((len(x), len(names)), bool)
        for i, cells in enumerate(probed):
            looks[i, np.isin(names, cells)] = True  # a cell's block of this part may have no vector
        out = ~looks[:, place]
        low, high = np.searchsorted(self.ids, queries), np.searchsorted(self.ids, queries, "right")
        for i in np.flatnonzero(high > low):
            out[i, low[i] : high[i]] = True
        unit = _unit(x)
        if proposals < len(self.ids):
            far = self.half - unit @ self.near.T
            far[out] = np.inf
            rows = np.argpartition(far, proposals - 1, axis=1)[:, :proposals]
            score = np.einsum("qd,qpd->qp", unit, self.unit[rows])
            score[np.take_along_axis(out, rows, 1)] = -np.inf
        else:
            rows, score = np.broadcast_to(np.arange(len(self.ids)), out.shape), unit @ self.unit.T
            score[out] = -np.inf
        k = min(self.k, score.shape[1])
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        at, column = np.nonzero((score >= least - 1e-9) & (score > -np.inf))
        return at, rows[at, column]


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first number to the last, as ``cosine`` of the functions does."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _found(index: Index, queries: DataFrame, levels: list[tuple[int, int]], k: int) -> DataFrame:
    """(level, query, rank, id, cosine): what (query, vector) finds with the probes and proposals of each level."""
    centres, words, blocks = index.centres, index.words, index.parts_of_cell
    kind, partitions = dict(index.vectors.dtypes)["id"], int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = max(1, min(sum(blocks.values()), max(4 * partitions, -(-index.rows // _most(index.setting, centres.shape[1])))))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = np.argsort((centres**2).sum(1) - 2 * _unit(x) @ centres.T, axis=1, kind="stable")
            rows, out = [], []
            for i, cells in enumerate(near.tolist()):
                for level, (probes, _) in enumerate(levels):
                    to: dict[int, list[int]] = {}
                    for c in cells[:probes]:
                        for p in {(c + b) % dealt for b in range(blocks.get(c, 0))}:
                            to.setdefault(p, []).append(c)
                    rows += [i] * len(to)
                    out += [(p, level, own) for p, own in to.items()]
            part, level, own = zip(*out, strict=True) if out else ((), (), ())
            raws = [x[i].tobytes() for i in range(len(x))]
            columns = [pa.array(part, pa.int32()), pa.array(level, pa.int32()), batch.column("query").take(pa.array(rows, pa.int64())), pa.array(own, pa.list_(pa.int32())), pa.array([[raws[i]] for i in rows], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "level", "query", "cells", "raws"])

    asks = queries.select("query", "vector").mapInArrow(probed, f"part int, level int, query {kind}, cells array<int>, raws array<binary>")
    loads = index.blocks.withColumn("part", F.pmod(F.col("cell") + F.col("block"), F.lit(dealt)).cast("int"))
    loads = loads.join(F.broadcast(asks.select("part").distinct()), "part", "left_semi").select("part", F.lit(-1).alias("level"), F.lit(None).cast(kind).alias("query"), F.array("cell").alias("cells"), "raws", "ids", "codes")
    both = loads.unionByName(asks.withColumns({"ids": F.lit(None).cast(f"array<{kind}>"), "codes": F.lit(None).cast("array<binary>")}))
    both = both.repartition(partitions, "part").sortWithinPartitions("part", "level")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, held = -1, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "level")], 1)
            starts = [0, *(1 + np.flatnonzero((keys[1:] != keys[:-1]).any(1))).tolist(), len(keys)]
            for i, j in zip(starts, starts[1:], strict=False):
                own, (at, level) = batch.slice(i, j - i), keys[i].tolist()
                if at != part:
                    part, rows, held = at, [], None
                if level < 0:
                    rows.append(own)
                    continue
                if held is None and not rows:
                    continue
                if held is None:
                    flat = {c: [r.column(c).flatten() for r in rows] for c in ("ids", "codes", "raws", "cells")}
                    many = np.concatenate([r.column("ids").value_lengths().to_numpy(zero_copy_only=False) for r in rows])
                    ids = pa.concat_arrays(flat["ids"]).to_numpy(zero_copy_only=False)
                    codes = np.frombuffer(b"".join(c for f in flat["codes"] for c in f.to_pylist()), np.uint8).reshape(-1, len(words))
                    held, rows = _Held(ids, np.repeat(pa.concat_arrays(flat["cells"]).to_numpy(), many), codes, [r for f in flat["raws"] for r in f.to_pylist()], (centres, words), k), []
                x = np.frombuffer(b"".join(own.column("raws").flatten().to_pylist())).reshape(own.num_rows, -1)
                queries = own.column("query").to_numpy(zero_copy_only=False)
                for who, ids, cosine in held.answers(queries, x, own.column("cells").to_pylist(), levels[level][1]):
                    columns = [pa.array(np.full(len(who), level, np.int32)), own.column("query").take(pa.array(who)), pa.array(ids, own.schema.field("query").type), pa.array(cosine)]
                    yield pa.RecordBatch.from_arrays(columns, ["level", "query", "id", "cosine"])

    rows = both.mapInArrow(look, f"level int, query {kind}, id {kind}, cosine double")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("level", "query").orderBy(F.col("cosine").desc(), "id"))).where(F.col("rank") <= k)


def exact(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank, id, cosine) by brute force; for a bounded set of queries, which is sent to every task."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    asked = F.broadcast(queries.select("query", F.col("vector").alias("asked"), F.sqrt(dot("vector", "vector")).alias("own")))
    norm = F.col("length") * F.col("own")
    cosine = F.when(norm > 0, dot("vector", "asked") / norm).otherwise(F.lit(0.0))
    rows = index.vectors.withColumn("length", F.sqrt(dot("vector", "vector"))).crossJoin(asked).where("query <> id").select("id", "query", cosine.alias("cosine"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("cosine").desc(), "id"))).where(F.col("rank") <= k)


def widened(index: Index, queries: DataFrame, k: int) -> Setting:
    """The setting with as many probes and proposals as the audit asks for."""
    s, cells, n = index.setting, len(index.centres), max(1, index.rows)
    some = staged(queries.orderBy(F.xxhash64("query"), "query").limit(s.audit), "audit")
    levels = [(min(cells, s.probes), min(n, s.proposals))]
    while levels[-1] != (cells, n):
        levels.append((min(cells, 2 * levels[-1][0]), min(n, 2 * levels[-1][1])))
    want = staged(exact(index, some, k), "truth")
    # as near as the k-th is as good as the k-th
    least = F.broadcast(want.groupBy("query").agg(F.min("cosine").alias("least")))
    hits = {r["level"]: r["count"] for r in _found(index, some, levels, k).join(least, "query").where("cosine >= least").groupBy("level").count().collect()}  # a row a level
    total = want.count()
    probes, proposals = next((w for i, w in enumerate(levels) if hits.get(i, 0) >= s.recall * total), levels[-1])
    return replace(s, probes=probes, proposals=proposals)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank, id, cosine): the ``k`` nearest found for each row of (query, vector)."""
    dim = index.centres.shape[1]
    asked = staged(sound(queries.withColumnRenamed("query", "id"), dim).withColumnRenamed("id", "query"), "asked")
    s = widened(index, asked, k)
    return _found(index, asked, [(s.probes, s.proposals)], k).select("query", "rank", "id", "cosine")
