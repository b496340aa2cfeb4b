"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

1. Every text becomes token ids and a closing id. Whole windows of a long document are sequences of their own; what is
   left at its end (the tail, shorter than a window) goes on, with the document frequencies of all tokens.
2. Tails are dealt to shards of about ``per_shard`` by their rarest term that another document has as well, so that related
   ones meet; the tails of a common key are spread over as many shards as they need. The table that says where a key's
   tails go has one entry per token of the vocabulary.
3. Each shard has an inverted index with BM25 weights (terms are token ids; frequencies are those of the corpus). A
   seed asks it with all its terms and walks down the ranking of all unused tails of the shard: best first, as long as they
   fit whole, then the best remaining one is cut to fill the window. The shard's last tokens, too few for a window, become
   sequences whose lengths are powers of two, so nothing is padded.

The work grows in proportion to the table; a seed looks for neighbours in its own shard only.

Edge cases: null and empty texts are just the closing id; repeated rows are packed each; null ids are carried through; an
empty table gives an empty result. Texts that hold a special token's string are encoded by the tokenizer library itself.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, mix64, staged

LONGS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "row_id")
TOKENISED = ", ".join(f"{c} long" for c in LONGS) + ", ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
EACH = 1 << 35  #: rows or sequences that one task may number
COMMON = 512  #: terms of most tails in a shard, whose weights are kept as a dense matrix


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The reversible alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a byte-level BPE file of the ``tokenizers`` library.

    If the ids of the file are the ranks of its merges, texts are encoded by ``tiktoken`` with these ranks, which gives the
    same ids faster.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.whole.get_vocab_size()
        alphabet, vocab = _byte_of_char(), spec["model"]["vocab"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.plain = None
        if all(vocab[m] == 256 + i for i, m in enumerate(merged)) and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel":
            import public_tokenizers
            import tiktoken

            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.plain = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.plain is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.plain.encode_to_numpy(text, disallowed_special=())


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, path: str, window: int, closing_id: int = 0) -> DataFrame:
    """Rows of three kinds: whole windows (with ``sequence_id``), tails with their ids (with ``row_id``), and a task's document
    frequencies (with neither)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        base = TaskContext.get().partitionId() * EACH
        df = np.zeros(max(encode.size, closing_id + 1), np.int64)
        seen = np.zeros(len(df), bool)
        seq = row = 0

        def batch(rows: list[tuple], ids: list[bytes | None]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(LONGS)
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(ids, pa.binary())], names=[*LONGS, "ids"])

        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                part, rows, held = whole.slice(lo, 500), [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(closing_id))
                    seen[ids] = True
                    own = np.flatnonzero(seen)
                    df[own] += 1
                    seen[own] = False
                    n = len(ids)
                    for start in range(0, n - window + 1, window):
                        rows.append((doc_id, start, window, crc(ids[start : start + window]), n, 2 * (base + seq), None))
                        held.append(None)
                        seq += 1
                    if n % window:
                        start = n - n % window
                        rows.append((doc_id, start, n - start, None, n, None, base + row))
                        held.append(ids[start:].astype("<u2" if len(df) <= 65536 else "<u4").tobytes())
                        row += 1
                yield batch(rows, held)
        yield batch([(None, None, len(df), None, None, None, None)], [df.tobytes()])

    return documents_of(docs, "doc_id", "text").mapInArrow(run, TOKENISED)


@dataclass
class Index:
    """Inverted index of a shard: for each term, the tails that hold it and their BM25 weights; commonest terms as a matrix."""

    at: np.ndarray
    tails: np.ndarray
    weights: np.ndarray
    common: np.ndarray
    dense: np.ndarray
    n_tails: int

    @classmethod
    def build(cls, tails: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float | None = None, k1: float = 1.5, b: float = 0.75) -> Index:
        n, size = len(tails), len(df)
        length = np.array([len(t) for t in tails])
        mean = mean or length.mean()
        key, tf = np.unique(np.repeat(np.arange(n), length) * size + np.concatenate(tails), return_counts=True)
        tail, term = key // size, key % size
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        weight = (idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[tail] / mean))).astype(np.float32)
        own = np.bincount(term, minlength=size)
        column = np.full(size, -1)
        common = np.argsort(-own, kind="stable")[:COMMON]
        common = common[own[common] * 64 > n]
        column[common] = np.arange(len(common))
        dense = np.zeros((len(common), n), np.float32)
        often = column[term] >= 0
        dense[column[term[often]], tail[often]] = weight[often]
        tail, term, weight = tail[~often], term[~often], weight[~often]
        order = np.argsort(term, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))])
        return cls(at, tail[order], weight[order], column, dense, n)

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """BM25 of all tails for all distinct terms of each query."""
        terms = [np.unique(q) for q in queries]
        held = np.zeros((len(queries), len(self.dense)), np.float32)
        for row, q in zip(held, terms, strict=True):
            row[self.common[q[self.common[q] >= 0]]] = 1
        out = held @ self.dense
        for row, q in zip(out, terms, strict=True):
            q = q[self.at[q + 1] > self.at[q]]
            spans = [slice(i, j) for i, j in zip(self.at[q].tolist(), self.at[q + 1].tolist(), strict=True)]
            if spans:
                row += np.bincount(np.concatenate([self.tails[x] for x in spans]), np.concatenate([self.weights[x] for x in spans]), self.n_tails)
        return out


def fill(tails: list[np.ndarray], index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """(tail, first, length, sequence, offset) of every piece; each token in one piece, every sequence but the last full."""
    n = len(tails)
    first, unused, out = np.zeros(n, np.int64), np.ones(n, bool), []
    left = np.array([len(t) for t in tails], np.int64)
    at, seq = 0, 0
    while unused.any():
        at += int(np.argmax(unused[at:]))
        room = window

        def put(i: int, length: int, seq: int = seq) -> None:
            nonlocal room
            out.append((i, int(first[i]), length, seq, window - room))
            first[i] += length
            left[i] -= length
            room -= length
            unused[i] = left[i] > 0

        put(at, int(left[at]))
        if room:
            near = np.flatnonzero(unused)
            score = index.scores([tails[at]])[0][near]
            near = near[np.lexsort((near, -score))]
            while room and len(near):
                fits = left[near] <= room
                if not fits.any():
                    put(int(near[0]), room)
                    break
                i = int(fits.argmax())
                put(int(near[i]), int(left[near[i]]))
                near = np.delete(near, i)
        seq += 1
    return out


def in_powers(pieces: list[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """The pieces with the last sequence, if it isn't full, cut into sequences whose lengths are powers of two, longest first."""
    last = max((p[3] for p in pieces), default=0)
    short = [p for p in pieces if p[3] == last]
    total = sum(p[2] for p in short)
    if total == window:
        return pieces
    out, seq = [p for p in pieces if p[3] != last], last
    sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    used = 0
    for tail, first, length, _, _ in short:
        while length:
            take = min(length, sizes[0] - used)
            out.append((tail, first, take, seq, used))
            first, length, used = first + take, length - take, used + take
            if used == sizes[0]:
                sizes, seq, used = sizes[1:], seq + 1, 0
    return out


def ids_of(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if width == 2 else "<u4").astype(np.int64)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 1024, per_shard: int = 1000) -> DataFrame:
    """Every piece of every document with its place."""
    path = tokenizer or default_tokenizer()
    rows = staged(tokenised(docs, path, window), "tokens")
    spark = docs.sparkSession

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("ids"):
                n = np.frombuffer(x.as_py(), np.int64)
                total = n.copy() if total is None else total + n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["token", "n"])

    # the vocabulary bounds what comes to the driver: one row per token id, whatever the corpus
    counts = rows.where("row_id is null and sequence_id is null").select("ids").mapInArrow(summed, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 1, np.int64)
    df[counts["token"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    # rarest first, but terms of a single document last: they can't bring two together
    by_rarity = np.lexsort((np.arange(len(df)), df, df < 2))
    rank = np.empty(len(df), np.int64)
    rank[by_rarity] = np.arange(len(df))
    width = F.when(F.col("length") > 0, F.octet_length("ids") / F.col("length")).cast("int")
    tails = rows.where("row_id is not null").select("row_id", "doc_id", "start", "doc_tokens", "length", "ids", width.alias("width"))
    ranks = spark.sparkContext.broadcast(rank)

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([ranks.value[ids_of(b, w)].min() for b, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True)], np.int64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys(batch))], names=["key"])

    per_key = tails.select("ids", "width").mapInArrow(keyed, "key long").groupBy("key").count().toPandas()
    size = np.zeros(len(df), np.int64)
    size[per_key["key"].to_numpy(np.int64)] = per_key["count"].to_numpy(np.int64)
    begin = np.cumsum(size) - size
    n_docs = int(df[0])  # every document has the closing id
    mean = tails.agg(F.avg("length")).first()[0] or 1.0
    places = spark.sparkContext.broadcast((size, begin, df))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = keys(batch)
            n, b, _ = places.value
            turn = (mix64(batch.column("row_id").to_numpy().view(np.uint64)) % n[k].astype(np.uint64)).astype(np.int64) if len(k) else k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((b[k] + turn) // per_shard)], names=[*batch.schema.names, "shard"])

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")
        ids = [ids_of(b, w) for b, w in zip(table.column("ids").to_pylist(), table.column("width").to_pylist(), strict=True)]
        pieces = in_powers(fill(ids, Index.build(ids, places.value[2], n_docs, mean), window), window)
        at, first, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        base = table.column("shard")[0].as_py() << 30
        of = pa.array(at)
        out = [
            table.column("doc_id").take(of), pa.array(table.column("start").to_numpy()[at] + first), pa.array(length), pa.array([crc(ids[p[0]][p[1] : p[1] + p[2]]) for p in pieces], pa.int64()),
            table.column("doc_tokens").take(of), pa.array(2 * (base + seq) + 1), pa.array(offset),
        ]
        return pa.table(out, names=[c.split()[0] for c in PIECES.split(", ")])

    schema = "row_id long, doc_id long, start long, doc_tokens long, length long, ids binary, width int, shard long"
    placed = tails.mapInArrow(dealt, schema).groupBy("shard").applyInArrow(packed, PIECES)
    whole = rows.where("sequence_id is not null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(placed)
