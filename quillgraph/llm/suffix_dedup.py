"""Repeated passages by range-partitioned suffixes.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller id.

Suffixes are taken at content-defined places: the least hash of the 16-byte strings in every ``length``-byte window. Equal
windows choose the same place, so no repeat is missed, and about one suffix in eighteen is kept.

1. Sampled splitters range-partition the suffixes by their leading bytes; a range that the sample finds to be more than
   a bucket's share is dealt on by a hash of the leading 16 bytes. Every group of documents sends each bucket the (hashed)
   leading 16 bytes that it has; the bucket sends back those found in two documents or more.
2. For these suffixes, a group sends each distinct context (the bytes around the place, with the smallest id that has
   it) to its bucket. The bucket sorts the contexts forwards and backwards by multikey quicksort, compares neighbours,
   and so finds, for each window over the place, all contexts that agree in it, and their smallest id. Contexts of leading
   bytes that are more than two buckets' share are sent once for each of FAMILIES ranges of windows, to buckets by the
   bytes that all windows of the range have in common, so a common string is split by its surroundings.
3. The runs of windows with these ids go back to the groups, which mark the bytes of their documents.

Only distinct leading strings and contexts travel, so copies cost one entry a group, whatever their number. The groups
of documents are dealt once (all three steps read the same exchange).

Edge cases: null and empty texts have no bytes; a null id sorts after all others (its repeats of other documents go,
and nothing goes for its sake); rows of the same id don't remove each other's bytes; results are per row; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, arrow_schema, batch_of, documents_of, staged, utf8

LEAD = 16
FAMILIES = 5  #: ranges of windows into which the contexts of common leading bytes are split
BATCH = 1 << 20  #: bytes that one round of array work takes
LEADS = "bucket long, p long, a binary"
CONTEXTS = "bucket long, p long, ids binary, several binary, bytes binary, sizes binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
NOTE = "p long, bucket long, kind string, a binary, b binary, c binary, d binary"


def _u64(x: int) -> np.uint64:
    return np.uint64(x)


def sliding(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


@dataclass
class Batch:
    """Some documents, end to end."""

    rows: list[int]
    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    bytes: np.ndarray


def batches_of(docs: pa.Table | pa.RecordBatch) -> Iterator[Batch]:
    rows, held, size = [], [], 0
    ids = pc.fill_null(docs.column("doc_id"), NULL_ID).to_numpy()

    def batch() -> Batch:
        sizes = np.array([len(b) for b in held], np.int64)
        return Batch(rows, ids[rows], np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(held), np.uint8))

    for i, text in enumerate(docs.column("text")):
        b = utf8(text.as_py())
        if rows and size + len(b) > BATCH:
            yield batch()
            rows, held, size = [], [], 0
        rows.append(i)
        held.append(b)
        size += len(b)
    if rows:
        yield batch()


@dataclass
class Places:
    """Chosen places of a batch: byte, document (its number in the batch), hash and first 8 of the leading bytes."""

    at: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    lead: np.ndarray


def places(batch: Batch, length: int) -> Places:
    n, span = len(batch.bytes), length - LEAD + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return Places(none, none, none.astype(np.uint64), none.astype(np.uint64))
    x = batch.bytes.astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << _u64(8 * step)) | x[step:]
    h = x[:-8] * _u64(0x9E3779B97F4A7C15) + x[8:] * _u64(0xC2B2AE3D27D4EB4F)
    h ^= h >> _u64(29)
    h *= _u64(0xBF58476D1CE4E5B9)
    h ^= h >> _u64(32)
    h |= _u64(1)
    least = sliding(h, span, np.minimum)  # of every window
    inside = np.zeros(n + 1, np.int32)
    long = batch.sizes >= length
    np.add.at(inside, batch.starts[long], 1)
    np.add.at(inside, (batch.starts + batch.sizes - length + 1)[long], -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0  # windows over two documents
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), span, np.maximum) == h)
    return Places(at, np.searchsorted(batch.starts + batch.sizes, at, side="right"), h[at], x[at])


@dataclass
class Contexts:
    """Bytes around places: ``back`` before (nearest first) and ``length`` from it on, and how many are in the document."""

    back: np.ndarray
    front: np.ndarray
    n_back: np.ndarray
    n_front: np.ndarray
    key: np.ndarray  #: 128-bit hash of all of it, in two halves
    half: np.ndarray


def contexts(batch: Batch, at: np.ndarray, doc: np.ndarray, length: int) -> Contexts:
    reach = length - LEAD
    first, last = batch.starts[doc], batch.starts[doc] + batch.sizes[doc]
    n_back, n_front = np.minimum(at - first, reach).astype(np.uint8), np.minimum(last - at, length).astype(np.uint8)

    def take(offsets: np.ndarray, limit: np.ndarray) -> np.ndarray:
        where = np.clip(at[:, None] + offsets, 0, len(batch.bytes) - 1)
        return np.where(np.arange(len(offsets)) < limit[:, None], batch.bytes[where], 0).astype(np.uint8)

    back, front = take(-1 - np.arange(reach), n_back), take(np.arange(length), n_front)
    return Contexts(back, front, n_back, n_front, *context_keys(front, back, np.stack([n_back, n_front], 1)))


def context_keys(front: np.ndarray, back: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, half = np.zeros(len(front), np.uint64), np.full(len(front), 0x243F6A8885A308D3, np.uint64)
    for w in as_words(np.concatenate([front, back, sizes], 1)).T:
        key = (key ^ w) * _u64(0x9E3779B97F4A7C15)
        key ^= key >> _u64(31)
        half = (half + w) * _u64(0xD6E8FEB86659FD93)
        half ^= half >> _u64(29)
    return key, half


def first_of_each(key: np.ndarray, half: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and id, and whether each place in it is the first of its key."""
    order = np.lexsort((ids, half, key))
    k, h = key[order], half[order]
    return order, np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]) if len(order) else np.zeros(0, bool)


def as_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 8-byte words, padded with zeros."""
    pad = -rows.shape[1] % 8
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)


def multikey_sort(rows: np.ndarray, small: int = 4096) -> np.ndarray:
    """Order of byte rows by multikey quicksort over their words: those less than a pivot in the word looked at, those equal to
    it, and those greater; only the equal ones go on to the next word. Groups of at most ``small`` rows are finished word by
    word, ties only."""
    words = as_words(rows)
    order, left = np.arange(len(rows)), [(0, len(rows), 0)]
    while left:
        lo, hi, k = left.pop()
        if hi - lo < 2 or k == words.shape[1]:
            continue
        own = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = own[_tie_by_tie(words[own, k:])]
            continue
        key = words[own, k]
        pivot = np.sort(key[:: max(1, len(key) // 64)])[min(len(key), 64) // 2]
        less, more = key < pivot, key > pivot
        order[lo:hi] = np.concatenate([own[less], own[~(less | more)], own[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        left += [(lo, a, k), (a, b, k + 1), (b, hi, k)]
    return order


def _tie_by_tie(words: np.ndarray) -> np.ndarray:
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.concatenate([[False], words[order[1:], 0] == words[order[:-1], 0]])
    for k in range(1, words.shape[1]):
        if not tied.any():
            break
        group = np.cumsum(~tied)
        open_ = tied | np.append(tied[1:], False)
        at = np.flatnonzero(open_)
        sub = order[at]
        order[at] = sub[np.lexsort((words[sub, k], group[at]))]
        tied[1:] &= words[order[1:], k] == words[order[:-1], k]
    return order


def agreement(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the one before it in ``order`` (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 50_000):
        hi = min(len(order), lo + 50_000)
        differ = rows[order[lo:hi]] != rows[order[lo - 1 : hi - 1]]
        out[lo:hi] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def smallest_ids(c: Contexts, ids: np.ndarray, length: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window (that starts ``o`` bytes before the place, from first to last): the contexts that hold it, and the smallest id of all that agree in it."""
    forward, backward = multikey_sort(c.front), multikey_sort(c.back)
    shared_f, shared_b = agreement(c.front, forward), agreement(c.back, backward)
    class_f, class_b = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for o in range(first, last + 1):
        class_f[forward] = np.cumsum(shared_f < length - o)
        class_b[backward] = np.cumsum(shared_b < o)
        own = np.flatnonzero((c.n_back >= o) & (c.n_front >= length - o))
        if not len(own):
            continue
        pair = class_f[own] * (len(ids) + 1) + class_b[own]
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[True], pair[order[1:]] != pair[order[:-1]]])
        low = np.minimum.reduceat(ids[own[order]], np.flatnonzero(new))
        found = np.empty(len(own), np.int64)
        found[order] = low[np.cumsum(new) - 1]
        yield o, own, found


def _pack(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _join(blobs, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def distinct_leads(docs: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a group's leading strings, whether two documents of the group have it, and the first 8 bytes."""
    found = []
    for batch in batches_of(docs):
        p = places(batch, length)
        found.append((p.hash, batch.ids[p.doc], p.lead))
    h, ids, lead = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, h))
    h, ids, lead = h[order], ids[order], lead[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(h) else new
    return h[first], several, lead[first]


def short(h: np.ndarray) -> np.ndarray:
    """31 bits of a hash. They only choose what is looked at within a bucket, and a bucket holds about as many leading
    strings at every size of the corpus, so chance hits stay rare."""
    return (h >> _u64(33)).astype(np.uint32)


@dataclass
class Buckets:
    """Ranges of leading bytes, each dealt on to so many buckets; and the hashes of leading bytes too common for one bucket."""

    splitters: np.ndarray
    parts: np.ndarray  #: buckets of each range
    common: np.ndarray  #: sorted hashes
    pool: int  #: buckets for each family of windows of the common ones

    def of(self, lead: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.splitters, lead, side="right")
        first = np.cumsum(self.parts) - self.parts
        return first[at] + ((h >> _u64(1)) % self.parts[at].astype(np.uint64)).astype(np.int64)

    def is_common(self, h: np.ndarray) -> np.ndarray:
        return np.isin(h, self.common)

    def family_of(self, bucket: int) -> int | None:
        own = bucket - int(self.parts.sum())
        return own % FAMILIES if own >= 0 else None

    def of_family(self, family: int, key: np.ndarray) -> np.ndarray:
        return int(self.parts.sum()) + (key % _u64(self.pool)).astype(np.int64) * FAMILIES + family


def families(length: int) -> list[tuple[int, int]]:
    """First and last window (bytes that it starts before the place) of each family."""
    return [(int(w[0]), int(w[-1])) for w in np.array_split(np.arange(length - LEAD + 1), FAMILIES) if len(w)]


def buckets_of(seen: pd.DataFrame, common: pd.DataFrame, n: int, groups: int) -> Buckets:
    """``groups`` buckets or so, of about the same share of a sample of leading bytes (``seen``, of ``n`` in all), and the
    common ones (hash and count in the sample)."""
    lead = np.sort(seen["lead"].to_numpy(np.int64).view(np.uint64))
    if not len(lead):
        return Buckets(lead, np.array([groups]), lead, 1)
    splitters = np.unique(lead[(np.arange(1, groups) * len(lead)) // groups])
    share = np.diff(np.concatenate([[0], np.searchsorted(lead, splitters, side="left"), [len(lead)]])) / len(lead)
    pool = int(np.ceil(common["count"].sum() * groups / n))
    return Buckets(splitters, np.maximum(1, np.round(share * groups)).astype(np.int64), np.sort(common["hash"].to_numpy(np.int64).view(np.uint64)), max(1, pool))


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


class Removal:
    """Which bytes of a group's documents go, given what the buckets sent back."""

    def __init__(self, notes: pd.DataFrame, length: int, buckets: Buckets):
        self.length, self.buckets = length, buckets
        leads = notes[notes["kind"] == "lead"]
        of = np.repeat(leads["bucket"].to_numpy(np.int64), [len(a) // 4 for a in leads["a"]])
        self.leads = np.unique((of.astype(np.uint64) << _u64(32)) | _join(leads["a"], "<u4").astype(np.uint64))
        runs = notes[notes["kind"] == "run"]
        self.key, self.low, self.windows = _join(runs["a"], "<u8"), _join(runs["b"], "<i8"), _join(runs["c"], "u1").reshape(-1, 2).astype(np.int64)
        order = np.argsort(self.key, kind="stable")
        self.key, self.half, self.low, self.windows = self.key[order], _join(runs["d"], "<u8")[order], self.low[order], self.windows[order]

    def candidates(self, batch: Batch) -> tuple[Places, Contexts]:
        p = places(batch, self.length)
        code = (self.buckets.of(p.lead, p.hash).astype(np.uint64) << _u64(32)) | short(p.hash).astype(np.uint64)
        i = np.searchsorted(self.leads, code)
        hit = np.zeros(len(p.at), bool)
        inside = i < len(self.leads)
        hit[inside] = self.leads[i[inside]] == code[inside]
        p = Places(p.at[hit], p.doc[hit], p.hash[hit], p.lead[hit])
        return p, contexts(batch, p.at, p.doc, self.length)

    def mask(self, batch: Batch) -> np.ndarray:
        p, c = self.candidates(batch)
        lo, hi = np.searchsorted(self.key, c.key, side="left"), np.searchsorted(self.key, c.key, side="right")
        n = hi - lo
        of = np.repeat(np.arange(len(n)), n)
        run = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        goes = (self.half[run] == c.half[of]) & (self.low[run] < batch.ids[p.doc[of]])
        of, run = of[goes], run[goes]
        cover = np.zeros(len(batch.bytes) + 1, np.int32)
        np.add.at(cover, p.at[of] - self.windows[run, 1], 1)
        np.add.at(cover, p.at[of] - self.windows[run, 0] + self.length, -1)
        return np.cumsum(cover[:-1]) > 0


def removals(docs: DataFrame, finish: Callable[[pa.Table, Iterator[tuple[int, np.ndarray, np.ndarray]]], pa.Table], schema, length: int = 50, group_bytes: int = 16 << 20, step: int = 37, sampled: int = 1000, least: int = 32) -> DataFrame:
    """``finish(rows, (row, bytes, goes) of each)`` for every group of documents; ``goes`` marks the bytes to remove.

    Rows are dealt to groups by id and text, so that those without an id or of the same id are spread as well.

    The sample that shapes the buckets (results don't depend on it) is every ``step``-th suffix of one document in
    ``sampled``, or of one in as many as there are groups if these are fewer; it is counted by Spark, and of it at most
    200,000 leading bytes come to the driver. Leading bytes seen ``least`` times, and more than two buckets' share, are
    common.
    """
    docs_size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-docs_size // group_bytes))
    group = "_group"
    while group in docs.columns:
        group += "_"
    dealt = docs.withColumn(group, F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))

    def sample(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            for batch in batches_of(part):
                p = places(batch, length)
                yield pa.RecordBatch.from_arrays([pa.array(x[::step].view(np.int64)) for x in (p.lead, p.hash)], names=["lead", "hash"])

    buckets = Buckets(np.zeros(0, np.uint64), np.ones(1, np.int64), np.zeros(0, np.uint64), 1)
    if groups > 1:
        few = documents_of(docs, "doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(min(groups, sampled))) == 0)
        drawn = staged(few.mapInArrow(sample, "lead long, hash long"), "suffix-sample")
        n = drawn.count()
        often = drawn.groupBy("hash").count().where((F.col("count") >= least) & (F.col("count") * groups > 2 * n))
        buckets = buckets_of(drawn.orderBy(F.xxhash64("lead", "hash"), "lead").limit(200_000).toPandas(), often.toPandas(), n, groups)

    def table_of(rows: list[tuple], kinds: str) -> pa.Table:
        return pa.Table.from_batches([batch_of(rows, arrow_schema(kinds))])

    def send_leads(docs: pa.Table) -> pa.Table:
        h, several, lead = distinct_leads(docs, length)
        own = docs.column(group)[0].as_py()
        return table_of([(b, own, _pack((short(h[i]) << np.uint32(1)) | several[i], "<u4")) for b, i in by_bucket(buckets.of(lead, h))], LEADS)

    def common_leads(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = _join(pdf["a"], "<u4")
        h = codes >> np.uint32(1)
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        goes = (codes & np.uint32(1)).astype(bool) | (count[back] > 1)
        ends = np.cumsum([len(a) // 4 for a in pdf["a"]])
        rows = [(p, b, "lead", _pack(h[s:e][goes[s:e]], "<u4"), None, None, None) for p, b, s, e in zip(pdf["p"], pdf["bucket"], [0, *ends[:-1]], ends, strict=True)]
        return pd.DataFrame([r for r in rows if r[3]], columns=["p", "bucket", "kind", "a", "b", "c", "d"])

    def send_contexts(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(docs) or not len(notes):
            return table_of([], CONTEXTS)
        job, found, squeeze = Removal(notes.to_pandas(), length, buckets), [], zstandard.ZstdCompressor(level=3)
        for batch in batches_of(docs):
            p, c = job.candidates(batch)
            ids = batch.ids[p.doc]
            order, new = first_of_each(c.key, c.half, ids)
            first = order[new]
            top = np.maximum.reduceat(ids[order], np.flatnonzero(new)) if len(order) else ids
            found.append((c.key[first], c.half[first], ids[first], top, p.lead[first], p.hash[first], np.concatenate([c.front, c.back], 1)[first], np.stack([c.n_back, c.n_front], 1)[first]))
        key, half, low, top, lead, h, data, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        order, new = first_of_each(key, half, low)
        first, at = order[new], np.flatnonzero(new)
        several = np.maximum.reduceat(top[order], at) != low[first] if len(key) else new
        rows, own = [], docs.column(group)[0].as_py()

        def send(to: np.ndarray, at: np.ndarray) -> None:
            for b, i in by_bucket(to):
                i = at[i]
                i = i[multikey_sort(data[first[i]])]  # neighbours share bytes, and so need less room
                f = first[i]
                rows.append((b, own, _pack(low[f], "<i8"), _pack(several[i], "u1"), squeeze.compress(data[f].tobytes()), sizes[f].tobytes()))

        often = buckets.is_common(h[first])
        rare = np.flatnonzero(~often)
        send(buckets.of(lead[first[rare]], h[first[rare]]), rare)
        if often.any():
            for k, (a, z) in enumerate(families(length)):
                i = np.flatnonzero(often & (sizes[first, 0] >= a) & (sizes[first, 1] >= length - z))
                shared = data[first[i]][:, [*range(length - z), *range(length, length + a)]]  # what its windows have in common
                send(buckets.of_family(k, context_keys(shared, shared[:, :0], shared[:, :0])[0]), i)
        return table_of(rows, CONTEXTS)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, several = _join(pdf["ids"], "<i8"), _join(pdf["several"], "u1").astype(bool)
        data, sizes = _join(map(zstandard.ZstdDecompressor().decompress, pdf["bytes"]), "u1").reshape(len(ids), -1), _join(pdf["sizes"], "u1").reshape(-1, 2)
        key, half = context_keys(data[:, :length], data[:, length:], sizes)
        # equal contexts of several groups are compared once
        order, new = first_of_each(key, half, ids)
        first, back = order[new], np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        low = ids[first]
        c = Contexts(data[first, length:], data[first, :length], sizes[first, 0], sizes[first, 1], key[first], half[first])
        n_windows = length - LEAD + 1
        smallest = np.full((n_windows, len(first)), -1, np.int64)
        held = np.zeros((n_windows, len(first)), bool)
        family = buckets.family_of(int(pdf["bucket"].iloc[0]))
        for o, own, found in smallest_ids(c, low, length, *((0, n_windows - 1) if family is None else families(length)[family])):
            smallest[o, own], held[o, own] = found, True
        # runs of windows with the same smallest id
        start = held.copy()
        start[1:] &= ~held[:-1] | (smallest[1:] != smallest[:-1])
        of, o0 = np.nonzero(start.T)
        stop = held.copy()
        stop[:-1] &= ~held[1:] | (smallest[1:] != smallest[:-1])
        o1 = np.nonzero(stop.T)[1]
        value = smallest[o0, of]
        begin = np.searchsorted(of, np.arange(len(first) + 1))
        rows, at = [], 0
        for p, b, blob in zip(pdf["p"], pdf["bucket"], pdf["ids"], strict=True):
            n = len(blob) // 8
            mine = back[at : at + n]
            count = begin[mine + 1] - begin[mine]
            src = np.repeat(np.arange(at, at + n), count)
            run = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[mine], count)
            use = several[src] | (value[run] < ids[src])
            src, run = src[use], run[use]
            at += n
            if len(src):
                rows.append((p, b, "run", _pack(key[src], "<u8"), _pack(value[run], "<i8"), _pack(np.stack([o0[run], o1[run]], 1), "u1"), _pack(half[src], "<u8")))
        return pd.DataFrame(rows, columns=["p", "bucket", "kind", "a", "b", "c", "d"])

    def apply(docs: pa.Table, notes: pa.Table) -> pa.Table:
        job = Removal(notes.to_pandas(), length, buckets)

        def each() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for batch in batches_of(docs):
                goes = job.mask(batch) if len(job.key) else np.zeros(len(batch.bytes), bool)
                for row, s, n in zip(batch.rows, batch.starts, batch.sizes, strict=True):
                    yield row, batch.bytes[s : s + n], goes[s : s + n]

        return finish(docs.drop_columns([group]), each())

    leads = dealt.groupBy(group).applyInArrow(send_leads, LEADS).groupBy("bucket").applyInPandas(common_leads, NOTE)
    sent = dealt.groupBy(group).cogroup(leads.groupBy("p")).applyInArrow(send_contexts, CONTEXTS)
    runs = sent.groupBy("bucket").applyInPandas(compare, NOTE)
    notes = leads.unionByName(runs)
    return dealt.groupBy(group).cogroup(notes.groupBy("p")).applyInArrow(apply, schema)


def figures(docs: DataFrame, length: int = 50) -> DataFrame:
    """What goes from each document, and the digest of what is kept."""

    def finish(docs: pa.Table, each) -> pa.Table:
        rows = [None] * len(docs)
        for row, data, goes in each:
            spans = int((goes[1:] & ~goes[:-1]).sum()) + int(len(goes) > 0 and goes[0])
            rows[row] = (len(data), int(goes.sum()), spans, hashlib.sha256(data[~goes].tobytes()).hexdigest())
        out = batch_of(rows, pa.schema(list(arrow_schema(RESULT))[1:]))
        return pa.table([docs.column("doc_id"), *out.columns], names=arrow_schema(RESULT).names)

    return removals(documents_of(docs, "doc_id", "text"), finish, RESULT, length)


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """The same rows and columns without the repeated bytes; a character goes if any of its bytes does."""

    def finish(docs: pa.Table, each) -> pa.Table:
        texts = docs.column("text").to_pylist()
        for row, data, goes in each:
            if goes.any():
                starts = (data & 0xC0) != 0x80
                touched = np.bincount(np.cumsum(starts), weights=goes) > 0
                texts[row] = data[~touched[np.cumsum(starts)]].tobytes().decode("utf-8", "surrogatepass")
        i = docs.schema.get_field_index("text")
        return docs.set_column(i, docs.schema.field(i), pa.array(texts, docs.schema.field(i).type))

    return removals(docs, finish, docs.schema, length)
