"""What five document filters remove alone, together, and in every order of application.

Texts are scanned where they lie in Arrow's buffers: a table gives each byte its class, prefix sums over the classes give
the counts of every text at once. Words are told apart by a polynomial hash that prefix sums give as well; the hashes of a
text are sorted, equal neighbours are compared byte by byte, and a text in which two words share a hash is counted anew
from its words. A text becomes a mask of the filters that it fails. Copies of a text are brought together by its SHA-256
digest, aggregated within tasks first; of a source only the counts of the 32 masks are left then, from which all 120 orders
follow.

Edge cases: a null text is empty; a null id is smaller than none and greater than none, so it never fails E; rows of one
id and text are no copies of each other; a document has a label if any of its rows in ``labels`` says so; sources that are
null or empty are one part; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, mix64, staged

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_WHITE, _CAPITAL, _SYMBOL, _FOLLOWS = 1, 2, 4, 8
#: Bytes that are looked at together; a longer text is cut at white space and its parts are added up.
PIECE = 1 << 20
#: Bytes of text of which the word hashes are sorted together (a longer text alone).
SORTED = 1 << 23
BASE = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    of = np.zeros(256, np.uint8)
    of[list(WHITE.encode())] |= _WHITE
    of[65:91] |= _CAPITAL
    of[list(b"#$%&*|")] |= _SYMBOL
    of[0x80:0xC0] |= _FOLLOWS
    return of


CLASS = _classes()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse, modulo 2^64."""
    back = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for base in (BASE, back):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def text_buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text begins and the last ends) of a string array; nulls are empty."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    _, places, data = text.buffers()
    at = np.frombuffer(places, np.int64)[text.offset : text.offset + len(text) + 1]
    at = at if len(at) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end): every text, those longer than ``most`` bytes in parts that end at white space."""
    if (np.diff(at) <= most).all():
        return np.arange(len(at) - 1), at[:-1], at[1:]
    out = []
    for row, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        while hi - lo > most:
            white = np.flatnonzero(CLASS[data[lo : lo + most]] & _WHITE)
            if len(white):
                cut = lo + int(white[-1]) + 1
            else:  # a word longer than a piece stays whole
                cut = lo + most
                while cut < hi and not CLASS[data[cut]] & _WHITE:
                    ahead = np.flatnonzero(CLASS[data[cut : min(cut + most, hi)]] & _WHITE)
                    cut = cut + int(ahead[0]) if len(ahead) else min(cut + most, hi)
            out.append((row, lo, cut))
            lo = cut
        out.append((row, lo, hi))
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True))


def _runs(begin: np.ndarray, end: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbours of at most ``most`` bytes together (or one that is longer)."""
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + most, side="right")))
        yield slice(lo, hi)
        lo = hi


def _scan_run(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts (words, capitals, symbols, code points) of neighbouring pieces, and place, length, hash of their words and the piece of each."""
    zero, n = int(begin[0]), int(end[-1] - begin[0])
    a, b = begin - zero, end - zero
    kind = CLASS[data[zero : zero + n]]

    def counted(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])
        return sums[b] - sums[a]

    white = (kind & _WHITE).astype(bool)
    edge = np.zeros(n + 1, bool)
    edge[a], edge[n] = True, True
    before, behind = np.ones(n, bool), np.ones(n, bool)
    before[1:], behind[:-1] = white[:-1], white[1:]
    starts = np.flatnonzero(~white & (before | edge[:-1]))
    ends = np.flatnonzero(~white & (behind | edge[1:])) + 1
    counts = np.stack([np.searchsorted(starts, b) - np.searchsorted(starts, a), counted(kind & _CAPITAL != 0), counted(kind & _SYMBOL != 0), counted(kind & _FOLLOWS == 0)], 1)
    up, down = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[zero : zero + n].astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts])
    return counts, starts + zero, ends - starts, hashes, np.searchsorted(a, starts, side="right") - 1


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes at ``a`` and at ``b`` are equal, eight bytes at a time."""
    wide = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]).view(np.uint8), (len(data) + 1, 8), (1, 1))
    same, left, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(left):
        x = np.ascontiguousarray(wide[a[left] + k]).view("<u8").ravel() ^ np.ascontiguousarray(wide[b[left] + k]).view("<u8").ravel()
        rest = np.minimum(length[left] - k, 8)
        x &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - rest.astype(np.uint64)))
        same[left[x != 0]] = False
        k += 8
        left = left[(x == 0) & (length[left] > k)]
    return same


def distinct_words(data: np.ndarray, rows: int, row: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of different words of each row: sorted hashes, equal neighbours verified."""
    order = np.lexsort((hashes, row))
    row, start, length, hashes = row[order], start[order], length[order], hashes[order]
    out = np.bincount(row, minlength=rows)
    twin = np.flatnonzero((row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1]))
    equal = length[twin] == length[twin + 1]
    equal[equal] = same_bytes(data, start[twin][equal], start[twin + 1][equal], length[twin][equal])
    out -= np.bincount(row[twin], minlength=rows)
    for r in np.unique(row[twin[~equal]]).tolist():  # two words of one hash
        own = slice(*np.searchsorted(row, [r, r + 1]))
        out[r] = len({data[s : s + n].tobytes() for s, n in zip(start[own].tolist(), length[own].tolist(), strict=True)})
    return out


def scan(text: pa.Array) -> np.ndarray:
    """words, distinct words, capitals, symbols, code points of each text."""
    data, at = text_buffer(text)
    out = np.zeros((len(at) - 1, 5), np.int64)
    for rows in _runs(at[:-1], at[1:], SORTED) if len(at) > 1 else ():
        lo, hi = int(at[rows.start]), int(at[rows.stop])
        part, own = data[lo:hi], at[rows.start : rows.stop + 1] - lo
        row, begin, end = pieces(part, own, PIECE)
        words = []
        for run in _runs(begin, end, PIECE):
            counts, start, length, hashes, piece = _scan_run(part, begin[run], end[run])
            np.add.at(out[rows], (row[run][:, None], np.array([0, 2, 3, 4])), counts)
            words.append((row[run][piece], start, length, hashes))
        out[rows, 1] = distinct_words(part, len(own) - 1, *(np.concatenate(x) for x in zip(*words, strict=True)))
    return out


def failed_mask(figures: np.ndarray) -> np.ndarray:
    """Bits 0 to 3: whether filters A to D fail."""
    words, distinct, capitals, symbols, points = figures.T
    fails = (words < 200, 100 * distinct < 50 * words, 100 * capitals > 2 * points, symbols > 0)
    return sum((f.astype(np.int32) << i for i, f in enumerate(fails)), np.zeros(len(figures), np.int32))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, n_distinct, n_capitals, n_symbols, n_chars, mask (of A to D), digest (of the text), one row a document."""
    names = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            figures, (data, at) = scan(text), text_buffer(text)
            view = memoryview(np.ascontiguousarray(data))
            digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [batch.column("doc_id"), batch.column("source"), *(pa.array(figures[:, i]) for i in range(5)), pa.array(failed_mask(figures), pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", *names, "mask", "digest"])

    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, source {kinds['source']}, " + ", ".join(f"{n} long" for n in names) + ", mask int, digest binary"
    return docs.select("doc_id", "source", "text").mapInArrow(run, schema)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by the set of filters that they fail, E among them.

    Rows of one id, text and source become one before labels are joined; copies of a text are counted within tasks before
    they meet, and only the smallest id of a text is brought back to its counts.
    """
    rows = judged(docs).select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "mask", "digest").groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    flag = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    rows = rows.join(known, "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(0))).withColumn("toxic", F.coalesce("toxic", F.lit(0)))
    alike = staged(
        rows.groupBy("digest", "part", "mask", "quality", "toxic", F.col("doc_id").isNull().alias("unnamed")).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least")),
        "alike",
    )
    # smallest ids of texts that stand in several rows; all others are first themselves
    firsts = alike.where("not unnamed").groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    met = alike.join(firsts, "digest", "left")
    first = F.coalesce(F.col("first"), F.col("least.doc_id"))
    own = F.when(F.col("unnamed"), F.col("n")).when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(F.lit(0))
    parts = F.explode(F.array(F.struct(F.col("mask").alias("mask"), own.alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - own).alias("n")))).alias("c")
    split = met.select("part", "quality", "toxic", parts).select("part", "quality", "toxic", "c.*").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(counted: DataFrame) -> DataFrame:
    """All orders and steps of every part, from its counts by mask (at most 32 rows a part)."""
    masks = F.sequence(F.lit(0), F.lit(31))
    named = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    parts = counted.groupBy("part").agg(named.alias("by"))
    listed = lambda c: F.transform(masks, lambda m: F.coalesce(F.try_element_at("by", m)[c], F.lit(0)).cast("long")).alias(c)
    steps = parts.select("part", listed("n"), listed("good"), listed("toxic"))
    steps = steps.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bits = F.transform(F.split("filter_order", ""), lambda f: F.pow(F.lit(2), F.instr(F.lit(FILTERS), f) - 1).cast("int"))
    steps = steps.withColumn("bits", bits)
    steps = steps.withColumn("own", F.element_at("bits", F.col("step"))).withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda s, b: s + b))
    meets = lambda m, c: m.bitwiseAND(F.col(c)) != 0

    def total(name: str, when, of: str = "n") -> Column:
        """Sum of the counts of all masks (an array holds them from mask 0 on) that ``when`` accepts."""
        return F.aggregate(masks, F.lit(0).cast("long"), lambda s, m: s + F.when(when(m), F.element_at(of, m + 1)).otherwise(F.lit(0))).cast("long").alias(name)

    removed = lambda m: meets(m, "own") & ~meets(m, "before")
    shares = F.aggregate(masks, F.lit(0).cast("long"), lambda s, m: s + F.when(meets(m, "own"), F.element_at("n", m + 1) * F.floor(F.lit(len(ORDERS)) / F.bit_count(m))).otherwise(F.lit(0)))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("kept", lambda m: ~meets(m, "own") & ~meets(m, "before")), total("removed", removed), total("redundant", lambda m: meets(m, "own") & meets(m, "before")),
        total("unique_fails", lambda m: m == F.col("own")), total("good_lost", removed, "good"), total("toxic_lost", removed, "toxic"),
        shares.cast("long").alias("shapley"),  # of the orders, each failing filter of a mask comes first in an equal share
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(cells(docs, labels))
