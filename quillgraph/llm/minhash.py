"""b-bit MinHash near-duplicates: bands give candidates, packed low bits estimate, full sets confirm.

1. Each text gives its set of word shingles, a digest of that set, band keys of its minima, and the low ``bits`` of
   every minimum packed into longs. Texts with equal sets are one class, which its smallest id stands for.
2. In every band bucket, each class is paired with the smallest one. The collision-corrected similarity of the packed
   bits (bit counts of folded exclusive-ors) drops pairs far under the threshold; the others are confirmed on the
   full sets. Confirmed links give components.
3. Buckets that still hold classes of several components are paired off completely, in blocks, with the same filter
   and confirmation; pairs inside a component would add nothing. So all candidates that could join components are tried,
   without the square of a group of copies ever being written.

The number of bands follows from the threshold so that a pair at the threshold is missed with probability ``miss``.

Edge cases: texts without words, null texts and null ids link with nothing (component of a null id: null, kept);
repeated rows of an id are judged by their own texts and returned each; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, documents_of, mix64, staged, utf8
from .components import components

SIGNED = "doc_id long, n_shingles long, set_hash binary, keys array<bigint>, bits array<bigint>"
BLOCK = 1000  #: members of a mixed bucket that one task compares with as many others


@dataclass(frozen=True)
class Setting:
    shingle: int = 5
    percent: int = 80  #: link if 100 * intersection >= percent * union
    rows: int = 5
    bits: int = 4
    miss: float = 1e-6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def floor(self) -> float:
        """Estimates under this are five standard errors below the threshold."""
        t, n, r = self.percent / 100, self.bands * self.rows, 1 / (1 << self.bits)
        seen = r + (1 - r) * t
        return t - 5 * math.sqrt(seen * (1 - seen) / n) / (1 - r)


def word_list(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()  # of bytes: only A-Z change


class Signer:
    """Shingle hashes, minima, band keys and packed bits of texts."""

    def __init__(self, setting: Setting, seed: int = 20):
        self.s = setting
        n = setting.bands * setting.rows
        draw = np.random.default_rng(seed)
        self.a = (draw.integers(0, 1 << 31, n, dtype=np.int64) * 2 + 1).astype(np.uint32)
        self.b = draw.integers(0, 1 << 32, n, dtype=np.int64).astype(np.uint32)
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Distinct 64-bit hashes of the shingles; fewer words than a shingle has are one shingle."""
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 250_000:
            known.clear()
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
        k = min(self.s.shingle, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 256):
            np.minimum(out, (x[i : i + 256, None] * self.a + self.b).min(0), out=out)
        return out

    def sign(self, text: str | None) -> tuple:
        h = self.hashes(word_list(text))
        if not len(h):
            return 0, None, None, None
        m = self.minima(h)
        bands = m.reshape(self.s.bands, self.s.rows).astype(np.uint64)
        key = np.arange(self.s.bands, dtype=np.uint64)
        for i in range(self.s.rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
        per = 64 // self.s.bits
        low = np.zeros(-(-len(m) // per) * per, np.uint64)
        low[: len(m)] = m & np.uint32((1 << self.s.bits) - 1)
        packed = (low.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(self.s.bits))).sum(1, dtype=np.uint64)
        return len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), key.view(np.int64).tolist(), packed.view(np.int64).tolist()


@cache
def signer_of(setting: Setting) -> Signer:
    """One for each worker."""
    return Signer(setting)


def signed(docs: DataFrame, setting: Setting) -> DataFrame:
    return by_text(docs, lambda texts: [signer_of(setting).sign(t) for t in texts], SIGNED)


def _lane(bits: int) -> int:
    """A long with the lowest bit of every lane set, as a signed number."""
    x = sum(1 << i for i in range(0, 64, bits))
    return x - (1 << 64) if x >> 63 else x


def estimate(a: Column, b: Column, setting: Setting) -> Column:
    """Similarity from packed bits: lanes that differ are counted, chance agreement is taken off."""
    n, r = setting.bands * setting.rows, 1 / (1 << setting.bits)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        step = 1
        while step < setting.bits:
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
            step *= 2
        return F.bit_count(d.bitwiseAND(F.lit(_lane(setting.bits)).cast("bigint")))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    return ((1 - off / n) - r) / (1 - r)


def estimates(one: np.ndarray, many: np.ndarray, setting: Setting) -> np.ndarray:
    """The same for one row against many, in numpy (uint64 lanes)."""
    n, r = setting.bands * setting.rows, 1 / (1 << setting.bits)
    d = many ^ one
    step = 1
    while step < setting.bits:
        d = d | (d >> np.uint64(step))
        step *= 2
    off = np.bitwise_count(d & np.uint64(_lane(setting.bits) & ((1 << 64) - 1))).sum(1)
    return ((1 - off / n) - r) / (1 - r)


def linked(a: str | None, b: str | None, setting: Setting) -> bool:
    """Whether the full shingle sets are similar enough, without hashing."""
    codes: dict[bytes, int] = {}
    sets = []
    for text in (a, b):
        ids = [codes.setdefault(w, len(codes)) for w in word_list(text)]
        k = min(setting.shingle, len(ids))
        sets.append(set(zip(*(ids[i : len(ids) - k + 1 + i] for i in range(k)), strict=True)) if k else set())
    both = len(sets[0] & sets[1])
    union = len(sets[0]) + len(sets[1]) - both
    return union > 0 and 100 * both >= setting.percent * union


def confirmed(pairs: DataFrame, texts: DataFrame, setting: Setting) -> DataFrame:
    """Those pairs (u, v) whose texts are linked."""
    sides = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[linked(a, b, setting) for a, b in zip(pdf["text_u"], pdf["text_v"], strict=True)]][["u", "v"]]

    return sides.select("u", "v", "text_u", "text_v").mapInPandas(run, "u long, v long").distinct()


def _first_shared(i: int, at: np.ndarray, keys: np.ndarray, key: int) -> np.ndarray:
    """Those of ``at`` whose first common bucket with row i is ``key``."""
    return at[keys[i][(keys[at] == keys[i]).argmax(1)] == key]


def _partners(i: int, others: np.ndarray, size: np.ndarray, keys: np.ndarray, bits: np.ndarray, key: int, setting: Setting) -> np.ndarray:
    """Those of ``others`` that sizes, estimates and the first common bucket leave as candidates of row i."""
    at = others[100 * np.minimum(size[others], size[i]) >= setting.percent * np.maximum(size[others], size[i])]
    if len(at):
        at = at[estimates(bits[i], bits[at], setting) >= setting.floor]
    return _first_shared(i, at, keys, key) if len(at) else at


def dealt_in_blocks(members: DataFrame) -> DataFrame:
    """A bucket of more than BLOCK members is cut into blocks by hash, and each pair (low, high) of blocks is a group."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "component", "size", "keys", "bits")


def in_question(dealt: DataFrame, setting: Setting) -> DataFrame:
    """The rows of ``dealt`` that have a candidate of another component in their group; signatures alone are read.

    Groups arrive sorted, so a task holds one group (two blocks at most) beside a batch.
    """
    cut = ["key", "low", "high"]

    def asked(group: pa.Table, keys: np.ndarray, bits: np.ndarray, lo: int, hi: int) -> np.ndarray:
        own, comp, size = (group.column(c).to_numpy()[lo:hi] for c in ("own", "component", "size"))
        key, low, high = (group.column(c)[lo].as_py() for c in cut)
        keys, bits = keys[lo:hi], bits[lo:hi]
        found = np.zeros(hi - lo, bool)
        for i in range(hi - lo):
            if low != high and own[i] != low:
                continue
            apart = comp != comp[i]
            if low == high:
                apart[: i + 1] = False
            else:
                apart &= own != low
            at = _partners(i, np.flatnonzero(apart), size, keys, bits, key, setting)
            found[at] = True
            found[i] |= len(at) > 0
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
            """The asked rows of the groups that have ended, and the rows of the open one."""
            ids = [rows.column(c).to_numpy() for c in cut]
            starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in ids], axis=0)]))
            ends = np.append(starts[1:], rows.num_rows)
            if not last:
                starts, ends = starts[:-1], ends[:-1]
            done = int(ends[-1]) if len(ends) else 0
            part = rows.slice(0, done)
            keep = np.zeros(done, bool)
            if done:
                keys, bits = (part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(done, -1) for c in ("keys", "bits"))
                for lo, hi in zip(starts, ends, strict=True):
                    if hi - lo > 1:
                        keep[lo:hi] = asked(part, keys, bits.view(np.uint64), lo, hi)
            return part.filter(pa.array(keep)), rows.slice(done)

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                found, held = groups(rows if held is None else pa.concat_tables([held, rows]).combine_chunks(), False)
                yield from found.combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from groups(held, True)[0].combine_chunks().to_batches()

    return dealt.repartition(*cut).sortWithinPartitions(*cut).mapInArrow(run, dealt.schema)


def mixed_links(members: DataFrame, texts: DataFrame, setting: Setting) -> DataFrame:
    """Links between different components within buckets: members are (key, id, size, keys, bits, component, n).

    All pairs of a bucket that stand in different components are tried: sizes, then estimates, then the full sets. A pair
    is tried in the first bucket that it shares, and not once its components have met, so what comes back is a forest.
    Texts are fetched only for the members that signatures leave in question.
    """
    asked = staged(in_question(dealt_in_blocks(members), setting), "asked")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        signer, key, n = Signer(setting), pdf["key"].iloc[0], len(pdf)
        ids, comp, own, size = (pdf[c].to_numpy() for c in ("id", "component", "own", "size"))
        keys, bits = (np.stack(pdf[c].to_list()).astype(np.int64) for c in ("keys", "bits"))
        bits = bits.view(np.uint64)
        sets = [signer.hashes(word_list(t)) for t in pdf["text"]]
        same = pdf["low"].iloc[0] == pdf["high"].iloc[0]
        comp, u, v = comp.copy(), [], []
        for i in range(n):
            if not same and own[i] != pdf["low"].iloc[0]:
                continue
            at = _partners(i, np.flatnonzero((comp != comp[i]) & (ids > ids[i] if same else own != own[i])), size, keys, bits, key, setting)
            if not len(at):
                continue
            flat = np.concatenate([sets[j] for j in at])
            place = np.searchsorted(sets[i], flat)
            hit = sets[i][np.minimum(place, size[i] - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[at]) - size[at])
            for j in at[100 * both >= setting.percent * (size[i] + size[at] - both)]:
                if comp[i] != comp[j]:
                    u.append(min(ids[i], ids[j]))
                    v.append(max(ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return asked.join(texts, "id").groupBy("key", "low", "high").applyInPandas(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    docs = documents_of(docs, "doc_id", "text")
    signs = staged(signed(docs, setting), "signatures")
    classes = staged(
        signs.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min_by(F.struct("doc_id", "n_shingles", "keys", "bits"), "doc_id").alias("s")).select("set_hash", F.col("s.doc_id").alias("id"), F.col("s.n_shingles").alias("size"), "s.keys", "s.bits"),
        "classes",
    )
    banded = classes.select("id", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    bucketed = staged(banded.join(buckets, "key"), "buckets")
    bits = classes.select("id", "bits")
    stars = bucketed.where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v")).distinct()
    tried = stars.join(bits.select(F.col("id").alias("u"), F.col("bits").alias("a")), "u").join(bits.select(F.col("id").alias("v"), F.col("bits").alias("b")), "v")
    tried = staged(tried.where(estimate(F.col("a"), F.col("b"), setting) >= setting.floor).select("u", "v"), "pairs")
    texts = staged(docs.withColumnRenamed("doc_id", "id").join(bucketed.select("id").distinct(), "id", "left_semi"), "texts")
    links = staged(confirmed(tried, texts, setting), "links")
    found = staged(components(links), "components")

    members = bucketed.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = members.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("key")
    full = members.join(mixed, "key", "left_semi").join(classes.select("id", "size", "keys", "bits"), "id")
    more = staged(confirmed(staged(mixed_links(full, texts, setting), "pairs"), texts, setting), "links")
    if not more.isEmpty():
        found = staged(components(links.unionByName(more)), "components")

    of_class = classes.select("set_hash", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id"))
    out = signs.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash")).join(of_class, "set_hash", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.eqNullSafe(F.col("doc_id"))).alias("kept"))
