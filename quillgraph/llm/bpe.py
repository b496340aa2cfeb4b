"""Byte-level BPE: distinct words are merged by Spark higher-order functions over a literal rank map.

1. A map task cuts the texts of a chunk into words by the tokenizer's pattern, keeps each distinct word once, and sends the
   words to buckets by hash; documents become codes of stretches, and stretches codes of words.
2. A bucket gathers the distinct words of the whole corpus that fall to it, as arrays of the ids of their bytes.
   ``merge_words`` folds the ranked merges over every word with ``aggregate``: the pair of least rank is joined until none is
   left. Ranks of pairs come from a literal, laid out as a displacement hash, since a literal map would be searched from end
   to end; it is read once for every ``PER_ROW`` words. So each word is merged once, however many chunks hold it.
3. The ids go back to the chunks that asked, where the ids of each document are put together. Decoding concatenates the
   byte pieces of the ids.

What travels is compressed and in proportion to the distinct words of a chunk (there are never more rows than words), and to
the codes of its documents. The fold takes steps in the square of a word's length, so the few words of more than ``LONG``
bytes are merged with a heap in the third step instead.

Edge cases: null and empty texts have no ids (the digest of nothing); lone surrogates count as U+FFFD; ids of special
tokens are never made; a text without any white space is one long word, which is merged in n log n; repeated rows and null
ids are carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, documents_of

PER_ROW = 16384  #: words of a row that is folded
LONG = 64  #: bytes of a word from which the heap is used
BUCKET_BYTES = 8 << 20  #: of text for each bucket of distinct words
GROUP = 2048  #: most buckets that a chunk's words go to; the chunks of a larger corpus are dealt into groups with buckets of their own
DEALT = 20_000  #: most parts into which chunks or buckets are dealt; a part holds several of them then
BUCKETS, SLOTS = 1 << 14, 1 << 17  #: of the displacement hash
RANK_AT, PLACE_AT = 45, 17  #: lowest bits of a pair's rank and of its place in the state; the token is at 0
NO_RANK = (1 << 17) - 1
_white_space = regex.compile(r"[^\S ] ")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CHUNK = "chunk long, bucket int, parts array<binary>, doc_ids array<bigint>"
GATHERED = "bracket string, words array<array<bigint>>, bucket int, chunks array<bigint>, parts array<binary>"
SENT = "chunk long, bucket int, parts array<binary>"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def pieces(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        out[v] = k
    return out


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank of every pair of tokens whose concatenation is a token."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


def rank_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Displacements of the buckets, then the slots, each (left, right, rank) in one long; and the factor of the hash."""
    if max(ranks.values()) >= NO_RANK:
        raise ValueError("the vocabulary doesn't fit the packed state")
    found = merge_pairs(ranks)
    left, right, rank = np.array([(a, b, r) for (a, b), r in found.items()], np.int64).T
    for factor in range(7919, 7919 + 2000, 2):  # no two pairs may share both bucket and slot
        bucket, slot = (left * 31337 + right) & (BUCKETS - 1), (left * factor + right * 5) & (SLOTS - 1)
        if len(np.unique(bucket * SLOTS + slot)) == len(slot):
            break
    else:
        raise ValueError("no factor tells all pairs apart")
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    table, shift, free = np.zeros(SLOTS, np.int64), np.zeros(BUCKETS, np.int64), np.ones(SLOTS, bool)
    entry = (left << 34) | (right << 17) | rank
    draw = np.random.default_rng(1).permutation(SLOTS)
    for g in sorted(groups, key=len, reverse=True):
        for lo in range(0, SLOTS, 512):
            at = (slot[g, None] + draw[lo : lo + 512]) & (SLOTS - 1)
            fits = free[at].all(0)
            if fits.any():
                i = int(fits.argmax())
                shift[bucket[g[0]]], table[at[:, i]], free[at[:, i]] = draw[lo + i], entry[g], False
                break
        else:
            raise ValueError("the rank table has no place for all pairs")
    return np.concatenate([shift, table]), factor


def table_literal(values: np.ndarray, bracket: Column) -> Column:
    """The table as one literal string, read once a row: with a constant ``bracket`` at its end it would be folded to a
    literal array, which every task takes a second to unpack."""
    return F.from_json(F.concat(F.lit("[" + ",".join(map(str, values.tolist()))), bracket), "array<bigint>")


def bind(value: Column, zero: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once; ``zero`` is anything of the result's type."""
    return F.aggregate(F.array(value), zero, lambda _, x: use(x))


def merge_words(words: Column, table: Column, factor: int) -> Column:
    """array<array<bigint>> of byte ids to token ids: ranked merges folded over each word.

    The state has one long per token: the rank of the pair that begins with it, its place, and itself. So ``array_min`` is
    the leftmost pair of least rank.
    """
    long = lambda x: F.lit(x).cast("bigint")
    token = lambda x: x.bitwiseAND(long(NO_RANK))
    none, rest = long(NO_RANK << RANK_AT), F.lit(1 << 28)

    def with_table(t: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            """Of a pair, where it belongs in the state; a key that differs leaves high bits, which ``least`` cuts off, and
            nothing on the right leaves null, which ``least`` passes over."""
            bucket, slot = (left * 31337 + right).bitwiseAND(long(BUCKETS - 1)), left * factor + right * 5
            place = (slot + F.get(t, bucket.cast("int"))).bitwiseAND(long(SLOTS - 1)) + BUCKETS
            key = F.shiftleft(left, 34).bitwiseOR(F.shiftleft(right, 17))
            return F.shiftleft(F.least(F.get(t, place.cast("int")).bitwiseXOR(key), long(NO_RANK)), RANK_AT)

        def first(x: Column, i: Column, word: Column) -> Column:
            return rank(x, F.get(word, i + 1)).bitwiseOR(F.shiftleft(i.cast("bigint"), PLACE_AT)).bitwiseOR(x)

        def step(s: Column, _: Column) -> Column:
            def join(i: Column) -> Column:  # the place of the pair in the state, from 1
                least, before = F.get(s, i - 1), F.get(s, i - 2)
                new = F.shiftright(least, RANK_AT)
                merged = rank(new, token(F.get(s, i + 1))).bitwiseOR(least.bitwiseAND(long((1 << RANK_AT) - (1 << PLACE_AT)))).bitwiseOR(new)
                changed = rank(token(before), new).bitwiseOR(before.bitwiseAND(long((1 << RANK_AT) - 1)))
                longer = F.concat(F.slice(s, F.lit(1), i - 2), F.array(changed, merged), F.slice(s, i + 2, rest))
                return F.when(least >= none, s).when(i > 1, longer).otherwise(F.concat(F.array(merged), F.slice(s, F.lit(3), rest)))

            return bind(F.array_position(s, F.array_min(s)).cast("int"), s, join)

        def fold(word: Column) -> Column:
            start = F.transform(word, lambda x, i: first(x, i, word))
            return F.transform(F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(word), F.lit(2))), start, step), token)

        return F.transform(words, fold)

    return F.get(F.transform(F.array(table), with_table), F.lit(0))


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by ranked merges, leftmost first among equals, in n log n."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at a byte
    heap = []

    def offer(at: int) -> None:
        if at >= 0 and end[at] < n:
            rank = ranks.get(word[at : end[end[at]]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, end[at], end[end[at]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, at, middle, stop = heapq.heappop(heap)
        if end[at] != middle or end[middle] != stop:
            continue
        end[at], end[middle] = stop, -1
        if stop < n:
            before[stop] = at
        offer(before[at])
        offer(at)
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


class Codes(dict):
    """Codes of strings in the order in which they are first met; ``held`` has them, each with the same lead before it."""

    def __init__(self, held: list[str], lead: str = ""):
        super().__init__()
        self.held, self.lead = held, lead

    def __missing__(self, text: str) -> int:
        self[text] = code = len(self.held)
        self.held.append(self.lead + text)
        return code


def squeezed(*parts: np.ndarray | bytes) -> list[bytes]:
    """Compressed; of whole numbers (as int32) first all lowest bytes, then all second ones and so on, which needs less room."""
    press = zstandard.ZstdCompressor(level=3).compress
    return [press(p if isinstance(p, bytes) else p.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()) for p in parts]


def spread(part: bytes) -> np.ndarray:
    """The whole numbers that ``squeezed`` took."""
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def chunks(docs: DataFrame, pattern: str, buckets: int, chunk_chars: int = 6 << 20) -> DataFrame:
    """Of every chunk, a row for each bucket that it has words for, and one row (without a bucket) that says how its
    stretches are made of its words (in the order of the buckets, long ones last) and its documents of stretches.

    Texts are first cut before every space that follows other than white space; the pattern never joins characters over
    such a place, so each distinct stretch is matched once.
    """
    own = min(buckets, GROUP)  # buckets of a group of chunks
    groups = -(-buckets // own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, schema = regex.compile(pattern), pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("parts", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64()))])
        task, chunk = TaskContext.get().partitionId(), TaskContext.get().partitionId() << 32
        held: list[str] = []
        plain, spaced = Codes(held), Codes(held, " ")
        ids, sizes, codes, chars = [], [], [], 0

        def flush() -> pa.RecordBatch:
            plain.clear()
            spaced.clear()
            words, parts, counts = Codes([]), array("i"), array("i")
            all_codes = np.frombuffer(b"".join(codes), "<i4")
            often = np.bincount(all_codes, minlength=len(held))
            by_use = np.argsort(-often, kind="stable")  # frequent stretches get small codes
            for i in by_use.tolist():
                found = cut.findall(held[i])
                counts.append(len(found))
                parts.extend([words[w] for w in found])
            new_code = np.empty(len(held), np.int32)
            new_code[by_use] = np.arange(len(held))
            raw = [w.encode("utf-8", "replace") for w in words.held]
            bucket = np.array([zlib.crc32(w) % own if len(w) <= LONG else own for w in raw], np.int64)
            order = np.argsort(bucket, kind="stable")
            code = np.empty(len(order), np.int32)
            code[order] = np.arange(len(order))
            rows, far = [], squeezed(np.zeros(0, np.int32), b"")
            for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                sent = squeezed(np.array([len(raw[i]) for i in some], np.int32), b"".join([raw[i] for i in some]))
                if bucket[some[0]] < own:
                    group = (task + (chunk & 0xFFFFFFFF)) % groups
                    rows.append({"chunk": chunk, "bucket": group * own + int(bucket[some[0]]), "parts": sent})
                else:
                    far = sent
            made = squeezed(code[np.array(parts, np.int32)], np.array(counts, np.int32), np.array(sizes, np.int32), new_code[all_codes])
            rows.append({"chunk": chunk, "parts": made + far, "doc_ids": ids})
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if cuts_at_every_space(text):
                    first, *more = text.split(" ")
                    code = [plain[first], *map(spaced.__getitem__, more)] if text else []
                else:
                    code = list(map(plain.__getitem__, regex_stretches(text)))
                ids.append(doc_id)
                sizes.append(len(code))
                codes.append(np.array(code, "<i4").tobytes())
                chars += len(text)
                if chars >= chunk_chars:
                    yield flush()
                    held.clear()
                    ids, sizes, codes, chars, chunk = [], [], [], 0, chunk + 1
        if ids:
            yield flush()

    return documents_of(docs, "doc_id", "text").mapInArrow(run, CHUNK)


def gathered(of_byte: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket: rows of its distinct words, then one row that says which chunk asked for which of them."""

    def run(table: pa.Table) -> pa.Table:
        words: dict[bytes, int] = {}
        asked = []
        for parts in table.column("parts").to_pylist():
            ends, data = np.cumsum(spread(parts[0])).tolist(), zstandard.ZstdDecompressor().decompress(parts[1])
            asked.append(np.array([words.setdefault(data[a:b], len(words)) for a, b in zip([0, *ends], ends)], np.int32))  # noqa: B905
        raw, bucket, rows = list(words), table.column("bucket")[0].as_py(), []
        kinds = pa.schema([("bracket", pa.string()), ("words", pa.list_(pa.list_(pa.int64()))), ("bucket", pa.int32()), ("chunks", pa.list_(pa.int64())), ("parts", pa.list_(pa.binary()))])
        for lo in range(0, len(raw), PER_ROW):
            some = raw[lo : lo + PER_ROW]
            inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]), pa.int32()), pa.array(of_byte[np.frombuffer(b"".join(some), np.uint8)]))
            one = [pa.array(["]"]), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), inner), pa.array([bucket], pa.int32())]
            rows.append(pa.RecordBatch.from_arrays([*one, *(pa.nulls(1, f.type) for f in list(kinds)[3:])], schema=kinds))
        rows.append(pa.RecordBatch.from_pylist([{"bucket": bucket, "chunks": table.column("chunk").to_pylist(), "parts": squeezed(*asked)}], kinds))
        return pa.Table.from_batches(rows)

    return run


def sent_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To every chunk that asked a bucket, the sizes and ids of its words in the order in which it sent them."""
    flats, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for batch in batches:
        for i in range(batch.num_rows):
            tokens = batch.column("tokens")[i].values
            if tokens is not None:
                ends = tokens.offsets.to_numpy()
                flats.append(tokens.values.to_numpy()[ends[0] : ends[-1]].astype(np.int32))
                sizes.append(np.diff(ends))
                continue
            flat, size = np.concatenate(flats), np.concatenate(sizes).astype(np.int64)
            flats, sizes, begin = flats[:1], sizes[:1], np.cumsum(size) - size
            bucket, rows = batch.column("bucket")[i].as_py(), []
            for chunk, part in zip(batch.column("chunks")[i].as_py(), batch.column("parts")[i].as_py(), strict=True):
                ids, count = gather(flat, begin, size, spread(part))
                rows.append({"chunk": chunk, "bucket": bucket, "parts": squeezed(count, ids)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("parts", pa.list_(pa.binary()))]))


def cuts_at_every_space(text: str) -> bool:
    return "  " not in text and text[:1] != " " and text[-1:] != " " and not _white_space.search(text)


def regex_stretches(text: str) -> list[str]:
    """The text cut before each space that follows a character other than white space."""
    parts = text.split(" ")
    if cuts_at_every_space(text):
        return [parts[0], *[" " + p for p in parts[1:]]]
    out, held, last = [], [parts[0]], parts[0][-1:]
    for p in parts[1:]:
        if last and not last.isspace():
            out.append("".join(held))
            held = []
        held += [" ", p]
        last = p[-1:] or " "
    out.append("".join(held))
    return out if text else []


def decode(ids: list[int], ranks_path: str | None = None) -> bytes:
    return b"".join(map(pieces(ranks_path or default_ranks()).__getitem__, ids))


def gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat``, end to end, and their sizes."""
    size = sizes[which]
    at = np.cumsum(size) - size
    return flat[np.repeat(begins[which] - at, size) + np.arange(int(size.sum()))], size


def documents_in(made: pa.Table, answers: pa.Table, ranks: dict[bytes, int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the documents of a chunk."""
    order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
    parts = [answers.column("parts")[int(i)].as_py() for i in order]
    stretches, counts, sizes, codes, long_sizes, long_data = made.column("parts")[0].as_py()
    ends, data = np.cumsum(spread(long_sizes)).tolist(), zstandard.ZstdDecompressor().decompress(long_data)
    far = [np.array(heap_merge(data[a:b], ranks), np.int32) for a, b in zip([0, *ends], ends)]  # noqa: B905
    size = np.concatenate([*(spread(p[0]) for p in parts), np.array([len(x) for x in far], np.int32)]).astype(np.int64)
    flat = np.concatenate([*(spread(p[1]) for p in parts), *far, np.zeros(0, np.int32)])
    flat, size = gather(flat, np.cumsum(size) - size, size, spread(stretches))  # in the order of the stretches
    ends, counts = np.concatenate([[0], np.cumsum(size)]), spread(counts).astype(np.int64)
    stop = np.cumsum(counts)
    begin, size = ends[stop - counts], ends[stop] - ends[stop - counts]
    codes, at = spread(codes), 0
    for doc_id, n in zip(made.column("doc_ids")[0].as_py(), spread(sizes).tolist(), strict=True):
        yield doc_id, gather(flat, begin, size, codes[at : at + n])[0]
        at += n


def with_ids(docs: DataFrame, finish: Callable[[Iterator[tuple[int | None, np.ndarray]]], pa.Table], schema: str, ranks_path: str, pattern: str | None = None) -> DataFrame:
    """``finish((doc_id, ids) of the documents of a chunk)``, for every chunk."""
    docs, ranks = documents_of(docs, "doc_id", "text"), load_ranks(ranks_path)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    made = bucketed(chunks(docs, pattern or default_pattern(), buckets), "chunk", min(buckets, DEALT), "chunks")
    table, factor = rank_table(ranks)
    of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
    words = made.where("bucket is not null").select("chunk", "bucket", "parts").repartition(min(buckets, DEALT), "bucket").groupBy("bucket").applyInArrow(gathered(of_byte), GATHERED)
    folded = words.withColumn("tokens", F.when(F.col("words").isNotNull(), merge_words(F.col("words"), table_literal(table, F.col("bracket")), factor)))
    answers = folded.select("tokens", "bucket", "chunks", "parts").mapInArrow(sent_back, SENT)

    def run(made: pa.Table, answers: pa.Table) -> pa.Table:
        return finish(documents_in(made, answers, load_ranks(ranks_path)))

    return made.where("bucket is null").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the token ids of every document."""

    def finish(rows: Iterator[tuple[int | None, np.ndarray]]) -> pa.Table:
        rows = list(rows)
        return pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "ids": pa.array([i for _, i in rows], pa.list_(pa.int32()))})

    return with_ids(docs, finish, "doc_id long, ids array<int>", ranks_path or default_ranks(), pattern)


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digests of the ids and of the bytes that they decode to, per document."""
    path = ranks_path or default_ranks()

    def finish(rows: Iterator[tuple[int | None, np.ndarray]]) -> pa.Table:
        piece = pieces(path)
        name, out = [str(i) for i in range(len(piece))], []
        for doc_id, ids in rows:
            ids = ids.tolist()
            out.append((doc_id, len(ids), hashlib.sha256(",".join([name[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(b"".join([piece[i] for i in ids])).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table({f.split()[0]: pa.array([r[i] for r in out], kind) for i, (f, kind) in enumerate(zip(SCHEMA.split(", "), kinds, strict=True))})

    return with_ids(docs, finish, SCHEMA, path, pattern)
