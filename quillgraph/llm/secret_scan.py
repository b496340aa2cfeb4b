"""Secret scans: rules for known shapes, and a character convolutional network over every candidate.

Rules find ``assign``, ``access`` and ``hex`` spans. Candidates are these and every other run of 16 or more token characters
(or what the rules leave of a run); the network reads all of each with the characters around it. It is trained on what it is
to judge: positives are the rules' findings with what the rules go by withheld (the value without its key, a part of it that
is too short or starts too late for the rule, in the middle of other words of the text), negatives are the candidates that
no rule touches. Its scores are calibrated by a logistic fit on those of held-out texts, and the threshold is the highest
that still recalls ``min_recall`` of the held-out positives, so it is a threshold for secrets that the rules miss. Spans of
the rules stay whatever their score; ``n_confirmed`` says how many reach the threshold.

The fit reads whole texts of all rows as the scan does: every example of every distinct text is learnt from or held out, by
shards whose parameters are averaged, and nothing but these parameters and counts of scores comes to the driver.

Edge cases: null and empty texts have no spans; without findings to learn from, the rules stand alone; candidates of the
network never overlap spans of the rules; repeated rows and null ids are carried through; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, by_text, documents_of, slices, staged, with_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"\S{10,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "model")
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, n_confirmed long"
EXAMPLE = "shard long, turn long, key long, x binary, y int"
PACKED = "shard long, held boolean, x binary, y binary, n long, hits long"
SUMS, STEPS = "place long, total long, shards long", "step long, y long, n long"
CHARS, SHARDS = 128, 2  #: bytes of text that give an example, about; shards that a task packs, about
LENT, LEAST = "shard long, lent binary", 512  #: positives that a shard should have
RATE, LAST_RATE = 0.01, 0.0005  #: of learning
UNIT = 1 << 30  #: parameters are summed in whole steps of its inverse
PARTS = 12  #: of a finding's value that are learnt besides the whole
BLOCK = 64  #: candidates whose scores are made at once: what that needs stays in a core's cache
WIDTH, SIDE = 64, 16  #: characters of the candidate, and of each side of it, that the network reads

Span = tuple[int, int, int]  #: start, index in KINDS, end


def rule_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by start and then kind; a match is the whole expression."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs of token characters, or what the rules leave of a run on either side of their spans."""
    found = []
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        for s, _, e in [*((s, k, e) for s, k, e in taken if at < e and s < end), (end, 0, end)]:
            if s - at >= 16:
                found.append((at, s))
            at = max(at, e)
    return found


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character classes of the candidate (first and last half if it is long) between those around it."""
    body = text[start:end]
    if len(body) > WIDTH:
        body = body[: WIDTH // 2] + body[-WIDTH // 2 :]
    parts = text[max(0, start - SIDE) : start].rjust(SIDE), body.ljust(WIDTH), text[end : end + SIDE].ljust(SIDE)
    return np.array([min(ord(c), 127) for c in "".join(parts)], np.uint8)


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """The candidate, and if it is long, every stretch of it by overlapping steps, so that each character is read."""
    steps = [*range(start, end - WIDTH, WIDTH // 2), end - WIDTH] if end - start > WIDTH else []
    return [encode(text, start, end), *(encode(text, a, a + WIDTH) for a in steps)]


def encoded(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """``encode`` of every span, in one step."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    padded = np.full(len(codes) + 2 * SIDE + WIDTH, 32, np.uint8)
    padded[SIDE : SIDE + len(codes)] = np.minimum(codes, 127)
    near, body = np.arange(SIDE), np.arange(WIDTH)
    out = np.zeros((len(spans), WIDTH + 2 * SIDE), np.uint8)
    for i in range(0, len(spans), 4096):  # places of a very long text take more memory than what is read there
        start, end = np.array(spans[i : i + 4096], np.int64).T[:, :, None]
        within = start + body
        within = np.where((end - start > WIDTH) & (body >= WIDTH // 2), end - WIDTH + body, within)
        middle = np.where(within < end, padded[np.minimum(within, len(codes)) + SIDE], 32)
        out[i : i + 4096] = np.concatenate([padded[start + near], middle, padded[end + SIDE + near]], 1)
    return out


class CharNet:
    """Embedding, one convolution, rectifier, maximum over places, logistic output; trained by Adam."""

    def __init__(self, dim: int = 8, filters: int = 24, width: int = 5, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.width = width
        self.p = {
            "e": draw.normal(0, 0.5, (128, dim)), "k": draw.normal(0, 0.3, (width * dim, filters)), "c": np.zeros(filters),
            "o": draw.normal(0, 0.3, filters), "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def shortened(self, x: np.ndarray) -> np.ndarray:
        """Without places that are padding in all rows; what is left of it has every window that it had, so the maximum stays."""
        body = x[:, SIDE : SIDE + WIDTH] != 32
        used = int(body.any(0).nonzero()[0].max(initial=-1)) + 1 + self.width
        return x if used >= WIDTH else np.concatenate([x[:, : SIDE + used], x[:, SIDE + WIDTH :]], 1)

    def _places(self, x: np.ndarray) -> np.ndarray:
        e = self.p["e"][x]  # n, places, dim
        places = e.shape[1]
        u = np.concatenate([e[:, i : places - self.width + 1 + i] for i in range(self.width)], 2)
        return u @ self.p["k"] + self.p["c"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.zeros(len(x))
        for i in range(0, len(x), BLOCK):
            top = self._places(self.shortened(x[i : i + BLOCK])).max(1)
            z[i : i + BLOCK] = np.maximum(top, 0) @ self.p["o"] + self.p["b"][0]
        return z

    def sorted_logits(self, x: np.ndarray) -> np.ndarray:
        """The same for many rows of all lengths: those of like length are read together."""
        order = lengths(x).argsort(kind="stable")
        z = np.zeros(len(x))
        z[order] = self.logits(x[order])
        return z

    def _calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self._calibrated(self.logits(x))

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rates: tuple[float, float], seed: list[int]) -> None:
        """Passes over all rows until at least ``steps`` batches are taken; the rate falls from the first to the last of ``rates``.

        Positives are repeated until they are an eighth of the rows, so that every batch has some; both labels weigh the same.
        """
        draw = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        ones, rest = np.nonzero(y > 0)[0], np.nonzero(y <= 0)[0]
        rows = np.concatenate([rest, np.resize(ones, max(len(ones), len(rest) // 7 if len(ones) else 0))])
        share = min(max((y[rows] > 0).mean(), 1e-9), 1 - 1e-9)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        a_pass = -(-len(rows) // batch)
        passes = -(-steps // a_pass)
        t = 0
        for _ in range(passes):
            order = draw.permutation(rows)
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                t += 1
                rate = np.float32(rates[0] + (rates[1] - rates[0]) * t / (passes * a_pass))
                for k, v in self._gradient(x[at], y[at], weight[at]).items():
                    m1[k] = np.float32(0.9) * m1[k] + np.float32(0.1) * v
                    m2[k] = np.float32(0.999) * m2[k] + np.float32(0.001) * v * v
                    self.p[k] = self.p[k] - rate * (m1[k] / np.float32(1 - 0.9**t)) / (np.sqrt(m2[k] / np.float32(1 - 0.999**t)) + np.float32(1e-8))

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        h = self._places(x)
        top = h.argmax(1)
        m = np.take_along_axis(h, top[:, None], 1)[:, 0]
        z = np.maximum(m, 0) @ self.p["o"] + self.p["b"][0]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(x)
        gm = g[:, None] * self.p["o"] * (m > 0)
        filters, dim = gm.shape[1], self.p["e"].shape[1]
        rows, cols = np.indices(top.shape)
        # what each filter's maxima get, by the character at each of its places
        spot = np.stack([(x[rows, top + j].astype(np.int64) * self.width + j) * filters + cols for j in range(self.width)])
        got = np.bincount(spot.ravel(), np.broadcast_to(gm, spot.shape).ravel(), 128 * self.width * filters)
        got = got.reshape(128, self.width * filters).astype(np.float32)
        k = self.p["k"].reshape(self.width, dim, filters)
        return {
            "o": (g @ np.maximum(m, 0)).astype(np.float32), "b": np.array([g.sum()], np.float32), "c": gm.sum(0).astype(np.float32),
            "k": (self.p["e"].T @ got).reshape(dim, self.width, filters).swapaxes(0, 1).reshape(-1, filters),
            "e": got @ k.swapaxes(1, 2).reshape(-1, dim),
        }

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, min_recall: float) -> None:
        """Logistic fit of the held-out scores, each found ``n`` times (Newton steps), then the recall-constrained threshold."""
        d = np.stack([z, np.ones_like(z)], 1)
        loss = lambda a: n @ (np.logaddexp(0, d @ a) - y * (d @ a)) + 5e-3 * ((a - [1.0, 0.0]) ** 2).sum()
        a = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(d @ a, -40, 40)))
            g = d.T @ (n * (p - y)) + 1e-2 * (a - [1.0, 0.0])
            step = np.linalg.solve((d * (n * p * (1 - p))[:, None]).T @ d + 1e-2 * np.eye(2), g)
            for _ in range(20):  # a whole step may go too far
                if loss(a - step) <= loss(a):
                    a = a - step
                    break
                step = step / 2
        self.scale, self.shift = (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)
        order = np.argsort(z[y > 0])
        least, times = z[y > 0][order], n[y > 0][order]
        missed = times.cumsum() - times  # positives below each score
        self.threshold = float(self._calibrated(least[missed <= (1 - min_recall) * times.sum()].max(keepdims=True))[0]) if len(least) else 1.1


def lengths(x: np.ndarray) -> np.ndarray:
    """Places of the candidates that aren't padding."""
    body = x[:, SIDE : SIDE + WIDTH] != 32
    return np.where(body.any(1), WIDTH - body[:, ::-1].argmax(1), 0)


def examples(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates of one text: the values of its findings, moved away from what the rules see, and the runs that the
    rules leave.

    A value comes whole and in parts, in between two words of the text that stand elsewhere; a part is as long as a candidate
    has to be, or longer, by the value's own hash. Runs come as they stand, and in between other words as well.
    """
    text = text or ""
    taken = rule_spans(text)
    free: list[str] = []
    x, y = [], []

    def moved(value: str, label: int) -> None:
        if not free:
            hinted = any(h in text.lower() for h in HINTS)
            free.extend([w for w in text.split() if len(w) < 16 and not (hinted and any(h in w.lower() for h in HINTS))] or [""])
        turn = zlib.crc32(value.encode("utf-8", "replace"), len(x))
        before, after = free[turn % len(free)], free[turn // 7 % len(free)]
        x.append(encode(f"{before} {value} {after}", len(before) + 1, len(before) + 1 + len(value)))
        y.append(label)

    for s, k, e in taken:
        m = ASSIGN.match(text, s) if k == 0 else None
        value = text[m.start(2) if m else s : e]
        if len(value) >= 16:
            moved(value, 1)
            for part in range(PARTS):
                turn = zlib.crc32(value.encode("utf-8", "replace"), part)
                size = 16 + turn % (len(value) - 15)
                begin = turn // 31 % (len(value) - size + 1)
                moved(value[begin : begin + size], 1)
    for a, b in candidates(text, taken):
        x.append(encode(text, a, b))
        y.append(0)
        moved(text[a:b], 0)
    # shorter runs too: there are few long ones in clean texts
    rest = [
        m.span() for m in RUN.finditer(text) if not CANDIDATE.search(m[0]) and not (taken and any(m.start() < e and s < m.end() for s, _, e in taken))
    ]
    short = encoded(text, rest)
    return np.concatenate([np.stack(x), short]) if x else short, np.array(y + [0] * len(rest), np.int8)


def train(docs: DataFrame, batch: int = 128, steps: int = 400, rounds: int = 2, shard: int = 1 << 16, min_recall: float = 0.98) -> CharNet | None:
    """Fit on every example of every distinct text.

    Examples are dealt to shards of about ``shard`` by a hash. In a round each shard goes through all of its examples in steps
    of ``batch``, several times if that makes fewer than ``steps``, and the mean of the parameters that the shards come to is
    the start of the next. A quarter of the texts is held out: their scores, counted in steps of 1/256, give the calibration
    and the threshold. Copies of a text count once and are on one side. Sums are made of whole numbers, so the network
    doesn't depend on how the table is cut into tasks. No parameter bounds what is read.
    """
    rows = documents_of(docs, "text").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    shards = max(1, -(-int(size or 0) // (CHARS * shard)))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // SHARDS)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of a task: a text of many copies is broken up once in each
        for part in slices(batches):
            out = []
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    x, y = examples(text)
                    out += [((turn := zlib.crc32(e, key & 0xFFFFFFFF)) % shards, turn, key, e, label) for e, label in zip(map(bytes, x), y.tolist(), strict=True)]
                if len(out) >= 5000:
                    yield batch_of(out, arrow_schema(EXAMPLE))
                    out = []
            yield batch_of(out, arrow_schema(EXAMPLE))

    def packed(table: pa.Table) -> pa.Table:
        """The distinct examples of a shard in an order of their own, one row for each side."""
        found = table.group_by(["turn", "key", "x", "y"]).aggregate([]).sort_by([(c, "ascending") for c in ("turn", "key", "x", "y")])
        held = found.column("key").to_numpy() % 4 == 0
        out = []
        for side in (False, True):
            mine = found.filter(pa.array(held == side))
            y = np.array(mine.column("y").to_numpy(), np.int8)
            x = zlib.compress(b"".join(mine.column("x").to_pylist()), 1)
            out.append((table.column("shard")[0].as_py(), side, x, y.tobytes(), len(y), int(y.sum())))
        return pa.Table.from_batches([batch_of([r for r in out if r[4]], arrow_schema(PACKED))])

    made = rows.select(F.xxhash64("text").alias("key"), "text").mapInArrow(labelled, EXAMPLE)
    packs = staged(made.repartition(parts, "shard").groupBy("shard").applyInArrow(packed, PACKED), "examples")
    counts = {r.held: r for r in packs.groupBy("held").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.count("*").alias("shards")).collect()}
    if any(side not in counts or not 0 < counts[side].hits < counts[side].n for side in (False, True)):
        return None
    net = CharNet()
    mine = _lent(packs.where("not held"), shards, counts[False].hits / counts[False].shards)
    for turn in range(rounds):
        rates = tuple(RATE * (1 - t / rounds) + LAST_RATE for t in (turn, turn + 1))
        net.p = _round(mine, net, batch, steps, rates, turn)
    z, y, n = _held_out(packs.where("held"), net)
    net.calibrate(z, y, n, min_recall)
    return net


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            y = np.frombuffer(batch.column("y")[i].as_py(), np.int8)
            yield batch.column("shard")[i].as_py(), np.frombuffer(zlib.decompress(batch.column("x")[i].as_py()), np.uint8).reshape(len(y), -1), y


def _lent(packs: DataFrame, shards: int, hits: float) -> DataFrame:
    """Where findings are so rare that a shard has less than ``LEAST`` positives, each is lent to the next shards as well."""
    if shards == 1 or hits >= LEAST:
        return packs.withColumn("lent", F.lit(None).cast("array<binary>"))
    times = min(shards, int(np.ceil(LEAST / hits)))

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, x, y in _rows(batches):
            for e in map(bytes, x[y > 0]):
                yield batch_of([((shard + i) % shards, e) for i in range(1, times)], arrow_schema(LENT))

    lent = packs.where("hits > 0").select("shard", "x", "y").mapInArrow(lend, LENT)
    return staged(packs.join(lent.groupBy("shard").agg(F.sort_array(F.collect_list("lent")).alias("lent")), "shard", "left"), "lent")


def _round(packs: DataFrame, net: CharNet, batch: int, steps: int, rates: tuple[float, float], turn: int) -> dict[str, np.ndarray]:
    """The mean of the parameters that the shards come to from those of ``net``."""
    start = net.p

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shards = None, 0
        for part, lent in ((b.slice(i, 1), b.column("lent")[i].as_py() or []) for b in batches for i in range(b.num_rows)):
            (shard, x, y), *_ = _rows([part])
            x = np.concatenate([x, np.frombuffer(b"".join(lent), np.uint8).reshape(len(lent), x.shape[1])])
            one = CharNet()
            one.p = dict(start)
            one.train(x, np.append(y, np.ones(len(lent))).astype(np.float32), steps, batch, rates, [turn, shard])
            flat = np.concatenate([one.p[k].ravel() for k in start]).astype(float)
            whole = np.rint(np.clip(flat, -1024, 1024) * UNIT).astype(np.int64)
            total, shards = whole if total is None else total + whole, shards + 1
        yield batch_of([] if total is None else [(i, n, shards) for i, n in enumerate(total.tolist())], arrow_schema(SUMS))

    sums = packs.select("shard", "x", "y", "lent").mapInArrow(learnt, SUMS).groupBy("place").agg(F.sum("total").alias("total"), F.sum("shards").alias("shards")).orderBy("place").collect()
    flat = np.array([r.total / r.shards for r in sums]) / UNIT
    ends = np.cumsum([v.size for v in start.values()])
    return {k: part.reshape(v.shape).astype(np.float32) for (k, v), part in zip(start.items(), np.split(flat, ends[:-1]), strict=True)}


def _held_out(packs: DataFrame, net: CharNet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all held-out examples in steps, rounded down: score, label and how many there are."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y in _rows(batches):
            step = np.floor(np.clip(net.sorted_logits(x), -64, 64) * 256).astype(np.int64)
            (step, label), n = np.unique(np.stack([step, y]), axis=1, return_counts=True)
            yield batch_of(list(zip(step.tolist(), label.tolist(), n.tolist(), strict=True)), arrow_schema(STEPS))

    got = packs.select("shard", "x", "y").mapInArrow(steps, STEPS).groupBy("step", "y").agg(F.sum("n").alias("n")).orderBy("step", "y").collect()
    return np.array([r.step for r in got]) / 256, np.array([r.y for r in got], float), np.array([r.n for r in got], float)


def scored(text: str, places: list[tuple[int, int]], net: CharNet) -> np.ndarray:
    """The calibrated score of each candidate: of a long one, that of its best stretch."""
    read = [windows(text, a, b) for a, b in places]
    scores = net.calibrated(np.stack([x for xs in read for x in xs]))
    return np.maximum.reduceat(scores, np.cumsum([0, *map(len, read)])[:-1])


def scan_text(text: str | None, net: CharNet | None) -> list[Span]:
    """All spans of one text."""
    return judged(text, net)[0]


def judged(text: str | None, net: CharNet | None) -> tuple[list[Span], int]:
    """All spans of one text, and how many of the rules' spans the network finds as well."""
    text = text or ""
    base = rule_spans(text)
    places = [*((s, e) for s, _, e in base), *candidates(text, base)]
    if net is None or not places:
        return base, 0
    found = scored(text, places, net) >= net.threshold
    more = [(a, 3, b) for (a, b), hit in zip(places[len(base) :], found[len(base) :], strict=True) if hit]
    return sorted(base + more), int(found[: len(base)].sum())


def redact(text: str | None, spans: list[Span], mark: str = "[SECRET]") -> str | None:
    """The text with every covered stretch replaced by ``mark``."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, net: CharNet | None) -> DataFrame:
    """Spans of every document; a narrow map. The network is a few thousand numbers."""

    def judge(texts: list[str | None]) -> list[tuple]:
        rows = []
        for t in texts:
            spans, confirmed = judged(t, net)
            n = np.bincount([k for _, k, _ in spans], minlength=4).tolist()
            rows.append((*n[:3], hashlib.sha256(digest([s for s in spans if s[1] < 3]).encode()).hexdigest(), digest(spans), n[3], confirmed))
        return rows

    return by_text(docs, judge, SCHEMA)


def redacted(docs: DataFrame, net: CharNet | None) -> DataFrame:
    """The same rows and columns with secrets blotted out of ``text``."""
    return with_text(docs, lambda texts: [redact(t, scan_text(t, net)) for t in texts])
