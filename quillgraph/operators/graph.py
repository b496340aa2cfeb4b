"""Traversal of bounded depth, supersession chains, reference look-up, co-edit edges, contradictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import constants as C
from .staging import staged


def current(edges: DataFrame, now: Column, history: bool = False) -> DataFrame:
    return edges if history else edges.where(F.col("valid_to").isNull() | (F.col("valid_to") > now))


def both_ways(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("from").alias("a"), F.col("to").alias("b"), "relation", "weight")
    return a.unionByName(edges.select(F.col("to").alias("a"), F.col("from").alias("b"), "relation", "weight"))


def traverse(seeds: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], hops: int = C.HOPS, decay: float = C.HOP_DECAY) -> DataFrame:
    """(id, value, path, relation, depth): the best value that reaches each id from the seeds (id, value).

    ``edges`` is a table, or a function that gives the edges at the ids (id) of a frontier, for edges that needn't all be made.

    At depth d a neighbour gets value * weight * decay^(d+1); a value replaces another only if it is larger. Ids without a
    node are walked through. The seeds are a top-k, so the frontier side of every join is small; the hops are unrolled.
    """
    at = edges if callable(edges) else lambda _: edges
    turned = lambda e: both_ways(e).withColumnRenamed("relation", "by")
    adjacency = staged(turned(edges), "adjacency") if hops > 1 and not callable(edges) else None
    best = seeds.select("id", "value", F.array("id").alias("path"), F.lit(None).cast("string").alias("relation"), F.lit(0).alias("depth"))
    frontier = best
    for depth in range(hops):
        near = adjacency if adjacency is not None else turned(at(frontier.select("id")))
        step = frontier.join(near, F.col("id") == F.col("a")).select(
            F.col("b").alias("id"), (F.col("value") * F.col("weight") * (decay ** (depth + 1))).alias("value"), F.concat("path", F.array("b")).alias("path"), F.col("by").alias("relation"), F.lit(depth + 1).alias("depth")
        )
        found = step.groupBy("id").agg(F.max_by(F.struct("value", "path", "relation", "depth"), F.struct("value", -F.size("path"), F.hash("path"))).alias("s")).select("id", "s.*")
        frontier = found.alias("f").join(best.alias("b"), "id", "left").where(F.col("b.value").isNull() | (F.col("f.value") > F.col("b.value"))).select("id", "f.value", "f.path", "f.relation", "f.depth")
        frontier = staged(frontier, "frontier")
        best = best.join(frontier.select("id"), "id", "left_anti").unionByName(frontier)
    return best


def chains(edges: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(head, chain): ids from the newest to the oldest along SUPERSEDES and CONTRADICTS edges; the last edge of an end wins.

    With ``present`` (id) only these ids count: one is a head if what replaced it is absent, and a walk stops at an absent
    one. Pointers alone are doubled: table k says where 2^k steps lead from each id, until none leads anywhere. Then the heads
    gather their chains once, from the longest steps down: each id found so far finds the one that many steps behind it. A
    walk that comes into a circle ends at the first id of the circle; circles have no head and give nothing.
    """
    own = edges.where(F.col("relation").isin("SUPERSEDES", "CONTRADICTS"))
    down = own.groupBy(F.col("from").alias("id")).agg(F.max_by("to", "pos").alias("next"))
    up = own.groupBy(F.col("to").alias("id")).agg(F.max_by("from", "pos").alias("by"))
    if present is not None:
        here = present.select("id").distinct()
        down = down.join(here, "id", "left_semi").join(here.withColumnRenamed("id", "next"), "next", "left_semi")
        up = up.join(here.withColumnRenamed("id", "by"), "by", "left_semi")
    down = staged(down.select("id", "next"), "steps")
    steps = _doubled(down)
    if steps is None:  # what every step leads to in the end are the circles
        circle = _doubled(down, whole=True)
        steps = _doubled(staged(down.join(circle, "id", "left_anti"), "steps"))
    found = down.join(up, "id", "left_anti").select(F.col("id").alias("head"), "id", F.lit(0).cast("long").alias("at"))
    for k in reversed(range(len(steps))):
        further = found.join(steps[k], "id").select("head", F.col("next").alias("id"), (F.col("at") + (1 << k)).alias("at"))
        found = staged(found.unionByName(further), "chains")
    return found.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("chain")).where(F.size("chain") > 1)


def _doubled(down: DataFrame, whole: bool = False):
    """Tables of 1, 2, 4... steps, the last of which isn't empty; None if there are circles, or, with ``whole``, their ids."""
    n, out = down.count(), []
    now = down
    while not now.isEmpty():
        if (1 << len(out)) > n:
            return now.select(F.col("next").alias("id")).distinct() if whole else None
        out.append(now)
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("after"))
        now = staged(now.join(ahead, "next").select("id", F.col("after").alias("next")), "steps")
    return out


def resolve(nodes: DataFrame, reference: str, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, text, matched): the exact id, else texts that hold the reference or are held by it; several rows mean it is ambiguous."""
    ref, t = F.lit(reference.strip().lower()), F.lower(F.col(text))
    kind = F.when(F.col(id_) == reference, F.lit("id")).when((t != "") & (t.contains(ref) | ref.contains(t)), F.lit("text"))
    found = nodes.withColumn("matched", kind).where("matched is not null")
    exact = nodes.where(F.col(id_) == reference).isEmpty()
    return found if exact else found.where("matched = 'id'")


#: Touches for a task of ``co_edits``, and buckets of the files of a session.
ROWS_A_TASK, FILE_BUCKETS = 500_000, 64


def co_edits(touches: DataFrame, session: str, file: str, pos: str, cap: int = C.CO_EDIT_FILES, rows: int | None = None) -> DataFrame:
    """(from, to, weight): unordered pairs of the first ``cap`` distinct files of each session; at most cap*(cap-1)/2 a session.

    With ``rows``, how many touches there are at most, the work is dealt into as many parts as keep a task's share of them
    bounded. Touches and pairs are dealt before they are made distinct, so no task holds more keys than its part has; of a
    session each of ``FILE_BUCKETS`` buckets sends only its first ``cap`` files on, so that a huge one is no task's either.
    """
    dealt = lambda df, *keys: df
    if rows is not None:
        parts = max(int(touches.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))
        dealt = lambda df, *keys: df.repartition(parts, *keys)
    firsts = touches.select(session, file, pos)
    if rows is None:
        firsts = firsts.groupBy(session, file).agg(F.min(pos).alias("first"))
    else:
        firsts = dealt(firsts.withColumn("bucket", F.pmod(F.hash(file), F.lit(FILE_BUCKETS))), session, "bucket").groupBy(session, "bucket", file).agg(F.min(pos).alias("first"))
        firsts = firsts.withColumn("rn", F.row_number().over(W.partitionBy(session, "bucket").orderBy("first", file))).where(F.col("rn") <= cap).drop("rn", "bucket")
    few = dealt(firsts, session).withColumn("rn", F.row_number().over(W.partitionBy(session).orderBy("first", file))).where(F.col("rn") <= cap)
    files = few.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", file))), lambda x: x[file]).alias("files"))
    pairs = F.flatten(F.transform("files", lambda a, i: F.transform(F.slice("files", i + 2, F.size("files")), lambda b: F.struct(F.least(a, b).alias("from"), F.greatest(a, b).alias("to")))))
    return dealt(files.select(F.explode(pairs).alias("p")).select("p.*"), "from", "to").distinct().withColumn("weight", F.lit(C.CO_EDIT_WEIGHT))


#: Longs of a subject's signature; a token sets one of their bits.
SIGNATURE = 4


def contradictions(decisions: DataFrame, pairs=C.ANTONYMS, id_: str = "id", text: str = "text", branch: str = "branch") -> DataFrame:
    """(old_id, new_id): contradicting decisions (id, text, branch, pos); unknown branches are compared with all.

    Candidates share a subject token that is not in most subjects, and stand on different sides of the same antonym
    pair. Of two subjects that overlap enough, the smaller one has a shared token among its rarest few: a subject of s
    tokens needs at least ``OVERLAP_FLOOR * s`` shared ones, so all but that many (less one) hold one of them, and in the
    order of frequency it is the rarest shared token. Only these are looked up, so common tokens rarely pair anything off.

    Candidates are judged where they meet and are never written: each row carries its subject as numbers, and a signature
    of it. Tokens in common set bits in common, so the bits that two signatures share, and as many as the smaller subject
    has tokens more than bits, bound what is shared; few pairs are left whose subjects have to be compared.
    """
    n = decisions.count()
    low = F.lower(text)
    sides = F.array_compact(F.array(*[F.when(low.contains(w), F.struct(F.lit(i).alias("pair"), F.lit(s).alias("side"))) for i, p in enumerate(pairs) for s, w in enumerate(p)]))
    rows = decisions.select(F.monotonically_increasing_id().alias("row"), F.col(id_).alias("id"), F.col(branch).alias("branch"), "pos", X.subject_tokens(F.col(text)).alias("subject"), sides.alias("sides"))
    rows = staged(rows, "decisions")
    words = rows.select(F.explode("subject").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    words = staged(words.withColumn("code", F.monotonically_increasing_id()), "words")
    # tokens in most subjects come last in this order and are not looked up
    common = F.lit(n >= C.DIRECTORY_MIN_FILES) & (F.col("df") > C.COMMON_SHARE * n)
    opposing = rows.where(F.size("sides") > 0)
    bit = F.pmod(F.xxhash64("code"), F.lit(64 * SIGNATURE)).cast("int")
    set_in = lambda k: F.when(F.floor(bit / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64)).otherwise(F.lit(0).cast("long"))
    coded = opposing.select("row", F.explode("subject").alias("token")).join(words, "token")
    coded = coded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(common.alias("common"), "df", "code"))).alias("tokens"), *[F.bit_or(set_in(k)).alias(f"b{k}") for k in range(SIGNATURE)])
    size = F.size("tokens")
    need = F.ceil(size * C.OVERLAP_FLOOR - 1e-9).cast("int")
    spare = size - sum(F.bit_count(f"b{k}") for k in range(SIGNATURE))
    listed = coded.join(opposing.drop("subject"), "row").withColumns({"codes": F.col("tokens.code"), "size": size, "need": need, "spare": spare})
    held = ["id", "branch", "pos", "codes", "size", "need", "spare", *(f"b{k}" for k in range(SIGNATURE))]
    keyed = listed.select(*held, "sides", F.posexplode("tokens").alias("at", "t")).where("not t.common")
    keyed = keyed.select(*held, "at", F.col("t.code").alias("token"), F.explode("sides").alias("s")).select(*held, "at", "token", "s.pair", "s.side")
    keyed = staged(keyed, "subjects")

    def met(side: int) -> DataFrame:
        """Pairs whose smaller subject is on this side (of two of a size, that on side 0), where their rarest shared token is."""
        small = keyed.where((F.col("side") == side) & (F.col("at") <= F.col("size") - F.col("need")))
        large = keyed.where(F.col("side") == 1 - side).select("token", "pair", *[F.col(c).alias(f"{c}_b") for c in [*held, "at"]])
        smaller = (F.col("size") < F.col("size_b")) | (F.lit(side == 0) & (F.col("size") == F.col("size_b")))
        common_bits = sum(F.bit_count(F.col(f"b{k}").bitwiseAND(F.col(f"b{k}_b"))) for k in range(SIGNATURE))
        near = smaller & (F.col("size_b") - F.col("at_b") >= F.col("need")) & (common_bits + F.col("spare") >= F.col("need"))
        beside = F.col("branch").isNull() | F.col("branch_b").isNull() | (F.col("branch") == F.col("branch_b"))
        enough = F.size(F.array_intersect("codes", "codes_b")) >= F.col("need")
        return small.join(large, ["token", "pair"]).where(near & (F.col("id") != F.col("id_b")) & beside & enough).select("id", "pos", "id_b", "pos_b")

    older = F.col("pos") < F.col("pos_b")
    full = met(0).unionByName(met(1))
    return full.select(F.when(older, F.col("id")).otherwise(F.col("id_b")).alias("old_id"), F.when(older, F.col("id_b")).otherwise(F.col("id")).alias("new_id")).distinct()
