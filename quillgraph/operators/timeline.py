"""Timeline: merge of sources, order, filters, edit matching, and last-n selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.constants import KINDS, SESSION_GAP_SECONDS


def kind_rank(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in KINDS.items() for v in p]), kind), F.lit(9))


def order_keys(pos: str = "pos") -> list[Column]:
    """ts (null first, as the epoch), kind, user before others, source as readers sort it (accents and case last), then the given position."""
    return [F.coalesce(F.col("ts"), F.lit("1970-01-01").cast("timestamp")), kind_rank(F.col("kind")), (F.coalesce(F.col("role"), F.lit("")) != "user").cast("int"), F.collate(F.coalesce("source", F.lit("")), "UNICODE"), F.col(pos)]


def merged(*sources: DataFrame) -> DataFrame:
    """All sources with default kind, without rows that are redacted."""
    out = sources[0]
    for x in sources[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    out = out.withColumn("kind", F.coalesce(F.nullif("kind", F.lit("")), F.lit("message")))
    return out.where(~(F.col("kind").isin("message", "artifact") & X.redacted(F.col("content"))))


def page(df: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*keys).offset(offset).limit(limit)


def paged(df: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> tuple[int, DataFrame]:
    """The number of all rows, and the page; a negative offset is the beginning."""
    return df.count(), page(df, keys, limit, max(0, offset))


def filtered(df: DataFrame, kind: str = "all", source: str = "all", role: str = "all") -> DataFrame:
    if kind == "code_edit":
        df = df.where(F.col("kind").isin("code_edit", "artifact"))
    elif kind != "all":
        df = df.where(F.col("kind") == kind)
    for name, value in (("source", source), ("role", role)):
        if value != "all":
            df = df.where(F.col(name) == value)
    return df


def last_per_group(df: DataFrame, group: list[str], keys: list[Column], n: int) -> DataFrame:
    """Last n rows of each group (``keys`` in descending order); Spark prunes within tasks before it shuffles."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*group).orderBy(*keys))).where(F.col("rn") <= n)


def balanced_edits(df: DataFrame, per_source: int = 5, total: int = 50) -> DataFrame:
    """Newest edits: the last few of every source first, then the newest of all others up to ``total``. ``pos`` is unique.

    The others are looked for among the newest ``total`` rows only: as many of these as are not in the first part can be
    needed. So both parts are pruned within tasks, and no source is ranked as a whole.
    """
    newest = [F.col("ts").desc(), F.col("pos").desc()]
    first = last_per_group(df, ["source"], newest, per_source).drop("rn").withColumn("balanced", F.lit(0))
    rest = df.orderBy(*newest).limit(total).join(first.select("pos"), "pos", "left_anti").withColumn("balanced", F.lit(1))
    return first.unionByName(rest).orderBy("balanced", *newest).limit(total).drop("balanced")


def gap_sessions(df: DataFrame, by: list[str], seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """session_no within each group: a new one after a gap of more than ``seconds``."""
    w = W.partitionBy(*by).orderBy("ts", "pos")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return df.withColumn("is_new", F.coalesce((gap > seconds * 1_000_000).cast("long"), F.lit(0))).withColumn("session_no", F.sum("is_new").over(w)).drop("is_new")


def segments(df: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """A segment begins at every user message; rows before the first share segment 0 (or 1 if it opens the group)."""
    return df.withColumn("segment", F.sum((F.col("role") == "user").cast("long")).over(W.partitionBy(*by).orderBy(*keys)))


def segment_label(key: str, limit: int = 72) -> Column:
    """Aggregate of a segment (kind, role, content, file, summary): the beginning of its first user message, else the file or
    summary of its first edit, else the beginning of its first content. Runs of white space become one space."""
    first = lambda value, when: F.min_by(value, F.when(when, F.col(key)))
    given = lambda c: F.nullif(c, F.lit(""))
    head = lambda c: F.regexp_replace(F.substring(c, 1, limit), r"\s+", " ")
    edit = F.col("kind").isin("code_edit", "artifact")
    named = first(F.coalesce(given(F.col("file")), given(F.col("summary")), F.lit("Code edit")), edit)
    said = given(first(F.col("content"), (F.col("kind") == "message") & (F.col("role") == "user")))
    return F.coalesce(head(said), named, head(first(F.col("content"), given(F.col("content")).isNotNull())), F.lit("Activity"))


def nearest(left: DataFrame, right: DataFrame, on: str, seconds: int) -> DataFrame:
    """For each left row (id, ts) the right row of the same key with the least time between, at most ``seconds``; ties go to the smaller id.

    The time axis is cut into bins of ``seconds``; a left row meets only its own bin and the two beside it, so a busy key
    is spread over its bins and no key is paired off as a whole.
    """
    bin_of = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: bin_of("ts") + k)))
    b = right.select(F.col(on).alias("r_key"), F.col("id").alias("r_id"), F.col("ts").alias("r_ts"), bin_of("ts").alias("r_bin"))
    delta = F.abs(F.unix_micros(F.col("r_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))
    near = a.join(b, (F.col(on) == F.col("r_key")) & (F.col("bin") == F.col("r_bin"))).withColumn("delta", delta).where(F.col("delta") <= seconds * 1_000_000)
    return near.groupBy("id").agg(F.min(F.struct("delta", "r_id")).alias("best")).select("id", F.col("best.r_id").alias("match_id"), (F.col("best.delta") / 1_000_000).alias("delta_s"))


def enriched(edits: DataFrame, history: DataFrame, seconds: int = 120) -> DataFrame:
    """Edits without a diff take diff and summary from the nearest history edit of the same path."""
    bare = edits.where("diff is null")
    match = nearest(bare.select("id", "path", "ts"), history.select("id", "path", "ts"), "path", seconds).select("id", "match_id")
    extra = history.select(F.col("id").alias("match_id"), F.col("diff").alias("h_diff"), F.col("summary").alias("h_summary"))
    out = edits.join(match, "id", "left").join(extra, "match_id", "left")
    return out.withColumn("diff", F.coalesce("diff", "h_diff")).withColumn("summary", F.coalesce("h_summary", "summary")).drop("h_diff", "h_summary")


def merged_edits(history: DataFrame, session: DataFrame) -> DataFrame:
    """History edits, and session edits of paths without history; one row per path and second, history first."""
    fresh = session.join(history.where("path is not null").select("path").distinct(), "path", "left_anti")
    both = history.withColumn("prio", F.lit(0)).unionByName(fresh.withColumn("prio", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy("path", F.date_trunc("second", F.coalesce("ts", F.lit("1970-01-01").cast("timestamp")))).orderBy("prio", "id")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "prio")


def interpolated(start: Column, end: Column, epoch: Column) -> Column:
    """start + floor(span * epoch / 10), in milliseconds."""
    return F.timestamp_millis(F.unix_millis(start) + F.floor((F.unix_millis(end) - F.unix_millis(start)) * epoch / 10))


def global_sessions(df: DataFrame, seconds: int = SESSION_GAP_SECONDS, bin_seconds: int = 3600) -> DataFrame:
    """``session_no`` over the whole table without putting it into one task; rows without a time have none.

    Gaps are found within bins of ``bin_seconds``; only one row a bin (its ends, its number of breaks) is looked at across
    bins. A bin is one window group, so ``bin_seconds`` bounds what a task holds.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    breaks = lambda gap: F.coalesce((gap > seconds * 1_000_000).cast("long"), F.lit(0))
    binned = df.where("ts is not null").withColumn("_bin", F.floor(micros("ts") / (bin_seconds * 1_000_000)))
    within, across = W.partitionBy("_bin").orderBy("ts", "pos"), W.orderBy("_bin")
    numbered = binned.withColumn("_new", breaks(micros("ts") - F.lag(micros("ts")).over(within))).withColumn("_within", F.sum("_new").over(within))
    ends = binned.groupBy("_bin").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    ends = ends.join(numbered.groupBy("_bin").agg(F.sum("_new").alias("_breaks")), "_bin")
    ends = ends.withColumn("_opens", breaks(micros("_first") - F.lag(micros("_last")).over(across)))
    base = F.sum("_opens").over(across) + F.coalesce(F.sum("_breaks").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = numbered.join(ends.select("_bin", base.alias("_base")), "_bin").withColumn("session_no", F.col("_within") + F.col("_base"))
    return out.drop("_bin", "_new", "_within", "_base").unionByName(df.where("ts is null").withColumn("session_no", F.lit(None).cast("long")))
