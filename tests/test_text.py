"""Expressions on columns."""

import hashlib
import math

from pyspark.sql import functions as F

from quillgraph.functions import text as X


def value(spark, column, **cells):
    names = list(cells)
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{n} string" for n in names)) if cells else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_tokens(spark):
    assert value(spark, X.tokens(F.col("t")), t="Use-the API_v2, über!") == ["use", "the", "api", "v2", "ber"]
    assert value(spark, X.tokens(F.col("t")), t=None) == []


def test_subject_tokens_leave_out_stop_words_and_short_ones(spark):
    assert value(spark, X.subject_tokens(F.col("t")), t="Use the redis queue for the redis db") == ["redis", "queue"]


def test_round3_uses_the_floor_form(spark):
    for x in (0.5115, 0.0004999, 0.1235, 2.0):
        assert value(spark, X.round3(F.lit(x))) == math.floor(x * 1000 + 0.5) / 1000


def test_stable_id_ignores_case_and_outer_space(spark):
    want = "task:" + hashlib.sha1(b"write tests").hexdigest()[:12]
    assert value(spark, X.stable_id("task", F.col("t")), t="\t Write Tests \n") == want


def test_truncated(spark):
    assert value(spark, X.truncated(F.col("t"), 5), t="abcdefgh") == "abcd…"
    assert value(spark, X.truncated(F.col("t"), 5), t=" abcde ") == "abcde"


def test_token_cost(spark):
    assert value(spark, X.token_cost(F.col("t")), t="abcde") == 2
    assert value(spark, X.token_cost(F.col("t")), t=None) == 0


def test_self_resolved_and_committed(spark):
    for t, want in (("crash, fixed", True), ("not fixed yet", False), ("unresolved", False), ("still an issue, patched", False), ("éfixed", True), ("prefixed", False)):
        assert value(spark, X.self_resolved(F.col("t")), t=t) is want, t
    assert value(spark, X.committed(F.col("t")), t="Let's go with plan B")
    assert not value(spark, X.committed(F.col("t")), t="finally done")


def test_redacted(spark):
    for t, want in ((" [REDACTED] [redacted]", True), ("", False), ("x [REDACTED]", False), (None, False)):
        assert value(spark, X.redacted(F.col("t")), t=t) is want


def test_contradicts(spark):
    assert value(spark, X.contradicts(F.col("a"), F.col("b")), a="Use redis for billing queue", b="Avoid redis for billing queue")
    assert not value(spark, X.contradicts(F.col("a"), F.col("b")), a="Use redis for billing", b="Avoid tabs within sources")
    assert not value(spark, X.contradicts(F.col("a"), F.col("b")), a="Redis for billing", b="Redis with billing")


def test_whole_diff_and_prefixes(spark):
    assert value(spark, X.whole_diff(F.col("a"), F.col("b"), F.lit("f")), a="x\ny", b="z") == "--- a/f\n+++ b/f\n-x\n-y\n+z"
    assert value(spark, X.without_checkbox(F.col("t")), t="[ ] do it") == "do it"
    assert value(spark, X.without_checkbox(F.col("t")), t="[ ]") == ""
    assert value(spark, X.without_date(F.col("t")), t="2026-02-01 — keep") == "keep"


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert value(spark, X.cosine(v(1, 0), v(1, 0))) == 1.0
    assert value(spark, X.cosine(v(1, 0), v(-1, 0))) == -1.0
    assert value(spark, X.cosine(v(1, 0), v(1, 0, 0))) == 0.0
    assert value(spark, X.cosine(v(0, 0), v(1, 0))) == 0.0
