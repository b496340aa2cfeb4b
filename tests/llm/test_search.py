"""Vector search, lexical search and the filter audit against brute force and SQL."""

import math
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import filter_audit, lexical_search, queries, vector_search


def by_sql(name, tables):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{tables}/{t}.parquet'")
    r = con.sql(queries.ORACLES[name])
    return sorted(tuple(str(x) for _, x in sorted(zip(r.columns, row, strict=True))) for row in r.fetchall())


def listed(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


# --- vectors -------------------------------------------------------------------------------------------------------


def brute_nearest(rows, asked, k=10):
    """rows: (id, vector or None); a row is never its own neighbour."""
    ok = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, i, v in ok:
        if asked(i):
            found = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for m, j, w in ok if m != n and len(w) == len(v))[:k]
            out += [(i, r, j, round(d, 9)) for r, (d, j) in enumerate(found, 1)]
    return sorted(out)


def found_rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def test_vector_search_equals_sql_at_the_query_size(spark, tables):
    assert listed(queries.op11_vector_search(spark, tables)) == by_sql("op11_vector_search", tables)


def test_vector_search_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(5, rows[5][1]), (100, rows[5][1]), (100, rows[6][1]), (101, None), (102, []), (103, [0.0] * 8), (104, [float("nan")] + [1.0] * 7), (105, [None] + [1.0] * 7), (106, [float("inf")] + [1.0] * 7)]
    rows += [(None, rows[3][1]), (200, [1.0, 2.0]), (201, [1.0, 2.5]), (300, [-0.0, 1.0, 2.0])] + [(400 + i, [7.0] * 8) for i in range(40)] + [(2**60 + i, rows[0][1]) for i in (2, 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("key", F.lit(None).cast("int")).withColumn("shard", F.lit(1)).repartition(5)
    s = vector_search.Setting(per_shard=30, block=4)
    got = found_rows(vector_search.search(vector_search.build(df, s), df.where("vec_id % 5 = 0")))
    assert got == brute_nearest(rows, lambda i: i % 5 == 0)
    assert vector_search.search(vector_search.build(df.limit(0)), df.limit(0)).count() == 0
    assert vector_search.search(vector_search.build(df.limit(0)), df).count() == 0


@pytest.mark.parametrize("dim", (4, 32))
def test_graph_recall_without_the_audit(dim):
    """A plain beam search over the pruned graph, nothing widened."""
    rng = np.random.default_rng(dim)
    v, s = rng.normal(size=(3000, dim)), vector_search.Setting()
    graph = vector_search.Graph(v, s)
    assert (graph.edges >= 0).sum(1).max() <= s.degree and (graph.edges != np.arange(3000)[:, None]).all()
    q = rng.normal(size=(50, dim))
    ids, _ = graph.search(graph.placed(q), 128)
    hit = sum(len(set(np.argsort(((v - x) ** 2).sum(1))[:10]) & set(i.tolist())) for x, i in zip(q, ids, strict=True))
    assert hit >= 0.9 * 500


def test_recall_over_many_shards(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, (centres[i % 40] + rng.normal(size=16)).astype("f4").tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = vector_search.build(df, vector_search.Setting(per_shard=1000))
    assert index.table.count() == 6
    got = {(r[0], r[2]) for r in found_rows(vector_search.search(index, df.where("vec_id % 100 = 0")))}
    want = {(r[0], r[2]) for r in brute_nearest(rows, lambda i: i % 100 == 0)}
    assert len(got & want) >= 0.97 * len(want) and len(got) == len(want)


# --- words ---------------------------------------------------------------------------------------------------------


def brute_ranked(docs, items, k=20):
    terms = [(i, Counter(t.decode() for t in lexical_search.terms_of(x))) for i, x in docs]
    terms = [(i, c) for i, c in terms if c]
    n, total = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked = [t.decode() for t in lexical_search.terms_of(text)]
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(asked)}
        scores = []
        for i, c in terms:
            m = 75 + (25 * c.total() * n) // total
            if (score := sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t])) > 0:
                scores.append((-score, i is None, i, score))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, x) for r, (_, _, i, x) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def ranked_rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_terms():
    assert lexical_search.terms_of("Don't STOP\x00été-№7 \x7f_x") == [b"don", b"t", b"stop", "été".encode(), "№7".encode(), b"x"]
    assert lexical_search.terms_of("ÉÀ İ") == ["ÉÀ".encode(), "İ".encode()] and lexical_search.terms_of(None) == []


def test_lexical_search_equals_sql_at_the_query_size(spark, tables):
    assert listed(queries.op12_lexical_search(spark, tables)) == by_sql("op12_lexical_search", tables)


@pytest.mark.parametrize("s", (lexical_search.Setting(), lexical_search.Setting(shard_terms=300, cluster=4, first_visits=1, growth=2, levels=2, sample=64, broadcast_terms=0)))
def test_lexical_search_is_exact_in_small_shards(spark, docs, odd, s):
    """Many shards, early stops, ties among copies, ids that are null, repeated or large."""
    some = docs.select("doc_id", "text").where("doc_id < 90")
    some = some.unionByName(some.where("doc_id < 5").select((F.col("doc_id") + 2**60).alias("doc_id"), "text")).unionByName(odd.select("doc_id", "text"))
    items = [(1, "the of and that"), (2, None), (3, ""), (4, "... !"), (5, "The THE the quick brown fox 你好"), (5, "lorem dolor dolor"), (None, "two words"), (7, "zzzz unseen"), (8, "every window of fifty bytes")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit("x")).withColumn("shard", F.lit(0))
    got = ranked_rows(lexical_search.search(lexical_search.build(some.withColumn("n", F.lit(1)), s), asked))
    assert got == brute_ranked([tuple(r) for r in some.collect()], items)


def test_lexical_search_of_nothing(spark, odd):
    items = spark.createDataFrame([(1, "quick")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build(odd.limit(0)), items).count() == 0
    assert lexical_search.search(lexical_search.build(odd), items.limit(0)).count() == 0


def test_bisection_brings_like_documents_together():
    """Documents of eight topics, dealt at random, end in clusters of their topic; every document is placed once."""
    rng = np.random.default_rng(0)
    topic = rng.permutation(np.arange(512) % 8)
    terms = [np.unique(np.concatenate([topic[i] * 50 + rng.integers(0, 50, 30), 400 + rng.integers(0, 20, 10)])) for i in range(512)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    order, path = lexical_search.bisected(starts, np.concatenate(terms), 64, 20)
    assert sorted(order.tolist()) == list(range(512)) and len(path) == 3
    pure = [Counter(topic[order[i : i + 64]].tolist()).most_common(1)[0][1] for i in range(0, 512, 64)]
    assert np.mean(pure) > 50


def test_visits_stop_early(spark):
    """An item of a rare topic needs few shards: those left can't reach its 20th score."""
    texts = [(i, " ".join(f"t{i % 40}w{(i * 7 + j) % 9}" for j in range(30))) for i in range(4000)]
    s = lexical_search.Setting(shard_terms=2000, cluster=16)
    index = lexical_search.build(spark.createDataFrame(texts, "doc_id long, text string"), s)
    asked = spark.createDataFrame([(1, "t3w1 t3w2 t3w5")], "item_id long, text string")
    assert index.shards > 8
    assert ranked_rows(lexical_search.search(index, asked)) == brute_ranked(texts, [(1, "t3w1 t3w2 t3w5")])
    shard = lexical_search.Shard(s)
    for r in index.lists.where("shard = 0").toPandas().itertuples():
        shard.take(r)
    query = [(b"t3w1", 1000), (b"t3w2", 1000)]
    ids, scores = shard.best(query, 0, 20)
    again, more = shard.best(query, int(scores[-1]) if len(scores) else 0, 20)
    assert again.tolist() == ids.tolist() and more.tolist() == scores.tolist()


# --- filters -------------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    import re

    masks, first = [], {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]), strict=True) if bad}
        masks.append((s or "", fails, i in good, i in toxic))
    out, total = {}, defaultdict(int)
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [m for m in own if f in m[1] and not m[1] & before]
                kept = sum(not m[1] & (before | {f}) for m in own)
                total[part, f] += len(here)
                out[part, "".join(order), step] = [kept, len(here), sum(f in m[1] and bool(m[1] & before) for m in own), sum(m[1] == {f} for m in own), sum(m[2] for m in here), sum(m[3] for m in here)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in df.collect()}


def test_filter_audit_equals_sql_at_the_query_size(spark, tables):
    assert listed(queries.op13_filter_audit(spark, tables)) == by_sql("op13_filter_audit", tables)


def test_filter_audit_odd_rows(spark, docs, odd):
    some = docs.select("doc_id", "text", "source").where("doc_id < 40").unionByName(odd.select("doc_id", "text", "source"))
    copies = [(500, "LOUD $ copy", "a"), (500, "LOUD $ copy", "a"), (501, "LOUD $ copy", "b"), (None, "LOUD $ copy", None), (502, "LOUD $ copy", ""), (499, "other", "a"), (499, "LOUD $ copy", "a")]
    some = some.unionByName(spark.createDataFrame(copies, "doc_id long, text string, source string"))
    labels = [(500, 1, 0), (500, 0, 1), (501, None, 1), (None, 1, 1), (3, 1, 0), (9, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = audit_rows(filter_audit.audit(some.withColumn("mask", F.lit("x")).withColumn("n", F.lit(0)).repartition(5), frame))
    assert got == brute_audit([tuple(r) for r in some.collect()], labels)
    assert filter_audit.audit(some.limit(0), frame).count() == 0
    assert audit_rows(filter_audit.audit(some, frame.limit(0))) == brute_audit([tuple(r) for r in some.collect()], [])


def test_scan_counts_texts_of_any_length_and_cut(monkeypatch):
    texts = ["", None, "a", " a  b a\n\tB é É 😀 #| $", "x" * 3000 + " y " + "x" * 3000, "word " * 900 + "tail", "\x0b\x0c\x1c z", "aa aaa aa aaaa aaaaaaaaa aaaaaaaaa aaaaaaaab"] * 3
    want = [[len(w := (t or "").encode().split()), len(set(w)), sum(c.isascii() and c.isupper() for c in t or ""), sum(c in "#$%&*|" for c in t or ""), len(t or "")] for t in texts]
    for piece, together in ((1 << 20, 1 << 23), (64, 200), (7, 7)):
        monkeypatch.setattr(filter_audit, "PIECE", piece)
        monkeypatch.setattr(filter_audit, "SORTED", together)
        assert filter_audit.scan(pa.array(texts, pa.string())).tolist() == want
        assert filter_audit.scan(pa.array(["skip me", *texts], pa.large_string())[1:]).tolist() == want
    assert filter_audit.scan(pa.array([], pa.string())).shape == (0, 5)


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "mix64", lambda x: np.zeros_like(x))
    assert filter_audit.scan(pa.array(["a b a c", "same same", "longer words than eight bytes, longer words"]))[:, 1].tolist() == [3, 1, 5]
