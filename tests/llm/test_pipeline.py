"""The pipeline's stages on the smallest tables: each takes effect, keeps the columns, and what follows holds on its output."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from quillgraph.llm import secret_scan, suffix_dedup
from quillgraph.llm.common import staged

from .test_operators import TEXT, brute_components, brute_repeats, check_packing


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    now, seen = docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        before, now = now, staged(stage(spark, now, tables), name)
        assert now.columns == docs.columns
        seen[name] = (before, now)
    before, after = seen["minhash"]
    want = {i for i, (_, c) in brute_components(TEXT(before), 5, 80).items() if i == c}
    assert {r.doc_id for r in after.select("doc_id").collect()} == want
    before, after = seen["suffixes"]
    assert after.count() == before.count()
    kept = {i: n - gone for i, n, gone, _, _ in brute_repeats(TEXT(before), pipeline.REPEAT_BYTES)}
    sizes = {r.doc_id: r.n for r in after.select("doc_id", F.octet_length("text").alias("n")).collect()}
    assert all(kept[i] - 2 * 3 * 50 <= sizes[i] <= kept[i] for i in kept)
    _, after = seen["secrets"]
    assert all(not secret_scan.rule_spans((t or "").replace("[SECRET]", "")) for _, t in TEXT(after))
    before, after = seen["toxicity"]
    assert after.count() <= before.count()
    check_packing(pipeline.STAGES[-1][1](spark, now, tables), TEXT(now))


def test_odd_rows_go_through(odd, spark, tables):
    now = odd.select("doc_id", "text", "lang", "source", "n_chars", "p", "key", "kept")
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, tables)
        if name != "packing":
            assert out.columns == now.columns
            now = staged(out, name)
        else:
            assert out.count() > 0
    empty = odd.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0
    assert suffix_dedup.deduplicated(empty).columns == empty.columns
