"""One query per training-data operator, over its whole table; and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dedup, filter_audit, language_id, lexical_search, minhash, packing, quality, secret_scan, suffix_dedup, toxicity, vector_search, warc
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Setting(shingle=3, percent=85, rows=6))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.figures(table(spark, sf_dir, "documents"), 50)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs))


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.search(vector_search.build(vectors), vectors.where("vec_id % 100 = 0"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_secret_scan": op10_secret_scan,
    "op11_vector_search": op11_vector_search,
    "op12_lexical_search": op12_lexical_search,
    "op13_filter_audit": op13_filter_audit,
}

_COMPONENTS = """
        reach AS (
            SELECT node, node AS least FROM nodes
            UNION
            SELECT e.v, r.least FROM reach r JOIN edges e ON e.u = r.node WHERE r.least < e.v
        ),
        comp AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
"""

_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NOT_SPACE = _SPACE.replace("[", "[^", 1)

_TERMS_OF = r"coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLES = {
    "op3_quality_rules": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
        win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 3),
        keyed AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c FROM win),
        rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM keyed WHERE c > 1) GROUP BY r),
        l AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
        ll AS (SELECT r, x, len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '')) AS words, len(regexp_extract_all(x, '{_NOT_SPACE}+')) AS n FROM l WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
        v AS (SELECT r, x, words, CASE
            WHEN length(regexp_replace(x, '[^|»›·•<>{{}}]', '', 'g')) > 0.25 * n THEN 'navigation'
            WHEN regexp_matches(lower(x), '{"|".join(quality.BOILERPLATE)}') THEN 'boilerplate'
            WHEN len(regexp_extract_all(x, '[#*$%&~^_=+\\\\]+')) > 0.3 * n THEN 'punctuation'
            WHEN NOT regexp_matches(x, '[.!?…:;。！？"''”’»)\\]]{_SPACE}*$') AND (n <= 4 OR length(regexp_replace(x, '[^.,]', '', 'g')) < 0.02 * n) THEN 'punctuation'
            ELSE 'keep' END AS verdict FROM ll),
        s AS (SELECT r, count(*) - count(DISTINCT x) AS dup, coalesce(sum(words) FILTER (verdict = 'keep'), 0) AS kept_words, count(*) FILTER (verdict = 'keep') AS kept_lines,
            count(*) FILTER (verdict = 'navigation') AS navigation_lines, count(*) FILTER (verdict = 'boilerplate') AS boilerplate_lines, count(*) FILTER (verdict = 'punctuation') AS punctuation_lines FROM v GROUP BY r),
        f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0)::BIGINT AS kept_words, coalesce(kept_lines, 0) AS kept_lines,
            coalesce(navigation_lines, 0) AS navigation_lines, coalesce(boilerplate_lines, 0) AS boilerplate_lines, coalesce(punctuation_lines, 0) AS punctuation_lines
            FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN s USING (r))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - kept_words <= 0.5 * n_words AS kept FROM f
    """,
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, k, substr(h, 1000 * k + 1, 1098) AS p FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 499) // 500)) AS k FROM d)),
        g AS (SELECT doc_id, 500 * k + j AS i, substr(p, 2 * j + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(500, len(p) // 2 - 49))) AS j FROM b)),
        low AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING min(doc_id) <> max(doc_id)),
        hit AS (SELECT g.doc_id, g.i FROM g JOIN low USING (s) WHERE g.doc_id > low.first),
        gap AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS b FROM hit),
        run AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM gap),
        span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, k),
        part AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM span),
        cut AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head FROM part JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
            sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
    """,
    "op2_minhash_near_dedup": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
        ),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
        ),
        sh AS (SELECT doc_id, unnest(s) AS g FROM sets),
        n AS (SELECT doc_id, len(s) AS n FROM sets),
        both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        edges AS (SELECT u, v FROM both_ JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
        nodes AS (SELECT doc_id AS node FROM sets),
        {_COMPONENTS}
        SELECT n.doc_id, n.n AS n_shingles, component_id, component_id = n.doc_id AS kept FROM n JOIN comp ON node = n.doc_id
    """,
    "op7_embedding_near_dedup": f"""
        WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        edges AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        nodes AS (SELECT vec_id AS node FROM e),
        {_COMPONENTS}
        SELECT node AS vec_id, (SELECT count(*) FROM edges WHERE u = node) AS n_links, component_id, component_id = node AS kept FROM comp
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        h AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS payload_digest FROM p),
        m AS (SELECT payload_digest, max(page_id) AS top FROM h WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
        FROM h LEFT JOIN (SELECT payload_digest, top FROM m) USING (payload_digest)
        WHERE payload_bytes >= 1000
        UNION ALL SELECT page_id, payload_bytes, payload_digest, 'response', NULL FROM h WHERE payload_bytes < 1000
    """,
    "op11_vector_search": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
        s AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        d AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b)) AS score FROM s q JOIN s c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
    """,
    "op12_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_TERMS_OF}) AS w FROM documents),
        nl AS (SELECT count(*) AS N, sum(len(w))::BIGINT AS L FROM d WHERE len(w) > 0),
        m AS (SELECT r, doc_id, 100 - 25 + ((25 * len(w) * N) // L) AS m FROM d, nl WHERE len(w) > 0),
        tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2),
        w AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, nl GROUP BY term, N),
        q AS (SELECT i, item_id, term, count(*) AS qtf FROM (SELECT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_TERMS_OF}) AS w FROM benchmark)) GROUP BY 1, 2, 3),
        s AS (SELECT i, item_id, r, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY 1, 2, 3, 4)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
    """,
    "op13_filter_audit": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
        f AS (SELECT r, doc_id, part, (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INTEGER
            + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INTEGER AS mask FROM w),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
        s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o))
        SELECT part, filter_order, step::INTEGER AS step,
            coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
            coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
            coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own > 0), 0)::BIGINT AS shapley
        FROM s, c GROUP BY part, filter_order, step
    """,
}
