"""Queries over whole tables, one for each corpus operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, divergence, html_extract, imatch, licenses, mixing, near_dups, quality, ranked_search, repeated_spans, sharding, token_counts, warc
from tidemark.llm.common import finished, table, text_or_empty


def held_out() -> Column:
    """Rows that labels must not be learned from."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def op1_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return quality.score_documents(docs, model, threshold=0.7).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024, text=text_or_empty())
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: imatch.edited_fingerprints(table(spark, sf_dir, "documents")))


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: near_dups.near_duplicates(table(spark, sf_dir, "documents")))


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: repeated_spans.remove_repeats(table(spark, sf_dir, "documents")).drop("spans"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return finished(lambda: decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_ids"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: mixing.mix(table(spark, sf_dir, "documents")))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ranked() -> DataFrame:
        index = ranked_search.index_documents(table(spark, sf_dir, "documents"))
        return ranked_search.search(index, table(spark, sf_dir, "benchmark"), k=50)

    return finished(ranked)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(licenses.scan(table(spark, sf_dir, "documents")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: divergence.audit(table(spark, sf_dir, "documents"), min_docs=10, top=10))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_scores": op1_quality_scores,
    "op2_token_counts": op2_token_counts,
    "op3_imatch_fingerprints": op3_imatch_fingerprints,
    "op4_histogram_shards": op4_histogram_shards,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_repeated_spans": op6_repeated_spans,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_source_mix": op8_source_mix,
    "op9_html_main_text": op9_html_main_text,
    "op10_warc_round_trip": op10_warc_round_trip,
    "op11_ranked_search": op11_ranked_search,
    "op12_license_scan": op12_license_scan,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE: dict[str, str] = {
    "op10_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        w AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS n, max(page_id) OVER (PARTITION BY h) AS winner FROM p)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND winner > page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND winner > page_id THEN winner END AS refers_to
        FROM w
    """,
    "op11_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        tok AS (SELECT k, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        tf AS (SELECT k, term, count(*) AS tf FROM tok GROUP BY k, term),
        size AS (SELECT k, count(*) AS words FROM tok GROUP BY k),
        total AS (SELECT count(*) AS docs, CAST(sum(words) AS BIGINT) AS words FROM size),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        item AS (SELECT row_number() OVER () AS i, item_id,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
        wanted AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM item),
        weighted AS (SELECT i, item_id, term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
            FROM wanted JOIN df USING (term), total),
        norm AS (SELECT k, 50 + (50 * size.words * docs) // total.words AS m FROM size, total),
        scored AS (SELECT i, item_id, doc_id, k, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
            FROM weighted JOIN tf USING (term) JOIN norm USING (k) JOIN d USING (k) GROUP BY i, item_id, doc_id, k)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 50
    """,
    "op12_license_scan": licenses.brute_sql(),
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        tok AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS c FROM tok GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
        groups AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
        cnt AS (SELECT lang, source, term, count(*) AS c FROM tok SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        n AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY lang, source),
        cell AS (SELECT g.lang, g.source, kept.term, coalesce(cnt.c, 0) AS c,
                1 + (1000000000 * CAST(coalesce(cnt.c, 0) + 2 AS HUGEINT)) // (coalesce(n.n, 0) + 2 * v.v) AS p,
                1 + (1000000000 * CAST(kept.c + 2 AS HUGEINT)) // (v.n + 2 * v.v) AS q
            FROM groups g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang
            LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
            LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = kept.term),
        two AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS s
            FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(two.s, 0) AS val
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
        word AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS val FROM cell WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, CAST(val AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY val DESC, item) AS INTEGER) AS rank
        FROM (SELECT * FROM pair UNION ALL SELECT * FROM word) u
        QUALIFY part = 'pair' OR rank <= 10
    """,
}
