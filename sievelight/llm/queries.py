"""The queries of the numbered operators, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import decontaminate

    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]).drop("hit_spans")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import suffix_dedup

    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import ann

    shared_folder(spark)
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import language_id

    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.train(docs), ["doc_id"])
    return out.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import ngram_join

    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import url_filters

    shared_folder(spark)
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), ["doc_id"])


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import html_extract

    return html_extract.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import token_shards

    return token_shards.document_stats(token_shards.write(table(spark, sf_dir, "documents")), spark)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import secret_scan

    return secret_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"]).drop("found")


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import compression_quality

    docs = table(spark, sf_dir, "documents")
    out = compression_quality.score(docs, compression_quality.train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.llm import fim

    out = fim.transform(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_ALL = (
    op1_benchmark_decontamination, op2_suffix_dedup, op3_nearest_neighbours, op4_language_id, op5_ngram_jaccard_join, op6_url_filter, op7_bpe, op8_html_text, op9_token_shards, op10_secret_scan,
    op11_compression_quality, op12_source_divergence, op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in _ALL}

_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
w AS (SELECT row_no, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_no) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
total AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.n, 0)::HUGEINT + v.v) AS p
      FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lp AS (SELECT x.lang, x.term, 1 + (1000000000::HUGEINT * (x.n + 1)) // (y.n + v.v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term) x JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM c GROUP BY lang) y USING (lang) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p.p - lp.q) * (p.p - lp.q)) // lp.q AS value FROM p JOIN lp USING (lang, term) WHERE p.n > 0 AND p.p > lp.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
           UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

#: The rest can't be expressed in SQL and is tested against brute force, exact round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op12_source_divergence": _DIVERGENCE}
