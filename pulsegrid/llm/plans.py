"""Registered queries of the training-data operators, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontam, divergence, exact, licenses, near, negatives, packing, quality, resample, sharding, toxicity, urls, warc

SHARDS = [f"shard-{i:03d}" for i in range(64)]
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
             ("com/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("found")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.verdicts(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.similar_components(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_pages(table(spark, sf_dir, "pages"))
    records = warc.read_warc(spark, path, verify=True)
    return records.select(
        warc.page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_id(F.col("refers_to")).alias("refers_to"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge_quality(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f for f in (
        op1_quality_classifier, op2_packing, op3_url_filter, op4_sharding, op5_license_scan, op6_toxicity, op7_decontamination,
        op8_exact_dedup, op9_near_dedup, op10_warc, op11_quality_rules, op12_hard_negatives, op13_resampling)
}

_RULE_ROWS = ", ".join(
    f"('{text}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}', '{verdict}')" for text, verdict in URL_RULES)

ORACLES = {
    "op3_url_filter": f"""
        WITH rules(rule, rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}),
        rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r
                 FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest),
        best AS (SELECT p.page_id, p.host, p.path, max_by(struct_pack(rule := s.rule, verdict := s.verdict), length(s.rule)) AS b
                 FROM parts p JOIN rules s ON (p.host = s.rule_host OR p.host LIKE '%.' || s.rule_host)
                  AND starts_with(p.path, s.rule_path) GROUP BY ALL)
        SELECT p.page_id, p.host, p.path, b.b.rule AS rule, coalesce(b.b.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN best b USING (page_id)""",
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS s FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
               s AS text_sha256 FROM t WINDOW w AS (PARTITION BY s)""",
    "op12_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
                          list_inner_product(a.v, o.v)::BIGINT AS score
                   FROM r a JOIN r o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER
                 AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
         AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score
        QUALIFY rank <= 5""",
    "op13_resampling": """
        WITH RECURSIVE crc(b, c, k) AS (
          SELECT range, range, 0 FROM range(256)
          UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
        steps AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
        words AS (
          SELECT doc_id, 0 AS kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
          UNION ALL SELECT NULL, 1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        tokens AS (SELECT doc_id, kind, unnest(w) AS w FROM words),
        bytes AS (SELECT w, list_transform(range(length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)
                    AS b FROM (SELECT DISTINCT w FROM tokens)),
        buckets AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)
                      % 10000 AS bucket FROM bytes, steps),
        n AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM tokens JOIN buckets USING (w) GROUP BY 1),
        g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n)::DOUBLE + 10000))
                / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n)::DOUBLE + 10000))))::BIGINT AS gain FROM n),
        weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS total FROM tokens JOIN buckets USING (w) JOIN g USING (bucket)
                    WHERE kind = 0 GROUP BY 1),
        scored AS (
          SELECT d.doc_id, coalesce(n_features, 0) AS n_features,
            CASE WHEN n_features > 0 THEN floor(total::DOUBLE / n_features)::BIGINT ELSE 0 END AS weight,
            floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS noise
          FROM documents d LEFT JOIN weights USING (doc_id)),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n
                   FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
        FROM scored LEFT JOIN ranked USING (doc_id)""",
}
