"""The registered queries of the ten operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, jaccard_join, language_id, mixing, quality, tiff, toxicity, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, by: int):
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=9, den=10).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT CAST(-1 AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, '{said}' text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    characters = toxicity.learn_characters(docs)
    lexicon = toxicity.learn_lexicon(docs, labels.where(~held), characters)
    scored = toxicity.toxicity(docs, characters, lexicon)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(tiff.pages(tiff.store_texts(table(spark, sf_dir, "documents"))))


#: The rules of the registered query.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES) + " AS t(host, path, action)")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = language_id.learn(docs.where(~held))
    return language_id.detect(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_jaccard_join, op3_chat, op4_toxicity, op5_decontamination, op6_warc, op7_tiff, op8_url_filter, op9_mixing, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2_SQL, "op6_warc": OP6_SQL, "op8_url_filter": OP8_SQL}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), g AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k FROM s JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) USING (g)
), p AS (SELECT doc_id, g FROM g JOIN n USING (doc_id) WHERE k <= n - CAST(ceil(9 * n / 10.0) AS BIGINT) + 1
), c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id
), o AS (SELECT a, b, count(*) AS o FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g GROUP BY a, b
), l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT DISTINCT a AS id, a AS to_id FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_id
), m AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id
), sig AS (SELECT doc_id, string_agg(g, '|' ORDER BY g) AS sig FROM s GROUP BY doc_id
), cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS class_id FROM sig
), d AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, doc_id) AS component_id, coalesce(cls.class_id, doc_id) AS class_id, coalesce(d.n_links, 0) AS n_links
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = doc_id LEFT JOIN cls USING (doc_id) LEFT JOIN d ON d.id = doc_id
"""

OP6_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

OP8_SQL = rf"""
WITH u AS (
  SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), r(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT page_id, h || p AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, action DESC) AS k
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT u.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND k = 1
"""
