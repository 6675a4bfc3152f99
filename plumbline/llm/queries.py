"""The registered queries of this subpackage and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read_table
from .cobucket import bucket_of, co_bucket
from .decontam import contamination
from .html_extract import extract_main_text
from .langid import identify_languages
from .mixing import mix
from .prefix_trie import prefix_trie
from .quality import score_quality
from .secrets import KINDS, find_secrets
from .simhash import near_duplicates
from .token_files import new_folder, read_token_files, write_token_files
from .toxicity import score_toxicity
from .topk import integer_vectors, top_k_of_rows
from .url_filter import filter_urls

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


#: Scores from which on op2 and op6 predict label 1.
DECISION = 0.3


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract_main_text(pages, ["page_id", "url"])
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = score_toxicity(docs, labels, ["doc_id"], learn_from=fold("doc_id", 4) != 2)
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted")
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = find_secrets(docs, ["doc_id"])
    base = [k for k in KINDS if k != "entropy"]
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    digest = lambda c: F.array_join(F.transform(c, line), ",")
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(digest(of(*base)), 256).alias("base_sha256"),
        digest(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda s: s["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter("secrets", lambda s: ~s["live"])).cast("bigint").alias("n_example"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = score_quality(docs, labels, ["doc_id"], learn_from=fold("doc_id", 5) != 0)
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted")
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_languages(docs, ["doc_id"], learn_from=fold("doc_id", 4) != 2)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a candidate, repeated ones and those of null id too; only a query's own row is not."""
    v = integer_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), null_ids=True)
    return top_k_of_rows(v, F.col("id") % 50 == 0)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, folder = read_table(spark, sf_dir, "documents").select("doc_id", "text"), new_folder(spark, "token-files")
    write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_co_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bucket_of(F.col("sale_id"), 300, "line")
    of_item = F.coalesce(F.crc32(F.col("item_id").cast("string")) % 300, F.lit(0))
    return co_bucket(
        read_table(spark, sf_dir, "sales"), read_table(spark, sf_dir, "sale_lines"), "sale_id", new_folder(spark, "co-buckets"), ("sales", "sale_lines"), F.when(b % 3 == 1, b - 1).otherwise(b), of_item
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_toxicity, op3_url_filters, op4_mixing, op5_secret_scans, op6_quality, op7_language_id, op8_simhash, op9_decontamination, op10_topk,
        op11_token_files, op12_co_buckets, op13_prefix_trie,
    )
}

OP3_SQL = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    greatest(0.05::DOUBLE, CASE WHEN length(text) > 0
      THEN pow(length(translate(text, '!#$%&*|<>{}[]\^~@=+_/0123456789', ''))::DOUBLE / length(text), 4.0) ELSE 0.05::DOUBLE END) AS w
  FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || size::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5)
    / 4503599627370496.0::DOUBLE) / w AS es_key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM s
), l AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS level FROM w
), f AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS fill
  FROM l
), g AS (
  SELECT *, first_value(CASE WHEN fill < level THEN fill END IGNORE NULLS)
    OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM f
), t AS (
  SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM g
), p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.es_key, k.doc_id NULLS FIRST, k.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM p
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words, row_number() OVER () AS r
  FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL
), wi AS (
  SELECT DISTINCT item, least(13, len(words)) AS m, array_to_string(words[a:a + least(13, len(words)) - 1], ' ') AS win
  FROM (SELECT item, words, unnest(generate_series(1, len(words) - least(13, len(words)) + 1)) AS a FROM i WHERE len(words) > 0)
), wd AS (
  SELECT r, a, m, array_to_string(words[a:a + m - 1], ' ') AS win
  FROM (SELECT r, words, m, unnest(generate_series(1, len(words) - m + 1)) AS a
        FROM d, (SELECT DISTINCT m FROM wi) WHERE len(words) >= m)
), hits AS (
  SELECT wd.r, wd.a, wd.m, wi.item FROM wd JOIN wi ON wd.m = wi.m AND wd.win = wi.win
), w AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(a, a + m - 1)) AS pos FROM hits) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(w.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256,
  coalesce(w.n_hit, 0) > 0 AND 20 * coalesce(w.n_hit, 0) >= len(d.words) AS contaminated
FROM d LEFT JOIN w ON d.r = w.r LEFT JOIN it ON d.r = it.r
"""

OP10_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE: dict[str, str] = {
    "op3_url_filters": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_topk": OP10_SQL,
}
