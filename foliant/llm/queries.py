"""The registered queries of the corpus operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import scratch


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, folder, "documents"), shingle=3, similarity=(85, 100))


def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.mixing import mix

    return mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.warc import read_warc, write_warc

    return read_warc(write_warc(_table(spark, folder, "pages"), scratch(spark, "warc")), payload=False).drop("url")


#: The tokenizer file of the token queries, of the installed public vocabularies.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.token_files import read_tokens, with_crc32, write_tokens

    files = scratch(spark, "tokens")
    write_tokens(_table(spark, folder, "documents"), files, tokenizer_path(), end_id=2)
    return with_crc32(read_tokens(spark, files))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.cuckoo import exact_duplicates

    return exact_duplicates(_table(spark, folder, "documents"))


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.quality import classify

    return classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"), threshold=0.3)


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.licences import scan

    return scan(_table(spark, folder, "documents"))


#: Host and path rules of the URL query, and hosts with a label that its patterns block.
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
URL_LABELS = ("cheap-pills", "spam-farm")


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.url_filters import filter_urls, host_path, label

    rules = [host_path(*r) for r in URL_RULES] + [label("block", x) for x in URL_LABELS]
    return filter_urls(_table(spark, folder, "pages"), rules)


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.packing import pack

    return pack(_table(spark, folder, "documents"), tokenizer_path(), capacity=4096, end_id=1)

def op10_media_copies(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.images import image_copies
    from foliant.llm.pictures import pictures

    return image_copies(pictures(_table(spark, folder, "embeddings")))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, folder, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0, positives=5, negatives=5, least=(80, 100), scale=256.0)


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.substrings import without_repeats

    found = without_repeats(_table(spark, folder, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from foliant.llm.whitening import whiten

    return whiten(_table(spark, folder, "embeddings"), most=8)


def _licence_sql() -> str:
    from foliant.llm.licences import ENDS, RULES, SENTENCES

    sentences = ", ".join(f"({i}, '{text}')" for i, text in SENTENCES.items())
    rules = ", ".join(f"('{name}', {ids[0]}, '{','.join(map(str, ids))},', {len(ids)})" for name, ids in RULES)
    cuts = " UNION ALL ".join(f"SELECT doc_id, {i} AS cut, string_split_regex(coalesce(text, ''), '{ends}') AS units FROM documents" for i, ends in enumerate(ENDS))
    return f"""
WITH s(sentence, unit) AS (VALUES {sentences}), r(licence, sentence, ids, size) AS (VALUES {rules}), c AS ({cuts}),
u AS (SELECT doc_id, cut, unnest(units) AS raw, generate_subscripts(units, 1) AS place FROM c),
n AS (SELECT doc_id, cut, place, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS unit FROM u),
f AS (SELECT doc_id, cut, place, sentence, string_agg(CAST(sentence AS VARCHAR), ',') OVER (PARTITION BY doc_id, cut ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) || ',' AS coming FROM n JOIN s USING (unit)),
m AS (SELECT doc_id, cut, place, first(licence ORDER BY size DESC, licence) AS licence FROM f JOIN r USING (sentence) WHERE starts_with(coming, ids) GROUP BY ALL),
l AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM m GROUP BY doc_id),
k AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, cut, count(*) AS n FROM f GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, coalesce(licences, '') AS licences, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences FROM documents LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)"""


def _url_sql() -> str:
    rules = ", ".join(f"('{action}', '{host}', '{path}')" for action, host, path in URL_RULES)
    labels = ", ".join(f"'{x}'" for x in URL_LABELS)
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH r(action, rule_host, rule_path) AS (VALUES {rules}),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{shape}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '{shape}', 2), '') AS path FROM pages),
m AS (SELECT page_id, first(action ORDER BY length(rule_host || rule_path) DESC) AS action, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
p AS (SELECT page_id, list_min(list_filter([{labels}], lambda x: list_contains(string_split(host, '.'), x))) AS label FROM u)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN label IS NOT NULL THEN 'block' END, 'allow') AS verdict, 'label ' || label AS pattern
FROM u LEFT JOIN m USING (page_id) LEFT JOIN p USING (page_id)"""


ORACLE_SQL: dict[str, str] = {
    "op7_license_scan": _licence_sql(),
    "op8_url_filter": _url_sql(),
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM e a JOIN e ON a.vec_id % 100 = 0 AND e.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5""",
    "op12_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM d WHERE len(words) >= 20),
w AS (SELECT doc_id, start, row_number() OVER (PARTITION BY list_aggregate(words[start:start + 19], 'string_agg', ' ') ORDER BY doc_id, start) AS nth FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM w WHERE nth > 1),
r AS (SELECT doc_id, list(place) AS gone FROM g GROUP BY doc_id),
f AS (SELECT doc_id, words, list_sort(list_filter(range(1, len(words) + 1), lambda i: NOT coalesce(list_contains(gone, i), false))) AS stay FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(stay) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(stay, lambda i: words[i]), ' '), '')) AS kept_sha256 FROM f""",
    "op3_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> kept_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept_id THEN kept_id END AS refers_to FROM g""",
}
QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_source_mixing, op3_warc_archives, op4_token_files, op5_exact_dedup, op6_quality_classifier,
                                   op7_license_scan, op8_url_filter, op9_best_fit_packing, op10_media_copies, op11_hard_negatives, op12_substring_dedup, op13_embedding_whitening)}
