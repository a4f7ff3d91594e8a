"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from finality.llm import decontaminate, jaccard_join, language, merkle, packing, paragraph_sketch, records, search, secret_links, shared_search, substring_dedup, token_counts, url_reputation
from finality.llm.merkle_sql import DATASET_MANIFEST
from finality.llm.shared import shared_folder, small_batches
from finality.session import ship

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
END_OF_TEXT = 50_256
#: Rules of the URL filter, by host and path.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    counted = token_counts.document_tokens(docs, shared_folder(spark, "tokens"), public_tokenizers.path(BYTE_BPE), END_OF_TEXT)
    return counted.select("doc_id", "start", "n_tokens")


def op2_top_documents(spark: SparkSession, folder: str) -> DataFrame:
    queries = table(spark, folder, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    found = search.top_documents(search.build_index(table(spark, folder, "documents")), queries)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def op3_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "distance", "similarity")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    models = language.train(docs.filter(check % 3 != 1), (check / 3).cast("long") % 8 == 0)
    judged = language.identify(docs, models, kept=("doc_id",))
    held_out = F.coalesce(check % 3 == 1, F.lit(False))
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op5_similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


def op6_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, folder, "documents"), window=35, with_text=False).drop("kept")


def op7_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_reputation.judge_urls(table(spark, folder, "pages"), table(spark, folder, "labels"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round(F.col("bad_rate") + 1e-9, 6).alias("bad_rate"), F.round(F.col("bad_bound") + 1e-9, 6).alias("bad_bound"))


def op8_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_links.find_secrets(table(spark, folder, "documents"))
    count = lambda rank: F.size(F.filter("sure", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_links.written(F.col("sure")), 256).alias("base_sha256"), secret_links.written(F.concat("sure", "linked")).alias("spans"),
    )


def op9_token_records(spark: SparkSession, folder: str) -> DataFrame:
    return records.record_rows(spark, table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0)


def op10_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE), end_id=1, window=2048)


def op11_ranked_items(spark: SparkSession, folder: str) -> DataFrame:
    found = shared_search.best_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_edited_texts(spark: SparkSession, folder: str) -> DataFrame:
    found = paragraph_sketch.compared(table(spark, folder, "documents"))
    printed = {c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")}
    return found.withColumns(printed | {"edited_sha256": F.lower(F.hex("edited_sha256"))})


def op13_dataset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = merkle.verified(table(spark, folder, "documents"), tampered, lower)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_token_counts, op2_top_documents, op3_benchmark_leaks, op4_language_id, op5_similar_documents,
        op6_repeated_passages, op7_url_verdicts, op8_secret_spans, op9_token_records, op10_packed_sequences,
        op11_ranked_items, op12_edited_texts, op13_dataset_manifest, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_top_documents": TOP_DOCUMENTS, "op6_repeated_passages": REPEATED_PASSAGES, "op7_url_verdicts": URL_VERDICTS, "op11_ranked_items": RANKED_ITEMS, "op13_dataset_manifest": DATASET_MANIFEST}


TOP_DOCUMENTS = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS word FROM documents
), asked AS (
    SELECT query_id, word, count(*) AS times FROM (
        SELECT item_id AS query_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS word
        FROM benchmark WHERE item_id % 20 = 0
    ) GROUP BY ALL
), sizes AS (
    SELECT count(*) AS n_docs, (SELECT count(*) FROM words) / count(*) AS mean FROM documents
), lengths AS (
    SELECT doc_id, count(*) AS length FROM words GROUP BY doc_id
), postings AS (
    SELECT doc_id, word, count(*) AS tf FROM words WHERE word IN (SELECT word FROM asked) GROUP BY ALL
), weights AS (
    SELECT word, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, sizes GROUP BY word, n_docs
), scored AS (
    SELECT query_id, doc_id, sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
    FROM asked JOIN postings USING (word) JOIN weights USING (word) JOIN lengths USING (doc_id), sizes GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored
)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
"""

REPEATED_PASSAGES = r"""
WITH words AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS list FROM documents
), windows AS (
    SELECT row, i, hash(array_to_string(list[i : i + 34], ' ')) AS a, md5(array_to_string(list[i : i + 34], ' ')) AS b
    FROM (SELECT row, list, unnest(generate_series(1, len(list) - 34)) AS i FROM words WHERE len(list) >= 35)
), repeated AS (
    SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY a, b) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT DISTINCT row, i + k AS i FROM repeated, generate_series(0, 34) t(k)
), kept AS (
    SELECT w.row, string_agg(w.word, ' ' ORDER BY w.i) AS text, count(*) AS n
    FROM (SELECT row, unnest(list) AS word, generate_subscripts(list, 1) AS i FROM words) w ANTI JOIN covered c ON w.row = c.row AND w.i = c.i
    GROUP BY w.row
)
SELECT doc_id, len(list) AS n_words, len(list) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (row)
"""

RANKED_ITEMS = r"""
WITH found AS (
    SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS row, * FROM documents)
), asked AS (
    SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item, * FROM benchmark)
), wanted AS (
    SELECT item, item_id, term, count(*) AS times FROM asked GROUP BY ALL
), sizes AS (
    SELECT count(DISTINCT row) AS n, count(*) AS l FROM found
), lengths AS (
    SELECT row, 25 + (75 * count(*) * any_value(sizes.n)) // any_value(l) AS m FROM found, sizes GROUP BY row
), postings AS (
    SELECT row, doc_id, term, count(*) AS tf FROM found WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, sizes GROUP BY term
), scored AS (
    SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (row) GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""

URL_VERDICTS = r"""
WITH placed AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), outcomes AS (
    SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NULL AND quality IS NULL THEN NULL ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), hosts AS (
    SELECT host, list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') AS domain, string_split(host, '.')[-1] AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS x
    FROM placed LEFT JOIN outcomes ON page_id = doc_id GROUP BY host
), domains AS (
    SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY ALL
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY ALL
), s1 AS (
    SELECT *, (SELECT (sum(x) + 0.5) / (sum(n) + 1) FROM suffixes) AS m FROM suffixes
), s2 AS (
    SELECT *, (SELECT CASE WHEN r > 1 / 1001.0 THEN greatest(2.0, least(1000.0, 1 / r - 1)) ELSE 1000.0 END FROM (
        SELECT CASE WHEN sum((n - 1) * m * (1 - m)) > 0 THEN (sum((x - n * m) ** 2 / n) - sum(m * (1 - m))) / sum((n - 1) * m * (1 - m)) ELSE 0.0 END AS r FROM s1 WHERE n > 0)) AS s FROM s1
), d1 AS (
    SELECT domains.*, (s * m + s2.x) / (s + s2.n) AS m FROM domains JOIN s2 USING (suffix)
), d2 AS (
    SELECT *, (SELECT CASE WHEN r > 1 / 1001.0 THEN greatest(2.0, least(1000.0, 1 / r - 1)) ELSE 1000.0 END FROM (
        SELECT CASE WHEN sum((n - 1) * m * (1 - m)) > 0 THEN (sum((x - n * m) ** 2 / n) - sum(m * (1 - m))) / sum((n - 1) * m * (1 - m)) ELSE 0.0 END AS r FROM d1 WHERE n > 0)) AS s FROM d1
), h1 AS (
    SELECT hosts.*, (s * m + d2.x) / (s + d2.n) AS m FROM hosts JOIN d2 USING (domain)
), h2 AS (
    SELECT *, (SELECT CASE WHEN r > 1 / 1001.0 THEN greatest(2.0, least(1000.0, 1 / r - 1)) ELSE 1000.0 END FROM (
        SELECT CASE WHEN sum((n - 1) * m * (1 - m)) > 0 THEN (sum((x - n * m) ** 2 / n) - sum(m * (1 - m))) / sum((n - 1) * m * (1 - m)) ELSE 0.0 END AS r FROM h1 WHERE n > 0)) AS s FROM h1
), judged AS (
    SELECT host, a / (a + b) AS bad_rate, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bad_bound
    FROM (SELECT host, s * m + x AS a, s * (1 - m) + n - x AS b FROM h2)
), ruled AS (
    SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM placed
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR bad_bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
    round(bad_rate + 1e-9, 6) AS bad_rate, round(bad_bound + 1e-9, 6) AS bad_bound
FROM ruled JOIN judged USING (host)
"""
