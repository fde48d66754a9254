"""The ten operators over the driver's tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corefold.llm import (
    byte_bpe, centroids, decontamination, language, line_dedup, media, near_duplicates, private, secrets_scan, shards, templates, token_files, whitening,
)
from corefold.llm.common import table

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.load_media(media.store_media(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "height", "width", F.lower(F.hex(F.crc32("rgb"))), F.sha2("rgb", 256)).alias("feature"),
    )


def op2_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    model = language.train(docs.filter(~F.col("held_out")))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digest(private.sanitise(table(spark, sf_dir, "documents"), with_text=False))


def op4_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.components(table(spark, sf_dir, "documents"), words=2)


def op5_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.occurrences(table(spark, sf_dir, "documents")).drop("row")


def op6_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), BPE, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded.select("doc_id", "n_tokens", "ids"), BPE, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_files(table(spark, sf_dir, "documents"), WORDS, end_id=2)
    return token_files.read_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_entropy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digest(secrets_scan.scan(table(spark, sf_dir, "documents")))


def op10_equivalence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = templates.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("centroid_sha256", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)).drop("centroid")


def op12_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that a long cannot hold is null here; the operator's decimal has it."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op13_proportional_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents"))
    return placed.withColumn("law", F.lit(shards.LAW)).withColumn("grown_shard", F.lit(None).cast("int"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_progressive_jpeg, op2_naive_bayes_language, op3_disclosing_terms, op4_min_max_hash, op5_line_edit_join, op6_sentencepiece_bpe, op7_aho_corasick,
        op8_token_files, op9_entropy_windows, op10_equivalence_classes, op11_bit_planes, op12_polarisation_whitening,
        op13_proportional_interleaving, pipeline,
    )
}


def _lloyd(rounds: int = 10) -> str:
    """The rounds of op11 one after another, with plain products and sums."""
    parts = [r"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS MATERIALIZED (
  SELECT k - 1 AS k, x AS c FROM (SELECT x, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) AS k FROM v) WHERE k <= 8)"""]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(d) AS d, arg_min(k, d * 8 + k) AS k
  FROM (SELECT r, vec_id, x, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM v, c{t}) GROUP BY r)""")
        if t < rounds:
            parts.append(f"""m{t} AS (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT k, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{t}, (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i) GROUP BY k
), c{t + 1} AS MATERIALIZED (SELECT k, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (k))""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


#: SQL cannot run the codecs, the tokenizers, the model or the statistics; those are tested
#: against brute force, round trips and held-out rows in tests/llm.
ORACLES: dict[str, str] = {
    "op7_aho_corasick": r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS words FROM (
    SELECT item, w, least(len(w), 13) AS size, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS p FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT size FROM win
), spot AS (
  SELECT r, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS words FROM (
    SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM dw, lens WHERE len(w) >= size)
), found AS (SELECT r, spot.size, p, item FROM spot JOIN win USING (size, words)
), hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + size - 1)) AS q FROM found) GROUP BY r
), its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
""",
    "op11_bit_planes": _lloyd(),
    # crc32 byte by byte from its table, which is made from the polynomial
    "op13_proportional_interleaving": r"""
WITH steps AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(256) AS r(i))
), d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 16 AS size,
    xor(coalesce(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295), 4294967295) AS crc,
    CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents, steps
), f AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, size, crc) - 1) / CAST(2 * count(*) OVER (PARTITION BY source) AS DOUBLE) AS fraction FROM d
), p AS (SELECT *, row_number() OVER (ORDER BY fraction, h, source NULLS FIRST, size, crc) - 1 AS place, count(*) OVER () AS n FROM f)
SELECT doc_id, size, crc AS text_crc32, CAST(place * 40 // n AS INTEGER) AS shard, place - ((place * 40 // n) * n + 39) // 40 AS slot,
  'rows' AS law, CAST(NULL AS INTEGER) AS grown_shard FROM p
""",
}
