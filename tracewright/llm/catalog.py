"""Queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontam, hardnegatives, htmltext, katz, langid, linededup, pieces, qualityrules, secretscan, simhash, tokencount, vectorcodes, warc
from tracewright.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    out = pieces.encode(table(spark, sf_dir, "documents"), model, n=3)
    same = pieces.decoding(F.col("ids"), model) == F.replace("text", F.lit(pieces.MARK), F.lit(" "))
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_pieces"), "score",
                      F.array_join(F.col("nbest.score").cast("array<string>"), ",").alias("nbest_scores"),
                      F.lower(F.hex(F.xxhash64("ids"))).alias("ids_hash"), same.alias("round_trip"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = warc.write_archives(pages)
    rows = warc.read_archives(archives, ["page", "type", "refers_to", "last", "payload_bytes", "payload_digest"]).filter("last")
    number = dict(pages.dtypes)["page_id"]
    return rows.select(F.when(F.col("page") != "null", F.col("page")).cast(number).alias("page_id"), "payload_bytes", "payload_digest",
                       F.col("type").alias("record_type"), F.col("refers_to").cast(number).alias("refers_to"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokencount.load(public_tokenizers.path("word_bpe_49k.json"))
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualityrules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rule")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, number = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    vectors = vectors.withColumn("label", F.when(number % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardnegatives.hard_negatives(vectors, number % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress_with_errors(table(spark, sf_dir, "embeddings"))


def op13_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_sentencepiece, op3_language_id, op4_warc, op5_secret_scan, op6_token_counts, op7_line_dedup, op8_quality_rules, op9_decontamination,
    op10_html_text, op11_hard_negatives, op12_vector_codes, op13_katz_score,
)}

#: Outer white space of a line: what ``bytes.strip`` takes off.
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Base32 of a hexadecimal digest, five digits at a time.
_BASE32 = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)
                         FOR i IN range(32)], '')"""

#: Rows whose vectors are there and finite.
_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0"


def _codes_sql(rounds: int = 6) -> str:
    """Plain rounds, each one a pair of tables: nearest entries and new entries."""
    nearest = """n{k} AS MATERIALIZED (
  SELECT parts.vec_id, parts.p, any_value(parts.x) AS x, min({{'d': {apart}, 'e': e}}) AS best
  FROM parts JOIN c{k} AS book USING (p) GROUP BY parts.vec_id, parts.p),"""
    apart = "CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(parts.x, book.c)]) AS BIGINT)"
    entries = """s{k} AS (SELECT p, best.e AS e, unnest(x) AS v, unnest(range(len(x))) AS pos FROM n{k}),
m{k} AS (SELECT p, e, list(total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END ORDER BY pos) AS c
         FROM (SELECT p, e, pos, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM s{k} GROUP BY ALL) GROUP BY p, e),
c{next} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e)),"""
    steps = "\n".join(nearest.format(k=k, apart=apart) + ("\n" + entries.format(k=k, next=k + 1) if k < rounds else "") for k in range(rounds + 1))
    return f"""
WITH kept AS (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE {_FINITE}),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM (SELECT vec_id, v, unnest(range(8)) AS p FROM kept)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),
{steps}
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM c{rounds}),
coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM n{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


ORACLES: dict[str, str] = {
    "op4_warc": f"""
WITH digests AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS owner FROM digests)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM firsts
""",
    "op11_hard_negatives": f"""
WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
              FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.v, b.v)]) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
         QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM near JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10
""",
    "op12_vector_codes": _codes_sql(),
    "op7_line_dedup": f"""
WITH parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(range(len(parts))) AS pos, trim(unnest(parts), {_BLANK}) AS line FROM parts),
filled AS (SELECT * FROM lines WHERE line <> ''),
windows AS (
  SELECT doc_id, pos, lead(pos, 2) OVER w AS upto, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS passage
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) AS nth FROM windows WHERE upto IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, upto + 1)) AS pos FROM ranked WHERE nth > 1),
dropped AS (SELECT doc_id, list(pos) AS ats, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CASE WHEN n IS NULL THEN text
            ELSE array_to_string([parts[i + 1] FOR i IN range(len(parts)) IF NOT list_contains(ats, i)], chr(10)) END AS text
FROM parts LEFT JOIN dropped USING (doc_id)
""",
}
