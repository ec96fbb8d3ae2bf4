"""The operators of this subpackage bound to the benchmark tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, exact, lines, mixing, packing, pii, secrets, simhash, substrings, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("copies", "source")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secrets.scan_secrets(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_documents(spark, sf_dir))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the fixed patterns alone, which SQL can express."""
    return op9_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the fixed patterns alone, which SQL can express."""
    return op10_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, (2 * p + 1)::BIGINT, 800)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS k FROM w) WHERE k > 1),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, g, min(p) AS a, max(p) + 400 AS z FROM i GROUP BY doc_id, g),
k AS (SELECT s.doc_id, s.a, s.z, coalesce(lag(s.z) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) AS b FROM s),
c AS (SELECT k.doc_id, sum(z - a) AS removed, count(*) AS spans, string_agg(substr(x, (2 * b + 1)::BIGINT, (2 * (a - b))::BIGINT), '' ORDER BY a) || substr(any_value(x), (2 * max(z) + 1)::BIGINT) AS kept
  FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""

BASE_SECRETS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM d
"""

BASE_PERSONAL_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 0) > 255)) = 0)) AS n_ip,
  [reverse(regexp_replace(x, '[^0-9]', '', 'g')) FOR x IN regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')] AS cards,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15)) AS n_phone FROM d)
SELECT doc_id, n_email, n_ip, len(list_filter(cards, lambda c: length(c) BETWEEN 16 AND 19
  AND list_sum([CASE WHEN i % 2 = 1 THEN c[i]::INT WHEN c[i]::INT > 4 THEN 2 * c[i]::INT - 9 ELSE 2 * c[i]::INT END FOR i IN range(1, length(c) + 1)]) % 10 = 0)) AS n_card, n_phone FROM m
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
r AS (SELECT doc_id, n, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size, row_number() OVER w AS k
  FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(n) AS text_sha256 FROM r
"""

OP7_SQL = mixing.MIX_SQL.replace("AS taken,\n  (whole + CASE WHEN pi > 0 AND 2 * before + size <= 2 * due THEN 1 ELSE 0 END)::BIGINT AS copies, source\n", "AS taken\n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_simhash_near_dedup, op3_nearest_neighbours, op4_substring_dedup, op5_line_dedup, op6_exact_dedup, op7_mixing, op8_best_fit_packing, op9_secret_scan, op10_personal_data, base_secrets, base_personal_data)}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": OP4_SQL, "base_secrets": BASE_SECRETS_SQL, "base_personal_data": BASE_PERSONAL_SQL, "op5_line_dedup": lines.LINES_SQL, "op6_exact_dedup": OP6_SQL, "op7_mixing": OP7_SQL}
