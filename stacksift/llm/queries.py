"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import perspectives

    return perspectives(table(spark, sf_dir, "conversations"))


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprint_hex, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_sequences

    return pack_sequences(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_html_mincut, op2_suffix_dedup, op3_best_fit_packing, op4_quality, op5_toxicity, op6_decontamination, op7_chat_perspectives, op8_simhash_golay, op9_license_scan, op10_exact_topk)}
WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": f"""
WITH i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 9), ' ') AS win, CAST(least(len(w), 10) AS BIGINT) AS m
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, text, {WORDS_SQL} AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM iw),
g AS (SELECT doc_id, s, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, sizes WHERE len(w) >= m)),
f AS (SELECT g.doc_id, g.s, g.m, iw.item_id FROM g JOIN iw ON g.win = iw.win AND g.m = iw.m),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS p FROM f) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op7_chat_perspectives": r"""
WITH c AS (SELECT conv_id, turn, replace(replace(trim(regexp_replace(coalesce(role, ''), '[\x00-\x20\x7F\x{85}\x{A0}\x{2028}\x{2029}]+', ' ', 'g')), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS name,
    replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS said FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, turn, CASE WHEN name = '' THEN 'unknown' ELSE name END AS speaker, said FROM c),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker <> 'system'),
b AS (SELECT s.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role FROM s JOIN p USING (conv_id)),
h AS (SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM b),
r AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS rendered FROM h),
w AS (SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, said ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM r)
SELECT conv_id, perspective, turn, speaker, chat_role, rendered, CAST(stop - length(rendered) AS BIGINT) AS start, stop,
  CASE WHEN chat_role = 'assistant' THEN CAST(stop - length(rendered) + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN chat_role = 'assistant' THEN stop - 1 END AS mask_stop FROM w
""",
    "op10_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
}
