"""The operators applied to whole tables with production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup, token_counts, token_file, toxicity


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir: str):
    return quality_rules.score_rules(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir: str):
    return decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark, sf_dir: str):
    return substring_dedup.digest(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op4_toxicity(spark, sf_dir: str):
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_near_dedup(spark, sf_dir: str):
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir: str):
    from corpusloom.llm import line_dedup

    return line_dedup.digest(line_dedup.remove_line_runs(_table(spark, sf_dir, "documents")))


def op7_token_file(spark, sf_dir: str):
    return token_file.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_mixing(spark, sf_dir: str):
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir: str):
    return quality_classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_token_counts(spark, sf_dir: str):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_decontamination, op3_substring_dedup, op4_toxicity, op5_near_dedup, op6_line_dedup, op7_token_file, op8_mixing, op9_quality_classifier, op10_token_counts, pipeline)
}

_OP2 = """
WITH bench AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), wins AS (
    SELECT DISTINCT item_id, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS win, least(8, len(w)) AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM bench WHERE len(w) > 0)
), docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), places AS (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wins) ks WHERE len(w) >= k
), hits AS (
    SELECT p.doc_id, x.item_id, p.i, p.k FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM places) p JOIN wins x ON p.k = x.k AND p.win = x.win
), covered AS (
    SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(f.items, '')) AS items_sha256, coalesce(f.n_items, 0) >= 2 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

_OP3 = """
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS d FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT w.doc_id, w.i, unnest(range(0, 13)) AS j FROM wins w JOIN firsts f ON w.win = f.win AND w.doc_id > f.d)),
words AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

_OP5 = """
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
    )
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), sides AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT a AS d, r FROM reach JOIN sides ON b = d
)
SELECT d AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, d = min(r) AS kept FROM reach LEFT JOIN sizes ON doc_id = d GROUP BY d
"""

_OP6 = """
WITH lines AS (SELECT doc_id, i, l[i] AS body FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
placed AS (SELECT doc_id, i, body, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1 AS later FROM lines)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE later) AS n_removed, sha256(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE NOT later), '')) AS kept_sha256 FROM placed GROUP BY doc_id
"""

ORACLES = {"op2_decontamination": _OP2, "op3_substring_dedup": _OP3, "op5_near_dedup": _OP5, "op6_line_dedup": _OP6}
