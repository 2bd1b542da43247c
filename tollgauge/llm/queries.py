"""The dealt operators as registered queries over whole tables, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tollgauge.llm.archives import op8_warc_dictionary
from tollgauge.llm.jaccard import op5_ngram_jaccard
from tollgauge.llm.language import op3_language_id
from tollgauge.llm.line_runs import op11_line_runs
from tollgauge.llm.mixing import op4_fair_mix
from tollgauge.llm.neighbours import op10_collision_neighbours
from tollgauge.llm.outliers import op6_robust_outliers
from tollgauge.llm.pieces import op2_sentencepiece
from tollgauge.llm.quality import op1_pu_quality
from tollgauge.llm.spelling import op13_spelling_trie
from tollgauge.llm.substrings import op9_substring_dedup
from tollgauge.llm.surrogates import op7_pii_surrogates
from tollgauge.llm.tables import table
from tollgauge.llm.whitening import op12_block_whitening

Query = Callable[[SparkSession, str], DataFrame]

#: Words of a text in DuckDB.
WORD_LIST = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return op1_pu_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return op2_sentencepiece(table(spark, folder, "documents"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return op3_language_id(table(spark, folder, "documents"))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return op4_fair_mix(table(spark, folder, "documents"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    return op5_ngram_jaccard(table(spark, folder, "documents"))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return op6_robust_outliers(table(spark, folder, "documents"))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return op7_pii_surrogates(table(spark, folder, "documents"))


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return op8_warc_dictionary(table(spark, folder, "pages"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return op9_substring_dedup(table(spark, folder, "documents"))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return op10_collision_neighbours(table(spark, folder, "embeddings"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return op11_line_runs(table(spark, folder, "documents"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return op12_block_whitening(table(spark, folder, "embeddings"))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return op13_spelling_trie(table(spark, folder, "documents"))


OP8_SQL = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages),
first AS (SELECT html, max(page_id) AS first FROM page WHERE size >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT page_id, size AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM page LEFT JOIN first USING (html)
"""

OP9_SQL = f"""
WITH words AS (SELECT doc_id, row_number() OVER () AS r, {WORD_LIST} AS ws FROM documents),
windows AS (SELECT r, i, list_aggregate(ws[i:i + 34], 'string_agg', ' ') AS s FROM words, unnest(range(1, len(ws) - 33)) AS t(i)),
again AS (SELECT r, i FROM windows JOIN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1) USING (s)),
gone AS (SELECT DISTINCT r, i + d AS i FROM again, unnest(range(0, 35)) AS t(d)),
lists AS (SELECT r, list(i) AS gs FROM gone GROUP BY r),
kept AS (SELECT doc_id, ws, CASE WHEN gs IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda p: NOT list_contains(gs, p[2])), lambda p: p[1]) END AS ks
         FROM words LEFT JOIN lists USING (r))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(ks) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256
FROM kept
"""

OP11_SQL = """
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM docs, unnest(range(1, len(ls) + 1)) AS t(i)),
often AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
stay AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept FROM lines ANTI JOIN often USING (k) GROUP BY r)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN stay USING (r)
"""

QUERIES: dict[str, Query] = {
    "op1_pu_quality": op1,
    "op2_sentencepiece": op2,
    "op3_language_id": op3,
    "op4_fair_mix": op4,
    "op5_ngram_jaccard": op5,
    "op6_robust_outliers": op6,
    "op7_pii_surrogates": op7,
    "op8_warc_dictionary": op8,
    "op9_substring_dedup": op9,
    "op10_collision_neighbours": op10,
    "op11_line_runs": op11,
    "op12_block_whitening": op12,
    "op13_spelling_trie": op13,
}
ORACLES: dict[str, str] = {"op8_warc_dictionary": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op11_line_runs": OP11_SQL}
