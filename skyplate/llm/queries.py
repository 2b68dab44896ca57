"""Queries over the training-data operators, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, pii, sentencepiece, simhash, substring
from .common import fold, materialize, table
from .language_id import LanguageId
from .line_crf import LineCrf
from .quality_rules import QualityRules, measured
from .toxicity import Toxicity


def is_held(remainder: Column, value: int) -> Column:
    """A row without an id is in no fold: it is not held out, and nothing is learned from it."""
    return F.coalesce(remainder == value, F.lit(False))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(measured(table(spark, sf_dir, "documents")), "statistics")
    return QualityRules().learn(stats, table(spark, sf_dir, "labels")).judge(stats)


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5)
    return LineCrf().fit(docs, table(spark, sf_dir, "labels").where(rest != 0)).apply(docs).withColumn("held_out", is_held(rest, 0))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4)
    return LanguageId().fit(docs, rest != 2).apply(docs).withColumn("held_out", is_held(rest, 2))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rest = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4)
    return Toxicity().fit(docs, table(spark, sf_dir, "labels").where(rest != 2)).apply(docs).withColumn("held_out", is_held(rest, 2))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.dedup(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_quality_rules, op3_quality_crf, op4_simhash, op5_sentencepiece, op6_language_id, op7_decontamination, op8_toxicity, op9_pii, op10_substring_dedup)}


#: All windows compared by their word sequences. The operators without SQL learn, hash in a way that DuckDB lacks or segment texts.
SUBSTRING_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS ws FROM documents),
w AS (SELECT r, doc_id, s, array_to_string(ws[s:s + 12], ' ') AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
g AS (SELECT DISTINCT r, s + o AS p FROM (SELECT r, s FROM w JOIN f USING (k) WHERE doc_id > first), (SELECT unnest(range(0, 13)) AS o)),
t AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
l AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.r = t.r AND g.p = t.p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN l USING (r)"""


#: All alignments that share a word compared by definition: equal words in each run, without seeds.
LEAKS_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x : x <> '') AS ws FROM documents),
b AS (SELECT ws, min(item_id) AS item_id, count(*) AS copies, len(ws) AS n FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x : x <> '') AS ws FROM benchmark) WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT *, least(13, n) AS run, least(13, n) - CASE WHEN n < 5 THEN 0 WHEN n < 10 THEN 1 ELSE 2 END AS least_same FROM b),
dw AS (SELECT r, len(ws) AS size, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
iw AS (SELECT item_id, copies, n, run, least_same, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM t),
m AS (SELECT r, item_id, copies, n, run, least_same, p - i AS shift, i, size FROM dw JOIN iw USING (w) WHERE least(n, size - (p - i)) - greatest(0, i - p) >= run),
c AS (SELECT *, count(*) OVER (PARTITION BY r, item_id, shift ORDER BY i RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS near FROM m),
s AS (SELECT r, item_id, copies, n, shift, count(*) AS n_same FROM c GROUP BY r, item_id, copies, n, shift, least_same HAVING max(near) >= least_same),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY r, item_id ORDER BY n_same DESC, shift) = 1)
SELECT doc_id, sum(copies)::BIGINT AS n_items, arg_min(item_id, (-n_same, item_id)) AS item_id, arg_min(shift, (-n_same, item_id))::INT AS "at", max(n_same)::BIGINT AS n_same, arg_min(n, (-n_same, item_id))::BIGINT AS n_item FROM a JOIN d USING (r) GROUP BY r, doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": LEAKS_SQL, "op10_substring_dedup": SUBSTRING_SQL}
