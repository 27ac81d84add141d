"""Queries of the text problems 7 to 9, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import langid, mixing, packing
from chunkloom.session import cut, table


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).where("n_parts > 1").select("doc_id").distinct()


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every document with its container."""
    return _packed(spark, sf_dir)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(_packed(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).short()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of every source."""
    return _mix(spark, sf_dir).report()


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken into the mix."""
    return _mix(spark, sf_dir).selection()


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, codes = table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes")
    labels = langid.LanguageLabels(docs, codes, [("text", "lang"), ("text_tgt", "lang_tgt")])
    return cut(labels.segments(docs.withColumnRenamed("lang", "label"), "doc_id", "text", "label"), "segments"), codes


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, codes = _segments(spark, sf_dir)
    return langid.contradicted(found, codes, "label")


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment in one language, with its confidence."""
    found, _ = _segments(spark, sf_dir)
    return found.drop("label").distinct()


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's languages with pooled confidences."""
    found, _ = _segments(spark, sf_dir)
    return langid.document_languages(found.drop("label").distinct()).withColumns({c: F.round(c, 6) for c in ("confidence", "probability")})


QUERIES = {f.__name__: f for f in (p7_found, p7_packed, p7_containers, p8_found, p8_report, p8_selection, p9_found, p9_segments, p9_documents)}

#: Tokens of a public tokenizer and a trained network are beyond SQL; see tests/llm.  But the
#: tables hold no text and no source near its limit, so that sizes in characters (about four a
#: token) decide these two alike.
ORACLE: dict[str, str] = {
    "p7_found": "SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND length(text) > 1024 * 4",
    "p8_found": """WITH t AS (SELECT lower(trim(source)) AS source, sum(weight) AS weight, greatest(1, max(max_repeats)) AS repeats FROM mix_targets WHERE source IS NOT NULL AND weight > 0 GROUP BY 1),
d AS (SELECT DISTINCT doc_id, text, lower(trim(source)) AS source FROM documents WHERE doc_id IS NOT NULL), z AS (SELECT source, weight, repeats, coalesce(sum(length(text)), 0) AS size FROM t LEFT JOIN d USING (source) GROUP BY ALL)
SELECT source FROM z WHERE repeats * size < weight * (SELECT sum(size) FROM z)""",
}
