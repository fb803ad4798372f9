"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import packing, quality, scans, spans, splitting, subjects, tokens, truncation
from quire.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_sections(table(spark, d, "paragraphs"), table(spark, d, "sections"), table(spark, d, "split_limits"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(p1_pieces(spark, d))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_records(table(spark, d, "distilled"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_records(spark, d).filter("cut").select("record_id")


def p2_providers(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(p2_records(spark, d))


def _span_texts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paragraphs").select("record_id", F.col("ingested_at").alias("at"), "text")
    return p.unionByName(table(spark, d, "distilled").select("record_id", F.col("written_at").alias("at"), F.col("body_md").alias("text")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.pairs(spans.repeats(_span_texts(spark, d)))


def p3_shared(spark: SparkSession, d: str) -> DataFrame:
    texts = _span_texts(spark, d)
    return spans.shared_share(spans.repeats(texts), texts)


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.spans(spans.repeats(_span_texts(spark, d)))


def p4_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "paragraphs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_statistics(spark, d).filter(F.col("kind").isin("list", "table", "junk")).select("record_id", "kind")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.damaged(table(spark, d, "paragraphs"), table(spark, d, "books"), table(spark, d, "sections"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "paragraphs"), table(spark, d, "books"), table(spark, d, "sections"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(spark.read.parquet(f"{d}/documents.parquet"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_documents(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fills(packing.packed_documents(spark, d), packing.capacity_of(spark, d))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "subject_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_records, p2_providers, p3_found, p3_shared, p3_spans, p4_found, p4_statistics, p5_found, p5_repaired, p6_ids, p7_packed, p7_fill, p8_found, p8_composition)}


_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_HELD = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY {at} DESC NULLS LAST) AS rn FROM {table}) WHERE rn = 1"

#: Plain SQL for what the operators of problems 1 and 3 find, by exhaustive counting.
_SQL = {
    "p1_found": f"WITH p AS ({_HELD.format(at='ingested_at', table='paragraphs')}), w AS (SELECT book_slug, section_pos, sum(len(list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda x: x <> ''))) AS words FROM p GROUP BY ALL), s AS (SELECT book_slug, section_pos, min(level) AS level FROM sections GROUP BY ALL) SELECT book_slug, section_pos FROM w JOIN s USING (book_slug, section_pos) JOIN split_limits USING (level) WHERE words > max_words",
    "p3_found": f"WITH t AS (SELECT record_id, text FROM ({_HELD.format(at='ingested_at', table='paragraphs')}) UNION ALL SELECT record_id, body_md FROM ({_HELD.format(at='written_at', table='distilled')})), w AS (SELECT DISTINCT record_id, hash(substr(text, k, 160)) AS h FROM (SELECT record_id, text, unnest(range(1, length(text) - 158)) AS k FROM t WHERE length(text) >= 160)), m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), x AS (SELECT record_id, h FROM w SEMI JOIN m USING (h)) SELECT DISTINCT a.record_id AS record_a, b.record_id AS record_b FROM x a JOIN x b ON a.h = b.h AND a.record_id < b.record_id",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
