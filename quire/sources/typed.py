"""JSON and JSON lines with a declared schema, and tables of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

#: Declared schemas of the model's tables.
SCHEMAS = {
    "books": "book_slug string, book_title string, book_author string, source_format string, source_path string, page_count int, word_count bigint, parser string, parser_mode string, skipped_pages array<int>, extracted_at timestamp",
    "sections": "book_slug string, section_pos int, section_id string, title string, level int, parent_pos int, top_pos int, path array<string>, section_type string, compression_ratio double",
    "paragraphs": "record_id bigint, book_slug string, para_pos int, section_pos int, paragraph_id string, text string, page_start int, page_end int, is_footnote boolean, is_table boolean, table_grid array<array<string>>, n_words int, ingested_at timestamp",
    "spine_chapters": "book_slug string, section_pos int, chapter_title string, thesis string, argumentative_moves array<string>, voice_sample string, source_word_count bigint, target_word_count bigint",
    "spine_items": "book_slug string, section_pos int, item_type string, item_pos int, name string, detail string, concept string, is_load_bearing boolean, paragraph_ids array<string>",
    "distilled": "record_id bigint, book_slug string, section_pos int, chapter_title string, section_id string, body_md string, word_count bigint, continuation_rounds int, provider string, written_at timestamp",
}


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, lines: bool = False, strict: bool = True) -> DataFrame:
    """JSON documents or lines by a declared schema; a document that does not fit is an error, or with ``strict`` off is left out. Unknown fields are ignored, blank lines skipped."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def domain_errors(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is none of the allowed ones; null is none."""
    from pyspark.sql import functions as F

    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
