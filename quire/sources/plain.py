"""Plain text files, and text cut into sections by its headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quire.functions.text import slug, title_case, word_count
from quire.operators.structure import MATTER_WORDS, NUMBER_WORDS

#: Headings in a whole text; what follows a number may run on to the next line that is not empty (fixed value).
HEADING = rf"(?im)^[ \t]*((?:chapter|part)\s+(?:\d+|{NUMBER_WORDS})[:.]?\s*.*|{MATTER_WORDS})$"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every file, a file a row; bytes that are no UTF-8 are dropped."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.replace("value", F.lit("\ufffd"), F.lit("")).alias("text"))


def book_slug(path: Column) -> Column:
    return slug(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def title_of(path: Column, stated: Column) -> Column:
    """The stated title, else the file's name in words."""
    stem = F.translate(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), "-_", "  ")
    return F.coalesce(F.nullif(F.trim(stated), F.lit("")), title_case(stem))


def split_by_headings(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_pos, title, para_pos, paragraph) of texts cut at chapter and part headings, and at those that are one word.

    Text before the first heading is dropped; one without any heading is one
    section ``Body``, whose paragraphs keep their blanks at the ends.
    Paragraphs are apart by blank lines, empty ones are dropped. Null texts
    have no rows. Line ends of any kind count.
    """
    t = F.regexp_replace(F.col(text), "\r\n?", "\n")
    titles = F.regexp_extract_all(t, F.lit(HEADING), F.lit(1))
    bodies = F.split(t, HEADING)
    x = texts.select(F.col(key), titles.alias("titles"), bodies.alias("bodies"), t.alias("t")).filter("t is not null")
    headed = x.filter("size(titles) > 0").select(key, F.posexplode(F.arrays_zip("titles", F.slice("bodies", 2, F.size("titles")).alias("b"))).alias("section_pos", "z"))
    cut = headed.select(key, "section_pos", F.trim(F.col("z.titles")).alias("title"), F.posexplode(F.split("z.b", "\n\n")).alias("para_pos", "p")).withColumn("paragraph", F.trim(F.regexp_replace("p", r"^\s+|\s+$", "")))
    whole = x.filter("size(titles) = 0").select(key, F.lit(0).alias("section_pos"), F.lit("Body").alias("title"), F.posexplode(F.split("t", "\n\n")).alias("para_pos", "paragraph"))
    out = cut.select(key, "section_pos", "title", "para_pos", "paragraph").unionByName(whole)
    return out.filter(F.trim(F.regexp_replace("paragraph", r"\s", "")) != "")


def headings(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_pos, title) of the sections ``split_by_headings`` makes, those without paragraphs included; blank texts have none."""
    t = F.regexp_replace(F.col(text), "\r\n?", "\n")
    titles = F.regexp_extract_all(t, F.lit(HEADING), F.lit(1))
    named = F.when(F.size(titles) > 0, F.transform(titles, lambda x: F.trim(x))).otherwise(F.array(F.lit("Body")))
    return texts.filter(F.trim(F.regexp_replace(text, r"\s", "")) != "").select(key, F.posexplode(named).alias("section_pos", "title"))


def to_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, sections, paragraphs) of (path, text, title, author): the relational model of plain books."""
    from quire.functions.ids import paragraph_id, section_id
    from quire.functions.text import estimated_pages

    base = files.withColumn("book_slug", book_slug(F.col("path")))
    cut = split_by_headings(base, "book_slug")
    pos = F.row_number().over(Window.partitionBy("book_slug").orderBy("section_pos", "para_pos")) - 1
    paras = cut.withColumn("pos", pos).select("book_slug", F.col("pos").alias("para_pos"), "section_pos", paragraph_id(F.col("paragraph"), F.array("title"), F.lit(1)).alias("paragraph_id"), F.col("paragraph").alias("text"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit(False).alias("is_footnote"), F.lit(False).alias("is_table"), F.lit(None).cast("array<array<string>>").alias("table_grid"), word_count(F.col("paragraph")).alias("n_words"))
    heads = headings(base, "book_slug")
    none = F.array().cast("array<string>")
    sections = heads.select("book_slug", "section_pos", section_id(F.col("title"), F.lit(1), none).alias("section_id"), "title", F.lit(1).alias("level"), F.lit(None).cast("int").alias("parent_pos"), F.col("section_pos").alias("top_pos"), F.array("title").alias("path"))
    n = paras.groupBy("book_slug").agg(F.sum("n_words").alias("word_count"))
    books = base.join(n, "book_slug", "left").select("book_slug", title_of(F.col("path"), F.col("title")).alias("book_title"), F.col("author").alias("book_author"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("source_format"), F.col("path").alias("source_path"), estimated_pages(F.col("text")).cast("int").alias("page_count"), F.coalesce("word_count", F.lit(0)).cast("bigint").alias("word_count"), F.lit("fallback").alias("parser"), F.lit("auto").alias("parser_mode"))
    return books, sections, paras
