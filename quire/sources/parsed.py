"""Items of a layout parser as sections and paragraphs, and files by such a parser where one is installed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.functions.ids import paragraph_id, section_id
from quire.functions.markdown import grid_text
from quire.functions.text import word_count
from quire.operators.structure import heading_level, item_role, parents

ITEM = "path string, pos int, label string, level int, text string, page_no int, table_grid array<array<string>>"


def parse_files(spark: SparkSession, path: str, parse: Callable[[str, bytes], list[dict]]) -> DataFrame:
    """Items of every file by ``parse(path, content)``, which runs in the executors; a file it fails on gives one item ``failed``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = ["path", "pos", "label", "level", "text", "page_no", "table_grid"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    items = parse(p, content.as_py())
                except Exception as e:  # any failure of a parser means the fallback for its file
                    items = [{"pos": 0, "label": "failed", "text": str(e)[:500]}]
                rows = [(p, *(i.get(n) for n in names[1:])) for i in items]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(run, ITEM)


def to_tables(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, paragraphs) of parser items; the first column is the book's slug.

    Items before any heading belong to a section ``Body`` at position -1. A
    section's id is of the path that was open when its heading was met.
    """
    w = Window.partitionBy("book_slug").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    role = item_role(F.col("label"), F.col("text"), F.coalesce(F.max(F.col("label") == "section_header").over(before), F.lit(False)))
    x = items.withColumn("role", role).filter("role is not null and label != 'failed'").withColumn("page_no", F.coalesce("page_no", F.lit(1)))
    heads = x.filter("role = 'section'").select("book_slug", F.col("pos").alias("section_pos"), F.trim("text").alias("title"), F.greatest(F.lit(1), heading_level(F.trim("text"), F.coalesce("level", F.lit(1)))).alias("level"))
    tree = parents(heads)
    path = _paths(tree)
    section_at = F.last(F.when(F.col("role") == "section", F.col("pos")), ignorenulls=True).over(upto)
    body = x.withColumn("section_pos", F.coalesce(section_at, F.lit(-1))).filter("role != 'section'")
    p = body.join(path.select("book_slug", "section_pos", "path"), ["book_slug", "section_pos"], "left").withColumn("path", F.coalesce("path", F.array(F.lit("Body"))))
    text = F.when(F.col("role") == "table", grid_text(F.col("table_grid"))).otherwise(F.trim("text"))
    paras = p.withColumn("body", text).select("book_slug", F.col("pos").alias("para_pos"), "section_pos", paragraph_id(F.col("body"), F.col("path"), F.col("page_no")).alias("paragraph_id"), F.col("body").alias("text"), F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), (F.col("role") == "footnote").alias("is_footnote"), (F.col("role") == "table").alias("is_table"), "table_grid", word_count(F.col("body")).alias("n_words"))
    prior = F.coalesce(F.lag("path").over(Window.partitionBy("book_slug").orderBy("section_pos")), F.array(F.lit("Body")))
    sections = path.withColumn("prior", prior).select("book_slug", "section_pos", section_id(F.col("title"), F.col("level"), F.col("prior")).alias("section_id"), "title", "level", "parent_pos", "top_pos", "path")
    return sections, paras


def _paths(tree: DataFrame, depth: int = 6) -> DataFrame:
    """Adds path: titles from the root down. At most ``depth`` joins of headings with their parents."""
    out = tree.withColumn("path", F.array("title")).withColumn("up", F.col("parent_pos"))
    above = tree.select("book_slug", F.col("section_pos").alias("up"), F.col("title").alias("up_title"), F.col("parent_pos").alias("up_up"))
    for _ in range(depth - 1):
        out = out.join(above, ["book_slug", "up"], "left").withColumn("path", F.when(F.col("up_title").isNotNull(), F.concat(F.array("up_title"), "path")).otherwise(F.col("path"))).drop("up", "up_title").withColumnRenamed("up_up", "up")
    return out.drop("up")


def table_ordinals(paragraphs: DataFrame) -> DataFrame:
    """(book_slug, section_pos, para_pos, ordinal) of tables: how many paragraphs of the section stand before each."""
    w = Window.partitionBy("book_slug", "section_pos").orderBy("para_pos")
    return paragraphs.withColumn("ordinal", F.row_number().over(w) - 1).filter("is_table").select("book_slug", "section_pos", "para_pos", "ordinal")
