"""Books from files to condensed texts, in stages that are written and can be taken up again."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.text import word_count
from quire.operators import budget, condense, coverage, render, structure
from quire.sinks.files import epubs, is_complete, write_epubs, write_texts
from quire.session import materialize
from quire.sources import epub, plain

Tables = dict[str, DataFrame]


@dataclass
class Run:
    """A run's folder and settings, and the tables its stages have written."""

    spark: SparkSession
    folder: str
    config: dict[str, Any]
    source: str
    done: list[tuple[str, str]] = field(default_factory=list)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def ingest(run: Run) -> Tables:
    """Text files by their headings; EPUBs by their pages, else by the headings among their paragraphs, else by those of all their text, so that every book is kept."""
    texts = plain.read_text(run.spark, f"{run.source}/*.{{txt,text,md,markdown,rst}}").withColumn("title", F.lit(None).cast("string")).withColumn("author", F.lit(None).cast("string"))
    meta, html = epub.read_pages(run.spark, run.source)
    pages = materialize(epub.html_sections(html), "ingest-pages")
    by_page = epub.strategy(pages).filter("strategy = 'pages'").select("path")
    cut = epub.resplit(pages.join(by_page, "path", "left_anti"))
    placed = by_page.unionByName(cut.select("path").distinct())
    merged = epub.plain_text(html).join(meta, "path", "left")
    b1, s1, p1 = plain.to_tables(texts.unionByName(merged.join(placed, "path", "left_anti").select("path", "text", "title", "author")))
    b2, s2, p2 = _from_pages(pages.join(by_page, "path").select("path", "pos", "title", "paragraphs", "n_words").unionByName(cut), meta, merged.select("path", "text"))
    sections, paras = structure.in_parts(materialize(s1.unionByName(s2), "ingest-sections"), materialize(p1.unionByName(p2), "ingest-paragraphs"), run.config["ingest"]["split_over"], run.config["ingest"]["split_target"])
    return {"books": b1.unionByName(b2), "sections": sections, "paragraphs": paras}


def _from_pages(pages: DataFrame, meta: DataFrame, text: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window

    from quire.functions.ids import paragraph_id, section_id
    from quire.functions.text import estimated_pages

    x = pages.withColumn("book_slug", plain.book_slug(F.col("path"))).withColumnRenamed("pos", "section_pos")
    one = F.lit(1)
    sections = x.select("book_slug", "section_pos", section_id(F.col("title"), one, F.array().cast("array<string>")).alias("section_id"), "title", one.alias("level"), F.lit(None).cast("int").alias("parent_pos"), F.col("section_pos").alias("top_pos"), F.array("title").alias("path"))
    each = x.select("book_slug", "section_pos", "title", F.posexplode("paragraphs").alias("k", "text"))
    pos = F.row_number().over(Window.partitionBy("book_slug").orderBy("section_pos", "k")) - 1
    paras = each.withColumn("pos", pos).select("book_slug", F.col("pos").alias("para_pos"), "section_pos", paragraph_id(F.col("text"), F.array("title"), one).alias("paragraph_id"), "text", one.alias("page_start"), one.alias("page_end"), F.lit(False).alias("is_footnote"), F.lit(False).alias("is_table"), F.lit(None).cast("array<array<string>>").alias("table_grid"), word_count(F.col("text")).alias("n_words"))
    n = pages.groupBy("path").agg(F.sum("n_words").cast("bigint").alias("word_count"))
    books = text.join(n, "path").join(meta, "path", "left").select(plain.book_slug(F.col("path")).alias("book_slug"), plain.title_of(F.col("path"), F.col("title")).alias("book_title"), F.col("author").alias("book_author"), F.lit("epub").alias("source_format"), F.col("path").alias("source_path"), estimated_pages(F.col("text")).cast("int").alias("page_count"), "word_count", F.lit("fallback").alias("parser"), F.lit("auto").alias("parser_mode"))
    return books, sections, paras


def classify(run: Run) -> Tables:
    s = run.table("sections")
    kinds = s.select("book_slug", "section_pos", budget.type_by_title(F.col("title")).alias("section_type"), F.lit(1).alias("seq"))
    classed = budget.with_classes(s, kinds)
    words = budget.section_words(run.table("paragraphs"), s)
    targets = budget.evened(budget.targets(words, classed), run.config["distill"]["compression_ratio"])
    return {"classes": classed, "targets": targets, "audit": budget.coverage_audit(s, run.table("paragraphs"))}


def spine(run: Run) -> Tables:
    paras = run.table("paragraphs")
    sents = condense.sentences(paras)
    terms = condense.key_terms(paras)
    t = run.table("targets").filter("words >= 50")
    heads = run.table("sections").select("book_slug", "section_pos", F.col("title").alias("chapter_title"))
    chapters = t.join(condense.thesis(sents), ["book_slug", "section_pos"]).join(heads, ["book_slug", "section_pos"])
    none = F.array().cast("array<string>")
    items = terms.select("book_slug", "section_pos", F.when(F.col("rank") == 1, "framework").otherwise("key_term").alias("item_type"), (F.col("rank") - 1).alias("item_pos"), F.col("term").alias("name"), F.lit("").alias("detail"), F.lit(None).cast("string").alias("concept"), F.lit(None).cast("boolean").alias("is_load_bearing"), none.alias("paragraph_ids"))
    return {
        "spine_chapters": chapters.select("book_slug", "section_pos", "chapter_title", "thesis", none.alias("argumentative_moves"), F.col("voice").alias("voice_sample"), F.col("words").alias("source_word_count"), F.col("target_words").alias("target_word_count")),
        "spine_items": items.join(chapters.select("book_slug", "section_pos"), ["book_slug", "section_pos"], "left_semi"),
    }


def distill(run: Run) -> Tables:
    c = run.table("spine_chapters")
    text = condense.best_sentences(condense.sentences(run.table("paragraphs")), run.table("targets"), run.table("spine_items"))
    return {"distilled": text.join(c.select("book_slug", "section_pos", "chapter_title"), ["book_slug", "section_pos"])}


def coherence(run: Run) -> Tables:
    c, i, d = run.table("spine_chapters"), run.table("spine_items"), run.table("distilled")
    missing = coverage.missing_items(i, d, run.config["coherence"]["similarity_threshold"])
    verdicts = coverage.verdicts(missing, c)
    b = run.table("books")
    return {
        "missing_items": missing,
        "fix_plan": coverage.fix_plan(missing, run.config["coherence"]["max_fix_rounds"]),
        "manifest": render.output_manifest(b, d, verdicts),
        "distillation_md": render.distillation_markdown(b, c, i, d, "undated"),
        "spine_md": render.spine_markdown(b, c, i),
        "source_md": render.source_markdown(b, run.table("sections"), run.table("paragraphs")),
    }


@dataclass(frozen=True, order=True)
class Stage:
    """Stages run in the order of their keys, numbers first and letters after them."""

    order: tuple[int, str]
    name: str
    run: Callable[[Run], Tables] = field(compare=False)


def stage(key: str, name: str, f: Callable[[Run], Tables]) -> Stage:
    m = re.fullmatch(r"(\d+)([a-z]?)", key)
    if not m:
        raise ValueError(f"stage key {key!r}")
    return Stage((int(m[1]), m[2]), name, f)


STAGES = [stage("01", "ingest", ingest), stage("02", "classify", classify), stage("03", "spine", spine), stage("04", "distill", distill), stage("05", "coherence", coherence)]


def run_pipeline(spark: SparkSession, source: str, folder: str, config: dict[str, Any], only: str | None = None, force: bool = False, until: str | None = None, stages: list[Stage] | None = None) -> Run:
    """Run the stages whose output is not complete yet, or with ``force`` all.

    ``only`` names one stage to run, ``until`` the last one. A stage is
    complete when all its tables are written; the marker comes last.
    """
    run = Run(spark, folder.rstrip("/"), config, source.rstrip("/"))
    for st in sorted(stages or STAGES):
        if only and st.name != only:
            continue
        marker = f"{run.folder}/_stage_{st.name}"
        if not force and not only and is_complete(spark, marker):
            run.done.append((st.name, "kept"))
        else:
            names = []
            for name, df in st.run(run).items():
                df.write.mode("overwrite").parquet(f"{run.folder}/{name}")
                names.append((name,))
            spark.createDataFrame(names, "table string").coalesce(1).write.mode("overwrite").parquet(marker)
            run.done.append((st.name, "run"))
        if st.name == until:
            break
    return run


def export(run: Run, folder: str) -> None:
    """The rendered books as files side by side: Markdown, and EPUBs of the condensed chapters."""
    folder = folder.rstrip("/")
    for table, suffix in (("distillation_md", ".md"), ("spine_md", ".spine.md"), ("source_md", ".source.md")):
        write_texts(run.table(table), f"{folder}/{table}", "book_slug", "markdown", suffix, render.ORDER)
    pages = render.epub_chapters(run.table("spine_chapters"), run.table("spine_items"), run.table("distilled"))
    write_epubs(epubs(run.table("books"), pages), f"{folder}/epub")
