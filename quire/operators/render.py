"""Books as Markdown: rows (book_slug, section_pos, place, markdown), whose texts in order, a line end apart, are a book.

A book is never put together in one row; the sink writes its rows in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.markdown import grid_markdown, html_blocks
from quire.functions.text import citations_to_links, title_case
from quire.operators.structure import is_generic_title

#: The order of a book's rows.
ORDER = ("section_pos", "place")


def _row(section: Column, place: Column, text: Column) -> list[Column]:
    return [F.col("book_slug"), section.cast("bigint").alias("section_pos"), place.cast("bigint").alias("place"), text.alias("markdown")]


def source_markdown(books: DataFrame, sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The source text with an anchor after every paragraph; headings no deeper than six, tables as tables. Null texts are empty lines."""
    zero, top = F.lit(0), F.lit(-1)
    title = books.select(*_row(top, zero, F.concat(F.lit("# "), F.coalesce("book_title", F.lit("")))))
    hashes = F.repeat(F.lit("#"), F.least(F.lit(6), F.col("level") + 1))
    heads = sections.select(*_row(F.col("section_pos"), top, F.concat(F.lit("\n"), hashes, F.lit(" "), F.coalesce("title", F.lit("")))))
    body = F.coalesce(F.when(F.coalesce("is_table", F.lit(False)), grid_markdown(F.col("table_grid"))), F.col("text"), F.lit(""))
    paras = paragraphs.select(*_row(F.col("section_pos"), F.col("para_pos"), F.concat(F.lit("\n"), body, F.lit("\n^"), F.coalesce("paragraph_id", F.lit("")))))
    return title.unionByName(heads).unionByName(paras)


def spine_markdown(books: DataFrame, chapters: DataFrame, items: DataFrame) -> DataFrame:
    """The items of every chapter as a readable list."""
    zero, top = F.lit(0), F.lit(-1)
    title = books.select(*_row(top, zero, F.concat(F.lit("# "), F.coalesce("book_title", F.lit("")), F.lit(" — Spine"))))
    heads = chapters.select(*_row(F.col("section_pos"), zero, F.concat(F.lit("\n## "), F.coalesce("chapter_title", F.lit("")), F.lit("\n\n**Thesis:** "), F.coalesce("thesis", F.lit("")))))
    order = F.when(F.col("item_type") == "framework", 1).when(F.col("item_type") == "example", 2).otherwise(4)
    label = F.when(F.col("item_type") == "framework", "Frameworks").when(F.col("item_type") == "example", "Key examples").otherwise("Key terms")
    kinds = items.join(chapters.select("book_slug", "section_pos"), ["book_slug", "section_pos"], "left_semi").withColumn("o", order).withColumn("label", label)
    line = F.concat(F.lit("- **"), F.coalesce("name", F.lit("")), F.lit("**: "), F.coalesce("detail", F.lit("")))
    lists = kinds.groupBy("book_slug", "section_pos", "o", "label").agg(F.array_sort(F.collect_list(F.struct("item_pos", line.alias("line")))).alias("x"))
    lists = lists.select(*_row(F.col("section_pos"), F.col("o"), F.concat(F.lit("\n**"), F.col("label"), F.lit(":**\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"))))
    numbered = F.array_join(F.transform("argumentative_moves", lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), m)), "\n")
    moves = chapters.filter(F.size("argumentative_moves") > 0).select(*_row(F.col("section_pos"), F.lit(3), F.concat(F.lit("\n**Argument flow:**\n"), numbered)))
    ends = chapters.select(*_row(F.col("section_pos"), F.lit(9), F.lit("\n---")))
    return title.unionByName(heads).unionByName(lists).unionByName(moves).unionByName(ends)


def smart_title(title: Column, framework: Column, term: Column, thesis: Column, index: Column) -> Column:
    """A readable title where splitting gave a generic one: by the first framework, else the first key term, else the thesis's first words."""
    fw = title_case(framework)
    named = F.when(F.length(fw) > 50, F.concat(F.left(fw, F.lit(47)), F.lit("..."))).otherwise(fw)
    words = F.concat(title_case(F.array_join(F.slice(F.split(F.trim(thesis), r"\s+"), 1, 5), " ")), F.lit("..."))
    better = F.concat(F.lit("Chapter "), index.cast("string"), F.lit(": "), F.coalesce(named, title_case(term), words))
    return F.when(is_generic_title(title) & (title != "Front Matter"), F.coalesce(better, title)).otherwise(title)


def strip_own_heading(body: Column, title: Column) -> Column:
    """A body without a first second-level heading that repeats the chapter's title."""
    head = F.regexp_extract(body, r"^##\s+([^\n]*?)\s*\n", 1)
    return F.when((head != "") & (head == title), F.regexp_replace(body, r"^##\s+[^\n]*\n", "")).otherwise(body)


def chapter_titles(chapters: DataFrame, items: DataFrame) -> DataFrame:
    """(book_slug, section_pos, idx, title) of every chapter in order, readable where its own is generic."""
    first = items.filter("coalesce(name, '') != ''").groupBy("book_slug", "section_pos").agg(
        F.min_by("name", F.when(F.col("item_type") == "framework", F.col("item_pos"))).alias("framework"),
        F.min_by("name", F.when(F.col("item_type") == "key_term", F.col("item_pos"))).alias("term"),
    )
    idx = F.row_number().over(Window.partitionBy("book_slug").orderBy("section_pos"))
    x = chapters.withColumn("idx", idx).join(first, ["book_slug", "section_pos"], "left")
    return x.select("book_slug", "section_pos", "idx", smart_title(F.col("chapter_title"), F.col("framework"), F.col("term"), F.col("thesis"), F.col("idx")).alias("title"))


def _names(items: DataFrame, kind: str, name: str) -> DataFrame:
    """(book_slug, section_pos, names of a chapter's items of a kind in order)."""
    listed = F.array_sort(F.collect_list(F.struct("item_pos", F.coalesce("name", F.lit("")).alias("name"))))
    return items.filter(F.col("item_type") == kind).groupBy("book_slug", "section_pos").agg(F.array_join(F.transform(listed, lambda r: r["name"]), ", ").alias(name))


def _told(chapters: DataFrame, items: DataFrame, bodies: DataFrame) -> DataFrame:
    """The condensed chapters with a readable title and what their spine says."""
    key = ["book_slug", "section_pos"]
    titles = chapter_titles(bodies.select(*key, "chapter_title").join(chapters.select(*key, "thesis"), key, "left"), items)
    spine = chapters.select(*key, "thesis", "argumentative_moves", F.lit(True).alias("has_spine"))
    x = bodies.join(titles, key).join(spine, key, "left")
    return x.join(_names(items, "framework", "fw"), key, "left").join(_names(items, "example", "ex"), key, "left")


def distillation_markdown(books: DataFrame, chapters: DataFrame, items: DataFrame, bodies: DataFrame, generated: str) -> DataFrame:
    """The condensed book: byline, length in pages of 275 words, each chapter's spine as a folded note, and its text with linked citations."""
    total = bodies.groupBy("book_slug").agg(F.sum(F.coalesce("word_count", F.lit(0))).alias("w"))
    author = F.when(F.coalesce("book_author", F.lit("")) != "", F.concat(F.lit('*Distilled from "'), F.coalesce("book_title", F.lit("")), F.lit('" by '), "book_author", F.lit(".*"))).otherwise(F.concat(F.lit('*Distilled from "'), F.coalesce("book_title", F.lit("")), F.lit('".*')))
    pages = F.floor(F.coalesce("w", F.lit(0)) / F.lit(275)).cast("string")
    zero, top = F.lit(0), F.lit(-1)
    head = books.join(total, "book_slug").select(*_row(top, zero, F.concat(F.lit("# "), F.coalesce("book_title", F.lit("")), F.lit("\n\n"), author, F.lit("\n*~"), pages, F.lit(f" pages. Generated {generated}.*\n\n---"))))
    moves = F.array_join(F.transform("argumentative_moves", lambda m, i: F.concat(F.lit("> "), (i + 1).cast("string"), F.lit(". "), m)), "\n")
    note = F.concat(
        F.lit("> [!abstract]- Spine\n> **Thesis:** "),
        F.coalesce("thesis", F.lit("")),
        F.when(F.col("fw").isNotNull(), F.concat(F.lit("\n>\n> **Frameworks:** "), "fw")).otherwise(F.lit("")),
        F.when(F.col("ex").isNotNull(), F.concat(F.lit("\n>\n> **Key examples:** "), "ex")).otherwise(F.lit("")),
        F.when(F.size("argumentative_moves") > 0, F.concat(F.lit("\n>\n> **Argument flow:**\n"), moves)).otherwise(F.lit("")),
        F.lit("\n\n"),
    )
    body = strip_own_heading(citations_to_links(F.coalesce("body_md", F.lit("")), F.col("book_slug")), F.col("chapter_title"))
    text = F.concat(F.lit("\n## "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.when(F.coalesce("has_spine", F.lit(False)), note).otherwise(F.lit("")), body)
    return head.unionByName(_told(chapters, items, bodies).select(*_row(F.col("section_pos"), zero, text)))


def epub_chapters(chapters: DataFrame, items: DataFrame, bodies: DataFrame) -> DataFrame:
    """(book_slug, section_pos, title, html): the condensed chapters as pages, with a subtitle where the title is a made one and the spine as a callout."""
    line = lambda label, c: F.concat(F.lit(f'<p><span class="spine-label">{label}:</span> '), c, F.lit("</p>\n"))
    own = F.coalesce("chapter_title", F.lit(""))
    subtitle = F.when(F.col("thesis").isNotNull() & (F.coalesce("title", F.lit("")) != own), F.concat(F.lit('<p class="chapter-subtitle">'), "thesis", F.lit("</p>\n"))).otherwise(F.lit(""))
    optional = [F.coalesce(line(label, F.col(c)), F.lit("")) for label, c in (("Frameworks", "fw"), ("Key examples", "ex"))]
    callout = F.concat(F.lit('<div class="spine-callout">\n'), line("Thesis", F.coalesce("thesis", F.lit(""))), *optional, F.lit("</div>\n"))
    html = F.concat(subtitle, F.when(F.coalesce("has_spine", F.lit(False)), callout).otherwise(F.lit("")), html_blocks(F.coalesce("body_md", F.lit(""))))
    return _told(chapters, items, bodies).select("book_slug", "section_pos", "title", html.alias("html"))


def output_manifest(books: DataFrame, bodies: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row a condensed book: its sizes, its ratio and whether it kept all that is critical."""
    by = bodies.groupBy("book_slug").agg(F.sum(F.coalesce("word_count", F.lit(0))).cast("bigint").alias("words"), F.count("*").alias("chapters"))
    x = books.join(by, "book_slug").join(verdicts.select("book_slug", "passed"), "book_slug", "left")
    ratio = F.round(F.col("words") / F.greatest(F.lit(1).cast("bigint"), F.coalesce("word_count", F.lit(0))), 6)
    return x.select("book_slug", "book_title", "book_author", F.col("page_count").alias("source_pages"), F.col("word_count").alias("source_words"), F.col("words").alias("distillation_words"), F.floor(F.col("words") / F.lit(275)).cast("bigint").alias("distillation_pages"), ratio.alias("compression_ratio"), "chapters", F.coalesce("passed", F.lit(True)).alias("coherence_pass"))
