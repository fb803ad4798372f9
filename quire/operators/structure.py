"""Reconstruction of chapters and sections from ordered lines and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.text import word_count, words

#: Number words of chapter headings (fixed value).
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
#: Headings that are one word (fixed value).
MATTER_WORDS = "introduction|preface|prologue|epilogue|conclusion|afterword"
CHAPTER = rf"(?i)^chapter\s+(\d+|{NUMBER_WORDS})(\s.*)?$"
MATTER = rf"(?i)^({MATTER_WORDS})$"
PLAIN_HEADING = rf"(?i)^\s*((chapter|part)\s+(\d+|{NUMBER_WORDS})[:.]?\s*.*|{MATTER_WORDS})$"
GENERIC_TITLE = r"^(Introduction|Body|Front Matter|Part \d+)\s*(\(Part \d+\))?$"


def is_chapter_heading(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(CHAPTER), F.lit(False))


def is_matter_heading(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(MATTER), F.lit(False))


def is_plain_heading(line: Column) -> Column:
    return F.coalesce(line.rlike(PLAIN_HEADING), F.lit(False))


def is_generic_title(title: Column) -> Column:
    return F.coalesce(title.rlike(GENERIC_TITLE), F.lit(False))


def is_real_title(title: Column) -> Column:
    """A title that is no artefact of splitting a file."""
    low = F.lower(F.regexp_replace(title, "[_-]", " "))
    return F.coalesce((F.length(title) > 3) & ~low.startswith("index split") & ~low.startswith("document outline"), F.lit(False))


def heading_level(title: Column, parsed: Column) -> Column:
    """Level by what a heading says: chapters, parts and three words that stand alone are 1, numbered ones as deep as their dots, others as parsed."""
    low = F.lower(F.trim(title))
    number = F.regexp_extract(title, r"(?i)^\s*(?:section\s+|sub\s+|appendix\s+)?(\d+(?:\.\d+)*)", 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    top = low.startswith("chapter ") | low.startswith("part ") | low.isin("introduction", "preface", "epilogue")
    return F.when(top, F.lit(1)).when(number != "", F.least(F.lit(6), dots + 1)).otherwise(parsed)


def item_role(label: Column, text: Column, in_section: Column) -> Column:
    """What a parser's item becomes: a section, a table, a footnote, a paragraph, or nothing."""
    return (
        F.when(label == "section_header", "section")
        .when((label == "title") & ~in_section, "section")
        .when(label == "table", "table")
        .when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(None).cast("string"))
        .when(label == "footnote", "footnote")
        .otherwise("paragraph")
    )


def parents(sections: DataFrame, max_level: int = 6) -> DataFrame:
    """Adds parent_pos and top_pos: for each section the last one before it on a higher level, and the root above it.

    One sort per book; the last position of each level is carried along, which
    is what a stack of open sections would hold.
    """
    w = Window.partitionBy("book_slug").orderBy("section_pos").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("section_pos")), ignorenulls=True).over(w) for k in range(1, max_level + 1)}
    nearest = F.greatest(F.lit(None).cast("int"), *[F.when(F.col("level") > k, last[k]) for k in last])
    here = Window.partitionBy("book_slug").orderBy("section_pos").rowsBetween(Window.unboundedPreceding, 0)
    with_parent = sections.withColumn("parent_pos", nearest)
    return with_parent.withColumn("top_pos", F.last(F.when(F.col("parent_pos").isNull(), F.col("section_pos")), ignorenulls=True).over(here))


def path_before(sections: DataFrame) -> DataFrame:
    """Adds path_before: the path that was open when a heading was met, ``Body`` at the start of a book."""
    w = Window.partitionBy("book_slug").orderBy("section_pos")
    return sections.withColumn("path_before", F.coalesce(F.lag("path").over(w), F.array(F.lit("Body"))))


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line, n_words) of every line; null texts have none."""
    return docs.select(key, F.posexplode(F.split(text, "\r\n|\n|\r")).alias("pos", "line")).withColumn("n_words", word_count(F.col("line")))


def assign_sections(lines: DataFrame, heading: Column, key: str = "doc_id", toc_words: int = 100, front_words: int = 20, short_words: int = 5) -> DataFrame:
    """Lines with the section they belong to.

    A heading with fewer than ``toc_words`` words before the next one is an
    entry of a table of contents and starts nothing. The first line of more
    than ``front_words`` words before any section starts the front matter.
    Lines of ``short_words`` words or fewer are decoration. Adds is_toc,
    section_start and title; lines before any section have nulls.
    """
    w = Window.partitionBy(key).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    x = lines.withColumn("is_heading", heading).withColumn("cum", F.sum("n_words").over(upto))
    x = x.withColumn("next_heading", F.first(F.when(F.col("is_heading"), F.col("cum") - F.col("n_words")), ignorenulls=True).over(after))
    x = x.withColumn("total", F.sum("n_words").over(Window.partitionBy(key)))
    between = F.coalesce("next_heading", "total") - F.col("cum")
    x = x.withColumn("is_toc", F.col("is_heading") & (between < toc_words))
    x = x.withColumn("real", F.col("is_heading") & ~F.col("is_toc"))
    x = x.withColumn("seen", F.count_if("real").over(upto))
    long = ~F.col("is_heading") & (F.col("seen") == 0) & (F.col("n_words") > front_words)
    x = x.withColumn("front", long & (F.count_if(long).over(upto) == 1))
    start = F.col("real") | F.col("front")
    x = x.withColumn("section_start", F.last(F.when(start, F.col("pos")), ignorenulls=True).over(upto))
    x = x.withColumn("title", F.last(F.when(F.col("front"), F.lit("Front Matter")).when(F.col("real"), F.trim("line")), ignorenulls=True).over(upto))
    body = (F.col("section_start").isNotNull() & ~F.col("is_heading") & ((F.col("n_words") > short_words) | F.col("front")))
    return x.withColumn("is_body", body).select(key, "pos", "line", "n_words", "is_heading", "is_toc", "section_start", "title", "is_body")


def greedy_parts(paragraphs: DataFrame, over: int = 8000, target: int = 5000, order: str = "para_pos") -> DataFrame:
    """Adds part: sections of more than ``over`` words in parts that close when they reach ``target`` words.

    A running sum that starts again cannot be a plain window; the word counts
    of a section, numbers alone, are folded in order and joined back by rank.
    """
    key = ["book_slug", "section_pos"]
    counts = paragraphs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("n_words")))).alias("a"), F.sum("n_words").alias("words"))
    start = F.struct(F.lit(1).alias("at"), F.lit(0).cast("bigint").alias("run"), F.array(F.lit(1)).alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        run, at = acc["run"] + x["n_words"], acc["at"] + 1
        return F.struct(at.alias("at"), F.when(run >= target, F.lit(0).cast("bigint")).otherwise(run).alias("run"), F.when(run >= target, F.concat(acc["starts"], F.array(at))).otherwise(acc["starts"]).alias("starts"))

    # only where parts begin is gathered; each part then takes its own stretch
    starts = F.when(F.col("words") > over, F.aggregate("a", start, step)["starts"]).otherwise(F.array(F.lit(1)))
    cut = counts.select(*key, "a", starts.alias("starts")).select(*key, "a", "starts", F.posexplode("starts").alias("i", "first"))
    stop = F.coalesce(F.get("starts", F.col("i") + 1), F.size("a") + 1)
    folded = cut.select(*key, (F.col("i") + 1).alias("part"), F.explode(F.slice("a", F.col("first"), stop - F.col("first"))).alias("x"))
    return paragraphs.join(folded.select(*key, F.col(f"x.{order}").alias(order), "part"), [*key, order])


def split_titles(parts: DataFrame, sections: DataFrame) -> DataFrame:
    """(book_slug, section_pos, part, title, section_id) of every part: the section's own where it is whole, else with its number behind."""
    from quire.functions.ids import section_id

    many = parts.groupBy("book_slug", "section_pos").agg(F.max("part").alias("parts"))
    x = sections.select("book_slug", "section_pos", F.col("title").alias("own")).join(many, ["book_slug", "section_pos"], "left").na.fill(1, ["parts"])
    x = x.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    title = F.when(F.col("parts") > 1, F.concat(F.coalesce("own", F.lit("")), F.lit(" (Part "), F.col("part").cast("string"), F.lit(")"))).otherwise(F.col("own"))
    x = x.withColumn("title", title)
    return x.select("book_slug", "section_pos", "part", "title", section_id(F.coalesce("title", F.lit("")), F.lit(1), F.array().cast("array<string>")).alias("section_id"))


def in_parts(sections: DataFrame, paragraphs: DataFrame, over: int = 8000, target: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(sections, paragraphs) with oversized sections as several ones, numbered anew in order; sections without subsections, as plain books have them."""
    parts = greedy_parts(paragraphs, over, target)
    named = split_titles(parts, sections)
    pos = (F.row_number().over(Window.partitionBy("book_slug").orderBy("section_pos", "part")) - 1).alias("new_pos")
    placed = named.select("book_slug", "section_pos", "part", "title", "section_id", pos)
    new = placed.select("book_slug", F.col("new_pos").alias("section_pos"), "section_id", "title", F.lit(1).alias("level"), F.lit(None).cast("int").alias("parent_pos"), F.col("new_pos").alias("top_pos"), F.array("title").alias("path"))
    moved = parts.join(placed.select("book_slug", "section_pos", "part", "new_pos"), ["book_slug", "section_pos", "part"]).drop("section_pos", "part").withColumnRenamed("new_pos", "section_pos")
    return new, moved.select(*paragraphs.columns)


def preview(paragraphs: DataFrame, sections: DataFrame, limit: int = 200) -> DataFrame:
    """(book_slug, section_pos, preview): the first words of a section's own text, then of that of its direct subsections."""
    own = sections.select("book_slug", "section_pos", F.col("section_pos").alias("of_pos"), F.lit(0).alias("depth"))
    below = sections.filter("parent_pos is not null").select("book_slug", "section_pos", F.col("parent_pos").alias("of_pos"), F.lit(1).alias("depth"))
    texts = own.unionByName(below).join(paragraphs.select("book_slug", "section_pos", "para_pos", "text", "n_words").filter("n_words > 0"), ["book_slug", "section_pos"])
    before = Window.partitionBy("book_slug", "of_pos").orderBy("depth", "section_pos", "para_pos").rowsBetween(Window.unboundedPreceding, -1)
    # only paragraphs that begin within the limit are gathered, so no more than so many
    first = texts.withColumn("before", F.coalesce(F.sum("n_words").over(before), F.lit(0))).filter(F.col("before") < limit)
    rows = first.groupBy("book_slug", "of_pos").agg(F.array_sort(F.collect_list(F.struct("depth", "section_pos", "para_pos", "text"))).alias("a"))
    joined = words(F.array_join(F.transform("a", lambda x: x["text"]), " "))
    return rows.select("book_slug", F.col("of_pos").alias("section_pos"), F.array_join(F.slice(joined, 1, limit), " ").alias("preview"))
