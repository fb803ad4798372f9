"""Classification of sections and the length every one may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Share of a section's words to keep, by type (fixed values).
RATIOS = {"intro": 0.12, "body": 0.30, "conclusion": 0.12, "appendix": 0.70, "foreword": 0.10, "other": 0.20}
LEAST_TARGET = 100


def known_type(kind: Column) -> Column:
    """The type where it is one of the known ones, else ``body``."""
    return F.when(kind.isin(*RATIOS), kind).otherwise("body")


def ratio_of(kind: Column, default: float = 0.30) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in RATIOS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, kind), F.lit(default))


def type_by_title(title: Column) -> Column:
    """Rule that stands in for a model: what a title says of its section."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(t.rlike(r"\b(foreword|preface|acknowledg)"), "foreword")
        .when(t.rlike(r"\b(introduction|prologue)\b"), "intro")
        .when(t.rlike(r"\b(conclusion|epilogue|afterword)\b"), "conclusion")
        .when(t.rlike(r"\b(appendix|glossary|tables?)\b"), "appendix")
        .when(t.rlike(r"\b(index|bibliography|notes|contents|copyright)\b"), "other")
        .otherwise("body")
    )


def with_classes(sections: DataFrame, classes: DataFrame) -> DataFrame:
    """Sections with their class; without one they are ``body``. Of several classes of a section the last holds.

    ``classes`` has (book_slug, section_pos, section_type, seq).
    """
    w = Window.partitionBy("book_slug", "section_pos").orderBy(F.desc("seq"))
    last = classes.withColumn("k", F.row_number().over(w)).filter("k = 1").select("book_slug", "section_pos", F.col("section_type").alias("given"))
    joined = sections.drop("section_type", "compression_ratio").join(last, ["book_slug", "section_pos"], "left")
    return joined.withColumn("section_type", known_type(F.col("given"))).withColumn("ratio", ratio_of(F.col("section_type"))).drop("given")


def section_words(paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """(book_slug, section_pos, top_pos, own_words, tree_words): tree_words is that of the whole chapter, on its first row, else null."""
    own = paragraphs.groupBy("book_slug", "section_pos").agg(F.sum("n_words").alias("w"))
    x = sections.select("book_slug", "section_pos", "top_pos").join(own, ["book_slug", "section_pos"], "left").withColumn("own_words", F.coalesce("w", F.lit(0)).cast("bigint"))
    tree = x.groupBy("book_slug", "top_pos").agg(F.sum("own_words").alias("t")).select("book_slug", F.col("top_pos").alias("section_pos"), "t")
    return x.join(tree, ["book_slug", "section_pos"], "left").select("book_slug", "section_pos", "top_pos", "own_words", F.col("t").alias("tree_words"))


def targets(words: DataFrame, sections: DataFrame, scale: float = 1.0) -> DataFrame:
    """(book_slug, section_pos, words, ratio, target_words, pct) of every chapter.

    Products are doubles cut to whole words; ``scale`` shrinks or widens all
    ratios. pct is the target in whole percent of the source.
    """
    kind = sections.select("book_slug", "section_pos", ratio_of(known_type(F.col("section_type"))).alias("ratio"))
    x = words.filter("tree_words is not null").join(kind, ["book_slug", "section_pos"]).withColumn("words", F.col("tree_words"))
    target = F.greatest(F.lit(LEAST_TARGET).cast("bigint"), (F.col("words").cast("double") * F.col("ratio") * F.lit(float(scale))).cast("bigint"))
    y = x.withColumn("target_words", target)
    return y.select("book_slug", "section_pos", "words", "ratio", "target_words", (F.col("target_words") / F.greatest(F.lit(1).cast("bigint"), F.col("words")).cast("double") * F.lit(100.0)).cast("bigint").alias("pct"))


def effective_ratios(targets_: DataFrame, low: float = 0.15, high: float = 0.50, uniform: float = 0.30) -> DataFrame:
    """(book_slug, words, effective, degenerate, used): the ratio of a whole book, and the uniform one where it is out of bounds."""
    by = targets_.groupBy("book_slug").agg(F.sum("words").alias("words"), F.sum(F.col("ratio") * F.col("words")).alias("kept"))
    e = F.when(F.col("words") > 0, F.round(F.col("kept") / F.col("words"), 6)).otherwise(F.lit(0.0))
    return by.withColumn("effective", e).withColumn("degenerate", ~F.col("effective").between(low, high)).select("book_slug", "words", "effective", "degenerate", F.when(F.col("degenerate"), uniform).otherwise(F.col("effective")).alias("used"))


def evened(targets_: DataFrame, uniform: float) -> DataFrame:
    """Targets of books whose ratio as a whole is out of bounds by the uniform ratio, all others as they are."""
    bad = effective_ratios(targets_, uniform=uniform).filter("degenerate").select("book_slug", F.lit(True).alias("bad"))
    ratio = F.when(F.coalesce("bad", F.lit(False)), F.lit(float(uniform))).otherwise(F.col("ratio"))
    x = targets_.join(bad, "book_slug", "left").withColumn("ratio", ratio)
    target = F.greatest(F.lit(LEAST_TARGET).cast("bigint"), (F.col("words").cast("double") * F.col("ratio")).cast("bigint"))
    y = x.withColumn("target_words", F.when(F.coalesce("bad", F.lit(False)), target).otherwise(F.col("target_words")))
    return y.select("book_slug", "section_pos", "words", "ratio", "target_words", (F.col("target_words") / F.greatest(F.lit(1).cast("bigint"), F.col("words")).cast("double") * F.lit(100.0)).cast("bigint").alias("pct"))


def coverage_audit(sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(book_slug, declared, detected, paragraphs, tables, coverage_pct, passed): chapters that have text against those declared."""
    has = paragraphs.filter("n_words > 0").select("book_slug", "section_pos").distinct()
    tops = sections.join(has, ["book_slug", "section_pos"], "left_semi").select("book_slug", "top_pos").distinct().groupBy("book_slug").agg(F.count("*").alias("detected"))
    declared = sections.filter("parent_pos is null").groupBy("book_slug").agg(F.count("*").alias("declared"))
    paras = paragraphs.groupBy("book_slug").agg(F.count("*").alias("paragraphs"), F.count_if("is_table").alias("tables"))
    x = declared.join(tops, "book_slug", "left").join(paras, "book_slug", "left").na.fill(0, ["detected", "paragraphs", "tables"])
    pct = F.when(F.col("declared") == 0, F.when(F.col("detected") > 0, 100.0).otherwise(0.0)).otherwise(F.least(F.lit(100.0), F.round(F.col("detected") * 100.0 / F.col("declared"), 6)))
    return x.withColumn("coverage_pct", pct.cast("double")).withColumn("passed", F.col("coverage_pct") >= 100.0)
