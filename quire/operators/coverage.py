"""Whether what had to survive condensation is still there, and what to fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.text import match_form, strip_citations

#: Tokens of the text that a needle's tokens must meet within.
SPAN = 50
THRESHOLD = 0.75


def _tokens(form: Column) -> Column:
    return F.filter(F.split(form, " "), lambda t: t != "")


def near_tokens(tokens: Column, needle: Column, threshold: float = THRESHOLD, span: int = SPAN) -> Column:
    """Whether some ``span`` consecutive tokens of a text hold enough of the needle's, repeated ones each.

    The needle is in match form. Only places where one of its tokens stands
    are looked at: a window that holds enough may as well begin at one.
    """
    n = _tokens(needle)
    need = F.greatest(F.lit(1), (F.size(n).cast("double") * F.lit(float(threshold))).cast("int"))
    hits = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("at"), t.alias("t"))), lambda x: F.array_contains(n, x["t"]))

    def held(first: Column) -> Column:
        inside = F.transform(F.filter(hits, lambda x: (x["at"] >= first["at"]) & (x["at"] < first["at"] + span)), lambda x: x["t"])
        return F.size(F.filter(n, lambda w: F.array_contains(inside, w))) >= need

    return F.exists(hits, held)


def match_forms(text: Column) -> Column:
    """What needles are looked for in, made once a text: (low, form, tokens)."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.lower(t).alias("low"), match_form(t).alias("form"), _tokens(match_form(t)).alias("tokens"))


def match_tier(forms: Column, needle: Column, threshold: float = THRESHOLD) -> Column:
    """1: the needle stands in the text in any case; 2: without its punctuation; 3: enough of its tokens near each other; 0: not at all. A null needle is empty."""
    n = F.coalesce(needle, F.lit(""))
    nf = match_form(n)
    return F.when(F.contains(forms["low"], F.lower(n)), 1).when(F.contains(forms["form"], nf), 2).when(near_tokens(forms["tokens"], nf, threshold), 3).otherwise(0)


def tiers(items: DataFrame, bodies: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The items with ``tier``, how their chapter's text holds their name, and ``none``, whether there is no text; citations are no part of it.

    ``bodies`` has one row a chapter; each is brought into match form once.
    """
    clean = strip_citations(F.coalesce("body_md", F.lit("")))
    # written out once a body, not once an item that meets it
    forms = bodies.select("book_slug", "section_pos", clean.alias("c")).select("book_slug", "section_pos", (F.col("c") == "").alias("none"), match_forms(F.col("c")).alias("forms")).repartition("book_slug", "section_pos")
    x = items.join(forms, ["book_slug", "section_pos"], "left")
    empty = F.struct(F.lit("").alias("low"), F.lit("").alias("form"), F.array().cast("array<string>").alias("tokens"))
    return x.withColumn("forms", F.coalesce("forms", empty)).withColumn("tier", match_tier(F.col("forms"), F.col("name"), threshold)).withColumn("none", F.coalesce("none", F.lit(True))).drop("forms")


def severity(kind: Column, load_bearing: Column) -> Column:
    """What it means that an item is missing."""
    return F.when(kind == "framework", "critical").when((kind == "example") & F.coalesce(load_bearing, F.lit(True)), "critical").otherwise("minor")


def missing_items(items: DataFrame, bodies: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(book_slug, section_pos, item_type, item_pos, description, severity) of items that a chapter's text lost.

    A chapter without text loses its frameworks only, named without their
    detail. ``bodies`` has one row a chapter.
    """
    x = tiers(items, bodies, threshold)
    lost = F.when(F.col("none"), F.col("item_type") == "framework").otherwise(F.col("tier") == 0)
    name = F.coalesce("name", F.lit(""))
    text = F.when(F.col("none"), name).otherwise(F.concat(name, F.lit(": "), F.coalesce("detail", F.lit(""))))
    return x.filter(lost).select("book_slug", "section_pos", "item_type", "item_pos", text.alias("description"), severity(F.col("item_type"), F.col("is_load_bearing")).alias("severity"))


def verdicts(missing: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_slug, flags, critical, passed) of every book: it fails if anything critical is missing."""
    by = missing.groupBy("book_slug").agg(F.count("*").alias("flags"), F.count_if(F.col("severity") == "critical").alias("critical"))
    books = chapters.select("book_slug").distinct()
    return books.join(by, "book_slug", "left").na.fill(0, ["flags", "critical"]).withColumn("passed", F.col("critical") == 0)


def fix_plan(missing: DataFrame, rounds: int = 2) -> DataFrame:
    """(book_slug, section_pos, rank, fixes, instructions, planned): chapters with critical losses in order, the first ``rounds`` of each book planned."""
    w = Window.partitionBy("book_slug").orderBy("section_pos")
    line = F.concat(F.lit("Restore "), F.col("item_type"), F.lit(": "), F.col("description"))
    by = missing.filter("severity = 'critical'").groupBy("book_slug", "section_pos").agg(F.array_sort(F.collect_list(F.struct("item_type", "item_pos", line.alias("line")))).alias("a"))
    return by.withColumn("rank", F.row_number().over(w)).select("book_slug", "section_pos", "rank", F.size("a").alias("fixes"), F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("instructions"), (F.col("rank") <= rounds).alias("planned"))


def excerpt(text: Column, n: int = 200) -> tuple[Column, Column]:
    """The first and the last ``n`` words; dots mark a first part that goes on."""
    from quire.functions.text import words

    w = words(text)
    head = F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit("...")).otherwise(F.lit("")))
    return head, F.array_join(F.when(F.size(w) > n, F.slice(w, -n, n)).otherwise(w), " ")


def looks_truncated(text: Column, n_words: Column, target: Column, finish_reason: Column) -> Column:
    """The model ran out of tokens, or stopped short of the target without an end."""
    end = F.right(F.rtrim(F.coalesce(text, F.lit(""))), F.lit(1))
    return (F.coalesce(finish_reason, F.lit("")) == "MAX_TOKENS") | ((n_words < target.cast("double") * F.lit(0.85)) & ~end.isin(".", "!", "?", '"', "'", ")"))


def remaining_items(items: Column, text: Column) -> Column:
    """Of an array of names those that the text does not hold, in any case."""
    return F.filter(items, lambda i: ~F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(i)))
