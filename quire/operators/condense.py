"""Selection of what must survive and condensation, by extraction.

The deterministic provider behind the provider interface: key terms by
frequency within a chapter against the corpus, the thesis as the first
sentence, and a condensed text of the best sentences in their order
(``best_sentences``) or of the first ones (``condensed``, as its SQL has it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.markdown import merge_overlap
from quire.functions.text import match_form, squeeze, word_count
from quire.operators.coverage import looks_truncated, remaining_items

#: Words shorter than this are no terms.
TERM_LETTERS = 5


def sentences(paragraphs: DataFrame) -> DataFrame:
    """(book_slug, section_pos, para_pos, sent, sentence, n_words)."""
    marked = F.regexp_replace(squeeze(F.col("text")), r"([.!?…][\"”’)]*) (?=[\p{Lu}“\"‘])", "$1\u0001")
    x = paragraphs.select("book_slug", "section_pos", "para_pos", F.posexplode(F.split(marked, "\u0001")).alias("sent", "sentence")).filter("sentence != ''")
    return x.withColumn("n_words", word_count(F.col("sentence")))


def key_terms(paragraphs: DataFrame, top: int = 5) -> DataFrame:
    """(book_slug, section_pos, rank, term, n): the terms of a chapter with the most weight, by count times rarity over chapters."""
    tok = paragraphs.select("book_slug", "section_pos", F.explode(F.split(match_form(F.col("text")), " ")).alias("term")).filter((F.length("term") >= TERM_LETTERS) & ~F.col("term").rlike(r"^\d"))
    tf = tok.groupBy("book_slug", "section_pos", "term").agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    chapters = paragraphs.select("book_slug", "section_pos").distinct().count()
    weighed = tf.join(df, "term").withColumn("weight", F.round(F.col("n") * F.log(F.lit(chapters + 1.0) / F.col("df")), 6))
    w = Window.partitionBy("book_slug", "section_pos").orderBy(F.desc("weight"), "term")
    return weighed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("book_slug", "section_pos", "rank", "term", "n")


def thesis(sents: DataFrame) -> DataFrame:
    """(book_slug, section_pos, thesis, voice): the first and the last sentence of a chapter."""
    at = F.struct("para_pos", "sent")
    return sents.groupBy("book_slug", "section_pos").agg(F.min_by("sentence", at).alias("thesis"), F.max_by("sentence", at).alias("voice"))


def condensed(sents: DataFrame, targets: DataFrame) -> DataFrame:
    """(book_slug, section_pos, body_md, word_count): sentences in order until the target is reached.

    A sentence is taken if the ones before it have not filled the target yet.
    """
    w = Window.partitionBy("book_slug", "section_pos").orderBy("para_pos", "sent").rowsBetween(Window.unboundedPreceding, -1)
    x = sents.join(targets.select("book_slug", "section_pos", "target_words"), ["book_slug", "section_pos"]).withColumn("before", F.coalesce(F.sum("n_words").over(w), F.lit(0)))
    kept = x.filter(F.col("before") < F.col("target_words"))
    by = kept.groupBy("book_slug", "section_pos").agg(F.array_sort(F.collect_list(F.struct("para_pos", "sent", "sentence"))).alias("a"), F.sum("n_words").alias("word_count"))
    return by.select("book_slug", "section_pos", F.array_join(F.transform("a", lambda s: s["sentence"]), " ").alias("body_md"), "word_count")


def best_sentences(sents: DataFrame, targets: DataFrame, items: DataFrame) -> DataFrame:
    """(book_slug, section_pos, body_md, word_count): the best sentences of all of a chapter, in their order.

    First come the chapter's first sentence and the one that names each item
    (``items`` has book_slug, section_pos and name) first, then those that
    name the most items, the earlier ones before. A sentence is taken if the
    better ones have not filled the target yet.
    """
    key, at = ["book_slug", "section_pos"], ["para_pos", "sent"]
    padded = lambda c: F.concat(F.lit(" "), match_form(c), F.lit(" "))
    names = items.filter(match_form(F.col("name")) != "").groupBy(*key).agg(F.collect_set(padded(F.col("name"))).alias("names"))
    x = sents.join(targets.select(*key, "target_words"), key).join(names, key, "left").withColumn("form", padded(F.col("sentence")))
    x = x.withColumn("hits", F.coalesce(F.filter("names", lambda n: F.contains(F.col("form"), n)), F.array().cast("array<string>"))).drop("names", "form")
    w = Window.partitionBy(*key).orderBy(*at)
    earlier = F.flatten(F.collect_set("hits").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("new", F.size(F.array_except("hits", earlier)) > 0).withColumn("first", F.row_number().over(w) == 1)
    best = Window.partitionBy(*key).orderBy(F.desc("first"), F.desc("new"), F.desc(F.size("hits")), *at).rowsBetween(Window.unboundedPreceding, -1)
    kept = x.withColumn("before", F.coalesce(F.sum("n_words").over(best), F.lit(0))).filter(F.col("before") < F.col("target_words"))
    by = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*at, "sentence"))).alias("a"), F.sum("n_words").alias("word_count"))
    return by.select(*key, F.array_join(F.transform("a", lambda s: s["sentence"]), " ").alias("body_md"), "word_count")


Answer = Callable[[list[dict]], list[str]]


class Provider:
    """Gives an answer to every prompt. ``answer`` gets a list of request rows and is run in the executors."""

    def __init__(self, name: str, answer: Answer):
        self.name, self.answer = name, answer

    def ask(self, requests: DataFrame, key: list[str]) -> DataFrame:
        """(key..., response struct<text, tokens_in, tokens_out, finish_reason>) of requests with a prompt column."""
        kinds = ", ".join(f"`{k}` {requests.schema[k].dataType.simpleString()}" for k in key)
        answer = self.answer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = answer(b.to_pylist())
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in key], b.column("prompt"), pa.array(texts, pa.string())], names=[*key, "prompt", "text"])

        tokens = lambda c: F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(c) / F.lit(4)))
        out = requests.mapInArrow(run, f"{kinds}, prompt string, text string")
        return out.select(*key, F.struct("text", tokens("prompt").alias("tokens_in"), tokens("text").alias("tokens_out"), F.lit("STOP").alias("finish_reason")).alias("response"))


def _first_words(rows: list[dict]) -> list[str]:
    return [" ".join((r["prompt"] or "").split()[: r.get("max_words") or 100]) for r in rows]


#: Providers by name: one that repeats the prompt's first words, one that gives a fixed answer.
PROVIDERS = {"extractive": Provider("extractive", _first_words), "stub": Provider("stub", lambda rows: ["stub"] * len(rows))}


def route(role: str, routes: dict[str, str]) -> Provider:
    """The provider of a role; KeyError for a role or provider that is unknown."""
    return PROVIDERS[routes[role]]


def prompts(chapters: DataFrame, template: str) -> Column:
    """The template with ``{column}`` replaced; a column the frame lacks is an error."""
    import string

    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name:
            parts.append(F.coalesce(chapters[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def continue_until_done(drafts: DataFrame, ask: Callable[[DataFrame], DataFrame], key: list[str], rounds: int = 5, least_gain: int = 50) -> DataFrame:
    """Drafts continued while they look truncated, ``rounds`` times at most.

    ``drafts`` has the key, body_md, target_words, finish_reason and items;
    ``ask`` gives (key, more, finish_reason) for unfinished ones. A round that
    adds fewer than ``least_gain`` words is a chapter's last.
    """
    from quire.session import materialize

    cur = drafts.withColumn("rounds", F.lit(1)).withColumn("open", looks_truncated(F.col("body_md"), word_count(F.col("body_md")), F.col("target_words"), F.col("finish_reason")))
    for k in range(1, rounds):
        cur = materialize(cur, f"draft{k}")
        todo = cur.filter("open").withColumn("missing", remaining_items(F.col("items"), F.col("body_md")))
        if todo.isEmpty():
            break
        more = ask(todo).select(*key, "more", F.col("finish_reason").alias("new_reason"))
        merged = merge_overlap(F.col("body_md"), F.col("more"))
        x = cur.join(more, key, "left").withColumn("merged", F.when(F.col("open"), F.coalesce(merged, F.col("body_md"))).otherwise(F.col("body_md")))
        gain = word_count(F.col("merged")) - word_count(F.col("body_md"))
        still = F.col("open") & (gain >= least_gain) & looks_truncated(F.col("merged"), word_count(F.col("merged")), F.col("target_words"), F.col("new_reason"))
        cur = x.select(*key, F.col("merged").alias("body_md"), "target_words", F.coalesce("new_reason", "finish_reason").alias("finish_reason"), "items", F.when(F.col("open"), F.col("rounds") + 1).otherwise(F.col("rounds")).alias("rounds"), still.alias("open"))
    return cur.drop("open")
