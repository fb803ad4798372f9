"""All queries of the engine over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions import ids, markdown as md, text as tx
from quire.operators import budget, condense, coverage, ledger, render, structure
from quire.sources import parsed, plain
from quire.streaming import streams
from quire.tables import latest, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Tables with the row that holds for each key.


def paragraphs(s: SparkSession, d: str) -> DataFrame:
    # words are counted before rows move, so that plans that need no text carry none
    p = table(s, d, "paragraphs").withColumn("n_words", tx.word_count(F.col("text"))).withColumn("is_table", F.coalesce("is_table", F.lit(False)))
    return latest(p, ["record_id"], "ingested_at")


def sections(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sections").dropDuplicates(["book_slug", "section_pos"])


def chapters(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "spine_chapters").dropDuplicates(["book_slug", "section_pos"])


def items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "spine_items").dropDuplicates(["book_slug", "section_pos", "item_type", "item_pos"])


def books(s: SparkSession, d: str) -> DataFrame:
    return latest(table(s, d, "books"), ["book_slug"], "extracted_at")


def bodies(s: SparkSession, d: str) -> DataFrame:
    """One condensed text a chapter: of several records the one with the greatest id."""
    held = latest(table(s, d, "distilled"), ["record_id"], "written_at")
    return latest(held, ["book_slug", "section_pos"], "record_id")


def calls(s: SparkSession, d: str) -> DataFrame:
    return ledger.calls(table(s, d, "llm_calls"))


_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _words(x: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({x}, ''), '{_WS}'), lambda w: w <> ''))"


def _list(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{_WS}'), lambda w: w <> '')"


_P = f"p AS (SELECT * EXCLUDE (n_words, is_table, rn), {_words('text')}::INT AS n_words, coalesce(is_table, false) AS is_table FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM paragraphs) WHERE rn = 1)"
_S = "s AS (SELECT DISTINCT * FROM sections)"
_C = "c AS (SELECT DISTINCT * FROM spine_chapters)"
_I = "i AS (SELECT DISTINCT * FROM spine_items)"
_B = "b AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY book_slug ORDER BY extracted_at DESC NULLS LAST) AS rn FROM books) WHERE rn = 1)"
_D = "d0 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY written_at DESC NULLS LAST) AS rn FROM distilled) WHERE rn = 1), d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY book_slug, section_pos ORDER BY record_id DESC) AS rn FROM d0) WHERE rn = 1)"
_L = "l AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY call_id) AS rn FROM llm_calls) WHERE rn = 1)"
_TREE = f"{_P}, {_S}, own AS (SELECT s.book_slug, s.section_pos, s.top_pos, coalesce(sum(p.n_words), 0)::BIGINT AS own_words FROM s LEFT JOIN p USING (book_slug, section_pos) GROUP BY ALL), tree AS (SELECT book_slug, top_pos AS section_pos, sum(own_words)::BIGINT AS words FROM own GROUP BY ALL)"
_RATIO = "CASE section_type WHEN 'intro' THEN 0.12::DOUBLE WHEN 'conclusion' THEN 0.12::DOUBLE WHEN 'appendix' THEN 0.70::DOUBLE WHEN 'foreword' THEN 0.10::DOUBLE WHEN 'other' THEN 0.20::DOUBLE ELSE 0.30::DOUBLE END"
_TARGETS = f"{_TREE}, t AS (SELECT book_slug, section_pos, words, ratio, greatest(100, trunc(words::DOUBLE * ratio)::BIGINT) AS target_words FROM (SELECT tree.book_slug, tree.section_pos, words, {_RATIO} AS ratio FROM tree JOIN s ON s.book_slug = tree.book_slug AND s.section_pos = tree.section_pos))"

# Aggregations and budgets.


@query(f"WITH {_TREE} SELECT own.book_slug, own.section_pos, own.top_pos, own_words, words AS tree_words FROM own LEFT JOIN tree ON own.book_slug = tree.book_slug AND own.section_pos = tree.section_pos")
def ag01_section_words(s: SparkSession, d: str) -> DataFrame:
    return budget.section_words(paragraphs(s, d), sections(s, d))


@query(f"WITH {_P} SELECT book_slug, sum(n_words)::BIGINT AS words, count(*) AS paragraphs, count(*) FILTER (is_table) AS tables, count(DISTINCT section_pos) AS sections FROM p GROUP BY book_slug")
def ag02_book_counts(s: SparkSession, d: str) -> DataFrame:
    return paragraphs(s, d).groupBy("book_slug").agg(F.sum("n_words").alias("words"), F.count("*").alias("paragraphs"), F.count_if("is_table").alias("tables"), F.countDistinct("section_pos").alias("sections"))


@query(
    f"WITH {_P}, {_S}, has AS (SELECT DISTINCT book_slug, section_pos FROM p WHERE n_words > 0), tops AS (SELECT book_slug, count(DISTINCT top_pos) AS detected FROM s JOIN has USING (book_slug, section_pos) GROUP BY 1), decl AS (SELECT book_slug, count(*) AS declared FROM s WHERE parent_pos IS NULL GROUP BY 1), q AS (SELECT book_slug, count(*) AS paragraphs, count(*) FILTER (is_table) AS tables FROM p GROUP BY 1) "
    "SELECT book_slug, declared, coalesce(detected, 0) AS detected, coalesce(paragraphs, 0) AS paragraphs, coalesce(tables, 0) AS tables, least(100.0, round(coalesce(detected, 0) * 100.0::DOUBLE / declared, 6))::DOUBLE AS coverage_pct, least(100.0, round(coalesce(detected, 0) * 100.0::DOUBLE / declared, 6)) >= 100 AS passed FROM decl LEFT JOIN tops USING (book_slug) LEFT JOIN q USING (book_slug)"
)
def ag03_coverage_audit(s: SparkSession, d: str) -> DataFrame:
    return budget.coverage_audit(sections(s, d), paragraphs(s, d))


def _targets(s: SparkSession, d: str) -> DataFrame:
    sec = sections(s, d)
    return budget.targets(budget.section_words(paragraphs(s, d), sec), sec)


@query(
    f"WITH {_TARGETS}, e AS (SELECT book_slug, sum(words)::BIGINT AS words, CASE WHEN sum(words) > 0 THEN round(sum(ratio * words) / sum(words), 6) ELSE 0.0 END::DOUBLE AS effective FROM t GROUP BY 1) SELECT book_slug, words, effective, NOT (effective BETWEEN 0.15 AND 0.5) AS degenerate, CASE WHEN effective BETWEEN 0.15 AND 0.5 THEN effective ELSE 0.3 END::DOUBLE AS used FROM e"
)
def ag04_effective_ratio(s: SparkSession, d: str) -> DataFrame:
    return budget.effective_ratios(_targets(s, d))


@query(f"WITH {_TARGETS} SELECT book_slug, section_pos, words, ratio, target_words, trunc(target_words / greatest(1, words)::DOUBLE * 100.0)::BIGINT AS pct FROM t")
def ag06_target_words(s: SparkSession, d: str) -> DataFrame:
    return _targets(s, d)


@query(f"WITH {_C}, {_I}, n AS (SELECT book_slug, count(*) FILTER (item_type = 'framework') AS frameworks, count(*) FILTER (item_type = 'example') AS examples, count(*) FILTER (item_type = 'key_term') AS terms FROM i GROUP BY 1) SELECT book_slug, count(*) AS chapters, sum(coalesce(source_word_count, 0))::BIGINT AS source_words, sum(coalesce(target_word_count, 0))::BIGINT AS target_words, sum(len(argumentative_moves))::BIGINT AS moves, coalesce(max(frameworks), 0) AS frameworks, coalesce(max(examples), 0) AS examples, coalesce(max(terms), 0) AS terms FROM c LEFT JOIN n USING (book_slug) GROUP BY book_slug")
def ag08_spine_totals(s: SparkSession, d: str) -> DataFrame:
    n = items(s, d).groupBy("book_slug").agg(*[F.count_if(F.col("item_type") == k).alias(a) for k, a in (("framework", "frameworks"), ("example", "examples"), ("key_term", "terms"))])
    c = chapters(s, d).groupBy("book_slug").agg(F.count("*").alias("chapters"), F.sum(F.coalesce("source_word_count", F.lit(0))).alias("source_words"), F.sum(F.coalesce("target_word_count", F.lit(0))).alias("target_words"), F.sum(F.size("argumentative_moves")).alias("moves"))
    return c.join(n, "book_slug", "left").na.fill(0, ["frameworks", "examples", "terms"])


@query(f"WITH {_D} SELECT book_slug, count(*) AS chapters, sum({_words('body_md')})::BIGINT AS words, sum(coalesce(continuation_rounds, 1))::BIGINT AS rounds FROM d GROUP BY 1")
def ag09_distill_totals(s: SparkSession, d: str) -> DataFrame:
    return bodies(s, d).groupBy("book_slug").agg(F.count("*").alias("chapters"), F.sum(tx.word_count(F.col("body_md"))).alias("words"), F.sum(F.coalesce("continuation_rounds", F.lit(1))).alias("rounds"))


@query(f"WITH {_L} SELECT round(coalesce(sum(usd), 0.0), 6)::DOUBLE AS usd, coalesce(sum(tokens_in), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out, count(*) AS calls FROM l")
def ag12_ledger_totals(s: SparkSession, d: str) -> DataFrame:
    return ledger.totals(calls(s, d))


@query(f"WITH {_L} SELECT stage, round(sum(usd), 6) AS usd, count(*) AS calls FROM l GROUP BY stage")
def ag13_ledger_by_stage(s: SparkSession, d: str) -> DataFrame:
    return ledger.by(calls(s, d), "stage")


@query(f"WITH {_L} SELECT model_role, round(sum(usd), 6) AS usd, count(*) AS calls FROM l GROUP BY model_role")
def ag14_ledger_by_role(s: SparkSession, d: str) -> DataFrame:
    return ledger.by(calls(s, d), "model_role")


@query(f"WITH {_L} SELECT stage, model_role, round(sum(usd), 6) AS usd, count(*) AS calls, grouping(stage, model_role)::BIGINT AS level FROM l GROUP BY ROLLUP (stage, model_role)")
def ag15_ledger_rollup(s: SparkSession, d: str) -> DataFrame:
    return ledger.rollup(calls(s, d))


@query(f"WITH {_L} SELECT stage, call_id, created_at, usd, round(coalesce(sum(usd) OVER (PARTITION BY stage ORDER BY created_at, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6)::DOUBLE AS spent_before FROM l")
def lm02_running_spend(s: SparkSession, d: str) -> DataFrame:
    return ledger.running(calls(s, d))


@query(f"WITH {_L} SELECT DISTINCT call_id, unnest(json_extract_string(chunk_uuids, '$[*]')) AS paragraph_id FROM l WHERE chunk_uuids IS NOT NULL")
def src17_ledger_chunks(s: SparkSession, d: str) -> DataFrame:
    return ledger.chunk_links(calls(s, d))


# Predicates.

_NUM = structure.NUMBER_WORDS
#: A line that is a heading, in SQL's own pattern language.
_HEADING = f"(?i)^\\s*((chapter|part)\\s+(\\d+|{_NUM})[:.]?\\s*.*|introduction|preface|prologue|epilogue|conclusion|afterword)$"


@query(
    f"WITH {_S} SELECT book_slug, section_pos, coalesce(regexp_matches(trim(title), '(?i)^chapter\\s+(\\d+|{_NUM})(\\s.*)?$'), false) AS chapter, coalesce(regexp_matches(trim(title), '(?i)^(introduction|preface|prologue|epilogue|conclusion|afterword)$'), false) AS matter, coalesce(regexp_matches(title, '{_HEADING}'), false) AS plain, coalesce(regexp_matches(title, '^(Introduction|Body|Front Matter|Part \\d+)\\s*(\\(Part \\d+\\))?$'), false) AS generic_title FROM s"
)
def pf01_heading_predicates(s: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return sections(s, d).select("book_slug", "section_pos", structure.is_chapter_heading(t).alias("chapter"), structure.is_matter_heading(t).alias("matter"), structure.is_plain_heading(t).alias("plain"), structure.is_generic_title(t).alias("generic_title"))


@query(
    f"WITH {_S}, n AS (SELECT *, lower(trim(title)) AS low, regexp_extract(title, '(?i)^\\s*(?:section\\s+|sub\\s+|appendix\\s+)?(\\d+(?:\\.\\d+)*)', 1) AS number FROM s) "
    "SELECT book_slug, section_pos, CASE WHEN starts_with(low, 'chapter ') OR starts_with(low, 'part ') OR low IN ('introduction', 'preface', 'epilogue') THEN 1 WHEN number <> '' THEN least(6, len(string_split(number, '.'))) ELSE level END::INT AS level FROM n"
)
def pf04_heading_levels(s: SparkSession, d: str) -> DataFrame:
    return sections(s, d).select("book_slug", "section_pos", structure.heading_level(F.col("title"), F.col("level")).alias("level"))


@query(f"WITH {_P} SELECT book_slug, count(*) FILTER (length(text) > 10) AS long_enough, count(*) FILTER (n_words > 5) AS over_5, count(*) FILTER (n_words > 20) AS over_20 FROM p GROUP BY 1")
def pf06_text_filters(s: SparkSession, d: str) -> DataFrame:
    return paragraphs(s, d).groupBy("book_slug").agg(F.count_if(F.length("text") > 10).alias("long_enough"), F.count_if(F.col("n_words") > 5).alias("over_5"), F.count_if(F.col("n_words") > 20).alias("over_20"))


@query(f"WITH {_TREE} SELECT book_slug, section_pos, words FROM tree WHERE words < 50")
def pf07_short_sections(s: SparkSession, d: str) -> DataFrame:
    return budget.section_words(paragraphs(s, d), sections(s, d)).filter("tree_words < 50").select("book_slug", "section_pos", F.col("tree_words").alias("words"))


@query(f"WITH {_S} SELECT book_slug, bool_or(coalesce(length(title) > 3 AND NOT starts_with(lower(translate(title, '_-', '  ')), 'index split') AND NOT starts_with(lower(translate(title, '_-', '  ')), 'document outline'), false)) AS has_real_titles FROM s GROUP BY 1")
def pf08_real_titles(s: SparkSession, d: str) -> DataFrame:
    return sections(s, d).groupBy("book_slug").agg(F.bool_or(structure.is_real_title(F.col("title"))).alias("has_real_titles"))


@query(f"WITH {_S} SELECT book_slug, section_pos, CASE WHEN section_type IN ('intro', 'body', 'conclusion', 'appendix', 'foreword', 'other') THEN section_type ELSE 'body' END AS section_type, {_RATIO} AS ratio FROM s")
def pf09_section_types(s: SparkSession, d: str) -> DataFrame:
    return sections(s, d).select("book_slug", "section_pos", budget.known_type(F.col("section_type")).alias("section_type"), budget.ratio_of(budget.known_type(F.col("section_type"))).alias("ratio"))


@query(f"WITH {_D}, {_C} SELECT d.book_slug, d.section_pos, ({_words('body_md')} < target_word_count::DOUBLE * 0.85::DOUBLE AND right(rtrim(coalesce(body_md, '')), 1) NOT IN ('.', '!', '?', '\"', '''', ')')) AS truncated FROM d JOIN c ON d.book_slug = c.book_slug AND d.section_pos = c.section_pos WHERE target_word_count IS NOT NULL")
def pf10_truncation_rule(s: SparkSession, d: str) -> DataFrame:
    x = bodies(s, d).join(chapters(s, d).select("book_slug", "section_pos", "target_word_count"), ["book_slug", "section_pos"]).filter("target_word_count is not null")
    return x.select("book_slug", "section_pos", coverage.looks_truncated(F.col("body_md"), tx.word_count(F.col("body_md")), F.col("target_word_count"), F.lit(None).cast("string")).alias("truncated"))


# Joins.


@query(f"WITH {_S}, k AS (SELECT book_slug, section_pos, CASE WHEN regexp_matches(lower(title), '\\b(foreword|preface|acknowledg)') THEN 'foreword' WHEN regexp_matches(lower(title), '\\b(introduction|prologue)\\b') THEN 'intro' WHEN regexp_matches(lower(title), '\\b(conclusion|epilogue|afterword)\\b') THEN 'conclusion' WHEN regexp_matches(lower(title), '\\b(appendix|glossary|tables?)\\b') THEN 'appendix' WHEN regexp_matches(lower(title), '\\b(index|bibliography|notes|contents|copyright)\\b') THEN 'other' ELSE 'body' END AS section_type FROM s) SELECT book_slug, section_pos, section_type, {_RATIO} AS ratio FROM k")
def j01_classified_sections(s: SparkSession, d: str) -> DataFrame:
    """The rule's classes, delivered twice and with one section missing, joined to the sections."""
    sec = sections(s, d)
    by_rule = sec.select("book_slug", "section_pos", budget.type_by_title(F.col("title")).alias("section_type"))
    twice = by_rule.withColumn("section_type", F.lit("other")).withColumn("seq", F.lit(1)).unionByName(by_rule.withColumn("seq", F.lit(2)))
    return budget.with_classes(sec, twice).select("book_slug", "section_pos", "section_type", "ratio")


@query(f"WITH {_S}, {_C} SELECT s.book_slug, s.section_pos, s.title, c.thesis FROM s JOIN c USING (book_slug, section_pos)")
def j05_sections_with_spine(s: SparkSession, d: str) -> DataFrame:
    return sections(s, d).join(chapters(s, d), ["book_slug", "section_pos"]).select("book_slug", "section_pos", "title", "thesis")


@query(f"WITH {_S}, {_C} SELECT s.book_slug, s.section_pos, s.title FROM s ANTI JOIN c ON s.book_slug = c.book_slug AND s.section_pos = c.section_pos")
def j05_sections_without_spine(s: SparkSession, d: str) -> DataFrame:
    return sections(s, d).join(chapters(s, d), ["book_slug", "section_pos"], "left_anti").select("book_slug", "section_pos", "title")


@query(f"WITH {_C}, {_D} SELECT c.book_slug, c.section_pos, coalesce(d.body_md, '') AS body_md FROM c LEFT JOIN d ON c.book_slug = d.book_slug AND c.section_pos = d.section_pos")
def j06_spine_with_bodies(s: SparkSession, d: str) -> DataFrame:
    return chapters(s, d).join(bodies(s, d).select("book_slug", "section_pos", "body_md"), ["book_slug", "section_pos"], "left").select("book_slug", "section_pos", F.coalesce("body_md", F.lit("")).alias("body_md"))


@query(f"WITH {_S} SELECT s.book_slug, s.section_pos, s.title FROM s WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.book_slug = s.book_slug AND x.parent_pos = s.section_pos)")
def so01_leaf_sections(s: SparkSession, d: str) -> DataFrame:
    sec = sections(s, d)
    return sec.join(sec.select("book_slug", F.col("parent_pos").alias("section_pos")).filter("section_pos is not null").distinct(), ["book_slug", "section_pos"], "left_anti").select("book_slug", "section_pos", "title")


# Order.


@query(f"WITH {_S} SELECT s.book_slug, s.section_pos, max(h.section_pos) AS parent_pos FROM s LEFT JOIN s h ON h.book_slug = s.book_slug AND h.section_pos < s.section_pos AND h.level < s.level AND NOT EXISTS (SELECT 1 FROM s m WHERE m.book_slug = s.book_slug AND m.section_pos > h.section_pos AND m.section_pos < s.section_pos AND m.level <= h.level) GROUP BY ALL")
def w01_parents(s: SparkSession, d: str) -> DataFrame:
    return structure.parents(sections(s, d).select("book_slug", "section_pos", "level")).select("book_slug", "section_pos", "parent_pos")


@query(f"WITH {_S} SELECT book_slug, section_pos, coalesce(lag(array_to_string(path, '/')) OVER (PARTITION BY book_slug ORDER BY section_pos), 'Body') AS path_before FROM s")
def w02_path_before(s: SparkSession, d: str) -> DataFrame:
    return structure.path_before(sections(s, d)).select("book_slug", "section_pos", F.array_join("path_before", "/").alias("path_before"))


_LINES = (
    f"x AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS a FROM documents WHERE text IS NOT NULL)), y AS (SELECT *, {_words('line')} AS n, regexp_matches(line, '{_HEADING}') OR regexp_matches(line, '^#+\\s') AS h FROM x), "
    "z AS (SELECT *, sum(n) OVER w AS cum, sum(n) OVER (PARTITION BY doc_id) AS total FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
    "q AS (SELECT *, h AND coalesce(first_value(CASE WHEN h THEN cum - n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), total) - cum < 100 AS toc FROM z), "
    "r AS (SELECT *, sum((h AND NOT toc)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS seen FROM q), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, NOT h AND seen = 0 AND n > 20 ORDER BY pos) = 1 AND NOT h AND seen = 0 AND n > 20 AS front FROM r), "
    "g AS (SELECT *, last_value(CASE WHEN front OR (h AND NOT toc) THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section_start, last_value(CASE WHEN front THEN 'Front Matter' WHEN h AND NOT toc THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS title FROM f)"
)


@query(f"WITH {_LINES} SELECT doc_id, section_start::INT AS section_start, title, count(*) AS lines, sum(n)::BIGINT AS words FROM g WHERE section_start IS NOT NULL AND NOT h AND (n > 5 OR front) GROUP BY ALL")
def w03_lines_to_sections(s: SparkSession, d: str) -> DataFrame:
    """Carry-forward of the last heading, table-of-contents entries and front matter found on the way."""
    lines = structure.lines_of(table(s, d, "documents"))
    heading = structure.is_plain_heading(F.col("line")) | F.col("line").rlike(r"^#+\s")
    x = structure.assign_sections(lines, heading)
    return x.filter("is_body").groupBy("doc_id", "section_start", "title").agg(F.count("*").alias("lines"), F.sum("n_words").alias("words"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) FILTER (h) AS headings, count(*) FILTER (toc) AS toc_entries FROM g GROUP BY 1")
def w05_toc_entries(s: SparkSession, d: str) -> DataFrame:
    heading = structure.is_plain_heading(F.col("line")) | F.col("line").rlike(r"^#+\s")
    return structure.assign_sections(structure.lines_of(table(s, d, "documents")), heading).groupBy("doc_id").agg(F.count_if("is_heading").alias("headings"), F.count_if("is_toc").alias("toc_entries"))


@query(
    f"WITH RECURSIVE {_P}, r AS (SELECT book_slug, section_pos, para_pos, n_words, row_number() OVER (PARTITION BY book_slug, section_pos ORDER BY para_pos) AS k, sum(n_words) OVER (PARTITION BY book_slug, section_pos) AS total FROM p), f AS (SELECT book_slug, section_pos, para_pos, k, 1 AS part, CASE WHEN n_words >= 500 THEN 0 ELSE n_words END AS run, CASE WHEN n_words >= 500 THEN 2 ELSE 1 END AS nxt FROM r WHERE k = 1 AND total > 800 "
    "UNION ALL SELECT r.book_slug, r.section_pos, r.para_pos, r.k, f.nxt, CASE WHEN f.run + r.n_words >= 500 THEN 0 ELSE f.run + r.n_words END, CASE WHEN f.run + r.n_words >= 500 THEN f.nxt + 1 ELSE f.nxt END FROM f JOIN r ON r.book_slug = f.book_slug AND r.section_pos = f.section_pos AND r.k = f.k + 1), a AS (SELECT book_slug, section_pos, para_pos, part FROM f UNION ALL SELECT book_slug, section_pos, para_pos, 1 FROM r WHERE total <= 800) "
    "SELECT book_slug, section_pos, part::INT AS part, count(*) AS paragraphs, min(para_pos) AS first_para FROM a GROUP BY ALL"
)
def w07_greedy_parts(s: SparkSession, d: str) -> DataFrame:
    """Parts of 500 words of sections over 800, limits that these books reach."""
    x = structure.greedy_parts(paragraphs(s, d).select("book_slug", "section_pos", "para_pos", "n_words"), over=800, target=500)
    return x.groupBy("book_slug", "section_pos", "part").agg(F.count("*").alias("paragraphs"), F.min("para_pos").alias("first_para"))


@query(
    f"WITH {_P}, {_S}, m AS (SELECT book_slug, section_pos AS sp, section_pos AS of_pos, 0 AS depth FROM s UNION ALL SELECT book_slug, section_pos, parent_pos, 1 FROM s WHERE parent_pos IS NOT NULL), j AS (SELECT m.book_slug, of_pos, depth, sp, para_pos, text FROM m JOIN p ON p.book_slug = m.book_slug AND p.section_pos = m.sp WHERE n_words > 0), g AS (SELECT book_slug, of_pos, string_agg(text, ' ' ORDER BY depth, sp, para_pos) AS t FROM j GROUP BY ALL) "
    f"SELECT book_slug, of_pos AS section_pos, array_to_string(({_list('t')})[1:200], ' ') AS preview FROM g"
)
def w08_previews(s: SparkSession, d: str) -> DataFrame:
    return structure.preview(paragraphs(s, d), sections(s, d))


@query(f"WITH {_C} SELECT book_slug, section_pos, (row_number() OVER (PARTITION BY book_slug ORDER BY section_pos))::INT AS idx, chapter_title FROM c")
def w10_chapter_numbers(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return chapters(s, d).select("book_slug", "section_pos", F.row_number().over(Window.partitionBy("book_slug").orderBy("section_pos")).alias("idx"), "chapter_title")


@query(f"WITH {_P}, r AS (SELECT book_slug, section_pos, para_pos, is_table, (row_number() OVER (PARTITION BY book_slug, section_pos ORDER BY para_pos) - 1)::INT AS ordinal FROM p) SELECT book_slug, section_pos, para_pos, ordinal FROM r WHERE is_table")
def w12_table_ordinals(s: SparkSession, d: str) -> DataFrame:
    return parsed.table_ordinals(paragraphs(s, d))


@query(f"WITH {_D}, w AS (SELECT book_slug, section_pos, {_list('body_md')} AS a FROM d) SELECT book_slug, section_pos, array_to_string(a[1:200], ' ') || CASE WHEN len(a) > 200 THEN '...' ELSE '' END AS head, array_to_string(CASE WHEN len(a) > 200 THEN a[-200:] ELSE a END, ' ') AS tail FROM w")
def st04_excerpts(s: SparkSession, d: str) -> DataFrame:
    head, tail = coverage.excerpt(F.col("body_md"))
    return bodies(s, d).select("book_slug", "section_pos", head.alias("head"), tail.alias("tail"))


@query(f"WITH {_C}, {_I}, n AS (SELECT book_slug, section_pos, min_by(name, item_pos) FILTER (item_type = 'framework') AS framework, min_by(name, item_pos) FILTER (item_type = 'key_term') AS term FROM i WHERE coalesce(name, '') <> '' GROUP BY ALL) SELECT c.book_slug, c.section_pos, framework, term, array_to_string(string_split_regex(trim(thesis), '\\s+')[1:5], ' ') AS thesis_start FROM c LEFT JOIN n ON c.book_slug = n.book_slug AND c.section_pos = n.section_pos")
def st03_first_items(s: SparkSession, d: str) -> DataFrame:
    f = items(s, d).filter("coalesce(name, '') != ''").groupBy("book_slug", "section_pos").agg(*[F.min_by("name", F.when(F.col("item_type") == k, F.col("item_pos"))).alias(a) for k, a in (("framework", "framework"), ("key_term", "term"))])
    return chapters(s, d).join(f, ["book_slug", "section_pos"], "left").select("book_slug", "section_pos", "framework", "term", F.array_join(F.slice(F.split(F.trim("thesis"), r"\s+"), 1, 5), " ").alias("thesis_start"))


# Scalar functions.

_FORM = "trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '" + _WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"


@query(
    f"WITH {_P} SELECT record_id, n_words, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS squeezed, {_FORM.format(x='text')} AS match_form, greatest(1, length(text) // 2400)::BIGINT AS pages, greatest(1, length(text) // 4)::BIGINT AS tokens FROM p WHERE text IS NOT NULL"
)
def fn01_text_functions(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return paragraphs(s, d).filter("text is not null").select("record_id", "n_words", tx.squeeze(t).alias("squeezed"), tx.match_form(t).alias("match_form"), tx.estimated_pages(t).alias("pages"), tx.estimated_tokens(t).alias("tokens"))


@query(f"WITH {_B} SELECT book_slug, CASE WHEN coalesce(x, '') = '' THEN 'untitled' ELSE x END AS slug FROM (SELECT book_slug, regexp_replace(regexp_replace(lower(book_title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS x FROM b)")
def fn04_slugs(s: SparkSession, d: str) -> DataFrame:
    return books(s, d).select("book_slug", tx.slug(F.col("book_title")).alias("slug"))


_UUID5 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"WITH {_P}, k AS (SELECT record_id, sha1(unhex('{ids.NAMESPACE.replace('-', '')}') || md5('paragraph' || chr(31) || text || chr(31) || 'Body' || chr(31) || page_start)::BLOB) AS h FROM p WHERE text IS NOT NULL AND page_start IS NOT NULL) SELECT record_id, {_UUID5} AS content_id FROM k")
def fn05_content_ids(s: SparkSession, d: str) -> DataFrame:
    return paragraphs(s, d).filter("text is not null and page_start is not null").select("record_id", ids.paragraph_id(F.col("text"), F.array(F.lit("Body")), F.col("page_start")).alias("content_id"))


@query(f"WITH {_P} SELECT record_id, CASE WHEN table_grid IS NULL OR len(table_grid) = 0 THEN '[empty table]' ELSE array_to_string(list_transform(table_grid, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | ')), chr(10)) END AS grid_text FROM p WHERE is_table")
def fn11_table_text(s: SparkSession, d: str) -> DataFrame:
    return paragraphs(s, d).filter("is_table").select("record_id", md.grid_text(F.col("table_grid")).alias("grid_text"))


@query(
    f"WITH {_D} SELECT book_slug, section_pos, regexp_replace(body_md, '\\[p:[a-f0-9-]+\\]', '', 'g') AS bare, regexp_replace(body_md, '\\[p:([a-f0-9-]+)\\]', '[[' || book_slug || '.source#^\\1|↗]]', 'g') AS linked, CASE WHEN regexp_extract(body_md, '^##\\s+([^\\n]*?)\\s*\\n', 1) = chapter_title AND chapter_title <> '' THEN regexp_replace(body_md, '^##\\s+[^\\n]*\\n', '') ELSE body_md END AS without_heading FROM d WHERE body_md IS NOT NULL"
)
def fn13_citations(s: SparkSession, d: str) -> DataFrame:
    b = F.col("body_md")
    return bodies(s, d).filter("body_md is not null").select("book_slug", "section_pos", tx.strip_citations(b).alias("bare"), tx.citations_to_links(b, F.col("book_slug")).alias("linked"), render.strip_own_heading(b, F.col("chapter_title")).alias("without_heading"))


@query(
    f"WITH {_D}, h AS (SELECT book_slug, section_pos, body_md AS t, left(body_md, length(body_md) // 2 + 60) AS a, substr(body_md, greatest(1, length(body_md) // 2 - 60)) AS b FROM d WHERE length(body_md) > 400), k AS (SELECT *, list_max(list_filter(range(21, least(length(a), length(b), 300) + 1), lambda n: right(a, n) = left(b, n))) AS size FROM h) SELECT book_slug, section_pos, CASE WHEN size IS NOT NULL THEN a || substr(b, size + 1) ELSE rtrim(a) || chr(10) || chr(10) || ltrim(b) END AS merged FROM k"
)
def fn19_merge_overlap(s: SparkSession, d: str) -> DataFrame:
    """Each body cut into two halves that overlap, and put together again."""
    n = F.floor(F.length("body_md") / 2).cast("int")
    x = bodies(s, d).filter(F.length("body_md") > 400)
    return x.select("book_slug", "section_pos", md.merge_overlap(F.left("body_md", n + 60), F.substring("body_md", F.greatest(F.lit(1), n - 60), F.length("body_md"))).alias("merged"))


@query(f"WITH {_C}, {_I}, {_D}, n AS (SELECT book_slug, section_pos, list(name ORDER BY item_type, item_pos) AS names FROM i WHERE coalesce(name, '') <> '' GROUP BY ALL) SELECT n.book_slug, n.section_pos, array_to_string(list_filter(names, lambda x: NOT contains(lower(coalesce(body_md, '')), lower(x))), '|') AS remaining FROM n JOIN d ON n.book_slug = d.book_slug AND n.section_pos = d.section_pos")
def fn20_remaining_items(s: SparkSession, d: str) -> DataFrame:
    names = items(s, d).filter("coalesce(name, '') != ''").groupBy("book_slug", "section_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_type", "item_pos", "name"))), lambda x: x["name"]).alias("names"))
    return names.join(bodies(s, d), ["book_slug", "section_pos"]).select("book_slug", "section_pos", F.array_join(coverage.remaining_items(F.col("names"), F.col("body_md")), "|").alias("remaining"))


@query(f"WITH {_B} SELECT book_slug, strftime(extracted_at, '%Y-%m-%d') AS day, format('{{:,}}', word_count) AS words, coalesce(word_count, 0) // 275 AS pages FROM b WHERE word_count IS NOT NULL")
def fn24_formats(s: SparkSession, d: str) -> DataFrame:
    return books(s, d).filter("word_count is not null").select("book_slug", F.date_format("extracted_at", "yyyy-MM-dd").alias("day"), F.format_number("word_count", 0).alias("words"), F.floor(F.col("word_count") / 275).alias("pages"))


# Coverage.

_TIER = f"CASE WHEN contains(lower(t), lower(n)) THEN 1 WHEN contains({_FORM.format(x='t')}, {_FORM.format(x='n')}) THEN 2 WHEN len(list_filter(range(0, greatest(0, len(ht) - 50) + 1), lambda k: len(list_filter(nt, lambda w: list_contains(ht[k + 1:k + 50], w))) >= greatest(1, trunc(len(nt) * 0.75::DOUBLE)::INT))) > 0 THEN 3 ELSE 0 END"
_MATCHED = f"{_I}, {_D}, m AS (SELECT i.*, d.body_md, regexp_replace(coalesce(d.body_md, ''), '\\[p:[a-f0-9-]+\\]', '', 'g') AS t, coalesce(i.name, '') AS n FROM i LEFT JOIN d ON i.book_slug = d.book_slug AND i.section_pos = d.section_pos), mm AS (SELECT *, list_filter(string_split({_FORM.format(x='t')}, ' '), lambda x: x <> '') AS ht, list_filter(string_split({_FORM.format(x='n')}, ' '), lambda x: x <> '') AS nt FROM m), tiers AS (SELECT *, {_TIER} AS tier FROM mm)"
_MISSING = f"{_MATCHED}, missing AS (SELECT book_slug, section_pos, item_type, item_pos, CASE WHEN t = '' THEN n ELSE n || ': ' || coalesce(detail, '') END AS description, CASE WHEN item_type = 'framework' OR (item_type = 'example' AND coalesce(is_load_bearing, true)) THEN 'critical' ELSE 'minor' END AS severity FROM tiers WHERE CASE WHEN t = '' THEN item_type = 'framework' ELSE tier = 0 END)"


@query(f"WITH {_MATCHED} SELECT book_slug, section_pos, item_type, item_pos, tier::INT AS tier FROM tiers")
def cv01_match_tiers(s: SparkSession, d: str) -> DataFrame:
    return coverage.tiers(items(s, d), bodies(s, d)).select("book_slug", "section_pos", "item_type", "item_pos", "tier")


def _missing(s: SparkSession, d: str) -> DataFrame:
    return coverage.missing_items(items(s, d), bodies(s, d))


@query(f"WITH {_MISSING} SELECT * FROM missing")
def cv04_missing_items(s: SparkSession, d: str) -> DataFrame:
    return _missing(s, d)


@query(f"WITH {_MISSING}, {_C}, x AS (SELECT book_slug, count(*) AS flags, count(*) FILTER (severity = 'critical') AS critical FROM missing GROUP BY 1) SELECT DISTINCT book_slug, coalesce(flags, 0) AS flags, coalesce(critical, 0) AS critical, coalesce(critical, 0) = 0 AS passed FROM c LEFT JOIN x USING (book_slug)")
def pf13_verdicts(s: SparkSession, d: str) -> DataFrame:
    return coverage.verdicts(_missing(s, d), chapters(s, d))


@query(f"WITH {_MISSING}, x AS (SELECT book_slug, section_pos, count(*)::INT AS fixes, string_agg('Restore ' || item_type || ': ' || description, chr(10) ORDER BY item_type, item_pos) AS instructions FROM missing WHERE severity = 'critical' GROUP BY ALL) SELECT book_slug, section_pos, (row_number() OVER w)::INT AS rank, fixes, instructions, row_number() OVER w <= 2 AS planned FROM x WINDOW w AS (PARTITION BY book_slug ORDER BY section_pos)")
def fx01_fix_plan(s: SparkSession, d: str) -> DataFrame:
    return coverage.fix_plan(_missing(s, d))


# Generation by extraction.

_SENT = f"{_P}, q AS (SELECT book_slug, section_pos, para_pos, string_split(regexp_replace(trim(regexp_replace(text, '{_WS}', ' ', 'g')), '([.!?…][\"”’)]*) ([\\p{{Lu}}“\"‘])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS a FROM p WHERE text IS NOT NULL), sents AS (SELECT book_slug, section_pos, para_pos, generate_subscripts(a, 1) - 1 AS sent, unnest(a) AS sentence FROM q)"


@query(f"WITH {_SENT} SELECT book_slug, section_pos, arg_min(sentence, (para_pos, sent)) AS thesis, arg_max(sentence, (para_pos, sent)) AS voice FROM sents WHERE sentence <> '' GROUP BY ALL")
def gn02_thesis(s: SparkSession, d: str) -> DataFrame:
    return condense.thesis(condense.sentences(paragraphs(s, d)))


@query(
    f"WITH {_P}, tok AS (SELECT book_slug, section_pos, unnest(string_split({_FORM.format(x='text')}, ' ')) AS term FROM p WHERE text IS NOT NULL), tf AS (SELECT book_slug, section_pos, term, count(*) AS n FROM tok WHERE length(term) >= 5 AND NOT regexp_matches(term, '^\\d') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT (book_slug, section_pos)) AS chapters FROM p), w AS (SELECT tf.*, row_number() OVER (PARTITION BY book_slug, section_pos ORDER BY round(n * ln((chapters + 1.0::DOUBLE) / df), 6) DESC, encode(term)) AS rank FROM tf JOIN df USING (term), n) SELECT book_slug, section_pos, rank::INT AS rank, term, n FROM w WHERE rank <= 5"
)
def gn02_key_terms(s: SparkSession, d: str) -> DataFrame:
    return condense.key_terms(paragraphs(s, d))


@query(f"WITH {_SENT}, {_TARGETS.replace(_P + ', ', '', 1)}, x AS (SELECT e.*, {_words('sentence')} AS n, target_words FROM sents e JOIN t ON e.book_slug = t.book_slug AND e.section_pos = t.section_pos WHERE sentence <> ''), y AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY book_slug, section_pos ORDER BY para_pos, sent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x) SELECT book_slug, section_pos, string_agg(sentence, ' ' ORDER BY para_pos, sent) AS body_md, sum(n)::BIGINT AS word_count FROM y WHERE before < target_words GROUP BY ALL")
def gn03_condensed(s: SparkSession, d: str) -> DataFrame:
    return condense.condensed(condense.sentences(paragraphs(s, d)), _targets(s, d))


# Rendering: the rows of every book in order.

_MD = "SELECT book_slug, section_pos::BIGINT AS section_pos, place::BIGINT AS place, markdown FROM"
_CASED = "array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda r: upper(left(r, 1)) || lower(substr(r, 2))), '')"
_FIRST_WORDS = "array_to_string(regexp_split_to_array(trim(thesis), '\\s+')[1:5], ' ')"
_TITLED = (
    "fw AS (SELECT book_slug, section_pos, arg_min(name, item_pos) FILTER (item_type = 'framework') AS framework, arg_min(name, item_pos) FILTER (item_type = 'key_term') AS term FROM i WHERE coalesce(name, '') <> '' GROUP BY ALL), "
    f"tt AS (SELECT k.*, framework, term, row_number() OVER (PARTITION BY book_slug ORDER BY section_pos) AS idx FROM k LEFT JOIN fw USING (book_slug, section_pos)), "
    f"tc AS (SELECT *, {_CASED.format(x='framework')} AS f, {_CASED.format(x='term')} AS w, {_CASED.format(x=_FIRST_WORDS)} || '...' AS h FROM tt), "
    "titled AS (SELECT book_slug, section_pos, idx::INT AS idx, CASE WHEN coalesce(regexp_matches(chapter_title, '^(Introduction|Body|Front Matter|Part \\d+)\\s*(\\(Part \\d+\\))?$'), false) AND chapter_title <> 'Front Matter' THEN coalesce('Chapter ' || idx || ': ' || coalesce(CASE WHEN length(f) > 50 THEN left(f, 47) || '...' ELSE f END, w, h), chapter_title) ELSE chapter_title END AS title FROM tc)"
)


@query(
    f"WITH {_P}, {_S}, {_B}, r AS (SELECT book_slug, -1 AS section_pos, 0 AS place, '# ' || coalesce(book_title, '') AS markdown FROM b "
    "UNION ALL SELECT book_slug, section_pos, -1, chr(10) || repeat('#', least(6, level + 1)) || ' ' || coalesce(title, '') FROM s "
    "UNION ALL SELECT book_slug, section_pos, para_pos, chr(10) || CASE WHEN is_table AND len(table_grid) > 0 THEN array_to_string(list_concat(['| ' || array_to_string(list_transform(table_grid[1], lambda c: coalesce(c, '')), ' | ') || ' |', '|' || array_to_string(list_transform(table_grid[1], lambda c: '---'), '|') || '|'], list_transform(table_grid[2:], lambda q: '| ' || array_to_string(list_transform(q, lambda c: coalesce(c, '')), ' | ') || ' |')), chr(10)) ELSE coalesce(text, '') END || chr(10) || '^' || coalesce(paragraph_id, '') FROM p) "
    f"{_MD} r"
)
def snk04_source_markdown(s: SparkSession, d: str) -> DataFrame:
    return render.source_markdown(books(s, d), sections(s, d), paragraphs(s, d))


@query(
    f"WITH {_C}, {_I}, {_B}, {_D}, k AS (SELECT d.book_slug, d.section_pos, d.chapter_title, thesis FROM d LEFT JOIN c ON c.book_slug = d.book_slug AND c.section_pos = d.section_pos), {_TITLED}, "
    "l AS (SELECT book_slug, section_pos, string_agg(coalesce(name, ''), ', ' ORDER BY item_pos) FILTER (item_type = 'framework') AS fws, string_agg(coalesce(name, ''), ', ' ORDER BY item_pos) FILTER (item_type = 'example') AS exs FROM i GROUP BY ALL), "
    "x AS (SELECT d.book_slug, d.section_pos, d.chapter_title, titled.title, c.thesis, c.book_slug IS NOT NULL AS has_spine, argumentative_moves, fws, exs, regexp_replace(coalesce(body_md, ''), '\\[p:([a-f0-9-]+)\\]', '[[' || d.book_slug || '.source#^\\1|↗]]', 'g') AS body FROM d JOIN titled USING (book_slug, section_pos) LEFT JOIN c USING (book_slug, section_pos) LEFT JOIN l USING (book_slug, section_pos)), "
    "r AS (SELECT book_slug, -1 AS section_pos, 0 AS place, '# ' || coalesce(book_title, '') || chr(10) || chr(10) || '*Distilled from \"' || coalesce(book_title, '') || '\"' || CASE WHEN coalesce(book_author, '') <> '' THEN ' by ' || book_author ELSE '' END || '.*' || chr(10) || '*~' || (w // 275) || ' pages. Generated 2025-01-01.*' || chr(10) || chr(10) || '---' AS markdown FROM b JOIN (SELECT book_slug, sum(coalesce(word_count, 0))::BIGINT AS w FROM d GROUP BY 1) USING (book_slug) "
    "UNION ALL SELECT book_slug, section_pos, 0, chr(10) || '## ' || coalesce(title, '') || chr(10) || chr(10) || CASE WHEN has_spine THEN '> [!abstract]- Spine' || chr(10) || '> **Thesis:** ' || coalesce(thesis, '') || coalesce(chr(10) || '>' || chr(10) || '> **Frameworks:** ' || fws, '') || coalesce(chr(10) || '>' || chr(10) || '> **Key examples:** ' || exs, '') || CASE WHEN len(argumentative_moves) > 0 THEN chr(10) || '>' || chr(10) || '> **Argument flow:**' || chr(10) || array_to_string(list_transform(argumentative_moves, lambda m, n: '> ' || n || '. ' || m), chr(10)) ELSE '' END || chr(10) || chr(10) ELSE '' END "
    "|| CASE WHEN regexp_extract(body, '^##\\s+([^\\n]*?)\\s*\\n', 1) = chapter_title AND chapter_title <> '' THEN regexp_replace(body, '^##\\s+[^\\n]*\\n', '') ELSE body END FROM x) "
    f"{_MD} r"
)
def snk05_distillation_markdown(s: SparkSession, d: str) -> DataFrame:
    return render.distillation_markdown(books(s, d), chapters(s, d), items(s, d), bodies(s, d), "2025-01-01")


@query(
    f"WITH {_C}, {_I}, {_B}, r AS (SELECT book_slug, -1 AS section_pos, 0 AS place, '# ' || coalesce(book_title, '') || ' — Spine' AS markdown FROM b "
    "UNION ALL SELECT book_slug, section_pos, 0, chr(10) || '## ' || coalesce(chapter_title, '') || chr(10) || chr(10) || '**Thesis:** ' || coalesce(thesis, '') FROM c "
    "UNION ALL SELECT book_slug, section_pos, CASE item_type WHEN 'framework' THEN 1 WHEN 'example' THEN 2 ELSE 4 END, chr(10) || '**' || CASE item_type WHEN 'framework' THEN 'Frameworks' WHEN 'example' THEN 'Key examples' ELSE 'Key terms' END || ':**' || chr(10) || string_agg('- **' || coalesce(name, '') || '**: ' || coalesce(detail, ''), chr(10) ORDER BY item_pos) FROM i SEMI JOIN c USING (book_slug, section_pos) GROUP BY book_slug, section_pos, item_type "
    "UNION ALL SELECT book_slug, section_pos, 3, chr(10) || '**Argument flow:**' || chr(10) || array_to_string(list_transform(argumentative_moves, lambda m, n: n || '. ' || m), chr(10)) FROM c WHERE len(argumentative_moves) > 0 "
    "UNION ALL SELECT book_slug, section_pos, 9, chr(10) || '---' FROM c) "
    f"{_MD} r"
)
def snk06_spine_markdown(s: SparkSession, d: str) -> DataFrame:
    return render.spine_markdown(books(s, d), chapters(s, d), items(s, d))


@query(
    f"WITH {_MISSING}, {_B}, {_C}, v AS (SELECT c.book_slug, count(*) FILTER (severity = 'critical') = 0 AS passed FROM (SELECT DISTINCT book_slug FROM c) c LEFT JOIN missing ON missing.book_slug = c.book_slug GROUP BY 1), w AS (SELECT book_slug, sum(coalesce(word_count, 0))::BIGINT AS words, count(*) AS chapters FROM d GROUP BY 1) SELECT b.book_slug, book_title, book_author, page_count AS source_pages, word_count AS source_words, words AS distillation_words, words // 275 AS distillation_pages, round(words / greatest(1, coalesce(word_count, 0))::DOUBLE, 6) AS compression_ratio, chapters, coalesce(passed, true) AS coherence_pass FROM b JOIN w USING (book_slug) LEFT JOIN v USING (book_slug)"
)
def snk08_output_manifest(s: SparkSession, d: str) -> DataFrame:
    return render.output_manifest(books(s, d), bodies(s, d), coverage.verdicts(_missing(s, d), chapters(s, d)))


@query(f"WITH {_C}, {_I}, k AS (SELECT book_slug, section_pos, chapter_title, thesis FROM c), {_TITLED} SELECT * FROM titled")
def fn17_chapter_titles(s: SparkSession, d: str) -> DataFrame:
    return render.chapter_titles(chapters(s, d).select("book_slug", "section_pos", "chapter_title", "thesis"), items(s, d))


@query(f"WITH {_C}, {_I}, k AS (SELECT book_slug, section_pos, CASE section_pos % 3 WHEN 0 THEN 'Part 2' WHEN 1 THEN 'Body (Part 1)' ELSE 'Front Matter' END AS chapter_title, thesis FROM c), {_TITLED} SELECT * FROM titled")
def fn17_generic_titles(s: SparkSession, d: str) -> DataFrame:
    """The titles that splitting gives, which the chapters here have not."""
    kind = F.col("section_pos") % 3
    title = F.when(kind == 0, "Part 2").when(kind == 1, "Body (Part 1)").otherwise("Front Matter")
    return render.chapter_titles(chapters(s, d).select("book_slug", "section_pos", title.alias("chapter_title"), "thesis"), items(s, d))


@query()
def snk07_epub_chapters(s: SparkSession, d: str) -> DataFrame:
    return render.epub_chapters(chapters(s, d), items(s, d), bodies(s, d))


@query(
    f"WITH {_D}, b AS (SELECT book_slug, section_pos, list_filter(list_transform(string_split(regexp_replace(body_md, '\\s*\\[p:[a-f0-9-]+(?:,\\s*p:[a-f0-9-]+)*\\]', '', 'g'), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS blocks FROM d WHERE body_md IS NOT NULL), "
    "h AS (SELECT *, coalesce(list_position(list_transform(blocks, lambda x: starts_with(x, '#')), true), 0) AS first FROM b) "
    "SELECT book_slug, section_pos, array_to_string(list_transform(list_filter(blocks, lambda x, i: i <> first), lambda x: CASE WHEN starts_with(x, '### ') THEN '<h3>' || substr(x, 5) || '</h3>' WHEN starts_with(x, '## ') THEN '<h3>' || substr(x, 4) || '</h3>' ELSE '<p>' || regexp_replace(regexp_replace(x, '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g'), '\\*(.+?)\\*', '<em>\\1</em>', 'g') || '</p>' END), chr(10)) AS html FROM h"
)
def fn18_html_bodies(s: SparkSession, d: str) -> DataFrame:
    return bodies(s, d).filter("body_md is not null").select("book_slug", "section_pos", md.html_blocks(F.col("body_md")).alias("html"))


# Sources and streams.


_CUT = f"(?im)^[ \\t]*((?:chapter|part)\\s+(?:\\d+|{_NUM})[:.]?\\s*.*|introduction|preface|prologue|epilogue|conclusion|afterword)$"


@query(
    f"WITH t AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, t, regexp_extract_all(t, '{_CUT}', 1) AS titles, string_split_regex(t, '{_CUT}') AS bodies FROM t), "
    "s AS (SELECT doc_id, unnest(range(0, len(titles)))::INT AS section_pos, unnest(list_transform(titles, lambda x: trim(x, ' '))) AS title, unnest(bodies[2:]) AS body FROM x WHERE len(titles) > 0 UNION ALL SELECT doc_id, 0, 'Body', t FROM x WHERE len(titles) = 0), "
    "p AS (SELECT doc_id, section_pos, title, unnest(string_split(body, chr(10) || chr(10))) AS p FROM s) SELECT doc_id, section_pos, title, count(*) AS paragraphs FROM p WHERE trim(regexp_replace(p, '[\\s\\x0b]', '', 'g'), ' ') <> '' GROUP BY ALL"
)
def src19_heading_sections(s: SparkSession, d: str) -> DataFrame:
    return plain.split_by_headings(table(s, d, "documents", "doc_id", "text")).groupBy("doc_id", "section_pos", "title").agg(F.count("*").alias("paragraphs"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def st_event_windows(s: SparkSession, d: str) -> DataFrame:
    return streams.event_windows(table(s, d, "events"))


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM b GROUP BY user_id, k")
def st_user_sessions(s: SparkSession, d: str) -> DataFrame:
    return streams.user_sessions(table(s, d, "events").filter("user_id is not null"))
