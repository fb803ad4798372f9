import uuid

import pytest
from pyspark.sql import functions as F

from quire.functions import ids, markdown as md, text as tx
from quire.operators import condense, coverage, render, structure


def one(spark, rows, expr):
    df = spark.createDataFrame(rows, "i int, a string, b string") if rows and isinstance(rows[0], tuple) else rows
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_words_are_what_python_splits(spark):
    texts = ["", " a  b ", "a\tb\x1cc\x85d e\x0b f", "x​y", None, "½ é—ü", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    assert one(spark, df, tx.word_count(F.col("a"))) == [len((t or "").split()) for t in texts]
    assert one(spark, df, tx.words(F.col("a"))) == [(t or "").split() for t in texts]


def test_ids(spark):
    text, path, page = "Ünï text", ["A", "B"], 3
    name = "\x1f".join(["paragraph", text, "A/B", "3"])
    import hashlib

    want = uuid.uuid5(uuid.UUID(ids.NAMESPACE), hashlib.md5(name.encode()).hexdigest())
    df = spark.createDataFrame([(0, text, "")], "i int, a string, b string")
    assert one(spark, df, ids.paragraph_id(F.col("a"), F.array(*map(F.lit, path)), F.lit(page))) == [str(want)]
    assert one(spark, df, ids.paragraph_id(F.lit(None).cast("string"), F.array(F.lit("A")), F.lit(1))) == [None]


@pytest.mark.parametrize("text,want", [("rule's PEAK-end 4th", "Rule'S Peak-End 4Th"), ("été", "Été"), ("", "")])
def test_title_case(spark, text, want):
    assert want == text.title() and one(spark, [(0, text, "")], tx.title_case(F.col("a"))) == [want]


def test_slug(spark):
    assert one(spark, [(0, "Hello, World!", ""), (1, "--", ""), (2, None, "")], tx.slug(F.col("a"))) == ["hello-world", "untitled", "untitled"]


def test_match_form(spark):
    assert one(spark, [(0, "Hello, World!  How's   it?", "")], tx.match_form(F.col("a"))) == ["hello world how s it"]


CASES = [
    ("Kahneman calls it System 1.", "System 1", 0.7, 1),
    ("THE HEDONIC TREADMILL", "hedonic treadmill", 0.7, 1),
    ("the peak-end rule holds", "peak end rule", 0.7, 2),
    ("System 1 and then System 2 compete", "System 1 vs System 2", 0.5, 3),
    ("nothing of the kind", "quantum entanglement", 0.7, 0),
    ("", "nudge", 0.7, 0),
    ("anything", "", 0.7, 1),
]


@pytest.mark.parametrize("text,needle,threshold,tier", CASES)
def test_match_tiers(spark, text, needle, threshold, tier):
    assert one(spark, [(0, text, needle)], coverage.match_tier(coverage.match_forms(F.col("a")), F.col("b"), threshold)) == [tier]


def test_near_tokens_against_all_windows(spark):
    import random

    rng = random.Random(1)
    rows, want = [], []
    for i in range(300):
        h = [rng.choice("abcdefghij") for _ in range(rng.choice([0, 3, 49, 50, 51, 120]))]
        n = [rng.choice("abcdefghijxyz") for _ in range(rng.randint(1, 5))]
        need = max(1, int(len(n) * 0.75))
        want.append(any(sum(w in h[k : k + 50] for w in n) >= need for k in range(max(0, len(h) - 50) + 1)))
        rows.append((i, " ".join(h), " ".join(n)))
    assert one(spark, rows, coverage.near_tokens(F.split("a", " "), F.col("b"))) == want


def test_merge_overlap(spark):
    s = "x" * 10 + "abcdefghijklmnopqrstuvwxyz"
    rows = [(0, "Start " + s, s + " end"), (1, "one", "two"), (2, "", "two"), (3, "one", None), (4, "tail " + s[-20:], s[-20:] + " on"), (5, "tail " + s[-21:], s[-21:] + " on")]
    got = one(spark, rows, md.merge_overlap(F.col("a"), F.col("b")))
    assert got == ["Start " + s + " end", "one\n\ntwo", "two", "one", "tail " + s[-20:] + "\n\n" + s[-20:] + " on", "tail " + s[-21:] + " on"]


def test_fences_and_json(spark):
    rows = [(0, '```json\n{"word": "a", "count": 2}\n```', ""), (1, '{"word": "b", "count": 1}', ""), (2, "no json", "")]
    got = one(spark, rows, md.parse_json(F.col("a"), "word string, count int"))
    assert [(r.word, r["count"]) if r and r.word else None for r in got] == [("a", 2), ("b", 1), None]


def test_tables(spark):
    df = spark.createDataFrame([(0, [["a", "b"], ["1", None]]), (1, []), (2, None)], "i int, g array<array<string>>")
    assert one(spark, df, md.grid_text(F.col("g"))) == ["a | b\n1 | ", "[empty table]", "[empty table]"]
    assert one(spark, df, md.grid_markdown(F.col("g"))) == ["| a | b |\n|---|---|\n| 1 |  |", None, None]


def test_html(spark):
    text = "## Title\n\nSome **bold** and *thin*.\n\n### Sub"
    assert one(spark, [(0, text, "")], md.html_blocks(F.col("a"))) == ["<p>Some <strong>bold</strong> and <em>thin</em>.</p>\n<h3>Sub</h3>"]


def test_smart_titles(spark):
    t = lambda title, fw, term: one(spark, [(0, title, "")], render.smart_title(F.col("a"), F.lit(fw), F.lit(term), F.lit("one two three four five six"), F.lit(3)))[0]
    assert t("Part 2", "inner game", None) == "Chapter 3: Inner Game"
    assert t("Body (Part 1)", None, "peak-end") == "Chapter 3: Peak-End"
    assert t("Introduction", None, None) == "Chapter 3: One Two Three Four Five..."
    assert t("Front Matter", "x", None) == "Front Matter" and t("Own Title", "x", None) == "Own Title"
    assert len(t("Body", "w" * 80, None)) == len("Chapter 3: ") + 50


def test_heading_levels(spark):
    rows = [(i, t, "") for i, t in enumerate(["Chapter 4", "2.1 Scope", "1.2.3.4.5.6.7 Deep", "3 Flat", "Other", "PREFACE", "Section 2.1", "Appendix 1.2", "Introduction to X", " part two", "Partial"])]
    assert one(spark, rows, structure.heading_level(F.col("a"), F.lit(9))) == [1, 2, 6, 1, 9, 1, 2, 2, 9, 1, 9]


def test_truncation_rule(spark):
    rule = lambda text, n, target, why=None: one(spark, [(0, text, "")], coverage.looks_truncated(F.col("a"), F.lit(n), F.lit(target), F.lit(why).cast("string")))[0]
    assert rule("so", 84, 100) and not rule("so.", 84, 100) and not rule("so", 85, 100) and rule("so.", 100, 100, "MAX_TOKENS")


def test_prompts_need_their_columns(spark):
    df = spark.createDataFrame([(0, "x", None)], "i int, a string, b string")
    assert one(spark, df, condense.prompts(df, "A: {a}; B: {b}.")) == ["A: x; B: ."]
    with pytest.raises(Exception):
        condense.prompts(df, "{missing}")
