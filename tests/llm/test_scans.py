import random

import pytest

from quire.llm import scans

NOUNS = "harbour library council reason price garden region paper letter window morning market".split()
TITLE = "The Quiet Harbour"


def clean(rng, n=4):
    return " ".join(rng.choice([f"The {rng.choice(NOUNS)} had replaced the older {rng.choice(NOUNS)} before {rng.randint(1700, 1999)}.", f"Nobody in the town expected the {rng.choice(NOUNS)} to last beyond the {rng.choice(NOUNS)}.", f"Was the {rng.choice(NOUNS)} well-known, or had the people simply changed their {rng.choice(NOUNS)}?"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    return [clean(rng) for _ in range(300)]


@pytest.fixture
def tables(spark, paragraphs, corpus):
    def make(rows):
        p = paragraphs([(10_000 + i, t) for i, t in enumerate(corpus)] + rows)
        b = spark.createDataFrame([("b", TITLE, 1), ("b", TITLE, 2), ("c", None, 1)], "book_slug string, book_title string, noise int")
        s = spark.createDataFrame([("b", 0, "Chapter 2: The Older Garden", "x"), ("b", 1, None, "x")], "book_slug string, section_pos int, title string, text string")
        return p, b, s

    return make


CASES = {
    "The library had replaced the older har-\nbour before 1850. Nobody in the town\nexpected the market to last.": {"broken_word"},
    "The library had replaced the older har\xad\nbour before 1850.": {"broken_word"},
    "The library had replaced the older har- bour before 1850.": {"broken_word"},
    "Was the short- and the long one well-\nknown, or had the people simply changed?": set(),
    "The libr@ry had replaced the older harbour before 1850.": {"misread"},
    "The library had rep1aced the oldcr harbour before l850.": {"misread"},
    "The library had replaced the older har-\nb0ur before 1850. Nobody in\nthe town expected it.": {"broken_word", "misread"},
    "THE QUIET HARBOUR  12\nThe library had replaced the older harbour\nbefore 1850.": {"running_head"},
    "The library had replaced the older\nThe Quiet Harbour | 1\nharbour before 1850.": {"running_head"},
    "T H E   Q U I E T   H A R B O U R\nThe library had replaced the older harbour\nbefore 1850.": {"running_head"},
    "The library had replaced CHAPTER 2: THE OLDER GARDEN the older harbour before 1850.": {"running_head"},
    "As the preface to The Quiet Harbour says, the library had replaced the older harbour.": set(),
    "The library had replaced\n— 1 —\nthe older harbour before 1850.": {"page_number"},
    "Page 2 of 300\nThe library had replaced\nthe older harbour before 1850.": {"page_number"},
    "ii\nThe library had replaced\nthe older harbour before 1850.": {"page_number"},
    "The number, written out in full, was\n7,162\nand the older harbour had replaced the library.": set(),
    "The library had replaced the older harbour in\n1850.": set(),
    "- small harb0ur\n- older gar-\nden\n- price and reason": set(),
}


def test_kinds(spark, tables):
    rows = [(i, t) for i, t in enumerate(CASES)]
    got = {}
    for r in scans.damaged(*tables(rows)).filter("record_id < 10000").collect():
        got.setdefault(r.record_id, set()).add(r.noise)
    assert {t: got.get(i, set()) for i, t in enumerate(CASES)} == CASES


def test_nothing_found_in_clean_texts(spark, tables, corpus):
    assert scans.damaged(*tables([])).count() == 0


def test_repair(spark, tables):
    rows = [(1, "THE QUIET HARBOUR  1\nThe library had rep1aced the older har-\nbour before 1850. Nobody in the t0wn\n1\nexpected the oldcr market to last be\xad\nyond the region."), (2, "The library had replaced the older harbour.")]
    got = {r.record_id: r.text for r in scans.repaired(*tables(rows)).collect()}
    assert got == {1: "The library had replaced the older harbour before 1850. Nobody in the town expected the older market to last beyond the region."}


def test_damage_and_repair_of_many(spark, tables):
    """Words broken and misread at random come back; held-out accuracy over 120 texts."""
    rng = random.Random(7)
    rows, want = [], {}
    for i in range(120):
        text = clean(rng, 5)
        want[i] = text
        words = text.split()
        for _ in range(3):
            k = rng.randrange(len(words))
            w = words[k]
            if len(w) > 6 and w.isalpha():
                words[k] = rng.choice([w.replace("e", "c", 1), w[:3] + "-\n" + w[3:], w.replace("a", "@", 1), w.replace("r", "r", 1), w.replace("l", "1", 1)])
        rows.append((i, " ".join(words)))
    got = {r.record_id: r.text for r in scans.repaired(*tables(rows)).collect()}
    same = sum(got.get(i, dict(rows)[i]) == want[i] for i in want)
    assert same >= 115


def test_nulls_ties_superseded_and_nothing(spark, tables, at):
    bad = "The library had replaced the older har-\nbour before 1850."
    rows = [{"record_id": 1, "text": bad}, {"record_id": 1, "text": bad}, {"record_id": 2, "text": bad, "ingested_at": at(-1)}, {"record_id": 2, "text": "The library had replaced the harbour."}, {"record_id": 3, "text": bad, "book_slug": None, "section_pos": None, "page_start": None, "page_end": None}, {"record_id": 4, "text": None}, {"record_id": 5, "text": ""}, {"record_id": 6, "text": " \n"}, {"record_id": None, "text": bad}, {"record_id": 7, "text": bad, "ingested_at": None}]
    p, b, s = tables(rows)
    got = {(r.record_id, r.noise) for r in scans.damaged(p, b, s).collect()}
    assert got == {(i, "broken_word") for i in (1, 3, None, 7)}
    assert scans.damaged(p.limit(0), b, s).count() == 0
    assert {r.record_id for r in scans.damaged(p, b.limit(0), s.limit(0)).collect()} == {1, 3, None, 7}


def test_paragraph_boundaries():
    lines = ["The first sentence goes on and on to the margin", "and ends here.", "A second paragraph begins and runs to the margin", "with more of it that goes on to the margin again", "and stops.", "", "Third."]
    assert [len(x) for x in scans.paragraphs_of(lines)] == [2, 3, 1]
    assert scans.paragraphs_of(["", ""]) == []


def test_words_divided_without_a_hyphen_and_run_together(spark, tables):
    rows = [(1, "The library had replaced the older har\nbour before 1850. Nobody in the town\nexpected the market to last."), (3, "Nobody in thetown expected thc market to last beyond theharb0ur."), (4, "Nobody in the town expected the market to\nlast beyond the\nprice."), (5, "The library had replaced the older har\nb0ur before 1850.")]
    got = {}
    for r in scans.damaged(*tables(rows)).filter("record_id < 10000").collect():
        got.setdefault(r.record_id, set()).add(r.noise)
    assert got[1] == {"broken_word"} and got[3] == {"misread"} and 4 not in got and got[5] == {"broken_word", "misread"}
    text = {r.record_id: r.text for r in scans.repaired(*tables(rows)).filter("record_id < 10000").collect()}
    assert text[1] == "The library had replaced the older harbour before 1850. Nobody in the town expected the market to last."
    assert text[3] == "Nobody in the town expected the market to last beyond the harbour."
    assert text[5] == "The library had replaced the older harbour before 1850."


def test_the_cheapest_reading_of_a_stream():
    words = {"the": 6000, "harbour": 300, "bar": 200, "old": 500, "foot": 100, "ball": 100, "football": 120, "was": 900}
    read = lambda text: " ".join(t for t, _ in scans.Scanner(words, {})._read([x.split() for x in text.split("\n")]))
    assert read("the har\nbour was") == "the harbour was"
    assert read("the foot\nball was") == "the foot ball was"
    assert read("the foot-\nball was") == "the football was"
    assert read("theharbour was") == "the harbour was" and read("the harb our was") == "the harbour was"


def test_confusions_in_any_number_and_long_words():
    words = {"the": 6000, "nineteenth": 300, "willingness": 200, "of": 3000, "ministered": 90, "incomprehensibilities" * 3: 50}
    decoder = scans.Decoder(words, {})
    assert decoder.repair("niiictccnfh") is None and decoder.repair("nin3teenth") is None
    assert decoder.repair("ninctccnfh") == "nineteenth" and decoder.repair("0f") == "of" and decoder.repair("e") is None
    assert decoder.repair("incomprchensibilities" * 3) == "incomprehensibilities" * 3
    # so many confusable places that no list of combinations could be made
    assert decoder.repair("1" * 400) is None and decoder.split("c" * 3_000) is None


def test_words_that_stand_too_often_to_be_misread():
    decoder = scans.Decoder({"eat": 900, "cat": 700, "ear": 900, "cvery": 3, "every": 900, "ha1l": 40, "hall": 90}, {})
    assert {"cat", "eat"} <= set(decoder.words) and not {"cvery", "ha1l"} & set(decoder.words)
    assert decoder.stands("car", 100) and not decoder.stands("car", 2)


def test_paragraphs_of_any_number_of_lines():
    assert [len(x) for x in scans.paragraphs_of(["the words of this line go on and on"] * 1_200)] == [1_200]


def test_misread_words_of_heads_are_none_of_the_prose(spark, tables):
    rows = [(1, "Nobody in the town expected the market to last.\nTHF QUlFT HARB0UR\nThe library had replaced the older harbour before 1850."), (2, "l2\nNobody in the town expected the market to last."), (3, "Nobody in the town expected the market to last.\nTHF 0LD PRlCE\nThe library had replaced the older harbour before 1850.")]
    got = {}
    for r in scans.damaged(*tables([(i, t) for i, t in rows])).filter("record_id < 10000").collect():
        got.setdefault(r.record_id, set()).add(r.noise)
    assert got[1] == {"running_head"} and got.get(3) == {"misread"}
