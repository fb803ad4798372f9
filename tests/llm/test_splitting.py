import random

import pytest

from quire.llm import splitting


def test_weakest_boundaries_go_first():
    # segments of 4, 4, 4, 4 words; the paragraph end in the middle stays
    assert splitting.merge_segments([4, 4, 4, 4], [2, 3, 2, 3], 8) == [1, 3]
    assert splitting.merge_segments([4, 4, 4, 4], [3, 2, 3, 3], 8) == [0, 2, 3]
    assert splitting.merge_segments([9], [3], 8) == [0]
    assert splitting.merge_segments([], [], 8) == []


def sentences(rng, n):
    return " ".join(" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(3, 30))) + rng.choice([".", "!", "?”", ","]) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_pieces_rebuild_the_text(seed):
    rng = random.Random(seed)
    paras = [sentences(rng, rng.randint(1, 6)) for _ in range(rng.randint(1, 12))] + [" ".join(f"x{i}" for i in range(200))]
    words = " ".join(paras).split()
    out = splitting.split_text(paras, 0, 60, 10)
    at = 0
    for k, (a, b, o, text) in enumerate(out):
        assert a == at and b > a
        assert text.split() == words[a - o : b]
        assert len(text.split()) <= 60 and o == (min(10, a) if k else 0)
        at = b
    assert at == len(words)


def test_overlap_wider_than_the_limit():
    out = splitting.split_text(["a b c d e f"], 0, 3, 9)
    assert [t.split() for *_, t in out][-1][-1] == "f" and all(len(t.split()) <= 3 for *_, t in out)


def frames(spark, paragraphs, rows, sections=((("b"), 0, 1),), limits=((1, 30, 5),)):
    p = paragraphs(rows)
    s = spark.createDataFrame([(*x, "extra") for x in sections], "book_slug string, section_pos int, level int, words string")
    l = spark.createDataFrame(list(limits), "level int, max_words int, overlap_words int")
    return p, s, l


@pytest.mark.parametrize("block", [20, 50_000])
def test_frame(spark, paragraphs, at, block, monkeypatch):
    monkeypatch.setattr(splitting, "BLOCK_WORDS", block)
    rng = random.Random(3)
    rows = [{"record_id": i, "para_pos": i, "text": sentences(rng, 4)} for i in range(30)]
    rows += [{"record_id": 90, "para_pos": 90, "text": None}, {"record_id": 91, "para_pos": 91, "text": " \n"}]
    rows += [rows[3], {"record_id": 3, "para_pos": 3, "text": "old text " * 400, "ingested_at": at(-5)}]
    rows += [{"record_id": 200, "para_pos": 0, "section_pos": 1, "text": "short one."}, {"record_id": 201, "para_pos": 0, "section_pos": 7, "text": "no section row " * 50}]
    p, s, l = frames(spark, paragraphs, rows, sections=(("b", 0, 1), ("b", 0, 1), ("b", 1, 1), ("b", 5, None)))
    got = splitting.split_sections(p, s, l).collect()
    assert {(r.book_slug, r.section_pos) for r in got} == {("b", 0)}
    words = " ".join(r["text"] for r in rows[:30]).split()
    at_ = 0
    for r in sorted(got, key=lambda r: r.first_word):
        assert r.first_word == at_ and r.text.split() == words[r.first_word - r.overlap : r.end_word] and len(r.text.split()) <= 30
        assert r.overlap == min(5, r.first_word)
        at_ = r.end_word
    assert at_ == len(words)
    assert [tuple(r) for r in splitting.oversized(splitting.split_sections(p, s, l)).collect()] == [("b", 0)]


def test_at_the_limit_and_empty(spark, paragraphs):
    p, s, l = frames(spark, paragraphs, [(1, "w " * 30)])
    assert splitting.split_sections(p, s, l).count() == 0
    p, s, l = frames(spark, paragraphs, [(1, "w " * 31)])
    assert splitting.split_sections(p, s, l).count() >= 2
    assert splitting.split_sections(p.limit(0), s, l).count() == 0
    assert splitting.split_sections(p, s.limit(0), l).count() == 0
    assert splitting.split_sections(p, s, l.limit(0)).count() == 0


def test_null_order_and_null_limits(spark, paragraphs):
    rows = [{"record_id": 1, "para_pos": None, "text": "a " * 20}, {"record_id": 2, "para_pos": 4, "text": "b " * 20, "ingested_at": None}]
    p, s, _ = frames(spark, paragraphs, rows)
    l = spark.createDataFrame([(1, 25, None), (1, 25, None), (2, 0, 3), (None, 9, 9)], "level int, max_words int, overlap_words int")
    got = sorted(splitting.split_sections(p, s, l).collect(), key=lambda r: r.first_word)
    assert sum((r.text.split() for r in got), []) == ["a"] * 20 + ["b"] * 20
