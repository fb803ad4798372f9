import random
import string
from itertools import combinations

import pytest

from quire.llm import spans

LEAST = 100


def brute(texts):
    where = {}
    for i, t in texts.items():
        for k in range(len(t or "") - LEAST + 1):
            where.setdefault(t[k : k + LEAST], set()).add(i)
    pairs, cover = set(), {i: set() for i in texts}
    for w, ids in where.items():
        if len(ids) > 1:
            pairs.update(combinations(sorted(ids), 2))
    for i, t in texts.items():
        for k in range(len(t or "") - LEAST + 1):
            if len(where[t[k : k + LEAST]]) > 1:
                cover[i].update(range(k, k + LEAST))
    return pairs, {i: len(c) for i, c in cover.items()}


def made(seed):
    rng = random.Random(seed)
    rand = lambda n: "".join(rng.choice(string.ascii_lowercase + "  é😀") for _ in range(n))
    shared = [rand(rng.choice([99, 100, 101, 140, 260])) for _ in range(6)]
    texts = {i: "".join(rng.choice([rand(rng.randint(0, 150)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 20) :]]) for _ in range(rng.randint(0, 6))) for i in range(40)}
    texts[50] = texts[51] = rand(400)
    texts[60] = "ab" * 300
    texts[61] = "ab" * 90 + rand(30)
    texts[62] = rand(LEAST - 1)
    return texts


@pytest.mark.parametrize("seed,limit", [(1, 4000), (2, 4000), (3, 1), (4, 3)])
def test_against_brute_force(spark, at, seed, limit, monkeypatch):
    monkeypatch.setattr(spans, "GROUP_LIMIT", limit)
    texts = made(seed)
    df = spark.createDataFrame([(i, at(), t, "x") for i, t in texts.items()], "record_id bigint, at timestamp, text string, node string")
    rep = spans.repeats(df, LEAST)
    pairs, cover = brute(texts)
    assert {tuple(r) for r in spans.pairs(rep).collect()} == pairs
    got = {r.record_id: (r.n_chars, r.shared_chars) for r in spans.shared_share(rep, df).collect()}
    assert got == {i: (len(t), cover[i]) for i, t in texts.items()}


def test_chunks_of_very_long_texts(spark, at, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 300)
    rng = random.Random(9)
    a = "".join(rng.choice(string.ascii_lowercase) for _ in range(2_000))
    texts = {1: a, 2: "zz" + a[650:1_300] + "yy", 3: a[1_950:] + a[:60]}
    df = spark.createDataFrame([(i, at(), t) for i, t in texts.items()], "record_id bigint, at timestamp, text string")
    assert {tuple(r) for r in spans.pairs(spans.repeats(df, LEAST)).collect()} == brute(texts)[0] == {(1, 2)}


def test_newest_rows_nulls_and_nothing(spark, at):
    a, b = "lorem ipsum " * 12, "dolor sit " * 14
    rows = [(1, at(), a), (2, at(5), b), (2, at(1), a), (3, at(), a), (3, at(), a), (4, at(), None), (5, at(), ""), (None, at(), a), (6, None, b)]
    df = spark.createDataFrame(rows, "record_id bigint, at timestamp, text string")
    rep = spans.repeats(df, LEAST)
    assert {tuple(r) for r in spans.pairs(rep).collect()} == {(1, 3), (2, 6)}
    assert {r.record_id: r.shared for r in spans.shared_share(rep, df).collect()} == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0, 5: 0.0, 6: 1.0}
    assert spans.pairs(spans.repeats(df.limit(0), LEAST)).count() == 0
    with pytest.raises(ValueError):
        spans.repeats(df, 50)


@pytest.mark.parametrize("limit", [4000, 2])
def test_spans_are_the_longest_that_the_same_records_share(spark, at, limit, monkeypatch):
    monkeypatch.setattr(spans, "GROUP_LIMIT", limit)
    rng = random.Random(11)
    rand = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    long, short, inner = rand(900), rand(130), rand(101)
    texts = {1: rand(49) + "A" + long + "B" + rand(30), 2: long + "C" + rand(20) + "D" + short, 3: rand(200) + "E" + short + "F", 5: rand(39) + "G" + inner + "H" + rand(300), 6: inner, 7: rand(500), 8: rand(2) + "I" + long, 9: rand(9) + "J" + short[:120]}
    df = spark.createDataFrame([(i, at(), t) for i, t in texts.items()], "record_id bigint, at timestamp, text string")
    got = {(r.first_record, r.start_pos, r.n_chars, r.n_records) for r in spans.spans(spans.repeats(df, LEAST)).collect()}
    # one that more records share in part gives a row for that part
    whole = {(1, 50, 900, 3), (2, 922, 120, 3), (5, 40, 101, 2)}
    assert got >= whole and all(f == 2 and n == 2 and 922 <= a and a + size == 922 + 130 for f, a, size, n in got - whole), got


def test_copies_share_their_nodes(spark, at):
    text = "".join(random.Random(1).choice(string.ascii_lowercase) for _ in range(500))
    df = spark.createDataFrame([(i, at(), text) for i in range(60)], "record_id bigint, at timestamp, text string")
    rep = spans.repeats(df, LEAST)
    assert all(r.n_records == 60 for r in spans.spans(rep).collect())
    assert spans.pairs(rep).count() == 60 * 59 // 2
