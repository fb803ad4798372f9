import random
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from quire.llm import packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_best_fit(sizes):
    where = packing.best_fit(sizes, [1] * len(sizes), 50)
    fill = defaultdict(int)
    for s, b in zip(sizes, where):
        fill[b] += s
    assert all(f <= 50 for f in fill.values())
    # no two bins could be one: best fit opens a bin only when no other has room
    low = sorted(fill.values())[:2]
    assert len(low) < 2 or sum(low) > 50 or 0 in sizes


def check(rows, docs, capacity):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.container].append(r)
    for i, n in docs:
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.size for r in mine) == (n or 0)
        assert len(mine) == max(1, -(-(n or 0) // capacity))
        at = 0
        for r in mine:
            assert r.first_token == at
            at += r.size
    for bin_rows in by_bin.values():
        bin_rows.sort(key=lambda r: r.place)
        assert [r.place for r in bin_rows] == list(range(len(bin_rows)))
        at = 0
        for r in bin_rows:
            assert r.start == at
            at += r.size
        assert at <= capacity
    return len(by_bin)


@pytest.mark.parametrize("tasks", [1, 3, 20])
def test_pack_in_rounds(spark, tasks, monkeypatch):
    rng = random.Random(tasks)
    docs = [(i, rng.choice([0, None, rng.randint(1, 900), rng.randint(1, 90), 2_500])) for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id bigint, n_tokens int")
    rows = packing.pack(df, 1_000, tasks=tasks).collect()
    bins = check(rows, docs, 1_000)
    least = -(-sum(n or 0 for _, n in docs) // 1_000)
    assert bins <= least * 1.06 + 2
    again = packing.pack(df, 1_000, tasks=tasks).collect()
    assert {(r.doc_id, r.piece, r.container, r.place) for r in rows} == {(r.doc_id, r.piece, r.container, r.place) for r in again}


def test_the_layout_of_the_input_does_not_matter(spark):
    rng = random.Random(7)
    docs = [(rng.choice([None, i]), rng.randint(0, 700)) for i in range(900)] + [(5, 20)] * 3
    df = spark.createDataFrame(docs, "doc_id bigint, n_tokens int")
    one, other = ({(r.doc_id, r.piece, r.size, r.container, r.place, r.start) for r in packing.pack(df.repartition(n), 1_000, tasks=4).collect()} for n in (2, 7))
    assert one == other and len(one) == len(docs)


def test_bins_that_nothing_fits_into(spark, monkeypatch):
    """All underfull, more than one task should hold: they stay in several tasks, whole."""
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 40)
    docs = [(i, 600 + i % 7) for i in range(400)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id bigint, n_tokens int"), 1_000).collect()
    assert check(rows, docs, 1_000) == 400


def test_many_empty_documents_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_BIN", 50)
    docs = [(i, 0) for i in range(400)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id bigint, n_tokens int"), 10, tasks=1).collect()
    check(rows, docs, 10)


def test_null_keys_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, 5, 1), (1, 5, 2), (1, 5, 3)], "doc_id bigint, n_tokens int, size int")
    rows = packing.pack(df, 6).collect()
    assert len(rows) == 3 and len({r.container for r in rows}) == 3
    assert packing.pack(df.limit(0), 6).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_fills(spark):
    df = spark.createDataFrame([(1, 6), (2, 4), (3, 25)], "doc_id bigint, n_tokens int")
    f = packing.fills(packing.pack(df, 10), 10).collect()
    assert sorted(r.fill for r in f) == [0.5, 1.0, 1.0, 1.0] and sum(r.tokens for r in f) == 35
