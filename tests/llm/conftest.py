import datetime as dt

import pytest

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def at():
    return lambda minutes=0: T0 + dt.timedelta(minutes=minutes)


PARAGRAPH = "record_id bigint, book_slug string, para_pos int, section_pos int, text string, page_start int, page_end int, ingested_at timestamp"


@pytest.fixture
def paragraphs(spark, at):
    """A frame of (record_id, text) or dicts; each its own paragraph of book b, section 0."""

    def make(rows, **defaults):
        out = []
        for i, r in enumerate(rows):
            r = dict(zip(("record_id", "text"), r)) if isinstance(r, tuple) else r
            d = {"record_id": i, "book_slug": "b", "para_pos": i, "section_pos": 0, "text": None, "page_start": 1, "page_end": 1, "ingested_at": at()} | defaults | r
            out.append(tuple(d[c.split()[0]] for c in PARAGRAPH.split(", ")))
        return spark.createDataFrame(out, PARAGRAPH)

    return make
