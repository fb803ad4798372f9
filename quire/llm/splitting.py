"""Problem 1: sections larger than a limit as overlapping pieces, cut at natural boundaries."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.functions.text import word_count

#: Words of a section that are merged in one block. A section of more is cut between paragraphs every so many words, so that no task holds one whole.
BLOCK_WORDS = 50_000

_WORD = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"[.!?…]+[\"'”’»)\]*_]*$")
_CLAUSE_END = re.compile(r"[,;:—–]$")
#: Strength of the boundary after a word; weaker ones are merged away first.
WORD_END, CLAUSE_END, SENTENCE_END, PARAGRAPH_END = 0, 1, 2, 3


def merge_segments(sizes: list[int], strength: list[int], limit: int) -> list[int]:
    """Cut positions: the segments after which a piece ends, the last one included.

    ``strength[i]`` is that of the boundary after segment i. Adjacent pairs
    wait in a heap; the weakest boundary goes first, of equal ones the pair
    with the smallest sum, of these the earliest, as long as the sum keeps
    within ``limit``. A segment over the limit stays alone.
    """
    n = len(sizes)
    size, nxt, prv = list(sizes), list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(n))
    heap = [(strength[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1) if size[i] + size[i + 1] <= limit]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, total, a, b = heapq.heappop(heap)
        if not alive[a] or not alive[b] or nxt[a] != b or size[a] + size[b] != total:
            continue
        alive[b] = False
        size[a], end[a], nxt[a] = total, end[b], nxt[b]
        if nxt[a] < n:
            prv[nxt[a]] = a
        for x, y in ((prv[a], a), (a, nxt[a])):
            if x >= 0 and y < n and size[x] + size[y] <= limit:
                heapq.heappush(heap, (strength[end[x]], size[x] + size[y], x, y))
    return [end[i] for i in range(n) if alive[i]]


def split_text(paragraphs: list[str], own_from: int, max_words: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(first word, end word, overlapping words, text) of each piece; word numbers count from the first own paragraph.

    ``own_from`` is the number of leading paragraphs that only lend their last
    words to the overlap. Pieces have at most ``max_words`` words with their
    overlap, which is the ``overlap`` words before them, or as many as there
    are.
    """
    overlap = max(0, min(overlap, max_words - 1))
    limit = max_words - overlap
    text = "\n\n".join(paragraphs)
    spans: list[tuple[int, int]] = []
    last_of: list[int] = []
    base = 0
    first_own = 0
    for k, p in enumerate(paragraphs):
        if k == own_from:
            first_own = len(spans)
        spans += [(base + m.start(), base + m.end()) for m in _WORD.finditer(p)]
        last_of.append(len(spans) - 1)
        base += len(p) + 2
    if own_from >= len(paragraphs):
        return []
    ends = set(last_of)
    sizes, strength, stops = [], [], []
    size = 0
    for w in range(first_own, len(spans)):
        size += 1
        if w in ends:
            s = PARAGRAPH_END
        else:
            word = text[spans[w][0] : spans[w][1]]
            s = SENTENCE_END if _SENTENCE_END.search(word) else CLAUSE_END if _CLAUSE_END.search(word) else WORD_END
        if s >= CLAUSE_END or size == limit:
            sizes.append(size)
            strength.append(s)
            stops.append(w + 1)
            size = 0
    out = []
    start = first_own
    for cut in merge_segments(sizes, strength, limit):
        stop = stops[cut]
        lead = max(0, start - overlap)
        out.append((start - first_own, stop - first_own, start - lead, text[spans[lead][0] : spans[stop - 1][1]]))
        start = stop
    return out


def split_sections(paragraphs: DataFrame, sections: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every section over the limit of its level.

    (book_slug, section_pos, level, max_words, block, piece, first_word,
    end_word, overlap, text), in order of first_word; block and piece number
    them, first by stretches of ``BLOCK_WORDS`` words.

    Of the rows of one record the newest holds. A null, empty or blank text
    has no words and gives nothing; null positions come before others.
    Sections without a row, a level or a limit for it, and those within the
    limit, are not split. Rows that repeat a section or a level count once,
    the least level or the least limit of them. The stated word counts are
    not used. Further columns are not read.
    """
    held = (
        paragraphs.select("record_id", "ingested_at", "book_slug", "section_pos", "para_pos", word_count(F.col("text")).alias("n"))
        .groupBy("record_id")
        .agg(F.max_by(F.struct("ingested_at", "book_slug", "section_pos", "para_pos", "n"), F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0)))).alias("h"))
        .select("record_id", "h.*")
        .filter(F.col("n") > 0)
    )
    levels = sections.groupBy("book_slug", "section_pos").agg(F.min("level").alias("level"))
    rule = limits.filter("max_words > 0").groupBy("level").agg(F.min(F.struct("max_words", "overlap_words")).alias("r")).select("level", "r.*")
    own = Window.partitionBy("book_slug", "section_pos")
    before = own.orderBy(F.col("para_pos").asc_nulls_first(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy("book_slug", "section_pos").agg(F.sum("n").alias("words"))
    large = (
        totals.join(levels, ["book_slug", "section_pos"])
        .join(rule, "level")
        .filter(F.col("words") > F.col("max_words"))
        .select("book_slug", "section_pos", "level", "max_words", F.coalesce("overlap_words", F.lit(0)).alias("overlap_words"))
    )
    size = F.greatest(F.lit(BLOCK_WORDS), F.col("max_words") * 20)
    start, end = F.col("start"), F.col("start") + F.col("n")
    placed = (
        held.join(large, ["book_slug", "section_pos"])
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("mine", F.floor(start / size))
        .withColumn("block", F.explode(F.array_distinct(F.array(F.col("mine"), F.floor(end / size), F.floor((end + F.col("overlap_words")) / size)))))
        .withColumn("lent", F.col("mine") != F.col("block"))
        .select("record_id", "ingested_at", "book_slug", "section_pos", "level", "max_words", "overlap_words", "block", "start", "lent")
    )
    texts = paragraphs.select("record_id", F.col("ingested_at").alias("at"), "text")
    same = (texts["record_id"] == placed["record_id"]) & texts["at"].eqNullSafe(placed["ingested_at"])
    grouped = (
        placed.join(texts, same)
        .select("book_slug", "section_pos", "level", "max_words", "overlap_words", "block", F.struct(~F.col("lent"), "start", "text").alias("s"))
        .groupBy("book_slug", "section_pos", "level", "max_words", "overlap_words", "block")
        .agg(F.array_sort(F.collect_set("s")).alias("s"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["book_slug", "section_pos", "level", "max_words", "block", "piece", "first_word", "end_word", "overlap", "text"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                out: list[tuple] = []
                for r in batch.slice(k, 64).to_pylist():
                    segs = [tuple(s.values()) for s in r["s"]]
                    lent = sum(not own for own, _, _ in segs)
                    if lent == len(segs):
                        continue
                    base = segs[lent][1]
                    for n, (a, b, o, text) in enumerate(split_text([t for _, _, t in segs], lent, r["max_words"], r["overlap_words"])):
                        out.append((r["book_slug"], r["section_pos"], r["level"], r["max_words"], r["block"], n, base + a, base + b, o, text))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return grouped.mapInArrow(run, "book_slug string, section_pos int, level int, max_words int, block bigint, piece int, first_word bigint, end_word bigint, overlap int, text string")


def oversized(pieces: DataFrame) -> DataFrame:
    """(book_slug, section_pos) of the sections that needed more than one piece."""
    words = F.max("end_word") - F.min("first_word")
    return pieces.groupBy("book_slug", "section_pos", "max_words").agg(words.alias("words")).filter(F.col("words") > F.col("max_words")).select("book_slug", "section_pos")
