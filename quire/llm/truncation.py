"""Problem 2: texts that were cut off, and how often each source cuts.

A backward character n-gram model, trained on all texts, gives for the last
characters of a text the odds that a sentence or an entry ends there rather
than goes on; lists, tables, quotes and prose are told apart. The final context of a value,
without the mark a cut may have left, is held against thresholds that are
calibrated for each language on blocks whose end is beyond doubt.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from quire.llm.language import LANGUAGES, detect
from quire.session import materialize

#: Longest context in characters. Sentences need fewer characters than entries to tell an end.
ORDER, SENTENCE_ORDER = 6, 4
#: Weight of the shorter context in a longer one's estimate.
BACKOFF = 2.0
#: Log-odds (natural) that part ends from stops where a language has too few blocks to calibrate.
THRESHOLD = -3.0
ENOUGH_BLOCKS = 200
#: Bins of log-odds for the calibration.
_LOW, _HIGH, _BINS = -16.0, 16.0, 320

#: An entry goes on after a word that stands before another one rather than at an end so many times as often as words do, even if OPEN_DOUBT of its ends went unseen (what no sighting in any number leaves possible at 95 %).
OPEN_RATIO, OPEN_DOUBT = 20.0, 3.0
#: Words that no entry ends with (fixed values).
OPEN_WORDS = frozenset("and or nor the a an of from with into than whose und oder der das ein eine einen einem einer eines vom zum zur et ou le la les un une du des aux y e o el los las unos unas del al con".split())
#: Share of complete words that the threshold for words may take for halves.
WORD_MISSED = 0.0005

TYPES = ("prose", "heading", "bullet", "number", "row", "quote", "source", "fence", "note", "word")
_TYPE = {t: i for i, t in enumerate(TYPES)}

#: What a cut may leave at the end (fixed values).
_MARK = regex.compile(r"(?:\s*(?:…|\.{3,}|\.\s\.\s\.|\[\s*(?:…|\.{3,}|cut|truncated|continued)\s*\]|\(\s*(?:…|\.{3,}|cut|truncated|continued)\s*\)|<(?:cut|truncated|eos|/s|\|endoftext\|)>?|\\|�+))+\s*$", regex.I)
_MARK_ENDS = frozenset("…])>\\\ufffd+")
_OPEN_CITATION = regex.compile(r"\s*\[[^\[\]\n]{0,60}$")
_CLOSED_CITATION = regex.compile(r"\s*\[p:[a-f0-9-]+\]\s*$")
#: The end of a sentence that another one follows.
_SENTENCE_END = regex.compile(r"[.!?…][\"'”’»)\]*_]*(?=\s+[\p{Lu}\p{Nd}“\"‘'(\[«„*_¿¡])")
#: Abbreviations whose full stop ends no sentence (fixed values).
_ABBREVIATED = regex.compile(r"(?<![\p{L}.])(?:cf|approx|fig|figs|i\.e|e\.g|no|nos|vs|dr|mr|mrs|ms|prof|st|vol|vols|pp|p|ch|sec|eq|ca|resp|incl|esp|viz|ed|eds|trans|bzw|z\.B|d\.h|vgl|usw|p\.ex|págs?|núm|bspw)\.$", regex.I)
_FINAL = regex.compile(r"[.!?…][\"'”’»)\]*_]*$")
_SENTENCES = ("prose", "quote", "note")
_ENTRIES = ("bullet", "number", "source")
_LAST_WORD = regex.compile(r"[\p{L}\p{M}\p{N}'’-]+$")
_NUMBERED = regex.compile(r"\(?\p{Nd}{1,3}[.)]\s")


def line_type(line: str) -> str:
    if line.startswith("#"):
        return "heading"
    if line[:2] in ("- ", "* ", "+ ", "• "):
        return "bullet"
    if _NUMBERED.match(line):
        return "number"
    if line.startswith("|"):
        return "row"
    if line.startswith(">"):
        return "source" if regex.match(r">\s*[—–-]", line) else "quote"
    if line[:1] in "*_" and line[:2] not in ("**", "__"):
        return "note"
    return "prose"


def blocks(text: str) -> tuple[list[tuple[str, str]], bool]:
    """((type, text) of each block, whether a code fence is left open). Lines of prose make one block, all others one each."""
    out: list[tuple[str, str]] = []
    fence = False
    run: list[str] = []

    def close() -> None:
        if run:
            out.append(("prose", " ".join(run)))
            run.clear()

    for line in text.splitlines():
        s = line.strip()
        if s.startswith("```"):
            close()
            fence = not fence
            out.append(("fence", s))
        elif fence:
            if s:
                out.append(("fence", s))
        elif not s:
            close()
        else:
            kind = line_type(s)
            if kind == "prose":
                run.append(s)
            else:
                close()
                out.append((kind, s))
    close()
    return out, fence


def ending(text: str) -> tuple[list[tuple[str, str]], bool, bool]:
    """(blocks, the last one without marks of a cut; whether there was such a mark; whether something was left open).

    Left open are a code fence, a citation, an emphasis that nothing follows,
    and a character cut in its bytes.
    """
    body = text.rstrip()
    opened = False
    m = _OPEN_CITATION.search(body, max(0, len(body) - 80)) if "[" in body[-62:] else None
    if m and m[0].lstrip()[:2] in ("[p", "[") or m and regex.match(r"\s*\[p?:", m[0]):
        body, opened = body[: m.start()].rstrip(), True
    bare = body
    m = _MARK.search(body) if body[-1:] in _MARK_ENDS or body.endswith(("...", ". .")) else None
    if m and m.start():
        body = body[: m.start()].rstrip()
    if body.endswith("**") and body.count("**") % 2:
        body, opened = body[:-2].rstrip(), True
    marked = body != bare
    opened = opened or "\ufffd" in bare[-2:]
    found, fence = blocks(body)
    return found, marked, opened or fence


def _context(kind: str, block: str) -> str:
    """What the model sees of a block: a citation at its end is no part of its sentence."""
    return (_CLOSED_CITATION.sub("", block) or block) if block.rstrip().endswith("]") else block


#: A context is packed in 62 bits: kind of block (4), the last characters (9 each, the last one first), language (2), whether it ends there, whether a space follows.
_SYMBOL, _FLAGS = 9, 4
#: Characters laid out at once, and distinct contexts and words a task holds before it passes them on.
CHUNK, HELD = 200_000, 1_000_000


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each character of the basic plane, the last one for those beyond; whether a symbol is a letter).

    Latin-1 is exact; other letters share 192 symbols, other signs 64.
    """
    codes = np.arange(0x10001, dtype=np.int64)
    letter = np.array([chr(c).isalpha() for c in range(0x10000)] + [True])
    spread = codes * 2654435761 % (1 << 32) >> 16
    table = np.where(codes < 256, codes, np.where(letter, 256 + spread % 192, 448 + spread % 64))
    return table, np.concatenate([letter[:256], np.arange(256, 512) < 448])


def _laid_out(found: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, kinds, is text, is end) of blocks one after the other, each behind padding as long as a context.

    A block ends at its last character, and where it is made of sentences at
    the last one of each.
    """
    pad = "\x02" * ORDER
    texts = [pad + _context(k, b) for k, b in found]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.array([len(t) for t in texts])
    kinds = np.repeat(np.array([_TYPE[k] for k, _ in found]), lens)
    stops = np.cumsum(lens)
    inside = np.ones(len(codes), dtype=bool)
    for k in range(ORDER):
        inside[stops - lens + k] = False
    end = np.zeros(len(codes), dtype=bool)
    end[stops - 1] = True
    for (kind, _), t, stop in zip(found, texts, stops.tolist()):
        if kind in _SENTENCES:
            for m in _SENTENCE_END.finditer(t):
                at = m.start()
                # no abbreviation has seven letters
                if t[at] == "." and not t[at - 7 : at].isalpha() and _ABBREVIATED.search(t, max(0, at - 8), m.end()):
                    continue
                # the quotation marks and brackets after it are part of the end
                end[stop - len(t) + at : stop - len(t) + m.end()] = True
            m = _FINAL.search(t, max(0, len(t) - 16))
            if m:
                end[stop - len(m[0]) : stop] = True
    return codes, kinds, inside, end


class Counts:
    """Contexts and words of many texts with their counts, in bounded memory."""

    def __init__(self) -> None:
        self.table, self.letters = _symbols()
        self.keys: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.waiting = 0
        #: How often a token stands in sentences, in entries, at the end of a sentence without a mark, and of an entry.
        self.tokens: tuple[Counter, Counter, Counter, Counter] = (Counter(), Counter(), Counter(), Counter())

    @staticmethod
    def packed(symbols: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Kind and last characters of each position."""
        key = kinds.astype(np.int64) << _SYMBOL * ORDER
        for n in range(ORDER):
            key[n:] |= symbols[: len(symbols) - n] << _SYMBOL * (ORDER - 1 - n)
        return key

    def last(self, kind: str, block: str) -> tuple[int, int | None]:
        """(the packed last context of a block, the same as that of a word, None where no letter is last)."""
        tail = "\x02" * ORDER + _context(kind, block)
        codes = np.frombuffer(tail[-ORDER:].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        key = _TYPE[kind] << _SYMBOL * ORDER
        for n, symbol in enumerate(self.table[np.minimum(codes, 0x10000)].tolist()):
            key |= symbol << _SYMBOL * n
        return key, (key & ((1 << _SYMBOL * ORDER) - 1) | _TYPE["word"] << _SYMBOL * ORDER if tail[-1].isalpha() else None)

    def add(self, found: list[tuple[str, str]], final: list[int], langs: list[int]) -> None:
        """Count blocks; ``final`` are the last ones of their texts, ``langs`` the languages of all."""
        codes, kinds, inside, end = _laid_out(found)
        lens = [ORDER + len(_context(*b)) for b in found]
        stops = np.cumsum(lens) - 1
        # whether the last sentence or entry of a text ends is the question, not evidence
        for i in final:
            k = int(stops[i])
            inside[k] = False
            while end[k]:
                end[k] = inside[k] = False
                k -= 1
        lang = np.repeat(np.array(langs, dtype=np.int64), lens)
        symbols = self.table[np.minimum(codes, 0x10000)]
        letter = self.letters[symbols] & inside
        follows = np.full(len(codes), 2)
        follows[:-1] = np.where(letter[1:], 0, np.where((codes[1:] == 32) & inside[1:], 1, 2))
        for a in range(0, len(codes), 2 * CHUNK):
            b = a + 2 * CHUNK
            begin = max(0, a - ORDER)
            key = self.packed(symbols[begin:b], kinds[begin:b])[a - begin :]
            self._count((key << 5 | lang[a:b] << 3 | end[a:b].astype(np.int64) << 2 | follows[a:b])[inside[a:b]])
        for i, (kind, block) in enumerate(found):
            entry = kind in _ENTRIES
            if entry or kind in _SENTENCES:
                words = _context(kind, block).split()
                w = words.pop() if words else ""
                if i not in final and (entry or w and not w[-1].isalnum()):
                    self.tokens[3 if entry else 0][w] += 1
                self.tokens[entry].update(words)

    def _count(self, keys: np.ndarray) -> None:
        got = pc.value_counts(pa.array(keys))
        self.keys.append(got.field("values").to_numpy())
        self.numbers.append(got.field("counts").to_numpy())
        self.waiting += len(got)
        if self.waiting > HELD:
            self._merge()

    def _merge(self) -> None:
        if self.keys:
            t = pa.table({"k": np.concatenate(self.keys), "n": np.concatenate(self.numbers)}).group_by("k").aggregate([("n", "sum")])
            self.keys, self.numbers = [t["k"].to_numpy()], [t["n_sum"].to_numpy()]
            self.waiting = 0

    def full(self) -> bool:
        return sum(map(len, self.keys)) > HELD or sum(map(len, self.tokens)) > HELD

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """(packed contexts with their flags, counts): each position as one of its block, letters as one of a word too."""
        self._merge()
        if not self.keys:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        key, n = self.keys[0], self.numbers[0]
        self.keys, self.numbers = [], []
        context, lang, end, follows = key >> 5, key >> 3 & 3, key >> 2 & 1, key & 3
        block = context << _FLAGS | lang << 2 | end << 1 | ((follows == 1) & (end == 0))
        letter = self.letters[context >> _SYMBOL * (ORDER - 1) & 511]
        word = (context & ((1 << _SYMBOL * ORDER) - 1) | _TYPE["word"] << _SYMBOL * ORDER) << _FLAGS | lang << 2 | (follows != 0).astype(np.int64) << 1
        return np.concatenate([block, word[letter]]), np.concatenate([n, n[letter]])

    def words(self) -> list[tuple[str, bool, int, int]]:
        """(word, in entries, how often, how often at an end): a mark after a word is an end, and so is the end of an entry."""
        out: dict[tuple[str, bool], list[int]] = {}
        for of, counts in enumerate(self.tokens):
            for t, n in counts.items():
                word = t.strip(_WORD_MARKS).lower()
                if word and word[-1].isalpha():
                    row = out.setdefault((word, of in (1, 3)), [0, 0])
                    row[0] += n
                    if of == 3 or not t[-1].isalnum() and t[-1] not in "-*_":
                        row[1] += n
            counts.clear()
        return [(w, e, n, k) for (w, e), (n, k) in out.items()]


_WORD_MARKS = "\"'“”‘’„«»()[]<>.,;:?!…*_—–-"
_BY_SENTENCE = [_TYPE[t] for t in _SENTENCES]

#: What the one pass over the texts gives: rows of records, of contexts and of words.
_ROW = "what string, language string, kind int, context bigint, word_context bigint, marked boolean, opened boolean, closed boolean, unfinished boolean, unclosed boolean, word string, n bigint, ends bigint"


def _read(held: DataFrame) -> DataFrame:
    """One pass over (key, source, text): what the end of each text looks like, and the counts of all contexts and words."""
    kinds = [held.schema[c].dataType.simpleString() for c in held.columns[:2]]
    names = ["key", "source", *[c.split()[0] for c in _ROW.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        schema: pa.Schema | None = None

        def rows(size: int, **columns: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        def counted() -> Iterator[pa.RecordBatch]:
            keys, n = counts.contexts()
            yield rows(len(keys), what=["context"] * len(keys), context=keys, n=n)
            words = counts.words()
            yield rows(len(words), what=["entry" if w[1] else "sentence" for w in words], word=[w[0] for w in words], n=[w[2] for w in words], ends=[w[3] for w in words])

        for batch in batches:
            if schema is None:
                s, i, b, t = pa.string(), pa.int32(), pa.bool_(), pa.int64()
                schema = pa.schema(list(zip(names, [batch.column(0).type, batch.column(1).type, s, s, i, t, t, b, b, b, b, b, s, t, t])))
            out: dict[str, list] = {c: [] for c in names[3:13]}
            found: list[tuple[str, str]] = []
            final: list[int] = []
            langs: list[int] = []
            size = 0
            for text in batch.column(2).to_pylist():
                for c in out.values():
                    c.append(None)
                if not text or not text.strip():
                    out["marked"][-1] = out["opened"][-1] = False
                    continue
                lang = _language(text)
                own, marked, opened = ending(text)
                for c, v in (("language", lang), ("marked", marked), ("opened", opened)):
                    out[c][-1] = v
                if not own:
                    continue
                kind, block = own[-1]
                context, word_context = counts.last(kind, block)
                last = _LAST_WORD.search(block[-200:])
                for c, v in (
                    ("kind", _TYPE[kind]),
                    ("context", context),
                    ("word_context", word_context),
                    ("closed", (kind == "row" and block.endswith("|")) or (kind == "note" and len(block) > 2 and block[0] == block[-1])),
                    ("unfinished", kind == "prose" and (block[-1] in ",;(" or _ABBREVIATED.search(block[-16:]) is not None)),
                    ("unclosed", kind in _ENTRIES and block.count("(") > block.count(")")),
                    ("word", last[0].lower() if last and kind in _ENTRIES and word_context is not None else None),
                ):
                    out[c][-1] = v
                found += own
                final.append(len(found) - 1)
                langs += [LANGUAGES.index(lang)] * len(own)
                size += len(text)
                if size > CHUNK:
                    counts.add(found, final, langs)
                    found, final, langs, size = [], [], [], 0
            if found:
                counts.add(found, final, langs)
            yield rows(batch.num_rows, key=batch.column(0), source=batch.column(1), what=["record"] * batch.num_rows, **out)
            if counts.full():
                yield from counted()
        if schema is not None:
            yield from counted()

    return held.mapInArrow(run, f"key {kinds[0]}, source {kinds[1]}, {_ROW}")


def _first_odds(read: DataFrame) -> tuple[float, dict[int, tuple[int, int]]]:
    """(share of ends among all positions, (positions, ends) by kind and last character): at most 16 x 512 rows."""
    key = F.col("context")
    rows = read.filter("what = 'context'").groupBy(F.shiftright(key, _FLAGS + _SYMBOL * (ORDER - 1)).alias("k")).agg(F.sum("n").alias("n"), F.sum(F.when(key.bitwiseAND(2) > 0, F.col("n")).otherwise(0)).alias("e")).collect()
    return (sum(r["e"] for r in rows) + 0.5) / (sum(r["n"] for r in rows) + 1.0), {r["k"]: (r["n"], r["e"]) for r in rows}


def _nearer(p: np.ndarray, e: np.ndarray, t: np.ndarray, own_end: int, own: int) -> np.ndarray:
    """The share of ends after a longer context, where ``p`` is that of the shorter one, without a sighting's own count."""
    e = np.maximum(0.0, e - own_end)
    t = np.maximum(e, t - own)
    return (e + BACKOFF * p) / (t + BACKOFF)


def _odds(key: np.ndarray, n: np.ndarray, base: float, first: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(odds, odds without the own count) that a block ends after each of some sorted contexts rather than goes on (natural logarithms).

    The share of ends among all sightings; each shorter context stands in for
    sightings the longer one lacks. All contexts with the same last two
    characters have to be there.
    """
    end = key >> 1 & 1
    ends = n * end
    k1 = key >> _FLAGS + _SYMBOL * (ORDER - 1)
    t1, e1 = (np.array([first.get(k, (0, 0))[i] for k in k1[np.flatnonzero(np.diff(k1, prepend=-1))].tolist()]) for i in (0, 1))
    place = np.cumsum(np.diff(k1, prepend=-1) != 0) - 1
    p, q = _nearer(base, e1[place], t1[place], 0, 0), _nearer(base, e1[place], t1[place], end, 1)
    sentence = np.isin(key >> _FLAGS + _SYMBOL * ORDER, _BY_SENTENCE)
    for order in range(2, ORDER + 1):
        k = key >> _FLAGS + _SYMBOL * (ORDER - order)
        starts = np.flatnonzero(np.diff(k, prepend=-1))
        place = np.cumsum(np.diff(k, prepend=-1) != 0) - 1
        t, e = np.add.reduceat(n, starts)[place], np.add.reduceat(ends, starts)[place]
        longer, other = _nearer(p, e, t, 0, 0), _nearer(q, e, t, end, 1)
        p, q = (longer, other) if order <= SENTENCE_ORDER else (np.where(sentence, p, longer), np.where(sentence, q, other))
    p, q = np.clip(p, 1e-7, 1 - 1e-7), np.clip(q, 1e-7, 1 - 1e-7)
    return np.log(p / (1 - p)), np.log(q / (1 - q))


def _scored(read: DataFrame) -> DataFrame:
    """Rows (context, odds) of the contexts that texts end with, and rows (language, side, place, n) that count those of all others by their odds.

    ``side`` is 1 for ends of sentences and entries, 0 for places between
    words within them, 2 for ends of words; ``place`` is the bin of the odds
    without the own count. Every task has added up its own contexts; all that
    share their last two characters meet in one partition, where memory grows
    with the distinct ones.
    """
    base, first = _first_odds(read)
    finals = read.filter("what = 'record' and context is not null")
    asked = finals.select(F.explode(F.array("context", "word_context")).alias("c")).filter("c is not null").distinct()
    rows = read.filter("what = 'context'").select("context", "n").unionByName(asked.select(F.shiftleft("c", _FLAGS).alias("context"), F.lit(0).cast("bigint").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = limit = 0

        for batch in batches:
            n = batch.column(1)
            held.append(pa.table({"k": batch.column(0), "n": n, "least": n}))
            size += batch.num_rows
            if size > HELD + 2 * limit:
                t = pa.concat_tables(held).group_by("k").aggregate([("n", "sum"), ("least", "min")]).rename_columns(["k", "n", "least"])
                held, size, limit = [t], len(t), len(t)
        if not size:
            return
        t = pa.concat_tables(held).group_by("k").aggregate([("n", "sum"), ("least", "min")]).sort_by("k")
        key, n, least = (t[c].to_numpy() for c in ("k", "n_sum", "least_min"))
        odds, other = _odds(key, n, base, first)
        want = least == 0
        kind, lang, end, spaced = key >> _FLAGS + _SYMBOL * ORDER, key >> 2 & 3, key >> 1 & 1, key & 1
        word = kind == _TYPE["word"]
        side = np.where(word, np.where(end == 1, 2, 3), np.where(kind == _TYPE["heading"], 3, np.where(end == 1, 1, np.where(spaced == 1, 0, 3))))
        place = np.clip((other - _LOW) / (_HIGH - _LOW) * _BINS, 0, _BINS - 1).astype(np.int64)
        hist = np.bincount((lang * 4 + side) * _BINS + place, weights=n, minlength=16 * _BINS)
        hit = np.flatnonzero(hist)
        hit = hit[hit // _BINS % 4 != 3]
        names = ["context", "odds", "language", "side", "place", "n"]
        some = int(want.sum())
        yield pa.RecordBatch.from_arrays([pa.array(key[want] >> _FLAGS), pa.array(odds[want])] + [pa.nulls(some, pa.int32())] * 3 + [pa.nulls(some, pa.int64())], names=names)
        numbers = [pa.array(x.astype(np.int32)) for x in (hit // _BINS // 4, hit // _BINS % 4, hit % _BINS)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(hit), pa.int64()), pa.nulls(len(hit), pa.float64()), *numbers, pa.array(hist[hit].astype(np.int64))], names=names)

    return rows.repartition(F.shiftright("context", _FLAGS + _SYMBOL * (ORDER - 2))).mapInArrow(run, "context bigint, odds double, language int, side int, place int, n bigint")


def _thresholds(scored: DataFrame) -> dict[str, tuple[float, float]]:
    """(threshold for sentences and closed entries, for words) of each language.

    For each language the threshold with the fewest errors on all that was
    counted: ends of sentences and entries against places between words
    within them; and for words the least odds that nearly all complete ones
    have.
    """
    # languages x 3 x bins rows at most
    rows = scored.filter("side is not null").groupBy("language", "side", "place").agg(F.sum("n").alias("n")).collect()
    hist = np.zeros((len(LANGUAGES), 3, _BINS))
    for r in rows:
        hist[r["language"], r["side"], r["place"]] = r["n"]
    out = {}
    for i, lang in enumerate(LANGUAGES):
        goes_on, ends, words = hist[i]
        if ends.sum() < ENOUGH_BLOCKS or goes_on.sum() == 0:
            out[lang] = THRESHOLD, THRESHOLD
            continue
        missed = np.concatenate([[0.0], np.cumsum(ends)]) / ends.sum()  # ends under the threshold
        taken = np.concatenate([[goes_on.sum()], goes_on.sum() - np.cumsum(goes_on)]) / goes_on.sum()
        error = missed + taken
        best = np.flatnonzero(error <= error.min() + 1e-4)
        least = int(np.searchsorted(np.cumsum(words), WORD_MISSED * words.sum()))
        out[lang] = tuple(float(_LOW + x * (_HIGH - _LOW) / _BINS) for x in (best.mean(), least))
    return out


def _open_words(read: DataFrame) -> DataFrame:
    """(word, open, open_name) of the words that entries end with: whether an entry goes on after it, by how often it ends one, and for lack of sightings by sentences too.

    ``open_name`` is the answer for names, as any of their words may be a first or a last one.
    """
    counted = read.filter("what in ('sentence', 'entry')")
    entry, sentence = F.col("what") == "entry", F.col("what") == "sentence"
    sums = [F.coalesce(F.sum(F.when(of, c)), F.lit(0)).alias(name) for name, of, c in (("entry_ends", entry, F.col("ends")), ("entry_on", entry, F.col("n") - F.col("ends")), ("ends", F.lit(True), F.col("ends")), ("goes_on", F.lit(True), F.col("n") - F.col("ends")))]
    every = counted.agg(*sums).first()
    asked = read.filter("what = 'record' and word is not null").select("word").distinct()
    own = asked.join(counted.groupBy("word").agg(*sums), "word", "left").na.fill(0)
    known = F.col("word").isin(sorted(OPEN_WORDS))
    if min(every["entry_on"], every["entry_ends"]) < 1:
        return own.select("word", known.alias("open"), known.alias("open_name"))
    on, ends = F.col("entry_on") / every["entry_on"], F.col("entry_ends")
    by_entries = on >= OPEN_RATIO * (ends + OPEN_DOUBT) / every["entry_ends"]
    # too few sightings in entries: with those in sentences, if the entries do not speak against it
    by_all = (F.col("goes_on") / every["goes_on"] >= OPEN_RATIO * (F.col("ends") + OPEN_DOUBT) / every["ends"]) & (on >= OPEN_RATIO * ends / every["entry_ends"])
    return own.select("word", (known | by_entries | by_all).alias("open"), known.alias("open_name"))


def _language(text: str) -> str:
    return detect(text.lower().split())


def cut_records(df: DataFrame, key: str = "record_id", text: str = "body_md", at: str = "written_at", source: str = "provider") -> DataFrame:
    """(key, source, language, log_odds, marked, opened, cut) for every record's newest text.

    ``cut`` is true where the text stops inside a word or a sentence: where
    its last block would not end there by the calibrated odds, or where a code
    fence, a citation or an emphasis is left open. ``marked`` tells of an
    ellipsis or the like, which alone is no cut. Null, empty and blank texts
    are not cut and have null odds. Rows tied on ``at`` are taken as
    identical; a null source stays null. Word counts and rounds as stated are
    not used. The texts are read once; what is joined and added up afterwards
    are ends of texts and distinct contexts.
    """
    time = F.coalesce(F.col(at).cast("timestamp"), F.timestamp_seconds(F.lit(-(10**10))))
    held = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"), time.alias("at")).groupBy("key").agg(F.max_by(F.struct("source", "text"), "at").alias("s")).select("key", "s.source", "s.text")
    read = materialize(_read(held), "cut-read")
    scored = materialize(_scored(read), "cut-odds")
    limits = _thresholds(scored)
    final = scored.filter("context is not null").select("context", "odds")
    x = read.filter("what = 'record'").select("key", "source", "language", "kind", "context", "word_context", "marked", "opened", "closed", "unfinished", "unclosed", "word")
    x = x.join(final.withColumnRenamed("odds", "log_odds"), "context", "left")
    x = x.join(final.select(F.col("context").alias("word_context"), F.col("odds").alias("word_odds")), "word_context", "left")
    x = x.join(_open_words(read), "word", "left")
    low, least = (F.create_map(*[v for lang in LANGUAGES for v in (F.lit(lang), F.lit(limits[lang][i]))])[F.col("language")] for i in (0, 1))
    kind = F.col("kind")
    open_end = F.when(kind == _TYPE["source"], F.col("open_name")).otherwise(F.col("open"))
    entry = F.coalesce(F.col("word_odds") < least, F.lit(False)) | F.col("unclosed") | F.coalesce(open_end, F.lit(False))
    goes_on = F.when(kind.isNull() | F.col("closed"), False).when(kind.isin([_TYPE[t] for t in _ENTRIES]), entry).otherwise((F.col("log_odds") < low) | F.col("unfinished"))
    return x.select(F.col("key").alias(key), F.col("source").alias(source), "language", "log_odds", "marked", "opened", (F.col("opened") | goes_on).alias("cut"))


def by_source(cuts: DataFrame, source: str = "provider") -> DataFrame:
    """(source, records, cut, share): how often each source cuts; records without a source are a group of their own."""
    return cuts.groupBy(source).agg(F.count("*").alias("records"), F.count_if("cut").alias("cut")).withColumn("share", F.col("cut") / F.col("records"))
