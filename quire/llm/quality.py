"""Problem 4: statistics of each text, and which texts are no natural prose.

Every text gives two distributions: one over what its tokens and lines are
(function words, other words, odd strings, numbers, cell and entry marks,
sentence ends) and one over character classes. Their Jensen-Shannon
divergence from the profile of each structure decides its kind. How words
look in the corpus at hand comes from the letter pairs of all its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quire.llm.language import ALL_FUNCTION_WORDS

#: What a parser writes for a table without rows (fixed value).
EMPTY_TABLE = "[empty table]"
KINDS = ("prose", "list", "table", "junk")
#: Shares by kind of: function words, other words, odd strings, numbers, symbols, cell marks, entry marks, sentence ends (fixed values).
TOKEN_PROFILE = {
    "prose": (0.38, 0.49, 0.01, 0.03, 0.01, 0.005, 0.005, 0.07),
    "list": (0.02, 0.62, 0.01, 0.01, 0.01, 0.01, 0.32, 0.00),
    "table": (0.01, 0.30, 0.01, 0.28, 0.01, 0.38, 0.01, 0.00),
    "junk": (0.01, 0.06, 0.70, 0.05, 0.15, 0.02, 0.01, 0.00),
}
#: Shares by kind of: lower-case letters, other letters, digits, white space, sentence marks, other signs (fixed values).
CHAR_PROFILE = {
    "prose": (0.78, 0.025, 0.01, 0.155, 0.02, 0.01),
    "list": (0.74, 0.03, 0.02, 0.14, 0.01, 0.06),
    "table": (0.40, 0.06, 0.28, 0.18, 0.01, 0.07),
    "junk": (0.35, 0.15, 0.12, 0.13, 0.03, 0.22),
}
CHAR_WEIGHT = 0.25
#: Conjunctions that join entries of lists as well; they do not mark prose.
JOINERS = frozenset("and or und oder et ou y o e".split())
#: Words with a mean letter-pair surprise of more bits are no words of the corpus: those of one text together, and one by one.
ODD_TEXT, ODD_WORD = 5.3, 9.0

_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêàâçîïôûùñáíóúœ"
_INDEX = {c: i + 1 for i, c in enumerate(_LETTERS)}
_A = len(_LETTERS) + 2

_TAG = regex.compile(r"<[^<>]*>|&[a-z]+;")
_SPACED = regex.compile(r"^(?:\p{Lu} )*\p{Lu}(?: {2,}(?:\p{Lu} )*\p{Lu})*$")
_MARK = regex.compile(r"^(?:[-–—*•·▪◦‣+]|\(?\p{Nd}{1,3}[.):]|\(?\p{L}[.)]|\(?[ivxl]{1,6}[.)])\s+(?=\S)")
_LEADER = regex.compile(r"(?<=[\p{L})])\s*(?:\.\s?){3,}\s*[\divxl]{1,4}$")
_RULE = regex.compile(r"([^\w\s]|_)\1{2,}")
_TABLE_RULE = regex.compile(r"^[-|:+=\s]+$")
_INDEX_REFS = regex.compile(r"(?:,\s*\d+(?:[-–]\d+)?)+$")
_GAP = regex.compile(r"(?<=\S)(?:\t+|\s*\|\s*|\s{2,}|;(?=[^\s])|;$)(?=\S|$)|^\|")
_SENTENCE = regex.compile(r"[.!?…][\"'”’»)\]*_]*$")
_STRIP = "\"'“”‘’„«»()[]{}<>.,;:!?…*_#"
_NUMBER = regex.compile(r"[+\-–$€£]?\d[\d.,:/–-]*\s?%?$")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:[-'’‐]\p{L}[\p{L}\p{M}]*)*$")
_MOJIBAKE = regex.compile(r"[ÃâÂ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|Ã.|â€")

_FUNCTION, _LEX, _ODD, _NUM, _SYM, _CELL, _ENTRY, _END = range(8)


def pair_table() -> np.ndarray:
    """Index of every character under 0x250 among the letters, 0 for all that is none of them."""
    table = np.zeros(0x250, dtype=np.int64)
    for c, i in _INDEX.items():
        for form in (c, c.upper()):
            if len(form) == 1 and ord(form) < 0x250:
                table[ord(form)] = i
    return table


def count_pairs(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    total = np.zeros(_A * _A, dtype=np.int64)
    joined = " ".join([t for t in texts if t])
    for j in range(0, len(joined), 500_000):
        codes = np.frombuffer(joined[j : j + 500_001].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ids = table[np.minimum(codes, 0x24F)]
        total += np.bincount(ids[:-1] * _A + ids[1:], minlength=_A * _A)
    return total


def pair_surprise(counts: dict[int, int]) -> np.ndarray:
    """Surprise in bits of every letter pair, from their counts."""
    n = np.zeros(_A * _A)
    for pair, k in counts.items():
        n[pair] = k
    n = n.reshape(_A, _A)
    n[0, 0] = 0
    return -np.log2((n + 0.02) / (n.sum(axis=1, keepdims=True) + 0.02 * _A))


def pair_bits(surprise: np.ndarray) -> Callable[[str], float]:
    """The surprise in bits of all letter pairs of a lower-case word together, its ends included."""
    table = surprise.tolist()

    def of(word: str) -> float:
        ids = [0, *(_INDEX.get(c, 0) for c in word), 0]
        return sum(table[a][b] for a, b in zip(ids, ids[1:]))

    return of


def letter_pairs(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Surprise in bits of every letter pair, word ends included, over all texts; as large as the alphabet squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, table = np.zeros(_A * _A, dtype=np.int64), pair_table()
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                total += count_pairs(batch.slice(k, 2_000).column(0).to_pylist(), table)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["pair", "n"])

    # one row a pair at most, whatever the corpus
    rows = texts.select(text).mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return pair_surprise({r["pair"]: r["n"] for r in rows})


def divergences(counts: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row's distribution from each profile."""
    p = counts / np.maximum(1.0, counts.sum(axis=1, keepdims=True))

    def entropy(x: np.ndarray) -> np.ndarray:
        return -(x * np.log2(np.where(x > 0, x, 1.0))).sum(axis=-1)

    return entropy((p[:, None, :] + profiles[None]) / 2) - (entropy(p)[:, None] + entropy(profiles)[None]) / 2


#: Width of a field of a packed token; a text may have 2**32 of each.
_FIELD = 32
_MASK = (1 << _FIELD) - 1
#: Fields after the eight classes: sentence end, semicolon, function word or joiner, letters of other words, their surprise in 1/16 bits.
_STOP, _SEMI, _COMMON, _LETTER_N, _BITS = range(8, 13)
_CLOSERS = "\"'”’»)]*_"


class Profiler(dict):
    """Classes of tokens and lines; as a dict the bounded memo of packed tokens.

    A packed token has a count in the field of its class and of all else that
    is counted, so that the sum over a line's tokens counts everything at once.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits.tolist()
        self.char_class = _char_classes()
        self.tokens = np.array([TOKEN_PROFILE[k] for k in KINDS])
        self.tokens /= self.tokens.sum(axis=1, keepdims=True)
        self.chars = np.array([CHAR_PROFILE[k] for k in KINDS])
        self.chars /= self.chars.sum(axis=1, keepdims=True)

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        c = self._class(token)
        packed = 1 << (_FIELD * c)
        if token[-1] in ".!?" or token[-1] in _CLOSERS and _SENTENCE.search(token):
            packed += 1 << (_FIELD * _STOP)
        if token[-1] == ";":
            packed += 1 << (_FIELD * _SEMI)
        word = "".join(x for x in token.lower() if x.isalpha())
        if word in ALL_FUNCTION_WORDS:
            packed += 1 << (_FIELD * _COMMON)
        elif c == _LEX and len(word) > 1:
            n = len(word) + 1
            packed += (n << (_FIELD * _LETTER_N)) + (int(16 * n * self.surprise(word)) << (_FIELD * _BITS))
        self[token] = packed
        return packed

    def surprise(self, word: str) -> float:
        ids = [0, *[_INDEX.get(c, _A - 1) for c in word if c not in "-'’‐"], 0]
        return sum(self.bits[a][b] for a, b in zip(ids, ids[1:])) / (len(ids) - 1)

    def _class(self, token: str) -> int:
        bare = token.strip(_STRIP)
        low = bare.lower()
        if not bare:
            return _LEX if len(token) > 1 and not token.strip(".,;:!?…\"'“”‘’()-–—") else _SYM
        if len(bare) == 1 and bare.isalpha() and bare not in "aAIàyoeé":
            return _ODD
        if low in ALL_FUNCTION_WORDS:
            return _LEX if low in JOINERS else _FUNCTION
        if _NUMBER.match(bare):
            return _ODD if _RULE.search(token) else _NUM
        if _MOJIBAKE.search(token) or _RULE.search(token):
            return _ODD
        if not any(c.isalnum() for c in bare):
            return _SYM
        if len(bare) == 1:
            return _ODD
        if _WORD.match(bare):
            longest = max(len(x) for x in regex.split(r"[-'’‐]", bare))
            return _ODD if longest > 30 or (low == bare or bare[1:] != bare[1:].lower() and bare != bare.upper()) and self.surprise(low) > ODD_WORD else _LEX
        letters = sum(c.isalpha() for c in bare)
        return _LEX if len(bare) < 25 and letters >= 0.7 * len(bare) and self.surprise(low) <= 1.5 * ODD_WORD else _ODD

    def describe(self, text: str) -> tuple[list[int], int, int, int]:
        """(counts by token class, lines, lines that end in punctuation, common words)."""
        total = lines = ended = entries = cell_marks = tables = ends = 0
        tags = 0
        body = text
        if "<" in text:
            body, tags = _TAG.subn(" ", text)
        for line in body.splitlines():
            line = line.strip()
            if not line:
                continue
            lines += 1
            if line == EMPTY_TABLE:
                tables += 3
                continue
            last, first = line[-1], line[0]
            end = last in ".!?…" or last in _CLOSERS and _SENTENCE.search(line) is not None
            ended += end
            double = "  " in line
            if double and _SPACED.match(line):
                line = " ".join(w.replace(" ", "") for w in regex.split(r" {2,}", line))
                double = False
            mark = _MARK.match(line) if not first.isalpha() or line[1:2] in ".)" or line[:6].rstrip(".)") != line[:6] else None
            if mark:
                line = line[mark.end() :]
            refs = None
            if not end and (last.isdigit() or last in "ivxl"):
                refs = _LEADER.search(line) or _INDEX_REFS.search(line)
                if refs and refs.start():
                    line = line[: refs.start()]
            cells = 0
            if double or "|" in line or "\t" in line or ";" in line:
                cells = sum(1 for _ in _GAP.finditer(line))
                if cells and not any(c.isalnum() for c in line) and not _TABLE_RULE.match(line):
                    cells = 0
                if cells:
                    line = line.replace("|", " ").replace(";", " ")
            tokens = line.split()
            packed = sum(map(self.__getitem__, tokens))
            total += packed
            function = packed & _MASK
            cell_marks += cells
            stops = packed >> (_FIELD * _STOP) & _MASK
            ends += stops if function else min(stops, 1)
            if refs or mark and function <= max(2, 0.3 * len(tokens)):
                entries += 2 if refs else 1
            elif not cells and not end and function <= 1 and len(tokens) <= 8 and not (packed >> (_FIELD * _ODD) & _MASK or packed >> (_FIELD * _SYM) & _MASK):
                entries += 1
            if not cells and function <= 0.15 * len(tokens):
                entries += packed >> (_FIELD * _SEMI) & _MASK
        counts = [total >> (_FIELD * c) & _MASK for c in range(8)]
        counts[_ODD] += tags
        counts[_CELL] = cell_marks + tables
        counts[_END] = ends
        letters, bits = total >> (_FIELD * _LETTER_N) & _MASK, (total >> (_FIELD * _BITS)) / 16
        if letters >= 8 and bits > ODD_TEXT * letters:
            counts[_ODD] += counts[_LEX] + entries
            counts[_LEX] = entries = 0
        counts[_ENTRY] = entries
        return counts, lines, ended, total >> (_FIELD * _COMMON) & _MASK

    def kinds(self, counts: np.ndarray, chars: np.ndarray) -> tuple[list[str], np.ndarray]:
        """For each text, a row of both counts: the nearest profile, and the divergence from prose. A list has two entries, a table two cells at least."""
        d = divergences(counts, self.tokens) + CHAR_WEIGHT * divergences(chars, self.chars)
        d[counts[:, _ENTRY] < 2, 1] = np.inf
        d[counts[:, _CELL] < 2, 2] = np.inf
        return [KINDS[i] for i in d.argmin(axis=1)], d[:, 0]

    def char_counts(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars = np.bincount(self.char_class[np.minimum(codes, 0x250)], minlength=7)
        if chars[6]:
            for x in codes[codes >= 0x250].tolist():
                c = chr(x)
                chars[1 if c.isalpha() else 3 if c.isspace() else 4 if c == "…" else 5] += 1
        return chars[:6]

    def kind_of(self, text: str) -> str:
        return self.kinds(np.array([self.describe(text)[0]], dtype=float), np.array([self.char_counts(text)], dtype=float))[0][0]


def _char_classes() -> np.ndarray:
    """Class of each character under 0x250: lower, other letter, digit, space, sentence mark, sign; 6 for all others."""
    out = np.full(0x251, 5, dtype=np.int64)
    out[0x250] = 6
    for c in range(0x250):
        ch = chr(c)
        out[c] = 0 if ch.islower() else 1 if ch.isalpha() else 2 if ch.isdigit() else 3 if ch.isspace() else 4 if ch in ".,!?" else 5
    return out


def text_quality(df: DataFrame, key: str = "record_id", text: str = "text", at: str = "ingested_at") -> DataFrame:
    """One row a record: the statistics of its newest text and the kind of text it is.

    (record_id, n_words, mean_word_length, symbol_ratio, punctuated_lines,
    common_words, divergence, kind); kind is prose, list, table or junk, and
    null for null, empty and blank texts, whose counts are 0 and ratios null.
    ``symbol_ratio`` is the share of characters that are neither letters,
    digits nor white space. Rows of one record tied on ``at`` are taken as
    identical. Rows with a null key count as one record. Stated word counts
    and table marks are not used. Texts of any length are read whole.
    """
    bits = letter_pairs(df, text)
    kind_of_key = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prof = Profiler(bits)
        names = ["key", "at", "n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "divergence", "kind"]
        kinds = [pa.int32(), *[pa.float64()] * 5, pa.string()]
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                part = batch.slice(k, 1_000)
                texts = part.column(2).to_pylist()
                full = [i for i, t in enumerate(texts) if t and not t.isspace()]
                rows: list[tuple] = [(0, None, None, None, None, None, None)] * len(texts)
                if full:
                    described = [prof.describe(texts[i]) for i in full]
                    chars = np.array([prof.char_counts(texts[i]) for i in full])
                    nearest, from_prose = prof.kinds(np.array([d[0] for d in described], dtype=float), chars.astype(float))
                    for i, (_, lines, ended, common), c, kind, d in zip(full, described, chars.tolist(), nearest, from_prose.tolist()):
                        words = texts[i].split()
                        n = len(words)
                        rows[i] = (n, sum(map(len, words)) / n, (c[4] + c[5]) / len(texts[i]), ended / max(1, lines), common / n, d, kind)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=names)

    out = "n_words int, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, divergence double, kind string"
    each = df.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(text)).mapInArrow(run, f"key {kind_of_key}, at timestamp, {out}")
    fields = [x.split()[0] for x in out.split(", ")]
    newest = each.groupBy("key").agg(F.max_by(F.struct(*fields), F.coalesce("at", F.timestamp_seconds(F.lit(-(10**10))))).alias("s"))
    return newest.select(F.col("key").alias(key), "s.*")
