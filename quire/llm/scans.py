"""Problem 5: damage that scanning leaves in text, and its repair.

One pass over all texts counts words; frequent ones are the vocabulary, whose
size is bounded by the least share a word must have. Every text is then
decoded against it as a stream of characters without lines: the cheapest of
all ways to read it as words, which may be divided by hyphens, line ends or
spaces, may run together and may hold confused characters, however many. Lines that may be running
heads are compared with the titles of the book and the section by a join, so
that texts need not move.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.language import ALL_FUNCTION_WORDS
from quire.llm.quality import Profiler, count_pairs, pair_bits, pair_surprise, pair_table
from quire.session import materialize

#: A word of the vocabulary makes up this share of all words and stands this often; so there are at most 1 / share words.
LEAST_SHARE, LEAST_COUNT = 2e-6, 3
#: A word of common letter pairs that is this many times rarer than one it may be misread for is taken for misread; each bit by which its pairs are less common halves the number.
MISREAD_RATIO = 60
#: What is printed on the left may stand for what was on the right (fixed values), in words of mixed or lower case and in words of upper case (given in lower case).
CONFUSIONS = [("c", "e"), ("f", "t"), ("|", "i"), ("|", "l"), ("@", "a"), ("5", "s"), ("0", "o"), ("1", "l"), ("1", "i"), ("9", "g"), ("6", "b"), ("8", "b"), ("$", "s"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("b", "h"), ("l", "t"), ("h", "li"), ("m", "rn"), ("!", "l")]
CAPITAL_CONFUSIONS = [("f", "e"), ("l", "i"), ("1", "i"), ("|", "i"), ("0", "o"), ("5", "s"), ("8", "b"), ("@", "a"), ("6", "g"), ("vv", "w")]
#: Letters that stand for digits (fixed values).
DIGITS = str.maketrans("lIiOoSsbBgqZz", "1110055689922"[:13])
HYPHENS = "-\xad¬‐"
#: Costs (natural logarithms) of reading a text: a word the vocabulary lacks and each of its characters, so that it is dearer than any that is there; confused characters; a number.
UNKNOWN, UNKNOWN_CHAR, CONFUSED, NUMBER = 10.0, 1.4, 1.0, 6.0
#: Every further confusion within a word.
CONFUSED_AGAIN = 2.0
#: A hyphen left at a word's end, one taken out, a line end or a space within a word, a space lost between two words.
DANGLING, HYPHENATED, LINE_END, SPACE, LOST_SPACE = 12.0, 1.0, 11.0, 13.0, 11.0

_CORE = "\"'“”‘’„«»()[]{}<>.,;:?…*_#—–/\\"
_HYPHEN_END = regex.compile(r"(\p{L}[^\s]*?)([-\xad¬‐])\s*$")
_PAGE = regex.compile(r"^[^\w]*(?:(?:page|seite|página|pag|pág|p|s)\b\.?\s*)?([\dlIOoSb]{1,4}|[ivxlc]{1,7})(?:\s*(?:of|von|de|sur|/)\s*\d{1,5})?[^\w.,;:!?]*$", regex.I)
_PREFIX = regex.compile(r"^[^\w]*(?:page|seite|página|pág|p)\b\.?\s", regex.I)
_ROMAN = regex.compile(r"^(?:x{0,3})(?:ix|iv|v?i{0,3})$")
_NUMBERED = regex.compile(r"^\s*(?:[\dlIOoS]{1,4}|[ivxl]{1,6})(?:\s{2,}|\s*[|·–—-]\s*)(.+)$|^(.+?)(?:\s{2,}|\s*[|·–—]\s*)(?:[\dlIOoS]{1,4}|[ivxl]{1,6})\s*$")
_CAPS = regex.compile(r"(?<![^\s])(?:[\p{Lu}\d@|l!'’.:-]*\p{Lu}{2}[\p{Lu}\d@|l!'’:-]*|A|\d{1,2}:?|[\p{Lu}\d@|l]{2,})(?: (?:[\p{Lu}\d@|l!'’:-]{2,}|A|\d{1,2}:?))+(?![^\s])|(?<![^\s])\p{Lu}{6,}(?![^\s])")
_SPACED = regex.compile(r"(?<!\S)(?:[\p{Lu}\d@|l:] ){1,}[\p{Lu}\d@|l:](?: {2,}(?:[\p{Lu}\d@|l:] )*[\p{Lu}\d@|l:])*(?!\S)")
_TITLE_RUN = regex.compile(r"(?:Chapter|Kapitel|Chapitre|Capítulo) \d+(?:: (?:\p{Lu}[\p{L}\p{M}'’-]*|of|the|and|a)(?: (?:\p{Lu}[\p{L}\p{M}'’-]*|of|the|and|a))*)?|(?:\p{Lu}[\p{L}\p{M}'’-]*)(?: (?:of|the|and|a|\p{Lu}[\p{L}\p{M}'’-]*))+")
#: Before a title that is part of a sentence (fixed values).
_LEADS_TITLE = frozenset("to of in from by see called titled entitled and the a on for with as".split())


def norm(text: str) -> str:
    """Letters and digits in lower case, what a title is compared by."""
    return "".join(c for c in text.lower() if c.isalnum() or c in "@|")


def vocabulary(df: DataFrame, text: str = "text") -> tuple[dict[str, int], dict[int, int]]:
    """(words in lower case with their counts, letter pairs with theirs), over all texts.

    Each task counts its own words first. Pieces of divided words are left
    out, and so are words that are misread ones by their counts. Beside the
    frequent words there are those rarer ones that a frequent one is within
    reach of, so that size does not make a word misread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs, table = None, pair_table()

        def flush() -> pa.RecordBatch:
            rows = list(words.items())
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                texts = [t for t in batch.slice(k, 2_000).column(0).to_pylist() if t]
                n = count_pairs(texts, table)
                pairs = n if pairs is None else pairs + n
                tokens: Counter = Counter()
                for t in texts:
                    if any(h in t for h in HYPHENS):
                        t = _DIVIDED.sub(" ", t)
                    tokens.update(t.split())
                for t, c in tokens.items():
                    w = core(t)[1]
                    if w and not w[-1] in HYPHENS:
                        words[w.lower()] += c
                if len(words) > 500_000:
                    yield flush()
        yield flush()
        if pairs is not None:
            hit = pairs.nonzero()[0].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([f"\0{i}" for i in hit], pa.string()), pa.array([int(pairs[i]) for i in hit], pa.int64())], names=["word", "n"])

    counted = materialize(df.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "scan-words")
    is_pair = F.col("word").startswith("\0")
    total = counted.filter(~is_pair).agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, int(total * LEAST_SHARE))
    # at most 1 / LEAST_SHARE words, and a fixed number of pairs
    rows = counted.filter(is_pair | (F.col("n") >= least)).collect()
    pairs = {int(r["word"][1:]): r["n"] for r in rows if r["word"][0] == "\0"}
    words = Decoder({r["word"]: r["n"] for r in rows if r["word"][0] != "\0"}, pairs).words
    if least > LEAST_COUNT:
        shared = df.sparkSession.sparkContext.broadcast((words, pairs))

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            decoder = Decoder(*shared.value, cleaned=True)
            for batch in batches:
                got = [decoder.stands(w, n) for w, n in zip(*(c.to_pylist() for c in batch.columns))]
                yield batch.filter(pa.array(got, pa.bool_()))

        # rarer words that might be misread for one of the vocabulary, but stand too often for that, are words of their own
        rare = counted.filter(~is_pair & (F.col("n") >= LEAST_COUNT) & (F.col("n") < least)).mapInArrow(kept, "word string, n bigint")
        words |= {r["word"]: r["n"] for r in rare.collect()}
    return words, pairs


_DIVIDED = regex.compile(r"\S*\p{L}[-\xad¬‐]\s+\S+")


def _by_first(rules: list[tuple[str, str]]) -> dict[str, tuple[tuple[str, str], ...]]:
    return {c: tuple(r for r in rules if r[0][0] == c) for c in {r[0][0] for r in rules}}


_RULES, _CAPITAL_RULES = _by_first(CONFUSIONS), _by_first(CAPITAL_CONFUSIONS)


def _confusable(low: str) -> bool:
    """Whether a string is looked up as misread: three characters, or two of which the first is a sign or figure for a letter. A single one tells nothing."""
    return len(low) > 2 or (len(low) == 2 and not low[0].isalpha() and low[1].isalpha() and not regex.fullmatch(r"\d[eoasd]", low))


def core(token: str) -> tuple[str, str, str]:
    """(marks before, word, marks after)."""
    w = token.strip(_CORE)
    if not w:
        return token, "", ""
    i = token.index(w)
    after = token[i + len(w) :]
    for s in ("'s", "’s"):
        if w.endswith(s):
            w, after = w[:-2], s + after
    return token[:i], w, after


class Decoder:
    """Best words for strings that are none, by the vocabulary."""

    def __init__(self, words: dict[str, int], pairs: dict[int, int], cleaned: bool = False):
        """``cleaned``: the words come from a decoder that has left out the misread ones."""
        self.words = words if cleaned else dict(words)
        self.memo: dict[str, str | None] = {}
        self.apart: dict[str, tuple[float, str, bool] | None] = {}
        self.bits = pair_bits(pair_surprise(pairs))
        self.order = sorted(words)
        self.total = log(sum(words.values()) or 1)
        if not cleaned:
            for w in words:
                if not w.isdigit() and not self.stands(w, words[w]):
                    del self.words[w]
            self.order = sorted(self.words)
            self.total = log(sum(self.words.values()) or 1)
        #: No string longer than this reads as a word, since a character is misread for two at most.
        self.longest = 2 * max(map(len, self.words), default=0)
        #: The least cost of a word of so many characters or more.
        self.least = [float("inf")] * 42
        for w, n in self.words.items():
            k = min(len(w), 41)
            self.least[k] = min(self.least[k], self.total - log(n))
        for k in range(40, -1, -1):
            self.least[k] = min(self.least[k], self.least[k + 1])

    def stands(self, word: str, n: int) -> bool:
        """Whether a word that stands ``n`` times is one of its own, not a misread one: no word it may be misread for stands so many times more often."""
        if not _confusable(word):
            return True
        for v, _ in self.confused(word, False):
            # signs and figures make no word
            ratio = MISREAD_RATIO / 2 ** max(0.0, self.bits(word) - self.bits(v)) if word.isalpha() else 1.0
            if self.words.get(v, 0) >= max(1.5, ratio) * n:
                return False
        return True

    def confused(self, low: str, caps: bool) -> Iterator[tuple[str, int]]:
        """(word of the vocabulary, number of confusions) of all that a string may have been misread for, however many places are confused."""
        rules = _CAPITAL_RULES if caps else _RULES
        order, n = self.order, len(self.order)
        stack = [(0, "", 0)]
        while stack:
            i, built, k = stack.pop()
            if i == len(low):
                if k and built in self.words:
                    yield built, k
                continue
            for seen, meant in ((low[i], low[i]), *rules.get(low[i], ())):
                if low.startswith(seen, i):
                    more = built + meant
                    at = bisect_left(order, more)
                    # only beginnings of words lead on
                    if at < n and order[at].startswith(more):
                        stack.append((i + len(seen), more, k + (seen != meant)))

    def known(self, word: str) -> bool:
        low = word.lower()
        return low in self.words or ("-" in low and all(p in self.words for p in low.split("-") if p))

    def repair(self, word: str) -> str | None:
        """The word it was misread from, or None where it is a word or none is near."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 200_000:
            self.memo.clear()
        out = self.memo[word] = self._repair(word)
        return out

    def _repair(self, word: str) -> str | None:
        low = word.lower()
        if self.known(word) or not _confusable(low):
            return None
        if sum(c.isdigit() for c in word) >= 2 and not word.isdigit():
            plain = word.translate(DIGITS)
            if plain.replace(",", "").isdigit() and any(c.isalpha() for c in word) and not regex.match(r"^\d+(?:st|nd|rd|th|er|s)$|^\d{1,2}[eoa]$", word):
                return plain
        if not any(c.isalpha() for c in word):
            return None
        caps = sum(c.isupper() for c in word) > 0.5 * sum(c.isalpha() for c in word) and len(word) > 2 and not word[1:].islower()
        # of all readings the cheapest, if it is cheaper than a word that nobody knows
        costs = [(self.cost(v) + CONFUSED + CONFUSED_AGAIN * (k - 1), v) for v, k in self.confused(low, caps) if len(v) > 2 or len(low) == 2]
        paid, best = min(costs, default=(0.0, None))
        if best and paid >= self.cost(word):
            best = None
        if best is None and "-" in low:
            parts = low.split("-")
            fixed = [p if p in self.words else self._repair(p) or "" for p in parts]
            best = "-".join(fixed) if all(fixed) else None
        if best is None:
            return None
        return best.upper() if caps else best[0].upper() + best[1:] if word[0].isupper() else best

    def joins(self, left: str, right: str, hyphen: str) -> tuple[str, bool] | None:
        """(word, misread) where both belong to one divided word, else None.

        The whole word, with or without confusions, competes with the two
        standing alone and with a compound that keeps its hyphen.
        """
        whole = left + right
        if hyphen == "-" and f"{left}-{right}".lower() in self.words and whole.lower() not in self.words:
            return None
        if whole.lower() in self.words:
            return whole, False
        if hyphen == "-" and right.lower() in ("and", "or", "und", "oder", "et", "ou", "y", "o", "to"):
            return None
        fixed = self.repair(whole)
        if fixed:
            return fixed, True
        if hyphen != "-" or not (left.lower() in self.words and right.lower() in self.words):
            return whole, False
        return None


    def cost(self, word: str) -> float:
        """What a word costs as it stands."""
        low = word.lower()
        n = self.words.get(low)
        if n:
            return self.total - log(n)
        if not any(c.isalpha() for c in low):
            return NUMBER
        if self.known(low):
            return max(self.cost(p) for p in low.split("-") if p) + CONFUSED
        return UNKNOWN + UNKNOWN_CHAR * len(low)

    def split(self, word: str) -> tuple[float, str, bool] | None:
        """(cost, words, misread) of a string as words that have lost the space between them, None where it is better left.

        Of two neighbours one is a function word, as others make compounds;
        one of all may hold confused characters.
        """
        if word in self.apart:
            return self.apart[word]
        if len(self.apart) > 200_000:
            self.apart.clear()
        out = None
        if len(word) > 4 and word[0].isalpha() and all(c.isalnum() or c in "@|$!" for c in word) and not self.known(word):
            # the cheapest reading of each beginning, by whether its last word is a function word and one was misread
            best: dict[tuple[int, bool, bool], tuple[float, str]] = {(0, True, False): (-LOST_SPACE, "")}
            for j in range(1, len(word) + 1):
                for i in range(max(0, j - self.longest), j):
                    before = [(last, wrong, *best[i, last, wrong]) for last in (True, False) for wrong in (True, False) if (i, last, wrong) in best]
                    if not before:
                        continue
                    piece = word[i:j]
                    low = piece.lower()
                    function = low in ALL_FUNCTION_WORDS
                    if low in self.words and (len(low) > 2 or function):
                        read, cost, confused = piece, self.cost(low), False
                    elif len(low) > 3 and (i == 0 or j == len(word)) and (read := self.repair(piece)):
                        cost, confused = self.cost(read) + CONFUSED, True
                        function = read.lower() in ALL_FUNCTION_WORDS
                    else:
                        continue
                    for last, wrong, c, text in before:
                        if (last or function) and not (wrong and confused):
                            key, new = (j, function, wrong or confused), (c + LOST_SPACE + cost, f"{text} {read}".lstrip())
                            if key not in best or new < best[key]:
                                best[key] = new
            ends = [(*best[k], k[2]) for k in best if k[0] == len(word) and " " in best[k][1]]
            if ends and min(ends)[0] < self.cost(word):
                out = min(ends)
        self.apart[word] = out
        return out

    def readings(self, tokens: list[str], ends: list[bool], i: int, stop: int, half: int, marks: bool) -> Iterator[tuple[int, float, str, tuple[str, ...]]]:
        """(next token, cost, text, kinds of damage) of each way to read the tokens from ``i`` on as one or as run together.

        ``half`` is the place of a token that may be half a word. With
        ``marks`` the second part of a divided word may follow marks.
        """
        t = tokens[i]
        pre, w, post = core(t)
        if not w:
            yield i + 1, 0.0, t, ()
            return
        dangling = w[-1] in HYPHENS
        yield i + 1, self.cost(w) + DANGLING * dangling, t, ()
        if i != half and not dangling:
            fixed = self.repair(w)
            if fixed:
                yield i + 1, self.cost(fixed) + CONFUSED, pre + fixed + post, ("misread",)
            else:
                parts = self.split(w)
                if parts:
                    yield i + 1, parts[0], pre + parts[1] + post, ("misread",) * parts[2]
        # words in several parts: the first ones as they are, each further one until none may follow
        left, paid, kinds, j, sure = t, 0.0, (), i, True
        while j + 1 < stop:
            at_end = ends[j]
            before, right, after = core(tokens[j + 1])
            if not right or not right[0].isalpha():
                return
            m = _HYPHEN_END.search(left)
            if m:
                if (before and not (marks and at_end)) or (not at_end and (before or not right[0].islower() or not left[m.start(2) - 1].isalpha())):
                    return
                lead, first = left[: m.start(1)] + core(m[1])[0], core(m[1])[1]
                more = right[-1] in HYPHENS
                got = self.joins(first, right, m[2]) if first else None
                if not got or not (sure or more or self.known(got[0])):
                    return
                step, known = HYPHENATED, self.cost(got[0]) if self.known(got[0]) else min(self.cost(got[0]), self.cost(first) + self.cost(right))
                kinds = ("broken_word",)
            else:
                lead, first, tail = core(left)
                if tail or before or not first or not first[-1].isalpha() or not right[0].islower() or (not at_end and self.known(first) and self.known(right)):
                    return
                whole = first + right
                more = right[-1] in HYPHENS
                step = LINE_END if at_end else SPACE
                if self.known(whole):
                    fixed = whole
                elif self.known(first) and self.known(right):
                    fixed = None
                else:
                    # confusions halve a word at most; where its parts are surely cheaper, none is looked for
                    apart = min(self.cost(first), self.cost(self.repair(first) or first) + CONFUSED) + min(self.cost(right), self.cost(j + 1 != half and self.repair(right) or right) + CONFUSED)
                    bound = step + CONFUSED + self.least[min(41, len(whole) // 2)]
                    fixed = self.repair(whole) if more or i != j or apart > bound else None
                if not fixed and not more:
                    return
                got = fixed or whole, bool(fixed) and fixed.lower() != whole.lower()
                # only a word of the vocabulary is believed to be divided without a hyphen
                sure = False
                known = self.cost(got[0])
                kinds = kinds or ("broken_word",) * at_end
            paid += step
            j += 1
            left = lead + got[0] + after
            if sure or not more:
                yield j + 1, paid + known + CONFUSED * got[1] + DANGLING * more, left, kinds + ("misread",) * got[1]
            if after or j - i > 4:
                return

    def read(self, tokens: list[str], ends: list[bool], odd: set[int], half: int = -1, marks: bool = False) -> list[tuple[str, tuple[str, ...]]]:
        """(text, kinds of damage) in order: the cheapest reading of a stream of tokens; ``ends`` tells those at a line's end.

        Only around ``odd`` tokens, hyphens and line ends within a word of
        the vocabulary is there more than one reading.
        """
        n = len(tokens)
        active = bytearray(n)
        for i in odd.union(i for i, t in enumerate(tokens) if t[-1] in HYPHENS):
            active[max(0, i - 1) : i + 2] = b"\1" * (min(n, i + 2) - max(0, i - 1))
        i = ends.index(True) if n else -1
        while 0 <= i < n - 1:
            t, u = tokens[i], tokens[i + 1]
            if t[-1].isalpha() and u[0].islower() and (core(t)[1] + core(u)[1]).lower() in self.words:
                active[i : i + 2] = b"\1\1"
            i = ends.index(True, i + 1)
        out: list[tuple[str, tuple[str, ...]]] = []
        i = 0
        while i < n:
            start = active.find(1, i)
            start = n if start < 0 else start
            out += [(t, ()) for t in tokens[i:start]]
            i = start
            if i == n:
                break
            stop = active.find(0, i)
            stop = n if stop < 0 else stop
            best: list[tuple | None] = [None] * (stop - i + 1)
            best[0] = (0.0, 0, "", ())
            for k in range(stop - i):
                for to, c, text, kinds in self.readings(tokens, ends, i + k, stop, half, marks):
                    if best[to - i] is None or best[k][0] + c < best[to - i][0]:
                        best[to - i] = (best[k][0] + c, k, text, kinds)
            path, k = [], stop - i
            while k:
                path.append(best[k][2:])
                k = best[k][1]
            out += reversed(path)
            i = stop
        return out


def page_number(line: str, first: int | None, last: int | None) -> str | None:
    """The number of a line that has a page number alone, as printed; near the pages of the record where these are known."""
    m = _PAGE.match(line)
    if not m:
        return None
    n = m[1]
    if _ROMAN.match(n.lower()) and n not in "lI":
        return n if n.islower() or n.isupper() else None
    value = n.translate(DIGITS)
    if not value.isdigit() or (not any(c.isdigit() for c in n) and len(n) > 1):
        return None
    if first is None and last is None:
        return n if any(c.isdigit() for c in n) else None
    low, high = (first if first is not None else last), (last if last is not None else first)
    return n if low - 2 <= int(value) <= high + 2 else None


def _letters(text: str) -> tuple[int, int]:
    a = [c for c in text if c.isalpha()]
    return len(a), sum(c.isupper() for c in a)


_CAP_PAIR = regex.compile(r"\p{Lu}[\p{Lu}\d|@l]\S*\p{Lu}|\p{Lu} \p{Lu} ")
_PAGE_AFTER = regex.compile(r"(?: {2,}| ?[|·–—] ?)[\dlIOoS]{1,4}\b")
_PAGE_BEFORE = regex.compile(r"\b[\dlIOoS]{1,4}(?: {1,}| ?[|·–—] ?)$")


def head_line(line: str) -> list[tuple[str, str]]:
    """("line", normal form) of a line that may be a running head as a whole: capitals, a title, or with a page number apart."""
    text = line.strip(" \t|·–—-")
    if not 4 <= len(text) <= 120 or text[0].islower() or text[-1] in ".,;!?" or line.rstrip()[-1] in HYPHENS[1:] or regex.search(r"\p{L}-$", line.rstrip()):
        return []
    numbered = _NUMBERED.match(line.strip())
    if not numbered:
        long = small = 0
        for w in text.split():
            if len(w) > 3 and w[0].isalpha():
                long += 1
                small += w[0].islower()
        if small * 5 > long:
            return []
        n, upper = _letters(text)
        if n < 4 or (not long and upper < 0.6 * n):
            return []
    elif _letters(text)[0] < 4:
        return []
    out = [("line", norm(text))]
    if numbered:
        out.append(("line", norm(numbered[1] or numbered[2])))
    return out


def heads_within(text: str, titles: bool) -> list[tuple[str, str, int, int]]:
    """(how, normal form, start, end) of parts of running text that may be running heads: in capitals, spaced, and with ``titles`` as titles."""
    out: list[tuple[str, str, int, int]] = []
    if _CAP_PAIR.search(text):
        if "  " in text:
            for m in _SPACED.finditer(text):
                if len(m[0]) >= 7:
                    out.append(("caps", norm(m[0]), *m.span()))
        for m in _CAPS.finditer(text):
            if _letters(m[0])[0] >= 5:
                out.append(("caps", norm(m[0]), *m.span()))
    if titles:
        for m in _TITLE_RUN.finditer(text):
            words = m[0].split()
            if len(m[0]) < 7 or (len(words) == 2 and words[0].lower() in ALL_FUNCTION_WORDS):
                continue
            if _PAGE_AFTER.match(text, m.end()) or _PAGE_BEFORE.search(text[max(0, m.start() - 12) : m.start()]):
                out.append(("numbered", norm(m[0]), *m.span()))
            else:
                before = text[max(0, m.start() - 24) : m.start()].split()
                out.append(("led" if before and before[-1].lower() in _LEADS_TITLE else "title", norm(m[0]), *m.span()))
    return out


#: A candidate for a running head: how it was met, its normal form, its place in the text, whether it holds misread words.
Head = tuple[str, str, int, bool]


class Scanner:
    """Damage of one text, and its lines as they would be read; ``words`` are those of a decoder."""

    def __init__(self, words: dict[str, int], pairs: dict[int, int]):
        self.decoder = Decoder(words, pairs, cleaned=True)
        self.profiler = Profiler(pair_surprise(pairs))
        self.fine: set[str] = set()

    def _odd(self, tokens: list[str]) -> list[str]:
        """Words of the tokens that the vocabulary lacks."""
        out = []
        fine = self.fine
        for t in tokens:
            if t in fine:
                continue
            w = core(t)[1]
            if not w or self.decoder.known(w) or w.replace(",", "").replace(".", "").replace("%", "").isdigit():
                if len(fine) > 300_000:
                    fine.clear()
                fine.add(t)
            else:
                out.append(w)
        return out

    def _misread(self, text: str) -> str | None:
        """A head candidate with its misread words put right, None where it has none."""
        fixed = {w: self.decoder.repair(w) for w in self._odd(text.split()) if w[-1] not in HYPHENS}
        if not any(fixed.values()):
            return None
        return " ".join(t if not fixed.get(core(t)[1]) else fixed[core(t)[1]] for t in text.split())

    def damage(self, text: str, first: int | None, last: int | None) -> tuple[list[str], list[Head]]:
        """(kinds of damage, head candidates) of a text, as if it were prose.

        The words of a candidate are not among those that make the text a
        misread one; it tells itself whether it holds such words.
        """
        tokens = text.split()
        if not tokens:
            return [], []
        lines = [x for x in text.splitlines() if x.strip()]
        several = len(lines) > 1
        found: set[str] = set()
        heads: list[Head] = []
        body: list[str] = []
        place = 0
        for line in lines:
            if several:
                if len(line) < 60 and page_number(line, first, last):
                    found.add("page_number")
                    continue
                whole_line = head_line(line)
                if whole_line:
                    place += 1
                    fixed = self._misread(line)
                    heads += [(how, form, place, fixed is not None) for how, form in dict.fromkeys(whole_line + (head_line(fixed) if fixed else []))]
                    continue
            kept, upto = "", 0
            for how, form, a, b in heads_within(line, not several):
                place += 1
                fixed = self._misread(line[a:b]) if how == "caps" else None
                heads += [(how, f, place, fixed is not None) for f in dict.fromkeys([form] + ([norm(fixed)] if fixed else []))]
                if fixed and a >= upto:
                    kept, upto = f"{kept}{line[upto:a]} ", b
            body.append(kept + line[upto:])
        # the last token of a text without an end may be half a word
        own = [x.split() for x in body]
        open_end = tokens[-1][-1] not in ".!?…:;,)\"'”’»" and own and own[-1] and own[-1][-1] == tokens[-1]
        half = sum(map(len, own)) - 1 if open_end else -1
        for _, kinds in self._read(own, half, True) if own else []:
            found.update(kinds)
        return sorted(found), heads

    def damages(self, rows: list[tuple[str | None, int | None, int | None]]) -> list[tuple[list[str], list[Head]]]:
        """``damage`` of each text that is prose; nothing for the others."""
        out = [self.damage(*r) if r[0] else ([], []) for r in rows]
        check = [i for i, (found, heads) in enumerate(out) if found or heads]
        if check:
            counts = np.array([self.profiler.describe(rows[i][0])[0] for i in check], dtype=float)
            chars = np.array([self.profiler.char_counts(rows[i][0]) for i in check], dtype=float)
            for i, kind in zip(check, self.profiler.kinds(counts, chars)[0]):
                if kind != "prose":
                    out[i] = [], []
        return out

    def _read(self, lines: list[list[str]], half: int = -1, marks: bool = False) -> list[tuple[str, tuple[str, ...]]]:
        """The decoder's reading of lines of tokens as one stream; nothing where it can only be the tokens as they are and ``marks`` are asked for."""
        tokens = lines[0] if len(lines) == 1 else [t for x in lines for t in x]
        fine = self.fine
        odd = {i for i, t in enumerate(tokens) if t not in fine and i != half and self._odd([t])}
        if marks and not odd and len(lines) < 2 and not any(t[-1] in HYPHENS for t in tokens):
            return []
        ends = [False] * len(tokens)
        k = -1
        for x in lines:
            k += len(x)
            if k >= 0:
                ends[k] = True
        return self.decoder.read(tokens, ends, odd, half, marks)

    def readable(self, text: str, heads: set[str], first: int | None, last: int | None) -> str:
        """The text in paragraphs of continuous lines, repaired; ``heads`` are the normal forms of running heads to leave out."""
        lines = [x for x in text.splitlines()]
        several = sum(bool(x.strip()) for x in lines) > 1
        kept: list[str] = []
        for line in lines:
            s = line.strip()
            if s and several and (page_number(line, first, last) or any(n in heads for _, n in head_line(line))):
                continue
            if s:
                for pattern in (_SPACED, _CAPS, _TITLE_RUN):
                    s = pattern.sub(lambda m: " " if norm(m[0]) in heads else m[0], s)
            kept.append(s)
        out = []
        for block in paragraphs_of(kept):
            fixed = [t for t, _ in self._read([line.split() for line in block])]
            if fixed:
                out.append(" ".join(fixed))
        return "\n\n".join(out)


def paragraphs_of(lines: list[str]) -> list[list[str]]:
    """Lines as paragraphs: the cheapest choice of boundaries, by dynamic programming.

    A boundary costs more the less the line before it looks like a last one:
    no sentence end, as wide as the others, a small letter after it. Joining
    over a blank line costs as well, unless the sentence goes on after it.
    """
    rows: list[tuple[str, bool]] = []
    blank = False
    for s in lines:
        if not s:
            blank = True
        else:
            rows.append((s, blank))
            blank = False
    if not rows:
        return []
    width = sorted(len(s) for s, _ in rows)[-max(1, len(rows) // 4)]
    n = len(rows)
    cost = [0.0] * (n + 1)
    back = [0] * (n + 1)
    joined = [0.0]
    split = [0.0]
    for i in range(1, n):
        a, (b, gap) = rows[i - 1][0], rows[i]
        ends = bool(regex.search(r"[.!?…:][\"'”’»)\]]*$", a))
        small = b[:1].islower() or a[-1:] in HYPHENS
        short = len(a) < 0.7 * width
        split.append(1.0 + (0 if ends else 3.0) + (3.0 if small else 0) + (0 if short else 1.5) - (3.5 if gap else 0))
        joined.append((2.0 if gap and ends and not small else 0.0) + (1.5 if ends and short and not small else 0.0))
    # joining costs add up, so the best beginning for all later ends is a running least
    best, at, run = float("inf"), 0, 0.0
    for j in range(1, n + 1):
        i = j - 1
        run += joined[i]
        c = cost[i] + split[i] - run
        if c <= best:
            best, at = c, i
        cost[j], back[j] = best + run, at
    cuts, j = [], n
    while j > 0:
        cuts.append((back[j], j))
        j = back[j]
    return [[s for s, _ in rows[i:j]] for i, j in reversed(cuts)]


_HEADS = "array<struct<how: string, form: string, place: int, bad: boolean>>"
#: The scanner of this worker process, by the name its words were sent under; so its memory of words outlives a task.
_SCANNERS: dict[str, Scanner] = {}
Shared = tuple[str, Broadcast]


def _scanner(shared: Shared) -> Scanner:
    name, words = shared
    if name not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[name] = Scanner(*words.value)
    return _SCANNERS[name]


def _scan(paragraphs: DataFrame, shared: Shared) -> DataFrame:
    """Damage and head candidates of every row: (record_id, at, book_slug, section_pos, noise, heads)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        head = pa.list_(pa.struct([("how", pa.string()), ("form", pa.string()), ("place", pa.int32()), ("bad", pa.bool_())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                got = scanner.damages(list(zip(*(part.column(c).to_pylist() for c in (4, 5, 6)))))
                noise = [found for found, _ in got]
                heads = [[dict(zip(("how", "form", "place", "bad"), h)) for h in cands] for _, cands in got]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(4)], pa.array(noise, pa.list_(pa.string())), pa.array(heads, head)], names=["record_id", "at", "book_slug", "section_pos", "noise", "heads"])

    cols = [F.col("record_id"), F.col("ingested_at").alias("at"), "book_slug", "section_pos", "text", "page_start", "page_end"]
    return paragraphs.select(*cols).mapInArrow(run, f"record_id bigint, at timestamp, book_slug string, section_pos int, noise array<string>, heads {_HEADS}")


def _title_norm(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}]", ""))


def _confirmed(rows: DataFrame, books: DataFrame, sections: DataFrame) -> DataFrame:
    """(record_id, form, place) of the candidates that name their book or section."""
    titles = books.filter("book_title is not null").select("book_slug", _title_norm(F.col("book_title")).alias("title")).distinct()
    heads = sections.filter("title is not null").select("book_slug", "section_pos", _title_norm(F.col("title")).alias("title")).distinct()
    c = rows.select("record_id", "book_slug", "section_pos", F.explode("heads").alias("h")).select("record_id", "book_slug", "section_pos", "h.how", "h.form", "h.place")
    # a book's title after a preposition is part of its sentence
    both = c.filter("how != 'led'").join(titles, "book_slug").select("record_id", "how", "form", "place", "title").unionByName(c.join(heads, ["book_slug", "section_pos"]).select("record_id", "how", "form", "place", "title"))
    far = F.greatest(F.lit(1), F.floor(F.length("title") * 0.2)).cast("int")
    # a head in another setting may carry its page number, or a capital word beside it
    held = F.contains(F.col("form"), F.col("title")) & (F.length("form") <= F.length("title") + F.when(F.col("how") == "line", 4).otherwise(14))
    near = F.when(F.abs(F.length("form") - F.length("title")) <= far, F.levenshtein("form", "title") <= far).otherwise(False)
    ok = (F.length("title") >= 4) & (held | (near & ~F.col("how").isin("title", "led")))
    return both.filter(ok).select("record_id", "form", "place").distinct()


def _held(paragraphs: DataFrame, books: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame, Shared]:
    # one word in LEAST_SHARE of the corpus at most, and the rarer ones near these: some tens of MB
    shared = uuid4().hex, paragraphs.sparkSession.sparkContext.broadcast(vocabulary(paragraphs))
    newest = (
        _scan(paragraphs, shared)
        .groupBy("record_id")
        .agg(F.max_by(F.struct("at", "book_slug", "section_pos", "noise", "heads"), F.coalesce("at", F.timestamp_seconds(F.lit(-(10**10))))).alias("s"))
        .select("record_id", "s.*")
        .filter((F.size("noise") > 0) | (F.size("heads") > 0))
    )
    rows = materialize(newest, "scan-damage")
    return rows, _confirmed(rows, books, sections), shared


def damaged(paragraphs: DataFrame, books: DataFrame, sections: DataFrame) -> DataFrame:
    """(record_id, noise): a row for each kind of damage a record's newest text carries.

    broken_word, misread, running_head or page_number; only texts that are
    prose by their profile are looked at. ``misread`` is told of the words and
    numbers of the prose, not of a head or page number, which is no part of it
    and goes as a whole; a line in capitals that proves to be no head is prose.
    Null, empty and blank texts have none, null pages leave the page number
    unchecked, a null book or section leaves no title to compare with. Of
    several titles of a book or section any may be the head. Rows tied on the
    time are taken as identical; rows with a null record_id count as one
    record. parser_mode is not used.
    """
    rows, heads, _ = _held(paragraphs, books, sections)
    noise = rows.select("record_id", F.explode("noise").alias("noise"))
    bad = rows.select("record_id", F.explode("heads").alias("h")).filter("h.bad").select("record_id", F.col("h.place").alias("place")).distinct()
    misread = bad.join(heads.select("record_id", "place"), ["record_id", "place"], "left_anti").select("record_id", F.lit("misread").alias("noise"))
    return noise.unionByName(misread).unionByName(heads.select("record_id", F.lit("running_head").alias("noise"))).distinct()


def repaired(paragraphs: DataFrame, books: DataFrame, sections: DataFrame) -> DataFrame:
    """(record_id, text): every damaged record as continuous readable prose, paragraphs apart by a blank line."""
    rows, heads, shared = _held(paragraphs, books, sections)
    # as they are printed, too, where only the form put right is a title
    every = rows.select("record_id", F.explode("heads").alias("h")).select("record_id", "h.place", "h.form")
    by = every.join(heads.select("record_id", "place").distinct(), ["record_id", "place"], "left_semi").groupBy("record_id").agg(F.collect_set("form").alias("forms"))
    bad = F.exists("heads", lambda h: h["bad"])
    marked = rows.select("record_id", "at", "noise", bad.alias("bad")).join(by, "record_id", "left").filter((F.size("noise") > 0) | F.col("bad") | F.col("forms").isNotNull())
    texts = paragraphs.select(F.col("record_id").alias("r"), F.col("ingested_at").alias("t"), "text", "page_start", "page_end")
    full = marked.join(texts, (F.col("record_id") == F.col("r")) & F.col("at").eqNullSafe(F.col("t"))).dropDuplicates(["record_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        for batch in batches:
            texts = [scanner.readable(t, set(f or ()), a, b) for t, f, a, b in zip(*(batch.column(c).to_pylist() for c in range(1, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["record_id", "text"])

    return full.select("record_id", "text", "forms", "page_start", "page_end").mapInArrow(run, "record_id bigint, text string")
