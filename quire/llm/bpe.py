"""Byte-level BPE with the merges of a public tokenizer, run as recursive DuckDB queries.

Texts are cut at single spaces between two non-space characters; no token
crosses such a cut, so a unit (the non-space run with its leading space) has
the same ids wherever it stands. A worker keeps the ids of units it has seen,
and every batch sends only its new words to DuckDB: token-position rows join
the merge table, the leftmost pair of least rank of each word is contracted,
and so on until no pair of any word can be merged.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import regex

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: Pre-tokenizer pattern of the byte-level vocabulary (fixed value of the public tokenizer).
PRETOKEN = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A cut no token crosses: one space between two non-space characters.
CUT = regex.compile(r"(?<=\S) (?=\S)")
SPACES = regex.compile(r"\s")

#: Words of more bytes go to the heap merge: the recursive query writes one row per token and step, so its rows grow with the square of a word's length.
LONGEST_IN_SQL = 96
ROWS_PER_QUERY = 400_000

CONTRACT = """
WITH RECURSIVE st(w, pos, tok, step) AS (
    SELECT w, pos, tok, 0 FROM init
    UNION ALL
    SELECT w, pos, CASE WHEN here THEN id ELSE tok END, step + 1
    FROM (
        SELECT *, lag(here, 1, false) OVER (PARTITION BY w ORDER BY pos) AS eaten
        FROM (
            SELECT *, key IS NOT NULL AND key = min(key) OVER (PARTITION BY w) AS here, min(key) OVER (PARTITION BY w) AS best
            FROM (
                SELECT p.w, p.pos, p.tok, p.step, m.id, m.rank * 4096 + p.pos AS key
                FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM st) p
                LEFT JOIN merges m ON p.tok = m.l AND p.nxt = m.r
            )
        )
    )
    WHERE best IS NOT NULL AND NOT eaten
)
SELECT w, list(tok ORDER BY pos) AS ids
FROM (SELECT *, max(step) OVER (PARTITION BY w) AS last FROM st)
WHERE step = last
GROUP BY w
"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = [""] * 256
    for b in keep:
        out[b] = chr(b)
    for n, b in enumerate(b for b in range(256) if not out[b]):
        out[b] = chr(256 + n)
    return out


class Encoder:
    """Ids of texts. One per worker; the unit and word memos are bounded."""

    def __init__(self, path: str = DEFAULT_TOKENIZER, max_memo: int = 400_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], dtype=np.int32)
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.max_memo = max_memo
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self._db = None
        self._ranks: dict[tuple[int, int], tuple[int, int]] | None = None

    @property
    def db(self):
        if self._db is None:
            import duckdb
            import pyarrow as pa

            db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
            merges = pa.table({"l": self.left, "r": self.right, "id": self.merged, "rank": np.arange(len(self.left), dtype=np.int64)})
            db.register("given", merges)
            db.execute("CREATE TABLE merges AS SELECT * FROM given")
            db.unregister("given")
            self._db = db
        return self._db

    def _by_query(self, words: list[str], raw: list[bytes]) -> None:
        import pyarrow as pa

        lens = np.array([len(r) for r in raw])
        toks = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        w = np.repeat(np.arange(len(raw), dtype=np.int32), lens)
        pos = (np.arange(len(toks)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int64)
        self.db.register("init", pa.table({"w": w, "pos": pos, "tok": toks}))
        got = self.db.execute(CONTRACT).fetchall()
        self.db.unregister("init")
        for i, ids in got:
            self.words[words[i]] = np.array(ids, dtype=np.int32).tobytes()

    def _by_heap(self, raw: bytes) -> bytes:
        """The same contraction for one very long word, in n log n steps."""
        if self._ranks is None:
            self._ranks = {(int(a), int(b)): (n, int(c)) for n, (a, b, c) in enumerate(zip(self.left, self.right, self.merged))}
        ranks, ids = self._ranks, self.byte_ids[np.frombuffer(raw, dtype=np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b or ids[i] != a:
                continue
            ids[i], ids[j] = ranks[a, b][1], -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] < n and (r := ranks.get((ids[x], ids[nxt[x]]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[nxt[x]]))
        return np.array([x for x in ids if x >= 0], dtype=np.int32).tobytes()

    def learn_words(self, words: set[str]) -> None:
        some, raw, rows = [], [], 0
        for word in sorted(words):
            b = word.encode("utf-8", "surrogatepass")
            if len(b) > LONGEST_IN_SQL:
                self.words[word] = self._by_heap(b)
                continue
            some.append(word)
            raw.append(b)
            rows += len(b) * len(b)
            if rows > ROWS_PER_QUERY:
                self._by_query(some, raw)
                some, raw, rows = [], [], 0
        if some:
            self._by_query(some, raw)

    def learn_units(self, units: set[str]) -> None:
        if len(self.units) + len(units) > self.max_memo:
            self.units.clear()
        if len(self.words) > self.max_memo:
            self.words.clear()
        cut = {u: PRETOKEN.findall(u) for u in units}
        self.learn_words({w for ws in cut.values() for w in ws if w not in self.words})
        for u, ws in cut.items():
            self.units[u] = b"".join([self.words[w] for w in ws])

    @staticmethod
    def cut(text: str) -> list[str]:
        """The units of a text; all but the first carry their leading space."""
        if "  " in text:
            parts = CUT.split(text)
        else:
            parts = text.split(" ")
            if "" in parts or any(p[-1].isspace() or p[0].isspace() for p in parts):
                parts = CUT.split(text)
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian int32 bytes; empty for null and empty texts."""
        cuts = [self.cut(t) if t else [] for t in texts]
        known = self.units
        new = {u for c in cuts for u in c if u not in known}
        if new:
            if len(known) + len(new) > self.max_memo:
                new = {u for c in cuts for u in c}
            self.learn_units(new)
        get = self.units.__getitem__
        return [b"".join(map(get, c)) for c in cuts]
