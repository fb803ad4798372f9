"""Problem 3: spans of at least a given length that stand verbatim in more than one record.

Sparse suffix trees, partitioned by prefix. Only suffixes that begin at an
anchor are kept: the anchor of a stretch of ``least`` characters is the
leftmost of its K-grams with the least hash, so equal stretches have the same
anchor and no shared span is lost. Suffixes whose K-gram stands in one record
only cannot be shared and go. The rest are split by prefixes of variable
length into groups that fit into memory; a group's suffixes are sorted, their
longest common prefixes give the internal nodes of its subtree, and the deep
ones, extended to the left, are the repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.session import materialize

#: Characters that suffixes of one subtree have in common at least.
K = 96
#: Prefix lengths that may bound a group, the shortest first.
PREFIXES = (8, 16, 32, 64, K)
#: Suffixes of a group that one task sorts. A prefix of K characters with more of them is split at all windows of ``least`` characters instead.
GROUP_LIMIT = 4_000
#: Characters hashed at a time in a worker.
CHUNK = 400_000

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    h = a * np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF | 1) + b
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of the K-grams at every position that has one."""
    h = (codes.astype(np.uint64) + np.uint64(0x51)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    n = 1
    while n < 32:
        h = _joined(h[:-n], h[n:], n)
        n *= 2
    m = len(codes) - K + 1
    return _joined(_joined(h[:m], h[32 : 32 + m], 32), h[64 : 64 + m], K)


def anchors(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions in the concatenated texts, and the K-gram hashes.

    Text i is ``codes[starts[i]:stops[i]]``; those shorter than ``least``
    have none.
    """
    grams = gram_hashes(codes)
    w = least - K + 1
    bits = np.uint64(24)
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    low, n = key, 1
    while 2 * n <= w:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    m = len(codes) - least + 1
    low = np.minimum(low[:m], low[w - n : w - n + m])
    ok = np.zeros(len(codes) + 1, dtype=np.int32)
    long = stops - starts >= least
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, stops[long] - least + 1, -1)
    low = low[np.cumsum(ok)[:m] > 0]
    at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    if len(at):
        at = at[np.r_[True, at[1:] != at[:-1]]]
    return np.unique(at), grams


def _pieces(texts: list[str | None], least: int) -> Iterator[list[tuple[int, int, str]]]:
    """(row, offset, text) in lists of at most about CHUNK characters; very long texts in overlapping parts."""
    group: list[tuple[int, int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        if t is None or len(t) < least:
            continue
        for off in range(0, max(1, len(t) - least + 1), CHUNK):
            part = t[off : off + CHUNK + least - 1]
            if size + len(part) > 2 * CHUNK:
                yield group
                group, size = [], 0
            group.append((i, off, part))
            size += len(part)
    if group:
        yield group


def _anchor_rows(df: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                for group in _pieces(part.column(2).to_pylist(), least):
                    codes = np.frombuffer("".join(t for _, _, t in group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                    lens = np.array([len(t) for _, _, t in group])
                    stops = np.cumsum(lens)
                    starts = stops - lens
                    at, hashes = anchors(codes, starts, stops, least)
                    which = np.searchsorted(stops, at, side="right")
                    rows = np.array([i for i, _, _ in group])[which]
                    offs = np.array([o for _, o, _ in group])[which]
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), pa.array((at - starts[which] + offs).astype(np.int32)), pa.array(hashes[at].view(np.int64))],
                        names=["record_id", "at", "pos", "gram"],
                    )

    return df.mapInArrow(run, "record_id bigint, at timestamp, pos int, gram bigint")


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def subtree_repeats(suffixes: list[tuple[int, int, str, str]], least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(node, record, start, end, start of what all share) of the repeats of one group of suffixes.

    A suffix is (record, position, text before it reversed, text from it on),
    both texts as far as they matter. Every internal node of the subtree of
    depth K or more is looked at: suffixes below it that also share enough
    text to the left for ``least`` characters make one repeat.
    """
    suffixes = sorted(suffixes, key=lambda s: s[3])
    n = len(suffixes)
    lcp = [_common(suffixes[i][3], suffixes[i + 1][3]) for i in range(n - 1)] + [0]
    stack: list[tuple[int, int]] = []
    for i in range(n):
        left = i
        while stack and stack[-1][0] > lcp[i]:
            depth, left = stack.pop()
            if depth >= K:
                yield from _node(suffixes[left : i + 1], depth, least)
        if lcp[i] and (not stack or stack[-1][0] < lcp[i]):
            stack.append((lcp[i], left))


def _node(below: list[tuple[int, int, str, str]], depth: int, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    if all(s[0] == below[0][0] for s in below):
        return
    need = max(0, least - depth)
    classes: dict[str, list[tuple[int, int, str, str]]] = {}
    for s in below:
        if len(s[2]) >= need:
            classes.setdefault(s[2][:need], []).append(s)
    for before, members in classes.items():
        members.sort(key=lambda s: s[2])
        if all(s[0] == members[0][0] for s in members):
            continue
        node = xxhash.xxh64_intdigest((before[::-1] + "\0" + members[0][3][:depth]).encode("utf-8", "surrogatepass")) - (1 << 63)
        m = len(members)
        reach = [0] * m
        for order in (range(m), range(m - 1, -1, -1)):
            other, common = -1, 0  # the nearest member of another record on this side, and what it shares
            before_i = -1
            for i in order:
                if before_i >= 0:
                    step = _common(members[before_i][2], members[i][2])
                    common = step if members[before_i][0] != members[i][0] else min(common, step) if other >= 0 else 0
                    other = before_i if members[before_i][0] != members[i][0] else other
                    if other >= 0:
                        reach[i] = max(reach[i], common)
                before_i = i
        # in order of what stands before them, the first and the last one have in common what all have
        every = max(need, _common(members[0][2], members[-1][2]))
        for s, left in zip(members, reach):
            yield node, s[0], s[1] - max(left, need), s[1] + depth, s[1] - every


def repeats(texts: DataFrame, least: int = 160) -> DataFrame:
    """(node, record_id, start_pos, end_pos, all_pos): where shared spans stand.

    ``texts`` has (record_id bigint, at timestamp, text); of the rows of one
    record the newest holds, tied ones are taken as identical. A node is one
    repeat, the stretch of text [start_pos, end_pos) of a record is covered by
    it; a longer span gives a chain of overlapping nodes. From ``all_pos`` on
    the stretch is common to all records of the node. Null texts and those
    under ``least`` characters have none; text that repeats only within one
    record is no repeat. A null record_id is left out. Copies share one node
    for each stretch, whatever their number. Empty input gives an empty frame.
    """
    if least < K:
        raise ValueError(f"least must be {K} at least")
    clean = texts.select("record_id", "at", "text").filter(F.col("record_id").isNotNull())
    found = materialize(_anchor_rows(clean, least), "span-anchors")
    shared = found.groupBy("gram").agg(F.min("record_id").alias("a"), F.max("record_id").alias("b")).filter("a < b").select("gram")
    newest = clean.groupBy("record_id").agg(F.max("at").alias("newest"))
    held = (
        found.join(shared, "gram")
        .join(newest, "record_id")
        .filter(F.col("at").eqNullSafe(F.col("newest")))
        .groupBy("record_id", "at")
        .agg(F.collect_set("pos").alias("positions"))
    )
    texts_of = clean.select(F.col("record_id").alias("r"), F.col("at").alias("t"), "text")
    side = least - K
    suffixes = materialize(
        held.join(texts_of, (F.col("record_id") == F.col("r")) & F.col("at").eqNullSafe(F.col("t")))
        .select("record_id", "text", F.explode("positions").alias("pos"))
        .select(
            "record_id",
            "pos",
            F.reverse(F.expr(f"substring(text, greatest(1, pos + 1 - {side}), least(pos, {side}))")).alias("before"),
            F.expr(f"substring(text, pos + 1, {least})").alias("after"),
        ),
        "span-suffixes",
    )
    # the shortest prefix that few enough suffixes have in common; larger groups are in no count table, whatever their size
    counted = suffixes.groupBy(*[F.xxhash64(F.substring("after", 1, n)).alias(f"g{n}") for n in PREFIXES]).agg(F.count("*").alias(f"n{K}"))
    by_prefix = counted
    for n in PREFIXES[:-1]:
        few = counted.groupBy(f"g{n}").agg(F.sum(f"n{K}").alias(f"n{n}")).filter(F.col(f"n{n}") <= GROUP_LIMIT)
        by_prefix = by_prefix.join(few, f"g{n}", "left")
    length, prefix = F.lit(0), F.lit(0).cast("bigint")
    for n in reversed(PREFIXES):
        length = F.when(F.col(f"n{n}") <= GROUP_LIMIT, n).otherwise(length)
        prefix = F.when(F.col(f"n{n}") <= GROUP_LIMIT, F.col(f"g{n}")).otherwise(prefix)
    groups = by_prefix.select(F.col(f"g{K}").alias("gram"), length.alias("length"), prefix.alias("prefix"))
    suffixes = suffixes.withColumn("gram", F.xxhash64(F.substring("after", 1, K))).join(groups, "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["node", "record_id", "start_pos", "end_pos", "all_pos"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                out: set[tuple] = set()
                for group in batch.slice(k, 16).column(0).to_pylist():
                    distinct = {(s["record_id"], s["pos"]): s for s in group}
                    out.update(subtree_repeats([(s["record_id"], s["pos"], s["before"], s["after"]) for s in distinct.values()], least))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    small = suffixes.filter("length > 0").groupBy("length", "prefix").agg(F.collect_list(F.struct("record_id", "pos", "before", "after")).alias("s"))
    trees = small.select("s").mapInArrow(run, "node bigint, record_id bigint, start_pos int, end_pos int, all_pos int")

    whole = F.concat(F.reverse(F.col("before")), F.col("after"))
    windows = (
        suffixes.filter("length = 0")
        .select("record_id", "pos", whole.alias("w"), F.length("before").alias("l"))
        .filter(F.length("w") >= least)
        .select("record_id", "pos", "w", "l", F.explode(F.sequence(F.lit(0), F.least(F.col("l"), F.length("w") - least))).alias("k"))
        .select("record_id", (F.col("pos") - F.col("l") + F.col("k")).alias("start_pos"), F.xxhash64(F.expr(f"substring(w, k + 1, {least})")).alias("node"))
    )
    windows = materialize(windows, "span-windows")
    many = windows.groupBy("node").agg(F.min("record_id").alias("a"), F.max("record_id").alias("b")).filter("a < b").select("node")
    leaves = windows.join(many, "node").select("node", "record_id", "start_pos", (F.col("start_pos") + least).alias("end_pos"), F.col("start_pos").alias("all_pos")).distinct()
    return trees.unionByName(leaves)


#: Nodes of more records than HOT are joined with themselves in SALTS parts.
HOT, SALTS = 1_000, 16


def _same(h: Column) -> list[Column]:
    """What tells sets apart, whatever the order and in fixed size."""
    return [F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("y")]


def pairs(rep: DataFrame) -> DataFrame:
    """(record_a, record_b), record_a < record_b: each two records with a repeat in common.

    A long span makes a chain of nodes with the same records; of these one is
    expanded. Nodes of many records are expanded in parts.
    """
    m = materialize(rep.select("node", "record_id").distinct(), "span-members")
    one = m.groupBy("node").agg(*_same(F.xxhash64("record_id"))).groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node", (F.col("n") > HOT).alias("hot"))
    held = m.join(one, "node")
    salt = F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")
    a = held.select("node", F.when(F.col("hot"), salt).otherwise(0).alias("salt"), F.col("record_id").alias("record_a"))
    b = held.select("node", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"), F.col("record_id").alias("record_b"))
    return a.join(b, ["node", "salt"]).filter("record_a < record_b").select("record_a", "record_b").distinct()


def shared_share(rep: DataFrame, texts: DataFrame) -> DataFrame:
    """(record_id, n_chars, shared_chars, shared): for each record how much of it stands elsewhere.

    One row for every record; a null text counts as 0 characters with a share of 0.
    """
    w = Window.partitionBy("record_id").orderBy("start_pos", "end_pos").rowsBetween(Window.unboundedPreceding, -1)
    cover = (
        rep.select("record_id", "start_pos", "end_pos")
        .distinct()
        .withColumn("seen", F.coalesce(F.max("end_pos").over(w), F.lit(0)))
        .groupBy("record_id")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end_pos") - F.greatest("start_pos", "seen"))).alias("shared_chars"))
    )
    size = texts.filter(F.col("record_id").isNotNull()).groupBy("record_id").agg(F.max(F.struct("at", F.coalesce(F.length("text"), F.lit(0)).alias("n"))).alias("m"))
    return (
        size.select("record_id", F.col("m.n").cast("bigint").alias("n_chars"))
        .join(cover, "record_id", "left")
        .withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)).cast("bigint"))
        .withColumn("shared", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
    )


def spans(rep: DataFrame) -> DataFrame:
    """(first_record, start_pos, end_pos, n_chars, n_records): the longest stretches that the same records share, as they stand in the least of these.

    Overlapping nodes of the same records, as far apart in all of them, are
    one stretch, however long. Where more records share a part of it, that
    part is a row of its own, and if it lies in the middle the ends on both
    sides are rows too. Where a record holds a stretch more than once its
    first place counts.
    """
    m = materialize(rep.groupBy("node", "record_id").agg(F.min(F.struct("end_pos", "all_pos")).alias("p")).select("node", "record_id", "p.*"), "span-places")
    first = m.groupBy("node").agg(F.min(F.struct("record_id", "all_pos", "end_pos")).alias("f")).select("node", F.col("f.record_id").alias("first_record"), F.col("f.all_pos").alias("a"), F.col("f.end_pos").alias("e"))
    apart = m.join(first, "node").groupBy("node", "first_record", "a", "e").agg(*_same(F.xxhash64("record_id", F.col("end_pos") - F.col("e"))))
    chain = ["first_record", "n", "x", "y"]
    w = Window.partitionBy(*chain).orderBy("a", "e")
    reached = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached >= F.col("a"), 0).otherwise(1)
    linked = apart.withColumn("begins", begins).withColumn("part", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = linked.groupBy(*chain, "part").agg(F.min("a").alias("start_pos"), F.max("e").alias("end_pos"))
    return out.select("first_record", "start_pos", "end_pos", (F.col("end_pos") - F.col("start_pos")).alias("n_chars"), F.col("n").alias("n_records"))
