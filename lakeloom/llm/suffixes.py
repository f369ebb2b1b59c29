"""Exact substring deduplication: bytes covered by a long string that also starts earlier are removed.

Only suffixes that can repeat are sorted. Each document's anchors are the places whose 50-byte
string hashes lowest among the 51 that some 100-byte window holds, so equal windows have equal anchors at one
place. Spark groups the anchors by their string's hash, and the suffixes at all anchors whose string
occurs elsewhere are sorted; the hash only tells which can be left out. Inside one batch or run, anchors with equal
contexts (all that windows around them can see) are one after their bytes have been compared: the others repeat.

The sort is a distributed merge sort that knows common prefixes: tasks sort runs, front-code
them (length of the prefix shared with the suffix before, and the rest) and send each range of the order to one
task, which merges the runs with a loser tree that compares characters behind known prefixes only.
Anchors of one string then follow each other, in order of what comes behind, with the lengths they
share; with what stands before each, that tells which windows are equal. All but the first of those in document
order repeat. Strings at very many anchors are not left to one task: there every
window is a suffix of its own, its order is cut into ranges anywhere, and windows that share the whole length repeat.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.shared import text_batches, written

#: Length of a repeat, of an anchor's string, and how far before and behind an anchor windows reach.
LENGTH, GRAM = 100, 50
BEFORE = LENGTH - GRAM
#: Bytes handled at once; longer documents are handled by overlapping segments.
SEGMENT = 1 << 19
#: Suffixes in a run and, about, in a range; documents that splitters are drawn from, and splitters of each; bytes of positions that are broadcast at most.
RUN, RANGE, SAMPLE, DRAWN, BROADCAST = 200_000, 500_000, 300, 200, 64_000_000
#: A string at more anchors than this is sorted window by window. Strings that a task remembers to occur more than once.
HOT, REMEMBERED = 50_000, 1_000_000

_B = 0x9E3779B97F4A7C15
_POWERS: list = []


def _powers(n: int):
    """Powers of an odd number and of its inverse, modulo 2**64."""
    import numpy as np

    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, SEGMENT + 4096)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n - 1, b, dtype=np.uint64)])) for b in (_B, pow(_B, -1, 1 << 64))]
    return _POWERS


def _mix(h):
    import numpy as np

    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _slide(f, a, n: int):
    """``f`` over each ``n`` neighbours, from the place itself on."""
    k = 1
    while 2 * k <= n:
        a = f(a[:-k], a[k:])
        k *= 2
    return f(a[: len(a) - (n - k)], a[n - k :]) if n > k else a


def anchors_of(units):
    """Anchors of several stretches of text.

    ``units``: (document, place of the stretch in it, bytes, first and last-but-one place to report).
    Returns hashes of the anchors' strings, their documents, places in those, and ``known``: an earlier anchor here has the same context.
    """
    import numpy as np

    sizes = np.array([len(u[2]) for u in units], dtype=np.int64)
    raw = np.frombuffer(b"".join(u[2] for u in units), dtype=np.uint8)
    n = len(raw)
    none = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return none.view(np.uint64), none, none, none.astype(bool)
    power, inverse = _powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    grams = n - GRAM + 1
    h = _mix((prefix[GRAM:] - prefix[:grams]) * inverse[:grams])
    order = h | np.uint64(1)  # never 0
    bad = np.zeros(n + 1, dtype=np.int32)  # windows that don't lie inside one unit
    last = np.maximum(ends - LENGTH + 1, starts)
    np.add.at(bad, last, 1)
    np.add.at(bad, ends, -1)
    bad = np.cumsum(bad)[: n - LENGTH + 1] > 0
    least = _slide(np.minimum, order, BEFORE + 1)
    least[bad] = 0
    most = _slide(np.maximum, np.concatenate([np.zeros(BEFORE, dtype=np.uint64), least, np.zeros(BEFORE, dtype=np.uint64)]), BEFORE + 1)
    at = np.flatnonzero(most == order)
    unit = np.searchsorted(ends, at, side="right")
    place = at - starts[unit] + np.array([u[1] for u in units], dtype=np.int64)[unit]
    own = (place >= np.array([u[3] for u in units], dtype=np.int64)[unit]) & (place < np.array([u[4] for u in units], dtype=np.int64)[unit])
    at, unit, place = at[own], unit[own], place[own]
    left, right = np.maximum(starts[unit], at - BEFORE), np.minimum(ends[unit], at + LENGTH)
    context = _mix(((prefix[right] - prefix[left]) * inverse[left]) ^ _mix((((at - left) << 16) | (right - left)).astype(np.uint64) + np.uint64(_B)))
    g, doc = h[at], np.array([u[0] for u in units], dtype=np.int64)[unit]
    order = np.lexsort((place, doc, context, g))
    g, x, doc, place, at, left, right = (c[order] for c in (g, context, doc, place, at, left, right))
    known = np.zeros(len(g), dtype=bool)
    known[1:] = (g[1:] == g[:-1]) & (x[1:] == x[:-1])
    first = np.maximum.accumulate(np.where(known, 0, np.arange(len(g))))
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(BEFORE + LENGTH, dtype=np.uint8)]), BEFORE + LENGTH)
    again = np.flatnonzero(known)
    for k in range(0, len(again), 1 << 14):  # equal hashes: compare the bytes
        b = again[k : k + (1 << 14)]
        a = first[b]
        size = (right - left)[b]
        same = ((view[left[b]] == view[left[a]]) | (np.arange(BEFORE + LENGTH) >= size[:, None])).all(axis=1)
        known[b] = same & (size == (right - left)[a]) & ((at - left)[b] == (at - left)[a])
    return g, doc, place, known


#: What is known of an anchor: nothing; its string occurs elsewhere, and others are to learn so from it; its string occurs
#: elsewhere; it repeats an earlier anchor's context.
LONE, TELLS, SHARED, KNOWN = range(4)
ANCHORS = T.StructType([T.StructField("g", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("kind", T.ByteType())])


def anchors(docs: DataFrame) -> DataFrame:
    """The anchors of all documents: g (string), doc, at and ``kind``.

    However often a string occurs, a task tells others of it once, in its first batch that holds it more than once.
    (A task remembers REMEMBERED strings; beyond those it tells once a batch.)
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        told = np.zeros(0, dtype=np.uint64)

        def emit(units):
            nonlocal told
            g, doc, place, known = anchors_of(units)
            kind = np.full(len(g), KNOWN, dtype=np.int8)
            open_ = np.flatnonzero(~known)
            _, start, where, count = np.unique(g[open_], return_index=True, return_inverse=True, return_counts=True)
            several, before = (count > 1)[where], np.isin(g[open_], told)
            tells = np.zeros(len(open_), dtype=bool)
            tells[start[count > 1]] = True
            kind[open_] = np.where(before | (several & ~tells), SHARED, np.where(tells, TELLS, LONE))
            if len(told) < REMEMBERED:
                told = np.concatenate([told, g[open_][tells & ~before]])
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32)), pa.array(kind)], names=ANCHORS.names)

        units, held = [], 0
        for b in text_batches(batches, rows=2000, chars=4 * SEGMENT):
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = (text or "").encode()
                if len(data) < LENGTH:
                    continue
                for a in range(0, len(data), SEGMENT):
                    lo, hi = max(0, a - 128), min(len(data), a + SEGMENT + 256)
                    units.append((doc, lo, data[lo:hi], a, a + SEGMENT))
                    held += hi - lo
                    if held >= SEGMENT:
                        yield emit(units)
                        units, held = [], 0
        if units:
            yield emit(units)

    return docs.select("doc", "text").mapInArrow(run, ANCHORS)


def candidates(found: DataFrame) -> DataFrame:
    """doc, at, g and kind of the anchors whose string's hash occurs more than once.

    Anchors that nobody has to hear of are dealt out by their place, so a very common string sends few rows of each task to one.
    """
    from pyspark.sql import Window

    key = F.when(F.col("kind") <= TELLS, F.col("g")).otherwise(F.xxhash64("doc", "at"))
    n = F.count("*").over(Window.partitionBy(key))
    return found.withColumn("n", n).where((F.col("kind") != LONE) | (F.col("n") > 1)).drop("n")


def graded(some: DataFrame) -> DataFrame:
    """doc, at and ``grade`` of candidates: 0 where the anchor's context occurs earlier, 1 where it must be sorted, 2 where its string has more than HOT to sort."""
    hot = written(some.where(F.col("kind") != KNOWN).groupBy("g").count().where(F.col("count") > HOT).select(F.col("g").alias("h")), "hot-strings")
    n = hot.count()
    grade = F.when(F.col("kind") == KNOWN, 0)
    if not n:
        return some.select("doc", "at", grade.otherwise(1).alias("grade"))
    joined = some.join(F.broadcast(hot) if 16 * n <= BROADCAST else hot, F.col("g") == F.col("h"), "left")
    return joined.select("doc", "at", grade.otherwise(F.when(F.col("h").isNull(), 1).otherwise(2)).alias("grade"))


# ---- Sorting


def windows_to_sort(n: int, anchors_):
    """Starts of all windows around some anchors, ascending."""
    import numpy as np

    mark = np.zeros(n + 2, dtype=np.int32)
    a = np.asarray(anchors_, dtype=np.int64)
    np.add.at(mark, np.maximum(0, a - BEFORE), 1)
    np.add.at(mark, np.minimum(a, n - LENGTH) + 1, -1)
    return np.flatnonzero(np.cumsum(mark) > 0)


def contexts_of(data, at):
    """For anchors: the suffixes from them on (padded to LENGTH), how long those are, what stands before (nearest first), and how long that is."""
    import numpy as np

    n = len(data)
    padded = np.concatenate([np.zeros(BEFORE, dtype=np.uint8), data, np.zeros(LENGTH, dtype=np.uint8)])
    behind = padded[at[:, None] + BEFORE + np.arange(LENGTH)]
    before = padded[at[:, None] + BEFORE - 1 - np.arange(BEFORE)]
    return behind, np.minimum(LENGTH, n - at).astype(np.uint8), before, np.minimum(BEFORE, at).astype(np.uint8)


def front_code(rows):
    """Sorted rows of equal length ((n, LENGTH) uint8) as shared prefix lengths and the rests, one after another."""
    import numpy as np

    differs = rows[1:] != rows[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1]) if len(rows) > 1 else np.zeros(0, dtype=np.int64)
    shared = np.r_[0, shared].astype(np.uint8)[: len(rows)]
    return shared, rows[np.arange(rows.shape[1])[None] >= shared[:, None]].tobytes()


def packed(values) -> bytes:
    """An array or bytes, compressed: runs are stored and exchanged like this."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(values if isinstance(values, bytes) else values.tobytes())


def unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data) if data else b""


_BLOBS = ("shared", "rest", "docs", "starts", "behind", "before", "befores")
RUNS = T.StructType([T.StructField("windows", T.BooleanType()), T.StructField("range", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in _BLOBS]])


def sorted_runs(texts: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Front-coded sorted runs of the suffixes to sort, one row for each range of the order that a run meets.

    Suffixes at anchors (column ``cold``) go with what stands before them, and ranges are cut between anchors'
    strings. Around the anchors in column ``hot`` every window is a suffix. A window, or an anchor with all its context, that a
    run holds twice is sent once, at its first place; the others are returned as rows of range -1: where the windows
    that repeat start (``starts``) and how many do (``behind``).
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        wide = np.array(splitters, dtype=f"S{LENGTH}")
        narrow = np.array(sorted({x[:GRAM] for x in splitters}), dtype=f"S{GRAM}")

        def record(windows, part, **blobs):
            return {"windows": windows, "range": part} | {c: b"" for c in _BLOBS} | {k: packed(v) for k, v in blobs.items()}

        def ranges(rows, cuts, width):
            keys = np.ascontiguousarray(rows[:, :width]).view(f"S{width}").ravel()
            part = np.searchsorted(cuts, keys, side="right") if len(cuts) else np.zeros(len(rows), dtype=np.int64)
            ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1
            return [(int(part[a]), a, e) for a, e in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

        def order_of(rows, docs, starts):
            order = np.lexsort((starts, docs))
            return order[np.argsort(np.ascontiguousarray(rows[order]).view(f"S{rows.shape[1]}").ravel(), kind="stable")]

        def emit(parts, windows):
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            whole = columns[0] if windows else np.concatenate([c.reshape(len(c), -1) for k, c in enumerate(columns) if k not in (1, 2)], axis=1)
            order = order_of(whole, *columns[1:3])
            whole = whole[order]
            columns = [c[order] for c in columns]
            same = np.r_[False, (whole[1:] == whole[:-1]).all(axis=1)]
            out = []
            if same.any():
                docs, starts = columns[1][same], columns[2][same]
                count = np.ones(len(docs), dtype=np.uint8)
                if not windows:
                    starts, count = starts - columns[5][same], columns[5][same] + columns[3][same] - np.uint8(LENGTH - 1)
                out.append(record(windows, -1, docs=docs.astype("<i8"), starts=starts.astype("<i4"), behind=count.astype(np.uint8)))
                columns = [c[~same] for c in columns]
            rows, docs, starts, *more = columns
            for part, a, e in ranges(rows, wide if windows else narrow, LENGTH if windows else GRAM):
                shared, rest = front_code(rows[a:e])
                out.append(record(windows, part, shared=shared, rest=rest, docs=docs[a:e].astype("<i8"), starts=starts[a:e].astype("<i4"), **{k: v[a:e] for k, v in zip(("behind", "before", "befores"), more, strict=False)}))
            return pa.RecordBatch.from_pylist(out, schema=_arrow(RUNS))

        held = {True: ([], 0), False: ([], 0)}
        for b in text_batches(batches, rows=1000):
            for doc, text, cold, hot in zip(*(b.column(c).to_pylist() for c in ("doc", "text", "cold", "hot")), strict=True):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
                for windows, at in ((True, windows_to_sort(len(data), hot) if hot else []), (False, np.array(cold, dtype=np.int64))):
                    for k in range(0, len(at), RUN):
                        own = at[k : k + RUN]
                        docs = np.full(len(own), doc, dtype=np.int64)
                        if windows:
                            part = (view[own], docs, own)
                        else:
                            behind, length, before, lengths = contexts_of(data, own)
                            part = (behind, docs, own, length, before, lengths)
                        parts, n = held[windows]
                        parts.append(part)
                        held[windows] = (parts, n + len(own))
                        if held[windows][1] >= RUN:
                            yield emit(held[windows][0], windows)
                            held[windows] = ([], 0)
        for windows, (parts, n) in held.items():
            if n:
                yield emit(parts, windows)

    return texts.select("doc", "text", "cold", "hot").mapInArrow(run, RUNS)


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class LoserTree:
    """Merge of front-coded runs that never compares a prefix twice.

    Each run's head knows how long a prefix it shares with the last suffix put out. Of two heads the one
    that shares more is smaller; only if both share alike are characters compared, from there on, and the
    loser remembers how far it agrees with the winner that passed it.
    """

    def __init__(self, runs: list[tuple[bytes, bytes]]):
        self.runs = runs
        self.n = len(runs)
        self.at, self.pos = [-1] * self.n, [0] * self.n
        self.head: list[bytes | None] = [b""] * self.n
        self.share = [0] * self.n
        self.size = 1 << max(0, (self.n - 1).bit_length())
        self.tree = [-1] * self.size
        for r in range(self.n):
            self._next(r)
            self.share[r] = 0
        self.best = self._build(1)

    def _next(self, r: int) -> None:
        shared, rest = self.runs[r]
        i = self.at[r] = self.at[r] + 1
        if i == len(shared):
            self.head[r] = None
            return
        k, p = shared[i], self.pos[r]
        e = self.pos[r] = p + LENGTH - k
        self.head[r] = self.head[r][:k] + rest[p:e]
        self.share[r] = k

    def _smaller(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads; an ended run (-1 or no head) loses."""
        if b < 0 or self.head[b] is None:
            return a, b
        if a < 0 or self.head[a] is None:
            return b, a
        share = self.share
        x, y = share[a], share[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        u, v = self.head[a], self.head[b]
        if u == v:
            share[b] = LENGTH
            return a, b
        while u[x : x + 8] == v[x : x + 8]:
            x += 8
        while u[x] == v[x]:
            x += 1
        if u[x] < v[x]:
            share[b] = x
            return a, b
        share[a] = x
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size if node - self.size < self.n else -1
        winner, self.tree[node] = self._smaller(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self):
        """(shared with the suffix before, run, number in the run) of all suffixes in order."""
        tree, head = self.tree, self.head
        while self.best >= 0 and head[self.best] is not None:
            r = self.best
            yield self.share[r], r, self.at[r]
            self._next(r)
            node, winner = (r + self.size) >> 1, r
            while node:
                winner, tree[node] = self._smaller(winner, tree[node])
                node >>= 1
            self.best = winner


#: A stretch of windows that repeat is one number: the first one's start times this, and how many follow each other.
STEP = 128


def repeated_among(group) -> list[tuple[int, int]]:
    """Which windows around anchors of one string occur earlier in the group.

    ``group``: (bytes shared with the one before, length, bytes before the anchor nearest first, doc, place) in
    sorted order. A window that begins ``a`` bytes before its anchor is equal to another's if they share
    LENGTH - a bytes from the anchor on, which those between two in sorted order share too, and ``a`` bytes before.
    """
    found: dict[tuple[int, int], list[int]] = {}
    for a in range(BEFORE + 1):
        need, first = LENGTH - a, {}
        for shared, length, before, doc, at in group:
            if shared < need:
                first = {}
            if length >= need and len(before) >= a:
                here, key = (doc, at), before[:a]
                known = first.get(key)
                if known is None:
                    first[key] = here
                elif here < known:
                    first[key] = here
                    found.setdefault(known, []).append(a)
                else:
                    found.setdefault(here, []).append(a)
    out = []
    for (doc, at), offsets in found.items():
        a = offsets[0]
        for b, c in zip(offsets, [*offsets[1:], -2], strict=True):
            if c != b + 1:
                out.append((doc, (at - b) * STEP + b - a + 1))
                a = c
    return out


def repeated_places(runs: DataFrame) -> DataFrame:
    """doc and ``stretch`` (start * STEP + number) of windows that occur earlier, from runs of all ranges."""

    def merge(pdf):
        import numpy as np
        import pandas as pd

        blobs = {c: [unpacked(x) for x in pdf[c]] for c in _BLOBS}
        docs = [np.frombuffer(x, dtype="<i8").tolist() for x in blobs["docs"]]
        starts = [np.frombuffer(x, dtype="<i4").tolist() for x in blobs["starts"]]
        merged = LoserTree(list(zip(blobs["shared"], blobs["rest"], strict=True)))
        out = []
        if pdf["windows"].iloc[0]:
            first = None
            for shared, r, i in merged:
                here = (docs[r][i], starts[r][i])
                if shared < LENGTH:
                    first = here
                else:
                    first, again = (here, first) if here < first else (first, here)
                    out.append((again[0], again[1] * STEP + 1))
        else:
            behind, before, befores = (blobs[c] for c in ("behind", "before", "befores"))
            group, contexts = [], {}
            for shared, r, i in merged:
                if shared < GRAM and group:
                    if len(group) > 1:
                        out += repeated_among(group)
                    group = []
                if shared < LENGTH:
                    contexts = {}
                one = (shared if group else 0, behind[r][i], before[r][i * BEFORE : i * BEFORE + befores[r][i]], docs[r][i], starts[r][i])
                known = contexts.setdefault(one[1:3], len(group))
                if known == len(group):
                    group.append(one)
                    continue
                if one[3:] < group[known][3:]:
                    one, group[known] = group[known], (group[known][0], *one[1:])
                out.append((one[3], (one[4] - len(one[2])) * STEP + len(one[2]) + one[1] - LENGTH + 1))
            if len(group) > 1:
                out += repeated_among(group)
        return pd.DataFrame(out, columns=["doc", "stretch"]).astype("int64")

    return runs.where("range >= 0").groupBy("windows", "range").applyInPandas(merge, "doc long, stretch long")


# ---- The operator


def _ordered_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with ``doc``, a number that orders them as doc_id does, and one row (doc, text) of each number.

    Usually doc_id itself. Where ids repeat or are null, rows are numbered by (doc_id, hash of the
    text), nulls first; rows equal in both share a number.
    """
    from lakeloom.llm.sharding import number_in_order

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.where("n > 1 or doc_id is null").head(1):
        docs = docs.withColumn("doc", F.col("doc_id"))
        return docs, docs.select("doc", "text")
    docs = docs.withColumn("h", F.xxhash64("text"))
    known = number_in_order(docs.select("doc_id", "h").distinct(), [F.asc_nulls_first("doc_id"), F.col("h").asc()], "doc")
    known = known.select(F.col("doc_id").alias("k"), F.col("h").alias("kh"), "doc")
    docs = written(docs.join(known, F.expr("doc_id <=> k and h = kh")).select("doc_id", "text", "doc"), "ordered")
    return docs, docs.groupBy("doc").agg(F.first("text").alias("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc, ``whole`` (anchors whose whole context occurs earlier) and ``stretches`` (windows that do) of documents (doc, text)."""
    spark = docs.sparkSession
    found = graded(written(candidates(anchors(docs)), "candidates"))
    lists = [F.collect_list(F.when(F.col("grade") == k, F.col("at"))).alias(c) for k, c in enumerate(("whole", "cold", "hot"))]
    by_doc = written(found.groupBy("doc").agg(*lists), "by-document")
    open_ = by_doc.where("size(cold) + size(hot) > 0").drop("whole")
    sums = open_.agg(F.sum(F.size("cold") + F.size("hot") + 8).alias("cost"), F.sum(F.size("cold") + (BEFORE + 1) * F.size("hot")).alias("suffixes")).first()
    cost, suffixes = sums["cost"] or 0, sums["suffixes"] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes // RANGE))
    few = open_.orderBy(F.xxhash64("doc")).limit(SAMPLE)
    ids = [r["doc"] for r in few.select("doc").collect()]
    splitters = _splitters(docs.where(F.col("doc").isin(ids)).join(F.broadcast(few), "doc"), ranges) if ids and ranges > 1 else []
    runs = written(sorted_runs(docs.join(F.broadcast(open_) if 4 * cost <= BROADCAST else open_, "doc"), splitters), "runs")

    def places(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for d, s, n in zip(*(map(unpacked, b.column(c).to_pylist()) for c in ("docs", "starts", "behind")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(d, dtype="<i8")), pa.array(np.frombuffer(s, dtype="<i4").astype(np.int64) * STEP + np.frombuffer(n, dtype=np.uint8))], names=["doc", "stretch"])

    again = runs.where("range < 0").select("docs", "starts", "behind").mapInArrow(places, "doc long, stretch long")
    stretches = repeated_places(runs).unionByName(again).groupBy("doc").agg(F.collect_list("stretch").alias("stretches"))
    return by_doc.where(F.size("whole") > 0).select("doc", "whole").join(stretches, "doc", "full_outer")


def _splitters(sample: DataFrame, ranges: int) -> list[bytes]:
    """Suffixes that cut a bounded sample's order into equal parts; they decide balance, not results."""

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        for b in text_batches(batches, rows=100):
            out = []
            for text, cold, hot in zip(*(b.column(c).to_pylist() for c in ("text", "cold", "hot")), strict=True):
                data = text.encode()
                at = np.array([*cold, *(windows_to_sort(len(data), hot) if hot else [])], dtype=np.int64)
                out += [data[a : a + LENGTH] for a in at[:: -(-len(at) // DRAWN)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["suffix"])

    own = sorted({bytes(r["suffix"]) for r in sample.select("text", "cold", "hot").mapInArrow(draw, "suffix binary").collect()})  # at most SAMPLE * DRAWN
    return sorted({own[len(own) * k // ranges] for k in range(1, ranges)}) if own else []


def removal(n: int, whole, stretches):
    """Which of ``n`` bytes are covered by a repeated window."""
    import numpy as np

    mark = np.zeros(n + 1, dtype=np.int32)
    a = np.asarray(whole if whole is not None else [], dtype=np.int64)
    np.add.at(mark, np.maximum(0, a - BEFORE), 1)
    np.add.at(mark, np.minimum(n, a + LENGTH), -1)
    s, k = np.divmod(np.asarray(stretches if stretches is not None else [], dtype=np.int64), STEP)
    np.add.at(mark, s, 1)
    np.add.at(mark, s + k - 1 + LENGTH, -1)
    return np.cumsum(mark[:-1]) > 0


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the bytes that stay) of each document.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of a
    smaller doc_id, or in the same one before. Strings are judged on the input; matches never cross
    documents. Null texts are empty. Null doc_ids come first; rows that repeat a doc_id are ordered
    by their text's hash, and rows equal in both count as one document and share a result. An empty table gives no
    rows. Columns other than doc_id and text are left out.
    """
    ordered, once = _ordered_ids(docs)
    found = repeats(once)
    joined = ordered.join(found, "doc", "left").select("doc_id", "text", "whole", "stretches")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in text_batches(batches, rows=1000):
            out = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for doc, text, whole, stretches in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "whole", "stretches")), strict=True):
                data = (text or "").encode()
                kept, removed, spans = data, 0, 0
                if whole or stretches:
                    gone = removal(len(data), whole, stretches)
                    kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                    removed, spans = int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())
                for c, v in zip(out, (doc, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    return joined.mapInArrow(run, schema)
