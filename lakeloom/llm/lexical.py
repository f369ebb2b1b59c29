"""Ranked lexical search over a two-level quantised index.

The index holds, for each block of documents, the block's terms in order and each term's postings: document, term frequency, and
the posting's impact rounded upward to a byte. The first level is the largest byte of each term in the block, the second the
bytes themselves. A query adds weight times byte over its terms, which bounds a score from above and, with one step less for
each byte, from below. Blocks whose first level can't reach the bound are left out, the k-th highest lower bound over all blocks is
what a document has to reach, and each document whose upper bound does is scored anew with exact integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.shared import text_batches, written

# What a term is, and the letters that are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values of the score: (GAIN * tf) div (UNIT * tf + LENGTH_WEIGHT * m), m = FLAT + (SLOPE * n * N) div L.
GAIN, UNIT, LENGTH_WEIGHT, FLAT, SLOPE = 1_000_000_000, 1000, 8, 10, 90
#: An impact is less than GAIN / UNIT; a byte counts steps of this size.
STEP = -(-GAIN // UNIT // 255)
#: Documents of a block, and pairs of item and term that one pass over the index takes along.
BLOCK, PAIRS = 512, 1_000_000
_LOWERED = str.maketrans(UPPER, LOWER)
_terms = re.compile(TERM).findall

_INDEX = "block long, documents array<long>, m array<long>, terms string, starts binary, places binary, frequencies binary, bytes binary, largest binary"


def terms_of(text: str | None) -> list[str]:
    return _terms(text.translate(_LOWERED) if not text.isascii() else text.lower()) if text else []


def corpus_sizes(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and of all terms."""
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    r = docs.select(n.alias("n")).agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    return r[0] or 0, r[1] or 0


def _impacts(tf, m):
    return GAIN * tf // (UNIT * tf + LENGTH_WEIGHT * m)


def build_index(docs: DataFrame, documents: int, total: int) -> DataFrame:
    """One row for each block of documents; null and termless texts have no postings. ``documents`` and ``total`` are ``corpus_sizes``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in text_batches(batches, BLOCK):
            places: dict[str, int] = {}
            term, count, sizes, lengths = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = terms_of(text)
                counts = Counter(own)
                term += [places.setdefault(t, len(places)) for t in counts]
                count += counts.values()
                sizes.append(len(counts))
                lengths.append(len(own))
            m = FLAT + SLOPE * np.array(lengths, dtype=np.int64) * documents // max(total, 1)
            names = sorted(places)
            rank = np.empty(len(names), dtype=np.int64)
            rank[[places[t] for t in names]] = np.arange(len(names))
            term, tf, doc = rank[np.array(term, dtype=np.int64)], np.array(count, dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(term, kind="stable")
            term, tf, doc = term[order], tf[order], doc[order]
            upward = (-(-_impacts(tf, m[doc]) // STEP)).astype(np.uint8)
            starts = np.searchsorted(term, np.arange(len(names) + 1))
            largest = np.maximum.reduceat(upward, starts[:-1]) if len(term) else upward
            binary = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + number]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([m], pa.list_(pa.int64())), pa.array(["\n".join(names)], pa.string()),
                    binary(starts, "<u4"), binary(doc, "<u2"), binary(tf, "<u4"), binary(upward, "u1"), binary(largest, "u1"),
                ], names=["block", "documents", "m", "terms", "starts", "places", "frequencies", "bytes", "largest"],
            )
            number += 1

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, _INDEX)


def document_frequencies(index: DataFrame, wanted: frozenset[str]) -> dict[str, int]:
    """How many documents hold each of the wanted terms. Each block tells its own; the sums are as many as the wanted terms."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own: Counter[str] = Counter()
            for names, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                n = np.diff(np.frombuffer(starts, "<u4").astype(np.int64)).tolist()
                own.update({t: k for t, k in zip(names.split("\n"), n, strict=False) if t in wanted})
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["term", "df"])

    return dict(map(tuple, index.select("terms", "starts").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df")).collect()))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class _Block:
    """A block's postings of the terms that some item asks for, as rows of terms by documents."""

    def __init__(self, row: dict, terms: dict[str, int]):
        import numpy as np

        self.documents, names = row["documents"], row["terms"].split("\n")
        at = [(terms[t], k) for k, t in enumerate(names) if t in terms] if row["starts"][4:] else []
        self.terms, own = np.array([t for t, _ in at], dtype=np.int64), np.array([k for _, k in at], dtype=np.int64)
        starts = np.frombuffer(row["starts"], "<u4").astype(np.int64)
        self.first, self.sizes = starts[own], starts[own + 1] - starts[own]
        self.largest = np.frombuffer(row["largest"], "u1")[own].astype(np.float64)
        self.row = row

    def table(self, name: str, kind: str):
        """The postings' values as a dense table, terms by documents."""
        import numpy as np

        out = np.zeros((len(self.terms), len(self.documents)), dtype=np.float64 if kind == "u1" else np.int64)
        at = np.repeat(self.first - np.concatenate([[0], np.cumsum(self.sizes)])[: len(self.sizes)], self.sizes) + np.arange(self.sizes.sum())
        out[np.repeat(np.arange(len(self.terms)), self.sizes), np.frombuffer(self.row["places"], "<u2")[at]] = np.frombuffer(self.row[name], kind)[at]
        return out


class Asked:
    """Items' terms and weights, item after item: term numbers, the weights of these as integers, and whose they are."""

    def __init__(self, items: list[list[str]], df: dict[str, int], documents: int):
        import numpy as np

        held = sorted({t for own in items for t in own if t in df})
        self.terms = {t: k for k, t in enumerate(held)}
        weights = np.array([weight(documents, df[t]) for t in held], dtype=np.int64)
        own = [sorted({self.terms[t] for t in o if t in df}) for o in items]
        self.n, self.numbers = len(items), np.array([t for o in own for t in o], dtype=np.int64)
        self.of = np.repeat(np.arange(len(items)), [len(o) for o in own])
        self.weights = weights[self.numbers]

    def reaching(self, block: _Block, least):
        """By the first level: the items that some document of the block may bring to ``least``, each with its terms' places in the block and their weights."""
        import numpy as np

        place = np.full(len(self.terms), -1, dtype=np.int64)
        place[block.terms] = np.arange(len(block.terms))
        at = place[self.numbers]
        held = at >= 0
        at, of, w = at[held], self.of[held], self.weights[held]
        most = STEP * np.bincount(of, weights=w * block.largest[at], minlength=self.n)
        live = np.nonzero(most >= least)[0]
        first, last = np.searchsorted(of, live), np.searchsorted(of, live, side="right")
        return [(i, at[a:b], w[a:b]) for i, a, b in zip(live.tolist(), first.tolist(), last.tolist(), strict=True)]


def _bounds(asked: Asked, k: int):
    """For mapInArrow: each item's k highest lower bounds of scores in the task's blocks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        best, least = {}, np.ones(asked.n)
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, asked.terms)
                live = asked.reaching(block, least)
                if not live:
                    continue
                steps = block.table("bytes", "u1")
                low = np.where(steps > 0, (steps - 1) * STEP + 1, 0.0)
                for i, at, w in live:
                    values = w @ low[at]
                    values = values[values >= least[i]]
                    if len(values):
                        own = np.concatenate([best[i], values]) if i in best else values
                        best[i] = own if len(own) <= k else np.partition(own, len(own) - k)[-k:]
                        if len(best[i]) == k:
                            least[i] = max(1, best[i].min())
        items = sorted(best)
        sizes = [len(best[i]) for i in items]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(items, dtype=np.int64), sizes), pa.int64()), pa.array(np.concatenate([best[i] for i in items]).astype(np.int64) if items else [], pa.int64())], names=["item", "low"])

    return run


def _scored(asked: Asked, least: dict[int, int], k: int):
    """For mapInArrow: exact scores of all documents whose upper bound reaches the item's k-th lower bound; the k best of each task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        needed = np.array([max(1, least.get(i, 1)) for i in range(asked.n)], dtype=np.float64)
        out: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, asked.terms)
                live = asked.reaching(block, needed)
                if not live:
                    continue
                steps, m, frequencies = block.table("bytes", "u1"), np.array(row["m"], dtype=np.int64), None
                for i, at, w in live:
                    docs = np.nonzero(STEP * (w @ steps[at]) >= needed[i])[0]
                    if not len(docs):
                        continue
                    frequencies = block.table("frequencies", "<u4") if frequencies is None else frequencies
                    tf = frequencies[np.ix_(at, docs)]
                    scores = w @ np.where(tf > 0, _impacts(tf, m[docs]), 0)
                    rows = out.setdefault(i, [])
                    rows += [(-s, row["documents"][d] is None, row["documents"][d] or 0) for s, d in zip(scores.tolist(), docs.tolist(), strict=True) if s > 0]
                    if len(rows) > 16 * k:
                        out[i] = sorted(rows)[:k]
        rows = [(i, -s, None if gone else d) for i, own in out.items() for s, gone, d in sorted(own)[:k]]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "score", "doc_id"])

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score: each item's k documents with the highest scores above 0, equal scores by doc_id.

    Null and termless texts score nothing, as items or documents, and don't count as documents. Each row of ``docs`` is a document of its
    own; null ids come last among equal scores. Rows equal in item_id and text are one item; null item ids are kept. Empty tables give no rows.
    ``items`` is taken in passes of at most PAIRS pairs of item and term (about; an item is never cut), so what a task holds of them is bounded.
    """
    spark = docs.sparkSession
    documents, total = corpus_sizes(docs)
    index = written(build_index(docs, documents, total), "lexical-index", rows=BLOCK)
    items = items.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").distinct().withColumn("terms", F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))))
    items = written(items.where(F.size("terms") > 0).select("item_id", "terms", F.xxhash64("item_id", "text").alias("dealt")), "lexical-items")
    pairs = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = -(-pairs // PAIRS)
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for n in range(passes):
        found = found.unionByName(_pass(index, items.where(F.pmod("dealt", F.lit(passes)) == n), documents, k))
    return found


def _pass(index: DataFrame, items: DataFrame, documents: int, k: int) -> DataFrame:
    """``ranked`` for items that are few enough to be sent to all tasks."""
    spark = index.sparkSession
    rows = items.orderBy("item_id", "dealt").collect()
    df = document_frequencies(index, frozenset(t for r in rows for t in r["terms"]))
    asked = Asked([r["terms"] for r in rows], df, documents)
    # One row for each item and task; of these, what is k-th.
    by = Window.partitionBy("item").orderBy(F.desc("low"))
    lows = index.select("documents", "terms", "starts", "places", "bytes", "largest").mapInArrow(_bounds(asked, k), "item long, low long")
    least = dict(map(tuple, lows.withColumn("n", F.row_number().over(by)).where(F.col("n") == k).select("item", "low").collect()))
    scored = written(index.mapInArrow(_scored(asked, least, k), "item long, score long, doc_id long"), "lexical-scores", rows=BLOCK)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(rows)], "item long, item_id long")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "doc_id", "score")
