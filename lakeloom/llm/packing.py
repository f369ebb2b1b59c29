"""Best-fit decreasing packing of token runs into sequences of a fixed length.

Best-fit decreasing looks at nothing but lengths, and documents of one length are alike to it. So
Spark counts the pieces of each length, the plan is made from that histogram (at most one entry for
each length up to the capacity, whatever the number of documents), and Spark deals the places of
the plan out to the pieces by their rank among those of their length. The packing is that of
best-fit decreasing over all pieces at once; no bin is cut at a partition's border.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.shared import PieceEncoder, text_batches, written


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the tightest that fits.

    A leaf for each remaining capacity holds ranges of equal bins; an inner node tells whether any
    leaf below it is filled. ``tightest`` walks up and down the tree, in logarithmic time.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.filled = [False] * (2 * self.size)
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _mark(self, room: int) -> None:
        i = room + self.size
        self.filled[i] = bool(self.ranges[room])
        while i > 1:
            i >>= 1
            self.filled[i] = self.filled[2 * i] or self.filled[2 * i + 1]

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.ranges[room].append((first, count))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].pop()
        self._mark(room)
        return out

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open bin that is ``length`` at least."""
        i = length + self.size
        if self.filled[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.filled[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.filled[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram of lengths.

    Returns placements (length, first rank, ranks, ranks in each bin, first bin, offset) and the
    number of bins. The r-th rank of a placement lies in bin ``first bin + r // each`` at
    ``offset + r % each * length``. Pieces of one length that follow each other fill the tightest
    bin until they don't fit, which is what best fit does with them one by one.
    """
    bins, places, used = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first, many = capacity, used, -(-left // (capacity // length))
                used += many
            else:
                first, many = bins.take(room)
            each = room // length
            full = min(many, left // each)
            if full:
                places.append((length, rank, full * each, each, first, capacity - room))
                bins.put(room - each * length, first, full)
                left, rank = left - full * each, rank + full * each
                first, many = first + full, many - full
            if many and left and left < each:
                places.append((length, rank, left, left, first, capacity - room))
                bins.put(room - left * length, first, 1)
                left, rank, first, many = 0, rank + left, first + 1, many - 1
            bins.put(room, first, many)
    return places, used


PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()),
])


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Documents as pieces of ``capacity`` tokens at most; ``part`` and ``rank`` number the pieces of a length."""

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, end = PieceEncoder.shared(tokenizer, keeps_blanks=False), end_id.to_bytes(4, "little")
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in text_batches(batches):
            out = {f.name: [] for f in PIECE}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text").to_pylist()), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    own = ids[k : k + 4 * capacity]
                    n = len(own) // 4
                    for name, v in (("doc_id", doc), ("piece", k // 4 // capacity), ("start", k // 4), ("length", n), ("ids_crc32", zlib.crc32(own)), ("ids", own if with_ids else None), ("part", part), ("rank", seen[n])):
                        out[name].append(v)
                    seen[n] += 1
            yield pa.RecordBatch.from_pydict(out, schema=_arrow(PIECE))

    return docs.select("doc_id", "text").mapInArrow(encode, PIECE)


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack documents (``doc_id``, ``text``) into as few sequences of ``capacity`` tokens as best-fit decreasing finds.

    Each document is its ids and then ``end_id``. Only documents over the capacity are cut, into
    pieces of exactly the capacity and a last one. Returns a row for each piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset, and with ``with_ids`` the ids (little-endian
    32-bit). Null and empty texts are the end id alone. Null and repeated doc_ids keep their rows.
    Equal lengths are placed in the order in which the tasks met them. An empty table gives no rows.
    Columns other than doc_id and text are left out.
    """
    pieces = written(tokenized_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    return place(pieces, capacity)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give each piece (``length``, ``part``, ``rank`` within part and length) its sequence and offset."""
    spark = pieces.sparkSession
    parts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places, _ = plan_bins(counts, capacity)
    fields = ["length", "from_rank", "ranks", "each", "first_bin", "at"]
    plan = spark.createDataFrame([tuple(map(int, p)) for p in places], T.StructType([T.StructField(c, T.LongType()) for c in fields]))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("r", F.col("before") + F.col("rank"))
    # The plan has a few rows for each length up to the capacity, whatever the input; beyond this it isn't broadcast.
    plan = F.broadcast(plan) if len(places) <= 64 * capacity else plan
    own = (F.col("r") - F.col("from_rank"))
    return (
        ranked.join(plan, "length").where((own >= 0) & (own < F.col("ranks")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_bin") + F.floor(own / F.col("each"))).alias("sequence_id"), (F.col("at") + own % F.col("each") * F.col("length")).alias("offset"), "ids")
    )
