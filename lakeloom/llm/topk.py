"""Exact top-k by inner product with norm-bucketed retrieval.

Components become integers, floor(scale * x). All vectors are put in order of length and cut into groups (one task's work) and
those into buckets of similar length. The longest groups are searched first; they give each query a lower bound of its k-th
score, which the rest must reach. In a bucket, the bound over the query's length and the bucket's longest vector is a local
cosine threshold: above 1 the bucket is left out, else it chooses between the two ways of pruning. Length: only the vectors
long enough to reach the bound. Coordinate: only those whose unit vector lies, on the query's largest coordinate, in the
interval that the threshold leaves (found by binary search in the bucket's sorted coordinate). What is left is verified by
exact integer products. Nothing is approximate.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.shared import written

#: Vectors of a group and of a bucket, and queries of a block.
GROUP, BUCKET, QUERIES = 8192, 1024, 2048
#: One of so many groups, the longest vectors, gives the first bounds.
HEAD = 16
#: Coordinate pruning is taken where it leaves at most this share of what length pruning leaves.
COORDINATE = 0.25
#: Integers saturate here: components at what products of long vectors can take, scores at 64 bits.
LARGEST, HIGHEST = 2**62, 2**63 - 1
#: Floating-point bounds are loosened by this share, so that rounding never prunes.
SLACK = 1e-9

def _integers(vectors: list, scale: int) -> list:
    """Each vector as an integer array, or None where it is null or holds null or non-finite components."""
    import numpy as np

    out = []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.floor(scale * np.asarray(v, dtype=np.float64))
        out.append(None if x is None or not np.isfinite(x).all() else np.where(abs(x) >= LARGEST, np.sign(x) * float(LARGEST), x).astype(np.int64))
    return out


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, length and the integer components (64 bits each, little-endian) of the rows that take part."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, column = b.column("vec_id"), b.column("embedding")
            values = column.flatten()
            sizes = np.diff(column.offsets.to_numpy())
            plain = not column.null_count and not values.null_count and len(sizes) and (sizes == sizes[0]).all() and sizes[0]
            x = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(sizes), -1) if plain else None
            own = list(x.astype(np.int64)) if plain and (abs(x) < LARGEST).all() else _integers(column.to_pylist(), scale)
            at = [k for k, (i, v) in enumerate(zip(ids.to_pylist(), own, strict=True)) if i is not None and v is not None]
            kept = [own[k] for k in at]
            length = [float(np.sqrt((v.astype(np.float64) ** 2).sum())) for v in kept]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(length, pa.float64()), pa.array([v.astype("<i8").tobytes() for v in kept], pa.binary())], names=["vec_id", "length", "vector"])

    return vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding").mapInArrow(run, "vec_id long, length double, vector binary")


def _matrix(vectors: list[bytes], dims: int):
    """Vectors as rows, padded with zeros."""
    import numpy as np

    if all(len(v) == 8 * dims for v in vectors):
        return np.frombuffer(b"".join(vectors), dtype="<i8").reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v) // 8] = np.frombuffer(v, dtype="<i8")
    return out


def _packed(matrix) -> tuple[bytes, int]:
    """The matrix in as few bytes for each component as hold it."""
    top = int(abs(matrix).max(initial=0))
    width = next(w for w, most in ((2, 2**15 - 1), (4, 2**31 - 1), (8, 2**63 - 1)) if top <= most)
    return matrix.astype(f"<i{width}").tobytes(), width


def _blocks(size: int):
    """For mapInArrow: rows of (vec_id, length, vector) packed by ``size``, equal rows next to each other once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, rows, last = TaskContext.get().partitionId(), 0, [], None

        def block():
            nonlocal number, rows
            ids, lengths, vectors = zip(*rows, strict=True)
            dims = max(len(v) for v in vectors) // 8
            data, width = _packed(_matrix(vectors, dims))
            columns = [pa.array([x]) for x in ((part << 32) + number, len(rows), dims, width)] + [pa.array([max(lengths)]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array(lengths, "<f8").tobytes()], pa.binary()), pa.array([data], pa.binary())]
            number, rows = number + 1, []
            return pa.RecordBatch.from_arrays(columns, names=["block", "n", "dims", "width", "longest", "ids", "lengths", "data"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row != last:
                    rows.append(row)
                    last = row
                if len(rows) == size:
                    yield block()
        if rows:
            yield block()

    return run


_BLOCK = "block long, n long, dims long, width long, longest double, ids binary, lengths binary, data binary"


class _Bucket:
    """Vectors of similar length, longest first, with their unit vectors' coordinates sorted when first asked for."""

    def __init__(self, ids, lengths, matrix):
        import numpy as np

        self.ids, self.lengths, self.matrix, self.sorted = ids, lengths, matrix, {}
        self.largest = int(abs(matrix).max(initial=0))
        self.floats = matrix.astype(np.float64)

    def coordinate(self, c: int):
        import numpy as np

        if c not in self.sorted:
            unit = self.floats[:, c] / np.maximum(self.lengths, 1e-300)
            order = np.argsort(unit, kind="stable")
            self.sorted[c] = order, unit[order]
        return self.sorted[c]

    def products(self, rows, queries, floats, largest: int):
        """Exact integer products of some rows with some queries; scores beyond 64 bits saturate."""
        import numpy as np

        if self.largest * largest * max(1, queries.shape[1]) < 2**53:  # every sum is exact in doubles
            return (self.floats[rows] @ floats.T).astype(np.int64)
        exact = self.matrix[rows].astype(object) @ queries.astype(object).T
        return np.clip(exact, -HIGHEST, HIGHEST).astype(np.int64)


class _Best:
    """The best k candidates of each query of a block, and the bound that the next ones must reach."""

    def __init__(self, k: int, bounds):
        self.k, self.bounds, self.rows = k, bounds, {}

    def add(self, query: int, scores, ids) -> None:
        import numpy as np

        if query in self.rows:
            scores, ids = np.concatenate([self.rows[query][0], scores]), np.concatenate([self.rows[query][1], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.rows[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.bounds[query] = max(self.bounds[query], int(scores[order[-1]]))


def _search(best: _Best, ids, lengths, queries, bucket: _Bucket) -> None:
    """All queries of a block against one bucket."""
    import numpy as np

    floats, largest = queries.astype(np.float64), int(abs(queries).max(initial=0))
    bounds = best.bounds
    needed = np.array([float(x) for x in bounds]) * (1 - SLACK)
    positive = needed > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(positive, needed / lengths, 0.0)  # the length that a candidate has at least
    cosine = np.where(positive, least / max(bucket.lengths[0], 1e-300), -1.0)
    # Lengths fall along the bucket: so many of its vectors are long enough.
    long = np.searchsorted(-bucket.lengths, -least * (1 - SLACK), side="right")
    long = np.where(positive, long, len(bucket.ids))
    by_length = []
    for q in np.nonzero((cosine <= 1 + SLACK) & (long > 0))[0].tolist():
        t = float(cosine[q]) - SLACK
        if t > 0:
            unit = floats[q] / lengths[q]
            c = int(np.argmax(abs(unit)))
            order, values = bucket.coordinate(c)
            t = min(1.0, t)
            reach = math.sqrt(max(0.0, (1 - t * t) * (1 - float(unit[c]) ** 2))) + 1e-7
            low, high = t * float(unit[c]) - reach, t * float(unit[c]) + reach
            # Beyond the arc's end the whole side is within the angle.
            low, high = (-math.inf if -unit[c] >= t else low), (math.inf if unit[c] >= t else high)
            first, last = np.searchsorted(values, low, side="left"), np.searchsorted(values, high, side="right")
            if last - first <= COORDINATE * long[q]:
                rows = order[first:last]
                _keep(best, q, ids, bucket.products(rows, queries[q : q + 1], floats[q : q + 1], largest)[:, 0], bucket.ids[rows])
                continue
        by_length.append(q)
    if by_length:
        some = np.array(by_length)
        rows = slice(0, int(long[some].max()))
        scores = bucket.products(rows, queries[some], floats[some], largest)
        for at, q in enumerate(by_length):
            _keep(best, q, ids, scores[:, at], bucket.ids[rows])


def _keep(best: _Best, q: int, ids, scores, candidates) -> None:
    import numpy as np

    at = np.nonzero(scores >= best.bounds[q])[0]
    at = at[candidates[at] != ids[q]]
    if len(at):
        best.add(q, scores[at], candidates[at])


def _searched(k: int):
    """For mapInArrow: one row is a block of queries and a group of vectors; out come the best k of each query in it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                dims = max(r["dims"], r["q_dims"])
                unpack = lambda data, width, n, d: np.pad(np.frombuffer(data, f"<i{width}").reshape(n, d).astype(np.int64), ((0, 0), (0, dims - d)))
                vectors, queries = unpack(r["data"], r["width"], r["n"], r["dims"]), unpack(r["q_data"], r["q_width"], r["q_n"], r["q_dims"])
                ids, lengths = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["lengths"], "<f8")
                own, own_lengths = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_lengths"], "<f8")
                best = _Best(k, [-HIGHEST] * r["q_n"])
                for x in r["bounds"] or ():
                    best.bounds[x["place"]] = x["score"]
                for start in range(0, r["n"], BUCKET):
                    part = slice(start, start + BUCKET)
                    _search(best, own, own_lengths, queries, _Bucket(ids[part], lengths[part], vectors[part]))
                places = sorted(best.rows)
                counts = [len(best.rows[p][0]) for p in places]
                column = lambda values, kind: pa.array(np.concatenate(values) if values else [], kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(sum(counts), r["q_block"]), pa.int64()), pa.array(np.repeat(places, counts), pa.int32()), pa.array(np.repeat(own[places], counts), pa.int64()),
                        column([best.rows[p][1] for p in places], pa.int64()), column([best.rows[p][0] for p in places], pa.int64()),
                    ], names=["q_block", "place", "query_id", "vec_id", "score"],
                )

    return run


_FOUND = "q_block long, place int, query_id long, vec_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


_QUERY = "q_block long, q_n long, q_dims long, q_width long, q_ids binary, q_lengths binary, q_data binary"


def _reach(batches):
    """For mapInArrow: ``reach`` is the least length with which a vector can still be found by some query of the block."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        out = []
        for r in b.select(["q_n", "q_lengths", "bounds"]).to_pylist():
            least = np.full(r["q_n"], -np.inf)
            lengths = np.frombuffer(r["q_lengths"], "<f8")
            for x in r["bounds"] or ():
                if x["score"] > 0:
                    least[x["place"]] = x["score"] / lengths[x["place"]] * (1 - SLACK)
            out.append(float(least.min()))
        names = [n for n in b.schema.names if n != "bounds"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.float64()), b.column("bounds")], names=[*names, "reach", "bounds"])


def _pairs(queries: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """Each block of queries with each group of vectors long enough for one of them."""
    spread = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "part")
    own = index.withColumn("part", F.shiftright("block", 32).cast("int")).repartition(parts, "part")
    return spread.join(own, (spread["part"] == own["part"]) & (F.col("longest") >= F.col("reach"))).drop("part", "longest", "reach")


def top_products(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest integer inner products of each row whose vec_id is divisible by ``every``, ties to the smaller vec_id.

    Rows with a null vec_id, and vectors that are null or hold null or non-finite components, take no part. Vectors of different
    sizes are compared as if padded with zeros. Rows equal in vec_id and vector count once; of different vectors with one vec_id each is a query
    or candidate of its own, and none is a candidate of its own vec_id. Integer components saturate at 2**62, scores at 64 bits. Other columns are left out. Without queries there are no rows.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale)
    groups = max(1, math.ceil(vectors.count() / GROUP))
    # A unique last key cuts vectors of one length; equal rows meet in one task, side by side.
    ordered = rows.repartitionByRange(groups, F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id", "vector")
    index = written(ordered.mapInArrow(_blocks(GROUP), _BLOCK), "norm-index", rows=1000)
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    n = asked.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = written(asked.repartition(math.ceil(n / QUERIES)).mapInArrow(_blocks(QUERIES), _BLOCK), "norm-queries", rows=1000)
    queries = queries.select(*(F.col(c).alias(f"q_{c}") for c in ("block", "n", "dims", "width", "ids", "lengths", "data")))
    # Ranges of length are numbered from the longest on.
    parts = index.agg(F.max(F.shiftright("block", 32))).first()[0] + 1
    first = math.ceil(parts / HEAD)
    in_head = F.shiftright("block", 32) < first
    no_bounds = queries.withColumns({"reach": F.lit(float("-inf")), "bounds": F.lit(None).cast("array<struct<place:int,score:long>>")})
    head = written(_pairs(no_bounds, index.where(in_head), first).mapInArrow(_searched(k), _FOUND), "norm-head", rows=4)
    bounds = _best(head, k).where(F.col("rank") == k).groupBy("q_block").agg(F.collect_list(F.struct("place", "score")).alias("bounds"))
    bounded = written(queries.join(bounds, "q_block", "left").mapInArrow(_reach, f"{_QUERY}, reach double, bounds array<struct<place:int,score:long>>"), "norm-bounded", rows=4)
    return _best(head.unionByName(written(_pairs(bounded, index.where(~in_head), parts).mapInArrow(_searched(k), _FOUND), "norm-rest", rows=4)), k).select("query_id", "rank", "vec_id", "score")
