"""Sharding along a Hilbert curve over several metadata dimensions.

Rows that are near in all dimensions are near on the curve, so a shard, being a run of the curve,
spans a small box of every dimension and a reader can skip shards by any of them.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.shared import written

#: Groups of equal texts (24 bytes each) that are broadcast at most to place their rows.
GROUPS = 1_000_000


def hilbert_index(codes, bits: int):
    """Positions on the Hilbert curve of points given as an (n, d) array of codes under ``2**bits``.

    The curve's state (which axis leads, which axes are mirrored) is undone bit by bit from the
    highest: an axis whose bit is set mirrors the leading axis below it, one whose bit is clear
    swaps with it. The bits that remain, interleaved and read as a Gray code, are the position.
    """
    import numpy as np

    x = np.array(codes, dtype=np.int64, copy=True)
    d = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(d):
            is_set = (x[:, axis] & bit) != 0
            swap = np.where(is_set, 0, (x[:, 0] ^ x[:, axis]) & low)
            x[:, 0] ^= np.where(is_set, low, swap)
            x[:, axis] ^= swap
    gray = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(d):
            gray = (gray << 1) | ((x[:, axis] >> level) & 1)
    shift = 1
    while shift < d * bits:
        gray ^= gray >> shift
        shift *= 2
    return gray


def category_code(column: Column, bits: int) -> Column:
    """A code of ``bits`` bits that depends on the value alone; null: 0."""
    return F.when(column.isNull(), 0).otherwise(F.pmod(F.xxhash64(column), F.lit((1 << bits) - 1)) + 1)


def size_code(column: Column, bits: int) -> Column:
    """Sixteenths of a doubling of the size, under ``2**bits``."""
    return F.least(F.floor(F.log2(column.cast("double")) * 8), F.lit((1 << bits) - 1)).cast("long")


def number_in_order(rows: DataFrame, by: list, name: str) -> DataFrame:
    """Add column ``name``, 0, 1, ... in the order of ``by``.

    The rows are dealt out by ranges of ``by``, so with a unique last key a value that many rows share
    is split. Places inside a range are counted as its task streams by; only a count for each range is
    then summed up.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])

    def number(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(m, part, dtype=np.int32)), pa.array(np.arange(seen, seen + m, dtype=np.int64))], names=schema.names)
            seen += m

    numbered = written(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(number, schema), "places")
    counts = numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()  # one row for each range
    before, offsets = 0, []
    for r in sorted(counts, key=lambda r: r["_part"]):
        offsets.append((r["_part"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return numbered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def order_along_curve(rows: DataFrame, codes: list[str], ties: list[str], bits: int = 8) -> DataFrame:
    """Add ``curve`` (the Hilbert index of the code columns) and ``place`` (0, 1, ... along curve, then ties)."""

    @F.pandas_udf("long")
    def curve(points):
        import numpy as np
        import pandas as pd

        values = np.stack(points.to_numpy()) if len(points) else np.zeros((0, len(codes)), dtype=np.int64)
        return pd.Series(hilbert_index(values, bits))

    table = written(rows.withColumn("curve", curve(F.array(*[F.col(c).cast("long") for c in codes]))), "curve")
    return number_in_order(table, ["curve", *ties], "place")


ROW = "_row_of_shards"


def _placed(docs: DataFrame, shards: int, bits: int, carried: list[str]) -> DataFrame:
    """What ``shard_documents`` returns, with the columns ``carried`` besides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *carried, F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"),
        category_code(F.col("lang"), bits).alias("lang_code"), category_code(F.col("source"), bits).alias("source_code"),
    ).withColumn("size_code", size_code(F.col("size"), bits))
    rows = written(rows, "codes")
    # Copies under several languages or sources take the place of the smallest codes; groups of one row need no look-up.
    several = rows.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct("lang_code", "source_code")).alias("least")).where("n > 1").select("group", F.col("least.lang_code").alias("lang_place"), F.col("least.source_code").alias("source_place"))
    several = written(several, "groups")
    several = F.broadcast(several) if several.count() <= GROUPS else several
    rows = rows.join(several, "group", "left").withColumn("lang_place", F.coalesce("lang_place", "lang_code")).withColumn("source_place", F.coalesce("source_place", "source_code"))
    placed = order_along_curve(rows, ["lang_place", "source_place", "size_code"], ["group", "doc_id"], bits)
    total = placed.count()
    # Integers throughout: shard s begins at place ceil(s * total / shards).
    shard = F.expr(f"(place * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).select(
        *carried, "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve", "lang_code", "source_code", "size_code",
    )


def shard_documents(docs: DataFrame, shards: int = 16, bits: int = 8) -> DataFrame:
    """Deal documents to ``shards`` runs of the Hilbert curve over language, source and size.

    Law ``rows``: the counts of two shards are at most one apart. Equal texts lie side by side on the curve: the whole group
    takes the place of its smallest language and source codes, and the text's hash is the first tie-breaker, so a group of
    copies is cut only where a shard ends, at most ``shards - 1`` groups in all. Null texts count no bytes; null languages and
    sources have a code of their own. Repeated rows each get a place. An empty table gives no rows.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), curve
    and the rows' own codes, whose smallest and largest values by shard are what a reader prunes by.
    """
    return _placed(docs, shards, bits, [])


def write_shards(docs: DataFrame, path: str, shards: int = 16, bits: int = 8) -> None:
    """Write the documents as one folder for each shard, in slot order inside each file.

    Rows are told apart by a number of their own, so rows with null or repeated doc_ids are written once each. Columns named
    shard, slot or curve of the input are left out in favour of the shards' own.
    """
    numbered = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    placed = _placed(numbered, shards, bits, [ROW]).select(ROW, "shard", "slot", "curve")
    both = numbered.drop("shard", "slot", "curve").join(placed, ROW)
    both = both.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot")
    both.drop(ROW).write.partitionBy("shard").parquet(path)


def shard_boxes(placed: DataFrame) -> DataFrame:
    """The box that each shard spans in every dimension, which is what pruning reads."""
    dims = ["lang_code", "source_code", "size_code", "curve"]
    return placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *[f(c).alias(f"{k}_{c}") for c in dims for k, f in (("min", F.min), ("max", F.max))])
