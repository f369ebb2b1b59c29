"""Token ids in files: a static range asymmetric numeral system with shared frequency tables.

Format. A folder holds two Parquet tables, ``table`` (token, freq: the shared frequencies, which
sum to ``2**SCALE``) and ``blocks``. A block holds whole documents in ascending doc_id order: the
first doc_id, document ids and token counts, and the coded ids. Its ids are dealt row by row to
``lanes`` interleaved 64-bit coder states; lanes give off 32-bit words into one stream. Each
checkpoint (a row number, the stream's position and all states there) lets a reader start in the
middle; ``crc32`` is that of the block's ids as little-endian 32-bit integers. Blocks are
independent, so they are written and read in parallel.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.shared import PieceEncoder, shared_folder, text_batches, written

#: Bits of the frequencies' sum, tokens in a block at least (unless it is the last), and rows between checkpoints.
SCALE, BLOCK, LANES, CHECKPOINT = 20, 1 << 18, 2048, 64


def quantize(counts, scale: int = SCALE):
    """Counts as frequencies that sum to ``2**scale``; each symbol that occurs gets 1 at least."""
    import numpy as np

    counts = np.asarray(counts, dtype=np.int64)
    here = np.flatnonzero(counts)
    freq = np.zeros(len(counts), dtype=np.int64)
    if not len(here):
        return freq
    spare = (1 << scale) - len(here)
    assert spare >= 0, "more symbols than slots"
    exact = counts[here] * (spare / counts[here].sum())
    got = np.floor(exact).astype(np.int64)
    order = np.lexsort((here, got - exact))  # largest remainders first, then the smaller id
    got[order[: spare - int(got.sum())]] += 1
    freq[here] = got + 1
    return freq


class Coder:
    """Interleaved range coder over a static table. States stay in [2**32, 2**64)."""

    def __init__(self, freq, scale: int = SCALE):
        import numpy as np

        self.scale = np.uint64(scale)
        freq = np.asarray(freq, dtype=np.int64)
        self.freq = freq.astype(np.uint32)  # small tables stay in the processor's cache
        self.low = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint32)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq)

    def encode(self, ids, lanes: int = LANES, every: int = CHECKPOINT):
        """Words (uint32), and the checkpoints: row numbers, positions in the words, and states (rows x lanes)."""
        import numpy as np

        n = len(ids)
        rows = -(-n // lanes)
        state = np.full(lanes, 1 << 32, dtype=np.uint64)
        up, low32, top = self.scale, np.uint64(0xFFFFFFFF), np.uint64(64) - self.scale
        chunks, sizes, marks = [], 0, []
        for r in range(rows - 1, -1, -1):
            own = ids[r * lanes : (r + 1) * lanes]
            m = len(own)
            f, x = self.freq[own].astype(np.uint64), state[:m]
            spill = (x >> top) >= f
            if spill.any():
                words = (x[spill] & low32).astype(np.uint32)
                chunks.append(words)
                sizes += len(words)
                x = np.where(spill, x >> np.uint64(32), x)
            q = x // f
            state[:m] = (q << up) + (x - q * f) + self.low[own]
            if r % every == 0:
                marks.append((r, sizes, state.copy()))
        marks.reverse()
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, dtype=np.uint32)
        at = np.array([sizes - s for _, s, _ in marks], dtype=np.int64)
        return words, np.array([r for r, _, _ in marks], dtype=np.int64), at, np.array([s for _, _, s in marks], dtype=np.uint64).reshape(len(marks), lanes)

    def decode(self, words, n: int, state, row: int = 0, at: int = 0, until: int | None = None, lanes: int = LANES):
        """Ids of rows ``row`` to ``until`` (the end), from a checkpoint's position and states."""
        import numpy as np

        rows = -(-n // lanes) if until is None else until
        out = np.empty(min(rows * lanes, n) - row * lanes, dtype=np.uint32)
        state = state.copy()
        low, least = np.uint64((1 << int(self.scale)) - 1), np.uint64(1 << 32)
        for r in range(row, rows):
            m = min(lanes, n - r * lanes)
            x = state[:m]
            slot = x & low
            own = self.symbol[slot]
            out[(r - row) * lanes : (r - row) * lanes + m] = own
            x = self.freq[own] * (x >> self.scale) + slot - self.low[own]
            short = np.flatnonzero(x < least)
            if len(short):
                x[short] = (x[short] << np.uint64(32)) | words[at : at + len(short)]
                at += len(short)
            state[:m] = x
        return out


TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("counts", T.BinaryType())])
BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType()),
    T.StructField("first_doc", T.LongType()), T.StructField("last_doc", T.LongType()), T.StructField("doc_ids", T.BinaryType()), T.StructField("null_ids", T.LongType()), T.StructField("doc_tokens", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("lanes", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("check_rows", T.BinaryType()), T.StructField("check_at", T.BinaryType()), T.StructField("check_states", T.BinaryType()), T.StructField("crc32", T.LongType()),
])
INDEX = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType()), T.StructField("first_doc", T.LongType()), T.StructField("last_doc", T.LongType()),
    T.StructField("block_tokens", T.LongType()), T.StructField("before", T.LongType()), T.StructField("k", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int = 1 << 16) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 16 bits) and the ascending run of the task's stream that the row is in.

    Each task's last row has part -1 and ``counts``, how often it saw each token (64-bit counts).
    """

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, end, part, run, last = PieceEncoder.shared(tokenizer, keeps_blanks=True, width="H", keep=1_600_000), end_id.to_bytes(2, "little"), TaskContext.get().partitionId(), 0, None
        total = np.zeros(vocabulary, dtype="<i8")
        for batch in text_batches(batches):
            out = {f.name: [] for f in TOKENS}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text").to_pylist()), strict=True):
                key = (doc is not None, doc or 0)
                run, last = run + (last is not None and key <= last), key
                ids += end
                for name, v in (("doc_id", doc), ("n_tokens", len(ids) // 2), ("ids", ids), ("part", part), ("run", run)):
                    out[name].append(v)
            total += np.bincount(np.frombuffer(b"".join(out["ids"]), dtype="<u2"), minlength=vocabulary)
            out["counts"] = [None] * len(out["ids"])
            yield pa.RecordBatch.from_pydict(out, schema=_arrow(TOKENS))
        yield pa.RecordBatch.from_pydict({"doc_id": [None], "n_tokens": [0], "ids": [b""], "part": [-1], "run": [0], "counts": [total.tobytes()]}, schema=_arrow(TOKENS))

    return docs.select("doc_id", "text").mapInArrow(encode, TOKENS)


def in_order(tokens: DataFrame) -> tuple[DataFrame, bool]:
    """The rows such that every segment (part, run) ascends and no two segments overlap; whether they moved.

    Where the input's runs already are apart from each other (at most four for each task; the check
    reads ids alone), nothing moves. Else the rows are dealt out by ranges of doc_id and sorted.
    """
    runs = tokens.groupBy("part", "run").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum(F.isnull("doc_id").cast("int")).alias("nulls"))
    parts = max(1, tokens.rdd.getNumPartitions())
    few = runs.limit(4 * parts + 65).collect()
    if len(few) <= 4 * parts + 64 and not any(r["nulls"] for r in few):
        few.sort(key=lambda r: r["lo"])
        if all(a["hi"] < b["lo"] for a, b in zip(few, few[1:], strict=False)):
            return tokens, False
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.repartitionByRange(n, F.asc_nulls_first("doc_id"), F.col("part"), F.col("run")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "part", "run"), True


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, vocabulary: int = 1 << 16) -> None:
    """Encode every document's text and write the ids to ``path``, in ascending doc_id order (null ids first).

    Null and empty texts are the end id alone; repeated doc_ids are coded next to each other.
    An empty table writes empty tables. The frequency table counts all documents.
    """
    import numpy as np

    spark = docs.sparkSession
    table = written(tokenized(docs, tokenizer, end_id, vocabulary), "tokens", "snappy")
    tokens = table.drop("counts").where("part >= 0")

    def count(batches):
        import pyarrow as pa

        total = np.zeros(vocabulary, dtype=np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                total += np.frombuffer(x, dtype="<i8")
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(total[here])], names=["token", "n"])

    counts = table.select("counts").where("counts is not null").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    total = np.zeros(vocabulary, dtype=np.int64)
    for r in counts:
        total[r["token"]] = r["n"]
    freq = quantize(total)
    spark.createDataFrame([(int(t), int(freq[t])) for t in np.flatnonzero(freq)], "token long, freq long").coalesce(1).write.parquet(f"{path}/table")
    ordered, moved = in_order(tokens)
    shared = spark.sparkContext.broadcast(freq.astype(np.uint32))  # one entry for each token of the vocabulary

    def code(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder, task = Coder(shared.value), TaskContext.get().partitionId()

        def block(docs_, ids_, segment, nth):
            sizes = np.array([len(x) // 2 for x in ids_], dtype="<i8")
            ids = np.frombuffer(b"".join(ids_), dtype="<u2").astype("<u4")
            lanes = min(LANES, max(1, len(ids) // 64))
            words, rows, at, states = coder.encode(ids, lanes)
            given = [d for d in docs_ if d is not None]
            return pa.RecordBatch.from_pydict({
                "part": [segment[0]], "run": [segment[1]], "task": [task], "nth": [nth],
                "first_doc": [docs_[0]], "last_doc": [docs_[-1]], "doc_ids": [np.array(given, dtype="<i8").tobytes()], "null_ids": [len(docs_) - len(given)], "doc_tokens": [sizes.tobytes()], "n_tokens": [len(ids)], "lanes": [lanes],
                "words": [words.astype("<u4").tobytes()], "check_rows": [rows.astype("<i8").tobytes()], "check_at": [at.astype("<i8").tobytes()], "check_states": [states.astype("<u8").tobytes()], "crc32": [zlib.crc32(ids.tobytes())],
            }, schema=_arrow(BLOCKS))

        own_docs, own_ids, held, at, nth = [], [], 0, None, 0
        for b in batches:
            for doc, ids, *segment in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "part", "run")), strict=True):
                segment = [task, 0] if moved else segment
                if own_docs and (held >= BLOCK or segment != at):
                    yield block(own_docs, own_ids, at, nth)
                    own_docs, own_ids, held, nth = [], [], 0, nth + 1
                own_docs.append(doc)
                own_ids.append(ids)
                held, at = held + len(ids) // 2, segment
        if own_docs:
            yield block(own_docs, own_ids, at, nth)

    ordered.select("doc_id", "ids", "part", "run").mapInArrow(code, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _coder_of(spark: SparkSession, path: str, vocabulary: int):
    import numpy as np

    freq = np.zeros(vocabulary, dtype=np.uint32)
    for r in spark.read.parquet(f"{path}/table").collect():  # at most the vocabulary
        freq[r["token"]] = r["freq"]
    return spark.sparkContext.broadcast(freq)


def decoded_blocks(batches, freq):
    """doc ids, token counts and ids of each block; every block's checksum is compared."""
    import numpy as np

    coder = Coder(freq)
    for b in batches:
        for r in b.to_pylist():
            words, n, lanes = np.frombuffer(r["words"], dtype="<u4"), r["n_tokens"], r["lanes"]
            rows, at = np.frombuffer(r["check_rows"], dtype="<i8"), np.frombuffer(r["check_at"], dtype="<i8")
            states = np.frombuffer(r["check_states"], dtype="<u8").reshape(len(rows), lanes)
            ends = [*rows[1:].tolist(), None]
            ids = np.concatenate([coder.decode(words, n, states[k], int(rows[k]), int(at[k]), ends[k], lanes) for k in range(len(rows))]).astype("<u4")
            if zlib.crc32(ids.tobytes()) != r["crc32"]:
                raise ValueError(f"the block at document {r['first_doc']} does not match its checksum")
            docs = [None] * r["null_ids"] + np.frombuffer(r["doc_ids"], dtype="<i8").tolist()
            yield r, docs, np.frombuffer(r["doc_tokens"], dtype="<i8"), ids


def read_token_files(spark: SparkSession, path: str, vocabulary: int = 1 << 16) -> DataFrame:
    """Each document of the files as doc_id and ids, decoded block by block."""
    shared = _coder_of(spark, path, vocabulary)

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for _, docs, sizes, ids in decoded_blocks(batches, shared.value):
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_pydict({"doc_id": docs, "ids": [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]}, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(decode, "doc_id long, ids array<int>")


def token_index(spark: SparkSession, path: str, vocabulary: int = 1 << 16) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    shared = _coder_of(spark, path, vocabulary)

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for r, docs, sizes, ids in decoded_blocks(batches, shared.value):
            data, cuts, m = memoryview(ids.tobytes()), np.concatenate([[0], np.cumsum(sizes)]), len(docs)
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
            same = {c: [r[c]] * m for c in ("part", "run", "task", "nth", "first_doc", "last_doc")}
            yield pa.RecordBatch.from_pydict(same | {"block_tokens": [r["n_tokens"]] * m, "before": cuts[:-1], "k": np.arange(m), "doc_id": docs, "n_tokens": sizes, "ids_crc32": crc}, schema=_arrow(INDEX))

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    documents = written(blocks.mapInArrow(decode, INDEX), "token-index")
    first = documents.where("k = 0")  # one row for each block
    segments = first.groupBy("part", "run").agg(F.min("first_doc").alias("lo"), F.sum("block_tokens").alias("n")).collect()  # a few for each task that wrote
    starts, total = [], 0
    for r in sorted(segments, key=lambda r: (r["lo"] is not None, r["lo"] or 0, r["part"])):
        starts.append((r["part"], r["run"], total))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(starts, "part int, run long, segment_start long"))
    order = [F.asc_nulls_first("first_doc"), F.asc_nulls_first("last_doc"), "task", "nth"]
    before = Window.partitionBy("part", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = first.join(starts, ["part", "run"]).select("task", "nth", (F.col("segment_start") + F.coalesce(F.sum("block_tokens").over(before), F.lit(0))).alias("block_start"))
    return documents.join(placed, ["task", "nth"]).select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the documents' ids into the shared folder, read the files back, and return their index."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer, path, end_id)
    return token_index(spark, path)
