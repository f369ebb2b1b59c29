"""Media columns: byte payloads stored as progressive JPEG, and features of the pictures read back.

A payload's bytes are the quantised coefficients, one for one, so storing loses nothing. Frequent
letters get small coefficients; the order below is part of the format.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.shared import text_batches, written

#: Bytes in order of the size of their coefficients; all others follow in ascending order.
FREQUENT = b" etaoinshrdlcumwfgypbvkjxqz.,\n"


def _coefficients():
    import numpy as np

    order = list(FREQUENT) + [b for b in range(256) if b not in FREQUENT]
    value = np.zeros(256, dtype=np.int16)
    for rank, b in enumerate(order):
        value[b] = (rank // 2 + 1) * (1 if rank % 2 == 0 else -1)
    back = np.zeros(512, dtype=np.uint8)
    back[value.astype(np.int64) + 256] = np.arange(256)
    return value, back


def encode_payloads(texts: list[str | None]) -> tuple[list[bytes], list[int]]:
    """Each text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, as a file; and the bytes' number."""
    import numpy as np

    from lakeloom.llm import jpeg

    raw = [(t or "").encode() for t in texts]
    padded = [r + bytes(-len(r) % 64 or (64 if not r else 0)) for r in raw]
    value, _ = _coefficients()
    blocks = value[np.frombuffer(b"".join(padded), dtype=np.uint8)].reshape(-1, 64)
    return jpeg.encode(blocks, np.array([len(p) // 64 for p in padded], dtype=np.int64)), [len(r) for r in raw]


def decode_payloads(files: list[bytes]):
    """Payloads, RGB tiles of all files, and each file's width and height in tiles."""
    import numpy as np

    from lakeloom.llm import jpeg

    grid, width, height = jpeg.decode(files)
    _, back = _coefficients()
    ends = np.cumsum(width * height) * 6
    payloads, at = [], 0
    for end in ends.tolist():
        own = grid[at:end]
        n = int(np.flatnonzero(own[:, 1])[-1]) + 1  # no byte's coefficient is zero; blocks of padding are
        payloads.append(back[own[:n].astype(np.int64) + 256].tobytes())
        at = end
    return payloads, jpeg.rgb_tiles(grid), width, height


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``, the text as a progressive JPEG file. Null texts count as empty."""

    def run(batches):
        import pyarrow as pa

        for b in text_batches(batches, rows=1000, chars=2_000_000):
            files, sizes = encode_payloads(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, type=pa.int64()), pa.array(files, type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """What the stored files hold: payload figures, file figures, and a feature of the picture.

    The feature is the picture's size and the mean red, green and blue of the picture and of its
    last tile's four quarters, rounded to whole numbers; equal files have equal features.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            sizes = [len(x.as_buffer()) for x in whole.column("media")]
            start = total = 0
            cuts = []
            for i, n in enumerate(sizes):
                if i > start and (total + n > 1_500_000 or i - start >= 1000):
                    cuts.append((start, i))
                    start, total = i, 0
                total += n
            cuts.append((start, len(sizes)))
            for a, z in cuts:
                if a == z:
                    continue
                b = whole.slice(a, z - a)
                files = b.column("media").to_pylist()
                payloads, tiles, width, height = decode_payloads(files)
                count = width * height
                sums = tiles.sum(axis=(1, 2), dtype=np.int64)
                ends = np.cumsum(count)
                total_ = np.add.reduceat(sums, ends - count)
                mean = (2 * total_ + 256 * count[:, None]) // (2 * 256 * count[:, None])
                last = tiles[ends - 1].reshape(-1, 2, 8, 2, 8, 3).sum(axis=(2, 4), dtype=np.int64)
                quarter = ((2 * last + 64) // 128).reshape(len(files), 12)
                feature = [f"{16 * w}x{16 * h}:" + ",".join(map(str, m + q)) for w, h, m, q in zip(width.tolist(), height.tolist(), mean.tolist(), quarter.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), b.column("n_bytes"), pa.array([len(p) for p in payloads], type=pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-64:]) for p in payloads], type=pa.int64()), pa.array([len(f) for f in files], type=pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array(feature),
                ], names=names)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def rgb_tensors(stored: DataFrame) -> DataFrame:
    """The stored files as full-resolution tensors: doc_id, height, width, and ``rgb`` (rows of pixels of three bytes)."""

    def run(batches):
        import pyarrow as pa

        from lakeloom.llm import jpeg

        for whole in batches:
            for k in range(0, whole.num_rows, 50):
                b = whole.slice(k, 50)
                _, tiles, width, height = decode_payloads(b.column("media").to_pylist())
                out, at = [], 0
                for w, h in zip(width.tolist(), height.tolist(), strict=True):
                    out.append(jpeg.rgb_image(tiles[at : at + w * h], w, h).tobytes())
                    at += w * h
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array((16 * height).astype("int32")), pa.array((16 * width).astype("int32")), pa.array(out, type=pa.binary())], names=["doc_id", "height", "width", "rgb"])

    return stored.mapInArrow(run, "doc_id long, height int, width int, rgb binary")


def media_features(docs: DataFrame) -> DataFrame:
    """Store every text as a picture in the shared folder, read the files back and compute their features.

    Null and empty texts are a payload of 64 zero bytes. Repeated rows and null doc_ids keep their
    rows. An empty table gives no rows. Columns other than doc_id and text are left out.
    """
    return features(written(store(docs), "media"))
