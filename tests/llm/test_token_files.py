import uuid
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import token_files as t
from lakeloom.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("n,lanes,symbols", [(0, 4, 5), (1, 4, 5), (1000, 16, 3), (777, 10, 1), (50_000, 64, 3000)])
def test_coder_round_trip_from_every_checkpoint(n, lanes, symbols):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, symbols - 1).astype(np.uint32)
    coder = t.Coder(t.quantize(np.bincount(ids, minlength=symbols)) if n else np.zeros(symbols))
    words, rows, at, states = coder.encode(ids, lanes, every=5)
    for k in range(len(rows)):
        assert (coder.decode(words, n, states[k], int(rows[k]), int(at[k]), lanes=lanes) == ids[rows[k] * lanes :]).all()


def test_frequencies_sum_to_the_scale_and_keep_rare_symbols():
    freq = t.quantize([10**12, 0, 1, 1, 5], 10)
    assert freq.sum() == 1 << 10 and freq[1] == 0 and (freq[[0, 2, 3, 4]] > 0).all()


def expected(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    out, start = [], 0
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for r in rows:
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_files_hold_every_document(small_docs, shuffled, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 4096)
    docs = small_docs.repartition(5, F.rand(3)) if shuffled else small_docs
    rows = t.token_file_round_trip(docs, PATH).orderBy("start").collect()
    assert [tuple(r) for r in rows] == expected(small_docs)


def test_edges(edge_docs, no_docs):
    rows = t.token_file_round_trip(edge_docs, PATH).orderBy("start").collect()
    want = expected(edge_docs)
    assert [r["doc_id"] for r in rows] == [w[0] for w in want]
    key = lambda w: (w[0] is not None, w[0] or 0, w[2], w[3])
    assert sorted(map(key, map(tuple, rows))) == sorted(map(key, want))
    assert sum(r["n_tokens"] for r in rows[:-1]) == rows[-1]["start"]
    assert t.token_file_round_trip(no_docs, PATH).count() == 0


def test_ids_come_back(small_docs, spark, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    t.write_token_files(small_docs.limit(7), PATH, path)
    got = {r["doc_id"]: r["ids"] for r in t.read_token_files(spark, path).collect()}
    assert {d: zlib.crc32(struct.pack(f"<{len(i)}I", *i)) for d, i in got.items()} == {w[0]: w[3] for w in expected(small_docs.limit(7))}


def test_damage_is_found(small_docs, spark, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    t.write_token_files(small_docs.limit(7), PATH, path)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("crc32", F.col("crc32") + 1).collect()
    spark.createDataFrame(blocks, t.BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")
    with pytest.raises(Exception, match="does not match its checksum"):
        t.read_token_files(spark, path).collect()
