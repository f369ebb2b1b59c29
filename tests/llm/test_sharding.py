import itertools
import math
import zlib

import numpy as np
import pytest
import xxhash

from lakeloom.llm.sharding import hilbert_index, shard_boxes, shard_documents, write_shards


@pytest.mark.parametrize("d,bits", [(1, 3), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(d, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    at = hilbert_index(points, bits)
    assert sorted(at) == list(range(len(points)))
    path = points[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("name", ["edge_docs", "small_docs", "no_docs"])
def test_shards(name, request):
    docs = request.getfixturevalue(name)
    rows = shard_documents(docs).collect()
    texts = sorted((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == texts
    by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in rows)


def test_shards_are_boxes(small_docs):
    boxes = shard_boxes(shard_documents(small_docs)).collect()
    whole = max(b["max_size_code"] for b in boxes) - min(b["min_size_code"] for b in boxes)
    assert sum(b["max_size_code"] - b["min_size_code"] for b in boxes) < len(boxes) * whole


def signed(data):
    h = xxhash.xxh64_intdigest((data or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def plain_places(docs, shards=16):
    """(size, crc, shard, slot) of each row by plain Python."""
    rows, least = [], {}
    for r in docs:
        code = lambda v: 0 if v is None else signed(v) % 255 + 1
        size = len((r["text"] or "").encode()) + 1
        rows.append((code(r["lang"]), code(r["source"]), min(int(math.log2(size) * 8), 255), signed(r["text"]), r["doc_id"], size, zlib.crc32((r["text"] or "").encode())))
        least[rows[-1][3]] = min(least.get(rows[-1][3], (999, 999)), rows[-1][:2])
    at = hilbert_index(np.array([(*least[r[3]], r[2]) for r in rows]), 8).tolist()
    order = sorted(range(len(rows)), key=lambda i: (at[i], rows[i][3], rows[i][4] is not None, rows[i][4] or 0))
    out = []
    for place, i in enumerate(order):
        shard = place * shards // len(rows)
        out.append((*rows[i][5:], shard, place - -(-shard * len(rows) // shards)))
    return out


@pytest.mark.parametrize("name", ["edge_docs", "small_docs"])
def test_places_equal_plain_ones(name, request):
    docs = request.getfixturevalue(name)
    assert sorted((r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in shard_documents(docs).collect()) == sorted(plain_places(docs.collect()))


def test_groups_under_several_sources_stay_together(spark):
    rows = [(i, f"text {i % 40}", "en de fr es".split()[i % 3], f"s{i % 7}") for i in range(400)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 4).collect()
    cut = sum(len({r["shard"] for r in out if r["text_crc32"] == zlib.crc32(f"text {k}".encode())}) - 1 for k in range(40))
    assert cut <= 3


def test_written_shards_hold_every_row_once(spark, edge_docs, tmp_path):
    write_shards(edge_docs, f"{tmp_path}/out", 4)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["lang"] or "")
    assert sorted(map(key, got)) == sorted(map(key, edge_docs.collect()))
    counts = [sum(r["shard"] == k for r in got) for k in range(4)]
    assert max(counts) - min(counts) <= 1 and {r["rank"] for r in got} == {"extra"}
