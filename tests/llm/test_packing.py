import random
import struct
import zlib
from collections import defaultdict

import pytest

from lakeloom.llm.packing import OpenBins, pack_documents, plan_bins
from lakeloom.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Best-fit decreasing, bin by bin."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        best = min(fits, key=lambda b: b[0]) if fits else None
        if best is None:
            bins.append(best := [capacity])
        best[0] -= n
    return sorted(b[0] for b in bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 7, 20, 64, 100])
    lengths = [rnd.randint(1, rnd.choice([capacity, max(1, capacity // 3)])) for _ in range(rnd.randint(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    places, used = plan_bins(counts, capacity)
    filled, taken = defaultdict(list), defaultdict(list)
    for n, first_rank, ranks, each, first, at in places:
        for r in range(ranks):
            taken[n].append(first_rank + r)
            filled[first + r // each].append((at + r % each * n, n))
    assert {n: sorted(v) for n, v in taken.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert sorted(filled) == list(range(used))
    for pieces in filled.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in filled.values()) == one_by_one(lengths, capacity)


def test_tightest_open_bin():
    bins = OpenBins(10)
    assert bins.tightest(1) is None
    bins.put(7, 0, 1)
    bins.put(4, 1, 1)
    assert [bins.tightest(n) for n in (1, 4, 5, 7, 8)] == [4, 4, 7, 7, None]
    bins.take(4)
    assert bins.tightest(1) == 7


def check_pack(docs, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    rows = pack_documents(docs, PATH, capacity, with_ids=True).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            data = struct.pack(f"<{len(own)}I", *own)
            want.append((r["doc_id"] is not None, r["doc_id"] or 0, k // capacity, k, len(own), zlib.crc32(data), data))
    got = [(r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows]
    assert sorted(got) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= capacity
    assert len(bins) == len(one_by_one([w[4] for w in want], capacity))


def test_pack_edges(edge_docs):
    check_pack(edge_docs, 64)


def test_pack_small(small_docs):
    check_pack(small_docs, 2048)


def test_pack_nothing(no_docs):
    assert pack_documents(no_docs, PATH).count() == 0
