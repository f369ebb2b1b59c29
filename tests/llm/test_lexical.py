import math
import random
import re
from collections import Counter

import pytest

from lakeloom.llm import lexical, queries

DOC, ITEM = "doc_id long, text string, item long, score string, term int", "item_id long, text string, doc_id string, low int"


def plain(docs, items, k=10):
    """All scores of all documents, in Python integers."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(words(t))) for i, t in docs]
    N, L = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            m = 10 + 90 * c.total() * N // max(L, 1)
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, None, "x", 1) for d in docs], DOC), spark.createDataFrame([(*i, "x", None) for i in items], ITEM)


def test_equals_plain_scores_on_the_tables(spark, small_docs):
    items = queries.table(spark, "/root/testdata/sf0.001", "benchmark")
    want = plain([(r["doc_id"], r["text"]) for r in small_docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert found(lexical.ranked(small_docs, items)) == want


@pytest.mark.parametrize("block, pairs", [(3, 7), (512, 10**6)])
def test_edges_in_blocks_and_passes_of_any_size(spark, edge_docs, monkeypatch, block, pairs):
    for name, n in (("BLOCK", block), ("PAIRS", pairs)):
        monkeypatch.setattr(lexical, name, n)
    asked = [(1, "one two three"), (1, "one two three"), (1, "word"), (2, None), (3, ""), (4, "..."), (None, "SAME text"), (5, "日本語のテキスト ÉTÉ été DON'T"), (6, "absent"), (7, "a A x " * 50)]
    asked_df = spark.createDataFrame([(*i, "x", None) for i in asked], ITEM)
    want = plain([(r["doc_id"], r["text"]) for r in edge_docs.collect()], asked)
    assert found(lexical.ranked(edge_docs, asked_df)) == want


def test_ties_beyond_k_and_a_word_of_every_document(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 16)
    rng = random.Random(3)
    docs = [(i, "common passage here") for i in range(100, 0, -1)] + [(i, "common " + " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(1, 30)))) for i in range(200, 300)]
    items = [(1, "passage"), (2, "common"), (3, "alpha beta"), (4, "gamma common")]
    want = plain(docs, items)
    assert sorted(r[2] for r in want if r[0] == 1) == list(range(1, 11))
    assert found(lexical.ranked(*frames(spark, docs, items))) == want


def test_empty_tables(spark):
    assert found(lexical.ranked(*frames(spark, [], [(1, "a")]))) == []
    assert found(lexical.ranked(*frames(spark, [(1, "a b"), (2, "c")], []))) == []
    assert found(lexical.ranked(*frames(spark, [(1, None), (2, "--")], [(1, "a")]))) == []


def test_bytes_bound_every_impact():
    import numpy as np

    for tf in (1, 2, 3, 50, 10**6):
        for m in (10, 11, 99, 10**7):
            exact = lexical._impacts(np.int64(tf), np.int64(m))
            step = -(-exact // lexical.STEP)
            assert 0 <= step <= 255 and step * lexical.STEP >= exact and (not step or (step - 1) * lexical.STEP + 1 <= exact)
