import math
import random
import re

import numpy as np
import pytest
import xxhash

from lakeloom.llm import graph
from lakeloom.llm import simhash as s
from lakeloom.llm.graph import connected_components


def plain_fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=4):
    """(doc_id, text) rows to (doc_id, fingerprint, component)."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def same(got, want):
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


@pytest.mark.parametrize("radius", [1, 2, 4, 5, 6])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks, rnd = s.covering_masks(radius), random.Random(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    assert sum(24 <= m.bit_count() <= 48 for m in masks) >= len(masks) - 1 and min(m.bit_count() for m in masks) >= 24
    for _ in range(5000):
        diff = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("name", ["edge_docs", "small_docs", "no_docs"])
def test_components_equal_brute_force(name, request):
    docs = request.getfixturevalue(name)
    same(s.near_duplicates(docs).collect(), brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


def joined_up(nodes, pairs):
    """node to the smallest node that pairs lead to."""
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def family(rnd, size, flips):
    centre = rnd.getrandbits(64)
    return {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, flips))) for _ in range(size)}


def close(fps, radius):
    arr = np.array(fps, dtype="u8")
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(arr[:, None] ^ arr[None]) <= radius), strict=True) if a < b]


@pytest.mark.parametrize("middle,radius", [(4096, 4), (8, 4), (16, 6)])
def test_every_bucket_size_gives_the_same_components(spark, middle, radius):
    rnd = random.Random(5)
    fps = set().union(*[family(rnd, 40, 5) for _ in range(4)]) | {rnd.getrandbits(64) for _ in range(50)}
    signed = sorted(s._signed(f) for f in fps)
    items = spark.createDataFrame([(f, f) for f in signed], "node long, p long")
    got = {r["node"]: r["root"] for r in s.near_components(items, ["p"], radius, middle).collect()}
    want = joined_up(range(len(signed)), close([f & (1 << 64) - 1 for f in signed], radius))
    assert {signed[n]: signed[r] for n, r in want.items() if n != r} == got


def test_items_hang_together_by_any_of_their_prints(spark):
    rnd = random.Random(8)
    prints = [[rnd.choice(fam) for fam in (first, second)] for first, second in [(sorted(family(rnd, 30, 7)), sorted(family(rnd, 30, 7))) for _ in range(5)] for _ in range(20)]
    rows = [(n, *map(s._signed, p)) for n, p in enumerate(prints)]
    got = {r["node"]: r["root"] for r in s.near_components(spark.createDataFrame(rows, "node long, p long, q long"), ["p", "q"], 6).collect()}
    want = joined_up(range(len(rows)), [x for k in (0, 1) for x in close([p[k] for p in prints], 6)])
    assert {n: r for n, r in want.items() if n != r} == got


@pytest.fixture
def counted(monkeypatch):
    """Links that each call of connected_components gets."""
    seen = []

    def run(links, plain=connected_components):
        seen.append(links.count())
        return plain(links)

    monkeypatch.setattr(s, "connected_components", run)
    monkeypatch.setattr(graph, "connected_components", run)
    return seen


@pytest.mark.parametrize("radius,middle", [(4, 4096), (6, 200)])
def test_links_follow_the_number_of_items(spark, counted, radius, middle):
    rnd = random.Random(3)
    fps = set().union(family(rnd, 2000, 6), *[family(rnd, 30, 6) for _ in range(60)])
    items = spark.createDataFrame([(s._signed(f), s._signed(f)) for f in fps], "node long, p long")
    s.near_components(items, ["p"], radius, middle).count()
    assert max(counted) <= 4 * len(fps)


def test_links_between_texts_follow_their_number(spark, counted):
    rnd = random.Random(4)
    rows = []
    for size in (700, *[30] * 20):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
        for _ in range(size):
            own = list(base)
            own[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    kept = s.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(700, 1300, 30)]
    assert len(counted) > 3 and max(counted) <= 4 * len(rows)


def test_long_chains_end_at_the_smallest_node(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(4, text), (2, text), (9, text + " tail"), (7, "something else entirely here now"), (None, text), (7, "something else entirely here now")]
    kept = s.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 2, 7]


def test_links_inside_groups_join_what_all_pairs_join(spark):
    rng = random.Random(5)
    rows, sets = [], {}
    for root, n in ((1, 5), (2, 90), (3, 70)):
        bases = [[rng.getrandbits(40) for _ in range(40)] for _ in range(2 if root < 3 else 60)]
        for _ in range(n):
            own = list(rng.choice(bases))
            for k in rng.sample(range(40), rng.choice([0, 2, 4, 9])):
                own[k] = rng.getrandbits(40)
            sets[len(rows)] = (root, frozenset(own))
            rows.append((root, len(rows), sorted(set(own))))
    every = [(a, b) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1])]
    df = spark.createDataFrame(rows, "group long, node long, s array<long>")
    for limit, leaders in ((8, 4), (1000, 32)):
        links = [(r["a"], r["b"]) for r in graph.links_inside(df, s._alike(0.8), limit, leaders).collect()]
        assert joined_up(sets, links) == joined_up(sets, every)
        assert len(links) <= 4 * len(sets)


def test_keep_one_leaves_texts_below_the_similarity(spark):
    words = [f"w{i}" for i in range(100)]
    turned = words[50:] + words[:50]  # the same words, other shingles at one place only
    shuffled = sorted(words, key=lambda w: hash_of(w))
    rows = [(1, " ".join(words)), (2, " ".join(turned)), (3, " ".join(shuffled)), (4, " ".join(words)), (5, None), (6, ""), (7, " ".join(words[:-1] + ["x"])), (8, "one"), (8, "two"), (8, "two")]
    kept = sorted((r["doc_id"], r["text"]) for r in s.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["text"])
    assert [k for k, _ in kept] == [1, 3, 8, 8]
    assert s.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def hash_of(w):
    return (int(w[1:]) * 37) % 101


def test_two_prints_find_nine_of_ten_alike_pairs_of_all_documents(spark):
    """All pairs of sf0.1 whose shingles are alike by 0.8: one of two texts' rarest fifth of shingles is shared, so an index of those finds every pair."""
    texts = sorted({r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() if r["text"]})
    sets = [s.shingle_set(t) for t in texts]
    every, often = np.unique(np.concatenate(sets), return_counts=True)
    index, pairs = {}, set()
    for i, own in enumerate(sets):
        rare = own[np.lexsort((own, often[np.searchsorted(every, own)]))][: len(own) - math.ceil(0.8 * len(own)) + 1]
        for h in rare.tolist():
            pairs |= {(j, i) for j in index.get(h, ())}
            index.setdefault(h, []).append(i)
    both = {(i, j): len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs}
    alike = [(i, j) for (i, j), n in both.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    near = [any((s.fingerprint(texts[i], 1, False, seed) ^ s.fingerprint(texts[j], 1, False, seed)).bit_count() <= 6 for seed in (42, 43)) for i, j in alike]
    assert len(alike) >= 40 and sum(near) >= 0.9 * len(alike)


def families(n, seed, texts, common):
    """Sets of shingles in one group: unlike ones with ``common`` shingles in all, and families in which one shingle of 40 differs from the first."""
    rng = random.Random(seed)
    shared, rows, want = [rng.getrandbits(60) for _ in range(common)], [], {}
    for i in range(texts):
        own = shared + [rng.getrandbits(60) for _ in range(40 - common)]
        rows.append((7, len(rows), sorted(own)))
        if i < n:
            for k in range(5):
                rows.append((7, len(rows), sorted(own[:-1] + [rng.getrandbits(60)])))
                want[len(rows) - 1] = len(rows) - 2 - k
    return rows, want


def test_large_groups_are_joined_by_prefixes_and_not_all_with_all(spark, monkeypatch):
    rows, want = families(300, 1, 8000, 12)
    sets = spark.createDataFrame(rows, "group long, node long, s array<long>")
    moved, plain = {}, s.written

    def counted(df, name, *a, **b):
        out = plain(df, name, *a, **b)
        moved[name] = moved.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(s, "written", counted)
    roots = {r["node"]: r["root"] for r in s.connected_components(s.similar_links(sets, 0.8, 256)).collect()}
    assert roots == want
    assert moved["prefixes"] == 9 * len(rows) and moved["token-members"] + moved["prefixes"] < 20 * len(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_prefix_joins_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = [rng.getrandbits(60) for _ in range(60)]
    rows = []
    for i in range(400):
        base = rng.sample(pool, rng.choice([1, 2, 5, 10, 25])) if not rows or rng.random() < 0.4 else [x for x in rng.choice(rows)[2] if rng.random() < 0.95] or pool[:1]
        rows.append((rng.randrange(2), i, sorted(set(base))))
    top = {i: i for _, i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for g, i, x in rows:
        for h, j, y in rows[:i]:
            if g == h and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    links = s.similar_links(spark.createDataFrame(rows, "group long, node long, s array<long>"), 0.8, 16)
    assert {r["node"]: r["root"] for r in s.connected_components(links).collect()} == {i: find(i) for i in top if find(i) != i}
