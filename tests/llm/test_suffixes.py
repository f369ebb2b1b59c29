import hashlib
import random

import numpy as np
import pytest

from lakeloom.llm import suffixes as s


def brute(rows):
    """(doc_id, text) with unique ids to the operator's row, window by window."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - s.LENGTH + 1):
            w = data[i : i + s.LENGTH]
            if w in seen:
                gone[i : i + s.LENGTH] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((d, len(data), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(data) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(df):
    return sorted(tuple(r)[:5] for r in s.deduplicated(df).collect())


def test_planted_repeats(spark, monkeypatch):
    monkeypatch.setattr(s, "SEGMENT", 1000)
    monkeypatch.setattr(s, "RUN", 700)
    rnd = random.Random(7)
    alphabet = "abcdefgh é"
    word = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    passages = [word(n) for n in (60, 99, 100, 101, 130, 400, 1500)]
    rows = []
    for i in range(120):
        parts = [word(rnd.randint(0, 150)) if rnd.random() < 0.5 else rnd.choice(passages)[rnd.randint(0, 30) :] for _ in range(rnd.randint(0, 6))]
        rows.append((i * 3 - 50, "".join(parts)))
    base = word(2500)
    for i in range(25):
        a = rnd.randint(0, 2400)
        rows.append((1000 + i, base[:a] + "#" + base[a + 1 :]))
    rows += [(2000, "a" * 3000), (2001, "ab" * 700), (2002, None), (2003, ""), (2004, base), (2005, base), (2006, "\x00" * 150 + "z"), (2007, "\x00" * 149 + "z"), (2008, "a" * 99), (-1000, base[300:420])]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df) == brute(rows)
    monkeypatch.setattr(s, "BROADCAST", 0)
    assert run(df) == brute(rows)
    monkeypatch.setattr(s, "REMEMBERED", 0)
    monkeypatch.setattr(s, "RANGE", 50)
    for hot in (0, 5):
        monkeypatch.setattr(s, "HOT", hot)
        assert run(df) == brute(rows)


def test_small_table(small_docs):
    assert run(small_docs) == brute([(r["doc_id"], r["text"]) for r in small_docs.collect()])


def test_edges(edge_docs, no_docs, spark):
    out = s.deduplicated(edge_docs).collect()
    assert len(out) == edge_docs.count()
    assert s.deduplicated(no_docs).count() == 0
    text = "".join(chr(97 + i * i % 23) + chr(97 + i % 26) for i in range(80))
    rows = [(1, text), (1, text), (None, text), (1, text[:50] + "Q" + text[51:]), (2, text)]
    got = sorted(((r["doc_id"] or 0), r["n_removed"]) for r in s.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 109), (1, 160), (1, 160), (2, 160)]
    once = s.deduplicated(spark.createDataFrame([(5, text), (5, text)], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in once] == [0, 0]


def test_equal_hashes_do_not_remove(spark, monkeypatch):
    """Where all hashes of contexts and of strings are equal, bytes still decide."""
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([110, 150, 200])))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 40, 7)] + [(200, rows[1][1][:105] + "zz" + rows[2][1])]

    def alike(units):
        g, doc, place, known = plain(units)
        return np.full_like(g, 7), doc, place, known

    plain, mix = s.anchors_of, s._mix
    units = [(d, 0, t.encode(), 0, 1 << 19) for d, t in rows]
    g, doc, place, known = plain(units)
    first = {}
    for k in range(len(g)):
        data = units[[u[0] for u in units].index(doc[k])][2]
        context = (data[max(0, place[k] - 50) : place[k]], data[place[k] : place[k] + 100])
        assert known[k] == (context in first)
        first.setdefault(context, k)
    monkeypatch.setattr(s, "_mix", lambda h: mix(h) & np.uint64(15))
    few = plain(units)[3]
    assert 0 < few.sum()
    monkeypatch.setattr(s, "_mix", mix)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(s, "anchors_of", alike)
    assert run(df) == brute(rows)


@pytest.mark.parametrize("k", [1, 2, 3, 8, 13])
def test_loser_tree_merges_front_coded_runs(k, monkeypatch):
    monkeypatch.setattr(s, "LENGTH", 12)
    rnd = random.Random(k)
    runs = [sorted({"".join(rnd.choice("ab") for _ in range(12)).encode() for _ in range(rnd.randint(0, 60))}) for _ in range(k)]
    coded = [tuple(x if isinstance(x, bytes) else x.tobytes() for x in s.front_code(np.array([list(w) for w in r], dtype=np.uint8).reshape(-1, 12))) for r in runs]
    got = list(s.LoserTree(coded))
    merged = [runs[r][i] for _, r, i in got]
    assert merged == sorted(w for r in runs for w in r)
    for (h, _, _), a, b in zip(got[1:], merged, merged[1:]):
        assert h == next((i for i in range(12) if a[i] != b[i]), 12)
