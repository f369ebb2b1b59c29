import json
import math
from collections import defaultdict
from pathlib import Path

import pytest
import xxhash

import corpus_pipeline as c
from lakeloom.llm import decontamination, quality
from tests.llm.test_packing import one_by_one
from tests.llm.test_quality import Plain

SF = "/root/testdata/sf0.001"


def test_stages_have_the_stated_order():
    assert [n for n, _ in c.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]
    json.dumps([n for n, _ in c.STAGES])
    assert Path(c.__file__).parent == Path(__file__).resolve().parent.parent.parent


def brute_quality(docs, labels, quantile=0.995, peak_quantile=0.99, prior=30):
    good = {d for d in {r["doc_id"] for r in labels} if min(r["quality"] for r in labels if r["doc_id"] == d) == 1 and max(r["toxic"] or 0 for r in labels if r["doc_id"] == d) == 0}
    trusted = [r for r in docs if r["doc_id"] in good and r["text"]]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    fold = lambda r: signed(xxhash.xxh64_intdigest(r["text"].encode(), 42)) % quality.FOLDS
    models = [Plain([r["text"] for r in trusted if fold(r) != k]) for k in range(quality.FOLDS)]
    figures = lambda plain, t: (lambda each: (sum(each), max((sum(each[i : i + 5]) / min(5, len(t)) for i in range(max(1, len(t) - 4))), default=0) if t else 0))(plain.each(t))
    own = {r["doc_id"]: figures(models[fold(r)], r["text"]) for r in trusted}
    by = defaultdict(list)
    for r in trusted:
        by[r["lang"]].append(r)
    mean, limit = {}, {}
    ppl = lambda loss, r, lang: math.exp((loss + prior * mean[lang]) / (len(r["text"]) + prior))
    for lang, rows in [*by.items(), (None, trusted)]:
        mean[lang] = sum(own[r["doc_id"]][0] for r in rows) / sum(len(r["text"]) for r in rows)
        rank = lambda v, share: sorted(v)[max(0, math.ceil(share * len(v)) - 1)] * (1 + 1e-9)
        limit[lang] = rank([ppl(own[r["doc_id"]][0], r, lang) for r in rows], quantile), rank([own[r["doc_id"]][1] for r in rows], peak_quantile)
    plain, keep = Plain([r["text"] for r in trusted]), set()
    for r in docs:
        lang = r["lang"] if r["lang"] in by else None
        loss, worst = figures(plain, r["text"] or "")
        if not r["text"] or ppl(loss, r, lang) <= limit[lang][0] and worst <= limit[lang][1]:
            keep.add(r["doc_id"])
    return keep


def words_fingerprint(text, seed):
    h = [xxhash.xxh64_intdigest(w, seed) for w in set((text or "").encode().lower().split())]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text, words=5):
    parts = (text or "").encode().lower().split()
    return [tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []


def brute_near(docs, radius=c.RADIUS):
    fps = [[words_fingerprint(r["text"], seed) for seed in (42, 43)] for r in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if any((x ^ y).bit_count() <= radius for x, y in zip(fps[i], fps[j], strict=True)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    candidates = list(map(find, range(len(docs))))
    root[:] = range(len(docs))
    sets = [set(shingles(r["text"])) for r in docs]
    for i in range(len(docs)):
        for j in range(i):
            if candidates[i] == candidates[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {r["doc_id"] for i, r in enumerate(docs) if find(i) == i}


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in c.STAGES:
        docs = c.written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_every_stage_against_plain_python(spark, outputs):
    raw = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    labels, items = spark.read.parquet(f"{SF}/labels.parquet").collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    ids = [{r["doc_id"] for r in o.collect()} for o in outputs]
    assert ids[0] == brute_quality(raw, labels)
    assert ids[1] == brute_near([r for r in raw if r["doc_id"] in ids[0]])
    assert ids[2] == {r["doc_id"] for r in raw if r["doc_id"] in ids[1] and not any(i["text"] in (r["text"] or "") for i in items)}
    assert ids[3] == ids[2] == ids[4]
    assert [o.columns for o in outputs[:4]] == [list(raw[0].asDict())] * 4
    for r in outputs[3].collect():
        assert "@mail" not in (r["text"] or "") and r["n_chars"] == len(r["text"] or "")
    pieces = outputs[4].collect()
    assert len({r["sequence_id"] for r in pieces}) == len(one_by_one([r["length"] for r in pieces], 2048))


def test_run_gives_the_last_stage(spark, outputs):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, c.run(spark, SF).select(*columns).collect())) == sorted(map(tuple, outputs[-1].select(*columns).collect()))


def test_stages_take_edge_cases(spark, edge_docs, no_docs):
    for docs in (edge_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs):
        for _, stage in c.STAGES[:-1]:
            docs = c.written(stage(spark, docs, SF), "test-edge")
        c.STAGES[-1][1](spark, docs, SF).count()


def test_leaks_follow_their_threshold():
    assert decontamination.COVERED <= 0.6
