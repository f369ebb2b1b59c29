import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import quality as q


class Plain:
    """Interpolated modified Kneser-Ney over strings, gram by gram."""

    def __init__(self, texts, order=4):
        self.order = order
        top = Counter()
        for t in texts:
            s = chr(q.PAD) * (order - 1) + t
            top.update(s[i : i + order] for i in range(len(t)))
        self.c = {order: top}
        for n in range(order - 1, 0, -1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.d, self.total, self.kinds = {}, defaultdict(int), defaultdict(lambda: [0, 0, 0])
        for n, counts in self.c.items():
            n1, n2, n3, n4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
            d = [0.5, 1.0, 1.5]
            if n1 and n2 and n3:
                y = n1 / (n1 + 2 * n2)
                d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
                d = [x if 0 < x < k + 1 else (k + 1) / 2 for k, x in enumerate(d)]
            self.d[n] = d
            for g, c in counts.items():
                self.total[n, g[:-1]] += c
                self.kinds[n, g[:-1]][min(c, 3) - 1] += 1

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / (len(self.c[1]) + 1)
        total = self.total.get((n, g[:-1]))
        if not total:
            return self.p(g[1:])
        c = self.c[n][g]
        cut = self.d[n][min(c, 3) - 1] if c else 0
        gamma = sum(d * k for d, k in zip(self.d[n], self.kinds[n, g[:-1]])) / total
        return max(c - cut, 0) / total + gamma * self.p(g[1:])

    def each(self, t):
        s = chr(q.PAD) * (self.order - 1) + t
        return [-math.log(self.p(s[i : i + self.order])) for i in range(len(t))]

    def loss(self, t):
        return sum(self.each(t))

    def worst(self, t, width=5):
        each = self.each(t)
        return max((sum(each[i : i + width]) / min(width, len(t)) for i in range(max(1, len(t) - width + 1))), default=0) if t else 0


@pytest.mark.parametrize("method", ["tables", "join"])
def test_loss_equals_the_plain_model(spark, small_docs, method):
    docs = small_docs.where("doc_id < 60").select("doc_id", "text")
    trusted = [r["text"] for r in docs.where("doc_id % 3 = 0").collect()]
    plain = Plain(trusted)
    model = q.build_model(q.written(q.count_grams(docs.where("doc_id % 3 = 0")), "t"))
    tried = docs.where("doc_id < 20").unionByName(spark.createDataFrame([(900, "zqx ☃☃ жук"), (901, ""), (902, None)], "doc_id long, text string"))
    got = q.scored(tried, model, method).collect()
    assert len(got) == tried.count()
    for r in got:
        assert r[q.SCORED] == len(r["text"] or "")
        assert r[q.LOSS] == pytest.approx(plain.loss(r["text"] or ""), rel=1e-9, abs=1e-9)
        assert r[q.WORST] == pytest.approx(plain.worst(r["text"] or ""), rel=1e-9, abs=1e-9)


def test_probabilities_sum_to_one(small_docs):
    plain = Plain([r["text"] for r in small_docs.limit(20).collect()])
    chars = list(plain.c[1])
    for context in ["the", "\x01\x01\x01", "zzz"]:
        assert sum(plain.p(context + c) for c in chars) + plain.p(context + "☃") == pytest.approx(1)


def test_labelled_documents(spark):
    """Quantiles of held-out texts need some hundred trusted documents to mean anything."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = q.classify(docs, labels).join(labels, "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1 and not r["toxic"]]
    bad = [r["keep"] for r in rows if r["quality"] == 0 and len(r["text"]) > 100]
    toxic = [r["keep"] for r in rows if r["toxic"]]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.3 * len(bad)
    assert sum(toxic) <= 0.4 * len(toxic)


def test_quantiles_are_ranks(spark):
    rnd = random.Random(1)
    values = [(lang, math.exp(rnd.uniform(0, 3))) for lang in ("a", "b", None) for _ in range(rnd.randint(50, 400))]
    got = {r["lang"]: r["limit"] for r in q.quantile_of(spark.createDataFrame(values, "lang string, v double"), "lang", "v", 0.98).collect()}
    for lang in ("a", "b", None):
        own = sorted(v for x, v in values if x == lang)
        at = own[math.ceil(0.98 * len(own)) - 1]
        assert got[lang] == max(v for v in own if math.floor(math.log(v) * q.BINS) == math.floor(math.log(at) * q.BINS))


def test_characters_beyond_the_basic_plane_differ():
    grams, of = q.grams_of(["😀😃", "𝔘x", None, ""])
    assert len(set(grams.tolist())) == 4 and of.tolist() == [0, 0, 1, 1]


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(k, f"plain words number {k % 7}", "en", "mine", "mine") for k in range(40)], "doc_id long, text string, lang string, keep string, _loss string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    assert {r["_loss"] for r in q.classify(docs, labels).collect()} == {"mine"}
    assert {(r["keep"], r["_loss"]) for r in q.keep_good(docs, labels).collect()} == {("mine", "mine")}


def test_edges(edge_docs, no_docs, spark):
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, None), (8, 1, 0), (None, 1, 0), (9, None, None), (10, 1, 1)], "doc_id long, quality int, toxic int")
    rows = q.classify(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count()
    assert all(r["keep"] and r["perplexity"] is None for r in rows if not r["text"])
    assert all(r["perplexity"] > 1 for r in rows if r["text"])
    none = q.classify(edge_docs, labels.where("false")).collect()
    assert all(r["keep"] for r in none) and len(none) == len(rows)
    assert q.classify(no_docs, labels).count() == 0
    assert q.keep_good(edge_docs, labels).columns == edge_docs.columns
