import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import expressions as X
from lakeloom.functions.probability import chi2_tail, kolmogorov_tail
from lakeloom.operators import baseline, comparables, evaluation, expectations, ledger, monitoring, profile, rules, splitting, statistics
from lakeloom.operators.rules import RowRule
from lakeloom.operators.running import running_sums


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))


def test_funnel_keeps_bounds_and_null_dates_and_counts_in_order(spark):
    rows = [(1, 500.0, None), (2, 499.9, "2020"), (3, None, "2020"), (4, 2000.0, "2021"), (5, 2000.0, "2021"), (6, 700.0, "2030")]
    df = spark.createDataFrame(rows, "id int, price double, date string")
    own = [RowRule("date", F.col("date").isNull() | (F.col("date") <= "2025")), RowRule("price", F.col("price").between(500.0, 2000.0))]
    assert values(rules.funnel(df, own, ["price", "date"]), "step", "rows", "removed") == [(0, 6, 0), (1, 5, 1), (2, 3, 2), (3, 2, 1)]
    assert values(rules.keep_first(rules.apply_rules(df, own), ["price", "date"], ["id"]), "id") == [(1,), (4,)]


def test_keep_first_takes_nulls_as_equal_and_the_smaller_id(spark):
    df = spark.createDataFrame([(3, None), (1, None), (2, "a"), (5, "a")], "id int, k string").repartition(3)
    assert values(rules.keep_first(df, ["k"], ["id"]), "id") == [(1,), (2,)]


def test_hash_split_is_that_of_plain_python(spark):
    import hashlib

    df = spark.createDataFrame([(f"k{i}é",) for i in range(200)], "k string")
    got = {r["k"]: r["p"] for r in df.select("k", X.hash_position("s", F.col("k")).alias("p")).collect()}
    assert got == {k: int(hashlib.sha256(f"s|{k}".encode()).hexdigest()[:8], 16) % 10000 / 10000 for k in got}
    with pytest.raises(ValueError):
        X.assign_split(F.lit(0.5), [("a", 0.5), ("b", 0.4)])
    with pytest.raises(ValueError):
        X.held_out("s", F.lit("ES"), "ES", F.lit("k"), 0)
    assert spark.range(1).select(X.held_out("s", F.lit(None).cast("string"), "ES", F.lit("k"), 1)).first()[0] is False


def test_split_rules_fire(spark):
    ratios = [("a", 0.5), ("b", 0.4), ("c", 0.1)]
    df = spark.createDataFrame([("g1", "a")] * 95 + [("g2", "b")] * 5, "k string, split string")
    fired = {r["split"]: r["fired"] for r in splitting.split_report(df, "k", ratios).collect()}
    assert fired["c"].startswith("empty,floor") and "concentration" in fired["a"] and "floor" in fired["b"]


def test_expectations_fail_alone_and_together(spark):
    df = spark.createDataFrame([(1.0, "x")] * 98 + [(9.0, "x"), (None, None)], "n double, s string")
    e = expectations.Expectation
    suite = [e("filled", "n", "not_null", mostly=0.99), e("range", "n", "between", 0.0, 5.0, mostly=0.99), e("hard", "n", "between", 0.0, 5.0), e("set", "s", "in_set", values=("x",))]
    got = expectations.run_suite(df, suite, 1000)
    assert values(got, "rule", "unexpected", "passed") == [("filled", 1, True), ("hard", 1, False), ("range", 1, False), ("row_count", 900, False), ("set", 0, True)]
    with pytest.raises(expectations.QualityError, match="hard.*row_count|row_count.*hard"):
        expectations.require(got)
    with pytest.raises(ValueError):
        expectations.run_suite(df, [])


def test_expressions(spark):
    df = spark.createDataFrame([(" 1,945 kg ", "Été S.line 2.0 TDI", 0.0, "['a', 'b\"c']"), ("1945kg", "...", 1.0, "[]"), ("19,45 kg", None, -1.0, None), (None, "", None, None)], "w string, t string, n double, l string")
    out = df.select(X.parsed_weight(F.col("w")).alias("w"), X.text_tokens(F.col("t"), 3).alias("t"), X.bucket(F.col("n"), [0, 1, 3]).alias("b"), X.parsed_list(F.col("l")).alias("l"), X.level_code(F.col("t"), ["", "..."]).alias("c")).collect()
    assert [r["w"] for r in out] == [1945.0, None, None, None]
    assert [r["t"] for r in out] == ["ete s line", None, None, None]
    assert [r["b"] for r in out] == ["0 to 1", "1 to 3", "(invalid)", "(missing)"]
    assert [r["l"] for r in out] == [["a", 'b"c'], [], None, None]
    assert [r["c"] for r in out] == [-1, 1, -1, 0]
    months = spark.createDataFrame([("2025-11-07",), ("2025-11-08",), ("2025-12-07",), ("2024-11-08",)], "d string").select(X.whole_months(F.col("d").cast("date"), "2025-11-08").alias("m"))
    assert [r["m"] for r in months.collect()] == [-1, 0, 0, -12]


def test_frequent_items_are_strictly_over_the_share(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a"],), (None,), (["b"],)], "x array<string>")
    assert values(profile.frequent_items(df, "x", 0.5), "item") == []
    assert values(profile.frequent_items(df, "x", 0.49), "item", "n") == [("a", 2), ("b", 2)]
    assert profile.vocabulary(df.withColumn("c", F.lit("z")), ["c"], {"x": 0.4}) == {"train_rows": 4, "categories": {"c": ["z"]}, "items": {"x": ["a", "b"]}}


def test_baseline_falls_back(spark):
    train = spark.createDataFrame([("a", "x", 1, 10.0), ("a", "x", 1, 20.0), ("a", "y", 2, 100.0), ("b", None, 1, 7.0)], "m string, o string, b int, p double")
    medians = baseline.fit_medians(train, "m", "o", F.col("b"), "p")
    rows = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "q", 1), (3, "zz", "x", 1), (4, None, None, None), (5, "b", None, 1)], "id int, m string, o string, b int")
    assert values(baseline.predict_medians(rows, medians, "m", "o", F.col("b")), "id", "predicted") == [(1, 15.0), (2, 20.0), (3, 15.0), (4, 15.0), (5, 7.0)]


def test_verdict_blocks_on_open_criteria_and_waives(spark):
    def run(*passed):
        return evaluation.verdict(spark.createDataFrame([(f"c{i}", p) for i, p in enumerate(passed)], "criterion string, passed boolean"), waived=["c0"]).first()

    assert run(False, True)["deployable"] and not run(True, None)["deployable"] and run(None, None, False)["blocking"] == "c1,c2"


def test_nearest_equals_a_plain_search(spark):
    rnd = random.Random(3)
    index = [(i, rnd.choice("ab"), rnd.choice("xy"), rnd.choice([None, rnd.uniform(-1, 9)]), rnd.choice([None, rnd.uniform(0, 100)])) for i in range(300)]
    queries = [(i, rnd.choice("abc"), rnd.choice([None, "x"]), rnd.choice([None, rnd.uniform(0, 9)]), rnd.choice([None, rnd.uniform(0, 100)])) for i in range(40)]
    got = comparables.nearest(spark.createDataFrame(queries, "query_id int, make string, model string, age double, mileage double"), spark.createDataFrame(index, "id int, make string, model string, age double, mileage double"))
    want = []
    for q, make, model, age, km in queries:
        near = [((abs(k - km) if km is not None else 0), (abs(a - age) if age is not None else 0), i) for i, m, o, a, k in index if m == make and model in (None, o) and (age is None or a is not None and abs(a - age) <= 2) and (km is None or k is not None and abs(k - km) <= 0.25 * km)]
        want += [(q, r, n[2]) for r, n in enumerate(sorted(near)[:5], 1)]
    assert values(got, "query_id", "rank", "id") == sorted(want)


@pytest.mark.parametrize("seed", range(6))
def test_count_windows_equal_a_row_by_row_pass(spark, seed):
    rnd = random.Random(seed)
    version, rows, seq = 0, [], 0
    for _ in range(rnd.choice([1, 40, 300])):
        seq += rnd.choice([1, 1, 1, 2, 30])
        version += rnd.random() < 0.08
        rows.append((seq, version))
    size = rnd.choice([1, 3, 7, 50])
    held, want = [], []
    for s, v in rows:
        if held and held[-1][1] != v:
            want.append((held[0][0], held[-1][0], len(held), "partial"))
            held = []
        held.append((s, v))
        if len(held) == size:
            want.append((held[0][0], held[-1][0], size, "tested"))
            held = []
    if held:
        want.append((held[0][0], held[-1][0], len(held), "open"))
    log = spark.createDataFrame(rows, "seq long, version int").repartition(4)
    got = monitoring.window_states(monitoring.count_windows(log, "seq", "version", size), "seq", size)
    assert values(got, "first_seq", "last_seq", "rows", "state") == sorted(want)


def test_running_sums(spark):
    rows = [(g, float(v), (v * 7 + g) % 5) for g in (0, 1) for v in range(500)]
    got = running_sums(spark.createDataFrame(rows, "g int, v double, k int"), "v", {"cum": "k"}, ["g"])
    total, want = Counter(), []
    for g, v, k in rows:
        total[g] += k
        want.append((g, v, total[g]))
    assert values(got, "g", "v", "cum") == sorted(want)


def test_tail_probabilities():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9) and chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert chi2_tail(5.0, 0) == 1.0 and kolmogorov_tail(0.5, 1, 10) == 1.0
    assert kolmogorov_tail(1.3580986393225507 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-6)


def test_performance_needs_labels(spark):
    rows = [(0, 0, 100.0, 100.0 + i / 100) for i in range(400)] + [(0, 0, 100.0, 130.0)] * 400 + [(1, 0, 100.0, 90.0)] * 5
    out = monitoring.window_performance(spark.createDataFrame(rows, "run int, window int, o double, p double"), "o", "p", F.col("p") < 125)
    got = values(out, "run", "labels", "mdape", "coverage", "status")
    assert got == [(0, 800, pytest.approx((0.0399 + 0.3) / 2), 0.5, "ok"), (1, 5, None, None, "insufficient_labels")]


def test_ledger(spark):
    t = lambda rows: spark.createDataFrame(rows, "k int, v int, o int")
    assert values(ledger.first_wins(t([(1, 1, 0)]), t([(1, 9, 1), (2, 5, 2), (2, 6, 3)]), ["k"], ["o"]), "k", "v") == [(2, 5)]
    assert values(ledger.latest_wins(t([(1, 1, 0)]), t([(1, 9, 1), (2, 5, 2), (2, 6, 3)]), ["k"], "o"), "k", "v") == [(1, 9), (2, 6)]
    log = spark.createDataFrame([(i * 3,) for i in range(1000)], "seq long").repartition(3)
    assert ledger.prune(log, "seq", 1000).count() == 1000
    assert values(ledger.prune(log, "seq", 100), "seq") == [(i * 3,) for i in range(910, 1000)]
    assert ledger.prune(log, "seq", 1).count() == 1


def test_bootstrap_interval_holds_the_mean(spark):
    rows = [(g, float(g % 10) + i / 10) for g in range(200) for i in range(3)]
    r = statistics.cluster_bootstrap(spark.createDataFrame(rows, "g int, d double"), "g", "d", 300, "s").first()
    assert r["lower"] < r["estimate"] < r["upper"] and 0.1 < r["std_error"] < 0.4
    w = spark.range(20_000).select(statistics.poisson_weight("s", F.col("id"), F.lit(0)).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert w[0] == pytest.approx(1, abs=0.03) and w[1] == pytest.approx(1, abs=0.05)


def test_conformal_offset_is_the_stated_order_statistic(spark):
    rows = [(float(i), 10.0, 60.0) for i in range(99)]
    got = {r["side"]: r["offset"] for r in statistics.conformal_offsets(spark.createDataFrame(rows, "a double, l double, u double"), "a", "l", "u", 0.9).collect()}
    assert got == {"lower": sorted(10.0 - i for i in range(99))[94], "upper": sorted(i - 60.0 for i in range(99))[94]}


def test_quantiles_by_counted_values(spark):
    import random

    from lakeloom.operators.running import exact_quantiles

    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), float(rnd.choice([1, 2, 2.5, 7, rnd.random()]))) for _ in range(300)] + [("c", 4.0), ("c", None)]
    got = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0, 0.25, 0.5, 1], ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        own = sorted(v for x, v in rows if x == g and v is not None)
        want = [own[int(i)] + (own[min(int(i) + 1, len(own) - 1)] - own[int(i)]) * (i - int(i)) for i in ((len(own) - 1) * s for s in (0, 0.25, 0.5, 1))]
        assert got[g]["n"] == len(own) and [got[g][f"q{k}"] for k in range(4)] == pytest.approx(want)


def test_folding_is_a_compatibility_decomposition(spark):
    import unicodedata

    from lakeloom.functions.expressions import feature_name, folded

    texts = ["Éclair ñandú", "ﬁne ½ ℡ №5", "ＡＢＣ Łódź Straße", "é … ｶﾞ 𝔘nicode 日本", "plain"]
    got = [r["f"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(folded(F.col("t")).alias("f")).collect()]
    assert got == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() for t in texts]
    assert feature_name("extra", "Câmera ½") == "extra_camera_12"


def test_latest_wins_has_one_answer_for_ties(spark):
    from lakeloom.operators.ledger import latest_wins

    rows = [(1, 5, "a"), (1, 5, "c"), (1, 5, "b"), (2, 1, "x")]
    out = [latest_wins(spark.createDataFrame(part, "k int, o int, v string"), spark.createDataFrame(rest, "k int, o int, v string"), ["k"], "o") for part, rest in ((rows[:2], rows[2:]), (rows[2:], rows[:2]))]
    assert [sorted(map(tuple, o.collect())) for o in out] == [[(1, 5, "c"), (2, 1, "x")]] * 2


def test_texts_that_cannot_be_read_are_refused(spark):
    df = spark.createDataFrame([("1,945 kg",), (None,), ("12 lb",), ("x",), ("12 lb",), *[(f"bad {k}",) for k in range(9)]], "w string")
    parsed = X.parsed_weight(F.col("w"))
    with pytest.raises(ValueError, match=r"'12 lb', 'bad 0', 'bad 1', 'bad 2', 'bad 3'$"):
        rules.refuse_unparsed(df, "w", parsed)
    assert rules.refuse_unparsed(df.where("w like '%kg' or w is null"), "w", parsed).count() == 2
