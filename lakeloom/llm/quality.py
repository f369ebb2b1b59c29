"""Quality by perplexity under an interpolated modified Kneser-Ney model trained on trusted text.

The model is over characters, four at a time: an n-gram is a 64-bit number of four 16-bit code
points (those beyond the basic plane by their lowest 11 bits, in the range of the surrogates, which no text holds), so counts and joins are over longs. Counts
cover all trusted text. Spark shards every count table by its n-gram and joins the orders, from
single characters up, into one table of probabilities for each order (after Chen and Goodman, 1999).
A document's perplexity is then found in one of two ways that give the same figures:

- ``join``: each document's different n-grams are joined with the sharded tables;
- ``tables``: where the tables are counted to have at most TABLE_ROWS rows, they are broadcast and
  looked up while documents stream by, without moving them.

A document is rejected if its perplexity, or that of its worst few characters in a row, is over a quantile of its language's
trusted documents. Trusted documents are scored for that by models that did not count them (folds by a hash of the text).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.graph import hinted
from lakeloom.llm.shared import counted, fresh, text_batches, written

ORDER = 4
#: Tables of more rows than this (16 bytes each) are joined, not broadcast.
TABLE_ROWS = 4_000_000
#: More trusted ids than this are joined by a shuffle, not a broadcast.
TRUSTED_IDS = 1_000_000
PAD = 1
#: Characters in a row whose mean loss is a text's peak, and folds of the trusted texts.
PEAK, FOLDS = 5, 5
#: Quantiles are over bins of so many to a unit of the logarithm.
BINS = 100_000
LOSS, SCORED, WORST = "_loss_of_quality", "_scored_of_quality", "_worst_of_quality"


def grams_of(texts: list[str | None]):
    """The n-grams that end in each character of each text, and the index of their text.

    The first characters are seen behind ORDER - 1 padding marks.
    """
    import numpy as np

    pad = chr(PAD) * (ORDER - 1)
    sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    a = np.frombuffer("".join(pad + (t or "") for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    a = np.where(a > 0xFFFF, 0xD800 + (a & 0x7FF), a).astype(np.uint64)
    g = a.copy()
    for k in range(1, ORDER):
        g[k:] |= a[:-k] << np.uint64(16 * k)
    own = np.ones(len(a), dtype=bool)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    for k in range(ORDER - 1):
        own[starts + k] = False
    return g[own].view(np.int64), np.repeat(np.arange(len(texts)), sizes)


def peaks(losses, of, texts: int):
    """The largest mean of PEAK losses in a row of each text (shorter ones: the mean of all; none: 0)."""
    import numpy as np

    sizes = np.bincount(of, minlength=texts)
    out = np.zeros(texts)
    if not len(losses):
        return out
    sums = np.concatenate([[0.0], np.cumsum(losses)])
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(losses))
    span = np.minimum(PEAK, sizes)[of]
    mean = np.where(at - starts[of] >= span - 1, (sums[at + 1] - sums[np.maximum(at + 1 - span, 0)]) / span, -np.inf)
    some = np.flatnonzero(sizes)
    out[some] = np.maximum.reduceat(mean, starts[some])
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """gram and its count ``c`` over all texts, for each ``fold`` if the documents have that column; each task adds up before the shuffle."""
    by = [c for c in ("fold",) if c in docs.columns]
    names = [*by, "gram", "c"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def merged(parts):
            g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return g, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(g)).astype(np.int64)

        def batch(fold, g, c):
            return pa.RecordBatch.from_arrays([*([pa.array(np.full(len(g), fold, dtype=np.int32))] if by else []), pa.array(g), pa.array(c)], names=names)

        parts, held = {}, {}
        for b in text_batches(batches, rows=500, chars=500_000):
            folds = b.column("fold").to_numpy() if by else np.zeros(b.num_rows, dtype=np.int32)
            grams, of = grams_of(b.column("text").to_pylist())
            for fold in np.unique(folds).tolist():
                own = parts.setdefault(fold, [])
                own.append(np.unique(grams[folds[of] == fold], return_counts=True))
                held[fold] = held.get(fold, 0) + len(own[-1][0])
                if held[fold] > 500_000:
                    parts[fold] = [merged(own)]
                    held[fold] = len(parts[fold][0][0])
                    if held[fold] > 400_000:
                        yield batch(fold, *parts[fold][0])
                        parts[fold], held[fold] = [], 0
        for fold, own in parts.items():
            if own:
                yield batch(fold, *merged(own))

    counted = docs.select("text", *by).mapInArrow(run, "".join(f"{c} int, " for c in by) + "gram long, c long")
    return counted.groupBy(*by, "gram").agg(F.sum("c").alias("c"))


def held_out_counts(counts: DataFrame) -> DataFrame:
    """From the counts of each fold, those of all other folds under its number, and of all under FOLDS."""
    sums = counts.groupBy("gram").agg(F.sum("c").alias("all"), *[F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("c"))), F.lit(0)).alias(f"c{k}") for k in range(FOLDS)])
    rest = [F.struct(F.lit(k).alias("fold"), (F.col("all") - F.col(f"c{k}")).alias("c")) for k in range(FOLDS)]
    each = sums.select("gram", F.explode(F.array(*rest, F.struct(F.lit(FOLDS).alias("fold"), F.col("all").alias("c")))).alias("x"))
    return each.select("x.fold", "gram", "x.c").where("c > 0")


def _suffix(gram: Column, n: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (16 * n)) - 1))


def build_model(counts: DataFrame) -> dict[int, dict[str, DataFrame]]:
    """For each order: ``grams`` (gram, p) and ``contexts`` (context, gamma), sharded by their key.

    The highest order uses counts, each lower one the number of different characters seen before.
    Discounts come from the counts of counts of their order; where those are too thin for the
    formula (a few grams in all), 0.5, 1 and 1.5 stand in. Single characters are interpolated with a uniform
    share over the characters seen and one unseen character. Counts with a column ``fold`` give a model for each fold, in the same tables.
    One query counts the counts of all orders, and one table holds the contexts of all.
    """
    by = [c for c in ("fold",) if c in counts.columns]
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = written(tables[n + 1].select(*by, _suffix(F.col("gram"), n).alias("gram")).groupBy(*by, "gram").agg(F.count("*").alias("c")), f"grams{n}")
    of_fold = lambda values: reduce(lambda a, k: a.when(F.col("fold") == k, values[k]), values, F.when(F.lit(False), 0.0)) if by else F.lit(values[0])
    every = reduce(DataFrame.unionByName, [t.select(*by, F.lit(n).alias("n"), "c") for n, t in tables.items()])
    of_counts = every.groupBy(*by, "n").agg(F.count("*").alias("all"), *[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()  # a row for each order and fold
    characters = of_fold({r["fold"] if by else 0: float(r["all"]) for r in of_counts if r["n"] == 1} or {0: 0.0})
    cuts, parts = {}, []
    for n in range(1, ORDER + 1):
        discounts = {}
        for r in of_counts:
            if r["n"] != n:
                continue
            n1, n2, n3, n4 = (r[f"n{k}"] or 0 for k in (1, 2, 3, 4))
            d = [0.5, 1.0, 1.5]
            if n1 and n2 and n3:
                y = n1 / (n1 + 2 * n2)
                d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
                d = [x if 0 < x < k + 1 else (k + 1) / 2 for k, x in enumerate(d)]
            discounts[r["fold"] if by else 0] = d
        d = [of_fold({f: x[k] for f, x in discounts.items()} or {0: 0.5}) for k in range(3)]
        cuts[n] = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        tables[n] = tables[n].withColumn("context", F.shiftrightunsigned("gram", 16) if n > 1 else F.lit(0).cast("long"))
        parts.append(tables[n].select(*by, F.lit(n).alias("n"), "context", "c", cuts[n].alias("cut")))
    sums = reduce(DataFrame.unionByName, parts).groupBy(*by, "n", "context").agg(F.sum("c").alias("total"), F.sum("cut").alias("freed"))
    sums = written(sums.select(*by, "n", "context", "total", (F.col("freed") / F.col("total")).alias("gamma")), "contexts")
    out: dict[int, dict[str, DataFrame]] = {}
    below: DataFrame | None = None
    for n in range(1, ORDER + 1):
        contexts = sums.where(F.col("n") == n).drop("n")
        joined = tables[n].join(contexts, [*by, "context"]).withColumn("alpha", (F.col("c") - cuts[n]) / F.col("total"))
        if n == 1:
            grams = joined.select(*by, "gram", (F.col("alpha") + F.col("gamma") / (characters + 1)).alias("p"))
        else:
            lower = below.select(*by, F.col("gram").alias("suffix"), F.col("p").alias("lower_p"))
            grams = joined.withColumn("suffix", _suffix(F.col("gram"), n - 1)).join(lower, [*by, "suffix"]).select(*by, "gram", (F.col("alpha") + F.col("gamma") * F.col("lower_p")).alias("p"))
        below = written(grams, f"model{n}")
        out[n] = {"grams": below, "contexts": contexts.select(*by, "context", "gamma")}
    return out


class Tables:
    """The model as sorted arrays, and the log-probabilities of n-grams from them."""

    def __init__(self, model: dict[int, dict[str, list]], characters: int):
        import numpy as np

        self.model, self.characters = model, characters
        g, p = model[ORDER]["grams"]
        self.bits = np.uint64(64 - max(10, int(len(g)).bit_length() + 2))
        self.key = np.zeros(1 << (64 - int(self.bits)), dtype=np.int64)
        self.log = np.full(len(self.key), np.nan)
        at = self._slot(g)
        self.key[at], self.log[at] = g, np.log(p)

    def _slot(self, g):
        import numpy as np

        return ((g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def _find(self, n: int, what: str, keys):
        import numpy as np

        sorted_keys, values = self.model[n][what]
        if not len(sorted_keys):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == keys, values[at], np.nan)

    def _p(self, n: int, g):
        """Probabilities of grams of order n, seen or not."""
        import numpy as np

        p = self._find(n, "grams", g)
        lost = np.flatnonzero(np.isnan(p))
        if len(lost):
            if n == 1:
                gamma = self.model[1]["contexts"][1]
                p[lost] = (gamma[0] if len(gamma) else 1.0) / (self.characters + 1)
            else:
                own = g[lost]
                gamma = self._find(n, "contexts", (own.view(np.uint64) >> np.uint64(16)).view(np.int64))
                p[lost] = np.where(np.isnan(gamma), 1.0, gamma) * self._p(n - 1, own & np.int64((1 << (16 * (n - 1))) - 1))
        return p

    def logs(self, g):
        import numpy as np

        at = self._slot(g)
        out = self.log[at]
        out[self.key[at] != g] = np.nan
        lost = np.flatnonzero(np.isnan(out))
        if len(lost):
            rare, back = np.unique(g[lost], return_inverse=True)
            out[lost] = np.log(self._p(ORDER, rare))[back]
        return out


def of_fold(model, fold: int):
    """The model of one fold."""
    return {n: {what: df.where(F.col("fold") == fold).drop("fold") for what, df in both.items()} for n, both in model.items()}


def _collected(model) -> dict:
    """The tables of each fold (0 if there are none) as sorted arrays, and the number of characters. Only called where their rows are counted to be few enough."""
    import numpy as np

    out: dict = {}
    for orders in ([ORDER], [n for n in model if n != ORDER]):  # about half of the rows each
        whole = _in_one({n: model[n] for n in orders}).toArrow()
        fold, table, k, v = (whole.column(c).to_numpy() for c in ("fold", "at", "k", "v"))
        del whole
        for f in np.unique(fold).tolist() or [0]:
            for n in orders:
                for at, what in ((2 * n, "grams"), (2 * n + 1, "contexts")):
                    own = np.flatnonzero((fold == f) & (table == at))
                    own = own[np.argsort(k[own], kind="stable")]
                    out.setdefault(f, {}).setdefault(n, {})[what] = (k[own], v[own])
    return {fold: (tables, len(tables[1]["grams"][0])) for fold, tables in out.items()}


def _in_one(model) -> DataFrame:
    """All tables of a model in one, so that one query reads them: ``fold`` (0 if there are none), ``at`` (twice the order, contexts one more), ``k`` and ``v``."""

    def of(df: DataFrame, at: int) -> DataFrame:
        fold = F.col("fold") if "fold" in df.columns else F.lit(0)
        return df.select(fold.cast("tinyint").alias("fold"), F.lit(at).cast("tinyint").alias("at"), *[F.col(c).alias(x) for c, x in zip(df.columns[-2:], "kv", strict=True)])

    return reduce(DataFrame.unionByName, [of(df, 2 * n + j) for n, both in model.items() for j, df in enumerate((both["grams"], both["contexts"]))])


def table_rows(model) -> int:
    return _in_one(model).count()


def scored(docs: DataFrame, model, method: str | None = None) -> DataFrame:
    """The documents with LOSS (sum of negative log-probabilities), SCORED (characters) and WORST (largest mean loss of PEAK characters in a row).

    Where the model has folds, the documents have a column ``fold`` that tells which one scores them.
    """
    method = method or ("tables" if table_rows(model) <= TABLE_ROWS else "join")
    if method == "tables":
        return _scored_by_tables(docs, model)
    if "fold" not in model[1]["grams"].columns:
        return _scored_by_join(docs, model)
    return reduce(DataFrame.unionByName, [_scored_by_join(docs.where(F.col("fold") == k), of_fold(model, k)) for k in range(FOLDS)])


def _scored_by_tables(docs: DataFrame, model) -> DataFrame:
    by_fold = "fold" in model[1]["grams"].columns
    shared = docs.sparkSession.sparkContext.broadcast(_collected(model))
    schema = T.StructType([*docs.schema.fields, T.StructField(LOSS, T.DoubleType()), T.StructField(SCORED, T.LongType()), T.StructField(WORST, T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        made = {}
        for whole in text_batches(batches, rows=500, chars=250_000):
            folds = whole.column("fold").to_numpy() if by_fold else np.zeros(whole.num_rows, dtype=np.int64)
            for fold in np.unique(folds).tolist():
                if fold not in made:
                    made[fold] = Tables(*shared.value[fold])
                b = whole.filter(pa.array(folds == fold)) if by_fold else whole
                texts = b.column("text").to_pylist()
                g, of = grams_of(texts)
                each = -made[fold].logs(g) if len(g) else np.zeros(0)
                loss = np.bincount(of, weights=each, minlength=len(texts)) if len(g) else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(loss), pa.array([len(t) if t else 0 for t in texts], type=pa.int64()), pa.array(peaks(each, of, len(texts)))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _scored_by_join(docs: DataFrame, model) -> DataFrame:
    """As by tables, but each document's different n-grams meet the sharded tables in joins, order by order."""
    row = "_row_of_quality"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in text_batches(batches, rows=500, chars=1_000_000):
            g, of = grams_of(b.column("text").to_pylist())
            ids = b.column(row).to_numpy()
            at = np.arange(len(g)) - np.searchsorted(of, of)
            order = np.lexsort((at, g, of))
            g, of, at = g[order], of[order], at[order]
            first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (of[1:] != of[:-1])]) if len(g) else np.zeros(0, dtype=np.int64)
            places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(g)].astype(np.int32)), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[of[first]]), pa.array(g[first]), places], names=[row, "gram", "at"])

    asked = numbered.select(row, "text").mapInArrow(run, f"{row} long, gram long, at array<int>")
    gamma0 = model[1]["contexts"].first()
    unseen = (gamma0["gamma"] if gamma0 else 1.0) / (model[1]["grams"].count() + 1)
    p = F.lit(None).cast("double")
    weight = F.lit(1.0)
    for n in range(ORDER, 0, -1):
        grams, contexts = model[n]["grams"].select(F.col("gram").alias(f"g{n}"), F.col("p").alias(f"p{n}")), model[n]["contexts"].select(F.col("context").alias(f"c{n}"), F.col("gamma").alias(f"y{n}"))
        gram = _suffix(F.col("gram"), n) if n < ORDER else F.col("gram")
        asked = asked.join(grams, gram == F.col(f"g{n}"), "left")
        p = F.coalesce(p, weight * F.col(f"p{n}"))
        if n > 1:
            asked = asked.join(contexts, F.shiftrightunsigned(gram, 16) == F.col(f"c{n}"), "left")
            weight = weight * F.coalesce(F.col(f"y{n}"), F.lit(1.0))
    p = F.coalesce(p, weight * unseen)
    lists = asked.groupBy(row).agg(F.collect_list(F.struct((-F.log(p)).alias("loss"), "at")).alias("grams"))

    def add_up(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):  # a row holds the different n-grams of one text
                grams = b.column("grams")[i].values
                at = grams.field("at")
                each = np.empty(len(at.flatten()))
                each[at.flatten().to_numpy()] = np.repeat(grams.field("loss").to_numpy(), at.value_lengths().to_numpy())
                worst = peaks(each, np.zeros(len(each), dtype=np.int64), 1)
                yield pa.RecordBatch.from_arrays([b.column(row).slice(i, 1), pa.array([each.sum()]), pa.array([len(each)], type=pa.int64()), pa.array(worst)], names=[row, LOSS, SCORED, WORST])

    sums = lists.mapInArrow(add_up, f"{row} long, {LOSS} double, {SCORED} long, {WORST} double")
    return numbered.join(sums, row, "left").select(*docs.columns, *[F.coalesce(F.col(c), F.lit(z)).alias(c) for c, z in ((LOSS, 0.0), (SCORED, 0), (WORST, 0.0))])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids that no label calls low quality or toxic and some label calls good."""
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")
    return hinted(counted(ids, "trusted"), TRUSTED_IDS)


def quantile_of(values: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """``by`` and ``limit``, the value of rank ceil(share * n) among the values of each ``by``, up to the largest in its bin.

    Values (positive) are counted in BINS bins to a unit of their logarithm, so what is sorted is bounded, and the result does not depend on partitions.
    """
    bins = values.groupBy(by, F.floor(F.log(value) * BINS).alias("bin")).agg(F.count("*").alias("n"), F.max(value).alias("most"))
    order = Window.partitionBy(by).orderBy("bin")
    ranked = bins.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    return ranked.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(by).agg(F.min("most").alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, peak_quantile: float = 0.99, prior: int = 30, method: str | None = None) -> DataFrame:
    """The documents with ``perplexity``, ``limit``, ``peak``, ``peak_limit`` and ``keep``.

    A perplexity counts ``prior`` characters of the mean trusted loss of the language besides the
    document's own, so a few characters of text prove little; ``peak`` is the perplexity of the worst PEAK characters in a row. ``limit`` is the
    ``quantile`` and ``peak_limit`` the ``peak_quantile`` of those of trusted documents in the language, each scored by a model of the trusted texts of other folds;
    equal texts are of one fold. Languages without trusted documents (null is one) share the mean and the limits over all of them.
    Null and empty texts have a null perplexity and are kept, there being nothing to hold against
    them. Without trusted text at all every document is kept. Repeated rows each keep their row. Columns of the input
    that have a name of these five are replaced; others stay as they are.
    """
    named = _judged(docs, labels, quantile, peak_quantile, prior, method)
    new = ["perplexity", "limit", "peak", "peak_limit", "keep"]
    return named.select(*[c for c in docs.columns if c not in new], *[F.col(f"_{c}_of_quality").alias(c) for c in new])


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, peak_quantile: float, prior: int, method: str | None) -> DataFrame:
    """``classify`` with its columns under names of their own."""
    ids = trusted_ids(labels)
    trusted = docs.join(ids, "doc_id", "left_semi").where("text is not null").select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    trusted = written(trusted, "trusted-texts")
    models = build_model(written(held_out_counts(count_grams(trusted)), f"grams{ORDER}"))
    every = method or ("tables" if table_rows(models) <= TABLE_ROWS else "join")
    known = scored(trusted, models, every).where(F.col(SCORED) > 0).select("lang", LOSS, SCORED, WORST)
    known = written(known, "trusted-loss")
    mean = (F.sum(LOSS) / F.sum(SCORED)).alias("mean")
    whole = known.agg(mean).first()["mean"]
    perplexity = lambda m: F.exp((F.col(LOSS) + prior * m) / (F.col(SCORED) + prior))
    means = known.where("lang is not null").groupBy("lang").agg(mean)
    # A row of every language, and one of all of them together under a null.
    own = known.join(means, "lang").select("lang", perplexity(F.col("mean")).alias("ppl"), F.exp(WORST).alias("peak"))
    both = own.unionByName(known.select(F.lit(None).cast("string").alias("lang"), perplexity(F.lit(whole).cast("double")).alias("ppl"), F.exp(WORST).alias("peak")))
    both = written(both, "trusted-perplexities")
    limits = quantile_of(both, "lang", "ppl", quantile).withColumnRenamed("limit", "ppl_limit").alias("p").join(quantile_of(both, "lang", "peak", peak_quantile).alias("q"), F.col("p.lang").eqNullSafe(F.col("q.lang"))).select("p.lang", "ppl_limit", F.col("limit").alias("peak_limit"))
    limits = written(limits, "limits")
    pooled = limits.where("lang is null").first()
    pooled = (pooled["ppl_limit"], pooled["peak_limit"]) if pooled else (None, None)
    lang_of, mean_of, p_of, q_of = (fresh(n, docs) for n in ("_lang_of_quality", "_mean_of_quality", "_p_of_quality", "_q_of_quality"))
    table = limits.join(means, "lang").select(F.col("lang").alias(lang_of), F.col("mean").alias(mean_of), F.col("ppl_limit").alias(p_of), F.col("peak_limit").alias(q_of))
    # Where all tables are few enough, those of one model are.
    out = scored(docs, of_fold(models, FOLDS), "tables" if every == "tables" else method).join(F.broadcast(written(table, "languages")), F.col("lang") == F.col(lang_of), "left")
    some = F.col(SCORED) > 0
    p, q = F.when(some, perplexity(F.coalesce(F.col(mean_of), F.lit(whole).cast("double")))), F.when(some, F.exp(WORST))
    p_limit, q_limit = (F.coalesce(c, F.lit(x).cast("double")) for c, x in zip((F.col(p_of), F.col(q_of)), pooled, strict=True))
    keep = F.coalesce((p <= p_limit) & (q <= q_limit), F.lit(True))
    return out.select(*docs.columns, *[c.alias(f"_{n}_of_quality") for n, c in (("perplexity", p), ("limit", p_limit), ("peak", q), ("peak_limit", q_limit), ("keep", keep))])


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, peak_quantile: float = 0.99) -> DataFrame:
    """The documents that ``classify`` keeps, with their own columns."""
    return _judged(docs, labels, quantile, peak_quantile, 30, None).where("_keep_of_quality").select(*docs.columns)
