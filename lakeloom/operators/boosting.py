"""Boosted quantile trees on binned columns, their learning curves and their exact contributions.

A round grows one tree level by level: rows are counted by (node, feature, bin) with how many of them lie under the prediction, which
is all that the gradient of the pinball loss needs. Only these counts, at most nodes x features x bins, reach the driver, which picks the splits.
Leaves take the wanted quantile of their rows' residuals, found by counting. Predictions are expressions, so trees run inside generated code;
rows are written after each round, so plans stay short.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.lineage import cut
from lakeloom.operators.running import exact_quantiles, in_slices, slice_edges

#: Levels of a category that get a bin of their own; rarer ones share the bin of missing values.
LEVELS = 255


class Node(NamedTuple):
    """A leaf has ``feature`` -1; other nodes send a row left if its bin is at most ``edge``. ``cover``: training rows."""

    feature: int
    edge: int
    left: int
    right: int
    value: float
    cover: int


class Boosted(NamedTuple):
    """A model: what columns become bins (edges of numbers; levels of categories in order of their median target), and the trees over them."""

    share: float
    base: float
    numbers: dict[str, list[float]]
    categories: dict[str, list[str]]
    trees: list[list[Node]]
    losses: list[float]

    @property
    def features(self) -> list[str]:
        return [*self.numbers, *self.categories]


def _bin(i: int) -> str:
    return f"_bin{i}"


def binned(df: DataFrame, numbers: dict[str, list[float]], categories: dict[str, list[str]]) -> DataFrame:
    """``df`` with a bin for each feature. Missing numbers, and missing or unknown levels, get the last bin."""
    out = df
    for i, (c, edges) in enumerate(numbers.items()):
        known = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        out = in_slices(out.withColumn(f"_number{i}", known), f"_number{i}", edges, _bin(i))
        out = out.withColumn(_bin(i), F.when(F.col(f"_number{i}").isNull(), len(edges) + 1).otherwise(F.col(_bin(i)))).drop(f"_number{i}")
    for k, (c, levels) in enumerate(categories.items()):
        i = len(numbers) + k
        place = F.array_position(F.array(*map(F.lit, levels)), F.col(c).cast("string")) if levels else F.lit(0)
        out = out.withColumn(_bin(i), F.coalesce(F.when(place > 0, place - 1), F.lit(len(levels))).cast("int"))
    return out


def _levels(train: DataFrame, column: str, target: str, edges: Sequence[float]) -> list[str]:
    """The most frequent levels in order of their median target, ties by name."""
    level = F.col(column).cast("string")
    rows = train.where(level.isNotNull() & F.col(target).isNotNull()).select(level.alias("_l"), F.col(target).cast("double").alias("_t"))
    kept = [r["_l"] for r in rows.groupBy("_l").count().orderBy(F.desc("count"), "_l").limit(LEVELS).collect()]
    medians = exact_quantiles(rows.where(F.col("_l").isin(kept)), "_t", [0.5], ["_l"], edges) if kept else None
    return [r["_l"] for r in sorted(medians.collect(), key=lambda r: (r["q0"], r["_l"]))] if kept else []


def _expression(tree: Sequence[Node], at: int = 0, leaf=lambda n, node: F.lit(node.value)) -> Column:
    node = tree[at]
    if node.feature < 0:
        return leaf(at, node)
    return F.when(F.col(_bin(node.feature)) <= node.edge, _expression(tree, node.left, leaf)).otherwise(_expression(tree, node.right, leaf))


def _best_split(counts: dict[tuple[int, int], tuple[int, int]], features: int, share: float, least: int) -> tuple | None:
    """The split with the largest gain of squared gradient sums over rows: (gain, feature, edge); ties to the first feature and lowest edge.

    ``counts``: of each (feature, bin), rows and how many of them lie under the prediction.
    """
    best = None
    for f in range(features):
        bins = sorted((b, *counts[f, b]) for (g, b) in counts if g == f)
        n, below = sum(x[1] for x in bins), sum(x[2] for x in bins)
        whole = (share * n - below) ** 2 / n
        left_n = left_below = 0
        for b, k, u in bins[:-1]:
            left_n, left_below = left_n + k, left_below + u
            if min(left_n, n - left_n) >= least:
                gain = (share * left_n - left_below) ** 2 / left_n + (share * (n - left_n) - (below - left_below)) ** 2 / (n - left_n) - whole
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, b
    return best


def _grown(rows: DataFrame, features: int, share: float, depth: int, least: int) -> list[Node]:
    """A tree on ``_y`` and the prediction ``_p``, without leaf values."""
    tree, open_ = [Node(-1, 0, 0, 0, 0.0, 0)], {0}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(_bin(i)).alias("b")) for i in range(features)]))
    for _ in range(depth):
        node = _expression(tree, leaf=lambda n, _: F.lit(n))
        counts: dict[int, dict] = {}
        per = rows.select(node.alias("_node"), (F.col("_y") < F.col("_p")).cast("long").alias("_u"), pairs.alias("_x")).where(F.col("_node").isin(sorted(open_)))
        for r in per.groupBy("_node", "_x.f", "_x.b").agg(F.count("*").alias("n"), F.sum("_u").alias("u")).collect():
            counts.setdefault(r["_node"], {})[r["f"], r["b"]] = (r["n"], r["u"])
        new = set()
        for n, own in sorted(counts.items()):
            cover = sum(k for (f, _), (k, _) in own.items() if f == 0)
            tree[n] = tree[n]._replace(cover=cover)
            split = _best_split(own, features, share, least)
            if split:
                _, f, edge = split
                left = sum(k for (g, b), (k, _) in own.items() if g == f and b <= edge)
                tree[n] = Node(f, edge, len(tree), len(tree) + 1, 0.0, cover)
                new |= {len(tree), len(tree) + 1}
                tree += [Node(-1, 0, 0, 0, 0.0, left), Node(-1, 0, 0, 0, 0.0, cover - left)]
        open_ = new
        if not open_:
            break
    return tree


def pinball(actual: Column, predicted: Column, share: float) -> Column:
    d = actual - predicted
    return F.greatest(share * d, (share - 1) * d)


def fit(
    train: DataFrame, target: str, numbers: Sequence[str], categories: Sequence[str], share: float = 0.5, rounds: int = 50, depth: int = 4, rate: float = 0.1,
    least: int = 20, bins: int = 64, validation: DataFrame | None = None, patience: int = 5,
) -> Boosted:
    """Trees for the ``share`` quantile of ``target``. With ``validation`` rows, rounds end after ``patience`` ones without a smaller pinball loss there, and the trees up to the best round stay.

    Rows with a null target are left out. Missing numbers and levels have a bin of their own. Without rows the model is the constant 0.
    """
    known = train.where(F.col(target).isNotNull())
    edges = dict(zip(numbers, ([] if not numbers else [sorted(set(e)) for e in known.select(*[F.col(c).cast("double").alias(c) for c in numbers]).approxQuantile(list(numbers), [i / bins for i in range(1, bins)], 0.25 / bins)]), strict=True))
    targets = slice_edges(known.select(F.col(target).cast("double").alias("_t")), "_t")
    levels = {c: _levels(known, c, target, targets) for c in categories}
    columns = [_bin(i) for i in range(len(edges) + len(levels))]
    prepare = lambda df: binned(df.where(F.col(target).isNotNull()), edges, levels).select(F.col(target).cast("double").alias("_y"), *columns)
    rows = cut(prepare(train), "boosting-bins")
    first = exact_quantiles(rows, "_y", [share], edges=targets).first()
    base = first["q0"] if first else 0.0
    rows = rows.withColumn("_p", F.lit(base))
    checked = None if validation is None else cut(prepare(validation), "boosting-validation").withColumn("_p", F.lit(base))
    trees, losses = [], []
    for _ in range(rounds if first else 0):
        tree = _grown(rows, len(columns), share, depth, least)
        if len(tree) == 1:
            break
        leaf = _expression(tree, leaf=lambda n, _: F.lit(n))
        values = {r["_leaf"]: r["q0"] for r in exact_quantiles(rows.select(leaf.alias("_leaf"), (F.col("_y") - F.col("_p")).alias("_r")), "_r", [share], ["_leaf"]).collect()}
        tree = [n._replace(value=rate * values.get(i, 0.0)) if n.feature < 0 else n for i, n in enumerate(tree)]
        trees.append(tree)
        rows = cut(rows.withColumn("_p", F.col("_p") + _expression(tree)), "boosting-round")
        if checked is not None:
            checked = cut(checked.withColumn("_p", F.col("_p") + _expression(tree)), "boosting-checked")
            losses.append(checked.agg(F.avg(pinball(F.col("_y"), F.col("_p"), share))).first()[0])
            if None in losses:  # no validation row
                losses, checked = [], None
            elif len(losses) - 1 - losses.index(min(losses)) >= patience:
                break
    if losses:
        trees = trees[: losses.index(min(losses)) + 1]
    return Boosted(share, base, edges, levels, trees, losses)


def predict(model: Boosted, df: DataFrame, name: str = "predicted") -> DataFrame:
    total = reduce(lambda a, b: a + b, map(_expression, model.trees), F.lit(model.base))
    return binned(df, model.numbers, model.categories).withColumn(name, total).drop(*[_bin(i) for i in range(len(model.features))])


def staged(model: Boosted, df: DataFrame, counts: Sequence[int], name: str = "predicted") -> DataFrame:
    """Each row once for each of ``counts``, with ``n_trees`` and the prediction of so many first trees: a learning curve is an aggregate by n_trees.

    Every tree is evaluated once; counts beyond the model's trees take all of them.
    """
    values = F.array(*map(_expression, model.trees)) if model.trees else F.array().cast("array<double>")
    out = binned(df, model.numbers, model.categories).withColumn("_values", values).withColumn("n_trees", F.explode(F.array(*map(F.lit, sorted(set(counts))))))
    total = F.aggregate(F.slice("_values", 1, F.col("n_trees")), F.lit(model.base), lambda a, x: a + x)
    return out.withColumn(name, total).drop("_values", *[_bin(i) for i in range(len(model.features))])


def _paths(tree: Sequence[Node]):
    """Of each leaf: its value, and for each feature on its way the bins that lead there (low, high] and the share of training rows that go that way."""
    out = []

    def walk(at: int, ranges: dict, shares: dict) -> None:
        node = tree[at]
        if node.feature < 0:
            out.append((node.value, ranges, shares))
            return
        for child, low, high in ((node.left, -1, node.edge), (node.right, node.edge, 1 << 30)):
            a, b = ranges.get(node.feature, (-1, 1 << 30))
            part = tree[child].cover / node.cover if node.cover else 0.5
            walk(child, ranges | {node.feature: (max(a, low), min(b, high))}, shares | {node.feature: shares.get(node.feature, 1.0) * part})

    walk(0, {}, {})
    return out


def tree_contributions(tree: Sequence[Node], bins):
    """Base and contribution of each feature for rows of bins (numpy, rows x features): Shapley values of the tree's path-dependent expectation.

    For one leaf the game is a product over its features, of 1 or 0 for a known feature (the row goes that way or not) and the training share for an unknown
    one, so sums over subsets are the coefficients of a polynomial.
    """
    import math

    import numpy as np

    out, base = np.zeros(bins.shape), 0.0
    for value, ranges, shares in _paths(tree):
        features = list(ranges)
        d = len(features)
        base += value * math.prod(shares.values())
        goes = {f: ((bins[:, f] > ranges[f][0]) & (bins[:, f] <= ranges[f][1])).astype(float) for f in features}
        for f in features:
            poly = [np.ones(len(bins))]  # by the number of known features among the others
            for g in features:
                if g != f:
                    poly = [(poly[k] * shares[g] if k < len(poly) else 0) + (poly[k - 1] * goes[g] if k else 0) for k in range(len(poly) + 1)]
            weight = sum(p * (math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)) for k, p in enumerate(poly))
            out[:, f] += value * weight * (goes[f] - shares[f])
    return base, out


def contributions(model: Boosted, df: DataFrame) -> DataFrame:
    """``df`` with ``base`` and ``contribution_<feature>``, which sum to the prediction. All trees in one pass over Arrow batches."""
    names = [f"contribution_{f}" for f in model.features]
    prepared = binned(df, model.numbers, model.categories)
    columns, trees, first = df.columns, model.trees, model.base
    bins = [_bin(i) for i in range(len(names))]
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("base", T.DoubleType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in bins], axis=1) if bins else np.zeros((b.num_rows, 0))
            base, total = first, np.zeros(rows.shape)
            for tree in trees:
                part, own = tree_contributions(tree, rows)
                base, total = base + part, total + own
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(np.full(len(rows), base)), *(pa.array(total[:, i]) for i in range(len(names)))], names=[*columns, "base", *names])

    return prepared.mapInArrow(run, schema)
