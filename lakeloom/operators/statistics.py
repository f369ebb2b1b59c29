"""Weighted statistics, cluster bootstraps and conformal ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.lineage import cut
from lakeloom.operators.running import running_sums


def weighted(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Weighted mean, and the median of each value repeated ``weight`` times."""
    return df.groupBy(*by).agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias("mean"), F.round(F.percentile(value, 0.5, F.col(weight).cast("long")), 6).alias("median"))


#: Draws that one digest gives weights for: 52 bits each.
PER_DIGEST = 4


def poisson_weight(seed: str, key: Column, draw: Column) -> Column:
    """A Poisson(1) draw, from 0 to 12, that depends on the seed, the key and the number of the draw (from 0) alone.

    The digest of ``seed|key|draw div 4`` (SHA-256) holds the uniform numbers of four draws, 13 hexadecimal digits each.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string"), F.floor(draw / PER_DIGEST).cast("string")), 256)
    u = F.conv(F.substring(digest, F.lit(1) + (draw % PER_DIGEST) * 13, F.lit(13)), 16, 10).cast("long") / float(1 << 52)
    return poisson_of(u)


def poisson_edges() -> list[float]:
    """The probabilities of at most 0, 1, ..., 11 of a Poisson(1) number."""
    total, p, edges = 0.0, math.exp(-1), []
    for k in range(12):
        total += p
        edges.append(total)
        p /= k + 1
    return edges


def poisson_of(u: Column) -> Column:
    out = F.lit(12)
    for k, edge in reversed(list(enumerate(poisson_edges()))):
        out = F.when(u < edge, k).otherwise(out)
    return out


def bootstrap_draws(df: DataFrame, group: str, values: dict[str, Column], draws: int, seed: str) -> DataFrame:
    """draw and the weighted mean of each of ``values`` when whole groups are drawn again.

    Groups are summed once. Each group's weight in each draw is made once and shared by all values, so differences of values have their noise in common.
    Rows where any value is null are left out, as pairs must be whole; null groups are one group.
    """
    whole = df.select(F.col(group).alias("_g"), *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(values.values())]).dropna(subset=[f"_v{i}" for i in range(len(values))])
    sums = whole.groupBy("_g").agg(F.count("*").alias("_n"), *[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(values))])
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_w", poisson_weight(seed, F.coalesce(F.col("_g").cast("string"), F.lit("")), F.col("draw")))
    n = F.nullif(F.sum(F.col("_w") * F.col("_n")), F.lit(0))
    return drawn.groupBy("draw").agg(*[(F.sum(F.col("_w") * F.col(f"_s{i}")) / n).alias(name) for i, name in enumerate(values)])


def cluster_bootstrap(df: DataFrame, group: str, difference: str, draws: int, seed: str, confidence: float = 0.95) -> DataFrame:
    """Interval of a mean when whole groups are drawn again: Poisson weights by group and draw."""
    stats = bootstrap_draws(df, group, {"x": F.col(difference)}, draws, seed)
    a = (1 - confidence) / 2
    whole = df.agg(F.avg(difference).alias("estimate"))
    return stats.agg(F.percentile("x", a).alias("lower"), F.percentile("x", 1 - a).alias("upper"), F.stddev_samp("x").alias("std_error")).join(F.broadcast(whole))


def paired_comparisons(df: DataFrame, group: str, values: dict[str, Column], reference: str, draws: int, seed: str, confidence: float = 0.95) -> DataFrame:
    """A row for each candidate of ``values`` but the reference: how its mean differs from the reference's, alone and jointly.

    ``lower`` and ``upper`` are the percentiles of its own differences. For the joint interval each candidate's difference is studentised by its spread over the draws;
    the ``confidence`` percentile of a draw's largest deviation over all candidates is the multiplier. ``joint_lower`` and ``joint_upper`` hold for all
    candidates together, and ``better`` says that the joint interval lies under zero. A candidate that never differs deviates by nothing. No candidate: no rows.
    """
    others = [k for k in values if k != reference]
    melt = lambda frame: frame.select(*[c for c in frame.columns if c == "draw"], F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), (F.col(k) - F.col(reference)).alias("d")) for k in others])).alias("_x")).select(*[c for c in frame.columns if c == "draw"], "_x.*")
    if not others:
        return df.sparkSession.createDataFrame([], "candidate string, difference double, lower double, upper double, share_better double, multiplier double, joint_lower double, joint_upper double, better boolean")
    df = cut(df.select(F.col(group).alias("_group"), *[c.cast("double").alias(k) for k, c in values.items()]), "paired-rows")
    # A row for each draw, read three times: the draws are made once.
    per_draw = cut(bootstrap_draws(df, "_group", {k: F.col(k) for k in values}, draws, seed), "paired-draws")
    whole = df.select(*values).dropna().agg(*[F.avg(k).alias(k) for k in values])
    observed = melt(whole).withColumnRenamed("d", "difference")  # one row for each candidate
    differences = melt(per_draw).join(F.broadcast(observed), "candidate")  # draws times candidates
    a = (1 - confidence) / 2
    each = differences.groupBy("candidate").agg(
        F.first("difference").alias("difference"), F.percentile("d", a).alias("lower"), F.percentile("d", 1 - a).alias("upper"), F.avg((F.col("d") < 0).cast("double")).alias("share_better"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("_spread"),
    )
    deviation = F.when(F.col("_spread") > 0, F.abs(F.col("d") - F.col("difference")) / F.col("_spread")).otherwise(0.0)
    largest = differences.join(F.broadcast(each.select("candidate", "_spread")), "candidate").groupBy("draw").agg(F.max(deviation).alias("_m"))
    multiplier = largest.agg(F.percentile("_m", confidence).alias("multiplier"))
    half = F.col("multiplier") * F.col("_spread")
    out = each.join(F.broadcast(multiplier)).withColumns({"joint_lower": F.col("difference") - half, "joint_upper": F.col("difference") + half})
    return out.select("candidate", "difference", "lower", "upper", "share_better", "multiplier", "joint_lower", "joint_upper", (F.col("joint_upper") < 0).alias("better"))


def conformal_offsets(calibration: DataFrame, actual: str, lower: str, upper: str, level: float = 0.9) -> DataFrame:
    """One offset for each side: with n scores of a side, the ceil((n + 1)(1 - (1 - level) / 2))-th smallest (the largest if there are fewer).

    Scores are how far actual values lie beyond the uncalibrated range (Romano et al., 2019). They are
    counted by value before they are ranked.
    """
    scores = calibration.select(F.explode(F.array(F.struct(F.lit("lower").alias("side"), (F.col(lower) - F.col(actual)).alias("score")), F.struct(F.lit("upper").alias("side"), (F.col(actual) - F.col(upper)).alias("score")))).alias("s")).select("s.*").where("score is not null")
    counts = scores.groupBy("side", "score").agg(F.count("*").alias("k"))
    sizes = counts.groupBy("side").agg(F.sum("k").alias("n"))  # two rows
    c = running_sums(counts, "score", {"cum": "k"}, ["side"]).join(F.broadcast(sizes), "side")
    need = F.least(F.ceil((F.col("n") + 1) * F.lit(1 - (1 - level) / 2)), F.col("n"))
    return c.groupBy("side").agg(F.max("n").alias("n"), F.min(F.when(F.col("cum") >= need, F.col("score"))).alias("offset"))


def range_by_class(train: DataFrame, value: str, keys: list[str], level: float = 0.9) -> DataFrame:
    """Lower, middle and upper quantiles of each class: an uncalibrated range."""
    a = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(a), F.lit(0.5), F.lit(1 - a)))
    return train.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("lower"), F.col("q")[1].alias("typical"), F.col("q")[2].alias("upper"))


def blanked_copies(df: DataFrame, key: list[str], fields: list[str], seed: str) -> DataFrame:
    """The rows, each also with all optional fields blank (``all``) and with a random part of them blank (``random``).

    How many fields a row loses is uniform from 1, and which ones follows from hashes of the row's key.
    """
    size = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(len(fields))) + 1
    rank = {f: F.xxhash64(F.lit(f"{seed}|{f}"), *key) for f in fields}
    copies = df.withColumn("copy", F.explode(F.array(F.lit("full"), F.lit("all"), F.lit("random"))))
    order = F.array_sort(F.array(*rank.values()))
    cut = F.element_at(order, size.cast("int"))
    return copies.select(*[F.when((F.col("copy") == "full") | ((F.col("copy") == "random") & (rank[c] > cut)), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns], "copy")


def histogram_2d(df: DataFrame, row: str, column: str, weight: str) -> DataFrame:
    """Rows and summed weight of each pair of a row's and a column's class, with the shares of the weight in its row and in all. Null classes are classes; null weights count nothing."""
    cells = df.groupBy(row, column).agg(F.count("*").alias("rows"), F.coalesce(F.sum(weight), F.lit(0.0)).alias("weight"))
    all_of = F.sum("weight").over(Window.partitionBy(F.lit(1)))  # one row for each cell
    return cells.withColumns({"row_share": F.col("weight") / F.nullif(F.sum("weight").over(Window.partitionBy(row)), F.lit(0.0)), "share": F.col("weight") / F.nullif(all_of, F.lit(0.0))})
