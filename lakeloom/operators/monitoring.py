"""Windows over an append-only log: count windows, late labels, drift, market baseline and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.expressions import alert_ceiling, coverage_floor
from lakeloom.functions.probability import chi2_p, ks_p
from lakeloom.operators.running import in_slices, running_sums, slice_edges

#: Slices of a log, each of which has a row in the task that puts them in order.
SLICES = 512


def count_windows(log: DataFrame, seq: str, version: str, size: int) -> DataFrame:
    """The log with ``run`` and ``window``: windows of ``size`` rows in order of ``seq``, closed early where the version changes.

    Runs and places in them follow from the log cut into at most SLICES slices at approximate quantiles of ``seq``: each slice is summarised
    (first and last version, changes inside, rows since the last change), the summaries are put in order, and
    what came before a slice is handed to its rows. Only summaries meet in one task, so the log isn't sorted in one place.
    """
    edges = slice_edges(log, seq, SLICES)
    sliced = in_slices(log, seq, edges, "_slice")
    inside = Window.partitionBy("_slice").orderBy(seq)
    sliced = sliced.withColumn("_change", F.coalesce((F.col(version) != F.lag(version).over(inside)).cast("long"), F.lit(0)))
    sliced = sliced.withColumn("_changes", F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sliced = sliced.withColumn("_place", F.row_number().over(Window.partitionBy("_slice", "_changes").orderBy(seq)))
    summary = sliced.groupBy("_slice").agg(
        F.min_by(version, seq).alias("_first"), F.max_by(version, seq).alias("_last"), F.max("_changes").alias("_inner"), F.max_by("_place", seq).alias("_tail"), F.count("*").alias("_n"),
    )
    by = Window.orderBy("_slice")  # one row for each slice
    summary = summary.withColumn("_cut", F.coalesce((F.col("_first") != F.lag("_last").over(by)).cast("long"), F.lit(0)))
    summary = summary.withColumn("_before", F.coalesce(F.sum(F.col("_inner") + F.col("_cut")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_cut"))
    # Rows that a slice's first run had already: those of all slices since the run began.
    summary = summary.withColumn("_group", F.sum(F.col("_cut") + (F.coalesce(F.lag("_inner").over(by), F.lit(0)) > 0).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    held = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.when(F.col("_cut") == 0, F.lag("_tail").over(by))
    summary = summary.withColumn("_open", F.first(F.coalesce(F.when(F.coalesce(F.lag("_inner").over(by), F.lit(0)) > 0, previous), F.lit(0))).over(Window.partitionBy("_group").orderBy("_slice")))
    summary = summary.withColumn("_had", F.coalesce(F.sum("_n").over(held), F.lit(0)) + F.col("_open"))
    out = sliced.join(summary.select("_slice", "_before", "_had"), "_slice")
    place = F.col("_place") + F.when(F.col("_changes") == 0, F.col("_had")).otherwise(0)
    return out.withColumn("run", F.col("_before") + F.col("_changes")).withColumn("window", F.floor((place - 1) / size)).drop("_slice", "_change", "_changes", "_place", "_before", "_had")


def window_states(windowed: DataFrame, seq: str, size: int) -> DataFrame:
    """first_seq, last_seq, rows and state of each window: tested if full, open if it is the last and isn't, else partial."""
    w = windowed.groupBy("run", "window").agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count("*").alias("rows"))
    last = F.max("last_seq").over(Window.partitionBy(F.lit(1)))  # one row for each window
    return w.withColumn("state", F.when(F.col("rows") == size, "tested").when(F.col("last_seq") == last, "open").otherwise("partial"))


def label_requests(log: DataFrame, labels: DataFrame, key: str, horizon_days: int | None = None, answered: str = "answered_at", received: str = "received_at") -> DataFrame:
    """Requests with their label; labels that came after the horizon don't count."""
    out = log.join(labels, key)
    return out if horizon_days is None else out.where(F.col(received) <= F.col(answered) + F.expr(f"interval {horizon_days} days"))


def window_performance(labelled: DataFrame, observed: str, predicted: str, inside: Column, by: Sequence[str] = ("run", "window"), least_labels: int = 200, least_ranges: int = 300) -> DataFrame:
    """Median error and coverage of each window; null with status ``insufficient_labels`` where labels are too few."""
    e = F.abs(F.col(observed) - F.col(predicted)) / F.col(observed)
    g = labelled.groupBy(*by).agg(F.count("*").alias("labels"), F.median(e).alias("m"), F.avg(inside.cast("double")).alias("c"), F.count(inside).alias("ranges"))
    return g.select(
        *by, "labels", F.when(F.col("labels") >= least_labels, F.round("m", 6)).alias("mdape"), F.when(F.col("ranges") >= least_ranges, F.round("c", 6)).alias("coverage"),
        F.when(F.col("labels") >= least_labels, "ok").otherwise("insufficient_labels").alias("status"),
    )


def market_baseline(shares: DataFrame, tested: DataFrame, overall: tuple[float, int], by: str, group: str, least: int = 500) -> DataFrame:
    """The error to expect from a window's mix of groups, and the sample size behind it.

    ``shares``: window, group, n. A group tested on fewer than ``least`` rows stands with the overall value.
    """
    t = tested.where(F.col("rows") >= least).select(F.col(group).alias("_g"), F.col("mdape").alias("_m"), F.col("rows").alias("_r"))
    w = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    j = shares.withColumn("w", w).join(t, F.col(group) == F.col("_g"), "left")
    m, r = F.coalesce("_m", F.lit(overall[0])), F.coalesce("_r", F.lit(overall[1]))
    return j.groupBy(by).agg(F.round(F.sum(F.col("w") * m), 6).alias("baseline"), F.round(1 / F.sum(F.col("w") * F.col("w") / r), 4).alias("effective_rows"))


def ks_statistic(df: DataFrame, value: str, first: Column, second: Column, by: Sequence[str] = ()) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between the rows of two predicates, with n, m and p.

    Rows are counted by value first; the cumulative counts are running sums over slices of the values.
    """
    both = df.where(F.col(value).isNotNull()).where(first | second)
    per = both.groupBy(*by, F.col(value).alias("_v")).agg(F.sum(first.cast("long")).alias("a"), F.sum(second.cast("long")).alias("b"))
    sizes = per.groupBy(*by).agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    c = running_sums(per, "_v", {"ca": "a", "cb": "b"}, by)
    c = c.join(sizes, list(by)) if by else c.crossJoin(F.broadcast(sizes))
    d = F.abs(F.col("ca") / F.nullif(F.col("n"), F.lit(0)) - F.col("cb") / F.nullif(F.col("m"), F.lit(0)))
    out = c.groupBy(*by).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.coalesce(F.max(d), F.lit(0.0)).alias("statistic"))
    return out.withColumn("p", ks_p("statistic", "n", "m"))


def chi2_statistic(df: DataFrame, category: str, first: Column, second: Column, by: Sequence[str] = ()) -> DataFrame:
    """Chi-square of homogeneity of a category between the rows of two predicates, with degrees of freedom and p."""
    per = df.where(F.col(category).isNotNull()).groupBy(*by, category).agg(F.sum(first.cast("long")).alias("a"), F.sum(second.cast("long")).alias("b")).where("a + b > 0")
    w = Window.partitionBy(*by, *([] if by else [F.lit(1)]))  # one row for each category
    t = per.withColumn("n", F.sum("a").over(w)).withColumn("m", F.sum("b").over(w))
    total = F.col("n") + F.col("m")
    ea, eb = (F.col("a") + F.col("b")) * F.col("n") / total, (F.col("a") + F.col("b")) * F.col("m") / total
    part = F.coalesce((F.col("a") - ea) * (F.col("a") - ea) / F.nullif(ea, F.lit(0.0)), F.lit(0.0)) + F.coalesce((F.col("b") - eb) * (F.col("b") - eb) / F.nullif(eb, F.lit(0.0)), F.lit(0.0))
    out = t.groupBy(*by).agg(F.count("*").alias("categories"), F.sum(part).alias("statistic"), F.max(total).alias("total"))
    out = out.withColumn("degrees", F.col("categories") - 1)
    return out.withColumn("p", chi2_p("statistic", "degrees")).withColumn("cramers_v", F.sqrt(F.col("statistic") / F.col("total"))).drop("total")


def drift_verdicts(tests: DataFrame, alpha: float = 0.005) -> DataFrame:
    """Bonferroni verdicts: a feature drifts if its p is under alpha over the number of features of its window."""
    return tests.withColumn("drifted", F.col("p") < alpha / F.count("*").over(Window.partitionBy("window")))


def alert_thresholds(windows: DataFrame, p: float = 0.9) -> DataFrame:
    """ceiling and floor of a window (columns labels, effective_rows, ranges), and whether its figures break them."""
    ceiling, floor = alert_ceiling(F.col("labels"), F.col("effective_rows")), coverage_floor(F.lit(p), F.col("ranges"))
    return windows.withColumn("ceiling", F.round(ceiling, 6)).withColumn("floor", F.round(floor, 6)).withColumn("error_alert", F.col("mdape") > ceiling * F.col("baseline")).withColumn("coverage_alert", F.col("coverage") < floor)


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Cumulative counts up to each edge, and all rows under ``+Inf``."""
    wide = df.agg(*[F.sum((F.col(value) <= e).cast("long")).alias(f"b{i}") for i, e in enumerate(edges)], F.count(value).alias("all"))
    rows = [F.struct(F.lit(f"{e:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def nearest_rank(df: DataFrame, value: str, shares: Sequence[float], by: str) -> DataFrame:
    """Nearest-rank percentiles from a histogram: the smallest value whose cumulative count reaches the share."""
    counts = df.groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    c = counts.withColumn("cum", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    return c.groupBy(by).agg(*[F.min(F.when(F.col("cum") >= F.ceil(F.lit(s) * F.col("total")), F.col("v"))).alias(f"p{round(100 * s)}") for s in shares])


def ratio_windows(df: DataFrame, ts: str, bad: Column, minutes: int, least: int = 20, limit: float = 0.01) -> DataFrame:
    """Share of bad events in tumbling windows with enough events, and whether it is over the limit."""
    g = df.groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("events"), F.sum(bad.cast("long")).alias("bad"))
    return g.where(F.col("events") >= least).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "bad", F.round(F.col("bad") / F.col("events"), 6).alias("ratio"), (F.col("bad") / F.col("events") > limit).alias("alert"))


def level_share(windowed: DataFrame, column: str, level: str, by: Sequence[str] = ("run", "window")) -> DataFrame:
    """The share of a level in each window; null rows count in the total."""
    return windowed.groupBy(*by).agg(F.round(F.avg(F.coalesce((F.col(column) == level).cast("double"), F.lit(0.0))), 6).alias("share"))


def pooled(windowed: DataFrame, metrics: Sequence[Column], by: Sequence[str] = ("run", "window")) -> DataFrame:
    """The metrics of each window, and of all windows together under null keys."""
    return windowed.groupingSets([list(by), []], *by).agg(*metrics).select(*by, *[m for m in windowed.groupBy(*by).agg(*metrics).columns if m not in by])


def quantile_over(df: DataFrame, ts: str, value: str, minutes: int, limit: float, share: float = 0.05, least: int = 20) -> DataFrame:
    """Tumbling windows with at least ``least`` values: how many lie above the limit, and whether that is over the share, which says that the (1 - share) quantile is above it."""
    g = df.where(F.col(value).isNotNull()).groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("events"), F.sum((F.col(value) > limit).cast("long")).alias("above"))
    return g.where(F.col("events") >= least).select(F.col("w.start").alias("start"), "events", "above", (F.col("above") > share * F.col("events")).alias("alert"))
