"""Nearest rows of one make (and model) within bands of two measures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.lineage import cut


#: Index rows of one cell that one task searches; cells with more are dealt out in slices.
CELL = 100_000
#: Rounds of neighbouring mileages after which what is left of a query is compared row by row.
ROUNDS = 64
#: Queries that are searched together.
TOGETHER = 20_000
#: Slot of a missing measure.
MISSING = -(1 << 62)


def _first_not_below(values, low, high, wanted):
    """For each wanted value the first place in [low, high) of the rising ``values`` that isn't below it, else ``high``."""
    import numpy as np

    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        below = open_ & (values[np.minimum(middle, len(values) - 1)] < wanted)
        low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
    return low


def _closest(rows, queries, k: int, age_band: float, mileage_share: float, rounds: int = ROUNDS):
    """(query, row) pairs: of each query its k first rows by distance in mileage, then age, then id.

    ``rows``: group, mileage, age and place in the order of ids; ``queries``: group, mileage and age (numpy). Rows are sorted by group, mileage and age. A query goes from its own
    mileage outwards, mileage by mileage, all queries at once, and takes the nearest ages of each on both sides until it has k rows or leaves its band.
    """
    import numpy as np

    order = np.lexsort(rows[::-1][:1] + rows[2:0:-1] + rows[:1])
    g, m, a, r = (x[order] for x in rows)
    changed = lambda *xs: np.concatenate([[True], np.any([x[1:] != x[:-1] for x in xs], axis=0)])
    place = np.arange(len(g))
    kept = place - np.maximum.accumulate(np.where(changed(g, m, a), place, 0)) < k  # of equal rows only the k smallest ids
    order, g, m, a, r = order[kept], g[kept], m[kept], a[kept], r[kept]
    start = np.flatnonzero(changed(g, m))
    end, sg, sm = np.append(start[1:], len(g)), g[start], m[start]
    near = np.arange(1 - 2 * k, k)  # k equal ages may begin k - 1 rows before the k-th one
    found = []
    for begin in range(0, len(queries[0]), TOGETHER):
        qg, qm, qa = (x[begin : begin + TOGETHER] for x in queries)
        first, last = np.searchsorted(sg, qg, "left"), np.searchsorted(sg, qg, "right")
        up = _first_not_below(sm, first, last, qm)
        down, band, have = up - 1, mileage_share * qm, np.zeros(len(qg), dtype=np.int64)
        pairs, live = [], np.arange(len(qg))
        distances = lambda x: (np.where(down[x] >= first[x], qm[x] - sm[np.maximum(down[x], 0)], np.inf), np.where(up[x] < last[x], sm[np.minimum(up[x], len(sm) - 1)] - qm[x], np.inf))  # noqa: B023, E731
        for _ in range(rounds):
            under, over = distances(live)
            nearer = np.minimum(under, over)
            going = (have[live] < k) & (nearer <= band[live])
            live, under, over, nearer = live[going], under[going], over[going], nearer[going]
            if not len(live):
                break
            lower, upper = live[under == nearer], live[over == nearer]
            q, s = np.concatenate([lower, upper]), np.concatenate([down[lower], up[upper]])
            at = _first_not_below(a, start[s], end[s], qa[q])[:, None] + near
            inside = (at >= start[s][:, None]) & (at < end[s][:, None])
            inside &= np.abs(a[np.clip(at, 0, len(a) - 1)] - qa[q][:, None]) <= age_band
            np.add.at(have, q, inside.sum(axis=1))
            pairs.append((np.repeat(q, inside.sum(axis=1)), at[inside]))
            down[lower] -= 1
            up[upper] += 1
        else:
            for q in live[have[live] < k]:
                spans = [np.arange(start[x], end[y - 1]) for x, y in ((first[q], down[q] + 1), (up[q], last[q])) if x < y]
                rest = np.concatenate([np.zeros(0, dtype=np.int64), *spans])
                rest = rest[(np.abs(m[rest] - qm[q]) <= band[q]) & (np.abs(a[rest] - qa[q]) <= age_band)]
                rest = rest[np.lexsort((r[rest], np.abs(a[rest] - qa[q]), np.abs(m[rest] - qm[q])))[:k]]
                pairs.append((np.full(len(rest), q), rest))
        if pairs:
            q, x = (np.concatenate(p) for p in zip(*pairs, strict=True))
            by = np.lexsort((r[x], np.abs(a[x] - qa[q]), np.abs(m[x] - qm[q]), q))
            q, x = q[by], x[by]
            place = np.arange(len(q))
            kept = place - np.maximum.accumulate(np.where(changed(q), place, 0)) < k if len(q) else place
            found.append((q[kept] + begin, order[x[kept]]))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2


def _in_cell(k: int, age_band: float, mileage_share: float, id_type: str, query_type: str):
    """The search of one slice of a cell, on Arrow tables of its queries and rows: query_id, id and both distances of up to k rows of each query."""

    def run(queries, rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        queries, rows = queries.combine_chunks(), rows.combine_chunks()
        numbers = lambda t, c: t.column(c).cast(pa.float64()).to_numpy()
        levels = pc.unique(rows.column("model")).drop_null()
        of = lambda t: pc.fill_null(pc.index_in(t.column("model"), levels), -1).to_numpy().astype(np.int64)
        own, place = of(rows), pc.rank(rows.column("id"), tiebreaker="dense").to_numpy().astype(np.int64)
        own_mileage, own_age, own_of = numbers(rows, "mileage"), numbers(rows, "age"), of(queries)
        mileage, age, any_model = numbers(queries, "mileage"), numbers(queries, "age"), pc.is_null(queries.column("model")).to_numpy()
        out = []
        for modelled in (False, True):
            for aged, priced in ((True, True), (True, False), (False, True)):
                # A model that no row has stays out; so do rows without a model where the query has one.
                q = np.flatnonzero((any_model != modelled) & (~np.isnan(age) == aged) & (~np.isnan(mileage) == priced) & (~np.array(modelled) | (own_of >= 0)))
                x = np.flatnonzero(own >= 0) if modelled else np.arange(len(own))
                if not len(q) or not len(x):
                    continue
                # A measure that the query lacks is equal for all.
                m, a = own_mileage[x] if priced else np.zeros(len(x)), own_age[x] if aged else np.zeros(len(x))
                qm, qa = mileage[q] if priced else np.zeros(len(q)), age[q] if aged else np.zeros(len(q))
                i, j = _closest((own[x] if modelled else np.zeros(len(x), dtype=np.int64), m, a, place[x]), (own_of[q] if modelled else np.zeros(len(q), dtype=np.int64), qm, qa), k, age_band, mileage_share)
                out.append((q[i], x[j], np.abs(m[j] - qm[i]), np.abs(a[j] - qa[i])))
        i, j, dm, da = (np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 4
        return pa.table({"query_id": queries.column("query_id").take(pa.array(i)), "id": rows.column("id").take(pa.array(j)), "_dm": pa.array(dm, pa.float64()), "_da": pa.array(da, pa.float64())})

    return run, f"query_id {query_type}, id {id_type}, _dm double, _da double"


def nearest(queries: DataFrame, index: DataFrame, k: int = 5, age_band: float = 2.0, mileage_share: float = 0.25) -> DataFrame:
    """The k nearest rows of ``index`` (id, make, model, age, mileage) to each query (query_id, make, model, age, mileage).

    A row qualifies if its make is the query's, its model too where the query has one, and its age and mileage
    lie within the bands where the query has them. Nearest by mileage, then age, then id. Index rows lie in cells of their make, the
    band-wide slot of their age and a slot of the logarithm of their mileage (the band is a share of it); large cells are dealt out in slices by a hash of the id. A query meets the
    cells that its bands touch, and each slice searches sorted rows outwards from its queries, so no pairs are made beyond what a query keeps. Queries with neither measure take the
    smallest ids of their make or model, which are found once. ``index`` is read several times.
    """
    width, slack = math.log((1 + mileage_share) / (1 - mileage_share)), 1e-9  # of a slot, for rounding at its edges
    age_at, mileage_at = lambda c: c / age_band, lambda c: F.log(F.greatest(c, F.lit(1.0))) / width
    slot = lambda c: F.floor(c).cast("long")
    r = index.where("make is not null").select("id", "make", "model", F.col("age").cast("double").alias("age"), F.col("mileage").cast("double").alias("mileage"))
    age, mileage, missing = F.col("age"), F.col("mileage"), F.lit(MISSING)
    rows = r.withColumn("_a", F.coalesce(slot(age_at(age)), missing)).withColumn("_m", F.coalesce(slot(mileage_at(mileage)), missing))
    keys = ["make", "_a", "_m"]
    # One row for each cell.
    cells = cut(rows.groupBy(*keys).agg(F.ceil(F.count("*") / CELL).alias("_slices")), "nearest-cells")
    sliced = rows.join(cells, keys).withColumn("_slice", F.pmod(F.xxhash64("id"), F.col("_slices"))).drop("_slices")
    wanted = queries.select("query_id", F.col("make").alias("_make"), "model", age.cast("double").alias("age"), mileage.cast("double").alias("mileage"))
    # A negative mileage has no band.
    wanted = wanted.where((age.isNotNull() | mileage.isNotNull()) & (mileage.isNull() | (mileage >= 0)))
    in_age = age.isNull() | F.col("_a").between(slot(age_at(age - age_band) - slack), slot(age_at(age + age_band) + slack))
    in_mileage = mileage.isNull() | F.col("_m").between(slot(mileage_at(mileage * (1 - mileage_share)) - slack), slot(mileage_at(mileage * (1 + mileage_share)) + slack))
    met = wanted.join(cells, (F.col("_make") == F.col("make")) & in_age & in_mileage).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)))
    met = met.select("query_id", "model", "age", "mileage", *keys, "_slice")
    run, schema = _in_cell(k, age_band, mileage_share, r.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString())
    near = met.groupBy(*keys, "_slice").cogroup(sliced.groupBy(*keys, "_slice")).applyInArrow(run, schema)
    first = Window.partitionBy("_make", "_of").orderBy("id")
    # Under its model, and under a null for queries by make alone.
    numbered = lambda df: df.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).select("id", "_make", "_of")
    named = r.withColumn("_make", F.col("make"))
    least = numbered(named.where("model is not null").withColumn("_of", F.col("model"))).unionByName(numbered(named.withColumn("_of", F.lit(None).cast("string"))))
    free = queries.where(age.isNull() & mileage.isNull()).join(least, (F.col("make") == F.col("_make")) & F.col("model").eqNullSafe(F.col("_of")))
    near = near.unionByName(free.select("query_id", "id", F.lit(0.0).alias("_dm"), F.lit(0.0).alias("_da")))
    by = Window.partitionBy("query_id").orderBy("_dm", "_da", "id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id")


def has_model(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (make, model) pairs that the index has."""
    return wanted.join(index.select("make", "model").distinct(), ["make", "model"], "left_semi")


def models_by_make(left: DataFrame, right: DataFrame) -> DataFrame:
    """Models of each make known to both sides, in case-insensitive order, joined by commas."""
    both = left.select("make", "model").distinct().join(right.select("make", "model").distinct(), ["make", "model"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct(F.lower("model").alias("l"), F.col("model").alias("m"))))
    return both.groupBy("make").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda s: s["m"]), ",").alias("models"))
