"""Connected components of a large graph by alternating star operations (Kiveris et al., 2014), and links inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.shared import counted, known, seen, written

#: Rows of a few longs that are broadcast at most.
SMALL = 500_000


def hinted(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` to be broadcast if it has few enough rows (``seen``)."""
    return F.broadcast(df) if seen(df) <= most else df


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) as (node, root), where root is the smallest node of the component; roots have no row.

    Each round hangs every node's larger neighbours on its smallest one, and then every node with its
    smaller neighbours on the smallest of them. Minima are pre-aggregated, so a node with very many
    links costs a row for each task; the join that hands minima out can be split by AQE. Each round
    is written to the shared folder. Rounds grow with the logarithm of the longest path and end with a star for each component.
    """
    edges = counted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        # Settled: every node hangs on one other, which hangs on none.
        ends = edges.select("u", F.lit(1).alias("on"), F.lit(0).alias("under")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("on"), F.lit(1).alias("under")))
        if not seen(edges) or not ends.groupBy("u").agg(F.sum("on").alias("on"), F.max("under").alias("under")).where("on > 1 or (on = 1 and under = 1)").head(1):
            return known(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), rows=seen(edges))
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = counted(small, "links")


def _stars(table, near: Callable):
    """Links that join up the nodes of the rows of one task: a star for each component, however many pairs are near."""
    import numpy as np
    import pyarrow as pa

    nodes, of_row = np.unique(table.column("node").to_numpy(), return_inverse=True)
    lab = of_row.copy()
    if "asks" in table.column_names:
        asks = np.flatnonzero(table.column("asks").to_numpy())
    else:  # every pair that may join has a row outside the most frequent node
        asks = np.flatnonzero(of_row != np.bincount(of_row).argmax())
    of = near(table)
    for i in asks.tolist():
        other = lab != lab[i]
        if other.any() and (hit := other & of(i)).any():
            joined = np.unique(np.append(lab[hit], lab[i]))
            lab[np.isin(lab, joined)] = joined[0]
    top = np.arange(len(nodes))
    top[of_row] = lab
    on = np.flatnonzero(top != np.arange(len(nodes)))
    return pa.table({"a": pa.array(nodes[top[on]], type=pa.int64()), "b": pa.array(nodes[on], type=pa.int64())})


def links_inside(members: DataFrame, near: Callable, limit: int, leaders: int = 32) -> DataFrame:
    """Links (a, b) between nodes that join up just what paths of near rows of one ``group`` join.

    ``members`` has group and node (longs) and what ``near`` needs: ``near(table)`` gives a function from the number of
    a row to the rows (as Booleans) that are near it. Rows of one node count as joined; several may be of one group.
    Pairs are never listed: each task gives one star for each component it finds, so links are fewer than rows.

    Groups of up to ``limit`` rows are compared in one task. Larger ones are dealt out in slices by hash, each together
    with about ``leaders`` rows of the group, which makes one component of each family of near rows. Then every row
    outside its group's largest component is compared with all rows of other components, again in slices of both, so no link is
    missed and no task holds more than two slices.
    """
    own = [c for c in members.columns if c != "group"]
    groups = members.groupBy("group").agg(F.count("*").alias("_n"), F.min("node").alias("_lo"), F.max("node").alias("_hi"))
    groups = counted(groups.where("_lo < _hi").select("group", "_n"), "groups", large=F.col("_n") > limit)
    t = members.join(hinted(groups), "group")
    stars = lambda df, *by: df.groupBy("group", *by).applyInArrow(lambda table: _stars(table, near), "a long, b long")
    links = stars(t.where(F.col("_n") <= limit).select("group", *own))
    if not seen(groups, "large"):
        return links
    slices = F.ceil(F.col("_n") / limit).cast("int")
    large = written(t.where(F.col("_n") > limit).withColumn("_all", slices).withColumn("_h", F.xxhash64(*own)).withColumn("_j", F.pmod("_h", "_all")), "large-groups")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("_all") - 1))
    first = large.where(F.pmod(F.xxhash64("_h"), F.ceil(F.col("_n") / leaders)) == 0).withColumn("_j", everywhere)
    near_leaders = written(stars(large.unionByName(first).select("group", "_j", *own), "_j"), "links-of-slices")
    roots = connected_components(near_leaders)
    joined = large.join(hinted(roots).select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left")
    joined = written(joined.withColumn("node", F.coalesce("root", "node")).drop("_node", "root"), "joined-groups")
    sizes = joined.groupBy("group", "node").agg(F.count("*").alias("k"))
    most = sizes.groupBy("group").agg(F.max(F.struct("k", "node")).alias("top"), F.sum("k").alias("k")).where("top.k < k")
    most = counted(most.select("group", F.col("top.node").alias("_most"), (F.col("k") - F.col("top.k")).alias("_out")), "largest-components")
    links = links.unionByName(near_leaders)
    if not seen(most):
        return links
    rest = joined.join(hinted(most), "group").withColumn("_outs", F.ceil(F.col("_out") / limit).cast("int"))
    asked = rest.where("node <> _most").withColumn("_i", F.pmod(F.xxhash64("_h"), "_outs")).withColumn("_j", everywhere).withColumn("asks", F.lit(True))
    against = rest.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_outs") - 1))).withColumn("asks", F.lit(False))
    kept = ["group", "_i", "_j", "asks", *own]
    return links.unionByName(written(stars(asked.select(kept).unionByName(against.select(kept)), "_i", "_j").distinct(), "links-across"))
