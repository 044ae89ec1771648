"""Graphs of regions, and moving values between pixels and regions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.plans.lineage import cut, small

MAX_DEGREE = 12


def _touching(assignment: DataFrame) -> DataFrame:
    """(image_id, src, dst, ord): each ordered meeting of two labels, right, below and below right, in raster order.

    Pixels of the last row and column start none.
    """
    a = assignment.select("image_id", "y", "x", "label")
    row = Window.partitionBy("image_id", "y").orderBy("x")
    a = a.withColumns({"right": F.lead("label").over(row), "next_x": F.lead("x").over(row)})
    below = a.select("image_id", (F.col("y") - 1).alias("y"), "x", F.col("label").alias("down"), F.col("right").alias("diagonal"))
    met = a.where("next_x = x + 1").join(below, ["image_id", "y", "x"])
    turn = (F.col("y").cast("long") * (1 << 31) + F.col("x")) * 3
    sides = F.array(*(F.struct(F.col(c).alias("dst"), (turn + k).alias("ord")) for k, c in enumerate(("right", "down", "diagonal"))))
    each = met.select("image_id", F.col("label").alias("src"), F.explode(sides).alias("e")).select("image_id", "src", "e.dst", "e.ord")
    return each.where("src is not null and dst is not null and src <> dst")


def taken(src: list[int], dst: list[int], max_degree: int) -> list[bool]:
    """Which of the pairs come in, one after another, while both their regions have fewer neighbours."""
    degree: dict[int, int] = {}
    keep = []
    for a, b in zip(src, dst, strict=True):
        ok = degree.get(a, 0) < max_degree and degree.get(b, 0) < max_degree
        keep.append(ok)
        if ok:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    return keep


def adjacency(assignment: DataFrame, max_degree: int | None = MAX_DEGREE, local: bool | None = None) -> DataFrame:
    """(image_id, src, dst, ord), both directions of each pair of touching labels once.

    With ``max_degree`` pairs come in the raster order of their first meeting, and one comes in only while both its
    regions have fewer neighbours. That depends on all edges before, so the edges of one image, a few for each region
    and not for each pixel, are gone through in one task: 65,533 regions, the most that there are, have some 200,000.
    Images that fit one task (LOCAL_PIXELS) are one task's work each; if any is larger, pixels meet by joins. ``local``
    says which, if the caller knows; else the images' pixels are counted.
    """
    from terrazzo.operators.local import touching_local
    from terrazzo.operators.segment import fit_tasks

    if fit_tasks(assignment) if local is None else local:
        return touching_local(assignment, max_degree)
    pairs = _touching(assignment).groupBy("image_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    first = pairs.agg(F.min(F.struct("ord", "src", "dst")).alias("f")).select("image_id", "f.src", "f.dst", "f.ord")
    if max_degree is not None:

        def capped(edges: pd.DataFrame) -> pd.DataFrame:
            edges = edges.sort_values("ord")
            return edges[taken(edges["src"].tolist(), edges["dst"].tolist(), max_degree)]

        first = first.groupBy("image_id").applyInPandas(capped, first.schema)
    return first.unionByName(first.select("image_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "ord"))


def nearest(clusters: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """(image_id, src, dst, ord): of the clusters within three spacings on both axes the k nearest, ties by number.

    Distances are those of places, in L1. Clusters meet by cells of three spacings, not all with all.
    """
    c = clusters.select("image_id", "number", "y", "x").join(small(grid.select("image_id", "s"), 32), "image_id")
    c = c.withColumns({"cy": F.expr("int(y) div (3 * s)"), "cx": F.expr("int(x) div (3 * s)")})
    around = c.withColumn("cy", F.explode(F.expr("sequence(cy - 1, cy + 1)"))).withColumn("cx", F.explode(F.expr("sequence(cx - 1, cx + 1)")))
    other = c.select("image_id", "cy", "cx", F.col("number").alias("dst"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    met = around.join(other, ["image_id", "cy", "cx"]).where("number <> dst and abs(y - y2) <= 3 * s and abs(x - x2) <= 3 * s")
    rank = F.row_number().over(Window.partitionBy("image_id", "number").orderBy(F.expr("abs(y - y2) + abs(x - x2)"), "dst"))
    return met.select("image_id", F.col("number").alias("src"), "dst", rank.cast("long").alias("ord")).where(F.col("ord") <= k)


def as_lists(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(image_id, number, neighbors): every node's neighbours in the order of ``ord``, none for a lone node."""
    lists = edges.groupBy("image_id", F.col("src").alias("number")).agg(F.array_sort(F.collect_list(F.struct("ord", "dst"))).alias("l"))
    all_ = clusters.select("image_id", "number").join(lists, ["image_id", "number"], "left")
    return all_.select("image_id", "number", F.coalesce(F.transform("l", lambda e: e["dst"]), F.array().cast("array<int>")).alias("neighbors"))


def mask_density(masked: DataFrame, clusters: DataFrame) -> DataFrame:
    """(image_id, number, density): the mask's sum over each region by the cluster's member count, 255 at most.

    masked has image_id, label and mask. The count is that of the last update, which subsampling makes too small.
    """
    sums = masked.groupBy("image_id", F.col("label").alias("number")).agg(F.sum(F.col("mask").cast("long")).alias("total"))
    joined = clusters.select("image_id", "number", "num_members").join(sums, ["image_id", "number"], "left")
    density = F.expr("int(least(255L, coalesce(total, 0L) div greatest(num_members, 1L)))")
    return joined.select("image_id", "number", density.alias("density"))


def broadcast_density(assignment: DataFrame, density: DataFrame) -> DataFrame:
    """(image_id, y, x, mask): each pixel with its region's density; 0 for labels without one."""
    d = small(cut(density.select("image_id", F.col("number").alias("label"), "density")), 48)
    return assignment.join(d, ["image_id", "label"], "left").select("image_id", "y", "x", F.coalesce("density", F.lit(0)).alias("mask"))
