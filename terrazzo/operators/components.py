"""Connected components of label images, and absorbing the small ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.plans.lineage import cut, small


def row_runs(assignment: DataFrame) -> DataFrame:
    """(image_id, y, label, lo, hi): maximal runs of one label in a row. Null is a label like any other."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    a = assignment.select("image_id", "y", "x", F.coalesce("label", F.lit(-1)).alias("label"))
    a = a.withColumn("new", F.coalesce((F.col("label") != F.lag("label").over(w)) | (F.col("x") != F.lag("x").over(w) + 1), F.lit(True)).cast("int"))
    a = a.withColumn("run", F.sum("new").over(w))
    return a.groupBy("image_id", "y", "run").agg(F.first("label").alias("label"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def components(assignment: DataFrame) -> DataFrame:
    """Runs with ``comp``, the least run of their component under 4-connectivity, and ``pos``, each run's own number.

    Least labels spread along overlapping runs of neighbouring rows, with a pointer jump each round, until a round
    changes nothing. The number of a run is its first pixel in raster order, so a component's is its leader pixel.
    """
    width = 1 << 31
    runs = row_runs(assignment).withColumn("pos", F.col("y").cast("long") * width + F.col("lo"))
    runs = cut(runs.select("image_id", "y", "label", "lo", "hi", "pos"))
    below = runs.select("image_id", (F.col("y") - 1).alias("y"), "label", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("pos").alias("b"))
    pairs = runs.join(below, ["image_id", "y", "label"]).where("lo <= hi2 and lo2 <= hi").select("image_id", F.col("pos").alias("a"), "b")
    edges = cut(pairs.union(pairs.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    comp = cut(runs.select("image_id", "pos", F.col("pos").alias("comp")))
    while True:
        near = edges.join(comp.select("image_id", F.col("pos").alias("b"), "comp"), ["image_id", "b"]).groupBy("image_id", F.col("a").alias("pos")).agg(F.min("comp").alias("near"))
        step = comp.join(near, ["image_id", "pos"], "left").select("image_id", "pos", "comp", F.least("comp", F.coalesce("near", "comp")).alias("new"))
        step = cut(step)
        jump = step.select("image_id", F.col("pos").alias("new"), F.col("new").alias("further"))
        after = cut(step.join(jump, ["image_id", "new"]).select("image_id", "pos", "comp", F.least("new", "further").alias("new")))
        if after.where("new <> comp").isEmpty():
            break
        comp = after.select("image_id", "pos", F.col("new").alias("comp"))
    return runs.join(comp, ["image_id", "pos"])


def enforce_connectivity(assignment: DataFrame, min_threshold: int = 0, k: int | None = None, limits: DataFrame | None = None, local_pixels: int | None = None) -> DataFrame:
    """(image_id, y, x, label) with one component a label, numbered in raster order.

    Components of ``min_threshold`` pixels and more stay, or the k largest of them (ties to the first in raster order; k is the
    greatest label plus one by default). A smaller one takes the label of the component left of its first pixel, above
    it in column 0, and so on until one that stays; the first of an image, if it doesn't stay, takes label 0.
    ``limits(image_id, k, least)`` gives both bounds by image. Images are whole rectangles. Those of ``local_pixels`` at most
    are one task's work each (LOCAL_PIXELS by default); if any is larger, all are worked off by joins of their runs, where
    only the components of an image, not its pixels or runs, are ranked and numbered in one task.
    """
    from terrazzo.operators.local import connect_local
    from terrazzo.operators.segment import LOCAL_PIXELS

    width = 1 << 31
    shapes = assignment.groupBy("image_id").agg((F.coalesce(F.max("label"), F.lit(-1)) + 1).alias("k"), F.count("*").alias("size"))
    shapes = cut(shapes)
    if limits is None:
        limits = shapes.select("image_id", F.lit(k).alias("k") if k is not None else F.col("k"), F.lit(min_threshold).cast("long").alias("least"))
    if shapes.where(F.col("size") > (LOCAL_PIXELS if local_pixels is None else local_pixels)).isEmpty():
        return connect_local(assignment, small(cut(limits), 64))
    runs = cut(components(assignment))
    sizes = runs.groupBy("image_id", "comp").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("area"))
    sizes = sizes.join(small(cut(limits), 64), "image_id")
    kept = sizes.where("area >= least")
    by_area = Window.partitionBy("image_id").orderBy(F.desc("area"), "comp")
    kept = kept.withColumn("rank", F.row_number().over(by_area)).where("rank <= k")
    kept = kept.select("image_id", "comp", (F.row_number().over(Window.partitionBy("image_id").orderBy("comp")) - 1).alias("label"))
    # A dropped component points at the one beside its leader, whose leader comes earlier: chains end.
    dropped = sizes.select("image_id", "comp").join(kept, ["image_id", "comp"], "left_anti")
    y, x = F.expr(f"comp div {width}"), F.expr(f"comp % {width}")
    beside = dropped.select("image_id", "comp", F.when(x > 0, y).otherwise(y - 1).alias("y"), F.when(x > 0, x - 1).otherwise(0).alias("x"))
    spans = runs.select("image_id", "y", "lo", "hi", F.col("comp").alias("parent"))
    target = beside.join(spans, ["image_id", "y"]).where("x between lo and hi").select("image_id", "comp", "parent")
    first = beside.where("y < 0").select("image_id", "comp", F.lit(None).cast("long").alias("parent"))
    todo = cut(target.union(first))
    done = cut(kept.unionByName(todo.where("parent is null").select("image_id", "comp", F.lit(0).alias("label"))))
    todo = cut(todo.where("parent is not null"))
    while not todo.isEmpty():
        found = todo.join(done.select("image_id", F.col("comp").alias("parent"), "label"), ["image_id", "parent"]).select("image_id", "comp", "label")
        found = cut(found)
        rest = todo.join(found, ["image_id", "comp"], "left_anti")
        jump = todo.select("image_id", F.col("comp").alias("parent"), F.col("parent").alias("further"))
        todo = cut(rest.join(jump, ["image_id", "parent"], "left").select("image_id", "comp", F.coalesce("further", "parent").alias("parent")))
        done = cut(done.unionByName(found))
    named = runs.join(done.select("image_id", "comp", F.col("label").alias("out")), ["image_id", "comp"])
    return named.select("image_id", "y", F.explode(F.sequence("lo", "hi")).alias("x"), F.col("out").cast("int").alias("label"))


def component_areas(assignment: DataFrame, local: bool | None = None) -> DataFrame:
    """(image_id, leader_y, leader_x, label, area) of each component.

    Images that fit one task (LOCAL_PIXELS) are one task's work each; if any is larger, all are worked off by joins of their
    runs. ``local`` says which, if the caller knows; else the images' pixels are counted.
    """
    from terrazzo.operators.local import areas_local
    from terrazzo.operators.segment import fit_tasks

    if fit_tasks(assignment) if local is None else local:
        return areas_local(assignment)
    width = 1 << 31
    found = components(assignment).groupBy("image_id", "comp").agg(F.first("label").alias("label"), F.sum(F.col("hi") - F.col("lo") + 1).alias("area"))
    return found.selectExpr("image_id", f"int(comp div {width}) leader_y", f"int(comp % {width}) leader_x", "nullif(label, -1) label", "area")
