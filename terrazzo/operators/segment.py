"""Superpixel segmentation: windowed k-means over the pixels of many images at once."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.functions.scalar import clamp, rgb_to_lab, round_int
from terrazzo.plans.config import SlicConfig
from terrazzo.plans.lineage import cut, small

CLUSTERS = ("image_id", "number", "y", "x", "c0", "c1", "c2", "num_members", "is_active", "is_updatable")
COOLDOWN = 2
#: Different sizes of images that one call takes.
MAX_SHAPES = 10_000
#: Images up to so many pixels are segmented by one task each, all iterations at once; larger ones by joins.
LOCAL_PIXELS = 1 << 22
#: The order of visits: squares of this much more than two spacings, in four phases like a board's colours.
MARGIN = 32


def frames(pixels: DataFrame, config: SlicConfig) -> DataFrame:
    """(image_id, h, w, s, coef, table) for each image. Sizes are told from one pass and kept; only distinct ones reach the
    driver, and no more than MAX_SHAPES of them. Images are whole rectangles."""
    sizes = cut(pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")))
    shapes = sizes.select("h", "w").distinct().limit(MAX_SHAPES + 1).collect()
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"images have more than {MAX_SHAPES} different sizes; segment them in groups")
    rows = [(r.h, r.w, s := config.spacing(r.h, r.w), config.spatial_coefficient(s), config.spatial_table(s)) for r in shapes]
    known = pixels.sparkSession.createDataFrame(rows, "h int, w int, s int, coef double, table array<int>")
    return sizes.join(small(known, 1 << 13, len(rows)), ["h", "w"]).select("image_id", "h", "w", "s", "coef", "table")


def fit_tasks(pixels: DataFrame) -> bool:
    """Whether each image has LOCAL_PIXELS at most; their pixels are counted."""
    return pixels.groupBy("image_id").count().where(F.col("count") > LOCAL_PIXELS).isEmpty()


def grid_fits(grid: DataFrame) -> bool:
    """The same by the sizes of ``frames``."""
    return grid.where(F.col("h").cast("long") * F.col("w") > LOCAL_PIXELS).isEmpty()


def to_lab(pixels: DataFrame) -> DataFrame:
    lab = rgb_to_lab("c0", "c1", "c2")
    return pixels.withColumns({f"c{k}": c for k, c in enumerate(lab)})


def grid_centres(h: int, w: int, k: int) -> list[tuple[int, int]]:
    """Centres of k cells in isqrt(k) rows of about k / isqrt(k) each.

    What doesn't divide evenly goes to one row each, even rows before odd ones. Cells have the rounded-up size; those that
    would begin outside are replaced by the image's centre.
    """
    rows = math.isqrt(k)
    evens = -(-rows // 2)
    counts = [k // rows + ((r // 2 + (evens if r % 2 else 0)) < k % rows) for r in range(rows)]
    height = -(-h // rows)
    widths = [-(-w // n) for n in counts]
    tops = range(0, h, height)
    inside = [(min(top + height // 2, h - 1), min(left + width // 2, w - 1)) for top, width in zip(tops, widths, strict=False) for left in range(0, w, width)]
    return (inside + [(h // 2, w // 2)] * k)[:k]


def sample_colour(clusters: DataFrame, pixels: DataFrame, grid: DataFrame) -> DataFrame:
    """Clusters, moved to the image's nearest place if they are outside, with the colour of the pixel that each then stands on."""
    placed = clusters.drop("c0", "c1", "c2").join(small(grid.select("image_id", "h", "w"), 32), "image_id")
    placed = placed.withColumns({"y": clamp(F.col("y"), 0.0, F.col("h") - 1), "x": clamp(F.col("x"), 0.0, F.col("w") - 1)})
    at = cut(placed.drop("h", "w").withColumns({"py": F.col("y").cast("int"), "px": F.col("x").cast("int")}))
    colours = pixels.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), *(F.col(f"c{k}").cast("double").alias(f"c{k}") for k in range(3)))
    return colours.join(small(at, 96), ["image_id", "py", "px"]).select(*CLUSTERS)


def initialize(pixels: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """k clusters an image, on a regular grid, with the colours found there."""
    shapes = grid.select("h", "w").distinct().collect()
    rows = [(r.h, r.w, [(n, float(y), float(x)) for n, (y, x) in enumerate(grid_centres(r.h, r.w, k))]) for r in shapes]
    seeds = pixels.sparkSession.createDataFrame(rows, "h int, w int, seeds array<struct<number: int, y: double, x: double>>")
    each = grid.select("image_id", "h", "w").join(small(seeds, 24 * k, len(rows)), ["h", "w"]).select("image_id", F.inline("seeds"))
    fixed = {"c0": F.lit(0.0), "c1": F.lit(0.0), "c2": F.lit(0.0), "num_members": F.lit(0).cast("long"), "is_active": F.lit(True), "is_updatable": F.lit(COOLDOWN)}
    return sample_colour(each.withColumns(fixed), pixels, grid)


def prepare(pixels: DataFrame, grid: DataFrame) -> DataFrame:
    """Pixels with the cell of one spacing that each lies in."""
    p = pixels.join(small(grid.select("image_id", "s"), 32), "image_id")
    return p.withColumns({"cell_y": F.expr("y div s"), "cell_x": F.expr("x div s")})


def distance(config: SlicConfig) -> Column:
    """The distance of a pixel (columns y, x, c0..c2) from a candidate ``c``, by variant, as a function of c."""

    def of(c: Column) -> Column:
        quantised = config.variant != "noq"
        part = lambda f: c[f].cast("int") if quantised else c[f]
        dy, dx = F.col("y") - part("y"), F.col("x") - part("x")
        dc = [F.col(f"c{k}") - part(f"c{k}") for k in range(3)]
        coef = F.col("coef")
        l1 = F.abs(dc[0]) + F.abs(dc[1]) + F.abs(dc[2])
        l2 = dc[0] * dc[0] + dc[1] * dc[1] + dc[2] * dc[2]
        if config.variant == "l2" or config.variant == "noq" and not config.manhattan_spatial_dist:
            return (l2 + coef * coef * (dy * dy + dx * dx)).cast("double")
        if config.variant in ("real", "noq"):
            plain = config.manhattan_spatial_dist
            return (l1 + coef * (F.abs(dy) + F.abs(dx) if plain else F.hypot(dy.cast("double"), dx.cast("double")))).cast("double")
        if config.manhattan_spatial_dist:
            return (F.get(F.col("table"), F.abs(dy) + F.abs(dx)) + l1).cast("double")
        return (F.floor(coef * F.hypot(dy.cast("double"), dx.cast("double"))) + l1).cast("double")

    return of


def candidates(clusters: DataFrame, grid: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, cell_y, cell_x, coef, table, near): the active clusters whose window meets each cell, one row a cell.

    The window join of pixels and clusters becomes an equality join on cells: a window of two spacings meets nine
    cells at most.
    """
    c = clusters.where("is_active").join(small(grid, 256), "image_id")
    c = c.withColumns({"y": clamp(F.col("y"), 0, F.col("h") - 1), "x": clamp(F.col("x"), 0, F.col("w") - 1)})
    c = c.withColumns({"iy": F.col("y").cast("int"), "ix": F.col("x").cast("int"), "t": 2 * F.col("s") + MARGIN})
    c = c.withColumns({"ty": F.expr("iy div t"), "tx": F.expr("ix div t")})
    near = F.struct(*(F.col(x) for x in ("y", "x", "iy", "ix", "c0", "c1", "c2", "number", "ty", "tx", *extra)))
    cells = lambda v, n: F.explode(F.sequence(F.expr(f"greatest(0, {v} - s) div s"), F.expr(f"least({n} - 1, {v} + s) div s")))
    c = c.select("image_id", "s", "coef", "table", near.alias("c"), "iy", "ix", "h", "w")
    c = c.withColumn("cell_y", cells("iy", "h")).withColumn("cell_x", cells("ix", "w"))
    return c.groupBy("image_id", "cell_y", "cell_x").agg(F.first("coef").alias("coef"), F.first("table").alias("table"), F.collect_list("c").alias("near"))


def assign(prepared: DataFrame, clusters: DataFrame, grid: DataFrame, config: SlicConfig, measure=None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pixels with ``label``, the number of the nearest active cluster, null where no window reaches.

    Of equal distances the cluster visited first wins: by phase of its square, then square, then number.
    """
    measure = measure or distance(config)
    near = small(cut(candidates(clusters, grid, extra)), 2048)
    joined = prepared.join(near, ["image_id", "cell_y", "cell_x"], "left")

    def inside(c: Column) -> Column:
        if config.variant == "noq":  # bounds of real centres, cut off
            lo = lambda v: F.greatest(F.lit(0), F.floor(F.greatest(c[v] - F.col("s"), F.lit(0.0))))
            hi = lambda v: F.floor(c[v] + F.col("s") + 1)
            return (F.col("y") >= lo("y")) & (F.col("y") < hi("y")) & (F.col("x") >= lo("x")) & (F.col("x") < hi("x"))
        return (F.abs(F.col("y") - c["iy"]) <= F.col("s")) & (F.abs(F.col("x") - c["ix"]) <= F.col("s"))

    def rank(c: Column) -> Column:
        return F.struct(measure(c).alias("d"), (2 * (c["ty"] % 2) + c["tx"] % 2).alias("phase"), c["ty"].alias("ty"), c["tx"].alias("tx"), c["number"].alias("number"))

    best = F.array_min(F.filter(F.transform(F.filter("near", inside), rank), lambda r: ~F.isnan(r["d"])))
    # Behind a generator the dear step is computed once, however often its result is read or filtered by.
    once = joined.select(*prepared.columns, F.explode_outer(F.array(best)).alias("best"))
    return once.select(*prepared.columns, F.col("best.number").alias("label"), F.col("best.d").alias("dist"))


def awake_rows(assigned: DataFrame, clusters: DataFrame, grid: DataFrame) -> DataFrame:
    """The pixels that a preemptive update counts: those in cells of two spacings where an active cluster stands, and
    all of an image whose clusters are all active. Cells reach the pixels by an equality join."""
    c = clusters.join(small(grid.select("image_id", "s"), 32), "image_id").withColumns({"wide_y": F.expr("int(y) div (2 * s)"), "wide_x": F.expr("int(x) div (2 * s)")})
    c = cut(c.select("image_id", "wide_y", "wide_x", "is_active"))
    whole = c.groupBy("image_id").agg(F.bool_and("is_active").alias("whole"))
    cells = c.where("is_active").select("image_id", "wide_y", "wide_x").distinct().withColumn("here", F.lit(True))
    placed = assigned.withColumns({"wide_y": F.expr("y div (2 * s)"), "wide_x": F.expr("x div (2 * s)")})
    marked = placed.join(small(whole, 32), "image_id", "left").join(small(cells, 48), ["image_id", "wide_y", "wide_x"], "left")
    return marked.where(F.coalesce("whole", F.lit(False)) | F.coalesce("here", F.lit(False))).select(*assigned.columns)


def update(assigned: DataFrame, clusters: DataFrame, config: SlicConfig) -> DataFrame:
    """Clusters moved to the mean of their pixels, rounded unless the variant is noq.

    A cluster without pixels stays where it is, with no members; one that may not move keeps everything.
    """
    rows = assigned.where("label is not null")
    sums = rows.groupBy("image_id", F.col("label").alias("number")).agg(F.count("*").alias("n"), *(F.sum(F.col(f).cast("long")).alias(f"s_{f}") for f in ("y", "x", "c0", "c1", "c2")))
    mean = lambda f: F.expr(f"s_{f} / n") if config.variant == "noq" else round_int(f"s_{f}", "n").cast("double")
    moved = F.col("n").isNotNull() & (F.col("is_updatable") > 0)
    joined = clusters.join(sums, ["image_id", "number"], "left")
    out = joined.withColumns({f: F.when(moved, mean(f)).otherwise(F.col(f)) for f in ("y", "x", "c0", "c1", "c2")})
    out = out.withColumn("num_members", F.when(F.col("is_updatable") > 0, F.coalesce("n", F.lit(0))).otherwise(F.col("num_members")))
    return out.select(*CLUSTERS)


def settle(clusters: DataFrame, before: DataFrame, grid: DataFrame, config: SlicConfig) -> DataFrame:
    """Preemptive bookkeeping: clusters that barely move cool down and freeze; those near none that moves rest.

    A cluster is active if one that may still move is within two spacings on both axes.
    """
    old = before.select("image_id", "number", F.col("y").alias("oy"), F.col("x").alias("ox"))
    c = clusters.join(old, ["image_id", "number"]).join(small(grid.select("image_id", "s"), 32), "image_id")
    limit = F.greatest(F.floor(2 * F.col("s") * F.lit(config.preemptive_thres) + 0.5), F.lit(1))
    still = F.abs(F.col("y") - F.col("oy")) + F.abs(F.col("x") - F.col("ox")) < limit
    left = F.when(F.col("is_updatable") == 0, 0).when(still, F.col("is_updatable") - 1).otherwise(COOLDOWN)
    c = c.withColumn("is_updatable", left).withColumns({"ty": F.expr("int(y) div (2 * s)"), "tx": F.expr("int(x) div (2 * s)")})
    c = cut(c)
    moving = c.where("is_updatable > 0").select("image_id", "s", F.expr("int(y) my"), F.expr("int(x) mx"), "ty", "tx")
    moving = moving.withColumn("ty", F.explode(F.expr("sequence(ty - 1, ty + 1)"))).withColumn("tx", F.explode(F.expr("sequence(tx - 1, tx + 1)"))).drop("s")
    reached = c.join(moving, ["image_id", "ty", "tx"]).where("abs(int(y) - my) <= 2 * s and abs(int(x) - mx) <= 2 * s").select("image_id", "number").distinct()
    return c.drop("is_active").join(reached.withColumn("is_active", F.lit(True)), ["image_id", "number"], "left").withColumn("is_active", F.coalesce("is_active", F.lit(False))).select(*CLUSTERS)


class Slic:
    """A model of one variant; ``iterate`` again to go on from its centres on the next frame of the same images."""

    def __init__(self, config: SlicConfig | None = None, **settings):
        self.config = config or SlicConfig(**settings)
        self.clusters: DataFrame | None = None
        self.last_assignment: DataFrame | None = None
        self.last_timing_report: list[tuple[str, int]] = []
        self.snapshots: list[tuple[int, DataFrame, DataFrame]] = []

    def set_clusters(self, clusters: DataFrame) -> None:
        """Replace the clusters: colours and places as whole numbers, numbered anew from 0 in their given order, all active.

        The number of components becomes that of the clusters given, the same for every image.
        """
        counts = clusters.groupBy("image_id").count().agg(F.min("count"), F.max("count")).first()
        if counts[0] is None or counts[0] != counts[1]:
            raise ValueError("every image must have the same number of clusters, and one at least")
        self.config = self.config.copy(num_components=counts[1])
        whole = {f: F.floor(F.col(f)).cast("double") for f in ("y", "x", "c0", "c1", "c2")}
        anew = (F.row_number().over(Window.partitionBy("image_id").orderBy("number")) - 1).alias("number")
        fixed = {**whole, "is_active": F.lit(True), "is_updatable": F.lit(COOLDOWN)}
        self.clusters = cut(clusters.withColumns({**fixed, "number": anew}).select(*CLUSTERS))

    def get_clusters(self) -> DataFrame:
        """(image_id, number, yx, color, num_members), as whole numbers."""
        whole = {f: F.col(f).cast("int") for f in ("y", "x", "c0", "c1", "c2")}
        c = self.clusters.withColumns(whole)
        return c.select("image_id", "number", F.array("y", "x").alias("yx"), F.array("c0", "c1", "c2").alias("color"), "num_members")

    def to_yxmrgb(self) -> DataFrame:
        return self.clusters.select("image_id", "number", *(F.col(f).cast("int").alias(f) for f in ("y", "x", "num_members", "c0", "c1", "c2")))

    def _timed(self, name: str, began: float) -> float:
        now = time.perf_counter()
        self.last_timing_report.append((name, round((now - began) * 1e6)))
        return now

    def recorder_report(self) -> Iterator[tuple[int, DataFrame, DataFrame]]:
        """For each recorded iteration, -1 being the beginning, its clusters and its pixels with label and distance, as
        JSON rows (debug_mode only)."""
        for number, clusters, assigned in self.snapshots:
            pixels = assigned.select(F.to_json(F.struct("image_id", "y", "x", "label", "dist")).alias("json"))
            yield number, clusters.select(F.to_json(F.struct(*CLUSTERS)).alias("json")), pixels

    def iterate(self, pixels: DataFrame, max_iter: int = 10, enforce: bool = True) -> DataFrame:
        """(image_id, y, x, label) of every pixel.

        Each iteration assigns and updates on every ``subsample_stride``-th row, in turn; at last all clusters are
        active again and all rows are assigned. A pixel that no window reaches keeps its former label. Images of
        LOCAL_PIXELS at most are segmented by one task each (see ``local``); of larger ones, and in debug_mode, each
        iteration is a join and an aggregation. Clusters of images that are not in this frame stay as they are.
        """
        from terrazzo.operators.components import enforce_connectivity
        from terrazzo.operators.local import segment_local, split_local

        config, began = self.config, time.perf_counter()
        self.last_timing_report, self.snapshots = [], []
        pixels = pixels.select("image_id", "y", "x", "c0", "c1", "c2")
        colours = to_lab(pixels) if config.convert_to_lab else pixels
        grid = frames(pixels, config)
        large = cut(grid.where(F.col("h").cast("long") * F.col("w") > (0 if config.debug_mode else LOCAL_PIXELS)))
        n_large, n_all = large.count(), grid.count()
        began = self._timed("prepare", began)
        done = []
        if n_large < n_all:
            own = colours.join(small(large.select("image_id"), 16, n_large), "image_id", "left_anti") if n_large else colours
            done.append(split_local(cut(segment_local(own, self.clusters, config, max_iter, enforce))))
            began = self._timed("local", began)
        if n_large:
            ids = small(large.select("image_id"), 16, n_large)
            found, moved = self._iterate_joined(colours.join(ids, "image_id", "left_semi"), large, max_iter)
            if enforce:
                least = F.floor(F.col("s") * F.col("s") * F.lit(config.min_size_factor) + 0.5).cast("long").alias("least")
                found = enforce_connectivity(found, limits=large.select("image_id", F.lit(config.num_components).alias("k"), least))
            done.append((found, moved))
            began = time.perf_counter()
        full, clusters = done[0] if len(done) == 1 else (done[0][0].unionByName(done[1][0]), done[0][1].unionByName(done[1][1]))
        if self.clusters is not None:
            rest = self.clusters.join(small(grid.select("image_id"), 16, n_all), "image_id", "left_anti")
            clusters = cut(clusters.unionByName(rest.select(*CLUSTERS)))
        self.clusters = clusters
        self.last_assignment = full
        self._timed("finish", began)
        return full

    def _iterate_joined(self, pixels: DataFrame, grid: DataFrame, max_iter: int) -> tuple[DataFrame, DataFrame]:
        """Labels and clusters by joins of pixels and clusters. Both are written in each iteration, the labels of the
        iteration's rows once, so that none is computed twice and each may be needed again when no window reaches a pixel."""
        config, began, stride = self.config, time.perf_counter(), self.config.subsample_stride
        image = cut(prepare(pixels, grid))
        fresh = grid
        known = None
        if self.clusters is not None:
            known = self.clusters.join(small(grid.select("image_id"), 16), "image_id", "left_semi")
            fresh = cut(grid.join(known.select("image_id").distinct(), "image_id", "left_anti"))
        clusters = initialize(image, fresh, config.num_components)
        clusters = clusters if known is None else clusters.unionByName(known.select(*CLUSTERS))
        clusters = cut(sample_colour(clusters.withColumns({"is_active": F.lit(True), "is_updatable": F.lit(COOLDOWN)}), image, grid))
        if config.debug_mode:
            nothing = image.select("image_id", "y", "x", F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("dist"))
            self.snapshots.append((-1, clusters, nothing))
        field = None
        if config.variant == "lsc":
            from terrazzo.operators.lsc import FeatureField

            field = FeatureField(image, grid, config)
            image, clusters = field.image, field.seed(clusters)
        labels: dict[int, DataFrame] = {}
        for number in range(max_iter):
            rem = number % stride
            rows = image.where(F.col("y") % stride == rem)
            done = cut(field.assign(rows, clusters) if field else assign(rows, clusters, grid, config))
            done = labels[rem] = self._stale(done, labels.get(rem))
            before = clusters
            # The first iteration begins with all clusters active, so that nothing is left out.
            counted = awake_rows(done, clusters, grid) if config.preemptive and number else done
            clusters = cut(field.update(counted, clusters) if field else update(counted, clusters, config))
            if config.preemptive:
                settled = settle(clusters.select(*CLUSTERS), before.select(*CLUSTERS), grid, config)
                clusters = cut(settled if field is None else settled.join(clusters.select("image_id", "number", "features"), ["image_id", "number"]))
            if config.debug_mode:
                self.snapshots.append((number, clusters, done))
            began = self._timed(f"iteration {number}", began)
        awake = clusters.withColumn("is_active", F.lit(True))
        full = cut(field.assign(image, awake) if field else assign(image, awake, grid, config))
        former = None
        for some in labels.values():  # rows of different remainders
            some = some.select("image_id", "y", "x", "label")
            former = some if former is None else former.unionByName(some)
        return self._stale(full, former).select("image_id", "y", "x", "label"), awake.select(*CLUSTERS)

    @staticmethod
    def _stale(done: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Written rows, with the former label where none was found; joined only if there is such a pixel."""
        if labels is None or done.where("label is null").isEmpty():
            return done
        old = labels.where("label is not null").select("image_id", "y", "x", F.col("label").alias("old"))
        return cut(done.join(old, ["image_id", "y", "x"], "left").withColumn("label", F.coalesce("label", "old")).drop("old"))
