"""Mean-field inference over regions in space and time."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrazzo.functions.scalar import log_loss, spatial_energy, temporal_energy
from terrazzo.plans.lineage import cut

NODES = "time int, node int, y double, x double, num_members long, c0 double, c1 double, c2 double"
EDGES = "time int, src int, dst int"
NODE = ("y", "x", "c0", "c1", "c2")
FLOOR = 1e-5


@dataclass(frozen=True)
class CRFParams:
    spatial_w: float = 10.0
    temporal_w: float = 10.0
    spatial_srgb: float = 13.0
    temporal_srgb: float = 13.0
    spatial_sxy: float = 80.0
    spatial_smooth_w: float = 0.0
    spatial_smooth_sxy: float = 3.0


def unbiased(nodes: DataFrame, num_classes: int) -> DataFrame:
    """(time, cls, node, u) with the same cost for every class."""
    return _by_class(nodes, num_classes, F.lit(math.log(num_classes)))


def from_mask(classes: DataFrame, num_classes: int, confidence: float) -> DataFrame:
    """Costs from ``classes(time, node, cls)``: the class given gets 1/C + (1 - 1/C) * confidence, others share the rest."""
    active = 1 / num_classes + (1 - 1 / num_classes) * confidence
    rest = (1 - active) / max(num_classes - 1, 1)
    chosen = classes.select("time", "node", F.col("cls").alias("own"))
    return _by_class(chosen, num_classes, F.when(F.col("own") == F.col("cls"), log_loss(F.lit(active))).otherwise(log_loss(F.lit(rest))))


def from_proba(proba: DataFrame) -> DataFrame:
    """Costs from ``proba(time, cls, node, p)``; a probability of 0 costs infinity."""
    return proba.select("time", "cls", "node", log_loss(F.col("p")).alias("u"))


def _by_class(nodes: DataFrame, num_classes: int, cost: Column) -> DataFrame:
    each = nodes.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(num_classes - 1))))
    return each.select("time", "cls", "node", cost.cast("double").alias("u"))


def reset(unary: DataFrame) -> DataFrame:
    """(time, cls, node, q) with q = exp(-u)."""
    return unary.select("time", "cls", "node", F.exp(-F.col("u")).alias("q"))


def normalize(q: DataFrame) -> DataFrame:
    """q over its sum by node."""
    total = F.sum("q").over(Window.partitionBy("time", "node"))
    return q.select("time", "cls", "node", (F.col("q") / F.greatest(total, F.lit(FLOOR))).alias("q"))


def spatial_pairs(nodes: DataFrame, edges: DataFrame, p: CRFParams) -> DataFrame:
    """(time, src, dst, e) for each edge."""
    n = nodes.select("time", "node", F.struct(*NODE).alias("n"), F.col("num_members").alias("m"))
    a = n.select("time", F.col("node").alias("src"), F.col("n").alias("a"), F.col("m").alias("ma"))
    b = n.select("time", F.col("node").alias("dst"), F.col("n").alias("b"), F.col("m").alias("mb"))
    joined = edges.join(a, ["time", "src"]).join(b, ["time", "dst"])
    e = F.when(F.col("src") == F.col("dst"), 0.0).otherwise(spatial_energy("a", "b", p))
    return joined.select("time", "src", "dst", e.alias("e"), F.sqrt(F.col("mb") / F.greatest("ma", F.lit(1))).alias("r"))


def temporal_pairs(nodes: DataFrame, p: CRFParams, steps: tuple[int, ...] = (-1, 1)) -> DataFrame:
    """(time, node, other, e, r) for each node and itself in the frames ``steps`` away, where there are such."""
    n = nodes.select("time", "node", F.struct(*NODE).alias("a"), F.col("num_members").alias("ma"))
    b = nodes.select(F.col("time").alias("other"), "node", F.struct(*NODE).alias("b"), F.col("num_members").alias("mb"))
    near = n.withColumn("other", F.explode(F.array(*(F.col("time") + s for s in steps))))
    e = F.when(F.col("time") == F.col("other"), 0.0).otherwise(temporal_energy("a", "b", p))
    return near.join(b, ["other", "node"]).select("time", "node", "other", e.alias("e"), F.sqrt(F.col("mb") / F.greatest("ma", F.lit(1))).alias("r"))


def infer_once(unary: DataFrame, q: DataFrame, spatial: DataFrame, temporal: DataFrame, compat: dict[int, float] | None = None) -> DataFrame:
    """One synchronous step: every node reads its neighbours' old q, and all are replaced.

    A class is charged with the messages of all others (weighted by ``compat``, 1 by default), and the result
    normalised over classes.
    """
    from_space = spatial.join(q.withColumnRenamed("node", "dst"), ["time", "dst"]).select("time", "cls", F.col("src").alias("node"), (F.col("e") * F.col("q") * F.col("r")).alias("m"))
    from_time = temporal.join(q.withColumnRenamed("time", "other"), ["other", "node"]).select("time", "cls", "node", (F.col("e") * F.col("q") * F.col("r")).alias("m"))
    messages = from_space.union(from_time).groupBy("time", "cls", "node").agg(F.sum("m").alias("m"))
    weight = F.lit(1.0)
    for c, w in (compat or {}).items():
        weight = F.when(F.col("cls") == c, float(w)).otherwise(weight)
    all_ = unary.join(messages, ["time", "cls", "node"], "left").withColumn("wm", F.coalesce("m", F.lit(0.0)) * weight)
    others = F.sum("wm").over(Window.partitionBy("time", "node")) - F.col("wm")
    return normalize(all_.select("time", "cls", "node", F.exp(-(F.col("u") + others)).alias("q")))


class SimpleCRF:
    """Frames of nodes with costs by class; times only grow and are not used again."""

    def __init__(self, spark: SparkSession, num_classes: int, params: CRFParams | None = None, compat: dict[int, float] | None = None):
        self.spark, self.num_classes, self.params, self.compat = spark, num_classes, params or CRFParams(), compat
        self.times: list[int] = []
        self._next = 0
        self.nodes = spark.createDataFrame([], NODES)
        self.edges = spark.createDataFrame([], EDGES)
        self.unary = spark.createDataFrame([], "time int, cls int, node int, u double")
        self.q: DataFrame = spark.createDataFrame([], "time int, cls int, node int, q double")

    first_time = property(lambda self: self.times[0] if self.times else -1)
    last_time = property(lambda self: self.times[-1] if self.times else -1)
    num_frames = property(lambda self: len(self.times))

    def push_frame(self, nodes: DataFrame, edges: DataFrame, unary: DataFrame | None = None) -> int:
        """Add a frame; nodes, edges and unary are without time. Without unary every class costs the same."""
        time, self._next = self._next, self._next + 1
        at = lambda df, like: df.withColumn("time", F.lit(time)).select(*(F.col(f.name).cast(f.dataType) for f in like.schema))
        frame = at(nodes, self.nodes)
        self.nodes = self.nodes.unionByName(frame)
        self.edges = self.edges.unionByName(at(edges, self.edges))
        self.unary = self.unary.unionByName(at(unary, self.unary) if unary is not None else unbiased(frame, self.num_classes))
        self.q = self.q.unionByName(_by_class(frame, self.num_classes, F.lit(0.0)).withColumnRenamed("u", "q"))
        self.times.append(time)
        return time

    def push_slic_frame(self, clusters: DataFrame, edges: DataFrame, image_id: int | None = None) -> int:
        """Add one image's clusters (whole numbers) and its adjacency or nearest-neighbour edges.

        Of tables with several images ``image_id`` names the one; without it there may be one only.
        """
        if image_id is not None:
            clusters, edges = clusters.where(F.col("image_id") == image_id), edges.where(F.col("image_id") == image_id)
        elif clusters.select("image_id").distinct().limit(2).count() > 1:
            raise ValueError("clusters of several images: name the image of this frame")
        nodes = clusters.select(F.col("number").alias("node"), *(F.floor(c).alias(c) for c in ("y", "x", "num_members", "c0", "c1", "c2")))
        return self.push_frame(nodes, edges.select("src", "dst"))

    def pop_frame(self) -> int:
        if not self.times:
            return -1
        time = self.times.pop(0)
        for name in ("nodes", "edges", "unary", "q"):
            setattr(self, name, getattr(self, name).where(F.col("time") != time))
        return time

    def get_frame(self, time: int) -> dict[str, DataFrame]:
        if time not in self.times:
            raise IndexError(time)
        return {name: getattr(self, name).where(F.col("time") == time) for name in ("nodes", "edges", "unary", "q")}

    def _replace(self, name: str, time: int, new: DataFrame) -> None:
        """Give a frame other rows of one of its tables."""
        old = getattr(self, name)
        self.get_frame(time)
        rows = new.withColumn("time", F.lit(time)).select(*(F.col(f.name).cast(f.dataType) for f in old.schema))
        setattr(self, name, old.where(F.col("time") != time).unionByName(rows))

    def set_unary(self, time: int, unary: DataFrame) -> None:
        """Costs (cls, node, u)."""
        self._replace("unary", time, unary)

    def set_unbiased(self, time: int) -> None:
        self.set_unary(time, unbiased(self.get_frame(time)["nodes"], self.num_classes))

    def set_mask(self, time: int, classes: DataFrame, confidence: float) -> None:
        """Costs from the class of each node, (node, cls)."""
        self.set_unary(time, from_mask(classes.withColumn("time", F.lit(time)), self.num_classes, confidence))

    def set_proba(self, time: int, proba: DataFrame) -> None:
        """Costs from probabilities (cls, node, p)."""
        self.set_unary(time, from_proba(proba.withColumn("time", F.lit(time))))

    def set_yxmrgb(self, time: int, nodes: DataFrame) -> None:
        """Other places, sizes and colours for the frame's nodes: (node, y, x, num_members, c0, c1, c2), as whole numbers."""
        whole = {c: F.floor(c) for c in ("y", "x", "num_members", "c0", "c1", "c2")}
        self._replace("nodes", time, nodes.withColumns(whole))

    def get_yxmrgb(self, time: int) -> DataFrame:
        fields = ("y", "x", "num_members", "c0", "c1", "c2")
        return self.get_frame(time)["nodes"].select("node", *(F.col(c).cast("int").alias(c) for c in fields))

    def set_connectivity(self, time: int, edges: DataFrame) -> None:
        """Other edges (src, dst) for the frame; they need not go both ways."""
        self._replace("edges", time, edges)

    def get_connectivity(self, time: int) -> DataFrame:
        return self.get_frame(time)["edges"].select("src", "dst")

    def get_inferred(self, time: int) -> DataFrame:
        """(cls, node, q): 0 before ``initialize``."""
        return self.get_frame(time)["q"].select("cls", "node", "q")

    def reset_inferred(self, time: int) -> None:
        self._replace("q", time, reset(self.get_frame(time)["unary"]))

    def initialize(self) -> None:
        self.q = reset(self.unary)

    def inference(self, max_iter: int) -> DataFrame:
        """q after ``max_iter`` steps; pair energies are computed once."""
        if not self.times:
            raise ValueError("inference without frames")
        spatial, temporal = cut(spatial_pairs(self.nodes, self.edges, self.params)), cut(temporal_pairs(self.nodes, self.params))
        unary, q = cut(self.unary), cut(self.q)
        for _ in range(max_iter):
            q = cut(infer_once(unary, q, spatial, temporal, self.compat))
        self.q = q
        return q
