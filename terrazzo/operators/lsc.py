"""The variant that clusters in a ten-dimensional weighted feature space."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.plans.config import SlicConfig
from terrazzo.plans.lineage import cut, small

COLOUR_WEIGHT = 20.0
#: Chroma counts this much more than lightness.
CHROMA = 2.55
FEATURES = 10


def raw_features(compactness: float) -> list[Column]:
    """Cosine and sine of lightness, both chroma channels and both coordinates (in quarter turns a spacing)."""
    space = COLOUR_WEIGHT * compactness / 100
    quarter = math.pi / 2
    angle = [(F.col(c) * (quarter / 255), w) for c, w in (("c0", COLOUR_WEIGHT), ("c1", COLOUR_WEIGHT * CHROMA), ("c2", COLOUR_WEIGHT * CHROMA))]
    angle += [(F.col(c) * (F.lit(quarter) / F.col("s")), space) for c in ("x", "y")]
    return [f(a) * w for a, w in angle for f in (F.cos, F.sin)]


def features(image: DataFrame, compactness: float) -> DataFrame:
    """Image rows with ``features``, each over the row's weight, and ``weight``: the features' product with their image's means."""
    raw = image.withColumns({f"f{k}": f for k, f in enumerate(raw_features(compactness))})
    means = raw.groupBy("image_id").agg(*(F.avg(f"f{k}").alias(f"m{k}") for k in range(FEATURES)))
    joined = raw.join(small(cut(means), 128), "image_id")
    weight = sum((F.col(f"m{k}") * F.col(f"f{k}") for k in range(1, FEATURES)), F.col("m0") * F.col("f0"))
    out = joined.withColumn("weight", weight)
    scaled = F.array(*(F.try_divide(F.col(f"f{k}"), F.col("weight")) for k in range(FEATURES)))
    return out.select(*image.columns, "weight", scaled.alias("features"))


def feature_distance(c: Column) -> Column:
    both = F.zip_with(F.col("features"), c["features"], lambda a, b: (a - b) * (a - b))
    return F.aggregate(both, F.lit(0.0), lambda total, d: total + d)


class FeatureField:
    """Seeds, assignment and update in feature space, in the place of those over colours."""

    def __init__(self, image: DataFrame, grid: DataFrame, config: SlicConfig):
        self.grid, self.config = grid, config
        self.image = cut(features(image, config.compactness))

    def seed(self, clusters: DataFrame) -> DataFrame:
        """Clusters with the plain mean of the features within a quarter spacing."""
        c = clusters.join(small(self.grid.select("image_id", "s", "h", "w"), 48), "image_id").withColumn("r", F.expr("s div 4"))
        ys = F.explode(F.sequence(F.expr("greatest(0, int(y) - r)"), F.expr("least(h - 1, int(y) + r)")))
        xs = F.explode(F.sequence(F.expr("greatest(0, int(x) - r)"), F.expr("least(w - 1, int(x) + r)")))
        window = c.select("image_id", "number", "x", "r", "w", ys.alias("py")).select("image_id", "number", F.col("py").alias("y"), xs.alias("x"))
        found = window.join(self.image.select("image_id", "y", "x", "features"), ["image_id", "y", "x"])
        mean = found.groupBy("image_id", "number").agg(F.array(*(F.avg(F.col("features")[k]) for k in range(FEATURES))).alias("features"))
        return cut(clusters.join(mean, ["image_id", "number"]))

    def assign(self, rows: DataFrame, clusters: DataFrame) -> DataFrame:
        from terrazzo.operators.segment import assign

        return assign(rows, clusters, self.grid, self.config, feature_distance, ("features",))

    def update(self, done: DataFrame, clusters: DataFrame) -> DataFrame:
        """Places and colours as elsewhere; features to the weighted mean. A cluster without pixels can't be told
        from any other by its features, and attracts none afterwards."""
        from terrazzo.operators.segment import update

        moved = update(done, clusters, self.config)
        sums = done.where("label is not null").groupBy("image_id", F.col("label").alias("number")).agg(
            F.array(*(F.try_divide(F.sum(F.col("weight") * F.col("features")[k]), F.sum("weight")) for k in range(FEATURES))).alias("new")
        )
        old = clusters.select("image_id", "number", "features")
        both = moved.join(old, ["image_id", "number"]).join(sums, ["image_id", "number"], "left")
        nothing = F.array(*(F.lit(math.nan) for _ in range(FEATURES)))
        value = F.when(F.col("is_updatable") > 0, F.coalesce("new", nothing)).otherwise(F.col("features"))
        return both.withColumn("features", value).drop("new")
