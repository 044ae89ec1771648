"""Images as tables: from arrays, from files, and from any ordered table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.plans.lineage import cut

PIXELS = "image_id int, y int, x int, c0 int, c1 int, c2 int"
ORDER = (
    "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice l_quantity l_discount l_tax l_shipdate l_returnflag l_linestatus"
).split()
HEIGHT, WIDTH = 60, 100


def from_array(spark: SparkSession, image: np.ndarray, image_id: int = 0) -> DataFrame:
    """pixels of one [H, W, 3] image of unsigned bytes."""
    if image.ndim != 3 or image.shape[2] != 3:
        raise ValueError("nchan != 3")
    h, w, _ = image.shape
    y, x = np.divmod(np.arange(h * w), w)
    flat = image.reshape(-1, 3).astype(int)
    rows = np.column_stack([np.full(h * w, image_id), y, x, flat]).tolist()
    return spark.createDataFrame(rows, PIXELS)


def from_binary(images: DataFrame) -> DataFrame:
    """pixels of the rows of Spark's ``image`` source (3 channels, bytes in BGR order), numbered by column image_id."""
    i = images.select("image_id", "image.*").where("nChannels = 3")
    at = i.select("image_id", "width", "data", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("i"))
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(data, 3 * i + {k + 1}, 1)")), 16, 10).cast("int")
    return at.select(
        "image_id", F.expr("i div width").cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"),
        byte(2).alias("c0"), byte(1).alias("c1"), byte(0).alias("c2"),
    )


def number(df: DataFrame, order: list[Column | str], name: str = "i", keep: list[str] | None = None) -> DataFrame:
    """Rows numbered from 0 in a total order, without gathering them in one task: ranges are sorted each for itself,
    and each range's numbers begin after the counts of the ranges before it. Only columns to ``keep`` are written."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = cut(ranged.select(*(df.columns if keep is None else keep), "__at"))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).collect()  # a row for each partition
    base, total = {}, 0
    for r in sorted(sizes):
        base[r["__part"]] = total
        total += r["n"]
    if not base:
        return ranged.drop("__at").withColumn(name, F.lit(0).cast("long"))
    starts = F.create_map(*(F.lit(v).cast("long") for kv in base.items() for v in kv))
    return ranged.withColumn(name, F.element_at(starts, part) + place).drop("__at")


def lineitem_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels derived from lineitem in a total order: images of 60 by 100."""
    i = number(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*ORDER), list(ORDER), keep=["l_quantity", "l_extendedprice", "l_discount"])
    size = HEIGHT * WIDTH
    out = i.selectExpr(
        f"int(i div {size}) image_id", f"int((i % {size}) div {WIDTH}) y", f"int(i % {WIDTH}) x", "int(l_quantity) q", "bigint(l_extendedprice) e", "l_discount"
    )
    return out.selectExpr(
        "image_id", "y", "x", "least(255, 3 * y + q) c0", "least(255, 2 * x + q) c1", "int(e % 256) c2", "int(l_discount * 1000) mask"
    )
