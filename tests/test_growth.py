"""Work that must not grow faster than the pixels: one task an image, and both ways of each step equal."""

import random
import uuid
from pathlib import Path

import pytest

from terrazzo.operators.components import component_areas
from terrazzo.operators.graph import adjacency
from terrazzo.plans import queries

SF = "/root/testdata/sf0.01"
PIXELS = 60_000


def jobs(spark, run):
    """The Spark jobs that run takes."""
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def written(spark, run):
    """The bytes that run leaves in checkpoints."""
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("part-*"))
    before = size()
    run()
    return size() - before


def maps(spark, seed=1):
    """Images of different sizes with nulls and lone pixels; of one, the last row is cut short."""
    draw = random.Random(seed)
    rows = [(i, y, x, draw.choice((None, 0, 0, 0, 3, 7))) for i, (h, w) in enumerate(((9, 7), (1, 5), (6, 1), (12, 11))) for y in range(h) for x in range(w)]
    return spark.createDataFrame([r for r in rows if r[:2] != (3, 11) or r[2] < 6], "image_id int, y int, x int, label int")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_components_take_one_task_an_image(spark):
    df = maps(spark)
    assert jobs(spark, lambda: component_areas(df).collect()) < 12  # by joins 60 on these
    assert rows(component_areas(df)) == rows(component_areas(df, local=False))


@pytest.mark.parametrize("name", ["knn_l1", "crf_infer_once", "crf_unbiased"])
def test_clusters_without_written_pixels(spark, name):
    """Only the numbered pixels are written before clusters are: 16 bytes each, and no labels beside them."""
    assert written(spark, lambda: queries.queries()[name](spark, SF).collect()) < 25 * PIXELS


@pytest.mark.parametrize("name", ["lsc_assign", "lsc_update"])
def test_features_are_not_written(spark, name):
    assert written(spark, lambda: queries.queries()[name](spark, SF).collect()) < 25 * PIXELS


@pytest.mark.parametrize("cap", [None, 2])
def test_adjacency_takes_one_task_an_image(spark, cap):
    df = maps(spark)
    found = adjacency(df, cap)
    assert "Window" not in found._jdf.queryExecution().toString()
    assert rows(found) == rows(adjacency(df, cap, local=False))
