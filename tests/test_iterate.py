"""Whole iterations against a sequential model, by both ways of running them."""

import numpy as np
import pytest
from model import Model, capped_neighbours
from pyspark.sql import functions as F

from terrazzo.operators import segment
from terrazzo.operators.graph import adjacency, as_lists
from terrazzo.operators.segment import Slic
from terrazzo.plans.config import SlicConfig
from terrazzo.sources.raster import from_array

H, W, K = 24, 30, 9
CASES = [
    {}, {"subsample_stride": 1}, {"variant": "real"}, {"variant": "l2"}, {"variant": "noq"}, {"variant": "noq", "manhattan_spatial_dist": False},
    {"manhattan_spatial_dist": False}, {"variant": "lsc"}, {"preemptive": True, "subsample_stride": 1, "preemptive_thres": 0.3}, {"compactness": 0.01},
]


def images():
    rng = np.random.default_rng(7)
    noise = rng.integers(0, 256, (H, W, 3)).astype(np.uint8)
    flat = np.full((H, W, 3), 90, np.uint8)
    y, x = np.mgrid[0:H, 0:W]
    parts = np.stack([(y // 9) * 80, (x // 11) * 70, (y + x) * 4], 2).astype(np.uint8)
    return {0: noise, 1: flat, 2: parts}


@pytest.fixture(scope="module")
def pixels(spark):
    tables = [from_array(spark, image, n) for n, image in images().items()]
    return tables[0].union(tables[1]).union(tables[2]).cache()


def labels_of(df, n):
    return {(r.y, r.x): r.label for r in df.where(F.col("image_id") == n).collect()}


@pytest.mark.parametrize("joined", [False, True])
@pytest.mark.parametrize("case", CASES, ids=lambda c: "-".join(map(str, c.values())) or "plain")
def test_iterate(spark, pixels, monkeypatch, case, joined):
    if joined:
        if case not in ({"variant": "noq"}, {"variant": "lsc"}, CASES[-2], {"compactness": 0.01}):
            pytest.skip("the joins' distances are held against SQL; these cases add only time")
        monkeypatch.setattr(segment, "LOCAL_PIXELS", 0)
    config = SlicConfig(num_components=K, convert_to_lab=False, **case)
    model = Slic(config)
    got = model.iterate(pixels, 5, enforce=False).cache()
    clusters = {(r.image_id, r.number): (r.y, r.x, r.num_members) for r in model.clusters.collect()}
    stale = 0
    for n, image in images().items():
        plain = Model(image.astype(int).tolist(), config)
        plain.run(5)
        assert labels_of(got, n) == plain.label
        assert [clusters[n, k] for k in range(K)] == [pytest.approx((c["y"], c["x"], c["n"])) for c in plain.clusters]
        stale += sum(not any(plain.inside(c, *p) for c in plain.clusters) and k is not None for p, k in plain.label.items())
    if case == {"compactness": 0.01}:
        assert stale, "some pixel keeps a label that no window reaches"


def test_imported_clusters_and_next_frame(spark, pixels):
    """Clusters outside the image come to its border, K follows their number, a new image gets clusters of its own."""
    model = Slic(SlicConfig(num_components=100, convert_to_lab=False))
    spots = [(5.7, 4.2), (-3.0, 50.0), (900.0, 7.0), (12.0, 12.0)]
    given = [(0, 10 + k, y, x, 1.5, 2.0, 3.0, 0) for k, (y, x) in enumerate(spots)]
    model.set_clusters(spark.createDataFrame(given, "image_id int, number int, y double, x double, c0 double, c1 double, c2 double, num_members long"))
    assert model.config.num_components == 4
    assert [r.yx for r in model.get_clusters().orderBy("number").collect()][:2] == [[5, 4], [-3, 50]]
    assert [(r.number, r.y, r.c0) for r in model.to_yxmrgb().orderBy("number").collect()][:1] == [(0, 5, 1)]
    whole = [(float(np.floor(y)), float(np.floor(x))) for y, x in spots]
    plain = Model(images()[0].astype(int).tolist(), model.config, whole)
    plain.run(3)
    assert labels_of(model.iterate(pixels.where("image_id = 0"), 3, enforce=False), 0) == plain.label
    # Image 2 is new, image 0 goes on from where it was, and image 1 keeps nothing as it never was there.
    again = model.iterate(pixels.where("image_id in (0, 2)"), 2, enforce=False)
    plain.label = dict.fromkeys(plain.label)
    plain.run(2)
    other = Model(images()[2].astype(int).tolist(), model.config)
    other.run(2)
    assert labels_of(again, 0) == plain.label and labels_of(again, 2) == other.label
    model.iterate(pixels.where("image_id = 1"), 1, enforce=False)
    assert {r.image_id for r in model.clusters.select("image_id").distinct().collect()} == {0, 1, 2}


def test_capped_adjacency(spark):
    rng = np.random.default_rng(2)
    n = 40
    label = {(y, x): int(v) for (y, x), v in np.ndenumerate(rng.integers(0, n, (20, 25)))}
    df = spark.createDataFrame([(0, y, x, v) for (y, x), v in label.items()], "image_id int, y int, x int, label int")
    nodes = spark.createDataFrame([(0, k) for k in range(n)], "image_id int, number int")
    got = {r.number: r.neighbors for r in as_lists(adjacency(df), nodes).collect()}
    assert got == capped_neighbours(label, 20, 25, n) and max(map(len, got.values())) == 12


def test_recorder(spark, pixels):
    import json

    model = Slic(SlicConfig(num_components=K, convert_to_lab=False, debug_mode=True))
    model.iterate(pixels.where("image_id = 2"), 2, enforce=False)
    seen = [(n, c.count(), [json.loads(r.json) for r in p.limit(3).collect()]) for n, c, p in model.recorder_report()]
    assert [n for n, _, _ in seen] == [-1, 0, 1] and all(c == K for _, c, _ in seen)
    assert "label" not in seen[0][2][0] and {"label", "dist"} <= set(seen[1][2][0])
    assert {"prepare", "iteration 0", "finish"} <= {name for name, _ in model.last_timing_report}
