"""The segmentation library against published values, closed forms and its SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.operators import crf
from terrazzo.operators.components import enforce_connectivity
from terrazzo.operators.graph import adjacency, as_lists, mask_density
from terrazzo.operators.segment import awake_rows, grid_centres, to_lab
from terrazzo.plans import queries
from terrazzo.plans.config import SlicConfig

SF = "/root/testdata/sf0.001"


def test_lab(spark):
    known = {(139, 91, 30): (85, 156, 210), (111, 197, 143): (146, 51, 166), (255, 255, 255): (200, 128, 128), (255, 0, 255): (120, 255, 6), (30, 57, 184): (61, 204, 0), (0, 0, 0): (0, 128, 128), (128, 128, 128): (107, 128, 128)}
    rows = to_lab(spark.createDataFrame([(0, 0, i, *rgb) for i, rgb in enumerate(known)], "image_id int, y int, x int, c0 int, c1 int, c2 int")).orderBy("x").collect()
    assert [(r.c0, r.c1, r.c2) for r in rows] == list(known.values())


def test_whole_number_helpers(spark):
    from terrazzo.functions.scalar import ceil_int, round_int

    rows = spark.sql("select * from values (7L, 2L), (8L, 2L), (10L, 4L), (9L, 4L), (0L, 3L) as t(n, d)")
    got = [(r.a, r.b) for r in rows.select(ceil_int("n", "d").alias("a"), round_int("n", "d").alias("b")).collect()]
    assert got == [(4, 4), (4, 4), (3, 3), (3, 2), (0, 0)]


def test_centres():
    assert grid_centres(60, 100, 5) == [(15, 17), (15, 51), (15, 85), (45, 25), (45, 75)]
    assert grid_centres(10, 10, 3) == [(5, 2), (5, 6), (5, 9)]
    assert grid_centres(4, 4, 10) == [(1, 0), (1, 1), (1, 2), (1, 3), (3, 1), (3, 3)] + [(2, 2)] * 4


def test_config():
    for bad in ({"num_components": 0}, {"num_components": 65534}, {"subsample_stride": 0}, {"variant": "?"}):
        with pytest.raises(ValueError):
            SlicConfig(**bad)
    assert SlicConfig().spatial_table(17)[17] == 19


def label_map(spark, rows):
    return spark.createDataFrame([(0, y, x, int(v)) for y, r in enumerate(rows) for x, v in enumerate(r)], "image_id int, y int, x int, label int")


@pytest.mark.parametrize(
    ("least", "k", "want"),
    [
        (0, 10, ["00000", "11200", "13456", "77556", "78888"]),
        (3, 10, ["00000", "11100", "11122", "33222", "34444"]),
        (0, 3, ["00000", "11100", "11111", "11111", "12222"]),
        (8, 10, ["00000"] * 5),
        (0, None, ["00000", "11200", "13456", "77556", "78888"]),
    ],
)
@pytest.mark.parametrize("local_pixels", [None, 0])
def test_connectivity(spark, least, k, want, local_pixels):
    got = enforce_connectivity(label_map(spark, ["00000", "11900", "19094", "22994", "23333"]), least, k, local_pixels=local_pixels).collect()
    assert {(r.y, r.x): r.label for r in got} == {(y, x): int(v) for y, row in enumerate(want) for x, v in enumerate(row)}


def test_graph(spark):
    clusters = spark.createDataFrame([(0, n, 3) for n in range(3)], "image_id int, number int, num_members long")
    lists = as_lists(adjacency(label_map(spark, ["001", "021", "221"])), clusters).orderBy("number").collect()
    assert [r.neighbors for r in lists] == [[2, 1], [0, 2], [0, 1]]
    masked = spark.createDataFrame([(0, 0, 90)] * 3, "image_id int, label int, mask int")
    assert {r.number: r.density for r in mask_density(masked, clusters).collect()} == {0: 90, 1: 0, 2: 0}


def test_awake_rows(spark):
    """Image 0 rests but for the cell of its first cluster; image 1 has no resting cluster; image 2 rests whole."""
    spots = [(0, 0, 1.0, 1.0, True), (0, 1, 6.0, 6.0, False), (1, 0, 1.0, 1.0, True), (2, 0, 5.0, 1.0, False)]
    clusters = spark.createDataFrame(spots, "image_id int, number int, y double, x double, is_active boolean")
    pixels = spark.createDataFrame([(i, y, x, 0) for i in range(3) for y in range(8) for x in range(8)], "image_id int, y int, x int, s int").selectExpr("image_id", "y", "x", "2 as s", "0 as label")
    grid = spark.createDataFrame([(i, 2) for i in range(3)], "image_id int, s int")
    got = awake_rows(pixels, clusters, grid)
    assert got.columns == pixels.columns
    assert {(r.image_id, r.y, r.x) for r in got.collect()} == {(0, y, x) for y in range(4) for x in range(4)} | {(1, y, x) for y in range(8) for x in range(8)}


def test_crf_step(spark):
    c = crf.SimpleCRF(spark, 2)
    assert (c.first_time, c.last_time, c.pop_frame()) == (-1, -1, -1)
    with pytest.raises(IndexError):
        c.get_frame(0)
    with pytest.raises(ValueError):
        c.inference(1)
    nodes = spark.createDataFrame([(n, 0.0, 0.0, 1, 0.0, 0.0, 0.0) for n in (0, 1)], "node int, y double, x double, num_members long, c0 double, c1 double, c2 double")
    edges = spark.createDataFrame([(0, 1), (1, 0)], "src int, dst int")
    p = {(0, 0): 0.9, (1, 0): 0.1, (0, 1): 0.6, (1, 1): 0.4}
    unary = spark.createDataFrame([(cls, n, -math.log(v)) for (cls, n), v in p.items()], "cls int, node int, u double")
    c.push_frame(nodes, edges, unary)
    c.initialize()
    q = {(r.cls, r.node): r.q for r in c.inference(1).collect()}
    assert q[0, 0] == pytest.approx(0.985186, abs=1e-5)
    assert q[0, 1] == pytest.approx(0.999776, abs=1e-5)


@pytest.mark.parametrize("name", ["rgb_to_lab", "update_once", "density_broadcast", "adjacency_capped", "components", "slic", "slic_preemptive", "slic_lsc", "preemptive_settle", "crf_infer_compat"])
def test_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = db.sql(queries.oracle_sql()[name]).df()[list(got.columns)]
    plain = lambda v: v if isinstance(v, str) else -1.0 if v is None or v != v else round(float(v), 5)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d.values.tolist())
    assert rows(got) == rows(want)


def test_connectivity_both_ways(spark):
    """One task an image and joins of runs agree, with the largest label as bound and without."""
    rng = np.random.default_rng(4)
    rows = [(n, y, x, int(v)) for n in range(3) for (y, x), v in np.ndenumerate(np.kron(rng.integers(0, 4, (9, 8)), np.ones((2 + n, 2), int)))]
    maps = spark.createDataFrame(rows, "image_id int, y int, x int, label int").withColumn("label", F.when(F.col("label") > 0, F.col("label")))
    for least, k in ((5, None), (0, 6)):
        one, two = (sorted(map(tuple, enforce_connectivity(maps, least, k, local_pixels=n).collect())) for n in (None, 0))
        assert one == two and len(one) == len(rows)


def test_frames(spark):
    """Frames keep what is set on them, each for itself."""
    c = crf.SimpleCRF(spark, 3)
    node = "node int, y double, x double, num_members long, c0 double, c1 double, c2 double"
    nodes = spark.createDataFrame([(n, 1.0, 1.0, 5, 2.0, 3.0, 4.0) for n in (0, 1)], node)
    none = spark.createDataFrame([], "src int, dst int")
    assert [c.push_frame(nodes, none) for _ in range(2)] == [0, 1]
    c.set_connectivity(1, spark.createDataFrame([(0, 1)], "src int, dst int"))
    assert c.get_connectivity(0).count() == 0 and [tuple(r) for r in c.get_connectivity(1).collect()] == [(0, 1)]
    c.set_yxmrgb(0, spark.createDataFrame([(n, 7.9, 2.0, 6, 1.0, 1.0, 1.0) for n in (0, 1)], node))
    assert {r.y for r in c.get_yxmrgb(0).collect()} == {7} and {r.y for r in c.get_yxmrgb(1).collect()} == {1}
    c.set_mask(0, spark.createDataFrame([(0, 0), (1, 2)], "node int, cls int"), 0.5)
    u = {(r.cls, r.node): r.u for r in c.get_frame(0)["unary"].collect()}
    assert u[0, 0] == pytest.approx(-math.log(2 / 3)) and u[0, 1] == pytest.approx(-math.log(1 / 6))
    assert {round(r.u, 6) for r in c.get_frame(1)["unary"].collect()} == {round(math.log(3), 6)}
    c.set_proba(1, spark.createDataFrame([(k, n, p) for k, p in enumerate((0.0, 0.25, 0.75)) for n in (0, 1)], "cls int, node int, p double"))
    assert {r.q for r in c.get_inferred(1).collect()} == {0.0}
    c.reset_inferred(1)
    assert {(r.cls, round(r.q, 6)) for r in c.get_inferred(1).collect()} == {(0, 0.0), (1, 0.25), (2, 0.75)} and {r.q for r in c.get_inferred(0).collect()} == {0.0}
    c.set_unbiased(0)
    assert c.pop_frame() == 0 and (c.first_time, c.num_frames) == (1, 1)
    two = spark.createDataFrame([(i, 0, 1.5, 2.0, 1, 0.0, 0.0, 0.0) for i in (0, 1)], "image_id int, number int, y double, x double, num_members long, c0 double, c1 double, c2 double")
    edges = spark.createDataFrame([], "image_id int, src int, dst int")
    with pytest.raises(ValueError):
        c.push_slic_frame(two, edges)
    assert c.get_yxmrgb(c.push_slic_frame(two, edges, 1)).first().y == 1


def test_stream(spark, tmp_path):
    """A stream that stops and starts anew goes on from the clusters that it left."""
    from terrazzo.operators.segment import Slic
    from terrazzo.sources.raster import from_array
    from terrazzo.streaming.warm_start import segment_stream

    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (12, 16, 3)).astype(np.uint8) for _ in range(3)]
    schema = "image_id int, y int, x int, c0 int, c1 int, c2 int, frame int"
    config, seen = SlicConfig(num_components=4, convert_to_lab=False), {}

    def sink(labels, batch):
        for r in labels.collect():
            seen.setdefault(r.frame, {})[r.y, r.x] = r.label

    for n, image in enumerate(images):  # a new query and a new model for each frame
        from_array(spark, image).withColumn("frame", F.lit(n)).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        segment_stream(stream, Slic(config), sink, str(tmp_path / "state"), 2).awaitTermination()
    model = Slic(config)
    for n, image in enumerate(images):
        assert {(r.y, r.x): r.label for r in model.iterate(from_array(spark, image), 2).collect()} == seen[n]


def test_sources(spark, tmp_path):
    from terrazzo.sources.raster import from_array, from_binary

    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert [tuple(r)[1:] for r in from_array(spark, image).orderBy("y", "x").collect()][5] == (1, 1, 15, 16, 17)
    with pytest.raises(ValueError):
        from_array(spark, image[:, :, :2])
    one = spark.createDataFrame([(0, ("x", 2, 4, 3, 16, bytearray(image[:, :, ::-1].tobytes())))], "image_id int, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>")
    assert sorted(map(tuple, from_binary(one).collect())) == sorted(map(tuple, from_array(spark, image).collect()))
