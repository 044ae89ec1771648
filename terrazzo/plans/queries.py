"""One query for each operator over the raster view of lineitem, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions.scalar import XYZ, gamma_table, lightness_table, rgb_to_lab_float
from terrazzo.operators import crf
from terrazzo.operators.components import component_areas, enforce_connectivity
from terrazzo.operators.graph import adjacency, as_lists, broadcast_density, mask_density, nearest
from terrazzo.operators.local import split_local, step_local
from terrazzo.operators.lsc import FeatureField, features
from terrazzo.operators.segment import Slic, assign, awake_rows, frames, grid_centres, grid_fits, initialize, prepare, sample_colour, settle, to_lab, update
from terrazzo.plans.config import SlicConfig
from terrazzo.plans.iterated import Iterated
from terrazzo.plans.lineage import cut
from terrazzo.sources.raster import HEIGHT, WIDTH, lineitem_raster

K, CLASSES = 24, 3
BASE = SlicConfig(num_components=K, subsample_stride=1)
RGB = BASE.copy(convert_to_lab=False)
#: The iterated queries: their settings and iterations.
ITERATED = {
    "slic": (SlicConfig(num_components=K), 10), "slic_preemptive": (SlicConfig(num_components=K, preemptive=True, preemptive_thres=0.3), 6),
    "slic_lsc": (SlicConfig(num_components=K, variant="lsc"), 3), "slic_labels": (RGB.copy(subsample_stride=3, compactness=0.05), 4),
}
#: Neighbours that the capped query leaves a region, few enough to bind.
CAP = 5
COMPAT = {0: 0.5, 1: 1.0, 2: 2.0}
S = BASE.spacing(HEIGHT, WIDTH)


def _start(spark: SparkSession, sf_dir: str, config: SlicConfig = RGB) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    raster = lineitem_raster(spark, sf_dir)
    pixels = raster.drop("mask")
    grid = frames(pixels, config)
    image = prepare(to_lab(pixels) if config.convert_to_lab else pixels, grid)
    return raster, image, grid, initialize(image, grid, K)


def _labels(df: DataFrame) -> DataFrame:
    return df.select("image_id", "y", "x", "label")


def rgb_to_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_lab(lineitem_raster(spark, sf_dir).drop("mask"))


def row_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_raster(spark, sf_dir).drop("mask").where("y % 3 = 1")


def init_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _start(spark, sf_dir)[3].select("image_id", "number", "y", "x", "c0", "c1", "c2")


def _assign_once(variant: str, **more) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, image, grid, clusters = _start(spark, sf_dir)
        return _labels(assign(image, clusters, grid, RGB.copy(variant=variant, **more)))

    return query


def _first(spark: SparkSession, sf_dir: str, config: SlicConfig = RGB, until: str = "update", give: tuple[str, ...] = ("labels", "clusters")) -> tuple[DataFrame, DataFrame | None, DataFrame, DataFrame | None, bool]:
    """The raster, the pixels' labels, the grid and the clusters after the first steps (see ``step_local``), and whether
    images are one task's work each. Of labels and clusters only those to ``give`` are there; clusters are written, and
    labels too if both are given."""
    raster = lineitem_raster(spark, sf_dir)
    pixels = raster.drop("mask")
    grid = frames(pixels, config)
    local = grid_fits(grid)
    if local:
        found = step_local(pixels, config, until, give)
        labels, clusters = split_local(cut(found) if "clusters" in give else found, ("features",) if config.variant == "lsc" else ())
        return raster, labels if "labels" in give else None, grid, clusters if "clusters" in give else None, True
    image = prepare(pixels, grid)
    clusters = cut(initialize(image, grid, K))
    field = None
    if config.variant == "lsc":
        field = FeatureField(image, grid, config)
        clusters = field.seed(clusters)
    if until == "seed":
        return raster, None, grid, clusters, False
    done = field.assign(field.image, clusters) if field else assign(image, clusters, grid, config)
    if until == "update":
        done = cut(done)
        clusters = cut(field.update(done, clusters) if field else update(done, clusters, config))
    return raster, _labels(done), grid, clusters, False


def _updated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return _first(spark, sf_dir)[:4]


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The grid and the clusters after an update."""
    return _first(spark, sf_dir, give=("clusters",))[2:4]


def _first_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """Labels of a first assignment, and whether images are one task's work each."""
    _, labels, _, _, local = _first(spark, sf_dir, until="assign", give=("labels",))
    return labels if local else cut(labels), local


def update_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir)[1].select("image_id", "number", "y", "x", "c0", "c1", "c2", "num_members")


def adjacency_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, local = _first_labels(spark, sf_dir)
    return adjacency(labels, None, local).select("image_id", "src", "dst")


def adjacency_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, done, _, clusters, local = _first(spark, sf_dir)
    lists = as_lists(adjacency(done, CAP, local), clusters)
    return lists.select("image_id", "number", F.array_join(F.transform("neighbors", lambda n: n.cast("string")), ",").alias("neighbors"))


def knn_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, clusters = _moved(spark, sf_dir)
    return nearest(clusters, grid, 4)


def density_of_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster, done, _, clusters = _updated(spark, sf_dir)
    masked = done.join(raster.select("image_id", "y", "x", "mask"), ["image_id", "y", "x"])
    return mask_density(masked, clusters)


def density_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster, done, _, clusters = _updated(spark, sf_dir)
    masked = done.join(raster.select("image_id", "y", "x", "mask"), ["image_id", "y", "x"])
    return broadcast_density(_labels(done), mask_density(masked, clusters))


def _iterate(name: str, enforce: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        config, max_iter = ITERATED[name]
        return Slic(config).iterate(lineitem_raster(spark, sf_dir).drop("mask"), max_iter, enforce)

    return query


def lab_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = rgb_to_lab_float("c0", "c1", "c2")
    return lineitem_raster(spark, sf_dir).select("image_id", "y", "x", *(F.round(c, 6).alias(n) for c, n in zip(lab, ("l", "a", "b"), strict=True)))


def clusters_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters set by hand, numbered anew, some outside their image, and moved inside with new colours."""
    _, image, grid, clusters = _start(spark, sf_dir)
    model = Slic(RGB)
    model.set_clusters(clusters.where("number % 2 = 0").withColumns({"y": F.col("y") * 2 - 20.5, "x": F.col("x") * 1.5 + 0.25}))
    return sample_colour(model.clusters, image, grid).select("image_id", "number", *(F.col(c).cast("int").alias(c) for c in ("y", "x", "c0", "c1", "c2")))


def clusters_yxmrgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Slic(RGB)
    model.clusters = _noq(spark, sf_dir)[1]
    return model.to_yxmrgb()


def _noq(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    config = RGB.copy(variant="noq")
    _, image, grid, clusters = _start(spark, sf_dir)
    done = cut(assign(image, clusters, grid, config))
    return done, cut(update(done, clusters, config))


def noq_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = [F.round(c, 6).alias(c) for c in ("y", "x", "c0", "c1", "c2")]
    return _noq(spark, sf_dir)[1].select("image_id", "number", *mean, "num_members")


def preemptive_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookkeeping after an update, with clusters that are frozen, cooling and free by their number."""
    _, image, grid, clusters = _start(spark, sf_dir)
    before = cut(clusters.withColumn("is_updatable", (F.col("number") % 3).cast("int")))
    after = cut(update(cut(assign(image, before, grid, RGB)), before, RGB))
    return settle(after, before, grid, RGB).select("image_id", "number", "y", "x", "num_members", "is_active", F.col("is_updatable").cast("int").alias("is_updatable"))


def preemptive_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pixels of each image an update counts where one cluster in seven is active."""
    _, image, grid, clusters = _start(spark, sf_dir)
    few = clusters.withColumn("is_active", F.col("number") % 7 == 0)
    return awake_rows(image, few, grid).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("y") * WIDTH + F.col("x")).alias("places"))


LSC = RGB.copy(variant="lsc")


def _rounded_features(clusters: DataFrame) -> DataFrame:
    return clusters.select("image_id", "number", *((F.round(F.col("features")[k], 6) + 0.0).alias(f"f{k}") for k in range(10)))


def lsc_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_features(_first(spark, sf_dir, LSC, "seed", ("clusters",))[3])


def lsc_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir, LSC, "assign", ("labels",))[1]


def lsc_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_features(_first(spark, sf_dir, LSC, give=("clusters",))[3])


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_areas(*_first_labels(spark, sf_dir))


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enforce_connectivity(_labels(_updated(spark, sf_dir)[1]), BASE.min_size(S), K)


def lsc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = features(_start(spark, sf_dir)[1], RGB.compactness)
    return image.select("image_id", "y", "x", F.round("weight", 6).alias("weight"), *((F.round(F.col("features")[k], 6) + 0.0).alias(f"f{k}") for k in range(10)))


def _crf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images as frames: nodes, 4-nearest edges, and costs by the class number % CLASSES."""
    grid, clusters = _moved(spark, sf_dir)
    nodes = clusters.select(F.col("image_id").alias("time"), F.col("number").alias("node"), "y", "x", "num_members", "c0", "c1", "c2")
    edges = nearest(clusters, grid, 4).select(F.col("image_id").alias("time"), "src", "dst")
    return nodes, edges, crf.from_mask(nodes.select("time", "node", (F.col("node") % CLASSES).alias("cls")), CLASSES, 0.5)


def crf_unary_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crf(spark, sf_dir)[2].select("time", "cls", "node", F.round("u", 6).alias("u"))


def crf_spatial_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = _crf(spark, sf_dir)
    return crf.spatial_pairs(nodes, edges, crf.CRFParams()).select("time", "src", "dst", F.round("e", 6).alias("e"))


def crf_temporal_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.temporal_pairs(_crf(spark, sf_dir)[0], crf.CRFParams()).select("time", "node", "other", F.round("e", 6).alias("e"))


def crf_infer_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, unary = _crf(spark, sf_dir)
    p = crf.CRFParams()
    q = crf.infer_once(unary, crf.reset(unary), crf.spatial_pairs(nodes, edges, p), crf.temporal_pairs(nodes, p))
    return q.select("time", "cls", "node", F.round("q", 6).alias("q"))


def crf_unbiased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.unbiased(_crf(spark, sf_dir)[0], CLASSES).select("time", "cls", "node", F.round("u", 6).alias("u"))


def crf_unary_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of probabilities, 0 among them; an infinite cost is shown as -1."""
    nodes = _crf(spark, sf_dir)[0]
    each = nodes.select("time", "node", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))).alias("cls"))
    u = crf.from_proba(each.withColumn("p", (F.col("node") + F.col("cls")) % 5 / 5.0))
    return u.select("time", "cls", "node", F.when(F.col("u") == float("inf"), -1.0).otherwise(F.round("u", 6)).alias("u"))


def _crf_model(spark: SparkSession, sf_dir: str, compat: dict[int, float] | None) -> crf.SimpleCRF:
    """All images as frames of one model, their tables set at once."""
    nodes, edges, unary = (cut(x) for x in _crf(spark, sf_dir))
    model = crf.SimpleCRF(spark, CLASSES, compat=compat)
    model.nodes, model.edges = nodes.select(*model.nodes.columns), edges.select(*model.edges.columns)
    model.unary, model.times = unary, sorted(r[0] for r in nodes.select("time").distinct().collect())
    model.initialize()
    return model


def _crf_twice(compat: dict[int, float] | None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _crf_model(spark, sf_dir, compat).inference(2).select("time", "cls", "node", F.round("q", 6).alias("q"))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        rgb_to_lab, lab_float, row_subsample, init_clusters, clusters_set, clusters_yxmrgb, update_once, noq_update, adjacency_uncapped, adjacency_capped,
        knn_l1, density_of_mask, density_broadcast, components, connectivity, lsc_features, lsc_seed, lsc_assign, lsc_update, preemptive_settle,
        preemptive_pixels, crf_unbiased, crf_unary_mask, crf_unary_proba, crf_spatial_energy, crf_temporal_energy, crf_infer_once,
    )
    found = {f.__name__: f for f in plain}
    found |= {f"{v}_assign": _assign_once(v) for v in ("slic", "real", "l2", "noq")}
    found |= {"slic_euclid_assign": _assign_once("slic", manhattan_spatial_dist=False), "noq_squares_assign": _assign_once("noq", manhattan_spatial_dist=False)}
    found |= {name: _iterate(name, name != "slic_labels") for name in ITERATED}
    return found | {"crf_infer_twice": _crf_twice(None), "crf_infer_compat": _crf_twice(COMPAT)}


_RASTER = f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount,
    l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS i FROM lineitem),
raster AS (SELECT (i // {HEIGHT * WIDTH})::INT AS image_id, ((i % {HEIGHT * WIDTH}) // {WIDTH})::INT AS y, (i % {WIDTH})::INT AS x,
    trunc(l_quantity)::INT AS q, trunc(l_extendedprice)::BIGINT AS e, l_discount FROM numbered),
pixels AS (SELECT image_id, y, x, least(255, 3 * y + q)::INT AS c0, least(255, 2 * x + q)::INT AS c1, (e % 256)::INT AS c2,
    trunc(l_discount * 1000)::INT AS mask FROM raster)"""
_CENTRES = ", ".join(f"({n}, {y}, {x})" for n, (y, x) in enumerate(grid_centres(HEIGHT, WIDTH, K)))
_CLUSTERS = f"""{_RASTER},
centres(number, y, x) AS (VALUES {_CENTRES}),
clusters AS (SELECT p.image_id, c.number, p.y, p.x, p.c0, p.c1, p.c2 FROM centres c JOIN pixels p ON p.y = c.y AND p.x = c.x)"""
_T = 2 * S + 32
_COEF = RGB.spatial_coefficient(S)
_TABLE = "[" + ", ".join(map(str, RGB.spatial_table(S))) + "]"


def _assigned(dist: str) -> str:
    return f"""{_CLUSTERS},
near AS (SELECT p.image_id, p.y, p.x, p.mask, p.c0, p.c1, p.c2, c.number AS label, row_number() OVER (PARTITION BY p.image_id, p.y, p.x ORDER BY {dist},
    2 * ((c.y // {_T}) % 2) + (c.x // {_T}) % 2, c.y // {_T}, c.x // {_T}, c.number) AS rn
  FROM pixels p LEFT JOIN clusters c ON c.image_id = p.image_id AND abs(p.y - c.y) <= {S} AND abs(p.x - c.x) <= {S}),
labels AS (SELECT image_id, y, x, mask, c0, c1, c2, label FROM near WHERE rn = 1)"""


_L1 = "abs(p.c0 - c.c0) + abs(p.c1 - c.c1) + abs(p.c2 - c.c2)"
_L2 = "(p.c0 - c.c0) * (p.c0 - c.c0) + (p.c1 - c.c1) * (p.c1 - c.c1) + (p.c2 - c.c2) * (p.c2 - c.c2)"
_STEP = "abs(p.y - c.y) + abs(p.x - c.x)"
_SLIC = _assigned(f"({_TABLE})[{_STEP} + 1] + {_L1}")
_MEAN = lambda f: f"((sum({f}) + (count(*) // 2)) // count(*))::DOUBLE AS {f}"
_UPDATED = f"""{_SLIC},
means AS (SELECT image_id, label AS number, {", ".join(map(_MEAN, ("y", "x", "c0", "c1", "c2")))}, count(*) AS num_members
  FROM labels WHERE label IS NOT NULL GROUP BY ALL),
moved AS (SELECT c.image_id, c.number, {", ".join(f"coalesce(m.{f}, c.{f}::DOUBLE) AS {f}" for f in ("y", "x", "c0", "c1", "c2"))},
    coalesce(m.num_members, 0) AS num_members FROM clusters c LEFT JOIN means m ON m.image_id = c.image_id AND m.number = c.number)"""
_DENSITY = f"""{_UPDATED},
density AS (SELECT m.image_id, m.number, least(255, coalesce(t.total, 0) // greatest(m.num_members, 1))::INT AS density
  FROM moved m LEFT JOIN (SELECT image_id, label, sum(mask)::BIGINT AS total FROM labels GROUP BY ALL) t ON t.image_id = m.image_id AND t.label = m.number)"""
_KNN = f"""{_UPDATED},
knn AS (SELECT * FROM (SELECT a.image_id, a.number AS src, b.number AS dst,
    row_number() OVER (PARTITION BY a.image_id, a.number ORDER BY abs(a.y - b.y) + abs(a.x - b.x), b.number) AS ord
  FROM moved a JOIN moved b ON a.image_id = b.image_id AND a.number <> b.number AND abs(a.y - b.y) <= {3 * S} AND abs(a.x - b.x) <= {3 * S})
  WHERE ord <= 4)"""
# Least run numbers spread downwards from runs with nothing of their label above; a run's number is its first pixel's.
_RUNS = f"""steps AS (SELECT image_id, y, x, coalesce(label, -1) AS label,
    (coalesce(label, -1) IS DISTINCT FROM lag(coalesce(label, -1)) OVER (PARTITION BY image_id, y ORDER BY x))::INT AS new FROM labels),
runs AS (SELECT image_id, y, label, min(x) AS lo, max(x) AS hi, y * {WIDTH} + min(x) AS pos
  FROM (SELECT *, sum(new) OVER (PARTITION BY image_id, y ORDER BY x) AS run FROM steps) GROUP BY image_id, y, run, label),
pairs AS (SELECT a.image_id, a.pos AS a, b.pos AS b FROM runs a
  JOIN runs b ON b.image_id = a.image_id AND b.label = a.label AND b.y = a.y + 1 AND a.lo <= b.hi AND b.lo <= a.hi),
touching AS (SELECT image_id, a, b FROM pairs UNION ALL SELECT image_id, b, a FROM pairs),
reach AS (SELECT image_id, pos AS root, pos FROM runs ANTI JOIN (SELECT image_id, b AS pos FROM pairs) USING (image_id, pos)
  UNION SELECT r.image_id, r.root, t.b FROM reach r JOIN touching t ON t.image_id = r.image_id AND t.a = r.pos),
named AS (SELECT runs.*, m.comp FROM runs JOIN (SELECT image_id, pos, min(root) AS comp FROM reach GROUP BY ALL) m USING (image_id, pos)),
areas AS (SELECT image_id, comp, label, sum(hi - lo + 1)::BIGINT AS area FROM named GROUP BY ALL)"""
_ABSORB = f"""kept AS (SELECT image_id, comp, row_number() OVER (PARTITION BY image_id ORDER BY comp) - 1 AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, comp) AS place FROM areas WHERE area >= {BASE.min_size(S)}) WHERE place <= {K}),
gone AS (SELECT image_id, comp, CASE WHEN comp % {WIDTH} > 0 THEN comp - 1 ELSE comp - {WIDTH} END AS beside FROM areas ANTI JOIN kept USING (image_id, comp)),
beside AS (SELECT g.image_id, g.comp, n.comp AS parent FROM gone g
  JOIN named n ON n.image_id = g.image_id AND n.y = g.beside // {WIDTH} AND g.beside % {WIDTH} BETWEEN n.lo AND n.hi WHERE g.beside >= 0),
ends AS (SELECT * FROM kept UNION ALL SELECT image_id, comp, 0 FROM gone WHERE beside < 0),
final AS (SELECT * FROM ends UNION ALL SELECT b.image_id, b.comp, f.label FROM final f JOIN beside b ON b.image_id = f.image_id AND b.parent = f.comp)"""
_COMPONENTS = f"{_SLIC},\n{_RUNS}"
_ABSORBED = f"{_COMPONENTS},\n{_ABSORB}"
_FINAL = "SELECT n.image_id, n.y, unnest(range(n.lo, n.hi + 1))::INT AS x, f.label::INT AS label FROM named n JOIN final f ON f.image_id = n.image_id AND f.comp = n.comp"
_ACTIVE = 1 / CLASSES + (1 - 1 / CLASSES) * 0.5
_SQ = lambda fields, scale: " + ".join(f"((a.{f} - b.{f}) / {scale}) * ((a.{f} - b.{f}) / {scale})" for f in fields)
_CRF = f"""{_KNN},
classes(cls) AS (VALUES {", ".join(f"({c})" for c in range(CLASSES))}),
un AS (SELECT image_id AS time, cls, number AS node, -ln(CASE WHEN number % {CLASSES} = cls THEN {_ACTIVE} ELSE {(1 - _ACTIVE) / (CLASSES - 1)} END) AS u
  FROM moved, classes),
se AS (SELECT k.image_id AS time, k.src, k.dst, 10.0 * exp(-0.5 * ({_SQ(("c0", "c1", "c2"), "13.0::DOUBLE")}) - 0.5 * ({_SQ(("y", "x"), "80.0::DOUBLE")})) AS e,
    sqrt(b.num_members / greatest(a.num_members, 1)) AS r
  FROM knn k JOIN moved a ON a.image_id = k.image_id AND a.number = k.src JOIN moved b ON b.image_id = k.image_id AND b.number = k.dst),
te AS (SELECT a.image_id AS time, a.number AS node, b.image_id AS other, 10.0 * exp(-0.5 * ({_SQ(("c0", "c1", "c2"), "13.0::DOUBLE")})) AS e,
    sqrt(b.num_members / greatest(a.num_members, 1)) AS r FROM moved a JOIN moved b ON a.number = b.number AND abs(a.image_id - b.image_id) = 1)"""


def _lab_steps() -> str:
    gamma = "[" + ", ".join(map(str, gamma_table())) + "]"
    light = "[" + ", ".join(map(str, lightness_table())) + "]"
    return f"""{_RASTER},
tables AS (SELECT {gamma} AS g, {light} AS f),
linear AS (SELECT image_id, y, x, g[c0 + 1] AS r, g[c1 + 1] AS gr, g[c2 + 1] AS b FROM pixels, tables),
xyz AS (SELECT image_id, y, x, f[((28440 * r + 24656 * gr + 12442 * b) >> 16) + 1] AS fx, f[((13938 * r + 46868 * gr + 4730 * b) >> 16) + 1] AS fy,
    f[((1164 * r + 7175 * gr + 57202 * b) >> 16) + 1] AS fz FROM linear, tables),
lab AS (SELECT image_id, y, x, least(255, greatest(0, floor((116 * fy - 131072) / 4096.0)))::INT AS c0,
    least(255, greatest(0, floor((500 * (fx - fy) + 1048576) / 4096.0) - 128))::INT AS c1,
    least(255, greatest(0, floor((200 * (fy - fz) + 1048576) / 4096.0) - 128))::INT AS c2 FROM xyz)"""


def _lab_float_sql() -> str:
    level = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
    mixed = lambda row: " + ".join(f"{k / 65536!r}::DOUBLE * {c}" for k, c in zip(row, ("r", "g", "b"), strict=True))
    bent = lambda v: f"CASE WHEN {v} > 0.008856 THEN pow({v}, {1 / 3!r}::DOUBLE) ELSE 7.787::DOUBLE * {v} + {16 / 116!r}::DOUBLE END"
    return f"""WITH {_RASTER},
linear AS (SELECT image_id, y, x, {level("c0")} AS r, {level("c1")} AS g, {level("c2")} AS b FROM pixels),
mixed AS (SELECT image_id, y, x, {mixed(XYZ[0])} AS vx, {mixed(XYZ[1])} AS vy, {mixed(XYZ[2])} AS vz FROM linear),
bent AS (SELECT image_id, y, x, {bent("vx")} AS fx, {bent("vy")} AS fy, {bent("vz")} AS fz FROM mixed)
SELECT image_id, y, x, round(116.0::DOUBLE * fy - 16.0, 6) AS l, round(500.0::DOUBLE * (fx - fy), 6) AS a, round(200.0::DOUBLE * (fy - fz), 6) AS b FROM bent"""


def _iterated_sql(name: str) -> str:
    config, max_iter = ITERATED[name]
    source = f"{_lab_steps()},\npx AS MATERIALIZED (SELECT * FROM lab)" if config.convert_to_lab else f"{_RASTER},\npx AS MATERIALIZED (SELECT image_id, y, x, c0, c1, c2 FROM pixels)"
    steps = f"WITH RECURSIVE {source},\n{Iterated(config, HEIGHT, WIDTH).steps(max_iter)}"
    if name == "slic_labels":
        return f"{steps} SELECT image_id, y, x, label FROM labels"
    return f"{steps},\n{_RUNS},\n{_ABSORB} {_FINAL}"


def _infer(step: int, compat: dict[int, float]) -> str:
    """CTEs from q{step} to q{step + 1}."""
    weight = "CASE cls " + " ".join(f"WHEN {c} THEN {w}::DOUBLE" for c, w in compat.items()) + " ELSE 1.0::DOUBLE END" if compat else "1.0::DOUBLE"
    return f"""msg{step} AS (SELECT time, cls, node, sum(m) AS m FROM (
  SELECT se.time, q.cls, se.src AS node, se.e * q.q * se.r AS m FROM se JOIN q{step} q ON q.time = se.time AND q.node = se.dst
  UNION ALL SELECT te.time, q.cls, te.node, te.e * q.q * te.r FROM te JOIN q{step} q ON q.time = te.other AND q.node = te.node) GROUP BY ALL),
all{step} AS (SELECT un.time, un.cls, un.node, un.u, coalesce(msg.m, 0) * ({weight.replace("cls", "un.cls", 1)}) AS wm
  FROM un LEFT JOIN msg{step} msg ON msg.time = un.time AND msg.cls = un.cls AND msg.node = un.node),
ex{step} AS (SELECT time, cls, node, exp(-(u + sum(wm) OVER (PARTITION BY time, node) - wm)) AS e FROM all{step}),
q{step + 1} AS MATERIALIZED (SELECT time, cls, node, e / greatest(sum(e) OVER (PARTITION BY time, node), 1e-5) AS q FROM ex{step})"""


def _twice_sql(compat: dict[int, float]) -> str:
    return f"WITH {_CRF},\nq0 AS (SELECT time, cls, node, exp(-u) AS q FROM un),\n{_infer(0, compat)},\n{_infer(1, compat)} SELECT time, cls, node, round(q, 6) AS q FROM q2"


def _capped_sql() -> str:
    """First meetings in raster order, gone through one by one with the degrees so far."""
    degrees = f"list_transform(range({K}), lambda n: 0)"
    return f"""WITH RECURSIVE {_SLIC},
t AS (SELECT image_id, y, x, label, lead(label) OVER (PARTITION BY image_id, y ORDER BY x) AS rt FROM labels),
met AS (SELECT a.image_id, a.label AS src, unnest([a.rt, b.label, b.rt]) AS dst, unnest([0, 1, 2]) + 3 * (a.y * {WIDTH} + a.x) AS ord
  FROM t a JOIN t b ON b.image_id = a.image_id AND b.y = a.y + 1 AND b.x = a.x WHERE a.x < {WIDTH - 1}),
firsts AS (SELECT image_id, least(src, dst) AS lo, greatest(src, dst) AS hi, min(ord) AS ord FROM met
  WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY ALL),
turns AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS turn FROM firsts),
walk AS (SELECT DISTINCT image_id, 0::BIGINT AS turn, {degrees} AS deg, false AS taken, -1 AS lo, -1 AS hi FROM turns
  UNION ALL SELECT w.image_id, t.turn,
    CASE WHEN w.deg[t.lo + 1] < {CAP} AND w.deg[t.hi + 1] < {CAP} THEN list_transform(w.deg, lambda d, i: d + CASE WHEN i = t.lo + 1 OR i = t.hi + 1 THEN 1 ELSE 0 END) ELSE w.deg END,
    w.deg[t.lo + 1] < {CAP} AND w.deg[t.hi + 1] < {CAP}, t.lo, t.hi
  FROM walk w JOIN turns t ON t.image_id = w.image_id AND t.turn = w.turn + 1),
pairs AS (SELECT image_id, turn, lo AS src, hi AS dst FROM walk WHERE taken UNION ALL SELECT image_id, turn, hi, lo FROM walk WHERE taken),
lists AS (SELECT image_id, src AS number, string_agg(dst::VARCHAR, ',' ORDER BY turn) AS neighbors FROM pairs GROUP BY ALL)
SELECT c.image_id, c.number, coalesce(l.neighbors, '') AS neighbors FROM clusters c LEFT JOIN lists l ON l.image_id = c.image_id AND l.number = c.number"""


def _more_sql() -> dict[str, str]:
    f10 = lambda t: ", ".join(f"round({t}f{k}, 6) + 0.0::DOUBLE AS f{k}" for k in range(10))
    lsc = Iterated(RGB.copy(variant="lsc", subsample_stride=1), HEIGHT, WIDTH)
    lsc_steps = f"WITH {_RASTER},\npx AS MATERIALIZED (SELECT image_id, y, x, c0, c1, c2 FROM pixels),\n{lsc.start()}"
    once = f"{lsc_steps},\n{lsc.assign(0, 'labels1', 'true')}"
    far = _assigned(f"{_L1} + {_COEF!r}::DOUBLE * ({_STEP})")
    means = ", ".join(f"sum({f}) / count(*)::DOUBLE AS {f}" for f in ("y", "x", "c0", "c1", "c2"))
    noq = f"""{far},
means AS (SELECT image_id, label AS number, {means}, count(*) AS num_members FROM labels WHERE label IS NOT NULL GROUP BY ALL),
moved AS (SELECT c.image_id, c.number, {", ".join(f"coalesce(m.{f}, c.{f}::DOUBLE) AS {f}" for f in ("y", "x", "c0", "c1", "c2"))}, coalesce(m.num_members, 0) AS num_members
  FROM clusters c LEFT JOIN means m ON m.image_id = c.image_id AND m.number = c.number)"""
    limit, wide = max(int(2 * S * RGB.preemptive_thres + 0.5), 1), 2 * S
    settled = f"""{_SLIC},
means AS (SELECT image_id, label AS number, {", ".join(map(_MEAN, ("y", "x")))}, count(*) AS n FROM labels WHERE label IS NOT NULL GROUP BY ALL),
after AS (SELECT c.image_id, c.number, c.number % 3 AS upd, c.y AS oy, c.x AS ox, m.n,
    CASE WHEN c.number % 3 > 0 AND m.n IS NOT NULL THEN m.y ELSE c.y::DOUBLE END AS y, CASE WHEN c.number % 3 > 0 AND m.n IS NOT NULL THEN m.x ELSE c.x::DOUBLE END AS x
  FROM clusters c LEFT JOIN means m ON m.image_id = c.image_id AND m.number = c.number),
cooled AS (SELECT *, CASE WHEN upd = 0 THEN 0 WHEN abs(y - oy) + abs(x - ox) < {limit} THEN upd - 1 ELSE 2 END::INT AS is_updatable FROM after)"""
    active = f"EXISTS (SELECT 1 FROM cooled o WHERE o.image_id = c.image_id AND o.is_updatable > 0 AND abs(o.y - c.y) <= {wide} AND abs(o.x - c.x) <= {wide})"
    squares = f"{_L2} + {_COEF!r}::DOUBLE * {_COEF!r}::DOUBLE * ((p.y - c.y) * (p.y - c.y) + (p.x - c.x) * (p.x - c.x))"
    return {
        "lab_float": _lab_float_sql(),
        "noq_squares_assign": f"WITH {_assigned(squares)} SELECT image_id, y, x, label FROM labels",
        "noq_update": f"WITH {noq} SELECT image_id, number, {', '.join(f'round({f}, 6) AS {f}' for f in ('y', 'x', 'c0', 'c1', 'c2'))}, num_members FROM moved",
        "clusters_yxmrgb": f"WITH {noq} SELECT image_id, number, {', '.join(f'trunc({f})::INT AS {f}' for f in ('y', 'x', 'num_members', 'c0', 'c1', 'c2'))} FROM moved",
        "clusters_set": f"""WITH {_CLUSTERS},
given AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY number) - 1 AS number, floor(y * 2 - 20.5) AS y, floor(x * 1.5 + 0.25) AS x FROM clusters WHERE number % 2 = 0),
inside AS (SELECT image_id, number, least(greatest(y, 0), {HEIGHT - 1})::INT AS y, least(greatest(x, 0), {WIDTH - 1})::INT AS x FROM given)
SELECT i.image_id, i.number::INT AS number, i.y, i.x, p.c0, p.c1, p.c2 FROM inside i JOIN pixels p ON p.image_id = i.image_id AND p.y = i.y AND p.x = i.x""",
        "preemptive_settle": f"""WITH {settled}
SELECT image_id, number, y, x, CASE WHEN upd > 0 THEN coalesce(n, 0) ELSE 0 END::BIGINT AS num_members, {active} AS is_active, is_updatable FROM cooled c""",
        "preemptive_pixels": f"""WITH {_CLUSTERS} SELECT image_id, count(*) AS n, sum(y * {WIDTH} + x)::BIGINT AS places FROM pixels
WHERE (image_id, y // {wide}, x // {wide}) IN (SELECT (image_id, y // {wide}, x // {wide}) FROM clusters WHERE number % 7 = 0) GROUP BY image_id""",
        "adjacency_capped": _capped_sql(),
        "lsc_seed": f"{lsc_steps} SELECT image_id, number, {f10('')} FROM clusters0",
        "lsc_assign": f"{once} SELECT image_id, y, x, label FROM labels1",
        "lsc_update": f"{once},\n{lsc.update(0, 'true')} SELECT image_id, number, {f10('')} FROM clusters1",
        "crf_unbiased": f"WITH {_CRF} SELECT time, cls, node, round(ln({CLASSES}::DOUBLE), 6) AS u FROM un",
        "crf_unary_proba": f"WITH {_CRF} SELECT time, cls, node, CASE WHEN (node + cls) % 5 = 0 THEN -1.0::DOUBLE ELSE round(-ln(((node + cls) % 5) / 5.0::DOUBLE), 6) END AS u FROM un",
        "crf_infer_twice": _twice_sql({}),
        "crf_infer_compat": _twice_sql(COMPAT),
        **{name: _iterated_sql(name) for name in ITERATED},
    }


def oracle_sql() -> dict[str, str]:
    labels = "SELECT image_id, y, x, label FROM labels"
    quarter = "pi() / 2"
    angles = [("c0", f"c0 * ({quarter} / 255)", 20.0), ("c1", f"c1 * ({quarter} / 255)", 51.0), ("c2", f"c2 * ({quarter} / 255)", 51.0), ("x", f"x * ({quarter} / {S})", 2.0), ("y", f"y * ({quarter} / {S})", 2.0)]
    raw = [f"{f}({a}) * {w}" for _, a, w in angles for f in ("cos", "sin")]
    lsc = f"""WITH {_RASTER}, raw AS (SELECT image_id, y, x, {", ".join(f"{r} AS f{k}" for k, r in enumerate(raw))} FROM pixels),
m AS (SELECT image_id, {", ".join(f"avg(f{k}) AS m{k}" for k in range(10))} FROM raw GROUP BY ALL),
w AS (SELECT raw.*, {" + ".join(f"m{k} * f{k}" for k in range(10))} AS weight FROM raw JOIN m USING (image_id))
SELECT image_id, y, x, round(weight, 6) AS weight, {", ".join(f"round(f{k} / weight, 6) + 0.0::DOUBLE AS f{k}" for k in range(10))} FROM w"""
    infer = f"""WITH {_CRF},
q AS (SELECT time, cls, node, exp(-u) AS q FROM un),
msg AS (SELECT time, cls, node, sum(m) AS m FROM (
  SELECT se.time, q.cls, se.src AS node, se.e * q.q * se.r AS m FROM se JOIN q ON q.time = se.time AND q.node = se.dst
  UNION ALL SELECT te.time, q.cls, te.node, te.e * q.q * te.r FROM te JOIN q ON q.time = te.other AND q.node = te.node) GROUP BY ALL),
ex AS (SELECT un.time, un.cls, un.node, exp(-(u + sum(coalesce(m, 0)) OVER (PARTITION BY un.time, un.node) - coalesce(m, 0))) AS e
  FROM un LEFT JOIN msg ON msg.time = un.time AND msg.cls = un.cls AND msg.node = un.node)
SELECT time, cls, node, round(e / greatest(sum(e) OVER (PARTITION BY time, node), 1e-5), 6) AS q FROM ex"""
    touch = f"""WITH {_SLIC},
t AS (SELECT image_id, y, x, label, lead(label) OVER (PARTITION BY image_id, y ORDER BY x) AS rt FROM labels),
e AS (SELECT a.image_id, a.label AS src, unnest([a.rt, b.label, b.rt]) AS dst FROM t a JOIN t b ON b.image_id = a.image_id AND b.y = a.y + 1 AND b.x = a.x
  WHERE a.x < {WIDTH - 1}),
d AS (SELECT image_id, src, dst FROM e WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)
SELECT image_id, src, dst FROM d UNION SELECT image_id, dst, src FROM d"""
    return {
        **_more_sql(),
        "rgb_to_lab": f"WITH {_lab_steps()} SELECT image_id, y, x, c0, c1, c2 FROM lab",
        "row_subsample": f"WITH {_RASTER} SELECT image_id, y, x, c0, c1, c2 FROM pixels WHERE y % 3 = 1",
        "init_clusters": f"WITH {_CLUSTERS} SELECT image_id, number, y::DOUBLE AS y, x::DOUBLE AS x, c0::DOUBLE AS c0, c1::DOUBLE AS c1, c2::DOUBLE AS c2 FROM clusters",
        "slic_assign": f"WITH {_SLIC} {labels}",
        "real_assign": f"WITH {_assigned(f'{_L1} + {_COEF!r}::DOUBLE * ({_STEP})')} {labels}",
        "l2_assign": f"WITH {_assigned(f'{_L2} + {_COEF!r}::DOUBLE * {_COEF!r}::DOUBLE * ((p.y - c.y) * (p.y - c.y) + (p.x - c.x) * (p.x - c.x))')} {labels}",
        "noq_assign": f"WITH {_assigned(f'{_L1} + {_COEF!r}::DOUBLE * ({_STEP})')} {labels}",
        "slic_euclid_assign": f"WITH {_assigned(f'floor({_COEF!r}::DOUBLE * sqrt(((p.y - c.y) * (p.y - c.y) + (p.x - c.x) * (p.x - c.x))::DOUBLE)) + {_L1}')} {labels}",
        "update_once": f"WITH {_UPDATED} SELECT image_id, number, y, x, c0, c1, c2, num_members FROM moved",
        "adjacency_uncapped": touch,
        "knn_l1": f"WITH {_KNN} SELECT image_id, src, dst, ord FROM knn",
        "density_of_mask": f"WITH {_DENSITY} SELECT image_id, number, density FROM density",
        "density_broadcast": f"WITH {_DENSITY} SELECT l.image_id, l.y, l.x, coalesce(d.density, 0) AS mask FROM labels l LEFT JOIN density d ON d.image_id = l.image_id AND d.number = l.label",
        "components": f"WITH RECURSIVE {_COMPONENTS} SELECT image_id, (comp // {WIDTH})::INT AS leader_y, (comp % {WIDTH})::INT AS leader_x, nullif(label, -1)::INT AS label, area FROM areas",
        "connectivity": f"WITH RECURSIVE {_ABSORBED} {_FINAL}",
        "lsc_features": lsc,
        "crf_unary_mask": f"WITH {_CRF} SELECT time, cls, node, round(u, 6) AS u FROM un",
        "crf_spatial_energy": f"WITH {_CRF} SELECT time, src, dst, round(e, 6) AS e FROM se",
        "crf_temporal_energy": f"WITH {_CRF} SELECT time, node, other, round(e, 6) AS e FROM te",
        "crf_infer_once": infer,
    }
