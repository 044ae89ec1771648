"""Each stage of the pipeline, and the operators behind them, on awkward tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from terrazzo.llm import common, decontam, exact_dedup, mixing
from terrazzo.llm.common import bit_filter, join_groups, marked, min_label_components
from terrazzo.llm.simhash import drop_near

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key string, __H int, chosen string, __maybe int, kept int"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [
    (None, None, None, None), (None, "", None, None), (1, "", "en", "a"), (2, " \n\t", "en", "a"), (3, "plain words stand here in order", "en", "a"),
    (3, "plain words stand here in order", "en", "a"), (3, "quite another text under the same id", "de", "b"), (4, f"x {PASSAGE} y", "en", "a"),
    (None, f"z {PASSAGE}", "en", "c"), (5, "long words again and again " * 20000, "en", "a"), (6, "12345 !!!", None, "c"),
]


def rows_of(df):
    return sorted((r.doc_id or 0, (r.text or "")[:40], r.source or "") for r in df.collect())


@pytest.fixture
def sf(spark, tmp_path):
    spark.createDataFrame([(0, PASSAGE, 7)], "item_id long, text string, doc_id int").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (6, 0, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_stages(spark, sf, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    docs = spark.createDataFrame([(*r, 0, "k", 1, "c", 2, 3) for r in ROWS], SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in STAGES.items():
        out = stage(spark, docs, sf)
        assert [c for c in out.columns if c in docs.columns] == docs.columns and stage(spark, none, sf).count() == 0, name
        assert {tuple(r) for r in out.select("__key", "__H", "chosen", "__maybe", "kept").collect()} <= {("k", 1, "c", 2, 3)}
    assert rows_of(STAGES["quality classifier"](spark, docs, sf)) == rows_of(docs) or broadcast  # both kinds may not be learned
    exact = rows_of(STAGES["exact dedup"](spark, docs, sf))
    assert [i for i, _, _ in exact] == [0, 2, 3, 3, 4, 5, 6]
    near = rows_of(STAGES["near dedup"](spark, docs, sf))
    assert [i for i, _, _ in near if i != 4] in ([0, 1, 3, 3, 5, 6], [1, 3, 3, 5, 6]) and len({t for i, t, _ in near if i == 3}) == 2
    clean = rows_of(STAGES["decontamination"](spark, docs, sf))
    assert len(clean) == len(ROWS) - 2 and not any(PASSAGE[:20] in t for _, t, _ in clean)


def test_repeated_ids_in_near_dedup(spark):
    a, b = "some text of a few plain words", "other things are told by this one"
    rows = spark.createDataFrame([(1, a), (7, a), (7, b)], "doc_id long, text string")
    assert sorted(map(tuple, drop_near(rows).collect())) == [(1, a), (7, b)]


def test_components_of_many_edges(spark):
    """Marks neither overflow nor repeat, and hubs with a great share of the edges are joined."""
    edges = spark.range(300_000).selectExpr("id + 10 a", "id % 3 b").union(spark.sql("select * from values (0L, 1L), (1L, 2L)"))
    assert min_label_components(edges).agg(F.count("*"), F.max("root")).first()[:] == (300_002, 0)


def test_groups_and_filters(spark):
    rows = spark.range(9000).selectExpr("if(id < 5000, 0, id) k", "id v")
    groups = rows.groupBy("k").agg(F.count("*").alias("__n"), F.min("v").alias("m"))
    got = join_groups(rows, groups, "k", 9000)
    assert got.count() == 9000 and got.where("m <> if(v < 5000, 0, v)").isEmpty()
    known = bit_filter(spark.range(2000).selectExpr("xxhash64(id) h"), 2000)
    told = marked(spark.range(40_000).selectExpr("id", "xxhash64(id) h"), "h", known)
    assert told.where("id < 2000 and not __maybe").isEmpty() and told.where("id >= 2000 and __maybe").count() < 2000


def test_bloom_words_far_apart(spark, tmp_path):
    """Words are numbered beyond 2**32, bits set twice are never missed, and rows in parts are told as in one."""
    words = 1 << 40
    h = spark.range(2000).selectExpr("xxhash64(id) h")
    placed = h.select(exact_dedup.word_of(F.col("h"), words).alias("w"))
    assert placed.agg(F.max("w")).first()[0] > 1 << 39 and placed.distinct().count() == 2000
    # Pairs, a text in three rows, and unique rows.
    rows = spark.range(3000).selectExpr("id", "xxhash64(case when id < 1000 then id % 500 when id < 1003 then -1 else id end) h")
    for n, sure in ((50, 0), (words, 1997)):
        told = exact_dedup.possibly_repeated(rows, n, str(tmp_path / str(n)))
        assert told.where("id < 1003 and not maybe").isEmpty() and told.where("not maybe").count() >= sure


def test_unique_rows_are_not_exchanged(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "PART_WORDS", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"text {i % 90}") for i in range(100)], "doc_id long, text string")
        tests = exact_dedup.possibly_repeated(exact_dedup.checkpoint(exact_dedup.digest(docs)), 100, str(tmp_path / "parts"))
        plan = tests._jdf.queryExecution().executedPlan().toString()
        assert (tmp_path / "parts").exists() and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
        assert tests.where("not maybe").count() > 50 and exact_dedup.exact_dedup(docs).where("kept").count() == 90
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_overlap_has_a_seed(spark):
    """Items of 1 to 14 words, each with every choice of allowed changes: all are found, and none with one change more."""
    from itertools import combinations

    for n in range(1, 15):
        size, allowed = min(n, decontam.RUN), decontam.changes(n)
        masks = decontam.MASKS if n >= decontam.RUN else decontam.masks_for(n, allowed)
        assert all(any(decontam.finds(m, size, c) for m in masks) for c in combinations(range(size), allowed))
    items, texts = [], []
    for n in (1, 4, 5, 6, 7, 10, 11, 12):
        words = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for extra in (0, 1):
            for c in combinations(range(n), decontam.changes(n) + extra):
                texts.append((len(texts), n, extra, " ".join(f"z{k}" if k in c else w for k, w in enumerate(words))))
    docs = spark.createDataFrame(texts, "doc_id long, n int, extra int, text string")
    found = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == {(i, n) for i, n, extra, _ in texts if not extra}


def test_mixing_weights(spark):
    rows = [(i, "w " * (1 + i % 7), ("en", "de")[i % 2], f"s{i % 5}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sums = lambda **more: {r[0]: r[1] for r in mixing.mixed(docs, **more).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies"))).collect()}
    one = F.lit("all")
    even = sums(domain=one, weights={}, share=0.4)
    tilted = sums(domain=one, weights={"source": {"s0": 4}}, share=0.4)
    without = sums(domain=one, weights={"source": {"s0": 0}, "lang": {"de": 0}}, share=0.4)
    assert tilted["s0"] > 1.5 * even["s0"] and "s0" not in without
    budget = sum(1 + i % 7 for i in range(200)) * 4 // 10
    assert all(budget - 80 <= sum(x.values()) <= budget for x in (even, tilted, without))
    assert mixing.mixed(docs, weights={"domain": dict.fromkeys("abcd", 0)}).count() == 0
    empty = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert 0 < mixing.mixed(empty).count() <= 600
