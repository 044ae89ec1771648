"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"
#: A word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes that one broadcast may hold; beyond it every operator here joins by shuffle.
BROADCAST_BYTES = 64 << 20
#: At most so many keys count as hot, and none with fewer rows than these.
HOT_KEYS, HOT_ROWS = 10_000, 1_000
#: So few edges are any task's work, whatever their nodes.
SOME_ROWS = 50_000
#: Bits of a block of a Bloom filter (4 KB), and the most blocks that one has.
BLOCK_BITS, FILTER_BLOCKS = 1 << 15, 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``. Only a local session
    without the setting, as in tests on one machine, gets a folder of its own; a cluster without it is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "terrazzo-checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute df once, into the shared folder of ``spark.checkpoint.dir``, and cut its lineage there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate rows, if it is there, wherever Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished rounds have left: the driver's memory, and checkpoints, shuffles and broadcasts that no
    plan refers to any more, which Spark removes only when the driver's garbage has been collected."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_below(count: int, bound: int, *keys: str) -> Column:
    """A seeded choice of about ``bound`` of ``count`` rows, by their keys alone."""
    share = min(1.0, bound / max(count, 1))
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def fits(rows: int, row_bytes: int) -> bool:
    """Whether so many rows of that size may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def hinted(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if its counted rows fit the bound; else as it is, for a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if fits(rows, row_bytes) else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with groups(key, __n, ...), of which every key of rows is one, where __n is the number of its rows and
    ``total`` that of all.

    A key with more than its share of rows would be one task's work in a shuffled join. Of keys with more than
    ``total / HOT_KEYS`` rows there are HOT_KEYS at most, so these, and only these, are broadcast; their rows stay where they are.
    rows are read twice and should be checkpointed.
    """
    bar = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = F.broadcast(groups.where(F.col("__n") > bar).drop("__n")), groups.where(F.col("__n") <= bar).drop("__n")
    rest = rows.join(F.broadcast(groups.where(F.col("__n") > bar).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


def join_known(rows: DataFrame, groups: DataFrame, key: str, total: int, row_bytes: int) -> DataFrame:
    """As join_groups, but with all groups broadcast if their counted rows fit the bound."""
    if fits(groups.count(), row_bytes):
        return rows.join(F.broadcast(groups.drop("__n")), key)
    return join_groups(rows, groups, key, total)


def bit_filter(keys: DataFrame, n: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """A Bloom filter of ``keys(h long)``: (__block, __words), blocks of 512 words of 64 bits, and the number of blocks.

    Two bits a key, built by partial aggregation. However many keys there are, the filter has FILTER_BLOCKS blocks at
    most, 64 MB, so that it may be broadcast: with more keys it lets more pass, and never loses one.
    """
    blocks = min(FILTER_BLOCKS, max(1, -(-n * bits_per_key // BLOCK_BITS)))
    places = F.array(*(F.struct(F.shiftright(b, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int")).alias("bit")) for b in _bits(F.col("h"))))
    each = keys.select(_block(F.col("h"), blocks).alias("__block"), F.explode(places).alias("p")).select("__block", "p.w", "p.bit")
    words = each.groupBy("__block", "w").agg(F.bit_or("bit").alias("bits"))
    held = words.groupBy("__block").agg(F.map_from_entries(F.collect_list(F.struct(F.col("w").cast("int"), "bits"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return checkpoint(held.select("__block", dense.alias("__words"))), blocks


def _bits(h: Column) -> list[Column]:
    return [h.bitwiseAND(F.lit(BLOCK_BITS - 1)), F.shiftrightunsigned(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1))]


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 30), F.lit(blocks))


def marked(rows: DataFrame, h: str, known: tuple[DataFrame, int]) -> DataFrame:
    """rows with ``__maybe``: whether their hash ``h`` may be among the filter's keys. No row moves; false is certain."""
    blocks, n = known
    met = rows.withColumn("__block", _block(F.col(h), n)).join(F.broadcast(blocks), "__block", "left")
    is_set = lambda b: F.call_function("shiftright", F.get("__words", F.shiftright(b, 6)), b.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    one, two = map(is_set, _bits(F.col(h)))
    return met.withColumn("__maybe", F.coalesce(one & two, F.lit(False))).drop("__block", "__words")


def aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns renamed whose names begin like the marks of this subpackage, and what gives them their names back."""
    taken, new = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        name = c
        while name.lower().startswith("__") or name != c and name.lower() in taken:
            name = f"kept{name}" if name.lower().startswith("__") else f"{name}_"
        new[c] = name
    out = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in new.items()))
    return out, lambda df: df.select(*(F.col(f"`{n}`").alias(c) for c, n in new.items()))


def text_key() -> Column:
    """A hash of each row's text alone; null counts as empty."""
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def row_key() -> Column:
    """A key of each row's own, by its id and a hash of its text, never null. Keys sort by id, null last. Rows with one key
    repeat id and text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), text_key().alias("text"))


def keep_one(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs(__key, ...) whose key is kept by judged(__key, kept), without it; of rows with one key one stays."""
    keys = checkpoint(judged.groupBy("__key").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")))
    out = without(docs, keys.where("not kept").select("__key"), "__key")
    repeats = checkpoint(keys.where("kept and n > 1").select("__key"))
    if not repeats.isEmpty():
        here, rest = _split(out, repeats, "__key")
        out = rest.unionByName(here.dropDuplicates(["__key"]))
    return out.drop("__key")


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose key is not in gone(key); checkpointed keys, never null."""
    return _split(docs, gone, key, parts=1)[0]


def _split(docs: DataFrame, keys: DataFrame, key: str, parts: int = 2) -> tuple[DataFrame, ...]:
    """Rows of docs with a key among keys, and those without; with one part, only the latter.

    Keys are broadcast as far as their counted size allows. Beyond it a bounded filter of their hashes is: rows that it
    does not let pass stay where they are, texts and all, and only the others are joined by shuffle.
    """
    n = keys.count()
    if fits(n, 160):
        small = F.broadcast(keys)
        out = docs.join(small, key, "left_anti")
        return (out,) if parts == 1 else (docs.join(small, key, "left_semi"), out)
    flagged = marked(docs.withColumn("__h", F.xxhash64(key)), "__h", bit_filter(keys.select(F.xxhash64(key).alias("h")), n))
    maybe = flagged.where("__maybe").drop("__h", "__maybe")
    out = flagged.where("not __maybe").drop("__h", "__maybe").unionByName(maybe.join(keys, key, "left_anti"))
    return (out,) if parts == 1 else (maybe.join(keys, key, "left_semi"), out)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def struct_of(**columns: pa.Array | np.ndarray) -> pa.StructArray:
    arrays = [pa.array(x) if isinstance(x, np.ndarray) else x for x in columns.values()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))


def min_label_components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``, as ``(node, root)`` with the smallest node as root.

    Alternates the two star steps of Kiveris et al., "Connected Components in MapReduce and Beyond" (2014),
    until the edge set stands still, which takes a number of rounds logarithmic in the longest path. Only edges
    move between executors; each round is cut by a checkpoint. Least neighbours are found with partial aggregation, and
    a node with a great share of all edges is broadcast to them, so that no hub is one task's work. Self-loops and repeated
    or mirrored edges are harmless. Nodes without any edge to another node are absent from the result.
    """
    edges = checkpoint(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )

    def mark(e: DataFrame) -> tuple:
        # Edges are distinct, so that no hash cancels another; neither mark can overflow.
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())

    def join(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
        return join_groups(rows, checkpoint(groups), "a", n) if n > SOME_ROWS else rows.join(groups.drop("__n"), "a")

    before = mark(edges)
    while before[0]:
        # Large star: every larger neighbour of a node moves to the node's least neighbour (itself included).
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("__n"))
        moved = join(both, least, 2 * before[0]).where("b > a")
        large = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n"))
        small = join(large, least, before[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(
            small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        after = mark(edges)
        if after == before:
            break
        before = after
    release(edges.sparkSession)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
