"""Near duplicates by SimHash fingerprints, joined on a grid of segment bit counts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, checkpoint, hinted, join_groups, keep_one, min_label_components, row_key, table, texts_of

#: Fingerprints link at so many differing bits or fewer.
MAX_BITS = 4
WORDS = 4
SEED = 42
#: The 32 two-bit segments form 8 blocks; two linked fingerprints agree in the counts of 4 blocks at least. With more
#: fingerprints than these, segments have one bit, so that a cell fixes 32 bits in the place of 24.
WIDE_SEGMENTS = 1 << 26
#: A cell with more members than these outside its commonest component is cut into the cells of another grid, this often at
#: most; what is crowded even then is linked by FLIPS.
CROWD, REFINEMENTS = 64, 2
#: All patterns of MAX_BITS / 2 bits or fewer, as an array in SQL.
FLIPS = "array_append(flatten(transform(sequence(0, 63), i -> transform(sequence(i, 63), j -> shiftleft(1L, i) | shiftleft(1L, j)))), 0L)"
BLOCKS = 8
LOW_BITS = 0x5555555555555555
#: Each choice of 4 blocks: its number from bit 32 on, and below, a byte for each chosen block's place in the fingerprint.
CHOICES = [
    number << 32 | sum(8 * k << 8 * place for place, k in enumerate(chosen))
    for number, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - MAX_BITS))
]


def fingerprint(text: bytes, n: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the word n-grams of a UTF-8 text, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = max(1, len(words) - n + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:last].tolist(), ends[min(n, len(words)) - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[i:j], seed) for i, j in spans], "<u8")
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for texts of any length
        part = hashes[k : k + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each row; null texts count as empty."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in texts_of(texts)], np.uint64).view(np.int64))

    return docs.select("doc_id", of(F.col("text")).alias("fp"))


def embedding(fp: Column) -> Column:
    """Bit counts (0, 1 or 2) of the 32 two-bit segments, each in unary in its own two bits.

    In this form the Manhattan distance of two count vectors is the number of differing bits. It is never more than
    the Hamming distance of the fingerprints, as the counts of a segment differ by no more than its bits do.
    """
    shifted = F.shiftrightunsigned(fp, 1)
    any_bit = fp.bitwiseOR(shifted).bitwiseAND(F.lit(LOW_BITS))
    both_bits = fp.bitwiseAND(shifted).bitwiseAND(F.lit(LOW_BITS))
    return any_bit.bitwiseOR(F.shiftleft(both_bits, 1))


def cell(emb: Column, choice: Column) -> Column:
    """The grid cell of an embedded fingerprint for one of CHOICES: the number of the choice and the counts in its 4
    blocks, packed exactly into one long. With a Manhattan distance of 4 or less, at most 4 of the 8 blocks differ, so
    that two linked fingerprints share a cell of some choice for certain."""
    key = choice.bitwiseAND(F.lit(~0xFFFFFFFF))
    for place in range(BLOCKS - MAX_BITS):
        shift = F.shiftright(choice, 8 * place).bitwiseAND(F.lit(255)).cast("int")
        block = F.call_function("shiftrightunsigned", emb, shift).bitwiseAND(F.lit(255))
        key = key.bitwiseOR(F.shiftleft(block, 8 * place))
    return key


def transposed(fp: Column) -> Column:
    """The fingerprint as 8 by 8 bits, rows and columns exchanged: blocks that have every eighth bit."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift)).bitwiseAND(F.lit(mask))
        fp = fp.bitwiseXOR(t).bitwiseXOR(F.shiftleft(t, shift))
    return fp


def rotated(fp: Column) -> Column:
    """The fingerprint turned by half a block."""
    return F.shiftleft(fp, 4).bitwiseOR(F.shiftrightunsigned(fp, 60))


def spread(df: DataFrame, tasks: int, emb: Column) -> DataFrame:
    """df(fp, ...) with each row once for each of its cells of the grid over ``emb``, over so many tasks.

    Each row becomes 70, so that few and small partitions must not decide how many tasks do this. The choices are
    data, not 70 expressions, which keeps plans, and so the driver's memory, small.
    """
    embedded = df.repartition(tasks).select(*df.columns, emb.alias("__emb"))
    exploded = embedded.select(*df.columns, "__emb", F.explode(F.lit(CHOICES)).alias("__choice"))
    return exploded.select(cell(F.col("__emb"), F.col("__choice")).alias("cell"), *df.columns)


def halves(fp: Column) -> list[Column]:
    """The bit counts of a fingerprint's two halves: its place in a plane, where linked ones are MAX_BITS apart at most."""
    return [F.bit_count(part).cast("int") for part in (fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32))]


def range_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(cell, x, a) and right(cell, y, b) that share a cell and are within MAX_BITS of each other by the Manhattan
    distance of their halves' counts.

    The plane is cut into squares of side MAX_BITS + 1. Each row of the right stands in its own square, each of the left looks
    into the nine around it, so that every pair within the radius meets once.
    """
    side = MAX_BITS + 1
    placed = right.withColumns({f"v{k}": c for k, c in enumerate(halves(F.col("y")))})
    placed = placed.withColumns({f"s{k}": F.expr(f"v{k} div {side}") for k in (0, 1)})
    looking = left.withColumns({f"u{k}": c for k, c in enumerate(halves(F.col("x")))})
    for k in (0, 1):
        looking = looking.withColumn(f"s{k}", F.explode(F.expr(f"sequence(u{k} div {side} - 1, u{k} div {side} + 1)")))
    return looking.join(placed, ["cell", "s0", "s1"]).where(F.abs(F.col("u0") - F.col("v0")) + F.abs(F.col("u1") - F.col("v1")) <= MAX_BITS)


def _linked(a: str, b: str) -> Column:
    """The Manhattan bound first, then the exact distance."""
    x, y = F.col(a), F.col(b)
    return (F.bit_count(embedding(x).bitwiseXOR(embedding(y))) <= MAX_BITS) & (F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS)


def star_links(members: DataFrame) -> DataFrame:
    """(a, b): each of ``members(cell, fp, low, high)`` with its cell's least and greatest fingerprint, where it links to them."""
    ends = members.select(F.col("fp").alias("a"), F.explode(F.array("low", "high")).alias("b"))
    return ends.where((F.col("a") != F.col("b")) & _linked("a", "b"))


def point_links(members: DataFrame, tasks: int) -> DataFrame:
    """(a, b): roots that links among distinct ``members(fp, root)`` join, exact however near they all are.

    Two fingerprints link if and only if some point is MAX_BITS / 2 bits or fewer from both. Each member stands at its 2,081
    points, and at each point every root is joined to the least, so that rows grow with the members and not with their pairs.
    """
    around = members.repartition(tasks).select("root", "fp", F.explode(F.expr(FLIPS)).alias("flip"))
    points = around.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "root").distinct()
    least = points.groupBy("point").agg(F.min("root").alias("b"), F.max("root").alias("most")).where("b < most")
    return points.join(least, "point").where("root <> b").select(F.col("root").alias("a"), "b").distinct()


def mixed_links(members: DataFrame, tasks: int, crowd: int = CROWD) -> DataFrame:
    """(a, b): roots of ``members(cell, fp, root)`` that links inside a cell join.

    Only fingerprints of different components are of interest: in each cell those outside the commonest component
    meet the cell's others, as far as they are within range (see ``range_join``), and are then compared exactly. With
    more than ``crowd`` of them a cell is cut first: each member goes to the cells of another
    grid, over other bits, within its own, where two linked ones still meet for certain, and unrelated ones seldom. Cells
    crowded to the last go by ``point_links``. So no member meets more than ``crowd`` others in a cell.
    """
    found = None
    for level in range(REFINEMENTS + 1):
        by_root = members.groupBy("cell", "root").agg(F.count("*").alias("n"))
        cells = by_root.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.sum("n").alias("__n"))
        cells = cells.where("roots > 1").select("cell", F.col("top.root").alias("top"), (F.col("__n") - F.col("top.n")).alias("others"), "__n")
        mixed = checkpoint(join_groups(members, checkpoint(cells), "cell", members.count()))
        small, big = mixed.where(F.col("others") <= crowd), mixed.where(F.col("others") > crowd).select("cell", "fp", "root")
        left = small.where("root <> top").select("cell", F.col("fp").alias("x"), F.col("root").alias("a"))
        right = small.select("cell", F.col("fp").alias("y"), F.col("root").alias("b"))
        more = range_join(left, right).where((F.col("a") != F.col("b")) & _linked("x", "y")).select("a", "b")
        found = more if found is None else found.union(more)
        if big.isEmpty():
            return found
        if level == REFINEMENTS:
            return found.union(point_links(big.select("fp", "root").distinct(), tasks))
        emb = transposed(F.col("fp")) if level == 0 else rotated(F.col("fp"))
        inner = spread(big.withColumnRenamed("cell", "outer"), tasks, emb)
        members = checkpoint(inner.select(F.xxhash64("outer", "cell").alias("cell"), "fp", "root"))
    raise AssertionError("the last level returns")


def link_fingerprints(distinct: DataFrame, wide_segments: int = WIDE_SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(fp, root) for each of ``distinct(fp)``; root is one fingerprint of the component.

    The range join of radius 4 in count space runs as equality joins on cells (see ``cell``):

    1. Each cell is reduced to its count and its least and greatest fingerprint, with partial aggregation. The two
       link if they are close enough. A cell of two is then done with.
    2. In cells of three and more, each member is compared with these two as well, which joins most of a large group at a cost
       that grows with its members.
    3. The components of those links are found. In cells of three and more, what is left between different components
       is verified (see ``mixed_links``), and the components are joined by what is found.
    """
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = distinct.count()
    emb = embedding(F.col("fp")) if n <= wide_segments else F.col("fp")
    reduced = checkpoint(
        spread(distinct, tasks, emb)
        .groupBy("cell")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1")
    )
    crowded = checkpoint(reduced.where("n > 2").select("cell", F.col("a").alias("low"), F.col("b").alias("high")))
    held = checkpoint(spread(distinct, tasks, emb).join(hinted(crowded, 80), "cell"))
    first = min_label_components(reduced.where(_linked("a", "b")).select("a", "b").union(star_links(held)))
    named = checkpoint(
        distinct.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    )
    members = checkpoint(held.select("cell", "fp").join(named, "fp"))
    second = min_label_components(mixed_links(members, tasks, crowd)).select(F.col("node").alias("root"), F.col("root").alias("final"))
    roots = named.groupBy("root").agg(F.count("*").alias("__n")).join(second, "root", "left")
    roots = checkpoint(roots.select("root", F.coalesce("final", "root").alias("final"), "__n"))
    return checkpoint(join_groups(named, roots, "root", n).select("fp", F.col("final").alias("root")))


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id, group_size.

    Rows with one fingerprint are one node; component_id is the smallest doc_id among rows reachable over links of
    MAX_BITS or fewer differing bits, the row's own included, and group_size the number of such rows. Null and
    wordless texts have fingerprint zero and link like any other. Repeated rows are all returned. A null doc_id never
    becomes a component_id unless its component has no other. An empty table gives an empty result. Other columns
    are not read.
    """
    rows = checkpoint(fingerprints(docs))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    known = checkpoint(distinct.join(link_fingerprints(distinct.select("fp")), "fp"))
    whole = checkpoint(known.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"), F.count("*").alias("__n")))
    sizes = whole.agg(F.sum("__n"), F.sum("group_size")).first()
    named = checkpoint(join_groups(known, whole, "root", sizes[0] or 0).select("fp", "component_id", "group_size", F.col("n").alias("__n")))
    return join_groups(rows, named, "fp", sizes[1] or 0).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size"
    )


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of docs of each component, with all columns, whatever their names: the one with the smallest id (null last),
    then text hash. Rows are told apart by id and text, so that another text under the same id stands for itself; of rows that
    repeat both one stays. Null and wordless texts are one component. An empty table stays empty."""
    plain, back = aside(docs)
    keyed = plain.withColumn("__key", row_key())
    found = simhash_components(keyed.select(F.col("__key").alias("doc_id"), "text"))
    return back(keep_one(keyed, found.select(F.col("doc_id").alias("__key"), (F.col("doc_id") == F.col("component_id")).alias("kept"))))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
