"""Exact duplicates by two passes over Bloom filters (DataFrame operations only)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, aside, checkpoint, join_groups, keep_one, remove_folder, row_key, shared_folder, table

#: Bits of the filter for each row. A row sets two bits of one 64-bit word; about one unique row in a hundred shares
#: both with repeated or chance company, is taken for a possible repeat, and found unique by the exact comparison.
BITS_PER_ROW = 32
#: Words of the second filter that are broadcast together: 64 MB at 64 bytes a word.
PART_WORDS = 1 << 20


def word_of(h: Column, words: int) -> Column:
    """The filter word of a hash, by its upper 52 bits, so that words may be numbered far beyond 2**32."""
    return F.pmod(F.shiftrightunsigned(h, 12), F.lit(words))


def bits_of(h: Column) -> Column:
    """The two bits that a hash sets in its word, by its lower 12 bits; they may be the same."""
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    return one(h).bitwiseOR(one(F.shiftrightunsigned(h, 6)))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, text_sha256, h) of each row; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(text, SPACE + "+", "")
    return docs.select(
        "doc_id", F.length(text).alias("n_points"), F.sha2(bare.cast("binary"), 256).alias("text_sha256")
    ).withColumn("h", F.xxhash64("text_sha256"))


def seen_again(hashed: DataFrame) -> DataFrame:
    """(word, again): the second filter, of the bits that two or more rows of ``hashed(word, bits)`` set; words without any are absent.

    The first filter is the words' bits, built by partial aggregation, so that only words move, never rows. With each
    word go the bits set an odd number of times and how many settings there were. If the settings beyond the first of
    each bit are as many as the bits set an even number of times, just these were set again; if they are more, some
    bit was set three times, and all bits of the word count. So no bit that was set twice is missing.
    """
    words = hashed.groupBy("word").agg(F.bit_or("bits").alias("seen"), F.bit_xor("bits").alias("odd"), F.sum(F.bit_count("bits")).alias("n"))
    even = F.col("seen").bitwiseAND(F.bitwise_not("odd"))
    extra = F.col("n") - F.bit_count("seen")
    return words.where(extra > 0).select("word", F.when(extra == F.bit_count(even), even).otherwise(F.col("seen")).alias("again"))


def possibly_repeated(rows: DataFrame, words: int, folder: str) -> DataFrame:
    """rows(h, ...) with ``maybe``, in the place of h: whether some other row may have the same hash. No row moves.

    The second filter is broadcast in parts of bounded size, by ranges of words. With more than one part rows are
    first written into a subfolder of ``folder`` for each, where they stand, so that each is read and tested once.
    """
    hashed = rows.withColumns({"word": word_of(F.col("h"), words), "bits": bits_of(F.col("h"))})
    again = checkpoint(seen_again(hashed.select("word", "bits")))
    # Hashes spread evenly; half the bound leaves room for chance.
    n = again.count()
    parts = -(-2 * n // PART_WORDS) if n > PART_WORDS else 1
    maybe = F.col("again").isNotNull() & (F.col("again").bitwiseAND(F.col("bits")) == F.col("bits"))
    test = lambda some, known: some.join(F.broadcast(known), "word", "left").withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("h", "word", "bits", "again")
    if parts == 1:
        return test(hashed, again)
    part = (F.col("word") / F.lit(-(-words // parts))).cast("long").cast("int")
    hashed.withColumn("__part", part).write.partitionBy("__part").parquet(folder)
    stored, out = rows.sparkSession.read.parquet(folder), None
    for k in range(parts):
        one = test(stored.where(F.col("__part") == k).drop("__part"), again.where(part == k))
        out = one if out is None else out.unionByName(one)
    return out


def exact_dedup(docs: DataFrame, bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """Groups of equal texts, one row for each row of docs.

    Texts are equal when identical without white space. The row with the most code points stays, among those the
    smallest doc_id. Returns doc_id, keep_id, group_size, kept, text_sha256.

    Pass 1 hashes every text once and builds two Bloom filters, of bits that some row sets and of those that two or
    more rows set. Pass 2 tests each row against the second, broadcast in parts of bounded size: rows that it does
    not hold are unique and pass straight through, without any shuffle; only the others are shuffled and compared by
    SHA-256. The filter has no false negatives, so no repeat is lost. A text that many rows share is counted with
    partial aggregation and then broadcast to its rows.

    Null texts equal empty ones. Rows that repeat doc_id and text count in group_size, and each is kept if its doc_id
    is keep_id; a null doc_id sorts after all others. An empty table gives an empty result. Other columns are not
    read.
    """
    rows = checkpoint(digest(docs))
    folder = f"{shared_folder(docs.sparkSession)}/filtered-{uuid.uuid4().hex}"
    tested = checkpoint(possibly_repeated(rows, max(1, rows.count() * bits_per_row // 64), folder))
    remove_folder(docs.sparkSession, folder)
    unique = tested.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = tested.where("maybe")
    # Partial aggregation leaves one row a task and text, so a text that a third of all rows share is no hot key here.
    groups = checkpoint(
        maybe.groupBy("text_sha256").agg(
            F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"))).alias("best"), F.count("*").alias("group_size")
        ).withColumn("__n", F.col("group_size"))
    )
    total = groups.agg(F.sum("__n")).first()[0] or 0
    repeated = join_groups(maybe, groups, "text_sha256", total).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"),
        "text_sha256",
    )
    return unique.unionByName(repeated)


def drop_exact(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all columns, whatever their names. Rows are told apart by id and text, so
    that null and repeated ids neither hold a copy nor drop another text; of rows that repeat both one stays. Null texts equal empty
    ones. An empty table stays empty."""
    plain, back = aside(docs)
    keyed = plain.withColumn("__key", row_key())
    found = exact_dedup(keyed.select(F.col("__key").alias("doc_id"), "text"))
    return back(keep_one(keyed, found.select(F.col("doc_id").alias("__key"), "kept")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
