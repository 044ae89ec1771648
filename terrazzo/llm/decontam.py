"""Benchmark decontamination by spaced seeds (DataFrame operations only)."""

from __future__ import annotations

from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, aside, bit_filter, checkpoint, fits, join_groups, marked, table, text_key, without

#: An overlap counts if, of some run of so many words of the item (all of a shorter item), this share agrees.
RUN, SHARE = 12, 0.8
#: Places of a run that the seeds of an item read; words at the other places may differ. Whichever two words of a run of
#: twelve differ, one of these two masks lies somewhere on the run with all its places on words that agree.
MASKS = ("111011", "11010011")
#: Bytes that a seed may take in a broadcast.
SEED_BYTES = 96
#: Seeds of a benchmark that is too large to broadcast are dealt to so many tasks each.
SALTS = 8


def changes(n: int, run: int = RUN, share: float = SHARE) -> int:
    """How many words of a run of an item of n words may differ."""
    size = min(n, run)
    return max(d for d in range(size + 1) if (size - d) / size >= share)


def finds(mask: str, n: int, changed: tuple[int, ...]) -> bool:
    """Whether the mask lies somewhere on n words with all its places beside the changed ones."""
    read = [k for k, bit in enumerate(mask) if bit == "1"]
    return any(all(at + k not in changed for k in read) for at in range(n - len(mask) + 1))


@cache
def masks_for(n: int, changed: int) -> tuple[str, ...]:
    """Four masks at most, reading as many words as can be, that find n words whichever ``changed`` of them differ."""
    wanted = set(combinations(range(n), changed))
    for weight in range(n - changed, 0, -1):
        spans = [(0, *inner, span - 1)[: weight if weight > 1 else 1] for span in range(weight, n + 1) for inner in combinations(range(1, span - 1), max(0, weight - 2))]
        known = ["".join("1" if k in read else "0" for k in range(read[-1] + 1)) for read in spans]
        found = {mask: {c for c in wanted if finds(mask, n, c)} for mask in dict.fromkeys(known)}
        chosen, left = [], set(wanted)
        while left and len(chosen) < 4:
            mask = max(found, key=lambda m: len(found[m] & left))
            if not found[mask] & left:
                break
            chosen.append(mask)
            left -= found[mask]
        if not left:
            return tuple(chosen)
    return ("1",)


def words_of(text: Column) -> Column:
    """Lower-case words, split at white space; none for null or blank text."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def seeds_at(hashes: str, pos: str, masks: list[str]) -> list[Column]:
    """The hash of each mask laid on the word hashes at ``pos``; null where it would stand out at the end."""
    h, p = F.col(hashes), F.col(pos)
    read = lambda mask: [F.get(h, p + k) for k, bit in enumerate(mask) if bit == "1"]
    return [F.when(p + len(mask) <= F.size(h), F.xxhash64(F.lit(mask), *read(mask))) for mask in masks]


def best_share(same: Column, n: Column, run: int) -> Column:
    """Of array ``same`` of n flags, the greatest share of set ones in any run of ``run`` (or n, if less) flags."""
    size = F.least(n, F.lit(run))
    ones = lambda i: F.aggregate(F.slice(same, i, size), F.lit(0), lambda a, x: a + x)
    return F.array_max(F.transform(F.sequence(F.lit(1), n - size + 1), ones)) / size


def contaminated(
    docs: DataFrame, benchmark: DataFrame, run: int = RUN, share: float = SHARE, masks: tuple[str, ...] = MASKS
) -> DataFrame:
    """(doc_id, item_id, doc_word, n_same, n_item, overlap) for each document and item that overlap.

    Each mask is laid on every place of every document and item; equal hashes are hits, which fix how the item lies on
    the document. There, word by word, the two are compared: they overlap if of some ``run`` words of the item in a
    row, or of all if it has fewer, at least ``share`` agree, so that substituted words don't hide a passage.
    Of several places the best stays, then the first. ``masks`` are those of items of a whole run; a shorter item
    has masks of its own by its length (see ``masks_for``). Both are such that no overlap is without a hit, down to items
    of one word.

    Hits are found and verified row by row, without shuffling texts; seeds and items are broadcast as far as their
    counted size allows. Beyond it a bounded Bloom filter of the seeds is, so that only places that pass it are shuffled, dealt
    to several tasks a seed, and only texts with a hit are moved. Null and blank texts and items overlap nothing. Repeated
    rows of either table give one result for each doc_id and item_id; null ids are ids like others. Empty tables give an
    empty result. Other columns of either table are not read, whatever their names.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    items = checkpoint(items.withColumn("__item", F.monotonically_increasing_id()))
    lengths = sorted(r[0] for r in items.select(F.least(F.size("item"), F.lit(run))).distinct().collect()) or [run]  # run at most
    by_length = {n: masks if n == run else masks_for(n, changes(n, run, share)) for n in lengths}
    all_masks = list(dict.fromkeys(m for given in by_length.values() for m in given))
    hashed = lambda df, words: df.withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w)))
    # The outer form, as the other would test the array's size first and so split each text twice.
    spots = lambda df, *keep: df.select(*keep, "hashes", F.posexplode_outer("hashes").alias("pos", "__h")).drop("__h")
    each = F.array(*(F.struct(F.lit(m).alias("mask"), s.alias("seed")) for m, s in zip(all_masks, seeds_at("hashes", "pos", all_masks), strict=True)))
    own = F.lit(False)
    for n, given in by_length.items():
        own = own | ((F.least("n", F.lit(run)) == n) & F.col("e.mask").isin(*given))
    seeds = spots(hashed(items, "item"), "__item").select("__item", F.size("hashes").alias("n"), F.col("pos").alias("item_pos"), F.explode(each).alias("e"))
    seeds = checkpoint(seeds.where(F.col("e.seed").isNotNull() & own).select("__item", "item_pos", "e.seed").distinct())
    n_seeds, n_items = seeds.count(), items.count()

    words = hashed(docs.select("doc_id", words_of(F.col("text")).alias("words")), "words")
    laid_at = lambda *keep: spots(words, *keep).select(*keep, "pos", F.explode(F.array(*seeds_at("hashes", "pos", all_masks))).alias("seed")).where("seed is not null")
    start = (F.col("pos") - F.col("item_pos")).alias("start")
    if not n_seeds:
        hits = words.where(F.lit(False)).select("doc_id", "words", F.lit(0).cast("long").alias("__item"), F.lit(0).alias("start"))
    elif fits(n_seeds, SEED_BYTES):
        hits = laid_at("doc_id", "words").join(F.broadcast(seeds), "seed").select("doc_id", "words", "__item", start)
    else:
        words = words.withColumn("__text", F.xxhash64("hashes"))
        at = marked(laid_at("doc_id", "__text"), "seed", bit_filter(seeds.select(F.col("seed").alias("h")), n_seeds)).where("__maybe")
        salted = at.withColumn("salt", F.pmod(F.xxhash64("__text", "pos"), F.lit(SALTS)))
        dealt = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hit = salted.join(dealt, ["seed", "salt"]).select(F.col("doc_id").alias("__doc"), F.col("__text").alias("__of"), "__item", start).distinct()
        hit = checkpoint(hit)
        texts = hit.select(F.col("__of").alias("h")).distinct()
        moved = marked(words, "__text", bit_filter(texts, texts.count())).where("__maybe")
        hits = moved.join(hit, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__of"))).select("doc_id", "words", "__item", "start")
    if fits(n_items, 4096):
        laid = hits.join(F.broadcast(items), "__item")
    else:
        hits = checkpoint(hits)
        known = items.join(hits.groupBy("__item").agg(F.count("*").alias("__n")), "__item")
        laid = join_groups(hits, known, "__item", hits.count())
    same = F.transform("item", lambda w, i: F.when(w == F.get(F.col("words"), F.col("start") + i), 1).otherwise(0))
    found = laid.select("doc_id", "item_id", "start", F.size("item").alias("n_item"), same.alias("same"))
    found = found.select(
        "doc_id", "item_id", "start", "n_item",
        best_share(F.col("same"), F.col("n_item"), run).alias("overlap"),
        F.aggregate("same", F.lit(0), lambda a, x: a + x).alias("n_same"),
    ).where(F.col("overlap") >= share)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", "n_same", -F.col("start"), "n_item")).alias("b"))
    return best.select(
        "doc_id", "item_id", (-F.col("b.col3")).cast("long").alias("doc_word"), F.col("b.n_same").cast("long").alias("n_same"),
        F.col("b.n_item").cast("long").alias("n_item"), F.col("b.overlap").alias("overlap"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap no item, with all columns, whatever their names. Texts are judged, whatever their ids: a
    null or repeated id neither saves a row nor takes another text with it, and all rows of a text share its fate. Null and
    empty texts stay. An empty benchmark leaves all rows."""
    plain, back = aside(docs)
    keyed = plain.withColumn("__key", text_key())
    found = contaminated(keyed.select(F.col("__key").alias("doc_id"), "text"), benchmark)
    return back(without(keyed, checkpoint(found.select(F.col("doc_id").alias("__key")).distinct()), "__key"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql(run: int = RUN, share: float = SHARE) -> str:
    """The definition in SQL, without seeds: texts and items are laid on each other wherever one word agrees, and places with
    fewer agreeing words than any overlap has are left out before the runs are rated."""
    words = lambda c: f"string_split_regex(regexp_replace(lower({c}), '^{SPACE}+|{SPACE}+$', '', 'g'), '{SPACE}+')"
    filled = lambda c: f"regexp_matches({c}, '[^\\x20\\x09-\\x0D]')"
    least = f"{share} * least(len(i.w), {run})"
    return f"""
WITH d AS (SELECT doc_id, w, row_number() OVER () AS row FROM (SELECT DISTINCT doc_id, {words("text")} AS w FROM documents WHERE {filled("text")})),
i AS (SELECT item_id, w, row_number() OVER () AS row FROM (SELECT DISTINCT item_id, {words("text")} AS w FROM benchmark WHERE {filled("text")})),
dw AS (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
iw AS (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS pos FROM i),
met AS (SELECT a.row AS doc, b.row AS item, a.pos - b.pos AS start, count(*) AS n_same FROM dw a JOIN iw b USING (word) GROUP BY ALL),
laid AS (
  SELECT doc_id, item_id, start, len(i.w) AS n, h.n_same,
         [CASE WHEN start + k >= 0 AND i.w[k + 1] = d.w[start + k + 1] THEN 1 ELSE 0 END for k in range(len(i.w))] AS same
  FROM met h JOIN d ON d.row = h.doc JOIN i ON i.row = h.item WHERE h.n_same >= {least} - 1e-9
), rated AS (
  SELECT *, list_max([list_sum(same[j + 1 : j + least(n, {run})]) for j in range(n - least(n, {run}) + 1)])::DOUBLE / least(n, {run}) AS overlap
  FROM laid
)
SELECT doc_id, item_id, start::BIGINT AS doc_word, n_same::BIGINT AS n_same, n::BIGINT AS n_item, overlap FROM rated WHERE overlap >= {share}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY overlap DESC, n_same DESC, start, n DESC) = 1
"""


OP8_SQL = _sql()
