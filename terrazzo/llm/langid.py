"""Language identification by prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, sample_below, struct_of, table, texts_of

ORDER = 3
#: Texts stand after so many line feeds, so that their first bytes have a context too.
PAD = b"\n" * ORDER
#: The models learn from about so many whole documents of each language, chosen by a hash of their id.
DOCS_PER_LANG = 1500
#: The models hold so many different grams of four bytes together, the most frequent of each language.
MAX_GRAMS = 1 << 22
WINDOW = 1 << 20


class GramTable:
    """A frozen open-addressed map from 32-bit grams to row numbers, searched for whole arrays at once."""

    def __init__(self, grams: np.ndarray):
        self.bits = max(8, int(len(grams) * 4).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(grams)), self._home(grams)
        while len(left):
            free = self.rows[at] < 0
            slot, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[slot >= 0]
            self.keys[at[first]], self.rows[at[first]] = grams[left[first]], left[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Row numbers; -1 where a gram is absent."""
        at = self._home(grams)
        found = self.rows[at]
        look = np.flatnonzero((self.keys[at] != grams) & (found >= 0))
        while len(look):
            at[look] = (at[look] + 1) & ((1 << self.bits) - 1)
            found[look] = self.rows[at[look]]
            look = look[(self.keys[at[look]] != grams[look]) & (found[look] >= 0)]
        return found


@dataclass
class Tree:
    """The context tree of one language: by order, the cost of each gram seen (a context and a byte) and the escape of each
    context, in bits. Only what the language has is held."""

    grams: list[GramTable]
    cost: list[np.ndarray]
    contexts: list[GramTable]
    escape: list[np.ndarray]

    @classmethod
    def fit(cls, grams: np.ndarray, n: np.ndarray) -> Tree:
        """grams: different 4-byte grams; n: their numbers."""
        tree = cls([], [], [], [])
        for k in range(ORDER + 1):
            union, at = np.unique(grams & _last(k + 1), return_inverse=True)
            heads, head_of = np.unique(union >> np.uint32(8), return_inverse=True)
            c = np.bincount(at, n, len(union))
            total, distinct = np.bincount(head_of, c, len(heads)), np.bincount(head_of, minlength=len(heads))
            tree.grams.append(GramTable(union))
            tree.cost.append(-np.log2(c / (total + distinct)[head_of]))
            tree.contexts.append(GramTable(heads))
            tree.escape.append(-np.log2(distinct / (total + distinct)))
        return tree

    def code(self, grams: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each 4-byte gram."""
        bits, look = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, -1, -1):  # k: bytes of context
            part = grams[look] & _last(k + 1)
            row = self.grams[k].find(part)
            bits[look[row >= 0]] += self.cost[k][row[row >= 0]]
            look, part = look[row < 0], part[row < 0]
            head = self.contexts[k].find(part >> np.uint32(8))
            bits[look[head >= 0]] += self.escape[k][head[head >= 0]]
        bits[look] += 8.0
        return bits


def _last(n: int) -> np.uint32:
    """A mask for the last n bytes of a gram."""
    return np.uint32((1 << 8 * n) - 1)


@dataclass
class PPM:
    """A context tree of order 3 down to 0 for each language, with escape method C and frozen statistics.

    After a context seen T times with D different bytes, a byte seen c times costs -log2(c / (T + D)), and any other the
    escape -log2(D / (T + D)) and then its cost in the next shorter context; at last all 256 bytes cost 8 bits. An unseen
    context costs nothing. As statistics are frozen, the code length of a byte depends on it and the three before it alone.
    """

    langs: list[str]
    trees: list[Tree]

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> PPM:
        """counts: for each language its different 4-byte grams and their numbers."""
        langs = sorted(counts)
        return cls(langs, [Tree.fit(*counts[lang]) for lang in langs])

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the code length of each whole text."""
        n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        starts = np.cumsum(sizes + ORDER) - sizes
        data = np.frombuffer(PAD + PAD.join(texts) if n else b"", np.uint8)
        total = np.zeros((n, len(self.langs)))
        owner_of = lambda at: np.searchsorted(starts, at, side="right") - 1
        for lo in range(0, len(data) - ORDER, WINDOW):  # positions lo + ORDER and on
            hi = min(lo + WINDOW, len(data) - ORDER)
            b = data[lo : hi + ORDER].astype(np.uint32)
            grams, inverse = np.unique(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:], return_inverse=True)
            first, last = owner_of(lo + ORDER), owner_of(hi + ORDER - 1)
            own = np.arange(max(first, 0), last + 1)
            begin = np.clip(starts[own] - lo - ORDER, 0, hi - lo)
            end = np.clip(starts[own] + sizes[own] - lo - ORDER, 0, hi - lo)
            full = end > begin
            own, begin, end = own[full], begin[full], end[full]
            if len(own):
                cuts = np.stack([begin, end], 1).ravel()
                for j, tree in enumerate(self.trees):  # each different gram of the window is looked up once
                    bits = np.append(tree.code(grams)[inverse], 0.0)
                    total[own, j] += np.add.reduceat(bits, cuts)[::2]
        return total

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of the language with the shortest code, ties to the first by name, and its posterior."""
        total = self.lengths(texts)
        best = total.argmin(1)
        shorter = np.minimum(total - total[np.arange(len(best)), best][:, None], 1000.0)
        return best, 1.0 / np.exp2(-shorter).sum(1)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each 4-byte gram occurs in the texts of each language."""

    def count(batches):
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                grams = []
                for text in texts:
                    b = np.frombuffer(PAD + text, np.uint8).astype(np.uint32)
                    grams.append(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])
                g, n = np.unique(np.concatenate(grams), return_counts=True)
                if len(g):
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(g), "gram": g.astype(np.int64), "n": n})

    found = docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_language_model(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, max_grams: int = MAX_GRAMS) -> PPM | None:
    """Learn from text and lang of about ``docs_per_lang`` documents of each language that are not held out, and of their
    grams from the most frequent ones, an equal number of each language and ``max_grams`` at most in all: a bound on what reaches
    the driver, in the order of 64 MB. None without any document to learn from.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = F.when(F.col("lang") == lang, sample_below(n, docs_per_lang, "doc_id")).otherwise(chosen)
    found = gram_counts(known.where(chosen))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= max(1, max_grams // len(sizes))).drop("rank").toArrow()
    counts = {}
    langs = np.array(found.column("lang").to_pylist(), object)
    for lang in sorted(set(langs.tolist())):
        own = langs == lang
        counts[lang] = found.column("gram").to_numpy()[own].astype(np.uint32), found.column("n").to_numpy()[own]
    return PPM.fit(counts) if counts else None


def identify_language(docs: DataFrame, model: PPM | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, from the whole text alone.

    lang_pred is the language whose model gives the shortest code, ties to the first by name; score is its posterior
    under equal priors. Null texts, texts without a letter, and all texts where nothing could be learned get ``und``
    and 0. Rows are neither merged nor dropped; other columns are not read.
    """
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        best, score = shared.value.predict(texts_of(texts))
        return struct_of(lang=pa.array(np.array(shared.value.langs, object)[best], pa.string()), score=score)

    found = docs.select("doc_id", held_out().alias("held_out"), lettered.alias("lettered"), of(F.col("text")).alias("p"))
    return found.select(
        "doc_id",
        "held_out",
        F.when(F.col("lettered"), F.col("p.lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("lettered"), F.col("p.score")).otherwise(0.0).alias("score"),
    )


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, fit_language_model(docs))
