"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, release, sample_below, table, texts_of

#: The field learns from so many labelled documents at most, and from so many of their lines, chosen by a hash of the id.
MAX_DOCS, MAX_LINES = 5000, 200_000
THRESHOLD = 0.3
STEPS = 120
#: Bytes of text whose lines are scored together.
BATCH_BYTES = 4 << 20

#: Byte classes: lower, upper, digit, blank, sentence marks, brackets and rules, other marks, beyond ASCII.
CLASSES = 8


def _classes() -> np.ndarray:
    kind = np.full(256, 6, np.uint8)
    for number, chars in enumerate(
        (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:!?'\"-", b"()[]{}<>|/\\_=")
    ):
        kind[list(chars)] = number
    kind[128:] = 7
    return kind


KIND = _classes()


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts, the lines' lengths in bytes plus one, and each text's number of lines.

    A text has one line more than line feeds. Features see the line itself, and then the same of the line before
    and the line after it, zero where there is none.
    """
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts + 1).astype(np.float64)  # with the line feed
    kind = KIND[data]
    per = np.stack([np.add.reduceat(kind == k, starts, dtype=np.int64) for k in range(CLASSES)], 1).astype(np.float64)
    per[:, 3] -= 1  # the line feed itself
    blank = kind == 3
    word_end = np.zeros(len(data), bool)
    word_end[:-1] = blank[1:] & ~blank[:-1]
    words = np.add.reduceat(word_end, starts, dtype=np.int64).astype(np.float64)
    odd_end = word_end & ((kind == 6) | (kind == 5) | (data == 33))
    odd = np.add.reduceat(odd_end, starts, dtype=np.int64)
    run = np.zeros(len(data), bool)
    run[1:] = (data[1:] == data[:-1]) & (kind[1:] >= 4) & (kind[1:] <= 6)
    runs = np.add.reduceat(run, starts, dtype=np.int64)
    seen_before, distinct = np.zeros(len(ends)), np.ones(len(ends))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        seen: set[bytes] = set()
        for k, line in enumerate(text.split(b"\n"), at):
            if line in seen:
                seen_before[k] = 1
            elif line:
                seen.add(line)
            found = line.split()
            if found:
                distinct[k] = len(set(found)) / len(found)
        at += n
    length = np.maximum(size - 1, 1)
    letters = per[:, 0] + per[:, 1] + per[:, 7]
    last = data[np.maximum(ends - 1, 0)]
    own = np.column_stack(
        [
            per / length[:, None],
            np.log1p(size - 1) / 5,
            words / length * 4,
            np.minimum(letters / np.maximum(words, 1), 20) / 10,
            per[:, 1] / np.maximum(letters, 1),
            odd / np.maximum(words, 1),
            runs / length * 4,
            seen_before,
            distinct,
            (distinct < 0.4) & (words >= 5),
            np.isin(last, (46, 33, 63)) & (size > 1),
            size == 1,
            np.log1p(words) / 3,
        ]
    )
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[np.cumsum(counts) - 1] = 0
    return np.column_stack([own, before, after, np.ones(len(own))]), size, counts


def _forward_backward(emit: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each line's label, and the expected number of each transition, over all chains at once.

    emit: (lines, 2) log potentials; trans: (2, 2). Chains are worked off in step, the longest first, so that those
    that have ended drop out at the end.
    """
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains with more than t lines
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    step = lambda x, m: np.logaddexp(x[:, :1] + m[0], x[:, 1:] + m[1])
    for t in range(longest):
        at = first[: active[t]] + t
        alpha[at] = emit[at] if t == 0 else emit[at] + step(alpha[at - 1], trans)
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        beta[at] = step(emit[at + 1] + beta[at + 1], trans.T)
    joint = alpha + beta
    marginal = np.exp(joint - np.logaddexp(joint[:, :1], joint[:, 1:]))
    inner = np.ones(len(emit), bool)
    inner[np.cumsum(counts) - 1] = False  # a chain's last line begins no transition
    at = np.flatnonzero(inner)
    if len(at):
        pair = alpha[at][:, :, None] + trans[None] + (emit[at + 1] + beta[at + 1])[:, None, :]
        pair -= pair.max((1, 2), keepdims=True)
        pair = np.exp(pair)
        expected = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    return marginal, expected


@dataclass
class LineField:
    """Weights of the field: those of a good line against a bad one, the transitions', and the final calibration."""

    weights: np.ndarray
    trans: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def _raw(self, features: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The length-weighted mean of each text's marginals of a good line."""
        good = features @ self.weights
        marginal, _ = _forward_backward(np.column_stack([np.zeros_like(good), good]), self.trans, counts)
        first = np.cumsum(counts) - counts
        return np.add.reduceat(marginal[:, 1] * size, first) / np.add.reduceat(size, first)

    @classmethod
    def fit(cls, features: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> LineField:
        """Maximum likelihood of the line labels, a document's own, each document weighing the same; Adam on all."""
        y = np.repeat(labels, counts)
        same = np.zeros((2, 2))
        inner = np.ones(len(y), bool)
        inner[np.cumsum(counts) - 1] = False
        for k in (0, 1):
            same[k, k] = np.count_nonzero(inner & (y == k))
        # The chain's transitions are damped strongly: labels of whole documents can't show where lines change.
        field = cls(np.zeros(features.shape[1]), np.zeros((2, 2)))
        m = v = np.zeros(features.shape[1] + 4)
        n = len(y)
        for step in range(1, STEPS + 1):
            good = features @ field.weights
            marginal, expected = _forward_backward(np.column_stack([np.zeros_like(good), good]), field.trans, counts)
            grad_w = features.T @ (y - marginal[:, 1]) / n - 1e-5 * field.weights
            grad_t = (same - expected) / n - 0.05 * field.trans
            grad = np.concatenate([grad_w, grad_t.ravel()])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 1))
            field.weights = field.weights + move[:-4]
            field.trans = field.trans + move[-4:].reshape(2, 2)
        x = _logit(field._raw(features, size, counts))
        a, b = 1.0, 0.0
        for _ in range(200):  # the score becomes a probability of label 1 for a document
            p = 1 / (1 + np.exp(-(a * x + b)))
            g, h = labels - p, np.maximum(p * (1 - p), 1e-6)
            hess = np.array([[np.sum(h * x * x) + 1, np.sum(h * x)], [np.sum(h * x), np.sum(h) + 1]])
            da, db = np.linalg.solve(hess, np.array([np.sum(g * x) - (a - 1), np.sum(g) - b]))
            a, b = a + da, b + db
        field.scale, field.shift = max(float(a), 1e-3), float(b)
        return field

    def score(self, texts: list[bytes]) -> np.ndarray:
        out, lo = np.zeros(len(texts)), 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH_BYTES):
                size += len(texts[hi])
                hi += 1
            raw = self._raw(*line_features(texts[lo:hi]))
            out[lo:hi] = 1 / (1 + np.exp(-(self.scale * _logit(raw) + self.shift)))
            lo = hi
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_quality_model(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> LineField | None:
    """Learn from labelled documents that are not held out; executors turn texts into features.

    Of about ``max_docs`` of them, chosen by a hash of their id, whole documents are taken in the order of another hash as long as
    all their lines together are ``max_lines`` at most, so that what reaches the driver is bounded whatever the texts. Of
    repeated labels the least counts; of rows that repeat an id, the one with the fewest lines, then the least text hash.
    None if no labelled document, or only one kind of label, is there.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").alias("__label"))
    known = known.groupBy("doc_id").agg(F.min("__label").alias("__label"))
    known = known.where(sample_below(known.count(), max_docs, "doc_id"))
    # The sample's bound is its size bound: 16 bytes a row.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    text = F.coalesce("text", F.lit(""))
    lines = (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long")
    sizes = rows.groupBy("doc_id").agg(F.min(F.struct(lines.alias("n"), F.xxhash64(text).alias("h"))).alias("s"))
    order = F.xxhash64(F.lit("order"), "doc_id")
    taken, used = [], 0
    for r in sizes.select("doc_id", "s.n", "s.h").orderBy(order, "doc_id").collect():  # the sample: 24 bytes a document
        if used + r.n <= max_lines:
            taken.append((r.doc_id, r.h))
            used += r.n
    if not taken:
        return None
    chosen = docs.sparkSession.createDataFrame(taken, sizes.select("doc_id", F.col("s.h").alias("__h")).schema)
    rows = rows.join(F.broadcast(chosen), "doc_id").where(F.xxhash64(text) == F.col("__h")).drop("__h")
    rows = rows.dropDuplicates(["doc_id"])
    schema = "label long, counts long, size array<double>, features array<float>"

    def prepare(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for text, label in zip(texts, batch.column("__label").to_pylist(), strict=True):
                features, size, counts = line_features([text])
                yield pa.RecordBatch.from_pydict(
                    {"label": [label], "counts": counts, "size": [size], "features": [features.ravel().astype(np.float32)]}
                )

    got = rows.mapInArrow(prepare, schema).toArrow()
    labels_ = got.column("label").to_numpy().astype(np.float64)
    if len(set(labels_.tolist())) < 2:
        return None
    counts = got.column("counts").to_numpy().astype(np.int64)
    size = got.column("size").combine_chunks().flatten().to_numpy()
    features = got.column("features").combine_chunks().flatten().to_numpy().reshape(len(size), -1).astype(np.float64)
    model = LineField.fit(features, size, counts, labels_)
    del got, features, size
    release(docs.sparkSession)
    return model


def score_column(docs: DataFrame, model: LineField | None):
    """The score of column text, as a Column."""
    if model is None:
        return F.lit(0.5)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts_of(texts)))

    return of(F.col("text"))


def quality_scores(docs: DataFrame, model: LineField | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, from its whole text alone.

    score is the calibrated length-weighted mean of the lines' marginals; predicted is 1 from ``threshold`` on. A
    null text counts as empty: one empty line, with a score like any other. Without a model every score is 0.5. Rows
    are neither merged nor dropped; other columns are not read.
    """
    found = docs.select("doc_id", held_out().alias("held_out"), score_column(docs, model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: LineField | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs predicted good, with all columns, whatever their names, each judged by its own text: rows that
    repeat are judged alike, null texts as empty ones, and without a model all stay."""
    return docs.where(score_column(docs, model) >= threshold)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality_model(docs, table(spark, sf_dir, "labels")))
