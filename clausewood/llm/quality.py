"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text is a sequence of tokens: runs of letters and digits, and runs of marks.
Unigrams and bigrams of the lower-cased tokens and of their shapes (all capitals,
capitalised, lower case, digits, or the mark itself; a pair of shapes also tells
if the token is the same again) are hashed to 2**BITS
features. A feature's value is its count over the number of tokens, so a score is
a sparse dot product whose cost is one table look-up per n-gram. The model is
fitted by FTRL-Proximal with per-coordinate rates, one row after another in the
order of a hash of the id.

The fit reads at most about ``max_rows`` labelled rows (a documented bound: ids
whose hash falls under the ratio), each in whole. Their features are counted where
the rows lie, sorted once for each epoch and streamed through one task, which holds
the model and a batch. Every row of every text is scored, in whole. The model, 2**BITS floats, is all
that reaches the driver and is broadcast.

Defined results: null and empty texts have no features and score by the bias
alone; rows without a label or with a null id only get scores; repeated rows get
equal scores; without any labelled row the score is 0.5; an empty table gives
an empty result; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewood.llm.common import LOWER_BYTES, M1, M3, SPACE, fresh, mix, runs, slices, span_hashes, tidy
from clausewood.runtime import ship

BITS = 18
MASK = np.uint64((1 << BITS) - 1)
#: Features per token: token, token pair, shape, shape pair.
KINDS = 4
WORDLIKE = np.zeros(256, dtype=bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True
MARKS = ~WORDLIKE & ~SPACE
#: Cut of the score for label 1.
CUT = 0.3
#: Scale of the relative frequencies, so that a token in every tenth place counts as 1.
SCALE = 10.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens x KINDS feature numbers, row of each token)."""
    a, b = runs(WORDLIKE[data], offsets), runs(MARKS[data], offsets)
    starts, ends, rows = (np.concatenate([x, y]) for x, y in zip(a, b, strict=True))
    marks = np.concatenate([np.zeros(len(a[0]), bool), np.ones(len(b[0]), bool)])
    order = np.argsort(starts, kind="stable")
    starts, ends, rows, marks = starts[order], ends[order], rows[order], marks[order]
    out = np.zeros((len(starts), KINDS), dtype=np.int32)
    if not len(starts):
        return out, rows
    words = span_hashes(LOWER_BYTES[data], starts, ends)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    first = (data[starts] >= 65) & (data[starts] <= 90)
    shape = np.where(upper[ends] - upper[starts] >= 2, 3, np.where(first, 2, np.where(digit[ends] > digit[starts], 4, 1))).astype(np.uint64)
    shapes = np.where(marks, words, mix(shape))
    out[:, 0] = words & MASK
    out[:, 2] = mix(shapes + M3) & MASK
    same = np.zeros(len(rows), dtype=bool)
    same[1:] = rows[1:] == rows[:-1]
    again = np.zeros(len(words), np.uint64)
    again[1:] = (words[1:] == words[:-1]) & same[1:]
    for kind, x in ((1, words), (3, shapes + again)):
        before = np.zeros(len(x), np.uint64)
        before[1:] = x[:-1]
        before[~same] = kind
        out[:, kind] = mix(before * M1 + x + np.uint64(kind)) & MASK
    return out, rows


def dots(weights: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of each row: sigmoid of the sparse dot product."""
    n = len(offsets) - 1
    numbers, rows = features(data, offsets)
    total = np.bincount(rows, weights=weights[numbers].sum(axis=1, dtype=np.float64), minlength=n)
    tokens = np.bincount(rows, minlength=n)
    z = bias + SCALE * total / np.maximum(tokens, 1)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Leader:
    """FTRL-Proximal, one row (feature numbers, values, label) after another; the last coordinate is the bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, numbers: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weight(numbers)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        step = (np.sqrt(self.n[numbers] + g * g) - np.sqrt(self.n[numbers])) / self.alpha
        self.z[numbers] += g - step * w
        self.n[numbers] += g * g

    def model(self) -> tuple[np.ndarray, float]:
        w = self.weight(np.arange(len(self.z)))
        return w[:-1].astype(np.float32), float(w[-1])


def counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(feature numbers, their counts, tokens) of each text."""
    numbers, rows = features(data, offsets)
    cuts = np.searchsorted(rows, np.arange(len(offsets)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own, counts = np.unique(numbers[lo:hi], return_counts=True)
        yield own.astype(np.int32), counts.astype(np.int32), int(hi - lo)


def training_row(numbers: np.ndarray, counts: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a row, the bias behind them."""
    return np.append(numbers, 1 << BITS).astype(np.int64), np.append(SCALE * counts / max(1, tokens), 1.0)


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int, id_col: str, text_col: str, epochs: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias from the labelled rows whose id ``learn`` accepts."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull()).where(learn).groupBy("id").agg(F.max("label").alias("label"))
    known = known.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    total = known.count()
    chosen = known.where(F.col("place") < int((1 << 40) * min(1.0, max_rows / max(1, total))))
    sample = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(chosen, "id").select("place", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "label", "text")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                numbers, counts, tokens = zip(*counted(data, offsets), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(tokens, pa.int32())], ["place", "digest", "label", "numbers", "counts", "tokens"])

    @tidy
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, any_row = Leader(), False
        for batch in batches:
            for label, numbers, counts, tokens in zip(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)), strict=True):
                leader.learn(*training_row(numbers, counts, tokens), label)
                any_row = True
        if any_row:
            weights, bias = leader.model()
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    rows = sample.mapInArrow(count, "place long, digest string, label int, numbers array<int>, counts array<int>, tokens int")
    rows = rows.withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs))))).repartition(1).sortWithinPartitions("epoch", "place", "digest", "label")
    fitted = rows.select("label", "numbers", "counts", "tokens").mapInArrow(fit, "weights binary, bias double").collect()  # one row
    if not fitted:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(fitted[0]["weights"], np.float32), fitted[0]["bias"]


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def score(docs: DataFrame, weights: np.ndarray, bias: float, keep: list[str], text_col: str, name: str) -> DataFrame:
    """The columns ``keep`` and the score, as ``name``, of every row."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))  # 2**BITS floats
    columns = [c for c in keep if c != text_col]
    narrow = docs.select(*[docs[c] for c in columns], docs[text_col])
    whole = text_col in keep

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text_col):
                kept = part.columns if whole else part.columns[:-1]
                names = part.schema.names if whole else part.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(dots(*model.value, data, offsets))], [*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if whole or f.name != text_col)
    return narrow.mapInArrow(run, f"{fields}, `{name}` double")


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier, fitted on all labels, doesn't reject; all columns as they were, whatever their names."""
    weights, bias = train(docs, labels, F.lit(True), max_rows, id_col, text_col)
    name = fresh("quality_score", docs)
    scored = score(docs, weights, bias, docs.columns, text_col, name)
    return scored.where(scored[name] >= CUT).select(*[scored[c] for c in docs.columns])


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows of the held fold are never learned from."""
    weights, bias = train(docs, labels, fold(F.col("id"), folds) != held, max_rows, id_col, text_col)
    scored = score(docs, weights, bias, [id_col], text_col, fresh("quality_score", docs))
    held_out = F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False))
    own = F.col(scored.columns[-1])
    return scored.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), own.alias("score"), (own >= CUT).cast("int").alias("predicted"))
