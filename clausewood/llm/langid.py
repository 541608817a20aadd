"""Language identification by a linear-chain conditional random field over words.

A text is the sequence of its words (runs of letters, in lower case). A word's
emission is the sum of weights of its lexicon entry, its prefixes and suffixes of
one to three letters' bytes and its byte trigrams with word borders, all hashed;
a transition weight stands between the labels of neighbouring words. Forward-
backward gives each word's label distribution, so code-switched text gets labels
by word; a text's label is the one with the largest expected share of words.

The weights, transitions included, are learned by AdaGrad on the conditional
likelihood of the word windows of labelled rows. Windows are shuffled, so that
those of different languages come to stand in one sequence and transitions see
switches. The fit reads at most about ``max_rows`` rows (a documented bound), each in
whole, as consecutive windows of WINDOW words; these are sorted once for each epoch
and streamed through one task, which holds the model and a few windows. Every word of
every text is labelled afterwards.

Forward-backward runs over all texts of a slice at once: texts are cut into pieces
of PIECE words, each piece's transfer matrix is formed, the pieces of a text are
chained, and the inner states follow. A long text costs no more per word.

Defined results: null texts and texts without a letter give ``und`` and score 0;
rows with a null id or label are not learned from; without any labelled row all
get ``und``; repeated rows get equal results; an empty table gives an empty
result; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewood.llm.common import M1, mix, runs, slices, span_hashes, tidy
from clausewood.llm.quality import fold
from clausewood.runtime import ship

WORD_BITS, GRAM_BITS = 18, 16
WORD_MASK, GRAM_MASK = np.uint64((1 << WORD_BITS) - 1), (1 << GRAM_BITS) - 1
#: Lexicon, prefixes of 1-3 bytes, suffixes of 1-3 bytes.
KINDS = 7
WINDOW, PIECE = 48, 64
#: Windows of a step of learning.
MINIBATCH = 128
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

Model = tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte Latin letters of U+00C0-U+00DE."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        out[second] += 32
    return out


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words x KINDS numbers, trigram number of each byte, start, end, row of each word)."""
    member = LETTER[data]
    starts, ends, rows = runs(member, offsets)
    text = lowered(data)
    n = len(text)
    numbers = np.zeros((len(starts), KINDS), dtype=np.int32)
    grams = np.zeros(n, dtype=np.int32)
    if not len(starts):
        return numbers, grams, starts, ends, rows
    numbers[:, 0] = span_hashes(text, starts, ends) & WORD_MASK
    b = text.astype(np.int64)
    first, last = starts, ends - 1
    code = np.zeros(len(starts), np.int64)
    for k in range(3):
        at = first + k
        code = code * 257 + np.where(at < ends, b[np.minimum(at, n - 1)], 0) + 1
        numbers[:, 1 + k] = mix(code.astype(np.uint64) * M1 + np.uint64(k + 1)) & WORD_MASK
    code = np.zeros(len(starts), np.int64)
    for k in range(3):
        at = last - k
        code = code * 257 + np.where(at >= starts, b[np.maximum(at, 0)], 0) + 1
        numbers[:, 4 + k] = mix(code.astype(np.uint64) * M1 + np.uint64(k + 11)) & WORD_MASK
    framed = np.where(member, text, 32).astype(np.int32)
    before, after = np.empty(n, np.int32), np.empty(n, np.int32)
    before[0], before[1:] = 32, framed[:-1]
    after[-1], after[:-1] = 32, framed[1:]
    before[first], after[last] = 32, 32
    grams[:] = ((before * 8191 + framed) * 8191 + after) * 40503 >> 9 & GRAM_MASK
    return numbers, grams, starts, ends, rows


def emissions(model: Model, numbers: np.ndarray, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """words x labels scores."""
    _, words, trigrams, _, _ = model
    out = np.zeros((len(starts), words.shape[1]), dtype=np.float32)
    for k in range(KINDS):
        out += words[numbers[:, k]]
    if len(starts):
        cuts = np.empty(2 * len(starts), np.int64)
        cuts[0::2], cuts[1::2] = starts, ends
        gathered = np.concatenate([trigrams[grams], np.zeros((1, trigrams.shape[1]), np.float32)])
        sums = np.add.reduceat(gathered, cuts, axis=0)[0::2]
        out += sums / (ends - starts)[:, None].astype(np.float32)
    return out


def marginals(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """words x labels posteriors by forward-backward; ``lengths``: words of each sequence, in order."""
    n, labels = scores.shape
    if not n:
        return np.zeros((0, labels))
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    move, start = np.exp(transition - transition.max()), np.exp(begin - begin.max())
    lengths = lengths[lengths > 0]
    pieces = -(-lengths // PIECE)
    k = int(pieces.sum())
    seq_first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    owner = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(k) - seq_first[owner]
    word_first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[owner] + number * PIECE
    size = np.minimum(PIECE, lengths[owner] - number * PIECE)
    steps = np.arange(PIECE)[:, None]
    at = np.minimum(word_first[None, :] + steps, n - 1)
    live = steps < size[None, :]
    grid = e[at]  # PIECE x k x labels
    # Transfer matrix of each piece: product of move * emission over its words.
    transfer = np.broadcast_to(np.eye(labels), (k, labels, labels)).copy()
    for t in range(PIECE):
        new = (transfer @ move) * grid[t][:, None, :]
        new /= new.sum(axis=(1, 2), keepdims=True)
        transfer = np.where(live[t][:, None, None], new, transfer)
    # States before each piece (enter) and after it (leave), chained along each sequence.
    enter, leave = np.ones((k, labels)), np.ones((k, labels))
    most = int(pieces.max())
    order = np.argsort(-pieces, kind="stable")
    sorted_pieces = pieces[order]
    for j in range(1, most):
        at_j = seq_first[order[: int(np.searchsorted(-sorted_pieces, -j, side="left"))]] + j
        before = enter[at_j - 1]
        if j == 1:
            inner = transfer_first(transfer[at_j - 1], grid, at_j - 1, live, move, start)
        else:
            inner = np.einsum("ki,kij->kj", before, transfer[at_j - 1])
        enter[at_j] = inner / inner.sum(axis=1, keepdims=True)
    for j in range(most - 1, 0, -1):
        at_j = seq_first[order[: int(np.searchsorted(-sorted_pieces, -j, side="left"))]] + j
        inner = np.einsum("kij,kj->ki", transfer[at_j], leave[at_j])
        leave[at_j - 1] = inner / inner.sum(axis=1, keepdims=True)
    forward = np.empty((PIECE, k, labels))
    state = enter
    head = (number == 0)[:, None]
    for t in range(PIECE):
        came = state @ move
        if t == 0:
            came = np.where(head, start[None, :], came)
        state = came * grid[t]
        state /= state.sum(axis=1, keepdims=True)
        forward[t] = state
    out = np.empty((PIECE, k, labels))
    back = leave
    for t in range(PIECE - 1, -1, -1):
        own = forward[t] * back
        out[t] = own / own.sum(axis=1, keepdims=True)
        new = (grid[t] * back) @ move.T
        back = np.where(live[t][:, None], new / new.sum(axis=1, keepdims=True), back)
    result = np.empty((n, labels))
    result[at[live]] = out[live]
    return result


def transfer_first(_: np.ndarray, grid: np.ndarray, pieces: np.ndarray, live: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """State after the first piece of each sequence, which begins with the start weights in place of a move."""
    state = start[None, :] * grid[0][pieces]
    for t in range(1, PIECE):
        new = (state @ move) * grid[t][pieces]
        new /= new.sum(axis=1, keepdims=True)
        state = np.where(live[t][pieces][:, None], new, state)
    return state


def word_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the consecutive windows of WINDOW words of each text; the last one may be shorter."""
    starts, ends, rows = runs(LETTER[data], offsets)
    first = np.searchsorted(rows, rows)
    head = np.flatnonzero((np.arange(len(rows)) - first) % WINDOW == 0)
    last = np.minimum(head + WINDOW, np.searchsorted(rows, rows[head], side="right")) - 1
    return starts[head], ends[last], rows[head]


class Learner:
    """The model while it is learned, by minibatches of sequences of windows."""

    def __init__(self, labels: list[str], rate: float = 0.25) -> None:
        count = len(labels)
        self.rate = rate
        self.model: Model = (labels, np.zeros((1 << WORD_BITS, count), np.float32), np.zeros((1 << GRAM_BITS, count), np.float32), np.zeros((count, count)), np.zeros(count))
        self.sums = [np.full_like(x, 1e-6) for x in self.model[1:]]
        self.rng = np.random.default_rng(7)

    def learn(self, windows: list[bytes], gold_of: np.ndarray) -> None:
        """One step on windows (their text and their label's number); sequences hold one to three of them, whatever their labels."""
        _, words, trigrams, transition, begin = self.model
        labels = len(begin)
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in windows])])
        numbers, grams, starts, ends, rows = word_features(np.frombuffer(b"".join(windows), np.uint8), offsets)
        cuts = np.cumsum(self.rng.integers(1, 4, len(windows)))
        sequence = np.searchsorted(cuts, np.arange(len(windows)), side="right")
        lengths = np.bincount(sequence[rows])
        lengths = lengths[lengths > 0]
        gold = gold_of[rows]
        scores = emissions(self.model, numbers, grams, starts, ends)
        post = marginals(scores, lengths, transition, begin)
        wrong = post.copy()
        wrong[np.arange(len(gold)), gold] -= 1.0
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        inner = np.ones(len(gold), bool)
        inner[first] = False
        later = np.flatnonzero(inner)
        # Expected moves: pair posteriors of neighbours.
        pair = post[later - 1][:, :, None] * np.exp(transition)[None] * (np.exp(scores[later] - scores[later].max(axis=1, keepdims=True)))[:, None, :]
        pair = pair / np.maximum(pair.sum(axis=1, keepdims=True), 1e-300) * post[later][:, None, :]
        seen = np.zeros((labels, labels))
        np.add.at(seen, (gold[later - 1], gold[later]), 1.0)
        size = ends - starts
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - starts, size)
        self.sparse(0, numbers.ravel(), np.repeat(wrong, KINDS, axis=0))
        self.sparse(1, grams[place], np.repeat(wrong / size[:, None], size, axis=0))
        for i, x, g in ((2, transition, pair.sum(axis=0) - seen), (3, begin, wrong[first].sum(axis=0))):
            self.sums[i] += g * g
            x -= self.rate * g / np.sqrt(self.sums[i])
        np.clip(transition, -8, 8, out=transition)

    def sparse(self, table: int, numbers: np.ndarray, gradients: np.ndarray) -> None:
        """AdaGrad on the rows of a table that a minibatch touches."""
        at, inverse = np.unique(numbers, return_inverse=True)
        g = np.stack([np.bincount(inverse, weights=gradients[:, j], minlength=len(at)) for j in range(gradients.shape[1])], axis=1)
        self.sums[table][at] += (g * g).astype(np.float32)
        self.model[1 + table][at] -= (self.rate * g / np.sqrt(self.sums[table][at])).astype(np.float32)


def fit(texts: pa.Array, langs: list[str], seeds: np.ndarray, epochs: int = 3) -> Model:
    """Learn a model from texts and their languages; ``seeds``, one per row, order the windows."""
    learner = Learner(sorted(set(langs)))
    numbers = {x: i for i, x in enumerate(learner.model[0])}
    held, at = [], 0
    for part, data, offsets in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        for s, e, row in zip(*word_windows(data, offsets), strict=True):
            held.append((mix(seeds[at + row : at + row + 1] + np.uint64(s))[0], data[s:e].tobytes(), numbers[langs[at + row]]))
        at += part.num_rows
    held.sort()
    for _ in range(epochs):
        for b in range(0, len(held), MINIBATCH):
            own = held[b : b + MINIBATCH]
            learner.learn([w for _, w, _ in own], np.array([g for _, _, g in own]))
    return learner.model


def label_texts(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best label or -1, its expected share of the words) of each text."""
    numbers, grams, starts, ends, rows = word_features(data, offsets)
    n, count = len(offsets) - 1, len(model[0])
    lengths = np.bincount(rows, minlength=n)
    post = marginals(emissions(model, numbers, grams, starts, ends), lengths, model[3], model[4])
    share = np.stack([np.bincount(rows, weights=post[:, j], minlength=n) for j in range(count)], axis=1) / np.maximum(lengths, 1)[:, None]
    return np.where(lengths > 0, share.argmax(axis=1), -1), np.clip(share.max(axis=1), 0.0, 1.0)


def train(docs: DataFrame, folds: int, held: int, max_rows: int, id_col: str, text_col: str, lang_col: str, epochs: int = 3) -> Model | None:
    ship(docs.sparkSession)
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    base = base.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    known = base.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("id"), folds) != held))
    total = known.select("lang").groupBy().count().first()["count"]
    sample = known.where(F.col("place") < int((1 << 40) * min(1.0, max_rows / max(1, total)))).select("lang", "place", "text")
    labels = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # the languages of max_rows rows

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                starts, ends, rows = word_windows(data, offsets)
                order = mix(part.column(1).to_numpy().astype(np.uint64)[rows] + (starts - offsets[rows]).astype(np.uint64)).view(np.int64)
                windows = pa.array([data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(order), windows], ["lang", "order", "window"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, numbers = Learner(labels), {x: i for i, x in enumerate(labels)}
        windows, gold = [], []
        for batch in batches:
            for lang, window in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                windows.append(window), gold.append(numbers[lang])
                if len(windows) == MINIBATCH:
                    learner.learn(windows, np.array(gold))
                    windows, gold = [], []
        if windows:
            learner.learn(windows, np.array(gold))
        raw = [np.ascontiguousarray(x, np.float32).tobytes() for x in learner.model[1:]]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in raw], ["words", "trigrams", "transition", "begin"])

    if not labels:
        return None
    windows = sample.mapInArrow(cut, "lang string, order long, window binary").withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
    row = windows.repartition(1).sortWithinPartitions("epoch", "order", "lang", "window").select("lang", "window").mapInArrow(run, "words binary, trigrams binary, transition binary, begin binary").first()
    load = lambda name: np.frombuffer(row[name], np.float32).reshape(-1, len(labels))
    return labels, load("words"), load("trigrams"), load("transition").astype(np.float64), load("begin")[0].astype(np.float64)


def identify(docs: DataFrame, folds: int = 4, held: int = 2, max_rows: int = 2_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; rows of the held fold are never learned from."""
    model = train(docs, folds, held, max_rows, id_col, text_col, lang_col)
    kind = docs.schema[id_col].dataType.simpleString()
    lettered = F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False))
    narrow = docs.select(docs[id_col].alias("doc_id"), F.when(lettered, docs[text_col]).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                if shared.value is None:
                    best, score, names = np.full(part.num_rows, -1), np.zeros(part.num_rows), ["und"]
                else:
                    best, score = label_texts(shared.value, data, offsets)
                    names = [*shared.value[0], "und"]
                score = np.where(best >= 0, score, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names).take(pa.array(np.where(best >= 0, best, len(names) - 1))), pa.array(score)], ["doc_id", "lang_pred", "score"])

    labelled = narrow.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return labelled.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
