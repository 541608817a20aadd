"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row per distinct shingle set and a column per shingle;
links are the pairs of rows whose overlap count reaches the bound that their sizes
give. The product is only formed where it can matter:

1. Equal sets become one row, by a digest of the set, with map-side combination.
2. Columns get one global order. A Misra-Gries summary over all shingles of all
   documents names the frequent ones, which come last, by their counts; the rest
   stand in the order of their hashes. Any order gives the same links.
3. Of a row of n shingles only the first n - ceil(t n) + 1 columns can be the first
   that it shares with another row over the bound; the others stay out.
4. Rows that meet in one of those columns are pairs to be counted. Columns are blocked
   by size class and dealt over salts by their number of rows; a column's rows meet
   inside its task, which tells of each row a list of the others. A size bound and a
   positional bound discard pairs at once, a parity bitmap (one bit per shingle or
   fewer; bits that differ are a lower bound of the shingles that do) most others.
5. The product itself: rows are dealt into row blocks, the cells are pairs of row
   blocks, and a cell gets each of its rows' bitmaps, then whole sets, once, however
   many pairs they stand in; no pair is joined to either. Pairs that the bitmaps leave
   go on as a list of each row's others. Within a cell overlap counts are accumulated over one block of columns
   after another; a pair is discarded as soon as its count and the columns left to
   its smaller rest can't reach the bound of its sizes.
6. A cell tells of each row how many documents it links with and the least row that
   it is tied to, so a group of near copies gives a row per member and cell, not one
   per link; only ``links``, whose result they are, writes pairs.

``links`` and ``join_links`` count every pair, so links inside a component are found,
too. ``join_components`` alone, for ``keep_one``, needs no such count: in each column
block rows are first held against one leader, a linear number of pairs; those that
link form components, and columns whose rows are all in one are done with. Only what
then still spans components is met in pairs across components.

Shingles are 64-bit hashes, of which a cell compares 44 bits. The result is exact but
for collisions within one pair of documents.

Defined results: a null or empty text, or one without words, has the empty set
and links with nothing; a text with fewer words than the width has its whole
sequence as its one shingle; repeated rows get equal results; rows of one id with
different texts are documents of their own; ids may have any type that can be
compared; a row with a null id joins the component of its set if an identified row
has the same set, else its component is null; an empty table gives an empty result;
further columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewood.llm.common import fresh, materialize, mix, salt, shingle_sets, slices, tidy, word_hashes
from clausewood.llm.components import components
from clausewood.runtime import ship

#: Counters of the frequent-shingle summary, for a task and in all.
COUNTERS = 1 << 18
#: Rows up to which a filter on ids is broadcast (some 16 bytes each); beyond, it is a shuffled join.
BROADCAST_IDS = 1_000_000
#: Rows of a column that stand under one salt.
SALT_ROWS = 512
#: A row block has about so many bytes of sets and rows at most; there are ROW_BLOCKS at least.
BLOCK_BYTES, BLOCK_ROWS, ROW_BLOCKS = 1 << 24, 1 << 18, 16
#: Column blocks of a cell, and entries that are looked up at once.
COLUMN_BITS, ENTRIES = 3, 1 << 20
#: Pairs of a cell that are looked at together, and pairs whose bitmaps are compared at once.
PAIRS, SLICE = 1 << 16, 1 << 11
#: Entries of columns, and pairs, that a task gathers before it says what met.
GATHERED, MET = 1 << 17, 1 << 20
#: Rows that a row block remembers to have named; beyond, it begins anew and some are named again.
TOLD = 1 << 21
#: Bits of a shingle that a cell compares; the row stands above them.
SHINGLE_BITS = 44

Order = tuple[np.ndarray, np.ndarray]


class FrequentItems:
    """A Misra-Gries summary that takes arrays."""

    def __init__(self, counters: int = COUNTERS) -> None:
        self.counters = counters
        self.items, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, items: np.ndarray) -> None:
        own, counts = np.unique(items, return_counts=True)
        both = np.concatenate([self.items, own])
        self.items, place = np.unique(both, return_inverse=True)
        self.counts = np.bincount(place, weights=np.concatenate([self.counts, counts])).astype(np.int64)
        if len(self.items) > self.counters:
            least = np.partition(self.counts, len(self.counts) - self.counters - 1)[len(self.counts) - self.counters - 1]
            keep = self.counts > least
            self.items, self.counts = self.items[keep], self.counts[keep] - least


def ranked(items: np.ndarray, seen: np.ndarray) -> Order:
    """(shingles sorted by hash, their places 1.. by rising count); of equal shingles the greatest count holds."""
    by = np.lexsort((-seen, items))
    items, seen = items[by], seen[by]
    first = np.ones(len(items), bool)
    first[1:] = items[1:] != items[:-1]
    items, seen = items[first], seen[first]
    rank = np.empty(len(items), np.int64)
    rank[np.lexsort((items, seen))] = np.arange(1, len(items) + 1)
    return items, rank


def collected(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent rows of (shingle, seen): whole powers of two of ``seen``, as many as have COUNTERS rows at most. No task gets them all."""
    found = materialize(found.withColumn("level", F.floor(F.log2("seen")).cast("int")))
    least, total = 64, 0
    for level, rows in sorted(((r["level"], r["count"]) for r in found.groupBy("level").count().collect()), reverse=True):
        total += rows
        if total > COUNTERS:
            break
        least = level
    top = found.where(F.col("level") >= least).select("shingle", "seen").toArrow()
    return top.column("shingle").to_numpy().astype(np.int64).view(np.uint64), top.column("seen").to_numpy().astype(np.int64)


def frequent_shingles(docs: DataFrame, width: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count): frequent shingles by a Misra-Gries summary; at most COUNTERS."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = FrequentItems()
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                summary.add(shingle_sets(*word_hashes(data, offsets), part.num_rows, width)[0])
        keep = summary.counts >= 2
        yield pa.RecordBatch.from_arrays([pa.array(summary.items[keep].view(np.int64)), pa.array(summary.counts[keep])], ["shingle", "seen"])

    found = docs.select(docs[text_col].alias("text")).mapInArrow(run, "shingle long, seen long").groupBy("shingle").agg(F.sum("seen").alias("seen")).where("seen >= 8")
    return collected(found)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(percent n / 100) + 1, 0 for the empty set."""
    return np.where(n > 0, n + (-percent * n) // 100 + 1, 0)


def prefixes(h: np.ndarray, cuts: np.ndarray, order: Order, percent: int) -> pa.Array:
    """The first columns, in the global order, of each row that can be the first it shares with a row over the bound."""
    frequent, ranks = order
    n = np.diff(cuts)
    row = np.repeat(np.arange(len(n)), n)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        rank = np.where(frequent[at] == h, ranks[at], 0)
        h = h[np.argsort(row * (len(frequent) + 1) + rank, kind="stable")]
    size = prefix_length(n, percent)
    kept = h[np.arange(len(h)) - cuts[row] < size[row]]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(kept.view(np.int64)))


def text_key(text: Column) -> Column:
    """A digest that tells the texts of rows with one id apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def incidence(docs: DataFrame, order: Order, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, sig_a, sig_b, prefix, bits) of every row: the text's digest, the set's size and digest, its first columns in order and its parity bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                h, cuts = shingle_sets(*word_hashes(data, offsets), part.num_rows, width)
                n = np.diff(cuts)
                sig_a, sig_b = signature(h, cuts)
                bits = parity_bitmaps(h, np.repeat(np.arange(part.num_rows), n), n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(sig_a), pa.array(sig_b), prefixes(h, cuts, shared.value, percent), bits], ["id", "key", "n", "sig_a", "sig_b", "prefix", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(docs[id_col].alias("id"), text_key(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, key binary, n long, sig_a long, sig_b long, prefix array<long>, bits binary")


def parity_bitmaps(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> pa.Array:
    """A bitmap of 2**k >= n bits for each row; a bit tells if an odd number of shingles has it as their low k bits."""
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    place = (ends - bits)[row] + (h & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little")
    offsets = np.concatenate([[0], ends // 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a binary column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def differing_bits(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Bits in which the parity bitmaps of each row differ, the longer one folded to the size of the shorter."""
    (x, x_at), (y, y_at) = binary_parts(left), binary_parts(right)
    sizes = np.stack([np.diff(x_at), np.diff(y_at)], axis=1)
    out = np.zeros(len(left), np.int64)
    # Sizes are powers of two, so the rows of a batch fall into few groups.
    for a, b in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes[:, 0] == a) & (sizes[:, 1] == b))
        folded = []
        for data, at, size in ((x, x_at, a), (y, y_at, b)):
            bits = data[at[rows][:, None] + np.arange(size)]
            while bits.shape[1] > min(a, b):
                half = bits.shape[1] // 2
                bits = bits[:, :half] ^ bits[:, half:]
            folded.append(bits)
        out[rows] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64)
    return out


def signature(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set."""
    out = []
    for number in (1, 2):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h + salt(number)), out=total[1:])
        out.append((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
    return out[0], out[1]


def sets_of(docs: DataFrame, chosen: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of a document for each of the chosen classes (node, id, key)."""
    named = chosen.select("node", F.col("id").alias("own"), "key")
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    met = narrow.join(F.broadcast(named) if chosen.count() <= BROADCAST_IDS else named, F.col("id") == F.col("own"))
    return met.where(F.col("key") == text_key(F.col("text"))).select("node", "text")


def whole_sets(docs: DataFrame, chosen: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) with the sorted hashes, as bytes, of the chosen classes; repeated rows give repeated sets."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                h, cuts = shingle_sets(*word_hashes(data, offsets), part.num_rows, width)
                raw = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((cuts * 8).astype(np.int32).tobytes()), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), raw], ["node", "shingles"])

    return sets_of(docs, chosen, width, id_col, text_col).mapInArrow(run, "node long, shingles binary")


def entries_of(classes: DataFrame) -> DataFrame:
    return classes.select("node", "n", F.posexplode("prefix").alias("at", "shingle"))


def crowded_columns(classes: DataFrame) -> DataFrame:
    """(shingle, seen) of the columns that more than one class begins with."""
    return materialize(classes.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1"))


# ---------------------------------------------------------------- the product


class Cell:
    """The rows of a pair of row blocks, as sorted codes: the row's number above SHINGLE_BITS bits of a shingle."""

    def __init__(self, nodes: np.ndarray, parts: list[pa.Array], members: np.ndarray | None = None) -> None:
        nodes, first = np.unique(nodes, return_index=True)  # repeated rows come with equal sets
        self.members = np.ones(len(nodes), np.int64) if members is None else members[first]
        held = [binary_parts(p) for p in parts]
        sets = np.concatenate([np.frombuffer(data[at[0] : at[-1]].tobytes(), np.uint64) for data, at in held]) if held else np.zeros(0, np.uint64)
        sizes = np.concatenate([np.diff(at) // 8 for _, at in held]) if held else np.zeros(0, np.int64)
        start = np.cumsum(sizes) - sizes
        self.nodes, self.n = nodes, sizes[first]
        self.row = np.cumsum(self.n) - self.n
        row = np.repeat(np.arange(len(nodes)), self.n)
        h = sets[np.arange(len(row)) - np.repeat(self.row - start[first], self.n)]
        self.code = (row.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | (h >> np.uint64(64 - SHINGLE_BITS))
        # Where each column block of each row begins.
        counts = np.bincount(row << COLUMN_BITS | (h >> np.uint64(64 - COLUMN_BITS)).astype(np.int64), minlength=len(nodes) << COLUMN_BITS)
        self.block = np.concatenate([[0], np.cumsum(counts)])

    def overlaps(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Overlap count of each pair of rows that reaches the bound of its sizes, else -1."""
        need = -(-percent * (self.n[a] + self.n[b]) // (100 + percent))
        small, large = np.where(self.n[a] <= self.n[b], a, b), np.where(self.n[a] <= self.n[b], b, a)
        total, live = np.zeros(len(a), np.int64), np.arange(len(a))
        mask = np.uint64((1 << SHINGLE_BITS) - 1)
        for column in range(1 << COLUMN_BITS):
            lo = self.block[(small[live] << COLUMN_BITS) + column]
            hi = self.block[(small[live] << COLUMN_BITS) + column + 1]
            cuts = np.concatenate([[0], np.cumsum(hi - lo)])
            begin = 0
            while begin < len(live):
                end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + ENTRIES, side="right")) - 1)
                sizes = (hi - lo)[begin:end]
                pair = np.repeat(np.arange(begin, end), sizes)
                at = np.arange(len(pair)) - np.repeat(cuts[begin:end] - cuts[begin] - lo[begin:end], sizes)
                wanted = (large[live[pair]].astype(np.uint64) << np.uint64(SHINGLE_BITS)) | (self.code[at] & mask)
                found = np.minimum(np.searchsorted(self.code, wanted), len(self.code) - 1)
                total[live[begin:end]] += np.bincount(pair[self.code[found] == wanted] - begin, minlength=end - begin)
                begin = end
            left = np.minimum((self.row + self.n)[small[live]] - hi, (self.row + self.n)[large[live]] - self.block[(large[live] << COLUMN_BITS) + column + 1])
            live = live[total[live] + left >= need[live]]
            if not len(live):
                break
        out = np.full(len(a), -1, np.int64)
        out[live] = total[live]
        return np.where(out >= need, out, -1)


Batches = Iterator[pa.RecordBatch]


def cells(batches: Batches) -> Iterator[tuple[int, list[pa.RecordBatch], list[pa.RecordBatch], bool]]:
    """(cell, its rows, some of its pairs, whether they are its last) of batches (cell, kind, a, others, n, held), sorted by cell and kind: rows (kind 0), then pairs (kind 1)."""
    now, held, pairs, size = None, [], [], 0
    for batch in batches:
        group = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi == lo:
                continue
            part, own = batch.slice(lo, hi - lo), int(group[lo]) >> 1
            if own != now:
                if now is not None:
                    yield now, held, pairs, True
                now, held, pairs, size = own, [], [], 0
            if not group[lo] & 1:
                held.append(part)
                continue
            if size >= PAIRS:
                yield now, held, pairs, False
                pairs, size = [], 0
            pairs.append(part)
            size += len(part.column(3).flatten())
    if now is not None:
        yield now, held, pairs, True


def ends_of(pairs: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Both nodes of each pair."""
    none = np.zeros(0, np.int64)
    a = [np.repeat(p.column(2).to_numpy(), p.column(3).value_lengths().to_numpy()) for p in pairs]
    return np.concatenate([none, *a]), np.concatenate([none, *(p.column(3).flatten().to_numpy() for p in pairs)])


def not_too_different(percent: int) -> Callable[[Batches], Batches]:
    """A function over the batches of ``cells``, whose rows hold bitmaps: (cell, kind, a, others) of the pairs that the bitmaps don't rule out and of the rows in them."""

    @tidy
    def run(batches: Batches) -> Batches:
        now, told = None, np.zeros(0, np.int64)
        for cell, held, pairs, _ in cells(batches):
            if cell != now:
                now, told = cell, np.zeros(0, np.int64)
            rows = pa.Table.from_batches(held).combine_chunks()
            nodes, n, bits = rows.column(2).to_numpy(), rows.column(4).to_numpy(), pa.concat_arrays(rows.column(5).chunks)
            by = np.argsort(nodes)
            a, b = ends_of(pairs)
            i, j = (by[np.searchsorted(nodes, x, sorter=by)] for x in (a, b))
            differ = [differing_bits(bits.take(pa.array(i[k : k + SLICE])), bits.take(pa.array(j[k : k + SLICE]))) for k in range(0, len(a), SLICE)]
            kept = (100 + percent) * np.concatenate([np.zeros(0, np.int64), *differ]) <= (100 - percent) * (n[i] + n[j])
            a, b = a[kept], b[kept]
            new = np.setdiff1d(np.concatenate([a, b]), told)
            told = np.concatenate([told, new])
            by = np.argsort(a, kind="stable")
            own, first = np.unique(a[by], return_index=True)
            cuts = np.concatenate([np.zeros(len(new) + 1, np.int64), np.append(first, len(a))[1:]]).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(cuts), pa.array(b[by]))
            kind = np.repeat(np.array([0, 1], np.int32), [len(new), len(own)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kind), cell)), pa.array(kind), pa.array(np.concatenate([new, own])), others], ["cell", "kind", "a", "others"])

    return run


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the least row of its component, after the links (a, b)."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def products(percent: int, pairwise: bool) -> Callable[[Batches], Batches]:
    """A function over the batches of ``cells``, whose rows hold sets and their number of documents: (a, b, overlap) of each link, or (node, root, near) of each linked row: the least row it is tied to and the documents it links with."""

    @tidy
    def run(batches: Batches) -> Batches:
        now, cell = None, None
        for own, held, pairs, last in cells(batches):
            if own != now:
                now, cell = own, Cell(*(np.concatenate([r.column(k).to_numpy() for r in held]) if k != 5 else [r.column(k) for r in held] for k in (2, 5, 4)))
                label, near = np.arange(len(cell.nodes)), np.zeros(len(cell.nodes), np.int64)
            a, b = (np.searchsorted(cell.nodes, x) for x in ends_of(pairs))
            overlap = cell.overlaps(a, b, percent)
            a, b, overlap = a[overlap >= 0], b[overlap >= 0], overlap[overlap >= 0]
            if pairwise:
                yield pa.RecordBatch.from_arrays([pa.array(cell.nodes[a]), pa.array(cell.nodes[b]), pa.array(overlap)], ["a", "b", "overlap"])
                continue
            label = united(label, a, b)
            np.add.at(near, a, cell.members[b])
            np.add.at(near, b, cell.members[a])
            if last:
                some = np.flatnonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(cell.nodes[some]), pa.array(cell.nodes[label[some]]), pa.array(near[some])], ["node", "root", "near"])

    return run


def in_cells(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (cell, a, n, held) and pairs (cell, a, others), as the functions over cells want them."""
    rows = rows.select("cell", F.lit(0).alias("kind"), "a", F.lit(None).cast("array<long>").alias("others"), "n", "held")
    both = rows.unionByName(pairs.select("cell", F.lit(1).alias("kind"), "a", "others", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("held")))
    return both.repartition("cell").sortWithinPartitions("cell", "kind").select("cell", "kind", "a", "others", "n", "held")


def placed(blocks: int) -> Callable[[Batches], Batches]:
    """A function over (a, others, own), sorted by own and a, where own is the row block of a: (cell, kind, a, others) of each cell's pairs, once, and of the rows that it needs for them.

    All of a row block's pairs come to one task, so it names the other ends once, not again for each of its rows.
    """

    @tidy
    def run(batches: Batches) -> Batches:
        now, told = None, np.zeros(0, np.int64)
        for a, others, own in whole_groups(batches):
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if own[lo] != now or len(told) > TOLD:
                    now, told = own[lo], np.zeros(0, np.int64)
                part = others.slice(lo, hi - lo)
                x, b = np.repeat(a[lo:hi], part.value_lengths().to_numpy()), part.flatten().to_numpy()
                block = lambda ends: now * blocks + (mix(ends.view(np.uint64) + salt(3)) % np.uint64(blocks)).astype(np.int64)  # noqa: B023, E731
                cell = block(b)
                first, listed = listed_pairs(x, b, cell)
                new = np.setdiff1d(b, told)
                told = np.union1d(told, new)
                cells_of, nodes = np.concatenate([cell[first], block(new)]), np.concatenate([x[first], new])
                kind = np.repeat(np.array([0, 1], np.int32), [len(nodes), len(first)])
                held = pa.concat_arrays([pa.nulls(len(nodes), listed.type), listed])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cells_of, cell[first]])), pa.array(kind), pa.array(np.concatenate([nodes, x[first]])), held], ["cell", "kind", "a", "others"])

    return run


def in_row_blocks(pairs: DataFrame, blocks: int) -> DataFrame:
    """``placed`` of pairs (a, others), dealt by the row block of ``a``."""
    dealt = pairs.select("a", "others", F.pmod(F.xxhash64("a"), F.lit(blocks)).alias("own"))
    return dealt.repartition("own").sortWithinPartitions("own", "a").mapInArrow(placed(blocks), "cell long, kind int, a long, others array<long>")


def close_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(cell, kind, a, others) of the pairs of nodes that bitmaps leave (kind 1), and of the rows that each cell needs for them (kind 0); ``pairs``: (a, b), or (a, others) as ``gathered`` gives them."""
    if "b" in pairs.columns:
        none = F.array().cast("array<long>")
        pairs = pairs.select("a", F.array("b").alias("others")).union(pairs.select("b", none))
    held = classes.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    blocks = max(ROW_BLOCKS, math.ceil((held["n"] or 0) * 8 / BLOCK_BYTES), math.ceil(held["rows"] / BLOCK_ROWS))
    dealt = materialize(in_row_blocks(pairs, blocks))
    wanted = dealt.where("kind = 0").select("cell", F.col("a").alias("node")).distinct()
    rows = wanted.join(classes.select("node", "n", F.col("bits").alias("held")), "node").select("cell", F.col("node").alias("a"), "n", "held")
    return in_cells(rows, dealt.where("kind = 1").select("cell", "a", "others")).mapInArrow(not_too_different(percent), "cell long, kind int, a long, others array<long>")


def possible(n1: str, at1: str, n2: str, at2: str, percent: int) -> str:
    """SQL: can two sets of these sizes, whose first shared column stands at these places, reach the bound?"""
    most = f"least({n1} - {at1}, {n2} - {at2})"
    return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) AND {100 + percent} * {most} >= {percent} * ({n1} + {n2})"


def prepared(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their sets' digests; a class, with a node's number, per distinct set; the classes' first columns that more than one has."""
    ship(docs.sparkSession)
    seen = frequent_shingles(docs, width, text_col)
    rows = materialize(incidence(docs, ranked(*seen), width, percent, id_col, text_col))
    known = rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = known.groupBy("n", "sig_a", "sig_b").agg(F.min(F.struct("id", "key", "prefix", "bits")).alias("least"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "n", "sig_a", "sig_b", "least.id", "least.key", "least.prefix", "least.bits"))
    crowded = crowded_columns(classes)
    # Sizes over the bound differ by one class at most; at 100 percent they are equal.
    size_class = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    return rows, classes, materialize(entries_of(classes).join(crowded.select("shingle"), "shingle").withColumn("class", size_class))


def listed_pairs(a: np.ndarray, b: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Of distinct pairs: the places of the first of each ``a`` (and keys), sorted, and a list of its ``b``."""
    by = np.lexsort((b, a, *keys))
    columns = [c[by] for c in (*keys, a)]
    new, again = np.ones(len(a), bool), np.zeros(len(a), bool)
    if len(a):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        again[1:] = ~new[1:] & (b[by][1:] == b[by][:-1])
    by, new = by[~again], new[~again]
    cuts = np.append(np.flatnonzero(new), len(by)).astype(np.int32)
    return by[new], pa.ListArray.from_arrays(pa.array(cuts), pa.array(b[by]))


def whole_groups(batches: Batches) -> Iterator[list[np.ndarray | pa.Array]]:
    """The columns of many rows at once, in which equal values of the first stand together; no group of them is cut. Elements of lists count as rows."""
    weight = lambda batch: batch.num_rows + sum(len(c.flatten()) for c in batch.columns if pa.types.is_list(c.type))
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += weight(batch)
        last = batch.column(0).to_numpy()
        if size >= GATHERED and (cut := int(np.flatnonzero(np.append(True, last[1:] != last[:-1]))[-1])):
            held[-1] = batch.slice(0, cut)
            yield _columns(held)
            held = [batch.slice(cut)]
            size = weight(held[0])
    if held:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> list[np.ndarray | pa.Array]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return [pa.concat_arrays(c.chunks) if pa.types.is_list(c.type) else c.to_numpy() for c in table.columns]


def meeting(percent: int) -> Callable[[Batches], Batches]:
    """A function over entries (key, side, up, node, n, at, root), sorted by key and side: (a, others) of the rows of both sides of a key that the bounds leave as pairs, and their other ends with no others."""

    def said(met: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met])
        first, others = listed_pairs(a, b)
        ends = np.setdiff1d(b, a)
        others = pa.concat_arrays([others, pa.array([[]] * len(ends), others.type)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[first], ends])), others], ["a", "others"])

    @tidy
    def run(batches: Batches) -> Batches:
        for key, side, up, node, n, at, root in whole_groups(batches):
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
            left = np.bincount(group, weights=1 - side).astype(np.int64)
            right = np.diff(np.append(start, len(key))) - left
            rows = np.flatnonzero(side == 0)
            cuts = np.concatenate([[0], np.cumsum(right[group[rows]])])
            met, size, begin = [], 0, 0
            while begin < len(rows):
                end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + MET, side="right")) - 1)
                own = rows[begin:end]
                many = right[group[own]]
                i = np.repeat(own, many)
                j = np.arange(len(i)) - np.repeat(cuts[begin:end] - cuts[begin] - (start + left)[group[own]], many)
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                kept = ((up[j] > 0) & (node[i] != node[j]) | (node[i] < node[j])) & (root[i] != root[j])
                kept &= (100 * small >= percent * large) & ((100 + percent) * np.minimum(n[i] - at[i], n[j] - at[j]) >= percent * (n[i] + n[j]))
                i, j = node[i[kept]], node[j[kept]]
                met.append((np.minimum(i, j), np.maximum(i, j)))
                size, begin = size + len(i), end
                if size >= MET:
                    yield said(met)
                    met, size = [], 0
            if size:
                yield said(met)

    return run


def gathered(shared: DataFrame, percent: int) -> DataFrame:
    """(a, others) of the pairs of classes a < b that a column and the bounds leave, and a row with no others for each end; rows of one ``a`` can repeat, and pairs in them; of different roots, if ``shared`` has them.

    Rows meet inside a task: a join would write a row for each column and pair.
    """
    parts = shared.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("parts"))
    each = shared if "root" in shared.columns else shared.withColumn("root", F.col("node"))
    each = each.join(parts, "shingle")
    kept = ["node", "n", F.col("at").cast("long").alias("at"), "root"]
    x = each.select("shingle", F.col("class").alias("block"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("salt"), F.lit(0).alias("side"), F.lit(0).alias("up"), *kept)
    # Sizes within the bound differ by one class at most, so the larger row comes to its own block and the one below.
    y = each.select("shingle", F.explode(F.array(F.lit(0), F.lit(1))).alias("up"), "class", "parts", *kept).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    y = y.select("shingle", (F.col("class") - F.col("up")).alias("block"), "salt", F.lit(1).alias("side"), "up", *[c if isinstance(c, str) else "at" for c in kept])
    # Keys that are equal by chance only add pairs to be looked at.
    dealt = x.unionByName(y).select(F.xxhash64("shingle", "block", "salt").alias("key"), "side", "up", "node", "n", "at", "root")
    return dealt.repartition("key").sortWithinPartitions("key", "side").mapInArrow(meeting(percent), "a long, others array<long>")


def candidates(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of every pair that ``gathered`` finds, once; to look at them, as their number grows with the square of a group."""
    return gathered(shared, percent).select("a", F.explode("others").alias("b")).distinct()


def counted(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int, id_col: str, text_col: str, members: DataFrame | None = None, pairwise: bool = False) -> DataFrame:
    """(a, b, overlap) of the pairs of nodes that link, or (node, root, near) of the linked nodes of each cell; ``members`` (node, members) weighs what ``near`` counts."""
    close = materialize(close_pairs(pairs, classes, percent))
    wanted, left = close.where("kind = 0").select("cell", F.col("a").alias("node")), close.where("kind = 1")
    ends = wanted.select("node").distinct()
    sets = materialize(whole_sets(docs, classes.join(ends, "node", "left_semi").select("node", "id", "key"), width, id_col, text_col))
    rows = wanted.join(sets, "node")
    rows = rows.withColumn("members", F.lit(1).cast("long")) if members is None else rows.join(members, "node")
    rows = rows.select("cell", F.col("node").alias("a"), F.col("members").alias("n"), F.col("shingles").alias("held"))
    return materialize(in_cells(rows, left).mapInArrow(products(percent, pairwise), "a long, b long, overlap long" if pairwise else "node long, root long, near long"))


def links(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, overlap), a < b, of every linked pair of different sets; a set stands under the least id that has it."""
    _, classes, shared = prepared(docs, width, percent, id_col, text_col)
    found = counted(docs, materialize(gathered(shared, percent)), classes, width, percent, id_col, text_col, pairwise=True)
    for end in ("a", "b"):
        found = found.join(classes.select(F.col("node").alias(end), F.col("id").alias(f"id_{end}")), end)
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "overlap")


def placed_classes(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """The classes with component_id, the least id of their component."""
    roots = components(edges)
    own = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("id").alias("component_id"))
    return own.join(least, "root")


def join_links(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, n_links, component_id of every row.

    ``n_links`` counts the other identified documents that the row's set links with,
    those with the same set included; it is null where the component is.
    """
    rows, classes, shared = prepared(docs, width, percent, id_col, text_col)
    key = ["n", "sig_a", "sig_b"]
    sizes = rows.where(F.col("id").isNotNull()).select(*key, "id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("members"))
    named = materialize(classes.select("node", *key, "id").join(sizes, key))
    found = counted(docs, materialize(gathered(shared, percent)), classes, width, percent, id_col, text_col, members=named.select("node", "members"))
    of_class = placed_classes(named, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked_to = found.groupBy("node").agg(F.sum("near").alias("others"))
    of_class = of_class.join(linked_to, "node", "left").select(*key, (F.col("members") + F.coalesce("others", F.lit(0))).alias("near"), "component_id")
    out = rows.select("id", *key).join(of_class, key, "left")
    empty = F.col("n") == 0
    n_links = F.when(empty, F.lit(0)).otherwise(F.col("near") - F.col("id").isNotNull().cast("int")).cast("long")
    own = F.when(empty, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), n_links.alias("n_links"), own.alias("component_id"))


def spanning_links(docs: DataFrame, classes: DataFrame, shared: DataFrame, rounds: int, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b) of enough links to join every component."""
    spark = docs.sparkSession
    edges = spark.createDataFrame([], "a long, b long")
    still = shared.withColumn("root", F.col("node"))
    for number in range(rounds + 1):
        if number < rounds:
            draw = F.col("node") if number == 0 else F.xxhash64("node", "shingle", F.lit(number))
            leaders = still.groupBy("shingle", "class").agg(F.min(F.struct(draw.alias("draw"), F.col("node"), F.col("n"), F.col("at"), F.col("root"))).alias("l"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
            met = still.join(leaders, ["shingle", "class"]).where("root != l.root").where(possible("n", "at", "l.n", "l.at", percent))
            pairs = met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()
        else:
            pairs = gathered(still, percent)
        pairs = materialize(pairs)
        if pairs.isEmpty():
            continue
        new = counted(docs, pairs, classes, width, percent, id_col, text_col)
        edges = edges.union(new.select(F.col("node").alias("a"), F.col("root").alias("b")))
        if number < rounds:
            # Columns whose rows all belong to one component are done with.
            roots = materialize(components(edges))
            placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            spanning = placed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("shingle")
            still = materialize(placed.join(spanning, "shingle"))
    return edges


def components_of(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, rounds: int) -> DataFrame:
    """(id, key, n, component_id) of every row."""
    rows, classes, shared = prepared(docs, width, percent, id_col, text_col)
    edges = spanning_links(docs, classes, shared, rounds, width, percent, id_col, text_col)
    key = ["n", "sig_a", "sig_b"]
    of_class = placed_classes(classes.select("node", *key, "id"), edges).select(*key, "component_id")
    out = rows.select("id", "key", *key).join(of_class, key, "left")
    return out.select("id", "key", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def join_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; sets link at a Jaccard similarity of percent / 100 or more."""
    return components_of(docs, width, percent, id_col, text_col, rounds).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """The rows of ``docs`` with the least id of their component, all columns as they were, whatever their names.

    Rows with equal ids and texts are one document and stay or go together; of different
    texts of that id in the component, the one with the least digest stays. Rows without
    an id or without words stay.
    """
    member = materialize(components_of(docs, width, percent, id_col, text_col, rounds).where(F.col("id").isNotNull() & (F.col("n") > 0)))
    best = member.where("id = component_id").groupBy("component_id").agg(F.min("key").alias("best"))
    own_id, own_key = fresh("lost_id", docs), fresh("lost_key", docs)
    # A component's own row is in ``member``, so none is without its best.
    lost = member.join(best, "component_id").where("id != component_id OR key != best").select(F.col("id").alias(own_id), F.col("key").alias(own_key))
    lost = materialize(lost.distinct())
    few = lost.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(lost) if few else lost, (docs[id_col] == lost[own_id]) & (text_key(docs[text_col]) == lost[own_key]), "left_anti")


def oracle(width: int = 4, percent: int = 85) -> str:
    """DuckDB SQL of the query on documents: all sharing pairs are counted, then least ids spread along links."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i : i + {width - 1}], ' '))) END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= {percent} * (na.n + nb.n - i)),
m AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(x, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT m.b, reach.c FROM reach JOIN m ON m.a = reach.x WHERE reach.c < m.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(c) AS component_id FROM n JOIN reach ON reach.x = n.doc_id GROUP BY n.doc_id, n.n
"""
