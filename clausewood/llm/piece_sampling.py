"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The lattice of a text has its characters as nodes and the vocabulary's pieces as
edges; a character that no piece has gets an edge of byte pieces. A piece of merge
rank r weighs 1 / (r + 2), Zipf's law over the ranks of the file, and a
segmentation has the product of its weights over their sum for all segmentations
(backward sums over the lattice).

Samples are drawn by perturbed A* search over the tree of prefixes. The root's
maximum is a Gumbel draw. Going down, the best child is drawn by its probability
and keeps its parent's maximum; the other children of a node form one group whose
maximum is a Gumbel draw truncated at it. The queue holds these groups; the next
sample opens the group of the greatest maximum. So samples come out distinct and
in the order of their perturbed log probability, as if every segmentation had been
perturbed. The greatest maximum left over, kappa, gives a sample's inclusion score
1 - exp(-exp(log_prob - kappa)). All draws are hashes of the row key, the sample
and the place, so a row gives the same samples wherever it is run.

No piece has a blank behind another character or a newline, so lattices are parted
there and equal parts share one lattice; the whole text is always covered. All
lattices of a slice of rows are built and walked at once as arrays; a worker keeps
those of the first parts it meets, up to a bound.

Decoding joins the pieces' bytes and drops the blank that encoding puts in front.

Defined results: null and empty texts have one segmentation, without pieces, of
log probability 0 and inclusion score 1; a text with fewer than k segmentations
gives them all, each with inclusion score 1; repeated rows give equal samples; a
null key has a seed of its own; an empty table gives an empty result; further
columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewood.llm.common import M1, M2, M3, hash_sums, mix, slices, span_hashes, tidy
from clausewood.runtime import ship

BLANK = "▁"
#: Groups this far below k + 1 others can't be among the next k: a draw of 53 bits lies between -3.7 and 37.5.
SPREAD = 42.0
#: Bytes of text whose lattices are held at once; a lattice takes about a hundred times its text.
LATTICE_BYTES = 1 << 17
#: Edges of lattices that a worker keeps for the slices to come: those of the parts it met first.
KEPT_EDGES = 500_000
#: Steps of a path that are looked at before the whole path is.
HEAD = 512
SLOT_BITS = 19


class Pieces:
    """The vocabulary: bytes and weight of each piece, and a hash table of them and of their beginnings."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.raw: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        ids, weights = [], []
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.raw[i], self.byte_id[value] = bytes([value]), i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                self.raw[i] = model.id_to_piece(i).replace(BLANK, " ").encode()
                ids.append(i)
                weights.append(-np.log(2.0 - model.get_score(i)))
        if any(b"\n" in self.raw[i] or b" " in self.raw[i].lstrip(b" ") for i in ids):
            raise ValueError("a piece crosses a newline or a blank; lattices can't be parted there")
        lengths = np.array([len(self.raw[i]) for i in ids])
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(self.raw[i] for i in ids), np.uint8)
        # All beginnings of pieces, with id -1 where they are no piece themselves.
        begin = np.repeat(ends - lengths, lengths)
        keys = span_keys(*hash_sums(data), begin, np.arange(1, len(data) + 1))
        whole = np.zeros(len(data), bool)
        whole[ends - 1] = True
        order = np.lexsort((~whole, keys))
        order = order[np.append(True, keys[order][1:] != keys[order][:-1])]
        owner = np.repeat(np.arange(len(ids)), lengths)[order]
        self.keys, self.ids = keys[order], np.where(whole[order], np.array(ids, np.int32)[owner], np.int32(-1))
        self.weights = np.array(weights)[owner]
        self.longest = int(lengths.max(initial=0))
        self.byte_weight = -np.log(float(size))
        # Slots by the high bits of a key hold the place in ``keys``; the few that clash are searched for.
        self.shift = np.uint64(64 - SLOT_BITS)
        slot = (self.keys >> self.shift).astype(np.int64)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slots[slot] = np.arange(len(slot), dtype=np.int32)
        self.crowded = np.zeros(1 << SLOT_BITS, bool)
        self.crowded[slot[self.slots[slot] != np.arange(len(slot))]] = True
        self.kept = Lattices(self.byte_id)
        self.raw_sizes = np.array([len(r) for r in self.raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.raw_data = np.frombuffer(b"".join(self.raw), np.uint8)

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of pieces, joined."""
        sizes = self.raw_sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.raw_starts[ids] - ends + sizes, sizes)
        return self.raw_data[at].tobytes()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in ``keys``, or -1."""
        slot = (keys >> self.shift).astype(np.int64)
        place = self.slots[slot]
        hit = (place >= 0) & (self.keys[place] == keys)
        out = np.where(hit, place, -1)
        again = np.flatnonzero(~hit & self.crowded[slot])
        if len(again):
            at = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            out[again] = np.where(self.keys[at] == keys[again], at, -1)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "surrogatepass") if ids else ""


def span_keys(total: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span's bytes; its high bits are well spread."""
    return (total[ends] - total[starts]) * down[starts]


class Lattices:
    """Lattices of distinct parts as arrays: the edges of each node in a row, nodes numbered from 1; node 0 is every part's end.

    A worker keeps the lattices of the first parts it meets, up to ``KEPT_EDGES``; those of a
    slice's other parts stand behind them and give way to the next slice's.
    """

    FIELDS = {"src": np.int32, "dst": np.int32, "ids": np.int32, "p": np.float32, "log_p": np.float64, "log_rest": np.float32}

    def __init__(self, byte_id: np.ndarray) -> None:
        self.byte_id = byte_id
        for name, kind in self.FIELDS.items():
            setattr(self, name, np.zeros(0, kind))
        self.edge = np.zeros(2, np.int32)
        self.nodes, self.edges = 1, 0  # kept
        self.known, self.known_first = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values behind the kept ones, in a new array if there is no room or far too much."""
        held = getattr(self, name)
        need = at + len(values)
        if len(held) < need or len(held) > 4 * need + (1 << 20):
            held = np.concatenate([held[:at], np.zeros(need - at + (need >> 3), held.dtype)])
            setattr(self, name, held)
        held[at:need] = values

    def firsts(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The first node of each part; parts that aren't kept get their lattices."""
        hashes, first, kind = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        node = np.zeros(len(hashes), np.int32)
        old = np.zeros(len(hashes), bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            old = self.known[at] == hashes
            node[old] = self.known_first[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            node[new], nodes, edges = self.build(pieces, data, starts[first[new]], ends[first[new]])
            if edges <= KEPT_EDGES:
                self.nodes, self.edges = nodes, edges
                known = np.concatenate([self.known, hashes[new]])
                order = np.argsort(known)
                self.known, self.known_first = known[order], np.concatenate([self.known_first, node[new]])[order]
        return node[kind]

    def build(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int, int]:
        """(first node of each part, nodes, edges): write the lattices of distinct parts behind the kept ones."""
        sizes = ends - starts
        base = np.cumsum(sizes + 1) - sizes - 1
        text = data[np.minimum(np.repeat(starts - base, sizes + 1) + np.arange(int((sizes + 1).sum())), len(data) - 1)]
        total = len(text)
        stop = np.repeat((base + sizes).astype(np.int32), sizes + 1)
        is_node = ((text & 0xC0) != 0x80) | (np.arange(total) == stop)
        by_place = np.flatnonzero(is_node).astype(np.int32)
        count = np.cumsum(is_node, dtype=np.int32)
        level = count[stop[by_place]] - count[by_place]
        order = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 65536 else level, kind="stable")
        inner = int(np.count_nonzero(level == 0))
        # Nodes in the order of their distance from the part's end; the ends themselves are node 0.
        order = order[inner:]
        at, level = by_place[order], level[order]
        after = by_place[order + 1]
        number = np.zeros(total, np.int32)
        number[at] = np.arange(self.nodes, self.nodes + len(at), dtype=np.int32)
        room = stop[at] - at
        sums = hash_sums(text)
        src, dst, ids, weight, found_one = [], [], [], [], np.zeros(len(at), bool)
        some = np.arange(len(at), dtype=np.int32)
        for size in range(1, pieces.longest + 1):
            some = some[room[some] >= size]
            if not len(some):
                break
            begin = at[some]
            place = pieces.find(span_keys(*sums, begin, begin + size))
            # Where no piece begins like this, no longer one does.
            on = place >= 0
            some, place = some[on], place[on]
            end = at[some] + size
            hit = np.flatnonzero((pieces.ids[place] >= 0) & is_node[end])
            own, place, end = some[hit], place[hit], end[hit]
            src.append(own)
            dst.append(number[end])
            ids.append(pieces.ids[place])
            weight.append(pieces.weights[place])
            found_one[own[end == after[own]]] = True
        bare = np.flatnonzero(~found_one).astype(np.int32)
        width = after[bare] - at[bare]
        src.append(bare)
        dst.append(number[after[bare]])
        ids.append(np.where(width == 1, self.byte_id[text[at[bare]]], -1 - code_points(text, at[bare], width)).astype(np.int32))
        weight.append(pieces.byte_weight * width)
        own_src = np.concatenate(src)
        by_src = np.argsort(own_src, kind="stable")
        own_src = own_src[by_src]
        w, own_dst = np.concatenate(weight)[by_src], np.concatenate(dst)[by_src]
        edge = np.searchsorted(own_src, np.arange(len(at) + 1)).astype(np.int32)
        self.put("src", self.edges, own_src + np.int32(self.nodes))
        self.put("dst", self.edges, own_dst)
        self.put("ids", self.edges, np.concatenate(ids)[by_src])
        del src, dst, ids, weight, by_src, sums, stop, order, by_place, count, after, room
        # Backward sums, level by level.
        beta = np.zeros(len(at) + 1)
        target = np.where(own_dst == 0, len(at), own_dst - self.nodes)
        p = np.empty(len(w))
        bounds = np.searchsorted(level, np.arange(1, int(level.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            a, b = edge[lo], edge[hi]
            value = w[a:b] + beta[target[a:b]]
            cuts = edge[lo:hi] - a
            own = own_src[a:b] - lo
            most = np.maximum.reduceat(value, cuts)
            e = np.exp(value - most[own])
            s = np.add.reduceat(e, cuts)
            beta[lo:hi] = most + np.log(s)
            p[a:b] = e / s[own]
        alone = (edge[1:] - edge[:-1])[own_src] == 1
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(p, 1.0))
            rest[alone] = -np.inf
            self.put("p", self.edges, p)
            self.put("log_p", self.edges, np.log(p))
            self.put("log_rest", self.edges, rest)
        self.put("edge", self.nodes, edge + np.int32(self.edges))
        return number[base], self.nodes + len(at), self.edges + len(w)

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges of all paths in order, edges of each path): a random path from each node to its part's end."""
        live = np.flatnonzero(nodes > 0).astype(np.int32)
        at, seed = nodes[live], seeds[live]
        owners, edges = [], []
        step = 0
        while len(live):
            step += 1
            u = uniform(seed + np.uint64(step * int(M3) % (1 << 64)))
            edge = self.edge[at]
            last = self.edge[at + 1] - 1
            left = u - self.p[edge]
            more = np.flatnonzero((left >= 0) & (edge < last))
            while len(more):
                edge[more] += 1
                left[more] -= self.p[edge[more]]
                more = more[(left[more] >= 0) & (edge[more] < last[more])]
            owners.append(live)
            edges.append(edge)
            at = self.dst[edge]
            on = at > 0
            live, at, seed = live[on], at[on], seed[on]
        counts = np.bincount(np.concatenate(owners), minlength=len(nodes)) if owners else np.zeros(len(nodes), np.int64)
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for number, (o, e) in enumerate(zip(owners, edges, strict=True)):
            out[begin[o] + number] = e
        return out, counts

    def piece_ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path; an edge of byte pieces gives several."""
        ids = self.ids[edges]
        if not len(ids) or ids.min() >= 0:
            return ids
        out: list[int] = []
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
            else:
                out += self.byte_id[list(chr(-1 - i).encode())].tolist()
        return np.array(out, np.int32)


def code_points(text: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The code point of the UTF-8 character of ``width`` bytes at each place."""
    lead = text[at].astype(np.int32)
    point = np.where(width == 1, lead, lead & (0x7F >> np.minimum(width, 4)))
    for k in range(1, 4):
        more = width > k
        point[more] = point[more] << 6 | (text[at[more] + k] & 0x3F)
    return point


def uniform(x: np.ndarray) -> np.ndarray:
    """Draws in (0, 1) from hashes."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def gumbel(x: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(uniform(x)))


def one_uniform(x: int) -> float:
    """``uniform`` of a single number."""
    mask = (1 << 64) - 1
    x &= mask
    x = (x ^ x >> 30) * int(M2) & mask
    x = (x ^ x >> 27) * int(M3) & mask
    return (((x ^ x >> 31) >> 11) + 0.5) / float(1 << 53)


def part_bounds(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin: at a text, at a blank behind another character, and before and behind a newline."""
    blank, newline = data == 32, data == 10
    cut = np.zeros(len(data), bool)
    cut[1:] = (blank[1:] & ~blank[:-1]) | newline[1:] | newline[:-1]
    cut[first] = True
    return np.flatnonzero(cut)


class Sampler:
    """Draws the samples of one slice of texts."""

    def __init__(self, pieces: Pieces, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, k: int) -> None:
        self.k, self.seeds = k, seeds
        sizes = np.diff(offsets)
        self.full = np.flatnonzero(sizes > 0)
        # A blank is put in front of each text that isn't empty.
        text = np.insert(data, offsets[self.full], 32)
        first = offsets[self.full] + np.arange(len(self.full))
        starts = part_bounds(text, first)
        ends = np.append(starts[1:], len(text))
        self.lattices = pieces.kept
        self.starts = self.lattices.firsts(pieces, text, starts, ends)
        self.part_cuts = np.append(np.searchsorted(starts, first), len(starts))

    def draw(self) -> Iterator[tuple[int, list[tuple[np.ndarray, float, float]], float]]:
        """(row, [(edges, log_prob, perturbed)], kappa) of each text that isn't empty."""
        lat, n = self.lattices, len(self.full)
        seeds = self.seeds[self.full]
        cuts = self.part_cuts
        paths: list[list[tuple[np.ndarray, np.ndarray, float, float]]] = [[] for _ in range(n)]
        queues: list[list[tuple[float, int, int, tuple[int, ...]]]] = [[] for _ in range(n)]
        peaks = gumbel(seeds + M2)
        prefix: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        active = np.arange(n)
        begin = cuts[:-1].copy()
        entry = np.zeros(n, np.int32)  # a node inside a part from which the first walk goes on
        for sample in range(self.k):
            inside = entry[active] > 0
            sizes = cuts[active + 1] - begin[active] + inside
            node_ends = np.concatenate([[0], np.cumsum(sizes)])
            number = np.arange(node_ends[-1]) - np.repeat(node_ends[:-1], sizes)
            part_of = number + np.repeat(begin[active] - inside, sizes)
            nodes = self.starts[part_of]
            nodes[node_ends[:-1][inside]] = entry[active][inside]
            seed_at = np.repeat(seeds[active] + np.uint64((sample + 1) * int(M1) % (1 << 64)), sizes) + number.astype(np.uint64) * M2
            edges, counts = lat.walk(nodes, mix(seed_at))
            edge_ends = np.concatenate([[0], np.cumsum(counts)])[node_ends]
            parts, logs = np.repeat(part_of.astype(np.int32), counts), lat.log_p[edges]
            for place, d in enumerate(active.tolist()):
                lo, hi = edge_ends[place], edge_ends[place + 1]
                path, path_parts, log_p = edges[lo:hi], parts[lo:hi], logs[lo:hi]
                kept = 0
                if d in prefix:
                    before, before_parts = prefix[d]
                    kept = len(before)
                    path, path_parts, log_p = np.concatenate([before, path]), np.concatenate([before_parts, path_parts]), np.concatenate([lat.log_p[before], log_p])
                peak = float(peaks[d])
                paths[d].append((path, path_parts, float(log_p.sum()), peak))
                self.push(queues[d], path, log_p, kept, peak, sample, int(seeds[d]))
            if sample + 1 == self.k:
                break
            active = np.array([d for d in active.tolist() if queues[d]], np.int64)
            for d in active.tolist():
                value, source, step, used = heapq.heappop(queues[d])
                seed = int(seeds[d])
                peaks[d] = -value
                path, path_parts, _, _ = paths[d][source]
                node = lat.src[path[step]]
                others = [e for e in range(lat.edge[node], lat.edge[node + 1]) if e not in used]
                shares = lat.p[others].astype(np.float64)
                u = one_uniform(seed ^ (sample * 7919 + step) * int(M3) % (1 << 64))
                chosen = others[min(int(np.searchsorted(np.cumsum(shares) / shares.sum(), u, side="right")), len(others) - 1)]
                excluded = (*used, chosen)
                left = float(1.0 - np.exp(lat.log_p[list(excluded)]).sum())
                if len(others) > 1 and left > 0:
                    loc = float(lat.log_p[path[:step]].sum()) + math.log(left)
                    g = -math.log(-math.log(one_uniform(seed ^ (sample * 104729 + step + 1) * int(M2) % (1 << 64)))) + loc
                    heapq.heappush(queues[d], (float(np.logaddexp(value, -g)), source, step, excluded))
                prefix[d] = (np.append(path[:step], np.int32(chosen)), path_parts[: step + 1])
                entry[d] = lat.dst[chosen]
                begin[d] = path_parts[step] + 1
        for d in range(n):
            kappa = -queues[d][0][0] if queues[d] else -np.inf
            yield int(self.full[d]), [(path, log_prob, peak) for path, _, log_prob, peak in paths[d]], kappa

    def push(self, queue: list[tuple[float, int, int, tuple[int, ...]]], path: np.ndarray, log_p: np.ndarray, kept: int, peak: float, sample: int, seed: int) -> None:
        """Queue the groups beside a path's steps from ``kept`` on; only those that can be among the next k."""
        lat = self.lattices
        for size in (kept + HEAD, len(path)):
            head = log_p[:size]
            before = np.cumsum(head) - head
            loc = before[kept:] + lat.log_rest[path[kept:size]]
            some = loc if len(loc) <= self.k + 1 else np.partition(loc, len(loc) - self.k - 1)[len(loc) - self.k - 1 :]
            least = some.min(initial=np.inf) if len(some) > self.k else -np.inf
            at = np.flatnonzero(loc > least - SPREAD) if least > -np.inf else np.flatnonzero(loc > -np.inf)
            # Probabilities only fall along a path: what follows the head can't come near these any more.
            if size >= len(path) or (least > -np.inf and before[-1] < least - SPREAD):
                break
        if not len(at):
            return
        own = np.uint64(mix(np.array([seed + (sample + 31) * int(M1) & (1 << 64) - 1], np.uint64))[0])
        g = gumbel((at + kept).astype(np.uint64) * M3 + own) + loc[at]
        value = np.logaddexp(-peak, -g)
        if len(at) > self.k:
            top = np.argpartition(value, self.k)[: self.k + 1]
            at, value = at[top], value[top]
        for v, step in zip(value.tolist(), (at + kept).tolist(), strict=True):
            heapq.heappush(queue, (v, sample, step, (int(path[step]),)))


_pieces: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    if path not in _pieces:  # a worker keeps it over its tasks
        _pieces[path] = Pieces(path)
    return _pieces[path]


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """doc_id, sample, pieces, n_pieces, log_prob, perturbed, inclusion, round_trip: up to k rows per row, the best first."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.xxhash64(docs[id_col].cast("string"), F.lit(seed))
    narrow = docs.select(docs[id_col].alias("doc_id"), key.alias("key"), docs[text_col].alias("text"))
    schema = f"doc_id {kind}, sample int, pieces array<int>, n_pieces int, log_prob double, perturbed double, inclusion double, round_trip boolean"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sample_batches(vocabulary(model), batches, k)

    return narrow.mapInArrow(run, schema)


def sample_batches(pieces: Pieces, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The samples of batches (id, key, text)."""
    names = ["doc_id", "sample", "pieces", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip"]
    for batch in batches:
        for part, data, offsets in slices(batch, "text", LATTICE_BYTES):
            seeds = mix(part.column(1).to_numpy().view(np.uint64))
            rows, number, lists, scores, peaks, inclusions, trips = [], [], [], [], [], [], []
            for row in np.flatnonzero(np.diff(offsets) == 0):
                rows.append(int(row)), number.append(0), lists.append(np.zeros(0, np.int32)), scores.append(0.0)
                peaks.append(float(gumbel(seeds[row : row + 1])[0])), inclusions.append(1.0), trips.append(True)
            if offsets[-1]:
                sampler = Sampler(pieces, data, offsets, seeds, k)
                for row, samples, kappa in sampler.draw():
                    raw = data[offsets[row] : offsets[row + 1]].tobytes()
                    for i, (edges, log_prob, peak) in enumerate(samples):
                        ids = sampler.lattices.piece_ids(edges)
                        rows.append(row), number.append(i), lists.append(ids), scores.append(log_prob), peaks.append(peak)
                        inclusions.append(-math.expm1(-math.exp(min(log_prob - kappa, 700.0))) if kappa > -np.inf else 1.0)
                        trips.append(pieces.spelled(ids)[1:] == raw)
            sizes = np.array([len(x) for x in lists], np.int64)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), column, pa.array(sizes, pa.int32()), pa.array(scores, pa.float64()), pa.array(peaks, pa.float64()), pa.array(inclusions, pa.float64()), pa.array(trips, pa.bool_())],
                names,
            )
            # Freed before the next slice is built, not when it replaces this one.
            sampler = samples = edges = ids = lists = flat = column = None


def decode(samples: DataFrame, model: str, pieces_col: str = "pieces") -> DataFrame:
    """``samples`` with the column ``text`` decoded from the pieces."""
    ship(samples.sparkSession)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = vocabulary(model)
        for ids in batches:
            yield pa.array([None if x is None else own.decode(x) for x in ids.to_pylist()], pa.string())

    return samples.withColumn("text", text(F.col(pieces_col)))
