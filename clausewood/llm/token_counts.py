"""Token counts by byte-pair merging with a heap and a linked list.

The library's byte-level tokenizer parts a text into pieces by a fixed pattern
and merges each piece on its own. Here the symbols of a piece form a linked list
and the ranks of its adjacent pairs a heap; the lowest rank, leftmost first, is
popped and merged until no pair has a rank. The count of a piece is its first
symbols less its merges; no identifiers are made. The cost of one piece is
n log n, so a piece of a million characters ends too.

Counts are kept per blank-delimited chunk in a cache of bounded size, since the
pattern can't join what lies on the two sides of a single blank between two
non-blank characters.

Defined results: null counts as empty (0 tokens); strings of special tokens
inside a text count as one token each, the library's default; an empty table
gives an empty result; each repeated row is counted; further columns play no part.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewood.llm.common import tidy
from clausewood.runtime import ship

#: Entries after which a cache of counts is emptied.
CACHE_LIMIT = 400_000
#: A chunk or piece longer than this is counted, not kept.
CACHE_LENGTH = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary, by its public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class PairCounter:
    """Counts the tokens of texts as the byte-level BPE file at ``path`` gives them."""

    def __init__(self, path: str) -> None:
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks: dict[tuple[str, str], int] = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.alphabet = byte_alphabet()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = [t["content"] for t in spec["added_tokens"] if t["content"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.unsafe = regex.compile(r"\s\s|\A\s|\s\Z")
        self.parts = regex.compile(r"(?<=\S) (?=\S)")
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merge_count(self, symbols: list[str]) -> int:
        """Symbols less merges of one piece."""
        n = len(symbols)
        ranks = self.ranks
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # An entry is stale if a symbol of its pair has been merged away or has grown since.
            if j >= n or symbols[i] == "" or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def piece(self, piece: str) -> int:
        found = self.pieces.get(piece)
        if found is None:
            a = self.alphabet
            found = self.merge_count([a[b] for b in piece.encode("utf-8", "surrogatepass")])
            if len(piece) <= CACHE_LENGTH:
                if len(self.pieces) >= CACHE_LIMIT:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def chunk(self, chunk: str) -> int:
        """Tokens of a stretch of text by the pattern."""
        found = self.chunks.get(chunk)
        if found is None:
            found = sum(map(self.piece, self.pattern.findall(chunk)))
            if len(chunk) <= CACHE_LENGTH:
                if len(self.chunks) >= CACHE_LIMIT:
                    self.chunks.clear()
                self.chunks[chunk] = found
        return found

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        parts = self.parts.split(text) if self.unsafe.search(text) else text.split(" ")
        total = self.chunk(parts[0])
        get, chunk = self.chunks.get, self.chunk
        for p in parts[1:]:
            p = " " + p
            n = get(p)
            total += chunk(p) if n is None else n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not (found := self.special.findall(text)):
            return self.plain(text)
        return len(found) + sum(map(self.plain, self.special.split(text)))


_counters: dict[str, PairCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``vocabulary`` is a path that every executor can open."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:  # a worker keeps it over its tasks
            _counters[vocabulary] = PairCounter(vocabulary)
        count = _counters[vocabulary].count
        for batch in batches:
            n = pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select(docs[id_col].alias("doc_id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
