"""Shared pieces of the training-data operators: lineage cuts and byte-level text hashing.

Text is handled as the UTF-8 bytes of Arrow buffers. One call handles a slice of
rows of bounded size, so memory follows the slice (or one very long text), not
the batch that Spark hands over.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


# ---------------------------------------------------------------- lineage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, or one on the default file system.

    A cluster whose default file system is each machine's own disk must set ``spark.checkpoint.dir``.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        home = context._jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration()).getUri().toString()
        if home.startswith("file:") and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{home.rstrip('/')}/tmp/clausewood-{context.applicationId}"
        context.setCheckpointDir(found)
    return found


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores behind it until no column of the frames is called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/clausewood-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- bytes and hashes

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Base of the word hash (odd, so it has an inverse modulo 2**64) and that inverse.
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 18
#: Bytes of text after which a worker gives freed memory back.
TRIM_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finishing steps."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M2
    x ^= x >> np.uint64(27)
    x *= M3
    x ^= x >> np.uint64(31)
    return x


BYTE_HASH = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * M1)
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
#: The white space that parts words: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n; the slice size is kept, larger ones are made anew."""
    kept = max(n, SLICE_BYTES)
    found = _powers.get(0)
    if found is None or len(found[0]) <= kept:
        made = []
        for base in (BASE, BASE_INVERSE):
            x = np.full(kept + 1, base, dtype=np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        found = (made[0], made[1])
        if kept == SLICE_BYTES:
            _powers[0] = found
    return found


def salt(n: int) -> np.uint64:
    """A constant that tells kinds of hashes apart."""
    return np.uint64(n * int(M1) % (1 << 64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return memory that freed arrays have left in this worker to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function over batches; at a task's end its worker gives freed memory back, as it may stay idle for long."""

    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about ``limit`` bytes of text (one row at least), with their bytes and offsets."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    row = done = 0
    while row < batch.num_rows:
        if offsets[row] - done >= TRIM_BYTES:
            done = offsets[row]
            give_back()
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes with ``member``; no run crosses rows."""
    n = len(member)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = member[1:]
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, whatever its place."""
    return hashes_between(*hash_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def hash_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and inverse powers, from which ``hashes_between`` takes the hash of any span."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_HASH[data] * up[: len(data)], out=total[1:])
    return total, down


def hashes_between(total: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * M1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    starts, ends, rows = runs(~SPACE[data], offsets)
    return span_hashes(LOWER_BYTES[data], starts, ends), rows


def shingle_sets(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and the n_rows+1 offsets of the rows.

    A row with fewer words than ``width`` has its whole sequence as one shingle; a
    row without words has none.
    """
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    keys = mix(np.arange(1, width + 1, dtype=np.uint64) * M3) | np.uint64(1)
    full = len(words) - width + 1
    if full > 0:
        whole = rows[:full] == rows[width - 1 :]
        at = np.flatnonzero(whole)
        h = np.zeros(len(at), np.uint64)
        for j in range(width):
            h += words[at + j] * keys[j]
        h, owner = mix(h + salt(width)), rows[at]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = count[short] > j
            extra[has] += words[first[short[has]] + j] * keys[j]
        extra = mix(extra + count[short].astype(np.uint64) * M1)
        h, owner = np.concatenate([h, extra]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_rows))])
