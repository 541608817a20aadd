"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in the order of (id, checksum, size), so the numbering
doesn't depend on how the table is cut into files. A keyed Feistel network over
the smallest even-bit domain that holds n permutes the numbers; values of n or
more walk on until they fall below n, at most four steps on average. A permuted
number p has shard p mod k and slot p div k: shard sizes differ by one at most
(the law ``rows``), slots are gapless, and both can be computed from the row
number alone.

Only (id, size, checksum) is shuffled, never text. Ids are dealt by range, so
a hot source spreads; what the driver gets is one count per partition.

Defined results: null text has size 1 and checksum 0; null ids come first;
repeated rows get places of their own; an empty table gives an empty result;
further columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewood.llm.common import materialize
from clausewood.runtime import ship

ROUNDS = 4
#: Multipliers of the round function, one per round; below 2**31 so that a product with a half word fits in 63 bits.
ROUND_KEYS = (1640531527, 2027808486, 1403630843, 1116352408)


def half_bits(n: int) -> int:
    """Bits of one half: 2 ** (2 * bits) is the smallest such domain that holds n numbers."""
    bits = 1
    while 1 << (2 * bits) < n:
        bits += 1
    return bits


def feistel(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """One pass of the network over numbers of 2 * bits bits."""
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in ROUND_KEYS:
        f = ((right + seed) % 2147483648 * key) >> 13
        left, right = right, left ^ (f & mask)
    return (left << bits) | right


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permutation of 0..n-1: the network again and again until the value is below n."""
    bits = half_bits(n)
    out = feistel(np.asarray(x, dtype=np.int64), bits, seed)
    walk = out >= n
    while walk.any():
        out[walk] = feistel(out[walk], bits, seed)
        walk = out >= n
    return out


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Add ``row_number`` (0..n-1 in the given order) by a range shuffle; also gives n."""
    dealt = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    dealt = dealt.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    marked = materialize_numbered(dealt)
    counts = sorted((r["part"], r["count"]) for r in marked.groupBy("part").count().collect())  # a row for each partition
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    offsets = rows.sparkSession.createDataFrame(starts, "part long, start long")
    numbered = marked.join(F.broadcast(offsets), "part").withColumn("row_number", F.col("start") + F.col("at"))
    return numbered.drop("part", "at", "start"), total


def materialize_numbered(dealt: DataFrame) -> DataFrame:
    """Cut lineage so that partitions can't change between the count and the numbering."""
    mark = F.monotonically_increasing_id()
    return materialize(dealt.withColumn("part", F.shiftright(mark, 33)).withColumn("at", mark.bitwiseAND((1 << 33) - 1)))


def shard(docs: DataFrame, shards: int = 16, seed: int = 20260101, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number of every row."""
    ship(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    narrow = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(narrow, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permute(numbers.to_numpy(), n, seed))

    p: Column = F.col("place")
    return numbered.withColumn("place", place("row_number")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (p % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def oracle(shards: int = 16, seed: int = 20260101) -> str:
    """DuckDB SQL of the query on documents: the same network by arithmetic, the walk by recursion, CRC-32 by its table."""
    rounds = ""
    for i, key in enumerate(ROUND_KEYS):
        rounds += f"""
  r{i + 1} AS MATERIALIZED (SELECT i, n, bits, r AS l, xor(l, (((r + {seed}) % 2147483648 * {key}) >> 13) & ((1::BIGINT << bits) - 1)) AS r FROM r{i}),"""
    return f"""
WITH RECURSIVE bit(b, v, k) AS (
  SELECT b, b::BIGINT, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bit WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS tab FROM bit WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT doc_id, text, hex(encode(text)) AS x FROM d),
c AS (SELECT doc_id, strlen(text) + 1 AS size,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2), lambda j: ('0x' || x[2 * j + 1 : 2 * j + 2])::BIGINT)),
    lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)]))) AS text_crc32 FROM h, crc),
num AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS i, count(*) OVER () AS n FROM c),
dom AS (SELECT max(n) AS n, (SELECT min(b) FROM range(1, 31) t(b) WHERE (1::BIGINT << (2 * b)) >= (SELECT max(n) FROM num)) AS bits FROM num),
all_i AS (SELECT t.i::BIGINT AS i, n, bits FROM dom, range((SELECT 1::BIGINT << (2 * bits) FROM dom)) t(i)),
  r0 AS (SELECT i, n, bits, i >> bits AS l, i & ((1::BIGINT << bits) - 1) AS r FROM all_i),{rounds}
net AS MATERIALIZED (SELECT i, n, (l << bits) | r AS p FROM r{len(ROUND_KEYS)}),
walk(i, p, n) AS (SELECT i, p, n FROM net WHERE i < n UNION ALL SELECT walk.i, net.p, walk.n FROM walk JOIN net ON net.i = walk.p WHERE walk.p >= walk.n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INT AS shard, p // {shards} AS slot, NULL::INT AS grown_shard, num.i AS row_number
FROM num JOIN walk ON walk.i = num.i AND walk.p < walk.n
"""
