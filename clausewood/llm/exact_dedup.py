"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Rows shrink to (id, digest) before anything moves. A Misra-Gries summary of
1/support counters (``freqItems``) names every digest that can hold more than
``support`` of all rows. Exact counts of those few candidates give the verified
winners, at most 1/support rows, which are broadcast: rows of a frequent digest
are settled where they are read. All other digests are grouped by an ordinary
shuffle, in which no group can hold more than ``support`` of the rows.

Defined results: a null text counts as empty; of equal texts the row with the
largest id stays (a null id is smaller than any other); of rows repeated with the
same id and text exactly one stays; an empty table gives an empty result;
further columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewood.llm.common import fresh, lower_ascii, materialize

#: Dropped rows up to which their (id, digest) pairs are broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 300_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row): the SHA-256 of each text after lower-casing A-Z, and a number that tells repeated rows apart."""
    text = lower_ascii(F.coalesce(docs[text_col], F.lit("")))
    return docs.select(docs[id_col].alias("doc_id"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("row"))


def winners(rows: DataFrame, support: float) -> DataFrame:
    """(digest, best, group_size) of the digests with over ``support`` of all rows, counted exactly; at most 1/support rows."""
    candidates = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    counted = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return counted.join(F.broadcast(total), F.col("group_size") > F.col("total") * support).drop("total")


def least_support(rows: DataFrame) -> float:
    """The support at which the rows of a digest that isn't taken out are a tenth of a shuffle partition's share, within bounds."""
    return min(0.001, max(1e-5, 0.1 / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(digests(docs, id_col, text_col))
    heavy = materialize(winners(rows, support or least_support(rows)))
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    frequent = marked.where(F.col("group_size").isNotNull())
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    settled = rest.join(groups, "digest", "left")
    own = F.struct("doc_id", "row")
    best = F.coalesce(F.col("best"), own)
    return frequent.unionByName(settled).select(
        "doc_id",
        best["doc_id"].alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (best["row"] == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were, whatever their names."""
    own_id, own_digest = fresh("lost_id", docs), fresh("lost_digest", docs)
    decided = materialize(exact_dedup(docs, id_col, text_col, support))
    named = lambda kept: decided.where(kept).select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_digest))
    lost, best = named("NOT kept"), named("kept")
    repeated = materialize(best.join(lost, [own_id, own_digest], "left_semi").unionByName(lost.where(F.col(own_id).isNull()).join(best.where(F.col(own_id).isNull()), own_digest, "left_semi").distinct()))
    lost = materialize(lost.distinct())
    few = lost.count() <= BROADCAST_ROWS
    digest = F.sha2(lower_ascii(F.coalesce(docs[text_col], F.lit(""))), 256)

    def same(other: DataFrame) -> Column:
        return docs[id_col].eqNullSafe(other[own_id]) & (digest == other[own_digest])

    out = docs.join(F.broadcast(lost) if few else lost, same(lost), "left_anti")
    if not repeated.isEmpty():
        # Rows repeated with the same id and text went with their keeper; one of each comes back.
        again = docs.join(repeated, same(repeated), "left_semi")
        mark = fresh("digest", docs)
        out = out.unionByName(again.withColumn(mark, F.sha2(lower_ascii(F.coalesce(again[text_col], F.lit(""))), 256)).dropDuplicates([id_col, mark]).drop(mark))
    return out


#: DuckDB SQL of the query on documents. Ties of repeated rows don't occur in the given tables.
ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
