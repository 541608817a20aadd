r"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

A document is contaminated by an item if one of its windows of the item's length
(in words) has a weighted shingle similarity, sum of the lesser over sum of the
greater multiplicities, of at least the threshold. Words are ``[\p{L}\p{N}]+`` in
lower case, a shingle is five of them; an item with fewer words is one shingle.

1. Every text is cut into shingles and every distinct text that shares one with the
   benchmark has its item-sized windows hashed: for each length that items have,
   the windows that hold as many shingles of items of that length as the threshold
   needs at least. Fewer can't reach it, and a window that doesn't begin with such a
   shingle loses nothing by moving on to the next one, so windows begin at those or
   end with the text; nothing is lost. Which item it may be isn't known here.
2. A window's SimHash is held against the index of the items' fingerprints. The 64
   bits are cut into BLOCKS blocks. If two fingerprints differ in at most RADIUS
   bits, they differ in at most TOLERANCE bits in one of the blocks, as BLOCKS *
   (TOLERANCE + 1) > RADIUS. The index holds each item's block values with all their
   neighbours of up to TOLERANCE bits, so an equi-join on (length, block, value)
   finds every pair within the radius; a random pair meets it with a probability
   of about a quarter.
3. What is within the radius is verified by the exact similarity, from counts of
   shingles, in time linear in the window.

At a similarity of 0.8 fingerprints differ in 9.7 bits on average with a standard
deviation of 2.9, so the radius of 19 lies 3.4 deviations above: what SimHash
loses stands in the README, measured against brute force.

Documents are keyed by the SHA-256 of the text, so copies are settled once and rows
without an id count as well. The index of items is broadcast up to a checked
number of shingles and shuffled beyond it.

Defined results: null texts and items and texts without words match nothing;
repeated rows give the same (doc_id, item_id) once; items with equal texts are
each reported; a row with a null id is reported with a null id; empty tables
give an empty result; further columns play no part.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewood.functions.scalars import let
from clausewood.llm.common import fresh, materialize

#: Rows of 16 bytes or a little more up to which a side is broadcast.
BROADCAST_ROWS = 1_000_000
BITS = 64
BLOCKS, TOLERANCE = 5, 3
RADIUS = BLOCKS * (TOLERANCE + 1) - 1


def word_codes(text: Column) -> Column:
    """A hash of each word."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(codes: Column, width: int) -> Column:
    """A hash of each run of ``width`` words; null if there are fewer."""

    def of(held: Column) -> Column:
        last = F.size(held) - F.lit(width - 1)
        run = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(*[F.get(held, i + F.lit(j)) for j in range(width)]))
        return F.when(last >= 1, run)

    return let(codes, of)


def least_shared(m: Column, k: Column, threshold: float) -> Column:
    """Shared shingles that windows of k shingles need with items of m: s / (m + k - s) >= threshold."""
    return F.greatest(F.lit(1), F.ceil(threshold / (1 + threshold) * (m + k) - 1e-9)).cast("int")


def bit(number: int) -> Column:
    """A long with one bit set."""
    return F.lit(1 << number if number < 63 else -(1 << 63)).cast("long")


def fingerprint(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp): the SimHash of each key's rows (h, c), weighted by the counts."""
    # Bits are taken from a second hash, since equal words share parts of none but the first.
    each = counts.withColumn("bits", F.xxhash64("h", F.lit(7)))
    votes = [F.sum(F.when(F.col("bits").bitwiseAND(bit(b)) != 0, F.col("c")).otherwise(-F.col("c"))).alias(f"v{b}") for b in range(BITS)]
    counted = each.groupBy(*keys).agg(*votes)
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        fp = fp.bitwiseOR(F.when(F.col(f"v{b}") > 0, bit(b)).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, fp.alias("fp"))


def block_bounds() -> list[tuple[int, int]]:
    cuts = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return list(itertools.pairwise(cuts))


def block_values(fp: str) -> Column:
    """(block, value) of the cuts of the 64 bits."""
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).alias("value")) for i, (lo, hi) in enumerate(block_bounds())]
    return F.explode(F.array(*parts))


def neighbours(spark) -> DataFrame:
    """(block, mask): every set of up to TOLERANCE bits of each block; fixed, under 2,000 rows."""
    rows = [(i, sum(1 << b for b in bits)) for i, (lo, hi) in enumerate(block_bounds()) for n in range(TOLERANCE + 1) for bits in itertools.combinations(range(hi - lo), n)]
    return spark.createDataFrame(rows, "block int, mask long")


def near_items(prints: DataFrame, item_prints: DataFrame) -> DataFrame:
    """(key, words, start, item) of the pairs of one length whose fingerprints differ in RADIUS bits or fewer, by the blocks' index."""
    masks = F.broadcast(neighbours(prints.sparkSession))
    index = item_prints.select("item", "words", F.col("fp").alias("item_fp"), block_values("fp").alias("b")).join(masks, F.col("b.block") == masks["block"])
    index = materialize(index.select("item", "words", "item_fp", "b.block", F.col("b.value").bitwiseXOR(F.col("mask")).alias("value")))
    hint = F.broadcast if index.count() <= BROADCAST_ROWS else (lambda df: df)
    probes = prints.select("key", "words", "start", "fp", block_values("fp").alias("b")).select("key", "words", "start", "fp", "b.block", "b.value")
    met = probes.join(hint(index), ["words", "block", "value"])
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("key", "words", "start", "item").distinct()


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def find(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, similarity, start_word): the best window of each contaminated text, keyed by the SHA-256 of the text."""
    coded = materialize(items.select(items[item_id].alias("item_id"), word_codes(items[item_text]).alias("codes")).where(F.size("codes") > 0).withColumn("item", F.monotonically_increasing_id()))
    widths = [r[0] for r in coded.select(F.least(F.size("codes"), F.lit(width)).alias("w")).distinct().orderBy("w").collect()]  # at most ``width`` values
    keyed = docs.select(text_key(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    found = None
    for w in widths:
        own = coded.where(F.least(F.size("codes"), F.lit(width)) == w).select("item_id", "item", F.size("codes").alias("words"), F.explode(shingles(F.col("codes"), w)).alias("h"))
        part = find_width(keyed, materialize(own.groupBy("item_id", "item", "words", "h").agg(F.count(F.lit(1)).alias("c"))), w, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = items.schema[item_id].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"key string, item_id {kind}, similarity double, start_word long")
    return found


def find_width(keyed: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """Hits of the items (item_id, item, words, h, c) whose shingles have ``width`` words."""
    marks = materialize(items.select("words", "h").distinct())
    hint = F.broadcast if marks.count() <= BROADCAST_ROWS else (lambda df: df)
    known = marks.select("h").distinct()

    # Texts that share a shingle with the benchmark, each once.
    texts = keyed.select("key", F.explode(shingles(word_codes(F.col("text")), width)).alias("h"))
    keys = materialize(texts.join(hint(known), "h", "left_semi").select("key").distinct())
    few = keys.count() <= BROADCAST_ROWS // 4
    chosen = keyed.join(F.broadcast(keys) if few else keys, "key", "left_semi").dropDuplicates(["key"])
    chosen = materialize(chosen.select("key", shingles(word_codes(F.col("text")), width).alias("shingles")).withColumn("n", F.size("shingles")))

    # Their windows, for each length of items.
    places = chosen.select("key", "n", F.posexplode("shingles").alias("at", "h")).join(hint(marks), "h")
    by_length = places.groupBy("key", "n", "words").agg(F.sort_array(F.collect_list("at")).alias("at")).withColumn("m", F.col("words") - F.lit(width - 1))
    need, last = least_shared(F.col("m"), F.least("m", "n"), threshold), F.greatest(F.col("n") - F.col("m"), F.lit(0))
    inside = F.filter(F.transform("at", lambda p, i: F.struct(p.alias("start"), F.get("at", i + F.col("need") - 1).alias("reach"))), lambda x: (x["start"] < F.col("last")) & (x["reach"] < x["start"] + F.col("m")))
    final = F.when(F.size(F.filter("at", lambda p: p >= F.col("last"))) >= F.col("need"), F.array("last")).otherwise(F.array().cast("array<int>"))
    starts = by_length.withColumns({"need": need, "last": last}).select("key", "words", "m", "n", F.explode(F.array_distinct(F.concat(F.transform(inside, lambda x: x["start"]), final))).alias("start"))
    # A window's shingles come by their places, not as a slice of the text's: a long text isn't copied for each window.
    reach = starts.select("key", "words", "start", F.explode(F.sequence("start", F.least(F.col("start") + F.col("m"), "n") - 1)).alias("at"))
    spots = chosen.select("key", F.posexplode("shingles").alias("at", "h"))
    bags = materialize(reach.join(spots, ["key", "at"]).groupBy("key", "words", "start", "h").agg(F.count(F.lit(1)).alias("c")))

    own = ["key", "words", "start"]
    near = near_items(fingerprint(bags, own), fingerprint(items, ["item", "words"]))
    hint = F.broadcast if items.count() <= BROADCAST_ROWS else (lambda df: df)
    shared = near.join(bags, own).join(hint(items.select("item", "h", F.col("c").alias("item_c"))), ["item", "h"])
    shared = shared.groupBy(*own, "item").agg(F.sum(F.least("c", "item_c")).alias("shared"))
    sizes = bags.groupBy(*own).agg(F.sum("c").alias("k"))
    item_sizes = items.groupBy("item", "item_id").agg(F.sum("c").alias("m"))
    scored = shared.join(sizes, own).join(hint(item_sizes), "item").withColumn("similarity", F.col("shared") / (F.col("m") + F.col("k") - F.col("shared")))
    best = scored.where(F.col("similarity") >= threshold - 1e-12).groupBy("key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start").cast("long")).alias("back"))).alias("best"))
    return best.select("key", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start_word"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """doc_id, item_id, similarity, start_word of every (document, item) pair over the threshold."""
    hits = materialize(find(docs, items, text_col=text_col, **options))
    narrow = docs.select(docs[id_col].alias("doc_id"), text_key(docs[text_col]).alias("key"))
    few = hits.count() <= BROADCAST_ROWS // 4
    return narrow.join(F.broadcast(hits) if few else hits, "key").select("doc_id", "item_id", "similarity", "start_word").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options: float) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, all columns as they were, whatever their names."""
    key = fresh("hit_key", docs)
    hits = materialize(find(docs, items, text_col=text_col, **options).select(F.col("key").alias(key)).distinct())
    few = hits.count() <= BROADCAST_ROWS // 4
    return docs.join(F.broadcast(hits) if few else hits, text_key(docs[text_col]) == hits[key], "left_anti")
