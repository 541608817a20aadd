"""Exact dedup, the n-gram join and components against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from clausewood.llm import exact_dedup, ngram_join
from clausewood.llm.components import components

SCHEMA = "doc_id long, text string, lang string, digest string, row long, id string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 1, "x", 2) for i, t in rows], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


ROWS = [(1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 100_000), (8, "X" * 100_000), (9, "one"), (9, "one"), (None, "solo"), (None, "a b")]


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_exact_dedup(spark, support):
    got = exact_dedup.exact_dedup(frame(spark, ROWS), support=support).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(hashlib.sha256(lower(t).encode()).hexdigest(), []).append(i)
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (max(known) if known else None)
    for digest, ids in groups.items():
        assert sum(r.kept for r in got if r.text_sha256 == digest) == 1, ids


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


def test_exact_dedup_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(600)]
    heavy = exact_dedup.winners(exact_dedup.digests(frame(spark, rows)), 0.1).collect()
    assert [r.group_size for r in heavy] == [200]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows), support=0.1).collect()}
    assert got[0].keep_id == 597 and got[0].group_size == 200
    assert sum(r.kept for r in got.values()) == len({t for _, t in rows})


def test_drop_copies(spark):
    docs = frame(spark, ROWS)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id if r.doc_id is not None else -1), (r.text or "")[:5]) for r in kept.collect())
    assert got == [(-1, "solo"), (2, "a B"), (3, "É"), (4, "é"), (6, ""), (8, "XXXXX"), (9, "one")]


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        sets[i] = set() if not w else {tuple(w)} if len(w) < width else {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n):
    """Chains of near copies, exact copies, shared passages, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.45 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind < 0.7:
            texts.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))))
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 50)])
def test_join_against_brute_force(spark, seed, width, percent):
    rows = corpus(seed, 150) + [(1000, None), (1001, ""), (1002, "\t \n"), (1003, "Lone"), (1004, "lone"), (1005, "a  b"), (1006, "A\tB"), (1007, "long " * 30_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(frame(spark, rows), width, percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_join_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (2, "a b c d e f")]
    got = sorted(map(str, (tuple(r) for r in ngram_join.join_components(frame(spark, rows), 4, 85).collect())))
    assert got == sorted(map(str, [(5, 3, 2), (5, 3, 2), (None, 3, 2), (None, 3, None), (2, 3, 2)]))
    assert ngram_join.join_components(frame(spark, [])).collect() == []


def test_keep_one(spark):
    rows = [*corpus(4, 60), (None, "n o p q r s"), (901, None)]
    docs = frame(spark, rows)
    kept = ngram_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    truth = brute_components([r for r in rows if r[0] is not None], 5, 80)
    want = {i for i, (_, root) in truth.items() if root == i}
    assert {r.doc_id for r in kept.collect()} == want | {None}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 400: 400, 500: 400}


def test_frequent_items_keep_every_frequent_one():
    rng = np.random.default_rng(0)
    stream = np.concatenate([rng.integers(0, 10_000, 20_000), np.repeat(np.arange(20_000, 20_005), 2_000)]).astype(np.uint64)
    rng.shuffle(stream)
    summary = ngram_join.FrequentItems(64)
    for part in np.array_split(stream, 50):
        summary.add(part)
    assert len(summary.items) <= 64 and set(range(20_000, 20_005)) <= set(summary.items.tolist())


def test_frequent_items_of_a_large_task_are_kept():
    """Tens of thousands of shingles that some documents share don't push each other out, so such columns come last."""
    summary = ngram_join.FrequentItems()
    for _ in range(4):
        summary.add(np.arange(60_000, dtype=np.uint64))
    assert len(summary.items) == 60_000 and (summary.counts == 4).all()


def test_every_link_is_found_and_counted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 8)
    base = [f"b{i}" for i in range(80)]
    near = [(2000 + i, " ".join([*base[:i], f"z{i}", *base[i + 1 :]])) for i in range(0, 80, 4)]
    rows = [*corpus(6, 100), *near, (3000, near[3][1]), (3001, None)]
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 4 else {tuple(w[j : j + 4]) for j in range(len(w) - 3)}
    pairs = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    least = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    want = {(a, b): n for (a, b), n in pairs.items() if least[a] == a and least[b] == b and sets[a] != sets[b]}
    assert {(r.a, r.b): r.overlap for r in ngram_join.links(frame(spark, rows), 4, 85).collect()} == want
    truth = brute_components(rows, 4, 85)
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.join_links(frame(spark, rows), 4, 85).collect()}
    assert got == {i: (truth[i][0], sum(i in p for p in pairs), truth[i][1]) for i in sets}
    assert got[2000][1] >= 19


@pytest.mark.parametrize("pairs", [1 << 16, 3])
def test_a_group_gives_a_row_per_member_and_cell_not_per_link(spark, monkeypatch, pairs):
    monkeypatch.setattr(ngram_join, "ROW_BLOCKS", 2)
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    common = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*common, f"end{i}"])) for i in range(40)] + [(100 + i, f"only text {i} of its own kind") for i in range(5)]
    _, classes, shared = ngram_join.prepared(frame(spark, rows), 4, 85, "doc_id", "text")
    candidates = ngram_join.candidates(shared, 85)
    assert candidates.count() == 40 * 39 // 2
    close = ngram_join.close_pairs(candidates, classes, 85).collect()
    assert sum(len(r.others) for r in close if r.kind == 1) == 40 * 39 // 2
    assert len([r for r in close if r.kind == 1]) <= 2 * 40 and len([r for r in close if r.kind == 0]) <= 4 * 40
    found = ngram_join.counted(frame(spark, rows), candidates, classes, 4, 85, "doc_id", "text").collect()
    assert len(found) <= 4 * 40 and sum(r.near for r in found) == 40 * 39
    got = {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.join_links(frame(spark, rows), 4, 85).collect()}
    assert got == {i: (39, 0) if i < 40 else (0, i) for i, _ in rows}


def test_columns_meet_without_a_join_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 16)
    common = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*common, f"end{i}", *["x"] * (i % 7)])) for i in range(60)]
    _, _, shared = ngram_join.prepared(frame(spark, rows), 4, 85, "doc_id", "text")
    met = ngram_join.gathered(shared, 85)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "id1" not in plan and "MapInArrow" in plan
    found = met.collect()
    assert {(r.a, b) for r in found for b in r.others} == {(r.a, r.b) for r in ngram_join.candidates(shared, 85).collect()}
    assert len({b for r in found for b in [r.a, *r.others]}) == 60 and len(found) <= 60 * spark.sparkContext.defaultParallelism * 4


@pytest.mark.parametrize("size", [1, 5, 1 << 17])
def test_groups_are_whole_whatever_the_batches(monkeypatch, size):
    monkeypatch.setattr(ngram_join, "GATHERED", size)
    keys = np.repeat(np.arange(20), np.arange(20) % 6)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 3]), pa.array(np.arange(len(keys))[i : i + 3])], ["key", "x"]) for i in range(0, len(keys), 3)]
    parts = list(ngram_join.whole_groups(iter(batches)))
    assert np.concatenate([p[1] for p in parts]).tolist() == list(range(len(keys)))
    assert sum(len(np.unique(p[0])) for p in parts) == len(np.unique(keys))


def test_a_row_block_names_its_rows_once_however_many_tasks(spark, monkeypatch):
    """Rows for the cells follow members and cells, not members and tasks."""
    group, blocks = 80, 2
    monkeypatch.setattr(ngram_join, "GATHERED", 64)
    monkeypatch.setattr(ngram_join, "ROW_BLOCKS", blocks)
    before = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = spark.createDataFrame([(i, list(range(i + 1, group))) for i in range(group)] * 2, "a long, others array<long>")
        found = ngram_join.in_row_blocks(pairs, blocks).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(r.kind == 0 for r in found) <= 2 * blocks * group
    told = [(r.cell, r.a, b) for r in found if r.kind == 1 for b in r.others]
    assert len({(a, b) for _, a, b in told}) == len(told) == group * (group - 1) // 2
    named = {(r.cell, r.a) for r in found if r.kind == 0}
    assert {(cell, x) for cell, a, b in told for x in (a, b)} == named
