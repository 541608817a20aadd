"""The operators' methods against scalar versions, and inputs that their filters and bounds are for."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausewood.llm import chat, decontamination, langid, license_scan, ngram_join, piece_sampling, quality
from clausewood.llm.common import mix, span_hashes
from tests.llm.test_dedup_join import brute_components, corpus
from tests.llm.test_dedup_join import frame as dedup_frame
from tests.llm.test_texts import MODEL, brute_contamination, frame

# ---------------------------------------------------------------- 3


@pytest.mark.parametrize("name", ["strings", "large ids"])
def test_join_ids_of_any_type(spark, name):
    rows = corpus(11, 60)
    ids = {i: f"id-{i:05d}" if name == "strings" else (1 << 63) - 1 - 1000 + i for i, _ in rows}
    kind = "string" if name == "strings" else "long"
    docs = spark.createDataFrame([(ids[i], t) for i, t in rows], f"doc_id {kind}, text string")
    want = {ids[i]: (n, ids[root]) for i, (n, root) in brute_components(rows, 4, 85).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_links(docs, 4, 85).collect()} == want


def test_join_at_100_percent_and_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "a b c d e g"), (4, "x"), (4, "p q r s t u v")]
    got = sorted((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in ngram_join.join_links(dedup_frame(spark, rows), 4, 100).collect())
    assert got == [(1, 3, 1, 1), (2, 3, 1, 1), (3, 3, 0, 3), (4, 1, 0, 4), (4, 4, 0, 4)]


def test_cell_counts_and_discards():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) for n in (5, 40, 400, 1)]
    sets += [np.sort(np.concatenate([sets[2][: 400 - k], rng.integers(0, 1 << 62, k, dtype=np.uint64)])) for k in (3, 30, 60, 200)]
    raw = pa.array([s.tobytes() for s in sets], pa.binary())
    cell = ngram_join.Cell(np.arange(10, 10 + len(sets)), [raw.slice(0, 3), raw.slice(3)])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    got = cell.overlaps(a, b, 80)
    for i, j, n in zip(a, b, got, strict=True):
        shared = len(np.intersect1d(sets[i], sets[j]))
        assert n == (shared if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared) else -1)


def test_parity_bitmaps_bound_from_below():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(base[:n]) for n in (300, 290, 200, 64, 3)]
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits = ngram_join.parity_bitmaps(np.concatenate(sets), np.repeat(np.arange(5), np.diff(cuts)), np.diff(cuts))
    for i in range(5):
        differ = ngram_join.differing_bits(bits, bits.take(pa.array([i] * 5)))
        for j in range(5):
            assert differ[j] <= len(np.setxor1d(sets[i], sets[j])) and (i != j or differ[j] == 0)


# ---------------------------------------------------------------- 4


def test_kept_lattices_change_nothing(monkeypatch):
    texts = ["the cat sat on the mat 中文 été", "the mat", "", "a" * 300, "the cat \n sat"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(15)), pa.array(np.arange(15, dtype=np.int64)), pa.array(texts)], ["doc_id", "key", "text"])

    def draw(kept, size):
        monkeypatch.setattr(piece_sampling, "KEPT_EDGES", kept)
        monkeypatch.setattr(piece_sampling, "LATTICE_BYTES", size)
        rows = pa.Table.from_batches(list(piece_sampling.sample_batches(piece_sampling.Pieces(MODEL), [batch, batch], 3))).to_pylist()
        return sorted(rows, key=lambda r: (r["doc_id"], r["sample"]))

    assert draw(0, 1 << 20) == draw(700_000, 1 << 20) == draw(400, 16)


# ---------------------------------------------------------------- 5


def scalar_features(text):
    """Feature numbers of a text, token by token."""
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+", text.encode())
    one = lambda x: int(mix(np.array([x & (1 << 64) - 1], np.uint64))[0])
    m1, m3 = int(quality.M1), int(quality.M3)
    hashed = lambda t: int(span_hashes(np.frombuffer(t.lower() if t.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in t), np.uint8), np.array([0]), np.array([len(t)]))[0])
    out, before = [], (None, None)
    for t in tokens:
        word = hashed(t)
        upper, digits = sum(65 <= b <= 90 for b in t), any(48 <= b <= 57 for b in t)
        wordlike = bool(re.match(rb"[0-9A-Za-z\x80-\xff]", t))
        shape = one(3 if upper >= 2 else 2 if 65 <= t[0] <= 90 else 4 if digits else 1) if wordlike else word
        again = int(before[0] == word)
        out.append(word)
        out.append(one((before[0] if before[0] is not None else 1) * m1 + word + 1))
        out.append(one(shape + m3))
        out.append(one((before[1] if before[1] is not None else 3) * m1 + shape + again + 3))
        before = (word, shape + again)
    return [x & (1 << quality.BITS) - 1 for x in out], len(tokens)


def test_quality_features_and_steps_against_scalars():
    rng = random.Random(8)
    rows = [(" ".join(rng.choice(["Good", "bad", "BAD", "x1", "été", "!!", "...", "the"]) for _ in range(rng.randint(0, 12))), rng.randrange(2)) for _ in range(40)]
    data = [t.encode() for t, _ in rows]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    leader, z, n = quality.Leader(), collections.defaultdict(float), collections.defaultdict(float)
    alpha, beta, l1, l2 = 1.0, 1.0, 0.02, 0.1

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for (text, label), (numbers, counts, tokens) in zip(rows, quality.counted(np.frombuffer(b"".join(data), np.uint8), offsets), strict=True):
        own, size = scalar_features(text)
        assert (collections.Counter(own), size) == (dict(zip(numbers.tolist(), counts.tolist(), strict=True)), tokens)
        leader.learn(*quality.training_row(numbers, counts, tokens), label)
        values = {i: quality.SCALE * c / max(1, size) for i, c in collections.Counter(own).items()} | {1 << quality.BITS: 1.0}
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in values.items())))
        for i, v in values.items():
            g, w = (p - label) * v, weight(i)
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w
            n[i] += g * g
    weights, bias = leader.model()
    assert abs(bias - weight(1 << quality.BITS)) < 1e-9
    assert all(abs(weights[i] - weight(i)) < 1e-6 for i in list(z) if i < 1 << quality.BITS)
    text = rows[3][0]
    own, size = scalar_features(text)
    want = 1 / (1 + math.exp(-(bias + quality.SCALE * sum(float(weights[i]) for i in own) / max(1, size))))
    assert abs(quality.dots(weights, bias, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0] - want) < 1e-5


# ---------------------------------------------------------------- 7


def test_language_labels_against_scalar_scoring():
    texts = ["der hund ist gut und schoen", "the dog is good and fine", "le chien est bon et beau"] * 8
    model = langid.fit(pa.array(texts), ["de", "en", "fr"] * 8, np.arange(24).astype(np.uint64))
    labels, words, trigrams, move, begin = model
    for text in ("the dog und the chien est", "é", "12 !", "gut " * 200):
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        numbers, grams, starts, ends, _ = langid.word_features(data, np.array([0, len(data)]))
        best, share = langid.label_texts(model, data, np.array([0, len(data)]))
        if not len(starts):
            assert best[0] == -1
            continue
        e = [[sum(float(words[k, j]) for k in numbers[i]) + sum(float(trigrams[g, j]) for g in grams[starts[i] : ends[i]]) / (ends[i] - starts[i]) for j in range(3)] for i in range(len(starts))]
        add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
        a = [[begin[j] + e[0][j] for j in range(3)]]
        for row in e[1:]:
            a.append([add([a[-1][i] + move[i, j] for i in range(3)]) + row[j] for j in range(3)])
        b = [[0.0] * 3]
        for row in reversed(e[1:]):
            b.insert(0, [add([move[i, j] + row[j] + b[0][j] for j in range(3)]) for i in range(3)])
        total = [sum(math.exp(x[j] + y[j] - add([x[i] + y[i] for i in range(3)])) for x, y in zip(a, b, strict=True)) / len(e) for j in range(3)]
        assert labels[best[0]] == labels[max(range(3), key=total.__getitem__)] and abs(share[0] - max(total)) < 1e-3


def test_windows_cover_whole_texts():
    text = " ".join(f"w{chr(97 + i % 26)}" for i in range(130)) + " 12 "
    data = np.frombuffer((text + "x").encode(), np.uint8)
    starts, ends, rows = langid.word_windows(data, np.array([0, len(text), len(text), len(text) + 1]))
    assert rows.tolist() == [0, 0, 0, 2]
    found = [re.findall("[a-z]+", data[s:e].tobytes().decode()) for s, e in zip(starts, ends, strict=True)]
    assert [len(x) for x in found] == [48, 48, 34, 1] and sum(found, [])[:130] == re.findall("[a-z]+", text)


# ---------------------------------------------------------------- 6


def test_logs_fold_back_to_the_texts(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t} é😀[x]" * (t % 3)) for c in range(30) for t in range(6)]
    rows += [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (50, 1, "assistant", "streamed text"), (50, 0, None, None), (51, None, "user", "no turn"), (51, 1 << 62, "user", "late"), (None, 1, "user", "nobody")]
    log = chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat.KINDS) and log.count() > 2 * len(rows)
    got = chat.reconstruct(log.orderBy(F.rand(1))).orderBy(F.col("conv_id"), F.col("seq"), F.col("at")).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert [(r.conv_id, r.turn, r.role, r.text) for r in got] == [(c, t, r or "", x or "") for c, t, r, x in sorted(rows, key=key)]


# ---------------------------------------------------------------- 8


def test_recall_at_the_threshold(spark):
    """Windows at or little above the similarity of 0.8; what the SimHash radius may lose is under a tenth."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60)))) for i in range(60)]
    rows = []
    for i, text in items:
        w = text.split(" ")
        for k in range(6):
            own, cut = list(w), rng.randint(1, max(1, len(w) // 9))
            own = own[cut:] if k % 2 else [*own[:-cut], *(rng.choice(vocabulary) for _ in range(cut))]
            rows.append((10 * i + k, " ".join([*(rng.choice(vocabulary) for _ in range(15)), *own, *(rng.choice(vocabulary) for _ in range(15))])))
    want = brute_contamination(rows, items)
    near = {p for p, s in want.items() if s < 0.85}
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() <= want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    print("recall", len(got), len(want), "near the threshold", len(near & got.keys()), len(near))
    assert len(near) > 20 and len(near & got.keys()) >= 0.9 * len(near) and len(got) >= 0.98 * len(want)


def test_blocks_meet_every_pair_within_the_radius(spark):
    rng = random.Random(5)
    prints, item_prints = [], []
    for i in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.choice([0, 5, decontamination.RADIUS, decontamination.RADIUS + 1])):
            b ^= 1 << bit
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        prints.append((f"k{i}", 20, 0, signed(a)))
        item_prints.append((i, 20, signed(b)))
    left = spark.createDataFrame(prints, "key string, words int, start int, fp long")
    right = spark.createDataFrame(item_prints, "item long, words int, fp long")
    got = {(r.key, r["item"]) for r in decontamination.near_items(left, right).collect()}
    mask = (1 << 64) - 1
    assert got == {(k, i) for k, _, _, a in prints for i, _, b in item_prints if ((a ^ b) & mask).bit_count() <= decontamination.RADIUS}


# ---------------------------------------------------------------- 10

MIT = dict(enumerate(t for label, t in license_scan.TEMPLATES if label == "mit"))[1]
BSD = next(t for label, t in license_scan.TEMPLATES if label == "bsd")


def wrapped(text, width):
    words, lines = text.split(" "), [""]
    for w in words:
        lines = [*lines[:-1], f"{lines[-1]} {w}".strip()] if len(lines[-1]) + len(w) < width else [*lines, w]
    return "\n * ".join(lines)


def test_notices_over_line_ends_and_in_long_lines(spark):
    filler = " ".join(f"f{i}" for i in range(3000))
    scattered = f" {' '.join(f'g{i}' for i in range(40))} ".join(sorted(set(BSD.lower().replace(",", "").split(" "))))
    rows = [
        (1, wrapped(BSD, 40)), (2, wrapped(MIT, 30)), (3, f"{filler} {BSD} {filler}"), (4, scattered), (5, "Released under the BSD License."),
        (6, "Licensed under the Mozilla Public License, Version 2.0."), (7, "This work is licensed under the Eclipse Public License, version 3."), (8, "Licensed under CC BY-NC 4.0."), (9, "Licensed under CC BY 4.0."),
    ]
    got = {r.doc_id: r.labels for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == {1: "bsd", 2: "mit", 3: "bsd", 4: "", 5: "", 6: "", 7: "", 8: "cc-by-nc", 9: "cc-by"}


def test_every_filter_rejects_something(spark):
    """Blocks that each filter alone rules out, and one that meets the template."""
    templates = license_scan.ordered(license_scan.compiled((("long", " ".join(f"t{i:02d}" for i in range(20))), ("short", "t00 t01 zz")), 0.8), {})
    span = templates[0].span
    long = [f"t{i:02d}" for i in range(20)]
    texts = {1: long[:16], 2: long[10:], 3: [long[0], *long[6:12]], 4: ["none"] * 9, 5: long[2:19], 6: [*long[3:5], *(f"y{i}" for i in range(60))]}
    scanned = spark.createDataFrame([(i, w) for i, w in texts.items()], "row long, words array<string>")
    blocks = license_scan.blocks_of(scanned, templates, {}).where(F.col("span") == span)
    formed = {r.row for r in blocks.select("row").distinct().collect()}
    assert 4 not in formed and 2 not in formed  # no prefix word of the template
    assert 3 not in formed and 6 not in formed  # too few tokens
    assert {(r.row, r.template) for r in license_scan.candidates(blocks, templates).collect()} == {(1, 0), (5, 0)}
    # Positional: the first shared token stands too far back in a block whose prefix goes by a lesser need.
    two = license_scan.ordered(license_scan.compiled((("a", " ".join(f"t{i:02d}" for i in range(20))), ("b", " ".join(f"s{i:02d}" for i in range(25)))), 0.8), {f"t{i:02d}": 5 for i in range(20)})
    words = [*(f"s{i:02d}" for i in range(10)), *long[4:19]]
    block = license_scan.blocks_of(spark.createDataFrame([(1, words)], "row long, words array<string>"), two, {f"t{i:02d}": 5 for i in range(20)})
    assert block.count() >= 1 and license_scan.candidates(block, two).collect() == []


def test_lattices_look_no_further_than_a_piece_begins(monkeypatch):
    """Spans that no piece begins with are not looked up at every longer size, and the lattices are the same."""
    pieces = piece_sampling.Pieces(MODEL)
    looked, find = [], piece_sampling.Pieces.find
    monkeypatch.setattr(piece_sampling.Pieces, "find", lambda self, keys: looked.append(len(keys)) or find(self, keys))
    text = " " + "zqxj" * 100 + "internationalisation" * 3
    data = np.frombuffer(text.encode(), np.uint8)
    lattices = piece_sampling.Lattices(pieces.byte_id)
    _, _, edges = lattices.build(pieces, data, np.array([0]), np.array([len(data)]))
    assert sum(looked) <= 5 * len(data)
    own = {pieces.raw[i] for i in pieces.ids.tolist() if i >= 0}
    wanted = sum(data[i:j].tobytes() in own for i in range(len(data)) for j in range(i + 1, min(len(data), i + pieces.longest) + 1))
    bare = sum(data[i : i + 1].tobytes() not in own for i in range(len(data)))
    assert edges == wanted + bare
    assert pieces.spelled(np.array([5, 400, 9000])) == b"".join(pieces.raw[i] for i in (5, 400, 9000)) and pieces.spelled(np.zeros(0, np.int32)) == b""
