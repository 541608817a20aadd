"""Sharding, token counts, sampling, classifiers, chat, licenses and decontamination on small tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

from clausewood.llm import chat, decontamination, langid, license_scan, piece_sampling, quality, sharding, token_counts
from clausewood.llm.common import mix, slices

SCHEMA = "doc_id long, text string, lang string, score double, row long, key long, words string"
ODD = ["", None, " ", "a", "  lead", "tail ", "Hello  world\n x", "été ▁ 中文😀", "don't", "<|endoftext|>", "x <|endoftext|> y", "a" * 30_000, "\n\n \n", "1234 $$$!!", "\x1c\x85 é"]


def frame(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, 0.5, 1, 2, "w") for i, t in rows], SCHEMA)


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 5)
    assert sorted(p.tolist()) == list(range(n))
    assert n < 100 or (p != np.arange(n)).mean() > 0.9


def test_shards(spark):
    rows = [(i // 2, t) for i, t in enumerate(ODD * 5)] + [(None, "z"), (None, None)]
    got = sharding.shard(frame(spark, rows).repartition(7), shards=4).collect()
    assert len(got) == len(rows)
    again = sharding.shard(frame(spark, rows).repartition(3), shards=4).collect()
    place = lambda rs: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rs)
    assert place(got) == place(again)
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    assert sharding.shard(frame(spark, [])).collect() == []


# ---------------------------------------------------------------- tokens


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(" \n\tabAB01'sré　​中😀<|>") for _ in range(rng.randint(0, 14))) for _ in range(500)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, rows), path).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512), t
    assert token_counts.token_counts(frame(spark, []), path).collect() == []


# ---------------------------------------------------------------- sampling

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def draw(texts, seeds, k):
    pieces, out, base = piece_sampling.vocabulary(MODEL), {}, 0
    for part, data, offsets in slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text"):
        sampler = piece_sampling.Sampler(pieces, data, offsets, seeds[base : base + part.num_rows], k)
        for row, samples, kappa in sampler.draw():
            out[base + row] = ([(tuple(sampler.lattices.piece_ids(e).tolist()), lp, peak) for e, lp, peak in samples], kappa)
        base += part.num_rows
    return out


def test_sampling_follows_the_distribution():
    pieces = piece_sampling.vocabulary(MODEL)
    weight = {pieces.raw[i]: w for i, w in zip(pieces.ids.tolist(), pieces.weights.tolist(), strict=True)}

    def all_of(text):
        if not text:
            return [((), 0.0)]
        return [((text[:j], *rest), weight[text[:j]] + w) for j in range(1, len(text) + 1) if text[:j] in weight for rest, w in all_of(text[j:])]

    segmentations = all_of(b" them")
    total = sum(math.exp(w) for _, w in segmentations)
    p = {s: math.exp(w) / total for s, w in segmentations}
    n = 6000
    got = draw(["them"] * n, mix(np.arange(n).astype(np.uint64) + np.uint64(5)), 2)
    named = [[tuple(pieces.raw[i] for i in ids) for ids, _, _ in got[i][0]] for i in range(n)]
    firsts, pairs = collections.Counter(x[0] for x in named), collections.Counter(map(tuple, named))
    for s, q in p.items():
        assert abs(firsts[s] / n - q) < 0.02
    for a, b in itertools.permutations(p, 2):
        assert abs(pairs[(a, b)] / n - p[a] * p[b] / (1 - p[a])) < 0.025
    for i in range(50):
        for ids, lp, _ in got[i][0]:
            assert abs(math.exp(lp) - p[tuple(pieces.raw[j] for j in ids)]) < 1e-9
    # Samples divided by their inclusion scores are unbiased: their weights sum to 1 on average.
    sums = [sum(math.exp(lp) / -math.expm1(-math.exp(lp - kappa)) for _, lp, _ in ss) for ss, kappa in got.values()]
    assert abs(np.mean(sums) - 1) < 0.05


def test_few_segmentations_all_come():
    got = draw(["a"], mix(np.array([1], np.uint64)), 8)
    samples, kappa = got[0]
    assert len(samples) == 2 and kappa == -np.inf
    assert abs(sum(math.exp(lp) for _, lp, _ in samples) - 1) < 1e-9


def test_sampling_round_trips(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [*enumerate(ODD), (None, "null key"), (3, "a")]
    sampled = piece_sampling.sample_segmentations(frame(spark, rows), MODEL, k=3)
    decoded = piece_sampling.decode(sampled, MODEL).collect()
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    for r in decoded:
        assert r.round_trip and r.text in texts[r.doc_id] and r.n_pieces == len(r.pieces)
        if "\x85" not in r.text:
            assert library.decode(list(r.pieces)) == r.text
        assert 0 < r.inclusion <= 1 + 1e-12
    per_row = collections.defaultdict(list)
    for r in decoded:
        per_row[r.doc_id].append(r)
    for i, own in per_row.items():
        if i not in (3,):
            assert len({tuple(r.pieces) for r in own}) == len(own)
            own.sort(key=lambda r: r.sample)
            assert all(a.perturbed >= b.perturbed for a, b in itertools.pairwise(own))
    again = piece_sampling.sample_segmentations(frame(spark, rows).repartition(5), MODEL, k=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, sampled.collect()))
    assert piece_sampling.sample_segmentations(frame(spark, []), MODEL).collect() == []


# ---------------------------------------------------------------- classifiers

DATA = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    for r in got:
        assert zlib.crc32(str(r.doc_id).encode()) % 5 == 0


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1), (3, None), (None, 0), (6, 0)], "doc_id long, quality int")
    rows = [*enumerate(ODD), (None, "x"), (3, "again")]
    got = quality.classify(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    empty = {r.score for r in got if r.doc_id in (0, 1)}
    assert len(empty) == 1
    none = quality.classify(frame(spark, rows), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    kept = quality.keep_good(frame(spark, rows), labels)
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    assert quality.classify(frame(spark, []), labels).collect() == []


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_language_odd_rows(spark):
    docs = frame(spark, [*enumerate(ODD), (None, "the")])
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for i, t in enumerate(ODD):
        lettered = bool(regex.search(r"\p{L}", t or ""))
        assert got[i].lang_pred == ("en" if lettered else "und"), t
        assert 0 <= got[i].score <= 1 and (lettered or got[i].score == 0)
    unlabelled = langid.identify(frame(spark, [(0, "a")], lang=None)).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]
    assert langid.identify(frame(spark, [])).collect() == []


def test_forward_backward_against_log_space():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 64, 65, 200, 0, 128, 3])
    scores, move, begin = rng.normal(size=(lengths.sum(), 3)) * 2, rng.normal(size=(3, 3)), rng.normal(size=3)
    got, at = langid.marginals(scores, lengths, move, begin), 0
    add = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    for n in lengths[lengths > 0]:
        e = scores[at : at + n]
        a, b = np.zeros((n, 3)), np.zeros((n, 3))
        a[0] = begin + e[0]
        for t in range(1, n):
            a[t] = add(a[t - 1][:, None] + move, 0) + e[t]
        for t in range(n - 2, -1, -1):
            b[t] = add(move + e[t + 1] + b[t + 1], 1)
        p = np.exp(a + b - (a + b).max(1, keepdims=True))
        assert np.allclose(p / p.sum(1, keepdims=True), got[at : at + n], atol=1e-9)
        at += n


def test_code_switched_text_changes_label_inside(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang").where("length(text) BETWEEN 400 AND 3000").collect()
    texts, langs = [r.text for r in docs], [r.lang for r in docs]
    model = langid.fit(pa.array(texts), langs, np.arange(len(texts)).astype(np.uint64))
    en, fr = (next(t for t, x in zip(texts, langs, strict=True) if x == lang)[:300] for lang in ("en", "fr"))
    data = np.frombuffer((en + " " + fr).encode(), np.uint8)
    numbers, grams, starts, ends, _ = langid.word_features(data, np.array([0, len(data)]))
    post = langid.marginals(langid.emissions(model, numbers, grams, starts, ends), np.array([len(starts)]), model[3], model[4])
    best = np.array(model[0])[post.argmax(1)]
    split = starts >= len(en.encode())
    assert (best[~split] == "en").mean() > 0.9 and (best[split] == "fr").mean() > 0.9


# ---------------------------------------------------------------- chat


def run_chat(spark, events):
    log = spark.createDataFrame(events, "conv_id long, seq long, turn long, kind string, role string, text string")
    return chat.render(chat.reconstruct(log))


def test_fold_of_events(spark):
    events = [
        (1, 3, 1, "delta", "assistant", "lo"), (1, 2, 1, "message", "assistant", "Hel"), (1, 1, 0, "message", "user", "hi"),
        (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "Bye"), (1, 7, 1, "delta", None, "!"),
        (1, 8, 0, "edit", None, "HI [x] <s> \\"), (2, 1, 0, "delta", "assistant", "only"), (None, 1, 0, None, None, None),
        (3, 1, 0, "message", "user", "dup"), (3, 1, 0, "message", "user", "dup"),
    ]
    got = {r.conv_id: r for r in run_chat(spark, events).collect()}
    assert got[1].formatted == "<|turn|>user\nHI [\\x] <\\s> \\\\<|end|><|turn|>assistant\nBye!<|end|>"
    (m,) = got[1].mask
    assert got[1].formatted[m.start : m.start + m.length] == "Bye!" and m.turn == 1
    assert got[2].formatted == "<|turn|>assistant\nonly<|end|>"
    assert got[3].formatted == "<|turn|>user\ndup<|end|>" * 2
    assert got[None].formatted == "<|turn|>\n<|end|>" and got[None].mask == []


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["</s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>", "\\", "<", "[", "\n", "é😀", "", "<n>", "ok", "\\\\", "<\\"]
    rows = []
    for c in range(60):
        rows += [(c, t, t, "message", rng.choice(["user", "assistant", "sys\ntem", "<n>", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])) for t in range(rng.randint(1, 9))]
    rows.append((99, 0, 0, "message", "assistant", "long [" * 20_000))
    rendered = run_chat(spark, rows)
    got = {r.conv_id: r for r in chat.digest(rendered).collect()}
    text = {r.conv_id: r for r in rendered.collect()}
    for c in got:
        own = [(r or "", t or "") for conv, _, _, _, r, t in rows if conv == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(text[c].formatted)
        inside = re.sub(r"<\|(turn|end)\|>", "", text[c].formatted)
        assert "</s>" not in inside and "[INST]" not in inside and "<|" not in inside


# ---------------------------------------------------------------- licenses


def test_license_scan(spark):
    rows = [
        (1, "Released under the MIT License."), (2, "x MIT, license y mit  LICENSE"), (3, None), (4, ""), (5, "license"),
        (6, "foo\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following are met\nbar"),
        (7, "subject to the terms of the Mozilla Public License this source code form is v 2 0"), (8, "general public license " * 5_000), (1, "Apache\nLicense"), (None, "mit-license é"),
    ]
    got = license_scan.license_scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_words): r for r in got}
    assert by[(1, 5)].labels == "mit" and (by[(1, 5)].n_base, by[(1, 5)].first_word, by[(1, 5)].last_word) == (1, 3, 3)
    assert (by[(2, 6)].n_base, by[(2, 6)].first_word, by[(2, 6)].last_word, by[(2, 6)].base_labels) == (2, 1, 4, "mit")
    assert [(r.n_words, r.labels, r.score) for r in got if r.doc_id in (3, 4)] == [(0, "", 0.0)] * 2
    assert by[(5, 1)].labels == ""
    six = next(r for r in got if r.doc_id == 6)
    assert (six.labels, six.base_labels, six.n_base) == ("bsd", "", 0) and 0.8 <= six.score < 1
    assert next(r for r in got if r.doc_id == 7).labels == "mpl"
    eight = next(r for r in got if r.doc_id == 8)
    assert (eight.n_base, eight.last_word) == (5_000, 14_997)
    assert by[(1, 2)].base_labels == "apache"
    assert next(r for r in got if r.doc_id is None).base_labels == "mit"
    assert license_scan.license_scan(frame(spark, [])).collect() == []


# ---------------------------------------------------------------- decontamination


def brute_contamination(rows, items, width=5, threshold=0.8):
    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    out = {}
    for item, text in items:
        own = words(text)
        if not own:
            continue
        n = min(width, len(own))
        target = collections.Counter(grams(own, n))
        m = sum(target.values())
        for doc, t in rows:
            w = words(t)
            best = 0.0
            for s in range(max(1, len(w) - len(own) + 1)):
                window = collections.Counter(grams(w[s : s + len(own)], n))
                shared = sum((window & target).values())
                best = max(best, shared / (m + sum(window.values()) - shared) if window else 0)
            if best >= threshold - 1e-12:
                out[(doc, item)] = max(best, out.get((doc, item), 0))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(40)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(12, 40)))) for i in range(12)] + [(20, "only three words"), (21, None), (22, "..."), (23, "v1 v1 v1 v1 v1 v1 v1 v1 v1"), (24, "Only THREE words!")]
    rows = []
    for d in range(120):
        w = items[rng.randrange(12)][1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], say(1), say(2)])
        rows.append((d, " ".join(say(rng.randint(0, 30)) + w[: rng.choice([len(w), len(w) - 2])] + say(rng.randint(0, 30)))))
    rows += [(500, None), (501, ""), (502, "say: ONLY three, words?"), (503, "v1 " * 30_000), (504, rows[0][1]), (0, rows[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(frame(spark, rows), benchmark).collect()}
    want = brute_contamination(rows, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(want) > 30 and len({d for d, _ in want}) < len(rows)
    clean = decontamination.decontaminate(frame(spark, rows), benchmark)
    assert clean.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in rows if d not in {x for x, _ in want})
    assert decontamination.contaminated(frame(spark, []), benchmark).collect() == []
    assert decontamination.contaminated(frame(spark, rows), benchmark.where("false")).collect() == []


def test_truncated_items_are_whole_documents(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([9, 10, 14, 20, 20, 24, 36, 60])]
    rows = []
    for i, text in items:
        w = text.split(" ")
        for lost in range(len(w) // 3):
            rows += [(1000 * i + 2 * lost, " ".join(w[: len(w) - lost])), (1000 * i + 2 * lost + 1, " ".join(w[lost:]))]
    rows.append((9000, " ".join(items[3][1].split(" ")[:18])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(frame(spark, rows), benchmark).collect()}
    want = brute_contamination(rows, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert got[(9000, 3)] == 0.875
