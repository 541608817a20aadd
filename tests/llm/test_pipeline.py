"""The pipeline's stages one by one and together, on rows of every odd kind, against brute force."""

import random

import pytest

import corpus_pipeline
from clausewood.llm import piece_sampling, quality
from clausewood.llm.common import fresh
from tests.llm.test_dedup_join import brute_components, lower
from tests.llm.test_texts import MODEL, brute_contamination

#: Names that operators use inside; none of them may get lost or in the way.
CLASHES = ["id", "key", "row", "node", "score", "digest", "label", "words", "quality_score", "lost_id", "lost_digest", "lost_key", "hit_key", "component_id", "QUALITY_SCORE_"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "hot", len(t or ""), *(f"{c}!" for c in CLASHES)) for i, t in rows], SCHEMA)


def sample_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(80)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(15, 30))) for i in range(6)]
    rows = [(i, say(rng.randint(5, 60))) for i in range(40)]
    rows += [(100 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(10)]
    rows += [(200 + i, rows[20 + i][1] + " tail") for i in range(10)]
    rows += [(300 + i, f"{say(4)} {t} {say(4)}") for i, t in items]
    rows += [(400, None), (401, ""), (402, " \n "), (403, "Lone"), (404, "x" * 50_000), (405, f"{say(9)} " * 2_000), (5, rows[5][1]), (5, rows[5][1]), (6, "another text of six"), (None, say(30)), (None, rows[7][1])]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = sample_rows()
    top = str(tmp_path_factory.mktemp("sf"))
    frame(spark, rows).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, folder, monkeypatch):
    _, items = sample_rows()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    # Quality: what the fitted weights score below the cut goes, nothing else.
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    weights, bias = quality.train(docs, labels, labels.doc_id.isNotNull() if False else quality.F.lit(True), 10_000, "doc_id", "text")
    good = stages["quality"](spark, docs, folder)
    score = lambda t: float(quality.dots(weights, bias, quality.np.frombuffer((t or "").encode(), quality.np.uint8), quality.np.array([0, len((t or "").encode())]))[0])
    assert good.columns == COLUMNS
    assert pairs(good) == sorted([p for p in pairs(docs) if score(p[1]) >= quality.CUT], key=str)

    # Exact copies: of equal texts one row with the largest id stays.
    single = stages["exact_dedup"](spark, docs, folder)
    best: dict[str, tuple] = {}
    for i, t in pairs(docs):
        k = lower(t)
        if k not in best or (i is not None and (best[k][0] is None or i > best[k][0])):
            best[k] = (i, t)
    assert single.columns == COLUMNS
    assert sorted((str(i), lower(t)) for i, t in pairs(single)) == sorted((str(i), k) for k, (i, _) in best.items())

    # Near copies: of each component the least id stays; rows without id or words do, too.
    named = [(i, t) for i, t in best.values() if i is not None]
    thin = stages["near_dedup"](spark, single, folder)
    truth = brute_components(named, 5, 80)
    assert thin.columns == COLUMNS
    assert {i for i, _ in pairs(thin)} == {i for i, (_, root) in truth.items() if root == i} | {i for i, _ in best.values() if i is None}

    # Contaminated documents go, the others stay.
    clean = stages["decontamination"](spark, single, folder)
    hit = {i for i, _ in brute_contamination([(k, t) for k, (_, t) in enumerate(best.values())], items)}
    assert clean.columns == COLUMNS and hit
    assert sorted((str(i), lower(t)) for i, t in pairs(clean)) == sorted((str(i), lower(t)) for k, (i, t) in enumerate(best.values()) if k not in hit)

    # Samples decode to their texts.
    encoded = stages["encoding"](spark, docs.where("doc_id < 20 OR doc_id >= 400 OR doc_id IS NULL"), folder)
    texts = {(str(i), t or "") for i, t in pairs(docs)}
    assert all(r.round_trip and (str(r.doc_id), r.text) in texts for r in piece_sampling.decode(encoded, MODEL).collect())


def test_run_is_the_chain_of_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder))
    key = lambda df: sorted((str(r.doc_id), r.sample, tuple(r.pieces)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(docs) and docs.count() > 10


def test_empty_tables(spark, folder):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == [], name
        assert name == "encoding" or out.columns == COLUMNS


def test_fresh_names(spark):
    assert fresh("a", frame(spark, [])) == "a" and fresh("Quality_Score", frame(spark, [])) == "Quality_Score__"
