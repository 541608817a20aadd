"""Source text to canonical text by one Python step, against parsing and serializing rows."""

import random

import pytest
import yaml

from clausewood import engine, queries
from clausewood.operators.frontmatter import NotSimple, TextDates, read_simple
from clausewood.operators.serialize import canonical, canonical_text, head_text, serialize
from clausewood.sources.contracts import contracts
from clausewood.sources.readers import from_rows
from tests.fixtures import BASE, BODIES, FRONTS
from tests.test_diagnose import ODD, PIECES

SF = "/root/testdata/sf0.001"
WORDS = ["", "a", "b c", "On", "null", "y", "a #b", "a#b", "#a", "2026-02-30", "2026-2-30", "12", "a: b", "a:", "it's", '"', "x" * 69, "x " * 45 + "x", "é", " a", "a ", "a  b", "- a", "-", "a\nb", "~", "1_0", "=", "<<", "a-", "a.", "c/d_e"]


def test_the_round_trip_makes_no_rows_of_sections(spark):
    plan = queries.queries()["k3_serialize_round_trip"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "sections" not in plan and "from_json" not in plan and "PandasUDF" not in plan


def test_texts_give_what_rows_give(spark):
    dice, base = random.Random(3), [*ODD, *(BASE + b for b in BODIES), *FRONTS, *(r.source for r in contracts(spark, SF).limit(60).collect())]
    sources = list(base)
    for _ in range(1_500):
        text = dice.choice(base)
        for _ in range(dice.choice([1, 2, 4])):
            at = dice.randrange(len(text) + 1)
            text = text[:at] + dice.choice(PIECES) + text[at + dice.choice([0, 0, 1, 3]) :]
        sources.append(text)
    rows = from_rows(spark, [(str(i), s) for i, s in enumerate(sources)])
    want = {r.doc_id: r.serialized for r in serialize(engine.parse(rows)).select("doc_id", "serialized").collect()}
    got = {r.doc_id: r.serialized for r in canonical(rows).select("doc_id", "serialized").collect()}
    for i, source in enumerate(sources):
        assert got[str(i)] == want[str(i)], source
    assert None in want.values() and len(set(want.values())) > 500


def test_heads_are_written_as_the_library_writes_them():
    dice = random.Random(5)

    def value(depth):
        kind = dice.random()
        if depth == 0 or kind < 0.6:
            return dice.choice(WORDS)
        if kind < 0.8:
            return {dice.choice(WORDS) if dice.random() < 0.2 else f"k{i}": value(depth - 1) for i in range(dice.choice([0, 1, 2, 3]))}
        return [dice.choice(WORDS) if dice.random() < 0.5 else {"k": value(depth - 1), "l": dice.choice(WORDS)} for _ in range(dice.choice([0, 1, 2]))]

    for _ in range(5_000):
        record = {f"k{i}": value(3) for i in range(3)}
        assert head_text(record) == yaml.safe_dump(record, sort_keys=False, allow_unicode=True).strip()


@pytest.mark.parametrize("text", ["a:\n- b: c\n  d:\n  - e: 'f g'\n    h: i#j\n  k: l\n- b: '2026-01-01'\nm: n", "a:\n  b:\n  - c: d\n  e: ''", "a: '#b'\nc:\n- d:\ne:\n- f: g"])
def test_canonical_heads_are_read_line_by_line(text):
    assert read_simple(text) == yaml.load(text, Loader=TextDates)


@pytest.mark.parametrize("text", ["a:\n- b: c\n  - d: e", "a:\n- b: c\n d: e", "a:\n- b: c\n - d: e", "a: 'b''c'", "a: b #c", "a: 'b' c", "a:\n- b: c\n- {d: e}", "a: b\n- c: d"])
def test_other_heads_are_not(text):
    with pytest.raises(NotSimple):
        read_simple(text)


def test_a_contract_is_stable(spark):
    texts = [r.source for r in contracts(spark, SF).limit(50).collect()]
    once = [t for t in map(canonical_text, texts) if t]
    assert [canonical_text(t) for t in once] == once and any(t not in once for t in texts)
    assert all(read_simple(t.split("---\n")[1].rstrip("\n")) for t in once)
