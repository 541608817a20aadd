"""Diagnostics without indices, by one Python step, against ``validate``."""

import random

import pytest

from clausewood import engine, queries
from clausewood.plans.diagnose import diagnosed
from clausewood.plans.validate import validate
from clausewood.sources.contracts import contracts
from clausewood.sources.readers import from_rows
from tests.fixtures import BASE, BODIES, FRONTS, PARTIES, front
from tests.test_documents import BODY

SF = "/root/testdata/sf0.001"
ODD = [
    "", "---\ntitle: [\n---\n", "---\n[1]\n---\n", "﻿---\ntitle: x\n---\n# A", "---\ntitle: x\n--- trailing\n# A", "---\r\ntitle: x\n---\r\n# A\x0b# A", BODY,
    front("title: T\namends: {title: ''}\nfield_types: {date: x, Bad: y}\nattachments: [{id: a}, {id: a, title: A, file: f}, {id: B}, {}]\n" + PARTIES, BODY),
    BASE + "# A {#a}\n### A\n# a {#a}\n# Article IV {#Bad_1}\n###### Deep\n# a.b {#s}\n\nSee {{ref: a.a-2}} {{ref: }} {{term: }} {#end}\n\n- x {#end}\n- {#X}",
    BASE + '**"A"** {{def: }} “B” {{def: b}} ‘C’ {{def:c}} {{def: bare}} "" {{def: B d}}\n\n"" {{def: 3rd-x}} y\n\n"A" {{def: a}} {{def: b}}',
    BASE + "{{date: ٢٠٢٤-٠٢-٣٠}} {{money: ١, currency=XXX}} {{money: 1., note=a*b}} {{duration: 1_0, unit=MIN}} {{duration: inf}} {{duration: 1d, unit=q}} {{date: 2024-02-29, note=a, b}} `{{date: x}}` <!-- {{date:\ny}} --> {{{date: z}}",
    BASE + "{{placeholder: a, type=money, currency=ZZZ}} {{placeholder: a}} {{placeholder: A b}} {{placeholder: b, type=x}}\n\n| {{field: 1, type=q}} | {{field: 2, type=Q}} |\n|--|--|\n| {{side: nobody}} {{party: No}} | {{attach: no}} {{nope: {{nope: x}}",
]
PIECES = ["", "\n", "\n\n", " ", "{{", "}}", "{{def: x}}", '"', "“", "’", "`", "```\n", "<!--", "-->", "~~~", "#", "# ", "{#a}", "- ", "1. ", "| a |\n", "> ", "{{ref: ", "{{term: x}}", "note=", ",", "İ", "١", " ", "---\n", "{{placeholder: q}}", "null", "''", "é", "*", "{{money: 5}}"]


def both(spark, sources):
    rows = from_rows(spark, [(str(i), s) for i, s in enumerate(sources)])
    by_row = {r.doc_id: [tuple(d) for d in r.diagnostics] for r in validate(engine.parse(rows)).select("doc_id", "diagnostics").collect()}
    at_once = {r.doc_id: [tuple(d) for d in r.diagnostics] for r in diagnosed(rows).select("doc_id", "diagnostics").collect()}
    return [(s, by_row[str(i)], at_once[str(i)]) for i, s in enumerate(sources)]


@pytest.mark.parametrize("name", ["g7_validity", "contract_diagnostics_by_rule", "g2_report_promoted"])
def test_sections_never_become_rows(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan and "sections" not in plan


def test_documents_of_every_rule_give_what_validate_gives(spark):
    for source, want, got in both(spark, [*ODD, *(BASE + b for b in BODIES), *FRONTS]):
        assert got == want, source


def test_contracts_give_what_validate_gives(spark):
    sources = [r.source for r in contracts(spark, SF).select("source").collect()]
    found = both(spark, sources)
    assert all(got == want for _, want, got in found) and len({d[0] for _, _, got in found for d in got}) == 16


def test_changed_documents_give_what_validate_gives(spark):
    dice, base = random.Random(11), [*ODD, *(BASE + b for b in BODIES), *FRONTS]
    sources = []
    for _ in range(1_500):
        text = dice.choice(base)
        for _ in range(dice.choice([1, 2, 4])):
            at = dice.randrange(len(text) + 1)
            text = text[:at] + dice.choice(PIECES) + text[at + dice.choice([0, 0, 1, 3]) :]
        sources.append(text)
    for source, want, got in both(spark, sources):
        assert got == want, source
