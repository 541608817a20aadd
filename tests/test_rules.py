"""Every rule on a document of its own; messages, order and imports."""

import pytest
from pyspark.sql import functions as F

from clausewood.operators.body import with_sections
from clausewood.operators.frontmatter import with_metadata
from clausewood.plans.messages import MESSAGES
from clausewood.plans.validate import validate
from clausewood.sources.readers import from_dicts, from_rows
from tests.fixtures import BASE, BODIES, FRONTS, PARTIES, front


def parse(spark, sources):
    return with_sections(with_metadata(from_rows(spark, [(str(i), s) for i, s in enumerate(sources)])))


@pytest.fixture(scope="module")
def golden(spark):
    sources = [*(BASE + b for b in BODIES), *FRONTS]
    rows = validate(parse(spark, sources)).select("doc_id", "diagnostics").collect()
    return {sources[int(r.doc_id)]: r.diagnostics for r in rows}


@pytest.mark.parametrize("body", BODIES)
def test_body(golden, body):
    assert sorted((d.rule, d.level) for d in golden[BASE + body]) == sorted(BODIES[body])


@pytest.mark.parametrize("source", FRONTS)
def test_frontmatter(golden, source):
    assert sorted((d.rule, d.level) for d in golden[source]) == sorted(FRONTS[source])


def test_every_rule_has_a_document(golden):
    seen = {d.rule for ds in golden.values() for d in ds}
    rules = {rule for rule, _, _ in MESSAGES.values()}
    assert rules - seen == {"anchor-autogen-collision", "amend-def-override", "amend-term-undefined"}  # tested below


def test_order_and_messages(spark):
    source = front("title: ''\nattachments: [{id: s, title: S, file: f}]\n" + PARTIES, '"Aa" {{def: x}} {{money: 1}} {{nope: 1}} {{ref: no}} {{term: q}}\n\n- {{date: z}}')
    (row,) = validate(parse(spark, [source])).select("diagnostics").collect()
    assert [d.message for d in row.diagnostics] == [
        "The document title is required.",
        "Unknown directive '{{nope:}}'. Renderers replace it with [UNKNOWN DIRECTIVE: nope] (§11.5).",
        "Money directive without currency parameter.",
        "Broken section reference: 'no'.",
        "Undefined term reference: 'q'.",
        "Invalid date value 'z'. Must be a valid ISO 8601 date (YYYY-MM-DD).",
        "Attachment 's' is declared but never referenced via {{attach:}}.",
        "Definition 'x' is declared but never referenced via {{term:}}.",
    ]


def test_empty_identifiers_from_a_dictionary(spark):
    section = {"title": "Scope", "level": 1, "blocks": []}
    document = {"metadata": {"title": "T"}, "sections": [section, section, {**section, "identifier": "scope"}]}
    (row,) = validate(from_dicts(spark, [("d", document)])).select("diagnostics", "section_index").collect()
    assert [(d.rule, d.level) for d in row.diagnostics] == [("sides-absent", "warning"), ("anchor-autogen-collision", "warning"), ("anchor-duplicate", "error")]
    assert [e.identifier for e in row.section_index] == ["scope", "scope-2", "scope-3"]


def test_section_index(spark):
    body = "# A {#a}\n### B {#a}\n### C {#a-2}\n## D {#a}\n# E\n"
    (row,) = validate(parse(spark, [body])).select("section_index").collect()
    assert [(e.identifier, e.path, e.level, e.number) for e in row.section_index] == [
        ("a", "a", 1, "1"), ("a-2", "a.a-2", 3, "1.1"), ("a-2-2", "a.a-2.a-2-2", 3, "1.2"), ("a-3", "a.a-3", 2, "1.1"), ("e", "e", 1, "2"),
    ]


def test_imports(spark):
    amends = "title: T\namends: {title: O, file: o.lgd}\nattachments: [{id: s, title: S, file: s.lgd}, {id: r, title: R, file: r.pdf}]\n" + PARTIES
    body = '"Services" {{def: services}} {{term: services}} {{term: fees}} {{term: other}} {{term: gone}} {{attach: s}} {{attach: r}}'
    docs = parse(spark, [front(amends, body)])
    terms = "array<struct<id:string,term:string>>"
    amended = spark.createDataFrame([("o.lgd", "0", True, [("services", "Services"), ("fees", "Fees")])], f"amends_file string, current_filename string, consulted boolean, definitions {terms}")
    attached = spark.createDataFrame([("s.lgd", [("fees", "F"), ("other", "O")]), ("r.pdf", [("gone", "G")])], f"file string, definitions {terms}")
    (row,) = validate(docs, amended, attached).select("diagnostics", "definition_lookup").collect()
    assert [(d.rule, d.level) for d in row.diagnostics] == [("amend-def-override", "warning"), ("def-duplicate-id", "error"), ("amend-term-undefined", "error")]
    assert [d.id for d in row.definition_lookup] == ["services", "fees", "other"]
    unavailable = amended.withColumn("consulted", F.lit(False))
    (row,) = validate(docs, unavailable, None).select("diagnostics").collect()
    assert {d.rule for d in row.diagnostics} == {"amend-term-unresolvable"}
    empty = amended.withColumn("definitions", F.array().cast(terms))
    (row,) = validate(docs, empty, None).select("diagnostics").collect()
    assert {d.rule for d in row.diagnostics} == {"amend-term-undefined"}


def test_no_shuffle(spark):
    plan = validate(parse(spark, ["# A"])).select("diagnostics")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
