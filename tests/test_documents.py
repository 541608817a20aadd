"""Parsing, scalars, serializing, reports, the command line and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from clausewood import cli, engine
from clausewood.functions import scalars as S
from clausewood.operators.serialize import serialize, to_dicts
from clausewood.plans import report, views
from clausewood.sources import readers
from clausewood.streaming.stream import diagnostics_stream, read_stream
from tests.fixtures import BASE, PARTIES, front

BODY = """lost line
# Terms {#terms}

"Alpha" {{def: x}} is.
more text

- a
  cont
- b
1. c

1. one
2. two
  > in
> quote
>
> q2
| A | | B |
|--|--|
| 1 | 2 |
|||
---
See {{ref: terms, format=full}} there.

Use {{term: x, label=Y}} `{{nope: 1}}`
## Sub Title
  - x
text
| one line |
"""


def rows(spark, *sources):
    return readers.from_rows(spark, [(f"{i}.lgd", s) for i, s in enumerate(sources)])


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_scalars(spark):
    assert column(spark, ["Fee Note", "  --A_b  c!", "3rd", "", "é", "_", "x" * 70, "K_\x85y", "1" * 70], S.slugify) == ["fee-note", "a-b-c", "section-3rd", "section", "section", "section", "x" * 64, "k-y", "section-" + "1" * 56]
    assert column(spark, ["2024-02-29", "2023-02-29", "0000-01-01", "2024-1-01", "٢٠٢٤-٠١-٠١", "2024-01-01T10"], S.is_iso_date) == [True, False, False, False, True, False]
    assert column(spark, ["1", "1.50", "-1", "1e3", "1.", "", "١", "9" * 400], S.is_money_amount) == [True, True, False, False, False, False, True, False]
    assert column(spark, ["1", "inf", "1e5", "1_000", "+5", " 2 ", ".5", "5.", "nan", "-1", "0", "1d", "1__0", "", "1e-400"], S.is_positive) == [True] * 8 + [False] * 7
    assert column(spark, ["1", "inf", "nan", "-1e3", "x"], S.is_numeric) == [True, False, False, True, False]
    assert column(spark, ["3rd-party", "a-b", "o"], S.display_name) == ["3Rd Party", "A B", "O"]
    assert column(spark, ["\xa0 a ", "\x1cb\x85"], S.strip) == ["a", "b"]
    masked = column(spark, ["a `b` c", "a <!-- x\ny --> b", "`a <!-- x\ny --> b`", "``a\nb`` c", "```\nx\n``` d", "<!-- a <!-- b --> c"], S.mask_literals)
    assert masked == ["a   c", "a \n b", "`a \n b`", "  c", "\n d", "  c"]
    assert [q[2] for q in S.accepted_quotes({"de": ["guillemets"]}, "DE")] == ["guillemets"] and len(S.accepted_quotes()) == 8


def test_blocks(spark):
    (row,) = engine.parse(rows(spark, BODY)).collect()
    first, second = row.sections
    got = [{k: v for k, v in b.asDict().items() if v} for b in first.blocks]
    assert got == [
        {"kind": "definition", "definition_id": "x", "term": "Alpha", "text": "is. more text"},
        {"kind": "unordered_list", "items": ["a cont", "b"]},
        {"kind": "ordered_list", "items": ["c"]},
        {"kind": "ordered_list", "items": ["one", "two > in"]},
        {"kind": "quote", "text": "quote\n\nq2"},
        {"kind": "table", "headers": ["A", "B"], "rows": [["1", "2"]]},
        {"kind": "rule"},
        {"kind": "ref", "prefix": "See ", "target": "terms", "format": "full", "suffix": " there."},
        {"kind": "term", "prefix": "Use ", "target": "x", "label": "Y", "suffix": " `{{nope: 1}}`"},
    ]
    assert (second.title, second.level, second.identifier) == ("Sub Title", 2, "sub-title")
    assert [(b.kind, b.items, b.text) for b in second.blocks] == [("unordered_list", ["x"], ""), ("paragraph", [], "text | one line |")]


def test_line_ends_and_odd_sources(spark):
    got = engine.parse(rows(spark, "# A\x0b# B\u2028# C\r\n# D", "", None, "\ufeff---\ntitle: x\n---\n# A", "---\ntitle: x\n--- trailing\n# A", "#\xa0NBSP", "####### seven\n#none")).orderBy("doc_id").collect()
    assert [[s.title for s in r.sections] for r in got] == [["A", "B", "C", "D"], [], [], ["A"], ["A"], ["NBSP"], []]
    assert [r.metadata.title for r in got] == ["", "", "", "", "x", "", ""]


def test_coercion(spark):
    text = """title: 5
language: no
version: 1.10
effective_date: 2024-01-01
include_signatures: "off"
tags: a, b,,c
field_types: {x: 1, "": y, z: null}
amends: {}
sides: [1, {name: a, parties: [x, {name: 0, representatives: [{name: Z}, 4]}]}]
"""
    (row,) = engine.parse(rows(spark, front(text))).collect()
    m = row.metadata
    assert (m.title, m.language, m.version, m.effective_date, m.include_signatures, m.tags) == ("5", "en", "1.1", "2024-01-01", False, ["a", "b", "c"])
    assert [tuple(p) for p in m.field_types] == [("x", "1")] and tuple(m.amends) == ("", "")
    assert [(s.name, [(p.name, [r.name for r in p.representatives]) for p in s.parties]) for s in m.sides] == [("a", [("", ["Z"])])]


def test_serialize_round_trip(spark):
    full = front("title: T\nsubtitle: S\ndocument_type: unilateral_act\nfield_types: {b: x, a: y}\namends: {title: O}\nattachments: [{id: s, title: S, file: f}, {id: t}]\ntags: [q]\n" + PARTIES, BODY.split("\n", 2)[2])
    parsed = engine.parse(rows(spark, full, BASE + "Text.", "---\ntitle: [\n---\n"))
    once = serialize(parsed).select("doc_id", "file", "filename", F.col("serialized").alias("source"))
    kept = {r.doc_id: r.source for r in once.collect()}
    assert kept["2.lgd"] is None
    again = {r.doc_id: r.serialized for r in serialize(engine.parse(once.where("source IS NOT NULL"))).collect()}
    assert {k: kept[k] for k in again} == again
    assert kept["1.lgd"].startswith("---\ntitle: Fixture\nsides:\n- name: providers\n  parties:\n  - name: acme\n    type: legal_entity\n    legal_name: Acme Corporation\n")
    assert kept["1.lgd"].endswith("language: en\n---\n\n# Terms {#terms}\n\nText.\n")
    for text in ('"Alpha" {{def: x}} is. more text', "- a cont\n- b", "1. one\n2. two > in", "> quote\n>\n> q2", "| A | B |\n| --- | --- |\n| 1 | 2 |", "See {{ref: terms, format=full}} there.", "field_types:\n  b: x\n  a: y", "attachments:\n- id: s\n  title: S\n  file: f\ntags:"):
        assert text in kept["0.lgd"], text


def test_dictionary_round_trip(spark):
    parsed = engine.parse(rows(spark, front("title: T\nfield_types: {b: x}\namends: {title: O}\ntags: [q]\n" + PARTIES, BODY.split("\n", 2)[2])))
    back = readers.from_json_documents(to_dicts(parsed))
    a, b = parsed.select("metadata", "sections").first(), back.select("metadata", "sections").first()
    assert a.metadata == b.metadata and a.sections == b.sections


def test_starter(spark):
    (row,) = serialize(readers.starter(spark)).collect()
    assert row.serialized.startswith("---\ntitle: Untitled Agreement\nsides:\n- name: providers\n  label: Providers\n")
    assert '"Services" {{def: services}} means the services described in this agreement.' in row.serialized
    (text,) = serialize(readers.from_dicts(spark, [("d", {"sections": [{"level": 9, "blocks": [{"kind": "table", "headers": ["", "B"], "rows": [["1", "2", "3"], ["", ""]]}, {"kind": "odd", "text": " t "}, {"kind": "definition", "definition_id": "fee-note"}]}]})])).select("serialized").first()
    assert text == "---\ntitle: ''\nlanguage: en\n---\n\n###### New Section\n\n| B |\n| --- |\n| 1 |\n\nt\n\n\"Fee Note\" {{def: fee-note}}\n"


def test_report(spark):
    found = report.diagnostics(engine.check(rows(spark, BASE + "{{money: 1}} {{ref: no}} {{money: 2}}", BASE + "Fine.")))
    lines = [r.line for r in report.text_lines(report.report(found)).collect()]
    assert lines == ["0.lgd: error: [ref-broken] Broken section reference: 'no'."] + ["0.lgd: warning: [money-missing-currency] Money directive without currency parameter."] * 2
    assert report.counts(report.promote(report.ignore(found, ["ref-broken"]))).first().asDict() == {"error": 2, "warning": 0, "info": 0}
    assert {r.rule for r in report.rules(found, "warning").collect()} == {"money-missing-currency"}
    valid = {r.doc_id: (r.is_valid, len(r.warnings)) for r in report.validity(engine.check(rows(spark, BASE + "{{money: 1}}", BASE + "{{ref: no}}"))).collect()}
    assert valid == {"0.lgd": (True, 1), "1.lgd": (False, 0)}
    assert json.loads(report.json_lines(found.where("rule = 'ref-broken'")).first().line)["level"] == "error"


def test_views(spark):
    checked = engine.check(rows(spark, BASE + '"A" {{def: a}} {{term: a}} {{date: 2026-01-01}} {{money: 5, currency=EUR}} `{{term: hidden}}` {{ref: terms}}\n\n- i {#item}'))
    views.register(checked, "v_")
    assert [tuple(r) for r in spark.sql("SELECT id, term, inline FROM v_definitions").collect()] == [("a", "A", False)]
    assert [tuple(r) for r in spark.sql("SELECT amount, currency FROM v_money").collect()] == [("5", "EUR")]
    assert {(r.key, r.section) for r in views.section_keys(checked).collect()} == {("terms", 0), ("item", 0)}
    assert {(r.kind, r.target) for r in views.source_directives(checked).collect()} == {("ref", "terms"), ("term", "a"), ("term", "hidden")}
    assert {(r.kind, r.id, r.term) for r in views.lookups(checked).collect()} == {("side", "providers", "Providers"), ("side", "clients", "Clients"), ("party", "acme", "Acme Corporation"), ("party", "beta", "Beta Industries Inc.")}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("docs")
    (top / "deep").mkdir()
    (top / "ok.lgd").write_text(BASE + "Fine.")
    (top / "deep" / "bad one.legal.md").write_bytes((BASE + "{{ref: no}} {{money: 1}}").replace("\n", "\r\n").encode())
    (top / "yaml.legaldown").write_text("---\ntitle: [unclosed\n---\n")
    (top / "other.txt").write_text(BASE + "{{nope: x}}")
    return top


@pytest.mark.parametrize(
    ("options", "code", "rules"),
    [
        (["deep"], 1, ["ref-broken", "money-missing-currency"]),
        (["deep", "--ignore", "ref-broken"], 0, ["money-missing-currency"]),
        (["deep", "--ignore", "ref-broken", "--strict"], 1, ["money-missing-currency"]),
        (["deep", "--ignore", "ref-broken", "--warnings-as-errors"], 1, ["money-missing-currency"]),
        (["ok.lgd"], 0, []),
        (["other.txt"], 1, ["directive-unknown"]),
        (["yaml.legaldown"], 1, ["frontmatter-invalid-yaml"]),
        (["ok.lgd", "missing.lgd"], 2, []),
    ],
)
def test_command_line(spark, folder, capsys, options, code, rules):
    paths = [str(folder / o) if (folder / o).exists() or o.startswith("missing") else o for o in options]
    args = cli.parser().parse_args(["validate", "--format", "json", *paths])
    assert cli.validate(spark, args) == code
    out = json.loads(capsys.readouterr().out)
    assert [d["rule"] for d in out["diagnostics"]] == rules and set(out) == {"legaldown_spec", "validator_version", "diagnostics"}


def test_command_line_text(spark, folder, capsys):
    args = cli.parser().parse_args(["validate", str(folder)])
    assert cli.validate(spark, args) == 1
    out, err = capsys.readouterr()
    assert "bad one.legal.md: error: [ref-broken] Broken section reference: 'no'." in out and "other.txt" not in out
    assert "2 error(s), 1 warning(s), 0 info(s)" in err


def test_stream(spark, folder, tmp_path):
    found = diagnostics_stream(read_stream(spark, str(folder)))
    query = found.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.rule for r in spark.sql("SELECT rule FROM found").collect()} == {"ref-broken", "money-missing-currency", "frontmatter-invalid-yaml"}


def test_validation_is_no_power_of_the_size(spark):
    """5,000 sections, each with a definition, a reference and a term, in one row."""
    part = "## Part {#p%d}\n\n\"Term %d\" {{def: t%d}} is {{money: %d, currency=USD}}.\n\nSee {{ref: p%d}} and {{term: t%d}}.\n"
    source = BASE + "\n".join(part % (i, i, i, i, max(i - 1, 0), i) for i in range(5_000)) + "\n\nSee {{ref: gone}}."
    engine.check(rows(spark, BASE)).select("diagnostics").collect()  # plans are built before the clock starts
    began = time.time()
    (row,) = engine.check(rows(spark, source)).select("diagnostics", F.size("section_index").alias("n"), F.size("definition_lookup").alias("terms")).collect()
    assert [d.message for d in row.diagnostics] == ["Broken section reference: 'gone'."] and (row.n, row.terms) == (5_001, 5_000)
    assert time.time() - began < 30
