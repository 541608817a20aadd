"""Queries over the documents of ``sources.cases`` and over texts made from customers, with what they must give.

Expected rows are written out by hand with ``@K`` for the key; the SQL joins them to
the tables' keys. Names begin with the ids of the coverage checklist.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewood import engine
from clausewood.functions import patterns as P
from clausewood.functions import scalars as S
from clausewood.operators.serialize import render_block, serialize, to_dicts
from clausewood.plans import report, views
from clausewood.plans.kept import kept
from clausewood.plans.validate import matches, validate
from clausewood.sources import readers
from clausewood.sources.cases import CASES, KEY, NUMBERS, PLACES, documents

Query = Callable[[SparkSession, str], DataFrame]
Value = str | int | bool | None

#: Checklist number of each rule that only these documents show.
RULES = {
    1: "title-missing", 2: "document-type-invalid", 3: "field-type-key-format", 4: "field-type-key-reserved", 6: "side-party-name-format", 7: "side-name-duplicate",
    8: "party-name-duplicate", 10: "date-of-birth-invalid", 11: "representative-name-empty", 12: "sides-absent", 13: "sides-minimum", 14: "parties-minimum",
    15: "issuer-side-required", 16: "anchor-format", 17: "attachment-id-duplicate", 18: "attachment-title-empty", 19: "attachment-file-missing", 20: "amends-title-empty",
    21: "heading-depth", 26: "attachment-id-collision", 27: "def-autogen-collision", 28: "def-duplicate-id", 29: "def-emphasis", 30: "def-no-quoted-span",
    31: "def-single-quote-ambiguous", 33: "placeholder-in-structural-field", 34: "placeholder-id-malformed", 35: "placeholder-type-invalid", 37: "placeholder-unknown-currency",
    39: "date-invalid", 40: "money-invalid-amount", 41: "money-unknown-currency", 43: "duration-invalid-value", 45: "party-name-malformed", 47: "side-name-malformed",
    48: "side-unknown", 50: "field-type-undeclared", 51: "attach-undeclared", 52: "note-invalid", 53: "ref-targets-attachment", 56: "amend-term-unresolvable",
}

# ---------------------------------------------------------------- SQL pieces


def literal(value: Value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def filled(rows: list[tuple[Value, ...]], columns: str, key: str) -> str:
    """SELECT list of the columns of VALUES rows, texts with the key filled in."""
    out = []
    for name, value in zip(columns.split(), rows[0], strict=True):
        own = f'"{name}"'
        out.append(f"replace({own}, '{KEY}', {key}::VARCHAR) AS {own}" if isinstance(value, str) else f"{own}::INT AS {own}" if isinstance(value, int) and not isinstance(value, bool) else own)
    return ", ".join(out)


def values(rows: list[tuple[Value, ...]], columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ") v(" + ", ".join(f'"{c}"' for c in columns.split()) + ")"


def of_cases(rows: list[tuple[Value, ...]], columns: str) -> str:
    """SQL of rows (case, values...): one for every order of the case."""
    placed = [(NUMBERS[str(r[0])], *r[1:]) for r in rows]
    return f"SELECT o_orderkey AS doc_id, {filled([r[1:] for r in rows], columns, 'o_orderkey')} FROM orders JOIN {values(placed, f'place {columns}')} ON o_orderkey % {PLACES} = place"


def of_customers(rows: list[tuple[Value, ...]], columns: str) -> str:
    return f"SELECT c_custkey, {filled(rows, columns, 'c_custkey')} FROM customer CROSS JOIN {values(rows, columns)}"


FOUND = [(name, pos, *d) for name, case in CASES.items() for pos, d in enumerate(case.found)]
FOUND_SQL = of_cases(FOUND, "seq rule level message")

# ---------------------------------------------------------------- sources of the queries


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "parsed cases", lambda: engine.parse(documents(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "validated cases", lambda: validate(parsed(spark, sf_dir)))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.diagnostics(validated(spark, sf_dir))


def case_is(*names: str) -> Column:
    return F.pmod("doc_id", F.lit(PLACES)).isin(*[NUMBERS[n] for n in names])


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, section, pos, fields of the block) of the parsed cases."""
    sections = parsed(spark, sf_dir).select("doc_id", F.posexplode("sections").alias("section", "s"))
    return sections.select("doc_id", "section", F.posexplode("s.blocks").alias("pos", "b")).select("doc_id", "section", "pos", "b.*")


QUERIES: dict[str, tuple[Query, str]] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Registers a query and its SQL."""

    def put(q: Query) -> Query:
        QUERIES[name] = (q, sql)
        return q

    return put


def rule_query(rule: str) -> Query:
    return lambda spark, sf_dir: found(spark, sf_dir).where(F.col("rule") == rule).select("doc_id", "rule", "level", "message")


for _number, _rule in RULES.items():
    QUERIES[f"r{_number:02d}_{_rule.replace('-', '_')}"] = (rule_query(_rule), of_cases([(r[0], *r[2:]) for r in FOUND if r[2] == _rule], "rule level message"))

# ---------------------------------------------------------------- reports


@query("g3_diagnostics_in_order", FOUND_SQL)
def diagnostics_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("doc_id", "seq", "rule", "level", "message")


@query("k1_text_report", f"SELECT 'cases/' || doc_id || '.lgd: ' || level || ': [' || rule || '] ' || message AS line FROM ({FOUND_SQL})")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.text_lines(found(spark, sf_dir))


@query("k2_json_report", f"""SELECT '{{"file":"cases/' || doc_id || '.lgd","rule":"' || rule || '","level":"' || level || '","message":"' || message || '"}}' AS line FROM ({FOUND_SQL})""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_lines(found(spark, sf_dir))


@query("g5_exit_codes", "VALUES ('clean', 0, 0), ('warnings', 0, 1), ('errors', 1, 1), ('unreadable', 2, 2)".replace("VALUES", "SELECT * FROM (VALUES") + ") v(documents, code, strict)")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, cases, failures in (("clean", ("clean", "kinds"), 0), ("warnings", ("no sides", "emphasis"), 0), ("errors", ("date",), 0), ("unreadable", ("date",), 1)):
        totals = report.counts(found(spark, sf_dir).where(case_is(*cases))).first().asDict()
        rows.append((name, report.exit_code(failures, totals), report.exit_code(failures, totals, strict=True)))
    return spark.createDataFrame(rows, "documents string, code int, strict int")


@query("g6_rules_by_level", f"SELECT DISTINCT doc_id, rule FROM ({FOUND_SQL}) WHERE level = 'warning'")
def rules_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rules(found(spark, sf_dir), "warning")


@query("g8_message_lists", f"SELECT o_orderkey AS doc_id, {', '.join(f"""coalesce(string_agg(message, '|' ORDER BY seq) FILTER (level = '{x}'), '') AS {x}s""" for x in ('error', 'warning', 'info'))} FROM orders LEFT JOIN ({FOUND_SQL}) ON doc_id = o_orderkey GROUP BY o_orderkey")
def message_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.validity(validated(spark, sf_dir)).select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("errors", "warnings", "infos")])


# ---------------------------------------------------------------- parsing

SECTIONS = [
    ("bad section id", 1, "Other", 2, "Bad_@K"), ("depth", 1, "Deep", 6, "deep"), ("skip", 1, "Sub", 3, "sub"), ("skip", 2, "2.1 Next", 2, "next"),
    ("numbers", 1, "Scope", 2, "scope"), ("numbers", 2, "Part @K", 3, "part"), ("numbers", 3, "Scope", 2, "scope"), ("numbers", 4, "Scope", 1, "scope"), ("lists", 1, "Part", 2, "part"),
]
ALL_SECTIONS = f"SELECT o_orderkey AS doc_id, 0::INT AS pos, 'Terms' AS title, 1::INT AS level, 'terms' AS identifier FROM orders UNION ALL {of_cases(SECTIONS, 'pos title level identifier')}"


def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("doc_id", F.posexplode("sections").alias("pos", "s")).select("doc_id", "pos", "s.title", "s.level", "s.identifier")


@query("p1_split_frontmatter", f"""SELECT o_orderkey AS doc_id, o_orderkey % {PLACES} = {NUMBERS['numbers']} AS deep, '# Terms {{#terms}}' || chr(10) AS start FROM orders""")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewood.operators.frontmatter import split_frontmatter

    _, body = split_frontmatter(F.col("source"))
    return documents(spark, sf_dir).select("doc_id", body.contains("### Part").alias("deep"), F.substring(body, 1, 17).alias("start"))


@query("p3_sections", f"SELECT doc_id, pos, title, level FROM ({ALL_SECTIONS})")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_rows(spark, sf_dir).drop("identifier")


@query("p4_default_ids", f"SELECT doc_id, pos, identifier FROM ({ALL_SECTIONS})")
def default_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_rows(spark, sf_dir).select("doc_id", "pos", "identifier")


@query("p5_signature_cut_off", f"SELECT doc_id, count(*) AS sections FROM ({ALL_SECTIONS}) WHERE doc_id % {PLACES} = {NUMBERS['signature']} GROUP BY doc_id")
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_rows(spark, sf_dir).where(case_is("signature")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))


KINDS_IN_ORDER = ("definition", "unordered_list", "ordered_list", "quote", "table", "rule", "ref", "term")


@query("p6_kinds_in_order", of_cases([("kinds", i, k) for i, k in enumerate(KINDS_IN_ORDER)] + [("lists", 0, "ref"), ("lists", 1, "unordered_list"), ("lists", 2, "ordered_list")], "pos kind"))
def kinds_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).where(case_is("kinds", "lists")).select("doc_id", "pos", "kind")


ITEMS = [
    ("kinds", 1, 0, "one {{term: alpha}} more"), ("kinds", 1, 1, "two"), ("kinds", 2, 0, "first"), ("kinds", 2, 1, "second"), ("bad anchor", 0, 0, "Item {#Bad@K}"), ("anchor twice", 0, 0, "Item {#x-@K}"),
    ("anchor twice", 0, 1, "Other {#terms}"), ("lists", 1, 0, "One two {#item}"), ("lists", 1, 1, "three"), ("lists", 2, 0, "a"), ("lists", 2, 1, "b"),
]


@query("p7_list_items", of_cases(ITEMS, "block at item"))
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).where(F.col("kind").endswith("list")).select("doc_id", F.col("pos").alias("block"), F.posexplode("items").alias("at", "item"))


@query("p8_tables", of_cases([("kinds", "A|B", "@K|x;|y")], "headers cells"))
def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")
    return blocks(spark, sf_dir).where("kind = 'table'").select("doc_id", F.array_join("headers", "|").alias("headers"), cells.alias("cells"))


PARAGRAPHS = [
    ("kinds", "definition", "alpha", "Alpha", "", "", "", "", "", "is @K."), ("kinds", "ref", "", "", "See ", "terms", "full", "", " there.", ""), ("kinds", "term", "", "", "Use ", "alpha", "", "Al", " now.", ""),
    ("lists", "ref", "", "", "", "item", "", "", " {{ref: terms.part}}", ""),
]


@query("p9_paragraphs", of_cases(PARAGRAPHS, "kind definition_id term prefix target format label suffix text"))
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blocks(spark, sf_dir).where(case_is("kinds", "lists") & F.col("kind").isin("definition", "ref", "term"))
    return own.select("doc_id", "kind", "definition_id", "term", "prefix", "target", "format", "label", "suffix", "text")


@query("p10_typed_documents", f"SELECT o_orderkey AS doc_id, o_orderkey || '.lgd' AS filename, CASE o_orderkey % {PLACES} WHEN {NUMBERS['no sides']} THEN 0 WHEN {NUMBERS['one side']} THEN 1 WHEN {NUMBERS['act without party']} THEN 1 ELSE 2 END::INT AS sides FROM orders")
def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("doc_id", "filename", F.size("metadata.sides").alias("sides"))


@query("f13_coercions", of_cases([("metadata", "Case @K", "1.1", "2024-01-31", "en", False, "b|a|c", "rate=x", "7", "providers:acme:Ann;clients:beta:")], "title version effective_date language include_signatures tags field_types governing_law parties"))
def coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metadata")
    people = F.transform(m["sides"], lambda s: F.concat(s["name"], F.lit(":"), s["parties"][0]["name"], F.lit(":"), F.array_join(F.transform(s["parties"][0]["representatives"], lambda r: r["name"]), ",")))
    return parsed(spark, sf_dir).where(case_is("metadata")).select(
        "doc_id", "metadata.title", "metadata.version", "metadata.effective_date", "metadata.language", "metadata.include_signatures", F.array_join(m["tags"], "|").alias("tags"),
        F.array_join(F.transform(m["field_types"], lambda f: F.concat(f["key"], F.lit("="), f["value"])), "|").alias("field_types"), "metadata.governing_law", F.array_join(people, ";").alias("parties"),
    )


# ---------------------------------------------------------------- indices

NUMBERED = [("numbers", 0, "terms", "terms", "1"), ("numbers", 1, "scope", "terms.scope", "1.1"), ("numbers", 2, "part", "terms.scope.part", "1.1.1"), ("numbers", 3, "scope-2", "terms.scope-2", "1.2"), ("numbers", 4, "scope-3", "scope-3", "2")]


def numbered(*columns: str) -> Query:
    return lambda spark, sf_dir: views.sections(validated(spark, sf_dir)).where(case_is("numbers")).select("doc_id", "pos", *columns)


QUERIES["f2_unique_identifiers"] = (numbered("identifier", "path"), of_cases([r[:4] for r in NUMBERED], "pos identifier path"))
QUERIES["f3_section_numbers"] = (numbered("number"), of_cases([(*r[:2], r[4]) for r in NUMBERED], "pos number"))


@query("i7_definition_terms", of_cases([("kinds", "alpha", "Alpha"), ("same slug", "fee-note", "Fee Note"), ("same id", "x@K", "Alpha"), ("emphasis", "services", "Services"), ("single quotes", "services", "Services @K"), ("inline definition", "goods", "Goods"), ("inline definition", "fees", "Fees @K")], "id term"))
def definition_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.definition_lookup(validated(spark, sf_dir)).select("doc_id", "id", "term")


@query("i12_placeholders", of_cases([("placeholders", "Bad@K", "text", ""), ("placeholders", "a", "x@K", ""), ("placeholders", "b", "money", "ZZZ"), ("placeholders", "c", "text", ""), ("placeholders", "c", "date", "")], "id type currency"))
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.exploded(validated(spark, sf_dir), "placeholders").select("doc_id", "id", "type", "currency")


@query("i11_fields", of_cases([("fields", 0, "@K", "bar"), ("fields", 1, "1", "foo"), ("fields", 2, "2", ""), ("fields", 3, "3", "BAD")], "pos value type"))
def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.exploded(validated(spark, sf_dir), "fields")


TERMS = "array<struct<id:string,term:string>>"


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case ``amended term`` beside an original, the case ``attachment title`` beside an attachment, and ``same id`` beside both."""

    def make() -> DataFrame:
        docs = parsed(spark, sf_dir).where(case_is("amended term", "attachment undeclared", "same id"))
        key = F.col("doc_id").cast("string")
        amends = F.struct(F.lit("O").alias("title"), F.lit("o.lgd").alias("file"))
        schedule = F.array(F.struct(F.concat(F.lit("s-"), key).alias("id"), F.lit("S").alias("title"), F.concat(F.lit("s"), key, F.lit(".lgd")).alias("file")))
        docs = docs.withColumn("metadata", F.col("metadata").withField("amends", amends).withField("attachments", schedule))
        term = lambda i, t: F.struct(i.alias("id"), F.lit(t).alias("term"))
        original = docs.select(F.lit("o.lgd").alias("amends_file"), F.col("filename").alias("current_filename"), F.lit(True).alias("consulted"), F.array(term(F.concat(F.lit("x"), key), "Old"), term(F.lit("fee"), "Fee")).cast(TERMS).alias("definitions"))
        schedules = docs.select(F.concat(F.lit("s"), key, F.lit(".lgd")).alias("file"), F.array(term(F.lit("fee"), "Other"), term(F.lit("rate"), "Rate")).cast(TERMS).alias("definitions"))
        return validate(docs, original, schedules)

    return kept(spark, sf_dir, "imports", make)


def import_rule(rule: str) -> Query:
    return lambda spark, sf_dir: report.diagnostics(imported(spark, sf_dir)).where(F.col("rule") == rule).select("doc_id", "rule", "level", "message")


BESIDE = ("amended term", "attachment undeclared", "same id")
QUERIES["r32_amend_def_override"] = (import_rule("amend-def-override"), of_cases([("same id", "amend-def-override", "warning", "Amendment redefines 'x@K' which exists in the original document.")], "rule level message"))
QUERIES["r55_amend_term_undefined"] = (import_rule("amend-term-undefined"), of_cases([("amended term", "amend-term-undefined", "error", "Undefined term reference: 'gone-@K' (not found in amendment or imported original).")], "rule level message"))
QUERIES["u2_attachment_definitions"] = (
    import_rule("def-duplicate-id"),
    of_cases([*[(c, "def-duplicate-id", "error", "Definition id 'fee' from attachment 's-@K' collides with a definition in the main document (ids must be unique, §15.10).") for c in BESIDE], ("same id", "def-duplicate-id", "error", "Definition identifier 'x@K' is duplicated.")], "rule level message"),
)
IMPORTED = [(c, i, t) for c in BESIDE for i, t in ((("x@K", "Alpha"),) if c == "same id" else (("x@K", "Old"),)) + (("fee", "Fee"), ("rate", "Rate"))]


@query("i9_amended_definitions", of_cases([r for r in IMPORTED if r[1] != "rate"], "id term"))
def amended_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.definition_lookup(imported(spark, sf_dir)).where("id != 'rate'").select("doc_id", "id", "term")


@query("i10_attached_definitions", of_cases([r for r in IMPORTED if r[1] == "rate"], "id term"))
def attached_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.definition_lookup(imported(spark, sf_dir)).where("id = 'rate'").select("doc_id", "id", "term")


# ---------------------------------------------------------------- serializing

KINDS_HEAD = """---
title: Case @K
sides:
- name: providers
  parties:
  - name: acme
    type: legal_entity
    legal_name: Acme Corporation
- name: clients
  parties:
  - name: beta
    type: natural_person
    legal_name: Beta Brown
language: en
---
"""
KINDS_TEXT = (
    '"Alpha" {{def: alpha}} is @K.', "- one {{term: alpha}} more\n- two", "1. first\n2. second", "> quote\n>\n> end", "| A | B |\n| --- | --- |\n| @K | x |\n|  | y |",
    "---", "See {{ref: terms, format=full}} there.", "Use {{term: alpha, label=Al}} now.",
)
METADATA_TEXT = """---
title: Case @K
subtitle: Sub
version: '1.1'
effective_date: '2024-01-31'
field_types:
  rate: x
sides:
- name: providers
  label: The Providers
  parties:
  - name: acme
    type: legal_entity
    legal_name: Acme
    representatives:
    - name: Ann
      title: CEO
    Reg: '5'
- name: clients
  parties:
  - name: beta
    type: natural_person
    date_of_birth: '1990-01-01'
governing_law: '7'
language: en
translations:
  fr: f.lgd
attachments:
- id: s
  title: S
  file: s.pdf
tags:
- b
- a
- c
---

# Terms {#terms}

See {{attach: s}}.
"""


def serialized(*cases: str) -> Query:
    return lambda spark, sf_dir: serialize(parsed(spark, sf_dir).where(case_is(*cases))).select("doc_id", "serialized")


WHOLE = KINDS_HEAD + "\n# Terms {#terms}\n\n" + "\n\n".join(KINDS_TEXT) + "\n"
QUERIES["k3_serialized_text"] = (serialized("kinds", "metadata"), of_cases([("kinds", WHOLE), ("metadata", METADATA_TEXT)], "serialized"))


@query("z1_frontmatter_text", of_cases([("metadata", METADATA_TEXT.split("\n\n")[0])], "head"))
def frontmatter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serialized("metadata")(spark, sf_dir).select("doc_id", F.substring_index("serialized", "\n\n", 1).alias("head"))


@query("z2_pruned_fields", of_cases([("kinds", False, False, True), ("metadata", False, True, False)], "writes_signatures writes_birth is_short"))
def pruned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("serialized")
    return serialized("kinds", "metadata")(spark, sf_dir).select("doc_id", text.contains("include_signatures").alias("writes_signatures"), text.contains("date_of_birth").alias("writes_birth"), (~text.contains("subtitle:")).alias("is_short"))


@query("z3_lossy_spots", of_cases([("attachment without id", 0), ("attachment title", 0), ("attachment file", 0), ("attachment twice", 2)], "attachments"))
def lossy_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = serialized("attachment without id", "attachment title", "attachment file", "attachment twice")(spark, sf_dir)
    return text.select("doc_id", F.size(F.regexp_extract_all("serialized", F.lit("(?m)^- id:"), F.lit(0))).alias("attachments"))


@query("k5_rendered_blocks", of_cases([("kinds", i, t) for i, t in enumerate(KINDS_TEXT)], "pos text"))
def rendered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = parsed(spark, sf_dir).where(case_is("kinds")).select("doc_id", F.posexplode(F.transform(F.col("sections")[0]["blocks"], render_block)).alias("pos", "text"))
    return own


@query("z5_assembled_lines", of_cases([("kinds", len(WHOLE.split("\n")) - 1)], "lines"))
def assembled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serialized("kinds")(spark, sf_dir).select("doc_id", (F.size(F.split("serialized", "\n")) - 1).alias("lines"))


@query("k4_documents_as_json", of_cases([("metadata", "Case @K", '{"rate":"x"}', "providers", "Ann", "terms", "See {{attach: s}}.")], "title field_types side person section text"))
def documents_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda path: F.get_json_object("document", path)
    paths = {"title": "$.metadata.title", "field_types": "$.metadata.field_types", "side": "$.metadata.sides[0].name", "person": "$.metadata.sides[0].parties[0].representatives[0].name", "section": "$.sections[0].identifier", "text": "$.sections[0].blocks[0].text"}
    return to_dicts(parsed(spark, sf_dir).where(case_is("metadata"))).select("doc_id", *[at(p).alias(n) for n, p in paths.items()])


# ---------------------------------------------------------------- sources


def nation_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a document per nation, below a folder per region, and files of other kinds; a fixture of 25 names."""
    top = Path(tempfile.mkdtemp(prefix="clausewood-files-"))
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect():
        folder = top / str(r.n_regionkey)
        folder.mkdir(exist_ok=True)
        text = f"---\r\ntitle: Nation {r.n_nationkey}\r\n---\r\n\r\n# Terms\r\n"
        (folder / f"n {r.n_nationkey}{P.MARKUP_EXTENSIONS[r.n_nationkey % 3]}").write_bytes(text.encode())
        (folder / f"{r.n_nationkey}.txt").write_text("---\ntitle: Other\n---\n")
    return str(top)


def titles(rows: DataFrame) -> DataFrame:
    return engine.parse(rows).select("filename", F.col("metadata.title").alias("title"), F.size("sections").alias("sections"))


NATIONS = "SELECT 'n ' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '.lgd' WHEN 1 THEN '.legaldown' ELSE '.legal.md' END AS filename, 'Nation ' || n_nationkey AS title, 1::INT AS sections FROM nation"


@query("s1_named_files", "SELECT n_nationkey || '.txt' AS filename, 'Other' AS title, 0::INT AS sections FROM nation")
def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(readers.read_files(spark, sorted(map(str, Path(nation_files(spark, sf_dir)).rglob("*.txt")))))


@query("s2_directory_scan", NATIONS)
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(readers.read_directory(spark, nation_files(spark, sf_dir)))


@query("s3_rows_in_memory", "SELECT r_regionkey || '.lgd' AS filename, r_name AS title, 1::INT AS sections FROM region")
def rows_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").collect()  # five rows
    return titles(readers.from_rows(spark, [(f"{r.r_regionkey}.lgd", f"---\ntitle: {r.r_name}\n---\n# A\n") for r in regions]))


def customer_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsed document per customer from JSON, with two sections of one title and no identifiers."""
    section = {"title": "Scope @K", "level": 1, "blocks": [{"kind": "paragraph", "text": " t "}, {"kind": "unordered_list"}]}
    text = json.dumps({"filename": "c@K.lgd", "metadata": {"title": 5, "tags": "a, b", "field_types": {"x": "1"}}, "sections": [section, section, {"level": "9", "blocks": None}]})
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey").cast("string")
    return readers.from_json_documents(customer.select(F.col("c_custkey").alias("doc_id"), key.alias("file"), F.replace(F.lit(text), F.lit(KEY), key).alias("document")))


@query("s4_json_documents", "SELECT c_custkey AS doc_id, 'c' || c_custkey || '.lgd' AS filename, '5' AS title, 'a|b' AS tags, 'en' AS language, 'Scope ' || c_custkey || ':1|Scope ' || c_custkey || ':1|New Section:6' AS sections, 't' AS text FROM customer")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array_join(F.transform("sections", lambda s: F.concat(s["title"], F.lit(":"), s["level"].cast("string"))), "|")
    return customer_dictionaries(spark, sf_dir).select("doc_id", "filename", "metadata.title", F.array_join("metadata.tags", "|").alias("tags"), "metadata.language", heads.alias("sections"), F.col("sections")[0]["blocks"][0]["text"].alias("text"))


@query("r25_anchor_autogen_collision", "SELECT c_custkey AS doc_id, 'anchor-autogen-collision' AS rule, 'warning' AS level, 'Auto-generated identifier on ''Scope ' || c_custkey || ''' collides with an earlier section. It was adjusted to ''scope-' || c_custkey || '-2''.' AS message FROM customer")
def autogen_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.diagnostics(validate(customer_dictionaries(spark, sf_dir))).where("rule = 'anchor-autogen-collision'").select("doc_id", "rule", "level", "message")


@query("s5_starter_document", "SELECT 'Untitled Agreement' AS title, 'providers|clients' AS sides, 'definitions|scope-of-work' AS sections, 'Services' AS term")
def starter_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda c, field: F.array_join(F.transform(c, lambda x: x[field]), "|")
    return readers.starter(spark).select("metadata.title", names("metadata.sides", "name").alias("sides"), names("sections", "identifier").alias("sections"), F.col("sections")[0]["blocks"][0]["term"].alias("term"))


# ---------------------------------------------------------------- patterns and scalar functions over texts

#: Name: texts, a function from a text to an array, its columns, and the rows (text, place in the array, values).
Texts = tuple[list[str], Callable[[Column], Column], str, list[tuple[Value, ...]]]


def found_by(pattern: str, groups: int) -> Callable[[Column], Column]:
    return lambda t: matches(t, pattern, groups)


def single(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda t: F.array(F.struct(f(t).alias("value")))


def terms_of(t: Column) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(P.DEFINITION), F.lit(0)), lambda m: F.struct(S.definition_term(m).alias("term"), S.definition_id(m).alias("id")))


TEXTS: dict[str, Texts] = {
    "x2_terms": (["a {{term: t@K}} b {{term:u , label=L @K}} {{term: }}"], found_by(P.TERM, 2), "g1 g2", [(0, 0, "t@K", ""), (0, 1, "u", "L @K"), (0, 2, "", "")]),
    "x6_parties": (["{{party: p@K}} {{party: q, label=Q @K}} {{party: r, note=n}} {{party:}}"], found_by(P.PARTY, 2), "g1 g2", [(0, 0, "p@K", ""), (0, 1, "q", "Q @K"), (0, 2, "r", "")]),
    "x7_sides": (["{{side: s@K, label=L}}, {{side: t}}"], found_by(P.SIDE, 2), "g1 g2", [(0, 0, "s@K", "L"), (0, 1, "t", "")]),
    "x8_fields": (["{{field: @K, type=rate}} {{field: a b}}"], found_by(P.FIELD, 2), "g1 g2", [(0, 0, "@K", "rate"), (0, 1, "a b", "")]),
    "x10_attachments": (["{{attach: s@K, label=x}} and {{attach: t}}"], found_by(P.ATTACH, 1), "g1", [(0, 0, "s@K"), (0, 1, "t")]),
    "x11_notes": (["{{date: 2026-01-01, note=n @K}} {{money: 1, currency=EUR, note=a, b}}"], found_by(P.NOTE, 1), "g1", [(0, 0, "n @K"), (0, 1, "a, b")]),
    "x12_openers": (["{{abc: x}} {{X: y}} {{d@K: z}} {{ def: q}} {{def: r}}"], found_by(P.DIRECTIVE_NAME, 1), "g1", [(0, 0, "abc"), (0, 1, "def")]),
    "x13_definition_anchors": (['"Alpha @K" {{def: a@K}} and “B” {{ def:b }}, «C»{{def:}}'], lambda t: F.transform(F.regexp_extract_all(t, F.lit(P.DEFINITION), F.lit(0)), lambda m: F.struct(m.alias("value"))), "value", [(0, 0, '"Alpha @K" {{def: a@K}}'), (0, 1, "“B” {{ def:b }}"), (0, 2, "«C»{{def:}}")]),
    "x14_definition_tags": (["x {{def: a@K}} {{ def: }} {{define: x}}"], found_by(f"({P.DEFINITION_TAG})", 1), "g1", [(0, 0, "{{def: a@K}}"), (0, 1, "{{ def: }}")]),
    "x15_emphasised_definitions": (['**"A @K"** {{def: a}}', '"A" {{def: a}}', '*“B”* {{def: b}}'], single(lambda t: t.rlike(P.EMPHASISED_DEFINITION)), "value", [(0, 0, True), (1, 0, False), (2, 0, True)]),
    "x16_trailing_anchors": (["Item {#i@K}", "Item {#i} x", "Item {#j}  "], single(lambda t: F.regexp_extract(t, P.TRAILING_ANCHOR, 1)), "value", [(0, 0, "i@K"), (1, 0, ""), (2, 0, "j")]),
    "x17_hardcoded_numbers": (["@K. Scope", "Article IV Scope", "Scope @K", "1.2.3 x"], single(lambda t: t.rlike(P.HARDCODED_NUMBER)), "value", [(0, 0, True), (1, 0, True), (2, 0, False), (3, 0, True)]),
    "x18_identifiers": (["a-@K", "A@K", "@Ka", "a_b", ""], single(S.is_identifier), "value", [(0, 0, True), (1, 0, False), (2, 0, False), (3, 0, False), (4, 0, False)]),
    "f5_numeric": (["@K", "@K.5", "-1e3", "inf", "nan", "x@K", ""], single(S.is_numeric), "value", [(0, 0, True), (1, 0, True), (2, 0, True), (3, 0, False), (4, 0, False), (5, 0, False), (6, 0, False)]),
    "f8_masked_texts": (["a `{{x: @K}}` b", "a <!-- {{x: @K}} --> b", "a <!-- x\n@K --> b", "```\n{{x: @K}}\n``` c", "~~~ a\n@K\n~~~", "``a`@K`` c", "plain @K"], single(S.mask_literals), "value", [(0, 0, "a   b"), (1, 0, "a   b"), (2, 0, "a \n b"), (3, 0, "\n c"), (4, 0, "\n"), (5, 0, "  c"), (6, 0, "plain @K")]),
    "f9_placeholder_values": (["{{placeholder: p@K}}", "a {{placeholder:x}}", "{{placeholders: x}}", "@K"], single(S.is_placeholder), "value", [(0, 0, True), (1, 0, True), (2, 0, False), (3, 0, False)]),
    "f12_extracted_definitions": (['The "Alpha @K" {{def: a@K}} and ‘B’ {{def: }}.'], terms_of, "term id", [(0, 0, "Alpha @K", "a@K"), (0, 1, "B", "")]),
}


def text_query(texts: list[str], f: Callable[[Column], Column], columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
        templates = spark.createDataFrame(list(enumerate(texts)), "text int, template string")
        rows = customer.join(F.broadcast(templates))  # a fixed handful of texts
        filled_in = rows.withColumn("source", F.replace("template", F.lit(KEY), F.col("c_custkey").cast("string")))
        return filled_in.select("c_custkey", "text", F.posexplode(f(F.col("source"))).alias("pos", "x")).select("c_custkey", "text", "pos", *[F.col(f"x.{c}").alias(c) for c in columns.split()])

    return run


for _name, (_texts, _f, _columns, _rows) in TEXTS.items():
    QUERIES[_name] = (text_query(_texts, _f, _columns), of_customers(_rows, f"text pos {_columns}"))

# The pairs of quotation marks.
MARKS = [('"', '"', "straight-double", False), ("“", "”", "curly-double", False), ("«", "»", "guillemets", False), ("»", "«", "reversed-guillemets", False), ("„", "“", "low-high-double", False), ("‘", "’", "curly-single", True), ("‚", "‘", "low-high-single", True), ("‹", "›", "single-guillemets", True)]


@query("f11_accepted_quotes", f"SELECT '' AS language, * FROM {values(MARKS, 'opening closing name single')} UNION ALL SELECT 'DE' AS language, * FROM {values([m for m in MARKS if m[2] in ('guillemets', 'low-high-double')], 'opening closing name single')}")
def accepted_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(language, *q) for language in ("", "DE") for q in S.accepted_quotes({"de": ["low-high-double", "guillemets"]}, language)]
    return spark.createDataFrame(rows, "language string, opening string, closing string, name string, single boolean")


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
