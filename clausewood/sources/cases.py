"""Documents of one case each, made from orders: an order's key modulo a prime names the case.

Each case is a document and the diagnostics it must give, written out by hand; ``@K``
stands for the order's key in both. So the whole path runs over as many documents as
there are orders, and what it must report follows from their keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "@K"
PARTIES = """sides:
  - name: providers
    parties:
      - name: acme
        type: legal_entity
        legal_name: Acme Corporation
  - name: clients
    parties:
      - {name: beta, type: natural_person, legal_name: Beta Brown}
"""
TITLE = "title: Case @K\n"
TWICE = "[{id: s, title: S, file: f}, {id: s, title: S, file: f}]"
E, W, I = "error", "warning", "info"
IDENTIFIER = "Use lowercase letters, numbers, and hyphens only."
LOWER = "must be a lowercase identifier matching '^[a-z][a-z0-9-]*$'."
DAY = "must be a valid ISO 8601 date (YYYY-MM-DD)."
KINDS = """"Alpha" {{def: alpha}} is @K.

- one {{term: alpha}}
  more
- two

1. first
2. second

> quote
>
> end

| A | B |
| --- | --- |
| @K | x |
| | y |

---

See {{ref: terms, format=full}} there.

Use {{term: alpha, label=Al}} now."""
METADATA = """title: " Case @K "
subtitle: Sub
version: 1.10
effective_date: 2024-01-31
language:
include_signatures: "off"
tags: b, a,,c
field_types: {rate: x, "": y, none: null}
governing_law: 7
translations: {fr: f.lgd}
sides:
  - 1
  - name: providers
    label: The Providers
    parties:
      - x
      - {name: acme, type: legal_entity, legal_name: Acme, date_of_birth: 1990-01-01, representatives: [{name: Ann, title: CEO}, 4], custom_fields: [{label: Reg, value: 5}]}
  - name: clients
    parties: [{name: beta, type: natural_person, date_of_birth: 1990-01-01}]
attachments: [{id: s, title: S, file: s.pdf}]
"""


@dataclass(frozen=True)
class Case:
    body: str = "Plain text."
    front: str = TITLE + PARTIES
    #: (rule, level, message) in the order of report.
    found: tuple[tuple[str, str, str], ...] = ()


def one(body: str, rule: str, level: str, message: str, *more: tuple[str, str, str], front: str = TITLE + PARTIES) -> Case:
    return Case(body, front, ((rule, level, message), *more))


def attached(items: str, body: str, *found: tuple[str, str, str]) -> Case:
    return Case(body, f"{TITLE}attachments: {items}\n{PARTIES}", found)


UNUSED = lambda i: ("attachment-unreferenced", W, f"Attachment '{i}' is declared but never referenced via {{{{attach:}}}}.")
UNREAD = lambda i: ("def-unreferenced", W, f"Definition '{i}' is declared but never referenced via {{{{term:}}}}.")
SKIP = lambda title, a, b: ("heading-skip", E, f"Heading levels must not skip. '{title}' jumps from level {a} to {b}.")

CASES: dict[str, Case] = {
    "clean": Case(),
    "kinds": Case(KINDS),
    "metadata": Case("See {{attach: s}}.", METADATA),
    "no title": one("Text.", "title-missing", E, "The document title is required.", front="title: ' '\n" + PARTIES),
    "type": one("Text.", "document-type-invalid", E, "Invalid document_type 'nda-@K'. Must be one of: contract, unilateral_act, collective_act.", front=TITLE + "document_type: nda-@K\n" + PARTIES),
    "field keys": Case("Text.", TITLE + "field_types: {Bad@K: x, date: y, fine: z}\n" + PARTIES, (
        ("field-type-key-format", E, "field_types key 'Bad@K' must match [a-z][a-z0-9-]*."),
        ("field-type-key-reserved", E, "field_types key 'date' collides with a reserved value-type name (date, money, duration, party, text)."),
    )),
    "dates": Case("Text.", TITLE + "effective_date: 2026-13-01\nadoption_date: x@K\n" + PARTIES, (
        ("metadata-date-invalid", E, f"effective_date '2026-13-01' {DAY}"), ("metadata-date-invalid", E, f"adoption_date 'x@K' {DAY}"),
    )),
    "party name": one("Text.", "side-party-name-format", E, f"Party name 'Acme @K' {LOWER}", front=TITLE + PARTIES.replace("name: acme", "name: Acme @K")),
    "side name": one("Text.", "side-party-name-format", E, f"Side name 'Clients@K' {LOWER}", front=TITLE + PARTIES.replace("clients", "Clients@K")),
    "side twice": one("Text.", "side-name-duplicate", E, "Duplicate side name 'providers'.", front=TITLE + PARTIES.replace("clients", "providers")),
    "party twice": one("Text.", "party-name-duplicate", E, "Duplicate party name 'acme'.", front=TITLE + PARTIES.replace("beta", "acme")),
    "party type": one("Text.", "party-type-invalid", E, "Party 'beta' has invalid type 'firm@K'. Must be 'legal_entity' or 'natural_person'.", front=TITLE + PARTIES.replace("natural_person", "firm@K")),
    "birth": one("Text.", "date-of-birth-invalid", E, f"Party 'beta' date_of_birth '1990-02-30' {DAY}", front=TITLE + PARTIES.replace("natural_person", "natural_person, date_of_birth: 1990-02-30")),
    "nameless": one("Text.", "representative-name-empty", E, "A representative of party 'beta' is missing the required name.", front=TITLE + PARTIES.replace("natural_person", "natural_person, representatives: [{title: CEO}, {name: Ann}]")),
    "no sides": one("Text.", "sides-absent", W, "No sides are declared, so the document_type 'contract' side/party constraints cannot be verified.", front=TITLE),
    "one side": Case("Text.", TITLE + "sides: [{name: a, parties: [{name: p, type: legal_entity}]}]\n", (
        ("sides-minimum", E, "Contracts require at least 2 distinct sides (found 1)."), ("parties-minimum", E, "Contracts require at least 2 parties (found 1)."),
    )),
    "act without party": one("Text.", "parties-minimum", E, "Document type 'unilateral_act' requires at least 1 party.", front=TITLE + "document_type: unilateral_act\nsides: [{name: issuer}]\n"),
    "act without issuer": one("Text.", "issuer-side-required", E, "Document type 'collective_act' requires a side named 'issuer'.", front=TITLE + "document_type: collective_act\n" + PARTIES),
    "bad anchor": one("- Item {#Bad@K}", "anchor-format", E, f"Anchor '{{#Bad@K}}' is invalid. {IDENTIFIER}"),
    "bad section id": one("## Other {#Bad_@K}", "anchor-format", E, f"Identifier 'Bad_@K' on section 'Other' is invalid. {IDENTIFIER}"),
    "bad definition id": one('"Alpha" {{def: Bad_@K}} is.', "anchor-format", E, f"Definition identifier 'Bad_@K' (term 'Alpha') is invalid. {IDENTIFIER}"),
    "anchor twice": one("- Item {#x-@K}\n- Other {#terms}\n\n> Quote {#x-@K}", "anchor-duplicate", E, "Anchor '{#terms}' duplicates an existing anchor in the document.", ("anchor-duplicate", E, "Anchor '{#x-@K}' duplicates an existing anchor in the document.")),
    "attachment without id": attached("[{title: S, file: f}]", "Text.", ("anchor-format", E, "Attachment is missing required 'id'.")),
    "attachment id": attached("[{id: S@K, title: S, file: f}]", "Text.", ("anchor-format", E, "Attachment id 'S@K' must match [a-z][a-z0-9-]*."), UNUSED("S@K")),
    "attachment twice": attached(TWICE, "{{attach: s}}", ("attachment-id-duplicate", E, "Duplicate attachment id 's'.")),
    "attachment title": attached("[{id: s-@K, file: f}]", "{{attach: s-@K}}", ("attachment-title-empty", E, "Attachment 's-@K' is missing required 'title'.")),
    "attachment file": attached("[{id: s-@K, title: S}]", "{{attach: s-@K}}", ("attachment-file-missing", E, "Attachment 's-@K' is missing required 'file'.")),
    "attachment and section": attached("[{id: terms, title: S, file: f}]", "{{attach: terms}}", ("attachment-id-collision", E, "Section identifier 'terms' collides with an attachment id.")),
    "attachment by ref": attached("[{id: s, title: S, file: f}]", "{{ref: s}}", ("ref-targets-attachment", E, "Reference '{{ref: s}}' targets an attachment id. Use '{{attach: s}}' instead."), UNUSED("s")),
    "attachment undeclared": one("{{attach: s-@K}}", "attach-undeclared", E, "Attachment reference '{{attach: s-@K}}' references undeclared attachment id."),
    "amends": one("Text.", "amends-title-empty", E, "amends.title is required when amends is present.", front=TITLE + "amends: {file: o.lgd}\n" + PARTIES),
    "amended term": one("{{term: gone-@K}}", "amend-term-unresolvable", I, "Term reference 'gone-@K' is not defined in the amendment; the original document is not available to verify it.", front=TITLE + "amends: {title: O}\n" + PARTIES),
    "depth": one("###### Deep {#deep}", "heading-depth", E, "Section 'Deep' uses unsupported heading level 6. LegalDown supports levels 1-5 (§4.1).", SKIP("Deep", 1, 5)),
    "skip": Case("### Sub {#sub}\n\n## 2.1 Next {#next}", found=(SKIP("Sub", 1, 3), ("heading-hardcoded-number", W, "Section '2.1 Next' appears to include hardcoded numbering. LegalDown headings should be plain text."))),
    "numbers": Case("## Scope\n\n### Part @K {#part}\n\n## Scope {#scope}\n\n# Scope {#scope}", found=(
        ("anchor-duplicate", E, "Duplicate section identifier on 'Scope'. It was adjusted to 'scope-2'."), ("anchor-duplicate", E, "Duplicate section identifier on 'Scope'. It was adjusted to 'scope-3'."),
    )),
    "signature": Case("{{ref: signature-block}}\n\n# Signature Block {#signature-block}\n\n{{nope: x}}", found=(("ref-broken", E, "Broken section reference: 'signature-block'."),)),
    "same slug": one('"Fee Note" {{def:}} is.\n\n"Fee-Note" {{def:}} is {{term: fee-note}}.', "def-autogen-collision", E, "Two definitions auto-generate the same id 'fee-note'. Add an explicit id to disambiguate."),
    "same id": one('"Alpha" {{def: x@K}} is.\n\n"Beta" {{def: x@K}} is {{term: x@K}}.', "def-duplicate-id", E, "Definition identifier 'x@K' is duplicated."),
    "emphasis": one('**"Services"** {{def: services}} means {{term: services}}.', "def-emphasis", W, "Defined term wrapped in emphasis markers in source. Quotation marks alone delimit a defined term; emphasis is a render-time style."),
    "no quotes": one("Foo {{def: bar}} baz.", "def-no-quoted-span", E, "A {{def:}} anchor must immediately follow a quoted defined term."),
    "single quotes": one("‘Services @K’ {{def: services}} are {{term: services}}.", "def-single-quote-ambiguous", W, "Single-quoted defined term 'Services @K' may be ambiguous with an apostrophe (U+2019); prefer double-quote delimiters."),
    "inline definition": Case('The “Goods” {{def: goods}} and «Fees @K» {{def: fees}} of it.', found=(UNREAD("goods"), UNREAD("fees"))),
    "structural": Case("Text.", TITLE + PARTIES.replace("name: clients", 'name: "{{placeholder: s}}"'), (
        ("side-party-name-format", E, f"Side name '{{{{placeholder: s}}}}' {LOWER}"),
        ("placeholder-in-structural-field", E, "A {{placeholder:}} is not allowed in the identifier/structural field (side name '{{placeholder: s}}'); placeholders are only valid in value fields (§3.10)."),
    )),
    "placeholders": Case("{{placeholder: Bad@K}} {{placeholder: a, type=x@K}} {{placeholder: b, type=money, currency=ZZZ}} {{placeholder: c}} {{placeholder: c, type=date}}", found=(
        ("placeholder-id-malformed", E, "Placeholder id 'Bad@K' is invalid — must match [a-z][a-z0-9-]*."),
        ("placeholder-type-invalid", E, "Placeholder type 'x@K' is unsupported. Must be one of: text, date, money."),
        ("placeholder-unknown-currency", W, "Placeholder 'b' has unrecognized currency code 'ZZZ'."),
        ("placeholder-type-inconsistent", E, "Placeholder 'c' used with inconsistent types: 'text' and 'date'."),
    )),
    "date": Case("{{date: 2026-02-30}} {{date: 2024-1-1}} {{date: 2024-02-29}} {{date: x@K}}", found=tuple(
        ("date-invalid", E, f"Invalid date value '{d}'. Must be a valid ISO 8601 date (YYYY-MM-DD).") for d in ("2026-02-30", "2024-1-1", "x@K")
    )),
    "money": Case("{{money: -@K, currency=USD}} {{money: 5, currency=usd}} {{money: 1,000, currency=USD}} {{money: @K.50, currency=EUR}}", found=(
        ("money-invalid-amount", E, "Invalid money amount '-@K'. Must be a non-negative numeric value."), ("money-unknown-currency", W, "Unrecognized currency code 'usd'."),
    )),
    "duration": Case("{{duration: 0, unit=D}} {{duration: 1d, unit=Y}} {{duration: 5}} {{duration: 1_000, unit=Q@K}}", found=(
        ("duration-invalid-value", E, "Invalid duration value '0'. Must be a positive numeric value."),
        ("duration-invalid-value", E, "Invalid duration value '1d'. Must be a positive numeric value."),
        ("duration-invalid-unit", E, "Duration directive missing required unit parameter."),
        ("duration-invalid-unit", E, "Invalid duration unit 'Q@K'. Must be one of: S, MIN, H, D, W, MO, Y."),
    )),
    "party": Case("{{party: Acme}} {{party: nobody-@K}} {{party: acme}} {{side: X@K}} {{side: nobody-@K}} {{side: clients}}", found=(
        ("party-name-malformed", E, "Party directive has invalid role value 'Acme'. Must match [a-z][a-z0-9-]*."),
        ("party-unknown", E, "Party directive references unknown party: 'nobody-@K'."),
        ("side-name-malformed", E, "Side directive has invalid value 'X@K'. Must match [a-z][a-z0-9-]*."),
        ("side-unknown", E, "Side directive references unknown side: 'nobody-@K'."),
    )),
    "fields": Case("{{field: @K, type=bar}} {{field: 1, type=foo}} {{field: 2}} {{field: 3, type=BAD}}", TITLE + "field_types: {foo: x}\n" + PARTIES, (
        ("field-type-undeclared", W, "Field type 'bar' is not declared in field_types."),
        ("field-type-missing", E, "Field directive is missing required type parameter."),
        ("field-type-missing", E, "Field type 'BAD' is invalid — must match [a-z][a-z0-9-]*."),
    )),
    "notes": Case("{{date: 2026-01-01, note=a, b}} {{date: 2026-01-02, note=**x**}} {{date: 2026-01-03, note=2 * 3}}", found=(
        ("note-invalid", E, "Note parameter must not contain commas or closing braces."), ("note-invalid", E, "Note parameter must be plain text without Markdown formatting."),
    )),
    "literals": Case("Write `{{nope: @K}}` or <!-- {{trem: x}} --> {{oops: @K}}.", found=(("directive-unknown", E, "Unknown directive '{{oops:}}'. Renderers replace it with [UNKNOWN DIRECTIVE: oops] (§11.5)."),)),
    "lists": Case("{{ref: item}} {{ref: terms.part}}\n\n- One\n  two {#item}\n- three\n\n2. a\n1. b\n\n## Part {#part}\n\n| one line |"),
}
#: A prime, so that keys of any pattern meet every case; keys of the places left over are clean.
PLACES = 67
NUMBERS = {name: i for i, name in enumerate(CASES)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file, filename, source): one document per order."""
    clean = CASES["clean"]
    rows = [(i, f"---\n{c.front}---\n\n# Terms {{#terms}}\n\n{c.body}\n") for i, c in enumerate([*CASES.values(), *[clean] * (PLACES - len(CASES))])]
    cases = spark.createDataFrame(rows, "place int, template string")
    key = F.col("o_orderkey").cast("string")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.pmod("o_orderkey", F.lit(PLACES)).cast("int").alias("place"))
    file = F.concat(F.lit("cases/"), key, F.lit(".lgd"))
    return orders.join(F.broadcast(cases), "place").select(F.col("o_orderkey").alias("doc_id"), file.alias("file"), F.concat(key, F.lit(".lgd")).alias("filename"), F.replace("template", F.lit(KEY), key).alias("source"))
