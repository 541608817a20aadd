"""Small documents and the rules they break."""

BASE = """---
title: Fixture
document_type: contract
sides:
  - name: providers
    parties:
      - name: acme
        type: legal_entity
        legal_name: Acme Corporation
  - name: clients
    parties:
      - name: beta
        type: legal_entity
        legal_name: Beta Industries Inc.
---

# Terms {#terms}

"""

E, W, I = "error", "warning", "info"

BODIES = {
    "Text.": [],
    "See {{ref: terms}}.": [],
    "See {{ref: nowhere}}.": [("ref-broken", E)],
    "Write `{{nope: x}}` and `{#not-an-anchor}` literally.": [],
    "Write `{{ref: nowhere}}`.": [("ref-broken", E)],
    "A {{trem: services}} typo.": [("directive-unknown", E)],
    "Uses {{term: x}}.": [("term-undefined", E)],
    '"Services" {{def: services}} means x.': [("def-unreferenced", W)],
    '**"Services"** {{def: services}} means {{term: services}}.': [("def-emphasis", W)],
    "Foo {{def: bar}} baz.": [("def-no-quoted-span", E)],
    "‘Services’ {{def: services}} are {{term: services}}.": [("def-single-quote-ambiguous", W)],
    '"Alpha" {{def: x}} is.\n\n"Beta" {{def: x}} is {{term: x}}.': [("def-duplicate-id", E)],
    '"Fee Note" {{def:}} is.\n\n"Fee-Note" {{def:}} is {{term: fee-note}}.': [("def-autogen-collision", E)],
    '"A" means X. "B" {{def: b}} y.': [("def-unreferenced", W)],
    "Pay {{money: 100}}.": [("money-missing-currency", W)],
    "{{money: -50, currency=USD}}": [("money-invalid-amount", E)],
    "{{money: 5, currency=usd}}": [("money-unknown-currency", W)],
    "{{money: 1,000, currency=USD}}": [],
    "{{date: 2026-02-30}}": [("date-invalid", E)],
    "{{date: ٢٠٢٦-٠١-٠١}}": [],
    "{{date: 2024-1-1}}": [("date-invalid", E)],
    "{{duration: 30, unit=M}}": [("duration-invalid-unit", E)],
    "{{duration: 0, unit=D}}": [("duration-invalid-value", E)],
    "{{duration: 5}}": [("duration-invalid-unit", E)],
    "{{duration: inf, unit=D}}": [],
    "{{duration: nan, unit=D}}": [("duration-invalid-value", E)],
    "{{duration: 1d, unit=D}}": [("duration-invalid-value", E)],
    "{{duration: 1_000, unit=D}}": [],
    "{{party: nobody}}": [("party-unknown", E)],
    "{{party: Acme}}": [("party-name-malformed", E)],
    "{{party: acme}} {{side: clients}}": [],
    "{{side: nobody}}": [("side-unknown", E)],
    "{{side: X}}": [("side-name-malformed", E)],
    "{{field: 1}}": [("field-type-missing", E)],
    "{{field: 1, type=BAD}}": [("field-type-missing", E)],
    "{{field: 1, type=foo}}": [],
    "{{placeholder: Bad}}": [("placeholder-id-malformed", E)],
    "{{placeholder: a, type=x}}": [("placeholder-type-invalid", E)],
    "{{placeholder: a}} {{placeholder: a, type=date}}": [("placeholder-type-inconsistent", E)],
    "{{placeholder: a, type=money, currency=ZZZ}}": [("placeholder-unknown-currency", W)],
    "{{attach: s}}": [("attach-undeclared", E)],
    "{{date: 2026-01-01, note=a, b}}": [("note-invalid", E)],
    "{{date: 2026-01-01, note=**x**}}": [("note-invalid", E)],
    "{{date: 2026-01-01, note=2 * 3}}": [],
    "- Item {#item}\n\nSee {{ref: item}}.": [],
    "- Item {#terms}": [("anchor-duplicate", E)],
    "- Item {#Bad}": [("anchor-format", E)],
    "### Sub {#sub}": [("heading-skip", E)],
    "###### Deep {#deep}": [("heading-depth", E), ("heading-skip", E)],
    "## 1.2 Scope {#scope}": [("heading-hardcoded-number", W)],
    "## Terms": [("anchor-duplicate", E)],
    "## Other {#Bad_ID}\n\n{{ref: bad-id}} {{ref: terms.bad-id}}": [("anchor-format", E)],
    "<!-- {{nope: a}}\n\n{{nope: b}} -->": [("directive-unknown", E), ("directive-unknown", E)],
    "<!-- {{nope: a}} -->": [],
    "# Signature Block {#signature-block}\n\n{{nope: x}}": [],
    "| {{nope: in a one-line table}} |": [],
    "| {{nope: header}} | b |\n|---|---|\n| {{nope: cell}} | c |": [("directive-unknown", E)],
    "{{date: 2026-01-01}} {{date: 2026-01-02}}": [],
    "> ~~~\n> {{nope: x}}\n> ~~~": [],
    "{{include: other.lgd}}": [],
    "{{date: }}": [("date-invalid", E)],
    "{{date:}}": [],
}

PARTIES = "sides:\n  - name: providers\n    parties:\n      - {name: acme, type: legal_entity}\n  - name: clients\n    parties:\n      - {name: beta, type: natural_person}\n"


def front(text: str, body: str = "") -> str:
    return f"---\n{text}---\n\n# Terms {{#terms}}\n\n{body}\n"


FRONTS = {
    "# Terms {#terms}\n": [("title-missing", E), ("sides-absent", W)],
    front("title: T\ndocument_type: nda\n" + PARTIES): [("document-type-invalid", E)],
    front("title: T\ndocument_type: unilateral_act\n" + PARTIES): [("issuer-side-required", E)],
    front("title: T\ndocument_type: unilateral_act\nsides: [{name: issuer}]\n"): [("parties-minimum", E)],
    front("title: T\neffective_date: 2026-13-45\n" + PARTIES): [("metadata-date-invalid", E)],
    front('title: T\neffective_date: "{{placeholder: d, type=date}}"\n' + PARTIES): [],
    front("title: T\nfield_types: {Bad: x, date: y}\n" + PARTIES): [("field-type-key-format", E), ("field-type-key-reserved", E)],
    front("title: T\nfield_types: {foo: x}\n" + PARTIES, "{{field: 1, type=bar}} {{field: 1, type=foo}}"): [("field-type-undeclared", W)],
    front("title: T\nsides: [{name: a, parties: [{name: p, type: legal_entity}]}]\n"): [("sides-minimum", E), ("parties-minimum", E)],
    front("title: T\n" + PARTIES.replace("clients", "providers")): [("side-name-duplicate", E)],
    front("title: T\n" + PARTIES.replace("beta", "acme")): [("party-name-duplicate", E)],
    front("title: T\n" + PARTIES.replace(", type: natural_person", "")): [("party-type-invalid", E)],
    front("title: T\n" + PARTIES.replace("natural_person", "corporation")): [("party-type-invalid", E)],
    front("title: T\n" + PARTIES.replace("beta, type: natural_person", "Acme Corporation Ltd.")): [("side-party-name-format", E)],
    front("title: T\n" + PARTIES.replace("natural_person", "natural_person, date_of_birth: 1990-02-30")): [("date-of-birth-invalid", E)],
    front("title: T\n" + PARTIES.replace("natural_person", "natural_person, representatives: [{title: CEO}]")): [("representative-name-empty", E)],
    front("title: T\n" + PARTIES.replace("name: clients", 'name: "{{placeholder: s}}"')): [("side-party-name-format", E), ("placeholder-in-structural-field", E)],
    front("title: T\namends: {file: o.lgd}\n" + PARTIES): [("amends-title-empty", E)],
    front("title: T\namends: {title: O}\n" + PARTIES, "{{term: missing}}"): [("amend-term-unresolvable", I)],
    front("title: T\nattachments: [{id: s, title: S, file: s.pdf}]\n" + PARTIES): [("attachment-unreferenced", W)],
    front("title: T\nattachments: [{id: terms, title: S, file: s.pdf}]\n" + PARTIES, "{{attach: terms}}"): [("attachment-id-collision", E)],
    front("title: T\nattachments: [{id: s, title: S, file: f}, {id: s, title: S, file: f}]\n" + PARTIES, "{{attach: s}}"): [("attachment-id-duplicate", E)],
    front("title: T\nattachments: [{id: s, file: f}]\n" + PARTIES, "{{attach: s}}"): [("attachment-title-empty", E)],
    front("title: T\nattachments: [{id: s, title: S}]\n" + PARTIES, "{{attach: s}}"): [("attachment-file-missing", E)],
    front("title: T\nattachments: [{title: S, file: f}]\n" + PARTIES): [("anchor-format", E)],
    front("title: T\nattachments: [{id: s, title: S, file: f}]\n" + PARTIES, "{{ref: s}}"): [("ref-targets-attachment", E), ("attachment-unreferenced", W)],
    front('title: "{{placeholder: a, type=date}}"\n' + PARTIES, "{{placeholder: a}}"): [("placeholder-type-inconsistent", E)],
    "---\ntitle: [unclosed\n---\n\n# A\n": [("frontmatter-invalid-yaml", E)],
    "---\n- a\n---\n\n# A\n": [("frontmatter-invalid-yaml", E)],
    "---\ntitle: T\nattachments: 5\n---\n": [("frontmatter-invalid-yaml", E)],
}
