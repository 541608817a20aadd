"""All rules over one document in plain Python, for reports over corpora that need no indices.

``validate`` computes a document's indices and diagnostics as expressions over its
row, which Spark interprets node by node: some 3 ms for a contract of four sections.
Here one Arrow function goes from source text to diagnostics, so that neither
sections nor blocks become rows. The rules, their messages and their order are
those of ``validate``, which tests hold it to; documents with definitions from other
documents need ``validate``.
"""

from __future__ import annotations

import datetime
import functools
import math
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewood.functions import patterns as P
from clausewood.functions.scalars import ASCII_DIGITS, pinned
from clausewood.operators.body import Block, Section, compiled, display_name, parse_body, slug
from clausewood.operators.frontmatter import read_metadata, split_source
from clausewood.plans.messages import MESSAGES
from clausewood.runtime import ship
from clausewood.schema import DIAGNOSTIC

Said = tuple[str, str, str]
Metadata = dict[str, Any]

_IDENTIFIER, _HARDCODED_NUMBER, _TRAILING_ANCHOR = compiled(P.IDENTIFIER), compiled(P.HARDCODED_NUMBER), compiled(P.TRAILING_ANCHOR)
_FENCED_CODE, _HTML_COMMENT, _CODE_SPAN = compiled(P.FENCED_CODE), compiled(P.HTML_COMMENT), compiled(P.CODE_SPAN)
_DEFINITION, _DEFINITION_TAG, _EMPHASISED, _SINGLE_QUOTED = compiled(P.DEFINITION), compiled(P.DEFINITION_TAG), compiled(P.EMPHASISED_DEFINITION), compiled(P.SINGLE_QUOTED)
_REF, _TERM, _DATE, _MONEY, _DURATION = compiled(P.REF), compiled(P.TERM), compiled(P.DATE), compiled(P.MONEY), compiled(P.DURATION)
_PARTY, _SIDE, _FIELD, _PLACEHOLDER, _ATTACH = compiled(P.PARTY), compiled(P.SIDE), compiled(P.FIELD), compiled(P.PLACEHOLDER), compiled(P.ATTACH)
_NOTE, _DIRECTIVE_NAME, _MARKDOWN_IN_NOTE = compiled(P.NOTE), compiled(P.DIRECTIVE_NAME), compiled(P.MARKDOWN_IN_NOTE)
_ISO_DATE, _AMOUNT = re.compile("[0-9]{4}-[0-9]{2}-[0-9]{2}"), re.compile(r"\d+(?:\.\d+)?")
_CURRENCIES = frozenset(P.CURRENCIES)
_TEXTS = {name: (rule, level, text.split("%s")) for name, (rule, level, text) in MESSAGES.items()}


def say(name: str, *values: object) -> Said:
    """(rule, level, message) with the values filled in."""
    rule, level, parts = _TEXTS[name]
    said = parts[0]
    for value, part in zip(values, parts[1:], strict=True):
        said += f"{value}{part}"
    return rule, level, said


# ---------------------------------------------------------------- scalars


def is_identifier(text: str) -> bool:
    return _IDENTIFIER.match(text) is not None


@functools.lru_cache(4096)
def _is_day(text: str) -> bool:
    try:
        datetime.date(int(text[:4]), int(text[5:7]), int(text[8:]))
    except ValueError:
        return False
    return True


def is_iso_date(text: str) -> bool:
    """``scalars.is_iso_date``."""
    plain = text if text.isascii() else text.translate(ASCII_DIGITS)
    return _ISO_DATE.fullmatch(plain) is not None and _is_day(plain)


def to_number(text: str) -> float:
    """The number that a text stands for; nan if it is none."""
    try:
        return float(text)
    except ValueError:
        return math.nan


def is_money_amount(text: str) -> bool:
    return _AMOUNT.fullmatch(text) is not None and math.isfinite(to_number(text))


def mask_literals(text: str) -> str:
    """``scalars.mask_literals``."""
    if "```" in text or "~~~" in text:
        text = _FENCED_CODE.sub("\n", text)
    if "<!--" in text:
        text = _HTML_COMMENT.sub(lambda m: "\n" if "\n" in m[0] else " ", text)
    return _CODE_SPAN.sub(" ", text) if "`" in text else text


def found_in(pattern: re.Pattern[str], text: str) -> list[list[str]]:
    """Of every match its groups, stripped."""
    return [[group.strip() for group in found.groups("")] for found in pattern.finditer(text)]


def bad_date(text: str) -> bool:
    return text != "" and P.PLACEHOLDER_LITERAL not in text and not is_iso_date(text.strip())


def places(values: Iterable[str]) -> dict[str, int]:
    """The first place of each value."""
    first: dict[str, int] = {}
    for i, value in enumerate(values):
        first.setdefault(value, i)
    return first


# ---------------------------------------------------------------- metadata


def party_rules(p: Metadata, at: int, first: dict[str, int]) -> Iterator[Said]:
    name = p["name"].strip()
    if name == "":
        return
    if not is_identifier(name):
        yield say("party-name-format", p["name"])
    elif first[name] < at:
        yield say("party-name-duplicate", name)
    else:
        if p["type"] not in P.PARTY_TYPES:
            yield say("party-type-invalid", name, p["type"])
        if bad_date(p["date_of_birth"]):
            yield say("date-of-birth-invalid", name, p["date_of_birth"])
        for person in p["representatives"]:
            if person["name"].strip() == "":
                yield say("representative-name-empty", name)


def side_rules(sides: list[Metadata], first_side: dict[str, int], first_party: dict[str, int]) -> Iterator[Said]:
    at = 0
    for i, s in enumerate(sides):
        name = s["name"].strip()
        if name != "":
            if not is_identifier(name):
                yield say("side-name-format", s["name"])
            elif first_side[name] < i:
                yield say("side-name-duplicate", name)
        for p in s["parties"]:
            yield from party_rules(p, at, first_party)
            at += 1


def cardinality_rules(sides: list[Metadata], kind: str, names: dict[str, int]) -> Iterator[Said]:
    n, parties = len(sides), sum(len(s["parties"]) for s in sides)
    if n == 0:
        yield say("sides-absent", kind)
    elif kind == "contract":
        if n < 2:
            yield say("sides-minimum", n)
        if parties < 2:
            yield say("contract-parties-minimum", parties)
    elif kind in ("unilateral_act", "collective_act"):
        if parties < 1:
            yield say("act-parties-minimum", kind)
        if "issuer" not in names:
            yield say("issuer-side-required", kind)


def attachment_rules(items: list[Metadata]) -> Iterator[Said]:
    first = places(a["id"] for a in items)
    for i, a in enumerate(items):
        if a["id"] == "":
            yield say("attachment-id-missing")
        elif not is_identifier(a["id"]):
            yield say("attachment-id-format", a["id"])
        elif first[a["id"]] < i:
            yield say("attachment-id-duplicate", a["id"])
        if a["title"] == "":
            yield say("attachment-title-empty", a["id"])
        if a["file"] == "":
            yield say("attachment-file-missing", a["id"])


def metadata_rules(m: Metadata, first_side: dict[str, int], first_party: dict[str, int]) -> Iterator[Said]:
    """Title, type, value types, dates, sides and parties, attachments, amendment."""
    kind = m["document_type"] or "contract"
    if m["title"].strip() == "":
        yield say("title-missing")
    if kind not in P.DOCUMENT_TYPES:
        yield say("document-type-invalid", kind)
    for f in m["field_types"]:
        if not is_identifier(f["key"]):
            yield say("field-type-key-format", f["key"])
        elif f["key"] in P.RESERVED_VALUE_TYPES:
            yield say("field-type-key-reserved", f["key"])
    for name in ("effective_date", "adoption_date"):
        if bad_date(m[name]):
            yield say("metadata-date-invalid", name, m[name])
    yield from side_rules(m["sides"], first_side, first_party)
    yield from cardinality_rules(m["sides"], kind, first_side)
    yield from attachment_rules(m["attachments"])
    if m["amends"] is not None and m["amends"]["title"].strip() == "":
        yield say("amends-title-empty")


# ---------------------------------------------------------------- sections and blocks


def section_rules(sections: list[Section], attachments: set[str], out: list[Said]) -> tuple[list[str], list[str]]:
    """The final identifiers and the paths of the sections; their diagnostics go to ``out``."""
    identifiers, paths, used = [], [], set()
    path: list[str] = []
    last = 0
    for title, depth, identifier, _ in sections:
        given = identifier.strip()
        first = given or slug(title)
        wanted = first if is_identifier(first) else slug(first)
        final, k = wanted, 1
        while final in used:
            k += 1
            final = f"{wanted}-{k}"
        level = max(1, min(5, depth))
        if level != depth:
            out.append(say("heading-depth", title, depth))
        if 0 < last < level - 1:
            out.append(say("heading-skip", title, last, level))
        if _HARDCODED_NUMBER.match(title.strip()):
            out.append(say("heading-hardcoded-number", title))
        if not is_identifier(first):
            out.append(say("section-id-format", first, title))
        if wanted != final:
            out.append(say("section-id-duplicate" if given else "anchor-autogen-collision", title, final))
        if final in attachments:
            out.append(say("attachment-id-collision", final))
        path = [*path[: level - 1], final]
        last = level
        used.add(final)
        identifiers.append(final)
        paths.append(".".join(path))
    return identifiers, paths


def fragments(b: Block) -> list[str]:
    """The texts of a block that hold a brace, and so may hold directives and anchors, in order."""
    texts = [b.get("text", ""), b.get("prefix", ""), b.get("suffix", ""), *b.get("items", ()), *(cell for row in b.get("rows", ()) for cell in row)]
    return [t for t in texts if "{" in t]


def anchor_rules(anchors: list[str], sections: set[str]) -> tuple[list[Said], set[str]]:
    """The diagnostics of trailing anchors, and those that are accepted."""
    out, seen = [], set()
    for a in anchors:
        if not is_identifier(a):
            out.append(say("anchor-format", a))
        elif a in sections or a in seen:
            out.append(say("anchor-duplicate", a))
        seen.add(a)
    return out, {a for a in seen if is_identifier(a) and a not in sections}


# ---------------------------------------------------------------- definitions

Definition = tuple[str, str, bool]


def leading_definition(b: Block) -> Definition:
    """(id, term, whether the id is made from the term) of a definition block."""
    term, given = b.get("term", "").strip(), b.get("definition_id", "").strip()
    own = given or slug(term, "term")
    return own, term or display_name(own), given == ""


def inline_definitions(text: str) -> list[tuple[Definition, bool]]:
    """Those inside a text, and whether single quotation marks enclose the term."""
    out = []
    for found in _DEFINITION.finditer(text):
        *terms, given = found.groups("")
        term, given = next(filter(None, terms), "").strip(), given.strip()
        out.append(((given or slug(term, "term"), term, given == ""), _SINGLE_QUOTED.match(found[0]) is not None))
    return out


def definition_rules(refs: list[Definition]) -> Iterator[Said]:
    first = places(d[0] for d in refs)
    for i, (own, term, auto) in enumerate(refs):
        place = first[own]
        if not is_identifier(own):
            yield say("definition-id-format", own, term)
        elif place < i:
            other = auto and refs[place][2] and refs[place][1] != term
            yield say("def-autogen-collision" if other else "def-duplicate-id", own)


def definition_form_rules(text: str, found: list[tuple[Definition, bool]]) -> Iterator[Said]:
    if _EMPHASISED.search(text):
        yield say("def-emphasis")
    for _ in range(sum(1 for _ in _DEFINITION_TAG.finditer(text)) - len(found)):
        yield say("def-no-quoted-span")
    for (_, term, _), single in found:
        if single:
            yield say("def-single-quote-ambiguous", term)


# ---------------------------------------------------------------- placeholders

Placeholder = tuple[str, str, str]


def structural_rules(m: Metadata) -> Iterator[Said]:
    def bad(value: str, label: str) -> Iterator[Said]:
        if P.PLACEHOLDER_LITERAL in value:
            yield say("placeholder-in-structural-field", label)

    yield from bad(m["document_type"], "document_type")
    for s in m["sides"]:
        yield from bad(s["name"], f"side name '{s['name']}'")
        for p in s["parties"]:
            yield from bad(p["name"], f"party name '{p['name']}'")
            yield from bad(p["type"], f"party type for '{p['name']}'")


def value_fields(m: Metadata) -> Iterator[str]:
    for name in ("title", "subtitle", "version", "effective_date", "governing_law", "authoritative", "adopted_by", "adoption_date", "supersedes"):
        yield m[name]
    for s in m["sides"]:
        yield s["label"]
        for p in s["parties"]:
            for name in ("label", "legal_name", "identification_number", "address", "date_of_birth"):
                yield p[name]
            for name in ("name", "title"):
                for person in p["representatives"]:
                    yield person[name]
            for c in p["custom_fields"]:
                yield c["value"]


def placeholders_in(text: str) -> list[Placeholder]:
    """(id, type, currency) of every placeholder, in order."""
    return [(own, kind or "text", currency) for own, kind, currency in found_in(_PLACEHOLDER, text)] if P.PLACEHOLDER_LITERAL in text else []


def placeholder_rules(found: Iterable[Placeholder], types: dict[str, str]) -> Iterator[Said]:
    """Checks of placeholders; ``types`` has the type of an id's first valid use anywhere."""
    for own, kind, currency in found:
        if not is_identifier(own):
            yield say("placeholder-id-malformed", own)
        elif kind not in P.PLACEHOLDER_TYPES:
            yield say("placeholder-type-invalid", kind)
        else:
            if types[own] != kind:
                yield say("placeholder-type-inconsistent", own, types[own], kind)
            if kind == "money" and currency != "" and currency not in _CURRENCIES:
                yield say("placeholder-unknown-currency", own, currency)


# ---------------------------------------------------------------- directives

#: A masked text and the names of its directives.
Named = tuple[str, list[str]]


#: The directives whose values are checked, in the order of report.
CHECKED = ("date", "money", "duration", "party", "side", "field", "placeholder", "attach")


def date_rules(t: str) -> Iterator[Said]:
    for (value,) in found_in(_DATE, t):
        if not is_iso_date(value):
            yield say("date-invalid", value)


def money_rules(t: str) -> Iterator[Said]:
    for amount, currency in found_in(_MONEY, t):
        if not is_money_amount(amount):
            yield say("money-invalid-amount", amount)
        if currency == "":
            yield say("money-missing-currency")
        elif currency not in _CURRENCIES:
            yield say("money-unknown-currency", currency)


def duration_rules(t: str) -> Iterator[Said]:
    for value, unit in found_in(_DURATION, t):
        if not to_number(value) > 0:
            yield say("duration-invalid-value", value)
        if unit == "":
            yield say("duration-unit-missing")
        elif unit == "M":
            yield say("duration-unit-m")
        elif unit not in P.DURATION_UNITS:
            yield say("duration-unit-unknown", unit)


def named_rules(t: str, pattern: re.Pattern[str], known: set[str], kind: str) -> Iterator[Said]:
    """Directives that name a side or a party."""
    for name, _ in found_in(pattern, t):
        if not is_identifier(name):
            yield say(f"{kind}-name-malformed", name)
        elif name not in known:
            yield say(f"{kind}-unknown", name)


def field_rules(t: str, declared: set[str]) -> Iterator[Said]:
    for _, kind in found_in(_FIELD, t):
        if kind == "":
            yield say("field-type-missing")
        elif not is_identifier(kind):
            yield say("field-type-malformed", kind)
        elif declared and kind not in declared:
            yield say("field-type-undeclared", kind)


def note_rules(t: str) -> Iterator[Said]:
    for found in _NOTE.finditer(t):
        if "," in found[1]:
            yield say("note-separators")
        elif _MARKDOWN_IN_NOTE.search(found[1]):
            yield say("note-markdown")


def targets(b: Block, named: list[Named], kind: str, pattern: re.Pattern[str]) -> list[str]:
    """Targets of references or terms of a block: its own, then those in its fragments."""
    own = b.get("target", "").strip() if b["kind"] == kind else ""
    return ([own] if own else []) + [found[1].strip() for t, names in named if kind in names for found in pattern.finditer(t)]


# ---------------------------------------------------------------- documents


def diagnose(m: Metadata, sections: list[Section]) -> list[Said]:
    """The diagnostics of a document in the order of report."""
    first_side = places(s["name"].strip() for s in m["sides"])
    first_party = places(p["name"].strip() for s in m["sides"] for p in s["parties"])
    sides, parties = set(filter(is_identifier, first_side)), set(filter(is_identifier, first_party))
    attachments = {a["id"] for a in m["attachments"] if is_identifier(a["id"])}
    declared = {f["key"] for f in m["field_types"]}
    out = list(metadata_rules(m, first_side, first_party))
    identifiers, paths = section_rules(sections, attachments, out)

    blocks = []
    anchors: list[str] = []
    definitions: list[Definition] = []
    forms: list[Said] = []
    body: list[Placeholder] = []
    used_terms, used_attachments = set(), set()
    for _, _, _, own in sections:
        for b in own:
            named: list[Named] = []
            if b["kind"] == "definition":
                definitions.append(leading_definition(b))
            for raw in fragments(b):
                if "def:" in raw:
                    found = inline_definitions(raw)
                    definitions += [d for d, _ in found]
                    forms += definition_form_rules(raw, found)
                t = mask_literals(raw)
                if "{#" in t and (anchor := _TRAILING_ANCHOR.search(t)):
                    anchors.append(anchor[1])
                if "{{" in t:
                    names = _DIRECTIVE_NAME.findall(t)
                    named.append((t, names))
                    if "attach" in names:
                        used_attachments.update(found[0] for found in found_in(_ATTACH, t))
                    if "placeholder" in names:
                        body += placeholders_in(t)
            terms = targets(b, named, "term", _TERM)
            used_terms.update(terms)
            blocks.append((named, targets(b, named, "ref", _REF), terms))

    said, accepted = anchor_rules(anchors, set(identifiers))
    keys = accepted.union(identifiers, paths)
    defined = {d[0] for d in definitions if is_identifier(d[0])}
    front = [x for t in value_fields(m) if P.PLACEHOLDER_LITERAL in t for x in placeholders_in(t)]
    types: dict[str, str] = {}
    for own, kind, _ in (*front, *body):
        if is_identifier(own) and kind in P.PLACEHOLDER_TYPES:
            types.setdefault(own, kind)
    undefined = "term-undefined" if m["amends"] is None else "amend-term-unresolvable"
    checks: dict[str, Callable[[str], Iterable[Said]]] = {
        "date": date_rules,
        "money": money_rules,
        "duration": duration_rules,
        "party": lambda t: named_rules(t, _PARTY, parties, "party"),
        "side": lambda t: named_rules(t, _SIDE, sides, "side"),
        "field": lambda t: field_rules(t, declared),
        "placeholder": lambda t: placeholder_rules(placeholders_in(t), types),
        "attach": lambda t: (say("attach-undeclared", found[0]) for found in found_in(_ATTACH, t) if found[0] not in attachments),
    }

    out += said
    out += definition_rules(definitions)
    out += forms
    out += structural_rules(m)
    out += placeholder_rules(front, types)
    for named, refs, terms in blocks:
        for t, names in named:
            out += [say("directive-unknown", name, name) for name in names if name not in P.KNOWN_DIRECTIVES]
            for name in CHECKED:
                if name in names:
                    out += checks[name](t)
            if "note=" in t:
                out += note_rules(t)
        for t in refs:
            if t not in keys:
                out.append(say("ref-targets-attachment", t, t) if t in attachments else say("ref-broken", t))
        out += [say(undefined, t) for t in terms if t not in defined]
    out += [say("attachment-unreferenced", a["id"]) for a in m["attachments"] if a["id"] != "" and a["id"] not in used_attachments]
    out += [say("def-unreferenced", own) for own in dict.fromkeys(d[0] for d in definitions) if own in defined and own not in used_terms]
    return out


def diagnose_source(source: str) -> list[Said]:
    front, body = split_source(source)
    metadata, error = read_metadata(front)
    return [say("frontmatter-invalid-yaml", error)] if metadata is None else diagnose(metadata, parse_body(body))


def diagnosed(docs: DataFrame) -> DataFrame:
    """Adds to rows with ``source`` the ``diagnostics`` that ``validate`` gives of documents that import nothing."""
    ship(docs.sparkSession)

    @F.arrow_udf(f"array<{DIAGNOSTIC}>")
    def read(sources: pa.Array) -> pa.Array:
        found = [diagnose_source(source) for source in sources.to_pylist()]
        offsets = [0]
        for said in found:
            offsets.append(offsets[-1] + len(said))
        flat = [d for said in found for d in said]
        columns = [pa.array([d[i] for d in flat], pa.string()) for i in range(3)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["rule", "level", "message"]))

    return docs.withColumn("diagnostics", pinned(read(F.coalesce("source", F.lit("")))))
