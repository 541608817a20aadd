"""Validation: indices and rules of a parsed document as expressions over its row.

Every lookup of a document (sections, anchors, definitions, parties, attachments)
is an array in its own row and every rule an expression over those, so a corpus is
validated without one shuffle: a map over rows, whatever their number. Only
definitions imported from other documents are joined in. The order in which the
rules report is the order of the arrays that are put together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewood.functions import patterns as P
from clausewood.functions import scalars as S
from clausewood.functions.scalars import let
from clausewood.plans.messages import MESSAGES
from clausewood.schema import DIAGNOSTIC

DIAGNOSTICS = f"array<{DIAGNOSTIC}>"
TERMS = "array<struct<id:string,term:string>>"
ENTRY = "struct<title:string,identifier:string,path:string,level:int,number:string>"
FOLD = f"struct<used:array<string>,counters:array<int>,path:array<string>,last:int,entries:array<{ENTRY}>,found:{DIAGNOSTICS}>"
DEFINITION_REF = "struct<id:string,term:string,section_identifier:string,block_index:int,inline:boolean,auto_id:boolean>"


#: While steps are built: the rules that are wanted (None: all), and the sets of rules that are said meanwhile.
_wanted: list[frozenset[str] | None] = [None]
_said: list[set[str]] = []


def part(make: Callable[[], Column]) -> Column:
    """The diagnostics that ``make`` gives, or none, at no cost, where it has no wanted rule."""
    _said.append(set())
    made, said = make(), _said.pop()
    return made if _wanted[0] is None or said & _wanted[0] else listed()


def say(name: str, *values: Column) -> Column:
    """A diagnostic with its values filled in."""
    rule, level, text = MESSAGES[name]
    for said in _said:
        said.add(rule)
    parts = text.split("%s")
    said = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        said += [value.cast("string"), F.lit(part)]
    return F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.concat(*said).alias("message")).cast(DIAGNOSTIC)


def when(condition: Column, name: str, *values: Column) -> Column:
    return F.when(condition, say(name, *values))


def listed(*found: Column) -> Column:
    return F.array(*found).cast(DIAGNOSTICS)


def each(values: Column, body: Callable[..., Column]) -> Column:
    return F.transform(values, body)


def matches(text: Column, pattern: str, groups: int) -> Column:
    """Of every match its groups g1.., stripped."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)), S.strip) for i in range(groups)]
    return F.transform(found[0], lambda x: F.struct(x.alias("g1"))) if groups == 1 else F.arrays_zip(*[x.alias(f"g{i + 1}") for i, x in enumerate(found)])


def contains(values: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(values, value), F.lit(False))


def firsts(values: Column) -> Column:
    """Indices (from 0) of the first occurrence of each value."""
    return let(values, lambda v: F.filter(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0))), lambda i: (F.size(v) > 0) & (F.array_position(v, F.get(v, i)) == i + 1)))


def bad_date(text: Column) -> Column:
    return (text != "") & ~S.is_placeholder(text) & ~S.is_iso_date(S.strip(text))


def text_fragments(block: Column) -> Column:
    """The texts of a block that can hold directives, in order."""
    return F.filter(F.concat(F.array(block["text"], block["prefix"], block["suffix"]), block["items"], F.flatten(block["rows"])), lambda t: t != "")


# ---------------------------------------------------------------- metadata


def side_columns(m: Column) -> dict[str, Column]:
    """Side and party names in order, and the lookups of the valid first ones."""
    sides, parties = m["sides"], F.flatten(each(m["sides"], lambda s: s["parties"]))
    names, party_names = each(sides, lambda s: S.strip(s["name"])), each(parties, lambda p: S.strip(p["name"]))

    def side(i: Column) -> Column:
        s = F.get(sides, i)
        return F.struct(S.strip(s["name"]).alias("id"), F.when(s["label"] != "", s["label"]).otherwise(S.display_name(S.strip(s["name"]))).alias("term"))

    def party(i: Column) -> Column:
        p = F.get(parties, i)
        name = S.strip(p["name"])
        return F.struct(name.alias("id"), F.when(p["label"] != "", p["label"]).when(p["legal_name"] != "", p["legal_name"]).otherwise(name).alias("term"))

    valid = lambda values, i: S.is_identifier(F.get(values, i))
    return {
        "side_names": names,
        "party_names": party_names,
        "side_lookup": each(F.filter(firsts(names), lambda i: valid(names, i)), side).cast(TERMS),
        "party_lookup": each(F.filter(firsts(party_names), lambda i: valid(party_names, i)), party).cast(TERMS),
    }


def attachment_columns(m: Column) -> dict[str, Column]:
    items = m["attachments"]
    ids = each(items, lambda a: a["id"])

    def entry(i: Column) -> Column:
        a = F.get(items, i)
        return F.struct(a["id"].alias("id"), F.when(a["title"] != "", a["title"]).otherwise(a["id"]).alias("term"))

    return {"attachment_lookup": each(F.filter(firsts(ids), lambda i: S.is_identifier(F.get(ids, i))), entry).cast(TERMS)}


def side_rules(m: Column) -> Column:
    sides, names, party_names = m["sides"], F.col("side_names"), F.col("party_names")

    def party_rules(p: Column, number: Column) -> Column:
        name = S.strip(p["name"])
        own = listed(when(~p["type"].isin(*P.PARTY_TYPES), "party-type-invalid", name, p["type"]), when(bad_date(p["date_of_birth"]), "date-of-birth-invalid", name, p["date_of_birth"]))
        people = each(p["representatives"], lambda r: when(S.strip(r["name"]) == "", "representative-name-empty", name))
        return (
            F.when(name == "", listed())
            .when(~S.is_identifier(name), listed(say("party-name-format", p["name"])))
            .when(F.array_position(party_names, name) < number, listed(say("party-name-duplicate", name)))
            .otherwise(F.concat(own, people.cast(DIAGNOSTICS)))
        )

    def side(s: Column, i: Column) -> Column:
        name = S.strip(s["name"])
        own = F.when(name == "", F.lit(None)).otherwise(F.when(~S.is_identifier(name), say("side-name-format", s["name"])).when(F.array_position(names, name) < i + 1, say("side-name-duplicate", name)))
        before = F.aggregate(F.slice(sides, 1, i), F.lit(0), lambda n, x: n + F.size(x["parties"]))
        return F.concat(listed(own), F.flatten(each(s["parties"], lambda p, j: party_rules(p, before + j + 1))))

    return F.flatten(each(sides, side))


def cardinality_rules(m: Column, kind: Column) -> Column:
    n = F.size(m["sides"])
    parties = F.aggregate(m["sides"], F.lit(0), lambda total, s: total + F.size(s["parties"]))
    issuer = F.exists("side_lookup", lambda s: s["id"] == "issuer")
    return (
        F.when(n == 0, listed(say("sides-absent", kind)))
        .when(kind == "contract", listed(when(n < 2, "sides-minimum", n), when(parties < 2, "contract-parties-minimum", parties)))
        .when(kind.isin("unilateral_act", "collective_act"), listed(when(parties < 1, "act-parties-minimum", kind), when(~issuer, "issuer-side-required", kind)))
        .otherwise(listed())
    )


def attachment_rules(m: Column) -> Column:
    items = m["attachments"]
    ids = each(items, lambda a: a["id"])

    def rules(a: Column, i: Column) -> Column:
        own = (
            F.when(a["id"] == "", say("attachment-id-missing"))
            .when(~S.is_identifier(a["id"]), say("attachment-id-format", a["id"]))
            .when(F.array_position(ids, a["id"]) < i + 1, say("attachment-id-duplicate", a["id"]))
        )
        return listed(own, when(a["title"] == "", "attachment-title-empty", a["id"]), when(a["file"] == "", "attachment-file-missing", a["id"]))

    return F.flatten(each(items, rules))


def metadata_rules(m: Column) -> Column:
    """Title, type, value types, dates, sides and parties, attachments, amendment."""
    kind = F.when(m["document_type"] == "", F.lit("contract")).otherwise(m["document_type"])
    keys = lambda: each(m["field_types"], lambda f: F.when(~S.is_identifier(f["key"]), say("field-type-key-format", f["key"])).when(f["key"].isin(*P.RESERVED_VALUE_TYPES), say("field-type-key-reserved", f["key"]))).cast(DIAGNOSTICS)
    dates = lambda: listed(*[when(bad_date(m[name]), "metadata-date-invalid", F.lit(name), m[name]) for name in ("effective_date", "adoption_date")])
    amends = lambda: listed(when(m["amends"].isNotNull() & (S.strip(m["amends"]["title"]) == ""), "amends-title-empty"))
    head = lambda: listed(when(S.strip(m["title"]) == "", "title-missing"), when(~kind.isin(*P.DOCUMENT_TYPES), "document-type-invalid", kind))
    return F.concat(*map(part, (head, keys, dates, lambda: side_rules(m), lambda: cardinality_rules(m, kind), lambda: attachment_rules(m), amends)))


# ---------------------------------------------------------------- sections


def section_fold() -> Column:
    """One pass over the sections: unique ids, numbers and paths, each a function of all that came before."""

    def unused(identifier: Column, used: Column) -> Column:
        tries = each(F.sequence(F.lit(2), F.size(used) + 2), lambda k: F.concat(identifier, F.lit("-"), k.cast("string")))
        return F.when(contains(used, identifier), F.element_at(F.filter(tries, lambda t: ~contains(used, t)), 1)).otherwise(identifier)

    def step(acc: Column, s: Column) -> Column:
        title, given = s["title"], S.strip(s["identifier"])
        first = F.when(given != "", given).otherwise(S.slugify(title))
        level = F.greatest(F.lit(1), F.least(F.lit(5), s["level"]))

        def settle(x: Column) -> Column:
            changed = x["wanted"] != x["final"]
            counters = each(acc["counters"], lambda c, i: F.when(i + 1 == level, c + 1).when(i + 1 > level, F.lit(0)).otherwise(c))
            path = F.concat(F.slice(acc["path"], 1, level - 1), F.array(x["final"]))
            found = listed(
                when((s["level"] < 1) | (s["level"] > 5), "heading-depth", title, s["level"]),
                when((acc["last"] > 0) & (level - acc["last"] > 1), "heading-skip", title, acc["last"], level),
                when(S.strip(title).rlike(P.HARDCODED_NUMBER), "heading-hardcoded-number", title),
                when(~S.is_identifier(first), "section-id-format", first, title),
                F.when(changed & (given != ""), say("section-id-duplicate", title, x["final"])).when(changed, say("anchor-autogen-collision", title, x["final"])),
                when(F.exists("attachment_lookup", lambda a: a["id"] == x["final"]), "attachment-id-collision", x["final"]),
            )
            entry = F.struct(title.alias("title"), x["final"].alias("identifier"), F.array_join(path, ".").alias("path"), level.alias("level"), S.section_number(counters, level).alias("number"))
            # Of the accumulator's type but for its fields' names, which the start gives: a cast would copy it at each step.
            return F.struct(F.concat(acc["used"], F.array(x["final"])), counters, path, level, F.concat(acc["entries"], F.array(entry.cast(ENTRY))), F.concat(acc["found"], F.filter(found, lambda d: d.isNotNull())))

        wanted = F.when(S.is_identifier(first), first).otherwise(S.slugify(first))
        return let(let(wanted, lambda w: F.struct(w.alias("wanted"), unused(w, acc["used"]).alias("final"))), settle)

    none = F.array().cast("array<string>")
    start = F.struct(none, F.array_repeat(F.lit(0), 6), none, F.lit(0), F.array().cast(f"array<{ENTRY}>"), listed()).cast(FOLD)
    return F.aggregate("sections", start, step)


def block_list() -> Column:
    """Every block of a document in order, with its section and its fragments, raw and masked."""

    def of_section(s: Column, i: Column) -> Column:
        def of_block(b: Column, j: Column) -> Column:
            return let(text_fragments(b), lambda raw: F.struct(i.alias("section"), j.alias("block"), b["kind"].alias("kind"), S.strip(b["target"]).alias("target"), S.strip(b["term"]).alias("term"), S.strip(b["definition_id"]).alias("definition_id"), raw.alias("raw"), each(raw, S.mask_literals).alias("masked")))

        return each(s["blocks"], of_block)

    return F.flatten(each(F.col("sections"), of_section))


def anchor_list() -> Column:
    """(section, id) of the trailing anchors, in order."""
    found = each(F.col("blocks"), lambda b: each(F.filter(b["masked"], lambda t: t.contains("{#") & t.rlike(P.TRAILING_ANCHOR)), lambda t: F.struct(b["section"].alias("section"), F.regexp_extract(t, P.TRAILING_ANCHOR, 1).alias("id"))))
    return F.flatten(found)


def accepted_anchors() -> Column:
    ids = F.col("__anchor_ids")
    kept = F.filter(firsts(ids), lambda i: S.is_identifier(F.get(ids, i)) & ~contains(F.col("__section_ids"), F.get(ids, i)))
    return each(kept, lambda i: F.get(F.col("anchors"), i))


def anchor_rules() -> Column:
    taken = lambda a, i: contains(F.col("__section_ids"), a["id"]) | (F.array_position("__anchor_ids", a["id"]) < i + 1)
    return each(F.col("anchors"), lambda a, i: F.when(~S.is_identifier(a["id"]), say("anchor-format", a["id"])).when(taken(a, i), say("anchor-duplicate", a["id"])))


def section_lookup() -> Column:
    """(key, section) of ids, dotted paths and anchors; of equal keys the last written counts."""
    own = F.flatten(each(F.col("section_index"), lambda e, i: F.array(F.struct(e["identifier"].alias("key"), i.alias("section")), F.struct(e["path"].alias("key"), i.alias("section")))))
    return F.concat(own, each(F.col("accepted_anchors"), lambda a: F.struct(a["id"].alias("key"), a["section"].alias("section"))))


# ---------------------------------------------------------------- definitions


def definition_matches(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({P.DEFINITION})"), F.lit(1))
    return F.when(text.contains("def:"), found).otherwise(F.array().cast("array<string>"))


def definition_list() -> Column:
    """Every definition in order: leading ones of definition blocks, then those inside fragments."""

    def ref(b: Column, term: Column, given: Column, inline: bool) -> Column:
        own = F.when(given != "", given).otherwise(S.slugify(term, "term"))
        shown = term if inline else F.when(term != "", term).otherwise(S.display_name(own))
        place = F.coalesce(F.get(F.col("section_index"), b["section"])["identifier"], F.lit(""))
        return F.struct(own.alias("id"), shown.alias("term"), place.alias("section_identifier"), b["block"].alias("block_index"), F.lit(inline).alias("inline"), (given == "").alias("auto_id")).cast(DEFINITION_REF)

    def of_block(b: Column) -> Column:
        leading = F.when(b["kind"] == "definition", F.array(ref(b, b["term"], b["definition_id"], False))).otherwise(F.array().cast(f"array<{DEFINITION_REF}>"))
        inside = F.flatten(each(b["raw"], lambda t: each(definition_matches(t), lambda m: ref(b, S.definition_term(m), S.definition_id(m), True))))
        return F.concat(leading, inside)

    return F.flatten(each(F.col("blocks"), of_block))


def own_definitions() -> Column:
    ids = F.col("__definition_ids")
    kept = F.filter(firsts(ids), lambda i: S.is_identifier(F.get(ids, i)))

    def entry(i: Column) -> Column:
        d = F.get(F.col("definitions"), i)
        return F.struct(d["id"].alias("id"), F.when(d["term"] != "", d["term"]).otherwise(S.display_name(d["id"])).alias("term"))

    return each(kept, entry).cast(TERMS)


def definition_rules() -> Column:
    refs, ids = F.col("definitions"), F.col("__definition_ids")

    def rules(d: Column, i: Column) -> Column:
        def by_place(place: Column) -> Column:
            first = F.get(refs, place - 1)
            other = d["auto_id"] & first["auto_id"] & (first["term"] != d["term"])
            again = F.when(other, say("def-autogen-collision", d["id"])).otherwise(say("def-duplicate-id", d["id"]))
            return F.when(~S.is_identifier(d["id"]), say("definition-id-format", d["id"], d["term"])).when(place < i + 1, again)

        return let(F.array_position(ids, d["id"]).cast("int"), by_place)

    return each(refs, rules)


def definition_form_rules() -> Column:
    def of_fragment(t: Column) -> Column:
        return F.when(t.contains("def:"), let(definition_matches(t), lambda found: forms(t, found))).otherwise(listed())

    def forms(t: Column, found: Column) -> Column:
        bare = F.size(F.regexp_extract_all(t, F.lit(f"({P.DEFINITION_TAG})"), F.lit(1))) - F.size(found)
        quoted = each(F.filter(found, S.is_single_quoted), lambda m: say("def-single-quote-ambiguous", S.definition_term(m)))
        return F.concat(listed(when(t.rlike(P.EMPHASISED_DEFINITION), "def-emphasis")), F.array_repeat(say("def-no-quoted-span"), F.greatest(bare, F.lit(0))), quoted)

    return F.flatten(each(F.col("blocks"), lambda b: F.flatten(each(b["raw"], of_fragment))))


def import_rules(m: Column) -> Column:
    """Definitions of the amended document and of attachments against those of this one."""
    override = F.filter("own_definitions", lambda d: F.exists("amended", lambda x: x["id"] == d["id"]))
    ids = each(F.col("attached"), lambda d: d["id"])
    clash = F.col("own_definitions"), F.col("amended")
    known = lambda d, i: F.exists(clash[0], lambda x: x["id"] == d["id"]) | F.exists(clash[1], lambda x: x["id"] == d["id"]) | (F.array_position(ids, d["id"]) < i + 1)
    attached = each(F.col("attached"), lambda d, i: when(known(d, i), "attachment-def-collision", d["id"], d["attachment"]))
    return F.concat(each(override, lambda d: say("amend-def-override", d["id"])), attached)


def definition_lookup() -> Column:
    added = F.filter("amended", lambda d: ~F.exists("own_definitions", lambda x: x["id"] == d["id"]))
    both = F.concat("own_definitions", added)
    ids = each(F.col("attached"), lambda d: d["id"])
    new = F.filter(firsts(ids), lambda i: ~F.exists(both, lambda x: x["id"] == F.get(ids, i)))
    return F.concat(both, each(new, lambda i: F.struct(F.get(F.col("attached"), i)["id"].alias("id"), F.get(F.col("attached"), i)["term"].alias("term")))).cast(TERMS)


# ---------------------------------------------------------------- placeholders


def structural_rules(m: Column) -> Column:
    bad = lambda value, label: when(S.is_placeholder(value), "placeholder-in-structural-field", label)
    quoted = lambda text, name: F.concat(F.lit(f"{text} '"), name, F.lit("'"))

    def side(s: Column) -> Column:
        parties = each(s["parties"], lambda p: listed(bad(p["name"], quoted("party name", p["name"])), bad(p["type"], quoted("party type for", p["name"]))))
        return F.concat(listed(bad(s["name"], quoted("side name", s["name"]))), F.flatten(parties))

    return F.concat(listed(bad(m["document_type"], F.lit("document_type"))), F.flatten(each(m["sides"], side)))


def value_fields(m: Column) -> Column:
    names = ("title", "subtitle", "version", "effective_date", "governing_law", "authoritative", "adopted_by", "adoption_date", "supersedes")

    def party(p: Column) -> Column:
        own = F.array(*[p[n] for n in ("label", "legal_name", "identification_number", "address", "date_of_birth")])
        return F.concat(own, each(p["representatives"], lambda r: r["name"]), each(p["representatives"], lambda r: r["title"]), each(p["custom_fields"], lambda c: c["value"]))

    return F.concat(F.array(*[m[n] for n in names]), F.flatten(each(m["sides"], lambda s: F.concat(F.array(s["label"]), F.flatten(each(s["parties"], party))))))


def placeholders_in(texts: Column) -> Column:
    """(id, type, currency) of every placeholder, in order."""
    found = F.flatten(each(F.filter(texts, S.is_placeholder), lambda t: matches(t, P.PLACEHOLDER, 3)))
    return each(found, lambda x: F.struct(x["g1"].alias("id"), F.when(x["g2"] == "", F.lit("text")).otherwise(x["g2"]).alias("type"), x["g3"].alias("currency")))


def placeholder_rules(found: Column) -> Column:
    """Checks of placeholders; the type of an id is that of its first valid use anywhere."""
    seen, types = F.col("placeholder_ids"), F.col("placeholder_types")

    def rules(x: Column) -> Column:
        first = F.get(types, (F.array_position(seen, x["id"]) - 1).cast("int"))
        known = listed(
            when(first != x["type"], "placeholder-type-inconsistent", x["id"], first, x["type"]),
            when((x["type"] == "money") & (x["currency"] != "") & ~x["currency"].isin(*P.CURRENCIES), "placeholder-unknown-currency", x["id"], x["currency"]),
        )
        return F.when(~S.is_identifier(x["id"]), listed(say("placeholder-id-malformed", x["id"]))).when(~x["type"].isin(*P.PLACEHOLDER_TYPES), listed(say("placeholder-type-invalid", x["type"]))).otherwise(known)

    return F.flatten(each(found, rules))


# ---------------------------------------------------------------- directives


def value_rules(t: Column, m: Column) -> Column:
    """Checks of all directives of a fragment, kind by kind."""
    has = lambda name, rules: part(lambda: F.when(t.contains(f"{{{{{name}:"), rules()).otherwise(listed()))
    unknown = lambda: each(matches(t, P.DIRECTIVE_NAME, 1), lambda x: when(~x["g1"].isin(*P.KNOWN_DIRECTIVES), "directive-unknown", x["g1"], x["g1"]))
    dates = lambda: each(matches(t, P.DATE, 1), lambda x: when(~S.is_iso_date(x["g1"]), "date-invalid", x["g1"]))
    money = lambda: F.flatten(each(matches(t, P.MONEY, 2), lambda x: listed(when(~S.is_money_amount(x["g1"]), "money-invalid-amount", x["g1"]), F.when(x["g2"] == "", say("money-missing-currency")).when(~x["g2"].isin(*P.CURRENCIES), say("money-unknown-currency", x["g2"])))))
    unit = lambda u: F.when(u == "", say("duration-unit-missing")).when(u == "M", say("duration-unit-m")).when(~u.isin(*P.DURATION_UNITS), say("duration-unit-unknown", u))
    durations = lambda: F.flatten(each(matches(t, P.DURATION, 2), lambda x: listed(when(~S.is_positive(x["g1"]), "duration-invalid-value", x["g1"]), unit(x["g2"]))))
    known = lambda lookup, x: F.exists(lookup, lambda e: e["id"] == x)
    parties = lambda: each(matches(t, P.PARTY, 1), lambda x: F.when(~S.is_identifier(x["g1"]), say("party-name-malformed", x["g1"])).when(~known("party_lookup", x["g1"]), say("party-unknown", x["g1"])))
    sides = lambda: each(matches(t, P.SIDE, 1), lambda x: F.when(~S.is_identifier(x["g1"]), say("side-name-malformed", x["g1"])).when(~known("side_lookup", x["g1"]), say("side-unknown", x["g1"])))
    declared = m["field_types"]
    undeclared = lambda kind: (F.size(declared) > 0) & ~F.exists(declared, lambda f: f["key"] == kind)
    fields = lambda: each(matches(t, P.FIELD, 2), lambda x: F.when(x["g2"] == "", say("field-type-missing")).when(~S.is_identifier(x["g2"]), say("field-type-malformed", x["g2"])).when(undeclared(x["g2"]), say("field-type-undeclared", x["g2"])))
    attached = lambda: each(matches(t, P.ATTACH, 1), lambda x: when(~known("attachment_lookup", x["g1"]), "attach-undeclared", x["g1"]))
    raw_notes = each(F.regexp_extract_all(t, F.lit(f"({P.NOTE})"), F.lit(1)), lambda x: F.regexp_extract(x, P.NOTE, 1))
    notes = lambda: each(raw_notes, lambda x: F.when(x.contains(","), say("note-separators")).when(x.rlike(P.MARKDOWN_IN_NOTE), say("note-markdown")))
    own = F.concat(
        part(unknown), has("date", dates), has("money", money), has("duration", durations), has("party", parties), has("side", sides), has("field", fields),
        has("placeholder", lambda: placeholder_rules(placeholders_in(F.array(t)))), has("attach", attached), part(lambda: F.when(t.contains("note="), notes()).otherwise(listed())),
    )
    return F.when(t.contains("{{"), own).otherwise(listed())


def targets(b: Column, kind: str, pattern: str) -> Column:
    """Targets of references or terms of a block: its own, then those in its fragments."""
    own = F.when((b["kind"] == kind) & (b["target"] != ""), F.array(b["target"])).otherwise(F.array().cast("array<string>"))
    inside = F.flatten(each(F.filter(b["masked"], lambda t: t.contains(f"{{{{{kind}:")), lambda t: each(matches(t, pattern, 1), lambda x: x["g1"])))
    return F.concat(own, inside)


def directive_rules(m: Column) -> Column:
    keys = F.col("section_keys")
    attached = lambda t: F.exists("attachment_lookup", lambda a: a["id"] == t)
    defined = lambda t: contains(F.col("__defined_ids"), t)
    undefined = lambda t: F.when(m["amends"].isNull(), say("term-undefined", t)).when(F.col("consulted"), say("amend-term-undefined", t)).otherwise(say("amend-term-unresolvable", t))

    def of_block(b: Column) -> Column:
        refs = lambda: each(targets(b, "ref", P.REF), lambda t: F.when(contains(keys, t), F.lit(None)).otherwise(F.when(attached(t), say("ref-targets-attachment", t, t)).otherwise(say("ref-broken", t)))).cast(DIAGNOSTICS)
        terms = lambda: each(targets(b, "term", P.TERM), lambda t: F.when(~defined(t), undefined(t))).cast(DIAGNOSTICS)
        values = lambda: F.flatten(each(b["masked"], lambda t: value_rules(t, m)))
        return F.concat(*map(part, (values, refs, terms)))

    return F.flatten(each(F.col("blocks"), of_block))


def unreferenced_rules(m: Column) -> Column:
    attachments = lambda: each(F.filter(m["attachments"], lambda a: (a["id"] != "") & ~contains(F.col("used_attachments"), a["id"])), lambda a: say("attachment-unreferenced", a["id"]))
    declared = F.array_intersect(F.col("__definition_ids"), F.col("__defined_ids"))
    unused = F.array_except(declared, F.col("used_terms"))
    return F.concat(part(attachments), part(lambda: each(unused, lambda i: say("def-unreferenced", i))))


# ---------------------------------------------------------------- the plan


def is_markup(file: Column) -> Column:
    found = F.lit(False)
    for extension in P.MARKUP_EXTENSIONS:
        found = found | file.endswith(extension)
    return found


def with_imports(parsed: DataFrame, amended: DataFrame | None, attached: DataFrame | None) -> DataFrame:
    """Adds what other documents define.

    ``amended``: (amends_file, current_filename, consulted, definitions array<struct<id,term>>), one row per
    pair that was looked up; ``attached``: (file, definitions), one row per attachment file.
    """
    docs = parsed
    empty = F.array().cast(TERMS)
    if amended is not None:
        keyed = amended.select(F.col("amends_file").alias("__file"), F.col("current_filename").alias("__name"), F.col("consulted").alias("__consulted"), F.col("definitions").alias("__defs"))
        docs = docs.join(keyed, is_markup(docs["metadata.amends.file"]) & (docs["metadata.amends.file"] == keyed["__file"]) & (docs["filename"] == keyed["__name"]), "left")
        ok = F.coalesce(F.col("__consulted"), F.lit(False))
        docs = docs.withColumns({"consulted": ok, "amended": F.when(ok, F.coalesce("__defs", empty)).otherwise(empty)}).drop("__file", "__name", "__consulted", "__defs")
    else:
        docs = docs.withColumns({"consulted": F.lit(False), "amended": empty})
    kind = "array<struct<id:string,term:string,attachment:string>>"
    if attached is None:
        return docs.withColumn("attached", F.array().cast(kind))
    wanted = docs.select("doc_id", F.posexplode("metadata.attachments").alias("at", "a")).where(is_markup(F.col("a.file"))).select("doc_id", "at", F.col("a.id").alias("attachment"), F.col("a.file").alias("file"))
    found = wanted.join(attached.select("file", "definitions"), "file").select("doc_id", "at", F.transform("definitions", lambda d: F.struct(d["id"].alias("id"), d["term"].alias("term"), F.col("attachment").alias("attachment"))).alias("defs"))
    gathered = found.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "defs"))), lambda x: x["defs"])).alias("attached"))
    return docs.join(gathered, "doc_id", "left").withColumn("attached", F.coalesce("attached", F.array().cast(kind)))


def pin(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once, in this step."""
    return docs.withColumns({name: S.pinned(column) for name, column in columns.items()})


def steps(rules: frozenset[str] | None = None) -> list[dict[str, Column]]:
    """The columns of a validation, each step standing on the ones before; with ``rules``, diagnostics of those, and of others only where they come with them."""
    _wanted[0] = rules
    try:
        return _built_steps()
    finally:
        _wanted[0] = None


def _built_steps() -> list[dict[str, Column]]:
    m = F.col("metadata")
    body = F.filter(F.flatten(each(F.col("blocks"), lambda b: b["masked"])), lambda t: t.contains("{{"))
    of_body = lambda pattern, groups, pick: F.flatten(each(body, lambda t: each(matches(t, pattern, groups), pick)))
    valid = F.filter("placeholders", lambda x: S.is_identifier(x["id"]) & x["type"].isin(*P.PLACEHOLDER_TYPES))
    _said.append(set())
    fold, said = section_fold(), _said.pop()
    headings = F.col("__fold.found") if _wanted[0] is None or said & _wanted[0] else listed()
    found = F.concat(
        metadata_rules(m), headings, part(anchor_rules), part(definition_rules), part(definition_form_rules), part(lambda: import_rules(m)),
        part(lambda: structural_rules(m)), part(lambda: placeholder_rules(F.col("__front"))), part(lambda: directive_rules(m)), unreferenced_rules(m),
    )
    failed = listed(say("frontmatter-invalid-yaml", F.coalesce("error", F.lit(""))))
    return [
        side_columns(m) | attachment_columns(m),
        {"__fold": fold},
        {"section_index": F.col("__fold.entries"), "blocks": block_list(), "__section_ids": F.transform("__fold.entries", lambda e: e["identifier"])},
        {"anchors": anchor_list(), "definitions": definition_list()},
        {"__anchor_ids": F.transform("anchors", lambda a: a["id"]), "__definition_ids": F.transform("definitions", lambda d: d["id"])},
        {"accepted_anchors": accepted_anchors(), "own_definitions": own_definitions()},
        {"section_lookup": section_lookup(), "definition_lookup": definition_lookup()},
        {
            "section_keys": F.transform("section_lookup", lambda e: e["key"]),
            "__defined_ids": F.transform("definition_lookup", lambda d: d["id"]),
            "__front": placeholders_in(value_fields(m)),
            "__body": placeholders_in(body),
            "used_terms": F.array_distinct(F.flatten(each(F.col("blocks"), lambda b: targets(b, "term", P.TERM)))),
            "used_refs": F.array_distinct(F.flatten(each(F.col("blocks"), lambda b: targets(b, "ref", P.REF)))),
            "used_attachments": F.array_distinct(of_body(P.ATTACH, 1, lambda x: x["g1"])),
            "dates": of_body(P.DATE, 1, lambda x: x["g1"]),
            "money": of_body(P.MONEY, 2, lambda x: F.struct(x["g1"].alias("amount"), x["g2"].alias("currency"))),
            "durations": of_body(P.DURATION, 2, lambda x: F.struct(x["g1"].alias("value"), x["g2"].alias("unit"))),
            "fields": of_body(P.FIELD, 2, lambda x: F.struct(x["g1"].alias("value"), x["g2"].alias("type"))),
        },
        {"placeholders": F.concat("__front", "__body")},
        {"placeholder_ids": F.transform(valid, lambda x: x["id"]), "placeholder_types": F.transform(valid, lambda x: x["type"])},
        {"diagnostics": F.when(F.col("ok"), F.filter(found, lambda d: d.isNotNull())).otherwise(failed)},
    ]


#: The steps of each application: building expressions takes many calls to the JVM, and they fit any input.
_steps: dict[tuple[str, frozenset[str] | None], list[dict[str, Column]]] = {}


def validate(parsed: DataFrame, amended: DataFrame | None = None, attached: DataFrame | None = None, rules: Iterable[str] | None = None) -> DataFrame:
    """Adds to parsed documents their indices and ``diagnostics``, an array in the order of report.

    With ``rules``, the diagnostics of those are all there, at the price of what they stand on; others may be absent.
    """
    key = (parsed.sparkSession.sparkContext.applicationId, None if rules is None else frozenset(rules))
    if key not in _steps:
        _steps[key] = steps(key[1])
    docs = with_imports(parsed, amended, attached)
    for columns in _steps[key]:
        docs = pin(docs, columns)
    return docs.drop("__fold", "__front", "__body", "__section_ids", "__anchor_ids", "__definition_ids", "__defined_ids", "placeholder_ids", "placeholder_types", "side_names", "party_names", "anchors")
