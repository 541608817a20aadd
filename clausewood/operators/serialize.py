"""Parsed documents back to source text, in canonical form.

Of parsed rows the YAML head is one Arrow function over the metadata and the body is
built-in functions; ``canonical`` goes from source text to source text in one Arrow
function, so that neither metadata nor sections become rows. The form is normal, not byte-equal: ``include_signatures`` is never
written, ``date_of_birth`` only for natural persons, custom fields as plain keys of
their party, incomplete attachments not at all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewood.functions.patterns import WS
from clausewood.functions import scalars as S
from clausewood.functions.scalars import pinned, strip
from clausewood.operators.body import Block, Section, display_name, parse_body, split_lines
from clausewood.operators.frontmatter import WORDS, NotSimple, read_metadata, split_source
from clausewood.runtime import ship

# ---------------------------------------------------------------- head


def filled(record: dict[str, Any], *names: str) -> dict[str, Any]:
    """The named fields that aren't empty, in that order."""
    return {n: record[n] for n in names if record.get(n)}


def mapping(pairs: list[dict[str, str]]) -> dict[str, str]:
    return {p["key"]: p["value"] for p in pairs}


def party_head(p: dict[str, Any]) -> dict[str, Any]:
    out = {"name": p["name"], **filled(p, "label", "type", "legal_name", "identification_number", "address")}
    if p["type"] == "natural_person":
        out |= filled(p, "date_of_birth")
    people = [person for r in p["representatives"] if (person := filled(r, "name", "title"))]
    if people:
        out["representatives"] = people
    return out | {c["label"]: c["value"] for c in p["custom_fields"] if c["label"] and c["value"]}


def side_head(s: dict[str, Any]) -> dict[str, Any] | None:
    """A side with its named parties; none without any."""
    parties = [party_head(p) for p in s["parties"] if p["name"] or p["legal_name"]]
    return {"name": s["name"], **filled(s, "label"), "parties": parties} if parties else None


def head(m: dict[str, Any]) -> dict[str, Any]:
    """The frontmatter of a metadata record, in its fixed order of keys."""
    out = {"title": m["title"], **filled(m, "subtitle", "version")}
    if m["document_type"] not in ("", "contract"):
        out["document_type"] = m["document_type"]
    out |= filled(m, "effective_date")
    if m["field_types"]:
        out["field_types"] = mapping(m["field_types"])
    if m.get("amends"):
        out["amends"] = {"title": m["amends"]["title"], **filled(m["amends"], "file")}
    sides = [side for s in m["sides"] if (side := side_head(s))]
    if sides:
        out["sides"] = sides
    out |= filled(m, "governing_law") | {"language": m["language"]}
    if m["translations"]:
        out["translations"] = mapping(m["translations"])
    out |= filled(m, "authoritative", "adopted_by", "adoption_date", "supersedes")
    if m["attachments"]:
        out["attachments"] = [dict(a) for a in m["attachments"] if a["id"] and a["title"] and a["file"]]
    return out | filled(m, "tags")


#: Scalars that YAML writes as they are: words of ASCII that begin with a letter; and dates, which it quotes. Longer lines may be folded.
_PLAIN = re.compile("[A-Za-z][A-Za-z0-9_./#-]*(?: [A-Za-z0-9_./-][A-Za-z0-9_./#-]*)*")
_DATE = re.compile("[0-9]{4}-[0-9]{2}-[0-9]{2}")
_LONGEST = 70


def _scalar(value: str, room: int) -> str:
    if len(value) > room:
        raise NotSimple
    if _PLAIN.fullmatch(value) and value.lower() not in WORDS:
        return value
    if not value or _DATE.fullmatch(value):
        return f"'{value}'"
    raise NotSimple


def _write(record: dict[str, Any], indent: str, out: list[str]) -> None:
    """The lines of a mapping that has only strings, mappings and lists of either; NotSimple if one needs the library."""
    if not record:
        raise NotSimple
    for key, value in record.items():
        room = _LONGEST - len(indent) - len(key)
        if not key or _scalar(key, _LONGEST) != key:
            raise NotSimple
        if isinstance(value, str):
            out.append(f"{indent}{key}: {_scalar(value, room)}")
            continue
        out.append(f"{indent}{key}:")
        if isinstance(value, dict):
            _write(value, f"{indent}  ", out)
        elif not value:
            raise NotSimple
        else:
            for item in value:
                at = len(out)
                if isinstance(item, str):
                    out.append(f"{indent}- {_scalar(item, room)}")
                else:
                    _write(item, f"{indent}  ", out)
                    out[at] = f"{indent}- {out[at].lstrip(' ')}"


def head_text(record: dict[str, Any]) -> str:
    """The YAML of a head, simple ones line by line, others by the library."""
    out: list[str] = []
    try:
        _write(record, "", out)
    except NotSimple:
        return yaml.safe_dump(record, sort_keys=False, allow_unicode=True).strip()
    return "\n".join(out)


def dump(metadata: str) -> str:
    return head_text(head(json.loads(metadata)))


# ---------------------------------------------------------------- body


def joined(items: Column, separator: str) -> Column:
    return F.array_join(items, separator)


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), joined(cells, " | "), F.lit(" |"))


def render_block(b: Column) -> Column:
    """The source text of one block."""
    term = F.when(strip(b["term"]) != "", strip(b["term"])).otherwise(S.display_name(b["definition_id"]))
    given = strip(b["definition_id"])
    anchor = F.concat(F.lit('"'), term, F.lit('" {{def:'), F.when(given != "", F.concat(F.lit(" "), given)).otherwise(F.lit("")), F.lit("}}"))
    said = strip(b["text"])
    option = lambda name, value: F.when(value != "", F.concat(F.lit(f", {name}="), value)).otherwise(F.lit(""))
    link = lambda name, extra: strip(F.concat(b["prefix"], F.lit(f"{{{{{name}: "), b["target"], extra, F.lit("}}"), b["suffix"]))
    items = F.filter(b["items"], lambda i: strip(i) != "")
    lines = split_lines(b["text"])
    quoted = F.transform(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(""))), lambda line: F.regexp_replace(F.concat(F.lit("> "), line), rf"{WS}+\z", ""))
    headers = F.transform(b["headers"], lambda h, i: F.when(strip(h) != "", strip(h)).otherwise(F.concat(F.lit("Column "), (i + 1).cast("string"))))
    width = F.size(headers)
    rows = F.transform(b["rows"], lambda r: table_row(F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), 1, width), strip)))
    table = joined(F.concat(F.array(table_row(headers), table_row(F.array_repeat(F.lit("---"), width))), rows), "\n")
    kind = b["kind"]
    return (
        F.when(kind == "definition", F.when(said != "", F.concat(anchor, F.lit(" "), said)).otherwise(anchor))
        .when(kind == "ref", link("ref", option("format", b["format"])))
        .when(kind == "term", link("term", option("label", b["label"])))
        .when(kind == "unordered_list", joined(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n"))
        .when(kind == "ordered_list", joined(F.transform(items, lambda i, n: F.concat((n + 1).cast("string"), F.lit(". "), i)), "\n"))
        .when(kind == "quote", joined(quoted, "\n"))
        .when(kind == "table", table)
        .when(kind == "rule", F.lit("---"))
        .otherwise(said)
    )


def render_section(s: Column) -> Column:
    """Heading and blocks, each behind an empty line."""
    given = strip(s["identifier"])
    heading = F.concat(F.repeat(F.lit("#"), s["level"]), F.lit(" "), strip(s["title"]), F.when(given != "", F.concat(F.lit(" {#"), given, F.lit("}"))).otherwise(F.lit("")))
    blocks = F.filter(F.transform(s["blocks"], render_block), lambda t: t != "")
    return joined(F.flatten(F.transform(F.concat(F.array(heading), blocks), lambda t: F.array(F.lit(""), t))), "\n")


# ---------------------------------------------------------------- text to text


def block_text(b: Block) -> str:
    """``render_block`` of a block of ``parse_body``."""
    kind, said = b["kind"], b.get("text", "").strip()
    if kind == "definition":
        own, given = b.get("definition_id", ""), b.get("definition_id", "").strip()
        return f"\"{b.get('term', '').strip() or display_name(own)}\" {{{{def:{given and ' ' + given}}}}} {said}".rstrip()
    if kind in ("ref", "term"):
        name = "format" if kind == "ref" else "label"
        option = f", {name}={b[name]}" if b.get(name) else ""
        return f"{b.get('prefix', '')}{{{{{kind}: {b['target']}{option}}}}}{b.get('suffix', '')}".strip()
    if kind in ("unordered_list", "ordered_list"):
        items = [item for item in b["items"] if item.strip()]
        return "\n".join(f"- {item}" if kind == "unordered_list" else f"{n}. {item}" for n, item in enumerate(items, 1))
    if kind == "quote":
        return "\n".join(f"> {line}".rstrip() for line in b["text"].splitlines() or [""])
    if kind == "table":
        headers = [header.strip() or f"Column {n}" for n, header in enumerate(b["headers"], 1)]
        rows = [[cell.strip() for cell in [*row, *[""] * len(headers)][: len(headers)]] for row in b["rows"]]
        return "\n".join("| " + " | ".join(cells) + " |" for cells in (headers, ["---"] * len(headers), *rows))
    return "---" if kind == "rule" else said


def document_text(m: dict[str, Any], sections: list[Section]) -> str:
    """What ``serialize`` gives of a document."""
    parts = ["---", head_text(head(m)), "---"]
    for title, level, identifier, blocks in sections:
        given = identifier.strip()
        parts += ["", f"{'#' * level} {title.strip()}" + (f" {{#{given}}}" if given else "")]
        for text in map(block_text, blocks):
            if text:
                parts += ["", text]
    return "\n".join(parts).strip() + "\n"


def canonical_text(source: str) -> str | None:
    """The canonical form of a source text; None if its frontmatter can't be loaded."""
    front, body = split_source(source)
    metadata, _ = read_metadata(front)
    return None if metadata is None else document_text(metadata, parse_body(body))


def canonical(docs: DataFrame) -> DataFrame:
    """Adds to rows with ``source`` what ``serialize`` gives of them once they are parsed."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def read(sources: pa.Array) -> pa.Array:
        return pa.array([canonical_text(source) for source in sources.to_pylist()], pa.string())

    return docs.withColumn("serialized", pinned(read(F.coalesce("source", F.lit("")))))


# ---------------------------------------------------------------- rows to text


def serialize(parsed: DataFrame) -> DataFrame:
    """Adds ``serialized``, the source text of each parsed document; null where loading failed."""
    ship(parsed.sparkSession)

    @F.pandas_udf("string")
    def yaml_head(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for records in batches:
            yield pd.Series([None if r is None else dump(r) for r in records], dtype=object)

    docs = parsed.withColumn("__head", yaml_head(F.to_json("metadata", {"ignoreNullFields": "false"})))
    sections = F.transform("sections", render_section)
    text = joined(F.concat(F.array(F.lit("---"), F.col("__head"), F.lit("---")), sections), "\n")
    return docs.withColumn("serialized", pinned(F.when(F.col("ok"), F.concat(strip(text), F.lit("\n"))))).drop("__head")


def to_dicts(parsed: DataFrame) -> DataFrame:
    """(doc_id, document): each parsed document as JSON; pairs become objects."""
    as_map = lambda c: F.map_from_entries(c)
    m = F.col("metadata").withField("field_types", as_map(F.col("metadata.field_types"))).withField("translations", as_map(F.col("metadata.translations")))
    return parsed.select("doc_id", F.to_json(F.struct(m.alias("metadata"), "sections", "filename"), {"ignoreNullFields": "false"}).alias("document"))
