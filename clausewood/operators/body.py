"""The body: lines to sections to blocks, by one Arrow function over whole texts.

Each line of a section gets a letter for its kind, a capital if it is indented.
The blocks are then the matches of one regular expression over the letters, and
each match is a slice of the lines:

    _ blank   r rule   q quote   t table   u bullet   o number   p other text

A paragraph takes every line up to a blank one; a list takes lines of its own
marker and indented ones; quotes and tables take runs; a rule stands alone.

The same as higher-order functions inside the row took some seven times the CPU:
Spark interprets those, node by node, for each line. The fields of all blocks of a
batch are gathered in plain lists, one per field, and become Arrow arrays at once.
"""

from __future__ import annotations

import functools
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewood.functions import patterns as P
from clausewood.functions.scalars import let, pinned
from clausewood.runtime import ship
from clausewood.schema import BLOCK_FIELDS, SECTIONS

SIGNATURE_TITLE, SIGNATURE_ID = "Signature Block", "signature-block"


def compiled(pattern: str) -> re.Pattern[str]:
    """A pattern of ``patterns`` for Python, whose only line end is a line feed anyway."""
    return re.compile(pattern.replace("(?d)", "").replace("(?dsm)", "(?sm)").replace(P.DIGIT, r"\d").replace(P.WORD, r"\w"))


_BLOCKS = re.compile("_+|[rR]|[qQ]+|[tT]+|[uU][uRQTUOP]*|[oO][oRQTUOP]*|[pP][^_]*")
_BULLET, _NUMBER = compiled(rf"\A{P.WS}*-{P.WS}+"), compiled(rf"\A{P.WS}*{P.DIGIT}+\.{P.WS}+")
_ITEM = compiled(rf"\A{P.WS}*(?:{P.DIGIT}+\.|-){P.WS}+(.*)$")
_HEADING, _REF_BLOCK, _TERM_BLOCK = compiled(P.HEADING), compiled(P.REF_BLOCK), compiled(P.TERM_BLOCK)
_LEADING, _EMPHASISED, _SINGLE_QUOTED = compiled(rf"\A{P.DEFINITION}"), compiled(rf"\A{P.EMPHASISED_DEFINITION}"), compiled(P.SINGLE_QUOTED)
_NOT_IN_SLUG, _SLUG_GAP = re.compile(rf"[^a-z0-9_\-{P.WS[1:-1]}]"), re.compile(rf"(?:{P.WS}|_)+")


def split_lines(text: Column) -> Column:
    """The lines of a text, whatever ends them; a last line end opens no further line."""
    odd = text.rlike(P.ODD_LINE_END)
    lines = F.when(odd, F.split(text, P.LINE_END)).otherwise(F.split(text, "\n"))
    return let(lines, lambda x: F.when((F.element_at(x, -1) == "") & (F.size(x) > 0), F.slice(x, 1, F.size(x) - 1)).otherwise(x))


# ---------------------------------------------------------------- blocks

Block = dict[str, Any]
Section = tuple[str, int, str, list[Block]]


def _letter(line: str) -> str:
    bare = line.strip()
    if not bare:
        return "_"
    first = bare[0]
    if first == "-":
        kind = "r" if bare == "---" else "u" if _BULLET.match(line) else "p"
    else:
        kind = "q" if first == ">" else "t" if first == "|" else "o" if first.isdecimal() and _NUMBER.match(line) else "p"
    return kind.upper() if line.startswith(("  ", "\t")) else kind


def _quote(lines: list[str]) -> Block:
    return {"kind": "quote", "text": "\n".join(line.lstrip()[1:].lstrip() for line in lines).strip()}


def _table(lines: list[str]) -> Block | None:
    """A table of one line gives none."""
    if len(lines) < 2:
        return None
    rows = [[cell.strip() for cell in line.strip().strip("|").split("|")] for line in lines]
    return {"kind": "table", "headers": [h for h in rows[0] if h], "rows": [row for row in rows[2:] if any(row)]}


def _list(lines: list[str], kind: str) -> Block:
    """An item is a marker line and the lines up to the next one."""
    items: list[list[str]] = []
    for line in lines:
        found = _ITEM.match(line)
        if found:
            items.append([found[1].strip()])
        elif items:
            items[-1].append(line.strip())
    return {"kind": kind, "items": [text for item in items if (text := " ".join(item).strip())] or [""]}


def _paragraph(lines: list[str]) -> Block:
    """A definition, a reference, a term or plain text, by the first pattern that fits."""
    said = " ".join(lines).strip()
    if "def:" in said and (found := _LEADING.match(said)) and not _EMPHASISED.match(said) and not _SINGLE_QUOTED.match(found[0]):
        *terms, given = found.groups("")
        return {"kind": "definition", "definition_id": given.strip(), "term": next(filter(None, terms), "").strip(), "text": said[found.end() :].strip()}
    if "{{ref:" in said and (found := _REF_BLOCK.match(said)) and (target := found[2].strip()):
        return {"kind": "ref", "prefix": found[1], "target": target, "format": (found[3] or "").strip(), "suffix": found[4]}
    if "{{term:" in said and (found := _TERM_BLOCK.match(said)) and (target := found[2].strip()):
        return {"kind": "term", "prefix": found[1], "target": target, "label": (found[3] or "").strip(), "suffix": found[4]}
    return {"kind": "paragraph", "text": said}


def section_blocks(lines: list[str]) -> list[Block]:
    """The blocks of a section's lines."""
    chunk = "\n".join(lines).strip()
    if not chunk:
        return []
    own, out = chunk.split("\n"), []
    for run in _BLOCKS.finditer("".join(map(_letter, own))):
        letter, part = run[0][0].lower(), own[run.start() : run.end()]
        if letter == "p":
            out.append(_paragraph(part))
        elif letter == "u" or letter == "o":
            out.append(_list(part, "unordered_list" if letter == "u" else "ordered_list"))
        elif letter == "t":
            out.append(_table(part))
        elif letter == "q":
            out.append(_quote(part))
        elif letter == "r":
            out.append({"kind": "rule"})
    return [b for b in out if b is not None]


# ---------------------------------------------------------------- sections


@functools.lru_cache(4096)
def slug(title: str, fallback: str = "section") -> str:
    """``scalars.slugify``."""
    cut = _SLUG_GAP.sub("-", _NOT_IN_SLUG.sub("", title.lower())).strip("-")[:64]
    if not cut:
        return fallback
    return cut if "a" <= cut[0] <= "z" else f"{fallback}-{cut}"[:64].strip("-")


def display_name(identifier: str) -> str:
    """An identifier for display: hyphens become blanks, words get capitals."""
    return identifier.replace("-", " ").title()


def parse_body(body: str) -> list[Section]:
    """(title, level, identifier, blocks) of the sections of a body; lines before the first heading and from the signature block on don't count."""
    lines, heads = body.splitlines(), []
    for at, line in enumerate(lines):
        if line[:1] == "#" and (found := _HEADING.match(line)):
            title, given = found[2].strip(), found[3] or ""
            if given == SIGNATURE_ID and title == SIGNATURE_TITLE:
                del lines[at:]
                break
            heads.append((at, len(found[1]), title, given))
    stops = [*(head[0] for head in heads), len(lines)][1:]
    return [(title or "New Section", level, given or slug(title), section_blocks(lines[at + 1 : stop])) for (at, level, title, given), stop in zip(heads, stops, strict=True)]


def _lists(values: list[list[object]], inside: pa.Array | None = None) -> pa.ListArray:
    """Lists as an Arrow array; ``inside``, if given, holds all their elements."""
    offsets, flat, end = [0], [], 0
    for value in values:
        end += len(value)
        offsets.append(end)
        if inside is None:
            flat += value
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.string()) if inside is None else inside)


def sections_array(bodies: pa.Array) -> pa.Array:
    """The sections of each body."""
    parsed = [parse_body(body) for body in bodies.to_pylist()]
    sections = [s for document in parsed for s in document]
    blocks = [b for s in sections for b in s[3]]
    fields = []
    for name in BLOCK_FIELDS:
        if name == "rows":
            rows = [b.get(name, ()) for b in blocks]
            fields.append(_lists(rows, _lists([row for of_block in rows for row in of_block])))
        elif name in ("items", "headers"):
            fields.append(_lists([b.get(name, ()) for b in blocks]))
        else:
            fields.append(pa.array([b.get(name, "") for b in blocks], pa.string()))
    titles, levels, identifiers = (pa.array([s[i] for s in sections], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string())))
    own = _lists([s[3] for s in sections], pa.StructArray.from_arrays(fields, list(BLOCK_FIELDS)))
    return _lists(parsed, pa.StructArray.from_arrays([titles, levels, identifiers, own], ["title", "level", "identifier", "blocks"]))


def parse_sections(body: Column) -> Column:
    """The sections of a body."""

    @F.arrow_udf(SECTIONS)
    def read(bodies: pa.Array) -> pa.Array:
        return sections_array(bodies)

    return read(body)


def with_sections(docs: DataFrame) -> DataFrame:
    """Adds ``sections`` to rows of ``with_metadata``, or any with ``ok`` and ``body``; documents that failed to load have none."""
    ship(docs.sparkSession)
    if "__sections" not in docs.columns:
        docs = docs.withColumn("__sections", parse_sections(F.col("body")))
    return docs.withColumn("sections", pinned(F.when(F.col("ok"), F.col("__sections")).otherwise(F.array().cast(SECTIONS)))).drop("__sections")
