"""YAML frontmatter: split off in SQL, loaded by one Arrow function, coerced by a table of fields.

Spark has no YAML reader, so loading is the one Python step of the parser. Each
text gives JSON of the fixed metadata schema or the loader's message; a bad
document is a row, never a failed job.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewood.functions import patterns as P
from clausewood.functions.scalars import pinned
from clausewood.operators.body import compiled, parse_sections
from clausewood.runtime import ship
from clausewood.schema import METADATA


class TextDates(yaml.SafeLoader):
    """YAML 1.1 whose timestamps stay text."""


class FastTextDates(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """The same by the C library, where there is one."""


for _loader in (TextDates, FastTextDates):
    _loader.add_constructor("tag:yaml.org,2002:timestamp", lambda loader, node: loader.construct_scalar(node))

# ---------------------------------------------------------------- coercion


def text(value: Any, default: str = "") -> str:
    """Any value as stripped text; false values and blanks give the default."""
    return (str(value).strip() if value else "") or default


def texts(values: Any) -> list[str]:
    return [s for s in (str(v).strip() for v in values) if s]


def flag(value: Any, default: bool) -> bool:
    if value is None or isinstance(value, bool):
        return default if value is None else value
    return str(value).strip().lower() in ("1", "true", "yes", "on")


def pairs(value: Any) -> list[dict[str, str]]:
    """A mapping as ordered pairs; false keys and values drop out, of equal stripped keys the last wins."""
    if not isinstance(value, dict):
        return []
    kept: dict[str, str] = {str(k).strip(): str(v).strip() for k, v in value.items() if k and v}
    return [{"key": k, "value": v} for k, v in kept.items()]


def tags(value: Any) -> list[str]:
    given = value or []
    return texts(given.split(",") if isinstance(given, str) else list(given))


Reader = Callable[[Any], Any]


def record(fields: dict[str, Reader]) -> Callable[[dict], dict]:
    return lambda given: {name: read(given.get(name)) for name, read in fields.items()}


def records(fields: dict[str, Reader], *, lists_only: bool = False) -> Reader:
    """The mappings among the elements of a list; a number in its place is an error unless only lists count."""
    read = record(fields)

    def run(value: Any) -> list[dict]:
        if lists_only and not isinstance(value, list):
            return []
        return [read(x) for x in list(value or []) if isinstance(x, dict)]

    return run


PERSON = {"name": text, "title": text}
LABELLED = {"label": text, "value": text}
PARTY_FIELDS: dict[str, Reader] = {
    "name": text, "label": text, "type": text, "legal_name": text, "identification_number": text, "address": text,
    "date_of_birth": text, "representatives": records(PERSON), "custom_fields": records(LABELLED),
}
SIDE_FIELDS: dict[str, Reader] = {"name": text, "label": text, "parties": records(PARTY_FIELDS)}
ORIGINAL = record({"title": text, "file": text})
METADATA_FIELDS: dict[str, Reader] = {
    "tags": tags,
    "sides": records(SIDE_FIELDS, lists_only=True),
    "amends": lambda v: ORIGINAL(v) if isinstance(v, dict) else None,
    "attachments": records({"id": text, "title": text, "file": text}),
    "title": text, "subtitle": text, "version": text,
    "document_type": lambda v: text(v, "contract"),
    "effective_date": text, "field_types": pairs, "governing_law": text,
    "language": lambda v: text(v, "en"),
    "include_signatures": lambda v: flag(v, True),
    "translations": pairs, "authoritative": text, "adopted_by": text, "adoption_date": text, "supersedes": text,
}


def coerce_metadata(given: Any) -> dict:
    """The metadata record of whatever the YAML held; anything but a mapping is an error."""
    given = given or {}
    if not isinstance(given, dict):
        raise TypeError(f"'{type(given).__name__}' object has no attribute 'get'")
    return record(METADATA_FIELDS)(given)


#: A subset of YAML that is read line by line: block mappings and sequences, mappings of one line, names, dates and plain quotes, all ASCII.
_KEY, _QUOTED, _DATE = "[A-Za-z_][A-Za-z0-9_]{0,99}", r"""(?:"[ !#-\[\]-~]*"|'[ -&(-~]*')""", "[0-9]{4}-[0-9]{2}-[0-9]{2}"
_PLAIN = "[A-Za-z](?:[A-Za-z0-9_./# -]*[A-Za-z0-9_./#-])?"
_PAIR = rf"{_KEY}: (?:{_PLAIN}|{_QUOTED}|{_DATE})"
_LINE = re.compile(rf"( *)(- )?(?:({_KEY}):(?: ({_PLAIN}|{_QUOTED}|{_DATE}))?|({_KEY}: )?(\{{{_PAIR}(?:, {_PAIR})*\}}))")
_EACH_PAIR = re.compile(rf"({_KEY}): ({_PLAIN}|{_QUOTED}|{_DATE})")
#: Words that YAML 1.1 reads as something other than text, in any case.
WORDS = frozenset(("yes", "no", "true", "false", "on", "off", "null"))
_Lines = list[tuple[int, bool, str, Any]]


class NotSimple(Exception):
    """A text outside the subset."""


def _word(text: str) -> str:
    if text[0] in "\"'":
        return text[1:-1]
    if text.lower() in WORDS or " #" in text:
        raise NotSimple
    return text


def _put(into: dict, key: str, value: Any) -> None:
    if key in into:
        raise NotSimple
    into[_word(key)] = value


@functools.lru_cache(4096)
def _line(text: str) -> tuple[int, bool, str, Any]:
    """Indent, whether an item begins, key or "", value; the value is shared by equal lines."""
    found = _LINE.fullmatch(text) if len(text) < 1000 else None
    if found is None:
        raise NotSimple
    indent, item, key, value, flow_key, flow = found.groups()
    if flow is None:
        return len(indent), item is not None, key, value and _word(value)
    pairs: dict[str, str] = {}
    for k, v in _EACH_PAIR.findall(flow):
        _put(pairs, k, _word(v))
    return len(indent), item is not None, flow_key[:-2] if flow_key else "", pairs


def _mapping(lines: _Lines, at: int, indent: int) -> tuple[dict, int]:
    """The mapping whose keys stand at ``indent``, from line ``at``, which may begin an item two columns before; and the line after it."""
    out: dict[str, Any] = {}
    begin = at
    while at < len(lines):
        own, item, key, value = lines[at]
        if at > begin and own < indent:
            break
        if not key or (item if at > begin else own + 2 * item != indent) or (at > begin and own != indent):
            raise NotSimple
        at += 1
        if value is None and at < len(lines) and lines[at][0] > indent:
            below, deeper, _, _ = lines[at]
            value, at = _sequence(lines, at, below) if deeper else _mapping(lines, at, below)
        elif isinstance(value, dict):
            value = dict(value)
        elif value is None and at < len(lines) and lines[at][0] == indent and lines[at][1]:
            value, at = _sequence(lines, at, indent, True)  # a sequence may stand where its key does
        _put(out, key, value)
    return out, at


def _sequence(lines: _Lines, at: int, indent: int, flush: bool = False) -> tuple[list, int]:
    """The sequence whose items stand at ``indent``; a ``flush`` one, which stands where its key does, has mappings of several lines and ends before the next key."""
    out = []
    while at < len(lines) and lines[at][0] >= indent:
        own, item, key, value = lines[at]
        if flush and own == indent and not item:
            break
        if own != indent or not item or (flush and not key):
            raise NotSimple
        if key:
            value, at = _mapping(lines, at, indent + 2)
        else:
            value, at = dict(value), at + 1
        out.append(value)
    return out, at


def read_simple(source: str) -> dict:
    """What a text of the subset holds; NotSimple if it is none."""
    lines = [_line(text) for text in source.split("\n")]
    if lines[0][0] or lines[0][1]:
        raise NotSimple
    out, at = _mapping(lines, 0, 0)
    if at < len(lines):
        raise NotSimple
    return out


def read_yaml(source: str) -> Any:
    """What the text holds; the pure loader has the last word on texts that the fast one refuses, and the message."""
    try:
        return read_simple(source)
    except NotSimple:
        pass
    try:
        return yaml.load(source, Loader=FastTextDates)  # noqa: S506
    except (yaml.YAMLError, UnicodeError, ValueError):
        return yaml.load(source, Loader=TextDates)  # noqa: S506


def read_metadata(source: str | None) -> tuple[dict | None, str | None]:
    """(metadata, error) of one frontmatter text; None is an absent one."""
    try:
        return coerce_metadata(read_yaml(source) if source else {}), None
    except Exception as failure:  # the message is the diagnostic
        return None, str(failure)


def load(source: str | None) -> tuple[str | None, str | None]:
    """(metadata as JSON, error) of one frontmatter text; None is an absent one."""
    metadata, error = read_metadata(source)
    return metadata and json.dumps(metadata, ensure_ascii=False), error


_FRONTMATTER = compiled(P.FRONTMATTER)


def split_source(source: str) -> tuple[str | None, str]:
    """``split_frontmatter`` of one text."""
    found = _FRONTMATTER.match(source) if source.startswith("---") else None
    return (found[1], source[found.end() :]) if found else (None, source)


# ---------------------------------------------------------------- columns


def split_frontmatter(source: Column) -> tuple[Column, Column]:
    """(frontmatter or null, body) of a source text."""
    found = source.startswith("---") & source.rlike(P.FRONTMATTER)
    return F.when(found, F.regexp_extract(source, P.FRONTMATTER, 1)), F.when(found, F.regexp_replace(source, P.FRONTMATTER, "")).otherwise(source)


def with_metadata(docs: DataFrame) -> DataFrame:
    """Adds body, ok, error and metadata to rows with ``source``, and ``__sections`` for ``with_sections``, so that one Python step does both."""
    ship(docs.sparkSession)

    @F.arrow_udf("struct<json:string,error:string>")
    def read(sources: pa.Array) -> pa.Array:
        found = [load(s) for s in sources.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["json", "error"])

    front, body = split_frontmatter(F.coalesce("source", F.lit("")))
    loaded = docs.withColumns({"__front": front, "body": body}).withColumns({"__read": read("__front"), "__sections": parse_sections(F.col("body"))})
    return loaded.withColumns({"ok": F.col("__read.error").isNull(), "error": F.col("__read.error"), "metadata": pinned(F.from_json("__read.json", METADATA))}).drop("__front", "__read")
