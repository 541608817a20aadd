"""The indices of validated documents as tables, for joins and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewood.functions import patterns as P
from clausewood.plans.report import diagnostics
from clausewood.plans.validate import matches


def exploded(validated: DataFrame, column: str) -> DataFrame:
    """(doc_id, pos, fields of the column's structs)."""
    return validated.select("doc_id", F.posexplode(column).alias("pos", "x")).select("doc_id", "pos", "x.*")


def sections(validated: DataFrame) -> DataFrame:
    return exploded(validated, "section_index")


def definitions(validated: DataFrame) -> DataFrame:
    return exploded(validated, "definitions")


def definition_lookup(validated: DataFrame) -> DataFrame:
    """(doc_id, id, term), the first of each id."""
    return exploded(validated, "definition_lookup")


def section_keys(validated: DataFrame) -> DataFrame:
    """(doc_id, key, section): ids, dotted paths and anchors; the last written of a key."""
    return exploded(validated, "section_lookup").groupBy("doc_id", "key").agg(F.max_by("section", "pos").alias("section"))


def lookups(validated: DataFrame) -> DataFrame:
    """(doc_id, kind, id, term) of sides, parties and attachments."""
    out = None
    for kind in ("side", "party", "attachment"):
        part = exploded(validated, f"{kind}_lookup").select("doc_id", F.lit(kind).alias("kind"), "id", "term")
        out = part if out is None else out.unionByName(part)
    return out


def source_directives(validated: DataFrame) -> DataFrame:
    """(doc_id, kind, target): every target of a reference or term, in unmasked text."""
    out = None
    for kind, pattern in (("ref", P.REF), ("term", P.TERM)):
        inside = F.flatten(F.transform("blocks", _inside(pattern)))
        own = F.transform(F.filter("blocks", _own(kind)), lambda b: b["target"])
        part = validated.select("doc_id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.concat(own, inside))).alias("target"))
        out = part if out is None else out.unionByName(part)
    return out


def _inside(pattern: str) -> Callable[[Column], Column]:
    return lambda b: F.flatten(F.transform(b["raw"], lambda t: F.transform(matches(t, pattern, 1), lambda x: x["g1"])))


def _own(kind: str) -> Callable[[Column], Column]:
    return lambda b: (b["kind"] == kind) & (b["target"] != "")


def register(validated: DataFrame, prefix: str = "") -> None:
    """Temporary views of all tables, for SQL."""
    tables = {"sections": sections, "definitions": definitions, "definition_lookup": definition_lookup, "section_keys": section_keys, "lookups": lookups, "diagnostics": diagnostics}
    for name, make in tables.items():
        make(validated).createOrReplaceTempView(f"{prefix}{name}")
    for name in ("dates", "used_terms", "used_refs", "used_attachments"):
        validated.select("doc_id", F.posexplode(name).alias("pos", "value")).createOrReplaceTempView(f"{prefix}{name}")
    for name in ("money", "durations", "fields", "placeholders"):
        exploded(validated, name).createOrReplaceTempView(f"{prefix}{name}")
