"""Sources: files, directories, rows in memory, nested dictionaries or JSON, and the starter document."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewood.functions.scalars import pinned, strip
from clausewood.schema import BLOCK_FIELDS, DOCUMENT

EXTENSIONS_GLOB = "*.{lgd,legaldown,legal.md}"


def files_to_rows(files: DataFrame) -> DataFrame:
    """doc_id, file, filename, source, readable of binary file rows; line ends become line feeds."""
    readable = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(readable, F.decode("content", "UTF-8"))
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"^file:(//)?(?=/)", "")
    return files.select(
        path.alias("doc_id"),
        path.alias("file"),
        F.element_at(F.split(path, "/"), -1).alias("filename"),
        F.regexp_replace(text, r"\r\n?", "\n").alias("source"),
        readable.alias("readable"),
    )


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """All markup files below a directory, by their extensions."""
    return files_to_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", EXTENSIONS_GLOB).load(path))


def read_files(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Named files, whatever their extensions."""
    return files_to_rows(spark.read.format("binaryFile").load(list(paths)))


def from_rows(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    """(filename, source) pairs in memory."""
    listed = [(name, name, name, source) for name, source in rows]
    return spark.createDataFrame(listed, "doc_id string, file string, filename string, source string")


# ---------------------------------------------------------------- dictionaries and JSON

#: The payload as it comes: every scalar is text, as JSON readers allow.
LOOSE = DOCUMENT.replace("level:int", "level:string").replace("include_signatures:boolean", "include_signatures:string").replace("field_types:array<struct<key:string,value:string>>", "field_types:map<string,string>").replace("translations:array<struct<key:string,value:string>>", "translations:map<string,string>").replace("tags:array<string>", "tags:string")


def _text(c: Column, default: str = "") -> Column:
    """Stripped text; false values and blanks give the default."""
    bare = F.when(c.isin("false", "0", "[]", "{}", "0.0"), F.lit("")).when(c == "true", F.lit("True")).otherwise(strip(c))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(default)).otherwise(bare)


def _listed(c: Column, kind: str) -> Column:
    return F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast(f"array<{kind}>"))


def _pairs(c: Column) -> Column:
    kept = F.filter(F.map_entries(c), lambda e: (F.coalesce(e["key"], F.lit("")) != "") & (F.coalesce(e["value"], F.lit("")) != ""))
    return F.coalesce(F.transform(kept, lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))


def _record(c: Column, names: Iterable[str], **others: Column) -> Column:
    return F.struct(*[others.get(n, _text(c[n])).alias(n) for n in names])


def _metadata(m: Column) -> Column:
    person = "struct<name:string,title:string>"
    field = "struct<label:string,value:string>"
    party_names = ("name", "label", "type", "legal_name", "identification_number", "address", "date_of_birth", "representatives", "custom_fields")

    def party(p: Column) -> Column:
        return _record(p, party_names, representatives=F.transform(_listed(p["representatives"], person), lambda r: _record(r, ("name", "title"))), custom_fields=F.transform(_listed(p["custom_fields"], field), lambda r: _record(r, ("label", "value"))))

    def side(s: Column) -> Column:
        return _record(s, ("name", "label", "parties"), parties=F.transform(F.coalesce(F.filter(s["parties"], lambda x: x.isNotNull()), F.filter(s["parties"], lambda x: F.lit(False)), F.slice(F.array(s["parties"]), 1, 0)[0]), party))

    tags = F.coalesce(F.from_json(m["tags"], "array<string>"), F.split(m["tags"], ","))
    signed = F.when(m["include_signatures"].isNull(), F.lit(True)).otherwise(F.lower(strip(m["include_signatures"])).isin("1", "true", "yes", "on"))
    return F.struct(
        *[_text(m[n]).alias(n) for n in ("title", "subtitle", "version")],
        _text(m["document_type"], "contract").alias("document_type"),
        _text(m["effective_date"]).alias("effective_date"),
        _pairs(m["field_types"]).alias("field_types"),
        _text(m["governing_law"]).alias("governing_law"),
        _text(m["language"], "en").alias("language"),
        signed.alias("include_signatures"),
        F.coalesce(F.filter(F.transform(tags, lambda t: strip(t)), lambda t: t != ""), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.transform(F.filter(m["sides"], lambda s: s.isNotNull()), side), F.transform(F.slice(F.array(m["sides"]), 1, 0), lambda s: side(s[0]))).alias("sides"),
        _pairs(m["translations"]).alias("translations"),
        *[_text(m[n]).alias(n) for n in ("authoritative", "adopted_by", "adoption_date", "supersedes")],
        F.when(m["amends"].isNotNull(), _record(m["amends"], ("title", "file"))).alias("amends"),
        F.transform(_listed(m["attachments"], "struct<id:string,title:string,file:string>"), lambda a: _record(a, ("id", "title", "file"))).alias("attachments"),
    )


def _block(b: Column) -> Column:
    kind = F.when(F.coalesce(b["kind"], F.lit("")) == "", F.lit("paragraph")).otherwise(b["kind"])
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != "")
    items = clean(b["items"])
    rows = F.filter(F.transform(F.coalesce(b["rows"], F.array().cast("array<array<string>>")), lambda r: F.transform(r, strip)), lambda r: F.exists(r, lambda x: x != ""))
    headers = F.when(b["headers"].isNull() & (kind == "table"), F.array(F.lit("Column 1"), F.lit("Column 2"))).otherwise(clean(b["headers"]))
    whole = lambda c: F.coalesce(c, F.lit(""))
    given = {"kind": kind, "prefix": whole(b["prefix"]), "suffix": whole(b["suffix"]), "items": F.when((F.size(items) == 0) & kind.endswith("list"), F.array(F.lit(""))).otherwise(items), "headers": headers, "rows": rows}
    return _record(b, BLOCK_FIELDS, **given)


def _section(s: Column) -> Column:
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.nullif(s["level"].try_cast("int"), F.lit(0)), F.lit(1))))
    blocks = F.coalesce(F.transform(F.filter(s["blocks"], lambda b: b.isNotNull()), _block), F.transform(F.slice(F.array(s["blocks"]), 1, 0), lambda b: _block(b[0])))
    return F.struct(_text(s["title"], "New Section").alias("title"), level.alias("level"), _text(s["identifier"]).alias("identifier"), blocks.alias("blocks"))


def from_json_documents(docs: DataFrame, json_col: str = "document") -> DataFrame:
    """Rows with a JSON document become parsed rows: ok, error, filename, metadata, sections."""
    given = docs.withColumn("__doc", F.from_json(json_col, LOOSE))
    ok = F.col("__doc").isNotNull()
    sections = F.coalesce(F.transform("__doc.sections", _section), F.transform(F.slice(F.array(F.col("__doc.sections")), 1, 0), lambda s: _section(s[0])))
    return given.withColumns({"ok": ok, "error": F.when(~ok, F.lit("not a JSON document")), "filename": _text(F.col("__doc.filename")), "metadata": pinned(_metadata(F.col("__doc.metadata"))), "sections": pinned(sections)}).drop("__doc")


def from_dicts(spark: SparkSession, rows: Iterable[tuple[str, dict[str, Any]]]) -> DataFrame:
    """(doc_id, nested dictionary) pairs as parsed rows."""
    listed = [(doc_id, doc_id, json.dumps(document)) for doc_id, document in rows]
    return from_json_documents(spark.createDataFrame(listed, "doc_id string, file string, document string")).drop("document")


# ---------------------------------------------------------------- starter document

# The content of a new document.
STARTER = {
    "metadata": {
        "title": "Untitled Agreement",
        "language": "en",
        "include_signatures": True,
        "sides": [
            {"name": "providers", "label": "Providers", "parties": [{"name": "provider-llc", "label": "Provider", "type": "legal_entity", "legal_name": "Provider LLC", "representatives": [{"name": "", "title": ""}]}]},
            {"name": "clients", "label": "Clients", "parties": [{"name": "client-llc", "label": "Client", "type": "legal_entity", "legal_name": "Client LLC", "representatives": [{"name": "", "title": ""}]}]},
        ],
    },
    "sections": [
        {"title": "Definitions", "level": 1, "identifier": "definitions", "blocks": [{"kind": "definition", "definition_id": "services", "term": "Services", "text": "means the services described in this agreement."}]},
        {"title": "Scope of Work", "level": 1, "identifier": "scope-of-work", "blocks": [{"kind": "paragraph", "text": "Describe the scope of work."}]},
    ],
}


def starter(spark: SparkSession) -> DataFrame:
    """The starter document as one parsed row."""
    return from_dicts(spark, [("starter", STARTER)])
