"""The nested schema of a document. Strings are empty rather than null; ``amends`` alone can be null."""

from __future__ import annotations

TEXT_PAIR = "array<struct<key:string,value:string>>"
PARTY = "struct<name:string,label:string,type:string,legal_name:string,identification_number:string,address:string,date_of_birth:string,representatives:array<struct<name:string,title:string>>,custom_fields:array<struct<label:string,value:string>>>"
SIDE = f"struct<name:string,label:string,parties:array<{PARTY}>>"
METADATA = (
    "struct<title:string,subtitle:string,version:string,document_type:string,effective_date:string,"
    f"field_types:{TEXT_PAIR},governing_law:string,language:string,include_signatures:boolean,tags:array<string>,"
    f"sides:array<{SIDE}>,translations:{TEXT_PAIR},authoritative:string,adopted_by:string,adoption_date:string,"
    "supersedes:string,amends:struct<title:string,file:string>,attachments:array<struct<id:string,title:string,file:string>>>"
)
BLOCK = "struct<kind:string,text:string,definition_id:string,term:string,prefix:string,suffix:string,target:string,format:string,label:string,items:array<string>,headers:array<string>,rows:array<array<string>>>"
SECTION = f"struct<title:string,level:int,identifier:string,blocks:array<{BLOCK}>>"
SECTIONS = f"array<{SECTION}>"
DOCUMENT = f"struct<metadata:{METADATA},sections:{SECTIONS},filename:string>"
DIAGNOSTIC = "struct<rule:string,level:string,message:string>"

BLOCK_FIELDS = ("kind", "text", "definition_id", "term", "prefix", "suffix", "target", "format", "label", "items", "headers", "rows")
EMPTY_METADATA = {"title": "", "document_type": "contract", "language": "en"}
