"""Rules, their levels and their message texts."""

from __future__ import annotations

# Rule ids, levels and wording are part of the markup's reports. %s stands for a value.
MESSAGES: dict[str, tuple[str, str, str]] = {
    "title-missing": ("title-missing", "error", "The document title is required."),
    "document-type-invalid": ("document-type-invalid", "error", "Invalid document_type '%s'. Must be one of: contract, unilateral_act, collective_act."),
    "field-type-key-format": ("field-type-key-format", "error", "field_types key '%s' must match [a-z][a-z0-9-]*."),
    "field-type-key-reserved": ("field-type-key-reserved", "error", "field_types key '%s' collides with a reserved value-type name (date, money, duration, party, text)."),
    "metadata-date-invalid": ("metadata-date-invalid", "error", "%s '%s' must be a valid ISO 8601 date (YYYY-MM-DD)."),
    "side-name-format": ("side-party-name-format", "error", "Side name '%s' must be a lowercase identifier matching '^[a-z][a-z0-9-]*$'."),
    "side-name-duplicate": ("side-name-duplicate", "error", "Duplicate side name '%s'."),
    "party-name-format": ("side-party-name-format", "error", "Party name '%s' must be a lowercase identifier matching '^[a-z][a-z0-9-]*$'."),
    "party-name-duplicate": ("party-name-duplicate", "error", "Duplicate party name '%s'."),
    "party-type-invalid": ("party-type-invalid", "error", "Party '%s' has invalid type '%s'. Must be 'legal_entity' or 'natural_person'."),
    "date-of-birth-invalid": ("date-of-birth-invalid", "error", "Party '%s' date_of_birth '%s' must be a valid ISO 8601 date (YYYY-MM-DD)."),
    "representative-name-empty": ("representative-name-empty", "error", "A representative of party '%s' is missing the required name."),
    "sides-absent": ("sides-absent", "warning", "No sides are declared, so the document_type '%s' side/party constraints cannot be verified."),
    "sides-minimum": ("sides-minimum", "error", "Contracts require at least 2 distinct sides (found %s)."),
    "contract-parties-minimum": ("parties-minimum", "error", "Contracts require at least 2 parties (found %s)."),
    "act-parties-minimum": ("parties-minimum", "error", "Document type '%s' requires at least 1 party."),
    "issuer-side-required": ("issuer-side-required", "error", "Document type '%s' requires a side named 'issuer'."),
    "attachment-id-missing": ("anchor-format", "error", "Attachment is missing required 'id'."),
    "attachment-id-format": ("anchor-format", "error", "Attachment id '%s' must match [a-z][a-z0-9-]*."),
    "attachment-id-duplicate": ("attachment-id-duplicate", "error", "Duplicate attachment id '%s'."),
    "attachment-title-empty": ("attachment-title-empty", "error", "Attachment '%s' is missing required 'title'."),
    "attachment-file-missing": ("attachment-file-missing", "error", "Attachment '%s' is missing required 'file'."),
    "amends-title-empty": ("amends-title-empty", "error", "amends.title is required when amends is present."),
    "heading-depth": ("heading-depth", "error", "Section '%s' uses unsupported heading level %s. LegalDown supports levels 1-5 (§4.1)."),
    "heading-skip": ("heading-skip", "error", "Heading levels must not skip. '%s' jumps from level %s to %s."),
    "heading-hardcoded-number": ("heading-hardcoded-number", "warning", "Section '%s' appears to include hardcoded numbering. LegalDown headings should be plain text."),
    "section-id-format": ("anchor-format", "error", "Identifier '%s' on section '%s' is invalid. Use lowercase letters, numbers, and hyphens only."),
    "section-id-duplicate": ("anchor-duplicate", "error", "Duplicate section identifier on '%s'. It was adjusted to '%s'."),
    "anchor-autogen-collision": ("anchor-autogen-collision", "warning", "Auto-generated identifier on '%s' collides with an earlier section. It was adjusted to '%s'."),
    "attachment-id-collision": ("attachment-id-collision", "error", "Section identifier '%s' collides with an attachment id."),
    "anchor-format": ("anchor-format", "error", "Anchor '{#%s}' is invalid. Use lowercase letters, numbers, and hyphens only."),
    "anchor-duplicate": ("anchor-duplicate", "error", "Anchor '{#%s}' duplicates an existing anchor in the document."),
    "definition-id-format": ("anchor-format", "error", "Definition identifier '%s' (term '%s') is invalid. Use lowercase letters, numbers, and hyphens only."),
    "def-autogen-collision": ("def-autogen-collision", "error", "Two definitions auto-generate the same id '%s'. Add an explicit id to disambiguate."),
    "def-duplicate-id": ("def-duplicate-id", "error", "Definition identifier '%s' is duplicated."),
    "def-emphasis": ("def-emphasis", "warning", "Defined term wrapped in emphasis markers in source. Quotation marks alone delimit a defined term; emphasis is a render-time style."),
    "def-no-quoted-span": ("def-no-quoted-span", "error", "A {{def:}} anchor must immediately follow a quoted defined term."),
    "def-single-quote-ambiguous": ("def-single-quote-ambiguous", "warning", "Single-quoted defined term '%s' may be ambiguous with an apostrophe (U+2019); prefer double-quote delimiters."),
    "amend-def-override": ("amend-def-override", "warning", "Amendment redefines '%s' which exists in the original document."),
    "attachment-def-collision": ("def-duplicate-id", "error", "Definition id '%s' from attachment '%s' collides with a definition in the main document (ids must be unique, §15.10)."),
    "placeholder-in-structural-field": ("placeholder-in-structural-field", "error", "A {{placeholder:}} is not allowed in the identifier/structural field (%s); placeholders are only valid in value fields (§3.10)."),
    "placeholder-id-malformed": ("placeholder-id-malformed", "error", "Placeholder id '%s' is invalid — must match [a-z][a-z0-9-]*."),
    "placeholder-type-invalid": ("placeholder-type-invalid", "error", "Placeholder type '%s' is unsupported. Must be one of: text, date, money."),
    "placeholder-type-inconsistent": ("placeholder-type-inconsistent", "error", "Placeholder '%s' used with inconsistent types: '%s' and '%s'."),
    "placeholder-unknown-currency": ("placeholder-unknown-currency", "warning", "Placeholder '%s' has unrecognized currency code '%s'."),
    "directive-unknown": ("directive-unknown", "error", "Unknown directive '{{%s:}}'. Renderers replace it with [UNKNOWN DIRECTIVE: %s] (§11.5)."),
    "date-invalid": ("date-invalid", "error", "Invalid date value '%s'. Must be a valid ISO 8601 date (YYYY-MM-DD)."),
    "money-invalid-amount": ("money-invalid-amount", "error", "Invalid money amount '%s'. Must be a non-negative numeric value."),
    "money-unknown-currency": ("money-unknown-currency", "warning", "Unrecognized currency code '%s'."),
    "money-missing-currency": ("money-missing-currency", "warning", "Money directive without currency parameter."),
    "duration-invalid-value": ("duration-invalid-value", "error", "Invalid duration value '%s'. Must be a positive numeric value."),
    "duration-unit-missing": ("duration-invalid-unit", "error", "Duration directive missing required unit parameter."),
    "duration-unit-m": ("duration-invalid-unit", "error", "Duration unit 'M' is not defined. Use 'MIN' for minutes or 'MO' for months."),
    "duration-unit-unknown": ("duration-invalid-unit", "error", "Invalid duration unit '%s'. Must be one of: S, MIN, H, D, W, MO, Y."),
    "party-name-malformed": ("party-name-malformed", "error", "Party directive has invalid role value '%s'. Must match [a-z][a-z0-9-]*."),
    "party-unknown": ("party-unknown", "error", "Party directive references unknown party: '%s'."),
    "side-name-malformed": ("side-name-malformed", "error", "Side directive has invalid value '%s'. Must match [a-z][a-z0-9-]*."),
    "side-unknown": ("side-unknown", "error", "Side directive references unknown side: '%s'."),
    "field-type-missing": ("field-type-missing", "error", "Field directive is missing required type parameter."),
    "field-type-malformed": ("field-type-missing", "error", "Field type '%s' is invalid — must match [a-z][a-z0-9-]*."),
    "field-type-undeclared": ("field-type-undeclared", "warning", "Field type '%s' is not declared in field_types."),
    "attach-undeclared": ("attach-undeclared", "error", "Attachment reference '{{attach: %s}}' references undeclared attachment id."),
    "note-separators": ("note-invalid", "error", "Note parameter must not contain commas or closing braces."),
    "note-markdown": ("note-invalid", "error", "Note parameter must be plain text without Markdown formatting."),
    "ref-targets-attachment": ("ref-targets-attachment", "error", "Reference '{{ref: %s}}' targets an attachment id. Use '{{attach: %s}}' instead."),
    "ref-broken": ("ref-broken", "error", "Broken section reference: '%s'."),
    "amend-term-undefined": ("amend-term-undefined", "error", "Undefined term reference: '%s' (not found in amendment or imported original)."),
    "amend-term-unresolvable": ("amend-term-unresolvable", "info", "Term reference '%s' is not defined in the amendment; the original document is not available to verify it."),
    "term-undefined": ("term-undefined", "error", "Undefined term reference: '%s'."),
    "attachment-unreferenced": ("attachment-unreferenced", "warning", "Attachment '%s' is declared but never referenced via {{attach:}}."),
    "def-unreferenced": ("def-unreferenced", "warning", "Definition '%s' is declared but never referenced via {{term:}}."),
    "frontmatter-invalid-yaml": ("frontmatter-invalid-yaml", "error", "%s"),
}

LEVELS = ("error", "warning", "info")
SPEC_VERSION = "0.1"
VALIDATOR_VERSION = "0.1.0"
