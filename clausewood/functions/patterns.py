"""Patterns, vocabularies and quotation marks of the markup, as Java regular expressions.

The markup's white space, digits and line ends are the Unicode ones of its
definition, so ``\\s``, ``\\d`` and the line mode are spelled out: ``(?d)`` makes a
line feed the only line end for ``.``, ``^`` and ``$``.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values of the markup

_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{_SPACES}]"
WS_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ODD_LINE_END = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"

IDENTIFIER = r"(?d)^[a-z][a-z0-9-]*$"

FRONTMATTER = rf"(?s)\A---{WS}*\n(.*?)\n---{WS}*\n?"
HEADING = rf"(?d)^(#{{1,6}}){WS}+(.+?)(?:{WS}+\{{#([^}}{_SPACES}]+)\}})?{WS}*$"
TRAILING_ANCHOR = rf"(?d)\{{#([^}}{_SPACES}]+)\}}{WS}*$"
HARDCODED_NUMBER = rf"(?iu)^(article{WS}+[ivxlcdm]+|{DIGIT}+(?:\.{DIGIT}+)*)"

REF_BLOCK = rf"(?s)^(.*?)\{{\{{ref:{WS}*([^,}}]+)(?:,{WS}*format=([^}}]+))?\}}\}}(.*)$"
TERM_BLOCK = rf"(?s)^(.*?)\{{\{{term:{WS}*([^,}}]+)(?:,{WS}*label=([^}}]+))?\}}\}}(.*)$"

#: Directive name: its optional parameters in order, besides the value and the note.
REF = rf"\{{\{{ref:{WS}*([^,}}]+)(?:,{WS}*format=([^}}]+))?\}}\}}"
TERM = rf"\{{\{{term:{WS}*([^,}}]+)(?:,{WS}*label=([^}}]+))?\}}\}}"


def _valued(name: str, *parameters: str) -> str:
    given = "".join(rf"(?:,{WS}*{p}=([^,}}]+?))?" for p in parameters)
    return rf"\{{\{{{name}:{WS}*([^,}}]+?){given}(?:,{WS}*note=[^}}]*)?\}}\}}"


DATE = _valued("date")
MONEY = _valued("money", "currency")
DURATION = _valued("duration", "unit")
PARTY = _valued("party", "label")
SIDE = _valued("side", "label")
FIELD = _valued("field", "type")
PLACEHOLDER = _valued("placeholder", "type", "currency")
ATTACH = rf"\{{\{{attach:{WS}*([^,}}]+?)(?:,{WS}*label=[^}}]*)?\}}\}}"
NOTE = rf"\{{\{{{WORD}+:[^}}]*,{WS}*note=([^}}]*)\}}\}}"
DIRECTIVE_NAME = r"\{\{([a-z]+):"
MARKDOWN_IN_NOTE = rf"\*\*|__|\+\+|`|(?<!{WORD})\*(?!{WS})"
PLACEHOLDER_LITERAL = "{{placeholder:"

FENCED_CODE = r"(?dsm)^(```|~~~).*?^\1"
HTML_COMMENT = r"(?s)<!--.*?-->"
CODE_SPAN = r"(?s)``.*?``|`[^`\n]*`"

#: Quotation marks of a defined term: opening, closing, name, single.
QUOTES = (
    ('"', '"', "straight-double", False),
    ("“", "”", "curly-double", False),
    ("«", "»", "guillemets", False),
    ("»", "«", "reversed-guillemets", False),
    ("„", "“", "low-high-double", False),
    ("‘", "’", "curly-single", True),
    ("‚", "‘", "low-high-single", True),
    ("‹", "›", "single-guillemets", True),
)
EMPHASIS = r"(?:\*\*|\*|\+\+)"

KNOWN_DIRECTIVES = ("ref", "def", "term", "date", "money", "duration", "party", "side", "field", "placeholder", "include", "attach")
RESERVED_VALUE_TYPES = ("date", "money", "duration", "party", "text")
DOCUMENT_TYPES = ("contract", "unilateral_act", "collective_act")
PARTY_TYPES = ("legal_entity", "natural_person")
DURATION_UNITS = ("S", "MIN", "H", "D", "W", "MO", "Y")
PLACEHOLDER_TYPES = ("text", "date", "money")
MARKUP_EXTENSIONS = (".lgd", ".legaldown", ".legal.md")
CURRENCIES = (
    "AED", "AFN", "ALL", "AMD", "ANG", "AOA", "ARS", "AUD", "AWG", "AZN", "BAM", "BBD", "BDT", "BGN", "BHD", "BIF",
    "BMD", "BND", "BOB", "BRL", "BSD", "BTN", "BWP", "BYN", "BZD", "CAD", "CDF", "CHF", "CLP", "CNY", "COP", "CRC",
    "CUP", "CVE", "CZK", "DJF", "DKK", "DOP", "DZD", "EGP", "ERN", "ETB", "EUR", "FJD", "FKP", "GBP", "GEL", "GHS",
    "GIP", "GMD", "GNF", "GTQ", "GYD", "HKD", "HNL", "HRK", "HTG", "HUF", "IDR", "ILS", "INR", "IQD", "IRR", "ISK",
    "JMD", "JOD", "JPY", "KES", "KGS", "KHR", "KMF", "KPW", "KRW", "KWD", "KYD", "KZT", "LAK", "LBP", "LKR", "LRD",
    "LSL", "LYD", "MAD", "MDL", "MGA", "MKD", "MMK", "MNT", "MOP", "MRU", "MUR", "MVR", "MWK", "MXN", "MYR", "MZN",
    "NAD", "NGN", "NIO", "NOK", "NPR", "NZD", "OMR", "PAB", "PEN", "PGK", "PHP", "PKR", "PLN", "PYG", "QAR", "RON",
    "RSD", "RUB", "RWF", "SAR", "SBD", "SCR", "SDG", "SEK", "SGD", "SHP", "SLE", "SOS", "SRD", "SSP", "STN", "SVC",
    "SYP", "SZL", "THB", "TJS", "TMT", "TND", "TOP", "TRY", "TTD", "TWD", "TZS", "UAH", "UGX", "USD", "UYU", "UZS",
    "VES", "VND", "VUV", "WST", "XAF", "XCD", "XOF", "XPF", "YER", "ZAR", "ZMW", "ZWL",
)

# ---------------------------------------------------------------- derived patterns


def definition_anchor(names: tuple[str, ...] | None = None) -> str:
    """A quoted term and its ``{{def: id}}``: a group for each accepted pair of marks, then the id."""
    pairs = [(o, c) for o, c, name, _ in QUOTES if not names or name in names]
    quoted = "|".join(f"{EMPHASIS}?{o}(.*?){c}{EMPHASIS}?" for o, c in pairs)
    return rf"(?d)(?:{quoted})[ \t\xa0]*\{{\{{{WS}*def:{WS}*([^}}]*?){WS}*\}}\}}"


DEFINITION = definition_anchor()
DEFINITION_TAG = rf"\{{\{{{WS}*def:{WS}*[^}}]*\}}\}}"
EMPHASISED_DEFINITION = rf"(?d){EMPHASIS}{WS}*(?:{'|'.join(f'{o}.*?{c}' for o, c, _, _ in QUOTES)}){WS}*{EMPHASIS}?[ \t]*\{{\{{{WS}*def:"
#: A definition match that opens with a single quotation mark.
SINGLE_QUOTED = rf"^{EMPHASIS}?[{''.join(o for o, _, _, single in QUOTES if single)}]"
