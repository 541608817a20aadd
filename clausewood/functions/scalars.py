"""Scalar functions of the markup as Column expressions; all run inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewood.functions import patterns as P

def pinned(column: Column) -> Column:
    """The same column, which the optimizer neither copies into other expressions nor filters by in an earlier step.

    A column that stands on many others would be written out again wherever it is used, level by level.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


_DECIMALS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd" and c < 0x10000]
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DECIMALS)
_DECIMALS_TEXT = "".join(_DECIMALS)
#: The same for ``str.translate``.
ASCII_DIGITS = str.maketrans(_DECIMALS_TEXT, _VALUES)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as 0-9."""
    return F.translate(text, _DECIMALS_TEXT, _VALUES)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(P.WS_CHARACTERS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(P.WS_CHARACTERS))


def is_identifier(text: Column) -> Column:
    return text.rlike(P.IDENTIFIER)


def slugify(text: Column, fallback: str = "section") -> Column:
    """A valid identifier from free text, at most 64 characters."""
    kept = F.regexp_replace(F.lower(text), rf"[^a-z0-9_\-{P.WS[1:-1]}]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, rf"(?:{P.WS}|_)+", "-"), r"\A-+|-+\z", "")
    cut = F.substring(joined, 1, 64)
    led = F.regexp_replace(F.substring(F.concat(F.lit(f"{fallback}-"), cut), 1, 64), r"\A-+|-+\z", "")
    return F.when(cut == "", F.lit(fallback)).when(cut.rlike("^[a-z]"), cut).otherwise(led)


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first and small rest."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def display_name(identifier: Column) -> Column:
    """An identifier for display: hyphens become blanks, words get capitals."""
    return title_case(F.replace(identifier, F.lit("-"), F.lit(" ")))


def is_iso_date(text: Column) -> Column:
    """A real calendar date, strictly YYYY-MM-DD."""
    plain = ascii_digits(text)
    shaped = plain.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~plain.startswith("0000")
    return shaped & F.try_to_date(F.when(shaped, plain), "yyyy-MM-dd").isNotNull()


_RUN = r"[0-9](?:_?[0-9])*"
_NUMBER = rf"\A[+-]?(?:(?:{_RUN}\.?(?:{_RUN})?|\.{_RUN})(?:[eE][+-]?{_RUN})?|(?i:inf|infinity|nan))\z"


def to_number(text: Column) -> Column:
    """The double that a number text stands for (underscores between digits, inf and nan allowed); null if it is none."""
    plain = strip(ascii_digits(text))
    digits = F.replace(plain, F.lit("_"), F.lit(""))
    value = F.when(plain.rlike(r"(?i)inf"), F.when(plain.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).when(plain.rlike("(?i)nan"), F.lit(float("nan"))).otherwise(digits.try_cast("double"))
    return F.when(plain.rlike(_NUMBER), value)


def is_numeric(text: Column) -> Column:
    """Parses as a finite number."""
    value = to_number(text)
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def is_money_amount(text: Column) -> Column:
    """Digits with an optional fraction, finite."""
    return text.rlike(rf"\A{P.DIGIT}+(?:\.{P.DIGIT}+)?\n?\z") & ~text.endswith("\n") & is_numeric(text)


def is_positive(text: Column) -> Column:
    """Parses as a number above zero."""
    value = to_number(text)
    return F.coalesce(~F.isnan(value) & (value > 0), F.lit(False))


def is_placeholder(text: Column) -> Column:
    return text.contains(P.PLACEHOLDER_LITERAL)


def _blank_out(text: Column, pattern: str) -> Column:
    """Each match becomes a blank, or a line feed if it holds one."""
    parts, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    blanks = F.concat(F.transform(found, lambda m: F.when(m.contains("\n"), F.lit("\n")).otherwise(F.lit(" "))), F.array(F.lit("")))
    return F.array_join(F.zip_with(parts, blanks, lambda a, b: F.concat(a, b)), "")


def mask_literals(text: Column) -> Column:
    """Code fences, comments and code spans become white space; directives in them are literal text."""
    unfenced = F.when(text.contains("```") | text.contains("~~~"), F.regexp_replace(text, P.FENCED_CODE, "\n")).otherwise(text)
    plain = F.when(unfenced.contains("<!--"), _blank_out(unfenced, P.HTML_COMMENT)).otherwise(unfenced)
    return F.when(plain.contains("`"), F.regexp_replace(plain, P.CODE_SPAN, " ")).otherwise(plain)


def accepted_quotes(by_language: dict[str, list[str]] | None = None, language: str = "") -> list[tuple[str, str, str, bool]]:
    """The quotation marks that a language accepts; all of them unless a table narrows it."""
    names = (by_language or {}).get(language.lower())
    return [q for q in P.QUOTES if not names or q[2] in names]


def definition_term(match: Column, pattern: str = P.DEFINITION) -> Column:
    """The term of a definition match."""
    groups = [F.regexp_extract(match, pattern, i + 1) for i in range(len(P.QUOTES))]
    return strip(F.coalesce(*[F.nullif(g, F.lit("")) for g in groups], F.lit("")))


def definition_id(match: Column, pattern: str = P.DEFINITION) -> Column:
    return strip(F.regexp_extract(match, pattern, len(P.QUOTES) + 1))


def is_single_quoted(match: Column) -> Column:
    return match.rlike(P.SINGLE_QUOTED)


def section_number(counters: Column, level: Column) -> Column:
    """Non-zero counters of levels 1..level, with dots."""
    return F.array_join(F.filter(F.slice(counters, 1, level), lambda c: c > 0), ".")
