"""Reports: diagnostics as rows, suppressed, promoted, sorted, counted and written as text or JSON."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewood.plans.messages import LEVELS, SPEC_VERSION, VALIDATOR_VERSION

# Exit codes.
EXIT_CLEAN, EXIT_FOUND, EXIT_FAILED = 0, 1, 2


def diagnostics(validated: DataFrame) -> DataFrame:
    """(doc_id, file, seq, rule, level, message): a row per diagnostic, ``seq`` in the order of report."""
    return validated.select("doc_id", "file", F.posexplode("diagnostics").alias("seq", "d")).select("doc_id", "file", "seq", "d.rule", "d.level", "d.message")


def ignore(found: DataFrame, rules: Iterable[str]) -> DataFrame:
    dropped = list(rules)
    return found.where(~F.col("rule").isin(dropped)) if dropped else found


def promote(found: DataFrame) -> DataFrame:
    """Warnings become errors."""
    return found.withColumn("level", F.when(F.col("level") == "warning", F.lit("error")).otherwise(F.col("level")))


def level_order(level: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)), F.lit(10))


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("file", level_order(F.col("level")), "rule", "doc_id", "seq")


def report(found: DataFrame, ignored: Iterable[str] = (), warnings_as_errors: bool = False) -> DataFrame:
    """Suppression first, then promotion, then the order of output."""
    kept = ignore(found, ignored)
    return ordered(promote(kept) if warnings_as_errors else kept)


def counts(found: DataFrame) -> DataFrame:
    """One row: the number of each level, zeros included."""
    return found.agg(*[F.count(F.when(F.col("level") == level, 1)).alias(level) for level in LEVELS])


def rules(found: DataFrame, level: str | None = None) -> DataFrame:
    return (found if level is None else found.where(F.col("level") == level)).select("doc_id", "rule").distinct()


def validity(validated: DataFrame) -> DataFrame:
    """(doc_id, is_valid, errors, warnings, infos): messages by level and whether there are no errors."""
    of = lambda level: F.transform(F.filter("diagnostics", lambda d: d["level"] == level), lambda d: d["message"])
    return validated.select("doc_id", (F.size(of("error")) == 0).alias("is_valid"), of("error").alias("errors"), of("warning").alias("warnings"), of("info").alias("infos"))


def text_lines(found: DataFrame) -> DataFrame:
    """``line``: file: level: [rule] message."""
    return found.select(F.concat("file", F.lit(": "), "level", F.lit(": ["), "rule", F.lit("] "), "message").alias("line"))


def json_lines(found: DataFrame) -> DataFrame:
    """``line``: each diagnostic as a JSON object, for bulk output."""
    return found.select(F.to_json(F.struct("file", "rule", "level", "message")).alias("line"))


def json_report(rows: Iterable[dict[str, str]]) -> Iterator[str]:
    """The parts of the one JSON report over all rows, which need not be held at once."""
    head = json.dumps({"legaldown_spec": SPEC_VERSION, "validator_version": VALIDATOR_VERSION}, indent=2)
    yield head.removesuffix("\n}") + ',\n  "diagnostics": ['
    empty = True
    for row in rows:
        yield ("\n" if empty else ",\n") + textwrap.indent(json.dumps(row, indent=2), "    ")
        empty = False
    yield "]\n}\n" if empty else "\n  ]\n}\n"


def summary(totals: dict[str, int]) -> str:
    if not any(totals.values()):
        return "No issues found."
    return ", ".join(f"{totals[level]} {level}(s)" for level in LEVELS)


def exit_code(failures: int, totals: dict[str, int], strict: bool = False) -> int:
    """Unreadable files outrank errors, errors outrank the rest."""
    if failures:
        return EXIT_FAILED
    return EXIT_FOUND if totals["error"] or (strict and any(totals.values())) else EXIT_CLEAN
