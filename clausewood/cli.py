"""Command line: ``python -m clausewood.cli validate PATH...``.

Directories are searched for markup files by one Spark scan, named files are read
whatever their extension. Diagnostics are made and counted on the executors; the report
reaches the driver a partition at a time and is printed as it comes.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewood import engine
from clausewood.plans import report
from clausewood.plans.messages import SPEC_VERSION, VALIDATOR_VERSION
from clausewood.sources import readers


def sources(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """The rows of all paths and the messages of paths that can't be read; a path named twice counts twice."""
    found, failures = None, []
    for path in paths:
        if Path(path).is_dir():
            rows = readers.read_directory(spark, path)
        elif Path(path).is_file():
            rows = readers.read_files(spark, [path])
        else:
            failures.append(f"cannot read {path}: [Errno 2] No such file or directory: '{path}'")
            continue
        found = rows if found is None else found.unionByName(rows)
    return found, failures


def written(found: DataFrame, form: str) -> Iterator[str]:
    """The report's text, piece by piece: its rows come from the executors one partition after another."""
    if form == "json":
        yield from report.json_report(r.asDict() for r in found.select("file", "rule", "level", "message").toLocalIterator())
    else:
        yield from (f"{r.line}\n" for r in report.text_lines(found).toLocalIterator())


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    rows, failures = sources(spark, args.paths)
    if rows is None:
        rows = readers.from_rows(spark, []).withColumn("readable", F.lit(True))
    rows = rows.persist()
    failures += [f"cannot read {r.file}: not UTF-8" for r in rows.where("NOT readable").select("file").toLocalIterator()]
    found = report.report(report.diagnostics(engine.check(rows.where("readable"))), args.ignore or (), args.warnings_as_errors).persist()
    totals = report.counts(found).first().asDict()
    sys.stdout.writelines(written(found, args.format))
    found.unpersist()
    rows.unpersist()
    if args.format == "text" and not args.quiet:
        sys.stderr.write(("\n" if any(totals.values()) else "") + report.summary(totals) + "\n")
    sys.stderr.writelines(f"error: {failure}\n" for failure in failures)
    return report.exit_code(len(failures), totals, args.strict)


# The options of the command line.
OPTIONS: dict[str, dict] = {
    "--quiet": {"action": "store_true", "help": "no summary"},
    "--strict": {"action": "store_true", "help": "any diagnostic makes the exit code 1"},
    "--warnings-as-errors": {"action": "store_true", "help": "report warnings as errors"},
    "--ignore": {"action": "append", "metavar": "RULE", "help": "leave out a rule (can be repeated)"},
    "--format": {"choices": ("text", "json"), "default": "text", "help": "form of the report"},
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="clausewood", description=f"Validator of marked-up legal documents (format {SPEC_VERSION}).")
    top.add_argument("--version", action="version", version=f"clausewood {VALIDATOR_VERSION}")
    command = top.add_subparsers(dest="command", required=True).add_parser("validate", help="validate documents")
    for name, how in OPTIONS.items():
        command.add_argument(name, **how)
    command.add_argument("paths", nargs="+", help="files, or directories to search")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("clausewood").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return validate(spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
