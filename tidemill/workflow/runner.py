"""``python -m tidemill.workflow.runner --file FLOW.yaml [--dry-run | --describe]``"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .compiler import CompileError, compile, graph
from .parse import ParseError, load
from .validate import ValidationError, validate


def run(path: str, spark: SparkSession, wait: bool = True):  # noqa: ANN201
    """Compile a file and run it; a stream's query is waited for unless told otherwise."""
    compiled = compile(load(path), spark)
    out = compiled.env.execute()
    if wait and hasattr(out, "awaitTermination"):
        out.awaitTermination()
    return out


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemill-workflow")
    parser.add_argument("--file", required=True)
    parser.add_argument("--dry-run", action="store_true", help="validate and compile only")
    parser.add_argument("--describe", action="store_true", help="print the pipeline as JSON")
    given = parser.parse_args(args)
    try:
        wf = load(given.file)
        validate(wf)
        if given.describe:
            import json

            print(json.dumps(graph(wf), indent=2))
            return 0
        if given.dry_run and wf.source.type == "kafka":
            print(f"{wf.name}: valid")  # its topic can only be read where the connector is
            return 0
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if given.dry_run:
            compile(wf, spark)
            print(f"{wf.name}: valid")
            return 0
        run(given.file, spark)
        return 0
    except (ParseError, ValidationError, CompileError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
