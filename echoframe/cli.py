"""Command line: ``python -m echoframe.cli ROOT``."""

from __future__ import annotations

import argparse
import sys
import time

from .config import CloneConfig, RepositoryOptions
from .errors import CloneError


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="echoframe", description="Find clones in a folder of source files.")
    p.add_argument("root")
    p.add_argument("--summary", action="store_true", help="only the line of counts")
    p.add_argument("--mode", choices=["exact", "renamed", "near-miss"], default="near-miss")
    p.add_argument("--min-tokens", type=int, default=24)
    p.add_argument("--min-lines", type=int, default=3)
    p.add_argument("--max-lines", type=int, default=400)
    p.add_argument("--format", action="append", default=[], metavar="EXTENSIONS", help="extensions to read, separated by commas")
    p.add_argument("--cross-extensions", action="store_true")
    p.add_argument("--output-format", choices=["text", "json", "sarif", "bigcloneeval"], default="text")
    p.add_argument("--output", metavar="FILE", help="where to write the report instead of the screen; a place that all workers see")
    args = p.parse_args(argv)
    if args.summary and args.output_format != "text":
        p.error("--summary needs --output-format text")
    return args


def main(argv: list[str] | None = None, spark=None) -> int:
    from .plans import encode
    from .plans.detector import detect_repository

    args = arguments(sys.argv[1:] if argv is None else argv)
    config = CloneConfig(mode={"near-miss": "nearMiss"}.get(args.mode, args.mode), min_tokens=args.min_tokens)
    options = RepositoryOptions(min_fragment_lines=args.min_lines, max_fragment_lines=args.max_lines, cross_extensions=args.cross_extensions)
    if args.format:
        options = options.with_extensions(",".join(args.format).split(","))
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("echoframe").getOrCreate()
    began = time.time()
    try:
        report = detect_repository(spark, args.root, config, options)
        name = args.output_format
        took = (time.time() - began) * 1000
        if args.output:
            more = (args.summary, took) if name == "text" else ()
            getattr(encode, f"write_{name}")(report, args.output, *more)
        elif name == "text":
            sys.stdout.write(encode.to_text(report, args.summary, took))
        else:
            text = getattr(encode, f"to_{name}")(report)
            sys.stdout.write(text if text.endswith("\n") or not text else text + "\n")
    except CloneError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
