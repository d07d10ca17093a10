"""Command line: analyses a folder, a query or a schema and writes the report.

A YAML file of settings goes before the options, but for references, where the option goes before the file of references
and that before the settings. Without any detector named, all run.
"""

from __future__ import annotations

import argparse
import sys

import yaml

from ..session import session
from ..sources.sinks import summary, write_json_report
from .assistant import analyze, source_of
from .config import AnomalyConfig, MappingConfig, SourceConfig

DETECTORS = ("zscore", "iqr", "isolation_forest", "categorical", "missing")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkgauge", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--data-root")
    p.add_argument("--sql", action="store_true")
    p.add_argument("--query")
    p.add_argument("--schema")
    p.add_argument("--max-rows", type=int)
    p.add_argument("--references")
    p.add_argument("--references-file")
    p.add_argument("--threshold", type=float, default=0.7)
    p.add_argument("--epsilon", type=float, default=0.05)
    p.add_argument("--z-threshold", type=float, default=3.0)
    p.add_argument("--contamination", type=float, default=0.01)
    p.add_argument("--missing-threshold", type=int, default=1)
    p.add_argument("--save-dir")
    p.add_argument("--output")
    for d in DETECTORS:
        p.add_argument(f"--{d.replace('_', '-')}", action="store_true", dest=f"use_{d}")
    return p


def settings(argv: list[str] | None = None) -> argparse.Namespace:
    args = parser().parse_args(argv)
    given = args.references
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            for k, v in (yaml.safe_load(f) or {}).items():
                setattr(args, k.replace("-", "_"), v)
    if given:
        args.references = given
    elif args.references_file:
        with open(args.references_file, encoding="utf-8") as f:
            args.references = [x.strip() for x in f if x.strip()]
    if isinstance(args.references, str):
        args.references = [x.strip() for x in args.references.split(",") if x.strip()]
    return args


def main(argv: list[str] | None = None) -> int:
    args = settings(argv)
    if args.sql and not (args.query or args.schema):
        print("--sql needs --query or --schema", file=sys.stderr)
        return 1
    if not args.sql and not args.data_root:
        print("--data-root or --sql is needed", file=sys.stderr)
        return 1
    spark = session()
    source = SourceConfig("sql", query=args.query, schema=args.schema, max_rows=None if args.query else args.max_rows) if args.sql else SourceConfig("local", args.data_root, max_rows=args.max_rows)
    chosen = {d: getattr(args, f"use_{d}") for d in DETECTORS}
    used = {f"use_{d}": v or not any(chosen.values()) for d, v in chosen.items()}
    anomalies = AnomalyConfig(**used, z_threshold=args.z_threshold, missing_threshold=args.missing_threshold, contamination=args.contamination)
    report = analyze(source_of(spark, source), anomalies, MappingConfig(tuple(args.references or ()), threshold=args.threshold, epsilon=args.epsilon), args.save_dir)
    if args.output:
        write_json_report(report, args.output)
    print(summary(report))
    return 0


if __name__ == "__main__":
    sys.exit(main())
