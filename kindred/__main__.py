"""python -m kindred run --sources PATHS [--config FILE] [--out FOLDER] [--store FOLDER] [--linkedin-url URL] [--linkedin-profiles FOLDER] [--github-url URL] [--github-base URL]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from kindred.plans.config import DEFAULT, parse_config
from kindred.plans.pipeline import run_pipeline
from kindred.plans.project import as_json
from kindred.plans.store import Store
from kindred.sources import readers


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="kindred")
    run = top.add_subparsers(dest="command", required=True).add_parser("run")
    run.add_argument("--sources", default="")
    run.add_argument("--config")
    run.add_argument("--out")
    run.add_argument("--store")
    run.add_argument("--linkedin-url")
    run.add_argument("--linkedin-profiles", help="a folder of linkedin_<slug>.json")
    run.add_argument("--github-url")
    run.add_argument("--github-base", default="https://api.github.com/users", help="where profiles are fetched; a file: URL needs no network")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    paths, warnings = readers.resolve_paths(args.sources, spark)
    for w in warnings:
        print(w, file=sys.stderr)
    if not paths and not args.linkedin_url and not args.github_url:
        print("there are no sources", file=sys.stderr)
        return 1
    sources, csv = readers.file_sources(spark, paths, csv=False), readers.csv_lines(spark, paths)
    github = linkedin = None
    if args.linkedin_url or args.github_url:
        sources = sources.unionByName(readers.link_sources(spark, args.github_url, args.linkedin_url, len(paths)))
    if args.github_url:
        github = readers.fetched_profiles(readers.link_sources(spark, args.github_url), args.github_base)
    if args.linkedin_profiles:
        linkedin = readers.stored_profiles(spark, args.linkedin_profiles)
    config = DEFAULT
    if args.config:
        with open(args.config) as f:
            config = parse_config(f.read())
    store = Store(spark, args.store) if args.store else None
    if store and not store.writable():
        print("the store can't be written; the run is not stored", file=sys.stderr)
        store = None
    result = run_pipeline(spark, sources, config, store, github, linkedin, csv)
    for row in result.warnings.toLocalIterator():
        print(f"{row.stage}: {row.subject}: {row.message}", file=sys.stderr)
    lines = as_json(result.projected, config)
    if args.out:
        lines.write.mode("overwrite").text(args.out)
    else:
        for row in lines.toLocalIterator():
            print(row.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
