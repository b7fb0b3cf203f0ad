"""Command line: scan, rules, schema."""

from __future__ import annotations

import argparse
import json
import os
import stat
import sys
from pathlib import Path

from granary.extract.archive import MEMBER_BYTES, TOTAL_BYTES, Bounds
from granary.plans import policy as P


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="granary", description="A cryptography inventory of Python wheels")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="scan wheels")
    s.add_argument("inputs", nargs="*", help="folders or wheels")
    s.add_argument("-o", "--output", required=True, help="a folder of part files; one file if it ends in .jsonl, or for md and html")
    s.add_argument("--format", choices=("jsonl", "md", "html"), default="jsonl")
    s.add_argument("--jobs", type=int, help="local cores, where no cluster is set")
    s.add_argument("--from-file", help="a file of paths, one a line")
    s.add_argument("--index-url", help="a page of wheel links, whose wheels are fetched first")
    s.add_argument("--download-dir", help="where fetched wheels go")
    s.add_argument("--ruleset", help="a policy file, or a folder of them, in place of the built-in one")
    s.add_argument("--evidence-level", choices=("standard", "minimal"), default="standard")
    s.add_argument("--cache-dir", help="records kept between runs (by default in the user's cache folder)")
    s.add_argument("--no-cache", action="store_true")
    s.add_argument("--resume", action="store_true")
    s.add_argument("--max-binary-bytes", type=int, default=MEMBER_BYTES, help="bytes that a member may unpack to")
    s.add_argument("--max-total-bytes", type=int, default=TOTAL_BYTES, help="bytes that an archive may unpack to")
    s.add_argument("-q", "--quiet", action="store_true", help="no counts on standard error")
    r = sub.add_parser("rules", help="print the policy's rules and standards")
    r.add_argument("--format", choices=("md", "json"), default="md")
    r.add_argument("--ruleset")
    sub.add_parser("schema", help="print the JSON Schema of a record")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return {"scan": _scan, "rules": _rules, "schema": _schema}[args.command](args)


def cache_root() -> Path:
    """Where records are kept if nothing else is said."""
    base = os.environ.get("XDG_CACHE_HOME")
    return (Path(base) if base else Path.home() / ".cache") / "granary"


def unfit(output: str) -> bool:
    """Whether an output exists that a rename cannot replace: a link, device or pipe."""
    try:
        mode = os.lstat(output).st_mode
    except OSError:
        return False
    return not (stat.S_ISREG(mode) or stat.S_ISDIR(mode))


def _fail(message: object, code: int = 2) -> int:
    print(message, file=sys.stderr)
    return code


def _scan(args: argparse.Namespace) -> int:
    if not args.inputs and not args.from_file and not args.index_url:
        return _fail("nothing to scan")
    if args.resume and args.format != "jsonl":
        return _fail("only jsonl output can be resumed")
    if args.index_url and not args.download_dir:
        return _fail("fetched wheels need a --download-dir")
    if unfit(args.output):
        return _fail(f"{args.output} is neither a file nor a folder")
    try:
        policy = P.load(args.ruleset)
    except (P.PolicyError, OSError, ValueError) as e:
        return _fail(e)
    from pyspark.sql import SparkSession

    from granary.sources import discovery

    build = SparkSession.builder.appName("granary")
    spark = (build.master(f"local[{args.jobs}]") if args.jobs else build).getOrCreate()
    inputs = list(args.inputs)
    if args.index_url:
        page = spark.createDataFrame([(args.index_url, discovery._over_http(args.index_url).decode("utf-8", "replace"))], "url string, html string")
        inputs += [r["path"] for r in discovery.fetched(discovery.index_links(page, "url", "html"), "link", args.download_dir).collect()]
    wheels = discovery.from_listing(spark, args.from_file) if args.from_file else discovery.wheels(spark, *inputs)
    try:
        return _records(spark, args, policy, wheels)
    except OSError as e:
        return _fail(e, 1)


def _records(spark, args: argparse.Namespace, policy: P.Policy, wheels) -> int:
    """Scan what has no record yet, and write all records in order of names.

    Only names and keys are joined; wheels are read where they lie."""
    from pyspark.sql import Observation

    from granary.plans.keep import kept
    from granary.plans.scan import Scan
    from granary.sinks import jsonl
    from granary.sinks.cache import RecordCache, keyed
    from granary.sources import discovery

    bounds = Bounds(args.max_binary_bytes, args.max_total_bytes)
    names, todo, known = discovery.names(wheels), wheels, []
    if args.resume and Path(args.output).exists():
        before = kept(jsonl.resumable(spark, args.output), "resumed")
        known.append(names.join(before, "filename").select("path", "filename", "line"))
        todo = discovery.only(spark, names.join(before, "filename", "left_anti"))
    cache = None
    if not args.no_cache and todo is not None:
        root = args.cache_dir or cache_root().as_uri()
        cache = RecordCache(spark, root, policy.version, args.evidence_level, f"{bounds.member}/{bounds.total}")
        keys = kept(keyed(todo), "keys")
        known.append(kept(cache.found(keys).select("path", "filename", "line"), "cached"))
        todo = discovery.only(spark, cache.misses(keys))
    out = known
    if todo is not None:
        seen = Observation("scan")
        records = kept(Scan(todo, policy, evidence_level=args.evidence_level, bounds=bounds).records(seen), "records")
        if cache:
            cache.put(records)
        out = [*known, records.select("path", "filename", "line")]
        if not args.quiet:
            print(", ".join(f"{k} {v or 0}" for k, v in seen.get.items()), file=sys.stderr)
    first, *more = out
    for x in more:
        first = first.unionByName(x)
    _write(spark, args, policy, first)
    return 0


def _write(spark, args: argparse.Namespace, policy: P.Policy, records) -> None:
    """Aside first, as the output may be what is resumed from; the old one goes last."""
    from granary.sinks import jsonl, report

    partial, old = f"{args.output}.partial", f"{args.output}.old"
    if args.format == "jsonl" and not args.output.endswith(".jsonl"):
        jsonl.write(records, partial, "overwrite")
    else:
        lines = (r["line"] for r in records.sort(*jsonl.order(records)).select("line").toLocalIterator())
        if args.format == "jsonl":
            with open(partial, "w") as f:
                f.writelines(f"{line}\n" for line in lines)
        else:
            rows = [json.loads(line) for line in lines]
            Path(partial).write_text(report.markdown(rows) if args.format == "md" else report.page(rows, policy))
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = path(args.output).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(old), True)
    if fs.exists(path(args.output)):
        fs.rename(path(args.output), path(old))
    fs.rename(path(partial), path(args.output))
    fs.delete(path(old), True)


def _rules(args: argparse.Namespace) -> int:
    policy = P.load(args.ruleset)
    if args.format == "json":
        print(json.dumps({"rules": policy.entries("rule"), "standards": policy.entries("standard")}, sort_keys=True))
        return 0
    from granary.sinks.report import table

    print(table(("rule", "layer", "severity", "verdict", "relation"), [[r["id"], r["layer"], r["severity"], r.get("verdict", "-"), r.get("relation", "-")] for r in policy.entries("rule")]))
    print()
    print(table(("standard", "status", "edition", "successor"), [[s["id"], s["status"], s["edition"], s.get("successor", "-")] for s in policy.entries("standard")]))
    return 0


def _schema(args: argparse.Namespace) -> int:
    from granary.sinks.schema import record_schema

    print(json.dumps(record_schema(P.load().precedence), sort_keys=True, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
