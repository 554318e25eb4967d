"""python -m crawlquarry [audit] PATH | diff OLD NEW | track STORE FETCHES | crawl FETCHES OUT: a thin command line over the operators."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crawlquarry import config as C
from crawlquarry.analysis import analyze
from crawlquarry.operators import diff as D
from crawlquarry.operators import parse as P
from crawlquarry.operators import track as T
from crawlquarry.sources import io

COMMANDS = ("audit", "diff", "track", "crawl")
CRAWLERS_DDL = "ord int, name string, tokens array<string>, category string, ua string"
FORMATS = ("lines", "summary", "markdown", "html", "json", "csv")


def main(argv: list[str] | None = None) -> int:
    """Exit 0: fine, 1: a gate failed, 2: an error.  Without a command, audit."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv.insert(0, "audit")
    top = argparse.ArgumentParser(prog="crawlquarry")
    sub = top.add_subparsers(dest="command", required=True)
    audit = sub.add_parser("audit")
    audit.add_argument("path")
    audit.add_argument("--fail-on", choices=["error", "warning", "info"])
    audit.add_argument("--format", choices=FORMATS, default="lines")
    diff = sub.add_parser("diff")
    diff.add_argument("old")
    diff.add_argument("new")
    diff.add_argument("--fail-on-change", action="store_true")
    track = sub.add_parser("track")
    track.add_argument("store", help="folder of <domain>/robots.txt")
    track.add_argument("fetches", help="Parquet of this run's fetches")
    track.add_argument("--summary-out")
    track.add_argument("--social-out")
    track.add_argument("--changed-out")
    track.add_argument("--dry-run", action="store_true")
    crawl = sub.add_parser("crawl")
    crawl.add_argument("fetches", help="Parquet of fetches")
    crawl.add_argument("out")
    for command in (audit, track, crawl):
        command.add_argument("--config")
        command.add_argument("--crawlers", help="Parquet of crawlers: ord, name, tokens, category")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("crawlquarry").getOrCreate()
    try:
        return {"audit": _audit, "diff": _diff, "track": _track, "crawl": _crawl}[args.command](spark, args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _pack(spark: SparkSession, args):
    crawlers = spark.read.parquet(args.crawlers) if args.crawlers else spark.createDataFrame([], CRAWLERS_DDL)
    return crawlers, C.load(*([Path(args.config)] if args.config else []))


def _audit(spark: SparkSession, args) -> int:
    a = analyze(io.text_files(spark, args.path), *_pack(spark, args))
    rank = {"error": 0, "warning": 1, "info": 2}
    worst = 3
    if args.format == "lines":
        for r in a.issues.orderBy("file_id", "phase", "line").toLocalIterator():
            print(f"{r['level']}\t{r['line'] or ''}\t{r['id']}\t{r['message']}")
            worst = min(worst, rank[r["level"]])
        return int(bool(args.fail_on) and worst <= rank[args.fail_on])
    from crawlquarry.operators.rollup import tagged

    if args.format == "csv":
        for r in tagged(a.tabs).toLocalIterator():
            print(",".join('"' + (x or "").replace('"', '""') + '"' for x in r))
    else:
        rows = a.summary_text.select("text") if args.format == "summary" else a.report.select(args.format)
        for r in rows.toLocalIterator():
            print(r[0])
    if args.fail_on:
        worst = min((rank[r["level"]] for r in a.findings.select("level").distinct().toLocalIterator()), default=3)
    return int(bool(args.fail_on) and worst <= rank[args.fail_on])


def _diff(spark: SparkSession, args) -> int:
    one = lambda p: io.text_files(spark, p).select(F.lit(0).cast("long").alias("file_id"), "text")
    old, new = one(args.old), one(args.new)
    flags = D.text_flags(old, new).first()
    text = old.select("file_id", F.col("text").alias("a")).join(new.select("file_id", F.col("text").alias("b")), "file_id").select(D.unified_diff("a", "b").alias("d")).first()
    print(text["d"])
    return int(args.fail_on_change and flags["is_changed"])


def _track(spark: SparkSession, args) -> int:
    crawlers, config = _pack(spark, args)
    key = F.xxhash64("domain").alias("file_id")
    have = Path(args.store).is_dir() and any(Path(args.store).iterdir())
    kept = io.read_snapshots(spark, args.store) if have else spark.createDataFrame([], f"domain string, text string, meta struct<{', '.join(c.replace(' ', ':', 1) for c in io.META_DDL.split(', '))}>")
    fetched = P.once_by_domain(spark.read.parquet(args.fetches))
    run = T.track(kept.select(key, F.col("domain").alias("name"), "text"), fetched.select(key, F.col("domain").alias("name"), "text", "status", "content_type"), crawlers, config)
    n = {k: getattr(run, k).count() for k in ("changed", "unchanged", "seeded", "unavailable")}
    print(", ".join(f"{k} {v}" for k, v in n.items()))
    for path, lines in ((args.summary_out, T.digest(run).orderBy("ord").select("text")), (args.social_out, run.drafts.orderBy("name").select(F.concat_ws("\n", "name", "text").alias("text"))), (args.changed_out, T.changed_list(run).orderBy("name").select(F.col("name").alias("text")))):
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.writelines(r["text"] + "\n" for r in lines.toLocalIterator())
    if not args.dry_run:
        moved = run.seeded.select("name").unionByName(run.changed.select("name"))
        io.write_store(fetched.join(moved.withColumnRenamed("name", "domain"), "domain", "left_semi").select("domain", "text", io.meta_of_fetch().alias("meta")), args.store)
    return 0


def _crawl(spark: SparkSession, args) -> int:
    crawlers, config = _pack(spark, args)
    a = analyze(P.files_of_fetches(spark.read.parquet(args.fetches)), crawlers, config, once=True)
    io.write_dataset(a.records, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
