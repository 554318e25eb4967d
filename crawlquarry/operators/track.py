"""One tracking run: kept and new versions of sites to a nested diff each, and the run's outputs.

`kept` holds the snapshot of every site seen before (file_id, name, text), `fetched` this run's answers (file_id, name, text,
status, content_type).  Everything is keyed by file_id, one exchange a list; the outputs hold a run's changes only.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions.presentation import diff_rendered, social_text
from crawlquarry.operators import diff as D
from crawlquarry.operators import findings as G
from crawlquarry.operators import match as M
from crawlquarry.operators import parse as P
from crawlquarry.operators import recon as R
from crawlquarry.operators.findings import looks_like_html


def flips_in(flips: DataFrame, category: str) -> DataFrame:
    """The flips of crawlers of one category."""
    return flips.where(F.col("category") == category)


@dataclass(frozen=True)
class Run:
    """Tables of a run: seeded, changed (nested diffs), unchanged, unavailable (with why), drafts, high_impact."""

    seeded: DataFrame
    changed: DataFrame
    unchanged: DataFrame
    unavailable: DataFrame
    drafts: DataFrame
    high_impact: DataFrame


def track(kept: DataFrame, fetched: DataFrame, crawlers: DataFrame, config: dict[str, Any]) -> Run:
    """What a run says about every fetched site.

    A site without a snapshot is seeded by an answer that crawlers saw (2xx without a page, 404, 410); an answer that may pass
    (a bot wall, a server error, a page) leaves the snapshot of a site alone and makes it unavailable.
    """
    body = F.coalesce("text", F.lit(""))
    page = looks_like_html(body)
    usable = F.coalesce(F.col("status").between(200, 299), F.lit(False)) & ~page
    now = fetched.select(
        "file_id", "name", "status", F.coalesce(D.transient(F.col("status"), F.col("content_type"), F.col("text")), F.lit(True)).alias("passing"), page.alias("page"), F.when(usable, body).otherwise("").alias("b")
    )
    seen = now.join(kept.select("file_id", F.coalesce("text", F.lit("")).alias("a")), "file_id", "left")
    first, again = seen.where("a is null"), seen.where("a is not null")
    seeds = ~F.col("passing") | F.col("status").isin(404, 410)
    why = F.concat_ws(" ", F.lit("HTTP"), F.col("status").cast("string"), F.when(F.col("page"), F.lit("page")))
    held = F.col("passing") & (F.col("a") != "")
    unavailable = first.where(~seeds).select("file_id", "name", F.concat(why, F.lit(", not seeded yet")).alias("why")).unionByName(again.where(held).select("file_id", "name", why.alias("why")))
    pairs = again.where(~held)
    flags = D.text_flags(pairs.select("file_id", F.col("a").alias("text")), pairs.select("file_id", F.col("b").alias("text")))
    moved = pairs.join(flags.where("is_changed").select("file_id"), "file_id", "left_semi")
    old, new = (P.parse(moved.select("file_id", F.col(k).alias("text"))) for k in ("a", "b"))
    flips = D.verdict_flips(M.crawler_verdicts(old, crawlers), M.crawler_verdicts(new, crawlers))
    paths = [R.sensitive_paths(x, config) for x in (old, new)]
    security = D.security_changes(*paths)
    found = [G.with_overrides(G.syntax_findings(x), config["rules"]["disabled"], config["rules"]["levels"]) for x in (old, new)]
    issues = D.issue_changes(*found)
    maps = D.sitemap_changes(P.sitemaps(old), P.sitemaps(new))
    lists = {"flips": (flips, ("crawler", "category", "old_verdict", "new_verdict")), "security": (security, ("path", "category", "side")), "issues": (issues, ("id", "message", "side")), "sitemaps": (maps, ("url", "side"))}
    changed = moved.select("file_id", "name", "status", D.unified_diff("a", "b").alias("text"))
    for name, (df, cols) in lists.items():
        changed = changed.join(df.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)), "file_id", "left")  # changes of one file
    drafts = social_text(flips, security).join(moved.select("file_id", "name"), "file_id")
    high = D.high_impact(flips, security, issues, paths[1], found[1])
    return Run(first.where(seeds).select("file_id", "name", F.col("b").alias("text")), changed, pairs.join(flags.where("not is_changed").select("file_id"), "file_id", "left_semi").select("file_id", "name"), unavailable, drafts, high)


def digest(run: Run) -> DataFrame:
    """ord, text: the digest of a run, one row a part: the counts, each changed site, each unavailable one."""
    counts = None
    for i, (what, df) in enumerate((("changed", run.changed), ("unchanged", run.unchanged), ("new", run.seeded), ("unavailable", run.unavailable))):
        part = df.agg(F.count("*").alias("n")).select(F.struct(F.lit(0).alias("part"), F.lit(i).cast("string").alias("key")).alias("ord"), F.concat(F.lit(f"- {what}: "), F.col("n").cast("string")).alias("text"))
        counts = part if counts is None else counts.unionByName(part)
    sites = diff_rendered(run.changed.drop("status")).select(F.struct(F.lit(1).alias("part"), F.col("name").alias("key")).alias("ord"), F.col("markdown").alias("text"))
    away = run.unavailable.select(F.struct(F.lit(2).alias("part"), F.col("name").alias("key")).alias("ord"), F.concat(F.lit("- "), "name", F.lit(": "), "why").alias("text"))
    return counts.unionByName(sites).unionByName(away)


def changed_list(run: Run) -> DataFrame:
    return run.changed.select("name")
