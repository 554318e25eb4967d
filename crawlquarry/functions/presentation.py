"""Reports as Markdown, HTML and text.  Presentation is built from nested rows in Arrow batches."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def markdown_of(report: dict) -> str:
    """Sections: summary, recommended actions, issues, crawlers, sensitive paths, sitemaps, what the file gives away, groups."""
    out = ["# robots.txt audit", "", "## Summary", ""]
    for k in ("size", "n_groups", "n_rules", "n_sitemaps", "errors", "warnings", "infos", "security_findings", "policy", "platform"):
        if report.get(k) is not None:
            out.append(f"- {k.replace('_', ' ')}: {report[k]}")
    if report.get("actions") is not None:
        out += ["", "## Recommended actions", ""]
        for i, a in enumerate(report["actions"]):
            where = f" (lines {', '.join(map(str, a['lines']))})" if a.get("lines") else ""
            items = ": " + ", ".join(f"`{x}`" for x in a["items"]) if a.get("items") else ""
            out.append(f"- {i + 1}. {a['action']}{items}{where}")
    issues = [f for f in report.get("findings") or [] if f["level"] != "info"]
    out += ["", "## Issues", ""] + ([f"- {f['level']}: `{f['id']}`" + (f" (line {f['line']})" if f.get("line") else "") for f in issues] or ["None."])
    out += ["", "## Crawlers", "", "| crawler | group | verdict |", "| --- | --- | --- |"]
    out += [f"| {c['crawler']} | {c.get('token') or '–'} | {c['verdict']} |" for c in report.get("crawlers") or []]
    out += ["", "## Sensitive paths", ""] + ([f"- `{s['path']}` (line {s['line']}): {s['category']}, {s['severity']}" for s in report.get("security") or []] or ["None."])
    out += ["", "## Sitemaps", ""] + ([f"- {m['url']} (line {m['line']})" for m in report.get("sitemaps") or []] or ["None."])
    if report.get("recon") is not None or report.get("actions") is not None:
        rows = ["| {} | {} | {} |".format(r["category"], r.get("line") or "–", r["item"].replace("|", "\\|")) for r in report.get("recon") or []]
        out += ["", "## What the file gives away", ""] + (["| kind | line | item |", "| --- | --- | --- |", *rows] if rows else ["None."])
    out += ["", "## Groups", ""]
    for g in report.get("groups") or []:
        out.append(f"- {', '.join(a['raw'] for a in g['agents'])}: {len(g['rules'])} rules")
    return "\n".join(out) + "\n"


def html_of(markdown: str) -> str:
    """A subset of Markdown (headings, lists, tables, code) as an HTML document."""
    inline = lambda s: re.sub(r"`([^`]*)`", r"<code>\1</code>", html.escape(s, quote=False))
    out, state = ["<!doctype html><meta charset=\"utf-8\"><title>robots.txt audit</title>"], ""
    for line in [*markdown.split("\n"), ""]:
        kind = "ul" if line.startswith("- ") else "table" if line.startswith("|") else ""
        if kind != state:
            out += [f"</{state}>"] if state else []
            out += [f"<{kind}>"] if kind else []
            state = kind
        if kind == "ul":
            out.append(f"<li>{inline(line[2:])}</li>")
        elif kind == "table":
            cells = [c.strip() for c in line.strip("|").split("|")]
            if not all(re.fullmatch(r"-+", c) for c in cells):
                out.append("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in cells) + "</tr>")
        elif m := re.match(r"(#+) (.*)", line):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif line:
            out.append(f"<p>{inline(line)}</p>")
    return "\n".join(out)


@F.pandas_udf(StringType())
def _markdown(reports: pd.Series) -> pd.Series:
    return reports.map(lambda r: markdown_of(json.loads(r)))


@F.pandas_udf(StringType())
def _html(markdown: pd.Series) -> pd.Series:
    return markdown.map(html_of)


def rendered(reports: DataFrame) -> DataFrame:
    """nested_report rows as json, markdown and html."""
    as_json = reports.select("file_id", F.to_json("report").alias("json"))
    return as_json.withColumn("markdown", _markdown("json")).withColumn("html", _html("markdown"))


ICONS = {"blocked": "⛔", "partial": "⚠️", "open": "✅"}


def social_text(flips: DataFrame, security: DataFrame | None = None) -> DataFrame:
    """file_id, text: a short post about the verdict flips of a file, and how many sensitive paths are new."""
    icon = F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv])
    one = F.struct("crawler", F.concat_ws(" ", F.element_at(icon, F.col("new_verdict")), F.concat("crawler", F.lit(":")), "old_verdict", F.lit("→"), "new_verdict").alias("t"))
    said = flips.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n").alias("flips"))
    if security is None:
        return said.select("file_id", F.col("flips").alias("text"))
    fresh = security.where("side = 'new'").groupBy("file_id").agg(F.concat(F.count("*").cast("string"), F.lit(" new sensitive paths")).alias("paths"))
    return said.join(fresh, "file_id", "full").select("file_id", F.concat_ws("\n", "flips", "paths").alias("text"))


def diff_markdown(diff: dict) -> str:
    """Markdown of one file's semantic diff: name, flips, security, issues, sitemaps, text."""
    out = [f"### {diff['name']}", ""]
    if diff.get("flips"):
        out += ["| crawler | category | before | after |", "| --- | --- | --- | --- |"] + [f"| {f['crawler']} | {f['category']} | {f['old_verdict']} | {f['new_verdict']} |" for f in diff["flips"]] + [""]
    for key, title, show in (("security", "Sensitive paths", lambda x: f"`{x['path']}` ({x['category']})"), ("issues", "Issues", lambda x: f"`{x['id']}`"), ("sitemaps", "Sitemaps", lambda x: x["url"])):
        for side, word in (("new", "new"), ("resolved", "gone")):
            rows = [x for x in diff.get(key) or [] if x["side"] == side]
            if rows:
                out += [f"#### {title}, {word}", "", *[f"- {show(x)}" for x in rows], ""]
    if diff.get("text"):
        out += ["```diff", diff["text"].rstrip("\n"), "```", ""]
    return "\n".join(out)


@F.pandas_udf(StringType())
def _diff_markdown(diffs: pd.Series) -> pd.Series:
    return diffs.map(lambda r: diff_markdown(json.loads(r)))


def diff_rendered(diffs: DataFrame) -> DataFrame:
    """name, markdown of nested diffs (file_id, name, flips, security, issues, sitemaps, text)."""
    return diffs.select("file_id", "name", _diff_markdown(F.to_json(F.struct(*[c for c in diffs.columns if c != "file_id"]))).alias("markdown"))
