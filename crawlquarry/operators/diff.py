"""Semantic diff of two versions of files, text diff, and change history over observations.

The two versions are full tables of parsed rows keyed by file_id (here: of the same site); every list of the diff is an
anti join or an inner join on keys, never a comparison of all pairs.
"""

from __future__ import annotations

import math
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from crawlquarry.operators import parse as P
from crawlquarry.operators.findings import looks_like_html, with_syntax
from crawlquarry.operators.match import file_verdicts
from crawlquarry.operators.recon import grave_paths
from crawlquarry.operators.snapshots import directive_lines

CONTEXT_LINES = 3
#: lines that occur more often keep their bit row, others build it again when it is needed
OFTEN = 64


def text_flags(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_id, is_changed (directive lines differ, in order), text_changed (trimmed text differs); files of both sides."""
    both = old.select("file_id", F.coalesce("text", F.lit("")).alias("a")).join(new.select("file_id", F.coalesce("text", F.lit("")).alias("b")), "file_id")
    bare = lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")
    return both.select("file_id", (directive_lines(F.col("a")) != directive_lines(F.col("b"))).alias("is_changed"), (bare(F.col("a")) != bare(F.col("b"))).alias("text_changed"))


def verdict_flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """Crawlers of both sides whose verdict differs: file_id, crawler, category, old_verdict, new_verdict."""
    return (
        old.select("file_id", "crawler", F.col("verdict").alias("old_verdict")).join(new.select("file_id", "crawler", "category", F.col("verdict").alias("new_verdict")), ["file_id", "crawler"])
        .where("old_verdict <> new_verdict").select("file_id", "crawler", "category", "old_verdict", "new_verdict")
    )


def one_sided(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is on one side only, with side `new` or `resolved`; repeats are kept."""
    fresh = new.join(old.select("file_id", *keys).distinct(), ["file_id", *keys], "left_anti").select("file_id", *keys, F.lit("new").alias("side"))
    gone = old.join(new.select("file_id", *keys).distinct(), ["file_id", *keys], "left_anti").select("file_id", *keys, F.lit("resolved").alias("side"))
    return fresh.unionByName(gone)


def security_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    return one_sided(old, new, ["path", "category"])


def wording(variant: Column, params: Column) -> Column:
    return F.to_json(F.named_struct(F.lit("variant"), variant, F.lit("params"), F.array_sort(F.map_entries(params))))


def issue_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Issues by id and wording (variant and parameters): a shifted line is no change."""
    worded = lambda df: df.select("file_id", "id", wording(F.col("variant"), F.col("params")).alias("message"))
    return one_sided(worded(old), worded(new), ["id", "message"])


def sitemap_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    return one_sided(old, new, ["url"])


def high_impact(flips: DataFrame, security: DataFrame, issues: DataFrame, severities: DataFrame, error_ids: DataFrame) -> DataFrame:
    """Files with a verdict flip, a new high-severity path or a new error: file_id."""
    high = security.where("side = 'new'").join(severities.where("severity = 'high'").select("file_id", "path").distinct(), ["file_id", "path"], "left_semi").select("file_id")
    errors = issues.where("side = 'new'").join(error_ids.where("level = 'error'").select("file_id", "id").distinct(), ["file_id", "id"], "left_semi").select("file_id")
    return flips.select("file_id").unionByName(high).unionByName(errors).distinct()


def weights(versions: DataFrame, crawlers: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Versions (text, any keys) as keys, issues (id, level, message), grave (paths of high severity) and verdicts: what is_grave compares.

    All of it is made in the row of the version and is short, so versions meet without their texts.
    """
    keys = [c for c in versions.columns if c != "text"]
    found = with_syntax(P.parse(versions)).select(
        *keys, "groups", F.transform("found", lambda f: F.struct(f["id"].alias("id"), f["level"].alias("level"), wording(f["variant"], f["params"]).alias("message"))).alias("issues"), grave_paths(F.col("groups"), config).alias("grave")
    )
    return file_verdicts(found, crawlers, *keys, "issues", "grave")


def is_grave(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Does a new version flip a verdict, add a path of high severity or an issue whose id has an error in it?  (See high_impact.)

    Both are judged for the same crawlers, so a flip is a crawler with more than one verdict in the two.
    """
    names = F.array_distinct(F.transform(new["verdicts"], lambda v: v["crawler"]))
    flip = ((old["verdicts"] != new["verdicts"]) | (F.size(names) < F.size(new["verdicts"]))) & (F.size(F.array_union(old["verdicts"], new["verdicts"])) > F.size(names))
    path = F.size(F.array_except(new["grave"], old["grave"])) > 0
    wrong = F.transform(F.filter(new["issues"], lambda i: i["level"] == "error"), lambda i: i["id"])
    fresh = lambda i: F.array_contains(wrong, i["id"]) & ~F.exists(old["issues"], lambda o: (o["id"] == i["id"]) & (o["message"] == i["message"]))
    return flip | path | F.exists(new["issues"], fresh)


class _CommonRows:
    """Rows of the table of longest common subsequences of the ends of x and y, as integers.

    Bit k of row r is 0 where the last k + 1 lines of y have one line more in common with the last r lines of x than the
    last k have (bit-parallel recurrence).  About sqrt(len(x)) rows are kept and those between two of them made again.
    """

    def __init__(self, x: list[str], y: list[str]) -> None:
        self.x, self.width, self.full = x, len(y), (1 << len(y)) - 1
        self.places: dict[str, list[int]] = {}
        for k, line in enumerate(reversed(y)):
            self.places.setdefault(line, []).append(k)
        self.often: dict[str, int] = {}
        self.step, self.base, self.block = math.isqrt(len(x)) + 1, -1, []
        self.kept, row = [self.full], self.full
        for r in range(1, len(x) + 1):
            row = self._next(row, r)
            if r % self.step == 0:
                self.kept.append(row)

    def _next(self, row: int, r: int) -> int:
        same = row & self._where(self.x[-r])
        return (row + same | row - same) & self.full

    def _where(self, line: str) -> int:
        places = self.places.get(line)
        if places is None:
            return 0
        if line in self.often:
            return self.often[line]
        bits = bytearray(self.width // 8 + 1)
        for k in places:
            bits[k >> 3] |= 1 << (k & 7)
        found = int.from_bytes(bits, "little")
        if len(places) > OFTEN:
            self.often[line] = found
        return found

    def pair(self, r: int) -> tuple[int, int]:
        """Rows r - 1 and r."""
        base = (r - 1) // self.step
        if base != self.base:
            self.base, self.block = base, [self.kept[base]]
            for k in range(base * self.step + 1, min((base + 1) * self.step, len(self.x)) + 1):
                self.block.append(self._next(self.block[-1], k))
        at = r - base * self.step
        return self.block[at - 1], self.block[at]


def _edits(x: list[str], y: list[str]) -> list[tuple[str, str]]:
    """Kept, deleted and added lines by longest common subsequence of lines of any number; deletions first on ties."""
    ops: list[tuple[str, str]] = []
    rows = _CommonRows(x, y) if x and y else None
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            ops.append((" ", x[i]))
            i, j = i + 1, j + 1
            continue
        below, row = rows.pair(len(x) - i)
        rest = (1 << len(y) - j) - 1
        gain = (below & rest).bit_count() - (row & rest).bit_count()  # of x[i:] over x[i + 1:], against y[j:]
        while gain and j < len(y) and x[i] != y[j]:
            k = len(y) - 1 - j
            gain += (row >> k & 1) - (below >> k & 1)
            ops.append(("+", y[j]))
            j += 1
        if not gain:
            ops.append(("-", x[i]))
            i += 1
    return ops + [("-", s) for s in x[i:]] + [("+", s) for s in y[j:]]


def unified_lines(old: str, new: str, context: int = CONTEXT_LINES) -> str:
    """Text diff by longest common subsequence: deletions before additions on ties, `...` between hunks."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    ops: list[tuple[str, str]] = [(" ", s) for s in a[:head]] + _edits(x, y)
    ops += [(" ", s) for s in a[len(a) - tail :]] if tail else []
    changed = [k for k, (m, _) in enumerate(ops) if m != " "]
    if not changed:
        return ""
    shown = sorted({n for k in changed for n in range(max(0, k - context), min(len(ops), k + context + 1))})
    out, last = [], None
    for k in shown:
        if last is not None and k != last + 1:
            out.append("...")
        out.append(ops[k][0] + ops[k][1])
        last = k
    return "\n".join(out)


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """unified_lines over Arrow batches: dynamic programming that no native expression gives."""
    return pd.Series([unified_lines(a, b) for a, b in zip(old, new)])


def transient(status: Column, content_type: Column, body: Column) -> Column:
    """Answers that say nothing about the file: HTML pages, 403, 429 and server errors."""
    head = F.lower(F.left(F.coalesce(body, F.lit("")), F.lit(64)))
    html = F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html") | F.ltrim(head).startswith("<!doctype html") | F.ltrim(head).startswith("<html")
    return html | status.isin(403, 429) | (status >= 500)


def change_history(observations: DataFrame) -> DataFrame:
    """Events of each site over its observations (domain, observed_at, obs_id, status, content_type, body).

    An observation counts unless it is transient, or comes before any that counts with a status other than 404 or 410.
    An event is the first counted observation (`seeded`) and each later one whose directive lines differ from the one
    before (`changed`).  Window over the site's own rows; ties of time fall to obs_id.  Null domain or time: left out.
    """
    rows = observations.where("domain is not null and observed_at is not null")
    usable = F.coalesce(F.col("status").between(200, 299), F.lit(False)) & ~looks_like_html(F.coalesce("body", F.lit("")))
    rows = rows.withColumns({"t": F.coalesce(transient(F.col("status"), F.col("content_type"), F.col("body")), F.lit(True)), "lines": directive_lines(F.when(usable, F.col("body")).otherwise(""))})
    rows = rows.withColumn("print", F.xxhash64(F.array_join("lines", "\n"))).select("domain", "observed_at", "obs_id", "status", "t", "print", F.size("lines").alias("n_lines"))
    # transient rows count only as a seed with 404 or 410, and there their text is empty
    w = Window.partitionBy("domain").orderBy("observed_at", "obs_id")
    counted = rows.withColumn("earlier", F.coalesce(F.max(F.when(~F.col("t"), 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counted = counted.where("not t or (earlier = 0 and status in (404, 410))")
    before = F.lag("print").over(w)
    out = counted.withColumn("event", F.when(F.row_number().over(w) == 1, "seeded").when(F.col("print") != before, "changed"))
    return out.where("event is not null").select("domain", "observed_at", "obs_id", "status", "event", "n_lines")
