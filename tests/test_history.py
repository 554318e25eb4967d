"""Snapshot changes, semantic diff, change history in batch and stream, sources."""

import datetime as dt
import json
import random

import numpy as np
from pyspark.sql import functions as F

from crawlquarry import config as C
from crawlquarry.operators import diff as D
from crawlquarry.operators import findings as G
from crawlquarry.operators import match as M
from crawlquarry.operators import parse as P
from crawlquarry.operators import recon as R
from crawlquarry.operators.snapshots import diff_sorted, snapshot_changes
from crawlquarry.plans import engine_queries as E
from crawlquarry.sources import io
from crawlquarry.streaming import tracker

SNAP = "snap_id long, run_no int, domain string, http_status int, final_url string, unavailable boolean, html boolean, robots_txt string, verdicts map<string,string>, fetched_at timestamp, domain_copy string"
T0 = dt.datetime(2026, 1, 1)


def snap(i, run, domain, status=200, url="u", text="a", verdicts=None, at=0, html=False):
    return (i, run, domain, status, url, False, html, text, verdicts, T0 + dt.timedelta(days=run or 0, minutes=at) if at is not None else None, "x")


def changes(spark, rows):
    return sorted(tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SNAP)).select("run_no", "domain", "change_kind").collect())


def test_snapshot_changes_small(spark):
    rows = [
        snap(1, 1, "a"), snap(2, 1, "b"), snap(3, 1, "c", verdicts={"x": "open", "y": None}), snap(4, 1, "d", url=None),
        snap(5, 4, "a", text="a # note\r\n\r\n"), snap(6, 4, "b", text="b"), snap(7, 4, "c", verdicts={"x": "open", "y": "open", "z": "open"}), snap(8, 4, "d", url=None), snap(8, 4, "d", url=None), snap(9, 4, "e", text=None),
        snap(10, 4, "b", text="a", at=9), snap(11, 9, "e", text="# only"), snap(12, 9, "c", verdicts={"w": "open"}), snap(13, None, "a"), snap(14, 9, None), snap(15, 9, "d", url="u"),
    ]
    assert changes(spark, rows) == [(4, "c", "changed"), (4, "e", "added"), (9, "a", "removed"), (9, "b", "removed"), (9, "d", "changed")]
    assert changes(spark, []) == [] and changes(spark, rows[:4]) == []


def test_snapshot_changes_random(spark):
    rnd = random.Random(3)
    rows, n = [], 0
    for run in (1, 2, 5):
        for k in range(60):
            for _ in range(rnd.choice([0, 1, 1, 1, 2])):
                n += 1
                rows.append(snap(n, run, f"d{k}", status=rnd.choice([200, 200, None]), text=rnd.choice(["a", "a\nb", None]), verdicts=rnd.choice([None, {"x": "open"}, {"x": "blocked"}]), at=rnd.choice([0, 1, None])))
    want = []
    standing = {}
    for r in rows:
        key = (r[1], r[2])
        rank = (r[9] is not None, r[9] or T0, r[0])
        if key not in standing or rank > standing[key][0]:
            standing[key] = (rank, r)
    for a, b in ((1, 2), (2, 5)):
        for d in {k[1] for k in standing if k[0] in (a, b)}:
            p, c = standing.get((a, d)), standing.get((b, d))
            if not p or not c:
                want.append((b, d, "added" if c else "removed"))
                continue
            p, c = p[1], c[1]
            lines = lambda t: [x for x in (t or "").split("\n") if x]
            flips = any(k in (p[8] or {}) and p[8][k] != v for k, v in (c[8] or {}).items())
            if p[3] != c[3] or lines(p[7]) != lines(c[7]) or flips:
                want.append((b, d, "changed"))
    assert changes(spark, rows) == sorted(want)


def test_diff_sorted_edges():
    e = np.array([], dtype=np.int64)
    one = np.array([1, 5], dtype=np.int64)
    added, removed, differs = diff_sorted((e, e, e), (one, one, one))
    assert list(added) == [1, 5] and len(removed) == len(differs) == 0
    added, removed, differs = diff_sorted((one, one, one), (np.array([5, 9]), np.array([6, 0]), np.array([5, 0])))
    assert (list(added), list(removed), list(differs)) == ([9], [1], [5])


def test_semantic_diff(spark):
    f = lambda *t: spark.createDataFrame(list(enumerate(t)), "file_id long, text string")
    got = {r["file_id"]: (r["is_changed"], r["text_changed"]) for r in D.text_flags(f("a\n#x", "a", "a", None), f("a", "a\nb", "a ", "")).collect()}
    assert got == {0: (False, True), 1: (True, True), 2: (False, False), 3: (False, False)}
    old, new = spark.createDataFrame([(0, "u"), (0, "v")], "file_id long, url string"), spark.createDataFrame([(0, "v"), (0, "w"), (0, "w")], "file_id long, url string")
    assert sorted(tuple(r) for r in D.sitemap_changes(old, new).collect()) == [(0, "u", "resolved"), (0, "w", "new"), (0, "w", "new")]


def edits_by_table(x, y):
    common = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            common[i][j] = common[i + 1][j + 1] + 1 if x[i] == y[j] else max(common[i + 1][j], common[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append((" ", x[i]))
            i, j = i + 1, j + 1
        elif i < len(x) and (j == len(y) or common[i + 1][j] >= common[i][j + 1]):
            out.append(("-", x[i]))
            i += 1
        else:
            out.append(("+", y[j]))
            j += 1
    return out


def test_edits_are_those_of_the_whole_table(monkeypatch):
    rnd = random.Random(5)
    for often in (0, 64):
        monkeypatch.setattr(D, "OFTEN", often)
        for _ in range(400):
            letters = "abcdefghijklmnop"[: rnd.choice([1, 2, 4, 16])]
            x, y = ([rnd.choice(letters) for _ in range(rnd.randint(0, 40))] for _ in "ab")
            assert D._edits(x, y) == edits_by_table(x, y)


def test_long_texts_keep_their_common_lines():
    a = [f"Disallow: /{i}" for i in range(5000)]
    b = ["# new", *a[1:2500], "# middle", *a[2500:-1], "# end"]
    out = D.unified_lines("\n".join(a), "\n".join(b)).split("\n")
    assert [x for x in out if x[0] in "-+"] == ["-Disallow: /0", "+# new", "+# middle", "-Disallow: /4999", "+# end"]


def test_every_delivery_is_compared_with_the_next(spark, tmp_path):
    shut, free = "User-agent: *\nDisallow: /\nSitemap: https://a.example/s.xml", "User-agent: *\nDisallow:"
    rows = [snap(1, 1, "a", text=free), snap(2, 4, "a", text=shut), snap(3, 9, "a", text=free), snap(4, 4, "b", text=free), snap(5, 9, "c", text=free), snap(6, 1, "d", text=free), snap(7, 9, "d", text=shut)]
    rows += [snap(8, 4, "a", text=free, at=-9), snap(9, 1, "e", text=None), snap(10, 4, "e", text=free), snap(11, None, "a", text=shut), snap(11, None, "a", text=shut)]
    spark.createDataFrame(rows, SNAP).write.parquet(str(tmp_path / "site_snapshots.parquet"))
    spark.createDataFrame([(1, "X", ["x"], "ai_training")], "ord int, name string, tokens array<string>, category string").write.parquet(str(tmp_path / "crawlers.parquet"))
    got = {n: sorted(tuple(r) for r in E.QUERIES[n](spark, str(tmp_path)).collect()) for n in ("semantic_flags", "semantic_flips", "semantic_sitemaps", "unified_diffs", "semantic_issues")}
    pairs = [(1, 1, 4), (1, 4, 9), (6, 1, 9), (9, 1, 4)]
    assert [r[:3] for r in got["semantic_flags"]] == [r[:3] for r in got["unified_diffs"]] == pairs and all(r[3] and r[4] for r in got["semantic_flags"])
    assert got["semantic_flips"] == [(1, 1, 4, "X", "ai_training", "open", "blocked"), (1, 4, 9, "X", "ai_training", "blocked", "open"), (6, 1, 9, "X", "ai_training", "open", "blocked")]
    assert got["semantic_sitemaps"] == [(i, a, b, "https://a.example/s.xml", side) for (i, a, b), side in zip(pairs, ("new", "resolved", "new"))]
    assert {r[:3] for r in got["semantic_issues"]} == set(pairs)


def test_high_impact_meets_in_rows_without_joins(spark, tmp_path):
    rnd = random.Random(8)
    lines = ["User-agent: *", "User-agent: x", "Disallow: /", "Disallow: /admin/", "Disallow: /backup.sql", "Disallow: /.git/", "Allow: /a", "Host", "Sitemap: /m", "User-agent:", "Disallow /b", ""]
    rows = [snap(k, k % 5, f"s{k // 5}", text=rnd.choice([None, "", *["\n".join(rnd.choices(lines, k=rnd.randint(1, 6))) for _ in range(6)]])) for k in range(1, 80)]
    rows += [snap(90, None, "s1", text="Disallow: /"), snap(91, 2, "s1", text="User-agent: *\nDisallow: /", at=99)]
    spark.createDataFrame(rows, SNAP).write.parquet(str(tmp_path / "site_snapshots.parquet"))
    many = spark.createDataFrame([(1, "X", ["x"], "ai_training"), (2, "Y", ["y"], "search"), (3, "X", ["y"], "search"), (4, None, ["x"], "search")], "ord int, name string, tokens array<string>, category string")
    many.write.parquet(str(tmp_path / "crawlers.parquet"))
    got = E.QUERIES["high_impact"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Broadcast" not in plan
    for drop in (True, False):  # with one crawler of a name, and with two whose verdicts differ
        if drop:
            many.where("ord < 3").write.parquet(str(tmp_path / "one" / "crawlers.parquet"))
            spark.createDataFrame(rows, SNAP).write.parquet(str(tmp_path / "one" / "site_snapshots.parquet"))
        d = str(tmp_path / "one") if drop else str(tmp_path)
        old, new = (P.parse(x) for x in E._versions(spark, d))
        crawlers, config = spark.read.parquet(f"{d}/crawlers.parquet"), C.load()
        flips = D.verdict_flips(M.crawler_verdicts(old, crawlers), M.crawler_verdicts(new, crawlers))
        paths, found = [R.sensitive_paths(x, config) for x in (old, new)], [G.syntax_findings(x) for x in (old, new)]
        want = D.high_impact(flips, D.security_changes(*paths), D.issue_changes(*found), paths[1], found[1]).select("file_id.*").collect()
        assert 0 < len(want) and sorted(map(tuple, E.QUERIES["high_impact"](spark, d).collect())) == sorted(map(tuple, want))


def test_unified_lines():
    assert D.unified_lines("a\nb\nc", "a\nx\nc") == " a\n-b\n+x\n c"
    assert D.unified_lines("a", "a") == "" and D.unified_lines("", "n") == "+n" and D.unified_lines(None, "") == ""
    long = "\n".join(map(str, range(30)))
    out = D.unified_lines(long, long.replace("\n3\n", "\nX\n").replace("\n25\n", "\nY\n")).split("\n")
    assert "..." in out and "-3" in out and "+Y" in out


def machine(obs):
    """The state machine, said plainly."""
    out, text, counted = [], None, False
    for at, i, status, body in obs:
        t = status in (403, 429) or status >= 500
        lines = [x for x in (body or "").split("\n") if x] if 200 <= status < 300 else []
        if text is None:
            if t and status not in (404, 410):
                continue
            out.append((i, "seeded"))
            text, counted = lines, True
        elif not t:
            if lines != text:
                out.append((i, "changed"))
            text = lines
    return out


def test_change_history_batch_and_stream(spark, tmp_path):
    rnd = random.Random(5)
    rows, n = [], 0
    for d in range(25):
        for k in range(rnd.randint(1, 7)):
            n += 1
            rows.append((f"d{d}", T0 + dt.timedelta(days=k), n, rnd.choice([200, 200, 404, 503, 403]), "text/plain", rnd.choice(["a", "b", "", None])))
    df = spark.createDataFrame(rows, "domain string, observed_at timestamp_ntz, obs_id long, status int, content_type string, body string")
    want = sorted((f"d{d}", *e) for d in range(25) for e in machine([(r[1], r[2], r[3], r[5]) for r in rows if r[0] == f"d{d}"]))
    assert sorted((r["domain"], r["obs_id"], r["event"]) for r in D.change_history(df).collect()) == want
    for day in range(7):  # in order over the batches
        df.where(F.dayofyear("observed_at") == day + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{day}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = tracker.change_events(stream).writeStream.format("memory").queryName("events").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["domain"], r["obs_id"], r["event"]) for r in spark.table("events").collect())
    assert got == want


def test_domain_list(spark):
    lines = spark.createDataFrame([(0, "# c"), (1, '1,"B.example"'), (2, "a.example"), (3, "b.example"), (4, "nodot"), (5, "x.y/z"), (6, None), (7, " c.example ")], "ord long, line string")
    assert [r["domain"] for r in io.domain_list(lines).orderBy("ord").collect()] == ["b.example", "a.example", "c.example"]
    assert [r["domain"] for r in io.domain_list(lines, 1, 1).collect()] == ["a.example"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "store/a.example").mkdir(parents=True)
    (tmp_path / "store/a.example/robots.txt").write_text("User-agent: *\n")
    (tmp_path / "watch.json").write_text(json.dumps([{"domain": "a.example"}, {"domain": "b.example", "enabled": False}]))
    assert [(r["domain"], r["text"]) for r in io.read_snapshots(spark, f"{tmp_path}/store").collect()] == [("a.example", "User-agent: *\n")]
    assert [r["domain"] for r in io.watch_list(spark, f"{tmp_path}/watch.json").collect()] == ["a.example"]
    (tmp_path / "bad.txt").write_bytes(b"ok\xff")
    assert io.binary_files(spark, f"{tmp_path}/bad.txt").first()["text"] == "ok�"
    io.write_dataset(spark.createDataFrame([(1, "x")], "a int, b string"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1
    assert io.target_kind("-") == "stdin" and io.target_kind("a.example") == "url" and io.target_kind("x/y") == "path"


class Answer:
    def __init__(self, status, body=b"", **headers):
        self.status, self.reason, self.body, self.headers = status, "r", body, headers

    def read(self, n):
        return self.body[:n]


def test_fetch_follows_and_retries():
    def opener(request, timeout):
        if request.full_url == "https://a.example/robots.txt":
            raise OSError("down")
        if request.full_url == "https://www.a.example/robots.txt":
            return Answer(301, Location="/r.txt")
        return Answer(200, b"User-agent: *")

    got = io.fetch_one("a.example", "ua", 1, opener)
    assert got["status"] == 200 and got["final_url"] == "https://www.a.example/r.txt" and len(got["redirects"]) == 1 and got["text"] == "User-agent: *"
    loop = io.fetch_one("b.example", "ua", 1, lambda request, timeout: Answer(302, Location="/robots.txt"))
    assert loop["redirect_limit"] and loop["text"] == ""


# -- tracking runs -------------------------------------------------------------------------------------------------


def test_track(spark, tmp_path):
    from crawlquarry import config as C
    from crawlquarry.operators import track as T

    old = "User-agent: *\nDisallow: /a\n"
    kept = spark.createDataFrame([(1, "same", old), (2, "moved", old), (3, "walled", old), (4, "gone", old), (8, "empty", "")], "file_id long, name string, text string")
    rows = [
        (1, "same", old + "# x\n", 200, "text/plain"), (2, "moved", "User-agent: *\nDisallow: /\nDisallow: /backup/\nSitemap: https://m.example/s.xml\n", 200, "text/plain"), (3, "walled", "<html>no", 403, "text/html"), (4, "gone", None, 404, None),
        (5, "fresh", "User-agent: x\nDisallow:", 200, "text/plain"), (6, "wall", "<html>", 503, "text/html"), (7, "none", None, 404, None),
    ]
    crawlers = spark.createDataFrame([(1, "Loom", ["loom"], "ai_training")], "ord int, name string, tokens array<string>, category string")
    run = T.track(kept, spark.createDataFrame(rows, "file_id long, name string, text string, status int, content_type string"), crawlers, C.load())
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(run.unchanged) == ["same"] and names(run.seeded) == ["fresh", "none"] and names(run.changed)[-1] == "moved"
    assert {r["name"]: r["why"] for r in run.unavailable.collect()}["wall"] == "HTTP 503 page, not seeded yet" and "walled" in names(run.unavailable)
    moved = {r["name"]: r for r in run.changed.collect()}["moved"]
    assert [(f["crawler"], f["new_verdict"]) for f in moved["flips"]] == [("Loom", "blocked")] and [x["path"] for x in moved["security"]] == ["/backup/"] and moved["sitemaps"][0]["side"] == "new" and "+Disallow: /" in moved["text"]
    text = "\n".join(r["text"] for r in T.digest(run).orderBy("ord").collect())
    assert text.startswith("- changed:") and "### moved" in text and "| Loom | ai_training | partial | blocked |" in text and "- wall: HTTP 503" in text
    assert {r["name"]: r["text"] for r in run.drafts.collect()}["moved"] == "⛔ Loom: partial → blocked\n1 new sensitive paths"
    assert 2 in {r["file_id"] for r in run.high_impact.collect()} and T.flips_in(spark.createDataFrame([("a",), ("b",)], "category string"), "a").count() == 1


def test_store_round_trip(spark, tmp_path):
    from crawlquarry.sources import io

    rows = [("a.example", "x", ("a.example", None, None, 200, 1, None, 0, False, False)), ("b.example", "y", None)]
    schema = f"domain string, text string, meta struct<{', '.join(c.replace(' ', ':', 1) for c in io.META_DDL.split(', '))}>"
    io.write_store(spark.createDataFrame(rows, schema), str(tmp_path / "store"))
    got = {r["domain"]: (r["text"], r["meta"]["http_status"] if r["meta"] else None) for r in io.read_snapshots(spark, str(tmp_path / "store")).collect()}
    assert got == {"a.example": ("x", 200), "b.example": ("y", None)}


def test_probe_plan_and_filtered_notices(spark):
    from crawlquarry.sources import io

    sites = spark.createDataFrame([("a.example",), (None,)], "domain string")
    crawlers = spark.createDataFrame([(1, "Loom", "Loom/1"), (2, "No", None)], "ord int, name string, ua string")
    assert sorted((r["crawler"] or "", r["ua"]) for r in io.probe_plan(sites, crawlers).collect()) == [("", "Mozilla/5.0"), ("Loom", "Loom/1")]
    changes = spark.createDataFrame([(1, "x", None), (2, "y", None)], "file_id long, text string, webhook_url string")
    assert changes.join(spark.createDataFrame([(2,)], "file_id long"), "file_id", "left_semi").count() == 1
    io.notify(changes, high_impact=changes.limit(0))


def test_track_on_the_command_line(spark, tmp_path, capsys):
    from crawlquarry.__main__ import main

    fetch = "fetch_id long, domain string, robots_url string, final_url string, status int, content_type string, redirect_limit boolean, bytes long, redirects array<struct<from_url:string>>, text string, observed_at timestamp"
    spark.createDataFrame([(1, "a.example", None, None, 200, "text/plain", False, 5, None, "User-agent: *\nDisallow: /", None)], fetch).write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([(2, "a.example", None, None, 200, "text/plain", False, 5, None, "User-agent: *\nDisallow: /b", None)], fetch).write.parquet(str(tmp_path / "two"))
    store, out = str(tmp_path / "store"), tmp_path / "digest.md"
    assert main(["track", store, str(tmp_path / "one")]) == 0 and "seeded 1" in capsys.readouterr().out
    assert main(["track", store, str(tmp_path / "two"), "--summary-out", str(out), "--changed-out", str(tmp_path / "changed")]) == 0 and "changed 1" in capsys.readouterr().out
    assert "### a.example" in out.read_text() and (tmp_path / "changed").read_text() == "a.example\n"
    assert main(["track", store, str(tmp_path / "two")]) == 0 and "unchanged 1" in capsys.readouterr().out
