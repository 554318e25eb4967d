"""Sources and sinks: text files, domain and watch lists, snapshot stores, data sets, summaries, notifications."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquarry.functions.text import trim_space
from crawlquarry.operators.findings import looks_like_html

BODY_CAP = 512 * 1024
MOST_REDIRECTS = 5
KEPT_HEADERS = ("cache-control", "expires", "x-robots-tag", "retry-after", "vary", "content-encoding")
FETCH_DDL = (
    "domain string, site_url string, source string, robots_url string, final_url string, status int, status_text string, content_type string, bytes long, truncated boolean, "
    "redirects array<struct<from_url:string,status:int,to_url:string>>, redirect_limit boolean, text string, "
    "headers struct<cache_control:string,expires:string,x_robots_tag:string,retry_after:string,vary:string,content_encoding:string>, error string"
)


def target_kind(target: str) -> str:
    """`stdin` for -, `url` for a scheme or for a dotted name without slash that is no file, else `path`."""
    if target == "-":
        return "stdin"
    if "://" in target:
        return "url"
    return "url" if "." in target and "/" not in target and not Path(target).exists() else "path"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: file_id (a hash of the path), path, text."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.select(F.xxhash64("path").alias("file_id"), "path", "text")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files read as bytes, cut at the body cap, bad UTF-8 replaced: file_id, path, text, truncated."""
    df = spark.read.format("binaryFile").load(path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [b[:BODY_CAP].decode("utf-8", "replace") for b in pdf["content"]], "truncated": pdf["length"] > BODY_CAP})

    return df.select("path", "content", "length").mapInPandas(decode, "path string, text string, truncated boolean").select(F.xxhash64("path").alias("file_id"), "path", "text", "truncated")


def domain_list(lines: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """ord, domain of a list (line STRING, ord BIGINT): the last CSV column, quotes cut, lower case.

    Blank lines, comments and what is no domain are skipped; the first mention of a domain stands; offset and limit
    count domains after that.
    """
    last = F.lower(F.regexp_replace(trim_space(F.substring_index(trim_space(F.col("line")), ",", -1)), "^[\"']+|[\"']+\\z", ""))
    rows = lines.where(F.col("line").isNotNull() & ~F.ltrim("line").startswith("#")).select("ord", trim_space(last).alias("domain")).where("domain like '%.%' and domain not like '%/%'")
    once = rows.groupBy("domain").agg(F.min("ord").alias("ord"))
    if offset or limit is not None:
        ordered = once.orderBy("ord").offset(offset)
        once = ordered if limit is None else ordered.limit(limit)
    return once.select("ord", "domain")


def read_domain_list(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("ord"))
    return domain_list(lines, offset, limit)


def watch_list(spark: SparkSession, path: str) -> DataFrame:
    """Enabled sites of a JSON array."""
    return enabled_sites(spark.read.json(path, schema="domain string, name string, category string, enabled boolean, notify_email string, webhook_url string", multiLine=True))


def enabled_sites(sites: DataFrame) -> DataFrame:
    return sites.withColumn("enabled", F.coalesce("enabled", F.lit(True))).where("enabled and domain is not null")


META_DDL = "domain string, robots_url string, final_url string, http_status int, bytes long, fetched_at string, redirects int, unavailable boolean, html boolean"
MOST_CRAWLERS = 2_000


def meta_of_fetch() -> Column:
    """The meta.json of a fetch."""
    page = looks_like_html(F.coalesce("text", F.lit("")))
    usable = F.coalesce(F.col("status").between(200, 299), F.lit(False)) & ~F.coalesce("redirect_limit", F.lit(False))
    return F.struct(
        "domain", "robots_url", "final_url", F.col("status").cast("int").alias("http_status"), F.col("bytes").cast("long").alias("bytes"), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at"),
        F.size("redirects").alias("redirects"), (~usable).alias("unavailable"), page.alias("html"),
    )


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A store of <domain>/robots.txt and <domain>/meta.json: domain, text, meta (null without a readable meta.json)."""
    site = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("domain")
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="robots.txt", recursiveFileLookup=True).select(site, F.col("value").alias("text"))
    notes = spark.read.text(path, wholetext=True, pathGlobFilter="meta.json", recursiveFileLookup=True).select(site, F.from_json("value", META_DDL).alias("meta"))
    return texts.join(notes, "domain", "left")


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Snapshots as Parquet, one partition a run."""
    snapshots.write.mode("append").partitionBy("run_no").parquet(path)


def write_dataset(records: DataFrame, path: str) -> None:
    """Records as gzipped JSON lines; the order of records is unspecified."""
    records.write.mode("overwrite").option("compression", "gzip").json(path)


def write_store(snapshots: DataFrame, path: str) -> None:
    """domain, text, meta as <domain>/robots.txt and <domain>/meta.json, written by the executors; path is a shared folder."""

    def each(rows) -> None:
        for r in rows:
            folder = Path(path) / r["domain"]
            folder.mkdir(parents=True, exist_ok=True)
            (folder / "robots.txt").write_text(r["text"] or "", encoding="utf-8")
            if r["meta"]:
                (folder / "meta.json").write_text(r["meta"], encoding="utf-8")

    snapshots.select("domain", "text", F.to_json("meta").alias("meta")).foreachPartition(each)


def write_texts(texts: DataFrame, path: str, column: str = "text") -> None:
    """Reports (markdown, html, json, summaries) as text, one report after the other in each part file."""
    texts.select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The few rows of a summary as one pretty JSON object."""
    out: dict = {}
    for r in summary.collect():  # one row a status, platform or crawler verdict
        if r["verdict"] is not None:
            out.setdefault(r["what"], {}).setdefault(r["key"], {})[r["verdict"]] = r["n"]
        elif r["key"]:
            out.setdefault(r["what"], {})[r["key"]] = r["n"]
        else:
            out[r["what"]] = r["n"]
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True), encoding="utf-8")


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


# -- the network: ingestion jobs only, never part of a query -------------------------------------------------------


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def fetch_one(domain: str, agent: str, timeout: float, opener: Callable | None = None) -> dict:
    """The file of a domain with its chain of redirects; on a failure once more with `www.` before the name."""
    open_ = opener or urllib.request.build_opener(_NoRedirect).open
    error = None
    for name in (domain, f"www.{domain}"):
        if name != domain and domain.startswith("www."):
            break
        try:
            return {"domain": domain, "site_url": f"https://{name}", "source": "crawl", "error": None} | _follow(f"https://{name}/robots.txt", agent, timeout, open_)
        except OSError as e:
            error = str(e)
    return {"domain": domain, "site_url": f"https://{domain}", "source": "crawl", "error": error}


def _follow(url: str, agent: str, timeout: float, open_: Callable) -> dict:
    first, hops = url, []
    while True:
        request = urllib.request.Request(url, headers={"User-Agent": agent})
        try:
            answer = open_(request, timeout=timeout)
        except urllib.error.HTTPError as e:
            answer = e
        where = answer.headers.get("Location")
        if 300 <= answer.status < 400 and where:
            target = urljoin(url, where)
            hops.append({"from_url": url, "status": answer.status, "to_url": target})
            if len(hops) > MOST_REDIRECTS:
                return _answer(first, url, answer, b"", hops, True)
            url = target
            continue
        return _answer(first, url, answer, answer.read(BODY_CAP + 1), hops, False)


def _answer(first: str, last: str, answer, body: bytes, hops: list[dict], limited: bool) -> dict:
    headers = {k.replace("-", "_"): answer.headers.get(k) for k in KEPT_HEADERS}
    return {
        "robots_url": first, "final_url": last, "status": answer.status, "status_text": getattr(answer, "reason", None), "content_type": answer.headers.get("Content-Type"), "bytes": len(body[:BODY_CAP]),
        "truncated": len(body) > BODY_CAP, "redirects": hops, "redirect_limit": limited, "text": body[:BODY_CAP].decode("utf-8", "replace"), "headers": headers,
    }


def fetch_domains(domains: DataFrame, agent: str, timeout: float = 10.0, parallelism: int = 64) -> DataFrame:
    """Fetches of a table of domains, as rows like the table of fetches; failures are rows with `error`."""
    columns = [c.strip().split(" ")[0] for c in FETCH_DDL.replace("array<struct<from_url:string,status:int,to_url:string>>", "x").replace("struct<cache_control:string,expires:string,x_robots_tag:string,retry_after:string,vary:string,content_encoding:string>", "x").split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([fetch_one(d, agent, timeout) for d in pdf["domain"]], columns=columns)

    return domains.select("domain").repartition(parallelism).mapInPandas(work, FETCH_DDL)


def probe_plan(sites: DataFrame, crawlers: DataFrame, browser: str = "Mozilla/5.0") -> DataFrame:
    """The fetches that an access check needs: every site as a browser (crawler null) and as every crawler with a user agent.

    The crawlers are a fixed list, so they go along in each row and are exploded there.
    """
    agents = [(r["name"], r["ua"]) for r in crawlers.where("ua is not null and ua <> ''").orderBy("ord").limit(MOST_CRAWLERS + 1).collect()]
    if len(agents) > MOST_CRAWLERS:
        raise ValueError(f"more than {MOST_CRAWLERS} crawlers: the dimension is meant to be a fixed list")
    one = lambda name, ua: F.struct(F.lit(name).cast("string").alias("crawler"), F.lit(ua).alias("ua"))
    return sites.where("domain is not null").select("domain", F.explode(F.array(one(None, browser), *(one(n, u) for n, u in agents))).alias("p")).select("domain", "p.crawler", "p.ua")


def access_probe(baseline: DataFrame, probed: DataFrame) -> DataFrame:
    """Answers to each crawler's name against the baseline of a domain: same, status differs or body differs."""
    base = baseline.select("domain", F.col("status").alias("s0"), F.coalesce("text", F.lit("")).alias("t0"))
    joined = probed.join(base, "domain")
    result = F.when(~F.col("status").eqNullSafe(F.col("s0")), "status differs").when(F.coalesce("text", F.lit("")) != F.col("t0"), "body differs").otherwise("same")
    return joined.select("domain", "crawler", "status", result.alias("result"))


def notify(changes: DataFrame, default_url: str | None = None, post: Callable[[str, bytes], None] | None = None, high_impact: DataFrame | None = None) -> None:
    """POST {text, content} for every change (text, webhook_url); off unless an address is given.  A site's own address wins.

    high_impact (file_id): only the changes of these files.
    """
    if high_impact is not None:
        changes = changes.join(high_impact.select("file_id").distinct(), "file_id", "left_semi")

    def send(url: str, body: bytes) -> None:
        urllib.request.urlopen(urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"}), timeout=10).close()

    def each(rows) -> None:
        for r in rows:
            url = r["webhook_url"] or default_url
            if url:
                (post or send)(url, json.dumps({"text": r["text"], "content": r["text"]}).encode())

    changes.select("text", "webhook_url").foreachPartition(each)
