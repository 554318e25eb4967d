"""The whole analysis of a table of files behind one call.

    a = analyze(files, crawlers, config)        # files: file_id, text; also site_url, domain, fetch, body where known
    a.findings; a.verdicts; a.recon["hosts"]; a.report; a.allowed(probes)

The files are parsed once; every table is built when it is asked for and only then.  With `once` the tables that several
others need (parsed files, findings, platform scores, sensitive paths, actions) are written when they are first asked for.
"""

from __future__ import annotations

from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquarry import config as C
from crawlquarry.functions.messages import worded
from crawlquarry.functions.presentation import rendered
from crawlquarry.functions.text import date_of
from crawlquarry.operators import findings as G
from crawlquarry.operators import match as M
from crawlquarry.operators import parse as P
from crawlquarry.operators import recon as R
from crawlquarry.operators import rollup as U
from crawlquarry.session import written

VERSION = "0.2.0"


def version() -> str:
    return VERSION


def default_config() -> str:
    """The default rule pack as TOML text."""
    return C.default_config()


def validate_config(toml: str) -> list[str]:
    """What is wrong with a user's rule pack: an empty list if nothing is."""
    try:
        C.load(toml if "\n" in toml else toml + "\n")
    except (ValueError, KeyError, TypeError) as e:
        return [str(e)]
    return []


class Analysis:
    """Tables of analysed files, all keyed by file_id."""

    def __init__(self, files: DataFrame, crawlers: DataFrame, config: dict[str, Any], lang: str = "en", today: Column | None = None, once: bool = False) -> None:
        self.files, self.crawlers, self.config, self.lang, self.today = files, crawlers, config, lang, today
        self._keep = written if once else lambda df: df
        self.parsed = self._keep(P.parse(files))

    @cached_property
    def lines(self) -> DataFrame:
        return P.lines(self.parsed)

    @cached_property
    def groups(self) -> DataFrame:
        return P.groups(self.parsed)

    @cached_property
    def rules(self) -> DataFrame:
        return P.rules(self.parsed)

    @cached_property
    def sitemaps(self) -> DataFrame:
        return P.sitemaps(self.parsed)

    @cached_property
    def findings(self) -> DataFrame:
        found = G.all_findings(self.parsed, self.config["checks"], self.config["crawlers"]["legacy_tokens"], self.config.get("limits"))
        return self._keep(G.with_overrides(found, self.config["rules"]["disabled"], self.config["rules"]["levels"]))

    @cached_property
    def issues(self) -> DataFrame:
        """Findings in words."""
        return worded(self.findings, self.lang)

    @cached_property
    def verdicts(self) -> DataFrame:
        return M.crawler_verdicts(self.parsed, self.crawlers)

    @cached_property
    def star(self) -> DataFrame:
        return M.star_policy(self.parsed)

    @cached_property
    def scores(self) -> DataFrame:
        return self._keep(R.platform_scores(self.parsed, self.config))

    @cached_property
    def platforms(self) -> DataFrame:
        return R.primary_platform(self.scores)

    @cached_property
    def security(self) -> DataFrame:
        paths = R.sensitive_paths(self.parsed, self.config, self.platforms)
        return self._keep(paths if self.config["checks"].get("security", True) else paths.limit(0))

    @cached_property
    def recon(self) -> dict[str, DataFrame]:
        tables = R.recon(self.parsed, self.config, self.today)
        return tables | {"platforms": self.scores} if "platforms" in tables else tables

    @cached_property
    def ai(self) -> DataFrame:
        c = self.config["crawlers"]
        return U.ai_cards(self.verdicts, c["ai_categories"], c.get("labels"))

    @cached_property
    def summary(self) -> DataFrame:
        return U.report_summary(self.parsed, self.findings, self.security, self.verdicts, self.star, self.platforms, self.config["crawlers"]["ai_categories"][0])

    @cached_property
    def actions(self) -> DataFrame:
        return U.recommended_actions(self.parsed, self.findings, self.security, self.star, self.ai, self.recon, self._keep)

    @cached_property
    def tabs(self) -> dict[str, DataFrame]:
        return U.tabs(self.parsed, self.findings, self.recon)

    @cached_property
    def report(self) -> DataFrame:
        """file_id, json, markdown, html."""
        items = self.tabs["recon"]
        return rendered(U.nested_report(self.parsed, self.summary, self.findings, self.verdicts, self.security, items, self.actions))

    @cached_property
    def summary_text(self) -> DataFrame:
        return U.summary_text(self.summary, self.findings, self.security, self.actions)

    @cached_property
    def records(self) -> DataFrame:
        return U.crawl_records(self.files, self.summary, self.verdicts)

    def check_access(self, probes: DataFrame) -> DataFrame:
        """Probes (file_id, tokens, path) with the decision of each."""
        return M.check_access(self.parsed, probes)

    def allowed(self, probes: DataFrame) -> DataFrame:
        """Probes (file_id, token, path) with `allowed`."""
        asked = probes.withColumn("tokens", F.array(F.lower("token"), F.lit("*"))).withColumnRenamed("token", "asked")
        return M.check_access(self.parsed, asked).select("file_id", F.col("asked").alias("token"), "path", "allowed")

    def clean_params(self, probes: DataFrame) -> DataFrame:
        """Probes (file_id, path) without the parameters that the file drops."""
        return M.cleaned_paths(self.parsed, probes)


def analyze(files: DataFrame, crawlers: DataFrame, config: dict[str, Any] | None = None, lang: str = "en", now: str | None = None, once: bool = False) -> Analysis:
    """The analysis of a table of files.  now: an ISO time that dates in comments are compared with; once: write the parsed
    files, and what is made of them for several tables, to the shared folder, so that many tables read them instead of making them again."""
    today = date_of(F.lit(now)) if now else None
    return Analysis(files, crawlers, config or C.load(), lang, today, once)
