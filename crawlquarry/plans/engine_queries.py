"""Queries over the reference operators, on the whole tables of a data directory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crawlquarry import config as C
from crawlquarry.analysis import analyze
from crawlquarry.functions.messages import outcome_sentences, worded
from crawlquarry.functions.text import body_hash, date_of, kib, normalise_encoding, sample_path
from crawlquarry.operators import diff as D
from crawlquarry.operators import findings as G
from crawlquarry.operators import match as M
from crawlquarry.operators import parse as P
from crawlquarry.operators import recon as R
from crawlquarry.operators import rollup as U
from crawlquarry.operators.track import flips_in
from crawlquarry.plans import engine_sql, engine_sql_more
from crawlquarry.session import default_parallelism, shuffle_partitions, table, written
from crawlquarry.sources import io

AI = ["ai_training", "ai_assistant"]
PROBES = ["/", "/login", "/search?q=1", "/admin/x", "/robots.txt", "/robots.txt?x", "/private/a.pdf"]


def _parsed(spark, d):
    return P.parse(P.files_of_fetches(table(spark, d, "fetches")))


def _once_parsed(spark, d):
    """The parsed files written once and read by column: for queries that need many tables of them."""
    return written(_parsed(spark, d))


def _over(f):
    return lambda spark, d: f(_parsed(spark, d))


def _with_pack(f):
    return lambda spark, d: f(_parsed(spark, d), C.load())


def _verdicts(spark, d):
    return M.crawler_verdicts(_parsed(spark, d), table(spark, d, "crawlers"))


def longest_match_access(spark, d):
    """Every file, crawler and probed path: allowed, and by which rule.  Rules with encoded or other characters count too."""
    return M.access_grid(_parsed(spark, d), table(spark, d, "crawlers"), PROBES).select("file_id", "crawler", "token", "path", "allowed", "rule", "line")


def typo_repair(spark, d):
    found = F.filter("lines", lambda x: x["misspelt"])
    return _parsed(spark, d).select("file_id", F.explode_outer(found).alias("l")).where("l is not null").select("file_id", F.col("l.n").alias("line"), F.col("l.raw_field").alias("raw"), "l.field")


def _findings(spark, d):
    config = C.load()
    parsed = _parsed(spark, d)
    return G.with_overrides(G.all_findings(parsed, config["checks"], config["crawlers"]["legacy_tokens"]), config["rules"]["disabled"], config["rules"]["levels"])


def shown(findings):
    """Findings with their parameters as one text: name=value in order of the names."""
    pairs = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return findings.select("file_id", "line", "id", "level", "kind", "variant", F.array_join(pairs, ";").alias("params"))


def finding_counts(spark, d):
    return _findings(spark, d).groupBy("kind", "id", "level").agg(F.count("*").alias("n"))


def worded_findings(spark, d):
    return worded(G.syntax_findings(_parsed(spark, d))).select("file_id", "line", "id", "level", "message")


def _recon_counts(spark, d):
    return R.recon_counts(R.recon(_once_parsed(spark, d), C.load()))


def _security(spark, d):
    parsed, config = _once_parsed(spark, d), C.load()
    return R.sensitive_paths(parsed, config, R.primary_platform(R.platform_scores(parsed, config)))


def _summary(spark, d):
    parsed, config = _once_parsed(spark, d), C.load()
    platforms = R.primary_platform(R.platform_scores(parsed, config))
    verdicts = M.crawler_verdicts(parsed, table(spark, d, "crawlers"))
    return U.report_summary(parsed, G.syntax_findings(parsed), R.sensitive_paths(parsed, config, platforms), verdicts, M.star_policy(parsed), platforms, "ai_training")


def report_summary(spark, d):
    return _summary(spark, d)


def _analysis(spark, d):
    return analyze(P.files_of_fetches(table(spark, d, "fetches")), table(spark, d, "crawlers"), once=True)


def markdown_reports(spark, d):
    return _analysis(spark, d).report.select("file_id", "markdown")


def ai_cards(spark, d):
    cards = U.ai_cards(_verdicts(spark, d), AI, C.load()["crawlers"]["labels"])
    return cards.select("file_id", "headline", "callout", "callout_text", F.size("groups").alias("n_groups"))


def tagged_sheets(spark, d):
    """Every row of the four tabs, as uniform cells of text."""
    return U.tagged(_analysis(spark, d).tabs)


def tab_lines(spark, d):
    return U.tab_tsv(_analysis(spark, d).tabs, "all")


def security_categories(spark, d):
    parsed, config = _once_parsed(spark, d), C.load()
    return R.security_categories(R.sensitive_paths(parsed, config, R.primary_platform(R.platform_scores(parsed, config))), config)


def security_changes(spark, d):
    """Sensitive paths that are new in a delivery, or no longer in it."""
    old, new = _versions(spark, d)
    return _by_run(D.security_changes(*(R.sensitive_paths(P.parse(x), C.load()) for x in (old, new))))


def high_impact(spark, d):
    """Pairs of deliveries with a verdict flip, a new path of high severity or a new error.

    Every delivery of such a pair is parsed once, where its site's deliveries lie; it meets the one before by what `weights` keeps of it.
    """
    w = Window.partitionBy("domain").orderBy("run_no")
    row = _standing(spark, d).withColumns({"a": F.lag("b").over(w), "prev_run_no": F.lag("run_no").over(w), "c": F.lead("b").over(w), "next_run_no": F.lead("run_no").over(w)})
    row = row.withColumns({"moved": F.coalesce(F.expr("prev_run_no is not null and a <> b"), F.lit(False)), "moves": F.coalesce(F.expr("run_no is not null and next_run_no is not null and b <> c"), F.lit(False))})
    kept = row.where("moved or moves").select("domain", "first", "prev_run_no", "run_no", "moved", F.col("b").alias("text"))  # so the row before a moved one is the delivery before it
    facts = D.weights(kept, table(spark, d, "crawlers"), C.load())
    both = facts.select("*", *[F.lag(c).over(w).alias(f"old_{c}") for c in ("issues", "grave", "verdicts")])
    here = D.is_grave(*({c: F.col(p + c) for c in ("issues", "grave", "verdicts")} for p in ("old_", "")))
    return both.where(F.col("moved") & here).select(F.col("first").alias("file_id"), "prev_run_no", "run_no")


def domains_of_sites(spark, d):
    """The watched sites as a domain list: cells of a CSV line, `#` lines and repeats left out."""
    lines = table(spark, d, "sites").select(F.concat_ws(",", F.coalesce("name", F.lit("")), "domain").alias("line"), F.xxhash64("domain").alias("ord"))
    return io.domain_list(lines.unionByName(lines).unionByName(lines.select(F.concat(F.lit("# "), "line").alias("line"), "ord"))).select("domain")


def dates_in_documents(spark, d):
    """Dates in words in the documents, as days; the day at the start of created_at."""
    docs = table(spark, d, "documents")
    words = F.explode(F.regexp_extract_all("text", F.lit(C.load()["comments"]["text_date"]), F.lit(1)))
    return docs.select("doc_id", words.alias("t")).select("doc_id", "t", R.text_date(F.col("t")).alias("day")).unionByName(docs.where("created_at is not null").select("doc_id", F.lit("created").alias("t"), date_of(F.col("created_at").cast("string")).alias("day"))).distinct()


def _standing(spark, d):
    """The standing body b of every site and run, with the first snapshot of the site: the rows of a site lie in one partition."""
    snaps = table(spark, d, "site_snapshots").where("domain is not null").repartition(max(shuffle_partitions(spark), default_parallelism(spark)), "domain")
    standing = snaps.groupBy("domain", "run_no").agg(F.min("snap_id").alias("first"), F.coalesce(F.max_by("robots_txt", F.struct("fetched_at", "snap_id")), F.lit("")).alias("b"))
    return standing.withColumn("first", F.min("first").over(Window.partitionBy("domain")))


def _deliveries(spark, d):
    """Two versions of every site's standing bodies: each delivery and the site's next one.

    The key file_id is a struct of the first snapshot of the site and the two run numbers; null run numbers are left out.
    """
    w = Window.partitionBy("domain").orderBy("run_no")
    pairs = _standing(spark, d).select("domain", "b", "run_no", "first", F.lag("run_no").over(w).alias("prev_run_no"), F.lag("b").over(w).alias("a"))
    return pairs.where("prev_run_no is not null").select(F.struct(F.col("first").alias("file_id"), "prev_run_no", "run_no").alias("file_id"), "domain", "a", "b")


def _versions(spark, d):
    """The older and the newer version of every pair of deliveries with different bodies: equal ones give no row in a diff."""
    pairs = _deliveries(spark, d).where("a <> b")
    return tuple(pairs.select("file_id", "domain", F.col(k).alias("text")) for k in ("a", "b"))


def _by_run(diff):
    return diff.select("file_id.file_id", "file_id.prev_run_no", "file_id.run_no", *[c for c in diff.columns if c != "file_id"])


def semantic_flags(spark, d):
    pairs = _deliveries(spark, d)
    return _by_run(D.text_flags(*(pairs.select("file_id", F.col(k).alias("text")) for k in ("a", "b"))))


def semantic_flips(spark, d):
    old, new = _versions(spark, d)
    crawlers = table(spark, d, "crawlers")
    return _by_run(D.verdict_flips(M.crawler_verdicts(P.parse(old), crawlers), M.crawler_verdicts(P.parse(new), crawlers)))


def semantic_sitemaps(spark, d):
    old, new = _versions(spark, d)
    return _by_run(D.sitemap_changes(P.sitemaps(P.parse(old)), P.sitemaps(P.parse(new))))


def semantic_issues(spark, d):
    old, new = _versions(spark, d)
    return _by_run(D.issue_changes(G.syntax_findings(P.parse(old)), G.syntax_findings(P.parse(new))))


def unified_diffs(spark, d):
    return _by_run(_deliveries(spark, d).where("a <> b").select("file_id", D.unified_diff("a", "b").alias("diff")))


def change_history(spark, d):
    obs = table(spark, d, "fetches").where("fetch_id is not null").dropDuplicates(["fetch_id"]).select("domain", "observed_at", F.col("fetch_id").alias("obs_id"), "status", "content_type", F.col("text").alias("body"))
    return D.change_history(obs)


def body_hashes(spark, d):
    return P.files_of_fetches(table(spark, d, "fetches")).select("file_id", body_hash(F.col("text")).alias("hash"))


def normalised_paths(spark, d):
    return table(spark, d, "rules").select("path").where("path is not null").distinct().select("path", normalise_encoding(F.col("path")).alias("norm"))


def checked_access(spark, d):
    """Every rule's sample path asked for by the first token of the rule's group: percent-encoded, non-ASCII and wildcard paths too."""
    parsed = _once_parsed(spark, d)
    tokens = P.agents(parsed).where("token <> ''").groupBy("file_id", "group_id").agg(F.min_by("token", "line").alias("token"))
    probes = P.effective_rules(parsed).join(tokens, ["file_id", "group_id"]).select("file_id", F.array("token", F.lit("*")).alias("tokens"), sample_path(F.col("path")).alias("path")).distinct()
    return M.check_access(parsed, probes).select("file_id", F.col("tokens")[0].alias("asked"), "path", "token", "allowed", F.col("rule.path").alias("rule"), F.col("rule.line").alias("line"))


def cleaned_paths(spark, d):
    """Paths with a query, those of the file's rules and a fixed one, without the parameters that Clean-param drops."""
    parsed = _once_parsed(spark, d)
    own = P.effective_rules(parsed).where(F.contains("path", F.lit("?"))).select("file_id", sample_path(F.col("path")).alias("path"))
    fixed = parsed.select("file_id", F.explode(F.array(F.lit("/forum/?ref=1&sort=2&vellum=3"), F.lit("/a?sid=1"))).alias("path"))
    named = P.clean_params(parsed).where("valid").select("file_id", F.concat(F.regexp_replace("path", r"\*", "x"), F.lit("?keep=1&"), F.array_join(F.transform("params", lambda x: F.concat(x, F.lit("=2"))), "&")).alias("path"))
    return M.cleaned_paths(parsed, own.unionByName(fixed).unionByName(named).distinct()).select("file_id", "path", "cleaned", "removed")


def mined_documents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit(1).alias("line"), "text")
    return R.mined_comments(docs, C.load())


def comment_tickets(spark, d):
    return mined_documents(spark, d).where("kind = 'ticket'").select("file_id", "value")


def fetch_findings(spark, d):
    return G.fetch_findings(P.files_of_fetches(table(spark, d, "fetches")))


#: ids of the findings that the query `syntax_core` compares with its SQL
SYNTAX_CORE = (
    "tooLarge bom utf16 longLine notFieldValue misspelling emptyUserAgent invalidToken tokenTail ruleBeforeAgent emptyAllow emptyDisallow pathNoSlash wildcardOnly spaceInPath nonAsciiPath crawlDelayBeforeAgent crawlDelayHigh "
    "crawlDelayNaN crawlDelayNonStandard hostObsolete hostDuplicate noindex noRules noSitemap emptyGroup"
).split()


def syntax_core(spark, d):
    found = G.syntax_findings(_parsed(spark, d)).where(F.col("id").isin(*[f"parser.{x}" for x in SYNTAX_CORE]))
    return found.select("file_id", "line", "id", "level")


QUERIES = {
    "syntax_core": syntax_core,
    "case_notes": lambda s, d: G.seo_findings(_parsed(s, d)).where("id = 'seo.caseSensitive'").select("file_id", "line", F.col("params")["path"].alias("path")),
    "fetch_ids": lambda s, d: fetch_findings(s, d).select("file_id", F.replace("id", F.lit("fetch.warn."), F.lit("")).alias("id")),
    "extension_counts": lambda s, d: R.extensions(_parsed(s, d), C.load()).where("ext in ('pdf', 'doc', 'xls', 'csv', 'zip', 'gz', 'php', 'asp', 'aspx', 'json', 'xml', 'gif', 'js', 'css')").select("file_id", "ext", "n"),
    "longest_match_access": longest_match_access,
    "parse_lines": _over(P.lines),
    "parse_groups": _over(P.groups),
    "parse_agents": _over(P.agents),
    "parse_rules": _over(P.rules),
    "sitemaps": _over(P.sitemaps),
    "first_hosts": _over(P.hosts),
    "clean_params": _over(P.clean_params),
    "unknown_directives": _over(P.unknown_directives),
    "comments": _over(P.comments),
    "typo_repair": typo_repair,
    "normalised_paths": normalised_paths,
    "crawler_verdicts": lambda s, d: _verdicts(s, d).drop("crawl_delay"),
    "star_policy": _over(M.star_policy),
    "rule_outcomes": _over(M.rule_outcomes),
    "cleaned_paths": cleaned_paths,
    "checked_access": checked_access,
    "syntax_findings": lambda s, d: shown(G.syntax_findings(_parsed(s, d))),
    "seo_findings": lambda s, d: shown(G.seo_findings(_parsed(s, d))),
    "sitemap_findings": lambda s, d: G.sitemap_findings(_parsed(s, d)).select("file_id", "line", "id", "level"),
    "fetch_findings": lambda s, d: shown(fetch_findings(s, d)),
    "fetch_status_findings": lambda s, d: fetch_findings(s, d).where("id in ('fetch.warn.serverError', 'fetch.warn.rateLimited', 'fetch.warn.forbidden')").select("file_id", "id"),
    "finding_counts": finding_counts,
    "worded_findings": worded_findings,
    "token_repeated": lambda s, d: G.syntax_findings(_parsed(s, d)).where("id = 'parser.tokenRepeated'").select("file_id", F.col("params")["token"].alias("token"), F.col("params")["n"].cast("long").alias("n")),
    "star_blocks_all": lambda s, d: G.syntax_findings(_parsed(s, d)).where("id = 'parser.starBlocksAll'").select("file_id"),
    "high_crawl_delays": lambda s, d: G.syntax_findings(_parsed(s, d)).where("id = 'parser.crawlDelayHigh'").select("file_id", "line", F.col("params")["seconds"].cast("double").alias("seconds")),
    "sensitive_paths": _security,
    "sensitive_paths_admin": lambda s, d: R.sensitive_paths(_parsed(s, d), C.load({"security": {"signature": [x for x in C.load()["security"]["signature"] if x["category"] == "admin"]}})).select("file_id", "path", "line"),
    "platform_scores": _with_pack(R.platform_scores),
    "generators": _with_pack(R.generators),
    "cloud_assets": _with_pack(R.cloud_assets),
    "leaked_hosts": _with_pack(R.leaked_hosts),
    "environment_paths": _with_pack(R.environment_paths),
    "api_endpoints": _with_pack(R.api_endpoints),
    "data_feeds": _with_pack(R.data_feeds),
    "portals": _with_pack(R.portals),
    "search_paths": _with_pack(R.search_paths),
    "search_parameters": _with_pack(R.parameters),
    "extensions": _with_pack(R.extensions),
    "mined_documents": mined_documents,
    "comment_tickets": comment_tickets,
    "comment_addresses": lambda s, d: mined_documents(s, d).where("kind in ('email', 'ip')").select("file_id", "kind", "value", "remark"),
    "file_kib": lambda s, d: _parsed(s, d).select("file_id", kib(F.col("size")).alias("kib")),
    "recon_counts": _recon_counts,
    "ai_status": lambda s, d: U.ai_status(_verdicts(s, d), AI),
    "leaderboard": lambda s, d: U.leaderboard(_verdicts(s, d), AI),
    "file_sizes": _over(U.file_sizes),
    "report_summary": report_summary,
    "markdown_reports": markdown_reports,
    "recommended_actions": lambda s, d: _analysis(s, d).actions,
    "ai_cards": ai_cards,
    "worst_levels": lambda s, d: U.worst(_findings(s, d)),
    "line_notes": lambda s, d: U.line_notes(_findings(s, d)),
    "tagged_sheets": tagged_sheets,
    "tab_lines": tab_lines,
    "summary_texts": lambda s, d: _analysis(s, d).summary_text,
    "crawl_records": lambda s, d: _analysis(s, d).records,
    "crawl_record_counts": lambda s, d: _analysis(s, d).records.drop("crawlers"),
    "security_categories": security_categories,
    "security_changes": security_changes,
    "high_impact": high_impact,
    "tech_hints": lambda s, d: R.tech_hints(R.extensions(_parsed(s, d), C.load())),
    "platform_evidence": _with_pack(R.platform_evidence),
    "outcome_sentences": lambda s, d: outcome_sentences(M.rule_outcomes(_parsed(s, d))).select("file_id", "group_id", "line", "sentence"),
    "probe_plan": lambda s, d: io.probe_plan(table(s, d, "sites"), table(s, d, "crawlers")),
    "domains_of_sites": domains_of_sites,
    "dates_in_documents": dates_in_documents,
    "ai_flips": lambda s, d: flips_in(semantic_flips(s, d), "ai_training"),
    "crawl_summary": lambda s, d: U.crawl_summary(table(s, d, "audit_records")),
    "enabled_sites": lambda s, d: io.enabled_sites(table(s, d, "sites")).select("domain", "name", "category"),
    "semantic_flags": semantic_flags,
    "semantic_flips": semantic_flips,
    "semantic_sitemaps": semantic_sitemaps,
    "semantic_issues": semantic_issues,
    "semantic_issue_ids": lambda s, d: semantic_issues(s, d).drop("message"),
    "unified_diffs": unified_diffs,
    "change_history": change_history,
    "body_hashes": body_hashes,
}
SQL = engine_sql.SQL | engine_sql_more.SQL
