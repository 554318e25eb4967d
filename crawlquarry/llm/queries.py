"""Queries over the text-corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlquarry.llm import canondup, confusables, mixing, mojibake, packing, pii, residue, sql, termfreq
from crawlquarry.session import table


def p1_found(spark, d):
    rows = confusables.unified_rows(table(spark, d, "fetches"), table(spark, d, "agents"), table(spark, d, "crawlers"), with_text=False)
    return rows.where("found").select("src", "row_id").distinct()


def p1_normalised(spark, d):
    return confusables.unified_rows(table(spark, d, "fetches"), table(spark, d, "agents"), table(spark, d, "crawlers"))


def p1_agent_forms(spark, d):
    agents, crawlers = table(spark, d, "agents"), table(spark, d, "crawlers")
    return confusables.unified_agents(agents, crawlers, confusables.unified_rows(table(spark, d, "fetches"), agents, crawlers))


def p2_found(spark, d):
    return mojibake.garbled_rows(table(spark, d, "fetches")).select(F.col("row_id").alias("fetch_id"))


def p2_restored(spark, d):
    return mojibake.restored_rows(table(spark, d, "fetches")).withColumnRenamed("row_id", "fetch_id")


def _keys(spark, d):
    return canondup.text_keys(table(spark, d, "fetches")).unionByName(canondup.record_keys(table(spark, d, "record_lines")))


def p3_found(spark, d):
    return canondup.copy_pairs(_keys(spark, d))


def p3_distinct_contents(spark, d):
    return canondup.distinct_contents(_keys(spark, d))


def p3_fetch_contents(spark, d):
    return canondup.distinct_contents(canondup.text_keys(table(spark, d, "fetches"))).select("keep_id", "copies")


def _values(spark, d):
    return termfreq.values_of(table(spark, d, "agents"), table(spark, d, "rules"), table(spark, d, "audit_records"))


def p4_found(spark, d):
    return termfreq.marked_terms(_values(spark, d)).where("mark is not null").select("field", "term", "mark")


def p4_term_counts(spark, d):
    return termfreq.marked_terms(_values(spark, d))


def _bodies(spark, d):
    return residue.bodies_of(table(spark, d, "fetches"), table(spark, d, "site_snapshots"))


def p6_method(spark, d):
    return residue.placeholder_rows(_bodies(spark, d))


def p6_found(spark, d):
    return residue.residue_rows(_bodies(spark, d)).select("src", "row_id")


def p6_kinds(spark, d):
    return residue.residue_rows(_bodies(spark, d))


def p6_kept(spark, d):
    return residue.without_residue(_bodies(spark, d)).select("src", "row_id", "body")


def p7_packed(spark, d):
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p7_fill(spark, d):
    limits = table(spark, d, "pack_limits")
    return packing.fill_report(packing.packed(table(spark, d, "documents"), limits), limits)


def p8_mixed(spark, d):
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark, d):
    return mixing.share_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_method(spark, d):
    return pii.disclosing_texts(table(spark, d, "documents"))


def p9_found(spark, d):
    return pii.found_kinds(table(spark, d, "documents"))


def p9_disclosing_terms(spark, d):
    return pii.term_disclosure(table(spark, d, "documents"))


def p9_sanitised(spark, d):
    return pii.sanitised(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_normalised": p1_normalised,
    "p1_agent_forms": p1_agent_forms,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_distinct_contents": p3_distinct_contents,
    "p3_fetch_contents": p3_fetch_contents,
    "p4_found": p4_found,
    "p4_term_counts": p4_term_counts,
    "p6_method": p6_method,
    "p6_found": p6_found,
    "p6_kinds": p6_kinds,
    "p6_kept": p6_kept,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_mixed": p8_mixed,
    "p8_shares": p8_shares,
    "p9_method": p9_method,
    "p9_found": p9_found,
    "p9_disclosing_terms": p9_disclosing_terms,
    "p9_sanitised": p9_sanitised,
}
SQL = sql.SQL
