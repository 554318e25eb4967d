"""Changes between consecutive full snapshots of a table.

Method: every standing row is reduced to a compact key hash (2 x 64 bit), a row hash and a hash of its map of
verdicts.  The hashes are spread over buckets by key; inside a bucket numpy sorts the key arrays of each
delivery and set differences come from `searchsorted`.  Full values are fetched afterwards, for differing keys
only, and decide exactly: a bit table of the rows wanted drops all others in the scan, before any value is computed or
shuffled.  The table has 16 bits a wanted row, with a bound (see session.bit_table); beyond that more other rows pass it, and the join
behind it drops them.

Defined results
* Rows whose run number or key is null belong to no delivery and are left out.
* Exact repeats and several rows of a key in one run: the latest `fetched_at` stands (null counts as earliest);
  ties fall to the highest `snap_id`, then to the higher row hash, so repeated rows never matter.
* An empty table, or one with a single delivery, gives no rows.  A null body has no directive lines.
* Null differs from any value and equals null.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquarry.session import bit_table, cut, in_table, shuffle_partitions

VALUE_COLUMNS = ("http_status", "final_url", "unavailable", "html")
#: about so many standing rows go into one bucket (two 8-byte keys and two 8-byte hashes a row)
BUCKET_ROWS = 400_000


def directive_lines(text: Column) -> Column:
    """Lines cut at the first `#`, trimmed, without blank ones, in order; a null text has none."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n", -1)
    cut_lines = F.transform(lines, lambda x: F.regexp_replace(F.substring_index(x, "#", 1), r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}]+$", ""))
    return F.filter(cut_lines, lambda x: x != "")


def _wide_hash(*cols: Column) -> Column:
    """64-bit hash that tells null from every value."""
    parts: list[Column] = []
    for c in cols:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def standing_rows(snapshots: DataFrame, key: str = "domain", run: str = "run_no") -> DataFrame:
    """One compact row for each key and run: the row that stands, as hashes plus its snap_id."""
    sorted_map = F.array_sort(F.map_entries(F.col("verdicts")))
    compact = snapshots.where(F.col(run).isNotNull() & F.col(key).isNotNull()).select(
        F.col(run).cast("int").alias("run_no"),
        F.col(key).alias("domain"),
        F.col("fetched_at"),
        F.col("snap_id"),
        _wide_hash(*[F.col(c) for c in VALUE_COLUMNS], F.array_join(directive_lines(F.col("robots_txt")), "\n")).alias("row_hash"),
        F.xxhash64(F.to_json(sorted_map)).alias("map_hash"),
    )
    order = F.struct(F.col("fetched_at"), F.col("snap_id"), F.col("row_hash"), F.col("map_hash"))
    best = compact.groupBy("run_no", "domain").agg(F.max(order).alias("b"))
    return best.select("run_no", "domain", F.col("b.fetched_at").alias("fetched_at"), F.col("b.snap_id").alias("snap_id"), F.col("b.row_hash").alias("row_hash"), F.col("b.map_hash").alias("map_hash"))


def diff_sorted(prev: tuple[np.ndarray, ...], cur: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set differences of two sorted, distinct key arrays with their hashes.

    Each argument is (keys, row_hash, map_hash).  Returns added and removed keys and those whose hashes differ.
    """
    pk, pr, pm = prev
    ck, cr, cm = cur
    if len(pk) == 0 or len(ck) == 0:
        return ck, pk, ck[:0]
    at = np.searchsorted(pk, ck)
    inside = at < len(pk)
    hit = np.zeros(len(ck), dtype=bool)
    hit[inside] = pk[at[inside]] == ck[inside]
    back = np.searchsorted(ck, pk)
    kept = np.zeros(len(pk), dtype=bool)
    ok = back < len(ck)
    kept[ok] = ck[back[ok]] == pk[ok]
    where = at[hit]
    differs = (pr[where] != cr[hit]) | (pm[where] != cm[hit])
    return ck[~hit], pk[~kept], ck[hit][differs]


_PART = "run_no int, prev_run_no int, kind string, domain string, at int, id_hash long, row_hash long, map_hash long"


def _bucket_diff(runs: list[int]):
    previous = dict(zip(runs[1:], runs[:-1]))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        k1, k2 = pdf["k1"].to_numpy(np.int64), pdf["k2"].to_numpy(np.int64)
        order = np.lexsort((k2, k1))
        fresh = np.ones(len(order), dtype=bool)
        if len(order) > 1:
            fresh[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        dense = np.empty(len(order), dtype=np.int64)
        dense[order] = np.cumsum(fresh) - 1  # one small integer for each 128-bit key
        run = pdf["run_no"].to_numpy(np.int64)
        row, mp = pdf["row_hash"].to_numpy(np.int64), pdf["map_hash"].to_numpy(np.int64)
        arrays, places = {}, {}
        for r in runs:
            at = np.flatnonzero(run == r)
            at = places[r] = at[np.argsort(dense[at], kind="stable")]
            arrays[r] = (dense[at], row[at], mp[at])
        out = []

        def take(kind: str, r: int, p: int, side: int, keys: np.ndarray) -> None:
            if len(keys):
                rows = places[side][np.searchsorted(arrays[side][0], keys)]
                out.append(pdf.iloc[rows][["domain", "id_hash", "row_hash", "map_hash"]].assign(run_no=np.int32(r), prev_run_no=np.int32(p), kind=kind, at=np.int32(side)))

        for r, p in previous.items():
            added, removed, differs = diff_sorted(arrays[p], arrays[r])
            take("added", r, p, r, added)
            take("removed", r, p, p, removed)
            take("differs", r, p, r, differs)
            take("differs", r, p, p, differs)
        names = [c.split(" ")[0] for c in _PART.split(", ")]
        if not out:
            return pdf.iloc[:0].assign(prev_run_no=np.int32(0), kind="", at=np.int32(0))[names]
        return pd.concat(out, ignore_index=True)[names]

    return work


def snapshot_changes(snapshots: DataFrame, key: str = "domain", run: str = "run_no", detail: bool = False) -> DataFrame:
    """Keys added, removed and changed from each delivery to the next one that exists.

    Columns run_no, domain, change_kind; with `detail` also prev_run_no, is_changed (directive lines differ, only
    where both runs hold the key) and bot_changes (name, old_verdict, new_verdict), for every key present in
    either run that differs in any of the hashes, change_kind null where only a one-sided verdict differs.
    """
    spark = snapshots.sparkSession
    keys = [F.xxhash64(F.col("domain")).alias("k1"), F.xxhash64(F.lit(7), F.col("domain")).alias("k2")]
    standing = cut(standing_rows(snapshots, key, run).select("run_no", "domain", _wide_hash(F.col("snap_id"), F.col("fetched_at")).alias("id_hash"), "row_hash", "map_hash", *keys))
    per_run = {r["run_no"]: r["n"] for r in standing.groupBy("run_no").agg(F.count("*").alias("n")).collect()}  # one row a delivery
    runs = sorted(per_run)
    buckets = max(1, min(sum(per_run.values()) // BUCKET_ROWS + 1, 1_000_000))
    buckets = max(buckets, min(shuffle_partitions(spark), sum(per_run.values()) // 20_000 + 1))
    compact = standing.withColumn("bucket", F.pmod(F.xxhash64(F.lit(11), "k1", "k2"), F.lit(buckets)))
    diffs = cut(compact.groupBy("bucket").applyInPandas(_bucket_diff(runs), _PART))
    entry = "array<struct<name:string,old_verdict:string,new_verdict:string>>"
    one_sided = diffs.where("kind <> 'differs'").select("run_no", "prev_run_no", "domain", F.col("kind").alias("change_kind"), F.lit(None).cast("boolean").alias("is_changed"), F.lit(None).cast(entry).alias("bot_changes"))

    # full values of the differing keys only
    wanted = diffs.where("kind = 'differs'").select("run_no", "prev_run_no", "domain", "at", "id_hash", "row_hash", "map_hash")
    its_run = F.col(run).cast("int")
    its_id = _wide_hash(F.col("snap_id"), F.col("fetched_at"))
    table, bits = bit_table(wanted, F.col("at"), F.col("domain"), F.col("id_hash"))
    src = snapshots.where(in_table(table, bits, its_run, F.col(key), its_id)).select(
        its_run.alias("s_run"), F.col(key).alias("s_domain"), its_id.alias("s_id"),
        *[F.col(c).alias(f"s_{c}") for c in VALUE_COLUMNS],
        directive_lines(F.col("robots_txt")).alias("s_lines"), F.array_sort(F.map_entries("verdicts")).alias("s_verdicts"),
    )
    src = src.withColumn("s_row", _wide_hash(*[F.col(f"s_{c}") for c in VALUE_COLUMNS], F.array_join("s_lines", "\n"))).withColumn("s_map", F.xxhash64(F.to_json("s_verdicts")))
    value = F.struct(*[F.col(f"s_{c}").alias(c) for c in VALUE_COLUMNS], F.col("s_lines").alias("lines"), F.col("s_verdicts").alias("verdicts"))
    same = (F.col("s_run") == F.col("at")) & (F.col("s_domain") == F.col("domain")) & (F.col("s_id") == F.col("id_hash"))
    held = wanted.join(src, same & (F.col("s_row") == F.col("row_hash")) & (F.col("s_map") == F.col("map_hash")))
    pair = held.groupBy("run_no", "prev_run_no", "domain").agg(F.max(F.when(F.col("at") == F.col("run_no"), value)).alias("c"), F.max(F.when(F.col("at") == F.col("prev_run_no"), value)).alias("p"))
    flips = F.expr(
        "array_sort(flatten(transform(coalesce(c.verdicts, array()), x -> transform(filter(coalesce(p.verdicts, array()), y -> y.key = x.key and not (y.value <=> x.value)), "
        "y -> named_struct('name', x.key, 'old_verdict', y.value, 'new_verdict', x.value)))))"
    ).cast(entry)
    lines_differ = ~F.col("c.lines").eqNullSafe(F.col("p.lines"))
    values_differ = lines_differ
    for name in VALUE_COLUMNS:
        values_differ = values_differ | ~F.col(f"c.{name}").eqNullSafe(F.col(f"p.{name}"))
    judged = pair.withColumn("bot_changes", flips).select(
        "run_no", "prev_run_no", "domain",
        F.when(values_differ | (F.size("bot_changes") > 0), F.lit("changed")).alias("change_kind"),
        lines_differ.alias("is_changed"), "bot_changes",
    )
    changes = one_sided.unionByName(judged)
    if detail:
        return changes
    return changes.where(F.col("change_kind").isNotNull()).select("run_no", "domain", "change_kind")


def corrected_diffs(snapshots: DataFrame, reported: DataFrame) -> DataFrame:
    """What the old tracker's reports should have said, for each key held by two consecutive runs that differs.

    Columns run_no, prev_run_no, domain, is_changed, n_bot_changes, bot_changes, reported_is_changed, verdict_of_report:
    `agrees`, `wrong`, `unknown` (reported null) or `missing` (no report).  Reports of pairs without any difference
    that claim one come out as `wrong`.  Repeated reports of a pair count once (true wins over false over null).
    """
    changes = snapshot_changes(snapshots, detail=True).where("change_kind is null or change_kind = 'changed'").select(
        "run_no", "prev_run_no", "domain", "is_changed", F.coalesce("bot_changes", F.array().cast("array<struct<name:string,old_verdict:string,new_verdict:string>>")).alias("bot_changes")
    )
    rep = reported.where(F.col("domain").isNotNull()).groupBy("domain", "run_no", "prev_run_no").agg(F.max("is_changed").alias("reported_is_changed"), F.count(F.lit(1)).alias("reports"))
    both = changes.join(rep, ["domain", "run_no", "prev_run_no"], "full")
    truth = F.coalesce(F.col("is_changed"), F.lit(False))
    said = (
        F.when(F.col("reports").isNull(), "missing")
        .when(F.col("reported_is_changed").isNull(), "unknown")
        .when(F.col("reported_is_changed") == truth, "agrees")
        .otherwise("wrong")
    )
    return both.select(
        "run_no", "prev_run_no", "domain", truth.alias("is_changed"),
        F.coalesce(F.size("bot_changes"), F.lit(0)).cast("int").alias("n_bot_changes"),
        F.array_join(F.transform("bot_changes", lambda x: F.concat_ws(":", x["name"], x["old_verdict"], x["new_verdict"])), ",").alias("bot_changes"),
        "reported_is_changed", said.alias("verdict_of_report"),
    )
