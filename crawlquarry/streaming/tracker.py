"""Change tracking over a stream of observations, and daily verdict counts with a watermark.

One state cell a site: the fingerprint of the directive lines last kept.  The rules are those of
`operators.diff.change_history`, which is the batch form and the oracle of this one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crawlquarry.operators.diff import transient
from crawlquarry.operators.findings import looks_like_html
from crawlquarry.operators.snapshots import directive_lines

EVENTS = "domain string, observed_at timestamp_ntz, obs_id long, status int, event string, n_lines int"


def prepared(observations: DataFrame) -> DataFrame:
    """Observations reduced to what the state machine needs, in the JVM."""
    usable = F.coalesce(F.col("status").between(200, 299), F.lit(False)) & ~looks_like_html(F.coalesce("body", F.lit("")))
    lines = directive_lines(F.when(usable, F.col("body")).otherwise(""))
    return observations.where("domain is not null and observed_at is not null").select(
        "domain", "observed_at", "obs_id", "status", F.coalesce(transient(F.col("status"), F.col("content_type"), F.col("body")), F.lit(True)).alias("t"), F.xxhash64(F.array_join(lines, "\n")).alias("print"), F.size(lines).alias("n_lines")
    )


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    counted, seeded, last = state.get if state.exists else (False, False, 0)
    out = []
    pdf = pd.concat(list(batches)).sort_values(["observed_at", "obs_id"])  # one site's rows of one micro batch
    for r in pdf.itertuples(index=False):
        seed_only = not counted and r.status in (404, 410)
        if r.t and not seed_only:
            continue
        event = "seeded" if not seeded else "changed" if r.print != last else None
        seeded, last = True, int(r.print)
        counted = counted or not r.t
        if event:
            out.append((key[0], r.observed_at, r.obs_id, r.status, event, r.n_lines))
    state.update((counted, seeded, last))
    if out:
        yield pd.DataFrame(out, columns=["domain", "observed_at", "obs_id", "status", "event", "n_lines"])


def change_events(observations: DataFrame) -> DataFrame:
    """Streaming events (seeded, changed) of every site; observations of a site must come in order across batches."""
    return prepared(observations).groupBy("domain").applyInPandasWithState(_advance, EVENTS, "counted boolean, seeded boolean, last long", "append", GroupStateTimeout.NoTimeout)


def daily_answers(observations: DataFrame, delay: str = "7 days") -> DataFrame:
    """Observations by day and status class over event time, duplicates by obs_id dropped, late rows up to the delay."""
    rows = observations.where("observed_at is not null").withColumn("at", F.col("observed_at").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["obs_id"])
    return rows.groupBy(F.window("at", "1 day"), F.floor(F.col("status") / 100).alias("class")).agg(F.count("*").alias("n"))
