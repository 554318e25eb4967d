"""Mixing sources to target shares of the total size, with capped repetition.

Tokens are added up for each source over its distinct texts: a text that a source holds under several ids counts once,
so it can't be used more often than the cap allows.  A mix of T tokens repeats a source share x T / tokens times; T is
the largest total at which no source exceeds its cap, unless a total is asked for (then rates are cut at the caps and
the report shows the shares that result).  Each text is emitted floor(rate) times, plus one copy if a hash of seed, mix
and id falls below the fraction.

Defined results: null texts, texts of a null source and of sources without a target aren't used; a target without any
text or share gets nothing and the other shares are reported as they come out; a cap that is null or below 1 counts as 1;
empty texts weigh nothing and are emitted like others; repeated rows of a text in a source are one text, under its
smallest id.  The same seed gives the same mix, however the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.llm import tokens
from crawlquarry.session import cut

MOST_TARGETS = 10_000
SEED = 20_260_101


def distinct_texts(docs: DataFrame, vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """source, doc_id, n_tokens: every distinct text of every source, under its smallest id.  Cut: used twice."""
    hashed = docs.where("source is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(5), "text").alias("h2")
    )
    sizes = tokens.sized(hashed, ["doc_id", "source", "h1", "h2"], path=vocabulary)
    best = sizes.groupBy("source", "h1", "h2").agg(F.min(F.struct("doc_id", "n_tokens")).alias("b"))
    return cut(best.select("source", F.col("b.doc_id").alias("doc_id"), F.col("b.n_tokens").alias("n_tokens")))


def repetition_rates(texts: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """mix_id, source, target_share, max_repeats, source_tokens, rate; one row a target."""
    if targets.count() > MOST_TARGETS:
        raise ValueError("too many targets: the table is meant to be a fixed list")
    per_source = texts.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    wanted = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.sum("target_share").alias("target_share"), F.greatest(F.lit(1), F.coalesce(F.max("max_repeats"), F.lit(1))).alias("max_repeats")
    )
    both = wanted.join(per_source, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    usable = (F.col("source_tokens") > 0) & (F.col("target_share") > 0)
    if total_tokens is None:
        total = both.where(usable).groupBy("mix_id").agg(F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("target_share")).alias("total"))
        both = both.join(F.broadcast(total), "mix_id", "left")  # no more rows than targets
    else:
        both = both.withColumn("total", F.lit(float(total_tokens)))
    rate = F.when(usable, F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.col("total") / F.col("source_tokens"))).otherwise(F.lit(0.0))
    return both.select("mix_id", "source", "target_share", "max_repeats", "source_tokens", rate.alias("rate"))


def emitted(texts: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """mix_id, source, doc_id, n_tokens, copies (1 or more)."""
    whole = F.floor(F.col("rate") + 1e-9)
    fraction = F.greatest(F.lit(0.0), F.col("rate") - whole)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("mix_id"), F.col("source"), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    copies = (whole + F.when((draw < fraction) & (fraction > 1e-9), 1).otherwise(0)).cast("int")
    plan = F.broadcast(rates.select("mix_id", "source", "rate").where("rate > 0"))  # at most MOST_TARGETS rows, checked
    return texts.join(plan, "source").select("mix_id", "source", "doc_id", "n_tokens", copies.alias("copies")).where("copies > 0")


def mixed(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED, vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """mix_id, source, doc_id, copy_no, n_tokens: one row for each emitted copy."""
    texts = distinct_texts(docs, vocabulary)
    rows = emitted(texts, repetition_rates(texts, targets, total_tokens), seed)
    return rows.select("mix_id", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")


def share_report(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED, vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """Target and actual share, rate, texts, copies and tokens of every source of every mix."""
    texts = distinct_texts(docs, vocabulary)
    rates = repetition_rates(texts, targets, total_tokens)
    per_source = emitted(texts, rates, seed).groupBy("mix_id", "source").agg(
        F.count("*").alias("texts_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    per_mix = per_source.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    none = F.lit(0).cast("long")
    joined = rates.join(per_source, ["mix_id", "source"], "left").join(F.broadcast(per_mix), "mix_id", "left")  # one row a mix
    return joined.select(
        "mix_id", "source", "target_share",
        F.when(F.col("mix_tokens") > 0, F.coalesce("tokens", none) / F.col("mix_tokens")).otherwise(F.lit(0.0)).alias("actual_share"),
        "max_repeats", "rate", F.coalesce("texts_used", none).alias("texts_used"), F.coalesce("copies", none).alias("copies"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("tokens", none).alias("tokens"), "source_tokens",
    )
