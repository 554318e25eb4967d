"""Occurrences and distinct records of every distinct value, by burst-trie counting.

1. A census counts rows by value prefixes of four lengths: one pass aggregates the longest prefixes map-side, the
   shorter ones are summed from these.  Prefixes that hold more than a fair share of the rows are `hot`; there are at
   most HOT_SHARES a partition for each length, so that list is bounded.
2. Every map task collects its rows in a burst trie: values are stored as suffixes in containers, and a container
   that grows too large bursts into one child for each next character.  A leaf holds the occurrence count and the
   record ids, sorted and merged again whenever as many new ones have come.  The trie is written out whenever it holds
   `flush_records` ids and values, so a task's memory is bounded.
3. Subtrees are routed by adaptive prefixes: the shortest prefix that isn't hot.  A value that is hot itself is
   additionally salted by record, with as many salts as it holds fair shares of the rows, so a value of a third of all
   rows is counted by a third of all workers.
4. Each worker rebuilds the trie of a route, drops repeated records and emits (value, occurrences, records); counters
   of matching subtrees of different salts have disjoint records and are added.

Defined results: null and empty values are left out; a null record id counts as an occurrence, not as a record; an
empty table gives no rows; values are compared exactly as stored, in any length; repeated rows count as occurrences
once each and as one record.  Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from crawlquarry.session import shuffle_partitions

PREFIX_LENGTHS = (2, 4, 8, 16)
#: a prefix is hot if it holds more than 1 / (HOT_SHARES x partitions) of the rows
HOT_SHARES = 4
#: ids of a leaf are merged when at least so many new ones wait
MERGE_AT = 4_096
BURST_AT = 64
FLUSH_RECORDS = 2_000_000
RARE_AT_MOST = 2
COMMON_SHARE = 0.1

_COUNTED = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
_ROUTED = pa.schema([("route", pa.string()), ("salt", pa.int32()), ("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("ids", pa.list_(pa.int64()))])


class BurstTrie:
    """Compact trie of counters.  A node is a dict {next character: node}; its containers hold value suffixes.

    `add(term, n, ids)` adds n occurrences and an array of record ids; `items()` yields (term, n, distinct ids) in
    order of the values.
    """

    __slots__ = ("root", "burst_at", "held", "bursts")

    def __init__(self, burst_at: int = BURST_AT) -> None:
        self.root: dict = {}
        self.burst_at = burst_at
        self.held = 0
        self.bursts = 0

    def add(self, term: str, n: int, ids: np.ndarray) -> None:
        node, depth = self.root, 0
        while True:
            head = term[depth : depth + 1]
            child = node.get(head)
            if child is None:
                child = node[head] = _Container()
            if type(child) is dict:
                node, depth = child, depth + 1
                continue
            break
        suffix = term[depth + 1 :]
        entry = child.get(suffix)
        self.held += len(ids)
        if entry is None:
            child[suffix] = [n, [ids], 0]
            self.held += 1
            if len(child) > self.burst_at and head:
                node[head] = self._burst(child)
        else:
            entry[0] += n
            entry[1].append(ids)
            entry[2] += len(ids)
            if entry[2] > MERGE_AT and entry[2] > len(entry[1][0]):
                before = len(entry[1][0]) + entry[2]
                entry[1:] = [np.unique(np.concatenate(entry[1]))], 0
                self.held -= before - len(entry[1][0])

    def _burst(self, container: dict) -> dict:
        self.bursts += 1
        node: dict = {}
        for suffix, entry in container.items():
            head = suffix[:1]
            child = node.get(head)
            if child is None:
                child = node[head] = _Container()
            child[suffix[1:]] = entry
        return node

    def items(self) -> Iterator[tuple[str, int, np.ndarray]]:
        stack: list[tuple[str, dict]] = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            for head in sorted(node, reverse=True):
                child = node[head]
                if type(child) is dict:
                    stack.append((prefix + head, child))
                    continue
                for suffix in child:
                    n, parts, _ = child[suffix]
                    ids = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
                    yield prefix + head + suffix, n, ids


class _Container(dict):
    """Leaf container: value suffix -> [occurrences, record id arrays].  A plain dict is an inner node."""

    __slots__ = ()


def _salt_of(ids: np.ndarray, salts: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(salts)).astype(np.int32)


def route_of(field: str, term: str, hot: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The adaptive prefix that a value is routed by, and its number of salts (1 unless the whole value is hot)."""
    for n in PREFIX_LENGTHS:
        prefix = term[:n]
        shares = hot.get((field, prefix))
        if shares is None:
            return prefix, 1
        if len(term) <= n:
            return term, shares
    return term, hot[field, term[: PREFIX_LENGTHS[-1]]]


def _map_side(hot: dict[tuple[str, str], int], flush_records: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, BurstTrie] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[], [], [], [], [], []]
            held = 0
            for field, trie in tries.items():
                for term, n, ids in trie.items():
                    route, shares = route_of(field, term, hot)
                    if shares > 1 and len(ids):
                        salts = _salt_of(ids, shares)
                        order = np.argsort(salts, kind="stable")
                        edges = np.flatnonzero(np.diff(salts[order])) + 1
                        groups = [(int(salts[g[0]]), ids[g]) for g in np.split(order, edges)]
                    else:
                        groups = [(0, ids)]
                    for k, (salt, part) in enumerate(groups):
                        for c, v in zip(cols, (route, salt, field, term, n if k == 0 else 0, part)):
                            c.append(v)
                        held += 1 + len(part) // 16
                    if held > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _ROUTED)], schema=_ROUTED)
                        cols, held = [[], [], [], [], [], []], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _ROUTED)], schema=_ROUTED)
            tries.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            fields = batch.column(0).dictionary_encode()
            terms = batch.column(1).dictionary_encode()
            rec = batch.column(2)
            known = rec.is_valid().to_numpy(zero_copy_only=False)
            ids = rec.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            code = fields.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(terms.dictionary) + terms.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, code))
            code, ids, known = code[order], ids[order], known[order]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1, [len(code)]))
            names, values = fields.dictionary.to_pylist(), terms.dictionary.to_pylist()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                f, t = divmod(int(code[a]), len(values))
                own = ids[a:b]
                if not known[a:b].all():
                    own = own[known[a:b]]
                if b - a > 1:
                    own = np.unique(own)
                trie = tries.get(names[f])
                if trie is None:
                    trie = tries[names[f]] = BurstTrie()
                trie.add(values[t], b - a, own)
            if sum(t.held for t in tries.values()) > flush_records:
                yield from emit()
        yield from emit()

    return work


def _reduce_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by route: the trie of one route at a time is held."""
    route, tries = None, {}
    out: list[list] = [[], [], [], []]

    def close() -> None:
        for field, trie in tries.items():
            for term, n, ids in trie.items():
                for c, v in zip(out, (field, term, n, len(ids))):
                    c.append(v)
        tries.clear()

    def flush() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _COUNTED)], schema=_COUNTED)
        for c in out:
            c.clear()
        return done

    for batch in batches:
        offsets = batch.column(5).offsets.to_numpy()
        flat = batch.column(5).values.to_numpy(zero_copy_only=False)
        for i, (r, s, f, t, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)))):
            if (r, s) != route:
                close()
                route = (r, s)
            trie = tries.get(f)
            if trie is None:
                trie = tries[f] = BurstTrie()
            trie.add(t, n, flat[offsets[i] : offsets[i + 1]].copy())
        if len(out[0]) > 20_000:
            yield flush()
    close()
    if out[0]:
        yield flush()


def hot_prefixes(values: DataFrame, partitions: int) -> dict[tuple[str, str], int]:
    """Prefixes that hold more than a fair share of the rows, with the number of fair shares they hold (rounded up).

    One pass: at most HOT_SHARES x partitions prefixes of a length can exceed a fair share, so that many of the largest
    are fetched and the share, known from the same pass, is applied to them.
    """
    most = HOT_SHARES * partitions * len(PREFIX_LENGTHS)
    seen = Observation()
    longest = values.observe(seen, F.count(F.lit(1)).alias("n")).groupBy("field", F.substring("term", 1, PREFIX_LENGTHS[-1]).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    prefixes = F.array_distinct(F.array(*[F.substring("start", 1, n) for n in PREFIX_LENGTHS]))
    counted = longest.select("field", "n", F.explode(prefixes).alias("prefix")).groupBy("field", "prefix").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "field", "prefix").limit(most).collect()
    share = max(1, (seen.get["n"] if rows else 0) // (HOT_SHARES * partitions))
    return {(r["field"], r["prefix"]): -(-r["n"] // share) for r in rows if r["n"] > share}


def term_counts(values: DataFrame, flush_records: int = FLUSH_RECORDS) -> DataFrame:
    """field, term, occurrences, records of a table (field STRING, term STRING, record_id BIGINT)."""
    spark = values.sparkSession
    partitions = shuffle_partitions(spark)
    kept = values.select("field", "term", F.col("record_id").cast("long").alias("record_id")).where("term is not null and term <> '' and field is not null")
    hot = hot_prefixes(kept, partitions)
    routed = kept.mapInArrow(_map_side(hot, flush_records), "route string, salt int, field string, term string, occurrences long, ids array<long>")
    grouped = routed.repartition(partitions, "route", "salt").sortWithinPartitions("route", "salt")
    subtrees = grouped.mapInArrow(_reduce_side, "field string, term string, occurrences long, records long")
    return subtrees.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(values: DataFrame, rare_at_most: int = RARE_AT_MOST, common_share: float = COMMON_SHARE) -> DataFrame:
    """term_counts plus `mark`: rare (at most so many records), else common (more than that share of the field's
    records with any value), else null."""
    counts = term_counts(values)
    totals = (
        values.where("term is not null and term <> '' and field is not null and record_id is not null")
        .select("field", "record_id").distinct().groupBy("field").agg(F.count("*").alias("all_records"))
    )
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") > F.col("all_records") * common_share, "common")
    return counts.join(F.broadcast(totals), "field", "left").select("field", "term", "occurrences", "records", mark.alias("mark"))  # one row a field


def values_of(agents: DataFrame, rules: DataFrame, records: DataFrame) -> DataFrame:
    """The three counted columns as one long table."""
    return (
        agents.select(F.lit("token").alias("field"), F.col("token").alias("term"), F.col("fetch_id").alias("record_id"))
        .unionByName(rules.select(F.lit("path").alias("field"), F.col("path").alias("term"), F.col("fetch_id").alias("record_id")))
        .unionByName(records.select(F.lit("platform").alias("field"), F.col("platform").alias("term"), F.col("record_id")))
    )
