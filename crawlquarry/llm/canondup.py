"""Duplicates hidden by formatting: canonical records, range partitioning, sorting, and a scan of adjacent runs.

Every row becomes (source, id, canonical key, 128-bit hash of the key).  Rows are range-partitioned by (hash, id), so a
key of any number of copies is spread over as many partitions as its rows need, and sorted externally by (hash, key,
id).  One pass over each partition compares full keys of neighbours and forms runs.  Only the runs of the first and the
last hash of a partition can go on in a neighbour; those few (a bounded number for each partition) are merged by full
key afterwards.

Defined results
* fetches: a text's key are its lines, each reduced to lower-case letters and digits, sorted, each as often as it
  occurs; lines and texts of which nothing remains don't count, nor do null texts.  Line ends are LF, CRLF or CR.
* record lines: the key are the fields with their values, nested ones by their path, reduced in the same way and sorted;
  what isn't a record in any JSON-like notation is reduced as a whole.  Null differs from a missing field.
* A repeated id of equal content is one; an id stored with two different contents belongs to both sets.
* An empty table gives no rows; texts of any length are compared whole; extra columns are never read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.session import cut, shuffle_partitions

# -- canonical keys ------------------------------------------------------------------------------------------------


def text_keys(fetches: DataFrame, row_id: str = "fetch_id", text: str = "text", src: str = "fetches") -> DataFrame:
    """src, id, key of every text with content: in the JVM, without Python."""
    lines = F.split(F.lower(F.col(text)), "\r\n|\r|\n", -1)
    reduced = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")), lambda x: x != "")
    key = F.array_join(F.array_sort(reduced), "\n")
    return fetches.where(F.col(text).isNotNull() & F.col(row_id).isNotNull()).select(F.lit(src).alias("src"), F.col(row_id).cast("long").alias("id"), key.alias("key")).where("key <> ''")


_LEX = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*")|('(?:[^'\\]|\\.)*')|([{}\[\]:,;=])|([^\s{}\[\]:,;="']+))""", re.S)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_PLAIN_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(s: str) -> str:
    if "\\" not in s:
        return s
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _PLAIN_ESCAPES.get(m[1], m[1]), s)


class NotARecord(ValueError):
    pass


def _lenient(raw: str) -> list[tuple[str, str]]:
    """Leaf fields (path, value) of a JSON-like object: single quotes, bare words and stray separators are accepted."""
    tokens: list[tuple[str, bool]] = []
    at = 0
    while at < len(raw):
        m = _LEX.match(raw, at)
        if not m:
            if raw[at:].strip():
                raise NotARecord
            break
        at = m.end()
        quoted = m[1] or m[2]
        tokens.append((_unescape(quoted[1:-1]), False) if quoted else (m[3], True) if m[3] else (m[4], False))
    leaves: list[tuple[str, str]] = []
    if not tokens or tokens[0] != ("{", True):
        raise NotARecord
    stack: list[list] = [["", "{", None, 0]]  # path, bracket, waiting key, index
    i = 1
    while i < len(tokens) and stack:
        text, mark = tokens[i]
        i += 1
        path, bracket, key, index = top = stack[-1]
        if mark and text in "}]":
            if (text == "}") != (bracket == "{"):
                raise NotARecord
            stack.pop()
            continue
        if mark and text in ",;":
            top[2] = None
            continue
        if mark and text in ":=":
            if key is None:
                raise NotARecord
            continue
        if bracket == "{" and key is None:
            if mark:
                raise NotARecord
            top[2] = text
            continue
        where = f"{path}\x1e{_reduce(key)}" if bracket == "{" else f"{path}\x1e#{index}"
        top[3] += 1
        if mark:
            stack.append([where, text, None, 0])
            leaves.append((where, text))
        else:
            leaves.append((where, _reduce(text)))
            top[2] = None if bracket == "{" and i < len(tokens) and tokens[i][1] else top[2]
    if stack or any(not (mark and t in ",;") for t, mark in tokens[i:]):
        raise NotARecord
    return leaves


def _reduce(value: str) -> str:
    low = value.lower()
    return low if low.isalnum() else "".join(c for c in low if c.isalnum())


def _leaves(value, path: str, out: list[tuple[str, str]]) -> None:
    if isinstance(value, dict):
        if path:
            out.append((path, "{"))
        for k, v in value.items():
            _leaves(v, f"{path}\x1e{_reduce(k)}", out)
    elif isinstance(value, list):
        out.append((path, "["))
        for i, v in enumerate(value):
            _leaves(v, f"{path}\x1e#{i}", out)
    else:
        out.append((path, _reduce(value)))


class _Pairs(dict):
    pass


def record_key(raw: str | None) -> str | None:
    """Canonical key of a raw record line; None if nothing remains of it."""
    if raw is None:
        return None
    try:
        value = json.loads(raw, parse_int=str, parse_float=str, parse_constant=str)
        if not isinstance(value, dict):
            raise NotARecord
        leaves: list[tuple[str, str]] = []
        _leaves(_words(value), "", leaves)
    except (ValueError, RecursionError):
        try:
            leaves = _lenient(raw)
        except NotARecord:
            whole = _reduce(raw)
            return f"raw\x1f{whole}" if whole else None
    if not leaves:
        return None
    return "\x1f".join(sorted(f"{p}={v}" for p, v in leaves))


def _words(value):
    """Booleans and null as the words that stand for them in the raw line."""
    if isinstance(value, dict):
        return {k: _words(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_words(v) for v in value]
    return "null" if value is None else "true" if value is True else "false" if value is False else value


def _record_keys(src: str):
    schema = pa.schema([("src", pa.string()), ("id", pa.int64()), ("key", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), [record_key(x) for x in batch.column(1).to_pylist()]
            kept = [(i, k) for i, k in zip(ids, keys) if k]
            yield pa.RecordBatch.from_arrays([pa.array([src] * len(kept), pa.string()), pa.array([i for i, _ in kept], pa.int64()), pa.array([k for _, k in kept], pa.string())], schema=schema)

    return work


def record_keys(lines: DataFrame, row_id: str = "line_id", raw: str = "raw", src: str = "record_lines") -> DataFrame:
    rows = lines.where(F.col(raw).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(raw).alias("raw"))
    return rows.mapInArrow(_record_keys(src), "src string, id long, key string")


# -- adjacent runs -------------------------------------------------------------------------------------------------

_SCANNED = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("src", pa.string()), ("id", pa.int64()), ("first_id", pa.int64()), ("n", pa.int64()), ("key", pa.string())])
_SCANNED_DDL = "part int, run long, src string, id long, first_id long, n long, key string"


def _scan(members: bool):
    """Rows of a partition, sorted by (h1, h2, src, key, id), to runs.

    Emits member rows (id set) of runs of two ids or more, if wanted, else one summary row a run; and for the runs
    of the first and last hash a marker row with the key.  Single rows of those runs are members as well.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[list] = [[] for _ in _SCANNED]

        def put(*row) -> None:
            for c, v in zip(out, row):
                c.append(v)

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _SCANNED)], schema=_SCANNED)
            for c in out:
                c.clear()
            return done

        run, hash_now, first_hash = -1, None, None
        key_now = src_now = first_id = last_id = None
        n, told = 0, False
        open_runs: list[tuple] = []  # (run, src, first_id, n, key) of the current hash

        def close_run() -> None:
            if n:
                open_runs.append((run, src_now, first_id, n, key_now))

        def close_hash(edge: bool) -> None:
            for r, s, f, k, key in open_runs:
                if edge:
                    put(part, r, s, None, f, k, key)
                    if members and k == 1:
                        put(part, r, s, f, f, None, None)
                elif not members:
                    put(part, r, s, None, f, k, None)
            open_runs.clear()

        for batch in batches:
            h1, h2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, s, i, k in zip(h1, h2, batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if (a, b) == hash_now and k == key_now and s == src_now:
                    if i != last_id:
                        n += 1
                        if members:
                            if not told:
                                put(part, run, s, first_id, first_id, None, None)
                                told = True
                            put(part, run, s, i, first_id, None, None)
                        last_id = i
                    continue
                close_run()
                if (a, b) != hash_now:
                    close_hash(hash_now == first_hash)
                    hash_now = (a, b)
                    first_hash = first_hash or hash_now
                run, key_now, src_now, first_id, last_id, n, told = run + 1, k, s, i, i, 1, False
            if len(out[0]) > 20_000:
                yield flush()
        close_run()
        close_hash(True)
        if out[0]:
            yield flush()

    return work


def _runs(keyed: DataFrame, members: bool) -> tuple[DataFrame, DataFrame]:
    """Scanned rows, and for the runs at the edges (part, run) -> first id and size over all partitions."""
    n = shuffle_partitions(keyed.sparkSession)
    hashed = keyed.select(F.xxhash64("src", "key").alias("h1"), F.xxhash64(F.lit(3), "key", "src").alias("h2"), "src", "id", "key")
    ordered = hashed.repartitionByRange(n, "h1", "h2", "id").sortWithinPartitions("h1", "h2", "src", "key", "id")
    scanned = cut(ordered.mapInArrow(_scan(members), _SCANNED_DDL))
    edge = scanned.where("key is not null")
    merged = edge.groupBy("src", "key").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("copies"), F.min(F.struct("part", "run")).alias("lead"))
    resolved = edge.join(merged, ["src", "key"]).select("part", "run", "keep_id", "copies", (F.col("lead") == F.struct("part", "run")).alias("leads"))
    return scanned, F.broadcast(resolved)  # at most the runs of two hashes for each partition


def copy_pairs(keyed: DataFrame) -> DataFrame:
    """src, keep_id, copy_id of a table (src, id, key): every other id of each set of equal keys, with its smallest."""
    scanned, resolved = _runs(keyed, members=True)
    rows = scanned.where("id is not null").join(resolved, ["part", "run"], "left")
    pairs = rows.select("src", F.coalesce("keep_id", "first_id").alias("keep_id"), F.col("id").alias("copy_id"))
    return pairs.where("keep_id < copy_id")


def distinct_contents(keyed: DataFrame) -> DataFrame:
    """src, keep_id, copies: one row for each distinct content with its exact number of distinct ids."""
    scanned, resolved = _runs(keyed, members=False)
    runs = scanned.where("id is null").join(resolved, ["part", "run"], "left")
    kept = runs.where("keep_id is null or leads")
    return kept.select("src", F.coalesce("keep_id", "first_id").alias("keep_id"), F.coalesce("copies", "n").alias("copies"))
