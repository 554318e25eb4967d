"""Filling containers of fixed capacity with items of varying length: bounded-space online packing.

Every partition keeps at most `windows` open containers for each pack.  An item goes into the open container it fits
best; if none fits, a new one is opened, and where no further may be open the fullest is emitted first.  An item that
alone exceeds the capacity is split into full containers and a rest, which is packed like any item; no other item is
split.  What is still open at a partition's end is merged afterwards, by best fit in decreasing order, in groups of
FAN_IN partitions and several rounds, so no task ever holds more than FAN_IN x windows containers of a pack.

Defined results: null texts are left out; an empty text is an item of 0 tokens and is packed; repeated rows are packed
each; ties of fit go to the container opened first; an empty table or a pack whose source has no text gives no rows;
a capacity that is null or below 1 is refused.  Further columns, whatever their names, are never read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.llm import tokens
from crawlquarry.session import cut

WINDOWS = 64
FAN_IN = 32
MOST_PACKS = 1_000

_PLACED = pa.schema([("pack_id", pa.int32()), ("part", pa.int32()), ("win", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("first_token", pa.int32()), ("n_tokens", pa.int32()), ("used", pa.int32())])
_PLACED_DDL = "pack_id int, part int, win long, doc_id long, piece int, first_token int, n_tokens int, used int"


class Packer:
    """Open containers of one pack in one partition."""

    def __init__(self, capacity: int, windows: int = WINDOWS) -> None:
        if capacity is None or capacity < 1:
            raise ValueError("a container needs a capacity of at least 1")
        self.capacity, self.windows = capacity, windows
        self.free: list[tuple[int, int]] = []  # (free space, container), sorted
        self.opened = 0

    def put(self, size: int) -> int:
        """The container of an item that is no larger than the capacity."""
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            space, win = self.free.pop(at)
        else:
            if len(self.free) >= self.windows:
                self.free.pop(0)  # none fits: the fullest is emitted
            space, win = self.capacity, self.opened
            self.opened += 1
        space -= size
        if space > 0:
            bisect.insort(self.free, (space, win))
        return win

    def split(self, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(container, piece, first token, tokens) of an item of any size."""
        piece = at = 0
        while size - at > self.capacity:
            yield self.opened, piece, at, self.capacity
            self.opened += 1
            piece, at = piece + 1, at + self.capacity
        yield self.put(size - at), piece, at, size - at


def _place(packs: list[tuple[int, int, str | None]], windows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packers = {p: Packer(c, windows) for p, c, _ in packs}
        out: list[list] = [[] for _ in _PLACED]

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _PLACED)], schema=_PLACED)
            for c in out:
                c.clear()
            return done

        for batch in batches:
            for doc, source, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for pack, _, only in packs:
                    if only is None or only == source:
                        for win, piece, first, n in packers[pack].split(size):
                            for c, v in zip(out, (pack, part, win, doc, piece, first, n, None)):
                                c.append(v)
            if len(out[0]) > 20_000:
                yield flush()
        for pack, packer in packers.items():  # what is still open
            for space, win in packer.free:
                for c, v in zip(out, (pack, part, win, None, None, None, None, packer.capacity - space)):
                    c.append(v)
        yield flush()

    return work


def _merge(capacities: dict[int, int], windows: int, last: bool):
    """Containers of a group to merged ones, best fit in decreasing order; the emptiest stay open for the next round."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pack, group = int(pdf["pack_id"].iloc[0]), int(pdf["grp"].iloc[0])
        pdf = pdf.sort_values(["used", "part", "win"], ascending=[False, True, True], kind="stable")
        packer = Packer(capacities[pack], windows=len(pdf) + 1)
        new = [packer.put(int(u)) for u in pdf["used"]]
        keep = {w for _, w in packer.free} if not last else set()
        if len(keep) > windows:
            keep = {w for _, w in packer.free[-windows:]}
        used = {w: packer.capacity - s for s, w in packer.free}
        return pd.DataFrame({"pack_id": pdf["pack_id"].astype("int32"), "part": pdf["part"].astype("int32"), "win": pdf["win"].astype("int64"), "to_part": group, "to_win": new, "to_used": [used.get(w, packer.capacity) for w in new], "still_open": [w in keep for w in new]}).astype({"to_part": "int32", "to_win": "int64", "to_used": "int32"})

    return work


def packed(docs: DataFrame, limits: DataFrame, vocabulary: str = tokens.DEFAULT_VOCABULARY, windows: int = WINDOWS) -> DataFrame:
    """pack_id, container, doc_id, piece, first_token, n_tokens: every text of every pack, in its container.

    `limits` (pack_id, capacity_tokens, source) is a fixed list; more than MOST_PACKS packs are refused.
    """
    if limits.count() > MOST_PACKS:
        raise ValueError("too many packs for one job")
    packs = sorted((int(r["pack_id"]), r["capacity_tokens"], r["source"]) for r in limits.where("pack_id is not null").select("pack_id", "capacity_tokens", "source").distinct().collect())
    for _, capacity, _ in packs:
        if capacity is None or capacity < 1:
            raise ValueError("a container needs a capacity of at least 1")
    capacities = {p: c for p, c, _ in packs}
    sizes = tokens.sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), ["doc_id", "source"], path=vocabulary)
    placed = cut(sizes.mapInArrow(_place(packs, windows), _PLACED_DDL))

    level = placed.where("used is not null").select("pack_id", "part", "win", "used")
    # where the containers of the first round went: (part, win) -> container name
    moved = level.select("pack_id", "part", "win", F.col("part").alias("at_part"), F.col("win").alias("at_win"), F.lit(0).alias("round"))
    top = level.agg(F.max("part").alias("m")).first()["m"]
    groups, round_no = (0 if top is None else top + 1), 0
    while groups > 0:
        round_no += 1
        groups_next = -(-groups // FAN_IN)
        last = groups_next == 1
        step = cut(
            level.withColumn("grp", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("pack_id", "grp").applyInPandas(
                _merge(capacities, windows, last), "pack_id int, part int, win long, to_part int, to_win long, to_used int, still_open boolean"
            )
        )
        hop = step.select(F.col("pack_id").alias("p"), F.col("part").alias("s_part"), F.col("win").alias("s_win"), "to_part", "to_win")
        on = (F.col("pack_id") == F.col("p")) & (F.col("at_part") == F.col("s_part")) & (F.col("at_win") == F.col("s_win")) & (F.col("round") == round_no - 1)
        moved = moved.join(hop, on, "left").select(
            "pack_id", "part", "win",
            F.coalesce("to_part", "at_part").alias("at_part"), F.coalesce("to_win", "at_win").alias("at_win"),
            F.when(F.col("to_part").isNotNull(), F.lit(round_no)).otherwise(F.col("round")).alias("round"),
        )
        level = step.where("still_open").select("pack_id", F.col("to_part").alias("part"), F.col("to_win").alias("win"), F.col("to_used").alias("used")).distinct()
        groups = 0 if last else groups_next
    items = placed.where("used is null").join(moved, ["pack_id", "part", "win"], "left")
    name = F.concat_ws("-", F.coalesce("round", F.lit(0)), F.coalesce("at_part", "part"), F.coalesce("at_win", "win"))
    return items.select("pack_id", name.alias("container"), "doc_id", "piece", "first_token", "n_tokens")


def fill_report(packed_rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Containers, tokens, least possible containers and share of used space of every pack."""
    boxes = packed_rows.groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    per_pack = boxes.groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    caps = F.broadcast(limits.select("pack_id", "capacity_tokens").distinct())  # a fixed list
    return per_pack.join(caps, "pack_id").select(
        "pack_id", "capacity_tokens", "containers", "items", "tokens", "fullest",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("fill"),
    )
