"""Sizes of texts in tokens of a public byte-level BPE tokenizer; the vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the published split pattern of this vocabulary (fixed value)
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(path: str = DEFAULT_VOCABULARY):
    """One encoder a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = DEFAULT_VOCABULARY) -> int:
    return len(encoding(path).encode_ordinary(text))


def sized(docs: DataFrame, keep: list[str], text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The kept columns plus n_tokens, for rows with a text (an empty one has 0 tokens; null rows are left out)."""
    rows = docs.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            *kept, texts = batch.columns
            sizes = pa.array([len(enc.encode_ordinary(t)) for t in texts.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*kept, sizes], names=[*(f.name for f in fields), "n_tokens"])

    return rows.mapInArrow(work, ddl)
