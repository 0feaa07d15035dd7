"""Words of whole texts as 64-bit hashes, in numpy blocks inside tasks.

A word is a maximal run of bytes other than space and the control characters 9 to 13. UTF-8 never uses these
bytes inside a character, so texts are handled as bytes throughout. Hashes are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from kappaframe.session import small_batches  # noqa: F401 - queries on texts take it from here

WHITESPACE = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WHITESPACE)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)


def as_bytes(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string").cast("binary"), F.lit("").cast("binary"))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every input bit over all output bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(max(n, 1), base, dtype=np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    letters = data[inside].astype(np.uint64) + np.uint64(1)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    h = np.add.reduceat(letters * powers(_BASE, int(lengths.max()))[place], first)
    return mixed(h), starts, ends


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, worked out in pieces so that memory stays small beside `data`."""
    raw = np.frombuffer(data, dtype=np.uint8)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK_BYTES)
        while end < len(raw) and not _SPACE[raw[end - 1]]:
            gap = np.flatnonzero(_SPACE[raw[end : end + BLOCK_BYTES]])
            end = end + int(gap[0]) + 1 if len(gap) else min(len(raw), end + BLOCK_BYTES)
        h, s, e = _hash_piece(raw[at:end])
        out.append((h, s + at, e + at))
        at = end
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of `k` consecutive entries; `len(words) - k + 1` of them, or none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up = powers(_ROLL, len(words))
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * up)])
    inverse = np.uint64(pow(int(_ROLL), -1, 1 << 64))
    return mixed((total[k:] - total[:-k]) * powers(inverse, n) + np.uint64(k))


class Block:
    """Some whole documents: their ids, the words of all of them in a row, and where each one's words begin."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        data = b" ".join(texts)
        self.words, self.starts, self.ends = word_hashes(data)
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        first_bytes = np.concatenate([[0], np.cumsum(sizes)])
        self.offsets = np.searchsorted(self.starts, first_bytes)
        self.offsets[-1] = len(self.words)
        self.data = data

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def cut(ids: pa.Array, texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, list[bytes], slice]]:
    """A record batch in parts of about `size` bytes of text; a longer text is a part of its own."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1 + texts.offset)[texts.offset :])
    names = ids.to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        end, total = at + 1, int(sizes[at])
        while end < len(texts) and total + sizes[end] <= size:
            total += int(sizes[end])
            end += 1
        yield names[at:end], texts.slice(at, end - at).to_pylist(), slice(at, end)
        at = end


def blocks(batch: pa.RecordBatch, id_column: str, text_column: str, lower: bool = False) -> Iterator[Block]:
    for ids, texts, _ in cut(batch.column(id_column), batch.column(text_column)):
        yield Block(ids, [t.lower() for t in texts] if lower else texts)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows of an Arrow batch while texts or sets are heavy: what a task holds at once stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def squeezed(text: Column) -> Column:
    """Bytes made small for a shuffle, with their length in front; `expanded` gives them back."""

    @arrow_udf("binary")
    def squeeze(values: pa.Array) -> pa.Array:
        codec = pa.Codec("zstd", 1)
        return pa.array([len(v).to_bytes(8, "little") + codec.compress(v, asbytes=True) for v in values.to_pylist()], pa.binary())

    return squeeze(text)


def expanded(value: bytes) -> bytes:
    return pa.Codec("zstd").decompress(value[8:], int.from_bytes(value[:8], "little"), asbytes=True)


LAST_ID = (1 << 63) - 1


def keyed(docs, id_column: str = "doc_id", text_column: str = "text"):
    """`(doc_id, _id, _t, _text)`: the id as given, an id to compare by (null comes after all others), a hash of the
    text and its bytes (null is empty). Rows that repeat are told apart by nothing and so are treated alike."""
    given = F.col(f"`{id_column}`").cast("long")
    text = as_bytes(text_column)
    return docs.select(
        given.alias("doc_id"), F.coalesce(given, F.lit(LAST_ID)).alias("_id"), F.xxhash64(text).alias("_t"),
        text.alias("_text"),
    )
