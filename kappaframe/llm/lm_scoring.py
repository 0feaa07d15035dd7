"""Cross-entropy difference of two matched bigram models.

A target model is counted on chosen documents and a background model on all of them, over one vocabulary (the words
that the corpus has twice or more; others are one unknown word) and with the same smoothing. The loss difference of a
token is -log P_target(w | u) + log P_background(w | u); its mean over a document is the document's score, low for
documents like the target.

Words and bigrams grow with the corpus and never meet in one place: tasks pack the documents they read into chunks of
word numbers, a chunk sends its distinct words with counts to ranges of word hashes, a range adds the counts of all
chunks and answers every chunk with the sums, in the order sent. Bigrams of known words then go the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaframe.llm.words import Block, arrow_rows, as_bytes, cut, expanded, mixed
from kappaframe.session import written

SEEN = 2  # a word that the corpus has less often is unknown
CHUNK_BYTES = 6 << 20
PRIOR = 16.0
BROADCAST_IDS = 1 << 20  # ids of the target documents are sent whole up to this count (8 MB), and joined by a shuffle beyond
SENT = "chunk long, range long, names binary, bg binary, tg binary"


def _packed(x: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers in few bytes: all lowest bytes, then all second ones and so on; steps only of a `rising` row."""
    x = np.ascontiguousarray(x if x.dtype == np.uint64 else x.astype(np.int64)).view(np.uint64)
    if rising:
        x = np.diff(x, prepend=np.uint64(0))
    data = x.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unpacked(value: bytes, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(expanded(value), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum(x, dtype=np.uint64) if rising else x.view(np.int64)


def _chunked(size: int):
    """Rows of a task in chunks of about `size` bytes of text; words stand in order of hash and are numbered by count."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        first, chunks, total = TaskContext.get().partitionId() << 32, 0, 0

        def row():
            ids = pa.concat_arrays([x[0] for x in held])
            flags, lengths, words = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            h, tokens, n = np.unique(words, return_inverse=True, return_counts=True)
            t = np.bincount(tokens, weights=np.repeat(flags, lengths), minlength=len(h)).astype(np.int64)
            common = np.argsort(-n, kind="stable")
            number = np.empty(len(h), np.int64)
            number[common] = np.arange(len(h))
            blobs = [_packed(flags), _packed(lengths), _packed(number[tokens]), _packed(number), _packed(h, True), _packed(n), _packed(t)]
            names = ["chunk", "ids", "flags", "lengths", "tokens", "number", "words", "bg", "tg", "n_docs", "n_bg", "n_tg"]
            return pa.RecordBatch.from_arrays(
                [pa.array([first + chunks]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([b], pa.binary()) for b in blobs],
                 *[pa.array([int(x)], pa.int64()) for x in (len(ids), n.sum(), t.sum())]], names=names)

        for batch in batches:
            flags = batch.column("target").to_numpy(zero_copy_only=False)
            for _, texts, part in cut(pa.nulls(batch.num_rows, pa.int64()), batch.column("_text")):
                block = Block(np.arange(len(texts)), texts)
                held.append((batch.column("doc_id").slice(part.start, len(texts)), flags[part], block.lengths, block.words))
                total += len(block.data)
                if total >= size:
                    yield row()
                    held, total = [], 0
                    chunks += 1
        if held:
            yield row()

    return task


def _dealt(names: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rising `names` by their range, and the ranges in that order."""
    to = (mixed(names) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, to[order]


def _sent(chunk: int, names: np.ndarray, bg: np.ndarray, tg: np.ndarray, ranges: int) -> dict[str, pa.Array]:
    order, to = _dealt(names, ranges)
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, np.int64)
    parts = np.split(order, first[1:]) if len(to) else []
    blobs = {c: pa.array([_packed(x[p], c == "names") for p in parts], pa.binary()) for c, x in (("names", names), ("bg", bg), ("tg", tg))}
    return {"chunk": pa.array([chunk] * len(parts), pa.int64()), "range": pa.array(to[first], pa.int64()), **blobs}


def _words_sent(ranges: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pydict(_sent(r["chunk"], _unpacked(r["words"], True), _unpacked(r["bg"]), _unpacked(r["tg"]), ranges))

    return task


def _answered(of_words: bool):
    """A range adds the counts of all chunks and answers each with what the others have, in the order sent; mostly 0 for
    bigrams. For words it also answers their place among the range's known words, from 1 (0 is unknown), and lists these
    under chunk -1."""

    def task(group: pa.Table) -> pa.Table:
        sent = [_unpacked(x, True) for x in group.column("names").to_pylist()]
        ends = np.cumsum([len(x) for x in sent])[:-1]
        known, which = np.unique(np.concatenate(sent), return_inverse=True)
        out, sums = {}, []
        for c in ("bg", "tg"):
            own = np.concatenate([_unpacked(x) for x in group.column(c).to_pylist()])
            # sums of whole numbers in doubles are exact up to 2^53
            sums.append(np.bincount(which, weights=own, minlength=len(known)).astype(np.int64))
            out[c] = [_packed(x) for x in np.split(sums[-1][which] - own, ends)]
        chunk, of = group.column("chunk").to_pylist(), group.column("range").to_pylist()
        out["names"] = [None] * len(chunk)
        if of_words:
            often = sums[0] >= SEEN
            place = np.where(often, np.cumsum(often), 0)[which]
            out["names"] = [_packed(x) for x in np.split(place, ends)] + [_packed(known[often], True)]
            for c, x in zip(("bg", "tg"), sums, strict=True):
                out[c].append(_packed(x[often]))
            chunk, of = [*chunk, -1], [*of, of[0]]
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "range": pa.array(of, pa.int64()), **{c: pa.array(out[c], pa.binary()) for c in ("names", "bg", "tg")}})

    return task


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            h, bg, tg = _unpacked(r["names"], True).view(np.int64), _unpacked(r["bg"]), _unpacked(r["tg"])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(bg), pa.array(tg)], names=["h", "bg", "tg"])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            bg, tg = _unpacked(r["bg"]), _unpacked(r["tg"])
            sizes = (r["range"], len(bg), bg.sum(), tg.sum())
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in sizes], names=["range", "v", "bg", "tg"])


@dataclass(frozen=True)
class Models:
    """What both models share: the least known word by count and then hash, the number of known words, and for
    background and target the counts of all tokens, of known ones and of documents."""

    ranges: int
    before: np.ndarray  # known words of the ranges before each, and of all
    edge: tuple[int, int]
    v: int
    totals: tuple[int, int]
    known: tuple[int, int]
    docs: tuple[int, int]


class Chunk:
    """A chunk with the counts of its words. Places after its words: the unknown word and the start of a document."""

    def __init__(self, models: Models, row: dict, answers: pa.Table):
        self.models = models
        self.lengths, number = _unpacked(row["lengths"]), _unpacked(row["number"])
        words = _unpacked(row["words"], True)
        n = len(words)
        at = np.empty(n, np.int64)
        at[number] = np.arange(n)
        tokens = at[_unpacked(row["tokens"])]
        flags = np.repeat(_unpacked(row["flags"]), self.lengths)
        order, to = _dealt(words, models.ranges)
        bg, tg, place = _received(order, answers, ("bg", "tg", "names"))
        bg, tg = bg + np.bincount(tokens, minlength=n), tg + np.bincount(tokens, weights=flags, minlength=n).astype(np.int64)
        least, last = models.edge
        keep = (bg > least) | ((bg == least) & (words.view(np.int64) <= last))
        # numbers in the whole vocabulary; 0 is the unknown word, 1 the start of a document
        start = np.zeros(n, np.int64)
        start[order] = models.before[to]
        whole = np.concatenate([start + place + 1, [0, 1]])
        ids = np.where(keep, np.arange(n), n)[tokens]
        before = np.concatenate([[n + 1], ids[:-1]]) if len(ids) else ids
        before[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = n + 1
        names = whole[before].astype(np.uint64) * np.uint64(models.before[-1] + 2) + whole[ids].astype(np.uint64)
        self.names, first, self.which, self.times = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        self.hits = np.bincount(self.which, weights=flags, minlength=len(first)).astype(np.int64)
        self.u, self.w = before[first], ids[first]
        self.context = [np.concatenate([c, [total - k, d]]).astype(np.float64) for c, total, k, d in zip((bg, tg), models.totals, models.known, models.docs, strict=True)]

    def differences(self, bg: np.ndarray, tg: np.ndarray) -> np.ndarray:
        """Loss difference of every bigram, by its counts in the other chunks."""
        m = self.models
        loss = []
        for n, c, total in zip((bg + self.times, tg + self.hits), self.context, m.totals, strict=True):
            plain = (c[self.w] + 0.5) / (total + 0.5 * (m.v + 1))
            loss.append(-np.log((n + PRIOR * plain) / (c[self.u] + PRIOR)))
        return loss[1] - loss[0]


def _received(order: np.ndarray, answers: pa.Table, columns: tuple[str, ...]) -> list[np.ndarray]:
    """Columns of the answers of all ranges, put back by the order that names were sent in."""
    turn = np.argsort(answers.column("range").to_numpy())
    out = []
    for c in columns:
        blobs = answers.column(c).to_pylist()
        values = np.zeros(len(order), np.int64)
        if len(turn):
            values[order] = np.concatenate([_unpacked(blobs[i]) for i in turn])
        out.append(values)
    return out


def _bigrams_sent(models: Models):
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk = Chunk(models, row, right)
        return pa.table(_sent(row["chunk"], chunk.names, chunk.times, chunk.hits, models.ranges))

    return task


def _scored(models: Models):
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        words = right.column("of_words").to_numpy(zero_copy_only=False).astype(bool)
        row = left.to_pylist()[0]
        chunk = Chunk(models, row, right.filter(pa.array(words)))
        loss = chunk.differences(*_received(_dealt(chunk.names, models.ranges)[0], right.filter(pa.array(~words)), ("bg", "tg")))
        n = chunk.lengths
        total = np.bincount(np.repeat(np.arange(len(n)), n), weights=loss[chunk.which], minlength=len(n))
        score = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "score": pa.array(score)})

    return task


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, vocabulary: int | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """`(doc_id, n_tokens, score)`, a row for each row of `docs`; score is the mean loss difference over its tokens.

    Words seen SEEN times or more are known, however many they are; a `vocabulary` asks for the commonest of them only.
    `target_ids` has a column `id_column` with the target's documents; ids that repeat count once and null ids choose
    nothing. Words are cut at ASCII white space. A null or empty text has no token and score 0; long texts are scored
    whole; repeated rows count and are scored each; without a target both models differ by smoothing only. An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ids = written(target_ids.select(F.col(f"`{id_column}`").cast("long").alias("_id")).where("_id IS NOT NULL").distinct(), "target")
    flagged = ids.withColumn("_hit", F.lit(1.0))
    n_ids = ids.count()
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), as_bytes(text_column).alias("_text"))
    rows = rows.join(F.broadcast(flagged) if n_ids <= BROADCAST_IDS else flagged, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", F.coalesce("_hit", F.lit(0.0)).alias("target"), "_text"
    )
    blobs = ", ".join(f"{c} binary" for c in ("flags", "lengths", "tokens", "number", "words", "bg", "tg"))
    # chunks are numbered by task, so they are written once and read by all that follows
    chunks = written(rows.mapInArrow(_chunked(CHUNK_BYTES), f"chunk long, ids array<long>, {blobs}, n_docs long, n_bg long, n_tg long"), "chunks")
    n_docs, *totals = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_docs", "n_bg", "n_tg")]).first()
    ranges = max(1, math.ceil(totals[0] * 6 / CHUNK_BYTES))
    with arrow_rows(spark, 1):  # a chunk at a time
        told = written(
            chunks.select("chunk", "words", "bg", "tg").mapInArrow(_words_sent(ranges), SENT)
            .groupBy("range").applyInArrow(_answered(True), SENT), "words",
        )
    often = told.where("chunk = -1")
    sizes = often.select("range", "bg", "tg").mapInArrow(_measured, "range long, v long, bg long, tg long").collect()  # one row per range
    v = np.zeros(ranges + 1, np.int64)
    v[[r["range"] + 1 for r in sizes]] = [r["v"] for r in sizes]
    edge, known = (SEEN, (1 << 63) - 1), [sum(r[c] for r in sizes) for c in ("v", "bg", "tg")]
    if vocabulary is not None:
        top = written(often.select("names", "bg", "tg").mapInArrow(_opened, "h long, bg long, tg long").orderBy(F.desc("bg"), "h").limit(vocabulary), "top")
        known = top.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("bg", "tg")]).first()
        last = top.orderBy("bg", F.desc("h")).first()
        edge = (last["bg"], last["h"]) if last else ((1 << 63) - 1, 0)
    models = Models(ranges, np.cumsum(v), edge, known[0], tuple(totals), (known[1], known[2]), (n_docs, n_ids))
    texts = chunks.select("chunk", "ids", "flags", "lengths", "tokens", "number", "words")
    words = told.where("chunk >= 0")
    # the same columns as below, so that Spark shuffles the texts once for both
    sent = texts.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_bigrams_sent(models), SENT)
    bigrams = sent.groupBy("range").applyInArrow(_answered(False), SENT)
    both = words.withColumn("of_words", F.lit(True)).unionByName(bigrams.withColumn("of_words", F.lit(False)))
    return texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_scored(models), "doc_id long, n_tokens long, score double")
