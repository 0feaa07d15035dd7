"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words whose log-odds between toxic and clean labelled documents are surely above zero. A text
becomes a row of densities (lexicon words as written and with letters put back, second-person words near them, capitals,
punctuation, obfuscated words); trees are grown on one part of the labelled rows and calibrated on the other. Labels
are the only thing read beside the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from kappaframe.llm.words import as_bytes, word_hashes

TRAIN_ROWS = 20_000  # labelled rows that lexicon, trees and calibration are fitted on, at most
LEXICON_WORDS = 256
PART = 512 * 1024

# Second-person words of the languages at hand
SECOND_PERSON = "you your yours yourself ur du dich dir dein deine euch euer tu te toi ton tes vous votre vos usted ti tus tuyo".split()
# Characters that stand in for letters
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": ""}

_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PLAIN = bytes(32 if b in _MARKS else _LOWER[b] for b in range(256))
_LETTERS = {ord(a): ord(b) for a, b in STAND_INS.items() if b}
_RESTORED = bytes(_LETTERS.get(b, _PLAIN[b] if b not in b"*_" else b) for b in range(256))
_CLASS = np.zeros(256, dtype=np.int8)  # 1 capital, 2 small letter or part of a letter beyond ASCII, 3 digit, 4 mark
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[48:58] = 3
_CLASS[list(_MARKS)] = 4
N_FEATURES = 16


def lexicon_hashes(words: list[str]) -> np.ndarray:
    return np.sort(word_hashes(" ".join(words).encode())[0]) if words else np.empty(0, np.uint64)


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(h):
        return np.zeros(len(h), dtype=bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def text_features(texts: list[bytes], lexicon: np.ndarray, persons: np.ndarray) -> np.ndarray:
    """N_FEATURES numbers per text; an empty text has zeros."""
    n = len(texts)
    joined = b" ".join(texts) + b" "
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    raw = np.frombuffer(joined, dtype=np.uint8)
    out = np.zeros((n, N_FEATURES))

    def per_text(places: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        of = np.searchsorted(bounds, places, "right") - 1
        return np.bincount(of, weights=weight, minlength=n)[:n]

    h, starts, _ = word_hashes(joined.translate(_PLAIN))
    words = np.maximum(per_text(starts), 1)
    hit = _member(h, lexicon)
    hits = per_text(starts[hit])
    at, you = np.flatnonzero(hit), np.flatnonzero(_member(h, persons))
    out[:, 0], out[:, 1] = hits / words, np.log1p(hits)
    out[:, 2] = per_text(starts[you]) / words
    if len(at):
        of_hit = np.searchsorted(bounds, starts[at], "right") - 1
        if len(you):
            of_you = np.searchsorted(bounds, starts[you], "right") - 1
            gap = np.full(len(at), 1e9)
            for side in (-1, 0):
                j = np.clip(np.searchsorted(you, at) + side, 0, len(you) - 1)
                gap = np.minimum(gap, np.where(of_you[j] == of_hit, np.abs(you[j] - at), 1e9))
            out[:, 3] = np.bincount(of_hit, weights=1 / (1 + gap), minlength=n) / np.maximum(hits, 1)
            out[:, 4] = np.bincount(of_hit, weights=gap <= 6, minlength=n)
        if len(at) > 1:
            same = of_hit[1:] == of_hit[:-1]
            out[:, 5] = np.bincount(of_hit[1:][same], weights=1 / np.diff(at)[same], minlength=n)
        distinct = np.unique(np.stack([of_hit.astype(np.uint64), h[at]]), axis=1)[0].astype(np.int64)
        out[:, 6] = np.bincount(distinct, minlength=n)
    restored, r_starts, _ = word_hashes(joined.translate(_RESTORED, b"*_"))
    if len(restored):
        shift = bounds if not any(c in joined for c in (b"*", b"_")) else np.concatenate(
            [[0], np.cumsum([len(t) + 1 - t.count(b"*") - t.count(b"_") for t in texts])])
        of = np.searchsorted(shift, r_starts[_member(restored, lexicon)], "right") - 1
        out[:, 7] = np.maximum(np.bincount(of, minlength=n)[:n] - hits, 0)
    kind = _CLASS[raw]
    cum = lambda flag: np.add.reduceat(flag, bounds[:-1], dtype=np.int64)
    letters = np.maximum(cum((kind == 1) | (kind == 2)), 1)
    length = np.maximum(np.diff(bounds) - 1, 1)
    out[:, 8] = cum(kind == 1) / letters
    caps_pair = np.concatenate([(kind[1:] == 1) & (kind[:-1] == 1), [False]])
    out[:, 9] = cum(caps_pair) / letters
    out[:, 10] = cum(kind == 4) / length
    out[:, 11] = cum((raw == 33) | (raw == 63)) / length
    out[:, 12] = cum(np.concatenate([(kind[1:] == 4) & (raw[1:] == raw[:-1]), [False]])) / length
    within = np.zeros(len(raw), dtype=bool)
    within[1:-1] = (kind[1:-1] >= 3) & ((kind[:-2] == 1) | (kind[:-2] == 2)) & ((kind[2:] == 1) | (kind[2:] == 2))
    out[:, 13] = cum(within) / words
    triple = np.zeros(len(raw), dtype=bool)
    triple[2:] = ((kind[2:] == 1) | (kind[2:] == 2)) & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])
    out[:, 14] = cum(triple) / words
    out[:, 15] = np.log1p(per_text(starts))
    return out


def features(text_column: str, lexicon: np.ndarray):
    persons = lexicon_hashes(SECOND_PERSON)

    @arrow_udf("array<double>")
    def computed(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        parts, at = [], 0
        while at < len(rows):
            end, size = at + 1, len(rows[at])
            while end < len(rows) and size + len(rows[end]) <= PART:
                size += len(rows[end])
                end += 1
            parts.append(text_features(rows[at:end], lexicon, persons))
            at = end
        flat = np.concatenate(parts).ravel() if parts else np.empty(0)
        offsets = np.arange(0, len(flat) + 1, N_FEATURES, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return computed.asNondeterministic()(as_bytes(text_column))


def learned_lexicon(labelled: DataFrame, z: float = 3.0, share: float = 0.5) -> list[str]:
    """Words of `(text, toxic)` rows whose log-odds of standing in a toxic text are `z` deviations above zero and which
    stand in toxic texts for a `share` of their texts at least; at most LEXICON_WORDS."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\s\p{Punct}]+"))
    counted = labelled.select("toxic", F.explode(words).alias("w")).where("length(w) > 1").groupBy("w").agg(
        F.sum("toxic").alias("a"), F.sum(F.lit(1) - F.col("toxic")).alias("b")
    )
    n = labelled.agg(F.sum("toxic").alias("t"), F.sum(F.lit(1) - F.col("toxic")).alias("c")).first()
    if not n.t or not n.c:
        return []
    odds = F.log((F.col("a") + 0.5) / (n.t - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n.c - F.col("b") + 0.5))
    scored = counted.where("a >= 3").where(F.col("a") >= share * (F.col("a") + F.col("b"))).withColumn(
        "z", odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    )
    return [r.w for r in scored.where(F.col("z") >= z).orderBy(F.desc("z"), "w").limit(LEXICON_WORDS).collect()]


class Model:
    """What `fit` learned; `rate` stands for every score where the labels hold one kind only."""

    def __init__(self, lexicon, trees, calibration, rate: float):
        self.lexicon, self.trees, self.calibration, self.rate = lexicon, trees, calibration, rate

    def score(self, docs: DataFrame, out: str = "score", text_column: str = "text") -> DataFrame:
        """`docs` with a score from 0 to 1. Null and empty texts are scored by their (zero) features; long texts whole;
        repeated rows alike. Columns named `_tox_*` are used on the way."""
        if self.trees is None:
            return docs.withColumn(out, F.lit(float(self.rate)))
        ready = docs.withColumn("_tox_f", array_to_vector(features(text_column, self.lexicon)))
        grown = self.trees.transform(ready)
        grown = grown.withColumn("_tox_p", vector_to_array("_tox_v")[1])
        level = self.calibration.transform(grown)
        # calibration has flat steps; a thousandth of the trees' own probability orders texts within a step
        value = F.least(F.greatest(F.col("_tox_i"), F.lit(0.0)), F.lit(1.0)) * 0.999 + F.col("_tox_p") * 0.001
        return level.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], value.alias(out))


def fit(
    docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 4,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
) -> Model:
    """Learns from at most `rows` labelled documents, drawn by a hash of the id; every fourth of them calibrates.

    Labels other than 0 and 1, labels without a document and null ids teach nothing. With one kind of label, or none,
    the model's score is that label's rate for all texts (0 without labels).
    """
    usable = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
    drawn = usable.groupBy(F.col(id_column).cast("long").alias("_id")).agg(F.max(label_column).cast("int").alias("toxic"))
    drawn = drawn.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    text = docs.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{text_column}`").alias("text"))
    # at most `rows` ids and labels, so the broadcast is bounded
    known = text.join(F.broadcast(drawn), "_id").withColumn("part", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(4)))
    known = known.persist()
    try:
        counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
        if counts.t in (0, counts.n):
            return Model(None, None, None, counts.t / counts.n if counts.n else 0.0)
        words = lexicon_hashes(learned_lexicon(known.where("part > 0")))
        # features in tasks of their own: a merged task would keep the Arrow buffers of all its parts until its end
        made = known.select("toxic", "part", features("text", words).alias("_tox_f")).persist()
        made.count()
        ready = made.select("toxic", "part", array_to_vector("_tox_f").alias("_tox_f"))
        ready = ready.withColumn("label", F.col("toxic").cast("double")).coalesce(4).persist()
        kinds = ready.where("part > 0").agg(F.countDistinct("label")).first()[0]
        grower = GBTClassifier(
            featuresCol="_tox_f", labelCol="label", predictionCol="_tox_y",
            maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, seed=7, minInstancesPerNode=8, maxBins=64,
        ).setProbabilityCol("_tox_v").setRawPredictionCol("_tox_r")
        grown = grower.fit(ready.where("part > 0") if kinds == 2 else ready)
        told = grown.transform(ready.where("part = 0")).select("label", vector_to_array("_tox_v")[1].alias("_tox_p"))
        if told.isEmpty():
            told = grown.transform(ready).select("label", vector_to_array("_tox_v")[1].alias("_tox_p"))
        level = IsotonicRegression(featuresCol="_tox_p", labelCol="label", predictionCol="_tox_i").fit(told)
        ready.unpersist()
        made.unpersist()
        return Model(words, grown, level, counts.t / counts.n)
    finally:
        known.unpersist()


