"""Corpus jobs on words: spelling correction and language probability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from kappaframe.session import cut_lineage, fresh, shuffle_width, small_batches, spread

WORD = "\\p{L}+"
PIECES = "\\p{L}+|[^\\p{L}]+"
EDITS = 2


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """`(word, n)` over the whole corpus."""
    words = spread(df.select(text)).select(F.explode(words_of(F.col(text))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _cut(third: str, ahead: int = 0) -> Column:
    """Start of a third of a word of length `len`."""
    return F.floor((F.col(third) + ahead) * F.col("len") / F.lit(EDITS + 1)).cast("int")


def spelling_corrections(counts: DataFrame, rare: int = 1, frequent: int = 20) -> DataFrame:
    """`(word, correction, distance)`: the frequent word within two edits of each rare word.

    The nearest wins, then the more frequent, then the first in word order. Of two words within two edits,
    one of the three thirds of the frequent word is found unchanged in the rare one, shifted by at most two
    places. Thirds are joined on (length, third, text), which is complete for words of every length and never
    compares the two vocabularies pair by pair.
    """
    counts = cut_lineage(counts)
    third = F.explode(F.array(*[F.lit(i) for i in range(EDITS + 1)])).alias("third")
    known = cut_lineage(
        counts.where(F.col("n") >= frequent)
        .select(F.col("word").alias("correction"), F.col("n").alias("freq"), F.length("word").alias("len"), third)
        .withColumn("part", F.substring("correction", _cut("third") + 1, _cut("third", 1) - _cut("third")))
    )
    odd = counts.where(F.col("n") <= rare).select("word", F.length("word").alias("own_len"))
    # few bytes become much work: spread the words over all tasks first
    odd = odd.repartition(shuffle_width(counts.sparkSession), "word")
    lengths = F.sequence(F.greatest(F.col("own_len") - EDITS, F.lit(1)), F.col("own_len") + EDITS)
    odd = odd.select("word", "own_len", F.explode(lengths).alias("len"))
    odd = odd.select("*", third)
    shift = F.explode(F.array(*[F.lit(i) for i in range(-EDITS, EDITS + 1)])).alias("shift")
    odd = odd.select("*", shift)
    odd = odd.withColumns({"at": _cut("third") + F.col("shift"), "size": _cut("third", 1) - _cut("third")})
    # a third matches at a shift its neighbours' edits can cause, seen from the left and from the right end
    ahead = F.col("own_len") - F.col("len")
    odd = odd.where(
        (F.abs("shift") <= F.col("third"))
        & (F.abs(F.col("shift") - ahead) <= EDITS - F.col("third"))
        & (F.col("at") >= 0)
        & (F.col("at") + F.col("size") <= F.col("own_len"))
    )
    odd = odd.select("word", "len", "third", F.substring("word", F.col("at") + 1, F.col("size")).alias("part"))
    pairs = odd.join(known, ["len", "third", "part"])
    distance = F.levenshtein("word", "correction", EDITS)
    close = pairs.withColumn("distance", distance).where(F.col("distance").between(1, EDITS))
    best = F.min(F.struct(F.col("distance"), (-F.col("freq")).alias("f"), F.col("correction").alias("w")))
    return close.groupBy("word").agg(best.alias("b")).select(
        "word", F.col("b.w").alias("correction"), F.col("b.distance").alias("distance")
    )


def _placed_words(rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """`(id, pos, word, raised)`: every word of a text, its place among the text's pieces, and whether it begins with a capital."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(PIECES), F.lit(0))
    words = rows.select(F.col(id_column).alias("id"), F.posexplode(pieces).alias("pos", "piece")).where(F.col("piece").rlike("^\\p{L}"))
    raised = (F.substring("piece", 1, 1) != F.substring(F.lower("piece"), 1, 1)).cast("int")
    return words.select("id", "pos", F.lower("piece").alias("word"), raised.alias("raised"))


def correct_spelling(df: DataFrame, id_column: str, text: str, rare: int = 1, frequent: int = 20) -> DataFrame:
    """Adds `corrected`: the whole text with rare words replaced, everything else left as it is.

    A word that occurs once carries its place along with its count, so the words of the texts are never joined again; only
    with `rare` above 1 are further occurrences looked up. Corrected places meet the texts by id: a text is cut into words
    and what lies between, and put together again from the stretches between its corrected places. A capital at the start
    of a word stays.
    """
    rows = spread(df)
    words = _placed_words(rows, id_column, text)
    first = [F.min(c).alias(c) for c in ("id", "pos", "raised")]
    counts = cut_lineage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *first))
    fixes = cut_lineage(spelling_corrections(counts.select("word", "n"), rare, frequent).select("word", "correction"))
    found = counts.where("n = 1").drop("n").join(fixes, "word")
    if rare > 1:
        several = fresh(counts).where(f"n BETWEEN 2 AND {int(rare)}").join(fixes, "word", "left_semi").select("word")
        found = found.unionByName(words.join(several, "word", "left_semi").join(fresh(fixes), "word"), allowMissingColumns=False)
    upper = F.concat(F.upper(F.substring("correction", 1, 1)), F.substring(F.col("correction"), F.lit(2), F.length("correction")))
    fix = F.when(F.col("raised") == 1, upper).otherwise(F.col("correction"))
    places = found.groupBy(F.col("id").alias(id_column)).agg(F.sort_array(F.collect_list(F.struct("pos", fix.alias("fix")))).alias("_at"))
    pieces = F.regexp_extract_all(F.col(text), F.lit(PIECES), F.lit(0))
    joined = rows.join(places, id_column, "left").withColumn("_pieces", F.when(F.col("_at").isNotNull(), pieces))

    def stretch(i: Column) -> Column:
        """What lies between the corrected places i-1 and i, and the correction at i."""
        start = F.when(i > 0, F.get("_at", i - 1)["pos"] + 1).otherwise(0)
        end = F.coalesce(F.get("_at", i)["pos"], F.size("_pieces"))
        kept = F.array_join(F.slice("_pieces", start + 1, end - start), "")
        return F.concat(kept, F.coalesce(F.get("_at", i)["fix"], F.lit("")))

    rebuilt = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_at")), stretch), "")
    return joined.withColumn("corrected", F.when(F.col("_at").isNull(), F.col(text)).otherwise(rebuilt)).drop(
        "_at", "_pieces"
    )


HELD = 1 << 20  # weights that a task holds at most, one per language and triple; rarer triples are joined
_PIECE = 1 << 20  # characters of a text that are looked at together


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+", " ")


def _added(triples: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of some triples, ascending, and the sums of their counts."""
    if len(triples) == 1:
        return triples[0], counts[0]
    every, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (triples, counts))
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
    return every[first], np.add.reduceat(n, first) if len(first) else n


def _triples(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct overlapping character triples of a text, ascending, three code points in one number, and their counts."""
    found, counts = [], []
    for at in range(0, max(len(text) - 2, 0), _PIECE):
        points = np.frombuffer(text[at : at + _PIECE + 2].encode("utf-32-le"), np.uint32)
        seen = np.zeros(int(points.max()) + 1, dtype=bool)
        seen[points] = True
        letters = np.flatnonzero(seen)
        place = (np.cumsum(seen) - 1)[points]
        k = len(letters)
        spots = (place[:-2] * k + place[1:-1]) * k + place[2:]
        if k**3 <= 8 * len(points):  # a table of all triples of the letters at hand is quicker than sorting
            table = np.bincount(spots, minlength=k**3)
            kinds = np.flatnonzero(table)
            n = table[kinds]
        else:
            kinds, n = np.unique(spots, return_counts=True)
        found.append((letters[kinds // (k * k)] << 42) | (letters[kinds // k % k] << 21) | letters[kinds % k])
        counts.append(n)
    return _added(found, counts)


def language_profiles(df: DataFrame, text: str, language: str) -> DataFrame:
    """`(language, triple, n)` over all texts, those without a language under null. Every batch is added up in its task."""
    rows = spread(df.select(F.col(language).cast("string").alias("language"), _letters(F.col(text)).alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str | None, list] = {}
            for name, value in zip(batch.column("language").to_pylist(), batch.column("text"), strict=True):
                held.setdefault(name, []).append(_triples(value.as_py()))
            for name, parts in held.items():
                triples, n = _added(*map(list, zip(*parts, strict=True)))
                columns = [pa.array([name] * len(n), pa.string()), pa.array(triples), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["language", "triple", "n"])

    parts = rows.mapInArrow(count, "language string, triple bigint, n bigint")
    return parts.groupBy("language", "triple").agg(F.sum("n").alias("n"))


def _gains(triples: np.ndarray, weights: np.ndarray, whole: bool):
    """Texts to `(total, gains, rest)`: how many triples, the summed weights per language (the columns of `weights`) of
    those in `triples` (ascending), and, unless these are the `whole` profile, the others with their counts."""
    kind = "struct<total:bigint, gains:array<double>, rest:array<struct<triple:bigint, times:bigint>>>"

    @arrow_udf(kind)
    def gained(texts: pa.Array) -> pa.Array:
        total, gains, rest = [], [], []
        for value in texts:
            found, n = _triples(value.as_py())
            at = np.searchsorted(triples, found)
            known = at < len(triples)
            known[known] = triples[at[known]] == found[known]
            total.append(int(n.sum()))
            gains.append(n[known] @ weights[at[known]])
            rest.append([] if whole else [{"triple": int(t), "times": int(k)} for t, k in zip(found[~known], n[~known], strict=True)])
        pair = pa.struct([("triple", pa.int64()), ("times", pa.int64())])
        columns = [pa.array(total, pa.int64()), pa.array(gains, pa.list_(pa.float64())), pa.array(rest, pa.list_(pair))]
        return pa.StructArray.from_arrays(columns, names=["total", "gains", "rest"])

    return gained


def language_probability(
    df: DataFrame, id_column: str, text: str, language: str, target: str = "en", held: int = HELD
) -> DataFrame:
    """`(id, probability)` that each text is in `target`: naive Bayes over character triples with equal priors and
    add-one counts, trained on the labelled texts themselves; 0 for a text without a triple of letters or spaces.

    Weights of the commonest triples, `held` in all, travel with the function, and a text is scored by them inside its
    row. Where the profile has more triples, the rarer ones leave their texts and are joined with it.
    """
    small_batches(df.sparkSession)
    profile = cut_lineage(language_profiles(df, text, language))
    known = profile.where("language IS NOT NULL")
    kinds = profile.agg(F.countDistinct("triple")).first()[0]
    # one row per language of the label set
    totals = {r["language"]: r["total"] for r in known.groupBy("language").agg(F.sum("n").alias("total")).collect()}
    names = sorted(totals)
    if target not in names:
        return df.select(id_column, F.lit(0.0).alias("probability"))
    sums = known.groupBy("triple").agg(F.sum("n").alias("n"))
    room = max(1, held // len(names))
    whole = sums.count() <= room
    common = known if whole else known.join(
        cut_lineage(sums.orderBy(F.desc("n"), "triple").limit(room).select("triple")), "triple", "left_semi"
    )
    table = common.toArrow()  # at most `held` rows, or one per language
    triples, row = np.unique(table.column("triple").to_numpy(), return_inverse=True)
    weights = np.zeros((len(triples), len(names)))
    weights[row, np.searchsorted(np.array(names), np.array(table.column("language").to_pylist()))] = np.log(table.column("n").to_numpy() + 1)
    gained = _gains(triples, weights, whole)(_letters(F.col(text)))
    scored = spread(df.select(id_column, text)).select(id_column, gained.alias("_g")).select(id_column, "_g.*")
    gains = F.col("gains")
    if not whole:
        scored = cut_lineage(scored.withColumn("_row", F.monotonically_increasing_id()))
        others = scored.select("_row", F.explode("rest").alias("_r")).select("_row", "_r.*").join(known, "triple")
        extra = others.groupBy("_row", "language").agg(F.sum(F.col("times") * F.log(F.col("n") + 1.0)).alias("gain"))
        extra = extra.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("language", "gain"))).alias("_more"))
        scored = scored.join(extra, "_row", "left")
        own = F.array(*[F.lit(name) for name in names])
        gains = F.zip_with("gains", own, lambda g, name: g + F.coalesce(F.col("_more")[name], F.lit(0.0)))
    norms = F.array(*[F.lit(float(np.log(totals[name] + kinds))) for name in names])
    scores = F.zip_with(gains, norms, lambda g, norm: g - F.col("total") * norm)
    wanted = F.get("_s", names.index(target))
    share = F.lit(1.0) / F.aggregate("_s", F.lit(0.0), lambda whole, score: whole + F.exp(score - wanted))
    return scored.withColumn("_s", scores).select(id_column, F.when(F.col("total") > 0, share).otherwise(0.0).alias("probability"))
