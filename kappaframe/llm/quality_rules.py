"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a text whose measure lies above a cutoff. Cutoffs are chosen per stratum on labelled good texts so that,
with confidence 1 - DELTA for all strata and rules together, no more than ALPHA of the good texts of a stratum are
rejected. For one rule and stratum the candidates are tested from the loosest to the strictest by the exact binomial tail
P(Bin(n, alpha) <= k), and testing ends at the first that fails (fixed-sequence testing needs no correction within the
sequence); alpha is shared among the rules, the error level among rules and strata (Bonferroni). A stratum with too few
good texts certifies nothing and rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kappaframe.session import written

ALPHA, DELTA = 0.02, 0.05

# What counts as a symbol, and white space
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

# measures and their candidate cutoffs, loosest first
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.19, 0.17, 0.15, 0.12, 0.1, 0.07, 0.05, 0.03]),
    "word_length": ("word_chars / greatest(n_words, 1)", [40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0]),
    "shouting": ("n_upper / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def _words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with the counts of MEASURES (existing columns of these names give way). Windows of five words that occur
    twice are found by sorting the text's own window hashes, so nothing is shuffled."""
    mine = [c for c in docs.columns if c not in MEASURES]
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    one = docs.select(*[F.col(f"`{c}`") for c in mine], text.alias("_q_t"), _words(text).alias("_q_w"))
    w = lambda i, k: F.get(F.col("_q_w"), i + k)
    window = F.when(
        F.size("_q_w") >= 5,
        F.transform(F.sequence(F.lit(0), F.size("_q_w") - 5), lambda i: F.xxhash64(*[w(i, k) for k in range(5)])),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_q_t", "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    drop = lambda chars: F.length("_q_t") - F.length(F.translate("_q_t", chars, ""))
    two = one.select(
        *[F.col(f"`{c}`") for c in mine], F.size("_q_w").cast("long").alias("n_words"),
        F.length(F.translate("_q_t", SPACES, "")).cast("long").alias("word_chars"), drop(SYMBOLS).cast("long").alias("n_symbols"),
        drop("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"), window.alias("_q_h"), lines.alias("_q_l"),
    )
    twice = F.size(F.array_distinct("_q_h")) < F.size("_q_h")
    three = two.select(
        "*", F.when(twice, F.array_sort(F.transform("_q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_q_s")
    )
    near = lambda i: F.get(F.col("_q_s"), i)["h"]
    before = lambda i: F.when(i > 0, near(i - 1))
    same = F.filter("_q_s", lambda x, i: x["h"].eqNullSafe(before(i)) | x["h"].eqNullSafe(near(i + 1)))
    four = three.select("*", F.array_sort(F.transform(same, lambda x: x["i"])).alias("_q_p"))
    covered = F.aggregate(
        F.transform("_q_p", lambda p, j: F.least(F.lit(5), F.coalesce(F.get(F.col("_q_p"), j + 1) - p, F.lit(5)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    n_lines = F.size("_q_l").cast("long")
    return four.select(
        *[F.col(f"`{c}`") for c in mine], "n_words", "word_chars", "n_symbols",
        (n_lines - F.size(F.array_distinct("_q_l"))).alias("n_dup_lines"), F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        n_lines.alias("n_lines"), "n_upper",
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact in double precision by summing in logarithms; 1 where k > p n, which never matters."""
    first = n * F.log(F.lit(1 - p))
    step = F.lit(p / (1 - p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * step)
        high = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(acc["sum"] - high) + F.exp(term - high))).alias("sum"))

    total = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("term"), first.alias("sum")), add, lambda acc: F.exp(acc["sum"]),
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """`(stratum, <rule>...)`: the certified cutoff of each rule, null where none is, from measured rows of good texts
    with a column `stratum`."""
    share = alpha / len(RULES)
    shown = good.select(
        "stratum", F.explode(F.array(*[
            F.struct(F.lit(name).alias("rule"), F.lit(float(c)).alias("cutoff"), F.lit(i).alias("turn"), (F.expr(m) > c).alias("hit"))
            for name, (m, grid) in RULES.items() for i, c in enumerate(grid)
        ])).alias("x"),
    )
    counted = shown.groupBy("stratum", "x.rule", "x.cutoff", "x.turn").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("x.hit").alias("k")
    )
    counted = written(counted, "counted")
    n_tests = counted.select("stratum", "rule").distinct().count()
    passed = (binomial_tail(F.col("n"), F.col("k"), share) <= delta / max(n_tests, 1)).cast("int")
    so_far = Window.partitionBy("stratum", "rule").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    certified = counted.withColumn("ok", F.min(passed).over(so_far)).where("ok = 1")
    return certified.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"_c_{name}") for name in RULES]
    )


def judged(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
) -> DataFrame:
    """`(doc_id, <MEASURES>, stratum, base_failed, kept)`, a row for each row of `docs`.

    `base_failed`: fewer than ten words, or more than a fifth of the words in repeated five-word windows. Labels 1 mark
    good texts; other or null labels, and labels without a text, are not used; the labels of an id that repeats count once.
    A null or empty text has no words; a null stratum is one of its own; long texts are measured whole; repeated rows are
    judged alike; without labels nothing but the base rule rejects. A value equal to its cutoff is kept. Every stratum has its
    own guarantee, however many there are. Other columns are not read.
    """
    ready = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("stratum"),
        F.col(f"`{text_column}`").alias("_q_text"),
    )
    rows = written(measured(ready, "_q_text").drop("_q_text"), "measured")
    marked = labels.where(F.col(label_column) == 1).select(F.col(id_column).cast("long").alias("doc_id")).distinct()
    failed = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
    good = rows.join(marked, "doc_id").where(f"NOT ({failed})")
    # a row per stratum, written, so that Spark knows its size when it joins
    told = rows.join(written(cutoffs(good, alpha, delta), "cutoffs"), "stratum", "left")
    above = [F.coalesce(F.expr(m) > F.col(f"_c_{name}"), F.lit(False)) for name, (m, _) in RULES.items()]
    rejects = above[0]
    for other in above[1:]:
        rejects = rejects | other
    return told.withColumn("base_failed", F.expr(failed)).select(
        "doc_id", *MEASURES, "stratum", "base_failed", (~F.col("base_failed") & ~rejects).alias("kept")
    )
