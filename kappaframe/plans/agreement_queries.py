"""Queries on rater agreement, selection of epochs, and uncertain rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kappaframe.constants import REGRADE_CODES
from kappaframe.functions import vectors as V
from kappaframe.functions.labels import canonical_label, reduce_by_evidence, reduce_by_text, round_half_even, row_mean
from kappaframe.functions.text import checkpoint_epoch, first_score, metric_parts, score_after_word
from kappaframe.operators import agreement as A
from kappaframe.operators import selection as S
from kappaframe.operators.tables import metrics_with_items
from kappaframe.plans import bindings as B
from kappaframe.plans.registry import Tables, query

METRICS = ("accuracy", "kappa", "quadratic_kappa")
ROUNDED = "ROUND(accuracy, 6) AS accuracy, ROUND(kappa, 6) AS kappa, ROUND(quadratic_kappa, 6) AS quadratic_kappa"
AVG = f"SELECT *, {B.MEAN} AS avg0, CAST(round_even({B.MEAN}, 0) AS INT) AS avg FROM ({B.PREDICTIONS_SQL})"


def averaged(t: Tables):
    """Predictions with the mean over epochs and its half-even rounding."""
    mean = row_mean([F.col(f"predict{e}") for e in B.EPOCHS])
    return B.predictions(t).withColumn("avg0", mean).withColumn("avg", round_half_even(F.col("avg0")))


_ITEM = B.agreement_sql(f"SELECT qid, label AS t, avg AS p, 1 AS n FROM ({AVG})", ["qid"])


@query("item_kappa", f"{_ITEM} SELECT qid, n, ROUND(quadratic_kappa, 6) AS quadratic_kappa, ROUND(accuracy, 6) AS accuracy FROM agr")
def item_kappa(t: Tables):
    cells = A.confusion_cells(averaged(t), ["qid"], "label", "avg")
    return B.six(A.agreement(cells, ["qid"]).drop("kappa"), "quadratic_kappa", "accuracy")


@query("item_kappa_unweighted", f"{_ITEM} SELECT qid, n, ROUND(kappa, 6) AS kappa FROM agr")
def item_kappa_unweighted(t: Tables):
    cells = A.confusion_cells(averaged(t), ["qid"], "label", "avg")
    return B.six(A.agreement(cells, ["qid"]).select("qid", "n", "kappa"), "kappa")


@query(
    "item_kappa_value_scale",
    f"""WITH r AS (SELECT qid, CASE WHEN label = 3 THEN 9 ELSE label END AS t, CASE WHEN avg = 3 THEN 9 ELSE avg END AS p
          FROM ({AVG}))
    SELECT qid, count(*) AS n,
      ROUND(1 - sum((t - p) * (t - p)) / (sum(t * t) + sum(p * p) - 2.0 * sum(t) * sum(p) / count(*)), 6) AS quadratic_kappa
    FROM r GROUP BY qid""",
)
def item_kappa_value_scale(t: Tables):
    """Weights on the label values, on a scale with a gap."""
    gap = lambda c: F.when(F.col(c) == 3, 9).otherwise(F.col(c))
    cells = A.confusion_cells(averaged(t), ["qid"], gap("label"), gap("avg"))
    return B.six(A.agreement(cells, ["qid"], scale="value").select("qid", "n", "quadratic_kappa"), "quadratic_kappa")


@query("item_accuracy", f"SELECT qid, ROUND(avg(CASE WHEN label = avg THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({AVG}) GROUP BY qid")
def item_accuracy(t: Tables):
    return averaged(t).groupBy("qid").agg(F.round(A.accuracy("label", "avg"), 6).alias("accuracy"))


_POOLED = f"""SELECT unnest(CASE WHEN qid LIKE '%2017%' OR qid LIKE '%2019%' THEN [qid, 'slope', 'ALL'] ELSE [qid, 'ALL'] END) AS qid,
  t, p, n FROM (SELECT {B.YEARLY_ITEM} AS qid, {B.LABEL} AS t, {B.predicted(5)} AS p, 1 AS n FROM orders)"""


@query("item_metrics_pooled", f"{B.agreement_sql(_POOLED, ['qid'])} SELECT qid, n, {ROUNDED} FROM agr")
def item_metrics_pooled(t: Tables):
    rows = B.derive(t.orders, [f"{B.YEARLY_ITEM} AS qid", f"{B.LABEL} AS label", f"{B.predicted(5)} AS predict"])
    cells = A.pool_items(A.confusion_cells(rows, ["qid"], "label", "predict"), "qid", {"slope": ["2017", "2019"]})
    return B.six(A.agreement(cells, ["qid"]), *METRICS)


REGIME = [
    "o_orderstatus AS qid",
    f"{B.DETAILED} AS label",
    f"{B.DETAILED_PREDICTED} AS predict",
    "1 + o_orderkey % 3 AS eval_label",
    "CAST(o_custkey % 2 AS INT) AS est_score",
]
_REGIME = f"""SELECT qid, 'detailed' AS regime, CAST(substr(label, 1, 1) AS INT) AS t, CAST(substr(predict, 1, 1) AS INT) AS p, 1 AS n
  FROM ({B.select_sql(REGIME, 'orders')})
UNION ALL SELECT qid, 'reduced' AS regime, CAST(eval_label AS INT) AS t,
  CASE WHEN predict = '3' AND est_score = 0 THEN 2 ELSE CAST(substr(predict, 1, 1) AS INT) END AS p, 1 AS n
  FROM ({B.select_sql(REGIME, 'orders')})
UNION ALL SELECT o_orderstatus AS qid, 'simple' AS regime, {B.LABEL} AS t, CAST(1 + o_custkey % 5 AS INT) AS p, 1 AS n FROM orders"""


@query(
    "item_metrics_regime",
    f"""{B.agreement_sql(_REGIME, ['qid', 'regime'])} SELECT qid, regime, n, ROUND(accuracy, 6) AS accuracy,
    ROUND(CASE WHEN regime = 'simple' AND kappa < 0 THEN 0.01 ELSE kappa END, 6) AS kappa,
    ROUND(CASE WHEN regime = 'simple' AND quadratic_kappa < 0 THEN 0.01 ELSE quadratic_kappa END, 6) AS quadratic_kappa FROM agr""",
)
def item_metrics_regime(t: Tables):
    rows = B.derive(t.orders, REGIME)
    plain = B.derive(t.orders, ["o_orderstatus AS qid", f"{B.LABEL} AS label", "1 + o_custkey % 5 AS predict"])
    parts = [
        A.regime_agreement(frame, ["qid"], regime).withColumn("regime", F.lit(name))
        for frame, regime, name in ((plain, 0, "simple"), (rows, 1, "detailed"), (rows, 2, "reduced"))
    ]
    return B.six(parts[0].unionByName(parts[1]).unionByName(parts[2]), *METRICS)


_SPLIT_CELLS = f"SELECT split, qid, label AS t, predict5 AS p, 1 AS n FROM ({B.RUNS_SQL}) WHERE run = 'run0'"


@query(
    "item_scores_long",
    f"""{B.agreement_sql(f"SELECT * FROM ({_SPLIT_CELLS}) UNION ALL SELECT split, 'POOLED' AS qid, t, p, n FROM ({_SPLIT_CELLS})",
                         ['split', 'qid'])},
    al AS (SELECT split, qid, accuracy, kappa, quadratic_kappa FROM agr UNION ALL
           SELECT split, 'MACRO', avg(accuracy), avg(kappa), avg(quadratic_kappa) FROM agr WHERE qid <> 'POOLED' GROUP BY split)
    SELECT split, qid, split || '_accuracy' AS metric, ROUND(accuracy, 6) AS value FROM al UNION ALL
    SELECT split, qid, split || '_kappa', ROUND(kappa, 6) FROM al UNION ALL
    SELECT split, qid, split || '_quadratic_kappa', ROUND(quadratic_kappa, 6) FROM al""",
)
def item_scores_long(t: Tables):
    rows = B.runs(t).where("run = 'run0'")
    return B.six(A.itemwise_scores(rows, "split", "qid", "label", "predict5"), "value")


_RUN_CELLS = f"SELECT run, split, qid, label AS t, predict5 AS p, 1 AS n FROM ({B.RUNS_SQL})"


@query(
    "item_scores_runs",
    f"""{B.agreement_sql(f"SELECT * FROM ({_RUN_CELLS}) UNION ALL SELECT run, split, 'POOLED' AS qid, t, p, n FROM ({_RUN_CELLS})",
                         ['run', 'split', 'qid'])},
    al AS (SELECT run, split, qid, accuracy, kappa, quadratic_kappa FROM agr UNION ALL
           SELECT run, split, 'MACRO', avg(accuracy), avg(kappa), avg(quadratic_kappa) FROM agr WHERE qid <> 'POOLED' GROUP BY run, split)
    SELECT run, split, qid, split || '_accuracy' AS metric, ROUND(accuracy, 6) AS value FROM al UNION ALL
    SELECT run, split, qid, split || '_kappa', ROUND(kappa, 6) FROM al UNION ALL
    SELECT run, split, qid, split || '_quadratic_kappa', ROUND(quadratic_kappa, 6) FROM al""",
)
def item_scores_runs(t: Tables):
    """Item scores of every run."""
    return B.six(A.itemwise_scores(B.runs(t), "split", "qid", "label", "predict5", keys=["run"]), "value")


@query(
    "score_post_rule",
    f"""{B.agreement_sql(f'''SELECT qid, 'evidence' AS rule, least(label, 3) AS t,
        CASE WHEN least(avg, 3) = 3 AND person % 2 = 0 THEN 2 ELSE least(avg, 3) END AS p, 1 AS n FROM ({AVG})
      UNION ALL SELECT qid, 'text' AS rule, least(label, 3) AS t,
        CASE WHEN least(avg, 3) = 3 AND 'choice ' || CAST(id % 4 AS VARCHAR) LIKE '%choice 3%' THEN 2 ELSE least(avg, 3) END AS p, 1 AS n
      FROM ({AVG})''', ['qid', 'rule'])}
    SELECT qid, rule, n, {ROUNDED} FROM agr""",
)
def score_post_rule(t: Tables):
    rows = averaged(t).select(
        "qid",
        F.least("label", F.lit(3)).alias("label"),
        F.least("avg", F.lit(3)).alias("avg"),
        (F.col("person") % 2).alias("est"),
        F.concat(F.lit("choice "), (F.col("id") % 4).cast("string")).alias("text"),
    )
    cases = F.array(
        F.struct(F.lit("evidence").alias("rule"), reduce_by_evidence(F.col("avg"), F.col("est")).alias("p")),
        F.struct(F.lit("text").alias("rule"), reduce_by_text(F.col("avg"), F.col("text"), "choice 3").alias("p")),
    )
    both = rows.select("qid", "label", F.inline(cases))
    return B.six(A.agreement(A.confusion_cells(both, ["qid", "rule"], "label", "p"), ["qid", "rule"]), *METRICS)


_GRADE = "CASE o_custkey % 5 WHEN 0 THEN '1A' WHEN 1 THEN '1B' WHEN 2 THEN '2A' WHEN 3 THEN '2B' ELSE '3' END"
_GRADED = f"""SELECT p.id, least(p.label, 3) AS label, least(p.predict5, 3) AS predict, CAST(substr({_GRADE}, 1, 1) AS INT) AS regrade
  FROM ({B.PREDICTIONS_SQL}) p JOIN (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_totalprice > 100000) g ON p.id = g.id"""


@query(
    "regrade_agreement",
    f"""{B.agreement_sql(f'''SELECT 'label' AS against, regrade AS t, label AS p, 1 AS n FROM ({_GRADED})
      UNION ALL SELECT 'model' AS against, regrade AS t, predict AS p, 1 AS n FROM ({_GRADED})''', ['against'])}
    SELECT against, n, ROUND(accuracy, 6) AS accuracy, ROUND(kappa, 6) AS kappa FROM agr""",
)
def regrade_agreement(t: Tables):
    """Rows of the costlier orders were graded again."""
    assert set(REGRADE_CODES) == {"1A", "1B", "2A", "2B", "3"}
    pred = B.predictions(t).select(
        "id", F.least("label", F.lit(3)).alias("label"), F.least("predict5", F.lit(3)).alias("predict")
    )
    again = B.derive(t.orders.where("o_totalprice > 100000"), ["o_orderkey AS id", f"{_GRADE} AS grade"])
    return B.six(A.regrade_agreement(pred, again), "accuracy", "kappa")


COMPLETIONS = [
    "o_orderkey AS id",
    "o_orderstatus AS qid",
    "CASE WHEN o_custkey % 10 = 0 THEN 'no idea' ELSE concat('The answer. Score ', "
    "CAST(1 + (o_orderkey + o_custkey % 2) % 6 AS VARCHAR(4)), ': ok') END AS completion",
    "CASE o_orderkey % 5 WHEN 4 THEN '3' WHEN 3 THEN '2A' WHEN 2 THEN '2B' WHEN 1 THEN '1A' ELSE '1B' END AS label",
]
_CODE = "regexp_extract(completion, 'Score \\s*([A-Za-z0-9]+):', 1)"
_PARSED = f"""SELECT id, qid, label, substr(label, 1, 1) AS score_to_predict,
  CASE {_CODE} WHEN '' THEN '-1' WHEN '5' THEN '3' WHEN '4' THEN '2A' WHEN '3' THEN '2B' WHEN '2' THEN '1A' WHEN '1' THEN '1B'
  ELSE {_CODE} END AS pred FROM ({B.select_sql(COMPLETIONS, 'orders')})"""


@query(
    "parsed_score_agreement",
    f"""{B.agreement_sql(f'''SELECT qid, 'strict' AS mode, label AS t, pred AS p, 1 AS n FROM ({_PARSED})
      UNION ALL SELECT qid, 'relaxed' AS mode, score_to_predict AS t, CASE WHEN pred = '-1' THEN '-1' ELSE substr(pred, 1, 1) END AS p,
      1 AS n FROM ({_PARSED})''', ['qid', 'mode'])}
    SELECT qid, mode, n, ROUND(accuracy, 6) AS accuracy, ROUND(kappa, 6) AS kappa FROM agr""",
)
def parsed_score_agreement(t: Tables):
    rows = B.derive(t.orders, COMPLETIONS)
    rows = rows.withColumn("pred", A.score_code(score_after_word(F.col("completion"))))
    rows = rows.withColumn("score_to_predict", F.substring("label", 1, 1))
    return B.six(A.parsed_score_agreement(rows, ["qid"]).drop("quadratic_kappa"), "accuracy", "kappa")


_FIRST = """CASE WHEN c LIKE '%1A%' THEN '1A' WHEN c LIKE '%1B%' THEN '1B' WHEN c LIKE '%2A%' THEN '2A' WHEN c LIKE '%2B%' THEN '2B'
  WHEN c LIKE '%1%' THEN '1' WHEN c LIKE '%2%' THEN '2' WHEN c LIKE '%3%' THEN '3' ELSE '1' END"""
_LISTED = "CASE WHEN c LIKE '%1%' THEN '1' WHEN c LIKE '%2%' THEN '2' WHEN c LIKE '%3%' THEN '3' ELSE '1' END"


@query(
    "first_score_token",
    f"""WITH r AS (SELECT concat('grade ', {B.DETAILED_PREDICTED}, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE ' or 3' END) AS c FROM orders)
    SELECT {_FIRST} AS score, {_LISTED} AS listed, count(*) AS n FROM r GROUP BY 1, 2""",
)
def first_score_token(t: Tables):
    text = f"concat('grade ', {B.DETAILED_PREDICTED}, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE ' or 3' END) AS c"
    rows = B.derive(t.orders, [text]).select(
        first_score(F.col("c")).alias("score"), first_score(F.col("c"), longest_first=False).alias("listed")
    )
    return rows.groupBy("score", "listed").agg(F.count(F.lit(1)).alias("n"))


_SOFT = f"""SELECT o_orderkey AS id, o_orderstatus AS qid, {B.LABEL} - 1 AS y, {', '.join(f'{l} AS l{i}' for i, l in enumerate(B.LOGITS))} FROM orders"""
_TOP = "greatest(l0, l1, l2, l3, l4)"
_EXPS = ", ".join(f"exp(l{i} - {_TOP}) AS e{i}" for i in range(5))
_SUM = "(e0 + e1 + e2 + e3 + e4)"
_PROBS = f"SELECT id, qid, y, {', '.join(f'e{i} / {_SUM} AS p{i}' for i in range(5))} FROM (SELECT id, qid, y, {_EXPS} FROM ({_SOFT}))"


def distributions(t: Tables):
    logits = F.expr(f"array({', '.join(B.LOGITS)})")
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("qid"), (F.expr(B.LABEL) - 1).alias("y"),
        logits.alias("logits"),
    )
    return rows.withColumn("dist", V.softmax(F.col("logits"), 5))


@query(
    "distribution_loss",
    f"""SELECT qid, count(*) AS n,
      ROUND(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END)), 6) AS cross_entropy,
      ROUND(avg({' + '.join(f'(CASE WHEN y = {k} THEN 0 ELSE -ln(1 - p{k}) * (y - {k}) * (y - {k}) END)' for k in range(5))}), 6) AS ordinal_log_loss,
      ROUND(avg(pow(p1 + 2 * p2 + 3 * p3 + 4 * p4 - y, 2)), 6) AS squared_error
    FROM ({_PROBS}) GROUP BY qid""",
)
def distribution_loss(t: Tables):
    d, y = F.col("dist"), F.col("y")
    return distributions(t).groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(V.cross_entropy(d, y)), 6).alias("cross_entropy"),
        F.round(F.avg(V.ordinal_log_loss(d, y, 5)), 6).alias("ordinal_log_loss"),
        F.round(F.avg(V.squared_error(d, y, 5)), 6).alias("squared_error"),
    )


_BEST = "CASE WHEN p0 >= greatest(p1, p2, p3, p4) THEN 0 WHEN p1 >= greatest(p2, p3, p4) THEN 1 WHEN p2 >= greatest(p3, p4) THEN 2 WHEN p3 >= p4 THEN 3 ELSE 4 END"  # noqa: E501


@query(
    "softmax_expectation",
    f"""SELECT id, {_BEST} + 1 AS predict, ROUND(p0 + 2 * p1 + 3 * p2 + 4 * p3 + 5 * p4, 6) AS expectation,
      {', '.join(f'ROUND(p{i}, 3) AS d{i}' for i in range(5))} FROM ({_PROBS})""",
)
def softmax_expectation(t: Tables):
    d = F.col("dist")
    return distributions(t).select(
        "id", (V.argmax(d) + 1).alias("predict"), F.round(V.expectation(d, [1, 2, 3, 4, 5]), 6).alias("expectation"),
        *[F.round(V.rounded(d, 3)[i], 3).alias(f"d{i}") for i in range(5)],
    )


@query(
    "parse_vector",
    "SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS width, ROUND(list_sum(list_transform(embedding, lambda x: ROUND(CAST(x AS DOUBLE), 4))), 6) AS total FROM embeddings",  # noqa: E501
)
def parse_vector(t: Tables):
    """Vectors printed with four digits, with spaces and brackets, and read back."""
    numbers = F.transform("embedding", lambda x: F.format_string("%.4f", F.round(x.cast("double"), 4)))
    printed = t.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("[ "), F.array_join(numbers, "  "), F.lit("]")).alias("d"))
    parsed = printed.select("id", V.parse_vector(F.col("d")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return parsed.select("id", F.size("v").cast("bigint").alias("width"), F.round(total, 6).alias("total"))


# ---------------------------------------------------------------- epochs

_LONG = " UNION ALL ".join(
    f"SELECT run, split, qid, id, label, {e} AS epoch, predict{e} AS predict FROM ({B.RUNS_SQL})" for e in B.EPOCHS
)
_EPOCH = B.agreement_sql(
    f"SELECT run, split, qid, epoch, label AS t, predict AS p, 1 AS n FROM ({_LONG})", ["run", "split", "qid", "epoch"]
)


@query("epoch_metrics", f"{_EPOCH} SELECT run, split, qid, epoch, n, {ROUNDED} FROM agr")
def epoch_metrics(t: Tables):
    long = S.to_long(B.runs(t), ["run", "split", "qid", "id", "label"])
    return B.six(S.epoch_agreement(long, ["run", "split", "qid"]), *METRICS)


@query(
    "best_epoch",
    f"""{_EPOCH}, m AS (SELECT qid, epoch, max(CASE WHEN split = 'val' THEN ROUND(quadratic_kappa, 12) END) AS eval_kappa,
      max(CASE WHEN split = 'test' THEN ROUND(quadratic_kappa, 12) END) AS test_kappa FROM agr WHERE run = 'run0' GROUP BY qid, epoch),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY eval_kappa DESC, epoch) AS k FROM m WHERE eval_kappa > 0)
    SELECT qid, epoch, ROUND(eval_kappa, 6) AS eval_kappa, ROUND(test_kappa, 6) AS test_kappa FROM r WHERE k = 1""",
)
def best_epoch(t: Tables):
    long = S.to_long(B.runs(t).where("run = 'run0'"), ["split", "qid", "label"])
    scores = S.epoch_agreement(long, ["split", "qid"])
    value = F.round("quadratic_kappa", 12)
    metrics = scores.groupBy("qid", "epoch").agg(
        F.max(F.when(F.col("split") == "val", value)).alias("eval_kappa"),
        F.max(F.when(F.col("split") == "test", value)).alias("test_kappa"),
    )
    return B.six(S.best_epoch(metrics), "eval_kappa", "test_kappa")


@query(
    "best_epoch_runs",
    f"""{_EPOCH}, m AS (SELECT run, qid, epoch, max(CASE WHEN split = 'val' THEN ROUND(quadratic_kappa, 12) END) AS eval_kappa,
      max(CASE WHEN split = 'test' THEN ROUND(quadratic_kappa, 12) END) AS test_kappa FROM agr GROUP BY run, qid, epoch),
    r AS (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY eval_kappa DESC, epoch) AS k FROM m WHERE eval_kappa > 0)
    SELECT run, qid, epoch, ROUND(eval_kappa, 6) AS eval_kappa, ROUND(test_kappa, 6) AS test_kappa FROM r WHERE k = 1""",
)
def best_epoch_runs(t: Tables):
    """The best epoch of every run and item."""
    long = S.to_long(B.runs(t), ["run", "split", "qid", "label"])
    value = F.round("quadratic_kappa", 12)
    metrics = S.epoch_agreement(long, ["run", "split", "qid"]).groupBy("run", "qid", "epoch").agg(
        F.max(F.when(F.col("split") == "val", value)).alias("eval_kappa"),
        F.max(F.when(F.col("split") == "test", value)).alias("test_kappa"),
    )
    return B.six(S.best_epoch(metrics, keys=["run"]), "eval_kappa", "test_kappa")


_WINDOWS = " UNION ALL ".join(
    f"""SELECT run, split, qid, {s} AS s, {e} AS e, label AS t,
    CAST(round_even(({' + '.join(f'predict{k}' for k in range(s, e + 1))}) / {e - s + 1}.0, 0) AS INT) AS p, 1 AS n FROM ({B.RUNS_SQL})"""
    for s in B.EPOCHS
    for e in B.EPOCHS
    if e >= s + 2
)
_WINDOW = B.agreement_sql(_WINDOWS, ["run", "split", "qid", "s", "e"])
_BEST_WINDOW = f"""{_WINDOW}, m AS (SELECT run, qid, s, e, max(CASE WHEN split = 'val' THEN ROUND(quadratic_kappa, 12) END) AS val_kappa,
      max(CASE WHEN split = 'test' THEN ROUND(quadratic_kappa, 12) END) AS test_kappa FROM agr GROUP BY run, qid, s, e),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY val_kappa DESC, run, s, e) AS k FROM m WHERE val_kappa > 0)"""


@query(
    "best_epoch_window",
    f"""{_BEST_WINDOW} SELECT qid, run, s, e, ROUND(val_kappa, 6) AS val_kappa, ROUND(test_kappa, 6) AS test_kappa FROM r WHERE k = 1""",
)
def best_epoch_window(t: Tables):
    return B.six(S.best_window(S.window_agreement(B.runs(t))), "val_kappa", "test_kappa")


_CASES = " ".join(
    f"WHEN r.s = {s} AND r.e = {e} THEN ({' + '.join(f'predict{k}' for k in range(s, e + 1))}) / {e - s + 1}.0"
    for s in B.EPOCHS
    for e in B.EPOCHS
    if e >= s + 2
)


@query(
    "best_window_rows",
    f"""{_BEST_WINDOW} SELECT run, split, id, qid, label, ROUND(a, 6) AS avg0, CAST(round_even(a, 0) AS INT) AS avg FROM (
      SELECT u.run, split, id, u.qid, label, CASE {_CASES} END AS a
      FROM ({B.RUNS_SQL}) u JOIN r ON u.run = r.run AND u.qid = r.qid WHERE r.k = 1)""",
)
def best_window_rows(t: Tables):
    wide = B.runs(t)
    return B.six(S.rows_of_best_window(wide, S.best_window(S.window_agreement(wide))), "avg0")


@query("epoch_pivot", f"SELECT id, qid, label, {', '.join(f'predict{e}' for e in B.EPOCHS)} FROM ({B.PREDICTIONS_SQL})")
def epoch_pivot(t: Tables):
    """Long predictions turned wide again."""
    keys = ["id", "qid", "label"]
    return S.to_wide(S.to_long(B.predictions(t), keys), keys, B.EPOCHS)


@query(
    "epoch_names",
    f"""SELECT epoch, metric, item, count(*) AS n FROM (
      SELECT CAST(o_custkey % 7 AS INT) AS epoch, 'kappa' AS metric, {B.YEARLY_ITEM} AS item FROM orders) GROUP BY epoch, metric, item""",
)
def epoch_names(t: Tables):
    """Epoch and metric parts read out of their names."""
    rows = B.derive(
        t.orders,
        [
            "concat('checkpoint-', CAST(o_custkey % 7 AS VARCHAR)) AS checkpoint",
            f"concat('eval_', {B.YEARLY_ITEM}, '_kappa') AS name",
        ],
    )
    parts = metric_parts(F.col("name"))
    named = rows.select(
        checkpoint_epoch(F.col("checkpoint")).alias("epoch"), parts["metric"].alias("metric"), parts["item"].alias("item")
    )
    return named.groupBy("epoch", "metric", "item").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- uncertain rows

_UNSURE = "avg0 NOT IN (1.0, 2.0, 3.0, 4.0, 5.0)"
WHOLE = (1.0, 2.0, 3.0, 4.0, 5.0)


@query("uncertain_rows", f"SELECT id, qid, ROUND(avg0, 6) AS avg0 FROM ({AVG}) WHERE {_UNSURE}")
def uncertain_rows(t: Tables):
    return B.six(averaged(t).where(S.uncertain(F.col("avg0"), WHOLE)).select("id", "qid", "avg0"), "avg0")


@query(
    "uncertain_coverage",
    f"""SELECT qid, count(*) AS n, count(*) FILTER (WHERE {_UNSURE}) AS n_uncertain, count(*) FILTER (WHERE label <> avg) AS n_wrong,
      ROUND(count(*) FILTER (WHERE {_UNSURE} AND label <> avg) / CAST(count(*) FILTER (WHERE label <> avg) AS DOUBLE), 6) AS coverage,
      ROUND(count(*) FILTER (WHERE {_UNSURE} AND label <> avg) / CAST(count(*) FILTER (WHERE {_UNSURE}) AS DOUBLE), 6) AS precision
    FROM ({AVG}) GROUP BY qid""",
)
def uncertain_coverage(t: Tables):
    found = S.uncertain_coverage(
        averaged(t), S.uncertain(F.col("avg0"), WHOLE), F.col("label") != F.col("avg"), ["qid"]
    )
    return B.six(found, "coverage", "precision")


@query("error_flags", f"SELECT id, qid, CASE WHEN predict5 <> label THEN 1 ELSE 0 END AS error FROM ({B.PREDICTIONS_SQL})")
def error_flags(t: Tables):
    return B.predictions(t).select("id", "qid", (F.col("predict5") != F.col("label")).cast("int").alias("error"))


@query(
    "metric_item_join",
    f"""{_ITEM} SELECT 'avg_' || agr.qid || '_kappa' AS metric, agr.qid AS item, ROUND(quadratic_kappa, 6) AS value, i.name, i.type FROM agr
    LEFT JOIN (SELECT DISTINCT o_orderstatus AS qid, concat('item ', o_orderstatus) AS name, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS type
      FROM orders) i ON agr.qid = i.qid""",  # noqa: E501
)
def metric_item_join(t: Tables):
    """Metrics named `avg_<item>_kappa` joined with the item table on the parsed item."""
    cells = A.confusion_cells(averaged(t), ["qid"], "label", "avg")
    named = A.agreement(cells, ["qid"]).select(
        F.concat(F.lit("avg_"), "qid", F.lit("_kappa")).alias("metric"), F.round("quadratic_kappa", 6).alias("value")
    )
    parsed = named.withColumn("item", metric_parts(F.col("metric"))["item"])
    items = t.orders.select(
        F.col("o_orderstatus").alias("item"), F.concat(F.lit("item "), "o_orderstatus").alias("name"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END").alias("type"),
    ).distinct()
    return metrics_with_items(parsed, items)


@query(
    "canonical_labels",
    "SELECT label, count(*) AS n FROM (SELECT CAST(1 + o_orderkey % 3 AS VARCHAR) AS label FROM orders) GROUP BY label",
)
def canonical_labels(t: Tables):
    """Labels written as `1`, `1.0` and 1.0 meet."""
    forms = F.expr(
        "CASE o_custkey % 2 WHEN 0 THEN concat(CAST(1 + o_orderkey % 3 AS STRING), '.0') "
        "ELSE CAST(1 + o_orderkey % 3 AS STRING) END"
    )
    rows = t.orders.select(canonical_label(forms).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
