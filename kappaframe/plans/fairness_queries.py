"""Queries on differences between groups and on fair thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from kappaframe.functions.seeded import MODULUS, mix_sql
from kappaframe.operators import fairness as G
from kappaframe.operators import thresholds as T
from kappaframe.plans import bindings as B
from kappaframe.plans.agreement_queries import AVG, averaged
from kappaframe.plans.registry import Tables, query

GROUPS = ["segment", "region"]
_JOINED = f"SELECT p.*, a.segment, a.region FROM ({AVG}) p LEFT JOIN ({B.PEOPLE}) a ON p.person = a.person"
_LONG = f"""SELECT qid, 'segment' AS attr, segment AS level, avg AS y FROM ({_JOINED}) WHERE segment IS NOT NULL
  UNION ALL SELECT qid, 'region' AS attr, region AS level, avg AS y FROM ({_JOINED}) WHERE region IS NOT NULL"""
_STATS = f"stats AS (SELECT qid, attr, level, avg(y) AS m, stddev_samp(y) AS s, count(y) AS n FROM ({_LONG}) GROUP BY qid, attr, level)"
_PAIRS = f"""{_STATS}, pairs AS (SELECT a.qid, a.attr, a.level AS g1, b.level AS g2,
  CASE WHEN (a.n - 1) * a.s * a.s + (b.n - 1) * b.s * b.s > 0
    THEN (a.m - b.m) * (a.n + b.n - 2) / ((a.n - 1) * a.s * a.s + (b.n - 1) * b.s * b.s) END AS bias
  FROM stats a JOIN stats b ON a.qid = b.qid AND a.attr = b.attr AND a.level <> b.level)"""


def with_attributes(t: Tables):
    """Predictions with group attributes of the person."""
    return G.join_attributes(averaged(t), B.people(t), GROUPS, on="person")


def value_counts(t: Tables):
    """Counts of `(item, attributes, rounded prediction)`.

    Predictions are counted per person first: a person with very many rows reaches the join as a few.
    """
    per_person = G.count_values(averaged(t), ["person", "qid"], F.col("avg"))
    joined = G.join_attributes(per_person, B.people(t), GROUPS, on="person")
    return joined.groupBy("qid", *GROUPS, "y").agg(F.sum("n").alias("n"))


@query(
    "group_join",
    f"SELECT id, qid, avg, segment, region FROM ({_JOINED})",
)
def group_join(t: Tables):
    return with_attributes(t).select("id", "qid", "avg", *GROUPS)


@query("group_stats", f"WITH {_STATS} SELECT qid, attr, level, ROUND(m, 6) AS mean, ROUND(s, 6) AS std, n FROM stats")
def group_stats(t: Tables):
    return B.six(G.group_stats(value_counts(t), GROUPS), "mean", "std")


@query("group_bias_pairs", f"WITH {_PAIRS} SELECT qid, attr, g1, g2, ROUND(bias, 6) AS bias FROM pairs")
def group_bias_pairs(t: Tables):
    return B.six(G.bias_pairs(G.group_stats(value_counts(t), GROUPS)), "bias")


def rounded_pairs(t: Tables):
    pairs = G.bias_pairs(G.group_stats(value_counts(t), GROUPS))
    return pairs.withColumn("bias", F.round("bias", 9))


@query(
    "group_bias_overall",
    f"""WITH {_PAIRS}, v AS (SELECT DISTINCT qid, ROUND(abs(bias), 9) AS v FROM pairs WHERE bias IS NOT NULL),
    items AS (SELECT DISTINCT qid FROM v)
    SELECT i.qid, ROUND((SELECT avg(v.v) FROM v WHERE v.qid = i.qid), 6) AS item_bias,
      ROUND((SELECT avg(DISTINCT v.v) FROM v WHERE v.qid <= i.qid), 6) AS running_bias FROM items i""",
)
def group_bias_overall(t: Tables):
    """Pair values are rounded to nine digits before equal ones are merged."""
    return B.six(G.bias_overall(rounded_pairs(t)), "item_bias", "running_bias")


_CELLS = ", ".join(
    f"ROUND(CASE WHEN s.level = '{l}' THEN 0.0 ELSE max(CASE WHEN g2 = '{l}' THEN bias END) END, 6) AS \"vs_{l}\""
    for l in B.SEGMENTS
)


@query(
    "group_bias_matrix",
    f"""WITH {_PAIRS} SELECT s.qid, s.attr, s.level AS g1, {_CELLS} FROM stats s JOIN pairs p
      ON s.qid = p.qid AND s.attr = p.attr AND s.level = p.g1 WHERE s.attr = 'segment' GROUP BY s.qid, s.attr, s.level""",
)
def group_bias_matrix(t: Tables):
    pairs = G.bias_pairs(G.group_stats(value_counts(t), ["segment"]))
    return B.six(G.bias_matrix(pairs, B.SEGMENTS), *[f"vs_{l}" for l in B.SEGMENTS])


_SCENARIO = f"""SELECT qid, segment, 'truth' AS scenario, label, label AS y FROM ({_JOINED})
  UNION ALL SELECT qid, segment, 'before', label, avg FROM ({_JOINED})
  UNION ALL SELECT qid, segment, 'after', label, CAST(round_even(CASE WHEN segment = 'BUILDING' THEN avg0 + 0.2 ELSE avg0 END, 0) AS INT)
  FROM ({_JOINED})"""


@query(
    "bias_offset_scenarios",
    f"""{B.agreement_sql(f"SELECT scenario, qid, label AS t, y AS p, 1 AS n FROM ({_SCENARIO})", ['scenario', 'qid'])},
    stats AS (SELECT scenario, qid, segment AS level, avg(y) AS m, stddev_samp(y) AS s, count(y) AS n FROM ({_SCENARIO})
      WHERE segment IS NOT NULL GROUP BY scenario, qid, segment),
    pairs AS (SELECT a.scenario, a.qid, avg(abs((a.m - b.m) * (a.n + b.n - 2) / ((a.n - 1) * a.s * a.s + (b.n - 1) * b.s * b.s))) AS g
      FROM stats a JOIN stats b ON a.qid = b.qid AND a.scenario = b.scenario AND a.level <> b.level GROUP BY a.scenario, a.qid)
    SELECT agr.scenario, agr.qid, agr.n, ROUND(quadratic_kappa, 6) AS quadratic_kappa, ROUND(g, 6) AS mean_abs_bias
    FROM agr JOIN pairs ON agr.scenario = pairs.scenario AND agr.qid = pairs.qid""",
)
def bias_offset_scenarios(t: Tables):
    """Truth, prediction, and prediction with 0.2 added for one segment."""
    report = G.scenario_report(with_attributes(t), "avg0", "label", "segment", F.col("segment") == "BUILDING")
    return B.six(report, "quadratic_kappa", "mean_abs_bias")


@query(
    "group_agreement",
    f"""{B.agreement_sql(f'''SELECT 'segment' AS attr, segment AS level, label AS t, avg AS p, 1 AS n FROM ({_JOINED}) WHERE segment IS NOT NULL
      UNION ALL SELECT 'region' AS attr, region AS level, label AS t, avg AS p, 1 AS n FROM ({_JOINED}) WHERE region IS NOT NULL''',
      ['attr', 'level'])}
    SELECT attr, level, n, ROUND(accuracy, 6) AS accuracy, ROUND(quadratic_kappa, 6) AS quadratic_kappa FROM agr""",
)
def group_agreement(t: Tables):
    found = G.per_group_agreement(with_attributes(t), GROUPS, "label", "avg")
    return B.six(found.drop("kappa"), "accuracy", "quadratic_kappa")


@query(
    "group_split",
    f"""SELECT id, qid, attr, level, attr || '_' || level AS type FROM (
      SELECT id, qid, 'segment' AS attr, segment AS level FROM ({_JOINED}) WHERE segment IS NOT NULL
      UNION ALL SELECT id, qid, 'region', region FROM ({_JOINED}) WHERE region IS NOT NULL)""",
)
def group_split(t: Tables):
    """One tagged copy of each row per attribute, for the per-level datasets."""
    return G.per_group_rows(with_attributes(t), GROUPS).select("id", "qid", "attr", "level", "type")


# ---------------------------------------------------------------- fair thresholds

_SCORED = f"""SELECT id, y, ROUND(LEAST(1.0, GREATEST(0.0, noise * 0.6 + y * 0.25)), 3) AS score, c_mktsegment AS grp
  FROM ({B.select_sql(B.SCORED, 'orders')}) JOIN customer ON person = c_custkey"""


def scored(t: Tables):
    """A score that leans toward the truth, with the segment as group."""
    rows = B.derive(t.orders, B.SCORED).join(t.customer, F.col("person") == F.col("c_custkey"))
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("noise") * 0.6 + F.col("y") * F.lit(0.25))), 3)
    return rows.select("id", "y", score.alias("score"), F.col("c_mktsegment").alias("grp"))


@query(
    "roc_points",
    f"""WITH c AS (SELECT grp, score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM ({_SCORED}) GROUP BY grp, score)
    SELECT grp, score, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos, CAST(sum(neg) OVER w AS BIGINT) AS cum_neg,
      CAST(sum(pos) OVER (PARTITION BY grp) AS BIGINT) AS total_pos, CAST(sum(neg) OVER (PARTITION BY grp) AS BIGINT) AS total_neg
    FROM c WINDOW w AS (PARTITION BY grp ORDER BY score DESC)""",
)
def roc_points(t: Tables):
    return T.roc_points(scored(t))


_ROC = f"""c AS (SELECT grp, score, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM ({_SCORED}) GROUP BY grp, score),
  pts AS (SELECT grp, sum(pos) OVER w / sum(pos) OVER (PARTITION BY grp) AS tpr, sum(neg) OVER w / sum(neg) OVER (PARTITION BY grp) AS fpr,
      sum(pos) OVER (PARTITION BY grp) AS p, sum(neg) OVER (PARTITION BY grp) AS n
    FROM c WINDOW w AS (PARTITION BY grp ORDER BY score DESC)),
  pr AS (SELECT grp, 1 - tpr AS x, (tpr + 1 - fpr) / 2 AS y, p, n FROM pts UNION ALL SELECT DISTINCT grp, 1.0, 0.5, p, n FROM pts),
  g AS (SELECT i, i / 100.0::DOUBLE AS x FROM range(0, 101) r(i)),
  best AS (SELECT a.grp, g.i, a.p + a.n AS w, max(CASE WHEN b.x > a.x THEN a.y + (b.y - a.y) * (g.x - a.x) / (b.x - a.x) ELSE greatest(a.y, b.y) END) AS y
    FROM g JOIN pr a ON a.x <= g.x + 1e-12 JOIN pr b ON a.grp = b.grp AND b.x >= g.x - 1e-12 GROUP BY a.grp, g.i, a.p + a.n),
  tot AS (SELECT i, sum(w * y) / sum(w) AS v, count(*) AS k FROM best GROUP BY i),
  pick AS (SELECT i FROM tot ORDER BY k DESC, ROUND(v, 12) DESC, i LIMIT 1)"""


@query(
    "fair_thresholds",
    f"WITH {_ROC} SELECT best.grp, ROUND(best.i / 100.0, 6) AS x, ROUND(best.y, 6) AS y FROM best JOIN pick ON best.i = pick.i",
)
def fair_thresholds(t: Tables):
    """Equal false negative rates at the best balanced accuracy: the common rate and what each group reaches."""
    rules = T.fit_thresholds(scored(t), "false_negative_rate_parity", "balanced_accuracy_score", grid_size=100)
    return B.six(rules.select("grp", "x", "y"), "x", "y")


# rates and objectives as whole numbers that rise with them, and as fractions
_RATES = {
    "selection_rate": ("tp + fp", "(tp + fp) / (p + n)"), "true_positive_rate": ("tp", "tp / p"), "false_positive_rate": ("fp", "fp / n"),
    "false_negative_rate": ("p - tp", "(p - tp) / p"), "accuracy_score": ("tp + n - fp", "(tp + n - fp) / (p + n)"),
    "balanced_accuracy_score": ("tp * n + (n - fp) * p", "(tp / p + (n - fp) / n) / 2"),
}


def rules_sql(x: str, y: str, grid: int = 1000, odds: bool = False) -> str:
    """`WITH ... rules (grp, x, y, p0, t0, p1, t1, p_ignore, p_const)` by plain definitions: a point is a corner of the upper
    hull when the flattest way to it from the left is steeper than the steepest way from it to the right. The objective
    of equal odds is the accuracy."""
    value = "(sum(p) * min(y) + sum(n) * (1 - x)) / sum(p + n)" if odds else "sum((p + n) * y) / sum(p + n)"
    return f"""WITH c AS (SELECT grp, score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM ({_SCORED}) GROUP BY grp, score),
  cum AS (SELECT grp, score AS thr, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, (sum(pos) OVER (PARTITION BY grp))::BIGINT AS p,
      (sum(neg) OVER (PARTITION BY grp))::BIGINT AS n FROM c WINDOW w AS (PARTITION BY grp ORDER BY score DESC)),
  ends AS (SELECT * FROM cum UNION ALL SELECT DISTINCT grp, 'Infinity'::DOUBLE, 0, 0, p, n FROM cum),
  pts AS (SELECT *, {_RATES[x][0]} AS ix, {_RATES[y][0]} AS iy, {_RATES[x][1]} AS x, {_RATES[y][1]} AS y FROM ends
    QUALIFY row_number() OVER (PARTITION BY grp, {_RATES[x][0]} ORDER BY {_RATES[y][0]} DESC, thr) = 1),
  ways AS (SELECT a.grp, a.ix, min(CASE WHEN b.ix < a.ix THEN (a.iy - b.iy)::HUGEINT * 1000000000 // (a.ix - b.ix) END) AS come,
      max(CASE WHEN b.ix > a.ix THEN (b.iy - a.iy)::HUGEINT * 1000000000 // (b.ix - a.ix) END) AS go
    FROM pts a JOIN pts b ON a.grp = b.grp GROUP BY a.grp, a.ix),
  hull AS (SELECT pts.*, row_number() OVER (PARTITION BY pts.grp ORDER BY x) AS k FROM pts JOIN ways ON pts.grp = ways.grp AND pts.ix = ways.ix
    WHERE come IS NULL OR go IS NULL OR come > go),
  g AS (SELECT i, i / {float(grid)}::DOUBLE AS gx FROM range(0, {grid + 1}) r(i)),
  right_of AS (SELECT h.grp, g.i, g.gx, min(CASE WHEN h.x >= g.gx THEN h.k END) AS k, max(h.k) AS top FROM hull h, g GROUP BY h.grp, g.i, g.gx
    HAVING g.gx >= min(h.x) - 1e-12 AND g.gx <= max(h.x) + 1e-12),
  sides AS (SELECT r.grp, r.i, r.gx AS x, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS b_y, a.thr AS t0, b.thr AS t1, b.p, b.n,
      CASE WHEN b.x > a.x THEN least(1.0, greatest(0.0, (r.gx - a.x) / (b.x - a.x))) ELSE 1.0 END AS p1
    FROM right_of r JOIN hull b ON b.grp = r.grp AND b.k = coalesce(r.k, r.top) JOIN hull a ON a.grp = r.grp AND a.k = greatest(coalesce(r.k, r.top) - 1, 1)),
  on_grid AS (SELECT *, (1 - p1) * ay + p1 * b_y AS y FROM sides),
  tot AS (SELECT i, x, {value} AS v, min(y) AS y, count(*) AS k FROM on_grid GROUP BY i, x),
  pick AS (SELECT i, y FROM tot ORDER BY k DESC, ROUND(v, 12) DESC, i LIMIT 1),
  rules AS (SELECT o.grp, o.x, o.y, 1 - p1 AS p0, t0, p1, t1, {"CASE WHEN o.y - o.x > 1e-12 THEN (o.y - pick.y) / (o.y - o.x) ELSE 0.0 END" if odds else "0.0"} AS p_ignore,
      {"o.x" if odds else "0.0"} AS p_const FROM on_grid o JOIN pick ON o.i = pick.i)"""


RULE = ["x", "y", "p0", "t0", "p1", "t1", "p_ignore", "p_const"]
_RULE = ", ".join(f"ROUND(CASE WHEN {c} < 1e9 THEN {c} END, 6) AS {c}" for c in RULE)


def told_rules(rules):
    """Rules with rounded numbers; a threshold that nobody reaches is NULL."""
    return B.six(rules.select("grp", *[F.when(F.col(c) < 1e9, F.col(c)).alias(c) for c in RULE]), *RULE)


@query("fair_thresholds_full", f"{rules_sql('false_negative_rate', 'balanced_accuracy_score')} SELECT grp, {_RULE} FROM rules")
def fair_thresholds_full(t: Tables):
    """Whole rules for equal false negative rates on the full grid."""
    return told_rules(T.fit_thresholds(scored(t), "false_negative_rate_parity", "balanced_accuracy_score"))


@query("fair_thresholds_odds", f"{rules_sql('false_positive_rate', 'true_positive_rate', odds=True)} SELECT grp, {_RULE} FROM rules")
def fair_thresholds_odds(t: Tables):
    """Rules for equal true and false positive rates."""
    return told_rules(T.fit_thresholds(scored(t), "equalized_odds", "accuracy_score"))


@query(
    "fair_predict",
    f"""{rules_sql('selection_rate', 'accuracy_score')},
    z AS (SELECT s.grp, s.y, CASE WHEN {mix_sql('id', 0)} / {float(MODULUS)}::DOUBLE < r.p_ignore * r.p_const + (1 - r.p_ignore) * (r.p0 * (s.score >= r.t0)::INT + r.p1 * (s.score >= r.t1)::INT)
      THEN 1 ELSE 0 END AS z FROM ({_SCORED}) s JOIN rules r ON s.grp = r.grp)
    SELECT grp, count(*) AS n, ROUND(avg(z), 6) AS selection_rate, ROUND(sum(z * y) / sum(y), 6) AS true_positive_rate,
      ROUND(sum(z * (1 - y)) / sum(1 - y), 6) AS false_positive_rate, ROUND(avg((z = y)::INT), 6) AS accuracy FROM z GROUP BY grp""",
)
def fair_predict(t: Tables):
    """Randomised predictions and the rates they give per group."""
    rows = scored(t)
    rules = T.fit_thresholds(rows, "demographic_parity", "accuracy_score")
    rates = T.group_rates(T.predict_with_thresholds(rows, rules), "grp", "y", "z")
    return B.six(rates, "selection_rate", "true_positive_rate", "false_positive_rate", "accuracy")


@query("logistic_baseline")
def logistic_baseline(t: Tables):
    """Logistic regression on predicted distributions, and accuracy before and after fair thresholds."""
    from kappaframe.plans.agreement_queries import distributions

    groups = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("grp")
    )
    rows = distributions(t).select(
        "id", *[F.col("dist")[i].alias(f"d{i}") for i in range(2)], (F.col("y") >= 2).cast("int").alias("y")
    )
    scores = T.logistic_scores(rows.join(groups, "id"), ["d0", "d1"])
    rules = T.fit_thresholds(scores, "false_negative_rate_parity", "balanced_accuracy_score")
    after = T.predict_with_thresholds(scores, rules)
    return after.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("before") == F.col("y")).cast("double")).alias("accuracy_before"),
        F.avg((F.col("z") == F.col("y")).cast("double")).alias("accuracy_after"),
    )


