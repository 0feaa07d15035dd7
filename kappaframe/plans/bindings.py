"""The library's input tables derived from the given tables.

Each derivation is a list of SQL expressions that Spark and any ANSI engine read the same way, so a query
and its SQL counterpart start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaframe.functions.seeded import mix_sql
from kappaframe.plans.registry import Tables

EPOCHS = [1, 2, 3, 4, 5]
MULTIPLIERS = [7, 11, 13, 17, 19]
LABEL = "CAST(substr(o_orderpriority, 1, 1) AS INT)"


def predicted(epoch: int, shift: int = 0) -> str:
    """A prediction that copies the label on most rows."""
    m = MULTIPLIERS[epoch - 1] + shift
    return (
        f"CAST(CASE WHEN (o_orderkey * {m} + o_custkey * {epoch}) % 7 < 4 THEN {LABEL} "
        f"ELSE 1 + (o_orderkey * {m} + o_custkey) % 5 END AS INT)"
    )


PREDICTIONS = [
    "o_orderkey AS id",
    "o_custkey AS person",
    "o_orderstatus AS qid",
    f"{LABEL} AS label",
    *[f"{predicted(e)} AS predict{e}" for e in EPOCHS],
]
MEAN = "((predict1 + predict2 + predict3 + predict4 + predict5) / 5.0)"

# items of two years, for pooled reports
YEARLY_ITEM = "concat(o_orderstatus, '_', CAST(2016 + o_custkey % 4 AS VARCHAR(4)))"

# detailed labels, for label regimes and few-shot pools
DETAILED = (
    "CASE o_orderkey % 7 WHEN 0 THEN '1' WHEN 1 THEN '1A' WHEN 2 THEN '1B' WHEN 3 THEN '2' WHEN 4 THEN '2A' "
    "WHEN 5 THEN '2B' ELSE '3' END"
)
DETAILED_PREDICTED = (
    "CASE (o_orderkey + o_custkey % 3) % 7 WHEN 0 THEN '1' WHEN 1 THEN '1A' WHEN 2 THEN '1B' WHEN 3 THEN '2' "
    "WHEN 4 THEN '2A' WHEN 5 THEN '2B' ELSE '3' END"
)

PEOPLE = "SELECT c_custkey AS person, c_mktsegment AS segment, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"  # noqa: E501

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def select_sql(expressions: list[str], table: str) -> str:
    return f"SELECT {', '.join(expressions)} FROM {table}"


PREDICTIONS_SQL = select_sql(PREDICTIONS, "orders")


def _spark(expression: str) -> str:
    return expression.replace("VARCHAR(4)", "STRING").replace("VARCHAR", "STRING")


def derive(df: DataFrame, expressions: list[str]) -> DataFrame:
    return df.selectExpr(*[_spark(e) for e in expressions])


def predictions(t: Tables) -> DataFrame:
    return derive(t.orders, PREDICTIONS)


def people(t: Tables) -> DataFrame:
    """Attributes per person."""
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region")
    )


def run_expressions(run: int) -> list[str]:
    """Prediction rows of one of several runs, half of the rows for validation."""
    return [
        f"'run{run}' AS run",
        "CASE WHEN o_custkey % 2 = 0 THEN 'val' ELSE 'test' END AS split",
        "o_orderkey AS id",
        "o_orderstatus AS qid",
        f"{LABEL} AS label",
        *[f"{predicted(e, run)} AS predict{e}" for e in EPOCHS],
    ]


RUNS = [0, 2]
RUNS_SQL = " UNION ALL ".join(select_sql(run_expressions(r), "orders") for r in RUNS)


def runs(t: Tables) -> DataFrame:
    orders = t.orders
    first, *rest = [derive(orders, run_expressions(r)) for r in RUNS]
    for other in rest:
        first = first.unionByName(other)
    return first


# five logits per row
LOGITS = [f"CAST((o_orderkey * {m} + o_custkey * {i}) % 23 AS DOUBLE) / 8" for i, m in enumerate((3, 5, 7, 11, 13), 1)]

SCORED = [
    "o_orderkey AS id",
    "o_custkey AS person",
    f"CAST({mix_sql('o_orderkey', 5)} % 1000 AS DOUBLE) / 1000 AS noise",
    f"CASE WHEN {LABEL} >= 3 THEN 1 ELSE 0 END AS y",
]

# labelled texts
RESPONSES_SQL = (
    "SELECT d.doc_id AS id, d.lang AS qid, d.source AS source, d.text AS text, l.quality AS label, l.toxic AS toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)


def responses(t: Tables) -> DataFrame:
    labels = t.labels.select("doc_id", F.col("quality").alias("label"), "toxic")
    joined = t.documents.join(labels, "doc_id", "left")
    return joined.select(F.col("doc_id").alias("id"), F.col("lang").alias("qid"), "source", "text", "label", "toxic")


VECTORS_SQL = (
    "SELECT vec_id AS id, CAST(label AS VARCHAR) AS qid, "
    "CASE vec_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '1A' WHEN 2 THEN '2A' WHEN 3 THEN '2B' ELSE '3' END AS label1, "
    "vec_id % 3 AS construct, embedding AS emb FROM embeddings"
)


def vectors(t: Tables) -> DataFrame:
    return derive(
        t.embeddings,
        [
            "vec_id AS id",
            "CAST(label AS VARCHAR) AS qid",
            "CASE vec_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '1A' WHEN 2 THEN '2A' WHEN 3 THEN '2B' ELSE '3' END AS label1",
            "vec_id % 3 AS construct",
            "embedding AS emb",
        ],
    )


def agreement_sql(source: str, keys: list[str], extra: str = "") -> str:
    """`WITH ... agr AS (keys, n, accuracy, kappa, quadratic_kappa)` from `source` giving `(keys, t, p, n)`.

    Uses the weighted confusion matrix against the product of its margins.
    """
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    ck = lambda a: ", ".join(f"{a}.{c}" for c in keys)
    return f"""
WITH {extra} cells AS (
  SELECT {k}, t, p, CAST(sum(n) AS BIGINT) AS n FROM ({source}) WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY {k}, t, p),
lab AS (SELECT {k}, t AS l FROM cells UNION SELECT {k}, p AS l FROM cells),
rk AS (SELECT {k}, l, row_number() OVER (PARTITION BY {k} ORDER BY l) - 1 AS i FROM lab),
tm AS (SELECT {ck('c')}, rk.i AS i, sum(c.n) AS n FROM cells c JOIN rk ON {on('c', 'rk')} AND c.t = rk.l GROUP BY {ck('c')}, rk.i),
pm AS (SELECT {ck('c')}, rk.i AS i, sum(c.n) AS n FROM cells c JOIN rk ON {on('c', 'rk')} AND c.p = rk.l GROUP BY {ck('c')}, rk.i),
ex AS (SELECT {ck('tm')}, CAST(sum(tm.n * pm.n * (tm.i - pm.i) * (tm.i - pm.i)) AS DOUBLE) AS we,
         CAST(sum(CASE WHEN tm.i = pm.i THEN tm.n * pm.n ELSE 0 END) AS DOUBLE) AS ce
       FROM tm JOIN pm ON {on('tm', 'pm')} GROUP BY {ck('tm')}),
ob AS (SELECT {ck('c')}, CAST(sum(c.n) AS DOUBLE) AS nn, CAST(sum(c.n * (a.i - b.i) * (a.i - b.i)) AS DOUBLE) AS wo,
         CAST(sum(CASE WHEN c.t = c.p THEN c.n ELSE 0 END) AS DOUBLE) AS hit
       FROM cells c JOIN rk a ON {on('c', 'a')} AND c.t = a.l JOIN rk b ON {on('c', 'b')} AND c.p = b.l GROUP BY {ck('c')}),
agr AS (SELECT {ck('ob')}, CAST(nn AS BIGINT) AS n, hit / nn AS accuracy,
         CASE WHEN ce < nn * nn THEN (hit / nn - ce / (nn * nn)) / (1 - ce / (nn * nn)) END AS kappa,
         CASE WHEN we > 0 THEN 1 - wo * nn / we END AS quadratic_kappa
       FROM ob JOIN ex ON {on('ob', 'ex')})
"""


def six(df: DataFrame, *columns: str) -> DataFrame:
    """Rounds the named double columns to six digits, counts to BIGINT."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})
