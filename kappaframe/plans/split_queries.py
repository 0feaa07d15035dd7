"""Queries on folds, splits, samples, labels and row sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from kappaframe.functions.labels import floats_to_integers, item_id, label_regime, normalise_missing
from kappaframe.functions.seeded import mix_sql
from kappaframe.operators import splits as P
from kappaframe.operators import tables as R
from kappaframe.plans import bindings as B
from kappaframe.plans.agreement_queries import AVG, WHOLE, averaged
from kappaframe.operators.selection import uncertain
from kappaframe.plans.registry import Tables, query

LABELLED = ["o_orderkey AS id", "o_orderstatus AS qid", f"{B.LABEL} AS label"]
_ROWS = B.select_sql(LABELLED, "orders")

# the published fold algorithm: labels by first appearance, allocation by dealing sorted labels into folds
_FOLDS = f"""r AS (SELECT id, qid, label, row_number() OVER (PARTITION BY qid ORDER BY id) - 1 AS pos FROM ({_ROWS})),
  f AS (SELECT qid, label, min(pos) AS f, count(*) AS n FROM r GROUP BY qid, label),
  c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f) AS k FROM f),
  dealt AS (SELECT r.qid, r.label, row_number() OVER (PARTITION BY r.qid ORDER BY c.k, r.pos) - 1 AS d FROM r JOIN c ON r.qid = c.qid AND r.label = c.label),
  alloc AS (SELECT qid, label, d % 10 AS fold, count(*) AS n FROM dealt GROUP BY qid, label, d % 10),
  cum AS (SELECT qid, label, fold, sum(n) OVER (PARTITION BY qid, label ORDER BY fold) - n AS lo,
      sum(n) OVER (PARTITION BY qid, label ORDER BY fold) AS hi FROM alloc),
  j AS (SELECT id, qid, label, row_number() OVER (PARTITION BY qid, label ORDER BY id) - 1 AS j FROM r),
  folds AS (SELECT j.id, j.qid, j.label, CAST(cum.fold AS INT) AS fold FROM j JOIN cum
      ON j.qid = cum.qid AND j.label = cum.label AND j.j >= cum.lo AND j.j < cum.hi)"""


def folded(t: Tables):
    return P.stratified_folds(B.derive(t.orders, LABELLED), "qid", "label", "id")


@query("stratified_folds", f"WITH {_FOLDS} SELECT id, qid, label, fold FROM folds")
def stratified_folds(t: Tables):
    return folded(t).select("id", "qid", "label", "fold")


@query(
    "fold_audit",
    f"WITH {_FOLDS} SELECT fold, {', '.join(f'count(*) FILTER (WHERE label = {l}) AS n_{l}' for l in range(1, 6))} FROM folds GROUP BY fold",
)
def fold_audit(t: Tables):
    return P.fold_audit(folded(t), "label", [str(l) for l in range(1, 6)])


_SOME_FOLD = "CASE WHEN o_custkey % 12 = 11 THEN NULL ELSE CAST(o_custkey % 12 AS INT) END AS fold"


@query(
    "fold_split",
    f"""SELECT id, fold, CASE WHEN fold = 8 THEN 'val' WHEN fold = 7 THEN 'test'
      WHEN fold IS NULL OR fold NOT IN (9, 10) THEN 'train' END AS split
    FROM ({B.select_sql(['o_orderkey AS id', _SOME_FOLD], 'orders')})""",
)
def fold_split(t: Tables):
    rows = B.derive(t.orders, ["o_orderkey AS id", _SOME_FOLD])
    return rows.withColumn("split", P.split_of_fold(F.col("fold"), 8, 7))


@query(
    "hashed_folds",
    f"SELECT o_orderkey AS id, CAST({mix_sql('o_orderkey', 3)} % 10 AS INT) AS fold FROM orders",
)
def hashed_folds(t: Tables):
    return P.hashed_folds(B.derive(t.orders, ["o_orderkey AS id"]), "id", seed=3)


@query(
    "held_out_rows",
    f"""SELECT o_orderkey AS id, CAST({mix_sql('o_orderkey', 2)} % 3 + 1 AS VARCHAR) AS label,
      CAST({mix_sql('o_orderkey', 2)} % 3 + 1 AS VARCHAR) AS score_to_predict, 10 AS fold FROM orders""",
)
def held_out_rows(t: Tables):
    return P.held_out(B.derive(t.orders, ["o_orderkey AS id"]), seed=2)


_DRAWN = f"SELECT id, qid, label, {mix_sql('id', 4)} AS h FROM ({_ROWS})"


@query(
    "random_split",
    f"""WITH r AS (SELECT id, qid, row_number() OVER (PARTITION BY qid ORDER BY h, id) AS k, count(*) OVER (PARTITION BY qid) AS n FROM ({_DRAWN})),
    s AS (SELECT *, floor(n * 0.8) AS a FROM r)
    SELECT id, qid, CASE WHEN k <= a THEN 'train' WHEN k <= a + floor((n - a) * 0.5) THEN 'val' ELSE 'test' END AS split FROM s""",
)
def random_split(t: Tables):
    return P.random_split(B.derive(t.orders, LABELLED), "qid", "id", seed=4).select("id", "qid", "split")


@query("sample_n", f"SELECT id, qid, label FROM ({_DRAWN}) ORDER BY h, id LIMIT 300")
def sample_n(t: Tables):
    return P.sample_n(B.derive(t.orders, LABELLED), 300, "id", seed=4)


@query(
    "sample_per_item",
    f"SELECT id, qid, label FROM ({_DRAWN}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY h, id) <= 100",
)
def sample_per_item(t: Tables):
    return P.sample_per_key(B.derive(t.orders, LABELLED), ["qid"], 100, "id", seed=4)


# ---------------------------------------------------------------- labels

_DETAIL = f"SELECT o_orderstatus AS qid, {B.DETAILED} AS label FROM orders"


@query(
    "label_ids",
    f"SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM ({_DETAIL}))",
)
def label_ids(t: Tables):
    return R.label_ids(B.derive(t.orders, [f"{B.DETAILED} AS label"]), "label")


@query(
    "label_share",
    f"""SELECT qid, label, n, ROUND(n / CAST(sum(n) OVER (PARTITION BY qid) AS DOUBLE), 6) AS share
    FROM (SELECT qid, label, count(*) AS n FROM ({_DETAIL}) GROUP BY qid, label)""",
)
def label_share(t: Tables):
    rows = B.derive(t.orders, ["o_orderstatus AS qid", f"{B.DETAILED} AS label"])
    return B.six(R.label_shares(rows, "qid", "label"), "share")


@query(
    "level_count",
    f"""SELECT 'segment' AS attr, count(DISTINCT segment) AS n_levels FROM ({B.PEOPLE})
    UNION ALL SELECT 'region', count(DISTINCT region) FROM ({B.PEOPLE})""",
)
def level_count(t: Tables):
    return R.level_counts(B.people(t), ["segment", "region"])


# ---------------------------------------------------------------- row sets


@query(
    "semi_by_ids",
    f"SELECT id, qid, label FROM ({_ROWS}) WHERE id IN (SELECT id FROM ({AVG}) WHERE avg0 NOT IN (1.0, 2.0, 3.0, 4.0, 5.0))",
)
def semi_by_ids(t: Tables):
    unsure = averaged(t).where(uncertain(F.col("avg0"), WHOLE))
    return R.keep_ids(B.derive(t.orders, LABELLED), unsure)


_REDONE = f"SELECT id, qid, label FROM ({AVG}) WHERE avg0 NOT IN (1.0, 2.0, 3.0, 4.0, 5.0)"


@query(
    "upsert_by_id",
    f"""SELECT id, qid, predict FROM (SELECT id, qid, avg AS predict FROM ({AVG}) WHERE id NOT IN (SELECT id FROM ({_REDONE}))
      UNION ALL SELECT id, qid, label AS predict FROM ({_REDONE}))""",
)
def upsert_by_id(t: Tables):
    rows = averaged(t)
    redone = rows.where(uncertain(F.col("avg0"), WHOLE)).select("id", "qid", F.col("label").alias("predict"))
    return R.upsert(rows.select("id", "qid", F.col("avg").alias("predict")), redone)


@query(
    "apply_corrections",
    f"""SELECT p.id, p.avg, coalesce(r.label, p.avg) AS modified FROM ({AVG}) p LEFT JOIN ({_REDONE}) r ON p.id = r.id""",
)
def apply_corrections(t: Tables):
    rows = averaged(t)
    fixes = rows.where(uncertain(F.col("avg0"), WHOLE)).select("id", F.col("label").alias("score"))
    return R.apply_corrections(rows.select("id", "avg"), fixes, "avg")


@query("dedup_rows", "SELECT DISTINCT text, lang, source FROM documents")
def dedup_rows(t: Tables):
    return R.distinct_rows(t.documents.select("text", "lang", "source"))


@query(
    "union_by_name",
    """SELECT doc_id AS id, lang, source, NULL AS role FROM documents
    UNION ALL SELECT conv_id, NULL, NULL, role FROM conversations UNION ALL SELECT item_id, NULL, NULL, NULL FROM benchmark""",
)
def union_by_name(t: Tables):
    from kappaframe.operators.fairness import stack

    return stack(
        [
            t.documents.select(F.col("doc_id").alias("id"), "lang", "source"),
            t.conversations.select(F.col("conv_id").alias("id"), "role"),
            t.benchmark.select(F.col("item_id").alias("id")),
        ]
    )


@query("id_union", "SELECT conv_id AS id FROM conversations UNION SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark")
def id_union(t: Tables):
    frames = [
        t.conversations.select(F.col("conv_id").alias("id")), t.labels.select(F.col("doc_id").alias("id")),
        t.benchmark.select(F.col("item_id").alias("id")),
    ]
    return R.union_of_ids(frames)


@query(
    "stack_versions",
    f"SELECT id, 'o_' || CAST(label AS VARCHAR) AS label1 FROM ({AVG}) UNION ALL SELECT id, CAST(avg AS VARCHAR) FROM ({AVG})",
)
def stack_versions(t: Tables):
    rows = averaged(t)
    return R.stack_versions(rows.select("id", F.col("label").alias("label1")), rows.select("id", F.col("avg").alias("label1")))


@query("drop_attributes", f"SELECT id, avg FROM ({AVG})")
def drop_attributes(t: Tables):
    """Attribute columns are dropped where present; missing names do not matter."""
    rows = averaged(t).drop("srace10", "dsex", "accom2", "iep", "lep", "person", "qid", "label", "avg0")
    return rows.drop(*[f"predict{e}" for e in B.EPOCHS])


@query(
    "item_scan",
    "SELECT o_orderkey AS id, o_orderstatus AS qid, substr(o_orderpriority, 1, 1) AS label FROM orders WHERE o_orderstatus = 'F'",
)
def item_scan(t: Tables):
    """One item, three columns: filter and column list reach the scan."""
    return B.derive(t.orders, ["o_orderkey AS id", "o_orderstatus AS qid", "substr(o_orderpriority, 1, 1) AS label"]).where(
        F.col("qid") == "F"
    )


# ---------------------------------------------------------------- ingest steps

_CELLS = [
    "o_orderkey AS id",
    "CASE o_custkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN 'null' ELSE o_orderpriority END AS answer",
    "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS code",
]


@query(
    "na_normalise",
    f"""SELECT id, CASE WHEN answer IN ('NA', '', 'null') THEN NULL ELSE answer END AS answer, coalesce(code, 0) AS code
    FROM ({B.select_sql(_CELLS, 'orders')})""",
)
def na_normalise(t: Tables):
    return normalise_missing(B.derive(t.orders, _CELLS))


@query(
    "int_coerce",
    """SELECT l_orderkey, CAST(trunc(l_quantity) AS BIGINT) AS l_quantity, CAST(trunc(l_extendedprice) AS BIGINT) AS l_extendedprice,
      CAST(trunc(0 - l_discount * 100) AS BIGINT) AS below, l_returnflag FROM lineitem""",
)
def int_coerce(t: Tables):
    rows = t.lineitem.select(
        "l_orderkey", "l_quantity", "l_extendedprice", (0 - F.col("l_discount") * 100).alias("below"), "l_returnflag"
    )
    return floats_to_integers(rows)


@query(
    "item_id",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'VH266510_' || CAST(2017 + 2 * (o_custkey % 2) AS VARCHAR)
      ELSE 'VH' || o_orderstatus END AS qid FROM orders""",
)
def item_id_query(t: Tables):
    rows = B.derive(
        t.orders,
        [
            "o_orderkey AS id",
            "CASE WHEN o_orderstatus = 'F' THEN 'VH266510' ELSE concat('VH', o_orderstatus) END AS accession",
            "concat(CAST(2017 + 2 * (o_custkey % 2) AS VARCHAR), '.0') AS year",
        ],
    )
    return rows.select("id", item_id(F.col("accession"), F.col("year")).alias("qid"))


@query(
    "rename_columns",
    "SELECT o_orderkey AS id, o_orderkey AS student_id, o_orderstatus AS qid, o_orderpriority AS text FROM orders",
)
def rename_columns(t: Tables):
    from kappaframe.constants import RENAMES

    raw = B.derive(
        t.orders, ["o_orderkey AS student_id", "o_orderstatus AS accession", "o_orderpriority AS predict_from"]
    )
    return raw.withColumnsRenamed(RENAMES).withColumn("id", F.col("student_id"))


_REGIME = [
    "o_orderkey AS id",
    f"{B.DETAILED} AS label",
    f"concat(substr({B.DETAILED}, 1, 1), '.0') AS score_to_predict",
    "CASE WHEN o_orderkey % 7 IN (4, 6) THEN '3' WHEN o_orderkey % 7 = 5 THEN '2' ELSE '1' END AS r_label",
]


@query(
    "label_regime",
    f"""WITH r AS ({B.select_sql(_REGIME, 'orders')})
    SELECT id, 0 AS regime, substr(score_to_predict, 1, 1) AS label, label AS label1, NULL AS eval_label FROM r
    UNION ALL SELECT id, 1, label, label, NULL FROM r
    UNION ALL SELECT id, 2, r_label, label, score_to_predict FROM r""",
)
def label_regime_query(t: Tables):
    from kappaframe.operators.fairness import stack

    rows = B.derive(t.orders, _REGIME)
    frames = [label_regime(rows, r).withColumn("regime", F.lit(r)).drop("score_to_predict", "r_label") for r in (0, 1, 2)]
    return stack([f.withColumn("eval_label", F.lit(None).cast("string")) if "eval_label" not in f.columns else f for f in frames])


_FIELDS = [
    "l_returnflag AS item",
    "l_orderkey * 8 + l_linenumber AS pos",
    "CASE WHEN l_returnflag = 'A' THEN 'NA' ELSE CAST(l_partkey AS VARCHAR) END AS part",
    "CASE WHEN l_returnflag = 'N' THEN 'NA' ELSE CAST(l_suppkey AS VARCHAR) END AS supplier",
    "l_linestatus AS state",
]


@query(
    "useful_fields",
    f"""WITH r AS (SELECT item, min_by(part, pos) AS part, min_by(supplier, pos) AS supplier, min_by(state, pos) AS state
      FROM ({B.select_sql(_FIELDS, 'lineitem')}) GROUP BY item)
    SELECT item, 0 AS position, 'item' AS field FROM r UNION ALL
    SELECT item, 1, 'part' FROM r WHERE part <> 'NA' UNION ALL
    SELECT item, 2, 'supplier' FROM r WHERE supplier <> 'NA' UNION ALL SELECT item, 3, 'state' FROM r WHERE state <> 'NA'""",
)
def useful_fields(t: Tables):
    return R.useful_fields(B.derive(t.lineitem, _FIELDS), "item", "pos")


_ELIMINATED = (
    "CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 9 = 1 THEN '0' WHEN l_partkey % 9 < 4 THEN '1 2 4' "
    "WHEN l_partkey % 9 < 6 THEN '1 2 3 4' WHEN l_partkey % 9 < 8 THEN '2 3' ELSE '1' END"
)
_PROFILE = ["l_returnflag AS qid", "l_linenumber % 5 AS score", f"{_ELIMINATED} AS answer"]


@query(
    "selection_profile",
    f"""WITH r AS (SELECT *, answer IS NULL OR answer = '0' AS e, coalesce(answer LIKE '%1%' AND answer LIKE '%2%' AND answer LIKE '%4%', false) AS f
      FROM ({B.select_sql(_PROFILE, 'lineitem')}))
    SELECT qid, score, count(*) AS n, ROUND(count(*) FILTER (WHERE e) / CAST(count(*) AS DOUBLE), 6) AS no_selection,
      ROUND(count(*) FILTER (WHERE f AND NOT e) / CAST(count(*) AS DOUBLE), 6) AS "right",
      ROUND(count(*) FILTER (WHERE NOT f AND NOT e) / CAST(count(*) AS DOUBLE), 6) AS wrong,
      ROUND(count(*) FILTER (WHERE NOT e AND answer NOT LIKE '%3%') / CAST(count(*) AS DOUBLE), 6) AS partial
    FROM r GROUP BY qid, score""",
)
def selection_profile(t: Tables):
    rows = B.derive(t.lineitem, _PROFILE)
    return B.six(R.selection_profile(rows, ["qid", "score"], F.col("answer")), "no_selection", "right", "wrong", "partial")
