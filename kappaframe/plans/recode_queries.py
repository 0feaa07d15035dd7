"""Queries on recoded answers and on the training table built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kappaframe.constants import REDUCED_LABELS
from kappaframe.functions import recode as C
from kappaframe.functions.labels import lookup
from kappaframe.operators.tables import answer_distribution
from kappaframe.plans import bindings as B
from kappaframe.plans.registry import Tables, query
from kappaframe.plans.training_table import training_table

STEPS = (1, 5, 25, 125)
SLOTS = [
    *[f"CAST(CAST(floor(l_partkey / {c}) AS BIGINT) % 5 AS INT) AS source{i}" for i, c in enumerate(STEPS, 1)],
    *[f"CAST(CAST(floor((l_suppkey + l_partkey * 3) / {c}) AS BIGINT) % 5 AS INT) AS target{i}" for i, c in enumerate(STEPS, 1)],
    "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber % 3 AS INT) END AS grade",
    "CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE concat('part ', CAST(l_partkey AS VARCHAR)) END AS answer",
]
FLAGS = [
    *[f"CAST(CAST(floor(l_partkey / {c}) AS BIGINT) % 2 AS INT) AS sel{i}" for i, c in enumerate((1, 2, 4, 8), 1)],
    *[f"CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(CAST(floor(l_suppkey / {c}) AS BIGINT) % 2 AS INT) END AS sel_b{i}"
      for i, c in enumerate((1, 2), 1)],
    *[f"CAST(CAST(floor(l_suppkey / {c}) AS BIGINT) % 2 AS INT) AS out_b{i}" for i, c in enumerate((4, 8), 1)],
]
AGE = [
    "CASE l_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'c(1, 2)' WHEN 2 THEN 'c(2, 1)' WHEN 3 THEN 'c(NA, 2)' WHEN 4 THEN 'c(1, 1)' "
    "WHEN 5 THEN 'c(2, 2)' WHEN 6 THEN '1' ELSE 'c(2, NA)' END AS part_a",
    "CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'TRUE FALSE' WHEN 2 THEN 'FALSE TRUE' WHEN 3 THEN 'TRUE TRUE' ELSE 'FALSE FALSE' END AS part_b",
    "CASE l_partkey % 3 WHEN 0 THEN 'FALSE FALSE' WHEN 1 THEN 'FALSE TRUE' ELSE NULL END AS struck",
]
_ONE = ["FALSE FALSE FALSE FALSE", "TRUE FALSE FALSE FALSE", "FALSE TRUE FALSE FALSE", "FALSE FALSE TRUE FALSE",
        "FALSE FALSE FALSE TRUE", "TRUE FALSE TRUE FALSE"]
_OUT = ["FALSE FALSE FALSE FALSE", "TRUE FALSE FALSE FALSE", "TRUE TRUE FALSE TRUE", "TRUE TRUE TRUE TRUE"]
SLOPE = [
    "CASE l_partkey % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_ONE)) + " END AS selected",
    "CASE l_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_OUT)) + " ELSE NULL END AS eliminated",
]
_ALL = B.select_sql(["l_partkey", "l_suppkey", *SLOTS, *FLAGS, *AGE, *SLOPE], "lineitem")

WORD = "CASE coalesce(grade, 0) WHEN 0 THEN 'empty' WHEN 1 THEN 'incorrect' ELSE 'correct' END"


def _card(slot: str, cards: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(cards, 1))
    return f"CASE {slot} {whens} ELSE 'nan' END"


def _placed(place: int, slots: int, cards: list[str], default: str) -> str:
    whens = " ".join(f"WHEN target{j} = {place} THEN {_card(f'source{j}', cards)}" for j in range(slots, 0, -1))
    return f"CASE {whens} ELSE '{default}' END"


DIV = ["3", "4", "6", "7"]
_DIV_ALL = " AND ".join("(" + " OR ".join(f"target{j} = {p}" for j in range(1, 5)) + ")" for p in range(1, 5))
DIV_SQL = f"""CASE WHEN {_DIV_ALL} THEN {_placed(1, 4, DIV, 'nan1')} || '/' || {_placed(2, 4, DIV, 'nan2')} || ' * ' ||
  {_placed(3, 4, DIV, 'nan3')} || '/' || {_placed(4, 4, DIV, 'nan4')} ELSE 'nan1/nan2 * nan3/nan4' END"""
CARDS = ["17", "27", "54", "62"]
CARD_SQL = f"{_placed(1, 3, CARDS, 'nan1')} || ' * ' || {_placed(2, 3, CARDS, 'nan2')} || ' - ' || {_placed(3, 3, CARDS, 'nan3')}"
LETTERS = ["w", "x", "y", "z"]
LEAST_SQL = f"""'(' || {_placed(1, 4, LETTERS, 'nan1')} || ' * ' || {_placed(2, 4, LETTERS, 'nan2')} || ') - (' ||
  {_placed(3, 4, LETTERS, 'nan3')} || ' + ' || {_placed(4, 4, LETTERS, 'nan4')} || ')'"""
GEO_SQL = f"'A is ' || {WORD} || ': ' || coalesce(answer, '0') || '; B is ' || {WORD} || ': ' || coalesce(selected, '0')"
CHANCE_A_SQL = f"""'Part A is ' || {WORD} || ': ' || CASE WHEN sel1 + sel2 + sel3 + sel4 = 0 THEN 'No answer' ELSE
  CASE WHEN sel1 = 1 THEN 'Null' ELSE '' END || CASE WHEN sel2 = 1 THEN '1/8' ELSE '' END ||
  CASE WHEN sel3 = 1 THEN '3/8' ELSE '' END || CASE WHEN sel4 = 1 THEN '5/8' ELSE '' END END"""
CHANCE_A_FIXED_SQL = f"""'Part A is ' || {WORD} || ': ' || CASE WHEN sel1 + sel2 + sel3 + sel4 = 0 THEN 'No answer' ELSE
  concat_ws(', ', CASE WHEN sel1 = 1 THEN '1/8' END, CASE WHEN sel2 = 1 THEN '3/8' END, CASE WHEN sel3 = 1 THEN '5/8' END,
  CASE WHEN sel4 = 1 THEN '6/8' END) END"""
_B1, _B2 = "coalesce(sel_b1, 0)", "coalesce(sel_b2, 0)"
CHANCE_B_SQL = f"""CASE WHEN {_B1} = 1 AND {_B2} = 0 THEN 'Yes, the probability will change' WHEN {_B1} = 0 AND {_B2} = 1
  THEN 'No, the probability won''t change' WHEN {_B1} = 1 THEN 'Not sure ' ELSE 'Not Sure ' END || ', ' || coalesce(answer, 'I don''t know')"""
CHANCE_B_FIXED_SQL = f"""CASE WHEN {_B1} = 1 AND {_B2} = 0 THEN 'Yes, the probability will change' WHEN {_B1} = 0 AND {_B2} = 1
  THEN 'No, the probability won''t change' WHEN {_B1} = 1 THEN 'Not sure ' WHEN out_b1 = 1 AND out_b2 = 0 THEN 'No, the probability won''t change'
  WHEN out_b2 = 1 AND out_b1 = 0 THEN 'Yes, the probability will change' ELSE 'Not Sure ' END || ', ' || coalesce(answer, 'I don''t know')"""
_A = "(coalesce(part_b, '') LIKE 'TRUE%')"
_Z = "(coalesce(part_b, '') LIKE '% TRUE' AND coalesce(struck, '') NOT LIKE '% TRUE')"
AGE_TEXT_SQL = f"""'I choose ' || CASE WHEN {_A} AND {_Z} THEN 'Aand B' WHEN {_A} THEN 'A' WHEN {_Z} THEN 'B' ELSE 'No Idea. ' END"""
AGE_TEXT_OLD_SQL = f"""CASE WHEN {_A} AND {_Z} THEN 'Student choose A, Student choose B' WHEN {_A} THEN 'Student choose A'
  WHEN {_Z} THEN 'Student choose B' ELSE 'No answer' END"""
AGE_EST_SQL = f"CASE WHEN {_A} AND NOT {_Z} THEN 1 ELSE 0 END"
_PART_A = """CASE coalesce(part_a, '') WHEN 'c(1, 2)' THEN '4 older' WHEN 'c(2, 1)' THEN '8 younger' WHEN 'c(NA, 2)' THEN 'Null older'
  WHEN 'c(1, 1)' THEN '4 younger' WHEN 'c(2, 2)' THEN '8 older' WHEN '1' THEN '4 Null' WHEN 'c(2, NA)' THEN '8 Null' ELSE 'Null Null' END"""
AGE_A_SQL = f"'Part A is ' || {WORD} || ': ' || {_PART_A}"
AGE_FULL_SQL = f"""CASE WHEN {_A} AND {_Z} THEN 'A, B' WHEN {_A} THEN 'A' WHEN {_Z} THEN 'B' ELSE 'No Idea. ' END || '. Part A is ' || {WORD}"""
_STATEMENT = """CASE l_partkey % 6 WHEN 1 THEN 'The slope of the lines must be equal.' WHEN 2 THEN 'The y-intercepts of the lines must be equal.'
  WHEN 3 THEN 'The slopes of the lines cannot be equal.' WHEN 4 THEN 'The y-intercepts of the lines cannot be equal.' WHEN 5 THEN NULL
  ELSE CASE l_suppkey % 5 WHEN 1 THEN 'I choose B and C and D' WHEN 2 THEN 'I choose C' WHEN 3 THEN 'Not sure.' ELSE 'I choose A and B and C and D' END END"""
SLOPE_SQL = f"{_STATEMENT} || ' ' || coalesce(answer, 'No idea.')"
SLOPE_OLD_SQL = "'s: [' || coalesce(selected, '0') || '], e: [' || coalesce(eliminated, '0') || ']'"


def cells(t: Tables):
    return B.derive(t.lineitem, ["l_partkey", "l_suppkey", *SLOTS, *FLAGS, *AGE, *SLOPE])


def slots(n: int):
    return [(F.col(f"source{i}"), F.col(f"target{i}")) for i in range(1, n + 1)]


def counted(rows, *columns):
    """Answers with their number: small output from every row of the table."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


@query("recode_div", f"SELECT 'A ' || {WORD} || ':' || {DIV_SQL} AS context, count(*) AS n FROM ({_ALL}) GROUP BY 1")
def recode_div(t: Tables):
    text = C.graded_part("A", F.col("grade"), C.division(slots(4)))
    return counted(cells(t).select(text.alias("context")), "context")


@query("recode_4card", f"SELECT {CARD_SQL} AS context, count(*) AS n FROM ({_ALL}) GROUP BY 1")
def recode_4card(t: Tables):
    return counted(cells(t).select(C.four_cards(slots(3)).alias("context")), "context")


@query("recode_least", f"SELECT {LEAST_SQL} AS context, count(*) AS n FROM ({_ALL}) GROUP BY 1")
def recode_least(t: Tables):
    return counted(cells(t).select(C.least_value(slots(4)).alias("context")), "context")


@query("recode_geo", f"SELECT {GEO_SQL} AS context, count(*) AS n FROM ({_ALL}) GROUP BY 1")
def recode_geo(t: Tables):
    text = C.two_graded_parts(F.col("grade"), F.col("answer"), F.col("grade"), F.col("selected"))
    return counted(cells(t).select(text.alias("context")), "context")


@query(
    "recode_8card",
    f"""SELECT {CHANCE_A_SQL} AS part_a, {CHANCE_A_FIXED_SQL} AS part_a_fixed, {CHANCE_B_SQL} AS part_b, {CHANCE_B_FIXED_SQL} AS part_b_fixed,
    count(*) AS n FROM ({_ALL}) GROUP BY 1, 2, 3, 4""",
)
def recode_8card(t: Tables):
    selected = [F.col(f"sel{i}") for i in range(1, 5)]
    b = [F.col(c) for c in ("sel_b1", "sel_b2", "answer", "out_b1", "out_b2")]
    rows = cells(t).select(
        C.chance_part_a(F.col("grade"), selected).alias("part_a"),
        C.chance_part_a(F.col("grade"), selected, fixed=True).alias("part_a_fixed"),
        C.chance_part_b(*b).alias("part_b"),
        C.chance_part_b(*b, fixed=True).alias("part_b_fixed"),
    )
    return counted(rows, "part_a", "part_a_fixed", "part_b", "part_b_fixed")


@query(
    "recode_halves",
    f"""SELECT 's: [' || CAST(sel1 AS VARCHAR) || ', ' || CAST(sel2 AS VARCHAR) || '], e: [' || CAST(sel3 AS VARCHAR) || ', ' ||
    CAST(sel4 AS VARCHAR) || ']' AS context, count(*) AS n FROM ({_ALL}) GROUP BY 1""",
)
def recode_halves(t: Tables):
    return counted(cells(t).select(C.halves([F.col(f"sel{i}") for i in range(1, 5)]).alias("context")), "context")


@query(
    "recode_age",
    f"""SELECT {AGE_TEXT_SQL} AS text1, {AGE_TEXT_OLD_SQL} AS text1_old, {AGE_EST_SQL} AS est, {AGE_A_SQL} AS context,
    {AGE_FULL_SQL} AS whole, {AGE_TEXT_SQL} || '. ' || coalesce(answer, '0') AS text, count(*) AS n FROM ({_ALL}) GROUP BY 1, 2, 3, 4, 5, 6""",
)
def recode_age(t: Tables):
    b = F.col("part_b"), F.col("struck")
    rows = cells(t).select(
        C.age_choice_text(*b).alias("text1"),
        C.age_choice_text(*b, variant="0604").alias("text1_old"),
        C.age_evidence(*b).alias("est"),
        C.age_part_a(F.col("grade"), F.col("part_a")).alias("context"),
        C.age_full_context(F.col("grade"), F.col("part_a"), *b).alias("whole"),
        C.joined_text(C.age_choice_text(*b), F.col("answer")).alias("text"),
    )
    return counted(rows, *rows.columns)


@query(
    "recode_slope",
    f"SELECT {SLOPE_SQL} AS text, {SLOPE_OLD_SQL} AS context_old, count(*) AS n FROM ({_ALL}) GROUP BY 1, 2",
)
def recode_slope(t: Tables):
    c = F.col("selected"), F.col("eliminated"), F.col("answer")
    rows = cells(t).select(C.slope_choice(*c).alias("text"), C.slope_choice(*c, variant="0604").alias("context_old"))
    return counted(rows, "text", "context_old")


@query(
    "reverse_label",
    f"""SELECT label, CASE WHEN label IN ('3', '2A') THEN '3' WHEN label = '2B' THEN '2' WHEN label IN ('1A', '1B') THEN '1' END AS r_label,
    count(*) AS n FROM (SELECT {B.DETAILED} AS label FROM orders) GROUP BY 1, 2""",
)
def reverse_label(t: Tables):
    rows = B.derive(t.orders, [f"{B.DETAILED} AS label"])
    return counted(rows.withColumn("r_label", lookup(C.reversed_map(REDUCED_LABELS), F.col("label"))), "label", "r_label")


@query("answer_distribution", f"SELECT {LEAST_SQL} AS context, count(*) AS n FROM ({_ALL}) WHERE grade = 2 GROUP BY 1")
def answer_distribution_query(t: Tables):
    rows = cells(t).withColumn("context", C.least_value(slots(4)))
    return answer_distribution(rows, F.col("grade") == 2, ["context"])


# ---------------------------------------------------------------- the whole ingest

ITEMS = ["VH134067", "VH266015", "VH302907", "VH507804", "VH139380", "VH304954", "VH525628", "VH266510", "VH269384", "VH271613"]
_K, _C = "o_orderkey", "o_custkey"
RAW = [
    "o_orderkey AS pos",
    "o_orderkey AS student_id",
    "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(ITEMS)) + " END AS accession",
    "CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE concat('because ', o_orderpriority) END AS predict_from",
    "CAST(2017 + 2 * (o_custkey % 2) AS VARCHAR) AS year",
    "CAST(1 + o_custkey % 3 AS VARCHAR) AS score",
    "CAST(CAST(o_custkey % 3 AS INT) AS VARCHAR) AS pta_rtr1",
    "CASE o_custkey % 5 WHEN 0 THEN '1A' WHEN 1 THEN '1B' WHEN 2 THEN '2A' WHEN 3 THEN '2B' ELSE '3' END AS ptb_rtr1",
    "CAST(CAST(o_orderkey % 3 AS INT) AS VARCHAR) AS ptc_rtr1",
    *[f"CAST(CAST(CAST(floor({_C} / {c}) AS BIGINT) % 5 AS INT) AS VARCHAR) AS source{i}" for i, c in enumerate(STEPS, 1)],
    *[f"CAST(CAST((CAST(floor({_K} / 10) AS BIGINT) + {i} * {_C}) % 5 AS INT) AS VARCHAR) AS target{i}" for i in range(1, 5)],
    *[f"CAST(CAST(CAST(floor({_C} / {c}) AS BIGINT) % 2 AS INT) AS VARCHAR) AS selected{i}" for i, c in enumerate((1, 2, 4, 8), 1)],
    f"CAST(CAST({_C} % 2 AS INT) AS VARCHAR) AS selected_b1",
    f"CAST(CAST(CAST(floor({_C} / 2) AS BIGINT) % 2 AS INT) AS VARCHAR) AS selected_b2",
    "'TRUE FALSE FALSE FALSE' AS selected",
    "'FALSE TRUE FALSE FALSE' AS eliminated",
    "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE '1 2 4' END AS eliminations",
    "CASE o_custkey % 3 WHEN 0 THEN 'c(1, 2)' WHEN 1 THEN 'c(2, 1)' ELSE NULL END AS partA_response_val",
    "CASE o_custkey % 4 WHEN 0 THEN 'TRUE FALSE' WHEN 1 THEN 'FALSE TRUE' WHEN 2 THEN 'TRUE TRUE' ELSE 'FALSE FALSE' END AS partB_response_val",
    "'FALSE FALSE' AS partB_eliminations",
    "o_orderpriority AS parsed_xml_v1",
    "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS parsed_xml_v2",
    "o_orderstatus AS parsed_xml_v3",
]
_RAW = B.select_sql(RAW, "orders")


def _flag(column: str) -> str:
    return f"CASE {column} WHEN '0' THEN 'empty' WHEN '1' THEN 'incorrect' ELSE 'correct' END"


def _tcard(slot: str, cards: list[str]) -> str:
    return f"CASE {slot} " + " ".join(f"WHEN '{i}' THEN '{c}'" for i, c in enumerate(cards, 1)) + " ELSE 'nan' END"


def _tplaced(place: int, n: int, cards: list[str], default: str) -> str:
    whens = " ".join(f"WHEN target{j} = '{place}' THEN {_tcard(f'source{j}', cards)}" for j in range(n, 0, -1))
    return f"CASE {whens} ELSE '{default}' END"


_TDIV_ALL = " AND ".join("(" + " OR ".join(f"target{j} = '{p}'" for j in range(1, 5)) + ")" for p in range(1, 5))
_TDIV = f"""CASE WHEN {_TDIV_ALL} THEN {_tplaced(1, 4, DIV, '')} || '/' || {_tplaced(2, 4, DIV, '')} || ' * ' || {_tplaced(3, 4, DIV, '')} ||
  '/' || {_tplaced(4, 4, DIV, '')} ELSE 'nan1/nan2 * nan3/nan4' END"""
_TCARD = f"{_tplaced(1, 3, CARDS, 'nan1')} || ' * ' || {_tplaced(2, 3, CARDS, 'nan2')} || ' - ' || {_tplaced(3, 3, CARDS, 'nan3')}"
_TLEAST = f"""'(' || {_tplaced(1, 4, LETTERS, 'nan1')} || ' * ' || {_tplaced(2, 4, LETTERS, 'nan2')} || ') - (' ||
  {_tplaced(3, 4, LETTERS, 'nan3')} || ' + ' || {_tplaced(4, 4, LETTERS, 'nan4')} || ')'"""
_TCH_A = f"""'Part A is ' || {_flag('pta_rtr1')} || ': ' || CASE WHEN selected1 || selected2 || selected3 || selected4 = '0000' THEN 'No answer' ELSE
  CASE WHEN selected1 = '1' THEN 'Null' ELSE '' END || CASE WHEN selected2 = '1' THEN '1/8' ELSE '' END ||
  CASE WHEN selected3 = '1' THEN '3/8' ELSE '' END || CASE WHEN selected4 = '1' THEN '5/8' ELSE '' END END"""
_TCH_B = """CASE selected_b1 || selected_b2 WHEN '10' THEN 'Yes, the probability will change' WHEN '01' THEN 'No, the probability won''t change'
  WHEN '11' THEN 'Not sure ' ELSE 'Not Sure ' END || ', ' || coalesce(predict_from, 'I don''t know')"""
_TAGE = "CASE partB_response_val WHEN 'TRUE TRUE' THEN 'I choose Aand B' WHEN 'TRUE FALSE' THEN 'I choose A' WHEN 'FALSE TRUE' THEN 'I choose B' ELSE 'I choose No Idea. ' END"  # noqa: E501
_TAGE_A = f"""'Part A is ' || {_flag('pta_rtr1')} || ': ' || CASE coalesce(partA_response_val, '') WHEN 'c(1, 2)' THEN '4 older'
  WHEN 'c(2, 1)' THEN '8 younger' ELSE 'Null Null' END"""
TRAINING_SQL = f"""WITH raw AS ({_RAW}),
 q AS (SELECT *, CASE WHEN accession = 'VH266510' THEN 'VH266510_' || year ELSE accession END AS qid FROM raw),
 c AS (SELECT pos, student_id AS id, qid,
  CASE qid WHEN 'VH266015' THEN ptb_rtr1 WHEN 'VH302907' THEN pta_rtr1 WHEN 'VH507804' THEN ptb_rtr1 WHEN 'VH269384' THEN ptb_rtr1
    WHEN 'VH271613' THEN ptb_rtr1 ELSE score END AS label,
  CASE qid WHEN 'VH266510_2019' THEN 'The slope of the lines must be equal. ' || coalesce(predict_from, 'No idea.')
    WHEN 'VH269384' THEN {_TCH_B} WHEN 'VH271613' THEN {_TAGE} || '. ' || coalesce(predict_from, '0') ELSE predict_from END AS text,
  CASE qid WHEN 'VH269384' THEN {_TCH_A} WHEN 'VH271613' THEN {_TAGE} END AS text1,
  CASE qid WHEN 'VH269384' THEN {_TCH_B} WHEN 'VH271613' THEN predict_from END AS text2,
  CASE qid WHEN 'VH266015' THEN 'A ' || {_flag('pta_rtr1')} || ':' || {_TDIV}
    WHEN 'VH302907' THEN CASE WHEN ptb_rtr1 <> '3' THEN 'A is ' || {_flag("CASE WHEN ptb_rtr1 IN ('1', '2') THEN ptb_rtr1 ELSE '0' END")} || ': ' || coalesce(parsed_xml_v2, '0') || '; B is ' || {_flag('ptc_rtr1')} || ': ' || parsed_xml_v3 END
    WHEN 'VH507804' THEN 'A ' || {_flag('pta_rtr1')} || ':' || {_TCARD}
    WHEN 'VH139380' THEN parsed_xml_v1 WHEN 'VH304954' THEN parsed_xml_v2 WHEN 'VH525628' THEN {_TLEAST}
    WHEN 'VH266510_2017' THEN eliminations WHEN 'VH266510_2019' THEN '' WHEN 'VH269384' THEN {_TCH_A} WHEN 'VH271613' THEN {_TAGE_A} END AS context_all,
  CASE WHEN qid = 'VH271613' THEN CASE WHEN ptb_rtr1 IN ('3', '2A') THEN '3' WHEN ptb_rtr1 = '2B' THEN '2' ELSE '1' END END AS r_label,
  CASE WHEN qid = 'VH271613' THEN CASE WHEN partB_response_val = 'TRUE FALSE' THEN 1 ELSE 0 END END AS est_score FROM q),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS rp FROM c),
 f AS (SELECT qid, label, min(rp) AS f FROM r GROUP BY qid, label),
 k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f) AS k FROM f),
 dealt AS (SELECT r.qid, r.label, row_number() OVER (PARTITION BY r.qid ORDER BY k.k, r.rp) - 1 AS d FROM r JOIN k ON r.qid = k.qid AND r.label = k.label),
 alloc AS (SELECT qid, label, d % 10 AS fold, count(*) AS n FROM dealt GROUP BY qid, label, d % 10),
 cum AS (SELECT qid, label, fold, sum(n) OVER (PARTITION BY qid, label ORDER BY fold) - n AS lo, sum(n) OVER (PARTITION BY qid, label ORDER BY fold) AS hi FROM alloc),
 j AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY pos) - 1 AS j FROM c)
SELECT j.id, j.qid, j.label, j.text, j.text1, j.text2, j.context_all, j.r_label, j.est_score, CAST(cum.fold AS INT) AS fold FROM j JOIN cum
  ON j.qid = cum.qid AND j.label = cum.label AND j.j >= cum.lo AND j.j < cum.hi"""


@query("training_table", TRAINING_SQL)
def training_table_query(t: Tables):
    """The ingest from raw cells to the folded training table, all items in one projection."""
    raw = B.derive(t.orders, RAW).withColumnsRenamed({"selected_b1": "selected1.1", "selected_b2": "selected2.1"})
    return training_table(raw)
