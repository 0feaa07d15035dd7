"""Queries on examples, prompts, templates and batch inference."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaframe.constants import GROUP_TEXT
from kappaframe.functions import text as X
from kappaframe.functions.seeded import mix_sql
from kappaframe.operators import examples as E
from kappaframe.operators.inference import column_function, infer
from kappaframe.plans import bindings as B
from kappaframe.plans.registry import Tables, query

POOL = ["o_orderkey AS id", "o_orderstatus AS qid", f"{B.LABEL} AS label", "concat('answer ', CAST(o_custkey AS VARCHAR)) AS text"]
N = 2


def shots_sql(source: str, keys: list[str], n: int, seed: int, same: bool = False) -> str:
    """Every pool numbered by the seeded order; each row walks n slots from its own start, over itself."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    n = 5 * n if same else n
    own = "AND a.label = b.label" if same else ""
    return f"""pool AS (SELECT *, row_number() OVER (PARTITION BY {k}, label ORDER BY {mix_sql('id', seed)}, id) - 1 AS slot,
      count(*) OVER (PARTITION BY {k}, label) AS m FROM ({source})),
    wide AS (SELECT a.id AS query_id, {', '.join('b.' + c for c in keys)}, b.label, b.id AS example_id, b.text,
        (b.slot - {mix_sql('a.id', seed + 1)} % b.m + b.m) % b.m AS d FROM pool a JOIN pool b ON {on} {own} AND a.id <> b.id),
    shots AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY d) - 1 AS position FROM wide
      QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY d) <= {n})"""


def pool(t: Tables):
    return B.derive(t.orders, POOL)


# customers as responses, their nation as the item
PEERS = [
    "c_custkey AS id",
    "concat('nation ', CAST(c_nationkey AS VARCHAR)) AS qid",
    "CAST(c_custkey % 4 AS INT) AS label",
    "c_name AS text",
    "c_mktsegment AS segment",
]
_PEERS = B.select_sql(PEERS, "customer")


@query(
    "few_shot",
    f"WITH {shots_sql(_PEERS, ['qid'], N, 6)} SELECT query_id, qid, label, example_id, position, text FROM shots",
)
def few_shot(t: Tables):
    return E.few_shot(B.derive(t.customer, PEERS), N, seed=6)


@query(
    "few_shot_same_label",
    f"WITH {shots_sql(_PEERS, ['qid'], 1, 6, same=True)} SELECT query_id, qid, label, example_id, position, text FROM shots",
)
def few_shot_same_label(t: Tables):
    return E.few_shot(B.derive(t.customer, PEERS), 1, seed=6, same_label=True)


@query(
    "few_shot_group",
    f"WITH {shots_sql(_PEERS, ['qid', 'segment'], N, 6)} SELECT query_id, qid, segment, label, example_id, position, text FROM shots",
)
def few_shot_group(t: Tables):
    """Examples of the same group level only."""
    return E.few_shot(B.derive(t.customer, PEERS), N, keys=["qid", "segment"], seed=6)


@query(
    "few_shot_large_items",
    f"""WITH r AS ({B.select_sql(POOL, 'orders')}), m AS (SELECT qid, label, count(*) AS m FROM r GROUP BY qid, label),
    q AS (SELECT qid, sum(m) AS all_rows FROM m GROUP BY qid)
    SELECT m.qid, m.label, CAST((all_rows - m) * least({N}, m) + m * least({N}, m - 1) AS BIGINT) AS n, CAST(all_rows AS BIGINT) AS queries,
      CAST(0 AS BIGINT) AS own FROM m JOIN q ON m.qid = q.qid WHERE m > 1""",
)
def few_shot_large_items(t: Tables):
    """Three items over all orders: how often each label was drawn."""
    drawn = E.few_shot(pool(t), N, seed=6)
    return drawn.groupBy("qid", "label").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("queries"),
        F.count_if(F.col("query_id") == F.col("example_id")).alias("own"),
    )


@query(
    "example_prompts",
    f"""WITH {shots_sql(_PEERS, ['qid'], N, 6)}
    SELECT p.id, 'Score this response: ' || p.text || chr(10) || string_agg('Examples: ' || s.text || '. Score: ' || CAST(s.label AS VARCHAR),
      chr(10) ORDER BY s.label, s.position) AS prompt FROM pool p JOIN shots s ON p.id = s.query_id GROUP BY p.id, p.text""",
)
def example_prompts(t: Tables):
    rows = B.derive(t.customer, PEERS)
    line = X.example_line(F.col("text"), F.col("label"))
    lists = E.example_lists(E.few_shot(rows, N, seed=6), line).withColumnRenamed("query_id", "id")
    return rows.join(lists, "id").select("id", X.prompt(F.col("text"), examples=F.col("examples")).alias("prompt"))


@query(
    "shuffled_examples",
    f"""WITH {shots_sql(_PEERS, ['qid'], N, 6)}
    SELECT query_id, string_agg(CAST(example_id AS VARCHAR), ',' ORDER BY {mix_sql('example_id + query_id * 7', 9)}, example_id) AS ids
    FROM shots GROUP BY query_id""",
)
def shuffled_examples(t: Tables):
    drawn = E.few_shot(B.derive(t.customer, PEERS), N, seed=6)
    lists = E.example_lists(drawn, F.col("example_id").cast("string"), shuffle_seed=9)
    return lists.select("query_id", F.array_join("examples", ",").alias("ids"))


_PLAN = {"F": ["3", "4"], "O": ["5"]}
_OVER = [
    "o_orderkey AS id", "o_orderstatus AS qid", "substr(o_orderpriority, 1, 1) AS label",
    "concat('answer ', CAST(o_custkey AS VARCHAR)) AS text",
]


@query(
    "oversample",
    f"""WITH r AS ({B.select_sql(_OVER, 'orders')}),
    pool AS (SELECT qid, id, label, text, row_number() OVER (PARTITION BY qid ORDER BY {mix_sql('id', 9)}, id) - 1 AS slot,
      count(*) OVER (PARTITION BY qid) AS m FROM r WHERE (qid = 'F' AND label IN ('3', '4')) OR (qid = 'O' AND label = '5')),
    s AS (SELECT DISTINCT qid, m FROM pool),
    f AS (SELECT r.*, CASE WHEN r.qid IN ('F', 'O') AND r.label IN ('1', '2') AND {mix_sql('r.id', 8)} / 2147483647.0::DOUBLE > 0.9
      THEN {mix_sql('r.id', 10)} % s.m END AS slot FROM r LEFT JOIN s ON r.qid = s.qid)
    SELECT f.id, f.qid, coalesce(p.id, f.id) AS source_id, coalesce(p.label, f.label) AS label, coalesce(p.text, f.text) AS text,
      CASE WHEN p.id IS NULL THEN 0 ELSE 1 END AS replaced FROM f LEFT JOIN pool p ON f.qid = p.qid AND f.slot = p.slot""",
)
def oversample(t: Tables):
    return E.oversample(B.derive(t.orders, _OVER), seed=8, plan=_PLAN, lowest=["1", "2"])


@query(
    "mine_pairs",
    f"""WITH {shots_sql(_PEERS, ['qid'], N, 6)},
    c AS (SELECT s.*, p.label AS query_label, {mix_sql('s.query_id', 12)} / 2147483647.0::DOUBLE > 0.5 AS want,
      {mix_sql('s.example_id + s.query_id * 7', 13)} AS h FROM shots s JOIN pool p ON s.query_id = p.id),
    g AS (SELECT query_id, query_label, want,
      max_by(example_id, (position, label, example_id)) FILTER (WHERE label = query_label) AS same,
      min_by(example_id, (position, label, example_id)) FILTER (WHERE label <> query_label) AS other,
      min_by(example_id, (h, example_id)) AS anyone FROM c GROUP BY query_id, query_label, want),
    x AS (SELECT query_id, query_label, coalesce(CASE WHEN want THEN same ELSE other END, anyone) AS partner_id FROM g)
    SELECT x.query_id, x.query_label, x.partner_id, p.label AS partner_label, CASE WHEN p.label = x.query_label THEN 1 ELSE 0 END AS target
    FROM x JOIN pool p ON x.partner_id = p.id""",
)
def mine_pairs(t: Tables):
    rows = B.derive(t.customer, PEERS)
    drawn = E.few_shot(rows, N, seed=6)
    labels = rows.select(F.col("id").alias("query_id"), F.col("label").alias("query_label"))
    return E.training_pairs(drawn.join(labels, "query_id"), seed=12)


# ---------------------------------------------------------------- text


@query(
    "closed_form_text",
    f"""SELECT id, CASE WHEN toxic IS NULL THEN text ELSE text || '. toxic ' || CAST(toxic AS VARCHAR) END AS text FROM ({B.RESPONSES_SQL})""",
)
def closed_form_text(t: Tables):
    context = F.concat(F.lit("toxic "), F.col("toxic").cast("string"))
    return B.responses(t).select("id", X.with_closed_form(F.col("text"), context).alias("text"))


_LEVELS = {"srace10": 7, "dsex": 2, "accom2": 2, "iep": 2, "lep": 2}


def _book(attribute: str, code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in GROUP_TEXT[attribute].items()) + " END"


_OWN = " || ', ' || ".join(_book(a, f"doc_id % {n + 1}") for a, n in _LEVELS.items())
_BLIND = " || ', ' || ".join(_book(a, f"({mix_sql('doc_id', 20 + i)} % {n} + 1)") for i, (a, n) in enumerate(_LEVELS.items()))


@query(
    "group_text",
    f"SELECT doc_id AS id, {_OWN} AS own, {_BLIND} AS blind FROM documents",
)
def group_text(t: Tables):
    levels = {a: F.col("doc_id") % (n + 1) for a, n in _LEVELS.items()}
    return t.documents.select(
        F.col("doc_id").alias("id"),
        X.group_text(levels).alias("own"),
        X.group_text(levels, blind_id=F.col("doc_id"), seed=20).alias("blind"),
    )


@query(
    "prompt_text",
    f"""SELECT doc_id AS id, 'Score this response: ' || text || 'question: Is this ' || lang || '?' || chr(10) || 'Group: ' || {_OWN} AS prompt,
      'Examples: ' || source || '. Score: 1' || chr(10) || text || '. Score: ' AS generative FROM documents""",
)
def prompt_text(t: Tables):
    levels = {a: F.col("doc_id") % (n + 1) for a, n in _LEVELS.items()}
    question = F.concat(F.lit("Is this "), F.col("lang"), F.lit("?"))
    line = F.array(X.example_line(F.col("source"), F.lit(1)))
    return t.documents.select(
        F.col("doc_id").alias("id"),
        X.prompt(F.col("text"), question=question, group=X.group_text(levels)).alias("prompt"),
        X.prompt(F.col("text"), examples=line, generative=True).alias("generative"),
    )


@query(
    "template_fill",
    """WITH r AS (SELECT c.conv_id, c.turn, c.role, c.text, CASE c.turn % 4 WHEN 0 THEN 'TRUE FALSE' WHEN 1 THEN 'FALSE TRUE' WHEN 2 THEN 'FALSE FALSE' ELSE NULL END AS flags FROM conversations c)
    SELECT conv_id, turn, 'Role ' || role || '. Answer: ' || coalesce(CASE flags WHEN 'TRUE FALSE' THEN 'Selection A' WHEN 'FALSE TRUE' THEN 'Selection B'
      WHEN 'FALSE FALSE' THEN 'Selection None' END, '') || ' because ' || text AS prompt FROM r""",  # noqa: E501
)
def template_fill(t: Tables):
    """A tagged block per role cut out of a template document, then filled per row."""
    roles = t.conversations.select("role").distinct()
    block = F.concat(
        F.lit("<"), "role", F.lit(">Role "), "role", F.lit(". Answer: {{student_selection}} because TEXT2</"), "role", F.lit(">")
    )
    # one block per role of the table
    document = roles.agg(F.array_join(F.sort_array(F.collect_list(block)), "\n").alias("document"))
    flags = F.expr(
        "CASE turn % 4 WHEN 0 THEN 'TRUE FALSE' WHEN 1 THEN 'FALSE TRUE' WHEN 2 THEN 'FALSE FALSE' ELSE NULL END"
    )
    rows = t.conversations.withColumn("selection", X.selection_words(flags)).join(document, F.lit(True))
    template = X.tagged_block(F.col("document"), F.col("role"))
    prompt = X.fill(template, {"{{student_selection}}": F.col("selection"), "TEXT2": F.col("text")})
    return rows.select("conv_id", "turn", prompt.alias("prompt"))


def length_grader():
    """Stands for a model: grades a text by its length."""
    return lambda texts: [f"Score {1 + len(x) % 6}: ok" for x in texts]


@query(
    "batch_infer",
    "SELECT doc_id, 'Score ' || CAST(1 + length(text) % 6 AS VARCHAR) || ': ok' AS completion, CAST(1 + length(text) % 6 AS VARCHAR) AS code FROM documents",  # noqa: E501
)
def batch_infer(t: Tables):
    done = infer(t.documents, "text", length_grader, "completion", T.StringType(), ["doc_id"])
    return done.withColumn("code", X.score_after_word(F.col("completion")))


@query("column_udf", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def column_udf(t: Tables):
    return t.documents.select("doc_id", column_function(lambda s: s.str.len(), "bigint", "text").alias("n"))
