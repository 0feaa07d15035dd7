"""Queries on neighbours, clusters and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kappaframe.functions import vectors as V
from kappaframe.functions.seeded import mix_sql
from kappaframe.operators import cells
from kappaframe.operators import clusters as K
from kappaframe.operators import neighbours as N
from kappaframe.operators.embedding import embed_text, pool_tokens
from kappaframe.operators.tables import fit_share
from kappaframe.plans import bindings as B
from kappaframe.plans.registry import Tables, query

TOP = 6
_V = B.VECTORS_SQL
_COS = "ROUND(list_cosine_similarity(CAST(a.emb AS DOUBLE[]), CAST(b.emb AS DOUBLE[])), 12)"


def edges_sql(queries: str, pool: str, k: int, condition: str = "TRUE") -> str:
    return f"""SELECT qid, query_id, neighbor_id, CAST(rn AS INT) AS rank, sim FROM (
      SELECT a.qid, a.id AS query_id, b.id AS neighbor_id, {_COS} AS sim,
        row_number() OVER (PARTITION BY a.id ORDER BY {_COS} DESC, b.id) AS rn
      FROM ({queries}) a JOIN ({pool}) b ON a.qid = b.qid AND a.id <> b.id AND {condition}) WHERE rn <= {k}"""


_EDGES = edges_sql(_V, _V, TOP)


@query("cosine_topk", f"SELECT qid, query_id, neighbor_id, rank, ROUND(sim, 6) AS sim FROM ({_EDGES})")
def cosine_topk(t: Tables):
    rows = B.vectors(t)
    return B.six(N.nearest(rows, rows, TOP), "sim")


@query("neighbor_edges", f"SELECT qid, count(*) AS edges, ROUND(avg(sim), 6) AS mean_sim, ROUND(min(sim), 6) AS min_sim FROM ({_EDGES}) GROUP BY qid")
def neighbor_edges(t: Tables):
    """The precomputed neighbour table, summed up per item."""
    rows = B.vectors(t)
    edges = N.nearest(rows, rows, TOP)
    return edges.groupBy("qid").agg(
        F.count(F.lit(1)).alias("edges"), F.round(F.avg("sim"), 6).alias("mean_sim"), F.round(F.min("sim"), 6).alias("min_sim")
    )


_APART = edges_sql(_V, _V, TOP, "a.construct <> b.construct")


@query("construct_excluded_topk", f"SELECT qid, query_id, neighbor_id, rank, ROUND(sim, 6) AS sim FROM ({_APART})")
def construct_excluded_topk(t: Tables):
    rows = B.vectors(t)
    return B.six(N.nearest(rows, rows, TOP, apart="construct"), "sim")


CAP = 20
_CAPPED = f"SELECT * FROM ({_V}) QUALIFY row_number() OVER (PARTITION BY qid, label1 ORDER BY {mix_sql('id', 7)}, id) <= {CAP}"


@query("cap_per_label", f"SELECT id, qid, label1 FROM ({_CAPPED})")
def cap_per_label(t: Tables):
    return N.candidates_per_label(B.vectors(t), CAP, seed=7).select("id", "qid", "label1")


@query("sampled_topk", f"SELECT qid, query_id, neighbor_id, rank, ROUND(sim, 6) AS sim FROM ({edges_sql(_V, _CAPPED, 5)})")
def sampled_topk(t: Tables):
    """Candidates are sampled per label once, as in the training configuration."""
    rows = B.vectors(t)
    return B.six(N.sampled_nearest(rows, rows, 5, CAP, seed=7), "sim")


@query(
    "neighbor_label_mix",
    f"""WITH e AS ({_EDGES}) SELECT query_id, label1 AS label, count(*) AS n FROM e JOIN ({_V}) v ON e.neighbor_id = v.id GROUP BY query_id, label1""",
)
def neighbor_label_mix(t: Tables):
    rows = B.vectors(t)
    return N.neighbour_labels(N.nearest(rows, rows, TOP), rows)


_HALF = _V.replace("embedding AS emb", "list_slice(embedding, 1, 32) AS emb")


@query(
    "label_mix_change",
    f"""WITH a AS ({_EDGES}), b AS ({edges_sql(_HALF, _HALF, TOP)}),
    x AS (SELECT query_id, label1 AS label, count(*) AS n FROM a JOIN ({_V}) v ON a.neighbor_id = v.id GROUP BY 1, 2),
    y AS (SELECT query_id, label1 AS label, count(*) AS n FROM b JOIN ({_V}) v ON b.neighbor_id = v.id GROUP BY 1, 2)
    SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.label, y.label) AS label, coalesce(x.n, 0) AS n_before,
      coalesce(y.n, 0) AS n_after FROM x FULL JOIN y ON x.query_id = y.query_id AND x.label = y.label""",
)
def label_mix_change(t: Tables):
    """Neighbour labels under the whole vectors and under their first half."""
    rows = B.vectors(t)
    half = rows.withColumn("emb", F.slice("emb", 1, 32))
    return N.label_mix_change(N.nearest(rows, rows, TOP), N.nearest(half, half, TOP), rows)


# a second embedding of the same rows: each vector less the one before it in the order of components, all of them used
_SECOND = _V.replace("embedding AS emb", "list_transform(range(1, 65), lambda i: embedding[i] - CASE WHEN i > 1 THEN embedding[i - 1] ELSE 0 END) AS emb")


@query(
    "label_mix_whole",
    f"""WITH a AS ({_EDGES}), b AS ({edges_sql(_SECOND, _SECOND, TOP)}),
    x AS (SELECT query_id, label1 AS label, count(*) AS n FROM a JOIN ({_V}) v ON a.neighbor_id = v.id GROUP BY 1, 2),
    y AS (SELECT query_id, label1 AS label, count(*) AS n FROM b JOIN ({_V}) v ON b.neighbor_id = v.id GROUP BY 1, 2)
    SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.label, y.label) AS label, coalesce(x.n, 0) AS n_before,
      coalesce(y.n, 0) AS n_after FROM x FULL JOIN y ON x.query_id = y.query_id AND x.label = y.label""",
)
def label_mix_whole(t: Tables):
    """Neighbour labels under two whole embeddings."""
    rows = B.vectors(t)
    second = rows.withColumn("emb", F.transform("emb", lambda x, i: x - F.coalesce(F.get("emb", i - 1), F.lit(0).cast("float"))))
    return N.label_mix_change(N.nearest(rows, rows, TOP), N.nearest(second, second, TOP), rows)


_SPLIT = "CASE id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END"
_UNSURE = "id % 3 = 0"
_PARTED = f"SELECT *, {_SPLIT} AS split, {_UNSURE} AS unsure FROM ({_V})"
_PART = lambda s: f"SELECT * FROM ({_PARTED}) WHERE split = '{s}'"


def parted(t: Tables):
    return B.vectors(t).withColumns({"split": F.expr(_SPLIT), "unsure": F.expr(_UNSURE)})


_REDUCED = f"""SELECT neighbor_id AS id FROM ({edges_sql(f"{_PART('test')} AND unsure", _PART('train'), TOP)})
  UNION SELECT id FROM ({_PARTED}) WHERE split <> 'train' AND unsure"""


@query("reduce_by_neighbors", _REDUCED)
def reduce_by_neighbors(t: Tables):
    """Uncertain validation and test rows, and the training neighbours of the uncertain test rows."""
    rows = parted(t)
    unsure = rows.where("split <> 'train' AND unsure")
    return N.reduce_by_uncertainty(rows.where("split = 'test' AND unsure"), [unsure], rows.where("split = 'train'"), TOP)


@query(
    "reduced_share",
    f"SELECT (SELECT count(*) FROM ({_REDUCED})) AS n_reduced, (SELECT count(*) FROM embeddings) AS n_all, ROUND((SELECT count(*) FROM ({_REDUCED})) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE), 6) AS share",  # noqa: E501
)
def reduced_share(t: Tables):
    return B.six(fit_share(reduce_by_neighbors(t), t.embeddings), "share")


_LABELLED = f"SELECT * FROM ({_PARTED}) WHERE split = 'train' AND label1 IN ('2', '2A', '2B', '3')"


@query(
    "reduce_by_label",
    " UNION ALL ".join(
        f"""SELECT query_id, '{s}' AS split, string_agg(CAST(neighbor_id AS VARCHAR), ',' ORDER BY rank) AS neighbors
        FROM ({edges_sql(_LABELLED, _PART(s), TOP)}) e JOIN ({_V}) v ON e.neighbor_id = v.id
        WHERE {"v.label1 IN ('1', '1A', '1B')" if s == 'train' else 'TRUE'} GROUP BY query_id"""
        for s in ("train", "val", "test")
    ),
)
def reduce_by_label(t: Tables):
    rows = parted(t)
    pools = {s: rows.where(F.col("split") == s) for s in ("train", "val", "test")}
    lists = N.reduce_by_label(pools["train"], pools, TOP, ["2", "2A", "2B", "3"], ["1", "1A", "1B"])
    return lists.withColumn("neighbors", F.array_join(F.col("neighbors").cast("array<string>"), ","))


@query(
    "unit_vectors",
    """SELECT vec_id AS id, ROUND(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) /
      sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS total,
      ROUND(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(range(1, 65), lambda i: CAST(i AS DOUBLE))), 6) AS ramp FROM embeddings""",
)
def unit_vectors(t: Tables):
    ramp = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    unit = V.l2_normalise(F.col("embedding"))
    return t.embeddings.select(
        F.col("vec_id").alias("id"),
        F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(V.cosine(F.col("embedding"), ramp), 6).alias("ramp"),
    )


# ---------------------------------------------------------------- clusters

EPS, CORE = 1.3, 4
_CORES = f"""v AS ({_V}),
  near AS (SELECT a.qid, a.id AS a, b.id AS b FROM v a JOIN v b ON a.qid = b.qid
    AND 2 - 2 * list_cosine_similarity(CAST(a.emb AS DOUBLE[]), CAST(b.emb AS DOUBLE[])) <= {EPS * EPS}),
  core AS (SELECT qid, a AS id FROM near GROUP BY qid, a HAVING count(*) >= {CORE}),
  edge AS (SELECT n.qid, n.a, n.b FROM near n JOIN core x ON n.a = x.id JOIN core y ON n.b = y.id),
  reach(qid, id, comp) AS (SELECT qid, id, id FROM core UNION SELECT r.qid, e.b, r.comp FROM reach r JOIN edge e ON r.id = e.a),
  comp AS (SELECT qid, id, min(comp) AS comp FROM reach GROUP BY qid, id),
  num AS (SELECT qid, comp, row_number() OVER (PARTITION BY qid ORDER BY comp) - 1 AS c_label FROM (SELECT DISTINCT qid, comp FROM comp)),
  named AS (SELECT c.qid, c.id, 1 AS core, n.c_label FROM comp c JOIN num n ON c.qid = n.qid AND c.comp = n.comp),
  border AS (SELECT n.qid, n.a AS id, 0 AS core, min(m.c_label) AS c_label FROM near n JOIN named m ON n.b = m.id
    WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.qid, n.a),
  clusters AS (SELECT v.qid, v.id, coalesce(u.core, 0) AS core, coalesce(u.c_label, -1) AS c_label
    FROM v LEFT JOIN (SELECT * FROM named UNION ALL SELECT * FROM border) u ON v.id = u.id)"""


def clusters(t: Tables, cell: int = cells.CELL):
    return K.density_clusters(B.vectors(t), EPS, CORE, cell=cell)


@query("density_clusters", f"WITH RECURSIVE {_CORES} SELECT qid, id, core, c_label FROM clusters")
def density_clusters(t: Tables):
    return clusters(t)


@query(
    "cluster_sizes",
    f"""WITH RECURSIVE {_CORES} SELECT qid, count(DISTINCT c_label) FILTER (WHERE c_label >= 0) AS n_clusters,
    count(*) FILTER (WHERE c_label = -1) AS n_noise, count(*) AS n_rows FROM clusters GROUP BY qid""",
)
def cluster_sizes(t: Tables):
    """Small cells, so that the cell bounds are at work."""
    return K.cluster_summary(clusters(t, cell=16), ["qid"])


_TOKENS = "SELECT source, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS token FROM documents"


@query(
    "cluster_top_tokens",
    f"""SELECT source, token, n, rank FROM (SELECT source, token, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, token) AS rank
      FROM ({_TOKENS}) WHERE token <> '' GROUP BY source, token) WHERE rank <= 50""",
)
def cluster_top_tokens(t: Tables):
    """The source of a text stands for its cluster."""
    return K.top_tokens(t.documents, "source", "text")


@query(
    "cluster_rank",
    """SELECT source, n, rank, CAST(floor((rank - 1) / 5) AS BIGINT) AS page FROM (
      SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY source)""",
)
def cluster_rank(t: Tables):
    return K.cluster_rank(t.documents, "source")


@query("cluster_members", "SELECT source, doc_id, text FROM documents")
def cluster_members(t: Tables):
    """Texts written by cluster and read back from there."""
    from kappaframe.session import scratch_path
    from kappaframe.sources.files import write_parts

    path = scratch_path(t.spark, "members")
    write_parts(t.documents.select("source", "doc_id", "text"), path, ["source"])
    return t.spark.read.schema("doc_id bigint, text string, source string").parquet(path)


@query("kmeans")
def kmeans(t: Tables):
    return K.k_means(t.embeddings, "embedding", 2).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("gaussian_mixture")
def gaussian_mixture(t: Tables):
    fitted = K.gaussian_mixture(t.embeddings, "embedding", components=5)
    return fitted.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("membership").alias("membership"))


@query("pca_map")
def pca_map(t: Tables):
    return K.plane_map(t.embeddings, "embedding", ["vec_id", "label"])


@query("error_map")
def error_map(t: Tables):
    """Map of all vectors with the truth and whether the prediction missed it."""
    rows = B.vectors(t).withColumn("predict", F.expr("CASE WHEN id % 5 = 0 THEN '3' ELSE label1 END"))
    flagged = rows.withColumn("error", (F.col("predict") != F.col("label1")).cast("int"))
    return K.plane_map(flagged, "emb", ["qid", "id", "label1", "error"])


@query("embed_text")
def embed_text_query(t: Tables):
    return embed_text(t.documents, "text").select("doc_id", "emb")


_TOKENS_OF = """SELECT CAST(floor(vec_id / 4) AS BIGINT) AS id, vec_id % 4 AS pos, CASE WHEN vec_id % 5 = 3 OR vec_id % 32 < 4 THEN 0 ELSE 1 END AS mask,
  embedding AS vec FROM embeddings"""


@query(
    "pool_tokens",
    f"""WITH tok AS ({_TOKENS_OF}), x AS (SELECT id, pos, mask, unnest(range(64)) AS d, unnest(vec) AS v FROM tok)
    SELECT id, CAST(d AS INT) AS dim, ROUND(coalesce(sum(CAST(v AS DOUBLE)) FILTER (WHERE mask = 1) / count(*) FILTER (WHERE mask = 1), 0), 6) AS mean,
      ROUND(coalesce(max(CAST(v AS DOUBLE)) FILTER (WHERE mask = 1), -1e9), 6) AS max,
      ROUND(coalesce(sum(CAST(v AS DOUBLE)) FILTER (WHERE mask = 1) / sqrt(count(*) FILTER (WHERE mask = 1)), 0), 6) AS mean_sqrt,
      ROUND(max(CAST(v AS DOUBLE)) FILTER (WHERE pos = 0), 6) AS cls FROM x GROUP BY id, d""",
)
def pool_tokens_query(t: Tables):
    tokens = B.derive(
        t.embeddings,
        ["CAST(floor(vec_id / 4) AS BIGINT) AS id", "vec_id % 4 AS pos",
         "CASE WHEN vec_id % 5 = 3 OR vec_id % 32 < 4 THEN 0 ELSE 1 END AS mask", "embedding AS vec"],
    )
    pooled = pool_tokens(tokens, 64)
    zipped = F.arrays_zip("mean", "max", "mean_sqrt", "cls")
    rows = pooled.select("id", F.posexplode(zipped).alias("dim", "z")).select("id", "dim", "z.*")
    return B.six(rows, "mean", "max", "mean_sqrt", "cls")
