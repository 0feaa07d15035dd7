"""Corpus jobs: spelling and language."""

from __future__ import annotations

from pyspark.sql import functions as F

from kappaframe.operators import wording as W
from kappaframe.plans.registry import Tables, query

RARE, FREQUENT = 1, 50
_WORDS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents"


# the SQL engine's edit distance counts bytes: the accented letters of the corpus get one byte each
_ONE_BYTE = "translate({}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"


@query("word_counts", f"SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY word")
def word_counts(t: Tables):
    return W.word_counts(t.documents, "text")


@query(
    "spelling_corrections",
    f"""WITH c AS (SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY word),
    p AS (SELECT a.word, b.word AS correction, b.n AS freq, levenshtein({_ONE_BYTE.format('a.word')}, {_ONE_BYTE.format('b.word')}) AS distance
      FROM c a JOIN c b
      ON a.n <= {RARE} AND b.n >= {FREQUENT} AND abs(length(a.word) - length(b.word)) <= 2)
    SELECT word, correction, CAST(distance AS INT) AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, correction) AS k FROM p WHERE distance BETWEEN 1 AND 2) WHERE k = 1""",
)
def spelling_corrections(t: Tables):
    return W.spelling_corrections(W.word_counts(t.documents, "text"), RARE, FREQUENT)


_FIXES = f"""c AS (SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY word),
    p AS (SELECT a.word, b.word AS correction, b.n AS freq, levenshtein({_ONE_BYTE.format('a.word')}, {_ONE_BYTE.format('b.word')}) AS distance
      FROM c a JOIN c b ON a.n <= {RARE} AND b.n >= {FREQUENT} AND abs(length(a.word) - length(b.word)) <= 2),
    fixes AS (SELECT word, correction FROM p WHERE distance BETWEEN 1 AND 2
      QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, correction) = 1)"""


@query(
    "spell_correct",
    f"""WITH {_FIXES}, pieces AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '\\p{{L}}+|[^\\p{{L}}]+') AS x FROM documents)),
    new AS (SELECT doc_id, string_agg(CASE WHEN f.word IS NULL THEN piece WHEN left(piece, 1) <> left(f.word, 1) THEN upper(left(correction, 1)) || substr(correction, 2)
      ELSE correction END, '' ORDER BY pos) AS corrected FROM pieces LEFT JOIN fixes f ON f.word = lower(piece) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.corrected, d.text) AS corrected, (coalesce(n.corrected, d.text) <> d.text)::INT AS changed FROM documents d LEFT JOIN new n ON n.doc_id = d.doc_id""",
)
def spell_correct(t: Tables):
    """Whole texts with their rare words corrected."""
    fixed = W.correct_spelling(t.documents.select("doc_id", "text"), "doc_id", "text", RARE, FREQUENT)
    return fixed.select("doc_id", "corrected", (F.col("corrected") != F.col("text")).cast("int").alias("changed"))


_LETTERS = "regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')"


@query(
    "language_score",
    f"""WITH d AS (SELECT doc_id, lang, {_LETTERS} AS s FROM documents),
    x AS (SELECT doc_id, lang, s, unnest(range(1, length(s) - 1)) AS i FROM d),
    g AS (SELECT doc_id, lang, substr(s, CAST(i AS BIGINT), 3) AS gram, count(*) AS n FROM x GROUP BY 1, 2, 3),
    prof AS (SELECT gram, lang, ln(sum(n) + 1) AS lc FROM g GROUP BY gram, lang),
    nrm AS (SELECT lang, ln(sum(n) + (SELECT count(DISTINCT gram) FROM g)) AS ln FROM g GROUP BY lang),
    len AS (SELECT doc_id, sum(n) AS total FROM g GROUP BY doc_id),
    sc AS (SELECT g.doc_id, p.lang, sum(g.n * p.lc) AS gain FROM g JOIN prof p ON g.gram = p.gram GROUP BY g.doc_id, p.lang),
    t AS (SELECT len.doc_id, nrm.lang, coalesce(gain, 0) - total * nrm.ln AS score FROM len JOIN nrm ON TRUE LEFT JOIN sc ON sc.doc_id = len.doc_id AND sc.lang = nrm.lang),
    w AS (SELECT doc_id, lang, exp(score - max(score) OVER (PARTITION BY doc_id)) AS w FROM t),
    r AS (SELECT doc_id, sum(CASE WHEN lang = 'en' THEN w ELSE 0 END) / sum(w) AS p FROM w GROUP BY doc_id)
    SELECT documents.doc_id, ROUND(coalesce(p, 0), 6) AS probability FROM documents LEFT JOIN r ON documents.doc_id = r.doc_id""",
)
def language_score(t: Tables):
    found = W.language_probability(t.documents, "doc_id", "text", "lang")
    return found.withColumn("probability", F.round("probability", 6))
