"""SQL for DuckDB that gives the rows of the registered queries by plain definitions, where SQL can say them."""

from __future__ import annotations

from kappaframe.llm import centroid_clusters, quality_rules, source_audit, url_filter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"'[^\x20\x09-\x0D]+'"

JACCARD = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) AS w FROM documents
), words AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts
), runs AS (
  SELECT doc_id, n, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS s
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), shingles AS (
  SELECT DISTINCT doc_id, s FROM runs WHERE i <= greatest(n - 4, 1)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.v
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(reach.r) AS component_id
FROM documents d JOIN reach ON reach.v = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

# windows of 50 words as 32 + 16 + 2, each of these doubled from the one before
SUBSTRINGS = rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents
), words AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts
), two AS (
  SELECT *, md5(x || ' ' || lead(x) OVER (PARTITION BY doc_id ORDER BY i)) AS h2 FROM words
), four AS (
  SELECT *, md5(h2 || lead(h2, 2) OVER (PARTITION BY doc_id ORDER BY i)) AS h4 FROM two
), eight AS (
  SELECT *, md5(h4 || lead(h4, 4) OVER (PARTITION BY doc_id ORDER BY i)) AS h8 FROM four
), sixteen AS (
  SELECT *, md5(h8 || lead(h8, 8) OVER (PARTITION BY doc_id ORDER BY i)) AS h16 FROM eight
), longer AS (
  SELECT *, md5(h16 || lead(h16, 16) OVER (PARTITION BY doc_id ORDER BY i)) AS h32 FROM sixteen
), windows AS (
  SELECT doc_id, i, x, h32 || lead(h16, 32) OVER (PARTITION BY doc_id ORDER BY i) || lead(h2, 48) OVER (PARTITION BY doc_id ORDER BY i) AS h
  FROM longer
), first AS (
  SELECT h, min(doc_id) AS lo FROM windows WHERE h IS NOT NULL GROUP BY h
), marked AS (
  SELECT w.doc_id, w.i, w.x, coalesce(w.doc_id > f.lo, false) AS again FROM windows w LEFT JOIN first f ON w.h = f.h
), judged AS (
  SELECT doc_id, i, x, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM marked
)
SELECT d.doc_id, count(j.i) AS n_words, count(j.i) FILTER (WHERE j.gone) AS n_removed,
  sha256(coalesce(string_agg(j.x, ' ' ORDER BY j.i) FILTER (WHERE NOT j.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _address(url: str) -> str:
    """Host, path and query of `url` as SQL."""
    host = rf"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    path = rf"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    query = rf"regexp_extract({url}, '(?s)^[^#]*?(\?[^#]*)', 1)"
    return f"{host} AS host, {path} AS path, {query} AS query"


def _value(tag: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    found = " || ".join(f"coalesce(regexp_extract({tag}, '{quoted}', {i}), '')" for i in (1, 2, 3))
    return f"trim(replace({found}, '&amp;', '&'), e' \\t\\n\\r\\f')"


def _resolved(base: str, link: str) -> str:
    """SQL for the absolute address of a link; segments of a path are put together one by one."""
    quoted = {name: getattr(url_filter, name).replace("'", "''") for name in ("ORIGIN", "SCHEME", "ANY_SCHEME")}
    origin = f"regexp_extract({base}, '{quoted['ORIGIN']}', 1)"
    path = rf"regexp_extract({base}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    stem, tail = rf"regexp_extract({link}, '(?s)^([^?#]*)', 1)", rf"regexp_extract({link}, '(?s)^[^?#]*(.*)$', 1)"

    def straight(x: str) -> str:
        parts = f"list_transform(list_filter(string_split({x}, '/'), lambda s: s <> ''), lambda s: [s])"
        step = "CASE WHEN x = ['.'] THEN a WHEN x = ['..'] THEN a[:greatest(len(a) - 1, 0)] ELSE a || x END"
        kept = f"array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), {parts}), lambda a, x: {step}), '/')"
        return rf"'/' || {kept} || CASE WHEN regexp_matches({x}, '(?:^|/)\.{{0,2}}$') AND {kept} <> '' THEN '/' ELSE '' END"

    return rf"""CASE WHEN regexp_matches({link}, '{quoted["SCHEME"]}') THEN {link} WHEN regexp_matches({link}, '{quoted["ANY_SCHEME"]}') OR {link} = '' OR starts_with({link}, '#') THEN NULL
    WHEN starts_with({link}, '//') THEN 'http:' || {link} WHEN {origin} = '' THEN NULL WHEN starts_with({link}, '?') THEN {origin} || {path} || {link}
    WHEN starts_with({link}, '/') THEN {origin} || {straight(stem)} || {tail}
    ELSE {origin} || {straight(rf"regexp_replace({path}, '[^/]*$', '') || '/' || {stem}")} || {tail} END"""


def url_sql() -> str:
    rules = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in url_filter.RULES)
    pattern = lambda name: getattr(url_filter, name).replace("'", "''")
    return rf"""
WITH RECURSIVE rules(action, host, path) AS (VALUES {rules}
), numbered AS (
  SELECT row_number() OVER () AS r, url, regexp_extract_all(html, '{pattern("TAGS")}') AS tags FROM pages
), tags AS (
  SELECT r, url, unnest(tags) AS t, generate_subscripts(tags, 1) AS i FROM numbered
), bases AS (
  SELECT r, arg_min(b, i) AS b FROM (SELECT r, i, {_value("t", url_filter.HREF)} AS b FROM tags WHERE regexp_matches(t, '{pattern("BASE")}')) WHERE b <> '' GROUP BY r
), named AS (
  SELECT r, url, CASE WHEN regexp_matches(t, '{pattern("CANONICAL")}') THEN {_value("t", url_filter.HREF)}
    WHEN regexp_matches(t, '{pattern("REFRESH")}') THEN regexp_extract({_value("t", url_filter.CONTENT)}, '{pattern("JUMP")}', 1) END AS link FROM tags
), based AS (
  SELECT n.url, n.link, CASE WHEN b.b IS NULL THEN n.url ELSE coalesce({_resolved("n.url", "b.b")}, n.url) END AS base
  FROM named n LEFT JOIN bases b ON b.r = n.r WHERE n.link IS NOT NULL AND n.url IS NOT NULL
), edges AS (
  SELECT url AS src, {_resolved("base", "link")} AS dst FROM based
), urls AS (
  SELECT url FROM pages UNION SELECT src FROM edges WHERE dst IS NOT NULL UNION SELECT dst FROM edges WHERE dst IS NOT NULL
), cut AS (
  SELECT url, {_address("url")} FROM urls
), fits AS (
  SELECT c.url, arg_max(r.action, 2 * length(r.host || r.path) + (r.action = 'block')::INT) AS action,
    arg_max(r.host || r.path, length(r.host || r.path)) AS rule
  FROM cut c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path) GROUP BY c.url
), places AS (
  SELECT c.url, c.host, c.path, f.rule, f.action, CASE WHEN c.host <> '' THEN c.host || regexp_replace(c.path, '/+$', '') || c.query END AS key
  FROM cut c LEFT JOIN fits f ON f.url = c.url
), ways AS (
  SELECT x.key AS a, y.key AS b FROM edges e JOIN places x ON x.url = e.src JOIN places y ON y.url = e.dst
), both_ways AS (
  SELECT a, b FROM ways UNION SELECT b, a FROM ways
), bad AS (
  SELECT key FROM places WHERE action = 'block' AND key IS NOT NULL UNION SELECT w.b FROM bad JOIN both_ways w ON w.a = bad.key
)
SELECT p.page_id, coalesce(x.host, '') AS host, coalesce(x.path, '') AS path, x.rule,
  coalesce(x.action, CASE WHEN x.key IN (SELECT key FROM bad WHERE key IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN places x ON x.url = p.url
"""


def quality_sql(alpha: float = quality_rules.ALPHA, delta: float = quality_rules.DELTA) -> str:
    share = alpha / len(quality_rules.RULES)
    grid = ", ".join(
        f"('{name}', {i}, {c}::DOUBLE)" for name, (_, cuts) in quality_rules.RULES.items() for i, c in enumerate(cuts)
    )
    shares = ", ".join(f"({measure})::DOUBLE AS {name}" for name, (measure, _) in quality_rules.RULES.items())
    names = ", ".join(quality_rules.RULES)
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {WORDS})) AS lines
  FROM documents
), words AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts
), windows AS (
  SELECT doc_id, i, n, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS s
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), found AS (
  SELECT doc_id, i, i <= n - 4 AND count(*) FILTER (WHERE i <= n - 4) OVER (PARTITION BY doc_id, s) > 1 AS again FROM windows
), covered AS (
  SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM found
), repeats AS (
  SELECT doc_id, count(*) FILTER (WHERE c) AS r FROM covered GROUP BY doc_id
), counts AS (
  SELECT t.doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(r, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM texts t LEFT JOIN repeats USING (doc_id)
), measured AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {shares} FROM counts
), good AS (
  SELECT * FROM measured WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), long AS (
  UNPIVOT (SELECT doc_id, lang AS stratum, {names} FROM measured)
  ON {names} INTO NAME rule VALUE v
), grid(rule, turn, cutoff) AS (VALUES {grid}
), hits AS (
  SELECT stratum, rule, turn, cutoff, count(*) AS n, count(*) FILTER (WHERE v > cutoff) AS k
  FROM long JOIN grid USING (rule) WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY ALL
), tails AS (
  SELECT stratum, rule, turn, cutoff, CASE WHEN k > n * {share} THEN 1.0 ELSE list_sum(list_transform(range(k + 1),
    lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}::DOUBLE) + (n - j) * ln(1 - {share}::DOUBLE)))) END AS p
  FROM hits
), tested AS (
  SELECT stratum, rule, cutoff, max(p) OVER (PARTITION BY stratum, rule ORDER BY turn) AS worst FROM tails
), cutoffs AS (
  SELECT stratum, rule, min(cutoff) AS c FROM tested
  WHERE worst <= {delta}::DOUBLE / (SELECT greatest(count(*), 1) FROM (SELECT DISTINCT stratum, rule FROM hits)) GROUP BY stratum, rule
), rejected AS (
  SELECT DISTINCT doc_id FROM long JOIN cutoffs USING (stratum, rule) WHERE v > c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (FROM rejected) AS kept
FROM measured
"""


def audit_sql(least_docs: int = source_audit.LEAST_DOCS, top_terms: int = source_audit.TOP_TERMS) -> str:
    share = lambda n, size: f"1 + {source_audit.UNIT}::HUGEINT * ({n} + 1) // ({size} + terms)"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {least_docs}
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), languages AS (
  SELECT lang, count(*) AS terms, sum(n) AS lang_size FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(l.terms, 0) AS terms, coalesce(l.lang_size, 0) AS lang_size,
    coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS size
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN languages l ON l.lang = g.lang
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "size")} AS p, {share("k.n", "lang_size")} AS q
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {top_terms}
"""


def clusters_sql(k: int = centroid_clusters.CLUSTERS, rounds: int = centroid_clusters.ROUNDS, seed: int = centroid_clusters.SEED) -> str:
    """The rounds one after the other, each a table of its own."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(distance := list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), cluster := k)) AS best
  FROM kept, centroids{i} GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""means{i} AS (
  SELECT k, list((total - ((total % n) + n) % n) // n ORDER BY d) AS c FROM (
    SELECT best.cluster AS k, d, sum(x)::HUGEINT AS total, count(*) AS n FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM near{i}) GROUP BY ALL
  ) GROUP BY k
), centroids{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(m.c::BIGINT[], p.c) AS c FROM centroids{i} p LEFT JOIN means{i} m USING (k)
)""")
    return rf"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({centroid_clusters.SCALE} * x::DOUBLE)::BIGINT) AS v,
    row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::BIGINT), embedding) AS r
  FROM embeddings WHERE len(embedding) = {centroid_clusters.WIDTH} AND len(list_filter(embedding, lambda x: isfinite(x))) = {centroid_clusters.WIDTH}
), centroids0 AS (
  SELECT (r - 1)::INT AS k, v AS c FROM kept WHERE r <= {k}
), {", ".join(steps)}
SELECT vec_id, best.cluster AS cluster, best.distance::BIGINT AS distance, (sum(best.distance) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
  (sum(best.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{rounds} JOIN centroids{rounds} ON k = best.cluster
"""


ORACLES: dict[str, str] = {
    "op3_url_filter": url_sql(),
    "op5_jaccard_join": JACCARD,
    "op6_substring_dedup": SUBSTRINGS,
    "op10_quality_rules": quality_sql(),
    "op12_source_audit": audit_sql(),
    "op13_centroid_clusters": clusters_sql(),
}
