"""Source divergence audit: how far the term shares of a language's sources lie apart, exactly.

Each source's share of a term is p = 1 + floor(10^9 (count + 1) / (N + V)); p and q are held against each other by
f(p, q) = floor((p - q)^2 / q). The sum of f over all V terms for every pair of sources is put together from

* V times f of the shares of a term that neither source has,
* corrections for terms that one of the two has, from the histogram of that source's shares, and
* corrections for terms that both have, from a frequent-pattern tree: a term is the row of its nonzero counts in the
  order of the sources, equal rows are one row with a multiplicity, and rows that begin alike share the nodes of their
  beginning. Every node meets each of its ancestors once, with the multiplicity of all terms below it.

Rows are dealt out by ranges of their paths, so a task holds neighbouring branches of the tree and a common beginning may
span several tasks: multiplicities are added up, so where a range ends changes nothing.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kappaframe.llm.words import as_bytes
from kappaframe.session import fresh, shuffle_width, written

UNIT = 1_000_000_000
LEAST_DOCS, TOP_TERMS = 3, 200
HELD = 200_000  # counted terms that a task holds before it sends them on
PIECE = 1 << 20  # bytes of a text that are cut into terms at once
BLOCK_ITEMS = 400_000  # items of paths that a task looks at together

# letters in lower case, bytes of all characters beyond ASCII as they are, everything else a space
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; a term is never cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _LETTERS[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_LETTERS).split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    held = 0

    def told() -> pa.RecordBatch:
        langs, sources, names, n, docs = [], [], [], [], []
        for (lang, source), (count, own) in seen.items():
            langs += [lang] * len(count)
            sources += [source] * len(count)
            names += count.keys()
            n += count.values()
            docs += map(own.__getitem__, count.keys())
        columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(names, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
            count, own = seen[lang, source]
            before, distinct = len(count), set()
            for words in terms_of(text.as_py()):
                count.update(words)
                distinct.update(words)
            own.update(distinct)
            held += len(count) - before
            if held > HELD:
                yield told()
                seen.clear()
                held = 0
    yield told()


def counted(docs: DataFrame) -> DataFrame:
    """`(lang, source, term, n, docs)`: occurrences and documents of every term, counted inside tasks first."""
    parts = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, size: str, terms: str) -> Column:
    """1 + floor(UNIT (count + 1) / (size + terms)) of SQL expressions, exact for any count."""
    up = f"cast({UNIT} AS decimal(10,0)) * cast({count} + 1 AS decimal(20,0))"
    return F.expr(f"1 + ({up}) div cast({size} + {terms} AS decimal(20,0))")


def gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def tree_corrections(path: np.ndarray, starts: np.ndarray, many: np.ndarray) -> dict[tuple[int, int], int]:
    """Corrections of ordered pairs of sources that both have a term, from sorted paths of one language.

    `path` holds (source, count, p, share of nothing) of all items in a row, `starts` where each path begins, `many` the
    multiplicities. A node of depth j begins at every path that does not share its first j + 1 items with the path before.
    """
    sizes = np.diff(starts)
    total: dict[tuple[int, int], int] = defaultdict(int)
    same = np.concatenate([[False], np.ones(len(sizes) - 1, bool)])  # as the path before, so far
    for j in range(int(sizes.max())):
        long = sizes > j
        item = np.where(long, starts[:-1] + j, 0)
        both = long[1:] & long[:-1] & (path[item[1:], :2] == path[item[:-1], :2]).all(axis=1)
        same[1:] &= both
        first = np.flatnonzero(~same)
        below = np.add.reduceat(many, first)  # paths that are shorter stand alone and are left out
        nodes, below = first[long[first]], below[long[first]]
        if not j:
            continue
        for at in range(0, len(nodes), max(1, BLOCK_ITEMS // j)):
            part = slice(at, at + max(1, BLOCK_ITEMS // j))
            begins = starts[nodes[part]]
            a, pa_, za = (path[begins + j, c][:, None] for c in (0, 2, 3))
            above = begins[:, None] + np.arange(j)
            b, pb, zb = (path[above, c] for c in (0, 2, 3))
            weight = below[part][:, None]
            for s, ps, zs, t, pt, zt in ((a, pa_, za, b, pb, zb), (b, pb, zb, a, pa_, za)):
                value = (gaps(ps, pt) - gaps(ps, zt) - gaps(zs, pt) + gaps(zs, zt)) * weight
                pair = np.broadcast_to(s, value.shape).ravel() << 32 | np.broadcast_to(t, value.shape).ravel()
                keys, place = np.unique(pair, return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, place, value.ravel())
                for key, x in zip(keys.tolist(), sums.tolist(), strict=True):
                    total[key >> 32, key & 0xFFFFFFFF] += x
    return total


_PAIRS = "lang string, a int, b int, value long"


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(lang: str, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        paths = pa.concat_arrays([p.column("path") for p in parts])
        items = paths.flatten()
        path = np.stack([items.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1)
        starts = np.concatenate([[0], np.cumsum(paths.value_lengths().to_numpy())])
        many = np.concatenate([p.column("many").to_numpy(zero_copy_only=False) for p in parts])
        found = tree_corrections(path, starts, many)
        columns = [pa.array([lang] * len(found), pa.string()), *[pa.array([k[i] for k in found], pa.int32()) for i in (0, 1)]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], names=["lang", "a", "b", "value"])

    parts, lang, items = [], None, 0
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        edges = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for x, y in zip(edges, edges[1:]):
            if parts and (lang != langs[x] or items > BLOCK_ITEMS):
                yield told(lang, parts)
                parts, items = [], 0
            lang = langs[x]
            parts.append(batch.slice(x, y - x))
            items += len(parts[-1].column("path").flatten())
    if parts:
        yield told(lang, parts)


def audited(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, lang: str = "lang", source: str = "source", text: str = "text",
) -> DataFrame:
    """`(lang, source, part, item, value, rank)`: for each source of a language every other source (`pair`), and the
    `top_terms` terms that it has more of than the language (`term`), by value and then by name.

    Terms are runs of letters and of characters beyond ASCII, A to Z in lower case; those in fewer than `least_docs`
    documents of a language are left out. Null languages, sources and texts are empty ones; long texts are counted whole;
    repeated rows are documents of their own; a language with one source has no pairs, a source without terms no terms; an
    empty table gives no rows. Other columns are not read.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias
    rows = docs.select(empty(lang)("lang"), empty(source)("source"), as_bytes(text).alias("text"))
    entry = F.struct("source", "n")
    kept = written(
        counted(rows).groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(entry).alias("counts"))
        .where(F.col("docs") >= least_docs).select("lang", "term", "n", "counts"),
        "kept",
    )
    # one row per language and per source of a language: the numbers that turn counts into shares
    of_lang = written(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_size")), "languages")
    told = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("size"))
    order = Window.partitionBy("lang").orderBy("source")
    groups = written(
        rows.select("lang", "source").distinct().join(told, ["lang", "source"], "left").join(fresh(of_lang), "lang", "left")
        .na.fill(0, ["size", "terms", "lang_size"])
        .withColumn("no", F.row_number().over(order).cast("int"))
        .withColumn("nothing", F.when(F.col("terms") > 0, share("0", "size", "terms"))),
        "groups",
    )
    long = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("counts").alias("c"))
    shares = long.select("lang", "term", "lang_n", F.col("c.source").alias("source"), F.col("c.n").alias("n")).join(groups, ["lang", "source"])
    shares = shares.withColumn("p", share("n", "size", "terms"))

    strong = shares.withColumn("q", share("lang_n", "lang_size", "terms")).where("p > q").withColumn("value", gap("p", "q"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = strong.select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(ranked))
    top = top.where(F.col("rank") <= top_terms)

    values = _pair_values(shares, groups)
    one, other = (fresh(groups.select("lang", F.col("no").alias(k), F.col("source").alias(name))) for k, name in (("a", "source"), ("b", "item")))
    pairs = values.join(one, ["lang", "a"]).join(other, ["lang", "b"]).select("lang", "source", "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").unionByName(part(top, "term"))


def _pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """`(lang, a, b, value)` for every ordered pair of sources of a language."""
    spark = groups.sparkSession
    item = F.struct("no", "n", "p", "nothing")
    paths = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(item)).alias("path")).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("many"))
    paths = written(paths, "paths")
    branches = paths.where(F.size("path") > 1).repartitionByRange(shuffle_width(spark), "lang", "path").sortWithinPartitions("lang", "path")
    both = branches.mapInArrow(_trees, _PAIRS)

    mine = groups.select("lang", F.col("no").alias("a"), F.col("nothing").alias("p0"), "terms")
    others = fresh(groups.select("lang", F.col("no").alias("b"), F.col("nothing").alias("q0")))
    pairs = mine.join(others, "lang").where("a <> b")  # as many rows as the result has
    neither = pairs.select("lang", "a", "b", F.coalesce(F.col("terms") * gap("p0", "q0"), F.lit(0).cast("long")).alias("value"))
    # terms that one source has: how often each share occurs, against the others' share of nothing
    cells = paths.select("lang", F.explode("path").alias("i"), "many").groupBy("lang", F.col("i.no").alias("a"), F.col("i.p").alias("p"), F.col("i.nothing").alias("p0"))
    cells = cells.agg(F.sum("many").alias("many"))
    met = cells.join(fresh(others), "lang").where("a <> b")
    there = met.select("lang", "a", "b", (F.col("many") * (gap("p", "q0") - gap("p0", "q0"))).alias("value"))
    back = met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), (F.col("many") * (gap("q0", "p") - gap("q0", "p0"))).alias("value"))
    exact = F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value")
    parts = [df.groupBy("lang", "a", "b").agg(exact) for df in (neither, there, back, both)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "a", "b").agg(exact)
