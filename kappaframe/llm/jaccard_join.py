"""Jaccard join on word shingles with R-trees over count vectors.

A document is the set of its distinct shingles, held as 64-bit hashes. Hashing the shingles into GROUPS groups gives
a point of counts, and the sum over all coordinates of the smaller value bounds the overlap of two points; with the
largest count per coordinate of a node it bounds the overlap with everything below the node. Links need an overlap of
t / (1 + t) of both sizes, so most nodes and points are passed over and only surviving pairs are verified on full sets.

Points meet in pages: two linked sets share one of the first n - ceil(t n) + 1 shingles of each under any common
order, so a page holds the points that share such a shingle. The order puts frequent shingles last: those that whole texts
or prefixes often share are set as bits of maps that grow with their number (a bit may stand for others as well; it changes
only how much work there is). Equal sets are one point. A first round links every
page's points with the page's best connected point, its leader, which joins groups of copies without looking at their
pairs. A second round looks only at pages that still hold several components. Pages of up to LEAF points are one leaf;
their pairs that share too little of their prefixes to link are left out before any set is fetched. The larger pages of
one leader are one crowd, which every point enters once, however many pages it is in: its points are dealt to blocks of
bounded size, and the points outside the leader's component visit every block, with their sets. A task searches a block
with an R-tree, verifies what survives, joins what links and returns only the links that joined something, a point less
one at most. No link between components is lost, no pair leaves a task unverified, and no group is paired with itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kappaframe.llm.words import BLOCK_BYTES, LAST_ID, Block, arrow_rows, cut, expanded, keyed, mixed, squeezed, windows
from kappaframe.operators.components import components
from kappaframe.session import discard, shuffles_dropped, written

GROUPS = 64
SELDOM, CROWD = 32, 6
MAP_BITS = 1 << 28  # bits at most (32 MB) of a map of frequent shingles that goes to tasks; beyond, more shingles share a bit
SHARD_ROWS = 1 << 15
SENT_ROWS = 1 << 19  # keys (16 bytes each) of wanted texts are sent to the texts up to this count; beyond, both are shuffled
LEAF = 16
BLOCK_SHINGLES = 1 << 20  # shingles of a block of a crowd (8 MB), and of the packed visits of a task
HOT_KEYS = 1 << 10  # keys with more than this part of all rows, so fewer than this many, are joined by a broadcast


def _unique_per_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and hashes of the distinct shingles of a block, sorted by both; a document of fewer than `k`
    words has its whole sequence as one shingle."""
    lengths = block.lengths
    h = windows(block.words, k)
    of = np.repeat(np.arange(len(lengths)), lengths)[: len(h)]
    whole = np.arange(len(h)) + k <= block.offsets[of + 1]
    docs, found = [of[whole]], [h[whole]]
    for short in range(1, k):
        rows = np.flatnonzero(lengths == short)
        if len(rows):
            docs.append(rows)
            found.append(windows(block.words, short)[block.offsets[rows]])
    return _unique_per_doc(np.concatenate(docs), np.concatenate(found))


def set_names(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and a 64-bit name of every set; equal sets have equal names."""
    sizes = np.bincount(doc, minlength=n_docs)
    total = np.zeros(n_docs, dtype=np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        first = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
        total[filled] = np.add.reduceat(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), first)
    return sizes, mixed(total + sizes.astype(np.uint64)).view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], lower: bool, small: bool = False):
    for batch in batches:
        ids, marks = batch.column("_id"), batch.column("_t")
        for _, texts, part in cut(ids, batch.column("_text"), BLOCK_BYTES // 4):  # the arrays of a block are many times its bytes
            texts = [expanded(t) for t in texts] if small else texts
            yield Block(np.arange(len(texts)), [t.lower() for t in texts] if lower else texts), ids.to_numpy()[part], marks.to_numpy()[part]


def _named(k: int, lower: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_t", "sid", "n", "kind"]
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged():
            h, n = (np.concatenate(x) for x in zip(*counts, strict=True))
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[first], np.add.reduceat(n, first)

        for block, ids, marks in _blocks(batches, lower):
            doc, h = shingles(block, k)
            sizes, sid = set_names(doc, h, len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(marks), pa.array(sid), pa.array(sizes), pa.array(np.zeros(len(ids), np.int8))], names=names
            )
            if len(h):
                counts.append(np.unique(h, return_counts=True))
                held += len(counts[-1][0])
            if held > 1 << 20:
                h, n = merged()
                counts = [(h[n > 1], n[n > 1])]
                held = len(counts[0][0])
                if held > 1 << 19:
                    top = np.argpartition(-n, 1 << 17)[: 1 << 17]
                    counts, held = [(h[top], n[top])], 1 << 17
        if counts:
            h, n = merged()
            h, n = h[n > 2], n[n > 2]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int64()), pa.array(h.view(np.int64)), pa.array(n), pa.array(np.ones(len(h), np.int8))],
                names=names,
            )

    return task


def _marked(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a map of `_bit_map`."""
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _rare_first(k: int, lower: bool, maps: list[np.ndarray], percent: int):
    """Prefixes in an order that puts shingles of the first of `maps` last, those of the next before them, and so on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for block, ids, _ in _blocks(batches, lower):
            doc, h = shingles(block, k)
            sizes, sid = set_names(doc, h, len(ids))
            new = np.zeros(len(ids), dtype=bool)
            for i, s in enumerate(sid.tolist()):  # equal sets of one task are sent once
                if sizes[i] and s not in seen:
                    seen.add(s)
                    new[i] = True
            if len(seen) > 1 << 20:
                seen.clear()
            use = new[doc]
            doc, h = doc[use], h[use]
            common = np.zeros(len(h), np.uint64)
            for level, bits in enumerate(reversed(maps), 1):
                common[_marked(h, bits)] = level
            order = np.lexsort((h, common, doc))
            doc, h = doc[order], h[order]
            kept = np.where(new, sizes, 0)
            first = np.concatenate([[0], np.cumsum(kept)[:-1]])
            rank = np.arange(len(h)) - first[doc]
            p = sizes + (-percent * sizes) // 100 + 1
            take = rank < p[doc]
            last = first + np.where(new, p, 1) - 1
            turn = (common[order] << np.uint64(62)) | (h >> np.uint64(2))
            end = turn[np.minimum(last, max(len(turn) - 1, 0))] if len(turn) else np.zeros(len(ids), np.uint64)
            end = ((end >> np.uint64(32)).astype(np.int64) - (1 << 31)).astype(np.int32)  # in the same order, with ties
            doc, h = doc[take], h[take]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(sid[doc]), pa.array(sizes[doc].astype(np.int32)), pa.array(end[doc])], names=["h", "sid", "n", "last"]
            )

    return task


def _points(k: int, lower: bool, small: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _ in _blocks(batches, lower, small):
            doc, h = shingles(block, k)
            sizes, sid = set_names(doc, h, len(block.ids))
            vec = np.bincount(doc * GROUPS + (h >> np.uint64(58)).astype(np.int64), minlength=len(sizes) * GROUPS)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid), pa.array(sizes), pa.array([v.tobytes() for v in vec.reshape(-1, GROUPS).astype(np.uint32)], pa.binary()),
                 pa.array([h[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())],
                names=["sid", "n", "vec", "members"])

    return task


def _bounded(percent: int):
    """Keeps the pairs whose summed coordinate minima allow a link."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, GROUPS) for c in ("vec_a", "vec_b"))
            both = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            ok = (100 + percent) * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= percent * both
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return task


def _verified(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("set_a"), b.column("set_b")
            ok = np.zeros(b.num_rows, dtype=bool)
            for i in range(b.num_rows):
                u, v = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                inter = int(np.count_nonzero(v[at] == u))
                ok[i] = 100 * inter >= percent * (len(u) + len(v) - inter)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return task


class RTree:
    """A packed R-tree: points sorted by size and leading counts, LEAF to a node; a node keeps its sizes' range, the
    largest count per coordinate, and its component if it has only one."""

    def __init__(self, n: np.ndarray, vec: np.ndarray, comp: np.ndarray):
        order = np.lexsort((*vec[:, :3].T, n))
        self.order, self.n, self.vec, self.comp = order, n[order], vec[order], comp[order]
        first = np.arange(0, len(n), LEAF)
        self.first, self.last = first, np.minimum(first + LEAF, len(n))
        self.low, self.high = self.n[first], self.n[self.last - 1]
        self.top = np.maximum.reduceat(self.vec, first, axis=0)
        self.least, self.most = np.minimum.reduceat(self.comp, first), np.maximum.reduceat(self.comp, first)

    def search(self, n: int, vec: np.ndarray, comp: np.int64, percent: int) -> np.ndarray:
        """Points of other components that may link with one point."""
        open_ = (100 * self.high >= percent * n) & (percent * self.low <= 100 * n) & ((self.least != comp) | (self.most != comp))
        nodes = np.flatnonzero(open_)
        bound = np.minimum(self.top[nodes], vec).sum(axis=1, dtype=np.int64)
        nodes = nodes[(100 + percent) * bound >= percent * (n + self.low[nodes])]
        if not len(nodes):
            return nodes
        at = np.concatenate([np.arange(self.first[i], self.last[i]) for i in nodes])
        bound = np.minimum(self.vec[at], vec).sum(axis=1, dtype=np.int64)
        ok = ((100 + percent) * bound >= percent * (n + self.n[at])) & (self.comp[at] != comp)
        return self.order[at[ok]]


def _tallied(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Pairs with how often each came up, the smaller name first."""
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b)))
    low, high = np.minimum(a, b)[order], np.maximum(a, b)[order]
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else order
    return pa.table({"a": low[first], "b": high[first], "count": np.diff(np.append(first, len(low))).astype(np.int64)})


def _crowds_linked(percent: int):
    """Links that join components of a block's points and its visitors."""

    def visited(home: np.ndarray, asks: np.ndarray, sid: np.ndarray, comp: np.ndarray, vec: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        n = np.array([len(x) for x in sets])
        known, places = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(places, np.cumsum(n)[:-1])
        at = np.flatnonzero(home)
        tree = RTree(n[at], vec[at], comp[at])
        now, mark = comp.copy(), np.zeros(len(known), dtype=bool)
        for i in np.flatnonzero(asks):
            near = at[tree.search(int(n[i]), vec[i], comp[i], percent)]
            near = near[now[near] != now[i]]
            if not len(near):
                continue
            mark[sets[i]] = True
            inter = np.add.reduceat(mark[np.concatenate([sets[j] for j in near])], np.cumsum(n[near]) - n[near], dtype=np.int64)
            mark[sets[i]] = False
            for j in near[100 * inter >= percent * (n[i] + n[near] - inter)]:
                if now[i] != now[j]:
                    now[now == now[j]] = now[i]
                    yield int(sid[i]), int(sid[j])

    def task(group: pa.Table) -> pa.Table:
        lead, block, sid, comp = (group.column(c).to_numpy() for c in ("lead", "block", "sid", "comp"))
        home, asks = (group.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("home", "asks"))
        vectors, members = group.column("vec").combine_chunks(), group.column("members").combine_chunks()
        links: list[tuple[int, int]] = []
        order = np.lexsort((sid, block, lead))
        visits = np.flatnonzero((lead[order][1:] != lead[order][:-1]) | (block[order][1:] != block[order][:-1])) + 1
        for rows in np.split(order, visits):
            if home[rows].any() and asks[rows].any():
                vec = np.frombuffer(b"".join(vectors.take(pa.array(rows)).to_pylist()), np.uint32).reshape(-1, GROUPS)
                sets = [np.frombuffer(members[i].as_buffer(), np.uint64) for i in rows.tolist()]
                links += visited(home[rows], asks[rows], sid[rows], comp[rows], vec, sets)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return task


def _met(percent: int):
    """Pairs across components within small pages, for every page they share."""

    def task(group: pa.Table) -> pa.Table:
        h, sid, n, comp = (group.column(c).to_numpy() for c in ("h", "sid", "n", "comp"))
        n = n.astype(np.int64)
        order = np.lexsort((sid, h))
        h, sid, n, comp = h[order], sid[order], n[order], comp[order]
        a, b = [], []
        for step in range(1, LEAF):
            x, y = np.arange(len(h) - step), np.arange(step, len(h))
            low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            ok = (h[x] == h[y]) & (comp[x] != comp[y]) & (100 * low >= percent * high)
            a.append(sid[x[ok]])
            b.append(sid[y[ok]])
        return _tallied(np.concatenate(a), np.concatenate(b))

    return task


def _possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs `(a, b)` of `(a, b, count)` that share enough of their prefixes.

    Of the two, the set whose prefix ends first has every shingle of its prefix that is in the other set also in the
    other's prefix. So it lacks its other prefix shingles in the overlap, and it may lack n - t/(1+t) (n_a + n_b) at most.
    """
    side = lambda c: facts.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("last").alias(f"last_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    need = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    prefix = lambda n: n - F.ceil(percent * n / F.lit(100)) + 1
    lacks = lambda n: prefix(F.col(n)) - F.col("count") <= F.col(n) - need
    ok = F.when(F.col("last_a") < F.col("last_b"), lacks("n_a")).when(F.col("last_b") < F.col("last_a"), lacks("n_b")).otherwise(True)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(fits & ok).select("a", "b")


def _verify(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    def side(name: str, *columns: str) -> DataFrame:
        return points.select(F.col("sid").alias(name), *[F.col(c).alias(t) for c, t in columns])

    near = pairs.join(side("a", ("n", "n_a"), ("vec", "vec_a")), "a").join(side("b", ("n", "n_b"), ("vec", "vec_b")), "b")
    # written, so that no task holds the Python workers of both steps
    near = written(near.mapInArrow(_bounded(percent), "a long, b long"), "near")
    full = near.join(side("a", ("members", "set_a")), "a").join(side("b", ("members", "set_b")), "b")
    links = written(full.mapInArrow(_verified(percent), "a long, b long"), "links")
    _discarded(near)
    return links


def jaccard_classes(
    docs: DataFrame, k: int = 5, percent: int = 75, lower: bool = True, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """`(doc_id, n_shingles, component_id)`, a row for each row of `docs`.

    Two documents link when 100 |A and B| >= percent |A or B|; a component's id is its smallest document id. Texts are
    whole, words are cut at ASCII white space and A-Z lower-cased on wish. A document without words (null, empty or
    blank text) has no shingle and stays alone. A null id is returned as null, and is its component's id only where no
    member has one. Repeated rows are equal sets and so one component. An empty table gives an empty result; other
    columns are not read.
    """
    with arrow_rows(docs.sparkSession, 500), shuffles_dropped(docs.sparkSession):
        sets, one, linked = _classes(docs, k, percent, lower, id_column, text_column)
    members = one.join(linked, "sid")
    firsts = members.groupBy("comp").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("size"))
    renamed = _hot_joined(members.select("sid", "comp"), written(firsts, "firsts"), "comp", "left").select("sid", "first")
    # a set that is neither linked nor repeated names itself
    names = one.join(renamed, "sid", "left").where("first IS NOT NULL OR size > 1")
    names = written(names.select("sid", F.coalesce("first", "r")["_id"].alias("component_id"), "size"), "names")
    filled = _hot_joined(sets.where("n > 0"), names, "sid", "left").select("_id", "n", "component_id")
    out = filled.unionByName(sets.where("n = 0").select("_id", "n", F.lit(None).cast("long").alias("component_id")))
    known = lambda c: F.when(c != LAST_ID, c)
    return out.select(
        known(F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.coalesce("component_id", "_id")).alias("component_id")
    )


def first_of_each(
    docs: DataFrame, k: int = 5, percent: int = 75, lower: bool = True, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """`(_id, _t)` as `words.keyed` names rows: of every component the row with the smallest id, then text hash, and every row
    without words. Rows are told apart by id and text, so ids may be null or repeat; each pair is named once."""
    with arrow_rows(docs.sparkSession, 500), shuffles_dropped(docs.sparkSession):
        sets, one, linked = _classes(docs, k, percent, lower, id_column, text_column)
    firsts = one.join(linked, "sid").groupBy("comp").agg(F.min("r").alias("r")).select("r.*")
    alone = one.join(linked, "sid", "left_anti").select("r.*")
    return firsts.unionByName(alone).unionByName(sets.where("n = 0").select("_id", "_t").distinct())


def _hot_joined(rows: DataFrame, names: DataFrame, key: str, how: str) -> DataFrame:
    """`rows` with the columns of `names` `(key, size, ...)`, where size counts the rows of the key. Keys with more than one in
    HOT_KEYS of all rows, of which there are fewer than HOT_KEYS, are sent to the rows; the others are shuffled."""
    total = names.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    many = F.col("size") > F.lit(total // HOT_KEYS)
    hot, rest = F.broadcast(names.where(many)), names.where(~many)
    cold = rows.join(hot.select(key), key, "left_anti").join(rest, key, how)
    return rows.join(hot, key).unionByName(cold)


def _classes(docs: DataFrame, k: int, percent: int, lower: bool, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(_id, _t, sid, n)`, a row for each row of `docs`; of every set with a shingle `(sid, r, size)`, its first row and the
    number of its rows; and `(sid, comp)` of the sets that link."""
    rows = keyed(docs, id_column, text_column)
    named = written(rows.mapInArrow(_named(k, lower), "_id long, _t long, sid long, n long, kind byte"), "sets")
    sets = named.where("kind = 0").select("_id", "_t", "sid", "n")
    often = named.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")).where(f"n >= {SELDOM}")
    maps = [_bit_map(often.select(F.col("sid").alias("h")))]

    def prefixes() -> DataFrame:
        return rows.mapInArrow(_rare_first(k, lower, maps, percent), "h long, sid long, n int, last int")

    # what is still shared by many goes towards the end of the order as well, and prefixes are drawn anew
    crowded = prefixes().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {CROWD}")
    maps = [*maps, _bit_map(crowded.select("h"))]
    same = Window.partitionBy("h")
    met_rows = written(prefixes().repartition("h").distinct().select("*", F.count(F.lit(1)).over(same).alias("m")).where("m > 1"), "met")
    # a page is led by the point that meets most others: of a group of copies most likely the one they were made from
    fame = met_rows.groupBy("sid").agg(F.sum("m").alias("fame"))
    famed = met_rows.join(fame, "sid")
    leads = written(famed.groupBy("h").agg(F.max(F.struct("fame", "sid"))["sid"].alias("lead"), F.count(F.lit(1)).alias("size")), "leads")
    live = written(_hot_joined(met_rows, leads, "h", "inner").drop("size"), "live")
    _discarded(met_rows, leads)
    facts = written(live.select("sid", "n", "last").dropDuplicates(["sid"]), "facts")
    one = written(sets.where("n > 0").groupBy("sid").agg(F.min(F.struct("_id", "_t")).alias("r"), F.count(F.lit(1)).alias("size")), "one")
    texts = rows.select("_id", "_t", squeezed(F.col("_text")).alias("_text"))

    def points_of(wanted: DataFrame) -> DataFrame:
        keys = written(wanted.join(one, "sid").select("r._id", "r._t"), "wanted")
        few = keys.count() <= SENT_ROWS  # then no text is shuffled, nor made small for it
        some = rows.select("_id", "_t", "_text").join(F.broadcast(keys), ["_id", "_t"]) if few else texts.join(keys, ["_id", "_t"])
        made = some.mapInArrow(_points(k, lower, small=not few), "sid long, n long, vec binary, members binary")
        points = written(made.dropDuplicates(["sid"]), "points")
        _discarded(keys)
        return points

    def verified(pairs: DataFrame) -> DataFrame:
        points = points_of(ends_of(pairs))
        links = _verify(pairs, points, percent)
        _discarded(pairs, points)
        return links

    ends_of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    shared = live.where("sid <> lead").groupBy(F.least("lead", "sid").alias("a"), F.greatest("lead", "sid").alias("b")).count()
    stars = written(_possible(shared, facts, percent), "stars")
    links = verified(stars)
    parts = written(components(links).select(F.col("vid").alias("sid"), "comp"), "parts")
    spread = live.select("h", "sid", "n", "m", "lead").join(parts, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    spread = written(spread, "spread")
    _discarded(live, parts)
    open_pages = spread.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"))
    open_pages = written(open_pages.where("lo < hi").select("h", "size"), "open")
    paged = written(_hot_joined(spread, open_pages, "h", "inner"), "paged")
    _discarded(spread, open_pages)
    shards = F.lit(1 + paged.count() // SHARD_ROWS)
    met = paged.where(f"m <= {LEAF}").groupBy(F.pmod(F.xxhash64("h"), shards).alias("shard")).applyInArrow(_met(percent), "a long, b long, count long")
    across = written(_possible(met.groupBy("a", "b").agg(F.sum("count").alias("count")), facts, percent), "across")
    _discarded(facts)
    more = verified(across)
    crowded = _crowd_links(paged, points_of, percent)
    _discarded(paged)
    linked = written(components(links.unionByName(more).unionByName(crowded)).select(F.col("vid").alias("sid"), "comp"), "linked")
    _discarded(links, more)
    return sets, one, linked


def _crowd_links(paged: DataFrame, points_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links `(a, b)` between components of the large pages of `(h, sid, n, m, lead, comp)`."""
    seats = written(paged.where(f"m > {LEAF}").select("lead", "sid", "n", "comp").distinct(), "seats")
    main = F.max(F.when(F.col("sid") == F.col("lead"), F.col("comp")))
    crowds = seats.groupBy("lead").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), main.alias("main"))
    crowds = written(crowds.withColumn("blocks", F.floor(F.col("shingles") / BLOCK_SHINGLES) + 1), "crowds")
    seated = _hot_joined(seats, crowds, "lead", "inner")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    asks = F.col("comp") != F.col("main")
    goes = F.when(asks, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))
    visits = seated.select("lead", "sid", "n", "comp", own.alias("own"), asks.alias("asks"), F.explode(goes).alias("block"))
    visits = written(visits.withColumn("home", F.col("own") == F.col("block")), "visits")
    sent = visits.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    points = points_of(seats.select("sid").distinct())
    shard = F.pmod(F.xxhash64("lead", "block"), F.lit(1 + sent // BLOCK_SHINGLES)).alias("shard")
    rows = visits.select("lead", "block", "sid", "comp", "home", "asks").join(points.select("sid", "vec", "members"), "sid")
    links = written(rows.groupBy(shard).applyInArrow(_crowds_linked(percent), "a long, b long"), "crowd_links")
    _discarded(seats, crowds, visits, points)
    return links


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """The bytes of a map with a bit set for each of the distinct hashes `(h)`, its last bits being the place: 16 to 32 bits for each
    hash, 2^21 at least and MAP_BITS at most. The bits are set in Spark, so only the map comes to the driver."""
    hashes = written(hashes, "hashes")
    size = min(MAP_BITS, max(1 << 21, 1 << (16 * hashes.count()).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(size - 1)) + 1  # Spark counts places from 1
    parts = hashes.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).repartition("part")
    bits = np.zeros(size // 8, dtype=np.uint8)
    for part, found in parts.groupBy("part").agg(F.bitmap_construct_agg("bit")).collect():
        bits[(part - 1) * len(found) : part * len(found)] = np.frombuffer(found, np.uint8)
    _discarded(hashes)
    return bits


def _discarded(*tables: DataFrame) -> None:
    for table in tables:
        discard(table)
