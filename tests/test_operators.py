"""Operators against brute force on small fixtures, with cells and blocks small enough to matter."""

import gc
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from kappaframe.operators import agreement as A
from kappaframe.operators import cells
from kappaframe.operators import clusters as K
from kappaframe.operators import examples as E
from kappaframe.operators import fairness as G
from kappaframe.operators import inference
from kappaframe.operators import neighbours as N
from kappaframe.operators import scan
from kappaframe.operators import selection as S
from kappaframe.operators import splits as P
from kappaframe.operators import thresholds as T
from kappaframe.operators import wording as W
from kappaframe.operators.components import components
from kappaframe.operators.ordering import numbered, position_bucket, running_sums
from kappaframe.session import arrow_rows


def brute_kappa(t, p, power):
    labels = sorted(set(t) | set(p))
    at = {l: i for i, l in enumerate(labels)}
    k, n = len(labels), len(t)
    seen = np.zeros((k, k))
    for a, b in zip(t, p):
        seen[at[a], at[b]] += 1
    chance = np.outer(seen.sum(1), seen.sum(0)) / n
    i, j = np.indices((k, k))
    w = np.abs(i - j) ** power if power else (i != j).astype(float)
    return None if (w * chance).sum() == 0 else 1 - (w * seen).sum() / (w * chance).sum()


def test_kappa_against_the_confusion_matrix(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for item in range(40):
        labels = rng.sample([1, 2, 3, 5, 9], rng.randint(1, 5))
        t = [rng.choice(labels) for _ in range(rng.randint(2, 60))]
        p = [x if rng.random() < 0.5 else rng.choice(labels) for x in t]
        rows += [(f"i{item}", a, b) for a, b in zip(t, p)]
        want[f"i{item}"] = (brute_kappa(t, p, 0), brute_kappa(t, p, 2))
    rows += [("fix", a, b) for a, b in zip((1, 1, 3, 9), (1, 3, 3, 3))]
    df = spark.createDataFrame(rows, "qid string, t int, p int")
    got = {r["qid"]: r for r in A.agreement(A.confusion_cells(df, ["qid"], "t", "p"), ["qid"]).collect()}
    assert got["fix"]["quadratic_kappa"] == pytest.approx(0.428571, abs=1e-6)
    for item, (plain, quadratic) in want.items():
        for found, expected in ((got[item]["kappa"], plain), (got[item]["quadratic_kappa"], quadratic)):
            assert (found is None) == (expected is None)
            if expected is not None:
                assert found == pytest.approx(expected, abs=1e-9)


def test_numbering_does_not_depend_on_buckets(spark):
    # one key holds most rows
    df = spark.range(3000).select(
        F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        (F.col("id") * 37).alias("pos"),
    )
    from pyspark.sql.window import Window

    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("pos")).cast("bigint"))
    for width in (50, 1000, 10**9):
        got = numbered(df, ["k"], [F.col("pos")], position_bucket("pos", width))
        assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 3000
    few = numbered(df, ["k"], [F.col("pos")], position_bucket("pos", 500), first=4)
    assert few.groupBy("k").count().where("count <> 4").count() == 0


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"), (F.col("id") % 11).alias("v"))
    got = running_sums(df, ["k"], F.desc("x"), (-F.floor(F.col("x") / 40)).cast("bigint"), ["v"])
    rows = got.collect()
    for r in rows:
        above = [x % 11 for x in range(r["x"], 500) if x % 3 == r["k"]]
        assert r["cum_v"] == sum(above) and r["total_v"] == sum(x % 11 for x in range(500) if x % 3 == r["k"])


def published_folds(labels, folds=10):
    """Stratified folds as published: labels by first appearance, sorted labels dealt out to the folds."""
    order = list(dict.fromkeys(labels))
    code = [order.index(l) for l in labels]
    dealt = sorted(code)
    share = np.array([np.bincount(dealt[i::folds], minlength=len(order)) for i in range(folds)])
    result = np.empty(len(labels), dtype=int)
    for c in range(len(order)):
        result[np.array(code) == c] = np.arange(folds).repeat(share[:, c])
    return result.tolist()


def test_folds_are_the_published_ones(spark):
    rng = random.Random(3)
    rows, pos = [], 0
    per_item = {"a": 237, "b": 31, "c": 500}
    want = {}
    for item, n in per_item.items():
        labels = [rng.choice(["1", "2", "2", "3A"]) for _ in range(n)]
        for label, fold in zip(labels, published_folds(labels)):
            pos += rng.randint(1, 9)
            rows.append((item, label, pos))
            want[pos] = fold
    df = spark.createDataFrame(rows, "qid string, label string, pos bigint")
    for width in (20, 1 << 20):
        got = P.stratified_folds(df, "qid", "label", "pos", bucket=position_bucket("pos", width)).collect()
        assert {r["pos"]: r["fold"] for r in got} == want


def test_folds_keep_rows_without_label_or_item(spark):
    rows = [("a", [None, "0", "1"][i % 3], i) for i in range(60)] + [(None, "1", 100 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "qid string, label string, pos bigint")
    got = P.stratified_folds(df, "qid", "label", "pos").collect()
    assert len(got) == len(rows) and all(r["fold"] is not None for r in got)
    # NULL counts as label 0
    labels = [label or "0" for item, label, _ in rows if item]
    assert [r["fold"] for r in sorted((r for r in got if r["qid"]), key=lambda r: r["pos"])] == published_folds(labels)
    assert sorted(r["fold"] for r in got if r["qid"] is None) == sorted(list(range(10)) * 2)
    assert sum(r["label"] is None for r in got) == 20


def test_split_keeps_rows_without_fold(spark):
    df = spark.createDataFrame([(1, 8), (2, 7), (3, 9), (4, 10), (5, None), (6, 0)], "id int, fold int")
    train, val, test = P.train_val_test(df, 8, 7)
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert (ids(train), ids(val), ids(test)) == ([5, 6], [1], [2])


def test_window_search_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for run, split, item in itertools.product(("r1", "r2"), ("val", "test"), ("a", "b")):
        for i in range(40):
            label = rng.randint(1, 3)
            predictions = [label if rng.random() < 0.6 else rng.randint(1, 3) for _ in range(5)]
            if i == 0:
                predictions[2] = None
            rows.append((run, split, f"{run}{split}{item}{i}", item, label, *predictions))
    df = spark.createDataFrame(
        rows, "run string, split string, id string, qid string, label int, " + ", ".join(f"predict{e} int" for e in range(1, 6))
    )
    scores = {}
    for run, split, item, s, e in itertools.product(("r1", "r2"), ("val", "test"), ("a", "b"), range(1, 6), range(1, 6)):
        if e < s + 2:
            continue
        part = [r for r in rows if (r[0], r[1], r[3]) == (run, split, item)]
        mean = [np.mean([x for x in r[4 + s : 5 + e] if x is not None]) for r in part]
        scores[(run, split, item, s, e)] = brute_kappa([r[4] for r in part], [round(m) for m in mean], 2)
    got = S.best_window(S.window_agreement(df)).collect()
    for r in got:
        best = None
        for run, s, e in itertools.product(("r1", "r2"), range(1, 6), range(1, 6)):
            k = scores.get((run, "val", r["qid"], s, e))
            if k is not None and k > 0 and (best is None or round(k, 12) > best[0]):
                best = (round(k, 12), run, s, e)
        assert (r["run"], r["s"], r["e"]) == best[1:]
        assert r["test_kappa"] == pytest.approx(scores[(r["run"], "test", r["qid"], r["s"], r["e"])], abs=1e-9)
    assert len(got) == 2


def test_bias(spark):
    stats = spark.createDataFrame(
        [("q", "g", "a", 2.0, 1.0, 3), ("q", "g", "b", 1.0, 1.0, 3), ("q", "g", "c", 1.0, None, 1)],
        "qid string, attr string, level string, mean double, std double, n bigint",
    )
    got = {(r["g1"], r["g2"]): r["bias"] for r in G.bias_pairs(stats).collect()}
    assert got[("a", "b")] == 1.0 and got[("b", "a")] == -1.0 and got[("a", "c")] is None and len(got) == 6


def hot_vectors(seed=0, n=260, width=8):
    """Clustered vectors; a third of the rows are copies of one vector, all in one item."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        item = "a" if i % 4 else "b"
        vector = centres[0] if i % 3 == 0 else centres[i % 6] + rng.normal(scale=0.15, size=width)
        rows.append((i, item, ["1", "2", "3"][i % 3], i % 2, [float(x) for x in vector]))
    return rows


VECTOR_SCHEMA = "id bigint, qid string, label1 string, construct int, emb array<float>"


def brute_nearest(rows, k, apart=False):
    unit = {}
    for r in rows:
        v = np.array(r[4], dtype=np.float32).astype(float)
        unit[r[0]] = v / (np.linalg.norm(v) or 1.0)
    edges = set()
    for r in rows:
        others = [o for o in rows if o[1] == r[1] and o[0] != r[0] and not (apart and o[3] == r[3])]
        ranked = sorted((-round(float(unit[r[0]] @ unit[o[0]]), 9), o[0]) for o in others)
        edges |= {(r[0], o, i + 1) for i, (_, o) in enumerate(ranked[:k])}
    return edges


SIZES = {"whole": {}, "parts": {"BLOCK_BYTES": 8 * 16, "PART": 16, "TILE": 5}, "crowded": {"BLOCK_BYTES": 8 * 40, "PART": 8, "FIRST": 9, "LISTED": 0.1}}


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("apart", [False, True])
def test_nearest_is_exact_with_hot_copies(spark, sizes, apart, monkeypatch):
    monkeypatch.setattr(scan, "DIGITS", 9)
    for name, value in SIZES[sizes].items():
        monkeypatch.setattr(scan, name, value)
    rows = hot_vectors()
    df = spark.createDataFrame(rows, VECTOR_SCHEMA)
    found = N.nearest(df, df, 4, apart="construct" if apart else None).collect()
    got = {(r["query_id"], r["neighbor_id"], r["rank"]) for r in found}
    assert got == brute_nearest(rows, 4, apart)


def test_nearest_among_near_copies_and_scaled_vectors(spark, monkeypatch):
    """A crowd that codes cannot tell apart, vectors of one direction, zero vectors, and queries outside the pool."""
    monkeypatch.setattr(scan, "DIGITS", 9)
    monkeypatch.setattr(scan, "PART", 32)
    monkeypatch.setattr(scan, "BLOCK_BYTES", 8 * 64)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=8)
    vectors = [centre + rng.normal(scale=1e-3, size=8) for _ in range(150)] + [centre * 2.0**i for i in range(6)] + list(rng.normal(size=(50, 8))) + [np.zeros(8)] * 2
    rows = [(i, "a", "1", 0, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, VECTOR_SCHEMA)
    got = {(r["query_id"], r["neighbor_id"], r["rank"]) for r in N.nearest(df, df, 5).collect()}
    assert got == brute_nearest(rows, 5)
    some = N.nearest(df.where("id % 7 = 0"), df.where("id % 2 = 1"), 3).collect()
    odd = [r for r in rows if r[0] % 2]
    for query in [r for r in rows if r[0] % 7 == 0]:
        want = sorted(x[1:] for x in brute_nearest([*[o for o in odd if o[0] != query[0]], query], 3) if x[0] == query[0])
        assert sorted((r["neighbor_id"], r["rank"]) for r in some if r["query_id"] == query[0]) == want
    assert N.nearest(df.where("false"), df, 3).collect() == [] == N.nearest(df, df.where("false"), 3).collect()


def test_codes_bound_the_cosine():
    rng = np.random.default_rng(2)
    rows = scan.unit(rng.normal(size=(400, 24)) * rng.choice([0.01, 1, 1e3], size=(400, 24)), 24)
    codes, scale, rest = scan.coded(rows)
    told = codes * scale[:, None]
    for i in range(400):
        wide = scan._margin(rest[i : i + 1], rest.max(), 24)[0]
        assert (np.abs(rows @ rows[i] - told @ told[i]) <= wide).all()


def brute_density(rows, eps, least):
    result = {}
    for item in sorted({r[1] for r in rows}):
        part = sorted((r for r in rows if r[1] == item), key=lambda r: r[0])
        m = np.array([np.array(r[4], dtype=np.float32).astype(float) for r in part])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        near = np.sqrt(np.maximum(2 - 2 * m @ m.T, 0)) <= eps
        core = near.sum(1) >= least
        label = np.full(len(part), -1)
        number = 0
        for i in range(len(part)):
            if core[i] and label[i] < 0:
                todo = [i]
                while todo:
                    j = todo.pop()
                    if label[j] < 0:
                        label[j] = number
                        todo += [x for x in np.nonzero(near[j] & core)[0] if label[x] < 0]
                number += 1
        for i in range(len(part)):
            if not core[i]:
                owners = [label[x] for x in np.nonzero(near[i] & core)[0]]
                label[i] = min(owners) if owners else -1
        result |= {r[0]: (int(c), int(l)) for r, c, l in zip(part, core, label)}
    return result


@pytest.mark.parametrize("cell, block", [(1 << 20, 1 << 20), (15, 6)])
def test_density_clusters_with_hot_copies(spark, cell, block):
    rows = hot_vectors(seed=2)
    df = spark.createDataFrame(rows, VECTOR_SCHEMA)
    got = K.density_clusters(df, 0.2, 5, cell=cell, block=block).collect()
    assert {r["id"]: (r["core"], r["c_label"]) for r in got} == brute_density(rows, 0.2, 5)


def test_components(spark):
    edges = [("x", f"n{i:03d}", f"n{i + 1:03d}") for i in range(60) if i != 30]
    nodes = [("x", f"n{i:03d}") for i in range(62)]
    got = K.connected_components(
        spark.createDataFrame(edges, "q string, a string, b string"), spark.createDataFrame(nodes, "q string, vid string"), ["q"]
    ).collect()
    comps = {r["vid"]: r["comp"] for r in got}
    assert comps["n030"] == "n000" and comps["n060"] == "n031" and comps["n061"] == "n061"


@pytest.mark.parametrize("n", [200, 4000])
def test_components_of_shuffled_path(spark, n):
    """A path in random order: the number of rounds follows the logarithm of its length."""
    order = np.random.default_rng(1).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(None, 1), (2, 2)], "a bigint, b bigint")
    got = components(edges).collect()
    assert len(got) == n and {r["comp"] for r in got} == {0}


def test_few_shot(spark):
    rows = [(i, "hot" if i % 10 else "small", i % 3) for i in range(200)] + [(900, "single", 1)]
    df = spark.createDataFrame([(a, b, c, f"t{a}") for a, b, c in rows], "id bigint, qid string, label bigint, text string")
    got = E.few_shot(df, 3, seed=1).collect()
    by = {}
    for r in got:
        assert r["query_id"] != r["example_id"] and r["text"] == f"t{r['example_id']}"
        by.setdefault((r["query_id"], r["label"]), []).append(r["example_id"])
    sizes = {}
    for _, item, label in rows:
        sizes[(item, label)] = sizes.get((item, label), 0) + 1
    for i, item, label in rows:
        for l in {k[1] for k in sizes if k[0] == item}:
            expected = min(3, sizes[(item, l)] - (l == label))
            drawn = by.get((i, l), [])
            assert len(drawn) == len(set(drawn)) == expected
    same = E.few_shot(df, 1, seed=1, same_label=True)
    labels = {a: c for a, _, c in rows}
    assert all(labels[r["query_id"]] == r["label"] for r in same.collect())


def test_oversample_replaces_about_one_in_ten(spark):
    df = spark.range(4000).select(
        "id", F.lit("VH271613").alias("qid"), F.when(F.col("id") % 2 == 0, "1A").otherwise("2B").alias("label"),
        F.lit("t").alias("text"),
    )
    rows = E.oversample(df, seed=3).collect()
    replaced = [r for r in rows if r["replaced"]]
    assert len(rows) == 4000 and 140 < len(replaced) < 260
    assert all(r["label"] == "2B" and r["id"] % 2 == 0 for r in replaced)
    assert len({r["source_id"] for r in replaced}) > len(replaced) * 0.8


def brute_thresholds(rows, objective, grid):
    """Best value of the objective with equal selection rates, over mixes of two thresholds per group."""
    groups = sorted({g for _, _, g in rows})
    best = None
    for i in range(grid + 1):
        x, total = i / grid, 0.0
        for g in groups:
            part = [(s, y) for s, y, gg in rows if gg == g]
            points = []
            for thr in [math.inf, *sorted({s for s, _ in part})]:
                tp = sum(y for s, y in part if s >= thr)
                fp = sum(1 - y for s, y in part if s >= thr)
                pos, neg = sum(y for _, y in part), sum(1 - y for _, y in part)
                acc = (tp + neg - fp) / len(part)
                bal = (tp / pos + (neg - fp) / neg) / 2
                points.append(((tp + fp) / len(part), acc if objective == "accuracy_score" else bal))
            value = max(
                (a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0])) if b[0] > a[0] else max(a[1], b[1])
                for a in points for b in points if a[0] <= x + 1e-12 and b[0] >= x - 1e-12
            )
            total += value * len(part) / len(rows)
        if best is None or round(total, 12) > round(best[1], 12):
            best = (x, total)
    return best


def test_fair_thresholds_on_toy_rows(spark):
    y = [1, 1, 1, 1, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0, 0, 1, 1, 1, 0]
    grp = ["aa", "b", "c", "aa", "c", "aa", "b", "b", "c", "b", "ab", "b", "c", "ab", "c", "ab", "b", "b", "c", "b"]
    rows = [(i / 20, y[i], grp[i]) for i in range(20)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, score double, y int, grp string")
    for objective in ("accuracy_score", "balanced_accuracy_score"):
        rules = T.fit_thresholds(df, "demographic_parity", objective, grid_size=40).collect()
        x, value = brute_thresholds(rows, objective, 40)
        sizes = {g: grp.count(g) for g in grp}
        assert {r["grp"] for r in rules} == set(grp) and all(r["x"] == pytest.approx(x) for r in rules)
        assert sum(r["y"] * sizes[r["grp"]] for r in rules) / 20 == pytest.approx(value)
        # the mix has the promised selection rate on the rows it was fitted on
        scored = T.predict_with_thresholds(df, spark.createDataFrame(rules, T_RULES))
        for r in scored.groupBy("grp").agg(F.avg("p_positive").alias("p")).collect():
            assert r["p"] == pytest.approx(x)
    odds = T.fit_thresholds(df, "equalized_odds", "balanced_accuracy_score", grid_size=40)
    rates = T.predict_with_thresholds(df, odds).groupBy("grp", "y").agg(F.avg("p_positive").alias("p")).collect()
    for label in (0, 1):
        values = [r["p"] for r in rates if r["y"] == label]
        assert max(values) - min(values) < 1e-9
    with pytest.raises(ValueError):
        T.fit_thresholds(df, "equalized_odds", "selection_rate")
    # a group with one kind of label is given that label and changes no other group's rule
    one_kind = spark.createDataFrame([(100 + i, i / 4, 1, "only") for i in range(4)], df.schema)
    more = T.fit_thresholds(df.unionByName(one_kind), "equalized_odds", "balanced_accuracy_score", grid_size=40)
    told = sorted(tuple(r) for r in more.where("grp <> 'only'").collect())
    assert told == sorted(tuple(r) for r in odds.collect())
    predicted = T.predict_with_thresholds(one_kind, more).collect()
    assert len(predicted) == 4 and all(r["p_positive"] == 1.0 and r["z"] == 1 for r in predicted)


T_RULES = "grp string, x double, y double, p0 double, t0 double, p1 double, t1 double, p_ignore double, p_const double"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, z in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != z)))
    return row[-1]


def test_spelling_against_all_pairs(spark):
    rng = random.Random(11)
    known = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))): rng.randint(20, 60) for _ in range(60)}
    odd = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 10))) for _ in range(150)} - set(known)
    df = spark.createDataFrame([*known.items(), *[(w, 1) for w in odd]], "word string, n bigint")
    got = {r["word"]: (r["distance"], r["correction"]) for r in W.spelling_corrections(df).collect()}
    want = {}
    for w in odd:
        near = sorted((edits(w, k), -n, k) for k, n in known.items() if edits(w, k) <= 2)
        if near:
            want[w] = (near[0][0], near[0][2])
    assert got == want and len(want) > 20


def test_spelling_keeps_the_rest_of_the_text(spark):
    rows = [(i, "The answer, is equal!\n(to) it.") for i in range(25)] + [(99, "Thé ansver:\n is  eqal ... zzzzzzz")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {r["id"]: r["corrected"] for r in W.correct_spelling(df, "id", "text").collect()}
    assert got[0] == rows[0][1] and got[99] == "The answer:\n is  equal ... zzzzzzz"


def test_language(spark):
    rows = [(1, "the thing that they think", "en"), (2, "der die das durch dich", "de"), (3, "12 !!", None), (4, "this thing there", None)]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string")
    got = {r["id"]: r["probability"] for r in W.language_probability(df, "id", "text", "lang").collect()}
    assert got[1] > 0.99 and got[2] < 0.01 and got[3] == 0.0 and got[4] > 0.9


def test_language_counts_exact_triples(spark):
    """Equal to naive Bayes in plain Python, also where most triples are joined and not held in the task."""
    rows = [(i, " ".join(random.Random(i).choices(words, k=9)), lang) for i in range(30)
            for lang, words in [(["en", "de", "ру", None][i % 4], ["thing house water the", "daß größe übel der", "вода дом один", "thing дом übel"][i % 4].split())]]
    rows += [(50, "x", "en"), (51, None, "de"), (52, "", None), (53, "thing \U00010400\U00010428\U00010400 12 вода", "en"), (53, "übel", "de"), (None, "the water", "en")]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string")
    texts = [re.sub(r"[\W\d_]+", " ", (text or "").lower()) for _, text, _ in rows]
    grams = [Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in texts]
    profile = {lang: sum((g for g, r in zip(grams, rows) if r[2] == lang), Counter()) for lang in ("en", "de", "ру")}
    kinds = len(set().union(*grams))
    want = []
    for (i, _, _), g in zip(rows, grams):
        score = {lang: sum(n * math.log((p[w] + 1) / (p.total() + kinds)) for w, n in g.items()) for lang, p in profile.items()}
        want.append((i, round(1 / sum(math.exp(x - score["en"]) for x in score.values()), 9) if g else 0.0))
    for held in (W.HELD, 60, 1):
        got = W.language_probability(df, "id", "text", "lang", held=held).collect()
        assert sorted(((r["id"], round(r["probability"], 9)) for r in got), key=str) == sorted(want, key=str), held


def test_functions_on_texts_get_batches_bounded_in_bytes(spark):
    """Long texts reach a function a few at a time, in all of `column_function` and `infer`."""
    sizes = lambda s: s.str.len().sum() + 0 * s.str.len()
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df = spark.range(0, 40, 1, 1).select("id", F.repeat(F.lit("ab c"), 250_000).alias("text"))
    try:
        together = df.select(inference.column_function(sizes, "bigint", "text").alias("n")).agg(F.max("n"), F.count("n")).first()
        assert together[0] <= 8_000_000 and together[1] == 40
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        found = inference.infer(df, "text", lambda: lambda texts: [len(texts)] * len(texts), "n", LongType(), ["id"], batch_size=100)
        assert found.agg(F.max("n")).first()[0] <= 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_column_function_lets_go_of_earlier_batches(spark):
    def held(s):
        return s.str.len() * 0 + sum(type(x).__name__ == "Series" and len(x) == 123 for x in gc.get_objects())

    df = spark.range(0, 123 * 60, 1, 1).select(F.lit("text").alias("text"))
    counted = df.select(inference.column_function(held, "bigint", "text").alias("n"))
    with arrow_rows(spark, 123):
        found = counted.agg(F.max("n"), F.count("n")).first()
    assert found[0] <= 4 and found[1] == 123 * 60


def test_vectors_are_sent_once_to_packs_of_small_cells(spark):
    draw = np.random.default_rng(4)
    df = spark.createDataFrame([("a", v.tolist()) for v in draw.normal(size=(300, 3))], "qid string, emb array<double>")
    vectors = cells.distinct_vectors(df, "qid", "emb").localCheckpoint()
    pivots = cells.pivots_of(vectors, "qid", 2).localCheckpoint()
    members = cells.assign_cells(vectors, pivots, "qid", 64)
    packs = cells.pack_cells(pivots, "qid", 2, 64)
    n = packs.select("pack").distinct().count()
    assert packs.count() == pivots.count() == 150 and n <= 8
    visits = cells.visit_cells(vectors, cells.cell_table(members, pivots, "qid").join(packs, ["qid", "cell"]), "qid", 2.0, 64)
    assert visits.count() == visits.distinct().count() == 300 * n


def test_pairs(spark):
    rows = [(q, "1", q * 10 + p, ["1", "2"][p % 2], p) for q in range(60) for p in range(4)] + [(100, "3", 5, "2", 0)]
    df = spark.createDataFrame(rows, "query_id bigint, query_label string, example_id bigint, label string, position bigint")
    got = E.training_pairs(df, seed=2).collect()
    assert len(got) == 61
    for r in got:
        if r["query_id"] == 100:
            assert r["partner_id"] == 5 and r["target"] == 0
        elif r["target"]:
            assert r["partner_id"] == r["query_id"] * 10 + 2  # last of the same label
        else:
            assert r["partner_id"] == r["query_id"] * 10 + 1  # first of another label
    assert 15 < sum(r["target"] for r in got) < 45
