"""Personal data, source audit and centroid clusters against brute force, and on odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check_oracle import rows_of
from kappaframe.llm import centroid_clusters, oracles, personal_data, queries, source_audit

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, found string, p string, term string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "t") for r in rows], SCHEMA)


# ---- personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        twice = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def plain_base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text) if passes(k, m[0])]


def test_fixed_patterns_are_the_plain_ones():
    draw = np.random.default_rng(1)
    for marks, size in (("ab@.-_+1 é", 40), ("0123.4567 -+()", 60), ("+1 (2)-5.", 30)):
        for _ in range(4000):
            text = "".join(draw.choice(list(marks), int(draw.integers(1, size))))
            got = [(personal_data.KINDS[k], a, b) for k, a, b in personal_data.base_spans(text)]
            assert got == plain_base(text), text
    for _ in range(2000):  # numbers of the lengths of cards
        text = " ".join("".join(draw.choice(list("0123456789-"), 19)) for _ in range(3))
        assert [(personal_data.KINDS[k], a, b) for k, a, b in personal_data.base_spans(text)] == plain_base(text)
    long = "a" * 300_000 + "1" * 300_000 + "." * 1000 + "+1" + " " * 300_000
    assert personal_data.base_spans(long) == []
    assert personal_data.base_spans("0" * 6000 + "1.2.3.4 1.2.3.256") == [(1, 0, 6007)]


def plain_graph(texts):
    """Accepted instances as the definition says, word by word."""
    edges, slots, n, kinds = defaultdict(Counter), Counter(), Counter(), {}
    for text in texts:
        words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        lower = ["<", "<", *[re.sub("[A-Z]", lambda m: m[0].lower(), w[0]) for w in words], ">"]
        names = lambda i, j: [(1, lower[i + 1]), (2, lower[i], lower[i + 1]), *([(3, lower[i + 1], lower[j + 2])] if j == i + 1 else [])]
        for i in range(len(words)):
            slots.update(names(i, i + 1))
        base = plain_base(text)
        found = [(k, a, b, next(i for i, w in enumerate(words) if w[2] > a), next(i for i, w in enumerate(words) if w[2] >= b) + 1) for k, a, b in base]
        for i, (word, a, _) in enumerate(words):
            core = word.lstrip(personal_data.EDGES)
            a += len(word) - len(core)
            core = core.rstrip(personal_data.EDGES)
            b = a + len(core)
            if 5 <= len(core) <= 64 and ("@" in core or len(re.findall("[0-9]", core)) >= 3) and all(b <= x or y <= a for _, x, y in base):
                found.append((None, a, b, i, i + 1))
        for kind, a, b, i, j in found:
            inst = text[a:b].lower()
            n[inst] += 1
            kinds[inst] = kinds.get(inst) or kind
            for p in names(i, j):
                edges[p][inst] += 1
    known = {i: (k, 1000) for i, k in kinds.items() if k}
    accepted = {}
    for _ in range(personal_data.TURNS):
        scores = defaultdict(list)
        for p, held in edges.items():
            for kind in personal_data.KINDS:
                mine = {i: c for i, c in held.items() if known.get(i, (0,))[0] == kind}
                strength = 1000 * sum(mine.values()) // (max(slots[p], sum(held.values())) + 1)
                if len(mine) >= personal_data.SUPPORT and strength >= personal_data.MIN_SCORE:
                    for i, c in held.items():
                        if not kinds[i]:
                            scores[i].append((2 * strength * c // (n[i] + c), -personal_data.KINDS.index(kind), kind))
        accepted = {i: (max(s)[2], max(s)[0]) for i, s in scores.items() if max(s)[0] >= personal_data.ACCEPT}
        known = {i: v for i, v in known.items() if kinds[i]} | accepted
    return accepted


def planted():
    """Texts with a telling context, identifiers that no fixed pattern matches there and, through them, in a second one."""
    draw = np.random.default_rng(3)
    filler = lambda k: " ".join("w" + chr(97 + int(x) % 26) + chr(97 + int(x) // 26) for x in draw.integers(0, 80, k))
    texts = [f"{filler(9)} Contact email: user{i}@mail{i}.example.com, {filler(5)}" for i in range(40)]
    texts += [f"{filler(6)} contact email: <member{i}0{i}7> and {filler(4)}" for i in range(6)]
    texts += [f"{filler(6)} account handle member{i}0{i}7 {filler(4)}" for i in range(6)]
    texts += [f"{filler(4)} account handle visitor88{i}9 {filler(4)}" for i in range(3)]
    texts += [f"é ring us: +4{i} (555) 010-23{i}0 {filler(2)}" for i in range(7)] + ["ring us: 555-0100x7 " + filler(3)] * 2
    texts += [f"{filler(8)} order 10{i}4455 {filler(6)} someone{i}@x{i}.org {filler(3)}" for i in range(9)]
    texts += [f"invoice nr 77{i}1234 {filler(5)}" for i in range(8)]
    return texts


def spans_of(text, accepted):
    """Places of accepted instances, in the order of kinds and starts."""
    base, out = plain_base(text), []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        core = m[0].lstrip(personal_data.EDGES)
        a = m.end() - len(core)
        core = core.rstrip(personal_data.EDGES)
        if core.lower() in accepted and all(a + len(core) <= x or y <= a for _, x, y in base):
            kind = accepted[core.lower()][0]
            out.append((personal_data.KINDS.index(kind), a, a + len(core), "context_" + kind))
    return [(k, a, b) for _, a, b, k in sorted(out)]


def test_unseen_identifiers(spark):
    texts = planted()
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (None, texts[41], "en", "s"), (None, None, None, None)]
    rows += [(900, "", "en", "s"), (901, " \n\t ", "en", "s"), (902, "word " * 60_000 + "contact email: long88844 x", "en", "s")]
    accepted = plain_graph([t or "" for _, t, _, _ in rows])
    assert {f"member{i}0{i}7" for i in range(6)} | {"555-0100x7", "long88844"} | {f"visitor88{i}9" for i in range(3)} == set(accepted)
    got = personal_data.found(documents(spark, rows)).collect()
    plain = lambda spans: tuple(tuple(s) for s in spans)
    want = Counter((i, tuple(plain_base(t or "")), tuple(spans_of(t or "", accepted))) for i, t, _, _ in rows)
    assert Counter((r.doc_id, plain(r.base), plain(r.added)) for r in got) == want
    assert personal_data.found(documents(spark, []).where("false")).collect() == []
    assert all(not r.added for r in personal_data.found(documents(spark, [(1, "no one here", "en", "s")])).collect())


def test_personal_data_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, folder, "documents").collect()}
    accepted = plain_graph(texts.values())
    for r in queries.op11_personal_data(spark, folder).collect():
        base = plain_base(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in personal_data.KINDS]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in base + spans_of(texts[r.doc_id], accepted))


# ---- source audit


def plain_audit(rows, least=3, top=200):
    groups, counts, docs = {(g or "", s or "") for _, _, g, s in rows}, defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (size + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out |= {(lang, s, name, i.decode(), -v, k + 1) for name, part in (("pair", pair), ("term", term)) for k, (v, i) in enumerate(part)}
    return out


def audit_rows(draw, n, sources, words):
    out = []
    for i in range(n):
        s = f"s{int(draw.integers(0, sources))}" if i % 3 else "s0"  # one source has over a third of the rows
        picks = draw.choice(words, int(draw.integers(0, 30)), p=np.arange(words, 0, -1) / (words * (words + 1) / 2))
        out.append((i, " ".join(f"T{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10]}é" for x in picks), ["en", "de", None][i % 3], s))
    return out


def test_source_audit(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = audit_rows(draw, 150, 6, 60)
    rows += [(1, "", "en", "only"), (2, None, "xx", None), (3, None, None, "s1"), (4, "a1b2a3 éa É [x] " * 30_000, "en", "long"), rows[0], rows[0], (None, "a b c", "en", "")]
    want = plain_audit(rows)
    got = source_audit.audited(documents(spark, rows)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    # every text in several pieces, every path in a block of its own
    monkeypatch.setattr(source_audit, "PIECE", 7)
    monkeypatch.setattr(source_audit, "HELD", 10)
    monkeypatch.setattr(source_audit, "BLOCK_ITEMS", 5)
    rows = rows[:150]
    got = source_audit.audited(documents(spark, rows), top_terms=5).collect()
    assert {tuple(r) for r in got} == plain_audit(rows, top=5)
    assert source_audit.audited(documents(spark, rows).where("false")).collect() == []


def test_tree_meets_every_pair_once():
    draw = np.random.default_rng(6)
    rows = sorted({tuple((int(s), int(draw.integers(1, 4))) for s in sorted(draw.choice(7, int(draw.integers(1, 6)), replace=False))) for _ in range(300)})
    many = draw.integers(1, 50, len(rows))
    p, nothing = (lambda s, c: 100 * c + s), (lambda s: 10 + s)
    path = np.array([(s, c, p(s, c), nothing(s)) for row in rows for s, c in row], np.int64)
    got = source_audit.tree_corrections(path, np.concatenate([[0], np.cumsum([len(r) for r in rows])]), many)
    f, want = (lambda a, b: (a - b) ** 2 // b), defaultdict(int)
    for row, m in zip(rows, many):
        for s, c in row:
            for t, d in row:
                if s != t:
                    want[s, t] += int(m) * (f(p(s, c), p(t, d)) - f(p(s, c), nothing(t)) - f(nothing(s), p(t, d)) + f(nothing(s), nothing(t)))
    assert dict(got) == dict(want)


# ---- centroid clusters


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024.0 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        centres = [[sum(x) // len(members[j]) for x in zip(*members[j])] if members[j] else c for j, c in enumerate(centres)]
    told = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in told:
        inertia[c] += d
    sha = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return Counter((i, c, d, inertia[c], sum(inertia.values()), sha(c)) for i, c, d in told)


def test_centroid_clusters(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(i % 5, 0.4, 64)]) for i in range(90)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [rows[1], rows[1], (None, rows[2][1]), (7, rows[9][1])]
    rows += [(300, None), (301, []), (302, rows[0][1][:63]), (303, [None, *rows[0][1][1:]]), (304, [float("nan"), *rows[0][1][1:]]), (305, [float("-inf"), *rows[0][1][1:]]), (306, [0.0] * 64)]
    schema = "vec_id bigint, embedding array<{}>, cluster int, n bigint, ids string"
    for chunk, kind in ((4096, "float"), (7, "double")):
        monkeypatch.setattr(centroid_clusters, "CHUNK", chunk)
        table = spark.createDataFrame([(i, v, 9, 9, "x") for i, v in rows], schema.format(kind))
        got = centroid_clusters.described(*centroid_clusters.clusters(table))
        assert Counter(tuple(r) for r in got.collect()) == plain_clusters(rows)
    few = table.where("vec_id < 3")
    assert Counter(tuple(r) for r in centroid_clusters.described(*centroid_clusters.clusters(few)).collect()) == plain_clusters([r for r in rows if r[0] is not None and r[0] < 3])
    assert centroid_clusters.described(*centroid_clusters.clusters(table.where("false"))).collect() == []
    with pytest.raises(Exception, match="do not fit"):
        centroid_clusters.clusters(table.where("vec_id = 5").withColumn("embedding", F.transform("embedding", lambda x: x * 1e9)))


@pytest.mark.parametrize("name", ["op12_source_audit", "op13_centroid_clusters"])
def test_sql_of_new_operators(spark, name):
    folder, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = con.execute(oracles.ORACLES[name])
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), [d[0] for d in want.description])
