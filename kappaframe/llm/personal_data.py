"""Personal data: four fixed patterns, and identifiers that they miss, found by the words around them.

Matches of the fixed patterns are seeds. Every identifier-like word (5 to 64 characters with an @ or three digits) is a
possible instance, known or not, and the words beside it are its lexical patterns: the word before, the two words before,
and the words before and after. Patterns and instances form a graph that is scored in turns:

* a pattern's score for a kind is the share of the places it occurs at, whatever stands there, that hold known instances of
  the kind; it counts with SUPPORT different ones and MIN_SCORE;
* an unknown instance's score is the best of a pattern's score times 2h / (n + h), where the pattern covers h of the
  instance's n places; from ACCEPT on it is known in the next turn, and so brings up patterns of its own.

Scores are whole thousandths, so they do not depend on the order of additions. How often a pattern occurs is counted over
all texts; a bit field of fixed size, built from the patterns with enough instances, only keeps other words out of that
count, and an exact join decides. Patterns that could not reach MIN_SCORE if all their instances were known go first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from kappaframe.llm.words import Block, as_bytes, blocks, mixed, powers, word_hashes
from kappaframe.session import fresh, written

KINDS = ["email", "ip", "card", "phone"]
FOUND = "context_"  # kinds of spans that the patterns' contexts add: context_email and so on
SUPPORT, MIN_SCORE, ACCEPT, TURNS = 5, 600, 500, 4
SHORTEST, LONGEST = 5, 64
FIELD_BITS = 1 << 23

# The four patterns. Quantifiers do not give back where giving back could not help.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
EDGES = ".,;:!?()[]{}<>\"'`*#$%&|~=_/\\-"

_START, _END = np.uint64(0x51ED270B9F652295), np.uint64(0x8CB92BA72F3D8DD7)
_PARTS = [np.uint64(x) for x in (0x9E6C63D0876A9A47, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each @, with the part before it read backwards: a word without @ costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def small(part: str) -> bool:
    """At most 255, for any number of digits."""
    digits = part.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches in code points, by kind and then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(small(g) for g in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def contexts(first: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """`(n, 3)` names of the patterns of places from the hashes of the second word before, the word before and the word after."""
    k = _PARTS
    with np.errstate(over="ignore"):
        names = [mixed(before * k[0]), mixed(first * k[1] + before * k[2]), mixed(before * k[3] + after * k[4])]
    return np.stack(names, axis=1)


def possible(word: str) -> bool:
    return SHORTEST <= len(word) <= LONGEST and ("@" in word or sum(c in "0123456789" for c in word) >= 3)


def _name(text: str) -> int:
    raw = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        total = ((raw + np.uint64(1)) * powers(_PARTS[0], len(raw))).sum(dtype=np.uint64)
    return int(mixed(np.array([total]))[0].astype(np.int64))


def _instances(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and identifier-like words of one text with the names of their patterns."""
    data = text.encode()
    hashes, starts, ends = word_hashes(data.lower())
    raw = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # byte of each code point
    points = np.append(lead, len(raw))
    found = []  # kind, start, end, first word, word after the last
    for kind, start, end in spans:
        a, b = np.searchsorted(starts, points[[start, end - 1]], "right")
        found.append((kind, start, end, int(a) - 1, int(b)))
    telling = np.flatnonzero(((raw >= 48) & (raw < 58)) | (raw == 64))
    taken = sorted((s, e) for _, s, e in spans)
    bounds = np.array([s for s, _ in taken] or [0])
    reach = np.maximum.accumulate(np.array([e for _, e in taken] or [0]))
    for w in np.unique(np.searchsorted(starts, telling, "right") - 1).tolist():
        word = data[starts[w] : ends[w]].decode()
        core = word.lstrip(EDGES)
        start = int(np.searchsorted(lead, starts[w])) + len(word) - len(core)
        core = core.rstrip(EDGES)
        if not possible(core):
            continue
        before = int(np.searchsorted(bounds, start + len(core))) - 1  # of the spans that begin before its end
        if not taken or before < 0 or reach[before] <= start:
            found.append((-1, start, start + len(core), w, w + 1))
    if not found:
        return []
    padded = np.concatenate([[_START, _START], hashes, [_END]])
    first, last = (np.array([f[i] for f in found]) for i in (3, 4))
    names = contexts(padded[first], padded[first + 1], padded[last + 2]).astype(np.int64).tolist()
    return [
        {"start": s, "end": e, "inst": _name(text[s:e]), "kind": k, "patterns": p if b - a == 1 else p[:2]}
        for (k, s, e, a, b), p in zip(found, names, strict=True)
    ]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_INSTANCE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("inst", pa.int64()), ("kind", pa.int32()), ("patterns", pa.list_(pa.int64()))])


def _scan() -> Column:
    @arrow_udf(
        "struct<base: array<struct<kind: string, start: long, end: long>>, "
        "found: array<struct<start: long, end: long, inst: long, kind: int, patterns: array<long>>>>"
    )
    def scan(texts: pa.Array) -> pa.Array:
        base, found = [], []
        for value in texts:
            text = value.as_py()
            spans = base_spans(text)
            base.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans])
            found.append(_instances(text, spans) if spans or "@" in text or DIGIT.search(text) else [])
        return pa.StructArray.from_arrays([pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_INSTANCE))], names=["base", "found"])

    return scan


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`(doc_id, text_a, text_b, base, found)`, written: two hashes of the text, its fixed matches and its instances."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text.alias("text"))
    told = rows.select("doc_id", F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(11), "text").alias("text_b"), _scan()("text").alias("x"))
    return written(told.select("doc_id", "text_a", "text_b", "x.base", "x.found"), "scanned")


def bit_field(patterns: DataFrame) -> np.ndarray:
    """FIELD_BITS bits with those of all patterns set; what reaches the driver has a fixed bound."""
    place = f"(p & {FIELD_BITS - 1})"
    words = patterns.groupBy(F.expr(f"cast(shiftright({place}, 6) AS int)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 63 AS int)))").alias("bits"))
    field = np.zeros(FIELD_BITS // 64, np.int64)
    for row in words.collect():
        field[row["w"]] = row["bits"]
    return field


def _places(block: Block, field: np.ndarray) -> np.ndarray:
    """Patterns of all places of the texts of a block whose bits are set."""
    h, n = block.words, len(block.words)
    if not n:
        return np.empty(0, np.int64)
    begins, stops = block.offsets[:-1][block.lengths > 0], block.offsets[1:][block.lengths > 0]
    before, first, after = (np.concatenate([[_START], h[:-1]]), np.concatenate([[_START, _START], h])[:n], np.append(h[1:], _END))
    before[begins] = _START
    first[begins] = _START
    first[np.minimum(begins + 1, n - 1)[begins + 1 < stops]] = _START
    after[stops - 1] = _END
    names = contexts(first, before, after).astype(np.int64).ravel()
    at = names & (FIELD_BITS - 1)
    return names[(field[at >> 6] >> (at & 63)) & 1 == 1]


def occurrences(docs: DataFrame, patterns: DataFrame, text_column: str = "text") -> DataFrame:
    """`(p, places)`: at how many places of all texts the patterns occur, whatever stands there."""
    field = bit_field(patterns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        waiting: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            names, at = np.unique(np.concatenate([held[0], *waiting]), return_inverse=True)
            n = np.zeros(len(names), np.int64)
            np.add.at(n, at, np.concatenate([held[1], np.ones(sum(map(len, waiting)), np.int64)]))
            return names, n

        for batch in batches:
            for block in blocks(batch, "id", "text", lower=True):
                waiting.append(_places(block, field))
                if sum(map(len, waiting)) > 1 << 20:
                    held, waiting = merged(), []
                    if len(held[0]) > 1 << 19:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["p", "places"])
                        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["p", "places"])

    texts = docs.select(F.lit(0).cast("long").alias("id"), as_bytes(text_column).alias("text"))
    counted = texts.mapInArrow(count, "p long, places long").groupBy("p").agg(F.sum("places").alias("places"))
    return counted.join(fresh(patterns.select("p")), "p")


def discovered(scan: DataFrame, docs: DataFrame, text_column: str = "text", turns: int = TURNS) -> DataFrame:
    """`(inst, kind, score)`, written: instances that no fixed pattern matches and the graph accepts."""
    seen = scan.select(F.explode("found").alias("f")).select("f.inst", "f.kind", "f.patterns")
    instances = written(seen.groupBy("inst").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n")), "instances")
    edges = written(seen.select("inst", F.explode("patterns").alias("p")).groupBy("p", "inst").agg(F.count(F.lit(1)).alias("held")), "edges")
    wide = edges.groupBy("p").agg(F.count(F.lit(1)).alias("different"), F.sum("held").alias("held")).where(F.col("different") >= SUPPORT)
    wide = written(wide.select("p", "held"), "wide")
    places = occurrences(docs, wide, text_column).join(wide, "p").select("p", "held", F.greatest("places", "held").alias("places"))
    hopeful = written(places.where(F.expr(f"1000 * held div (places + 1) >= {MIN_SCORE}")).select("p", "places"), "hopeful")
    graph = edges.join(hopeful, "p").join(fresh(instances), "inst")
    graph = written(graph.select("p", "places", "inst", "held", "n", "kind"), "graph")
    known = instances.where("kind >= 0").select("inst", "kind")
    seeds, size = known, -1
    for _ in range(turns):
        backed = graph.select("p", "places", "inst", "held").join(fresh(known), "inst").groupBy("p", "kind").agg(
            F.count(F.lit(1)).alias("different"), F.expr("1000 * sum(held) div (first(places) + 1)").alias("strength")
        )
        sure = backed.where((F.col("different") >= SUPPORT) & (F.col("strength") >= MIN_SCORE)).select("p", "kind", "strength")
        told = graph.where("kind < 0").drop("kind").join(sure, "p").groupBy("inst", "kind").agg(F.max(F.expr("2 * strength * held div (n + held)")).alias("score"))
        best = told.groupBy("inst").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
        accepted = written(best.where(F.col("score") >= ACCEPT).select("inst", "kind", "score"), "accepted")
        before, size = size, accepted.count()
        known = seeds.unionByName(accepted.select("inst", "kind"))
        if size == before or not size:
            break
    return accepted


def found(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`(doc_id, base, added)`, a row for each row of `docs`: spans (kind, start, end) of the fixed patterns by kind and
    start, and the spans found by their surroundings, of kinds `context_<kind>`, in the same order.

    Offsets are code points, ends exclusive. Null and empty texts have no spans, long texts are read whole; repeated rows are
    treated alike, and their places count each time while the different instances of a pattern count once; an instance
    found by patterns of two kinds takes the better score, then the kind listed first; an empty table gives no rows. An
    added span never overlaps a match of a fixed pattern. Other columns are not read.
    """
    scan = scanned(docs, id_column, text_column)
    accepted = discovered(scan, docs, text_column)
    key = ["text_a", "text_b"]
    held = scan.where(F.size("found") > 0).select(*key, F.explode("found").alias("f")).where("f.kind < 0")
    spans = held.select(*key, "f.inst", "f.start", "f.end").distinct().join(accepted, "inst")
    of_kind = F.get(F.array(*[F.lit(FOUND + k) for k in KINDS]), F.col("kind"))
    entry = F.struct(F.col("kind").alias("k"), "start", "end", of_kind.alias("kind"))
    added = written(spans.select(*key, entry.alias("s")).groupBy(*key).agg(F.sort_array(F.collect_list("s")).alias("s")), "added")
    plain = F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    return scan.select("doc_id", *key, "base").join(added, key, "left").select("doc_id", "base", F.coalesce(plain, none).alias("added"))


def lined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
