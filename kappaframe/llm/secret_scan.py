"""Secret scans: three fixed patterns, and a linear-chain conditional random field over the tokens of a text.

Tokens are runs of letters and digits, or of one kind of other visible characters. The field tags every token as begin
(1), inside (2) or outside (0) of a secret from its shape, the tokens beside it and features of its file, and is decoded by
Viterbi. It is trained on the values that the patterns find in a bounded sample, and on made secrets: random strings of
other lengths and alphabets in the place of these values and, where their look alone tells, in the place of words of other
texts. So it adds what looks and stands like a secret but fits no pattern, and does not learn the patterns' own lengths and
keywords as the whole truth.

Decoding is exact and short: where swapping any tag for "outside" surely gains, whatever the neighbours' tags, the best
path is outside; only the runs between such tokens are decoded step by step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from kappaframe.llm.words import as_bytes, cut, mixed, powers

TRAIN_DOCS = 2_000  # sampled texts with a pattern's match, and as many without, at most
WINDOW = 24
CONTEXT_WORDS = 256
MADE = 4096  # strings drawn for made secrets
# Alphabets of made secrets
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]

# The three patterns, in the order in which kinds are listed
KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in KEYWORDS)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "crf"]
_HINTS = (b"passw", b"secret", b"token", b"api")

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.zeros(256, dtype=np.int8)  # 0 space, 1 letter or digit, others by themselves
_KIND[33:127] = np.arange(33, 127)
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KIND[_a:_b] = 1
_KIND[128:] = 1
N_SHAPES, FINE, N_FILES, TAGS = 1296, 8, 16, 3  # FINE shapes share a length and a mix of letters and digits
BARRED = -1e6


def base_spans(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and not overlapping per kind, in code points."""
    found = []
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"akia" in low:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


class Tokens:
    """Tokens of some texts in a row, with the indices of their features."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(data, dtype=np.uint8)
        kind = _KIND[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], kind, [0]]).astype(np.int16)))
        starts = edge[:-1] if len(edge) else edge
        ends = edge[1:] if len(edge) else edge
        solid = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
        self.starts, self.ends = starts[solid], ends[solid]
        self.doc = np.searchsorted(self.bounds, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, self.bounds)
        n = len(self.starts)
        if not n:
            self.shape = self.file = np.empty(0, np.int64)
            self.word = np.empty(0, np.uint64)
            return
        length = self.ends - self.starts

        def total(flag: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
            return c[self.ends] - c[self.starts]

        digit = total((raw >= 48) & (raw < 58))
        upper = total((raw >= 65) & (raw < 91))
        lower = total((raw >= 97) & (raw < 123))
        hexed = total(((raw >= 97) & (raw < 103)) | ((raw >= 48) & (raw < 58)))
        numeral = (raw >= 48) & (raw < 58)
        switch = total(np.concatenate([numeral[1:] != numeral[:-1], [False]]))
        size = np.digitize(length, [2, 4, 8, 12, 16, 24, 32, 48])
        mix = np.digitize(switch, [2, 5])
        some = lambda k: np.minimum(k, 1) + (k == length)  # noqa: E731  none, some or all of the token
        self.shape = ((((size * 3 + mix) * 3 + some(digit)) * 2 + (upper > 0)) * 2 + (lower > 0)) * 2 + (hexed == length)
        self.shape += 648 * (kind[self.starts] != 1)
        # a token's word: its letters in lower case, digits as one character
        form = np.frombuffer(data.translate(_LOWER), dtype=np.uint8).copy()
        form[numeral] = 48
        place = np.arange(len(raw)) - np.repeat(self.starts, np.diff(np.append(self.starts, len(raw)))) if self.starts[0] == 0 else None
        if place is None:
            lead = np.concatenate([[0], self.starts])
            place = np.arange(len(raw)) - np.repeat(lead, np.diff(np.append(lead, len(raw))))
        weight = powers(np.uint64(0x9E3779B97F4A7C15), 64)[np.minimum(place, 63)]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(form.astype(np.uint64) * weight)])
        self.word = mixed(sums[self.ends] - sums[self.starts])
        per_doc = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[self.bounds]) / sizes
        marks = np.digitize(per_doc(kind > 1), [0.02, 0.05, 0.1])
        caps = np.digitize(per_doc((raw >= 65) & (raw < 91)), [0.1, 0.4])
        self.file = (marks * 4 + caps)[self.doc]

    def beside(self, vocabulary: np.ndarray, shift: int) -> np.ndarray:
        """Number of the word `shift` tokens away in `vocabulary`; its size for others, one more beyond the text."""
        n, v = len(self.word), len(vocabulary)
        at = np.arange(n) + shift
        ok = (at >= self.first[self.doc]) & (at < self.first[self.doc + 1])
        word = self.word[np.clip(at, 0, max(n - 1, 0))]
        j = np.minimum(np.searchsorted(vocabulary, word), max(v - 1, 0))
        known = (vocabulary[j] == word) if v else np.zeros(n, bool)
        return np.where(ok, np.where(known, j, v), v + 1)


class Field:
    """Weights of the field: one table per kind of feature, and transitions."""

    def __init__(self, vocabulary: np.ndarray):
        v = len(vocabulary) + 2
        self.vocabulary = vocabulary
        self.tables = [np.zeros((k, TAGS)) for k in (N_SHAPES, N_SHAPES // FINE, N_FILES, v, v, v)]
        self.step = np.zeros((TAGS, TAGS))
        self.step[0, 2] = BARRED

    def indices(self, t: Tokens) -> list[np.ndarray]:
        return [t.shape, t.shape // FINE, t.file, t.beside(self.vocabulary, -1), t.beside(self.vocabulary, -2), t.beside(self.vocabulary, 1)]

    def scores(self, indices: list[np.ndarray]) -> np.ndarray:
        return sum(table[i] for table, i in zip(self.tables, indices, strict=True))

    def train(self, indices: np.ndarray, tags: np.ndarray, rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Gradient ascent with per-weight steps on the log-likelihood of windows `(n, WINDOW)` of features and tags."""
        n, width = tags.shape
        sums = [np.full(t.shape, 1e-6) for t in [*self.tables, self.step]]
        free = self.step > BARRED / 2
        for _ in range(rounds):
            e = self.scores([indices[:, :, k] for k in range(indices.shape[2])])
            e[:, 0, 2] = BARRED
            forward, back = np.empty_like(e), np.zeros_like(e)
            forward[:, 0] = e[:, 0]
            for i in range(1, width):
                m = forward[:, i - 1][:, :, None] + self.step[None]
                forward[:, i] = e[:, i] + _logsum(m, 1)
            for i in range(width - 2, -1, -1):
                back[:, i] = _logsum(self.step[None] + (e[:, i + 1] + back[:, i + 1])[:, None, :], 2)
            z = _logsum(forward[:, -1], 1)
            error = -np.exp(forward + back - z[:, None, None])
            np.put_along_axis(error, tags[:, :, None], np.take_along_axis(error, tags[:, :, None], 2) + 1, 2)
            pair = np.zeros((TAGS, TAGS))
            for i in range(1, width):
                m = forward[:, i - 1][:, :, None] + self.step[None] + (e[:, i] + back[:, i])[:, None, :] - z[:, None, None]
                pair -= np.exp(m).sum(axis=0)
            np.add.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
            slopes = []
            for k, table in enumerate(self.tables):
                at = indices[:, :, k].ravel()
                g = np.stack([np.bincount(at, error[:, :, c].ravel(), len(table)) for c in range(TAGS)], axis=1)
                slopes.append(g / n - decay * table)
            slopes.append(np.where(free, pair / n - decay * np.where(free, self.step, 0), 0))
            for w, g, s in zip([*self.tables, self.step], slopes, sums, strict=True):
                s += g * g
                w += rate * g / np.sqrt(s)

    def decode(self, t: Tokens) -> np.ndarray:
        """Viterbi tags of all tokens, texts apart."""
        n = len(t.starts)
        tags = np.zeros(n, dtype=np.int8)
        if not n:
            return tags
        e = self.scores(self.indices(t))
        begins = np.zeros(n, dtype=bool)
        begins[t.first[:-1][t.first[:-1] < n]] = True
        gain = np.maximum(e[:, 1], e[:, 2]) - e[:, 0]
        mend = np.zeros(n)
        mend[:-1] = np.maximum(e[1:, 2] - e[1:, 1], 0)
        open_ = np.flatnonzero(gain + mend + self._most() >= 0)
        if not len(open_):
            return tags
        cuts = np.flatnonzero((np.diff(open_) > 1) | begins[open_[1:]])
        for run in np.split(open_, cuts + 1):
            a, b = int(run[0]), int(run[-1]) + 1
            score = e[a] + (0 if begins[a] else self.step[0])
            score[2] = BARRED if begins[a] else score[2]
            trail = []
            for i in range(a + 1, b):
                m = score[:, None] + self.step
                trail.append(m.argmax(axis=0))
                score = m.max(axis=0) + e[i]
            ends_text = b == n or begins[b]
            tag = int((score if ends_text else score + self.step[:, 0]).argmax())
            tags[b - 1] = tag
            for i in range(len(trail) - 1, -1, -1):
                tag = int(trail[i][tag])
                tags[a + i] = tag
        return tags

    def _most(self) -> float:
        """The most that the steps around one token can gain by a tag other than outside, when outside is put in its
        place and an inside after it becomes a begin; a missing neighbour counts as no step."""
        s = self.step
        best = -np.inf
        for p in (-1, 0, 1, 2):
            for x in (1, 2):
                if p >= 0 and s[p, x] < BARRED / 2:
                    continue
                for q in (-1, 0, 1, 2):
                    if q >= 0 and s[x, q] < BARRED / 2:
                        continue
                    r = 1 if q == 2 else q
                    had = (s[p, x] if p >= 0 else 0) + (s[x, q] if q >= 0 else 0)
                    has = (s[p, 0] if p >= 0 else 0) + (s[0, r] if q >= 0 else 0)
                    after = max((s[q, w] - s[r, w] for w in range(3) if s[q, w] > BARRED / 2 and s[r, w] > BARRED / 2), default=0) if q >= 0 else 0
                    best = max(best, had - has + max(after, 0))
        return float(best)


def _logsum(m: np.ndarray, axis: int) -> np.ndarray:
    top = m.max(axis=axis, keepdims=True)
    return np.log(np.exp(m - top).sum(axis=axis)) + np.squeeze(top, axis)


def _made_shapes(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Shapes of random strings of 8 to 48 characters that change between digits and letters twice or more, and of those
    that nobody takes for a word: of 8 characters with five changes or more, or of 12 with two."""
    texts = []
    for _ in range(MADE):
        letters = np.frombuffer(ALPHABETS[rng.integers(len(ALPHABETS))].encode(), np.uint8)
        texts.append(rng.choice(letters, rng.integers(8, 49)).tobytes())
    shape = Tokens(texts).shape
    size, changes = shape // 72, shape // 24 % 3
    return shape[changes > 0], shape[(changes == 2) | ((changes == 1) & (size >= 4))]


def _with_made(shape: np.ndarray, file: np.ndarray, tags: np.ndarray, near: np.ndarray, unknown: int) -> tuple[np.ndarray, ...]:
    """The windows and, of each, one with a made secret: in the place of its first value of one token that a pattern found, or,
    in a window without values, of a word. The words around stay; the replaced token is an unknown word to its neighbours."""
    rng = np.random.default_rng(4)
    beside, alone = _made_shapes(rng)
    later = np.concatenate([tags[:, 1:], np.zeros((len(tags), 1), tags.dtype)], axis=1)
    valued = (tags > 0).any(axis=1)
    fits = np.where(valued[:, None], (tags == 1) & (later != 2), shape < 648)
    fits[:, [0, 1, -1]] = False
    rows = np.flatnonzero(fits.any(axis=1))
    # the first value, or any word
    at = np.where(valued[rows], fits[rows].argmax(axis=1), (fits[rows] * rng.random((len(rows), WINDOW))).argmax(axis=1))
    new = [x[rows].copy() for x in (shape, file, tags, near)]
    each = np.arange(len(rows))
    new[0][each, at] = np.where(valued[rows], rng.choice(beside, len(rows)), rng.choice(alone, len(rows)))
    new[2][each, at] = 1
    for k, step in enumerate((1, 2, -1)):
        place = at + step
        ok = (place >= 0) & (place < WINDOW)
        new[3][each[ok], place[ok], k] = unknown
    return tuple(np.concatenate([a, b]) for a, b in zip((shape, file, tags, near), new, strict=True))


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for _, texts, part in cut(batch.column("doc_id"), batch.column("_text")):
            yield batch, part, texts


def _points(text: bytes, places: list[int]) -> list[int]:
    return [len(text[:p].decode("utf-8", "ignore")) for p in places]


def fit(docs: DataFrame, sample: int = TRAIN_DOCS, id_column: str = "doc_id", text_column: str = "text") -> Field | None:
    """A field trained on windows around matches of the patterns and on windows elsewhere, from at most `sample` texts
    with a match and as many without, drawn by a hash of the text, each with a made secret as well. None if nothing matches,
    as in an empty table. Repeated texts are drawn once."""
    text = as_bytes(text_column)
    plain = F.col(f"`{text_column}`").cast("string")
    hit = F.coalesce(plain.rlike("[0-9a-f]{16}|AKIA[A-Z0-9]{14}|(?i)(passw|secret|token|api_?key)"), F.lit(False)).cast("int")
    marked = docs.select(F.xxhash64(text).alias("_t"), hit.alias("hit")).distinct()
    # an order by hash with a limit keeps a bounded number of rows in every task; windows are cut out before they leave it
    drawn = marked.where("hit = 1").select("_t").orderBy("_t").limit(sample).unionByName(
        marked.where("hit = 0").select("_t").orderBy("_t").limit(sample)
    )
    keyed_rows = docs.select(F.lit(0).cast("long").alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("_t"))
    chosen = keyed_rows.join(F.broadcast(drawn), "_t").dropDuplicates(["_t"]).select("doc_id", "_text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _texts(batches):
            t = Tokens(texts)
            tags = np.zeros(len(t.starts), dtype=np.int8)
            for d, text_ in enumerate(texts):
                string = text_.decode("utf-8", "replace")
                for start, kind, end in base_spans(string, text_.translate(_LOWER)):
                    if kind == 0:
                        start = ASSIGN.match(string, start).start(2)
                    at = t.bounds[d] + len(string[:start].encode())
                    to = t.bounds[d] + len(string[:end].encode())
                    a, b = np.searchsorted(t.starts, [at, to])
                    tags[a:b] = np.where(tags[a:b] > 0, tags[a:b], 2)
                    if a < b:
                        tags[a] = 1
            n = len(tags)
            here = np.flatnonzero(tags == 1)
            often = np.arange(0, n, 40 * WINDOW)
            left = np.unique(np.concatenate([here - WINDOW // 2, here - 3, often]))
            left = left[(left >= 0) & (left + WINDOW <= n)]
            left = left[t.doc[left] == t.doc[left + WINDOW - 1]]
            left = left[tags[left] != 2]
            if not len(left):
                continue
            at = left[:, None] + np.arange(WINDOW)
            words = np.stack([t.word[np.clip(at + s, 0, n - 1)] for s in (-1, -2, 1)], axis=2)
            flat = [t.shape[at].astype(np.int32), t.file[at].astype(np.int32), tags[at].astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in f], pa.binary()) for f in flat] + [pa.array([w.tobytes() for w in words], pa.binary()), pa.array((tags[at] > 0).any(axis=1))],
                names=["shape", "file", "tags", "words", "positive"])

    told = chosen.mapInArrow(windows, "shape binary, file binary, tags binary, words binary, positive boolean")
    rows = told.orderBy(F.xxhash64("shape", "words")).limit(2 * sample).collect()
    if not any(r.positive for r in rows):
        return None
    shape, file, tags = (np.stack([np.frombuffer(r[k], np.int32) for r in rows]) for k in range(3))
    words = np.stack([np.frombuffer(r.words, np.uint64).reshape(WINDOW, 3) for r in rows])
    near, counts = np.unique(words[tags == 1], return_counts=True)
    field = Field(np.sort(near[np.argsort(-counts, kind="stable")[:CONTEXT_WORDS]]))
    v = field.vocabulary
    j = np.minimum(np.searchsorted(v, words), len(v) - 1)
    j = np.where(v[j] == words, j, len(v))
    shape, file, tags, j = _with_made(shape, file, tags, j, len(v))
    field.train(np.concatenate([np.stack([shape, shape // FINE, file], axis=2), j], axis=2).astype(np.int64), tags.astype(np.int64))
    return field


def _spans_of(field: Field | None):
    @arrow_udf("array<struct<start: long, kind: string, end: long>>")
    def spans_of(texts: pa.Array) -> pa.Array:
        out: list[list[tuple[int, str, int]]] = []
        for _, part, _ in cut(pa.nulls(len(texts), pa.int64()), texts):
            out += _part_spans(field, part)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])))

    return spans_of


def _part_spans(field: Field | None, texts: list[bytes]) -> list[list[tuple[int, str, int]]]:
    added: dict[int, list[tuple[int, int]]] = {}
    if field is not None:
        t = Tokens(texts)
        tags = field.decode(t)
        for a in np.flatnonzero(tags == 1).tolist():
            b = a + 1
            while b < len(tags) and tags[b] == 2 and t.doc[b] == t.doc[a]:
                b += 1
            d = int(t.doc[a])
            added.setdefault(d, []).append((int(t.starts[a] - t.bounds[d]), int(t.ends[b - 1] - t.bounds[d])))
    out = []
    for d, text in enumerate(texts):
        spans = base_spans(text.decode("utf-8", "replace"), text.translate(_LOWER))
        base = list(spans)
        for place in added.get(d, []):
            s, e = _points(text, list(place))
            if all(e <= x or y <= s for x, _, y in base):
                spans.append((s, 3, e))
        out.append([(s, KINDS[k], e) for s, k, e in sorted(spans)])
    return out


def with_spans(docs: DataFrame, field: Field | None, out: str = "spans", text_column: str = "text") -> DataFrame:
    """`docs` with its secrets: structs (start, kind, end) in code points, by start and then by kind in the order of KINDS.

    Null and empty texts have no spans, long texts are scanned whole, repeated rows alike; ids play no part and other
    columns pass through. Kind `crf` holds what the field adds: runs of tagged tokens that overlap no match of a pattern.
    """
    return docs.withColumn(out, _spans_of(field)(as_bytes(text_column)))


def redacted(docs: DataFrame, field: Field | None, mark: str = "[SECRET]", text_column: str = "text") -> DataFrame:
    """`docs` with every span of its texts replaced by `mark` (overlapping spans by one); null texts stay null."""

    @arrow_udf("string")
    def without(texts: pa.Array) -> pa.Array:
        out = []
        for _, part, _ in cut(pa.nulls(len(texts), pa.int64()), texts):
            for text, spans in zip(part, _part_spans(field, part), strict=True):
                string, kept, at = text.decode("utf-8", "replace"), [], 0
                for start, _, end in spans:
                    if start >= at:
                        kept += [string[at:start], mark]
                    at = max(at, end)
                out.append("".join([*kept, string[at:]]) if spans else string)
        return pa.array(out, pa.string())

    clean = F.when(F.col(f"`{text_column}`").isNotNull(), without(as_bytes(text_column)))
    return docs.withColumn(text_column, clean)
