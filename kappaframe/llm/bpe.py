"""Exact byte-level BPE in linear time: a backtracking encoder, and a decoder by an offset table.

An Aho-Corasick automaton over all tokens gives the tokens that start at every place of a piece. The encoder takes the
longest one that is compatible with the token before it, a shorter one otherwise, and steps back from a dead end,
marking it so that no place is tried twice. Two tokens are compatible when merging across their seam never comes
first; answers are kept in a table of pairs. The result is what applying the merges in order gives.

Texts are cut where no token crosses: before a space that a visible character follows, and after a single line end. Equal
units of a block are encoded once, and once per worker while a bounded cache holds; numpy puts their ids in place.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaframe.llm.words import as_bytes, cut

# The public pre-tokenisation pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 1 << 18
PART_BYTES = 8 << 20
LONGEST_CACHED = 48
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes by id, merges by rank, and the tokens that are matched as they stand."""

    def __init__(self, text: str):
        spec = json.loads(text)
        kind = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex")
        if spec["model"]["type"] != "BPE" or not plain or kind.get("add_prefix_space") or spec["model"].get("ignore_merges"):
            raise ValueError("only plain byte-level BPE vocabularies are read")
        letter = byte_letters()
        ids = spec["model"]["vocab"]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.added.values()])
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(letter[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = ids[a], ids[b]
            self.rank[pair] = r
            self.halves.setdefault(ids[a + b], pair)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.known: dict[tuple[int, int], bool] = {}
        self.right = {i: self._edge(i, 1) for i in range(len(v.bytes))}
        self.left = {i: self._edge(i, 0) for i in range(len(v.bytes))}
        self.size = [len(b) for b in v.bytes]
        self.automaton = ahocorasick.Automaton()
        usable = {}
        for i in {*v.halves, *(i for i, b in enumerate(v.bytes) if len(b) == 1)}:
            if i not in v.halves or self.fits(*v.halves[i], v.rank[v.halves[i]]):
                usable[v.bytes[i]] = i
                self.automaton.add_word(v.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(v.bytes)  # the longest token that a token begins with
        for token, i in usable.items():
            heads = (usable.get(token[:k]) for k in range(len(token) - 1, 0, -1))
            self.shorter[i] = next((h for h in heads if h is not None), -1)
        self.split = regex.compile(PATTERN).findall
        names = sorted(v.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and its outer halves on one side, each with the rank at which its parent swallows it."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.vocabulary.halves:
                return out
            pair = self.vocabulary.halves[token]
            until, token = self.vocabulary.rank[pair], pair[side]

    def fits(self, a: int, b: int, limit: int = NEVER) -> bool:
        """No merge across the seam of `a` and `b` comes before both are complete (and before `limit`)."""
        rank = self.vocabulary.rank
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                r = rank.get((x, y))
                if r is not None and r < limit and r < x_until and r <= y_until:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        answer = self.known.get((a, b))
        if answer is None:
            if len(self.known) > CACHE:
                self.known.clear()
            answer = self.known[a, b] = self.fits(a, b)
        return answer

    def token_run(self, piece: bytes) -> list[int]:
        """Tokens of one piece of the pattern."""
        n, size, known = len(piece), self.size, self.known
        longest = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size[token] + 1] = token  # ends rise, so the longest token of a place comes last
        dead: set[int] = set()
        tokens: list[int] = []
        place, last, token = 0, -1, longest[0]
        while True:
            end = place + size[token]
            if end not in dead:
                fit = True if last < 0 else known.get((last, token))
                if fit is None:
                    fit = self.compatible(last, token)
                if fit:
                    tokens.append(token)
                    if end == n:
                        return tokens
                    place, last, token = end, token, longest[end]
                    continue
            token = self.shorter[token]
            if token < 0:
                dead.add(place)
                token = tokens.pop()
                place -= size[token]
                last = tokens[-1] if tokens else -1

    def kept(self, text: str) -> bytes | None:
        found = self.young.get(text)
        if found is None:
            found = self.old.get(text)
            if found is not None:
                self.keep(text, found)
        return found

    def keep(self, text: str, found: bytes) -> None:
        if len(text) <= LONGEST_CACHED:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[text] = found

    def unit(self, text: str) -> bytes:
        found = self.kept(text)
        if found is None:
            pieces = self.split(text)
            if len(pieces) == 1:
                found = array("i", self.token_run(text.encode())).tobytes()
            else:
                found = b"".join([self.kept(p) or self.unit(p) for p in pieces])
            self.keep(text, found)
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for i, part in enumerate(self.added.split(text) if self.added else [text]):
            out += [self.vocabulary.added[part]] if i % 2 else np.frombuffer(self.unit(part), np.int32).tolist() if part else []
        return out

    def encode_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts in a row, and the number of ids of each."""
        own = {i: t for i, t in enumerate(texts) if any(a.encode() in t for a in self.vocabulary.added)}
        plain = [b"" if i in own else t for i, t in enumerate(texts)]
        sizes = np.array([len(t) for t in plain], dtype=np.int64)
        data = np.frombuffer(b"".join(plain), dtype=np.uint8)
        first = np.concatenate([[0], np.cumsum(sizes)])
        starts = unit_starts(data, first)
        counts = np.zeros(len(texts), dtype=np.int64)
        ids = np.empty(0, np.int32)
        if len(data):
            offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
            units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
            runs = [self.unit(u.decode("utf-8", "replace")) for u in units.dictionary.to_pylist()]
            table = np.frombuffer(b"".join(runs), dtype=np.int32)
            length = np.array([len(r) // 4 for r in runs], dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(length)[:-1]])
            which = units.indices.to_numpy()
            size = length[which]
            before = np.concatenate([[0], np.cumsum(size)])
            ids = table[np.arange(before[-1]) + np.repeat(at[which] - before[:-1], size)]
            counts = np.diff(before[np.searchsorted(starts, first)])
        if own:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, t in own.items():
                parts[i] = np.array(self.encode(t.decode("utf-8", "replace")), dtype=np.int32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        return ids, counts


VISIBLE = np.zeros(256, dtype=bool)
VISIBLE[33:127] = True
VISIBLE[0xC3:0xC9] = True  # these begin two-byte letters
ASCII = np.zeros(256, dtype=bool)
ASCII[33:127] = True


def unit_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places in `data` (texts in a row, beginning at `first`) where no token of the pattern crosses."""
    cut_here = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 1:
        visible = VISIBLE[data]
        cut_here[:-2] = (data[:-1] == 32) & visible[1:]
        cut_here[2:-1] |= ASCII[data[:-2]] & (data[1:-1] == 10) & visible[2:]
    cut_here[first[:-1]] = True
    return np.flatnonzero(cut_here[:-1])


class Decoder:
    """All token bytes in one row and where each token's begin."""

    def __init__(self, vocabulary: Vocabulary):
        self.data = np.frombuffer(b"".join(vocabulary.bytes), dtype=np.uint8)
        self.size = np.array([len(b) for b in vocabulary.bytes], dtype=np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.size)])[:-1]

    def decode(self, ids: np.ndarray, part: int = 1 << 18) -> bytes:
        out = []
        for at in range(0, len(ids), part):
            i = ids[at : at + part]
            size = self.size[i]
            shift = self.offset[i] - np.concatenate([[0], np.cumsum(size)[:-1]])
            out.append(self.data[np.arange(int(size.sum())) + np.repeat(shift, size)].tobytes())
        return b"".join(out)


_ENCODERS: dict[int, Encoder] = {}
_DECODERS: dict[int, Decoder] = {}


def _coder(kind, kept: dict, spec: str):
    key = hash(spec)
    if key not in kept:
        kept.clear()
        kept[key] = kind(Vocabulary(spec))
    return kept[key]


def vocabulary_text(path: str) -> str:
    """The vocabulary file, read by the driver; it travels with the job (its size is that of one tokenizer)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, spec: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`(doc_id, ids)`, a row for each row of `docs`: token ids of the whole text.

    Strings of added tokens in a text become these tokens, as the public library does. A null text is empty and an
    empty text has no tokens; ids may be null or repeat, nothing depends on them. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(Encoder, _ENCODERS, shared.value)
        for batch in batches:
            for _, texts, part in cut(batch.column("doc_id"), batch.column("_text"), PART_BYTES):
                flat, counts = coder.encode_many(texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.start, len(texts)), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), as_bytes(text_column).alias("_text"))
    return rows.mapInArrow(task, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, spec: str) -> DataFrame:
    """`(doc_id, ids, decoded)` of `(doc_id, ids)`: the text of the tokens. Null ids give an empty text; bytes that are no
    UTF-8 (a cut sequence) become replacement characters."""
    shared = encoded.sparkSession.sparkContext.broadcast(spec)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(Decoder, _DECODERS, shared.value)
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy()
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            texts = [coder.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, ids array<int>, decoded string")
