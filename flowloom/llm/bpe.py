"""Byte-pair encoding and decoding with an index of pair occurrences.

The words of a batch that are not known yet are laid out as one chain of
symbols. An index maps each mergeable pair, by its rank, to all its positions.
Active ranks are taken in ascending order: all positions of a pair are merged
from the left, and only the lists of the pairs to both sides change.

Text is cut as the vocabulary file says: special tokens first, then runs
without white space, which are normalised (NFC, lower case), cut by the
pattern and mapped to byte symbols, with an end mark on each word's last one.
Runs with letters from U+0530 on, where libraries differ in their Unicode
version, are normalised and cut by the vocabulary library's own rules.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from flowloom.llm.common import slim

CACHE = 400_000     # words, and runs of text, that a task remembers; it only saves time
PIECE = 1 << 20     # characters of a text that are cut into words in one go


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin
    text, else the next free character from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


@dataclass
class Vocabulary:
    """What a vocabulary file says, and the merges as (left, right) -> (rank, id)."""

    tokens: list[str]
    first: list[int]              # id of each byte inside a word
    last: list[int]               # id of each byte at a word's end
    merges: dict[int, int]        # left << 32 | right: rank
    pairs: list[tuple[int, int, int]]  # by rank: left, right, whole
    special: dict[str, int]
    pattern: str
    rules: str                    # the file without its vocabulary

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a file of the kind lower-case BPE with word ends."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, steps = data["model"], data["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or model.get("unk_token"):
            raise ValueError(f"{path} is not of the kind this operator reads")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        tokens = [""] * (1 + max([*ids.values(), *special.values()]))
        for token, i in [*ids.items(), *special.items()]:
            tokens[i] = token
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        known = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        merges = {a << 32 | b: rank for rank, (a, b, _) in enumerate(known)}
        symbols = byte_symbols()
        return cls(tokens, [ids[s] for s in symbols], [ids[s + end] for s in symbols], merges, known, special,
                   steps[0]["pattern"]["Regex"], json.dumps({**data, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))


def encode_words(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """The ids of each non-empty word."""
    symbol: list[int] = []
    after: list[int] = []
    heads = []
    for w in words:
        heads.append(len(symbol))
        symbol.extend(map(v.first.__getitem__, w))
        symbol[-1] = v.last[w[-1]]
        after.extend(range(heads[-1] + 1, len(symbol)))
        after.append(-1)
    before = [-1] * len(symbol)
    places: dict[int, list[int]] = defaultdict(list)
    merge = v.merges.get
    for i, j in enumerate(after):
        if j >= 0:
            before[j] = i
            r = merge(symbol[i] << 32 | symbol[j])
            if r is not None:
                places[r].append(i)
    active = list(places)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        found = places.pop(rank, None)
        if not found:
            continue
        found.sort()
        left, right, whole = v.pairs[rank]
        for at, i in enumerate(found):
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # merged meanwhile
            symbol[i], symbol[j] = whole, -1
            k = after[i] = after[j]
            lowest = rank
            if k >= 0:
                before[k] = i
                r = merge(whole << 32 | symbol[k])
                if r is not None:
                    if r not in places:
                        heapq.heappush(active, r)
                    places[r].append(i)
                    lowest = min(lowest, r)
            p = before[i]
            if p >= 0:
                r = merge(symbol[p] << 32 | whole)
                if r is not None:
                    if r not in places:
                        heapq.heappush(active, r)
                    places[r].append(p)
                    lowest = min(lowest, r)
            if lowest < rank:  # a pair that goes first has come up: the rest waits
                places[rank].extend(found[at + 1:])
                heapq.heappush(active, rank)
                break
    out = []
    for h in heads:
        ids = []
        while h >= 0:
            ids.append(symbol[h])
            h = after[h]
        out.append(ids)
    return out


class Encoder:
    """A task's encoder; it remembers the words it has seen."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.cut = regex.compile(v.pattern)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.rare = re.compile("[\u0530-\U0010ffff]")
        self.bytes = {s: b for b, s in enumerate(byte_symbols())}
        self.rules = Tokenizer.from_str(v.rules)
        self.space = regex.compile(r"\s+")
        self.known: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def words(self, chunk: str) -> list[bytes]:
        if chunk.isascii():
            return [w.encode() for w in self.cut.findall(chunk.lower())]
        if self.rare.search(chunk):
            text = self.rules.normalizer.normalize_str(chunk)
            return [bytes(map(self.bytes.__getitem__, w)) for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(text)]
        text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()  # each letter by itself
        return [w.encode() for w in self.cut.findall(text)]

    def learn(self, chunks: set[str]) -> None:
        cut = {c: self.words(c) for c in chunks}
        needed = {w for found in cut.values() for w in found}
        missing = needed - self.pieces.keys()
        if len(self.pieces) + len(missing) > CACHE:
            self.pieces.clear()
            missing = needed
        words = list(missing)
        for w, ids in zip(words, encode_words(words, self.v)):
            self.pieces[w] = array("I", ids).tobytes()
        for c, found in cut.items():
            self.known[c] = b"".join([self.pieces[w] for w in found])

    def chunks(self, text: str) -> list[str]:
        # str.split() also cuts at the four separators below, which are no white space here.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in self.space.split(text) if c]
        return text.split()

    def stretches(self, text: str) -> Iterator[str]:
        """Parts of about ``PIECE`` characters, cut at white space."""
        while len(text) > PIECE:
            m = self.space.search(text, PIECE)
            if m is None:
                break
            yield text[:m.start()]
            text = text[m.end():]
        yield text

    def plain(self, texts: list[str]) -> list[bytes]:
        out = []
        lists = [self.chunks(t) for t in texts]
        new = set().union(*lists) if lists else set()
        missing = new - self.known.keys()
        if len(self.known) + len(missing) > CACHE:
            self.known.clear()
            missing = new
        if missing:
            self.learn(missing)
        for words in lists:
            out.append(b"".join([self.known[w] for w in words]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        parts: list[tuple[int, str, int]] = []  # text, piece, or special id
        for i, t in enumerate(texts):
            split = self.marks.split(t) if self.marks and self.marks.search(t) else [t]
            for s in split:
                if s in self.v.special:
                    parts.append((i, "", self.v.special[s]))
                else:
                    parts += [(i, p, -1) for p in self.stretches(s)]
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[int] = []
        size = 0
        for n, (_, p, _) in enumerate(parts):
            group.append(n)
            size += len(p)
            if size >= PIECE or n + 1 == len(parts):
                for g, data in zip(group, self.plain([parts[g][1] for g in group])):
                    i, _, special = parts[g]
                    out[i].append(data if special < 0 else special.to_bytes(4, "little"))
                group, size = [], 0
        return [b"".join(x) for x in out]


def _decoded(ids: bytes | None, tokens: list[str]) -> str:
    return " ".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",), back: bool = False) -> DataFrame:
    """The columns ``keep`` with n_tokens and ids (binary, little-endian
    unsigned 32-bit numbers) of the whole text; a null or empty text has none.
    Row by row: repeated rows are encoded alike, other columns are ignored.
    ``back`` adds ``decoded`` as ``decode`` does, from the ids, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        gc.disable()  # nothing here makes cycles; the collector would only walk the caches, over and over
        for whole in parts:
            for b in slim(whole, 500):
                ids = encoder.encode([t or "" for t in b.column("text").to_pylist()])
                out = [*(b.column(c) for c in keep), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if back:
                    out.append(pa.array([_decoded(x, shared.value.tokens) for x in ids], pa.string()))
                yield pa.record_batch(out, [*keep, "n_tokens", "ids", "decoded"][:len(out)])

    picked = docs.select(*[F.col(f"`{c}`") for c in keep if c != "text"], F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, (fields + ", " if fields else "") + "n_tokens long, ids binary" + ", decoded string" * back)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ``decoded``: the tokens of ``ids`` joined by blanks, as a vocabulary
    without a decoder has it, special tokens included. Null ids are empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens)
    schema = encoded.select("*", F.lit("").alias("decoded")).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for b in slim(whole, 500):
                text = [_decoded(x, shared.value) for x in b.column("ids").to_pylist()]
                yield b.append_column("decoded", pa.array(text, pa.string()))

    return encoded.mapInArrow(run, schema)
