"""Byte-level BPE encoding by a depth-first walk over a trie of words.

The state of a trie node is the last token of the encoding of its prefix: token
t ends the encoding of p exactly where t is a suffix of p and the last token of
the prefix before it stays apart from t, i.e. the merges applied to both leave
both whole. So each node looks only at the states of its ancestors, and the
encoding of a prefix that many words share is found once. The distinct words of
a batch in sorted order are the trie in depth-first order: the next word goes on
from the node where it leaves the one before. An automaton over the vocabulary
names the tokens that end at a node.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm.common import id_and_text, schema_with, table

#: The split of byte-level BPE before any merge; fixed by the tokenizer's format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents whose words are gathered before a walk, and bounds of what a task remembers.
DOCS, MAX_WORDS, MAX_PAIRS, LONG_WORD = 250, 150_000, 400_000, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary file: visible
    Latin-1 characters stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder of one vocabulary; not shared between threads."""

    def __init__(self, spec: bytes):
        made = json.loads(spec)
        byte = _byte_of_char()
        raw = lambda token: bytes(byte[c] for c in token)
        model = made["model"]
        ids = {raw(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in made.get("added_tokens") or []}
        self.bytes_of: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in [*ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes_of[i] = t
        self.byte_ids = [ids.get(bytes([b]), -1) for b in range(256)]
        # pair of ids -> (rank, id of both together)
        self.merges: dict[int, tuple[int, int]] = {}
        for i, m in enumerate(model["merges"]):
            left, right = map(raw, m if isinstance(m, list) else m.split(" "))
            self.merges[ids[left] << 24 | ids[right]] = (i, ids[left + right])
        self._automaton(ids)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        # ids of the words of this generation, and of the one before
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}

    def _stays_apart(self, key: int) -> bool:
        """Whether plain merging, lowest rank first and leftmost first, of the
        bytes of two tokens ends with just these two."""
        left, right = key >> 24, key & 0xFFFFFF
        parts = [self.byte_ids[b] for b in self.bytes_of[left] + self.bytes_of[right]]
        merges, none = self.merges, (1 << 40, 0)
        while len(parts) > 1:
            (rank, both), at = min((merges.get(a << 24 | b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == none[0]:
                break
            a, b = parts[at], parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(both)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        if len(self.apart) >= MAX_PAIRS:
            self.apart.clear()
        found = self.apart[key] = parts == [left, right]
        return found

    def _automaton(self, ids: dict[bytes, int]) -> None:
        """Suffix automaton of the vocabulary: a state is the longest suffix of
        the bytes read that begins a token. ``goto`` learns the steps that fall
        back; ``ends`` has the tokens that end at a state, longest first, as far
        as states were met."""
        self.goto: dict[int, int] = {}
        parent, byte, self.token = array("i", [0]), array("i", [0]), array("i", [-1])
        for t, i in ids.items():
            at = 0
            for c in t:
                key = at << 8 | c
                if key not in self.goto:
                    self.goto[key] = len(parent)
                    parent.append(at)
                    byte.append(c)
                    self.token.append(-1)
                at = self.goto[key]
            self.token[at] = i
        self.depth = array("i", [0]) * len(parent)
        for n in range(1, len(parent)):
            self.depth[n] = self.depth[parent[n]] + 1
        self.fail = array("i", [0]) * len(parent)
        for n in sorted(range(1, len(parent)), key=self.depth.__getitem__):
            if self.depth[n] > 1:
                self.fail[n] = self._follow(self.fail[parent[n]], byte[n])
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {0: ()}

    def _follow(self, state: int, c: int) -> int:
        while state and (state << 8 | c) not in self.goto:
            state = self.fail[state]
        return self.goto.get(state << 8 | c, 0)

    def _ends_at(self, state: int) -> tuple[tuple[int, int], ...]:
        found, at = [], state
        while at:
            if self.token[at] >= 0:
                found.append((self.token[at], self.depth[at]))
            at = self.fail[at]
        self.ends[state] = tuple(found)
        return self.ends[state]

    def _walk(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of sorted distinct words. By bytes read: last token, its
        length, state of the automaton."""
        goto, ends, apart = self.goto, self.ends, self.apart
        last, size, states = [-1], [0], [0]
        before = b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :], size[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for d in range(shared + 1, len(word) + 1):
                key = state << 8 | word[d - 1]
                state = goto.get(key, -1)
                if state < 0:
                    state = goto[key] = self._follow(key >> 8, key & 255)
                states.append(state)
                for token, n in ends.get(state) or self._ends_at(state):
                    if n < d:
                        pair = last[d - n] << 24 | token
                        ok = apart.get(pair)
                        if ok is None:
                            ok = self._stays_apart(pair)
                        if not ok:
                            continue
                    last.append(token)
                    size.append(n)
                    break
            out, d = [], len(word)
            while d:
                out.append(last[d])
                d -= size[d]
            before = word
            out.reverse()
            yield struct.pack(f"<{len(out)}I", *out)

    def _learn(self, pieces: set[str]) -> list[str]:
        """Makes all pieces known; the long ones, which the caller is to forget.
        Of a full generation, what the next one uses stays."""
        if len(self.known) > MAX_WORDS:
            self.known, self.older = {}, self.known
        missing = pieces.difference(self.known)
        kept = {p: self.older[p] for p in missing if p in self.older}
        self.known |= kept
        self.known |= {p: struct.pack("<I", self.special[p]) for p in missing if p in self.special}
        order = sorted((p.encode("utf-8", "surrogatepass"), p) for p in missing if p not in self.known)
        self.known.update(zip((p for _, p in order), self._walk([b for b, _ in order])))
        return [p for p in missing if len(p) > LONG_WORD]

    def _parts(self, text: str) -> list[str]:
        if self.special_split is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        parts = self.special_split.split(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.split.findall(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        pieces = [self._parts(t) for t in texts]
        long = self._learn(set(chain.from_iterable(pieces)))
        found = [b"".join(map(self.known.__getitem__, p)) for p in pieces]
        for p in long:
            del self.known[p]
        return found

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[int, TrieBpe] = {}


def _loaded(spec: object) -> TrieBpe:
    """One per Python worker: what it has learnt serves the next tasks too."""
    key = hash(spec.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = TrieBpe(spec.value)
    return _LOADED[key]


def _broadcast(spark: SparkSession, path: str | None) -> object:
    """The vocabulary file, read on the driver; its size doesn't depend on the data."""
    with open(path or default_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            yield batch.slice(at, DOCS)


def _encoder(spec: object, back: bool) -> Callable:
    """Ids of the texts; with ``back``, also what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec)
        for part in _slices(batches):
            found = bpe.encode(part.column(1).to_pylist())
            columns = [part.column(0), pa.array(found, pa.binary())]
            if back:
                columns.append(pa.array(list(map(bpe.decode, found)), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return run


def _decoder(spec: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec)
        for part in _slices(batches):
            texts = [bpe.decode(x or b"") for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids: the tokens of the whole text as little-endian unsigned
    32-bit integers. Special tokens of the file are recognised in texts.

    Null and empty texts give empty ids; a null doc_id stays null; repeated rows
    return as often; an empty table gives an empty result; further columns are
    not read. ``path`` is a byte-level BPE file in the tokenizers' JSON format.
    """
    return id_and_text(docs).mapInArrow(_encoder(_broadcast(spark, path), False), schema_with(docs.select("doc_id"), "ids binary"))


def decode(spark: SparkSession, tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded: the text of ``ids`` as ``encode`` returns them."""
    read = tokens.select("doc_id", "ids")
    return read.mapInArrow(_decoder(_broadcast(spark, path)), schema_with(read, "decoded string"))


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded: ``encode`` and ``decode`` in one worker."""
    return id_and_text(docs).mapInArrow(_encoder(_broadcast(spark, path), True), schema_with(docs.select("doc_id"), "ids binary", "decoded string"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(round_trip(spark, table(spark, sf_dir, "documents")))


def token_digests(tokens: DataFrame, *more: str) -> DataFrame:
    return tokens.select(
        "doc_id",
        F.expr("length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
