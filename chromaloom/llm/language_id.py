"""Language identification of whole texts, span by span.

Each word's script (ranges of code points) narrows the languages it may belong
to. A character-trigram model scores the word in each of them, and a Viterbi
pass with a penalty for switching labels the spans of a mixed text. The language
of the text is the one whose spans hold most letters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm.common import id_and_text, schema_with, table

#: The model is fitted on about so many labelled documents of each language at most.
SAMPLE_DOCS = 2000
#: Languages that a model may have: 64 KB each, in the driver and in what is broadcast.
MAX_LANGS = 1000
BUCKETS, SMOOTH = 1 << 14, 0.5
#: Nats that a change of language costs, and the most that one word can weigh.
SWITCH, MOST = 12.0, 10.0
#: Share of a language's letters from which it is written in a script.
SCRIPT_SHARE = 0.01
UND = "und"
DOCS, MAX_WORDS = 400, 150_000

# First and last code point of scripts' blocks.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
OTHER = len(SCRIPTS)
_EDGES = np.array(sorted({e for blocks in SCRIPTS.values() for lo, hi in blocks for e in (lo, hi + 1)}))
_SCRIPT_AT = np.full(len(_EDGES) + 1, OTHER, np.int64)
for _i, _blocks in enumerate(SCRIPTS.values()):
    for _lo, _hi in _blocks:
        _SCRIPT_AT[np.searchsorted(_EDGES, _lo, side="right")] = _i

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters; the pattern also lets through number signs
    such as superscripts, which on their own are no word."""
    low = text.lower()
    # where a letter becomes two, words are found before they are lower-cased
    found = _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def _grams(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed trigrams of all words, first trigram of each, script of each)."""
    text = " " + " ".join(found) + " "
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77C2B2AE63) + c[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS
    starts = np.flatnonzero(c[:-1] == 32)[: len(found)]
    return h, starts, _SCRIPT_AT[np.searchsorted(_EDGES, c[starts + 1].astype(np.int64), side="right")]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts by language, one row a language and bucket."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            if found := words(text.as_py()):
                h, starts, script = _grams(found)
                into = held.setdefault(lang.as_py(), np.zeros(BUCKETS + OTHER + 1, np.int64))
                # the trigram across the space between two words is left out
                inner = np.ones(len(h), bool)
                inner[starts[1:] - 1] = False
                into[:BUCKETS] += np.bincount(h[inner], minlength=BUCKETS)
                into[BUCKETS:] += np.bincount(script, minlength=OTHER + 1)
    for lang, counts in held.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])


class Model:
    """Log probabilities of trigrams, and which scripts each language uses."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        n = np.zeros((len(self.langs), BUCKETS + OTHER + 1))
        n[np.searchsorted(self.langs, counts["lang"]), counts["bucket"]] = counts["n"]
        grams = n[:, :BUCKETS] + SMOOTH
        self.log_p = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
        scripts = n[:, BUCKETS:]
        self.writes = (scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True)) >= SCRIPT_SHARE).T
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)

    def _score(self, found: list[str]) -> np.ndarray:
        """Log posterior of each word over the languages that write its script;
        all languages where none does."""
        h, starts, script = _grams(found)
        p = self.log_p[h]
        p[starts[1:] - 1] = 0
        total = np.add.reduceat(p, starts, axis=0)
        may = self.writes[script]
        may |= ~may.any(axis=1, keepdims=True)
        total = np.where(may, total, -np.inf)
        total -= total.max(axis=1, keepdims=True)
        total -= np.log(np.exp(total).sum(axis=1, keepdims=True))
        return np.maximum(total, -MOST).astype(np.float32)

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of ``scores`` for the words of each text."""
        fresh = list({w for t in texts for w in t if w not in self.known})
        if len(self.known) + len(fresh) > MAX_WORDS:
            self.known.clear()
            self.scores = self.scores[:0]
            fresh = list({w for t in texts for w in t})
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            self.known.update(zip(part, range(len(self.scores), len(self.scores) + len(part))))
            self.scores = np.vstack([self.scores, self._score(part)])
        get = self.known.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]

    def paths(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The best language of every word of every text, all texts abreast."""
        order = np.argsort([-len(r) for r in rows], kind="stable")
        lengths = np.array([len(rows[i]) for i in order])
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than t
        offsets = np.concatenate([[0], np.cumsum(active)])
        flat = np.empty(offsets[-1], np.int64)
        for place, i in enumerate(order):
            flat[offsets[: len(rows[i])] + place] = rows[i]
        emit = self.scores[flat]
        stays, source = np.empty(emit.shape, bool), np.empty(len(flat), np.int32)
        best = np.zeros((len(rows), len(self.langs)), np.float32)
        for t in range(longest):
            lo, hi = offsets[t], offsets[t + 1]
            cur = best[: hi - lo]
            top = cur.argmax(axis=1)
            away = cur[np.arange(hi - lo), top] - SWITCH
            source[lo:hi] = top
            stays[lo:hi] = cur >= away[:, None]
            # only differences count: sums stay small, however long the text
            best[: hi - lo] = np.maximum(cur, away[:, None]) - cur[np.arange(hi - lo), top][:, None] + emit[lo:hi]
        label = best.argmax(axis=1)
        out = np.empty(len(flat), np.int32)
        for t in range(longest - 1, -1, -1):
            lo, hi = offsets[t], offsets[t + 1]
            now = label[: hi - lo]
            out[lo:hi] = now
            keep = stays[np.arange(lo, hi), now]
            label[: hi - lo] = np.where(keep, now, source[lo:hi])
        found: list[np.ndarray] = [np.empty(0, np.int32)] * len(rows)
        for place, i in enumerate(order):
            found[i] = out[offsets[: len(rows[i])] + place]
        return found


def _spans(text: str, path: np.ndarray, langs: list[str]) -> list[dict]:
    """Spans of one language each, in code points of the text."""
    if not len(path):
        return []
    cuts = np.flatnonzero(np.diff(path)) + 1
    if not len(cuts):
        return [{"start": 0, "end": len(text), "lang": langs[path[0]]}]
    places = [m.start() for m in _WORD.finditer(text) if any(map(str.isalpha, m.group()))]
    edges = [0, *(places[c] for c in cuts), len(text)]
    return [{"start": a, "end": b, "lang": langs[path[c]]} for a, b, c in zip(edges, edges[1:], [0, *cuts])]


def _labeller(model: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                texts = part.column("text").to_pylist()
                split = [words(t) for t in texts]
                lang, score, found = [], [], []
                for text, ws, path in zip(texts, split, m.paths(m.ids(split)) if m.langs else [()] * len(texts)):
                    if not len(path):
                        lang.append(UND)
                        score.append(0.0)
                        found.append([])
                        continue
                    letters = np.bincount(path, weights=np.fromiter(map(len, ws), np.int64, len(ws)), minlength=len(m.langs))
                    top = int(letters.argmax())
                    lang.append(m.langs[top])
                    score.append(float(letters[top] / letters.sum()))
                    found.append(_spans(text, path, m.langs))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(found, spans)],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )

    return run


def fit(spark: SparkSession, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of ``labelled(doc_id, text, lang)``, from about ``sample_docs``
    documents of each language at most, chosen by a hash of doc_id.

    Rows without a language, an id or a letter teach nothing. What reaches the
    driver is one count for each language and hash bucket. More than MAX_LANGS
    languages are an error.
    """
    rows = labelled.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").filter("lang is not null and doc_id is not null")
    number = rows.groupBy("lang").count()
    if (langs := number.count()) > MAX_LANGS:
        raise ValueError(f"{langs} languages; a model has {MAX_LANGS} at most")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    share = number.select(F.col("lang").alias("_lang"), (sample_docs / F.col("count")).alias("share"))
    # MAX_LANGS rows at most; without the hint all texts would shuffle to meet them
    sample = rows.join(F.broadcast(share), (F.col("lang") == F.col("_lang")) & (drawn < F.col("share"))).select("lang", "text")
    counts = sample.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(counts.toPandas())


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in spans of lang_pred) and
    spans (start, end, lang; code points).

    Null and empty texts, and texts without a letter, are ``und`` with score 0
    and no spans; a null doc_id stays null; of equal shares the language first in
    the alphabet counts; repeated rows return as often; an empty table gives an
    empty result; further columns are not read.
    """
    held = spark.sparkContext.broadcast(model)
    schema = schema_with(docs.select("doc_id"), "lang_pred string", "score double", "spans array<struct<start:int,end:int,lang:string>>")
    return id_and_text(docs).mapInArrow(_labeller(held), schema)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(spark, docs.filter(fold(F.col("doc_id")) != 2))
    found = identify(spark, docs, model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["lang"], s["start"], s["end"])), ",")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", spans.alias("spans"))
