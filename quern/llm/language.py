"""Language spans: scripts narrow the candidates of each word, Viterbi over word scores labels the words.

A word is a run of letters and marks that holds a letter. Its score in a language is the sum of the log
probabilities of its two- and three-character grams, edges included, hashed to a fixed number of slots.
Switching the language between two words costs a penalty, so a span must earn its label.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.core import col
from quern.llm.batches import lists, slices, without

SLOTS = 1 << 15
CHUNK = 4 << 20
EVEN = 0.05
UNKNOWN = "und"
EDGE = 32

# First and last code point of the scripts' blocks (Unicode). Letters elsewhere count as Latin or other.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
OTHER = len(SCRIPTS)


@dataclass
class LanguageModel:
    """Learned languages in order, log probability of each slot and the scripts each language uses."""

    langs: list[str]
    logp: np.ndarray  # languages x slots
    uses: np.ndarray  # scripts x languages


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 outside words, 1 mark, 2 letter; and the script."""
    kind, script = np.zeros(0x110000, np.uint8), np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        kind[c] = 2 if major == "L" else major == "M"
    for i, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            script[first : last + 1] = i
    return kind, script


@dataclass
class _Words:
    """Words of several texts: position of the edge before each word, end, letters, script, first word of each text."""

    before: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    first: np.ndarray
    base: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray


def _words(texts: list[str]) -> _Words:
    kind_of, script_of = _tables()
    texts = [t.replace("İ", "i").lower() for t in texts]
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=base[1:])
    joined = "\n" + "\n".join(texts) + "\n\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kind_of[cp]
    inside = kind > 0
    edge = np.diff(inside.astype(np.int8))
    before = np.flatnonzero(edge == 1)  # the position before the first character of a word
    end = np.flatnonzero(edge == -1) + 1
    letter = (kind == 2).astype(np.int32)
    total = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(letter, out=total[1:])
    letters = total[end] - total[before]
    keep = letters > 0
    before, end, letters = before[keep], end[keep], letters[keep]
    first_letter = np.searchsorted(total, total[before] + 1) - 1
    c = np.where(inside, cp, EDGE).astype(np.uint32)
    x = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    pairs = ((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE3D) >> np.uint32(17)).astype(np.int32)
    x = x[:-1] + c[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
    triples = ((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE3D) >> np.uint32(17)).astype(np.int32)
    triples[~inside[1:-1]] = SLOTS  # the gram would reach past its word
    return _Words(before, end, letters, script_of[cp[first_letter]], np.searchsorted(before, base), base, pairs, triples)


def _per_word(values: np.ndarray, w: _Words) -> np.ndarray:
    """Sum of values from the edge before each word to its last character."""
    at = np.empty(2 * len(w.before), np.int64)
    at[::2], at[1::2] = w.before, w.end
    return np.add.reduceat(values, at)[::2] if len(at) else np.zeros(0, values.dtype)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = SLOTS + OTHER + 1
    seen: dict[str, np.ndarray] = {}

    def flush():
        for lang, n in seen.items():
            slot = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(n[slot], pa.int64())], names=["lang", "slot", "n"])
        seen.clear()

    for whole in batches:
        for batch in slices(whole, "text", CHUNK):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                w = _words([t for t, g in zip(texts, langs, strict=True) if g == lang])
                if len(seen) >= 256 and lang not in seen:
                    yield from flush()
                n = seen.setdefault(lang, np.zeros(width, np.int64))
                used = np.zeros(len(w.pairs) + 2, np.int32)
                np.add.at(used, w.before, 1)
                np.add.at(used, w.end, -1)
                used = np.cumsum(used) > 0
                n[:SLOTS] += np.bincount(w.pairs[used[: len(w.pairs)]], minlength=SLOTS)
                n[:SLOTS] += np.bincount(w.triples[used[: len(w.triples)]], minlength=SLOTS + 1)[:SLOTS]
                n[SLOTS:] += np.bincount(w.script, weights=w.letters, minlength=OTHER + 1).astype(np.int64)
    yield from flush()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", script_share: float = 0.01) -> LanguageModel:
    """Learn from all rows with a text and a language; the counts are exact and independent of row order.

    Every task sends one count per language and slot, so the driver gets at most languages x (32,768 + 15) numbers.
    A language uses a script if at least `script_share` of its letters are of it. Without rows there are no languages.
    """
    rows = docs.select(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.zeros((len(langs), SLOTS + OTHER + 1))
    n[np.searchsorted(langs, counts["lang"]) if langs else [], counts["slot"]] = counts["n"]
    grams, letters = n[:, :SLOTS], n[:, SLOTS:]
    # a part of each distribution is even, so an unseen gram costs the same in a language with much text or little
    logp = np.log((1 - EVEN) * grams / np.maximum(grams.sum(1, keepdims=True), 1) + EVEN / SLOTS).astype(np.float32)
    uses = (letters >= script_share * np.maximum(letters.sum(1, keepdims=True), 1)) & (letters > 0)
    return LanguageModel(langs, np.concatenate([logp, np.zeros((len(langs), 1), np.float32)], axis=1), uses.T.copy())


def _viterbi(emit: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; all texts advance together, one word a step."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    start, sizes = first[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts with more than t words
    best_from = np.zeros(len(emit), np.uint16)
    switch = np.zeros(emit.shape, bool)
    state = np.zeros((len(sizes), emit.shape[1]), np.float32)
    for t in range(steps):
        k = active[t]
        at, v = start[:k] + t, state[:k]
        if t:
            best = v.argmax(1)
            top = v[np.arange(k), best][:, None] - np.float32(penalty)
            best_from[at], switch[at] = best, top > v
            v = np.maximum(v, top)
        v = v + emit[at]
        state[:k] = v - v.max(1, keepdims=True)
    label = np.zeros(len(emit), np.int64)
    now = state.argmax(1) if emit.shape[1] else np.zeros(len(sizes), np.int64)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        label[at] = now[:k]
        now[:k] = np.where(switch[at, now[:k]], best_from[at], now[:k])
    return label


def _label(batches: Iterable[pa.RecordBatch], model: LanguageModel, penalty: float) -> Iterator[pa.RecordBatch]:
    names = pa.array([*model.langs, UNKNOWN])
    n = len(model.langs)
    for whole in batches:
        for batch in slices(whole, "_text", CHUNK):
            w = _words([t or "" for t in batch.column("_text").to_pylist()])
            sizes = np.diff(w.first)
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            emit = np.empty((len(w.before), n), np.float32)
            for i, table in enumerate(model.logp):
                score = table[w.pairs]
                score[: len(w.triples)] += table[w.triples]
                emit[:, i] = _per_word(score, w)
            allowed = model.uses[w.script]
            emit[~allowed] = -1e6
            emit[~allowed.any(1)] = 0  # no learned language uses the script: the neighbours decide
            label = _viterbi(emit, w.first, penalty) if n else np.zeros(len(emit), np.int64)
            share = np.zeros((len(sizes), max(n, 1)))
            np.add.at(share, (text_of, label), w.letters)
            letters = share.sum(1)
            known = (letters > 0) & (n > 0)
            pick = np.where(known, share.argmax(1), n)
            score = np.where(known, share.max(1) / np.maximum(letters, 1), 0.0)
            fresh = np.ones(len(label), bool)
            fresh[1:] = (label[1:] != label[:-1]) | (text_of[1:] != text_of[:-1])
            opens = np.flatnonzero(fresh) if n else np.zeros(0, np.int64)
            closes = np.append(opens[1:], len(label))[: len(opens)] - 1
            shift = w.base[text_of[opens]]
            spans = pa.StructArray.from_arrays([pa.array(w.before[opens] - shift, pa.int32()), pa.array(w.end[closes] - 1 - shift, pa.int32()), names.take(pa.array(label[opens]))], names=["start", "stop", "lang"])
            made = [names.take(pa.array(pick)), pa.array(score, pa.float64()), lists(spans, np.bincount(text_of[opens], minlength=len(sizes)))]
            rest = [(f, c) for f, c in zip(batch.schema.names, batch.columns, strict=True) if f != "_text"]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + made, names=[f for f, _ in rest] + ["lang_pred", "score", "spans"])


def label(docs: DataFrame, model: LanguageModel, text: str = "text", penalty: float = 12.0) -> DataFrame:
    """Adds `lang_pred`, `score` and `spans` (start, stop in code points, lang) to every row, from the text alone.

    `lang_pred` has the most letters in the spans (ties: first in order), `score` is its share of the letters.
    Null or letterless texts, or a model without languages: `und`, 0 and no spans. Words of a script that no
    learned language uses take their neighbours' label. Input columns with the new names are replaced.
    """
    kept = without(docs, ["lang_pred", "score", "spans", "_text"])
    rows = docs.select(*[col(c) for c in kept.columns], col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields), "lang_pred string, score double, spans array<struct<start:int, stop:int, lang:string>>"])
    return rows.mapInArrow(lambda batches: _label(batches, model, penalty), schema)
