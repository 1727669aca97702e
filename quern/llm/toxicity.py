"""Toxicity of texts: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two words sums, over all letter subsequences of length 3 that both have, their weights: LAMBDA to the
power of the span that each covers. So `id-iot` and `idxiot` stay close to `idiot`; marks inside a word are gaps, and a
spelt-out word (`i d i o t`, `i.d.i.o.t`) is read without them. A sentence is the sum of its distinct words under the
cube of the normalised kernel; landmarks are words, chosen by how much their document counts differ between labels,
and frequent clean words near to them. The machine is trained on sentences: all of clean texts, and of each toxic text the one that looks worst
(found anew after each round). A text scores by its worst sentences, through a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.core import col
from quern.llm.batches import lists, release, slices, without

LAMBDA = 0.8
WORST = 3  # sentences of a text that its score depends on
SPAN = 7  # places that a subsequence may cover
LETTERS = 64
FEATURES = LETTERS**3
BLOCK = 2 << 20
LONGEST = 40  # letters of a landmark


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point below 65,536: letter number (0: none; A-Z as a-z), blank, end of a sentence."""
    code, blank, stop = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            code[i] = low - 96 if 97 <= low <= 122 else 27 + low % 37
        blank[i] = c.isspace()
    stop[[ord(c) for c in ".!?…。！？"]] = True
    return code, blank, stop


CODE, BLANK, STOP = _tables()
# Places of the second and third letter of a subsequence after its first.
OFFSETS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


class Units:
    """The words of some texts: letter numbers of the distinct ones end to end, and text and sentence of each word."""

    def __init__(self, texts: list[str | None]):
        sizes = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
        points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(points, 0xFFFF)
        code = np.where(points > 0xFFFF, 27 + points % 37, CODE[low]).astype(np.uint8)
        blank, stop = BLANK[low] & (points <= 0xFFFF), STOP[low] & (points <= 0xFFFF)
        n = len(points)
        head = np.zeros(n + 1, bool)  # first character of a text
        head[np.cumsum(sizes) - sizes] = True
        head, ends = head[:n], np.cumsum(sizes)
        after = np.append(blank[1:] | head[1:], True)[:n]
        close = (stop & after) | (points == 10)
        sentence = np.cumsum(head | np.append(False, close[:-1])[:n])
        solid = ~blank
        begin = np.flatnonzero(solid & (head | np.append(True, blank[:-1])[:n]))
        end = np.flatnonzero(solid & after) + 1
        letters = np.append(0, np.cumsum(code > 0))
        single = (letters[end] - letters[begin] == 1) & (end - begin <= 2)
        text = np.searchsorted(ends, begin, "right")
        joins = np.zeros(len(begin), bool)  # belongs to the word before
        if len(begin) > 2:
            chain = single[1:] & single[:-1] & (text[1:] == text[:-1])
            three = np.zeros(len(begin) + 1, bool)  # a run of three single letters
            run = chain[1:] & chain[:-1]
            for shift in (0, 1):
                three[1 + shift : 1 + shift + len(run)] |= run
            joins[1:] = chain & three[1 : len(begin)]
        first = np.flatnonzero(~joins)
        last = np.append(first[1:], len(begin))[: len(first)] - 1
        begin, end = begin[first], end[last]
        self.text, self.sentence = text[first], (sentence[begin] if len(begin) else begin)
        size = end - begin
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pairs = np.append(0, np.cumsum((code[1:] > 0) & (code[:-1] > 0)))
        spelt = (letters[end] - letters[begin] > 2) & (pairs[end - 1] == pairs[begin])
        stay = (code[at] > 0) | ~np.repeat(spelt, size)
        at, size = at[stay], np.where(spelt, letters[end] - letters[begin], size)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(code[at].tobytes())])
        coded = words.dictionary_encode()
        self.which = coded.indices.to_numpy().astype(np.int64)
        self.distinct = coded.dictionary

    def once(self, touched: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, sentence, word) of the touched words of each sentence; a word counts once in its sentence."""
        at = np.flatnonzero(touched[self.which]) if len(self.which) else self.which
        key = np.unique(self.sentence[at] * max(1, len(self.distinct)) + self.which[at])
        sentence, word = np.divmod(key, max(1, len(self.distinct)))
        start = np.searchsorted(self.sentence, sentence, "left")
        return self.text[start], sentence, word


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of words end to end, and the word of each."""
    sizes = np.fromiter(map(len, words.to_pylist()), np.int64, len(words))
    return np.frombuffer(b"".join(words.to_pylist()), np.uint8).astype(np.int32), np.repeat(np.arange(len(words)), sizes)


def subsequences(codes: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, feature, weight) of every subsequence of three letters, by its span."""
    n = len(codes)
    for j, k in OFFSETS:
        if n <= k:
            continue
        x, y, z = codes[: n - k], codes[j : n - k + j], codes[k:]
        ok = np.flatnonzero((x > 0) & (y > 0) & (z > 0) & (word[: n - k] == word[k:]))
        yield word[ok], (x[ok] * LETTERS + y[ok]) * LETTERS + z[ok], LAMBDA ** (k + 1)


def _root(key: np.ndarray, weight: np.ndarray, words: int) -> np.ndarray:
    """Root of each word's kernel with itself, from its subsequences as word * FEATURES + feature."""
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    square = np.add.reduceat(weight, first) ** 2 if len(first) else np.zeros(0)
    return np.sqrt(np.bincount(key[first] // FEATURES, weights=square, minlength=words))


def _norms(codes: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    parts = list(subsequences(codes, word))
    if not parts:
        return np.zeros(words)
    return _root(np.concatenate([w * FEATURES + f for w, f, _ in parts]), np.concatenate([np.full(len(w), x) for w, _, x in parts]), words)


class Landmarks:
    """Landmark words, as lists over the subsequences that they have."""

    def __init__(self, words: list[bytes]):
        self.words = words
        codes, word = _flat(pa.array(words, pa.binary()))
        parts = list(subsequences(codes, word))
        w, f = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
        x = np.concatenate([np.full(len(p[0]), p[2]) for p in parts]) if parts else np.zeros(0)
        key, at = np.unique(f * len(words) + w, return_inverse=True)
        self.owner = key % max(1, len(words))
        self.weight = np.bincount(at, weights=x, minlength=len(key)) / np.maximum(_norms(codes, word, len(words)), 1e-30)[self.owner]
        features, count = np.unique(key // max(1, len(words)), return_counts=True)
        self.number = np.full(FEATURES, -1, np.int32)
        self.number[features] = np.arange(len(features))
        self.first, self.count = np.cumsum(count) - count, count

    def similarity(self, distinct: pa.Array, words: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words that share a subsequence with a landmark, and their the cube of their normalised kernel with each
        landmark, some words at a time."""
        m = len(self.words)
        for start in range(0, len(distinct), words):
            codes, word = _flat(distinct[start : start + words])
            n = min(words, len(distinct) - start)
            every = list(subsequences(codes, word))
            if not every:
                continue
            w, f = (np.concatenate([e[i] for e in every]) for i in (0, 1))
            x = np.concatenate([np.full(len(e[0]), e[2]) for e in every])
            number = self.number[f]
            hit = np.flatnonzero(number >= 0)
            near = np.flatnonzero(np.bincount(w[hit], minlength=n))
            if not len(near):
                continue
            row = np.full(n, -1)
            row[near] = np.arange(len(near))
            count = self.count[number[hit]]
            at = np.arange(count.sum()) + np.repeat(self.first[number[hit]] - (np.cumsum(count) - count), count)
            shared = np.bincount(np.repeat(row[w[hit]], count) * m + self.owner[at], weights=np.repeat(x[hit], count) * self.weight[at], minlength=len(near) * m).reshape(-1, m)
            mine = np.flatnonzero(row[w] >= 0)
            shared /= _root(row[w[mine]] * FEATURES + f[mine], x[mine], len(near))[:, None]
            yield near + start, shared * shared * shared


@dataclass
class Model:
    """Landmark words, the weight of the kernel with each, and the logistic curve over a text's worst sentences."""

    words: list[bytes]
    weights: list[float]
    slopes: list[float]
    offset: float


def _probability(worst: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(worst @ np.array(model.slopes) + model.offset, -60, 60)))


def _largest(text: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    """The WORST largest values of each text in descending order, 0 where it has fewer."""
    out = np.zeros((texts, WORST))
    order = np.lexsort((-values, text))
    nth = np.arange(len(order)) - np.searchsorted(text[order], text[order], "left")
    keep = nth < WORST
    out[text[order[keep]], nth[keep]] = values[order[keep]]
    return out


def worst_sentences(units: Units, landmarks: Landmarks, weights: np.ndarray, texts: int) -> np.ndarray:
    """Largest sums among the sentences of each text that have a word near a landmark."""
    worth, touched = np.zeros(len(units.distinct)), np.zeros(len(units.distinct), bool)
    for near, similar in landmarks.similarity(units.distinct):
        worth[near], touched[near] = similar @ weights, True
    text, sentence, word = units.once(touched)
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    return _largest(text[first], np.add.reduceat(worth[word], first) if len(word) else np.zeros(0), texts)


def _score(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    landmarks, weights = Landmarks(model.words), np.array(model.weights)
    for whole in batches:
        for batch in slices(whole, "_text", BLOCK):
            texts = batch.column("_text").to_pylist()
            score = _probability(worst_sentences(Units(texts), landmarks, weights, len(texts)), model)
            rest = {f: c for f, c in zip(batch.schema.names, batch.columns, strict=True) if f != "_text"} | {"score": pa.array(score)}
            yield pa.RecordBatch.from_arrays(list(rest.values()), names=list(rest))
    release()


def _doc_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text, summed per block: in how many toxic and clean texts."""
    for whole in batches:
        for batch in slices(whole, "t", BLOCK):
            units = Units(batch.column("t").to_pylist())
            label = batch.column("y").to_numpy()
            n = max(1, len(units.distinct))
            pairs = np.unique(units.text * n + units.which)
            toxic = label[pairs // n] == 1
            counts = [np.bincount(pairs[m] % n, minlength=n)[: len(units.distinct)] for m in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([units.distinct.cast(pa.binary()), *[pa.array(c) for c in counts]], names=["word", "toxic", "clean"])


def _doc_sentences(batches: Iterable[pa.RecordBatch], words: list[bytes], most: int) -> Iterator[pa.RecordBatch]:
    """Kernel sums of each text's sentences, the `most` ones that are nearest to a landmark."""
    landmarks = Landmarks(words)
    for whole in batches:
        for batch in slices(whole, "t", BLOCK):
            units = Units(batch.column("t").to_pylist())
            row, rows = np.full(len(units.distinct), -1), []
            for near, similar in landmarks.similarity(units.distinct):
                row[near] = np.arange(len(near)) + sum(map(len, rows))
                rows.append(similar.astype(np.float32))
            text, sentence, word = units.once(row >= 0)
            if not len(word):
                continue
            similar = np.concatenate(rows)
            first = np.flatnonzero(np.diff(sentence, prepend=-1))
            edges, sums, text = np.append(first, len(word)), [], text[first]
            for p in range(0, len(first), 4096):
                a, b = edges[p], edges[min(p + 4096, len(first))]
                sums.append(np.add.reduceat(similar[row[word[a:b]]], first[p : p + 4096] - a, axis=0))
            sums = np.concatenate(sums)
            order = np.lexsort((-sums.max(1), text))
            nth = np.arange(len(order)) - np.searchsorted(text[order], text[order], "left")
            keep = order[nth < most]
            ids = pa.compute.take(batch.column("k"), pa.array(text[keep]))
            label = batch.column("y").to_numpy()[text[keep]]
            flat = sums[keep].astype(np.float32).ravel()
            yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), lists(flat, np.full(len(keep), len(words)))], names=["k", "y", "x"])


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss (the last one is the bias), by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        return 0.5 * float(v @ ridge @ v) + float(cost @ np.maximum(0, 1 - y * (x @ v)) ** 2)

    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa = x[active]
        best = np.linalg.solve(ridge + 2 * xa.T @ (cost[active, None] * xa), 2 * xa.T @ (cost[active] * y[active]))
        step, now = 1.0, loss(w)
        while step > 1e-6 and loss(w + step * (best - w)) > now:
            step /= 2
        w, done = w + step * (best - w), now - loss(w + step * (best - w)) <= 1e-9 * now
        if done:
            break
    return w


def _curve(worst: np.ndarray, label: np.ndarray) -> tuple[list[float], float]:
    """Logistic curve over the worst sentences of texts, with a little smoothing."""
    x, goal = np.column_stack([worst, np.ones(len(worst))]), np.where(label == 1, 0.99, 0.01)
    ridge = np.diag([1e-3] * worst.shape[1] + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        hess = x.T @ ((p * (1 - p))[:, None] * x) + ridge
        step = np.linalg.solve(hess, x.T @ (p - goal) + ridge @ w)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1].tolist(), float(w[-1])


NEVER = Model([], [], [0.0] * WORST, -2.0)


def train(x: np.ndarray, label: np.ndarray, group: np.ndarray, texts: dict[int, int], gram: np.ndarray, words: list[bytes], rounds: int = 4, cost: float = 200.0) -> Model:
    """The model from sentences: rows of kernel sums, the label and the number of their text.

    `texts` has the label of every text, also of those without a sentence near a landmark.
    """
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    z = x @ root
    clean = label == 0
    none = sum(1 for k, y in texts.items() if y == 0) - len(np.unique(group[clean]))
    pick = np.zeros(len(x), bool)
    worst = x.max(1)
    for _ in range(rounds):
        order = np.lexsort((-worst, group))
        first = order[np.append(True, np.diff(group[order]) != 0)] if len(order) else order
        chosen = np.zeros(len(x), bool)
        chosen[first] = True
        chosen &= ~clean
        if (chosen == pick).all():
            break
        pick = chosen
        rows = np.concatenate([z[pick], z[clean], np.zeros((1, z.shape[1]))])
        y = np.concatenate([np.ones(pick.sum()), -np.ones(clean.sum() + 1)])
        each = np.concatenate([np.full(pick.sum(), 1 / max(1, pick.sum())), np.full(clean.sum(), 1 / max(1, clean.sum() + none)), [max(1, none) / max(1, clean.sum() + none)]])
        w = _svm(rows, y, cost * each)
        worst = z @ w[:-1]
    keys = np.array(sorted(texts))
    worst = _largest(np.searchsorted(keys, group), worst, len(keys))
    slopes, offset = _curve(worst, np.array([texts[k] for k in keys.tolist()]))
    return Model(words, (root @ w[:-1]).tolist(), slopes, offset)


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """About `most` labelled keys of each label, by a hash of the key, so that reruns agree."""
    count = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(12)), F.lit(1 << 30)) / float(1 << 30)
    share = {y: min(1.0, most / max(1, count.get(y, 0))) for y in (0, 1)}
    return labels.where(place < F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", landmarks: int = 112, near: int = 32, most: int = 4000, sentences: int = 6) -> Model:
    """The model of the texts that `labels` (key and label, 1: toxic, 0: clean, others are left out) names.

    Several labels of a key count as toxic if one is. About `most` keys of each label, chosen by a hash, are read; they
    are broadcast to the texts, which are not shuffled. Their texts give `landmarks` words that toxic texts have more
    often, `near` frequent clean words that look like those, and up to `sentences` sentences per text that are near to a
    landmark. These bounds hold what the driver sees: words and their counts, and most * 2 * sentences short vectors.
    Without toxic texts nothing scores 0.5.
    """
    marked = labels.select(col(key).alias("id"), col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    chosen = _sample(marked, most)
    used = docs.select(col(key).alias("id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "id")
    used = used.select(F.xxhash64("id", "t").alias("k"), "t", "y")
    used = used.persist()
    try:
        texts = {r["k"]: r["y"] for r in used.select("k", "y").distinct().collect()}
        n = {y: max(1, sum(1 for v in texts.values() if v == y)) for y in (0, 1)}
        counts = used.select("t", "y").mapInArrow(_doc_words, "word binary, toxic long, clean long")
        counts = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.length("word").between(3, LONGEST)).persist()
        ratio = F.log((F.col("toxic") + 0.5) / n[1] / ((F.col("clean") + 0.5) / n[0]))
        top = counts.where("toxic >= 2").select("word", (F.col("toxic") * ratio).alias("s")).where("s > 0").orderBy(F.desc("s"), "word").limit(landmarks).collect()
        often = counts.where(F.col("clean") * F.lit(n[1]) >= F.col("toxic") * F.lit(n[0])).orderBy(F.desc("clean"), "word").limit(5000).select("word").collect()
        counts.unpersist()
        words = [bytes(r["word"]) for r in top if np.count_nonzero(np.frombuffer(bytes(r["word"]), np.uint8)) >= 3]
        if not words:
            return NEVER
        others = [bytes(r["word"]) for r in often if bytes(r["word"]) not in set(words)]
        alike = np.zeros(len(others))
        for at, similar in Landmarks(words).similarity(pa.array(others, pa.binary())):
            alike[at] = similar.sum(1)
        words += [others[i] for i in np.argsort(-alike, kind="stable")[:near] if alike[i] > 0]
        found = used.select("k", "y", "t").mapInArrow(partial(_doc_sentences, words=words, most=sentences), "k long, y int, x array<float>").toArrow()
    finally:
        used.unpersist()
    if not found.num_rows:
        return NEVER
    name = {k: i for i, k in enumerate(texts)}
    group = np.array([name[k] for k in found.column("k").to_pylist()])
    x = found.column("x").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(group), -1)
    order = np.lexsort((*x.T[::-1], group))  # the same sums on every run
    gram = np.concatenate([s for _, s in Landmarks(words).similarity(pa.array(words, pa.binary()))])
    label_of = found.column("y").to_numpy()
    return train(x[order], label_of[order], group[order], {name[k]: y for k, y in texts.items()}, gram, words)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds `score` (0 to 1, higher: toxic likelier) and `predicted` (1 from 0.5 on) of every whole text.

    A null or empty text, or one without a word near a landmark, scores as a sentence without any. Input columns with
    the new names are replaced.
    """
    kept = without(docs, ["score", "predicted", "_text"])
    rows = docs.select(*[col(c) for c in kept.columns], col(text).cast("string").alias("_text"))
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    out = rows.mapInArrow(lambda b: _score(b, model), ", ".join([*fields, "score double"]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
