"""Exact removal of repeated word windows by level-wise doubling.

Every window of the target length is named by the smallest five-word window inside it, its anchor. Anchors that
occur once in the corpus cannot lie in a repeated window; the others are extended to windows of twice the length,
on either side, and again only those that repeat go on, until the target length is reached or nothing is left.

Texts are stored once, cut into slices and bucketed by slice. Per level each slice sends its distinct hashes, dealt
by value, and gets back one bit for each; so texts are shuffled at no level, and a passage that many documents
share is one hash per slice. Hashes only rule windows out. At the last level a slice sends the words around the anchors
of the distinct windows that are left, once for all windows of an anchor, and windows are equal if their words are.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.core import col, one_row, scratch_dir
from quern.llm.batches import raw_bytes, release, slices

BASE = 5
SLICE = 4 << 20
BUCKET = 64 << 20  # bytes of text in a bucket of slices, as far as Spark allows so many
MOST_BUCKETS = 100_000
NO_KEY = (1 << 63) - 1  # a null key comes after all others
LONG = 1024  # bytes of a word from which on it is hashed by itself
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_GOLD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of the texts of one block: byte ranges, text of each word, first word of each text, hashes of windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~_BLANK[data]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        opens[inner] = solid[inner]
        self.starts = np.flatnonzero(opens)
        closes = solid.copy()
        closes[:-1] &= ~solid[1:]
        before = inner[inner > 0] - 1
        closes[before] = solid[before]
        self.stops = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.data, self.offsets, self.solid = data, offsets, solid
        n = len(self.starts)
        self.left = np.repeat(self.first[1:], self.counts) - np.arange(n)  # words from here to the end of the text
        self.windows = {1: self._names()}

    def _names(self) -> np.ndarray:
        """A hash of each word: its length, then eight bytes at a time, mixed by turns."""
        raw = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), np.dtype("<u8"), buffer=raw, strides=(1,))
        size = self.stops - self.starts
        out = _mix(size.astype(np.uint64) * np.uint64(_GOLD))
        here = np.flatnonzero(size <= LONG)
        done = 0
        while len(here):
            left = size[here] - done
            part = eight[self.starts[here] + done] & _LOW[np.minimum(left, 8)]
            out[here] = _mix(out[here] ^ part)
            done += 8
            here = here[left > 8]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.stops[i]].tobytes())
        return out

    def _window(self, size: int) -> np.ndarray:
        """Hashes of all windows of a size, from those of half the size (rounded up) at both ends."""
        if size not in self.windows:
            half = (size + 1) // 2
            part, off = self._window(half), size - half
            out = np.zeros(len(part), np.uint64)
            stop = max(0, len(part) - off)
            out[:stop] = _mix(_mix(part[:stop] + np.uint64(size * _GOLD % (1 << 64))) ^ part[off:])
            self.windows[size] = out
        return self.windows[size]

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hash of the window of `size` words at each place (which must lie in one text)."""
        return self._window(size)[at]

    def numbers(self) -> np.ndarray:
        """A number for each word, the same for equal words alone."""
        upto = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.stops - self.starts, out=upto[1:])
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(upto), pa.py_buffer(self.data[self.solid].tobytes())])
        return flat.dictionary_encode().indices.to_numpy()

    def classes(self, places: np.ndarray, size: int) -> np.ndarray:
        """Number of the class of equal windows that each place belongs to: equal hashes, then equal words."""
        hashes, at = np.unique(self.hashes(places, size), return_inverse=True)
        word, first = self.numbers(), np.zeros(len(hashes), np.int64)
        first[at[::-1]] = places[::-1]
        odd = np.zeros(len(places), bool)
        for k in range(size):
            odd |= word[places + k] != word[first[at] + k]
        if odd.any():  # other words under one hash
            rows = np.flatnonzero(np.isin(at, at[odd]))
            own = np.unique(word[places[rows, None] + np.arange(size)], axis=0, return_inverse=True)[1].ravel()
            at[rows] = len(hashes) + own
            at = np.unique(at, return_inverse=True)[1]
        return at

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of `size` words, and the place of the smallest base window in each (leftmost)."""
        n = len(self.left)
        h = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        base = np.flatnonzero(self.left >= BASE)
        h[base] = self.hashes(base, BASE)
        best, span, need = np.arange(n), 1, size - BASE + 1
        while span < need:
            step = min(span, need - span)
            if step >= n:  # fewer words than that hold no window
                break
            other = best[step:]
            better = h[other] < h[best[: n - step]]
            best = best.copy()
            best[: n - step][better] = other[better]
            span += step
        at = np.flatnonzero(self.left >= size)
        return at, best[at]


def levels(size: int) -> list[int]:
    """Lengths between the anchors and the target at which windows are tested."""
    out, m = [], 2 * BASE
    while 2 * m <= size:
        out.append(m)
        m *= 2
    return out


class Search:
    """The levels of one slice: what it sends at each, given the answers to the levels before."""

    def __init__(self, texts: pa.Array, keys: np.ndarray, size: int):
        self.words, self.keys, self.size = Words(*raw_bytes(texts)), keys, size
        w = self.words
        self.text_of = np.repeat(np.arange(len(keys)), w.counts)
        self.at, self.anchor = w.anchors(size)

    def anchors(self) -> np.ndarray:
        return self.anchor[np.flatnonzero(np.diff(self.anchor, prepend=-1))] if len(self.anchor) else self.anchor

    def sides(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Which windows hold the m words from their anchor on, and the m words up to its end."""
        ahead = self.anchor + m <= self.at + self.size
        behind = self.anchor + BASE - m >= self.at
        return ahead, behind

    def sent(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of a level below the last one, in order, and how often each occurs here."""
        w = self.words
        if level == BASE:
            places = self.anchors()
        else:
            ahead, behind = self.sides(level)
            places = np.unique(np.concatenate([self.anchor[ahead], self.anchor[behind] + BASE - level]))
        distinct, self.back, count = np.unique(w.hashes(places, level), return_inverse=True, return_counts=True)
        self.places = places
        return distinct, count

    def last(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the last level sends: runs of distinct windows, as (bucket, first window, number), and all their windows.

        Windows are sent by the first place of each class of equal ones. A run holds neighbours that share an anchor;
        the anchor's words name its bucket. Equal windows have equal anchors.
        """
        w = self.words
        self.back = w.classes(self.at, self.size)
        n = int(self.back.max()) + 1 if len(self.back) else 0
        self.least = np.full(n, NO_KEY, np.int64)
        np.minimum.at(self.least, self.back, self.keys[self.text_of[self.at]])
        one = np.full(n, len(self.at), np.int64)
        np.minimum.at(one, self.back, np.arange(len(self.at)))
        one = np.sort(one)
        at, anchor = self.at[one], self.anchor[one]
        first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(anchor, prepend=-1) != 0))
        number = np.diff(np.append(first, len(one)))
        bucket = _bucket(w.hashes(anchor[first], BASE), buckets)
        order = np.argsort(bucket, kind="stable")
        first, number = first[order], number[order]
        windows = one[np.repeat(first - (np.cumsum(number) - number), number) + np.arange(number.sum())]
        return bucket[order], at[first], number, windows

    def keep(self, level: int, repeated: np.ndarray) -> None:
        """Drop the windows that hold a window of this level which occurs once."""
        alive = np.zeros(len(self.words.left), bool)
        alive[self.places] = repeated[self.back]
        if level == BASE:
            ok = alive[self.anchor]
        else:
            ahead, behind = self.sides(level)
            ok = (~ahead | alive[np.where(ahead, self.anchor, 0)]) & (~behind | alive[np.where(behind, self.anchor + BASE - level, 0)])
        self.at, self.anchor = self.at[ok], self.anchor[ok]

    def removed(self, first_here: np.ndarray) -> np.ndarray:
        """Words to remove: those of windows that a smaller key or an earlier place of the same text has, too."""
        text = self.text_of[self.at]
        later = self.keys[text] > self.least[self.back]
        order = np.lexsort((self.at, text, self.back))
        again = np.zeros(len(order), bool)
        if len(order):
            again[order[1:]] = (self.back[order[1:]] == self.back[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        starts = self.at[later | again | ~first_here[self.back]]
        cover = np.zeros(len(self.words.left) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + self.size, -1)
        return np.cumsum(cover)[:-1] > 0


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _advance(table: pa.Table, answers: pa.Table | None, size: int, buckets: int) -> Search:
    """The search of a slice as far as the answers go."""
    table = table.sort_by("_nth").combine_chunks()
    keys = table.column("_key").combine_chunks().fill_null(NO_KEY).to_numpy()
    search = Search(table.column("_text").combine_chunks(), keys, size)
    search.table = table
    search.first_here = None
    if answers is not None:
        by_level: dict[int, dict[int, bytes]] = {}
        for level, bucket, bits in zip(*(answers.column(c).to_pylist() for c in ("level", "bucket", "bits")), strict=True):
            by_level.setdefault(level, {})[bucket] = bits
        for level in sorted(set(by_level) | {BASE}):
            if level == size:
                bucket, _, number, windows = search.last(buckets)
                place = np.repeat(bucket, number)
                flags = np.zeros(len(windows), bool)
            else:
                distinct, count = search.sent(level)
                flags, place = np.zeros(len(distinct), bool), _bucket(distinct, buckets)
            for bucket, bits in by_level.get(level, {}).items():
                mine = np.flatnonzero(place == bucket)
                flags[mine] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)).astype(bool)
            if level < size:
                search.keep(level, flags | (count > 1))
            else:
                search.first_here = np.zeros(len(windows), bool)
                search.first_here[search.back[windows]] = flags
    return search


SENT = "slice long, bucket long, hashes binary, docs binary, doc_of binary"  # hashes: at the last level sizes, then words
ANSWER = "slice long, level int, bucket long, bits binary"


def _send(search: Search, slice_id: int, level: int, buckets: int) -> pa.Table:
    rows = []
    if level < search.size:
        distinct, _ = search.sent(level)
        place = _bucket(distinct, buckets)
        order = np.argsort(place, kind="stable")
        cuts = np.flatnonzero(np.diff(place[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
        for p, q in zip(cuts[:-1], cuts[1:], strict=True):
            rows.append((int(place[order[p]]), distinct[order[p:q]].tobytes(), b"", b""))
    else:
        w = search.words
        bucket, at, number, windows = search.last(buckets)
        start, stop = w.starts[at], (w.stops[at + number + search.size - 2] if len(at) else at)
        upto = np.append(0, np.cumsum(number))
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, np.int64)
        for p, q in zip(cuts[:-1], cuts[1:], strict=True):
            size = stop[p:q] - start[p:q]
            text = w.data[np.repeat(start[p:q] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            docs, of = np.unique(search.least[search.back[windows[upto[p] : upto[q]]]], return_inverse=True)
            kind = np.uint16 if len(docs) <= 1 << 16 else np.uint32
            head = np.concatenate([[q - p], size]).astype(np.int64).tobytes()
            rows.append((int(bucket[p]), head + text.tobytes(), docs.tobytes(), of.astype(kind).tobytes()))
    return pa.table({"slice": pa.array([slice_id] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int64()), **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(("hashes", "docs", "doc_of"), 1)}})


def _twins(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes per row, and whether another row of the bucket has each."""
    sent = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
    h = np.concatenate(sent)
    order = np.argsort(h, kind="stable")
    twin = h[order[1:]] == h[order[:-1]]
    yes = np.zeros(len(h), bool)
    yes[order[1:]] |= twin
    yes[order[:-1]] |= twin
    return np.fromiter(map(len, sent), np.int64, len(sent)), yes


def _firsts(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows per row, and whether the smallest key that has each one's words is there."""
    texts, sizes, keys = [], [], []
    for words, docs, of in zip(*(table.column(c).to_pylist() for c in ("hashes", "docs", "doc_of")), strict=True):
        n = int(np.frombuffer(words, np.int64, 1)[0])
        sizes.append(np.frombuffer(words, np.int64, n, 8))
        texts.append(np.frombuffer(words, np.uint8, offset=8 + 8 * n))
        docs = np.frombuffer(docs, np.int64)
        keys.append(docs[np.frombuffer(of, np.uint16 if len(docs) <= 1 << 16 else np.uint32)])
    w = Words(np.concatenate(texts), np.append(0, np.cumsum(np.concatenate(sizes))))
    key, at = np.concatenate(keys), np.flatnonzero(w.left >= size)
    same = w.classes(at, size)
    least = np.full(len(at), NO_KEY, np.int64)
    np.minimum.at(least, same, key)
    return np.fromiter(map(len, keys), np.int64, len(keys)), key == least[same]


def _answer(table: pa.Table, level: int, final: bool) -> pa.Table:
    """One bit per hash and slice of a bucket: does another slice have it; at the last level, is the smallest key here."""
    sizes, yes = _firsts(table, level) if final else _twins(table)
    ends = np.cumsum(sizes)
    bits = [np.packbits(yes[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
    return pa.table({"slice": table.column("slice"), "level": pa.array([level] * len(bits), pa.int32()), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _answering(level: int, final: bool):
    return lambda table: _answer(table, level, final)


def _finish(search: Search, slice_id: int) -> pa.Table:
    """The texts without their removed words (and the blanks behind them), and the counts."""
    w, table = search.words, search.table
    gone = search.removed(search.first_here if search.first_here is not None else np.ones(0, bool)) if len(search.at) else np.zeros(len(w.left), bool)
    data, offsets = raw_bytes(table.column("_text").combine_chunks())
    last = w.left == 1
    stops = np.append(w.starts[1:], len(data)) if len(w.starts) else w.starts
    stops = np.where(last, w.offsets[1:][search.text_of], stops) if len(stops) else stops
    cut = np.zeros(len(data) + 1, np.int32)
    np.add.at(cut, w.starts[gone], 1)
    np.add.at(cut, stops[gone], -1)
    stay = np.cumsum(cut)[:-1] == 0
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(stay, out=kept[1:])
    text = pa.LargeStringArray.from_buffers(len(table), pa.py_buffer(kept[offsets].tobytes()), pa.py_buffer(data[stay].tobytes())).cast(pa.string())
    text = pa.compute.if_else(table.column("_text").combine_chunks().is_null(), pa.scalar(None, pa.string()), text)
    n_removed = np.bincount(search.text_of[gone], minlength=len(table))
    return pa.table({"_row": table.column("_row"), "_text": text, "_n_words": pa.array(w.counts, pa.int64()), "_n_removed": pa.array(n_removed, pa.int64())})


def _slice_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the slices of a task and the rows of each."""
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in slices(whole, "_text", SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, number, np.int64)), pa.array(np.arange(batch.num_rows, dtype=np.int64))], names=[*batch.schema.names, "slice", "_nth"])
            number += 1


def _store(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """The documents as a table bucketed by slice, in the shared folder, and its name in the catalogue."""
    spark = docs.sparkSession
    rest = F.struct(F.lit(0).alias("_none"), *[col(c) for c in docs.columns if c != text])
    rows = docs.select(rest.alias("_row"), col(text).cast("string").alias("_text"), col(key).cast("long").alias("_key"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" if f.name != "_row" else f"_row {_struct(f.dataType)}" for f in rows.schema.fields)
    sliced = rows.mapInArrow(_slice_rows, f"{fields}, slice long, _nth long")
    name = f"slices_{os.urandom(8).hex()}"
    size = one_row(docs, F.sum(F.octet_length(col(text))))[0] or 0
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET)), MOST_BUCKETS)
    sliced.write.bucketBy(buckets, "slice").option("path", scratch_dir(spark, name)).saveAsTable(name)
    return spark.table(name), name


def _struct(kind) -> str:
    return "struct<" + ", ".join(f"`{f.name.replace('`', '``')}`: {f.dataType.simpleString()}" for f in kind.fields) + ">"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20, n_words: str | None = None, n_removed: str | None = None) -> DataFrame:
    """The rows of `docs` with every word taken out of `text` that a repeated window of `size` words covers.

    A window counts as repeated if its words also start in a row of a smaller key, or earlier in the same row; the
    first occurrence stays. Windows are judged on the input. Removed words go with the blanks behind them, other
    text stays as it is. Null and short texts stay; null keys come last; rows that share a key (or have none) never
    take words from each other, so repeated rows come out equal. Columns keep their order; `n_words` and
    `n_removed` name optional new columns, which replace input columns of those names.
    """
    if size < 2 * BASE:
        raise ValueError(f"windows must have at least {2 * BASE} words")
    table, name = _store(docs, key, text)
    buckets = max(12, -(-table.select("slice").distinct().count() // 4))
    answers = None
    for level in [BASE, *levels(size), size]:
        sent = _over(table, answers, partial(_send, level=level, buckets=buckets), SENT, size, buckets)
        found = sent.groupBy("bucket").applyInArrow(_answering(level, level == size), ANSWER)
        path = scratch_dir(docs.sparkSession, "answers")
        found.write.parquet(path)
        found = docs.sparkSession.read.schema(ANSWER).parquet(path)
        answers = found if answers is None else answers.unionAll(found)
    kinds = dict(table.dtypes)
    row = _struct(table.schema["_row"].dataType)
    out = _over(table, answers, _finish, f"_row {row}, _text {kinds['_text']}, _n_words long, _n_removed long", size, buckets)
    docs.sparkSession.sql(f"DROP TABLE {name}")  # the name only: the files lie in the shared folder, and are read yet
    new = {n: c for n, c in ((n_words, "_n_words"), (n_removed, "_n_removed")) if n}
    taken = {n.lower() for n in new}
    cols = [F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in taken]
    return out.select(*cols, *[F.col(c).alias(n) for n, c in new.items()])


def _over(table: DataFrame, answers: DataFrame | None, step, schema: str, size: int, buckets: int) -> DataFrame:
    """Run a step on every slice, with the answers it has got so far."""

    def run(key: tuple, rows: pa.Table, got: pa.Table | None) -> pa.Table:
        out = step(_advance(rows, got, size, buckets), key[0].as_py())
        release(collect=False)
        return out

    if answers is None:
        return table.groupBy("slice").applyInArrow(lambda k, t: run(k, t, None), schema)
    return table.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, schema)
