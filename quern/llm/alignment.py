"""Links between the tokens of two tokenizers over the same bytes, by products of sparse incidence matrices.

A row of a token-byte matrix marks the bytes of one token occurrence. With A and B for the two tokenizers, the product
A·Bᵀ has an entry for every two tokens that share a byte: the overlap links, with the number of shared bytes. Bytes
where tokens of both end cut a text into groups; products of the token-group matrices link all tokens of a group.
Products are Gustavson's, row by row over compressed rows, many texts at a time as one block-diagonal matrix.

How often each pair of ids is linked in the corpus is counted per slice of texts first, then summed by Spark.
"""

from __future__ import annotations

import functools
import json
import os
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.core import col, materialize
from quern.llm import pieces
from quern.llm.batches import lists, release, slices, without
from quern.llm.token_counts import PATTERN, byte_letters

SLICE = 4 << 20  # bytes of text whose id pairs are counted together
BLOCK = 256 << 10  # bytes of text in one product
KEEP = 400_000  # pre-tokens and marked words remembered in a task; only speed depends on it
SHORT = 64
PAIR_BITS = 40  # of a pair of ids; the number of its text in a block lies above


class Csr:
    """A sparse matrix of whole numbers in compressed rows."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.starts, self.columns, self.values, self.width = starts, columns, values, width

    @classmethod
    def runs(cls, sizes: np.ndarray) -> Csr:
        """Row i marks the next `sizes[i]` columns: tokens over bytes."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return cls(starts, np.arange(starts[-1], dtype=np.int32), np.ones(starts[-1], np.int32), int(starts[-1]))

    @classmethod
    def places(cls, column: np.ndarray, width: int) -> Csr:
        """Row i marks one column: tokens over groups."""
        return cls(np.arange(len(column) + 1), column.astype(np.int32), np.ones(len(column), np.int32), width)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(starts, self.rows()[order], self.values[order], len(self))

    def work(self, other: Csr) -> np.ndarray:
        """Products that each row of self · other takes (the entries of the result where no two fall together)."""
        each = np.concatenate([[0], np.cumsum(np.diff(other.starts)[self.columns])])
        return each[self.starts[1:]] - each[self.starts[:-1]]

    def times(self, other: Csr, low: int = 0, high: int | None = None) -> Csr:
        """Rows `low` to `high` of self · other: each entry of a row takes the other's row of its column along."""
        high = len(self) if high is None else high
        p, q = self.starts[low], self.starts[high]
        columns, values = self.columns[p:q], self.values[p:q]
        rows = np.repeat(np.arange(high - low, dtype=np.int32), np.diff(self.starts[low : high + 1]))
        begin = other.starts[columns]
        count = other.starts[columns + 1] - begin
        if len(count) and (count == 1).all():
            at = begin
        else:
            ends = np.cumsum(count)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)
            rows, values = np.repeat(rows, count), np.repeat(values, count)
        found, values = other.columns[at], values * other.values[at]
        key = rows.astype(np.int64) * other.width + found
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(values, first) if len(first) else values
        rows, found = np.divmod(key[first], max(1, other.width))
        starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=high - low))])
        return Csr(starts, found.astype(np.int32), sums, other.width)


class Pair:
    """Two tokenizers: ids of texts, and the bytes of each id. The first one's texts begin with a space."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # every core runs a task already
        self.tok = Tokenizer.from_file(first)
        self.tok.encode_special_tokens = True
        with open(first, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_letters()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        added = {t["content"] for t in spec["added_tokens"]}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(of[c] for c in token)
        if {of[c] for c in vocab if len(c) == 1 and c in of} != set(range(256)):
            raise ValueError(f"{first} cannot spell every byte")  # with all of them, its merges keep the bytes of a text
        self.sp = pieces.load(second)
        self.b_bytes = [self._piece(i) for i in range(self.sp.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(b) for b in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # Digits of every id and the mark behind it: `,` inside a side, `|` after A, `;` after B.
        marks = [f"{i}{m}".encode() for t, end in ((self.a_bytes, "|"), (self.b_bytes, ";")) for m in ("," + end) for i in range(len(t))]
        self.mark_size = np.array([len(m) for m in marks], np.int64)
        self.mark = np.frombuffer(b"".join(m.ljust(int(self.mark_size.max()), b"\0") for m in marks), np.uint8).reshape(len(marks), -1)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.changed: set[str] = set()  # pre-tokens and words whose ids stand for other bytes

    def _piece(self, i: int) -> bytes:
        piece = self.sp.id_to_piece(i)
        if self.sp.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(pieces.MARK, " ").encode()

    def _look_up(self, known: dict[str, bytes], cut: list[list[str]], encode, table: list[bytes], raw) -> list[np.ndarray]:
        """Ids of texts from their parts; parts that are not known are encoded, and their bytes compared with a table, once."""
        distinct = set(chain.from_iterable(cut))
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > KEEP:
            known.clear()
            new = list(distinct)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for w, ids in zip(part, encode(part), strict=True):
                known[w] = array("i", ids).tobytes()
                if table is not None and b"".join([table[i] for i in ids]) != raw(w):
                    self.changed.add(w)
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in cut]
        for w in new:
            if len(w) > SHORT:
                del known[w]
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids on both sides; none for a null or empty text and for one whose bytes a side does not keep."""
        none = np.zeros(0, np.int32)
        full = [t or "" for t in texts]
        self.changed = set()
        first = [PATTERN.findall(" " + t) if t else [] for t in full]
        a = self._look_up(self.known, first, lambda part: (e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)), None, None)
        marked = [self.sp.normalize(t) if t else "" for t in full]
        second = [pieces.MARKED.findall(m) for m in marked]
        b = self._look_up(self.words, second, lambda part: pieces.segment(self.sp, part), self.b_bytes, lambda w: w.replace(pieces.MARK, " ").encode())
        if self.changed:  # not from the tables, lest a word met before hides it
            for w in self.changed:
                self.known.pop(w, None)
                self.words.pop(w, None)
        for i, t in enumerate(full):
            if not t:
                a[i] = b[i] = none
            elif "".join(first[i]) != " " + t or marked[i].replace(pieces.MARK, " ") != " " + t or (self.changed and not self.changed.isdisjoint([*first[i], *second[i]])):
                raw = b" " + t.encode()
                if any(b"".join(map(table.__getitem__, ids.tolist())) != raw for table, ids in ((self.a_bytes, a[i]), (self.b_bytes, b[i]))):
                    a[i] = b[i] = none
        return a, b

    def forget(self) -> None:
        self.known.clear()
        self.words.clear()


@functools.lru_cache(maxsize=2)
def load(first: str, second: str) -> Pair:
    return Pair(first, second)


class Aligned:
    """The tokens of some texts, their overlap links and groups."""

    def __init__(self, pair: Pair, a: list[np.ndarray], b: list[np.ndarray]):
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
        self.pair, self.a, self.b, n = pair, join(a), join(b), len(a)
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
        self.doc_a, self.doc_b = (np.repeat(np.arange(n), k) for k in (self.n_a, self.n_b))
        over_a, over_b = Csr.runs(pair.a_size[self.a]), Csr.runs(pair.b_size[self.b])
        self.links = over_a.times(over_b.transposed())
        end = np.zeros(over_a.width + 1, np.int8)
        end[over_a.starts[1:]] += 1
        end[over_b.starts[1:]] += 2
        group = np.cumsum(end == 3)
        self.group_a, self.group_b = (np.asarray(group[o.starts[:-1]], np.int64) for o in (over_a, over_b))
        self.groups = int(group[-1]) if over_a.width else 0
        self.doc_group = np.zeros(self.groups, np.int64)
        self.doc_group[self.group_a] = self.doc_a
        self.n_groups = np.bincount(self.doc_group, minlength=n)
        self.link_a = self.links.rows()
        self.n_links = np.bincount(self.doc_a[self.link_a], minlength=n)

    def group_links(self, entries: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (of A, of B) of all pairs of tokens that share a group, some rows of the product at a time."""
        a, b = Csr.places(self.group_a, self.groups), Csr.places(self.group_b, self.groups).transposed()
        upto = np.cumsum(a.work(b))
        low = 0
        while low < len(a):
            most = (upto[low - 1] if low else 0) + entries
            high = max(low + 1, int(np.searchsorted(upto, most, "right")))
            part = a.times(b, low, high)
            yield part.rows() + low, part.columns
            low = high

    def n_group_links(self) -> np.ndarray:
        """Pairs of tokens that share a group, per text, from the size of the product alone."""
        a, b = Csr.places(self.group_a, self.groups), Csr.places(self.group_b, self.groups).transposed()
        return np.bincount(self.doc_a, weights=a.work(b), minlength=len(self.n_a)).astype(np.int64)

    def group_texts(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` per text: the ids of each group."""
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (self.group_a, self.group_b))
        order = np.argsort(np.concatenate([2 * self.group_a, 2 * self.group_b + 1]), kind="stable")
        wide_a, wide_b = len(self.pair.a_bytes), len(self.pair.b_bytes)
        mark = np.concatenate([self.a + wide_a * last_a, 2 * wide_a + self.b + wide_b * last_b])[order]
        size = self.pair.mark_size[mark]
        digits = self.pair.mark[mark]
        flat = digits[np.arange(digits.shape[1]) < size[:, None]].tobytes().decode()
        upto = np.append(0, np.cumsum(size))
        ends = upto[np.cumsum(self.n_a + self.n_b)].tolist()
        return [flat[p : max(p, q - 1)] for p, q in zip([0, *ends[:-1]], ends, strict=True)]


def _blocks(pair: Pair, column: pa.Array, limit: int = BLOCK) -> Iterator[Aligned]:
    """The texts of a column in runs of about `limit` bytes."""
    a, b = pair.encode(column.to_pylist())
    low = 0
    for part in slices(pa.RecordBatch.from_arrays([column], names=["t"]), "t", limit):
        yield Aligned(pair, a[low : low + part.num_rows], b[low : low + part.num_rows])
        low += part.num_rows


def _align(batches: Iterable[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    pair = load(first, second)
    for whole in batches:
        for batch in slices(whole, "_text", BLOCK):
            x = Aligned(pair, *pair.encode(batch.column("_text").to_pylist()))
            a0, b0 = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b
            doc = x.doc_a[x.link_a]
            link = pa.StructArray.from_arrays([pa.array((x.link_a - a0[doc]).astype(np.int32)), pa.array((x.links.columns - b0[doc]).astype(np.int32)), pa.array(x.links.values.astype(np.int32))], names=["a", "b", "bytes"])
            g0 = np.cumsum(x.n_groups) - x.n_groups
            made = {
                "ids_a": lists(x.a, x.n_a),
                "ids_b": lists(x.b, x.n_b),
                "links": lists(link, x.n_links),
                "group_of_a": lists((x.group_a - g0[x.doc_a]).astype(np.int32), x.n_a),
                "group_of_b": lists((x.group_b - g0[x.doc_b]).astype(np.int32), x.n_b),
                "n_group_links": pa.array(x.n_group_links()),
            }
            rest = {f: c for f, c in zip(batch.schema.names, batch.columns, strict=True) if f != "_text"} | made
            yield pa.RecordBatch.from_arrays(list(rest.values()), names=list(rest))
    pair.forget()
    release()


MADE = "ids_a array<int>, ids_b array<int>, links array<struct<a: int, b: int, bytes: int>>, group_of_a array<int>, group_of_b array<int>, n_group_links long"


def align(docs: DataFrame, first: str, second: str, text: str = "text") -> DataFrame:
    """Adds the ids of both tokenizers, the links (positions and shared bytes) and the group of every token.

    The first file is a byte-level BPE and reads the text with a space before it, the second a SentencePiece model that
    adds this space itself. `n_group_links` counts the pairs of tokens in one group. Null and empty texts, and texts
    whose bytes one side changes, have no tokens. Input columns with the new names are replaced.
    """
    names = [f.split()[0] for f in ("ids_a", "ids_b", "links", "group_of_a", "group_of_b", "n_group_links", "_text")]
    kept = without(docs, names)
    rows = docs.select(*[col(c) for c in kept.columns], col(text).cast("string").alias("_text"))
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return rows.mapInArrow(lambda b: _align(b, first, second), ", ".join([*fields, MADE]))


SLICED = "slice long, k long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>, a array<int>, b array<int>, n array<int>"


def _sliced(batches: Iterable[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    """Per text its counts, its groups and how often it has each id pair of its slice; the slice's pairs and their
    number in the slice lie in its first row."""
    pair = load(first, second)
    number = TaskContext.get().partitionId() << 32
    width = len(pair.b_bytes)
    for whole in batches:
        for batch in slices(whole, "t", SLICE):
            done, keys, docs, seen = [], [], [], 0
            for x in _blocks(pair, batch.column("t")):
                key = x.a[x.link_a].astype(np.int64) * width + x.b[x.links.columns]
                # one entry per text and pair: both numbers in one, sorted
                both = np.sort((x.doc_a[x.link_a] << PAIR_BITS) | key)
                new = np.flatnonzero(np.diff(both, prepend=-1))
                keys.append(both[new] & ((1 << PAIR_BITS) - 1))
                docs.append(((both[new] >> PAIR_BITS) + seen, np.diff(np.append(new, len(both)))))
                done.append((x.n_a, x.n_b, x.n_groups, x.n_links, x.group_texts()))
                seen += len(x.n_a)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            doc, times = (np.concatenate([d[i] for d in docs]) if docs else np.zeros(0, np.int64) for i in (0, 1))
            distinct, at = np.unique(flat, return_inverse=True)
            total = np.bincount(at, weights=times, minlength=len(distinct)).astype(np.int32)
            sizes = np.bincount(doc, minlength=seen)
            once = np.zeros(seen, np.int64)
            once[:1] = len(distinct)
            numbers = [pa.array(np.concatenate([d[i] for d in done])) for i in range(4)]
            groups = pa.array(list(chain.from_iterable(d[4] for d in done)), pa.string())
            cols = [pa.array(np.full(seen, number)), batch.column("k"), *numbers, groups, lists(at.astype(np.int32), sizes), lists(times.astype(np.int32), sizes)]
            cols += [lists(v.astype(np.int32), once) for v in (distinct // width, distinct % width, total)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SLICED.split(", ")])
            number += 1
    pair.forget()
    release()


def _weigh(table: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each text of a slice: links that are their B id's best, and counts."""
    n = counts.num_rows
    count, best = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    at = counts.column("at").to_numpy()
    count[at], best[at] = counts.column("count").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    pairs, times = (table.column(c).combine_chunks() for c in ("pairs", "times"))
    ends = np.cumsum(pairs.value_lengths().to_numpy())
    pairs, times = (x.flatten().to_numpy().astype(np.int64) for x in (pairs, times))
    out = {}
    for name, worth in (("n_best", best), ("count_sum", count)):
        run = np.concatenate([[0], np.cumsum(worth[pairs] * times)])
        out[name] = np.diff(run[np.concatenate([[0], ends])])
    kept = table.select(["k", "n_a", "n_b", "n_groups", "n_links", "groups"])
    return pa.table([*kept.columns, pa.array(out["n_best"]), pa.array(out["count_sum"])], names=[*kept.column_names, "n_best", "count_sum"])


def link_counts(sliced: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links of the corpus hold each pair of ids, and whether no pair of b has more."""
    rows = sliced.where(F.size("a") > 0).select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    pairs = materialize(rows.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    top = pairs.groupBy("b").agg(F.max("count").alias("top"))
    return pairs.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def corpus_links(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of every text, against the links of all texts.

    `groups` is `a1,a2|b1;a3|b2,b3` (ids of each group; empty without tokens), with `digest` its SHA-256 (empty stays
    empty). `count_sum` adds up, over the links of a text, how many links of the corpus hold the same two ids;
    `n_best` counts the links whose number is the highest of their second id, ties included.
    """
    rows = docs.select(col(key).cast("long").alias("k"), col(text).cast("string").alias("t"))
    made = rows.mapInArrow(lambda b: _sliced(b, first, second), SLICED)
    if digest:
        made = made.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    sliced = materialize(made, "links")
    counts = materialize(link_counts(sliced), "counts")
    asked = sliced.where(F.size("a") > 0).select("slice", F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("slice", "at", "p.*")
    answers = asked.join(counts, ["a", "b"]).select(F.col("slice").alias("part"), "at", "count", "best")
    texts = sliced.drop("a", "b", "n")
    out = texts.groupBy("slice").cogroup(answers.groupBy("part")).applyInArrow(_weigh, "k long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    return out.withColumnRenamed("k", key)
