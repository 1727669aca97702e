"""Exact byte-level BPE token counts at every prefix of a text, by dynamic programming.

Within a pre-token, the tokens of a prefix are the tokens of a shorter prefix plus one last token, and the two
fit if the encoder would leave that pair of neighbours alone. So one pass over a pre-token finds the last token
and the count at each of its prefixes. Counts of a text add up over its pre-tokens; the ends that a cut changes
(a run of white space, a cut contraction) are counted as the encoder would count the cut text.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.core import col
from quern.llm.batches import lists, slices, without

CHUNK = 4 << 20
KEEP = 1_000_000  # pre-tokens, and stretches, remembered in a worker; only speed depends on it
SHORT = 64  # longer ones are forgotten after their block of texts

# Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACES = regex.compile(r"\s{2,}")
BLANKS = frozenset(regex.findall(r"\s", "".join(map(chr, range(0xD800)))))
# Blanks and what follows up to the next blank, or up to a mark after letters and digits: no pre-token reaches over
# the end of such a stretch.
STRETCH = re.compile("[{0}]*[^\\W_]++(?![^{0},.;:!?)])|[{0}]*[^{0}]+|[{0}]+".format(re.escape("".join(sorted(BLANKS)))))
CONTRACTION = regex.compile(r"'(?:re|ve|ll)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 as it is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of all prefixes under one tokenizer file.

    Pre-tokens of up to `WIDE` bytes are worked on together, one prefix length a step: tokens are looked up by the
    hash of their bytes (then compared), pairs in a table that holds the last answer of each slot. Longer
    pre-tokens take the same steps one by one.
    """

    WIDE, TOKEN_SLOTS, PAIR_SLOTS = 24, 22, 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_letters()
        raw = lambda token: bytes(of[c] for c in token)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.tokens = sorted({bytes((b,)) for b in of.values()} | {raw(a + b) for a, b in pairs})
        self.number = {t: i for i, t in enumerate(self.tokens)}
        self.longest = max(map(len, self.tokens), default=1)
        # merge that makes each token (its rank, left and right part); single bytes have none
        self.made, self.left, self.right = (np.full(len(self.tokens), -1, np.int64) for _ in range(3))
        for i, (x, y) in enumerate(pairs):
            t = self.number[raw(x + y)]
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = i, self.number[raw(x)], self.number[raw(y)]
        keys = np.array([self.number[raw(x)] * len(self.tokens) + self.number[raw(y)] for x, y in pairs], np.int64)
        self.merge_rank = np.argsort(keys, kind="stable")
        self.merge_keys = keys[self.merge_rank]
        self.rank = {k: i for i, k in enumerate(keys.tolist())}
        self.tree = list(zip(self.made.tolist(), self.left.tolist(), self.right.tolist(), strict=True))
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        self.passing: list[str] = []
        self.apart: dict[int, bool] = {}
        rng = np.random.default_rng(7)
        self.letter = rng.integers(1, 1 << 63, 256, np.uint64)
        odd = int(rng.integers(1, 1 << 62)) * 2 + 1
        self.power = np.array([pow(odd, k, 1 << 64) for k in range(self.WIDE + 1)], np.uint64)
        self.back = np.array([pow(odd, -k, 1 << 64) for k in range(self.WIDE + 1)], np.uint64)
        short = [i for i, t in enumerate(self.tokens) if len(t) <= self.WIDE]
        grid = np.zeros((len(short), self.WIDE), np.uint64)
        for row, i in enumerate(short):
            t = np.frombuffer(self.tokens[i], np.uint8)
            grid[row, : len(t)] = self.letter[t] * self.power[: len(t)]
        self.hash = np.zeros(len(self.tokens) + 1, np.uint64)
        self.hash[short] = grid.sum(1, dtype=np.uint64)
        if len(set(self.hash[short].tolist())) < len(short):
            raise ValueError("two tokens share a hash")
        self.first, self.second = np.full(1 << self.TOKEN_SLOTS, -1, np.int32), np.full(1 << self.TOKEN_SLOTS, -1, np.int32)
        at, other = self.slots(self.hash[short])
        self.first[at] = short
        lost = np.array(short, np.int64)[self.first[at] != short]
        self.second[self.slots(self.hash[lost])[1]] = lost
        missing = lost[self.second[self.slots(self.hash[lost])[1]] != lost]
        if len(missing):
            raise ValueError("token table too small")
        self.pair_key, self.pair_apart = np.full(1 << self.PAIR_SLOTS, -1, np.int64), np.zeros(1 << self.PAIR_SLOTS, bool)

    def slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.uint64(64 - self.TOKEN_SLOTS)
        return (h >> top).astype(np.int64), ((h * np.uint64(0x9E3779B97F4A7C15)) >> top).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Token numbers of byte hashes, -1 where no token has it."""
        at, other = self.slots(h)
        one = self.first[at]
        two = self.second[other]
        return np.where(self.hash[one] == h, one, np.where(self.hash[two] == h, two, -1))

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the encoder, given only these two tokens' bytes, returns just these two tokens.

        Merges happen in the order of their ranks. Undone from the last one on, they show every pair of neighbours
        that ever met at the border; the tokens grow together if such a pair has a merge due before both are used up.
        """
        never = 1 << 60
        left_until = right_until = never
        while True:
            rank = self.rank.get(left * len(self.tokens) + right, never)
            if rank < left_until and rank <= right_until:
                return False
            (left_made, _, left_end), (right_made, right_start, _) = self.tree[left], self.tree[right]
            if left_made < 0 and right_made < 0:
                return True
            if right_made >= left_made:
                right, right_until = right_start, right_made
            else:
                left, left_until = left_end, left_made

    def all_apart(self, key: np.ndarray) -> np.ndarray:
        """`stay_apart` of many pairs, one undone merge of each at a time."""
        width, never = len(self.tokens), 1 << 60
        out = np.ones(len(key), bool)
        at = np.arange(len(key))
        left, right = np.divmod(key, width)
        left_until, right_until = np.full(len(key), never), np.full(len(key), never)
        while len(at):
            now = left * width + right
            i = np.minimum(np.searchsorted(self.merge_keys, now), len(self.merge_keys) - 1)
            rank = np.where(self.merge_keys[i] == now, self.merge_rank[i], never) if len(self.merge_keys) else np.full(len(at), never)
            grown = (rank < left_until) & (rank <= right_until)
            out[at[grown]] = False
            left_made, right_made = self.made[left], self.made[right]
            go = ~grown & ((left_made >= 0) | (right_made >= 0))
            later = right_made >= left_made
            right_until, left_until = np.where(later, right_made, right_until)[go], np.where(later, left_until, left_made)[go]
            left, right = np.where(later, left, self.right[left])[go], np.where(later, self.left[right], right)[go]
            at = at[go]
        return out

    def pair(self, key: int) -> bool:
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) >= 2 * KEEP:
                self.apart.clear()
            found = self.apart[key] = self.stay_apart(*divmod(key, len(self.tokens)))
        return found

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * len(self.tokens) + right
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.PAIR_SLOTS)).astype(np.int64)
        new = np.flatnonzero(self.pair_key[at] != key)
        out = self.pair_apart[at]
        if len(new):
            distinct, back = np.unique(key[new], return_inverse=True)
            out[new] = self.all_apart(distinct)[back]
            self.pair_key[at[new]] = key[new]  # of keys that share a slot numpy keeps the last one in both lines
            self.pair_apart[at[new]] = out[new]
        return out

    def learn(self, pretokens: list[str]) -> None:
        """Find the counts of pre-tokens that are not known."""
        if len(self.known) + len(pretokens) > KEEP:
            self.known.clear()
        short, data = [], []
        for w in pretokens:
            b = w.encode("utf-8", "surrogatepass")
            if len(w) > SHORT:
                self.passing.append(w)
            if len(b) > self.WIDE:
                self.known[w] = self.word(w)
            else:
                short.append(w)
                data.append(b)
        for start in range(0, len(short), 1 << 16):
            self.learn_block(short[start : start + (1 << 16)], data[start : start + (1 << 16)])

    def learn_block(self, pretokens: list[str], data: list[bytes]) -> None:
        order = sorted(range(len(data)), key=lambda i: -len(data[i]))
        pretokens, data = [pretokens[i] for i in order], [data[i] for i in order]
        size = np.fromiter(map(len, data), np.int64, len(data))
        grid = np.frombuffer(b"".join(d.ljust(self.WIDE, b"\0") for d in data), np.uint8).reshape(-1, self.WIDE)
        total = np.zeros((len(data), self.WIDE + 1), np.uint64)
        np.cumsum(self.letter[grid] * self.power[: self.WIDE], axis=1, out=total[:, 1:])
        last = np.full(total.shape, -1, np.int32)
        count = np.zeros(total.shape, np.uint32)
        for k in range(1, self.WIDE + 1):
            rows = np.arange(np.searchsorted(-size, -k, side="right"))
            for j in range(k):  # the longest last token first
                if not len(rows):
                    break
                token = self.find((total[rows, k] - total[rows, j]) * self.back[j])
                hit = np.flatnonzero(token >= 0)
                if j:
                    hit = hit[self.pairs(last[rows[hit], j], token[hit])]
                last[rows[hit], k] = token[hit]
                count[rows[hit], k] = count[rows[hit], j] + 1
                left = np.ones(len(rows), bool)
                left[hit] = False
                rows = rows[left]
        flat, wide = count.tobytes(), 4 * (self.WIDE + 1)
        for i, (w, d) in enumerate(zip(pretokens, data, strict=True)):
            if len(w) == len(d):
                self.known[w] = flat[i * wide + 4 : i * wide + 4 + 4 * len(d)]
            else:
                ends = [e for e in range(1, len(d) + 1) if e == len(d) or d[e] & 0xC0 != 0x80]
                self.known[w] = count[i, ends].tobytes()

    def word(self, pretoken: str) -> bytes:
        """Counts after each code point of one pre-token, as unsigned 32-bit numbers."""
        data = pretoken.encode("utf-8", "surrogatepass")
        n, width = len(data), len(self.tokens)
        last, count = [-1], [0]
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                token = self.number.get(data[j:i])
                if token is not None and (not j or self.pair(last[j] * width + token)):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
        return array("I", [c for i, c in enumerate(count) if i == n or i and data[i] & 0xC0 != 0x80]).tobytes()

    def counts(self, pretoken: str) -> bytes:
        return self.known.get(pretoken) or self.word(pretoken)

    @staticmethod
    def add_up(text: str, cut: list[str], table: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the prefixes of length 0, 1, ... of a text from those of its parts, and the ends of the parts."""
        out = np.zeros(len(text) + 1, np.int64)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        ends = np.cumsum(sizes)
        if cut:
            inner = np.frombuffer(b"".join(map(table.__getitem__, cut)), np.uint32)
            total = inner[ends - 1].astype(np.int64)
            out[1:] = inner + np.repeat(np.cumsum(total) - total, sizes)
        return out, ends

    def learn_stretches(self, stretches: list[str]) -> None:
        """Find the counts of stretches that are not known, all in one pass over them end to end."""
        if len(self.stretches) + len(stretches) > KEEP:
            self.stretches.clear()
        self.passing += [s for s in stretches if len(s) > SHORT]
        words = [s for s in stretches if s.isalpha() or s[0] == " " and s[1:].isalpha()]
        others = list(set(stretches).difference(words))
        cuts = [PATTERN.findall(s) for s in others]
        words += [s for s, parts in zip(others, cuts, strict=True) if len(parts) == 1]
        distinct = set(chain(words, chain.from_iterable(cuts)))
        new = [w for w in distinct if w not in self.known]
        self.learn(list(distinct) if len(self.known) + len(new) > KEEP else new)
        self.stretches.update((s, self.known[s]) for s in words)
        several = [(s, parts) for s, parts in zip(others, cuts, strict=True) if len(parts) > 1 or s[0] == "'"]
        mixed, cut = [s for s, _ in several], [w for _, parts in several for w in parts]
        text = "".join(mixed)
        out, ends = self.add_up(text, cut, self.known)
        for m in SPACES.finditer(text):  # a prefix that ends inside a run has the run so far as one pre-token
            out[m.start() + 1 : m.end() + 1] = out[m.start()] + np.frombuffer(self.counts(m.group()), np.uint32)
        for m in CONTRACTION.finditer(text) if "'" in text else ():
            at = m.start()
            k = int(np.searchsorted(ends, at, side="right"))
            if cut[k] == m.group() and ends[k] - len(cut[k]) == at:
                out[at + 2] = out[at] + 2  # the quote and the letter, not yet a contraction
        sizes = np.fromiter(map(len, mixed), np.int64, len(mixed))
        stops = np.cumsum(sizes)
        flat = (out[1:] - np.repeat(out[stops - sizes], sizes)).astype(np.uint32).tobytes()
        places = zip((4 * (stops - sizes)).tolist(), (4 * stops).tolist(), strict=True)
        self.stretches.update((s, flat[i:j]) for s, (i, j) in zip(mixed, places, strict=True))

    def prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """Counts of the prefixes of length 0, 1, ... of each text; a special string is one token once complete."""
        plans = []
        for text in texts:
            plan, at = [], 0
            for m in self.split.finditer(text) if self.split else ():
                plan.append((text[at : m.end() - 1], m.start() - at))  # before its last character it is ordinary text
                at = m.end()
            plan.append((text[at:], -1))
            plans.append([(t, closes, STRETCH.findall(t)) for t, closes in plan])
        distinct = set(chain.from_iterable(cut for plan in plans for _, _, cut in plan))
        new = [s for s in distinct if s not in self.stretches]
        self.learn_stretches(list(distinct) if len(self.stretches) + len(new) > KEEP else new)
        out = []
        for plan in plans:
            parts, base = [np.zeros(1, np.int64)], 0
            for text, closes, cut in plan:
                counts = self.add_up(text, cut, self.stretches)[0]
                parts.append(base + counts[1:])
                if closes >= 0:
                    base += int(counts[closes]) + 1
                    parts.append(np.array([base]))
            out.append(np.concatenate(parts))
        for s in self.passing:
            self.known.pop(s, None)
            self.stretches.pop(s, None)
        self.passing.clear()
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _schema(kept: DataFrame, new: str) -> str:
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields), new])


def _run(batches: Iterable[pa.RecordBatch], path: str, answer) -> Iterator[pa.RecordBatch]:
    counter = load(path)
    for whole in batches:
        for batch in slices(whole, "_text", CHUNK):
            made = answer(counter.prefixes([t or "" for t in batch.column("_text").to_pylist()]))
            rest = {f: c for f, c in zip(batch.schema.names, batch.columns, strict=True) if f != "_text"} | made
            yield pa.RecordBatch.from_arrays(list(rest.values()), names=list(rest))


def prefix_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds `prefix_tokens`: item i is the exact number of tokens of the first i code points (item 0 is 0).

    Null texts count as empty: `[0]`. Stored once, the table answers every truncation and budget question with
    `tokens_within` and `longest_within`. An input column with the new name is replaced.
    """
    kept = without(docs, ["prefix_tokens", "_text"])
    rows = docs.select(*[col(c) for c in kept.columns], col(text).cast("string").alias("_text"))

    def answer(prefixes):
        sizes = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
        return {"prefix_tokens": lists(np.concatenate(prefixes).astype(np.int32) if prefixes else np.zeros(0, np.int32), sizes)}

    return rows.mapInArrow(lambda batches: _run(batches, path, answer), _schema(kept, "prefix_tokens array<int>"))


def tokens_within(prefix_tokens: Column, chars: Column | int) -> Column:
    """Tokens of the first `chars` code points, or of the whole text if it is shorter."""
    n = F.lit(chars) if isinstance(chars, int) else chars
    return F.get(prefix_tokens, F.least(n, F.size(prefix_tokens) - 1).cast("int"))


def longest_within(prefix_tokens: Column, budget: int) -> Column:
    """Code points of the longest prefix with at most `budget` tokens."""
    at = F.sequence(F.lit(0), F.size(prefix_tokens) - 1)
    return F.array_max(F.filter(at, lambda i: F.get(prefix_tokens, i) <= budget))


def count_tokens(docs: DataFrame, path: str, text: str = "text", budget: int = 512) -> DataFrame:
    """Adds `n_tokens` of every whole text and `fit_chars`, the longest prefix within the budget in code points.

    Both are read off the prefix counts inside the task, which holds those of one block of texts. Null texts have
    0 tokens. Counts equal the library's, special strings included. Input columns with the new names are replaced.
    """
    kept = without(docs, ["n_tokens", "fit_chars", "_text"])
    rows = docs.select(*[col(c) for c in kept.columns], col(text).cast("string").alias("_text"))

    def answer(prefixes):
        total = [int(p[-1]) for p in prefixes]
        fit = [len(p) - 1 if p[-1] <= budget else int(np.flatnonzero(p <= budget)[-1]) for p in prefixes]
        return {"n_tokens": pa.array(total, pa.int64()), "fit_chars": pa.array(fit, pa.int64())}

    return rows.mapInArrow(lambda batches: _run(batches, path, answer), _schema(kept, "n_tokens long, fit_chars long"))
