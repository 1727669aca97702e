"""Prefix trie of conversations as a node table behind minimal perfect hashes.

Every prefix of a conversation has a 128-bit digest. Conversations are dealt to shards; each shard numbers its distinct
digests by a minimal perfect hash (slots hold the digest, so a lookup is verified) and scatters counts into flat arrays.
The shards' tables are summed by digest. For sums over subtrees each node's amount belongs to its smallest member, whose
shard adds it up through an array of parent slots, deepest first; sums of the shards are then added by digest. A hot
prefix is thus one row per shard, and a very long conversation is cut into segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.core import col, materialize, one_row
from quern.operators import ordered

NO_KEY = (1 << 63) - 1  # stands for a null id, after all others
SEGMENT = 1 << 16  # turns of one conversation in one shard
SHARD_ROWS = 250_000  # prefixes in a shard, about
PACK = 1 << 16  # ids in one piece of a member list


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct pairs of 64-bit numbers, by levels of bits that one key alone has hit.

    Key i of n gets a slot of 0..n-1 of its own; `slots` gives -1 for pairs that are no keys, as each slot holds its key.
    """

    SPACE = 1.6  # places per key in a level

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.levels: list[np.ndarray] = []
        left, used = np.arange(len(first)), 0
        while len(left):
            places = max(8, int(self.SPACE * len(left)))
            at = self._place(first[left], second[left], len(self.levels), places)
            alone = np.bincount(at, minlength=places) == 1
            rank = np.where(alone, used + np.cumsum(alone) - 1, -1)
            self.levels.append(rank)
            used += int(alone.sum())
            left = left[~alone[at]]
        self.keys = np.zeros((2, len(first)), np.uint64)
        at = self._lookup(first, second)
        self.keys[0, at], self.keys[1, at] = first, second

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray, level: int, places: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (_mix(first ^ _mix(second + salt)) % np.uint64(places)).astype(np.int64)

    def _lookup(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(first), -1, np.int64), np.arange(len(first))
        for level, rank in enumerate(self.levels):
            found = rank[self._place(first[open_], second[open_], level, len(rank))]
            out[open_] = found
            open_ = open_[found < 0]
        return out

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = self._lookup(first, second)
        hit = at >= 0
        hit[hit] = (self.keys[0, at[hit]] == first[hit]) & (self.keys[1, at[hit]] == second[hit])
        return np.where(hit, at, -1)


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in names]


def _digests(table: pa.Table, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(x.astype(np.int64).view(np.uint64) for x in _numbers(table, a, b))


def _distinct(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One row of each distinct pair."""
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    return order[new]


LOCAL = "shard long, d1 long, d2 long, p1 long, p2 long, depth long, chars long, n_convs long, conv long"


def _local_nodes(table: pa.Table) -> pa.Table:
    """The distinct prefixes of a shard with their members' number and smallest id."""
    first, second = _digests(table, "d1", "d2")
    conv, depth, chars, p1, p2 = _numbers(table, "conv", "depth", "chars", "p1", "p2")
    one = _distinct(first, second)
    nodes = PerfectHash(first[one], second[one])
    at = nodes.slots(first, second)
    members = np.bincount(at, minlength=len(one))
    least = np.full(len(one), NO_KEY, np.int64)
    np.minimum.at(least, at, conv)
    flat = {}
    for name, values in (("p1", p1), ("p2", p2), ("depth", depth), ("chars", chars)):
        flat[name] = np.zeros(len(one), np.int64)
        flat[name][at] = values
    cols = [np.full(len(one), table.column("shard")[0].as_py()), *nodes.keys.view(np.int64), *flat.values(), members, least]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in LOCAL.split(", ")])


def _subtree_sums(table: pa.Table, segment: int) -> pa.Table:
    """Sums over the subtree of each node of a shard, of the amounts that the shard owns. They end at the first node of
    a segment: what lies above gets them as a carry."""
    first, second = _digests(table, "d1", "d2")
    nodes = PerfectHash(first, second)
    at = nodes.slots(first, second)
    up = nodes.slots(*_digests(table, "p1", "p2"))
    depth, saved, leaves = _numbers(table, "depth", "saved", "leaves")
    up[(depth == 0) | ((depth > 1) & ((depth - 1) % segment == 0))] = -1
    sums = np.zeros((2, len(at)), np.int64)
    sums[0, at], sums[1, at] = saved, leaves
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order], prepend=-1, append=-1))
    for p, q in zip(cuts[:-1], cuts[1:], strict=True):
        level = order[p:q]
        level = level[up[level] >= 0]
        for s in sums:
            np.add.at(s, up[level], s[at[level]])
    cols = [*nodes.keys.view(np.int64), *sums]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["d1", "d2", "saved", "leaves"])


def _packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of members of one node, in order, as comma-joined text: a batch's rows of the node, PACK at most."""
    names = ["d1", "d2", "first", "ids"]
    for batch in batches:
        d1, d2, conv = (batch.column(c).to_numpy() for c in ("d1", "d2", "conv"))
        change = np.ones(len(conv), bool)
        change[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        cuts = np.unique(np.concatenate([np.flatnonzero(change), np.arange(0, len(conv), PACK), [len(conv)]]))
        text = ["" if c == NO_KEY else str(c) for c in conv.tolist()]
        ids = [",".join(text[p:q]) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
        at = cuts[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(d1[at]), pa.array(d2[at]), pa.array(conv[at]), pa.array(ids, pa.string())], names=names)


def _hash_packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the packs of each node joined in order; the state lives on from batch to batch."""
    now, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        cols = [pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        done.clear()
        return pa.RecordBatch.from_arrays(cols, names=["d1", "d2", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids")), strict=True):
            if (a, b) != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(done) >= 10_000:
            yield flush()
    if now is not None:
        done.append((*now, state.hexdigest()))
    if done:
        yield flush()


def place_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int | None = None) -> DataFrame:
    """(conv, k, h1, h2, chars): place, two hashes of role and text, and code points of the text of every turn, stored.

    Turns are ordered by number (null first), then role and a hash of the text; a null role or text is empty.
    """
    said, who = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (text, role))
    rows = turns.select(F.coalesce(col(conv).cast("long"), F.lit(NO_KEY)).alias("conv"), col(turn).cast("long").alias("turn"), who.alias("role"), said.alias("text"))
    rows = rows.select("conv", "turn", "role", F.length("text").cast("long").alias("chars"), *[F.xxhash64(F.lit(s), "role", "text").alias(f"h{s}") for s in (1, 2)])
    placed = ordered.position(materialize(rows, "turns"), ["conv"], ["turn", "role", "h1", "h2"], out="k", block_rows=block_rows)
    return materialize(placed.select("conv", "k", "h1", "h2", "chars"), "turns")


def rebuild(placed: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv, n_turns) and their turns (conv, k, h1, h2, chars).

    With h = crc32(decimal id) % `most`, the first h turns come from the first conversation of the id's group of
    `group` (fewer if it has fewer, none if it is absent), then the conversation's own turns after its first h. A null
    id keeps its own turns.
    """
    known = F.col("conv") != NO_KEY
    sizes = placed.groupBy("conv").agg(F.max("k").alias("own"))
    base = F.when(known, F.col("conv") - F.col("conv") % group)
    taken = F.when(known, F.crc32(F.col("conv").cast("string").cast("binary")) % most).otherwise(F.lit(0)).cast("long")
    convs = sizes.select("conv", "own", base.alias("base"), taken.alias("h"))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("lent")), "base", "left")
    convs = convs.withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0).cast("long"))))
    convs = materialize(convs.withColumn("n_turns", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "convs")
    heads = placed.where(F.col("k") < most).withColumnRenamed("conv", "base")
    first = convs.where("lent > 0").select("conv", "base", "lent").join(heads, "base").where("k <= lent").select("conv", "k", "h1", "h2", "chars")
    own = placed.join(convs.select("conv", "h", "lent"), "conv").where("k > h").withColumn("k", F.col("k") - F.col("h") + F.col("lent"))
    return convs.select("conv", "n_turns"), first.unionAll(own.select(*first.columns))


def prefixes(convs: DataFrame, turns: DataFrame, segment: int = SEGMENT, block_rows: int | None = None) -> DataFrame:
    """(conv, seg, depth, d1, d2, p1, p2, chars, last): every prefix of every conversation, its digest and its parent's.

    Digests come from running sums of hashes of the turns with their places; the empty prefix has digest (0, 0).
    """
    place = {f"s{s}": F.xxhash64(f"h{s}", "k").cast("decimal(20,0)") for s in (1, 2)}
    runs = ordered.running_sum(materialize(turns.select("*", *[e.alias(n) for n, e in place.items()]), "turns"), ["conv"], ["k"], {"r1": F.col("s1"), "r2": F.col("s2")}, block_rows=block_rows)

    def digest(a: Column, b: Column, depth: Column) -> list[Column]:
        return [F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(s), *v)) for s, v in ((1, (a, b, depth)), (2, (b, a, depth)))]

    long_sum = lambda c: c.cast("decimal(38,0)")
    here = digest(long_sum(F.col("r1")), long_sum(F.col("r2")), F.col("k"))
    above = digest(long_sum(F.col("r1") - F.col("s1")), long_sum(F.col("r2") - F.col("s2")), F.col("k") - 1)
    ends = runs.join(convs, "conv")
    seg = F.floor((F.col("k") - 1) / segment).cast("long")
    deep = ends.select("conv", seg.alias("seg"), F.col("k").alias("depth"), here[0].alias("d1"), here[1].alias("d2"), above[0].alias("p1"), above[1].alias("p2"), "chars", (F.col("k") == F.col("n_turns")).alias("last"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("seg", "depth", "d1", "d2", "p1", "p2", "chars")]
    return deep.unionAll(convs.select("conv", *zero, (F.col("n_turns") == 0).alias("last")))


def _in_shard(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("conv", "seg"), F.lit(shards)).cast("long"))


def _carries(found: DataFrame, nodes: DataFrame, segment: int, shards: int) -> DataFrame:
    """(shard, d1, d2, more_saved, more_leaves): what a cut conversation owns in its later segments, at each cut."""
    part = F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / segment).cast("long").alias("seg")
    owned = nodes.groupBy("conv", part).agg(F.sum("amount").alias("saved"), F.sum("leaf").alias("leaves"))
    cut = found.where((F.col("depth") > 0) & (F.col("depth") % segment == 0) & ~F.col("last"))
    later = cut.select("conv", F.col("seg").alias("at"), "d1", "d2").join(owned, "conv").where(F.col("seg") > F.col("at"))
    per = later.groupBy("conv", "at", "d1", "d2").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    placed = _in_shard(per.withColumnRenamed("at", "seg"), shards)
    return placed.groupBy("shard", "d1", "d2").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))


def build(convs: DataFrame, turns: DataFrame, segment: int = SEGMENT, shard_rows: int = SHARD_ROWS, block_rows: int | None = None) -> DataFrame:
    """One row per node: conv_id (smallest member; null only if all are), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    `convs` has conv and n_turns, `turns` the turns of the conversations as `place_turns` gives them. Conversations
    without turns are members of the root alone; without conversations there is no root. A null id (NO_KEY) comes last
    and is an empty text in `ends_sha256`.
    """
    spark = convs.sparkSession
    found = materialize(prefixes(convs, turns, segment, block_rows), "prefixes")
    size = one_row(found, F.count("*").alias("n"), F.max("depth").alias("deep"))
    shards = max(1, -(-size["n"] // shard_rows), min(spark.sparkContext.defaultParallelism, size["n"] // 10_000))
    local = materialize(_in_shard(found, shards).groupBy("shard").applyInArrow(_local_nodes, LOCAL), "local")
    same = [F.min(c).alias(c) for c in ("depth", "chars", "p1", "p2")]
    clash = F.max("depth") + F.max("chars") > F.min("depth") + F.min("chars")
    merged = local.groupBy("d1", "d2").agg(F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv"), *same, clash.alias("clash"))
    merged = merged.withColumn("depth", F.when(F.col("clash"), F.raise_error(F.lit("two prefixes share a digest")).cast("long")).otherwise(F.col("depth"))).drop("clash")
    merged = materialize(merged, "nodes")
    children = merged.where("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    nodes = merged.join(children, ["d1", "d2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("amount", (F.col("n_convs") - 1) * F.col("chars")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = materialize(nodes, "nodes")
    facts = nodes.select("d1", "d2", F.col("conv").alias("owner"), "amount", "leaf")
    mine = lambda c: F.when(F.col("conv") == F.col("owner"), F.col(c)).otherwise(F.lit(0)).cast("long")
    rows = local.join(facts, ["d1", "d2"]).select("shard", "d1", "d2", "p1", "p2", "depth", mine("amount").alias("saved"), mine("leaf").alias("leaves"))
    if (size["deep"] or 0) > segment:
        more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).cast("long").alias(c)
        rows = rows.join(_carries(found, nodes, segment, shards), ["shard", "d1", "d2"], "left").select("shard", "d1", "d2", "p1", "p2", "depth", more("saved"), more("leaves"))
    parts = rows.groupBy("shard").applyInArrow(lambda t: _subtree_sums(t, segment), "d1 long, d2 long, saved long, leaves long")
    sums = parts.groupBy("d1", "d2").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    parent = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("parent"))
    out = nodes.join(sums, ["d1", "d2"]).join(parent, ["p1", "p2"], "left")
    out = out.join(member_hashes(found), ["d1", "d2"], "left")
    known = lambda c: F.when(F.col(c) != NO_KEY, F.col(c))
    return out.select(
        known("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, known("parent")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def member_hashes(found: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of the conversations that end at each node.

    Members are sorted over all tasks and joined to pieces there; a node's pieces then pass one task as a stream, as
    the hash of a text must.
    """
    ends = found.where("last").select("d1", "d2", "conv")
    order = ["d1", "d2", "conv"]
    packs = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packs, "d1 long, d2 long, first long, ids string")
    dealt = packs.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first")
    return dealt.mapInArrow(_hash_packs, "d1 long, d2 long, ends_sha256 string")


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuilt: bool = False, segment: int = SEGMENT, shard_rows: int = SHARD_ROWS, block_rows: int | None = None) -> DataFrame:
    """Nodes of the prefix trie of a table of turns (see `build`), with `rebuilt` of its rebuilt conversations.

    Only the four named columns are read. Rows of a null id are one conversation. Repeated rows are repeated turns.
    """
    placed = place_turns(conversations, conv, turn, role, text, block_rows)
    if rebuilt:
        convs, turns = rebuild(placed)
    else:
        convs, turns = materialize(placed.groupBy("conv").agg(F.max("k").alias("n_turns")), "convs"), placed
    return build(convs, turns, segment, shard_rows, block_rows)
