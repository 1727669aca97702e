"""The prefix trie against a plain one, with segments, shards and blocks of a few rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quern.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, rebuilt):
    """Nodes of the trie: (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends)."""
    logs = defaultdict(list)
    for c, turn, role, text in rows:
        logs[c].append((turn is not None, turn or 0, role or "", text or ""))
    logs = {c: [x[2:] for x in sorted(v)] for c, v in logs.items()}
    full = {}
    for c, own in logs.items():
        h = zlib.crc32(str(c).encode()) % 6 if c is not None else 0
        base = c - int(np.fmod(c, 100)) if c is not None else None
        full[c] = logs.get(base, [])[:h] + own[h:] if rebuilt and c is not None else own
    key = lambda c: (c is None, c or 0)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(full.items(), key=lambda x: key(x[0])):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        text = ",".join("" if c is None else str(c) for c in ends.get(path, []))
        kids = sum(len(p) == len(path) + 1 for p in below)
        out.append((convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), kids, len(leaves), saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rnd = random.Random(4)
    turn = lambda: (rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bé", "", None, "漢字 lang"]))
    starts = [[turn() for _ in range(rnd.randint(1, 9))] for _ in range(4)]
    out = []
    for c in [*range(0, 14), *range(100, 110), 205, 310, -7, 400]:
        said = rnd.choice(starts)[: rnd.randint(1, 9)] + [turn() for _ in range(rnd.randint(0, 3))]
        out += [(c, None if rnd.random() < 0.05 and not i else i, r, t) for i, (r, t) in enumerate(said)]
    out += [(None, 0, "user", "a"), (None, 1, None, None), (500, 1, "user", "same"), (500, 1, "user", "same")]
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_trie_against_a_plain_one(spark):
    data = rows()
    table = spark.createDataFrame(data, SCHEMA).withColumns({n: F.lit("mine") for n in ("depth", "d1", "conv", "k")})
    assert got(trie.trie(table, rebuilt=True)) == plain(data, True)
    small = dict(segment=2, shard_rows=6, block_rows=11)
    assert got(trie.trie(table, rebuilt=True, **small)) == plain(data, True)
    assert got(trie.trie(table, **small)) == plain(data, False)


def test_turnless_and_empty(spark):
    lone = spark.createDataFrame([(c, 0, "user", "x") for c in range(1, 7)], SCHEMA)
    assert got(trie.trie(lone, rebuilt=True)) == plain([tuple(r) for r in lone.collect()], True)
    assert trie.trie(lone.limit(0), rebuilt=True).count() == 0


def test_very_long_conversation(spark):
    long = spark.range(30_000).select(F.lit(3).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    copy = long.withColumn("conv_id", F.lit(9).cast("long")).where("turn < 20000")
    out = trie.trie(long.unionAll(copy), segment=1000, shard_rows=5000, block_rows=7000)
    r = out.where("depth = 0").first()
    assert (r.n_convs, r.n_leaves, r.saved_tokens) == (2, 1, sum(len(f"t{i}") for i in range(20_000)))
    assert out.count() == 30_001


def test_perfect_hash():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, (2, 5000), np.uint64)
    keys[0, :100] = keys[0, 0]  # equal in one half
    table = trie.PerfectHash(*keys)
    assert sorted(table.slots(*keys).tolist()) == list(range(5000))
    other = rng.integers(0, 1 << 63, (2, 1000), np.uint64)
    assert (table.slots(*other) == -1).all()
    assert trie.PerfectHash(*keys[:, :0]).slots(*other[:, :3]).tolist() == [-1] * 3
