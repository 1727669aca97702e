"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt to tiles by the population counts of their sections. Two tiles are compared only if
those counts allow a pair within the radius; a pair of tiles is compared by exclusive-or and bit counts, and sends
on a spanning forest of its links, not all of them. Components follow by alternating star steps on the links.

With a `similarity` the bits only name candidates: nodes are distinct sets of shingles, each pair of tiles names its
rows with a candidate, and their sets are read for an exact test of every candidate before the forest is made. Tiles
are then made by the number of shingles, as sets that similar are of about the same size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.core import col, materialize
from quern.llm.batches import lists, release, slices

CHUNK = 4 << 20
SEED = 42
ROWS = 1 << 16  # shingles whose bits are unpacked at once
STEPS = 4  # tiles between two set sizes that the similarity still allows
TILE_BYTES = 32 << 20  # of the shingles in a tile
TESTED = 16  # candidates tested before those connected meanwhile are left out


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every shingle of `size` words, A-Z lower-cased; fewer words are one shingle, none give nothing."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    k = min(size, n)
    hash_of = xxhash.xxh64_intdigest
    cut = zip(starts[: n - k + 1].tolist(), stops[k - 1 :].tolist(), strict=True)
    return np.fromiter((hash_of(joined[a:b], SEED) for a, b in cut), np.uint64, n - k + 1)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """The hash itself for lane 0, else another well mixed number made from it."""
    if lane == 0:
        return h
    x = h + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """One 64-bit number per lane: a bit is 1 if set in over half the hashes."""
    out = np.zeros(lanes, np.uint64)
    if not len(hashes):
        return out
    for lane in range(lanes):
        count = np.zeros(64, np.int64)
        for at in range(0, len(hashes), ROWS):
            raw = _mixed(hashes[at : at + ROWS], lane).astype("<u8").view(np.uint8).reshape(-1, 8)
            count += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.uint32)
        out[lane] = np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _sketch(batches: Iterable[pa.RecordBatch], size: int, lanes: int, sets: bool = False) -> Iterator[pa.RecordBatch]:
    """Fingerprints of all shingles; with `sets` of the distinct ones, and a hash of the set."""
    for whole in batches:
        for batch in slices(whole, "t", CHUNK):
            hashes = [shingle_hashes(t or "", size) for t in batch.column("t").to_pylist()]
            hashes = [np.unique(h) for h in hashes] if sets else hashes
            made = [fingerprint(h, lanes) for h in hashes]
            flat = np.concatenate(made).view(np.int64) if made else np.zeros(0, np.int64)
            out = [batch.column("k"), batch.column("th"), lists(flat, np.full(len(made), lanes))]
            if sets:
                out.append(pa.array(np.fromiter((xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in hashes), np.uint64, len(hashes)).view(np.int64)))
                out.append(pa.array(np.fromiter(map(len, hashes), np.int64, len(hashes))))
            yield pa.RecordBatch.from_arrays(out, names=["k", "th", "lanes", "sh", "n"][: len(out)])
    release()


def _sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text, as bytes."""
    for whole in batches:
        for batch in slices(whole, "t", CHUNK):
            made = [np.unique(shingle_hashes(t or "", size)).tobytes() for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lanes"), pa.array(made, pa.binary())], names=["id", "lanes", "shingles"])


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, lanes: int = 1, sets: bool = False) -> DataFrame:
    """(k, th, lanes): key, hash of the text and fingerprint of every whole text; null texts count as empty (zero).

    With `sets` a repeated shingle counts once, `sh` is a hash of the set of shingles and `n` its size.
    """
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(col(key).cast("long").alias("k"), F.xxhash64(body).alias("th"), body.alias("t"))
    return rows.mapInArrow(lambda b: _sketch(b, shingle, lanes, sets), "k long, th long, lanes array<long>" + ", sh long, n long" * sets)


def _section_counts(lane: Column, sections: int, width: int) -> Column:
    """Population counts of the sections in steps of `width`, as one number in base 256."""
    bits = 64 // sections
    mask = (1 << bits) - 1
    total = F.lit(0).cast("long")
    for s in range(sections):
        part = F.shiftrightunsigned(lane, s * bits).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long"))
        total = total + F.floor(F.bit_count(part) / width).cast("long") * (256**s)
    return total


def neighbour_steps(sections: int, width: int, radius: int) -> list[int]:
    """Differences of tile numbers that a pair within the radius can have, one of each two opposite ones."""
    reach = [d for d in range(-radius - 1, radius + 2) if max(0, (abs(d) - 1) * width + 1) * (d != 0) <= radius]
    cost = lambda d: 0 if d == 0 else (abs(d) - 1) * width + 1
    steps = [sum(d * 256**s for s, d in enumerate(v)) for v in product(reach, repeat=sections) if sum(map(cost, v)) <= radius and v >= (0,) * sections]
    return sorted(set(steps))


def spanning_links(a: np.ndarray, b: np.ndarray, same: bool, first_radius: int, radius: int, block: int = 256) -> list[tuple[int, int]]:
    """Links of a forest that connects what the pairs within the radius connect; rows of `b` count from len(a)."""
    n, m = len(a), len(b)
    shift = 0 if same else n
    label = np.arange(shift + m)
    out: list[tuple[int, int]] = []
    for at in range(0, n, block):
        near = np.bitwise_count(a[at : at + block, 0, None] ^ b[None, :, 0]) <= first_radius
        rows, cols = np.nonzero(near)
        if same:
            later = cols > rows + at
            rows, cols = rows[later], cols[later]
        if a.shape[1] > 1 or radius < first_radius:
            ok = np.zeros(len(rows), bool)
            for p in range(0, len(rows), ROWS):
                x = a[rows[p : p + ROWS] + at] ^ b[cols[p : p + ROWS]]
                ok[p : p + ROWS] = np.bitwise_count(x).sum(1, dtype=np.int64) <= radius
            rows, cols = rows[ok], cols[ok]
        bounds = np.flatnonzero(np.diff(rows, prepend=-1, append=-1))
        for p, q in zip(bounds[:-1], bounds[1:], strict=True):
            i, js = int(rows[p]) + at, cols[p:q] + shift
            while len(js := js[label[js] != label[i]]):
                j = int(js[0])
                out.append((i, j))
                low, high = sorted((int(label[i]), int(label[j])))
                label[label == high] = low
    return out


def candidates(a: np.ndarray, b: np.ndarray, same: bool, first_radius: int, radius: int, cells: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of `a` and of `b` of all pairs within the radius, in order of the first, some rows at a time.

    The first lane may differ in `first_radius` bits, the first two together in twice as many.
    """
    step, first = max(1, cells // max(1, len(b))), np.ascontiguousarray(b[:, 0])
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, 0, None] ^ first[None, :]) <= first_radius
        rows, cols = np.divmod(np.flatnonzero(near), max(1, len(b)))
        rows += at
        for lanes, most in ((2, 2 * first_radius), (a.shape[1], radius)):
            ok = np.bitwise_count(a[rows, :lanes] ^ b[cols, :lanes]).sum(1, dtype=np.int64) <= most
            rows, cols = rows[ok], cols[ok]
        if same:
            rows, cols = rows[cols > rows], cols[cols > rows]
        if len(rows):
            yield rows, cols


def _touched(batches: Iterable[pa.RecordBatch], lanes: int, first_radius: int, radius: int) -> Iterator[pa.RecordBatch]:
    """The rows of each pair of tiles that have a candidate in it, by side."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = [np.frombuffer(row[c], np.int64) for c in ("ids_a", "ids_b")]
            a, b = (np.frombuffer(row[c], np.uint64).reshape(-1, lanes) for c in ("fp_a", "fp_b"))
            hit = np.zeros(len(a), bool), np.zeros(len(b), bool)
            for rows, cols in candidates(a, b, row["same"], first_radius, radius):
                hit[0][rows] = True
                hit[0 if row["same"] else 1][cols] = True
            for side in (0, 1):
                found = ids[side][hit[side]]
                where = [pa.array(np.full(len(found), row[c], np.int64)) for c in ("tile_a", "part_a", "tile_b", "part_b")]
                yield pa.RecordBatch.from_arrays([*where, pa.array(np.full(len(found), side == 1)), pa.array(found)], names=["tile_a", "part_a", "tile_b", "part_b", "second", "id"])
    release()


def similar_links(shingles: list[np.ndarray], a: np.ndarray, b: np.ndarray, same: bool, first_radius: int, radius: int, similarity: Fraction) -> list[tuple[int, int]]:
    """Links of a forest that connects what the candidates of at least the similarity connect; rows of `b` count from len(a).

    `shingles` are the distinct shingles of the rows of `a`, then of `b`. Only a pair that is connected already goes untested.
    """
    shift, top, base = 0 if same else len(a), similarity.numerator, similarity.denominator
    size = np.array([len(x) for x in shingles], np.int64)
    ends = np.cumsum(size)
    values, number = np.unique(np.concatenate(shingles), return_inverse=True) if len(shingles) else (np.zeros(0), np.zeros(0, np.int64))
    numbers = [number[e - n : e] for e, n in zip(ends, size, strict=True)]
    marked, label, out = np.zeros(len(values), bool), np.arange(len(shingles)), []
    for rows, cols in candidates(a, b, same, first_radius, radius):
        for i in np.unique(rows):
            js = cols[np.searchsorted(rows, i) : np.searchsorted(rows, i, "right")] + shift
            marked[numbers[i]] = True
            while len(js := js[label[js] != label[i]]):
                some, js = js[:TESTED], js[TESTED:]
                shared = np.array([np.count_nonzero(marked[numbers[j]]) for j in some], np.int64)
                alike = base * shared >= top * (size[i] + size[some] - shared)
                for j in some[alike]:
                    if label[j] != label[i]:
                        out.append((int(i), int(j)))
                        low, high = sorted((int(label[i]), int(label[j])))
                        label[label == high] = low
            marked[numbers[i]] = False
    return out


def _verify(table: pa.Table, lanes: int, first_radius: int, radius: int, similarity: Fraction) -> pa.Table:
    """Links among the rows of one pair of tiles that have a candidate in it."""
    second = table.column("second").to_numpy()
    order = np.argsort(second, kind="stable")
    ids = table.column("id").to_numpy()[order]
    fp = table.column("lanes").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, lanes)[order]
    raw = table.column("shingles").to_pylist()
    n = int((~second).sum())
    same = n == len(ids)
    found = similar_links([np.frombuffer(raw[i], np.uint64) for i in order], fp[:n], fp if same else fp[n:], same, first_radius, radius, similarity)
    ends = ids[np.array(found, np.int64).reshape(-1, 2)]
    return pa.table({"a": pa.array(ends.min(1)), "b": pa.array(ends.max(1))})


def _compare(batches: Iterable[pa.RecordBatch], lanes: int, first_radius: int, radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = [np.frombuffer(row[c], np.int64) for c in ("ids_a", "ids_b")]
            a, b = (np.frombuffer(row[c], np.uint64).reshape(-1, lanes) for c in ("fp_a", "fp_b"))
            found = spanning_links(a, b, row["same"], first_radius, radius)
            names = ids[0] if row["same"] else np.concatenate(ids)
            ends = names[np.array(found, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], names=["a", "b"])


def _pack(table: pa.Table) -> pa.Table:
    """A tile as two byte strings: ids, and fingerprints end to end."""
    ids = table.column("id").to_numpy()
    flat = table.column("lanes").combine_chunks().flatten().to_numpy()
    return pa.table({"tile": table.column("tile")[:1], "part": table.column("part")[:1], "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "fp": pa.array([flat.astype(np.int64).tobytes()], pa.binary())})


def tile_pairs(tiled: DataFrame, steps: Iterable[int], parts: Column) -> DataFrame:
    """The packed ids and fingerprints of every two tiles whose numbers differ by one of the steps.

    `tiled` has id, lanes, tile and n; `parts` says from count and largest n into how many parts a tile is dealt.
    """
    counts = tiled.groupBy("tile").agg(F.count("*").alias("count"), F.max("n").alias("n"))
    dealt = tiled.drop("n").join(counts.select("tile", F.greatest(parts.cast("int"), F.lit(1)).alias("parts")), "tile")
    dealt = dealt.select("id", "lanes", "tile", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    packed = materialize(dealt.groupBy("tile", "part").applyInArrow(_pack, "tile long, part int, ids binary, fp binary"), "tiles")
    ahead = F.array(*[F.lit(s).cast("long") for s in steps])
    here = packed.select("tile", "part")
    pairs = here.select(F.col("tile").alias("tile_a"), F.col("part").alias("part_a"), F.explode(F.transform(ahead, lambda s: F.col("tile") + s)).alias("tile"))
    pairs = pairs.join(here, "tile").where("tile > tile_a or tile < tile_a or part >= part_a").select("tile_a", "part_a", F.col("tile").alias("tile_b"), F.col("part").alias("part_b"))
    side = lambda x: packed.select(F.col("tile").alias(f"tile_{x}"), F.col("part").alias(f"part_{x}"), F.col("ids").alias(f"ids_{x}"), F.col("fp").alias(f"fp_{x}"))
    full = pairs.join(side("a"), ["tile_a", "part_a"]).join(side("b"), ["tile_b", "part_b"])
    same = ((F.col("tile_a") == F.col("tile_b")) & (F.col("part_a") == F.col("part_b"))).alias("same")
    return full.select("tile_a", "part_a", "tile_b", "part_b", "ids_a", "fp_a", "ids_b", "fp_b", same)


def links(nodes: DataFrame, lanes: int, radius: int, first_radius: int, sections: int, width: int, tile_rows: int) -> DataFrame:
    """(a, b): links between node ids that connect all nodes within the radius. `nodes` has id and lanes, stored."""
    tiled = nodes.select("id", "lanes", _section_counts(F.get("lanes", 0), sections, width).alias("tile"), F.lit(1).alias("n"))
    full = tile_pairs(tiled, neighbour_steps(sections, width, min(radius, first_radius)), F.ceil(F.col("count") / tile_rows))
    return full.select("ids_a", "fp_a", "ids_b", "fp_b", "same").mapInArrow(lambda b: _compare(b, lanes, first_radius, radius), "a long, b long")


def _place(key: Column) -> Column:
    """A key as text, also a null one."""
    return F.coalesce(key.cast("long").cast("string"), F.lit("-"))


def verified_links(nodes: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, similarity: float, lanes: int, radius: int, first_radius: int, tile_rows: int) -> DataFrame:
    """(a, b): links that connect the nodes of at least the similarity. `nodes` has id, lanes, n and (k, th) of one of its rows in `docs`.

    Tiles are made by the size of the set of shingles, in steps of the log size: only sets of about the same size can
    be that similar. The shingles of a tile stay within TILE_BYTES, a single larger set apart.
    """
    step = math.log(1 / similarity) / STEPS if similarity < 1 else 1e-9
    tiled = nodes.select("id", "lanes", F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / step + 1e-9).cast("long").alias("tile"), "n")
    full = tile_pairs(tiled, range(STEPS + 2), F.greatest(F.ceil(F.col("count") / tile_rows), F.ceil(F.col("count") * F.col("n") * 8 / TILE_BYTES)))
    at = "tile_a long, part_a long, tile_b long, part_b long, second boolean, id long"
    touched = materialize(full.mapInArrow(lambda b: _touched(b, lanes, first_radius, radius), at), "touched")
    wanted = nodes.join(touched.select("id").distinct(), "id").select("id", "lanes", _place(F.col("k")).alias("_at"), F.col("th").alias("_th"))
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    texts = docs.select(_place(col(key)).alias("_at"), F.xxhash64(body).alias("_th"), body.alias("t")).join(wanted, ["_at", "_th"])
    sets = texts.select("id", "lanes", "t").mapInArrow(lambda b: _sets(b, shingle), "id long, lanes array<long>, shingles binary")
    sets = materialize(sets.dropDuplicates(["id"]), "sets")
    least = Fraction(str(similarity))
    grouped = touched.join(sets, "id").groupBy("tile_a", "part_a", "tile_b", "part_b")
    return grouped.applyInArrow(lambda t: _verify(t, lanes, first_radius, radius, least), "a long, b long")


def connected(edges: DataFrame, label: str = "stars") -> DataFrame:
    """(id, root): smallest id of each component, for ids that have a link; alternating large and small star steps.

    A node with many links is never gathered: each step takes one minimum per node and joins it back.
    """
    now = materialize(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), label)

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).collect()[0])

    seen = state(now)
    while True:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = materialize(large, label)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi")
        small = moved.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionAll(moved.select(F.col("m").alias("lo"), "hi")).where("lo < hi").distinct()
        now = materialize(small, label)
        found = state(now)
        if found == seen:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionAll(now.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
        seen = found


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, lanes: int = 1, radius: int = 2, first_radius: int | None = None, sections: int = 4, width: int = 1, tile_rows: int = 4096, similarity: float | None = None) -> DataFrame:
    """(k, th, lanes, component): every row's key, text hash, fingerprint and the smallest key linked with it.

    Fingerprints link at `radius` or fewer differing bits over all lanes, of which `first_radius` (default: radius)
    or fewer in the first. Small radii should use more `sections`, which leaves fewer tile pairs. Null texts are empty; rows of a null key
    get the component of their fingerprint, null if no key is linked with it. An empty table gives no rows.

    With a `similarity` only pairs within the radius that share at least that part of their distinct shingles link;
    tiles then follow the number of shingles, not `sections` and `width`.
    """
    first = radius if first_radius is None else first_radius
    if similarity is not None:
        made = materialize(sketches(docs, key, text, shingle, lanes, sets=True), "sketches")
        rep = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "th"))
        nodes = materialize(made.groupBy("lanes", "sh").agg(rep.alias("m"), F.max("n").alias("n")).select("lanes", "sh", "n", "m.k", "m.th", F.xxhash64("lanes", "sh").alias("id")), "nodes")
        roots = connected(verified_links(nodes, docs, key, text, shingle, similarity, lanes, radius, first, tile_rows))
        placed = nodes.join(roots, "id", "left").select("lanes", "sh", "k", F.coalesce("root", "id").alias("root"))
        least = placed.groupBy("root").agg(F.min("k").alias("component"))
        named = materialize(placed.join(least, "root").select("lanes", "sh", "component"), "groups")
        return made.join(named, ["lanes", "sh"], "left").select("k", "th", "lanes", "component")
    made = materialize(sketches(docs, key, text, shingle, lanes), "sketches")
    nodes = materialize(made.groupBy("lanes").agg(F.min("k").alias("rep")).select("lanes", "rep", F.coalesce("rep", F.xxhash64("lanes")).alias("id")), "nodes")
    roots = connected(links(nodes, lanes, radius, first, sections, width, tile_rows))
    placed = nodes.join(roots, "id", "left").select("lanes", "rep", F.coalesce("root", "id").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component"))
    named = materialize(placed.join(least, "root").select("lanes", "component"), "groups")
    return made.join(named, "lanes", "left").select("k", "th", "lanes", "component")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of `docs` that stay when one of each component does: its smallest key (null last), then text hash.

    Of fully repeated rows (same key and text) one stays. All columns are kept.
    """
    found = components(docs, key, text, **settings)
    group = F.when(F.col("component").isNotNull(), F.concat(F.lit("="), F.col("component").cast("string"))).otherwise(F.concat_ws(",", F.transform("lanes", lambda x: x.cast("string"))))
    keep = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "th")).alias("m")).select("m.k", "m.th")
    chosen = keep.select(_place(F.col("k")).alias("_at"), F.col("th").alias("_th")).distinct()
    boxed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_row"), _place(col(key)).alias("_at"), F.xxhash64(F.coalesce(col(text).cast("string"), F.lit(""))).alias("_th"))
    one = boxed.select("*", F.row_number().over(Window.partitionBy("_at", "_th").orderBy("_th")).alias("_nth")).where("_nth = 1")
    return one.join(chosen, ["_at", "_th"], "left_semi").select("_row.*")
