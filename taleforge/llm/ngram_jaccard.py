"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

1. Every text becomes its set of distinct n-word shingles (64-bit hashes). Texts with equal sets form
   a class, found by an order-free digest; only one member of a class goes on.
2. Two sets can only reach the similarity if they share one of their first ``size - needed + 1`` members
   in one fixed order of all shingles (prefix filter). Shingles that a bounded sample finds in several
   texts come last in this order, the most frequent at the end: that keeps common passages out of the
   prefixes. Any order is exact. A member's place in the order bounds the overlap, and so the size of
   partners: members of a run (all sets that share a prefix member) without a fitting neighbour by size go.
3. Classes of a run are first linked to the least class of the run and to their neighbour by size; after
   exact verification the components of these links are contracted.
4. What remains of each run with several components is sorted by size and cut into blocks. Two blocks
   whose size bands can meet form a tile, unless both lie in the run's first component. In a tile, pairs
   of different components survive if their sizes and places fit and if the bit counts of their signatures
   do not already bound the overlap below what is needed. A pair that shares one of its first few members
   is left to the run of the first of these. Survivors are verified exactly, too, and joined into the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taleforge.llm.common import binaries, discard, distinct_by_row, let_go, mix, rebatched, shingle_hashes, stash, text_bytes, word_hashes
from taleforge.llm.graph import components

#: Rows of a run that one side of a tile holds.
TILE_ROWS = 1024
#: Bits of the driver's filter of texts that need their sets again.
WANTED_BITS = 1 << 23
#: Texts sampled to find common shingles, and how many of those are kept at most (12 bytes each). They only order the members.
SAMPLE_ROWS, COMMON_MOST = 12_000, 400_000
#: First members of a set that go along into its tiles, so that a pair is found in one run and not in all that it shares.
HEADS = 4
#: Bits of a signature for each member, at least.
BITS = 2
#: Classes whose sketch a task remembers having written.
REMEMBERED = 1 << 18


def needed_overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least intersection with den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def prefix_length(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """A partner of the similarity shares at least num/den of the set, so one of so many first members."""
    return size - -(-num * size // den) + 1


def signature_bytes(size: int) -> int:
    """Width of a set's signature: 2 to 4 bits a member, a power of two, 64 bits at least."""
    return max(64, 1 << max(0, int(BITS * size - 1).bit_length())) // 8


def sets_of(batch: pa.RecordBatch, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(batch.column(text))
    return distinct_by_row(*shingle_hashes(*word_hashes(raw, offsets), n))


def digests(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set."""
    out = []
    for seed in (0x51ED270B, 0x7C0FFEE1):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(seed)))])
        out.append(mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _sketcher(text: str, n: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray]) -> Callable:
    """Of each row its size and digests; of the first row of a class in a task also prefix and signature."""
    shared, rank = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen: set[int] = set()
        for batch in rebatched(batches, text):
            values, offsets = sets_of(batch, text, n)
            size = np.diff(offsets)
            k1, k2 = digests(values, offsets)
            late = np.zeros(len(values), bool)
            if len(shared) and len(values):
                at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
                late = shared[at] == values
            take = np.where(size > 0, prefix_length(size, num, den), 0)
            heads: list = []
            marks: list = []
            if len(seen) > REMEMBERED:
                seen.clear()
            for a, b, k, cid in zip(offsets[:-1].tolist(), offsets[1:].tolist(), take.tolist(), k1.tolist(), strict=True):
                if a == b or cid in seen:
                    heads.append(None)
                    marks.append(None)
                    continue
                seen.add(cid)
                own, bits = values[a:b], np.zeros(signature_bytes(b - a) * 8, np.uint8)
                bits[(mix(own) & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
                marks.append(np.packbits(bits, bitorder="little").tobytes())
                if late[a:b].any():
                    last = np.flatnonzero(late[a:b])
                    own = np.concatenate([own[~late[a:b]], own[last[np.argsort(rank[at[a:b][last]])]]])
                heads.append(own[:k].view(np.int64))
            columns = [batch.column("__id"), pa.array(size, pa.int64()), pa.array(k1), pa.array(k2), pa.array(heads, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "cid", "k2", "prefix", "sig"])

    return run


def _common(docs: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of SAMPLE_ROWS hashed texts hold, and their places from rare to frequent: a bounded list that only orders the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, text):
            values, offsets = sets_of(batch, text, n)
            k1, _ = digests(values, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.repeat(k1, np.diff(offsets)))], names=["h", "c"])

    rows = docs.count()
    part = docs if rows <= SAMPLE_ROWS else docs.where(F.pmod(F.xxhash64("__id"), F.lit(rows)) < SAMPLE_ROWS)
    seen = part.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.count_distinct("c").alias("n")).where("n >= 4")
    found = seen.orderBy(F.desc("n"), "h").limit(COMMON_MOST).select("h").toPandas()["h"].to_numpy()
    values = found.astype(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(order) - order).astype(np.int32)


def _wanted(ids: DataFrame) -> np.ndarray:
    """A bitmap of the hashed ids; each task sends one of WANTED_BITS bits, merged as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(WANTED_BITS, np.uint8)
        for b in batches:
            bits[b.column("h").to_numpy()] = 1
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(WANTED_BITS // 8, np.uint8)
    slot = F.pmod(F.xxhash64("id"), F.lit(WANTED_BITS))
    for row in ids.select(slot.alias("h")).distinct().coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(total)


def _plausible(pairs: DataFrame, sketch: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose signatures leave room for the overlap that is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, n = b.column("m").to_numpy(), b.column("n").to_numpy()
            least = np.empty(len(m), np.int64)
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                if len(x) != len(y):  # fold the wider one
                    w = min(len(x), len(y))
                    x, y = (np.bitwise_or.reduce(z.reshape(-1, w), axis=0) for z in (x, y))
                least[i] = min(m[i] - int(np.bitwise_count(x & ~y).sum()), n[i] - int(np.bitwise_count(y & ~x).sum()))
            yield b.select(["a", "b"]).filter(pa.array(least >= needed_overlap(m, n, num, den)))

    named = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    marks = sketch.where("size > 0").select("cid", "size", "sig").join(named, "cid", "left_semi").dropDuplicates(["cid"])
    x, y = marks.toDF("a", "m", "x"), marks.toDF("b", "n", "y")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, n: int, num: int, den: int, name: str) -> DataFrame:
    """The pairs (a, b) of classes that reach the similarity. Sets are made again from the texts of the classes named."""
    pairs = stash(pairs, f"{name}-pairs")
    named = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(_wanted(classes.join(named, "cid", "left_semi").select("id"))))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(held[batch.column("__slot").to_numpy()]))
            for part in rebatched([batch], text):
                values, offsets = sets_of(part, text, n)
                yield pa.RecordBatch.from_arrays([pa.array(digests(values, offsets)[0]), binaries(values, offsets)], names=["cid", "members"])

    slot = F.pmod(F.xxhash64("__id"), F.lit(WANTED_BITS))
    made = docs.withColumn("__slot", slot).mapInArrow(arrays, "cid bigint, members binary").join(F.broadcast(named) if named.count() < 100_000 else named, "cid", "left_semi")
    made = stash(made.groupBy("cid").agg(F.first("members").alias("members")), f"{name}-members")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(made.select(F.col("cid").alias("a"), F.col("members").alias("x")), "a").join(made.select(F.col("cid").alias("b"), F.col("members").alias("y")), "b")
    return stash(both.select("a", "b", "x", "y").mapInArrow(check, "u bigint, v bigint"), f"{name}-links")


def _fold(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def tile_pairs(
    tile: np.ndarray, size: np.ndarray, root: np.ndarray, cid: np.ndarray, side: np.ndarray, pos: np.ndarray, first: np.ndarray, sigs: list, num: int, den: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each tile (rows sorted by tile) with other roots, fitting sizes and places and enough room in their signatures.

    side: 0 or 1 where the tile holds two blocks (only pairs across count), else 2. pos: the place of the run's
    member in the own prefix; first: the first HEADS members of the prefix (rows, HEADS). A pair is left out
    where both have a common member before the run's one: it is found there.
    """
    width = np.array([len(s) for s in sigs])
    place = np.zeros(len(sigs), np.int64)
    own, half = {}, {}
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        place[rows] = np.arange(len(rows))
        own[w] = np.frombuffer(b"".join(sigs[r] for r in rows), np.uint64).reshape(len(rows), -1)
        half[w] = _fold(own[w]) if w > 8 else own[w]
    left, right = [], []
    live = np.arange(len(tile))
    rest = size - pos
    gap = 1
    while len(live):
        live = live[live + gap < len(tile)]
        live = live[tile[live] == tile[live + gap]]
        i, j = live, live + gap
        fit = (root[i] != root[j]) & ((side[i] == 2) | (side[i] != side[j])) & (needed_overlap(size[i], size[j], num, den) <= np.minimum(rest[i], rest[j]))
        fit &= den * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j])
        i, j = i[fit], j[fit]
        swap = size[i] > size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        for w in np.unique(width[i]).tolist():
            for table, k in ((own, w), (half, 2 * w)):
                at = (width[i] == w) & (width[j] == k)
                if at.any():
                    x, y = own[w][place[i[at]]], table[k][place[j[at]]]
                    least = np.minimum(size[i[at]] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), size[j[at]] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
                    good = least >= needed_overlap(size[i[at]], size[j[at]], num, den)
                    left.append(i[at][good])
                    right.append(j[at][good])
        gap += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    before = np.zeros(len(i), bool)
    for x in range(first.shape[1]):
        for y in range(first.shape[1]):
            before |= (first[i, x] == first[j, y]) & (x < pos[i]) & (y < pos[j])
    a, b = cid[i[~before]], cid[j[~before]]
    return np.minimum(a, b), np.maximum(a, b)


def _tiler(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        rest: pa.Table | None = None

        def flush(t: pa.Table) -> pa.RecordBatch:
            col = {k: t.column(k).combine_chunks().to_numpy().astype(np.int64) for k in ("tile", "size", "root", "cid", "side", "pos")}
            sigs = t.column("sig").to_pylist()
            first = np.frombuffer(b"".join(t.column("first").to_pylist()), np.uint64).reshape(-1, HEADS)
            a, b = tile_pairs(*(col[k] for k in ("tile", "size", "root", "cid", "side", "pos")), first, sigs, num, den)
            both = np.unique(np.stack([a, b], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            tiles = t.column("tile").to_numpy()
            cut = int(np.searchsorted(-(tiles[::-1] == tiles[-1]).astype(int), 0, side="left")) if len(tiles) else 0
            whole, rest = t.slice(0, len(tiles) - cut), t.slice(len(tiles) - cut)
            if whole.num_rows:
                yield flush(whole)
        if rest is not None and rest.num_rows:
            yield flush(rest)

    return run


def ngram_jaccard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100, name: str = "jaccard") -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: components of texts with Jaccard >= num/den of their n-word shingle sets.

    Words: runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer than n words is
    one shingle. Null, empty and blank texts have no shingle, link with nothing and stand for themselves.
    component_id is the smallest id reachable; rows with a null id link as any others, but never name a
    component (a component of null ids only has a null name). Repeated rows are repeated in the result.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias(text_col))
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, text_col, n))
    sketch = stash(docs.mapInArrow(lambda it: _sketcher(text_col, n, num, den, common.value)(it), "id bigint, size bigint, cid bigint, k2 bigint, prefix array<bigint>, sig binary"), f"{name}-sketch")
    groups = stash(sketch.where("size > 0").groupBy("cid", "k2", "size").agg(F.min("id").alias("id")), f"{name}-classes")
    # the members of all prefixes, once for each class (tasks may each have written one)
    member = sketch.where("prefix is not null").select("cid", F.col("size").cast("int").alias("size"), F.posexplode("prefix").alias("pos", "key"))
    member = member.repartition("key").dropDuplicates(["key", "cid"])
    # the largest partner that the overlap from this place on allows; members without a fitting neighbour by size go
    member = member.withColumn("cap", F.expr(f"cast((size - pos) * {num + den}L div {num} - size as int)"))
    whole, by_size = W.partitionBy("key"), W.partitionBy("key").orderBy("size", "cid")
    runs = member.withColumns({"below": F.lag("size").over(by_size), "above": F.lead("size").over(by_size), "reach": F.max("cap").over(by_size.rowsBetween(W.unboundedPreceding, -1))})
    runs = runs.where(f"({den}L * below >= {num}L * size and reach >= size) or above <= cap").select("key", "cid", "size", "pos")
    runs = runs.withColumns({"least": F.min(F.struct("cid", "size")).over(whole), "next": F.lead(F.struct("cid", "size")).over(by_size)})
    runs = stash(runs.where("next is not null or least.cid <> cid"), f"{name}-runs")
    links_of = [runs.where(f"{c}.cid <> cid and {den}L * least(size, {c}.size) >= {num}L * greatest(size, {c}.size)").select(F.least("cid", f"{c}.cid").alias("a"), F.greatest("cid", f"{c}.cid").alias("b")) for c in ("least", "next")]
    near = stash(links_of[0].union(links_of[1]).distinct(), f"{name}-near")
    links = _verified(_plausible(near, sketch, num, den), groups, docs, text_col, n, num, den, f"{name}-first")
    discard(near)
    roots = stash(components(links, f"{name}-first"), f"{name}-roots")

    # what the first links leave open: runs of several roots, small ones as one tile, larger ones in blocks
    rooted = runs.select("key", "cid", "size", "pos").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rooted = rooted.withColumns({"lo": F.min("root").over(whole), "hi": F.max("root").over(whole), "n": F.count("*").over(whole)}).where("lo <> hi")
    inner = F.when(F.col("n") > TILE_ROWS, F.col("root") == F.col("lo")).otherwise(F.lit(False))
    rooted = rooted.withColumn("inner", inner).drop("lo", "hi")
    block = F.floor((F.row_number().over(W.partitionBy("key", "inner").orderBy("size", "cid")) - 1) / F.lit(TILE_ROWS)) * 2 + F.col("inner").cast("int")
    blocks = stash(rooted.withColumn("block", block).drop("inner"), f"{name}-blocks")
    discard(runs)
    columns = ["size", "pos", "root", "cid"]
    large = blocks.where(f"n > {TILE_ROWS}")
    spans = large.groupBy("key", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    x, y = spans.alias("x"), spans.alias("y")
    meet = x.join(y, F.col("x.key") == F.col("y.key")).where(f"x.block <= y.block and {den}L * x.high >= {num}L * y.low and {den}L * y.high >= {num}L * x.low and not (x.block % 2 = 1 and y.block % 2 = 1)")
    meet = meet.select(F.col("x.key").alias("key"), F.col("x.block").alias("p"), F.col("y.block").alias("q"))
    sides = meet.select("key", "p", "q", F.col("p").alias("block"), F.when(F.col("p") == F.col("q"), 2).otherwise(0).alias("side")).union(meet.where("p < q").select("key", "p", "q", F.col("q").alias("block"), F.lit(1).alias("side")))
    tiles = blocks.where(f"n <= {TILE_ROWS}").select(F.xxhash64("key").alias("tile"), *columns, F.lit(2).alias("side")).union(large.join(sides, ["key", "block"]).select(F.xxhash64("key", "p", "q").alias("tile"), *columns, "side"))
    head = F.unhex(F.array_join(F.transform(F.slice("prefix", 1, HEADS), lambda v: F.lpad(F.hex(v), 16, "0")), ""))
    marks = sketch.where("prefix is not null").select("cid", "sig", F.rpad(head, 8 * HEADS, F.lit(b"\0")).alias("first"))
    marks = marks.join(blocks.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"])
    tiles = tiles.join(marks, "cid").select("tile", *columns, "side", "sig", "first")
    found = tiles.repartition("tile").sortWithinPartitions("tile", "size", "cid").mapInArrow(_tiler(num, den), "a bigint, b bigint").distinct()
    more = _verified(found, groups, docs, text_col, n, num, den, f"{name}-more")
    discard(blocks)
    links = links.union(more)
    roots = components(links, f"{name}-all")

    named = groups.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    named = stash(named.join(least, "root").select("cid", "component"), f"{name}-named")
    out = sketch.select("id", "size", "cid").join(named, "cid", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
