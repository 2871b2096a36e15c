"""Sharding by fixed virtual slots: records are hashed into thousands of slots, bytes are summed per slot,
and a versioned slot-to-shard map is edited when shards are rebalanced or added. DataFrame functions only."""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taleforge.llm.common import stash

#: Virtual slots; fixed for the life of a data set, so a record never changes its slot.
SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: the shard of each slot, with the bytes and rows that led to it."""

    version: int
    shards: int
    shard: tuple[int, ...]
    size: tuple[int, ...]
    rows: tuple[int, ...]

    def loads(self) -> list[int]:
        total = [0] * self.shards
        for s, b in zip(self.shard, self.size, strict=True):
            total[s] += b
        return total

    def table(self, spark: SparkSession) -> DataFrame:
        """The map as (version, shards, slot, shard, bytes, rows)."""
        entries = [{"version": self.version, "shards": self.shards, "slot": i, "shard": s, "bytes": b, "rows": r} for i, (s, b, r) in enumerate(zip(self.shard, self.size, self.rows, strict=True))]
        kind = "array<struct<version:int,shards:int,slot:int,shard:int,bytes:bigint,rows:bigint>>"
        return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(entries)), kind)).alias("e")).select("e.*")


    @staticmethod
    def read(rows: DataFrame, version: int | None = None) -> SlotMap:
        """A version of the map (the newest one) from the stored table of all versions; one row a slot."""
        got = sorted(rows.where(F.col("version") == (rows.agg(F.max("version")).first()[0] if version is None else version)).collect(), key=lambda r: r.slot)
        if not got:
            raise ValueError(f"the table holds no version {version} of the map")
        return SlotMap(got[0].version, got[0].shards, *(tuple(r[k] for r in got) for k in ("shard", "bytes", "rows")))


def first_map(size: list[int], rows: list[int], shards: int) -> SlotMap:
    """Version 0: slots are dealt to the shards in turn."""
    return SlotMap(0, shards, tuple(i % shards for i in range(len(size))), tuple(size), tuple(rows))


def rebalanced(old: SlotMap) -> SlotMap:
    """The next version: single slots move, or change places, between the fullest and the emptiest shard while this helps."""
    shard, load = list(old.shard), old.loads()
    held = [sorted((old.size[i], i) for i in range(len(shard)) if shard[i] == s) for s in range(old.shards)]
    for _ in range(4 * len(shard)):
        top, low = max(range(old.shards), key=load.__getitem__), min(range(old.shards), key=load.__getitem__)
        gap = load[top] - load[low]
        best = None  # the change that leaves the least gap: (gap left, slot out, slot back)
        for back in [(0, -1), *held[low]]:
            at = bisect_left(held[top], (back[0] + gap // 2, -1))
            for out in held[top][max(0, at - 1) : at + 1]:
                left = abs(gap - 2 * (out[0] - back[0]))
                if out[0] > back[0] and left < gap and (best is None or left < best[0]):
                    best = (left, out, back)
        if best is None or gap <= 1:
            break
        _, out, back = best
        for x, a, b in ((out, top, low), (back, low, top)):
            if x[1] >= 0:
                held[a].remove(x)
                held[b].insert(bisect_left(held[b], x), x)
                shard[x[1]], load[a], load[b] = b, load[a] - x[0], load[b] + x[0]
    return SlotMap(old.version + 1, old.shards, tuple(shard), old.size, old.rows)


def grown(old: SlotMap) -> SlotMap:
    """The next version with one more shard: slots move into it from the fullest shards, and nowhere else."""
    shard, load = list(old.shard), [*old.loads(), 0]
    new, fair = old.shards, sum(old.size) / (old.shards + 1)
    held = [sorted((old.size[i], i) for i in range(len(shard)) if shard[i] == s) for s in range(old.shards)]
    while True:
        top = max(range(new), key=load.__getitem__)
        fit = [x for x in held[top] if load[new] + x[0] <= fair] if load[top] > fair else []
        if not fit:
            break
        size, slot = fit[-1]
        held[top].remove((size, slot))
        shard[slot], load[top], load[new] = new, load[top] - size, load[new] + size
    return SlotMap(old.version + 1, old.shards + 1, tuple(shard), old.size, old.rows)


def _lookup(values: list[int], at: Column, kind: str) -> Column:
    """A constant array, folded into the plan, read at a slot."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), at + 1)


def sized(docs: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 8
    out = docs.select(F.col(id_col), size.alias("size"), F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"))
    return out.withColumn("virtual_slot", F.pmod(F.xxhash64(id_col, "text_crc32", "size"), F.lit(slots)).cast("int"))


def shard(docs: DataFrame, *, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, old: SlotMap | None = None, name: str = "shard", stored: list[DataFrame] | None = None) -> tuple[DataFrame, SlotMap]:
    """Rows with their shard and their gapless place in it, and the map that decides; law ``bytes``.

    A row's size is its text's UTF-8 bytes (null: none) plus 8. Its virtual slot is a hash of id, text
    checksum and size, so null or repeated ids spread, and equal rows share a slot. Pass the map in force as
    ``old`` to edit it instead of starting anew; otherwise version 0 deals the slots in turn. Both the map in force
    and its edit are stored as a table, and rows are placed by the version read back from there (``stored``
    keeps it). Only ``slots`` sums reach the driver. The place is the
    rows of the shard's earlier slots plus the rank in the own slot, so no task sorts a whole shard.
    A null text has a null checksum. An empty table gives no rows; extra columns are left out.
    """
    rows = stash(sized(docs, id_col, text_col, slots), f"{name}-sized")
    sums = {r.virtual_slot: (r.b, r.n) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    size, count = ([sums.get(i, (0, 0))[k] for i in range(slots)] for k in (0, 1))
    start = first_map(size, count, shards) if old is None else SlotMap(old.version, old.shards, old.shard, tuple(size), tuple(count))
    versions = stash(start.table(docs.sparkSession), f"{name}-map")
    versions = stash(versions.union(rebalanced(SlotMap.read(versions)).table(docs.sparkSession)), f"{name}-map")
    if stored is not None:
        stored.append(versions)
    best = SlotMap.read(versions)
    before, seen = [0] * slots, [0] * best.shards
    for i in range(slots):
        before[i] = seen[best.shard[i]]
        seen[best.shard[i]] += count[i]
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy(F.col(id_col), "text_crc32", "size")) - 1
    out = rows.select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), _lookup(list(best.shard), F.col("virtual_slot"), "int").alias("shard"),
        (_lookup(before, F.col("virtual_slot"), "bigint") + rank).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(best.version).alias("map_version"),
    )
    return out, best
