"""Packing by cutting stock: documents become sequences of at most ``capacity`` tokens without padding.

A document's whole stretches of ``capacity`` tokens are sequences of their own. What is left of it is an item
of its length. The histogram of lengths (at most capacity - 1 numbers) goes to the driver, which solves the
cutting-stock program; documents are ranked within their length, and the rank alone says which copy of
which pattern takes them and where. Items that no exact pattern takes stand one after the other, also placed
by length and rank, and are cut wherever a sequence ends; the last stretch becomes sequences of
powers of two.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taleforge.llm.bpe import byte_letters
from taleforge.llm.common import held, rebatched, stash
from taleforge.llm.cutting_stock import full_patterns, powers

#: Runs between spaces that a worker keeps in each of two generations.
CACHE = 250_000
#: Cut items that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Fixed value: the published pattern of the byte-level vocabulary's pieces.
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Irregular(Exception):
    """A run whose white space reaches beyond it."""


class ByteIds:
    """Ids of texts as little-endian unsigned 32-bit integers, with a bounded table of runs between single spaces.

    A run that neither begins nor ends with white space is cut into pieces independently of its
    neighbours, the space before it included; texts with other runs are encoded whole.
    """

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)
        letters = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.special = tuple(special)
        self.coder = tiktoken.Encoding("byte-level", pat_str=BYTE_PIECES, mergeable_ranks=ranks, special_tokens=special)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.coder.encode(text, allowed_special="all"), "<u4").tobytes()
        return np.array(self.coder.encode_ordinary(text), "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        found = self.old.get(run)
        if found is None:
            if not run or run[0].isspace() or run[-1].isspace() or "<|" in run:
                raise _Irregular
            found = np.array(self.coder.encode_ordinary(" " + run), "<u4").tobytes()
        if len(run) <= 512:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[run] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        known, run = self.new, self._run
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise _Irregular
            made = []
            for r in rest:
                found = known.get(r)
                if found is None:
                    found = run(r)
                    known = self.new
                made.append(found)
            return self.whole(first) + b"".join(made)
        except _Irregular:
            return self.whole(text)


def byte_ids(spec: str) -> ByteIds:
    return held(f"byte-ids-{zlib.crc32(spec.encode())}", lambda: ByteIds(spec))


ITEMS = "__id bigint, tokens bigint, part int, row bigint, own bigint, crcs array<bigint>, r int, rank bigint, crc bigint, tail binary"


def _items(docs: DataFrame, vocabulary: str, text: str, capacity: int, end: int) -> DataFrame:
    """One row a document: its token count, checksums of its whole stretches, and the rest with its rank in the task.

    part and row name the row; own counts the whole stretches of the task's earlier rows.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, work = TaskContext.get().partitionId(), byte_ids(spec.value).encode
        ranks, row, own = [0] * capacity, 0, 0
        for batch in rebatched(batches, text, 8 << 20):
            out: list[list] = [[] for _ in range(9)]
            for value in batch.column(text):
                ids = work(value.as_py() or "") + stop
                n = len(ids) // 4
                crcs = [zlib.crc32(ids[k : k + 4 * capacity]) for k in range(0, 4 * (n // capacity) * capacity, 4 * capacity)]
                r = n % capacity
                tail = ids[len(ids) - 4 * r :] if r else b""
                for to, x in zip(out, (n, part, row, own, crcs, r, ranks[r], zlib.crc32(tail), tail), strict=True):
                    to.append(x)
                ranks[r] += 1
                row += 1
                own += len(crcs)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["__id", "tokens", "part", "row", "own", "crcs", "r", "rank", "crc", "tail"])

    return docs.mapInArrow(run, ITEMS)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[dict], int, int]:
    """Where the items of each length go by rank: rows (r, lo, hi, base, copies, at); then sequences used and tokens left over.

    copies > 0: ranks lo to hi - 1 go to sequences base, base + 1, ..., copies to each, from offset at on.
    copies = 0: they follow one another from position base of the left-over stretch on.
    """
    chosen, left = full_patterns(histogram, capacity)
    rows, used, taken = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in chosen:
        at = 0
        for length, copies in pattern:
            rows.append({"r": length, "lo": taken[length], "hi": taken[length] + copies * times, "base": used, "copies": copies, "at": at})
            taken[length] += copies * times
            at += copies * length
        used += times
    stretch = 0
    for length, count in sorted(left.items(), reverse=True):
        rows.append({"r": length, "lo": taken[length], "hi": taken[length] + count, "base": stretch, "copies": 0, "at": 0})
        stretch += length * count
    return rows, used, stretch


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end: int = 0, name: str = "pack") -> DataFrame:
    """One row a piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's (null: empty) by the byte-level tokenizer file ``vocabulary`` (read on the
    driver, broadcast) and then ``end``, so an empty text is one token. Repeated rows and null ids are
    documents of their own. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    if id_type not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("documents are named by integers")
    docs = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias(text_col))
    items = stash(_items(docs, vocabulary, text_col, capacity, end), f"{name}-items")

    # ranks and whole stretches of earlier tasks: one row per task and length
    slim = items.select("__id", "tokens", "part", "row", "own", "crcs", "r", "rank", "crc")
    counts = slim.where("r > 0").groupBy("part", "r").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("r").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = stash(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), f"{name}-before")
    histogram = {row.r: row.n for row in before.groupBy("r").agg(F.sum("n").alias("n")).collect()}
    rows, used, stretch = plan(histogram, capacity)
    whole = slim.groupBy("part").agg(F.sum(F.size("crcs")).alias("n"))
    wholes = stash(whole.withColumn("first", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), f"{name}-wholes")
    after = used + stretch // capacity + len(powers(stretch % capacity))

    full = slim.where(F.size("crcs") > 0).join(wholes.select("part", "first"), "part")
    full = full.select("__id", "tokens", (F.col("first") + F.col("own") + after).alias("base"), F.posexplode("crcs").alias("k", "crc"))
    full = full.select("__id", (F.col("k") * F.lit(capacity).cast("bigint")).alias("start"), F.lit(capacity).cast("bigint").alias("length"), "crc", "tokens", (F.col("base") + F.col("k")).alias("sequence"), F.lit(0).cast("bigint").alias("offset"))

    # the plan has at most a few rows for each length and pattern: bounded by the capacity
    frame = pd.DataFrame(rows, columns=["r", "lo", "hi", "base", "copies", "at"]).astype("int64")
    places = spark.createDataFrame(frame, "r bigint, lo bigint, hi bigint, base bigint, copies bigint, at bigint")
    placed = slim.where("r > 0").select("__id", "tokens", "part", "row", "r", "rank", "crc").join(before.select("part", "r", "before"), ["part", "r"])
    placed = placed.withColumn("rank", F.col("rank") + F.col("before")).drop("before").join(F.broadcast(places), "r").where("rank >= lo and rank < hi")
    begin = F.col("tokens") - F.col("r")
    kept = placed.where("copies > 0").select(
        "__id", begin.alias("start"), F.col("r").cast("bigint").alias("length"), "crc", "tokens",
        F.expr("base + (rank - lo) div copies").alias("sequence"), F.expr("at + (rank - lo) % copies * r").alias("offset"),
    )

    # the left-over stretch: every item lies at [p, q) and is cut where a sequence ends
    last = stretch // capacity * capacity
    ends = list(np.cumsum(powers(stretch % capacity)) + last) if stretch % capacity else []
    marks = ",".join(f"{int(x)}L" for x in [last, *ends]) if ends else f"{last}L"
    loose = placed.where("copies = 0").selectExpr("__id", "tokens", "part", "row", "cast(tokens - r as bigint) as begin", "base + (rank - lo) * r as p", "base + (rank - lo + 1) * r as q")
    inner = f"filter(array_union(array((p div {capacity} + 1) * {capacity}), array({marks})), x -> x > p and x < q)"
    loose = loose.withColumn("cuts", F.expr(f"array_sort(array_distinct(concat(array(p), {inner}, array(q))))"))
    loose = loose.selectExpr("*", "inline(zip_with(slice(cuts, 1, size(cuts) - 1), slice(cuts, 2, size(cuts) - 1), (a, b) -> struct(a as a, b as b)))").drop("cuts")
    loose = stash(loose, f"{name}-loose")
    small = loose.count() <= BROADCAST_ROWS
    named = F.broadcast(loose) if small else loose
    tails = items.select("part", "row", "tail").join(named, ["part", "row"])
    ladder = [last, *(int(x) for x in ends)]
    sequence, offset = F.expr(f"{used} + a div {capacity}"), F.expr(f"a % {capacity}")
    for k, (lo, hi) in enumerate(zip(ladder, ladder[1:], strict=False)):
        inside = (F.col("a") >= lo) & (F.col("a") < hi)
        sequence = F.when(inside, F.lit(used + last // capacity + k).cast("bigint")).otherwise(sequence)
        offset = F.when(inside, F.col("a") - lo).otherwise(offset)
    crc = F.expr("crc32(substring(tail, cast(4 * (a - p) + 1 as int), cast(4 * (b - a) as int)))")
    cut = tails.select("__id", F.expr("begin + a - p").alias("start"), F.expr("b - a").alias("length"), crc.alias("crc"), "tokens", sequence.alias("sequence"), offset.alias("offset"))
    out = full.union(kept).union(cut)
    return out.select(F.col("__id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), F.col("sequence").cast("bigint").alias("sequence_id"), F.col("offset").cast("bigint").alias("offset"))
