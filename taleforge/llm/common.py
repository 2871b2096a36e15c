"""Shared pieces of the corpus operators: tables in the shared folder, bounded broadcasts, vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text hashed at once; bounds the scratch arrays of a task.
BLOCK_BYTES = 512 << 10

#: Fixed value: ASCII white space, as in ``[^\x20\x09-\x0D]+``.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_GEN = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _GEN.integers(1, 2**63, size=256, dtype=np.uint64)
#: Random 64-bit word of each byte, with A-Z as a-z.
_LOWERED = _BYTE.copy()
_LOWERED[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = []
#: What a worker keeps between tasks: the tables of one operator.
_HELD: dict[str, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where it is unset, as in tests on one machine, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="taleforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/taleforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go() -> None:
    """Drop what the worker keeps, and give its free memory back to the system (where the allocators can)."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def held(key: str, make: Callable[[], Any]) -> Any:
    """What make() returns, kept by the worker until a task of another operator begins."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _UNBASE)]
    return _POWERS[0], _POWERS[1]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = column.cast(pa.large_string())
    offsets = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset : large.offset + len(large) + 1] if len(large) else np.zeros(1, np.int64)
    data = large.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _block(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of raw; cuts: offsets at which a word also ends."""
    solid = ~WHITE[raw]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[cuts[cuts < len(raw)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    power, unpower = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWERED[raw] * power[: len(raw)], out=total[1:])
    hashes = (total[ends] - total[starts]) * unpower[starts] + (ends - starts).astype(np.uint64)
    return starts, ends, mix(hashes)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased, split at ASCII white space), and the first word of each row."""
    found, counts, n = [], np.zeros(len(offsets), np.int64), len(raw)
    at = 0
    while at < n:
        to = min(n, at + BLOCK_BYTES)
        if to < n:  # end at a row's end or else at white space, so that no word is cut
            row = int(offsets[np.searchsorted(offsets, to, side="right") - 1])
            if row > at:
                to = row
            else:
                limit = int(offsets[np.searchsorted(offsets, to, side="left")])
                while to < limit and not WHITE[raw[to]]:
                    to += 1
        lo, hi = np.searchsorted(offsets, at, side="left"), np.searchsorted(offsets, to, side="right")
        starts, _, hashes = _block(raw[at:to], offsets[lo:hi] - at)
        found.append(hashes)
        # rows that begin in this block: words before them
        counts += np.searchsorted(starts + at, np.clip(offsets, at, to), side="left")
        at = to
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words in each row (a row of fewer words, but some: all of it as one), and their offsets."""
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(first[:-1] - out[:-1], made)  # first word of each shingle
    last = np.repeat(first[1:], made)
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            there = at + k < last
            word = words[np.minimum(at + k, len(words) - 1)]
            total = mix(total * np.uint64(0xD6E8FEB86659FD93) + np.where(there, word, np.uint64(k + 1)))
    return total, out


def distinct_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, values.dtype)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose rows are slices of values."""
    width = values.dtype.itemsize
    data = np.ascontiguousarray(values).view(np.uint8)
    if offsets[-1] * width < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32).tobytes()), pa.py_buffer(data)])
    raise ValueError("a batch holds more than 2 GB of packed values")


def packed_groups(slots: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of columns by slot, as (slot, columns)."""
    order = np.argsort(slots, kind="stable")
    slots = slots[order]
    cuts = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else []
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, [*cuts[1:], len(slots)], strict=True):
        yield int(slots[a]), [c[a:b] for c in columns]


def rebatched(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of the text column at most (a longer row stands alone)."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
