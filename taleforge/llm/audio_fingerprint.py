"""Media columns: chroma fingerprints of audio, and their alignment.

A WAV recording becomes frames of twelve pitch classes. Sixteen rectangular filters, summed with an integral
image, slide over the frames; each answer is quantised to two bits, so every step gives a packed 32-bit
integer. Two recordings are aligned by a histogram of the offsets at which halves of their integers
agree; the best offsets are judged by the share of differing bits where the recordings overlap.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleforge.llm.common import stash

RATE, FRAME, HOP = 5512, 2048, 683
LOWEST, HIGHEST = 60.0, 2000.0
#: The filters by rule: kind, first pitch class, classes, frames.
FILTERS = [(k % 5, 5 * k % 12, 4 + 2 * (k % 3), 4 + 2 * (k // 5)) for k in range(16)]
WIDEST = max(f[3] for f in FILTERS)
#: Answers are logarithms of ratios; the steps between the four quantised values.
STEP = 0.35
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Votes an offset needs, integers two recordings have to overlap by, and the share of differing bits allowed.
VOTES, OVERLAP, ERRORS = 3, 16, 0.3
#: Recordings of a block, and queries of one.
BLOCK, QUERIES = 4096, 4096
#: Queries of a block that are aligned at once.
ALIGNED = 256


def decode(data: bytes | None) -> np.ndarray:
    """Samples of a PCM WAV file as one channel at RATE, -1 to 1; nothing if it is null, empty or broken."""
    if not data:
        return np.zeros(0)
    try:
        with wave.open(io.BytesIO(data)) as file:
            width, channels, rate, raw = file.getsampwidth(), file.getnchannels(), file.getframerate(), file.readframes(file.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0)
    if width not in (1, 2, 3, 4) or not raw or not rate:
        return np.zeros(0)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 3:  # as the upper three bytes of four
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        raw, width = wide.tobytes(), 4
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(float)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(1)
    if rate != RATE and len(x):
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)
    return x


def encode(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes(np.clip(samples * 32767, -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


_FREQ = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = np.flatnonzero((_FREQ >= LOWEST) & (_FREQ <= HIGHEST))
_FOLD = np.zeros((len(_USED), 12))
_FOLD[np.arange(len(_USED)), np.round(12 * np.log2(_FREQ[_USED] / 440)).astype(int) % 12] = 1
_HANN = np.hanning(FRAME)


def chroma(x: np.ndarray) -> np.ndarray:
    """Pitch-class frames (frames, 12), each summing to 1, or all zero in silence."""
    if len(x) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = []
    for at in range(0, len(frames), 256):  # long recordings piece by piece
        power = np.abs(np.fft.rfft(frames[at : at + 256] * _HANN, axis=1)[:, _USED]) ** 2
        out.append(power @ _FOLD)
    out = np.concatenate(out)
    total = out.sum(1, keepdims=True)
    return np.where(total > 1e-6, out / np.maximum(total, 1e-12), 0.0)


def fingerprint(x: np.ndarray) -> np.ndarray:
    """Packed 32-bit integers of a recording: two Gray-coded bits of each filter at each step."""
    image = chroma(x)
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    ring = np.concatenate([image, image], axis=1)  # pitch classes go round
    total = np.zeros((len(image) + 1, 25))
    total[1:, 1:] = ring.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[t1 : t1 + n, p1] - total[t0 : t0 + n, p1] - total[t1 : t1 + n, p0] + total[t0 : t0 + n, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, high, wide in FILTERS:
        q, t = p + high, wide
        if kind == 0:  # these classes against all
            a, b = area(0, t, p, q), area(0, t, 0, 12) * high / 12
        elif kind == 1:  # lower half against upper half
            a, b = area(0, t, p, p + high // 2), area(0, t, p + high // 2, q)
        elif kind == 2:  # earlier half against later half
            a, b = area(0, t // 2, p, q), area(t // 2, t, p, q)
        elif kind == 3:  # one diagonal against the other
            a = area(0, t // 2, p, p + high // 2) + area(t // 2, t, p + high // 2, q)
            b = area(0, t // 2, p + high // 2, q) + area(t // 2, t, p, p + high // 2)
        else:  # the middle classes against the outer ones
            third = high // 3
            a, b = area(0, t, p + third, q - third), area(0, t, p, p + third) + area(0, t, q - third, q)
        answer = np.log((a + 0.02) / (b + 0.02))
        out = out << np.uint32(2) | GRAY[np.searchsorted([-STEP, 0.0, STEP], answer)]
    return out


def starts(codes: np.ndarray) -> np.ndarray:
    """Steps at which the integer changes: a held sound votes once."""
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where a, moved by offset, overlaps b; and the integers compared."""
    lo, hi = max(0, offset), min(len(b), len(a) + offset)
    if hi - lo <= 0:
        return 1.0, 0
    return float(np.bitwise_count(a[lo - offset : hi - offset] ^ b[lo:hi]).sum()) / (32 * (hi - lo)), hi - lo


def align(queries: list[np.ndarray], recordings: list[np.ndarray]) -> list[tuple[int, int, int, float, int]]:
    """(query, recording, offset, bit error, integers) of each pair that aligns: its best offset."""

    def keys(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = [starts(c) for c in codes]
        owner, step = np.repeat(np.arange(len(codes)), [len(x) for x in at]), np.concatenate([np.zeros(0, np.int64), *at])
        code = np.concatenate([np.zeros(0, np.uint32), *(c[x] for c, x in zip(codes, at, strict=True))])
        return np.concatenate([code >> np.uint32(16), (code & np.uint32(0xFFFF)) + np.uint32(1 << 16)]), np.tile(owner, 2), np.tile(step, 2)

    qk, qo, qs = keys(queries)
    rk, ro, rs = keys(recordings)
    order = np.argsort(rk, kind="stable")
    rk, ro, rs = rk[order], ro[order], rs[order]
    first, last = np.searchsorted(rk, qk, "left"), np.searchsorted(rk, qk, "right")
    votes: list[np.ndarray] = []
    at = 0
    while at < len(qk):  # some millions of votes at a time, whole queries together
        to = at + 1
        room = int(last[at] - first[at])
        while to < len(qk) and room < 2_000_000:
            room += int(last[to] - first[to])
            to += 1
        n = last[at:to] - first[at:to]
        k = np.repeat(first[at:to] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pair = (np.repeat(qo[at:to], n) * len(recordings) + ro[k]) * (1 << 24) + (rs[k] - np.repeat(qs[at:to], n)) + (1 << 23)
        names, count = np.unique(pair, return_counts=True)
        votes.append(np.stack([names, count], 1))
        at = to
    if not votes:
        return []
    every = np.concatenate(votes)
    names, back = np.unique(every[:, 0], return_inverse=True)
    count = np.bincount(back, every[:, 1]).astype(int)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for name in names[count >= VOTES].tolist():
        pair, offset = divmod(name, 1 << 24)
        q, r = divmod(pair, len(recordings))
        error, n = bit_error(queries[q], recordings[r], offset - (1 << 23))
        if n >= OVERLAP and error <= ERRORS and (error, -n, offset) < best.get((q, r), (2.0, 0, 0)):
            best[q, r] = (error, -n, offset)
    return [(q, r, offset - (1 << 23), error, -n) for (q, r), (error, n, offset) in sorted(best.items())]


def fingerprints(media: DataFrame, *, id_col: str = "id", wav_col: str = "wav", name: str = "audio") -> DataFrame:
    """(id, codes: little-endian 32-bit integers, n_codes) of every row; null, broken and very short recordings have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [fingerprint(decode(x.as_py())) for x in b.column("wav")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([c.astype("<u4").tobytes() for c in codes], pa.binary()), pa.array([len(c) for c in codes], pa.int64())], names=["id", "codes", "n_codes"])

    return media.select(F.col(id_col).cast("bigint").alias("id"), F.col(wav_col).alias("wav")).mapInArrow(run, "id bigint, codes binary, n_codes bigint")


def alignments(queries: DataFrame, recordings: DataFrame, *, name: str = "audio") -> DataFrame:
    """(query_id, match_id, offset, bit_error, overlap) of all pairs that align; both inputs as from fingerprints().

    offset: steps by which the query begins after the recording. The queries are a stated set; blocks of them
    meet blocks of recordings.
    """

    def blocks(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, size):
                    own = b.slice(at, size)
                    yield pa.RecordBatch.from_arrays([pa.array([own.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([own.column("codes").to_pylist()], pa.list_(pa.binary()))], names=["ids", "codes"])

        return run

    kind = "ids array<bigint>, codes array<binary>"
    asked = stash(queries.where("n_codes > 0").select("id", "codes").mapInArrow(blocks(QUERIES), kind).withColumn("ask", F.monotonically_increasing_id()), f"{name}-queries")
    names = [r.ask for r in asked.select("ask").collect()]  # one number a block
    if not names:
        return queries.sparkSession.createDataFrame([], "query_id bigint, match_id bigint, offset int, bit_error double, overlap int")
    held = recordings.where("n_codes > 0").select("id", "codes").mapInArrow(blocks(BLOCK), kind)
    meet = held.toDF("rids", "rcodes").withColumn("ask", F.explode(F.split(F.lit(",".join(map(str, names))), ",").cast("array<bigint>"))).join(asked, "ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q, r = ([np.frombuffer(c, "<u4") for c in row[k]] for k in ("codes", "rcodes"))
                found = [(row["ids"][at + i], row["rids"][j], offset, error, n) for at in range(0, len(q), ALIGNED) for i, j, offset, error, n in align(q[at : at + ALIGNED], r)]
                frame = pd.DataFrame(found, columns=["query_id", "match_id", "offset", "bit_error", "overlap"]).astype({"query_id": "int64", "match_id": "int64", "offset": "int32", "bit_error": "float64", "overlap": "int32"})
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return meet.mapInArrow(run, "query_id bigint, match_id bigint, offset int, bit_error double, overlap int")


NOTE = 0.125


def melody(vector: list[float] | None, *, skip: float = 0.0, noise: float = 0.0) -> bytes | None:
    """A vector played as a WAV recording: one note for each component, its pitch by the component's rank.

    Null, empty and non-finite vectors are no recording. skip: seconds left out at the start; noise: level of
    a hiss that depends on the vector alone.
    """
    if not vector or any(x is None for x in vector) or not np.isfinite(vector).all():
        return None
    rank = np.argsort(np.argsort(vector, kind="stable"), kind="stable")
    pitch = 45 + rank % 36
    t = np.arange(int(NOTE * RATE)) / RATE
    step = 2 * np.pi * 440 * 2.0 ** ((pitch - 69) / 12)
    x = 0.5 * np.sin(step[:, None] * t).ravel()
    x = x + 0.2 * np.sin(2 * step[:, None] * t).ravel()
    if noise:
        seed = zlib.crc32(np.asarray(vector, "<f8").tobytes())
        x = 0.7 * x + noise * np.random.default_rng(seed).standard_normal(len(x))
    return encode(x[int(skip * RATE) :])


def recordings(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(id, wav): the vectors as recordings; with ``queries``, only those rows, as noisy excerpts that begin two seconds in."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")) if queries is None else vectors.where(queries).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    skip, noise = (0.0, 0.0) if queries is None else (2.0, 0.02)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):  # a recording is some 90 kB
                own = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([own.column("id"), pa.array([melody(v, skip=skip, noise=noise) for v in own.column("v").to_pylist()], pa.binary())], names=["id", "wav"])

    return rows.mapInArrow(run, "id bigint, wav binary")
