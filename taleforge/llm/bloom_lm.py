"""Language-model scores from a log-frequency Bloom filter.

Word and word-pair counts of all training texts are summed in slots by hash. Each count is quantised on a
roughly geometric scale of levels; a gram of level q is put into the filter q times, once with each level
up to q. A count is read back by probing level after level until one is missing. The filter is made in
segments where their grams meet, each with bits in proportion to what is put into it, and is broadcast in parts
of bounded size; where there are several, a worker holds one at a time.
The model mixes the pair's share of its context with the smoothed word probability; the weights, one for
each context level, are fitted on all training texts by leaving each pair's own occurrence out.

The add-one base score needs exact word counts. Frequent words (a bounded number) are broadcast;
the others are looked up by a shuffle on the word's slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleforge.llm.common import binaries, mix, packed_groups, rebatched, shuffle_width, stash, text_bytes, word_hashes

#: Bits of the filter at least (64 MB), and for each bit that is set (a segment's width is the next power of two).
FILTER_BITS = 1 << 29
ROOM = 4
#: Bytes of the filter that a worker holds at once, give or take a segment.
PART_BYTES = 64 << 20
PROBES = 2
#: Words whose exact counts are broadcast at most (16 bytes each).
FREQUENT = 1 << 20
#: Grams that a task holds before it sends them on.
HELD = 4_000_000
WEIGHTS = np.array([0.0, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
END, BEGIN = np.uint64(0xE4D0_0000_0000_0001), np.uint64(0xBE61_0000_0000_0001)


def thresholds(most: int = 1 << 40) -> np.ndarray:
    """The least count of each level: steps of one, later of a fifth."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 6 // 5))
    return np.array(out, np.int64)


LEVELS = thresholds()


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


def low(levels: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(levels > 0, LEVELS[np.maximum(levels, 1) - 1], 0)


def high(levels: np.ndarray) -> np.ndarray:
    """The largest count of a level; 0 for level 0."""
    return np.where(levels > 0, LEVELS[levels] - 1, 0)


def word_gram(words: np.ndarray) -> np.ndarray:
    return mix(words ^ np.uint64(0x1A57))


def pair_gram(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first + np.uint64(0x9A13)) * np.uint64(3) + second)


def positions(rest: np.ndarray, at: int | np.ndarray, probe: int, bits: int | np.ndarray) -> np.ndarray:
    """The bit of one probe for a gram's low half at a level, within its segment."""
    h = mix(rest + (np.uint64(1) << np.uint64(40)) * np.asarray(at, np.uint64) + (np.uint64(1) << np.uint64(56)) * np.uint64(probe))
    return (h & np.asarray(bits - 1, np.uint64)).astype(np.int64)


@dataclass(frozen=True)
class Filter:
    """bits: the whole filter or a part of it, little bit first; segments: a power of two. base, width: first bit and
    bits of each segment; without them all are equally wide."""

    bits: np.ndarray
    segments: int
    base: np.ndarray | None = None
    width: np.ndarray | None = None

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The level of each gram by probes of rising level; never below the true one."""
        owner = segment_of(grams, self.segments)
        even = len(self.bits) * 8 // self.segments
        base = owner * even if self.base is None else self.base[owner]
        width = None if self.width is None else self.width[owner]
        rest = grams & np.uint64(0xFFFFFFFF)
        out = np.zeros(len(grams), np.int64)
        live = np.arange(len(grams))
        at = 0
        while len(live) and at < len(LEVELS) - 1:
            at += 1
            for k in range(PROBES):
                where = base[live] + positions(rest[live], at, k, even if width is None else width[live])
                live = live[(self.bits[where >> 3] >> (where & 7).astype(np.uint8)) & 1 == 1]
            out[live] = at
        return out


@dataclass(frozen=True)
class Parts:
    """A filter in broadcast parts; owner: the part of each segment."""

    held: list[Broadcast]
    owner: np.ndarray

    def levels(self, grams: np.ndarray) -> np.ndarray:
        if len(self.held) == 1:
            return self.held[0].value.levels(grams)
        part, out = self.owner[segment_of(grams, len(self.owner))], np.zeros(len(grams), np.int64)
        for p, b in enumerate(self.held):
            mine = np.flatnonzero(part == p)
            if len(mine):
                out[mine] = b.value.levels(grams[mine])
                if hasattr(b, "_path"):  # read from the worker's disk when it is next asked for
                    b.__dict__.pop("_value", None)
        return out


def segment_of(grams: np.ndarray, segments: int) -> np.ndarray:
    return (grams >> np.uint64(64 - segments.bit_length() + 1)).astype(np.int64)


def segment_width(counts: np.ndarray, least: int) -> int:
    """Bits of a segment that holds grams with these counts: a power of two."""
    return max(least, 1 << (ROOM * PROBES * int(level(counts).sum()) - 1).bit_length() if len(counts) else 0)


def segment_bits(rest: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """The packed bits of one segment that holds the grams with these counts."""
    out = np.zeros(bits, np.uint8)
    live, at = level(counts), 0
    while len(rest):
        at += 1
        for k in range(PROBES):
            out[positions(rest, at, k, bits)] = 1
        keep = live > at
        rest, live = rest[keep], live[keep]
    return np.packbits(out, bitorder="little")


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def stream(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows (words, then END), the token before each (BEGIN at first), and offsets of the rows."""
    words, first = word_hashes(raw, offsets)
    rows = len(first) - 1
    out = np.insert(words, first[1:], END)
    starts = first + np.arange(rows + 1)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[starts[:-1]] = BEGIN
    return out, before, starts


def _count(train: DataFrame, text: str, segments: int, slots: int) -> DataFrame:
    """Partial counts (kind, slot, keys, counts): kind 0 exact words by slot, kind 1 grams by segment of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        size = total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                if not parts:
                    continue
                keys, counts = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts.clear()
                n = segments if kind else slots
                names, firsts, seconds = [], [], []
                for slot, (k, c) in packed_groups((keys >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64), [keys, counts]):
                    names.append(slot)
                    firsts.append((k.astype(np.uint32) if kind else k).tobytes())
                    seconds.append(c.astype(np.uint32).tobytes())
                for a in range(0, len(names), 64):
                    b = a + 64
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(names[a:b]), pa.int32()), pa.array(names[a:b], pa.int32()), pa.array(firsts[a:b], pa.binary()), pa.array(seconds[a:b], pa.binary())], names=["kind", "slot", "keys", "counts"])

        for batch in rebatched(batches, text):
            tokens, before, starts = stream(*text_bytes(batch.column(text)))
            words, n = np.unique(tokens, return_counts=True)
            context = np.array([len(starts) - 1], np.int64)
            pairs, m = np.unique(pair_gram(before, tokens), return_counts=True)
            held[0].append((words, n))
            held[1] += [(word_gram(words), n), (word_gram(np.array([BEGIN])), context), (pairs, m)]
            size, total = size + len(pairs), total + len(tokens)
            if size > HELD or total >= 1 << 31:  # a partial count fits 32 bits; the sums have 64
                yield from flush()
                size = total = 0
        yield from flush()

    return train.mapInArrow(run, "kind int, slot int, keys binary, counts binary")


def _merge(parts: DataFrame, segments: int) -> DataFrame:
    """One row for each kind and slot: words with their counts, or a segment's bits."""
    least = FILTER_BITS // segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, keys, counts = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if name is not None:
                k, c = summed(np.concatenate(keys), np.concatenate(counts))
                data = (segment_bits(k, c, segment_width(c, least)).tobytes(), b"") if name[0] else (k.tobytes(), c.astype(np.uint64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int32()), pa.array([name[1]], pa.int32()), pa.array([data[0]], pa.binary()), pa.array([data[1]], pa.binary())], names=["kind", "slot", "keys", "counts"])

        for b in batches:
            for kind, slot, k, c in zip(*(b.column(x) for x in ("kind", "slot", "keys", "counts")), strict=True):
                if (kind.as_py(), slot.as_py()) != name:
                    yield from close()
                    name, keys, counts = (kind.as_py(), slot.as_py()), [], []
                keys.append(np.frombuffer(k.as_buffer(), np.uint32 if name[0] else np.uint64).astype(np.uint64))
                counts.append(np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64))
        yield from close()

    n = max(2 * shuffle_width(parts.sparkSession), segments // 64)
    return parts.repartition(n, "kind", "slot").sortWithinPartitions("kind", "slot").mapInArrow(run, "kind int, slot int, keys binary, counts binary")


def _sizes(words: DataFrame) -> np.ndarray:
    """Of each count level: distinct words and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LEVELS) + 1, 2))
        for b in batches:
            for c in b.column("counts"):
                c = np.frombuffer(c.as_buffer(), np.uint64).astype(np.int64)
                q = level(c)
                total[:, 0] += np.bincount(q, minlength=len(total))
                total[:, 1] += np.bincount(q, c, len(total))
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at, 0]), pa.array(total[at, 1])], names=["q", "words", "tokens"])

    out = np.zeros((len(LEVELS) + 1, 2))
    for r in words.mapInArrow(run, "q bigint, words double, tokens double").groupBy("q").agg(F.sum("words").alias("w"), F.sum("tokens").alias("t")).collect():
        out[r.q] = r.w, r.t
    return out


def _frequent(words: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of a count of least or more; the caller has bounded their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column("keys"), b.column("counts"), strict=True):
                k, c = np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint64)
                keep = c >= least
                yield pa.RecordBatch.from_arrays([pa.array([k[keep].tobytes()], pa.binary()), pa.array([c[keep].tobytes()], pa.binary())], names=["k", "c"])

    got = [(np.frombuffer(r.k, np.uint64), np.frombuffer(r.c, np.uint64)) for r in words.mapInArrow(run, "k binary, c binary").toLocalIterator()]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    keys, counts = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(keys)
    return keys[order], counts[order]


def _broadcast(merged: DataFrame, segments: int) -> Parts:
    """The filter's segments in parts; the driver holds one part at a time."""
    spark = merged.sparkSession
    sizes = np.full(segments, FILTER_BITS // segments // 8, np.int64)
    for r in merged.where("kind = 1").select("slot", F.length("keys").alias("n")).collect():  # one row a segment
        sizes[r.slot] = r.n
    start = np.cumsum(sizes) - sizes
    owner = (start // PART_BYTES).astype(np.int32)
    owner = np.unique(owner, return_inverse=True)[1].astype(np.int32)
    held = []
    for p in range(int(owner[-1]) + 1):
        first, last = np.flatnonzero(owner == p)[[0, -1]].tolist()
        bits = np.zeros(int(sizes[first : last + 1].sum()), np.uint8)
        for r in merged.where((F.col("kind") == 1) & F.col("slot").between(first, last)).select("slot", "keys").toLocalIterator():
            at = int(start[r.slot] - start[first])
            bits[at : at + len(r.keys)] = np.frombuffer(r.keys, np.uint8)
        held.append(spark.sparkContext.broadcast(Filter(bits, segments, 8 * (start - start[first]), 8 * sizes)))
    return Parts(held, owner)


@dataclass(frozen=True)
class Model:
    filter: Filter | Parts
    tokens: int
    distinct: int
    weights: np.ndarray  # by level of the context

    def read(self, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: the levels of its pair, of its word and of its context."""
        names, at = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        pairs, back = np.unique(pair_gram(before, tokens), return_inverse=True)
        levels = self.filter.levels(np.concatenate([word_gram(names), pairs]))
        word, context = levels[at[: len(tokens)]], levels[at[len(tokens) :]]
        return np.minimum(np.minimum(levels[len(names) :][back], word), context), word, context

    def parts(self, both: np.ndarray, word: np.ndarray, context: np.ndarray, own: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """By levels: the pair's share of its context and the word's probability. own: occurrences to leave out."""
        middle = np.maximum((low(word) + high(word)) / 2 - own, 0)
        share = np.maximum(low(both) - own, 0) / np.maximum(high(context) - own, 1)
        return np.minimum(share, 1.0), (middle + 1) / (self.tokens + self.distinct + 1)

    def logs(self, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token, and whether its word can be known."""
        both, word, context = self.read(tokens, before)
        share, alone = self.parts(both, word, context)
        weight = np.where(context > 0, self.weights[context], 0.0)
        return np.log10(np.minimum(weight * share + (1 - weight) * alone, 1.0)), word > 0


def _weights(train: DataFrame, text: str, model: Model) -> np.ndarray:
    """For each context level the mixture weight that suits all training texts best, each token's own occurrence left out.

    Tokens of equal levels weigh alike: they are counted first, and the logarithms taken once for all of them.
    """
    n = len(LEVELS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in rebatched(batches, text):
            tokens, before, _ = stream(*text_bytes(batch.column(text)))
            both, word, context = model.read(tokens, before)
            names, more = np.unique((both * n + word) * n + context, return_counts=True)
            keys, counts = summed(np.concatenate([keys, names]), np.concatenate([counts, more]))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, times = (b.column(x).to_numpy() for x in ("key", "n"))
            share, alone = model.parts(key // n // n, key // n % n, key % n, own=1)
            total = np.stack([np.bincount(key % n, times * np.log(w * share + (1 - w) * alone), n) for w in WEIGHTS], 1)
            q, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(k), pa.array(total[q, k])], names=["q", "k", "s"])

    out = np.zeros((n, len(WEIGHTS)))
    counted = train.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    for r in counted.mapInArrow(logs, "q bigint, k bigint, s double").groupBy("q", "k").agg(F.sum("s").alias("s")).collect():
        out[r.q, r.k] = r.s
    return WEIGHTS[out.argmax(1)]


def score(docs: DataFrame, *, train: Column, id_col: str = "doc_id", text_col: str = "text", name: str = "bloom") -> DataFrame:
    """(id_col, trained, n_tokens, n_known, train_tokens, base_score, score) of every row; the model learns where ``train`` holds.

    Words: runs of bytes other than ASCII white space, A-Z lower-cased; a text ends with one end token, so null
    and empty texts have one token. Rows where ``train`` is null are not learned from. Without training
    tokens both scores are 0. Repeated rows and null ids are scored, and learned from, row by row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias(text_col), F.coalesce(train, F.lit(False)).alias("__train"))
    learned = docs.where("__train").select("__id", text_col)
    total = learned.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    grams = (total[1] or 0) // 6
    segments = 1 << max(8, min(17, (grams // 2_000_000).bit_length()))
    slots = 1 << max(3, (grams // 16_000_000).bit_length())
    merged = stash(_merge(_count(learned, text_col, segments, slots), segments), f"{name}-merged")
    words = merged.where("kind = 0")

    sizes = _sizes(words)
    above = np.cumsum(sizes[::-1, 0])[::-1]  # words of a level or a higher one
    cut = int(np.argmax(above <= FREQUENT))
    hot = _frequent(words, int(LEVELS[cut - 1]) if cut else 1)
    model = Model(_broadcast(merged, segments), int(sizes[:, 1].sum()), int(sizes[:, 0].sum()), np.zeros(len(LEVELS) + 1))
    known = replace(model, weights=_weights(learned, text_col, model))
    shared = spark.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        keys, counts = shared.value
        logs = np.log10(counts.astype(float) + 1)
        for batch in rebatched(batches, text_col):
            tokens, before, starts = stream(*text_bytes(batch.column(text_col)))
            own, may = known.logs(tokens, before)
            at = np.minimum(np.searchsorted(keys, tokens), max(len(keys) - 1, 0))
            there = keys[at] == tokens if len(keys) else np.zeros(len(tokens), bool)
            rare = may & ~there  # a word that the filter lacks was never seen
            left = np.concatenate([[0], np.cumsum(rare)])[starts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id"), batch.column("__train"), pa.array((part << 40) + row + np.arange(batch.num_rows)), pa.array(np.diff(starts)),
                    pa.array(np.add.reduceat(there.astype(np.int64), starts[:-1])), pa.array(np.add.reduceat(np.where(there, logs[at] if len(keys) else 0.0, 0.0), starts[:-1])),
                    pa.array(np.add.reduceat(own, starts[:-1])), binaries(tokens[rare], left),
                ],
                names=["id", "trained", "row", "n", "seen", "base", "score", "rare"],
            )
            row += batch.num_rows

    id_type = docs.schema["__id"].dataType.simpleString()
    scored = stash(docs.mapInArrow(run, f"id {id_type}, trained boolean, row bigint, n bigint, seen bigint, base double, score double, rare binary"), f"{name}-scored")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("rare")]
            keys, rows = np.concatenate(got), np.repeat(b.column("row").to_numpy(), [len(x) for x in got])
            for slot, (k, r) in packed_groups((keys >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64), [keys, rows]):
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([slot], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([r.tobytes()], pa.binary())], names=["kind", "slot", "keys", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, keys, counts = None, np.zeros(0, np.uint64), np.zeros(0)
        for b in batches:
            for kind, slot, k, c in zip(*(b.column(x) for x in ("kind", "slot", "keys", "counts")), strict=True):
                if kind.as_py() == 0:
                    name, keys, counts = slot.as_py(), np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint64).astype(float)
                elif name == slot.as_py() and len(keys):
                    asked, rows = np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    hit = keys[at] == asked
                    names, back = np.unique(rows[hit], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(back, minlength=len(names))), pa.array(np.bincount(back, np.log10(counts[at[hit]] + 1), len(names)))], names=["row", "more", "part"])

    asked = scored.where("length(rare) > 0").select("row", "rare").mapInArrow(ask, "kind int, slot int, keys binary, counts binary")
    met = words.union(asked).repartition(max(slots, shuffle_width(spark)), "slot").sortWithinPartitions("slot", "kind").mapInArrow(answer, "row bigint, more bigint, part double")
    found = met.groupBy("row").agg(F.sum("more").alias("more"), F.sum("part").alias("part"))
    whole = float(np.log10(model.tokens + model.distinct + 1))
    out = scored.drop("rare").join(found, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "trained", F.col("n").alias("n_tokens"), (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("part", F.lit(0.0)) - F.col("n") * whole).alias("base_score"), "score",
    )
