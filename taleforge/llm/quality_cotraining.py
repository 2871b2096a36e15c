"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

Both start from the labelled rows. In every round each adds the unlabelled rows it is surest of to the
other's training rows. At the end both are calibrated on labelled rows they were not trained on, and the
calibrated views are combined; all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from taleforge.llm.common import WHITE, distinct_by_row, let_go, rebatched, text_bytes, word_hashes

#: Labelled and unlabelled rows that are fitted on at most.
LABELLED, UNLABELLED = 8000, 8000
ROUNDS = 4
#: Rows that a view hands over in a round at most, of each class, and how sure it has to be.
HANDED, SURE = 400, 0.95
HASHED = 64
SOURCES = 32
#: Bytes of text whose features are made at once: the scratch arrays hold some forty times as many.
TEXT_BYTES = 1 << 20

_CLASS = np.full(256, 5, np.uint8)  # of a byte: 0 lower, 1 upper, 2 digit, 3 white, 4 plain marks, 5 other marks, 6 beyond ASCII
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[WHITE], _CLASS[128:] = 0, 1, 2, 3, 6
_CLASS[[ord(c) for c in ".,'-\""]] = 4


def text_view(column: pa.Array) -> np.ndarray:
    """Features of whole texts: shares of character classes, word lengths, repetition, hashed words."""
    raw, offsets = text_bytes(column)
    n, length = len(column), np.diff(offsets)
    size = np.maximum(length, 1)[:, None].astype(float)
    rows = np.repeat(np.arange(n), length)
    kind = _CLASS[raw]
    shares = np.bincount(rows * 7 + kind, minlength=7 * n).reshape(n, 7) / size
    marks = np.bincount(rows, (raw == 0x21) | (raw == 0x3F), n)[:, None] / size
    pipes = np.bincount(rows, raw == 0x7C, n)[:, None] / size
    same = np.zeros(len(raw), bool)
    same[1:] = (raw[1:] == raw[:-1]) & (kind[1:] >= 5) & (rows[1:] == rows[:-1])
    runs = np.bincount(rows, same, n)[:, None] / size
    lines = np.bincount(rows, raw == 0x0A, n)[:, None] / size
    words, first = word_hashes(raw, offsets)
    count = np.diff(first)
    some = np.maximum(count, 1)[:, None].astype(float)
    _, distinct = distinct_by_row(words, first)
    owner = np.repeat(np.arange(n), count)
    next_same = np.zeros(len(words), bool)
    next_same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    bucket = (words >> np.uint64(58)).astype(np.int64)
    hashed = np.sqrt(np.bincount(owner * HASHED + bucket, minlength=n * HASHED).reshape(n, HASHED) / some)
    dense = [shares, marks, pipes, runs, lines, np.log1p(count)[:, None], (length / some[:, 0])[:, None] / 10, np.diff(distinct)[:, None] / some, np.bincount(owner, next_same, n)[:, None] / some, (count == 0)[:, None].astype(float)]
    return np.concatenate([*dense, hashed], axis=1)


def page_view(lang: list, source: list, n_chars: np.ndarray) -> np.ndarray:
    """Features of the metadata: declared length, hashed language and source; nulls have buckets of their own."""
    n = len(lang)
    out = np.zeros((n, 2 + 2 * SOURCES))
    chars = np.nan_to_num(np.asarray(n_chars, float), nan=0.0)
    out[:, 0], out[:, 1] = np.log1p(np.maximum(chars, 0)), np.isnan(np.asarray(n_chars, float))
    for at, values in ((2, lang), (2 + SOURCES, source)):
        for i, v in enumerate(values):
            out[i, at + (_bucket(v) if v is not None else 0)] = 1
    return out


def _bucket(value: str) -> int:
    h = 2166136261
    for b in value.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return 1 + (h >> 8) % (SOURCES - 1)


@dataclass(frozen=True)
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weight + self.bias, -30, 30)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> Linear:
    """Logistic regression by Newton steps, features standardised, the bias free."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    ridge = np.diag([penalty] * (len(w) - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Linear(mean, scale, w[:-1], float(w[-1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass(frozen=True)
class CoTrained:
    """The two views, their calibration, their combination, and the score from which a document is kept."""

    text: Linear
    page: Linear
    calibration: tuple[Linear, Linear]
    combination: Linear
    threshold: float
    handed: tuple[int, int]

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.calibration[0].logit(self.text.logit(text)[:, None])
        b = self.calibration[1].logit(self.page.logit(page)[:, None])
        return sigmoid(a), sigmoid(b), sigmoid(self.combination.logit(np.stack([a, b], 1)))


def co_train(text: np.ndarray, page: np.ndarray, label: np.ndarray, more_text: np.ndarray, more_page: np.ndarray, *, rounds: int = ROUNDS, handed: int = HANDED, sure: float = SURE, threshold: float = 0.5) -> CoTrained:
    """label: 0 or 1 of the first two; the other two are unlabelled. Every fourth labelled row is held back for calibration."""
    back = np.arange(len(label)) % 4 == 3
    if len(set(label[back].tolist())) < 2:
        back = np.zeros(len(label), bool)
    own = ~back
    known = {"text": (text[own], label[own]), "page": (page[own], label[own])}
    views = {"text": more_text, "page": more_page}
    free = {"text": np.ones(len(more_text), bool), "page": np.ones(len(more_page), bool)}  # rows the view has not been taught
    given = {"text": 0, "page": 0}
    at = back if back.any() else own
    held = {"text": text[at], "page": page[at]}
    models = {}
    for turn in range(rounds + 1):
        models = {k: logistic(*known[k]) for k in known}
        if turn == rounds or not len(more_text):
            break
        taught = {}
        for teacher, pupil in (("text", "page"), ("page", "text")):
            # how sure a view may be shows on the labelled rows held back: a weak view teaches nothing
            trust = logistic(models[teacher].logit(held[teacher])[:, None], label[at])
            p = sigmoid(trust.logit(models[teacher].logit(views[teacher])[:, None]))
            picked = []
            for score in (p, 1 - p):
                some = np.flatnonzero((score >= sure) & free[pupil])
                picked.append(some[np.argsort(-score[some], kind="stable")[:handed]])
            rows = np.concatenate(picked)
            taught[pupil] = (rows, (p[rows] >= 0.5).astype(float))
        if not any(len(rows) for rows, _ in taught.values()):
            break
        for pupil, (rows, y) in taught.items():
            free[pupil][rows] = False
            given[pupil] += len(rows)
            known[pupil] = (np.concatenate([known[pupil][0], views[pupil][rows]]), np.concatenate([known[pupil][1], y]))
    a, b, y = models["text"].logit(text[at]), models["page"].logit(page[at]), label[at]
    calibration = (logistic(a[:, None], y), logistic(b[:, None], y))
    both = np.stack([calibration[0].logit(a[:, None]), calibration[1].logit(b[:, None])], 1)
    return CoTrained(models["text"], models["page"], calibration, logistic(both, y), threshold, (given["text"], given["page"]))


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in rebatched(batches, "text", TEXT_BYTES):
            t = text_view(batch.column("text"))
            p = page_view(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes() for x in t], pa.binary()), pa.array([x.astype(np.float32).tobytes() for x in p], pa.binary()), batch.column("y")], names=["t", "p", "y"])

    return docs.select("text", "lang", "source", "n_chars", "y").mapInArrow(run, "t binary, p binary, y double")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> CoTrained | None:
    """Fit on at most about ``labelled`` and ``unlabelled`` rows chosen by a hash of the id; only their features reach the driver.

    Null ids and null labels teach nothing; of labels that repeat an id the largest counts. None without labels.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("y"))
    n, m = marks.count(), docs.count()
    if not n or not m:
        return None
    spot = F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(1 << 40)) / (1 << 40)
    some = marks.where(spot < labelled / n).withColumn("__labelled", F.lit(True))
    # rows of the hash range that feeds the unlabelled sample, and the sampled labels: few enough to broadcast
    rows = docs.select(id_col, "text", "lang", "source", "n_chars").join(F.broadcast(some), id_col, "left")
    rows = rows.where("__labelled or " + f"pmod(xxhash64({id_col}, 3), {1 << 40}) / {1 << 40} >= {1 - min(1.0, unlabelled / m)!r}")
    got = _features(rows.drop("__labelled")).toPandas()
    t, p = (np.array([np.frombuffer(x, np.float32) for x in got[c]], float).reshape(len(got), -1) for c in "tp")
    y = got["y"].to_numpy(float)
    order = np.lexsort([*t.T[:8], *p.T[:2]])  # the same whatever order the rows came in
    t, p, y = t[order], p[order], y[order]
    known = ~np.isnan(y)
    if len(set(y[known].tolist())) < 2:
        return None
    return co_train(t[known], p[known], y[known], t[~known], p[~known])


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """docs with p_text, p_page, quality_score (0 to 1) and keep; without a model all scores are null and all rows are kept.

    Null texts count as empty; null metadata has its own place among the features. Columns of those four
    names are replaced, all others pass through unread (text, lang, source and n_chars are read).
    """
    added = ["p_text", "p_page", "quality_score", "keep"]
    docs = docs.drop(*added)
    if model is None:
        return docs.withColumns({c: F.lit(None).cast("double") for c in added[:3]}).withColumn("keep", F.lit(True))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        let_go()
        for batch in rebatched(batches, "text", TEXT_BYTES):
            t = text_view(batch.column("text")).astype(np.float32).astype(float)
            p = page_view(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.float32).astype(float)
            a, b, both = known.scores(t, p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a), pa.array(b), pa.array(both), pa.array(both >= known.threshold)], names=[*names, *added])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(c, DoubleType()) for c in added[:3]), StructField("keep", BooleanType())]))
