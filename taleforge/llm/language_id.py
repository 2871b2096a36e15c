"""Language identification by unigrams over a fixed public vocabulary, with all segmentations summed.

Each language has a probability for every vocabulary piece. A word's probability is the sum over all ways to
cut it into pieces, by the forward algorithm; a text's is the product over its words. The piece
probabilities are fitted by expectation maximisation: forward and backward sums give every piece's
expected count. Only sums over the fixed vocabulary leave the executors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from taleforge.llm.common import let_go, rebatched, stash

#: Documents of each language that the model is fitted on at most.
ROWS_PER_LANGUAGE = 1500
ROUNDS = 2
#: Runs between white space, and words, that a worker keeps of each.
CACHE = 400_000
#: Longer words are scored one by one, with scaling, and learned from in stretches of this length.
LONG = 60
#: Probability of a letter that no piece covers, the same in every language.
UNKNOWN = 1e-7
#: Runs of letters; numerals such as fractions and circled digits are none.
WORD = regex.compile(r"\p{L}+")


class Pieces:
    """The vocabulary: lower-case pieces by their text, the word mark included, and all beginnings of pieces (as -1)."""

    def __init__(self, pieces: list[str]) -> None:
        self.index = {p: i for i, p in enumerate(pieces)}
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.begins = {p[:k]: -1 for p in pieces for k in range(1, len(p))} | self.index

    def cuts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every piece in every word: (word, start, end, piece), in the order of the words; piece = size: an unknown letter."""
        get, none = self.begins.get, self.size
        out: list[tuple[int, int, int, int]] = []
        put = out.append
        for w, word in enumerate(words):
            n = len(word)
            for i in range(n):
                p = get(word[i], -1)
                put((w, i, i + 1, p if p >= 0 else none))
                for j in range(i + 2, n + 1):
                    p = get(word[i:j])
                    if p is None:  # no piece begins like this
                        break
                    if p >= 0:
                        put((w, i, j, p))
        return tuple(np.array(out, np.int64).reshape(-1, 4).T)


def vocabulary(path: str) -> list[str]:
    """The lower-case pieces of a public piece model; control, unknown and byte pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in found if p == p.lower()})


def _sum(values: np.ndarray, groups: np.ndarray, into: np.ndarray, at: int | tuple[()]) -> None:
    """Add rows of values, sorted by groups, to into[groups, at], or to into[groups] for at = ()."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    where = (groups[first], at) if at != () else groups[first]
    into[where] += np.add.reduceat(values, first, axis=0)


def forward(cuts: tuple, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]: the sum over all segmentations of the word's first letters. table: (pieces + 1, languages)."""
    word, start, end, piece = cuts
    alpha = np.zeros((len(lengths), int(lengths.max(initial=0)) + 1, table.shape[1]))
    alpha[:, 0] = 1
    order = np.argsort(end, kind="stable")
    bounds = np.searchsorted(end[order], np.arange(alpha.shape[1] + 1))
    for e in range(1, alpha.shape[1]):
        k = order[bounds[e] : bounds[e + 1]]
        if len(k):
            _sum(alpha[word[k], start[k]] * table[piece[k]], word[k], alpha, e)
    return alpha


def backward(cuts: tuple, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    word, start, end, piece = cuts
    beta = np.zeros((len(lengths), int(lengths.max(initial=0)) + 1, table.shape[1]))
    beta[np.arange(len(lengths)), lengths] = 1
    order = np.argsort(start, kind="stable")
    bounds = np.searchsorted(start[order], np.arange(beta.shape[1] + 1))
    for s in range(beta.shape[1] - 2, -1, -1):
        k = order[bounds[s] : bounds[s + 1]]
        if len(k):
            _sum(beta[word[k], end[k]] * table[piece[k]], word[k], beta, s)
    return beta


def long_word(word: str, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probabilities of one word of any length: the forward sums of the last letters only, scaled as they go."""
    width = pieces.longest
    recent, logs = [np.ones(table.shape[1])], np.zeros(table.shape[1])
    for e in range(1, len(word) + 1):
        now = np.zeros(table.shape[1])
        for k in range(1, min(width, len(recent)) + 1):
            p = pieces.index.get(word[e - k : e], pieces.size if k == 1 else None)
            if p is not None:
                now += recent[-k] * table[p]
        scale = np.maximum(now, 1e-300)
        recent = [r / scale for r in [*recent[-(width - 1) :], now]] if width > 1 else [now / scale]
        logs += np.log(scale)
    return logs


def word_logs(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probabilities (words, languages), summed over all segmentations."""
    out = np.zeros((len(words), table.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for at in range(0, len(short), 4096):
        part = short[at : at + 4096]
        own = [words[i] for i in part]
        lengths = np.array([len(w) for w in own])
        alpha = forward(pieces.cuts(own), lengths, table)
        out[part] = np.log(np.maximum(alpha[np.arange(len(own)), lengths], 1e-300))
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = long_word(w, pieces, table)
    return out


def words_of(text: str) -> list[str]:
    return ["▁" + w for w in WORD.findall(text.lower())]


@dataclass(frozen=True)
class LanguageModel:
    """languages: sorted; pieces: the vocabulary; table: probabilities (pieces + 1, languages)."""

    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    table: np.ndarray


def _expected(train: DataFrame, model: LanguageModel, uniform: bool) -> np.ndarray:
    """Expected counts (pieces, languages) over the training texts (columns __text, __lang as an index)."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        let_go()
        pieces, n = Pieces(list(known.pieces)), len(known.languages)
        total = np.zeros((len(known.pieces) + 1, n))
        for batch in batches:
            words: dict[int, Counter] = {}
            for text, lang in zip(batch.column("__text"), batch.column("__lang"), strict=True):
                words.setdefault(lang.as_py(), Counter()).update(w[k : k + LONG] for w in words_of(text.as_py()) for k in range(0, len(w), LONG))
            for lang, counts in words.items():
                own, table = list(counts), known.table[:, lang : lang + 1]
                for at in range(0, len(own), 4096):
                    part = own[at : at + 4096]
                    lengths, times = np.array([len(w) for w in part]), np.array([counts[w] for w in part], float)
                    cuts = word, start, end, piece = pieces.cuts(part)
                    if uniform:
                        share = np.ones(len(word))
                    else:
                        alpha, beta = forward(cuts, lengths, table)[..., 0], backward(cuts, lengths, table)[..., 0]
                        share = alpha[word, start] * table[piece, 0] * beta[word, end] / np.maximum(beta[word, 0], 1e-300)
                    total[:, lang] += np.bincount(piece, share * times[word], len(total))
        at, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang), pa.array(total[at, lang])], names=["piece", "lang", "n"])

    out = np.zeros((len(model.pieces) + 1, len(model.languages)))
    sums = train.mapInArrow(run, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    out[sums["piece"].to_numpy(int), sums["lang"].to_numpy(int)] = sums["n"]
    return out[:-1]


def fit(docs: DataFrame, path: str, *, keep: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE, rounds: int = ROUNDS, name: str = "language") -> LanguageModel:
    """Fit on the rows where ``keep`` holds and text and language are not null: at most about ``rows`` of each language, chosen by a hash."""
    pieces = vocabulary(path)
    own = docs.where(keep & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.xxhash64(id_col).alias("__h"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__name"))
    sizes = {r[0]: r[1] for r in own.groupBy("__name").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), tuple(pieces), np.zeros((len(pieces) + 1, 0)))
    known = own.sparkSession.createDataFrame([(k, i, max(1, sizes[k])) for i, k in enumerate(languages)], "__name string, __lang bigint, __n bigint")
    train = own.join(F.broadcast(known), "__name").where(F.pmod("__h", "__n") < rows).select("__text", "__lang")
    train = stash(train.repartition(max(8, train.sparkSession.sparkContext.defaultParallelism)), f"{name}-train")
    model = LanguageModel(languages, tuple(pieces), np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces)))
    for k in range(rounds + 1):
        counts = _expected(train, model, uniform=k == 0) + 0.01
        table = np.concatenate([counts / counts.sum(0), np.full((1, len(languages)), UNKNOWN)])
        model = LanguageModel(languages, tuple(pieces), table)
    return model


class _Scorer:
    """A task's model with its bounded table of runs between white space."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.pieces = model, Pieces(list(model.pieces))
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.model.languages)))
        self.words: dict[str, int] = {}
        self.word_logs = np.zeros((0, len(self.model.languages)))

    def scores(self, texts: list[str]) -> Iterator[tuple[bool, np.ndarray]]:
        """For each text: whether it has a letter, and its log probability in each language."""
        if len(self.seen) > CACHE or len(self.words) > CACHE:
            self.clear()
        seen, new, index = self.seen, [], []
        for text in texts:
            at = []
            for run in text.lower().split():
                k = seen.get(run)
                if k is None:
                    k = seen[run] = len(seen)
                    new.append(run)
                at.append(k)
            index.append(at)
        if new:
            words, fresh, owner, which = self.words, [], [], []
            for i, run in enumerate(new):
                for w in WORD.findall(run):
                    k = words.get(w)
                    if k is None:
                        k = words[w] = len(words)
                        fresh.append("▁" + w)
                    owner.append(i)
                    which.append(k)
            if fresh:
                self.word_logs = np.concatenate([self.word_logs, word_logs(fresh, self.pieces, self.model.table)])
            made = np.zeros((len(new), self.logs.shape[1]))
            if owner:
                _sum(self.word_logs[which], np.array(owner), made, ())
            self.logs = np.concatenate([self.logs, made])
        for at in index:
            total = self.logs[at].sum(0) if at else np.zeros(self.logs.shape[1])
            yield bool(total.any()), total


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """docs with ``lang_pred`` and ``score`` (the language's share of the probability of all, 0 to 1).

    ``und`` and 0 where the text is null or has no letter, or nothing was learned; ties go to the first
    language. Only the text is read; every other column, whatever its name, is passed through
    (``lang_pred`` and ``score`` are replaced if they exist); the text itself only ``with_text``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names = [c for c in docs.columns if with_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        let_go()
        scorer = _Scorer(known)
        for batch in rebatched(batches, text_col):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            named, share = [], []
            for letters, logs in scorer.scores(texts):
                if not letters or not len(logs):
                    named.append("und")
                    share.append(0.0)
                    continue
                best = int(logs.argmax())
                named.append(known.languages[best])
                share.append(float(1 / np.exp(np.minimum(logs - logs[best], 0)).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(named, pa.string()), pa.array(share, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = StructType([*(docs.schema[c] for c in names), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)
