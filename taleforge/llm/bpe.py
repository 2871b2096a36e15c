"""BPE by a bounded-lookahead streaming transducer, and decoding by an incremental state machine.

A merge can only be undone by what stands to its right if a merge of higher priority overlaps its end, and
that one in turn by a third, and so on with rising priority. The longest such chain over the merge list
bounds how many symbols beyond a token's end can still matter: the list's sufficient lookahead. The encoder
holds a window of symbols, merges inside it, emits the tokens that end before the last ``lookahead``
symbols and starts anew after them, so memory does not grow with the text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleforge.llm.common import held, rebatched

#: Runs, and pieces, that a worker keeps in each of two generations; the older one goes when the newer is full.
CACHE = 200_000
#: Longer runs without a space are transduced piece by piece and not kept.
LONG = 512
#: Letters of a text that are encoded at once.
CHUNK = 1 << 16
#: Fixed value: white space of Unicode.
SPACE = "\t-\r \x85\xa0  -     　"
#: Fixed value: the pieces of the lower-casing word vocabulary; the second alternatives spell out its white space.
WORD_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list, its vocabulary and its sufficient lookahead in symbols."""

    def __init__(self, merges: Iterable[tuple[str, str]], vocab: dict[str, int], ending: str = "") -> None:
        self.vocab, self.ending = vocab, ending
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.lookahead = self._lookahead()

    def symbols(self, token: str) -> int:
        return len(token.removesuffix(self.ending)) if self.ending and token != self.ending else len(token)

    def _lookahead(self) -> int:
        """The most symbols that a chain of overlapping merges of rising priority reaches beyond a token."""
        made: set[str] = set()
        reach: dict[str, int] = {}  # of a prefix: symbols to the end of the farthest chain that begins with it
        most = 0
        for a, b in self.rank:
            for part in (a, b):
                if self.symbols(part) > 1 and part not in made:
                    raise ValueError(f"merge {a!r} {b!r} comes before the merge that makes {part!r}")
            token = a + b
            made.add(token)
            n = self.symbols(token)
            beyond = 0
            if not (self.ending and token.endswith(self.ending)):
                beyond = max([0, *(reach[token[k:]] - (n - k) for k in range(1, n) if token[k:] in reach)])
            most = max(most, beyond)
            for k in range(1, n):
                prefix = token[:k]
                if reach.get(prefix, 0) < n + beyond:
                    reach[prefix] = n + beyond
        return most + 1  # the last symbol of a word is another symbol than within it

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges inside a window, by priority, equal ones from the left."""
        return self._merge_long(symbols) if len(symbols) > 48 else self._merge_short(symbols)

    def _merge_short(self, symbols: list[str]) -> list[str]:
        get, none = self.rank.get, len(self.rank)
        symbols = list(symbols)
        ranks = [get(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a queue of pairs: n log n steps."""
        get, parts, n = self.rank.get, list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j >= n or get((parts[i], parts[j])) != r:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := get((parts[i], parts[k]))) is not None:
                    heapq.heappush(queue, (x, i))
            if (h := before[i]) >= 0 and (x := get((parts[h], parts[i]))) is not None:
                heapq.heappush(queue, (x, h))
        return [p for p in parts if p]


class Transducer:
    """Feeds on the letters of one piece; gives tokens as soon as nothing to come can change them."""

    def __init__(self, merges: Merges, window: int = 256) -> None:
        self.merges, self.window = merges, window + 2 * merges.lookahead
        self.held: list[str] = []

    def feed(self, letters: str) -> Iterator[str]:
        for at in range(0, len(letters), self.window):
            self.held += letters[at : at + self.window]
            if len(self.held) > self.window:
                yield from self._stable()

    def _stable(self) -> Iterator[str]:
        end, limit = 0, len(self.held) - self.merges.lookahead
        for token in self.merges.merge(self.held):
            if end + len(token) > limit:
                break
            end += len(token)
            yield token
        self.held = self.held[end:]

    def close(self) -> Iterator[str]:
        """What is left, now that the end is known."""
        if self.held:
            self.held[-1] += self.merges.ending
            yield from self.merges.merge(self.held)
            self.held = []


class PieceDecoder:
    """State machine for vocabularies without a decoder: tokens joined by single spaces, special ones included."""

    def __init__(self, tokens: dict[int, str]) -> None:
        self.tokens, self.begun = tokens, False

    def reset(self) -> None:
        self.begun = False

    def feed(self, token_id: int) -> str:
        out = (" " if self.begun else "") + self.tokens[token_id]
        self.begun = True
        return out

    def close(self) -> str:
        return ""


class ByteDecoder:
    """State machine from token ids to text: letters stand for bytes, and an incomplete UTF-8 sequence waits for the next token."""

    def __init__(self, tokens: dict[int, str], special: frozenset[int] = frozenset(), ending: str = "") -> None:
        self.bytes = {c: b for b, c in enumerate(byte_letters())}
        self.tokens, self.special, self.ending = tokens, special, ending
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def reset(self) -> None:
        self.state.reset()

    def feed(self, token_id: int) -> str:
        token = self.tokens[token_id]
        if token_id in self.special:
            return self.state.decode(b"", True) + token
        last = bool(self.ending) and token.endswith(self.ending)
        text = self.state.decode(bytes(self.bytes[c] for c in (token.removesuffix(self.ending) if last else token)))
        return text + (" " if last else "")

    def close(self) -> str:
        return self.state.decode(b"", True)


def lowered(text: str) -> str:
    """Lower case letter by letter, without rules that look at neighbours."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class WordBpe:
    """Texts to ids and decoded text with a tokenizer file of the lower-casing kind with word ends.

    A run without spaces is looked up whole; a new one is normalised, cut into pieces, and each new piece
    goes through the transducer. Both tables are bounded; what is not asked for again leaves them.
    """

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)
        self.ending = model["model"]["end_of_word_suffix"] or ""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"])
        self.merges = Merges(pairs, model["model"]["vocab"], self.ending)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.tokens = {i: t for t, i in self.merges.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.cut = regex.compile(WORD_PIECES)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.runs: dict[str, tuple[bytes, str]] = {}
        self.old_runs: dict[str, tuple[bytes, str]] = {}
        self.pieces: dict[str, list[int]] = {}
        self.old_pieces: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is not None:
            return found
        found = self.old_pieces.get(piece)
        if found is None:
            work = Transducer(self.merges)
            vocab = self.merges.vocab
            found = []
            for at in range(0, len(piece), LONG):
                letters = "".join([self.letters[b] for b in piece[at : at + LONG].encode()])
                found += [vocab[t] for t in work.feed(letters)]
            found += [vocab[t] for t in work.close()]
        if len(piece) <= LONG:
            if len(self.pieces) >= CACHE:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = found
        return found

    def ids(self, run: str) -> list[int]:
        """Ids of a run of text (any text; special tokens are found before it is normalised)."""
        out: list[int] = []
        for part in self.at_special.split(run) if self.at_special and "<|" in run else (run,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for piece in self.cut.findall(lowered(part if part.isascii() else unicodedata.normalize("NFC", part))):
                    out += self._piece(piece)
        return out

    def _run(self, run: str) -> tuple[bytes, str]:
        made = self.old_runs.get(run)
        if made is None:
            ids = self.ids(run)
            decoder = PieceDecoder(self.tokens)
            text = "".join([decoder.feed(i) for i in ids]) + decoder.close()
            made = (struct.pack(f"<{len(ids)}I", *ids), " " + text if ids else "")
        if len(run) <= LONG:
            if len(self.runs) >= CACHE:
                self.old_runs, self.runs = self.runs, {}
            self.runs[run] = made
        return made

    def stream(self, chunks: Iterable[str]) -> Iterator[tuple[bytes, str]]:
        """Ids and decoded text of a text that comes in chunks, as they become certain.

        Only the run that a chunk cuts is held back (white space ends it): its normal form and special tokens need all of it.
        """
        rest: list[str] = []
        begun = False
        for chunk in itertools.chain(chunks, [" "]):
            at = max(chunk.rfind(" "), chunk.rfind("\n"))
            if at < 0:
                rest.append(chunk)
                continue
            ids, text = self.encode("".join([*rest, chunk[:at]]))
            rest = [chunk[at + 1 :]]
            if ids:
                yield ids, " " + text if begun else text
                begun = True

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 sums of the ids and of the decoded text, which are never held whole."""
        sums, n = (hashlib.sha256(), hashlib.sha256()), 0
        for ids, decoded in self.stream(text[at : at + CHUNK] for at in range(0, len(text), CHUNK)):
            n += len(ids) // 4
            sums[0].update(ids)
            sums[1].update(decoded.encode())
        return n, sums[0].hexdigest(), sums[1].hexdigest()

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        known, new = self.runs, self._run
        made = [known.get(run) or new(run) for run in text.replace("\n", " ").split(" ") if run]
        return b"".join([m[0] for m in made]), "".join([m[1] for m in made])[1:]


def word_bpe(spec: str) -> WordBpe:
    """The worker's tokenizer for a file's content; one is kept."""
    return held(f"word-bpe-{hashlib.sha256(spec.encode()).hexdigest()}", lambda: WordBpe(spec))


def encode_table(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids, decoded) of every row, or with ``digest`` SHA-256 sums in place of the last two.

    vocabulary: path of a tokenizer file, read on the driver and broadcast (a fixed file of under 2 MB).
    ids: little-endian unsigned 32-bit integers. Null and empty texts have no ids and decode to ''.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = word_bpe(spec.value)
        for batch in rebatched(batches, text_col):
            count, ids, decoded = [], [], []
            for text in batch.column(text_col):
                if digest:
                    n, a, b = work.digest(text.as_py() or "")
                else:
                    a, b = work.encode(text.as_py() or "")
                    n = len(a) // 4
                count.append(n)
                ids.append(a)
                decoded.append(b)
            last = [pa.array(ids, pa.string()), pa.array(decoded, pa.string())] if digest else [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(count, pa.int64()), *last], names=["__id", "n_tokens", "x", "y"])

    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    kind = "string" if digest else "binary"
    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias(text_col)).mapInArrow(run, f"__id {id_type}, n_tokens bigint, x {kind}, y string")
    return out.toDF(id_col, "n_tokens", *names)


def decoder_of(spec: str) -> PieceDecoder | ByteDecoder:
    """The state machine that a tokenizer file asks for: bytes to text where it decodes byte letters, else pieces and spaces."""
    model = json.loads(spec)
    special = {t["id"]: t["content"] for t in model["added_tokens"]}
    tokens = {i: t for t, i in model["model"]["vocab"].items()} | special
    kind = model.get("decoder")
    if kind is None:
        return PieceDecoder(tokens)
    if kind["type"] != "ByteLevel":
        raise ValueError(f"no state machine for the decoder {kind['type']!r}")
    return ByteDecoder(tokens, frozenset(special))


def decode_table(rows: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded) of every row of little-endian unsigned 32-bit ids, token by token. Null and empty ids decode to ''; unknown ids raise."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = rows.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = decoder_of(spec.value)
        for batch in batches:
            out = []
            for ids in batch.column("__ids"):
                data = ids.as_py() or b""
                work.reset()
                out.append("".join([*(work.feed(i) for (i,) in struct.iter_unpack("<I", data)), work.close()]))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(out, pa.string())], names=["__id", "decoded"])

    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("__id"), F.col(ids_col).alias("__ids")).mapInArrow(run, f"__id {id_type}, decoded string").toDF(id_col, "decoded")
