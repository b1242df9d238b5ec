"""SentencePiece encoding and decoding with batched numpy Viterbi.

Words of equal length advance together, one character at a time. Hashes of all substrings that end at a
character probe the sorted hashes of the pieces; the vectorised maximum over the admissible pieces is kept
with its backpointer. The model is a BPE model: a piece may follow another only if the two, merged by score,
stay apart. Segmentations of which all neighbors stay apart are exactly the results of merging, so the best
path is the one that the model's own encoder gives (a plain sum of BPE scores would not be).

Characters outside the vocabulary become byte pieces. Each distinct word is encoded once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voidscope.llm.common import slices, texts

SPACE = "▁"
LONG = 64  # longer words are merged by a heap, which gives the same pieces
_CACHED = 500_000  # words of a generation; two are kept
_BITMAP = 18
_BASE = np.uint64(0x100000001B3)
_WORDS = 8192  # words advancing together
_PAIR_SLOTS = 20  # verdicts on pairs of pieces are kept in a table of this many bits


class Pieces:
    """Vocabulary of a model file, as sorted hashes and as Python tables."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.size, self.unknown = size, size  # one number past the vocabulary stands for an unknown character
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.score = np.array([model.get_score(i) for i in range(size)] + [-1e12])
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.number = {self.text[i]: i for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.longest = max(map(len, self.number))
        hashes = np.array([self._hash(self.text[i]) for i in plain], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array(plain)[order]
        self.bitmap = np.zeros(1 << _BITMAP, bool)
        self.bitmap[hashes >> np.uint64(64 - _BITMAP)] = True
        #: Bytes that a piece stands for.
        self.bytes = [b"" if model.is_control(i) else self.text[i].replace(SPACE, " ").encode() for i in range(size)]
        for value, i in self.byte.items():
            self.bytes[i] = bytes([value])
        self.bytes[model.unk_id()] = " ⁇ ".encode()
        self.pair_keys = np.full(1 << _PAIR_SLOTS, -1)
        self.pair_apart = np.zeros(1 << _PAIR_SLOTS, bool)
        self.spines: tuple[dict[str, list], dict[str, list]] = {}, {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
        return h * 0x9E3779B97F4A7C15 & (1 << 64) - 1

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers of substring hashes, -1 for none."""
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
        out = np.full(len(mixed), -1)
        some = np.flatnonzero(self.bitmap[mixed >> np.uint64(64 - _BITMAP)])
        at = np.minimum(np.searchsorted(self.hashes, mixed[some]), len(self.hashes) - 1)
        hit = self.hashes[at] == mixed[some]
        out[some[hit]] = self.numbers[at[hit]]
        return out

    def merge(self, text: str, without: str = "") -> list[str]:
        """Merging by score, leftmost first among equals; unknown characters, and the piece ``without``, are not
        made."""
        symbols: list[str | None] = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        number, score = self.number, self.score

        def pair(i: int) -> tuple[float, int, str, str] | None:
            j = after[i]
            if j < len(symbols):
                joined = number.get(symbols[i] + symbols[j])
                if joined is not None and symbols[i] + symbols[j] != without:
                    return -score[joined], i, symbols[i], symbols[j]
            return None

        heap = [p for p in map(pair, range(len(symbols))) if p]
        heapify(heap)
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            for p in (pair(before[i]) if before[i] >= 0 else None, pair(i)):
                if p:
                    heappush(heap, p)
        return [s for s in symbols if s is not None]

    def spine(self, piece: str, side: int) -> list[tuple[str, float]] | None:
        """Symbols at one edge of a piece while it is merged, from one character to the piece, each with the score
        at which it is merged on; None for a piece that merging never makes."""
        known = self.spines[side]
        if piece not in known:
            if len(piece) == 1:
                known[piece] = [(piece, -np.inf)]
            else:
                parts = self.merge(piece, piece)
                part = self.spine(parts[side], side) if len(parts) == 2 else None
                if part is None:
                    known[piece] = None
                else:
                    score = self.score[self.number[piece]]
                    if len(part) > 1:
                        score = min(score, part[-2][1])  # not before the part itself is there
                    known[piece] = [*part[:-1], (part[-1][0], score), (piece, -np.inf)]
        return known[piece]

    def _apart(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` ends with these two pieces: no symbols met at the border may merge
        before one of them is merged on inside its own piece."""
        a, b = self.spine(left, 1), self.spine(right, 0)
        if a is None or b is None:
            return False
        number, score = self.number, self.score
        i = j = 0
        while True:
            (x, at_x), (y, at_y) = a[i], b[j]
            joined = number.get(x + y)
            if joined is not None:
                s = score[joined]
                if s > at_x and s >= at_y:
                    return False
            if at_x == -np.inf and at_y == -np.inf:
                return True
            if at_x >= at_y:
                i += 1
            else:
                j += 1

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces survives merging; unknown characters never merge."""
        out = (left == self.unknown) | (right == self.unknown)
        keys = left * self.size + right
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PAIR_SLOTS)).astype(np.int64)
        hit = self.pair_keys[slots] == keys
        out |= hit & self.pair_apart[slots]
        miss = np.flatnonzero(~hit & ~out)
        if len(miss):
            new, first, place = np.unique(keys[miss], return_index=True, return_inverse=True)
            text = self.text
            verdicts = np.array([self._apart(text[k // self.size], text[k % self.size]) for k in new.tolist()])
            at = slots[miss[first]]
            self.pair_keys[at], self.pair_apart[at] = new, verdicts
            out[miss] = verdicts[place]
        return out

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length: all words advance together."""
        m, n = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(m, n).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((m, n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * _BASE + codes[:, i]
        power = np.cumprod(np.r_[np.uint64(1), np.full(self.longest, _BASE)], dtype=np.uint64)
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((m, n + 1), self.unknown)
        back = np.full((m, n + 1), -1)
        for end in range(1, n + 1):
            for size in range(1, min(end, self.longest) + 1):
                start = end - size
                piece = self.probe(prefix[:, end] - prefix[:, start] * power[size])
                if size == 1:
                    piece = np.where(piece < 0, self.unknown, piece)
                rows = np.flatnonzero((piece >= 0) & (best[:, start] > -np.inf))
                if start and len(rows):
                    rows = rows[self.stay_apart(last[rows, start], piece[rows])]
                total = best[rows, start] + self.score[piece[rows]]
                better = total > best[rows, end]
                rows, total = rows[better], total[better]
                best[rows, end], last[rows, end], back[rows, end] = total, piece[rows], start
        on_path = np.zeros((m, n + 1), bool)
        at, rows = np.full(m, n), np.flatnonzero(back[:, n] >= 0)
        whole = back[:, n] >= 0
        while len(rows):
            on_path[rows, at[rows]] = True
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        whole &= ~(on_path & (last == self.unknown)).any(axis=1)
        ids = last[on_path].astype("<u4").tobytes()
        ends = (4 * np.cumsum(on_path.sum(axis=1))).tolist()
        # words with unknown characters are spelled in bytes
        return [ids[a:b] if ok else self._ids(self.merge(word))
                for word, ok, a, b in zip(words, whole.tolist(), [0, *ends], ends)]

    def _ids(self, pieces: list[str]) -> bytes:
        ids = []
        for p in pieces:
            i = self.number.get(p)
            if i is None:
                ids += [self.byte[b] for b in p.encode("utf-8", "replace")]
            else:
                ids.append(i)
        return np.array(ids, "<u4").tobytes()

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        # no piece holds a line feed, or a space mark behind another character: words end there
        split = [_UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in rows]
        known = self.words
        new = set().union(*split) - known.keys() if split else set()
        if len(known) + len(new) > _CACHED:  # two generations: frequent words move on to the next one
            self.older, known = known, {}
            self.words = known
            new = set().union(*split)
        again = new & self.older.keys()
        known.update((w, self.older[w]) for w in again)
        new -= again
        by_length: dict[int, list[str]] = {}
        for word in new:
            by_length.setdefault(len(word), []).append(word)
        for length, words in by_length.items():
            for at in range(0, len(words), _WORDS):
                some = words[at:at + _WORDS]
                known.update(zip(some, self.viterbi(some) if length <= LONG else [self._ids(self.merge(w)) for w in some]))
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the space that encoding puts in front goes."""
        text = b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The vocabulary, read once per worker process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs(doc_id, text)``: the piece ids of the whole text.

    NULL and empty texts have no ids. Repeated rows give repeated results; further columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for part in slices(batch):
                found = pieces.encode(texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(found)], ["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _lists(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(f) // 4 for f in found]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids)``. NULL ids give the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            rows = [pieces.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids, restored`` of every row of ``docs(doc_id, text)``: encoded, decoded again and
    compared. A space mark in a text is a space to the model; it comes back as one and counts as restored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for part in slices(batch):
                rows = texts(part.column("text"))
                found = pieces.encode(rows)
                same = [pieces.decode(np.frombuffer(f, "<u4").tolist()) == t.replace(SPACE, " ") for t, f in zip(rows, found)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(f) // 4 for f in found], pa.int64()), _lists(found), pa.array(same)],
                    ["doc_id", "n_tokens", "ids", "restored"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, restored boolean")
