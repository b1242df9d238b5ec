"""Token ids of all texts in a compact binary format.

The format is a list of blocks in ascending document order, each one row of a Parquet file: document ids and
their token counts, the distinct token ids ranked by frequency in the block, and the ranks in a byte-aligned
variable-length code. Control bytes (two bits of length for each value, four values a byte) stand apart from
the data bytes, so a block is decoded with table lookups and no loop. Spark's committer publishes whole files
only, so a lost executor leaves no torn file.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voidscope.llm.common import slices
from voidscope.session import stage

END = 2
BLOCK_TOKENS = 1 << 18
_CACHED = 500_000
_JOINED = 500
_PIECE_BYTES = 4 << 20
_MARKS = rb"!-&(-/:-@\[-`{-~"  # ASCII punctuation without the apostrophe
_PARTS = re.compile(rb"[^\s" + _MARKS + rb"]+|[" + _MARKS + rb"]+")
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_TAILED = re.compile(b"(" + _LETTERS.pattern + b")([" + _MARKS + b"]+)")
_PLAIN = bytes(set(range(32, 127)) - {39} | set(b"\t\n\v\f\r") | {0xC3} | set(range(0x80, 0xC0)))

_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)


def _plain(text: bytes) -> bool:
    """Whether all characters are ASCII (no control character, no apostrophe) or Latin-1 letters, without a special
    token's mark. The vocabulary then parts the word wherever punctuation starts or ends."""
    return not (text.translate(None, _PLAIN) or b"<|" in text or b"\xc3\x97" in text or b"\xc3\xb7" in text)


class WordEncoder:
    """Whole texts through the tokenizers library, each distinct word once.

    The vocabulary lower-cases, drops white space and never joins over it, so the ids of a text are those of its
    words. Words of letters are encoded many at a time, joined by spaces; all others one by one. Plain words
    are parted at punctuation first, so that a word is known with any mark behind it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.words: dict[bytes, bytes] = {}

    def _ids(self, text: bytes) -> np.ndarray:
        found, = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)
        return np.array(found.ids, "<u4")

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words. Words of letters only are one word of the vocabulary each, and are encoded many at a time."""
        known = self.words
        letters, odd, joined = [], set(), []
        for word in words:
            if word.isalpha() or _LETTERS.fullmatch(word):
                letters.append(word)
            elif tailed := _TAILED.fullmatch(word):
                joined.append((word, tailed.groups()))
            elif _plain(word) and len(parts := _PARTS.findall(word)) > 1:
                joined.append((word, parts))
            else:
                odd.add(word)
        for part in {p for _, parts in joined for p in parts} - known.keys() - set(words):
            if _LETTERS.fullmatch(part):
                letters.append(part)
            else:
                odd.add(part)
        for start in range(0, len(letters), _JOINED):
            group = letters[start:start + _JOINED]
            ids = self._ids(b" ".join(group))
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()  # the last token of a word is marked
            if len(cuts) == len(group):
                raw = ids.tobytes()
                known.update(zip(group, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
            else:
                odd.update(group)
        for word in odd:
            known[word] = self._ids(word).tobytes()
        for word, parts in joined:
            known[word] = b"".join([known[p] for p in parts])

    def _found(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words; what is known is bounded and starts anew beyond the bound."""
        if len(self.words) > _CACHED:
            self.words.clear()
        found = list(map(self.words.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        self._learn([words[i] for i in new])
        for i in new:
            found[i] = self.words[words[i]]
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (a string column without NULL) as little-endian 32-bit integers.

        Texts are split at ASCII white space, in lower case but for those that may name a special token; every
        distinct word of the column is looked up once.
        """
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        words = split.flatten().dictionary_encode()
        ids = self._found(words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        at = words.indices.to_numpy()
        counts = sizes[at]
        ends = np.cumsum(counts)
        tokens = pool[np.repeat(starts[at] - ends + counts, counts) + np.arange(counts.sum())]
        bounds = np.r_[0, ends][np.cumsum(np.r_[0, pc.list_value_length(split).to_numpy()])]
        return [tokens[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def pack(tokens: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """Ids ranked by frequency (ties: smaller id), control bytes, data bytes."""
    counts = np.bincount(tokens)  # ids are below the size of a vocabulary
    distinct = np.flatnonzero(counts)
    ranked = distinct[np.argsort(-counts[distinct], kind="stable")]
    rank = np.zeros(len(counts), "<u4")
    rank[ranked] = np.arange(len(ranked))
    values = rank[tokens]
    extra = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] <= extra[:, None]]
    return ranked, control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(n: int, ranked: np.ndarray, control: bytes, data: bytes) -> np.ndarray:
    """The ids of a block: lengths by table lookup on control bytes, then byte gathers."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, np.uint8)
    values = raw[start].astype(np.int64)
    for j in range(1, 4):
        longer = np.flatnonzero(lengths > j)
        if not len(longer):
            break
        values[longer] |= raw[start[longer] + j].astype(np.int64) << 8 * j
    return ranked[values]


BLOCKS = "part int, seq long, doc_ids array<long>, counts array<long>, n long, ranked array<long>, control binary, data binary"


_loaded: dict[str, WordEncoder] = {}


def load(path: str) -> WordEncoder:
    """The encoder with the words it knows, kept for the tasks that follow in a worker process."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def write_tokens(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Encode ``docs(doc_id, text)``, write the files in ascending ``doc_id`` order, and return them read again.

    A range shuffle orders the documents (rows of one id by a hash of their text, so that one id can spread);
    rows without an id come first. ``(part, seq)`` is the place of a block in the whole order.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        last = np.array([end], "<u4").tobytes()
        ids: list[int | None] = []
        found: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(found), "<u4")
            ranked, control, data = pack(tokens)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(x) // 4 for x in found]], pa.list_(pa.int64())), pa.array([len(tokens)], pa.int64()),
                pa.array([ranked.astype(np.int64)], pa.list_(pa.int64())),
                pa.array([control], pa.binary()), pa.array([data], pa.binary()),
            ], ["part", "seq", "doc_ids", "counts", "n", "ranked", "control", "data"])

        for batch in batches:
            for some in slices(batch, limit=_PIECE_BYTES):
                for doc, tokens in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text"))):
                    ids.append(doc)
                    found.append(tokens + last)
                    size += len(tokens) // 4 + 1
                    if size >= BLOCK_TOKENS:
                        yield block()
                        ids, found, size, seq = [], [], 0, seq + 1
        if found:
            yield block()

    return stage(rows.mapInArrow(run, BLOCKS), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """``part, seq, doc_id, offset, ids`` of every document, decoded; ``offset`` counts within the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, doc_ids, counts, starts, tokens in _decoded(batches):
            ids = pa.ListArray.from_arrays(
                pa.array(np.r_[starts, len(tokens)].astype(np.int32)), pa.array(tokens.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(counts), part, np.int32)), pa.array(np.full(len(counts), seq)), doc_ids,
                pa.array(starts), ids], ["part", "seq", "doc_id", "offset", "ids"])

    return files.mapInArrow(run, "part int, seq long, doc_id long, offset long, ids array<long>")


def _decoded(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            counts = batch.column("counts")[i].values.to_numpy()
            ranked = batch.column("ranked")[i].values.to_numpy()
            tokens = unpack(
                batch.column("n")[i].as_py(), ranked, batch.column("control")[i].as_py(), batch.column("data")[i].as_py())
            yield (batch.column("part")[i].as_py(), batch.column("seq")[i].as_py(), batch.column("doc_ids")[i].values,
                   counts, np.cumsum(counts) - counts, tokens)


def block_starts(files: DataFrame) -> DataFrame:
    """``part, seq, first``: ids before each block in the whole order. One row per block; the running sum over
    parts sees one row per file."""
    blocks = files.select("part", "seq", "n")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("total"))
    files_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks_before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_part", F.coalesce(F.sum("total").over(files_before), F.lit(0)))
    within = F.coalesce(F.sum("n").over(blocks_before), F.lit(0))
    return blocks.withColumn("_within", within).join(parts, "part").select(
        "part", "seq", (F.col("_part") + F.col("_within")).cast("long").alias("first"))


def summary(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the decoded files.

    NULL and empty texts hold the end id alone; repeated rows are documents of their own. Further columns of the
    input are not written. An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, doc_ids, counts, starts, tokens in _decoded(batches):
            raw = memoryview(tokens.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * s:4 * (s + c)]) for s, c in zip(starts.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(counts), part, np.int32)), pa.array(np.full(len(counts), seq)), doc_ids,
                pa.array(starts), pa.array(counts), pa.array(crc, pa.int64()),
            ], ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(run, "part int, seq long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(block_starts(files), ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
