"""Removal of long passages that an earlier document holds, by run-length indexes over shared strings.

Texts are written as compressed blocks. Every window of ``length`` bytes is known by the least hash of its short
substrings; consecutive windows with one such mark form a string, and equal windows always meet under one mark. Blocks
first exchange marks only; strings then travel where another document shares their mark, each once per block.
Every part of the marks builds a run-compressed index (:mod:`voidscope.llm.runindex`) of its strings and streams their
matching statistics against it; windows that an earlier document holds go back to the blocks, which
mark all their documents.

Marks that very many strings share are dealt out by whole windows instead, so a passage that a third of all
documents hold costs one copy per block and window, spread over all parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voidscope.llm.common import row_sums, slices
from voidscope.llm.runindex import RunIndex, _places
from voidscope.session import stage

LENGTH = 50
MARK = 20  # bytes of the substrings whose least hash marks a window
BLOCK_BYTES = 4 << 20
SLICE = 1 << 17  # windows marked at a time
MAX_WINDOWS = 64  # windows in one string
PART_MARKS = 4 << 20  # marks of one part, about
PART_STRINGS = 40_000  # strings of one part, about
HOT = 20_000  # strings under one mark beyond which they are dealt out by windows
NO_ID = (1 << 63) - 1  # an absent id comes after all ids

_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_MANY = 0x7FFF


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of every substring of ``length`` bytes, composed of powers of two."""
    power, base, found, size = data.astype(np.uint64) + np.uint64(1), _BASE, None, 0
    tail_base = np.uint64(1)
    bit = 1
    with np.errstate(over="ignore"):
        while bit <= length:
            if length & bit:
                if found is None:
                    found = power
                else:
                    n = min(len(found) - bit, len(power))
                    found = power[:n] * tail_base + found[bit:bit + n]
                tail_base, size = tail_base * base, size + bit
            if bit * 2 <= length:
                power = power[:-bit] * base + power[bit:]
                base = base * base
            bit *= 2
    return _mixed(found[: len(data) - length + 1])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Block:
    """Some whole texts, their owners, and the marked strings of their windows."""

    def __init__(self, data: bytes, sizes: np.ndarray, owners: np.ndarray, length: int):
        self.data, self.owners, self.length = data, owners, length
        self.mark = min(MARK, length)
        self.ends = np.cumsum(sizes)
        self.start, self.windows, self.value = self._strings()
        self.owner = owners[np.searchsorted(self.ends, self.start, side="right")] if len(self.start) else owners[:0]

    def _strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and mark of every string; none crosses the end of a text."""
        text = np.frombuffer(self.data, np.uint8)
        length = self.length
        begins = self.ends - np.diff(self.ends, prepend=0)
        bound = np.zeros(len(text) + 1, np.int8)  # +1 where a text begins to have windows, -1 behind its last one
        some = self.ends - begins >= length
        bound[begins[some]] += 1
        bound[self.ends[some] - length + 1] -= 1
        found, open_ = [], 0
        for a in range(0, len(text) - length + 1, SLICE):
            z = min(a + SLICE, len(text) - length + 1)
            value = _least(_hashes(text[a:z + length - 1], self.mark), length - self.mark + 1)
            # a text that begins right where the windows of the last one end leaves no gap, so bounds cut as well
            depth = np.cumsum(bound[a:z]) + open_
            open_, inside = int(depth[-1]), depth > 0
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (inside[1:] != inside[:-1])
            new[begins[np.searchsorted(begins, a):np.searchsorted(begins, z)] - a] = True
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(value)))
            start, count = start[inside[start]], count[inside[start]]
            pieces = -(-count // MAX_WINDOWS)
            at = np.repeat(np.arange(len(start)), pieces)
            turn = _places(np.zeros(len(start), np.int64), pieces) * MAX_WINDOWS
            found.append((start[at] + turn + a, np.minimum(count[at] - turn, MAX_WINDOWS), _mixed(value[start][at])))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different marks in rising order, how many strings have each, and whether two owners share it."""
        order = np.argsort(self.value, kind="stable")
        value, owner = self.value[order], self.owner[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, int)
        if not len(first):
            return value, first, np.zeros(0, bool)
        count = np.diff(np.append(first, len(value)))
        return value[first], count, np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first)

    def shared(self, marks: np.ndarray, hot: np.ndarray) -> Shared:
        """Strings under ``marks`` (rising), those under hot ones cut into windows; equal ones counted once."""
        at = np.minimum(np.searchsorted(marks, self.value), max(len(marks) - 1, 0))
        kept = np.flatnonzero(marks[at] == self.value) if len(marks) else np.zeros(0, int)
        split = hot[at[kept]] if len(kept) else np.zeros(0, bool)
        whole, cut = kept[~split], kept[split]
        start = np.concatenate([self.start[whole], _places(self.start[cut], self.windows[cut])])
        windows = np.concatenate([self.windows[whole], np.ones(int(self.windows[cut].sum()), np.int64)])
        owner = np.concatenate([self.owner[whole], np.repeat(self.owner[cut], self.windows[cut])])
        data, more = self.data, self.length - 1
        numbers: dict[bytes, int] = {}
        number = np.fromiter(
            (numbers.setdefault(data[a:a + n + more], len(numbers)) for a, n in zip(start.tolist(), windows.tolist())),
            np.int64, len(start))
        value = np.empty(len(numbers), np.uint64)
        value[number[: len(whole)]] = self.value[whole]
        if len(cut):
            single = np.unique(number[len(whole):])
            texts = list(numbers)
            whole_windows = np.frombuffer(b"".join(texts[i] for i in single.tolist()), np.uint8)
            value[single] = _hashes(whole_windows, self.length)[:: self.length]
        least = np.full(len(numbers), NO_ID)
        np.minimum.at(least, number, owner)
        return Shared(list(numbers), value, least, number, start, windows, owner)


class Shared:
    """Different strings of a block with mark and least owner, and the places of each."""

    def __init__(self, strings, value, least, number, start, windows, owner):
        self.strings, self.value, self.least = strings, value, least
        self.number, self.start, self.windows, self.owner = number, start, windows, owner

    def covered(self, size: int, length: int, number, first, count, least) -> np.ndarray:
        """Bytes under windows that an owner before their own holds: in this block, or by the replies
        ``(number, first window, count, least owner)`` of other blocks."""
        mark = np.zeros(size + 1, np.int32)
        own = self.least[self.number] < self.owner
        self._add(mark, self.start[own], self.windows[own], length)
        if len(number):
            order = np.argsort(self.number, kind="stable")
            begin = np.searchsorted(self.number[order], number)
            places = np.searchsorted(self.number[order], number, side="right") - begin
            place = order[_places(begin, places)]
            reply = np.repeat(np.arange(len(number)), places)
            later = least[reply] < self.owner[place]
            place, reply = place[later], reply[later]
            self._add(mark, self.start[place] + first[reply], count[reply], length)
        return np.cumsum(mark[:-1]) > 0

    @staticmethod
    def _add(mark, start, windows, length):
        np.add.at(mark, start, 1)
        np.add.at(mark, start + windows + length - 1, -1)


def _packed(values: np.ndarray, kind) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, kind).tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def write_blocks(docs: DataFrame) -> DataFrame:
    """``block, rows, sizes, ids, data``: texts of about ``BLOCK_BYTES`` together, in the shared folder.

    A block has a number of its own; only a committed attempt's blocks stand in the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, limit=BLOCK_BYTES):
                texts = [t or b"" for t in part.column("text").to_pylist()]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([_packed(sizes, np.int64)], pa.binary()),
                    pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary()),
                    pa.array([int(sizes.sum())])], ["block", "sizes", "ids", "data", "bytes"])
                number += 1

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stage(texts.mapInArrow(run, "block long, sizes binary, ids array<long>, data binary, bytes long"), "blocks")


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            owners = np.array([NO_ID if d is None else d for d in row["ids"]], np.int64)
            yield row, Block(zstandard.ZstdDecompressor().decompress(row["data"]), _unpacked(row["sizes"], np.int64), owners, length)


def _bits(total: int, each: int) -> int:
    """Bits of a part number, so that a part holds about ``each``."""
    return max(1, (max(total, 1) // each).bit_length())


def _exchange_marks(blocks: DataFrame, length: int, bits: int) -> DataFrame:
    """Per block and part: which of its marks in that part two documents share, and which are hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks(batches, length):
            value, count, several = block.marks()
            part = value >> np.uint64(64 - bits)
            number = np.minimum(count, _MANY).astype(np.uint16) | (several.astype(np.uint16) << np.uint16(15))
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            ends = np.append(cuts[1:], len(part)) if len(cuts) else []
            for lot in range(0, len(cuts), 4096):
                spans = list(zip(cuts[lot:lot + 4096], ends[lot:lot + 4096]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array([row["block"]] * len(spans), pa.int64()),
                    pa.array([value[a:z].astype(np.uint32).tobytes() for a, z in spans], pa.binary()),
                    pa.array([number[a:z].tobytes() for a, z in spans], pa.binary())], ["part", "block", "marks", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        blobs = table.column("marks").to_pylist()
        marks = np.frombuffer(b"".join(blobs), np.uint32)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint16)
        order = np.argsort(marks, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], marks[order][1:] != marks[order][:-1]]))
        sizes = np.diff(np.append(first, len(marks)))
        strings = (counts & np.uint16(_MANY)).astype(np.int64)
        total = np.add.reduceat(strings[order], first)
        shared = (sizes > 1) | np.logical_or.reduceat((counts >> np.uint16(15))[order] > 0, first)
        flags = np.empty(len(marks), np.uint8)
        flags[order] = np.repeat(shared + 2 * (shared & (total > HOT)), sizes)
        out, kept, at = [], [], 0
        for blob in blobs:
            some = flags[at:at + len(blob) // 4]
            own = strings[at:at + len(blob) // 4]
            out.append(zstandard.ZstdCompressor(level=1).compress(some.tobytes()))
            kept.append(int(own[some > 0].sum()))
            at += len(some)
        return pa.Table.from_arrays([
            table.column("block"), table.column("part"), pa.array(out, pa.binary()), pa.array(kept, pa.int64())],
            ["block", "part", "flags", "strings"])

    sent = blocks.select("block", "sizes", "ids", "data").mapInArrow(
        send, "part int, block long, marks binary, counts binary").repartition(1 << min(bits, 14), "part")
    return stage(sent.groupBy("part").applyInArrow(
        answer, "block long, part int, flags binary, strings long"), "marks")


def _shared_of(row: dict, block: Block) -> Shared:
    """The strings of a block whose marks are shared, by the replies of the parts."""
    value, _, _ = block.marks()
    replies = sorted(row["replies"] or [], key=lambda r: r["part"])
    flags = np.concatenate([_unpacked(r["flags"], np.uint8) for r in replies]) if replies else np.zeros(0, np.uint8)
    some = np.flatnonzero(flags)
    return block.shared(value[some], flags[some] > 1)


def _send_strings(blocks: DataFrame, length: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks(batches, length):
            shared = _shared_of(row, block)
            part = (_mixed(shared.value) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(part) else []
            for a, z in zip(cuts, np.append(cuts[1:], len(part)) if len(cuts) else []):
                some = order[a:z]
                strings = [shared.strings[i] for i in some.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(part[some[0]])], pa.int32()), pa.array([row["block"]]),
                    pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(strings))], pa.binary()),
                    *[pa.array([_packed(v, k)], pa.binary()) for v, k in (
                        ([len(s) for s in strings], np.uint32), (some, np.uint32), (shared.least[some], np.int64),
                        (shared.value[some], np.uint32))],
                ], ["part", "block", "strings", "sizes", "numbers", "owners", "marks"])

    return blocks.mapInArrow(
        run, "part int, block long, strings binary, sizes binary, numbers binary, owners binary, marks binary")


def least_owners(strings: list[bytes], owners: np.ndarray, marks: np.ndarray, length: int):
    """Runs of windows with one least owner, over different ``strings``: ``(string, first window, count, least owner)``.

    A string whose mark no other string has can match nothing else; the others go into one index and are streamed
    against it.
    """
    _, group, sizes = np.unique(marks, return_inverse=True, return_counts=True)
    alone = sizes[group] == 1
    counts = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
    lone = np.flatnonzero(alone)
    out = [(lone, np.zeros(len(lone), np.int64), counts[lone], owners[lone])]
    some = np.flatnonzero(~alone)
    if len(some):
        chosen = [strings[i] for i in some.tolist()]
        match, least, starts = RunIndex(chosen, owners[some], length).matching_statistics(chosen)
        window = _places(starts, counts[some])  # positions with a whole window; all are matched at full length
        string = np.repeat(np.arange(len(some)), counts[some])
        value = np.where(match[window] >= length, least[window], NO_ID)
        first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (string[1:] != string[:-1])]))
        out.append((some[string[first]], window[first] - starts[string[first]],
                    np.diff(np.append(first, len(window))), value[first]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _reply(length: int):
    def run(table: pa.Table) -> pa.Table:
        strings: dict[bytes, int] = {}
        blocks, numbers, member, owner, marks = [], [], [], [], []
        for row in table.to_pylist():
            data = zstandard.ZstdDecompressor().decompress(row["strings"])
            sizes = _unpacked(row["sizes"], np.uint32).astype(np.int64)
            ends = np.cumsum(sizes)
            member.append(np.fromiter(
                (strings.setdefault(data[a:z], len(strings)) for a, z in zip((ends - sizes).tolist(), ends.tolist())),
                np.int64, len(sizes)))
            numbers.append(_unpacked(row["numbers"], np.uint32))
            owner.append(_unpacked(row["owners"], np.int64))
            marks.append(_unpacked(row["marks"], np.uint32))
            blocks.append(np.full(len(sizes), row["block"]))
        blocks, numbers, member, owner, marks = map(np.concatenate, (blocks, numbers, member, owner, marks))
        least = np.full(len(strings), NO_ID)
        np.minimum.at(least, member, owner)
        mark = np.empty(len(strings), np.uint32)
        mark[member] = marks
        string, first, count, value = least_owners(list(strings), least, mark, length)
        # back to every block that sent the string and does not know of an owner so early
        order = np.argsort(string, kind="stable")
        begin = np.searchsorted(string[order], member)
        runs = np.searchsorted(string[order], member, side="right") - begin
        run = order[_places(begin, runs)]
        who = np.repeat(np.arange(len(member)), runs)
        news = value[run] < owner[who]
        run, who = run[news], who[news]
        by = np.argsort(blocks[who], kind="stable")
        run, who = run[by], who[by]
        cuts = np.flatnonzero(np.concatenate([[True], blocks[who][1:] != blocks[who][:-1]])) if len(who) else []
        spans = list(zip(cuts, np.append(cuts[1:], len(who)) if len(cuts) else []))

        def lots(values, kind):
            return pa.array([_packed(values[a:z], kind) for a, z in spans], pa.binary())

        return pa.Table.from_arrays([
            pa.array([int(blocks[who[a]]) for a, _ in spans], pa.int64()),
            lots(numbers[who], np.uint32), lots(first[run], np.uint16), lots(count[run], np.uint16),
            lots(value[run], np.int64)], ["block", "numbers", "firsts", "counts", "owners"])

    return run


_SPANS = "array<struct<start: long, end: long>>"


def _finish(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for row, block in _blocks(batches, length):
        shared = _shared_of(row, block)
        found = [[_unpacked(r[c], k) for r in row["found"] or []] for c, k in (
            ("numbers", np.uint32), ("firsts", np.uint16), ("counts", np.uint16), ("owners", np.int64))]
        parts = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in found]
        text = np.frombuffer(block.data, np.uint8)
        gone = shared.covered(len(text), length, *parts)
        ends = block.ends
        begins = ends - np.diff(ends, prepend=0)
        edge = np.zeros(len(text) + 1, bool)  # where a removed run may begin or end: its own edges and text ends
        edge[0] = edge[-1] = True
        edge[1:-1] = gone[1:] != gone[:-1]
        edge[begins], edge[ends] = True, True
        cut = np.flatnonzero(edge)
        run_start, run_end = cut[:-1], cut[1:]
        removed = gone[run_start] if len(text) else np.zeros(0, bool)
        run_start, run_end = run_start[removed], run_end[removed]
        doc = np.searchsorted(ends, run_start, side="right")
        spans = np.bincount(doc, minlength=len(ends)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(spans)]).astype(np.int32)
        structs = pa.StructArray.from_arrays(
            [pa.array(run_start - begins[doc]), pa.array(run_end - begins[doc])], ["start", "end"])
        kept = text[~gone].tobytes()
        left = row_sums((~gone).astype(np.int64), ends - begins)
        kept_ends = np.cumsum(left)
        yield pa.RecordBatch.from_arrays([
            pa.array(row["ids"], pa.int64()), pa.array(ends - begins),
            pa.ListArray.from_arrays(pa.array(offsets), structs),
            pa.array([kept[a:z] for a, z in zip((kept_ends - left).tolist(), kept_ends.tolist())], pa.binary()),
        ], ["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row of ``docs(doc_id, text)``.

    ``spans`` are the maximal runs of removed bytes (start, end exclusive), ``kept`` the other bytes. A byte is
    removed if a string of ``length`` bytes that covers it also starts in a document with a smaller id; strings are
    judged on the input.

    NULL texts count as empty; texts shorter than ``length`` lose nothing. Rows of one id do not remove each other's
    bytes. A NULL id comes after all ids. Further columns are not read. An empty table gives an empty result.
    """
    blocks = write_blocks(docs)
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    plain = blocks.select("block", "sizes", "ids", "data")
    marks = _exchange_marks(plain, length, _bits(total // 16, PART_MARKS))
    replies = marks.groupBy("block").agg(F.collect_list(F.struct("part", "flags")).alias("replies"))
    bits = _bits(marks.agg(F.sum("strings")).first()[0] or 0, PART_STRINGS)
    asked = plain.join(replies.hint("shuffle_hash"), "block", "left")
    strings = _send_strings(asked, length, bits).repartition(1 << min(bits, 14), "part")
    found = stage(strings.groupBy("part").applyInArrow(
        _reply(length), "block long, numbers binary, firsts binary, counts binary, owners binary"), "repeats")
    found = found.groupBy("block").agg(F.collect_list(F.struct("numbers", "firsts", "counts", "owners")).alias("found"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _finish(batches, length)

    return asked.join(found.hint("shuffle_hash"), "block", "left").mapInArrow(
        finish, f"doc_id long, n_bytes long, spans {_SPANS}, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
