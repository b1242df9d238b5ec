"""Fill-in-middle rearrangement over texts kept as seekable compressed frames.

A text is stored as independent zstandard frames of about 64 KiB, with the units, code points and bytes up to the end
of each. A cut at a unit decompresses the one frame that holds it; whole frames between the cuts go into the output as
they are. Digests and the way back stream the frames of an output in order, one at a time.

Units are runs of ASCII letters, or single other code points. Lengths count code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voidscope.llm.common import slices
from voidscope.session import stage

FRAME_BYTES = 64 << 10
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
PLAIN_FROM = 90  # of 100
SPM_BELOW = 20  # of 100
LEVEL = 3

_FRAMES = "frames array<binary>, units array<long>, chars array<long>, bytes array<long>"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _begins(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes where a code point begins, and where a unit begins if ``data`` is a text of its own."""
    char = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    unit = char.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    return char, unit


def _frame_ends(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all frames, none inside a code point, and how many each text has (an empty text none)."""
    out, counts = [], np.zeros(len(begins), np.int64)
    for i in np.flatnonzero(ends > begins).tolist():
        at, end = int(begins[i]), int(ends[i])
        while end - at > size:
            cut = at + size
            while cut < end and (data[cut] & 0xC0) == 0x80:
                cut += 1
            out.append(cut)
            counts[i] += 1
            at = cut
        if at < end:
            out.append(end)
            counts[i] += 1
    return np.array(out, np.int64), counts


def _lists(values: list, counts: np.ndarray, kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def write_frames(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The texts of ``docs(doc_id, text)`` as frames in the shared folder.

    One row per row: ``doc_id, marked, frames, units, chars, bytes``; the last three count up to the end of each
    frame, ``marked`` says whether the text holds one of the markers. NULL texts count as empty, without a frame.
    Further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in slices(batch):
                texts = [t or b"" for t in part.column("text").to_pylist()]
                joined = b"".join(texts)
                data = np.frombuffer(joined, np.uint8)
                ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
                begins = ends - np.diff(ends, prepend=0)
                char, unit = _begins(data)
                first = begins[ends > begins]
                unit[first] = char[first]
                cuts, counts = _frame_ends(data, begins, ends, frame_bytes)
                starts = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
                frames = [packer.compress(joined[a:z]) for a, z in zip(starts.tolist(), cuts.tolist())]
                own = np.repeat(begins, counts)
                columns = [_lists(frames, counts, pa.binary())]
                for mask in (unit, char):
                    total = np.concatenate([[0], np.cumsum(mask)])
                    columns.append(_lists((total[cuts] - total[own]) if len(cuts) else [], counts, pa.int64()))
                columns.append(_lists(cuts - own if len(cuts) else [], counts, pa.int64()))
                marked = pa.array([any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), marked, *columns], ["doc_id", "marked", "frames", "units", "chars", "bytes"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stage(rows.mapInArrow(run, f"doc_id {kind}, marked boolean, {_FRAMES}"), "frames")


class Frames:
    """Reads ranges of one framed text; holds one decompressed frame."""

    def __init__(self, frames, units, chars, size):
        self.frames, self.units, self.chars, self.size = frames, units, chars, size
        self._reader = zstandard.ZstdDecompressor()
        self._at, self._open = -1, b""

    def frame(self, j: int) -> bytes:
        if j != self._at:
            self._at, self._open = j, self._reader.decompress(self.frames[j])
        return self._open

    def seek(self, unit: int) -> tuple[int, int, int]:
        """Frame, byte in it, and code points before the unit of this number; the end for the number of units."""
        if not self.units or unit >= self.units[-1]:
            return len(self.frames), 0, self.chars[-1] if self.chars else 0
        if unit == 0:
            return 0, 0, 0
        j = int(np.searchsorted(self.units, unit, side="right"))
        before, chars = (self.units[j - 1], self.chars[j - 1]) if j else (0, 0)
        data = np.frombuffer(self.frame(j), np.uint8)
        char, begin = _begins(data)
        places = np.flatnonzero(begin)
        if len(places) > self.units[j] - before:
            places = places[1:]  # the frame opens inside a unit
        at = int(places[unit - before])
        return j, at, chars + int(char[:at].sum())

    def pieces(self, start: tuple[int, int], end: tuple[int, int]) -> Iterator[tuple[bytes, bool]]:
        """What lies between two places: ``(frame, True)`` for a whole frame as it is, ``(bytes, False)`` for a part."""
        (j, a), (last, z) = start, end
        while j < last:
            if a:
                yield self.frame(j)[a:], False
            else:
                yield self.frames[j], True
            j, a = j + 1, 0
        if z > a:
            yield self.frame(last)[a:z], False


def _numbers(doc_id, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def _rearranged(row: dict, seed: int, packer) -> tuple[int, str, int | None, int | None, list[bytes]]:
    text = Frames(row["frames"], row["units"], row["chars"], row["bytes"])
    n = text.units[-1] if text.units else 0
    h = _numbers(row["doc_id"], seed)
    if n == 0 or row["marked"] or h[2] % 100 >= PLAIN_FROM:
        return n, "plain", None, None, row["frames"]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    *first, before = text.seek(low)
    *second, until = text.seek(high)
    begin, a, b, end = (0, 0), tuple(first), tuple(second), (len(text.frames), 0)
    form = "spm" if h[3] % 100 < SPM_BELOW else "psm"
    parts = [(PREFIX, begin, a), (SUFFIX, b, end), (MIDDLE, a, b)]
    if form == "spm":
        parts[0], parts[1] = parts[1], parts[0]
    out, loose = [], []

    def close():
        if loose:
            out.append(packer.compress(b"".join(loose)))
            loose.clear()

    for marker, start, stop in parts:
        loose.append(marker)
        for piece, whole in text.pieces(start, stop):
            if whole:
                close()
                out.append(piece)
            else:
                loose.append(piece)
    close()
    return n, form, before, until - before, out


def rearrange(frames: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row of :func:`write_frames`.

    ``output`` holds the rearranged text as frames in order. A row's numbers come from the seed and its id (NULL: no
    digits), so rows of one id and text give one result. Empty texts, texts that hold a marker and a tenth of
    the others stay plain, with NULL lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for some in _bounded(batch, "frames"):
                found = [_rearranged(row, seed, packer) for row in some.to_pylist()]
                n, form, prefix, middle, output = zip(*found)
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()), pa.array(output, pa.list_(pa.binary()))],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = frames.schema["doc_id"].dataType.simpleString()
    return frames.mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output array<binary>")


def _bounded(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``limit`` bytes of frames."""
    if batch.num_rows == 0:
        return
    lists = batch.column(column)
    sizes = pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = total[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
    cuts = np.flatnonzero(np.diff(ends // limit)) + 1
    start = 0
    for end in [*cuts.tolist(), batch.num_rows]:
        yield batch.slice(start, end - start)
        start = end


def _find(frames: list[bytes], reader, markers: list[bytes]) -> tuple[list[int], list[int]]:
    """Where the markers first stand, one after the other, and where each frame ends."""
    found, ends, size, carried = [], [], 0, b""
    for frame in frames:
        data = carried + reader.decompress(frame)
        offset, at = size - len(carried), 0
        while len(found) < len(markers) and (at := data.find(markers[len(found)], at)) >= 0:
            found.append(offset + at)
            at += len(markers[0])
        size = offset + len(data)
        ends.append(size)
        # a marker may go on in the next frame; what stands before or inside a found one cannot
        keep = min(len(markers[0]) - 1, size - (found[-1] + len(markers[0]) if found else 0))
        carried = data[len(data) - keep:] if keep > 0 else b""
    return found, ends


def restored(output: list[bytes], form: str) -> Iterator[bytes]:
    """The text as it was, piece by piece, from the frames of an output and its form."""
    reader = zstandard.ZstdDecompressor()
    if form == "plain":
        for frame in output:
            yield reader.decompress(frame)
        return
    markers = [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
    places, ends = _find(output, reader, markers)
    if len(places) < len(markers):
        raise ValueError(f"an output of form {form} lacks a marker")
    total = ends[-1]
    spans = dict(zip(markers, zip([p + len(m) for p, m in zip(places, markers)], [*places[1:], total])))
    text = Frames(output, None, None, ends)
    for marker in (PREFIX, MIDDLE, SUFFIX):
        start, end = spans[marker]
        j = int(np.searchsorted(ends, start, side="right"))
        while start < end:
            offset = ends[j - 1] if j else 0
            yield text.frame(j)[start - offset:end - offset]
            start, j = ends[j], j + 1


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            for some in _bounded(batch, "output"):
                sums = []
                for frames, form in zip(some.column("output").to_pylist(), some.column("form").to_pylist()):
                    whole, back = hashlib.sha256(), hashlib.sha256()
                    for frame in frames:
                        whole.update(reader.decompress(frame))
                    for piece in restored(frames, form):
                        back.update(piece)
                    sums.append((whole.hexdigest(), back.hexdigest()))
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(c) for c in kept], *[pa.array(list(x), pa.string()) for x in zip(*sums)]],
                    [*kept, "output_sha256", "restored_sha256"])

    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, "
             "output_sha256 string, restored_sha256 string")


def output_texts(found: DataFrame) -> DataFrame:
    """``doc_id, form, output`` with the rearranged text as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            for some in _bounded(batch, "output"):
                texts = [b"".join(map(reader.decompress, frames)) for frames in some.column("output").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("form"), pa.array(texts, pa.binary())], ["doc_id", "form", "output"])

    kind = found.schema["doc_id"].dataType.simpleString()
    out = found.select("doc_id", "form", "output").mapInArrow(run, f"doc_id {kind}, form string, output binary")
    return out.withColumn("output", F.col("output").cast("string"))
