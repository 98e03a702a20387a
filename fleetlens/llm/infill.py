"""Fill-in-middle over texts that are kept as seekable zstandard frames."""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import record, slim, small_batches

FRAME_BYTES = 1 << 16  # text bytes of a frame
LEVEL = 1

# Fixed values of the output: what prefix, suffix and middle start with.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

# The table of frames is itself a frame that decoders skip: magic, size, entries, trailer.
_SKIPPED = struct.Struct("<II")
_ENTRY = struct.Struct("<IIII")  # stored bytes, text bytes, units, code points
_TRAILER = struct.Struct("<IB3x")  # entries, whether the text has a marker
_MAGIC = 0x184D2A5E

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _unit_starts(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of some UTF-8 bytes: which start a code point, and which start a unit, a run of ASCII
    letters or one other code point. ``inside``: a run of letters comes before."""
    points = (data & 0xC0) != 0x80
    letters = _LETTER[data]
    goes_on = letters.copy()
    goes_on[1:] &= letters[:-1]
    if len(data):
        goes_on[0] &= inside
    return points, points & ~goes_on


class Framed:
    """A text as independent frames, with how many bytes, units and code points come before each."""

    def __init__(self, blobs: list, entries: list[tuple[int, int, int, int]], marked: bool):
        self.blobs, self.entries, self.marked = blobs, entries, marked
        _, sizes, units, points = zip(*entries, strict=True) if entries else ((), (), (), ())
        self.bytes = list(accumulate(sizes, initial=0))
        self.units = list(accumulate(units, initial=0))
        self.points = list(accumulate(points, initial=0))

    @classmethod
    def read(cls, stored: bytes) -> Framed:
        view = memoryview(stored)
        count, marked = _TRAILER.unpack(view[-_TRAILER.size :])
        table = view[len(view) - _TRAILER.size - count * _ENTRY.size : len(view) - _TRAILER.size]
        entries, blobs, at = list(_ENTRY.iter_unpack(table)), [], 0
        for entry in entries:
            blobs.append(view[at : at + entry[0]])
            at += entry[0]
        return cls(blobs, entries, bool(marked))

    def stored(self) -> bytes:
        """One zstandard stream: the frames, then the table that says where each one is."""
        table = b"".join(_ENTRY.pack(*e) for e in self.entries) + _TRAILER.pack(len(self.entries), self.marked)
        return b"".join([*self.blobs, _SKIPPED.pack(_MAGIC, len(table)), table])

    def frame(self, i: int) -> bytes:
        return _tools()[1].decompress(self.blobs[i])

    def inside(self, i: int, data: np.ndarray) -> bool:
        """Whether frame ``i`` starts within a run of letters that the one before began."""
        return bool(len(data)) and int(_unit_starts(data, False)[1].sum()) != self.entries[i][2]

    def at_unit(self, unit: int) -> tuple[int, int, int]:
        """Where a unit starts: frame, byte and code point in it. Only that frame is decompressed."""
        if unit >= self.units[-1]:
            return len(self.blobs), 0, 0
        i = bisect_right(self.units, unit) - 1
        data = np.frombuffer(self.frame(i), np.uint8)
        points, starts = _unit_starts(data, self.inside(i, data))
        place = int(np.flatnonzero(starts)[unit - self.units[i]])
        return i, place, int(np.count_nonzero(points[:place]))

    def at_byte(self, place: int) -> tuple[int, int, int]:
        if place >= self.bytes[-1]:
            return len(self.blobs), 0, 0
        i = bisect_right(self.bytes, place) - 1
        return i, place - self.bytes[i], 0

    def pieces(self) -> Iterator[bytes]:
        for i in range(len(self.blobs)):
            yield self.frame(i)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for piece in self.pieces():
            digest.update(piece)
        return digest.hexdigest()

    def find(self, mark: bytes, start: int) -> int:
        """The first place of ``mark`` at byte ``start`` or after it; -1 if there is none."""
        i, skip, _ = self.at_byte(start)
        held, base = b"", start
        while i < len(self.blobs):
            held += self.frame(i)[skip:]
            found = held.find(mark)
            if found >= 0:
                return base + found
            keep = min(len(held), len(mark) - 1)
            base += len(held) - keep
            held, skip, i = held[len(held) - keep :], 0, i + 1
        return -1


_TOOLS: list = []


def _tools() -> list:
    if not _TOOLS:  # one of each for a worker process
        _TOOLS.extend([zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()])
    return _TOOLS


class Framing:
    """Puts frames together: bytes are gathered into new frames, whole frames taken as they are."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.blobs, self.entries = frame_bytes, [], []
        self.held, self.inside = bytearray(), False

    def _flush(self) -> None:
        if not self.held:
            return
        data = np.frombuffer(self.held, np.uint8)
        points, starts = _unit_starts(data, self.inside)
        blob = _tools()[0].compress(bytes(self.held))
        self.blobs.append(blob)
        self.entries.append((len(blob), len(data), int(np.count_nonzero(starts)), int(np.count_nonzero(points))))
        self.inside = bool(_LETTER[data[-1]])
        del data
        self.held = bytearray()

    def add(self, raw: bytes, inside: bool = False) -> None:
        """``inside``: a run of letters before goes on; looked at where ``raw`` starts a frame."""
        if len(self.held) + len(raw) > self.frame_bytes:
            self._flush()
        if not self.held:
            self.inside = inside
        self.held += raw

    def add_part(self, source: Framed, first: tuple[int, int, int], after: tuple[int, int, int]) -> None:
        """What ``source`` has from one place to another: whole frames aren't even decompressed."""
        (i, start, _), (last, end, _) = first, after
        while (i, start) < (last, end):
            if start == 0 and i < last:
                self._flush()
                self.blobs.append(source.blobs[i])
                self.entries.append(source.entries[i])
            else:
                raw = source.frame(i)
                inside = start == 0 and source.inside(i, np.frombuffer(raw, np.uint8))
                self.add(raw[start : end if i == last else len(raw)], inside)
            i, start = i + 1, 0

    def done(self, marked: bool = False) -> Framed:
        self._flush()
        return Framed(self.blobs, self.entries, marked)


def framed(text: np.ndarray, frame_bytes: int = FRAME_BYTES) -> Framed:
    """Frames of some UTF-8 bytes; only one frame's bytes are copied at a time."""
    made, at, marked, tail, inside = Framing(frame_bytes), 0, False, b"", False
    while at < len(text):
        end = min(len(text), at + frame_bytes)
        back = end
        while end < len(text) and back > at and text[back] & 0xC0 == 0x80:
            back -= 1  # never within a code point
        end = back if back > at else end
        raw = text[at:end].tobytes()
        near = tail + raw
        marked = marked or any(m in near for m in (PREFIX, SUFFIX, MIDDLE))
        made._flush()
        made.add(raw, inside)
        inside, tail, at = bool(_LETTER[raw[-1]]), raw[-2:], end
    return made.done(marked)


def transformed(text: Framed, draws: tuple[int, int, int, int], plain_from: int, spm_below: int) -> tuple[Framed, dict]:
    """The text with its middle at the end, and what was done. ``draws`` are four random numbers."""
    n = text.units[-1]
    if not n or text.marked or draws[2] % 100 >= plain_from:
        return text, {"form": "plain", "prefix_chars": None, "middle_chars": None}
    cuts = sorted(d % (n + 1) for d in draws[:2])
    first, second = (text.at_unit(c) for c in cuts)
    begin, end = (0, 0, 0), (len(text.blobs), 0, 0)
    chars = [text.points[i] + points for i, _, points in (first, second)]
    parts = {PREFIX: (begin, first), SUFFIX: (second, end), MIDDLE: (first, second)}
    form = "spm" if draws[3] % 100 < spm_below else "psm"
    made = Framing()
    for mark in (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE):
        made.add(mark)
        made.add_part(text, *parts[mark])
    return made.done(True), {"form": form, "prefix_chars": chars[0], "middle_chars": chars[1] - chars[0]}


def rebuilt(output: Framed, form: str) -> Framed:
    """The text from an output and its form alone."""
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    places, at = {}, 0
    for mark in order:
        at = output.find(mark, at)
        if at < 0 or (mark == order[0] and at):
            raise ValueError(f"not an output of the form {form}")
        places[mark] = at
        at += len(mark)
    ends = {order[0]: places[order[1]], order[1]: places[order[2]], order[2]: output.bytes[-1]}
    made = Framing()
    for mark in (PREFIX, MIDDLE, SUFFIX):
        made.add_part(output, output.at_byte(places[mark] + len(mark)), output.at_byte(ends[mark]))
    return made.done()


def _mapped(frame: DataFrame, schema: str, work) -> DataFrame:
    """``work`` on the values of each row, by column name, to the row's new values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("id").type
            rows = [work(**dict(zip(batch.schema.names[1:], row, strict=True))) for row in _rows(batch)]
            types = dict(zip(names, kinds, strict=True))
            yield record(
                id=batch.column("id").cast(id_type),
                **{n: pa.array([r[n] for r in rows], types[n]) for n in names[1:]},
            )

    names = [c.split()[0] for c in schema.split(", ")]
    known = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [known.get(c.split()[1]) for c in schema.split(", ")]
    return frame.mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    columns = batch.columns[1:]
    for i in range(batch.num_rows):  # one row's bytes at a time
        yield tuple(c[i].as_py() for c in columns)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``(id_col, frames)``: each whole text as a zstandard stream of independent frames.

    At its end is a table of the bytes, units and code points of each frame, so that a
    unit is found by decompressing one frame, and whether the text has one of the three
    markers. A null or empty text has no frames. Rows are handled one by one: repeated
    ids come out repeated, a null id stays null; other columns are not looked at.
    """
    frame = slim(docs, id_col, text_col)
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in small_batches(batches):
            at = texts.starts.tolist()
            stored = [framed(texts.data[a:b], frame_bytes).stored() for a, b in zip(at, at[1:], strict=False)]
            yield record(id=texts.ids, frames=pa.array(stored, pa.binary()))

    return frame.mapInArrow(run, f"id {kind}, frames binary").withColumnRenamed("id", id_col)


def transform(
    packed: DataFrame, id_col: str = "doc_id", frames_col: str = "frames", seed: str = "1", plain_from: int = 90, spm_below: int = 20
) -> DataFrame:
    """``(id_col, n, form, prefix_chars, middle_chars, output)`` of packed texts.

    A text of ``n`` units is cut at two places drawn from a hash of ``seed`` and its id (a
    null id counts as an empty one). ``output`` is again a stream of frames: only the
    frames with a cut are decompressed, all others are taken as they are. ``form`` is
    psm, spm or plain; plain texts, for which two of the columns are null, are those that
    are empty, have a marker in them, or draw ``plain_from`` or more of a hundred.
    """

    def work(draw: str, frames: bytes) -> dict:
        text = Framed.read(frames)
        draws = tuple(int(draw[i : i + 8], 16) for i in (0, 8, 16, 24))
        output, told = transformed(text, draws, plain_from, spm_below)
        return {"n": text.units[-1], "output": output.stored(), **told}

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    frame = packed.select(F.col(id_col).alias("id"), drawn.alias("draw"), F.col(frames_col).alias("frames"))
    kind = frame.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    return _mapped(frame, schema, work).withColumnRenamed("id", id_col)


def restore(coded: DataFrame, id_col: str = "doc_id", form_col: str = "form", output_col: str = "output") -> DataFrame:
    """``(id_col, frames)``: the packed text, exactly as it was, from an output and its form alone."""
    frame = coded.select(F.col(id_col).alias("id"), F.col(form_col).alias("form"), F.col(output_col).alias("output"))
    kind = frame.schema["id"].dataType.simpleString()

    def work(form: str, output: bytes) -> dict:
        return {"frames": rebuilt(Framed.read(output), form).stored()}

    return _mapped(frame, f"id {kind}, frames binary", work).withColumnRenamed("id", id_col)


def unpack(packed: DataFrame, id_col: str = "doc_id", frames_col: str = "frames") -> DataFrame:
    """``(id_col, text)`` of packed texts."""
    frame = packed.select(F.col(id_col).alias("id"), F.col(frames_col).alias("frames"))
    kind = frame.schema["id"].dataType.simpleString()

    def work(frames: bytes) -> dict:
        return {"text": b"".join(Framed.read(frames).pieces()).decode("utf-8", "replace")}

    return _mapped(frame, f"id {kind}, text string", work).withColumnRenamed("id", id_col)


def with_digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``coded`` with the SHA-256 of its output and of the text rebuilt from output and form, in
    place of the output. Frames are decompressed in order, one at a time."""
    others = ["n", "form", "prefix_chars", "middle_chars"]
    frame = coded.select(F.col(id_col).alias("id"), *others, "output")
    kind = frame.schema["id"].dataType.simpleString()

    def work(form: str, output: bytes, **told: object) -> dict:
        whole = Framed.read(output)
        return {**told, "form": form, "output_sha256": whole.sha256(), "restored_sha256": rebuilt(whole, form).sha256()}

    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return _mapped(frame, schema, work).withColumnRenamed("id", id_col)
