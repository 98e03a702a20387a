"""Token ids in files of length-delimited records with masked checksums, and an offset index."""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm.checksums import crc32c, masked
from fleetlens.llm.common import record, slim, small_batches, written
from fleetlens.session import work_folder

FILE_BYTES = 256 << 20  # a task begins another file beyond that
SPLIT_BYTES = 8 << 20  # what one task reads back at least
READ_BYTES = 2 << 20  # record bytes handled at once; one longer record is handled by itself
SLICE_BYTES = 1 << 20  # text bytes split into words at once
CACHE_ENTRIES = 1 << 17  # runs whose ids a worker remembers, and as many that it met before these
OTHER_ENTRIES = 1 << 13  # and words that are encoded whole
CACHED_BYTES = 64  # longer words are encoded each time

# A record is its length (8 bytes), the length's masked checksum (4), that many bytes, and their
# masked checksum (4), all little-endian. The bytes are one sequence: bytes of an id (1), length
# of the document's id as text (4; NO_ID if it has none), that text in UTF-8, and the ids.
FRAME, NO_ID = 16, 0xFFFFFFFF
# An entry of the index: where the record begins, its bytes with all around them, ids before it
# in the file, ids in it.
ENTRY = np.dtype([("offset", "<u8"), ("size", "<u8"), ("first", "<u8"), ("n", "<u8")])

_BLANKS = [bytes([b]) for b in (0x20, *range(0x09, 0x0E))]

# Text of these alone (ASCII but for controls, composed Latin letters, usual marks) stays as it is when
# it is normalized, but for capitals, and falls into the runs that the vocabulary's pattern finds:
# endings after an apostrophe, letters, single digits, and what is neither nor blank.
_PLAIN = re.compile("[\t-\r -~¡-©«¬®-±´¶-¸»¿-įı-ſ‐-‧€]*")
_PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[^\t-\r 0-9a-zÀ-ÖØ-öø-ſ]+")


def _is_plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None and "<|" not in text


class _Parts(dict):
    """Packed ids of each run of plain text, from the library's model; the latest ones are kept."""

    def __init__(self, model):
        super().__init__()
        self.model, self.older = model, {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.letters = {b: letters[b] for b in range(256)}  # how byte-level vocabularies write bytes

    def __missing__(self, part: str) -> bytes:
        packed = self.older.pop(part, None)
        if packed is None:
            written = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            found = self.model.tokenize(written)
            packed = array("I", [token.id for token in found]).tobytes()
            if len(part) > CACHED_BYTES:
                return packed
        if len(self) >= CACHE_ENTRIES:  # what isn't met again goes the next time
            self.older = dict(self)
            self.clear()
        self[part] = packed
        return packed


class Words(dict):
    """Packed ids of each word by its bytes, from the tokenizers library.

    The vocabulary's rules never look across white space: its pattern skips it, no added
    token has any or asks for what is around it, and nothing composes with it. So a
    text's ids are those of its words one after the other. Plain text goes to the library's
    model run by run, and a run that was seen before isn't encoded again; other words go
    through all of the library's steps.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.parts = _Parts(self.tokenizer.model)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if _is_plain(text):
            return self.plain(text)
        packed = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= CACHED_BYTES:
            if len(self) >= OTHER_ENTRIES:
                self.clear()
            self[word] = packed
        return packed

    def plain(self, text: str) -> bytes:
        parts = self.parts
        return b"".join([parts[part] for part in _PARTS.findall(text.lower())])

    def encode(self, text: np.ndarray) -> np.ndarray:
        """Ids of a whole text in UTF-8; a long one is split between words as it is read."""
        parts, at, want = [], 0, SLICE_BYTES
        while at < len(text):
            raw = text[at : at + want].tobytes()
            if at + want < len(text):
                cut = max(raw.rfind(b) for b in _BLANKS)
                if cut < 0:
                    want *= 2  # no word ends here yet
                    continue
                raw = raw[: cut + 1]
            whole = raw.decode("utf-8", "replace")
            parts.append(self.plain(whole) if _is_plain(whole) else b"".join([self[word] for word in raw.split()]))
            at, want = at + len(raw), SLICE_BYTES
        return np.frombuffer(b"".join(parts), "<u4")


@cache
def _words(path: str) -> Words:
    """One for each worker process and vocabulary file, which every machine has."""
    return Words(path)


def serialized(doc: str | None, ids: np.ndarray, width: int) -> bytes:
    name = (doc or "").encode()
    size = NO_ID if doc is None else len(name)
    return bytes([width]) + size.to_bytes(4, "little") + name + ids.astype(f"<u{width}").tobytes()


def parsed(data: memoryview) -> tuple[str | None, np.ndarray]:
    width, size = data[0], int.from_bytes(data[1:5], "little")
    at = 5 + (0 if size == NO_ID else size)
    return None if size == NO_ID else bytes(data[5:at]).decode(), np.frombuffer(data[at:], f"<u{width}").astype("<u4")


def framed(sequences: list[bytes]) -> list[bytes]:
    """Records of serialized sequences."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    data = np.frombuffer(b"".join(sequences), np.uint8)
    ends = masked(crc32c(data, np.concatenate([[0], np.cumsum(sizes)]))).astype("<u4")
    lengths = sizes.astype("<u8").view(np.uint8)
    heads = masked(crc32c(lengths, np.arange(len(sizes) + 1) * 8)).astype("<u4")
    return [
        b"".join([size.tobytes(), head.tobytes(), s, end.tobytes()])
        for size, head, s, end in zip(sizes.astype("<u8"), heads, sequences, ends, strict=True)
    ]


def unframed(data: bytes, sizes: np.ndarray, where: str) -> list[memoryview]:
    """The sequences of records that follow each other; raises if one isn't as it was written."""
    view, ends = memoryview(data), np.cumsum(sizes)
    begins = ends - sizes
    raw = np.frombuffer(data, np.uint8)
    heads = raw[begins[:, None] + np.arange(12)]
    lengths = np.ascontiguousarray(heads[:, :8]).view("<u8")[:, 0]
    kept = np.ascontiguousarray(heads[:, 8:]).view("<u4")[:, 0]
    if (masked(crc32c(np.ascontiguousarray(heads[:, :8]).reshape(-1), np.arange(len(sizes) + 1) * 8)) != kept).any():
        raise ValueError(f"{where}: the length of a record doesn't have its checksum")
    if (lengths + np.uint64(FRAME) != sizes.astype(np.uint64)).any():
        raise ValueError(f"{where}: a record is not as long as the index says")
    out = [view[a + 12 : b - 4] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    found = crc32c(np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum(lengths.astype(np.int64))]))
    tails = np.ascontiguousarray(raw[ends[:, None] + np.arange(-4, 0)]).view("<u4")[:, 0]
    if (masked(found) != tails).any():
        raise ValueError(f"{where}: a record doesn't have its checksum")
    return out


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if ":" in path.split("/", 1)[0]:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class _Files:
    """The record files of one task, each with its index next to it.

    A file gets its name when it is whole. The name follows from the task's number, so a
    task that runs again puts the same bytes in the same place.
    """

    def __init__(self, path: str, part: int, most_bytes: int):
        self.most_bytes = most_bytes
        self.store, self.base = _store(path)
        self.store.create_dir(self.base, recursive=True)
        self.part, self.number, self.sink = part, 0, None
        self.done: list[tuple[str, int, int, int]] = []

    def add(self, records: list[bytes], counts: list[int]) -> None:
        for data, n in zip(records, counts, strict=True):
            if self.sink is not None and self.at + len(data) > self.most_bytes:
                self.close()
            if self.sink is None:
                self.name = f"part-{self.part:06d}-{self.number:04d}"
                self.draft = f"{self.base}/.{self.name}-{uuid.uuid4().hex}"
                self.sink, self.at, self.ids, self.entries = self.store.open_output_stream(self.draft), 0, 0, []
            self.sink.write(data)
            self.entries.append((self.at, len(data), self.ids, n))
            self.at += len(data)
            self.ids += n

    def close(self) -> None:
        if self.sink is None:
            return
        self.sink.close()
        with self.store.open_output_stream(f"{self.draft}.index") as index:
            index.write(np.array(self.entries, ENTRY).tobytes())
        self.store.move(f"{self.draft}.index", f"{self.base}/{self.name}.index")
        self.store.move(self.draft, f"{self.base}/{self.name}.records")
        self.done.append((self.name, len(self.entries), self.ids, self.at))
        self.sink, self.number = None, self.number + 1


def write_records(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the ids of each whole text, and ``end_id`` after them, to files in the folder ``path``.

    Gives the table of files, itself written: ``(path, file, records, ids, bytes)``. The
    files in the order of their names hold the documents by ascending id, null ids first;
    of rows that share an id those with equal texts are next to each other, each row a
    record. A null or empty text has only ``end_id``. Other columns are not looked at.

    ``vocabulary`` is a file of the tokenizers library, used without special tokens at
    either end. Ids take two bytes where the vocabulary allows it, else four. Rows are
    dealt by id, hash of the text and row number, so that many rows of one id are split.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, files = _words(vocabulary), _Files(path, TaskContext.get().partitionId(), file_bytes)
        for texts in small_batches(batches):
            at = texts.starts.tolist()
            ids = [np.append(known.encode(texts.data[a:b]), np.uint32(end_id)) for a, b in zip(at, at[1:], strict=False)]
            names = texts.ids.to_pylist()
            files.add(framed([serialized(d, x, known.width) for d, x in zip(names, ids, strict=True)]), [len(x) for x in ids])
        files.close()
        pa.default_memory_pool().release_unused()  # the worker lives on
        if files.done:
            file, records, n, size = zip(*files.done, strict=True)
            yield record(path=pa.array([path] * len(file)), file=pa.array(file), records=records, ids=n, bytes=size)

    order = ["id", "tie", "row"]
    frame = slim(docs, id_col, text_col, tie=F.xxhash64(F.col(text_col).cast("string")), row=F.monotonically_increasing_id())
    dealt = frame.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("id").cast("string").alias("id"), "text")
    return written(dealt.mapInArrow(run, "path string, file string, records long, ids long, bytes long"), "record-files")


def _index(store: fs.FileSystem, base: str, file: str) -> np.ndarray:
    with store.open_input_file(f"{base}/{file}.index") as index:
        return np.frombuffer(index.read(), ENTRY)


def _batches_of(entries: np.ndarray) -> Iterator[np.ndarray]:
    """Entries whose records follow each other, cut at about ``READ_BYTES``."""
    begin = 0
    total = 0
    for i, size in enumerate(entries["size"].tolist()):
        apart = i > begin and int(entries["offset"][i]) != int(entries["offset"][i - 1] + entries["size"][i - 1])
        if i > begin and (apart or total + size > READ_BYTES):
            yield entries[begin:i]
            begin, total = i, 0
        total += size
    if begin < len(entries):
        yield entries[begin:]


def _sequences(store: fs.FileSystem, base: str, file: str, start: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    with store.open_input_file(f"{base}/{file}.records") as source:
        for some in _batches_of(entries):
            sizes = some["size"].astype(np.int64)
            data = source.read_at(int(sizes.sum()), int(some["offset"][0]))
            if len(data) != sizes.sum():
                raise ValueError(f"{file}: it ends before the index does")
            rows = [parsed(x) for x in unframed(data, sizes, file)]
            if [len(x) for _, x in rows] != some["n"].tolist():
                raise ValueError(f"{file}: a record doesn't have as many ids as the index says")
            yield record(
                id=pa.array([d for d, _ in rows], pa.string()),
                start=some["first"].astype(np.int64) + start,
                ids=pa.array([x.tobytes() for _, x in rows], pa.binary()),
            )


def placed(files: DataFrame) -> DataFrame:
    """``files`` with ``start``: the ids in all files before. One row per file goes to one task."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_records(files: DataFrame, id_type: str = "string", id_col: str = "doc_id", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(id_col, start, ids)`` of each record in the files of ``write_records``.

    ``start`` is how many ids all documents before have; ``ids`` are little-endian
    unsigned 32-bit integers. Files are read in ranges of ``split_bytes`` that the index
    gives, so tasks don't depend on how large files are. Both checksums and the index's
    own lengths are checked. No files give no rows.
    """

    def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                entries = _index(*_store(row["path"]), row["file"])
                cuts = np.flatnonzero(np.diff(entries["offset"] // np.uint64(split_bytes))) + 1
                bounds = [0, *cuts.tolist(), len(entries)]
                yield record(
                    path=pa.array([row["path"]] * (len(bounds) - 1)), file=pa.array([row["file"]] * (len(bounds) - 1)),
                    start=[row["start"]] * (len(bounds) - 1), begin=bounds[:-1], end=bounds[1:],
                )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, base = _store(row["path"])
                entries = _index(store, base, row["file"])[row["begin"] : row["end"]]
                yield from _sequences(store, base, row["file"], row["start"], entries)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = placed(files).mapInArrow(ranges, "path string, file string, start long, begin long, end long")
    rows = split.repartition(parts, "file", "begin").mapInArrow(run, "id string, start long, ids binary")
    return rows.select(F.col("id").cast(id_type).alias(id_col), "start", "ids")


def read_shuffled(files: DataFrame, seed: int, id_type: str = "string", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``read_records`` in an order that ``seed`` gives, through the offset index alone.

    Only index entries are shuffled; each record is then read at its own offset.
    """

    def entries_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = _index(*_store(row["path"]), row["file"])
                parts = {n: found[n].astype(np.int64) for n in ENTRY.names}
                same = [pa.array([row[c]] * len(found)) for c in ("path", "file", "start")]
                yield record(path=same[0], file=same[1], start=same[2], **parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                entry = np.array([tuple(row[n] for n in ENTRY.names)], ENTRY)
                yield from _sequences(*_store(row["path"]), row["file"], row["start"], entry)

    fields = ", ".join(f"{n} long" for n in ENTRY.names)
    entries = placed(files).mapInArrow(entries_of, f"path string, file string, start long, {fields}")
    mixed = entries.withColumn("mix", F.xxhash64("file", "offset", F.lit(seed)))
    dealt = mixed.repartitionByRange("mix", "file", "offset").sortWithinPartitions("mix", "file", "offset").drop("mix")
    rows = dealt.mapInArrow(run, "id string, start long, ids binary")
    return rows.select(F.col("id").cast(id_type).alias(id_col), "start", "ids")


def stored(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` written to files in the shared folder and read back: ``(id_col, start, ids)``."""
    path = work_folder(docs.sparkSession, "records")
    files = write_records(docs, path, vocabulary, end_id, id_col, text_col)
    return read_records(files, docs.select(id_col).schema[0].dataType.simpleString(), id_col)
