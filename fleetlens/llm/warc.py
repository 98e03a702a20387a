"""WARC archives of pages, read back, with an index merged from sorted runs."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice
from typing import BinaryIO
from urllib.parse import unquote_plus, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import ways, written
from fleetlens.session import work_folder

LEAST_BYTES = 1000  # smaller payloads are always stored
RECORDS_PER_FILE = 20_000
FIRST_CAPTURE = 1_700_000_000  # seconds; captures without a time are spread over a year from here
YEAR = 31_536_000

# Fixed values of the format.
VERSION = "WARC/1.0"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LINE = "\r\n"
RECORD_END = "\r\n\r\n"


NAMED, NAMELESS = "<urn:x-page:", "<urn:x-nopage:>"


def _name(id_: Column) -> Column:
    named = F.concat(F.lit(NAMED), F.url_encode(id_.cast("string")), F.lit(">"))
    return F.coalesce(named, F.lit(NAMELESS))


def _header(*fields: tuple[str, Column]) -> Column:
    """Lines of those fields that aren't null, and the empty line after them."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    return F.concat(F.concat_ws(LINE, *lines), F.lit(RECORD_END))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    captured: Column | None = None,
) -> None:
    """Write a record per page to gzipped archives in the new folder ``path``.

    Of pages with equal payloads of ``LEAST_BYTES`` or more, the one with the largest id is a
    response with the payload, and the others are revisit records that refer to it.
    The payload is the page in UTF-8; a null page is empty. A page without URL gets one
    made of its id, one without a time of capture a time made of a hash of its id. Where a
    page is repeated under the largest id, each row is a response.
    """
    spread = F.timestamp_seconds(F.pmod(F.xxhash64(id_col), F.lit(YEAR)) + FIRST_CAPTURE)
    captured = spread if captured is None else F.coalesce(captured.cast("timestamp"), spread)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        captured.alias("captured"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("bytes"),
        F.sha1(html.cast("binary")).alias("digest"),
    )
    large = rows.where(F.col("bytes") >= LEAST_BYTES)
    groups = written(
        large.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"),
        "warc-groups",
    )
    # Both sides are plain tables, so that adaptive execution can split a frequent payload.
    named = rows.join(groups, "digest", "left")
    again = (F.col("bytes") >= LEAST_BYTES) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(RECORD_END),
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.concat(F.lit("urn:x-page:"), F.col("id").cast("string")), F.lit("urn:x-page:"))
    header = _header(
        ("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", _name(F.col("id"))),
        ("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(again, F.lit(SAME_PAYLOAD))),
        ("WARC-Refers-To", F.when(again, _name(F.col("first")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    )
    records = named.withColumn("block", block).select(F.concat(F.lit(VERSION + LINE), header, F.col("block")).alias("value"))
    writer = records.write.option("lineSep", RECORD_END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class Unzipped:
    """Bytes of a gzip stream, read and inflated a piece at a time; at most one record is held."""

    def __init__(self, source: BinaryIO):
        self.source, self.held, self.offset = source, bytearray(), 0
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        raw = self.inflate.unused_data if self.inflate.eof else b""
        raw = raw or self.source.read(1 << 16)
        if not raw:
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)  # the next member
        self.held += self.inflate.decompress(raw)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes up to and with ``mark``; none at the end."""
        seen = 0
        while (found := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError(f"the archive ends within a record at {self.offset}")
        out = bytes(self.held[:n])
        del self.held[:n]
        self.offset += n
        return out


def records(archive: bytes | BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields (names in lower case) and block of each record of an archive."""
    source = Unzipped(io.BytesIO(archive) if isinstance(archive, bytes) else archive)
    end = RECORD_END.encode()
    while True:
        offset = source.offset
        head = source.until(end)
        if head is None:
            return
        version, *lines = head.decode("utf-8", "replace").split(LINE)
        if version != VERSION:
            raise ValueError(f"no record at {offset}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}
        block = source.take(int(fields["content-length"]))
        if source.take(len(end)) != end:
            raise ValueError(f"the record at {offset} doesn't end where its header says")
        yield offset, fields, block


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then path and query: sorts hosts together."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    query = f"?{parts.query}" if parts.query else ""
    return f"{labels}{f':{port}' if port else ''}){parts.path or '/'}{query}".lower()


ENTRY = (
    "url_key string, captured string, id string, run string, file string, offset long, payload_bytes long, "
    "payload_digest string, record_type string, refers_to string"
)
COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]
TYPES = [pa.int64() if c.endswith(" long") else pa.string() for c in ENTRY.split(", ")]


def _id_in(name: str | None) -> str | None:
    return unquote_plus(name.removeprefix(NAMED).removesuffix(">")) if name and name.startswith(NAMED) else None


def _entry(file: str, offset: int, fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(RECORD_END.encode())
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{file} at {offset}: the payload doesn't have its digest")
    else:  # the length that the full payload was served with
        size = int(next(x for x in head.decode().split(LINE) if x.lower().startswith("content-length:")).split(":")[1])
    return (
        url_key(fields["warc-target-uri"]), fields["warc-date"], _id_in(fields["warc-record-id"]), file,
        file.rsplit("/", 1)[-1], offset, size, digest, kind, _id_in(fields.get("warc-refers-to")),
    )


def _order(entry: Sequence) -> tuple:
    return entry[0], entry[1], entry[2] or "", entry[4], entry[5]


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*entries, strict=True)) or [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=COLUMNS)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all records below ``path``: each archive is one run, sorted by
    URL key, time and id. Payloads are checked against their digests.

    An archive is read as a stream, so a task holds one record of it and its entries,
    whatever its size.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                store, place = _opened(name)
                with store.open_input_stream(place, compression=None) as archive:
                    yield _batch(sorted((_entry(name, *parts) for parts in records(archive)), key=_order))

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(ways(spark), "path").mapInArrow(run, ENTRY)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)
    return fs.FileSystem.from_uri(path)


class LoserTree:
    """Merges sorted runs: each inner node holds the run that lost there, so that taking
    the next entry replays only the path from one leaf to the root."""

    def __init__(self, runs: list[Sequence], key: Callable = _order):
        self.runs, self.key = [r for r in runs if r], key
        self.at = [0] * len(self.runs)
        self.keys: list[tuple | None] = [key(r[0]) for r in self.runs]
        self.losers = [-1] * max(1, len(self.runs))
        for i in range(len(self.runs) - 1, -1, -1):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _replay(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node:
            loser = self.losers[node]
            if loser < 0:  # nobody has come here yet: wait for an opponent
                self.losers[node] = winner
                return
            if self._beats(loser, winner):
                self.losers[node], winner = winner, loser
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.keys[best := self.losers[0]] is not None:
            run = self.runs[best]
            yield run[self.at[best]]
            self.at[best] += 1
            self.keys[best] = self.key(run[self.at[best]]) if self.at[best] < len(run) else None
            self._replay(best)


def merged_index(runs: DataFrame) -> DataFrame:
    """All entries in one global order by URL key, time and id.

    Runs are cut at the same places, which Spark takes from a sample of all keys; each
    task merges its piece of every run. Entries of one URL or one host may be in many
    tasks, since times and ids also decide where they go. As the exchange mixes the runs,
    Spark puts each piece in order again, spilling if need be; the tree then merges the
    pieces where they lie, in Arrow columns.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        key, captured, ids, files, offsets = (table[c].combine_chunks() for c in ("url_key", "captured", "id", "run", "offset"))
        lengths = pc.run_end_encode(files).run_ends.to_pylist()
        pieces = [range(a, b) for a, b in zip([0, *lengths], lengths, strict=False)]

        def order_of(i: int) -> tuple:
            return key[i].as_py(), captured[i].as_py(), ids[i].as_py() or "", files[i].as_py(), offsets[i].as_py()

        merged = iter(LoserTree(pieces, order_of))
        while block := list(islice(merged, 10_000)):
            yield from table.take(pa.array(block)).combine_chunks().to_batches()

    order = ["url_key", "captured", F.coalesce("id", F.lit("")), "run", "offset"]
    return runs.repartitionByRange(*order).sortWithinPartitions("run", *order).mapInArrow(run, ENTRY)


def archived(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: Column | None = None
) -> DataFrame:
    """Pages written as archives to the shared folder and read back, as a merged index:
    ``(id_col, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, file,
    offset)`` in the order of URL key and time.

    ``offset`` is that of the record in the unzipped archive. Ids come back in their type.
    No pages give no archives and no rows.
    """
    spark = pages.sparkSession
    path = work_folder(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col, captured)
    kind = pages.select(id_col).schema[0].dataType
    merged = merged_index(written(read_runs(spark, path), "warc-runs"))
    return merged.select(
        F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "url_key", "captured", "file", "offset",
    )
